"""Whether a text is finished: a stack automaton for structure, an end-of-text n-gram model
for prose.

The model is fitted on all rows.  It reads tokens as classes
(numbers, dates, versions, dotted identifiers, rare words) at two grains and counts, for
every n-gram, how often a sentence ends after it and how often it goes on.  A text that
stops where sentences go on was cut.  Texts that end with a terminator, and perhaps an
ornament after it, are finished unless a structure is open.
"""

from __future__ import annotations

import json
import re
from collections import Counter

import numpy as np
import xxhash

#: How sure the model has to be at most that a value without a terminator is finished.
SURE = 0.8
_CJK = "一-鿿"
#: Characters before the end that are looked at first.
_TAIL = 240
_LETTER = rf"[^\W\d_{_CJK}]"
# what was matched is never given back: no shorter piece would fit better
_TOKEN = re.compile(rf"{_LETTER}++(?:[._]{_LETTER}++)*+|\d{{4}}-\d\d-\d\d|\d++(?:\.\d++)*+|[{_CJK}]|\n|[^\w\s]")
#: The same for texts of ASCII alone, with sets of characters in place of Unicode's classes.
_ASCII = re.compile(
    r"[A-Za-z]++(?:[._][A-Za-z]++)*+|[0-9]{4}-[0-9][0-9]-[0-9][0-9]|[0-9]++(?:\.[0-9]++)*+|\n|[!-/:-@\[-^`{-~\x00-\x08\x0e-\x1b\x7f]"
)
# What stands for no answer.
STAND_INS = {
    "n/a", "na", "none", "null", "nil", "nan", "undefined", "empty", "no response", "no answer", "no output",
    "tbd", "todo", "keine antwort", "sin respuesta", "aucune réponse", "无", "暂无", "无回答", "没有回答",
}
#: A beginning that no empty answer has: more than the longest stand-in from one letter or digit to another, without tags.
_LONG = re.compile(rf"[^\W_][^<&\u200b\u200c\u200d\u2060\ufeff]{{{max(map(len, STAND_INS))},{2 * max(map(len, STAND_INS))}}}?[^\W_]")
# Marks that end a sentence, marks that close around one, and what people or
# programs put after a break.
TERMINATORS = ".!?。！？؟।"
CLOSERS = "\"'”’»)）]】」』*_`›"
BREAK_MARKS = re.compile(
    r"(?:\s|…|\.{2,}|�|[\[(<（](?:truncated|cut|cut off|continued|more|snip|\.\.\.|…|未完|截断|省略)[\])>）])+$",
    re.I,
)
_BREAK_CHARS = frozenset("…�])>）.")
#: Marks with which a structure can begin; a text without any that ends with one terminator is finished.
_BEGINS = re.compile("[\"`<*“«（【「『({\\[]")
_OPEN = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»", "（": "）", "【": "】", "「": "」", "『": "』"}
_CLOSE = {v: k for k, v in _OPEN.items()}
_STRUCT = re.compile("```|\\*\\*|<!--|-->|</?[a-zA-Z][a-zA-Z0-9]*(?:\\s[^<>]*)?/?>|[\"`" + re.escape("".join(_OPEN) + "".join(_CLOSE)) + "]")
# Elements that need no end.
_VOID = {"br", "hr", "img", "input", "p", "li", "td", "tr", "th", "meta", "link", "wbr"}
_ORNAMENT = re.compile(r"(?:\s*(?:[:;]-?[)(DP]|\((?:ok|end|done|fin|fertig|hecho)\)|（完）|[^\w\s.,:;!?\-–—(){}\[\]<>=/\\|#+&%$§@\"'`。！？，、；：（）【】「」『』“”«»…]+))+$", re.I)
_TAGS = re.compile(r"<[^<>]*>|[\u200b\u200c\u200d\u2060\ufeff]|&nbsp;")
_MARKED = re.compile(rf"(?:[{re.escape(TERMINATORS)}]|```)[{re.escape(CLOSERS)}\s]*$")
_BROKEN_ESCAPE = re.compile(r"(?:\\u[0-9a-fA-F]{0,3}|\\x[0-9a-fA-F]?|(?<!\\)\\|&(?:#\d{0,4}|#x[0-9a-f]{0,4}|[a-z]{1,6})|<[a-zA-Z/][^<>]{0,40}|%[0-9A-F]?)$")


def tokens_of(text: str) -> list[str]:
    return (_ASCII if text.isascii() else _TOKEN).findall(text)


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    # longer than any stand-in, with nothing in it that is taken out
    if _LONG.match(answer):
        return False
    bare = _TAGS.sub(" ", answer).strip()
    if not re.search(r"[^\W_]", bare):
        return True
    return re.sub(r"^[\W_]+|[\W_]+$", "", bare).lower() in STAND_INS


def open_structure(text: str) -> str:
    """The innermost structure that is open at the end of ``text``, "" if none: brackets, quotes,
    code, bold type, comments and elements.  Closers without an opener, as in smileys and list
    numbers, do not matter, nor elements that need no end."""
    stack: list[str] = []
    for m in _STRUCT.finditer(text):
        mark = m.group()
        if mark == "```":
            if "```" in stack:
                del stack[stack.index("```"):]
            else:
                stack.append(mark)
        elif "```" in stack:
            continue
        elif mark in ('"', "`", "**"):
            # marks that close themselves; an inch or a list star has white space or a number before it
            if mark in stack:
                del stack[stack.index(mark):]
            elif not (mark == '"' and text[m.start() - 1:m.start()].isdigit()) and not (mark == "**" and text[m.end():m.end() + 1].isspace()):
                stack.append(mark)
        elif mark == "<!--":
            stack.append(mark)
        elif mark == "-->":
            if "<!--" in stack:
                del stack[stack.index("<!--"):]
        elif mark[0] == "<":
            name = mark.strip("</>").split()[0].lower()
            if mark[1] == "/":
                if f"<{name}>" in stack:
                    del stack[len(stack) - 1 - stack[::-1].index(f"<{name}>"):]
            elif not mark.endswith("/>") and name not in _VOID:
                stack.append(f"<{name}>")
        elif mark in _OPEN:
            if not (mark in "([{" and text[m.start() - 1:m.start()] in (":", ";", "-", "=")):
                stack.append(mark)
        elif _CLOSE[mark] in stack:
            del stack[len(stack) - 1 - stack[::-1].index(_CLOSE[mark]):]
    return stack[-1] if stack else ""


def open_json(text: str) -> bool:
    """Whether a JSON text stops inside a string, array, object, number or literal."""
    depth: list[str] = []
    quoted = escaped = False
    for c in text:
        if quoted:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in "[{":
            depth.append(c)
        elif c in "]}" and depth:
            depth.pop()
    return quoted or bool(depth)


class Words:
    """The word list of a collection of texts, and the n-grams of word classes before a place in a text.

    ``words`` of ``n_texts`` texts come most frequent first.  An n-gram is known by a polynomial of the hashes of its
    classes, so those of all places of many texts are a few array operations."""

    ORDERS = (("c", 7), ("f", 5), ("c", 5), ("f", 3))
    #: Shorter contexts, asked where none of the others was seen.
    SHORTER = (("c", 3), ("f", 1))

    def __init__(self, words: list[str], n_texts: int, function_words: int = 70):
        #: Times from which on a context counts no more than others, in proportion to the texts: with many
        #: texts rare contexts would else count as much as frequent ones.
        self.enough = max(40, n_texts // 400)
        self.known = frozenset(words)
        # short frequent words stand for themselves at the coarse grain: mostly articles,
        # prepositions and pronouns in any of the languages
        self.common = frozenset([w for w in words if len(w) <= 4][:function_words])
        self._codes: dict[str, tuple[int, int]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_codes": {}}

    @staticmethod
    def counts(texts: list[str]) -> Counter:
        """In how many texts each word stands."""
        seen: Counter = Counter()
        for t in texts:
            tokens = tokens_of(t)
            # an unmarked last token may be a piece of a word
            seen.update({w.lower() for w in (tokens if t[-1:] in TERMINATORS else tokens[:-1])})
        return seen

    @staticmethod
    def least(n_texts: int) -> int:
        """Texts in which a word has to stand to count as itself."""
        return max(3, n_texts // 2_000)

    def _class(self, w: str) -> tuple[str, str]:
        low = w.lower()
        if w[0].isdigit():
            k = "D" if len(w) == 10 and w[4] == "-" else "V" if "." in w else "9"
            return k, k
        if len(w) > 2 and ("." in w or "_" in w):
            return "I", "I"
        if low in self.known:
            return low, low if low in self.common or not w.isalpha() or "一" <= w <= "鿿" else "w"
        return "N", "N"

    def _code(self, w: str) -> tuple[int, int]:
        """Hashes of the fine and the coarse class of a token."""
        code = self._codes.get(w)
        if code is None:
            if len(self._codes) > 200_000:
                self._codes.clear()
            fine, coarse = self._class(w)
            code = self._codes[w] = (xxhash.xxh64_intdigest(fine), xxhash.xxh64_intdigest(coarse))
        return code

    def grams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(n-grams of ``texts``, how often each stands there, how often a sentence ends after it)."""
        docs = [["\n", *tokens_of(t)] for t in texts]
        tokens = [w for d in docs for w in d]
        if not tokens:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        # tokens are few others again and again, so each one is looked at once
        numbers: dict[str, int] = {}
        which = np.fromiter((numbers.setdefault(w, len(numbers)) for w in tokens), np.int64, len(tokens))
        fine, coarse = (np.fromiter(x, np.uint64, len(numbers)) for x in zip(*map(self._code, numbers)))
        sizes = np.array([len(d) for d in docs])
        at = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        stop = np.array([w in TERMINATORS or w == "\n" for w in numbers])[which]
        last = at + 1 == np.repeat(sizes, sizes)
        # an unmarked last word that no other text knows may be a piece of one
        place = ~stop & ~(last & (fine == _RARE)[which])
        ending = (last | np.r_[stop[1:], True])[place]
        found = []
        for code, grain, longest in ((coarse[which], "c", 7), (fine[which], "f", 5)):
            total, factor = np.zeros(len(tokens), np.uint64), 1
            for n in range(1, longest + 1):
                # the n-th token from the end, where the text has one
                back = np.where(at >= n - 1, np.r_[np.zeros(n - 1, np.uint64), code[:len(code) - n + 1]], np.uint64(0))
                total = total + back * np.uint64(factor)
                factor = factor * _FACTOR & _MASK
                if (grain, n) in self.ORDERS + self.SHORTER:
                    # the lowest bit of a key gives way to whether a sentence ends, so one sort counts both
                    keys = (total + np.uint64(_SEED[grain, n]))[place]
                    keys = np.sort(keys & ~np.uint64(1) | ending)
                    first = np.flatnonzero(np.r_[True, keys[1:] >> np.uint64(1) != keys[:-1] >> np.uint64(1)]) if len(keys) else np.zeros(0, np.int64)
                    many = np.diff(np.r_[first, len(keys)])
                    ends = np.add.reduceat((keys & np.uint64(1)).astype(np.int64), first) if len(keys) else many
                    found.append(((keys[first] & ~np.uint64(1)).view(np.int64), many, ends))
        return tuple(np.concatenate(x) for x in zip(*found))

    def contexts(self, text: str) -> tuple[bool, list[int]]:
        """(whether the last word is a piece of one, n-grams before the end, of ORDERS and SHORTER)."""
        tail, tokens, most = 0, [], self.ORDERS[0][1]
        # a stretch from the end that holds the longest context, and one token that its start may cut
        while tail < len(text) and len(tokens) <= most:
            tail = min(len(text), 2 * tail or _TAIL)
            tokens = tokens_of(text[len(text) - tail:])
            while tokens and tokens[-1] == "\n":
                tokens.pop()
        if not tokens:
            return False, []
        if tail == len(text):
            tokens.insert(0, "\n")
        codes = [self._code(w) for w in tokens[:-most - 1:-1]]
        if codes[0][0] == _RARE and tokens[-1][0].islower():
            return True, []
        keys = []
        for grain, n in self.ORDERS + self.SHORTER:
            total, factor = _SEED[grain, n], 1
            for code in codes[:n]:
                total, factor = total + code[grain == "c"] * factor, factor * _FACTOR & _MASK
            total &= _MASK - 1
            keys.append(total - (total >> 63 << 64))
        return False, keys


_MASK, _FACTOR = (1 << 64) - 1, 0x9E3779B97F4A7C15
_RARE = xxhash.xxh64_intdigest("N")
_SEED = {(g, n): xxhash.xxh64_intdigest(f"{g}{n}") for g, n in Words.ORDERS + Words.SHORTER}
#: Contexts seen so often or less say nothing.
RARE = 3


class EndModel:
    """Word list and n-gram counts of sentence ends of ``texts``, where these fit in memory;
    ``truncation`` counts the same over a table."""

    def __init__(self, texts: list[str], vocabulary: int = 6_000, function_words: int = 70):
        least = Words.least(len(texts))
        seen = [(w, n) for w, n in Words.counts(texts).items() if n >= least]
        self.words = Words([w for w, _ in sorted(seen, key=lambda x: (-x[1], x[0]))[:vocabulary]], len(texts), function_words)
        self.seen = {k: (n, e) for k, n, e in zip(*(x.tolist() for x in self.words.grams(texts))) if n > RARE}

    def finished(self, keys: list[int]) -> float | None:
        """Probability that a sentence ends after contexts; None without evidence."""
        numbers = [self.seen.get(k) for k in keys]
        longer = len(Words.ORDERS)
        found = [x for x in numbers[:longer] if x] or [x for x in numbers[longer:] if x]
        weight = sum(min(n, self.words.enough) for n, _ in found)
        return sum(min(n, self.words.enough) * (e + 0.5) / (n + 1) for n, e in found) / weight if weight else None


def _body_end(text: str) -> int:
    """Where a mark of a break, or white space, at the end of ``text`` begins."""
    if not text or not (text[-1] in _BREAK_CHARS or text[-1].isspace()):
        return len(text)
    # marks are short, so the search begins near the end unless all of that belongs to one
    start = max(0, len(text) - 200)
    m = BREAK_MARKS.search(text, start)
    if m and m.start() == start and start:
        m = BREAK_MARKS.search(text)
    return m.start() if m else len(text)


def marked(text: str) -> bool:
    """Whether ``text`` ends with a terminator, maybe with closers or ornaments after it."""
    bare = text.rstrip()
    return bool(_MARKED.search(bare) or _MARKED.search(_ORNAMENT.sub("", bare)))


def limit(baseline: float) -> float:
    """How sure the model has to be that a value is finished: between an even chance and SURE."""
    return min(max(baseline, 0.5), SURE)


def verdict(text: str | None, words: Words, baseline: float = 1.0) -> bool | list[int]:
    """Whether prose stops before its word, sentence, listing or structure is finished; where its
    structure does not tell, the contexts of which the counts decide.

    ``baseline`` is the share of the values of the same source and field that end with a terminator:
    the more of them do, the surer the model has to be that a value without one is finished."""
    # most texts, at the cost of one search
    if text and text[-1] in TERMINATORS and text[-2:-1] not in TERMINATORS and text[-2:-1].isalnum() and not _BEGINS.search(text):
        return False
    if is_empty(text):
        return False
    bare = text[:_body_end(text)]
    after = text[len(bare):].strip()
    if after:
        # a mark of a break is believed unless the text before it was finished
        return not marked(bare)
    if open_structure(bare):
        return True
    if marked(bare):
        return False
    if _BROKEN_ESCAPE.search(bare) and not bare.rstrip().endswith(">"):
        return True
    body = _ORNAMENT.sub("", bare)
    if body != bare and marked(body):
        return False
    if body.rstrip()[-1:] in ",;:，、；：（([{=":
        return True
    piece, keys = words.contexts(body.rstrip(CLOSERS + " "))
    # without any evidence the baseline decides alone
    return keys or piece or baseline >= SURE


def verdicts(text: str | None, words: Words, baseline: float = 1.0) -> bool | list[list[int]]:
    """Whether a JSON text, or the ``content`` of an element of it, stops before its end; where their
    structure does not tell, the contexts of each content of which the counts decide."""
    if not text or not text.strip():
        return False
    try:
        value = json.loads(text)
    except ValueError:
        bare = BREAK_MARKS.sub("", text)
        return open_json(bare) or (not bare.rstrip().endswith(("]", "}", '"')) and not bare.strip()[-1:].isalnum())
    asked = []
    for item in value if isinstance(value, list) else [value]:
        if isinstance(item, dict) and isinstance(item.get("content"), str):
            found = verdict(item["content"], words, baseline)
            if found is True:
                return True
            if found:
                asked.append(found)
    return asked or False


def _decided(keys: list[int], model: EndModel, baseline: float) -> bool:
    p = model.finished(keys)
    return baseline >= SURE if p is None else p < limit(baseline)


def broken_text(text: str | None, model: EndModel, baseline: float = 1.0) -> bool:
    """``verdict`` with the counts of ``model``."""
    found = verdict(text, model.words, baseline)
    return found if isinstance(found, bool) else _decided(found, model, baseline)


def broken_json(text: str | None, model: EndModel, baseline: float = 1.0) -> bool:
    """``verdicts`` with the counts of ``model``."""
    found = verdicts(text, model.words, baseline)
    return found if isinstance(found, bool) else any(_decided(keys, model, baseline) for keys in found)
