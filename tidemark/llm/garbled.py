"""Garbled text from wrong character encodings, found and restored by a hidden Markov model.

States are ``clean`` and one per encoding pair (written in X, read as Y).  Only characters
outside ASCII are observations, since all pairs leave ASCII alone.  Emissions are counted
on all documents: as they stand for ``clean``, and garbled by each pair for that pair's state;
documents that a first pass over all of them labels are then left out of the counts.  Viterbi labels the characters, and once more with the wrong decoding that labels
most of the document, which makes a change to it at the start of a run cheaper.  Each labelled
span gets the inverse transform of its state, its ends moved by up to three characters where they
cut a character's bytes; it counts only if the inverse exists and reads better under the clean
emissions.  Characters that the model labels clean stay as they are.  Texts garbled twice are
labelled again after the first restoration.

A path leaves the clean state only if the characters that some other state emits more
readily gain more than a change to it costs, so the sums of those gains, and then the best
stretch in each state, come first and pass most documents by without a Viterbi run; both bounds
are exact.

Defined cases: null and empty texts are sound; a span standing alone between quotation
marks is a quoted example and stays; if characters were lost (replacement characters in a
garbled span) the text can not be had and the hash is empty; equal texts give equal rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOST = "�"
# Encoding pairs, written in the first and read as the second.
PAIRS = [
    ("utf-8", "latin-1"), ("utf-8", "cp1252"), ("utf-8", "cp1251"), ("utf-8", "mac_roman"),
    ("utf-8", "gb18030"), ("cp1252", "utf-8"), ("gb18030", "utf-8"), ("utf-8", "cp1250"), ("utf-8", "iso-8859-15"),
    ("utf-8", "cp437"), ("gb18030", "latin-1"),
]
#: What a change to a pair costs more: the last four are rarer and much like earlier ones.
_PRIOR = [0.0] * 7 + [-2.0] * 4
# Marks that open and close a quoted example.
OPENING, CLOSING = "“\"'‘«`„「『（(‹", "”\"'’»`“」』）)›"
_RUN = re.compile(r"[^\x00-\x7f]+")
_PART = re.compile(r"[^。，、；：？！]+")
_UNSEEN = -13.0
_SWITCH, _SWITCH_GAP = -5.0, -3.5
#: What a change to or from the document's own wrong decoding costs less.
_KNOWN = 2.0
#: Characters, times documents, that are labelled at a time.
_CELLS = 400_000


def _byte_table(codec: str) -> tuple[dict[int, str], dict[str, int]]:
    """Characters of single bytes; bytes without one stand for the control of their number."""
    read = {b: bytes([b]).decode(codec, "ignore") or chr(b) for b in range(256)}
    return read, {c: b for b, c in reversed(read.items())}


_TABLES = {y: _byte_table(y) for x, y in PAIRS if x == "utf-8" and y not in ("gb18030",)}


def garble(text: str, written: str, read: str) -> str:
    raw = text.encode(written, "ignore")
    if read in _TABLES:
        table = _TABLES[read][0]
        return "".join(map(table.__getitem__, raw))
    return raw.decode(read, "replace")


def invert(span: str, written: str, read: str) -> str | None:
    """The text of which ``span`` is the garbled form, None if there is none."""
    if LOST in span:
        return None
    try:
        if read in _TABLES:
            table = _TABLES[read][1]
            # a control read by Latin-1 stays one under the other tables, too
            raw = bytes(table[c] if c in table else ord(c) for c in span)
        else:
            raw = span.encode(read)
        return raw.decode(written)
    except (UnicodeError, KeyError, ValueError):
        return None


#: Pairs whose characters depend on those before: they are counted on the garbled texts, the characters
#: of the others come from the counts of the clean ones.
_BOUND = [i for i, (_, read) in enumerate(PAIRS, 1) if read not in _TABLES]


def emissions(texts: list[str]) -> dict[int, Counter]:
    """Characters outside ASCII by state: as they stand, and garbled by the pairs of ``_BOUND``."""
    odd = [t for t in texts if not t.isascii()]
    out = {0: _characters(odd)}
    return out | {i: _characters([garble(t, *PAIRS[i - 1]) for t in odd]) for i in _BOUND}


def _characters(texts: list[str]) -> Counter:
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds, many = np.unique(code[code > 127], return_counts=True)
    return Counter(dict(zip(map(chr, kinds.tolist()), many.tolist())))


class Model:
    """Emission tables, the screen and the Viterbi labelling."""

    def __init__(self, texts: list[str]):
        seen = emissions(texts)
        self.fit(seen)
        # second estimate without the documents that the first one labels
        bad = self.labelled(texts)
        if len(bad) < len(texts):
            self.fit(without(seen, emissions(bad)))

    @classmethod
    def of(cls, seen: dict[int, Counter]) -> Model:
        model = cls.__new__(cls)
        model.fit(seen)
        return model

    def labelled(self, texts: list[str]) -> list[str]:
        """The garbled ones of ``texts``."""
        odd = [t for t in texts if self.suspect(t)]
        return [t for t, out in zip(odd, self.restore_all(odd)) if out is not None]

    @staticmethod
    def _read(counts: Counter, written: str, read: str) -> Counter:
        """How often each character outside ASCII comes out of characters garbled one by one."""
        out: Counter = Counter()
        table = _TABLES[read][0]
        for c, n in counts.items():
            for b in c.encode(written, "ignore"):
                if table[b] > "\x7f":
                    out[table[b]] += n
        return out

    def fit(self, counts: dict[int, Counter]) -> None:
        clean = Counter(counts[0])
        tables = [clean]
        # the curly quotes and the dash that word processors write are clean everywhere
        clean.update({c: 5 for c in "“”‘’–—…«»éèàçùâêîôûäöüßñáíóú¿¡。，？！：；、（）"})
        for i, (written, read) in enumerate(PAIRS, 1):
            if i in _BOUND:
                seen = Counter(counts[i])
            else:
                seen = self._read(counts[0], written, read)
                # some texts are garbled twice the same way, which adds characters: a quarter here
                for c, n in self._read(seen, written, read).items():
                    seen[c] += n / 4
            seen[LOST] += 1
            tables.append(seen)
        chars = sorted(set().union(*tables))
        logs = np.full((len(tables), len(chars)), _UNSEEN)
        at = {c: i for i, c in enumerate(chars)}
        for s, seen in enumerate(tables):
            total = sum(seen.values()) + 0.02 * len(chars)
            base = math.log(0.02 / total) if total else _UNSEEN
            logs[s, :] = max(base, _UNSEEN)
            for c, n in seen.items():
                logs[s, at[c]] = math.log((n + 0.02) / total)
        # the last row stands for characters that no state has seen
        self.at, self.logs = at, np.vstack([logs.T, np.full(len(tables), _UNSEEN)])
        self.margin = self.logs[:, 1:] - self.logs[:, :1]
        self.unseen = np.full(len(tables), _UNSEEN)
        suspicious = [c for c in chars if logs[1:, at[c]].max() > logs[0, at[c]] + 1e-9]
        suspicious += [LOST]
        self.lead = np.maximum(logs[1:] - logs[0], 0.0).T.copy()
        self.spot = {c: at[c] for c in suspicious}
        self.screen = re.compile("[\x80-\x9f" + "".join(map(re.escape, dict.fromkeys(suspicious))) + "]")

    def suspect(self, text: str) -> bool:
        """Whether a path through another state can beat the clean one at all: all its stretches in
        one state gain at most what the text's characters are likelier there, and pay one change."""
        odd = [i for c in self.screen.findall(text) if (i := self.spot.get(c)) is not None]
        if not odd or not (self.lead[odd].sum(axis=0) + _PRIOR > -_SWITCH_GAP).any():
            return False
        # the same for the best stretch of each state, with what its other characters lose
        last = len(self.logs) - 1
        at = self.at.get
        gain = self.margin[[at(c, last) for c in "".join(_RUN.findall(text))]].cumsum(axis=0)
        low = np.minimum(np.minimum.accumulate(np.vstack([np.zeros(gain.shape[1]), gain[:-1]])), 0.0)
        return bool(((gain - low).max(axis=0) + _PRIOR > -_SWITCH_GAP).any())

    def _row(self, c: str) -> np.ndarray:
        i = self.at.get(c)
        return self.unseen if i is None else self.logs[i]

    def clean_score(self, text: str) -> float:
        """Mean log emission of the clean state per character outside ASCII."""
        odd = [self._row(c)[0] for c in text if c > "\x7f"]
        return sum(odd) / len(odd) if odd else 0.0

    def label(self, docs: list[list[str]], mains: list[int] | None = None) -> list[list[np.ndarray]]:
        """Most likely states of the characters of all runs of every document.  ``mains`` are the
        wrong decodings that are known of the documents, so between two runs a change between one
        and the clean state costs less."""
        out: list = [None] * len(docs)
        # the longest first, so that the documents still open are always the first ones
        order = sorted(range(len(docs)), key=lambda d: -sum(map(len, docs[d])))
        lo = 0
        while lo < len(order):
            longest = max(1, sum(map(len, docs[order[lo]])))
            some = order[lo:lo + max(1, _CELLS // longest)]
            paths = self._viterbi([docs[d] for d in some], [mains[d] if mains else 0 for d in some])
            for d, path in zip(some, paths):
                cuts = np.cumsum([len(r) for r in docs[d]])[:-1]
                out[d] = np.split(path, cuts)
            lo += len(some)
        return out

    def _viterbi(self, docs: list[list[str]], mains: list[int]) -> list[np.ndarray]:
        """Paths of documents that come longest first, one step for all of them at a time."""
        last, states = len(self.logs) - 1, self.logs.shape[1]
        sizes = np.array([sum(map(len, runs)) for runs in docs])
        n, k = int(sizes[0]), len(docs)
        seen, first = np.full((n, k), last, np.int32), np.zeros((n, k), bool)
        for d, runs in enumerate(docs):
            seen[:sizes[d], d] = [self.at.get(c, last) for r in runs for c in r]
            first[np.cumsum([0, *[len(r) for r in runs[:-1]]]), d] = True
        prior = np.array([0.0, *_PRIOR])
        known = np.tile(prior, (k, 1))
        for d, main in enumerate(mains):
            if main:
                known[d, [0, main]] = _KNOWN
        back, own = np.zeros((n, k, states), np.int8), np.arange(states, dtype=np.int8)
        score = self.logs[seen[0]].copy()
        score[:, 1:] += _SWITCH_GAP + known[:, 1:]
        for i in range(1, n):
            here = int(np.searchsorted(-sizes, -i))  # documents of more than i characters
            now = score[:here]
            best = now.argmax(axis=1)
            gap = first[i, :here, None]
            jump = now[np.arange(here), best][:, None] + np.where(gap, _SWITCH_GAP + known[:here], _SWITCH + prior)
            come = now < jump
            back[i, :here] = np.where(come, best[:, None], own)
            score[:here] = np.where(come, jump, now) + self.logs[seen[i, :here]]
        path = np.zeros((n, k), np.int8)
        path[sizes - 1, np.arange(k)] = score.argmax(axis=1)
        for i in range(n - 1, 0, -1):
            here = int(np.searchsorted(-sizes, -i))
            path[i - 1, :here] = back[i, np.arange(here), path[i, :here]]
        return [path[:size, d] for d, size in enumerate(sizes)]

    def _better(self, out: str | None, span: str) -> bool:
        return out is not None and out != span and (out.isascii() or self.clean_score(out) > self.clean_score(span) + 0.2)

    def _piece(self, run: str, lo: int, hi: int, state: int) -> list[tuple[int, int, str]]:
        """Valid inverses around run[lo:hi]: the nearest span whose ends move by up to three,
        else those of its parts between full-width marks."""
        pair = PAIRS[state - 1]
        spans = {(max(0, lo + d), min(len(run), hi + e)) for d in range(-3, 4) for e in range(-3, 4)}
        for a, b in sorted(spans, key=lambda s: (abs(s[0] - lo) + abs(s[1] - hi), s[0] - s[1])):
            if a < b and self._better(out := invert(run[a:b], *pair), run[a:b]):
                return [(a, b, out)]
        parts = [(m.start() + lo, m.end() + lo) for m in _PART.finditer(run[lo:hi])]
        found = [(a, b, invert(run[a:b], *pair)) for a, b in parts if b - a < hi - lo]
        return [(a, b, out) for a, b, out in found if self._better(out, run[a:b])]

    def _run(self, run: str, path: np.ndarray) -> list[tuple[int, int, str]]:
        """(start, end, original) of the labelled spans of one run that have an original."""
        found, done = [], 0
        edges = np.r_[0, np.nonzero(path[1:] != path[:-1])[0] + 1, len(path)]
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            state = int(path[lo])
            if not state or hi <= done:
                continue
            if hi - lo == len(run) > 1:
                # a run that is one span of four and more characters and decodes to known ones needs
                # no better score: what was garbled twice reads no better after one step
                out = invert(run, *PAIRS[state - 1])
                known = out is not None and len(run) > 3 and PAIRS[state - 1][1] in _TABLES and all(c in self.at for c in out if c > "\x7f")
                if known or self._better(out, run):
                    return [(0, len(run), out)]
            for a, b, out in self._piece(run, max(lo, done), hi, state):
                if a >= done:
                    found.append((a, b, out))
                    done = b
        return found

    def _once(self, texts: list[str]) -> list[tuple[str, bool, bool]]:
        """(text, changed, lost) of every text after one labelling."""
        # a run of which no character is likelier in another state is clean: a path through it there
        # has no inverse that reads better
        found = [[m for m in _RUN.finditer(t) if self.screen.search(m.group())] for t in texts]
        runs = [[m.group() for m in f] for f in found]
        some = [d for d, f in enumerate(found) if f]
        labels = dict(zip(some, self.label([runs[d] for d in some])))
        mains = {}
        for d in some:
            states = np.concatenate(labels[d])
            if states.any():
                mains[d] = int(np.bincount(states[states > 0]).argmax())
        # labelled again, now that the document's own wrong decoding is known
        labels.update(zip(mains, self.label([runs[d] for d in mains], list(mains.values()))))
        return [self._inverted(t, found[d], labels[d]) if d in mains else (t, False, False) for d, t in enumerate(texts)]

    def _inverted(self, text: str, found: list, labels: list[np.ndarray]) -> tuple[str, bool, bool]:
        """(text, changed, lost) after the inverse transforms of the labelled spans."""
        spans = []  # start, end, what it was, None where characters are lost
        for m, path in zip(found, labels):
            run = m.group()
            if LOST in run and path[[i for i, c in enumerate(run) if c == LOST]].any():
                spans.append((m.start(), m.end(), None))
                continue
            for a, b, out in self._run(run, path):
                spans.append((m.start() + a, m.start() + b, out))
        # where all garbled spans stand in quotes, they are examples
        if all(self._quoted(text, start, end) for start, end, _ in spans):
            return text, False, False
        pieces, last = [], 0
        for start, end, out in spans:
            if out is not None:
                pieces += [text[last:start], out]
                last = end
        return "".join(pieces) + text[last:], bool(pieces), any(out is None for _, _, out in spans)

    @staticmethod
    def _quoted(text: str, start: int, end: int) -> bool:
        """Whether text[start:end] is all that stands between two quotation marks."""
        return start > 0 and end < len(text) and text[start - 1] in OPENING and text[end] in CLOSING

    def restore_all(self, texts: list[str]) -> list[str | None]:
        """The original texts; "" if characters are lost for good; None for a sound text."""
        out: list[str | None] = [None] * len(texts)
        open_ = list(range(len(texts)))
        now = list(texts)
        for _ in range(4):
            again = []
            for d, (text, changed, lost) in zip(open_, self._once([now[d] for d in open_])):
                if lost:
                    out[d] = ""
                elif changed:
                    now[d] = out[d] = text
                    if self.suspect(text):
                        again.append(d)
            open_ = again
            if not open_:
                break
        return out

    def restore(self, text: str) -> str | None:
        return self.restore_all([text])[0]


def without(seen: dict[int, Counter], less: dict[int, Counter]) -> dict[int, Counter]:
    return {i: counts - less[i] for i, counts in seen.items()}


def counted(docs: DataFrame, model: Model | None = None) -> tuple[dict[int, Counter], int]:
    """(emissions, number) of all texts of ``docs``, or of those that ``model`` labels."""
    schema = pa.schema([("state", pa.int32()), ("code", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            texts = texts if model is None else model.labelled(texts)
            # the number of texts goes along as a state of its own
            rows = [(-1, 0, len(texts))] + [(i, ord(c), n) for i, counts in emissions(texts).items() for c, n in counts.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    # as many rows as there are characters in use, for each state
    rows = docs.select("text").mapInArrow(run, "state int, code int, n long").groupBy("state", "code").agg(F.sum("n").alias("n")).collect()
    seen: dict[int, Counter] = {i: Counter() for i in (0, *_BOUND)}
    for state, code, n in rows:
        if state >= 0:
            seen[state][chr(code)] = n
    return seen, sum(r.n for r in rows if r.state < 0)


def fitted(docs: DataFrame) -> Model:
    """The model of all texts of ``docs``, its second estimate without those that the first one labels."""
    seen, total = counted(docs)
    first = Model.of(seen)
    bad, n_bad = counted(docs, first)
    return Model.of(without(seen, bad)) if 0 < n_bad < total else first


def restored(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, restored_text): garbled documents; the text is null where it is lost."""
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).filter(F.length("text") > 0)
    # pure ASCII texts are sound, have no emissions and stay in the JVM
    odd = slim.filter(F.octet_length("text") > F.length("text"))
    model = fitted(odd)
    schema = pa.schema([("doc_id", pa.int64()), ("restored_text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odd = [(doc, body) for doc, body in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()) if model.suspect(body)]
            found = [(doc, out or None) for (doc, _), out in zip(odd, model.restore_all([t for _, t in odd])) if out is not None]
            ids, texts = [d for d, _ in found], [t for _, t in found]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], schema=schema)

    return odd.mapInArrow(run, "doc_id long, restored_text string")


def garbled_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, restored_md5): MD5 of the restored UTF-8 text, empty where it is lost."""
    return restored(docs, key, text).select(
        "doc_id", F.coalesce(F.md5(F.col("restored_text").cast("binary")), F.lit("")).alias("restored_md5")
    ).distinct()


def md5_of(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest() if text else ""
