"""Whether a sentence declines: naive Bayes on word n-grams, learned from a few seed sentences and all
answers.

Nobody labelled the answers, so the classifier labels them itself.  Seeds stand for sentences
that decline, all sentences of answers for those that do not; sentences that the model then puts
clearly on the side of the seeds change sides, and it is fitted again.  So it learns the wording of
the log, and words of other sentences, however polite, speak against a refusal.  Features are hashed
into a fixed table, so the size of the log does not change that of the model.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.endings import is_empty
from tidemark.session import materialise

ROUNDS, CLEAR, LEAST = 4, 3.0, 0.0
#: Sentences in which a word has to stand to count as itself, for 2,000 answers and in proportion for more;
#: names and other rare words are one.
COMMON = 5
#: Bits of the number of a feature; parts of one by which weights of sentences are counted.
BITS, PARTS = 22, 1 << 20
_MASK, _FACTOR = (1 << 64) - 1, 0x9E3779B97F4A7C15
#: What stands for no word: the ends of a sentence, rare words and numbers.
_NO_WORDS = frozenset("^$X0")
#: Words of a sentence from which on its n-grams decide.
SHORT = 3
# Sentences that decline or apologise, by language.
SEEDS = {
    "en": [
        "Sorry.", "I am sorry.", "My apologies.", "Unfortunately.", "I'm sorry, but I can't help you with this.", "I cannot help with that.",
        "I can't assist with this request.", "I am not able to help with this.", "I am unable to answer that question.", "I cannot answer this question.",
        "I can not answer questions of this kind.", "I won't answer that.", "I will not do this.", "This is not something I will do.",
        "I will not be able to help here.", "I must decline this request.", "I have to refuse.", "I refuse to discuss this.", "I decline to comment.",
        "No comment, sorry.", "I do not want to talk about this.", "As an assistant I am not allowed to share this.", "I am not permitted to discuss this topic.",
        "My rules do not let me talk about this.", "My guidelines do not allow me to answer this.", "A policy prevents me from answering.",
        "This topic is off limits.", "That falls outside what I may discuss.", "This is outside of what I can talk about.", "Please ask someone else.",
        "I would suggest asking someone else.",
    ],
    "de": [
        "Entschuldigung.", "Leider.", "Tut mir leid.", "Es tut mir leid, aber ich kann dabei nicht helfen.", "Leider kann ich nicht helfen.",
        "Dabei kann ich leider nicht helfen.", "Das kann ich nicht beantworten.", "Das werde ich nicht tun.", "Diese Frage werde ich nicht beantworten.",
        "Ich muss das ablehnen.", "Leider muss ich diese Anfrage ablehnen.", "Ich darf dazu nichts sagen.", "Dazu darf ich keine Auskunft geben.",
        "Darüber darf ich nicht sprechen.", "Meine Regeln erlauben das nicht.",
    ],
    "fr": [
        "Désolé.", "Malheureusement.", "Je suis désolé, mais je ne peux pas vous aider.", "Désolé, je ne peux pas répondre.", "Je ne peux pas répondre à cette question.",
        "Je ne peux pas traiter cette demande.", "Je dois refuser.", "Malheureusement, je dois refuser cette demande.", "Je refuse de répondre.",
        "Je ne suis pas autorisé à répondre.", "Je ne suis pas autorisé à parler de cela.", "Cela ne relève pas de ce que je peux faire.", "Ce sujet ne relève pas de ce que je peux aborder.",
        "Mes règles ne le permettent pas.",
    ],
    "es": [
        "Lo siento.", "Lamentablemente.", "Lo siento, pero no puedo ayudar con esto.", "No puedo responder a esta pregunta.", "No puedo ayudar con esta petición.",
        "Debo rechazar esto.", "Lamentablemente debo rechazar esta solicitud.", "Me niego a responder.", "No estoy autorizado a responder.", "No estoy autorizado a hablar de esto.",
        "Eso queda fuera de lo que puedo hacer.", "Este tema queda fuera de lo que puedo comentar.", "Mis reglas no lo permiten.",
    ],
    "zh": [
        "抱歉。", "对不起。", "很遗憾。", "抱歉，我不能帮助你。", "对不起，我无法回答这个问题。", "我无法回答关于这个的问题。", "这个请求我不能处理。", "我不能处理这个问题。",
        "我必须拒绝。", "按照规定，我必须拒绝回答。", "我拒绝这个请求。", "我没有权限回答。", "很遗憾，我没有权限讨论这个话题。", "我不能讨论这个话题。", "无可奉告。",
    ],
}
_SENTENCE = re.compile(r"[^.!?。！？\n]+[.!?。！？]*")
_BETWEEN = re.compile(r"[.!?。！？\n]+")
_WORD = re.compile(r"[一-鿿]|[^\W\d_一-鿿]++(?:'[^\W\d_]++)*+|\d++")
#: The same for lower-case texts of ASCII alone.
_ASCII = re.compile(r"[a-z]++(?:'[a-z]++)*+|[0-9]++")
_SAID = re.compile(r"[^\W_]")


def sentences(text: str) -> Iterator[str]:
    """Sentences of ``text`` that hold a letter or digit."""
    return (s for m in _SENTENCE.finditer(text) if _SAID.search(s := m.group().strip()))


def _words(sentence: str) -> list[str]:
    if sentence.isascii():
        return _ASCII.findall(sentence.lower())
    # single words are lowered, as the form of some letters depends on their neighbours
    return [w.lower() for w in _WORD.findall(sentence.replace("’", "'"))]


def _split(answers: list[str | None]) -> list[list[str]]:
    """Words of all sentences that have any."""
    return [words for t in answers if not is_empty(t) for s in _BETWEEN.split(t) if (words := _words(s))]


def _seen(split: list[list[str]]) -> Counter:
    """In how many sentences each word stands."""
    seen: Counter = Counter()
    for words in split:
        seen.update(set(words))
    return seen


def common(n_answers: int) -> int:
    return max(COMMON, n_answers * COMMON // 2_000)


#: (n_yes, n_no, sentences that changed sides, features, their sums on both sides), in PARTS
Sides = tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray]


def _sides(many: np.ndarray, sizes: np.ndarray, owner: np.ndarray, features: np.ndarray, now: np.ndarray | None, before: np.ndarray | None) -> Sides:
    """Sums of the sentences with ``many`` copies, ``sizes`` words and ``features``, put on the sides that ``now`` tells."""
    chosen = [
        (sizes >= SHORT) & (np.bincount(owner, w[features], len(sizes)) >= CLEAR) if w is not None else np.zeros(len(sizes), bool)
        for w in (now, before)
    ]
    # a sentence said often is one wording, and not a hundred reasons
    weight = np.rint((1 + np.log(many)) * PARTS).astype(np.int64)
    kinds, at = np.unique(features, return_inverse=True)
    on = [np.zeros(len(kinds), np.int64) for _ in range(2)]
    for side, some in zip(on, (chosen[0], ~chosen[0])):
        np.add.at(side, at, (weight * some)[owner])
    return int(weight[chosen[0]].sum()), int(weight[~chosen[0]].sum()), int((chosen[0] != chosen[1]).sum()), kinds, *on


class Refusals:
    """Log-odds of n-gram features, fitted on ``answers``; ``refusals_of`` fits them on a table."""

    def __init__(self, answers: list[str]):
        split = _split(answers)
        self._begin([w for w, n in _seen(split).items() if n >= common(len(answers))])
        rows = Counter(tuple(self._masked(words)) for words in split)
        found = [self._features(words) for words in rows]
        sizes = np.array([len(words) for words in rows], np.int64)
        owner = np.repeat(np.arange(len(rows)), [len(f) for f in found])
        features = np.array([f for some in found for f in some], np.int64)
        many = np.array(list(rows.values()), np.int64)
        self._learn(lambda now, before: _sides(many, sizes, owner, features, now, before))

    def _begin(self, frequent: list[str]) -> None:
        seeds = [_words(s) for group in SEEDS.values() for s in group]
        self.known = {*frequent, *(w for words in seeds for w in words)}
        self.short = [words for words in seeds if len(words) < SHORT]
        self.seeds = [self._features(self._masked(words)) for words in seeds]

    def _learn(self, sides: Callable[[np.ndarray | None, np.ndarray | None], Sides]) -> None:
        self.weights = before = None
        for _ in range(ROUNDS):
            found = sides(self.weights, before)
            if self.weights is not None and not found[2]:
                break
            before, self.weights = self.weights, self._fit(*found[:2], *found[3:])

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_cached"}

    def _masked(self, words: list[str]) -> list[str]:
        """Words, numbers as 0, rare ones as X, none twice in a row."""
        out: list[str] = []
        for w in words:
            w = "0" if w[0].isdigit() else w if w in self.known else "X"
            if not (out and out[-1] == w == "X"):
                out.append(w)
        return out

    @staticmethod
    def _features(words) -> set[int]:
        """Numbers of the words, pairs and threes of a masked sentence."""
        codes = [_code(w) for w in ("^", *words, "$")]
        one = {c for w, c in zip(words, codes[1:]) if w not in ("X", "0")}
        two = [(a * _FACTOR + b) & _MASK for a, b in zip(codes, codes[1:])]
        three = {(a * _FACTOR + b + 1) & _MASK for a, b in zip(two, codes[2:])}
        return {f >> 64 - BITS for f in one.union(two, three)}

    @staticmethod
    def _numbers(rows: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(features of all ``rows``, how many each has): those of ``_features``, by array operations."""
        tokens = [w for words in rows for w in ("^", *words, "$")]
        codes = np.fromiter(map(_code, tokens), np.uint64, len(tokens))
        owner = np.repeat(np.arange(len(rows)), [len(words) + 2 for words in rows])
        real = np.array([w not in _NO_WORDS for w in tokens], bool)
        two = codes[:-1] * np.uint64(_FACTOR) + codes[1:]
        three = two[:-1] * np.uint64(_FACTOR) + codes[2:] + np.uint64(1)
        in_two, in_three = owner[:-1] == owner[1:], owner[:-2] == owner[2:]
        found = np.concatenate([codes[real], two[in_two], three[in_three]]) >> np.uint64(64 - BITS)
        owners = np.concatenate([owner[real], owner[:-1][in_two], owner[:-2][in_three]])
        keys = np.sort(owners << BITS | found.astype(np.int64))
        keys = keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys
        return keys & (1 << BITS) - 1, np.bincount(keys >> BITS, minlength=len(rows))

    def _fit(self, n_yes: int, n_no: int, kinds: np.ndarray, yes_of: np.ndarray, no_of: np.ndarray) -> np.ndarray:
        yes, no = np.zeros(1 << BITS), np.zeros(1 << BITS)
        yes[kinds], no[kinds] = yes_of / PARTS, no_of / PARTS
        for features in self.seeds:
            yes[list(features)] += 1
        n_yes, n_no = n_yes / PARTS + len(self.seeds), n_no / PARTS
        # smoothing in proportion to the sides: what neither has seen says nothing.  The other side
        # counts as no smaller than the seeds, so a few answers do not outweigh them
        n_no += n_yes
        share = n_yes / (n_yes + n_no)
        odds = np.log((yes + share) / n_yes) - np.log((no + 1 - share) / n_no)
        return np.where(yes + no > 0, odds, 0.0).astype(np.float32)

    def _odds(self, words) -> float:
        return float(self.weights[list(self._features(words))].sum(dtype=np.float64))

    def declines(self, sentence: str) -> bool:
        words = _words(sentence)
        # too short to tell a refusal from a plain no, unless a seed says the same
        if len(words) < SHORT:
            return words in self.short
        return self._odds(self._masked(words)) > LEAST

    def is_refusal(self, answer: str) -> bool:
        """Whether every sentence declines or apologises: one of substance makes an answer of it."""
        if not hasattr(self, "_cached"):
            self._cached = lru_cache(50_000)(self.declines)
        said = False
        for said in sentences(answer):
            if not self._cached(said):
                return False
        return bool(said)


@lru_cache(200_000)
def _code(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def refusals_of(log: DataFrame, answer: str = "model_response") -> Refusals:
    """The classifier fitted on all answers of ``log``."""
    texts = log.select(F.col(answer).alias("answer")).filter(F.length(F.trim("answer")) > 0)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = _seen(_split(batch["answer"].to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    seen = texts.mapInArrow(words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    model = Refusals.__new__(Refusals)
    model._begin([r.word for r in seen.filter(F.col("n") >= common(texts.count())).collect()])

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = Counter(" ".join(model._masked(words)) for words in _split(batch["answer"].to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.string()), pa.array(list(rows.values()), pa.int64())], names=["sentence", "n"])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [s.split() for s in batch["sentence"].to_pylist()]
            found, sizes = Refusals._numbers(rows)
            lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum(sizes)].astype(np.int32), pa.array(found, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch["n"], pa.array([len(words) for words in rows], pa.int64()), lists], names=["n", "size", "features"])

    rows = texts.mapInArrow(masked, "sentence string, n long").groupBy("sentence").agg(F.sum("n").alias("n"))
    rows = materialise(rows.mapInArrow(numbered, "n long, size long, features array<int>"), "wordings")

    def sides(now: np.ndarray | None, before: np.ndarray | None) -> Sides:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                many, sizes = (batch[c].to_numpy(zero_copy_only=False) for c in ("n", "size"))
                owner = np.repeat(np.arange(len(sizes)), batch["features"].value_lengths().to_numpy(zero_copy_only=False))
                features = batch["features"].flatten().to_numpy(zero_copy_only=False)
                n_yes, n_no, changed, kinds, yes, no = _sides(many, sizes, owner, features, now, before)
                # totals go along as features of their own
                columns = ([*kinds, -1, -2], [*yes, n_yes, changed], [*no, n_no, 0])
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["feature", "yes", "no"])

        sums = rows.mapInArrow(run, "feature long, yes long, no long").groupBy("feature").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).toArrow()
        kinds, yes, no = (sums[c].to_numpy() for c in ("feature", "yes", "no"))
        real = kinds >= 0
        return int(yes[kinds == -1].sum()), int(no[kinds == -1].sum()), int(yes[kinds == -2].sum()), kinds[real], yes[real], no[real]

    model._learn(sides)
    return model
