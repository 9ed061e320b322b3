"""Broken prompt and response pairs, flagged with their kind of defect.

Kinds in the order in which they are tried, so that a pair has at most one: ``empty``,
``copy``, ``refusal``, ``truncated``, ``other_language``.

Languages are compared by a character-trigram naive Bayes, fitted on all labelled documents: question
and answer have a posterior over languages each, and the pair is defective if both are unlikely to
be of one language.  Trigrams are hashed into a fixed table, and a whole Arrow batch is scored by
array operations.  Truncation is the end-of-text n-gram model of ``endings``; copies are found on
the words of both texts; a refusal is an answer of which every sentence declines or apologises by
the classifier of ``refusals``, so one sentence of substance makes it an answer.

Defined cases: a null, blank or stand-in answer is empty whatever the question; a null
question has no language and nothing to copy; texts too short for a language are not
compared; redelivered rows give one result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.endings import is_empty, verdict
from tidemark.llm.refusals import refusals_of
from tidemark.llm.truncation import decided, with_baselines, word_list

BUCKETS = 1 << 16
#: What an unseen trigram counts in up to PER_SMOOTH texts of a language, and in proportion in more; the
#: most probability that question and answer share a language; the least number of trigrams.
SMOOTH, PER_SMOOTH, SAME, LEAST = 0.05, 400, 0.005, 12

# Names of languages in questions that ask for one.
LANGUAGE_NAMES = re.compile(
    r"\b(?:in|into|auf|ins?|en|to|au|al|em) (?:the )?(?:english|chinese|mandarin|german|french|spanish|englisch\w*|chinesisch\w*|deutsch\w*|französisch\w*|spanisch\w*|"
    r"anglais|chinois|allemand|français|espagnol|inglés|chino|alemán|francés|español)\b|[用以译成为](?:中文|英文|英语|德语|德文|法语|法文|西班牙语|西班牙文|汉语)|(?:translate|übersetze|tradui[st]|traduce|翻译)", re.I)

_WORDS = re.compile(r"[一-鿿]|[^\W_一-鿿]+")


def is_copy(question: str | None, answer: str, lead_in: int = 8) -> bool:
    """Whether the answer is the question's own words, from its start or after a lead-in of
    at most ``lead_in`` words, once or repeated."""
    asked = [w.lower() for w in _WORDS.findall(question or "")]
    if len(asked) < 3:
        return False
    # a copy begins after the lead-in at the latest, or all words after that are the question's
    first = [m.group().lower() for m in islice(_WORDS.finditer(answer), lead_in + 4)]
    if len(first) > lead_in and asked[0] not in first[:lead_in + 1] and not set(asked).issuperset(first[lead_in:]):
        return False
    said = [w.lower() for w in _WORDS.findall(answer)]
    if len(said) < 3:
        return False
    whole = "\x01" + "\x01".join(asked) + "\x01"
    text = "\x01" + "\x01".join(said) + "\x01"
    count = text.count(whole[:-1])
    if count and len(said) - count * len(asked) <= lead_in:
        return True
    own = set(asked)
    at = len(said)
    while at and said[at - 1] in own:
        at -= 1
    rest = said[at:]
    # the question's words in the question's order, most of them
    if at > lead_in or len(rest) < max(4, 0.6 * len(asked)):
        return False
    pairs = set(zip(asked, asked[1:]))
    follow = sum(p in pairs for p in zip(rest, rest[1:]))
    return follow >= 0.85 * (len(rest) - 1)


class Languages:
    """Naive Bayes over hashed character trigrams."""

    def __init__(self, texts: dict[str, list[str]], buckets: int = BUCKETS):
        names = sorted(texts)
        counts = np.zeros((len(names), buckets), np.int64)
        for row, name in enumerate(names):
            counts[row] = np.bincount(self.grams(texts[name], buckets)[0], minlength=buckets)
        self._fit(names, counts, np.array([len(texts[name]) for name in names]))

    @classmethod
    def of(cls, names: list[str], counts: np.ndarray, n_texts: np.ndarray) -> Languages:
        model = cls.__new__(cls)
        model._fit(names, counts, n_texts)
        return model

    def _fit(self, names: list[str], counts: np.ndarray, n_texts: np.ndarray) -> None:
        """From the trigrams of ``n_texts`` texts of each language.  Smoothing grows with the texts, so that
        unseen trigrams speak for no language, however many texts another has."""
        self.names, self.buckets = names, counts.shape[1]
        self.table = np.zeros(counts.shape, np.float32)
        for row, n in enumerate(n_texts.tolist()):
            seen = counts[row] + SMOOTH * max(1.0, n / PER_SMOOTH)
            self.table[row] = np.log(seen / seen.sum())

    @staticmethod
    def grams(texts: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
        """(trigram buckets of all texts, number of trigrams before each text)."""
        joined = "\n\n\n".join(re.sub(r"[\d_]+", "0", t.lower().replace("\n", " ")) for t in texts)
        code = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        if len(code) < 3:
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        keys = (code[:-2] * 1_000_003 + code[1:-1] * 8_191 + code[2:] * 127) % buckets
        breaks = code == 10
        # no trigram may touch a separator, digit or full stop run
        odd = breaks | (code < 65) & (code != 32)
        clean = ~(odd[:-2] | odd[1:-1] | odd[2:])
        owner = np.cumsum(breaks[:-2]) // 3
        keys, owner = keys[clean], owner[clean]
        return keys, np.searchsorted(owner, np.arange(len(texts) + 1))

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log likelihood per text and language, number of trigrams per text)."""
        keys, at = self.grams(texts, self.buckets)
        sums = np.zeros((len(self.names), len(keys) + 1))
        for row in range(len(self.names)):
            np.cumsum(self.table[row][keys], out=sums[row, 1:])
        return (sums[:, at[1:]] - sums[:, at[:-1]]).T, np.diff(at)


def language_model(labelled: DataFrame, label: str = "lang", text: str = "text") -> Languages:
    rows = labelled.select(F.lower(F.trim(F.col(label))).alias("label"), F.col(text).alias("body")).filter(
        F.col("label").isNotNull() & (F.length("body") > 40)
    )
    many = {r.label: r["count"] for r in rows.groupBy("label").count().filter("count >= 3").collect()}
    if not many:
        return Languages({"und": ["und"]})
    names = sorted(many)
    at = {name: row for row, name in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: dict[int, list[str]] = {}
            for name, body in zip(batch["label"].to_pylist(), batch["body"].to_pylist()):
                if name in at:
                    texts.setdefault(at[name], []).append(body)
            for row, own in texts.items():
                seen = np.bincount(Languages.grams(own)[0], minlength=BUCKETS)
                kinds = np.flatnonzero(seen)
                yield pa.RecordBatch.from_arrays([pa.array(row * BUCKETS + kinds), pa.array(seen[kinds])], names=["cell", "n"])

    sums = rows.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(names) * BUCKETS, np.int64)
    counts[sums["cell"].to_numpy()] = sums["n"].to_numpy()
    return Languages.of(names, counts.reshape(len(names), BUCKETS), np.array([many[name] for name in names]))


def _posterior(likelihood: np.ndarray) -> np.ndarray:
    odds = np.exp(likelihood - likelihood.max(axis=1, keepdims=True))
    return odds / odds.sum(axis=1, keepdims=True)


def differ(q: np.ndarray, r: np.ndarray, nq: np.ndarray, nr: np.ndarray) -> np.ndarray:
    """Whether question and answer are unlikely to be of one language, from their log likelihoods
    (rows of languages) and numbers of trigrams."""
    together = (_posterior(q) * _posterior(r)).sum(axis=1)
    return (np.minimum(nq, nr) >= LEAST) & (together <= SAME)


def defects(log: DataFrame, labelled: DataFrame) -> DataFrame:
    """(interaction_id, defect) of every defective pair of ``log``; ``labelled`` has texts
    with a language label."""
    words, languages = word_list(log), language_model(labelled)
    refusals = refusals_of(log)
    schema = pa.schema([
        ("interaction_id", pa.int64()), ("defect", pa.string()), ("base", pa.float64()), ("broken", pa.bool_()), ("asked", pa.list_(pa.int64()))
    ])

    def kind(question: str | None, answer: str | None) -> str | None:
        if is_empty(answer):
            return "empty"
        if is_copy(question, answer):
            return "copy"
        if refusals.is_refusal(answer):
            return "refusal"
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, asked, said = (batch[c].to_pylist() for c in ("id", "user_query", "model_response"))
            bases = batch["base_model_response"].to_pylist()
            kinds = [kind(q, r) for q, r in zip(asked, said)]
            ends = [verdict(r, words, b) if k is None else False for k, r, b in zip(kinds, said, bases)]
            open_ = [i for i, k in enumerate(kinds) if k is None and ends[i] is not True and asked[i]]
            if open_:
                sq, nq = languages.scores([asked[i] for i in open_])
                sr, nr = languages.scores([said[i] for i in open_])
                for j in np.nonzero(differ(sq, sr, nq, nr))[0]:
                    if not LANGUAGE_NAMES.search(asked[open_[j]]):
                        kinds[open_[j]] = "other_language"
            # a kind of an answer whose end the counts decide holds if it is finished
            found = [
                (i, k, b, e if isinstance(e, bool) else None, None if isinstance(e, bool) else e)
                for i, k, b, e in zip(ids, kinds, bases, ends) if k or e
            ]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found) if found else [[]] * 5, schema)], schema=schema)

    rows = with_baselines(log, ["user_query", "model_response"], ["model_response"])
    rows = rows.mapInArrow(run, "interaction_id long, defect string, base double, broken boolean, asked array<long>")
    defect = F.when(F.col("broken"), "truncated").otherwise(F.col("defect"))
    return decided(rows, log, words).select("interaction_id", defect.alias("defect")).filter("defect IS NOT NULL").distinct()
