"""Mixing sources to target weights by pivotal dependent rounding.

A source with share w of a planned total of M tokens and T tokens of its own uses each of
its documents ``w * M / T`` times, at most ``max_repeats`` times: the whole part as copies,
the fraction as the probability of one more.  Fractions are rounded in pairs: the pair
moves token mass from one document to the other, the direction drawn so that each keeps its
probability on average, until one of them is 0 or 1.  Token mass per source is preserved at
every step, so a source misses its plan by at most one document.

Documents are spread by hash, so a source with a third of all rows is worked on by every
task.  A task leaves one fractional document per source; these residuals are paired in a
tree of fan-in ``FAN`` until one is left, which is drawn.  Draws are hashes of the seed and
the document ids, so a task that runs again decides the same.

Defined cases: documents without a source, of a source without a target, or with null or
empty text are never used; a target without documents, or whose cap is too low, is reported
with the share it reached; equal documents are separate ones; empty tables report zeros.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tidemark.session import materialise

TOKENIZERS = "/opt/tokenizers"
SEED, FAN = 29, 16
#: Share of the wanted tokens by which the drawn ones may differ where a target counts as met.
TOLERANCE = 0.02
#: Documents of one task of the first rounding.
TASK_DOCS = 20_000
_EPS = 1e-12
_ENCODERS: dict = {}


def _encoder(key: tuple[str, str], pattern: str, ranks: dict[bytes, int]):
    """The byte-level BPE of these ranks, made once per worker."""
    if key not in _ENCODERS:
        import tiktoken

        _ENCODERS[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def token_count(text: Column, folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken") -> Column:
    """Number of tokens of ``text``, 0 for null.  The vocabulary is read here and sent to the tasks,
    so that no other machine needs the folder; it has some ten thousand entries."""
    spec = importlib.util.spec_from_file_location("_tokenizer_files", os.path.join(folder, "__init__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    with open(os.path.join(folder, name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
    sent, pattern = SparkSession.active().sparkContext.broadcast(ranks), module.PATTERN

    @pandas_udf("long")
    def count(values: pd.Series) -> pd.Series:
        encode = _encoder((folder, name), pattern, sent.value).encode_ordinary
        return values.map(lambda t: len(encode(t)) if t else 0)

    return count(text)


def source_name(source: Column) -> Column:
    return F.lower(F.regexp_replace(source, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def draw(seed: int, a: int, b: int) -> float:
    """Uniform in [0, 1), the same for the same documents."""
    return xxhash.xxh64_intdigest(f"{a}:{b}", seed) / 2**64


def pair_up(first: tuple[int, int, float], second: tuple[int, int, float], seed: int) -> tuple[tuple, tuple]:
    """One pivotal step on two (document, tokens, probability): returns (settled, other),
    where ``settled`` has probability 0 or 1; token mass and mean probabilities stay."""
    (i, si, pi), (j, sj, pj) = first, second
    up, down = min(si * (1 - pi), sj * pj), min(si * pi, sj * (1 - pj))
    if draw(seed, i, j) * (up + down) < down:
        pi, pj = pi + up / si, pj - up / sj
    else:
        pi, pj = pi - down / si, pj + down / sj
    near = lambda p: min(p, 1 - p)
    if near(pi) <= near(pj):
        return (i, si, float(round(pi))), (j, sj, pj)
    return (j, sj, float(round(pj))), (i, si, pi)


_ROUNDED = "doc_id long, source string, tokens long, whole long, extra double, block long"


def _round(seed: int):
    """Pandas stream over rows sorted by source: settled rows get extra 0 or 1, one row per
    source and task keeps a fraction."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: dict[str, tuple] = {}
        for frame in frames:
            out = []
            for doc, source, tokens, whole, extra, block in frame.itertuples(index=False, name=None):
                if extra <= _EPS or extra >= 1 - _EPS:
                    out.append((doc, source, tokens, whole, float(round(extra)), block))
                    continue
                held = open_.pop(source, None)
                if held is None:
                    open_[source] = (doc, tokens, extra, whole, block)
                    continue
                wholes = {held[0]: (held[3], held[4]), doc: (whole, block)}
                done, left = pair_up(held[:3], (doc, tokens, extra), seed)
                out.append((done[0], source, done[1], wholes[done[0]][0], done[2], wholes[done[0]][1]))
                if _EPS < left[2] < 1 - _EPS:
                    open_[source] = (*left, *wholes[left[0]])
                else:
                    out.append((left[0], source, left[1], wholes[left[0]][0], float(round(left[2])), wholes[left[0]][1]))
            yield pd.DataFrame(out, columns=["doc_id", "source", "tokens", "whole", "extra", "block"])
        rest = [(d, s, t, w, p, b) for s, (d, t, p, w, b) in open_.items()]
        yield pd.DataFrame(rest, columns=["doc_id", "source", "tokens", "whole", "extra", "block"])

    return run


def _settle(planned: DataFrame, n_docs: int, seed: int) -> DataFrame:
    """All documents with extra 0 or 1."""
    blocks = max(1, -(-n_docs // TASK_DOCS))
    spread = planned.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(blocks)).cast("long"))
    spread = spread.repartition(blocks, "block").sortWithinPartitions("block", "source", "doc_id")
    level = materialise(spread.mapInPandas(_round(seed), _ROUNDED), "rounding")
    fraction = (F.col("extra") > 0) & (F.col("extra") < 1)
    settled = level.filter(~fraction)
    rest, width = level.filter(fraction), blocks
    columns = ["doc_id", "source", "tokens", "whole", "extra", "block"]
    while True:
        # residuals: at most one per task and source, so each group of the tree has FAN rows
        width = -(-width // FAN)
        group = rest.withColumn("block", F.floor(F.col("block") / FAN).cast("long"))
        joined = group.groupBy("source", "block").applyInPandas(
            lambda frame: pd.concat([f for f in _round(seed)(iter([frame.sort_values("doc_id")[columns]])) if len(f)]), _ROUNDED
        )
        joined = materialise(joined, "residuals")
        settled = settled.unionByName(joined.filter(~fraction))
        rest = joined.filter(fraction)
        if width <= 1:
            break
    # the last one of a source is drawn with its own probability
    lot = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(1_000_003)) / 1_000_003.0
    last = rest.withColumn("extra", F.when(lot < F.col("extra"), 1.0).otherwise(0.0))
    return settled.unionByName(last)


def _plan(docs: DataFrame, targets: DataFrame, total: int | None, folder: str) -> tuple[DataFrame, DataFrame, int, int]:
    """(documents with tokens, one row per target with its plan, number of documents, planned tokens)."""
    goals = targets.select(
        source_name(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"),
        F.col("max_repeats").cast("int").alias("max_repeats"),
    ).filter(F.col("source").isNotNull()).dropDuplicates(["source"])
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source_name(F.col("source")).alias("source"), "text")
    # repartitioned before Python: a text table is few, large row groups
    sized = slim.filter(F.col("source").isNotNull() & (F.length("text") > 0)).join(
        goals.select("source"), "source", "left_semi"
    ).withColumn("tokens", token_count(F.col("text"), folder)).select("doc_id", "source", "tokens").filter("tokens > 0")
    sized = materialise(sized, "sizes")
    sums = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("tokens").alias("source_tokens"))
    plan = goals.join(sums, "source", "left").fillna(0, ["n_docs", "source_tokens"])
    row = plan.agg(F.sum("source_tokens").alias("t"), F.sum("n_docs").alias("n")).first()
    size = total if total is not None else int(row.t or 0)
    want = F.col("target_share") * size
    copies = F.when(F.col("source_tokens") > 0, F.least(want / F.col("source_tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    plan = plan.withColumns({"wanted_tokens": F.round(want).cast("long"), "copies": copies})
    return sized, materialise(plan, "plan"), int(row.n or 0), size


def draw_mixture(
    docs: DataFrame, targets: DataFrame, total: int | None = None, seed: int = SEED, folder: str = TOKENIZERS
) -> tuple[DataFrame, DataFrame]:
    """(draws, shares).  draws: (doc_id, source, tokens, copies) of all documents of the
    target sources, 0 copies included.  shares: per target what was wanted and reached, as a share of
    all tokens drawn and of the planned total; ``target_met`` compares the tokens drawn with those
    wanted.

    ``total`` is the planned size in tokens, by default that of all documents of the target
    sources."""
    sized, plan, n, planned_total = _plan(docs, targets, total, folder)
    # one row per target source: a table of at most 10,000 rows is sent to all tasks
    rates = plan.select("source", "copies")
    rates = F.broadcast(rates) if plan.limit(10_001).count() <= 10_000 else rates
    planned = sized.join(rates, "source").select(
        "doc_id", "source", "tokens", F.floor("copies").cast("long").alias("whole"),
        (F.col("copies") - F.floor("copies")).alias("extra"),
    )
    draws = materialise(_settle(planned, n, seed).select(
        "doc_id", "source", "tokens", (F.col("whole") + F.col("extra").cast("long")).alias("copies")
    ), "draws")
    got = draws.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("drawn_tokens"), F.sum("copies").alias("drawn_copies"),
        F.max("copies").alias("most_copies"),
    )
    all_ = draws.agg(F.sum(F.col("tokens") * F.col("copies")).alias("all_tokens"))
    shares = plan.join(got, "source", "left").fillna(0, ["drawn_tokens", "drawn_copies", "most_copies"]).join(F.broadcast(all_))
    reached = F.when(F.col("all_tokens") > 0, F.col("drawn_tokens") / F.col("all_tokens")).otherwise(0.0)
    shares = shares.select(
        "source", "target_share", "max_repeats", "n_docs", "source_tokens", "wanted_tokens", "drawn_tokens",
        "drawn_copies", "most_copies", F.round(reached, 6).alias("reached_share"),
        F.when(F.lit(planned_total) > 0, F.round(F.col("drawn_tokens") / planned_total, 6)).otherwise(0.0).alias("share_of_plan"),
        (F.abs(F.col("drawn_tokens") - F.col("wanted_tokens")) <= TOLERANCE * F.col("wanted_tokens")).alias("target_met"),
    )
    return draws, shares
