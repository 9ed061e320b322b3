"""Near-duplicate records by rare-first prefix filtering.

Two records are similar when shared / all distinct tokens >= threshold.  Plan:

1. Records with equal token sets become one class (a group by a 128-bit set hash), so a
   text copied into a third of all rows is one row from here on.
2. Frequencies over all classes give one global order, rarest token first.  The tokens of more
   than a few classes are sent to all tasks; how many classes that is rises until at most
   ``MOST_LISTED`` tokens are left, and the tokens below it come first, ordered by their hash.
3. Prefix n-grams.  A pair of size s at the least shares ``ceil(t*s)`` tokens, so the first
   ``s - ceil(t*s) + 2`` tokens of both hold its two first shared tokens.  A first shared
   token of low frequency is a signature by itself; a frequent one is joined with every later
   prefix token to a 2-gram, which keeps buckets small where names and numbers repeat over
   millions of rows.  Both records see the same frequency of the same token, so they choose
   alike.  Records so small that one shared token is enough send frequent tokens alone, too.
   Records of more than ``LONG`` tokens use single tokens (prefix one shorter), since the
   2-grams of a record grow with the square of its size; a record near the limit sends both
   kinds and the pair's smaller size decides, so no pair is lost.
4. Rows of one signature are joined under the length filter, the positional filter (what can
   still be shared from the signature on, exact for the first shared tokens of a pair) and the
   suffix filter: tokens are counted in eight fixed cells, and whether their number is odd in
   sixty-four; the sum of differences bounds the number of tokens not shared, which is the
   divide-and-bound of a suffix filter with its pivots fixed beforehand.
5. Surviving pairs are made distinct and verified once, on the token arrays.

Nothing of the records is collected and no bucket is capped.  A bucket that is hot is split by
the skew-join of adaptive execution.

Defined cases: null, empty or token-less contents are in no pair and form classes of their
own; repeated ids keep one row; identical token sets have similarity 1; any number of
extra columns is ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialise

#: Sets of more tokens are signed by single tokens only.
LONG = 400
#: A first shared token up to this frequency is a signature by itself.
RARE = 100
#: Tokens of more classes than this have their frequency sent to the tasks, and the most of them.
LISTED, MOST_LISTED = 8, 2_000_000
#: Copies up to which the rows without them are not written a second time.
MOST_COPIES = 1_000_000

_HAN = "[一-鿿]"


def tokens(text: Column) -> Column:
    """Distinct token hashes, sorted: runs of letters and digits, bigrams of CJK runs (a run of
    one stands for itself)."""
    low = F.lower(text)
    plain = F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}&&[^一-鿿]]+)"), F.lit(1))
    # a look-ahead takes both characters and moves on by one
    pairs = F.regexp_extract_all(low, F.lit(f"(?=({_HAN}{{2}}|(?<!{_HAN}){_HAN}(?!{_HAN}))){_HAN}"), F.lit(1))
    return F.sort_array(F.array_distinct(F.transform(F.concat(plain, pairs), lambda t: F.xxhash64(t))))


def classes(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(members, sets): members maps id to class (least id of equal token sets), sets holds
    (cid, toks, n) of every class with tokens."""
    rows = docs.select(
        F.col(key).alias("id"), F.monotonically_increasing_id().alias("row"),
        tokens(F.coalesce(F.col(text), F.lit(""))).alias("toks"),
    )
    rows = materialise(rows, "token-sets").filter(F.size("toks") > 0)
    marks = rows.select("id", "row", F.xxhash64("toks").alias("h1"), F.xxhash64(F.lit(1), "toks").alias("h2"), F.size("toks").alias("n"))
    group = ["h1", "h2", "n"]
    heads = materialise(marks.groupBy(*group).agg(F.min(F.struct("id", "row")).alias("m")).select(
        *group, F.col("m.id").alias("cid"), F.col("m.row").alias("row")
    ), "heads")
    owned = materialise(marks.join(heads.select(*group, "cid", F.col("row").alias("first")), group).select(
        "id", "cid", "n", "row", (F.col("row") != F.col("first")).alias("copy")
    ), "members")
    # rows that only repeat a class are left out; they are few, or the sets are written once
    copies = materialise(owned.filter("copy").select("row"), "copies")
    sets = rows.select(F.col("id").alias("cid"), F.size("toks").alias("n"), "toks", "row").join(copies, "row", "left_anti").drop("row")
    return owned.select("id", "cid", "n").distinct(), materialise(sets, "sets") if copies.count() > MOST_COPIES else sets


def frequencies(sets: DataFrame, listed: int = LISTED, most: int = MOST_LISTED) -> tuple[np.ndarray, np.ndarray, int]:
    """(tokens, their numbers of classes, limit): tokens of more than ``limit`` classes, by
    token; the limit doubles from ``listed`` until at most ``most`` tokens exceed it."""
    df = sets.select(F.explode("toks").alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") > listed)
    df = materialise(df, "frequencies")
    limits = [listed << i for i in range(40)]
    over = df.agg(*[F.count_if(F.col("df") > limit).alias(f"n{i}") for i, limit in enumerate(limits)]).first()
    limit = next(limit for i, limit in enumerate(limits) if over[i] <= most)
    table = df.filter(F.col("df") > limit).toArrow()
    tok, count = table["tok"].to_numpy(), table["df"].to_numpy()
    order = np.argsort(tok)
    return tok[order], count[order], limit


def _up(t: float, of: np.ndarray) -> np.ndarray:
    """ceil(t * of) in integers, for a threshold with at most four decimals."""
    return -((-of * round(t * 10_000)) // 10_000)


def _mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """One hash of two, in that order."""
    z = (x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (y.view(np.uint64) + np.uint64(0xD1B54A32D192ED03))
    z = (z ^ (z >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return (z ^ (z >> np.uint64(29))).view(np.int64)


def _signer(listed: np.ndarray, counts: np.ndarray, rare: int, t: float, long: int):
    """Arrow function: (cid, toks) -> one row per signature."""
    schema = pa.schema([("sig", pa.int64()), ("cid", pa.int64()), ("size", pa.int64()), ("cells", pa.int64()), ("odd", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch["toks"]
            bounds = lists.offsets.to_numpy()
            tok = lists.values.to_numpy(zero_copy_only=False)[bounds[0]:bounds[-1]]
            start = (bounds - bounds[0])[:-1].astype(np.int64)
            n = np.diff(bounds).astype(np.int64)
            doc = np.repeat(np.arange(len(n)), n)
            # cells of the suffix filter: one byte each, saturated
            cell = np.bincount(doc * 8 + ((tok >> 7) & 7), minlength=8 * len(n)).reshape(-1, 8)
            cells = (np.minimum(cell, 255).astype(np.uint64) << (8 * np.arange(8, dtype=np.uint64))).sum(axis=1, dtype=np.uint64).view(np.int64)
            odd = np.bitwise_xor.reduceat(np.uint64(1) << ((tok >> 13) & 63).astype(np.uint64), start).view(np.int64)
            if len(listed):
                place = np.minimum(np.searchsorted(listed, tok), len(listed) - 1)
                df = np.where(listed[place] == tok, counts[place], 0)
            else:
                df = np.zeros(len(tok), np.int64)
            order = np.lexsort((tok, df, doc))
            tok, df = tok[order], df[order]
            at = np.arange(len(tok)) - np.repeat(start, n)
            prefix = np.minimum(n - _up(t, n) + 2, n)
            near, far = (n <= int(long / t))[doc], (n > long)[doc]
            # the first of one shared token stands one place before the second of two
            single = at < (n - _up(t, n) + 1)[doc]
            common = df > rare
            tiny = (n <= int(1 / t + 1e-9))[doc]
            out = []

            def emit(which: np.ndarray, sig: np.ndarray, kind: int, last: np.ndarray, many: int) -> None:
                d = doc[which]
                out.append((sig ^ kind, d, n[d] << 32 | (many + n[d] - last - 1) << 1 | kind))

            alone = np.nonzero(single & near & (~common | tiny))[0]
            emit(alone, _mixed(tok[alone], np.zeros(len(alone), np.int64)), 0, at[alone], 1)
            alone = np.nonzero(single & far)[0]
            emit(alone, _mixed(tok[alone], np.zeros(len(alone), np.int64)), 1, at[alone], 1)
            first = np.nonzero(common & near & (at < (prefix - 1)[doc]))[0]
            many = (prefix - 1)[doc[first]] - at[first]
            a = np.repeat(first, many)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many)
            emit(a, _mixed(tok[a], tok[b]), 0, at[b], 2)
            ids = batch["cid"].to_numpy(zero_copy_only=False)
            for sig, d, size in out:
                for lo in range(0, len(sig), 100_000):
                    s = slice(lo, lo + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (sig[s], ids[d[s]], size[s], cells[d[s]], odd[d[s]])], schema=schema)

    return run, "sig long, cid long, size long, cells long, odd long"


def signatures(sets: DataFrame, t: float, rare: int | None = None) -> DataFrame:
    """(sig, cid, size, cells, odd): one row per prefix n-gram.  ``size`` packs the number of tokens,
    how many can be shared from the signature on, its own included, and the kind in the last bit."""
    listed, counts, limit = frequencies(sets)
    run, kind = _signer(listed, counts, max(RARE if rare is None else rare, limit), t, LONG)
    return sets.select("cid", "toks").mapInArrow(run, kind)


def _cell_gap(a: Column, b: Column) -> Column:
    out = F.lit(0).cast("long")
    for i in range(8):
        byte = lambda c, i=i: F.shiftrightunsigned(c, 8 * i).bitwiseAND(F.lit(255))
        out = out + F.abs(byte(a) - byte(b))
    return out


def similar_classes(sets: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b) with a < b: all pairs of different classes with Jaccard >= threshold, once each."""
    t = threshold
    k = round(t * 10_000)
    sigs = materialise(signatures(sets, t), "signatures")
    x, y = sigs.alias("x"), sigs.alias("y")
    nx, ny = F.shiftright("x.size", 32), F.shiftright("y.size", 32)
    room = lambda c: F.shiftright(F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)), 1)
    kind = lambda c: F.col(c).bitwiseAND(F.lit(1))
    # least number shared: ceil(t / (1 + t) * (nx + ny))
    need = F.floor(((nx + ny) * k + (10_000 + k - 1)) / (10_000 + k))
    smaller = F.least(nx, ny)
    candidates = x.join(
        y,
        (F.col("x.sig") == F.col("y.sig")) & (F.col("x.cid") < F.col("y.cid"))
        & (smaller * 10_000 >= F.greatest(nx, ny) * k)
        & (F.least(room("x.size"), room("y.size")) >= need)
        & (kind("x.size") == kind("y.size")) & ((kind("x.size") == 1) == (smaller > LONG))
        & (F.bit_count(F.col("x.odd").bitwiseXOR(F.col("y.odd"))) <= nx + ny - 2 * need)
        & (_cell_gap(F.col("x.cells"), F.col("y.cells")) <= nx + ny - 2 * need),
    ).select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).distinct()
    candidates = materialise(candidates, "candidates")
    needed = materialise(candidates.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), "needed")
    held = sets.select("cid", "toks").join(needed, "cid", "left_semi")
    left = candidates.join(held.select(F.col("cid").alias("a"), F.col("toks").alias("ta")), "a")
    right = held.select(F.col("cid").alias("b"), F.col("toks").alias("tb"))
    shared = F.size(F.array_intersect("ta", "tb"))
    union = F.size("ta") + F.size("tb") - shared
    return left.join(right, "b").filter(shared * 10_000 >= union * k).select("a", "b")


def similar_pairs(docs: DataFrame, key: str = "id", text: str = "content", threshold: float = 0.8) -> DataFrame:
    """(id_a, id_b) with id_a < id_b of all records with similarity >= threshold."""
    members, sets = classes(docs, key, text)
    links = materialise(similar_classes(sets, threshold), "links")
    m = members.select("id", "cid")
    left = links.join(m.select(F.col("id").alias("p"), F.col("cid").alias("a")), "a")
    across = left.join(m.select(F.col("id").alias("q"), F.col("cid").alias("b")), "b").select(
        F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b")
    )
    first, second = m.alias("f"), m.alias("s")
    inside = first.join(second, (F.col("f.cid") == F.col("s.cid")) & (F.col("f.id") < F.col("s.id"))).select(
        F.col("f.id").alias("id_a"), F.col("s.id").alias("id_b")
    )
    return across.unionByName(inside)


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(cid, root): least class reachable over ``links`` (a, b).  Alternates large-star and
    small-star steps, which halve path lengths, each materialised to the shared folder."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = materialise(edges, "cc")
    for _ in range(rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter(F.col("u") != F.col("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.u", "e.v").filter(F.col("u") != F.col("v")).distinct()
        small = materialise(small, "cc")
        before = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        after = small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        edges = small
        if before == after:
            break
    else:
        raise RuntimeError("components did not settle; raise rounds")
    return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "cid")


def duplicate_groups(docs: DataFrame, key: str = "id", text: str = "content", threshold: float = 0.8) -> DataFrame:
    """(id, group_id, copies, links): one row per record with tokens.  ``group_id`` is the
    least id of its connected group, ``copies`` the number of records with the same tokens,
    ``links`` the number of other records with similarity >= threshold."""
    members, sets = classes(docs, key, text)
    links = materialise(similar_classes(sets, threshold), "links")
    sizes = members.groupBy("cid").agg(F.count(F.lit(1)).alias("copies"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    outside = both.join(sizes.select(F.col("cid").alias("b"), F.col("copies").alias("m")), "b").groupBy(
        F.col("a").alias("cid")
    ).agg(F.sum("m").alias("near"))
    return members.join(sizes, "cid").join(outside, "cid", "left").join(components(links), "cid", "left").select(
        "id", F.coalesce("root", "cid").alias("group_id"), "copies",
        (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("links"),
    )


def groups_of_all(docs: DataFrame, key: str = "id", text: str = "content", threshold: float = 0.8) -> DataFrame:
    """``duplicate_groups`` and one row for every record without tokens, a group of its own."""
    found = duplicate_groups(docs, key, text, threshold)
    # a text has tokens if any character can be part of a run
    has = F.lower(F.coalesce(F.col(text), F.lit(""))).rlike(r"[一-鿿\p{L}\p{N}]")
    alone = docs.groupBy(F.col(key).alias("id")).agg(F.bool_or(has).alias("has")).filter(~F.col("has"))
    return found.unionByName(alone.select(
        "id", F.col("id").alias("group_id"), F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("links")
    ))
