"""Most similar vectors by shifted space-filling curves.

Every unit vector is projected by a seeded random orthonormal map, shifted at random and
put on a grid; the Hilbert index of its cell orders all vectors along one curve.  Several
curves with other maps and shifts are laid.  On each, rows are range-partitioned by key
with cuts taken from a bounded sample (``SAMPLE`` rows; it only balances tasks, every row
is indexed), sorted, and each row meets the ``WINDOW`` rows after it: one small matrix
product per block of rows.  What travels along a curve is a sketch, one byte for each of
``SKETCH`` axes of a further projection; a pair becomes a candidate if its distance there is below
``SLACK`` times that of the floor, which one similar pair in about 10,000 exceeds.  Candidates of
all curves merge, the vectors are joined to the distinct ones, and exact cosines rank them.
Windows end at the cuts between ranges, which some other curve has elsewhere.

Vectors of one direction are one class beforehand, so copies held by a third of all rows, in
any length, are one row on the curves; a class keeps its few smallest ids, which are all that
ties can ask for.  Keys that many different vectors share are spread over several tasks by the
hash of the id.  Vectors are written once and shuffled only to the candidates.

Where vectors lie dense, a window holds only some of the similar ones.  A row is crowded if on
some curve at least ``CROWD`` of the window before or after it is within twice the angle of the
floor; crowded rows are compared exactly (``crowded_pairs``).  Leaders from rounds of bounded
samples cover all crowded rows, each is at home with its nearest leader, and every row within a
leader's radius plus the angle of the floor, which no similar row can exceed, is sent there.
The homes of a leader are split into blocks of ``HOMES`` rows, so a dense group of n rows costs
n * n products, in tasks of bounded memory.  Other rows have at most 2 * WINDOW * CURVES
candidates.

Defined cases: null, short, non-finite, all-zero vectors and such with a null or wrong
dimension are left out; different dimensions never compare; ties go to the smaller id;
repeated ids count once; empty tables give empty results; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import bounded_sample, materialise

CURVES, WINDOW, AXES, BITS, SAMPLE, SEED = 16, 128, 16, 3, 20_000, 17
#: Axes of a sketch, and squared distance of two over that of the floor up to which a pair is a candidate.
SKETCH, SLACK, _STEP = 24, 2.0, 1 / 32
#: Copies up to which the rows without them are not written a second time.
MOST_COPIES = 1_000_000
#: Rows of one range of a curve.
RANGE_ROWS = 25_000
_BLOCK = 192
#: Share of a window that makes a row crowded, and crowded rows of one block of exact comparison.
CROWD, HOMES = 0.75, 4_000


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer grid points (n x axes), by the Gray-code transpose: undo the
    rotations from the top bit down, Gray-encode, interleave."""
    x = cells.astype(np.uint32).copy()
    axes = x.shape[1]
    level = np.uint32(1 << (bits - 1))
    while level > 1:
        low = np.uint32(level - 1)
        for i in range(axes):
            on = (x[:, i] & level) != 0
            swap = np.where(on, np.uint32(0), (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(on, low, swap)
            if i:
                x[:, i] ^= swap
        level = np.uint32(level >> 1)
    for i in range(1, axes):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.uint32)
    level = np.uint32(1 << (bits - 1))
    while level > 1:
        flip ^= np.where((x[:, -1] & level) != 0, np.uint32(level - 1), np.uint32(0))
        level = np.uint32(level >> 1)
    x ^= flip[:, None]
    key = np.zeros(len(x), np.int64)
    for j in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << 1) | ((x[:, i] >> np.uint32(j)) & np.uint32(1)).astype(np.int64)
    return key


def curve_keys(unit: np.ndarray, curve: int, axes: int = AXES, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """Keys of unit vectors (n x dim) on one curve."""
    dim = unit.shape[1]
    rng = np.random.default_rng([seed, curve, dim])
    axes = min(axes, dim)
    basis = np.linalg.qr(rng.normal(size=(dim, axes)))[0]
    shift = rng.uniform(-0.5, 0.5, size=axes)
    # a random unit vector has standard deviation 1 per axis after this scaling
    spread = unit @ basis * np.sqrt(dim) + shift
    cells = np.clip(np.floor((spread + 2.5) / 5 * (1 << bits)), 0, (1 << bits) - 1)
    return hilbert_keys(cells, bits)


def sketch(unit: np.ndarray) -> np.ndarray:
    """One byte per axis of a projection of its own; squared differences, times ``_STEP`` squared
    over the number of axes, estimate the squared distance of unit vectors."""
    dim = unit.shape[1]
    basis = np.linalg.qr(np.random.default_rng([SEED, 10_007, dim]).normal(size=(dim, min(SKETCH, dim))))[0]
    return np.clip(np.rint(unit @ basis * np.sqrt(dim) / _STEP), -127, 127).astype(np.int8)


def _unit(raw: np.ndarray) -> np.ndarray:
    wide = raw.astype(np.float64)
    # scaled first, so that squares of very large or very small values stay finite
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def usable(vectors: DataFrame, key: str = "entry_id", column: str = "embedding", dim: str = "embed_dim") -> DataFrame:
    """(id, dim, vec) of vectors that have their declared dimension, finite and not all zero."""
    v = F.col(column)
    top = F.lit(float("inf"))
    return vectors.filter(
        F.col(key).isNotNull() & (F.size(v) > 0) & (F.size(v) == F.col(dim))
        & F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < top))
        & F.exists(v, lambda x: x != 0)
    ).select(F.col(key).cast("long").alias("id"), F.col(dim).cast("int").alias("dim"), v.cast("array<float>").alias("vec"))


def _cuts(sample: list, parts: int) -> dict[tuple[int, int], np.ndarray]:
    by_dim: dict[int, list] = {}
    for dim, vec in sample:
        by_dim.setdefault(dim, []).append(vec)
    cuts = {}
    for dim, vecs in by_dim.items():
        unit = _unit(np.asarray(vecs, dtype=np.float32))
        share = max(1, round(parts * len(vecs) / max(1, len(sample))))
        for c in range(CURVES):
            keys = np.sort(curve_keys(unit, c))
            cuts[dim, c] = keys[(np.arange(1, share) * len(keys)) // share]
    return cuts


def _lay(cuts: dict[tuple[int, int], np.ndarray]):
    """Arrow function: (id, dim, vec) -> one row per curve."""
    schema = pa.schema([("curve", pa.int32()), ("dim", pa.int32()), ("part", pa.int32()), ("key", pa.int64()),
                        ("id", pa.int64()), ("mini", pa.binary())])

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims = batch["id"].to_numpy(zero_copy_only=False), batch["dim"].to_numpy(zero_copy_only=False)
            lists = batch["vec"]
            flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for dim in np.unique(dims):
                rows = np.nonzero(dims == dim)[0]
                raw = np.stack([flat[offsets[r]:offsets[r] + dim] for r in rows]).astype(np.float32)
                unit, some = _unit(raw), ids[rows]
                small = sketch(unit)
                n, wide = len(rows), small.shape[1]
                blob = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * wide).astype(np.int32)), pa.py_buffer(small.tobytes())])
                for c in range(CURVES):
                    keys = curve_keys(unit, c)
                    edges = cuts.get((int(dim), c), np.zeros(0, np.int64))
                    lo, hi = np.searchsorted(edges, keys, "left"), np.searchsorted(edges, keys, "right")
                    mixed = (some.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                    part = lo + (mixed % (hi - lo + 1).astype(np.uint64)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, c, np.int32)), pa.array(np.full(n, dim, np.int32)),
                         pa.array(part.astype(np.int32)), pa.array(keys), pa.array(some), blob],
                        schema=schema,
                    )

    return lay, "curve int, dim int, part int, key long, id long, mini binary"


def _near(floor: float) -> float:
    """Cosine of twice the angle of ``floor``."""
    return float(np.cos(min(np.pi, 2 * np.arccos(min(1.0, max(-1.0, floor))))))


def _windows(window: int, floor: float):
    """Arrow function over rows sorted by (curve, dim, part, key): candidate pairs within the
    window, and (id, id) for crowded rows."""
    full = max(1, round(CROWD * window))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    # squared distances of unit vectors at the floor and at twice its angle
    close, near = SLACK * 2 * (1 - floor), 2 * (1 - _near(floor))

    def pairs(ids: np.ndarray, small: np.ndarray, fresh: int, after: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Pairs of a run of rows; the first ``fresh`` rows already met one another.  ``after``
        counts the near rows in the window after each."""
        before = np.zeros(len(ids), np.int64)
        spread = small.astype(np.float32) * np.float32(_STEP / np.sqrt(small.shape[1]))
        size = np.einsum("ij,ij->i", spread, spread)
        low, high = [], []
        for at in range(0, len(ids), _BLOCK):
            end = min(at + _BLOCK, len(ids))
            far = min(end + window, len(ids))
            apart = size[at:end, None] + size[None, at:far] - 2 * (spread[at:end] @ spread[at:far].T)
            r, c = np.nonzero(apart <= max(near, close))
            gap = c - r
            keep = (gap > 0) & (gap <= window) & (c + at >= fresh)
            r, c = r[keep], c[keep]
            value = apart[r, c]
            r, c = r + at, c + at
            after += np.bincount(r[value <= near], minlength=len(ids))
            before += np.bincount(c[value <= near], minlength=len(ids))
            low.append(ids[r[value <= close]])
            high.append(ids[c[value <= close]])
            if sum(map(len, low)) > 200_000:
                yield both(low, high)
                low, high = [], []
        crowded = ids[(after >= full) | (before >= full)]
        yield both([*low, crowded], [*high, crowded])

    def both(low: list, high: list) -> pa.RecordBatch:
        x, y = np.concatenate(low), np.concatenate(high)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], schema=schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple | None = None  # group, ids, sketches, near rows after, of the last rows of the open run
        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in ("curve", "dim", "part")], axis=1)
            ids = batch["id"].to_numpy(zero_copy_only=False)
            minis = batch["mini"]
            starts = np.r_[0, np.nonzero((group[1:] != group[:-1]).any(axis=1))[0] + 1, len(ids)]
            for lo, hi in zip(starts[:-1], starts[1:]):
                tag, axes = tuple(group[lo]), min(SKETCH, int(group[lo, 1]))
                small = np.frombuffer(b"".join(minis.slice(lo, hi - lo).to_pylist()), np.int8).reshape(-1, axes)
                here, fresh, after = ids[lo:hi], 0, np.zeros(hi - lo, np.int64)
                if kept is not None and kept[0] == tag:
                    here, small, fresh = np.r_[kept[1], here], np.concatenate([kept[2], small]), len(kept[1])
                    after = np.r_[kept[3], after]
                yield from pairs(here, small, fresh, after)
                kept = (tag, here[-window:], small[-window:], after[-window:])

    return walk, "a long, b long"


def _ranked(floor: float):
    """Arrow function: (a, b, va, vb) -> (a, b, cosine) with cosine >= floor."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cosine", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch["va"], batch["vb"]
            many = left.value_lengths().to_numpy(zero_copy_only=False)
            x, y = left.flatten().to_numpy(zero_copy_only=False), right.flatten().to_numpy(zero_copy_only=False)
            start = np.cumsum(many) - many
            for dim in np.unique(many):
                rows = np.nonzero(many == dim)[0]
                cells = start[rows][:, None] + np.arange(dim)
                cosine = np.round(np.einsum("ij,ij->i", _unit(x[cells]), _unit(y[cells])), 6)
                ok = cosine >= floor
                pick = pa.array(rows[ok])
                yield pa.RecordBatch.from_arrays([batch["a"].take(pick), batch["b"].take(pick), pa.array(cosine[ok])], schema=schema)

    return run, "a long, b long, cosine double"


def _meetings(reps: DataFrame, floor: float, window: int, range_rows: int) -> DataFrame:
    """(a, b), a <= b, distinct: rows within a window on some curve whose sketches are close;
    a = b marks a crowded row."""
    n = reps.count()
    sample = bounded_sample(reps, "id", SAMPLE, SEED).select("dim", "vec").collect() if n else []
    parts = max(1, -(-n // range_rows))
    lay, laid = _lay(_cuts([(r.dim, r.vec) for r in sample], parts))
    rows = reps.mapInArrow(lay, laid).repartition(parts * CURVES, "curve", "dim", "part").sortWithinPartitions(
        "curve", "dim", "part", "key", "id"
    )
    walk, walked = _windows(window, floor)
    return rows.mapInArrow(walk, walked).distinct()


def _exact_cosines(reps: DataFrame, pairs: DataFrame, floor: float) -> DataFrame:
    """(a, b, cosine) of ``pairs`` (a, b) with cosine >= floor."""
    left = pairs.join(reps.select(F.col("id").alias("a"), F.col("vec").alias("va")), "a")
    right = reps.select(F.col("id").alias("b"), F.col("vec").alias("vb")).join(pairs.select("b"), "b", "left_semi")
    run, kind = _ranked(floor)
    return left.join(right, "b").select("a", "b", "va", "vb").mapInArrow(run, kind)


def candidate_pairs(
    reps: DataFrame, floor: float, window: int = WINDOW, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """(a, b, cosine), a < b, distinct: rows within a window on some curve, cosine >= floor."""
    met = materialise(_meetings(reps, floor, window, range_rows), "candidates")
    return _exact_cosines(reps, met.filter(F.col("a") < F.col("b")), floor)


def _leaders(sample: list, near: float) -> dict[int, np.ndarray]:
    """By dimension, unit vectors such that every sampled one is near one of them."""
    by_dim: dict[int, list] = {}
    for dim, vec in sample:
        by_dim.setdefault(dim, []).append(vec)
    out = {}
    for dim, vecs in by_dim.items():
        unit, chosen = _unit(np.asarray(vecs, dtype=np.float32)), []
        open_ = np.ones(len(unit), bool)
        for i in range(len(unit)):
            if open_[i]:
                chosen.append(i)
                open_ &= unit @ unit[i] < near
                open_[i] = False
        out[dim] = unit[chosen]
    return out


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, ids, raw) of each dimension of a batch of (id, dim, vec)."""
    ids, dims = batch["id"].to_numpy(zero_copy_only=False), batch["dim"].to_numpy(zero_copy_only=False)
    flat, offsets = batch["vec"].values.to_numpy(zero_copy_only=False), batch["vec"].offsets.to_numpy()
    for dim in np.unique(dims):
        rows = np.nonzero(dims == dim)[0]
        yield int(dim), ids[rows], np.stack([flat[offsets[r]:offsets[r] + dim] for r in rows]).astype(np.float32)


def _housed(leaders: dict[int, np.ndarray], near: float):
    """Arrow function: (id, dim, vec) -> (id, leader, angle), leader -1 where none is near."""
    schema = pa.schema([("id", pa.int64()), ("leader", pa.int32()), ("angle", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, ids, raw in _vectors(batch):
                best, cosine = np.full(len(ids), -1, np.int32), np.full(len(ids), -1.0)
                if dim in leaders:
                    unit = _unit(raw)
                    for at in range(0, len(ids), _BLOCK):
                        part = unit[at:at + _BLOCK] @ leaders[dim].T
                        best[at:at + _BLOCK], cosine[at:at + _BLOCK] = part.argmax(axis=1), part.max(axis=1)
                    best = np.where(cosine >= near, best, -1).astype(np.int32)
                angle = np.arccos(np.clip(cosine, -1, 1))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(best), pa.array(angle)], schema=schema)

    return run, "id long, leader int, angle double"


def _sent(leaders: dict[int, np.ndarray], reach: dict[int, np.ndarray], blocks: dict[int, np.ndarray]):
    """Arrow function: (id, dim, vec) -> one row per block of each leader in reach."""
    schema = pa.schema([("dim", pa.int32()), ("leader", pa.int32()), ("block", pa.int32()), ("guest", pa.bool_()),
                        ("id", pa.int64()), ("raw", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, ids, raw in _vectors(batch):
                if dim not in leaders:
                    continue
                unit, blob = _unit(raw), np.array([r.tobytes() for r in raw], dtype=object)
                for at in range(0, len(ids), _BLOCK):
                    cosine = np.clip(unit[at:at + _BLOCK] @ leaders[dim].T, -1, 1)
                    r, leader = np.nonzero(np.arccos(cosine) <= reach[dim])
                    many = blocks[dim][leader]
                    block = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    r, leader = np.repeat(r, many) + at, np.repeat(leader, many)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(r), dim, np.int32)), pa.array(leader.astype(np.int32)), pa.array(block.astype(np.int32)),
                         pa.array(np.ones(len(r), bool)), pa.array(ids[r]), pa.array(blob[r], pa.binary())], schema=schema
                    )

    return run, "dim int, leader int, block int, guest boolean, id long, raw binary"


def _exact(k: int, floor: float):
    """Arrow function over rows sorted by (dim, leader, block, guest, id): pairs of each home
    with its ``k`` most similar guests, ties to the smaller id."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cosine", pa.float64())])

    class Block:
        def __init__(self) -> None:
            self.ids, self.raw, self.unit, self.met = [], [], None, 0

        def meet(self, ids: np.ndarray, raw: np.ndarray) -> None:
            if self.unit is None:
                self.home, self.unit = np.concatenate(self.ids), _unit(np.concatenate(self.raw))
                self.cosine = np.full((len(self.home), k), -2.0)
                self.other = np.full((len(self.home), k), -1, np.int64)
            unit, at = _unit(raw), 0
            while at < len(ids):
                # few at first, so that most of the later ones stay below the k-th best
                end = min(len(ids), at + min(1024, max(64, self.met)))
                self.step(ids[at:end], unit[at:end])
                self.met, at = self.met + end - at, end

        def step(self, ids: np.ndarray, unit: np.ndarray) -> None:
            value = self.unit @ unit.T
            place = np.minimum(np.searchsorted(self.home, ids), len(self.home) - 1)
            same = self.home[place] == ids
            value[place[same], np.nonzero(same)[0]] = -3.0
            # guests come by id, so an equal one that comes later has the larger id
            least = np.maximum(floor, self.cosine[:, -1])
            r, c = np.nonzero(value >= least[:, None] - 1e-6)
            exact = np.round(value[r, c], 6)
            ok = (exact >= floor) & (exact > self.cosine[r, -1])
            r, c, exact = r[ok], c[ok], exact[ok]
            if not len(r):
                return
            rows = np.unique(r)
            row = np.r_[np.repeat(rows, k), r]
            cosine, other = np.r_[self.cosine[rows].ravel(), exact], np.r_[self.other[rows].ravel(), ids[c]]
            order = np.lexsort((other, -cosine, row))
            row, cosine, other = row[order], cosine[order], other[order]
            first = np.r_[True, row[1:] != row[:-1]]
            rank = np.arange(len(row)) - np.maximum.accumulate(np.where(first, np.arange(len(row)), 0))
            keep = rank < k
            self.cosine[rows], self.other[rows] = cosine[keep].reshape(-1, k), other[keep].reshape(-1, k)

        def found(self) -> Iterator[pa.RecordBatch]:
            if self.unit is None:
                return
            r, c = np.nonzero(self.cosine >= floor)
            x, y = self.home[r], self.other[r, c]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(self.cosine[r, c])], schema=schema
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag, block = None, Block()
        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.stack([batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("dim", "leader", "block", "guest")], axis=1)
            ids, blobs = batch["id"].to_numpy(zero_copy_only=False), batch["raw"]
            starts = np.r_[0, np.nonzero((group[1:] != group[:-1]).any(axis=1))[0] + 1, len(ids)]
            for lo, hi in zip(starts[:-1], starts[1:]):
                if tag != tuple(group[lo, :3]):
                    yield from block.found()
                    tag, block = tuple(group[lo, :3]), Block()
                raw = np.frombuffer(b"".join(blobs.slice(lo, hi - lo).to_pylist()), np.float32).reshape(-1, int(group[lo, 0]))
                if not group[lo, 3]:
                    block.ids.append(ids[lo:hi])
                    block.raw.append(raw)
                elif block.ids:
                    block.meet(ids[lo:hi], raw)
        yield from block.found()

    return run, "a long, b long, cosine double"


def crowded_pairs(reps: DataFrame, crowded: DataFrame, k: int, floor: float, homes: int = HOMES) -> DataFrame | None:
    """(a, b, cosine), a < b: every row of ``crowded`` (id) with its ``k`` most similar others of
    all ``reps`` with cosine >= floor, exactly; None if there are no crowded rows."""
    near, alpha = _near(floor), float(np.arccos(floor))
    rest = materialise(reps.join(crowded, "id", "left_semi"), "crowded")
    out = None
    while rest.count():
        # every round covers at least its sample
        leaders = _leaders([(r.dim, r.vec) for r in bounded_sample(rest, "id", SAMPLE, SEED).select("dim", "vec").collect()], near)
        run, kind = _housed(leaders, near)
        housed = materialise(rest.join(rest.select("id", "dim", "vec").mapInArrow(run, kind), "id"), "housed")
        rest = housed.filter(F.col("leader") < 0).select("id", "dim", "vec")
        housed = housed.filter(F.col("leader") >= 0)
        reach = {d: np.full(len(m), -1.0) for d, m in leaders.items()}
        blocks = {d: np.zeros(len(m), np.int64) for d, m in leaders.items()}
        for r in housed.groupBy("dim", "leader").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("angle")).collect():
            # the arc cosine of a cosine near 1 is exact to 1e-7 only
            reach[r.dim][r.leader], blocks[r.dim][r.leader] = r.angle + alpha + 1e-6, -(-r.n // homes)
        many = reps.sparkSession.createDataFrame(
            [(int(d), i, int(n)) for d, b in blocks.items() for i, n in enumerate(b) if n], "dim int, leader int, blocks int")
        run, kind = _sent(leaders, reach, blocks)
        guests = reps.select("id", "dim", "vec").mapInArrow(run, kind)
        raw, kind = _packed()
        at_home = housed.join(many, ["dim", "leader"]).select(
            "dim", "leader", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "id", "vec"
        ).mapInArrow(raw, kind)
        tasks = max(1, sum(int(b.sum()) for b in blocks.values()))
        rows = at_home.unionByName(guests).repartition(tasks, "dim", "leader", "block").sortWithinPartitions(
            "dim", "leader", "block", "guest", "id"
        )
        run, kind = _exact(k, floor)
        part = materialise(rows.mapInArrow(run, kind), "exact")
        out = part if out is None else out.unionByName(part)
    return out


def _packed():
    """Arrow function: (dim, leader, block, id, vec) -> rows at home in the form of ``_sent``."""
    schema = pa.schema([("dim", pa.int32()), ("leader", pa.int32()), ("block", pa.int32()), ("guest", pa.bool_()),
                        ("id", pa.int64()), ("raw", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = batch["vec"].values.to_numpy(zero_copy_only=False).astype(np.float32), batch["vec"].offsets.to_numpy()
            blob = pa.array([flat[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch["dim"], batch["leader"], batch["block"], pa.array(np.zeros(batch.num_rows, bool)), batch["id"], blob], schema=schema
            )

    return run, "dim int, leader int, block int, guest boolean, id long, raw binary"


def nearest(vectors: DataFrame, k: int = 5, floor: float = 0.9, window: int = WINDOW) -> DataFrame:
    """(id, other, cosine, place): up to ``k`` most similar others of every usable vector
    with cosine >= floor, place 1 the most similar, ties to the smaller id."""
    # the quotients of equal directions are the same doubles; + 0.0 makes -0.0 one with 0.0.
    # Arrays of one element bind a value, so that it is computed once
    top = F.array(F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double")))))
    way = F.transform(top, lambda t: F.transform("vec", lambda x: x.cast("double") / t + 0.0))
    hashes = F.transform(way, lambda w: F.struct(F.xxhash64(w).alias("h1"), F.hash(w).alias("h2")))
    rows = vectors.withColumn("h", F.explode(hashes)).select("id", F.monotonically_increasing_id().alias("row"), "dim", "vec", "h.h1", "h.h2")
    rows = materialise(rows, "usable")
    group = ["dim", "h1", "h2"]
    once = rows.groupBy("id").agg(F.min(F.struct("row", *group)).alias("m")).select("id", "m.*")
    heads = once.groupBy(*group).agg(F.min(F.struct("id", "row")).alias("m"))
    owned = materialise(once.join(heads, group).select("id", F.col("m.id").alias("cid"), "row", F.col("m.row").alias("first")), "members")
    # rows that only repeat an id or a class are left out; they are few, or the others are written once
    copies = rows.select("row").join(owned.filter(F.col("row") == F.col("first")).select("row"), "row", "left_anti")
    copies = materialise(copies, "copies")
    reps = rows.join(copies, "row", "left_anti").select("id", "dim", "vec")
    if copies.count() > MOST_COPIES:
        reps = materialise(reps, "vectors")
    met = materialise(_meetings(reps, floor, window, RANGE_ROWS), "candidates")
    links = materialise(_exact_cosines(reps, met.filter(F.col("a") < F.col("b")), floor), "pairs")
    exact = crowded_pairs(reps, met.filter(F.col("a") == F.col("b")).select(F.col("a").alias("id")), k + 1, floor)
    if exact is not None:
        links = materialise(links.unionByName(exact).groupBy("a", "b").agg(F.max("cosine").alias("cosine")), "links")
    members = owned.select("id", "cid")
    # the k + 1 smallest ids of a class are all that can be chosen of it
    first = Window.partitionBy("cid").orderBy("id")
    few = members.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1).select("cid", F.col("id").alias("other"))
    both = links.select(F.col("a").alias("x"), F.col("b").alias("y"), "cosine").unionByName(
        links.select(F.col("b").alias("x"), F.col("a").alias("y"), "cosine")
    )
    own = members.filter(F.col("id") == F.col("cid")).select(F.col("cid").alias("x"), F.col("cid").alias("y"), F.lit(1.0).alias("cosine"))
    best = Window.partitionBy("x").orderBy(F.col("cosine").desc(), "other")
    ranked = both.unionByName(own).join(few.withColumnRenamed("cid", "y"), "y").select("x", "other", "cosine")
    ranked = ranked.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).drop("r")
    mine = Window.partitionBy("id").orderBy(F.col("cosine").desc(), "other")
    chosen = members.join(ranked, members["cid"] == ranked["x"]).filter(F.col("other") != F.col("id"))
    return chosen.withColumn("place", F.row_number().over(mine)).filter(F.col("place") <= k).select(
        "id", "other", "cosine", "place"
    )


def similar_entries(vectors: DataFrame, k: int = 5, floor: float = 0.9) -> DataFrame:
    """(entry_a, entry_b): pairs with cosine >= floor of which one is among the ``k`` most
    similar of the other, smaller id first."""
    return nearest(usable(vectors), k, floor).select(
        F.least("id", "other").alias("entry_a"), F.greatest("id", "other").alias("entry_b")
    ).distinct()
