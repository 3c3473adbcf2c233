"""Problem 3: the k most similar vectors of every vector, by multi-index hashing.

Codes of one bit per dimension are learned by iterative quantisation (a rotation of
the principal axes that moves the data towards the corners of a cube); several starts
give several codes. The codes are split into disjoint substrings; each substring is a
table that holds every vector under its value and, probing within Hamming radius 1,
under the values with one of its least certain bits flipped. How long a substring is,
how many tables and how many flips there are is chosen from the number of rows by a
cost estimate, under the condition that pairs at the least similarity meet at the
target rate, measured on pairs made at that similarity. In a bucket codes are compared
first (XOR, bit count), and only pairs within the radius have their vectors compared.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.plans.runtime import ship, spread
from loomgraph.plans.skew import skew_join

DIM, K, MIN_SIM = 64, 5, 0.85
#: Rows of the sample on which the rotation is fitted (the index itself holds every row).
FIT_ROWS = 20_000
#: A bucket is one group's work up to this many vectors; a larger one is split into pairs of blocks.
BLOCK = 16_384
#: Least share of pairs at the least similarity that share a bucket, and of those within the radius.
MEET, WITHIN = 0.96, 0.995
#: Costs that the choice of an index weighs (microseconds): a copy of a vector in a table, a comparison of two codes.
COPY_COST, PAIR_COST = 8.0, 0.0025
#: Most tables, flips of a table and bits of a substring that are tried; pairs on which a choice is measured.
TABLES, FLIPS, BITS, TRIALS = 128, 3, 24, 4000
#: Rows of buckets over ``BLOCK`` that may be broadcast; more are joined by shuffle.
HOT_ROWS = 1_000_000
#: Vectors are stored in buckets as 16-bit fixed point of this scale.
SCALE = 32767.0


@dataclass
class Index:
    rotations: list[np.ndarray]  # of DIM x DIM; the first gives the code that is compared
    bits: int  # of a substring
    tables: int
    flips: int  # probes of a table besides the own value
    radius: int
    meet: float  # measured share of pairs at the least similarity that share a bucket


def rotation(axes: np.ndarray, v: np.ndarray, seed: int) -> np.ndarray:
    """One learned rotation: iterative quantisation of the sample ``v`` (in the principal axes) from a random start."""
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(v.shape[1], v.shape[1])))[0]
    for _ in range(20):
        b = np.where(v @ r >= 0, 1.0, -1.0)
        u, _, w = np.linalg.svd(b.T @ v)
        r = (u @ w).T
    return axes.T @ r


def table_values(y: np.ndarray, table: int, bits: int, flips: int) -> np.ndarray:
    """Values under which rows go into one table: their own, then with the least certain bits flipped, one at a time.

    ``y`` are the rotated vectors of the table's code.
    """
    per = y.shape[1] // bits
    part = y[:, (table % per) * bits : (table % per + 1) * bits]
    own = (part >= 0) @ (1 << np.arange(bits, dtype=np.int64))
    if not flips:
        return own[:, None]
    weak = np.argsort(np.abs(part), axis=1)[:, :flips]
    return np.concatenate([own[:, None], own[:, None] ^ (1 << weak.astype(np.int64))], axis=1)


def fit(sample: np.ndarray, rows: int, min_sim: float = MIN_SIM, seed: int = 7, meet: float = MEET) -> Index:
    """Index for ``rows`` vectors from a sample of unit vectors.

    Of all substring lengths and numbers of flips, each with the fewest tables that
    reach ``meet`` on made pairs, the one with the least estimated cost is taken;
    raises where none reaches it.
    """
    d = sample.shape[1]
    rnd = np.random.default_rng(seed)
    axes = np.linalg.eigh(sample.T @ sample)[1].T[::-1]  # not centred: planes through the origin keep the number of differing bits in proportion to the angle
    few = sample[:5000] @ axes.T
    rotations = [rotation(axes, few, seed)]
    x = sample[rnd.integers(0, len(sample), TRIALS)]
    z = rnd.normal(size=x.shape)
    z -= (x * z).sum(1, keepdims=True) * x
    y = min_sim * x + math.sqrt(1 - min_sim**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    turned: list[tuple[np.ndarray, ...]] = []

    def turn(code: int) -> tuple[np.ndarray, ...]:
        while len(turned) <= code:
            if len(turned) == len(rotations):
                rotations.append(rotation(axes, few, seed + len(rotations)))
            r = rotations[len(turned)]
            turned.append((x @ r, y @ r, sample[:5000] @ r))
        return turned[code]

    a, b, _ = turn(0)
    radius = int(np.quantile(((a >= 0) != (b >= 0)).sum(1), WITHIN))
    best: tuple[float, Index] | None = None
    if rows <= BLOCK:
        best = COPY_COST + rows / 2 * PAIR_COST, Index(rotations, 0, 1, 0, radius, 1.0)
    for bits in range(2, min(BITS, d) + 1):
        if best and best[0] < COPY_COST * bits / 2:  # longer substrings need more tables still
            break
        for flips in range(min(FLIPS, bits) + 1):
            met, cost = np.zeros(len(x), bool), 0.0
            for t in range(TABLES):
                a, b, s = turn(t // (d // bits))
                va, vb = table_values(a, t, bits, flips), table_values(b, t, bits, flips)
                met |= (va[:, :, None] == vb[:, None, :]).any((1, 2))
                n = np.unique(table_values(s, t, bits, flips), return_counts=True)[1]
                cost += COPY_COST * (1 + flips) + (n * (n - 1.0)).sum() / max(len(s) * (len(s) - 1.0), 1.0) * rows / 2 * PAIR_COST
                if best and cost >= best[0]:
                    break
                if met.mean() >= meet:
                    best = cost, Index(rotations, bits, t + 1, flips, radius, float(met.mean()))
                    break
    if best is None:
        raise ValueError(f"no index within {TABLES} tables lets {meet:.0%} of pairs at {min_sim} meet")
    ix = best[1]
    ix.rotations = rotations[: -(-ix.tables // (d // ix.bits)) if ix.bits else 1]
    return ix


def _unit(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(usable row numbers, unit vectors) of lists of ``DIM``: those with NULL or NaN elements and zero vectors are left out."""
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, DIM)
    n = np.sqrt((x * x).sum(1))
    good = np.flatnonzero(np.isfinite(n) & (n > 0))
    return good, x[good] / n[good, None]


def _digest(x: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each row of integers."""
    out = []
    for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        k = np.random.default_rng(seed).integers(1, 2**63, x.shape[1], np.uint64) * np.uint64(2) + np.uint64(1)
        h = x.astype(np.int64).view(np.uint64) * k
        h ^= h >> np.uint64(31)
        h = (h * np.uint64(0xBF58476D1CE4E5B9)).sum(1, dtype=np.uint64)
        out.append((h ^ (h >> np.uint64(29))).view(np.int64))
    return np.stack(out, axis=1)


_UNIT = pa.schema([("vec_id", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("q", pa.binary())])


def unit_vectors(df: DataFrame) -> DataFrame:
    """(vec_id, digest of the direction, fixed-point unit vector) of the usable vectors; rows delivered again stay."""
    ship(df.sparkSession)

    def run(batches):
        for b in batches:
            at, x = _unit(b.column(1))
            q = np.rint(x * SCALE).astype(np.int16)
            d = _digest(np.rint(x * 1e5))  # equal vectors, also of another norm; finer than the fixed point
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()).take(pa.array(at)), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array([r.tobytes() for r in q], pa.binary())], schema=_UNIT)

    return spread(df.select("vec_id", "embedding").where("vec_id is not null and size(embedding) = 64")).mapInArrow(run, "vec_id bigint, d1 bigint, d2 bigint, q binary")


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.int16).reshape(-1, DIM)


def _turned(q: np.ndarray) -> np.ndarray:
    """Unit vectors of fixed-point ones; always in double precision, so that a vector has the same keys wherever they are computed."""
    x = q / SCALE
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _codes(x: np.ndarray, ix: Index) -> np.ndarray:
    """64-bit codes of unit vectors."""
    return np.packbits(x @ ix.rotations[0] >= 0, axis=1).view(">u8").astype(np.uint64).ravel()


def bucket_keys(x: np.ndarray, ix: Index) -> np.ndarray:
    """Keys of the buckets that hold each vector, over all tables."""
    if not ix.bits:
        return np.zeros((len(x), 1), np.int64)
    per, out = x.shape[1] // ix.bits, []
    for t in range(ix.tables):
        if t % per == 0:
            y = x @ ix.rotations[t // per]
        out.append(table_values(y, t, ix.bits, ix.flips) | (t << ix.bits))
    return np.concatenate(out, axis=1)


_CAND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sim", pa.float64())])


def first_shared(ka: np.ndarray, kb: np.ndarray, key: int, ix: Index) -> np.ndarray:
    """Whether ``key`` is the first bucket that the pairs with bucket keys ``ka`` and ``kb`` share."""
    first, wide, own = np.ones(len(ka), bool), 1 + ix.flips, key >> ix.bits
    for t in range(own):
        a, b = ka[:, t * wide : (t + 1) * wide], kb[:, t * wide : (t + 1) * wide]
        first &= ~(a[:, :, None] == b[:, None, :]).any((1, 2))
    a, b = ka[:, own * wide : (own + 1) * wide], kb[:, own * wide : (own + 1) * wide]
    least = np.where((a[:, :, None] == b[:, None, :]).any(2), a, np.iinfo(np.int64).max).min(1)
    return first & (least == key)


def _compare(ia, xa, ca, ib, xb, cb, ka, kb, key: int, ix: Index, same: bool, min_sim: float):
    """Pairs of two blocks of one bucket: within the radius, then at least ``min_sim`` by their vectors, each under the first bucket that it shares."""
    near = np.bitwise_count(ca[:, None] ^ cb[None, :]) <= ix.radius
    if same:
        near &= np.tri(len(ia), len(ib), -1, dtype=bool).T
    i, j = np.nonzero(near)
    if not len(i):
        return None
    sim = np.empty(len(i))
    for s in range(0, len(i), 200_000):
        t = slice(s, s + 200_000)
        sim[t] = np.einsum("ij,ij->i", xa[i[t]], xb[j[t]])
    keep = np.flatnonzero(sim >= min_sim - 1e-4)
    if ix.bits:
        keep = keep[first_shared(ka[i[keep]], kb[j[keep]], key, ix)]
    return np.minimum(ia[i[keep]], ib[j[keep]]), np.maximum(ia[i[keep]], ib[j[keep]]), sim[keep]


def nearest(df: DataFrame, k: int = K, min_sim: float = MIN_SIM) -> DataFrame:
    """(vec_id, embedding) -> (vec_a, vec_b), vec_a < vec_b: at least one is among the ``k`` most
    similar of the other and their cosine is at least ``min_sim`` (rounded to 6 decimals; ties to
    the smaller vec_id).

    Equal vectors are searched once and their copies joined afterwards; of a class of
    copies only the smallest ``k + 1`` ids can be anyone's nearest, so the search holds
    no more. Buckets of any size are split into block pairs, none is capped.
    """
    raw = unit_vectors(df).persist()
    units = raw.select("d1", "d2", "vec_id").distinct().persist()  # without the vectors
    # classes of equal vectors: WindowGroupLimit keeps k + 1 rows of a class on the map side
    w = Window.partitionBy("d1", "d2").orderBy("vec_id")
    sizes = units.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min("vec_id").alias("rep")).persist()
    first = units.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).groupBy("d1", "d2").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = first.join(sizes, ["d1", "d2"]).where("n > 1").select("d1", "d2", "rep", "n", "ids").persist()
    reps = raw.groupBy("d1", "d2").agg(F.min("vec_id").alias("vec_id"), F.first("q").alias("q")).select("vec_id", "q").persist()

    rows = sizes.count()
    sample = reps.orderBy(F.xxhash64("vec_id")).limit(FIT_ROWS).select("q").toArrow().column("q")
    if rows < 2 or not len(sample):
        pairs = reps.sparkSession.createDataFrame([], "a bigint, b bigint, sim double")
    else:
        x = _matrix(sample) / SCALE
        ix = fit(x / np.linalg.norm(x, axis=1, keepdims=True), rows, min_sim)
        pairs = _candidates(reps, ix, k, min_sim)
    # nearest classes: both ends ask, the k best classes of each by (similarity, smallest id)
    sim = F.round("sim", 6).alias("sim")
    ask = pairs.select(F.explode(F.array(F.struct("a", "b", sim), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), sim))).alias("x")).select("x.*").where(F.col("sim") >= min_sim)
    near = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    ask = ask.withColumn("r", F.row_number().over(near)).where(F.col("r") <= k).select("a", "b", "sim")
    ids = classes.where("n > 1").select("rep", "n", "ids")
    small = classes.where((F.col("n") > 1) & (F.col("n") <= k)).select("rep", "ids")
    # members of a class of up to k copies: their copies, then the members of the nearest classes
    e = ask.join(ids.select(F.col("rep").alias("b"), F.col("ids").alias("bs")), "b", "left").join(ids.select(F.col("rep").alias("a"), "n", F.col("ids").alias("as_")), "a", "left")
    e = e.where(F.coalesce("n", F.lit(1)) <= k).select(F.explode(F.coalesce("as_", F.array("a"))).alias("a"), F.coalesce("bs", F.array("b")).alias("bs"), "sim").select("a", F.explode("bs").alias("b"), "sim")
    own = small.select(F.explode("ids").alias("a"), "ids").select("a", F.explode("ids").alias("b"), F.lit(1.0).alias("sim")).where("a <> b")
    best = e.unionByName(own).withColumn("r", F.row_number().over(near)).where(F.col("r") <= k).select("a", "b")
    # members of larger classes: the k smallest other ids of the class
    big = classes.where(F.col("n") > k).select("d1", "d2", "n", "ids")
    hot = skew_join(units.withColumnRenamed("vec_id", "a"), big.drop("n"), ["d1", "d2"], big.select("d1", "d2", "n"))
    hot = hot.select("a", F.explode(F.slice(F.array_except("ids", F.array("a")), 1, k)).alias("b"))
    return best.unionByName(hot).select(F.least("a", "b").alias("vec_a"), F.greatest("a", "b").alias("vec_b")).distinct()


def _candidates(reps: DataFrame, ix: Index, k: int, min_sim: float) -> DataFrame:
    """Pairs (a, b, sim) of vectors that share a bucket within the radius."""
    spark = reps.sparkSession
    coded = pa.schema([("row", pa.binary()), ("vec_id", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def encode(batches):
        for b in batches:
            q, ids = _matrix(b.column(1)), b.column(0).to_numpy()
            keys = bucket_keys(_turned(q), ix)
            rows = np.concatenate([ids[:, None].view(np.int16), q], axis=1)  # one binary field: little else is shuffled
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary()), b.column(0), lists], schema=coded)

    base = reps.mapInArrow(encode, "row binary, vec_id bigint, keys array<bigint>").persist()
    hot = base.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("m")).persist()
    full = base.select("row", "vec_id", F.explode("keys").alias("key"))
    many = hot.count()
    if many:  # a bucket of m blocks becomes its pairs of blocks, without a limit on m
        full = full.join(F.broadcast(hot) if many <= HOT_ROWS else hot, "key", "left")
        blk = F.pmod(F.xxhash64("vec_id"), F.col("m")).cast("int")
        full = full.withColumn("m", F.coalesce("m", F.lit(1))).withColumn("blk", blk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        full = full.select("key", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"), (F.col("blk") > F.col("other")).alias("right"), "row")
        full = full.groupBy("key", "lo", "hi")
    else:
        full = full.select("key", F.lit(False).alias("right"), "row").groupBy("key")

    def search(key, t):
        raw = np.frombuffer(b"".join(t.column("row").to_pylist()), np.int16).reshape(-1, DIM + 4)
        v = np.ascontiguousarray(raw[:, :4]).view(np.int64).ravel()
        x = _turned(raw[:, 4:])
        c, keys, own = _codes(x, ix), bucket_keys(x, ix), key[0].as_py()
        if len(key) == 1 or key[1] == key[2]:
            left, right = np.arange(len(v)), None
        else:
            side = t.column("right").to_numpy(zero_copy_only=False).astype(bool)
            left, right = np.flatnonzero(~side), np.flatnonzero(side)
        x, out = x.astype(np.float32), []
        for s in range(0, len(left), 1024):  # bounds the bit matrix in memory
            u = left[s : s + 1024]
            for z in range(s if right is None else 0, len(left if right is None else right), 1024):
                w = (left if right is None else right)[z : z + 1024]
                out.append(_compare(v[u], x[u], c[u], v[w], x[w], c[w], keys[u], keys[w], own, ix, right is None and s == z, min_sim))
        out = [o for o in out if o is not None and len(o[0])]
        if not out:
            return _CAND.empty_table()
        a, b, sim = (np.concatenate(c_) for c_ in zip(*out))
        return _top(a, b, sim, k)

    return full.applyInArrow(search, "a bigint, b bigint, sim double")


def _top(a, b, sim, k) -> pa.Table:
    """The pairs of one bucket that can be among the ``k`` best of either end: all down to the k-th similarity of that end in this bucket."""
    ends, sims, at = np.concatenate([a, b]), np.concatenate([sim, sim]), np.concatenate([np.arange(len(a))] * 2)
    order = np.lexsort((-sims, ends))
    e = ends[order]
    start = np.flatnonzero(np.r_[True, e[1:] != e[:-1]])
    rank = np.arange(len(e)) - np.repeat(start, np.diff(np.r_[start, len(e)]))
    kth = np.repeat(sims[order][np.minimum(start + k - 1, np.r_[start[1:], len(e)] - 1)], np.diff(np.r_[start, len(e)]))
    keep = np.unique(at[order][(rank < k) | (sims[order] >= kth - 2e-6)])
    return pa.table([pa.array(a[keep]), pa.array(b[keep]), pa.array(sim[keep])], schema=_CAND)
