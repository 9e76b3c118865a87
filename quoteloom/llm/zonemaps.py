"""Operator 13: k-means over zone maps of a space-filling curve.

Vectors become whole numbers (``floor(SCALE * x)``) and are put in the order of a Hilbert curve through all their
dimensions, the widest dimensions first, ``BITS`` bits each. Consecutive vectors form blocks of ``BLOCK`` rows; a
block is stored as one row: its ids, its matrix in the narrowest whole-number type, and its zone map, the least and greatest value
of each dimension. The blocks are written once and read by every round.

In a round a task looks at a block's box first. Centroid a beats centroid b everywhere in the box if the greatest value of
|x - a|^2 - |x - b|^2 over the box is negative; the difference is linear in each dimension, so its bound stands in a corner and
costs one pass over the dimensions. With a the centroid whose farthest corner is nearest, what remains are the block's
candidates. They alone are compared with the block's vectors, exactly: in double-precision matrix products where every
partial sum is a whole number below 2^53, in 64-bit integers otherwise. A block with one candidate is not compared at all
while only sums are needed.

A round returns whole-number sums per centroid and dimension, added up per task and then by a grouped sum; the driver holds
k centroids, never vectors. Equal vectors, however many, are spread over blocks by a last sort key and cost a box of
no extent each.

Nulls and edge cases: vectors that are null, of another length, or hold null or non-finite components take no part; neither do
those with a component of 2^27 or more after scaling, whose squared distance would not fit a long; a null id takes part and sorts as
an empty text among the seeds; rows with equal ids are vectors of their own (seeds that tie go by their components); with fewer
vectors than k there are as many centroids as vectors; ties go to the smaller number; a centroid without vectors
stays where it is; inertia that does not fit a long is null; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoteloom.session import durable

K, ROUNDS, SCALE, DIM = 16, 3, 64, 64
BITS = 4  # of the Hilbert curve, per dimension
BLOCK = 512  # vectors
LIMIT = 1 << 27


def whole(v: Column, scale: int = SCALE) -> Column:
    return F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def kept(v: Column, dim: int = DIM, scale: int = SCALE) -> Column:
    fits = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < LIMIT / scale, F.lit(False)))  # null, NaN and infinite fail too
    return v.isNotNull() & (F.size(v) == dim) & fits


# --- the curve ---------------------------------------------------------------------------------------------------------


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of points in a grid of 2^bits cells a side, as byte strings in the order of the curve.

    ``cells`` is points x dimensions. The grid coordinates are untwisted from the highest bit down by exchanges and inversions
    of low bits, Gray-decoded across the dimensions, and their bits are then interleaved.
    """
    x = cells.T.astype(np.uint32).copy()
    dims = len(x)
    top = np.uint32(1 << (bits - 1))
    q = top
    while q > 1:
        low = q - np.uint32(1)
        for d in range(dims):
            set_here = (x[d] & q) != 0
            swap = np.where(set_here, np.uint32(0), (x[0] ^ x[d]) & low)
            x[0] ^= np.where(set_here, low, swap)
            if d:
                x[d] ^= swap
        q >>= np.uint32(1)
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn, q = np.zeros_like(x[0]), top
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - np.uint32(1), np.uint32(0))
        q >>= np.uint32(1)
    x ^= turn
    planes = [((x >> np.uint32(b)) & np.uint32(1)).astype(np.uint8) for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).T, axis=1)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _keyed(batches: Iterator[pa.RecordBatch], low: list[int], high: list[int], bits: int) -> Iterator[pa.RecordBatch]:
    lo = np.array(low, np.float64)
    span = np.array(high, np.float64) - lo
    order = np.argsort(-span, kind="stable")
    for batch in batches:
        if batch.num_rows:
            m = _matrix(batch.column(1), len(lo))
            cells = np.minimum((m - lo) * ((1 << bits) / (span + 1)), (1 << bits) - 1).astype(np.uint32)
            keys = hilbert_keys(cells[:, order], bits)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([k.tobytes() for k in keys], pa.binary())], ["id", "v", "key"])


# --- blocks ------------------------------------------------------------------------------------------------------------


def _packed(m: np.ndarray) -> bytes:
    least, most = int(m.min()), int(m.max())
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= least and most <= np.iinfo(t).max)
    out = io.BytesIO()
    np.save(out, m.astype(kind), allow_pickle=False)
    return out.getvalue()


def _unpacked(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False)


def _cut(batches: Iterator[pa.RecordBatch], dim: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Blocks of ``rows`` consecutive rows of a sorted partition."""
    ids, vectors, held = [], [], 0

    def block(n: int) -> pa.RecordBatch:
        nonlocal ids, vectors, held
        i, m = pa.concat_arrays(ids), np.concatenate(vectors)
        own, rest = m[:n], m[n:]
        ids, vectors, held = ([i.slice(n)], [rest], len(rest)) if len(rest) else ([], [], 0)
        lists = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), i.slice(0, n))
        box = [pa.array([b.tolist()], pa.list_(pa.int64())) for b in (own.min(axis=0), own.max(axis=0))]
        return pa.RecordBatch.from_arrays([lists, *box, pa.array([_packed(own)], pa.binary())], ["ids", "low", "high", "matrix"])

    for batch in batches:
        if batch.num_rows:
            ids.append(batch.column(0))
            vectors.append(_matrix(batch.column(1), dim))
            held += batch.num_rows
        while held >= rows:
            yield block(rows)
    if held:
        yield block(held)


def zone_maps(vectors: DataFrame, low: list[int], high: list[int], bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """``ids, low, high, matrix`` per block of ``id, v`` in the order of the curve."""
    spark, dim = vectors.sparkSession, len(low)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(vectors.dtypes)["id"]
    keyed = vectors.select("id", "v").mapInArrow(lambda it: _keyed(it, low, high, bits), f"id {kind}, v array<long>, key binary")
    salted = keyed.withColumn("_salt", F.monotonically_increasing_id())
    ranged = salted.repartitionByRange(parts, "key", "id", "_salt").sortWithinPartitions("key", "id", "_salt").select("id", "v")
    return durable(ranged.mapInArrow(lambda it: _cut(it, dim, block), f"ids array<{kind}>, low array<long>, high array<long>, matrix binary"))


# --- rounds ------------------------------------------------------------------------------------------------------------


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to some point of the box (whole numbers below 2^28 in size).

    Sums of 64 dimensions stay below 2^62, so 64-bit integers are exact.
    """
    far = (np.maximum(np.abs(centroids - low), np.abs(high - centroids)) ** 2).sum(axis=1)
    best = int(far.argmin())
    a = centroids[best]
    # |x - a|^2 - |x - b|^2 = sum of 2 x (b - a) + a^2 - b^2, greatest in the corner where x (b - a) is greatest
    slope = centroids - a
    most = (2 * np.where(slope > 0, high, low) * slope + (a - centroids) * (a + centroids)).sum(axis=1)
    return np.nonzero((most >= 0) | (np.arange(len(centroids)) == best))[0]


def nearest(m: np.ndarray, centroids: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest of ``among`` for every row, exactly; ties go to the smaller number."""
    c = centroids[among]
    size = max(int(np.abs(m).max()), int(np.abs(c).max()))
    exact = m.shape[1] * 4 * size * size < 1 << 53
    kind = np.float64 if exact else np.int64
    x, c = m.astype(kind), c.astype(kind)
    far = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)
    place = far.argmin(axis=1)
    return among[place], far[np.arange(len(far)), place].astype(np.int64)


def _sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    k, dim = centroids.shape
    total, count, left = np.zeros((k, dim), np.int64), np.zeros(k, np.int64), 1 << 35  # vectors whose sums surely fit

    def out() -> pa.RecordBatch:
        used = np.nonzero(count)[0]
        c, d = np.repeat(used, dim), np.tile(np.arange(dim), len(used))
        return pa.RecordBatch.from_arrays([pa.array(c), pa.array(d), pa.array(total[used].ravel()), pa.array(np.repeat(count[used], dim))], ["cluster", "dim", "s", "n"])

    for batch in batches:
        for low, high, data in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            m = _unpacked(data.as_py()).astype(np.int64)
            among = candidates(low.values.to_numpy(), high.values.to_numpy(), centroids)
            if len(among) == 1:
                total[among[0]] += m.sum(axis=0)
                count[among[0]] += len(m)
            else:
                number, _ = nearest(m, centroids, among)
                for c in np.unique(number).tolist():
                    mine = m[number == c]
                    total[c] += mine.sum(axis=0)
                    count[c] += len(mine)
            left -= len(m)
            if left < 0:
                yield out()
                total[:], count[:], left = 0, 0, 1 << 35
    if count.any():
        yield out()


def _assign(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, low, high, data in zip(*(batch.column(i) for i in range(4)), strict=True):
            m = _unpacked(data.as_py()).astype(np.int64)
            number, far = nearest(m, centroids, candidates(low.values.to_numpy(), high.values.to_numpy(), centroids))
            yield pa.RecordBatch.from_arrays([ids.values, pa.array(number.astype(np.int32)), pa.array(far)], ["id", "cluster", "distance"])


def cluster(
    vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, block: int = BLOCK, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """``id, cluster, distance, cluster_inertia, inertia, centroid`` (whole numbers) of every vector that takes part."""
    spark = vectors.sparkSession
    v = F.col(vector_column)
    rows = durable(vectors.filter(kept(v, dim, scale)).select(F.col(id_column).alias("id"), whole(v, scale).alias("v")))
    kind = dict(rows.dtypes)["id"]
    name = F.coalesce(F.col("id").cast("string"), F.lit(""))
    seeds = rows.orderBy(F.sha2(F.concat(F.lit("1:"), name).cast("binary"), 256), "v").limit(k).collect()
    if not seeds:
        return spark.createDataFrame([], f"id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
    box = rows.agg(*[f(F.col("v")[d]).alias(f"{n}{d}") for d in range(dim) for n, f in (("low", F.min), ("high", F.max))]).first()
    blocks = zone_maps(rows, [box[f"low{d}"] for d in range(dim)], [box[f"high{d}"] for d in range(dim)], block=block)
    centroids = np.array([r.v for r in seeds], np.int64)
    for _ in range(rounds):
        parts = blocks.select("low", "high", "matrix").mapInArrow(lambda it, c=centroids: _sums(it, c), "cluster long, dim long, s long, n long")
        totals = parts.groupBy("cluster", "dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
        centroids = centroids.copy()
        for r in totals.collect():  # k x dim rows
            centroids[r.cluster, r.dim] = int(r.s) // r.n
    found = blocks.select("ids", "low", "high", "matrix").mapInArrow(lambda it: _assign(it, centroids), f"id {kind}, cluster int, distance long")
    found = durable(found)
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(exact.alias("s")).collect()}  # k rows
    fits = lambda n: n if n < 1 << 63 else None
    whole_sum = sum(sums.values())
    lines = [(c, fits(sums.get(c, 0)), fits(whole_sum), centroids[c].tolist()) for c in range(len(centroids))]
    about = spark.createDataFrame(lines, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return found.join(F.broadcast(about), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")  # k rows
