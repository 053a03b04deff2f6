"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of TABLES tables hashes a vector to a bucket by HASHES Gaussian projections, shifted and cut into cells of WIDTH.
A query visits in every table its own bucket and those reached by perturbing cells, in the order of the estimated
success: the sum of the squared distances from its projections to the borders crossed. Queries meet a bucket's members
at the bucket, where exact distances are computed by blocks; a task sends on the K best of each of its queries alone,
and the tables' candidates are merged and ranked by exact distance.

A bucket of many members or visitors is a grid of blocks of both, each cell of which is met on its own, so what a
process holds doesn't follow the number of vectors.

The parameters hold recall for any number of vectors. The work is vectors x members of a bucket x probes, and a bucket
holds a fixed share of the vectors: for clustered vectors raise `hashes`, and `probes` with it. Where the tenth
neighbour is hardly nearer than any other vector, no hashing helps: a projection to 16 dimensions still puts over a
third of all vectors as near as nine tenths of the true neighbours are.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, checkpoint, mix

K, TABLES, HASHES, WIDTH, PROBES = 10, 3, 4, 2.0, 16
#: Cells of a distance block.
BLOCK = 1 << 20
#: Members and visitors of a bucket that meet in one place; a bucket with more of either is cut by the hash of the id.
MEETING = 1 << 16
#: Candidates that a task holds before it merges them, and sends them on where that frees less than half.
HELD = 1 << 20
#: So many large buckets are sent to all executors (24 bytes each); more are joined.
LARGE = 100_000


@lru_cache(maxsize=4)
def family(dim: int, tables: int, hashes: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Projections (dim x tables*hashes) and shifts. Vectors of length about 1 have projections of about standard deviation 1."""
    rng = np.random.default_rng([dim, tables, hashes])
    return rng.standard_normal((dim, tables * hashes)), rng.uniform(0, width, tables * hashes)


@lru_cache(maxsize=4)
def perturbations(hashes: int) -> np.ndarray:
    """All vectors of -1, 0, 1."""
    return np.array(list(itertools.product((0, -1, 1), repeat=hashes)), np.int64)


def cells(x: np.ndarray, tables: int, hashes: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Cells and places within them, both (vectors x tables x hashes)."""
    a, b = family(x.shape[1], tables, hashes, width)
    p = ((x.astype(np.float64) @ a + b) / width).reshape(len(x), tables, hashes)
    cell = np.floor(p)
    return cell.astype(np.int64), p - cell


def bucket(cell: np.ndarray) -> np.ndarray:
    """One hash of the last axis."""
    out = np.zeros(cell.shape[:-1], U64)
    for j in range(cell.shape[-1]):
        out = mix(out * U64(31) + cell[..., j].view(U64) + U64(j + 1))
    return out.view(np.int64)


def probes_of(cell: np.ndarray, place: np.ndarray, probes: int) -> np.ndarray:
    """Buckets (vectors x tables x probes) by estimated success, the own one first."""
    steps = perturbations(cell.shape[-1])
    cost_down, cost_up = place**2, (1 - place) ** 2
    score = cost_down @ (steps == -1).T.astype(float) + cost_up @ (steps == 1).T.astype(float)
    best = np.argsort(score, axis=-1, kind="stable")[..., : min(probes, len(steps))]
    return bucket(cell[..., None, :] + steps[best])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), dim)


def nearest(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, squared distance) of the k nearest others of each query, ties by id; equal distances have equal values."""
    rows, ids, dist = [], [], []
    step = max(1, BLOCK // max(len(x), 1))
    xx = (x * x).sum(1)
    for a in range(0, len(q), step):
        part = q[a : a + step]
        d = xx - 2 * part @ x.T
        d[q_ids[a : a + step, None] == x_ids[None]] = np.inf
        near = min(len(x), 2 * k + 8)  # the block's rounding may swap neighbours: rank more of them exactly
        best = np.argpartition(d, near - 1, axis=1)[:, :near] if near < len(x) else np.broadcast_to(np.arange(len(x)), d.shape)
        exact = ((part[:, None].astype(np.float64) - x[best]) ** 2).sum(2)
        exact[np.isinf(np.take_along_axis(d, best, 1))] = np.inf
        order = np.lexsort((x_ids[best], exact), axis=1)[:, :k]
        exact = np.take_along_axis(exact, order, 1)
        found = np.isfinite(exact)
        rows.append(np.nonzero(found)[0] + a)
        ids.append(x_ids[np.take_along_axis(best, order, 1)][found])
        dist.append(exact[found])
    return np.concatenate(rows), np.concatenate(ids), np.concatenate(dist)


def best_of(q: np.ndarray, d: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k least distinct (distance, id) of each query, in order, and their ranks from 0."""
    order = np.lexsort((n, d, q))
    q, d, n = q[order], d[order], n[order]
    if len(q):
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (d[1:] != d[:-1]) | (n[1:] != n[:-1])
        q, d, n = q[new], d[new], n[new]
    begin = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.empty(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q))))
    keep = rank < k
    return q[keep], d[keep], n[keep], rank[keep]


_PAIR = np.dtype([("d", "<f8"), ("n", "<i8")])


def _packed(q: np.ndarray, d: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """(id, best): the (distance, id) pairs of each query as bytes; equal queries lie together."""
    pairs = np.empty(len(q), _PAIR)
    pairs["d"], pairs["n"] = d, n
    begin = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.empty(0, np.int64)
    offsets = (np.append(begin, len(q)) * _PAIR.itemsize).astype(np.int32)
    best = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(pairs.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(q[begin]), best], names=["id", "best"])


def _meet(it: Iterator[pa.RecordBatch], dim: int, k: int) -> Iterator[pa.RecordBatch]:
    """Rows come by cell, its members before its visitors."""
    now, members, matrix, found, held = None, [], None, [], 0
    for batch in it:
        cell = np.stack([batch.column(c).to_numpy() for c in ("bucket", "i", "j", "side")], 1)
        cuts = np.flatnonzero((cell[1:] != cell[:-1]).any(1)) + 1
        for a, b in zip(np.append(0, cuts), np.append(cuts, len(cell))):
            part, side = batch.slice(a, b - a), cell[a, 3]
            if now is None or (cell[a, :3] != now).any():
                now, members, matrix = cell[a, :3], [], None
            ids, x = part.column("id").to_numpy(), _matrix(part.column("v"), dim)
            if side == 0:
                members.append((ids, x))
                continue
            if not members:
                continue
            if matrix is None:
                matrix = [np.concatenate(c) for c in zip(*members)]
            row, near, dist = nearest(x, ids, matrix[1], matrix[0], k)
            found.append((ids[row], dist, near))
            held += len(row)
            if held >= HELD:
                merged = best_of(*(np.concatenate(c) for c in zip(*found)), k)[:3]
                found, held = [merged], len(merged[0])
                if held >= HELD // 2:
                    yield _packed(*merged)
                    found, held = [], 0
    if found:
        yield _packed(*best_of(*(np.concatenate(c) for c in zip(*found)), k)[:3])


def _merge(it: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, rank, neighbour_id, distance) of rows (id, best), which come by id."""
    rest: list[tuple[np.ndarray, ...]] = []

    def out(q: np.ndarray, d: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        q, d, n, rank = best_of(q, d, n, k)
        return pa.RecordBatch.from_arrays([pa.array(q), pa.array((rank + 1).astype(np.int32)), pa.array(n), pa.array(np.sqrt(d))], names=["vec_id", "rank", "neighbour_id", "distance"])

    for batch in it:
        raw = batch.column("best").to_pylist()
        pairs = np.frombuffer(b"".join(raw), _PAIR)
        q = np.repeat(batch.column("id").to_numpy(), np.array([len(r) for r in raw]) // _PAIR.itemsize)
        parts = [np.concatenate(c) for c in zip(*rest, (q, pairs["d"], pairs["n"]))]
        if not len(parts[0]):
            continue
        whole = int(np.searchsorted(parts[0], parts[0][-1]))  # the last one may go on
        if whole:
            yield out(*(c[:whole] for c in parts))
        rest = [tuple(c[whole:] for c in parts)]
    if rest:
        yield out(*rest[0])


def neighbours(vectors: DataFrame, k: int = K, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, probes: int = PROBES, id_col: str = "vec_id", vector_col: str = "embedding", meeting: int = MEETING) -> DataFrame:
    """Rows (vec_id, rank, neighbour_id, distance): for each vector its k nearest others found, rank from 1, Euclidean distance.

    Every vector is a query. Left out are null ids, null or empty vectors, such with null or NaN elements, and those of
    another dimension than most have. Rows repeated with id and vector count once; an id with several
    vectors has the nearest to any of them, itself left out; a neighbour with several vectors may come several times. Ties go to the smaller id. Fewer than k rows come out where
    the probed buckets hold fewer vectors; an empty table gives no rows. Ids must be whole numbers of 64 bits (other
    ids raise). Other columns are not read.
    """
    v = F.col(vector_col).cast("array<float>")
    clean = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and size(v) > 0").where(~F.exists("v", lambda e: e.isNull() | F.isnan(e)))
    most = clean.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = most["d"] if most else 1
    clean = clean.where(F.size("v") == dim).dropDuplicates()

    def spread(with_vectors: bool):
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                for at in range(0, batch.num_rows, 2048):
                    part = batch.slice(at, 2048)
                    x = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(part.num_rows, dim)
                    cell, place = cells(x, tables, hashes, width)
                    keys = np.concatenate([bucket(cell)[..., None], probes_of(cell, place, probes)], 2)  # the own bucket as a member, and those visited
                    each = keys[0].size
                    table = np.tile(np.repeat(np.arange(tables), each // tables), len(x))
                    side = np.tile(np.arange(each // tables) > 0, len(x) * tables).astype(np.int32)
                    bucket_key = mix(keys.ravel().view(U64) + table.astype(U64)).view(np.int64)
                    own = pa.array(np.repeat(np.arange(len(x)), each))
                    columns = [pa.array(bucket_key), pa.array(side), part.column("id").take(own)]
                    if with_vectors:
                        columns.append(pa.array([r.tobytes() for r in x], pa.binary()).take(own))
                    yield pa.RecordBatch.from_arrays(columns, names=["bucket", "side", "id", "v"][: len(columns)])

        return run

    schema = "bucket bigint, side int, id bigint"
    both = clean.mapInArrow(spread(True), f"{schema}, v binary")
    blocks = lambda c: F.ceil(F.col(c) / meeting).cast("int")
    sizes = clean.mapInArrow(spread(False), schema).groupBy("bucket").agg(F.count_if(F.col("side") == 0).alias("m"), F.count_if(F.col("side") == 1).alias("q"))
    large = checkpoint(sizes.where((F.col("m") > meeting) | (F.col("q") > meeting)).select("bucket", blocks("m").alias("m"), blocks("q").alias("q")))
    if n := large.count():
        both = both.join(F.broadcast(large) if n <= LARGE else large, "bucket", "left")
        own = lambda c: F.pmod(F.xxhash64("id"), F.coalesce(c, F.lit(1))).cast("int")
        all_of = lambda c: F.sequence(F.lit(0), F.greatest(F.coalesce(c, F.lit(1)), F.lit(1)) - 1)
        member = F.col("side") == 0
        both = both.where("m is null or m > 0").withColumn("i", F.explode(F.when(member, F.array(own("m"))).otherwise(all_of("m"))))
        both = both.withColumn("j", F.explode(F.when(member, all_of("q")).otherwise(F.array(own("q"))))).select("bucket", "i", "j", "side", "id", "v")
    else:
        both = both.select("bucket", F.lit(0).alias("i"), F.lit(0).alias("j"), "side", "id", "v")
    met = both.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side").mapInArrow(lambda it: _meet(it, dim, k), "id bigint, best binary")
    return met.repartition("id").sortWithinPartitions("id").mapInArrow(lambda it: _merge(it, k), "vec_id bigint, rank int, neighbour_id bigint, distance double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
