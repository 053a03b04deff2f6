"""Helpers shared by the corpus operators: row keys, checkpoints, vectorised text kernels."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Flat kernels work on slices of a batch of about this many bytes, so a worker's memory doesn't follow the batch.
SLICE_BYTES = 1 << 20
U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where that is unset on one machine (tests) a new one. On a cluster it must be set."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(configured)
        return configured
    set_dir = sc._jsc.sc().getCheckpointDir()
    if not set_dir.isDefined():
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tabsel-checkpoint-"))
        set_dir = sc._jsc.sc().getCheckpointDir()
    return set_dir.get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and cut its lineage. Only for narrow tables: the files are not compressed."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def content_key(text: Column) -> Column:
    """64-bit key of a text. Among N texts about N^2 / 2^65 pairs are expected to share one by chance."""
    return F.xxhash64(text)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened by underscores until no column of df has it (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser: a bijection of 64-bit words."""
    x = (x ^ (x >> U64(30))) * _MIX1
    x = (x ^ (x >> U64(27))) * _MIX2
    return x ^ (x >> U64(31))


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of about `limit` bytes; a row longer than that is a range of its own."""
    n = len(texts)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, a = np.cumsum(sizes), 0
    while a < n:
        b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, side="right"))
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, and n+1 offsets into it. A null is an empty text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    flat = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.empty(0, np.uint8)
    return flat, offs - offs[0]


@lru_cache(maxsize=2)
def separators(punctuation: bool) -> np.ndarray:
    """Which bytes part words: ASCII white space, and with `punctuation` all ASCII but letters and digits."""
    table = np.zeros(256, bool)
    table[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
    if punctuation:
        table[[b for b in range(128) if not chr(b).isalnum()]] = True
    return table


def word_bounds(flat: np.ndarray, offs: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the n+1 offsets of its words."""
    if not len(flat):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~sep[flat]
    edge = np.zeros(len(flat) + 1, bool)
    edge[offs] = True
    before = np.empty(len(flat), bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(flat), bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


class _Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, grown when needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 1 << 16)
            base, inverse = int(_BASE) | 1, pow(int(_BASE) | 1, -1, 1 << 64)
            self.up = np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, base, U64)]))
            self.down = np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, inverse, U64)]))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def span_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, whatever its place: differences of one running polynomial sum."""
    up, down = _powers.get(len(flat) + 1)
    total = np.zeros(len(flat) + 1, U64)
    terms = total[1:]  # in place: these are the largest arrays of a worker
    terms[:] = flat
    terms += U64(1)
    terms *= up[:-1]
    np.cumsum(terms, out=terms)
    return mix((total[ends] - total[starts]) * down[starts])


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges [starts[i], starts[i] + counts[i])."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    step = np.ones(total, np.int64)
    keep = counts > 0
    s, c = starts[keep].astype(np.int64), counts[keep].astype(np.int64)
    at = np.cumsum(c)[:-1]
    step[0] = s[0]
    step[at] = s[1:] - (s[:-1] + c[:-1] - 1)
    return np.cumsum(step)


@lru_cache(maxsize=1)
def _libc():
    import ctypes

    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library: nothing to give back
        return None


def release() -> None:
    """Give freed memory back to the system: reused workers would keep the most that any task before has used."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


def batches(it: Iterable[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The batches in slices of bounded bytes of their text column."""
    for batch in it:
        for a, b in text_slices(batch.column(text)):
            yield batch.slice(a, b - a)
        del batch
        release()
