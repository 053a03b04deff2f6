"""Best-fit packing by exact-complement hashing.

Sequences are packed into bins of `capacity` tokens. Only the histogram of lengths, at most `capacity` rows whatever
the number of documents, reaches the driver. There single, pair and triple sums of the lengths that remain are indexed to fill a gap exactly, under availability counts; what has no exact complement goes best-fit into the open bins.
The driver's plan is a list of patterns (lengths of one bin, number of such bins). Documents then take their places by
their rank among the documents of their length, in two counted steps, so no length, however frequent, is one task.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vocab
from .common import checkpoint, documents
from .eliasfano import VOCABULARY

CAPACITY = 2048
#: Ranks are counted in slices of the pieces, of about so many pieces of a length that is alone in the table.
SLICE_ROWS = 250_000


class _Sums:
    """Lengths still available, and an index of the sums of one, two and three of them.

    For each sum the index names the largest length of a pair, and of a triple, that add up to it, as they were when
    it was last looked up; lengths only become fewer, so a sum without an entry never gets one again. An entry whose
    lengths have run out is made anew when it is met.
    """

    def __init__(self, counts: np.ndarray) -> None:
        self.counts, n = counts, len(counts)
        self.pairs, self.triples = np.zeros(n, np.int32), np.zeros(n, np.int32)
        there = np.flatnonzero(counts)
        for x in there:  # rising, so that the largest stays
            small = there[(there <= x) & (there < n - x)]
            if len(small) and small[-1] == x and counts[x] < 2:
                small = small[:-1]
            self.pairs[x + small] = x
        sums = np.flatnonzero(self.pairs)
        for x in there:
            # of three, x is the largest; whether the pair may take x again is asked when the sum is looked up
            rest = sums[(sums < n - x) & (sums <= 2 * x)]
            self.triples[x + rest] = x

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if 0 < gap < len(self.counts) and self.counts[gap] > 0 else None

    def _best(self, gap: int, top: int) -> int:
        """The larger length, `top` at most, of the pair for gap whose larger length is largest; 0 if there is none."""
        large = np.arange(min(gap - 1, top, len(self.counts) - 1), (gap - 1) // 2, -1)
        small = gap - large
        live = (self.counts[large] > 0) & (self.counts[small] > 0) & ((large != small) | (self.counts[large] > 1))
        at = int(live.argmax()) if len(live) else 0
        return int(large[at]) if len(live) and live[at] else 0

    def pair(self, gap: int) -> tuple[int, ...] | None:
        if gap < 2 or not self.pairs[gap]:
            return None
        x = int(self.pairs[gap])
        if not (self.counts[x] > (2 * x == gap) and self.counts[gap - x] > 0):
            self.pairs[gap] = x = self._best(gap, x)
        return (x, gap - x) if x else None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        """The triple whose largest length is largest, then whose second is."""
        if gap < 3 or not self.triples[gap]:
            return None
        first = np.arange(int(self.triples[gap]), (gap - 1) // 3, -1)
        for x in first[(self.counts[first] > 0) & (self.pairs[gap - first] > 0)].tolist():
            rest = self.pair(gap - x)
            if not rest:
                continue
            # a pair with a length above x would have been met with that length as first; only x itself may be short
            need = 1 + (rest[0] == x) + (rest[1] == x)
            if rest[0] > x or self.counts[x] < need:
                self.counts[x] -= 1
                y = self._best(gap - x, x)
                self.counts[x] += 1
                rest = (y, gap - x - y) if y else None
            if rest:
                self.triples[gap] = x
                return (x, *rest)
        self.triples[gap] = 0
        return None


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, number of bins) that hold every length of the histogram as often as it says.

    Longest lengths first. A bin's gap is filled by one, two or three lengths that add up to it exactly, as many bins
    at once as the counts allow. Lengths without exact complement are packed afterwards, longest first, each into the
    open bin with the smallest gap that takes it (best fit), again as many at once as there are such bins.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is outside 1..{capacity}")
        counts[length] = n
    out: list[tuple[tuple[int, ...], int]] = []
    sums, left = _Sums(counts), []
    if counts[capacity]:
        out.append(((capacity,), int(counts[capacity])))
        counts[capacity] = 0
    for length in range(capacity - 1, 0, -1):
        while counts[length]:
            gap = capacity - length
            counts[length] -= 1
            rest = sums.single(gap) or sums.pair(gap) or sums.triple(gap)
            counts[length] += 1
            if not rest:
                left.append((length, int(counts[length])))
                counts[length] = 0
                break
            pattern = (length, *rest)
            need = defaultdict(int)
            for x in pattern:
                need[x] += 1
            times = min(int(counts[x]) // n for x, n in need.items())
            for x, n in need.items():
                counts[x] -= n * times
            out.append((pattern, times))
    # residuals: gap -> {pattern: bins}, best fit by bisection over the gaps that occur
    gaps: list[int] = []
    open_bins: dict[int, dict[tuple[int, ...], int]] = {}

    def put(pattern: tuple[int, ...], n: int) -> None:
        gap = capacity - sum(pattern)
        if not gap:
            out.append((pattern, n))
            return
        if gap not in open_bins:
            bisect.insort(gaps, gap)
            open_bins[gap] = {}
        open_bins[gap][pattern] = open_bins[gap].get(pattern, 0) + n

    for length, n in left:
        while n:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):
                fit = capacity // length  # new bins: n of this length alone, as full as they go
                if n >= fit:
                    put((length,) * fit, n // fit)
                if n % fit:
                    put((length,) * (n % fit), 1)
                break
            gap = gaps[at]
            pattern, bins = next(iter(open_bins[gap].items()))
            take = min(n, bins)
            if take == bins:
                del open_bins[gap][pattern]
                if not open_bins[gap]:
                    del open_bins[gap]
                    gaps.pop(at)
            else:
                open_bins[gap][pattern] = bins - take
            put((*pattern, length), take)
            n -= take
    for group in open_bins.values():
        out.extend(group.items())
    return out


def word_length(text: Column) -> Column:
    """Words of a text and one end-of-document token; a null text has none of either."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(r"\S+")) + 1)


def token_length(text: Column, vocabulary: str = VOCABULARY, folder: str = vocab.TOKENIZERS) -> Column:
    """Ids that a text has in the vocabulary and one end-of-document token; a null text has none of either."""

    @F.pandas_udf("long")
    def length(texts: pd.Series) -> pd.Series:
        enc = vocab.encoding(vocabulary, folder)
        return pd.Series([0 if t is None else len(enc.encode_to_numpy(t, disallowed_special=())) + 1 for t in texts], dtype="int64")

    return length.asNondeterministic()(text)  # else a filter on it encodes every text twice


def pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None) -> DataFrame:
    """Rows (bin_id, slot, start, doc_id, piece, n_tokens): which piece of which document lies where in which bin.

    length: tokens of a document (default: words and an end mark). A document longer than the capacity is cut into
    full pieces and a rest. Documents of length 0 or null take no place (a null text; an empty text has its end mark).
    A null id is a document like any other; repeated rows are packed as often as they occur; ties in length are taken
    in the order of (slice by hash, id, piece). An empty table gives no rows. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    n = F.coalesce((word_length(F.col(text_col)) if length is None else length).cast("long"), F.lit(0))
    lengths = docs.select(F.col(id_col).alias("doc_id"), n.alias("n")).where("n > 0")
    pieces = lengths.select(
        "doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), ((F.col("n") - 1) / capacity).cast("int")), lambda i: F.least(F.lit(capacity), F.col("n") - i * capacity).cast("int"))).alias("piece", "n_tokens")
    )
    pieces = checkpoint(pieces)
    slices = pieces.count() // SLICE_ROWS + 1
    pieces = pieces.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slices)).cast("int"))
    sliced = pieces.groupBy("n_tokens", "slice").agg(F.count("*").alias("c"))
    sliced = checkpoint(sliced)  # at most capacity x slices rows
    histogram = {int(r["n_tokens"]): int(r["c"]) for r in sliced.groupBy("n_tokens").agg(F.sum("c").alias("c")).toLocalIterator()}
    places, bins, used = [], 0, defaultdict(int)
    for pattern, times in plan_bins(histogram, capacity):
        start = 0
        for slot, x in enumerate(pattern):
            # the ranks of length x from `used` take slot `slot` of bins from `bins`
            places.append((x, used[x], times, bins, slot, start))
            used[x] += times
            start += x
        bins += times
    schema = "n_tokens int, first long, times long, bin long, slot int, start int"
    plan = spark.createDataFrame(places, schema)  # a row for each slot of each pattern: bounded by the capacity
    by_length = Window.partitionBy("n_tokens").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sliced.withColumn("offset", F.coalesce(F.sum("c").over(by_length), F.lit(0))).drop("c")
    # A piece's rank is its slice's offset and its rank in the slice; the places of a slice are those its ranks meet.
    rank = F.row_number().over(Window.partitionBy("n_tokens", "slice").orderBy("doc_id", "piece")) - 1
    ranked = pieces.withColumn("rank", rank).join(offsets, ["n_tokens", "slice"]).withColumn("rank", F.col("rank") + F.col("offset"))
    steps = plan.groupBy("n_tokens").agg(F.array_sort(F.collect_list(F.struct("first", "times", "bin", "slot", "start"))).alias("places"))
    counted = sliced.join(offsets, ["n_tokens", "slice"]).join(steps, "n_tokens")
    lo, hi = F.col("offset"), F.col("offset") + F.col("c")
    mine = counted.select("n_tokens", "slice", F.explode(F.filter("places", lambda p: (p["first"] < hi) & (p["first"] + p["times"] > lo))).alias("p"))
    mine = mine.groupBy("n_tokens", "slice").agg(F.array_sort(F.collect_list("p")).alias("places"))
    found = ranked.join(mine, ["n_tokens", "slice"])
    at = F.element_at(F.filter("places", lambda p: (p["first"] <= F.col("rank")) & (F.col("rank") < p["first"] + p["times"])), 1)
    placed = found.select("doc_id", "piece", "n_tokens", "rank", at.alias("p"))
    return placed.select(
        (F.col("p.bin") + F.col("rank") - F.col("p.first")).alias("bin_id"), F.col("p.slot").alias("slot"), F.col("p.start").alias("start"), "doc_id", "piece", "n_tokens"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), length=token_length(F.col("text")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """In words, unlike the query: test_pipeline_stages holds the pipeline's pieces to them."""
    return pack(docs)
