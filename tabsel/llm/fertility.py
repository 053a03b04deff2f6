"""Quality rules from tokeniser fertility.

Public vocabularies measure each whole document: characters per token and the entropy of its tokens (a byte-level
vocabulary for many languages), and the share of its characters that a vocabulary with byte fallback must spell as
bytes. Each language (where it is null, each script) has rejection bands of its own. Their middles and widths are
robust statistics over all documents of that language: a middle is a median, for the entropy a line through the
medians by length, as entropy falls short of its most the more, the longer a text; a half width is `spread` median
absolute deviations, counted in units of sampling error (1 / sqrt(tokens)), and a small documented floor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vocab
from .common import checkpoint, documents, fresh, text_slices

MULTI, FALLBACK = "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"
SPREAD = 5.0
#: Least half width of each band.
FLOOR = {"chars_per_token": 0.04, "fallback_share": 0.02, "entropy_gap": 0.05}
METRICS = tuple(FLOOR)
#: Documents with fewer tokens say nothing about the middle or the width of a band; they are judged all the same.
LEAST_TOKENS = 16
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Han", "Hiragana", "Hangul", "Thai")


def measure(text: str, folder: str) -> tuple[int, float, float, float]:
    """Tokens, characters per token, share of visible characters in byte fallback, entropy gap.

    The entropy gap is 1 - H / log2(n): 0 if all n tokens differ, 1 if all are the same, 0 for a single token.
    """
    ids = vocab.encoding(MULTI, folder).encode_to_numpy(text, disallowed_special=())
    n = len(ids)
    if not n:
        return 0, 0.0, 0.0, 0.0
    s = np.sort(ids.astype(vocab.id_type(MULTI, folder)), kind="stable")  # a radix sort for two bytes
    runs = np.diff(np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]])))
    entropy = np.log2(n) - float(runs @ np.log2(runs)) / n
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    wide = codes[~((codes <= 32) | (codes == 127))]
    spelled = int((~vocab.covered_chars(FALLBACK, folder)[wide]).sum())
    return n, len(codes) / n, spelled / max(len(wide), 1), 1 - entropy / np.log2(n) if n > 1 else 0.0


def script(text: Column) -> Column:
    """The script with most letters in a text, the earlier of the list at a tie; 'none' without letters."""
    counts = [F.regexp_count(text, F.lit(r"\p{Is%s}" % s)) for s in SCRIPTS]
    most = F.greatest(*counts)
    out = F.lit("none")
    for name, c in reversed(list(zip(SCRIPTS, counts))):
        out = F.when((c == most) & (most > 0), F.lit(name)).otherwise(out)
    return out


def measured(docs: DataFrame, text_col: str, lang_col: str, folder: str) -> tuple[DataFrame, list[str]]:
    """docs with five columns more, and their names: band key, tokens, the three metrics."""
    names = fresh(docs, "band_key", "n_tokens", *METRICS)
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None).cast("string")
    key = F.coalesce(lang, F.concat(F.lit("script:"), F.coalesce(script(F.col(text_col)), F.lit("none"))))
    source = docs.withColumn(names[0], key)
    at = docs.columns.index(text_col)
    new = [T.StructField(names[1], T.LongType()), *(T.StructField(n, T.DoubleType()) for n in names[2:])]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for a, b in text_slices(batch.column(at)):
                part = batch.slice(a, b - a)
                rows = np.array([measure(t.as_py() or "", folder) for t in part.column(at)], np.float64).reshape(-1, 4)
                cols = [pa.array(rows[:, 0].astype(np.int64)), *(pa.array(rows[:, i]) for i in (1, 2, 3))]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], names=[*batch.schema.names, *names[1:]])

    return source.mapInArrow(run, T.StructType([*source.schema.fields, *new])), names


def medians(rows: DataFrame, groups: list[str], values: dict[str, Column], scale: int) -> list[dict]:
    """Lower medians of the values, to 1 / scale, by groups: the same for any partitioning.

    Counted in bins, so what moves follows the groups and the bins, not the documents.
    """
    long = rows.select(*groups, F.inline(F.array(*(F.struct(F.lit(m).alias("m"), F.round(c * scale).cast("long").alias("v")) for m, c in values.items()))))
    bins = long.groupBy(*groups, "m", "v").agg(F.count("*").alias("c"))
    upto = Window.partitionBy(*groups, "m").orderBy("v")
    bins = bins.withColumn("upto", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(Window.partitionBy(*groups, "m")))
    found = bins.where(2 * F.col("upto") >= F.col("n")).groupBy(*groups, "m").agg((F.min("v") / scale).alias("x"))
    return [r.asDict() for r in found.orderBy(*groups, "m").collect()]


def learn(rows: DataFrame, spread: float) -> dict[str, dict[str, tuple[float, float, float]]]:
    """band_key -> metric -> (middle, its slope by log2 of the tokens, half width times sqrt(tokens)), over all rows.

    Only sums for each language and power of two of the length reach the driver.
    """
    full = rows.where(F.col("n_tokens") >= LEAST_TOKENS)
    log = F.log2("n_tokens")
    full = full.withColumn("b", F.floor(log))
    # sums of rounded logarithms: whole numbers, so their order doesn't matter
    cells = [r.asDict() for r in full.groupBy("band_key", "b").agg(F.count("*").alias("n"), (F.sum(F.round(log * 1e6).cast("long")) / F.count("*") / 1e6).alias("x")).orderBy("band_key", "b").collect()]
    mid_of = {(r["band_key"], r["b"], r["m"]): r["x"] for r in medians(full, ["band_key", "b"], {m: F.col(m) for m in METRICS}, 1000)}
    mids: dict[str, dict[str, tuple[float, float]]] = {}
    for key in sorted({r["band_key"] for r in cells}):
        own = [r for r in cells if r["band_key"] == key]
        w, x = np.array([r["n"] for r in own], float), np.array([r["x"] for r in own])
        mids[key] = {}
        for m in METRICS:
            y = np.array([mid_of[key, r["b"], m] for r in own])
            if m == "entropy_gap" and len(own) > 1:
                mx, my = w @ x / w.sum(), w @ y / w.sum()
                slope = float((w * (x - mx)) @ (y - my) / ((w * (x - mx)) @ (x - mx)))
                mids[key][m] = (float(my - slope * mx), slope)
            else:
                order = np.argsort(y)  # median of the cells' medians, by their documents
                mids[key][m] = (float(y[order][np.searchsorted(np.cumsum(w[order]), w.sum() / 2)]), 0.0)
    if not mids:
        return {}
    z = {m: F.abs(F.col(m) - middle(mids, m)) * F.sqrt("n_tokens") for m in METRICS}
    dev = {(r["band_key"], r["m"]): r["x"] for r in medians(full, ["band_key"], z, 1000)}
    return {key: {m: (*mids[key][m], spread * dev[key, m]) for m in METRICS} for key in mids}


def by_key(table: dict, pick) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for k, v in table.items() for x in (k, float(pick(v))))), F.col("band_key"))


def middle(table: dict, m: str) -> Column:
    return by_key(table, lambda v: v[m][0]) + by_key(table, lambda v: v[m][1]) * F.log2(F.greatest("n_tokens", F.lit(1)))


def reason(table: dict) -> Column:
    """The first rule that a row breaks (no_tokens, or a metric and the side of its band), or null.

    A language with no document of LEAST_TOKENS tokens has no bands: only no_tokens is held against it.
    """
    out = F.lit(None).cast("string")
    for m in reversed(METRICS) if table else ():
        off = F.col(m) - middle(table, m)
        half = F.lit(FLOOR[m]) + by_key(table, lambda v: v[m][2]) / F.sqrt(F.greatest("n_tokens", F.lit(1)))
        if m == "chars_per_token":
            out = F.when(off < -half, F.lit(f"{m}_low")).otherwise(out)
        out = F.when(off > half, F.lit(f"{m}_high")).otherwise(out)
    return F.when(F.col("n_tokens") == 0, F.lit("no_tokens")).otherwise(out)


def quality(docs: DataFrame, spread: float = SPREAD, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folder: str = vocab.TOKENIZERS) -> DataFrame:
    """Rows (doc_id, band_key, n_tokens, chars_per_token, fallback_share, entropy_gap, reason, keep), one for each row of docs.

    A null or empty text has no tokens and is rejected for it. A null language is judged by its script. A null id is
    kept as null, repeated rows give repeated rows, other columns are not read.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (F.col(lang_col) if lang_col in docs.columns else F.lit(None).cast("string")).alias("lang"))
    rows, names = measured(narrow, "text", "lang", folder)
    rows = checkpoint(rows.select("doc_id", *names))
    table = learn(rows, spread)
    return rows.withColumn("reason", reason(table)).withColumn("keep", F.col("reason").isNull())


def keep_good(docs: DataFrame, spread: float = SPREAD, text_col: str = "text", lang_col: str = "lang", folder: str = vocab.TOKENIZERS) -> DataFrame:
    """The rows of docs that quality() keeps, with the columns they had.

    Documents are measured twice, for the bands and for the decision, which moves no text: joining decisions back to
    the documents would shuffle every text.
    """
    narrow = docs.select(F.col(text_col).alias("text"), (F.col(lang_col) if lang_col in docs.columns else F.lit(None).cast("string")).alias("lang"))
    rows, names = measured(narrow, "text", "lang", folder)
    table = learn(checkpoint(rows.select(*names)), spread)
    inner = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    lang = f"c{docs.columns.index(lang_col)}" if lang_col in docs.columns else "lang"
    full, _ = measured(inner, f"c{docs.columns.index(text_col)}", lang, folder)
    return full.where(reason(table).isNull()).select(*inner.columns).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)
