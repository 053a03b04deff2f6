"""Exact substring removal by super-k-mer partitioning.

A window is WINDOW consecutive words; its minimiser is the least hash among its runs of MINIMISER words. Consecutive
windows with the same minimiser form a super-k-mer, which travels to the minimiser's bucket as one packed string
instead of a string for each window. There the windows are sorted, equal ones counted and compared byte by byte, and
all but the first occurrence of a window are marked.

A minimiser that occurs once in the corpus has no repeated windows, so only places are sent around first; strings are
packed for the super-k-mers whose minimiser occurs again. A bucket of more than HOT super-k-mers (a licence in every
file, say) is not one sort: each of its windows goes by the 128-bit hash of its bytes, the first place of each is an
aggregate that combines before it travels, and the windows are joined to these places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, _powers, batches, checkpoint, content_key, documents, flat_bytes, mix, ragged, release, separators, span_hashes, word_bounds

WINDOW, MINIMISER = 50, 8
#: Whole buckets of about this many bytes are sorted together.
SORT_BYTES = 1 << 20
#: A minimiser's super-k-mers are sorted as strings up to so many; beyond, their windows go by hash.
HOT = 20_000
#: A minimiser is the least of (34 bits of a hash, place in 30 bits): equal hashes go to the leftmost, alike in equal windows.
_PLACE = U64((1 << 30) - 1)


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    up, down = _powers.get(len(words) + 1)
    total = np.zeros(len(words) + 1, U64)
    np.cumsum(words * up[:-1], out=total[1:])
    return mix((total[k:] - total[: len(total) - k]) * down[: len(total) - k])


def super_kmers(words: np.ndarray, edges: np.ndarray, window: int = WINDOW, m: int = MINIMISER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser hash, text, first window, number of windows) of all super-k-mers of the texts."""
    n = np.diff(edges)
    count = np.maximum(n - window + 1, 0)
    at = ragged(edges[:-1], count)
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    gram = rolling(words, m)
    least = (gram & ~_PLACE) | np.arange(len(gram), dtype=U64)
    reach, width = window - m + 1, 1
    while 2 * width <= reach:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < reach:
        least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
    place = (least[at] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (np.diff(at) > 1)]))
    text = np.repeat(np.arange(len(n)), count)[first]
    return gram[place[first]].view(np.int64), text, at[first] - edges[text], np.diff(np.append(first, len(at)))


def places(table: DataFrame, window: int, m: int) -> DataFrame:
    """(mh, key, doc_id, start, n): the super-k-mers of a table (key, doc_id, text), without their strings."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, "text"):
            flat, offs = flat_bytes(batch.column("text"))
            starts, ends, edges = word_bounds(flat, offs, separators(False))
            mh, text, start, n = super_kmers(span_hashes(flat, starts, ends), edges, window, m)
            at = pa.array(text)
            yield pa.RecordBatch.from_arrays([pa.array(mh), batch.column("key").take(at), batch.column("doc_id").take(at), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], names=["mh", "key", "doc_id", "start", "n"])

    return table.select("key", "doc_id", "text").mapInArrow(run, "mh bigint, key bigint, doc_id bigint, start int, n int")


def _spaced(texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts with one space between words; where their bytes have moved; starts and ends of the words before, edges of the texts."""
    flat, offs = flat_bytes(texts)
    sep = separators(False)
    starts, ends, edges = word_bounds(flat, offs, sep)
    inside = ~sep[flat]
    # one separator after each word stays; a text's last word may have none
    gap = np.zeros(len(flat), bool)
    tail = ends[(ends < len(flat))]
    gap[tail[sep[flat[tail]]]] = True
    keep = inside | gap
    return np.where(inside, flat, 32)[keep].tobytes(), np.concatenate([[0], np.cumsum(keep)]), starts, ends, edges


def _parts(batch: pa.RecordBatch, edges: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of each super-k-mer of a batch: its row, minimiser, first window in the text and number of windows, and its first word."""
    parts = batch.column("parts")
    at = parts.offsets.to_numpy() - parts.offsets[0].as_py()
    values = parts.flatten()
    mh, start, n = (values.field(c) for c in ("mh", "start", "n"))
    text = np.repeat(np.arange(batch.num_rows), np.diff(at))
    s, k = start.to_numpy().astype(np.int64), n.to_numpy().astype(np.int64)
    return text, mh, s, k, edges[text] + s


def packed(rows: DataFrame, window: int) -> DataFrame:
    """(mh, key, doc_id, start, n, words): strings, one space between words, of the super-k-mers (array parts) of each row's text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["mh", "key", "doc_id", "start", "n", "words"]
        for batch in batches(it, "text"):
            clean, moved, starts, ends, edges = _spaced(batch.column("text"))
            text, mh, s, k, first = _parts(batch, edges)
            a, b = moved[starts[first]], moved[ends[first + k + window - 2]]
            strings = pa.array([clean[x:y] for x, y in zip(a.tolist(), b.tolist())], pa.binary())
            rows_at, start, n = pa.array(text), pa.array(s.astype(np.int32)), pa.array(k.astype(np.int32))
            for x in range(0, len(text), 20_000):
                y = slice(x, x + 20_000)
                yield pa.RecordBatch.from_arrays([mh[y], batch.column("key").take(rows_at[y]), batch.column("doc_id").take(rows_at[y]), start[y], n[y], strings[y]], names=names)

    return rows.select("key", "doc_id", "text", "parts").mapInArrow(run, "mh bigint, key bigint, doc_id bigint, start int, n int, words binary")


def windows(rows: DataFrame, window: int) -> DataFrame:
    """(w0, w1, key, doc_id, start): each window of the super-k-mers (array parts) of each row's text, by a 128-bit hash of its bytes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches(it, "text"):
            clean, moved, starts, ends, edges = _spaced(batch.column("text"))
            text, _, s, k, first = _parts(batch, edges)
            word, place, row = ragged(first, k), ragged(s, k).astype(np.int32), np.repeat(text, k)
            for x in range(0, len(word), 20_000):
                w = word[x : x + 20_000]
                a, b = moved[starts[w]].tolist(), moved[ends[w + window - 1]].tolist()
                h = np.frombuffer(b"".join(xxh3_128_digest(clean[i:j]) for i, j in zip(a, b)), np.int64).reshape(-1, 2)
                at = pa.array(row[x : x + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), batch.column("key").take(at), batch.column("doc_id").take(at), pa.array(place[x : x + 20_000])], names=["w0", "w1", "key", "doc_id", "start"])

    return rows.select("key", "doc_id", "text", "parts").mapInArrow(run, "w0 bigint, w1 bigint, key bigint, doc_id bigint, start int")


def marked_hot(spread: DataFrame) -> DataFrame:
    """(key, doc_id, start, n, first_id) of windows(): those that occurred before, one by one, as marked() has them in runs."""
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "start")
    firsts = spread.groupBy("w0", "w1").agg(F.min(place).alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    both = spread.join(firsts, ["w0", "w1"]).where(~place.eqNullSafe(F.col("first")))
    return both.select("key", "doc_id", "start", F.lit(1).alias("n"), F.col("first.doc_id").alias("first_id"))


def _once(table: pa.Table) -> pa.Table:
    """The table without rows that equal the one before in bucket, text, id and place."""
    n = table.num_rows
    same = np.ones(max(n - 1, 0), bool)
    for name in ("mh", "key", "start"):
        c = table.column(name).to_numpy()
        same &= c[1:] == c[:-1]
    if not same.any():
        return table
    ids = table.column("doc_id").to_pylist()
    keep = np.ones(n, bool)
    keep[1:] = ~(same & np.array([a == b for a, b in zip(ids, ids[1:])], bool))
    return table.filter(pa.array(keep))


def repeats(batch: pa.Table, window: int) -> list[np.ndarray]:
    """Runs of windows that aren't the first of their kind: (row, first window in the row, windows, row of the first occurrence).

    Rows hold whole buckets in the order of their documents. The same window of a repeated row isn't another occurrence.
    """
    flat, offs = flat_bytes(batch.column("words").combine_chunks().cast(pa.large_binary()).view(pa.large_string()))
    n = batch.column("n").to_numpy().astype(np.int64)
    starts, ends, edges = word_bounds(flat, offs, separators(False))
    words = span_hashes(flat, starts, ends)
    at = ragged(edges[:-1], n)
    row = np.repeat(np.arange(len(n)), n)
    value = rolling(words, window)[at] ^ mix(batch.column("mh").to_numpy().view(U64))[row]
    order = np.argsort(value, kind="stable")
    s = value[order]
    begin = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    head = np.empty(len(s), np.int64)
    head[order] = np.repeat(order[begin], np.diff(np.append(begin, len(s))))
    later = np.flatnonzero(head != np.arange(len(s)))
    if not len(later):
        return [np.empty(0, np.int64)] * 4
    # windows in a row whose first occurrences are in a row, too
    cut = (np.diff(later) > 1) | (np.diff(head[later]) != 1) | (np.diff(row[later]) != 0) | (np.diff(row[head[later]]) != 0)
    a = np.concatenate([[0], np.flatnonzero(cut) + 1])
    count = np.diff(np.append(a, len(later)))
    mine, theirs = later[a], head[later[a]]
    # byte by byte, one long comparison for each run
    left, right = starts[at[mine]], starts[at[theirs]]
    size, size2 = ends[at[mine] + count + window - 2] - left, ends[at[theirs] + count + window - 2] - right
    same = size == size2
    raw = flat.tobytes()
    for i in np.flatnonzero(same):
        same[i] = raw[left[i] : left[i] + size[i]] == raw[right[i] : right[i] + size[i]]
    if not same.all():
        return _carefully(raw, starts, ends, at, row, order, begin, window)
    first_of_row = np.cumsum(n) - n
    return [row[mine], mine - first_of_row[row[mine]], count, row[theirs]]


def _carefully(raw: bytes, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, row: np.ndarray, order: np.ndarray, begin: np.ndarray, window: int) -> list[np.ndarray]:
    """As repeats(), window by window: for the case that different windows share a hash."""
    out, first_of_row = [], {}
    for i, r in enumerate(row):
        first_of_row.setdefault(r, i)
    for a, b in zip(begin, np.append(begin[1:], len(order))):
        seen: dict[bytes, int] = {}
        for i in order[a:b]:
            text = raw[starts[at[i]] : ends[at[i] + window - 1]]
            if text in seen:
                out.append((row[i], i - first_of_row[row[i]], 1, row[seen[text]]))
            else:
                seen[text] = i
    return [np.array(c, np.int64) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 4


def marked(strings: DataFrame, window: int) -> DataFrame:
    """(key, doc_id, start, n, first_id): the runs of windows that occurred before, in the order of (doc_id, key, start)."""
    # a bucket's rows come together, in the order of the documents; repeated rows lie side by side and are taken once
    spread = strings.repartition("mh").sortWithinPartitions("mh", F.col("doc_id").asc_nulls_last(), "key", "start")
    names = ["key", "doc_id", "start", "n", "first_id"]

    def found(table: pa.Table) -> pa.RecordBatch:
        table = _once(table)
        row, first, n, head = repeats(table, window)
        at = pa.array(row)
        start = table.column("start").to_numpy()[row] + first if len(row) else np.empty(0)
        return pa.RecordBatch.from_arrays(
            [table.column("key").take(at).combine_chunks(), table.column("doc_id").take(at).combine_chunks(), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), table.column("doc_id").take(pa.array(head)).combine_chunks()], names=names
        )

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in it:
            held.append(batch)
            size += batch.nbytes
            if size < SORT_BYTES:
                continue
            table = pa.Table.from_batches(held)
            mh = table.column("mh").to_numpy()
            whole = int(np.searchsorted(mh, mh[-1]))  # the last bucket may go on
            if not whole:
                continue
            at = 0
            while at < whole:
                # whole buckets of about SORT_BYTES
                stop = min(whole, at + max(1, int(len(mh) * SORT_BYTES / size)))
                stop = int(np.searchsorted(mh, mh[stop - 1], side="right"))
                yield found(table.slice(at, stop - at))
                at = stop
            rest = table.slice(whole).combine_chunks()
            held = [b for b in pa.Table.from_arrays([pa.concat_arrays(c.chunks) for c in rest.columns], names=rest.column_names).to_batches()]
            size = sum(b.nbytes for b in held)
            del table, rest, batch
            release()
        if held:
            yield found(pa.Table.from_batches(held))

    return spread.mapInArrow(run, "key bigint, doc_id bigint, start int, n int, first_id bigint")


def repeated_spans(docs: DataFrame, window: int = WINDOW, m: int = MINIMISER, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(key, doc_id, spans): for each document with such words, its sorted spans (start, n, first_id) of words seen before.

    A document is a text with an id; repeated rows are one document. The order is that of the ids, null last, then of
    the text's key, then of the words. The spans don't depend on `hot`.
    """
    table = docs.select(content_key(F.col(text_col)).alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    spots = places(table, window, m)
    again = spots.withColumn("c", F.count("*").over(Window.partitionBy("mh"))).where("c > 1")
    parts = again.groupBy("key", "doc_id").agg(F.collect_set(F.struct("mh", "start", "n", (F.col("c") > hot).alias("hot"))).alias("parts"))
    parts = checkpoint(parts.select(F.col("key").alias("pk"), F.col("doc_id").alias("pd"), "parts"))

    def of(chosen) -> DataFrame:
        """The texts that have such super-k-mers, and these."""
        some = parts.withColumn("parts", F.filter("parts", chosen)).where(F.size("parts") > 0)
        return table.join(some.hint("shuffle_hash"), (table["key"] == some["pk"]) & table["doc_id"].eqNullSafe(some["pd"]))

    runs = marked(packed(of(lambda p: ~p["hot"]), window), window)
    if not parts.where(F.exists("parts", lambda p: p["hot"])).isEmpty():
        runs = runs.unionByName(marked_hot(windows(of(lambda p: p["hot"]), window)))
    runs = checkpoint(runs)

    def merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            merged = []
            for spans in batch.column("runs").to_pylist():
                out: list[dict] = []
                for r in spans:
                    n = r["n"] + window - 1
                    if out and out[-1]["first_id"] == r["first_id"] and r["start"] <= out[-1]["start"] + out[-1]["n"] - window + 1:
                        out[-1]["n"] = max(out[-1]["n"], r["start"] + n - out[-1]["start"])
                    else:
                        out.append({"start": r["start"], "n": n, "first_id": r["first_id"]})
                merged.append(out)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("first_id", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), pa.array(merged, kind)], names=["key", "doc_id", "spans"])

    grouped = runs.groupBy("key", "doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "n", "first_id"))).alias("runs"))
    return grouped.mapInArrow(merge, "key bigint, doc_id bigint, spans array<struct<start: int, n: int, first_id: bigint>>")


def substring_duplicates(docs: DataFrame, window: int = WINDOW, m: int = MINIMISER, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """Rows (doc_id, start_word, n_words, first_doc_id): each longest stretch of words, all of whose windows occur before it.

    Words are parted by ASCII white space and compared byte by byte. Texts of fewer than `window` words and null texts
    have no windows; a document may repeat itself (first_doc_id is its own id); repeated rows are one document and give
    each stretch once; null ids come last. An empty table gives no rows; a long text is taken whole. Ids must be whole
    numbers of 64 bits (other ids raise). Other columns are not read.
    """
    spans = repeated_spans(docs, window, m, id_col, text_col, hot)
    return spans.select("doc_id", F.inline("spans")).select("doc_id", F.col("start").alias("start_word"), F.col("n").alias("n_words"), F.col("first_id").alias("first_doc_id"))


def without_repeats(docs: DataFrame, window: int = WINDOW, m: int = MINIMISER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the words of substring_duplicates() taken out of their texts, together with the white space after them.

    All rows stay, null texts and repeated rows as well, a text may become empty; a column n_chars holding the length of
    the text follows it. Columns as they were; an empty table stays empty.
    """
    spans = checkpoint(repeated_spans(docs, window, m, id_col, text_col))
    inner = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    text, ident = f"c{docs.columns.index(text_col)}", f"c{docs.columns.index(id_col)}"
    spans = spans.select(F.col("key").alias("sk"), F.col("doc_id").alias("sd"), F.transform("spans", lambda s: F.struct(s["start"], s["n"])).alias("spans"))
    same = (content_key(F.col(text)) == F.col("sk")) & F.col(ident).cast("long").eqNullSafe(F.col("sd"))
    both = inner.join(spans.hint("shuffle_hash"), same, "left").drop("sk", "sd")
    schema, names = inner.schema, inner.columns
    at = names.index(text)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sep = separators(False)
        for batch in it:
            spans_at = batch.schema.get_field_index("spans")
            texts = batch.column(at)
            hit = np.flatnonzero(batch.column(spans_at).is_valid().to_numpy(zero_copy_only=False))
            if len(hit):
                new = texts.to_pylist()
                for i in hit:
                    flat, offs = flat_bytes(texts.slice(i, 1))
                    starts, _, _ = word_bounds(flat, offs, sep)
                    edges, gone = np.append(starts, len(flat)), np.zeros(len(flat) + 1, np.int64)
                    for s in batch.column(spans_at)[i].as_py():
                        gone[edges[s["start"]]] += 1
                        gone[edges[s["start"] + s["n"]]] -= 1
                    new[i] = flat[np.cumsum(gone)[:-1] == 0].tobytes().decode("utf-8")
                texts = pa.array(new, pa.string())
            columns = list(batch.columns)
            columns[at] = texts
            columns.pop(spans_at)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = both.mapInArrow(run, schema).toDF(*docs.columns)
    if "n_chars" in docs.columns and text_col != "n_chars":
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_chars") == F.length(text_col), F.col("n_chars")).otherwise(F.length(text_col)).cast(kind))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_duplicates(documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeats(docs)
