"""Near-duplicate removal by Order MinHash.

A sketch has HASHES values. For each, the LABELS smallest k-mers of a text under one hash function are taken, repeated
k-mers told apart by their occurrence number, and hashed in the order in which they stand in the text: two texts agree
in a value with a probability that follows their edit similarity, not only their common k-mers. Texts that agree in
any value are candidates; banded alignment of their words verifies them, and connected verified pairs form the groups.

Candidates of a bucket are not compared all with all at once. First each is aligned with the bucket's first text, and
groups are formed; then only texts of one bucket that are still in different groups are compared, pair by pair. The
groups are those that comparing all pairs would give.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import alignment
from .common import U64, batches, checkpoint, content_key, documents, flat_bytes, fresh, mix, separators, span_hashes, word_bounds

K, LABELS, HASHES, SIMILARITY = 3, 2, 32, 0.75
#: Size of the k-mers (K at most) and the fewest words of a text that has such a sketch. It reaches up to the longest text near one that
#: hasn't the next sketch, so that two texts near each other share a kind. Shorter k-mers find pairs that longer ones miss in short texts.
BANDS = ((1, 1), (2, 32), (3, 256))
#: Word classes of a profile.
PROFILE = 256
#: Texts of a bucket that are compared in one place; more are a grid of such blocks.
BLOCK = 4096
_TOP = U64(0xFFFFFFFFFFFFFFFF)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (lower case, parted by white space and ASCII marks) and each text's n+1 offsets."""
    import pyarrow.compute as pc

    flat, offs = flat_bytes(pc.utf8_lower(texts.cast(pa.large_string())))
    starts, ends, edges = word_bounds(flat, offs, separators(True))
    return span_hashes(flat, starts, ends), edges


def sketch(words: np.ndarray, edges: np.ndarray, k: int = K, hashes: int = HASHES) -> np.ndarray:
    """The Order MinHash values (texts x hashes) of texts with at least one word; a text of fewer than k words is one k-mer."""
    n = np.diff(edges)
    count = np.maximum(n - k + 1, 1)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    at = np.repeat(edges[:-1] - first, count) + np.arange(int(count.sum()))
    short = np.repeat(n, count)
    gram = np.zeros(len(at), U64)
    for j in range(k):
        here = np.minimum(at + j, len(words) - 1)
        gram = np.where(j < short, mix(gram + words[here] + U64(j + 1)), gram)
    # occurrence numbers: equal k-mers of a text in the order of the text
    text = np.repeat(np.arange(len(n)), count)
    keyed = gram ^ mix(text.astype(U64) + U64(0x51ED27))
    order = np.argsort(keyed, kind="stable")
    s = keyed[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    begin = np.flatnonzero(new)
    nth = np.arange(len(s)) - np.repeat(begin, np.diff(np.append(begin, len(s))))
    label = np.empty(len(s), U64)
    label[order] = nth.astype(U64)
    x = mix(gram + label * U64(0x9E3779B97F4A7C15))
    out = np.empty((len(n), hashes), np.int64)
    rng = np.random.default_rng(20240607)
    seeds = rng.integers(1, 1 << 63, size=(hashes, 2), dtype=np.uint64)
    for j in range(hashes):
        h = (x ^ seeds[j, 0]) * (seeds[j, 1] | U64(1))
        h ^= h >> U64(32)
        places = []
        for _ in range(LABELS):
            least = np.minimum.reduceat(h, first)
            hit = np.flatnonzero(h == np.repeat(least, count))
            one = np.searchsorted(hit, first)  # the first of equal minima
            place = hit[one]
            places.append(np.where(least == _TOP, -1, place))
            h[place] = _TOP
        ordered = np.sort(np.stack(places), axis=0)
        value = np.full(len(n), U64(j + 1))
        for place in ordered:
            value = np.where(place >= 0, mix(value * U64(31) + gram[np.maximum(place, 0)]), value)
        out[:, j] = value.view(np.int64)
    return out


def sketches(docs: DataFrame, text: str, similarity: float = SIMILARITY, k: int = K, hashes: int = HASHES) -> DataFrame:
    """(key, doc_id, n_bytes, n_words, sketch) of a table (key, doc_id, text); the sketch of a text without words is null.

    A text has a sketch for each of BANDS that it falls into, one after another.
    """
    tops = [int(least / similarity) for _, least in BANDS[1:]]
    bands = [(min(k, size), least, top) for (size, least), top in zip(BANDS, [*tops, 1 << 62])]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, text):
            column = batch.column(text)
            words, edges = words_of(column)
            n = np.diff(edges)
            values, owner = [], []
            for size, least, top in bands:
                chosen = (n >= least) & (n <= top)
                at = np.flatnonzero(chosen)
                if len(at):
                    own = np.repeat(chosen, n)
                    found = sketch(words[own], np.concatenate([[0], np.cumsum(n[at])]), size, hashes)
                    values.append(mix(found.view(U64) ^ U64(size)).view(np.int64).ravel())
                    owner.append(np.repeat(at, hashes))
            owner, values = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (owner, values))
            order = np.argsort(owner, kind="stable")
            null = np.append(n == 0, False)
            offsets = np.searchsorted(owner[order], np.arange(len(n) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets, mask=null if null.any() else None), pa.array(values[order]))
            bytes_ = np.diff(flat_bytes(column)[1])
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), pa.array(bytes_), pa.array(n.astype(np.int32)), lists], names=["key", "doc_id", "n_bytes", "n_words", "sketch"])

    return docs.select("key", "doc_id", text).mapInArrow(run, "key bigint, doc_id bigint, n_bytes bigint, n_words int, sketch array<bigint>")


def packed_words(docs: DataFrame) -> DataFrame:
    """(key, size, profile, words) of a table (key, text): the 32-bit word hashes one after another, their number, and
    how many of them fall into each of PROFILE classes (255 at most)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, "text"):
            words, edges = words_of(batch.column("text"))
            raw = (words >> U64(32)).astype(np.uint32).tobytes()
            packed = pa.array([raw[4 * a : 4 * b] for a, b in zip(edges, edges[1:])], pa.binary())
            row = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
            classes = np.bincount(row * PROFILE + (words % U64(PROFILE)).astype(np.int64), minlength=(len(edges) - 1) * PROFILE)
            flat = np.minimum(classes, 255).astype(np.uint8).reshape(-1, PROFILE)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(np.diff(edges).astype(np.int32)), pa.array([r.tobytes() for r in flat], pa.binary()), packed], names=["key", "size", "profile", "words"])

    return docs.mapInArrow(run, "key bigint, size int, profile binary, words binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), PROFILE).astype(np.int16)


def allowed(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """The most edits that texts of n and m words may be apart."""
    return np.floor((1 - similarity) * np.maximum(n, m) + 1e-9).astype(np.int64)


def possible(p: np.ndarray, q: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Whether the profiles allow for so few edits: an edit moves one word out of a class and one into a class at most."""
    d = p - q
    return np.maximum(np.maximum(d, 0).sum(-1), np.maximum(-d, 0).sum(-1)) <= limits


def hopeful(pairs: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose lengths and profiles don't rule out the similarity."""
    side = lambda c: words.select(F.col("key").alias(c), F.col("size").alias(f"n{c}"), F.col("profile").alias(f"p{c}"))
    shorter, longer = F.least("na", "nb"), F.greatest("na", "nb")
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(longer - shorter <= (1 - similarity) * longer + 1e-9)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            good = pa.array(possible(_matrix(batch.column("pa")), _matrix(batch.column("pb")), allowed(na, nb, similarity)))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], names=["a", "b"])

    return both.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(run, "a bigint, b bigint")


def across(members: DataFrame, words: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """The hopeful pairs (a, b) of each bucket whose keys have different roots and aren't the lead.

    members: (bucket, key, lead, root). Texts near each other have sizes of one class or of neighbouring ones (a class
    ends where its smallest size becomes too small), so a bucket falls into cells of two classes each, and a cell of
    many texts into a grid of blocks. Each part of the grid is compared where its rows lie together; only pairs that
    pass leave it. However many texts share a bucket, a process holds two blocks.
    """
    width = max(-math.log(similarity), 1e-6) * (1 + 1e-9)
    level = F.floor(F.log("size") / width)
    # a text is in the cell of its own class (up), and in that of the class above
    sizes = words.select("key", "size")
    both = members.where("key <> lead").join(sizes, "key").select("bucket", "key", "root", F.inline(F.array(F.struct(level.alias("cell"), F.lit(True).alias("up")), F.struct((level + 1).alias("cell"), F.lit(False).alias("up")))))
    counts = both.groupBy("bucket", "cell").agg(F.count("*").alias("c"), F.count_if("up").alias("u"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("u > 0 and lo < hi")
    placed = both.join(counts.select("bucket", "cell", F.ceil(F.col("c") / block).cast("int").alias("blocks")), ["bucket", "cell"])
    own = F.pmod(F.xxhash64("key"), "blocks").cast("int")
    placed = placed.select("bucket", "cell", "key", "root", "up", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    placed = placed.select("bucket", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "root", "up")
    full = placed.join(words.select("key", "size", "profile"), "key")
    spread = full.repartition("bucket", "cell", "i", "j").sortWithinPartitions("bucket", "cell", "i", "j", "size", "key")

    def pairs_of(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        key, root, size, own = (table.column(c).to_numpy() for c in ("key", "root", "size", "own"))
        up, profile = table.column("up").combine_chunks().to_numpy(zero_copy_only=False), _matrix(table.column("profile"))
        coarse = profile.reshape(len(key), PROFILE // 16, 16).sum(2)  # fewer classes rule out most of what more would
        cross = table.column("i")[0].as_py() != table.column("j")[0].as_py()
        least = np.ceil(similarity * size - 1e-9)  # rows are sorted by size: partners of a row lie before it
        for i in range(len(key)):
            lo = int(np.searchsorted(size, least[i]))
            wanted = root[lo:i] != root[i]
            if not up[i]:
                wanted &= up[lo:i]
            if cross:
                wanted &= own[lo:i] != own[i]
            at = np.flatnonzero(wanted) + lo
            for x in range(0, len(at), 4096):
                near = at[x : x + 4096]
                for p in (coarse, profile):
                    near = near[possible(p[near], p[i], allowed(size[near], size[i], similarity))]
                if len(near):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(key[near], key[i])), pa.array(np.maximum(key[near], key[i]))], names=["a", "b"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in it:
            part = np.stack([batch.column(c).to_numpy() for c in ("bucket", "cell", "i", "j")], 1)
            cuts = np.flatnonzero((part[1:] != part[:-1]).any(1)) + 1
            for a, b in zip(np.append(0, cuts), np.append(cuts, len(part))):
                if a == b:
                    continue
                if held and (part[a] != now).any():
                    yield from pairs_of(held)
                    held = []
                now = part[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from pairs_of(held)

    return spread.mapInArrow(run, "a bigint, b bigint").distinct()


def verified(pairs: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose word sequences have an edit similarity 1 - distance / longer length of at least `similarity`."""
    left, right = words.select(F.col("key").alias("a"), F.col("words").alias("wa")), words.select(F.col("key").alias("b"), F.col("words").alias("wb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "wa", "wb")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            n, at = batch.num_rows, 0
            size = np.array([x.as_buffer().size + y.as_buffer().size for x, y in zip(batch.column("wa"), batch.column("wb"))], np.int64)
            while at < n:
                stop = max(at + 1, at + int(np.searchsorted(np.cumsum(size[at:]), 4 << 20)))
                part = batch.slice(at, stop - at)
                arrays = [[np.frombuffer(x.as_buffer(), np.uint32) for x in part.column(c)] for c in ("wa", "wb")]
                limits = allowed(*(np.array([len(x) for x in side]) for side in arrays), similarity)
                good = pa.array(alignment.within(list(zip(*arrays)), limits) >= 0)
                yield pa.RecordBatch.from_arrays([part.column("a").filter(good), part.column("b").filter(good)], names=["a", "b"])
                at = stop

    return both.mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(key, root): the smallest key of each key's component, for the keys of the edges (a, b). Large-star, small-star rounds.

    Every round is written to the shared folder; the number of rounds follows the logarithm of the component sizes.
    """
    now = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        # large star: neighbours greater than a node go to its smallest neighbour
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: smaller neighbours and the node itself go to the smallest
        low = large.where("b < a").distinct()
        m = low.groupBy("a").agg(F.min("b").alias("m"))
        small = low.join(m, "a")
        new = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(m.select("a", F.col("m").alias("b"))).distinct()
        new = checkpoint(new)
        same = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first() == new.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        now = new
        if same:
            return now.select(F.col("a").alias("key"), F.col("b").alias("root"))


def rooted(keys: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """keys with a column root: that of the column `key`, or the key itself where it has none."""
    return keys.join(roots.withColumnRenamed("key", key), key, "left").withColumn("root", F.coalesce("root", key))


def groups(docs: DataFrame, similarity: float = SIMILARITY, k: int = K, hashes: int = HASHES, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(key, n_bytes, first_id, group_id, root, n, n_first): each distinct text, the smallest id of its rows and of its group.

    key and n_bytes are content_key and size of the text; root names the group. n counts the rows with that text,
    n_first those of them with first_id.
    """
    table = docs.select(content_key(F.col(text_col)).alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    rows = sketches(table, "text", similarity, k, hashes)
    # both steps on one shuffle: rows of a text with the same id, then the text
    same = rows.repartition("key", "n_bytes").groupBy("key", "n_bytes", "doc_id").agg(F.first("sketch").alias("sketch"), F.count("*").alias("c"))
    first = F.coalesce(F.min_by("c", "doc_id"), F.max("c")).alias("n_first")
    texts = checkpoint(same.groupBy("key", "n_bytes").agg(F.min("doc_id").alias("first_id"), F.first("sketch").alias("sketch"), F.sum("c").alias("n"), first))
    entries = texts.where("sketch is not null").select("key", F.explode("sketch").alias("bucket")).select("bucket", "key").distinct()
    window = Window.partitionBy("bucket")
    shared = entries.withColumn("lead", F.min("key").over(window)).withColumn("size", F.count("*").over(window)).where("size > 1").drop("size")
    shared = checkpoint(shared)
    candidates = texts.select("key", F.col("first_id").alias("doc_id")).join(shared.select("key").distinct(), "key", "left_semi")
    same_row = (table["key"] == candidates["key"]) & table["doc_id"].eqNullSafe(candidates["doc_id"])
    firsts = table.join(candidates.hint("shuffle_hash"), same_row, "left_semi")
    words = packed_words(firsts.select("key", "text")).groupBy("key").agg(*(F.first(c).alias(c) for c in ("size", "profile", "words")))
    words = checkpoint(words)  # of candidates alone, 4 bytes a word
    star = shared.where("key <> lead").select(F.col("lead").alias("a"), F.col("key").alias("b")).distinct()
    edges = checkpoint(verified(hopeful(star, words, similarity), words, similarity))
    roots = components(edges)
    # texts of a bucket that are in different groups still; buckets with the same texts once
    rest = rooted(shared, roots, "key")
    same_set = [F.bit_xor(F.xxhash64(F.lit(i), "key")).alias(f"x{i}") for i in (1, 2)]
    mixed = rest.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c"), *same_set).where("lo < hi and c > 2")
    rest = rest.join(mixed.dropDuplicates(["c", "x1", "x2"]).select("bucket"), "bucket")
    more = checkpoint(verified(across(rest, words, similarity, block), words, similarity))
    if not more.isEmpty():
        roots = components(edges.unionByName(more))
    out = rooted(texts.select("key", "n_bytes", "first_id", "n", "n_first"), roots, "key")
    return out.withColumn("group_id", F.min("first_id").over(Window.partitionBy("root"))).select("key", "n_bytes", "first_id", "group_id", "root", "n", "n_first")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, k: int = K, hashes: int = HASHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, group_id, keep), one for each row of docs: group_id is the smallest id of the row's group.

    Equal texts are one group, also empty texts; texts without words join no other group. A null text is in no group:
    its group_id is its own id. keep is true for rows with the group's smallest id, for repeated such rows (equal id)
    for all of them here; keep_one() keeps one. A null id counts as larger than any other; a group of null ids alone has a
    null group_id, and its rows are kept. An empty table gives no rows; a long text is taken whole. Ids must be whole
    numbers of 64 bits (other ids raise). Other columns are not read.
    """
    found = groups(docs, similarity, k, hashes, id_col, text_col)
    rows = docs.select(content_key(F.col(text_col)).alias("key"), F.octet_length(text_col).cast("long").alias("n_bytes"), F.col(id_col).cast("long").alias("doc_id"))
    out = rows.join(found.select("key", "n_bytes", "group_id"), ["key", "n_bytes"], "left")
    group = F.when(F.col("n_bytes").isNull(), F.col("doc_id")).otherwise(F.col("group_id"))
    return out.select("doc_id", group.alias("group_id")).withColumn("keep", F.col("doc_id").eqNullSafe(F.col("group_id")))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, k: int = K, hashes: int = HASHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose group has a row that comes before: smallest id first, among equal ids the smallest text key.

    Exactly one row of each group stays, also of repeated rows; rows with a null text all stay. Columns as they were.
    """
    found = groups(docs, similarity, k, hashes, id_col, text_col)
    key, size, row, chosen, many = fresh(docs, "_key", "_bytes", "_row", "_chosen", "_many")
    # of each group the one text that stays; only texts with some other row in their group are looked at further
    order = Window.partitionBy("root").orderBy(F.col("first_id").asc_nulls_last(), "key", "n_bytes")
    texts = found.withColumn("place", F.row_number().over(order)).where("place > 1 or n > 1")
    texts = texts.select(F.col("key").alias(key), F.col("n_bytes").alias(size), (F.col("place") == 1).alias(chosen), F.col("first_id").alias(row), (F.col("n_first") > 1).alias(many))
    texts = checkpoint(texts)
    named = docs.withColumn(key, content_key(F.col(f"`{text_col}`"))).withColumn(size, F.octet_length(F.col(f"`{text_col}`")).cast("long"))
    marked = named.join(texts.hint("shuffle_hash"), [key, size], "left")
    same_id = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(row))
    stays = marked.where(F.col(chosen).isNull() | (F.col(chosen) & same_id))
    own = [F.col(f"`{c}`") for c in docs.columns]
    if texts.where(F.col(many) & F.col(chosen)).isEmpty():
        return stays.select(*own)
    # rows repeated with id and text: the first by their other columns
    simple = [F.col(f"`{f.name}`") for f in docs.schema if f.name != text_col and f.dataType.typeName() not in ("map", "variant", "calendarinterval")]
    one = Window.partitionBy(key, size).orderBy(*simple)
    again = stays.where(F.col(many)).withColumn(row, F.row_number().over(one)).where(F.col(row) == 1)
    return stays.where(F.col(many).isNull() | ~F.col(many)).select(*own).unionByName(again.select(*own))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)
