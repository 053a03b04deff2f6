"""Shapes that a large corpus brings: hot keys, long threads, full blocks; each against a second computation."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsel.llm import ann, eliasfano, packing, quotation, separator_scan, superkmer, vocab
from tabsel.llm import order_minhash as omh


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdeilnorstu"), rng.integers(2, 8))) for _ in range(n))


def test_separator_scan_of_many_separators_in_one_block(spark, tmp_path):
    rng = np.random.default_rng(1)
    ids = np.where(rng.random(1_000_000) < 0.5, 9, 1).astype(np.uint16)
    (tmp_path / "a.u16").write_bytes(ids.tobytes())
    started = time.monotonic()
    out = separator_scan.scan(spark, f"file://{tmp_path}", separator=9, block_tokens=1 << 21).toPandas().sort_values("ordinal")
    assert time.monotonic() - started < 60
    at = np.flatnonzero(ids == 9)
    starts = np.append(0, at + 1)
    lengths = np.append(at, len(ids)) - starts
    full = (lengths > 0) | (np.arange(len(starts)) < len(at))
    assert (out.start.to_numpy() == starts[full]).all() and (out.n_tokens.to_numpy() == lengths[full]).all() and out.ended.sum() == len(at)
    assert (out.ordinal.to_numpy() == np.arange(len(out))).all()


def test_separator_scan_in_four_bytes(spark, tmp_path):
    docs = spark.createDataFrame([(0, "a b c"), (1, None), (2, ""), (3, "d" * 300)], "doc_id int, text string").coalesce(1)
    separator_scan.write_tokens(docs, f"file://{tmp_path}/t", separator=70_000, width=4)
    out = separator_scan.scan(spark, f"file://{tmp_path}/t", separator=70_000, width=4, block_tokens=3)
    enc = vocab.encoding(separator_scan.VOCABULARY)
    assert sorted(r.n_tokens for r in out.collect()) == sorted([len(enc.encode("a b c")), 0, 0, len(enc.encode("d" * 300))])
    with pytest.raises(ValueError):
        separator_scan.write_tokens(docs, f"file://{tmp_path}/u", separator=70_000)
    with pytest.raises(ValueError):
        separator_scan.write_tokens(docs, f"file://{tmp_path}/u", separator=5)


def test_separator_scan_of_an_empty_folder(spark, tmp_path):
    assert separator_scan.scan(spark, f"file://{tmp_path}").count() == 0


def test_elias_fano_reader(spark):
    docs = spark.createDataFrame([(0, "a b c"), (None, None), (2, ""), (3, "d" * 300), (3, "d" * 300)], "doc_id int, text string")
    out = eliasfano.documents_of(eliasfano.segments(docs, segment_tokens=10)).collect()
    enc = vocab.encoding(eliasfano.VOCABULARY)
    assert sorted((r.doc_id is None, r.doc_id or 0, enc.decode(r.ids), r.n_tokens == len(r.ids)) for r in out) == [(False, 0, "a b c", True), (False, 2, "", True), (False, 3, "d" * 300, True), (False, 3, "d" * 300, True), (True, 0, "", True)]
    assert eliasfano.documents_of(eliasfano.segments(docs.limit(0))).count() == 0


def test_quotes_of_all_levels_and_wrapped_anew(spark):
    chat = [
        (1, 0, "u", "The first line\nand the second\n\nanother paragraph"), (1, 1, "a", "> The first line and\n> the second\nwrapped anew"), (1, 2, "u", ">> another paragraph\nonly the second level"),
        (1, 3, "a", "> wrapped anew\n>> The first line\n>> and the second\nboth"), (1, 4, "u", "> unknown\n>> wrapped anew\nouter level unknown"), (1, 5, "a", ">\n> \nempty quotes"),
    ]
    schema = "conv_id bigint, turn bigint, role string, text string"
    messages = spark.createDataFrame(chat, schema)
    out = {r.turn: r for r in quotation.link(messages).collect()}
    assert [out[t].reply_to for t in range(6)] == [None, 0, 0, 1, 1, None]
    assert [out[t].linked_lines for t in range(6)] == [0, 2, 1, 1, 1, 0] and [out[t].depth for t in range(6)] == [0, 1, 1, 2, 2, 0]
    assert [out[t].position for t in range(6)] == [1, 2, 5, 3, 4, 6]
    found = {(r.turn, r.quote_level): (r.source_turn, r.linked_lines) for r in quotation.links(messages).collect()}
    assert found == {(1, 1): (0, 2), (2, 2): (0, 1), (3, 1): (1, 1), (3, 2): (0, 2), (4, 2): (1, 1)}
    assert quotation.link(messages.limit(0)).count() == 0 and quotation.links(messages.limit(0)).count() == 0


@pytest.mark.parametrize("reply", [lambda i: i - 1, lambda i: 0, lambda i: i // 2])
def test_long_threads(spark, reply):
    n = 20_000
    rows = [(7, i, "u", (f"> message number {reply(i)}\n" if i else "") + f"message number {i}") for i in range(n)]
    messages = spark.createDataFrame(pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]))
    started = time.monotonic()
    out = quotation.link(messages).toPandas().sort_values("turn")
    assert time.monotonic() - started < 20
    assert (out.reply_to.to_numpy()[1:] == [reply(i) for i in range(1, n)]).all() and sorted(out.position) == list(range(1, n + 1))
    depth = [0]
    for i in range(1, n):
        depth.append(depth[reply(i)] + 1)
    assert out.depth.tolist() == depth
    place = out.position.to_numpy()
    assert all(place[i] > place[reply(i)] for i in range(1, n))


def test_a_very_long_message(spark):
    text = "\n".join(f"line {i} " + "x" * 50 for i in range(30_000))
    rows = [(1, 0, "u", text), (1, 1, "a", "\n".join(f"> {x}" for x in text.split("\n")) + "\nyes")]
    out = {r.turn: r for r in quotation.link(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert out[1].reply_to == 0 and out[1].linked_lines == 30_000 and out[1].text == "yes"


def test_neighbours_in_blocks_of_buckets(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").limit(400)
    key = lambda out: sorted(map(tuple, out.collect()))
    assert key(ann.neighbours(rows)) == key(ann.neighbours(rows, meeting=7))


def test_neighbours_merge_in_several_steps(monkeypatch):
    rng = np.random.default_rng(3)
    x, ids = rng.standard_normal((300, 8)).astype(np.float32), np.arange(300)
    import pyarrow as pa

    def batch(bucket, side, at):
        n = len(at)
        return pa.RecordBatch.from_arrays([pa.array([bucket] * n), pa.array([0] * n), pa.array([0] * n), pa.array([side] * n), pa.array(ids[at]), pa.array([r.tobytes() for r in x[at]], pa.binary())], names=["bucket", "i", "j", "side", "id", "v"])

    monkeypatch.setattr(ann, "HELD", 200)
    first, second = np.arange(0, 150), np.arange(150, 300)
    met = pa.Table.from_batches(ann._meet(iter([batch(1, 0, first), batch(1, 1, ids[:90]), batch(1, 1, ids[90:]), batch(2, 0, second[:70]), batch(2, 0, second[70:]), batch(2, 1, ids), batch(3, 1, ids)]), 8, 4)).sort_by("id")
    out = pa.Table.from_batches(ann._merge(iter(met.to_batches(max_chunksize=37)), 4)).to_pandas()
    for i in ids:
        d = ((x[i].astype(float) - x) ** 2).sum(1)
        d[i] = np.inf
        assert out[out.vec_id == i].sort_values("rank").neighbour_id.tolist() == np.argsort(d)[:4].tolist()


def test_probes_are_the_likeliest_cells_in_order():
    rng = np.random.default_rng(8)
    cell, place = ann.cells(rng.standard_normal((20, 8)).astype(np.float32), 2, 3, 1.0)
    found = ann.probes_of(cell, place, 10)
    import itertools

    for v in range(20):
        for t in range(2):
            cost = lambda step: sum(p**2 if s < 0 else (1 - p) ** 2 if s > 0 else 0 for s, p in zip(step, place[v, t]))
            order = sorted(itertools.product((-1, 0, 1), repeat=3), key=cost)[:10]
            assert [int(b) for b in found[v, t]] == [int(ann.bucket(cell[v, t] + np.array(s))) for s in order]


def naive_plan(histogram, capacity):
    """Exact complements by trying all combinations in the order of their lengths, then best fit, one sequence at a time."""
    from itertools import combinations_with_replacement

    left, bins, residual = dict(histogram), [], []
    for length in range(capacity, 0, -1):
        while left.get(length):
            left[length] -= 1
            gap, found = capacity - length, ()
            for size in (0, 1, 2, 3):
                options = [c for c in combinations_with_replacement(sorted((x for x, n in left.items() if n), reverse=True), size) if sum(c) == gap and all(left[x] >= c.count(x) for x in c)]
                if options and (gap or not size):
                    found = max(options)
                    break
            else:
                left[length] += 1
                residual += [length] * left[length]
                left[length] = 0
                break
            for x in found:
                left[x] -= 1
            bins.append((length, *found))
    space = []
    for x in residual:
        fits = [i for i, b in enumerate(space) if capacity - sum(b) >= x]
        if fits:
            i = min(fits, key=lambda i: (capacity - sum(space[i]), i))
            space[i] = (*space[i], x)
        else:
            space.append((x,))
    return bins, space


@pytest.mark.parametrize("seed", range(60))
def test_packing_plan_equals_the_naive_one(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(8, 33))
    lengths = rng.integers(1, capacity + 1, rng.integers(0, 40))
    histogram = {int(x): int(n) for x, n in zip(*np.unique(lengths, return_counts=True))}
    bins, space = naive_plan(histogram, capacity)
    plan = [(p, n) for p, n in packing.plan_bins(histogram, capacity)]
    exact = sorted(tuple(sorted(p)) for p, n in plan for _ in range(n) if sum(p) == capacity)
    assert sorted(tuple(sorted(b)) for b in [*bins, *(s for s in space if sum(s) == capacity)]) == exact
    assert sum(n for _, n in plan) == len(bins) + len(space)


@pytest.mark.parametrize("capacity", [2048, 32_768])
def test_packing_plans_large_capacities_in_seconds(capacity):
    rng = np.random.default_rng(capacity)
    lengths, n = np.unique(np.minimum(rng.lognormal(np.log(capacity / 8), 1.2, 400_000).astype(int) + 1, capacity), return_counts=True)
    started = time.monotonic()
    plan = packing.plan_bins(dict(zip(lengths.tolist(), n.tolist())), capacity)
    took = time.monotonic() - started
    used = np.zeros(capacity + 1, int)
    for pattern, times in plan:
        assert sum(pattern) <= capacity
        np.add.at(used, list(pattern), times)
    assert (used[lengths] == n).all() and used.sum() == n.sum() and took < 60


def test_packing_in_several_slices(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLICE_ROWS", 40)
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 90).cast("int")).alias("text"))
    out = packing.pack(docs, 64).toPandas()
    expected = sorted((i, p, min(64, i % 90 + 1 - 64 * p)) for i in range(300) for p in range(-(-(i % 90 + 1) // 64)))
    assert sorted(zip(out.doc_id, out.piece, out.n_tokens)) == expected
    ordered = out.sort_values(["bin_id", "slot"])
    assert (ordered.start == ordered.groupby("bin_id").n_tokens.cumsum() - ordered.n_tokens).all() and out.groupby("bin_id").n_tokens.sum().max() <= 64
    assert not out.duplicated(["bin_id", "slot"]).any() and sorted(out.bin_id.unique()) == list(range(out.bin_id.nunique()))


def crowd(spark, n, words=30):
    """n texts of a few own words around one passage, and some near copies among them."""
    passage = prose(4242, 100)
    rows = [(i, f"{prose(10_000 + i, words)} {passage} {prose(50_000 + i, words // 2)}") for i in range(n)]
    rows += [(n + i, rows[7 * i][1].replace(" ", "  ", 1).rsplit(" ", 1)[0] + " other") for i in range(n // 20)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["doc_id", "text"]))


def test_hot_minimisers_give_the_same_spans(spark):
    docs = crowd(spark, 200).unionByName(spark.createDataFrame([(None, prose(4242, 100)), (3, None), (5, "")], "doc_id bigint, text string"))
    docs = docs.unionByName(docs.where("doc_id in (5, 9)"))
    key = lambda hot: sorted(map(str, superkmer.substring_duplicates(docs, hot=hot).collect()))
    assert key(superkmer.HOT) == key(1) == key(20)


def test_one_passage_in_many_documents(spark):
    """As many buckets' rows as HOT allows and more, each window of the passage in all documents."""
    n = 25_000
    passage = prose(4242, 60)
    docs = spark.range(0, n, 1, 8).select(F.col("id").alias("doc_id"), F.concat(F.concat_ws(" ", *(F.md5(F.concat_ws(":", "id", F.lit(i))) for i in range(6))), F.lit(f" {passage} "), F.concat_ws(" ", *(F.md5(F.concat_ws("-", "id", F.lit(i))) for i in range(6)))).alias("text"))
    out = superkmer.substring_duplicates(docs)
    found = out.agg(F.count("*").alias("c"), F.min("doc_id").alias("lo"), F.min("start_word").alias("s"), F.max("start_word").alias("t"), F.min("n_words").alias("n"), F.max("n_words").alias("m"), F.max("first_doc_id").alias("f")).first()
    assert tuple(found) == (n - 1, 1, 6, 6, 60, 60, 0)


def test_spans_on_the_fixture_word_by_word(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    from test_operators import brute_spans

    expected = brute_spans(docs.collect())
    got = {k: np.zeros(len(g), int) for k, (_, g) in expected.items()}
    for r in superkmer.substring_duplicates(docs).collect():
        got[r.doc_id][r.start_word : r.start_word + r.n_words] = 1
    assert all((got[k] == g).all() for k, (_, g) in expected.items())


def test_near_duplicates_in_blocks_of_buckets(spark):
    docs = crowd(spark, 300, 60)
    key = lambda block: sorted((r.first_id, r.group_id) for r in omh.groups(docs, block=block).collect())
    found = key(omh.BLOCK)
    assert found == key(9) and sum(a != b for a, b in found) == 15


def test_sketch_by_the_definition():
    """The LABELS least occurrence-labelled k-mers under each hash, in the order of the text, hashed together."""
    import random

    import pyarrow as pa

    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdef") for _ in range(n)) for n in (1, 2, 3, 4, 9, 40, 41)]
    words, edges = omh.words_of(pa.array(texts))
    found = omh.sketch(words, edges, hashes=6)
    u = lambda x: np.array([x], np.uint64)
    seeds = np.random.default_rng(20240607).integers(1, 1 << 63, size=(6, 2), dtype=np.uint64)
    for t, (a, b) in enumerate(zip(edges, edges[1:])):
        own, kmers, seen = words[a:b], [], {}
        for i in range(max(len(own) - omh.K + 1, 1)):
            g = u(0)
            for j, w in enumerate(own[i : i + omh.K]):
                g = omh.mix(g + u(w) + u(j + 1))
            nth = seen.get(int(g[0]), 0)
            seen[int(g[0])] = nth + 1
            kmers.append((g, omh.mix(g + u(nth) * u(0x9E3779B97F4A7C15))))
        for h in range(6):
            ranked = []
            for i, (_, x) in enumerate(kmers):
                y = (x ^ u(seeds[h, 0])) * u(seeds[h, 1] | np.uint64(1))
                ranked.append((int((y ^ (y >> u(32)))[0]), i))
            value = u(h + 1)
            for i in sorted(i for _, i in sorted(ranked)[: omh.LABELS]):
                value = omh.mix(value * u(31) + kmers[i][0])
            assert found[t, h] == value.view(np.int64)[0]


def test_near_pairs_are_found_at_every_length(spark):
    """Pairs at the similarity's edge, by number of words: a tenth at most may be missed in any band."""
    rng, rows, pairs = np.random.default_rng(12), [], {}
    for n in (5, 8, 12, 20, 30, 33, 42, 45, 100, 300):
        for _ in range(40):
            words = prose(int(rng.integers(1 << 30)), n).split()
            words = [f"{w}{rng.integers(1000)}" for w in words]
            other = list(words)
            for at in rng.choice(n, n // 4, replace=False):
                other[at] = f"changed{rng.integers(1 << 30)}"
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
            pairs.setdefault(n, []).append((len(rows) - 2, len(rows) - 1))
    found = {r.doc_id: r.group_id for r in omh.near_duplicates(spark.createDataFrame(pd.DataFrame(rows, columns=["doc_id", "text"]))).collect()}
    for n, own in pairs.items():
        assert sum(found[a] == found[b] for a, b in own) >= 0.9 * len(own), n
    assert sum(len(p) for p in pairs.values()) + 0 <= len(set(found.values())) <= 1.1 * len(rows) / 2
