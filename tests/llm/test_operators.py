"""Operators on small tables with everything that may go wrong in them, against brute force."""

import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsel.llm import ann, bpe, common, eliasfano, fertility, packing, quotation, separator_scan, superkmer, toxicity, vocab
from tabsel.llm import order_minhash as omh

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF = "/root/testdata/sf0.001"


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdeilnorstu"), rng.integers(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and very long texts, copies, repeated rows, a shared passage, and columns with clashing names."""
    passage = prose(99, 70)
    texts = [(i, prose(i, 80), "en") for i in range(12)]
    near = prose(3, 80).split()
    near[10], near[40] = "changed", "too"
    texts += [(20, prose(3, 80), "en"), (21, " ".join(near), "en"), (22, f"{prose(50, 30)} {passage} {prose(51, 30)}", "de"), (23, f"{prose(52, 40)} {passage}", "de"), (24, f"{passage} {prose(53, 20)}", None)]
    texts += [(30, None, "en"), (31, "", "en"), (31, "", "en"), (None, prose(60, 60), "fr"), (None, prose(60, 60), "fr"), (32, "   \n ", None), (33, prose(70, 20_000), "en"), (34, prose(71, 60), "xx"), (34, prose(71, 60), "xx"), (35, "one two", "en"), (36, "one two", "en")]
    rows = [(i, t, lang, "s", len(t) if t else 0) for i, t, lang in texts]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("key", "keep", "n_tokens", "score", "toxic", "band_key", "words", "root", "_key", "_row", "c0", "spans")}).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing(docs):
    out = packing.pack(docs, 128).toPandas()
    expected = Counter()
    for r in docs.collect():
        n = 0 if r.text is None else len(r.text.split()) + 1
        for i in range(0, n, 128):
            expected[(r.doc_id, i // 128, min(128, n - i))] += 1
    got = Counter((None if pd.isna(a) else int(a), int(b), int(c)) for a, b, c in zip(out.doc_id, out.piece, out.n_tokens))
    assert got == expected
    fill = out.sort_values(["bin_id", "slot"]).groupby("bin_id")
    assert fill.n_tokens.sum().max() <= 128 and (out.sort_values(["bin_id", "slot"]).start == fill.n_tokens.cumsum() - out.sort_values(["bin_id", "slot"]).n_tokens).all()
    assert sorted(out.bin_id.unique()) == list(range(out.bin_id.nunique()))


def test_packing_query_counts_tokens(spark):
    enc, expected = vocab.encoding(eliasfano.VOCABULARY), Counter()
    for r in common.documents(spark, SF).collect():
        n = 0 if r.text is None else len(enc.encode(r.text, disallowed_special=())) + 1
        for i in range(0, n, packing.CAPACITY):
            expected[(r.doc_id, i // packing.CAPACITY, min(packing.CAPACITY, n - i))] += 1
    out = packing.query(spark, SF).toPandas()
    assert Counter(zip(out.doc_id, out.piece, out.n_tokens)) == expected
    assert out.groupby("bin_id").n_tokens.sum().max() <= packing.CAPACITY


def test_packing_lengths_in_tokens(spark):
    rows = spark.createDataFrame([(0, None), (1, ""), (2, "日本語" * 50), (3, "<|endoftext|>")], "doc_id int, text string")
    found = {r.doc_id: r.n for r in rows.select("doc_id", packing.token_length(F.col("text")).alias("n")).collect()}
    assert found[0] == 0 and found[1] == 1 and found[2] > 50 and found[3] > 2


def test_packing_empty(empty):
    assert packing.pack(empty).count() == 0


def test_quality(docs):
    out = fertility.quality(docs).toPandas()
    assert len(out) == docs.count() and set(out[out.n_tokens == 0].reason) == {"no_tokens"}
    by = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    for r in out[out.doc_id.notna()].itertuples():
        n, chars, fallback, gap = fertility.measure(by[r.doc_id] or "", vocab.TOKENIZERS)
        assert (r.n_tokens, round(r.chars_per_token, 9), r.fallback_share, round(r.entropy_gap, 9)) == (n, round(chars, 9), fallback, round(gap, 9))
    assert out[(out.doc_id == 24)].band_key.item() == "script:Latin"
    kept = fertility.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == out.keep.sum()


def test_quality_rejects_what_is_unlike_its_language(spark):
    rows = [(i, prose(i, 200), "en", "s", 0) for i in range(60)] + [(100, "spam " * 300, "en", "s", 0), (101, "".join(chr(0x16A0 + i % 60) for i in range(600)), "en", "s", 0)]
    out = fertility.quality(spark.createDataFrame(rows, SCHEMA)).toPandas().set_index("doc_id")
    assert not out.keep[100] and not out.keep[101] and out.keep[list(range(60))].all()


def test_quality_empty(empty):
    assert fertility.quality(empty).count() == 0 and fertility.keep_good(empty).count() == 0


def labelled(spark):
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(200):
        words, toxic = prose(1000 + i, 40).split(), i % 4 == 0
        if toxic:
            words[int(rng.integers(1, 39))] = "grobian"
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    rows += [(300, f"{prose(1, 5)} gr0b1an {prose(2, 5)}", "en", "s", 0), (301, f"{prose(1, 5)} g r o b i a n {prose(2, 5)}", "en", "s", 0), (302, f"{prose(1, 5)} grobiaaan {prose(2, 5)}", "en", "s", 0), (303, prose(5, 20), "en", "s", 0), (304, None, "en", "s", 0), (None, "Grobian!", "en", "s", 0)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels + [(None, 1, 1), (1, None, None)], "doc_id bigint, quality int, toxic int")


def test_toxicity(spark):
    d, labels = labelled(spark)
    d = d.withColumn("restored", F.lit("clash")).withColumn("score", F.lit(0))
    lexicon, log_p, _ = toxicity.model(d, labels)
    assert set(lexicon) == {"grobian"}
    out = toxicity.toxicity(d, labels).toPandas()
    assert len(out) == d.count()
    hits = {None if pd.isna(i) else int(i) for i in out[out.toxic].doc_id}
    assert hits == {*range(0, 200, 4), 300, 301, 302, None}
    kept = toxicity.drop_toxic(d, labels)
    assert kept.columns == d.columns and kept.count() == d.count() - len(hits)
    # brute force: all stretches of up to seven tokens decoded, without the pattern
    rows = [r for r in d.collect() if r.text]
    for r in rows[::16] + rows[-5:]:
        tokens = r.text.lower().split()
        stretches = (" ".join(tokens[i : i + k]) for i in range(len(tokens)) for k in range(1, 8))
        assert any("grobian" in re.split("[^a-z]+", toxicity.decode(s, log_p)) for s in stretches) == (r.doc_id in hits)


def test_toxicity_counts_all_ngrams(spark):
    d, _ = labelled(spark)
    counts = toxicity.count_ngrams(d)
    brute = Counter()
    for r in d.collect():
        s = re.sub(r"[^a-z]+", "_", f"   {(r.text or '').lower()} ")
        brute.update(s[i : i + 4] for i in range(len(s) - 3))
    code = lambda g: sum((0 if c == "_" else ord(c) - 96) << 5 * (3 - i) for i, c in enumerate(g))
    assert all(counts[code(g)] == n for g, n in brute.items() if "_" not in g)


def test_toxicity_without_labels_or_rows(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert not toxicity.toxicity(docs, none).where("toxic").count() and toxicity.toxicity(empty, none).count() == 0


def test_near_duplicates(docs):
    out = omh.near_duplicates(docs).toPandas()
    group = {int(a): (None if pd.isna(b) else int(b)) for a, b in zip(out.doc_id, out.group_id) if not pd.isna(a)}
    assert len(out) == docs.count()
    assert {k for k, g in group.items() if g == 3} == {3, 20, 21} and group[36] == 35 and group[22] == 22 and group[23] == 23 and group[30] == 30
    one = omh.keep_one(docs)
    assert one.columns == docs.columns
    ids = Counter(None if r.doc_id is None else r.doc_id for r in one.collect())
    assert set(ids) == {*range(12), 22, 23, 24, 30, 31, 32, 33, 34, 35, None} and all(n == 1 for n in ids.values())


def test_near_duplicates_against_all_pairs(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r.doc_id: r.group_id for r in omh.near_duplicates(d).collect()}
    import pyarrow as pa

    from tabsel.llm import alignment

    pdf = d.toPandas()
    w, e = omh.words_of(pa.array(pdf.text))
    words = [(w[a:b] >> np.uint64(32)).astype(np.uint32) for a, b in zip(e, e[1:])]
    pairs = [(i, j) for i in range(len(pdf)) for j in range(i) if len(words[i]) and len(words[j])]
    limits = omh.allowed(np.array([len(words[i]) for i, _ in pairs]), np.array([len(words[j]) for _, j in pairs]), omh.SIMILARITY)
    near = [p for p, x in zip(pairs, alignment.within([(words[i], words[j]) for i, j in pairs], limits)) if x >= 0]
    hit = sum(found[pdf.doc_id[i]] == found[pdf.doc_id[j]] for i, j in near)
    assert hit >= 0.9 * len(near)
    # no group without a chain of true pairs
    root = list(range(len(pdf)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in near:
        root[top(i)] = top(j)
    same = {}
    for i, k in enumerate(pdf.doc_id):
        same.setdefault(found[k], set()).add(top(i) if len(words[i]) else -1)
    assert all(len(v) == 1 for v in same.values())


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2))]
    found = {r.key: r.root for r in omh.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    for x in root:
        assert found.get(x, x) == top(x)


def test_near_duplicates_empty(empty):
    assert omh.near_duplicates(empty).count() == 0 and omh.keep_one(empty).count() == 0


def brute_spans(rows, window=superkmer.WINDOW):
    """Words of each document covered by windows that occurred before, documents in order of id, null last."""
    seen, out = set(), {}
    for i, text in sorted({(r.doc_id, r.text) for r in rows if r.text is not None}, key=lambda x: (x[0] is None, x[0] or 0)):
        words = re.findall(r"[^\t\n\x0b\x0c\r\x1c-\x1f ]+", text)
        gone = np.zeros(len(words), int)
        for j in range(len(words) - window + 1):
            key = tuple(words[j : j + window])
            if key in seen:
                gone[j : j + window] = 1
            seen.add(key)
        out[i] = (words, gone)
    return out


def test_substring_removal(docs):
    rows = docs.collect()
    expected = brute_spans(rows)
    got = {k: np.zeros(len(g), int) for k, (_, g) in expected.items()}
    for r in superkmer.substring_duplicates(docs).collect():
        got[r.doc_id][r.start_word : r.start_word + r.n_words] = 1
        assert r.first_doc_id is not None or r.doc_id is None
    assert all((got[k] == g).all() for k, (_, g) in expected.items())
    out = superkmer.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    for r in out.collect():
        if r.text is not None:
            words, gone = expected[r.doc_id]
            assert r.text.split() == [w for w, g in zip(words, gone) if not g] and r.n_chars == len(r.text)


def test_substring_removal_on_the_fixture(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    expected = brute_spans(d.collect())
    removed = {k: g.sum() for k, (_, g) in expected.items()}
    got = Counter()
    for r in superkmer.substring_duplicates(d).collect():
        got[r.doc_id] += r.n_words
    assert {k for k, n in removed.items() if n} == set(got)


def test_substring_removal_empty(empty):
    assert superkmer.substring_duplicates(empty).count() == 0 and superkmer.without_repeats(empty).count() == 0


def test_bpe(docs):
    out = bpe.encode(docs).collect()
    assert len(out) == docs.count()
    public = vocab.encoding(bpe.VOCABULARY)
    texts = Counter((r.doc_id, r.text) for r in docs.collect())
    assert Counter((r.doc_id, None if r.ids is None else public.decode(r.ids)) for r in out) == texts
    assert all(r.round_trip if r.ids is not None else r.round_trip is None for r in out)
    assert all(r.ids == public.encode_ordinary(public.decode(r.ids)) for r in out if r.ids)
    back = bpe.decode(bpe.encode(docs).withColumn("text", F.lit("taken")))
    assert back.columns[-1] == "text_" and Counter((r.doc_id, r.text_) for r in back.collect()) == texts


def test_elias_fano(docs, empty):
    got = Counter()
    for r in eliasfano.segments(docs, segment_tokens=500).collect():
        ends, ids, a = eliasfano.decode_offsets(r.n_docs, r.low_bits, r.low, r.high), np.frombuffer(r.ids, np.uint16), 0
        assert len(ids) == r.n_tokens == (ends[-1] if r.n_docs else 0)
        for i, (k, b) in enumerate(zip(r.doc_ids, ends)):
            assert eliasfano.select(i, r.low_bits, r.low, r.high, r.samples) == b
            got[(k, vocab.encoding(eliasfano.VOCABULARY).decode(ids[a:b].tolist()))] += 1
            a = b
    assert got == Counter((r.doc_id, r.text or "") for r in docs.collect())
    assert eliasfano.segments(empty).count() == 0


def test_separator_scan_of_documents(spark, docs, tmp_path):
    separator_scan.write_tokens(docs, f"file://{tmp_path}/t")
    out = separator_scan.scan(spark, f"file://{tmp_path}/t", block_tokens=64).toPandas()
    enc = vocab.encoding(separator_scan.VOCABULARY)
    assert sorted(out.n_tokens) == sorted(len(enc.encode_ordinary(r.text or "")) for r in docs.collect()) and out.ended.all()


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_separator_scan_stitches_blocks(spark, tmp_path, block):
    streams = {"a.u16": [9, 9, 5, 1, 2, 3, 9, 4], "b.u16": [1] * 20, "c.u16": [], "d.u16": [9], "e.u16": [1] * 10 + [9] + [2] * 5 + [9]}
    (tmp_path / "f").mkdir()
    expected = []
    for name, ids in streams.items():
        (tmp_path / "f" / name).write_bytes(np.array(ids, np.uint16).tobytes())
        start, ordinal = 0, 0
        for i, x in enumerate(ids):
            if x == 9:
                expected.append((name, ordinal, start, i - start, True))
                start, ordinal = i + 1, ordinal + 1
        if start < len(ids):
            expected.append((name, ordinal, start, len(ids) - start, False))
    out = separator_scan.scan(spark, f"file://{tmp_path}/f", separator=9, block_tokens=block)
    assert sorted(map(tuple, out.collect())) == sorted(expected)


def test_separator_scan_refuses_odd_files(spark, tmp_path):
    (tmp_path / "odd.u16").write_bytes(b"abc")
    with pytest.raises(ValueError):
        separator_scan.scan(spark, f"file://{tmp_path}")


def test_neighbours(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    pdf = rows.toPandas()
    x, ids = np.stack(pdf.embedding), pdf.vec_id.to_numpy()
    bad = spark.createDataFrame([(None, [0.1] * 64), (9001, None), (9002, []), (9003, [0.5] * 3), (9004, [float("nan")] * 64)], "vec_id bigint, embedding array<float>")
    out = ann.neighbours(rows.select("vec_id", "embedding").unionByName(bad).unionByName(rows.select("vec_id", "embedding").limit(5)).withColumn("id", F.lit(1)))
    got = out.toPandas()
    assert set(got.vec_id) <= set(ids) and not got.duplicated(["vec_id", "rank"]).any() and (got.vec_id != got.neighbour_id).all()
    hit = 0
    for i, k in enumerate(ids):
        d = ((x[i].astype(float) - x) ** 2).sum(1)
        d[i] = np.inf
        own = got[got.vec_id == k].sort_values("rank")
        hit += len(set(ids[np.argsort(d)[:10]]) & set(own.neighbour_id))
        assert np.allclose(own.distance, np.sqrt(d[[int(np.flatnonzero(ids == n)[0]) for n in own.neighbour_id]])) and own.distance.is_monotonic_increasing
    assert hit >= 0.9 * 10 * len(ids)


def test_neighbours_empty(spark):
    assert ann.neighbours(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


CHAT = [
    (1, 0, "u", "Hello there\nhow are you?"), (1, 1, "a", "> hello  THERE\nFine."), (1, 2, "u", "On Monday X wrote:\n> Fine.\n>> Hello there\nGood"), (1, 3, "a", "> how are you?\nlate reply"), (1, 4, "u", "> nothing known\nx"),
    (1, 5, "a", "> Fine.\n> Good\n> how are you?"), (2, 0, "u", None), (2, 1, None, "> a\n> b"), (2, 1, None, "> a\n> b"), (3, None, "u", ""), (None, 1, "u", "lone"), (None, 2, "u", "> lone"), (4, 1, "u", "x " * 5000),
]


def test_quotation_linking_equals_sql(spark):
    pdf = pd.DataFrame(CHAT[:10] + CHAT[12:], columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    out = quotation.link(spark.createDataFrame(CHAT[:10] + CHAT[12:], "conv_id bigint, turn bigint, role string, text string").withColumns({"pos": F.lit(0), "ck": F.lit(0)}))
    con = duckdb.connect()
    con.register("conversations", pdf)
    expected = con.sql(quotation.ORACLE_SQL).fetchall()
    order = [d[0] for d in con.sql(quotation.ORACLE_SQL).description]
    assert sorted(map(str, (tuple(r[c] for c in order) for r in out.collect()))) == sorted(map(str, expected))


def test_quotation_linking_by_hand(spark):
    out = {(r.conv_id, r.turn): r for r in quotation.link(spark.createDataFrame(CHAT, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert out[1, 1].reply_to == 0 and out[1, 1].text == "Fine." and out[1, 2].reply_to == 1 and out[1, 2].quote_level == 2 and out[1, 2].text == "Good"
    assert out[1, 3].reply_to == 0 and out[1, 4].reply_to is None and out[1, 5].reply_to == 2 and out[1, 5].depth == 3
    assert [out[1, t].position for t in range(6)] == [1, 2, 3, 5, 6, 4]
    assert out[None, 2].reply_to == 1


def test_fresh_names(spark):
    assert common.fresh(spark.range(1).select(F.lit(1).alias("A"), F.lit(1).alias("a_")), "a", "b") == ["a__", "b"]


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [f for _, f in p.STAGES] == [fertility.stage, toxicity.stage, omh.stage, superkmer.stage, packing.stage]
    now = docs
    for _, stage in p.STAGES[:-1]:
        new = stage(spark, now, SF)
        assert new.columns == docs.columns
        now = new.cache()
        assert 0 < now.count() <= docs.count()
    kept = {(r.doc_id, i) for r in now.collect() for i in range(-(-(len(r.text.split()) + 1) // packing.CAPACITY))}
    assert {(r.doc_id, r.piece) for r in p.run(spark, SF).collect()} == kept
