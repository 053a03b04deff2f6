"""Kernels against brute force, without Spark."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabsel.llm import alignment, ann, bpe, common, eliasfano, fertility, packing, superkmer, toxicity, vocab
from tabsel.llm import order_minhash as omh


def test_words_and_hashes():
    texts = pa.array(["a bb  a", None, "", "  ", "bb\na", "é\tbb"])
    flat, offs = common.flat_bytes(texts)
    starts, ends, edges = common.word_bounds(flat, offs, common.separators(False))
    raw = flat.tobytes()
    words = [raw[a:b].decode() for a, b in zip(starts, ends)]
    assert [words[a:b] for a, b in zip(edges, edges[1:])] == [["a", "bb", "a"], [], [], [], ["bb", "a"], ["é", "bb"]]
    h = common.span_hashes(flat, starts, ends)
    assert len(set(h.tolist())) == len(set(words)) and all((x == y) == (u == v) for x, u in zip(h, words) for y, v in zip(h, words))


def test_slices_cover_all_rows():
    texts = pa.array(["x" * n for n in (5, 0, 50, 3, 3, 100)])
    assert list(common.text_slices(texts, 10)) == [(0, 2), (2, 3), (3, 5), (5, 6)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.tuples(st.lists(st.integers(0, 5), max_size=40), st.lists(st.integers(0, 5), max_size=40), st.integers(0, 40)), min_size=1, max_size=8))
def test_banded_alignment_is_exact(cases):
    found = alignment.within([(np.array(a, np.uint32), np.array(b, np.uint32)) for a, b, _ in cases], np.array([t for *_, t in cases]))
    for d, (a, b, t) in zip(found, cases):
        true = distance(a, b)
        assert d == (true if true <= t else -1)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_packing_places_every_length(lengths):
    histogram = {x: lengths.count(x) for x in lengths}
    used, bins = {}, 0
    for pattern, n in packing.plan_bins(histogram, 64):
        assert sum(pattern) <= 64 and n > 0
        bins += n
        for x in pattern:
            used[x] = used.get(x, 0) + n
    assert used == histogram
    assert bins <= len(lengths) and 2 * sum(lengths) >= 64 * (bins - 1)


@pytest.mark.parametrize("lengths,bins", [([60, 4], 1), ([50, 10, 4], 1), ([40, 12, 8, 4], 1), ([33, 33], 2), ([64], 1), ([], 0), ([32] * 5, 3)])
def test_packing_finds_exact_complements(lengths, bins):
    assert sum(n for _, n in packing.plan_bins({x: lengths.count(x) for x in lengths}, 64)) == bins


def test_packing_refuses_lengths_beyond_capacity():
    with pytest.raises(ValueError):
        packing.plan_bins({65: 1}, 64)


@settings(deadline=None, max_examples=80)
@given(st.lists(st.integers(0, 5000), max_size=300))
def test_elias_fano_round_trip(steps):
    ends = np.cumsum(np.array(steps, np.int64))
    width, low, high, samples = eliasfano.encode_offsets(ends)
    assert (eliasfano.decode_offsets(len(ends), width, low, high) == ends).all()
    assert all(eliasfano.select(i, width, low, high, samples) == x for i, x in enumerate(ends))
    if len(ends):
        assert len(low) + len(high) <= (2 + np.log2(max(ends[-1] / len(ends), 1)) + 1) * len(ends) / 8 + 3


ALPHABET = "ab aAé\n\t  ß'sll123!?.,-_ \xa0\x1c日本ñ🙂\r"


@settings(deadline=None, max_examples=80)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=60), max_size=12))
def test_bpe_equals_the_public_encoder(texts):
    name = bpe.VOCABULARY
    enc = bpe.Encoder(bpe.merges(name, vocab.TOKENIZERS))
    ids, counts = enc.encode(texts)
    ends = np.cumsum(counts)
    for t, a, b in zip(texts, ends - counts, ends):
        assert ids[a:b].tolist() == vocab.encoding(name).encode_ordinary(t)
        assert enc.merges.decode(ids[a:b]).decode() == t


def test_bpe_long_words():
    enc = bpe.Encoder(bpe.merges(bpe.VOCABULARY, vocab.TOKENIZERS))
    for t in ("a" * 3000, "ab" * 2000, " " * 500, "é" * 700):
        ids, _ = enc.encode([t])
        assert ids.tolist() == vocab.encoding(bpe.VOCABULARY).encode_ordinary(t)


def test_fertility_measures():
    n, chars, fallback, gap = fertility.measure("the cat sat on the mat", vocab.TOKENIZERS)
    ids = vocab.encoding(fertility.MULTI).encode_ordinary("the cat sat on the mat")
    p = np.array([ids.count(i) for i in set(ids)]) / len(ids)
    assert n == len(ids) and chars == 22 / n and fallback == 0 and abs(gap - (1 + (p * np.log2(p)).sum() / np.log2(n))) < 1e-12
    assert fertility.measure("", vocab.TOKENIZERS) == (0, 0.0, 0.0, 0.0)
    assert fertility.measure("the the the the", vocab.TOKENIZERS)[3] > 0.5


def test_fallback_share_is_that_of_the_vocabulary():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=f"{vocab.TOKENIZERS}/{fertility.FALLBACK}")
    for text in ("plain words", "日本語 と ꙮ ᚠᚢᚦ", "naïve 🙂🙂 test"):
        spelled = sum(sp.is_byte(i) for i in sp.encode(text))
        table = vocab.covered_chars(fertility.FALLBACK)
        assert spelled == sum(len(c.encode()) for c in text if not table[ord(c)])


@pytest.fixture(scope="module")
def language():
    text = "you are an idiot and a loser . this is a stupid clown with no idea . the idiot said that the clown is stupid . a little dog and an old book . " * 50
    s = toxicity._fold()[np.frombuffer(("\n" * 3 + text).encode("utf-32-le"), np.uint32)]
    s = s[(s > 0) | np.concatenate([[True], s[:-1] > 0])].astype(np.int64)
    counts = np.bincount((s[:-3] << 15) | (s[1:-2] << 10) | (s[2:-1] << 5) | s[3:], minlength=toxicity.SIZE).astype(float)
    return toxicity.language_model(counts)


@pytest.mark.parametrize("noisy,clean", [("1d10t", "idiot"), ("idiooot", "idiot"), ("i d i o t", "idiot"), ("i.d.i.o.t", "idiot"), ("l0ser", "loser"), ("$tup1d", "stupid"), ("cl0wn", "clown"), ("book", "book"), ("little", "little"), ("clown", "clown")])
def test_viterbi_restores(language, noisy, clean):
    assert toxicity.decode(noisy, language) == clean


def brute_readings(observed, log_p):
    """All readings of the lattice with their least costs."""
    lone, found = toxicity._lone(observed), {}

    def walk(i, state, cost, read, run):
        if i == len(observed):
            a, b, d = state
            cost += -float(log_p[a, b, d, 0]) if d else 0.0
            found[read] = min(cost, found.get(read, float("inf")))
            return
        c = observed[i]
        letter = toxicity.base_letter(c)
        run = run + 1 if i and letter and letter == toxicity.base_letter(observed[i - 1]) else 1
        a, b, d = state
        options = [(letter, 0.0)] if letter else [(None, toxicity.LITERAL)] + [(x, toxicity.SUBSTITUTE) for x in toxicity.LEET.get(c, "")]
        for x, extra in options:
            s = ord(x) - 96 if x else 0
            step = 0.0 if not s and not d else -float(log_p[a, b, d, s])
            walk(i + 1, (b, d, s) if s or d else state, cost + extra + step, read + (x or c), run)
        if letter and run > 1:
            following = toxicity.base_letter(observed[i + 1 : i + 2] or " ")
            walk(i + 1, state, cost + (toxicity.PAIR if run == 2 and following != letter else toxicity.RUN), read, run)
        elif not letter:
            walk(i + 1, state, cost + (toxicity.SPACED if lone[i] else toxicity.SEPARATOR) + (toxicity.SUBSTITUTE if c.isalnum() else 0.0), read, run)

    walk(0, (0, 0, 0), 0.0, "", 0)
    return found


@pytest.mark.parametrize("observed", ["1d10t", "l o s e r", "st00p!d", "c|0wn", "loo5err", "a-b", "x!!1", "88", "", "aaa"])
def test_viterbi_is_the_cheapest_reading(language, observed):
    found = brute_readings(observed, language)
    assert abs(found[toxicity.decode(observed, language)] - min(found.values())) < 1e-6


def test_pattern_covers_every_reading():
    p = toxicity.pattern({"idiot": 1.0, "loser": 1.0, "idle": 1.0})
    import regex

    for s in ("idiot", "1d10t", "I.D.I.O.T", "l o s e r", "looooser", "ídiót", "!d!ot", "ID-LE"):
        assert regex.search(p, s.lower()), s
    for s in ("idiotic", "closer", "ideal", "lose r8"):
        assert not regex.search(p, s.lower()), s


def is_covered(noisy, word, language):
    """Whether decoding all of noisy gives the word, and decoding what the pattern finds in it does as well."""
    import regex

    words = lambda text: re.split("[^a-z]+", toxicity.decode(text, language))
    found = regex.findall(toxicity.pattern({"book": 1.0, "little": 1.0, "idiot": 1.0}), noisy)
    return word in words(noisy) and any(word in words(s) for s in found)


@pytest.mark.parametrize("noisy,word", [("b o o k", "book"), ("b-o-o-k", "book"), ("b o oo k", "book"), ("bo 0k", "book"), ("boook", "book"), ("l i t t l e", "little"), ("l.i.t.t.l.e", "little"), ("l i tt l e", "little"), ("i d ii o t", "idiot")])
def test_pattern_covers_doubled_letters_apart(language, noisy, word):
    assert is_covered(noisy, word, language)


@pytest.mark.parametrize("noisy", ["i    d    i    o    t", "i -- d -- i -- o -- t", "i\nd\ni\no\nt", "i\r\n\r\nd\r\n\r\ni\r\n\r\no\r\n\r\nt", "i2d2i2o2t", "i 2 d 2 i 2 o 2 t", f"i{'.' * 500}d{' ' * 500}i o t", "ịdịọt"])
def test_pattern_covers_gaps_of_any_length(language, noisy):
    assert is_covered(noisy, "idiot", language)


def test_pattern_covers_whatever_decodes_to_a_word(language):
    rng, hits = random.Random(2), 0
    for _ in range(1500):
        word, gap, noisy = rng.choice(["book", "little", "idiot"]), rng.choice(["", "", " ", "  ", "-", "\n", " -- ", "     ", "2", " 9 ", "! ", "."]), ""
        for x in word:
            x = rng.choice([x, x, x, *(m for m, read in toxicity.LEET.items() if x in read)])
            noisy += x * rng.choice([1, 1, 1, 2]) + (gap if rng.random() < 0.9 else "")
        noisy = noisy.strip(" -\n.!29")
        if word in re.split("[^a-z]+", toxicity.decode(noisy, language)):
            hits += 1
            assert is_covered(noisy, word, language), noisy
    assert hits > 500


def test_order_minhash_depends_on_order_and_occurrence():
    words, edges = omh.words_of(pa.array(["a b c d e f g h", "a b c d e f g h", "e f g h a b c d", "a b c d e f g h a b c d e f g h", "x"]))
    s = omh.sketch(words, edges, k=1)
    assert (s[0] == s[1]).all() and 0 < (s[0] == s[2]).mean() < 1 and (s[0] != s[4]).all()


def test_order_minhash_against_the_definition():
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdef") for _ in range(n)) for n in (1, 2, 3, 9, 40)]
    words, edges = omh.words_of(pa.array(texts))
    found = omh.sketch(words, edges, hashes=4)
    for i, _ in enumerate(texts):
        one = omh.sketch(words[edges[i] : edges[i + 1]], np.array([0, edges[i + 1] - edges[i]]), hashes=4)
        assert (found[i] == one[0]).all()


def test_profiles_never_rule_out_a_true_pair():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = rng.integers(0, 40, rng.integers(1, 60)).astype(np.uint64)
        b = a.copy()
        for _ in range(rng.integers(0, 15)):
            b = np.delete(b, rng.integers(0, len(b))) if len(b) > 1 and rng.random() < 0.5 else np.insert(b, rng.integers(0, len(b) + 1), rng.integers(0, 40))
        p, q = (np.minimum(np.bincount((x % 256).astype(int), minlength=256), 255).astype(np.int16) for x in (a, b))
        assert omh.possible(p, q, np.array(distance(a.tolist(), b.tolist())))


def test_super_kmers_cover_every_window_once():
    rng = np.random.default_rng(3)
    n = np.array([0, 49, 50, 51, 130, 300])
    words = rng.integers(0, 1 << 62, n.sum()).astype(np.uint64)
    edges = np.concatenate([[0], np.cumsum(n)])
    mh, text, start, count = superkmer.super_kmers(words, edges)
    seen = sorted((t, s + i) for t, s, c in zip(text, start, count) for i in range(c))
    assert seen == [(t, i) for t, k in enumerate(n) for i in range(max(0, k - 49))]
    again = superkmer.super_kmers(np.concatenate([words[edges[5] :], words[edges[5] :]]), np.array([0, 300, 600]))
    assert (again[0][again[1] == 0] == again[0][again[1] == 1]).all()


def test_probes_come_in_order_of_success():
    rng = np.random.default_rng(0)
    cell, place = ann.cells(rng.standard_normal((5, 8)), 2, 3, 1.0)
    found = ann.probes_of(cell, place, 27)
    assert (found[..., 0] == ann.bucket(cell)).all() and all(len(set(r.tolist())) == 27 for r in found.reshape(-1, 27))


def test_nearest_ranks_exactly_with_ties_by_id():
    x = np.array([[0, 0], [1, 0], [0, 1], [2, 2], [1, 0]], np.float32)
    ids = np.array([4, 3, 2, 1, 9])
    row, found, dist = ann.nearest(x[:1], ids[:1], x, ids, 3)
    assert found.tolist() == [2, 3, 9] and dist.tolist() == [1, 1, 1] and row.tolist() == [0, 0, 0]


