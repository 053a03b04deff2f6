"""Byte-pair encoding and decoding in batched numpy merge rounds.

Texts are cut at white space into chunks, chunks by the vocabulary's pattern into words. The symbols of all new words
of a batch lie in one flat array; each round looks up all neighbouring pairs by binary search over the sorted pair
keys of the vocabulary, and merges the lowest-rank pair of every word. Words seen before come from a bounded store.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vocab
from .common import documents, flat_bytes, fresh, ragged, text_slices

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Chunks that the store of a worker holds before it starts anew.
STORE = 500_000
#: Texts of about this many bytes share their merge rounds.
ROUND_BYTES = 2 << 20
NONE = np.int64(1 << 40)
_CHUNK = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+\Z")
#: Other white space and controls: a text with any of these is not cut into chunks before the pattern.
_OTHER = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_WORD = regex.compile(vocab.PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s+(?!\S)|\s+", r"\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"))


class Merges:
    """A vocabulary as arrays: sorted keys of all pairs that make a token, its id, and the tokens' bytes."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        keys, ids = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    keys.append(left << 20 | right)
                    ids.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.ids = np.array(keys, np.int64)[order], np.array(ids, np.int64)[order]
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the pairs' tokens, NONE where a pair makes no token."""
        key = left << np.int64(20) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ids[at], NONE)

    def _beside(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray, own: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the pairs that `own`, in place of the `step` symbols at `at`, makes with the symbols before and after."""
        last = len(sym) - 1
        before, after = np.maximum(at - 1, 0), np.minimum(at + step, last)
        left = np.where((at > 0) & (word[before] == word[at]), self.lookup(sym[before], own), NONE)
        right = np.where((at + step <= last) & (word[after] == word[at]), self.lookup(own, sym[after]), NONE)
        return left, right

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has.

        In a round a word merges every occurrence of its lowest pair, left to right, unless a pair that these merges
        make would come before them; then only the first occurrence is merged, as one merge after another would.
        """
        lengths = np.array([len(w) for w in words], np.int64)
        sym = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        rank = np.full(len(sym), NONE)
        inside = np.flatnonzero(word[1:] == word[:-1])
        rank[inside] = self.lookup(sym[inside], sym[inside + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(sym)))
            live = least < NONE
            if not live.all():
                ended = np.repeat(~live, sizes)
                done.append((word[ended], sym[ended]))
                keep = ~ended
                sym, word, rank = sym[keep], word[keep], rank[keep]
                sizes, least = sizes[live], least[live]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(least, sizes))
            # of overlapping occurrences every other one: the place's parity in its run
            new_run = np.concatenate([[True], np.diff(at) > 1])
            run_start = np.repeat(at[new_run], np.diff(np.append(np.flatnonzero(new_run), len(at))))
            at = at[(at - run_start) % 2 == 0]
            at_word = word[at]
            lead = np.concatenate([[True], at_word[1:] != at_word[:-1]])
            if not lead.all():
                several = np.flatnonzero(np.isin(at_word, at_word[~lead]))
                place, own = at[several], at_word[several]
                made = rank[place]
                left, right = self._beside(sym, word, place, made, 2)
                sooner = np.minimum(np.minimum(left, right), self.lookup(made, made)) < made
                careful = np.isin(at_word, own[sooner])
                at = at[lead | ~careful]
            sym[at] = rank[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # where the merged symbols are once the others are gone
            sym, word, rank = sym[keep], word[keep], rank[keep]
            left, right = self._beside(sym, word, at, sym[at], 1)
            rank[np.maximum(at - 1, 0)] = np.where(at > 0, left, rank[0])
            rank[at] = right
        if not done:
            return np.empty(0, np.int64), lengths
        word, sym = np.concatenate([w for w, _ in done]), np.concatenate([s for _, s in done])
        return sym[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes[ragged(self.starts[ids], self.lengths[ids])].tobytes()


class Encoder:
    """Encodes batches of texts; keeps the ids of the chunks that it has met."""

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        self._clear()

    def _clear(self) -> None:
        self.codes: dict[str, int] = {}
        self.flat, self.starts, self.lengths = np.empty(1 << 16, np.int32), np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)
        self.used = 0

    def _learn(self, new: list[str]) -> None:
        words: dict[str, int] = {}
        per_chunk, order = [], []
        for chunk in new:
            bare = chunk[1:] if chunk[0] == " " else chunk
            own = (chunk,) if bare.isalpha() else _WORD.findall(chunk)  # letters after at most a space are one word
            per_chunk.append(len(own))
            order.extend(words.setdefault(w, len(words)) for w in own)
        ids, sizes = self.merges.encode_words([w.encode("utf-8", "surrogatepass") for w in words])
        starts = np.cumsum(sizes) - sizes
        order = np.array(order, np.int64)
        flat = ids[ragged(starts[order], sizes[order])]
        ends = np.concatenate([[0], np.cumsum(sizes[order])])
        edges = ends[np.concatenate([[0], np.cumsum(per_chunk)])]
        at, n = len(self.codes), len(new)
        self.flat = _room(self.flat, self.used + len(flat))
        self.starts, self.lengths = _room(self.starts, at + n), _room(self.lengths, at + n)
        self.flat[self.used : self.used + len(flat)] = flat
        self.starts[at : at + n] = self.used + edges[:-1]
        self.lengths[at : at + n] = np.diff(edges)
        self.used += len(flat)
        self.codes.update(zip(new, range(at, at + n)))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        if len(self.codes) > STORE:
            self._clear()
        chunks, counts = [], np.empty(len(texts), np.int64)
        for i, t in enumerate(texts):
            own = [t] if _OTHER.search(t) else _CHUNK.findall(t)
            counts[i] = len(own)
            chunks += own
        new = [c for c in dict.fromkeys(chunks) if c not in self.codes]
        if new:
            self._learn(new)
        at = np.array(list(map(self.codes.__getitem__, chunks)), np.int64)
        sizes = self.lengths[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        edges = ends[np.concatenate([[0], np.cumsum(counts)])]
        return self.flat[ragged(self.starts[at], sizes)], np.diff(edges)


def _room(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    out = np.empty(max(n, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


@lru_cache(maxsize=2)
def merges(name: str, folder: str) -> Merges:
    return Merges(vocab.ranks(name, folder))


@lru_cache(maxsize=2)
def encoder(name: str, folder: str) -> Encoder:
    return Encoder(merges(name, folder))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, folder: str = vocab.TOKENIZERS) -> DataFrame:
    """Rows (doc_id, n_tokens, ids, round_trip), one for each row of docs; round_trip says that decoding gives the text back.

    An empty text has no ids; a null text has null ids, 0 tokens and null round_trip. A null id stays null, repeated
    rows give repeated rows, white space and case are kept, other columns are not read. Whole texts are encoded.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, folder)
        for batch in it:
            for a, b in text_slices(batch.column(1), ROUND_BYTES):
                column = batch.column(1).slice(a, b - a)
                ids, counts = enc.encode([t or "" for t in column.to_pylist()])
                flat, offs = flat_bytes(column)
                back = np.frombuffer(enc.merges.decode(ids), np.uint8)
                edges = np.concatenate([[0], np.cumsum(counts)])
                sizes = np.concatenate([[0], np.cumsum(enc.merges.lengths[ids])])[edges]
                if len(back) == len(flat) and (sizes == offs).all() and (back == flat).all():
                    same = np.ones(len(column), bool)
                else:
                    same = np.array([np.array_equal(back[sizes[i] : sizes[i + 1]], flat[offs[i] : offs[i + 1]]) for i in range(len(column))])
                null = column.is_null().to_numpy(zero_copy_only=False)
                lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32), mask=np.append(null, False) if null.any() else None), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts), lists, pa.array(same, mask=null)], names=schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decode(rows: DataFrame, ids_col: str = "ids", vocabulary: str = VOCABULARY, folder: str = vocab.TOKENIZERS) -> DataFrame:
    """rows with a column more, text (with underscores where that name is taken): the text of the ids.

    Null ids give a null text, no ids an empty one; ids outside the vocabulary raise; bytes that aren't UTF-8 become
    replacement characters.
    """
    (name,) = fresh(rows, "text")
    at, schema = rows.columns.index(ids_col), T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = merges(vocabulary, folder)
        for batch in it:
            texts = [None if x is None else table.decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, name])

    return rows.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir))
