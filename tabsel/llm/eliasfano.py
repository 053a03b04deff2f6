"""Token-ID output: a concatenated id array with Elias-Fano encoded document boundaries.

A segment holds the ids of many documents one after another and the offsets of their boundaries as an Elias-Fano
sequence: the low bits of each offset packed, the high bits in unary, and every SAMPLE-th one's place for select.
Each boundary takes 2 + log2(tokens / documents) bits or so; no table of 64-bit offsets is kept anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vocab
from .common import documents, text_slices

#: Every so many boundaries the bit place of one is kept.
SAMPLE = 64
#: A segment is closed when it has this many tokens.
SEGMENT_TOKENS = 1 << 21
VOCABULARY = "byte_bpe_50k.tiktoken"


def encode_offsets(offsets: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """(low bits, low part, high part, select samples) of a rising sequence, the last value being the universe."""
    n, u = len(offsets), int(offsets[-1]) if len(offsets) else 0
    width = max(0, (u // n).bit_length() - 1) if n else 0
    if not n:
        return 0, b"", b"", b""
    off = offsets.astype(np.uint64)
    bits = ((off[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    low = np.packbits(bits.ravel(), bitorder="little").tobytes()
    places = (off >> np.uint64(width)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(places[-1]) + 1, np.uint8)
    high[places] = 1
    return width, low, np.packbits(high, bitorder="little").tobytes(), places[::SAMPLE].astype(np.uint32).tobytes()


_POPCOUNT = np.array([bin(b).count("1") for b in range(256)], np.uint8)


def select(i: int, width: int, low: bytes, high: bytes, samples: bytes) -> int:
    """The i-th value, from the nearest sample onwards; only the bytes between are looked at."""
    place = int(np.frombuffer(samples, np.uint32, 1, 4 * (i // SAMPLE))[0])
    left = i % SAMPLE
    if left:
        raw = np.frombuffer(high, np.uint8)
        at = place // 8
        head = int(raw[at]) >> (place % 8 + 1)
        seen = int(_POPCOUNT[head])
        if seen >= left:
            base, byte = at * 8 + place % 8 + 1, head
        else:
            left -= seen
            counts = np.cumsum(_POPCOUNT[raw[at + 1 : at + 1 + SAMPLE * 64]].astype(np.int64))
            if not len(counts) or counts[-1] < left:
                counts = np.cumsum(_POPCOUNT[raw[at + 1 :]].astype(np.int64))
            k = int(np.searchsorted(counts, left))
            left -= int(counts[k - 1]) if k else 0
            base, byte = (at + 1 + k) * 8, int(raw[at + 1 + k])
        bit = -1
        for bit in range(8):
            left -= byte >> bit & 1
            if not left:
                break
        place = base + bit
    upper = place - i
    if not width:
        return upper
    first, bits = i * width, 0
    piece = int.from_bytes(low[first // 8 : (first + width + 7) // 8], "little")
    bits = piece >> first % 8 & (1 << width) - 1
    return upper << width | bits


def decode_offsets(n: int, width: int, low: bytes, high: bytes) -> np.ndarray:
    """All n values."""
    places = np.flatnonzero(np.unpackbits(np.frombuffer(high, np.uint8), bitorder="little"))[:n]
    upper = (places - np.arange(n)).astype(np.int64) << width
    if not width or not n:
        return upper
    bits = np.unpackbits(np.frombuffer(low, np.uint8), bitorder="little")[: n * width].reshape(n, width)
    return upper | (bits.astype(np.int64) << np.arange(width)).sum(1)


SCHEMA = T.StructType(
    [
        T.StructField("partition", T.IntegerType()),
        T.StructField("segment", T.IntegerType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("n_docs", T.IntegerType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("low_bits", T.IntegerType()),
        T.StructField("low", T.BinaryType()),
        T.StructField("high", T.BinaryType()),
        T.StructField("samples", T.BinaryType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


def segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, folder: str = vocab.TOKENIZERS, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """Rows of SCHEMA: document i of a segment has the ids [offset(i-1), offset(i)), offset(-1) being 0, little-endian, two bytes
    an id, or four for a vocabulary with ids above 65,535 (so len(ids) / n_tokens bytes).

    Documents stay in the order and partition in which they are read; nothing is shuffled. A null or empty text is a
    document without tokens (two equal offsets), a null id stays null, repeated rows are repeated documents, a document
    longer than segment_tokens is not cut. Without rows there are no segments. Other columns are not read.
    """
    kind = vocab.id_type(vocabulary, folder)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = vocab.encoding(vocabulary, folder)
        part = TaskContext.get().partitionId()
        number, ids, parts, lengths, total = 0, [], [], [], 0

        def close() -> pa.RecordBatch:
            ends = np.cumsum(np.array(lengths, np.int64))
            width, low, high, samples = encode_offsets(ends)
            flat = np.concatenate(parts) if parts else np.empty(0, kind)
            row = [[part], [number], [ids], [len(lengths)], [total], [width], [low], [high], [samples], [flat.tobytes()]]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=SCHEMA.names)

        for batch in it:
            for a, b in text_slices(batch.column(1)):
                for key, text in zip(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a)):
                    tokens = enc.encode_to_numpy(text.as_py() or "", disallowed_special=()).astype(kind)
                    ids.append(key)
                    parts.append(tokens)
                    lengths.append(len(tokens))
                    total += len(tokens)
                    if total >= segment_tokens:
                        yield close()
                        number, ids, parts, lengths, total = number + 1, [], [], [], 0
        if lengths:
            yield close()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def documents_of(table: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) of segments(): each document's place in its segment and its ids, in order of the segment.

    A document without tokens has an empty array; without segments there are no rows.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for r in batch.to_pylist():
                ends = decode_offsets(r["n_docs"], r["low_bits"], r["low"], r["high"])
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                flat = np.frombuffer(r["ids"], np.uint16 if len(r["ids"]) == 2 * r["n_tokens"] else np.uint32).astype(np.int32)
                offsets = pa.array(np.append(starts, ends[-1]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(starts), pa.array(ends - starts), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=["doc_id", "start", "n_tokens", "ids"])

    return table.select("doc_ids", "n_docs", "n_tokens", "low_bits", "low", "high", "ids").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids array<int>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(documents(spark, sf_dir))
