"""Token counts by separator scan.

Flat token files hold nothing but ids, documents ended by one identifier, without an index. Files are read in blocks
of equal size; each block is searched for the identifier at once. A document may begin in one block and end in another
one far away: a prefix scan over the blocks of a file (running number of separators, place of the last one) stitches
the boundaries.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vocab
from .common import checkpoint, documents, shared_dir, text_slices

VOCABULARY, SEPARATOR = "byte_bpe_50k.tiktoken", 50256
BLOCK_TOKENS = 1 << 21
#: Bytes of an id -> how it is read and written.
KINDS = {2: np.dtype("<u2"), 4: np.dtype("<u4")}


def write_tokens(docs: DataFrame, folder: str, text_col: str = "text", vocabulary: str = VOCABULARY, separator: int = SEPARATOR, tokenizers: str = vocab.TOKENIZERS, width: int = 2) -> None:
    """Write the ids of each partition of docs to folder/part-N.u16 or .u32 (little-endian, `width` bytes an id), each document ended by the separator.

    A file is written under a name of its own attempt and renamed when it is whole, so a task may run again. A null
    text is written as an empty document, repeated rows as documents of their own, a long text whole. A partition
    without rows leaves an empty file. Raises where the separator is an id of the vocabulary, or where an id or the
    separator needs more than `width` bytes.
    """
    kind = KINDS[width]
    top = vocab.encoding(vocabulary, tokenizers).max_token_value
    if separator <= top:
        raise ValueError(f"separator {separator} is an id of {vocabulary}, whose last is {top}")
    if separator > np.iinfo(kind).max:
        raise ValueError(f"separator {separator} doesn't fit into {width} bytes")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        name = f"{base}/part-{task.partitionId():06d}.u{8 * width}"
        attempt = f"{base}/.{task.partitionId():06d}-{task.taskAttemptId()}"
        enc, end, n = vocab.encoding(vocabulary, tokenizers), np.array([separator], kind), 0
        with files.open_output_stream(attempt) as out:
            for batch in it:
                for a, b in text_slices(batch.column(0)):
                    for t in batch.column(0).slice(a, b - a):
                        ids = enc.encode_to_numpy(t.as_py() or "", disallowed_special=())
                        out.write(np.concatenate([ids.astype(kind), end]).tobytes())
                        n += 1
        files.move(attempt, name)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    docs.select(text_col).mapInArrow(run, "n bigint").agg(F.sum("n")).collect()


def blocks(spark: SparkSession, folder: str, block_tokens: int = BLOCK_TOKENS, width: int = 2) -> DataFrame:
    """Rows (file, block, first, tokens): the blocks of all files of the folder. A row for each file is made on the driver."""
    from pyarrow import fs

    files, base = fs.FileSystem.from_uri(folder)
    found = [(f.base_name, f.size) for f in files.get_file_info(fs.FileSelector(base)) if f.is_file and not f.base_name.startswith(".")]
    for name, size in found:
        if size % width:
            raise ValueError(f"{name} has {size} bytes, no multiple of {width}")
    table = spark.createDataFrame(found, "file string, size bigint").where("size > 0")
    n = (F.col("size") / width).cast("long")
    table = table.select("file", n.alias("n"), F.explode(F.sequence(F.lit(0), ((n - 1) / block_tokens).cast("int"))).alias("block"))
    first = F.col("block").cast("long") * block_tokens
    return table.select("file", "block", first.alias("first"), F.least(F.lit(block_tokens).cast("long"), F.col("n") - first).alias("tokens"), (first + block_tokens >= F.col("n")).alias("last_block"))


def scan(spark: SparkSession, folder: str, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS, width: int = 2) -> DataFrame:
    """Rows (file, ordinal, start, n_tokens, ended), one for each document of the files in folder, the separator not counted.

    Two separators in a row are an empty document. Tokens after the last separator are a document that hasn't ended;
    a file that ends with one has none. An empty file has no documents, an empty folder no rows. Files of an odd size
    raise. A document may be longer than any number of blocks.

    A block gives the starts and lengths of the documents that lie within it; what reaches over its edges is a row of
    six numbers, and only these rows go through the prefix scan.
    """
    table = blocks(spark, folder, block_tokens, width)
    spread = table.repartition(max(1, spark.sparkContext.defaultParallelism), "file", "block")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(folder)
        for batch in it:
            for r in batch.to_pylist():
                with files.open_input_file(f"{base}/{r['file']}") as f:
                    ids = np.frombuffer(f.read_at(r["tokens"] * width, r["first"] * width), KINDS[width])
                at = np.flatnonzero(ids == separator).astype(np.int64) + r["first"]
                inner = pa.StructArray.from_arrays([pa.array(at[:-1] + 1), pa.array(np.diff(at) - 1)], names=["start", "n_tokens"])
                offsets = pa.array([0, len(inner)], pa.int32())
                row = [[r["file"]], [r["block"]], [r["first"] + r["tokens"]], [r["last_block"]], [at[0] if len(at) else None], [at[-1] if len(at) else None], [len(at)]]
                yield pa.RecordBatch.from_arrays([*(pa.array(v, k) for v, k in zip(row, kinds)), pa.ListArray.from_arrays(offsets, inner)], names=names)

    names = ["file", "block", "stop", "last_block", "head", "tail", "n", "inner"]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
    # written once: the scan over the edges and the documents within blocks are read from it
    found = checkpoint(spread.mapInArrow(run, "file string, block int, stop bigint, last_block boolean, head bigint, tail bigint, n bigint, inner array<struct<start: bigint, n_tokens: bigint>>"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    edges = found.drop("inner").withColumn("docs_before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("open_at", F.coalesce(F.last("tail", ignorenulls=True).over(before) + 1, F.lit(0).cast("long")))
    # the document that ends at the block's first separator, and at the file's end one that hasn't ended
    rest = F.coalesce(F.col("tail") + 1, F.col("open_at"))
    head = F.when(F.col("n") > 0, F.struct(F.col("docs_before").alias("ordinal"), F.col("open_at").alias("start"), (F.col("head") - F.col("open_at")).alias("n_tokens"), F.lit(True).alias("ended")))
    tail = F.when(F.col("last_block") & (F.col("stop") > rest), F.struct((F.col("docs_before") + F.col("n")).alias("ordinal"), rest.alias("start"), (F.col("stop") - rest).alias("n_tokens"), F.lit(False).alias("ended")))
    across = edges.select("file", F.inline(F.filter(F.array(head, tail), lambda d: d.isNotNull())))
    within = found.where("n > 1").select("file", "block", "inner").join(edges.where("n > 1").select("file", "block", "docs_before"), ["file", "block"])
    within = within.select("file", "docs_before", F.posexplode("inner").alias("i", "d"))
    return across.unionByName(within.select("file", (F.col("docs_before") + F.col("i") + 1).alias("ordinal"), "d.start", "d.n_tokens", F.lit(True).alias("ended")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents: written to flat files in the shared folder, scanned, and the files dropped again."""
    from pyarrow import fs

    root = shared_dir(spark)
    folder = f"{root if '://' in root or root.startswith('file:') else 'file://' + root}/tokens-{uuid.uuid4().hex}"
    files, base = fs.FileSystem.from_uri(folder)
    try:
        write_tokens(documents(spark, sf_dir), folder)
        return checkpoint(scan(spark, folder))
    finally:
        if files.get_file_info(base).type != fs.FileType.NotFound:
            files.delete_dir(base)
