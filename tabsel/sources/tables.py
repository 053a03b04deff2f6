"""Tables from files and folders, from the driver's memory, and report rows back to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InputError, SchemaError
from ..functions.expressions import nan_to_null

FORMATS = ("parquet", "csv")


def _list(spark: SparkSession, path: str) -> tuple[bool, list[str]]:
    """Whether the path is one file, and the data files (or partitioned datasets) of it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise InputError(f"{path} doesn't exist")
    if fs.getFileStatus(p).isFile():
        return True, [path]
    found = sorted(s.getPath().toString() for s in fs.listStatus(p) if not s.getPath().getName().startswith(("_", ".")))
    return False, [f for f in found if f.rsplit(".", 1)[-1] in FORMATS]


def _read(spark: SparkSession, path: str) -> DataFrame:
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in FORMATS:
        raise InputError(f"{path}: {kind} is none of {FORMATS}")
    return spark.read.parquet(path) if kind == "parquet" else spark.read.option("header", True).option("inferSchema", True).csv(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """A parquet or csv file, or a folder of them, all of one schema. Only footers (and csv samples) are read here."""
    single, files = _list(spark, path)
    if not files:
        raise InputError(f"{path} holds no parquet or csv files")
    frames = [_read(spark, f) for f in files]
    first = [(f.name, f.dataType) for f in frames[0].schema]
    for name, frame in zip(files, frames):
        if [(f.name, f.dataType) for f in frame.schema] != first:
            raise InputError(f"{name} has another schema than {files[0]}")
    kinds = {f.rsplit(".", 1)[-1] for f in files}
    if single or len(frames) == 1:
        return nan_to_null(frames[0])
    if kinds == {"parquet"}:
        return nan_to_null(spark.read.parquet(*files))  # one scan of all files
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return nan_to_null(out)


def from_memory(spark: SparkSession, data: object) -> DataFrame:
    """A DataFrame as it is; pandas, Arrow or a 2-d array (columns f0, f1, ...) as one."""
    if isinstance(data, DataFrame):
        return nan_to_null(data)
    if hasattr(data, "ndim") and not hasattr(data, "columns"):
        import pandas as pd

        if data.ndim != 2:
            raise InputError(f"an array of {data.ndim} dimensions is no table")
        data = pd.DataFrame(data, columns=[f"f{i}" for i in range(data.shape[1])])
    if len(set(getattr(data, "column_names", None) or data.columns)) < len(getattr(data, "column_names", None) or data.columns):
        raise SchemaError("columns occur more than once")
    return nan_to_null(spark.createDataFrame(data))


def attach_column(df: DataFrame, other: DataFrame, key: str, column: str) -> DataFrame:
    """df with a column of another table of the same keys; keys must match one to one."""
    counts = df.select(key).join(other.groupBy(key).agg(F.count("*").alias("__c")), key, "left").agg(F.count_if(F.coalesce("__c", F.lit(0)) != 1).alias("bad")).first()
    if counts["bad"]:
        raise InputError(f"{counts['bad']} rows have no or several values of {column}")
    return df.join(other.select(key, column), key)


def data_signature(df: DataFrame) -> str:
    """Order-free digest of the rows: xor and sum of row hashes, count and schema. Weaker than a checksum of the bytes."""
    h = F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))
    r = df.agg(F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).first()
    return f"{r['x']}:{r['s']}:{r['n']}:{df.schema.json()}"
