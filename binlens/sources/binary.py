"""Binary corpus scan (A1), folder labels (A2), typed CSV reads (A3) and sinks (A5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binlens.functions.text import base_name, label_from_path

# Exact names of the pipeline's own output, never samples.
DEFAULT_SKIP = ("test.csv",)


def scan_binaries(spark: SparkSession, root: str, glob: str | None = None, skip: tuple = DEFAULT_SKIP,
                  max_bytes: int | None = None) -> DataFrame:
    """Recursive file listing as rows ``(sample_id, sample_name, path, content, length, label)``.

    The driver only lists paths; executors read bytes. ``sample_id`` is the SHA-256 of the
    content (the real key, since names repeat); ``label`` comes from the folder name.
    ``max_bytes`` leaves out giants by the listed length before their content is carried on;
    ``oversize_rejects`` lists them.
    """
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return samples_from_files(r.load(root), skip, max_bytes)


def samples_from_files(df: DataFrame, skip: tuple = DEFAULT_SKIP, max_bytes: int | None = None) -> DataFrame:
    """binaryFile rows (batch or stream) -> samples; per-row expressions only."""
    name = base_name(F.col("path"))
    if skip:
        df = df.filter(~name.isin(*skip))
    if max_bytes is not None:
        df = df.filter(F.col("length") <= max_bytes)
    return df.select(
        F.sha2(F.col("content"), 256).alias("sample_id"),
        name.alias("sample_name"),
        F.col("path"),
        F.col("content"),
        F.col("length"),
        label_from_path(F.col("path")).alias("label"),
    )


def oversize_rejects(files: DataFrame, max_bytes: int, skip: tuple = DEFAULT_SKIP) -> DataFrame:
    """(path, length, reason) of the files that ``max_bytes`` leaves out; contents are not read."""
    name = base_name(F.col("path"))
    big = files.filter(F.col("length") > max_bytes)
    if skip:
        big = big.filter(~name.isin(*skip))
    return big.select("path", "length", F.lit("too_large").alias("reason"))


def split_label_rejects(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose path names neither class go to a rejects table with a reason."""
    good = samples.filter(F.col("label").isNotNull())
    bad = samples.filter(F.col("label").isNull()).select("sample_id", "path", F.lit("no_label_folder").alias("reason"))
    return good, bad


# Columns read as text in the typed feature CSV (everything else is double).
# The key, 31 section-name columns, the year and two reserved-word blocks.
STRING_COLUMNS = frozenset(["SampleName", *[f"Name{i}" for i in range(31)], "TimeDateStamp", "e_res", "e_res2"])


def typed_schema(columns: list[str], string_columns=STRING_COLUMNS) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType() if c in string_columns else T.DoubleType(), True)
                         for c in columns])


def read_typed_csv(spark: SparkSession, path: str, string_columns=STRING_COLUMNS) -> DataFrame:
    """Header-only read to learn the columns, then a full read with an explicit schema
    (no inference pass). Multi-line quoted fields are allowed (reserved-word blocks can hold
    line breaks)."""
    header = spark.read.option("header", "true").csv(path).columns
    schema = typed_schema(header, string_columns)
    return (spark.read.schema(schema).option("header", "true").option("multiLine", "true")
            .option("escape", '"').csv(path))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Overwrite sink; parquet by default, CSV (with header) on request."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", "true").option("escape", '"').csv(path)
    else:
        w.format(fmt).save(path)
