"""Table preparation (C1-C9, C17, C18): union by name, null-column drop, alignment, typed
fills, shapes, truncation and deterministic splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binlens.functions.ranking import stratified_folds, stratified_holdout  # noqa: F401

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def concat_by_name(frames: list[DataFrame]) -> DataFrame:
    """Stack rows; the columns are the union of all inputs (missing -> null); duplicates kept."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def null_counts(df: DataFrame) -> dict[str, int]:
    """One aggregate pass over all columns (map-side combined)."""
    row = df.agg(*[F.sum(F.col(c).isNull().cast("bigint")).alias(c) for c in df.columns]).first()
    return {c: int(row[c] or 0) for c in df.columns}


def drop_null_columns(df: DataFrame, also_drop: list[str] = ()) -> DataFrame:
    """Drop every column holding at least one null, then the named columns (absent names are
    ignored). The surviving column list is data dependent: one aggregate action decides it."""
    nulls = null_counts(df)
    keep = [c for c in df.columns if nulls[c] == 0 and c not in set(also_drop)]
    return df.select(*keep)


def align_columns(df: DataFrame, reference: T.StructType) -> DataFrame:
    """Take the reference's column list and types: extra columns go, missing ones are added as
    typed nulls, the rest are cast (ANSI: a bad value raises)."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
                       for f in reference.fields])


def typed_fill(df: DataFrame, number=0, text: str = "null", boolean: bool = False) -> DataFrame:
    """Numeric nulls -> 0, string nulls -> 'null', boolean nulls -> false."""
    nums = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]
    strs = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    bools = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]
    out = df
    if nums:
        out = out.fillna(number, subset=nums)
    if strs:
        out = out.fillna(text, subset=strs)
    if bools:
        out = out.fillna(boolean, subset=bools)
    return out


def shape(df: DataFrame, step: str) -> DataFrame:
    """(step, n_rows, n_cols) without collecting the data."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(step).alias("step"), F.col("n_rows"), F.lit(len(df.columns)).cast("bigint").alias("n_cols"))


def truncate(df: DataFrame, cols: list[str]) -> DataFrame:
    """Integer truncation toward zero (``astype(int64)``)."""
    return df.select(*[F.col(c).cast("bigint").alias(c) if c in cols else F.col(c) for c in df.columns])


def string_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in exclude]
