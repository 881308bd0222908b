"""The driver tables mapped onto the engine's domain tables (FIXTURES.md part 2).

Every view reads the given parquet tables with only the columns it needs, so the work grows
with the data. Fixed stand-in expressions are shared with the SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binlens.sources.tables import table

# Fixed values shared with the oracle: score rule, decision threshold and model stand-ins.
THRESHOLD = 0.30
MODEL_SCORES = {
    "chars": ("n_chars", 5000.0),   # round(least(1, n_chars / 5000), 4)
    "lines": ("n_lines", 40.0),     # round(least(1, n_lines / 40), 4)
    "words": ("n_words", 1000.0),   # round(least(1, n_words / 1000), 4)
}


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """documents as a binary corpus: content = UTF-8 bytes, path = folder/lang/source/id.bin.

    The folder carries the class (quality 0 -> malware, 1 -> benign, unlabelled otherwise), as a
    real corpus folder would.
    """
    d = table(spark, sf, "documents", "doc_id", "text", "lang", "source")
    lab = table(spark, sf, "labels", "doc_id", "quality")
    folder = (F.when(F.col("quality") == 0, F.lit("malware"))
              .when(F.col("quality") == 1, F.lit("benign")).otherwise(F.lit("unlabelled")))
    return (d.join(lab, "doc_id", "left")
            .select(F.col("doc_id"),
                    F.concat(F.lit("/corpus/"), folder, F.lit("/"), F.col("lang"), F.lit("/"), F.col("source"),
                             F.lit("/"), F.col("doc_id").cast("string"), F.lit(".bin")).alias("path"),
                    F.encode(F.col("text"), "UTF-8").alias("content")))


def labelled_docs(spark: SparkSession, sf: str) -> DataFrame:
    """documents joined to their label (quality); documents without one are left out."""
    d = table(spark, sf, "documents", "doc_id", "text", "lang", "source", "n_chars")
    lab = table(spark, sf, "labels", "doc_id", "quality")
    return d.join(lab, "doc_id").withColumnRenamed("quality", "label")


def doc_counts(df: DataFrame) -> DataFrame:
    """Numeric per-document counts used as features and as model stand-ins."""
    return (df.withColumn("n_lines", F.size(F.split(F.col("text"), "\n")).cast("bigint"))
              .withColumn("n_words", F.size(F.split(F.col("text"), " ")).cast("bigint")))


def _score(col: str, scale: float):
    return F.round(F.least(F.lit(1.0), F.col(col) / F.lit(scale)), 4)


def scored(spark: SparkSession, sf: str, model: str = "chars") -> DataFrame:
    """(id, label, score, prediction) for one stand-in model."""
    c, s = MODEL_SCORES[model]
    df = doc_counts(labelled_docs(spark, sf))
    return df.select(F.col("doc_id").alias("id"), F.col("label"), _score(c, s).alias("score")) \
        .withColumn("prediction", (F.col("score") >= F.lit(THRESHOLD)).cast("int"))


def scored_models(spark: SparkSession, sf: str) -> DataFrame:
    """Long table (model, id, label, score, prediction) for all stand-in models in one scan."""
    df = doc_counts(labelled_docs(spark, sf))
    arr = F.array(*[F.struct(F.lit(m).alias("model"), _score(c, s).alias("score"))
                    for m, (c, s) in MODEL_SCORES.items()])
    return (df.select(F.col("doc_id").alias("id"), "label", F.inline(arr))
              .withColumn("prediction", (F.col("score") >= F.lit(THRESHOLD)).cast("int")))


def instructions(spark: SparkSession, sf: str) -> DataFrame:
    """documents as disassembly: a line is a basic block, its lower-case words are the mnemonic
    field of one instruction ``'<idx>:\\t<words>\\t'``."""
    d = table(spark, sf, "documents", "doc_id", "text")
    lines = d.select(F.col("doc_id").alias("binary_id"), F.posexplode(F.split(F.col("text"), "\n")).alias("node_idx", "line"))
    return lines.select(
        "binary_id", F.col("node_idx").cast("int").alias("node_idx"), F.lit(0).alias("pos"),
        F.concat(F.col("node_idx").cast("string"), F.lit(":\t"),
                 F.array_join(F.regexp_extract_all(F.lower(F.col("line")), F.lit("[a-z]+"), 0), " "),
                 F.lit("\t")).alias("text"))


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    """(binary_id, node_idx, size, is_api): size = bytes of the line; a line without words is an
    API stub (no code)."""
    d = table(spark, sf, "documents", "doc_id", "text")
    lines = d.select(F.col("doc_id").alias("binary_id"), F.posexplode(F.split(F.col("text"), "\n")).alias("node_idx", "line"))
    return lines.select("binary_id", F.col("node_idx").cast("int").alias("node_idx"),
                        F.octet_length(F.col("line")).cast("int").alias("size"),
                        (F.size(F.regexp_extract_all(F.lower(F.col("line")), F.lit("[a-z]+"), 0)) == 0).alias("is_api"))


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events", "event_id", "ts", "user_id", "event_type")
