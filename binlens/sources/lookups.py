"""Category dictionaries (A6) as small lookup DataFrames.

A dictionary maps a category to a list of tokens; it becomes a ``(category, opcode)`` table
that is broadcast (its row count is known, so the broadcast is size-checked by construction).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from binlens.functions.sizing import maybe_broadcast


def load_dictionary(source, spark: SparkSession | None = None) -> dict[str, list[str]]:
    """``source`` is a mapping or the path of a YAML file of ``category: [token, ...]``, on any file system that
    Spark reads. An empty file has no categories, an empty category no tokens; anything but a mapping is an error."""
    if not isinstance(source, dict):
        import yaml

        spark = spark or SparkSession.getActiveSession()
        text = spark.read.text(source, wholetext=True).first()
        source = (yaml.safe_load(text[0]) if text else None) or {}
        if not isinstance(source, dict):
            raise ValueError("a dictionary file holds a mapping of categories to lists of tokens")
    return {str(k): [str(t) for t in (v or [])] for k, v in source.items()}


def dictionary_frame(spark: SparkSession, source) -> DataFrame:
    d = load_dictionary(source, spark)
    rows = [(c, t.lower()) for c, toks in d.items() for t in toks]
    df = spark.createDataFrame(rows, "category string, opcode string").distinct()
    return maybe_broadcast(df, known_rows=len(rows))


# The seven-category word list that stands in for the opcode dictionary when the
# instruction table is derived from prose (documents). A word may sit in two categories.
WORD_CATEGORIES = {
    "arithmetic": ["un", "une", "ein", "eine", "uno", "una", "one"],
    "bit_manipulation": ["de", "del", "der", "des", "du", "of"],
    "control_flow": ["if", "si", "wenn", "then", "puis", "dann"],
    "data_manipulation": ["the", "le", "la", "les", "el", "los", "die", "das"],
    "flags": ["not", "ne", "pas", "nicht", "no"],
    "logical": ["and", "et", "und", "y", "or", "ou", "oder", "o"],
    "system": ["is", "est", "ist", "es", "que", "qui", "la"],
}
