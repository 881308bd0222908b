"""binlens: a Spark-native engine for classifying large corpora of binary files.

Files become tables (dedup, little-endian header decoding, section flattening, byte n-grams,
opcode-category counts, graph features); tables become training sets (union by name, alignment,
typed fills, one-hot, MI / chi-squared selection, scaling, matrix reduction); classifiers are
fitted and combined on Spark ML; every evaluation is an ordinary DataFrame.
"""

from binlens.session import get_session, checkpoint_dir  # noqa: F401

__all__ = ["get_session", "checkpoint_dir"]
