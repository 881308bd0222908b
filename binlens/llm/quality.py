"""Quality rules: word-count and repetition limits, then robust multivariate outliers.

Statistics of every text become a vector (``features``). Per language and source the
minimum-covariance-determinant estimate of its mean and covariance is found by concentration steps over
all rows: start from a median/MAD scale, then repeatedly take the ``share`` of the rows with the smallest
Mahalanobis distance and re-estimate from them. A text is rejected when its distance exceeds ``cutoff``
(after the usual rescaling of the median distance to that of the chi-squared law).

Every step is one aggregation of sums per group. The distance quantile of a group comes from counts over
a fixed logarithmic grid, so no group is ever gathered, sorted or sampled, and a rerun gives the same
result. Groups under ``min_rows`` rows use their language's estimate, and languages under it that of
all rows.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binlens.llm.common import materialise, utf8

SYMBOLS = "[#*$%&|<>]"
_SYMBOLS = re.compile(SYMBOLS.encode())
DIMENSIONS = 5
#: Median of the chi-squared law with five degrees of freedom.
CHI2_MEDIAN = 4.351460191095529
#: The distance grid: GRID bins for each doubling.
GRID = 64
#: Parts that the rows of one group are spread over when they meet its estimate.
SALTS = 32

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
X = [f"x{i}" for i in range(DIMENSIONS)]
PAIRS = [(i, j) for i in range(DIMENSIONS) for j in range(i, DIMENSIONS)]


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words inside ``window``-word windows that occur twice or more (first occurrence included)."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) ** window < 2**62:
        key = code[:n].copy()
        for i in range(1, window):
            key = key * len(ids) + code[i:n + i]
    else:       # number the windows by pairs, so codes stay small
        key = code[:n]
        for i in range(1, window):
            key = np.unique(key * len(ids) + code[i:n + i], return_inverse=True)[1]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(len(words), bool)
    for i in range(window):
        inside[i:n + i] |= twice
    return int(inside.sum())


def _points(text: bytes) -> int:
    a = np.frombuffer(text, np.uint8)
    return int(((a & 0xC0) != 0x80).sum())


def text_stats(text: bytes | None) -> tuple[int, int, int, int, int]:
    """The five base statistics of a UTF-8 text (null: none of anything)."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.split()
    points = len(text) if text.isascii() else _points(text)
    spaces = sum(text.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (len(words), points - spaces, len(_SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated_words(words))


def features(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) -> np.ndarray:
    """Transformed statistic vectors: log length, mean word length, and square-root shares (they are
    steadier near zero) of symbols, duplicate lines and repeated words."""
    w = np.maximum(np.asarray(n_words, float), 1)
    return np.stack([np.log1p(w), np.asarray(word_chars) / w, np.sqrt(np.asarray(n_symbols) / w),
                     np.sqrt(np.asarray(n_dup_lines) / w), np.sqrt(np.asarray(n_repeat_words) / w)])


def text_statistics(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", source_col="source") -> DataFrame:
    """(id, key, lang, source, five statistics, x0..x4); ``key`` is a hash of the text."""
    src = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"),
                      F.col(source_col).cast("string").alias("source"),
                      F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), F.col(text_col).alias("text"))

    def run(batches):
        for b in batches:
            rows = [text_stats(t) for t in utf8(b, "text")]
            s = np.array(rows, np.int64).reshape(-1, len(STATS)).T
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *map(pa.array, s), *map(pa.array, features(*s))],
                                             names=["id", "lang", "source", "key", *STATS, *X])

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, lang string, source string, key long, "
                               + ", ".join(f"{c} long" for c in STATS) + ", " + ", ".join(f"{c} double" for c in X))


def _levels(df: DataFrame) -> DataFrame:
    """Each row once per estimate it feeds: its (language, source), its language, and all."""
    g = F.array(F.struct(F.lit(0).alias("level"), F.to_json(F.struct("lang", "source")).alias("grp")),
                F.struct(F.lit(1).alias("level"), F.to_json(F.struct("lang")).alias("grp")),
                F.struct(F.lit(2).alias("level"), F.lit("all").alias("grp")))
    return df.withColumn("g", F.explode(g)).select("g.level", "g.grp", F.pmod(F.xxhash64(*X), F.lit(SALTS)).cast("int").alias("salt"), *X)


def _with(rows: DataFrame, per_group: DataFrame) -> DataFrame:
    """``rows`` with the columns of their group's one row; a group's rows meet SALTS copies of it, so the
    rows of a hot group (all rows are one) don't meet in one task."""
    copies = per_group.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(copies, ["level", "grp", "salt"])


def _cell(d):
    """Bin of a non-negative value on the logarithmic grid."""
    return F.floor(F.log2(d + F.lit(1e-12)) * GRID).cast("long")


def _quantile(rows: DataFrame, value, share: float, name: str) -> DataFrame:
    """(level, grp, name): the grid bin that holds the ``share`` quantile of ``value`` in each group."""
    cells = rows.groupBy("level", "grp", value.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("level", "grp").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("level", "grp")
    cum = cells.select("level", "grp", "cell", F.sum("n").over(by).alias("c"), F.sum("n").over(every).alias("t"))
    return cum.where(F.col("c") >= F.col("t") * share).groupBy("level", "grp").agg(F.min("cell").alias(name))


def _moments(rows: DataFrame) -> DataFrame:
    sums = [F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(c).alias(f"s_{c}") for c in X],
            *[F.sum(F.col(X[i]) * F.col(X[j])).alias(f"p_{i}_{j}") for i, j in PAIRS]]
    return rows.groupBy("level", "grp").agg(*sums)


#: Least standard deviation of each feature: spread under it never makes a text an outlier.
FLOOR = np.array([0.25, 0.25, 0.06, 0.06, 0.12])
SHAPE = "level int, grp string, mean array<double>, inv array<double>, n double"


def _estimates(moments: DataFrame) -> DataFrame:
    """(level, grp, mean, inverse covariance, n) from sums; a floor keeps flat directions invertible."""
    def run(frames):
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                mean = np.array([r[f"s_{c}"] for c in X]) / r["n"]
                cov = np.zeros((DIMENSIONS, DIMENSIONS))
                for i, j in PAIRS:
                    cov[i, j] = cov[j, i] = r[f"p_{i}_{j}"] / r["n"] - mean[i] * mean[j]
                cov += np.diag(FLOOR**2)
                out.append((r["level"], r["grp"], mean.tolist(), np.linalg.inv(cov).ravel().tolist(), r["n"]))
            yield pd.DataFrame(out, columns=["level", "grp", "mean", "inv", "n"])
    return moments.mapInPandas(run, SHAPE)


def _distance():
    """Squared Mahalanobis distance of x0..x4 to ``mean`` under ``inv``."""
    d = [F.col(c) - F.col("mean")[i] for i, c in enumerate(X)]
    terms = [F.col("inv")[i * DIMENSIONS + j] * d[i] * d[j] * (1 if i == j else 2) for i, j in PAIRS]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.greatest(total, F.lit(0.0))


def mcd_estimates(stats: DataFrame, share: float = 0.75, steps: int = 5) -> DataFrame:
    """(level, grp, mean, inv, n, scale) for every group of rows in ``stats`` (written, not lazy)."""
    rows = _levels(stats)
    # start: per-feature medians and MADs on a fixed linear grid
    cell = F.floor(F.col("v") * 512).cast("long")
    flat = rows.select("level", "grp", "salt", F.posexplode(F.array(*X)).alias("i", "v"))
    tagged = flat.select("level", F.concat(F.col("i").cast("string"), F.lit(":"), "grp").alias("grp"), "salt", "v")
    med = _quantile(tagged, cell, 0.5, "m")
    dev = _with(tagged, med).withColumn("v", F.abs(F.col("v") - (F.col("m") + 0.5) / 512))
    mad = _quantile(dev, F.floor(F.col("v") * 512).cast("long"), 0.5, "d")
    start = (med.join(mad, ["level", "grp"])
             .select("level", F.split("grp", ":", 2)[0].cast("int").alias("i"), F.split("grp", ":", 2)[1].alias("grp"),
                     ((F.col("m") + 0.5) / 512).alias("m"), (1.4826 * (F.col("d") + 0.5) / 512).alias("s")))
    start = start.groupBy("level", "grp").agg(F.array_sort(F.collect_list(F.struct("i", "m", "s"))).alias("a"))
    floor = F.array(*[F.lit(float(x)) for x in FLOOR])
    inv = F.flatten(F.transform("a", lambda p: F.transform(F.sequence(F.lit(0), F.lit(DIMENSIONS - 1)), lambda j: F.when(
        j == p["i"], 1.0 / (p["s"] * p["s"] + F.element_at(floor, p["i"] + 1) * F.element_at(floor, p["i"] + 1))).otherwise(0.0))))
    est = materialise(start.select("level", "grp", F.transform("a", lambda p: p["m"]).alias("mean"), inv.alias("inv"),
                                   F.lit(0.0).alias("n")), "mcd-start")
    for _ in range(steps):
        near = _with(rows, est.drop("n")).withColumn("cell", _cell(_distance()))
        edge = _quantile(near, F.col("cell"), share, "edge")
        inner = _with(near, edge).where(F.col("cell") <= F.col("edge"))
        est = materialise(_estimates(_moments(inner)), "mcd-step")
    near = _with(rows, est).withColumn("cell", _cell(_distance()))
    mid = _quantile(near, F.col("cell"), 0.5, "mid")
    scale = F.greatest(F.pow(F.lit(2.0), (F.col("mid") + 1) / GRID) / CHI2_MEDIAN, F.lit(1.0))
    total = rows.groupBy("level", "grp").agg(F.count(F.lit(1)).alias("rows"))
    return materialise(est.join(mid, ["level", "grp"]).join(total, ["level", "grp"])
                       .select("level", "grp", "mean", "inv", scale.alias("scale"), "rows"), "mcd")


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                     source_col: str = "source", least_words: int = 50, most_repeated: float = 0.5,
                     cutoff: float = 70.0, min_rows: int = 100, share: float = 0.75) -> DataFrame:
    """(id, key, lang, source, statistics, base_failed, distance, kept) for every row of ``docs``.

    ``base_failed``: under ``least_words`` words, or over ``most_repeated`` of them in repeated 3-word
    windows. The estimates are fitted on the rows that pass that; failed rows have no distance. Null and
    empty texts have no words and fail. Null language or source is a value of its own. Null ids and
    repeated rows stay as they are; extra columns are not read. Empty input: no rows.
    """
    stats = text_statistics(docs, id_col, text_col, lang_col, source_col)
    failed = (F.col("n_words") < least_words) | (F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    stats = materialise(stats.withColumn("base_failed", failed), "quality-stats")
    est = mcd_estimates(stats.where("not base_failed"), share)
    big = est.where((F.col("rows") >= min_rows) | (F.col("level") == 2))
    mine = stats.select("lang", "source").distinct().select("lang", "source", F.explode(F.array(
        F.struct(F.lit(0).alias("level"), F.to_json(F.struct("lang", "source")).alias("grp")),
        F.struct(F.lit(1).alias("level"), F.to_json(F.struct("lang")).alias("grp")),
        F.struct(F.lit(2).alias("level"), F.lit("all").alias("grp")))).alias("g"))
    mine = mine.select("lang", "source", "g.*").join(big, ["level", "grp"])
    best = mine.groupBy(F.col("lang").alias("l2"), F.col("source").alias("s2")).agg(
        F.min_by(F.struct("mean", "inv", "scale"), "level").alias("e"))
    best = best.select("l2", "s2", "e.*")
    out = stats.join(best, F.col("lang").eqNullSafe(F.col("l2")) & F.col("source").eqNullSafe(F.col("s2")), "left")
    out = out.withColumn("distance", F.when(~F.col("base_failed"), _distance() / F.col("scale")))
    return out.select("id", "key", "lang", "source", *STATS, "base_failed", "distance",
                      (~F.col("base_failed") & (F.col("distance") <= cutoff)).alias("kept"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
              source_col: str = "source", **limits) -> DataFrame:
    """``docs`` without the rows that ``quality_verdicts`` rejects; columns and repeated rows unchanged."""
    good = quality_verdicts(docs, id_col, text_col, lang_col, source_col, **limits).where("kept").select(
        F.col("id").alias("__i"), F.col("key").alias("__k"), F.col("lang").alias("__l"), F.col("source").alias("__s")).distinct()
    rows = docs.select(F.struct("*").alias("__row"), F.col(id_col).alias("__id"),
                       F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__key"),
                       F.col(lang_col).cast("string").alias("__lang"), F.col(source_col).cast("string").alias("__source"))
    on = (F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__key") == F.col("__k"))
          & F.col("__lang").eqNullSafe(F.col("__l")) & F.col("__source").eqNullSafe(F.col("__s")))
    return rows.join(good, on, "left_semi").select("__row.*")
