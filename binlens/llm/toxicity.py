"""Toxicity scores from a factorization machine over hashed terms.

A text's features are the hashed terms it contains (words of letters in lower case, and their first four
and five letters), present or not. The machine scores ``w0 + sum w_i + sum over pairs <v_i, v_j>``, so
pairs such as an insult with a group mention get a weight of their own, also where neither term tells
anything alone: every pair of frequent terms is tested for an interaction. It is fitted on a bounded sample
of labelled rows (``SAMPLE_ROWS`` of each class at most, chosen by a hash of the id) and then scores
every text of any length in place: texts stream through the workers once and nothing is shuffled.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binlens.llm.common import held_out, text_runs, utf8

BITS = 20
#: The documented bound of the training sample, for each class.
SAMPLE_ROWS = 4000
#: Hashed terms the machine keeps for what they tell alone, by chi-squared in the sample.
ACTIVE = 1 << 11
#: Terms it keeps besides for what they tell in a pair, and the frequent terms whose pairs are all tested for that.
PAIRED = 1 << 8
PAIR_TERMS = 1 << 11
#: Squared z of a pair's interaction from which it counts: 0.0005 false ones expected among all pairs tested.
PAIR_Z2 = 40.0
RANK = 4
RUN_BYTES = 4_000_000
_WORDS = re.compile(r"[^\W\d_]+")
STEMS = (4, 5)


def word_terms(word: str) -> tuple[int, ...]:
    """Hash slots of a lower-case word and its stems."""
    mask = (1 << BITS) - 1
    out = [zlib.crc32(word.encode()) & mask]
    out += [zlib.crc32(b"^" + word[:k].encode()) & mask for k in STEMS if len(word) >= k]
    return tuple(out)


def text_terms(texts: list[bytes | None], cache: dict) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) of every distinct term of every text."""
    rows, terms = [], []
    for i, t in enumerate(texts):
        found = set(_WORDS.findall(t.decode("utf-8", "replace").lower())) if t else ()
        for w in found:
            got = cache.get(w)
            if got is None:
                got = cache[w] = word_terms(w)
            terms.extend(got)
        rows.append(len(terms))
    row = np.repeat(np.arange(len(texts)), np.diff([0, *rows]))
    key = np.unique(row * (1 << BITS) + np.array(terms, np.int64))
    return key >> BITS, key & ((1 << BITS) - 1)


def sample_terms(texts: list[bytes | None], chunk: int = 250) -> tuple[np.ndarray, np.ndarray]:
    """``text_terms`` of a whole sample, a chunk of texts at a time, as small integers."""
    parts, cache = [], {}
    for lo in range(0, max(len(texts), 1), chunk):
        row, term = text_terms(texts[lo:lo + chunk], cache)
        parts.append(((row + lo).astype(np.int32), term.astype(np.int32)))
    return np.concatenate([r for r, _ in parts]), np.concatenate([t for _, t in parts])


class Machine:
    """``terms`` (sorted slots) with weights ``w``, factors ``v`` and bias ``b``."""

    def __init__(self, terms, w, v, b):
        self.terms, self.w, self.v, self.b = terms, w, v, b
        self.place = np.full(1 << BITS, -1, np.int32)
        self.place[terms] = np.arange(len(terms))

    def state(self):
        return self.terms, self.w, self.v, self.b

    def active(self, row, term):
        p = self.place[term]
        return row[p >= 0], p[p >= 0]

    def margins(self, row: np.ndarray, p: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Margin of each of ``n`` texts, and their factor sums."""
        out = np.full(n, self.b) + np.bincount(row, self.w[p], n)
        sums = np.stack([np.bincount(row, self.v[p, f], n) for f in range(self.v.shape[1])], 1).astype(float)   # no terms: integers
        squares = np.bincount(row, (self.v[p] ** 2).sum(1), n)
        return out + 0.5 * ((sums**2).sum(1) - squares), sums

    def scores(self, texts, cache) -> np.ndarray:
        m, _ = self.margins(*self.active(*text_terms(texts, cache)), len(texts))
        return 1 / (1 + np.exp(-np.clip(m, -30, 30)))


def chi_squared(term: np.ndarray, label: np.ndarray, positives: int, total: int) -> np.ndarray:
    """Chi-squared of presence against the label for every slot; ``label`` is that of each term's row."""
    n = np.bincount(term, minlength=1 << BITS).astype(float)
    a = np.bincount(term[label == 1], minlength=1 << BITS).astype(float)
    expect = n * positives / total
    spread = expect * (1 - positives / total) * np.maximum(1 - n / total, 1 / total)
    return np.where(n >= 2, (a - expect) ** 2 / np.maximum(spread, 1e-9), 0)


def interactions(row: np.ndarray, term: np.ndarray, labels: np.ndarray, most: int = PAIR_TERMS, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(terms, z2): the ``most`` frequent terms in 20 texts or more, and each one's strongest interaction with another.

    The contrast of a pair is the rate of label 1 with both terms, less that with each alone, plus that with neither: zero where
    the terms add up. ``z2`` is its square over its variance; all four cases need 5 texts. Counts of all pairs are products of
    blocks of the 0/1 matrix of the sample, so memory is rows x ``most`` floats.
    """
    n = np.bincount(term, minlength=1 << BITS)
    total = len(labels)
    spread = np.minimum(n, total - n)                       # a term of every text has no contrast
    terms = np.argsort(-spread, kind="stable")[:most]
    terms = np.sort(terms[spread[terms] >= 20])
    k = len(terms)
    place = np.full(1 << BITS, -1, np.int64)
    place[terms] = np.arange(k)
    p = place[term]
    x = np.zeros((total, k), np.float32)
    x[row[p >= 0], p[p >= 0]] = 1
    toxic = x[labels == 1]
    count, hits, positives = n[terms].astype(np.float32), toxic.sum(0), float(len(toxic))
    best = np.zeros(k)
    for lo in range(0, k, block):
        hi = min(lo + block, k)
        n11, t11 = x[:, lo:hi].T @ x[:, lo:], toxic[:, lo:hi].T @ toxic[:, lo:]      # pairs with later terms only
        a, b, ta, tb = count[lo:hi, None], count[None, lo:], hits[lo:hi, None], hits[None, lo:]
        contrast, variance, least = 0.0, 0.0, np.full(n11.shape, np.inf, np.float32)
        for sign, size, found in ((1, n11, t11), (-1, a - n11, ta - t11), (-1, b - n11, tb - t11),
                                  (1, total - a - b + n11, positives - ta - tb + t11)):
            share = (found + 0.5) / (size + 1)
            contrast = contrast + sign * share
            variance = variance + share * (1 - share) / (size + 1)
            least = np.minimum(least, size)
        z2 = np.where(least >= 5, contrast**2 / variance, 0)
        best[lo:hi] = np.maximum(best[lo:hi], z2.max(1))
        best[lo:] = np.maximum(best[lo:], z2.max(0))
    return terms, best


def fit_machine(texts: list[bytes | None], labels: np.ndarray, passes: int = 90, seed: int = 5, rate: float = 0.1,
                decay: float = 0.1, rank: int = RANK, active: int = ACTIVE, paired: int = PAIRED) -> Machine:
    """Full-batch Adagrad on the class-balanced logistic loss. One class only: its constant score.

    The terms are the ``active`` most telling alone and the ``paired`` that tell most in a pair.
    """
    labels = np.asarray(labels, float)
    rng = np.random.default_rng(seed)
    positives, n = labels.sum(), len(labels)
    if positives in (0, n):
        rate_of = (positives + 0.5) / (n + 1)
        return Machine(np.empty(0, np.int64), np.zeros(0), np.zeros((0, rank)), float(np.log(rate_of / (1 - rate_of))))
    row, term = sample_terms(texts)
    chi = chi_squared(term, labels[row], positives, n)
    top = np.argsort(-chi, kind="stable")[:active]
    frequent, z2 = interactions(row, term, labels)
    strong = np.argsort(-z2, kind="stable")[:paired]
    model = Machine(np.union1d(top[chi[top] > 3.84], frequent[strong[z2[strong] > PAIR_Z2]]), None, None, 0.0)
    k = len(model.terms)
    model.w, model.v = np.zeros(k), rng.normal(0, 0.02, (k, rank))
    step = np.where(np.isin(model.terms, frequent[z2 > PAIR_Z2]), 1.0, 0.2)[:, None] * rate     # a pair's terms lean on their factors
    row, p = model.active(row, term)
    weight = np.where(labels == 1, 0.5 / positives, 0.5 / (n - positives))
    gw, gv, gb = np.full(k, 1e-8), np.full((k, rank), 1e-8), 1e-8
    for _ in range(passes):
        m, sums = model.margins(row, p, n)
        g = weight * (1 / (1 + np.exp(-np.clip(m, -30, 30))) - labels)
        dw = np.bincount(p, g[row], k) + decay * model.w / max(k, 1)
        dv = np.stack([np.bincount(p, g[row] * sums[row, f], k) for f in range(rank)], 1).astype(float)
        dv -= np.bincount(p, g[row], k)[:, None] * model.v
        dv += decay * model.v / max(k, 1)
        db = g.sum()
        gw, gv, gb = gw + dw**2, gv + dv**2, gb + db**2
        model.w -= rate * dw / np.sqrt(gw)
        model.v -= step * dv / np.sqrt(gv)
        model.b -= rate * db / np.sqrt(gb)
    return model


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> list:
    """(text, label) of at most ``rows`` documents of each class, by a hash of the id; none is held out."""
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col), 5, 0) & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__y"))
    order = [F.xxhash64("__id"), F.col("__id")]
    picked = None
    for y in (0, 1):
        part = known.where(F.col("__y") == y).orderBy(*order).limit(rows)
        picked = part if picked is None else picked.unionAll(part)
    found = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text")).join(
        picked, F.col("__doc") == F.col("__id"))
    got = found.groupBy("__doc", "__y").agg(F.min("__text").alias("__text")).collect()     # at most 2 * rows
    return sorted(((r["__text"].encode() if r["__text"] else None, r["__y"]) for r in got), key=lambda x: (x[1], x[0] or b""))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id_col, held_out, score, predicted) for every row of ``docs``.

    Only labels of documents with crc32(id) mod 5 other than 0 are learnt from. Null and empty texts get
    the score of a text without terms; null ids are scored too (their crc32 is that of ''); repeated rows
    are scored one by one; a document's repeated labels count as toxic if one is. Labels other than 0 and
    1 (null too) are ignored; without labels of both classes the score is one constant. Empty documents:
    no rows. Other columns are not read.
    """
    sample = training_sample(docs, labels, id_col, text_col, label_col, sample_rows)
    model = fit_machine([t for t, _ in sample], np.array([y for _, y in sample]))
    sent = docs.sparkSession.sparkContext.broadcast(model.state())      # ACTIVE + PAIRED terms at most
    src = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col), 5, 0).alias("held_out"), F.col(text_col).alias("text"))

    def run(batches):
        machine, cache = Machine(*sent.value), {}
        for b in batches:
            raw = utf8(b, "text")
            out = []
            for lo, hi in text_runs(raw, RUN_BYTES):
                out.append(machine.scores(raw[lo:hi], cache))
                if len(cache) > 2_000_000:
                    cache.clear()
            score = np.concatenate(out) if out else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                                             names=["id", "held_out", "score", "predicted"])

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
