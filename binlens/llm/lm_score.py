"""Language-model scores from a log-frequency Bloom filter.

The filter holds the quantised counts of all words and word pairs of the training texts: an n-gram of count
``c`` is inserted with levels 1 to ``1 + floor(log_b(c))``, and its count is read back by probing level after
level until one is absent. It grows with the distinct n-grams and is cut into regions by n-gram hash, as many
as keep a region's share of the input small, so no task and not the driver holds all of it.

1. Words are counted over all training texts (map-side sums, then one aggregation).
2. Texts are packed into runs of ``RUN_BYTES``. A run sends each region its distinct n-grams there, with how
   often the run's training texts have them.
3. A region adds the counts, builds its bits, probes every n-gram it was sent and answers each run with levels.
4. A run meets its answers and scores its texts: the probability of a word interpolates the pair and word
   estimates, both from filter probes. The exact add-one score takes the counts of words of at least the
   ``VOCABULARY`` share of all tokens (at most ``1 / VOCABULARY`` words) from a broadcast and the other words'
   by a join on the word, partial sums added per text.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binlens.llm.common import held_out, materialise, mix64, text_runs, utf8, words_of

VOCABULARY = 5e-7
BASE = math.sqrt(2.0)
#: Weight of the pair estimate.
PAIR_WEIGHT = 0.15
HASHES = 4
BITS_PER_LEVEL = 10
REGIONS = 64
RUN_BYTES = 4_000_000
#: Bytes of text for each region beyond ``REGIONS`` of them.
REGION_BYTES = 6_000_000
#: Words held by a counting task before it passes its sums on.
HELD = 2_000_000
#: The token after the last word; no word is empty.
END = b""
_ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _hash_word(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 42)     # what F.xxhash64 gives for the string


def pair_hash(key: np.ndarray) -> np.ndarray:
    """Gram hash of 64-bit pair keys."""
    return mix64(key.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))


def pair_gram(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Gram hash of word pairs from the words' hashes."""
    return pair_hash(mix64(first) * _TWO + second)


def levels_of(count, tau: float):
    """Levels inserted for counts of ``tau`` or more."""
    return 1 + np.floor(np.log(np.asarray(count, float) / tau) / math.log(BASE) + 1e-9).astype(np.int64)


def level_count(levels: np.ndarray, tau: float) -> np.ndarray:
    """The count that a number of levels stands for: the middle of its step; none: 0."""
    return np.where(levels > 0, tau * BASE ** (levels - 1) * math.sqrt(BASE), 0.0)


def _places(gram: np.ndarray, level, bits: int):
    """Bit positions (one array for each hash) of gram hashes at a level inside their region."""
    x = mix64(gram + np.asarray(level).astype(np.uint64) * _ONE)
    step = mix64(x + _TWO) | np.uint64(1)
    for i in range(HASHES):
        yield ((x + np.uint64(i) * step) % np.uint64(bits)).astype(np.int64)


def region_of(gram: np.ndarray) -> np.ndarray:
    return (gram >> np.uint64(58)).astype(np.int64)


def filter_bytes(levels: int, regions: int = 1) -> int:
    """Bytes of a region for a number of levels inserted in all ``regions``."""
    return max(64, math.ceil(levels * BITS_PER_LEVEL * 1.1 / regions / 8))


def insert(mine: np.ndarray, gram: np.ndarray, levels: np.ndarray):
    """Set the bits (one bool each) of gram hashes at levels 1 to ``levels`` in a region."""
    for j in range(1, int(levels.max(initial=0)) + 1):
        for p in _places(gram[levels >= j], j, len(mine)):
            mine[p] = True


class Filter:
    def __init__(self, regions: np.ndarray, tau: float):
        self.regions, self.tau = regions, tau       # (REGIONS or 1, bytes)
        self.bits = regions.shape[1] * 8
        self.flat = regions.ravel()

    def levels(self, gram: np.ndarray) -> np.ndarray:
        """Levels present for each gram hash: probes go on only for grams whose last probe succeeded."""
        out = np.zeros(len(gram), np.int64)
        left = np.arange(len(gram))
        base = (region_of(gram) if len(self.regions) > 1 else np.zeros(len(gram), np.int64)) * self.regions.shape[1]
        level = 0
        while len(left):
            level += 1
            here = np.ones(len(left), bool)
            for p in _places(gram[left], level, self.bits):
                here &= (self.flat[base[left] + (p >> 3)] >> (p & 7).astype(np.uint8)) & 1 == 1
            left = left[here]
            out[left] = level
        return out

    def counts(self, gram: np.ndarray) -> np.ndarray:
        return level_count(self.levels(gram), self.tau)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over rows of (text): every word, and '' once per text."""
    def run(batches):
        held: Counter = Counter()

        def rows():
            words = pa.array(list(held), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for t in utf8(b, "text"):
                held.update(words_of(t))
                held[END] += 1
                if len(held) > HELD:
                    yield rows()
                    held.clear()
        if held:
            yield rows()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


class Grams:
    """Words and pairs of texts, each text closed by END and preceded by it."""

    def __init__(self, texts: list[bytes | None]):
        tokens, lengths = [], []
        for t in texts:
            words = words_of(t)
            words.append(END)
            tokens += words
            lengths.append(len(words))
        self.lengths = np.array(lengths, np.int64)
        self.words = list(dict.fromkeys(tokens))        # distinct, ``word`` numbers them
        ids = {w: i for i, w in enumerate(self.words)}
        self.word = np.fromiter(map(ids.__getitem__, tokens), np.int32, len(tokens))
        del tokens
        self.before = np.roll(self.word, 1)
        self.before[np.cumsum(self.lengths) - self.lengths] = ids.get(END, 0)
        key, pair = np.unique(self.before.astype(np.int64) * len(self.words) + self.word, return_inverse=True)
        self.pair = pair.astype(np.int32)
        hashes = np.fromiter(map(_hash_word, self.words), np.uint64, len(self.words))
        n = max(len(self.words), 1)
        both = np.concatenate((hashes, pair_gram(hashes[key // n], hashes[key % n])))
        #: sorted distinct gram hashes (of 56 bits, the lowest 8 are 0), and where each distinct word and pair is in them
        self.grams, at = np.unique(both & ~np.uint64(255), return_inverse=True)
        self.word_at, self.pair_at = at[:len(hashes)], at[len(hashes):]

    def times(self, counted: np.ndarray) -> np.ndarray:
        """How often each gram occurs in the texts marked by ``counted``."""
        w = np.repeat(counted, self.lengths)
        out = np.bincount(self.word_at[self.word[w]], minlength=len(self.grams))
        return out + np.bincount(self.pair_at[self.pair[w]], minlength=len(self.grams))


def pack_runs(src: DataFrame) -> DataFrame:
    """(run, size, packed): rows of ``src`` (with text) in compressed runs of ``RUN_BYTES`` of text, one text at least."""
    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def row():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for x in held:
                    out.write_batch(x)
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | made]), pa.array([size]), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                                              names=["run", "size", "packed"])

        for b in batches:
            raw = utf8(b, "text")
            for lo, hi in text_runs(raw, RUN_BYTES):
                n = sum(len(t) for t in raw[lo:hi] if t)
                if held and size + n > RUN_BYTES:
                    yield row()
                    held, size, made = [], 0, made + 1
                held.append(b.slice(lo, hi - lo))
                size += n
        if held:
            yield row()

    return src.mapInArrow(run, "run long, size long, packed binary")


def unpacked(packed) -> pa.RecordBatch:
    return pa.ipc.open_stream(pa.py_buffer(packed)).read_all().combine_chunks().to_batches()[0]


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers byte by byte of all, compressed: sorted hashes share their high bytes, most counts are small."""
    width = numbers.dtype.itemsize
    data = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, width).T).tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _from_planes(data: bytes, kind) -> np.ndarray:
    data = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    planes = np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def gram_levels(runs: DataFrame, regions: int) -> DataFrame:
    """(run, region, levels): filter levels of each run's sorted distinct grams, a byte each, in ``regions``
    (a power of two) ranges of the gram hash. The filter holds the grams of rows that are not held out."""
    shift = np.uint64(64 - (regions.bit_length() - 1))

    def probes(batches):
        for b in batches:
            for run, packed in zip(b.column(0).to_pylist(), b.column(1)):
                rows = unpacked(packed.as_buffer())
                g = Grams(utf8(rows, "text"))
                times = g.times(~rows.column("held_out").to_numpy(zero_copy_only=False).astype(bool)).astype(np.uint32)
                of = (g.grams >> shift).astype(np.int64)
                there = np.unique(of)
                lo, hi = np.searchsorted(of, there, "left"), np.searchsorted(of, there, "right")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(there.astype(np.int32)), pa.array([run] * len(there), pa.int64()),
                     pa.array([_planes(g.grams[i:j]) for i, j in zip(lo, hi)], pa.binary()),
                     pa.array([_planes(times[i:j]) for i, j in zip(lo, hi)], pa.binary())],
                    names=["region", "run", "grams", "times"])

    def answer(table):
        # a region's share of the input is bounded by the number of regions
        grams = [_from_planes(x, np.uint64) for x in table.column("grams").to_pylist()]
        ends = np.cumsum([len(x) for x in grams])
        gram, back = np.unique(np.concatenate(grams), return_inverse=True)
        del grams
        times = np.concatenate([_from_planes(x, np.uint32) for x in table.column("times").to_pylist()])
        c = np.bincount(back, times).astype(np.int64)
        top = levels_of(c[c > 0], 1.0)
        mine = np.zeros(filter_bytes(int(top.sum())) * 8, bool)
        insert(mine, gram[c > 0], top)
        levels = Filter(np.packbits(mine, bitorder="little")[None], 1.0).levels(gram).astype(np.uint8)[back]
        out = [x.tobytes() for x in np.split(levels, ends[:-1])]
        return pa.table([table.column("run"), table.column("region"), pa.array(out, pa.binary())], names=["run", "region", "levels"])

    sent = runs.select("run", "packed").mapInArrow(probes, "region int, run long, grams binary, times binary")
    return sent.groupBy("region").applyInArrow(answer, "run long, region int, levels binary")


class Vocabulary:
    """Frequent words by id, with their exact counts."""

    def __init__(self, words: list[bytes], counts):
        self.words, self.counts = words, np.asarray(counts, np.int64)
        self.ids = {w: i for i, w in enumerate(words)}


def build_filter(words: DataFrame, pairs: DataFrame, tau: float) -> np.ndarray:
    """The filter in one array: bit regions over the words (word, c) and pairs (pair, c) of count ``tau`` or
    more. ``lm_scores`` doesn't gather it; this is for looking into a small one."""
    def hashed(batches):
        for b in batches:
            g = pair_hash(b.column(0).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), b.column(1)], names=["gram", "c"])

    grams = words.where(F.col("c") >= tau).select(F.xxhash64("word").alias("gram"), "c").unionAll(
        pairs.where(F.col("c") >= tau).mapInArrow(hashed, "gram long, c long"))
    grams = materialise(grams, "lm-grams")
    level = F.floor(F.log(F.col("c") / F.lit(tau)) / F.lit(math.log(BASE)) + F.lit(1e-9)) + 1
    total = grams.agg(F.sum(level)).first()[0] or 0
    width = filter_bytes(total, REGIONS)

    def fill(batches):
        bits = {}
        for b in batches:
            gram = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            top = levels_of(b.column(1).to_numpy(zero_copy_only=False), tau)
            region = region_of(gram)
            for r in np.unique(region):
                mine = bits.setdefault(int(r), np.zeros(width * 8, bool))
                insert(mine, gram[region == r], top[region == r])
        for r, mine in sorted(bits.items()):
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([np.packbits(mine, bitorder="little").tobytes()],
                                                                                pa.binary())], names=["region", "bits"])

    parts = grams.repartition(REGIONS, F.shiftrightunsigned("gram", 58)).mapInArrow(fill, "region int, bits binary").collect()
    out = np.zeros((REGIONS, width), np.uint8)
    for r in parts:
        out[r["region"]] = np.frombuffer(r["bits"], np.uint8)
    return out


class Scorer:
    def __init__(self, vocabulary: Vocabulary, tokens: int, distinct: int):
        self.v, self.total = vocabulary, tokens + distinct + 1
        self.exact = np.log10((vocabulary.counts + 1) / self.total)

    def run(self, texts: list[bytes | None], levels: np.ndarray):
        """Per text: tokens, known and add-one score over vocabulary words, model score, other words. ``levels``
        are those of the texts' sorted distinct grams."""
        g = Grams(texts)
        text = np.repeat(np.arange(len(texts)), g.lengths)
        ids = np.fromiter((self.v.ids.get(w, -1) for w in g.words), np.int64, len(g.words))[g.word]
        known = ids >= 0
        n_known = np.bincount(text[known], minlength=len(texts))
        base = np.bincount(text[known], self.exact[ids[known]], len(texts))
        counts = level_count(levels, 1.0)
        seen, both = counts[g.word_at], counts[g.pair_at][g.pair]
        p, first = (seen[g.word] + 1) / self.total, seen[g.before]
        share = np.minimum(both / np.maximum(first, 1e-9), 1.0)
        p = np.where(first > 0, PAIR_WEIGHT * share + (1 - PAIR_WEIGHT) * p, p)
        score = np.bincount(text, np.log10(np.minimum(p, 1.0)), len(texts))
        rare = np.flatnonzero(~known)
        others = Counter(zip(text[rare].tolist(), (g.words[i] for i in g.word[rare])))
        return g.lengths, n_known, base, score, others


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, remainder: int = 2) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    The model learns from all rows whose crc32(id) mod ``modulus`` is not ``remainder``. Null and empty
    texts are one end token. Null ids are rows like any other (crc32 of ''); repeated rows count and are
    scored one by one. Other columns are not read. Empty input: no rows. Without training rows every
    count is 0.
    """
    spark = docs.sparkSession
    out = held_out(F.col(id_col), modulus, remainder)
    src = docs.select(F.col(id_col).alias("id"), out.alias("held_out"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"),
                      F.col(text_col).alias("text"))
    train = src.where("not held_out")
    words = materialise(word_counts(train), "lm-words")
    sums = words.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, distinct = sums["n"] or 0, sums["v"]
    # at most 1 / VOCABULARY words have this share
    frequent = words.where(F.col("c") >= max(1.0, VOCABULARY * tokens)).orderBy(F.desc("c"), "word").toArrow()
    frequent = (frequent.column("word").cast(pa.binary()).to_pylist(), frequent.column("c").to_numpy())
    sent = spark.sparkContext.broadcast(frequent)
    runs = materialise(pack_runs(src), "lm-runs")
    size = runs.agg(F.sum("size")).first()[0] or 0
    answers = gram_levels(runs, max(REGIONS, 1 << math.ceil(math.log2(max(1, size / REGION_BYTES)))))

    kind = src.schema["id"].dataType.simpleString()
    schema = (f"id {kind}, held_out boolean, key long, n_tokens long, n_known long, base double, score double, "
              "word string, times long")
    names = [x.split()[0] for x in schema.split(", ")]
    made = []

    def score(packed, answered):
        if not made:        # once for each task
            made.append(Scorer(Vocabulary(*sent.value), tokens, distinct))
        rows = unpacked(packed.column("packed")[0].as_buffer())
        levels = b"".join(answered.sort_by("region").column("levels").to_pylist())
        lengths, known, base, total, others = made[0].run(utf8(rows, "text"), np.frombuffer(levels, np.uint8))
        ids, held, keys = rows.columns[:3]
        out = [pa.table([ids, held, keys, pa.array(lengths), pa.array(known), pa.array(base), pa.array(total),
                         pa.nulls(len(ids), pa.string()), pa.nulls(len(ids), pa.int64())], names=names)]
        if others:
            k = len(others)
            at = pa.array([i for i, _ in others])
            out.append(pa.table([ids.take(at), held.take(at), keys.take(at), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()),
                                 pa.nulls(k, pa.float64()), pa.nulls(k, pa.float64()),
                                 pa.array([w for _, w in others], pa.binary()).cast(pa.string()), pa.array(list(others.values()), pa.int64())],
                                names=names))
        return pa.concat_tables(out)

    scored = runs.select("run", "packed").groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(score, schema)
    parts = materialise(scored, "lm-parts")
    main = parts.where("word is null")
    counted = words.withColumnRenamed("word", "w2")
    rare = parts.where("word is not null").select("id", "key", "word", "times")
    rare = rare.join(counted, rare["word"] == counted["w2"], "left").select(
        "id", "key", F.when(F.col("c") > 0, F.col("times")).otherwise(0).alias("k"),
        (F.col("times") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(tokens + distinct + 1)))).alias("s"), F.lit(0).alias("copies"))
    # a repeated row brings its words as often as itself: divide by the copies
    mark = main.select("id", "key", F.lit(0).cast("long").alias("k"), F.lit(0.0).alias("s"), F.lit(1).alias("copies"))
    rest = rare.unionAll(mark).groupBy(F.col("id").alias("i2"), F.col("key").alias("k2")).agg(
        (F.sum("k") / F.sum("copies")).cast("long").alias("k"), (F.sum("s") / F.sum("copies")).alias("s"))
    done = main.join(rest, F.col("id").eqNullSafe(F.col("i2")) & (F.col("key") == F.col("k2")))
    return done.select(F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.col("k")).alias("n_known"),
                       F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") + F.col("s")).alias("base_score"), "score")
