import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n):
    return " ".join("".join(rng.choices(["ka", "lo", "mi", "ren", "ta", "vos", "el", "dan"], k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows of documents: prose in three sources, copies, near copies, shared passages, nulls, blanks, ties."""
    rng = random.Random(3)
    rows = []
    for i in range(60):
        rows.append([i, sentence(rng, rng.randint(60, 160)), "en" if i % 3 else "de", f"s{i % 3}"])
    for i in range(60, 70):     # exact copies
        rows.append([i, rows[5][1], "en", "s1"])
    for i in range(70, 76):     # one word changed
        words = rows[7][1].split()
        words[i - 65] = "zzz"
        rows.append([i, " ".join(words), "en", "s1"])
    passage = sentence(rng, 30)
    for i in range(76, 82):
        rows.append([i, sentence(rng, 40) + " " + passage + "\n" + sentence(rng, 40), "de", "s2"])
    rows += [[82, None, "en", "s0"], [83, "", None, None], [84, "   \n\t ", "en", None], [85, "one", "en", "s1"],
             [86, "ééé ßß " * 40, "de", "s2"], [None, rows[3][1], "en", "s0"], [None, sentence(rng, 80), None, "s1"],
             [87, sentence(rng, 30000), "en", "s0"]]
    rows.append(list(rows[9]))      # a repeated row
    return [(a, t, c, d, None if t is None else len(t)) for a, t, c, d in rows]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOC_SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """``docs`` with extra columns named like what the operators use inside."""
    from pyspark.sql import functions as F

    extra = ["id", "key", "row", "size", "bucket", "shard", "slot", "fp", "root", "crc", "start", "rank", "score", "__row", "word", "item", "kept"]
    return docs.select("*", *[F.lit(f"x-{c}").alias(c) for c in extra])
