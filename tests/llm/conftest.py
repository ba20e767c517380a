from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, score string, shard string, ids string"


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(words))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, a long one, copies, repeated rows, clashing names."""
    long = prose(1, 6_000)
    texts = [None, "", "  \n\t ", "one", "Two words", prose(2, 60), prose(2, 60), prose(3, 80), prose(3, 80) + " more", long]
    texts += ["a@b.co and 1.2.3.4, card 4539 5787 6362 1486", "+1 (555) 123-4567", "é 日本 🙂 ▁x  y", "word " * 400, "a" * 5_000]
    rows = [(i, t, "en" if i % 2 else None, f"src{i % 3}" if i % 4 else None, None, "k", "s", None, "i") for i, t in enumerate(texts)]
    rows += [(None, "no id here", None, None, None, None, None, None, None)] * 2
    rows += [(5, texts[5], "en", "src2", None, "k", "s", None, "i")] * 2
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def folder(spark, odd, tmp_path_factory):
    """The odd table and labels, laid out like the given tables."""
    path = str(tmp_path_factory.mktemp("tables"))
    odd.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(15)] + [(None, None, None), (3, None, 1), (4, 1, None)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path
