import random

import pytest

from wirecorpus.llm.common import table


def invented(rnd: random.Random, words: int) -> str:
    syllables = ["an", "der", "ti", "qu", "és", "oun", "la", "mo", "ren", "ß"]
    return " ".join("".join(rnd.choices(syllables, k=rnd.randint(1, 3))) for _ in range(words))


@pytest.fixture(scope="session")
def texts():
    """Texts with the cases every operator has to stand: null, empty, blank, long, equal, odd."""
    rnd = random.Random(5)
    some = [invented(rnd, rnd.randint(1, 200)) for _ in range(30)]
    base = invented(rnd, 150).split()
    near = []
    for k in range(6):
        words = list(base)
        for at in range(k):
            words[at * 20] = f"changed{k}{at}"
        near.append(" ".join(words))
    long = "\n".join(invented(rnd, 60) for _ in range(400))
    return [
        None, "", " \n\t ", "...", "A", "a", *some, *near, some[0], some[0], some[1].upper(), long,
        "x\x00y <|endoftext|> ▁ z  two", "日本語 テスト 👍🏽", "\n".join(["same line here"] * 80),
    ]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Rows over several partitions, with a repeated row, a null id, and columns of clashing names."""
    rows = [(i, t, ["en", "de", None][i % 3], i, "x", 1) for i, t in enumerate(texts)]
    rows += [rows[8], (None, "an id of null", "en", 1, "x", 1)]
    schema = "doc_id long, text string, lang string, shard int, _group string, length int"
    return spark.createDataFrame(rows, schema).repartition(5)


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def pairs(docs):
    """(doc_id, text or empty) of every row."""
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")


@pytest.fixture(scope="session")
def corpus(spark, data):
    return table(spark, data, "documents")


@pytest.fixture(scope="session")
def corpus_labels(spark, data):
    return table(spark, data, "labels")
