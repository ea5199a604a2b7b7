import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, hash string, kept string, shard string, mark string"


def edge_rows(seed: int = 3, n: int = 160):
    """Documents with nulls, blanks, long texts, exact and near copies, repeated rows, shared passages and odd characters."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)] + ["É,", "日本", "naïve", "😀", "x" * 40, "don't", "A", "a"]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage, rows = prose(80), []
    for i in range(n):
        text = prose(rng.choice([0, 1, 2, 5, 12, 60, 150]))
        if i % 9 == 1 and rows:
            text = rows[-1][1]
        elif i % 9 == 2 and rows and rows[-1][1]:
            text = rows[-1][1] + " " + rng.choice(words)
        elif i % 9 == 3:
            text = prose(20) + "\n" + passage + "\n" + prose(15)
        elif i % 9 == 4:
            text = "\n".join([prose(6)] * 3 + ["", " "]) + " #$ " + "ab ab ab ab ab " * rng.randint(0, 9)
        rows.append((i * 3, text, "en", rng.choice(["a", "a", "a", "b", "c", None]), len(text)))
    rows += [(-5, None, None, None, None), (None, "null id text here", "en", "a", 4), (None, None, None, "b", None), (7000, "", "", "", 0), (7001, " \t\n", "", "b", 3)]
    rows += [(8000, prose(4000), "en", "c", 0), (8001, "z" * 30000, "en", "c", 0), (8002, "<|endoftext|> \x1c tail<|endoftext|>", "en", "c", 0)]
    rows += [rows[5], rows[5], rows[12]]
    return [(*r, "s", "h", "k", "x", "m") for r in rows]


@pytest.fixture(scope="session")
def edge(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("edge") / "documents")
    spark.createDataFrame(edge_rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i * 3, int(i % 9 != 4), int(i % 7 == 0)) for i in range(120)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
