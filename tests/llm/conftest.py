import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, kept boolean, row string"


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Documents with nulls, empty and long texts, copies, near copies, repeated rows and columns that clash."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k)) + "."
    rows = []
    base = text(80)
    for i in range(n):
        t = text(rng.randint(1, 60))
        if i % 10 == 3:
            words = base.split()
            words[rng.randrange(len(words))] = "changed"
            t = " ".join(words)
        if i % 10 == 5:
            t = base.replace(" ", rng.choice([" ", "  ", "\n", "\t "]))
        rows.append((i, t, "en", "hot" if i % 3 else f"s{i % 4}", len(t), 7, False, "x"))
    rows += [(100, None, None, None, None, None, None, None), (101, "", "en", "hot", 0, 1, True, ""), (102, " \n\t", "fr", "s1", 3, 1, None, None), (103, "ÀÉ 日本 <|endoftext|> 😀 don't İX, A–B", "en", None, 9, 0, False, "y")]
    rows += [(104, text(30_000), "de", "s2", 1, 1, True, "z"), rows[5], rows[5], (None, "no id here", "en", "s1", 1, 1, True, "q")]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def unique(docs):
    return docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
