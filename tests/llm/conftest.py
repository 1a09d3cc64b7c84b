import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, row int, score string, shard string, component string, lines string, hash int"
WORDS = "the stone river walks under old bright moon while seven birds sing near quiet gates of winter glass".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(300)) for _ in range(n))


def odd_texts():
    """Null, empty, blank, very long, repeated and odd texts."""
    rng = random.Random(5)
    long_line = prose(rng, 60)
    base = prose(rng, 200)
    near = base.split()
    near[50] = "changed"
    texts = [None, "", " \n\t ", "###", "word", "two Words", "İ é́ 你好 😀 <|endoftext|>", "x" * 50_000, prose(rng, 20_000), base, base, " ".join(near), f"start\n{long_line}\nend", f"other\n{long_line}\nlast\n", long_line, "a\n\nb\n\n", prose(rng, 150)]
    return texts + [None, "", prose(rng, 30), prose(rng, 30)]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Whose other columns clash with names that operators use; with a null id and a row that is there twice."""
    rows = [(i, t, ["en", "de", None][i % 3], "src0", 1, "clash", 1, "x", "y", "z", "w", 3) for i, t in enumerate(odd_texts())]
    rows += [(None, "no id here at all", "en", None, None, None, None, None, None, None, None, None), rows[9], rows[9]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, key="id"):
    return {r[key]: r for r in df.collect()}
