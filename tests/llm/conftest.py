import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[2]))

from paperloom.session import build_session  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, n int, body string"


@pytest.fixture(scope="session")
def spark():
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g"}
    session = build_session(master="local[4]", conf=conf)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def docs(spark):
    """Documents of a small driver table and of hand, with columns whose names operators use inside."""
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()
    rows = [(*r, 1, 1, "x") for r in given]
    words = "one two three four five six seven eight nine ten eleven twelve"
    hand = [
        None, "", " \n\t ", "word", "word", "Two words", words, words + " thirteen", words.upper(), "né é ß 日本語 \U0001f600", "1 2 3 4", "a\x1cb\tc  d\n\n",
        "call +1 (743) 555-3824 or mail a.b@c.example.org, 10.0.0.255 and 4111 1111 1111 1111", " ".join(f"w{i % 700}" for i in range(30_000)), "x" * 50_000,
    ]
    rows += [(10_000 + i, t, "en" if i % 2 else None, None if i % 3 else "hand", None, 1, 1, "x") for i, t in enumerate(hand)]
    rows += [(10_006, words, "en", "hand", 1, 1, 1, "x")]  # repeats an id and a text
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def with_null_id(spark, docs):
    return docs.unionByName(spark.createDataFrame([(None, "one two three four", "en", None, 1, 1, 1, "x"), (None, None, None, None, None, None, None, None)], SCHEMA))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
