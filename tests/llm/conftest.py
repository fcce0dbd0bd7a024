import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent.parent
sys.path.insert(0, str(ROOT))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Columns with names that operators use inside.
CLASH = {c: "x" for c in ("node", "n", "slot", "kind", "region", "w", "at", "row_no", "print", "carried", "value", "key")}


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4")
               .config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session


def words(rng, n, vocabulary=3000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """Rows with copies, shared passages, nulls, blanks, short and long texts, a
    repeated row, a repeated id and rows without an id."""
    import random

    rng = random.Random(5)
    passage = " ".join(words(rng, 70))
    rows = []
    for i in range(24):
        body = words(rng, rng.choice([3, 18, 19, 20, 21, 60, 150]))
        if i % 3 == 0:
            body[len(body) // 2:len(body) // 2] = passage.split()
        rows.append((i, ("\n" if i % 2 else " ").join(body), "en" if i % 4 else "de"))
    long = " ".join(words(rng, 4000))
    rows += [(100, rows[9][1], "en"), (101, rows[9][1].upper(), "en"), (102, None, None), (103, "", "en"),
             (104, " \t\n\x0b\f\r ", "fr"), (105, long, "en"), (106, long + " x", "en"), (107, "é É ß\u2028\u3000z", "fr"),
             (108, "a b " * 60, "en"), (109, "a b " * 60, "en"), (7, rows[9][1], "en"), (None, rows[9][1], "en"),
             (None, "alone here", None), (110, "aaaa" * 40, "de"), (111, "x" + "aaaa" * 40, "de"), rows[3], rows[3]]
    return [(i, t, g, "src0", len(t or "")) for i, t, g in rows]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    from pyspark.sql import functions as F

    return spark.createDataFrame(corpus, SCHEMA).repartition(3).withColumns({k: F.lit(v) for k, v in CLASH.items()}).cache()
