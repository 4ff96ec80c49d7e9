import random

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType())])
#: Columns that operators use names of inside.
CLASHES = ["key", "n", "hits", "size", "bucket", "g", "doc", "line", "set", "rank", "target", "taken", "score", "spans", "dropped", "rest", "component"]


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) or longer tuples; clashing adds extra columns."""
    from pyspark.sql import functions as F

    def make(rows, clashing=False):
        full = [(*r, *("en", "s")[len(r) - 2 :])[:4] if len(r) < 4 else r for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        return df.withColumns({c: F.lit("x") for c in CLASHES}) if clashing else df

    return make


@pytest.fixture(scope="session")
def corpus():
    """Random documents with exact copies, near copies, shared passages, and odd rows."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(300)]
    say = lambda n: [r.choice(words) for _ in range(n)]
    passages = [say(30) for _ in range(4)]
    texts = []
    for i in range(60):
        body = say(r.randint(0, 120))
        if i % 5 == 0:
            at = r.randint(0, len(body))
            body[at:at] = r.choice(passages)
        if i % 7 == 3 and texts:
            body = texts[r.randrange(len(texts))].split()
            if i % 2 and len(body) > 3:
                body[r.randrange(len(body))] = "changed"
        breaks = [r.choice([" ", " ", " ", " ", "\n", ". ", "\t"]) for _ in body]
        texts.append("".join(w + b for w, b in zip(body, breaks)))
    texts += ["", "   ", "one", "one two", "One TWO", "\n\n", "x" * 5000, "a b c " * 700, "ÀÉ àé"]
    rows = [(i * 3, t, r.choice(["en", "fr", None]), r.choice(["a", "b", "c", None])) for i, t in enumerate(texts)]
    rows += [(1000, None, None, None), (1001, texts[5], "en", "a"), (1002, texts[5], "en", "b")]
    r.shuffle(rows)
    return rows
