import os

import pytest
from pyspark.sql import types as T

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
# workers import the package by its name, wherever the tests are started
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

WORDS = "the of and thing ation house lemma river stone cloud paper green light after under".split()


def prose(n: int, seed: int) -> str:
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "x"]) + str(rng.randint(0, 9)) * rng.randint(0, 1) for _ in range(n))


#: doc_id, text, lang, source: nulls, empty and blank texts, repeated rows and ids, one very long text, odd characters.
ODD = [
    (1, "Some plain text of the house. Mail me: anna.b@mail.example.org or call +1 (555) 123-4567!", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (4, " \t\n\n ", "fr", "b"),
    (5, prose(300, 1), "en", "a"),
    (6, prose(300, 1), "en", "c"),
    (6, prose(300, 1), "en", "c"),
    (7, prose(299, 1) + " changed", "en", "a"),
    (7, "another text under the same id, ten words are in this line", None, "b"),
    (None, prose(300, 1), "de", "a"),
    (None, None, None, None),
    (8, "été \U0001f600 naïve <|endoftext|> 4111 1111 1111 1111 and 10.0.0.255 or 1.2.3.999\x00\x0b", "fr", "b"),
    (9, prose(20000, 2), "en", "a"),
    (10, "a line that is long enough\nshort\nA LINE that is long enough  \nx", "en", "a"),
    (11, "a line that is long enough\nother words here", "en", "b"),
    (12, "!!! 123 ...", "en", "b"),
]

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
    ]
)
#: Extra columns under names that the operators use themselves.
CLASHES = {"n_words": "1", "n_hit": "2", "spans": "'x'", "n_tokens": "4", "start": "5", "kept": "true", "row": "6", "raw": "'r'", "n": "7", "doc": "'d'", "token": "8", "position": "9", "stream": "10", "score": "1.5", "component": "11", "k1": "12", "h": "13", "id": "14", "width": "15", "contained": "0.1", "part": "16"}


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(ODD, SCHEMA).repartition(3)
    return frame.withColumns({k: F.expr(v) for k, v in CLASHES.items()})


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
