"""Small tables with what real ones hold: nulls, empty and long texts, repeated rows, ties, clashing column names."""

import random

import pytest

#: Names that the operators use inside.
CLASHES = ["key", "size", "target", "taken", "position", "u", "rid", "cls", "n", "ids", "row", "label", "vector", "blob",
           "findings", "stratum", "host", "path", "bucket", "root", "mix_row", "near_row", "tox_score", "secret_blob"]


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdeo") for _ in range(rng.randint(2, 6))) for _ in range(n))


def odd_rows():
    rng = random.Random(5)
    rows = [(i, sentence(rng, rng.randint(1, 80)), rng.choice(["en", "de", None]), rng.choice(["b", "a", None, "Z"])) for i in range(60)]
    rows += [(100, None, "en", "a"), (101, "", "en", "a"), (102, " \t\n ", None, None), (None, "null key text of some six words", "en", "a")]
    rows += [(103, sentence(rng, 20_000), "en", "b")]  # long
    rows += [rows[3], rows[3], (None, None, None, None), (None, None, None, None)]  # repeated
    rows += [(104, rows[3][1], "en", "Z"), (104, "the same key but quite another text than before", "en", "Z")]  # a repeated key
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [r + (len(r[1]) if r[1] is not None else None,) + tuple("x" for _ in CLASHES) for r in odd_rows()]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def odd_labels(spark):
    rows = [(i, int(i % 4 > 0), int(i % 3 == 0)) for i in range(40)] + [(None, 1, 1), (41, None, None), (3, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
