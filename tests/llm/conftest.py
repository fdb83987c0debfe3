from __future__ import annotations

import random

import pytest
from llm_tables import FOLDER

#: Extra columns whose names the operators use inside themselves.
EXTRA = "key string, row bigint, node string, `order` int, digest string, bits string, spans string, label int"


def _texts() -> list:
    rng = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "Épsilon", "zeta,", "eta.", "θ", "42", "iota\nkappa", "***"]
    prose = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(30)]
    near = " ".join(f"word{k}" for k in range(200))
    passage = " ".join(f"shared{k}" for k in range(60))
    return [
        None, "", " ", "\n\n", "\t", "one", "one two", "one  two", "one\ttwo", "a" * 9000, "ab" * 3000, "é" * 700,
        "x " * 6000, *prose, *prose[:8], prose[3] + " ", near, near.replace("word7 ", "other "),
        near.replace("word150 ", ""), prose[0] + "\n" + passage, prose[1] + passage + prose[2], passage,
        "mail me at jo.doe+x@mail.example.com. or call +1 (555) 123-4567, 10.0.0.255 and 10.0.0.256",
        "4111 1111 1111 1111 and 4111111111111112 or 4111-1111-1111-1111 x@y.com_foo@z.org 1.2.3.4.5.6.7.8",
        "0" * 5000 + ".1.1.1 " + "1." * 400 + "@" * 50 + "a@b" * 40, "tail\r\nwindows\r\n", "▁ mark ▁▁", "日本語 𝔘 text \x00 nul",
    ]


@pytest.fixture(scope="session")
def texts():
    return _texts()


@pytest.fixture(scope="session")
def odd(spark, texts):
    """Awkward texts under shuffled keys, in several partitions, with clashing extra columns."""
    rows = [(k * 7 % 101, t, "k", k, "n", 1, "d", "b", "s", 0) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id bigint, text string, {EXTRA}").repartition(5)


@pytest.fixture(scope="session")
def repeated(spark, texts):
    """Rows that repeat whole, keys that repeat, and null keys."""
    rows = [(k % 20, t) for k, t in enumerate(texts)] * 2 + [(None, "one two"), (None, "one two"), (None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], f"doc_id bigint, text string, {EXTRA}")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")

