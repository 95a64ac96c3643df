from __future__ import annotations

import random

import pytest

CLASHING = ["rid", "key", "row", "sha", "node", "band", "size", "part", "cls", "block", "slot", "item", "may", "touched", "n", "component", "target", "digest"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, extra columns with names that the operators use."""
    rng = random.Random(11)
    words = ["alpha", "beta", "Gamma", "delta", "ζeta", "x", "<b>", "e1"]
    long = " ".join(rng.choice(words) + str(rng.randrange(500)) for _ in range(30000))
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(80))
    texts = [None, "", " \n\t", "one", "one", "a b", long, long + " end", "é" * 900, passage, "lead " + passage + " tail", "1234 !!", "same line\nsame line\nsame line"]
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None][i % 3]) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "no id here", "en", "s1"), (None, None, None, None)]
    rows = [(*r, None if r[1] is None else len(r[1]), *[f"{c}{r[0]}" for c in CLASHING]) for r in rows]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame(rows, kinds).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
