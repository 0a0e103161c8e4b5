"""Families of texts that share values beyond any list's length are dealt to blocks, and no pair is lost."""

import random

import numpy as np
import pytest

from lodestrata.llm import near_duplicates as nd


def test_every_two_rows_meet(monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 3)
    ids = np.arange(40, dtype=np.int64)
    v, often = np.r_[np.full(30, 7), np.full(10, 8)].astype(np.int64), np.r_[np.full(30, 30), np.full(10, 2)].astype(np.int64)
    key, row = nd._dealt(v, ids, often)
    met = {(a, b) for k in np.unique(key) for a in row[key == k] for b in row[key == k] if a < b}
    assert met == {(a, b) for a in range(40) for b in range(a + 1, 40) if v[a] == v[b]}


@pytest.mark.parametrize("held", [nd.FREQUENT_HELD, -1])
def test_a_family_in_blocks(spark, monkeypatch, held):
    rng, rows = random.Random(3), []
    words = [f"w{k}" for k in range(300)]
    for k in range(45):
        own = list(words)
        for _ in range(k % 7):
            own[rng.randrange(300)] = f"x{rng.randrange(999)}"
        rows.append((k, " ".join(own)))
    docs = spark.createDataFrame(rows, "id long, body string")
    monkeypatch.setattr(nd, "FREQUENT_HELD", held)
    whole = {tuple(r) for r in nd.near_duplicate_pairs(docs, "id", "body").collect()}
    monkeypatch.setattr(nd, "BLOCK", 5)
    monkeypatch.setattr(nd, "FREQUENT", 3)
    assert {tuple(r) for r in nd.near_duplicate_pairs(docs, "id", "body").collect()} == whole and len(whole) > 500
