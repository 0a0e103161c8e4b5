"""Near duplicates among long texts of few distinct shingles, against brute force."""

import random

import pytest

from lodestrata.llm import near_duplicates


@pytest.mark.parametrize("held", [2_000_000, -1])
def test_repetitive_texts(spark, monkeypatch, held):
    monkeypatch.setattr(near_duplicates, "FREQUENT_HELD", held)
    rng, rows = random.Random(5), []
    for family, n in enumerate([3, 4, 5, 8, 12, 16, 20, 25, 30, 34, 41, 42, 50, 64, 66] * 6):
        phrase = [f"w{family}x{k}" for k in range(n)]
        variants = [phrase, phrase]
        for changed in (1, max(1, n // 12), max(1, n // 8)):
            at = rng.randrange(n)
            variants.append([f"c{family}x{k}" if (k - at) % n < changed else w for k, w in enumerate(phrase)])
        variants.append(phrase + [f"more{family}x{k}" for k in range(n // 2)])
        for k, v in enumerate(variants):
            rows.append((len(rows), " ".join(v * (-(-120 // len(v)) + 3 * k))))
    sets = {}
    for i, t in rows:
        w = near_duplicates.tokens(t)
        assert len(w) >= near_duplicates.MIN_TOKENS
        sets[i] = set(zip(w, w[1:], w[2:], strict=False))
    true = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    docs = spark.createDataFrame(rows, "id long, body string")
    assert {tuple(r) for r in near_duplicates.near_duplicate_pairs(docs, "id", "body").collect()} == true
