"""The lexicon of scanned pages holds all words and pairs, however many."""

from lodestrata.llm import scanned_pages


def test_nothing_is_cut(spark, monkeypatch):
    for name in ("VOCABULARY", "PAIRS"):
        monkeypatch.setattr(scanned_pages, name, 3, raising=False)
    docs = spark.createDataFrame([("", "alpha beta gamma delta epsilon zeta")] * 3 + [("", "single")], "title string, body string")
    got = scanned_pages.lexicon_of(docs)
    assert got.words == dict.fromkeys(["alpha", "beta", "gamma", "delta", "epsilon", "zeta"], 3)
    assert len(got.pairs) == 5 and set(got.pairs.values()) == {3}


def test_alike_lines_meet_by_their_pieces():
    import random
    from collections import Counter

    rng = random.Random(6)
    lines = Counter()
    for _ in range(60):
        base = "".join(rng.choice("abcde") for _ in range(rng.choice([3, 8, 9, 15, 16, 30, 60])))
        for _ in range(4):
            own = list(base)
            for _ in range(rng.randrange(len(own) // 7 + 2)):
                at = rng.randrange(len(own))
                own[at : at + 1] = rng.choice([[], ["x"], [own[at], "y"]])
                own = own or ["z"]
            lines["".join(own)[: rng.randrange(1, 70)]] += 1
    index = scanned_pages.Alike(lines)
    for x in lines:
        assert index.number(x) == sum(n for y, n in lines.items() if scanned_pages._alike(y, x))


def test_the_automaton_gives_the_readings():
    got = scanned_pages.Lexicon({"modern": 900, "modem": 1, "journal": 900, "jonrnal": 1, "harbour": 900}, {})
    assert got.readings("modem") == [] or got.readings("modem")[0][0] == "modern"
    assert got.readings("jonrnal")[0][0] == "journal" and not got.readings("harbour")
