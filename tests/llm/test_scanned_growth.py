"""What is told of a word of scanned pages depends on its share of the corpus, not on the corpus's size."""

from lodestrata.llm import scanned_pages

WORDS = ["museum", "garden", "harbour", "journal", "archive", "library", "village", "handwritten", "kitchen", "bridge"]


def lexicon(times):
    return scanned_pages.Lexicon({w: 4000 * times for w in WORDS} | {"harbxur": times, "jonrnal": times, "vjllage": times}, {})


def test_readings_do_not_depend_on_size():
    for times in (1, 5, 100):
        got = lexicon(times)
        for word, printed in (("harbxur", "harbour"), ("vjllage", "village"), ("jonrnal", "journal"), ("kitqhen", "kitchen")):
            assert [c for c, _ in got.readings(word)] == [printed], (times, word)
        assert not any(got.readings(w) for w in WORDS)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_all_near_words_that_come_often_enough():
    rank = {f"{a}a{b}e{c}n": 1 + 7 * k for k, (a, b, c) in enumerate((a, b, c) for a in "gkmt" for b in "rlst" for c in "dbvz")}
    got = scanned_pages.Lexicon(rank, {})
    for least in (15, 29, 30, 45, 61, 200, 440):
        for word in ("garqen", "kasevn", "tatebn", "gardn", "akatezen", "xyz"):
            want = {(c, e) for c in rank if rank[c] >= least and (e := distance(word, c)) <= 2}
            assert set(got.within(word, 2, least)) == want
