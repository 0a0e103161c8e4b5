"""Repeated lines come from blocks of every length, by brute force."""

from collections import defaultdict

import pytest

from lodestrata.llm import repeated_lines as rl


def naive_blocks(rows):
    """Of blocks of 1, 2, 4 and more lines: the urls they stand in, by site and letters."""
    urls = defaultdict(set)
    for _, u, b in rows:
        own = [rl.letters(x) for x in b.split("\n")]
        for size in (2**k for k in range(len(own).bit_length())):
            for at in range(len(own) - size + 1):
                if all(own[at : at + size]):
                    urls[(rl.site_of(u), *own[at : at + size])].add(u)
    return urls


@pytest.fixture(scope="module")
def long_blocks():
    """A menu of 21 lines, whole on 12 pages, a part of it on 20 more, and captures of a page with the same lines."""
    word = lambda k: "entry " + "abcdefghijklmnopqrstuvwxyz"[k % 26] * 3 + "abc"[k // 26]
    menu, rows = [word(k) for k in range(21)], []
    for k in range(32):
        lines = ["own " + word(30 + k), *(menu if k < 12 else menu[k % 5 : k % 5 + 6]), "", word(5), "own last " + word(30 + k)]
        rows.append((k, f"http://{'www.' * (k % 2)}a.example/{k}", "\n".join(lines)))
    rows += [(100 + k, "http://a.example/0", rows[0][2]) for k in range(5)]
    rows += [(200 + k, f"http://b.example/{k}", "\n".join(menu)) for k in range(9)]
    return rows


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_blocks_of_every_length_are_counted(spark, long_blocks, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        docs = spark.createDataFrame(long_blocks, "id long, url string, body string")
        got = sorted((r["size"], r.urls) for r in rl._counted(rl._sequences(docs, "id", "url", "body"), None).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == sorted((len(k) - 1, len(v)) for k, v in naive_blocks(long_blocks).items() if len(v) >= rl.MIN_URLS)
    assert max(got)[0] == 16


@pytest.mark.parametrize("least", [1, 2, 8, 16, 32])
def test_lines_come_from_blocks_of_every_length(spark, monkeypatch, long_blocks, least):
    counted = rl._counted
    monkeypatch.setattr(rl, "_counted", lambda sequences, longest: counted(sequences, longest).filter(f"size >= {least}"))
    urls = naive_blocks(long_blocks)
    true = set()
    for i, u, b in long_blocks:
        own = [rl.letters(x) for x in b.split("\n")]
        for size in (2**k for k in range(6)):
            for at in range(len(own) - size + 1):
                if size >= least and len(urls.get((rl.site_of(u), *own[at : at + size]), ())) >= rl.MIN_URLS:
                    true |= {(i, n + 1) for n in range(at, at + size)}
    docs = spark.createDataFrame(long_blocks, "id long, url string, body string")
    got = [tuple(r) for r in rl.repeated_lines(docs, "id", "url", "body").collect()]
    assert len(got) == len(set(got)) and set(got) == true and bool(true) == (least < 32)
