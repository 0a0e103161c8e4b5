"""Repeated blocks of lines against brute force, with urls of many captures dealt to many tasks."""

import random
from collections import defaultdict

import pytest

from lodestrata.llm import repeated_lines as rl


@pytest.mark.parametrize("dealt", [3, 2000])
def test_blocks_and_lines(spark, monkeypatch, dealt):
    monkeypatch.setattr(rl, "DEALT", dealt)
    monkeypatch.setattr(rl, "BATCH_LINES", 40)
    rng = random.Random(5)
    pool = [f"line {'abcdefghij'[k]}{'klmnopq'[k % 7]}" for k in range(8)]
    rows = []
    for k in range(160):
        url = f"http://s{k % 2}.example/{'home' if k % 3 == 0 else k}"
        start = rng.randrange(5)
        lines = [f"own {rng.choice('abcdefgh')}{chr(97 + k % 26)}{chr(97 + k // 26)}" for _ in range(2)]
        at = rng.randrange(3)
        lines[at:at] = [*pool[start : start + rng.randrange(1, 4)], ""]
        rows.append((k, url, "\n".join(lines)))
    docs = spark.createDataFrame(rows, "id long, url string, body string")
    urls = defaultdict(set)
    for _, u, b in rows:
        for x in b.split("\n"):
            urls[(rl.site_of(u), rl.letters(x))].add(u)
    often = {k for k, v in urls.items() if k[1] and len(v) >= rl.MIN_URLS}
    true = {(i, n) for i, u, b in rows for n, x in enumerate(b.split("\n"), 1) if (rl.site_of(u), rl.letters(x)) in often}
    assert {tuple(r) for r in rl.repeated_lines(docs, "id", "url", "body").collect()} == true and true
    blocks = defaultdict(set)
    for _, u, b in rows:
        own = [(rl.site_of(u), rl.letters(x)) for x in b.split("\n") if rl.letters(x)]
        for size in range(1, rl.MAX_BLOCK + 1):
            for at in range(len(own) - size + 1):
                if all(x in often for x in own[at : at + size]):
                    blocks[tuple(own[at : at + size])].add(u)
    want = sorted((len(k), len(v)) for k, v in blocks.items() if len(v) >= rl.MIN_URLS)
    got = sorted((r["size"], r.urls) for r in rl.repeated_blocks(docs, "id", "url", "body").collect())
    assert got == want and max(x[0] for x in want) > 1
