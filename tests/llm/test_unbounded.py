"""Texts of any length and number of units: nothing is cut."""

import numpy as np

from lodestrata.llm import encodings, packing, sentences


def test_long_quotations_closers_and_many_units(spark):
    quoted = "「" + "完全な写本は残っていない" * 100 + "。」とフェの人は言った。"
    closing = "He left." + ")" * 60 + " She stayed."
    many = "It rains. " * 30_000
    item = " " * 40 + "12. An item far to the right"
    rows = [(1, quoted), (2, closing), (3, many), (4, f"Before.\n{item}\n"), (5, "『「はい。」と人は言った。』")]
    got = {}
    for r in sentences.sentence_units(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect():
        got.setdefault(r.id, []).append((r.start_char, r.end_char))
    assert got[1] == [(0, len(quoted))]
    assert got[2] == [(0, 68), (69, 80)]
    assert sorted(got[3]) == [(10 * k, 10 * k + 9) for k in range(30_000)]
    assert len(got[4]) == 2
    assert 5 in got


def test_references_of_every_kind():
    assert encodings.plain("&#233;&#xE9;&#x1F600;&#128512;&#xD800;&#0;") == "éé😀😀&#xD800;&#0;"


def test_genetic_algorithm_beats_its_seed():
    rng = np.random.default_rng(4)
    sizes = rng.integers(20, 512, 4000)
    seed = packing._fit(sizes, np.argsort(-sizes, kind="stable"), 512)
    best = packing.evolve(sizes, 512, [], 1)[0]
    fill = np.bincount(best, sizes)
    assert fill.max() <= 512 and len(best) == 4000
    assert packing._fitness(best, sizes, 512) > packing._fitness(seed, sizes, 512)
    assert best.max() <= seed.max()


def test_white_space_runs_are_sized():
    encoding = packing._encoding(packing.TOKENIZERS, packing.VOCABULARY)
    text = "word " * 100_000
    assert packing._count(encoding, text) == len(encoding.encode_ordinary(text))
    assert packing._count(encoding, " " * 300_000 + "end") > 1
