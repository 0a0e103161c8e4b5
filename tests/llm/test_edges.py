"""Every operator on nulls, empty and very long texts, repeated rows, empty tables and columns whose names clash."""

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import encodings, error_pages, leakage, near_duplicates, packing, page_template, repeated_lines, scanned_pages, sentences

LONG = "The quick museum opened in 1990. It kept every page. " * 4000
ROWS = [
    (1, "http://a.example/1", "Title", "Home\nA short page about nothing at all.\nImprint", "en"),
    (1, "http://a.example/1", "Title", "Home\nA short page about nothing at all.\nImprint", "en"),
    (2, None, None, None, None),
    (None, "http://a.example/2", "x", "Home\ntext", "en"),
    (3, "http://a.example/3", "", "", "en"),
    (4, "no url", " ", " \n\t\n", None),
    (5, "http://b.example/5", "Große Ü", LONG, "de"),
    (6, "http://b.example/6", "x", "one-line-without-spaces" * 3000, "de"),
    (7, "http://b.example/7", "x", "\x00�\U0001f600  \f\r\n", "de"),
]
SCHEMA = "id long, url string, title string, body string, lang string"
CLASH = ("rec_id", "text", "n", "k1", "k2", "sketch", "line_no", "site_key", "nodes", "spans", "tokens", "score", "error", "long", "placeholder", "key", "tbl", "piece", "_small", "v")


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    for c in CLASH:
        rows = rows.withColumn(c, F.lit("clash"))
    return rows


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "en", "the quick museum opened in 1990 it kept every page the quick museum", "clash"), (2, None, None, "x"), (None, "ja", "x", "x"), (3, "ja", "", "x")], "item_id long, lang string, passage string, suite string")


def operators(docs, items):
    none = docs.select("id").limit(0)
    return {
        "p1": lambda d: encodings.garbled_fields({"t": (d, "id", ["title", "body"])}, restored=True),
        "p2": lambda d: near_duplicates.near_duplicate_pairs(d, "id", "body"),
        "p2g": lambda d: near_duplicates.near_duplicate_groups(d, "id", "body"),
        "p3": lambda d: repeated_lines.repeated_lines(d, "id", "url", "body"),
        "p3b": lambda d: repeated_lines.repeated_blocks(d, "id", "url", "body"),
        "p3c": lambda d: repeated_lines.without_repeated_lines(d, "id", "url", "body"),
        "p4": lambda d: error_pages.error_pages(d, none),
        "p5": lambda d: scanned_pages.flawed_lines(d),
        "p5r": lambda d: scanned_pages.repaired_texts(d),
        "p6": lambda d: page_template.boilerplate_lines(d, "id", "url", "body"),
        "p6c": lambda d: page_template.main_content(d, "id", "url", "body"),
        "p7": lambda d: packing.pack(packing.token_sizes(d, "id", "body"), [(1, 64), (2, None), (3, 0)]),
        "p8": lambda d: leakage.leaked(d, "id", "body", items),
        "p8e": lambda d: leakage.leaked(d, "id", "body", items.limit(0)),
        "p9": lambda d: sentences.sentence_units(d, "id", "body"),
    }


NAMES = list(operators_names := ("p1", "p2", "p2g", "p3", "p3b", "p3c", "p4", "p5", "p5r", "p6", "p6c", "p7", "p8", "p8e", "p9"))


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(docs, items, name):
    rows = operators(docs, items)[name](docs).collect()
    ids = {r["id"] for r in rows} if rows and "id" in rows[0].__fields__ else set()
    if name in ("p3", "p5", "p6", "p7", "p9"):
        assert None not in ids and 2 not in ids
    if name == "p2":
        assert {tuple(r) for r in rows} <= {(5, 5)}
    if name == "p8":
        assert {tuple(r) for r in rows} == {(5, 1)}
    if name == "p8e":
        assert rows == []
    if name == "p7":
        assert {r.spec_id for r in rows} == {1} and all(r.tokens <= 64 for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(docs, items, name):
    assert operators(docs, items)[name](docs.limit(0)).collect() == []
