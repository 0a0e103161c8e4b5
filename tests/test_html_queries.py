"""The HTML queries give every record, those that hold markup, entities or nulls included."""

from lodestrata.plans import catalog

# (title, body, text, title read from the page)
ROWS = [
    ("Plain", "one\ntwo", "Plain & more one two", "Plain & more"),
    ("<b>A</b>", "1 &lt; 2 &#169;&#xe9;\n<script>no</script>z", "A & more 1 < 2 ©é z", "<b>A</b> & more"),
    ("x &#226;", "a &amp;lt; b &bogus; <%= heading %> <!-- gone", "x â & more a &lt; b &bogus;", "x â & more"),
    ("&quot;q&quot;", "a <p class='x'>b", "\"q\" & more a b", "\"q\" & more"),
    (None, "body", "& more body", "& more"),
    ("t", None, "t & more", "t & more"),
    (None, None, "& more", "& more"),
]


def test_every_record_comes_out(spark, tmp_path):
    rows = [(k, t, b) for k, (t, b, _, _) in enumerate(ROWS)]
    spark.createDataFrame(rows, "rec_id long, title string, body string").write.parquet(f"{tmp_path}/index_docs.parquet")
    for name, at in (("html_text", 2), ("html_title", 3)):
        got = {r[0]: r[1] for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()}
        assert got == {k: r[at] for k, r in enumerate(ROWS)}
