"""Ranked full-text search: an inverted index as a table, a boolean query language, and BM25.

Query language: terms side by side or OR, AND (binds tighter), NOT, ``+`` and ``-``, parentheses, ``"phrases"``,
``field:term``. Terms without a field stand in title or body. url, mime, s3_key and collection hold whole values.
Scores are exact BM25 by field and term (k1 = 1.2, b = 0.75), summed; ties go by id.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.skiplist import SkipList
from lodestrata.functions.urls import url_domain

TEXT_FIELDS, RAW_FIELDS = ("title", "body"), ("url", "mime", "s3_key", "collection")
K1, B = 1.2, 0.75
MAX_TOKEN_BYTES = 40


class QueryError(ValueError):
    """A query that can't be parsed or only excludes."""


@dataclass
class Leaf:
    field: str
    terms: tuple[str, ...]


@dataclass
class Node:
    """must: all; should: any, if nothing must; without: none of them."""

    must: list = field(default_factory=list)
    should: list = field(default_factory=list)
    without: list = field(default_factory=list)


_token = re.compile(r'\s*(?:(\()|(\))|(AND|OR|NOT)(?=[\s()]|$)|([+-])?(?:(\w+):)?(?:"([^"]*)"|([^\s()"]+)))')


def words_of(text: str) -> list[str]:
    return [w for w in re.findall(r"[^\W_]+", text.lower()) if len(w.encode()) < MAX_TOKEN_BYTES]


def _leaf(name: str | None, text: str) -> Node | Leaf:
    if name in RAW_FIELDS:
        return Leaf(name, (text,))
    if name and name not in TEXT_FIELDS:
        raise QueryError(f"no such field: {name}")
    terms = tuple(words_of(text))
    if not terms:
        raise QueryError(f"no words in {text!r}")
    return Leaf(name, terms) if name else Node(should=[Leaf(f, terms) for f in TEXT_FIELDS])


def parse(query: str) -> Node | Leaf | None:
    """The query's tree; None for a blank query, which finds everything."""
    if not query.strip():
        return None
    items, at = [], 0
    while query[at:].strip():
        m = _token.match(query, at)
        if not m:
            raise QueryError(f"can't read {query[at:]!r}")
        at = m.end()
        items.append(m.groups())
    items.reverse()

    def atom():
        if not items:
            raise QueryError("something is missing at the end")
        opened, closed, word, sign, name, phrase, term = items.pop()
        if opened:
            node = either()
            if not items or not items.pop()[1]:
                raise QueryError("a parenthesis isn't closed")
            return "", node
        if closed or word in ("AND", "OR"):
            raise QueryError("an operand is missing")
        if word == "NOT":
            return "-", atom()[1]
        return sign or "", _leaf(name, phrase if phrase is not None else term)

    def both():
        parts = [atom()]
        while items and items[-1][2] == "AND":
            items.pop()
            parts.append(atom())
        if len(parts) == 1:
            return parts[0]
        return "", Node(must=[n for s, n in parts if s != "-"], without=[n for s, n in parts if s == "-"])

    def either():
        node = Node()
        while items and not items[-1][1]:
            if items[-1][2] == "OR":
                items.pop()
                continue
            sign, part = both()
            {"": node.should, "+": node.must, "-": node.without}[sign].append(part)
        if node.without and not (node.must or node.should):
            raise QueryError("a query can't only exclude")
        return node

    tree = either()
    if items:
        raise QueryError("a parenthesis too many")
    return tree


def leaves(tree) -> list[Leaf]:
    if tree is None:
        return []
    if isinstance(tree, Leaf):
        return [tree]
    out = []
    for part in (*tree.must, *tree.should, *tree.without):
        out += leaves(part)
    return [x for k, x in enumerate(out) if x not in out[:k]]


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)


@dataclass
class Index:
    """postings (field, term, id, tf, dl, positions), each with the length of its field, so that ranking needs no other
    table of all documents; totals, a row with the number of documents and each field's mean length; and the documents."""

    postings: DataFrame
    totals: DataFrame
    docs: DataFrame


def build(docs: DataFrame, id_col: str, terms: list[str] | None = None) -> Index:
    """The index of docs (title, body, ...). ``terms`` limits the postings to those, before they are grouped.

    Positions count the dropped long tokens. Null fields are empty; rows with a null id are left out.
    """
    own = docs if id_col == "id" else docs.drop("id").withColumnRenamed(id_col, "id")
    own = own.filter(F.col("id").isNotNull())
    split = own.select("id", *[tokens(F.col(f)).alias(f) for f in TEXT_FIELDS])
    short = lambda c: F.size(F.filter(c, lambda t: F.octet_length(t) < MAX_TOKEN_BYTES))
    totals = split.agg(F.count("*").alias("n"), *[F.avg(short(F.col(f))).alias(f) for f in TEXT_FIELDS])
    parts = None
    for f in TEXT_FIELDS:
        rows = split.select(F.lit(f).alias("field"), "id", short(F.col(f)).alias("dl"), F.posexplode(f).alias("pos", "term"))
        parts = rows if parts is None else parts.union(rows)
    rows = parts.filter(F.octet_length("term") < MAX_TOKEN_BYTES)
    if terms is not None:
        rows = rows.filter(F.col("term").isin(terms))
    postings = rows.groupBy("field", "term", "id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"), F.array_sort(F.collect_list("pos")).alias("positions"))
    return Index(postings, totals, own)


def write_index(index: Index, path: str, buckets: int | None = None) -> None:
    """Postings clustered by term, so that a query's terms are read from few row groups."""
    buckets = buckets or index.postings.sparkSession.sparkContext.defaultParallelism
    index.postings.repartitionByRange(buckets, "term", "field").sortWithinPartitions("term", "field", "id").write.mode("overwrite").parquet(f"{path}/postings")
    index.totals.write.mode("overwrite").parquet(f"{path}/totals")
    index.docs.write.mode("overwrite").parquet(f"{path}/docs")


def read_index(spark, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{x}") for x in ("postings", "totals", "docs")))


def matches(index: Index, tree) -> DataFrame:
    """(id, score) of all documents that match."""
    if tree is None:
        return index.docs.select("id", F.lit(1.0).alias("score"))
    own = leaves(tree)
    text = [x for x in own if x.field in TEXT_FIELDS]
    raw = [x for x in own if x.field in RAW_FIELDS]
    stats = index.totals.first()  # three numbers
    n = stats["n"] or 1
    flags: dict[int, str] = {}
    joined = None
    for k, leaf in enumerate(own):
        if leaf not in text:
            continue
        rows = index.postings.filter((F.col("field") == leaf.field) & F.col("term").isin(list(set(leaf.terms))))
        if len(leaf.terms) == 1:
            hits = rows.select("id", "tf", "dl")
        else:  # consecutive positions: every term's positions shifted back to the phrase's start
            at = F.col("positions")
            by_term = rows.groupBy("id").agg(F.first("dl").alias("dl"), F.map_from_entries(F.collect_list(F.struct("term", at))).alias("m"))
            shifted = [F.transform(F.coalesce(F.col("m")[t], F.array().cast("array<int>")), _back(j)) for j, t in enumerate(leaf.terms)]
            common = shifted[0]
            for s in shifted[1:]:
                common = F.array_intersect(common, s)
            hits = by_term.select("id", F.size(common).cast("bigint").alias("tf"), "dl").filter("tf > 0")
        part = hits.select("id", F.lit(k).alias("leaf"), "tf", "dl")
        joined = part if joined is None else joined.union(part)
    for k, leaf in enumerate(own):
        if leaf in raw:
            part = index.docs.filter(F.col(leaf.field) == leaf.terms[0]).select("id", F.lit(k).alias("leaf"), F.lit(1).cast("bigint").alias("tf"), F.lit(0).alias("dl"))
            joined = part if joined is None else joined.union(part)
    df = {r[0]: r[1] for r in joined.groupBy("leaf").count().collect()}  # one number for each leaf of the query
    aggs = []
    for k, leaf in enumerate(own):
        here = F.col("leaf") == k
        tf = F.max(F.when(here, F.col("tf")))
        if leaf in text:
            idf = float(_idf(n, df.get(k, 0)))
            average = float(stats[leaf.field] or 1.0) or 1.0
            length = F.max(F.when(here, F.col("dl")))
            weight = F.lit(idf) * tf * F.lit(K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length / F.lit(average)))
        else:
            weight = F.when(tf.isNotNull(), F.lit(float(_idf(n, df.get(k, 0)))))
        aggs.append(F.coalesce(weight, F.lit(0.0)).alias(f"w{k}"))
        aggs.append(tf.isNotNull().alias(f"h{k}"))
    table = joined.groupBy("id").agg(*aggs)

    def holds(t) -> Column:
        if isinstance(t, Leaf):
            return F.col(f"h{own.index(t)}")
        result = F.lit(True)
        for part in t.must:
            result = result & holds(part)
        if not t.must and t.should:
            anything = F.lit(False)
            for part in t.should:
                anything = anything | holds(part)
            result = result & anything
        for part in t.without:
            result = result & ~holds(part)
        return result

    def weight(t) -> Column:
        if isinstance(t, Leaf):
            return F.col(f"w{own.index(t)}")
        total = F.lit(0.0)
        for part in (*t.must, *t.should):
            total = total + F.when(holds(part), weight(part)).otherwise(0.0)
        return total

    return table.filter(holds(tree)).select("id", weight(tree).alias("score"))


def _idf(n: int, df: int) -> float:
    """Inverse document frequency."""
    import math

    return math.log(1 + (n - df + 0.5) / (df + 0.5))


def _back(by: int):
    return lambda p: p - F.lit(by)


def query_terms(tree) -> list[str]:
    return sorted({t for leaf in leaves(tree) if leaf.field in TEXT_FIELDS for t in leaf.terms})


def search(index: Index, query: str, limit: int = 50, collection: str | None = None, first: int | None = None, last: int | None = None, skip: SkipList | None = None, compat_window: bool = False) -> DataFrame:
    """The best hits: (rank, id, url, timestamp, title, mime, s3_key, offset, length, collection, score).

    Collection, times and skip list filter before the ranking. With ``compat_window`` times filter only the best
    max(20 limit, 200), and the result may be short. A limit of 0 gives nothing.
    """
    hits = matches(index, parse(query)).join(index.docs, "id")
    if collection:
        hits = hits.filter(F.col("collection") == collection)
    if skip is not None:
        hits = hits.filter(~skip.listed(F.col("url")))
    during = F.lit(True)
    if first is not None:
        during = during & (F.col("timestamp") >= first)
    if last is not None:
        during = during & (F.col("timestamp") <= last)
    order = [F.desc("score"), F.asc("id")]
    if compat_window:
        hits = hits.orderBy(*order).limit(max(20 * limit, 200))
    top = hits.filter(during).orderBy(*order).limit(max(limit, 0))
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # limit rows at most
    at = F.lpad(F.col("timestamp").cast("string"), 14, "0")
    return ranked.select("rank", "id", "url", at.alias("timestamp"), "title", "mime", "s3_key", "offset", "length", "collection", "score")


def group_by_domain(hits: DataFrame) -> DataFrame:
    """Hits in groups of their domain: groups by their best rank, within one the newest first; place 1 is the head."""
    rows = hits.withColumn("domain", url_domain(F.col("url")))
    group = F.min("rank").over(Window.partitionBy("domain"))
    place = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("timestamp"), "rank"))
    return rows.withColumn("group_rank", group).withColumn("place", place)


def schema_compat(stored: list[str], target: list[str]) -> str:
    """identical, behind (the stored columns lack a suffix), or incompatible."""
    if stored == target:
        return "identical"
    return "behind" if stored == target[: len(stored)] else "incompatible"


def num_docs(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("num_docs"))
