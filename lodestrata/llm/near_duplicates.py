"""Problem 2: near-duplicate records with small edits, by bottom-k sketches.

Each text is reduced to the ``SKETCH`` smallest values that one hash function gives its shingles. Two texts of
similarity ``THRESHOLD`` share at least ``OVERLAP`` retained values (binomial, more than three standard deviations
below the mean at the threshold itself). Inverted lists hold, of each sketch, only its ``SKETCH - OVERLAP + 1`` rarest
values: two sketches with ``OVERLAP`` values in common meet in at least one of these lists, whichever global order is
taken, and values in many texts (site furniture, stock phrases) fall out of the lists by themselves. So no list needs
a cap. A meeting is kept if fingerprints carried in the lists agree often enough, then by the estimate over the
union's sketch, then by the exact Jaccard similarity of the two texts.

A text of no more than ``SKETCH`` distinct shingles is its own sketch. It shares at least ``THRESHOLD`` of its shingles
with a similar text, which are fewer than ``OVERLAP`` if it is repetitive, so its lists are longer by as much; its
fingerprints have too few bytes to tell anything and are not asked.

Texts with the same tokens are one class from the start; only its representative takes part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators.components import components
from lodestrata.store import materialize, table

SHINGLE = 3
THRESHOLD = 0.6
MIN_TOKENS = 120
SKETCH = 64
OVERLAP = 26
#: Of 16 one-byte fingerprints; at similarity 0.6 fewer than 4 agree once in a thousand, at 0.7 once in 50,000.
AGREE = 4
#: Estimates below are dropped; 4 standard deviations below THRESHOLD.
ESTIMATE = 0.36
#: Values in more texts than this count as frequent when a sketch's values are put in order.
FREQUENT = 20
#: At most so many frequent values are held by each worker (12 bytes each); beyond it they are joined.
FREQUENT_HELD = 2_000_000
#: A value in more texts is dealt to blocks of so many, and each two blocks meet in a list of their own.
BLOCK = 1_000
#: Copies of one text beyond this number are linked to the representative only, not to each other.
EXPAND_COPIES = 64

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_odd_space = re.compile("[\x0b\x0c\x1c-\x1f\x85]")


def tokens(body: str) -> list[str]:
    """The lower-cased body cut at runs of space, tab, CR and LF."""
    flat = body.lower().replace("\t", " ").replace("\r", " ").replace("\n", " ")
    return [w for w in flat.split(" ") if w]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * _M2
    x = x ^ (x >> np.uint64(32))
    x = x * _M1
    return (x ^ (x >> np.uint64(30))) >> np.uint64(1)


class ShingleHasher:
    """63-bit values of the shingles of many token lists at once; equal in every process."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Of each token list, the sorted distinct values of its shingles of three tokens."""
        known = self.known
        if len(known) > 1_000_000:
            known.clear()
        flat = []
        for text in texts:
            for w in text:
                h = known.get(w)
                if h is None:
                    h = known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
                flat.append(h)
        h = np.array(flat, dtype=np.uint64)
        if len(h) < SHINGLE:
            return [np.empty(0, np.int64) for _ in texts]
        s = _mix((h[:-2] * _M1) ^ _mix((h[1:-1] * _M3) ^ _mix(h[2:] * _M2))).view(np.int64)
        out, at = [], 0
        for text in texts:
            out.append(np.unique(s[at : max(at, at + len(text) - SHINGLE + 1)]))
            at += len(text)
        return out


def _fingerprints(values: np.ndarray) -> np.ndarray:
    """16 bytes: of each of 16 buckets, a byte of its least value (one-permutation hashing)."""
    out = np.zeros(16, np.uint8)
    bucket = values & 15
    first = np.unique(bucket, return_index=True)
    out[first[0]] = ((values[first[1]] >> 8) % 255 + 1).astype(np.uint8)
    return out


SKETCH_SCHEMA = "id long, k1 long, k2 long, n int, sketch array<long>, prints binary"


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = ShingleHasher()
    for batch in batches:
        ids, bodies = batch.column(0), batch.column(1)
        for start in range(0, len(ids), 500):
            keep, texts = [], []
            for i, body in zip(ids[start : start + 500].to_pylist(), bodies[start : start + 500].to_pylist(), strict=True):
                if body and len(t := tokens(body)) >= MIN_TOKENS:
                    keep.append((i, xxhash.xxh3_128_digest("\x20".join(t).encode("utf-8", "surrogatepass"))))
                    texts.append(t)
            if not keep:
                continue
            sets = hasher(texts)
            whole = np.frombuffer(b"".join(k for _, k in keep), np.int64).reshape(-1, 2)
            least = [s[:SKETCH] for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _ in keep], pa.int64()),
                    pa.array(np.ascontiguousarray(whole[:, 0])),
                    pa.array(np.ascontiguousarray(whole[:, 1])),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(s) for s in least]), pa.int32()), pa.array(np.concatenate(least))),
                    pa.array([_fingerprints(s).tobytes() for s in least], pa.binary()),
                ],
                ["id", "k1", "k2", "n", "sketch", "prints"],
            )


LIST_SCHEMA = "v long, id long, n int, prints binary"


def _dealt(v: np.ndarray, ids: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row): the lists each row goes to. Rows of a value in many texts are dealt to blocks by their ids, and go to a
    list for each other block, so that every two rows meet in one and no list is long."""
    blocks = np.maximum(-(-often // BLOCK), 1)
    times = np.maximum(blocks - 1, 1)
    again = np.repeat(np.arange(len(v)), times)
    key, of = v[again].copy(), blocks[again]
    split = np.flatnonzero(of > 1)
    if len(split):
        own = (_mix(ids.astype(np.uint64) * _M3) % blocks.astype(np.uint64)).astype(np.int64)[again][split]
        turn = (np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times))[split]
        other = turn + (turn >= own)
        pair = np.minimum(own, other) * of[split] + np.maximum(own, other) + 1
        key[split] = _mix(key[split].astype(np.uint64) * _M1 + pair.astype(np.uint64) * _M3).astype(np.int64)
    return key, again


def _rarest(held: tuple[np.ndarray, np.ndarray]):
    """Of each sketch its rarest values, frequent ones last and by their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, counts = held
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("sketch")
            v = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = np.asarray(lists.value_lengths())
            row = np.repeat(np.arange(len(sizes)), sizes)
            often = np.zeros(len(v), np.int64)
            if len(values):
                at = np.minimum(np.searchsorted(values, v), len(values) - 1)
                hit = values[at] == v
                often[hit] = counts[at[hit]]
            order = np.lexsort((v, often, row))
            place = np.arange(len(v)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keep = order[place < np.repeat(sizes - np.minimum(np.ceil(THRESHOLD * sizes).astype(np.int64), OVERLAP) + 1, sizes)]
            key, again = _dealt(v[keep], batch.column("id").to_numpy(zero_copy_only=False)[row[keep]], often[keep])
            take = pa.array(row[keep][again])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), batch.column("id").take(take), batch.column("n").take(take), batch.column("prints").take(take)],
                ["v", "id", "n", "prints"],
            )

    return run


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that meet in the lists of one partition, sorted by value; a list is worked off in blocks."""

    def pairs(left: np.ndarray, right: np.ndarray, ids, n, prints) -> pa.RecordBatch | None:
        ok = (n[left] >= THRESHOLD * n[right]) & (n[right] >= THRESHOLD * n[left])
        left, right = left[ok], right[ok]
        got = []
        for at in range(0, len(left), 200_000):
            i, j = left[at : at + 200_000], right[at : at + 200_000]
            x, y = prints[i], prints[j]
            got.append((((x == y) & (x > 0)).sum(1) >= AGREE) | (np.minimum(n[i], n[j]) <= SKETCH))
        if not got or not (ok := np.concatenate(got)).any():
            return None
        a, b = ids[left[ok]], ids[right[ok]]
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))], ["a", "b"])

    rest: list[pa.RecordBatch] = []

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        v, ids, n = (t.column(c).to_numpy() for c in ("v", "id", "n"))
        prints = np.frombuffer(b"".join(t.column("prints").to_pylist()), np.uint8).reshape(-1, 16)
        cuts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        sizes = np.diff(np.r_[cuts, len(v)])
        for size in np.unique(sizes[sizes > 1]):
            starts = cuts[sizes == size]
            if size <= 4 * BLOCK:
                i, j = np.triu_indices(size, 1)
                step = max(1, 1_000_000 // len(i))
                for k in range(0, len(starts), step):
                    s = starts[k : k + step, None]
                    if (got := pairs((s + i).ravel(), (s + j).ravel(), ids, n, prints)) is not None:
                        yield got
            else:  # only if ids crowd in a block: row by row against the list, still compared in numpy
                for s in starts:
                    for x in range(size - 1):
                        right = np.arange(s + x + 1, s + size)
                        if (got := pairs(np.full(len(right), s + x), right, ids, n, prints)) is not None:
                            yield got

    held = 0
    for batch in batches:
        rest.append(batch)
        held += batch.num_rows
        if held < 100_000:
            continue
        t = pa.Table.from_batches(rest).combine_chunks()
        v = t.column("v").to_numpy()
        cut = int(np.searchsorted(v, v[-1]))  # the last list may go on in the next batch
        if cut:
            yield from work(t.slice(0, cut))
        rest = t.slice(cut).combine_chunks().to_batches()
        held = t.num_rows - cut
    if rest and held:
        yield from work(pa.Table.from_batches(rest).combine_chunks())


def _jaccard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = ShingleHasher()
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
            texts = {}
            for ids, col in ((a, "body_a"), (b, "body_b")):
                for i, body in zip(ids, part.column(col).to_pylist(), strict=True):
                    if i not in texts:
                        texts[i] = tokens(body)
            sets = dict(zip(texts, hasher(list(texts.values())), strict=True))
            out = []
            for x, y in zip(a, b, strict=True):
                common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if common >= THRESHOLD * (len(sets[x]) + len(sets[y]) - common):
                    out.append((x, y, common / (len(sets[x]) + len(sets[y]) - common)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out, strict=True)], ["a", "b", "similarity"])


def _lists(distinct: DataFrame) -> DataFrame:
    """The inverted lists (v, id, n, prints)."""
    counts = distinct.select(F.explode("sketch").alias("v")).groupBy("v").count().filter(F.col("count") > FREQUENT)
    counts = materialize(counts, "frequent")
    if counts.count() <= FREQUENT_HELD:
        rows = counts.toPandas().sort_values("v")
        held = (rows["v"].to_numpy(np.int64), rows["count"].to_numpy(np.int64))
        return distinct.select("id", "n", "prints", "sketch").mapInArrow(_rarest(held), LIST_SCHEMA)
    ranked = (
        distinct.select("id", F.explode("sketch").alias("v"))
        .join(counts, "v", "left")
        .groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("often"), "v"))).alias("all"))
        .select("id", F.explode(F.expr(f"slice(all, 1, size(all) - least({OVERLAP}, cast(ceil({THRESHOLD} * size(all)) as int)) + 1)")).alias("x"))
        .select("id", "x.v", F.ceil(F.col("x.often") / BLOCK).alias("blocks"))
    )
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.greatest("blocks", F.lit(1)) - 1), lambda k: k != own)
    pair = F.xxhash64("v", F.least("own", "other"), F.greatest("own", "other"))
    split = ranked.filter("blocks > 1").select("id", "v", own.alias("own"), F.explode(others).alias("other")).select("id", pair.alias("v"))
    ranked = ranked.filter("blocks <= 1").select("id", "v").union(split)
    return ranked.join(distinct.select("id", "n", "prints"), "id").select("v", "id", "n", "prints")


def similar_classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(links, classes): links (a, b, similarity) between representatives of different texts with a Jaccard similarity
    of at least THRESHOLD; classes (id, rep) of every text in scope, equal texts having one rep.

    Texts that are null or have fewer than MIN_TOKENS tokens are out of scope. Ids must be unique; rows with a null id are
    left out. Empty tables give empty results.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body")).filter("id is not null and body is not null")
    sketches = materialize(own.mapInArrow(_sketches, SKETCH_SCHEMA), "sketches")
    reps = sketches.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    copied = materialize(
        sketches.select("id", "k1", "k2").join(reps.filter("copies > 1"), ["k1", "k2"]).select("id", "rep").filter("id <> rep"), "copies"
    )
    classes = sketches.select("id").join(copied, "id", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    distinct = sketches.join(copied, "id", "left_anti")
    lists = _lists(distinct)
    met = lists.repartition("v").sortWithinPartitions("v").mapInArrow(_meetings, "a long, b long").distinct()
    small = sketches.select("id", F.expr("transform(sketch, x -> cast(shiftright(x, 32) as int))").alias("s"), "n")
    near = (
        met.join(small.select(F.col("id").alias("a"), F.col("s").alias("sa"), F.col("n").alias("na")), "a")
        .join(small.select(F.col("id").alias("b"), F.col("s").alias("sb"), F.col("n").alias("nb")), "b")
        # the union's sketch: its least k values; those in both sketches estimate the similarity
        .withColumn("u", F.expr("slice(array_sort(array_union(sa, sb)), 1, greatest(size(sa), size(sb)))"))
        .filter(F.expr(f"size(array_intersect(array_intersect(sa, sb), u)) >= {ESTIMATE} * size(u)"))
        .select("a", "b")
    )
    near = materialize(near, "near")
    wanted = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    text = materialize(own.join(wanted, "id", "left_semi"), "texts")
    links = (
        near.join(text.select(F.col("id").alias("a"), F.col("body").alias("body_a")), "a")
        .join(text.select(F.col("id").alias("b"), F.col("body").alias("body_b")), "b")
        .mapInArrow(_jaccard, "a long, b long, similarity double")
    )
    return materialize(links, "links"), classes


def near_duplicate_pairs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_a, id_b), smaller first: the pairs of records of similarity THRESHOLD or more, copies included.

    Copies of one text are paired with each other up to EXPAND_COPIES of them; in larger sets of copies each is paired
    with the representative, and links between different texts are given for the representative, so that membership
    remains whole without listing all pairs of a set.
    """
    links, classes = similar_classes(docs, id_col, text_col)
    sizes = classes.groupBy("rep").agg(F.count("*").alias("copies")).filter("copies > 1")
    members = materialize(classes.join(sizes, "rep").select("rep", "id", "copies"), "members")
    few = members.filter(F.col("copies") <= EXPAND_COPIES).select("rep", "id")
    inner = few.alias("x").join(few.alias("y"), "rep").filter("x.id < y.id").select(F.col("x.id").alias("id_a"), F.col("y.id").alias("id_b"))
    star = members.filter((F.col("copies") > EXPAND_COPIES) & (F.col("id") != F.col("rep"))).select(F.col("rep").alias("id_a"), F.col("id").alias("id_b"))
    a = few.select(F.col("rep").alias("a"), F.col("id").alias("ida"))
    b = few.select(F.col("rep").alias("b"), F.col("id").alias("idb"))
    across = (
        links.join(a, "a", "left")
        .join(b, "b", "left")
        .select(F.coalesce("ida", "a").alias("x"), F.coalesce("idb", "b").alias("y"))
        .select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    )
    return inner.union(star).union(across)


def near_duplicate_groups(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, class_id, group_id, links): one row per record in scope with the class of its copies, the group of all that
    are linked to it directly or through others, and the number of different texts its text is linked to."""
    links, classes = similar_classes(docs, id_col, text_col)
    groups = components(links, "a", "b")
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    return (
        classes.join(groups.withColumnRenamed("node", "rep"), "rep", "left")
        .join(degree, "rep", "left")
        .select("id", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = near_duplicate_pairs(table(spark, sf_dir, "index_docs"), "rec_id", "body")
    return pairs.select(F.col("id_a").alias("rec_id_a"), F.col("id_b").alias("rec_id_b"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "index_docs"), "rec_id", "body")


QUERIES = {"p2_found": p2_found, "p2_groups": p2_groups}

SQL = {
    "p2_found": f"""
with t as (select rec_id, list_filter(regexp_split_to_array(lower(body), '[ \\t\\r\\n]+'), lambda x: x <> '') w from index_docs),
g as (select distinct rec_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as s from (select rec_id, w, unnest(range(1, len(w) - 1)) i from t where len(w) >= {MIN_TOKENS})),
n as (select rec_id, count(*) n from g group by 1),
c as (select a.rec_id x, b.rec_id y, count(*) c from g a join g b on a.s = b.s and a.rec_id < b.rec_id group by 1, 2)
select x as rec_id_a, y as rec_id_b from c join n p on p.rec_id = x join n q on q.rec_id = y where c >= {THRESHOLD} * (p.n + q.n - c)"""
}
