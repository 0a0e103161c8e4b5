"""Problem 3: lines repeated across one site's documents, by suffix arrays over line identifiers.

Each body becomes a sequence of line identifiers that hold the site, so that lines of two sites never meet. The
documents are spread by site and url, never by site alone: a site of any size is cut into batches of bounded size, and
as all captures of a url are in one batch, numbers of urls add up over batches. Each batch's sequences are concatenated,
separated by symbols that occur once, and sorted into a suffix array by prefix doubling; runs of suffixes with common
prefixes, the array's prefix intervals, are the repeated blocks. An interval's urls are counted, the counts are added over
all batches, and the lines of blocks that span ``MIN_URLS`` urls are reported.

To report lines the blocks of 1, 2, 4, 8 and more lines are counted, to the end of the longest document. These stand for
blocks of every length: one of another length is covered by two of the next smaller power of two, which span its urls at
least. A line of too few letters ends a block. A block also spans no more urls than each of its lines, so by the definition
of a repeated line longer blocks confirm the lines of shorter ones and can add none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.store import materialize, table

MIN_URLS = 10
MIN_LETTERS = 3
#: Longest block that is counted, in lines.
MAX_BLOCK = 8
#: Lines in one suffix array; a url's captures stay together.
BATCH_LINES = 250_000
#: Captures of one url that one task takes.
DEALT = 2_000

_not_letters = regex.compile(r"\P{L}+")


_ascii_marks = bytes(c for c in range(128) if not chr(c).isalpha())


def letters(line: str) -> str:
    """What makes lines equal: their letters in lower case."""
    own = line.lower().encode("utf-8", "surrogatepass").translate(None, _ascii_marks).decode("utf-8", "surrogatepass")
    return own if own.isalpha() else _not_letters.sub("", own)


def site_of(url: str) -> str:
    """The url's host in lower case, without user, port and a leading www."""
    rest = url.partition("://")[2] or url
    for mark in "/?#\\":
        rest = rest.partition(mark)[0]
    host = rest.rpartition("@")[2].lower()
    host = host.partition("]")[0] + "]" if host.startswith("[") else host.partition(":")[0]
    return host[4:] if host.startswith("www.") else host


def _hash(text: str) -> int:
    return (xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1) or 1


LINES_SCHEMA = "id long, site_key long, url_key long, lines array<long>"


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[tuple[str, str], int] = {}
    for batch in batches:
        out: list[tuple[int, int, int, list[int]]] = []
        for i, url, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            site = site_of(url)
            keys = []
            for line in body.split("\n"):
                key = known.get((site, line))
                if key is None:
                    own = letters(line)
                    key = _hash(f"{site}\n{own}") if len(own) >= MIN_LETTERS else 0
                    if len(line) < 200:
                        if len(known) > 300_000:
                            known.clear()
                        known[(site, line)] = key
                keys.append(key)
            out.append((i, _hash(site), _hash(url), keys))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int64()), pa.array([r[3] for r in out], pa.list_(pa.int64()))],
                ["id", "site_key", "url_key", "lines"],
            )


def suffix_array(symbols: np.ndarray, longest: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array by prefix doubling and, of each doubling, the ranks of all positions: equal ranks at level k mean
    equal prefixes of 2**k symbols. It is sorted by prefixes of ``longest`` symbols at least, or entirely."""
    _, rank = np.unique(symbols, return_inverse=True)
    rank = rank.astype(np.int64)
    levels, width, n = [rank], 1, len(symbols)
    while width < longest and rank.max(initial=0) < n - 1:
        after = np.full(n, -1, np.int64)
        after[: max(0, n - width)] = rank[width:]
        _, rank = np.unique(rank * (n + 1) + after + 1, return_inverse=True)
        levels.append(rank := rank.astype(np.int64))
        width *= 2
    return np.argsort(rank, kind="stable"), levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Of each neighbouring pair of the suffix array, the length of the common prefix as far as the levels tell."""
    n = len(order)
    i, j = order[:-1].copy(), order[1:].copy()
    length = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (i < n) & (j < n)
        same = np.zeros(len(i), bool)
        same[inside] = levels[k][i[inside]] == levels[k][j[inside]]
        step = same * (1 << k)
        length += step
        i, j = i + step, j + step
    return length


BLOCK_SCHEMA = "block long, size int, urls long, url long"
PLACE_SCHEMA = "id long, at int, size int, block long"


def prefix_intervals(order: np.ndarray, lcp: np.ndarray, size: int) -> np.ndarray:
    """Of each suffix in the array's order, the number of its interval: neighbours with ``size`` symbols in common."""
    return np.cumsum(np.r_[True, lcp < size]) - 1 if len(order) else np.empty(0, np.int64)


def block_keys(ids: np.ndarray, longest: int | None) -> Iterator[tuple[int, np.ndarray]]:
    """Of each size in lines, the keys of the blocks that start at each position: sizes up to ``longest``, or 1, 2, 4 and so
    on without end if it is None. Keys of blocks that don't end within their document tell nothing."""
    key, size = ids.astype(np.uint64), 1
    while longest is None or size <= longest:
        yield size, key
        after = np.zeros_like(key)
        if longest is None:
            after[: max(0, len(key) - size)] = key[size:]
            key = (key * np.uint64(0x9E3779B97F4A7C15)) ^ after
            key = (key ^ (key >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            size *= 2
        else:
            after[: max(0, len(key) - size)] = ids.astype(np.uint64)[size:]
            key = (key * np.uint64(0x9E3779B97F4A7C15)) ^ ((after >> np.uint64(3)) + np.uint64(size))
            size += 1


def _room(gap: np.ndarray) -> np.ndarray:
    """Of each position, the lines up to the next gap; the last position is one."""
    to_gap = np.flatnonzero(gap)
    return to_gap[np.searchsorted(to_gap, np.arange(len(gap)))] - np.arange(len(gap))


def _count_blocks(ids: np.ndarray, urls: np.ndarray, longest: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the concatenated lines (0 between documents): the blocks' keys, sizes in lines and the urls they stand in, each
    once. Blocks that span documents are none; those that stand once count too, for they may stand in other batches."""
    symbols = ids.copy()
    gap = symbols == 0
    symbols[gap] = -1 - np.arange(gap.sum())
    order, levels = suffix_array(symbols, longest or len(ids))
    lcp = common_prefixes(order, levels)
    room = _room(gap)
    known, url = np.unique(urls, return_inverse=True)
    out = []
    for size, key in block_keys(ids, longest):
        interval = prefix_intervals(order, lcp, size)
        inside = room[order] >= size
        if not inside.any():
            break
        pairs = np.unique(interval[inside] * len(known) + url[order[inside]])
        first = np.full(interval[-1] + 1, -1, np.int64)
        first[interval[inside][::-1]] = order[inside][::-1]
        out.append((key[first[pairs // len(known)]].view(np.int64), np.full(len(pairs), size, np.int32), known[pairs % len(known)]))
    if not out:
        return (np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _blocks(longest: int | None):
    def batch_of(ids: list[int], urls: list[int], split: set[int]) -> pa.RecordBatch:
        block, size, url = _count_blocks(np.array(ids, np.int64), np.array(urls, np.int64), longest)
        apart = np.isin(url, np.array(sorted(split), np.int64))
        # a url that lies in one batch only is counted here; of one that is dealt to many the url itself goes on
        own, of = block[~apart], size[~apart]
        starts = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (of[1:] != of[:-1])]) if len(own) else np.empty(0, np.int64)
        n = len(starts)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.r_[own[starts], block[apart]]),
                pa.array(np.r_[of[starts], size[apart]].astype(np.int32)),
                pa.array(np.r_[np.diff(np.r_[starts, len(own)]), np.ones(apart.sum(), np.int64)].astype(np.int64)),
                pa.array(np.r_[np.zeros(n, np.int64), url[apart]], mask=np.r_[np.ones(n, bool), np.zeros(apart.sum(), bool)]),
            ],
            ["block", "size", "urls", "url"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        urls: list[int] = []
        split: set[int] = set()
        last = None
        seen: set[tuple[int, ...]] = set()
        for batch in batches:
            for url, dealt, lines in zip(*(batch.column(c).to_pylist() for c in ("url_key", "dealt", "lines")), strict=True):
                if url != last or dealt:
                    if len(ids) > BATCH_LINES:
                        yield batch_of(ids, urls, split)
                        ids, urls, split = [], [], set()
                if url != last:
                    last, seen = url, set()
                if dealt:
                    split.add(url)
                    seen = set()
                own = tuple(lines)
                if any(own) and own not in seen:  # captures of a url with the same lines count once
                    if not dealt:
                        seen.add(own)
                    ids += (*own, 0) if longest != 1 else (*(x for x in set(own) if x), 0)
                    urls += [url] * (len(ids) - len(urls))
        if ids:
            yield batch_of(ids, urls, split)

    return run


def _sequences(docs: DataFrame, id_col: str, url_col: str, text_col: str) -> DataFrame:
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(text_col).alias("body"))
    return materialize(own.filter("id is not null and url is not null and body is not null").mapInArrow(_lines, LINES_SCHEMA), "lines")


def _counted(sequences: DataFrame, longest: int | None) -> DataFrame:
    """(block, size, urls) of the blocks of up to ``longest`` lines, or of 1, 2, 4 and more lines to the end of the longest
    document if it is None, in at least MIN_URLS urls of their site.

    Captures are dealt by url, so that the urls counted in each batch add up. A url with more than DEALT captures is dealt
    to many tasks, and its (block, url) pairs are made distinct before they are counted.
    """
    often = sequences.groupBy("url_key").count().filter(F.col("count") > DEALT)
    turn = F.when(F.col("count").isNull(), 0).otherwise(F.expr(f"pmod(xxhash64(id), cast(ceil(count / {DEALT}) as long))"))
    spread = (
        sequences.join(often, "url_key", "left")
        .select("url_key", F.col("count").isNotNull().alias("dealt"), turn.alias("turn"), "lines")
        .repartition("url_key", "turn")
        .sortWithinPartitions("url_key", "turn")
    )
    blocks = spread.select("url_key", "dealt", "lines").mapInArrow(_blocks(longest), BLOCK_SCHEMA)
    blocks = blocks.repartition("size", "block").groupBy("size", "block", "url").agg(F.sum("urls").alias("n"), F.first("url").alias("own"))
    counts = blocks.groupBy("size", "block").agg(F.sum(F.when(F.col("own").isNull(), F.col("n")).otherwise(1)).alias("urls"))
    return counts.filter(F.col("urls") >= MIN_URLS)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where blocks of 1, 2, 4 and more lines start in their document, from 0."""
    for batch in batches:
        lengths = batch.column("lines").value_lengths().to_numpy(zero_copy_only=False)
        if not len(lengths):
            continue
        row = np.repeat(np.arange(len(lengths)), lengths + 1)
        at = np.arange(len(row)) - np.repeat(np.cumsum(lengths + 1) - lengths - 1, lengths + 1)
        ids = np.zeros(len(row), np.int64)  # 0 after each document
        ids[at < lengths[row]] = batch.column("lines").flatten().to_numpy(zero_copy_only=False)
        own = batch.column("id").to_numpy(zero_copy_only=False)
        room = _room(ids == 0)
        for size, key in block_keys(ids, None):
            start = np.flatnonzero(room >= size)
            if not len(start):
                break
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[row[start]]), pa.array(at[start].astype(np.int32)), pa.array(np.full(len(start), size, np.int32)), pa.array(key[start].view(np.int64))],
                ["id", "at", "size", "block"],
            )


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The numbers, from 1, of the lines that blocks cover, each once; the blocks come by id and start."""
    last, reached = None, 0  # the lines of the last id are reported up to here
    for batch in batches:
        ids, at, size = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("id", "at", "size"))
        if not len(ids):
            continue
        new = np.r_[ids[0] != last, ids[1:] != ids[:-1]]
        apart = np.cumsum(new) << 40  # so that the ends of one id are below those of the next
        end = np.maximum.accumulate(np.r_[reached, apart + at + size])
        begin = np.maximum(end[:-1], apart + at) - apart
        count = np.maximum(end[1:] - apart - begin, 0)
        line = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)
        last, reached = ids[-1], end[-1] - apart[-1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, count)), pa.array((line + 1).astype(np.int32))], ["id", "line_no"])


def repeated_lines(docs: DataFrame, id_col: str, url_col: str, text_col: str) -> DataFrame:
    """(id, line_no): the lines, counted from 1, of the blocks of any length that stand in at least MIN_URLS urls of their
    site; so the lines whose letters do.

    Each record's blocks of 1, 2, 4 and more lines are looked up among the repeated ones, and the lines that these cover are
    reported. Rows with a null id, url or text have no lines. Lines with fewer than MIN_LETTERS letters do not count. An id
    that comes twice gives the lines of both rows once.
    """
    sequences = _sequences(docs, id_col, url_col, text_col)
    often = _counted(sequences, None).select("size", "block")
    places = sequences.select("id", "lines").mapInArrow(_places, PLACE_SCHEMA).join(often, ["size", "block"], "left_semi")
    return places.select("id", "at", "size").repartition("id").sortWithinPartitions("id", "at").mapInArrow(_covered, "id long, line_no int")


def repeated_blocks(docs: DataFrame, id_col: str, url_col: str, text_col: str) -> DataFrame:
    """(block, size, urls): the keys of the blocks of 1 to MAX_BLOCK lines that stand in at least MIN_URLS urls of their
    site, wherever these lie. Lines that are not repeated themselves are in no block and are left out first."""
    sequences = _sequences(docs, id_col, url_col, text_col)
    often = _counted(sequences, 1).select(F.col("block").alias("line"))
    kept = (
        sequences.withColumn("row", F.monotonically_increasing_id())
        .select("id", "url_key", "row", F.posexplode("lines").alias("at", "line"))
        .filter("line <> 0")
        .join(often.withColumn("own", F.lit(True)), "line", "left")
    )
    lines = F.transform(F.array_sort(F.collect_list(F.struct("at", F.when(F.col("own"), F.col("line")).otherwise(0).alias("line")))), lambda x: x["line"])
    return _counted(kept.groupBy("id", "url_key", "row").agg(lines.alias("lines")), MAX_BLOCK)


def _delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for body, drop in zip(batch.column("body").to_pylist(), batch.column("drop").to_pylist(), strict=True):
            if body is not None and drop:
                gone = set(drop)
                body = "\n".join(line for k, line in enumerate(body.split("\n"), 1) if k not in gone)
            out.append(body)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.string())], ["id", "body"])


def without_repeated_lines(docs: DataFrame, id_col: str, url_col: str, text_col: str) -> DataFrame:
    """(id, body): every record with the repeated lines deleted; a null text stays null. Ids must be unique."""
    drop = repeated_lines(docs, id_col, url_col, text_col).groupBy("id").agg(F.collect_list("line_no").alias("drop"))
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    return own.join(drop, "id", "left").select("id", "body", "drop").mapInArrow(_delete, "id long, body string")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(table(spark, sf_dir, "index_docs"), "rec_id", "url", "body").withColumnRenamed("id", "rec_id")


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeated_lines(table(spark, sf_dir, "index_docs"), "rec_id", "url", "body").withColumnRenamed("id", "rec_id")


QUERIES = {"p3_found": p3_found, "p3_clean": p3_clean}

_SQL = f"""
with l as (select rec_id, url, regexp_replace(lower(regexp_extract(url, '^[^:]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '^www\\.', '') site, string_split(body, chr(10)) ls from index_docs),
x as (select rec_id, url, site, line_no, ls[line_no] line, regexp_replace(lower(ls[line_no]), '[^\\p{{L}}]', '', 'g') k from (select *, unnest(range(1, len(ls) + 1)) line_no from l)),
o as (select site, k from x where length(k) >= {MIN_LETTERS} group by 1, 2 having count(distinct url) >= {MIN_URLS})
"""
SQL = {
    "p3_found": _SQL + "select rec_id, line_no::int as line_no from x join o using (site, k)",
    "p3_clean": _SQL
    + """select rec_id, coalesce(string_agg(line, chr(10) order by line_no) filter (where o.k is null), '') as body
         from x left join o on x.site = o.site and x.k = o.k group by rec_id""",
}
