"""Problem 8: evaluation texts in the corpus, by Wu-Manber multi-pattern search.

The patterns are all runs of ``WORDS`` words of the passages, and for Japanese and Chinese items all runs of
``LETTERS`` letters and digits. Texts are laid out as one array of symbols (hashes of words, or code points). A block
of two symbols at the end of the window looks up how far the window may move: a block that stands in no pattern moves it
by the whole pattern length less one, so most positions are never looked at. Where the shift is zero, the hash of the
window's symbols selects the bucket of patterns, whose symbols are then compared one by one. All this runs on many
segments of the array at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.store import table

WORDS = 13
LETTERS = 30
#: Items are searched in blocks of this many, each one pass over the corpus, so that the tables are of bounded size.
ITEMS_HELD = 20_000
BY_LETTER = ("ja", "zh")
SEGMENT = 400
TABLE_BITS = 20

_words = re.compile(r"[^\W_]+").findall
_east = re.compile("[぀-ヿ㐀-鿿豈-﫿\U00020000-\U0002ffff]").search
_M = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Runs of letters and digits, lower-cased."""
    return _words(text.lower())


class Symbols:
    """Word hashes; 0 separates texts and is no word's hash."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def of_words(self, words: list[str], out: list[int]) -> None:
        known = self.known
        if len(known) > 1_000_000:
            known.clear()
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) | 1
            out.append(h)


def letters_of(text: str) -> np.ndarray:
    """The code points of the letters and digits of a text, lower-cased, as symbols."""
    flat = "".join(words_of(text))
    return np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


def _blocks(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return ((x * _M) ^ ((y * _M) >> np.uint64(17)) ^ (y << np.uint64(5))) * _M >> np.uint64(64 - TABLE_BITS)


class WuManber:
    """Patterns of ``length`` symbols each, with the items they belong to."""

    def __init__(self, length: int, passages: list[tuple[int, np.ndarray]]):
        self.length = length
        rows, owners = [], []
        for item, symbols in passages:
            if len(symbols) >= length:
                view = np.lib.stride_tricks.sliding_window_view(symbols, length)
                rows.append(view)
                owners += [item] * len(view)
        self.patterns = np.concatenate(rows) if rows else np.empty((0, length), np.uint64)
        owner = np.array(owners, np.int64)
        self.shift = np.full(1 << TABLE_BITS, length - 1, np.uint8)
        for j in range(length - 1):
            at = _blocks(self.patterns[:, j], self.patterns[:, j + 1])
            np.minimum.at(self.shift, at, length - 2 - j)
        power = np.power(_M, np.arange(length, dtype=np.uint64))
        self.power = power
        hashes = (self.patterns * power).sum(1, dtype=np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.patterns, self.owner = hashes[order], self.patterns[order], owner[order]

    def search(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ends, items) of all occurrences."""
        m = self.length
        if len(text) < m or not len(self.patterns):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.arange(m - 1, len(text), SEGMENT, dtype=np.int64)
        stop = np.minimum(at + SEGMENT, len(text))
        found = []
        while len(at):
            step = self.shift[_blocks(text[at - 1], text[at])]
            hit = at[step == 0]
            if len(hit):
                found.append(hit)
            at = at + np.maximum(step, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        ends = np.concatenate(found)
        window = np.lib.stride_tricks.sliding_window_view(text, m)
        out_e, out_i = [], []
        for k in range(0, len(ends), 100_000):
            e = ends[k : k + 100_000]
            rows = window[e - m + 1]
            h = (rows * self.power).sum(1, dtype=np.uint64)
            lo, hi = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
            in_bucket = hi > lo
            e, rows, lo, hi = e[in_bucket], rows[in_bucket], lo[in_bucket], hi[in_bucket]
            while len(e):
                same = (self.patterns[lo] == rows).all(1)
                out_e.append(e[same])
                out_i.append(self.owner[lo[same]])
                lo = lo + 1
                on = lo < hi
                e, rows, lo, hi = e[on], rows[on], lo[on], hi[on]
        if not out_e:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(out_e), np.concatenate(out_i)


def _build(items: list[tuple[int, str, str]]) -> tuple[WuManber, WuManber]:
    by_word, by_letter, symbols = [], [], Symbols()
    for item, lang, passage in items:
        if (lang or "").lower().replace("_", "-").split("-")[0] in BY_LETTER:
            by_letter.append((item, letters_of(passage)))
        else:
            out: list[int] = []
            symbols.of_words(words_of(passage), out)
            by_word.append((item, np.array(out, np.uint64)))
    return WuManber(WORDS, by_word), WuManber(LETTERS, by_letter)


def _searcher(items: list[tuple[int, str, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, letters = _build(items)
        symbols = Symbols()
        for batch in batches:
            got: set[tuple[int, int]] = set()
            ids = batch.column(0).to_pylist()
            flat: list[int] = [0]
            starts, owners = [], []
            east_ids, east = [], []

            def flush() -> None:
                """Search what has been laid out so far."""
                if owners:
                    ends, hit = words.search(np.array(flat, np.uint64))
                    doc = np.searchsorted(starts, ends, "right") - 1
                    got.update(zip(np.array(owners)[doc].tolist(), hit.tolist(), strict=True))
                    del flat[1:], starts[:], owners[:]
                if east:
                    zero = np.zeros(1, np.uint64)
                    lengths = np.array([len(x) + 1 for x in east])
                    ends, hit = letters.search(np.concatenate([y for x in east for y in (x, zero)]))
                    doc = np.searchsorted(np.cumsum(lengths) - lengths, ends, "right") - 1
                    got.update(zip(np.array(east_ids)[doc].tolist(), hit.tolist(), strict=True))
                    del east_ids[:], east[:]

            for i, text in zip(ids, batch.column(1), strict=True):
                text = text.as_py()
                if not text or i is None:
                    continue
                starts.append(len(flat))
                owners.append(i)
                symbols.of_words(words_of(text), flat)
                flat.append(0)
                if _east(text):
                    east_ids.append(i)
                    east.append(letters_of(text))
                if len(flat) > 500_000:
                    flush()
            flush()
            if got:
                rows = sorted(got)
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["doc_id", "item_id"])

    return run


def leaked(docs: DataFrame, id_col: str, text_col: str, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents that share WORDS consecutive words (LETTERS letters and digits for Japanese and Chinese
    items) with an item's passage, and the item.

    ``items`` has item_id, lang and passage; items without id or passage, or shorter than the run, match nothing. Null or
    empty texts match nothing; rows with a null id are left out. Repeated rows give one row. Where no item or document is
    given, the result is empty.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    result = spark.createDataFrame([], "doc_id long, item_id long")
    block: list[tuple[int, str, str]] = []

    def scan() -> DataFrame:
        return own.mapInArrow(_searcher(list(block)), "doc_id long, item_id long")

    scans = []
    for row in items.filter("item_id is not null and passage is not null").select("item_id", "lang", "passage").toLocalIterator():
        block.append((row[0], row[1], row[2]))
        if len(block) == ITEMS_HELD:
            scans.append(scan())
            block.clear()
    if block:
        scans.append(scan())
    for part in scans:
        result = part if len(scans) == 1 else result.union(part)
    return result.distinct()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, suite, documents, sources): the items that leaked, in how many documents and sources."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    items = table(spark, sf_dir, "eval_items").select("item_id", "suite")
    return (
        p8_found(spark, sf_dir)
        .join(docs, "doc_id")
        .join(F.broadcast(items), "item_id")
        .groupBy("item_id", "suite")
        .agg(F.count("*").alias("documents"), F.countDistinct("source").alias("sources"))
    )


QUERIES = {"p8_found": p8_found, "p8_report": p8_report}

_SQL = f"""
with d as (select doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') ws from documents),
i as (select item_id, lang, regexp_extract_all(lower(passage), '[\\p{{L}}\\p{{N}}]+') ws from eval_items),
dw as (select doc_id, ws[p:p + {WORDS - 1}] g from (select doc_id, ws, unnest(range(1, len(ws) - {WORDS - 2})) p from d where len(ws) >= {WORDS})),
iw as (select item_id, ws[p:p + {WORDS - 1}] g from (select item_id, ws, unnest(range(1, len(ws) - {WORDS - 2})) p from i where lang not in ('ja', 'zh') and len(ws) >= {WORDS})),
dl as (select doc_id, array_to_string(ws, '') s from d where regexp_matches(array_to_string(ws, ''), '[\\x{{3040}}-\\x{{30ff}}\\x{{3400}}-\\x{{9fff}}]')),
il as (select item_id, array_to_string(ws, '') s from i where lang in ('ja', 'zh')),
ds as (select doc_id, s[p:p + {LETTERS - 1}] g from (select doc_id, s, unnest(range(1, length(s) - {LETTERS - 2})) p from dl where length(s) >= {LETTERS})),
ls as (select item_id, s[p:p + {LETTERS - 1}] g from (select item_id, s, unnest(range(1, length(s) - {LETTERS - 2})) p from il where length(s) >= {LETTERS})),
found as (select distinct doc_id, item_id from dw join iw using (g) union select distinct doc_id, item_id from ds join ls using (g))
"""
SQL = {
    "p8_found": _SQL + "select doc_id, item_id from found",
    "p8_report": _SQL
    + "select item_id, suite, count(*) as documents, count(distinct source) as sources from found join documents using (doc_id) join eval_items using (item_id) group by 1, 2",
}
