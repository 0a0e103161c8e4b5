"""Problem 6: page boilerplate, by wrapper induction.

The archived bodies have lost their markup; what is left of a page's tree is a root with lines as its children, and each
line's own children: a constant part, its frame (what stands before the first or after the last mark: "» ...",
"More: ...", "... (12)"), and a slot. Trees of pages of one host are matched on both levels:

1. Simple tree matching of the lines: the longest ordered matching of equal lines. Lines matched on many pages are constant
   nodes, the template; lines never matched are varying nodes.
2. Varying lines are matched by their frames. A frame that comes back on the host's pages is a template's slot if its
   lines stand in blocks directly under constant nodes (a heading and what it lists), or if the frame has words of its own;
   frames of marks that follow varying lines are the content's own lists.

The content's own furniture is told by its place: nodes and frames that mostly stand right after a page's first varying
line, the headline, are bylines.

Where the induction is silent (hosts of too few pages, nodes matched seldom) a naive Bayes model over hashed features of
lines decides, trained on the induced labels of a bounded sample.

Pages of a host are matched in groups of bounded size, and what a node got is added over all groups, so a host may be of
any size, and so may a url's captures: they are dealt to many groups.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.line_features import SIZE, LineHasher, score
from lodestrata.llm.repeated_lines import _hash, letters, site_of
from lodestrata.store import materialize, table

#: Records used to fit the model.
SAMPLE = 6_000
#: Pages of a host in one group, captures of one url among them, and with how many pages of other urls each is matched.
GROUP, CAPTURES, PARTNERS = 256, 16, 6
#: Two pages with more of their leaves matched are taken for versions of one page and tell nothing.
SAME_PAGE = 0.85
#: A node is constant from this share of its matchings on, and from two of them.
CONSTANT = 0.12
#: A node never matched varies if it had the chance so many times.
VARYING = 4
#: A frame is a slot of the template from this share of blocks under constant nodes, or, if it has words, of the urls.
UNDER, WORDED = 0.3, 0.1
#: Blocks of a host's frame are judged together with so many from all hosts.
PRIOR = 4
LONG = 150
ROUNDS = 4
#: The model overrules a varying node from this score on.
SURE = 4.0

NODES_SCHEMA = "id long, site_key long, url_key long, nodes array<long>, pre array<long>, post array<long>, long array<boolean>"

#: Up to four words before the first mark, up to three after the last, or a number in brackets at the end.
_before = re.compile(r"((?:[\w.]+ ){0,3}[\w.]*[^\w\s.,;'’]+)\s").match
_after = re.compile(r"\s([^\w\s]+(?:\s\w+){1,3}|[^\w\s]+\d+[^\w\s]*)$").search
_digits = re.compile(r"\d+")
#: The frame's hash is odd if it has words.
_word = re.compile(r"[^\W\d_]{2}").search


def frame_key(frame: str) -> int:
    frame = _digits.sub("0", frame.lower())
    return _hash(frame) & ~1 | bool(_word(frame)) or 2


def frames(line: str) -> tuple[int, int]:
    """The labels of a short line's constant parts before and after its slot, 0 where there is none."""
    if not line or len(line) >= LONG:
        return 0, 0
    pre, post = _before(line), _after(line)
    return (frame_key(pre[1]) if pre else 0), (frame_key(post[1]) if post and post.start() else 0)


def node_key(site: str, line: str) -> int:
    """A line's label within its host: its letters in lower case, or its marks if it has none; 0 if it is blank."""
    own = letters(line) or "".join(line.split())
    return _hash(f"{site}\t{own}") if own else 0


def site_frame(site_key: int, frame: int) -> int:
    """A frame's label within its host."""
    return _hash(f"{site_key} {frame}") if frame else 0


class Nodes:
    """(node, frame before, frame after, long) of lines, with a memory for short ones."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, str], tuple[int, int, int, bool]] = {}

    def __call__(self, site: str, lines: list[str]) -> list[tuple[int, int, int, bool]]:
        out, known = [], self.known
        for line in lines:
            got = known.get((site, line))
            if got is None:
                own = line.strip()
                got = (node_key(site, line), *frames(own), len(own) >= LONG)
                if len(line) < 200:
                    if len(known) > 200_000:
                        known.clear()
                    known[(site, line)] = got
            out.append(got)
        return out


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nodes = Nodes()
    for batch in batches:
        out = []
        for i, url, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            site = site_of(url or "")
            out.append((i, _hash(site), _hash(url or ""), *([x[k] for x in own] for own in [nodes(site, body.split("\n"))] for k in range(4))))
        if out:
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.list_(pa.int64())) for c in columns[3:6]), pa.array(columns[6], pa.list_(pa.bool_()))],
                ["id", "site_key", "url_key", "nodes", "pre", "post", "long"],
            )


def places_of(nodes: list[int]) -> dict[int, list[int]]:
    """The places of each node, last first."""
    out: dict[int, list[int]] = {}
    for place in range(len(nodes) - 1, -1, -1):
        out.setdefault(nodes[place], []).append(place)
    return out


#: A leaf with more equals is matched with those of its own rank among them and so many ranks beside.
RANKS = 16


def tree_matching(left: list[int], right: dict[int, list[int]]) -> list[int]:
    """The leaves of ``left`` (places) in a largest ordered matching with equal leaves of another root; ``right`` has the
    places of each leaf there, last first. Leaves that occur often are matched near their own rank only, which keeps the work linear
    in the number of leaves."""
    ends: list[int] = []  # least last place of a matching of each length
    links: list[tuple[int, int]] = []
    tails: list[int] = []
    ranks: dict[int, int] = {}
    for place, key in enumerate(left):
        at_right = right.get(key)
        if at_right is None:
            continue
        if len(at_right) > RANKS:
            rank = ranks.get(key, 0)
            ranks[key] = rank + 1
            own = len(at_right) - 1 - rank
            at_right = at_right[max(own - RANKS, 0) : max(own + RANKS + 1, 0)]
        for at in at_right:
            k = bisect_left(ends, at)
            links.append((place, tails[k - 1] if k else -1))
            if k == len(ends):
                ends.append(at)
                tails.append(len(links) - 1)
            else:
                ends[k] = at
                tails[k] = len(links) - 1
    out = []
    at = tails[-1] if tails else -1
    while at >= 0:
        place, at = links[at]
        out.append(place)
    return out


#: What is counted of a node: matchings, chances, places, those right after a headline; of a frame: places, those right
#: after a headline, blocks, blocks under a constant node, urls, the urls of its groups.
COUNTS = ["matched", "seen", "places", "head", "blocks", "under", "urls", "of"]


class _Group:
    """Matches the pages of one group and adds what their nodes got to ``counts``: (key, frame) -> COUNTS."""

    def __init__(self, counts: dict[tuple[int, int], list[int]]) -> None:
        self.counts = counts

    def _count(self, key: int, frame: int = 0) -> list[int]:
        got = self.counts.get((key, frame))
        if got is None:
            got = self.counts[(key, frame)] = [0] * len(COUNTS)
        return got

    def __call__(self, site: int, pages: list[tuple[int, list[int], list[int], list[int], list[bool]]]) -> None:
        places = [places_of(p[1]) for p in pages]
        matched: dict[int, int] = {}
        seen: dict[int, int] = {}
        done: set[tuple[int, int]] = set()
        for i, page in enumerate(pages):
            partners = 0
            for step in range(1, len(pages)):
                j = (i + step) % len(pages)
                if pages[j][0] == page[0]:
                    continue
                if (j, i) in done:
                    break  # once around
                done.add((i, j))
                leaves = tree_matching(page[1], places[j])
                if len(leaves) < SAME_PAGE * min(len(page[1]), len(pages[j][1])):
                    for k in places[i]:
                        seen[k] = seen.get(k, 0) + 1
                    for k in places[j]:
                        if k not in places[i]:
                            seen[k] = seen.get(k, 0) + 1
                    for k in {page[1][p] for p in leaves}:
                        matched[k] = matched.get(k, 0) + 1
                partners += 1
                if partners == PARTNERS:
                    break
        for k, n in seen.items():
            got = self._count(k)
            got[0] += matched.get(k, 0)
            got[1] += n
        constant = {k for k, n in matched.items() if n >= 2 and n >= CONSTANT * seen[k]}
        urls: dict[int, set[int]] = {}
        for url, nodes, pre, post, _ in pages:
            for k in {f for side in (pre, post) for f, n in zip(side, nodes, strict=True) if f and n not in constant}:
                urls.setdefault(k, set()).add(url)
        many = max(2, WORDED * len({p[0] for p in pages}))
        for _, nodes, pre, post, _ in pages:
            head, block = -2, None
            for at, node in enumerate(nodes):
                fixed = node in constant
                own = [f for f in (pre[at], post[at]) if f]
                if head == -2 and not fixed and not any(len(urls[f]) >= many for f in own):
                    head = at
                after_head = at == head + 1 and head >= 0
                got = self._count(node)
                got[2] += 1
                got[3] += after_head
                if fixed:
                    block = ()
                elif own:
                    under = block == () or (bool(block) and any(f in block[0] for f in own) and block[1])
                    begins = not block or not any(f in block[0] for f in own)
                    for f in own:
                        got = self._count(site_frame(site, f), f)
                        got[2] += 1
                        got[3] += after_head
                        got[4] += begins
                        got[5] += begins and under and 0 <= head < at
                    block = (own, under)
                else:
                    block = None
        of = len({p[0] for p in pages})
        for f, own in urls.items():
            got = self._count(site_frame(site, f), f)
            got[6] += len(own)
            got[7] += of


COUNTS_SCHEMA = "key long, frame long, " + ", ".join(f"{c} long" for c in COUNTS)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[int, int], list[int]] = {}
    group = _Group(counts)
    now, pages = None, []

    def emit() -> pa.RecordBatch:
        keys, values = list(zip(*counts, strict=True)), list(zip(*counts.values(), strict=True))
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in [*keys, *values]], ["key", "frame", *COUNTS])

    for batch in batches:
        for site, part, url, *sides in zip(*(batch.column(c).to_pylist() for c in ("site_key", "part", "url_key", "nodes", "pre", "post", "long")), strict=True):
            if (site, part) != now:
                if pages:
                    group(now[0], pages)
                now, pages = (site, part), []
                if len(counts) > 100_000:
                    yield emit()
            kept = [k for k, x in enumerate(sides[0]) if x]
            if kept:
                pages.append((url, *([side[k] for k in kept] for side in sides)))
    if pages:
        group(now[0], pages)
    if counts:
        yield emit()


def node_verdicts(pages: DataFrame) -> DataFrame:
    """(key, verdict): what the induction tells of the nodes and frames of a host: 1 template, -1 content; a node or frame
    it is silent about has no row. Pages as in NODES_SCHEMA."""
    sizes = pages.groupBy("site_key", "url_key").agg(F.count("*").alias("n"))
    sites = sizes.groupBy("site_key").agg(F.sum("n").alias("pages"))
    dealt = (
        pages.join(sizes, ["site_key", "url_key"])
        .join(sites, "site_key")
        .withColumn("turn", F.expr(f"pmod(xxhash64(id), cast(ceil(n / {CAPTURES}) as long))"))
        .select("site_key", F.expr(f"pmod(xxhash64(url_key, turn), cast(ceil(pages / {GROUP}) as long))").alias("part"), "url_key", "id", "nodes", "pre", "post", "long")
        .repartition("site_key", "part")
        .sortWithinPartitions("site_key", "part", "url_key", "id")
        .drop("id")
    )
    got = materialize(dealt.mapInArrow(_counts, COUNTS_SCHEMA).groupBy("key", "frame").agg(*(F.sum(c).alias(c) for c in COUNTS)), "counts")
    leaves = got.filter("frame = 0").withColumn(
        "verdict",
        F.when(F.expr("2 * head >= places and matched > 0 and places > 1"), -1).when(F.expr(f"matched >= 2 and matched >= {CONSTANT} * seen"), 1).when(F.expr(f"matched = 0 and seen >= {VARYING}"), -1),
    )
    slots = got.filter("frame <> 0")
    usual = slots.groupBy("frame").agg((F.sum("under") / F.greatest(F.sum("blocks"), F.lit(1))).alias("usual"))
    slots = slots.join(usual, "frame").withColumn(
        "verdict",
        F.when(F.expr("2 * head >= places"), -1).when(
            F.expr(f"urls >= 2 and ((under + {PRIOR} * usual) / (blocks + {PRIOR}) >= {UNDER} or frame % 2 <> 0 and urls >= greatest(3, {WORDED} * of))"), 1
        ),
    )
    return leaves.select("key", "verdict").union(slots.select("key", "verdict")).filter("verdict is not null")


def keys_of(site_key: int, node: int, pre: int, post: int) -> list[int]:
    """The node's keys among the verdicts: its own, then those of its frames."""
    return [node, *(site_frame(site_key, f) for f in (pre, post) if f)]


def verdict_of(told: list[int]) -> int:
    """A line's verdict from those of its node and its frames: a slot of the template outdoes a varying node."""
    return 1 if told[0] == 1 or 1 in told[1:] else -1 if -1 in told else 0


def fit(labelled: list[tuple[str, float]]) -> np.ndarray:
    """Weights of the features from lines with their labels; after each round lines take the label of a clear score."""
    weights = np.zeros(SIZE)
    if not labelled:
        return weights
    lines = [x for x, _ in labelled]
    label = np.array([y for _, y in labelled])
    features, owner = LineHasher()(lines)
    # long lines would make whatever is in short ones look rare
    size = np.array([min(1.0, 60 / len(x)) ** 2 for x in lines])
    r = label.copy()
    for _ in range(ROUNDS):
        one = np.bincount(features, (r * size)[owner], SIZE)
        none = np.bincount(features, ((1 - r) * size)[owner], SIZE)
        ratio = max(one.sum(), 1.0) / max(none.sum(), 1.0)
        weights = np.log(one + max(ratio, 1.0)) - np.log(none * ratio + max(ratio, 1.0))
        total, number = score(weights, features, owner, len(lines))
        s = total / np.sqrt(np.maximum(number, 1))
        r = np.where(s > 2, 1.0, np.where(s < -2, 0.0, label))
    return weights


def _sample_labels(rows) -> list[tuple[str, float]]:
    out = []
    nodes = Nodes()
    for body, url, told in rows:
        own = {x["key"]: x["verdict"] for x in told or []}
        site, lines = site_of(url or ""), body.split("\n")
        for line, (node, pre, post, _) in zip(lines, nodes(site, lines), strict=True):
            if node:
                verdict = verdict_of([own.get(k, 0) for k in keys_of(_hash(site), node, pre, post)])
                if verdict:
                    out.append((line.strip(), float(verdict > 0)))
    return out


def _scorer(weights: np.ndarray):
    """Lines with their score and the keys of their node and frames, one row a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, nodes = LineHasher(), Nodes()
        slots: dict[tuple[int, int], int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 300):
                part = batch.slice(at, 300)
                ids, numbers, flat, keys, owners = [], [], [], [], []
                for i, url, body in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    site, lines = site_of(url or ""), body.split("\n")
                    site_key = _hash(site)
                    for n, (line, (node, *own, _)) in enumerate(zip(lines, nodes(site, lines), strict=True), 1):
                        if node:
                            keys.append(node)
                            owners.append(len(flat))
                            for f in own:
                                if f:
                                    k = slots.get((site_key, f))
                                    if k is None:
                                        if len(slots) > 200_000:
                                            slots.clear()
                                        k = slots[(site_key, f)] = site_frame(site_key, f)
                                    keys.append(k)
                                    owners.append(len(flat))
                            ids.append(i)
                            numbers.append(n)
                            flat.append(line.strip())
                if not flat:
                    continue
                features, owner = hasher(flat)
                total, number = score(weights, features, owner, len(flat))
                s = (total / np.sqrt(np.maximum(number, 1))).astype(np.float32)
                of = np.array(owners)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(ids, np.int64)[of]), pa.array(np.array(numbers, np.int32)[of]), pa.array(np.array(keys, np.int64)), pa.array(s[of])],
                    ["id", "line_no", "key", "score"],
                )

    return run


def boilerplate_lines(docs: DataFrame, id_col: str, url_col: str, text_col: str) -> DataFrame:
    """(id, line_no): the non-blank lines, counted from 1, that belong to the page's template and not to its content.

    Rows with a null id or text have no lines; a null url is a host of its own. Ids that come twice give the lines of both
    rows, each once. An empty table gives an empty result.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(text_col).alias("body")).filter("id is not null and body is not null")
    pages = materialize(own.mapInArrow(_nodes, NODES_SCHEMA), "nodes")
    verdicts = materialize(node_verdicts(pages), "verdicts")
    chosen = own.select("id").orderBy(F.xxhash64("id"), "id").limit(SAMPLE)  # SAMPLE ids at most
    sample = materialize(own.join(F.broadcast(chosen), "id", "left_semi"), "sample")
    told = (
        sample.mapInArrow(_scorer(np.zeros(SIZE)), "id long, line_no int, key long, score float")
        .select("id", "key")
        .join(verdicts, "key")
        .groupBy("id")
        .agg(F.collect_set(F.struct("key", "verdict")).alias("told"))
    )
    weights = fit(_sample_labels(sample.join(told, "id", "left").select("body", "url", "told").toLocalIterator()))
    scored = own.select("id", "url", "body").mapInArrow(_scorer(weights), "id long, line_no int, key long, score float")
    # of a line's rows: a constant node or a slot makes it template, else a varying node makes it content, else the score decides
    evidence = F.when(F.col("verdict") == 1, 100.0).when(F.col("verdict") == -1, -SURE).otherwise(0.0)
    lines = scored.join(verdicts, "key", "left").select("id", "line_no", "score", evidence.alias("evidence"))
    whole = lines.groupBy("id", "line_no").agg(F.max("score").alias("score"), F.max("evidence").alias("most"), F.min("evidence").alias("least"))
    return whole.filter(F.col("score") + F.when(F.col("most") > 0, F.col("most")).otherwise(F.col("least")) > 0).select("id", "line_no")


def _content(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for body, drop in zip(batch.column("body").to_pylist(), batch.column("drop").to_pylist(), strict=True):
            if body is not None:
                gone = set(drop or ())
                body = "\n".join(x.strip() for k, x in enumerate(body.split("\n"), 1) if k not in gone and x.strip())
            out.append(body)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.string())], ["id", "body"])


def main_content(docs: DataFrame, id_col: str, url_col: str, text_col: str) -> DataFrame:
    """(id, body): every record with the lines of its main content only; a null text stays null. Ids must be unique."""
    drop = boilerplate_lines(docs, id_col, url_col, text_col).groupBy("id").agg(F.collect_list("line_no").alias("drop"))
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    return own.join(drop, "id", "left").select("id", "body", "drop").mapInArrow(_content, "id long, body string")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate_lines(table(spark, sf_dir, "index_docs"), "rec_id", "url", "body").withColumnRenamed("id", "rec_id")


def p6_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_content(table(spark, sf_dir, "index_docs"), "rec_id", "url", "body").withColumnRenamed("id", "rec_id")


QUERIES = {"p6_found": p6_found, "p6_content": p6_content}
