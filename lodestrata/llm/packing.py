"""Problem 7: filling fixed-capacity containers with texts, by a grouping genetic algorithm.

Texts are sized in tokens of a public tokenizer. A text that alone exceeds the capacity is cut into pieces that fill a
container each, and a rest; no other text is split. All rests and texts are dealt by hash into batches of bounded size.
Each batch is evolved on several islands: a solution's genes are its containers; crossover injects well-filled containers
of one parent into the other, removes the containers that hold their texts twice, and puts the displaced texts back: a
text of a container gives way to a larger displaced one that fits, and what is left goes in by best fit. Mutation empties
a part of the containers that are not full. Between epochs the islands of a batch pass their elites on in a ring.

Of each batch's best solution the worst containers are opened again, and their texts are dealt into fewer batches, round
by round until one batch is left, so that the space that batches leave does not add up.
"""

from __future__ import annotations

import base64
import importlib.util
import os
import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.store import materialize, table

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Texts in a batch (on average), islands, epochs, and within an epoch the solutions and generations of an island.
BATCH, ISLANDS, EPOCHS, POPULATION, GENERATIONS = 12_000, 2, 2, 4, 15
#: Share of a parent's containers that a crossover injects, of the containers with space that a mutation empties, and of a
#: batch's containers that the next round opens.
INJECTED, EMPTIED, OPENED = 0.12, 0.5, 0.1
#: Texts of a container that are tried in pairs for a larger one.
PAIRED = 12
#: Longest run of white space that the tokenizer's pattern stands; longer runs are sized in pieces of as many.
RUN = 10_000

_run = re.compile(r"\s{%d}(?=\s)" % RUN)


@cache
def _encoding(folder: str, vocabulary: str):
    import tiktoken

    spec = importlib.util.spec_from_file_location("lodestrata_tokenizers", os.path.join(os.path.realpath(folder), "__init__.py"))
    public = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(public)
    with open(os.path.join(folder, vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(encoding, text: str) -> int:
    total, at = 0, 0
    for m in _run.finditer(text):
        total += len(encoding.encode_ordinary(text[at : m.end()]))
        at = m.end()
    return total + len(encoding.encode_ordinary(text[at:] if at else text))


def _sizes(folder: str, vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(folder, vocabulary)
        for batch in batches:
            sizes = [_count(encoding, t) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["id", "tokens"])

    return run


def token_sizes(docs: DataFrame, id_col: str, text_col: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, tokens): the size of every text in tokens; null and empty texts have none. Special tokens' strings are text."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(_sizes(folder, vocabulary), "id long, tokens long")


class Bins:
    """Open containers in order of the space left."""

    def __init__(self, capacity: int, left: list[tuple[int, int]]):
        self.capacity, self.left = capacity, sorted(left)
        self.next = max((b for _, b in left), default=-1) + 1

    def put(self, size: int) -> int:
        """Best fit: the container with the least space that is enough, else a new one."""
        k = bisect_left(self.left, (size, -1))
        if k < len(self.left):
            space, b = self.left.pop(k)
        else:
            space, b = self.capacity, self.next
            self.next += 1
        insort(self.left, (space - size, b))
        return b


def _fit(sizes: np.ndarray, order: np.ndarray, capacity: int) -> np.ndarray:
    bins = Bins(capacity, [])
    place = np.empty(len(sizes), np.int32)
    for k, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        place[k] = bins.put(size)
    return place


def _fitness(place: np.ndarray, sizes: np.ndarray, capacity: int) -> float:
    """The mean square of the containers' filling: few full containers are better than many alike."""
    fill = np.bincount(place, sizes) / capacity
    return float((fill[fill > 0] ** 2).mean()) if len(fill) else 1.0


def _reinsert(place: np.ndarray, loose: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Put the loose items into what the others leave. One or two items of a container with space give way to the largest
    loose one that fits in their stead; then all that is loose goes in by best fit, largest first."""
    kept = np.ones(len(place), bool)
    kept[loose] = False
    bins = int(place.max(initial=0)) + 1
    fill = np.bincount(place[kept], sizes[kept], minlength=bins).astype(np.int64)
    count = np.bincount(place[kept], minlength=bins)
    size = sizes.tolist()
    free = sorted((size[i], i) for i in loose.tolist())
    with_space = np.flatnonzero((count > 0) & (fill < capacity)).tolist()
    space = (capacity - fill).tolist()
    order = np.argsort(place, kind="stable")
    order = order[kept[order]]
    starts = np.searchsorted(place[order], np.arange(bins + 1)).tolist()
    order = order.tolist()
    for b in with_space:
        room, own = space[b], order[starts[b] : starts[b + 1]]
        gain, at, leave = 0, -1, ()
        pairs = own[:PAIRED]
        for out in [*((i,) for i in own), *((i, j) for n, i in enumerate(pairs) for j in pairs[:n])]:
            taken = sum(size[i] for i in out)
            k = bisect_right(free, (taken + room, len(size))) - 1
            if k >= 0 and free[k][0] - taken > gain:
                gain, at, leave = free[k][0] - taken, k, out
                if gain == room:
                    break
        if leave:
            place[free.pop(at)[1]] = b
            space[b] -= gain
            for i in leave:
                insort(free, (size[i], i))
    open_bins = Bins(capacity, [(space[b], b) for b in with_space if space[b] > 0])
    open_bins.next = bins
    for n, i in reversed(free):
        place[i] = open_bins.put(n)
    return np.unique(place, return_inverse=True)[1].astype(np.int32)


def crossover(one: np.ndarray, other: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A child of ``one`` with whole well-filled containers of ``other``."""
    fill = np.bincount(other, sizes)
    best = np.argsort(-(fill + rng.random(len(fill)) * capacity * 0.1))[: max(1, int(len(fill) * INJECTED * 2))]
    chosen = np.zeros(len(fill), bool)
    chosen[rng.permutation(best)[: max(1, len(best) // 2)]] = True
    injected = chosen[other]
    hit = np.zeros(int(one.max()) + 1, bool)
    hit[one[injected]] = True
    loose = np.flatnonzero(hit[one] & ~injected)
    child = one.copy()
    child[injected] = other[injected] + len(hit)
    return _reinsert(child, loose, sizes, capacity)


def mutate(place: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A part of the containers with space, the worst two among them, are emptied and their items put back."""
    fill = np.bincount(place, sizes)
    spare = rng.permutation(np.flatnonzero(fill < capacity))
    out = np.zeros(len(fill), bool)
    out[spare[: int(len(spare) * EMPTIED)]] = True
    out[np.argsort(fill, kind="stable")[:2]] = True
    return _reinsert(place.copy(), np.flatnonzero(out[place]), sizes, capacity)


def evolve(sizes: np.ndarray, capacity: int, elites: list[np.ndarray], seed: int) -> list[np.ndarray]:
    """One epoch of an island; the best solutions, best first."""
    rng = np.random.default_rng(seed)
    population = list(elites)
    if not population:
        population.append(_fit(sizes, np.argsort(-sizes, kind="stable"), capacity))
    while len(population) < POPULATION:
        population.append(_fit(sizes, np.argsort(-(sizes * (1 + 0.15 * rng.random(len(sizes)))), kind="stable"), capacity))
    scored = sorted(((_fitness(p, sizes, capacity), k, p) for k, p in enumerate(population)), key=lambda x: (-x[0], x[1]))
    least = int(-(-sizes.sum() // capacity))
    for g in range(GENERATIONS):
        if scored[0][2].max(initial=-1) + 1 <= least:
            break  # as few containers as there can be
        a, b = rng.choice(min(3, len(scored))), rng.integers(0, len(scored))
        child = crossover(scored[a][2], scored[b][2], sizes, capacity, rng) if a != b else mutate(scored[a][2], sizes, capacity, rng)
        if g % 3 == 2:
            child = mutate(child, sizes, capacity, rng)
        entry = (_fitness(child, sizes, capacity), POPULATION + g, child)
        if entry[0] > scored[-1][0]:
            scored = sorted([*scored[:-1], entry], key=lambda x: (-x[0], x[1]))
    return [p for _, _, p in scored[:2]]


ITEMS = "array<struct<id:bigint,piece:int,tokens:bigint>>"
STATE_SCHEMA = f"spec_id int, capacity long, batch long, batches long, island int, items {ITEMS}, elites array<array<int>>"


def _epoch(number: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1)
                spec, capacity, at, island = (r.column(c)[0].as_py() for c in ("spec_id", "capacity", "batch", "island"))
                sizes = r.column("items")[0].values.field("tokens").to_numpy(zero_copy_only=False)
                elites = [np.array(e, np.int32) for e in r.column("elites")[0].as_py() or []]
                seed = (at * 1_000_003 + spec * 101 + island * 7 + number) % (1 << 63)
                found = [p.tolist() for p in evolve(sizes, capacity, elites, seed)]
                yield r.set_column(r.schema.get_field_index("elites"), r.schema.field("elites"), pa.array([found], r.schema.field("elites").type))

    return run


PLACED_SCHEMA = "spec_id int, capacity long, batch long, batches long, container string, id long, piece int, tokens long"


def _settled(round_number: int):
    """The items with their containers; those of containers that are opened again have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                place, items = np.array(r["place"], np.int64), r["items"]
                fill = np.bincount(place, [x["tokens"] for x in items])
                again = np.zeros(len(fill), bool)
                if r["batches"] > 1:
                    again[np.argsort(fill, kind="stable")[: max(2, int(len(fill) * OPENED))]] = True
                n = len(items)
                names = [None if again[p] else f"b{round_number}-{r['batch']}-{p}" for p in r["place"]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["spec_id"]] * n, pa.int32()), *(pa.array([r[c]] * n, pa.int64()) for c in ("capacity", "batch", "batches")), pa.array(names, pa.string()),
                        pa.array([x["id"] for x in items], pa.int64()), pa.array([x["piece"] for x in items], pa.int32()), pa.array([x["tokens"] for x in items], pa.int64()),
                    ],
                    [x.split(" ")[0] for x in PLACED_SCHEMA.split(", ")],
                )

    return run


def _packed(items: DataFrame, round_number: int) -> DataFrame:
    """PLACED_SCHEMA of items (spec_id, capacity, batches, id, piece, tokens), by all epochs of one round."""
    batch = F.pmod(F.xxhash64("id", "piece", F.lit(7 + round_number)), F.col("batches")).alias("batch")
    dealt = items.select("spec_id", "capacity", "batches", batch, F.struct("id", "piece", "tokens").alias("item")).groupBy("spec_id", "capacity", "batches", "batch").agg(F.array_sort(F.collect_list("item")).alias("items"))
    state = dealt.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1)))).withColumn("elites", F.array().cast("array<array<int>>"))
    columns = ["spec_id", "capacity", "batch", "batches", "island", "items", "elites"]
    for number in range(EPOCHS):
        state = materialize(state.select(*columns).repartition("spec_id", "batch", "island").mapInArrow(_epoch(number), STATE_SCHEMA), "islands")
        if number < EPOCHS - 1:  # each island goes on with its best and that of the island before
            sent = state.select("spec_id", "batch", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.slice("elites", 1, 1).alias("came"))
            state = state.join(sent, ["spec_id", "batch", "island"]).withColumn("elites", F.concat(F.slice("elites", 1, 2), "came"))
    ranked = state.withColumn("place", F.col("elites")[0]).withColumn("used", F.array_max("place"))
    best = ranked.groupBy("spec_id", "capacity", "batch", "batches").agg(F.min_by(F.struct("items", "place"), F.struct("used", "island")).alias("x")).select("spec_id", "capacity", "batch", "batches", "x.*")
    return materialize(best.mapInArrow(_settled(round_number), PLACED_SCHEMA), "placed")


def pack(sizes: DataFrame, specs: list[tuple[int, int]]) -> DataFrame:
    """(spec_id, container, id, piece, tokens): into which container of each capacity every text or piece goes.

    ``sizes`` (id, tokens); ``specs`` (spec_id, capacity). Texts without tokens need no container and are left out, as are
    rows with a null id and specs without a positive capacity. Rows that come twice are packed twice.
    """
    spark = sizes.sparkSession
    specs = [(int(s), int(c)) for s, c in specs if s is not None and c and c > 0]
    empty = spark.createDataFrame([], "spec_id int, container string, id long, piece int, tokens long")
    if not specs:
        return empty
    sizes = materialize(sizes.filter("id is not null and tokens > 0"), "sizes")
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("spec_id"), F.lit(c).cast("long").alias("capacity")) for s, c in specs]))
    cut = sizes.withColumn("spec", each).select("spec.*", "id", "tokens", F.expr("tokens div spec.capacity").alias("full"), F.expr("tokens % spec.capacity").alias("rest"))
    whole = cut.filter("full > 0").select("spec_id", "capacity", "id", F.explode(F.expr("sequence(0, cast(full as int) - 1)")).alias("piece"))
    whole = whole.select("spec_id", F.concat(F.lit("f"), F.col("id"), F.lit("-"), F.col("piece")).alias("container"), "id", "piece", F.col("capacity").alias("tokens"))
    number = max(1, round(sizes.count() / BATCH))
    open_items = cut.filter("rest > 0").select("spec_id", "capacity", F.lit(number).cast("long").alias("batches"), "id", F.col("full").cast("int").alias("piece"), F.col("rest").alias("tokens"))
    out, round_number = whole, 0
    while True:  # the rounds are as many as the digits of the number of batches
        placed = _packed(open_items, round_number)
        out = out.union(placed.filter("container is not null").select("spec_id", "container", "id", "piece", "tokens"))
        counts = placed.filter("container is null").groupBy("spec_id").count().collect()  # one row a spec
        if not counts:
            return out
        fewer = max(1, -(-max(r["count"] for r in counts) // BATCH))
        open_items = placed.filter("container is null").select("spec_id", "capacity", F.lit(fewer).cast("long").alias("batches"), "id", "piece", "tokens")
        round_number += 1


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents, in every capacity of container_specs; piece counts the pieces of a text that was cut."""
    specs = [(r[0], r[1]) for r in table(spark, sf_dir, "container_specs").select("spec_id", "capacity_tokens").collect()]
    sizes = token_sizes(table(spark, sf_dir, "documents"), "doc_id", "text")
    return pack(sizes, specs).withColumnRenamed("id", "doc_id")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(spec_id, containers, tokens, fill): how well the containers of each capacity are filled."""
    specs = table(spark, sf_dir, "container_specs").select("spec_id", "capacity_tokens")
    sums = p7_containers(spark, sf_dir).groupBy("spec_id", "container").agg(F.sum("tokens").alias("t")).groupBy("spec_id").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"))
    return sums.join(F.broadcast(specs), "spec_id").select("spec_id", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"))


QUERIES = {"p7_containers": p7_containers, "p7_fill": p7_fill}
