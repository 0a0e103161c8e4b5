"""Problem 4: error text, template residue and filler, by naive Bayes learnt from positive and unlabelled records.

Trusted records are captures with an error status and records with a line that is nothing but a placeholder; records
without any longer line are unlabelled, most of them short pages or errors; the rest holds content and site furniture. A
naive Bayes model over hashed features of passages (lines) starts from the trusted and the bare records' passages that
don't stand in the rest, and expectation-maximization moves passages between the sides, so that furniture, teasers and
short texts leave the positives and hidden error text and filler joins them. A record is a case if a passage scores as
error text and no longer passage scores as content. The model is fitted on a bounded sample; every record is scored whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.line_features import SIZE, LineHasher, score
from lodestrata.store import materialize, table

#: At most so many trusted, bare and other records are used to fit the model.
SAMPLE_TRUSTED, SAMPLE_BARE, SAMPLE_REST = 4_000, 4_000, 6_000
#: A passage of this many characters can be a page's content by itself.
LONG = 170
#: Longer passages count less when the model is fitted.
SHORT = 60
ROUNDS = 8
#: Scores that tell of error text in a passage, and their sum from which a record is a case.
TELLING, ERROR = 1.0, 2.0

#: Syntax of unfilled placeholders, as whole lines (fixed values).
PLACEHOLDERS = (
    r"\{\{.*\}\}", r"\{%.*%\}", r"<%.*%>", r"<\?php.*\?>", r"\$\{.*\}", r"#\{.*\}", r"%%\w+%%", r"@@\w+@@", r"__\w+__", r"\[\[.*\]\]",
    r":\w+:", r"[A-Z_]{1,80}_PLACEHOLDER", r"lorem ipsum.*", r"undefined", r"NaN", r"null",
)
_placeholder = re.compile("(?:" + "|".join(PLACEHOLDERS) + ")", re.I).fullmatch


#: The number of the feature that a line is a placeholder.
SYNTAX = 12_345

_not_letters = regex.compile(r"\P{L}+")


def lines_of(body: str) -> list[str]:
    """The body's passages; breadcrumbs (parts joined by >) are left out."""
    return [x for line in body.split("\n") if (x := line.strip()) and (" > " not in x or _placeholder(x)) and x[-2:] != " >"]


def features_of(hasher: LineHasher, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The lines' hashed features; a placeholder's syntax is one of its own, with as much weight as all others of the line."""
    features, owner = hasher(lines)
    syntax = np.array([k for k, x in enumerate(lines) if len(x) < 200 and _placeholder(x)], np.int64)
    times = np.bincount(owner, minlength=len(lines))[syntax]
    return np.r_[features, np.full(times.sum(), SYNTAX, np.int64)], np.r_[owner, np.repeat(syntax, times)]


class Model:
    """Weights of the features, and the decision on records."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def passages(self, features: np.ndarray, owner: np.ndarray, lines: list[str]) -> np.ndarray:
        """A score for each line: the sum of its features' weights, tempered as they depend on each other."""
        total, number = score(self.weights, features, owner, len(lines))
        return total / np.sqrt(np.maximum(number, 1))

    @staticmethod
    def decide(scores: np.ndarray, lines: list[str]) -> bool:
        return bool(scores[scores > TELLING].sum() >= ERROR and not any(s < 0 and len(x) >= LONG for s, x in zip(scores.tolist(), lines, strict=True)))


def fit(trusted: list[str], bare: list[str], rest: list[str]) -> Model:
    """The model from bodies of trusted, bare and other records; without positives or others nothing is learnt."""
    model = Model(np.zeros(SIZE))
    held = Counter(k for b in rest for k in {_not_letters.sub("", x.lower()) for x in lines_of(b)})
    common = set(held)
    positive = [list(dict.fromkeys(x for x in lines_of(b) if _not_letters.sub("", x.lower()) not in common or _placeholder(x))) for b in (*trusted, *bare)]
    other = [list(dict.fromkeys(lines_of(b))) for b in rest]
    bodies = [b for b in positive if b] + [b for b in other if b]
    begun = sum(1 for b in positive if b)
    if not begun or begun == len(bodies):
        return model
    flat = [x for b in bodies for x in b]
    record = np.repeat(np.arange(len(bodies)), [len(b) for b in bodies])
    features, owner = features_of(LineHasher(), flat)
    sure = np.array([bool(_placeholder(x)) for x in flat])
    r = (record < begun).astype(float)
    # furniture counts against a feature, but the sides are compared by their other passages, as the positives hold none
    furniture = np.array([held[_not_letters.sub("", x.lower())] > 1 for x in flat]) & (record >= begun)
    # passages of content are long and would make whatever is in short lines look rare
    weight = np.array([min(1.0, SHORT / len(x)) ** 2 for x in flat])
    for _ in range(ROUNDS):
        one = np.bincount(features, r[owner] * weight[owner], SIZE)
        none = np.bincount(features, (1 - r[owner]) * weight[owner], SIZE)
        # a feature that is rare on both sides tells nothing: the larger side gets the larger pseudo-count
        ratio = max(((1 - r[owner]) * weight[owner])[~furniture[owner]].sum() / max(one.sum(), 1.0), 1.0)
        model.weights = np.log(one + 1) - np.log(none / ratio + 1)
        scores = model.passages(features, owner, flat)
        new = 1 / (1 + np.exp(-2 * np.clip(scores - TELLING, -15, 15)))
        new[sure] = 1.0
        if np.abs(new - r).mean() < 1e-4:
            break
        r = new
    return model


def fit_from(docs: DataFrame, errors: DataFrame) -> Model:
    """The model from docs (id, body) and errors (id), the ids of captures with an error status.

    Records are marked and chosen (by the least hashes of their ids) without their bodies, which are read for the chosen ones
    only.
    """
    own = docs.select("id", "body").filter("id is not null and body is not null")
    marks = own.select(
        "id",
        F.col("body").rlike("(?m)^[ \\t]*(?:" + "|".join(PLACEHOLDERS) + ")[ \\t]*$").alias("placeholder"),
        F.col("body").rlike("(?m)^.{%d}" % LONG).alias("long"),
    )
    marks = materialize(marks.join(errors.select("id").distinct().withColumn("error", F.lit(True)), "id", "left"), "marks")
    trusted = F.coalesce("error", F.lit(False)) | F.col("placeholder")
    kinds = (("trusted", trusted, SAMPLE_TRUSTED), ("bare", ~trusted & ~F.col("long"), SAMPLE_BARE), ("rest", ~trusted & F.col("long"), SAMPLE_REST))
    chosen = None
    for kind, condition, size in kinds:
        part = marks.filter(condition).select("id", F.lit(kind).alias("kind")).orderBy(F.xxhash64("id"), "id").limit(size)
        chosen = part if chosen is None else chosen.union(part)
    bodies: dict[str, list[str]] = {kind: [] for kind, _, _ in kinds}
    for kind, body in own.join(F.broadcast(chosen.distinct()), "id").select("kind", "body").limit(2 * (SAMPLE_TRUSTED + SAMPLE_BARE + SAMPLE_REST)).collect():
        bodies[kind].append(body)
    return fit(*(sorted(bodies[kind]) for kind, _, _ in kinds))


def _scorer(weights: np.ndarray):
    model = Model(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = LineHasher()
        for batch in batches:
            for at in range(0, batch.num_rows, 300):
                part = batch.slice(at, 300)
                bodies = [lines_of(b) for b in part.column(1).to_pylist()]
                flat = [x for b in bodies for x in b]
                if not flat:
                    continue
                scores = model.passages(*features_of(hasher, flat), flat)
                ends = np.cumsum([len(b) for b in bodies])
                ids = part.column(0).to_pylist()
                found = [i for i, b, e in zip(ids, bodies, ends, strict=True) if b and Model.decide(scores[e - len(b) : e], b)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["id"])

    return run


def error_statuses(docs: DataFrame, cdx: DataFrame) -> DataFrame:
    """(id): the records of docs (id, s3_key, offset) whose capture has an error status."""
    bad = cdx.filter("status >= 400").select("s3_key", "offset").distinct()
    return docs.join(bad, ["s3_key", "offset"]).select("id")


def error_pages(docs: DataFrame, errors: DataFrame) -> DataFrame:
    """(id): records of docs (id, body) with error text, template residue, filler or a script notice in place of content.

    ``errors`` (id) names captures with an error status, from which the model learns; their status decides nothing. Null
    and empty bodies are no cases, rows with a null id are left out, repeated rows give one row.
    """
    model = fit_from(docs, errors)
    own = docs.filter("id is not null and body is not null").select("id", "body")
    return own.mapInArrow(_scorer(model.weights), "id long").distinct()


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "index_docs").select(F.col("rec_id").alias("id"), "body", "s3_key", "offset")
    return docs.select("id", "body"), error_statuses(docs.select("id", "s3_key", "offset"), table(spark, sf_dir, "cdx"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return error_pages(*_inputs(spark, sf_dir)).withColumnRenamed("id", "rec_id")


def p4_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that remain when the cases are excluded."""
    return table(spark, sf_dir, "index_docs").join(p4_found(spark, sf_dir), "rec_id", "left_anti").select("rec_id", "url", "body")


QUERIES = {"p4_found": p4_found, "p4_clean": p4_clean}
