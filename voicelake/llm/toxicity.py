"""Severity of toxic text by cumulative-link ordinal regression.

A text's features are its distinct words and word beginnings. The model has
one weight a feature, shared by all grades, and one threshold between each
grade and the next: P(grade > k) is the logistic of weights minus threshold k.
The expected severity is the sum of those probabilities.

Features are counted and chosen over a bounded sample of labelled documents
(TRAIN_DOCS ids, by hash of the id; of several labels of one id the highest
grade counts, of several texts one), and the weights are fitted on their chosen
features. Every document is scored, on its whole text.

Defined results: a null text has no features; repeated rows get equal scores;
null ids are scored; without labels of more than one grade nothing is flagged
and severity is 0; an empty table gives an empty result; further columns are
dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voicelake.llm.scratch import Scratch

TRAIN_DOCS, FEATURES, LEAST_DOCS = 10_000, 20_000, 3
BEGINNINGS = (4, 5)
#: Words whose features a worker keeps.
KEPT_WORDS = 200_000


def word_features(word: str) -> list[str]:
    return ["w:" + word, *(f"{n}:{word[:n]}" for n in BEGINNINGS if len(word) > n)]


def split_words(text: str) -> set[str]:
    import regex

    return set(regex.findall(r"\w+", text.lower()))


def fit(rows: list[list[int]], grades: list[int], n_features: int, n_grades: int, rounds: int = 400, penalty: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(weights, ascending thresholds) by full-batch gradient steps with Adam."""
    y, size = np.asarray(grades), np.array([len(r) for r in rows], np.int64)
    index, owner = np.concatenate([np.asarray(r, np.int64) for r in rows]), np.repeat(np.arange(len(rows)), size)
    free = np.zeros(n_features + n_grades - 1)
    free[n_features] = 1.0
    moment, square = np.zeros_like(free), np.zeros_like(free)
    logistic = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for step in range(1, rounds + 1):
        weights, gaps = free[:n_features], np.exp(free[n_features + 1 :])
        theta = free[n_features] + np.concatenate(([0.0], np.cumsum(gaps)))
        score = np.bincount(owner, weights[index], minlength=len(rows))
        edges = np.concatenate(([-np.inf], theta, [np.inf]))
        below, upto = logistic(edges[y] - score), logistic(edges[y + 1] - score)
        below[y == 0], upto[y == n_grades - 1] = 0.0, 1.0
        chance = np.maximum(upto - below, 1e-12)
        pull = upto + below - 1  # of the log-likelihood, by score
        by_weight = np.bincount(index, pull[owner], minlength=n_features)
        by_theta = np.zeros(n_grades + 1)
        np.add.at(by_theta, y + 1, upto * (1 - upto) / chance)
        np.add.at(by_theta, y, -below * (1 - below) / chance)
        inner = by_theta[1:-1]
        tail = np.cumsum(inner[::-1])[::-1]
        gradient = np.concatenate((by_weight, [tail[0]], tail[1:] * gaps)) / len(rows) - penalty * np.concatenate((weights, [0.0], 0.1 * free[n_features + 1 :]))
        moment, square = 0.9 * moment + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
        free = free + 0.1 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return free[:n_features], free[n_features] + np.concatenate(([0.0], np.cumsum(np.exp(free[n_features + 1 :]))))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted({f for w in split_words(text.as_py() or "") for f in word_features(w)}) for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["grade", "features"])


def train(docs: DataFrame, graded: DataFrame) -> dict:
    """(doc_id, grade) of labelled documents -> weights by feature, thresholds."""
    known = graded.filter("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy(F.col("doc_id").alias("_labelled")).agg(F.max("grade").cast("int").alias("_grade"))
    sample = known.orderBy(F.xxhash64("_labelled"), "_labelled").limit(TRAIN_DOCS)
    texts = docs.select(F.col("doc_id").alias("_doc"), F.col("text").cast("string").alias("_text")).join(F.broadcast(sample), F.col("_doc") == F.col("_labelled"))
    picked = texts.groupBy("_labelled").agg(F.max("_grade").alias("grade"), F.min_by("_text", F.xxhash64("_text")).alias("text")).select("grade", "text")
    listed = picked.mapInArrow(_listed, "grade int, features array<string>")
    listed = Scratch(docs.sparkSession, "toxicity").table(listed, "features")
    totals = {r["grade"]: r["n"] for r in listed.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    high, everything = sum(n for g, n in totals.items() if g > 0), sum(totals.values())
    if len(totals) < 2 or not high:
        return {"weights": {}, "thresholds": []}
    base = high / everything
    counts = listed.select((F.col("grade") > 0).cast("int").alias("high"), F.explode("features").alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.sum("high").alias("k"))
    rate = (F.col("k") + base) / (F.col("n") + 1)
    strong = counts.filter((F.col("n") >= LEAST_DOCS) & (rate > min(0.9, 2.5 * base))).orderBy((F.col("k") * F.log(rate / base)).desc(), "feature").limit(FEATURES)
    names = [r["feature"] for r in strong.select("feature").collect()]  # at most FEATURES
    if not names:
        return {"weights": {}, "thresholds": []}
    place = {f: i for i, f in enumerate(names)}
    rows = listed.select("grade", F.array_intersect("features", F.split(F.lit(" ".join(names)), " ")).alias("own")).collect()  # at most TRAIN_DOCS, one an id
    n_grades = max(totals) + 1
    weights, thresholds = fit([[place[f] for f in r["own"]] for r in rows], [r["grade"] for r in rows], len(names), n_grades)
    return {"weights": {f: float(w) for f, w in zip(names, weights, strict=True) if abs(w) > 1e-4}, "thresholds": thresholds.tolist()}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, expected_severity, grade (the most probable crossing) and toxic of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, theta = shared.value["weights"], np.asarray(shared.value["thresholds"])
        known: dict[str, tuple[str, ...]] = {}

        def hits(word: str) -> tuple[str, ...]:
            if len(known) >= KEPT_WORDS:
                known.clear()
            got = known[word] = tuple(f for f in word_features(word) if f in weights)
            return got

        for batch in batches:
            total = np.zeros(batch.num_rows)
            for k, text in enumerate(batch.column(1)):
                own: set[str] = set()
                for word in split_words(text.as_py() or ""):
                    got = known.get(word)
                    own.update(hits(word) if got is None else got)
                total[k] = sum(weights[f] for f in sorted(own))
            above = 1 / (1 + np.exp(-np.clip(total[:, None] - theta[None, :], -40, 40))) if len(theta) else np.zeros((len(total), 1))
            grade = (above >= 0.5).sum(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(above.sum(axis=1)), pa.array(grade), pa.array(grade > 0)], names=["doc_id", "expected_severity", "grade", "toxic"])

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text").mapInArrow(run, "doc_id long, expected_severity double, grade int, toxic boolean")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Grades of the labels: 0 not toxic, 1 toxic, 2 toxic and of low quality."""
    grade = F.when(F.col("toxic") == 0, 0).when(F.col("quality") == 0, 2).otherwise(1)
    return score(docs, train(docs, labels.filter("toxic IS NOT NULL").select("doc_id", grade.alias("grade"))))


def op8_toxicity(spark, sf_dir):
    return toxicity_report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
