"""Toxicity by weak supervision: voters from lexicons and patterns, a generative label model, a linear classifier on its posterior labels.

Words and word beginnings that mark toxic texts are mined from labelled rows. The strongest make the lexicons and beginning patterns that
vote, besides a few fixed patterns. The label model holds for each voter how often it fires on toxic and on other texts (its accuracies),
found by expectation maximisation, and discounts voters by the correlation of their residuals, so that voters that say the same count once.
Its posteriors are the targets of a logistic regression over all mined features, which alone scores texts.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import modest_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

#: Labelled rows that are learned from, at most: those of the least hashes of doc_id. The bound of the training sample.
SAMPLE = 20_000
#: Features of the classifier, features that vote, and rows that must hold a feature.
FEATURES, VOTING, SUPPORT = 4096, 240, 4
LEXICONS = 24
BEGINNINGS = (3, 4, 5)
WORDS = re.compile(r"[^\W\d_]+")
#: Fixed patterns: an insult's form, threats, shouting, strings of exclamation marks, masked words.
PATTERNS = (r"\byou(?:'re| are) (?:an?|such|so)\b", r"\b(?:kill|hurt|hate) (?:you|them|him|her)\b", r"\b[A-Z]{5,}\b", r"!{3,}", r"\b[a-z]+[*#@$]{2,}[a-z]*\b")
COMPILED = tuple(map(re.compile, PATTERNS))


def features_of(text: str | None) -> set[str]:
    """The lower-cased words of a text, and their beginnings with a ^; fixed patterns as #0, #1 ..."""
    text = text or ""
    tokens = set(WORDS.findall(text.lower()))
    found = tokens | {f"^{w[:k]}" for k in BEGINNINGS for w in tokens if len(w) > k}
    return found | {f"#{i}" for i, p in enumerate(COMPILED) if p.search(text)}


@dataclass
class Model:
    """weights by feature, and the bias. Without any labelled rows of both kinds, bias alone."""

    bias: float
    weights: dict[str, float] = field(default_factory=dict)
    accuracies: list[tuple[float, float]] = field(default_factory=list)
    discounts: list[float] = field(default_factory=list)

    def score(self, text: str | None) -> float:
        get = self.weights.get
        text = text or ""
        tokens = set(WORDS.findall(text.lower()))
        z, starts = self.bias, set()
        for w in tokens:
            if (x := get(w)) is not None:
                z += x
            for k in BEGINNINGS:
                if len(w) > k:
                    starts.add(w[:k])
        for s in starts:
            if (x := get("^" + s)) is not None:
                z += x
        for i, p in enumerate(COMPILED):
            if (x := get(f"#{i}")) is not None and p.search(text):
                z += x
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def training_rows(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text and y of at most about sample labelled rows that aren't held out, spread evenly by a hash of doc_id."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("y"))
    n = known.count()
    share = min(1.0, sample / max(n, 1))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    return documents.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # about sample rows of two numbers


def label_model(votes: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors of rows, accuracies (how often a voter fires on toxic rows, and on others) and discounts of voters, of the votes alone: no label is seen. Starts from how many voters fire."""
    votes = votes.astype(float)
    post = np.array([0.02, 0.5, 0.9])[np.minimum(votes.sum(axis=1), 2).astype(int)]
    discount = np.ones(votes.shape[1])
    for k in range(rounds):
        post = np.clip(post, 1e-4, 1 - 1e-4)
        prior = post.mean()
        on = (votes.T @ post + 0.5) / (post.sum() + 1)
        off = (votes.T @ (1 - post) + 0.5) / ((1 - post).sum() + 1)
        if k in (0, rounds // 2):  # correlations that the posterior doesn't explain
            rest = votes - np.outer(post, on) - np.outer(1 - post, off)
            sd = np.sqrt((rest**2).mean(axis=0)) + 1e-9
            corr = np.abs((rest / sd).T @ (rest / sd) / len(rest))
            discount = 1 / np.where(corr > 0.1, corr, 0).sum(axis=0).clip(1)
        z = np.log(prior / (1 - prior)) + votes @ (discount * np.log(on / off)) + (1 - votes) @ (discount * np.log((1 - on) / (1 - off)))
        post = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return post, np.column_stack([on, off]), discount


def logistic(rows: list[np.ndarray], targets: np.ndarray, n: int, rounds: int = 300, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on rows of indices of features that are present, with soft targets."""
    flat, owner = np.concatenate([*rows, np.zeros(0, int)]).astype(int), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    weights, bias = np.zeros(n), float(np.log((targets.mean() + 1e-3) / (1 - targets.mean() + 1e-3)))
    g2, b2 = np.full(n, 1e-8), 1e-8
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(owner, weights[flat], len(rows)), -30, 30)))
        error = (p - targets) / len(rows)
        grad, gb = np.bincount(flat, error[owner], n) + decay * weights / n, error.sum()
        g2, b2 = g2 + grad**2, b2 + gb**2
        weights, bias = weights - 0.5 * grad / np.sqrt(g2), bias - 0.5 * gb / np.sqrt(b2)
    return weights, bias


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from at most about sample labelled rows that aren't held out. What comes to the driver: FEATURES features with their counts, and of each of those rows which of these it holds."""
    modest_batches(documents.sparkSession)
    rows = training_rows(documents, labels, sample).persist()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            by: dict[str, list[int]] = {}
            for text, y in zip(part["text"], part["y"], strict=True):
                for f in features_of(text):
                    by.setdefault(f, [0, 0])[y] += 1
            yield pd.DataFrame({"feature": list(by), "n": [x[0] for x in by.values()], "p": [x[1] for x in by.values()]})

    totals = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    neg, pos = totals.get(0, 0), totals.get(1, 0)
    if not pos or not neg:
        rows.unpersist()
        return Model(float(np.log((pos + 0.5) / (neg + 0.5))) if pos + neg else -5.0)
    odds = F.log((F.col("p") + 0.5) / (pos + 1)) - F.log((F.col("n") + 0.5) / (neg + 1))
    counted = rows.select("text", "y").mapInPandas(count, "feature string, n long, p long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    strength = F.abs(odds) * F.sqrt(F.col("p") + F.col("n"))
    best = counted.where(F.col("p") + F.col("n") >= SUPPORT).select("feature", "n", "p", odds.alias("odds"), strength.alias("strength")).orderBy(F.desc("strength"), "feature").limit(FEATURES).toPandas()
    index = {f: i for i, f in enumerate(best["feature"])}

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame({"y": part["y"], "held": [np.array(sorted(index[f] for f in features_of(t) if f in index), dtype=np.int32).tobytes() for t in part["text"]]})

    got = rows.select("doc_id", "text", "y").mapInPandas(held, "y int, held binary").toPandas()
    rows.unpersist()
    sparse = [np.frombuffer(x, dtype=np.int32) for x in got["held"]]
    # Voters: lexicons of words, and of beginnings, that mark toxic rows, dealt in turn from the strongest on; the fixed patterns.
    toxic = [i for i, (f, o) in enumerate(zip(best["feature"], best["odds"], strict=True)) if o > 1.5 and f[0] != "#"][:VOTING]
    groups: dict[str, int] = {}
    voter_of = np.full(len(index), -1)
    seen = {"^": 0, "w": 0}
    for i in toxic:
        kind = "^" if best["feature"][i][0] == "^" else "w"
        voter_of[i] = groups.setdefault(f"{kind}{seen[kind] % (LEXICONS // 2)}", len(groups))
        seen[kind] += 1
    for i, f in enumerate(best["feature"]):
        if f[0] == "#":
            voter_of[i] = groups.setdefault(f, len(groups))
    votes = np.zeros((len(sparse), max(len(groups), 1)), dtype=bool)
    for r, x in enumerate(sparse):
        v = voter_of[x]
        votes[r, v[v >= 0]] = True
    post, accuracies, discounts = label_model(votes)
    weights, bias = logistic(sparse, post, len(index))
    return Model(float(bias), {f: float(w) for f, w in zip(best["feature"], weights, strict=True) if w}, [tuple(x) for x in accuracies.tolist()], discounts.tolist())


def scorer(documents: DataFrame, model: Model):
    shared = documents.sparkSession.sparkContext.broadcast((model.bias, model.weights))  # FEATURES weights at most; plain values, as executors need not have this package

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        m = Model(*shared.value)
        return pd.Series([m.score(t) for t in texts], dtype="float64")

    return score


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """documents with score and predicted added last. Each row by its whole text alone; a null text counts as empty. Existing columns of these names are replaced."""
    return documents.withColumn("score", scorer(documents, model)(F.col("text"))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents that aren't predicted to be toxic, with their own columns."""
    score = scorer(documents, train(documents, labels))
    return documents.where(score(F.col("text")) < 0.5)


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of documents, repeated rows too. A null doc_id isn't held out; no label can be its. Labels that are null are no labels; of several for a doc_id the mean counts. Without labels of both kinds every row gets the same score."""
    return scored(documents.select("doc_id", "text"), train(documents, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
