"""Quality classifier by co-training: a text view and a metadata view teach each other with confident pseudo-labels; calibrated, they score together.

In each round either view labels all unlabelled rows of the table of which it is sure, and the other learns from them: gradients over the
whole table are summed up where the rows are. Only the labelled rows that are learned from are a bounded sample. Sums are of whole numbers, so
that the scores don't depend on how rows are dealt.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, modest_batches
from .toxicity import held_out

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

#: Labelled rows that are learned from, at most: those of the least hashes of doc_id. The bound of the training samples.
SAMPLE = 6000
#: Buckets of hashed features of the text view and of the metadata view; rounds; how sure a view is of the pseudo-labels it gives, and the
#: weight, in labelled rows, that all of them together gain at most in a round.
TEXT, META, ROUNDS, GIVEN, SURE = 8192, 512, 4, 600, 0.9
#: Steps of the learners on the labelled rows alone, and on the whole table in each round; parts of 1 in which errors are summed up.
FIRST, STEPS, PARTS = 150, 10, 1 << 24
WORD = re.compile(r"\w+")


def bucket(name: str, n: int) -> int:
    return xxhash.xxh64_intdigest(name) % n


def text_view(text: str | None) -> np.ndarray:
    """Hashed words, and graded measures of the text: shares of letters, digits, capitals and signs, word length, variety, repeated lines."""
    text = text or ""
    tokens = WORD.findall(text.lower())
    n, lines = max(len(text), 1), [x for x in text.split("\n") if x.strip()]
    measures = {
        "alpha": sum(map(str.isalpha, text)) / n, "digit": sum(map(str.isdigit, text)) / n, "upper": sum(map(str.isupper, text)) / n, "space": text.count(" ") / n,
        "sign": sum(text.count(c) for c in "|#%*&@$<>{}[]\\^~=_+") / n, "length": sum(map(len, tokens)) / max(len(tokens), 1) / 12,
        "variety": len(set(tokens)) / max(len(tokens), 1), "lines": len(set(lines)) / max(len(lines), 1), "size": min(np.log1p(len(tokens)) / 12, 1), "end": sum(x.rstrip()[-1:] in ".!?" for x in lines) / max(len(lines), 1),
    }
    found = {f"w {w}" for w in tokens} | {f"m {k} {int(v * 20)}" for k, v in measures.items()}
    return np.unique(np.array([bucket(f, TEXT) for f in found], dtype=np.int32))


def meta_view(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    size = "none" if n_chars is None or n_chars != n_chars else int(2 * np.log2(max(n_chars, 0) + 1))
    return np.unique(np.array([bucket(f, META) for f in (f"source {source}", f"lang {lang}", f"size {size}", f"{source} {lang}", f"{lang} {size}")], dtype=np.int32))


@dataclass
class Model:
    """Weights and biases of the views, the slope and offset that calibrate each, and the weights and the offset of their sum."""

    text: tuple[np.ndarray, float]
    meta: tuple[np.ndarray, float]
    mix: tuple[float, float, float]


def indices(rows) -> tuple[np.ndarray, np.ndarray]:
    """The features of rows (bytes of int16) one after another, and the row of each."""
    return np.frombuffer(b"".join(rows), dtype=np.int16).astype(int), np.repeat(np.arange(len(rows)), [len(r) // 2 for r in rows])


def margins(model: tuple[np.ndarray, float], flat: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return model[1] + np.bincount(owner, model[0][flat], n)


def chances(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Learner:
    """A logistic regression on labelled rows, and in each step on the summed errors of others too, by Adagrad as logistic() of toxicity."""

    def __init__(self, rows: list[bytes], y: np.ndarray, n: int):
        (self.flat, self.owner), self.y, self.n = indices(rows), y, n
        self.model = (np.zeros(n), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))))
        self.g2, self.b2 = np.full(n, 1e-8), 1e-8

    def step(self, more: np.ndarray | None = None, weight: float = 0.0) -> None:
        """more: sums of errors by feature, of the errors, and of rows; they weigh as weight rows at most."""
        w, bias = self.model
        error = chances(margins(self.model, self.flat, self.owner, len(self.y))) - self.y
        grad, gb, rows = np.bincount(self.flat, error[self.owner], self.n), error.sum(), len(self.y)
        if more is not None and more[-1]:
            share = min(1.0, weight / more[-1])
            grad, gb, rows = grad + share * more[:-2] / PARTS, gb + share * more[-2] / PARTS, rows + share * more[-1]
        grad, gb = grad / rows + 1e-4 * w / self.n, gb / rows
        self.g2, self.b2 = self.g2 + grad**2, self.b2 + gb**2
        self.model = (w - 0.5 * grad / np.sqrt(self.g2), bias - 0.5 * gb / np.sqrt(self.b2))


def fitted(x: np.ndarray, y: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Weights of the columns of x and an offset, of a logistic regression with a small penalty."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + 1e-2 * w)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def viewed(documents: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """doc_id, y and v (the features of both views) of each row of documents; y is -1 but for at most about sample labelled rows that aren't held out."""
    modest_batches(documents.sparkSession)
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    share = min(1.0, sample / max(known.count(), 1))
    known = known.where(~held_out(F.col("doc_id")) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))))

    @F.pandas_udf("text binary, meta binary")
    def views(text: pd.Series, source: pd.Series, lang: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        short = lambda v: v.astype(np.int16).tobytes()
        return pd.DataFrame({"text": [short(text_view(t)) for t in text], "meta": [short(meta_view(*x)) for x in zip(source, lang, n_chars, strict=True)]})

    rows = documents.select("doc_id", "text", "source", "lang", "n_chars").join(F.broadcast(known), "doc_id", "left")  # sample rows of two numbers
    return checkpointed(rows.select("doc_id", F.coalesce("y", F.lit(-1)).alias("y"), views("text", "source", "lang", "n_chars").alias("v")))


def errors(pool: DataFrame, teachers: list[tuple[np.ndarray, float]], models: list[tuple[np.ndarray, float]]) -> list[np.ndarray]:
    """For each view, over all rows of pool (text, meta) of which the other view's teacher is sure: its model's errors by feature and in all, in PARTS, and the rows."""
    sizes = (TEXT, META)

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = [np.zeros(n + 2, dtype=np.int64) for n in sizes]
        for part in batches:
            at = [indices(part[c].tolist()) for c in ("text", "meta")]
            taught = [chances(margins(m, *x, len(part))) for m, x in zip(teachers, at, strict=True)]
            for v, (flat, owner) in enumerate(at):
                p = taught[1 - v]
                sure = np.maximum(p, 1 - p) >= SURE
                error = np.where(sure, np.rint((chances(margins(models[v], flat, owner, len(part))) - (p > 0.5)) * PARTS), 0)
                sums[v] += np.concatenate([np.bincount(flat, error[owner], sizes[v]), [error.sum(), sure.sum()]]).astype(np.int64)
        both = np.concatenate(sums)
        found = np.flatnonzero(both)
        yield pd.DataFrame({"at": found, "x": both[found]})

    got = pool.mapInPandas(kernel, "at long, x long").groupBy("at").agg(F.sum("x").alias("x")).toPandas()  # TEXT + META + 4 rows at most
    out = np.zeros(sum(sizes) + 4)
    out[got["at"].to_numpy(dtype=int)] = got["x"].to_numpy(dtype=float)
    return [out[: TEXT + 2], out[TEXT + 2 :]]


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    return learn(viewed(documents, labels, sample))


def learn(rows: DataFrame) -> Model:
    got = rows.where("y >= 0").select("doc_id", "y", "v.text", "v.meta").toPandas().sort_values(["doc_id", "y", "text"], ignore_index=True)
    # As many tasks as run at once, so that a step costs little however many files there are.
    pool = rows.where("y < 0").select("v.text", "v.meta").coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism)
    y, sizes = got["y"].to_numpy(dtype=int), (TEXT, META)
    views = [got[c].tolist() for c in ("text", "meta")]
    fold = np.arange(len(y)) % 4 == 0  # the rows that calibrate
    gold, check = np.flatnonzero(~fold), np.flatnonzero(fold)
    if len(np.unique(y[gold])) < 2 or len(np.unique(y[check])) < 2:
        rate = float(y.mean()) if len(y) else 0.5
        return Model((np.zeros(TEXT), 0.0), (np.zeros(META), 0.0), (0.0, 0.0, float(np.log((rate + 1e-3) / (1 - rate + 1e-3)))))
    learners = [Learner([x[i] for i in gold], y[gold].astype(float), n) for x, n in zip(views, sizes, strict=True)]
    for _ in range(FIRST):
        for x in learners:
            x.step()
    for turn in range(1, ROUNDS + 1):
        teachers = [x.model for x in learners]
        for _ in range(STEPS):
            for x, more in zip(learners, errors(pool, teachers, [x.model for x in learners]), strict=True):
                x.step(more, GIVEN * turn)
    models = [x.model for x in learners]
    z = np.column_stack([margins(m, *indices([x[i] for i in check]), len(check)) for m, x in zip(models, views, strict=True)])
    calibrated = [fitted(z[:, [v]], y[check]) for v in range(2)]
    both = fitted(np.column_stack([z[:, v] * calibrated[v][0] + calibrated[v][1] for v in range(2)]), y[check])
    mix = (both[0] * calibrated[0][0], both[1] * calibrated[1][0], both[2] + both[0] * calibrated[0][1] + both[1] * calibrated[1][1])
    return Model(models[0], models[1], tuple(map(float, mix)))


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: quality 1 likelier), predicted for each row of documents, by its whole text and its source, lang and n_chars, each of which may be null.

    Labels are learned from rows that aren't held out, as in the toxicity operator; rows without a label there, null ids too, are all learned from unlabelled. Labels that are null are none; of several the mean counts.
    Without labels of both kinds each row gets their rate, or 0.5. A null text counts as empty. Repeated rows stay. Other columns are not read.
    """
    seen = viewed(documents, labels, SAMPLE)
    model = learn(seen)
    shared = documents.sparkSession.sparkContext.broadcast((model.text, model.meta, model.mix))  # TEXT + META weights; plain values, as executors need not have this package

    @F.pandas_udf("double")
    def score(text: pd.Series, meta: pd.Series) -> pd.Series:
        of_text, of_meta, mix = shared.value
        a, b = (margins(x, *indices(v.tolist()), len(v)) for x, v in ((of_text, text), (of_meta, meta)))
        return pd.Series(1 / (1 + np.exp(-np.clip(mix[0] * a + mix[1] * b + mix[2], -40, 40))))

    rows = seen.select("doc_id", score("v.text", "v.meta").alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
