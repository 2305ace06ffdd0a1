"""Approximate nearest neighbours by cross-polytope hashing: nearest signed axis after fast Hadamard pseudo-rotations, multiprobe, exact reranking."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

#: Hash tables; buckets of a table that a query looks into; nearest rows returned.
TABLES, PROBES, K = 16, 6, 20
#: Rows of a bucket that are compared in one piece.
CHUNK = 4096


def rotations(dim: int, seed: int) -> np.ndarray:
    """Signs of the three diagonal matrices of a pseudo-rotation of the next power of two."""
    size = 1 << max(dim - 1, 1).bit_length()
    return np.random.default_rng(seed).choice([-1.0, 1.0], size=(3, size))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), signs.shape[1]))
    out[:, : x.shape[1]] = x
    for s in signs:
        out = hadamard(out * s)
    return out


def nearest_axes(x: np.ndarray, probes: int) -> np.ndarray:
    """The probes signed axes nearest to each row, nearest first: 2 i for axis i, 2 i + 1 for its opposite."""
    both = np.stack([x, -x], axis=2).reshape(len(x), -1)
    probes = min(probes, both.shape[1])
    top = np.argpartition(-both, probes - 1, axis=1)[:, :probes]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(both, top, 1), axis=1, kind="stable"), 1)


def usable(v: Column) -> Column:
    """Neither null nor empty nor zero, and without null or non-finite components."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def search(vectors: DataFrame, is_query: Column, k: int = K, tables: int = TABLES, probes: int = PROBES, seed: int = 7) -> DataFrame:
    """The k rows nearest to each query by inner product in double precision, itself left out: query_id, rank (from 1), vec_id, score; ties to the smaller vec_id.

    vectors holds vec_id and embedding; other columns are not read. Vectors that are null, empty or zero or hold null or non-finite
    components take no part, nor do rows without vec_id; of rows of one vec_id the least vector counts. Vectors of another length than the
    most common one take no part either. Hashes follow the direction, so recall is for vectors of about equal length; it is measured in the
    tests. Equal vectors share a bucket in every table, so each vector is indexed once with its smallest k + 1 ids: no more of a group of
    copies can be among a query's k nearest. Empty tables give no rows.
    """
    rows = vectors.where("vec_id is not null").where(usable(F.col("embedding"))).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), is_query.alias("q"))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = common["n"] if common else 1
    rows = rows.where(F.size("v") == dim).groupBy("vec_id").agg(F.min(F.struct("v", "q")).alias("x")).select("vec_id", "x.v", "x.q")
    # The k + 1 least ids of each distinct vector, first among groups of ids that a salt spreads, so that no group of copies meets in one task.
    salted = rows.groupBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt")).agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, k + 1).alias("ids"))
    indexed = salted.groupBy("v").agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids")).select("v", "ids")
    queries = rows.where("q").select("vec_id", "v")
    signs = [rotations(dim, seed + t) for t in range(tables)]

    def buckets(n: int):
        def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in batches:
                for at in range(0, len(part), 1024):
                    some = part.iloc[at : at + 1024]
                    x = np.stack(some["v"].to_numpy())
                    x = x / np.abs(x).max(axis=1, keepdims=True)
                    for t, s in enumerate(signs):
                        axes = nearest_axes(rotate(x, s), n)
                        for p in range(axes.shape[1]):
                            yield some.assign(bucket=t * 2 * s.shape[1] + axes[:, p])

        return kernel

    # A bucket's queries are compared with its vectors in pieces: pieces of the index by a salt, and each query goes to all of them.
    index = indexed.mapInPandas(buckets(1), "v array<double>, ids array<long>, bucket long")
    index = index.withColumn("piece", F.pmod(F.xxhash64("v"), F.lit(1 << 20)))
    sizes = indexed.mapInPandas(lambda b: (x[["bucket"]] for x in buckets(1)(b)), "bucket long").groupBy("bucket").count().select("bucket", F.ceil(F.col("count") / CHUNK).cast("long").alias("pieces"))
    sizes = F.broadcast(sizes)  # a row for each of 2 * dim axes of each table at most
    index = index.join(sizes, "bucket").withColumn("piece", F.col("piece") % F.col("pieces"))
    asked = queries.mapInPandas(buckets(probes), "vec_id long, v array<double>, bucket long").join(sizes, "bucket").select("vec_id", "v", "bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"))

    def rank(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        c = np.stack(right["v"].to_numpy())
        ids = right["ids"].to_numpy()
        longest = float(np.sqrt((c**2).sum(axis=1).max()))
        out = []
        for at in range(0, len(left), 256):
            some = left.iloc[at : at + 256]
            x = np.stack(some["v"].to_numpy())
            margins = 1e-12 * c.shape[1] * longest * np.sqrt((x**2).sum(axis=1))
            for q, row, margin in zip(some["vec_id"].tolist(), x @ c.T, margins.tolist(), strict=True):
                # Distinct vectors, ties at the end all included; rounding of the product leaves a margin for the exact pass.
                if len(row) > k + 1:
                    least = np.partition(row, len(row) - k - 1)[len(row) - k - 1]
                    best = np.flatnonzero(row >= least - margin)
                else:
                    best = np.arange(len(row))
                out.extend((q, i, j) for j in best.tolist() for i in ids[j].tolist() if i != q)
        got = pd.DataFrame(out, columns=["query_id", "vec_id", "j"])
        x = np.stack(left["v"].to_numpy())
        place = pd.Series(np.arange(len(left)), index=left["vec_id"].to_numpy())
        got["score"] = exact(x[place.loc[got["query_id"]].to_numpy()], c[got["j"].to_numpy(dtype=int)])
        got = got.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k)
        return got[["query_id", "vec_id", "score"]]

    found = asked.groupBy("bucket", "piece").cogroup(index.groupBy("bucket", "piece")).applyInPandas(rank, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id").agg(F.collect_set(F.struct((-F.col("score")).alias("minus"), "vec_id")).alias("all"))
    best = best.select("query_id", F.posexplode_outer(F.slice(F.sort_array("all"), 1, k)).alias("pos", "x")).where("x is not null")
    return best.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.minus")).alias("score"))


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component to the last."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def report(vectors: DataFrame) -> DataFrame:
    """search() with the rows whose vec_id is divisible by 20 as queries."""
    return search(vectors, F.col("vec_id") % 20 == 0)
