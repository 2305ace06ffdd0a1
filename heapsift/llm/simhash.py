"""SimHash near-duplicates: 64-bit fingerprints of word shingles, compared with the help of pivot distance tables.

A pivot table holds, for each fingerprint, its Hamming distances to reference fingerprints. Where two fingerprints differ in d bits, no
coordinate differs by more than d, so a pair is discarded by its largest coordinate difference and only survivors are verified. For random
fingerprints one coordinate still passes about half of all pairs, so the table alone would leave a number of pairs that grows with the
square of the input. Pairs are therefore sought among fingerprints that agree in 3 of 6 blocks of bits, which any two within 3 bits do;
within such a bucket, rows are ordered by the first coordinate and compared over the window in which it differs by 3 at most.
"""

from __future__ import annotations

import sys
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, components, fresh, modest_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

SHINGLE, SEED, MAX_BITS = 3, 42, 3
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: Rows of a bucket that one task compares; a larger bucket is cut into chunks, and each pair of chunks is a task's work.
CHUNK = 8192
PIVOTS = np.array([xxhash.xxh64_intdigest(f"pivot {i}", SEED) for i in range(16)], dtype=np.uint64)
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None) -> int:
    """The fingerprint as an unsigned number; 0 for a null text and one without words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not tokens:
        return 0
    digest = xxhash.xxh64_digest
    if len(tokens) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(tokens), SEED)
    ones, n = np.zeros(64, dtype=np.int64), len(tokens) - SHINGLE + 1
    for at in range(0, n, 1 << 15):  # so that a very long text needs no more memory
        end = min(n, at + (1 << 15))
        raw = b"".join([digest(b"%b %b %b" % x, SEED) for x in zip(tokens[at:end], tokens[at + 1 : end + 1], tokens[at + 2 : end + 2], strict=True)])
        ones += np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""
    modest_batches(documents.sparkSession)

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))

    return documents.select("doc_id", of(F.col("text")).alias("fp"))


def spanning_links(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect the same fingerprints of one bucket as all its pairs within MAX_BITS do, in number one less than the fingerprints at most."""
    table = np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    root, links, lag = np.arange(len(fps)), [], 0
    alive = np.arange(len(fps))  # rows whose window has not ended
    while True:
        lag += 1
        alive = alive[alive + lag < len(fps)]
        alive = alive[table[alive + lag, 0] - table[alive, 0] <= MAX_BITS]
        if not len(alive):
            return links
        a = alive[root[alive] != root[alive + lag]]
        for p in range(1, len(PIVOTS)):
            if not len(a):
                break
            a = a[np.abs(table[a + lag, p] - table[a, p]) <= MAX_BITS]
        a = a[np.bitwise_count(fps[a] ^ fps[a + lag]) <= MAX_BITS]
        for i in a.tolist():
            x, y = i, i + lag
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            if x != y:
                root[max(x, y)] = min(x, y)
                links.append((int(fps[i]), int(fps[i + lag])))
        while len(a) and (up := root[root]).tolist() != root.tolist():
            root = up


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between fingerprints of the column fp, which hold together what all pairs within MAX_BITS bits hold together."""
    keys = []
    for n, chosen in enumerate(combinations(BLOCKS, 3)):
        mask = sum(((1 << size) - 1) << at for at, size in chosen)
        keys.append(F.xxhash64(F.lit(n), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    many = rows.groupBy("key").count().where("count > 1")
    rows = rows.join(many, "key").withColumn("chunks", F.ceil(F.col("count") / CHUNK).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks").cast("long")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    rows = rows.select("key", "fp", own.alias("own"), other.alias("other")).select("key", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def kernel(batches):
        def done(part: pd.DataFrame) -> pd.DataFrame:
            ks, fps = part[["key", "i", "j"]].to_numpy(), part["fp"].to_numpy().view(np.uint64)
            edges = np.flatnonzero((ks[1:] != ks[:-1]).any(axis=1)) + 1
            out = [x for group in np.split(fps, edges) if len(group) > 1 for x in spanning_links(group)]
            both = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pd.DataFrame({"a": both[:, 0], "b": both[:, 1]})

        held = None
        for part in batches:
            if part.empty:
                continue
            part = part if held is None else pd.concat([held, part], ignore_index=True)
            last = part[["key", "i", "j"]].iloc[-1]
            open_ = (part["key"] == last["key"]) & (part["i"] == last["i"]) & (part["j"] == last["j"])
            held = part[open_]
            if not open_.all():
                yield done(part[~open_])
        if held is not None:
            yield done(held)

    return rows.mapInPandas(kernel, "a long, b long").distinct()


def grouped(documents: DataFrame) -> DataFrame:
    """A row for each row of documents: doc_id, fp (signed long), component_id (the least doc_id linked to it over any number of steps).

    Null and empty texts have fingerprint 0 and are linked like others. A null doc_id is no smallest id: its row takes the component of
    its fingerprint, null if that holds no other. Equal texts meet as one fingerprint, so that copies make no pairs. Other columns are not
    read. Empty documents give no rows.
    """
    docs = checkpointed(fingerprints(documents))
    own = docs.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(own.select("fp")))
    linked = own.join(roots, F.col("fp") == F.col("node")).select("fp", "root", "least")
    linked = linked.join(linked.groupBy("root").agg(F.min("least").alias("all")), "root").select("fp", "all")
    of = own.join(linked, "fp", "left").select("fp", F.coalesce("all", "least").alias("component_id"))
    return docs.join(of, "fp").select("doc_id", "fp", "component_id")


def keep_one(documents: DataFrame) -> DataFrame:
    """The document of the least doc_id of each component, once even if its row is repeated; of rows of that doc_id with different texts one of the least text. A null doc_id stays: nothing tells which of its group it is."""
    kept = grouped(documents).where("doc_id = component_id").select("doc_id").distinct()
    (rank,) = fresh(documents, "rank")
    stay = documents.join(kept, "doc_id", "left_semi")
    stay = stay.withColumn(rank, F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where(F.col(rank) == 1).drop(rank)
    return stay.select(*documents.columns).unionByName(documents.where("doc_id is null"))


def report(documents: DataFrame) -> DataFrame:
    """grouped() with the fingerprint as 16 hex digits: doc_id, fingerprint, component_id."""
    return grouped(documents).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
