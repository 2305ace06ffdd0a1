"""Substring dedup: passages of 50 words or more that repeat across documents, by prefix-partitioned suffix trees.

The suffixes are word windows, cut at the depth that matters (WINDOW words). They are dealt to partitions by prefixes of variable length.
The first prefix is a run of ANCHOR words of the window, the one of least hash: equal windows have the same, wherever it stands in them.
A census of these prefixes drops those that one document alone holds; no window with such a prefix can repeat. Prefixes whose windows fit in
memory go as they are to a task, which sorts the suffixes of each; equal neighbours are the suffixes below one internal node of depth WINDOW,
and all of them but the least document's are repeats. A prefix with more windows than fit is lengthened to the whole window; what then
shares a prefix is below one node already, and partial minima of its document id replace the sort, so no task has to hold it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, modest_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

WINDOW, ANCHOR = 50, 20
#: Windows of a prefix that one task sorts; a prefix with more is lengthened.
IN_MEMORY = 200_000
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def words_of(text: str | None) -> list[bytes]:
    """Words: runs of anything but ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def codes_of(tokens: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, tokens)), dtype=">u8").astype(np.uint64)


def rolling(codes: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of k codes."""
    n = len(codes)
    if n < k:
        return np.zeros(0, np.uint64)
    base = BASE + np.uint64(2 * salt)
    inverse = INVERSE if not salt else np.uint64(pow(int(base), -1, 1 << 64))
    power = lambda b: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b)]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * power(base))])
    x = (sums[k:] - sums[:-k]) * power(inverse)[: n - k + 1]
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def prefixes(codes: np.ndarray) -> np.ndarray:
    """For each window the least hash of a run of ANCHOR words in it."""
    least, span, width = rolling(codes, ANCHOR), 1, WINDOW - ANCHOR + 1
    if len(codes) < WINDOW:
        return least[:0]
    while 2 * span <= width:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    return np.minimum(least[: len(least) - (width - span)], least[width - span :]) if width > span else least


def runs_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys start and end."""
    edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return np.concatenate([[0], edges]), np.concatenate([edges, [len(keys)]])


def repeats(group: np.ndarray, doc: np.ndarray, codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows of stretches (each of a group, a document and codes): which stretch and which offset repeat a window of the same group and a smaller document."""
    flat = np.concatenate(codes)
    sizes = np.array([len(c) for c in codes])
    n = sizes - WINDOW + 1
    owner = np.repeat(np.arange(len(codes)), n)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(np.cumsum(sizes) - sizes, n) + offset
    key = rolling(flat.astype(np.uint64), WINDOW)[at]
    order = np.lexsort((doc[owner], key, group[owner]))
    g, k = group[owner[order]], key[order]
    fresh = np.concatenate([[True], (g[1:] != g[:-1]) | (k[1:] != k[:-1])])
    first = order[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]  # of each node's suffixes, one of the least document
    again = np.flatnonzero(doc[owner[order]] > doc[owner[first]])
    found = []
    for part in np.array_split(again, len(again) // 20_000 + 1):  # the words decide, not their hash
        a, b = at[order[part]][:, None] + np.arange(WINDOW), at[first[part]][:, None] + np.arange(WINDOW)
        found.append(order[part[(flat[a] == flat[b]).all(axis=1)]])
    found = np.sort(np.concatenate(found))
    return owner[found], offset[found]


def removals(documents: DataFrame) -> DataFrame:
    """Windows to remove, as (doc_id, tid, at, n): n windows from word at on; tid tells rows of one doc_id apart."""
    modest_batches(documents.sparkSession)
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("tid"), "text")

    def census(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for doc, tid, text in zip(part["doc_id"], part["tid"], part["text"], strict=True):
                keys, counts = np.unique(prefixes(codes_of(words_of(text))), return_counts=True)
                if len(keys):
                    out.append((np.full(len(keys), doc), np.full(len(keys), tid), keys.view(np.int64), counts))
            if out:
                yield pd.DataFrame(dict(zip(("doc_id", "tid", "prefix", "windows"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    held = checkpointed(docs.mapInPandas(census, "doc_id long, tid long, prefix long, windows long"))
    shared = held.groupBy("prefix").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.sum("windows").alias("all")).where("lo < hi").select("prefix", (F.col("all") > IN_MEMORY).alias("long"))
    per = held.join(shared, "prefix").groupBy("doc_id", "tid").agg(F.collect_list(F.when(~F.col("long"), F.col("prefix"))).alias("short"), F.collect_list(F.when(F.col("long"), F.col("prefix"))).alias("long"))
    per = checkpointed(per)
    texts = docs.dropDuplicates(["doc_id", "tid"]).join(per, ["doc_id", "tid"])

    def stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for doc, tid, text, short in zip(part["doc_id"], part["tid"], part["text"], part["short"], strict=True):
                if not len(short):
                    continue
                codes = codes_of(words_of(text))
                keys = prefixes(codes).view(np.int64)
                codes = (codes >> np.uint64(32)).astype(np.uint32)
                starts, ends = runs_of(keys)
                for s, e in zip(*(x[np.isin(keys[starts], short)].tolist() for x in (starts, ends)), strict=True):
                    out.append((keys[s], doc, tid, s, codes[s : e + WINDOW - 1].tobytes()))
            yield pd.DataFrame(out, columns=["prefix", "doc_id", "tid", "at", "codes"])

    def subtrees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(part: pd.DataFrame) -> pd.DataFrame:
            owner, offset = repeats(part["prefix"].to_numpy(), part["doc_id"].to_numpy(), [np.frombuffer(x, dtype=np.uint32) for x in part["codes"]])
            if not len(owner):
                return pd.DataFrame({"doc_id": [], "tid": [], "at": [], "n": []})
            fresh = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1)]))
            rows = part.iloc[owner[fresh]]
            return pd.DataFrame({"doc_id": rows["doc_id"].to_numpy(), "tid": rows["tid"].to_numpy(), "at": rows["at"].to_numpy() + offset[fresh], "n": np.diff(np.append(fresh, len(owner)))})

        held = []
        for part in batches:
            if part.empty:
                continue
            last = part["prefix"].iloc[-1]
            open_ = (part["prefix"] == last).to_numpy()
            if open_.all() and held and held[-1]["prefix"].iloc[-1] == last:
                held.append(part)
                continue
            if not open_.all():
                yield done(pd.concat([*held, part[~open_]], ignore_index=True))
                held = []
            elif held:
                yield done(pd.concat(held, ignore_index=True))
                held = []
            held.append(part[open_])
        if held:
            yield done(pd.concat(held, ignore_index=True))

    schema = "doc_id long, tid long, at int, n int"
    cold = texts.where(F.size("short") > 0).select("doc_id", "tid", "text", "short").mapInPandas(stretches, "prefix long, doc_id long, tid long, at int, codes binary")
    cold = cold.repartition("prefix").sortWithinPartitions("prefix").mapInPandas(subtrees, schema)

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for doc, tid, text, long in zip(part["doc_id"], part["tid"], part["text"], part["long"], strict=True):
                codes = codes_of(words_of(text))
                at = np.flatnonzero(np.isin(prefixes(codes).view(np.int64), long))
                yield pd.DataFrame({"h": rolling(codes, WINDOW)[at].view(np.int64), "i": rolling(codes, WINDOW, 1)[at].view(np.int64), "doc_id": np.full(len(at), doc), "tid": np.full(len(at), tid), "at": at})

    hot = texts.where(F.size("long") > 0).select("doc_id", "tid", "text", "long").mapInPandas(windows, "h long, i long, doc_id long, tid long, at int")
    hot = hot.join(hot.groupBy("h", "i").agg(F.min("doc_id").alias("least")), ["h", "i"]).where("doc_id > least").select("doc_id", "tid", "at", F.lit(1).alias("n"))
    return cold.unionByName(hot)


def deduplicated(documents: DataFrame) -> DataFrame:
    """For each row of documents: doc_id, n_words, n_removed, kept (the words that stay, joined by one space).

    A word goes if a window of WINDOW words that covers it also starts in a document of smaller doc_id. A null or empty text, and one of
    fewer words than a window, loses none. A row with a null doc_id is neither larger nor smaller than others and stays whole. Rows of one
    doc_id don't repeat each other. Other columns are not read.
    """
    docs = documents.select("doc_id", "text", F.xxhash64("text").alias("tid"))
    cuts = removals(documents).groupBy("doc_id", "tid").agg(F.collect_list("at").alias("at"), F.collect_list("n").alias("n"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for text, at, n in zip(part["text"], part["at"], part["n"], strict=True):
                tokens, gone = words_of(text), 0
                if at is not None and len(at):
                    delta = np.zeros(len(tokens) + 1, np.int64)
                    np.add.at(delta, at, 1)
                    np.add.at(delta, np.minimum(at + n + WINDOW - 1, len(tokens)), -1)
                    stays = np.cumsum(delta[:-1]) == 0
                    gone = len(tokens) - int(stays.sum())
                    kept = [tokens[i] for i in np.flatnonzero(stays).tolist()]
                else:
                    kept = tokens
                out.append((len(tokens), gone, b" ".join(kept).decode("utf-8", "surrogatepass")))
            yield pd.concat([part[["doc_id"]].reset_index(drop=True), pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])], axis=1)

    return docs.join(cuts, ["doc_id", "tid"], "left").select("doc_id", "text", "at", "n").mapInPandas(cut, "doc_id long, n_words long, n_removed long, kept string")


def report(documents: DataFrame) -> DataFrame:
    """The digest of deduplicated(): doc_id, n_words, n_removed, kept_sha256."""
    return deduplicated(documents).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
