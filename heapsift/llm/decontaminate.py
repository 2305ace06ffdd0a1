"""Benchmark decontamination: word windows of benchmark items are looked up in documents, as a broadcast hash set of n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_ALNUM, fresh, lower_ascii, words

WINDOW = 10
#: The set of benchmark windows is broadcast up to this size; beyond it the join is dealt by hash, and AQE splits hot hashes.
BROADCAST_BYTES = 64 << 20


def windows_of(tokens: Column, size: Column) -> Column:
    """All runs of size consecutive tokens."""
    n = F.size(tokens) - size
    return F.when((n >= 0) & (size > 0), F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(tokens, i + 1, size)))


def word_hashes(tokens: str) -> Column:
    return F.transform(tokens, lambda x: F.xxhash64(x))


def rolling_hashes(docs: DataFrame, widths: list[int], *keep: str) -> DataFrame:
    """For each start pos of a word in wh (hashes of words) and each of widths: keep, pos, width and the hash of the run, null where it would pass the end.

    A row without words gives one row, its pos null. The outer generator is used as a plain one adds a filter on what it explodes, which
    would be worked out twice; the hashes are made after it, as there they are compiled with the join that follows.
    """
    rows = docs.select(*keep, "wh", F.posexplode_outer("wh").alias("pos", "_"))
    run = lambda k: F.when(F.col("pos") + k <= F.size("wh"), F.xxhash64(*[F.get("wh", F.col("pos") + j) for j in range(k)]))
    if len(widths) <= 1:
        return rows.select(*keep, "pos", F.lit(widths[0] if widths else 0).alias("width"), run(widths[0]).alias("hash") if widths else F.lit(None).cast("long").alias("hash"))
    return rows.select(*keep, "pos", F.inline(F.array(*[F.struct(F.lit(k).alias("width"), run(k).alias("hash")) for k in widths])))


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """A row for each distinct window: k (its words), grams (the words), h (their hash), items (sorted distinct item ids).

    A window is n consecutive words of an item, or all words of an item of fewer. Items that are null or have no words give none; a null
    item_id counts as a window of no item.
    """
    item = benchmark.select("item_id", words(lower_ascii(F.col("text")), WORD_ALNUM).alias("w"))
    k = F.least(F.lit(n), F.size("w"))
    rows = item.select("item_id", k.alias("k"), F.explode_outer(windows_of(F.col("w"), k)).alias("grams")).where("grams is not null")
    return rows.groupBy("k", "grams").agg(F.sort_array(F.collect_set("item_id")).alias("items")).withColumn("h", F.xxhash64(word_hashes("grams")))


def _met(docs: DataFrame, side: DataFrame, ks: list[int]) -> DataFrame:
    """doc_id, id, chars, n_words, raw (struct<start, len> of each window found), items. The windows are broadcast; those of documents never leave the map task but where they hit."""
    rows = rolling_hashes(docs.withColumn("wh", word_hashes("w")), ks, "doc_id", "id", "chars", "w")
    first = F.col("pos").isNull() | ((F.col("pos") == 0) & (F.col("width") == (ks or [0])[0]))  # stands for the document, so that one without hits stays
    hits = rows.join(F.broadcast(side), F.col("hash") == F.col("h"), "left").where(first | F.col("h").isNotNull())
    verified = F.coalesce((F.col("width") == F.col("k")) & (F.slice("w", F.col("pos") + 1, F.col("k")) == F.col("grams")), F.lit(False))
    hits = hits.withColumn("hit", verified).where(first | F.col("hit"))
    span = F.when(F.col("hit"), F.struct(F.col("pos").alias("start"), F.col("k").alias("len")))
    # Each of a row's hits on the first window comes once; of several equal hashes there only one is verified.
    return hits.groupBy("doc_id", "id", "chars").agg(
        F.max(F.size("w")).alias("n_words"), F.sort_array(F.collect_set(span)).alias("raw"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("hit"), F.col("items")))))).alias("items"),
    )


def _joined(docs: DataFrame, side: DataFrame, ks: list[int]) -> DataFrame:
    """As _met(), for windows that are too many to broadcast: hashes meet by a join, and the hits, few as they are, go back to their documents to be verified."""
    key = ["doc_id", "id", "chars"]
    rows = rolling_hashes(docs.withColumn("wh", word_hashes("w")), ks, *key).where("hash is not null")
    hits = rows.join(side, (F.col("hash") == F.col("h")) & (F.col("width") == F.col("k"))).groupBy(*key).agg(F.collect_set(F.struct("pos", "k", "grams", "items")).alias("hits"))
    same = [F.col(c).eqNullSafe(F.col(f"hit_{c}")) for c in key]
    both = docs.dropDuplicates(key).join(hits.withColumnsRenamed({c: f"hit_{c}" for c in key}), same[0] & same[1] & same[2], "left")
    good = F.filter("hits", lambda x: F.slice("w", x["pos"] + 1, x["k"]) == x["grams"])
    both = both.select(*key, F.size("w").alias("n_words"), F.coalesce(good, F.array().cast(hits.schema["hits"].dataType)).alias("good"))
    raw = F.sort_array(F.array_distinct(F.transform("good", lambda x: F.struct(x["pos"].alias("start"), x["k"].alias("len")))))
    return both.select(*key, "n_words", raw.alias("raw"), F.array_sort(F.array_distinct(F.flatten(F.transform("good", lambda x: x["items"])))).alias("items"))


def scan(documents: DataFrame, benchmark: DataFrame, n: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A row for each document: doc_id, id and chars (the text's hash and length), n_words, n_hit, items (sorted array of the ids whose windows occur), spans (sorted array of disjoint struct<start, len> of the words hit).

    Null texts have no words. Rows that are equal in doc_id and text give one row together. Of other
    columns none is used. The document side is read once and its windows never leave the map task but where they hit.
    """
    windows = benchmark_windows(benchmark, n)
    sizes = windows.groupBy("k").agg(F.sum(F.length(F.concat_ws(" ", "grams")) + 16 * F.col("k") + 16 * F.size("items") + 64).alias("bytes")).collect()  # n rows at most
    ks = sorted(r["k"] for r in sizes)
    side = windows.select("h", "k", "grams", "items")
    docs = documents.select("doc_id", F.xxhash64("text").alias("id"), F.length("text").alias("chars"), words(lower_ascii(F.col("text")), WORD_ALNUM).alias("w"))
    per = _met(docs, side, ks) if sum(r["bytes"] for r in sizes) <= broadcast_bytes else _joined(docs, side, ks)
    # Of windows with one start the longest counts, so that no more than n - 1 earlier ones reach into one.
    longest = per.withColumn("raw", F.filter("raw", lambda x, i: F.coalesce(F.get("raw", i + 1)["start"] != x["start"], F.lit(True))))
    before = lambda i: F.slice("raw", F.greatest(i - (n - 1), F.lit(0)) + 1, F.least(i, F.lit(n - 1)))
    begin = lambda x, i: F.greatest(x["start"], F.coalesce(F.array_max(F.transform(before(i), lambda y: y["start"] + y["len"])), F.lit(0)))
    pieces = F.transform("raw", lambda x, i: F.struct(begin(x, i).alias("start"), (x["start"] + x["len"] - begin(x, i)).alias("len")))
    per = longest.withColumn("spans", F.filter(pieces, lambda x: x["len"] > 0))
    return per.select("doc_id", "id", "chars", F.col("n_words").cast("long").alias("n_words"), F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["len"]).alias("n_hit"), "items", "spans")


def clean_documents(documents: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """documents without the rows in which a window of the benchmark occurs. Each row is judged by its own text, also where its doc_id is null or another row's."""
    doc, tid, size = fresh(documents, "doc", "id", "chars")
    bad = scan(documents, benchmark, n).where("n_hit > 0").select(F.col("doc_id").alias(doc), F.col("id").alias(tid), F.col("chars").alias(size))
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(tid)) & (F.length("text") == F.col(size))
    return documents.join(bad, same, "left_anti")


def report(documents: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """The digest of scan(): doc_id, n_words, n_hit, n_items, items_sha256 (of the ids sorted as strings, comma-joined), contaminated."""
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return scan(documents, benchmark, n).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
