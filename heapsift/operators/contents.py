"""Duplicates, collections, searches and the difference between two dumps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_folded


def duplicate_strings(strings: DataFrame) -> DataFrame:
    """text, copies, wasted of texts that several arrays hold. strings: obj, array, text, bytes (of string and array). An array counts once, by its string of least id; wasted is what all but the array of least id take."""
    once = strings.groupBy("array").agg(F.min_by(F.struct("text", "bytes"), "obj").alias("x")).select("array", "x.text", "x.bytes")
    return _copies(once, "text")


def duplicate_arrays(arrays: DataFrame, content: str = "content") -> DataFrame:
    """content, copies, wasted of array contents that occur several times. arrays: array, content, bytes."""
    return _copies(arrays, content)


def _copies(rows: DataFrame, key: str) -> DataFrame:
    groups = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("copies"), (F.sum("bytes") - F.min_by("bytes", "array")).alias("wasted"))
    return groups.where("copies > 1")


def boxed_values(boxed: DataFrame, top: int = 5) -> DataFrame:
    """class, instances, distinct, wasted, values: boxed values that waste memory. boxed: class, bits, shallow (per instance). values: the most frequent ones, value:count."""
    tallied = boxed.groupBy("class", "bits").agg(F.count("*").alias("n"), F.max("shallow").alias("shallow"))
    w = Window.partitionBy("class").orderBy(F.desc("n"), "bits")
    ranked = tallied.withColumn("rank", F.row_number().over(w))
    shown = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("rank") <= top, F.struct("rank", "bits", "n")))), lambda x: F.concat(x["bits"].cast("string"), F.lit(":"), x["n"].cast("string"))), " ")
    out = ranked.groupBy("class").agg(F.sum("n").alias("instances"), F.count("*").alias("distinct_values"), F.sum((F.col("n") - 1) * F.col("shallow")).alias("wasted"), shown.alias("top_values"))
    return out.where("wasted > 0")


def find_text(strings: DataFrame, needle: str) -> DataFrame:
    """The strings (obj, text) that hold needle; case of A-Z is ignored."""
    return strings.where(contains_folded(F.col("text"), needle))


def collection_fill(collections: DataFrame, reference: int = 8, sparse: int = 64, colliding: int = 64) -> DataFrame:
    """class, collections, empty, entries, capacity, wasted, sparse, colliding. collections: class, entries, capacity (slots), used_buckets (null or 0 where it has none).

    Used slots are the used buckets if known, else as many as entries. Sparse: at least `sparse` slots, less than half of them used.
    Colliding: at least `colliding` entries in less than half as many buckets.
    """
    known = F.coalesce(F.col("used_buckets"), F.lit(0))
    used = F.when(known > 0, known).otherwise(F.least("entries", "capacity"))
    flags = collections.withColumn("used", used)
    return flags.groupBy("class").agg(
        F.count("*").alias("collections"), F.count(F.when(F.col("entries") == 0, 1)).alias("empty"), F.sum("entries").alias("entries"), F.sum("capacity").alias("capacity"),
        F.sum((F.col("capacity") - F.col("used")) * reference).alias("wasted"),
        F.count(F.when((F.col("capacity") >= sparse) & (2 * F.col("used") < F.col("capacity")), 1)).alias("sparse"),
        F.count(F.when((F.col("entries") >= colliding) & (known > 0) & (2 * known < F.col("entries")), 1)).alias("colliding"),
    )


def changes(before: DataFrame, now: DataFrame, key: list[str], measures: list[str]) -> DataFrame:
    """key, and of each measure before, now and change, of what differs. A key that one side lacks counts as 0 there; equal keys of a side are summed."""
    side = lambda df, s: df.groupBy(*key).agg(*[F.sum(m).alias(f"{m}_{s}") for m in measures])
    both = side(before, "before").join(side(now, "now"), key, "full_outer").na.fill(0, [f"{m}_{s}" for m in measures for s in ("before", "now")])
    both = both.withColumns({f"{m}_change": F.col(f"{m}_now") - F.col(f"{m}_before") for m in measures})
    return both.where(reduce(lambda a, b: a | b, [F.col(f"{m}_change") != 0 for m in measures]))
