"""Line dedup with fuzzy lines: MinHash signatures of character shingles, banding, exact Jaccard similarity, union of what is similar.

Each line is encoded at four bytes a character, so that a shingle is cut out in constant time. All hash functions of the signature are one
64-bit hash xored with different constants: the least value is that of the shingle nearest to a constant, and of two sets' shingles each is
equally likely to be it.

Every pair of lines that shares a band is compared, or holds together already when its turn comes: small buckets give their pairs; of a
large one each line first meets a few heads, and the pairs that this leaves in different groups are compared in blocks.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, components, fresh

SHINGLE, SIMILAR = 10, 0.8
#: Rows of a band and bands: a pair of similarity 0.8 shares a band with probability 0.986, one of 0.9 with 0.9996.
ROWS, BANDS = 3, 6
#: Shingles that are hashed as one row.
STRIDE = 4
#: Lines of a bucket that are all compared with each other at once; in a larger one each is first compared with REPRESENTATIVES lines.
PAIRED, REPRESENTATIVES = 16, 2
#: Characters of the lines of a large bucket's chunk; each pair of chunks is compared as one row.
CHUNK = 1 << 16
#: Longs of parity bits of a line.
LANES = 16


def constant(name: str) -> int:
    x = xxhash.xxh64_intdigest(name)
    return x - (1 << 64) if x >> 63 else x


def released(df: DataFrame) -> DataFrame:
    """df as checkpointed() gives it; the shuffle files that it took go then, and not when the driver happens to collect its garbage."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, "false")
    conf.set(name, "true")
    try:
        return checkpointed(df.select("*"))  # planned under this setting
    finally:
        conf.set(name, before)


def split_lines(documents: DataFrame) -> DataFrame:
    """doc_id, tid (hash of the text), line_no and line, of lines that aren't blank, of rows with a doc_id."""
    docs = documents.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("tid"), F.split("text", "\n").alias("lines"))
    rows = docs.select("doc_id", "tid", F.posexplode_outer("lines").alias("line_no", "line"))
    return rows.where(F.trim("line") != "").withColumn("h", F.xxhash64("line"))


def signatures(lines: DataFrame) -> DataFrame:
    """h and the bands' keys of each line (h, line) of SHINGLE characters or more."""
    # No filter on the length: it would encode each line once more.
    rows = lines.select("h", F.encode("line", "UTF-32").alias("units")).select("h", "units", F.greatest((F.length("units") / 4).cast("int") - SHINGLE, F.lit(0)).alias("last"))
    rows = rows.select("h", "units", "last", F.explode_outer(F.sequence(F.lit(0), F.col("last"), F.lit(STRIDE))).alias("at"))
    # Past the end the last shingle comes again, which changes no minimum.
    shingle = lambda j: F.substring("units", 4 * F.least(F.col("at") + j, F.col("last")) + 1, F.lit(4 * SHINGLE))
    rows = rows.select("h", *[F.xxhash64(shingle(j)).alias(f"x{j}") for j in range(STRIDE)])
    near = lambda i: F.least(*[F.col(f"x{j}").bitwiseXOR(F.lit(constant(f"min {i}"))) for j in range(STRIDE)])
    least = rows.groupBy("h").agg(*[F.min(near(i)).alias(f"m{i}") for i in range(ROWS * BANDS)])
    return least.select("h", F.explode(F.array(*[F.xxhash64(F.lit(b), *[F.col(f"m{b * ROWS + i}") for i in range(ROWS)]) for b in range(BANDS)])).alias("key"))


def bucketed(bands: DataFrame) -> DataFrame:
    """key, h, n, the number of the bucket's members, of buckets of several; heads, the members that are least under REPRESENTATIVES orders that all buckets share; after, the next PAIRED - 1 members."""
    by = Window.partitionBy("key")
    # Windows rather than aggregates joined back, so that the signatures are worked out and dealt once; a window over many rows spills.
    rows = bands.select("key", "h").withColumn("n", F.count("*").over(by)).where("n > 1")
    orders = [F.lit(constant(f"order {i}")) for i in range(REPRESENTATIVES)]
    heads = F.array(*[F.min(F.col("h").bitwiseXOR(o)).over(by).bitwiseXOR(o) for o in orders])
    return rows.withColumn("heads", heads).withColumn("after", F.collect_list("h").over(by.orderBy("h").rowsBetween(1, PAIRED - 1)))


def candidates(members: DataFrame) -> DataFrame:
    """Pairs a < b of lines to compare first: all of a bucket of PAIRED members at most, in a larger one each with the heads. across() compares what these leave apart.

    A line of large buckets also comes as a pair with itself, with their keys; so the buckets are worked out once for both.
    """
    large = F.col("n") > PAIRED
    both = members.select("key", "h", "n", F.explode(F.when(large, F.concat("heads", F.array("h"))).otherwise(F.col("after"))).alias("g")).where(large | (F.col("h") != F.col("g")))
    both = both.select(F.least("h", "g").alias("a"), F.greatest("h", "g").alias("b"), F.when(F.col("h") == F.col("g"), F.col("key")).alias("key"))
    return both.groupBy("a", "b").agg(F.collect_set("key").alias("keys"))  # BANDS at most


def shingles(line: Column) -> Column:
    """The hashes of a line's shingles, repeats included. As lambdas over one element, so that a line is encoded once and not for each place."""
    last = lambda units: F.greatest(F.length(units) - (4 * SHINGLE - 1), F.lit(1))
    hashes = lambda units: F.transform(F.sequence(F.lit(1), last(units), F.lit(4)), lambda at: F.xxhash64(F.substring(units, at, F.lit(4 * SHINGLE))))
    return F.transform(F.array(F.encode(line, "UTF-32")), hashes)[0]


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df dealt to as many tasks as a shuffle has: few bytes can be much work, so that they must not be put together."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def similar(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets of shingles have a Jaccard similarity of SIMILAR or more; of a line paired with itself a, keys and line, with no b. The skew join splits a line of very many pairs."""
    both = pairs.join(lines.select(F.col("h").alias("a"), F.col("line").alias("x")), "a").join(lines.select(F.col("h").alias("b"), F.col("line").alias("y")), "b")
    alone = F.col("a") == F.col("b")
    # As rows of one element, for a filter on plain columns would be pushed down and work out the hashes at each use.
    swap = F.octet_length("x") < F.octet_length("y")
    of = lambda c, d: F.when(~alone, shingles(F.when(swap, F.col(d)).otherwise(F.col(c))))
    both = both.select("a", "b", "keys", "x", F.inline_outer(F.array(F.struct(of("x", "y").alias("s"), of("y", "x").alias("t")))))
    # What either set lacks of the other, the longer line's first, decides as soon as it can: a set has as many elements as its array at most.
    less = lambda s, t: F.explode_outer(F.array(F.size(F.array_except(s, t))))
    enough = lambda n: (n - F.col("m")) * (1 - SIMILAR) >= SIMILAR * (F.col("m") + F.col("k")) - 1e-6
    both = both.select("*", less("s", "t").alias("m")).where(alone | (F.col("m") <= (1 - SIMILAR) * F.size("s") + 1e-6))
    both = both.select("*", less("t", "s").alias("k")).where(alone | (enough(F.size("s")) & enough(F.size(F.array_distinct("s")))))
    return both.select("a", F.when(~alone, F.col("b")).alias("b"), F.when(alone, F.col("keys")).alias("keys"), F.when(alone, F.col("x")).alias("line"))


def sketched(lines: DataFrame) -> DataFrame:
    """h, size (of its set of shingles) and bits of each line (h, line): LANES longs of bits, each the parity of the hashes that fall on it. Two sets differ in at least as many elements as these differ in bits."""
    rows = lines.select("h", F.explode_outer(F.array_distinct(shingles(F.col("line")))).alias("x"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("x").bitwiseAND(F.lit(63)).cast("int"))
    lane = F.shiftright("x", 6).bitwiseAND(F.lit(LANES - 1))
    return rows.groupBy("h").agg(F.count("*").cast("int").alias("size"), F.array(*[F.coalesce(F.bit_xor(F.when(lane == k, bit)), F.lit(0).cast("long")) for k in range(LANES)]).alias("bits"))


def across(large: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) of similar lines of one large bucket that roots leaves in different groups: every such pair is compared, in pairs of chunks. large: h, keys (of its large buckets), line.

    Of a pair that shares several buckets the least key's compares it. A pair is dropped unseen only where it can't be similar: by the sizes
    of its sets, or by bits that are never more than the elements in which they differ.
    """
    of = large.join(roots, F.col("h") == F.col("node"), "left").select("h", F.coalesce("root", "h").alias("root"), "keys", "line")
    of = checkpointed(of.join(sketched(large.select("h", "line")), "h"))
    keyed = of.select("h", "root", F.explode("keys").alias("key"), F.char_length("line").alias("chars"))
    groups = keyed.groupBy("key", "root").agg(F.sum("chars").alias("chars"), F.count("*").alias("n"))
    # Of a bucket of several groups: the largest one, and chunks of its lines and of the others. Lines of the largest only meet the others.
    mixed = groups.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max(F.struct("n", "root", "chars"))["chars"].alias("most"), F.sum("chars").alias("all"), F.count("*").alias("groups")).where("groups > 1")
    mixed = mixed.select("key", "main", F.ceil((F.col("all") - F.col("most") + 1) / CHUNK).cast("int").alias("others"), F.ceil((F.col("most") + 1) / CHUNK).cast("int").alias("mains"))
    keyed = keyed.join(mixed, "key").groupBy("h").agg(F.sort_array(F.collect_list(F.struct("key", "main", "others", "mains"))).alias("in"))  # BANDS buckets at most
    rows = of.drop("keys").join(keyed, "h").select("h", "root", F.col("in.key").alias("keys"), "line", "size", "bits", F.inline("in"))
    part = lambda n: F.pmod(F.xxhash64("h"), F.col(n).cast("long")).cast("int")
    is_main = F.col("root") == F.col("main")
    rows = rows.withColumn("own", F.when(is_main, F.col("others") + part("mains")).otherwise(part("others")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(is_main, F.col("others") - 1).otherwise(F.col("others") + F.col("mains") - 1))))
    line = F.struct("h", "root", "keys", "line", "size", "bits", "own")
    each = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), line.alias("x"))
    # Each chunk meets itself as (i, i) and every other one once.
    blocks = dealt(each, "key", "i", "j").groupBy("key", "i", "j").agg(F.collect_list("x").alias("xs"))
    hashed = F.transform("xs", lambda x: x.withField("s", shingles(x["line"])).dropFields("line"))
    blocks = blocks.select("key", "i", "j", hashed.alias("xs"))

    def alike(x: Column, y: Column) -> Column:
        both = x["size"] + y["size"]
        apart = lambda n: sum((F.bit_count(x["bits"][k].bitwiseXOR(y["bits"][k])) for k in range(n)), F.lit(0))
        shared = F.size(F.array_intersect(x["s"], y["s"]))
        # Similarity s of sets of n elements together: s (n - shared) <= shared, so they differ in n (1 - s) / (1 + s) at most.
        may = (x["root"] != y["root"]) & ((F.col("i") == F.col("j")) | (x["own"] != y["own"]))
        may &= F.least(x["size"], y["size"]) >= SIMILAR * F.greatest(x["size"], y["size"]) - 1e-6
        for n in (LANES // 2, LANES):  # half of the bits mostly tell already
            may &= apart(n) * (1 + SIMILAR) <= both * (1 - SIMILAR) + 1e-6
        return (x["h"] < y["h"]) & may & (F.array_min(F.array_intersect(x["keys"], y["keys"])) == F.col("key")) & (shared * (1 + SIMILAR) >= SIMILAR * both - 1e-6)

    pairs = F.flatten(F.transform("xs", lambda x: F.transform(F.filter("xs", lambda y: alike(x, y)), lambda y: F.struct(x["h"].alias("a"), y["h"].alias("b")))))
    return blocks.select(F.inline(pairs))


def linked(lines: DataFrame) -> DataFrame:
    """node and root of each line that is linked to another: the groups that all similar pairs of lines that share a band hold together."""
    # Shorter lines have no shingle and are linked only if equal. A character has four bytes at most; to count bytes is faster.
    distinct = lines.where((F.octet_length("line") >= 4 * SHINGLE) | (F.char_length("line") >= SHINGLE)).groupBy("h").agg(F.first("line").alias("line"))
    # One job, so that the signatures are worked out and the texts dealt once: the similar pairs, and the lines of large buckets for what is left apart.
    found = released(similar(candidates(bucketed(signatures(distinct))), distinct))
    roots = components(found.where("b is not null"))
    rest = released(across(found.where("b is null").select(F.col("a").alias("h"), "keys", "line"), roots))
    return roots if rest.isEmpty() else components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(rest))


def line_groups(lines: DataFrame) -> DataFrame:
    """For each line that occurs more than once, in equal or similar form: h, root (the group's), keeper (the least doc_id that holds one of the group)."""
    roots = linked(lines)
    # The roots are put among the lines, as a join would sort all of them; and few lines are left, so that they are kept for both uses.
    rows = lines.select("h", "doc_id", F.lit(1).alias("one"), F.lit(None).cast("long").alias("root"))
    rows = rows.union(roots.select("node", F.lit(None).cast(lines.schema["doc_id"].dataType), F.lit(0), "root"))
    own = rows.groupBy("h").agg(F.min("doc_id").alias("least"), F.sum("one").alias("n"), F.max("root").alias("root")).where("n > 1 or root is not null")
    own = released(own.select("h", F.coalesce("root", "h").alias("root"), "least", "n"))
    groups = own.groupBy("root").agg(F.min("least").alias("keeper"), F.sum("n").alias("all")).where(F.col("all") > 1)
    return own.join(groups, "root").select("h", "root", "keeper")


def removals(documents: DataFrame) -> DataFrame:
    """doc_id, tid and gone: the numbers of the lines of a document that go."""
    lines = split_lines(documents)
    found = lines.select("doc_id", "tid", "line_no", "h").join(line_groups(lines), "h")
    per = found.groupBy("doc_id", "tid", "root", "keeper").agg(F.sort_array(F.collect_set("line_no")).alias("at"))
    go = F.when(F.col("doc_id") == F.col("keeper"), F.slice("at", 2, F.greatest(F.size("at") - 1, F.lit(0)))).otherwise(F.col("at"))
    return per.groupBy("doc_id", "tid").agg(F.flatten(F.collect_list(go)).alias("gone")).where(F.size("gone") > 0)


def deduplicated(documents: DataFrame) -> DataFrame:
    """documents without lines that repeat, exactly or in a fuzzy form: of each group of linked lines the first line of the least doc_id stays.

    Lines are linked if they are equal, or if the Jaccard similarity of their sets of SHINGLE characters is SIMILAR or more; groups are what
    links connect. Lines of fewer characters are linked only if equal. Blank lines stay and link nothing; so do all lines of a row whose
    doc_id is null, and null texts. Rows of one doc_id each keep the line that is that document's. Columns are those of documents; an n_chars
    that is there isn't changed. Lines are told apart by a 64-bit hash.
    """
    tid, doc, cut, gone = fresh(documents, "tid", "doc", "cut", "gone")
    docs = documents.withColumn(tid, F.xxhash64("text"))
    cuts = removals(documents).select(F.col("doc_id").alias(doc), F.col("tid").alias(cut), F.col("gone").alias(gone))
    docs = docs.join(cuts, (F.col("doc_id") == F.col(doc)) & (F.col(tid) == F.col(cut)), "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n")
    return docs.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept)).select(*documents.columns)


def report(documents: DataFrame) -> DataFrame:
    """doc_id, n_lines (before), n_kept, kept_sha256 (of the text that stays) for each row of documents; null texts count as no lines."""
    n = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(F.split(c, "\n"))).cast("long")
    docs = deduplicated(documents.select("doc_id", "text", n("text").alias("n_lines"), (F.col("text") == "").alias("empty")))
    # A text of which no line stays is empty; that is no line.
    left = F.when((F.col("text") == "") & ~F.col("empty"), 0).otherwise(n("text"))
    return docs.select("doc_id", "n_lines", left.cast("long").alias("n_kept"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
