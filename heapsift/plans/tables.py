"""The tables that every analysis reads."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

#: The virtual root that dominates all GC roots.
ROOT = 0


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it names none, a temporary one if the master is local, else an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="heapsift-")
        atexit.register(shutil.rmtree, _OWN[sc.applicationId], ignore_errors=True)
    return _OWN[sc.applicationId]


_OWN: dict[str, str] = {}


def checkpointed(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again: its lineage is cut, its size is known, and only columns in use are read."""
    path = f"{shared_folder(df.sparkSession)}/heapsift-{uuid.uuid4().hex}"
    df.write.options(**PACKED).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Written columns are mostly ids, which rise within a file: differences of neighbours take far fewer bytes.
PACKED = {"compression": "zstd", "parquet.writer.version": "v2"}


@contextmanager
def shuffled(spark: SparkSession, parts: int) -> Iterator[None]:
    """What is run within shuffles into that many parts, and joins by key without broadcasts: what both sides are dealt by costs nothing."""
    wanted = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def dealt(df: DataFrame, key: str, parts: int) -> DataFrame:
    """As checkpointed(), dealt by the hash of key into parts: tables dealt alike are joined and grouped by key without a shuffle."""
    spark, name = df.sparkSession, f"heapsift_{uuid.uuid4().hex}"
    with shuffled(spark, parts):
        df.write.options(**PACKED).option("path", f"{shared_folder(spark)}/{name}").format("parquet").bucketBy(parts, key).sortBy(key).saveAsTable(name)
    return spark.table(name)


@dataclass(frozen=True)
class HeapTables:
    """classes(class_id, name, super_id, loader_id), objects(obj, class_id, kind, len, shallow), edges(src, ord, dst, label, elem), roots(obj, kind), weak_edges(src, dst, ref_kind).

    obj is the object's id; orders by object are orders by id. elem is the index within an array, null for fields. Several edges may join
    the same two objects. kind of an object is instance, object_array, primitive_array or class.
    """

    classes: DataFrame
    objects: DataFrame
    edges: DataFrame
    roots: DataFrame
    weak_edges: DataFrame

    def cut(self) -> HeapTables:
        return replace(self, **{k: checkpointed(getattr(self, k)) for k in ("classes", "objects", "edges", "roots", "weak_edges")})

    def views(self) -> None:
        """Registers the tables as temporary views, for SQL."""
        for k in ("classes", "objects", "edges", "roots", "weak_edges"):
            getattr(self, k).createOrReplaceTempView(f"heap_{k}")
