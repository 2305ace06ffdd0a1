"""Heap dumps in the HPROF format, plain or packed, as a Spark data source; and the heap's tables made of it.

spark.read.format("hprof").option("table", "instances").load(path) reads one kind of record. A plain dump is read by many tasks: the driver
skips from one top-level record to the next, and cuts long heap segments at boundaries of the records in them. A packed dump is a stream
and is read by one task; write its tables as Parquet once and read those.
"""

from __future__ import annotations

import gzip
import io
import struct
import sys
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.sizes import Sizing
from ..functions.text import pretty_class_name
from ..plans.tables import HeapTables

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

MAGIC = b"JAVA PROFILE 1.0."
CHUNK = 32 << 20
#: Types by tag with their widths; a reference's is the dump's id size. Fixed values of the format.
TYPES = {2: ("ref", 0), 4: ("boolean", 1), 5: ("char", 2), 6: ("float", 4), 7: ("double", 8), 8: ("byte", 1), 9: ("short", 2), 10: ("int", 4), 11: ("long", 8)}
#: Roots by tag: kind, number of further ids, of further 32-bit numbers. Fixed values of the format.
ROOTS = {
    0xFF: ("unknown", 0, 0), 0x01: ("JNI global", 1, 0), 0x02: ("JNI local", 0, 2), 0x03: ("Java frame", 0, 2), 0x04: ("native stack", 0, 1), 0x05: ("sticky class", 0, 0),
    0x06: ("thread block", 0, 1), 0x07: ("monitor used", 0, 0), 0x08: ("thread object", 0, 2), 0x89: ("interned string", 0, 0), 0x8A: ("finalizing", 0, 0), 0x8B: ("debugger", 0, 0),
    0x8C: ("reference cleanup", 0, 0), 0x8D: ("VM internal", 0, 0), 0x8E: ("JNI monitor", 0, 2), 0x90: ("unreachable", 0, 0),
}
UTF8, LOAD_CLASS, FRAME, TRACE, HEAP, SEGMENT, HEAP_END = 1, 2, 4, 5, 0x0C, 0x1C, 0x2C

SCHEMAS = {
    "symbols": "sym_id long, text string",
    "loads": "serial long, class_id long, sym_id long, place long",
    "frames": "id long, method_sym long, source_sym long, class_serial long, line int",
    "traces": "serial long, frames array<long>",
    "roots": "obj long, kind string, thread_serial long, frame long, place long",
    "classes": "class_id long, super_id long, loader_id long, statics array<struct<sym:long,type:string,bits:long>>, fields array<struct<sym:long,type:string>>, place long",
    "instances": "id long, class_id long, data binary, place long",
    "object_arrays": "id long, class_id long, elements array<long>, place long",
    "primitive_arrays": "id long, type string, len long, data binary, place long",
    "meta": "format string, id_size int, taken_ms long, size long, packed boolean, truncated boolean",
}


class DumpError(ValueError):
    """A dump that is damaged otherwise than by a missing end."""


def opened(path: str) -> tuple[io.BufferedIOBase, int, bool]:
    """A stream of the dump, where in the file it starts and whether it is packed. The container is told by its first bytes: gzip, tar (also in gzip), zip, or none."""
    f = open(path, "rb")  # noqa: SIM115
    head = f.read(512)
    f.seek(0)
    if head[:2] == b"\x1f\x8b":
        inner = gzip.open(f)
        start = inner.read(512)
        inner.seek(0)
        return (_member(tarfile.open(fileobj=inner, mode="r|")) if start[257:262] == b"ustar" else inner), 0, True
    if head[257:262] == b"ustar":
        archive = tarfile.open(fileobj=f)
        for m in archive:
            if m.isfile():
                f.seek(m.offset_data)
                if f.read(len(MAGIC)) == MAGIC:
                    f.seek(m.offset_data)
                    return f, m.offset_data, False
        raise DumpError("no dump in the tar archive")
    if head[:4] == b"PK\3\4":
        archive = zipfile.ZipFile(f)
        for info in archive.infolist():
            if info.compress_type in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) and not info.is_dir():
                with archive.open(info) as inner:
                    if inner.read(len(MAGIC)) == MAGIC:
                        return archive.open(info), 0, True
        raise DumpError("no dump in the zip archive")
    return f, 0, False


def _member(archive: tarfile.TarFile) -> io.BufferedIOBase:
    for m in archive:
        if m.isfile():
            inner = archive.extractfile(m)
            start = inner.peek(len(MAGIC))[: len(MAGIC)] if hasattr(inner, "peek") else b""
            if start == MAGIC:
                return inner
    raise DumpError("no dump in the tar archive")


def whole(f, n: int | None) -> bytes:
    """n bytes, or all that are left; fewer where the stream ends, also where a packed one is cut."""
    parts, left = [], n
    while left is None or left > 0:
        try:
            part = f.read(min(left, 1 << 20) if left is not None else 1 << 20)
        except (EOFError, zlib.error):
            break
        if not part:
            break
        parts.append(part)
        left = None if left is None else left - len(part)
    return b"".join(parts)


def header(f) -> tuple[str, int, int, int]:
    """Format, id size, milliseconds, bytes of the header."""
    raw = b""
    while not raw.endswith(b"\0"):
        c = f.read(1)
        if not c or len(raw) > 40:
            raise DumpError("not a heap dump")
        raw += c
    name = raw[:-1].decode("latin-1")
    id_size, high, low = struct.unpack(">III", f.read(12))
    if not name.startswith(MAGIC.decode()) or id_size not in (4, 8):
        raise DumpError("not a heap dump")
    return name, id_size, high << 32 | low, len(raw) + 12


class Decoder:
    """Decodes the records of one dump; ids come as signed 64-bit numbers."""

    def __init__(self, id_size: int):
        self.id_size = id_size
        self.id = struct.Struct(">q" if id_size == 8 else ">I").unpack_from
        self.widths = {k: w or id_size for k, (_, w) in TYPES.items()}

    def ids(self, buf: bytes, at: int, n: int) -> list[int]:
        return list(struct.unpack_from(f">{n}{'q' if self.id_size == 8 else 'I'}", buf, at))

    def value(self, buf: bytes, at: int, tag: int) -> int:
        """The bits of a value; whole numbers are sign-extended, char and boolean are not."""
        raw = buf[at : at + self.widths[tag]]
        return int.from_bytes(raw, "big", signed=tag in (8, 9, 10, 11) or (tag == 2 and self.id_size == 8) or tag == 7)

    def top(self, tag: int, body: bytes, place: int) -> tuple[str, tuple] | None:
        i = self.id_size
        if tag == UTF8:
            return "symbols", (self.id(body, 0)[0], body[i:].decode("utf-8", "replace"))
        if tag == LOAD_CLASS:
            return "loads", (struct.unpack_from(">I", body)[0], self.id(body, 4)[0], self.id(body, 8 + i)[0], place)
        if tag == FRAME:
            serial, line = struct.unpack_from(">Ii", body, 4 * i)
            return "frames", (self.id(body, 0)[0], self.id(body, i)[0], self.id(body, 3 * i)[0], serial, line)
        if tag == TRACE:
            serial, _, n = struct.unpack_from(">III", body)
            return "traces", (serial, self.ids(body, 12, n))
        return None

    def length(self, buf: bytes, at: int) -> int:
        """Bytes of the record within a heap segment at a place of buf; struct.error or IndexError where buf ends before its head does."""
        tag, i = buf[at], self.id_size
        if tag in ROOTS:
            _, ids, words = ROOTS[tag]
            return 1 + i * (1 + ids) + 4 * words
        if tag == 0x21:
            return 1 + i + 4 + i + 4 + struct.unpack_from(">I", buf, at + 5 + 2 * i)[0]
        if tag == 0x22:
            return 1 + i + 8 + i + i * struct.unpack_from(">I", buf, at + 5 + i)[0]
        if tag in (0x23, 0xC3):
            n, kind = struct.unpack_from(">IB", buf, at + 5 + i)
            if kind not in self.widths:
                raise DumpError(f"unknown element type {kind}")
            return 1 + i + 9 + (n * self.widths[kind] if tag == 0x23 else 0)
        if tag == 0x20:
            p = at + 1 + i + 4 + 6 * i + 4
            for step in (0, 1, 2):  # constants, statics, fields
                (n,) = struct.unpack_from(">H", buf, p)
                p += 2
                for _ in range(n):
                    kind = buf[p + 2] if step == 0 else buf[p + i]
                    p += (3 if step == 0 else i + 1) + (0 if step == 2 else self.widths[kind])
            return p - at
        if tag == 0xFE:
            return 1 + 4 + i
        raise DumpError(f"unknown record {tag:#x} in a heap segment")

    def sub(self, buf: bytes, at: int, place: int) -> tuple[str, tuple] | None:
        tag, i = buf[at], self.id_size
        at += 1
        if tag in ROOTS:
            kind, ids, words = ROOTS[tag]
            more = struct.unpack_from(f">{words}I", buf, at + i * (1 + ids))
            return "roots", (self.id(buf, at)[0], kind, more[0] if words else None, more[1] if words > 1 else None, place)
        if tag == 0x21:
            n = struct.unpack_from(">I", buf, at + 4 + 2 * i)[0]
            p = at + 8 + 2 * i
            return "instances", (self.id(buf, at)[0], self.id(buf, at + i + 4)[0], bytes(buf[p : p + n]), place)
        if tag == 0x22:
            n = struct.unpack_from(">I", buf, at + i + 4)[0]
            return "object_arrays", (self.id(buf, at)[0], self.id(buf, at + i + 8)[0], self.ids(buf, at + 2 * i + 8, n), place)
        if tag in (0x23, 0xC3):
            n, kind = struct.unpack_from(">IB", buf, at + i + 4)
            p = at + i + 9
            return "primitive_arrays", (self.id(buf, at)[0], TYPES[kind][0], n, bytes(buf[p : p + n * self.widths[kind]]) if tag == 0x23 else None, place)
        if tag == 0x20:
            p, parts = at + i + 4 + 6 * i + 4, []
            for step in (0, 1, 2):
                (n,) = struct.unpack_from(">H", buf, p)
                p += 2
                rows = []
                for _ in range(n):
                    name, kind = (None, buf[p + 2]) if step == 0 else (self.id(buf, p)[0], buf[p + i])
                    p += 3 if step == 0 else i + 1
                    if step < 2:
                        rows.append((name, TYPES[kind][0], self.value(buf, p, kind)))
                        p += self.widths[kind]
                    else:
                        rows.append((name, TYPES[kind][0]))
                parts.append(rows)
            return "classes", (self.id(buf, at)[0], self.id(buf, at + i + 4)[0], self.id(buf, at + 2 * i + 4)[0], parts[1], parts[2], place)
        return None


def sections(f, start: int, first: int, size: int | None) -> Iterator[tuple[int, int, int]]:
    """Tag, place of the body and its length, of each top-level record of a seekable dump. A heap segment of length 0 goes on to the end of the file."""
    at = start + first
    while True:
        f.seek(at)
        head = f.read(9)
        if len(head) < 9:
            return
        tag, _, n = struct.unpack(">BII", head)
        if n == 0 and tag in (HEAP, SEGMENT):
            n = (size or 0) - at - 9
        yield tag, at + 9, n
        at += 9 + n


class Part(InputPartition):
    def __init__(self, ranges: list[tuple[int, int, int]]):
        super().__init__(None)
        self.ranges = ranges  # tag, place, length


class HprofReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table = options["path"], options.get("table", "instances")
        self.chunk = int(options.get("chunk", CHUNK))
        if self.table not in SCHEMAS:
            raise ValueError(f"no table {self.table}; there are {', '.join(SCHEMAS)}")

    def partitions(self) -> list[Part]:
        f, start, packed = opened(self.path)
        if packed or self.table == "meta":
            return [Part([])]
        _, id_size, _, first = header(f)
        f.seek(0, 2)
        size, decoder = f.tell(), Decoder(id_size)
        heap = self.table not in ("symbols", "loads", "frames", "traces")
        parts, now, held = [], [], 0
        for tag, at, n in sections(f, start, first, size):
            if (tag in (HEAP, SEGMENT)) != heap:
                continue
            for a, m in self.cut(f, decoder, at, min(n, size - at)) if heap and n > self.chunk else [(at, min(n, size - at))]:
                now.append((tag, a, m))
                held += m
                if held >= self.chunk:
                    parts, now, held = [*parts, Part(now)], [], 0
        return [*parts, Part(now)] if now or not parts else parts

    def cut(self, f, decoder: Decoder, at: int, n: int) -> list[tuple[int, int]]:
        """A long segment in pieces of whole records. Only their heads are looked at."""
        out, begin, p, end = [], at, at, at + n
        base, buf = at, b""
        while p < end:
            size = None
            for want in (1 << 20, 16 << 20, self.chunk * 4):
                if p - base < len(buf):
                    try:
                        size = decoder.length(buf, p - base)
                        break
                    except (struct.error, IndexError):
                        pass
                f.seek(p)
                base, buf = p, f.read(min(want, end - p))
            if size is None:
                try:
                    size = decoder.length(buf, p - base)
                except (struct.error, IndexError):
                    break  # the dump ends within this record
            p += size
            if p - begin >= self.chunk:
                out.append((begin, min(p, end) - begin))
                begin = p
        return [*out, (begin, end - begin)] if begin < end else out

    def read(self, part: Part) -> Iterator[tuple]:
        f, start, packed = opened(self.path)
        name, id_size, ms, first = header(f)
        decoder = Decoder(id_size)
        if self.table == "meta":
            whole = 0 if packed else f.seek(0, 2) or f.tell()
            cut = False if packed else any(at + n > whole for _, at, n in sections(f, start, first, whole))
            yield name, id_size, ms, whole, packed, cut
            return
        if packed:
            yield from self.stream(f, decoder, first)
            return
        for tag, at, n in part.ranges:
            f.seek(at)
            body = f.read(n)
            if tag in (HEAP, SEGMENT):
                yield from self.segment(body, decoder, at)
            elif len(body) == n and (x := decoder.top(tag, body, at)) and x[0] == self.table:
                yield x[1]

    def segment(self, body: bytes, decoder: Decoder, place: int) -> Iterator[tuple]:
        """The records of a piece; one that passes its end is the dump's missing end and closes it."""
        at, n = 0, len(body)
        while at < n:
            if body[at] in (HEAP, SEGMENT, HEAP_END) and body[at] not in ROOTS and n - at >= 9:  # an embedded segment head
                at += 9
                continue
            try:
                size = decoder.length(body, at)
            except (struct.error, IndexError):
                return
            if at + size > n:
                return
            x = decoder.sub(body, at, place + at)
            if x and x[0] == self.table:
                yield x[1]
            at += size

    def stream(self, f, decoder: Decoder, at: int) -> Iterator[tuple]:
        while len(head := whole(f, 9)) == 9:
            tag, _, n = struct.unpack(">BII", head)
            at += 9
            body = whole(f, None if n == 0 and tag in (HEAP, SEGMENT) else n)
            if tag in (HEAP, SEGMENT):
                yield from self.segment(body, decoder, at)
            elif len(body) == n and (x := decoder.top(tag, body, at)) and x[0] == self.table:
                yield x[1]
            at += len(body)


class HprofSource(DataSource):
    """Options: path, table (one of SCHEMAS), chunk (bytes of a task's share)."""

    @classmethod
    def name(cls) -> str:
        return "hprof"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "instances")]

    def reader(self, schema) -> HprofReader:
        return HprofReader(dict(self.options))


def table(spark: SparkSession, path: str, name: str, **options) -> DataFrame:
    spark.dataSource.register(HprofSource)
    return spark.read.format("hprof").options(table=name, **options).load(path)


def to_parquet(spark: SparkSession, path: str, folder: str) -> None:
    """Writes all tables of a dump once; heap(..., folder=) then reads them instead."""
    for name in SCHEMAS:
        table(spark, path, name).write.mode("overwrite").parquet(f"{folder}/{name}")


#: Classes whose field `referent` is a reference that the collector may clear, with the kind of reference. Fixed values of the Java library.
REFERENCES = {"java.lang.ref.SoftReference": "soft", "java.lang.ref.WeakReference": "weak", "java.lang.ref.PhantomReference": "phantom", "java.lang.ref.FinalReference": "final"}


def heap(spark: SparkSession, path: str, sizes: str = "auto", include_soft: bool = False, include_weak: bool = False, folder: str | None = None) -> HeapTables:
    """The heap's tables of a dump.

    The first record of an id counts, class objects last; null and unknown references are no edges. Layouts of classes are worked out on
    the driver: classes are few, and a class inherits the fields of its chain. Bodies are decoded where they are read.
    """
    read = (lambda n: spark.read.parquet(f"{folder}/{n}")) if folder else (lambda n: table(spark, path, n))
    meta = read("meta").first()
    symbols = read("symbols").dropDuplicates(["sym_id"])
    names = read("loads").groupBy("class_id").agg(F.min_by("sym_id", "place").alias("sym_id")).join(symbols, "sym_id", "left")
    dumps = read("classes").groupBy("class_id").agg(F.max_by(F.struct("super_id", "loader_id", "statics", "fields"), "place").alias("d"))
    classes = names.join(dumps, "class_id", "full_outer").select("class_id", pretty_class_name(F.coalesce("text", F.concat(F.lit("<class 0x"), F.lower(F.hex("class_id")), F.lit(">")))).alias("name"), "d.*")
    rows = {r["class_id"]: r for r in classes.collect()}
    wanted = {x["sym"] for r in rows.values() for x in [*(r["fields"] or ()), *(r["statics"] or ())]}
    text = {r["sym_id"]: r["text"] for r in symbols.join(F.broadcast(spark.createDataFrame([(s,) for s in wanted] or [(0,)], "sym_id long")), "sym_id").collect()}
    instances, arrays, prims = read("instances"), read("object_arrays"), read("primitive_arrays")
    top = max(df.agg(F.max("id")).first()[0] or 0 for df in (instances, arrays, prims))
    sizing = Sizing.resolve(sizes, meta["id_size"], top)
    chain = lambda c, n=0: [rows[c], *chain(rows[c]["super_id"], n + 1)] if c in rows and n < 64 else []
    width = {name: w or meta["id_size"] for name, w in TYPES.values()}
    layouts, shallow, kinds = {}, {}, {}
    reference = {c for c, r in rows.items() if r["name"] == "java.lang.ref.Reference"}
    for c in rows:
        at, slots, total, up = 0, [], 0, chain(c)
        kinds[c] = next((REFERENCES[r["name"]] for r in up if r["name"] in REFERENCES), "weak" if any(r["class_id"] in reference for r in up[1:]) else None)
        for r in up:
            for x in r["fields"] or ():
                if x["type"] == "ref":
                    slots.append((at, text.get(x["sym"], "?"), r["class_id"] in reference and text.get(x["sym"]) == "referent"))
                at += width[x["type"]]
                total += sizing.width(x["type"])
        layouts[c], shallow[c] = slots, -(-(sizing.header + total) // 8) * 8
    shared = spark.sparkContext.broadcast((layouts, kinds))
    big, keeps = meta["id_size"] == 8, {"soft": include_soft}

    def references(batches):
        import pandas as pd

        layouts, kinds = shared.value
        one = struct.Struct(">q" if big else ">I").unpack_from
        for part in batches:
            out = []
            for src, c, data in zip(part["id"], part["class_id"], part["data"], strict=True):
                for n, (at, label, referent) in enumerate(layouts.get(c, ())):
                    if at + (8 if big else 4) <= len(data) and (dst := one(data, at)[0]):
                        kind = kinds[c] if referent and not keeps.get(kinds[c], include_weak) else None
                        out.append((src, n, dst, label, kind))
            yield pd.DataFrame(out, columns=["src", "ord", "dst", "label", "ref_kind"]).astype({"src": "int64", "ord": "int64", "dst": "int64"})

    once = lambda df, *c: df.groupBy("id").agg(F.min_by(F.struct(*c), "place").alias("x")).select("id", "x.*")
    sized = spark.createDataFrame(list(shallow.items()), "class_id long, shallow long")
    class_of = {r["name"]: c for c, r in rows.items()}
    prim_class = {t: class_of.get(f"{t}[]", -k) for k, (t, _) in TYPES.items() if t != "ref"}
    n64 = F.lit(0).cast("long")
    inst = instances.join(F.broadcast(sized), "class_id", "left").select("id", "class_id", F.lit("instance").alias("kind"), n64.alias("len"), F.coalesce("shallow", F.lit(sizing.header).cast("long")).alias("shallow"), "place")
    objs = arrays.select("id", "class_id", F.lit("object_array").alias("kind"), F.size("elements").cast("long").alias("len"), sizing.array(F.size("elements").cast("long"), F.lit(sizing.reference)).alias("shallow"), "place")
    element = F.create_map(*[F.lit(x) for t, c in prim_class.items() for x in (t, c)])[F.col("type")]
    elem_width = F.create_map(*[F.lit(x) for t, w in TYPES.values() if w for x in (t, w)])[F.col("type")]
    prim = prims.select("id", element.cast("long").alias("class_id"), F.lit("primitive_array").alias("kind"), "len", sizing.array(F.col("len"), elem_width).alias("shallow"), "place")
    klass = class_of.get("java.lang.Class", -1)
    static_bytes = {c: sum(sizing.width(x["type"]) for x in r["statics"] or ()) for c, r in rows.items() if r["fields"] is not None}
    klasses = spark.createDataFrame([(c, klass, "class", 0, -(-(sizing.header + n) // 8) * 8, 1 << 62) for c, n in static_bytes.items()], "id long, class_id long, kind string, len long, shallow long, place long")
    objects = once(inst.union(objs).union(prim).union(klasses), "class_id", "kind", "len", "shallow").withColumnRenamed("id", "obj")
    refs = once(instances, "class_id", "data").mapInPandas(references, "src long, ord long, dst long, label string, ref_kind string")
    elements = once(arrays, "elements").select(F.col("id").alias("src"), F.posexplode_outer("elements").alias("ord", "dst")).where("dst != 0").select("src", F.col("ord").cast("long").alias("ord"), "dst", F.lit("[]").alias("label"), F.col("ord").cast("long").alias("elem"))
    statics = [(c, n, x["bits"], f"static {text.get(x['sym'], '?')}") for c, r in rows.items() for n, x in enumerate(r["statics"] or ()) if x["type"] == "ref" and x["bits"]]
    loader = [(c, 1 << 30, r["loader_id"], "<classloader>") for c, r in rows.items() if r["loader_id"]]
    fixed = spark.createDataFrame(statics + loader, "src long, ord long, dst long, label string")
    none = F.lit(None).cast("long").alias("elem")
    raw = refs.where("ref_kind is null").select("src", "ord", "dst", "label", none).union(elements).union(fixed.select("*", none))
    known = objects.select(F.col("obj").alias("dst"))
    edges = raw.join(known, "dst", "left_semi").select("src", "ord", "dst", "label", "elem")
    weak = refs.where("ref_kind is not null").join(known, "dst", "left_semi").select("src", "dst", "ref_kind")
    roots = read("roots").where("kind != 'unreachable'").join(known.withColumnRenamed("dst", "obj"), "obj", "left_semi")
    minted = [(c, f"{t}[]", None, 0) for t, c in prim_class.items() if c < 0]
    out = spark.createDataFrame([(c, r["name"], r["super_id"] or None, r["loader_id"] or 0) for c, r in rows.items()] + minted, "class_id long, name string, super_id long, loader_id long")
    return HeapTables(out, objects, edges, roots, weak)
