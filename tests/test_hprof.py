"""Dumps written here, record by record, and read back."""

import gzip
import io
import struct
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from heapsift.sources import hprof


class Writer:
    def __init__(self, id_size=8):
        self.i, self.out, self.heap = id_size, io.BytesIO(), io.BytesIO()
        self.out.write(b"JAVA PROFILE 1.0.2\0" + struct.pack(">IQ", id_size, 1_700_000_000_000))

    def id(self, x):
        return x.to_bytes(self.i, "big")

    def top(self, tag, body):
        self.out.write(struct.pack(">BII", tag, 0, len(body)) + body)

    def symbol(self, i, text):
        self.top(1, self.id(i) + text.encode())

    def load(self, serial, cls, sym):
        self.top(2, struct.pack(">I", serial) + self.id(cls) + struct.pack(">I", 0) + self.id(sym))

    def klass(self, cls, sup, statics=(), fields=()):
        h = self.heap
        h.write(b"\x20" + self.id(cls) + bytes(4) + self.id(sup) + self.id(0) * 5 + bytes(4) + struct.pack(">H", 0))
        h.write(struct.pack(">H", len(statics)) + b"".join(self.id(s) + bytes([2]) + self.id(v) for s, v in statics))
        h.write(struct.pack(">H", len(fields)) + b"".join(self.id(s) + bytes([t]) for s, t in fields))

    def instance(self, obj, cls, data):
        self.heap.write(b"\x21" + self.id(obj) + bytes(4) + self.id(cls) + struct.pack(">I", len(data)) + data)

    def objects(self, obj, cls, items):
        self.heap.write(b"\x22" + self.id(obj) + bytes(4) + struct.pack(">I", len(items)) + self.id(cls) + b"".join(map(self.id, items)))

    def bytes_(self, obj, data):
        self.heap.write(b"\x23" + self.id(obj) + bytes(4) + struct.pack(">IB", len(data), 8) + data)

    def root(self, obj, tag=0x05):
        self.heap.write(bytes([tag]) + self.id(obj) + {0x05: b"", 0x08: bytes(8), 0x03: struct.pack(">II", 1, 2)}[tag])

    def done(self, cut=0):
        self.top(0x1C, self.heap.getvalue())
        self.top(0x2C, b"")
        raw = self.out.getvalue()
        return raw[: len(raw) - cut] if cut else raw


def sample(id_size=8, cut=0):
    w = Writer(id_size)
    for i, text in enumerate(("java/lang/Object", "java/lang/Class", "demo/Node", "next", "value", "[Ljava/lang/Object;", "java/lang/ref/Reference", "referent", "java/lang/ref/WeakReference", "held"), 1):
        w.symbol(i, text)
    for n, (cls, sym) in enumerate(((100, 1), (101, 2), (102, 3), (103, 6), (104, 7), (105, 9)), 1):
        w.load(n, cls, sym)
    w.klass(100, 0)
    w.klass(101, 100)
    w.klass(102, 100, statics=[(10, 200)], fields=[(4, 2), (5, 10)])
    w.klass(104, 100, fields=[(8, 2)])
    w.klass(105, 104)
    w.root(102)
    w.root(206, 0x03)
    w.instance(200, 102, w.id(201) + struct.pack(">i", 7))
    w.instance(201, 102, w.id(0) + struct.pack(">i", -1))
    w.instance(201, 102, w.id(200) + struct.pack(">i", 5))  # a second record of the id doesn't count
    w.objects(206, 103, [200, 0, 207, 999])
    w.instance(207, 105, w.id(208))
    w.bytes_(208, b"hello")
    return w.done(cut)


@pytest.mark.parametrize("id_size", [4, 8])
def test_tables(spark, tmp_path, id_size):
    path = tmp_path / "d.hprof"
    path.write_bytes(sample(id_size))
    h = hprof.heap(spark, str(path), sizes="mat")
    named = {r["name"]: r["n"] for r in h.objects.join(h.classes, "class_id").groupBy("name").agg(F.count("*").alias("n")).collect()}
    assert named["demo.Node"] == 2 and named["java.lang.Class"] == 5 and named["java.lang.Object[]"] == 1 and named["byte[]"] == 1
    assert sorted((r["src"], r["dst"], r["label"]) for r in h.edges.collect()) == [(102, 200, "static held"), (200, 201, "next"), (206, 200, "[]"), (206, 207, "[]")]
    assert [tuple(r) for r in h.weak_edges.collect()] == [(207, 208, "weak")]
    assert sorted(r["obj"] for r in h.roots.collect()) == [102, 206]
    assert h.objects.where("obj = 200").first()["shallow"] == (16 if id_size == 4 else 32)


def pack(kind, raw):
    out = io.BytesIO()
    if kind == "gz":
        return gzip.compress(raw[:60]) + gzip.compress(raw[60:])
    if kind.startswith("tar"):
        with tarfile.open(fileobj=out, mode="w:gz" if kind == "tar.gz" else "w") as t:
            for name, data in (("readme", b"x" * 700), ("dump", raw)):
                info = tarfile.TarInfo(name)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
        return out.getvalue()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED if kind == "zip" else zipfile.ZIP_STORED) as z:
        z.writestr("readme", "x")
        z.writestr("dump", raw)
    return out.getvalue()


@pytest.mark.parametrize("kind", ["gz", "tar", "tar.gz", "zip", "stored.zip"])
def test_containers(spark, tmp_path, kind):
    path = tmp_path / "dump.bin"
    path.write_bytes(pack(kind, sample()))
    assert hprof.table(spark, str(path), "instances").count() == 4
    assert hprof.table(spark, str(path), "symbols").count() == 10


def test_pieces_and_missing_end(spark, tmp_path):
    path = tmp_path / "d.hprof"
    path.write_bytes(sample(cut=20))
    small = hprof.table(spark, str(path), "instances", chunk=64)
    assert small.rdd.getNumPartitions() > 1 and small.count() == 4
    assert hprof.table(spark, str(path), "meta").first()["truncated"]
    path.write_bytes(b"something else")
    with pytest.raises(Exception, match="not a heap dump"):
        hprof.table(spark, str(path), "meta").collect()


def test_cut_gzip(spark, tmp_path):
    """A packed dump that is cut gives the records before the cut."""
    raw = sample()
    (tmp_path / "cut.gz").write_bytes(gzip.compress(raw, mtime=0)[:-12])
    (tmp_path / "all.gz").write_bytes(gzip.compress(raw, mtime=0))
    cut, all_ = (hprof.table(spark, str(tmp_path / f), "symbols").collect() for f in ("cut.gz", "all.gz"))
    assert cut == all_[: len(cut)] and len(cut) > 0
