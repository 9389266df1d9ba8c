"""Container formats: Hive's SerDes in a session of their own, Avro files by hand, numbering over byte ranges."""

import io
import json
import os
import struct
import subprocess
import sys
import zlib

import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from waymark import TableIndexer
from waymark.sources import indexer
from waymark.sources import sequence as seq
from waymark.sources.avro import AvroError, AvroFile
from waymark.sources.sequence import BYTES, TEXT, SequenceError, SequenceFile, separators
from waymark.spec import FILE, OFFSET

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_hive_formats(tmp_path):
    env = os.environ | {"PYTHONPATH": ROOT}
    got = subprocess.run([sys.executable, f"{ROOT}/tests/hive_job.py", str(tmp_path), "avro", "sequencefile", "sequencefile/NONE", "sequencefile/BLOCK/Snappy", "sequencefile/BLOCK/Gzip", "textfile", "orc"], env=env, capture_output=True, text=True, timeout=600, check=False)
    assert got.returncode == 0, got.stderr[-3000:]


@pytest.mark.parametrize("sent", [0, indexer.SENT_RANGES])
def test_numbering_over_ranges(spark, tmp_path, monkeypatch, sent):
    """Files cut into many byte ranges, and many files in one partition, are numbered by line all the same."""
    monkeypatch.setattr(indexer, "SENT_RANGES", sent)
    want = set()
    for k, n in (("big", 20_000), ("a", 3), ("b", 1), ("c", 500)):
        (tmp_path / k).write_text("".join(f"{k} {i}\n" for i in range(n)))
        want |= {(f"{k} {i}", k, i) for i in range(n)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    try:
        one = TableIndexer.text(spark, str(tmp_path))
        index = one.create_index_df(["value"])
        assert one.data.rdd.getNumPartitions() > 8
        got = index.select("value", F.element_at(F.split(FILE, "/"), -1).alias("f"), OFFSET).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
        few = one.load_by_index(index.where("value in ('big 19999', 'c 0')"))
        assert sorted(r["value"] for r in few.collect()) == ["big 19999", "c 0"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


# -- Avro by hand ---------------------------------------------------------------------------------


def number(n):
    n, out = (n << 1) ^ (n >> 63), b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def sized(b):
    return number(len(b)) + b


def container(schema, blocks, codec="null", sync=b"s" * 16, extra=b""):
    pack = {"null": lambda b: b, "deflate": lambda b: zlib.compress(b)[2:-4], "zstandard": zstandard.compress, "snappy": lambda b: pa.Codec("snappy").compress(b, asbytes=True) + b"\0" * 4}[codec]
    meta = {"avro.schema": json.dumps(schema).encode(), "avro.codec": codec.encode(), "note": extra}
    head = b"Obj\x01" + number(len(meta)) + b"".join(sized(k.encode()) + sized(v) for k, v in meta.items()) + number(0) + sync
    return head + b"".join(number(len(b)) + sized(pack(b"".join(b))) + sync for b in blocks)


SCHEMA = {"type": "record", "name": "r", "fields": [
    {"name": "K", "type": "long"}, {"name": "t", "type": ["null", "string"]}, {"name": "l", "type": {"type": "array", "items": "int"}}, {"name": "m", "type": {"type": "map", "values": "double"}},
    {"name": "e", "type": {"type": "enum", "name": "kind", "symbols": ["x", "y"]}}, {"name": "e2", "type": "kind"}, {"name": "x", "type": {"type": "fixed", "name": "two", "size": 2}},
    {"name": "d", "type": {"type": "bytes", "logicalType": "decimal", "precision": 6, "scale": 2}}, {"name": "s", "type": {"type": "record", "name": "in", "fields": [{"name": "b", "type": "boolean"}]}},
]}


def row(k, text):
    # the array comes in a block that tells its size
    return number(k) + (number(0) if text is None else number(1) + sized(text.encode())) + number(-2) + number(2) + number(1) + number(-1) + number(0) + number(1) + sized(b"a") + struct.pack("<d", 0.5) + number(0) + number(1) + number(0) + b"zz" + sized(b"\xff\x38") + b"\x01"


def opened(raw, columns):
    return AvroFile(pa.PythonFile(io.BytesIO(raw), mode="r"), columns)


@pytest.mark.parametrize("codec", ["null", "deflate", "zstandard", "snappy"])
def test_avro_file(codec):
    raw = container(SCHEMA, [[row(-5, "é"), row(2**62, None)], [], [row(7, "x" * 1000)]], codec, extra=b"n" * 200_000)
    f = opened(raw, ["k", "t", "none", "l", "m", "e", "e2", "x", "d", "s"])
    assert f.counts == [2, 0, 1]
    a, b = f.table(0).to_pylist()
    assert (a["k"], a["t"], b["k"], b["t"]) == (-5, "é", 2**62, None) and a["none"] is None
    assert a["l"] == [1, -1] and a["m"] == [("a", 0.5)] and (a["e"], a["e2"]) == ("y", "x") and a["x"] == b"zz" and str(a["d"]) == "-2.00" and a["s"] == {"b": True}
    assert f.table(1).num_rows == 0 and f.table(2).to_pylist()[0]["t"] == "x" * 1000
    assert opened(raw, ["T"]).table(0).column_names == ["T"]
    for cut in (3, 40, len(raw) - 1, len(raw) - 20):
        with pytest.raises(AvroError):
            opened(raw[:cut], ["k"])
    with pytest.raises(AvroError):
        opened(raw[:-1] + b"t", ["k"]).table(2)


def test_avro_limits():
    for bad in (["int", "string"], {"type": "long", "logicalType": "timestamp-micros"}, "unknown"):
        with pytest.raises(AvroError):
            opened(container({"type": "record", "name": "r", "fields": [{"name": "a", "type": bad}]}, []), ["a"])
    with pytest.raises(AvroError):
        opened(container("long", []), ["a"])
    assert opened(container(SCHEMA, []), ["k"]).counts == []


# -- SequenceFiles by hand ------------------------------------------------------------------------


def text(b):
    assert len(b) < 128
    return bytes([len(b)]) if len(b) <= 112 else b"\x8f" + bytes([len(b)])


def sequence(rows, value=TEXT, sync=b"s" * 16, every=2):
    """Records without compression, with a mark after every two."""
    names = b"".join(text(n.encode()) + n.encode() for n in (BYTES, value))
    out = b"SEQ\x06" + names + b"\0\0" + struct.pack(">i", 1) + text(b"k") + b"k" + text(b"v") + b"v" + sync
    for i, r in enumerate(rows):
        body = b"\0" * 4 + (text(r) if value == TEXT else struct.pack(">i", len(r))) + r
        out += struct.pack(">ii", len(body), 4) + body + (struct.pack(">i", -1) + sync if i % every == 1 else b"")
    return out


def sought(raw, columns, kinds="a int, b string, m map<string,array<int>>"):
    return SequenceFile(pa.PythonFile(io.BytesIO(raw), mode="r"), StructType.fromDDL(kinds), separators({"serialization.format": "1"}), columns)


@pytest.mark.parametrize("value", [TEXT, BYTES])
def test_sequence_file(spark, monkeypatch, value):
    monkeypatch.setattr(seq, "GROUP_ROWS", 2)
    monkeypatch.setattr(seq, "AHEAD", 64)
    raw = sequence([b"1\x01x\x01k\x031\x042", b"", b"\\N\x01" + b"y" * 100, b"4", b"5\x01z\x01\x01more"], value)
    f = sought(raw, ["b", "A", "m"])
    assert f.counts == [2, 2, 1]
    assert [r for i in (2, 0, 1) for r in f.table(i).to_pylist()] == [
        {"b": "z", "A": 5, "m": []}, {"b": "x", "A": 1, "m": [("k", [1, 2])]}, {"b": None, "A": None, "m": None}, {"b": "y" * 100, "A": None, "m": None}, {"b": None, "A": 4, "m": None},
    ]
    assert sought(sequence([], value), ["a"]).counts == []
    for cut in (2, 30, len(raw) - 1, len(raw) - 3):
        with pytest.raises(SequenceError):
            sought(raw[:cut], ["a"])
    bad = raw.replace(b"\xff\xff\xff\xff" + b"s" * 16, b"\xff\xff\xff\xff" + b"t" * 16)
    with pytest.raises(SequenceError):
        sought(bad, ["a"])


def test_sequence_limits(spark):
    with pytest.raises(SequenceError):
        sought(sequence([b"1"], "org.apache.hadoop.io.LongWritable"), ["a"])
    with pytest.raises(SequenceError):
        sought(sequence([b"1"]), ["t"], "t timestamp")
    assert separators({"escape.delim": "x"}) is None and separators({"field.delim": "ab"}) is None
    assert separators({"field.delim": ",", "collection.delim": "58"})[:3] == [b",", b":", b"\x03"]
    deep = "array<" * 9 + "int" + ">" * 9
    assert seq.reader_of(StructType.fromDDL(f"a {deep}")[0].dataType, separators({})) is None
