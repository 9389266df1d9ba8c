"""SequenceFiles from Python: seek to the records that hold given rows, and decode their delimited text.

Rows are what Hive's simple SerDe writes: columns by position, one separator a level of nesting, ``\\N``
for null. A block-compressed file's heads are walked without decoding; other files' records tell their
lengths, so they are walked too, and counted in groups.
"""

from __future__ import annotations

import datetime
import re
import struct
import zlib
from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import types as T

#: Fixed values of the format.
MAGIC, SYNC, ESCAPE = b"SEQ", 16, -1
#: Fixed values of the SerDe: its class, what a null is, and separators by level where a table names none.
SERDE, NULL = "org.apache.hadoop.hive.serde2.lazy.LazySimpleSerDe", b"\\N"
LEVELS = 8
#: Value classes that hold a row's text.
TEXT, BYTES = "org.apache.hadoop.io.Text", "org.apache.hadoop.io.BytesWritable"
#: Rows, and bytes, after which a group of records ends, where the file has no blocks.
GROUP_ROWS, GROUP_BYTES = 10_000, 8 << 20
#: Bytes read at once while records are walked.
AHEAD = 1 << 20
_INT = re.compile(rb"([+-]?)([0-9]*)(\.[0-9]*)?")
_PLAIN = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?")
_REAL = re.compile(rf"[+-]?(NaN|Infinity)|({_PLAIN.pattern})[fFdD]?")
_DATE = re.compile(rb"([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})")


class SequenceError(ValueError):
    """What is wrong with a file, or beyond this reader."""


# -- text to values -------------------------------------------------------------------------------


def _integer(bits: int) -> Callable:
    most = 1 << (bits - 1)

    def one(b):
        m = _INT.fullmatch(b)
        n = int(m[1] + (m[2] or b"0")) if m and (m[2] or m[3] not in (None, b".")) else None
        return n if n is not None and -most <= n < most else None

    return one


def _real(b: bytes) -> float | None:
    s = b.decode("utf-8", "replace").strip()
    return float(s.rstrip("fFdD") if s[-1:] in "fFdD" else s) if _REAL.fullmatch(s) else None


def _date(b: bytes) -> datetime.date | None:
    m = _DATE.fullmatch(b.strip())
    if not m or not (1 <= int(m[2]) <= 12 and 1 <= int(m[3]) <= 31) or not int(m[1]):
        return None
    try:
        return datetime.date(int(m[1]), int(m[2]), 1) + datetime.timedelta(int(m[3]) - 1)
    except OverflowError:  # the last day of the calendar's last year
        return None


def _decimal(precision: int, scale: int) -> Callable:
    def one(b):
        s = b.decode("utf-8", "replace")
        if not _PLAIN.fullmatch(s):
            return None
        d = Decimal(s)
        if d and d.adjusted() >= precision - scale:
            return None
        q = Decimal((d.scaleb(scale)).to_integral_value(ROUND_HALF_UP)).scaleb(-scale)
        return q if not q or q.adjusted() < precision - scale else None

    return one


def reader_of(kind: T.DataType, seps: list[bytes], level: int = 1) -> Callable | None:
    """A function from a value's bytes to the value, or None where the scan alone knows how to read the type."""
    plain = {
        T.StringType: lambda b: b.decode("utf-8", "replace"), T.ByteType: _integer(8), T.ShortType: _integer(16), T.IntegerType: _integer(32), T.LongType: _integer(64),
        T.FloatType: _real, T.DoubleType: _real, T.DateType: _date, T.BooleanType: lambda b: {b"true": True, b"false": False}.get(b.lower()),
    }
    if type(kind) in plain:
        return plain[type(kind)]
    if isinstance(kind, T.DecimalType):
        return _decimal(kind.precision, kind.scale)
    inner = {T.ArrayType: 1, T.StructType: 1, T.MapType: 2}.get(type(kind))
    if inner is None or level + inner > len(seps):
        return None
    sep = seps[level]
    if isinstance(kind, T.ArrayType):
        one = reader_of(kind.elementType, seps, level + 1)
        return one and (lambda b: [None if x == NULL else one(x) for x in b.split(sep)] if b else [])
    if isinstance(kind, T.StructType):
        ways = [(f.name, reader_of(f.dataType, seps, level + 1)) for f in kind]
        return None if any(w is None for _, w in ways) else (lambda b: _row(b, sep, ways))
    key, value, to = reader_of(kind.keyType, seps, level + 2), reader_of(kind.valueType, seps, level + 2), seps[level + 1]

    def entries(b):
        out = {}
        for entry in b.split(sep) if b else []:
            k, there, v = entry.partition(to)
            if k != NULL and (name := key(k)) is not None:
                out.setdefault(name, value(v) if there and v != NULL else None)
        return list(out.items())

    return entries if key and value else None


def _row(b: bytes, sep: bytes, ways: list[tuple[str, Callable]]) -> dict:
    """A record by position: columns that the text lacks are null, what goes beyond the last is left."""
    parts = b.split(sep)
    return {name: None if i >= len(parts) or parts[i] == NULL else one(parts[i]) for i, (name, one) in enumerate(ways)}


def separators(props: dict[str, str]) -> list[bytes] | None:
    """Separators of each level from a table's SerDe properties, or None where those ask for more than separators."""
    known = {"serialization.format", "field.delim", "collection.delim", "mapkey.delim", "line.delim"}
    if set(props) - known:
        return None
    told = [props.get("field.delim", props.get("serialization.format")), props.get("collection.delim"), props.get("mapkey.delim")]
    out = []
    for level in range(LEVELS):
        x = told[level] if level < len(told) else None
        b = bytes([level + 1]) if not x else bytes([int(x)]) if x.isdigit() and int(x) < 128 else x.encode()
        if len(b) != 1:
            return None
        out.append(b)
    return out


# -- the container --------------------------------------------------------------------------------


def _unpacked(data: bytes, codec: str | None) -> bytes:
    kind = (codec or "").rpartition(".")[2]
    if not kind:
        return data
    if kind in ("DefaultCodec", "DeflateCodec"):
        return zlib.decompress(data)
    if kind == "GzipCodec":
        return zlib.decompress(data, 31)
    if kind == "BZip2Codec":
        import bz2

        return bz2.decompress(data)
    if kind == "ZStandardCodec":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    if kind in ("SnappyCodec", "Lz4Codec"):
        return _chunks(data, "snappy" if kind == "SnappyCodec" else "lz4_raw")
    raise SequenceError(f"unknown codec {codec!r}")


def _chunks(data: bytes, name: str) -> bytes:
    """Hadoop's frames of raw codecs: the size of a piece, then its packed chunks, each behind its own size."""
    import pyarrow as pa

    out, at = [], 0
    while at < len(data):
        (left,) = struct.unpack_from(">I", data, at)
        at += 4
        while left:
            (n,) = struct.unpack_from(">I", data, at)
            packed = data[at + 4 : at + 4 + n]
            size = left
            if name == "snappy":  # a chunk tells its own size, and may be a part of the piece
                size = shift = 0
                for b in packed:
                    size |= (b & 127) << shift
                    shift += 7
                    if b < 128:
                        break
            out.append(pa.Codec(name).decompress(packed, size, asbytes=True))
            at, left = at + 4 + n, left - size
    return b"".join(out)


class _Bytes:
    """A file's bytes from any place on, read ahead."""

    def __init__(self, handle, ahead: int = AHEAD):
        self.handle, self.size, self.ahead = handle, handle.size(), ahead
        self.at, self.base, self.held = 0, 0, b""

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > self.size:
            raise SequenceError(f"the file ends within what begins at byte {self.at}")
        if not self.base <= self.at or self.at + n > self.base + len(self.held):
            self.handle.seek(self.at)
            self.base, self.held = self.at, self.handle.read(min(max(n, self.ahead), self.size - self.at))
        a = self.at - self.base
        self.at += n
        return self.held[a : a + n]

    def skip(self, n: int) -> None:
        if n < 0 or self.at + n > self.size:
            raise SequenceError(f"the file ends within what begins at byte {self.at}")
        self.at += n

    def int32(self) -> int:
        return struct.unpack(">i", self.take(4))[0]

    def vint(self) -> int:
        """A number whose first byte is the value itself, or tells sign and length of what follows."""
        (b,) = struct.unpack("b", self.take(1))
        if b >= -112:
            return b
        n = int.from_bytes(self.take(-112 - b if b >= -120 else -120 - b), "big")
        return n if b >= -120 else ~n

    def text(self) -> str:
        return self.take(self.vint()).decode()


class _Held(_Bytes):
    """The same over bytes in memory."""

    def __init__(self, data: bytes):
        self.size, self.ahead, self.at, self.base, self.held = len(data), 0, 0, 0, data


class SequenceFile:
    """``counts`` of rows by group, and each group as a table of the wanted columns of a row's ``schema``."""

    def __init__(self, handle, schema: T.StructType, seps: list[bytes], columns: list[str]):
        from pyspark.sql.pandas.types import to_arrow_schema

        f = self.file = _Bytes(handle)
        if f.take(3) != MAGIC or f.take(1) != b"\x06":
            raise SequenceError("no SequenceFile of version 6")
        f.text()
        self.value = f.text()
        if self.value not in (TEXT, BYTES):
            raise SequenceError(f"values of class {self.value}")
        packed, self.blocked = f.take(1) != b"\0", f.take(1) != b"\0"
        self.codec = f.text() if packed else None
        for _ in range(2 * f.int32()):
            f.text()
        self.sync = f.take(SYNC)
        self.sep, at = seps[0], {n.lower(): i for i, n in enumerate(schema.names)}
        self.places = [at[c.lower()] for c in columns]
        self.ways = [reader_of(schema[i].dataType, seps) for i in self.places]
        if None in self.ways:
            raise SequenceError(f"types that are left to the scan: {schema.simpleString()}")
        wanted = to_arrow_schema(T.StructType([schema[i] for i in self.places]))
        self.columns, self.types = columns, [x.type for x in wanted]
        self.counts, self.groups = [], []
        if self.blocked:
            f.ahead = 64  # heads stand far apart
            self._walk_blocks()
        else:
            self._walk_records()

    def _mark(self, f: _Bytes) -> None:
        if f.take(SYNC) != self.sync:
            raise SequenceError(f"no mark at byte {f.at - SYNC}")

    def _walk_blocks(self) -> None:
        f = self.file
        while f.at < f.size:
            if f.int32() != ESCAPE:
                raise SequenceError(f"no block at byte {f.at - 4}")
            self._mark(f)
            rows = f.vint()
            for _ in range(2):
                f.skip(f.vint())
            at = f.at
            for _ in range(2):
                f.skip(f.vint())
            self.counts.append(rows)
            self.groups.append((at, f.at - at))

    def _walk_records(self) -> None:
        f, rows, start = self.file, 0, self.file.at
        while f.at < f.size:
            n = f.int32()
            if n == ESCAPE:
                self._mark(f)
                continue
            f.int32()
            f.skip(n)
            rows += 1
            if rows >= GROUP_ROWS or f.at - start >= GROUP_BYTES:
                self.counts.append(rows)
                self.groups.append((start, f.at - start))
                rows, start = 0, f.at
        if rows:
            self.counts.append(rows)
            self.groups.append((start, f.at - start))

    def _values(self, data: bytes):
        """The serialised values of a group, in order."""
        f = _Held(data)
        if self.blocked:
            lengths, values = (_Held(_unpacked(f.take(f.vint()), self.codec)) for _ in range(2))
            while lengths.at < lengths.size:
                yield values.take(lengths.vint())
            return
        while f.at < f.size:
            n = f.int32()
            if n == ESCAPE:
                f.skip(SYNC)
                continue
            key = f.int32()
            f.skip(key)
            yield _unpacked(f.take(n - key), self.codec)

    def table(self, i: int):
        import pyarrow as pa

        at, n = self.groups[i]
        self.file.at = at
        out = [[] for _ in self.places]
        for raw in self._values(self.file.take(n)):
            f = _Held(raw)
            parts = f.take(f.vint() if self.value == TEXT else f.int32()).split(self.sep)
            for col, place, one in zip(out, self.places, self.ways, strict=True):
                col.append(None if place >= len(parts) or parts[place] == NULL else one(parts[place]))
        if any(len(c) != self.counts[i] for c in out):
            raise SequenceError(f"{len(out[0])} values in a group of {self.counts[i]} at byte {at}")
        return pa.table([pa.array(c, t) for c, t in zip(out, self.types, strict=True)], names=self.columns)
