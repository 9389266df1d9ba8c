"""Avro container files from Python: seek to the blocks that hold given rows, and decode those alone.

Where Spark has no reader of its own for these files (a Hive SerDe scans them), point reads come from
here: block heads are walked without decoding, so a row costs one block and not its file.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable
from decimal import Decimal

#: Fixed values of the format.
MAGIC, SYNC = b"Obj\x01", 16
#: Bytes that hold a block's head: two numbers of at most ten bytes.
HEAD = 20
#: The change of calendars on 15 October 1582, and a day, in milliseconds.
CHANGE_MS, DAY_MS = -12_219_292_800_000, 86_400_000
#: Types without further structure, and Arrow's names of them.
PLAIN = {"null": "null", "boolean": "bool", "int": "int32", "long": "int64", "float": "float", "double": "double", "bytes": "binary", "string": "string"}


class AvroError(ValueError):
    """What is wrong with a file, or beyond this reader."""


def same_label(ms: int) -> int:
    """An instant as the SerDe's scan has it, in UTC: before the calendar's change its date is read off the Julian
    calendar, and that label taken for the proleptic Gregorian one."""
    if ms >= CHANGE_MS:
        return ms
    days = ms // DAY_MS
    n = days + 2440588 + 32082  # days since 1 March 4801 BC in the Julian calendar
    year = (4 * n + 3) // 1461
    left = n - 1461 * year // 4
    month = (5 * left + 2) // 153
    day, year = left - (153 * month + 2) // 5, year - 4800
    # both calendars count years from March here, so a 29 February that the Gregorian one lacks is 1 March
    gregorian = 365 * year + year // 4 - year // 100 + year // 400 + (153 * month + 2) // 5 + day - 719468
    return ms + (gregorian - days) * DAY_MS


class Cursor:
    """Bytes and a place in them."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise AvroError("the data end within a value")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self) -> int:
        """A zig-zag number of seven bits a byte, lowest first."""
        n = shift = 0
        while True:
            if self.at >= len(self.data) or shift > 63:
                raise AvroError("a number doesn't end")
            b = self.data[self.at]
            self.at += 1
            n |= (b & 127) << shift
            if b < 128:
                return (n >> 1) ^ -(n & 1)
            shift += 7

    def sized(self) -> bytes:
        return self.take(self.number())

    def items(self, one: Callable) -> list:
        """An array's items; its blocks may tell their sizes."""
        out = []
        while n := self.number():
            if n < 0:
                n = -n
                self.number()
            out += [one(self) for _ in range(n)]
        return out


def _decoder(schema, names: dict) -> tuple[Callable, object]:
    """A function from a cursor to a value, and the Arrow type of its values."""
    import pyarrow as pa

    if isinstance(schema, list):
        kinds = [_decoder(s, names) for s in schema]
        rest = [t for _, t in kinds if t != pa.null()]
        if len(set(rest)) > 1:
            raise AvroError(f"a union of several types: {schema}")
        ways = [f for f, _ in kinds]

        def union(c):
            i = c.number()
            if not 0 <= i < len(ways):
                raise AvroError(f"no branch {i} in {schema}")
            return ways[i](c)

        return union, rest[0] if rest else pa.null()
    if isinstance(schema, str):
        if schema in PLAIN:
            return _plain(schema), pa.type_for_alias(PLAIN[schema])
        if schema not in names:
            raise AvroError(f"unknown or recursive type {schema!r}")
        return names[schema]
    kind, logical = schema["type"], schema.get("logicalType")
    if logical == "decimal" and kind in ("bytes", "fixed"):
        raw, scale = _decoder({k: v for k, v in schema.items() if k != "logicalType"}, names)[0], schema.get("scale", 0)
        return (lambda c: Decimal(int.from_bytes(raw(c), "big", signed=True)).scaleb(-scale)), pa.decimal128(schema["precision"], scale)
    if logical == "date" and kind == "int":
        return _plain("int"), pa.date32()
    if logical == "timestamp-millis" and kind == "long":
        return (lambda c: same_label(c.number())), pa.timestamp("ms", "UTC")
    if logical and logical.startswith(("time", "local-time")):
        raise AvroError(f"times are left to the scan: {logical}")
    if kind == "array":
        one, t = _decoder(schema["items"], names)
        return (lambda c: c.items(one)), pa.list_(t)
    if kind == "map":
        one, t = _decoder(schema["values"], names)
        return (lambda c: c.items(lambda c: (c.sized().decode(), one(c)))), pa.map_(pa.string(), t)
    if kind not in ("record", "enum", "fixed"):
        return _decoder(kind, names)
    if kind == "enum":
        symbols = schema["symbols"]
        made = (lambda c: symbols[c.number()]), pa.string()
    elif kind == "fixed":
        size = schema["size"]
        made = (lambda c: c.take(size)), pa.binary()
    else:
        fields = [(f["name"], *_decoder(f["type"], names)) for f in schema["fields"]]
        made = (lambda c: {n: f(c) for n, f, _ in fields}), pa.struct([(n, t) for n, _, t in fields])
    names[schema["name"]] = made
    if schema.get("namespace"):
        names[f"{schema['namespace']}.{schema['name']}"] = made
    return made


def _plain(name: str) -> Callable:
    return {
        "null": lambda c: None, "boolean": lambda c: c.take(1) == b"\x01", "int": Cursor.number, "long": Cursor.number, "bytes": Cursor.sized, "string": lambda c: c.sized().decode(),
        "float": lambda c: struct.unpack("<f", c.take(4))[0], "double": lambda c: struct.unpack("<d", c.take(8))[0],
    }[name]


def _unpacked(data: bytes, codec: str) -> bytes:
    if codec == "null":
        return data
    if codec == "deflate":
        return zlib.decompress(data, -15)
    if codec == "zstandard":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    if codec == "bzip2":
        import bz2

        return bz2.decompress(data)
    if codec == "snappy":
        import pyarrow as pa

        size = shift = 0  # the raw form begins with its size, a check sum follows it
        for b in data:
            size |= (b & 127) << shift
            shift += 7
            if b < 128:
                break
        return pa.Codec("snappy").decompress(data[:-4], size, asbytes=True)
    raise AvroError(f"unknown codec {codec!r}")


class AvroFile:
    """A container file: ``counts`` of rows by block, and each block as a table of the wanted columns.

    Column names are matched without regard to case, as catalogs keep them in lower case. Columns that
    the file lacks are null.
    """

    def __init__(self, handle, columns: list[str]):
        self.handle, self.columns = handle, columns
        self.size = handle.size()
        self._header()
        self.counts, self.blocks, at = [], [], self.first
        while at < self.size:
            c = Cursor(self._at(at, HEAD))
            rows, n = c.number(), c.number()
            if rows < 0 or n < 0 or at + c.at + n + SYNC > self.size:
                raise AvroError(f"bad block at byte {at}")
            self.counts.append(rows)
            self.blocks.append((at + c.at, n))
            at += c.at + n + SYNC

    def _at(self, at: int, n: int) -> bytes:
        self.handle.seek(at)
        return self.handle.read(min(n, self.size - at))

    def _header(self) -> None:
        n = 1 << 16
        while True:  # until the header is whole
            c = Cursor(self._at(0, n))
            try:
                if c.take(len(MAGIC)) != MAGIC:
                    raise AvroError("no Avro container file")
                meta = dict(c.items(lambda c: (c.sized().decode(), c.sized())))
                self.sync, self.first = c.take(SYNC), c.at
                break
            except AvroError:
                if n >= self.size or not c.data.startswith(MAGIC):
                    raise
                n *= 4
        self.codec = meta.get("avro.codec", b"null").decode()
        schema = json.loads(meta["avro.schema"])
        if not isinstance(schema, dict) or schema.get("type") != "record":
            raise AvroError("the file's rows are no records")
        names: dict = {}
        self.fields = [(f["name"].lower(), *_decoder(f["type"], names)) for f in schema["fields"]]

    def table(self, i: int):
        import pyarrow as pa

        at, n = self.blocks[i]
        raw = self._at(at, n + SYNC)
        if raw[n:] != self.sync:
            raise AvroError(f"no mark after the block at byte {at}")
        c = Cursor(_unpacked(raw[:n], self.codec))
        kept = {name: [] for name in map(str.lower, self.columns)}
        for _ in range(self.counts[i]):
            for name, one, _ in self.fields:
                v = one(c)
                if name in kept:
                    kept[name].append(v)
        types = {name: t for name, _, t in self.fields}
        return pa.table([pa.array(kept[x.lower()], types[x.lower()]) if x.lower() in types else pa.nulls(self.counts[i]) for x in self.columns], names=self.columns)
