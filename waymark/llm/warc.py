"""WARC archives in Zstandard: one frame a record, the dictionary in a leading skippable frame.

Archives are made in workers and put down by Spark's own writer, a file each, so that a task run
again after a lost executor leaves nothing double. That writer ends a row with a line feed, which
the last bytes of an archive, the head of a one-byte skippable frame, take in.

A null ``html`` is an empty payload; a null ``url`` leaves out the target; a null ``page_id`` is kept
as null. Records with equal payloads of at least ``REVISIT_BYTES`` bytes: rows with the largest
``page_id`` are responses (repeated rows all of them), the others revisit it. Empty tables make no
archives and give no rows. Payloads may be as long as Arrow allows (2 GB). Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import batches, new_folder, small_batches, written

#: Fixed values of the formats.
DICT_MAGIC, SKIP_MAGIC, RAW_DICT_MAGIC = 0x184D2A5D, 0x184D2A50, 0xEC30A437
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads below this many bytes are always written.
REVISIT_BYTES = 1000
#: Uncompressed bytes of records in an archive; of what a dictionary is trained on; of a dictionary.
ARCHIVE_BYTES, SAMPLE_BYTES, DICT_BYTES, LEVEL = 24 << 20, 2 << 20, 32 << 10, 3
#: An archive's date: archives of the same pages are the same.
DATE = "2024-01-01T00:00:00Z"
#: A record may not claim more than that.
MOST_BYTES = 2**31 - 1


class WarcError(ValueError):
    """What is wrong with an archive or record."""


# -- records --------------------------------------------------------------------------------------


def _line(value: str) -> str:
    """A header's value on one line."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if ("\r" in value or "\n" in value) else value


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """One record's bytes. A revisit has the HTTP head alone, whose length names the full payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.decode("utf-8").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"bad header line {line[:60]!r}")
        if name.lower() in out:
            raise WarcError(f"header {name} twice")
        out[name.lower()] = value.strip()
    return out


def _number(value: str | None, what: str) -> int:
    if value is None or not value.isascii() or not value.isdigit():
        raise WarcError(f"no valid {what}: {value!r}")
    return int(value)


def _page(urn: str | None) -> int | None:
    if urn is None or not urn.startswith("<urn:page:") or not urn.endswith(">"):
        raise WarcError(f"bad record identifier {urn!r}")
    name = urn[10:-1]
    return None if name == "none" else int(name)


def parse(raw: bytes) -> dict:
    """A record's fields; headers, lengths and the response's digest are validated."""
    if not raw.startswith(b"WARC/1."):
        raise WarcError(f"no WARC record: {raw[:16]!r}")
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        raise WarcError("headers don't end")
    version_end = raw.index(b"\r\n")
    if raw[:version_end] not in (b"WARC/1.0", b"WARC/1.1") or version_end == end:
        raise WarcError(f"bad version line {raw[:version_end][:30]!r}")
    h = _headers(raw[version_end + 2 : end])
    if missing := [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if k not in h]:
        raise WarcError(f"headers missing: {missing}")
    n = _number(h["content-length"], "Content-Length")
    block = raw[end + 4 : end + 4 + n]
    if len(block) != n or raw[end + 4 + n :] != b"\r\n\r\n":
        raise WarcError(f"Content-Length is {n}; the record has {len(raw) - end - 8}")
    kind = h["warc-type"]
    if kind not in ("response", "revisit"):
        return {"page_id": None, "url": h.get("warc-target-uri"), "record_type": kind, "refers_to": None, "payload_digest": None, "payload_bytes": 0, "payload": block}
    cut = block.find(b"\r\n\r\n")
    if cut < 0 or not block.startswith(b"HTTP/"):
        raise WarcError("the block is no HTTP response")
    http = _headers(block[block.index(b"\r\n") + 2 : cut])
    payload, size = block[cut + 4 :], _number(http.get("content-length"), "HTTP Content-Length")
    digest = h.get("warc-payload-digest", "")
    if not digest.startswith("sha1:"):
        raise WarcError(f"no SHA-1 payload digest: {digest!r}")
    digest = digest[5:]
    if kind == "response":
        if len(payload) != size:
            raise WarcError(f"HTTP Content-Length is {size}; the payload has {len(payload)}")
        if hashlib.sha1(payload).hexdigest() != digest:
            raise WarcError("the payload's digest is another")
    elif payload or h.get("warc-profile") != PROFILE:
        raise WarcError("a revisit with a payload, or of no known profile")
    return {"page_id": _page(h["warc-record-id"]), "url": h.get("warc-target-uri"), "record_type": kind, "refers_to": _page(h.get("warc-refers-to")) if kind == "revisit" else None, "payload_digest": digest, "payload_bytes": size, "payload": payload}


# -- archives -------------------------------------------------------------------------------------


def _skippable(content: bytes, magic: int = SKIP_MAGIC) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


def archive(records: list[bytes], tail: bool = True) -> bytes:
    """Records as an archive, a frame each. The dictionary is trained on the first records; too few of them: none.

    With ``tail``, one byte that follows belongs to the archive.
    """
    import zstandard as zstd

    sample, n = [], 0
    for r in records:
        sample.append(r[: 64 << 10])
        n += len(sample[-1])
        if n >= SAMPLE_BYTES:
            break
    out, dictionary = [], None
    if len(sample) >= 16:
        try:
            dictionary = zstd.train_dictionary(DICT_BYTES, sample)
        except zstd.ZstdError:  # records too small or too alike to train on: archives without one are valid
            dictionary = None
    if dictionary:
        packed = zstd.ZstdCompressor(level=9).compress(dictionary.as_bytes())
        out.append(_skippable(packed, DICT_MAGIC))
    c = zstd.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=True, write_checksum=True)
    out += [c.compress(r) for r in records]
    if tail:
        out.append(struct.pack("<II", SKIP_MAGIC, 1))
    return b"".join(out)


def frames(data: bytes) -> Iterator[tuple[int, memoryview]]:
    """``magic, frame`` of each Zstandard or skippable frame, by walking block heads; nothing is unpacked."""
    import zstandard as zstd

    view, at, n = memoryview(data), 0, len(data)
    while at < n:
        if n - at < 8:
            raise WarcError("the archive ends within a frame")
        (magic,) = struct.unpack_from("<I", view, at)
        if DICT_MAGIC & 0xFFFFFFF0 == magic & 0xFFFFFFF0:
            (size,) = struct.unpack_from("<I", view, at + 4)
            end = at + 8 + size
        else:
            try:
                head = zstd.frame_header_size(view[at : at + 18])
                checksum = zstd.get_frame_parameters(view[at : at + 18]).has_checksum
            except zstd.ZstdError as e:
                raise WarcError(f"no frame at byte {at}: {e}") from e
            end, last = at + head, False
            while not last:
                if end + 3 > n:
                    raise WarcError("the archive ends within a frame")
                block = int.from_bytes(view[end : end + 3], "little")
                last, kind = bool(block & 1), block >> 1 & 3
                if kind == 3:
                    raise WarcError(f"bad block at byte {end}")
                end += 3 + (1 if kind == 1 else block >> 3)
            end += 4 * checksum
        if end > n:
            raise WarcError("the archive ends within a frame")
        yield magic, view[at:end]
        at = end


def read_archive(data: bytes) -> Iterator[dict]:
    """Every record of an archive, validated. What is wrong with a single record is told in its ``error``."""
    import zstandard as zstd

    plain, d = zstd.ZstdDecompressor(), zstd.ZstdDecompressor()
    for i, (magic, frame) in enumerate(frames(data)):
        if magic == DICT_MAGIC:
            if i:
                raise WarcError("a dictionary that doesn't lead the archive")
            raw = bytes(frame[8:])
            if struct.unpack_from("<I", raw.ljust(4, b"\0"))[0] != RAW_DICT_MAGIC:
                raw = plain.decompress(raw, max_output_size=64 << 20)
            d = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(raw))
        elif magic & 0xFFFFFFF0 != SKIP_MAGIC:
            try:
                size = zstd.frame_content_size(frame)
                if size > MOST_BYTES:
                    raise WarcError(f"a record claims {size} bytes")
                yield parse(d.decompress(frame, max_output_size=64 << 20 if size < 0 else 0)) | {"error": None}
            except (WarcError, zstd.ZstdError, ValueError) as e:
                yield dict.fromkeys(("page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload")) | {"error": str(e)[:300]}


# -- tables ---------------------------------------------------------------------------------------


def decided(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, digest, refers_to``: the last is the response's page for revisits, else null.

    Only payloads that occur again make rows of the lookup, one each, combined before the shuffle; it is
    written, so that Spark knows its size, sends it around where small, and else splits hot digests.
    """
    p = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    big = F.octet_length("html") >= REVISIT_BYTES
    again = p.where(big).groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1 and last is not null").select("digest", "last")
    again = written(again, "digests")
    return p.join(again, "digest", "left").select("page_id", "url", "html", "digest", F.when(big & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))


def _archive_batches(rows):
    import pyarrow as pa

    held, size = [], 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array([archive(held)], pa.binary())], names=["content"])

    for b in batches(rows):
        for i, u, html, digest, to in zip(*(c.to_pylist() for c in b.columns), strict=True):
            held.append(record(i, u, html.encode(), digest, to, to is not None))
            size += len(held[-1])
            if size >= ARCHIVE_BYTES:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def write_archives(pages: DataFrame, folder: str) -> None:
    """Archives of all pages in ``folder``, each of about ``ARCHIVE_BYTES`` unpacked."""
    small_batches(pages.sparkSession)
    made = decided(pages).mapInArrow(_archive_batches, "content binary")
    # the text writer puts a row's bytes down as they are, one row a file, with the line feed that the archive's tail takes
    made.select(F.col("content").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(folder)


def _read_batches(rows, payloads: bool):
    import pyarrow as pa

    kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_digest": pa.string(), "payload_bytes": pa.int64(), "error": pa.string()} | ({"payload": pa.binary()} if payloads else {})

    def out(got):
        return pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], t) for k, t in kinds.items()], names=list(kinds))

    for b in batches(rows):
        for content in b.column(0):
            got, size = [], 0
            for r in read_archive(content.as_py()):
                got.append(r)
                size += len(r["payload"] or b"") if payloads else 0
                if len(got) >= 1000 or size > 16 << 20:
                    yield out(got)
                    got, size = [], 0
            if got:
                yield out(got)


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """A row for each record of all archives of a folder; ``error`` is null where the record is valid."""
    files = spark.read.format("binaryFile").load(folder).where("length > 0").select("content")
    schema = "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, error string" + ", payload binary" * payloads
    return files.mapInArrow(partial(_read_batches, payloads=payloads), schema)


def round_trip(pages: DataFrame, payloads: bool = False) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back; an invalid record is an error."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    write_archives(pages, folder)
    got = read_archives(spark, folder, payloads)
    return got.where(F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("boolean")).otherwise(True)).drop("error")
