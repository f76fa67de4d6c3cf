"""WARC archives in Zstandard, one frame per record, with a dictionary in front.

An archive file starts with a skippable frame that holds the dictionary; each further
frame is one whole WARC/1.1 record, so a reader decodes record by record and never more
than one at a time. Equal payloads are stored once: the row with the smallest id is a
``response``, the others are ``revisit`` records that name it.

Executors write the files through Arrow's file systems into the folder that the caller
names (by default below ``spark.checkpoint.dir``). A file is written under a name of
its own attempt and counts only if the finished task lists it in the manifest, so lost
or repeated tasks leave nothing that is read. The reader checks the magic numbers, the
version line, header syntax, required headers, lengths and digests, and raises
``ArchiveError`` at the first fault.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import BinaryIO

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import hashed_sample
from pageloom.session import materialize, scratch_path

# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MIN_PAYLOAD = 0
DICTIONARY_BYTES = 64 << 10
DICTIONARY_ROWS = 400
SAMPLE_CHARS = 20_000
LEVEL = 3
FILE_BYTES = 256 << 20
CHUNK = 1 << 20
# A header block beyond this is taken for damage.
MAX_HEADER = 1 << 16


class ArchiveError(ValueError):
    """An archive does not hold what its format demands."""


def digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def train_dictionary(samples: list[bytes]) -> bytes:
    """A Zstandard dictionary, or nothing if there is too little to learn from."""
    samples = [s for s in samples if len(s) >= 8]
    if len(samples) < 8 or sum(map(len, samples)) < 10 * 1024:
        return b""
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def record(
    record_id: str, target: str, kind: str, payload: bytes, refers_to: str | None, date: str
) -> bytes:
    """One WARC record. The block of a revisit is empty; its payload digest is that of
    the full payload."""
    block = payload if kind == "response" else b""
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:record:{record_id}>"),
        ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", "", target)),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("Content-Type", "text/html; charset=utf-8"),
    ]
    if refers_to is not None:
        headers += [
            ("WARC-Refers-To", f"<urn:record:{refers_to}>"),
            ("WARC-Profile", REVISIT_PROFILE),
        ]
    headers.append(("Content-Length", str(len(block))))
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers)
    return head + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record, checked."""
    end = data.find(b"\r\n\r\n", 0, MAX_HEADER)
    if end < 0:
        raise ArchiveError("no end of the header block")
    lines = data[:end].decode("utf-8").split("\r\n")
    if lines[0].encode() != VERSION:
        raise ArchiveError(f"unknown version line {lines[0][:40]!r}")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise ArchiveError(f"malformed header {line[:60]!r}")
        if name.lower() in headers:
            raise ArchiveError(f"repeated header {name}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ArchiveError(f"missing header {name}")
    if not headers["content-length"].isdecimal():
        raise ArchiveError("Content-Length is no number")
    size = int(headers["content-length"])
    block = data[end + 4 :]
    if len(block) != size + 4 or block[size:] != b"\r\n\r\n":
        raise ArchiveError(f"Content-Length {size} does not match the record")
    block = block[:size]
    for name, value in (("warc-block-digest", block), ("warc-payload-digest", block)):
        # A revisit's payload is not in the record.
        if name in headers and not (name == "warc-payload-digest" and headers["warc-type"] == "revisit"):
            if headers[name] != f"sha1:{digest(value)}":
                raise ArchiveError(f"{name} does not match")
    if headers["warc-type"] == "revisit" and "warc-refers-to" not in headers:
        raise ArchiveError("a revisit without WARC-Refers-To")
    return headers, block


def write_archive(out: BinaryIO, dictionary: bytes, records: Iterator[bytes], limit: int) -> tuple[int, int]:
    """Write records until ``limit`` bytes are reached; number of records and bytes."""
    size = 0
    packer = zstandard.ZstdCompressor(
        level=LEVEL,
        dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None,
        write_checksum=True,
    )
    if dictionary:
        size += out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
    n = 0
    for data in records:
        size += out.write(packer.compress(data))
        n += 1
        if size >= limit:
            break
    return n, size


def read_archive(source: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an open archive, one at a time."""

    def filled(held: bytes, size: int) -> bytes:
        """``held`` with more bytes up to ``size`` at least, if there are as many."""
        while len(held) < size:
            more = source.read(max(CHUNK, size - len(held)))
            if not more:
                break
            held += more
        return held

    held = filled(b"", 8)
    dictionary = None
    if len(held) >= 8 and struct.unpack_from("<I", held)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", held, 4)[0]
        held = filled(held, 8 + size)
        if len(held) < 8 + size:
            raise ArchiveError("the dictionary frame is cut off")
        raw = held[8 : 8 + size]
        if raw[:4] == FRAME:  # the dictionary may itself be compressed
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        dictionary = zstandard.ZstdCompressionDict(raw)
        held = held[8 + size :]
    opener = zstandard.ZstdDecompressor(dict_data=dictionary)
    while held := filled(held, 4):
        if held[:4] != FRAME:
            raise ArchiveError("no Zstandard frame where one must start")
        frame, parts = opener.decompressobj(), []
        try:
            while True:
                parts.append(frame.decompress(held))
                if frame.eof:
                    break
                held = source.read(CHUNK)
                if not held:
                    raise ArchiveError("the last frame is cut off")
        except zstandard.ZstdError as fault:
            raise ArchiveError(f"damaged frame: {fault}") from None
        held = frame.unused_data
        yield parse(b"".join(parts))


def write(
    pages: DataFrame, folder: str, min_payload: int = MIN_PAYLOAD, file_bytes: int = FILE_BYTES
) -> DataFrame:
    """Archive every row of ``pages`` (page_id, url, html) below ``folder``; the manifest
    (path, records, bytes) of the finished files.

    Payloads are the HTML in UTF-8, empty for null. Of equal payloads of at least
    ``min_payload`` bytes the smallest page_id is stored, the rest refer to it; of rows
    that also share that page_id each is stored. A null page_id comes after all others.
    """
    spark = pages.sparkSession
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
    )
    sample = hashed_sample(rows.select("page_id").distinct(), "page_id", DICTIONARY_ROWS)
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    texts = (
        rows.join(F.broadcast(sample), "page_id")
        .select("page_id", "url", F.substring("html", 1, SAMPLE_CHARS).alias("t"))
        .limit(2 * DICTIONARY_ROWS)
        .collect()
    )
    # Whole records, so that headers are learned as well.
    dictionary = train_dictionary(
        sorted(record(str(i), url, "response", t.encode(), None, date) for i, url, t in texts)
    )
    # Only digests and ids meet in the search for equal payloads. Most payloads occur
    # once; what goes on to the join is small, and written down, so that a payload that very
    # many pages share can be split between tasks.
    key = F.sha2(F.encode("html", "UTF-8"), 256)
    shared = materialize(
        rows.filter(F.octet_length("html") >= min_payload)
        .select("page_id", key.alias("key"))
        .groupBy("key")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1"),
        "shared",
    )
    repeats = rows.withColumn("key", key).join(shared, "key", "left").drop("key", "n")

    def archived(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for page_id, url, html, first in batch.itertuples(index=False):
                    again = first is not None and first != page_id
                    yield record(
                        page_id or "null",
                        url,
                        "revisit" if again else "response",
                        html.encode(),
                        first if again else None,
                        date,
                    )

        place, base = fs.FileSystem.from_uri(folder)
        place.create_dir(base, recursive=True)
        todo = records()
        done = []
        ahead = next(todo, None)
        while ahead is not None:
            name = f"part-{uuid.uuid4().hex}.warc.zst"
            with place.open_output_stream(f"{base}/{name}", compression=None) as out:

                def rest(first: bytes = ahead) -> Iterator[bytes]:
                    yield first
                    yield from todo

                n, size = write_archive(out, dictionary, rest(), file_bytes)
            done.append((f"{folder}/{name}", n, size))
            ahead = next(todo, None)
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    # Ids travel as text: pandas would turn numbers beside nulls into floats.
    sent = [F.col("page_id").cast("string"), "url", "html", F.col("first").cast("string")]
    listed = repeats.select(*sent).mapInPandas(
        archived, "path string, records long, bytes long"
    )
    return materialize(listed, "manifest")


RECORD = (
    "page_id long, target string, record_type string, payload_bytes long, "
    "payload_digest string, refers_to long"
)


def read(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """One row per record of the files in ``manifest`` (path, records): ids, type,
    digest, and the block's length, which is 0 for revisits; the block too if asked."""
    named = re.compile(r"<urn:record:(-?\d+|null)>")

    def number(value: str) -> int | None:
        match = named.fullmatch(value)
        if not match:
            raise ArchiveError(f"unknown record id {value[:60]!r}")
        return None if match[1] == "null" else int(match[1])

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, expected in zip(batch["path"], batch["records"]):
                place, name = fs.FileSystem.from_uri(path)
                rows, held, seen = [], 0, 0
                with place.open_input_stream(name, compression=None) as source:
                    for headers, block in read_archive(source):
                        refers = headers.get("warc-refers-to")
                        rows.append(
                            (
                                number(headers["warc-record-id"]),
                                headers.get("warc-target-uri"),
                                headers["warc-type"],
                                len(block),
                                headers["warc-payload-digest"].removeprefix("sha1:"),
                                number(refers) if refers else None,
                                *([block] if payloads else []),
                            )
                        )
                        seen += 1
                        held += len(block) if payloads else 200
                        if held > 32 << 20:
                            yield _frame(rows, payloads)
                            rows, held = [], 0
                if seen != expected:
                    raise ArchiveError(f"{path} holds {seen} records, the manifest says {expected}")
                yield _frame(rows, payloads)

    return manifest.select("path", "records").mapInPandas(
        opened, RECORD + (", payload binary" if payloads else "")
    )


def _frame(rows: list[tuple], payloads: bool) -> pd.DataFrame:
    names = ["page_id", "target", "record_type", "payload_bytes", "payload_digest", "refers_to"]
    frame = pd.DataFrame(rows, columns=names + ["payload"] * payloads)
    ids = ["page_id", "refers_to"]
    frame[ids] = frame[ids].astype("Int64")
    return frame


def resolve(records: DataFrame) -> DataFrame:
    """Give each revisit the payload length of the record it refers to. A revisit whose
    response is missing or has another digest fails the query."""
    stored = records.filter("record_type = 'response'").select(
        F.col("page_id").alias("stored_id"),
        F.col("payload_bytes").alias("stored_bytes"),
        F.col("payload_digest").alias("stored_digest"),
    )
    once = materialize(stored.dropDuplicates(["stored_id"]), "stored")
    revisits = records.filter("record_type = 'revisit'").join(
        once, F.col("refers_to") == F.col("stored_id"), "left"
    )
    checked: Column = F.when(
        F.col("stored_digest") == F.col("payload_digest"), F.col("stored_bytes")
    ).otherwise(F.raise_error(F.lit("a revisit does not match its response")).cast("long"))
    return records.filter("record_type = 'response'").unionByName(
        revisits.withColumn("payload_bytes", checked).select(*records.columns)
    )


def round_trip(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Archive the pages in the session's shared folder and read them back."""
    folder = scratch_path(pages.sparkSession, "warc")
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    return resolve(materialize(read(write(pages, folder, min_payload)), "records"))
