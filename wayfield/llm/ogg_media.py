"""Media columns: Ogg containers.

Reading: find pages, verify their checksums, take them apart by logical stream, reassemble packets
from lacing values (packets may go on over pages), and derive timestamps from granule positions.
Writing puts packets back into pages.  Bytes that aren't a sound page (bad checksum, wrong version,
truncated) are skipped to the next capture pattern and counted, so damaged files give what is left.

The query stores each text's bytes as 8-bit samples, one packet a frame, in one logical stream, and a
description of it in a second one; both are interleaved, read back and demultiplexed.

How it scales.  One pass over the rows with no shuffle; a file is handled on its own, in Arrow
batches, and checksums run in zlib (the Ogg checksum is the CRC-32 of bit-reversed bytes).

Nulls and odd cases: null and empty texts give a payload of 64 zero bytes; equal texts give equal
bytes, since serial numbers come from the payload; very long texts go over as many pages as they need; a null doc_id is kept; repeated rows are stored each on
their own; null or empty media give no packets; columns other than doc_id and text (or the key and the media) are not read, so their names cannot clash; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

CONTINUED, FIRST, LAST = 1, 2, 4
NO_GRANULE = -1  # no packet ends on the page
RATE, FRAME = 8000, 4000  # samples a second; bytes (samples) a packet
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_HEAD = struct.Struct("<4sBBqIIIB")


def page_checksum(page: bytes) -> int:
    """CRC with polynomial 0x04C11DB7, not reflected, from 0: zlib's, seen in a mirror."""
    c = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{c:032b}"[::-1], 2)


@dataclass(slots=True)
class Page:
    flags: int
    granule: int
    serial: int
    sequence: int
    lacing: bytes
    body: bytes

    def pack(self) -> bytes:
        head = _HEAD.pack(b"OggS", 0, self.flags, self.granule, self.serial, self.sequence, 0, len(self.lacing)) + self.lacing
        crc = page_checksum(head + self.body)
        return head[:22] + crc.to_bytes(4, "little") + head[26:] + self.body


def read_pages(data: bytes) -> tuple[list[Page], int]:
    """The sound pages and the number of bytes that belong to none."""
    pages, at, lost = [], 0, 0
    while at < len(data):
        if data[at : at + 4] == b"OggS" and at + 27 <= len(data):
            _, version, flags, granule, serial, sequence, crc, n = _HEAD.unpack_from(data, at)
            body = at + 27 + n
            lacing = data[at + 27 : body]
            end = body + sum(lacing)
            if version == 0 and len(lacing) == n and end <= len(data) and page_checksum(b"".join((data[at : at + 22], bytes(4), data[at + 26 : end]))) == crc:
                pages.append(Page(flags, granule, serial, sequence, lacing, data[body:end]))
                at = end
                continue
        after = data.find(b"OggS", at + 1)
        after = len(data) if after < 0 else after
        lost += after - at
        at = after
    return pages, lost


@dataclass(slots=True)
class Packet:
    serial: int
    number: int
    data: bytes
    granule: int  # of the packet's end; NO_GRANULE unless it is the last to end on its page
    whole: bool


def demultiplex(pages: list[Page]) -> dict[int, list[Packet]]:
    """Packets by logical stream.  One that lost a page in its middle is kept as not whole."""
    out: dict[int, list[Packet]] = {}
    open_: dict[int, list[bytes]] = {}
    last: dict[int, int] = {}
    for p in pages:
        packets = out.setdefault(p.serial, [])
        parts = open_.setdefault(p.serial, [])
        gap = p.serial in last and p.sequence != last[p.serial] + 1
        last[p.serial] = p.sequence
        whole = True
        if parts and (gap or not p.flags & CONTINUED):
            packets.append(Packet(p.serial, len(packets), b"".join(parts), NO_GRANULE, False))
            parts.clear()
        if p.flags & CONTINUED and not parts:
            whole = False  # its beginning is missing
        at = start = ended = 0
        for n in p.lacing:
            at += n
            if n < 255:
                parts.append(p.body[start:at])
                packets.append(Packet(p.serial, len(packets), b"".join(parts), NO_GRANULE, whole))
                parts.clear()
                start, ended, whole = at, ended + 1, True
        if start < at:
            parts.append(p.body[start:at])
        if ended and p.granule != NO_GRANULE:
            packets[-1].granule = p.granule
    for serial, parts in open_.items():
        if parts:
            out[serial].append(Packet(serial, len(out[serial]), b"".join(parts), NO_GRANULE, False))
    return out


def write_stream(packets: list[tuple[bytes, int]], serial: int, most: int = 255) -> list[Page]:
    """Pages of one logical stream from (packet, granule at its end); `most` lacing values a page at most."""
    lacing, body, ends = [], [], []  # over the whole stream; ends: granule for a segment that ends a packet
    for data, granule in packets:
        full, rest = divmod(len(data), 255)
        lacing += [255] * full + [rest]
        ends += [None] * full + [granule]
        body.append(data)
    whole, pages, at = b"".join(body), [], 0
    for i in range(0, max(1, len(lacing)), most):
        part = lacing[i : i + most]
        granule = next((g for g in reversed(ends[i : i + most]) if g is not None), NO_GRANULE)
        flags = (CONTINUED if i and ends[i - 1] is None else 0) | (0 if i else FIRST) | (LAST if i + most >= len(lacing) else 0)
        pages.append(Page(flags, granule, serial, len(pages), bytes(part), whole[at : at + sum(part)]))
        at += sum(part)
    return pages


def store(payload: bytes) -> bytes:
    """An Ogg file of two logical streams: the samples, and a description of them."""
    serial = zlib.crc32(payload)
    sound = [(b"PCM8" + struct.pack("<II", RATE, FRAME), 0)]
    sound += [(payload[i : i + FRAME], min(i + FRAME, len(payload))) for i in range(0, len(payload), FRAME)]
    note = [(b"NOTE" + struct.pack("<IQ", serial, len(payload)), len(payload))]
    pages = write_stream(sound, serial)
    described = write_stream(note, serial ^ 0xFFFFFFFF)
    return b"".join(p.pack() for p in [pages[0], *described, *pages[1:]])


def load(media: bytes) -> tuple[bytes, dict]:
    """The samples of the stored form and what the container says of them."""
    pages, lost = read_pages(media)
    streams = demultiplex(pages)
    sound = next((s for s in streams.values() if s and s[0].data[:4] == b"PCM8"), [])
    note = next((s for s in streams.values() if s and s[0].data[:4] == b"NOTE"), [])
    rate = struct.unpack_from("<I", sound[0].data, 4)[0] if sound else RATE
    stamps = [p.granule / rate for p in sound if p.granule != NO_GRANULE]
    return b"".join(p.data for p in sound[1:]), {
        "pages": len(pages), "streams": len(streams), "packets": len(sound) - 1, "lost": lost, "whole": all(p.whole for s in streams.values() for p in s),
        "seconds": max(stamps, default=0.0), "said": struct.unpack_from("<Q", note[0].data, 8)[0] if note else -1,
    }


def feature(samples: bytes, about: dict) -> str:
    """Level, loudness and spread of the samples as read back, and the container's figures."""
    h = np.bincount(np.frombuffer(samples, np.uint8), minlength=256).astype(float)
    n, v = max(1.0, h.sum()), np.arange(256) - 128.0
    mean, square = (h * v).sum() / n, (h * v * v).sum() / n
    p = h[h > 0] / n
    return (
        f"ogg;pages={about['pages']};streams={about['streams']};packets={about['packets']};lost={about['lost']};whole={int(about['whole'])};"
        f"seconds={about['seconds']:.6f};mean={mean:.6f};rms={square**0.5:.6f};entropy={-(p * np.log2(p)).sum():.6f}"
    )


def ends(stream: list[Packet], samples: Callable[[bytes], int] = len) -> list[int | None]:
    """Granule at the end of each packet of a logical stream: where a page gives none, counted back from the next one that is given by the packets between.

    None after the last that is given, and before a packet that isn't whole.  samples: how many granules a packet lasts.
    """
    out, at = [], None
    for p in reversed(stream):
        at = p.granule if p.granule != NO_GRANULE else at
        out.append(at)
        at = at - samples(p.data) if at is not None and p.whole and at >= samples(p.data) else None
    return out[::-1]


PACKETS = "serial long, packet long, whole boolean, granule long, seconds double, data binary"


def packets(media: DataFrame, key: str, column: str = "media", rate: int = RATE, samples: Callable[[bytes], int] = len) -> DataFrame:
    """One row for each packet of each Ogg file in a binary column: the general reader.

    granule is what the page says (null unless the packet is the last to end on it); seconds at the packet's end are derived for the others too.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in zip(batch.column(0), batch.column(1), strict=True):
                streams = demultiplex(read_pages(data.as_py() or b"")[0]).values()
                found = [p for s in streams for p in s]
                times = [None if at is None else at / rate for s in streams for at in ends(s, samples)]
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([k.as_py()] * len(found), batch.schema.field(0).type),
                            pa.array([p.serial for p in found], pa.int64()),
                            pa.array([p.number for p in found], pa.int64()),
                            pa.array([p.whole for p in found]),
                            pa.array([p.granule if p.granule != NO_GRANULE else None for p in found], pa.int64()),
                            pa.array(times, pa.float64()),
                            pa.array([p.data for p in found], pa.binary()),
                        ],
                        [key, "serial", "packet", "whole", "granule", "seconds", "data"],
                    )

    kind = media.schema[key].dataType.simpleString()
    return media.select(key, column).mapInArrow(read, f"{key} {kind}, {PACKETS}")


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % 64 or (0 if raw else 64))


STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def stored_texts(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """Stores every text, reads the stored bytes back, and returns its digests (and the file, if asked)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                n, payload = payload_of(text.as_py())
                media = store(payload)
                back, about = load(media)
                if len(back) != about["said"]:
                    raise ValueError("the stored form lost bytes")
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(back, about), media))
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            arrays = [batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns[: 7 + keep_media], kinds, strict=False))]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"]
            yield pa.RecordBatch.from_arrays(arrays, names[: 8 + keep_media])

    text_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, STORED + ", media binary" * keep_media)
