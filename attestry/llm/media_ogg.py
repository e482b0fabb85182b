"""Media columns: Ogg files in a binary column.

Reading verifies the checksum of every page, demultiplexes pages by their stream's serial number, reassembles
packets from the lacing values (a value of 255 goes on, also over pages), and gives each packet its time from
the page's granule position. Writing makes such files from packets. A damaged page is reported and skipped, and
a packet that misses a part is dropped and counted, as the format's readers do.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE, FRAME = 8000, 576
CONTINUED, FIRST, LAST = 1, 2, 4
_HEAD = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
#: Serial numbers of the streams that ``write_pcm`` makes.
AUDIO, NOTES = 1, 2


def checksum(data: bytes) -> int:
    """CRC-32 of polynomial 0x04C11DB7, most significant bit first, from and to zero.

    That is zlib's reflected CRC over bit-reversed bytes, its two complements undone, bit-reversed again.
    """
    r = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(r.to_bytes(4, "big").translate(_REVERSED), "little")


def page(flags: int, granule: int, serial: int, sequence: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing
    crc = checksum(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


def pages_of(packets: list[tuple[bytes, int]], serial: int) -> Iterator[bytes]:
    """Pages of one stream. ``packets``: (data, granule position at its end); a page has at most 255 lacing
    values and the granule of the last packet that ends on it, -1 if none does."""
    values: list[tuple[int, bytes, int | None]] = []  # lacing value, its bytes, granule if the packet ends
    for data, granule in packets:
        full, rest = divmod(len(data), 255)
        values += [(255, data[255 * i : 255 * i + 255], None) for i in range(full)]
        values.append((rest, data[255 * full :], granule))
    count = max(1, -(-len(values) // 255))
    for n in range(count):
        part = values[255 * n : 255 * n + 255]
        ends = [g for _, _, g in part if g is not None]
        flags = (CONTINUED if n and values[255 * n - 1][2] is None else 0) | (FIRST if n == 0 else 0) | (LAST if n == count - 1 else 0)
        yield page(flags, ends[-1] if ends else -1, serial, n, bytes(v for v, _, _ in part), b"".join(d for _, d, _ in part))


def write_pcm(payload: bytes, frame: int = FRAME, rate: int = RATE) -> bytes:
    """An Ogg file of a stream of 8-bit samples, one packet for each frame, and a stream of two notes.

    The audio stream begins with a header packet (rate, frame, samples). The streams' first pages stand in
    front, as the format asks; the notes' only page is followed by the audio pages.
    """
    notes = [(b"notes\0" + struct.pack("<I", len(payload)), 0), (hashlib.md5(payload).digest(), 0)]
    header = (b"pcm8\0" + struct.pack("<IIQ", rate, frame, len(payload)), 0)
    packets = [header, *((payload[i : i + frame], min(i + frame, len(payload))) for i in range(0, len(payload), frame))]
    audio = list(pages_of(packets, AUDIO)) if len(payload) % frame or frame % 255 == 0 else list(_even_pages(header, payload, frame))
    return b"".join([audio[0], *pages_of(notes, NOTES), *audio[1:]])


def _even_pages(header: tuple[bytes, int], payload: bytes, frame: int) -> Iterator[bytes]:
    """The pages of ``pages_of`` for frames of one size, page by page: as many frames as a page takes."""
    yield page(FIRST, header[1], AUDIO, 0, bytes([len(header[0])]), header[0])
    lace = b"\xff" * (frame // 255) + bytes([frame % 255])
    per = 255 // len(lace)
    total = len(payload) // frame
    for n, i in enumerate(range(0, total, per), 1):
        k = min(per, total - i)
        yield page(LAST if i + k == total else 0, (i + k) * frame, AUDIO, n, lace * k, payload[i * frame : (i + k) * frame])


@dataclass
class Stream:
    """One logical stream as read."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)  # of the page where a packet ends if it is the last there, else -1
    pages: int = 0
    lost: int = 0
    ended: bool = False
    _open: list[bytes] | None = None
    _next: int | None = None


@dataclass
class Ogg:
    streams: dict[int, Stream]
    pages: int
    bad_pages: int


def parse(data: bytes) -> Ogg:
    """All streams of a file. Bytes that are no page are skipped up to the next capture pattern."""
    streams: dict[int, Stream] = {}
    at, pages, bad, end = 0, 0, 0, len(data)
    while (at := data.find(b"OggS", at)) >= 0:
        if at + 27 > end:
            bad += 1
            break
        _, version, flags, granule, serial, sequence, crc, n = _HEAD.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + n]
        size = 27 + n + sum(lacing)
        if version or len(lacing) < n or at + size > end or checksum(b"".join([data[at : at + 22], b"\0\0\0\0", data[at + 26 : at + size]])) != crc:
            bad += 1
            at += 4
            continue
        pages += 1
        _page(streams.setdefault(serial, Stream(serial)), flags, granule, sequence, lacing, data, at + 27 + n)
        at += size
    for s in streams.values():
        if s._open is not None:
            s.lost += 1
            s._open = None
    return Ogg(streams, pages, bad)


def _page(s: Stream, flags: int, granule: int, sequence: int, lacing: bytes, data: bytes, at: int) -> None:
    s.pages += 1
    gap = s._next is not None and sequence != s._next
    s._next = sequence + 1
    if s._open is not None and (gap or not flags & CONTINUED):
        s.lost += 1
        s._open = None
    # A page that goes on with a packet whose start is lost: skip to where that packet ends.
    skip = bool(flags & CONTINUED) and s._open is None
    if skip:
        s.lost += 1
    start, before = at, len(s.packets)
    for v in lacing:
        at += v
        if v < 255:
            if skip:
                skip = False
            else:
                piece = data[start:at]
                s.packets.append(b"".join([*s._open, piece]) if s._open else piece)
                s.granules.append(-1)
            s._open, start = None, at
    if lacing and lacing[-1] == 255 and not skip:
        s._open = [*(s._open or ()), data[start:at]]
    if len(s.packets) > before and granule >= 0:
        s.granules[-1] = granule
    s.ended |= bool(flags & LAST)


def times(s: Stream, per_packet: int, rate: int, headers: int = 1) -> list[float | None]:
    """End time in seconds of each packet: pages give the last one's granule, packets before it count back."""
    out: list[float | None] = [None] * len(s.packets)
    later: int | None = None
    for i in range(len(s.packets) - 1, headers - 1, -1):
        later = s.granules[i] if s.granules[i] >= 0 else None if later is None else later - per_packet
        out[i] = None if later is None else later / rate
    return out


def read_pcm(data: bytes) -> tuple[bytes, Ogg, list[float | None]]:
    """The samples of the audio stream, the parsed file, and the packets' end times."""
    ogg = parse(data)
    s = next((x for x in ogg.streams.values() if x.packets and x.packets[0].startswith(b"pcm8\0")), None)
    if s is None:
        return b"", ogg, []
    rate, frame, samples = struct.unpack_from("<IIQ", s.packets[0], 5)
    return b"".join(s.packets[1:])[:samples], ogg, times(s, frame, rate)


def features(samples: bytes, ogg: Ogg, ends: list[float | None]) -> str:
    """Whole numbers only, so that equal files have equal features on every machine."""
    x = np.frombuffer(samples, np.uint8)
    side = x >= 128
    cross = int(np.count_nonzero(side[1:] != side[:-1]))
    last = next((t for t in reversed(ends) if t is not None), 0.0)
    energy = int((x.astype(np.int64) ** 2).sum()) // max(1, len(x))
    packets = sum(len(s.packets) for s in ogg.streams.values())
    return f"streams={len(ogg.streams)};pages={ogg.pages};bad={ogg.bad_pages};packets={packets};ms={round(last * 1000)};mean={int(x.sum(dtype=np.int64)) // max(1, len(x))};energy={energy};crossings={cross}"


# -- columns -----------------------------------------------------------------------------------------------


def packets(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("id",), per_packet: int = FRAME, rate: int = RATE, headers: int = 1) -> DataFrame:
    """One row per packet of every stream: ``keep``, serial, packet (from 0), bytes, granule, end_s.

    Null or empty media, and media without a sound page, have no packets. ``end_s`` is null for headers and
    where no later page of the stream has a granule position. Repeated rows give repeated packets.
    """
    src = df.select(F.col(media).alias("__media"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, data in enumerate(b.column(0).to_pylist()):
                for serial, s in sorted(parse(data or b"").streams.items()):
                    n = len(s.packets)
                    if n:
                        kept = [pa.concat_arrays([b.column(j).slice(i, 1)] * n) for j in range(1, b.num_columns)]
                        cols = [*kept, pa.array([serial] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(s.packets, pa.binary()), pa.array(s.granules, pa.int64()), pa.array(times(s, per_packet, rate, headers), pa.float64())]
                        yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names[1:], "serial", "packet", "bytes", "granule", "end_s"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[1:]]
    return src.mapInArrow(run, ", ".join([*fields, "serial bigint, packet int, bytes binary, granule bigint, end_s double"]))


def payload_of(text: str | None, frame: int = FRAME) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    size = max(1, -(-len(raw) // frame)) * frame
    return raw + b"\xff" * (size - len(raw)), len(raw)


def stored(df: DataFrame, id_col: str = "doc_id", text: str = "text", with_media: bool = False) -> DataFrame:
    """Store every whole text as an Ogg file, read it back and describe it: a row for each row.

    Null text is empty, and a text of no bytes is one frame of padding. Equal texts give equal values. Null
    ids are kept; only the id and the text are read. ``with_media`` adds the file itself.
    """
    src = df.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("t"))
    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                payload, n = payload_of(t)
                media = write_pcm(payload)
                back, ogg, ends = read_pcm(media)
                row = (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(back, ogg, ends))
                rows.append((*row, media) if with_media else row)
            cols = list(zip(*rows)) if rows else [[]] * (7 + with_media)
            extra = [pa.array(cols[7], pa.binary())] if with_media else []
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds)), *extra], names=["id", *names, *["media"] * with_media])

    schema = f"id {src.schema['id'].dataType.simpleString()}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return src.mapInArrow(run, schema + (", media binary" if with_media else "")).withColumnRenamed("id", id_col)
