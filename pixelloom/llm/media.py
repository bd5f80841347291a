"""Media columns: Ogg bitstreams of 8-bit samples.

The bytes of a clip are interleaved samples of two mono tracks. Each track is one logical stream: a header packet
on a first (BOS) page, then data packets whose lengths are written as lacing values, over as many pages as they
need; a packet may continue on the next page. Pages of the streams alternate in the file. A page's granule
position is the number of the track's samples up to the last packet that ends on it (-1: none ends), so a
packet's start time follows from the granule position and the lengths of the packets behind it.

The reader trusts nothing: it checks capture pattern, version, checksum and sequence number of every page, puts
packets together from lacing values, separates streams by serial number, and checks every granule position.

Edge cases: null or empty content gives a valid container without data packets; content of any length is packets over as many pages as it
needs; repeated rows give repeated results; an empty table gives no rows; other columns are ignored, so their names can't clash; damaged
media raise ``OggError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mapped

MAGIC = b"\x80PCMU8\0"
RATE = 8000
PACKET = 4000
TRACKS = 2
#: Bytes with their bits in reverse order: the page checksum's polynomial is zlib's, read from the other end.
MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
HEAD = struct.Struct("<4sBBqIIIB")
PAD = 192


class OggError(ValueError):
    pass


def page_checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04c11db7, most significant bit first, register 0, no final inversion."""
    low = zlib.crc32(page.translate(MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(low.to_bytes(4, "little").translate(MIRROR), "big")


def _page(flags: int, granule: int, serial: int, number: int, laces: bytes, body: bytes) -> bytes:
    blank = HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(laces)) + laces + body
    return blank[:22] + page_checksum(blank).to_bytes(4, "little") + blank[26:]


def _track_pages(samples: bytes, serial: int, packet: int, rate: int) -> list[bytes]:
    pages = [_page(2, 0, serial, 0, bytes([len(MAGIC) + 5]), MAGIC + struct.pack("<BI", serial, rate))]
    # every segment of the stream, and at each segment the granule position if a packet ends there
    laces, ends = bytearray(), []
    for at in range(0, len(samples), packet):
        n = min(packet, len(samples) - at)
        laces += b"\xff" * (n // 255)
        laces.append(n % 255)
        ends += [-1] * (n // 255) + [at + n]
    done = 0
    for at in range(0, max(len(laces), 1), 255):
        seg = bytes(laces[at : at + 255])
        size = sum(seg)
        granule = next((g for g in reversed(ends[at : at + 255]) if g >= 0), -1)
        flags = (1 if at and laces[at - 1] == 255 else 0) | (4 if at + 255 >= len(laces) else 0)
        pages.append(_page(flags, granule, serial, len(pages), seg, samples[done : done + size]))
        done += size
    return pages


def encode(payload: bytes, packet: int = PACKET, rate: int = RATE) -> bytes:
    """The container of a payload of an even number of bytes. Equal payloads give equal containers."""
    if len(payload) % TRACKS:
        raise OggError("the payload isn't a whole number of frames")
    tracks = [_track_pages(payload[k::TRACKS], k + 1, packet, rate) for k in range(TRACKS)]
    out = [t[0] for t in tracks]  # all first pages come before other pages
    for i in range(1, max(map(len, tracks))):
        out += [t[i] for t in tracks if i < len(t)]
    return b"".join(out)


def pages(media: bytes) -> Iterator[tuple[int, int, int, int, bytes, int, int]]:
    """flags, granule, serial, number, lacing values, body's start and end of each verified page."""
    at = 0
    while at < len(media):
        if at + 27 > len(media):
            raise OggError("the last page is cut off")
        magic, version, flags, granule, serial, number, crc, n = HEAD.unpack_from(media, at)
        laces = media[at + 27 : at + 27 + n]
        body = at + 27 + n
        end = body + sum(laces)
        if magic != b"OggS" or version or len(laces) < n or end > len(media):
            raise OggError(f"no whole page at {at}")
        if page_checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise OggError(f"wrong checksum of the page at {at}")
        yield flags, granule, serial, number, laces, body, end
        at = end


def demultiplex(media: bytes) -> dict[int, list[tuple[bytes, int]]]:
    """By serial number: the stream's packets, each with the granule position at its end (header: 0).

    A packet that ends inside a page has the page's position less the lengths of the packets after it there.
    """
    streams: dict[int, list[tuple[bytes, int]]] = {}
    half: dict[int, bytearray | None] = {}
    expect: dict[int, int] = {}
    closed: set[int] = set()
    for flags, granule, serial, number, laces, at, _ in pages(media):
        if flags & 2:
            if serial in streams:
                raise OggError("a stream begins twice")
            streams[serial], half[serial], expect[serial] = [], None, 0
        if serial not in streams or serial in closed:
            raise OggError("a page outside its stream")
        if number != expect[serial]:
            raise OggError("a page is missing")
        expect[serial] += 1
        if bool(flags & 1) != (half[serial] is not None):
            raise OggError("a continued packet is broken")
        whole: list[bytes] = []
        open_ = half[serial]
        run = 0
        for v in laces:
            run += v
            if v < 255:
                piece = media[at : at + run]
                whole.append(bytes(open_) + piece if open_ is not None else piece)
                open_, at, run = None, at + run, 0
        if laces and laces[-1] == 255:
            open_ = (open_ if open_ is not None else bytearray()) + media[at : at + run]
        half[serial] = open_
        if bool(whole) == (granule == -1):
            raise OggError("granule position without a packet's end")
        ends, back = [], granule
        for p in reversed(whole):
            ends.append(back)
            back -= len(p)
        streams[serial] += zip(whole, [0] * len(whole) if flags & 2 else ends[::-1], strict=True)
        if flags & 4:
            closed.add(serial)
    if closed != set(streams) or any(h is not None for h in half.values()):
        raise OggError("a stream has no end")
    return streams


def decode(media: bytes) -> tuple[bytes, list[tuple[int, int, int]], int]:
    """The payload, (track, start, length) of each data packet in samples, and the sample rate."""
    tracks, spans, rate = [], [], RATE
    for serial, packets in sorted(demultiplex(media).items()):
        if not packets or not packets[0][0].startswith(MAGIC):
            raise OggError("unknown codec")
        _, rate = struct.unpack("<BI", packets[0][0][len(MAGIC) :])
        at = 0
        for p, end in packets[1:]:
            if end - len(p) != at:
                raise OggError("granule positions don't follow the samples")
            spans.append((serial, at, len(p)))
            at = end
        tracks.append(np.frombuffer(b"".join(p for p, _ in packets[1:]), np.uint8))
    if len(tracks) != TRACKS or len(tracks[0]) != len(tracks[1]):
        raise OggError("the tracks differ in length")
    return np.column_stack(tracks).tobytes(), spans, rate


def feature(payload: bytes, spans: list[tuple[int, int, int]], rate: int) -> str:
    """Duration in microseconds, data packets, start of the last one, then integer statistics of the samples."""
    a = np.frombuffer(payload, np.uint8)
    if not len(a):
        return f"us=0;packets={len(spans)}"
    c = a.astype(np.int32) - 128
    last = max((at for _, at, _ in spans), default=0)
    crossings = int(np.count_nonzero((c[:-1] < 0) != (c[1:] < 0)))
    return f"us={len(a) // TRACKS * 1_000_000 // rate};packets={len(spans)};last_us={last * 1_000_000 // rate};min={int(a.min())};max={int(a.max())};sum={int(a.sum(dtype=np.int64))};energy={int(np.dot(c.astype(np.int64), c))};crossings={crossings}"


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % PAD if raw else PAD), len(raw)


def read_media(media: bytes) -> tuple:
    payload, spans, rate = decode(media)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload, spans, rate)


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def text_media(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """Each text as an Ogg clip, read back and described; with ``keep_media`` the container itself is a column.

    Null texts count as empty; repeated rows give repeated results; other columns are ignored. Nothing is
    shuffled, and a task holds one Arrow batch of texts and one clip.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, rows, clips = part.column(0), [], []
                for text in part.column(1).to_pylist():
                    payload, n = padded(text)
                    media = encode(payload)
                    rows.append((n, *read_media(media)))
                    if keep_media:
                        clips.append(media)
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                arrays = [ids.cast(pa.int64())] + [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
                if keep_media:
                    arrays.append(pa.array(clips, pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, NAMES + ["media"] * keep_media)

    return docs.select("doc_id", "text").transform(mapped(run, SCHEMA + ", media binary" * keep_media))


NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
