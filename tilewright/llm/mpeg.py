"""MPEG audio columns: a writer that carries bytes losslessly, and a reader.

The writer makes an MPEG-1 Layer III stream, 48 kHz, mono, with checksums: an
ID3v2 tag, a frame with a variable-bitrate table (count of frames and bytes, a
seek table of 100 points), then frames whose side information says "silence" and
whose free bytes hold the payload in units of 64.  The bitrate of each frame is
the smallest that holds its share, so the stream is one of variable bitrate.

The reader knows nothing of the writer: it skips tags, finds frame headers by
their sync bits and confirms each by the one that must follow, takes up again
after damage, verifies the CRC-16 of protected frames, parses the table, and
gives exact durations (a rational number of samples) and the frames' offsets.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

UNIT = 64
# fixed values of the format: bitrates in kbit/s by index, sample rates, for MPEG-1 and MPEG-2/2.5
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


def _crc_table() -> tuple[int, ...]:
    out = []
    for byte in range(256):
        r = byte << 8
        for _ in range(8):
            r = (r << 1 ^ 0x8005) & 0xFFFF if r & 0x8000 else r << 1 & 0xFFFF
        out.append(r)
    return tuple(out)


_CRC = _crc_table()


def crc16(data: bytes, start: int = 0xFFFF) -> int:
    for b in data:
        start = (start << 8 & 0xFFFF) ^ _CRC[start >> 8 ^ b]
    return start


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    protected: bool
    bitrate: int
    rate: int
    mono: bool
    size: int
    samples: int
    side: int  # bytes of Layer III side information


_headers: dict[bytes, Header | None] = {}


def parse_header(four: bytes) -> Header | None:
    """The header of a frame, or None if the four bytes aren't one."""
    if four in _headers:
        return _headers[four]
    found = None
    if len(four) == 4 and four[0] == 0xFF and four[1] >> 5 == 7:
        version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
        index, rate_index = four[2] >> 4, four[2] >> 2 & 3
        if version != 1 and layer != 4 and 0 < index < 15 and rate_index < 3:
            bitrate = BITRATES[(1 if version == 3 else 2, layer)][index]
            rate = RATES[version][rate_index]
            padding, mono = four[2] >> 1 & 1, four[3] >> 6 == 3
            samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
            size = (12000 * bitrate // rate + padding) * 4 if layer == 1 else samples // 8 * 1000 * bitrate // rate + padding
            side = 0 if layer != 3 else (17 if mono else 32) if version == 3 else (9 if mono else 17)
            found = Header(version, layer, not four[1] & 1, bitrate, rate, mono, size, samples, side)
    if len(_headers) < 4096:
        _headers[four] = found
    return found


@dataclass
class Audio:
    """What a stream holds."""

    rate: int = 0
    samples: int = 0
    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    checked: int = 0
    bad_crc: int = 0
    skipped: int = 0  # bytes outside tags and frames
    tags: dict[str, str] = field(default_factory=dict)
    table: dict[str, object] | None = None

    @property
    def duration_us(self) -> int:
        """Floor of the exact duration in microseconds."""
        return self.samples * 1_000_000 // self.rate if self.rate else 0


def _syncsafe(raw: bytes) -> int:
    return raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]


def _tag_end(data: bytes, at: int, out: Audio) -> int:
    """Past an ID3v2 or ID3v1 tag at ``at``; ``at`` itself if there is none."""
    if data[at : at + 3] == b"ID3" and len(data) >= at + 10 and max(data[at + 6 : at + 10]) < 128:
        end = min(len(data), at + 10 + _syncsafe(data[at + 6 : at + 10]) + (10 if data[at + 5] & 16 else 0))
        k, wide = at + 10, data[at + 3] >= 4
        while k + 10 <= end and data[k] and data[at + 3] >= 3:
            size = _syncsafe(data[k + 4 : k + 8]) if wide else int.from_bytes(data[k + 4 : k + 8], "big")
            name, body = data[k : k + 4].decode("latin-1"), data[k + 10 : k + 10 + size]
            if name[0] == "T" and body:
                code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
                out.tags[name] = body[1:].decode(code, "replace").rstrip("\0")
            k += 10 + size
        return end
    if data[at : at + 3] == b"TAG" and len(data) - at == 128:
        out.tags.setdefault("TIT2", data[at + 3 : at + 33].decode("latin-1").rstrip("\0 "))
        return len(data)
    return at


def _table(frame: bytes, head: Header) -> dict[str, object] | None:
    """A variable-bitrate table (Xing or Info, or VBRI) in the first frame."""
    at = 4 + 2 * head.protected + head.side
    if frame[at : at + 4] in (b"Xing", b"Info"):
        flags, k = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
        out: dict[str, object] = {"kind": frame[at : at + 4].decode()}
        for bit, name, size in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
            if flags & bit:
                out[name] = list(frame[k : k + size]) if name == "toc" else int.from_bytes(frame[k : k + size], "big")
                k += size
        return out
    if frame[36:40] == b"VBRI":
        return {"kind": "VBRI", "bytes": int.from_bytes(frame[46:50], "big"), "frames": int.from_bytes(frame[50:54], "big")}
    return None


def parse(data: bytes) -> Audio:
    """Frames, tags, table and checks of a stream.  Bytes that are neither tag
    nor frame are skipped up to the next header that another header, a tag or
    the end of the stream confirms."""
    out, at, n, synced = Audio(), 0, len(data), False
    first, kind = True, None
    while at < n:
        end = _tag_end(data, at, out)
        if end > at:
            at, synced = end, True
            continue
        head = parse_header(data[at : at + 4])
        follows = at + head.size if head else 0
        if head and follows <= n:
            # a lone header may be chance: its successor must be there too, or it goes on a
            # stream of its kind, with a right checksum if it has one
            after = parse_header(data[follows : follows + 4]) if follows < n else head
            sure = bool(after and after.rate == head.rate and after.layer == head.layer) or data[follows : follows + 3] in (b"ID3", b"TAG")
            frame = data[at:follows]
            wrong = head.protected and head.layer == 3 and crc16(frame[2:4] + frame[6 : 6 + head.side]) != int.from_bytes(frame[4:6], "big")
            if not sure and synced and kind == (head.version, head.layer, head.rate, head.protected, head.mono):
                sure = not wrong
            if sure:
                kind = (head.version, head.layer, head.rate, head.protected, head.mono)
                if head.protected and head.layer == 3:
                    out.checked += 1
                    out.bad_crc += wrong
                table = _table(frame, head) if first else None
                first = False
                out.rate = out.rate or head.rate
                if table:
                    out.table = table
                else:
                    out.offsets.append(at)
                    out.sizes.append(head.size)
                    out.samples += head.samples
                at, synced = follows, True
                continue
        synced = False
        step = data.find(b"\xff", at + 1)
        tag = data.find(b"ID3", at + 1, step if step >= 0 else n)
        step = min((x for x in (step, tag) if x >= 0), default=n)
        if n - 128 > at and data[n - 128 : n - 125] == b"TAG":
            step = min(step, n - 128)
        out.skipped += step - at
        at = step
    return out


def seek(audio: Audio, sample: int) -> int:
    """The byte offset of the frame that holds a sample (of equal-length frames)."""
    if not audio.offsets:
        return 0
    each = audio.samples // len(audio.offsets)
    return audio.offsets[min(max(sample, 0) // each, len(audio.offsets) - 1)]


# the writer's frames: units of payload -> (header, size), MPEG-1 Layer III 48 kHz mono protected
def _frame_kinds() -> list[tuple[bytes, int, int]]:
    out = []
    for index in range(1, 15):
        four = bytes((0xFF, 0xFA, index << 4 | 1 << 2, 0xC0))
        head = parse_header(four)
        room = (head.size - 23) // UNIT
        if room > (out[-1][2] if out else 0):
            out.append((four + crc16(four[2:] + bytes(17)).to_bytes(2, "big") + bytes(17), head.size, room))
    return out


_KINDS = _frame_kinds()
MOST_UNITS = _KINDS[-1][2]
_FITS = [next(k for k in _KINDS if k[2] >= u) for u in range(1, MOST_UNITS + 1)]
_TAG_BODY = b"TSSE" + (8).to_bytes(4, "big") + b"\0\0" + b"\3payload"
_TAG = b"ID3\4\0\0" + bytes((0, 0, 0, len(_TAG_BODY))) + _TAG_BODY


def write(payload: bytes) -> bytes:
    """A stream that carries a payload of a positive multiple of 64 bytes."""
    if not payload or len(payload) % UNIT:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    frames, span = [], UNIT * MOST_UNITS
    for k in range(0, len(payload), span):
        part = payload[k : k + span]
        top, size, _ = _FITS[len(part) // UNIT - 1]
        frames.append(top + part + bytes(size - len(top) - len(part)))
    body = b"".join(frames)
    top, size, _ = _KINDS[next(i for i, k in enumerate(_KINDS) if k[1] >= 23 + 120)]
    total = size + len(body)
    starts, at = [], size
    for f in frames:
        starts.append(at)
        at += len(f)
    toc = bytes(min(255, starts[p * len(frames) // 100] * 256 // total) for p in range(100))
    table = b"Xing" + (7).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + total.to_bytes(4, "big") + toc
    return _TAG + top + table + bytes(size - len(top) - len(table)) + body


def payload_of(data: bytes, audio: Audio) -> bytes:
    """The payload that :func:`write` put into the frames of a stream."""
    out = []
    for at, size in zip(audio.offsets, audio.sizes, strict=True):
        units = (size - 23) // UNIT
        out.append(data[at + 23 : at + 23 + units * UNIT])
    return b"".join(out)


def padded(text: str | None) -> tuple[int, bytes]:
    """Length of a text in UTF-8, and it with zeros up to a positive multiple of 64."""
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))


def store(text: str | None) -> tuple[int, int, bytes]:
    n, payload = padded(text)
    return n, len(payload), write(payload)


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_us long, frame_offsets array<long>"


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, media): whole texts as streams.

    Null and empty texts are one frame's payload of zeros; repeated rows give
    repeated results; an empty table gives no rows; further columns, whatever
    their names, are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [store(t) for t in batch.column(1).to_pylist()]
            n, m, media = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "payload_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """Reads stored streams: digests of payload and stream, the exact duration,
    frame offsets, and a feature string of frames, sample rate, samples, checks
    and bitrates.

    A damaged stream gives what its whole frames hold; the payload is cut at the
    stored length.  A null stream counts as an empty one.  Equal streams give
    equal rows."""

    def one(doc, n, m, data):
        data = data or b""
        audio = parse(data)
        payload = payload_of(data, audio)[: m or 0]
        rates = [s * audio.rate // 144_000 for s in audio.sizes]
        feature = f"frames={len(audio.offsets)};rate={audio.rate};samples={audio.samples};crc_ok={audio.checked - audio.bad_crc}/{audio.checked};skipped={audio.skipped};kbps={min(rates, default=0)}-{max(rates, default=0)};table={(audio.table or {}).get('frames', 0)}"
        return doc, n, m, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature, audio.duration_us, audio.offsets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64())]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            rows = [one(*r) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return media.select("doc_id", "n_bytes", "payload_bytes", "media").mapInArrow(run, SCHEMA)
