import hashlib
import zlib

from tilewright.llm import mpeg


def test_round_trip_and_tables():
    for text in (None, "", "x", "a" * 64, "a" * 65, "é" * 5000):
        n, m, data = mpeg.store(text)
        audio = mpeg.parse(data)
        assert mpeg.payload_of(data, audio)[:m] == mpeg.padded(text)[1]
        assert audio.bad_crc == audio.skipped == 0 and audio.table["frames"] == len(audio.offsets)
        assert audio.samples == 1152 * len(audio.offsets) and audio.tags == {"TSSE": "payload"}
        assert audio.table["bytes"] == len(data) - mpeg.parse(data[:0] + data).offsets[0] + (audio.offsets[0] - len(mpeg._TAG)) if audio.offsets else True


def test_resynchronises_after_damage():
    _, _, data = mpeg.store("hello " * 3000)
    good = mpeg.parse(data)
    at = good.offsets[3]
    bad = mpeg.parse(data[:at] + b"\xff\xfbgarbage\xff\xff" * 9 + data[at:])
    assert len(bad.offsets) == len(good.offsets) and bad.skipped == 99
    one = bytearray(data)
    one[good.offsets[5] + 8] ^= 1
    assert mpeg.parse(bytes(one)).bad_crc == 1
    cut = mpeg.parse(data[: good.offsets[-1] + 10])
    assert len(cut.offsets) == len(good.offsets) - 1


def test_headers():
    head = mpeg.parse_header(bytes((0xFF, 0xFB, 0x90, 0x00)))
    assert (head.bitrate, head.rate, head.size, head.samples, head.protected) == (128, 44100, 417, 1152, False)
    assert mpeg.parse_header(b"\xff\xfb\xf0\x00") is None and mpeg.parse_header(b"abcd") is None
    assert mpeg.parse_header(bytes((0xFF, 0xFF, 0x90, 0x00))).layer == 1
    assert mpeg.crc16(b"123456789") == 0xAEE7  # CRC-16 with 0x8005, start 0xFFFF, not reflected


def test_seek():
    _, _, data = mpeg.store("hello " * 3000)
    audio = mpeg.parse(data)
    assert mpeg.seek(audio, 0) == audio.offsets[0] and mpeg.seek(audio, 1152 * 4 + 7) == audio.offsets[4] and mpeg.seek(audio, 10**9) == audio.offsets[-1]


def test_query(documents, texts, none):
    rows = mpeg.features(mpeg.store_texts(documents)).collect()
    assert len(rows) == len(texts)
    by = {r["doc_id"]: r for r in rows}
    for i, t in texts:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = by[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert by[0]["feature"] == by[9]["feature"] and by[0]["media_sha256"] == by[9]["media_sha256"]
    assert mpeg.features(mpeg.store_texts(none)).count() == 0
