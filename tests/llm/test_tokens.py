import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from tilewright.llm import packing, sentencepiece_codec, separators


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def codec():
    return sentencepiece_codec.PieceCodec(P.path("piece_bpe_32k.model"))


def test_pieces_equal_the_library(codec, library, texts):
    r = random.Random(1)
    for _ in range(5000):
        s = "".join(r.choice("abcdeaaab  ▁\n\t…é中文😀\x00ｆ<s>0x́.,") for _ in range(r.randrange(30)))
        ids = library.encode(s)
        assert codec.encode(s) == ids and codec.decode(ids) == library.decode(ids), repr(s)
        assert codec.digest(s)[0] == len(ids)
    for s in [" " * 3000, "a" * 3000, "\n" * 1000, *(t or "" for _, t in texts)]:
        assert codec.encode(s) == library.encode(s)


def test_piece_query(documents, texts, library, none):
    rows = {r["doc_id"]: r for r in sentencepiece_codec.encode_digests(documents, P.path("piece_bpe_32k.model")).collect()}
    for i, t in texts:
        ids = library.encode(t or "")
        r = rows[i]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert sentencepiece_codec.encode_digests(none, P.path("piece_bpe_32k.model")).count() == 0


def test_fill_is_optimal():
    r = random.Random(4)
    for _ in range(200):
        counts = {r.randrange(1, 20): r.randrange(1, 3) for _ in range(5)}
        free = r.randrange(0, 40)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * j for s in sums for j in range(n + 1)}
        took = packing.fill(counts, sorted(counts, reverse=True), free)
        assert all(took[k] <= counts[k] for k in took)
        assert sum(k * v for k, v in took.items()) == max(s for s in sums if s <= free)


def test_word_tokenizer(texts):
    w = packing.WordTokenizer(P.path("word_bpe_49k.json"))
    r = random.Random(1)
    samples = ["".join(r.choice("abcE  \n\t…é中文😀\x1c1x́'s.,<|endoftext|>²ªİΣßﬁ̈") for _ in range(r.randrange(12))) for _ in range(5000)]
    for s in samples + [t or "" for _, t in texts]:
        assert w.ids(s) == w.raw(s), repr(s)


def test_packing_query(documents, texts, none):
    file = P.path("word_bpe_49k.json")
    rows = packing.pack_documents(documents, file).collect()
    raw = packing.WordTokenizer(file)
    want = sorted((i, np.frombuffer(raw.raw(t or ""), "<u4").tolist() + [1]) for i, t in texts)
    assert len({(r["doc_id"], r["start"]) for r in rows}) <= len(rows)
    ids = dict(want)
    total = {}
    windows = {}
    for r in rows:
        full = ids[r["doc_id"]]
        piece = full[r["start"] : r["start"] + r["length"]]
        assert r["length"] == len(piece) > 0 and r["doc_tokens"] == len(full)
        assert r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes())
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i in ids:
        assert total[i] == len(ids[i]) * sum(i == j for j, _ in texts)
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(none, file).count() == 0


@pytest.mark.parametrize("block", [2, 6, 64, 4 << 20])
def test_separator_scan(documents, texts, none, block):
    rows = separators.document_lengths(documents, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, block_bytes=block if block > 6 else 64 * block).collect()
    tokenizer = separators._tokenizer(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    want = sorted((i, len(tokenizer.encode_ordinary(t or ""))) for i, t in texts)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in rows) == want
    if block == 64:
        assert separators.document_lengths(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_open_tail_and_empty_documents(spark, tmp_path):
    data = np.array([9, 9, 5, 0, 9, 7, 7, 7, 9, 1, 2], "<u4")
    (tmp_path / "a.tok").write_bytes(data.tobytes())
    (tmp_path / "b.tok").write_bytes(b"")
    for step in (4, 12, 4096):
        blocks = separators.list_blocks(spark, str(tmp_path), step, 4)
        found = separators.stitch(separators.scan_blocks(blocks, 9, "<u4")).orderBy("ordinal").collect()
        assert [(r["ordinal"], r["start"], r["n_tokens"], r["closed"]) for r in found] == [(0, 0, 0, True), (1, 1, 0, True), (2, 2, 2, True), (3, 5, 3, True), (4, 9, 2, False)]


def test_small_partitions_cost_no_padding(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 150)
    rows = [(k % 50, "word " * (3 + 37 * k % 1900)) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(60)
    got = packing.pack_documents(df, P.path("word_bpe_49k.json")).toPandas().sort_values(["sequence_id", "offset"])
    by = got.groupby("sequence_id")["length"]
    assert (by.cumsum() - got["length"] == got["offset"]).all() and by.sum().max() <= 2048
    assert got["length"].sum() == sum(3 + 37 * k % 1900 + 1 for k in range(300))
    assert len(by) <= got["length"].sum() / 2048 * 1.02 + 2  # two groups


def test_token_files_are_cleared(spark, documents):
    """What the scan has written goes with the other tables that operators leave."""
    import os

    from tilewright.llm import common, separators
    from tilewright.llm.queries import BYTE_RANKS

    import public_tokenizers

    rows = separators.document_lengths(documents, BYTE_RANKS, public_tokenizers.PATTERN)
    assert rows.count() == documents.count()
    folders = [f.removeprefix("file://") for f in common._folders if "/tokens-" in f]
    assert folders and all(os.path.isdir(f) for f in folders)
    common.clear_saved(spark)
    assert not any(os.path.isdir(f) for f in folders)
