"""Packing of tokenised documents into windows by minimum bin slack.

A document's ids are cut at multiples of the window; full pieces fill a window
each.  The rest of every document goes with others into windows: the longest
piece left opens one, and a subset-sum dynamic programme over the multiset of
the remaining lengths (a bitset of reachable fills) finds the lengths whose sum
comes closest to what is free; backtracking through the saved bitsets gives how
often each length is taken.  The same pattern is then used for as many windows
as the counts allow, so that cost goes with different patterns, not windows.

Every input partition packs its own pieces, so no text or token is shuffled.
Only windows that come out nearly full stay: the pieces of all others (ids of
none travel, just where they lie and how long they are) are dealt to groups of
bounded size and packed again, so small partitions cost no padding.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tilewright.llm.common import saved, slices

#: A window stays as its partition packed it if it lacks 1 / SLACK of its tokens at most; pieces to a group of the others.
SLACK, GROUP = 128, 200_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ODD_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


_PLAIN = re.compile(r"([^\W\d_]*)([.,;:!?%&*$#|()\"+=-]*)")


def _byte_letters() -> dict[int, str]:
    """The usual printable stand-ins of byte-level tokenizers: bytes that are
    visible Latin-1 characters stand for themselves, others for 256, 257, ..."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in visible)
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordTokenizer:
    """ids of texts as little-endian unsigned 32-bit bytes.

    The tokenizer splits at white space before anything else, so words are
    encoded by themselves; a bounded cache keeps the results of words met first.
    A word of letters and then punctuation is two pre-tokens, which go to the
    tokenizer's merge model at once; all other words, and texts with rare kinds
    of space, go through the whole tokenizer."""

    def __init__(self, file: str, cache_words: int = 450_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.model = self.tokenizer.model
        self.words: dict[str, bytes] = {}
        self.most = cache_words
        self.letters = _byte_letters()

    def raw(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def pre_token(self, text: str) -> bytes:
        """ids of one pre-token that is lower case already."""
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.model.tokenize(text)], "<u4").tobytes()

    def word(self, word: str) -> bytes:
        parts = _PLAIN.fullmatch(word)
        head, tail = parts.groups() if parts else ("", "")
        lower = head.lower()
        # not: letters that lower-case to a letter and a mark or by what is around, and what normalisation changes
        if parts and (not head or lower.isalpha()) and (word.isascii() or ("Σ" not in head and unicodedata.is_normalized("NFC", lower) and unicodedata.is_normalized("NFC", head))):
            if head and tail:
                found = (self.words.get(head) or self.word(head)) + (self.words.get(tail) or self.word(tail))
            else:
                found = self.pre_token(lower or tail)
            room = self.most // 2 if head and tail else self.most
        else:
            found, room = self.raw(word), self.most
        if len(self.words) < room and len(word) <= 40:
            self.words[word] = found
        return found

    def ids(self, text: str) -> bytes:
        if _ODD_SPACE.search(text):
            return self.raw(text)
        get, word = self.words.get, self.word
        return b"".join([get(w) or word(w) for w in text.split()])


def fill(counts: dict[int, int], lengths: list[int], free: int) -> dict[int, int]:
    """How often to take each of ``lengths`` (descending, with ``counts`` left)
    so that their sum comes closest to ``free`` from below."""
    reach, mask, stages = 1, (1 << (free + 1)) - 1, []
    for length in lengths:
        left = min(counts[length], free // length) if length <= free else 0
        times = 1
        while left > 0:
            take = min(times, left)
            wider = reach | (reach << (length * take)) & mask
            if wider != reach:
                stages.append((length, take, reach))
                reach = wider
            left -= take
            times *= 2
        if reach >> free & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for length, take, before in reversed(stages):
        if not before >> at & 1:
            at -= length * take
            out[length] = out.get(length, 0) + take
    return out


def minimum_bin_slack(lengths: np.ndarray, window: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns (times used, {length: how often in one window}) that use up the
    multiset ``lengths`` (each from 1 to ``window``)."""
    values, n = np.unique(lengths, return_counts=True)
    counts = dict(zip(values.tolist(), n.tolist(), strict=True))
    order = sorted(counts, reverse=True)
    out = []
    while order:
        longest = order[0]
        counts[longest] -= 1
        pattern = fill(counts, order, window - longest)
        counts[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(counts[k] // v for k, v in pattern.items())
        for k, v in pattern.items():
            counts[k] -= times * v
        order = [k for k in order if counts[k]]
        out.append((times, pattern))
    return out


def arrange(length: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, offset, tokens of the sequence) of each piece, sequences from 0."""
    sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    full = np.flatnonzero(length == window)
    sequence[full] = np.arange(len(full))
    used = len(full)
    rest = np.flatnonzero(length < window)
    by_length = rest[np.argsort(length[rest], kind="stable")]
    values, first = np.unique(length[by_length], return_index=True)
    next_of = dict(zip(values.tolist(), first.tolist(), strict=True))
    for times, pattern in minimum_bin_slack(length[rest], window):
        at = 0
        for size, often in sorted(pattern.items(), reverse=True):
            k = next_of[size]
            chosen = by_length[k : k + times * often]
            next_of[size] = k + times * often
            sequence[chosen] = used + np.repeat(np.arange(times), often)
            offset[chosen] = at + size * np.tile(np.arange(often), times)
            at += size * often
        used += times
    return sequence, offset, np.bincount(sequence, length, minlength=used)[sequence]


_tokenizers: dict[str, WordTokenizer] = {}
_FIELDS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_file: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """Packs (doc_id, text) into windows of ``window`` tokens.

    A null or empty text is the end id alone.  Rows are taken one by one:
    repeated doc_ids are packed as often as they come.  Other columns are not
    read.  Gives per piece doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id and offset; an empty table gives no rows."""
    last = np.array([end_id], "<u4").tobytes()

    def batches_of(doc: pa.Array, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(doc), 50_000):
            yield pa.RecordBatch.from_arrays([doc[k : k + 50_000], *(pa.array(c[k : k + 50_000], pa.int64()) for c in columns)], names=["doc_id", *_FIELDS])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_file not in _tokenizers:
            _tokenizers[tokenizer_file] = WordTokenizer(tokenizer_file)
        words = _tokenizers[tokenizer_file]
        parts: list[np.ndarray] = []  # doc_id, is null, start, length, crc, doc_tokens
        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = words.ids(text or "") + last
                n = len(ids) // 4
                for start in range(0, n, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    rows.append((doc or 0, doc is None, start, len(piece) // 4, zlib.crc32(piece), n))
            if rows:
                parts.append(np.array(rows, np.int64))
        if not parts:
            return
        pieces = np.concatenate(parts)
        sequence, offset, tokens = arrange(pieces[:, 3], window)
        base = TaskContext.get().partitionId() << 36
        # a piece whose window isn't full enough has a number of its own, below 0
        sequence = np.where(window - tokens <= window // SLACK, base + sequence, -1 - base - np.arange(len(pieces)))
        yield from batches_of(pa.array(pieces[:, 0], mask=pieces[:, 1].astype(bool)), [*(pieces[:, j] for j in (2, 3, 4, 5)), sequence, offset])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held).combine_chunks()
        columns = [whole.column(name).to_numpy() for name in _FIELDS]
        order = np.argsort(-columns[4], kind="stable")  # the same whatever order the rows come in
        sequence, offset, _ = arrange(columns[1][order], window)
        base = (TaskContext.get().partitionId() << 36) + (1 << 35)
        doc = whole.column("doc_id").combine_chunks().take(pa.array(order))
        yield from batches_of(doc, [*(c[order] for c in columns[:4]), base + sequence, offset])

    packed = saved(docs.select("doc_id", "text").mapInArrow(first, SCHEMA), "packed")
    rest = packed.where("sequence_id < 0")
    groups = max(1, -(-rest.count() // GROUP))
    return packed.where("sequence_id >= 0").union(rest.repartition(groups, "sequence_id").mapInArrow(again, SCHEMA))
