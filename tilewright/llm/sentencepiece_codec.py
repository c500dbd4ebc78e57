"""Exact encoding with a merge-type SentencePiece model, by backtracking.

The greedy tokenizer merges, again and again, the adjacent pair whose union is
the best-scored piece.  Its result is the only sequence of pieces in which every
two neighbours are *compatible*: merging their joint text from single characters
gives just these two.  So a text is encoded from left to right: at each position
the longest piece (one Aho-Corasick pass finds them all) is tried, then its
shorter prefixes; a piece is taken if it is compatible with the one before and
its end is not known to fail.  If none fits, the position is marked as failed in
a bitfield and the piece before is given up.

No piece holds a space mark after another character, so nothing merges across
the start of a word and words are encoded by themselves; results of frequent
words are kept in a bounded cache.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"


class PieceCodec:
    """Encoder and decoder over the pieces and scores of a model file."""

    def __init__(self, model_file: str, cache_words: int = 450_000, cache_pairs: int = 400_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        self.special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.byte_ids = [0] * 256
        self.byte_of: dict[int, int] = {}
        self.piece_of: dict[int, str] = {}
        self.rank: dict[str, tuple[float, int]] = {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_of[i] = int(piece[3:5], 16)
                self.byte_ids[self.byte_of[i]] = i
            elif i not in self.special:
                self.piece_of[i] = piece
                self.rank[piece] = (-model.get_score(i), i)
        if any(MARK in p.lstrip(MARK) for p in self.rank):
            raise ValueError("pieces across words: this model can't be encoded by words")
        self.finder = ahocorasick.Automaton()
        for piece in self.rank:
            self.finder.add_word(piece, len(piece))
        self.finder.make_automaton()
        self.prefixes: dict[str, tuple[str, ...]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words = _Words(self, cache_words)
        self.cache_pairs = cache_pairs

    def merge(self, text: str) -> list[str]:
        """Greedy merging from single characters: best score first, leftmost on a tie."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                found = self.rank.get(parts[k] + parts[k + 1])
                if found is not None and (best is None or found[0] < best):
                    best, at = found[0], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            known = self.merge(left + right) == [left, right]
            if len(self.pairs) < self.cache_pairs:
                self.pairs[key] = known
        return known

    def choices(self, longest: str) -> tuple[str, ...]:
        """A piece and its shorter prefixes that are pieces, the longest first;
        the first character always counts (unknown characters become bytes)."""
        found = self.prefixes.get(longest)
        if found is None:
            found = tuple(longest[:k] for k in range(len(longest), 0, -1) if (k == 1 or longest[:k] in self.rank) and self.merge(longest[:k]) == [longest[:k]])
            self.prefixes[longest] = found
        return found

    def split(self, text: str) -> list[str]:
        """The pieces of a text without inner word starts."""
        n = len(text)
        longest = [1] * n
        for end, size in self.finder.iter(text):
            start = end - size + 1
            if size > longest[start]:
                longest[start] = size
        open_ends = bytearray(b"\1") * (n + 1)  # the bitfield: 0 where all ways on have failed
        path: list[tuple[str, int]] = []  # taken pieces, and which of their choices they were
        at, choice, before = 0, 0, None
        known, choices = self.pairs.get, self.prefixes.get
        while at < n:
            word = text[at : at + longest[at]]
            options = choices(word) or self.choices(word)
            for k in range(choice, len(options)):
                piece = options[k]
                end = at + len(piece)
                if open_ends[end]:
                    fits = True if before is None else known((before, piece))
                    if fits is None:
                        fits = self.compatible(before, piece)
                    if fits:
                        path.append((piece, k))
                        at, choice, before = end, 0, piece
                        break
            else:
                open_ends[at] = 0
                if not path:
                    raise AssertionError("no valid sequence")
                piece, k = path.pop()
                at -= len(piece)
                choice, before = k + 1, path[-1][0] if path else None
        return [p for p, _ in path]

    def word_ids(self, word: str) -> list[int]:
        return self.piece_ids(self.split(word))

    def piece_ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for piece in pieces:
            found = self.rank.get(piece)
            if found is not None:
                out.append(found[1])
            else:
                out.extend(self.byte_ids[b] for b in piece.encode())
        return out

    def chunks(self, text: str) -> list[str]:
        """The words of a text, each with its spaces before it."""
        if not text:
            return []
        text = text.replace(MARK, " ")
        words = text.split(" ")
        if "" in words:
            return re.findall(" +[^ ]*", " " + text)
        return [" " + w for w in words]

    def encode(self, text: str) -> list[int]:
        return [i for w in self.chunks(text) for i in self.word_ids(w.replace(" ", MARK))]

    def raw_text(self, ids: list[int]) -> str:
        """Decoding without the removal of the first space: runs of byte pieces
        are UTF-8, and each byte that isn't becomes U+FFFD."""
        out, run = [], bytearray()
        for i in [*ids, -1]:
            if i in self.byte_of:  # rare: only characters without a piece
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            if i in self.piece_of:
                out.append(self.piece_of[i].replace(MARK, " "))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        out = self.raw_text(ids)
        return out[1:] if ids and self.piece_of.get(ids[0], "").startswith(MARK) else out

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, and the SHA-256 of the joined ids and of the decoded text."""
        found = [self.words[w] for w in self.chunks(text)]
        ids = ",".join([f[0] for f in found])
        decoded = "".join([f[1] for f in found])[1:]
        n = ids.count(",") + 1 if ids else 0
        return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


class _Words(dict):
    """word -> (joined ids, decoded text, first piece, last piece); keeps the
    first words it meets, so frequent ones, up to a bound.

    A word with a tail of other characters is put together from the results of
    its two parts where the pieces at the seam are compatible, for then all
    neighbours are and the sequence is the exact one."""

    def __init__(self, codec: PieceCodec, most: int):
        super().__init__()
        self.codec, self.most = codec, most
        self.parts = re.compile(r"( *\w+)(\W.*)", re.DOTALL).fullmatch

    def __missing__(self, word: str) -> tuple[str, str, str, str]:
        found, room = None, self.most // 3
        if parts := self.parts(word):
            head, tail = self[parts[1]], self[parts[2]]
            if self.codec.compatible(head[3], tail[2]):
                found = f"{head[0]},{tail[0]}", head[1] + tail[1], head[2], tail[3]
        if found is None:
            pieces = self.codec.split(word.replace(" ", MARK))
            ids = self.codec.piece_ids(pieces)
            text = self.codec.raw_text(ids)
            found = ",".join(map(str, ids)), word if text == word else text, pieces[0], pieces[-1]
            room = self.most
        if len(self) < room and len(word) <= 40:
            self[word] = found
        return found


def _utf8(raw: bytes) -> str:
    out, k = [], 0
    while k < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[k : k + size].decode())
                k += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            k += 1
    return "".join(out)


_codecs: dict[str, PieceCodec] = {}


def codec(model_file: str) -> PieceCodec:
    """One codec a worker process and model."""
    if model_file not in _codecs:
        _codecs[model_file] = PieceCodec(model_file)
    return _codecs[model_file]


def encode_pieces(docs: DataFrame, model_file: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the ids of ``text`` as an array column; null is as empty: no ids."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(texts):
        c = codec(model_file)
        return texts.map(lambda t: c.encode(t or ""))

    return docs.withColumn(ids, run(F.col(text)))


def encode_digests(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of whole texts.

    Null and empty texts have no ids; repeated rows give repeated results; an
    empty table gives no rows; further columns are not read.  One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        for batch in batches:
            found = [c.digest(t or "") for t in batch.column(1).to_pylist()]
            n, ids, text = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
