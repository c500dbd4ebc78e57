"""Exact Jaccard self-join of documents on sets of word n-grams, by T-occurrence
search, and the components that its links form.

Documents with equal sets are one *node*.  A first inverted index over three eighths of
all hashes leaves out nodes that have over a quarter of their shingles there alone.
A second one is built over all shingles of the others, split by hash ranges; both travel
as packed arrays, not rows.  Its list lengths give every node the shingles that it shares with any
other; a node with fewer than T = ceil(3/4 of its size) such shingles cannot
link, which leaves few nodes, and only their shared shingles, rarest first.
Shingles that a first pass finds in a large share of the nodes go past the index
to the nodes, as shared and last in the order, so no range holds such a list.

Two sets of sizes a and b link when their overlap is at least 3/7 (a + b), which
is at least T for both, so linked nodes share one of their ``shared - T + 1``
rarest shingles, near enough to the front in both for the rest to suffice: those
lists propose candidates.  The place of a shingle in a node's order bounds the
size of its partners there (``cap``): lists are joined by bands of sizes, and a
node whose cap is below its own size meets only nodes whose cap isn't, so nodes
that share a template, but too little else, don't meet at all.  A candidate is
searched for by DivideSkip: the lists of a query's shingles in a block of nodes
are divided into short ones, merged with a heap, and long ones, probed by binary
search, for nodes that reach the overlap.

Only components are asked for, so links within a component already known are
not needed: each list's nodes are searched against one of them, its lead, and then
every node is searched against each *other* component that shares a candidate
list with its own, smaller against larger.  That leaves no link between two
components untested, and emits no pairs within a group.

Nothing rests on hashes being different.  Nodes whose 64-bit names clash while
their 128-bit digests differ are renamed before anything else, and every link is
checked on the words of both texts at the end; were one false, all is done again
with other hashes.  Only two lists of as many but other nodes whose 64-bit sums agree would
be taken for one run.
"""

from __future__ import annotations

import hashlib
import heapq
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.common import _folders, remove, saved, slices
from tilewright.llm.components import connected_components
from tilewright.llm.shingles import exact_shingles, shingle_sets

WIDTH = 5
#: Shingles that a task packs at once, and nodes of a component and queries in one search block.
PACK, SHARD, SLICE = 1_500_000, 1000, 4000
#: Leads that the lists of one group of nodes have.
LEADS = 4
#: Rows of (block, node) or nodes that may be broadcast, checked by a count; more are joined by shuffles.
MOST_BROADCAST = 200_000
#: A shingle goes past the index if one of these many nodes has it, and so many nodes of a pack at least.
COMMON_SHARE, COMMON_LEAST = 1000, 64
#: Shingles below this hash are the sample by which nodes are left out first: more than a quarter of all.
SAMPLE = 3 << 61
#: Postings of a range of the index, of one of the sample's index, and bits at most of a map of nodes.
RANGE, SAMPLE_RANGE, MOST_BITS = 500_000, 1_500_000, 1 << 29
#: Names that clash are carried by closures; so many are expected only beyond 10^11 documents.
MOST_RENAMED = 10_000
_KINDS = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())


@dataclass(frozen=True)
class Naming:
    """How sets and shingles are hashed: a seed, names that clash, common shingles."""

    seed: int = 0
    renamed: frozenset[int] = frozenset()
    common: bytes = b""

    def sets(self, texts: pa.Array) -> list[np.ndarray]:
        return shingle_sets(texts, WIDTH, self.seed)

    def name(self, digest: bytes) -> int:
        """A node's name: the digest's first eight bytes, or the last ones where those clash."""
        first = int.from_bytes(digest[:8], "little", signed=True)
        return int.from_bytes(digest[8:], "little", signed=True) if first in self.renamed else first


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sampled(shingles: np.ndarray) -> np.ndarray:
    return shingles < np.uint64(SAMPLE)


def document_nodes(docs: DataFrame, naming: Naming) -> DataFrame:
    """(doc_id, n_shingles, sampled, node, digest, common) for every document, node and digest
    null for an empty set, sampled the number of its shingles below SAMPLE; and rows that hold but common, the shingles that many of
    the nodes of one pack have, as (shingle, how many) in turn."""

    def tally(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        many = n >= max(COMMON_LEAST, len(held) * 10 // COMMON_SHARE)
        if many.any():
            found = np.stack((h[many].view(np.int64), n[many]), axis=1).ravel()
            yield batch([None], [None], [None], [None], [None], [found])

    def batch(ids, n, sampled, nodes, digests, common) -> pa.RecordBatch:
        ids = ids if isinstance(ids, pa.Array) else pa.array(ids, pa.int64())
        return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(sampled, pa.int64()), pa.array(nodes, pa.int64()), pa.array(digests, pa.binary()), pa.array(common, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "sampled", "node", "digest", "common"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, seen = [], 0, set()
        for one in slices(batches):
            sets = naming.sets(one.column(1))
            digests = [_digest(s) if len(s) else None for s in sets]
            yield batch(one.column(0), [len(s) for s in sets], [int(_sampled(s).sum()) for s in sets], [naming.name(d) if d else None for d in digests], digests, [None] * len(sets))
            for s, d in zip(sets, digests, strict=True):
                if d is None or d in seen:
                    continue
                seen.add(d)
                held.append(s)
                total += len(s)
                if total >= PACK or len(held) >= 60_000:
                    yield from tally(held)
                    held, total, seen = [], 0, set()
        if held:
            yield from tally(held)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, sampled long, node long, digest binary, common array<long>")


def named_nodes(docs: DataFrame, seed: int = 0) -> tuple[DataFrame, Naming]:
    """(doc_id, n_shingles, sampled, node) in the shared folder, and the naming by which
    equal nodes have equal sets.

    The common shingles that the naming carries are at most COMMON_SHARE times
    the mean set's size (each is in 1 of COMMON_SHARE nodes or COMMON_LEAST)."""
    naming = Naming(seed)
    nodes = saved(document_nodes(docs, naming), "jaccard-documents")
    pairs = nodes.where("common is not null").select(F.explode(F.expr("transform(sequence(0, size(common) div 2 - 1), i -> struct(common[2 * i] as h, common[2 * i + 1] as n))")).alias("pair"))
    least = F.lit(max(COMMON_LEAST, nodes.where("node is not null").count() // COMMON_SHARE))
    common = sorted(r["h"] for r in pairs.select("pair.*").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h").collect())
    naming = Naming(seed, frozenset(), np.sort(np.array(common, np.int64).view(np.uint64)).tobytes())
    clash = nodes.where("node is not null").groupBy("node").agg(F.min(F.hex("digest")).alias("lo"), F.max(F.hex("digest")).alias("hi")).where("lo <> hi").select("node").limit(MOST_RENAMED + 1).collect()
    if len(clash) > MOST_RENAMED:
        raise ValueError(f"over {MOST_RENAMED} names of nodes clash")
    if clash:
        naming = Naming(seed, frozenset(r["node"] for r in clash), naming.common)
        nodes = saved(document_nodes(docs, naming), "jaccard-documents")
    return nodes.where("common is null").select("doc_id", "n_shingles", "sampled", "node"), naming


def _cut(key: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(range, places) for the ranges of the first ``bits`` bits that occur, each in the order of ``key``."""
    order = np.argsort(key, kind="stable")
    top = (key[order] >> np.uint64(64 - bits)).astype(np.int64)
    found, first = np.unique(top, return_index=True)
    for b, lo, hi in zip(found.tolist(), first.tolist(), np.append(first, len(top))[1:].tolist(), strict=True):
        yield b, order[lo:hi]


def _packed_index(docs: DataFrame, bits: int, naming: Naming, stay: np.ndarray | None = None) -> DataFrame:
    """The inverted index of the nodes that ``stay``, a map of bits by the last bits of their
    names, or, without it, of all nodes but only shingles of the sample, as (bucket, nodes, sizes, owner, step): of each hash range
    the nodes met, their sizes, and per posting, by shingle, the node's place and the
    step from the shingle before, in as few bytes as all steps need; the sample's index has no
    sizes.  Common shingles have rows of their own, by range of nodes, with no step but the whole shingle."""
    common = np.frombuffer(naming.common, np.uint64)
    mask = 8 * len(stay) - 1 if stay is not None else 0
    pack = max(PACK, 16 << bits)  # so that ranges of large indexes hold some postings of each pack

    def flush(held: list[np.ndarray], nodes: list[int], whole: list[int]) -> Iterator[pa.RecordBatch]:
        sizes, ids, none = np.array(whole, np.int32), np.array(nodes, np.int64), np.empty(0, np.int32)
        h, owner = np.concatenate(held), np.repeat(np.arange(len(held)), [len(s) for s in held])
        out: list[list] = [[], [], [], [], []]

        def add(*values) -> None:
            for column, value in zip(out, values, strict=True):
                column.append(value if isinstance(value, int) else value.tobytes())

        if len(common):
            past = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h
            for b, at in _cut(ids[owner[past]].view(np.uint64), bits):
                who = owner[past][at]
                add(b, ids[who], none if stay is None else sizes[who], np.empty(0, np.uint8), h[past][at])
            h, owner = h[~past], owner[~past]
        for b, at in _cut(h, bits):
            used, place = np.unique(owner[at], return_inverse=True)
            step = np.diff(h[at], prepend=np.uint64(b << (64 - bits)))
            width = max(1, (int(step.max()).bit_length() + 7) // 8)
            add(b, ids[used], none if stay is None else sizes[used], place.astype("<u2"), step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, _KINDS, strict=True)], names=["bucket", "nodes", "sizes", "owner", "step"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, nodes, whole, total, seen = [], [], [], 0, set()
        for batch in slices(batches, "text"):
            for s in naming.sets(batch.column(0)):
                node = naming.name(_digest(s)) if len(s) else None
                if node is None or node in seen or (stay is not None and not stay[(node & mask) >> 3] >> (node & 7) & 1):
                    continue
                if len(seen) < 200_000:  # spares most copies; the rest are found equal later
                    seen.add(node)
                whole.append(len(s))
                held.append(s[_sampled(s)] if stay is None else s)
                nodes.append(node)
                total += len(held[-1])
                if total >= pack or len(held) >= 60_000:
                    yield from flush(held, nodes, whole)
                    held, nodes, whole, total = [], [], [], 0
        if held:
            yield from flush(held, nodes, whole)

    return docs.select("text").mapInArrow(run, "bucket int, nodes binary, sizes binary, owner binary, step binary")


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each range that a task has got."""
    by: dict[int, list[tuple]] = {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            by.setdefault(row[0], []).append(row)
    while by:
        yield by.popitem()[1]


def _postings(row: tuple, bits: int) -> tuple[np.ndarray, ...]:
    """(shingle, node, size) of the postings of a row of the index, without size in the sample's."""
    place = np.frombuffer(row[3], "<u2")
    step = np.zeros((len(place), 8), np.uint8)
    step[:, : len(row[4]) // len(place)] = np.frombuffer(row[4], np.uint8).reshape(len(place), -1)
    h = np.cumsum(step.view("<u8").ravel(), dtype=np.uint64) + np.uint64(row[0] << (64 - bits))
    sizes = [np.frombuffer(row[2], np.int32)[place]] if len(row[2]) else []
    return h, np.frombuffer(row[1], np.int64)[place], *sizes


def _map_of(nodes: DataFrame, count: int) -> np.ndarray:
    """Map of bits by the last bits of (node): 16 bits for each of ``count`` nodes, MOST_BITS at most."""
    size = min(MOST_BITS, 1 << max(15, (16 * count).bit_length()))
    place = F.pmod("node", F.lit(size)) + 1
    out = np.zeros(size // 8, np.uint8)
    for r in nodes.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).toLocalIterator():
        out[(r["part"] - 1) * 4096 : r["part"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def _range_counts(index: DataFrame, bits: int, ranges: int) -> DataFrame:
    """(range, node, shared): of each range of shingles, how many its nodes share with another
    one, as packed arrays by range of nodes (2^``ranges``): a node costs no row for each range of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_range(batches):
            parts = [np.frombuffer(r[1], np.int64) for r in rows if not len(r[3])]  # once for each common shingle
            found = [_postings(r, bits) for r in rows if len(r[3])]
            if found:
                h, node = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.argsort(h, kind="stable")
                h, node = h[order], node[order]
                same = h[1:] == h[:-1]
                many = np.concatenate((same, [False])) | np.concatenate(([False], same))
                h, node = h[many], node[many]
                order = np.lexsort((node, h))
                h, node = h[order], node[order]
                fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (node[1:] != node[:-1]))) if len(h) else np.empty(0, bool)
                h, node = h[fresh], node[fresh]
                same = h[1:] == h[:-1]
                parts.append(node[np.concatenate((same, [False])) | np.concatenate(([False], same))] if len(h) else node)
            each, count = np.unique(np.concatenate(parts), return_counts=True)
            out = [(b, each[at].tobytes(), count[at].astype(np.int32).tobytes()) for b, at in _cut(each.view(np.uint64), ranges)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _KINDS[:3], strict=True)], names=["range", "node", "shared"])

    return index.repartitionById(1 << bits, F.col("bucket")).mapInArrow(run, "range int, node binary, shared binary")


def _counts(index: DataFrame, bits: int) -> DataFrame:
    """(node, shared): how many of its sampled shingles a node shares with another one; nodes without any have no row."""
    ranges = max(4, bits - 2)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_range(batches):
            node, count = (np.concatenate([np.frombuffer(r[k], kind) for r in rows]) for k, kind in ((1, np.int64), (2, np.int32)))
            each, at = np.unique(node, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(each), pa.array(np.bincount(at, count).astype(np.int64))], names=["node", "shared"])

    return _range_counts(index, bits, ranges).repartitionById(1 << ranges, F.col("range")).mapInArrow(add, "node long, shared long")


def staying(docs: DataFrame, nodes: DataFrame, bits: int, naming: Naming) -> tuple[np.ndarray, int]:
    """(map of bits, postings) of the nodes (node, n_shingles, sampled) that may link, by a
    sample of the shingles: a node of which more than a quarter of its shingles are in the
    sample and in no other node has fewer than T shared ones, whatever the others are.

    A node that stays only because another one has its bit in the map costs postings, but
    no link is lost."""
    shared = _counts(_packed_index(docs, bits, naming), bits)
    known = nodes.where("node is not null").groupBy("node").agg(F.max("n_shingles").alias("n"), F.max("sampled").alias("sampled"))
    stay = saved(known.join(shared, "node", "left").where("4 * (sampled - coalesce(shared, 0)) <= n").select("node", "n"), "jaccard-staying", scratch := [])
    total = stay.agg(F.count("*").alias("nodes"), F.sum("n").alias("n")).first()
    out = _map_of(stay, total["nodes"])
    remove(docs.sparkSession, scratch)
    return out, total["n"] or 0


def _shared_postings(packed: DataFrame, bits: int) -> DataFrame:
    """The postings of lists with two nodes or more, as (range, node, size, h, df, who)
    arrays by ranges of nodes; common shingles have the largest df.  ``who`` is the same
    for lists of the same nodes: a sum over hashes of all of them."""

    def listed(rows: list[tuple]) -> tuple[np.ndarray, ...]:
        h, node, size = (np.concatenate(x) for x in zip(*(_postings(r, bits) for r in rows), strict=True))
        order = np.argsort(h, kind="stable")
        h, node, size = h[order], node[order], size[order]
        same = h[1:] == h[:-1]
        many = np.concatenate((same, [False])) | np.concatenate(([False], same))
        h, node, size = h[many], node[many], size[many]
        order = np.lexsort((node, h))
        h, node, size = h[order], node[order], size[order]
        fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (node[1:] != node[:-1]))) if len(h) else np.empty(0, bool)
        h, node, size = h[fresh], node[fresh], size[fresh]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.empty(0, np.int64)
        count = np.diff(np.append(first, len(h)))
        df = np.repeat(count, count)
        who = np.repeat(np.add.reduceat(_mixed(node.view(np.uint64)), first), count) if len(h) else np.empty(0, np.uint64)
        return tuple(x[df > 1] for x in (h, node, size, df, who))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_range(batches):
            found = [r for r in rows if len(r[3])]
            parts = [listed(found)] if found else []
            for r in rows:
                if not len(r[3]):
                    h = np.frombuffer(r[4], np.uint64)
                    parts.append((h, np.frombuffer(r[1], np.int64), np.frombuffer(r[2], np.int32), np.full(len(h), 2**31 - 1), h))
            h, node, size, df, who = (np.concatenate(x) for x in zip(*parts, strict=True))
            out: list[list] = [[], [], [], [], [], []]
            for b, at in _cut(node.view(np.uint64), bits):
                for column, value in zip(out, (b, node[at].tobytes(), size[at].tobytes(), h[at].tobytes(), np.minimum(df[at], 2**31 - 1).astype(np.int32).tobytes(), who[at].tobytes()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (*_KINDS, pa.binary()), strict=True)], names=["range", "node", "size", "h", "df", "who"])

    return packed.repartitionById(1 << bits, F.col("bucket")).mapInArrow(run, "range int, node binary, size binary, h binary, df binary, who binary")


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose sums tell sets apart."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _linkable(shared: DataFrame, bits: int) -> DataFrame:
    """(node, n, shingles, runs, weights): nodes that share at least T of their shingles,
    those shingles in the global order: shorter lists first, then by hash; and the runs
    of them whose lists have the same nodes, an eighth of its size and more, with their
    shingles' number: whoever has one shingle of a run has all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_range(batches):
            node, size, h, df, who = (np.concatenate([np.frombuffer(r[k], kind) for r in rows]) for k, kind in ((1, np.int64), (2, np.int32), (3, np.uint64), (4, np.int32), (5, np.uint64)))
            _, start, each, count = np.unique(node, return_index=True, return_inverse=True, return_counts=True)
            order = np.flatnonzero((count >= -(-3 * size[start].astype(np.int64) // 4))[each])
            order = order[np.lexsort((h[order], df[order], node[order]))]
            node, size, h, df, who = node[order], size[order], h[order], df[order], who[order]
            fresh = np.concatenate(([True], (node[1:] != node[:-1]) | (h[1:] != h[:-1]))) if len(node) else np.empty(0, bool)
            node, size, h, df, who = node[fresh], size[fresh], h[fresh], df[fresh], who[fresh]  # common shingles of a node that two tasks have packed
            _, start, each, count = np.unique(node, return_index=True, return_inverse=True, return_counts=True)
            keep = (count >= -(-3 * size[start].astype(np.int64) // 4))[each]
            node, size, h, df, who = node[keep], size[keep], h[keep], df[keep], who[keep]
            first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1]))) if len(node) else np.empty(0, np.int64)

            def lists(ends: np.ndarray, values: np.ndarray) -> pa.Array:
                return pa.LargeListArray.from_arrays(pa.array(ends.astype(np.int64)), pa.array(values.view(np.int64))).cast(pa.list_(pa.int64()))

            order = np.lexsort((who, df, node))
            by, of, long = node[order], who[order], df[order]
            begins = np.flatnonzero(np.concatenate(([True], (by[1:] != by[:-1]) | (of[1:] != of[:-1]) | (long[1:] != long[:-1])))) if len(by) else np.empty(0, np.int64)
            weight = np.diff(np.append(begins, len(by)))
            heavy = 8 * weight >= size[order][begins]
            begins, weight = begins[heavy], weight[heavy]
            names = _mixed(of[begins] ^ _mixed(long[begins].astype(np.uint64)))
            ends = np.append(np.searchsorted(by[begins], node[first]), len(begins))
            yield pa.RecordBatch.from_arrays([pa.array(node[first]), pa.array(size[first].astype(np.int64)), lists(np.append(first, len(node)), h), lists(ends, names), lists(ends, weight.astype(np.int64))], names=["node", "n", "shingles", "runs", "weights"])

    return shared.repartitionById(1 << bits, F.col("range")).mapInArrow(run, "node long, n long, shingles array<long>, runs array<long>, weights array<long>")


def divide_skip(lists: list[list[int]], least: int, weight: float = 0.01) -> list[tuple[int, int]]:
    """(id, occurrences) of the ids in at least ``least`` of the sorted lists.

    The longest lists (as many as ``least / (weight * log2(longest) + 1)``) are
    set apart; the others are merged with a heap, and an id that occurs often
    enough there to still reach ``least`` is looked up in the long ones."""
    if len(lists) < least or least < 1:
        return []
    lists = sorted(lists, key=len)
    longest = len(lists[-1])
    apart = min(least - 1, int(least / (weight * np.log2(max(longest, 2)) + 1)))
    short, long = lists[: len(lists) - apart], lists[len(lists) - apart :]
    out = []

    def probe(x: int, n: int) -> None:
        if n < least - apart:
            return
        left = apart
        for one in long:
            if n + left < least:
                return
            k = bisect_left(one, x)
            n += k < len(one) and one[k] == x
            left -= 1
        if n >= least:
            out.append((x, n))

    last, n = None, 0
    for x in heapq.merge(*short):
        if x == last:
            n += 1
        else:
            if last is not None:
                probe(last, n)
            last, n = x, 1
    if last is not None:
        probe(last, n)
    return out


def _search_block(members: list[tuple], queries: list[tuple], one_each: bool) -> list[tuple[int, int]]:
    """Links (query, member) between the queries and members of a block; rows are
    (node, n, shingles).  Members that are connected need but one link a query."""
    h = np.concatenate([m[2] for m in members])
    place = np.repeat(np.arange(len(members)), [len(m[2]) for m in members])
    order = np.argsort(h, kind="stable")
    h, place = h[order], place[order]
    sizes = [m[1] for m in members]
    out = []
    for node, n, shingles in queries:
        lo, hi = np.searchsorted(h, shingles), np.searchsorted(h, shingles, side="right")
        found = hi > lo
        lists = [place[a:b].tolist() for a, b in zip(lo[found], hi[found], strict=True)]
        for k, overlap in divide_skip(lists, -(-3 * n // 4)):
            if 7 * overlap >= 3 * (n + sizes[k]) and members[k][0] != node:
                out.append((node, members[k][0]))
                if one_each:
                    break
    return out


def _search(queries: DataFrame, members: DataFrame, active: DataFrame, scratch: list[str], one_each: bool = False) -> DataFrame:
    """Links (a, b) between the queries and the members of each block, both as (block, node).

    A block is cut into shards of its members and slices of its queries, so
    that no task has more than SHARD of the one and about SLICE of the other."""
    ends = members.select("block", "node", F.lit(False).alias("asks")).union(queries.select("block", "node", F.lit(True)))
    cuts = ends.groupBy("block").agg(F.ceil(F.count_if(~F.col("asks")) / SHARD).cast("int").alias("shards"), F.ceil(F.count_if("asks") / SLICE).cast("int").alias("slices"))
    own = {"shard": F.array(F.pmod(F.xxhash64("node", F.lit(3)), F.col("shards")).cast("int")), "slice": F.array(F.pmod(F.xxhash64("node", F.lit(4)), F.col("slices")).cast("int"))}
    every = {"shard": F.sequence(F.lit(0), F.col("shards") - 1), "slice": F.sequence(F.lit(0), F.col("slices") - 1)}
    rows = ends.join(cuts.where("shards > 0 and slices > 0"), "block")
    rows = rows.select("block", "node", "asks", F.when(F.col("asks"), own["slice"]).otherwise(every["slice"]).alias("slice"), F.explode(F.when(F.col("asks"), every["shard"]).otherwise(own["shard"])).alias("shard"))
    marked = rows.select("block", "node", "asks", F.explode("slice").alias("slice"), "shard")
    marked = saved(marked, "jaccard-blocks", scratch)
    few = marked.count() <= MOST_BROADCAST
    rows = active.join(F.broadcast(marked) if few else marked, "node").select("block", "shard", "slice", "asks", "node", "n", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, queries = None, [], []

        def done() -> pa.RecordBatch:
            found = _search_block(members, queries, one_each) if members and queries else []
            a, b = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            asks, node, n = (batch.column(k).to_pylist() for k in (3, 4, 5))
            lists = batch.column(6)
            for i, key in enumerate(keys):
                if key != now or len(queries) >= SLICE:
                    if queries:
                        yield done()
                    if key != now:
                        now, members = key, []
                    queries = []
                (queries if asks[i] else members).append((node[i], n[i], lists[i].values.to_numpy()))
        if queries:
            yield done()

    return rows.repartition("block", "shard", "slice").sortWithinPartitions("block", "shard", "slice", "asks").mapInArrow(run, "a long, b long")


def with_common_runs(nodes: DataFrame, naming: Naming) -> DataFrame:
    """Nodes (node, n, shingles, runs, weights) in the shared folder, also with the runs of
    common shingles, whose lists no range has held: those that the same of these nodes have.

    Of each common shingle a sum over its nodes is put together from all tasks; there are
    no more of them than the naming carries already."""
    common = np.frombuffer(naming.common, np.uint64)
    if not len(common):
        return nodes

    def columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the node in the batch, place of the shingle, node's hash) of common shingles."""
        lists = batch.column(2)
        h = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        held = common[at] == h
        return owner[held], at[held], _mixed(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))[owner[held]]

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(len(common), np.uint64), np.zeros(len(common), np.int64)
        for batch in batches:
            _, at, who = columns(batch)
            np.add.at(total, at, who)
            count += np.bincount(at, minlength=len(common))
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array((total[held] >> np.uint64(32)).astype(np.int64)), pa.array((total[held] & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(count[held])], names=["at", "high", "low", "count"])

    rows = nodes.mapInArrow(tally, "at long, high long, low long, count long").groupBy("at").agg(*(F.sum(c).alias(c) for c in ("high", "low", "count"))).collect()
    name = np.zeros(len(common), np.uint64)
    for r in rows:
        name[r["at"]] = ((r["high"] << 32) + r["low"]) % (1 << 64)
    count = np.zeros(len(common), np.uint64)
    count[[r["at"] for r in rows]] = [r["count"] for r in rows]
    name = _mixed(name ^ _mixed(count + np.uint64(1)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, at, _ = columns(batch)
            n = batch.column(1).to_numpy(zero_copy_only=False)
            order = np.lexsort((name[at], owner))
            by, of = owner[order], name[at][order]
            begins = np.flatnonzero(np.concatenate(([True], (by[1:] != by[:-1]) | (of[1:] != of[:-1])))) if len(by) else np.empty(0, np.int64)
            weight = np.diff(np.append(begins, len(by)))
            heavy = 8 * weight >= n[by[begins]]
            runs, weights = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for k, w, run in zip(by[begins][heavy].tolist(), weight[heavy].tolist(), of[begins][heavy].view(np.int64).tolist(), strict=True):
                runs[k].append(run)
                weights[k].append(w)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(runs, pa.list_(pa.int64())), pa.array(weights, pa.list_(pa.int64()))], names=["node", "n", "shingles", "runs", "weights"])

    return nodes.mapInArrow(add, "node long, n long, shingles array<long>, runs array<long>, weights array<long>")


def _band(size: Column) -> Column:
    """An eighth of a doubling: sizes of one band differ by a twelfth at most."""
    return F.floor(F.log2(size.cast("double")) * 8).cast("int")


def _spare(a: Column, b: Column) -> Column:
    """Most shingles that one of two linked sets of these bands can have apart from the other."""
    low = lambda v: F.pow(F.lit(2.0), v / 8)
    high = lambda v: F.pow(F.lit(2.0), (v + 1) / 8)
    return F.greatest(4 * high(a) - 3 * low(b), 4 * high(b) - 3 * low(a)) / 7


def with_marks(nodes: DataFrame) -> DataFrame:
    """Nodes (n, runs, weights) with ``marks``: for each band that their partners' sizes can
    be in, the hash of the runs that are larger than what linked sets of both bands
    can have apart.  Linked nodes share all of these runs, each one's and the other's, so
    both have the same mark for each other's band."""
    own = _band(F.col("n"))
    bands = F.sequence(_band(F.ceil(F.col("n") * 3 / 4)), _band(F.floor(F.col("n") * 4 / 3)))

    def mark(band: Column) -> Column:
        large = F.filter(F.arrays_zip("runs", "weights"), lambda r: r["weights"] > _spare(own, band) + 1e-6)
        return F.struct(band.alias("band"), F.xxhash64(F.array_sort(F.transform(large, lambda r: r["runs"]))).alias("mark"))

    return nodes.withColumn("marks", F.transform(bands, mark))


def _meetings(here: DataFrame, scratch: list[str]) -> DataFrame:
    """(block, node): nodes to search for in another component that shares a
    candidate list with theirs, the smaller component's nodes in the larger.

    ``here`` is (h, node, n, cap, comp, size, marks).  Two nodes can link over a list only
    if each one's size is at most the other's cap and at least 3/4 of the other's
    size, and if their marks agree; of two caps one at least isn't below its node's own
    size (strong)."""
    here = here.withColumn("strong", F.col("cap") >= F.col("n")).withColumn("own", _band(F.col("n")))
    mixed = here.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("strong").alias("any")).where("lo <> hi and any").select("h")
    here = saved(here.join(mixed, "h", "left_semi"), "jaccard-mixed", scratch)  # few lists hold several components
    met = here.select("h", "node", "n", "cap", "comp", "size", "strong", "own", F.explode("marks").alias("m")).select("*", F.col("m.band").alias("other"), F.col("m.mark").alias("mark")).drop("m")
    # of each list the components by band, and by the marks for each band of those who ask
    lists = met.groupBy("h", F.col("own").alias("band"), F.col("other").alias("asking"), "mark", "strong", "comp").agg(F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.max("cap").alias("most_cap"), F.max("size").alias("size"))
    lists = saved(lists, "jaccard-lists", scratch)
    place = ["h", "band", "asking", "mark"]
    lists = lists.select(*place, "strong", F.col("comp").alias("block"), F.col("size").alias("block_size"), "least_n", "most_n", "most_cap")
    asks = met.where(F.col("other") <= _band(F.least("cap", F.floor(F.col("n") * 4 / 3))))
    others = F.when(F.col("strong"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))
    asks = asks.select("h", "node", "n", "cap", "comp", "size", F.col("other").alias("band"), F.col("own").alias("asking"), "mark", F.explode(others).alias("strong"))
    smaller = "(size < block_size or size = block_size and comp < block)"
    meet = "4 * most_n >= 3 * n and 4 * n >= 3 * least_n and least_n <= cap and most_cap >= n"
    return asks.join(lists, [*place, "strong"]).where(f"{smaller} and {meet}").select("block", "node").distinct()


def node_links(docs: DataFrame, nodes: DataFrame, naming: Naming, scratch: list[str]) -> tuple[DataFrame, DataFrame]:
    """(a, b) links that connect all nodes of each component, and (node, comp) of all nodes linked."""
    parts = docs.rdd.getNumPartitions()
    bits = max(4, int(np.ceil(np.log2(max(parts, 1)))) + 1)
    sampled = nodes.agg(F.sum("sampled")).first()[0] or 0
    stay, postings = staying(docs, nodes, min(bits, max(4, (sampled * 8 // 3 // SAMPLE_RANGE).bit_length())), naming)
    bits = min(bits, max(4, (postings // RANGE).bit_length()))
    active = saved(_linkable(_shared_postings(_packed_index(docs, bits, naming, stay), bits), bits), "jaccard-nodes", scratch)
    active = saved(with_marks(with_common_runs(active, naming)).drop("runs", "weights"), "jaccard-marked", scratch)
    least = F.ceil(F.col("n") * 3 / 4)
    head = F.slice("shingles", F.lit(1), (F.size("shingles") - least + 1).cast("int"))
    rare = active.select("node", "n", "marks", F.size("shingles").alias("shared"), F.posexplode(head).alias("at", "h"))
    # with n - shared + at words passed, 4 n - 7 passed is at least 3 times the size of any set whose first common shingle is here
    cap = F.floor((4 * F.col("n") - 7 * (F.col("n") - F.col("shared") + F.col("at"))) / 3)
    rare = rare.select("h", "node", "n", "marks", cap.alias("cap"), F.floor(F.col("shared") * -1000 / F.col("n")).alias("alone")).where("4 * cap >= 3 * n")
    # the node that shares most of its shingles leads a list: a group's middle, to which whoever can link mostly does;
    # where several do, lists fall into LEADS kinds, so that a group has as many leads
    rank = F.struct("alone", F.xxhash64("node", F.pmod("h", F.lit(LEADS))).alias("r"), F.col("node").alias("lead"), F.col("n").alias("lead_n"), F.col("cap").alias("lead_cap"))
    leads = rare.groupBy("h").agg(F.min(rank).alias("lead"), F.count("*").alias("nodes")).where("nodes > 1").select("h", "lead.*").drop("alone", "r")
    near = "4 * least(n, lead_n) >= 3 * greatest(n, lead_n) and cap >= lead_n and lead_cap >= n and node <> lead"
    rare = rare.drop("alone")
    pairs = saved(rare.join(leads, "h").where(near).select(F.col("lead").alias("block"), "node").distinct(), "jaccard-stars", scratch)
    asked = pairs.select("block", F.col("block").alias("node")).distinct()
    links = saved(_search(asked, pairs, active, scratch), "jaccard-links", scratch)
    kept: list[str] = []
    comps = connected_components(links, keep=kept)
    sized = saved(comps.join(comps.groupBy("comp").agg(F.count("*").alias("size")), "comp"), "jaccard-sizes", scratch)
    here = rare.join(sized, "node", "left").withColumn("comp", F.coalesce("comp", "node")).withColumn("size", F.coalesce("size", F.lit(1)))
    queries = saved(_meetings(here, scratch), "jaccard-queries", scratch)
    every = active.select("node").join(comps, "node", "left").select(F.coalesce("comp", "node").alias("block"), "node")
    found = saved(_search(queries, every, active, scratch, one_each=True), "jaccard-links", scratch)
    if not found.head(1):
        _folders.extend(kept)
        return links, comps
    scratch.extend(kept)
    links = links.union(found)
    return links, connected_components(links)


def false_links(docs: DataFrame, links: DataFrame, naming: Naming, scratch: list[str]) -> DataFrame:
    """(a, b) of the links whose texts' shingles, as words, don't reach the threshold."""
    links = links.distinct()
    shards = links.groupBy("a").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"))
    ends = links.join(shards, "a").select("a", "b", "shards", F.pmod(F.xxhash64("b"), F.col("shards")).cast("int").alias("shard"))
    leads = shards.select("a", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.col("a").alias("node"))
    rows = saved(ends.select("a", "shard", F.col("b").alias("node"), F.lit(1).alias("k")).union(leads.select("a", "shard", "node", F.lit(0).alias("k"))), "jaccard-ends", scratch)
    wanted = rows.select("node").distinct()

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            nodes = [naming.name(_digest(s)) if len(s) else None for s in naming.sets(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), batch.column(0)], names=["node", "text"])

    few = wanted.count() <= MOST_BROADCAST
    texts = docs.select("text").mapInArrow(name, "node long, text string").join(F.broadcast(wanted) if few else wanted, "node", "left_semi")
    texts = texts.groupBy("node").agg(F.min("text").alias("text"))
    rows = rows.join(texts, "node").select("a", "shard", "k", "node", "text").repartition("a", "shard").sortWithinPartitions("a", "shard", "k")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lead = None, set()
        for batch in batches:
            bad: list[tuple[int, int]] = []
            for a, shard, k, node, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = exact_shingles(text, WIDTH)
                if k == 0:
                    now, lead = (a, shard), own
                elif now != (a, shard) or 7 * len(lead & own) < 3 * (len(lead) + len(own)):
                    bad.append((a, node))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in bad], pa.int64()), pa.array([x for _, x in bad], pa.int64())], names=["a", "b"])

    return rows.mapInArrow(check, "a long, b long")


def document_components(docs: DataFrame, tries: int = 3) -> tuple[DataFrame, Naming]:
    """(doc_id, n_shingles, node, comp) of every row whose set isn't empty, and of
    the others with null for both; and the naming of the nodes."""
    for seed in range(tries):
        nodes, naming = named_nodes(docs, seed)
        scratch: list[str] = []
        links, comps = node_links(docs, nodes, naming, scratch)
        wrong = false_links(docs, links, naming, scratch).head(1)
        remove(docs.sparkSession, scratch)
        if not wrong:
            linked = nodes.where("node is not null").join(comps, "node", "left").select("doc_id", "n_shingles", "node", F.coalesce("comp", "node").alias("comp"))
            return linked.union(nodes.where("node is null").select("doc_id", "n_shingles", "node", F.col("node").alias("comp"))), naming
    raise RuntimeError(f"{tries} kinds of hashes have each given a false link")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of whole texts.

    Null and empty texts and texts without words have an empty set and are their
    own component; equal texts always share one; rows with a null doc_id count
    as documents, but no component is named after them unless all of it are
    such (then it is null); repeated rows give repeated results; an empty table
    gives no rows; further columns are not read."""
    rows, _ = document_components(docs)
    # written, so that the join's shuffles stand alone and a large component's rows can be dealt to several tasks
    smallest = saved(rows.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id")), "jaccard-names")
    named = rows.where("comp is not null").join(smallest, "comp").select("doc_id", "n_shingles", "component_id")
    return named.union(rows.where("comp is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each component stays, with all its columns: that with the smallest
    doc_id (null after all others); of rows that agree in doc_id and set, the one
    with the smallest text.

    Texts without words are linked with nothing, so each such row stays.  Where
    two texts share a doc_id, each is judged by its own component.  An empty table
    stays empty; columns may have any names but those that begin with ``_jaccard_``."""
    rows, naming = document_components(docs)
    rows = rows.where("node is not null")
    per = saved(rows.groupBy("comp", "doc_id", "node").count(), "jaccard-rows")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")
    first = saved(per.groupBy("comp").agg(F.min(order).alias("first")), "jaccard-first")
    marked = per.join(first, "comp").select("doc_id", "node", "count", (order == F.col("first")).alias("stays"))
    marked = saved(marked.where("not stays or count > 1"), "jaccard-others")

    def names(texts: pa.Array) -> list[int | None]:
        whole = pa.RecordBatch.from_arrays([texts], names=["text"])
        return [naming.name(_digest(s)) if len(s) else None for one in slices([whole]) for s in naming.sets(one.column(0))]

    @F.arrow_udf("long")
    def name(texts: pa.Array) -> pa.Array:
        return pa.array(names(texts), pa.int64())

    # rows without words: a key of their own each, that no other has
    node = F.coalesce("_jaccard_name", F.xxhash64("doc_id"))

    def named(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_jaccard_name", name("text")).withColumn("_jaccard_node", node).withColumn("_jaccard_empty", F.col("_jaccard_name").isNull())

    keys = marked.select(F.col("node").alias("_jaccard_right"), F.col("doc_id").alias("_jaccard_id"), F.lit(False).alias("_jaccard_full"), "stays")
    same = (F.col("_jaccard_node") == F.col("_jaccard_right")) & F.col("doc_id").eqNullSafe(F.col("_jaccard_id")) & (F.col("_jaccard_empty") == F.col("_jaccard_full"))
    count = marked.count()
    if count <= MOST_BROADCAST:
        kept = named(docs).join(F.broadcast(keys), same, "left_anti").select(*docs.columns)
    else:  # only texts whose node may be among these are shuffled
        going = _map_of(marked.select("node").distinct(), count)

        @F.arrow_udf("boolean")
        def may_go(texts: pa.Array) -> pa.Array:
            places = [None if n is None else n & 8 * len(going) - 1 for n in names(texts)]
            return pa.array([p is not None and bool(going[p >> 3] >> (p & 7) & 1) for p in places])

        few = named(docs.where(may_go("text"))).join(keys, same, "left_anti").select(*docs.columns)
        kept = docs.where(~may_go("text")).union(few)
    again = keys.where("stays")
    if not again.head(1):
        return kept
    # rows that come several times: the first by text
    some = docs.join(again.select("_jaccard_id").distinct(), F.col("doc_id").eqNullSafe(F.col("_jaccard_id")), "left_semi").withColumn("_jaccard_name", name("text"))
    some = some.where("_jaccard_name is not null").withColumn("_jaccard_node", F.col("_jaccard_name")).withColumn("_jaccard_empty", F.lit(False)).join(again, same, "left_semi")
    k = F.row_number().over(Window.partitionBy("_jaccard_node", "doc_id").orderBy("text"))
    return kept.union(some.withColumn("_jaccard_k", k).where("_jaccard_k = 1").select(*docs.columns))
