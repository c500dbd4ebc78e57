"""Documents in flat token files, found by their end-of-document identifiers.

A token file is a plain sequence of little-endian unsigned integers without an
index.  The scan reads byte ranges (blocks) of all files in parallel; a
vectorised comparison finds the separators of each block.  A block knows neither
how many documents came before it nor where the document that it begins in
started, so blocks give short summaries, a prefix scan over each file's
summaries gives both, and the blocks' local rows are stitched to it.

Tokens never travel: only one row per document and one per block do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.llm.common import _folders, saved, shared_dir, slices

MANIFEST = "doc_id long, file string, ordinal long, tokens_crc32 long"


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a URI; Hadoop's own names of S3 and Azure stores are known too."""
    scheme, colon, rest = uri.partition("://")
    uri = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}.get(scheme, scheme) + colon + rest
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_token_files(docs: DataFrame, folder: str, ranks_file: str, pattern: str, end_id: int = 50256) -> DataFrame:
    """Writes the ids of (doc_id, text) with ``end_id`` after each document, one
    file per partition, and returns doc_id, file, ordinal of each document.

    A text's own ids never hold ``end_id``; null and empty texts are a separator
    alone.  A file appears under its name only when it is whole, and a task that
    runs again writes the same file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        tokenizer = _tokenizer(ranks_file, pattern)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        name, ordinal = f"{root}/part-{part:06d}.tok", 0
        out = None
        for batch in slices(batches):
            out = out or store.open_output_stream(f"{name}.{attempt}")
            crcs = []
            for text in batch.column(1).to_pylist():
                ids = np.array([*tokenizer.encode_ordinary(text or ""), end_id], "<u2")
                raw = ids.tobytes()
                crcs.append(zlib.crc32(raw[:-2]))
                out.write(raw)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f"part-{part:06d}.tok"] * n), pa.array(np.arange(ordinal, ordinal + n)), pa.array(crcs, pa.int64())], names=["doc_id", "file", "ordinal", "tokens_crc32"])
            ordinal += n
        if out is not None:
            out.close()
            store.move(f"{name}.{attempt}", name)

    return docs.select("doc_id", "text").mapInArrow(run, MANIFEST)


_tokenizers: dict[str, object] = {}


def _tokenizer(ranks_file: str, pattern: str):
    if ranks_file not in _tokenizers:
        import base64

        import tiktoken

        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _tokenizers[ranks_file] = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _tokenizers[ranks_file]


def list_blocks(spark: SparkSession, folder: str, block_bytes: int, width: int) -> DataFrame:
    """(file, block, path, start, size): byte ranges of whole tokens over all token
    files.  Spark lists the files; contents aren't read here."""
    step = block_bytes - block_bytes % width
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder).select("path", "length")
    files = files.where(F.col("length") > 0).withColumn("file", F.element_at(F.split("path", "/"), -1))
    blocks = files.select("path", "file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {step}"))).alias("block"))
    return blocks.select("path", "file", "block", (F.col("block") * step).alias("start"), F.least(F.lit(step), F.col("length") - F.col("block") * step).alias("size"))


def scan_blocks(blocks: DataFrame, end_id: int, dtype: str = "<u2", rows: int = 200_000) -> DataFrame:
    """Per block: its number of tokens and the positions (in tokens, within the
    file) just after each of its separators, as rows of at most ``rows`` positions.

    (file, block, first, tokens, part, ends)"""
    width = np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "block", "first", "tokens", "part", "ends"]
        for batch in batches:
            for path, file, block, start, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, name = _store(path)
                with store.open_input_file(name) as data:
                    raw = data.read_at(size, start)
                tokens = np.frombuffer(raw[: len(raw) - len(raw) % width], dtype)
                first = start // width
                ends = np.flatnonzero(tokens == end_id) + (first + 1)
                for part, k in enumerate(range(0, max(len(ends), 1), rows)):
                    columns = [[file], [block], [first], [len(tokens)], [part], [ends[k : k + rows]]]
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return blocks.select("path", "file", "block", "start", "size").mapInArrow(run, "file string, block long, first long, tokens long, part int, ends array<long>")


def stitch(scanned: DataFrame) -> DataFrame:
    """(file, ordinal, start, n_tokens, closed) of every document of every file.

    The prefix scan runs over block parts, not documents: a running sum counts
    the separators before each, and the last separator before each is where its
    first document began.  Tokens after a file's last separator are a document
    that isn't closed."""
    order = Window.partitionBy("file").orderBy("block", "part")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    found = scanned.select(
        "file", "first", "tokens", "ends",
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).cast("long").alias("seen"),
        F.coalesce(F.max(F.array_max("ends")).over(before), F.lit(0).cast("long")).alias("open"),
        F.lead("block").over(order).isNull().alias("last"),
    )
    starts = F.concat(F.array("open"), F.col("ends"))
    rows = found.select("file", "seen", "first", "tokens", "last", F.arrays_zip(starts.alias("start"), F.col("ends").alias("end")).alias("docs"))
    docs = rows.select("file", "seen", "first", "tokens", "last", F.posexplode("docs").alias("k", "doc"))
    end = F.col("doc.end")
    tail = F.col("first") + F.col("tokens")
    return docs.where(end.isNotNull() | (F.col("last") & (F.col("doc.start") < tail))).select(
        "file", (F.col("seen") + F.col("k")).alias("ordinal"), F.col("doc.start").alias("start"),
        F.coalesce(end - 1 - F.col("doc.start"), tail - F.col("doc.start")).alias("n_tokens"), end.isNotNull().alias("closed"),
    )


def document_lengths(docs: DataFrame, ranks_file: str, pattern: str, end_id: int = 50256, block_bytes: int = 4 << 20) -> DataFrame:
    """Token counts of whole documents by way of flat token files.

    The texts are tokenised into files of the shared folder, the files scanned
    in blocks, and the documents found joined by (file, ordinal) to what was
    written: doc_id, file, ordinal, start, n_tokens, tokens_crc32.  Null and
    empty texts have 0 tokens; repeated rows stay apart; no rows give
    none; further columns, whatever their names, are not read."""
    import uuid

    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    _folders.append(folder)
    manifest = saved(write_token_files(docs, folder, ranks_file, pattern, end_id), "token-manifest")
    if not manifest.head(1):
        return manifest.select("doc_id", "file", "ordinal", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n_tokens"), "tokens_crc32")
    blocks = list_blocks(spark, folder, block_bytes, 2)
    found = stitch(scan_blocks(blocks, end_id))
    return manifest.join(found, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens", "tokens_crc32")
