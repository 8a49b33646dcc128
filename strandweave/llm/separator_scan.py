"""Token counts from flat, unindexed token files: a scan for end-of-document ids.

A token file holds nothing but little-endian ids of fixed width, of any number. Each file is
cut into blocks of a fixed length, the last of which may be short, that any task reads by
offset (pyarrow's file systems, so the folder may be local, shared or an object store; a
folder without a scheme is on Hadoop's default file system). Blocks are searched for the end
id with numpy, and a prefix scan over (file, block) stitches the documents that cross a
block's edge: only a block's number of ends, the place of the last one, and the tail after
it take part, never tokens.

An empty file holds no documents; a file that does not end with the end id has a last,
open document (``closed`` false). ``pad_id``, if given, is an id that files of others are
padded with at their end; it is not counted and must not occur in documents.

:func:`count_document_tokens` takes a null text as empty, keeps null ids and every repeated
row, each with a place of its own, ignores other columns, and gives an empty result for an
empty table; a long text is one document of as many tokens.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandweave.llm.graph import cut, remove, shared_dir
from strandweave.llm.textkit import chunks
from strandweave.llm.tokenization import CachedEncoder

#: Bytes of a block: the unit of reading and of stitching.
BLOCK_BYTES = 1 << 20
#: Fixed value of files written here, of 2-byte ids: the end id.
END_ID = 50256


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` as a URI; one without scheme is on Hadoop's default file system, which all executors share."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes one flat file of 2-byte ids per input partition and returns (file, ordinal, doc_id).

    ``folder`` must be one that every executor reaches. A task writes under a name of its own
    and renames at the end, so one that runs again replaces its file with an equal one.
    """

    folder = qualified(docs.sparkSession, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        encoder, task = CachedEncoder(tokenizer_path, width=2), TaskContext.get()
        name = f"tokens-{task.partitionId():06d}.bin"
        draft = f"{root}/_{name}.{uuid.uuid4().hex}"
        end, size, ordinal = np.array([end_id], dtype="<u2").tobytes(), 0, 0
        store.create_dir(root, recursive=True)
        with store.open_output_stream(draft) as sink:
            for batch in batches:
                for part in chunks(batch, "text"):
                    for data in encoder.encode([t or "" for t in part.column(1).to_pylist()]):
                        sink.write(data + end)
                        size += len(data) + len(end)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * batch.num_rows), pa.array(range(ordinal, ordinal + batch.num_rows), pa.int64()), batch.column(0)],
                    names=["file", "ordinal", "doc_id"],
                )
                ordinal += batch.num_rows
        if size:
            store.move(draft, f"{root}/{name}")
        else:
            store.delete_file(draft)

    return cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(write, "file string, ordinal long, doc_id long"))


def _blocks(spark: SparkSession, folder: str, block_bytes: int, width: int) -> DataFrame:
    """(file, block) of the blocks of every ``*.bin`` file; the last of a file may be short."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    listed = store.globStatus(jvm.org.apache.hadoop.fs.Path(path, "*.bin")) if store.exists(path) else []
    rows = [(s.getPath().getName(), int(s.getLen())) for s in listed]
    if bad := [n for n, size in rows if size % width]:
        raise ValueError(f"not whole ids of {width} bytes: {bad[:3]}")
    spans = spark.createDataFrame([r for r in rows if r[1]], "file string, size long")
    # file names and sizes only; blocks are read in the tasks that count them
    return spans.select("file", F.explode(F.expr(f"sequence(0L, (size - 1) div {block_bytes})")).alias("block"))


def scan_token_files(spark: SparkSession, folder: str, end_id: int = END_ID, pad_id: int | None = None, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, ordinal, start, n_tokens, closed) of every document in the folder's token files.

    ``start`` counts the file's tokens before the document, ``n_tokens`` those before its end id.
    """
    kind = "<u2" if width == 2 else "<u4"
    per = block_bytes // width
    folder = qualified(spark, folder)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{name}") as source:
                    ids = np.frombuffer(source.read_at(block_bytes, block * block_bytes), dtype=kind)
                live = len(ids) - (int((ids == pad_id).sum()) if pad_id is not None else 0)
                ends = np.flatnonzero(ids == end_id).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([block], pa.int64()), pa.array([live], pa.int64()), pa.array([ends], pa.list_(pa.int64()))],
                    names=["file", "block", "live", "ends"],
                )

    blocks = _blocks(spark, folder, block_bytes, width)
    found = cut(blocks.repartition(max(1, min(blocks.count(), 4 * spark.sparkContext.defaultParallelism)), "file", "block").mapInArrow(search, "file string, block long, live long, ends array<long>"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    edges = found.select("file", "block", "live", F.size("ends").cast("long").alias("n_ends"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    carried = edges.select(
        "file",
        "block",
        F.coalesce(F.sum("n_ends").over(before), F.lit(0)).alias("ordinal0"),
        F.coalesce(F.max(F.col("block") * per + F.col("last")).over(before) + 1, F.lit(0)).alias("open_at"),
        (F.lead("block").over(W.partitionBy("file").orderBy("block")).isNull()).alias("final"),
    )
    joined = found.join(carried, ["file", "block"])
    closed = joined.select("file", "block", "ordinal0", "open_at", F.posexplode("ends").alias("i", "place"), "ends").select(
        "file",
        (F.col("ordinal0") + F.col("i")).alias("ordinal"),
        F.when(F.col("i") == 0, F.col("open_at")).otherwise(F.col("block") * per + F.get("ends", F.col("i") - 1) + 1).alias("start"),
        (F.col("block") * per + F.col("place")).alias("end"),
        F.lit(True).alias("closed"),
    )
    tail = joined.where("final").select(
        "file",
        (F.col("ordinal0") + F.size("ends")).alias("ordinal"),
        F.coalesce(F.col("block") * per + F.try_element_at("ends", F.lit(-1)) + 1, F.col("open_at")).alias("start"),
        (F.col("block") * per + F.col("live")).alias("end"),
        F.lit(False).alias("closed"),
    )
    return closed.unionByName(tail.where("end > start")).select("file", "ordinal", "start", (F.col("end") - F.col("start")).alias("n_tokens"), "closed")


def count_document_tokens(docs: DataFrame, tokenizer_path: str, folder: str | None = None) -> DataFrame:
    """Writes ``docs`` as flat token files and counts each document's tokens by scanning them."""
    spark = docs.sparkSession
    own = folder is None
    folder = folder or f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    places = write_token_files(docs, folder, tokenizer_path)
    counted = places.join(scan_token_files(spark, folder), ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
    if own:  # the scan's blocks are checkpointed: the files have been read for good
        remove(spark, folder)
    return counted
