"""Packing by power-of-two decomposition: no sequence crosses documents, none needs padding.

A document's ids (its text's, then an end id) are cut into full sequences of
``max_length`` and then one piece for each binary digit of what is left. Every piece is a
sequence of its own whose length is a power of two, and sequences of equal length form a
bucket (``bucket`` = log2 of the length), from which a trainer draws batches of one shape.

Null text counts as empty (the end id alone); null or repeated ids of documents are
separate documents, row by row; an empty table gives an empty result; other columns are
ignored, whatever their names. Memory: one document's ids and the encoder's bounded cache.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.textkit import chunks
from strandweave.llm.tokenization import CachedEncoder

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, `offset` long, bucket int"
)


def piece_lengths(n: int, max_length: int = 1024) -> list[int]:
    """Full sequences, then the binary digits of the rest, the largest first."""
    rest = n % max_length
    return [max_length] * (n // max_length) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack_powers_of_two(
    docs: DataFrame,
    tokenizer_path: str,
    max_length: int = 1024,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: ``SCHEMA``, and ``ids`` (array of int) if asked for.

    ``sequence_id`` is the input partition's number and a count within it, so a task that
    runs again gives the same numbers and no task waits for another's count.
    """
    if max_length & (max_length - 1) or max_length < 1:
        raise ValueError("max_length must be a power of two")
    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    names = [c.split()[0].strip("`") for c in SCHEMA.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = CachedEncoder(tokenizer_path)
        end = np.array([end_id], dtype="<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in chunks(batch, "text"):
                rows: list[tuple] = []
                ids: list[np.ndarray] = []
                encoded = encoder.encode([t or "" for t in part.column(1).to_pylist()])
                for doc_id, data in zip(part.column(0).to_pylist(), encoded, strict=True):
                    data += end
                    total, start = len(data) // 4, 0
                    for length in piece_lengths(total, max_length):
                        piece = data[4 * start : 4 * (start + length)]
                        rows.append((doc_id, start, length, zlib.crc32(piece), total, sequence, 0, length.bit_length() - 1))
                        if with_ids:
                            ids.append(np.frombuffer(piece, dtype="<i4"))
                        sequence += 1
                        start += length
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                arrays = [pa.array(c, pa.int64() if i < 7 else pa.int32()) for i, c in enumerate(columns)]
                if with_ids:
                    ends = np.cumsum([0, *map(len, ids)])
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids or [np.zeros(0, "<i4")]), pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=names + ["ids"] * with_ids)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(pack, schema)
