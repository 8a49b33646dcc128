"""Substring dedup by unit hashing: repeated lines and passages are removed, original offsets retained.

Units are lines. Besides, windows of ``WINDOW`` words are taken from the whole text's words,
across lines: those whose hash is the least of some ``STEP`` in a row. So two passages that
share WINDOW + STEP - 1 = 50 words share a window, wherever these stand in long or
differently broken lines, and the windows of a longer passage leave no word out but up to
STEP - 1 at either end.

Words are runs of bytes that aren't ASCII white space, A-Z lower-cased; a unit is its
sequence of words, hashed to 128 bits. A digest's occurrences are ranked by (doc_id, offset)
over the whole table; the first is kept, every later one removed, whatever its length.
Removed units that follow each other or overlap, by words, are one passage.

A null id ranks last. Rows that are equal in id and text are one document; other rows that
share an id are told apart, but a unit at one offset of them is one occurrence. Null, empty
and wordless texts have no units; an empty table gives an empty result. A window that
overlaps its own first occurrence, in text that repeats itself, is no later one. Very long
texts are hashed whole: some 100 bytes a word. Other columns pass through
:func:`remove_repeats`, whatever their names; if one is called ``removed_spans`` the result's
gets underscores behind its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandweave.llm.graph import cut, free_name
from strandweave.llm.textkit import chunks, mix64, scan_words, span_hashes

WINDOW, STEP = 26, 25
#: Kinds of units.
LINE, PASSAGE = 0, 1
_UNIT = "row long, doc_id long, kind int, word int, words int, start int, `end` int, h1 long, h2 long"


def _sliding(value: np.ndarray, n: int, best) -> np.ndarray:
    """The least or greatest of every ``n`` in a row, by doubling."""
    size = 1
    while 2 * size <= n:
        value = best(value[: len(value) - size], value[size:])
        size *= 2
    return best(value[: len(value) - (n - size)], value[n - size :]) if size < n else value


def chosen(value: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Which windows have the least ``value`` of some STEP in a row; ``whole`` tells those inside one text."""
    out = np.zeros(len(value), bool)
    if len(value) < STEP:
        return out
    # windows that begin in one text follow each other, so a row is inside it if its ends are
    text = np.cumsum(~whole)
    inside = whole[STEP - 1 :] & whole[: len(whole) - STEP + 1] & (text[STEP - 1 :] == text[: len(text) - STEP + 1])
    least = np.where(inside, _sliding(value, STEP, np.minimum), np.uint64(0))
    edge = np.zeros(STEP - 1, np.uint64)
    return whole & (_sliding(np.concatenate([edge, least, edge]), STEP, np.maximum) == value)


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, kind, word, words, start, end, h1, h2): offsets in code points of the original text; ``word`` is the number of its first word."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                words = scan_words(part.column("text"), fold_case=True)
                n = len(words.starts)
                of = np.repeat(np.arange(part.num_rows), words.counts)
                breaks = np.cumsum(words.raw == 10, dtype=np.int32)[words.starts] if n else np.zeros(0, np.int32)
                head = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (breaks[1:] != breaks[:-1]))) if n else np.zeros(0, np.int64)
                tail = np.append(head[1:], n) if n else head
                windows = np.arange(max(0, n - WINDOW + 1))
                value = span_hashes(words.hashes, np.concatenate([head, windows]), np.concatenate([tail, windows + WINDOW]))
                other = span_hashes(mix64(words.hashes ^ np.uint64(0xA24BAED4963EE407)), np.concatenate([head, windows]), np.concatenate([tail, windows + WINDOW]))
                lines = len(head)
                picked = np.flatnonzero(chosen(value[lines:], of[: len(windows)] == of[WINDOW - 1 :] if len(windows) else np.zeros(0, bool)))
                first, last = np.concatenate([head, picked]), np.concatenate([tail, picked + WINDOW])
                at = np.concatenate([np.arange(lines), lines + picked])
                points = np.cumsum((words.raw & 0xC0) != 0x80, dtype=np.int64)
                before = np.append(0, points)[words.offsets[:-1]]
                doc = of[first] if n else np.zeros(0, np.int64)
                start = (points[words.starts[first]] - 1 - before[doc]) if n else first
                end = (points[words.ends[last - 1] - 1] - before[doc]) if n else first
                index = pa.array(doc)
                kind = np.repeat([LINE, PASSAGE], [lines, len(picked)])
                ints = [pa.array(c.astype(np.int32)) for c in (kind, first - words.first[doc], last - first, start, end)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row").take(index), part.column("doc_id").take(index), *ints, pa.array(value[at].view(np.int64)), pa.array(other[at].view(np.int64))],
                    names=["row", "doc_id", "kind", "word", "words", "start", "end", "h1", "h2"],
                )

    return _keyed(docs, id_col, text_col).select("row", "doc_id", "text").mapInArrow(split, _UNIT)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text, key = F.col(text_col).cast("string"), F.col(id_col).cast("long")
    return docs.select(F.xxhash64(key, text).alias("row"), key.alias("doc_id"), text.alias("text"))


_NONE = 1 << 63


def _rank() -> Column:
    """(doc_id, start) as one number, so that its minimum stays in hash aggregation."""
    return (F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(str(_NONE)).cast("decimal(20,0)")) * F.lit(1 << 31).cast("decimal(12,0)") + F.col("start")).cast("decimal(38,0)")


def _runs(rows: DataFrame) -> DataFrame:
    """``rows`` with ``run``: those of a text that follow each other or overlap, by words, have the same."""
    in_text = W.partitionBy("row").orderBy("word", "words", "kind")
    before = F.max(F.col("word") + F.col("words")).over(in_text.rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("opens", F.coalesce((F.col("word") > before).cast("int"), F.lit(0))).withColumn("run", F.sum("opens").over(in_text.rowsBetween(W.unboundedPreceding, 0)))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, start, end, n_units, n_words, first_doc_id) of every passage to remove; ``row`` is a hash of id and text.

    ``first_doc_id`` is the least document that keeps one of its units. Digest groups are
    summed before their shuffle. Only digests with a later occurrence meet the units again, in
    a join whose skewed keys Spark can split.
    """
    first = units(docs, id_col, text_col).groupBy("h1", "h2").agg(F.min(_rank()).alias("first"), F.max(_rank()).alias("last"))
    repeated = cut(first.where("first <> last").select("h1", "h2", "first"))
    met = units(docs, id_col, text_col).join(repeated, ["h1", "h2"])
    ahead = _rank() - F.col("first")
    later = met.where(ahead > 0).where((F.col("kind") == LINE) | (ahead >= F.col("end") - F.col("start")))
    source = F.floor(F.col("first") / F.lit(1 << 31).cast("decimal(12,0)")).cast("decimal(20,0)")
    told = later.select("row", "doc_id", "kind", "word", "words", "start", "end", F.when(source < F.lit(str(_NONE)).cast("decimal(20,0)"), source.cast("long")).alias("first_doc_id"))
    # a text's repeated units only, so a window holds one text's at most; equal rows of one id give each unit once
    runs = _runs(told.repartition("row").dropDuplicates(["row", "kind", "word", "words"]))
    return (
        runs.groupBy("row", "doc_id", "run")
        .agg(
            F.min("start").cast("long").alias("start"),
            F.max("end").cast("long").alias("end"),
            F.count(F.lit(1)).alias("n_units"),
            (F.max(F.col("word") + F.col("words")) - F.min("word")).cast("long").alias("n_words"),
            F.min("first_doc_id").alias("first_doc_id"),
        )
        .drop("run")
    )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut from the text, and ``removed_spans`` (start, end) of the original."""
    out = free_name(docs, "removed_spans")
    mine, of, found = (free_name(docs, c) for c in ("__row", "__of", "__spans"))
    spans = repeated_passages(docs, id_col, text_col).groupBy(F.col("row").alias(of)).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(found))
    text = F.col(text_col).cast("string")
    joined = docs.withColumn(mine, F.xxhash64(F.col(id_col).cast("long"), text)).join(spans, F.col(mine) == F.col(of), "left").drop(mine, of)
    joined = joined.withColumn(found, F.coalesce(found, F.array().cast("array<struct<start:bigint,end:bigint>>"))).withColumn(text_col, text)
    place = joined.columns.index(text_col)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for whole, cuts in zip(batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                at, left = 0, []
                for c in cuts:
                    left.append(whole[at : c["start"]])
                    at = c["end"]
                kept.append("".join([*left, whole[at:]]) if cuts else whole)
            yield batch.set_column(place, batch.schema.field(place), pa.array(kept, batch.schema.field(place).type))

    return joined.mapInArrow(remove, joined.schema).withColumnRenamed(found, out)
