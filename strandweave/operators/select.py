"""First-wins selection of non-overlapping records.

A record is applied if it starts at or after the end of the last *applied* one, so a plain
window does not do: skipped records must not move the cursor. Records are cut into islands,
which no candidate's end reaches across, and each island is folded on its own.

Prefix maxima run in two levels, bins of ``BIN`` bases and then the bins' maxima, so a whole
contig is never one task's; an island longer than ``LONG_ISLAND`` records is folded by a
streamed loop instead of an array.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BIN, LONG_ISLAND = 1 << 20, 10_000


def prefix_max(df: DataFrame, value: Column, out: str, inclusive: bool) -> DataFrame:
    """The greatest ``value`` of the contig's records before (or up to) each, by rec_ord."""
    marked = df.withColumns({"__v": value, "__bin": F.floor(F.col("start") / BIN)})
    tops = marked.groupBy("contig", "__bin").agg(F.max("__v").alias("__top"))
    before = W.partitionBy("contig").orderBy("__bin").rowsBetween(W.unboundedPreceding, -1)
    carry = tops.select("contig", "__bin", F.max("__top").over(before).alias("__carry"))
    within = W.partitionBy("contig", "__bin").orderBy("rec_ord").rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    joined = marked.join(carry, ["contig", "__bin"])
    return joined.withColumn(out, F.greatest("__carry", F.max("__v").over(within))).drop("__v", "__bin", "__carry")


def prefix_sum(df: DataFrame, key: list[str], place: Column, order: list[str], value: Column, out: str) -> DataFrame:
    """Adds the sum of ``value`` over the key's rows before each, in two levels: bins of ``place``, which grows with ``order``."""
    marked = df.withColumns({"__v": value, "__bin": place})
    tops = marked.groupBy(*key, "__bin").agg(F.sum("__v").alias("__top"))
    before = W.partitionBy(*key).orderBy("__bin").rowsBetween(W.unboundedPreceding, -1)
    carry = tops.select(*key, "__bin", F.coalesce(F.sum("__top").over(before), F.lit(0)).alias("__carry"))
    within = W.partitionBy(*key, "__bin").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    joined = marked.join(carry, [*key, "__bin"])
    return joined.withColumn(out, (F.col("__carry") + F.coalesce(F.sum("__v").over(within), F.lit(0))).cast("long")).drop("__v", "__bin", "__carry")


def islands(candidates: DataFrame) -> DataFrame:
    """``candidates`` (contig, rec_ord, start, end, ...) with ``island``, the start of its first record."""
    reach = prefix_max(candidates, F.col("end"), "__reach", inclusive=False)
    heads = reach.withColumn("__head", F.when(F.col("__reach").isNull() | (F.col("start") >= F.col("__reach")), F.col("start")))
    return prefix_max(heads, F.col("__head"), "island", inclusive=True).drop("__reach", "__head")


def select_nonoverlapping(candidates: DataFrame, long_island: int = LONG_ISLAND) -> DataFrame:
    """``candidates``, in file order by rec_ord and sorted by start, with ``applied``."""
    placed = islands(candidates)
    spans = placed.select("contig", "island", "rec_ord", "start", "end")
    sizes = spans.groupBy("contig", "island").agg(F.count(F.lit(1)).alias("n"))
    known = spans.join(sizes, ["contig", "island"])

    def keep(acc: Column, r: Column) -> Column:
        take = r["start"] >= acc["cursor"]
        return F.when(take, F.struct(r["end"].alias("cursor"), F.concat(acc["kept"], F.array(r["rec_ord"])).alias("kept"))).otherwise(acc)

    start = F.struct(F.lit(-1).cast("long").alias("cursor"), F.array().cast("array<bigint>").alias("kept"))
    short = (
        known.where(F.col("n") <= long_island)
        .groupBy("contig", "island")
        .agg(F.array_sort(F.collect_list(F.struct("rec_ord", "start", "end"))).alias("rows"))
        .select("contig", F.explode(F.aggregate("rows", start, keep, lambda a: a["kept"])).alias("rec_ord"))
    )

    def loop(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        contig, island, cursor = None, None, -1
        for pdf in batches:
            kept = []
            for r in pdf.itertuples(index=False):
                if (r.contig, r.island) != (contig, island):
                    contig, island, cursor = r.contig, r.island, -1
                if r.start >= cursor:
                    kept.append((r.contig, r.rec_ord))
                    cursor = r.end
            yield pd.DataFrame(kept, columns=["contig", "rec_ord"])

    long = known.where(F.col("n") > long_island).repartition("contig", "island").sortWithinPartitions("contig", "island", "rec_ord")
    taken = short.unionByName(long.select("contig", "island", "rec_ord", "start", "end").mapInPandas(loop, "contig string, rec_ord long"))
    return placed.join(taken.withColumn("applied", F.lit(True)), ["contig", "rec_ord"], "left").withColumn("applied", F.coalesce("applied", F.lit(False)))


def unsorted_records(records: DataFrame) -> DataFrame:
    """(contig, rec_ord, pos, previous_pos) of records that come before a greater position's."""
    before = prefix_max(records.withColumn("start", F.col("rec_ord")), F.col("pos"), "previous_pos", inclusive=False)
    return before.where("previous_pos > pos").select("contig", "rec_ord", "pos", "previous_pos")
