"""Checks of a run's output against sequences built another way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.operators.emit import segment_length


def allele_edits(called: DataFrame) -> DataFrame:
    """(contig, sample_idx, sample, hap, start, end, text): the calls that write an ALT; all else keeps the reference."""
    return called.where("code > 0").select("contig", "sample_idx", "sample", "hap", "start", "end", F.col("allele").alias("text"))


def edited_sequences(sequences: DataFrame, haps: DataFrame, edits: DataFrame) -> DataFrame:
    """(contig, sample_idx, sample, hap, seq): a contig's sequence with a haplotype's edits put in.

    Made for contigs that a cell holds: it builds whole sequences from ``sequences`` (contig,
    seq) and shares no step with the assembly by segments and offsets.
    """
    key = ["contig", "sample_idx", "sample", "hap"]
    listed = edits.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "text"))).alias("edits"))
    bound = haps.select(*key).join(sequences.select("contig", "seq"), "contig").join(listed, key, "left").withColumn("edits", F.coalesce("edits", F.array().cast("array<struct<start:bigint,end:bigint,text:string>>")))

    def part(e: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(0)).otherwise(F.get("edits", i - 1)["end"])
        return F.concat(F.col("seq").substr((before + 1).cast("int"), (e["start"] - before).cast("int")), e["text"])

    last = F.coalesce(F.get("edits", F.size("edits") - 1)["end"], F.lit(0))
    seq = F.concat(F.array_join(F.transform("edits", part), ""), F.col("seq").substr((last + 1).cast("int"), F.length("seq")))
    return bound.select(*key, seq.alias("seq"))


def compare_lines(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(name, differing, first_line) of names whose lines (name, line, text) differ or are on one side only."""
    left = expected.select("name", "line", F.col("text").alias("one"))
    right = actual.select("name", "line", F.col("text").alias("two"))
    return left.join(right, ["name", "line"], "full_outer").where(~F.col("one").eqNullSafe(F.col("two"))).groupBy("name").agg(F.count(F.lit(1)).alias("differing"), F.min("line").alias("first_line"))


def length_attribution(called: DataFrame) -> DataFrame:
    """(contig, sample_idx, hap, rec_ord, delta): the records that change a haplotype's length, and by how much."""
    wrote = F.when(F.col("code") >= 0, F.length("allele")).otherwise(1)
    return called.withColumn("delta", (wrote - (F.col("end") - F.col("start"))).cast("long")).where("delta <> 0").select("contig", "sample_idx", "hap", "rec_ord", "delta")


def unexplained_lengths(segs: DataFrame, called: DataFrame, contigs: DataFrame) -> DataFrame:
    """(contig, sample_idx, hap, length, expected) of haplotypes whose length is not the contig's plus its attributed differences."""
    key = ["contig", "sample_idx", "hap"]
    lengths = segs.groupBy(*key).agg(F.sum(segment_length()).alias("length"))
    deltas = length_attribution(called).groupBy(*key).agg(F.sum("delta").alias("delta"))
    told = lengths.join(deltas, key, "left").join(contigs.select("contig", F.col("length").alias("bases")), "contig")
    return told.select(*key, "length", (F.col("bases") + F.coalesce("delta", F.lit(0))).alias("expected")).where("length <> expected")
