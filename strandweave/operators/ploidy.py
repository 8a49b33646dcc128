"""Ploidy by sample and contig, runs of equal ploidy, and merging phased runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandweave.functions.genotype import extract_gt, gt_is_valid, gt_ploidy


def genotypes(records: DataFrame, samples: DataFrame) -> DataFrame:
    """(contig, rec_ord, pos, sample_idx, sample, has_column, gt): one row a record and header sample."""
    n = samples.agg(F.max("sample_idx") + 1).first()[0] or 0
    wide = records.select("contig", "rec_ord", "pos", "format", "samples", F.posexplode(F.slice(F.concat(F.transform("samples", lambda s: F.struct(s.alias("text"))), F.array_repeat(F.struct(F.lit(None).cast("string").alias("text")), n)), 1, n)).alias("sample_idx", "field"))
    named = wide.join(samples, "sample_idx")
    return named.select("contig", "rec_ord", "pos", "sample_idx", "sample", (F.col("sample_idx") < F.size("samples")).alias("has_column"), extract_gt(F.col("format"), F.col("field.text")).alias("gt"))


def sample_ploidy(gts: DataFrame) -> DataFrame:
    """(contig, sample_idx, sample, max_ploidy, variable, phased, unphased) over parsable records; 2 where nothing parses."""
    ploidy = F.when(gt_is_valid(F.col("gt")), gt_ploidy(F.col("gt")))
    return gts.withColumn("ploidy", ploidy).groupBy("contig", "sample_idx", "sample").agg(
        F.coalesce(F.max("ploidy"), F.lit(2)).alias("max_ploidy"),
        (F.coalesce(F.min("ploidy"), F.lit(2)) != F.coalesce(F.max("ploidy"), F.lit(2))).alias("variable"),
        F.count_if(F.col("gt").contains("|")).alias("phased"),
        F.count_if(F.col("gt").contains("/") & ~F.col("gt").contains("|")).alias("unphased"),
    )


def haplotype_offsets(ploidies: DataFrame) -> DataFrame:
    """Adds ``offset``, the haplotypes of the contig's samples before, and their total."""
    before = W.partitionBy("contig").orderBy("sample_idx").rowsBetween(W.unboundedPreceding, -1)
    return ploidies.withColumns({"offset": F.coalesce(F.sum("max_ploidy").over(before), F.lit(0)), "haplotypes": F.sum("max_ploidy").over(W.partitionBy("contig"))})


def global_haplotypes(ploidies: DataFrame) -> DataFrame:
    """(contig, global_hap, sample_idx, hap): which sample and haplotype a contig's n-th haplotype is."""
    placed = haplotype_offsets(ploidies)
    return placed.select("contig", "sample_idx", "offset", F.explode(F.sequence(F.lit(0), F.col("max_ploidy") - 1)).alias("hap")).select("contig", (F.col("offset") + F.col("hap")).cast("long").alias("global_hap"), "sample_idx", "hap")


def run_slice(records: DataFrame, contig: str, start_pos: int, end_pos: int, sample_idx: int) -> DataFrame:
    """Records of a run, from start_pos to end_pos, with its sample's column only; records without that column go."""
    inside = (F.col("contig") == contig) & F.col("pos").between(start_pos, end_pos) & (F.size("samples") > sample_idx)
    return records.where(inside).withColumn("samples", F.slice("samples", sample_idx + 1, 1))


def merge_groups(groups: list[DataFrame]) -> DataFrame:
    """(contig, pos, ref, alt, sample, gt) of ploidy groups' genotypes put together: a full outer merge on sites.

    Each group has these columns for samples of its own. At a site that a group lacks its samples are ``./.``.
    """
    every = groups[0]
    for g in groups[1:]:
        every = every.unionByName(g)
    site = ["contig", "pos", "ref", "alt"]
    samples = every.select("sample").distinct()
    # every site for every sample: the size of the merged file itself
    cells = every.select(*site).distinct().withColumn("all", F.lit(1)).join(F.broadcast(samples.withColumn("all", F.lit(1))), "all").drop("all")
    return cells.join(every.groupBy(*site, "sample").agg(F.min("gt").alias("gt")), [*site, "sample"], "left").withColumn("gt", F.coalesce("gt", F.lit("./.")))


def ploidy_at(segments: DataFrame, sites: DataFrame) -> DataFrame:
    """(contig, pos, ploidy): the ploidy of the first segment (contig, nth, start, end, ploidy) that covers a site; null if none does.

    Sites and segments meet by bins of 2 ** 16 bases, not all with all.
    """
    binned = segments.withColumn("bin", F.explode(F.expr("sequence(start >> 16, `end` >> 16)")))
    met = sites.withColumn("bin", F.shiftright("pos", 16)).join(binned, ["contig", "bin"]).where("pos between start and `end`")
    found = met.groupBy("contig", "pos").agg(F.min_by("ploidy", "nth").alias("ploidy"))
    return sites.select("contig", "pos").distinct().join(found, ["contig", "pos"], "left")


class NoEligibleRun(ValueError):
    """No run of a variable-ploidy file can be phased."""


def require_eligible(runs: DataFrame) -> DataFrame:
    """:func:`eligible_runs`, or an error if there is none."""
    found = eligible_runs(runs)
    if found.isEmpty():
        raise NoEligibleRun("no run is longer than one position and at least diploid")
    return found


def ploidy_runs(gts: DataFrame) -> DataFrame:
    """(sample, contig, start_pos, end_pos, ploidy, n): maximal runs of equal ploidy over parsable genotypes."""
    parsed = gts.where(gt_is_valid(F.col("gt"))).withColumn("ploidy", gt_ploidy(F.col("gt")))
    order = W.partitionBy("contig", "sample").orderBy("rec_ord")
    changed = parsed.withColumn("change", F.coalesce((F.lag("ploidy").over(order) != F.col("ploidy")).cast("int"), F.lit(0)))
    return changed.withColumn("run", F.sum("change").over(order)).groupBy("sample", "contig", "run", "ploidy").agg(F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos"), F.count(F.lit(1)).alias("n")).drop("run")


def eligible_runs(runs: DataFrame) -> DataFrame:
    """Runs that a phaser can take: over more than one position and at least diploid."""
    return runs.where("end_pos <> start_pos and ploidy >= 2")


def merge_runs(original: DataFrame, phased: DataFrame) -> DataFrame:
    """Original genotypes with phased ones put in by (contig, pos, sample).

    ``original`` is :func:`genotypes`' frame, ``phased`` has (contig, pos, sample, ord, gt). The last
    phased row of a position wins, and the first original row there receives it.
    """
    last = phased.groupBy("contig", "pos", "sample").agg(F.max_by("gt", "ord").alias("phased_gt"))
    first = F.row_number().over(W.partitionBy("contig", "pos", "sample").orderBy("rec_ord")) == 1
    joined = original.withColumn("first", first).join(last, ["contig", "pos", "sample"], "left")
    return joined.withColumn("gt", F.coalesce(F.when(F.col("first"), F.col("phased_gt")), F.col("gt"), F.lit("."))).drop("first", "phased_gt")
