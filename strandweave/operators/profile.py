"""Profiles, routing, planning arithmetic and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.functions.genotype import gt_is_valid, gt_ploidy, variant_class
from strandweave.functions.text import parse_size
from strandweave.operators.ploidy import genotypes

#: The router's tags.
NONE, CANONICAL, BEAGLE, WHATSHAP, VARIABLE = "none", "canonical", "beagle", "whatshap", "variable-ploidy"


def contig_profile(ploidies: DataFrame, records: DataFrame) -> DataFrame:
    """One row a contig: variants, haplotypes, greatest ploidy, phased and unphased genotypes, variable ploidy."""
    sums = ploidies.groupBy("contig").agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.sum("max_ploidy").cast("long").alias("haplotypes"),
        F.max("max_ploidy").alias("max_ploidy"),
        F.sum("phased").alias("phased"),
        F.sum("unphased").alias("unphased"),
        F.bool_or("variable").alias("variable"),
        F.bool_and(F.col("max_ploidy") == 2).alias("all_diploid"),
    )
    return records.groupBy("contig").agg(F.count(F.lit(1)).alias("variants")).join(sums, "contig")


def backend(n_samples: Column, max_ploidy: Column, unphased: Column, variable: Column, all_diploid: Column, has_reads: Column) -> Column:
    """The phasing treatment of a contig, by precedence."""
    return (
        F.when((unphased == 0) | (max_ploidy <= 1), NONE)
        .when(n_samples == 1, F.when(~has_reads, CANONICAL).when(variable, VARIABLE).otherwise(WHATSHAP))
        .when(variable, VARIABLE)
        .when(all_diploid, BEAGLE)
        .otherwise(WHATSHAP)
    )


def phase_route(profile: DataFrame, has_reads: bool = False) -> DataFrame:
    route = backend(F.col("n_samples"), F.col("max_ploidy"), F.col("unphased"), F.col("variable"), F.col("all_diploid"), F.lit(has_reads))
    return profile.withColumn("backend", route).withColumn("needs_phasing", ~F.col("backend").isin(NONE, CANONICAL))


def workload(records: DataFrame, samples: DataFrame) -> DataFrame:
    """One row: variants, malformed, snv, indel, phased and unphased genotypes, haplotypes.

    Any GT text counts, a valid one or not: its ploidy is the number of its separators and
    one more; a sample without any is diploid.
    """
    good = F.col("malformed").isNull()
    kind = variant_class(F.col("ref"), F.col("alt"))
    gts = genotypes(records.where("malformed is null"), samples).where("gt is not null")
    per_sample = gts.groupBy("sample_idx").agg(F.max(gt_ploidy(F.col("gt"))).alias("p"), F.count_if(F.col("gt").contains("|")).alias("phased"), F.count_if(F.col("gt").contains("/") & ~F.col("gt").contains("|")).alias("unphased"))
    every = samples.select("sample_idx").join(per_sample, "sample_idx", "left")
    sums = every.agg(F.sum(F.when(F.coalesce("p", F.lit(0)) == 0, 2).otherwise(F.col("p"))).cast("long").alias("haplotypes"), F.coalesce(F.sum("phased"), F.lit(0)).alias("phased"), F.coalesce(F.sum("unphased"), F.lit(0)).alias("unphased"))
    counts = records.agg(F.count_if(good).alias("variants"), F.count_if(~good).alias("malformed"), F.count_if(good & (kind == "snv")).alias("snv"), F.count_if(good & (kind == "indel")).alias("indel"))
    # one row each
    return counts.withColumn("one", F.lit(1)).join(sums.withColumn("one", F.lit(1)), "one").drop("one")


def legacy_route(gts: DataFrame, samples: DataFrame, has_reads: bool = False) -> DataFrame:
    """One row, ``backend``: the treatment of a whole file; a GT with any ``/`` counts as unphased."""
    ploidy = F.when(gt_is_valid(F.col("gt")), gt_ploidy(F.col("gt")))
    # ploidies vary where one sample has two on any contig or over them
    per_sample = gts.groupBy("sample_idx").agg(F.coalesce(F.max(ploidy), F.lit(2)).alias("top"), F.coalesce(F.min(ploidy), F.lit(2)).alias("low"), F.count_if(F.col("gt").contains("/")).alias("unphased"))
    every = samples.select("sample_idx").join(per_sample, "sample_idx", "left")
    one = every.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("unphased"), F.lit(0)).alias("unphased"),
        F.bool_or(F.coalesce(F.col("top") != F.col("low"), F.lit(False))).alias("variable"), F.bool_and(F.coalesce("top", F.lit(2)) == 2).alias("diploid"),
    )
    tag = (
        F.when(F.col("unphased") == 0, NONE)
        .when(F.col("n") == 1, WHATSHAP if has_reads else CANONICAL)
        .when(F.col("variable"), VARIABLE)
        .when(F.col("diploid"), BEAGLE)
        .otherwise(WHATSHAP)
    )
    return one.select(tag.alias("backend"))


def chunk_size(total_bases: int, threads: int, user: int | None = None) -> int:
    """Bases a chunk: a share of the total for four chunks a thread, eight at least, within limits."""
    if user is not None:
        return max(1, user)
    return min(max(total_bases // max(max(threads, 1) * 4, 8) if total_bases else 10_000_000, 100_000), 50_000_000)


def chunk_plan(ref_contigs: DataFrame, size: int) -> DataFrame:
    starts = F.explode(F.expr(f"sequence(0L, length - 1, {size}L)"))
    return ref_contigs.where("length > 0").select("contig", "length", starts.alias("start")).select("contig", "start", F.least(F.col("start") + size, "length").alias("end"))


def tile_plan(ref_contigs: DataFrame, haplotypes: int, hap_block: int, base_block: int) -> DataFrame:
    """(contig, hap_start, hap_end, base_start, base_end), half open."""
    bases = chunk_plan(ref_contigs, max(1, base_block)).withColumnsRenamed({"start": "base_start", "end": "base_end"})
    block = max(1, hap_block)
    haps = F.explode(F.expr(f"sequence(0, {haplotypes} - 1, {block})")) if haplotypes else F.explode(F.array().cast("array<int>"))
    return bases.withColumn("hap_start", haps).withColumn("hap_end", F.least(F.col("hap_start") + block, F.lit(haplotypes)))


def chunk_pad(records: DataFrame) -> DataFrame:
    """One row: twice the longest REF, 1000 at least."""
    return records.agg(F.greatest(F.coalesce(F.max(F.length("ref")), F.lit(0)) * 2, F.lit(1000)).cast("long").alias("pad"))


def output_estimate(variants: Column, bases: Column, haps: Column, width: int) -> tuple[Column, Column]:
    """(bytes of FASTA, work units)."""
    return ((bases + F.ceil(bases / width) + 64) * haps).cast("long"), (variants * haps + bases * haps).cast("long")


def beagle_parameters(n_samples: int) -> tuple[int, int]:
    """(burn-in, iterations) for a cohort."""
    return (3, 12) if n_samples <= 10 else (6, 20)


def beagle_heap(available: int, wanted: str | None = None) -> str:
    """Heap of the phaser's JVM: 60 % of memory in whole GiB, from 1 to 64; ``wanted`` (1024, 512m, 32g) can only lower it."""
    auto = min(max(int(available * 0.6), 1 << 30), 64 << 30) >> 30
    if wanted is not None:
        try:
            if parse_size(wanted) <= auto << 30:
                return wanted
        except ValueError:
            pass
    return f"{auto}g"


def beagle_fits(n_samples: int, variants: int, available: int) -> bool:
    return n_samples * variants * 64 <= available * 0.75


def contig_stats(checked: DataFrame, chosen: DataFrame) -> DataFrame:
    """(contig, seen, applied): parsable records and those applied."""
    seen = checked.groupBy("contig").agg(F.count_if(F.col("malformed").isNull()).alias("seen"))
    done = chosen.groupBy("contig").agg(F.count_if("applied").alias("applied"))
    return seen.join(done, "contig", "left").select("contig", "seen", F.coalesce("applied", F.lit(0)).alias("applied"))
