"""The registered queries over the derived fixture; ``plans/oracles.py`` has their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandweave.functions import genotype as g
from strandweave.functions.text import classify_warning, sanitize, sequence_name
from strandweave.operators import emit, ploidy, profile, sink, verify
from strandweave.operators.select import unsorted_records
from strandweave.plans.reconstruct import Reconstruction, reconstruct
from strandweave.sources.files import has_alignment_index, pick_chromosome_files, pick_sample_files
from strandweave.sources.fixture import Genome, contig_sequences, genome
from strandweave.sources.vcf import in_region, parse_records, pick_samples

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: Fixed values of small literal inputs, shared with the SQL twins.
WARNING_TEXTS = (
    "[chr1:5] overlap/out-of-order (start=4 < prev_end=9)", "[chr1:5] REF mismatch: outside contig", "REF exceeds contig length", "POS 21 outside contig",
    "POS must be >= 1", "malformed record: x", "malformed: y", "malformed GT 'ABC'", "cannot extract GT", "normalisation failed", "invalid allele 9", "negative allele",
    "missing allele", "S2 missing from record", "record belongs to chr2", "ALT contains empty token", "no valid REF", "REF allele is invalid", "something else",
)
FILES = ("/b/S1.sorted.bam", "/b/S1.bam", "/b/S10.bam", "/b/S2_x.CRAM", "/b/xS3.bam", "/b/S3.txt", "/b/S1.bam.bai", "/b/S2_x.crai", "/b/plink.chrchr1.map", "/b/plink.chr10.map", "/b/PANEL-X.vcf.gz", "/b/a_chr2_b.map", "/b/b.2.map")
NAMES = ("chr1", "HLA-A*01:01", "a b/c", "x.y_z-1", "")


def registered(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def over(f: Callable[[Genome], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Registers a query over the fixture's frames."""

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(genome(spark, sf_dir))

    return registered(run)


def rebuilt(f: Callable[[Reconstruction], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Registers a query over the reconstruction's frames."""

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(reconstruct(genome(spark, sf_dir), single_sample=False))

    return registered(run)


def _each_gt(x: Genome) -> DataFrame:
    """One row a record and sample, straight from the columns."""
    rows = x.records.select("contig", "rec_ord", "alt", "ref", "format", F.posexplode("samples").alias("sample_idx", "field"))
    return rows.withColumn("gt", g.extract_gt(F.col("format"), F.col("field")))


@registered
def vcf_parse_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = genome(spark, sf_dir)
    text = F.concat_ws("\t", "contig", F.col("pos").cast("string"), "id", "ref", "alt", "qual", "filter", "info", "format", F.array_join("samples", "\t"), F.lit(""))
    parsed = parse_records(x.records.select(F.col("rec_ord").alias("ord"), text.alias("value")))
    return parsed.select("contig", "rec_ord", "pos", "id", "ref", "alt", "qual", "filter", "info", F.size("samples").cast("long").alias("n_samples"), F.coalesce("malformed", F.lit("")).alias("malformed"))


@over
def gt_extract(x: Genome) -> DataFrame:
    return _each_gt(x).select("contig", "rec_ord", F.col("sample_idx").cast("long").alias("sample_idx"), "gt")


@over
def gt_parse_alleles(x: Genome) -> DataFrame:
    alleles = F.transform(g.gt_alleles(F.col("gt")), lambda a: F.coalesce(a.cast("string"), F.lit(".")))
    return _each_gt(x).select("contig", "rec_ord", F.col("sample_idx").cast("long").alias("sample_idx"), F.coalesce(F.array_join(alleles, ","), F.lit("malformed")).alias("alleles"))


@over
def gt_phased_flag(x: Genome) -> DataFrame:
    return _each_gt(x).select("contig", "rec_ord", F.col("sample_idx").cast("long").alias("sample_idx"), F.coalesce(g.is_effectively_phased(F.col("gt")).cast("string"), F.lit("malformed")).alias("phased"))


@over
def gt_ploidy(x: Genome) -> DataFrame:
    return _each_gt(x).select("contig", "rec_ord", F.col("sample_idx").cast("long").alias("sample_idx"), g.gt_ploidy(F.col("gt")).cast("long").alias("ploidy"))


@over
def allele_validity(x: Genome) -> DataFrame:
    each = x.records.select("contig", "rec_ord", F.posexplode(F.split("alt", ",", -1)).alias("i", "allele"))
    return each.select("contig", "rec_ord", F.col("i").cast("long").alias("i"), g.is_symbolic(F.col("allele")).alias("symbolic"), g.is_nucleotides(F.col("allele")).alias("nucleotides"))


@over
def variant_class(x: Genome) -> DataFrame:
    return x.records.select("contig", g.variant_class(F.col("ref"), F.col("alt")).alias("kind")).groupBy("contig", "kind").agg(F.count(F.lit(1)).alias("n"))


def _named(x: Genome) -> DataFrame:
    """Header contigs of a made-up header: the reference's first twenty and three unknown ones."""
    extra = x.ref_contigs.where("contig_ord < 3").select(F.concat(F.lit("un"), F.col("contig_ord").cast("string")).alias("contig"))
    return x.ref_contigs.where("contig_ord < 20").select("contig").unionByName(extra)


@over
def contig_intersect(x: Genome) -> DataFrame:
    return _named(x).join(x.ref_contigs, "contig", "left_semi").join(x.records.select("contig").distinct(), "contig", "left_semi")


@over
def contig_dropped(x: Genome) -> DataFrame:
    both = x.ref_contigs.select("contig").intersect(x.records.select("contig"))
    return _named(x).subtract(both)


@rebuilt
def ref_check(r: Reconstruction) -> DataFrame:
    return r.checked.select("contig", "rec_ord", "start", "end", F.coalesce("reason", F.lit("valid")).alias("reason"))


@rebuilt
def reject_reasons(r: Reconstruction) -> DataFrame:
    found = sink.reason_histogram(r.warnings.where("sample_idx is null"))
    return found.select(F.coalesce("contig", F.lit("all")).alias("contig"), "reason", "n")


@rebuilt
def nonoverlap_select(r: Reconstruction) -> DataFrame:
    return r.chosen.where("applied").select("contig", "rec_ord", "start", "end")


@rebuilt
def contig_stats(r: Reconstruction) -> DataFrame:
    return r.stats.select("contig", "seen", F.col("applied").cast("long").alias("applied"))


@rebuilt
def run_totals(r: Reconstruction) -> DataFrame:
    files = r.ploidies.groupBy("contig").agg(F.sum("max_ploidy").cast("long").alias("files"))
    return r.stats.join(files, "contig").rollup("contig").agg(F.sum("seen").alias("seen"), F.sum("applied").cast("long").alias("applied"), F.sum("files").alias("files")).select(F.coalesce("contig", F.lit("all")).alias("contig"), "seen", "applied", "files")


@rebuilt
def sample_ploidy(r: Reconstruction) -> DataFrame:
    return r.ploidies.select("contig", F.col("sample_idx").cast("long").alias("sample_idx"), F.col("max_ploidy").cast("long").alias("max_ploidy"), "variable", "phased", "unphased")


@rebuilt
def contig_profile(r: Reconstruction) -> DataFrame:
    return r.routes.select("contig", "variants", "haplotypes", F.col("max_ploidy").cast("long").alias("max_ploidy"), "phased", "unphased", "variable")


@over
def workload_profile(x: Genome) -> DataFrame:
    return profile.workload(x.records.withColumn("malformed", F.when(F.col("ref") == ".", "malformed_record")), x.samples)


@over
def legacy_route(x: Genome) -> DataFrame:
    """Routes of the whole file, of its contigs 3 and up without the last sample, and of one sample alone."""
    gts = ploidy.genotypes(x.records.where("ref <> '.'"), x.samples)
    each = lambda name, g, s: profile.legacy_route(g, s).select(F.lit(name).alias("part"), "backend")
    three = x.samples.where("sample_idx < 3")
    one = x.samples.where("sample_idx = 0")
    calm = gts.where("sample_idx < 3 and gt rlike '^[01]/[01]$'")
    parts = [each("whole", gts, x.samples), each("diploid", calm, three), each("one", gts.where("sample_idx = 0"), one), each("phased", gts.where("gt = '0|1'"), x.samples)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@rebuilt
def file_ploidy(r: Reconstruction) -> DataFrame:
    return r.overall_ploidies.select(F.col("sample_idx").cast("long").alias("sample_idx"), F.col("max_ploidy").cast("long").alias("max_ploidy"))


@rebuilt
def global_haplotypes(r: Reconstruction) -> DataFrame:
    return ploidy.global_haplotypes(r.ploidies).select("contig", "global_hap", F.col("sample_idx").cast("long").alias("sample_idx"), F.col("hap").cast("long").alias("hap"))


@over
def run_slice(x: Genome) -> DataFrame:
    return ploidy.run_slice(x.records, "chr3", 2000, 12000, 3).select("contig", "rec_ord", "pos", F.get("samples", F.lit(0)).alias("field"))


@rebuilt
def group_merge(r: Reconstruction) -> DataFrame:
    """Diploid and triploid samples' genotypes, of different sites, put together again."""
    rows = r.genotypes.join(r.checked.select("contig", "rec_ord", "ref", "alt"), ["contig", "rec_ord"]).where("contig = 'chr3' and gt is not null").select("contig", "pos", "ref", "alt", "sample", "gt")
    return ploidy.merge_groups([rows.where("sample <> 'S3' and pos % 3 <> 0"), rows.where("sample = 'S3' and pos % 3 <> 1")])


@over
def ploidy_intervals(x: Genome) -> DataFrame:
    """The first of overlapping segments that covers a record; none covers those past 15000."""
    cuts = x.ref_contigs.select("contig", F.explode(F.expr("array(named_struct('nth', 0, 's', 1, 'e', 5000, 'p', 2), named_struct('nth', 1, 's', 4000, 'e', 9000, 'p', 3), named_struct('nth', 2, 's', 9001, 'e', 15000, 'p', 4))")).alias("c"))
    segments = cuts.select("contig", "c.nth", F.col("c.s").cast("long").alias("start"), F.col("c.e").cast("long").alias("end"), F.col("c.p").cast("long").alias("ploidy"))
    return ploidy.ploidy_at(segments, x.records.select("contig", "pos"))


@rebuilt
def prefilter_counts(r: Reconstruction) -> DataFrame:
    return sink.prefilter_counts(r.checked, r.contigs.where("contig_ord < 20"))


@rebuilt
def warning_log(r: Reconstruction) -> DataFrame:
    return sink.warning_log(r.warnings, r.contigs, 500).select("value")


@rebuilt
def run_log(r: Reconstruction) -> DataFrame:
    return sink.run_log(r.routes, r.stats, r.haplotype_counts)


@over
def reference_slice(x: Genome) -> DataFrame:
    """Ranges of a contig, over tile borders and past its end."""
    ranges = x.ref_contigs.withColumn("nth", F.explode(F.sequence(F.lit(0), F.lit(4)))).select("contig", (F.col("nth") * 3777).cast("long").alias("start"), (F.col("nth") * 3777 + 4500).cast("long").alias("end"))
    return emit.reference_slices(ranges, x.ref_tiles, x.tile_size, "start", "end", "seq").select("contig", "start", F.length("seq").cast("long").alias("length"), F.md5("seq").alias("md5"))


@rebuilt
def phase_route(r: Reconstruction) -> DataFrame:
    return r.routes.select("contig", "backend", "needs_phasing")


@rebuilt
def any_unphased(r: Reconstruction) -> DataFrame:
    return r.genotypes.agg(F.coalesce(F.bool_or(F.col("gt").contains("/")), F.lit(False)).alias("any_unphased"))


@rebuilt
def variable_ploidy_exists(r: Reconstruction) -> DataFrame:
    return r.ploidies.agg(F.bool_or("variable").alias("variable"))


@rebuilt
def hap_offsets(r: Reconstruction) -> DataFrame:
    return ploidy.haplotype_offsets(r.ploidies).select("contig", F.col("sample_idx").cast("long").alias("sample_idx"), F.col("offset").cast("long").alias("hap_offset"), F.col("haplotypes").cast("long").alias("haplotypes"))


@rebuilt
def ploidy_groups(r: Reconstruction) -> DataFrame:
    return r.ploidies.groupBy("contig", F.col("max_ploidy").cast("long").alias("ploidy")).agg(F.array_join(F.array_sort(F.collect_list("sample")), ",").alias("samples"))


@rebuilt
def ploidy_runs(r: Reconstruction) -> DataFrame:
    return ploidy.ploidy_runs(r.genotypes).select("sample", "contig", "start_pos", "end_pos", F.col("ploidy").cast("long").alias("ploidy"), "n")


@rebuilt
def ploidy_runs_eligible(r: Reconstruction) -> DataFrame:
    return ploidy.eligible_runs(ploidy.ploidy_runs(r.genotypes)).select("sample", "contig", "start_pos", "end_pos", F.col("ploidy").cast("long").alias("ploidy"), "n")


@rebuilt
def run_merge(r: Reconstruction) -> DataFrame:
    phased = r.genotypes.where("rec_ord % 3 = 0").select("contig", "pos", "sample", F.col("rec_ord").alias("ord"), F.translate("gt", "/", "|").alias("gt"))
    return ploidy.merge_runs(r.genotypes, phased).select("contig", "rec_ord", "sample", "gt")


@over
def sample_subset(x: Genome) -> DataFrame:
    return pick_samples(x.records, [2, 0, 9]).select("contig", "rec_ord", F.array_join("samples", "\t").alias("columns"))


@over
def region_scan(x: Genome) -> DataFrame:
    return in_region(x.records, "chr7", 4000, 9000).select("contig", "rec_ord", "pos", "ref")


@rebuilt
def clean_gt(r: Reconstruction) -> DataFrame:
    lines = sink.cleaned_lines(r.checked.where("reason is null"), r.genotypes, r.overall_ploidies)
    return lines.select("contig", "rec_ord", "line")


@rebuilt
def sample_warnings(r: Reconstruction) -> DataFrame:
    return r.warnings.where("sample_idx is not null").groupBy("contig", F.col("sample_idx").cast("long").alias("sample_idx"), "reason").agg(F.count(F.lit(1)).alias("n"))


@rebuilt
def first_warnings(r: Reconstruction) -> DataFrame:
    return sink.first_warnings(r.warnings).groupBy("contig").agg(F.count(F.lit(1)).alias("stored"), F.min("rec_ord").alias("first_rec"), F.max("rec_ord").alias("last_rec"))


@over
def single_sample_canonical(x: Genome) -> DataFrame:
    one = x.samples.where("sample_idx = 0")
    cut = x.records.withColumn("samples", F.slice("samples", 1, 1))
    r = reconstruct(Genome(one, cut, x.ref_contigs, x.ref_tiles, x.tile_size), single_sample=True)
    return r.called.select("contig", "rec_ord", F.col("hap").cast("long").alias("hap"), F.col("code").cast("long").alias("code"))


@rebuilt
def haplotype_calls(r: Reconstruction) -> DataFrame:
    return r.called.groupBy("contig", F.col("sample_idx").cast("long").alias("sample_idx"), F.col("hap").cast("long").alias("hap"), F.col("code").cast("long").alias("code")).agg(F.count(F.lit(1)).alias("n"))


@rebuilt
def segments(r: Reconstruction) -> DataFrame:
    return r.segments.select("contig", F.col("sample_idx").cast("long").alias("sample_idx"), F.col("hap").cast("long").alias("hap"), "ord", (F.col("gap_end") - F.col("gap_start")).alias("gap_length"), "text")


@rebuilt
def hap_lengths(r: Reconstruction) -> DataFrame:
    return r.segments.groupBy("contig", "sample", F.col("hap").cast("long").alias("hap")).agg(F.sum(emit.segment_length()).alias("length"))


@rebuilt
def segment_offsets(r: Reconstruction) -> DataFrame:
    return emit.segment_offsets(r.segments).select("contig", "sample", F.col("hap").cast("long").alias("hap"), "ord", F.col("offset").cast("long").alias("at"), "length")


@rebuilt
def hap_sequences(r: Reconstruction) -> DataFrame:
    return r.sequences.select("contig", "sample", F.col("hap").cast("long").alias("hap"), F.length("seq").cast("long").alias("length"), F.md5("seq").alias("md5"))


@rebuilt
def fasta_lines(r: Reconstruction) -> DataFrame:
    name = sequence_name(F.col("sample"), F.col("contig"), F.col("hap"))
    return emit.wrapped_lines(r.pieces, 80).select(name.alias("name"), F.col("line").cast("long").alias("line"), "text")


@rebuilt
def merged_fasta(r: Reconstruction) -> DataFrame:
    return emit.merged_lines(r.segments, r.pieces, r.contigs, 80).select("sample", F.col("hap").cast("long").alias("hap"), "line", "text")


@rebuilt
def region_sequences(r: Reconstruction) -> DataFrame:
    return r.region("chr7", 4000, 9000).select("contig", "sample", F.col("hap").cast("long").alias("hap"), F.length("seq").cast("long").alias("length"), F.md5("seq").alias("md5"))


@registered
def truth_haplotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences built from ALT edits alone, apart from the assembly."""
    r = reconstruct(genome(spark, sf_dir), single_sample=False)
    haps = r.ploidies.select("contig", "sample_idx", "sample", F.explode(F.sequence(F.lit(0), F.col("max_ploidy") - 1)).alias("hap"))
    built = verify.edited_sequences(contig_sequences(spark, sf_dir), haps, verify.allele_edits(r.called))
    return built.select("contig", "sample", F.col("hap").cast("long").alias("hap"), F.length("seq").cast("long").alias("length"), F.md5("seq").alias("md5"))


@rebuilt
def length_attribution(r: Reconstruction) -> DataFrame:
    return verify.length_attribution(r.called).select("contig", F.col("sample_idx").cast("long").alias("sample_idx"), F.col("hap").cast("long").alias("hap"), "rec_ord", "delta")


@rebuilt
def unexplained_lengths(r: Reconstruction) -> DataFrame:
    return verify.unexplained_lengths(r.segments, r.called, r.contigs).select("contig", F.col("sample_idx").cast("long").alias("sample_idx"), F.col("hap").cast("long").alias("hap"), "length", "expected")


@over
def chunk_plan(x: Genome) -> DataFrame:
    return profile.chunk_plan(x.ref_contigs, 5000)


@over
def tile_plan(x: Genome) -> DataFrame:
    return profile.tile_plan(x.ref_contigs, 8, 3, 5000).select("contig", F.col("hap_start").cast("long").alias("hap_start"), F.col("hap_end").cast("long").alias("hap_end"), "base_start", "base_end")


@over
def chunk_pad(x: Genome) -> DataFrame:
    return profile.chunk_pad(x.records)


@rebuilt
def output_estimate(r: Reconstruction) -> DataFrame:
    size, work = profile.output_estimate(F.col("variants"), F.col("length"), F.col("haplotypes"), 80)
    return r.routes.join(r.contigs, "contig").select("contig", size.alias("output_bytes"), work.alias("work_units"))


@rebuilt
def beagle_preflight(r: Reconstruction) -> DataFrame:
    need = (F.col("n_samples") * F.col("variants") * 64).cast("long")
    return r.routes.select("contig", need.alias("need_bytes"), (need <= F.lit(100_000 * 0.75)).alias("fits"))


def _literal(spark: SparkSession, values: tuple[str, ...], name: str) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def _files(spark: SparkSession) -> DataFrame:
    return _literal(spark, FILES, "path").withColumn("name", F.element_at(F.split("path", "/"), -1))


@registered
def file_pick_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pick_sample_files(_literal(spark, ("S1", "S2", "S3", "S10"), "sample"), _files(spark))


@registered
def file_pick_chromosome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pick_chromosome_files(_literal(spark, ("chr1", "10", "chrX", "2", "chr3"), "contig"), _files(spark))


@registered
def alignment_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark)
    return has_alignment_index(files.where(F.lower("name").rlike(r"\.(bam|cram)$")).select("path"), files)


@registered
def warning_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _literal(spark, WARNING_TEXTS, "message").select("message", classify_warning(F.col("message")).alias("reason"))


@registered
def name_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _literal(spark, NAMES, "name").select("name", sanitize(F.col("name")).alias("clean"))


@over
def sorted_check(x: Genome) -> DataFrame:
    shuffled = x.records.withColumn("rec_ord", F.when(F.col("rec_ord") % 50 == 0, F.col("rec_ord") - 3).otherwise(F.col("rec_ord")) * 1000 + F.col("pos") % 7)
    return unsorted_records(shuffled)


@over
def source_variants(x: Genome) -> DataFrame:
    """Biallelic, plain variants with strictly increasing positions: what a generator would take."""
    plain = x.records.where(~F.col("alt").contains(",") & g.is_nucleotides(F.col("ref")) & g.is_nucleotides(F.col("alt")))
    order = W.partitionBy("contig").orderBy("rec_ord")
    return plain.withColumn("before", F.lag("pos").over(order)).where("before is null or pos > before").select("contig", "rec_ord", "pos", "ref", "alt")


@over
def region_selection(x: Genome) -> DataFrame:
    nth = F.row_number().over(W.partitionBy("contig").orderBy("rec_ord"))
    return x.records.withColumn("nth", nth).where("nth <= 40").groupBy("contig").agg(F.max(F.col("pos") + F.length("ref") - 1).cast("long").alias("region_end"))


@rebuilt
def overlap_skips(r: Reconstruction) -> DataFrame:
    return r.chosen.join(r.chosen.where("applied").select("contig", "rec_ord"), ["contig", "rec_ord"], "left_anti").select("contig", "rec_ord", "pos")


@rebuilt
def length_differences(r: Reconstruction) -> DataFrame:
    """Each haplotype's length less its contig's, as summed over the calls that change it."""
    wrote = F.when(F.col("code") >= 0, F.length("allele")).otherwise(1)
    return r.called.groupBy("contig", F.col("sample_idx").cast("long").alias("sample_idx"), F.col("hap").cast("long").alias("hap")).agg(F.sum(wrote - (F.col("end") - F.col("start"))).cast("long").alias("delta"))
