"""Haplotype reconstruction end to end."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions.genotype import gt_is_valid, gt_ploidy
from strandweave.operators import emit, ploidy, profile, sink
from strandweave.operators.select import select_nonoverlapping, unsorted_records
from strandweave.operators.settle import settled
from strandweave.operators.validate import checked
from strandweave.sources.fasta import read_fasta
from strandweave.sources.fixture import Genome
from strandweave.sources.vcf import file_lines, read_vcf, used_contigs

#: Bases of a reference tile.
TILE_SIZE = 65536


class Phaser(Protocol):
    """Gives genotypes (``operators.ploidy.genotypes``' frame) phased; external programs plug in here."""

    def phase(self, gts: DataFrame, routes: DataFrame) -> DataFrame: ...


class NoPhaser:
    """Takes genotypes as they stand: unphased ones are applied by position."""

    def phase(self, gts: DataFrame, routes: DataFrame) -> DataFrame:
        return gts


class UnsortedInput(ValueError):
    """Records of a contig are not in order of position."""


@dataclass
class Reconstruction:
    """The frames of one run: checked and chosen records are written, all else is lazy."""

    checked: DataFrame
    chosen: DataFrame
    genotypes: DataFrame
    ploidies: DataFrame
    routes: DataFrame
    called: DataFrame
    segments: DataFrame
    warnings: DataFrame
    stats: DataFrame
    contigs: DataFrame
    tiles: DataFrame
    tile_size: int

    @property
    def pieces(self) -> DataFrame:
        return emit.pieces(self.segments, self.tiles, self.tile_size)

    @property
    def sequences(self) -> DataFrame:
        return emit.assemble(self.pieces)

    @property
    def overall_ploidies(self) -> DataFrame:
        """(sample_idx, max_ploidy) over all contigs."""
        return sink.sample_ploidy_overall(self.genotypes, F.when(gt_is_valid(F.col("gt")), gt_ploidy(F.col("gt"))))

    @property
    def haplotype_counts(self) -> DataFrame:
        """(contig, files): its haplotypes, each a file."""
        return self.ploidies.groupBy("contig").agg(F.sum("max_ploidy").cast("long").alias("files"))

    def region(self, contig: str, start: int, end: int) -> DataFrame:
        """(contig, sample_idx, sample, hap, seq) of [start, end), 0-based, of a contig; adjoining regions join up to the whole."""
        return emit.assemble(emit.pieces(emit.clipped(self.segments, contig, start, end), self.tiles, self.tile_size))


def reconstruct(genome: Genome, no_call: str = "N", validate_ref: bool = True, phaser: Phaser | None = None, single_sample: bool | None = None, has_reads: bool = False) -> Reconstruction:
    """Checks, selects, calls and emits all haplotypes of a genome's frames."""
    single = genome.samples.count() == 1 if single_sample is None else single_sample
    records = genome.records if "malformed" in genome.records.columns else genome.records.withColumn("malformed", F.when((F.col("ref") == ".") | (F.col("ref") == ""), "malformed_record"))
    contigs = genome.ref_contigs
    # frames that several steps read are written once
    rows = settled(checked(records, genome.ref_tiles, contigs, genome.tile_size, validate_ref))
    valid = rows.where("reason is null")
    base = F.col("ref_bases").substr(1, 1).alias("base")
    chosen = settled(select_nonoverlapping(valid.select("contig", "rec_ord", "pos", "ref", "alt", "start", "end", "alleles", base)))
    parsable = rows.where("malformed is null").select("contig", "rec_ord", "pos", "ref", "alt", "format", "samples")
    gts = ploidy.genotypes(parsable, genome.samples)
    ploidies = settled(ploidy.sample_ploidy(gts))
    routes = profile.phase_route(profile.contig_profile(ploidies, parsable), has_reads)
    gts = (phaser or NoPhaser()).phase(gts, routes)
    applied = emit.with_gaps(chosen.where("applied"))
    called = emit.calls(applied, gts, ploidies, single)
    # contigs without an applied record still come out, as the reference with their ploidies
    segs = emit.segments(chosen.where("applied"), called, ploidies, contigs, no_call)
    record_warnings = rows.where("reason is not null").select("contig", "rec_ord", F.lit(None).cast("int").alias("sample_idx"), "reason")
    overlaps = chosen.where("not applied").select("contig", "rec_ord", F.lit(None).cast("int").alias("sample_idx"), F.lit("overlap").alias("reason"))
    warnings = record_warnings.unionByName(overlaps).unionByName(emit.sample_warnings(valid, gts))
    return Reconstruction(rows, chosen, gts, ploidies, routes, called, segs, warnings, profile.contig_stats(rows, chosen), contigs, genome.ref_tiles, genome.tile_size)


def reconstruct_files(spark: SparkSession, vcf: str, fasta: str, no_call: str = "N", validate_ref: bool = True, emit_variantless: bool = False, phaser: Phaser | None = None, tile_size: int = TILE_SIZE) -> Reconstruction:
    """From a VCF and a FASTA file; contigs are those that header, records and reference share."""
    header, records = read_vcf(spark, vcf)
    ref_contigs, ref_tiles = read_fasta(spark, fasta, tile_size)
    used, _ = used_contigs(header, records, ref_contigs, emit_variantless)
    if used.isEmpty():
        raise ValueError("header, records and reference share no contig")
    kept = records.join(used.select("contig"), "contig", "left_semi")
    if not unsorted_records(kept.where("malformed is null")).isEmpty():
        raise UnsortedInput(vcf)
    samples = spark.createDataFrame(list(enumerate(header.samples)), "sample_idx int, sample string")
    contigs = used.join(ref_contigs.select("contig", "length"), "contig")
    return reconstruct(Genome(samples, kept, contigs, ref_tiles, tile_size), no_call, validate_ref, phaser)


def write(result: Reconstruction, prefix: str, merged: bool = False, width: int = 80) -> DataFrame:
    """Writes FASTA files and returns (path, bytes)."""
    return sink.write_fasta(result.segments, result.pieces, prefix, result.contigs if merged else None, width)


def cleaned_text(result: Reconstruction, vcf: str) -> DataFrame:
    """(place, value) of the cleaned VCF of a file's run."""
    cleaned = sink.cleaned_lines(result.checked.where("reason is null"), result.genotypes, result.overall_ploidies)
    return sink.cleaned_vcf(file_lines(result.checked.sparkSession, vcf), cleaned, result.contigs)
