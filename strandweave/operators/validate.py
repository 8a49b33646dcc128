"""Record checks in order: the first that fails is the record's reason (null: valid)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.functions.genotype import is_nucleotides, is_symbolic
from strandweave.operators.emit import reference_slices


def with_reference(records: DataFrame, ref_tiles: DataFrame, ref_contigs: DataFrame, tile_size: int) -> DataFrame:
    """Adds start, end (0-based, half open), the contig's length and the reference bases under REF, of any length.

    A REF inside one tile is read by one equi-join on (contig, tile); one that crosses a
    tile's end gathers its parts from all that it touches.
    """
    spanned = records.withColumns({"start": F.col("pos") - 1, "end": F.col("pos") - 1 + F.length("ref")})
    sized = spanned.join(ref_contigs.select("contig", F.col("length").alias("contig_length")), "contig", "left").withColumn("tile_id", F.floor(F.col("start") / tile_size))
    crosses = F.coalesce(F.floor((F.col("end") - 1) / tile_size) > F.col("tile_id"), F.lit(False))
    tile = ref_tiles.select("contig", "tile_id", F.col("seq").alias("tile_seq"))
    inside = (F.col("start") - F.col("tile_id") * tile_size + 1).cast("int")
    near = sized.where(~crosses).join(tile, ["contig", "tile_id"], "left").withColumn("ref_bases", F.col("tile_seq").substr(inside, F.length("ref"))).drop("tile_seq", "tile_id")
    far = sized.where(crosses).drop("tile_id")
    read = reference_slices(far.select("contig", "rec_ord", "start", "end"), ref_tiles, tile_size, "start", "end", "ref_bases")
    return near.unionByName(far.join(read.select("contig", "rec_ord", "ref_bases"), ["contig", "rec_ord"]).select(*near.columns))


def record_reason(validate_ref: bool = True) -> Column:
    """The reason column over :func:`with_reference`'s frame; ``malformed`` must be a column too."""
    alts = F.when(F.col("alt") == ".", F.array().cast("array<string>")).otherwise(F.split("alt", ",", -1))
    reason = (
        F.when(F.col("malformed").isNotNull(), F.col("malformed"))
        .when(F.col("start") >= F.col("contig_length"), "pos_out_of_range")
        .when(F.exists(alts, lambda a: a == ""), "empty_alt")
        .when(~is_nucleotides(F.col("ref")) | is_symbolic(F.col("ref")), "invalid_ref")
        .when(F.col("end") > F.col("contig_length"), "ref_interval_overflow")
    )
    return reason.when(F.upper("ref") != F.upper("ref_bases"), "ref_mismatch") if validate_ref else reason


def checked(records: DataFrame, ref_tiles: DataFrame, ref_contigs: DataFrame, tile_size: int, validate_ref: bool = True) -> DataFrame:
    """All records with start, end, alleles (REF first) and ``reason``."""
    base = records if "malformed" in records.columns else records.withColumn("malformed", F.when((F.col("ref") == ".") | (F.col("ref") == ""), "malformed_record"))
    alleles = F.when(F.col("alt") == ".", F.array("ref")).otherwise(F.concat(F.array("ref"), F.split("alt", ",", -1)))
    return with_reference(base, ref_tiles, ref_contigs, tile_size).withColumns({"reason": record_reason(validate_ref), "alleles": alleles})
