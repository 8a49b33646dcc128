"""VCF text: lines in file order, the header, and parsed records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Columns before the samples.
FIXED_COLUMNS = 9


class HeaderError(ValueError):
    """The file has no usable ``#CHROM`` line."""


@dataclass
class VcfHeader:
    samples: list[str]
    contigs: list[str]


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, value): a text file's lines in file order; gzip, of several members too, by its extension.

    Splits of one file are numbered by size, not place, so ``ord`` leads with the split's place.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    starts = rows.select("block").distinct().withColumn("nth", F.row_number().over(W.orderBy("block")) - 1)
    inside = F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    # one row a split
    return rows.join(starts, "block").select((F.col("nth") * F.lit(1 << 33) + inside).cast("long").alias("ord"), "value")


def read_header(lines: DataFrame) -> VcfHeader:
    """Sample and contig names in order; header lines only reach the driver."""
    head = [r["value"] for r in lines.where(F.col("value").startswith("#CHROM")).orderBy("ord").limit(1).collect()]
    if not head:
        raise HeaderError("no '#CHROM' line")
    columns = head[0].rstrip("\r\n").split("\t")
    if len(columns) < FIXED_COLUMNS + 1:
        raise HeaderError(f"'#CHROM' has {len(columns)} columns, 10 or more are needed")
    found = lines.where(F.col("value").startswith("##contig=<")).select("ord", F.regexp_extract("value", r"[<,]ID=([^,>]+)", 1).alias("id")).where("id <> ''").orderBy("ord").collect()
    return VcfHeader(columns[FIXED_COLUMNS:], list(dict.fromkeys(r["id"] for r in found)))


def parse_records(lines: DataFrame) -> DataFrame:
    """(contig, rec_ord, pos, id, ref, alt, qual, filter, info, format, samples, malformed) of record lines.

    Header lines and lines with under nine fields are dropped silently. ``malformed`` has the
    reason why a line does not parse: an empty contig, a position that is no unsigned integer
    or is 0 (``invalid_pos``), an empty or ``.`` REF. Empty sample columns at the end go.
    """
    fields = F.split("value", "\t", -1)
    split = lines.where(~F.col("value").startswith("#")).select("ord", fields.alias("f")).where(F.size("f") >= FIXED_COLUMNS)
    f = lambda i: F.get("f", F.lit(i))
    pos: Column = F.when(f(1).rlike(r"^\+?[0-9]+$"), f(1).try_cast("bigint"))
    bad = F.when((f(0) == "") | pos.isNull(), "malformed_record").when(pos == 0, "invalid_pos").when((f(3) == "") | (f(3) == "."), "malformed_record")
    samples = F.slice("f", FIXED_COLUMNS + 1, F.greatest(F.size("f") - FIXED_COLUMNS, F.lit(0)))
    last = F.array_max(F.transform(samples, lambda s, i: F.when(s != "", i + 1).otherwise(0)))
    named = [f(i).alias(c) for i, c in ((2, "id"), (3, "ref"), (4, "alt"), (5, "qual"), (6, "filter"), (7, "info"), (8, "format"))]
    return split.select(f(0).alias("contig"), F.col("ord").alias("rec_ord"), pos.alias("pos"), *named, F.slice(samples, F.lit(1), F.coalesce(last, F.lit(0))).alias("samples"), bad.alias("malformed"))


def read_vcf(spark: SparkSession, path: str) -> tuple[VcfHeader, DataFrame]:
    lines = file_lines(spark, path)
    return read_header(lines), parse_records(lines)


def used_contigs(header: VcfHeader, records: DataFrame, ref_contigs: DataFrame, emit_variantless: bool = False) -> tuple[DataFrame, DataFrame]:
    """(used, dropped): header contigs that the reference and the records have, in header order."""
    spark = records.sparkSession
    named = spark.createDataFrame(list(enumerate(header.contigs)), "contig_ord int, contig string")
    used = named.join(ref_contigs.select("contig"), "contig", "left_semi")
    if not emit_variantless:
        used = used.join(records.select("contig").distinct(), "contig", "left_semi")
    return used.select("contig", "contig_ord"), named.join(used, "contig", "left_anti").select("contig", "contig_ord")


def check_phased(spark: SparkSession, path: str, n_samples: int) -> None:
    """Raises HeaderError unless a phaser's VCF has a ``#CHROM`` line with so many samples."""
    header = read_header(file_lines(spark, path))
    if len(header.samples) != n_samples:
        raise HeaderError(f"{path} has {len(header.samples)} samples, {n_samples} are expected")


def in_region(records: DataFrame, contig: str, start: int, end: int) -> DataFrame:
    """Records whose REF touches [start, end), 0-based, of a contig: plain comparisons, which a partitioned store prunes by."""
    return records.where((F.col("contig") == contig) & (F.col("pos") - 1 < end) & (F.col("pos") - 1 + F.length("ref") > start))


def pick_samples(records: DataFrame, indexes: list[int]) -> DataFrame:
    """Records with the sample columns of these indexes, in this order; ``.`` where a record has none."""
    return records.withColumn("samples", F.transform(F.array(*map(F.lit, indexes)), lambda i: F.coalesce(F.get("samples", i), F.lit("."))))
