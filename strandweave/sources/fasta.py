"""Reference sequences: FASTA and its index, and tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandweave.operators.select import prefix_sum
from strandweave.sources.vcf import file_lines

#: Lines of a block, as a power of two.
BLOCK = 16


def tile(sequences: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """(contig, tile_id, seq): tiles of ``size`` bases, each followed by up to ``overlap`` of the next."""
    ids = F.explode(F.expr(f"sequence(0L, greatest(0L, (length(seq) - 1) div {size}))"))
    cut = sequences.select("contig", ids.alias("tile_id"), "seq")
    return cut.select("contig", "tile_id", F.col("seq").substr((F.col("tile_id") * size + 1).cast("int"), F.lit(size + overlap)).alias("seq"))


def read_fasta_index(spark: SparkSession, path: str) -> DataFrame:
    """(contig, contig_ord, length, offset, line_bases, line_width) of a ``.fai`` file."""
    rows = spark.read.csv(path, sep="\t", schema="contig string, length bigint, `offset` bigint, line_bases bigint, line_width bigint")
    return rows.withColumn("contig_ord", (F.row_number().over(W.orderBy("offset")) - 1).cast("int"))


def read_fasta(spark: SparkSession, path: str, size: int = 65536) -> tuple[DataFrame, DataFrame]:
    """(ref_contigs, ref_tiles) of a FASTA file; a contig's name is its header's first word.

    A line learns its header by the greatest header before it and its place by the running
    length, both in two levels over ``BLOCK`` lines, and is dealt to the tiles it touches: so
    neither a contig nor the list of headers is ever one task's.
    """
    lines = file_lines(spark, path).where("value <> ''")
    marked = lines.withColumns({"head": F.when(F.col("value").startswith(">"), F.col("ord")), "block": F.shiftright("ord", BLOCK)})
    # one row a block of lines
    tops = marked.groupBy("block").agg(F.max("head").alias("top")).withColumn("carry", F.max("top").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)))
    within = W.partitionBy("block").orderBy("ord").rowsBetween(W.unboundedPreceding, W.currentRow)
    owned = marked.join(tops.select("block", "carry"), "block").withColumn("of", F.coalesce(F.max("head").over(within), "carry"))
    heads = marked.where("head is not null").select(F.col("ord").alias("of"), F.regexp_extract("value", r"^>(\S*)", 1).alias("contig"))
    body = owned.where("head is null and of is not null").select("ord", "of", F.trim("value").alias("value")).withColumn("n", F.length("value").cast("long"))
    placed = prefix_sum(body, ["of"], F.shiftright("ord", BLOCK), ["ord"], F.col("n"), "at").join(heads, "of")
    lengths = body.groupBy("of").agg(F.sum("n").alias("length"))
    nth = F.row_number().over(W.orderBy("of")) - 1  # one row a contig
    contigs = heads.join(lengths, "of", "left").select("contig", nth.cast("int").alias("contig_ord"), F.coalesce("length", F.lit(0)).cast("long").alias("length"))
    touched = placed.where("n > 0").withColumn("tile_id", F.explode(F.expr(f"sequence(at div {size}, (at + n - 1) div {size})")))
    lo = F.greatest(F.col("tile_id") * size - F.col("at"), F.lit(0))
    hi = F.least((F.col("tile_id") + 1) * size - F.col("at"), F.col("n"))
    parts = touched.select("contig", "tile_id", "at", F.col("value").substr((lo + 1).cast("int"), (hi - lo).cast("int")).alias("part"))
    tiles = parts.groupBy("contig", "tile_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda p: p["part"]), "").alias("seq"))
    return contigs, tiles
