"""Looking up companion files by name: alignments of samples, files of chromosomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name) of a folder's files; contents are not read."""
    return spark.read.format("binaryFile").load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("name"))


def pick_sample_files(samples: DataFrame, files: DataFrame) -> DataFrame:
    """(sample, path): an alignment whose name starts with the sample as a whole token; the shortest name, then path."""
    alignments = files.where(F.lower("name").rlike(r"\.(bam|cram)$"))
    after = F.expr("substring(name, length(sample) + 1, 1)")
    met = samples.join(alignments, F.col("name").startswith(F.col("sample")) & ~after.rlike("^[A-Za-z0-9]"))
    rank = F.row_number().over(W.partitionBy("sample").orderBy(F.length("name"), "path"))
    return met.withColumn("nth", rank).where("nth = 1").select("sample", "path")


def pick_chromosome_files(contigs: DataFrame, files: DataFrame) -> DataFrame:
    """(contig, path): the least path whose name has the chromosome (``chr`` once, twice or not at all) as a token."""
    bare = F.regexp_replace(F.lower("contig"), "^chr", "")
    tokens = files.select("path", F.explode(F.array_distinct(F.split(F.lower("name"), "[^a-z0-9]"))).alias("token")).where("token <> ''")
    wanted = contigs.select("contig", F.explode(F.array(bare, F.concat(F.lit("chr"), bare), F.concat(F.lit("chrchr"), bare))).alias("token"))
    return wanted.join(tokens, "token").groupBy("contig").agg(F.min("path").alias("path"))


def has_alignment_index(alignments: DataFrame, files: DataFrame) -> DataFrame:
    """``alignments`` (path) that have an index beside them."""
    stem = F.regexp_replace("path", r"\.(bam|cram)$", "")
    names = [F.concat("path", F.lit(e)) for e in (".bai", ".csi", ".crai")] + [F.concat(stem, F.lit(e)) for e in (".bai", ".crai")]
    wanted = alignments.select("path", F.explode(F.array(*names)).alias("index"))
    return alignments.join(wanted.join(files.select(F.col("path").alias("index")), "index").select("path").distinct(), "path", "left_semi")
