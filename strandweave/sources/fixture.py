"""A genomic fixture derived from ``nation`` and ``orders`` by integer arithmetic and md5 only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandweave.sources.fasta import tile

LENGTH, TILE = 16384, 4096
N_SAMPLES = 4


@dataclass
class Genome:
    """The frames of one input."""

    samples: DataFrame
    records: DataFrame
    ref_contigs: DataFrame
    ref_tiles: DataFrame
    tile_size: int


def contig_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey")
    part = lambda i: F.translate(F.md5(F.concat(F.col("n_nationkey").cast("string"), F.lit(":"), i.cast("string"))), "0123456789abcdef", "ACGTACGTACGTACGT")
    seq = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(LENGTH // 32 - 1)), part), "")
    named = nation.select(F.concat(F.lit("chr"), F.col("n_nationkey").cast("string")).alias("contig"), F.col("n_nationkey").cast("int").alias("contig_ord"), seq.alias("seq"))
    return named.repartition("contig")


def genome(spark: SparkSession, sf_dir: str) -> Genome:
    ref = contig_sequences(spark, sf_dir)
    k = F.col("k")
    x = k * 7919 % LENGTH
    keyed = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("k"))
    placed = keyed.select(
        "k",
        F.concat(F.lit("chr"), (k % 25).cast("string")).alias("contig"),
        F.when(k % 101 == 0, LENGTH).when(k % 103 == 0, LENGTH + 6).otherwise(1 + x - x % 32 + x % 3).cast("long").alias("pos"),
        F.when(k % 1009 == 0, 4200 + k % 7).when(k % 7 == 0, 2 + k % 5).otherwise(1).cast("int").alias("reflen"),
    )
    # dealt by key, so that bases are computed once and not for every row that a join pairs them with
    tiles = tile(ref.select("contig", "seq"), TILE).repartition("contig", "tile_id")
    # some REF are longer than a tile; the fixture's contigs are short, so REF is cut from whole ones
    rb = F.coalesce(F.col("seq").substr(F.col("pos").cast("int"), F.col("reflen")), F.lit(""))
    based = placed.join(ref.select("contig", "seq"), "contig", "left").select("k", "contig", "pos", rb.alias("rb"))
    b = F.col("rb")
    ref_allele = F.when(b == "", "A").when(k % 101 == 0, F.concat(b, F.lit("A"))).when(k % 97 == 0, F.translate(b, "ACGT", "CGTA")).when(k % 89 == 0, "X").when(k % 83 == 0, ".").otherwise(b)
    r = k % 23
    alt = F.when(r == 0, "<DEL>").when(r == 1, ".").when(r == 2, "X").when(r == 3, "A,<INS>").when(r == 4, "A,,C").when(r == 5, F.concat(b, F.lit("GG"))).otherwise(F.translate(F.substring(b, 1, 1), "ACGT", "GTAC"))

    def sample(j: int) -> Column:
        g = (k * 31 + j * 17) % 40
        gt = (
            F.when((g < 4) & (F.lit(j) == 3), "0|1|1").when(g < 10, "0|1").when(g < 20, "1|0").when(g < 26, "1|1").when(g < 32, "0|0").when(g == 32, ".|.").when(g == 33, ".").when(g == 34, "0|9")
            .when(g == 35, "-1|0").when(g == 36, "ABC").when(g == 37, "0|").when(g == 38, "0/1").otherwise("1/0")
        )
        return F.concat(gt, F.lit(":"), (k % 60).cast("string"))

    rec_ord = F.row_number().over(W.partitionBy("contig").orderBy("pos", "k")).cast("long")
    records = based.select(
        "contig", rec_ord.alias("rec_ord"), "pos", F.when(k % 3 == 0, F.concat(F.lit("rs"), k.cast("string"))).otherwise(".").alias("id"), ref_allele.alias("ref"), alt.alias("alt"),
        (k % 100).cast("string").alias("qual"), F.when(k % 2 == 0, "PASS").otherwise("q10").alias("filter"), F.concat(F.lit("K="), k.cast("string")).alias("info"), F.lit("GT:DP").alias("format"), F.array(*[sample(j) for j in range(N_SAMPLES)]).alias("samples")
    )
    samples = spark.range(N_SAMPLES).select(F.col("id").cast("int").alias("sample_idx"), F.concat(F.lit("S"), F.col("id").cast("string")).alias("sample"))
    contigs = ref.select("contig", "contig_ord", F.length("seq").cast("long").alias("length"))
    return Genome(samples, records, contigs, tiles, TILE)
