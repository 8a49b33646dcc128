"""Calls, segments and ordered assembly of haplotype sequences.

A call writes: an allele as the VCF spells it; the no-call string once for a missing one,
whatever REF's length; one reference base for a call that falls back to the reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandweave.functions.genotype import MISSING, REFERENCE, call_codes, call_reasons
from strandweave.functions.text import sequence_name
from strandweave.operators.select import prefix_max


def calls(applied: DataFrame, gts: DataFrame, ploidies: DataFrame, single_sample: bool = False) -> DataFrame:
    """(contig, rec_ord, gap_start, start, end, base, sample_idx, sample, hap, code, allele) of :func:`with_gaps`' records."""
    codes = call_codes(F.col("gt"), F.col("alleles"), F.col("max_ploidy"), single_sample)
    record = ["contig", "rec_ord", "gap_start", "start", "end", "base"]
    joined = gts.drop("pos").join(applied.select(*record, "alleles"), ["contig", "rec_ord"]).join(ploidies.select("contig", "sample_idx", "max_ploidy"), ["contig", "sample_idx"])
    return joined.select(*record, "sample_idx", "sample", "alleles", F.posexplode(codes).alias("hap", "code")).select(
        *record, "sample_idx", "sample", "hap", "code", F.when(F.col("code") >= 0, F.element_at("alleles", F.col("code") + 1)).alias("allele")
    )


def sample_warnings(valid: DataFrame, gts: DataFrame) -> DataFrame:
    """(contig, rec_ord, sample_idx, reason) of valid records, applied or not."""
    joined = gts.join(valid.select("contig", "rec_ord", "alleles"), ["contig", "rec_ord"])
    return joined.select("contig", "rec_ord", "sample_idx", F.explode(call_reasons(F.col("has_column"), F.col("gt"), F.col("alleles"))).alias("reason"))


def with_gaps(applied: DataFrame) -> DataFrame:
    """Applied records with ``gap_start``, the end of the one before; the gap runs up to ``start``."""
    return prefix_max(applied, F.col("end"), "reach", inclusive=False).withColumn("gap_start", F.coalesce("reach", F.lit(0)).cast("long")).drop("reach")


def tails(applied: DataFrame, ref_contigs: DataFrame) -> DataFrame:
    """(contig, ord, gap_start, gap_end): what follows a contig's last applied record; ``ord`` is one more than the greatest rec_ord."""
    last = applied.groupBy("contig").agg(F.max("end").alias("reach"), F.max("rec_ord").alias("top"))
    return ref_contigs.join(last, "contig", "left").select("contig", (F.coalesce("top", F.lit(0)) + 1).alias("ord"), F.coalesce("reach", F.lit(0)).cast("long").alias("gap_start"), F.col("length").alias("gap_end"))


def reference_slices(spans: DataFrame, ref_tiles: DataFrame, tile_size: int, start: str, end: str, out: str) -> DataFrame:
    """Adds reference bases of [start, end): each tile touched gives its part, parts are joined in order."""
    key = spans.columns
    touched = spans.withColumn("tile_id", F.explode_outer(F.when(F.col(end) > F.col(start), F.expr(f"sequence({start} div {tile_size}, (`{end}` - 1) div {tile_size})"))))
    lo = F.greatest(F.col(start) - F.col("tile_id") * tile_size, F.lit(0))
    hi = F.least(F.col(end) - F.col("tile_id") * tile_size, F.lit(tile_size))
    parts = touched.join(ref_tiles.select("contig", "tile_id", "seq"), ["contig", "tile_id"], "left").withColumn("part", F.col("seq").substr((lo + 1).cast("int"), (hi - lo).cast("int")))
    ordered = F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("tile_id", "part"))))
    return parts.groupBy(*key).agg(F.array_join(F.transform(ordered, lambda p: p["part"]), "").alias(out))


def emitted(code: Column, allele: Column, base: Column, no_call: str) -> Column:
    return F.when(code == MISSING, no_call).when(code == REFERENCE, base).otherwise(allele)


def segments(applied: DataFrame, called: DataFrame, ploidies: DataFrame, ref_contigs: DataFrame, no_call: str = "N") -> DataFrame:
    """(contig, sample_idx, sample, hap, ord, gap_start, gap_end, text): what each haplotype writes, record by record, then the tail.

    A gap is its reference coordinates: bases are read from tiles where they are written, in
    :func:`pieces`, so no reference text is copied for every haplotype.
    """
    text = F.coalesce(emitted(F.col("code"), F.col("allele"), F.col("base"), no_call), F.lit(""))
    body = called.select("contig", "sample_idx", "sample", "hap", F.col("rec_ord").alias("ord"), "gap_start", F.col("start").alias("gap_end"), text.alias("text"))
    haps = ploidies.select("contig", "sample_idx", "sample", F.explode(F.sequence(F.lit(0), F.col("max_ploidy") - 1)).alias("hap"))
    last = haps.join(tails(applied, ref_contigs), "contig")
    return body.unionByName(last.withColumn("text", F.lit("")).select(*body.columns))


def segment_length() -> Column:
    return (F.col("gap_end") - F.col("gap_start") + F.length("text")).cast("long")


def segment_offsets(segs: DataFrame) -> DataFrame:
    """Adds ``length`` and ``offset``, each segment's place in its haplotype."""
    # coordinates of one haplotype, streamed: there are as many windows as haplotypes of all samples and contigs
    before = W.partitionBy("contig", "sample_idx", "hap").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    sized = segs.withColumn("length", segment_length())
    return sized.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))


def clipped(segs: DataFrame, contig: str, start: int, end: int) -> DataFrame:
    """Segments of a region [start, end): records that start in it, and the gaps' part inside it."""
    inside = segs.where((F.col("contig") == contig) & (F.col("gap_end") >= start) & (F.col("gap_start") < end))
    # past the region's end a record's own text belongs to the next region
    text = F.when(F.col("gap_end") < end, F.col("text")).otherwise("")
    cut = inside.withColumns({"gap_start": F.greatest("gap_start", F.lit(start).cast("long")), "text": text, "gap_end": F.least("gap_end", F.lit(end).cast("long"))})
    return cut.where("gap_end > gap_start or text <> ''").withColumn("gap_start", F.least("gap_start", "gap_end"))


def pieces(segs: DataFrame, ref_tiles: DataFrame, tile_size: int) -> DataFrame:
    """(contig, sample_idx, sample, hap, offset, part): each haplotype's text in parts of a tile or an allele at most.

    Gaps meet the tiles that they touch by (contig, tile), so coordinates travel and not bases.
    """
    placed = segment_offsets(segs)
    key = ["contig", "sample_idx", "sample", "hap"]
    written = placed.where("text <> ''").select(*key, (F.col("offset") + F.col("gap_end") - F.col("gap_start")).alias("offset"), F.col("text").alias("part"))
    touched = placed.where("gap_end > gap_start").withColumn("tile_id", F.explode(F.expr(f"sequence(gap_start div {tile_size}, (gap_end - 1) div {tile_size})")))
    lo, hi = F.greatest("gap_start", F.col("tile_id") * tile_size), F.least("gap_end", (F.col("tile_id") + 1) * tile_size)
    wanted = touched.select(*key, "tile_id", (F.col("offset") + lo - F.col("gap_start")).alias("offset"), (lo - F.col("tile_id") * tile_size).cast("int").alias("lo"), (hi - lo).cast("int").alias("n"))
    read = wanted.join(ref_tiles.select("contig", "tile_id", "seq"), ["contig", "tile_id"])
    return written.unionByName(read.select(*key, "offset", F.col("seq").substr(F.col("lo") + 1, F.col("n")).alias("part")))


def assemble(parts: DataFrame) -> DataFrame:
    """(contig, sample_idx, sample, hap, seq) of :func:`pieces`: whole sequences, for those that a cell (2 GB) can hold.

    ``wrapped_lines`` and ``sink.write_fasta`` need no whole sequence.
    """
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "part"))), lambda p: p["part"]), "")
    return parts.groupBy("contig", "sample_idx", "sample", "hap").agg(joined.alias("seq"))


def wrapped_lines(parts: DataFrame, width: int = 80) -> DataFrame:
    """(contig, sample_idx, sample, hap, line, text): FASTA body lines of :func:`pieces`, computed by offsets without whole sequences.

    Each part gives the ends of the lines that it touches; a line joins them in order.
    """
    n = F.length("part")
    touched = parts.where(n > 0).withColumn("line", F.explode(F.expr(f"sequence(offset div {width}, (offset + length(part) - 1) div {width})")))
    lo = F.greatest(F.col("line") * width - F.col("offset"), F.lit(0))
    hi = F.least((F.col("line") + 1) * width - F.col("offset"), n)
    cells = touched.select("contig", "sample_idx", "sample", "hap", "line", "offset", F.col("part").substr((lo + 1).cast("int"), (hi - lo).cast("int")).alias("part"))
    return cells.groupBy("contig", "sample_idx", "sample", "hap", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "part"))), lambda p: p["part"]), "").alias("text"))


def merged_lines(segs: DataFrame, parts: DataFrame, contigs: DataFrame, width: int = 80) -> DataFrame:
    """(sample, hap, line, text): the lines of each haplotype's merged file, contigs in header order, unknown ones last."""
    key = ["sample", "hap"]
    ranked = contigs.select("contig", "contig_ord")
    sizes = segs.groupBy("contig", *key).agg(F.sum(segment_length()).alias("length")).join(ranked, "contig", "left").withColumn("nth", F.coalesce("contig_ord", F.lit((1 << 31) - 1)))
    before = W.partitionBy(*key).orderBy("nth", "contig").rowsBetween(W.unboundedPreceding, -1)
    # one row a contig and haplotype
    heads = sizes.withColumn("line", F.coalesce(F.sum(1 + F.ceil(F.col("length") / width)).over(before), F.lit(0)).cast("long")).select("contig", *key, F.col("line").alias("head"))
    named = heads.select(*key, F.col("head").alias("line"), F.concat(F.lit(">"), sequence_name(F.col("sample"), F.col("contig"), F.col("hap"))).alias("text"))
    body = wrapped_lines(parts, width).join(heads, ["contig", *key]).select(*key, (F.col("head") + 1 + F.col("line")).alias("line"), "text")
    return named.unionByName(body)
