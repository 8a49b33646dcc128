"""Sinks: FASTA per contig or merged, cleaned VCF text, warnings and run statistics."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandweave.functions.genotype import clean_gt

#: Warnings echoed on standard error, and lines of a warnings file.
ECHOED, LOGGED = 100, 1_000_000


def write_fasta(segs: DataFrame, parts: DataFrame, prefix: str, contigs: DataFrame | None = None, width: int = 80) -> DataFrame:
    """Writes ``emit.pieces`` as FASTA files and returns (path, bytes); replaces files of earlier runs.

    Without ``contigs`` one file a (sample, contig, haplotype), else one a (sample, haplotype) with
    contigs in their order, unknown ones last. Parts arrive sorted and are wrapped as they
    stream, so no sequence is ever whole in memory. Names of single files have a colon, which
    Hadoop paths cannot have, so tasks write with plain file calls: ``prefix`` must be
    reachable by every executor.
    """
    merged = contigs is not None
    key = ["sample", "hap"] if merged else ["sample", "contig", "hap"]
    # a record without a base has its header too
    heads = segs.select("sample", "contig", "hap").distinct().withColumns({"offset": F.lit(-1).cast("long"), "part": F.lit("")})
    rows = heads.unionByName(parts.select("sample", "contig", "hap", "offset", "part"))
    placed = rows.join(contigs.select("contig", "contig_ord"), "contig", "left") if merged else rows.withColumn("contig_ord", F.lit(0))
    ranked = placed.withColumn("nth", F.coalesce("contig_ord", F.lit((1 << 31) - 1)))
    ordered = ranked.select("sample", "contig", "hap", "nth", "offset", "part").repartition(*key).sortWithinPartitions("sample", "hap", "nth", "contig", "offset")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = sink = record = None
        carry = ""

        def closed() -> pa.RecordBatch:
            if carry:
                sink.write(carry + "\n")
            sink.close()
            os.replace(f"{path}.part", path)
            return pa.RecordBatch.from_pydict({"path": [path], "bytes": [os.path.getsize(path)]})

        for batch in batches:
            for sample, contig, hap, part in zip(*(batch.column(c).to_pylist() for c in ("sample", "contig", "hap", "part")), strict=True):
                file = f"{prefix}{sample}_{hap}.fa" if merged else f"{prefix}{sample}_{contig}:{hap}.fa"
                if file != path:
                    if sink:
                        yield closed()
                    path, record, carry = file, None, ""
                    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
                    sink = open(f"{path}.part", "w", encoding="utf-8", newline="\n")
                if record != contig:
                    if carry:
                        sink.write(carry + "\n")
                    record, carry = contig, ""
                    sink.write(f">{sample}_{contig}:{hap}\n")
                carry += part
                full = len(carry) - len(carry) % width
                if full:
                    sink.write("".join(f"{carry[i : i + width]}\n" for i in range(0, full, width)))
                    carry = carry[full:]
        if sink:
            yield closed()

    # plain file calls a partition: the one place that needs per-partition imperative code
    return ordered.mapInArrow(write, "path string, bytes long")


def sample_ploidy_overall(gts: DataFrame, ploidy) -> DataFrame:
    """(sample_idx, max_ploidy) over the whole file; ``ploidy`` is a genotype's, null for an invalid one. 2 where nothing parses."""
    return gts.groupBy("sample_idx").agg(F.coalesce(F.max(ploidy), F.lit(2)).alias("max_ploidy"))


def cleaned_lines(valid: DataFrame, gts: DataFrame, ploidies: DataFrame) -> DataFrame:
    """(contig, rec_ord, line): validated records, columns up to INFO as they stand, FORMAT=GT, every genotype joined by ``|``.

    ``ploidies`` has each sample's greatest ploidy in the whole file, which an unusable genotype is filled up to.
    """
    shown = gts.join(valid.select("contig", "rec_ord", F.size("alleles").alias("n")), ["contig", "rec_ord"]).join(F.broadcast(ploidies.select("sample_idx", "max_ploidy")), "sample_idx")
    columns = shown.groupBy("contig", "rec_ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sample_idx", clean_gt(F.col("gt"), F.col("n"), F.col("max_ploidy")).alias("gt")))), lambda s: s["gt"]), "\t").alias("gts"))
    return valid.join(columns, ["contig", "rec_ord"]).select("contig", "rec_ord", F.concat_ws("\t", "contig", F.col("pos").cast("string"), "id", "ref", "alt", "qual", "filter", "info", F.lit("GT"), "gts").alias("line"))


def cleaned_vcf(lines: DataFrame, cleaned: DataFrame, contigs: DataFrame) -> DataFrame:
    """(place, value): the text of a cleaned VCF, its header as in ``lines`` but for FORMAT entries other than GT.

    Records follow by contig, in ``contigs``' order, and file order.
    """
    head = lines.where(F.col("value").startswith("#") & (~F.col("value").startswith("##FORMAT=") | F.col("value").startswith("##FORMAT=<ID=GT")))
    body = cleaned.join(contigs.select("contig", "contig_ord"), "contig").select(F.struct(F.col("contig_ord").cast("long").alias("contig_ord"), "rec_ord").alias("place"), F.col("line").alias("value"))
    return head.select(F.struct(F.lit(-1).cast("long").alias("contig_ord"), F.col("ord").alias("rec_ord")).alias("place"), "value").unionByName(body)


def write_text(placed: DataFrame, path: str) -> None:
    """Writes (place, value) as text, in order over the part files of a folder, which it replaces."""
    placed.repartitionByRange("place").sortWithinPartitions("place").select("value").write.mode("overwrite").text(path)


def prefilter_counts(checked: DataFrame, ref_contigs: DataFrame) -> DataFrame:
    """One row: records kept, dropped as their contig is not in the reference, and dropped as invalid."""
    known = checked.join(ref_contigs.where("length > 0").select("contig", F.lit(True).alias("known")), "contig", "left")
    parsed, known_ = F.col("malformed").isNull(), F.coalesce(F.col("known"), F.lit(False))
    return known.agg(
        F.count_if(parsed & known_ & F.col("reason").isNull()).alias("kept"),
        F.count_if(parsed & ~known_).alias("dropped_contig"),
        F.count_if(~parsed | (known_ & F.col("reason").isNotNull())).alias("dropped_invalid"),
    )


def reason_histogram(warnings: DataFrame) -> DataFrame:
    """(contig, reason, n), with totals of the run where contig is null."""
    return warnings.rollup("reason", "contig").agg(F.count(F.lit(1)).alias("n")).where("reason is not null").select("contig", "reason", "n")


def first_warnings(warnings: DataFrame, limit: int = 100) -> DataFrame:
    """Each contig's first warnings in file order: a report's stored messages."""
    nth = F.row_number().over(W.partitionBy("contig").orderBy("rec_ord", "sample_idx", "reason"))
    return warnings.withColumn("nth", nth).where(F.col("nth") <= limit).drop("nth")


def warning_log(warnings: DataFrame, contigs: DataFrame, limit: int = LOGGED) -> DataFrame:
    """(place, value): a warnings file's first ``limit`` lines, by contig and file order, and a note if there are more.

    The limit is the file's; use ``ECHOED`` for what a console gets.
    """
    placed = warnings.join(contigs.select("contig", "contig_ord"), "contig")
    place = F.struct(F.col("contig_ord").cast("long").alias("contig_ord"), "rec_ord", F.coalesce("sample_idx", F.lit(-1)).cast("long").alias("sample_idx"), "reason")
    who = F.when(F.col("sample_idx").isNotNull(), F.concat(F.lit(" sample "), F.col("sample_idx").cast("string"))).otherwise("")
    lines = placed.select(place.alias("place"), F.concat(F.lit("WARNING ["), "contig", F.lit(":"), F.col("rec_ord").cast("string"), F.lit("]"), who, F.lit(" "), "reason").alias("value"))
    last = F.struct(F.lit(1 << 62).alias("contig_ord"), F.lit(0).cast("long").alias("rec_ord"), F.lit(0).cast("long").alias("sample_idx"), F.lit("").alias("reason"))
    note = warnings.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select(last.alias("place"), F.lit(f"# warnings log reached {limit} lines; further warnings suppressed").alias("value"))
    return lines.orderBy("place").limit(limit).unionByName(note)


def run_log(routes: DataFrame, stats: DataFrame, files: DataFrame) -> DataFrame:
    """(contig, tag, value): a run's tagged lines by contig, and its summary where contig is null."""
    found = routes.select("contig", F.lit("DISCOVERY").alias("tag"), F.format_string("%s: %d records, %d haplotypes", "contig", "variants", "haplotypes").alias("value"))
    phased = routes.select("contig", F.when(F.col("needs_phasing"), "PHASING").otherwise("READY").alias("tag"), F.format_string("%s: %s", "contig", "backend").alias("value"))
    done = stats.join(files, "contig").select("contig", F.lit("COMPLETE").alias("tag"), F.format_string("%s: %d seen, %d applied, %d haplotypes", "contig", "seen", "applied", "files").alias("value"))
    total = stats.join(files, "contig").agg(F.count(F.lit(1)).alias("c"), F.sum("seen").alias("s"), F.sum("applied").alias("a"), F.sum("files").alias("f"))
    summary = total.select(F.lit(None).cast("string").alias("contig"), F.lit("SUMMARY").alias("tag"), F.format_string("%d contigs, %d seen, %d applied, %d haplotypes", "c", "s", "a", "f").alias("value"))
    return found.unionByName(phased).unionByName(done).unionByName(summary)
