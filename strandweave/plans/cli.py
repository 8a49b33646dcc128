"""Command line: ``python -m strandweave VCF -f FASTA [-p PREFIX] ...``."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from pathlib import Path

from strandweave.functions.text import parse_int_list, parse_size
from strandweave.operators.sink import ECHOED


class UsageError(ValueError):
    """An option has a value that no run can use."""


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="strandweave", description="Haplotype sequences from a multi-sample VCF and a reference FASTA, on Spark.")
    out.add_argument("vcf", help="plain or gzip text")
    out.add_argument("-f", "--reference", required=True, metavar="FASTA")
    out.add_argument("-p", "--prefix", default="", help="put before the names of output files")
    out.add_argument("-n", "--no-call-string", default="N")
    out.add_argument("-t", "--threads", type=int, default=1, help="cores of a local run; a cluster's own setting wins")
    out.add_argument("-w", "--line-width", type=int, default=80)
    out.add_argument("-v", "--no-validate-ref", action="store_true")
    out.add_argument("-q", "--quiet", action="store_true")
    out.add_argument("--merged-output", action="store_true", help="one file a haplotype instead of one a contig and haplotype")
    out.add_argument("--emit-variantless", action="store_true", help="contigs without records too")
    out.add_argument("--chunk-size", type=int, metavar="BP", help="bases of a reference tile")
    out.add_argument("--max-memory", metavar="SIZE", help="the driver's heap in a local run")
    out.add_argument("--cleaned-vcf", metavar="FOLDER", help="write the validated records as VCF text too")
    out.add_argument("--warnings", metavar="FOLDER", help="write the warnings log there")
    out.add_argument("--beagle-ref-panel", metavar="DIR")
    out.add_argument("--beagle-genetic-map", metavar="DIR")
    out.add_argument("--gpu-devices", metavar="LIST", help="checked and otherwise ignored: Spark schedules the work")
    return out


def validate(args: argparse.Namespace) -> argparse.Namespace:
    """``args`` if every value can be used, else a UsageError that names the option."""
    for name in ("threads", "line_width", "chunk_size"):
        value = getattr(args, name)
        if value is not None and value < 1:
            raise UsageError(f"--{name.replace('_', '-')} must be greater than 0")
    for name, read in (("max_memory", parse_size), ("gpu_devices", parse_int_list)):
        if (value := getattr(args, name)) is not None:
            try:
                read(value)
            except ValueError as e:
                raise UsageError(f"--{name.replace('_', '-')}: {e}") from e
    for name in ("beagle_ref_panel", "beagle_genetic_map"):
        if (value := getattr(args, name)) is not None and not Path(value).is_dir():
            raise UsageError(f"--{name.replace('_', '-')} {value} is no directory")
    return args


def main(argv: Sequence[str] | None = None) -> int:
    try:
        args = validate(parser().parse_args(argv))
    except UsageError as e:
        print(e, file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from strandweave.operators import sink
    from strandweave.plans import reconstruct

    build = SparkSession.builder.appName("strandweave")
    if not SparkSession.getActiveSession():
        build = build.config("spark.default.parallelism", str(args.threads))
    if args.max_memory:
        build = build.config("spark.driver.memory", f"{max(1, parse_size(args.max_memory) >> 20)}m")
    spark = build.getOrCreate()
    run = reconstruct.reconstruct_files(spark, args.vcf, args.reference, args.no_call_string, not args.no_validate_ref, args.emit_variantless, tile_size=args.chunk_size or reconstruct.TILE_SIZE)
    written = reconstruct.write(run, args.prefix, args.merged_output, args.line_width)
    files, size = written.selectExpr("count(*)", "coalesce(sum(bytes), 0)").first()
    if args.cleaned_vcf:
        sink.write_text(reconstruct.cleaned_text(run, args.vcf), args.cleaned_vcf)
    if args.warnings:
        sink.write_text(sink.warning_log(run.warnings, run.contigs), args.warnings)
    if not args.quiet:
        for r in sink.warning_log(run.warnings, run.contigs, ECHOED).orderBy("place").collect():
            print(r["value"], file=sys.stderr)
        for r in sink.run_log(run.routes, run.stats, run.haplotype_counts).orderBy("contig", "tag").collect():
            print(f"[{r['tag']}] {r['value']}", file=sys.stderr)
        print(f"{files} files, {size} bytes", file=sys.stderr)
    return 0
