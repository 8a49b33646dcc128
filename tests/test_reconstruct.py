"""Queries against their SQL twins, and golden cases from text files."""

from __future__ import annotations

import gzip
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from strandweave.functions.text import parse_size
from strandweave.operators import ploidy, profile, sink, verify
from strandweave.operators.emit import wrapped_lines
from strandweave.operators.select import select_nonoverlapping
from strandweave.plans import catalogue, cli, oracles, reconstruct
from strandweave.sources import fasta, vcf
from strandweave.streaming.cursor import select_stream

HEADER = "##fileformat=VCFv4.2\n##FORMAT=<ID=DP,Number=1>\n##FORMAT=<ID=GT,Number=1>\n##contig=<ID=chr1>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"


def record(pos, ref, alt, *columns, contig="chr1", fmt="GT"):
    return "\t".join([contig, str(pos), "id", ref, alt, "9", "PASS", "A=1", fmt, *columns]) + "\n"


@pytest.fixture(scope="module")
def db(sf):
    out = duckdb.connect()
    for t in ("nation", "orders"):
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return out


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, sf, db, name):
    df = catalogue.QUERIES[name](spark, sf)
    got = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)
    run = db.execute(oracles.ORACLES[name])
    names = [d[0] for d in run.description]
    assert sorted(names) == sorted(df.columns)
    assert got == sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in run.fetchall()), key=repr)


@pytest.mark.parametrize(
    "rows, want",
    [
        ([(10, "C", "G", "0|1"), (10, "C", "T", "1|0")], {0: ("C", 100), 1: ("G", 100)}),
        ([(10, "CG", "A", "0|1"), (11, "G", "T", "1|0")], {0: ("C", 100), 1: ("A", 99)}),
    ],
)
def test_files_to_sequences(spark, tmp_path, rows, want):
    (tmp_path / "x.vcf").write_text(HEADER + "S1\n" + "".join(record(p, r, a, g) for p, r, a, g in rows))
    (tmp_path / "x.fa").write_text(">chr1\n" + "ACGT" * 25 + "\n")
    r = reconstruct.reconstruct_files(spark, str(tmp_path / "x.vcf"), str(tmp_path / "x.fa"))
    assert {x["hap"]: (x["seq"][9], len(x["seq"])) for x in r.sequences.collect()} == want


def written(spark, tmp_path, args):
    assert cli.main([str(tmp_path / "x.vcf"), "-f", str(tmp_path / "x.fa"), "-p", f"{tmp_path}/out/", "-q", *args]) == 0
    return {p.name: p.read_text() for p in (tmp_path / "out").iterdir()}


def test_long_ref_over_tiles_and_files_byte_for_byte(spark, tmp_path):
    """A deletion longer than a tile, two contigs, names beyond ASCII, files by contig and merged, lines by offsets."""
    rng = random.Random(3)
    one, two = ("".join(rng.choice("ACGT") for _ in range(n)) for n in (2000, 333))
    rows = [(5, one[4], "T" if one[4] != "T" else "A", "0|1", "1|1"), (100, one[99:1400], one[99], "1|0", "0|0"), (1500, one[1499], one[1499] + "GG", "1|0", "0|1")]
    body = "".join(record(p, r, a, *g) for p, r, a, *g in rows) + record(7, two[6], ".", "0|0", ".", contig="chr2")
    with gzip.open(tmp_path / "x.vcf.gz", "wt") as f:
        f.write(HEADER.replace("<ID=chr1>", "<ID=chr2>\n##contig=<ID=chr1>") + "S1\té\n" + body)
    lines = lambda s, w: "".join(s[i : i + w] + "\n" for i in range(0, len(s), w))
    (tmp_path / "x.fa").write_text(f">chr1 first\n{lines(one, 61)}>chr2\n{lines(two, 61)}>chr3\n\n")

    def hap(column, h):
        out, at = [], 0
        for p, r, a, *g in rows:
            out += [one[at : p - 1], (r, a)[int(g[column][2 * h])]]
            at = p - 1 + len(r)
        return "".join(out) + one[at:]

    args = [str(tmp_path / "x.vcf.gz"), "-f", str(tmp_path / "x.fa"), "-w", "50", "--chunk-size", "256", "-q"]
    assert cli.main([*args, "-p", f"{tmp_path}/each/", "--cleaned-vcf", f"{tmp_path}/clean", "--warnings", f"{tmp_path}/warned"]) == 0
    each = {p.name: p.read_text() for p in (tmp_path / "each").iterdir()}
    assert len(each) == 7  # a GT of one dot is haploid
    for i, sample in enumerate(("S1", "é")):
        for h in (0, 1):
            assert each[f"{sample}_chr1:{h}.fa"] == f">{sample}_chr1:{h}\n" + lines(hap(i, h), 50)
    no_call = two[:6] + "N" + two[7:]
    assert each["é_chr2:0.fa"] == ">é_chr2:0\n" + lines(no_call, 50) and each["S1_chr2:1.fa"] == ">S1_chr2:1\n" + lines(two, 50)
    assert cli.main([*args, "-p", f"{tmp_path}/all/", "--merged-output"]) == 0
    merged = {p.name: p.read_text() for p in (tmp_path / "all").iterdir()}
    assert merged == {f"{s}_{h}.fa": each.get(f"{s}_chr2:{h}.fa", "") + each[f"{s}_chr1:{h}.fa"] for s in ("S1", "é") for h in (0, 1)}
    clean = "".join(p.read_text() for p in sorted((tmp_path / "clean").glob("part-*"))).splitlines()
    assert "##FORMAT=<ID=DP,Number=1>" not in clean and "##FORMAT=<ID=GT,Number=1>" in clean and clean[4].startswith("#CHROM")
    assert clean[5:] == [record(7, two[6], ".", "0|0", ".", contig="chr2").strip(), *[record(p, r, a, *g).strip() for p, r, a, *g in rows]]
    assert "chr2:" in "".join(p.read_text() for p in (tmp_path / "warned").glob("part-*"))


def test_sample_columns_formats_and_ploidies(spark, tmp_path):
    """Too few and too many columns, no GT, triploids, foreign and short lines, an unknown contig."""
    rows = [
        record(4, "T", "A", "0|1|1"), record(8, "T", "G", "0|1|1", "1|0", "1|1"), record(12, "T", "C", "5", "7", fmt="DP"), record(16, "T", "C", "9:0&1", "3:1", fmt="DP:GT"),
        "short\tline\n", record(3, "G", "A", "0|0", "0|0", contig="chrU"), record(0, "T", "A", "0|0", "0|0"), record(20, ".", "A", "0|0", "0|0"),
    ]
    (tmp_path / "x.vcf").write_text(HEADER + "S1\tS2\n" + "".join(rows))
    (tmp_path / "x.fa").write_text(">chr1\n" + "ACGT" * 10 + "\n>chr9\nA\n")
    run = reconstruct.reconstruct_files(spark, str(tmp_path / "x.vcf"), str(tmp_path / "x.fa"))
    ref = "ACGT" * 10
    got = {(r["sample"], r["hap"]): r["seq"] for r in run.sequences.collect()}
    put = lambda *edits: "".join(dict(edits).get(i + 1, c) for i, c in enumerate(ref))
    assert got == {("S1", 0): ref, ("S1", 1): put((4, "A"), (8, "G")), ("S1", 2): put((4, "A"), (8, "G")), ("S2", 0): put((8, "G"), (16, "C")), ("S2", 1): ref}
    reasons = {(r["rec_ord"], r["sample_idx"], r["reason"]) for r in run.warnings.collect()}
    assert {r for _, _, r in reasons} >= {"sample_missing", "cannot_extract_gt", "malformed_gt", "invalid_pos", "malformed_record"}
    header, records = vcf.read_vcf(spark, str(tmp_path / "x.vcf"))
    samples = spark.createDataFrame(list(enumerate(header.samples)), "sample_idx int, sample string")
    load = profile.workload(records, samples).first()
    # the record without contig in the reference counts; GT text counts whether valid or not
    assert load["variants"] == 5 and load["malformed"] == 2 and load["haplotypes"] == 5


def test_input_errors(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">chr1\n" + "ACGT" * 25 + "\n")
    run = lambda text: (tmp_path / "x.vcf").write_text(text) and reconstruct.reconstruct_files(spark, str(tmp_path / "x.vcf"), str(tmp_path / "x.fa"))
    with pytest.raises(reconstruct.UnsortedInput):
        run(HEADER + "S1\n" + record(50, "C", "G", "0|1") + record(10, "C", "G", "0|1"))
    with pytest.raises(vcf.HeaderError):
        run(HEADER.replace("#CHROM", "#CHR") + "S1\n")
    with pytest.raises(vcf.HeaderError):
        run(HEADER[:-1] + "\n")
    with pytest.raises(ValueError, match="no contig"):
        run(HEADER + "S1\n" + record(5, "C", "G", "0|1", contig="chr7"))
    (tmp_path / "p.vcf").write_text(HEADER + "S1\tS2\n")
    vcf.check_phased(spark, str(tmp_path / "p.vcf"), 2)
    with pytest.raises(vcf.HeaderError):
        vcf.check_phased(spark, str(tmp_path / "p.vcf"), 3)
    for bad in (["-t", "0"], ["-w", "0"], ["--chunk-size", "0"], ["--max-memory", "x"], ["--gpu-devices", "1,a"], ["--beagle-ref-panel", f"{tmp_path}/none"]):
        assert cli.main(["a", "-f", "b", *bad]) == 2


def test_contigs_without_variants_come_out_if_asked_for(spark, tmp_path):
    (tmp_path / "x.vcf").write_text(HEADER.replace("<ID=chr1>", "<ID=chr1>\n##contig=<ID=chr2>") + "S1\n" + record(2, "C", "G", "1|0"))
    (tmp_path / "x.fa").write_text(">chr1\nACGT\n>chr2\nGGG\n")
    (tmp_path / "x.fa.fai").write_text("chr1\t4\t6\t4\t5\nchr2\t3\t17\t3\t4\n")
    for asked, contigs in ((False, {"chr1"}), (True, {"chr1", "chr2"})):
        run = reconstruct.reconstruct_files(spark, str(tmp_path / "x.vcf"), str(tmp_path / "x.fa"), emit_variantless=asked)
        assert {r["contig"] for r in run.contigs.collect()} == contigs
    index = {(r["contig"], r["contig_ord"], r["length"]) for r in fasta.read_fasta_index(spark, str(tmp_path / "x.fa.fai")).collect()}
    assert index == {("chr1", 0, 4), ("chr2", 1, 3)}


def greedy(rows):
    kept, cursor = [], -1
    for i, s, e in rows:
        if s >= cursor:
            kept.append(i)
            cursor = e
    return kept


def test_selection_over_bins_and_long_islands_and_as_a_stream(spark, tmp_path):
    rng = random.Random(1)
    starts = sorted(rng.randrange(5 << 20) for _ in range(3000))
    rows = [("c", i, s, s + rng.choice([1, 2, 40, 5000, 2 << 20] if i % 50 == 0 else [1, 2, 900])) for i, s in enumerate(starts)]
    df = spark.createDataFrame(rows, "contig string, rec_ord long, start long, `end` long")
    want = greedy([r[1:] for r in rows])
    for limit in (10_000, 5):
        assert sorted(r["rec_ord"] for r in select_nonoverlapping(df, limit).where("applied").collect()) == want


def test_regions_join_up_and_lines_equal_the_truth(spark, sf):
    run = reconstruct.reconstruct(catalogue.genome(spark, sf), single_sample=False)
    whole = {(r["sample"], r["hap"]): r["seq"] for r in run.sequences.where("contig = 'chr7'").collect()}
    joined = {k: "" for k in whole}
    for at in range(0, 16384, 5000):
        for r in run.region("chr7", at, min(at + 5000, 16384)).collect():
            joined[(r["sample"], r["hap"])] += r["seq"]
    assert joined == whole
    name = F.concat_ws("_", "sample", "contig", "hap")
    lines = wrapped_lines(run.pieces).select(name.alias("name"), "line", "text")
    assert verify.compare_lines(lines, lines).count() == 0
    changed = lines.withColumn("text", F.when((F.col("line") == 3) & F.col("name").startswith("S1_chr7"), "x").otherwise(F.col("text")))
    assert {(r["differing"], r["first_line"]) for r in verify.compare_lines(lines, changed).collect()} == {(1, 3)}


def test_sizes_heaps_and_runs(spark):
    assert parse_size("4K") == 4096 and parse_size("10") == 10
    assert [profile.beagle_heap(12 << 30, w) for w in (None, "64g", "2g", "x")] == ["7g", "7g", "2g", "7g"] and profile.beagle_heap(1) == "1g" and profile.beagle_heap(1 << 40) == "64g"
    assert profile.beagle_parameters(10) == (3, 12) and profile.beagle_parameters(11) == (6, 20) and profile.beagle_fits(1, 1, 100) and not profile.beagle_fits(2, 1, 100)
    runs = spark.createDataFrame([("S", "c", 1, 1, 2, 1), ("S", "c", 2, 9, 1, 3)], "sample string, contig string, start_pos long, end_pos long, ploidy int, n long")
    with pytest.raises(ploidy.NoEligibleRun):
        ploidy.require_eligible(runs)
    assert sink.ECHOED == 100
