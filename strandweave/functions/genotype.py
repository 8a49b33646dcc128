"""Genotype and allele functions over columns.

Codes of a call: an allele's index (0 is REF), ``REFERENCE`` for a call that falls back to
one reference base, ``MISSING`` for a no-call.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REFERENCE, MISSING = -1, -2
GT_PATTERN = r"^([+-]?[0-9]+|\.)([/|]([+-]?[0-9]+|\.))*$"
SEPARATOR = "[/|]"


def extract_gt(fmt: Column, sample: Column) -> Column:
    """The sample's field at the place of GT in FORMAT; null if either lacks it."""
    place = F.array_position(F.split(fmt, ":", -1), "GT").cast("int")
    return F.when(place > 0, F.get(F.split(sample, ":", -1), place - 1))


def gt_tokens(gt: Column) -> Column:
    return F.split(gt, SEPARATOR, -1)


def gt_is_valid(gt: Column) -> Column:
    """Tokens are dots or integers that fit 32 bits; an empty token is an error."""
    fits = F.forall(gt_tokens(gt), lambda t: (t == ".") | t.try_cast("int").isNotNull())
    return F.coalesce(gt.rlike(GT_PATTERN) & fits, F.lit(False))


def gt_alleles(gt: Column) -> Column:
    """Allele indexes, null where missing or negative; null for an invalid GT."""
    index = lambda t: F.when(t.try_cast("int") >= 0, t.try_cast("int"))
    return F.when(gt_is_valid(gt), F.transform(gt_tokens(gt), index))


def is_effectively_phased(gt: Column) -> Column:
    """One allele, or none called, or ``|`` before every allele after the first."""
    alleles = gt_alleles(gt)
    return F.when(alleles.isNotNull(), (F.size(alleles) <= 1) | F.forall(alleles, lambda a: a.isNull()) | ~gt.contains("/"))


def gt_ploidy(gt: Column) -> Column:
    return F.when(gt == "", F.lit(0)).otherwise(F.regexp_count(gt, F.lit(SEPARATOR)) + 1).cast("int")


def is_symbolic(allele: Column) -> Column:
    return (allele == "") | (allele == "*") | allele.rlike(r"[<>\[\]]")


def is_nucleotides(allele: Column) -> Column:
    return allele.rlike("^[ACGTNacgtn]+$")


def variant_class(ref: Column, alt: Column) -> Column:
    single = F.forall(F.split(alt, ",", -1), lambda a: (F.length(a) == 1) & (a != "."))
    return F.when((F.length(ref) == 1) & single, "snv").otherwise("indel")


def clean_gt(gt: Column, n_alleles: Column, max_ploidy: Column) -> Column:
    """A GT as the cleaned VCF has it: out-of-range alleles missing, unusable ones all REF, joined by ``|``."""
    shown = F.transform(gt_alleles(gt), lambda a: F.when(a.isNull() | (a >= n_alleles), ".").otherwise(a.cast("string")))
    return F.coalesce(F.array_join(shown, "|"), F.array_join(F.array_repeat(F.lit("0"), max_ploidy), "|"))


def call_codes(gt: Column, alleles: Column, max_ploidy: Column, single_sample: bool = False) -> Column:
    """Codes of one sample's haplotypes at one record, padded or cut to ``max_ploidy``.

    ``gt`` is null where the record has no column or no GT for the sample. With one sample in
    the cohort an unphased heterozygote is put in ascending order.
    """
    usable = lambda a: F.element_at(alleles, a + 1)
    code = lambda a: (
        F.when(a.isNull() | (a >= F.size(alleles)), MISSING).when(is_symbolic(usable(a)) | ~is_nucleotides(usable(a)), MISSING).otherwise(a)
    )
    codes = F.transform(gt_alleles(gt), code)
    if single_sample:
        swap = (F.size(codes) == 2) & F.forall(codes, lambda c: c >= 0) & ~is_effectively_phased(gt) & (F.get(codes, F.lit(0)) > F.get(codes, F.lit(1)))
        codes = F.when(swap, F.reverse(codes)).otherwise(codes)
    filled = F.concat(F.coalesce(codes, F.array().cast("array<int>")), F.array_repeat(F.lit(REFERENCE), max_ploidy))
    return F.slice(filled, F.lit(1), max_ploidy)


def call_reasons(has_column: Column, gt: Column, alleles: Column) -> Column:
    """Reasons of the sample's warnings at a record, in order; one for each allele concerned."""
    usable = lambda a: F.element_at(alleles, a + 1)

    def reason(t: Column) -> Column:
        a = t.try_cast("int")
        bad = F.when(a >= 0, F.when(a >= F.size(alleles), F.lit(True)).otherwise(is_symbolic(usable(a)) | ~is_nucleotides(usable(a))))
        return F.when(t == ".", "missing_allele").when(a < 0, "negative_allele").when(bad, "invalid_allele_index")

    one = lambda r: F.array(F.lit(r))
    return (
        F.when(~has_column, one("sample_missing"))
        .when(gt.isNull(), one("cannot_extract_gt"))
        .when(~gt_is_valid(gt), one("malformed_gt"))
        .otherwise(F.filter(F.transform(gt_tokens(gt), reason), lambda r: r.isNotNull()))
    )
