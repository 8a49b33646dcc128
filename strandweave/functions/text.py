"""Names, sizes and warning texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A part of a warning's text and its reason; the first part that is contained decides.
WARNING_REASONS = (
    ("overlap/out-of-order", "overlap"),
    ("REF mismatch", "ref_mismatch"),
    ("exceeds contig length", "ref_interval_overflow"),
    ("outside contig", "pos_out_of_range"),
    ("POS must be >= 1", "invalid_pos"),
    ("malformed record", "malformed_record"),
    ("malformed:", "malformed_record"),
    ("malformed GT", "malformed_gt"),
    ("cannot extract GT", "cannot_extract_gt"),
    ("normalisation failed", "normalisation_failed"),
    ("invalid allele", "invalid_allele_index"),
    ("negative allele", "negative_allele"),
    ("missing allele", "missing_allele"),
    ("missing from record", "sample_missing"),
    ("record belongs to", "wrong_contig"),
    ("ALT contains empty", "empty_alt"),
    ("no valid REF", "invalid_ref"),
    ("REF allele is invalid", "invalid_ref"),
)


def classify_warning(message: Column) -> Column:
    """The reason of a warning text, ``other`` if no part is known."""
    parts = [F.when(message.contains(part), reason) for part, reason in WARNING_REASONS]
    return F.coalesce(*parts, F.lit("other"))


def sanitize(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9_-]", "_")


def sequence_name(sample: Column, contig: Column, hap: Column) -> Column:
    return F.format_string("%s_%s:%d", sample, contig, hap)


def parse_size(text: str) -> int:
    """``10``, ``4K``, ``2m``, ``1G``, ``1T`` in bytes, by powers of 1024, at most 2**64 - 1."""
    text = text.strip()
    unit = {"K": 1, "M": 2, "G": 3, "T": 4}.get(text[-1:].upper(), 0)
    digits = text[:-1] if unit else text
    if not digits.isdigit():
        raise ValueError(f"not a size: {text!r}")
    return min(int(digits) << (10 * unit), (1 << 64) - 1)


def parse_int_list(text: str) -> list[int]:
    """Comma-separated integers, the first of equal ones kept."""
    return list(dict.fromkeys(int(t) for t in text.split(",") if t.strip()))
