"""Quality rules by compression bands: zstandard ratios of whole texts and of fixed chunks.

The ratio is UTF-8 bytes over compressed bytes. A text whose ratio leaves the band of its
length is rejected: above it the text repeats itself, below it the text is noise. Texts of
more than ``CHUNK_BYTES`` are also cut into chunks of that size, the last of which ends at
the text's end (it overlaps the one before), and each must lie in the chunk band, so a short
stretch of spam in a long text counts wherever it stands. The base rules come
first: a text with under 50 words, or with more than half its words in repeated 3-word
windows, has failed whatever its ratio.

Null texts count as texts without words; empty ones likewise; ids may be null or repeated,
and repeated rows are judged each. Other columns are ignored, whatever their names; an empty
table gives an empty result. All figures are over whole texts, long ones too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.textkit import chunks, raw_bytes, scan_words, shingles

LEVEL, CHUNK_BYTES = 3, 8192
#: (bytes below which the band holds, least ratio, greatest ratio): fixed limits by length.
BANDS = ((512, 1.05, 4.0), (2048, 1.2, 5.5), (8192, 1.35, 8.0), (65536, 1.5, 12.0), (float("inf"), 1.5, 16.0))
CHUNK_BAND = (1.3, 10.0)
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, max_chunk_ratio double, min_chunk_ratio double"


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _measures(texts: pa.Array) -> dict[str, np.ndarray]:
    words = scan_words(texts)
    raw, offsets, counts = words.raw, words.offsets, words.counts
    n = len(counts)
    # code points in words: bytes that do not continue a character
    lead = ((raw & 0xC0) != 0x80) & ~np.isin(raw, [9, 10, 11, 12, 13, 32])
    out = {"n_words": counts.astype(np.int64), "word_chars": _sums(lead, offsets), "n_symbols": _sums(_SYMBOLS[raw], offsets)}
    # words in 3-word windows that occur twice or more in their text
    repeat = np.zeros(n, dtype=np.int64)
    doc, value = shingles(words, 3)
    long = counts[doc] >= 3 if len(doc) else np.zeros(0, bool)
    doc, value = doc[long], value[long]
    if len(doc):
        order = np.lexsort((value, doc))
        same = (doc[order][1:] == doc[order][:-1]) & (value[order][1:] == value[order][:-1])
        twice = np.zeros(len(doc), dtype=bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        start = np.arange(len(doc)) - np.searchsorted(doc, doc) + words.first[doc]
        hit = np.zeros(len(words.hashes), dtype=bool)
        for i in range(3):
            hit[start[twice] + i] = True
        repeat = _sums(hit, words.first)
    out["n_repeat_words"] = repeat
    return out


def compression_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: int = LEVEL, chunk_bytes: int = CHUNK_BYTES, bands=BANDS, chunk_band=CHUNK_BAND) -> DataFrame:
    """One row per document: its words, the base rules' figures, the ratios and the verdict."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=level)
        for batch in batches:
            for part in chunks(batch, "text"):
                m = _measures(part.column("text"))
                raw, offsets = raw_bytes(part.column("text"))
                data = raw.tobytes()
                n = part.num_rows
                dup = np.zeros(n, dtype=np.int64)
                ratio, high, low = np.ones(n), np.full(n, np.nan), np.full(n, np.nan)
                fits = np.zeros(n, dtype=bool)
                for i in range(n):
                    text = data[offsets[i] : offsets[i + 1]]
                    seen: set[bytes] = set()
                    for line in text.split(b"\n"):
                        if line in seen:
                            dup[i] += 1
                        elif line.strip(b" \t\r\x0b\x0c"):
                            seen.add(line)
                    if not text:
                        continue
                    ratio[i] = len(text) / len(press.compress(text))
                    _, least, most = next(b for b in bands if len(text) < b[0])
                    fits[i] = least <= ratio[i] <= most
                    last = len(text) - chunk_bytes
                    if last > 0:
                        each = [chunk_bytes / len(press.compress(text[j : j + chunk_bytes])) for j in (*range(0, last, chunk_bytes), last)]
                        high[i], low[i] = max(each), min(each)
                        fits[i] &= chunk_band[0] <= low[i] and high[i] <= chunk_band[1]
                failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
                longs = [m["n_words"], m["word_chars"], m["n_symbols"], dup, m["n_repeat_words"]]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *[pa.array(x, pa.int64()) for x in longs], pa.array(failed), pa.array(fits & ~failed), pa.array(ratio), pa.array(high, from_pandas=True), pa.array(low, from_pandas=True)],
                    names=[c.split()[0] for c in _SCHEMA.split(", ")],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(judge, _SCHEMA)
