"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and read as code points with every run of non-letters as one blank;
n-grams of 1 to ``MAX_N`` code points are hashed to ``BUCKETS`` buckets. Training counts
come from a bounded sample of labelled rows (about ``SAMPLE_PER_LANG`` a language, chosen by
hash of the id) and are summed by (language, bucket) on the cluster. The smoothed
log-probability matrix (buckets x languages, float32) is broadcast; it has ``BUCKETS``
buckets, fewer if there are so many languages that it would exceed ``CELLS`` numbers, and
over ``CELLS`` / ``LEAST_BUCKETS`` languages are an error: none is left out. Scoring adds
each whole text's matrix rows in numpy.

The score is the posterior of the predicted language with the text's log-likelihood taken
per n-gram and weighed as ``EVIDENCE`` of them, so it does not saturate with length. A text
that is null or has no letter is ``und`` with score 0. Ties go to the language first by code
point. Without labelled rows every text is ``und``. Ids may be null or repeated; repeated
rows are judged each. An empty table gives an empty result, other columns are ignored,
whatever their names, and a very long text is read in pieces that overlap by the longest
n-gram, in some 6 bytes a code point.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.llm.graph import cut

#: Bounds and constants of the model.
BUCKETS, MAX_N = 1 << 16, 3
CELLS, LEAST_BUCKETS = 1 << 24, 1 << 10
SAMPLE_PER_LANG = 2000
EVIDENCE = 40.0
SMOOTHING = 0.5
#: Code points scored at once.
_PIECE = 1 << 18


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point of the basic plane and beyond, whether it is a letter or mark."""
    table = np.zeros(0x110000, dtype=bool)
    for cp in range(0x110000):
        if unicodedata.category(chr(cp))[0] in "LM":
            table[cp] = True
    return table


def buckets_for(n_langs: int) -> int:
    """Buckets of a model of so many languages, a power of two."""
    if n_langs * LEAST_BUCKETS > CELLS:
        raise ValueError(f"{n_langs} languages: at most {CELLS // LEAST_BUCKETS} can be told apart")
    return min(BUCKETS, 1 << ((CELLS // max(1, n_langs)).bit_length() - 1))


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points (blank for non-letters) of lower-cased texts, each followed by a blank, and the text of each."""
    raw = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    doc = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    letter = _letters()[raw]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one blank after each run of letters
    return np.where(letter, raw, 32)[keep], doc[keep]


def _long_points(text: str) -> np.ndarray:
    """:func:`_points` of one text, a piece at a time."""
    parts, open_ = [], False
    for at in range(0, len(text), _PIECE):
        raw = np.frombuffer(text[at : at + _PIECE].encode("utf-32-le", "surrogatepass"), dtype="<u4")
        letter = _letters()[raw]
        parts.append(np.where(letter, raw, 32).astype(np.uint32)[letter | np.append(open_, letter[:-1])])
        open_ = bool(letter[-1])
    return np.concatenate([*parts, np.full(int(open_), 32, np.uint32)])


def ngram_buckets(texts: list[str], buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text index, bucket) of every n-gram; an n-gram of order n is one that ends in its text. A long text comes alone."""
    if len(texts) == 1 and len(texts[0]) > _PIECE:
        points = _long_points(texts[0].lower())
        for at in range(0, len(points), _PIECE):
            part = points[at : at + _PIECE + MAX_N - 1]
            yield from _ngrams(part, np.zeros(len(part), np.int64), min(_PIECE, len(points) - at), buckets)
        return
    points, doc = _points([t.lower() for t in texts])
    yield from _ngrams(points, doc, len(points), buckets)


def _ngrams(points: np.ndarray, doc: np.ndarray, starts: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text index, bucket) of the n-grams that begin in the first ``starts`` points."""
    points = points.astype(np.uint64)
    prime, bits = np.uint64(0x9E3779B97F4A7C15), np.uint64(65 - buckets.bit_length())
    value = np.zeros(len(points), dtype=np.uint64)
    for n in range(1, MAX_N + 1):
        size = len(points) - n + 1
        if size <= 0:
            return
        value = value[:size] * prime + points[n - 1 :] + np.uint64(n)
        inside = doc[:size] == doc[n - 1 :]
        inside[starts:] = False
        yield doc[:size][inside], ((value * prime) >> bits).astype(np.int64)[inside]


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, list[str], list[int]]]:
    """Whole texts of about _PIECE code points together; a longer one alone."""
    held, owners, size = [], [], 0
    for i, text in enumerate(texts):
        if not text:
            continue
        if held and size + len(text) > _PIECE:
            yield len(held), held, owners
            held, owners, size = [], [], 0
        held.append(text)
        owners.append(i)
        size += len(text)
    if held:
        yield len(held), held, owners


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, usable: Column, sample_per_lang: int = SAMPLE_PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities by bucket and language) from the labelled, usable rows' sample."""
    labelled = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)).alias("u")
    )
    # one row a language; one more than can be told apart is an error
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(CELLS // LEAST_BUCKETS + 1).collect()}
    langs = sorted(sizes)
    buckets = buckets_for(len(langs))
    if not langs:
        return [], np.zeros((buckets, 0), dtype=np.float32)
    bound = F.create_map(*[x for g in langs for x in (F.lit(g), F.lit(int(min(1.0, sample_per_lang / sizes[g]) * (1 << 30))))])
    sample = labelled.where(F.col("u") <= bound[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), buckets), dtype=np.int64)
        place = {g: i for i, g in enumerate(langs)}
        for batch in batches:
            row = np.array([place[g] for g in batch.column(1).to_pylist()], dtype=np.int64)
            for _, texts, owners in _pieces(batch.column(0).to_pylist()):
                of = row[np.array(owners)]
                for doc, bucket in ngram_buckets(texts, buckets):
                    total += np.bincount(of[doc] * buckets + bucket, minlength=total.size).reshape(total.shape)
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(bucket, pa.int32()), pa.array(total[lang, bucket], pa.int64())], names=["lang", "bucket", "n"])

    # at most languages x buckets rows reach the driver
    counted = sample.select("text", "lang").mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((buckets, len(langs)))
    table[counted["bucket"].to_numpy(), counted["lang"].to_numpy()] = counted["n"].to_numpy()
    table = np.log((table + SMOOTHING) / (table.sum(axis=0) + SMOOTHING * buckets))
    return langs, table.astype(np.float32)


def score(docs: DataFrame, langs: list[str], table: np.ndarray, extra: dict[str, Column] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, extra columns, lang_pred, score) of every whole text."""
    extra = extra or {}
    shared = docs.sparkSession.sparkContext.broadcast(table)
    names = np.array([*langs, "und"], dtype=object)
    columns = ["doc_id", *extra, "lang_pred", "score"]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                total = np.zeros((part.num_rows, model.shape[1]))
                grams = np.zeros(part.num_rows)
                for n, texts, owners in _pieces(part.column(0).to_pylist()) if model.shape[1] else ():
                    owners = np.array(owners)
                    sums, sizes = np.zeros((n, model.shape[1])), np.zeros(n)
                    for doc, bucket in ngram_buckets(texts, len(model)):
                        heads = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
                        if len(heads):
                            sums[doc[heads]] += np.add.reduceat(model[bucket], heads, axis=0, dtype=np.float64)
                            sizes[doc[heads]] += np.diff(np.append(heads, len(doc)))
                    np.add.at(total, owners, sums)
                    np.add.at(grams, owners, sizes)
                best = np.where(grams > 0, total.argmax(axis=1) if model.shape[1] else 0, len(langs))
                mean = total / np.maximum(grams, 1)[:, None] * np.minimum(grams, EVIDENCE)[:, None]
                odds = np.exp(mean - mean.max(axis=1, keepdims=True, initial=-np.inf)) if model.shape[1] else mean
                post = np.where(grams > 0, odds.max(axis=1, initial=0) / np.maximum(odds.sum(axis=1), 1e-300), 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(names[best].tolist(), pa.string()), pa.array(post)], names=columns)

    # a text of marks or digits alone has no letter and is read as none
    text = F.col(text_col).cast("string")
    source = docs.select(F.when(text.rlike(r"\p{L}"), text).alias("__text"), F.col(id_col).alias("doc_id"), *[c.alias(k) for k, c in extra.items()])
    return source.mapInArrow(predict, source.drop("__text").withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0)}).schema)


def identify_languages(docs: DataFrame, sample_per_lang: int = SAMPLE_PER_LANG) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): trained on labelled rows outside the held-out fold."""
    langs, table = train(docs, ~held_out(), sample_per_lang)
    return score(docs, langs, table, {"held_out": held_out()})


def keep_identified(docs: DataFrame, min_score: float = 0.5, sample_per_lang: int = SAMPLE_PER_LANG) -> DataFrame:
    """``docs`` without texts that have no letters or whose language is less likely than not."""
    langs, table = train(docs, F.lit(True), sample_per_lang)
    columns = {f"__{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns)}
    found = score(docs, langs, table, columns).where((F.col("lang_pred") != "und") & (F.col("score") >= min_score))
    return found.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns)])
