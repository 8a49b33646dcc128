"""The corpus pipeline, stage by stage, against brute force on what each stage was given."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import corpus_pipeline
from pyspark.sql import functions as F
from test_joins import WORD, brute_jaccard, brute_lines
from tokenizers import Tokenizer


def test_stages_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, given = docs.columns, docs.collect()
    outs = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        outs[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    named = {r["doc_id"]: r for r in given}

    spoken = outs["language_id"]
    assert all(named[r["doc_id"]] == r for r in spoken)
    lettered = [r for r in given if r["text"] and re.search(r"[^\W\d_]", r["text"])]
    assert len(spoken) >= 0.95 * len(lettered) and {r["doc_id"] for r in spoken} <= {r["doc_id"] for r in lettered}

    want = {i: t for i, t in brute_lines([(r["doc_id"], r["text"]) for r in spoken]) if t == named[i]["text"] or t.strip(" \n\t\r")}
    lined = outs["line_dedup"]
    assert {r["doc_id"]: r["text"] for r in lined} == want and all(r["n_chars"] == len(r["text"]) for r in lined)

    tops = brute_jaccard([(r["doc_id"], r["text"]) for r in lined], corpus_pipeline.SHINGLE_WORDS, corpus_pipeline.PERCENT)
    single = outs["jaccard_join"]
    assert sorted(r["doc_id"] for r in single) == sorted(i for i, _, top in tops if i == top)
    assert {(r["doc_id"], r["text"]) for r in single} <= {(r["doc_id"], r["text"]) for r in lined}

    texts, copies = {r["doc_id"]: r["text"] for r in single}, defaultdict(list)
    for r in outs["mix_sources"]:
        copies[r["doc_id"]].append(r["text"])
        assert r["n_chars"] == len(r["text"])
    for i, mine in copies.items():
        parts = [t for t in mine if t != texts[i]]
        assert len(parts) <= 1 and all(texts[i].startswith(t) for t in parts)
        assert sum(len(WORD.findall(t)) for t in mine) <= 3 * len(WORD.findall(texts[i]))

    pieces = outs["packing"]
    held = defaultdict(list)
    for r in pieces:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in held.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= corpus_pipeline.MAX_LENGTH
    # the tokens read back: pieces of one copy stand in sequences that follow each other
    tokenizer = Tokenizer.from_file(corpus_pipeline.tokenizer_path())
    read: list[tuple[int, list[int]]] = []
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        if r["start"] == 0:
            read.append((r["doc_id"], []))
        assert read[-1][0] == r["doc_id"] and len(read[-1][1]) == r["start"] and len(r["ids"]) == r["length"]
        read[-1][1].extend(r["ids"])
    want = Counter((i, tuple(tokenizer.encode(t, add_special_tokens=False).ids) + (0,)) for i, mine in copies.items() for t in mine)
    assert Counter((i, tuple(ids)) for i, ids in read) == want


def test_stages_on_odd_rows(spark, sf, tmp_path):
    """Null and repeated ids, repeated rows, null and blank texts, clashing column names."""
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    prose = next(r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").where("lang is not null and length(text) > 900").orderBy("doc_id").limit(1).collect())
    words = prose.split()
    texts = [prose, prose, " ".join(words[: len(words) // 2]), None, "", " \n", "12 34", " ".join(reversed(words))]
    rows = [{"doc_id": i, "text": t, "lang": "en", "source": None, "n_chars": None if t is None else len(t)} for i, t in zip([5, None, 5, 6, 7, None, 8, None], texts, strict=True)]
    rows += [rows[-1], rows[3]]
    docs = spark.createDataFrame([tuple(r.get(c) for c in schema.names) for r in rows], schema).withColumns({c: F.lit("x") for c in ("row", "removed_lines", "class_id", "component_id", "size", "uid")})
    kept = corpus_pipeline.dedup_documents(spark, docs, sf)
    # of the copies the row with an id stays; of fully equal rows one
    assert kept.columns == docs.columns and Counter(r["text"] for r in kept.collect()) == Counter(texts[1:]) and kept.where("text is null").count() == 1
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert name == "packing" or out.columns == docs.columns
        assert out.count() >= 0 and stage(spark, docs.limit(0), sf).count() == 0


def test_run_on_an_empty_table(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
