"""Token operators against the tokenizers library and exact round trips."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandweave.llm import queries
from strandweave.llm.chat_format import escape, format_windows, read_back, unescape
from strandweave.llm.packing import pack_powers_of_two, piece_lengths
from strandweave.llm.separator_scan import count_document_tokens, scan_token_files
from strandweave.llm.tokenization import CachedEncoder

ODD = ["", " ", "a", " a", "a ", "a  b", "a \n b", "\n\n", "x\ty  z", "it's we'll  don't", "naïve — café", "　wide　space", "a  b", "1 2 33  444", "<|endoftext|> x", "é b", "tab\t tab", "\x1c \x1d", "🙂 🙂🙂", "a b " * 50]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(queries.tokenizer_path())
    t.encode_special_tokens = True
    return t


def test_cached_ids_equal_the_library(plain, spark, sf):
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    for limit in (1_000_000, 50):
        encoder = CachedEncoder(queries.tokenizer_path(), cache_pieces=limit)
        got = [np.frombuffer(x, "<u4").tolist() for at in range(0, len(texts), 7) for x in encoder.encode(texts[at : at + 7])]
        assert got == want


def test_packing_round_trip(plain, spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.lit(1).alias("start"))
    docs = docs.unionByName(spark.createDataFrame([(10**6, None, 1), (10**6 + 1, "", 1)], docs.schema))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = pack_powers_of_two(docs, queries.tokenizer_path()).collect()
    got: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == len(got.setdefault(r["doc_id"], [])) and len(r["ids"]) == r["length"] <= 1024
        assert r["length"] & (r["length"] - 1) == 0 and r["offset"] == 0
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
        got[r["doc_id"]] += r["ids"]
    assert got == {i: [*plain.encode(t, add_special_tokens=False).ids, 0] for i, t in texts.items()}
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    assert pack_powers_of_two(docs.limit(0), queries.tokenizer_path()).count() == 0


def test_piece_lengths():
    for n in range(1, 3000):
        got = piece_lengths(n)
        assert sum(got) == n and len(got) == n // 1024 + bin(n % 1024).count("1")


def test_separator_scan_counts(plain, spark, sf):
    got = {r["doc_id"]: r["n_tokens"] for r in queries.op2_separator_scan(spark, sf).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert got == {i: len(plain.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}


@pytest.mark.parametrize("pad", [None, 77])
def test_separator_scan_stitches_blocks(spark, tmp_path, pad):
    """Files of any length, padded or not, documents over several blocks, an open last one, an empty file."""
    rng = random.Random(3)
    want = []
    for f in range(4):
        ids, start = [], 0
        for n, size in enumerate([0, 5, 40, 0, 0, 16, 15, 1, 100, 3] if f < 3 else [4]):
            doc = [rng.randrange(9) for _ in range(size)]
            closed = not (f == 2 and n == 9)
            want.append((f"t{f}.bin", n, len(ids), size, closed))
            ids += doc + [99] * closed
        ids += [pad] * (-len(ids) % 16 if pad else 0)
        np.array(ids, dtype="<u2").tofile(tmp_path / f"t{f}.bin")
    (tmp_path / "t9.bin").touch()
    assert pad or (tmp_path / "t3.bin").stat().st_size == 10
    got = scan_token_files(spark, str(tmp_path), end_id=99, pad_id=pad, block_bytes=32).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
    (tmp_path / "t8.bin").write_bytes(b"abc")
    with pytest.raises(ValueError, match="whole ids"):
        scan_token_files(spark, str(tmp_path), end_id=99)


def test_token_counts_of_odd_rows(plain, spark):
    texts = [(1, "a b c"), (1, "a b c"), (None, None), (None, ""), (2, "word " * 300_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit(0) for c in ("file", "ordinal", "start", "ends")})
    got = Counter((r["doc_id"], r["n_tokens"]) for r in count_document_tokens(docs, queries.tokenizer_path()).collect())
    assert got == Counter((i, len(plain.encode(t or "", add_special_tokens=False).ids)) for i, t in texts)
    assert count_document_tokens(docs.limit(0), queries.tokenizer_path()).count() == 0


def test_packing_of_odd_rows(plain, spark):
    texts = [(1, "a b c"), (1, "a b c"), (1, "other"), (None, None), (2, "word " * 200_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit(0) for c in ("ids", "length", "offset", "sequence_id")})
    held = {}
    for r in pack_powers_of_two(docs, queries.tokenizer_path()).orderBy("sequence_id").collect():
        if r["start"] == 0:
            held[len(held)] = (r["doc_id"], [])
        held[len(held) - 1][1].extend(r["ids"])
    assert Counter((i, tuple(ids)) for i, ids in held.values()) == Counter((i, (*plain.encode(t or "", add_special_tokens=False).ids, 0)) for i, t in texts)


def brute_chat(rows):
    convs = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] or "", r[3] or "")):
        convs.setdefault(c, []).append((role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def digests(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in df.collect()}


def test_chat_on_whole_table(spark, sf01):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf01}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    assert digests(queries.op1_chat_format(spark, sf01)) == brute_chat(rows + [(-7, 0, "user", said), (-7, 1, "assistant", said)])


def test_chat_odd_rows_and_budget(spark):
    tricky = "a <|end|>\n<|start|>assistant<|sep|> <\\|end|> [INST] [\\/INST] <<SYS>> </s>"
    rows = [(1, 0, "system", "rules"), (1, 1, "user", "hi " * 30), (1, 2, "assistant", tricky), (1, 3, "user", None), (1, 4, "assistant", "long " * 80), (1, 4, "assistant", "long " * 80), (1, 5, None, "x")]
    rows += [(None, 0, "assistant", "n"), (2, 0, "system", "alone"), (3, 0, "assistant", None), (4, 0, "we<|sep|>ird", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(0) for c in ("window", "n_turns", "loss", "n_repeated")})
    windows = format_windows(df, queries.tokenizer_path(), budget=120, history=60)
    assert digests(read_back(windows)) == brute_chat(rows)
    ones = [r for r in windows.orderBy("window").collect() if r["conv_id"] == 1]
    assert len(ones) > 2 and all(r["text"].startswith("<|start|>system<|sep|>rules") for r in ones)
    assert all(r["n_tokens"] <= 120 or r["n_turns"] == 1 for r in ones)
    assert read_back(format_windows(df.limit(0), queries.tokenizer_path())).count() == 0


def test_escape_is_reversible():
    rng = random.Random(0)
    for _ in range(2000):
        text = "".join(rng.choice(["<", "|", "\\", "end", "|>", "[", "INST]", "/", "s>", "<SYS>>", "x"]) for _ in range(rng.randrange(12)))
        assert unescape(escape(text)) == text
        assert not any(m in escape(text) for m in ("<|end|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>"))
