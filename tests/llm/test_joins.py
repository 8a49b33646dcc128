"""Joins on pairs against brute force: Jaccard, embeddings, lines, passages."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandweave.llm import embedding_dedup, graph, jaccard_join, queries, substring_dedup
from strandweave.llm.embedding_dedup import embedding_components
from strandweave.llm.graph import connected_components
from strandweave.llm.jaccard_join import jaccard_components
from strandweave.llm.line_dedup import line_dedup, within_edits
from strandweave.llm.substring_dedup import remove_repeats, repeated_passages
from strandweave.llm.textkit import scan_words, span_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string"


def components(ids, links):
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_jaccard(rows, k, percent):
    sets = {}
    for i, text in rows:
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())
    at = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            at[x].append(i)
    met = {(a, b) for m in at.values() for a in m for b in m if a < b}
    links = [(a, b) for a, b in met if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    top = components(sets, links)
    return {(i, len(s), top[i]) for i, s in sets.items()}


def test_jaccard_matches_brute_force_on_whole_table(spark, sf01):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf01}/documents.parquet").select("doc_id", "text").collect()]
    got = {tuple(r) for r in queries.op9_jaccard_join(spark, sf01).collect()}
    assert got == brute_jaccard(rows, 4, 85)


@pytest.mark.parametrize("edits", [3, 12])
def test_jaccard_chains_and_large_groups(spark, edits):
    rng = random.Random(edits)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(edits)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(words)))
    rows += [(200, " ".join(base)), (201, " ".join(base)), (202, None), (203, ""), (204, " \n"), (205, "One two"), (206, "one TWO"), (207, "one")]
    got = {tuple(r) for r in jaccard_components(spark.createDataFrame(rows, DOCS), k=4, percent=85).select("doc_id", "n_shingles", "component_id").collect()}
    assert got == brute_jaccard(rows, 4, 85)


@pytest.mark.parametrize("shared, k, percent", [(30, 4, 85), (170, 4, 85), (190, 1, 60)])
def test_jaccard_many_unlike_sets_in_one_region(spark, shared, k, percent):
    """A common passage of any share, families at the threshold behind it, and sets of a few shingles."""
    rng = random.Random(shared)
    passage = [f"p{i}" for i in range(shared)]
    rows = []
    for i in range(120):
        own = [f"o{rng.randrange(10**6)}" for _ in range(200 - shared)]
        for j in range(3):
            words = passage + own
            for _ in range(rng.randrange(6)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(99)}"
            rows.append((3 * i + j, " ".join(words)))
    rows += [(1000 + i, " ".join(rng.choices("abcdefg", k=rng.randrange(6)) + passage[: rng.randrange(14)])) for i in range(150)]
    got = {tuple(r) for r in jaccard_components(spark.createDataFrame(rows, DOCS), k=k, percent=percent, leaf=4).select("doc_id", "n_shingles", "component_id").collect()}
    assert got == brute_jaccard(rows, k, percent)


def test_jaccard_of_long_sets_around_the_signatures_bounds(spark):
    """Near and far copies of 1000 to 1040 and 8150 to 8250 words, and chance shingles between strangers."""
    rng = random.Random(6)
    rows = []
    for size in (1000, 8150):
        for f in range(6):
            base = [f"w{rng.randrange(3000)}" for _ in range(size + size // 25)]
            for j in range(4):
                words = base[: size + rng.randrange(size // 25)]
                for _ in range(rng.randrange(size // 40)):
                    words[rng.randrange(len(words))] = f"x{rng.randrange(99)}"
                rows.append((len(rows), " ".join(words)))
    got = {tuple(r) for r in jaccard_components(spark.createDataFrame(rows, DOCS), k=2, percent=85).select("doc_id", "n_shingles", "component_id").collect()}
    assert got == brute_jaccard(rows, 2, 85)


def test_jaccard_odd_input(spark):
    long = " ".join(f"w{i}" for i in range(400_000)) + " " + "z" * 3_000_000
    rows = [(1, long, 5), (2, "\n" + long.upper(), 6), (3, "a b c d e f", 7), (3, "g h i j k l", 8), (4, "g h i j k l m", 9), (5, "A  b c d e f", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int").withColumns({c: F.lit(0) for c in ("uid", "x", "n", "rid", "items", "class_id")})
    got = {tuple(r) for r in jaccard_components(docs, k=3, percent=100).select("doc_id", "n_shingles", "component_id").collect()}
    # equal sets and rows of one id hold together at 100 per cent too; 4 has a set of its own
    assert got == {(1, 399_999, 1), (2, 399_999, 1), (3, 4, 3), (5, 4, 3), (4, 5, 4)}
    with pytest.raises(ValueError):
        jaccard_components(docs, percent=0)


def test_jaccard_empty_table_and_nulls(spark):
    assert jaccard_components(spark.createDataFrame([], DOCS)).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (None, None)], DOCS)
    assert {tuple(r) for r in jaccard_components(rows).collect()} == {(None, 2, 1, 1), (1, 2, 1, 1), (None, 0, None, None)}


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = components({x for p in links for x in p}, links)
    assert {k: v for k, v in want.items() if k in got} == got
    assert all(want[k] == k for k in set(want) - set(got))


def test_components_followed_by_the_driver_or_by_joins(spark, monkeypatch):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(60)] + [(i + 1000, i + 999) for i in range(60, 0, -1)] + [(rng.randrange(300, 900), rng.randrange(300, 900)) for _ in range(400)]
    want = components({x for p in links for x in p}, links)
    edges = spark.createDataFrame(links, "a long, b long")
    for few in (graph.FEW_LINKS, 0):
        monkeypatch.setattr(graph, "FEW_LINKS", few)
        got = {r["id"]: r["component"] for r in connected_components(edges).collect()}
        assert {k: v for k, v in want.items() if k in got} == got and all(want[k] == k for k in set(want) - set(got))
    assert graph.compact(edges.repartition(50)).rdd.getNumPartitions() == graph.FEW_TASKS


def test_jaccard_cuts_make_no_more_rows_than_pairs(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for _ in range(40):
        base = [f"w{rng.randrange(2000)}" for _ in range(120)]
        for share in (64, 62, 61, 60, 60, 59, 58, 110):
            rows.append((len(rows), " ".join(base[:share] + [f"x{rng.randrange(10**6)}" for _ in range(120 - share)])))
    made, real = [], jaccard_join._children

    def watched(placed, *rest):
        out = graph.cut(real(placed, *rest))
        pairs = {r["rid"]: r["count"] * (r["count"] - 1) // 2 for r in placed.groupBy("rid").count().collect()}
        made.extend(r["count"] <= pairs[r["parent"]] for r in out.groupBy("parent").count().collect())
        return out

    monkeypatch.setattr(jaccard_join, "_children", watched)
    docs = spark.createDataFrame(rows, DOCS)
    got = {tuple(r) for r in jaccard_components(docs, k=2, percent=40, leaf=2).select("doc_id", "n_shingles", "component_id").collect()}
    assert got == brute_jaccard(rows, 2, 40) and all(made)


def brute_vectors(rows, threshold=0.95):
    good = {i: np.array(v, dtype=np.float64) for i, v in rows if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    links = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= threshold]
    n = defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    top = components([i for i, _ in rows], links)
    return {(i, n[i], top[i], top[i] == i) for i, _ in rows}


def test_embeddings_recall_and_exact_margin(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = brute_vectors([(r["vec_id"], r["embedding"]) for r in df.collect()])
    assert {tuple(r) for r in embedding_components(df, cells=8, margin_sd=None, block_rows=64).collect()} == want
    got = {tuple(r) for r in queries.op3_embedding_dedup(spark, sf).collect()}
    assert sum(r[1] for r in got) >= 0.95 * sum(r[1] for r in want)


def test_embeddings_group_of_a_third_and_pairs_at_the_threshold(spark):
    rng = np.random.default_rng(4)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    loose = unit(rng.normal(size=(500, 32)))
    step = rng.normal(size=loose.shape)
    step = unit(step - (step * loose).sum(axis=1, keepdims=True) * loose)
    twins = 0.951 * loose + np.sqrt(1 - 0.951**2) * step
    group = unit(unit(rng.normal(size=32)) + 0.02 * rng.normal(size=(500, 32)))
    rows = list(enumerate(np.concatenate([loose, twins, group]).tolist()))
    want = {r[0]: r for r in brute_vectors(rows)}
    got = {r["vec_id"]: tuple(r) for r in embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cells=60, block_rows=128).collect()}
    assert all(got[i][1] <= want[i][1] for i in want) and set(got) == set(want)
    assert sum(got[i][1] for i in range(1000)) >= 0.97 * sum(want[i][1] for i in range(1000))
    assert all(got[i] == want[i] for i in range(1000, 1500))


def test_embeddings_pairs_in_one_cone(spark):
    rng = np.random.default_rng(9)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    base = unit(unit(rng.normal(size=64)) + 0.5 * unit(rng.normal(size=(2000, 64))))
    step = rng.normal(size=base.shape)
    step = unit(step - (step * base).sum(axis=1, keepdims=True) * base)
    rows = list(enumerate(np.concatenate([base, 0.951 * base + np.sqrt(1 - 0.951**2) * step]).tolist()))
    want = {r[0]: r[1] for r in brute_vectors(rows)}
    got = {r["vec_id"]: r["n_links"] for r in embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cells=400).collect()}
    assert all(got[i] <= n for i, n in want.items()) and sum(got.values()) >= 0.999 * sum(want.values())


def test_embeddings_tables_one_by_one_and_steps_along_one_direction(spark, monkeypatch):
    """Tables beyond PASS_BYTES are dealt one by one; pairs at the threshold that all differ along one axis are found."""
    rng = np.random.default_rng(12)
    base = rng.normal(size=(3000, 64))
    base[:, 0] = 0
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    twins = 0.9501 * base
    twins[:, 0] = np.sqrt(1 - 0.9501**2)
    group = np.ones(64) / 8 + 0.004 * rng.normal(size=(300, 64))
    rows = list(enumerate([*base.tolist(), *twins.tolist(), *group.tolist(), *base[:50].tolist()]))
    want = {r[0]: r[1] for r in brute_vectors(rows)}
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = []
    for size in (1 << 40, 0):
        monkeypatch.setattr(embedding_dedup, "PASS_BYTES", size)
        got.append({r["vec_id"]: tuple(r) for r in embedding_components(vectors, cells=40, block_rows=100).collect()})
    assert got[0] == got[1] and all(r[1] <= want[i] for i, r in got[0].items())
    assert sum(r[1] for r in got[0].values()) >= 0.999 * sum(want.values())
    assert sum(got[0][i][1] for i in range(6000)) >= 0.999 * sum(want[i] for i in range(6000))


def test_embeddings_odd_vectors(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.1]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, []), (8, [1.0, 0.0, 0.0]), (9, [1.0, 0.0, 0.01]), (10, [1.0, None]), (11, [-1.0, 0.0])]
    got = {tuple(r) for r in embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == brute_vectors(rows)
    assert embedding_components(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embeddings_rows_with_one_id_and_unlike_vectors(spark):
    # 5 has a vector equal to 3's and one of its own, which takes 3's component too
    rows = [(3, [1.0, 0.0]), (5, [1.0, 0.0]), (5, [0.0, 1.0]), (6, [-1.0, 1.0])]
    got = sorted(tuple(r) for r in embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == [(3, 1, 3, True), (5, 0, 3, False), (5, 1, 3, False), (6, 0, 6, True)]


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


@pytest.mark.parametrize("k", [0, 1, 2, 3])
def test_banded_edit_distance(spark, k):
    rng = random.Random(k)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(9)))
        b = list(a)
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "a", "b"])
        pairs.append((a, "".join(b)))
    got = spark.createDataFrame(pairs, "a string, b string").withColumn("near", within_edits(F.col("a"), F.col("b"), k)).collect()
    assert [(r["a"], r["b"], r["near"]) for r in got if r["near"] != (edit(r["a"], r["b"]) <= k)] == []


def normal(line):
    return line.lower().translate(str.maketrans("123456789\t\r", "000000000  ")).strip(" ")


def brute_lines(rows, threshold=1, per_edit=20):
    """Texts without lines that an earlier one, of any row, equals or is within the shorter one's edits of."""
    seen, out = defaultdict(set), []
    known = set()
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        kept = []
        for line in (text or "").split("\n"):
            n = normal(line)
            gone = n != "" and n in known
            if n and not gone:
                for size in range(len(n) - threshold, len(n) + threshold + 1):
                    k = min(threshold, min(size, len(n)) // per_edit)
                    if abs(size - len(n)) <= k:
                        gone = gone or any(edit(n, s) <= k for s in seen[size] if close(n, s, k))
                known.add(n)
                seen[len(n)].add(n)
            if not gone:
                kept.append(line)
        out.append((i, None if text is None else "\n".join(kept)))
    return out


def close(a, b, k):
    """Whether a bag of letters differs in so little that the edit distance is worth computing."""
    return sum(((c := Counter(a)) - (d := Counter(b))).values()) <= k and sum((d - c).values()) <= k


@pytest.mark.parametrize("threshold, per_edit, hot", [(0, 1, 64), (1, 20, 64), (1, 1, 3), (2, 10, 4), (3, 1, 5)])
def test_lines_match_brute_force_with_hot_segments(spark, threshold, per_edit, hot):
    """Lines of every length, one group that shares all its segments, and near copies around the threshold."""
    rng = random.Random(threshold * 100 + per_edit)
    base = "".join(rng.choice("abcdef gh") for _ in range(66)).strip() + "z"
    rows = []
    for i in range(40):
        s = list(base)
        for _ in range(rng.randrange(threshold + 3)):
            at = rng.choice([1, 2, 20, 40, 41, 42, 43, 60, 64])
            s[at : at + rng.randrange(2)] = rng.choice(["", "q", "r", "ss"])
        short = "".join(rng.choice("ab ") for _ in range(rng.randrange(9)))
        rows.append((i, short + "\n" + "".join(s) + "\n" + ("x%02d" % i) * 9 + "\n" + base[: rng.randrange(len(base))] + rng.choice("uvw")))
    rows += [(100, None), (101, ""), (102, base), (103, base + "\n" + base), (None, base[1:] + "\nnobody has this one")]
    got = sorted((tuple(r) for r in line_dedup(spark.createDataFrame(rows, DOCS), threshold, per_edit, hot).select("doc_id", "text").collect()), key=str)
    assert got == sorted(brute_lines(rows, threshold, per_edit), key=str)


def test_lines_on_sf_table_and_empty(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").withColumn("pos", F.lit(1))
    got = {r["doc_id"]: r["text"] for r in line_dedup(df).collect()}
    assert got == dict(brute_lines([(r["doc_id"], r["text"]) for r in df.collect()]))
    empty = line_dedup(spark.createDataFrame([], DOCS))
    assert empty.count() == 0 and empty.columns == ["doc_id", "text", "removed_lines"]


def test_lines_of_odd_tables(spark):
    rows = [(1, "Footer 1\n\n}\nkept"), (2, "  footer 2\n\n}\nfooters"), (3, " \n\t\nFOOTER 9\nown"), (None, "own\nlast"), (4, None), (5, "one\nmine"), (5, "one\nyours\nmine"), (5, "one\nmine")]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("kept") for c in ("removed_lines", "row", "pos", "__of", "h1", "key", "rank")})
    out = line_dedup(df)
    assert out.columns == [*df.columns, "removed_lines_"] and out.where("removed_lines <> 'kept' or rank <> 'kept'").count() == 0
    got = sorted((tuple(r) for r in out.select("doc_id", "text").collect()), key=str)
    # lines at one place of rows that share an id are one occurrence
    assert got == sorted([(1, rows[0][1]), (2, "\nfooters"), (3, " \n\t\nown"), (None, "last"), (4, None), (5, "one\nmine"), (5, "one\nyours"), (5, "one\nmine")], key=str)


def test_lines_of_a_very_long_text_with_the_numbers_dropped(spark):
    """Linear in the lines: the numbers of removed lines are bound once, dropped by the caller or not."""
    text = "\n".join(f"line {''.join(chr(97 + int(d)) for d in str(i))} of the long text" for i in range(60_000))
    rows = [(1, text), (2, text + "\nlast words")]
    got = {r["doc_id"]: r["text"] for r in line_dedup(spark.createDataFrame(rows, DOCS), threshold=0).select("doc_id", "text").collect()}
    assert got == {1: text, 2: "last words"}


def brute_units(text):
    """(kind, first word, words, start, end, content) of every line and chosen window, as the module's docstring has it."""
    found = [(m.group(), m.start(), m.end()) for m in WORD.finditer(text or "")]
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w, _, _ in found]
    out, at = [], 0
    while at < len(found):
        to = at + 1
        while to < len(found) and "\n" not in text[found[to - 1][2] : found[to][1]]:
            to += 1
        out.append((0, at, to - at, found[at][1], found[to - 1][2], tuple(words[at:to])))
        at = to
    if len(words) >= substring_dedup.WINDOW:
        n = len(words) - substring_dedup.WINDOW + 1
        hashes = scan_words(pa.array([text]), fold_case=True).hashes
        value = span_hashes(hashes, np.arange(n), np.arange(n) + substring_dedup.WINDOW)
        picked = {i for j in range(n - substring_dedup.STEP + 1) for i in range(j, j + substring_dedup.STEP) if value[i] == value[j : j + substring_dedup.STEP].min()}
        out += [(1, i, substring_dedup.WINDOW, found[i][1], found[i + substring_dedup.WINDOW - 1][2], tuple(words[i : i + substring_dedup.WINDOW])) for i in picked]
    return out


def brute_passages(rows):
    """Every later occurrence of a unit, joined by words; rows of one id and text are one document."""
    known = lambda i: (i is None, i or 0)
    each = [(i, t, u) for i, t in {(i, t) for i, t in rows} for u in brute_units(t)]
    first = {}
    for i, _, u in each:
        # a window is hashed as a line of the same words is
        first[u[5]] = min(first.get(u[5], (known(i), u[3])), (known(i), u[3]))
    held = defaultdict(list)
    for i, t, u in each:
        top = first[u[5]]
        own = u[0] == 1 and top[0] == known(i) and u[3] < top[1] + u[4] - u[3]
        if (known(i), u[3]) != top and not own:
            held[(i, t)].append((*u[1:5], None if top[0][0] else top[0][1]))
    out = Counter()
    for (i, _), mine in held.items():
        runs = []
        for word, n, start, end, source in sorted(mine, key=lambda u: u[:2]):
            if runs and word <= runs[-1][0]:
                r = runs[-1]
                r[0], r[3], r[4] = max(r[0], word + n), max(r[3], end), r[4] + 1
                r[5].add(source)
            else:
                runs.append([word + n, word, start, end, 1, {source}])
        for last, word, start, end, n, sources in runs:
            out[(i, start, end, n, last - word, min((s for s in sources if s is not None), default=None))] += 1
    return out


def passages(df):
    return Counter(tuple(r[c] for c in ("doc_id", "start", "end", "n_units", "n_words", "first_doc_id")) for r in repeated_passages(df).collect())


def test_passages_match_brute_force_on_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    assert passages(df) == brute_passages(rows)
    cut = {r["doc_id"]: r for r in remove_repeats(df).collect()}
    spans = defaultdict(list)
    for i, start, end, *_ in brute_passages(rows):
        spans[i].append((start, end))
    for i, text in rows:
        want, at = "", 0
        for start, end in sorted(spans[i]):
            want, at = want + text[at:start], end
        assert cut[i]["text"] == (None if text is None else want + text[at:]) and [tuple(s) for s in cut[i]["removed_spans"]] == sorted(spans[i])


def test_passages_pasted_into_long_lines(spark):
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, want = [], {}
    for i in range(60):
        passage, before = words(50), words(rng.randrange(60))
        rows.append((i, " ".join(words(rng.randrange(60)) + passage + words(30))))
        rows.append((100 + i, " ".join(before + passage + words(rng.randrange(1, 60)))))
        want[100 + i] = (len(" ".join(before)), len(" ".join(before + passage)))
    df = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r for r in repeated_passages(df).collect()}
    assert set(got) == set(want) and passages(df) == brute_passages(rows)
    assert all(want[i][0] <= r["start"] + 1 and r["end"] <= want[i][1] and r["n_words"] >= 26 for i, r in got.items())


def test_passages_of_odd_tables(spark):
    rng = random.Random(2)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    a, b, c = text(70), text(80) + "\n\nRead more.\n" + text(9), text(60)
    rows = [(1, a), (5, a), (5, c), (5, "x " + a), (5, "x " + a), (7, b), (8, "read  MORE.\nEnd"), (9, None), (9, ""), (9, " \n"), (None, c), (None, "é " + b), (10, "One word. " * 40), (11, "ab " * 200)]
    df = spark.createDataFrame(rows, DOCS).withColumns({k: F.lit("kept") for k in ("removed_spans", "row", "start", "h1", "__of")})
    assert passages(df) == brute_passages(rows)
    out = remove_repeats(df)
    assert out.columns == [*df.columns, "removed_spans_"] and out.where("removed_spans <> 'kept' or row <> 'kept'").count() == 0
    left = Counter((r["doc_id"], r["text"]) for r in out.collect())
    # a row whose text is all its own stays whole, though others with its id lose theirs
    assert left[(5, c)] == 1 and left[(5, "")] == 1 and left[(8, "\nEnd")] == 1 and left[(9, None)] == 1 and left[(None, "")] == 1
    assert sum(n for (i, t), n in left.items() if i == 5 and t.startswith("x ") and len(t) < len(a)) == 2
    empty = remove_repeats(spark.createDataFrame([], DOCS))
    assert empty.count() == 0 and empty.columns == ["doc_id", "text", "removed_spans"] and repeated_passages(spark.createDataFrame([], DOCS)).count() == 0


def test_passages_of_a_very_long_text(spark):
    long = " ".join(f"w{i % 500_000}" for i in range(1_000_000))
    got = {(r["start"], r["end"]) for r in repeated_passages(spark.createDataFrame([(1, long)], DOCS)).collect()}
    half = len(" ".join(f"w{i}" for i in range(500_000))) + 1
    # the second half repeats the first but for a window's choice at its ends
    assert len(got) == 1 and all(abs(s - half) < 400 and abs(e - len(long)) < 400 for s, e in got)
