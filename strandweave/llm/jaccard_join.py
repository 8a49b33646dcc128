"""Exact Jaccard join of word-shingle sets in metric space, as classes and components.

Distances are ``1 - J``, a metric. Equal sets are one class and are joined once.

1. *Pivots of one shingle.* Between unrelated documents every distance is exactly 1, so
   document pivots alone separate nothing and every triangle window spans the collection.
   The first pivots are therefore the sets of one shingle, ``{s}``: a set that holds s is
   nearer to it than any that doesn't, and ties go to the first s of one global order. So a
   set's home, its Voronoi region, is its first shingle, and its window reaches the regions
   of its first ``n - ceil(t n) + 1``: two sets that share none of these differ in more than
   ``1 - t``. Shingles that recur within a task's input come last in the order (any order is
   exact; this keeps common passages out of the regions). A region of one class is done.
2. *Small regions*, of ``LEAF`` classes at most, compare the pairs that the bounds leave:
   sizes within t of each other, and enough shingles behind the shared one.
3. *Large regions* take ``PIVOTS`` of their documents. All members are measured against
   them (exact intersections); members within ``1 - t`` link to the pivot, so a group of
   near copies is one component without a pair among them. Then the members nearest to the
   pivots are pivots too, as a text is nearer to its copies than these are to each other.
   A region of one component is done.
4. *Recursion.* What is left of a large region is cut again: each member goes to the cell
   of its nearest pivot document and, inside the triangle window of ``2 (1 - t)``, to those
   of the others; a cell is cut by pivots of one more shingle, ``{s, s'}``, with s' among
   the next in the order that a linked pair could share. The regions made this way go
   through 2 to 4 again. Where cutting makes more rows than the region has pairs, or doesn't
   at least halve these (a family of sets that are all half alike), its pairs that meet the triangle inequality for every
   pivot and are not yet connected are compared.

Results are whole: every document, every component, whatever the size of a group. Counts,
pivots and classes are pre-aggregated; rows of a frequent shingle are salted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandweave.llm.graph import compact, connected_components, neighbour_labels
from strandweave.llm.textkit import chunks, distinct_pairs, mix64, scan_words, shingles

#: Size of the table of recurring shingles: 2 ** ORDER_BITS bytes, whatever the input.
ORDER_BITS = 22
#: Hashes that a task gathers before it reports those that recur, or its regions.
_FLUSH = 1 << 22
_HOT = 3
#: Bits of a set's signature, and the shingles from which it has more: (shingles below which they hold, bits).
SIGNATURES = ((1024, 512), (8192, 4096), (float("inf"), 32768))
#: A shingle that recurs 2 ** SALT_LEVEL times or more is dealt to several tasks.
SALT_LEVEL = 12
#: Classes of a small region; document pivots of a large one; turns of choosing hubs, and their number.
LEAF, PIVOTS, HUBS, OUTSIDE = 32, 4, 1, 8
#: Rows up to which a list of ids is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000
#: Shingles, of 8 bytes, up to which pivots' sets are broadcast.
BROADCAST_ITEMS = 4_000_000


def _sets(part: pa.RecordBatch, k: int) -> tuple[np.ndarray, ...]:
    """Distinct shingles (text index, hash) of a batch's ``text``; each text's number of them, node and fingerprint."""
    doc, value = distinct_pairs(*shingles(scan_words(part.column("text"), fold_case=True), k))
    n = np.bincount(doc, minlength=part.num_rows)
    edge = np.cumsum(np.append(0, n))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(value))])
    other = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(value ^ np.uint64(0x5851F42D4C957F2D)))])
    f1, f2 = total[edge[1:]] - total[edge[:-1]], other[edge[1:]] - other[edge[:-1]]
    x = mix64(f1 + mix64(f2 ^ n.astype(np.uint64)))
    return doc, value, n, x.view(np.int64), f1.view(np.int64)


def _signatures(doc: np.ndarray, value: np.ndarray, n: np.ndarray) -> pa.Array:
    """Each text's signature as a list of 64-bit words."""
    bits = np.select([n < most for most, _ in SIGNATURES], [b for _, b in SIGNATURES])
    edge = np.cumsum(np.append(0, bits))
    place = edge[:-1][doc] + (value & (bits[doc] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(place, minlength=edge[-1]) & 1
    return pa.ListArray.from_arrays(pa.array(edge // 64, pa.int32()), pa.array(np.packbits(odd.astype(bool)).view(np.int64)))


def _survey(docs: DataFrame, k: int) -> DataFrame:
    """One pass: (uid, n, x, f, sig) of each row of ``docs`` (uid, text), and (h, times) of shingles that recur in a task's share.

    ``sig`` is the parity of a set's shingles in each of its hash buckets (``SIGNATURES``): two
    sets differ in at least as many shingles as their signatures in bits.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["uid", "n", "x", "f", "sig", "h", "times"]
        held: list[np.ndarray] = []
        kind = pa.list_(pa.int64())

        def report() -> pa.RecordBatch:
            value = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            head = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else np.zeros(0, np.int64)
            times = np.diff(np.append(head, len(value)))
            keep = times > 1
            held.clear()
            none = pa.nulls(int(keep.sum()), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(none), kind), pa.array(value[head][keep].view(np.int64)), pa.array(times[keep], pa.int64())], names=names)

        for batch in batches:
            for part in chunks(batch, "text"):
                doc, value, n, x, f = _sets(part, k)
                sig = _signatures(doc, value, n)
                none = pa.nulls(part.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("uid"), pa.array(n, pa.int64()), pa.array(x), pa.array(f), sig, none, none], names=names)
                held.append(value)
                if sum(map(len, held)) > _FLUSH:
                    yield report()
        yield report()

    return docs.select("uid", "text").mapInArrow(read, "uid long, n long, x long, f long, sig array<long>, h long, times long")


def _levels(recurring: DataFrame) -> np.ndarray:
    """A byte for each of 2 ** ORDER_BITS hash buckets: about log2 of how often its shingle recurs."""
    hot = recurring.groupBy("h").agg(F.sum("times").alias("times")).where(F.col("times") >= _HOT)
    # one row a bucket at most, so the driver gets 2 ** ORDER_BITS rows at the very most
    found = (
        hot.select(F.shiftrightunsigned("h", 64 - ORDER_BITS).cast("int").alias("b"), F.floor(F.log2("times")).cast("int").alias("level"))
        .groupBy("b")
        .agg(F.max("level").alias("level"))
        .toArrow()
    )
    table = np.zeros(1 << ORDER_BITS, dtype=np.uint8)
    table[found["b"].to_numpy()] = np.minimum(found["level"].to_numpy(), 60)
    return table


def _ordered(doc: np.ndarray, value: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, item, level): each text's shingles in the global order; an item sorts by level, then hash."""
    level = levels[value >> np.uint64(64 - ORDER_BITS)]
    item = (np.minimum(level, 15).astype(np.uint64) << np.uint64(60)) | (value >> np.uint64(4))
    order = np.lexsort((item, doc))
    return doc[order], item[order], level[order]


def _first_regions(docs: DataFrame, k: int, t: float, table) -> DataFrame:
    """(rid, salt, x, n, pos): each set in the regions of its first shingles, ``pos`` its place in its order.

    A set is known by its fingerprints, and a task gives it once for each ``_FLUSH``, so copies
    are one member of a region. ``salt`` is 0 but for shingles that recur very often.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        gathered = 0
        for batch in batches:
            for part in chunks(batch, "text"):
                doc, value, n, x, _ = _sets(part, k)
                fresh = np.zeros(len(x), bool)
                for i in np.flatnonzero((n > 0) & part.column("uid").is_valid().to_numpy(zero_copy_only=False)):
                    if x[i] not in seen:
                        fresh[i] = True
                        seen.add(x[i])
                some = fresh[doc]
                doc, item, level = _ordered(doc[some], value[some], table.value)
                size = np.where(fresh, n, 0)
                edge = np.cumsum(np.append(0, size))
                pos = np.arange(len(doc)) - edge[doc]
                early = pos < (size - np.ceil(t * size - 1e-9).astype(np.int64) + 1)[doc]
                doc, item, level, pos = doc[early], item[early], level[early].astype(np.int64), pos[early]
                salt = np.where(level < SALT_LEVEL, 0, 1 + (x[doc] & ((np.int64(1) << np.maximum(level - SALT_LEVEL + 1, 0)) - 1)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(item.view(np.int64)), pa.array(salt, pa.int64()), pa.array(x[doc]), pa.array(size[doc], pa.int32()), pa.array(pos, pa.int32())], names=["rid", "salt", "x", "n", "pos"]
                )
                gathered += int(n.sum())
                if gathered > _FLUSH:
                    seen.clear()
                    gathered = 0

    return docs.select("uid", "text").mapInArrow(place, "rid long, salt long, x long, n int, pos int")


def _whole_sets(docs: DataFrame, k: int, table) -> DataFrame:
    """(x, items): each row's whole set in the global order."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                doc, value, n, x, _ = _sets(part, k)
                _, item, _ = _ordered(doc, value, table.value)
                edge = np.cumsum(np.append(0, n))
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(item.view(np.int64)))], names=["x", "items"])

    return docs.select("uid", "text").mapInArrow(read, "x long, items array<long>")


def _small(side: DataFrame) -> DataFrame:
    return F.broadcast(side) if side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else side


def _shared(rows: DataFrame, t: float) -> DataFrame:
    """``rows`` (rid, salt, x, n, pos), once each, of regions of more than one class, with ``c``, the region's classes.

    Regions of two classes, most of them shared by chance, must also pass :func:`_possible`.
    """
    # a window and not a join back, so that texts are read and rows are dealt once
    here = W.partitionBy("rid", "salt")
    held = {"x0": F.min("x"), "x1": F.max("x"), "rows": F.count(F.lit(1)), "ns": F.sum("n"), "ps": F.sum("pos")}
    ends = rows.withColumns({k: v.over(here) for k, v in held.items()}).where("salt > 0 or x0 <> x1")
    other = (F.col("ns") - F.col("n")).cast("int"), (F.col("ps") - F.col("pos")).cast("int")
    ends = ends.where((F.col("salt") > 0) | (F.col("rows") > 2) | _possible(F.col("n"), F.col("pos"), *other, 1, t))
    kept = compact(ends.select("rid", "salt", "x", "n", "pos").dropDuplicates(["rid", "salt", "x"]).withColumn("c", F.count(F.lit(1)).over(here)))
    plain = kept.where("salt = 0").drop("salt")
    salted = kept.where("salt > 0")
    if salted.isEmpty():
        return plain
    frequent = salted.groupBy("rid").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.count(F.lit(1)).alias("c")).where("x0 <> x1").select("rid", "c")
    return compact(plain.unionByName(salted.drop("salt", "c").join(frequent, "rid")))


def _sets_of(source: DataFrame, rows: DataFrame, wanted: DataFrame, k: int, table) -> DataFrame:
    """(x, items) of wanted nodes, each read from the text of its least id."""
    wanted = compact(wanted)
    ids = compact(rows.where("uid is not null").join(wanted, "x", "left_semi").groupBy("x").agg(F.min("uid").alias("uid")).select("uid").distinct())
    # rows that share an id may have other sets: those not wanted go
    found = compact(_whole_sets(source.join(_small(ids), "uid", "left_semi"), k, table).join(_small(wanted), "x", "left_semi"))
    return compact(found.dropDuplicates(["x"])) if found.count() > wanted.count() else found


def _needed(na: Column, nb: Column, t: float) -> Column:
    """Shingles that two sets of these sizes share at least if they are linked."""
    return F.ceil((na + nb) * F.lit(t / (1 + t)) - 1e-9)


def _possible(na: Column, pa_: Column, nb: Column, pb: Column, level: int, t: float) -> Column:
    """Whether sets of these sizes that share ``level`` shingles, the last at these places, may be linked."""
    return (F.least(na, nb) >= F.greatest(na, nb) * F.lit(t) - 1e-9) & (F.least(na - pa_, nb - pb) - 1 + level >= _needed(na, nb, t))


def _candidates(rows: DataFrame, level: int, t: float, eps: float | None = None) -> DataFrame:
    """(a, b) of members of a region whose sizes and places let them be linked.

    ``level`` shingles are known to be shared, the last one at ``pos``; behind it the two
    have no more in common than either has left. With ``eps`` also the triangle inequality
    for each pivot (``d``), and only pairs not yet connected (``comp``).
    """
    extra = ["comp", "d"] if eps is not None else []
    one = rows.select("rid", *[F.col(c).alias(f"{c}1") for c in ("x", "n", "pos", *extra)])
    two = rows.select("rid", *[F.col(c).alias(f"{c}2") for c in ("x", "n", "pos", *extra)])
    met = one.join(two, "rid").where("x1 < x2").where(_possible(F.col("n1"), F.col("pos1"), F.col("n2"), F.col("pos2"), level, t))
    if eps is not None:
        met = met.where("comp1 <> comp2").where(F.forall(F.zip_with("d1", "d2", lambda p, q: F.abs(p - q)), lambda g: g <= eps + 1e-9))
    return met.select(F.col("x1").alias("a"), F.col("x2").alias("b"))


def _alike(pairs: DataFrame, signatures: DataFrame, t: float) -> DataFrame:
    """``pairs`` whose signatures don't differ in more bits than linked sets could in shingles."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("x")).distinct()
    known = compact(signatures.join(_small(ends), "x", "left_semi").dropDuplicates(["x"]))
    one, two = (known.select(F.col("x").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"s{c}")) for c in ("a", "b"))
    differ = F.aggregate(F.zip_with("sa", "sb", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, n: total + n)
    # signatures of unlike lengths, of sizes on both sides of a bound, tell nothing
    bits = F.when(F.size("sa") == F.size("sb"), differ).otherwise(0)
    met = pairs.join(one, "a").join(two, "b")
    return met.where(bits <= F.col("na") + F.col("nb") - 2 * _needed(F.col("na"), F.col("nb"), t)).select("a", "b")


def _pivots(large: DataFrame, level: int) -> DataFrame:
    """(rid, i, p): up to PIVOTS documents of each region, the least by so many hashes."""
    least = [F.min_by("x", F.xxhash64("x", F.lit(level * PIVOTS + i))).alias(f"p{i}") for i in range(PIVOTS)]
    return large.groupBy("rid").agg(*least).select("rid", F.posexplode(F.array_distinct(F.array(*[f"p{i}" for i in range(PIVOTS)]))).alias("i", "p"))


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, inter, na, nb) of distinct pairs, which are written already. Only sets that they name are shuffled."""

    def of(side: str) -> DataFrame:
        return sets.select(F.col("x").alias(side), F.col("items").alias(f"i{side}"))

    named = _small(pairs.select("b").distinct())
    # while pairs are few they are sent to the first side's sets, which then stay where they are
    return of("a").join(_small(pairs), "a").join(of("b").join(named, "b", "left_semi"), "b").select(
        "a", "b", F.size(F.array_intersect("ia", "ib")).cast("long").alias("inter"), F.size("ia").cast("long").alias("na"), F.size("ib").cast("long").alias("nb")
    )


def _to_pivots(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """:func:`_measured` of (x, p) with few distinct p: their sets are broadcast if they are small together, so a popular pivot is no hot key."""
    ends = pairs.select("x", "p", F.least("x", "p").alias("a"), F.greatest("x", "p").alias("b"))
    named = pairs.select(F.col("p").alias("x")).distinct()
    if not named.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return _measured(ends.select("a", "b").distinct(), sets)
    held = compact(sets.join(F.broadcast(named), "x", "left_semi"))
    if (held.agg(F.sum(F.size("items"))).first()[0] or 0) > BROADCAST_ITEMS:
        return _measured(compact(ends.select("a", "b").distinct()), sets)
    members = sets.select("x", F.col("items").alias("ix"))
    pivot = F.broadcast(held.select(F.col("x").alias("p"), F.col("items").alias("ip")))
    met = members.join(_small(compact(ends.dropDuplicates(["a", "b"]))), "x").join(pivot, "p")
    size = lambda end, other: F.when(F.col("x") == F.col(end), F.size("ix")).otherwise(F.size("ip")).cast("long").alias(other)
    return met.select("a", "b", F.size(F.array_intersect("ix", "ip")).cast("long").alias("inter"), size("a", "na"), size("b", "nb"))


def _distances(large: DataFrame, pivots: DataFrame, found: DataFrame, labels: DataFrame) -> DataFrame:
    """``large`` with ``d``, each member's distances to its region's pivots, and ``comp``, its component so far."""
    gap = found.select("a", "b", (1 - F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter"))).alias("gap"))
    met = large.join(pivots, "rid").select("rid", "x", "n", "pos", "i", F.least("x", "p").alias("a"), F.greatest("x", "p").alias("b"))
    told = met.join(gap, ["a", "b"], "left").groupBy("rid", "x", "n", "pos").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("gap", F.lit(0.0)).alias("gap")))).alias("told"))
    return _labelled(told.select("rid", "x", "n", "pos", F.col("told.gap").alias("d")), labels)


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels.select(F.col("id").alias("x"), "component"), "x", "left").withColumn("comp", F.coalesce("component", "x")).drop("component")


def _mixed(placed: DataFrame) -> DataFrame:
    """Members of regions of more than one component."""
    mixed = placed.groupBy("rid").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1")
    return placed.join(mixed.select("rid"), "rid", "left_semi")


def _mean(d: str) -> Column:
    return F.aggregate(d, F.lit(0.0), lambda s, v: s + v) / F.size(d)


def _to_hubs(placed: DataFrame, turn: int) -> DataFrame:
    """(x, p): members with the hubs of their region, if not yet connected with these.

    The hubs are the member with the least mean distance to the pivots and, of those outside
    its component, up to OUTSIDE by hash.
    """
    first = compact(placed.groupBy("rid").agg(F.min_by(F.struct("x", "comp"), F.struct(_mean("d"), "x")).alias("hub")))
    outside = placed.join(first, "rid").where(F.col("comp") != F.col("hub.comp")).drop("hub")
    least = [F.min_by(F.struct("x", "comp"), F.xxhash64("x", F.lit(-1 - turn * OUTSIDE - i))).alias(f"p{i}") for i in range(OUTSIDE)]
    second = outside.groupBy("rid").agg(*least).select("rid", F.explode(F.array_distinct(F.array(*[f"p{i}" for i in range(OUTSIDE)]))).alias("hub"))
    met = placed.join(first.unionByName(second), "rid").where(F.col("comp") != F.col("hub.comp"))
    return met.select("x", F.col("hub.x").alias("p")).distinct()


def _cells(eps: float) -> Column:
    """The cells of a member: its nearest pivot and those in its window."""
    return F.filter(F.sequence(F.lit(0), F.size("d") - 1), lambda i: F.get("d", i) <= F.array_min("d") + 2 * eps + 1e-9)


def _behind(level: int, t: float) -> Column:
    """How many shingles behind the last shared one a linked set could share next."""
    last = F.least(F.col("n") - F.ceil(F.col("n") * F.lit(t) - 1e-9) + level, F.col("n") - 1)
    return F.greatest(last - F.col("pos"), F.lit(0)).cast("int")


def _children(placed: DataFrame, sets: DataFrame, level: int, t: float, eps: float) -> DataFrame:
    """(parent, rid, x, n, pos): members by cell (nearest pivot and window) and by the next shingle."""
    after = F.slice("items", F.col("pos") + 2, _behind(level, t))
    spread = placed.join(sets, "x").select("rid", "x", "n", "pos", _cells(eps).alias("cells"), F.posexplode(after).alias("j", "item"))
    return spread.select("rid", "x", "n", "pos", "j", "item", F.explode("cells").alias("cell")).select(
        F.col("rid").alias("parent"), F.xxhash64("rid", "cell", "item").alias("rid"), "x", "n", (F.col("pos") + 1 + F.col("j")).cast("int").alias("pos")
    )


def _enough(large: DataFrame, level: int, t: float) -> DataFrame:
    """(a, b): members that share all the shingles that they need already, each with its region's least set.

    Behind these they may have none in common, so no further cut would find them.
    """
    least = large.groupBy("rid").agg(F.min(F.struct("n", "x")).alias("least"))
    met = large.join(least, "rid").where(F.col("x") != F.col("least.x")).where(_needed(F.col("n"), F.col("least.n"), t) <= level)
    return met.select(F.least("x", "least.x").alias("a"), F.greatest("x", "least.x").alias("b"))


def jaccard_components(
    docs: DataFrame,
    k: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    leaf: int = LEAF,
) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of every row of ``docs``.

    Links join sets with ``100 * intersection >= percent * union``. ``class_id`` is the least
    id with an equal set, ``component_id`` the least id reachable by links. Null, empty or
    wordless texts have an empty set and link with nothing (both ids are their own). Rows
    that share an id are linked by it; a null id is carried with null ids of class and
    component if its set is empty, and else it takes those of its class. An empty table
    gives an empty result, other columns are ignored, whatever their names, and a very long
    text is scanned in pieces: its distinct shingles must fit in a task's memory.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    t, eps = percent / 100, 1 - percent / 100
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("uid"), F.col(text_col).cast("string").alias("text"))
    survey = compact(_survey(source, k))
    table = spark.sparkContext.broadcast(_levels(survey.where("h is not null").select("h", "times")))
    rows = survey.where("h is null").select("uid", "n", "x", "f")
    filled = rows.where("n > 0 and uid is not null")
    classes = filled.groupBy("x", "f").agg(F.min("uid").alias("class_id"))
    same_id = filled.join(classes, ["x", "f"]).where("uid <> class_id").select(F.col("uid").alias("a"), F.col("class_id").alias("b")).distinct()

    signatures = survey.where("h is null and n > 0").select("x", "n", "sig")
    sized = _shared(_first_regions(source, k, t, table), t)
    links: DataFrame | None = None
    sets: DataFrame | None = None
    level = 1
    linked = F.col("inter") * 100 >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("inter"))
    while True:
        large = sized.where(F.col("c") > leaf).drop("c")
        pairs = compact(_alike(_candidates(sized.where(F.col("c") <= leaf), level, t).distinct(), signatures, t))
        todo = large.limit(1).count() > 0
        if todo:
            pivots = compact(_pivots(large, level))
            to = compact(large.join(pivots, "rid").where("x <> p").select("x", "p").distinct())
        if sets is None:
            # all that later levels need: they only cut these regions again
            wanted = pairs.select(F.explode(F.array("a", "b")).alias("x")).unionByName(large.select("x")).distinct()
            sets = _sets_of(source, rows, wanted, k, table)
        found = _measured(pairs, sets)
        found = compact(found.unionByName(_to_pivots(to, sets)) if todo else found)
        near = found.where(linked).select("a", "b")
        links = near if links is None else links.unionByName(near)
        if not todo:
            break
        links = compact(links.unionByName(_enough(large, level, t)).distinct())
        placed = compact(_mixed(_distances(large, pivots, found, neighbour_labels(links))))
        for turn in range(HUBS):
            # copies of one text are nearer to it than to each other: whoever is nearest to the pivots may link them
            more = _to_hubs(placed, turn)
            more = compact(more.join(found.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("p")), F.struct(F.col("b").alias("x"), F.col("a").alias("p")))).alias("q")).select("q.*"), ["x", "p"], "left_anti"))
            if more.isEmpty():
                break
            told = compact(_to_pivots(more, sets))
            found = found.unionByName(told)
            links = compact(links.unionByName(told.where(linked).select("a", "b")))
            placed = compact(_mixed(_labelled(placed.drop("comp"), connected_components(links))))
        # sets that are much alike share most shingles, so cutting them again would only repeat them;
        # nor is a region cut where that makes more rows than it has pairs
        spread = placed.groupBy("rid").agg(F.avg(_mean("d")).alias("mean"), F.count(F.lit(1)).cast("double").alias("c"), F.sum((F.size(_cells(eps)) * _behind(level, t)).cast("double")).alias("made"))
        spread = compact(spread.withColumn("tried", F.expr("mean >= 0.5 and made * 2 <= c * (c - 1)")))
        children = compact(_children(placed.join(spread.where("tried"), "rid", "left_semi"), sets, level, t, eps))
        sizes = compact(children.groupBy("parent", "rid").agg(F.count(F.lit(1)).alias("c")))
        cost = sizes.groupBy("parent").agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("cost"))
        cuts = compact(spread.join(cost.withColumnRenamed("parent", "rid"), "rid", "left").select("rid", (F.col("tried") & (F.coalesce("cost", F.lit(0.0)) * 2 <= F.col("c") * F.col("c"))).alias("cuts")))
        rest = compact(_alike(_candidates(placed.join(cuts.where("not cuts"), "rid", "left_semi"), level, t, eps).distinct(), signatures, t).join(found, ["a", "b"], "left_anti"))
        links = compact(links.unionByName(_measured(rest, sets).where(linked).select("a", "b")))
        again = sizes.where("c > 1").join(cuts.where("cuts").select(F.col("rid").alias("parent")), "parent", "left_semi").select("rid", "c")
        sized = compact(children.join(again, "rid").select("rid", "x", "n", "pos", "c"))
        level += 1
    links = compact(links)
    # from nodes to ids: a node stands for its class's least id
    ids = compact(classes.select("x", F.col("class_id").alias("uid")).join(links.select(F.explode(F.array("a", "b")).alias("x")).distinct(), "x", "left_semi"))
    by_id = links.join(ids.select(F.col("x").alias("a"), F.col("uid").alias("ua")), "a").join(ids.select(F.col("x").alias("b"), F.col("uid").alias("ub")), "b").select(F.col("ua").alias("a"), F.col("ub").alias("b"))
    component = connected_components(by_id.unionByName(same_id))
    return (
        rows.join(classes, ["x", "f"], "left")
        .select(F.col("uid").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("class_id", "uid")).otherwise(F.col("uid")).alias("class_id"))
        .join(component.withColumnRenamed("id", "class_id"), "class_id", "left")
        .select("doc_id", "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    )
