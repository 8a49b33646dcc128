"""Embedding near-duplicates: hashed cells in several tables, blocked cosine products, one kept per component.

Equal vectors are one class. A class stands in one cell of each of several tables: the
cross-polytope hash of its unit vector, or of its difference from the mean, under random
rotations of the table's own. Two classes are compared in the cells that they share and a
link counts in the first table where they share one, so exactly once. The rotations are
independent, so whatever the direction in which two vectors differ, each table is a new
chance to meet, and vectors nearer than the threshold meet more often.

How many tables and cells there are follows from a bounded sample: its vectors are moved by
random steps of the threshold's angle, and as many tables are taken as bring together all
but the share of them that a normal value exceeds by ``margin_sd`` standard deviations
(3.5: one in 4300). Among the numbers of cells that get there the cheapest is chosen by the
sizes that the sample's cells have; one cell, and so every pair, is always among them. Links
that no table brings together are missed; ``margin_sd=None`` compares every pair.

Tables are dealt in passes that hold ``PASS_BYTES``, or one table, at a time, so shuffles
don't grow with their number. Cells are cut into blocks of at most ``block_rows`` by hash
and each pair of blocks is a group of its own; it returns counts and a spanning forest of
its links, never the pairs. Products are in single precision, and what their error leaves
open at the threshold is decided in double precision.

A vector that is null, empty, zero or holds null or non-finite components links with
nothing, as does one without id. Vectors of unlike lengths are never compared; each length
but the sample's most frequent has one cell. Other columns are ignored; an empty table gives
an empty result. Rows with one id count as separate vectors with one component.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.graph import connected_components, cut

#: Vectors of the sample (taken by hash of the id) and their numbers in all, which the driver holds.
SAMPLE, SAMPLE_NUMBERS = 16384, 1 << 21
#: Rows of a cell aimed at, tables at most, and rows that one more table costs a vector as much as comparing.
ROWS_PER_CELL, TABLES, TABLE_ROWS = 256, 32, 4096
BLOCK_ROWS, TILE = 4096, 1024
#: Tables are dealt together while their rows take no more; beyond it one by one.
PASS_BYTES = 1 << 28
#: Rows up to which a list is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000
#: Links missed at the threshold, as a normal value's tail beyond so many standard deviations; None is exact.
MARGIN_SD = 3.5


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows of any finite size at unit length, in single precision."""
    v = v.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def _directions(dim: int, cells: int, tables: int, seed: int = 7) -> np.ndarray:
    """(tables, hashes, m, dim): for each hash m orthonormal directions, so that (2 m) ** hashes is about ``cells``."""
    hashes = 1
    while cells ** (1 / hashes) > 2 * dim:
        hashes += 1
    m = max(1, round(cells ** (1 / hashes) / 2))
    rng = np.random.default_rng(seed)
    turns = np.linalg.qr(rng.normal(size=(tables * hashes, dim, dim if 2 * m > dim else m)))[0]
    return np.swapaxes(turns[:, :, :m], 1, 2).reshape(tables, hashes, m, dim).astype(np.float32)


def _codes(unit: np.ndarray, shift: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """(rows, tables): the cell of each row in each table, by the nearest of each hash's directions and their opposites."""
    tables, hashes, m, dim = directions.shape
    out = np.zeros((len(unit), tables), np.int32)
    flat = directions.reshape(-1, dim).T
    for at in range(0, len(unit), 2048):
        some = unit[at : at + 2048] - shift
        along = (some @ flat).reshape(len(some), tables, hashes, m)
        best = np.abs(along).argmax(axis=3)
        digit = 2 * best + (np.take_along_axis(along, best[..., None], axis=3)[..., 0] < 0)
        out[at : at + 2048] = digit @ (2 * m) ** np.arange(hashes)
    return out


def fit_tables(unit: np.ndarray, total: int, threshold: float, margin_sd: float | None, cells: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(shift, directions) for ``total`` vectors like the sample ``unit``, the cheapest that miss no more than ``margin_sd`` allows.

    ``cells`` is the number to take if TABLES tables of so many are enough, else fewer.
    """
    dim, none = unit.shape[1], np.zeros(unit.shape[1], np.float32)
    whole = none, np.zeros((1, 0, 1, dim), np.float32)
    if margin_sd is None or len(unit) < 2 or dim < 2:
        return whole
    rng = np.random.default_rng(11)
    base = np.repeat(unit[:2048], -(-4096 // min(len(unit), 2048)), axis=0)[:4096].astype(np.float64)
    step = rng.normal(size=base.shape)
    step -= (step * base).sum(axis=1, keepdims=True) * base
    step /= np.linalg.norm(step, axis=1, keepdims=True)
    moved = (threshold * base + math.sqrt(max(0.0, 1 - threshold**2)) * step).astype(np.float32)
    missed = 0.5 * math.erfc(margin_sd / math.sqrt(2))
    least, chosen = (math.inf if cells else TABLE_ROWS + total), whole
    wanted = cells or total // ROWS_PER_CELL
    while wanted > 1:
        for shift in (none, unit.mean(axis=0)):
            directions = _directions(dim, wanted, TABLES)
            met = np.logical_or.accumulate(_codes(base.astype(np.float32), shift, directions) == _codes(moved, shift, directions), axis=1)
            enough = np.flatnonzero((~met).mean(axis=0) <= missed)
            if len(enough):
                some = unit[:8192]
                sizes = [np.unique(c, return_counts=True)[1].astype(float) for c in _codes(some, shift, directions[: min(4, enough[0] + 1)]).T]
                alike = np.mean([(n * (n - 1)).sum() for n in sizes]) / (len(some) * (len(some) - 1))
                cost = (enough[0] + 1) * (TABLE_ROWS + alike * total)
                if cost < least:
                    least, chosen = cost, (shift, directions[: enough[0] + 1])
        if cells and least < math.inf:
            break
        wanted //= 4
    return chosen


def _few(rows: DataFrame) -> DataFrame:
    """``rows``, which are written already, to be broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _forest(left: np.ndarray, right: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The least id of each row's component under the links between rows ``left`` and ``right``."""
    top = ids.copy()
    while True:
        low = np.minimum(top[left], top[right])
        if (low == top[left]).all() and (low == top[right]).all():
            return top
        np.minimum.at(top, left, low)
        np.minimum.at(top, right, low)


class _Cells:
    """Links inside rows that stand in order of their group: (table, code, i, j) and, within it, block."""

    def __init__(self, rows: pa.Table, dtype: type, threshold: float):
        column = lambda c: rows.column(c).to_numpy()
        self.x, self.copies, self.t, self.b, self.threshold = column("x"), column("copies"), column("t"), column("b"), threshold
        self.codes = rows.column("codes").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
        self.across = column("i") != column("j")
        data = rows.column("data").combine_chunks()
        self.raw, self.start = np.frombuffer(data.buffers()[2], dtype=np.uint8), np.frombuffer(data.buffers()[1], dtype=np.int32)[data.offset : data.offset + rows.num_rows + 1]
        self.dtype = dtype

    def vectors(self, lo: int, hi: int) -> np.ndarray:
        return self.raw[self.start[lo] : self.start[hi]].view(self.dtype).reshape(hi - lo, -1)

    def links(self, a: tuple[int, int], b: tuple[int, int], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Linked rows of two spans, which are one or apart, if of one group and not of one cell in an earlier table."""
        va, vb = self.vectors(*a), self.vectors(*b)
        one, two = _unit(va), _unit(vb)
        near = one @ two.T
        # single precision is off by less than this, rounded vectors included
        off = (va.shape[1] + 16) * 2.0**-23
        left, right = np.nonzero(near >= self.threshold - off)
        keep = group[left + a[0]] == group[right + b[0]]
        if a == b:
            keep &= left < right
        left, right = left[keep], right[keep]
        at, to = left + a[0], right + b[0]
        fresh = np.ones(len(at), bool)
        for k in range(int(self.t[at].max(initial=0))):
            fresh &= (self.codes[at, k] != self.codes[to, k]) | (self.t[at] <= k)
        left, right = left[fresh], right[fresh]
        open_ = np.flatnonzero(near[left, right] < self.threshold + off)
        if len(open_):
            p, q = va[left[open_]].astype(np.float64), vb[right[open_]].astype(np.float64)
            p, q = p / np.abs(p).max(axis=1, keepdims=True), q / np.abs(q).max(axis=1, keepdims=True)
            true = np.ones(len(left), bool)
            true[open_] = (p * q).sum(axis=1) / (np.linalg.norm(p, axis=1) * np.linalg.norm(q, axis=1)) >= self.threshold
            left, right = left[true], right[true]
        return left + a[0], right + b[0]

    def told(self, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
        """(x, y, linked): of each row with links its component's least id here, and how many vectors it links with."""
        rows, place = np.unique(np.concatenate([left, right]), return_inverse=True)
        p, q = place[: len(left)], place[len(left) :]
        n = np.bincount(p, self.copies[right], len(rows)) + np.bincount(q, self.copies[left], len(rows))
        return pa.RecordBatch.from_arrays([pa.array(self.x[rows]), pa.array(_forest(p, q, self.x[rows])), pa.array(n.astype(np.int64))], names=["x", "y", "linked"])

    def spans(self, edge: np.ndarray) -> Iterator[tuple[tuple[int, int], tuple[int, int]]]:
        """Pairs of spans to compare, of at most TILE rows each; ``edge`` has the groups' ends. Small groups are taken together."""
        size, at = np.diff(self.start), 0
        while at < len(edge) - 1:
            lo, to = edge[at], at + 1
            while to < len(edge) - 1 and edge[to + 1] - lo <= TILE and not self.across[lo] and not self.across[edge[to]] and size[edge[to]] == size[lo]:
                to += 1
            hi, at = edge[to], to
            cuts = [(int(k), int(min(k + TILE, hi))) for k in range(lo, hi, TILE)]
            if self.across[lo]:
                middle = int(lo + np.searchsorted(self.b[lo:hi], self.b[lo], side="right"))
                one = [(k, min(k + TILE, middle)) for k in range(int(lo), middle, TILE)]
                yield from ((p, (k, min(k + TILE, int(hi)))) for p in one for k in range(middle, int(hi), TILE))
            else:
                yield from ((p, q) for i, p in enumerate(cuts) for q in cuts[i:])


def embedding_components(
    vectors: DataFrame,
    threshold: float = 0.95,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    cells: int | None = None,
    margin_sd: float | None = MARGIN_SD,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors``."""
    spark = vectors.sparkSession
    # single precision stays as it is, at half the bytes
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    kind, dtype = ("array<float>", np.float32) if single else ("array<double>", np.float64)
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("v"))
    sound = (
        F.col("vec_id").isNotNull()
        & F.coalesce(F.size("v") > 0, F.lit(False))
        & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
        & F.exists("v", lambda c: c != 0)
    )
    rows = source.withColumn("ok", F.coalesce(sound, F.lit(False)))
    keyed = rows.withColumns({"h1": F.when(F.col("ok"), F.xxhash64("v")), "h2": F.when(F.col("ok"), F.xxhash64(F.lit(1), "v"))})

    total, widest = source.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    share = min(1.0, min(SAMPLE, SAMPLE_NUMBERS / max(1, widest or 0)) / max(1, total))
    # chosen by hash, so a rerun fits the same tables
    drawn = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) <= int(share * (1 << 30))).where("ok").dropDuplicates(["v"]).select("vec_id", F.xxhash64("v").alias("h"), "v")
    lists = drawn.toArrow().sort_by([("vec_id", "ascending"), ("h", "ascending")]).column("v").combine_chunks()
    wide = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    dim = int(np.bincount(wide).argmax()) if len(wide) else 0
    taken = lists.filter(pa.array(wide == dim)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) if dim else np.zeros((0, 1))
    fitted = spark.sparkContext.broadcast(fit_tables(_unit(taken) if len(taken) else taken, total, threshold, margin_sd, cells))
    tables = len(fitted.value[1])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift, directions = fitted.value
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("v"))
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            flat, edge = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.append(0, sizes)).astype(np.int64)
            codes = np.repeat(-sizes.astype(np.int32)[:, None], tables, axis=1)
            even = np.flatnonzero(sizes == dim)
            if len(even):
                codes[even] = _codes(_unit(flat[edge[even][:, None] + np.arange(dim)]), shift, directions)
            data = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((edge * flat.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * tables, pa.int32()), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), listed, data], names=["h1", "h2", "cid", "copies", "codes", "data"])

    grouped = keyed.where("ok").groupBy("h1", "h2").agg(F.min("vec_id").alias("cid"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    coded = grouped.mapInArrow(place, "h1 long, h2 long, cid long, copies long, codes array<int>, data binary")
    # a class is known by its hashes' fold, as rows with unlike vectors may share an id
    classes = cut(coded.withColumn("x", F.xxhash64("h1", "h2")))

    def stands(first: int, count: int) -> DataFrame:
        """A row for each class and table; a length of its own has one table."""
        dealt = classes.select("x", "copies", "codes", "data", F.posexplode(F.slice("codes", first + 1, count)).alias("t", "code"))
        return dealt.withColumn("t", F.col("t") + first).where("t = 0 or code >= 0")

    # a row a large cell: as many as tables times blocks at most
    large = cut(stands(0, tables).groupBy("t", "code").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks")).where("blocks > 1"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def links(part: pa.Table) -> Iterator[pa.RecordBatch]:
            group = ends(part)
            edge = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group))
            here = _Cells(part, dtype, threshold)
            for one, two in here.spans(edge):
                left, right = here.links(one, two, group)
                if len(left):
                    yield here.told(left, right)

        def ends(part: pa.Table) -> np.ndarray:
            keys = np.stack([part.column(c).to_numpy() for c in ("t", "code", "i", "j")])
            return np.cumsum(np.append(0, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))

        for batch in batches:
            held = pa.concat_tables([held, pa.Table.from_batches([batch])]) if held else pa.Table.from_batches([batch])
            if held.num_rows < TILE:
                continue
            group = ends(held)
            whole = int(np.searchsorted(group, group[-1]))
            if whole:
                yield from links(held.slice(0, whole).combine_chunks())
                held = held.slice(whole).combine_chunks()
        if held:
            yield from links(held.combine_chunks())

    some = large.limit(1).count() > 0
    each = max(1, total) * (dim * np.dtype(dtype).itemsize + 4 * tables + 64)
    count = int(min(tables, max(1, PASS_BYTES // each)))
    found: DataFrame | None = None
    for first in range(0, tables, count):
        dealt = stands(first, count)
        dealt = dealt.join(F.broadcast(large), ["t", "code"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))) if some else dealt.withColumn("blocks", F.lit(1))
        dealt = dealt.withColumn("b", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int"))
        if some:
            dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("b", "o"), "j": F.greatest("b", "o")})
        else:
            dealt = dealt.withColumns({"i": F.lit(0), "j": F.lit(0)})
        dealt = dealt.select("t", "code", "i", "j", "b", "x", "copies", "codes", "data").repartition("t", "code", "i", "j").sortWithinPartitions("t", "code", "i", "j", "b")
        here = cut(dealt.mapInArrow(compare, "x long, y long, linked long"))
        found = here if found is None else found.unionByName(here)
        # this pass's shuffle goes before the next is written
        del dealt, here
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    # mostly few: only classes that something links are dealt again, any other vector is its own component
    direct = _few(cut(found.groupBy("x").agg(F.sum("linked").alias("linked"))))
    known = _few(cut(classes.select("x", "cid").join(direct.select("x"), "x")))
    edges = found.where("x <> y").join(known.select("x", F.col("cid").alias("a")), "x").join(known.select(F.col("x").alias("y"), F.col("cid").alias("b")), "y").select("a", "b")
    # vectors that share an id hold together by it
    repeated = _few(cut(classes.where("copies > 1").select("h1", "h2", "cid")))
    shared = keyed.where("ok").select("vec_id", "h1", "h2").join(repeated, ["h1", "h2"]).where("vec_id <> cid").select(F.col("vec_id").alias("a"), F.col("cid").alias("b")).distinct()
    component = _few(cut(connected_components(edges.unionByName(shared)).withColumnRenamed("id", "cid")))
    told = classes.select("h1", "h2", "cid", "copies", "x").join(direct, "x", "left").join(component, "cid", "left").where("copies > 1 or linked is not null or component is not null")
    told = cut(told.select("h1", "h2", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n"), F.coalesce("component", "cid").alias("c")))
    return (
        keyed.join(_few(told), ["h1", "h2"], "left")
        .select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
