"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Lines are normalised (lower case, digits to 0, tabs and carriage returns to blanks,
trimmed); blank ones always stay. A line is removed if an earlier one, by (doc_id, line
number) over the whole table, is equal to it, or is within as many edits as the shorter of
the two allows: one for every ``per_edit`` characters, ``threshold`` at most.

Equal lines are one class. A line of length l that allows k edits is cut into ``k + 1`` even
segments; two lines within k share one of the shorter one's segments, at a shift that the
lengths bound. So each line is indexed by its segments and probes those of every shorter
length in reach. Candidates are verified by a banded bit-parallel edit distance: bit d of
register e says whether diagonal d is reached with e edits.

A segment that more than ``hot`` lines share is not joined as it stands. All its lines are
compared with the earliest of them, which settles those that it is near to; the rest is cut
again, in the longer of the parts that the shared segment leaves open: these hold at most k
edits too, so the same partition and shifts apply. This goes on until a group is small or
nothing is left open, each step linear in the group.

Null texts stay null, empty ones empty, an empty table gives an empty result. Rows that are
equal in id and text are one document; other rows that share an id share their rank, and
equal lines at one place of them are one occurrence. A null id ranks last. Other columns
pass through, whatever their names; if one is called ``removed_lines`` the result's gets
underscores behind its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.llm.graph import cut, free_name

THRESHOLD, PER_EDIT, HOT, PIECES = 1, 20, 64, 8

#: White space that trimming takes and blanks replace.
_EDGE = " \t\r"
#: Rows up to which a side of 16 to 40 bytes a row is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def normalise(line: Column) -> Column:
    low = F.lower(F.btrim(line, F.lit(_EDGE)))
    # few lines have a character to replace, and looking for one is cheaper than replacing none
    digits = F.when(low.rlike("[1-9]"), F.regexp_replace(low, "[1-9]", "0")).otherwise(low)
    return F.when(low.rlike(r"[\t\r]"), F.translate(digits, "\t\r", "  ")).otherwise(digits)


def _few(side: DataFrame) -> bool:
    return side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def within_edits(a: Column, b: Column, k: int) -> Column:
    """Whether strings ``a`` and ``b`` are within ``k`` edits, over the 2k + 1 diagonals between them.

    Register e is a word of 2k + 1 bits; bit d + k stands for the cell of diagonal d (place
    in a less place in b). A step takes one character of b: matches keep a bit, and
    register e also takes what register e - 1 had (substitution), had one diagonal up
    (insertion) and has now one diagonal down (deletion).
    """
    full = (1 << (2 * k + 1)) - 1
    letters = F.split(a, "")
    start = F.struct(*[F.lit(sum(1 << (k + d) for d in range(e + 1)) & full).alias(f"r{e}") for e in range(k + 1)], F.lit(0).alias("j"))

    def step(acc: Column, c: Column) -> Column:
        match = F.lit(0)
        for d in range(-k, k + 1):
            # get is null at places before the first letter and past the last
            match = match + F.when(F.get(letters, acc["j"] + d) == c, F.lit(1 << (k + d))).otherwise(F.lit(0))
        rows: list[Column] = []
        for e in range(k + 1):
            row = acc[f"r{e}"].bitwiseAND(match)
            if e:
                old = acc[f"r{e - 1}"]
                row = row.bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(F.shiftleft(rows[-1], 1)).bitwiseAND(F.lit(full))
            rows.append(row)
        return F.struct(*[r.alias(f"r{e}") for e, r in enumerate(rows)], (acc["j"] + 1).alias("j"))

    gap = F.length(a) - F.length(b)
    last = F.aggregate(F.when(F.length(b) > 0, F.split(b, "")).otherwise(F.array().cast("array<string>")), start, step, lambda acc: acc[f"r{k}"])
    return F.when(F.abs(gap) > k, F.lit(False)).otherwise(_bit(last, gap + k, k))


def _bit(word: Column, place: Column, k: int) -> Column:
    value = F.lit(False)
    for d in range(2 * k + 1):
        value = F.when(place == d, word.bitwiseAND(F.lit(1 << d)) != 0).otherwise(value)
    return value


def _rank(id_col: str, pos: str) -> Column:
    """(doc_id, line) as one number, so that its minimum stays in hash aggregation."""
    return (F.coalesce(F.col(id_col).cast("decimal(20,0)"), F.lit("9223372036854775808").cast("decimal(20,0)")) * F.lit(1 << 31).cast("decimal(12,0)") + F.col(pos)).cast("decimal(38,0)")


def _allowed(length: Column, threshold: int, per_edit: int) -> Column:
    return F.least(F.lit(threshold), F.floor(length / per_edit).cast("int"))


def _cuts(length: Column, i: int, parts: int) -> Column:
    return F.floor(length * i / parts).cast("int")


def _layout(threshold: int) -> list[tuple[int, int, int, int]]:
    """(edits, characters less, segment, shift) of each of a line's keys, in order."""
    return [(k, less, i, shift) for k in range(1, threshold + 1) for less in range(k + 1) for i in range(k + 1) for shift in range(max(-i, less - (k - i)), min(i, less + (k - i)) + 1)]


def _keys(norm: Column, threshold: int, per_edit: int) -> list[Column]:
    """Index keys of a line's own segments and probe keys of shorter lengths', as ``_layout`` has them; null where that length allows other edits."""
    out = []
    for k, less, i, shift in _layout(threshold):
        short = F.length(norm) - less
        start = _cuts(short, i, k + 1)
        key = F.xxhash64(F.lit(i), short, norm.substr(start + shift + 1, _cuts(short, i + 1, k + 1) - start))
        out.append(F.when(_allowed(short, threshold, per_edit) == k, key))
    return out


def _met(early: DataFrame, late: DataFrame) -> DataFrame:
    """(a1, a2, b1, b2): pairs of a key, an earlier line a and a later, unsettled line b; at least one is indexed."""
    one = early.select("key", F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("rank").alias("ra"), F.col("probe").alias("pa"))
    two = late.where("open").select("key", F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("rank").alias("rb"), F.col("probe").alias("pb"))
    return one.join(two, "key").where("ra < rb and not (pa and pb)").select("a1", "a2", "b1", "b2")


def _grouped(rows: DataFrame) -> DataFrame:
    """``rows`` of keys that hold an indexed line and an unsettled one that isn't alone, with ``n``."""
    dealt = rows.repartition("key")
    sizes = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("probe").alias("probes"), F.max("open").alias("some"), F.min("rank").alias("r0"), F.max("rank").alias("r1"))
    return dealt.join(sizes.where("r0 <> r1 and not probes and some").select("key", "n"), "key")


def near_earlier(classes: DataFrame, texts, threshold: int, per_edit: int = PER_EDIT, hot: int = HOT) -> DataFrame:
    """(h1, h2) of lines that have an earlier one within their edits.

    ``classes`` has (h1, h2, rank, k0, k1, ...); ``texts(wanted)`` gives (h1, h2, norm) of wanted lines.
    """
    layout = _layout(threshold)
    told = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("i") + 1)
    keys = F.posexplode(F.array(*[F.col(f"k{j}") for j in range(len(layout))])).alias("i", "key")
    spread = classes.select("h1", "h2", "rank", keys).where("key is not null")
    placed = spread.select("key", told([less > 0 or shift != 0 for _, less, _, shift in layout]).alias("probe"), F.col("i").cast("tinyint").alias("i"), "h1", "h2", "rank", F.lit(True).alias("open"))
    shared = cut(_grouped(placed))
    lines = cut(texts(shared.select("h1", "h2").distinct()))

    def verified(pairs: DataFrame) -> DataFrame:
        return cut(_near(pairs.distinct(), lines, threshold, per_edit))

    found = verified(_met(*[shared.where(F.col("n") <= hot)] * 2))
    group = shared.where(F.col("n") > hot)
    if group.isEmpty():
        return found.distinct()
    # the part that the shared segment leaves open: its length on the shorter side, and what a probe's has more
    edits, less, seg, shift = (told([t[j] for t in layout]) for j in range(4))
    opened = group.join(lines, ["h1", "h2"]).withColumns({"k": edits, "less": less, "seg": seg, "shift": shift})
    short = F.length("norm") - F.col("less")
    opened = opened.withColumns({"from": F.floor(short * F.col("seg") / (F.col("k") + 1)).cast("int"), "to": F.floor(short * (F.col("seg") + 1) / (F.col("k") + 1)).cast("int"), "size": short})
    rows = _rest(opened.withColumns({"text": F.col("norm"), "more": F.col("less")}))
    while True:
        rows = cut(rows)
        # all against the earliest line, indexed or the first of those that probe
        first = rows.groupBy("key").agg(F.min_by(F.struct("h1", "h2", "rank", "probe"), F.col("rank")).alias("f"))
        heads = first.select("key", "f.h1", "f.h2", "f.rank", "f.probe")
        index = rows.where("not probe").groupBy("key").agg(F.min_by(F.struct("h1", "h2", "rank", "probe"), F.col("rank")).alias("f")).select("key", "f.h1", "f.h2", "f.rank", "f.probe")
        settled = verified(_met(heads.unionByName(index), rows))
        found = found.unionByName(settled)
        rows = rows.drop("open").join(settled.distinct().withColumn("settled", F.lit(True)), ["h1", "h2"], "left").withColumn("open", F.col("settled").isNull()).drop("settled")
        closed = F.col("size") <= F.col("k") + 1
        finer = cut(_grouped(_finer(rows.where(~closed), threshold)))
        found = found.unionByName(verified(_met(*[_grouped(rows.where(closed).select("key", "probe", "h1", "h2", "rank", "open"))] * 2).unionByName(_met(*[finer.where(F.col("n") <= hot)] * 2))))
        rows = _rest(finer.where(F.col("n") > hot))
        if finer.where(F.col("n") > hot).isEmpty():
            return found.distinct()


def _rest(rows: DataFrame) -> DataFrame:
    """(key, probe, k, size, more, text, ...): of a row's text the longer part before or after [from, to), as the shorter line has it."""
    left = F.col("from") >= F.col("size") - F.col("to")
    text = F.when(left, F.substring("text", F.lit(1), F.col("from") + F.col("shift"))).otherwise(F.substring("text", F.col("to") + F.col("shift") + 1, F.length("text")))
    return rows.select(
        "key", "probe", "k", "h1", "h2", "rank", "open",
        F.when(left, F.col("from")).otherwise(F.col("size") - F.col("to")).cast("int").alias("size"),
        F.when(left, F.col("shift")).otherwise(F.col("more") - F.col("shift")).alias("more"),
        text.alias("text"),
    )


def _finer(rows: DataFrame, threshold: int) -> DataFrame:
    """Rows by key and segment of the open part, with the segment's bounds on the shorter side and its shift."""
    choices = [F.struct(F.lit(k).alias("k"), F.lit(i).alias("seg"), F.lit(s).alias("shift")) for k in range(1, threshold + 1) for i in range(k + 1) for s in range(-k, k + 1)]
    fits = lambda c: (c["k"] == F.col("k")) & (c["shift"] >= F.greatest(-c["seg"], F.col("more") - (c["k"] - c["seg"]))) & (c["shift"] <= F.least(c["seg"], F.col("more") + (c["k"] - c["seg"])))
    cells = rows.withColumn("cell", F.explode(F.filter(F.array(*choices), fits))).withColumns({"seg": F.col("cell.seg"), "shift": F.col("cell.shift")}).drop("cell")
    cells = cells.withColumns({"from": F.floor(F.col("size") * F.col("seg") / (F.col("k") + 1)).cast("int"), "to": F.floor(F.col("size") * (F.col("seg") + 1) / (F.col("k") + 1)).cast("int")})
    piece = F.substring("text", F.col("from") + F.col("shift") + 1, F.col("to") - F.col("from"))
    return cells.withColumns({"key": F.xxhash64("key", "seg", piece), "probe": F.col("probe") | (F.col("shift") != 0)})


def _near(pairs: DataFrame, lines: DataFrame, threshold: int, per_edit: int) -> DataFrame:
    """(h1, h2) of the later lines of pairs that are within the shorter one's edits."""
    one = lines.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("norm").alias("na"))
    two = lines.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("norm").alias("nb"))
    met = pairs.join(one, ["a1", "a2"]).join(two, ["b1", "b2"]).withColumn("k", _allowed(F.least(F.length("na"), F.length("nb")), threshold, per_edit))
    checked = _trimmed(met.where(F.abs(F.length("na") - F.length("nb")) <= F.col("k")))
    near = F.lit(False)
    for k in range(1, threshold + 1):
        near = F.when(F.col("k") == k, within_edits(F.col("ta"), F.col("tb"), k)).otherwise(near)
    return checked.where(near).select(F.col("b1").alias("h1"), F.col("b2").alias("h2")).distinct()


def _trimmed(met: DataFrame) -> DataFrame:
    """Pairs with ``ta`` and ``tb``: their texts without the equal ones of PIECES even pieces at both ends.

    Equal ends don't change the distance. One edit leaves all pieces but one equal, those
    before it counted from the front and those after it from the back. Written before the
    distance is computed: one nested expression of both takes the planner minutes.
    """
    w = F.floor(F.least(F.length("na"), F.length("nb")) / PIECES).cast("int")
    sized = met.withColumn("w", w)
    ahead, behind = F.lit(PIECES), F.lit(PIECES)
    for i in reversed(range(PIECES)):
        ahead = F.when(F.col("na").substr(i * F.col("w") + 1, F.col("w")) != F.col("nb").substr(i * F.col("w") + 1, F.col("w")), i).otherwise(ahead)
        back = lambda c, i=i: F.col(c).substr(F.length(c) - (i + 1) * F.col("w") + 1, F.col("w"))
        behind = F.when(back("na") != back("nb"), i).otherwise(behind)
    told = sized.withColumns({"f": F.when(F.col("w") == 0, 0).otherwise(ahead), "g": F.when(F.col("w") == 0, 0).otherwise(behind)})
    kept = told.where(f"k > 1 or w = 0 or f + g >= {PIECES - 1}").withColumn("g", F.least("g", PIECES - F.col("f")))
    rest = lambda c: F.col(c).substr(F.col("f") * F.col("w") + 1, F.length(c) - (F.col("f") + F.col("g")) * F.col("w"))
    return cut(kept.select("b1", "b2", "k", rest("na").alias("ta"), rest("nb").alias("tb")))


def _without(text: Column, numbers: Column) -> Column:
    """``text`` without the lines of these sorted numbers, from 0.

    The numbers become a mask, a byte a line, which a line looks its own up in: all linear.
    Text and mask are bound once, as an expression inside a lambda is computed again for
    every line.
    """

    def upto(i: Column) -> Column:
        before = F.when(i == 0, F.lit(-1)).otherwise(F.get(numbers, i - 1))
        return F.concat(F.repeat(F.lit("-"), F.get(numbers, i) - before - 1), F.lit("x"))

    mask = F.array_join(F.transform(F.sequence(F.lit(0), F.size(numbers) - 1), upto), "").cast("binary")
    bound = F.array(F.struct(F.split(text, "\n").alias("l"), mask.alias("m")))
    kept = F.transform(bound, lambda s: F.array_join(F.filter(s["l"], lambda _, i: F.substr(s["m"], i + 1, F.lit(1)) != F.lit(b"x")), "\n"))
    return F.get(kept, F.lit(0))


def line_dedup(docs: DataFrame, threshold: int = THRESHOLD, per_edit: int = PER_EDIT, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with removed lines cut from the text, and ``removed_lines``, their numbers from 0."""
    text, out = F.col(text_col).cast("string"), free_name(docs, "removed_lines")
    row = F.xxhash64(F.col(id_col).cast("long"), text)
    source = docs.select(row.alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    normal = source.select("row", _rank("doc_id", "pos").alias("rank"), "pos", normalise(F.col("line")).alias("norm")).where("norm <> ''")
    keys = [key.alias(f"k{j}") for j, key in enumerate(_keys(F.col("norm"), threshold, per_edit))]
    lines = cut(normal.select("row", "pos", "rank", F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(1), "norm").alias("h2"), *keys))
    names = [f"k{j}" for j in range(len(keys))]
    classes = cut(lines.groupBy("h1", "h2").agg(F.min("rank").alias("rank"), F.max("rank").alias("last"), *[F.min(c).alias(c) for c in names]))

    def texts(wanted: DataFrame) -> DataFrame:
        # a line's text is read where it comes first, from the documents that hold such lines only
        places = cut(lines.join(classes.join(wanted, ["h1", "h2"], "left_semi").select("h1", "h2", "rank"), ["h1", "h2", "rank"], "left_semi").select("row", "pos", "h1", "h2"))
        by_row = places.groupBy("row").agg(F.collect_set(F.struct("pos", "h1", "h2")).alias("places"))
        held = docs.select(row.alias("row"), F.split(text, "\n").alias("parts")).join(F.broadcast(by_row) if _few(places) else by_row, "row")
        found = held.select("parts", F.explode("places").alias("p")).select(F.col("p.h1").alias("h1"), F.col("p.h2").alias("h2"), normalise(F.get("parts", F.col("p.pos"))).alias("norm"))
        return found.dropDuplicates(["h1", "h2"])

    verdict = classes.where("rank <> last").select("h1", "h2", F.col("rank").alias("keep"))
    if threshold:
        near = near_earlier(classes, texts, threshold, per_edit, hot).withColumn("near", F.lit(True))
        verdict = verdict.join(near, ["h1", "h2"], "full_outer").select("h1", "h2", F.when(F.col("near").isNull(), F.col("keep")).alias("keep"))
    verdict = cut(verdict)
    gone = lines.select("row", "pos", "rank", "h1", "h2").join(F.broadcast(verdict) if _few(verdict) else verdict, ["h1", "h2"]).where("keep is null or keep <> rank")
    mine, of, found = (free_name(docs, c) for c in ("__row", "__of", "__removed"))
    removed = gone.groupBy(F.col("row").alias(of)).agg(F.sort_array(F.collect_set("pos")).alias(found))
    joined = docs.withColumn(mine, row).join(removed, F.col(mine) == F.col(of), "left").drop(mine, of)
    kept = F.when(F.col(found).isNull(), F.col(text_col)).otherwise(_without(text, F.col(found)))
    return joined.withColumn(text_col, kept).withColumn(out, F.coalesce(found, F.array().cast("array<int>"))).drop(found)
