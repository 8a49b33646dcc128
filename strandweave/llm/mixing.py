"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

A document's size is its number of words. Sources in code-point order (null last) weigh
``WEIGHTS`` in turn and share ``share`` of all words; a target stops at ``max_repeats`` times
its source's size and the excess is dealt anew by weight until none is above.

Rates are the least-divergence ones that meet each source's target: minimising
``sum r log r - r`` under ``sum r size = target`` and ``r <= max_repeats`` gives
``r = min(max_repeats, exp(lambda size / mean size))`` with one multiplier a source, the
solution of a convex dual. Newton steps on all sources at once run over the histogram
(source, size, documents), which is all the dual needs; each is one grouped sum, bracketed by
bisection so that it always converges.

Rates become copies: a document takes the whole part of its rate, and the rest of its
source's target, in buckets of about ``BUCKET_ROWS`` documents by hash of the id and text,
goes as one more whole copy each to documents in order of hash over fractional rate; the
last one is cut to the words that are left. So a bucket meets its target to the word, no
document exceeds ``max_repeats`` times its size, and reruns agree. Nothing is collected but
three numbers a round.

Null and wordless texts have size 0 and take nothing. A source without words has target 0.
Null sources are one source. Null or repeated ids are separate documents. Rows equal in id,
text and source share one hash, so one bucket holds them; their order in it is arbitrary and
changes nothing, as any of them may take what another does. An empty table gives an empty
result; other columns are ignored, whatever their names; texts of any length are counted
whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandweave.llm.graph import cut

#: Fixed values of the production mix.
WEIGHTS, SHARE, MAX_REPEATS = (5, 2, 1), 1.0, 3
BUCKET_ROWS, NEWTON_ROUNDS, TOLERANCE = 512, 40, 1e-9
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, docs, target) from (source, source_size, docs): the capped shares.

    Dealing the excess anew until no target is above its limit ends at one price per weight:
    targets are ``least(limit, price * weight)``. Sources ordered by limit over weight reach
    their limits in that order, so the price follows from running sums over one row a source.
    """
    numbered = totals.withColumn("place", F.row_number().over(W.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    row = numbered.withColumns({"weight": weight, "limit": F.col("source_size") * F.lit(float(max_repeats))})
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_price = W.orderBy(F.col("limit") / F.col("weight"), "place")
    row = row.withColumns({"all": F.sum("source_size").over(every) * share, "weights": F.sum("weight").over(every)})
    before = by_price.rowsBetween(W.unboundedPreceding, -1)
    row = row.withColumns({"full": F.coalesce(F.sum("limit").over(before), F.lit(0.0)), "gone": F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
    # the price if this source and all later ones stay under their limits
    row = row.withColumn("price", (F.col("all") - F.col("full")) / (F.col("weights") - F.col("gone")))
    row = row.withColumn("nth", F.row_number().over(by_price))
    row = row.withColumn("first", F.min(F.when(F.col("price") * F.col("weight") <= F.col("limit"), F.col("nth"))).over(every))
    price = F.max(F.when(F.col("nth") == F.col("first"), F.col("price"))).over(every)
    row = row.withColumn("final", price)
    return row.select("source", "source_size", "docs", F.when(F.col("nth") < F.coalesce("first", F.lit(1 << 30)), F.col("limit")).otherwise(F.least(F.col("final") * F.col("weight"), "limit")).alias("target"))


def balance(histogram: DataFrame, targets: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, unit, lam): the dual's multiplier of each source with words and a target.

    ``histogram`` has (source, size, n). Rates are ``least(max_repeats, exp(lam * size / unit))``;
    a target at its limit has no finite multiplier and needs none: ``lam`` is null.
    """
    open_ = targets.where("source_size > 0 and target > 0").withColumn("unit", F.col("source_size") / F.col("docs"))
    biggest = histogram.groupBy("source").agg(F.max("size").alias("top"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    null_safe = lambda a, b: a["source"].eqNullSafe(b["source"])
    state = open_.join(biggest, null_safe(open_, biggest)).drop(biggest["source"])
    # at the high end every rate is at the cap; at the low end no document keeps its share of the target
    state = state.select(
        "source", "source_size", "target", "unit",
        F.least(F.lit(0.0), F.log(F.col("target") / F.col("source_size") / 2) * F.col("unit") / F.col("least")).alias("lo"),
        (F.log(F.lit(float(max_repeats))) * F.col("unit") / F.col("least") + 1).alias("hi"),
        F.lit(0.0).alias("lam"),
        (F.col("target") >= F.col("source_size") * max_repeats * (1 - 1e-12)).alias("full"),
    )
    state = cut(state)
    for _ in range(NEWTON_ROUNDS):
        s, h = state.where("not full").alias("s"), histogram.where("size > 0").alias("h")
        power = F.col("lam") * F.col("size") / F.col("unit")
        capped = power >= F.log(F.lit(float(max_repeats)))
        rate = F.when(capped, F.lit(float(max_repeats))).otherwise(F.exp(power))
        mass = rate * F.col("size") * F.col("n")
        sums = h.join(s, F.col("h.source").eqNullSafe(F.col("s.source"))).select(F.col("s.source").alias("source"), mass.alias("mass"), F.when(capped, F.lit(0.0)).otherwise(mass * F.col("size") / F.col("unit")).alias("slope")).groupBy("source").agg(F.sum("mass").alias("mass"), F.sum("slope").alias("slope"))
        gap = F.col("mass") - F.col("target")
        lo, hi = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")), F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - F.try_divide(gap, F.col("slope"))
        t = state.alias("t").join(sums.withColumnRenamed("source", "other"), F.col("t.source").eqNullSafe(F.col("other")), "left").drop("other")
        t = t.withColumns({"lo": F.coalesce(lo, "lo"), "hi": F.coalesce(hi, "hi"), "gap": F.coalesce(F.abs(gap) / F.col("target"), F.lit(0.0)), "step": newton})
        inside = (F.col("step") > F.col("lo")) & (F.col("step") < F.col("hi"))
        done = F.col("gap") <= TOLERANCE
        state = cut(t.withColumn("lam", F.when(done, F.col("lam")).when(inside, F.col("step")).otherwise((F.col("lo") + F.col("hi")) / 2)).drop("mass", "slope", "step"))
        if (state.agg(F.max("gap")).first()[0] or 0.0) <= TOLERANCE:
            break
        state = state.drop("gap")
    return state.select("source", "unit", F.when(~F.col("full"), F.col("lam")).alias("lam"))


def mix_to_weights(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: bool = False) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, part, taken) of every row.

    ``copies`` whole copies and ``part`` words of one more are taken: ``taken`` words in all.
    With ``carry`` the row itself comes along as the struct ``row``.
    """
    sized = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col).cast("string")).alias("size"),
        F.xxhash64(F.lit(7), F.col(id_col), F.col(text_col).cast("string")).alias("u"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []),
    )
    if not carry:
        sized = cut(sized)
    histogram = cut(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    totals = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    targets = cut(source_targets(totals, weights, share, max_repeats))
    lam = balance(histogram, targets, max_repeats)
    plan = targets.alias("a").join(lam.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left").select(F.col("a.source").alias("of"), "source_size", "docs", "target", "unit", "lam", F.col("b.unit").isNotNull().alias("open"))
    plan = cut(plan.withColumn("buckets", F.ceil(F.col("docs") / BUCKET_ROWS).cast("int")))
    rate = (
        F.when((F.col("size") == 0) | ~F.col("open"), F.lit(0.0))
        .when(F.col("lam").isNull(), F.lit(float(max_repeats)))
        .otherwise(F.least(F.lit(float(max_repeats)), F.exp(F.col("lam") * F.col("size") / F.col("unit"))))
    )
    rated = sized.join(plan, F.col("source").eqNullSafe(F.col("of"))).withColumns({"rate": rate, "bucket": F.pmod(F.col("u"), F.col("buckets"))})
    rated = rated.withColumns({"whole": F.floor(F.col("rate") + 1e-9).cast("long"), "more": F.greatest(F.col("rate") - F.floor(F.col("rate") + 1e-9), F.lit(0.0))})
    bucket = W.partitionBy("of", "bucket")
    # smaller first: a uniform number by hash over the fractional rate
    luck = F.when(F.col("more") > 0, (F.pmod(F.xxhash64("u"), F.lit(1 << 40)) + 1) / F.col("more")).otherwise(F.lit(float("inf")))
    order = bucket.orderBy("luck", "u", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    dealt = rated.withColumn("luck", luck).withColumns({"room": F.round(F.sum(F.col("more") * F.col("size")).over(bucket)).cast("long"), "upto": F.sum(F.when(F.col("more") > 0, F.col("size")).otherwise(0)).over(order)})
    extra = F.when(F.col("more") <= 0, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.col("size"), F.col("room") - (F.col("upto") - F.col("size"))))).cast("long")
    out = dealt.withColumn("extra", extra).withColumns({"copies": F.col("whole") + F.when((F.col("size") > 0) & (F.col("extra") == F.col("size")), 1).otherwise(0), "part": F.when(F.col("extra") < F.col("size"), F.col("extra")).otherwise(F.lit(0)).cast("long")})
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", "part", (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"), *(["row"] if carry else []))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, white space as it stands."""
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", (n + 1).cast("int"))
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def repeat_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS, text_col: str = "text") -> DataFrame:
    """``docs`` with each row as often as the mix takes it; a last, partial copy ends after its words."""
    mixed = mix_to_weights(docs, weights, share, max_repeats, text_col=text_col, carry=True)
    times = F.col("copies") + F.when(F.col("part") > 0, 1).otherwise(0)
    each = mixed.where(times > 0).select("row", "part", "copies", F.explode(F.sequence(F.lit(1).cast("long"), times)).alias("copy"))
    text = F.col(f"row.`{text_col}`")
    cut_text = F.when(F.col("copy") > F.col("copies"), first_words(text, F.col("part"))).otherwise(text)
    return each.select(*[cut_text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
