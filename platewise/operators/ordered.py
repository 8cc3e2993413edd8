"""Exact order statistics and ordered running sums that survive hot groups.

Medians, percentiles, ranks and empirical distribution functions all need a group's values in
order. A group (a day, a well, a cell) can hold a third of all rows, so nothing here sorts or
buffers a whole unbounded group in one task:

* quantiles of large groups are found by narrowing: a sketch of each group and feature proposes two values on
  either side of a wanted rank, one pass counts the values below, at and between them, and only the
  values between them go on. The counts are exact, so the sketch decides how much is left, never the
  result. Where more than ``TASK_VALUES`` are left, radix selection reads the order-preserving 64-bit
  images of what is left digit by digit; what remains is put in order and picked by rank;
* running sums are taken in two levels: (group, value) pairs are cut into as many ranges as there
  are tasks, so a group gets ranges in proportion to its own size; sums inside a range are put
  together with the totals of the group's ranges before it.

The cut points only decide how work is spread; results never depend on them. They are a pure
function of the data (for each hash class the pair with the smallest second hash), so a
recomputed task after an executor loss cuts exactly as before.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platewise.functions.numeric import all_present, no_nan, order_image
from platewise.session import stage

#: Values (rows x features) of one group that a task puts in order. Larger groups are narrowed down to it.
TASK_VALUES = 1 << 20
#: Size of the sketches that propose where a rank lies: wrong by about 0.04 % of the ranks, 0.2 MB each.
SKETCH = 8192
#: How far from a rank its two bounds are taken, as a share of the ranks.
SKETCH_MARGIN = 0.001
#: Where groups are larger than so many rows, sketches take about so many rows of the smallest, but at least ``SKETCH_SHARE`` of all.
SKETCH_ROWS = 1 << 17
SKETCH_SHARE = 1 / 16
#: How far from a rank its bounds may be taken where sketches see part of the rows, and in how many standard errors.
PART_MARGINS = (0.001, 0.002, 0.004, 0.008, 0.016, 0.032, 0.064)
PART_ERRORS = 4.0
#: Features that passes over all rows hold as columns side by side. More are stacked, so plans stay as small for any number of
#: them; the optimizer's work on one test over many columns doubles with every column or two.
WIDE_FEATURES = 8
#: Stacked features whose sketches a task holds side by side: Spark hashes up to 128 groups of such aggregates, then it sorts.
SKETCHED_FEATURES = 100
#: Bits that one radix pass reads; a task holds at most 2^DIGIT counts per group and feature.
DIGIT = 16
#: Ranges of (group, value) pairs per task.
RANGES_PER_TASK = 4


def task_ranges(df: DataFrame) -> int:
    """How many ranges ordered work is cut into; it follows the cluster's setting, not the data."""
    return RANGES_PER_TASK * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def long_form(df: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    """``ids, feature, value`` with missing values left out."""
    # stack, not unpivot: filters on the ids move below it in every copy of the plan, which keeps
    # the copies equal and lets Spark share their shuffles.
    pairs = [p for f in features for p in (F.lit(f), F.col(f"`{f}`").cast("double"))]
    out = df.select(*ids, F.stack(F.lit(len(features)), *pairs).alias("feature", "value"))
    return out.where(no_nan(F.col("value")).isNotNull())


def assign_ranges(df: DataFrame, by: Sequence[str], value: str, ranges: int | None = None) -> DataFrame:
    """Add ``_range``: which of the ranges of (``by``, ``value``) pairs a row falls in.

    Cuts are drawn evenly from all rows, so a group gets ranges in proportion to its rows. There is one per hash class,
    ``ranges`` in all, which every task gets as one array; its size is set by the cluster.

    The second hash reads all columns: so the cuts need of ``df`` what its rows need, and Spark shares the shuffle that
    ``df`` comes from, which it would make twice if the cuts could do with fewer columns.
    """
    ranges = ranges or task_ranges(df)
    pair = F.struct(*[F.col(f"`{c}`") for c in by], F.col(value).alias(value))
    drawn = df.groupBy(F.pmod(F.xxhash64(*by, value), F.lit(ranges)).alias("_class"))
    drawn = drawn.agg(F.min_by(pair, F.xxhash64(F.lit(1), *[F.col(f"`{c}`") for c in df.columns])).alias("_cut"))
    out = df.withColumn("_cuts", drawn.agg(F.array_sort(F.collect_list("_cut")).alias("_cuts")).scalar())
    out = out.withColumn("_pair", pair).withColumn("_range", F.lit(0))
    step = 1 << (ranges.bit_length() - 1)
    while step:
        # One binary-search step per projection keeps the search inside generated code.
        ahead = F.get("_cuts", F.col("_range") + F.lit(step - 1))
        out = out.withColumn("_range", F.col("_range") + F.when(ahead <= F.col("_pair"), step).otherwise(0))
        step >>= 1
    return out.drop("_cuts", "_pair")


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    measures: Mapping[str, Column],
    ranges: int | None = None,
    ties: bool = False,
) -> DataFrame:
    """Running sums of ``measures`` in order of ``value`` within ``by``.

    ``df`` is counted: rows that share a value are few. Adds ``{m}_upto`` (sum over all rows of the
    group with value <= this one), ``{m}_total`` (sum over the group), ``next_value`` (the value of
    the next row in order, NULL at the end) and, with ``ties``, ``{m}_ties`` (sum over rows with
    this same value). Rows without a value or a key drop out.

    The counted rows are shuffled once more, by group and range; the running sums inside a range
    and the totals per range both read that shuffle.
    """
    by = list(by)
    keep = df.columns
    cell = [*by, "_range"]
    # Keys are checked up front so that the joins below add no filter of their own to one branch.
    known = df.where(all_present([*by, value]))
    ranged = assign_ranges(known, by, value, ranges).repartition(*cell)
    ranged = ranged.select("*", *[expr.alias(f"_m_{m}") for m, expr in measures.items()])
    ordered = W.partitionBy(*cell).orderBy(value)
    peers_in = ordered.rangeBetween(W.unboundedPreceding, W.currentRow)
    peers = ordered.rangeBetween(W.currentRow, W.currentRow)
    local = ranged.select(
        *keep,
        "_range",
        F.lead(value).over(ordered).alias("_next_here"),
        *[F.sum(f"_m_{m}").over(peers_in).alias(f"_in_{m}") for m in measures],
        *([F.sum(f"_m_{m}").over(peers).alias(f"{m}_ties") for m in measures] if ties else []),
    )
    # One row per group and range: at most groups + ranges rows.
    per_range = ranged.groupBy(*cell).agg(
        F.min(value).alias("_first"), *[F.sum(f"_m_{m}").alias(f"_sum_{m}") for m in measures]
    )
    along = W.partitionBy(*by).orderBy("_range")
    earlier = along.rowsBetween(W.unboundedPreceding, -1)
    offsets = per_range.select(
        *cell,
        F.lead("_first").over(along).alias("_next_first"),
        *[F.coalesce(F.sum(f"_sum_{m}").over(earlier), F.lit(0)).alias(f"_off_{m}") for m in measures],
        *[F.sum(f"_sum_{m}").over(W.partitionBy(*by)).alias(f"{m}_total") for m in measures],
    )
    return local.join(offsets, cell).select(
        *keep,
        F.coalesce("_next_here", "_next_first").alias("next_value"),
        *[(F.col(f"_off_{m}") + F.col(f"_in_{m}")).alias(f"{m}_upto") for m in measures],
        *[F.col(f"{m}_total") for m in measures],
        *([F.col(f"{m}_ties") for m in measures] if ties else []),
    )


def _position(p: float, n: Column) -> Column:
    return F.lit(float(p)) * (n - 1)


def _blend(p: float, n: Column, at) -> Column:
    """The value at share ``p`` of ``n`` ordered values, linear between two ranks; ``at`` gives the value of a rank."""
    h = _position(p, n)
    lo, hi = F.floor(h).cast("long"), F.ceil(h).cast("long")
    return F.when(lo == hi, at(lo)).otherwise((hi - h) * at(lo) + (h - lo) * at(hi))


def _part(rows: int | None) -> float:
    """The share of rows that sketches take of groups of at least ``rows`` rows."""
    return min(1.0, max(SKETCH_SHARE, SKETCH_ROWS / rows)) if rows else 1.0


def _stacked(df: DataFrame, keys: list[str], features: list[str], bounds: DataFrame | None = None) -> DataFrame:
    """``keys, _at, value``: a row per value, with the place of its feature; with ``bounds``, also ``_b``: those of its group and feature.

    Bounds meet the rows by group before these are stacked: an array with an entry per feature.
    """
    rows, held = df.select(*keys, F.array(*[F.col(f"`{f}`").cast("double") for f in features]).alias("_cells")), []
    if bounds is not None:
        by_feature = F.map_from_entries(F.collect_list(F.struct("feature", "bounds")))
        wide = bounds.groupBy(*keys).agg(by_feature.alias("_of"))
        wide = stage(wide.select(*keys, F.transform(_names(features), lambda f: F.element_at("_of", f)).alias("_all")), "wide-bounds")
        rows, held = rows.join(wide, keys, "left") if keys else rows.crossJoin(wide), ["_all"]
    # Outer, though no array is empty: from an inner one Spark infers a filter over all cells, and for each of these that a
    # column is named for it keeps the filter with and without the name: twice as many per feature.
    out = rows.select(*keys, *held, F.posexplode_outer("_cells").alias("_at", "value")).where(no_nan(F.col("value")).isNotNull())
    return out.select(*keys, "_at", "value", *[F.get(c, F.col("_at")).alias("_b") for c in held])


def _names(features: Sequence[str]) -> Column:
    return F.array(*[F.lit(f) for f in features])


def _named(features: Sequence[str]) -> Column:
    """The name at the place ``_at``."""
    return F.get(_names(features), F.col("_at")).alias("feature")


def _bounded(df: DataFrame, keys: list[str], features: list[str], probs: Sequence[float], rows: int | None = None) -> DataFrame:
    """``keys, feature, bounds`` (``lo, hi`` of each of ``probs``): values between which a wanted rank is to be expected.

    Sketches of large groups take part of the rows, and bounds lie further apart the fewer they are; an end is NULL (open)
    where it would lie outside. This only proposes: every row is counted afterwards.
    """
    found, part = [], _part(rows)
    margins = [SKETCH_MARGIN] if part == 1.0 else PART_MARGINS
    ends = F.array(*[F.lit(end) for p in probs for m in margins for end in (max(0.0, p - m), min(1.0, p + m))])
    seen = df if part == 1.0 else df.where(F.rand(1) < part)

    def ends_of(cuts: Column, n: Column, j: int) -> Column:
        at = 2 * len(margins) * j
        if part == 1.0:
            return F.struct(F.get(cuts, F.lit(at)).alias("lo"), F.get(cuts, F.lit(at + 1)).alias("hi"))
        p = probs[j]
        need = F.lit(SKETCH_MARGIN / 2) + PART_ERRORS * F.sqrt(F.greatest(F.lit(p * (1 - p)), 1 / n) / n)
        lo, hi = F.lit(None).cast("double"), F.lit(None).cast("double")
        for k, m in reversed(list(enumerate(margins))):
            near = need <= m
            lo = F.when(near & F.lit(p > m), F.get(cuts, F.lit(at + 2 * k))).otherwise(F.when(~near, lo))
            hi = F.when(near & F.lit(p + m < 1), F.get(cuts, F.lit(at + 2 * k + 1))).otherwise(F.when(~near, hi))
        return F.struct(lo.alias("lo"), hi.alias("hi"))

    # The ends are the same for all groups, as the function wants constants. Cuts are taken once per sketch.
    if len(features) <= WIDE_FEATURES:
        values = [no_nan(F.col(f"`{f}`").cast("double")) for f in features]
        aggs = [a for i, v in enumerate(values) for a in (F.count(v).alias(f"_n{i}"), F.kll_sketch_agg_double(v, F.lit(SKETCH)).alias(f"_s{i}"))]
        cuts = [F.when(F.col(f"_n{i}") > 0, F.kll_sketch_get_quantile_double(f"_s{i}", ends)) for i in range(len(features))]
        named = [F.struct(F.lit(f).alias("feature"), F.col(f"_n{i}").alias("n"), c.alias("cuts")) for i, (f, c) in enumerate(zip(features, cuts))]
        found.append(seen.groupBy(*keys).agg(*aggs).select(*keys, F.inline(F.array(*named))))
    else:
        for at in range(0, len(features), SKETCHED_FEATURES):
            some = features[at : at + SKETCHED_FEATURES]
            sketches = _stacked(seen, keys, some).groupBy(*keys, "_at").agg(F.count("value").alias("n"), F.kll_sketch_agg_double("value", F.lit(SKETCH)).alias("_s"))
            found.append(sketches.select(*keys, _named(some), "n", F.kll_sketch_get_quantile_double("_s", ends).alias("cuts")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    pairs = F.array(*[ends_of(F.col("cuts"), F.col("n"), j) for j in range(len(probs))])
    return stage(out.where("n > 0").select(*keys, "feature", pairs.alias("bounds")), "rank-bounds")


def _with_bounds(df: DataFrame, keys: list[str], bounds: DataFrame, features: list[str]) -> DataFrame:
    """``df`` with one column ``_b{i}`` of bounds per feature, by key; a row per group stays small."""
    wide = bounds.groupBy(*keys).agg(*[F.first(F.when(F.col("feature") == f, F.col("bounds")), ignorenulls=True).alias(f"_b{i}") for i, f in enumerate(features)])
    wide = stage(wide, "wide-bounds")
    return df.join(wide, keys, "left") if keys else df.crossJoin(wide)


def _narrow(
    df: DataFrame, keys: list[str], features: list[str], probs: Sequence[float], rows: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """The first step of ``select_ranks``: its rows after one counting pass, and the values that are left, with images.

    A rank lies below its two bounds, at one of them (then it is known), between or above them; which one follows from
    exact counts, so bounds that missed a rank only leave more values. Open bounds have everything on their inner side.
    """
    by = [*keys, "feature"]
    bounds = _bounded(df, keys, features, probs, rows)
    counts = range(len(probs))

    def tallies(v: Column, ends: str, tag: str = "") -> list[Column]:
        out = []
        for j in counts:
            lo, hi = (F.get(ends, F.lit(j))[end] for end in ("lo", "hi"))
            above = hi.isNull() & v.isNotNull()
            tests = {"a": v < lo, "b": v <= lo, "c": (v < hi) | above, "d": (v <= hi) | above}
            out += [F.count(F.when(test, F.lit(1))).alias(f"_{k}{tag}_{j}") for k, test in tests.items()]
        return out

    def tallied(tag: str = "") -> Column:
        return F.array(*[F.struct(*[F.col(f"_{k}{tag}_{j}").alias(k) for k in "abcd"]) for j in counts]).alias("held")

    wide = len(features) <= WIDE_FEATURES
    if wide:
        cells = [no_nan(F.col(f"`{f}`").cast("double")).alias(f"_v{i}") for i, f in enumerate(features)]
        spread = _with_bounds(df.select(*keys, *cells), keys, bounds, features)
        aggs = [a for i in range(len(features)) for a in (F.count(f"_v{i}").alias(f"_n{i}"), *tallies(F.col(f"_v{i}"), f"_b{i}", str(i)))]
        named = [F.struct(F.lit(f).alias("feature"), F.col(f"_n{i}").alias("n"), tallied(str(i))) for i, f in enumerate(features)]
        held = spread.groupBy(*keys).agg(*aggs).select(*keys, F.inline(F.array(*named)))
    else:
        sums = _stacked(df, keys, features, bounds).groupBy(*keys, "_at").agg(F.count("value").alias("n"), *tallies(F.col("value"), "_b"))
        held = sums.select(*keys, _named(features), "n", tallied())
    held = held.where("n > 0")
    n, least, most = F.col("n"), F.lit(-(1 << 63)).cast("long"), F.lit((1 << 63) - 1).cast("long")
    steps = [
        F.struct(end(_position(p, n)).cast("long").alias("rank"), F.get("bounds", F.lit(j)).alias("at"), F.get("held", F.lit(j)).alias("held"))
        for j, p in enumerate(probs)
        for end in (F.floor, F.ceil)
    ]
    asked = held.join(bounds, by, "left").select(*by, "n", F.inline(F.array(*steps)))
    rank, lo, hi = F.col("rank"), F.col("at.lo"), F.col("at.hi")
    a, b, c, d = (F.col(f"held.{k}") for k in "abcd")

    def place(below, at_lo, between, at_hi, above):
        # Bounds that coincide have nothing between them, and b counts what c does not.
        return F.when(rank < a, below).when(rank < b, at_lo).when(rank < c, between).when(rank < d, at_hi).otherwise(above)

    none = F.lit(None).cast("double")
    low, high = order_image(lo), order_image(hi)
    after, before = F.coalesce(low + 1, least), F.coalesce(high - 1, most)
    ranks = asked.select(
        *by, "n", "rank", place(none, lo, none, hi, none).alias("value"),
        place(least, low, after, high, high + 1).alias("low"), place(low - 1, low, before, high, most).alias("high"),
        place(F.lit(0), a, b, F.greatest(b, c), d).cast("long").alias("below"), place(a, b - a, c - b, d - F.greatest(b, c), n - d).alias("inside"),
        place(none, none, lo, none, hi).alias("_above"), place(lo, none, hi, none, none).alias("_under"),
    ).dropDuplicates([*by, "rank"])
    # Both ends name a span: spans of several ranks can begin at one value, or be open.
    ranks = stage(ranks.withColumn("span", F.struct("low", "high")), "ranks")
    span = F.struct("span", "_above", "_under")
    # An end that some span lacks is open.
    first = F.when(F.count("_above") == F.count(F.lit(1)), F.min("_above"))
    last = F.when(F.count("_under") == F.count(F.lit(1)), F.max("_under"))
    spans = ranks.where("value IS NULL").groupBy(*by).agg(first.alias("_from"), last.alias("_to"), F.collect_set(span).alias("_spans"))
    spans = stage(spans, "open-spans")

    def within(v: Column, above: Column, under: Column) -> Column:
        return (above.isNull() | (v > above)) & (under.isNull() | (v < under))

    # The outer ends first, as plain numbers and before rows are stacked, so the rows that hold nothing between them are
    # dropped whole; the spans themselves and the images only for what lies between these.
    ends = spans.select(*by, F.struct("_from", "_to").alias("bounds"))
    if wide:
        spread = _with_bounds(df.select(*keys, *cells), keys, ends, features)
        inner = [F.col(f"_b{i}").isNotNull() & F.col(f"_v{i}").isNotNull() & within(F.col(f"_v{i}"), F.col(f"_b{i}._from"), F.col(f"_b{i}._to")) for i in range(len(features))]
        kept = [F.when(test, F.col(f"_v{i}")).alias(f) for i, (f, test) in enumerate(zip(features, inner))]
        near = long_form(spread.where(reduce(or_, inner)).select(*keys, *kept), keys, features)
    else:
        near = _stacked(df, keys, features, ends).where(F.col("_b").isNotNull() & within(F.col("value"), F.col("_b._from"), F.col("_b._to")))
        near = near.select(*keys, _named(features), "value")
    left = near.join(spans, by)
    own = F.filter("_spans", lambda s: within(F.col("value"), s["_above"], s["_under"]))
    left = left.select(*by, "value", F.explode(F.transform(own, lambda s: s["span"])).alias("span"))
    return ranks.drop("_above", "_under"), stage(left.withColumn("image", order_image(F.col("value"))), "rank-values")


def _selected(
    df: DataFrame, keys: Sequence[str], features: Sequence[str], probs: Sequence[float], enough: int, rows: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """``select_ranks`` with the span that each rank was counted in, and the values left in the spans."""
    by = [*keys, "feature", "span"]
    wanted, left = _narrow(df, list(keys), list(features), probs, rows)
    wanted = wanted.withColumn("prefix", F.lit(0).cast("long"))
    current, prefix, shift, done = left.withColumn("n", F.lit(1).cast("long")), F.lit(0).cast("long"), 64, []
    while True:
        settled = F.col("value").isNotNull() | (F.col("inside") <= enough)
        done.append(wanted.where(settled))
        unsettled = wanted.where(~settled)
        if not shift or unsettled.isEmpty():
            break
        places = unsettled.select(*by, "prefix").distinct()
        here = current.withColumn("prefix", prefix).join(places, [*by, "prefix"], "left_semi")
        if shift < 64:
            # What shares no digits with a wanted rank is left behind.
            here = stage(here.groupBy(*by, "prefix", "image", "value").agg(F.sum("n").alias("n")), "rank-values")
        shift -= DIGIT
        digit = F.shiftright("image", shift)
        held = here.groupBy(*by, "prefix", digit.alias("_digit")).agg(
            F.sum("n").alias("_n"), F.min("value").alias("_min"), F.max("value").alias("_max")
        )
        along = W.partitionBy(*by, "prefix").orderBy("_digit")
        held = held.withColumn("_upto", F.sum("_n").over(along))
        rank, before = F.col("rank") - F.col("below"), F.col("_upto") - F.col("_n")
        found = unsettled.join(held, [*by, "prefix"]).where((before <= rank) & (rank < F.col("_upto")))
        start = F.shiftleft("_digit", shift)
        wanted = stage(found.select(
            *by, "n", "rank", F.when(F.col("_min") == F.col("_max"), F.col("_min")).alias("value"),
            F.greatest("low", start).alias("low"), F.least("high", start + F.lit((1 << shift) - 1)).alias("high"),
            (F.col("below") + before).alias("below"), F.col("_n").alias("inside"), F.col("_digit").alias("prefix"),
        ), "ranks")
        current, prefix = here.drop("prefix"), digit
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("prefix"), left


def select_ranks(df: DataFrame, keys: Sequence[str], features: Sequence[str], probs: Sequence[float], enough: int) -> DataFrame:
    """``keys, feature, n, rank, value, low, high, below, inside``, a row per rank that ``probs`` ask for.

    A sketch and a counting pass narrow every rank first, then radix passes go on until its value is known (then it is
    ``value``) or at most ``enough`` values share its digits so far: those with images from ``low`` to ``high``, with
    ``below`` smaller ones before them. With ``enough`` 0 every value becomes known. ``df`` is read three times; radix
    passes read what is left.
    """
    return _selected(df, keys, features, probs, enough)[0].drop("span")


def _narrowed_quantiles(
    df: DataFrame, keys: list[str], features: list[str], probs: Sequence[float], limit: int, rows: int | None = None
) -> DataFrame:
    """``keys`` and ``{feature}``: exact quantiles of groups of at least ``rows`` rows, without a feature's array where it has no value."""
    by = [*keys, "feature"]
    enough = max(1, limit // (2 * len(features) * len(probs)))
    ranks, left = _selected(df, keys, features, probs, enough, rows)
    ranks = stage(ranks, "ranks")
    open_ = ranks.where("value IS NULL")
    spans = open_.select(*by, "span", "low", "high", "below").distinct()
    inside = left.join(spans, [*by, "span"]).where(F.col("image").between(F.col("low"), F.col("high")))
    along = W.partitionBy(*by, "span", "low").orderBy("image")
    placed = inside.select(*by, "span", "low", (F.col("below") + F.row_number().over(along) - 1).alias("rank"), F.col("value").alias("_value"))
    picked = open_.join(placed, [*by, "span", "low", "rank"]).select(*by, "n", "rank", F.col("_value").alias("value"))
    known = ranks.where("value IS NOT NULL").select(*by, "n", "rank", "value").unionByName(picked)
    found = known.groupBy(*by).agg(F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))
    q = F.array(*[_blend(p, F.col("n"), lambda r: F.element_at("at", r)) for p in probs])
    # One row per group; a feature without values has no entry.
    held = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("feature", q.alias("q")))).alias("_q"))
    return held.select(*keys, *[F.element_at("_q", F.lit(f)).alias(f) for f in features])


def _crowded(df: DataFrame, keys: Sequence[str], limit: int, seen: Observation | None = None) -> DataFrame:
    """``keys, _rows`` of the groups with more rows than a task should put in order.

    ``seen`` is told how many others are ``small``.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    if seen is not None:
        sizes = sizes.observe(seen, F.count_if(F.col("_rows") <= limit).alias("small"))
    return stage(sizes.where(F.col("_rows") > limit), "crowded-groups")


def _picked(values: str, probs: Sequence[float]) -> Column:
    """Quantiles from the ordered values of a group; an empty array without values."""
    n = F.size(values).cast("long")
    found = F.array(*[_blend(p, n, lambda rank: F.get(values, rank.cast("int"))) for p in probs])
    return F.when(n > 0, found).otherwise(F.array().cast("array<double>"))


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    features: Sequence[str],
    probs: Sequence[float],
    extra: Sequence[Column] = (),
    task_values: int = TASK_VALUES,
) -> DataFrame:
    """One row per group: ``keys``, ``{feature}: array<double>`` of exact quantiles, and ``extra``.

    Rows with a missing key belong to no group; a feature without values has an empty array. ``extra`` are ordinary
    aggregates. Groups of up to ``task_values`` values are put in order and the quantiles picked by rank; larger ones are
    narrowed to the few values around each rank first. No key and no result passes through the driver, and joins are left
    to the optimizer. ``df`` is read once to count, once to pick where there are small groups, and up to four times for
    large ones.
    """
    keys, features = list(keys), list(features)
    keyed = df.where(all_present(keys))
    seen = Observation()
    sizes = _crowded(keyed, keys, max(1, task_values // max(1, len(features))), seen)
    crowded, least = sizes.select(*keys), sizes.agg(F.min("_rows")).first()[0]
    small = keyed if least is None else keyed.join(crowded, keys, "left_anti")
    cells = [no_nan(F.col(f"`{f}`").cast("double")) for f in features]
    lists = small.groupBy(*keys).agg(*[F.sort_array(F.collect_list(v)).alias(f"_list{i}") for i, v in enumerate(cells)], *extra)
    rest = [c for c in lists.columns if c not in keys and not c.startswith("_list")]
    out = lists.select(*keys, *[_picked(f"_list{i}", probs).alias(f) for i, f in enumerate(features)], *rest)
    if least is None:
        return out
    large = keyed.join(crowded, keys, "left_semi")
    found = stage(_narrowed_quantiles(large, keys, features, probs, task_values, least), "narrowed-groups")
    sums = large.groupBy(*keys).agg(*extra) if extra else crowded
    sums = sums.join(found, keys, "left")
    none = F.array().cast("array<double>")
    found = sums.select(*keys, *[F.coalesce(F.col(f"`{f}`"), none).alias(f) for f in features], *rest)
    # Without small groups their rows are not looked for.
    return found if seen.get.get("small") == 0 else out.unionByName(found)


def with_group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    features: Sequence[str],
    probs: Sequence[float],
    prefix: str = "_q_",
    task_values: int = TASK_VALUES,
) -> DataFrame:
    """All rows of ``df`` plus ``{prefix}{feature}``: the quantiles of the row's group.

    The statistics are one row per group. They are stored first, so that the join knows their true size: small
    ones are broadcast by Spark itself and the rows are not shuffled; large ones are joined by key. Rows with a
    missing key match nothing and get NULL.
    """
    keys, features = list(keys), list(features)
    stats = group_quantiles(df, keys, features, probs, task_values=task_values)
    stats = stage(stats.select(*keys, *[F.col(f"`{f}`").alias(f"{prefix}{f}") for f in features]), "group-quantiles")
    return df.join(stats, keys, "left").select(*df.columns, *[F.col(f"`{prefix}{f}`") for f in features])


def table_quantiles(df: DataFrame, features: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """One row with ``{feature}: array<double>``: exact quantiles over the whole table, narrowed as a large group is."""
    return _narrowed_quantiles(df, [], list(features), probs, TASK_VALUES, df.count())


def grid_quantiles(
    df: DataFrame, features: Sequence[str], points: int, ranges: int | None = None
) -> DataFrame:
    """``feature, q``: each column's exact quantiles at ``points`` even steps from 0 to 1.

    For many points: a value finds the few grid points whose rank it covers, instead of every
    point searching all values. The result is features x points doubles.
    """
    counted = long_form(df, [], features).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(counted, ["feature"], "value", {"n": F.col("n")}, ranges=ranges)
    last = F.col("n_total") - 1
    steps = F.lit(points - 1)
    # Grid points near the ranks [n_upto - n, n_upto) this value covers, one to spare on each side.
    per_rank = F.coalesce(F.try_divide(steps.cast("double"), last.cast("double")), F.lit(0.0))
    first = F.greatest(F.lit(0), F.floor((F.col("n_upto") - F.col("n") - 1) * per_rank) - 1)
    final = F.when(last == 0, steps).otherwise(F.least(steps, F.ceil(F.col("n_upto") * per_rank) + 1))
    near = ranked.select("feature", "value", "n", "n_upto", "n_total", F.explode(F.sequence(first.cast("int"), final.cast("int"))).alias("i"))
    at = (F.col("n_total") - 1) * F.col("i") / steps
    # A rank that is whole up to rounding is one value, not a blend of two.
    at = F.when(F.abs(at - F.rint(at)) < 1e-9, F.rint(at)).otherwise(at)
    near = near.withColumn("_at", at).withColumn("_from", F.col("n_upto") - F.col("n"))
    low = (F.col("_from") <= F.floor("_at")) & (F.floor("_at") < F.col("n_upto"))
    high = (F.col("_from") <= F.ceil("_at")) & (F.ceil("_at") < F.col("n_upto"))
    found = near.where(low | high).groupBy("feature", "i", "_at").agg(
        F.max(F.when(low, F.col("value"))).alias("_lo"), F.max(F.when(high, F.col("value"))).alias("_hi")
    )
    part = F.col("_at") - F.floor("_at")
    q = F.when(part == 0, F.col("_lo")).otherwise(F.col("_lo") + part * (F.col("_hi") - F.col("_lo")))
    return found.groupBy("feature").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", q.alias("q")))), lambda s: s["q"]).alias("q")
    )
