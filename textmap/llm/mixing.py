"""Mixing sources to target weights by entropy balancing.

The rate of a document is an exponential tilt in its words, bounded by the cap: of all rates between 0 and
the cap, those nearest to one (in relative entropy of the documents' copies) whose words sum to the source's
target are ``cap / (1 + exp(-l x))``, x the document's words over the mean of its source. One
multiplier l per source solves the convex dual; Newton steps find it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textmap.llm.prefix import running_sums
from textmap.session import stage

WORD = r"[^\x20\x09-\x0D]+"
UNIT = 1_000_000  # rates are rounded to millionths, so that their sums do not depend on the order
MAX_STEPS = 60
TOLERANCE = 1e-9
REPAIRS = 4
EXACT = "decimal(38,9)"


def source_targets(rows: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """One row per source: source, source_size, n_docs, target.

    Sources in code point order, null last, take ``weights`` in turn and share ``share`` times all words by
    weight. No target passes ``cap`` times the source's words; what is cut off goes to the others by weight.
    """
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = per_source.withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    )
    everything = W.partitionBy()
    by_room = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(W.unboundedPreceding, -1)
    limit = F.col("source_size") * F.lit(float(cap))
    # the level at which the remaining sources would stand if all before this one were full
    level = (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    full = weighed.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= limit)
    spread = by_room.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    final = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(spread)
    open_target = F.least(F.col("weight") * F.coalesce(final, F.lit(0.0)), limit)
    return full.select(
        "source", "source_size", "n_docs", F.when(F.col("full"), limit).otherwise(open_target).alias("target")
    )


def tilted(multiplier: Column, x: Column, cap: float) -> Column:
    return F.lit(float(cap)) / (F.lit(1.0) + F.exp(-multiplier * x))


def solve_multipliers(rows: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """The multiplier of each source whose target lies between nothing and its cap: source, multiplier.

    Documents of a source with equal words have equal rates, so the steps run over the counts of
    ``(source, size)``. Each step is one grouped sum of the dual's gradient and curvature; a step that leaves
    the bracket found so far is replaced by its middle or by doubling. Multipliers are rounded to nine places.
    """
    cells = rows.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    limits = targets.where(
        (F.col("target") > 0) & (F.col("target") < F.col("source_size") * F.lit(cap * (1 - 1e-12)))
    ).select(F.col("source").alias("of"), "target", (F.col("source_size") / F.col("n_docs")).alias("mean"))
    cells = cells.join(limits, F.col("source").eqNullSafe(F.col("of"))).select(
        "source", "target", "n", "size", (F.col("size") / F.col("mean")).alias("x")
    )
    cells = stage(cells, "mix-cells")
    state = limits.select(
        "of",
        F.lit(0.0).alias("multiplier"),
        F.lit(None).cast("double").alias("low"),
        F.lit(None).cast("double").alias("high"),
    )
    for _ in range(MAX_STEPS):
        rate = tilted(F.col("multiplier"), F.col("x"), cap)
        words = F.col("n") * F.col("size")
        sums = (
            cells.join(state, F.col("source").eqNullSafe(F.col("of")))
            .groupBy("source", "target", "multiplier", "low", "high")
            .agg(
                F.sum((words * rate).cast(EXACT)).cast("double").alias("taken"),
                F.sum((words * F.col("x") * rate * (F.lit(1.0) - rate / F.lit(float(cap)))).cast(EXACT))
                .cast("double").alias("slope"),
            )
        )
        miss = F.col("taken") - F.col("target")
        now = F.col("multiplier")
        low = F.when(miss < 0, now).otherwise(F.col("low"))
        high = F.when(miss >= 0, now).otherwise(F.col("high"))
        sums = sums.withColumns({"low": low, "high": high, "gap": F.abs(miss) / F.col("target")})
        newton = now - miss / F.when(F.col("slope") > 0, F.col("slope"))
        # without a bracket, a step goes at most one further than twice the way from zero
        reach = F.lit(2.0) * F.abs(now) + F.lit(1.0)
        newton = F.least(F.greatest(newton, -reach), reach)
        fallback = F.when(F.col("low").isNull(), -reach).when(F.col("high").isNull(), reach).otherwise(
            (F.col("low") + F.col("high")) / 2
        )
        inside = newton.isNotNull() & (F.col("low").isNull() | (newton > F.col("low"))) & (
            F.col("high").isNull() | (newton < F.col("high"))
        )
        settled = F.col("gap") <= F.lit(TOLERANCE)
        state = stage(
            sums.select(
                F.col("source").alias("of"),
                F.when(settled, now).when(inside, newton).otherwise(fallback).alias("multiplier"),
                "low", "high", "gap",
            ),
            "mix-state",
        )
        worst = state.agg(F.max("gap")).first()[0]
        state = state.drop("gap")
        if worst is None or worst <= TOLERANCE:
            break
    else:
        raise RuntimeError(f"multipliers did not settle in {MAX_STEPS} steps: a source still misses its target by a share of {worst}")
    return state.select(F.col("of").alias("source"), F.round("multiplier", 9).alias("multiplier"))


def _nearest_moves(chosen: DataFrame, targets: DataFrame, cap: int, moves: DataFrame | None) -> DataFrame:
    """For each source the one document whose next copy, added or dropped, brings the words nearest to the target."""
    if moves is not None:
        done = moves.select(F.col("row").alias("moved"), "delta")
        chosen = (
            chosen.join(F.broadcast(done), F.col("row") == F.col("moved"), "left")  # a row per source and round
            .withColumn("copies", F.col("copies") + F.coalesce(F.col("delta"), F.lit(0)))
            .drop("moved", "delta")
        )
    taken = chosen.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"))
    errors = taken.join(
        targets.select(F.col("source").alias("of"), "target"), F.col("source").eqNullSafe(F.col("of"))
    ).select("of", (F.col("target") - F.col("taken")).alias("error"))
    errors = stage(errors, "mix-errors")
    left = F.abs(F.abs(F.col("error")) - F.col("size"))
    may = (F.col("size") > 0) & (left < F.abs(F.col("error"))) & F.when(
        F.col("error") > 0, F.col("copies") < cap
    ).otherwise(F.col("copies") > 0)
    best = (
        chosen.join(errors, F.col("source").eqNullSafe(F.col("of")))
        .where(may)
        .groupBy("source")
        .agg(F.min(F.struct(left.alias("left"), F.col("row"), F.signum("error").cast("long").alias("delta"))).alias("best"))
    )
    return best.select("best.row", "best.delta")


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Copies of each document so that each source's words meet its target.

    Columns: ``id_col``, row (number of the row in the scan, see below), source, size, source_size, target,
    rate, copies. ``size`` counts the words of the text; ``copies`` is 0 to ``cap``.

    Rates become copies by systematic rounding along each source's documents, longest first, so that the
    rounding errors of neighbours cancel; what is left over is taken back by at most four single documents per
    source. Everything is decided by whole numbers and fixed hashes: reruns agree.

    Null text: size 0. Null source: a source of its own, last in order. A source without words has the target 0.
    Repeated rows are rounded each for themselves. ``row`` is the scan's row number, the same for every scan
    of the same files. An empty table gives an empty result. Other columns play no part.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id__"),
        F.col(source_col).alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = stage(rows, "mix-rows")
    targets = stage(source_targets(rows, weights, share, cap), "mix-targets")
    multipliers = solve_multipliers(rows, targets, cap)
    known = targets.join(
        multipliers.select(F.col("source").alias("of"), "multiplier"), F.col("source").eqNullSafe(F.col("of")), "left"
    ).select(F.col("source").alias("of"), "source_size", "target", "multiplier", (F.col("source_size") / F.col("n_docs")).alias("mean"))
    known = stage(known, "mix-known")
    rate = F.when(
        F.col("multiplier").isNull(), F.when(F.col("target") > 0, F.lit(float(cap))).otherwise(F.lit(1.0))
    ).otherwise(tilted(F.col("multiplier"), F.col("size") / F.col("mean"), cap))
    rated = rows.join(known, F.col("source").eqNullSafe(F.col("of"))).withColumn(
        "millionths", F.round(rate * UNIT).cast("long")
    ).withColumn("part", F.col("millionths") % UNIT).drop("of", "multiplier", "mean")
    order = [F.col("size").desc(), F.xxhash64("id__"), F.col("row")]
    summed = running_sums(rated, order, {"part": "before"}, "mix-rates", group="source")
    half = UNIT // 2
    whole = F.expr(
        f"millionths div {UNIT} + (before + part + {half}) div {UNIT} - (before + {half}) div {UNIT}"
    )
    chosen = stage(summed.withColumn("copies", whole).drop("part", "before"), "mix-copies")
    moves = None
    for _ in range(REPAIRS):
        found = _nearest_moves(chosen, targets, cap, moves)
        moves = stage((found if moves is None else moves.unionByName(found)).groupBy("row").agg(F.sum("delta").alias("delta")), "mix-moves")
    done = moves.select(F.col("row").alias("moved"), "delta")
    return chosen.join(F.broadcast(done), F.col("row") == F.col("moved"), "left").select(
        F.col("id__").alias(id_col), "row", "source", "size", "source_size", "target",
        (F.col("millionths") / UNIT).alias("rate"),
        (F.col("copies") + F.coalesce(F.col("delta"), F.lit(0))).alias("copies"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix: each row of ``docs`` as often as ``mix`` takes it, with all its columns.

    ``docs`` must be a scan of stored files, which numbers its rows alike each time it is read.
    """
    taken = mix(docs, **options).where("copies > 0").select(F.col("row").alias("taken_row"), F.col("copies").cast("int").alias("copies"))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rest"), F.monotonically_increasing_id().alias("row"))
    repeated = held.join(taken, F.col("row") == F.col("taken_row")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select(*[F.col(f"rest.`{c}`") for c in docs.columns])
