"""Alert times to alert events, and what they cost: rates, delays, duty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Dilation, merge gap, least length and cooldown in seconds.
PARAMETERS = (1200.0, 3000.0, 1200.0, 6000.0)


def _islands(df: DataFrame, keys: list[str], start: str, end: str, begins: Column, count: Column) -> DataFrame:
    """Groups of consecutive rows: begins marks each group's first row."""
    w = Window.partitionBy(*keys).orderBy(start)
    ids = df.withColumn("__g", F.sum(begins.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return ids.groupBy(*keys, "__g").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.sum(count).alias("alarms")).drop("__g")


def eventize(alerts: DataFrame, keys: list[str], dilation: Column | float = PARAMETERS[0], merge: Column | float = PARAMETERS[1], least: Column | float = PARAMETERS[2], cooldown: Column | float = PARAMETERS[3]) -> DataFrame:
    """alerts (keys, t) to (keys, start, end, alarms).

    Alerts no further apart than dilation or merge gap are one block (gaps between blocks are gaps between alerts);
    blocks shorter than least go; a block that starts less than the cooldown after the one before joins it. Windows
    are by device and stream: alerts are those few rows that pass a threshold.
    """
    lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    w = Window.partitionBy(*keys)
    gap = F.col("t") - F.lag("t").over(w.orderBy("t"))
    blocks = _islands(alerts.withColumn("__gap", gap), keys, "t", "t", F.col("__gap").isNull() | (F.col("__gap") > F.greatest(lit(dilation), lit(merge))), F.lit(1))
    blocks = blocks.where(F.col("end") - F.col("start") >= lit(least))
    rest = F.col("start") - F.lag("end").over(w.orderBy("start"))
    return _islands(blocks.withColumn("__rest", rest), keys, "start", "end", F.col("__rest").isNull() | (F.col("__rest") >= lit(cooldown)), F.col("alarms"))


def streams(obs: DataFrame) -> DataFrame:
    """(client_id, n_alerts, n_benign_alerts, attack_start, attack_end, duration) of obs with threshold."""
    hit = F.col("score") > F.col("threshold")
    attack = F.col("label") == "attack"
    return obs.groupBy("client_id").agg(
        F.count_if(hit).alias("n_alerts"), F.count_if(hit & ~attack).alias("n_benign_alerts"),
        F.min(F.when(attack, F.col("t"))).alias("attack_start"), F.max(F.when(attack, F.col("t"))).alias("attack_end"), (F.max("t") - F.min("t")).alias("duration"),
    )


def event_metrics(obs: DataFrame, keys: tuple[str, ...] = ("client_id",), parameters: tuple = PARAMETERS) -> DataFrame:
    """Event rates, recall of the attack interval, delay and duty, for devices that have any event.

    obs: keys, label, t, score, threshold. parameters: numbers, or columns that are among the keys.
    """
    alerts, span = _alerts_and_span(obs, list(keys))
    return _metrics(alerts, span, list(keys), list(keys), parameters)


def _alerts_and_span(obs: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Alerts (keys, t, benign), and each device's duration, attack interval and delay."""
    attack = F.col("label") == "attack"
    alerts = obs.where(F.col("score") > F.col("threshold")).select(*keys, "t", (~attack).alias("benign"))
    span = obs.groupBy(*keys).agg((F.max("t") - F.min("t")).alias("duration"), F.min(F.when(attack, F.col("t"))).alias("a0"), F.max(F.when(attack, F.col("t"))).alias("a1"))
    inside = alerts.join(span, keys).where(F.col("t").between(F.col("a0"), F.col("a1"))).groupBy(*keys).agg((F.min("t") - F.min("a0")).alias("delay"))
    return alerts, span.join(inside, keys, "left")


def _metrics(alerts: DataFrame, span: DataFrame, own: list[str], keys: list[str], parameters: tuple) -> DataFrame:
    """Metrics by keys, of which own are those of span."""
    both = alerts.select(*keys, "t", F.explode(F.when(F.col("benign"), F.array(F.lit("all"), F.lit("benign"))).otherwise(F.array(F.lit("all")))).alias("stream"))
    ev = eventize(both, [*keys, "stream"], *parameters)
    per = ev.join(span.select(*own, "duration"), own).groupBy(*keys).agg(
        F.count_if(F.col("stream") == "benign").alias("benign_events"), F.count_if(F.col("stream") == "all").alias("all_events"),
        F.coalesce(F.avg(F.when(F.col("stream") == "benign", (F.col("end") - F.col("start")) / F.col("duration"))), F.lit(0.0)).alias("duty"),
    )
    out = per.join(span, own)
    rate = lambda n: F.when(F.col("duration") > 0, F.col(n) / (F.col("duration") / 3600.0)).otherwise(0.0)
    recall = F.when(F.col("a0").isNotNull() & F.col("delay").isNotNull(), 1.0).otherwise(0.0)
    return out.select(*keys, "benign_events", "all_events", rate("benign_events").alias("false_events_per_hour"), rate("all_events").alias("events_per_hour"), recall.alias("recall"), (1 - recall).alias("miss"), F.coalesce("delay", F.lit(0.0)).alias("delay"), "duty")


def grid(steps: dict[str, tuple[float, ...]], spark) -> DataFrame:
    """All combinations of the parameters' values: a small table, by exploding arrays."""
    out = spark.range(1).select()
    for name, values in steps.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return out


def robustness(obs: DataFrame, steps: dict[str, tuple[float, ...]], keys: tuple[str, ...] = ("client_id",)) -> DataFrame:
    """event_metrics for every combination of dilation, merge, least and cooldown.

    Alerts alone meet the grid; durations, intervals and delays don't depend on it and are worked out once.
    """
    names, own = ["dilation", "merge", "least", "cooldown"], list(keys)
    alerts, span = _alerts_and_span(obs, own)
    for n in names:
        alerts = alerts.select("*", F.explode(F.array(*(F.lit(float(v)) for v in steps[n]))).alias(n))
    return _metrics(alerts, span, own, [*own, *names], tuple(F.col(n) for n in names))


def budget_rows(obs: DataFrame, budgets: tuple[float, ...], parameters: tuple[float, ...] = PARAMETERS) -> DataFrame:
    """(client_id, budget_per_hour, threshold, false_events_per_hour, recall, delay) for each budget of events an hour.

    Devices for which no threshold keeps the budget, or that have no event at theirs, have no row.
    """
    from fleetward.operators.event_budget import thresholds
    from fleetward.staging import staged

    out = None
    for budget in budgets:
        cut = staged(thresholds(obs, budget, parameters).where(F.col("threshold").isNotNull()), "event-thresholds")
        own = obs.drop("threshold").join(F.broadcast(cut), "client_id")
        one = event_metrics(own, parameters=parameters).join(cut, "client_id")
        one = one.select("client_id", F.lit(float(budget)).alias("budget_per_hour"), "threshold", "false_events_per_hour", "recall", "delay")
        out = one if out is None else out.unionByName(one)
    return out


def event_tables(obs: DataFrame, budgets: dict[str, float], steps: dict[str, tuple[float, ...]], per_hour: tuple[float, ...], parameters: tuple[float, ...] = PARAMETERS) -> dict[str, DataFrame]:
    """metrics, robustness, gini and budgets of a set of observations (client_id, label, t, score).

    budgets: rates by name; a device's threshold at a rate comes from its own benign scores, and devices without
    any are left out.
    """
    from fleetward.operators.calibrate import thresholds
    from fleetward.operators.evaluate import gini_by
    from fleetward.staging import staged

    benign = obs.where(F.col("label") == "benign").select("client_id", "score")
    rates = F.inline(F.array(*(F.struct(F.lit(k).alias("budget_id"), F.lit(float(v)).alias("target_rate")) for k, v in budgets.items())))
    cut = staged(thresholds(benign, benign.select("client_id").distinct().select("client_id", rates)).select("client_id", "budget_id", "threshold"), "thresholds")
    own = obs.drop("threshold").join(F.broadcast(cut), "client_id")
    keys = ("client_id", "budget_id")
    metrics = event_metrics(own, keys, parameters)
    return {"metrics": metrics, "robustness": robustness(own, steps, keys), "gini": gini_by(metrics, "benign_events", ["budget_id"]), "budgets": budget_rows(obs, per_hour, parameters)}


def in_intervals(points: DataFrame, intervals: DataFrame, keys: tuple[str, ...] = ("client_id",), how: str = "inner", width: float | None = None) -> DataFrame:
    """Joins intervals (keys, start, end, ...) with points (keys, t, ...) that they hold, ends included, by range bins.

    An interval's level is how often width must be doubled to be no less than its length, so it reaches into two
    bins of its level at the most; a point has one bin at each level that some interval has. Points meet the
    intervals of their bins alone, and long intervals cost no more rows than short ones. width: the least bin
    (unset: the median length). how: inner, left_semi (of intervals) or left_anti. Intervals whose end is before
    their start hold nothing; null bounds or times neither. Columns of points but the keys are to have other names
    than those of intervals.
    """
    length = F.col("end") - F.col("start")
    if width is None:
        width = intervals.where(length > 0).agg(F.percentile_approx(length, 0.5)).first()[0] or 1.0
    size = lambda level: F.lit(float(width)) * F.pow(F.lit(2.0), level)
    level = F.when(length <= width, 0).otherwise(F.ceil(F.log2(length / F.lit(float(width))))).cast("int")
    binned = intervals.withColumn("__level", level).withColumn("__ends", F.array_distinct(F.array(F.floor(F.col("start") / size(F.col("__level"))).cast("long"), F.floor(F.col("end") / size(F.col("__level"))).cast("long"))))
    # Rounding at a power of two may leave three bins: all between the ends.
    bins = F.sequence(F.element_at("__ends", 1), F.element_at("__ends", -1))
    binned = binned.where(length >= 0).withColumn("__bin", F.explode(bins)).drop("__ends")
    levels = sorted(r["__level"] for r in binned.select("__level").distinct().collect())
    own = points.select(*(F.col(k).alias(f"__{k}") for k in keys), *(F.col(c) for c in points.columns if c not in keys))
    own = own.where(F.col("t").isNotNull()).withColumn("__at", F.explode(F.array(*(F.lit(k) for k in levels)) if levels else F.array().cast("array<int>"))).withColumn("__place", F.floor(F.col("t") / size(F.col("__at"))).cast("long"))
    same = (F.col("__level") == F.col("__at")) & (F.col("__bin") == F.col("__place"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"__{k}"))
    held = same & F.col("t").between(F.col("start"), F.col("end"))
    inner = [f"__{k}" for k in keys]
    if how == "inner":
        return binned.join(own, held).drop("__level", "__bin", "__at", "__place", *inner)
    # An interval stands in two bins at most: once is enough.
    numbered = binned.withColumn("__row", F.struct(*intervals.columns))
    found = numbered.join(own, held, "left_semi").select("__row").distinct()
    same_row = intervals.withColumn("__row", F.struct(*intervals.columns))
    return same_row.join(found.withColumnRenamed("__row", "__found"), F.col("__row").eqNullSafe(F.col("__found")), how).drop("__row", "__found")


def detected_intervals(intervals: DataFrame, alerts: DataFrame, keys: tuple[str, ...] = ("client_id",)) -> DataFrame:
    """intervals (keys, start, end, ...) that hold an alert (keys, t) of theirs, ends included."""
    return in_intervals(alerts.select(*keys, "t"), intervals, keys, "left_semi")


def steps_back(rows: DataFrame, keys: list[str], order: str, slices: int = 256) -> DataFrame:
    """rows (keys, order, t) with d: t less that of the row before, in order within keys; null for the first.

    A group's order is cut into slices at its quantiles. Rows look back within their slice, and a slice's first row
    takes the last of the slice before, from a table of one row a slice.
    """
    from fleetward.operators.ranking import _celled, _same

    held = _celled(rows, keys, order, slices)
    own = [*keys, "__cell"]
    ends = held.groupBy(*own).agg(F.max_by("t", order).alias("__last"))
    before = ends.select(*own, F.lag("__last").over(Window.partitionBy(*keys).orderBy("__cell")).alias("__before"))
    out = held.join(before, on=_same(held, before, own), how="inner").drop(*(before[k] for k in own))
    w = Window.partitionBy(*own).orderBy(order)
    first = F.row_number().over(w) == 1
    return out.withColumn("d", F.col("t") - F.when(first, F.col("__before")).otherwise(F.lag("t").over(w))).drop("__cell", "__before")


def capture_audit(rows: DataFrame, seam: float) -> DataFrame:
    """(file, devices, parsed_share, associable, has_attack, out_of_order, separable, duration).

    rows: file, client_id (null or blank: no device), t (null: not parsed), label, ordinal. Steps back in time of
    less than the seam count as out of order; longer ones are seams between captures.
    """
    dev = F.col("client_id").isNotNull() & (F.trim("client_id") != "")
    step = steps_back(rows.where(dev & F.col("t").isNotNull()), ["file", "client_id"], "ordinal")
    per = step.groupBy("file", "client_id").agg(F.count_if((F.col("d") < 0) & (F.col("d") > -seam)).alias("back"), F.count("d").alias("steps"))
    per = per.groupBy("file").agg(F.max(F.when(F.col("steps") > 0, F.col("back") / F.col("steps")).otherwise(0.0)).alias("out_of_order"))
    attack = F.col("label") != "benign"
    a0, a1 = F.min(F.when(attack, F.col("t"))), F.max(F.when(attack, F.col("t")))
    b0, b1 = F.min(F.when(~attack, F.col("t"))), F.max(F.when(~attack, F.col("t")))
    out = rows.groupBy("file").agg(
        F.count_distinct(F.when(dev, F.col("client_id"))).alias("devices"), F.avg(F.col("t").isNotNull().cast("double")).alias("parsed_share"), F.avg(dev.cast("double")).alias("associable"),
        F.max(attack).alias("has_attack"), F.coalesce((b0 < a0) | (b1 > a1), F.lit(True)).alias("separable"), (F.max("t") - F.min("t")).alias("duration"),
    )
    return out.join(per, "file", "left").withColumn("out_of_order", F.coalesce("out_of_order", F.lit(0.0)))
