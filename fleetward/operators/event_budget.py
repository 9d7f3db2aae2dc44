"""Thresholds for a budget of events an hour, for all devices at once.

A device's events at a threshold come from its alerts in time order: alerts no further apart
than a gap are a block, short blocks go, and a block that starts soon after the one before joins
it. What a stretch of time has of this is a summary of fixed size: its first and last block,
which may go on beyond its ends, and what lies between them. Summaries of neighbouring stretches
join, in any grouping, so rows are read where they lie, sorted once, and only summaries meet.

The bisection of each device is sequential, but a pass answers several of its steps: the
thresholds that the next LEVELS steps may ask for are a binary tree, tried side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetward.operators.events import PARAMETERS
from fleetward.staging import staged

STEPS = 24
#: A table of thresholds is broadcast up to so many bytes.
BROADCAST_BYTES = 48 << 20
#: Steps that a pass over the rows answers.
LEVELS = 4
#: Summaries of one device and threshold that are joined together.
TOGETHER = 64

_SUMMARY = "first_start double, first_end double, last_start double, last_end double, blocks long, kept_start double, kept_end double, events long"


@dataclass
class Rule:
    """What makes alerts events: the greatest gap in a block, the least length of a block, the rest between events."""

    gap: float
    least: float
    cooldown: float


@dataclass
class Stretch:
    """A stretch of time: its number of blocks, the first and the last, and of the kept ones between them the start, the end and the events."""

    first_start: float
    first_end: float
    last_start: float
    last_end: float
    blocks: int
    kept_start: float | None = None
    kept_end: float | None = None
    events: int = 0


def summary(t: np.ndarray, rule: Rule) -> Stretch | None:
    """Of alerts in time order; None where there are none."""
    if not len(t):
        return None
    cut = np.flatnonzero(np.diff(t) > rule.gap)
    start, end = t[np.r_[0, cut + 1]], t[np.r_[cut, len(t) - 1]]
    out = Stretch(float(start[0]), float(end[0]), float(start[-1]), float(end[-1]), len(start))
    a, b = start[1:-1], end[1:-1]
    ok = b - a >= rule.least
    a, b = a[ok], b[ok]
    if len(a):
        out.kept_start, out.kept_end, out.events = float(a[0]), float(b[-1]), 1 + int((a[1:] - b[:-1] >= rule.cooldown).sum())
    return out


def _then(x: tuple, start: float, end: float, rule: Rule) -> tuple:
    """Kept blocks (start, end, events) and, behind them, one more block, kept if it is long enough."""
    return x if end - start < rule.least else _chain(x, (start, end, 1), rule)


def _chain(x: tuple, y: tuple, rule: Rule) -> tuple:
    if not x[2] or not y[2]:
        return y if not x[2] else x
    return x[0], y[1], x[2] + y[2] - (y[0] - x[1] < rule.cooldown)


def join(a: Stretch | None, b: Stretch | None, rule: Rule) -> Stretch | None:
    """Two stretches, a before b: a's last block and b's first are one if their gap allows."""
    if a is None or b is None:
        return a or b
    one = b.first_start - a.last_end <= rule.gap
    out = Stretch(a.first_start, a.first_end, b.last_start, b.last_end, a.blocks + b.blocks - one)
    kept = (a.kept_start, a.kept_end, a.events)
    if one:
        # The block across the border; it is the first or last of all if it was that on its side.
        start = a.last_start
        if a.blocks == 1:
            out.first_end = b.first_end
        if b.blocks == 1:
            out.last_start = start
        if a.blocks > 1 and b.blocks > 1:
            kept = _then(kept, start, b.first_end, rule)
    else:
        if a.blocks > 1:
            kept = _then(kept, a.last_start, a.last_end, rule)
        if b.blocks > 1:
            kept = _then(kept, b.first_start, b.first_end, rule)
    out.kept_start, out.kept_end, out.events = _chain(kept, (b.kept_start, b.kept_end, b.events), rule)
    return out


def events_of(x: Stretch | None, rule: Rule) -> int:
    """The events of a whole: with its first and last block."""
    if x is None:
        return 0
    kept = _then((None, None, 0), x.first_start, x.first_end, rule)
    kept = _chain(kept, (x.kept_start, x.kept_end, x.events), rule)
    return (_then(kept, x.last_start, x.last_end, rule) if x.blocks > 1 else kept)[2]


def _row(key: list, x: Stretch) -> list:
    return [*key, x.first_start, x.first_end, x.last_start, x.last_end, x.blocks, x.kept_start, x.kept_end, x.events]


_FIELDS = ["first_start", "first_end", "last_start", "last_end", "blocks", "kept_start", "kept_end", "events"]
_TYPES = [pa.float64()] * 4 + [pa.int64()] + [pa.float64()] * 2 + [pa.int64()]


def _frame(keys: list[tuple[str, pa.DataType]], rows: list[list]) -> pa.RecordBatch:
    names, types = [k for k, _ in keys] + _FIELDS, [t for _, t in keys] + _TYPES
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _summaries(rule: Rule):
    """Batches of rows (client_id, part, t, score, tries) in order of part and client to summaries of their runs."""
    keys = [("client_id", pa.string()), ("part", pa.int64()), ("at", pa.float64()), ("try", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            client, part = b.column("client_id").to_pylist(), b.column("part").to_numpy(zero_copy_only=False)
            t, score = (b.column(c).to_numpy(zero_copy_only=False) for c in ("t", "score"))
            tries, out, at = b.column("tries"), [], 0
            while at < len(client):
                to = at + 1
                while to < len(client) and client[to] == client[at] and part[to] == part[at]:
                    to += 1
                for k, x in enumerate(tries[at].as_py() or []):
                    found = summary(t[at:to][score[at:to] > x], rule)
                    if found:
                        out.append(_row([client[at], int(part[at]), found.first_start, k], found))
                at = to
            if out:
                yield _frame(keys, out)

    return run


def _joined(rule: Rule, last: bool):
    """Rows of summaries of one device and try, as an array in time order, to one summary, or to its events."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for client, k, group, parts in zip(*(b.column(c).to_pylist() for c in ("client_id", "try", "group", "parts")), strict=True):
                whole = None
                for p in parts:
                    whole = join(whole, Stretch(*(p[f] for f in _FIELDS)), rule)
                rows.append([client, k, events_of(whole, rule)] if last else _row([client, k, group], whole))
            if rows and last:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int64()), strict=True)], names=["client_id", "try", "events"])
            elif rows:
                yield _frame([("client_id", pa.string()), ("try", pa.int32()), ("nr", pa.int64())], rows)

    return run


def _by_time(rows: DataFrame) -> DataFrame:
    """rows dealt out by ranges of (device, time), in order, with the range's number as part."""
    return rows.repartitionByRange("client_id", "t").sortWithinPartitions("client_id", "t").withColumn("part", F.spark_partition_id().cast("long"))


def _counts(rows: DataFrame, tries: DataFrame, rule: Rule, devices: int) -> DataFrame:
    """(client_id, try, events) of sorted rows at each device's thresholds (client_id, tries).

    The thresholds are broadcast, which keeps the rows in order, if they fit; else they are joined and rows dealt anew.
    """
    met = rows.join(F.broadcast(tries), "client_id") if devices * (100 + (8 << LEVELS)) <= BROADCAST_BYTES else _by_time(rows.drop("part").join(tries.hint("shuffle_hash"), "client_id"))
    parts = met.mapInArrow(_summaries(rule), f"client_id string, part long, at double, try int, {_SUMMARY}")
    parts = parts.withColumn("nr", (F.row_number().over(Window.partitionBy("client_id", "try").orderBy("part", "at", "last_end")) - 1).cast("long"))
    found = staged(parts.drop("part", "at"), "stretches")
    # As many rounds as the logarithm of a device's summaries: none holds more than TOGETHER of them in a row.
    most = (found.agg(F.max("nr")).first()[0] or 0) + 1
    while True:
        last = most <= TOGETHER
        group = found.withColumn("group", F.floor(F.col("nr") / TOGETHER).cast("long"))
        arrays = group.groupBy("client_id", "try", "group").agg(F.transform(F.array_sort(F.collect_list(F.struct("nr", *_FIELDS))), lambda x: F.struct(*(x[f].alias(f) for f in _FIELDS))).alias("parts"))
        if last:
            return arrays.mapInArrow(_joined(rule, True), "client_id string, try int, events long")
        found = staged(arrays.mapInArrow(_joined(rule, False), f"client_id string, try int, nr long, {_SUMMARY}"), "stretches")
        most = -(-most // TOGETHER)


def _tree(low: float, high: float, levels: int) -> list[float]:
    """The middles that so many steps of bisection may ask for, level by level: the children of k are 2k + 1 and 2k + 2."""
    spans, out = [(low, high)], []
    for _ in range(levels):
        out += [(a + b) / 2.0 for a, b in spans]
        spans = [s for a, b in spans for s in ((a, (a + b) / 2.0), ((a + b) / 2.0, b))]
    return out


def thresholds(obs: DataFrame, per_hour: float, parameters: tuple[float, ...] = PARAMETERS, steps: int = STEPS) -> DataFrame:
    """(client_id, threshold): bisection on [least, greatest] benign score for at most per_hour events an hour.

    obs: client_id, label, t, score. The rate is not monotone in the threshold, so the result is that of the
    procedure: 24 halvings, the upper end. Null where even that has too many, or where a device's rows span no time.
    Devices without benign rows have no row. Benign rows are dealt out by ranges of (device, time) once; the driver
    holds four numbers a device.
    """
    spark = obs.sparkSession
    rule = Rule(max(parameters[0], parameters[1]), parameters[2], parameters[3])
    benign = obs.where((F.col("label") == "benign") & F.col("score").isNotNull() & F.col("t").isNotNull()).select("client_id", F.col("t").cast("double").alias("t"), F.col("score").cast("double").alias("score"))
    rows = staged(_by_time(benign), "benign-by-time")
    span = obs.groupBy("client_id").agg(((F.max("t") - F.min("t")) / 3600.0).alias("hours"))
    ends = rows.groupBy("client_id").agg(F.min("score").alias("low"), F.max("score").alias("high")).join(span, "client_id").collect()
    state = {r["client_id"]: [r["low"], r["high"], r["hours"]] for r in ends}
    open_ = {c for c, (low, high, hours) in state.items() if hours > 0 and low != high}
    done = {c: (low if hours > 0 else None) for c, (low, _, hours) in state.items() if c not in open_}

    def events_at(asked: dict[str, list[float]]) -> dict[tuple[str, int], int]:
        table = spark.createDataFrame([(c, x) for c, x in asked.items()], "client_id string, tries array<double>")
        return {(r["client_id"], r["try"]): r["events"] for r in _counts(rows, table, rule, len(asked)).collect()}

    left = steps
    while open_ and left > 0:
        levels = min(LEVELS, left)
        trees = {c: _tree(state[c][0], state[c][1], levels) for c in open_}
        got = events_at(trees)
        for c in open_:
            k = 0
            for _ in range(levels):
                mid, fits = trees[c][k], got.get((c, k), 0) / state[c][2] <= per_hour
                # Low enough: the upper end comes down; else the lower one goes up.
                state[c][1 if fits else 0] = mid
                k = 2 * k + (1 if fits else 2)
        left -= levels
    if open_:
        got = events_at({c: [state[c][1]] for c in open_})
        done.update({c: state[c][1] if got.get((c, 0), 0) / state[c][2] <= per_hour else None for c in open_})
    return spark.createDataFrame(sorted(done.items()), "client_id string, threshold double")
