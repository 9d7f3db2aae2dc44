"""Replication on a collection of packet captures that was made elsewhere.

Captures lie at <root>/<benign>/<file>.csv and <root>/<category>/<subtype>/<file>.csv and need
not have the same columns. Their lines are read and numbered once, files are classified one by one,
and lines are taken apart three times, each time for less: devices and labels for the census, which
decides whether to go on; all columns for the manifest of those that are numbers; and then the
columns of the manifest alone, with the rows' places, for the features.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetward.functions.text import device_name, is_device
from fleetward.operators import frontier, infer, policies
from fleetward.sources import captures, timed
from fleetward.sources.tables import persist_run
from fleetward.staging import released, staged


def scanned(spark: SparkSession, root: str, benign: str) -> captures.Scan:
    """The captures below root, their files with label and attack_subtype."""
    return captures.scan(spark, root, lambda files: captures.classify(files, root, benign))


def device_labels(rows: DataFrame, device: str, target: str) -> DataFrame:
    """(client_id, label, attack_subtype) of classified rows: benign ones by device, attacks by target, where that is a device."""
    mac = F.when(F.col("label") == "benign", F.col("values")[device]).otherwise(F.col("values")[target])
    kept = rows.where(mac.isNotNull() & ((F.col("label") == "benign") | is_device(F.lower(F.trim(mac)))))
    return kept.select(device_name(mac).alias("client_id"), "label", "attack_subtype")


def assess(spark: SparkSession, root: str, benign: str, device: str, target: str, min_benign: int, min_attack: int, min_devices: int, read: captures.Scan | None = None) -> tuple[DataFrame, dict[str, Any]]:
    """The census of all devices, and devices (that qualify) and level, CONFIRMATORY or SUPPORTIVE."""
    rows = captures.loose_rows(spark, root, [device, target], read or scanned(spark, root, benign))
    counts = staged(captures.census(device_labels(rows, device, target)), "census")
    level = captures.evidence_level(counts, min_benign, min_attack, min_devices).first()
    return counts, {"devices": level["devices"], "level": level["level"]}


def manifest(spark: SparkSession, root: str, benign: str, excluded: list[str], threshold: float, read: captures.Scan | None = None) -> list[str]:
    """The columns of which, over all captures that have them, enough cells are numbers, by name; none is an error."""
    rows = captures.loose_rows(spark, root, read=read or scanned(spark, root, benign))
    names = sorted(r["column"] for r in captures.feature_manifest(rows, excluded, threshold).collect())
    if not names:
        raise ValueError(f"no column of the captures below {root} holds numbers")
    return names


def federation(spark: SparkSession, root: str, benign: str, device: str, target: str, columns: list[str], eligible: DataFrame, read: captures.Scan | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of eligible devices with all features, as timed.materialise() takes them, and (client_id, kept, dropped).

    Of each line only the chosen columns and the two of devices are kept. Order is by capture path, then row.
    """
    wanted = list(dict.fromkeys([*columns, device, target]))
    rows = captures.typed_rows(spark, root, columns=wanted, read=read or scanned(spark, root, benign))
    packets = staged(captures.packet_rows(rows, device, target, columns), "packets")
    own = captures.eligible_rows(packets, eligible)
    return own.select("client_id", F.col("file").alias("source_file"), "source_row", "label", "attack_subtype", "x"), captures.dropped_rows(packets)


def replicate(
    spark: SparkSession, root: str, path: str, model: timed.Model, budgets: dict[str, float], seeds: list[int], dataset: str = "external", benign: str = "Benign", device: str = "src_mac", target: str = "dst_mac",
    excluded: list[str] | None = None, parsed: float = 0.99, min_benign: int = 100, min_attack: int = 100, min_devices: int = 3, grid: tuple[float, ...] | None = None, min_client: int = 100, min_rows: int = 50, max_fallback: float = 0.5,
) -> dict[str, Any]:
    """The whole replication; what it came to: devices, level and, if that is CONFIRMATORY, columns, dropped, seeds, worst_fallback, supportive.

    Scores go below path by seed, the run's tables below path/run by seed and budget; all of them in commits, and
    seeds that are there are reused. Evidence that is SUPPORTIVE ends the run after the census. supportive: more
    devices than max_fallback took the fallback rate at some seed and budget.
    """
    with released(spark):
        read = scanned(spark, root, benign)
        counts, out = assess(spark, root, benign, device, target, min_benign, min_attack, min_devices, read)
        if out["level"] != "CONFIRMATORY":
            return out
        eligible = counts.where(captures.qualifying(counts, min_benign, min_attack)).select("client_id")
        columns = manifest(spark, root, benign, [device, target, *(excluded or [])], parsed, read)
        rows, dropped = federation(spark, root, benign, device, target, columns, eligible, read)
        rows = staged(rows, "external-rows")
        lost = dropped.agg(F.sum("dropped").alias("n")).first()["n"] or 0
        done = timed.materialise(spark, rows, path, dataset, seeds, model)
        scores = None
        for seed in seeds:
            one = timed.scores_of(spark, path, dataset, seed).select("seed", "client_id", "label", "attack_subtype", "score", "split")
            scores = one if scores is None else scores.unionByName(one)
        weights = frontier.equal_weights(scores.select("client_id").distinct())
        run = policies.run_tables(scores, weights, budgets, grid, min_client, min_rows)
        persist_run(run["results"], run["evaluations"], run["allocations"], f"{path}/run")
        shares = run["allocations"].where(F.col("policy") == "macro").groupBy("seed", "budget_id").agg(F.avg((F.col("status") == "FALLBACK").cast("double")).alias("fallback_share"))
        worst = infer.worst_fallback(shares, max_fallback).first()
        return {**out, "columns": columns, "dropped": int(lost), "seeds": done, "worst_fallback": worst["worst"], "supportive": worst["warning"]}
