"""Alert sessions of an unbounded stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def alert_sessions(alerts: DataFrame, gap_seconds: int, watermark_seconds: int, least_seconds: float = 0.0) -> DataFrame:
    """alerts (client_id, ts) to (client_id, start, end, alarms): alerts no further apart than the gap are one session.

    Works on batches and on streams; on a stream a session comes out once the watermark has passed its end and gap.
    State is bounded by the open sessions of each device. Late alerts, older than the watermark, are dropped.
    """
    held = alerts.withWatermark("ts", f"{watermark_seconds} seconds") if alerts.isStreaming else alerts
    out = held.groupBy("client_id", F.session_window("ts", f"{gap_seconds} seconds")).agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("alarms"))
    return out.where(F.unix_micros("end") - F.unix_micros("start") >= F.lit(int(least_seconds * 1e6))).select("client_id", "start", "end", "alarms")
