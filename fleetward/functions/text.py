"""Normalising device names, attack labels and capture times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Destinations that are no device.
NO_DEVICE = ["00:00:00:00:00:00", "01:80:c2:00:00:00", "01:80:c2:00:00:03", "ff:ff:ff:ff:ff:ff"]
NO_DEVICE_PREFIXES = ("33:33:", "01:00:5e:")


def strip(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "^\\s+", ""), "\\s+$", "")


def device_name(c: Column) -> Column:
    """Trimmed, lower case, runs of other characters as one underscore."""
    return F.regexp_replace(F.lower(strip(c)), "[^a-z0-9._: -]+", "_")


def attack_name(c: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def label_subtype(c: Column) -> Column:
    """Attack label to subtype; null where it has no valid form."""
    out = F.translate(F.lower(strip(c)), "& ", "--")
    return F.when(out.rlike("^[a-z0-9][a-z0-9._-]*$"), out)


def is_device(mac: Column) -> Column:
    out = ~mac.isin(NO_DEVICE)
    for prefix in NO_DEVICE_PREFIXES:
        out = out & ~mac.startswith(prefix)
    return out


def capture_time(c: Column) -> Column:
    """'Jan 01, 2020 00:00:00.000000000 GMT' to a timestamp (microseconds); null if it cannot be read."""
    bare = F.regexp_replace(F.regexp_replace(strip(c), " GMT$", ""), "(\\.[0-9]{6})[0-9]+$", "$1")
    return F.try_to_timestamp(F.regexp_replace(bare, " +", " "), F.lit("MMM d, yyyy HH:mm:ss[.SSSSSS]"))


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(ts) / F.lit(1e6)


def number(c: Column) -> Column:
    """Plain decimal notation to double; anything else to null."""
    return F.when(c.rlike("^\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*$"), c.try_cast("double"))
