"""CSV collections of device captures."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetward.functions.text import attack_name, capture_time, device_name, epoch_seconds, is_device, label_subtype, number
from fleetward.staging import measured, staged

#: Bytes in memory of a block's row of counts, and of a file's row with its header.
BLOCK_ROW, FILE_ROW = 512, 8192


class Scan(NamedTuple):
    """Captures read once: (file, at, line), and one row a file with (file, names) and what else is known of files."""

    lines: DataFrame
    files: DataFrame


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names only; no rows are read."""
    return spark.read.option("header", True).csv(path).columns


def capture_files(spark: SparkSession, path: str | list[str], limit: int | None = None) -> list[str]:
    """Paths of the CSV captures below path, sorted; the first so many. No content is read."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").format("binaryFile").load(path).select("path").orderBy("path")
    return [r["path"] for r in (files.limit(limit) if limit is not None else files).collect()]


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, at, line): each line of the CSV captures below path and its place in its file, from 0.

    Spark deals a file out in blocks. Lines are staged with a number that rises by one within their block, and the
    blocks' counts, one row each, give every block its first place; so a file of any size is spread over its blocks,
    and no line is sorted or moved.
    """
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(path)
    lines = staged(text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"), F.col("value").alias("line")), "lines")
    before = Window.partitionBy("file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    counts = lines.groupBy("file", "__block").agg(F.count("*").alias("__n"), F.min("__id").alias("__least"))
    counts = counts.select("file", "__block", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__least")).alias("__before"))
    out = lines.join(measured(counts, "blocks", BLOCK_ROW), ["file", "__block"])
    return out.select("file", (F.col("__before") + F.col("__id")).cast("long").alias("at"), "line")


def _fields(line: Column) -> Column:
    """A line's cells; without any quotes it is only split."""
    found = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(',("[^"]*"|[^,]*)'))
    return F.when(F.contains(line, F.lit('"')), F.transform(found, lambda x: F.regexp_replace(x, '^"|"$', ""))).otherwise(F.split(line, ","))


def _names(lines: DataFrame) -> DataFrame:
    """(file, names): each capture's header, one row a file."""
    return lines.where(F.col("at") == 0).select("file", _fields(F.col("line")).alias("names"))


def headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, names): each capture's header, the first line of its first block."""
    return _names(numbered_lines(spark, path))


def scan(spark: SparkSession, path: str | list[str], known: Callable[[DataFrame], DataFrame] = lambda files: files) -> Scan:
    """The captures below path, for any number of passes. known: from the files (file, names) to those wanted, with more columns."""
    lines = numbered_lines(spark, path)
    # Staged before, since what is asked of files would be asked of each of their lines.
    return Scan(lines, measured(known(staged(_names(lines), "headers")), "files", FILE_ROW))


def _values(columns: list[str] | None) -> Column:
    """The cells of a line by their names, the given columns (__keep, __keys) or all; a blank cell is null, one that the line lacks too."""
    cells = _fields(F.col("line"))
    if columns is not None:
        cells = F.filter(cells, lambda x, k: F.get("__keep", k))
    n = F.size("__keys")
    cells = F.transform(cells, lambda x: F.when(F.trim(x) != "", x))
    return F.map_from_arrays("__keys", F.slice(F.concat(cells, F.array_repeat(F.lit(None).cast("string"), n)), 1, n))


def loose_rows(spark: SparkSession, path: str | list[str], columns: list[str] | None = None, read: Scan | None = None) -> DataFrame:
    """file and values, as typed_rows() without the rows' numbers."""
    return typed_rows(spark, path, columns=columns, read=read).drop("source_row")


def typed_rows(spark: SparkSession, path: str | list[str], row_limit: int | None = None, columns: list[str] | None = None, read: Scan | None = None) -> DataFrame:
    """file, source_row (from 0, without the header) and values, a map of column name to text; what else read knows of files.

    Headers may differ between captures; a header is one row a file and meets its file's lines in a join. A blank
    cell is null. row_limit: rows of each file. columns: those to keep (unset: all). Quoted cells may hold commas,
    but no line breaks. read: what scan() of path gave (unset: it is read now).
    """
    read = read or scan(spark, path)
    rows = read.lines.where((F.col("at") > 0) & (F.trim("line") != ""))
    if row_limit is not None:
        rows = rows.where(F.col("at") <= row_limit)
    more = [c for c in read.files.columns if c not in ("file", "names")]
    kept = F.transform("names", lambda x: F.lit(True) if columns is None else x.isin(columns))
    keys = F.col("names") if columns is None else F.filter("names", lambda x: x.isin(columns))
    files = read.files.select("file", *more, keys.alias("__keys"), kept.alias("__keep"))
    # Behind the generator, filters on values do not take a line apart again for each of their uses.
    return rows.join(files, "file").select("file", (F.col("at") - 1).cast("long").alias("source_row"), *more, F.explode_outer(F.array(_values(columns))).alias("values"))


def feature_columns(columns: list[str], layout: list[str], excluded: list[str] = ()) -> list[str]:
    """The columns that are features, in their order."""
    gone = {*layout, *excluded}
    return [c for c in columns if c not in gone]


def same_features(spark: SparkSession, files: list[str], layout: list[str], excluded: list[str] = ()) -> list[str]:
    """The feature columns that all captures have, by their headers; an error if one lacks a layout column or differs."""
    first: list[str] | None = None
    for path in files:
        columns = header(spark, path)
        missing = [c for c in layout if c not in columns]
        if missing:
            raise ValueError(f"{path} lacks the columns {missing}")
        own = feature_columns(columns, layout, excluded)
        if not own:
            raise ValueError(f"{path} has no feature columns")
        if first is not None and own != first:
            raise ValueError(f"{path} has the feature columns {own}, others {first}")
        first = own
    if first is None:
        raise ValueError("no captures")
    return first


def _finite(x: Column) -> Column:
    return F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def timed_features(rows: DataFrame, features: list[str], device: str = "eth.src", label: str = "label") -> DataFrame:
    """(client_id, source_file, source_row, label, attack_subtype, x) of timed captures with all features finite.

    A blank cell is 0; a row with a cell that is no finite number, or without a device, goes; others keep their row
    numbers.
    """
    get = lambda c: F.col("values")[c]
    attack = F.lower(F.trim(get(label))) != "benign"
    x = F.array(*(number(F.coalesce(get(f), F.lit("0"))) for f in features))
    out = rows.select(
        F.trim(get(device)).alias("client_id"), F.element_at(F.split("file", "/"), -1).alias("source_file"), "source_row", F.when(attack, "attack").otherwise("benign").alias("label"),
        F.when(attack, label_subtype(get(label))).alias("attack_subtype"), x.alias("x"),
    )
    return out.where(F.col("client_id").isNotNull() & (F.col("client_id") != "") & _finite(F.col("x")))


def trainable(rows: DataFrame, train: float = 0.5) -> DataFrame:
    """(client_id, n_train): clients whose benign rows leave some to train on, floor(train x benign) > 0."""
    n = F.floor(F.lit(float(train)) * F.count_if(F.col("label") == "benign").cast("double"))
    return rows.groupBy("client_id").agg(n.alias("n_train")).where(F.col("n_train") > 0)


#: The file of benign rows, and the folders and files of attacks with their subtypes.
BENIGN_FILE = "benign_traffic.csv"
FAMILIES = {
    "gafgyt_attacks": {f"{k}.csv": f"bashlite_{k}" for k in ("combo", "junk", "scan", "tcp", "udp")},
    "mirai_attacks": {f"{k}.csv": f"mirai_{k}" for k in ("ack", "scan", "syn", "udp", "udpplain")},
}


def device_tree(spark: SparkSession, root: str, benign_file: str = BENIGN_FILE, families: dict[str, dict[str, str]] = FAMILIES, clients: dict[str, str] | None = None) -> DataFrame:
    """(client_id, label, attack_subtype, source_file, source_row, x) from <root>/<device>/... of numeric captures.

    <device>/<benign_file> is benign, <device>/<family>/<file> an attack of the family's table; other files are left
    out, missing families and files are no error, a device without its benign file is one. clients: folders to read
    and their ids (unset: all, by their own names). x: the row's numbers in the order of the header; a cell that is
    no finite number is an error.
    """
    rows = typed_rows(spark, root)
    depth = len([p for p in root.split("://")[-1].split("/") if p])
    parts = F.filter(F.split(F.regexp_replace(F.regexp_replace("file", "^[a-z]+:/+", ""), "%20", " "), "/"), lambda p: p != "")
    inner = F.slice(parts, depth + 1, 10)
    device, one, two = (F.get(inner, F.lit(k)) for k in range(3))
    name = F.concat_ws("/", F.slice(inner, 2, 10))
    kinds = F.create_map(*(F.lit(x) for folder, files in families.items() for file, subtype in files.items() for x in (f"{folder}/{file}", subtype)))
    subtype = F.when(F.size(inner) == 3, F.try_element_at(kinds, F.concat_ws("/", one, two)))
    benign = (F.size(inner) == 2) & (one == benign_file)
    out = rows.select(device.alias("client_id"), F.when(benign, "benign").when(subtype.isNotNull(), "attack").alias("label"), subtype.alias("attack_subtype"), name.alias("source_file"), "source_row", "values")
    out = out.where(F.col("label").isNotNull())
    if clients is not None:
        ids = F.create_map(*(F.lit(x) for pair in clients.items() for x in pair))
        out = out.withColumn("client_id", F.try_element_at(ids, F.col("client_id"))).where(F.col("client_id").isNotNull())
    lacking = out.groupBy("client_id").agg(F.count_if(F.col("label") == "benign").alias("n")).where(F.col("n") == 0).first()
    have = {r["client_id"] for r in out.select("client_id").distinct().collect()}
    missing = sorted(({*clients.values()} if clients else set()) - have) + ([lacking["client_id"]] if lacking else [])
    if missing:
        raise ValueError(f"no {benign_file} for {missing}")
    x = F.transform(F.map_values("values"), number)
    told = F.when(_finite(x), x).otherwise(F.raise_error(F.concat(F.lit("no finite number in row "), F.col("source_row").cast("string"), F.lit(" of "), F.col("source_file"))).cast("array<double>"))
    return out.select("client_id", "label", "attack_subtype", "source_file", "source_row", told.alias("x"))


def dropped_rows(packets: DataFrame) -> DataFrame:
    """(client_id, kept, dropped) of packet_rows(): rows that are complete, and rows that are not."""
    return packets.groupBy("client_id").agg(F.count_if("complete").alias("kept"), F.count_if(~F.col("complete")).alias("dropped"))


def eligible_rows(packets: DataFrame, eligible: DataFrame) -> DataFrame:
    """The complete rows of eligible clients; an error if there are none of either."""
    from fleetward.operators.checks import require_rows

    require_rows(eligible, "eligible clients")
    return require_rows(packets.where("complete").join(eligible.select("client_id").distinct(), "client_id", "left_semi"), "rows of eligible clients")


def flow_gate(columns: list[str], identity: list[str] = ("src_mac", "dst_mac", "src_ip", "dst_ip"), time: list[str] = ("timestamp", "ts", "frame.time", "time")) -> dict[str, bool]:
    """What the header of a flow capture lets one tell: devices, times, and so order, attack intervals and durations."""
    low = {c.strip().lower() for c in columns}
    known, timed = bool(low & {*identity}), bool(low & {*time})
    return {"devices_known": known, "time_parsed": timed, "ordered": known and timed, "separable": timed, "lasting": timed, "passed": known and timed}


def classify(df: DataFrame, root: str, benign: str) -> DataFrame:
    """Adds label and attack_subtype from the path: <benign>/x.csv, or <category>/<subtype>/x.csv; others go."""
    path = F.regexp_replace(F.regexp_replace("file", "^file:/+", "/"), "%20", " ")
    parts = F.split(F.substring(path, len(root.rstrip("/")) + 2, 1 << 20), "/")
    is_benign = (F.size(parts) == 2) & (F.get(parts, F.lit(0)) == benign)
    is_attack = (F.size(parts) == 3) & (F.get(parts, F.lit(0)) != benign)
    out = df.withColumns({"label": F.when(is_benign, "benign").when(is_attack, "attack"), "attack_subtype": F.when(is_attack, attack_name(F.get(parts, F.lit(1))))})
    return out.where(F.col("label").isNotNull())


def feature_manifest(rows: DataFrame, excluded: list[str], threshold: float) -> DataFrame:
    """(column, rows, numeric, share): columns of which at least threshold of the cells are numbers, over files that have them."""
    cells = rows.select(F.explode("values").alias("column", "value")).where(~F.col("column").isin(excluded))
    out = cells.groupBy("column").agg(F.count("*").alias("rows"), F.count(number(F.col("value"))).alias("numeric"))
    return out.withColumn("share", F.col("numeric") / F.col("rows")).where(F.col("share") >= threshold)


def packet_rows(rows: DataFrame, device: str, target: str, features: list[str]) -> DataFrame:
    """(client_id, label, attack_subtype, file, source_row, x, complete): benign rows by device, attack rows by target.

    x: the features as numbers. complete: none is missing. Attack rows to destinations that are no device go.
    """
    mac = F.when(F.col("label") == "benign", F.col("values")[device]).otherwise(F.col("values")[target])
    out = rows.where((F.col("label") == "benign") | is_device(F.lower(F.trim(mac)))).where(mac.isNotNull())
    x = F.array(*(number(F.col("values")[f]) for f in features))
    out = out.select(device_name(mac).alias("client_id"), "label", "attack_subtype", "file", "source_row", x.alias("x"))
    return out.withColumn("complete", F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))


def timed_rows(rows: DataFrame, device: str = "eth.src", label: str = "label", time: str = "frame.time") -> DataFrame:
    """(file, source_row, client_id, t, label, attack_subtype) of timed captures; null where device or time is unreadable."""
    get = lambda c: F.col("values")[c]
    attack = F.lower(F.trim(get(label))) != "benign"
    return rows.select("file", F.col("source_row").alias("ordinal"), device_name(get(device)).alias("client_id"), epoch_seconds(capture_time(get(time))).alias("t"), F.when(attack, "attack").otherwise("benign").alias("label"), F.when(attack, label_subtype(get(label))).alias("attack_subtype"))


def census(rows: DataFrame) -> DataFrame:
    """(client_id, benign, attack, subtypes): rows of each device; 0 benign where it has none."""
    by = rows.groupBy("client_id", "label", "attack_subtype").agg(F.count("*").alias("n"))
    attack = F.col("label") == "attack"
    return by.groupBy("client_id").agg(
        F.sum(F.when(~attack, F.col("n")).otherwise(0)).alias("benign"), F.sum(F.when(attack, F.col("n")).otherwise(0)).alias("attack"), F.count_if(attack).alias("subtypes"),
    )


def qualifying(counts: DataFrame, benign: int, attack: int) -> Column:
    return (F.col("benign") >= benign) & (F.col("attack") >= attack)


def evidence_level(counts: DataFrame, benign: int, attack: int, devices: int) -> DataFrame:
    """One row: qualifying devices, and CONFIRMATORY if there are enough of them, else SUPPORTIVE."""
    out = counts.agg(F.count_if(qualifying(counts, benign, attack)).alias("devices"))
    return out.select("devices", F.when(F.col("devices") >= devices, "CONFIRMATORY").otherwise("SUPPORTIVE").alias("level"))


def gate(audit: DataFrame, parsed: float = 1.0, out_of_order: float = 0.0) -> DataFrame:
    """One row: the provenance criteria of timed captures as booleans, and status PASS if all hold; no captures: FAIL."""
    out = audit.agg(
        F.coalesce(F.min("parsed_share") >= parsed, F.lit(False)).alias("time_parsed"), F.coalesce(F.min("associable") >= 1.0, F.lit(False)).alias("devices_known"),
        F.coalesce(F.max("has_attack"), F.lit(False)).alias("attacks_labelled"), F.coalesce(F.max("out_of_order") <= out_of_order, F.lit(False)).alias("ordered"),
        F.coalesce(F.min("separable"), F.lit(False)).alias("separable"), F.coalesce(F.min("duration") > 0, F.lit(False)).alias("lasting"),
    )
    every = F.lit(True)
    for c in out.columns:
        every = every & F.col(c)
    return out.withColumn("status", F.when(every, "PASS").otherwise("FAIL"))
