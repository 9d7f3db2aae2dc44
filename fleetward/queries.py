"""Registered queries of the fleet operators, each with the same in DuckDB's SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetward.functions import text
from fleetward.operators import event_budget as event_budget_
from fleetward.operators import calibrate, checks, evaluate, events, frontier, generalization, incremental, infer, lookups, ordering, policies, reports, resampling, scoring, splits
from fleetward.sources import external, timed
from fleetward.sources.adapters import features, large_observations, observations
from fleetward.staging import new_path, staged

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

BUDGET = 0.02
GRID = frontier.GRID
SEED_BUDGETS = {"b1": 0.01, "b2": 0.02, "b3": 0.05}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded, infinities as null: what two engines can be held to."""
    return df.select(*(F.round(F.when(F.abs(c) < float("inf"), F.col(c)), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def r9(x: str, name: str) -> str:
    return f"round(CASE WHEN abs({x}) < 'infinity'::DOUBLE THEN {x} END, 9) AS {name}"


# --- the parts that the SQL texts share --------------------------------------------------------------------------

OBS = """obs AS (
  SELECT 'c' || (user_id % 5) AS client_id, CASE WHEN event_type IN ('error', 'purchase') THEN 'attack' ELSE 'benign' END AS label,
    CASE WHEN event_type IN ('error', 'purchase') THEN event_type END AS attack_subtype,
    value + CASE event_type WHEN 'error' THEN 100 + 50 * (user_id % 5) WHEN 'purchase' THEN 50 + 40 * (user_id % 5) ELSE 0 END AS score,
    event_id AS ordinal, epoch_us(ts) / 1e6 AS t, event_id % 3 AS seed FROM events)"""
BIG = """obs AS (
  SELECT 's' || (l_suppkey % 9) AS client_id, CASE WHEN l_returnflag = 'N' THEN 'benign' ELSE 'attack' END AS label,
    CASE WHEN l_returnflag <> 'N' THEN lower(l_returnflag || '_' || l_linestatus) END AS attack_subtype,
    l_extendedprice / 1000.0::DOUBLE + CASE WHEN l_returnflag = 'N' THEN 0 ELSE 20 + 8 * (l_suppkey % 9) END AS score FROM lineitem)"""


def split_sql(keys: str = "client_id") -> str:
    return f"""ix AS (
  SELECT *, row_number() OVER (PARTITION BY {keys}, label, attack_subtype ORDER BY ordinal) - 1 AS i,
    count(*) OVER (PARTITION BY {keys}, label, attack_subtype)::DOUBLE AS n FROM obs),
sp AS (
  SELECT * EXCLUDE (i, n), CASE WHEN label = 'benign' THEN CASE WHEN i < floor(0.5::DOUBLE * n) THEN 'benign_train'
      WHEN i < floor(0.7::DOUBLE * n) THEN 'benign_frontier' WHEN i < floor(0.8::DOUBLE * n) THEN 'benign_final_cal' ELSE 'benign_test' END
    ELSE CASE WHEN i < floor(0.2::DOUBLE * n) THEN 'attack_validation' ELSE 'attack_test' END END AS split FROM ix)"""


SPLIT = split_sql()


def theta_sql(name: str, rows: str, asked: str, keys: str = "client_id") -> str:
    """name(keys, target_rate, ..., n_cal, threshold): rows (keys, score), asked (keys, target_rate)."""
    same = " AND ".join(f"a.{k.strip()} = r.{k.strip()}" for k in keys.split(","))
    return f"""{name}_r AS (SELECT {keys}, score, row_number() OVER (PARTITION BY {keys} ORDER BY score) AS k FROM ({rows})),
{name}_n AS (SELECT {keys}, count(*) AS n FROM {name}_r GROUP BY {keys}),
{name} AS (
  SELECT a.*, coalesce(m.n, 0) AS n_cal, CASE WHEN a.target_rate <= 1e-12 OR m.n IS NULL OR ceil((m.n + 1)::DOUBLE * (1.0::DOUBLE - a.target_rate)) > m.n THEN 'infinity'::DOUBLE
    WHEN ceil((m.n + 1)::DOUBLE * (1.0::DOUBLE - a.target_rate)) < 1 THEN '-infinity'::DOUBLE ELSE r.score END AS threshold
  FROM ({asked}) a LEFT JOIN {name}_n m ON {same.replace('r.', 'm.')}
  LEFT JOIN {name}_r r ON {same} AND r.k = ceil((m.n + 1)::DOUBLE * (1.0::DOUBLE - a.target_rate)))"""


GRID_SQL = "grid AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {a!r}::DOUBLE)" for i, a in enumerate(GRID)) + ") g(grid_ix, target_rate))"
CLIENTS = "cl AS (SELECT DISTINCT client_id FROM obs)"
CURVE = ",\n".join(
    [
        OBS, SPLIT, CLIENTS, GRID_SQL,
        theta_sql("fr", "SELECT client_id, score FROM sp WHERE split = 'benign_frontier'", "SELECT client_id, grid_ix, target_rate FROM cl, grid"),
        "cf AS (SELECT f.client_id, f.grid_ix, f.target_rate, f.threshold, v.attack_subtype, count(*) FILTER (WHERE v.score > f.threshold) AS tp, count(*) FILTER (WHERE NOT v.score > f.threshold) AS fn"
        " FROM fr f JOIN sp v ON v.client_id = f.client_id AND v.split = 'attack_validation' GROUP BY ALL)",
        "ut AS (SELECT client_id, grid_ix, target_rate, avg(tp / (tp + fn)::DOUBLE) AS utility,"
        " sum((tp / (tp + fn)::DOUBLE) * (1 - tp / (tp + fn)::DOUBLE) / (tp + fn)) / pow(count(*), 2) AS utility_variance FROM cf WHERE tp + fn >= 50 GROUP BY ALL)",
    ]
)
WEIGHT = "w AS (SELECT client_id, count(*) / (sum(count(*)) OVER ())::DOUBLE AS weight FROM sp WHERE label = 'benign' GROUP BY client_id)"


def result_sql(asked: str, keys: str = "client_id", extra: str = "") -> str:
    """cal, res, pc: calibrated decisions, results by subtype, rows by client; asked (keys, extra, target_rate)."""
    by = keys + (f", {extra}" if extra else "")
    same = " AND ".join(f"c.{k.strip()} = s.{k.strip()}" for k in keys.split(","))
    also = " AND ".join(f"b.{k.strip()} = a.{k.strip()}" for k in by.split(","))
    own = ", ".join(f"c.{k.strip()}" for k in by.split(","))
    sel = ", ".join(f"a.{k.strip()}" for k in by.split(","))
    return ",\n".join(
        [
            theta_sql("cal", f"SELECT {keys}, score FROM sp WHERE split IN ('benign_frontier', 'benign_final_cal')", asked, keys),
            f"hits AS (SELECT {own}, c.target_rate, c.threshold, c.n_cal, s.label, s.attack_subtype, count(*) FILTER (WHERE s.score > c.threshold) AS hit, count(*) AS n"
            f" FROM cal c JOIN sp s ON {same} AND s.split IN ('benign_test', 'attack_test') GROUP BY ALL)",
            f"res AS (SELECT {sel}, a.attack_subtype, a.target_rate, a.threshold, a.n_cal, a.hit AS tp, a.n - a.hit AS fn, a.hit / a.n::DOUBLE AS recall, coalesce(b.hit, 0) AS fp, coalesce(b.n - b.hit, 0) AS tn,"
            f" coalesce(b.hit / b.n::DOUBLE, 0) AS fpr FROM hits a LEFT JOIN hits b ON {also} AND b.label = 'benign' WHERE a.label = 'attack')",
            f"pc AS (SELECT {by}, avg(recall) AS macro_recall, any_value(fpr) AS fpr, any_value(fp) AS fp, any_value(tn) AS tn, sum(tp)::BIGINT AS tp, sum(fn)::BIGINT AS fn FROM res GROUP BY {by})",
        ]
    )


def fleet_sql(select: str, b: str, group: str = "") -> str:
    f1 = "CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END"
    ba = "CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (tp / (tp + fn)::DOUBLE + tn / (tn + fp)::DOUBLE) / 2 END"
    lead = f"{group}, " if group else ""
    return f"""fl AS (SELECT {lead}avg(macro_recall) AS macro_recall, min(macro_recall) AS worst_recall, sum(weight * fpr) AS fleet_fpr, sum(tp) / sum(tp + fn)::DOUBLE AS pooled_recall,
    avg({f1}) AS macro_f1, avg({ba}) AS balanced_accuracy FROM pc JOIN w USING (client_id) {'GROUP BY ' + group if group else ''}),
fu AS (SELECT *, fleet_fpr / {b} AS usage, greatest(0.0, fleet_fpr / {b} - 1) AS violation FROM fl)
{select}"""


FLEET = ["macro_recall", "worst_recall", "fleet_fpr", "pooled_recall", "macro_f1", "balanced_accuracy", "usage", "violation"]
EQUAL = f"SELECT client_id, {BUDGET}::DOUBLE AS target_rate FROM cl"


# --- splits, calibration, evaluation -----------------------------------------------------------------------------


def split_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_rows(observations(spark, sf_dir))


def benign_weights(scores: DataFrame) -> DataFrame:
    return frontier.count_weights(scores.where(F.col("label") == "benign").groupBy("client_id").agg(F.count("*").alias("n")))


def equal_decisions(scores: DataFrame, budget: float = BUDGET) -> DataFrame:
    return policies.equal_rate(scores.select("client_id").distinct(), budget)


def equal_results(scores: DataFrame) -> DataFrame:
    return evaluate.evaluate(scores, evaluate.final_thresholds(scores, equal_decisions(scores)))


@query("p16_split_rows", f"WITH {OBS}, {SPLIT} SELECT client_id, ordinal, split FROM sp")
def split_assignment(spark, sf_dir):
    return split_scores(spark, sf_dir).select("client_id", "ordinal", "split")


@query("a44_split_counts", f"WITH {OBS}, {SPLIT} SELECT client_id, split, attack_subtype, count(*) AS n FROM sp GROUP BY ALL")
def split_counts(spark, sf_dir):
    return split_scores(spark, sf_dir).groupBy("client_id", "split", "attack_subtype").agg(F.count("*").alias("n"))


@query("a01_device_census", f"WITH {OBS} SELECT client_id, count(*) FILTER (WHERE label = 'benign') AS benign, count(*) FILTER (WHERE label = 'attack') AS attack, count(DISTINCT attack_subtype) AS subtypes FROM obs GROUP BY client_id")
def device_census(spark, sf_dir):
    from fleetward.sources.captures import census

    return census(observations(spark, sf_dir))


@query("a45_distinct_subtypes", f"WITH {OBS} SELECT DISTINCT client_id, attack_subtype FROM obs WHERE attack_subtype IS NOT NULL")
def distinct_subtypes(spark, sf_dir):
    return observations(spark, sf_dir).where(F.col("attack_subtype").isNotNull()).select("client_id", "attack_subtype").distinct()


@query("a43_evidence_level", f"WITH {OBS}, c AS (SELECT client_id, count(*) FILTER (WHERE label = 'benign') AS b, count(*) FILTER (WHERE label = 'attack') AS a FROM obs GROUP BY 1) SELECT count(*) FILTER (WHERE b >= 1000 AND a >= 500) AS devices, CASE WHEN count(*) FILTER (WHERE b >= 1000 AND a >= 500) >= 3 THEN 'CONFIRMATORY' ELSE 'SUPPORTIVE' END AS level FROM c")
def evidence_level(spark, sf_dir):
    from fleetward.sources.captures import census, evidence_level

    return evidence_level(census(observations(spark, sf_dir)), 1000, 500, 3)


@query("a03_order_stat_threshold", f"WITH {BIG}, {CLIENTS}, {GRID_SQL},\n" + theta_sql("th", "SELECT client_id, score FROM obs WHERE label = 'benign'", "SELECT client_id, grid_ix, target_rate FROM cl, grid") + f" SELECT client_id, grid_ix, n_cal, {r9('threshold', 'threshold')} FROM th")
def order_statistics(spark, sf_dir):
    obs = large_observations(spark, sf_dir)
    out = calibrate.thresholds(obs.where(F.col("label") == "benign").select("client_id", "score"), frontier.grid_frame(obs))
    return rounded(out.select("client_id", "grid_ix", "n_cal", "threshold"))


@query("a17_final_calibration", f"WITH {OBS}, {SPLIT}, {CLIENTS},\n{result_sql(EQUAL)} SELECT client_id, n_cal, {r9('threshold', 'threshold')}, {r9('1.0 / (n_cal + 1)', 'least_rate')} FROM cal")
def final_calibration(spark, sf_dir):
    s = split_scores(spark, sf_dir)
    out = evaluate.final_thresholds(s, equal_decisions(s))
    return rounded(out.select("client_id", "n_cal", "threshold", calibrate.minimum_resolvable_rate(F.col("n_cal")).alias("least_rate")))


@query("a19_evaluate_threshold", f"WITH {OBS}, {SPLIT}, {CLIENTS},\n{result_sql(EQUAL)} SELECT client_id, attack_subtype, n_cal, {r9('threshold', 'threshold')}, tp, fn, {r9('recall', 'recall')}, fp, tn, {r9('fpr', 'fpr')} FROM res")
def evaluate_threshold(spark, sf_dir):
    return rounded(equal_results(split_scores(spark, sf_dir)).drop("target_rate"))


@query("a20_client_metrics", f"WITH {OBS}, {SPLIT}, {CLIENTS},\n{result_sql(EQUAL)} SELECT client_id, {r9('macro_recall', 'macro_recall')}, {r9('fpr', 'fpr')}, fp, tn, tp, fn FROM pc")
def client_metrics(spark, sf_dir):
    return rounded(evaluate.per_client(equal_results(split_scores(spark, sf_dir))).drop("f1", "balanced_accuracy"))


@query("a34_fleet_summary", f"WITH {OBS}, {SPLIT}, {CLIENTS}, {WEIGHT},\n{result_sql(EQUAL)},\n" + fleet_sql("SELECT " + ", ".join(r9(c, c) for c in FLEET) + " FROM fu", f"{BUDGET}::DOUBLE"))
def fleet_summary(spark, sf_dir):
    """The flagship: split, calibrate at an equal rate, evaluate, summarise."""
    s = split_scores(spark, sf_dir)
    return rounded(evaluate.fleet(evaluate.per_client(equal_results(s)), benign_weights(s), BUDGET))


@query("a26_fpr_dispersion", f"WITH {OBS}, {SPLIT}, {CLIENTS},\n{result_sql(EQUAL)} SELECT round(quantile_cont(fpr, 0.5), 9) AS median, round(quantile_cont(fpr, 0.75) - quantile_cont(fpr, 0.25), 9) AS iqr, round(min(fpr), 9) AS least, round(max(fpr), 9) AS most, round(CASE WHEN avg(fpr) > 1e-12 THEN stddev_pop(fpr) / avg(fpr) END, 9) AS cv FROM pc")
def fpr_dispersion(spark, sf_dir):
    return rounded(evaluate.dispersion(evaluate.per_client(equal_results(split_scores(spark, sf_dir)))))


@query("a27_false_alert_gini", f"WITH {OBS}, {SPLIT}, {CLIENTS},\n{result_sql(EQUAL)} SELECT round(CASE WHEN sum(a.fp) = 0 THEN 0.0::DOUBLE ELSE sum(abs(a.fp - b.fp)) / (2.0::DOUBLE * sum(a.fp)) END, 9) AS gini FROM pc a, pc b")
def false_alert_gini(spark, sf_dir):
    return rounded(evaluate.gini(evaluate.per_client(equal_results(split_scores(spark, sf_dir))), "fp"))


@query("a31_auroc", f"WITH {BIG}, d AS (SELECT client_id, score, count(*) FILTER (WHERE label = 'benign') AS b, count(*) FILTER (WHERE label = 'attack') AS a FROM obs GROUP BY 1, 2), c AS (SELECT *, coalesce(sum(b) OVER (PARTITION BY client_id ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM d) SELECT client_id, round(sum(a * (below + b / 2.0::DOUBLE)) / (sum(a) * sum(b))::DOUBLE, 9) AS auroc FROM c GROUP BY 1")
def auroc(spark, sf_dir):
    return rounded(evaluate.auroc(large_observations(spark, sf_dir), ["client_id"]))


@query("a32_auprc", f"WITH {BIG}, o AS (SELECT client_id, row_number() OVER (PARTITION BY client_id ORDER BY score DESC, label DESC) AS k, (label = 'attack')::INT AS y FROM (SELECT client_id, score, CASE label WHEN 'benign' THEN 'z' ELSE 'attack' END AS label FROM obs)), c AS (SELECT *, sum(y) OVER (PARTITION BY client_id ORDER BY k) AS tp FROM o), p AS (SELECT *, tp / k::DOUBLE AS prec, coalesce(lag(tp / k::DOUBLE) OVER (PARTITION BY client_id ORDER BY k), 1.0) AS before FROM c) SELECT client_id, round(sum(CASE WHEN y = 1 THEN (prec + before) / 2 ELSE 0 END) / sum(y), 9) AS auprc FROM p GROUP BY 1")
def auprc(spark, sf_dir):
    return rounded(evaluate.auprc(large_observations(spark, sf_dir), ["client_id"]))


@query("a47_empirical_fpr", f"WITH {OBS} SELECT client_id, round(avg((score > 200)::INT), 9) AS fpr FROM obs WHERE label = 'benign' GROUP BY 1")
def empirical_fpr(spark, sf_dir):
    b = observations(spark, sf_dir).where(F.col("label") == "benign")
    return rounded(b.groupBy("client_id").agg(F.avg((F.col("score") > 200).cast("double")).alias("fpr")))


# --- frontier, weights, budgets ----------------------------------------------------------------------------------


def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.confusions(split_scores(spark, sf_dir))


@query("a04_frontier_confusions", f"WITH {CURVE} SELECT client_id, grid_ix, {r9('target_rate', 'target_rate')}, {r9('threshold', 'threshold')}, attack_subtype, tp, fn FROM cf")
def frontier_confusions(spark, sf_dir):
    return rounded(curve(spark, sf_dir))


@query("a05_client_utility", f"WITH {CURVE} SELECT client_id, grid_ix, {r9('target_rate', 'target_rate')}, {r9('utility', 'utility')}, {r9('utility_variance', 'utility_variance')} FROM ut")
def client_utility(spark, sf_dir):
    return rounded(frontier.utilities(curve(spark, sf_dir)))


ELIGIBLE = "el AS (SELECT client_id, sum(tp + fn)::BIGINT AS n_rows, count(*) FILTER (WHERE tp + fn >= 50) AS n_subtypes, sum(tp + fn) >= 165 AND count(*) FILTER (WHERE tp + fn >= 50) >= 2 AS eligible FROM cf WHERE grid_ix = 0 GROUP BY 1)"


@query("a08_client_eligibility", f"WITH {CURVE}, {ELIGIBLE} SELECT * FROM el")
def client_eligibility(spark, sf_dir):
    return frontier.eligibility(curve(spark, sf_dir), min_client=165)


@query("a10_fallback_budget", f"WITH {CURVE}, {ELIGIBLE}, {WEIGHT}, x AS (SELECT sum(CASE WHEN eligible THEN 0 ELSE weight * {BUDGET}::DOUBLE END) AS reserved, avg((NOT eligible)::INT) AS fallback_share FROM el JOIN w USING (client_id)) SELECT {BUDGET}::DOUBLE AS fallback_rate, round(reserved, 9) AS reserved, round(greatest(0.0, {BUDGET}::DOUBLE - reserved), 9) AS remaining, round(fallback_share, 9) AS fallback_share FROM x")
def fallback_budget(spark, sf_dir):
    s = split_scores(spark, sf_dir)
    return rounded(frontier.fallback_budget(frontier.eligibility(frontier.confusions(s), min_client=165), benign_weights(s), BUDGET))


@query("p24_resolution_guard", f"WITH {CURVE}, m AS (SELECT client_id, count(*) AS n_cal FROM sp WHERE split IN ('benign_frontier', 'benign_final_cal') GROUP BY 1) SELECT client_id, grid_ix, n_cal, target_rate > 1e-12 AND target_rate < 2.0::DOUBLE / (n_cal + 1) AS forbidden FROM cl JOIN m USING (client_id), grid")
def resolution_guard(spark, sf_dir):
    s = split_scores(spark, sf_dir)
    n = s.where(F.col("split").isin(*evaluate.CALIBRATION)).groupBy("client_id").agg(F.count("*").alias("n_cal"))
    return frontier.resolution_guard(frontier.grid_frame(s), n, 2.0).select("client_id", "grid_ix", "n_cal", "forbidden")


@query("a13_equal_weights", f"WITH {OBS}, {CLIENTS} SELECT client_id, round(1.0::DOUBLE / count(*) OVER (), 9) AS weight FROM cl")
def equal_weights(spark, sf_dir):
    return rounded(frontier.equal_weights(observations(spark, sf_dir).select("client_id").distinct()))


@query("a14_count_weights", f"WITH {OBS}, {SPLIT}, {WEIGHT} SELECT client_id, round(weight, 9) AS weight FROM w")
def count_weights(spark, sf_dir):
    return rounded(benign_weights(split_scores(spark, sf_dir)))


@query("o23_weight_gamma", f"WITH {OBS}, {SPLIT}, {WEIGHT} SELECT client_id, gamma, round(pow(weight, gamma) / sum(pow(weight, gamma)) OVER (PARTITION BY gamma), 9) AS weight FROM w, (VALUES (0.0::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE), (1.5::DOUBLE)) g(gamma)")
def weight_gamma(spark, sf_dir):
    w = benign_weights(split_scores(spark, sf_dir))
    parts = [frontier.gamma_weights(w, g).withColumn("gamma", F.lit(g)) for g in (0.0, 0.5, 1.0, 1.5)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return rounded(out)


@query("a41_utility_heterogeneity", f"WITH {CURVE}, h AS (SELECT grid_ix, target_rate, stddev_pop(utility) AS spread FROM ut GROUP BY 1, 2) SELECT grid_ix, target_rate, round(spread, 9) AS spread, round(avg(spread) OVER (), 9) AS mean_spread FROM h")
def utility_heterogeneity(spark, sf_dir):
    return rounded(frontier.heterogeneity(frontier.utilities(curve(spark, sf_dir))))


@query("a42_payload_bytes", f"WITH {CURVE} SELECT client_id, 68 + 4 * count(*) AS payload FROM ut GROUP BY 1")
def payload_bytes(spark, sf_dir):
    return frontier.payload(frontier.utilities(curve(spark, sf_dir)), len(GRID)).select("client_id", "payload")


# --- policies ----------------------------------------------------------------------------------------------------

LEVEL = f"""q AS (SELECT *, 0.05::DOUBLE * weight AS cap, coalesce(sum(0.05::DOUBLE * weight) OVER b, 0) AS filled, count(*) OVER () - coalesce(count(*) OVER b, 0) AS rest FROM w WINDOW b AS (ORDER BY weight, client_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT coalesce((SELECT ({BUDGET}::DOUBLE - filled) / rest FROM q WHERE ({BUDGET}::DOUBLE - filled) / rest < cap ORDER BY weight, client_id LIMIT 1), least(0.05::DOUBLE, {BUDGET}::DOUBLE / (SELECT min(weight) FROM w))) AS c)"""


@query("o02_equal_alert", f"WITH {OBS}, {SPLIT}, {WEIGHT}, {LEVEL} SELECT client_id, round(least(c / weight, 0.05::DOUBLE), 9) AS target_rate FROM w, c")
def equal_alert(spark, sf_dir):
    return rounded(policies.equal_alert(benign_weights(split_scores(spark, sf_dir)), BUDGET))


def solver_points(spark: SparkSession, sf_dir: str, guard: bool = False) -> DataFrame:
    s = split_scores(spark, sf_dir)
    util = frontier.utilities(frontier.confusions(s))
    forbidden = None
    if guard:
        n = s.where(F.col("split").isin(*evaluate.CALIBRATION)).groupBy("client_id").agg(F.count("*").alias("n_cal"))
        forbidden = frontier.resolution_guard(frontier.grid_frame(s), n)
    return policies.problem_points(util, frontier.equal_weights(s.select("client_id").distinct()), BUDGET, forbidden)


@query("o03_greedy")
def greedy(spark, sf_dir):
    return policies.allocate(solver_points(spark, sf_dir), "greedy")


COMBOS = f"""u AS (SELECT client_id, utility, target_rate / (SELECT count(*) FROM cl) AS c, row_number() OVER (PARTITION BY client_id ORDER BY grid_ix) AS j FROM ut),
o AS (SELECT client_id, row_number() OVER (ORDER BY client_id) AS k FROM (SELECT DISTINCT client_id FROM ut)),
v AS (SELECT k, utility, c FROM u JOIN o USING (client_id)),
x AS (SELECT a.utility + b.utility + d.utility + e.utility + f.utility AS u, a.c + b.c + d.c + e.c + f.c AS c
  FROM v a, v b, v d, v e, v f WHERE a.k = 1 AND b.k = 2 AND d.k = 3 AND e.k = 4 AND f.k = 5)"""


@query("o04_macro_objective", f"WITH {CURVE}, {COMBOS} SELECT 'OPTIMAL' AS status, round(max(u / 5), 6) AS objective FROM x WHERE c <= {BUDGET}::DOUBLE + 1e-12")
def macro_objective(spark, sf_dir):
    out = policies.allocate(solver_points(spark, sf_dir), "macro")
    return out.groupBy("status").agg(F.round(F.max("objective"), 6).alias("objective"))


#: The macro policy's choice among all of five devices and six rates: utility, then cost, variance and rates, each within its slack.
CHOICE = f"""z AS (SELECT client_id, grid_ix, target_rate, utility AS u, utility_variance / 5 AS v, target_rate / 5.0::DOUBLE AS c, dense_rank() OVER (ORDER BY client_id) AS k FROM ut),
x AS (SELECT [a.grid_ix, b.grid_ix, d.grid_ix, e.grid_ix, f.grid_ix] AS g, (a.u + b.u + d.u + e.u + f.u) / 5 AS u, a.c + b.c + d.c + e.c + f.c AS c, a.v + b.v + d.v + e.v + f.v AS v
  FROM z a, z b, z d, z e, z f WHERE a.k = 1 AND b.k = 2 AND d.k = 3 AND e.k = 4 AND f.k = 5 AND a.c + b.c + d.c + e.c + f.c <= {BUDGET}::DOUBLE + 1e-12),
y AS (SELECT max(u) AS best FROM x),
y2 AS (SELECT min(c) AS least FROM x, y WHERE u >= best - 1e-4 + 1e-8 - 1e-12),
y3 AS (SELECT min(v) AS calm FROM x, y, y2 WHERE u >= best - 1e-4 + 1e-8 - 1e-12 AND c <= least + 1e-4 - 1e-8 + 1e-12),
y4 AS (SELECT min(g) AS g FROM x, y, y2, y3 WHERE u >= best - 1e-4 - 1e-12 AND c <= least + 1e-4 + 1e-12 AND v <= calm + 1e-4 + 1e-12)
SELECT 'p' AS problem, client_id, z.grid_ix, target_rate, round(best, 6) AS objective, 'OPTIMAL' AS status FROM z, y, y4 WHERE z.grid_ix = list_extract(y4.g, z.k)"""


@query("o04_macro_allocation", f"WITH {CURVE}, {CHOICE}")
def macro_allocation(spark, sf_dir):
    return rounded(policies.allocate(solver_points(spark, sf_dir), "macro"), 6)


WORST = f"""g AS (SELECT u.client_id, u.utility, u.target_rate / (SELECT count(*) FROM cl) AS c FROM ut u JOIN (SELECT client_id, count(*) AS n_cal FROM sp WHERE split IN ('benign_frontier', 'benign_final_cal') GROUP BY 1) USING (client_id)
  WHERE NOT (target_rate > 1e-12 AND target_rate < 1.0::DOUBLE / (n_cal + 1))),
o AS (SELECT client_id, row_number() OVER (ORDER BY client_id) AS k FROM (SELECT DISTINCT client_id FROM ut)),
v AS (SELECT k, utility, c FROM g JOIN o USING (client_id)),
x AS (SELECT list_sort([a.utility, b.utility, d.utility, e.utility, f.utility]) AS l, a.c + b.c + d.c + e.c + f.c AS c
  FROM v a, v b, v d, v e, v f WHERE a.k = 1 AND b.k = 2 AND d.k = 3 AND e.k = 4 AND f.k = 5)"""


@query("o05_minimax_objective", f"WITH {CURVE}, {WORST} SELECT 'OPTIMAL' AS status, round(max(list_extract(l, 1) + list_extract(l, 2)), 6) AS objective FROM x WHERE c <= {BUDGET}::DOUBLE + 1e-12")
def minimax_objective(spark, sf_dir):
    out = policies.allocate(solver_points(spark, sf_dir, guard=True), "minimax")
    return out.groupBy("status").agg(F.round(F.max("objective"), 6).alias("objective"))


@query("o05_minimax_allocation")
def minimax_allocation(spark, sf_dir):
    return policies.allocate(solver_points(spark, sf_dir, guard=True), "minimax")


@query("j13_exhaustive_macro", f"WITH {CURVE}, {COMBOS} SELECT round(max(u / 5), 9) AS objective, count(*) AS feasible FROM x WHERE c <= {BUDGET}::DOUBLE + 1e-12")
def exhaustive_macro(spark, sf_dir):
    s = split_scores(spark, sf_dir)
    clients = s.select("client_id").distinct()
    return rounded(policies.exhaustive(frontier.utilities(frontier.confusions(s)), frontier.equal_weights(clients), BUDGET, [f"c{k}" for k in range(5)]))


@query("o06_pooled_shared", f"""WITH {OBS}, {SPLIT}, {WEIGHT}, th AS (SELECT DISTINCT score AS threshold FROM sp WHERE split = 'benign_frontier' UNION ALL SELECT 'infinity'::DOUBLE),
b AS (SELECT client_id, list_sort(list(score)) AS l FROM sp WHERE split = 'benign_frontier' GROUP BY 1),
f AS (SELECT threshold, sum(weight * x / n::DOUBLE) AS fleet_fpr FROM (SELECT t.threshold, s.client_id, count(*) FILTER (WHERE s.score > t.threshold) AS x, count(*) AS n FROM th t, sp s WHERE s.split = 'benign_frontier' GROUP BY 1, 2) JOIN w USING (client_id) GROUP BY 1),
m AS (SELECT threshold, avg(r) AS macro_recall FROM (SELECT threshold, client_id, avg(x / n::DOUBLE) AS r FROM (SELECT t.threshold, s.client_id, s.attack_subtype, count(*) FILTER (WHERE s.score > t.threshold) AS x, count(*) AS n FROM th t, sp s WHERE s.split = 'attack_validation' GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1)
SELECT round(threshold, 9) AS threshold, round(macro_recall, 9) AS macro_recall, round(fleet_fpr, 9) AS fleet_fpr FROM f JOIN m USING (threshold) WHERE fleet_fpr <= {BUDGET}::DOUBLE + 1e-12 ORDER BY round(macro_recall, 12) DESC, threshold LIMIT 1""")
def pooled_shared(spark, sf_dir):
    s = split_scores(spark, sf_dir)
    return rounded(policies.pooled_shared(s, benign_weights(s), BUDGET))


ORACLE_VIEW = SPLIT.replace("sp AS (", "sp0 AS (", 1) + ", sp AS (SELECT * FROM sp0 WHERE split <> 'attack_validation' UNION ALL SELECT * REPLACE ('attack_validation' AS split) FROM sp0 WHERE split = 'attack_test')"


@query("o07_test_oracle", f"WITH {CURVE.replace(SPLIT, ORACLE_VIEW)}, {CHOICE}")
def test_oracle(spark, sf_dir):
    s = splits.oracle_view(split_scores(spark, sf_dir))
    points = policies.problem_points(frontier.utilities(frontier.confusions(s)), frontier.equal_weights(s.select("client_id").distinct()), BUDGET)
    return rounded(policies.allocate(points, "macro"), 6)


@query("o24_subtype_fold", f"WITH {CURVE.replace('GROUP BY ALL)', 'GROUP BY ALL)', 1)}, z AS (SELECT client_id, grid_ix, tp / (tp + fn)::DOUBLE AS u FROM cf WHERE attack_subtype = 'error' AND tp + fn >= 50) SELECT client_id, grid_ix, round(u, 9) AS utility FROM z")
def subtype_fold(spark, sf_dir):
    s = splits.restrict_subtypes(split_scores(spark, sf_dir), ["error"], ["purchase"])
    return rounded(frontier.utilities(frontier.confusions(s)).select("client_id", "grid_ix", "utility"))


# --- several seeds: inference and gates --------------------------------------------------------------------------


def seed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of three seeds, split; several plans read them."""
    return staged(splits.split_rows(observations(spark, sf_dir), keys=("seed", "client_id")), "seed-scores")


def seed_results(s: DataFrame) -> DataFrame:
    """Results of equal rate and equal alert, at three budgets, on three interleaved thirds."""
    seeds = s.select("seed", "client_id").distinct()
    w = benign_weights(s)
    alert = policies.equal_alerts(w, SEED_BUDGETS).withColumn("policy", F.lit("equal_alert"))
    rate = alert.select("budget_id", "budget", "client_id", F.col("budget").alias("target_rate"), F.lit("equal_rate").alias("policy"))
    asked = seeds.join(alert.unionByName(rate), "client_id")
    by = ("budget_id", "budget", "policy")
    return evaluate.evaluate(s, evaluate.final_thresholds(s, asked, ("seed", "client_id")), ("seed", "client_id"), by)


def seed_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seed, budget_id, policy, FLEET...) of seed_results()."""
    s = seed_scores(spark, sf_dir)
    w, by, res = benign_weights(s), ("budget_id", "budget", "policy"), seed_results(s)
    return evaluate.fleet(evaluate.per_client(res, ("seed", *by)), w, None, ("seed", *by))


def _level_sql(b: str, budget: float) -> str:
    return LEVEL.replace("q AS", f"q_{b} AS").replace("FROM q ", f"FROM q_{b} ").replace("\nc AS", f"\nlv_{b} AS").replace(f"{BUDGET}::DOUBLE", f"{budget}::DOUBLE")


SEEDS = f"WITH {OBS}, {split_sql('seed, client_id')}, {CLIENTS}, {WEIGHT}, " + ",\n".join(_level_sql(b, v) for b, v in SEED_BUDGETS.items()) + ",\n"
SEEDS += "ask AS (" + " UNION ALL ".join(
    f"SELECT seed, client_id, '{b}' AS budget_id, {v}::DOUBLE AS budget, 'equal_rate' AS policy, {v}::DOUBLE AS target_rate FROM (SELECT DISTINCT seed, client_id FROM obs)"
    f" UNION ALL SELECT seed, client_id, '{b}', {v}::DOUBLE, 'equal_alert', least(c / weight, 0.05::DOUBLE) FROM (SELECT DISTINCT seed, client_id FROM obs) JOIN w USING (client_id), lv_{b}"
    for b, v in SEED_BUDGETS.items()
) + "),\n"
SEEDS += result_sql("SELECT * FROM ask", "seed, client_id", "budget_id, budget, policy") + ",\n" + fleet_sql("", "budget", "seed, budget_id, budget, policy").rstrip()


@query("o10_seed_evaluations", SEEDS + " SELECT seed, budget_id, policy, " + ", ".join(r9(c, c) for c in FLEET) + " FROM fu")
def seed_table(spark, sf_dir):
    return rounded(seed_evaluations(spark, sf_dir).select("seed", "budget_id", "policy", *FLEET))


@query("a35_mean_over_seeds", SEEDS + " SELECT budget_id, policy, count(*) AS n, " + ", ".join(f"round(avg({c}), 9) AS mean_{c}" for c in ("macro_recall", "worst_recall", "fleet_fpr", "usage", "violation")) + " FROM fu GROUP BY 1, 2")
def mean_over_seeds(spark, sf_dir):
    return rounded(infer.seed_means(seed_evaluations(spark, sf_dir)))


PAIRS = ", df AS (SELECT a.budget_id, a.seed, a.macro_recall - b.macro_recall AS diff FROM fu a JOIN fu b ON a.seed = b.seed AND a.budget_id = b.budget_id AND a.policy = 'equal_alert' AND b.policy = 'equal_rate'), sd AS (SELECT budget_id, list(diff ORDER BY seed) AS d FROM df GROUP BY 1), sf AS (SELECT budget_id, d, list_extract(d, 1) * (1 - 2 * (m % 2)) + list_extract(d, 2) * (1 - 2 * ((m // 2) % 2)) + list_extract(d, 3) * (1 - 2 * (m // 4)) AS s FROM sd, (SELECT unnest(range(8)) AS m)), tp AS (SELECT budget_id, list_sum(d) / 3 AS mean, avg((abs(s) / 3 >= abs(list_sum(d)) / 3 - 1e-12)::INT) AS p FROM sf GROUP BY budget_id, d)"


@query("o11_sign_flip", SEEDS + PAIRS + " SELECT budget_id, 3 AS n, round(mean, 9) AS mean, round(p, 9) AS p FROM tp")
def sign_flip(spark, sf_dir):
    return rounded(infer.sign_flip(infer.paired_differences(seed_evaluations(spark, sf_dir), "equal_alert", "equal_rate", "macro_recall")))


@query("o13_holm", SEEDS + PAIRS + ", r AS (SELECT budget_id, p, row_number() OVER (ORDER BY p, budget_id) AS k, count(*) OVER () AS m FROM tp) SELECT budget_id, round(p, 9) AS p, round(max(least(1.0, (m - k + 1) * p)) OVER (ORDER BY k), 9) AS adjusted, bool_and(p <= 0.3::DOUBLE / (m - k + 1)) OVER (ORDER BY k) AS rejected FROM r")
def holm(spark, sf_dir):
    tests = infer.sign_flip(infer.paired_differences(seed_evaluations(spark, sf_dir), "equal_alert", "equal_rate", "macro_recall"))
    return rounded(infer.holm(tests, alpha=0.3).select("budget_id", "p", "adjusted", "rejected"))


@query("o12_bootstrap")
def bootstrap(spark, sf_dir):
    return rounded(infer.bootstrap(infer.paired_differences(seed_evaluations(spark, sf_dir), "equal_alert", "equal_rate", "macro_recall")))


@query("o16_macro_gate", SEEDS + ", g AS (SELECT budget_id, avg(macro_recall) AS m FROM fu WHERE policy = 'equal_rate' GROUP BY 1) SELECT count(*) FILTER (WHERE m >= 0.5) AS n_ok, CASE WHEN count(*) < 3 THEN 'UNAVAILABLE' WHEN count(*) FILTER (WHERE m >= 0.5) >= 2 THEN 'PASS' ELSE 'FAIL' END AS status FROM g")
def macro_gate(spark, sf_dir):
    return infer.macro_gate(seed_evaluations(spark, sf_dir), "equal_rate", 0.5, 2, 3)


@query("o17_minimax_gate", SEEDS + ", g AS (SELECT budget_id, avg(worst_recall) FILTER (WHERE policy = 'equal_alert') AS v, 100 * (avg(macro_recall) FILTER (WHERE policy = 'equal_alert') - avg(macro_recall) FILTER (WHERE policy = 'equal_rate')) AS d FROM fu GROUP BY 1) SELECT count(*) FILTER (WHERE v >= 0.05 AND d >= -2.0) AS n_ok, CASE WHEN count(*) < 3 THEN 'UNAVAILABLE' WHEN count(*) FILTER (WHERE v >= 0.05 AND d >= -2.0) >= 2 THEN 'PASS' ELSE 'FAIL' END AS status FROM g")
def minimax_gate(spark, sf_dir):
    return infer.minimax_gate(seed_evaluations(spark, sf_dir), "equal_alert", "equal_rate", 0.05, 2.0, 2, 3)


@query("o18_budget_compliance", SEEDS + ", g AS (SELECT policy, budget_id, quantile_cont(usage, 0.5) AS mu, avg((usage <= 1.1)::INT) AS sw, count(usage) AS n FROM fu GROUP BY 1, 2) SELECT policy, budget_id, round(mu, 9) AS median_usage, round(sw, 9) AS share_within, CASE WHEN n < 3 THEN 'UNAVAILABLE' WHEN mu <= 1.05 AND sw >= 0.9 THEN 'PASS' ELSE 'FAIL' END AS status FROM g")
def budget_compliance(spark, sf_dir):
    return rounded(infer.compliance(seed_evaluations(spark, sf_dir), 3))


@query("a40_stability_mode", "WITH r AS (SELECT 'c' || (user_id % 5) AS client_id, round(value / 50) AS x FROM events), c AS (SELECT client_id, x, count(*) AS n FROM r GROUP BY 1, 2), m AS (SELECT client_id, arg_min(x, (-n, x)) AS mode_rate, max(n) / sum(n)::DOUBLE AS mode_share FROM c GROUP BY 1), q AS (SELECT client_id, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.05) AS p5, quantile_cont(x, 0.95) AS p95 FROM r GROUP BY 1) SELECT client_id, round(mode_rate, 9) AS mode_rate, round(mode_share, 9) AS mode_share, round(median, 9) AS median, round(p5, 9) AS p5, round(p95, 9) AS p95, round(1 - mode_share, 9) AS instability FROM m JOIN q USING (client_id)")
def stability_mode(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rounded(infer.stability(e.select(F.concat(F.lit("c"), F.pmod("user_id", F.lit(5)).cast("string")).alias("client_id"), F.round(F.col("value") / 50).alias("target_rate"))))


#: Replicates of the stability study.
REPLICATES = 500


@query("o19_allocation_stability")
def allocation_stability(spark, sf_dir):
    s = split_scores(spark, sf_dir)
    weights = frontier.equal_weights(s.select("client_id").distinct())
    return rounded(infer.stability(resampling.replicate_rates(s, weights, resampling.Draws(7, BUDGET), REPLICATES)))


@query("o21_conservative_curves")
def conservative_curves(spark, sf_dir):
    return rounded(scoring.conservative_utilities(curve(spark, sf_dir)), 6)


# --- events ------------------------------------------------------------------------------------------------------

TH = f"WITH {OBS}, {CLIENTS},\n" + theta_sql("th", "SELECT client_id, score FROM obs WHERE label = 'benign'", "SELECT client_id, 0.05::DOUBLE AS target_rate FROM cl")


def timed_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs with each device's own threshold at a rate of 0.05."""
    obs = observations(spark, sf_dir)
    cut = calibrate.thresholds(obs.where(F.col("label") == "benign").select("client_id", "score"), policies.equal_rate(obs.select("client_id").distinct(), 0.05))
    return obs.join(F.broadcast(cut.select("client_id", "threshold")), "client_id")


def event_sql(keys: str, rows: str, dil="1200.0", merge="3000.0", least="1200.0", cool="6000.0") -> str:
    return f"""a1 AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY {keys} ORDER BY t) <= greatest({dil}, {merge}) THEN 0 ELSE 1 END AS nb FROM ({rows})),
a2 AS (SELECT *, sum(nb) OVER (PARTITION BY {keys} ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM a1),
a3 AS (SELECT {keys}, g, min(t) AS s, max(t) AS e, count(*) AS n FROM a2 GROUP BY {keys}, g HAVING max(t) - min(t) >= {least}),
a4 AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY {keys} ORDER BY s) < {cool} THEN 0 ELSE 1 END AS nb FROM a3),
a5 AS (SELECT *, sum(nb) OVER (PARTITION BY {keys} ORDER BY s ROWS UNBOUNDED PRECEDING) AS g2 FROM a4),
ev AS (SELECT {keys}, min(s) AS start_t, max(e) AS end_t, sum(n)::BIGINT AS alarms FROM a5 GROUP BY {keys}, g2)"""


ALERTS = "SELECT o.client_id, o.t FROM obs o JOIN th USING (client_id) WHERE o.score > th.threshold"


@query("e01_eventize", TH + f", {event_sql('client_id', ALERTS)} SELECT client_id, round(start_t, 6) AS start, round(end_t, 6) AS \"end\", alarms FROM ev")
def eventize(spark, sf_dir):
    a = timed_alerts(spark, sf_dir)
    return rounded(events.eventize(a.where(F.col("score") > F.col("threshold")).select("client_id", "t"), ["client_id"]), 6)


@query("e05_alert_streams", TH + ", z AS (SELECT o.*, th.threshold FROM obs o JOIN th USING (client_id)) SELECT client_id, count(*) FILTER (WHERE score > threshold) AS n_alerts, count(*) FILTER (WHERE score > threshold AND label = 'benign') AS n_benign_alerts, round(min(t) FILTER (WHERE label = 'attack'), 6) AS attack_start, round(max(t) FILTER (WHERE label = 'attack'), 6) AS attack_end, round(max(t) - min(t), 6) AS duration FROM z GROUP BY 1")
def alert_streams(spark, sf_dir):
    return rounded(events.streams(timed_alerts(spark, sf_dir)), 6)


def metrics_sql(keys: str, grid_from: str, params: tuple[str, str, str, str]) -> str:
    both = f"SELECT {keys}, o.t, unnest(CASE WHEN o.label = 'benign' THEN ['all', 'benign'] ELSE ['all'] END) AS stream{', dilation, merge, least_s, cooldown' if grid_from and False else ''} FROM obs o JOIN th USING (client_id){grid_from} WHERE o.score > th.threshold"
    k = ", ".join(x.strip().split(".")[-1] for x in keys.split(","))
    dil, merge, least, cool = params
    return TH + f""", {event_sql(k + ', stream', both, dil, merge, least, cool).replace("GROUP BY " + k + ", stream, g HAVING", "GROUP BY " + k + ", stream, g HAVING")},
sp2 AS (SELECT client_id, max(t) - min(t) AS du, min(t) FILTER (WHERE label = 'attack') AS a0, max(t) FILTER (WHERE label = 'attack') AS z0 FROM obs GROUP BY 1),
dl AS (SELECT o.client_id, min(o.t) - min(a0) AS delay FROM obs o JOIN th USING (client_id) JOIN sp2 USING (client_id) WHERE o.score > th.threshold AND o.t BETWEEN a0 AND z0 GROUP BY 1),
pe AS (SELECT {k}, count(*) FILTER (WHERE stream = 'benign') AS benign_events, count(*) FILTER (WHERE stream = 'all') AS all_events, coalesce(avg((end_t - start_t) / du) FILTER (WHERE stream = 'benign'), 0) AS duty FROM ev JOIN sp2 USING (client_id) GROUP BY {k})
SELECT {k}, benign_events, all_events, round(benign_events / (du / 3600.0), 9) AS false_events_per_hour, round(all_events / (du / 3600.0), 9) AS events_per_hour,
  CASE WHEN delay IS NULL THEN 0.0 ELSE 1.0 END AS recall, CASE WHEN delay IS NULL THEN 1.0 ELSE 0.0 END AS miss, round(coalesce(delay, 0), 9) AS delay, round(duty, 9) AS duty
FROM pe JOIN sp2 USING (client_id) LEFT JOIN dl USING (client_id)"""


@query("e08_event_metrics", metrics_sql("o.client_id", "", ("1200.0", "3000.0", "1200.0", "6000.0")))
def event_metrics(spark, sf_dir):
    return rounded(events.event_metrics(timed_alerts(spark, sf_dir)))


STEPS = {"dilation": (600.0, 1200.0, 2400.0), "merge": (1500.0, 3000.0, 6000.0), "least": (600.0, 1200.0, 2400.0), "cooldown": (3000.0, 6000.0, 12000.0)}
_GRID_FROM = "".join(f", (SELECT unnest([{', '.join(map(str, v))}]::DOUBLE[]) AS {n})" for n, v in STEPS.items())


@query("e11_robustness_grid", metrics_sql("o.client_id, dilation, merge, least, cooldown", _GRID_FROM, ("any_value(dilation)", "m", "l", "c")).replace("greatest(any_value(dilation), m)", "greatest(dilation, merge)").replace(">= l)", ">= least)").replace("< c THEN", "< cooldown THEN"))
def robustness_grid(spark, sf_dir):
    return rounded(events.robustness(timed_alerts(spark, sf_dir), STEPS))


@query("e13_event_gini", TH + f", {event_sql('client_id', ALERTS + chr(32) + 'AND o.label = ' + repr('benign'))}, c AS (SELECT client_id, count(*) AS n FROM ev GROUP BY 1) SELECT round(sum(abs(a.n - b.n)) / (2.0::DOUBLE * sum(a.n)), 9) AS gini FROM c a, c b")
def event_gini(spark, sf_dir):
    a = timed_alerts(spark, sf_dir).where((F.col("score") > F.col("threshold")) & (F.col("label") == "benign"))
    ev = events.eventize(a.select("client_id", "t"), ["client_id"])
    return rounded(evaluate.gini(ev.groupBy("client_id").agg(F.count("*").alias("n")), "n"))


@query("e09_event_budget")
def event_budget(spark, sf_dir):
    return rounded(event_budget_.thresholds(observations(spark, sf_dir), 0.05), 6)


AUDIT = "a AS (SELECT event_type AS file, CASE WHEN user_id % 11 = 0 THEN NULL ELSE 'd' || (user_id % 4) END AS client_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE epoch_us(ts) / 1e6 - 700 * (event_id % 2) END AS t, CASE WHEN user_id % 7 = 0 THEN 'x' ELSE 'benign' END AS label, event_id AS ordinal FROM events)"


@query("e14_capture_audit", f"WITH {AUDIT}, s AS (SELECT file, client_id, t - lag(t) OVER (PARTITION BY file, client_id ORDER BY ordinal) AS d FROM a WHERE client_id IS NOT NULL AND t IS NOT NULL), o AS (SELECT file, max(x) AS out_of_order FROM (SELECT file, client_id, coalesce(count(*) FILTER (WHERE d < 0 AND d > -500) / nullif(count(d), 0)::DOUBLE, 0) AS x FROM s GROUP BY 1, 2) GROUP BY 1) SELECT file, count(DISTINCT client_id) AS devices, round(avg((t IS NOT NULL)::INT), 9) AS parsed_share, round(avg((client_id IS NOT NULL)::INT), 9) AS associable, bool_or(label <> 'benign') AS has_attack, coalesce(min(t) FILTER (WHERE label = 'benign') < min(t) FILTER (WHERE label <> 'benign') OR max(t) FILTER (WHERE label = 'benign') > max(t) FILTER (WHERE label <> 'benign'), true) AS separable, round(max(t) - min(t), 6) AS duration, round(any_value(out_of_order), 9) AS out_of_order FROM a JOIN o USING (file) GROUP BY file")
def capture_audit(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6) - 700 * F.pmod("event_id", F.lit(2))
    rows = e.select(
        F.col("event_type").alias("file"), F.when(F.pmod("user_id", F.lit(11)) != 0, F.concat(F.lit("d"), F.pmod("user_id", F.lit(4)).cast("string"))).alias("client_id"),
        F.when(F.pmod("event_id", F.lit(13)) != 0, t).alias("t"), F.when(F.pmod("user_id", F.lit(7)) == 0, "x").otherwise("benign").alias("label"), F.col("event_id").alias("ordinal"),
    )
    out = events.capture_audit(rows, 500.0)
    return rounded(out.withColumn("duration", F.round("duration", 6)))


# --- features and scores -----------------------------------------------------------------------------------------

FEAT = "f AS (SELECT 'e' || label AS client_id, vec_id AS row, embedding::DOUBLE[] AS x FROM embeddings), l AS (SELECT client_id, row, unnest(range(len(x))) AS feature, unnest(x) AS v FROM f), st AS (SELECT client_id, feature, avg(v) AS mean, CASE WHEN stddev_pop(v) < 1e-12 THEN 1.0 ELSE stddev_pop(v) END AS sd FROM l GROUP BY 1, 2)"


@query("a46_column_statistics", f"WITH {FEAT} SELECT client_id, feature, round(mean, 9) AS mean, round(sd, 9) AS sd FROM st")
def column_statistics(spark, sf_dir):
    return rounded(scoring.column_statistics(features(spark, sf_dir)).withColumn("feature", F.col("feature").cast("long")))


@query("f02_standardise", f"WITH {FEAT} SELECT client_id, row, round(sqrt(sum(pow((v - mean) / sd, 2))), 6) AS norm FROM l JOIN st USING (client_id, feature) GROUP BY 1, 2")
def standardise(spark, sf_dir):
    f = features(spark, sf_dir)
    z = scoring.standardise(f, scoring.column_statistics(f))
    return z.select("client_id", "row", F.round(F.sqrt(F.aggregate("z", F.lit(0.0), lambda a, v: a + v * v)), 6).alias("norm"))


@query("f04_reconstruction_error", f"WITH {FEAT}, z AS (SELECT client_id, row, feature, (v - mean) / sd AS z FROM l JOIN st USING (client_id, feature)) SELECT client_id, row, round(avg(pow(z - 0.5::DOUBLE * p, 2)), 6) AS mse FROM (SELECT *, coalesce(lag(z) OVER (PARTITION BY client_id, row ORDER BY feature), 0) AS p FROM z) GROUP BY 1, 2")
def reconstruction_error(spark, sf_dir):
    """A fixed linear model that guesses each feature from the one before."""
    f = features(spark, sf_dir)
    z = scoring.standardise(f, scoring.column_statistics(f))
    guess = F.transform("z", lambda v, i: F.coalesce(F.get("z", i - 1), F.lit(0.0)) * 0.5)
    return z.select("client_id", "row", F.round(scoring.mean_square(F.col("z"), guess), 6).alias("mse"))


@query("w06_ecdf", f"WITH {OBS}, {SPLIT}, p AS (SELECT client_id, score FROM sp WHERE split IN ('benign_frontier', 'benign_final_cal')), n AS (SELECT client_id, count(*) AS n FROM p GROUP BY 1), q AS (SELECT client_id, ordinal, score FROM sp WHERE split = 'benign_test') SELECT q.client_id, q.ordinal, round((SELECT count(*) FROM p WHERE p.client_id = q.client_id AND p.score <= q.score) / n.n::DOUBLE, 9) AS pct FROM q JOIN n USING (client_id)")
def ecdf(spark, sf_dir):
    s = split_scores(spark, sf_dir)
    pool = s.where(F.col("split").isin(*evaluate.CALIBRATION)).select("client_id", "score")
    out = scoring.ecdf(pool, s.where(F.col("split") == "benign_test").select("client_id", "ordinal", "score"), ["client_id"], "score")
    return rounded(out.select("client_id", "ordinal", "pct"))


@query("f03_ensemble", f"WITH {FEAT}, b AS (SELECT client_id, row, sum(v) AS s1, sum(abs(v)) AS s2, row % 2 = 0 AS pool FROM l GROUP BY 1, 2), q AS (SELECT a.client_id, a.row, avg((b.s1 <= a.s1)::INT) AS p1, avg((b.s2 <= a.s2)::INT) AS p2 FROM b a JOIN b ON a.client_id = b.client_id AND b.pool GROUP BY 1, 2) SELECT client_id, row, round(greatest(p1, p2), 9) AS score FROM q")
def ensemble(spark, sf_dir):
    f = features(spark, sf_dir)
    total = lambda g: F.aggregate("x", F.lit(0.0), lambda a, v: a + g(v))
    s = f.select("client_id", "row", total(lambda v: v).alias("s1"), total(F.abs).alias("s2"))
    return rounded(scoring.ensemble(s, F.pmod("row", F.lit(2)) == 0, "s1", "s2").select("client_id", "row", "score"))


@query("o28_federated_scores")
def federated_scores(spark, sf_dir):
    f = features(spark, sf_dir)
    z = scoring.standardise(f, scoring.column_statistics(f))
    net = scoring.federated_training(z.select("client_id", "row", "z"), [64, 16, 4], rounds=10, epochs=3)
    return scoring.reconstruction_scores(z, net).select("client_id", "row", F.round("score", 4).alias("score"))


TIMED = """tr AS (SELECT 'e' || label AS client_id, 'f' || (vec_id % 3) AS source_file, vec_id AS source_row, CASE WHEN vec_id % 4 = 0 THEN 'attack' ELSE 'benign' END AS label, CASE WHEN vec_id % 4 = 0 THEN 's' || (vec_id % 8) END AS attack_subtype, embedding::DOUBLE[] AS x FROM embeddings),
ti AS (SELECT *, row_number() OVER (PARTITION BY client_id, label, attack_subtype ORDER BY source_file, source_row) - 1 AS i, count(*) OVER (PARTITION BY client_id, label, attack_subtype)::DOUBLE AS n FROM tr),
ts AS (SELECT * EXCLUDE (i, n), CASE WHEN label = 'benign' THEN CASE WHEN i < floor(0.5::DOUBLE * n) THEN 'benign_train' WHEN i < floor(0.7::DOUBLE * n) THEN 'benign_frontier' WHEN i < floor(0.8::DOUBLE * n) THEN 'benign_final_cal' ELSE 'benign_test' END WHEN i < floor(0.2::DOUBLE * n) THEN 'attack_validation' ELSE 'attack_test' END AS split FROM ti),
tl AS (SELECT client_id, source_file, source_row, split, unnest(range(len(x))) AS j, unnest(x) AS v FROM ts),
tm AS (SELECT client_id, j, avg(v) AS mean, CASE WHEN stddev_pop(v) < 1e-12 THEN 1.0 ELSE stddev_pop(v) END AS sd FROM tl WHERE split = 'benign_train' GROUP BY 1, 2),
tz AS (SELECT tl.*, (v - mean) / sd AS z FROM tl JOIN tm USING (client_id, j)),
tg AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY client_id, source_file, source_row ORDER BY j), 0.0) * 0.5 AS guess FROM tz)"""


def timed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as rows of timed captures: three files, a quarter of the rows attacks of two subtypes."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    attack = F.pmod("vec_id", F.lit(4)) == 0
    return v.select(
        F.concat(F.lit("e"), F.col("label").cast("string")).alias("client_id"), F.concat(F.lit("f"), F.pmod("vec_id", F.lit(3)).cast("string")).alias("source_file"), F.col("vec_id").alias("source_row"),
        F.when(attack, "attack").otherwise("benign").alias("label"), F.when(attack, F.concat(F.lit("s"), F.pmod("vec_id", F.lit(8)).cast("string"))).alias("attack_subtype"), F.col("embedding").cast("array<double>").alias("x"),
    )


def neighbour_model(train: DataFrame, rows: DataFrame, seed: int) -> DataFrame:
    """A fixed model that guesses each feature from the one before."""
    return rows.withColumn("score", scoring.mean_square(F.col("z"), F.transform("z", lambda v, i: F.coalesce(F.get("z", i - 1), F.lit(0.0)) * 0.5)))


@query("e21_timed_scores", f"WITH {TIMED} SELECT client_id, source_file, source_row, split, seed, round(avg((z - guess) * (z - guess)), 6) AS score FROM tg, (VALUES (0::BIGINT), (1::BIGINT)) q(seed) WHERE split <> 'benign_train' GROUP BY ALL")
def materialised_scores(spark, sf_dir):
    """Scaler and scores of two seeds, committed seed by seed and read back."""
    path = new_path(spark, "timed-scores")
    timed.materialise(spark, timed_rows(spark, sf_dir), path, "embeddings", [0, 1], neighbour_model)
    both = timed.scores_of(spark, path, "embeddings", 0).unionByName(timed.scores_of(spark, path, "embeddings", 1))
    return both.select("client_id", "source_file", "source_row", "split", "seed", F.round("score", 6).alias("score"))


def packet_captures(spark: SparkSession, sf_dir: str) -> str:
    """events as a tree of packet captures, written by Spark; its path."""
    root, obs = new_path(spark, "captures"), observations(spark, sf_dir)
    mac = lambda k: F.concat(F.lit("aa:00:00:00:00:0"), k)
    cells = obs.select("label", "attack_subtype", F.substring("client_id", 2, 1).alias("k"), "score", "t", "ordinal").repartitionByRange("ordinal").sortWithinPartitions("ordinal")
    odd = F.when(F.pmod("ordinal", F.lit(50)) == 0, F.lit("n/a")).otherwise(F.col("t").cast("string")).alias("f2")
    cells.where(F.col("label") == "benign").select(mac(F.col("k")).alias("src_mac"), mac(F.lit("9")).alias("dst_mac"), F.col("score").alias("f1"), odd, F.lit("text").alias("note")).write.option("header", True).csv(f"{root}/Benign")
    for kind in ("error", "purchase"):
        cells.where(F.col("attack_subtype") == kind).select(F.lit("text").alias("note"), mac(F.lit("9")).alias("src_mac"), mac(F.col("k")).alias("dst_mac"), odd, F.col("score").alias("f1")).write.option("header", True).csv(f"{root}/attacks/{kind}")
    return root


@query("o26_external_replication", f"WITH {OBS}, k AS (SELECT client_id, count(*) FILTER (WHERE label = 'benign') AS b, count(*) FILTER (WHERE label = 'attack') AS a FROM obs GROUP BY 1), e AS (SELECT 'aa:00:00:00:00:0' || substr(client_id, 2) AS client_id, label, attack_subtype, ordinal FROM obs JOIN k USING (client_id) WHERE b >= 20 AND a >= 20 AND ordinal % 50 <> 0), i AS (SELECT *, row_number() OVER (PARTITION BY client_id, label, attack_subtype ORDER BY ordinal) - 1 AS i, count(*) OVER (PARTITION BY client_id, label, attack_subtype)::DOUBLE AS n FROM e), s AS (SELECT client_id, attack_subtype, CASE WHEN label = 'benign' THEN CASE WHEN i < floor(0.5::DOUBLE * n) THEN 'benign_train' WHEN i < floor(0.7::DOUBLE * n) THEN 'benign_frontier' WHEN i < floor(0.8::DOUBLE * n) THEN 'benign_final_cal' ELSE 'benign_test' END WHEN i < floor(0.2::DOUBLE * n) THEN 'attack_validation' ELSE 'attack_test' END AS split FROM i) SELECT client_id, split, attack_subtype, count(*) AS n FROM s WHERE split <> 'benign_train' GROUP BY ALL")
def external_replication(spark, sf_dir):
    """The replication's scores by device, split and subtype, from captures to committed scores and runs."""
    path = new_path(spark, "external")
    first = lambda train, rows, seed: rows.withColumn("score", F.get("z", F.lit(0)))
    out = external.replicate(spark, packet_captures(spark, sf_dir), path, first, {"b1": 0.01}, [0], parsed=0.9, min_benign=20, min_attack=20, min_devices=2, min_client=20, min_rows=10)
    assert out["level"] == "CONFIRMATORY" and out["columns"] == ["f1", "f2"], out
    return timed.scores_of(spark, path, "external", 0).groupBy("client_id", "split", "attack_subtype").agg(F.count("*").alias("n"))


FOLDS = {"f1": ["m1", "m2", "m3"], "f2": ["m4", "m5"], "f3": ["m6", "m7"]}
LINES = """obs AS (
  SELECT 's' || (l_suppkey % 9) AS client_id, CASE WHEN l_returnflag = 'N' THEN 'benign' ELSE 'attack' END AS label, CASE WHEN l_returnflag <> 'N' THEN 'm' || l_linenumber END AS attack_subtype,
    l_extendedprice / 1000.0::DOUBLE + CASE WHEN l_returnflag = 'N' THEN 0 ELSE 20 + 8 * (l_suppkey % 9) END AS score, l_orderkey * 8 + l_linenumber AS ordinal FROM lineitem)"""


def line_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as split scores of nine devices, with line numbers as seven subtypes."""
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    benign = F.col("l_returnflag") == "N"
    obs = x.select(
        F.concat(F.lit("s"), F.pmod("l_suppkey", F.lit(9)).cast("string")).alias("client_id"), F.when(benign, "benign").otherwise("attack").alias("label"), F.when(~benign, F.concat(F.lit("m"), F.col("l_linenumber").cast("string"))).alias("attack_subtype"),
        (F.col("l_extendedprice") / F.lit(1000.0) + F.when(benign, F.lit(0)).otherwise(20 + 8 * F.pmod("l_suppkey", F.lit(9)))).alias("score"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ordinal"),
    )
    return splits.split_rows(obs)


def _rotation_sql() -> str:
    sides = []
    for name, own in FOLDS.items():
        other = ", ".join(f"'{s}'" for k, x in FOLDS.items() if k != name for s in x)
        mine = ", ".join(f"'{s}'" for s in own)
        sides.append(f"SELECT *, '{name}' AS direction FROM sp0 WHERE label = 'benign' OR (split = 'attack_validation' AND attack_subtype IN ({mine})) OR (split = 'attack_test' AND attack_subtype IN ({other}))")
    asked = " UNION ALL ".join(f"SELECT direction, client_id, '{b}' AS budget_id, {v}::DOUBLE AS budget, {v}::DOUBLE AS target_rate FROM (SELECT DISTINCT direction, client_id FROM sp)" for b, v in SEED_BUDGETS.items())
    parts = [f"WITH {LINES}", split_sql().replace("sp AS (", "sp0 AS (", 1), f"sp AS ({' UNION ALL '.join(sides)})", WEIGHT, result_sql(asked, "direction, client_id", "budget_id, budget"), fleet_sql("", "budget", "direction, budget_id, budget").rstrip()]
    return ", ".join(parts) + " SELECT direction, budget_id, " + ", ".join(r9(c, c) for c in FLEET) + " FROM fu"


@query("o24_rotations", _rotation_sql())
def fold_rotations(spark, sf_dir):
    """Three rotations of subtype folds at three budgets, at an equal rate: each fold validated on, the others tested."""
    s = staged(line_scores(spark, sf_dir), "lines")
    v = generalization.views(s, generalization.rotations(FOLDS))
    asked = v.select("direction", "client_id").distinct().select("direction", "client_id", F.inline(F.array(*(F.struct(F.lit(b).alias("budget_id"), F.lit(x).alias("budget"), F.lit(x).alias("target_rate")) for b, x in SEED_BUDGETS.items()))))
    keys, by = ("direction", "client_id"), ("budget_id", "budget")
    res = evaluate.evaluate(v, evaluate.final_thresholds(v, asked, keys), keys, by)
    out = evaluate.fleet(evaluate.per_client(res, ("direction", *by)), benign_weights(s), None, ("direction", *by))
    return rounded(out.select("direction", "budget_id", *FLEET))


@query("d16_budget_policy_table", SEEDS + " SELECT format('{:.4f}', budget) AS budget, policy, format('{:.4f}', avg(macro_recall)) AS \"macro recall\", format('{:.4f}', avg(worst_recall)) AS \"worst-client recall\", format('{:.3f}', avg(usage)) AS \"budget usage\", format('{:.4f}', avg(fleet_fpr)) AS \"federation fpr\" FROM fu GROUP BY budget, policy")
def budget_policy_table(spark, sf_dir):
    return reports.budget_policy_table(reports.summaries(seed_evaluations(spark, sf_dir)), SEED_BUDGETS, reports.PRIMARY_COLUMNS, policies.POLICIES)


@query("d14_summary_totals", SEEDS + " SELECT CASE grouping(budget_id, policy) WHEN 0 THEN 'cell' WHEN 1 THEN 'budget' WHEN 2 THEN 'policy' ELSE 'all' END AS level, budget_id, policy, count(*) AS n, " + ", ".join(f"round(avg({c}), 9) AS {c}" for c in ("macro_recall", "worst_recall", "fleet_fpr", "usage", "violation", "pooled_recall", "macro_f1", "balanced_accuracy")) + " FROM fu GROUP BY GROUPING SETS ((budget_id, policy), (policy), (budget_id), ())")
def summary_totals(spark, sf_dir):
    """Means by budget and policy with their totals, in one pass."""
    return rounded(reports.summaries(seed_evaluations(spark, sf_dir)).drop("auroc", "auprc", "gini", "fallback_share"))


@query("j09_alerts_in_intervals", TH + ", i AS (SELECT client_id, attack_subtype, min(t) AS a, max(t) AS b FROM obs WHERE label = 'attack' GROUP BY client_id, attack_subtype, seed) SELECT i.client_id, i.attack_subtype, round(i.a, 6) AS start, count(*) AS n, round(min(o.t), 6) AS first FROM i JOIN obs o ON o.client_id = i.client_id AND o.t BETWEEN i.a AND i.b JOIN th ON th.client_id = o.client_id WHERE o.score > th.threshold GROUP BY 1, 2, 3")
def alerts_in_intervals(spark, sf_dir):
    """Alerts by the attack intervals, overlapping ones too, that hold them."""
    z = timed_alerts(spark, sf_dir)
    spans = staged(z.where(F.col("label") == "attack").groupBy("client_id", "attack_subtype", "seed").agg(F.min("t").alias("start"), F.max("t").alias("end")).drop("seed"), "spans")
    held = events.in_intervals(z.where(F.col("score") > F.col("threshold")).select("client_id", "t"), spans)
    return held.groupBy("client_id", "attack_subtype", F.round("start", 6).alias("start")).agg(F.count("*").alias("n"), F.round(F.min("t"), 6).alias("first"))


# --- text --------------------------------------------------------------------------------------------------------


@query("p06_normalise_names", "SELECT p_partkey, regexp_replace(lower(trim('  ' || p_name || '#?' || p_brand || ' ')), '[^a-z0-9._: -]+', '_', 'g') AS device, regexp_replace(regexp_replace(lower(p_type || ' & ' || p_brand || '!'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS attack FROM part")
def normalise_names(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", text.device_name(F.concat(F.lit("  "), "p_name", F.lit("#?"), "p_brand", F.lit(" "))).alias("device"), text.attack_name(F.concat("p_type", F.lit(" & "), "p_brand", F.lit("!"))).alias("attack"))


@query("p08_capture_time", "SELECT event_id, round(epoch_us(ts) / 1e6, 6) AS t FROM events")
def capture_time(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    shown = F.concat(F.date_format(F.col("ts").cast("timestamp"), "MMM dd, yyyy HH:mm:ss.SSSSSS"), F.lit("000 GMT"))
    return e.select("event_id", F.round(text.epoch_seconds(text.capture_time(shown)), 6).alias("t"))


@query("p01_numeric_projection", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE o_totalprice END AS x FROM orders")
def numeric_projection(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.pmod("o_orderkey", F.lit(4))
    cell = F.when(k == 0, "").when(k == 1, F.concat(F.col("o_totalprice").cast("string"), F.lit("d"))).otherwise(F.concat(F.lit(" "), F.format_string("%.2f", "o_totalprice")))
    return o.select("o_orderkey", text.number(cell).alias("x"))


@query("j01_score_lookup", "SELECT o_orderkey AS source_file, o_custkey, round(score, 2) AS score FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice) AS score FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def score_lookup(spark, sf_dir):
    """Rows meet the one score of their place: orders, and what their lines cost."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("source_file"), "o_custkey")
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("source_file")).agg(F.sum("l_extendedprice").alias("score"))
    return lookups.score_lookup(rows, x, ["source_file"]).withColumn("score", F.round("score", 2))


@query("j02_timed_scores", "SELECT event_id AS source_row, 'c' || (user_id % 5) AS client_id, epoch_us(ts) / 1e6 AS t, value AS score FROM events WHERE user_id % 7 <> 0 AND event_id % 5 <> 0 AND event_id % 3 <> 0")
def timed_scores(spark, sf_dir):
    """Timed rows, some without a device or a time, meet a score table that lacks every third row."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("source_file", F.lit("events"))
    timed = e.select(
        "source_file", F.col("event_id").alias("source_row"), F.when(F.pmod("user_id", F.lit(7)) != 0, F.concat(F.lit("c"), F.pmod("user_id", F.lit(5)).cast("string"))).otherwise(" ").alias("client_id"),
        F.when(F.pmod("event_id", F.lit(5)) != 0, F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t"), F.lit("benign").alias("label"), F.lit(None).cast("string").alias("attack_subtype"),
    )
    scores = e.where(F.pmod("event_id", F.lit(3)) != 0).select("source_file", F.col("event_id").alias("source_row"), F.col("value").alias("score"))
    return lookups.timed_scores(timed, scores).select("source_row", "client_id", "t", "score")


@query("w03_out_of_order_steps", "SELECT client_id, count(*) FILTER (WHERE d < 0) AS back, count(d) AS steps FROM (SELECT client_id, t - lag(t) OVER (PARTITION BY client_id ORDER BY ordinal) AS d FROM (SELECT 'c' || (user_id % 5) AS client_id, event_id AS ordinal, epoch_us(ts) / 1e6 - 900 * (event_id % 3) AS t FROM events)) GROUP BY 1")
def out_of_order_steps(spark, sf_dir):
    obs = observations(spark, sf_dir).withColumn("t", F.col("t") - 900 * F.pmod("ordinal", F.lit(3)))
    d = events.steps_back(obs.select("client_id", "ordinal", "t"), ["client_id"], "ordinal")
    return d.groupBy("client_id").agg(F.count_if(F.col("d") < 0).alias("back"), F.count("d").alias("steps"))


# --- views, contrasts, completion --------------------------------------------------------------------------------


@query("d08_split_manifest", f"WITH {OBS}, {SPLIT} SELECT client_id, split, attack_subtype, min(ordinal) AS first, max(ordinal) AS last, count(*) AS n FROM sp GROUP BY ALL")
def split_manifest(spark, sf_dir):
    return split_scores(spark, sf_dir).groupBy("client_id", "split", "attack_subtype").agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.count("*").alias("n"))


@query("j09_detected_intervals", TH + ", i AS (SELECT client_id, attack_subtype, min(t) AS a, max(t) AS b FROM obs WHERE label = 'attack' GROUP BY client_id, attack_subtype) SELECT client_id, attack_subtype FROM i WHERE EXISTS (SELECT 1 FROM obs o JOIN th USING (client_id) WHERE o.client_id = i.client_id AND o.score > th.threshold AND o.t BETWEEN i.a AND i.b)")
def detected_intervals(spark, sf_dir):
    z = timed_alerts(spark, sf_dir)
    spans = z.where(F.col("label") == "attack").groupBy("client_id", "attack_subtype").agg(F.min("t").alias("start"), F.max("t").alias("end"))
    return events.detected_intervals(spans, z.where(F.col("score") > F.col("threshold"))).select("client_id", "attack_subtype")


@query("a33_auroc_invariance", f"WITH {OBS}, d AS (SELECT client_id, score, count(*) FILTER (WHERE label = 'benign') AS b, count(*) FILTER (WHERE label = 'attack') AS a FROM obs GROUP BY 1, 2), c AS (SELECT *, coalesce(sum(b) OVER (PARTITION BY client_id ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM d) SELECT client_id, round(sum(a * (below + b / 2.0::DOUBLE)) / (sum(a) * sum(b))::DOUBLE, 9) AS auroc, 0.0::DOUBLE AS spread FROM c GROUP BY 1")
def auroc_invariance(spark, sf_dir):
    """The areas under two policies' evaluations, which their thresholds cannot move; an error if they did."""
    obs = observations(spark, sf_dir)
    each = obs.select("*", F.explode(F.array(F.lit("equal_rate"), F.lit("equal_alert"))).alias("policy"))
    areas = evaluate.auroc(each, ["client_id", "policy"])
    spread = evaluate.invariant_areas(areas, ["client_id"])
    return rounded(areas.where(F.col("policy") == "equal_rate").select("client_id", "auroc").join(spread, "client_id"))


@query("j05_merge_decisions", f"WITH {CURVE}, {ELIGIBLE} SELECT client_id, CASE WHEN eligible THEN 0.03::DOUBLE ELSE {BUDGET}::DOUBLE END AS target_rate, NOT eligible AS fallback FROM el")
def merge_decisions(spark, sf_dir):
    """Fallback clients take the budget's rate, the others what was optimised for them (here a fixed rate)."""
    el = frontier.eligibility(curve(spark, sf_dir), min_client=165)
    fallback = el.where(~F.col("eligible")).select("client_id", F.lit(BUDGET).alias("target_rate"))
    optimised = el.where("eligible").select("client_id", F.lit(0.03).alias("target_rate"))
    return lookups.merge_decisions(el, fallback, optimised)


@query("a16_weighted_cost", f"WITH {OBS}, {SPLIT}, {CLIENTS}, {WEIGHT} SELECT round(sum(weight * 0.02::DOUBLE), 9) AS cost, sum(weight * 0.02::DOUBLE) <= {BUDGET}::DOUBLE + 1e-12 AS feasible FROM w")
def weighted_cost(spark, sf_dir):
    s = split_scores(spark, sf_dir)
    return rounded(frontier.weighted_cost(equal_decisions(s), benign_weights(s), BUDGET))


LONG = frontier.long_grid()


@query("a04_long_grid", "WITH " + CURVE.replace(GRID_SQL, "grid AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {a!r}::DOUBLE)" for i, a in enumerate(LONG)) + ") g(grid_ix, target_rate))") + f" SELECT client_id, grid_ix, {r9('target_rate', 'target_rate')}, {r9('threshold', 'threshold')}, attack_subtype, tp, fn FROM cf")
def long_frontier(spark, sf_dir):
    """The frontier over all 207 rates."""
    return rounded(frontier.confusions(split_scores(spark, sf_dir), LONG))


@query("a48_worst_fallback", f"WITH {CURVE}, {ELIGIBLE} SELECT round(avg((NOT eligible)::INT), 9) AS worst, avg((NOT eligible)::INT) > 0.1 AS warning FROM el")
def worst_fallback(spark, sf_dir):
    s = split_scores(spark, sf_dir)
    one = frontier.fallback_budget(frontier.eligibility(frontier.confusions(s), min_client=165), benign_weights(s), BUDGET)
    return rounded(infer.worst_fallback(one, 0.1))


@query("a37_policy_means", SEEDS + " SELECT budget_id, round(avg(macro_recall), 9) AS mean FROM fu WHERE policy = 'equal_alert' GROUP BY 1")
def policy_means(spark, sf_dir):
    return rounded(infer.policy_means(seed_evaluations(spark, sf_dir), "equal_alert", "macro_recall"))


@query("a38_operating_points", SEEDS + ", p AS (SELECT seed, client_id, avg(recall) AS macro_recall, any_value(target_rate) AS target_rate, any_value(threshold) AS threshold, any_value(fpr) AS fpr FROM res WHERE policy = 'equal_alert' AND budget_id = 'b2' GROUP BY 1, 2) SELECT client_id, round(avg(target_rate), 9) AS target_rate, " + r9("avg(threshold)", "threshold") + ", round(avg(fpr), 9) AS fpr, round(avg(macro_recall), 9) AS macro_recall FROM p GROUP BY 1")
def operating_points(spark, sf_dir):
    return rounded(evaluate.operating_points(seed_results(seed_scores(spark, sf_dir)), "equal_alert", "b2"))


def all_policies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = splits.split_rows(observations(spark, sf_dir), keys=("seed", "client_id"))
    return policies.run_all(s, benign_weights(s), SEED_BUDGETS, min_client=30, min_rows=10)


@query("o10_all_policies")
def run_of_all_policies(spark, sf_dir):
    """Every policy at every seed and budget. The optimised ones are found by a solver, so SQL has no say."""
    return rounded(all_policies(spark, sf_dir)[1].select("seed", "budget_id", "policy", "status", *FLEET))


@query("o14_primary_policies")
def primary_policies(spark, sf_dir):
    return rounded(infer.primary(all_policies(spark, sf_dir)[1].where(F.col("status") == "COMPLETED")))


@query("o15_guardrail")
def guardrail(spark, sf_dir):
    return rounded(infer.guardrail(all_policies(spark, sf_dir)[1].where(F.col("status") == "COMPLETED")))


@query("e10_event_budget_rows")
def event_budget_rows(spark, sf_dir):
    """Thresholds by bisection, device by device, and what their events come to."""
    return rounded(events.budget_rows(observations(spark, sf_dir), (0.05, 0.2)), 6)


E20 = f"WITH {OBS}, {CLIENTS}, bu AS (SELECT * FROM (VALUES ('b1', 0.05::DOUBLE), ('b2', 0.02::DOUBLE)) b(budget_id, target_rate)),\n" + theta_sql("th", "SELECT client_id, score FROM obs WHERE label = 'benign'", "SELECT client_id, budget_id, target_rate FROM cl, bu")


@query("e20_event_tables", E20 + f", {event_sql('client_id, budget_id', 'SELECT o.client_id, th.budget_id, o.t FROM obs o JOIN th USING (client_id) WHERE o.score > th.threshold')} SELECT client_id, budget_id, count(*) AS all_events FROM ev GROUP BY 1, 2")
def event_run(spark, sf_dir):
    tables = events.event_tables(observations(spark, sf_dir), {"b1": 0.05, "b2": 0.02}, {k: v[:1] for k, v in STEPS.items()}, (0.05,))
    return tables["metrics"].where(F.col("all_events") > 0).select("client_id", "budget_id", "all_events")


@query("j08_gain_heterogeneity", SEEDS + ", g AS (SELECT a.seed, avg(a.macro_recall - b.macro_recall) AS gain FROM fu a JOIN fu b ON a.seed = b.seed AND a.budget_id = b.budget_id AND a.policy = 'equal_alert' AND b.policy = 'equal_rate' GROUP BY 1), h AS (SELECT seed, stddev_pop(macro_recall) AS heterogeneity FROM pc WHERE policy = 'equal_rate' AND budget_id = 'b2' AND seed < 2 GROUP BY 1) SELECT seed, round(gain, 9) AS gain, round(heterogeneity, 9) AS heterogeneity FROM g JOIN h USING (seed)")
def gain_heterogeneity(spark, sf_dir):
    """Each seed's gain beside the spread of its clients' recalls; one seed has no spread on record."""
    d = infer.paired_differences(seed_evaluations(spark, sf_dir), "equal_alert", "equal_rate", "macro_recall").groupBy("seed").agg(F.avg("diff").alias("gain"))
    clients = evaluate.per_client(seed_results(seed_scores(spark, sf_dir)).where((F.col("policy") == "equal_rate") & (F.col("budget_id") == "b2")), ("seed",))
    spread = clients.where(F.col("seed") < 2).groupBy("seed").agg(F.stddev_pop("macro_recall").alias("aggregate"))
    return rounded(lookups.gain_and_heterogeneity(d, spread))


@query("a39_seed_gain", SEEDS + ", g AS (SELECT a.seed, avg(a.macro_recall - b.macro_recall) AS gain FROM fu a JOIN fu b ON a.seed = b.seed AND a.budget_id = b.budget_id AND a.policy = 'equal_alert' AND b.policy = 'equal_rate' GROUP BY 1) SELECT seed, round(gain, 9) AS gain FROM g")
def seed_gain(spark, sf_dir):
    d = infer.paired_differences(seed_evaluations(spark, sf_dir), "equal_alert", "equal_rate", "macro_recall")
    return rounded(d.groupBy("seed").agg(F.avg("diff").alias("gain")))


def _contrast_sql(metric: str, tag: str) -> str:
    return PAIRS.replace("macro_recall", metric).replace(", df AS", f", df{tag} AS").replace("FROM df ", f"FROM df{tag} ").replace(" sd AS", f" sd{tag} AS").replace("FROM sd,", f"FROM sd{tag},").replace(" sf AS", f" sf{tag} AS").replace("FROM sf ", f"FROM sf{tag} ").replace(" tp AS", f" tp{tag} AS")


@query("o14_primary_inference", SEEDS + _contrast_sql("macro_recall", "1") + _contrast_sql("worst_recall", "2") + ", u AS (SELECT 'macro_recall' AS metric, * FROM tp1 UNION ALL SELECT 'worst_recall', * FROM tp2), r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY p, budget_id) AS k, count(*) OVER (PARTITION BY metric) AS m FROM u) SELECT metric, budget_id, round(mean, 9) AS mean, round(p, 9) AS p, round(max(least(1.0, (m - k + 1) * p)) OVER (PARTITION BY metric ORDER BY k), 9) AS adjusted, bool_and(p <= 0.05::DOUBLE / (m - k + 1)) OVER (PARTITION BY metric ORDER BY k) AS rejected FROM r")
def primary_inference(spark, sf_dir):
    evals = seed_evaluations(spark, sf_dir)
    tests = None
    for metric in ("macro_recall", "worst_recall"):
        one = infer.sign_flip(infer.paired_differences(evals, "equal_alert", "equal_rate", metric)).withColumn("metric", F.lit(metric))
        tests = one if tests is None else tests.unionByName(one)
    return rounded(infer.holm(tests, family=["metric"]).select("metric", "budget_id", "mean", "p", "adjusted", "rejected"))


def _view_sql(validation: str, test: str) -> str:
    inner = SPLIT.replace("sp AS (", "sp0 AS (", 1)
    return f"WITH {OBS}, {inner}, sp AS (SELECT * FROM sp0 WHERE NOT (split = 'attack_validation' AND attack_subtype <> '{validation}') AND NOT (split = 'attack_test' AND attack_subtype <> '{test}')), {CLIENTS}, {WEIGHT},\n{result_sql(EQUAL)},\n" + fleet_sql("", f"{BUDGET}::DOUBLE").rstrip()


@query("o25_family_transfer", "SELECT * FROM (" + _view_sql("error", "purchase") + " SELECT 'error to purchase' AS direction, " + ", ".join(r9(c, c) for c in FLEET) + " FROM fu) UNION ALL SELECT * FROM (" + _view_sql("purchase", "error") + " SELECT 'purchase to error' AS direction, " + ", ".join(r9(c, c) for c in FLEET) + " FROM fu)")
def family_transfer(spark, sf_dir):
    s = split_scores(spark, sf_dir)
    out = None
    for a, b in (("error", "purchase"), ("purchase", "error")):
        v = splits.restrict_subtypes(s, [a], [b])
        one = evaluate.fleet(evaluate.per_client(equal_results(v)), benign_weights(v), BUDGET).select(F.lit(f"{a} to {b}").alias("direction"), *FLEET)
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query("o22_conservative_allocation")
def conservative_allocation(spark, sf_dir):
    s = split_scores(spark, sf_dir)
    util = scoring.conservative_utilities(frontier.confusions(s))
    n = s.where(F.col("split").isin(*evaluate.CALIBRATION)).groupBy("client_id").agg(F.count("*").alias("n_cal"))
    forbidden = frontier.resolution_guard(frontier.grid_frame(s), n)
    weights = frontier.equal_weights(s.select("client_id").distinct())
    macro = policies.allocate(policies.problem_points(util, weights, BUDGET), "macro").withColumn("policy", F.lit("macro"))
    return macro.unionByName(policies.allocate(policies.problem_points(util, weights, BUDGET, forbidden), "minimax").withColumn("policy", F.lit("minimax")))


@query("d10_completion", SEEDS + ", e AS (SELECT seed, budget_id, policy FROM (SELECT DISTINCT seed FROM obs), (VALUES ('b1'), ('b2'), ('b3'), ('b4')) b(budget_id), (VALUES ('equal_rate'), ('equal_alert')) p(policy)), s AS (SELECT CASE WHEN f.seed IS NULL THEN 'MISSING' WHEN usage <= 1.1 THEN 'VALID' ELSE 'MALFORMED' END AS state FROM e LEFT JOIN fu f USING (seed, budget_id, policy)) SELECT count(*) AS cells, count(*) FILTER (WHERE state = 'VALID') AS valid, count(*) FILTER (WHERE state = 'MISSING') AS missing, count(*) FILTER (WHERE state = 'MALFORMED') AS malformed, CASE WHEN count(*) FILTER (WHERE state = 'MISSING') = count(*) THEN 'NOT_STARTED' WHEN count(*) FILTER (WHERE state = 'MALFORMED') > 0 THEN 'FAILED' WHEN count(*) FILTER (WHERE state = 'MISSING') > 0 THEN 'EXECUTION_INCOMPLETE' ELSE 'PASSED' END AS state FROM s")
def completion(spark, sf_dir):
    """Expected cells of seeds, budgets and policies against what has been evaluated; one budget is never run."""
    evals = seed_evaluations(spark, sf_dir)
    cells = F.explode(F.array(*map(F.lit, [*SEED_BUDGETS, "b4"]))).alias("budget_id")
    expected = observations(spark, sf_dir).select("seed").distinct().select("seed", cells).select("seed", "budget_id", F.explode(F.array(F.lit("equal_rate"), F.lit("equal_alert"))).alias("policy"))
    return checks.progress(checks.completion(expected, evals, ["seed", "budget_id", "policy"], F.col("usage") <= 1.1))


DIGEST_CELLS = " || '|' || ".join(f"coalesce(length({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("ordinal", "label", "attack_subtype"))


@query("d04_partition_digest", f"WITH {OBS}, {SPLIT} SELECT client_id, split, count(*) AS n, CAST(sum(CAST('0x' || substr(md5({DIGEST_CELLS}), 1, 15) AS UBIGINT)) AS VARCHAR) AS digest FROM sp GROUP BY 1, 2")
def partition_digest(spark, sf_dir):
    return checks.digest(split_scores(spark, sf_dir), ["client_id", "split"], ["ordinal", "label", "attack_subtype"])


def _prefixed_sql(columns: tuple[str, ...]) -> str:
    one = "coalesce(unhex(format('{{:016x}}', octet_length(encode({c}::VARCHAR)))) || encode({c}::VARCHAR), unhex('ffffffffffffffff'))"
    return " || ".join(one.format(c=c) for c in columns)


@query(
    "f07_ordered_digest",
    f"""WITH {OBS}, {SPLIT},
h AS (SELECT client_id, split, row_number() OVER (PARTITION BY client_id, split ORDER BY ordinal) - 1 AS i, sha256({_prefixed_sql(("ordinal", "label", "attack_subtype"))}) AS h FROM sp),
l AS (SELECT client_id, split, i // 1024 AS g, count(*) AS w, sha256(unhex(string_agg(h, '' ORDER BY i))) AS h FROM h GROUP BY 1, 2, 3),
r AS (SELECT client_id, split, CAST(sum(w) AS BIGINT) AS n, CASE WHEN count(*) = 1 THEN min(h) ELSE sha256(unhex(string_agg(h, '' ORDER BY g))) END AS h FROM l GROUP BY 1, 2)
SELECT client_id, split, n, sha256(unhex(format('{{:016x}}', n)) || unhex(h)) AS digest FROM r""",
)
def ordered_digest(spark, sf_dir):
    return ordering.ordered_digest(split_scores(spark, sf_dir), ["client_id", "split"], ["ordinal"], ["ordinal", "label", "attack_subtype"])


@query(
    "d10_completion_states",
    SEEDS
    + """, e AS (SELECT seed, budget_id, policy, 'd' || seed AS digest FROM fu),
s AS (
  SELECT seed, budget_id, policy, 'evaluation' AS part, CASE WHEN seed = 1 AND budget_id = 'b2' THEN 'old' ELSE 'd' || seed END AS digest, usage <= 1.1 AS ok FROM fu WHERE NOT (budget_id = 'b3' AND policy = 'equal_alert')
  UNION ALL SELECT seed, budget_id, policy, 'results', 'd' || seed, true FROM fu WHERE NOT (seed = 0 AND budget_id = 'b1')),
c AS (
  SELECT e.seed, e.budget_id, e.policy, CASE WHEN count(*) FILTER (WHERE part = 'evaluation') = 0 THEN 'MISSING' WHEN count(DISTINCT part) < 2 THEN 'INCOMPLETE' WHEN bool_or(s.digest <> e.digest) THEN 'STALE' WHEN NOT bool_and(ok) THEN 'MALFORMED' ELSE 'VALID' END AS state
  FROM e LEFT JOIN s ON (s.seed, s.budget_id, s.policy) = (e.seed, e.budget_id, e.policy) GROUP BY 1, 2, 3)
SELECT seed, budget_id, policy, state FROM c""",
)
def completion_states(spark, sf_dir):
    """Cells of two parts, some without one, some made of an older input, some over their budget."""
    keys, of_seed = ["seed", "budget_id", "policy"], F.concat(F.lit("d"), F.col("seed").cast("string"))
    evals = staged(seed_evaluations(spark, sf_dir).select(*keys, "usage"), "evaluations")
    old = F.when((F.col("seed") == 1) & (F.col("budget_id") == "b2"), "old").otherwise(of_seed)
    one = evals.where(~((F.col("budget_id") == "b3") & (F.col("policy") == "equal_alert"))).select(*keys, F.lit("evaluation").alias("part"), old.alias("digest"), (F.col("usage") <= 1.1).alias("ok"))
    two = evals.where(~((F.col("seed") == 0) & (F.col("budget_id") == "b1"))).select(*keys, F.lit("results").alias("part"), of_seed.alias("digest"), F.lit(True).alias("ok"))
    return incremental.cell_states(evals.select(*keys, of_seed.alias("digest")), one.unionByName(two), keys, "evaluation", ["results"])


@query("d06_refreshed_totals", f"WITH {OBS} SELECT client_id, count(*) AS n, round(sum(score), 4) AS total FROM obs WHERE client_id <> 'c1' OR ordinal % 2 = 0 GROUP BY 1")
def refreshed_totals(spark, sf_dir):
    """Totals of all devices, and again when one device has lost half of its rows: only that one is worked out anew."""
    path, obs = new_path(spark, "cells"), observations(spark, sf_dir).select("client_id", "ordinal", "score")
    total = lambda own: own.groupBy("client_id").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"))
    incremental.refresh(spark, path, obs, ["client_id"], ["ordinal"], total)
    again = incremental.refresh(spark, path, obs.where((F.col("client_id") != "c1") | (F.pmod("ordinal", F.lit(2)) == 0)), ["client_id"], ["ordinal"], total)
    assert {r["client_id"] for r in again.collect()} <= {"c1"}
    return incremental.outputs(spark, path, ["client_id"])


@query("u06_repeated_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(spark, sf_dir):
    return checks.repeated(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_orderkey", "l_linenumber"])


@query("u04_unmatched_keys", "SELECT k AS c_custkey, side FROM (SELECT c_custkey AS k, 'left' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'right' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))")
def unmatched_keys(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("c_custkey"))
    return checks.unmatched(c, o, ["c_custkey"])
