"""Screens over the driver's tables: five tests a customer, read from its order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridial.operators import screens as S
from meridial.plans.registry import R4, Tables, query, r4

_TESTS = ("dj", "cmj", "ppu", "slv_left", "slv_right")
_KEYS = ("(c * 7 + i * 13)", "(c * 11 + i * 29)", "(c * 5 + i * 31)", "(c * 17 + i * 3)", "(c * 23 + i * 19)", "(c * 29 + i * 7)")

# percentiles and raw values of a customer's tests, spread over the ranges that the rules look at
_FIELDS = {
    "pp_pct": f"{_KEYS[0]} % 101",
    "auc_pct": f"{_KEYS[1]} % 101",
    "jh_pct": f"CASE WHEN c % 13 = 0 THEN NULL ELSE {_KEYS[2]} % 101 END",
    "force_pct": f"{_KEYS[3]} % 101",
    "velocity_pct": f"{_KEYS[4]} % 101",
    "ramp_time_pct": f"{_KEYS[5]} % 101",
    "auc_j": f"CAST({_KEYS[1]} % 101 AS DOUBLE) * 14 + spent / 100000",
    "force_at_pp": f"1000 + CAST({_KEYS[3]} % 101 AS DOUBLE) * 15",
    "kurtosis": f"CAST({_KEYS[2]} % 40 AS DOUBLE) / 20 - 1.7",
    "rpd_max_w_per_s": f"CAST({_KEYS[0]} % 90 AS DOUBLE) * 500",
    "work_early_pct": f"CAST({_KEYS[4]} % 101 AS DOUBLE)",
    "ct": f"CAST({_KEYS[5]} % 50 AS DOUBLE) / 100 + 0.2",
    "rsi": f"CAST({_KEYS[3]} % 40 AS DOUBLE) / 10",
    "throws": "CASE c % 3 WHEN 0 THEN 'Right' WHEN 1 THEN ' left' END",
}
_SCREENS = f"""s AS (SELECT c, test, {', '.join(f'{x} AS {n}' for n, x in _FIELDS.items())} FROM (
    SELECT o_custkey AS c, i, test, sum(o_totalprice) / 1000 AS spent FROM (
      SELECT o_custkey, o_orderkey % 5 AS i, CASE o_orderkey % 5 WHEN 0 THEN 'dj' WHEN 1 THEN 'cmj' WHEN 2 THEN 'ppu' WHEN 3 THEN 'slv_left' ELSE 'slv_right' END AS test, o_totalprice FROM orders) o GROUP BY o_custkey, i, test) g)"""


def _screens(t: Tables) -> DataFrame:
    i = (F.col("o_orderkey") % 5).alias("i")
    test = F.element_at(F.array(*map(F.lit, _TESTS)), (F.col("i") + 1).cast("int"))
    spent = t.orders.select(F.col("o_custkey").alias("c"), i, "o_totalprice").groupBy("c", "i").agg((F.sum("o_totalprice") / 1000).alias("spent"))
    return spent.select("c", test.alias("test"), *(F.expr(x).alias(n) for n, x in _FIELDS.items()))


_BASE = "regexp_replace(test, '_(left|right)$', '')"
_ELITE = f"CASE {_BASE} WHEN 'dj' THEN 570 WHEN 'cmj' THEN 1260 WHEN 'ppu' THEN 700 WHEN 'slv' THEN 1030 END"
_RAMP = f"CASE {_BASE} WHEN 'dj' THEN 32700 WHEN 'cmj' THEN 25200 WHEN 'ppu' THEN 8000 WHEN 'slv' THEN 18200 END"
_FOUND = f"""f AS (SELECT *,
    CASE WHEN auc_j > {_ELITE} THEN 'elite' WHEN {_BASE} = 'slv' THEN 'below' WHEN auc_j < CASE test WHEN 'dj' THEN 327 WHEN 'cmj' THEN 561 ELSE 326 END THEN 'gap' ELSE 'high' END AS auc_label,
    CASE {_BASE} WHEN 'dj' THEN CASE WHEN kurtosis < -1.45 THEN 'flat' WHEN kurtosis > -1.1 THEN 'sharp' ELSE 'ideal' END WHEN 'cmj' THEN CASE WHEN kurtosis < -1.3 THEN 'flat' WHEN kurtosis > -0.4 THEN 'sharp' ELSE 'ideal' END
      WHEN 'ppu' THEN CASE WHEN kurtosis < -1.55 THEN 'flat' WHEN kurtosis > -1.25 THEN 'sharp' ELSE 'ideal' END ELSE CASE WHEN kurtosis < -1.0 THEN 'flat' WHEN kurtosis > -0.2 THEN 'sharp' ELSE 'ideal' END END AS shape,
    rpd_max_w_per_s > {_RAMP} AS ramp_elite,
    CASE WHEN force_pct - velocity_pct > 15 THEN 'force' WHEN velocity_pct - force_pct > 15 THEN 'velocity' ELSE 'balanced' END AS dominance,
    pp_pct >= 80 AND auc_pct < 50 AS spike, work_early_pct > 85 AND auc_pct < 50 AS front_loaded, rpd_max_w_per_s > {_RAMP} AND ramp_time_pct > 50 AS late_ramp,
    CASE WHEN test = 'ppu' THEN pp_pct - jh_pct > 15 END AS no_range,
    CASE WHEN test = 'dj' AND jh_pct IS NOT NULL THEN CASE WHEN ct <= 0.33 THEN CASE WHEN jh_pct >= 50 THEN 'reactive' ELSE 'quick' END WHEN jh_pct >= 50 THEN 'powerful' ELSE 'neither' END END AS jump_kind,
    CASE WHEN test = 'dj' THEN rsi >= 3 AND ct <= 0.33 END AS on_target FROM s)"""
_SHOWN = "auc_label, shape, ramp_elite, dominance, spike, front_loaded, late_ramp, no_range, jump_kind, on_target"


@query(f"WITH {_SCREENS}, {_FOUND} SELECT c, test, {_SHOWN} FROM f")
def screen_findings(t: Tables) -> DataFrame:
    return S.test_findings(_screens(t)).select("c", "test", *_SHOWN.split(", "))


@query(
    f"""WITH {_SCREENS}, {_FOUND}, d AS (SELECT * FROM f WHERE test = 'dj'), j AS (SELECT * FROM f WHERE test = 'cmj'), p AS (SELECT * FROM f WHERE test = 'ppu'), l AS (SELECT * FROM f WHERE test = 'slv_left'), r AS (SELECT * FROM f WHERE test = 'slv_right'),
    x AS (SELECT c, 'arms_add_little' AS p FROM d JOIN j USING (c) WHERE abs(d.jh_pct - j.jh_pct) <= 10
      UNION ALL SELECT c, 'arms_add' FROM d JOIN j USING (c) WHERE d.jh_pct - j.jh_pct > 10 UNION ALL SELECT c, 'reactive_limit' FROM d JOIN j USING (c) WHERE j.jh_pct - d.jh_pct > 10
      UNION ALL SELECT c, 'bilateral_auc_gap' FROM d JOIN j USING (c) WHERE d.auc_pct < 50 AND j.auc_pct < 50
      UNION ALL SELECT c, 'single_leg_only' FROM d JOIN l USING (c) JOIN r USING (c) WHERE d.auc_pct < 50 AND l.auc_label = 'elite' AND r.auc_label = 'elite'
      UNION ALL SELECT c, 'upper_bottleneck' FROM d JOIN j USING (c) JOIN p USING (c) WHERE d.auc_pct >= 50 AND j.auc_pct >= 50 AND p.auc_pct < 50
      UNION ALL SELECT c, 'upper_speed_strength' FROM d JOIN j USING (c) JOIN p USING (c) WHERE d.dominance = 'balanced' AND j.dominance = 'balanced' AND p.dominance = 'force'
      UNION ALL SELECT c, d.dominance || '_dominant' FROM d JOIN j USING (c) WHERE d.dominance = j.dominance AND d.dominance <> 'balanced'
      UNION ALL SELECT c, 'ramp_lost_on_one_leg' FROM d JOIN j USING (c) JOIN l USING (c) JOIN r USING (c) WHERE d.ramp_elite AND j.ramp_elite AND NOT l.ramp_elite AND NOT r.ramp_elite
      UNION ALL SELECT c, 'brief_everywhere' FROM f GROUP BY c HAVING count(*) >= 2 AND bool_and(spike)
      UNION ALL SELECT c, 'peaker' FROM f WHERE shape = 'sharp' GROUP BY c HAVING count(*) >= 2)
    SELECT c, coalesce((SELECT string_agg(p, ',' ORDER BY p) FROM x WHERE x.c = a.c), '') AS patterns FROM (SELECT DISTINCT c FROM s) a"""
)
def screen_patterns(t: Tables) -> DataFrame:
    return S.screen_patterns(S.test_findings(_screens(t)), "c").select("c", F.array_join("patterns", ",").alias("patterns"))


@query(
    f"""WITH {_SCREENS}, h AS (SELECT c, max(lower(trim(throws))) = 'right' AS r, max(auc_j) FILTER (test = 'slv_left') AS la, max(auc_j) FILTER (test = 'slv_right') AS ra, max(force_at_pp) FILTER (test = 'slv_left') AS lf, max(force_at_pp) FILTER (test = 'slv_right') AS rf FROM s GROUP BY c),
    q AS (SELECT c, CASE WHEN r THEN la ELSE ra END AS pa, CASE WHEN r THEN ra ELSE la END AS da, CASE WHEN r THEN lf ELSE rf END AS pf, CASE WHEN r THEN rf ELSE lf END AS df FROM h WHERE r IS NOT NULL AND la IS NOT NULL AND ra IS NOT NULL)
    SELECT c, {R4('pa')} AS plant, {R4('da')} AS drive, {R4('pa - da')} AS gap, CASE WHEN da < 0.75 * pa OR df < 0.75 * pf THEN 'monitor' WHEN da > pa THEN 'drive_leads' ELSE 'expected' END AS verdict FROM q"""
)
def leg_roles(t: Tables) -> DataFrame:
    legs = S.leg_roles(_screens(t), "c", "throws")
    return legs.select("c", *(r4(x).alias(x) for x in ("plant", "drive", "gap")), "verdict")


# breakpoints that Spark derives from the table: exact percentiles of the line prices by supplier and flag
_AT = (5, 10, 20, 25, 30, 40, 50, 60, 70, 75, 80, 85, 90, 95)
_POINTS = f"""q AS (SELECT (l_suppkey % 5)::VARCHAR AS test, l_returnflag AS metric, quantile_cont(l_extendedprice::DOUBLE, [{', '.join(str(p / 100) for p in _AT)}]) AS v FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL),
    b AS (SELECT test, metric, v, [{', '.join(map(str, _AT))}] AS p FROM q)"""


@query(
    f"""WITH {_POINTS}, x AS (SELECT l.*, v, p, len(list_filter(v, lambda y: y <= l_extendedprice)) AS k FROM lineitem l LEFT JOIN b ON test = (l_suppkey % 5)::VARCHAR AND metric = l_returnflag),
    y AS (SELECT *, CASE WHEN v IS NULL THEN NULL WHEN k = 0 THEN 5 WHEN k = 14 THEN 95 ELSE p[k] + (p[k + 1] - p[k]) * (l_extendedprice - v[k]) / (v[k + 1] - v[k]) END AS pc FROM x)
    SELECT l_orderkey, l_linenumber, {R4('pc')} AS percentile, {R4("CASE WHEN l_returnflag = 'R' THEN 100 - pc ELSE pc END")} AS standing FROM y"""
)
def screen_percentiles(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 5).cast("string").alias("test"), F.col("l_returnflag").alias("metric"), F.col("l_extendedprice").cast("double").alias("value"))
    at = F.percentile("value", F.array(*(F.lit(p / 100) for p in _AT)))
    held = lines.where("metric <> 'N'").groupBy("test", "metric").agg(at.alias("v"))
    pairs = F.arrays_zip(F.array(*(F.lit(float(p)) for p in _AT)).alias("pct"), F.col("v").alias("value"))
    points = held.select("test", "metric", F.explode(pairs).alias("x")).select("test", "metric", F.col("x.pct").alias("pct"), F.col("x.value").alias("value"))
    out = S.screen_percentiles(lines, points, inverted=("R",))
    return out.select("l_orderkey", "l_linenumber", r4("percentile").alias("percentile"), r4("standing").alias("standing"))
