"""Reading a whole screen: percentiles from published breakpoints, findings a test, and patterns over tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridial.operators.norms import interpolated_percentile
from meridial.operators.selection import KURTOSIS_IDEAL, RAMP_ELITE

# Ideal work (AUC) and its median of the screens, targets of the drop jump, share of early work.
AUC_ELITE = {"dj": 570.0, "cmj": 1260.0, "ppu": 700.0, "slv": 1030.0}
AUC_MEDIAN = {"dj": 327.0, "cmj": 561.0, "ppu": 326.0}
RSI_TARGET = 3.0
CONTACT_TARGET = 0.33
EARLY_WORK = 85.0
#: Metrics of which less is better.
INVERTED = ("ct",)


def read_breakpoints(spark: SparkSession, path: str) -> DataFrame:
    """``test, metric, pct, value, n`` of JSON files ``{test: {metric: {"5": value, ..., "n": count}}}``.

    Members that are not such objects (notes) are passed over, and so are values
    that are no numbers; ``n`` is null where it is not stated. One row a file is
    read, so a file is a table of published points, not data.
    """
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("_d"))
    tests = doc.select(F.explode("_d").alias("test", "_t")).select("test", F.explode(F.from_json("_t", "map<string,string>")).alias("metric", "_m"))
    points = tests.withColumn("_m", F.from_json("_m", "map<string,string>")).where(F.col("_m").isNotNull())
    n = F.try_element_at("_m", F.lit("n")).try_cast("long")
    rows = points.select("test", "metric", n.alias("n"), F.explode("_m").alias("_p", "_v"))
    out = rows.select("test", "metric", F.col("_p").try_cast("double").alias("pct"), F.col("_v").try_cast("double").alias("value"), "n")
    return out.where("pct IS NOT NULL AND value IS NOT NULL")


def screen_percentiles(values: DataFrame, breakpoints: DataFrame, *, test: str = "test", metric: str = "metric", value: str = "value", inverted: Sequence[str] = INVERTED) -> DataFrame:
    """``values`` with ``percentile`` in the published table and ``standing``, which is higher where an entity is better.

    ``standing`` is 100 less the percentile for ``inverted`` metrics (contact time).
    Values without a table of their test and metric have neither.
    """
    points = breakpoints.select(F.col("test").alias(test), F.col("metric").alias(metric), "pct", F.col("value"))
    out = interpolated_percentile(values, points, value, (test, metric))
    return out.withColumn("standing", F.when(F.col(metric).isin(*inverted), 100 - F.col("percentile")).otherwise(F.col("percentile")))


def best_trials(trials: DataFrame, entity: str, *, by: str = "pp_w_per_kg", test: str = "test", order: str) -> DataFrame:
    """The trial of each entity and test (and side, as tests of their own) with the most of ``by``, then least ``order``; nulls last."""
    best = F.max_by(F.struct(*trials.columns), F.struct(F.col(by).isNotNull(), F.col(by), -F.col(order)))
    return trials.groupBy(entity, test).agg(best.alias("_t")).select("_t.*")


def by_test(table: dict[str, float], test: Column) -> Column:
    """The value of a fixed table for a test; both sides of the single-leg jump share one."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), F.regexp_replace(test, "_(left|right)$", ""))


def dominance(force: Column, velocity: Column, apart: float) -> Column:
    gap = force - velocity
    return F.when(gap > apart, "force").when(gap < -apart, "velocity").when(gap.isNotNull(), "balanced")


def test_findings(screens: DataFrame, *, test: str = "test", apart: float = 15.0) -> DataFrame:
    """``screens`` (a row an entity and test) with columns of findings; each is null where its inputs are missing.

    ``auc_label`` is ``elite`` above the ideal, ``gap`` below the median (``below``
    for tests without a published one) and ``high`` between. ``spike`` is high peak
    power (80th percentile or above) over work below its median percentile, ``front_loaded`` more than 85 % early
    work without enough of it, ``late_ramp`` an elite ramp that comes late,
    ``no_range`` power over height by ``apart`` points in the push-up. The drop
    jump is ``reactive``, ``powerful`` (high, but long on the ground), ``quick``
    (short, but low) or ``neither``, and ``on_target`` by index and contact.
    Needs ``auc_j, kurtosis, rpd_max_w_per_s, work_early_pct, ct, rsi`` and the percentiles
    ``auc_pct, pp_pct, jh_pct, force_pct, velocity_pct, ramp_time_pct``.
    """
    t, c = F.col(test), F.col
    elite, median = by_test(AUC_ELITE, t), by_test(AUC_MEDIAN, t)
    auc = F.when(c("auc_j") > elite, "elite").when(c("auc_j") < median, "gap").when(median.isNull() & (c("auc_j") <= elite), "below").when(c("auc_j") <= elite, "high")
    low, high = (by_test({k: v[i] for k, v in KURTOSIS_IDEAL.items()}, t) for i in (0, 1))
    shape = F.when(c("kurtosis") < low, "flat").when(c("kurtosis") > high, "sharp").when(c("kurtosis").isNotNull() & low.isNotNull(), "ideal")
    short, tall = c("ct") <= CONTACT_TARGET, c("jh_pct") >= 50
    jump = F.when(short & tall, "reactive").when(tall & ~short, "powerful").when(short & ~tall, "quick").when(short.isNotNull() & tall.isNotNull(), "neither")
    return screens.withColumns(
        {
            "auc_label": auc,
            "shape": shape,
            "ramp_elite": c("rpd_max_w_per_s") > by_test(RAMP_ELITE, t),
            "dominance": dominance(c("force_pct"), c("velocity_pct"), apart),
            "spike": (c("pp_pct") >= 80) & (c("auc_pct") < 50),
            "front_loaded": (c("work_early_pct") > EARLY_WORK) & (c("auc_pct") < 50),
            "late_ramp": (c("rpd_max_w_per_s") > by_test(RAMP_ELITE, t)) & (c("ramp_time_pct") > 50),
            "no_range": F.when(t == "ppu", c("pp_pct") - c("jh_pct") > apart),
            "jump_kind": F.when(t == "dj", jump),
            "on_target": F.when(t == "dj", (c("rsi") >= RSI_TARGET) & short),
        }
    )


def _one(what: str, *tests: str, test: str) -> Column:
    """The value of ``what`` in one of ``tests``, null without it."""
    return F.max(F.when(F.col(test).isin(*tests), F.col(what)))


def screen_patterns(found: DataFrame, entity: str, *, test: str = "test", near: float = 10.0) -> DataFrame:
    """One row an entity with ``patterns``, a sorted array of what its tests say together.

    Takes the rows of ``test_findings``, one an entity and test (the single-leg jump as ``slv_left`` and ``slv_right``);
    of repeated rows the larger value counts. A pattern needs every test that it names.

    - ``arms_add_little``: height percentiles of drop and counter-movement jump within ``near`` points;
      ``arms_add``: the drop jump's is higher by more; ``reactive_limit``: it is lower by more.
    - ``bilateral_auc_gap``: work below its median in both; ``single_leg_only``: the drop jump below it, both legs elite.
    - ``upper_bottleneck``: work at its median or above in both jumps, below it in the push-up;
      ``upper_speed_strength``: the push-up force-dominant, both jumps balanced;
      ``force_dominant`` / ``velocity_dominant``: both jumps alike.
    - ``ramp_lost_on_one_leg``: an elite ramp in both jumps, on neither leg.
    - ``brief_everywhere``: peak power of 80 or more and work under 50 in all of two tests or more;
      ``peaker``: too sharp in two tests or more.
    """
    one = lambda what, *tests: _one(what, *tests, test=test)
    legs = ("slv_left", "slv_right")
    row = found.groupBy(entity).agg(
        *(one(f"{m}_pct", name).alias(f"_{m}_{name}") for m in ("jh", "auc") for name in ("dj", "cmj", "ppu")),
        *(one("dominance", name).alias(f"_fv_{name}") for name in ("dj", "cmj", "ppu")),
        *(one("ramp_elite", name).alias(f"_ramp_{name}") for name in ("dj", "cmj", *legs)),
        *(one("auc_label", name).alias(f"_label_{name}") for name in legs),
        F.count_if("spike").alias("_spikes"),
        F.count_if(F.col("pp_pct").isNotNull() & F.col("auc_pct").isNotNull()).alias("_read"),
        F.count_if(F.col("shape") == "sharp").alias("_sharp"),
    )
    c = F.col
    height = c("_jh_dj") - c("_jh_cmj")
    both = lambda a, b: a & b
    rules = {
        "arms_add_little": F.abs(height) <= near,
        "arms_add": height > near,
        "reactive_limit": height < -near,
        "bilateral_auc_gap": both(c("_auc_dj") < 50, c("_auc_cmj") < 50),
        "single_leg_only": (c("_auc_dj") < 50) & (c("_label_slv_left") == "elite") & (c("_label_slv_right") == "elite"),
        "upper_bottleneck": (c("_auc_dj") >= 50) & (c("_auc_cmj") >= 50) & (c("_auc_ppu") < 50),
        "upper_speed_strength": (c("_fv_ppu") == "force") & (c("_fv_dj") == "balanced") & (c("_fv_cmj") == "balanced"),
        "force_dominant": (c("_fv_dj") == "force") & (c("_fv_cmj") == "force"),
        "velocity_dominant": (c("_fv_dj") == "velocity") & (c("_fv_cmj") == "velocity"),
        "ramp_lost_on_one_leg": c("_ramp_dj") & c("_ramp_cmj") & ~c("_ramp_slv_left") & ~c("_ramp_slv_right"),
        "brief_everywhere": (c("_read") >= 2) & (c("_spikes") == c("_read")),
        "peaker": c("_sharp") >= 2,
    }
    named = F.array_sort(F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items()))))
    return row.select(entity, named.alias("patterns"))


def leg_roles(found: DataFrame, entity: str, throws: str, *, test: str = "test", large: float = 0.25) -> DataFrame:
    """One row an entity with both legs: ``plant, drive`` (work, in joules), ``gap`` and ``verdict``.

    Right-handed: the left leg is the plant leg. A plant leg that does more is
    ``expected``, as is an even pair; ``drive_leads`` says that the drive leg does
    more. A drive leg that lacks more than ``large`` of the plant leg's work or
    force is ``monitor``: tracked, not corrected. Null sides or hands: no row.
    """
    side = lambda what, s: F.max(F.when(F.col(test) == f"slv_{s}", F.col(what)))
    legs = found.groupBy(entity).agg(F.max(F.lower(F.trim(throws))).alias("_hand"), *(side(w, s).alias(f"_{w}_{s}") for w in ("auc_j", "force_at_pp") for s in ("left", "right")))
    right = F.col("_hand").startswith("r")
    plant = {w: F.when(right, F.col(f"_{w}_left")).otherwise(F.col(f"_{w}_right")) for w in ("auc_j", "force_at_pp")}
    drive = {w: F.when(right, F.col(f"_{w}_right")).otherwise(F.col(f"_{w}_left")) for w in ("auc_j", "force_at_pp")}
    lacks = [plant[w] - drive[w] > large * plant[w] for w in plant]
    verdict = F.when(F.coalesce(lacks[0], F.lit(False)) | F.coalesce(lacks[1], F.lit(False)), "monitor").when(drive["auc_j"] > plant["auc_j"], "drive_leads").otherwise("expected")
    rows = legs.where(F.col("_hand").isNotNull() & F.col("_auc_j_left").isNotNull() & F.col("_auc_j_right").isNotNull())
    return rows.select(entity, plant["auc_j"].alias("plant"), drive["auc_j"].alias("drive"), (plant["auc_j"] - drive["auc_j"]).alias("gap"), verdict.alias("verdict"))
