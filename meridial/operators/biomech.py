"""Report documents: scalar metrics, derived features and mechanical labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridial.functions.rows import number

# Offsets (ms after foot strike) at which dwell is measured.
DWELL_MS = tuple(range(10, 121, 10))


def report_scalars(reports: DataFrame, report: str) -> DataFrame:
    """``report, metric, measurement, value`` of scalar results, the first of their values.

    ``reports`` has ``results`` (array of id, type and data: measurement,
    values), as ``spark.read.json`` with multiLine reads it.
    """
    r = reports.select(report, F.explode("results").alias("r")).where("r.type = 'scalar'")
    return r.select(report, F.col("r.id").alias("metric"), F.explode("r.data").alias("d")).select(report, "metric", F.col("d.measurement").alias("measurement"), F.get("d.values", F.lit(0)).alias("value")).where("value IS NOT NULL")


def fastballs(measurements: DataFrame, *, name: str = "Fastball", comment: str = "comment") -> DataFrame:
    """Measurements whose id has the name, with the velocity that the comment is, if it is a number."""
    return measurements.where(F.contains("measurement", F.lit(name))).withColumn("velocity", number(comment))


def report_means(scalars: DataFrame, report: str, measurements: DataFrame | None = None) -> DataFrame:
    """Mean of every metric over a report's (chosen) measurements."""
    rows = scalars if measurements is None else scalars.join(measurements.select(report, "measurement").distinct(), [report, "measurement"], "left_semi")
    return rows.groupBy(report, "metric").agg(F.avg("value").alias("value"))


def velocity_summary(pitches: DataFrame, report: str, velocity: str = "velocity") -> DataFrame:
    v = F.col(velocity)
    return pitches.groupBy(report).agg(F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("count"))


def report_features(means: DataFrame, report: str, metrics: Sequence[str], derived: Mapping[str, Column]) -> DataFrame:
    """One row a report: the named metrics as columns (missing: null) and features derived from them."""
    wide = means.groupBy(report).pivot("metric", list(metrics)).agg(F.first("value"))
    return wide.select("*", *(c.alias(n) for n, c in derived.items()))


def ratio(a: Column | str, b: Column | str) -> Column:
    """Null if either is null or the denominator is 0."""
    return F.try_divide(a, b)


def dwell_ms(means: DataFrame, report: str, pattern: str, *, threshold: float = -20.0) -> DataFrame:
    """The largest offset whose mean is at most the threshold, 0 if there is none.

    ``pattern`` has the offset in its first group.
    """
    ms = F.regexp_extract("metric", pattern, 1).try_cast("int")
    hit = F.when(ms.isin(*DWELL_MS) & (F.col("value") <= threshold), ms)
    return means.groupBy(report).agg(F.coalesce(F.max(hit), F.lit(0)).alias("dwell_ms"))


def labels(rules: Mapping[str, Column]) -> Column:
    """The names of all rules that hold, in their order; unknown counts as not holding."""
    return F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))


def plant_and_drive(df: DataFrame, keys: Sequence[str], side: str, value: str, right_handed: Column) -> DataFrame:
    """Means of the plant (front) and the drive leg: a right-hander plants the left leg."""
    planted = F.when(right_handed, F.lit("l")).otherwise(F.lit("r"))
    mine = F.lower(F.substring(side, 1, 1))
    return df.groupBy(*keys).agg(F.avg(F.when(mine == planted, F.col(value))).alias("plant_mean"), F.avg(F.when(mine != planted, F.col(value))).alias("drive_mean"))


# Bands of the metrics in order, the first that holds a value applies: low (included), high (not included), status.
BANDS: dict[str, list[tuple[float | None, float | None, str]]] = {
    "stride_pct": [(85, None, "Elite"), (80, 85, "Strength"), (75, 80, "Watch"), (None, 75, "Flag")],
    "separation_fs": [(50, 60, "Elite"), (40, 60, "Strength"), (30, 40, "Watch"), (None, 30, "Flag"), (65, None, "Watch")],
    "trunk_product": [(380, None, "Elite"), (300, 380, "Strength"), (200, 300, "Watch"), (None, 200, "Flag")],
    "knee_extension": [(15, 25, "Elite"), (10, 15, "Watch"), (None, 10, "Flag"), (25, None, "Strength")],
    "lead_grf": [(2.0, None, "Elite"), (1.7, 2.0, "Strength"), (1.3, 1.7, "Watch"), (None, 1.3, "Flag")],
    "forward_flex": [(30, 40, "Elite"), (40, 50, "Strength"), (25, 30, "Watch"), (None, 25, "Flag"), (50, None, "Watch")],
    "lateral_tilt": [(30, 45, "Elite"), (25, 30, "Strength"), (15, 25, "Watch"), (None, 15, "Flag")],
    "dwell_ms": [(60, None, "Elite"), (40, 60, "Strength"), (20, 40, "Watch"), (None, 20, "Flag")],
    "back_grf": [(1.7, None, "Elite"), (1.5, 1.7, "Strength"), (1.3, 1.5, "Watch"), (None, 1.3, "Flag")],
    "lead_braking": [(None, -1.0, "Elite"), (-1.0, -0.8, "Strength"), (-0.8, -0.6, "Watch"), (-0.6, None, "Flag")],
    "elbow_torque": [(80, 110, "Safe"), (110, 120, "Watch"), (120, 130, "Top of normal"), (130, None, "Caution")],
    "stress_per_mph": [(None, 1.2, "Healthy"), (1.2, 1.35, "Watch"), (1.35, None, "Elevated")],
    "shoulder_distraction": [(0.8, 1.1, "Game effort"), (0.5, 0.8, "Possibly sub-max"), (None, 0.5, "Likely sub-max")],
    "pelvis_stop_ms": [(None, 140, "Elite"), (140, 180, "Typical"), (180, None, "Late")],
    "rotation_fs": [(None, 25, "Late"), (25, 40, "Typical"), (40, 60, "Arm-early"), (60, None, "Severely arm-early")],
    "max_rotation": [(170, 190, "Elite"), (190, 200, "Slightly above"), (None, 170, "Below")],
}
#: The metrics of the eight cylinders, by which a profile is called strong.
CYLINDERS = ("stride_pct", "separation_fs", "trunk_product", "knee_extension", "forward_flex", "dwell_ms", "back_grf", "stress_per_mph")

# What a report must show to fit an archetype: metric, comparison, bound. Where the profile is in
# words only ("low", "early"), the bound is that of the status band or of the opposite profile.
ARCHETYPES: dict[str, list[tuple[str, str, float]]] = {
    "model arm": [("n_strong", ">=", 8), ("stress_per_mph", "<=", 1.25), ("trunk_product", ">=", 350)],
    "sequenced thrower": [("pelvis_fs", "<", 200), ("separation_fs", "<", 50), ("amplification", "<=", 1.2)],
    "rubber band": [("pelvis_fs", ">=", 200), ("separation_fs", ">=", 50), ("amplification", ">=", 1.4)],
    "arm thrower": [("knee_extension", "<", 10), ("stress_per_mph", ">=", 1.35), ("hand_amplification", ">=", 1.0)],
    "trunk-dumper": [("trunk_product", ">=", 380), ("forward_flex", ">", 50), ("amplification", "<", 1.4)],
    "short-strider": [("stride_pct", "<", 75), ("separation_fs", ">", 65)],
    "quiet-trunk": [("trunk_product", "<", 200), ("forward_flex", "<", 25)],
    "sub-max capture": [("shoulder_distraction", "<", 0.5), ("velocity_sd", "<", 0.3)],
    "developmental": [("n_flags", ">=", 3), ("pelvis_peak", ">=", 900)],
}


def status_of(metric: Column | str, value: Column | str, bands: Mapping[str, Sequence[tuple]] = BANDS) -> Column:
    """The status of a value in the bands of its metric, ``Neutral`` outside all of them; null without a value.

    The bands are a literal that is looked up in the row, so nothing is joined.
    """
    number = lambda x: F.lit(None if x is None else float(x)).cast("double")
    rows = [x for name, of in bands.items() for x in (F.lit(name), F.array(*(F.struct(number(a).alias("low"), number(z).alias("high"), F.lit(s).alias("status")) for a, z, s in of)))]
    value = F.col(value) if isinstance(value, str) else value
    held = F.filter(F.try_element_at(F.create_map(*rows), F.col(metric) if isinstance(metric, str) else metric), lambda b: (F.coalesce(value >= b["low"], F.lit(True))) & (F.coalesce(value < b["high"], F.lit(True))))
    return F.when(value.isNotNull(), F.coalesce(F.get(held, F.lit(0))["status"], F.lit("Neutral")))


def cylinder_counts(values: Mapping[str, Column]) -> dict[str, Column]:
    """``n_strong`` and ``n_flags``: how many of the eight cylinders are at least Strength (or Healthy), and how many are flagged (or Elevated)."""
    statuses = [F.coalesce(status_of(F.lit(m), values[m]), F.lit("")) for m in CYLINDERS]
    count = lambda names: sum((s.isin(*names).cast("int") for s in statuses), F.lit(0))
    return {"n_strong": count(("Elite", "Strength", "Healthy")), "n_flags": count(("Flag", "Elevated"))}


def archetypes_of(values: Mapping[str, Column], rules: Mapping[str, Sequence[tuple[str, str, float]]] = ARCHETYPES) -> Column:
    """The archetypes that a report's metrics fit, in their order; a missing metric fits none."""
    compare = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    holds = {}
    for name, conditions in rules.items():
        rule = F.lit(True)
        for metric, op, bound in conditions:
            rule = rule & compare[op](values[metric], F.lit(float(bound)))
        holds[name] = rule
    return labels(holds)


# Names of features and of the report metrics whose means they are.
MEASURES: dict[str, str] = {
    "stride_pct_height": "STRIDE_LENGTH_MEAN_PERCENT",
    "stride_length_m": "STRIDE_LENGTH",
    "hss_fs": "Trunk Rot wrt Pelvis Rot@Footstrike",
    "hss_mer": "Trunk Rot wrt Pelvis Rot@Max_Shoulder_Rot",
    "hss_release": "Trunk Rot wrt Pelvis Rot@Release",
    "sagittal_trunk_vel_mph": "MaxTrunkLinearVel_MPH_Y",
    "trunk_forward_flex_rel": "Trunk_Angle@Release_X",
    "lateral_tilt": "Trunk_Angle@Release_Y",
    "rotation_z": "Trunk_Angle@Release_Z",
    "lead_knee_fs": "Lead_Knee_Angle@Footstrike_X",
    "lead_knee_release": "Lead_Knee_Angle@Release_X",
    "lead_knee_mer": "Lead_Knee_Angle@Max_Shoulder_Rot_X",
    "lead_leg_vert_grf_release": "Lead GRF_BW@Release_Z",
    "lead_leg_vert_grf_fs": "Lead GRF_BW@Footstrike_Z",
    "lead_leg_braking_fs": "Lead GRF_BW@Footstrike_Y",
    "lead_leg_braking_release": "Lead GRF_BW@Release_Y",
    "back_leg_grf_max": "Back_Leg_GRF_mag_max",
    "hz_abd_fs": "Pitching_Shoulder_Angle@Footstrike_X",
    "hz_abd_mer": "Pitching_Shoulder_Angle@Max_Shoulder_Rot_X",
    "hz_abd_release": "Pitching_Shoulder_Angle@Release_X",
    "er_fs": "Pitching_Shoulder_Angle@Footstrike_Z",
    "max_er_mer": "Pitching_Shoulder_Angle@Max_Shoulder_Rot_Z",
    "elbow_torque_mer_nm": "Elbow_Torque_Nm@Max_Shoulder_Rot",
    "elbow_torque_release_nm": "Elbow_Torque_Nm@Release",
    "max_elbow_force_bw": "Max_Elbow_Force",
    "shoulder_distraction_n": "Shoulder_Force_Abd_N@Max_Shoulder_Abd_Force_N",
    "shoulder_distraction_bw": "Shoulder_Force_Abd@Max_Shoulder_Abd_Force",
    "pelvis_ang_vel_peak": "Pelvis_Ang_Vel_max",
    "thorax_ang_vel_peak": "Thorax_Ang_Vel_max",
    "humerus_ang_vel_peak": "Pitching_Humerus_Ang_Vel_max",
    "shoulder_ang_vel_peak": "Pitching_Shoulder_Ang_Vel_max",
    "elbow_ang_vel_peak": "Pitching_Elbow_Ang_Vel_max",
    "hand_ang_vel_peak": "Pitching_Hand_Ang_Vel_max",
    "pelvis_lin_x_mph": "MaxPelvisLinearVel_MPH_X",
    "pelvis_lin_y_mph": "MaxPelvisLinearVel_MPH_Y",
    "pelvis_lin_z_mph": "MaxPelvisLinearVel_MPH_Z",
    "trunk_lin_x_mph": "MaxTrunkLinearVel_MPH_X",
    "trunk_lin_z_mph": "MaxTrunkLinearVel_MPH_Z",
    "pelvis_peak_time": "MaxPelvisVelTime",
    "thorax_peak_time": "MaxThoraxVelTime",
    "humerus_peak_time": "MaxHumerusVelTime",
    "hand_peak_time": "MaxHandVelTime",
    "fs_time": "FootstrikeTime",
    "release_time": "ReleaseTime",
    "pelv_ang_vel_mkh": "Pelvis_Ang_Vel@MaxKneeHeight_X",
    "pelv_ang_vel_fs": "Pelvis_Ang_Vel@Footstrike_X",
    "pelv_ang_vel_mer": "Pelvis_Ang_Vel@Max_Shoulder_Rot_X",
    "pelv_stop_time": "PelvisRot_StopTime",
    "back_knee_mkh": "Back_Knee_Angle@MaxKneeHeight_X",
    "back_knee_fs": "Back_Knee_Angle@Footstrike_X",
    "back_knee_mer": "Back_Knee_Angle@Max_Shoulder_Rot_X",
    "back_knee_release": "Back_Knee_Angle@Release_X",
    "velocity_mph": "velocity",
}
# Features derived of two others; ``ms`` is a difference of seconds in thousandths.
DERIVED: dict[str, tuple[str, str, str]] = {
    "product": ("sagittal_trunk_vel_mph", "*", "trunk_forward_flex_rel"),
    "lead_knee_extension": ("lead_knee_fs", "-", "lead_knee_release"),
    "delta_back_knee_fs_to_mer": ("back_knee_mer", "-", "back_knee_fs"),
    "stress_per_mph": ("elbow_torque_mer_nm", "/", "velocity_mph"),
    "amp_pelvis_to_thorax": ("thorax_ang_vel_peak", "/", "pelvis_ang_vel_peak"),
    "amp_thorax_to_humerus": ("humerus_ang_vel_peak", "/", "thorax_ang_vel_peak"),
    "amp_humerus_to_hand": ("hand_ang_vel_peak", "/", "humerus_ang_vel_peak"),
    "pelvis_peak_rel_fs_ms": ("pelvis_peak_time", "ms", "fs_time"),
    "thorax_peak_rel_fs_ms": ("thorax_peak_time", "ms", "fs_time"),
    "humerus_peak_rel_fs_ms": ("humerus_peak_time", "ms", "fs_time"),
    "hand_peak_rel_fs_ms": ("hand_peak_time", "ms", "fs_time"),
    "pelv_stop_after_fs_ms": ("pelv_stop_time", "ms", "fs_time"),
}


def report_profile(means: DataFrame, report: str) -> DataFrame:
    """One row a report with all ``MEASURES`` and ``DERIVED`` features; what is missing, or would divide by 0, is null.

    Names of metrics hold dots and spaces, so the pivot is on the features' names.
    """
    feature = F.create_map(*(F.lit(x) for name, metric in MEASURES.items() for x in (metric, name)))
    named = means.withColumn("_f", F.try_element_at(feature, "metric")).where("_f IS NOT NULL")
    wide = named.groupBy(report).pivot("_f", list(MEASURES)).agg(F.first("value"))
    joined = {"*": lambda a, b: a * b, "-": lambda a, b: a - b, "/": ratio, "ms": lambda a, b: (a - b) * 1000}
    return wide.select("*", *(joined[op](F.col(a), F.col(b)).alias(name) for name, (a, op, b) in DERIVED.items()))
