"""The metric catalogue, and its compiler: definitions become one un-pivot of each source.

A definition says where a metric's values are (a column, a key of a JSON
object, the difference of two keys), which rows count and what is done to a
value. ``compiled`` makes ``facts.Metric`` of them; a source's JSON is parsed
once a row, for the keys that its definitions name and no others.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from meridial.functions.rows import FIRST_OR_SOLE, not_prefixed, number, recode, scaled, side_is
from meridial.operators import facts, norms


@dataclass(frozen=True)
class Definition:
    """One metric.

    ``kind`` is ``json`` (``field`` is a key), ``json_diff`` (``field`` less
    ``less``), ``column``, ``flag`` (a truth value as 0 or 1), ``grades`` (a column
    whose values 1, 2 and 3 stand for ``grades``; one record each, no mean),
    ``movement`` (a column where ``movement`` and ``position`` are as wanted) or
    ``side`` (a column of one side's rows).
    """

    key: str
    modality: str
    applies_to: str
    source: str
    kind: str
    field: str
    less: str | None = None
    absolute: bool = False
    scale: float = 1.0
    grades: tuple[float, ...] = ()
    movement: str | None = None
    movement_whole: bool = False
    position: str | None = None
    position_not: str | None = None
    side: str | None = None

    @property
    def keys(self) -> tuple[str, ...]:
        """The JSON keys that it needs."""
        return tuple(k for k in (self.field, self.less) if k) if self.kind in ("json", "json_diff") else ()


# The definitions. A JSON key has its axis behind a dot.
_PITCHING_JSON = """
pitch_max_horizontal_abduction|PROCESSED.Pitching_Shoulder_Angle@Footstrike.X
pitch_arm_er_timing_at_fc_xyz|PROCESSED.Pitching_Shoulder_Angle_XYZ@Footstrike.Z
pitch_arm_timing_at_fc_simple|PROCESSED.Pitching_Shoulder_Angle@Footstrike.Z
pitch_max_external_rotation_xyz|PROCESSED.Pitching_Shoulder_Angle_XYZ@Max_Shoulder_Rot.Z
pitch_max_external_rotation_simple|PROCESSED.Pitching_Shoulder_Angle_Max.Z
pitch_peak_abduction|PROCESSED.Pitching_Shoulder_Angle_Min.X
pitch_pelvis_rotation_at_fc|PROCESSED.Pelvis_Angle@Footstrike.Z
pitch_trunk_rotation_at_fc|PROCESSED.Trunk_Angle@Footstrike.Z
pitch_trunk_flexion_at_release|PROCESSED.Trunk_Angle@Release.X
pitch_lead_knee_at_fc|PROCESSED.Lead_Knee_Angle@Footstrike.X
pitch_lead_knee_at_release|PROCESSED.Lead_Knee_Angle@Release.X
pitch_hip_shoulder_sep_at_fc|PROCESSED.Hip Shoulders Sep@Footstrike.Z
pitch_pelvis_ang_vel_max|KINEMATIC_SEQUENCE.Pelvis_Ang_Vel_max.X
pitch_thorax_ang_vel_max|KINEMATIC_SEQUENCE.Thorax_Ang_Vel_max.X
pitch_humerus_ang_vel_max|KINEMATIC_SEQUENCE.Pitching_Humerus_Ang_Vel_max.X
pitch_hand_ang_vel_max|KINEMATIC_SEQUENCE.Pitching_Hand_Ang_Vel_max.X
pitch_time_max_pelvis_vel|TIMING.MaxPelvisVelTime.X
pitch_time_max_thorax_vel|TIMING.MaxThoraxVelTime.X
pitch_time_max_humerus_vel|TIMING.MaxHumerusVelTime.X
pitch_time_max_hand_vel|TIMING.MaxHandVelTime.X
pitch_lead_leg_grf_mag_midpoint|PROCESSED.Lead_Leg_GRF_mag_Midpoint_FS_Release.X
pitch_lead_leg_grf_mag_max|PROCESSED.Lead_Leg_GRF_mag_max.X
pitch_lead_leg_grf_max_z|PROCESSED.Lead_Leg_GRF_max.Z
pitch_max_pelvis_linear_vel_mph|PROCESSED.MaxPelvisLinearVel_MPH.X
pitch_stride_length|STRIDE_LENGTH.STRIDE_LENGTH.X
pitch_stride_length_mean_percent|STRIDE_LENGTH.STRIDE_LENGTH_MEAN_PERCENT.X
pitch_trunk_rot_wrt_pelvis_at_fc|PROCESSED.Trunk Rot wrt Pelvis Rot@Footstrike.X
pitch_max_trunk_linear_vel_mph_y|PROCESSED.MaxTrunkLinearVel_MPH.Y
pitch_trunk_cog_vel_at_release_mph_y|PROCESSED.Trunk_COG_Vel@Release_MPH.Y
pitch_trunk_lateral_at_release|PROCESSED.Trunk_Angle@Release.Y
pitch_trunk_lateral_at_fc|PROCESSED.Trunk_Angle@Footstrike.Y
pitch_back_leg_grf_mag_max|PROCESSED.Back_Leg_GRF_mag_max.X
pitch_elbow_torque_nm_at_max_er|PROCESSED.Elbow_Torque_Nm@Max_Shoulder_Rot.X
pitch_max_elbow_varus_torque_nm|PROCESSED.Max_Elbow_Varus_Torque_Nm.X
pitch_shoulder_force_abd_at_max|PROCESSED.Shoulder_Force_Abd@Max_Shoulder_Abd_Force.X
pitch_pelvis_ang_vel_at_fc|PROCESSED.Pelvis_Ang_Vel@Footstrike.X
pitch_pelvis_ang_vel_at_max_er|PROCESSED.Pelvis_Ang_Vel@Max_Shoulder_Rot.X
pitch_pelvis_rot_stop_time|TIMING.PelvisRot_StopTime.X
pitch_back_knee_at_fc|PROCESSED.Back_Knee_Angle@Footstrike.X
pitch_back_knee_at_max_er|PROCESSED.Back_Knee_Angle@Max_Shoulder_Rot.X
pitch_back_knee_at_release|PROCESSED.Back_Knee_Angle@Release.X
pitch_pelvis_obliquity_at_fc|PROCESSED.Pelvis_Angle@Footstrike.Y
pitch_pelvis_obliquity_at_release|PROCESSED.Pelvis_Angle@Release.Y
pitch_release_time|TIMING.ReleaseTime.X
pitch_max_shoulder_rot_time|TIMING.Max_Shoulder_RotTime.X
pitch_time_max_pelvis_to_max_thorax|PROCESSED.time_MaxPelvisVel_MaxThoraxVel.X
pitch_max_elbow_vel_time|TIMING.MaxElbowVelTime.X
pitch_shoulder_y_at_fc|PROCESSED.Pitching_Shoulder_Angle@Footstrike.Y
pitch_shoulder_y_at_max_er|PROCESSED.Pitching_Shoulder_Angle@Max_Shoulder_Rot.Y
pitch_elbow_flex_at_max_er|PROCESSED.Pitching_Elbow_Angle@Max_Shoulder_Rot.X
pitch_elbow_ang_vel_max|KINEMATIC_SEQUENCE.Pitching_Elbow_Ang_Vel_max.X
pitch_shoulder_at_fc_120ms_x|INCREMENT.Pitching_Shoulder_Angle@Footstrike_120ms.X
pitch_hss_at_fc_120ms_z|INCREMENT.Hip Shoulders Sep@Footstrike_120ms.Z
"""
_PITCHING_DIFFERENCES = """
pitch_front_leg_extension|PROCESSED.Lead_Knee_Angle@Footstrike.X|PROCESSED.Lead_Knee_Angle@Release.X
pitch_pelvic_obliquity_total|PROCESSED.Pelvis_Angle@Release.Y|PROCESSED.Pelvis_Angle@Footstrike.Y
pitch_total_trunk_flexion|PROCESSED.Trunk_Angle@Release.X|PROCESSED.Trunk_Angle@Footstrike.X
pitch_time_to_max_abduction_ms|TIMING.MaxShoulderHorAngleTime.X|TIMING.FootstrikeTime.X|1000
"""
_PITCHING_FORCE = """
pitch_force_lead_peak_vertical_bw|lead_peak_vertical_bw
pitch_force_lead_peak_braking_bw|lead_peak_braking_bw
pitch_force_lead_peak_resultant_bw|lead_peak_resultant_bw
pitch_force_peak_v_to_b_lag_ms|peak_v_to_peak_b_lag_ms
pitch_force_lead_peak_vertical_pct_fc_br|lead_peak_vertical_pct_fc_br
pitch_force_lead_time_to_peak_fz_ms|lead_time_to_peak_fz_ms
pitch_force_lead_rfd_vertical_bw_per_s|lead_rfd_vertical_bw_per_s
pitch_force_lead_rfd_braking_bw_per_s|lead_rfd_braking_bw_per_s
pitch_force_lead_impulse_v_into_ball_bws|lead_impulse_v_into_ball_bws
pitch_force_lead_impulse_b_into_ball_bws|lead_impulse_b_into_ball_bws
pitch_force_lead_fz_at_midpoint_bw|lead_fz_at_midpoint_bw
"""
_HITTING_JSON = """
hit_horizontal_attack_angle_at_contact|PLANE.Horizontal_attack_angle
hit_vertical_attack_angle_at_contact|PLANE.Vertical_attack_angle
hit_bat_angle_frontal_at_contact|PLANE.Bat_Angle_Frontal@Contact
hit_bat_angle_sagittal_at_contact|PLANE.Bat_Angle_Sagittal@Contact
hit_bat_angle_transversal_at_contact|PLANE.Bat_Angle_Transversal@Contact
hit_bat_travelled_distance_max|PROCESSED.Bat_travelled_distance_max
hit_pelvis_at_contact|PROCESSED.Pelvis_Angle@Contact
hit_trunk_at_contact|PROCESSED.Trunk_Angle@Contact
hit_hip_shoulder_sep_at_setup|PROCESSED.Pelvis_Shoulders_Separation@Setup
"""
# Each of these has a second metric: key and field with _mean and _MEAN behind them.
_HITTING_WITH_MEANS = """
hit_max_pelvis_ang_vel|PROCESSED.Max_Pelvis_Ang_Vel
hit_max_thorax_ang_vel|PROCESSED.Max_Thorax_Ang_Vel
hit_max_lead_forearm_ang_vel|PROCESSED.Max_Lead_Forearm_Ang_Vel
hit_max_lead_hand_ang_vel|PROCESSED.Max_Lead_Hand_Ang_Vel
hit_max_bat_ang_vel|PROCESSED.Max_Bat_Ang_Vel
hit_max_rpv_cgpos_linear_vel|PROCESSED.Max_RPV_CGPos_VLab_Linear_Vel
hit_max_rta_cgpos_linear_vel|PROCESSED.Max_RTA_CGPos_VLab_Linear_Vel
hit_lead_knee_at_lead_foot_down|PROCESSED.Lead_Knee_Angle@Lead_Foot_Down
hit_lead_knee_at_contact|PROCESSED.Lead_Knee_Angle@Contact
hit_lead_knee_ang_vel_ext_max|PROCESSED.Lead_Knee_Ang_Vel_ext_max
hit_pelvis_at_lead_foot_down|PROCESSED.Pelvis_Angle@Lead_Foot_Down
hit_pelvis_shoulders_sep_at_lead_foot_down|PROCESSED.Pelvis_Shoulders_Separation@Lead_Foot_Down
hit_pelvis_shoulders_sep_at_downswing|PROCESSED.Pelvis_Shoulders_Separation@Downswing
hit_pelvis_shoulders_sep_at_max_bat_ang_vel|PROCESSED.Pelvis_Shoulders_Separation@Max_Bat_Ang_Vel
hit_pelvis_shoulders_sep_at_max_lead_hand_ang_vel|PROCESSED.Pelvis_Shoulders_Separation@Max_Lead_Hand_Ang_Vel
hit_pelvis_shoulders_sep_at_contact|PROCESSED.Pelvis_Shoulders_Separation@Contact
hit_trunk_at_lead_foot_down|PROCESSED.Trunk_Angle@Lead_Foot_Down
hit_stride_width_at_lead_foot_down|PROCESSED.Stride_Width@Lead_Foot_Down
"""
_HITTING_DIFFERENCES = """
hit_lead_leg_block_delta|PROCESSED.Lead_Knee_Angle@Contact|PROCESSED.Lead_Knee_Angle@Lead_Foot_Down
hit_pelvis_total_rotation|PROCESSED.Pelvis_Angle@Contact|PROCESSED.Pelvis_Angle@Lead_Foot_Down
hit_trunk_total_rotation|PROCESSED.Trunk_Angle@Contact|PROCESSED.Trunk_Angle@Lead_Foot_Down
"""
# Columns and what their grades 1, 2 and 3 stand for, if they are grades; misspelt names are the columns' own.
_MOBILITY = """
cervical_rotation|55|65|75
cervical_flexion|37|42|48
cervical_extension|55|65|75
cervical_lateral_flexion|37|42|48
horizontal_abduction|27|32|38
shoulder_ir|27|35|42
shoulder_er|112|120|128
shoulder_stability_flexion|11|17.5|25
shoulder_stability_abduction|10|15|21
shoulder_stability_er_at_0_deg_horiz_abuduction|6|10|14
shoulder_stability_ir_at_0_deg_horiz_abduction|8|13|18
elbow_extension|7|3|0
elbow_flexion|122|130|138
elbow_pronation|65|71|78
elbow_supination|67|75|83
grip_strength_r|45|57|70
gs_l|45|57|70
grip_strength_r_at_90|40|52|63
gs_l_at_90|40|52|63
ankle_dorsiflextion_to_wall|27|32|38
ankle_manual_test|27|32|38
sittiing_t_spine_pvc_r|57|67|78
sittiing_t_spine_pvc_l|57|68|78
hamstring_stretch|67|75|83
r_prone_hip_ir|27|32|38
r_prone_hip_er|27|33|38
l_prone_hip_ir|27|33|38
l_prone_hip_er|27|33|38
prone_hamstring_raise|17|22|28
glute_strength_test_prone_hammy_push|27|32|38
mid_trap|7|12|17
low_trap|7|12|17
back_to_wall_shoulder_flexion
pelvic_tilt_against_wall
radial_nerve_glide
ulnar_nerve_glide
backbend
slump_test
thomas_test_hip_flexor_r
thomas_test_hip_flexor_l
young_stretch_passive
hip_pinch
isa
"""
_MOVEMENT_COLUMNS = "power_high power_mean velocity_high velocity_mean acceleration_high acceleration_mean"
_SCREEN_COLUMNS = "jh_in pp_w_per_kg vel_at_pp force_at_pp auc_j kurtosis rpd_max_w_per_s time_to_rpd_max_s"
_DROP_JUMP_COLUMNS = "rsi ct"


def _rows(text: str) -> list[list[str]]:
    return [line.split("|") for line in text.strip().splitlines()]


def _pitching() -> Iterable[Definition]:
    of = ("pitching", "pitcher", "pitching_trials")
    yield from (Definition(k, *of, "json", f) for k, f in _rows(_PITCHING_JSON))
    yield Definition("pitch_lead_leg_grf_min_y_abs", *of, "json", "PROCESSED.Lead_Leg_GRF_min.Y", absolute=True)
    yield Definition("pitch_ball_release_speed", *of, "column", "velocity_mph")
    force = ("pitching_force", "pitcher", "pitching_force_metrics")
    yield from (Definition(k, *force, "column", c) for k, c in _rows(_PITCHING_FORCE))
    yield Definition("pitch_force_peaks_before_mer", *force, "flag", "peaks_before_mer_flag")
    yield from (Definition(k, *of, "json_diff", f, less, scale=float(scale[0]) if scale else 1.0) for k, f, less, *scale in _rows(_PITCHING_DIFFERENCES))


def _hitting() -> Iterable[Definition]:
    of = ("hitting", "hitter", "hitting_trials")
    yield from (Definition(k, *of, "json", f) for k, f in _rows(_HITTING_JSON))
    for k, f in _rows(_HITTING_WITH_MEANS):
        yield Definition(k, *of, "json", f)
        yield Definition(f"{k}_mean", *of, "json", f"{f}_MEAN")
    yield from (Definition(k, *of, "json_diff", f, less) for k, f, less in _rows(_HITTING_DIFFERENCES))


def _movements() -> Iterable[Definition]:
    for role, wanted in (("pitcher", {"position": "pitcher"}), ("hitter", {"position_not": "pitcher"})):
        other = ("d2_extension", "D2 Extension", False) if role == "pitcher" else ("trunk_rotation", "Straight Arm Trunk Rotation", True)
        for name, movement, whole in (("shotput", "Shot Put", False), other):
            for c in _MOVEMENT_COLUMNS.split():
                yield Definition(f"proteus_{role}_{name}_{c}", f"proteus_{role}", role, "proteus", "movement", c, movement=movement, movement_whole=whole, **wanted)


def _screens() -> Iterable[Definition]:
    for test in ("cmj", "ppu", "dj"):
        for c in (_SCREEN_COLUMNS + (" " + _DROP_JUMP_COLUMNS if test == "dj" else "")).split():
            yield Definition(f"screen_{test}_{c}", f"athletic_screen_{test}", "both", f"screen_{test}", "column", c)
    for side in ("left", "right"):
        for c in _SCREEN_COLUMNS.split():
            yield Definition(f"screen_slv_{side}_{c}", "athletic_screen_slv", "both", "screen_slv", "side", c, side=side)


CATALOGUE: tuple[Definition, ...] = (
    *_pitching(),
    *_hitting(),
    *(Definition(f"mob_{c}", "mobility", "both", "mobility", "grades", c, grades=tuple(map(float, grades))) for c, *grades in _rows(_MOBILITY)),
    *_movements(),
    *_screens(),
)

#: Where a source's JSON object is, and where it is kept once it is parsed.
_OBJECT, _PARSED = "metrics", "_parsed"


def _json_value(key: str) -> Column:
    """The number under a key: of an array its first element, of a number or its text itself, else null."""
    return number(F.regexp_extract(F.col(_PARSED).getField(key), FIRST_OR_SOLE, 1))


def _value(d: Definition) -> tuple[Column, Column | None]:
    """What a definition takes of a row, and which rows count."""
    if d.kind == "json":
        return scaled(_json_value(d.field), absolute=d.absolute, scale=d.scale), None
    if d.kind == "json_diff":
        return scaled(_json_value(d.field) - _json_value(d.less), absolute=d.absolute, scale=d.scale), None
    if d.kind == "flag":
        return F.col(d.field).cast("int"), None
    if d.kind == "grades":
        return recode(d.field, dict(enumerate(d.grades, 1))), None
    if d.kind == "movement":
        where = F.col("movement") == d.movement if d.movement_whole else F.ilike("movement", F.lit(f"%{d.movement}%"))
        where = where & (F.ilike("position", F.lit(f"{d.position}%")) if d.position else not_prefixed("position", d.position_not))
        return F.col(d.field), where
    if d.kind == "side":
        return F.col(d.field), side_is("side", d.side[0])
    if d.kind == "column":
        return F.col(d.field), None
    raise ValueError(f"no such kind of metric: {d.kind}")


def compiled(definitions: Iterable[Definition] = CATALOGUE) -> list[facts.Metric]:
    """The definitions as expressions over ``parsed`` sources."""
    return [facts.Metric(d.source, d.modality, d.key, *_value(d), applies_to=d.applies_to, per_record=d.kind == "grades") for d in definitions]


def parsed(source: DataFrame, definitions: Iterable[Definition]) -> DataFrame:
    """The source with its JSON parsed for the keys of the definitions; a text that is no object gives nulls."""
    keys = sorted({k for d in definitions for k in d.keys})
    if not keys:
        return source
    # values as they are written: an array or an object stays text
    schema = StructType([StructField(k, StringType()) for k in keys])
    return source.withColumn(_PARSED, F.from_json(_OBJECT, schema)).drop(_OBJECT)


def values_by_catalogue(sources: dict[str, DataFrame], definitions: Iterable[Definition] = CATALOGUE, *, role: str = "both", entity: str = "entity", date: str = "session_date") -> DataFrame:
    """``entity, session_date, modality, metric_key, value`` of all metrics for a role, one scan a source.

    ``sources`` are tables with ``entity``, ``session_date`` and the columns that
    the definitions name; a source that is not given has no values. Null
    values do not count, and a session without any has no row.
    """
    definitions = [d for d in definitions if d.source in sources and (role == "both" or d.applies_to in (role, "both"))]
    read = {s: parsed(sources[s], [d for d in definitions if d.source == s]) for s in dict.fromkeys(d.source for d in definitions)}
    return facts.session_values(read, compiled(definitions), entity, date)


def norms_by_catalogue(sources: dict[str, DataFrame], people: DataFrame, definitions: Iterable[Definition] = CATALOGUE, *, entity: str = "entity", approximate: bool = False) -> DataFrame:
    """Norms of every metric and age group: ``people`` has ``entity`` and ``age_group``.

    A session's values stay in one row until its group is known; then equal
    values of a metric and group are counted, and all statistics come of counts.
    """
    if approximate:
        values = values_by_catalogue(sources, definitions, entity=entity)
        return norms.norm_stats(values.join(people.select(entity, "age_group"), entity), ["modality", "metric_key", "age_group"], approximate=True)
    definitions = [d for d in definitions if d.source in sources]
    every, order = None, []
    for name in dict.fromkeys(d.source for d in definitions):
        mine = [d for d in definitions if d.source == name]
        # the outer form, of which Spark infers no filter on the array that it would copy to the source
        for wide, metrics in facts.wide_values(parsed(sources[name], mine), compiled(mine), entity):
            held = wide.join(people.select(entity, "age_group"), entity).select("age_group", F.posexplode_outer("_v").alias("_i", "value")).where("value IS NOT NULL")
            held = held.select((F.col("_i") + F.lit(len(order))).alias("_m"), "age_group", "value")
            order += [(m.modality, m.key) for m in metrics]
            every = held if every is None else every.unionByName(held)
    counts = every.groupBy("_m", "age_group", "value").agg(F.count("*").alias("_n"))
    said = lambda i: F.get(F.array(*(F.lit(o[i]) for o in order)), F.col("_m"))
    out = norms.counted_stats(counts, ["_m", "age_group"])
    return out.select(said(0).alias("modality"), said(1).alias("metric_key"), *out.columns[1:])
