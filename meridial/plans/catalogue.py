"""The metric catalogue over stand-in sources: every order is a record of each source.

The i-th field of a source holds ``(o_orderkey * (i + 3)) % 991`` in some rows,
grades in some, and nothing in the others; JSON values come in every shape that
a source may have. The oracles take each metric by a statement of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridial.functions import rows as X
from meridial.operators import catalogue as C
from meridial.plans.profiles import _GROUP, _STATS, groups, rounded
from meridial.plans.registry import ORACLES, QUERIES, Tables, query

_SOURCES = tuple(dict.fromkeys(d.source for d in C.CATALOGUE))
_COLUMNS = {s: tuple(dict.fromkeys(d.field for d in C.CATALOGUE if d.source == s and not d.keys)) for s in _SOURCES}
_KEYS = {s: tuple(dict.fromkeys(k for d in C.CATALOGUE if d.source == s for k in d.keys)) for s in _SOURCES}
_FLAGS = {d.field for d in C.CATALOGUE if d.kind == "flag"}
_MOVEMENTS = ("Shot Put", "PNF shot put test", "D2 Extension", "Straight Arm Trunk Rotation", "straight arm trunk rotation")
_POSITIONS = ("Pitcher", "pitcher/of", "C", None)
_SIDES = ("Left", "right", "L", "Right ")


def _picked(choices: tuple) -> Column:
    """Of the choices one by the order's key."""
    return F.get(F.array(*(F.lit(c).cast("string") for c in choices)), (F.col("o_orderkey") % len(choices)).cast("int"))


def _picked_sql(choices: tuple) -> str:
    return "[" + ", ".join("NULL" if c is None else f"'{c}'" for c in choices) + f"][(o_orderkey % {len(choices)} + 1)::INT]"


def _field(i: int, flag: bool = False) -> Column:
    """A value in 4 rows of 7, a grade (1, 2, 3) in 2 of them, else null."""
    k, shape = F.col("o_orderkey"), (F.col("o_orderkey") + i) % 7
    value = (k * (i + 3)) % 991
    return F.when(shape < 4, value % 2 == 0) if flag else F.when(shape < 2, (k % 3 + 1).cast("double")).when(shape < 4, value.cast("double"))


def _field_sql(i: int, flag: bool = False) -> str:
    shape, value = f"(o_orderkey + {i}) % 7", f"(o_orderkey * {i + 3}) % 991"
    return f"CASE WHEN {shape} < 4 THEN {value} % 2 = 0 END" if flag else f"CASE WHEN {shape} < 2 THEN (o_orderkey % 3 + 1)::DOUBLE WHEN {shape} < 4 THEN ({value})::DOUBLE END"


# A key's value as [n], [n, n], n, "n", null or an object; one row in 8 has no such key, one in 8 no number.
_SHAPES = ('"%k": [%v]', '"%k": [%v, 7]', '"%k": %v', '"%k": "%v"', '"%k": null', '"%k": {"a": %v}', '"%k": "AMRAP"')


def _entry(i: int, key: str) -> Column:
    value = F.concat(F.when((F.col("o_orderkey") + i) % 2 == 0, "-").otherwise(""), ((F.col("o_orderkey") * (i + 3)) % 991).cast("string"))
    parts = [_filled(shape.replace("%k", key), value) for shape in _SHAPES]
    # only the one that is meant is made
    return F.elt(((F.col("o_orderkey") + i) % 8 + 1).cast("int"), *parts, F.lit(None).cast("string"))


def _filled(shape: str, value: Column) -> Column:
    before, _, after = shape.partition("%v")
    return F.concat(F.lit(before), value, F.lit(after)) if "%v" in shape else F.lit(shape)


def _entry_sql(i: int, key: str) -> str:
    value = f"CASE WHEN (o_orderkey + {i}) % 2 = 0 THEN '-' ELSE '' END || ((o_orderkey * {i + 3}) % 991)::VARCHAR"
    parts = ["'" + shape.replace("%k", key).replace("%v", f"' || {value} || '") + "'" for shape in _SHAPES]
    return f"[{', '.join(parts)}][((o_orderkey + {i}) % 8 + 1)::INT]"


def _source(t: Tables, name: str) -> DataFrame:
    fields = [_field(i, c in _FLAGS).alias(c) for i, c in enumerate(_COLUMNS[name])]
    if _KEYS[name]:
        fields.append(F.concat(F.lit("{"), F.concat_ws(", ", *(_entry(i, k) for i, k in enumerate(_KEYS[name]))), F.lit("}")).alias("metrics"))
    if name == "proteus":
        fields += [_picked(_MOVEMENTS).alias("movement"), _picked(_POSITIONS).alias("position")]
    if name == "screen_slv":
        fields.append(_picked(_SIDES).alias("side"))
    return t.orders.select(F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("session_date"), *fields)


def _source_sql(name: str) -> str:
    fields = [f'{_field_sql(i, c in _FLAGS)} AS "{c}"' for i, c in enumerate(_COLUMNS[name])]
    if _KEYS[name]:
        text = "'{' || concat_ws(', ', " + ", ".join(_entry_sql(i, k) for i, k in enumerate(_KEYS[name])) + ") || '}'"
        # one parse for all keys: a list with a place for each
        fields.append(f"json_extract({text}, [" + ", ".join(f"'$.\"{k}\"'" for k in _KEYS[name]) + "]) AS j")
    if name == "proteus":
        fields += [f"{_picked_sql(_MOVEMENTS)} AS movement", f'{_picked_sql(_POSITIONS)} AS "position"']
    if name == "screen_slv":
        fields.append(f"{_picked_sql(_SIDES)} AS side")
    return f"{name} AS MATERIALIZED (SELECT o_custkey AS entity, o_orderdate::DATE AS session_date, {', '.join(fields)} FROM orders)"


def _metric_sql(d: C.Definition) -> str:
    """The values of one metric, as a statement of its own."""
    j = lambda k: f"j[{_KEYS[d.source].index(k) + 1}]"
    read = lambda k: f"CASE WHEN json_type({j(k)}) = 'ARRAY' THEN try_cast({j(k)}->>'$[0]' AS DOUBLE) WHEN json_type({j(k)}) <> 'OBJECT' THEN try_cast({j(k)}->>'$' AS DOUBLE) END"
    where, mean = [], True
    if d.keys:
        value = " - ".join(f"({read(k)})" for k in d.keys)
        value = (f"abs({value})" if d.absolute else f"({value})") + f" * {d.scale}"
        where = [f"{j(k)} IS NOT NULL" for k in d.keys]
    else:
        value, where = f'"{d.field}"', [f'"{d.field}" IS NOT NULL']
    if d.kind == "flag":
        value += "::INT"
    if d.kind == "grades":
        mean = False
        value = f"CASE {' '.join(f'WHEN {value} = {g} THEN {v}' for g, v in enumerate(d.grades, 1))} ELSE {value} END" if d.grades else value
    if d.kind == "movement":
        where.append(f"movement = '{d.movement}'" if d.movement_whole else f"movement ILIKE '%{d.movement}%'")
        where.append(f"\"position\" ILIKE '{d.position}%'" if d.position else f"(\"position\" IS NULL OR \"position\" NOT ILIKE '{d.position_not}%')")
    if d.kind == "side":
        where.append(f"lower(substr(side, 1, 1)) = '{d.side[0]}'")
    said = f"'{d.modality}' AS modality, '{d.key}' AS metric_key, entity, session_date"
    return f"SELECT {said}, {f'avg({value})' if mean else value}::DOUBLE AS value FROM {d.source} WHERE {' AND '.join(where)}" + (" GROUP BY entity, session_date" if mean else "")


def _norms_sql(definitions: list[C.Definition]) -> str:
    sources = ", ".join(_source_sql(s) for s in dict.fromkeys(d.source for d in definitions))
    values = " UNION ALL ".join(map(_metric_sql, definitions))
    return f"""WITH {sources}, s AS ({values}), g AS (SELECT c_custkey AS entity, {_GROUP} AS age_group FROM customer)
    SELECT modality, metric_key, age_group, {_STATS} FROM s JOIN g USING (entity) WHERE value IS NOT NULL GROUP BY ALL HAVING count(value) >= 5"""


def _norms(t: Tables, definitions: list[C.Definition]) -> DataFrame:
    sources = {s: _source(t, s) for s in dict.fromkeys(d.source for d in definitions)}
    return rounded(C.norms_by_catalogue(sources, groups(t), definitions))


def _of_kind(*kinds: str, source: str = "") -> list[C.Definition]:
    return [d for d in C.CATALOGUE if d.kind in kinds and d.source.startswith(source)]


#: Every kind of extract by itself, and all metrics together.
SUBSETS = {
    "catalogue_pitching_json": _of_kind("json", source="pitching"),
    "catalogue_hitting_json": _of_kind("json", source="hitting"),
    "catalogue_differences": _of_kind("json_diff"),
    "catalogue_columns": _of_kind("column", "flag", source="pitching"),
    "catalogue_screens": _of_kind("column", source="screen"),
    "catalogue_grades": _of_kind("grades"),
    "catalogue_movements": _of_kind("movement"),
    "catalogue_sides": _of_kind("side"),
    "catalogue_norms": list(C.CATALOGUE),
}
for _name, _definitions in SUBSETS.items():
    QUERIES[_name] = lambda spark, folder, d=_definitions: _norms(Tables(spark, folder), d)
    ORACLES[_name] = _norms_sql(_definitions)


_NESTED = ('{"a.b": {"c d": [%v, 7]}}', '{"a.b": {"c d": %v}}', '{"a.b": {"c d": "%v"}}', '{"a.b": {"c d": null}}', '{"a.b": [%v]}', '{"a.b": {"c d": {"e": %v}}}', '{"a.b": {"c d": "30d"}}', "{}")
_K = "json_extract_string(props, '$.k')"
_J = "[" + ", ".join("'" + s.replace("%v", f"' || coalesce({_K}, 'null') || '") + "'" for s in _NESTED) + "][(event_id % 8 + 1)::INT]"


@query(
    f"""WITH e AS (SELECT event_id, json_extract({_J}, '$."a.b"."c d"') AS v FROM events)
    SELECT event_id, CASE WHEN json_type(v) = 'ARRAY' THEN try_cast(v->>'$[0]' AS DOUBLE) WHEN json_type(v) <> 'OBJECT' THEN try_cast(v->>'$' AS DOUBLE) END AS number FROM e"""
)
def json_nested_number(t: Tables) -> DataFrame:
    """A number inside an object, in every shape."""
    k = F.coalesce(F.get_json_object("props", "$.k"), F.lit("null"))
    text = F.get(F.array(*(_filled(s, k) for s in _NESTED)), (F.col("event_id") % 8).cast("int"))
    return t.events.select("event_id", X.variant_number(F.parse_json(text), '$["a.b"]["c d"]').alias("number"))
