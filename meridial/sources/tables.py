"""Reading, snapshotting and rewriting tables."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridial.functions.text import dose, taxonomy, template_id
from meridial.sources.scratch import written

#: Operational types and what they are stored as; anything else, and arrays of named base types, is text.
SNAPSHOT_TYPES = {
    "varchar": "string", "text": "string", "enum": "string", "uuid": "string", "int": "int", "bigint": "bigint", "smallint": "smallint", "boolean": "boolean",
    "numeric": "decimal(38,18)", "real": "float", "double": "double", "date": "date", "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "json": "string", "jsonb": "string", "bytea": "binary",
}


def jdbc_reader(spark: SparkSession, url: str, key: str, bounds: tuple[int, int], partitions: int, **options) -> Callable[[str], DataFrame]:
    """A reader of operational tables in parallel ranges of a numeric key."""
    return lambda table: spark.read.jdbc(url, table, column=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions, properties=options or None)


def as_types(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Columns cast by the operational types of a schema; what does not parse is null, other columns are text."""
    return df.select(*(F.col(c).cast("string").try_cast(SNAPSHOT_TYPES.get(types.get(c, ""), "string")).alias(c) for c in df.columns))


def reloaded(df: DataFrame, target: str, table: str) -> int:
    """Write a table anew as a version of its own, then point to it; returns its rows.

    Readers (``current``) see the old or the new whole, also if the write fails.
    The rows are counted by the write itself.
    """
    version, seen = uuid.uuid4().hex, Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{target}/{table}/{version}")
    rows = seen.get["n"]
    df.sparkSession.createDataFrame([(version, rows)], "version string, n long").coalesce(1).write.mode("overwrite").parquet(f"{target}/{table}/_current")
    return rows


def snapshot(reader: Callable[[str], DataFrame], tables: Sequence[str], target: str, spark: SparkSession) -> DataFrame:
    """Write each table to a new version below ``target``; returns the audit log of the run.

    A table's pointer (``<target>/<table>/_current``, a one-row table with the
    version and its count) is replaced only after its data are complete, so
    readers see the old or the new whole. A failure is logged and stays with
    its table.
    """
    log = []
    for name in tables:
        began, rows, error = time.time(), None, None
        try:
            rows = reloaded(reader(name), target, name)
        except Exception as e:  # noqa: BLE001  the next table must not suffer
            error = str(e).split("\n")[0][:500]
        log.append((name, "error" if error else "success", rows, round(time.time() - began, 3), error))
    return spark.createDataFrame(log, "table_name string, status string, n_rows long, seconds double, error string")


#: How the copy form writes null: without quotes, which every value has.
COPY_NULL = r"\N"
_QUOTED = r'"(?:[^"]|"")*+"'


def write_copy_form(df: DataFrame, path: str) -> int:
    """CSV in which every value is quoted and a null is not; returns the rows, counted by the write itself."""
    value = lambda c: F.concat(F.lit('"'), F.replace(F.col(f"`{c}`").cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))
    seen = Observation()
    rows = df.select(F.concat_ws(",", *(F.coalesce(value(c), F.lit(COPY_NULL)) for c in df.columns)).alias("value"))
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.text(path)
    return seen.get["n"]


def read_copy_form(spark: SparkSession, path: str, types: Mapping[str, str], *, line_ends: bool = True) -> DataFrame:
    r"""The table of files in copy form: ``types`` are the operational types of its columns, in order.

    ``\N`` without quotes is null; the same in quotes, an empty text, quotes and
    line ends are values. With ``line_ends`` a file is taken whole, as a record
    may have several lines; without, lines are records and large files are split.
    A record of fewer values has nulls, further values are left out.
    """
    if line_ends:
        files = spark.read.text(path, wholetext=True)
        records = files.select(F.explode(F.regexp_extract_all("value", F.lit(rf'(?:{_QUOTED}|[^"\n])++'), F.lit(0))).alias("value"))
    else:
        records = spark.read.text(path).where("value != ''")
    fields = F.regexp_extract_all(F.concat(F.lit(","), F.regexp_replace("value", r"\r$", "")), F.lit(rf',({_QUOTED}|[^,"]*+)'), F.lit(1))
    plain = lambda x: F.when(F.startswith(x, F.lit('"')), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).when(x != COPY_NULL, x)
    rows = records.select(F.transform(fields, plain).alias("f"))
    return as_types(rows.select(*(F.get("f", F.lit(i)).alias(c) for i, c in enumerate(types))), types)


def current(spark: SparkSession, target: str, table: str) -> DataFrame:
    """The version of a snapshot that its pointer names."""
    version = spark.read.parquet(f"{target}/{table}/_current").first()["version"]
    return spark.read.parquet(f"{target}/{table}/{version}")


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``new`` rows, and ``old`` ones whose key is not among them."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").select(new.columns).unionByName(new)


def replaced(old: DataFrame, new: DataFrame, keys: Sequence[str], groups: DataFrame | None = None) -> DataFrame:
    """As ``upserted``, for whole groups: a group of ``groups`` without new rows vanishes."""
    gone = (new if groups is None else groups).select(*keys).distinct()
    return old.join(gone, list(keys), "left_anti").select(new.columns).unionByName(new)


def write_version(df: DataFrame, path: str, *, partition_by: Sequence[str] = ()) -> DataFrame:
    """Written whole and read again; with partitions, only those that ``df`` has are replaced."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if partition_by else "static")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.parquet(path)


def with_ids(new: DataFrame, keys: Sequence[str], name: str = "id") -> DataFrame:
    """A deterministic id from the key columns; a run that is repeated gives the same."""
    return new.withColumn(name, F.xxhash64(*keys))


def numbered_after(old: DataFrame, new: DataFrame, order: Sequence[str], name: str = "id") -> DataFrame:
    """Ids that go on after the largest old one, in the given order.

    Rows are dealt by ranges of the order and numbered within each; a range goes
    on where those before it end, so no task sees all rows. Rows that are alike
    in the order are numbered in any one.
    """
    dealt = written(new.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    # one row a range
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    top = old.agg(F.coalesce(F.max(name), F.lit(0))).first()[0]
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.join(F.broadcast(before), "_range").withColumn(name, F.lit(top) + F.col("_before") + own).drop("_range", "_before")


CATALOGUE = T.StructType().add("index", T.MapType(T.StringType(), T.StructType().add("description", "string").add("made_for_athletes", T.ArrayType(T.StringType())).add("notes", "string"))).add(
    "blocks",
    T.ArrayType(
        T.StructType().add(
            "levels",
            T.MapType(
                T.StringType(),
                T.StructType().add("header", T.StructType().add("raw", "string").add("id_numeric", "string").add("mesocycle_id", "string").add("description", "string")).add("exercises", T.ArrayType(T.StructType().add("exercise", "string").add("sets_x_reps", "string"))),
            ),
        )
    ),
)


def load_catalogue(spark: SparkSession, path: str, *, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """Templates and their items from nested JSON (a document a file, or a line); the first block of an id stays."""
    doc = spark.read.schema(CATALOGUE).option("multiLine", multi_line).json(path)
    blocks = doc.select("index", F.posexplode("blocks").alias("block_no", "b"))
    levels = blocks.select("index", "block_no", F.explode(F.map_entries("b.levels")).alias("l")).select("index", "block_no", F.col("l.key").alias("level"), F.col("l.value.header").alias("h"), F.col("l.value.exercises").alias("items"))
    rows = levels.withColumn("template_id", template_id("h.id_numeric", "h.mesocycle_id", "h.raw")).withColumn("family_id", F.col("h.id_numeric"))
    first = F.row_number().over(Window.partitionBy("template_id").orderBy("block_no", "level"))
    rows = rows.withColumn("_n", first).where("_n = 1")
    known = F.try_element_at("index", F.col("family_id"))
    templates = rows.select("template_id", "family_id", taxonomy("family_id", "h.mesocycle_id").alias("t"), F.col("h.description").alias("block_description"), known["description"].alias("description"), known["made_for_athletes"].alias("made_for_athletes"), known["notes"].alias("notes")).select("template_id", "family_id", "t.*", "block_description", "description", "made_for_athletes", "notes")
    items = rows.select("template_id", F.posexplode("items").alias("exercise_order", "i")).select("template_id", "exercise_order", F.col("i.exercise").alias("exercise_name"), F.col("i.sets_x_reps").alias("sets_x_reps"), dose("i.sets_x_reps").alias("d"))
    return templates, items.select("template_id", "exercise_order", "exercise_name", "sets_x_reps", F.col("d.sets").alias("parsed_sets"), F.col("d.reps").alias("parsed_reps"))


def name_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """Trimmed lines without blank ones and comments."""
    name: Column = F.trim(F.col(column))
    return lines.select(name.alias("name")).where("name != '' AND NOT startswith(name, '#')")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Report documents, one a file, with their file as ``report``."""
    value = T.ArrayType(T.StructType().add("measurement", "string").add("values", T.ArrayType(T.DoubleType())))
    field = T.ArrayType(T.StructType().add("id", "string").add("value", "string"))
    schema = T.StructType().add("results", T.ArrayType(T.StructType().add("id", "string").add("type", "string").add("data", value))).add("measurements", T.ArrayType(T.StructType().add("id", "string").add("fields", field))).add("metadata", T.StructType().add("customFields", field))
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("report", F.input_file_name())
