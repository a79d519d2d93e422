"""Programs, doses, ids, names and classifiers over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridial.functions import text as T
from meridial.operators import norms, programs
from meridial.plans.profiles import rounded
from meridial.plans.registry import R4, Tables, query, r4


def _breakdown(t: Tables) -> DataFrame:
    link = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
    return programs.category_breakdown(t.orders, "o_orderkey", link, t.part.select("p_partkey", "p_type"), "p_partkey", F.nullif(F.col("p_type"), F.lit("PROMO")), component="lift")


_BREAKDOWN = """SELECT o_orderkey, 'lift' AS component, coalesce(nullif(p_type, 'PROMO'), 'unknown') AS category, count(*)::BIGINT AS n, count(DISTINCT p_partkey)::BIGINT AS unique_count
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY ALL"""


@query(_BREAKDOWN)
def program_breakdown(t: Tables) -> DataFrame:
    return _breakdown(t)


@query(
    f"""WITH b AS ({_BREAKDOWN}), s AS (SELECT o_orderkey, sum(n)::BIGINT AS n_lift, sum(unique_count)::BIGINT AS n_unique_lift, string_agg(category || ':' || n, ',' ORDER BY n DESC, category) AS breakdown FROM b GROUP BY ALL)
    SELECT o_orderkey, n_lift, n_unique_lift, breakdown, c_mktsegment, floor(epoch(d - o_orderdate) / 86400)::BIGINT AS duration_days
    FROM s JOIN orders USING (o_orderkey) LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS d FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey"""
)
def program_summary(t: Tables) -> DataFrame:
    s = programs.program_summaries(_breakdown(t), "o_orderkey", ["lift"])
    ends = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("ends"))
    out = s.join(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderkey").join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey", "left").join(ends, "o_orderkey", "left")
    shown = F.array_join(F.transform("lift_breakdown", lambda x: F.concat_ws(":", x.category, x.n.cast("string"))), ",")
    return out.select("o_orderkey", "n_lift", "n_unique_lift", shown.alias("breakdown"), "c_mktsegment", programs.duration_days(F.col("o_orderdate"), F.col("ends")).alias("duration_days"))


TYPES = ("ECONOMY", "LARGE", "MEDIUM", "SMALL", "STANDARD", "unknown")


@query(f"WITH b AS ({_BREAKDOWN}) SELECT o_orderkey, {', '.join(f'coalesce(sum(n) FILTER (category = {chr(39)}{c}{chr(39)}), 0)::BIGINT AS {c}' for c in TYPES)} FROM b GROUP BY ALL")
def breakdown_pivot(t: Tables) -> DataFrame:
    return programs.breakdown_pivot(_breakdown(t), "o_orderkey", TYPES)


@query(
    f"""WITH a AS (SELECT l_orderkey, list(l_quantity::INT) AS r, list(l_discount * 100) AS w FROM lineitem GROUP BY ALL)
    SELECT l_orderkey, len(r)::BIGINT AS n_sets, list_sum(r)::BIGINT AS total_reps, {R4('list_avg(r)')} AS avg_reps, list_max(r) AS max_reps, list_min(r) AS min_reps, {R4('list_avg(w)')} AS avg_weight, {R4('list_max(w)')} AS max_weight FROM a"""
)
def array_dose_stats(t: Tables) -> DataFrame:
    a = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.col("l_quantity").cast("int")).alias("r"), F.collect_list(F.col("l_discount") * 100).alias("w"))
    return rounded(a.select("l_orderkey", *T.array_stats(F.col("r"), F.col("w"))))


_TOKENS = "[CASE l_linenumber % 4 WHEN 0 THEN 'AMRAP' WHEN 1 THEN l_quantity::INT || 's' WHEN 2 THEN l_quantity::INT || '.5' ELSE ' ' || l_quantity::INT END, l_quantity::INT || 'd', '', l_linenumber::VARCHAR]"


@query(
    f"""WITH k AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, {_TOKENS} AS x FROM lineitem),
    f AS (SELECT *, list_filter(x, lambda v: regexp_full_match(trim(v), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')) AS y FROM k)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, list_sum(list_transform(y, lambda v: trunc(v::DOUBLE)))::BIGINT AS ints, {R4('list_sum(list_transform(y, lambda v: v::DOUBLE))')} AS doubles FROM f"""
)
def token_parse(t: Tables) -> DataFrame:
    q = F.col("l_quantity").cast("int").cast("string")
    n = F.col("l_linenumber") % 4
    first = F.when(n == 0, "AMRAP").when(n == 1, F.concat(q, F.lit("s"))).when(n == 2, F.concat(q, F.lit(".5"))).otherwise(F.concat(F.lit(" "), q))
    tokens = F.array(first, F.concat(q, F.lit("d")), F.lit(""), F.col("l_linenumber").cast("string"))
    total = lambda a, z: F.aggregate(a, z, lambda x, y: x + y)
    out = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", T.numbers(tokens, "bigint").alias("i"), T.numbers(tokens).alias("d"))
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", total("i", F.lit(0).cast("long")).alias("ints"), r4(total("d", F.lit(0.0))).alias("doubles"))


@query(
    """WITH k AS (SELECT p_partkey, p_size, CASE p_partkey % 5 WHEN 0 THEN '3 x ' || p_size WHEN 1 THEN '2X' || p_size || 's' WHEN 2 THEN '1 x ' || p_size || 'min' WHEN 3 THEN p_size || ' each' ELSE ' 4x' || p_size || ' ' END AS d FROM part)
    SELECT p_partkey, d,
      CASE WHEN p_partkey % 5 <> 3 THEN [3, 2, 1, NULL, 4][p_partkey % 5 + 1] END AS sets, CASE WHEN p_partkey % 5 <> 3 THEN p_size END AS reps,
      CASE WHEN p_partkey % 5 IN (0, 1, 4) THEN [3, 2, NULL, NULL, 4][p_partkey % 5 + 1] END AS payload_sets,
      (CASE p_partkey % 5 WHEN 0 THEN 3 * p_size WHEN 4 THEN 4 * p_size ELSE 0 END)::BIGINT AS payload_total,
      CASE WHEN p_partkey % 5 <> 3 THEN p_size END AS eval_reps,
      coalesce(p_partkey % 5 = 0 AND abs(p_size - 10) <= 1, false) AS as_three_tens
    FROM k"""
)
def sets_reps_parse(t: Tables) -> DataFrame:
    s, m = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    d = F.when(m == 0, F.concat(F.lit("3 x "), s)).when(m == 1, F.concat(F.lit("2X"), s, F.lit("s"))).when(m == 2, F.concat(F.lit("1 x "), s, F.lit("min"))).when(m == 3, F.concat(s, F.lit(" each"))).otherwise(F.concat(F.lit(" 4x"), s, F.lit(" ")))
    p = t.part.select("p_partkey", d.alias("d")).select("p_partkey", "d", T.dose("d").alias("c"), T.dose("d", "payload").alias("p"), T.dose("d", "eval").alias("e"))
    total = F.aggregate("p.reps_array", F.lit(0).cast("long"), lambda a, x: a + x)
    return p.select("p_partkey", "d", "c.sets", "c.reps", F.col("p.sets").alias("payload_sets"), total.alias("payload_total"), F.col("e.reps").alias("eval_reps"), T.same_dose(F.col("e.sets"), F.col("e.reps"), F.lit(3), F.lit(10)).alias("as_three_tens"))


@query(
    """WITH a AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS r FROM lineitem GROUP BY ALL)
    SELECT l_orderkey, len(r) || ' x ' || CASE WHEN len(list_distinct(r)) = 1 THEN r[1]::VARCHAR ELSE array_to_string(r, '/') END AS dose FROM a"""
)
def dose_rebuild(t: Tables) -> DataFrame:
    a = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("r"))
    return a.select("l_orderkey", T.dose_text(F.size("r"), F.col("r"), F.lit(None).cast("double")).alias("dose"))


def _map_sql(table: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


@query(
    f"""WITH k AS (SELECT p_partkey, (p_partkey * 7 + 1000)::VARCHAR || CASE WHEN p_partkey % 9 = 0 THEN 'x' ELSE '' END AS f, (p_size * 13)::VARCHAR AS m, p_name FROM part), d AS (SELECT *, regexp_full_match(f, '[0-9]+') AS ok FROM k)
    SELECT p_partkey, CASE WHEN ok THEN {_map_sql(T.LEVELS, 'substr(f, 1, 1)')} END AS athlete_level, CASE WHEN ok THEN {_map_sql(T.FOCUSES, 'substr(f, 2, 1)')} END AS focus, CASE WHEN ok THEN try_cast(substr(f, 3, 1) AS INT) END AS sprint_days_per_week,
      CASE WHEN ok THEN nullif(substr(f, 4, 1), '') END AS variant_identifier, try_cast(substr(m, 1, 1) AS INT) AS mesocycle_number, {_map_sql(T.BUCKETS, 'substr(m, 2, 1)')} AS movement_bucket, nullif(substr(m, 3, 1), '') AS lift_position_in_day,
      CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN f || '-' || m ELSE 'unknown-' || m END AS template_id FROM d"""
)
def taxonomy_decode(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    f = F.concat((key * 7 + 1000).cast("string"), F.when(key % 9 == 0, "x").otherwise(""))
    p = t.part.select("p_partkey", "p_name", f.alias("f"), (F.col("p_size") * 13).cast("string").alias("m"))
    header = F.when(key % 3 == 0, F.concat(F.lit(" "), "p_name"))
    family = F.when(key % 3 == 1, F.col("f"))
    return p.select("p_partkey", T.taxonomy("f", "m").alias("x"), T.template_id(family, "m", header).alias("template_id")).select("p_partkey", "x.*", "template_id")


_CLEAN = "trim(regexp_replace(lower(trim({0})), '\\s+', ' ', 'g'))"
_LOOSE = "trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(translate(trim(lower({0})), '‘’“”–—', '''''\"\"--'), '\\bw\\s*/\\s*', 'w ', 'g'), '\\bwith\\b', 'w', 'g'), '&', 'and'), '[^a-z0-9/ ]+', ' ', 'g'), '\\s+', ' ', 'g'))"
_NOISY = "'  ' || upper(p_name) || CASE p_partkey % 4 WHEN 0 THEN ' w/ band' WHEN 1 THEN ' WITH band & 5/10/5' WHEN 2 THEN '  (“heavy”) – slow' ELSE '!' END"


@query(f"SELECT p_partkey, {_LOOSE.format(_NOISY)} AS name FROM part")
def loose_normalize(t: Tables) -> DataFrame:
    m = F.col("p_partkey") % 4
    tail = F.when(m == 0, " w/ band").when(m == 1, " WITH band & 5/10/5").when(m == 2, "  (“heavy”) – slow").otherwise("!")
    return t.part.select("p_partkey", T.loose(F.concat(F.lit("  "), F.upper("p_name"), tail)).alias("name"))


@query(f"SELECT doc_id, md5({_LOOSE.format('text')}) AS digest FROM documents")
def loose_normalize_texts(t: Tables) -> DataFrame:
    """Digests of the normal forms of all documents, whatever their language."""
    return t.documents.select("doc_id", F.md5(T.loose("text").cast("binary")).alias("digest"))


@query(f"SELECT doc_id, length({_LOOSE.format('text')})::BIGINT AS n FROM documents")
def loose_normalize_all_texts(t: Tables) -> DataFrame:
    """Lengths of the normal forms of all documents."""
    return t.documents.select("doc_id", F.length(T.loose("text")).cast("long").alias("n"))


def classify_sql(name: str) -> str:
    q = lambda s: s.replace("'", "''")
    n = _CLEAN.format(name)
    return f"CASE WHEN coalesce({n}, '') = '' THEN 'unclassified' " + " ".join("WHEN " + " OR ".join(f"contains({n}, '{q(w)}')" for w in words) + f" THEN '{q(label)}'" for label, words in T.PATTERNS) + " ELSE 'unclassified' END"


_PART_NAMES = "CASE p_partkey % 7 WHEN 0 THEN p_name || ' squat' WHEN 1 THEN 'SINGLE ARM ' || p_name || ' Row' WHEN 2 THEN 'hex bar  deadlift' WHEN 3 THEN 'hop and pogo' WHEN 4 THEN NULL ELSE p_name END"


def part_names(t: Tables) -> DataFrame:
    m = F.col("p_partkey") % 7
    name = F.when(m == 0, F.concat("p_name", F.lit(" squat"))).when(m == 1, F.concat(F.lit("SINGLE ARM "), "p_name", F.lit(" Row"))).when(m == 2, "hex bar  deadlift").when(m == 3, "hop and pogo").when(m == 4, F.lit(None).cast("string")).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", name.alias("name"))


@query(f"SELECT p_partkey, {classify_sql(_PART_NAMES)} AS pattern FROM part")
def pattern_classify(t: Tables) -> DataFrame:
    return part_names(t).select("p_partkey", T.classify("name").alias("pattern"))


@query(f"SELECT doc_id, {classify_sql('text')} AS pattern FROM documents")
def pattern_classify_texts(t: Tables) -> DataFrame:
    """The pattern of every document."""
    cleaned = t.documents.select("doc_id", T.clean("text").alias("text"))
    return cleaned.select("doc_id", T.classify("text", cleaned=True).alias("pattern"))


@query(f"WITH p AS (SELECT doc_id, {classify_sql('text')} AS pattern FROM documents) SELECT pattern, count(*)::BIGINT AS n FROM p GROUP BY ALL")
def pattern_classify_all_texts(t: Tables) -> DataFrame:
    """How many documents have each pattern."""
    return t.documents.select(T.classify("text").alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))


_KINDS = "CASE p_partkey % 8 WHEN 0 THEN 'Lower Body' WHEN 1 THEN ' UB' WHEN 2 THEN 'Full Body' WHEN 3 THEN 'running' WHEN 4 THEN 'Plyo/box' WHEN 5 THEN NULL ELSE p_type || '--Mid/Set 1' END"


def _kinds() -> Column:
    m = F.col("p_partkey") % 8
    return F.when(m == 0, "Lower Body").when(m == 1, " UB").when(m == 2, "Full Body").when(m == 3, "running").when(m == 4, "Plyo/box").when(m == 5, F.lit(None).cast("string")).otherwise(F.concat("p_type", F.lit("--Mid/Set 1")))


@query(
    f"""WITH k AS (SELECT p_partkey, trim(lower(coalesce({_KINDS}, ''))) AS s FROM part) SELECT p_partkey, CASE WHEN s LIKE '%leg%' OR s LIKE '%lower%' THEN 'Legs' WHEN s LIKE '%upper%' OR s = 'ub' THEN 'Upper'
    WHEN s LIKE '%total%' OR s LIKE '%full body%' OR s = 'tb' THEN 'Total Body' WHEN s LIKE '%sprint%' OR s LIKE '%speed%' OR s LIKE '%run%' THEN 'Sprint' WHEN s LIKE '%jump%' OR s LIKE '%plyo%' THEN 'Jump' ELSE 'Other' END AS bucket FROM k"""
)
def bucket_normalize(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.bucket(_kinds()).alias("bucket"))


@query(f"SELECT p_partkey, coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace(lower({_KINDS}), '[ \\-/]', '_', 'g'), '[^a-z0-9_]', '', 'g'), '_+', '_', 'g'), '_'), ''), 'unknown') AS slug FROM part")
def slug_category(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.slug(_kinds()).alias("slug"))


@query(
    """WITH k AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'OZ_' || p_size WHEN 1 THEN 'lb_' || p_size WHEN 2 THEN p_size || '_oz' ELSE 'Body_Weight' END AS c FROM part)
    SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN c[4:] || ' oz' WHEN 1 THEN c[4:] || ' lb' WHEN 2 THEN replace(c, '_oz', '') || ' oz' ELSE 'body weight' END AS shown,
      CASE p_partkey % 4 WHEN 0 THEN c WHEN 1 THEN upper(c) WHEN 2 THEN 'OZ_' || replace(c, '_oz', '') END AS code FROM k"""
)
def unit_enum(t: Tables) -> DataFrame:
    s, m = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    c = F.when(m == 0, F.concat(F.lit("OZ_"), s)).when(m == 1, F.concat(F.lit("lb_"), s)).when(m == 2, F.concat(s, F.lit("_oz"))).otherwise("Body_Weight")
    return t.part.select("p_partkey", T.weight_text(c).alias("shown")).withColumn("code", T.weight_code("shown"))


@query(
    f"""WITH k AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'in_season x' WHEN 1 THEN 'Size block' ELSE nullif(o_orderstatus, 'P') END AS kind, o_totalprice > 400000 AS w, o_totalprice > 300000 AS s, o_totalprice > 200000 AS g, o_totalprice > 100000 AS z FROM orders),
    f AS (SELECT o_orderkey, CASE WHEN upper(kind) LIKE '%IN_SEASON%' THEN 'In-Season' WHEN upper(kind) LIKE '%SIZE%' THEN 'Hypertrophy' WHEN w THEN 'Power' WHEN s THEN 'Speed' WHEN g THEN 'Strength' WHEN z THEN 'Hypertrophy' ELSE 'Power' END AS focus FROM k)
    SELECT o_orderkey, focus, {_map_sql(T.FOCUS_PHASE, 'focus')} AS phase, coalesce({_map_sql(T.FOCUS_DAY_LEVEL, 'focus')}, 'P1') AS day_level FROM f"""
)
def focus_infer(t: Tables) -> DataFrame:
    m, x = F.col("o_orderkey") % 6, F.col("o_totalprice")
    kind = F.when(m == 0, "in_season x").when(m == 1, "Size block").otherwise(F.nullif(F.col("o_orderstatus"), F.lit("P")))
    o = t.orders.select("o_orderkey", T.focus_of(kind, x > 400000, x > 300000, x > 200000, x > 100000).alias("focus"))
    return o.withColumn("phase", T.lookup("focus", T.FOCUS_PHASE, "Workload Ramp")).withColumn("day_level", T.lookup("focus", T.FOCUS_DAY_LEVEL, "P1"))


@query(
    """WITH k AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'P2 - Mound Day then P1' WHEN 1 THEN 'Rest' WHEN 2 THEN 'P3 Offset' ELSE '[Legs] x' END AS s FROM orders)
    SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'P1' WHEN 2 THEN 'P3' END AS level, o_orderkey % 4 = 1 AS off, regexp_replace(s, '^\\[[^\\]]+\\]\\s*', '') AS bare FROM k"""
)
def level_tokens(t: Tables) -> DataFrame:
    m = F.col("o_orderkey") % 4
    s = F.when(m == 0, "P2 - Mound Day then P1").when(m == 1, "Rest").when(m == 2, "P3 Offset").otherwise("[Legs] x")
    return t.orders.select("o_orderkey", T.level_token(s).alias("level"), T.off_day(s).alias("off"), T.without_group(s).alias("bare"))


@query("SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_name)), ',') AS items, array_to_string(list_sort(list(DISTINCT p_type) FILTER (p_type <> 'PROMO')), ',') AS buckets FROM part GROUP BY ALL")
def family_rollup(t: Tables) -> DataFrame:
    return programs.family_rollup(t.part.withColumn("b", F.nullif(F.col("p_type"), F.lit("PROMO"))), "p_brand", "p_name", "b").select("p_brand", F.array_join("items", ",").alias("items"), F.array_join("buckets", ",").alias("buckets"))


@query("SELECT p_brand, p_type, count(*)::BIGINT AS n FROM part GROUP BY ALL HAVING count(*) >= 3")
def availability(t: Tables) -> DataFrame:
    return programs.available_focuses(t.part, "p_brand", "p_type")


@query("SELECT coalesce(nullif(p_type, 'PROMO'), '(none)') AS level, count(*)::BIGINT AS n, count(DISTINCT p_brand)::BIGINT AS n_families, count(DISTINCT p_size)::BIGINT AS n_sizes FROM part GROUP BY ALL")
def catalog_stats(t: Tables) -> DataFrame:
    level = F.coalesce(F.nullif(F.col("p_type"), F.lit("PROMO")), F.lit("(none)"))
    return t.part.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.countDistinct("p_brand").alias("n_families"), F.countDistinct("p_size").alias("n_sizes"))


@query(
    """WITH r AS (SELECT user_id, event_id, event_type = 'signup' AS h, event_type IN ('error', 'view') AND event_type <> 'signup' AS e FROM events),
    b AS (SELECT *, sum(h::INT) OVER w AS block, sum((NOT e)::INT) OVER w AS filled FROM r WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    c AS (SELECT *, sum(e::INT) OVER (PARTITION BY user_id, filled ORDER BY event_id) AS run FROM b), d AS (SELECT *, max((run >= 2)::INT) OVER (PARTITION BY user_id, block ORDER BY event_id) AS ended FROM c)
    SELECT user_id, block::BIGINT AS block, event_id FROM d WHERE block > 0 AND NOT e AND ended = 0"""
)
def block_segment(t: Tables) -> DataFrame:
    return programs.segment_blocks(t.events, "user_id", "event_id", F.col("event_type") == "signup", F.col("event_type").isin("error", "view")).select("user_id", "block", "event_id")


@query("SELECT user_id, arg_min(event_type, event_id) AS description, string_agg(props, ',' ORDER BY event_id) AS made_for FROM events GROUP BY ALL")
def index_fold(t: Tables) -> DataFrame:
    return programs.index_fold(t.events, "user_id", "event_id", "event_type", "props").withColumn("made_for", F.array_join("made_for", ","))


@query("SELECT p_brand, p_type, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) = 1")
def keep_first(t: Tables) -> DataFrame:
    return norms.latest(t.part, ["p_brand", "p_type"], "p_partkey").select("p_brand", "p_type", "p_partkey")


def _payload(t: Tables) -> DataFrame:
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).withColumn("weight", F.nullif(F.col("l_discount"), F.lit(0.0)))
    return programs.payloads(lines, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], ["p_name", "l_quantity", "weight"])


@query()
def payload_json(t: Tables) -> DataFrame:
    return _payload(t)
