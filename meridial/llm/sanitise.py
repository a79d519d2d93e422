r"""Personal data: fixed patterns, and terms that give protected values away.

Addresses, IP numbers, cards and phone numbers are found by pattern. What stands
around them may disclose them too: how much a term tells of a value is estimated
from the whole corpus. The contexts of a value are the words near its
occurrences. Of all places of a term, the share ``P(value | term)`` that lie in
the value's contexts is compared with what the value is worth, its information
content ``IC = -ln P(value)`` (``P``: the share of all words that its contexts
hold): pointwise mutual information over information content,
``1 + ln P(value | term) / IC``, is 1 if the term occurs nowhere else and 0 if
it occurs there as often as anywhere. A term is a disclosure at
``threshold`` or more, if at least ``support`` different contexts of one value
have it (so copies of one text are no evidence). Disclosures are found wherever
they stand, also where the value does not.

``sanitise`` replaces patterns by their kind, and a disclosure by its longest
beginning that, taken over all words that begin so, discloses less; where none
does, the term goes.

Everything is an expression of the JVM. Spans come from what a pattern matches
and what it leaves between; their places are running sums within the row, in
blocks, so a row needs neither a shuffle nor quadratic time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridial.llm._work import cut, drop

#: Characters on either side of a value whose words are its context.
REACH = 60
#: Fewer letters are no term.
LEAST_LETTERS = 3
THRESHOLD, SUPPORT = 0.95, 3
#: Up to this many terms are sent to all executors; more are joined by a shuffle.
MAX_BROADCAST_TERMS = 100_000
#: Running sums go block by block of so many.
_BLOCK = 64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What is no letter: ASCII other than A-Z and a-z.
_NO_LETTER = r"\x00-\x40\x5B-\x60\x7B-\x7F"
_WORDS = rf"[^{_NO_LETTER}]+"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"

#: The kinds in their order. Each match is the leftmost of the contract's pattern: a start inside a run of characters that
#: may begin a match is left out (unless the last match ends there), and loops give nothing back, so long runs take linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _digits(hit: Column) -> Column:
    return F.translate(hit, "+ ().-", "")


def _holds(kind: str, hit: Column) -> Column:
    """Whether a match of the kind's pattern is one of the kind."""
    if kind == "ip":
        return hit.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.length(_digits(hit)).between(13, 19) & F.call_function("luhn_check", _digits(hit))
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    return F.lit(True)


def _may_hold(kind: str, text: Column) -> Column:
    """False only if the text has no match of the kind."""
    return text.contains({"email": "@", "ip": ".", "phone": "+"}[kind]) if kind != "card" else text.rlike("[0-9][ -]?[0-9]")


def running(lengths: Column) -> Column:
    """Running sums of an array of numbers, each with its own term; in blocks, as appending to an array copies it."""
    add = lambda a, x: a + x
    total = lambda xs: F.aggregate(xs, F.lit(0), add)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")), lambda b: F.slice(lengths, b * _BLOCK + 1, _BLOCK))
    before = lambda sums: F.aggregate(sums, F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))
    within = lambda block, start: F.transform(block, lambda _, i: start + total(F.slice(block, F.lit(1), i + 1)))
    sums = F.flatten(F.zip_with(blocks, F.slice(before(F.transform(blocks, total)), F.lit(1), F.size(blocks)), within))
    return F.when(F.size(lengths) > 0, sums).otherwise(F.array().cast("array<int>"))


def _cut_up(df: DataFrame, name: str, pattern: Column, may: Column) -> DataFrame:
    """Columns ``<name>_hits`` and ``<name>_gaps``: what a pattern matches, and the text before, between and behind."""
    text = F.col("text")
    return df.withColumns(
        {
            f"{name}_hits": F.when(may, F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(F.array().cast("array<string>")),
            f"{name}_gaps": F.when(may, F.split(text, pattern, -1)).otherwise(F.array(text)),
        }
    )


def _places(df: DataFrame, name: str, holds) -> DataFrame:
    """Column ``<name>``: the spans (start, end) of the hits that hold, in code points."""
    hits, gaps = F.col(f"{name}_hits"), F.col(f"{name}_gaps")
    df = df.withColumn(name, F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.length(g) + F.length(h)))
    df = df.withColumn(name, running(F.col(name)))
    spans = F.zip_with(hits, F.col(name), lambda h, e: F.struct((e - F.length(h)).alias("start"), e.alias("end"), holds(h).alias("holds")))
    return df.withColumn(name, F.filter(spans, lambda s: s["holds"])).drop(f"{name}_hits", f"{name}_gaps")


def _said(name: str) -> Column:
    return F.transform(name, lambda s: F.concat(F.lit(f"{name}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))


def words(text: Column) -> Column:
    """The terms of a text: runs of ASCII letters and of all other characters, A-Z in lower case, of three letters at least."""
    return F.filter(F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(_WORDS), F.lit(0)), lambda w: F.length(w) >= LEAST_LETTERS)


def contexts(docs: DataFrame, text: str = "text", reach: int = REACH) -> DataFrame:
    """entity and the words near it: one row an occurrence of a protected value.

    A value is its kind and its letters in lower case or its digits. Words cut by
    the reach, and what has an ``@``, are no context.
    """
    df = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = []
    for kind, pattern in PATTERNS.items():
        df = _cut_up(df, kind, F.lit(pattern), _may_hold(kind, F.col("text")))
        hits, gaps = F.col(f"{kind}_hits"), F.col(f"{kind}_gaps")
        value = (lambda h: F.translate(h, _UPPER, _LOWER)) if kind in ("email", "ip") else _digits
        before = lambda g: F.when(F.length(g) > reach, F.regexp_replace(F.substring(g, -reach, reach), r"^\S+", " ")).otherwise(g)
        after = lambda g: F.when(F.length(g) > reach, F.regexp_replace(F.substring(g, 1, reach), r"\S+$", " ")).otherwise(g)
        beside = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), F.slice(gaps, F.lit(2), F.size(hits)), lambda a, b: F.concat(before(a), F.lit(" "), after(b)))
        occurrence = F.zip_with(hits, beside, lambda h, c: F.struct(F.concat(F.lit(f"{kind}:"), value(h)).alias("entity"), c.alias("near"), _holds(kind, h).alias("holds")))  # noqa: B023
        found.append(F.filter(occurrence, lambda o: o["holds"]))
    rows = df.select(F.explode(F.concat(*found)).alias("o")).select("o.entity", F.regexp_replace("o.near", r"\S*@\S*", " ").alias("near"))
    return rows.select("entity", words(F.col("near")).alias("words"))


def _joined(rows: DataFrame, terms: DataFrame, how: str = "inner") -> DataFrame:
    """Rows joined with a table of terms, which is sent to all executors if it is small."""
    return rows.join(F.broadcast(terms) if terms.limit(MAX_BROADCAST_TERMS + 1).count() <= MAX_BROADCAST_TERMS else terms, "term", how)


class Disclosures:
    """Written tables of what terms tell of protected values.

    ``terms``: term, disclosure (the highest of its values), at the threshold or above.
    """

    def __init__(self, docs: DataFrame, text: str = "text", reach: int = REACH, threshold: float = THRESHOLD, support: int = SUPPORT):
        self.threshold, self.support = threshold, support
        self.corpus = docs.select(F.explode(words(F.coalesce(F.col(text), F.lit("")))).alias("term"))
        near = contexts(docs, text, reach).select("entity", F.xxhash64("words").alias("context"), F.explode("words").alias("term"))
        # copies of a context add up before they are counted as one; a frequent value's terms are groups of their own
        each = near.groupBy("entity", "term", "context").agg(F.count("*").alias("together"))
        self.joint = cut(each.groupBy("entity", "term").agg(F.sum("together").alias("together"), F.count("*").alias("support")))
        self.entities = cut(self.joint.groupBy("entity").agg(F.sum("together").alias("context_words")))
        asked = cut(self.joint.where(F.col("support") >= support).select("term").distinct())
        few = asked.limit(MAX_BROADCAST_TERMS + 1).count() <= MAX_BROADCAST_TERMS
        if few:
            counted = self.corpus.join(F.broadcast(asked.withColumn("asked", F.col("term"))), "term", "left").groupBy(F.col("asked").alias("term")).agg(F.count("*").alias("places"))
        else:
            counted = self.corpus.groupBy("term").agg(F.count("*").alias("places"))
        places = cut(counted)
        self.total = places.agg(F.sum("places")).first()[0] or 0
        told = self._disclosure(self.joint.where(F.col("support") >= support), places.where("term IS NOT NULL"), "term")
        self.terms = cut(told.where(F.col("disclosure") >= threshold))
        drop(asked, places)

    def _disclosure(self, joint: DataFrame, places: DataFrame, by: str) -> DataFrame:
        """by, the highest disclosure of any value."""
        share = F.least(F.lit(1.0), F.col("together") / F.col("places"))
        content = F.log(F.lit(float(self.total)) / F.col("context_words"))
        each = joint.join(places, by).join(self.entities, "entity").where(content > 0)
        return each.groupBy(by).agg(F.max(1 + F.log(share) / content).alias("disclosure"))

    def forms(self) -> DataFrame:
        """term, form: the longest beginning that discloses less than the threshold and a ``*``, or the ``*`` alone.

        All words that begin so count, wherever they stand.
        """
        begins = lambda term, to: F.transform(F.sequence(F.lit(1), to), lambda n: F.substring(term, F.lit(1), n))
        asked = self.terms.select("term", F.explode(begins(F.col("term"), F.length("term") - 1)).alias("beginning"))
        some = F.broadcast(asked.select("beginning").distinct()) if self.terms.count() <= MAX_BROADCAST_TERMS // 10 else asked.select("beginning").distinct()
        shorter = lambda rows, n: rows.select("*", F.explode(begins(F.col("term"), F.length("term"))).alias("beginning")).drop("term").join(some, "beginning")
        places = shorter(self.corpus.groupBy("term").agg(F.count("*").alias("places")), "places").groupBy("beginning").agg(F.sum("places").alias("places"))
        joint = shorter(self.joint.drop("support"), "together").groupBy("entity", "beginning").agg(F.sum("together").alias("together"))
        safe = self._disclosure(joint, places, "beginning").where(F.col("disclosure") < self.threshold).select("beginning")
        longest = asked.join(safe, "beginning").groupBy("term").agg(F.max_by("beginning", F.length("beginning")).alias("beginning"))
        return self.terms.select("term").join(longest, "term", "left").select("term", F.concat(F.coalesce("beginning", F.lit("")), F.lit("*")).alias("form"))


def _with_terms(docs: DataFrame, terms: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``text`` (null: empty) and ``told``: the structs of ``terms`` that stand in it, or null.

    Texts are known by a digest, so equal ones are looked up once, and a row's key plays no part.
    """
    rows = docs.withColumns({"text": F.coalesce(F.col(text), F.lit(""))}).withColumn("digest", F.md5("text"))
    if not terms.take(1):
        return rows.withColumn("told", F.lit(None).cast(f"array<{terms.select(F.struct('*')).schema[0].dataType.simpleString()}>")).drop("digest")
    each = rows.select("digest", F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    told = _joined(each, terms).groupBy("digest").agg(F.collect_set(F.struct(*terms.columns)).alias("told"))
    return rows.join(told, "digest", "left").drop("digest")


def _pattern(terms: Column) -> Column:
    """Any of the terms as a whole word; they are letters only, so they are patterns of themselves."""
    return F.concat(F.lit(rf"(?i)(?<![^{_NO_LETTER}])(?:"), F.array_join(terms, "|"), F.lit(rf")(?![^{_NO_LETTER}])"))


def find_private(docs: DataFrame, key: str = "doc_id", text: str = "text", disclosures: Disclosures | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_term, base_spans, spans of every row.

    Spans are ``kind:start:end`` in code points, end exclusive, by kind, then
    start; ``term`` is the last kind, its spans may lie in others. A null or
    empty text has none. Equal texts have equal spans; null and repeated keys
    are rows like others, an empty table has none. Other columns are not read.
    """
    own = disclosures or Disclosures(docs, text)
    df = _with_terms(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), own.terms.select("term"), "text")
    for kind, pattern in PATTERNS.items():
        df = _places(_cut_up(df, kind, F.lit(pattern), _may_hold(kind, F.col("text"))), kind, lambda h, k=kind: _holds(k, h))
    df = df.withColumn("told", _pattern(F.transform("told", lambda t: t["term"])))
    df = _places(_cut_up(df, "term", F.col("told"), F.col("told").isNotNull()), "term", lambda h: F.lit(True))
    base = F.concat(*(_said(k) for k in PATTERNS))
    return df.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in (*PATTERNS, "term")),
        F.array_join(base, ",").alias("base_spans"),
        F.array_join(F.concat(base, _said("term")), ",").alias("spans"),
    )


def sanitise(docs: DataFrame, text: str = "text", disclosures: Disclosures | None = None) -> DataFrame:
    """``docs`` with values replaced by ``[kind]`` and disclosing terms by their general form; null texts stay null.

    One kind after the other, disclosures last; all rows and all other columns stay.
    """
    own = disclosures or Disclosures(docs, text)
    kept = [F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(docs.columns)]
    df = _with_terms(docs.select(*kept, F.col(text).alias("text")), cut(own.forms()), "text")
    for kind, pattern in PATTERNS.items():
        df = _cut_up(df, kind, F.lit(pattern), _may_hold(kind, F.col("text")))
        other = F.transform(f"{kind}_hits", lambda h: F.when(_holds(kind, h), F.lit(f"[{kind}]")).otherwise(h))  # noqa: B023
        df = df.withColumn("text", _glued(kind, other)).drop(f"{kind}_hits", f"{kind}_gaps")
    df = df.withColumn("pattern", _pattern(F.transform("told", lambda t: t["term"])))
    df = _cut_up(df, "term", F.col("pattern"), F.col("pattern").isNotNull())
    form = F.map_from_entries(F.transform("told", lambda t: F.struct(t["term"], t["form"])))
    other = F.transform("term_hits", lambda h: F.coalesce(F.element_at(form, F.translate(h, _UPPER, _LOWER)), h))
    at = docs.columns.index(text)
    df = df.withColumn("text", F.when(F.col(f"own_{at}").isNotNull(), _glued("term", other)))
    return df.select(*(F.col("text" if i == at else f"own_{i}").alias(c) for i, c in enumerate(docs.columns)))


def _glued(name: str, instead: Column) -> Column:
    """The text again, with other strings in place of the hits."""
    gaps = F.col(f"{name}_gaps")
    return F.concat(F.array_join(F.zip_with(F.slice(gaps, F.lit(1), F.size(instead)), instead, lambda g, h: F.concat(g, h)), ""), F.element_at(gaps, -1))
