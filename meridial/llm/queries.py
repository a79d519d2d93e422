"""The queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridial.llm._work import table


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, and how near edited and next texts come."""
    from meridial.llm.fingerprint import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under links of 85 % 4-word Jaccard similarity."""
    from meridial.llm.set_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op3_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a mix by source weights takes, and for which output shards."""
    from meridial.llm.mixture import draw

    drawn = draw(table(spark, sf_dir, "documents"))
    return drawn.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.array_join(F.col("shards").cast("array<string>"), ",").alias("shards"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and labels of all documents."""
    from meridial.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, and their digests read back from the output."""
    from meridial.llm.chat import format_chats, read_back

    text = "\\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return read_back(format_chats(turns))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in all documents; the base spans as a digest."""
    from meridial.llm.secrets import scan_secrets

    found = scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_novel")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    from meridial.llm.html_text import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents, learned from nine tenths of them."""
    from meridial.llm.language_model import fit, held_out, score

    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs.where(~held_out("doc_id"))), last=True)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark items searched in all documents."""
    from meridial.llm.decontaminate import find_contamination

    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from four fifths of the labels."""
    from meridial.llm.quality import fit_quality, score_quality

    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    # a row without a key is not learned from, but in no fold either
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest-scoring documents of each benchmark item."""
    from meridial.llm.ranked_search import ranked

    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_token_align(spark: SparkSession, sf_dir: str, tokenizers: str = "/opt/tokenizers") -> DataFrame:
    """Tokens of a byte-level and of a sentencepiece vocabulary, aligned over all documents."""
    from meridial.llm.token_align import align

    return align(table(spark, sf_dir, "documents"), f"{tokenizers}/byte_bpe_50k.json", f"{tokenizers}/piece_bpe_32k.model")


def op13_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents, and terms that disclose it; the base spans as a digest."""
    from meridial.llm.sanitise import find_private

    found = find_private(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_term")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprint": op1_fingerprint,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_mixture": op3_mixture,
    "op4_licenses": op4_licenses,
    "op5_chat": op5_chat,
    "op6_secrets": op6_secrets,
    "op7_html": op7_html,
    "op8_language_model": op8_language_model,
    "op9_decontaminate": op9_decontaminate,
    "op10_quality": op10_quality,
    "op11_ranked_search": op11_ranked_search,
    "op12_token_align": op12_token_align,
    "op13_private": op13_private,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _shingles_sql(source: str, key: str, k: int) -> str:
    """(key, shingle): distinct k-word shingles; fewer words count as one."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+')"
    return f"""(SELECT DISTINCT {key}, array_to_string(w[i:i + {k - 1}], ' ') AS shingle
      FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - {k - 1}, 1) + 1)) AS i
            FROM (SELECT {key}, {words} AS w FROM {source}) WHERE len(w) > 0))"""


def _level_sql(level: int) -> str:
    """Draws one level further down the splitting tree."""
    return f"""b{level + 1} AS (SELECT rank, turn, node * 2 + (row_number() OVER (PARTITION BY node ORDER BY md5('mix|{level}|' || rank || '|' || turn), rank, turn)
                         > ceil(count(*) OVER (PARTITION BY node) / 2.0))::INT AS node FROM b{level})"""


_MIXTURE_SQL = f"""
      WITH e AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
                        md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS base FROM documents),
           r AS (SELECT doc_id, source, size, md5('mix|' || base || '|' || (row_number() OVER (PARTITION BY source, base) - 1)) AS place FROM e),
           s AS (SELECT source, sum(size)::BIGINT AS source_size FROM r GROUP BY 1),
           w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
           l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                           / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
           t AS (SELECT source, source_size, rank, CASE WHEN level * weight >= cap THEN cap
                        ELSE weight * (SELECT arg_min(level, cap / weight) FROM l WHERE level * weight < cap) END AS target FROM l),
           g AS (SELECT *, CASE WHEN source_size > 0 THEN least(2, floor(target / source_size + 1e-9)) ELSE 0 END::INT AS passes FROM t),
           h AS (SELECT *, CASE WHEN passes < 2 THEN greatest(target - passes * source_size, 0) ELSE 0 END AS rest FROM g),
           c AS (SELECT r.*, h.source_size, h.target, h.rank, h.passes, h.rest, sum(size) OVER (PARTITION BY r.source ORDER BY place) AS "end"
                 FROM r JOIN h ON r.source IS NOT DISTINCT FROM h.source),
           met AS (SELECT rank, min(place) AS crossed FROM c WHERE rest > 0 AND "end" >= rest GROUP BY 1),
           cut AS (SELECT c.rank, coalesce(max(place) FILTER ("end" <= rest AND left(place, 4) = left(crossed, 4)), any_value(left(crossed, 4))) AS stop,
                          max(rest) - coalesce(max("end") FILTER ("end" <= rest), 0) AS gap FROM c JOIN met USING (rank) GROUP BY 1),
           f AS (SELECT rank, arg_min(place, (abs(size - gap), place)) AS filler FROM c JOIN cut USING (rank) WHERE place > stop AND size > 0 AND abs(size - gap) < gap GROUP BY 1),
           p AS (SELECT h.rank, h.passes * 256 + coalesce(('0x' || left(stop, 2))::INT + 1, 0) AS quota, stop, filler FROM h LEFT JOIN cut USING (rank) LEFT JOIN f USING (rank)),
           b0 AS (SELECT rank, unnest(range(quota)) AS turn, 0 AS node FROM p), {", ".join(_level_sql(i) for i in range(3))},
           deal AS (SELECT rank, node AS shard, row_number() OVER (PARTITION BY rank ORDER BY node) - 1 AS turn FROM b3),
           x AS (SELECT c.*, ('0x' || left(place, 2))::INT AS block, quota, coalesce(place = filler, false) AS fills, (coalesce(place <= stop, false) OR coalesce(place = filler, false))::INT AS part FROM c JOIN p USING (rank)),
           y AS (SELECT *, CASE WHEN passes + part > 0 THEN CASE WHEN fills AND passes = 0 THEN quota - 1 ELSE block END END AS t0,
                        CASE WHEN passes + part > 1 THEN CASE WHEN fills AND passes = 1 THEN quota - 1 ELSE 256 + block END END AS t1 FROM x)
      SELECT doc_id, size, source_size, round(target, 6) AS target, (size * ((d0.shard IS NOT NULL)::INT + (d1.shard IS NOT NULL)::INT))::BIGINT AS taken,
             concat_ws(',', d0.shard::VARCHAR, d1.shard::VARCHAR) AS shards
      FROM y LEFT JOIN deal d0 ON d0.rank = y.rank AND d0.turn = t0 LEFT JOIN deal d1 ON d1.rank = y.rank AND d1.turn = t1"""


def _licenses_sql() -> str:
    """Phrases and templates compared at every word of the texts, without an index."""
    from meridial.llm.licenses import PHRASES, TEMPLATES, WORD, Template

    every = [*(Template(label, p, p) for p, label in PHRASES.items()), *TEMPLATES]
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    rows = ", ".join(f"({i}, '{t.label}', {listed(t.words)}, {listed(t.mandatory.split())}, {t.offset})" for i, t in enumerate(every))
    return f"""
      WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD.replace(chr(92), chr(92))}') AS w FROM documents),
           t(t, label, tw, must, off) AS (VALUES {rows}),
           v AS (SELECT DISTINCT unnest(tw) AS word FROM t),
           n AS (SELECT word, count(DISTINCT r) AS n FROM (SELECT r, unnest(w) AS word FROM d) JOIN v USING (word) GROUP BY 1),
           tw AS (SELECT t, unnest(tw) AS word, unnest(range(len(tw))) AS j FROM t),
           wt AS (SELECT t, list(ln(((SELECT count(*) FROM d) + 1)::DOUBLE / (coalesce(n, 0) + 1)) ORDER BY j) AS wt FROM tw LEFT JOIN n USING (word) GROUP BY t),
           h AS (SELECT t.*, wt.wt, list_sum(wt.wt) AS total FROM t JOIN wt USING (t)),
           x AS (SELECT r, w, unnest(range(len(w))) AS i FROM d WHERE len(list_intersect(w, (SELECT list(DISTINCT must[1]) FROM t))) > 0),
           p AS (SELECT r, t, label, i - off AS s, CASE WHEN t < {len(PHRASES)} THEN 1.0 ELSE list_sum(list_transform(range(len(tw)), lambda j: CASE WHEN i - off + j >= 0 AND w[i - off + j + 1] = tw[j + 1] THEN wt[j + 1] ELSE 0.0 END)) / nullif(total, 0) END AS share
                 FROM x JOIN h ON x.w[x.i + 1] = h.must[1] WHERE x.w[x.i + 1:x.i + len(h.must)] = h.must),
           g AS (SELECT r, count(*) FILTER (t < {len(PHRASES)}) AS n_base, min(s) FILTER (t < {len(PHRASES)}) AS a, max(s) FILTER (t < {len(PHRASES)}) AS z,
                        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (t < {len(PHRASES)}) AS base, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (share >= 0.6 - 1e-9) AS labels, max(share) AS score FROM p GROUP BY 1)
      SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, a::BIGINT AS first_word, z::BIGINT AS last_word,
             coalesce(base, '') AS base_labels, coalesce(labels, '') AS labels, least(1.0, round(coalesce(score, 0), 9))::DOUBLE AS score
      FROM d LEFT JOIN g USING (r)"""


def _terms_sql(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


ORACLES: dict[str, str] = {
    "op11_ranked_search": f"""
      WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_terms_sql("text")} AS w FROM documents),
           c AS (SELECT count(*)::BIGINT AS texts, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0),
           i AS (SELECT row_number() OVER () AS i, item_id, {_terms_sql("text")} AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
           q AS (SELECT i, item_id, term, count(*)::BIGINT AS times FROM (SELECT i, item_id, unnest(w) AS term FROM i) GROUP BY ALL),
           p AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL),
           t AS (SELECT term, floor(1000 * ln((2 * texts + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, c GROUP BY term, texts),
           s AS (SELECT i, item_id, r, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * texts) // terms))))::BIGINT AS score
                 FROM p JOIN q USING (term) JOIN t USING (term), c GROUP BY ALL HAVING score > 0)
      SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM s
      QUALIFY row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) <= 10""",
    "op2_jaccard_join": f"""
      WITH RECURSIVE sh AS {_shingles_sql("documents", "doc_id", 4)}, n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
           met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
           link AS (SELECT x, y FROM met JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
           edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
           reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, edge.y FROM reach JOIN edge ON reach.r = edge.x)
      SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY 1, 2""",
    "op4_licenses": _licenses_sql(),
    "op3_mixture": _MIXTURE_SQL,
    "op9_decontaminate": f"""
      WITH item AS {_shingles_sql("benchmark", "item_id", 5)},
           doc AS {_shingles_sql("documents", "doc_id", 5)},
           size AS (SELECT item_id, count(*) AS n FROM item GROUP BY 1)
      SELECT doc_id, item_id, n AS n_shingles, count(*) AS n_shared, count(*) / n::DOUBLE AS containment
      FROM doc JOIN item USING (shingle) JOIN size USING (item_id)
      GROUP BY doc_id, item_id, n HAVING count(*) >= 0.8 * n - 1e-9""",
}
