"""Ranked search against scores of all documents, and against its SQL."""

import math
import random
import re
from collections import Counter

import pytest
from compare import duck_rows, spark_rows
from conftest import SF

from meridial.llm import queries, ranked_search
from meridial.llm.ranked_search import Queries, Searcher, ranked, term_counts


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, k):
    """(item, rank, doc, score): every document scored for every item."""
    counts = [(key, Counter(terms_of(t))) for key, t in docs]
    counts = [(key, c, c.total()) for key, c in counts if c]
    texts, terms = len(counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for key, c, n in counts:
            m = 100 - 75 + 75 * n * texts // terms
            s = sum(math.floor(1000 * math.log((2 * texts + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms_of(text) if t in c)
            if s > 0:
                scored.append((-s, key is None, key or 0))
        out += [(item, i + 1, None if null else key, -s) for i, (s, null, key) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = ["the", "of", "É", "Éa", "漢字", *(f"w{i}" for i in range(120))]
    # common words come first: word i is drawn with weight 1 / (i + 1)
    draw = lambda k: rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=k)
    docs = [(i, rng.choice([" ", "_", "\n- ", "! "]).join(draw(rng.choice([0, 1, 3, 30, 200])))) for i in range(n)]
    docs += [docs[7], docs[7], (None, docs[11][1]), (None, None), (n, None), (n + 1, ""), (n + 2, " !?\t"), (n + 3, "The WORD of w1 " * 3000)]
    items = [(i, " ".join(draw(rng.choice([1, 2, 8, 40])))) for i in range(40)] + [(0, "the"), (3, None), (None, "of w7"), (5, "nowhere else"), (50, "")]
    return docs, items + items[:3]


@pytest.mark.parametrize(("slice_postings", "block", "split"), [(1 << 20, 4 << 20, 1 << 20), (50, 64, 16)])
def test_equals_scores_of_all_documents(spark, monkeypatch, slice_postings, block, split):
    docs, items = corpus(4)
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", block if block > 64 else 2000)
    left = spark.createDataFrame([(k, t, 1, "x") for k, t in docs], "doc_id long, text string, score int, item_id string").repartition(3)
    right = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, doc_id int")
    got = sorted((tuple(r) for r in ranked(left, right).select("item_id", "rank", "doc_id", "score").collect()), key=repr)
    assert got == brute(docs, items, 10)
    # slices and splits of one process
    monkeypatch.setattr(ranked_search, "SLICE_POSTINGS", slice_postings)
    monkeypatch.setattr(ranked_search, "SPLIT_BYTES", split)
    counts = [c for _, c in (term_counts(t) for _, t in docs) if c]
    items = sorted(set(items), key=repr)
    wanted = [term_counts(t)[1] for _, t in items]
    own = Searcher(Queries(wanted, Counter(t for c in counts for t in c if any(t in w for w in wanted)), len(counts), sum(c.total() for c in counts)), 10)
    for d in docs:
        own.add(*d)
    own.search()
    assert sorted(((items[i][0], r + 1, None if null else k, s) for i, best in enumerate(own.best) for r, (s, null, k) in enumerate(best)), key=repr) == brute(docs, items, 10)


def test_accumulators_are_limited():
    """A document with common words alone gets none once ten with a rare word are known."""
    docs = [(i, "rare common the" if i < 12 else "common the filler" if i % 3 else "the other") for i in range(3000)]
    counts = [term_counts(t)[1] for _, t in docs]
    item = term_counts("rare common the")[1]
    own = Searcher(Queries([item], Counter(t for c in counts for t in c if t in item), len(counts), sum(c.total() for c in counts)), 10)
    made = []
    own._keep = lambda i, docs, scores: made.append(len(docs))
    for d in docs:
        own.add(*d)
    own.search()
    assert made == [12]


def test_ranked_search_sql(spark, duck):
    assert spark_rows(queries.QUERIES["op11_ranked_search"](spark, SF)) == duck_rows(duck.sql(queries.ORACLES["op11_ranked_search"]))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a word")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert ranked(docs.where("false"), items).count() == ranked(docs, items.where("false")).count() == 0
    assert [r["doc_id"] for r in ranked(docs, items).collect()] == [1]
