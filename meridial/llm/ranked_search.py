"""Ranked lexical search: term-at-a-time with a limited set of accumulators.

Every partition of the documents is an index of its own under the statistics of
the whole corpus, which a first pass counts. A second pass inverts the texts
slice by slice and takes an item's terms one at a time, rarest first. A document
that has a term gets an accumulator, until no further one can matter: once all
terms left together (each at its highest score in the slice) stay below the kth
partial score, a document without an accumulator cannot come among the first k.
From there on only documents that have one are updated, exactly, so no score is
an estimate. A partition carries each item's kth score from slice to slice, and
hands on at most k documents an item; the first k of all are a window's.

Scores are integers (see ``ranked``), so neither order nor partitioning can
change them. The items are the queries: they are sent to the executors in blocks
of bounded size, and each block is held against all documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of items that are sent to the executors together.
BLOCK_BYTES = 4 << 20
#: Places of items' terms (document, term, frequency) that are inverted together.
SLICE_POSTINGS = 1 << 20
#: Bytes of one text that are split together.
SPLIT_BYTES = 1 << 20

#: Terms of UTF-8 text in lower case: everything but ASCII that is no letter or digit.
_TERM, _GAP = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")


def term_counts(text: str | None) -> tuple[int, Counter]:
    """How many terms a text has, with repeats, and how often it has each (only A-Z are lower-cased)."""
    data, n, at, out = (text or "").encode().lower(), 0, 0, Counter()
    while at < len(data):
        gap = _GAP.search(data, at + SPLIT_BYTES) if at + SPLIT_BYTES < len(data) else None
        stop = gap.start() if gap else len(data)
        found = _TERM.findall(data, at, stop)
        n += len(found)
        out.update(found)
        at = stop
    return n, out


def _statistics(vocabulary):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, texts, terms, df = vocabulary.value, 0, 0, Counter()
        for b in batches:
            for t in b.column(0):
                n, counts = term_counts(t.as_py())
                texts += n > 0
                terms += n
                df.update(counts.keys() & known)
        yield pa.record_batch({"term": pa.array([None, *df], pa.binary()), "df": pa.array([texts, *df.values()], pa.int64()), "terms": pa.array([terms, *[0] * len(df)], pa.int64())})

    return rows


class Queries:
    """Items as terms in the order in which they are taken: rarest first, equally rare ones by their bytes."""

    def __init__(self, items: list[Counter], df: dict[bytes, int], texts: int, terms: int):
        self.texts, self.terms = texts, terms
        self.number = {t: i for i, t in enumerate(sorted(df, key=lambda t: (df[t], t)))}
        weight = {t: math.floor(1000 * math.log((2 * texts + 2) / (2 * n + 1))) for t, n in df.items()}
        self.items = [sorted((self.number[t], c * weight[t]) for t, c in item.items() if weight.get(t, 0) > 0) for item in items]


class Searcher:
    """The best documents of each item among those added so far."""

    def __init__(self, queries: Queries, k: int):
        self.queries, self.k = queries, k
        self.best: list[list[tuple[int, bool, int]]] = [[] for _ in queries.items]
        self._clear()

    def _clear(self) -> None:
        self.ids, self.lengths = [], []
        self.at, self.terms, self.tf = [], [], []

    def add(self, key: int | None, text: str | None) -> None:
        n, counts = term_counts(text)
        number = self.queries.number
        for t in counts.keys() & number.keys():
            self.at.append(len(self.ids))
            self.terms.append(number[t])
            self.tf.append(counts[t])
        if n:
            self.ids.append(key)
            self.lengths.append(n)
        if len(self.at) >= SLICE_POSTINGS:
            self.search()

    def search(self) -> None:
        """Invert the documents added since the last time, and rank them for all items."""
        q = self.queries
        # Python's integers: n * N may exceed 64 bits
        m = np.array([100 - 75 + 75 * n * q.texts // q.terms for n in self.lengths], np.int64)
        at, terms, tf = (np.array(x, np.int64) for x in (self.at, self.terms, self.tf))
        order = np.argsort(terms, kind="stable")
        at, terms, tf = at[order], terms[order], tf[order]
        gain = 1_000_000_000 * tf // (1000 * tf + 8 * m[at])
        first = np.searchsorted(terms, np.arange(len(q.number) + 1))
        for i, item in enumerate(q.items):
            postings = [(at[first[t] : first[t + 1]], gain[first[t] : first[t + 1]] * w) for t, w in item if first[t] < first[t + 1]]
            if postings:
                self._keep(i, *self._accumulate(postings, self.best[i][-1][0] if len(self.best[i]) == self.k else 0))
        self._clear()

    def _accumulate(self, postings: list[tuple[np.ndarray, np.ndarray]], least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents with an accumulator and their scores; all others score less than k documents."""
        left = np.cumsum([int(s.max()) for _, s in postings][::-1])[::-1]
        total, met = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), bool)
        taken = 0
        for docs, scores in postings:
            if left[taken] < max(least, self._kth(total[met])):
                break
            total[docs] += scores
            met[docs] = True
            taken += 1
        survivors = np.flatnonzero(met)
        score = total[survivors]
        for docs, scores in postings[taken:]:
            place = np.minimum(np.searchsorted(docs, survivors), len(docs) - 1)
            score += np.where(docs[place] == survivors, scores[place], 0)
        return survivors, score

    def _kth(self, scores: np.ndarray) -> int:
        return int(np.partition(scores, -self.k)[-self.k]) if len(scores) >= self.k else 0

    def _keep(self, i: int, docs: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= max(1, self._kth(scores))
        new = [(int(s), self.ids[d] is None, self.ids[d] or 0) for d, s in zip(docs[good], scores[good], strict=True)]
        self.best[i] = sorted(self.best[i] + new, key=lambda x: (-x[0], *x[1:]))[: self.k]


def _search(queries, k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Searcher(queries.value, k)
        for b in batches:
            for key, text in zip(b.column(0), b.column(1), strict=True):
                own.add(key.as_py(), text.as_py())
        own.search()
        found = [(i, None if null else key, score) for i, best in enumerate(own.best) for score, null, key in best]
        item, key, score = zip(*found, strict=True) if found else ((), (), ())
        yield pa.record_batch({"item": pa.array(item, pa.int64()), "doc_id": pa.array(key, pa.int64()), "score": pa.array(score, pa.int64())})

    return rows


def _ranked_block(docs: DataFrame, rows: list, k: int) -> DataFrame:
    spark = docs.sparkSession
    items = [term_counts(r["text"])[1] for r in rows]
    vocabulary = spark.sparkContext.broadcast(frozenset().union(*items))
    counted = docs.select("text").mapInArrow(_statistics(vocabulary), "term binary, df bigint, terms bigint").groupBy("term").agg(F.sum("df").alias("df"), F.sum("terms").alias("terms"))
    # at most one row a term of the block
    found = {None if r["term"] is None else bytes(r["term"]): r for r in counted.collect()}
    texts, terms = (found[None]["df"], found[None]["terms"]) if None in found else (0, 0)
    queries = spark.sparkContext.broadcast(Queries(items, {t: r["df"] for t, r in found.items() if t is not None}, texts, terms))
    best = docs.mapInArrow(_search(queries, k), "item bigint, doc_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], "item bigint, item_id bigint")
    return best.withColumn("rank", rank).where(F.col("rank") <= k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score of each item's first ``k`` documents with a score above 0.

    Of ``N`` documents with terms and their ``L`` terms in all, a term that ``df``
    have weighs ``floor(1000 * ln((2N + 2) / (2df + 1)))``. A document of ``n``
    terms that has it ``tf`` times adds the weight times ``10**9 * tf div (1000 *
    tf + 8 * m)`` for each time that the item has it, ``m = 25 + 75 * n * N div L``.

    Null and empty texts have no terms: such documents do not count, such items
    have no rows. Every row of ``docs`` is a document, so repeated ones take a
    rank each; a null key comes after all others among equal scores. Equal rows
    of ``items`` are one item, of a repeated key with two texts each is ranked.
    Other columns are not read.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    items = items.select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES) or 1
    of = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    # the blocks are one after the other only while they are planned: each is a job of its own
    out = [_ranked_block(docs, sorted(items.where(of == b).collect(), key=str), k) for b in range(blocks)]
    for other in out[1:]:
        out[0] = out[0].unionByName(other)
    return out[0]
