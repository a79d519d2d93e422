"""Benchmark decontamination: size-partitioned MinHash containment search.

Short test items are looked for inside documents of any length. Similarity of
whole sets is of no use there (an item of 30 shingles in a document of 3,000
has a Jaccard similarity of 0.01), so the search is one-sided: of each item a
bottom-k MinHash sketch is kept, and a document is a candidate if it holds at
least one sketched shingle. The items are partitioned by size, in powers of two;
all items of a class have sketches of one length, ``k = floor((1 - threshold) *
n) + 1`` for the largest ``n`` of the class: a document that holds the
threshold's share of an item's shingles misses fewer than that, so it always
meets the sketch and none is lost. A document asks only the classes whose least
item it is large enough to hold. Candidates are verified by exact containment
over all shingles.

An item of fewer words than a shingle is looked for as it is: of each such
length that occurs among the items, all windows of the documents are hashed too,
and a document that has the item's words in a row anywhere holds all of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridial.llm import _text
from meridial.llm._work import cut

#: Up to this many shingle hashes of items (8 bytes each) are sent to all
#: executors; more are joined by a shuffle.
MAX_BROADCAST_HASHES = 1_000_000


def _item_rows(text: str, shingle: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s.view(np.int64) for s in _text.shingle_sets(b.column(text), shingle)]
            data, at = _text.utf8_buffers(b.column(text))
            words = [np.diff(_text.words_of(data, at[a : z + 1])[1]) for a, z in _text.slices(at)]
            words = np.concatenate(words) if words else np.zeros(0, np.int64)
            yield pa.record_batch({"item_id": b.column("item_id").cast(pa.int64()), "hashes": pa.array(sets, pa.list_(pa.int64())), "short": pa.array(np.where(words < shingle, words, 0), pa.int32())})

    return rows


def item_hashes(items: DataFrame, text: str = "text", shingle: int = 5) -> DataFrame:
    """item and the distinct shingle hashes of its text (null or without words: none).

    ``short`` is the number of words of an item of fewer than a shingle, else 0.
    """
    return items.select("item_id", text).mapInArrow(_item_rows(text, shingle), "item_id bigint, hashes array<bigint>, short int")


def item_sketches(items: DataFrame, threshold: float) -> DataFrame:
    """item, size class, size, sketch and all hashes of items that have shingles.

    ``hashes`` are sorted as unsigned numbers, so a prefix is the bottom-k
    sketch. ``least`` is the size of document that may hold an item of the class.
    """
    n = F.size("hashes")
    of = F.floor(F.log2(n.cast("double"))).cast("int")
    low, high = F.pow(F.lit(2), of), F.pow(F.lit(2), of + 1) - 1
    return items.where(n > 0).select(
        "item_id",
        of.alias("size_class"),
        n.cast("long").alias("n_shingles"),
        F.ceil(F.lit(threshold) * low - F.lit(1e-9)).cast("long").alias("least"),
        F.slice("hashes", F.lit(1), (high - F.ceil(F.lit(threshold) * high - F.lit(1e-9)) + 1).cast("int")).alias("sketch"),
        "hashes",
    )


class ItemIndex:
    """Sketches of the items by size class, and their hashes, in one process."""

    def __init__(self, rows: list, threshold: float):
        self.threshold = threshold
        self.ids = [r["item_id"] for r in rows]
        self.sets = [np.array(r["hashes"], np.int64).view(np.uint64) for r in rows]
        self.classes = []
        for c in sorted({r["size_class"] for r in rows}):
            pairs = sorted((h, i) for i, r in enumerate(rows) if r["size_class"] == c for h in np.array(r["sketch"], np.int64).view(np.uint64).tolist())
            least = next(r["least"] for r in rows if r["size_class"] == c)
            self.classes.append((least, np.array([h for h, _ in pairs], np.uint64), np.array([i for _, i in pairs], np.int64)))

    def held_by(self, s: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item's position, shared hashes) of items of which a document's set holds the threshold's share."""
        for least, sketch, owner in self.classes:
            if len(s) < least:
                continue
            at = np.searchsorted(sketch, s)
            met = at[(at < len(sketch)) & (sketch[np.minimum(at, len(sketch) - 1)] == s)]
            if not len(met):
                continue
            # equal hashes of several items stand next to each other
            ends = np.searchsorted(sketch, sketch[met], "right")
            for i in np.unique(np.concatenate([owner[a:z] for a, z in zip(met, ends, strict=True)])):
                shared = int(np.isin(self.sets[i], s, assume_unique=True).sum())
                if shared >= self.threshold * len(self.sets[i]) - 1e-9:
                    yield int(i), shared


def _search(index, shingle: int, short: tuple[int, ...], key: str, text: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = index.value
        for b in batches:
            keys = b.column(key).cast(pa.int64()).to_pylist()
            out: list[tuple] = []
            for doc, s in zip(keys, _text.shingle_sets(b.column(text), shingle, short), strict=True):
                out += [(doc, found.ids[i], len(found.sets[i]), n, n / len(found.sets[i])) for i, n in found.held_by(s)]
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [key, "item_id", "n_shingles", "n_shared", "containment"])

    return rows


def _clean(index, shingle: int, short: tuple[int, ...], text: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = index.value
        for b in batches:
            yield b.filter(pa.array([next(found.held_by(s), None) is None for s in _text.shingle_sets(b.column(text), shingle, short)], pa.bool_()))

    return rows


def _index(docs: DataFrame, sketches: DataFrame, threshold: float):
    return docs.sparkSession.sparkContext.broadcast(ItemIndex(sketches.collect(), threshold))


def _measured(items: DataFrame, text: str, shingle: int) -> tuple[DataFrame, int, tuple[int, ...]]:
    """Hashed items, the number of their hashes, and the lengths of those of fewer words than a shingle."""
    hashed = item_hashes(items, text, shingle)
    # at most one length for each number of words below a shingle's
    size, lengths = hashed.agg(F.sum(F.size("hashes")), F.collect_set("short")).first()
    return hashed, size or 0, tuple(sorted(n for n in lengths if n > 0))


def _dealt(docs: DataFrame, sketches: DataFrame, shingle: int, short: tuple[int, ...], threshold: float, key: str, text: str) -> DataFrame:
    """Matches with the documents' row numbers, both sides dealt by hash: nothing is broadcast.

    ``docs`` has a column ``row`` that stays what it is; so must the items, which are written first.
    """
    items = cut(sketches.withColumn("item", F.monotonically_increasing_id()))
    ours = cut(docs.select("row", key, text).mapInArrow(_rowed(key, text, shingle, short), f"row bigint, {key} bigint, hashes array<bigint>"))
    hashes = ours.select("row", F.size("hashes").alias("n"), F.explode("hashes").alias("hash"))
    met = hashes.join(items.select("item", "least", F.explode("sketch").alias("hash")), "hash").where("n >= least").select("row", "item").distinct()
    met = cut(met)
    # every item hash that the document holds, for the pairs that met
    asked = met.join(items.select("item", "item_id", "n_shingles", F.explode("hashes").alias("hash")), "item")
    some = ours.join(met.select("row").distinct(), "row", "left_semi").select("row", key, F.explode("hashes").alias("hash"))
    shared = some.join(asked, ["row", "hash"]).groupBy("row", "item").agg(F.first(key).alias(key), F.first("item_id").alias("item_id"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("n_shared"))
    return shared.where(F.col("n_shared") >= threshold * F.col("n_shingles") - 1e-9)


def find_contamination(docs: DataFrame, items: DataFrame, *, shingle: int = 5, threshold: float = 0.8, key: str = "doc_id", text: str = "text", max_broadcast: int = MAX_BROADCAST_HASHES) -> DataFrame:
    """One row for each document and test item of which it holds ``threshold`` or more.

    Returns ``doc_id, item_id, n_shingles`` (of the item), ``n_shared,
    containment``. An item of fewer than ``shingle`` words counts as one shingle
    and is found wherever a document has its words in a row, so one of a single
    common word is found in most. Null, empty and wordless texts and items never match. Rows
    that repeat an id, or have none, count as rows of their own on both sides.
    Other columns of the inputs are not read.
    """
    hashed, size, short = _measured(items, text, shingle)
    sketches = item_sketches(hashed, threshold)
    if size <= max_broadcast:
        index = _index(docs, sketches, threshold)
        return docs.select(key, text).mapInArrow(_search(index, shingle, short, key, text), f"{key} bigint, item_id bigint, n_shingles bigint, n_shared bigint, containment double")
    rowed = cut(docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias(key), text))
    shared = _dealt(rowed, sketches, shingle, short, threshold, key, text)
    return shared.select(key, "item_id", "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, *, shingle: int = 5, threshold: float = 0.8, text: str = "text", max_broadcast: int = MAX_BROADCAST_HASHES) -> DataFrame:
    """The rows of ``docs``, all columns, that hold less than ``threshold`` of every item.

    Rows are judged by their text alone, so null and repeated ids make no difference.
    """
    hashed, size, short = _measured(items, text, shingle)
    sketches = item_sketches(hashed, threshold)
    if size <= max_broadcast:
        return docs.mapInArrow(_clean(_index(docs, sketches, threshold), shingle, short, text), docs.schema)
    rowed = cut(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")))
    texts = rowed.select("row", F.lit(0).cast("long").alias("key"), F.col(f"doc.{text}").alias(text))
    gone = _dealt(texts, sketches, shingle, short, threshold, "key", text).select("row").distinct()
    return rowed.join(gone, "row", "left_anti").select("doc.*")


def _rowed(key: str, text: str, shingle: int, short: tuple[int, ...]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s.view(np.int64) for s in _text.shingle_sets(b.column(text), shingle, short)]
            yield pa.record_batch({"row": b.column("row"), key: b.column(key).cast(pa.int64()), "hashes": pa.array(sets, pa.list_(pa.int64()))})

    return rows
