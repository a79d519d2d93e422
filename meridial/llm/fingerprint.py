"""Document fingerprints: one-permutation MinHash with packed low-order bits.

Every shingle is hashed once. The high bits of the hash choose one of ``bins``
bins, and each bin keeps its least hash. An empty bin borrows from a bin found
by its own fixed random sequence (optimal densification: the sequence depends on
the empty bin and the attempt only, so two texts borrow alike). Only ``bits``
low-order bits of each bin's value are kept, packed and written in base64;
``likeness`` takes the chance agreement of such values out again.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridial.llm import _text
from meridial.llm._work import partitions


class OnePermutation:
    """Fingerprints of shingle sets.

    ``bins`` and ``bits`` are powers of two, ``bits`` of 1, 2, 4 or 8. The
    fingerprint of a text without words is the empty string.
    """

    def __init__(self, bins: int = 512, bits: int = 4, shingle: int = 5):
        self.bins, self.bits, self.shingle = bins, bits, shingle
        self.shift = np.uint64(64 - (bins.bit_length() - 1))
        self.bounds = np.arange(bins, dtype=np.uint64) << self.shift
        self._attempts: list[np.ndarray] = []

    def _candidates(self, block: int) -> np.ndarray:
        """Bins that each bin tries in the attempts of a block: bins x 64."""
        while len(self._attempts) <= block:
            at = np.uint64(len(self._attempts))
            i = (at * np.uint64(64) + np.arange(64, dtype=np.uint64))[None, :] + (np.arange(self.bins, dtype=np.uint64)[:, None] << np.uint64(32)) + np.uint64(1)
            self._attempts.append((_text.mix(i) >> self.shift).astype(np.int64))
        return self._attempts[block]

    def values(self, hashes: np.ndarray) -> np.ndarray:
        """The low-order bits of every bin; ``hashes`` are sorted and not empty."""
        at = np.searchsorted(hashes, self.bounds)
        least = hashes[np.minimum(at, len(hashes) - 1)]
        full = (at < len(hashes)) & (least >> self.shift == np.arange(self.bins, dtype=np.uint64))
        source = np.arange(self.bins)
        empty, block = np.flatnonzero(~full), 0
        while len(empty):
            tried = self._candidates(block)[empty]
            hit = full[tried]
            first, found = hit.argmax(1), hit.any(1)
            source[empty[found]] = tried[found, first[found]]
            empty, block = empty[~found], block + 1
        return (_text.mix(least[source]) & np.uint64((1 << self.bits) - 1)).astype(np.uint8)

    def pack(self, values: np.ndarray) -> str:
        bits = np.unpackbits(values[:, None], axis=1)[:, 8 - self.bits :]
        return base64.b64encode(np.packbits(bits.ravel()).tobytes()).decode()

    def of_texts(self, texts: pa.Array) -> list[np.ndarray | None]:
        return [self.values(s) if len(s) else None for s in _text.shingle_sets(texts, self.shingle)]

    def likeness(self, a: np.ndarray | None, b: np.ndarray | None) -> float:
        """Estimated Jaccard similarity; two texts without words are alike."""
        if a is None or b is None:
            return float(a is b)
        chance = 1 / (1 << self.bits)
        return float(np.clip(((a == b).mean() - chance) / (1 - chance), 0, 1))


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", bins: int = 512, bits: int = 4, shingle: int = 5) -> DataFrame:
    """``key`` and ``fingerprint`` of every whole text (null: as empty). No shuffle."""
    one = OnePermutation(bins, bits, shingle)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [one.pack(v) if v is not None else "" for v in one.of_texts(b.column(text))]
            yield pa.record_batch([b.column(key).cast(pa.int64()), pa.array(made, pa.string())], [key, "fingerprint"])

    return docs.select(key, text).mapInArrow(rows, f"{key} bigint, fingerprint string")


def _bucket(value, bounds: list[int]):
    """The number of ``bounds`` (sorted) that are at most ``value``, by binary search."""
    if not bounds:
        return F.lit(0)
    half = len(bounds) // 2
    # each level of the tree is one comparison
    return F.when(value < bounds[half], _bucket(value, bounds[:half])).otherwise(_bucket(value, bounds[half + 1 :]) + half + 1)


def in_order_with_successor(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``bucket, follows, key, text`` in partitions sorted by key.

    The keys are cut at quantiles into buckets; each bucket is followed by a
    copy (``follows``) of the first row of the next bucket, the last by the
    table's first row, so that every row's successor stands right behind it
    without a join. Only quantiles of the key and one key a bucket reach the
    driver; each text is shuffled once. Ties of the key go by text; null keys
    come first.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias(key), F.coalesce(text, F.lit("")).alias(text))
    n = partitions(spark)
    many = 4 * n
    cuts = docs.select(F.percentile_approx(key, [i / many for i in range(1, many)], 10 * many)).first()[0] or []
    bucket = F.when(F.col(key).isNull(), 0).otherwise(_bucket(F.col(key), sorted(set(cuts))))
    docs = docs.withColumn("bucket", bucket)
    # a null key is the least of all
    heads = docs.groupBy("bucket").agg(F.min(F.struct(key)).getField(key).alias("head"))
    before = Window.orderBy("bucket")
    heads = heads.withColumn("to", F.coalesce(F.lag("bucket").over(before), F.max("bucket").over(Window.partitionBy()))).collect()
    target = {r["head"]: r["to"] for r in heads}
    known = [k for k in target if k is not None]
    head = F.col(key).isin(known) if known else F.lit(False)
    if None in target:
        head = head | F.col(key).isNull()
    first = docs.where(head).groupBy("bucket", key).agg(F.min(text).alias(text))
    first = first.join(F.broadcast(spark.createDataFrame([(k, v) for k, v in target.items()], "head long, to int")), F.col(key).eqNullSafe(F.col("head")))
    rows = docs.select("bucket", F.lit(0).alias("follows"), key, text).unionByName(first.select(F.col("to").alias("bucket"), F.lit(1).alias("follows"), key, text))
    return rows.repartition(n, "bucket").sortWithinPartitions("bucket", "follows", key, text)


def _edited(one: OnePermutation, key: str, text: str):
    def flush(block: list[tuple]) -> pa.RecordBatch:
        """block: (bucket, follows, key, text) in order; the last only serves as successor."""
        texts = [r[3] for r in block]
        rows = [i for i in range(len(block) - 1) if not block[i][1]]
        edited = []
        for i in rows:
            t, k = texts[i], len(texts[i]) // 4
            edited.append(t[: len(t) - k] + texts[i + 1][:k])
        own = one.of_texts(pa.array(texts, pa.large_string()))
        new = one.of_texts(pa.array(edited, pa.large_string()))
        return pa.record_batch(
            {
                key: pa.array([block[i][2] for i in rows], pa.int64()),
                "n_chars": pa.array([len(texts[i]) for i in rows], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                "fingerprint": pa.array([one.pack(own[i]) if own[i] is not None else "" for i in rows], pa.string()),
                "edited_fingerprint": pa.array([one.pack(v) if v is not None else "" for v in new], pa.string()),
                "near_edited": pa.array([one.likeness(own[i], v) for i, v in zip(rows, new, strict=True)], pa.float64()),
                "near_next": pa.array([one.likeness(own[i], own[i + 1]) for i in rows], pa.float64()),
            }
        )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        held = 0
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("bucket", "follows", key, text)), strict=True):
                block.append(r)
                held += len(r[3])
                if held > _text.SLICE_BYTES and len(block) > 1:
                    yield flush(block)
                    block, held = block[-1:], len(r[3])
        if len(block) > 1:
            yield flush(block)

    return rows


def edited_fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", bins: int = 512, bits: int = 4, shingle: int = 5) -> DataFrame:
    """Fingerprints of every text and of its edited form.

    The edited form has its last quarter (whole code points, rounded down)
    replaced by the first as many code points (or all) of the next text by
    ascending key; after the last comes the first, and a lone text follows
    itself. Null texts are empty; empty texts have the fingerprint ''.
    """
    one = OnePermutation(bins, bits, shingle)
    schema = f"{key} bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order_with_successor(docs, key, text).mapInArrow(_edited(one, key, text), schema)
