"""Exact nearest profiles of all targets: what all pairs give, without a row a pair.

The targets of a block are dealt over groups of a bound size, and a block's
entities are streamed past each group in the order of their ids. A matrix
product in single precision screens targets against entities: what it says of a
pair, less a bound of its rounding errors, has to be within the distance of the
target's k-th neighbour so far. Only pairs that pass are scored, in double
precision. Entities are tiled by their nearest pivot; tiles whose ranges of
values are too far from a tile of targets are not met at all. So the result is
that of all pairs, and a task holds its targets, k neighbours of each and one
buffer of entities.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridial.sources.scratch import written

#: The most and the fewest targets of a group, if there are more in a block.
TARGETS = (65_536, 4_096)
#: Targets and entities of one matrix product.
_ROWS, _MET = 512, 4_096
#: Ranks behind all distances: infinite, not a number, none (null), and no neighbour yet.
_INFINITE, _NAN, _NONE, _EMPTY = 1.5e308, 1.6e308, 1.7e308, 1.75e308
#: Larger values are not screened, as their squares leave single precision.
_LARGE = 1e15


def nearest(packed: DataFrame, block: Sequence[str], k: int, min_common: int, *, targets: DataFrame | None = None, by_length: bool = False, pivots: int = 32) -> DataFrame:
    """``target, neighbour, distance, n_common``: of every row of ``packed`` (``*block, _e, _v``) the ``k`` nearest within its block.

    ``_v`` is an array whose nulls are missing. A distance is the root mean square
    over what both have, ``by_length`` over the length of the target's array;
    rounded to 3 places and ranked by it, then by id. Pairs with fewer than
    ``min_common`` do not count; one with nothing in common has no distance and
    comes last. Null ids and null blocks have no neighbours.
    """
    block, spark = list(block), packed.sparkSession
    rows = written(packed.select(*block, "_e", "_v").where(F.col("_e").isNotNull()))
    sizes = written(rows.groupBy(*block).agg(F.count("*").alias("_of"), F.max(F.size("_v")).alias("_width")).withColumn("_b", F.monotonically_increasing_id()))
    every, blocks, width = sizes.agg(F.sum("_of"), F.count("*"), F.max("_width")).first()
    slots = spark.sparkContext.defaultParallelism
    together = min(TARGETS[0], max(TARGETS[1], (every or 0) // (8 * slots)))
    parts = max(1, min(16 * slots, blocks + (every or 0) // together))
    sizes = sizes.select(*block, "_b", F.ceil(F.col("_of") / together).cast("int").alias("_chunks"))
    known = rows.join(sizes, block) if block else rows.crossJoin(F.broadcast(sizes))  # one row
    asking = known if targets is None else known.join(targets.select(F.col(targets.columns[0]).alias("_e")).distinct(), "_e", "left_semi")
    asks = asking.select("_b", F.pmod(F.xxhash64("_e"), F.col("_chunks")).cast("int").alias("_chunk"), F.lit(0).alias("_role"), "_e", "_v")
    met = known.select("_b", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_chunk"), F.lit(1).alias("_role"), "_e", "_v")
    dealt = asks.unionByName(met).repartition(parts, "_b", "_chunk").sortWithinPartitions("_b", "_chunk", "_role", "_e")
    kind = packed.schema["_e"].dataType.simpleString()
    # written, so that whoever reads neighbours twice does not look for them again
    return written(dealt.mapInArrow(partial(_met, k=k, least=min_common, by_length=by_length, width=max(1, width or 0), pivots=pivots), f"target {kind}, neighbour {kind}, distance double, n_common bigint"))


def _met(batches: Iterator[pa.RecordBatch], **how) -> Iterator[pa.RecordBatch]:
    """Rows in the order of group, role and id; a group is done when the next begins."""
    at, group = None, None
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy() for i in range(3)]).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.any(keys[:, 1:] != keys[:, :-1], axis=0)) + 1), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            if at != (now := tuple(keys[:2, lo])):
                if group is not None:
                    yield from group.found()
                at, group = now, _Group(**how)
            (group.meet if keys[2, lo] else group.ask)(batch.column(3).slice(lo, hi - lo), batch.column(4).slice(lo, hi - lo))
    if group is not None:
        yield from group.found()


class _Profiles:
    """Values (0 where missing), what is there, and packed bits of it, of some rows."""

    def __init__(self, ids: list[pa.Array], arrays: list[pa.Array], width: int):
        self.ids = pa.concat_arrays(ids)
        n = len(self.ids)
        self.v, self.has, self.length = np.zeros((n, width)), np.zeros((n, width), bool), np.zeros(n)
        start = 0
        for a in arrays:
            lengths = np.diff(a.offsets.to_numpy()) * np.asarray(a.is_valid())
            self.length[start : start + len(a)] = lengths
            flat = a.flatten()
            row = np.repeat(np.arange(start, start + len(a)), lengths)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            there = np.asarray(flat.is_valid())
            self.has[row, place] = there
            self.v[row[there], place[there]] = flat.drop_null().to_numpy(zero_copy_only=False)
            start += len(a)
        bits = np.packbits(self.has, axis=1)
        self.bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view(np.uint64)
        self.wild = ~np.all(np.abs(self.v) <= _LARGE, axis=1)

    def ordered(self, order: np.ndarray) -> _Profiles:
        out = object.__new__(_Profiles)
        out.ids = self.ids.take(pa.array(order))
        for name in ("v", "has", "length", "bits", "wild"):
            setattr(out, name, getattr(self, name)[order])
        return out

    def box(self, lo: int, hi: int) -> tuple:
        v, has = self.v[lo:hi], self.has[lo:hi]
        return np.where(has, v, np.inf).min(0), np.where(has, v, -np.inf).max(0), has.any(0), has.all(0), bool(self.wild[lo:hi].any())

    def tiles(self, pivots: np.ndarray) -> np.ndarray:
        """An order in which rows of one nearest pivot stand together."""
        v = np.where(self.wild[:, None], 0.0, self.v)
        return np.argsort(((pivots * pivots).sum(1) - 2 * v @ pivots.T).argmin(1), kind="stable")


class _Group:
    """Some targets of a block, and the nearest of the entities that they have met."""

    def __init__(self, k: int, least: int, by_length: bool, width: int, pivots: int):
        self.k, self.least, self.by_length, self.width, self.most_pivots = k, least, by_length, width, pivots
        self.asked: tuple[list, list] = ([], [])
        self.waiting: tuple[list, list, int] = ([], [], 0)
        self.buffer = min(65_536, max(_MET, (1 << 21) // width))
        self.targets: _Profiles | None = None

    def ask(self, ids: pa.Array, arrays: pa.Array) -> None:
        self.asked[0].append(ids)
        self.asked[1].append(arrays)

    def _ready(self) -> None:
        t = _Profiles(*self.asked, self.width)
        self.asked = ([], [])
        self.pivots = t.v[~t.wild][: self.most_pivots]
        t = self.targets = t.ordered(t.tiles(self.pivots)) if len(self.pivots) else t
        self.names = t.ids.to_numpy(zero_copy_only=False)
        n = len(t.ids)
        self.rank, self.code, self.common = np.full((n, self.k), _EMPTY), np.full((n, self.k), -1, np.int64), np.zeros((n, self.k), np.int64)
        self.seen, self.held = 0, (np.empty(0, np.int64), t.ids.slice(0, 0))
        # around the middle, so that the squares are small
        self.middle = np.where(t.wild[:, None], 0.0, t.v).sum(0) / np.maximum(1, (t.has & ~t.wild[:, None]).sum(0))
        self.square = (self._middled(t) ** 2).sum(1)
        self.boxes = [t.box(i, i + _ROWS) for i in range(0, n, _ROWS)]

    def _middled(self, p: _Profiles) -> np.ndarray:
        return np.where(p.has & ~p.wild[:, None], p.v - self.middle, 0.0)

    def meet(self, ids: pa.Array, arrays: pa.Array) -> None:
        if self.targets is None:
            if not self.asked[0]:
                return
            self._ready()
        self.waiting[0].append(ids)
        self.waiting[1].append(arrays)
        self.waiting = (*self.waiting[:2], self.waiting[2] + len(ids))
        if self.waiting[2] >= self.buffer:
            self._flush()

    def _flush(self) -> None:
        if not self.waiting[2]:
            return
        near = _Profiles(*self.waiting[:2], self.width)
        self.waiting = ([], [], 0)
        codes = self.seen + np.arange(len(near.ids))
        self._hold(codes, near.ids)
        cuts = [0]
        if not self.seen:  # the first are met in growing steps, as there are no bounds yet
            while cuts[-1] < min(_MET, len(codes)):
                cuts.append(min(len(codes), max(64, 2 * cuts[-1])))
        order = np.arange(len(codes))
        if len(self.pivots):
            rest = near.ordered(order[cuts[-1] :])
            order[cuts[-1] :] = cuts[-1] + rest.tiles(self.pivots)
            near, codes = near.ordered(order), codes[order]
        cuts += [*range(cuts[-1] + _MET, len(codes), _MET), len(codes)]
        names, at = near.ids.to_numpy(zero_copy_only=False), self._middled(near)
        for lo, hi in zip(cuts, cuts[1:]):
            if lo < hi:
                self._compare(near, names, at, codes, lo, hi)
        self.seen += len(codes)

    def _hold(self, codes: np.ndarray, ids: pa.Array) -> None:
        """Ids by code; those that no target has any more go when there are too many."""
        self.held = (np.concatenate([self.held[0], codes]), pa.concat_arrays([self.held[1], ids]))
        if len(self.held[0]) > 4 * self.code.size + 1_000_000:
            used = np.union1d(self.code[self.code >= 0], codes)
            self.held = (used, self.held[1].take(pa.array(np.searchsorted(self.held[0], used))))

    def _compare(self, near: _Profiles, names: np.ndarray, at: np.ndarray, codes: np.ndarray, lo: int, hi: int) -> None:
        t, w, box = self.targets, self.width, near.box(lo, hi)
        v, has, wild = at[lo:hi], near.has[lo:hi], near.wild[lo:hi]
        squares, first, full = v * v, codes[lo:hi].min(), bool(has.all())
        most = squares.sum(1).max()
        sides: dict = {}
        for i, start in enumerate(range(0, len(t.ids), _ROWS)):
            rows = np.arange(start, min(start + _ROWS, len(t.ids)))
            # an entity of the same distance goes before one of a larger code only
            last = self.rank[rows, -1]
            reach = np.where(last < _INFINITE, (last + np.where(self.code[rows, -1] > first, 0.5, -0.5)) / 1000, np.inf)
            rows, reach = rows[reach >= 0], reach[reach >= 0]
            if not len(rows) or self._apart(self.boxes[i], box, reach.max(), t.length[rows].max()):
                continue
            free = t.wild[rows] | np.isinf(reach)
            square = np.where(free, 0.0, reach) ** 2
            plain = full and bool(t.has[rows].all())
            mean = t.length[rows] if self.by_length else np.full(len(rows), float(w))
            m = t.has[rows]
            a = np.where(m & ~t.wild[rows, None], t.v[rows] - self.middle, 0.0)
            if plain:
                left, limit = np.concatenate([-2 * a, (a * a).sum(1)[:, None], np.ones((len(rows), 1))], 1), square * mean
            elif self.by_length:
                left, limit = np.concatenate([a * a, m, -2 * a], 1), square * mean
            else:
                left, limit = np.concatenate([a * a - square[:, None] * m, m, -2 * a], 1), np.zeros(len(rows))
            left[free] = 0.0
            for kind in (np.float32, np.float64):
                if (kind, plain) not in sides:
                    right = np.concatenate([v.T, np.ones((1, hi - lo)), squares.sum(1)[None]] if plain else [has.T, squares.T, v.T])
                    right[:, wild] = 0.0
                    sides[kind, plain] = right.astype(kind)
                # each of the products, sums and roundings to ``kind`` is off by no more than this share
                slack = 1.1 * (3 * w + 8) * np.finfo(kind).eps * (2 * (self.square[rows] + most) + square * w)
                with np.errstate(all="ignore"):
                    passed = left.astype(kind) @ sides[kind, plain] <= np.where(free, np.inf, (limit + slack) * 1.00001).astype(kind)[:, None]
                hits = np.flatnonzero(passed)
                if len(hits) <= passed.size // 16 or free.all():
                    break
            for some in range(0, len(hits), 1 << 17):
                ti, ni = np.divmod(hits[some : some + (1 << 17)], hi - lo)
                self._score(rows[ti], lo + ni, near, names, codes)

    def _apart(self, a: tuple, b: tuple, reach: float, length: float) -> bool:
        """Whether no entity of a tile can be within reach of a target of another."""
        if a[4] or b[4] or np.isinf(reach):
            return False
        both = int((a[2] & b[2]).sum())
        if both < self.least:
            return True
        gaps = np.maximum(0.0, np.maximum(a[0] - b[1], b[0] - a[1]))[a[3] & b[3]]
        return (gaps**2).sum() > reach * reach * (length if self.by_length else both) * 1.000001

    def _score(self, ti: np.ndarray, ni: np.ndarray, near: _Profiles, names: np.ndarray, codes: np.ndarray) -> None:
        t = self.targets
        common = np.bitwise_count(t.bits[ti] & near.bits[ni]).sum(1).astype(np.int64)
        kept = (common >= self.least) & (self.names[ti] != names[ni])
        ti, ni, common = ti[kept], ni[kept], common[kept]
        rank = np.empty(len(ti))
        for lo in range(0, len(ti), 1 << 15):
            i, j = ti[lo : lo + (1 << 15)], ni[lo : lo + (1 << 15)]
            with np.errstate(all="ignore"):
                gaps = np.where(t.has[i] & near.has[j], t.v[i] - near.v[j], 0.0)
                total = np.einsum("ij,ij->i", gaps, gaps)
                x = np.floor((np.sqrt(total / (t.length[i] if self.by_length else common[lo : lo + (1 << 15)])) + 1e-9) * 1000 + 0.5)
            x = np.where(np.isnan(x), _NAN, np.where(np.isinf(x), _INFINITE, x))
            rank[lo : lo + (1 << 15)] = np.where(common[lo : lo + (1 << 15)] == 0, _NONE, x)
        kept = rank <= self.rank[ti, -1]
        ti, rank, code, common = ti[kept], rank[kept], codes[ni[kept]], common[kept]
        if not len(ti):
            return
        # the targets' neighbours so far and the new ones, and of each target the first k
        touched = np.unique(ti)
        ti = np.concatenate([np.repeat(touched, self.k), ti])
        rank, code, common = (np.concatenate([old[touched].ravel(), new]) for old, new in ((self.rank, rank), (self.code, code), (self.common, common)))
        order = np.lexsort((code, rank, ti))
        place = np.arange(len(order)) - np.searchsorted(ti[order], ti[order])
        order = order[place < self.k]
        for name, new in (("rank", rank), ("code", code), ("common", common)):
            getattr(self, name)[touched] = new[order].reshape(len(touched), self.k)

    def found(self) -> Iterator[pa.RecordBatch]:
        if self.targets is None:
            return
        self._flush()
        each = max(1, 100_000 // self.k)
        for lo in range(0, len(self.targets.ids), each):
            row, place = np.nonzero(self.code[lo : lo + each] >= 0)
            rank, code = self.rank[lo + row, place], self.code[lo + row, place]
            distance = np.select([rank == _INFINITE, rank == _NAN], [np.inf, np.nan], rank / 1000)
            yield pa.RecordBatch.from_arrays(
                [self.targets.ids.take(pa.array(lo + row)), self.held[1].take(pa.array(np.searchsorted(self.held[0], code))), pa.array(distance, mask=rank == _NONE), pa.array(self.common[lo + row, place])],
                ["target", "neighbour", "distance", "n_common"],
            )
