"""N-gram Jaccard join by PartEnum signatures, and its connected components.

Sets of word shingles are cut into bands of nearly equal size. Within a band a
Jaccard similarity of ``threshold`` bounds the number of differing elements by
some ``k``. The domain of shingle hashes is cut into ``n1`` parts of ``n2``
cells; by the pigeonhole principle one part has at most ``k2`` differences, so a
subset of ``n2 - k2`` of its cells is equal in both sets. Each such subset is one
signature, and linked sets share at least one. Small sets enumerate subsets of
two of four or three cells, which cover half as much again of the domain as
single cells do; large ones, whose signatures are most of all rows, single cells.

Passages that many sets share fill whole cells and make signatures of many
members. So there are more parts than the principle needs, by ``SPARE`` of them;
linked sets then agree in one part more than there are to spare, and each set
leaves out as many of its signatures as it has spare parts, the most common
first. As all sets order signatures alike, the rarest that two linked sets share
is left out by neither.

Equal sets are one node. Sets that share a signature are not paired with each
other: each is compared with one centre, components of those links are formed,
and so on with other centres ``STARS`` times; then only members outside the last
centre's component are compared with members of other components, once for all
signatures of one centre where these have mostly the same members. Parity sketches, whose distance never exceeds the true one,
discard pairs without reading the sets: first 512 bits, then for sets of more
than 256 elements a sketch of 4 to 8 bits an element. What is left is verified
exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import ceil, exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridial.llm import _text
from meridial.llm._graph import connected_components
from meridial.llm._work import cut, drop

U = np.uint64
SKETCH = [f"s{i}" for i in range(8)]
#: A list of keys of at most this length may be broadcast (8 bytes each).
MAX_BROADCAST_KEYS = 500_000
#: Rounds in which the members of a signature are compared with one of them.
STARS = 3
#: Pairs of members that one task meets of one group.
PIECE = 1 << 20
#: Spare parts, as a share of those that are needed.
SPARE = 0.3
#: Sets of more elements have a second sketch that grows with them.
SMALL = 256


def cells_of(high: int) -> tuple[int, int]:
    """(n2, k2) of a band whose largest sets have ``high`` elements."""
    return (4, 2) if high <= 64 else (3, 1) if high <= SMALL else (2, 1)


class PartEnum:
    """Signatures for Jaccard similarity of at least ``num / den``.

    ``scheme`` gives the cells of a part and how many of them may differ by the
    largest size of a band.
    """

    def __init__(self, num: int = 85, den: int = 100, scheme=cells_of, more: float = SPARE):
        self.num, self.den, self.scheme, self.more = num, den, scheme, more
        self._bands: list[tuple[int, int]] = [(1, den // num)]
        self._tags: dict[int, tuple] = {}

    def band(self, size: int) -> int:
        while self._bands[-1][1] < size:
            low = self._bands[-1][1] + 1
            self._bands.append((low, low * self.den // self.num))
        return next(i for i in range(len(self._bands) - 1, -1, -1) if self._bands[i][0] <= size)

    def _layout(self, tag: int) -> tuple[int, int, np.ndarray, np.ndarray]:
        """Differences allowed, spare parts, the cells' lower bounds and the subsets of a part's cells."""
        if tag not in self._tags:
            self.band(ceil(self._bands[-1][1] + 1) if tag >= len(self._bands) else 1)
            low, high = self._bands[tag]
            n2, k2 = self.scheme(high)
            k = 2 * high * (self.den - self.num) // (self.den + self.num)
            n1 = k // (k2 + 1) + 1
            spare = ceil(2 * n1 * n2 * exp(-0.85 * low / (n1 * n2))) + 1 + ceil(self.more * n1)
            cells = (n1 + spare) * n2
            bounds = np.array([-(-(c << 64) // cells) for c in range(cells)], U)
            self._tags[tag] = (k, spare, bounds, np.array(list(combinations(range(n2), n2 - k2))))
        return self._tags[tag]

    def signatures(self, hashes: np.ndarray) -> np.ndarray:
        """Of sorted distinct hashes. Sets of which no other set can be linked have none."""
        found = self.spared(hashes)
        return np.concatenate([x for x, _ in found]) if found else hashes[:0]

    def spared(self, hashes: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """For each band the signatures, and how many of them may be left out."""
        size = len(hashes)
        if not size:
            return []
        band = self.band(size)
        self.band(self._bands[band][1] + 1)
        tags = [band] + [band + 1] * (size * self.den >= self._bands[band + 1][0] * self.num)
        sums = np.concatenate((np.zeros(1, U), np.cumsum(_text.mix(hashes), dtype=U)))
        out = []
        for tag in tags:
            k, spare, bounds, subsets = self._layout(tag)
            if not k:  # only equal sets, which are one node already
                continue
            at = np.append(np.searchsorted(hashes, bounds), size)
            n2 = int(subsets.max()) + 1
            cell = (sums[at[1:]] - sums[at[:-1]]).reshape(-1, n2)
            full = (at[1:] > at[:-1]).reshape(-1, n2)
            value = cell[:, subsets].sum(2, dtype=U)
            some = full[:, subsets].any(2)
            name = np.arange(value.size, dtype=U).reshape(value.shape) + (U(tag + 1) << U(32))
            sig = _text.mix(value + _text.mix(name))
            # with more void parts than spare ones, equal empty subsets must count too
            void = int((~some.all(1)).sum())
            out.append((sig.ravel(), 0) if void > spare else (sig[some], spare - void))
        return out


def _digests(s: np.ndarray) -> tuple[int, int]:
    """Two sums that name a set."""
    a = _text.mix(s ^ U(0xA5A5A5A5A5A5A5A5)).sum(dtype=U)
    b = _text.mix(s + U(0x0123456789ABCDEF)).sum(dtype=U)
    return int(np.int64(a.astype(np.int64))), int(np.int64(b.astype(np.int64)))


def parity_sketch(s: np.ndarray, bits: int) -> np.ndarray:
    """Parity of the number of elements in each of ``bits`` cells (a power of two, 64 at least)."""
    odd = (np.bincount((s & U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def wide_sketch(s: np.ndarray) -> np.ndarray:
    """A sketch of 4 to 8 bits an element; none for small sets."""
    return parity_sketch(s, 4 << (len(s) - 1).bit_length()) if len(s) > SMALL else np.zeros(0, np.int64)


def apart(x: np.ndarray, y: np.ndarray) -> int:
    """A lower bound of the number of differing elements from two wide sketches.

    The cells are the low bits of the hashes, so the longer sketch folds onto the shorter.
    """
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count((x ^ y).view(U)).sum())


def _describe(key: str, text: str, shingle: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, names, more, sketches, wide = [], [], [], [], []
            for s in _text.shingle_sets(b.column(text), shingle):
                x, y = _digests(s)
                sizes.append(len(s))
                names.append(x)
                more.append(y)
                sketches.append(parity_sketch(s, 512))
                wide.append(wide_sketch(s))
            sketches = np.array(sketches, np.int64).reshape(-1, 8)
            yield pa.record_batch(
                [b.column(key).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), pa.array(more, pa.int64()), *(pa.array(sketches[:, i]) for i in range(8)), pa.array(wide, pa.list_(pa.int64()))],
                [key, "n", "node", "check", *SKETCH, "wide"],
            )

    return rows


def _signed(scheme: PartEnum, text: str, shingle: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            sigs, nodes, spared = [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            for s in _text.shingle_sets(b.column(text), shingle):
                node = _digests(s)[0]
                if node not in seen:
                    seen.add(node)
                    # twice the number, and one more for the larger band, so that bands are told apart
                    for band, (sig, spare) in enumerate(scheme.spared(s)):
                        sigs.append(sig)
                        nodes.append(np.full(len(sig), node, np.int64))
                        spared.append(np.full(len(sig), 2 * spare + band, np.int32))
            sigs, nodes, spared = np.concatenate(sigs).view(np.int64), np.concatenate(nodes), np.concatenate(spared)
            for at in range(0, max(1, len(sigs)), 1 << 18):
                part = slice(at, at + (1 << 18))
                yield pa.record_batch([pa.array(sigs[part]), pa.array(nodes[part]), pa.array(spared[part])], ["sig", "node", "spare"])

    return rows


def _sets(text: str, shingle: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = list(_text.shingle_sets(b.column(text), shingle))
            names = [_digests(s) for s in sets]
            yield pa.record_batch([pa.array([x for x, _ in names], pa.int64()), pa.array([y for _, y in names], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "check", "elements"])

    return rows


def _near(num: int, den: int):
    """Sizes and sketches of two sides (prefixes a and b) allow a link."""
    a, b = F.col("a.n"), F.col("b.n")
    odd = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a.{s}").bitwiseXOR(F.col(f"b.{s}"))) for s in SKETCH])
    return (F.least(a, b) * den >= F.greatest(a, b) * num) & (odd * (den + num) <= (a + b) * (den - num))


def _not_apart(num: int, den: int):
    """Pairs whose wide sketches allow a link."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column("x"), b.column("y")
            n = (b.column("n").to_numpy() + b.column("m").to_numpy()) * (den - num)
            keep = [apart(x[i].values.to_numpy(), y[i].values.to_numpy()) * (den + num) <= n[i] for i in range(len(b))]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text: str, shingle: int, num: int, den: int) -> DataFrame:
    """The ``pairs`` (a, b of node ids) whose sets are linked, by exact intersection of their hashes."""
    sized = lambda side, n, sketch: nodes.select(F.col("id").alias(side), F.col("n").alias(n), F.col("wide").alias(sketch))
    met = pairs.join(sized("a", "n", "x"), "a").join(sized("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y")
    small = F.least("n", "m") <= SMALL
    left = cut(met.where(~small).mapInArrow(_not_apart(num, den), "a bigint, b bigint").unionByName(met.where(small).select("a", "b")))
    ends = left.select(F.col("a").alias("id")).unionByName(left.select(F.col("b").alias("id"))).distinct()
    named = cut(ends.join(nodes.select("id", "doc", "node", "check"), "id"))
    keys = named.where("doc IS NOT NULL").select(F.col("doc").alias(key)).distinct()
    if named.count() <= MAX_BROADCAST_KEYS:
        keys = F.broadcast(keys)
    # a node all of whose rows have no key is looked for among those
    texts = docs.join(keys, key, "left_semi").select(text).unionByName(docs.where(F.col(key).isNull()).select(text))
    sets = texts.mapInArrow(_sets(text, shingle), "node bigint, check bigint, elements array<bigint>")
    sets = cut(sets.join(named.select("id", "node", "check"), ["node", "check"]).dropDuplicates(["id"]).select("id", "elements"))
    both = left.join(sets.select(F.col("id").alias("a"), F.col("elements").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("elements").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    links = cut(both.where(shared * den >= (F.size("x") + F.size("y") - shared) * num).select("a", "b"))
    drop(left, named, sets)
    return links


def jaccard_links(docs: DataFrame, nodes: DataFrame, *, key: str, text: str, shingle: int, num: int, den: int) -> DataFrame:
    """Links ``a, b`` between nodes that span the same components as all links do."""
    info = nodes.select("id", "n", *SKETCH)
    signed = docs.select(text).mapInArrow(_signed(PartEnum(num, den), text, shingle), "sig bigint, node bigint, spare int")
    alike = Window.partitionBy("sig")
    several = F.min("node").over(alike) < F.max("node").over(alike)
    # copies in several tasks give equal rows; a group needs two different nodes
    met = signed.select("sig", "node", "spare", several.alias("several"), F.count("*").over(alike).alias("size")).where("several")
    met = met.select("sig", "node", "spare", "size").distinct()
    common = F.row_number().over(Window.partitionBy("node", "spare").orderBy(F.desc("size"), "sig"))
    met = met.withColumn("common", common).where(F.col("common") > F.floor(F.col("spare") / 2)).select("sig", "node")
    met = cut(met.select("sig", "node", several.alias("several")).where("several").drop("several"))
    # two sets of one 64-bit name are two nodes, with the same signatures
    hashes = [F.bit_xor(F.xxhash64("id", F.lit(i))).over(alike).alias(f"h{i}") for i in range(2)]
    groups = met.join(nodes.select("node", "id"), "node").select("sig", "id", F.count("*").over(alike).alias("size"), *hashes)
    # many signatures of near copies have the same members; one of them is enough
    groups = cut(groups.groupBy("h0", "h1", "size", "id").agg(F.min("sig").alias("sig")).select("sig", "id", F.lit(False).alias("done")))
    drop(met)
    clash = nodes.alias("a").join(nodes.alias("b"), (F.col("a.node") == F.col("b.node")) & (F.col("a.id") < F.col("b.id"))).where(_near(num, den)).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    found = None
    for turn in range(STARS):
        # every member outside its component is compared with one that was no centre yet
        member = _placed(groups, found).withColumn("mid", F.max(F.struct(~F.col("done"), F.xxhash64("id", F.lit(turn)), "id", "component")).over(alike))
        member = cut(member.select("sig", "id", "component", (F.col("done") | (F.col("id") == F.col("mid.id"))).alias("done"), F.col("mid.id").alias("centre"), F.col("mid.component").alias("central")))
        drop(groups)
        groups = member
        spokes = member.where("component != central").select("id", "centre").distinct()
        pairs = spokes.join(info.select(F.col("id"), F.struct("n", *SKETCH).alias("a")), "id").join(info.select(F.col("id").alias("centre"), F.struct("n", *SKETCH).alias("b")), "centre").where(_near(num, den)).select(F.col("id").alias("a"), F.col("centre").alias("b"))
        pairs = cut(pairs if turn else pairs.unionByName(clash))
        links = _verified(pairs, nodes, docs, key, text, shingle, num, den)
        before, found = found, cut(connected_components(links if found is None else links.unionByName(_as_links(found))))
        drop(pairs, links, *([before] if before else []))
    # what no star has compared: members outside the last centre's component against all others
    placed = cut(_placed(groups, found).where("NOT done").withColumn("out", F.count_if(F.col("component") != F.col("central")).over(alike)).where("out > 0"))
    drop(groups)
    rest = cut(unmet(placed, info, num, den).distinct())
    drop(placed)
    more = _verified(rest, nodes, docs, key, text, shingle, num, den)
    drop(rest)
    return _as_links(found).unionByName(more)


def unmet(placed: DataFrame, info: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs ``a < b`` of members that may be linked and that no star has joined.

    ``placed``: sig, id, component, the signature's centre, the centre's component (central) and how many members of
    the signature lie outside it (out). Signatures of near copies have mostly the same members, and the same centre:
    where that makes fewer pairs, members meet by their centre, so once instead of in every signature that they
    share. The outside members of a large group are dealt over several tasks.
    """
    outside = F.col("component") != F.col("central")
    cost = placed.groupBy("centre").agg(F.sum("out").alias("apart"), F.countDistinct("id").alias("members"), F.countDistinct(F.when(outside, F.col("id"))).alias("outer"))
    together = cost.select("centre", (F.col("members") * F.col("outer") <= F.col("apart")).alias("together"))
    member = placed.join(together, "centre").select("together", F.when(F.col("together"), F.col("centre")).otherwise(F.col("sig")).alias("key"), "id", "component", "central").distinct()
    met = Window.partitionBy("together", "key")
    pieces = F.ceil(F.count("*").over(met) * F.count_if(outside).over(met) / PIECE)
    member = cut(member.withColumn("pieces", pieces).join(info, "id"))
    a = member.where(outside).withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces"))).alias("a")
    b = member.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))).alias("b")
    alike = reduce(lambda x, y: x & y, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("together", "key", "piece")])
    different = (F.col("a.component") != F.col("b.component")) & ((F.col("b.component") == F.col("b.central")) | (F.col("a.id") < F.col("b.id")))
    return a.join(b, alike & different & _near(num, den)).select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"))


def _as_links(found: DataFrame) -> DataFrame:
    """Components as links of every node to its component's name."""
    return found.select(F.col("node").alias("a"), F.col("component").alias("b"))


def _placed(groups: DataFrame, found: DataFrame | None) -> DataFrame:
    """Members of signatures with their present components; signatures whose members are all of one are through."""
    if found is None:
        return groups.withColumn("component", F.col("id"))
    alike = Window.partitionBy("sig")
    kept = ["sig", "id", "done", *(c for c in ("centre", "central") if c in groups.columns)]
    member = groups.select(kept).join(found.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    if "central" in kept:  # a centre's component may have grown
        member = member.join(found.select(F.col("node").alias("central"), F.col("component").alias("now")), "central", "left").withColumn("central", F.coalesce("now", "central")).drop("now")
    return member.withColumn("several", F.min("component").over(alike) < F.max("component").over(alike)).where("several").drop("several")


def _components(docs: DataFrame, key: str, text: str, shingle: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Every row's key, size and digests, and every node's digests and component."""
    sketches = ", ".join(f"{s} bigint" for s in SKETCH)
    described = docs.mapInArrow(_describe(key, text, shingle), f"{key} bigint, n bigint, node bigint, check bigint, {sketches}, wide array<bigint>")
    # numbered once and written, so that a node's id stays what it is
    described = cut(described.withColumn("row", F.monotonically_increasing_id()))
    firsts = [F.first(c).alias(c) for c in ("n", *SKETCH, "wide")]
    nodes = cut(described.where("n > 0").groupBy("node", "check").agg(F.min("row").alias("id"), F.min(key).alias("doc"), *firsts))
    links = jaccard_links(docs, nodes, key=key, text=text, shingle=shingle, num=num, den=den)
    found = connected_components(links)
    labelled = nodes.select("node", "check", "id", "doc").join(found.select(F.col("node").alias("id"), "component"), "id", "left")
    named = cut(labelled.select("node", "check", "doc", F.coalesce("component", "id").alias("component")))
    drop(nodes)
    return described.select(key, "n", "node", "check"), named


def jaccard_components(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """One row for each row of ``docs``: ``key, n_shingles, component_id``.

    Two texts link if the Jaccard similarity of their sets of distinct word
    shingles is at least ``num / den``; the component is the least key reachable
    by links, the row's own included. Texts without words (null, empty, white
    space) link with nothing. Rows with a null key carry links like all others;
    a component of such rows alone has a null id. A repeated key is taken row by
    row. Other columns are not read.
    """
    docs = docs.select(F.col(key).cast("long").alias(key), text)
    described, named = _components(docs, key, text, shingle, num, den)
    least = named.groupBy("component").agg(F.min("doc").alias("component_id"))
    named = cut(named.join(least, "component").select("node", "check", "component_id"))
    words = described.where("n > 0").join(named, ["node", "check"]).select(key, F.col("n").alias("n_shingles"), "component_id")
    none = described.where("n = 0").select(key, F.col("n").alias("n_shingles"), F.col(key).alias("component_id"))
    return words.unionByName(none)


def _with_digests(text: str, shingle: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [_digests(s) for s in _text.shingle_sets(b.column(text), shingle)]
            yield pa.record_batch([*b.columns, pa.array([x for x, _ in names], pa.int64()), pa.array([y for _, y in names], pa.int64())], [*b.schema.names, "_node", "_check"])

    return rows


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, all columns, but one row only of each component.

    The row with the least key stays (null keys last, ties by the text's
    digest); of rows that agree in key and shingles one. Texts without words
    link with nothing and stay. Rows whose key is not null and occurs once are
    taken out by their key; only the others are told apart by their texts.
    """
    columns, kind = docs.columns, docs.schema[key].dataType.simpleString()
    described, named = _components(docs.select(F.col(key).cast("long").alias(key), text), key, text, shingle, num, den)
    every = cut(described.where("n > 0").join(named.drop("doc"), ["node", "check"]))
    order = F.struct(F.col(key).isNull(), F.col(key), "node", "check")
    stay = cut(every.groupBy("component").agg(F.min(order).alias("first")).select(f"first.{key}", "first.node", "first.check"))
    counts = described.where(F.col(key).isNotNull()).groupBy(key).count()
    several = cut(counts.where("count > 1").select(F.col(key).cast(kind).alias(key)))
    gone = every.join(stay, [key, "node", "check"], "left_anti").where(F.col(key).isNotNull()).select(F.col(key).cast(kind).alias(key))
    gone = cut(gone.unionByName(several).distinct())
    plain = docs.where(F.col(key).isNotNull()).join(gone, key, "left_anti").select(columns)
    unsure = docs.where(F.col(key).isNull()).unionByName(docs.join(several, key, "left_semi").select(columns))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    unsure = cut(unsure.mapInArrow(_with_digests(text, shingle), f"{fields}, _node bigint, _check bigint"))
    same = F.col(key).cast("long").eqNullSafe(F.col("_key")) & (F.col("_node") == F.col("_x")) & (F.col("_check") == F.col("_y"))
    chosen = unsure.join(stay.toDF("_key", "_x", "_y"), same, "left_semi").dropDuplicates([key, "_node", "_check"])
    wordless = unsure.where((F.col("_node") == 0) & (F.col("_check") == 0))
    return plain.unionByName(chosen.select(columns)).unionByName(wordless.select(columns))
