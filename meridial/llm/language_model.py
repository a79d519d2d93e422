"""LM scoring: a hierarchical Pitman-Yor model of words.

A token's context is the word before it or the start of the text. Every context
of the training texts has a restaurant in which the following tokens are
customers, so restaurants grow with the corpus; all of them share one parent
restaurant, whose customers are their tables, and its parent is uniform over the
known types and one unknown. A context never seen leaves all to the parent.

Seating is sampled by Gibbs sweeps. What a predictive probability needs of a
restaurant are customers and tables of each dish, so a sweep draws the number of
tables of every dish given all others: exactly, from its conditional
distribution (generalized Stirling numbers), for up to ``EXACT`` customers, and
beyond that by the restaurant's own seating process in blocks. A dish with one
customer has one table, so only pairs that occur twice are drawn. Draws depend
on the word, context and sweep alone, so a task that is run again draws the
same. Predictive probabilities are averaged over the last sweeps.

Pairs are dealt over shards by a hash of context and word together, so no
context meets in one task, and words over as many shards by their own hash. Shards
and what they tell each other are rows of packed arrays: a sweep's shuffles send
a pair shard's tables of each word it has to the words' shards and their sums
back. Texts are scored in blocks of whole texts, which ask word and pair shards
for the counts of what they have and get them in the order of asking. Their
number follows the size of the texts. Nothing of a size that grows with the corpus
reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridial.llm import _text
from meridial.llm._work import cut, drop, release

U = np.uint64
END = int(_text.mix(np.array([0xE0F], U)).view(np.int64)[0])
EXACT = 64
TABLE_SHARE = 1 << 18
#: Bytes of text for each shard, and tokens of a block of texts.
SHARD_BYTES, BLOCK_TOKENS = 1 << 24, 1 << 20
#: Log probabilities are added up as whole numbers of this part, so in any order alike.
PART = 1e-10


def held_out(key, folds: int = 10):
    """Rows not learned from: crc32(key as text) mod ``folds`` is 0; a null key is learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == 0, F.lit(False))


def _tokens(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slices of texts: word hashes with an end behind each text, and the texts' ranges."""
    data, at = _text.utf8_buffers(column)
    for a, z in _text.slices(at):
        words, ends = _text.words_of(data, at[a : z + 1])
        yield np.insert(words.view(np.int64), ends[1:], END), ends + np.arange(len(ends))


ROW = "at bigint, kind int, frm bigint, data array<binary>"
ONES, MANY, STATE, WORDS, SENT, BACK, BLOCK, WORD_ASK, WORD_BACK, PAIR_ASK, PAIR_BACK = range(11)
_ROW = pa.schema([("at", pa.int64()), ("kind", pa.int32()), ("frm", pa.int64()), ("data", pa.list_(pa.binary()))])


def _pack(a: np.ndarray) -> bytes:
    """An array in the least type that holds its numbers, and that type."""
    if a.dtype.kind != "f":
        fit = "<i8" if len(a) and a.min() < 0 else next((t for t, most in (("|u1", 8), ("<u2", 16), ("<u4", 32)) if not len(a) or int(a.max()) < 1 << most), "<i8")
        a = a.astype(fit)
    return a.tobytes() + a.dtype.str.encode()


def _unpack(x: pa.Buffer) -> np.ndarray:
    m = memoryview(x)
    a = np.frombuffer(m[:-3], bytes(m[-3:]).decode())
    return a if a.dtype.kind == "f" else a.astype(np.int64)


def _table(rows: list[tuple]) -> pa.Table:
    """``rows`` of at, kind, from and arrays."""
    at, kind, frm, data = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table([pa.array(at, pa.int64()), pa.array(kind, pa.int32()), pa.array(frm, pa.int64()), pa.array([[_pack(a) for a in d] for d in data], _ROW.field("data").type)], schema=_ROW)


def _rows(t: pa.Table | pa.RecordBatch) -> Iterator[tuple[int, int, int, list[np.ndarray]]]:
    for at, kind, frm, data in zip(*(t.column(k).to_pylist() for k in ("at", "kind", "frm")), t.column("data"), strict=True):
        yield at, kind, frm, [_unpack(x.as_buffer()) for x in data.values]


def _each(df: DataFrame, make) -> DataFrame:
    """``make(at, kind, frm, arrays)``, a list of rows, of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in _rows(b):
                yield from _table(make(*r)).to_batches()

    return df.mapInArrow(rows, ROW)


def _meet(frames: list[DataFrame], make, schema: str = ROW) -> DataFrame:
    """``make(at, rows by kind)``, a table, of all rows with the same ``at``."""

    def group(t: pa.Table) -> pa.Table:
        by: dict[int, list] = {}
        for at, kind, frm, data in _rows(t):
            by.setdefault(kind, []).append((frm, data))
        return make(t.column("at")[0].as_py(), {k: sorted(v, key=lambda r: r[0]) for k, v in by.items()})

    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out.groupBy("at").applyInArrow(group, schema)


def _runs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a sorted array and their counts."""
    first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, np.int64)
    return a[first], np.diff(np.append(first, len(a)))


def _numbered(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of ``a`` by first appearance, and the number of each of its values in them."""
    d = pa.array(a).dictionary_encode()
    out = d.dictionary.to_numpy().copy(), d.indices.to_numpy().astype(np.int64)
    del d
    # workers live on, and an executor's memory is for all of them
    pa.default_memory_pool().release_unused()
    return out


def _word_shard(x: np.ndarray, shards: int) -> np.ndarray:
    return ((x.view(U) >> U(33)) % U(shards)).astype(np.uint32)


def _digest(g: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A pair as one number."""
    return _text.mix(g.view(U) * U(0x9E3779B97F4A7C15) + w.view(U))


def _pair_shard(p: np.ndarray, shards: int) -> np.ndarray:
    return ((p >> U(33)) % U(shards)).astype(np.uint32)


def _deal(shard: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Each shard's part of ``arrays``, in their order."""
    order = np.argsort(shard.astype(np.uint16) if len(shard) and shard.max() < 1 << 16 else shard, kind="stable")
    ids, n = _runs(shard[order])
    arrays, z = [a[order] for a in arrays], np.cumsum(n)
    for i, a, b in zip(ids, z - n, z, strict=True):
        yield int(i), [x[a:b] for x in arrays]


def _in_order(shard: np.ndarray, parts: list[tuple[int, list[np.ndarray]]], k: int) -> list[np.ndarray]:
    """Arrays put together of ``k`` arrays of each shard that ``_deal`` dealt."""
    where = {i: at for i, (at,) in _deal(shard, np.arange(len(shard)))}
    out = [np.zeros(len(shard), np.int64) for _ in range(k)]
    for i, data in parts:
        for o, a in zip(out, data, strict=True):
            o[where[i]] = a
    return out


def _pairs_in(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens; of each token, numbers of the one before it and its own in them, as one key.

    Before the first stands an end, as before every other text.
    """
    x, code = _numbered(np.concatenate(([END], tokens)))
    return x, code[1:], code[:-1] << 32 | code[1:]


def _halves(key: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x[key >> 32], x[key & 0xFFFFFFFF]


def _count(text: str, shards: int):
    """Counts of words in contexts by shard, combined over 2 million tokens."""

    def flush(held: list[np.ndarray]) -> pa.Table:
        x, _, key = _pairs_in(np.concatenate(held))
        key, c = _runs(np.sort(key))
        g, w = _halves(key, x)
        return _table([(s, MANY, 0, [*_runs(g), w, c]) for s, (g, w, c) in _deal(_pair_shard(_digest(g, w), shards), g, w, c)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            for tokens, _ in _tokens(b.column(text)):
                held.append(tokens.astype(np.int64))
                if sum(map(len, held)) > 1 << 21:
                    yield from flush(held).to_batches()
                    held = []
        if held:
            yield from flush(held).to_batches()

    return rows


def _add_up(at: int, by: dict) -> pa.Table:
    """A pair shard: pairs of one customer, and the others with their customers; by context."""
    g = np.concatenate([np.repeat(d[0], d[1]) for _, d in by[MANY]])
    w, c = (np.concatenate([d[i] for _, d in by[MANY]]) for i in (2, 3))
    x, i = _numbered(np.concatenate([g, w]))
    all_, i = _numbered(i[: len(g)] << 32 | i[len(g) :])
    order = np.argsort(all_)
    total = np.bincount(i, c, len(all_)).astype(np.int64)[order]
    g, w = _halves(all_[order], x)
    one = total == 1
    return _table([(at, ONES, 0, [*_runs(g[one]), w[one]]), (at, MANY, 0, [*_runs(g[~one]), w[~one], total[~one]])])


def _first_sums(shards: int):
    """What a pair shard tells the words' shards: customers and dishes of each word and of each context."""

    def make(at, kind, frm, data):
        g, w = np.repeat(data[0], data[1]), data[2]
        c = data[3] if kind == MANY else np.ones(len(w), np.int64)
        # in the order of _pair_words, as the answers are
        x, i = _numbered(np.concatenate([g, w]))
        out = []
        for i in (i[len(g) :], i[: len(g)]):
            n = np.bincount(i, minlength=len(x))
            out += [np.bincount(i, c, len(x)).astype(np.int64), n, n if kind == ONES else 0 * n]
        return [(u, SENT, 2 * at + (kind == MANY), d) for u, d in _deal(_word_shard(x, shards), x, *out)]

    return make


def _first_words(at: int, by: dict) -> pa.Table:
    """A word shard before the first sweep, and the numbers that its words begin with sent back."""
    x = _runs(np.sort(np.concatenate([d[0] for _, d in by[SENT]])))[0]
    s = np.zeros((6, len(x)), np.int64)
    for _, d in by[SENT]:
        s[:, np.searchsorted(x, d[0])] += np.stack(d[1:])
    cw, nw, n1w, cg, ng, n1g = s
    t = (cw > 0).astype(np.int64)
    back = []
    for frm, d in by[SENT]:
        if frm % 2:
            i = np.searchsorted(x, d[0])
            back.append((frm // 2, BACK, at, [ng[i], nw[i], t[i]]))
    return _table([(at, WORDS, 0, [x, cw, n1w, cg, n1g, nw, t, ng]), *back])


def _pair_words(data: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Context and word of each pair, the distinct ones of both, contexts' and words' numbers in them."""
    g, w = np.repeat(data[0], data[1]), data[2]
    x, i = _numbered(np.concatenate([g, w]))
    return g, w, x, i[: len(g)], i[len(g) :]


def _draw_pairs(model: "Model", now: "Totals", salt: int, keep: bool):
    """A sweep over a pair shard: tables drawn anew, and their sums sent to the words' shards."""

    def make(at: int, by: dict) -> pa.Table:
        data = by[MANY][0][1]
        g, w, x, ig, iw = _pair_words(data)
        c = data[3]
        t, total = by[STATE][0][1] if STATE in by else (np.ones(len(w), np.int64), np.zeros(len(w), np.int64))
        u = _word_shard(x, model.shards)
        inner, customers, tables = _in_order(u, by.get(BACK, []), 3)
        base = model.parent(customers, tables, now)
        drawn = draw_tables(w, g, c, t, inner[ig], base[iw], model.d, model.theta, log_stirling(model.d), salt) if len(w) else t
        sums = [np.bincount(i, drawn, len(x)).astype(np.int64) for i in (ig, iw)]
        sent = [(i, SENT, at, d) for i, d in _deal(u, x, *sums)]
        return _table([(at, STATE, 0, [drawn, total + drawn if keep else total]), *sent])

    return make


def _draw_words(model: "Model", now: "Totals", salt: int, keep: bool, last: bool):
    """A sweep over a word shard: the parent's tables drawn anew, and what pair shards asked for sent back if another sweep follows."""

    def make(at: int, by: dict) -> pa.Table:
        x, cw, n1w, cg, n1g, _, t, _, *history = by[WORDS][0][1]
        c, inner = n1w.copy(), n1g.copy()
        where = [(frm, np.searchsorted(x, d[0]), d) for frm, d in by.get(SENT, [])]
        for _, i, d in where:
            inner[i] += d[1]
            c[i] += d[2]
        word = np.flatnonzero(cw)
        old = np.minimum(t, c)[word]
        k = len(word)
        args = (np.zeros(k, np.int64), c[word], old, np.full(k, now.parent_tables), np.full(k, 1 / (model.types + 1)))
        t = np.zeros(len(x), np.int64)
        t[word] = draw_tables(x[word], *args, model.d_parent, model.theta_parent, log_stirling(model.d_parent), salt) if k else old
        history += [c, t, inner] if keep else []
        return _table([(at, WORDS, 0, [x, cw, n1w, cg, n1g, c, t, inner, *history]), *((frm, BACK, at, [inner[i], c[i], t[i]]) for frm, i, _ in where if not last)])

    return make


def _totals(df: DataFrame, make, n: int) -> list[int]:
    """Sums over all rows of the ``n`` numbers that ``make(arrays)`` gives of a row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for b in batches:
            for _, _, _, data in _rows(b):
                total += np.array(make(data), np.int64)
        yield pa.record_batch([pa.array([int(v)], pa.int64()) for v in total], names=[f"n{i}" for i in range(n)])

    sums = df.mapInArrow(rows, ", ".join(f"n{i} bigint" for i in range(n)))
    return [int(v or 0) for v in sums.agg(*(F.sum(f"n{i}") for i in range(n))).first()]


def _uniform(w: np.ndarray, g: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on word, context and draw alone."""
    x = _text.mix(_text.mix(w.view(U) + g.astype(U) * U(0x9E3779B97F4A7C15)) + U(salt * 2654435761 + 1))
    return ((x >> U(11)).astype(np.float64) + 0.5) / (1 << 53)


def log_stirling(d: float, most: int = EXACT) -> np.ndarray:
    """log of the generalized Stirling numbers S_d(n, m), n and m up to ``most``."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0
    for n in range(1, most):
        m = np.arange(1, n + 2)
        stay = np.log(np.maximum(n - m * d, 1e-300)) + out[n, 1 : n + 2]
        out[n + 1, 1 : n + 2] = np.logaddexp(out[n, 0 : n + 1], stay)
    return out


def draw_tables(w, g, customers, tables, others, base, d: float, theta: float, stirling: np.ndarray, salt: int) -> np.ndarray:
    """New numbers of tables of dishes with ``customers``, one Gibbs step.

    ``others`` are all tables of the restaurant, ``base`` the parent's
    probability of the dish. A single customer always has one table.
    """
    out = tables.copy()
    rest = np.maximum(others - tables, 0)
    u = _uniform(w, g, salt)
    exact = np.flatnonzero((customers >= 2) & (customers <= EXACT))
    order = exact[np.argsort(customers[exact], kind="stable")]
    sizes, begin = np.unique(customers[order], return_index=True)
    for c, rows in zip(sizes, np.split(order, begin[1:]), strict=True) if len(order) else ():
        for part in np.array_split(rows, max(1, len(rows) * int(c) >> 20)):
            m = np.arange(c)
            p = stirling[c, 1 : c + 1] + np.cumsum(np.log(theta + d * (rest[part][:, None] + m)), 1) + np.log(base[part])[:, None] * (m + 1)
            p = np.cumsum(np.exp(p - p.max(1, keepdims=True)), 1)
            out[part] = 1 + (p < (u[part] * p[:, -1])[:, None]).sum(1)
    many = np.flatnonzero(customers > EXACT)
    if len(many):
        c, a = customers[many].astype(np.float64), (theta + d * rest[many]) * base[many]
        t, i, k = np.ones(len(many)), 1.0, 0
        while i < c.max():
            to = max(i + 1, np.floor(i * 1.25))
            step = np.clip(np.minimum(to, c) - i, 0, None)
            mean = step * a / (a + np.maximum(i - d * t, 1 - d))
            x, y = _uniform(w[many], g[many], salt + 7919 * (2 * k + 1)), _uniform(w[many], g[many], salt + 7919 * (2 * k + 2))
            # few new tables: one with the right chance; many: nearly normal
            normal = np.rint(mean + np.sqrt(mean) * np.sqrt(-2 * np.log(x)) * np.cos(2 * np.pi * y))
            t += np.clip(np.where(mean < 4, np.floor(mean) + (x < mean - np.floor(mean)), normal), 0, step)
            i, k = to, k + 1
        out[many] = t.astype(np.int64)
    return out


@dataclass
class Totals:
    """Sums after a sweep: customers and tables of the parent; tables of each context in ``contexts``."""

    parent_customers: int
    parent_tables: int
    contexts: DataFrame = None
    at: int = 0

    @property
    def context(self) -> np.ndarray:
        """Tables of all contexts in the order of ``predictive``, for small models."""
        return np.array([r["n"] for r in self.contexts.orderBy("g").select(F.get("tables", F.lit(self.at)).alias("n")).collect()], np.int64)


@dataclass
class Model:
    """Fitted sums; the tables stay distributed.

    ``counted``, ``seated`` and ``known`` are the shards: pairs and their
    customers, tables of those with several, words. As rows: ``pairs`` (g, w, c
    and mean tables t), ``contexts`` (g, c, tables: one number a used sweep),
    ``words`` (w, c, q: the parent's probability, likewise).
    """

    counted: DataFrame
    seated: DataFrame
    known: DataFrame
    shards: int
    tokens: int
    types: int
    d: float
    d_parent: float
    theta: float
    theta_parent: float
    history: list[Totals] = field(default_factory=list)
    written: tuple[DataFrame, ...] = ()

    def bare(self) -> "Model":
        """The numbers without the tables, for tasks."""
        return replace(self, counted=None, seated=None, known=None, written=(), history=[replace(h, contexts=None) for h in self.history])

    @property
    def pairs(self) -> DataFrame:
        n = max(1, len(self.history))

        def make(at: int, by: dict) -> pa.Table:
            one, many = by[ONES][0][1], by[MANY][0][1]
            g, w = (np.concatenate([a, b]) for a, b in ((np.repeat(one[0], one[1]), np.repeat(many[0], many[1])), (one[2], many[2])))
            ones = np.ones(len(one[2]), np.int64)
            return pa.table({"g": g, "w": w, "c": np.concatenate([ones, many[3]]), "t": np.concatenate([ones, by[STATE][0][1][1] / n])})

        return _meet([self.counted, self.seated], make, "g bigint, w bigint, c bigint, t double")

    def _listed(self, columns: str, make) -> DataFrame:
        """A row of every word: of each shard's arrays, ``make`` gives keys, counts and one array a used sweep."""

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for _, _, _, data in _rows(b):
                    x, c, each = make(data)
                    have = c > 0
                    lists = np.stack([e[have] for e in each], 1) if each else np.zeros((int(have.sum()), 0), np.int64)
                    ends = np.arange(len(lists) + 1, dtype=np.int32) * len(each)
                    yield pa.record_batch([pa.array(x[have]), pa.array(c[have]), pa.ListArray.from_arrays(pa.array(ends), pa.array(lists.ravel()))], names=["x", "c", "e"])

        kind = "double" if columns.endswith("q") else "bigint"
        return self.known.mapInArrow(rows, f"x bigint, c bigint, e array<{kind}>").toDF(*columns.split())

    @property
    def contexts(self) -> DataFrame:
        return self._listed("g c tables", lambda d: (d[0], d[3], d[10::3]))

    @property
    def words(self) -> DataFrame:
        bare = self.bare()

        def make(d):
            return d[0], d[1], [bare.parent(c, t, h) for c, t, h in zip(d[8::3], d[9::3], bare.history, strict=True)]

        return self._listed("w c q", make)

    def parent(self, customers, tables, at: Totals):
        """The parent's probability of a dish (numbers or columns)."""
        return (customers - self.d_parent * tables + (self.theta_parent + self.d_parent * at.parent_tables) / (self.types + 1)) / (self.theta_parent + at.parent_customers)

    @property
    def context_customers(self) -> np.ndarray:
        """Customers of all contexts in the order of ``predictive``, for small models."""
        return np.array([r["c"] for r in self.contexts.orderBy("g").select("c").collect()], np.int64)

    def back_off(self, at: Totals) -> np.ndarray:
        """Each context's weight of the parent, for small models."""
        return (self.theta + self.d * at.context) / (self.theta + self.context_customers)

    def used(self) -> list[Totals]:
        return self.history

    def base(self, count):
        """The fixed additive score, log10, of a column of counts."""
        return F.log10((count + 0.1) / (self.tokens + 0.1 * (self.types + 1)))

    def rates(self, df: DataFrame) -> DataFrame:
        """``df`` (g, w and ``seated``, what the pair's own customers weigh) with known, base and log10 probability p."""
        df = _attach(_attach(df, "w", self.words, self.tokens), "g", self.contexts.withColumnRenamed("c", "size"), self.tokens, "size")
        size, n = F.coalesce("size", F.lit(0)), len(self.history)
        p = F.col("seated") / (size + self.theta)
        for i, h in enumerate(self.history):
            tables = F.coalesce(F.get("tables", F.lit(i)), F.lit(0))
            p += (tables * self.d + self.theta) / (size + self.theta) * F.coalesce(F.get("q", F.lit(i)), F.lit(self.parent(0, 0, h))) / n
        return df.withColumns({"known": F.col("c").isNotNull(), "base": self.base(F.coalesce("c", F.lit(0))), "p": F.log10(p)}).drop("c", "q", "size", "tables", "seated")


def _attach(df: DataFrame, key: str, table: DataFrame, tokens: int, count: str = "c") -> DataFrame:
    """``df`` left-joined with ``table``; rows of frequent keys meet a broadcast of at most ``TABLE_SHARE`` rows."""
    often = F.col(count) * TABLE_SHARE >= tokens
    hot = table.where(often)
    met = df.join(F.broadcast(hot), key)
    return met.unionByName(df.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.where(~often), key, "left"))


def _shards(docs: DataFrame, text: str) -> int:
    """One for each 16 MB of texts, whatever a shuffle's partitions: shards send rows to one another."""
    return max(4, -(-(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // SHARD_BYTES))


def fit(docs: DataFrame, *, text: str = "text", sweeps: int = 4, burn_in: int = 2, theta: float = 1.0, theta_parent: float = 1.0) -> Model:
    """A model of all rows of ``docs`` (null texts: empty; each text has one end token).

    Discounts are n1 / (n1 + 2 n2), n1 and n2 the numbers of counts of one and
    two. Only sums reach the driver.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(text, F.lit("")).alias(text))
    shards = _shards(docs, text)
    counted = cut(_meet([docs.mapInArrow(_count(text, shards), ROW)], _add_up), "zstd")
    release(spark)
    words = cut(_meet([_each(counted, _first_sums(shards))], _first_words), "zstd")
    several = counted.where(F.col("kind") == MANY)

    def sums(d):
        x, c, _, _, _, n, *_ = d
        return [c.sum(), (c > 0).sum(), n.sum(), (n == 1).sum(), (n == 2).sum(), d[2].sum()]

    n, v, many, *sizes, ones = _totals(words.where(F.col("kind") == WORDS), sums, 6)
    twos = _totals(several, lambda d: [(d[3] == 2).sum()], 1)[0]
    share = lambda n1, n2: min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5
    model = Model(counted, None, words, shards, n, v, share(ones, twos), share(*sizes), theta, theta_parent)
    if not v:
        return model
    bare = model.bare()
    # a pair of one customer has one table in every sweep
    now, pairs, kind = Totals(many, v), None, lambda df, k: df.where(F.col("kind") == k)
    for s in range(sweeps):
        keep = s >= burn_in
        old = pairs, words
        state = [kind(pairs, STATE)] if pairs is not None else []
        pairs = cut(_meet([several, *state, kind(words, BACK)], _draw_pairs(bare, now, 101 + s, keep)))
        words = cut(_meet([kind(words, WORDS), kind(pairs, SENT)], _draw_words(bare, now, 50021 + s, keep, s == sweeps - 1)), "zstd")
        now = Totals(*_totals(kind(words, WORDS), lambda d: [d[5][d[1] > 0].sum(), d[6].sum()], 2), at=len(model.history))
        if keep:
            model.history.append(now)
        # a sweep reads what the last one wrote, and nothing older
        drop(*(t for t in old if t is not None))
        release(spark)
    model.seated, model.known = cut(kind(pairs, STATE)), words
    drop(pairs)
    model.written = counted, model.seated, words
    for h in model.history:
        h.contexts = model.contexts
    return model


def predictive(model: Model) -> DataFrame:
    """Of every word: count, parent probabilities and the averaged ones of its contexts.

    Contexts are numbered in one order, for a look at small models; scoring does not use it.
    """
    ids = model.contexts.select("g", (F.row_number().over(Window.orderBy("g")) - 1).alias("id"))
    p = cut(model.rates(model.pairs.select("g", "w", _seated(model))))
    each = p.join(ids, "g").groupBy("w").agg(F.array_sort(F.collect_list(F.struct("id", F.pow(F.lit(10.0), "p").alias("p")))).alias("x"))
    return model.words.join(each, "w").select("w", "c", "q", F.col("x.id").alias("gs"), F.col("x.p").alias("ps"))


def _seated(model: Model):
    """What a pair's own customers weigh, before the division by its context's."""
    return (F.col("c") - F.col("t") * model.d).alias("seated")


def _blocks(text: str, key: str):
    """Blocks of whole texts: their rows' keys and numbers of tokens, their distinct tokens (the end first), and all tokens as numbers in these."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> list[pa.RecordBatch]:
            keys, null, sizes, tokens = (np.concatenate(p) for p in zip(*held, strict=True))
            x, code, _ = _pairs_in(tokens)
            return _table([(0, BLOCK, 0, [keys, null, sizes, x, code])]).to_batches()

        for b in batches:
            at, null = b.column(key), b.column(key).is_null().to_numpy(zero_copy_only=False)
            at, done = at.fill_null(0).to_numpy(), 0
            for tokens, ends in _tokens(b.column(text)):
                to = done + len(ends) - 1
                held.append((at[done:to], null[done:to].astype(np.int64), np.diff(ends), tokens.astype(np.int64)))
                done = to
                if sum(len(h[3]) for h in held) > BLOCK_TOKENS:
                    yield from flush()
                    held = []
        if held:
            yield from flush()

    return rows


def _block_keys(data: list[np.ndarray]) -> np.ndarray:
    """The pair of each token of a block as one key."""
    code = data[4]
    return np.concatenate(([0], code[:-1])) << 32 | code


def _ask_words(shards: int):
    return lambda at, kind, frm, data: [(u, WORD_ASK, at, d) for u, d in _deal(_word_shard(data[3], shards), data[3])]


def _tell_words(at: int, by: dict) -> pa.Table:
    """Counts as a word and as a context, and the used sweeps' numbers, of the words asked for; zeros of others."""
    out = []
    x, cw, _, cg, _, _, _, _, *history = by[WORDS][0][1] if WORDS in by else [np.zeros(0, np.int64)] * 8
    for frm, (asked,) in by.get(WORD_ASK, []):
        i = np.minimum(np.searchsorted(x, asked), max(len(x) - 1, 0))
        have = x[i] == asked if len(x) else np.zeros(len(asked), bool)
        out.append((frm, WORD_BACK, at, [np.where(have, a[i], 0) if len(x) else np.zeros(len(asked), np.int64) for a in (cw, cg, *history)]))
    return _table(out)


def _ask_pairs(shards: int, slices: int, k: int):
    """Questions for every ``slices``-th pair shard."""

    def make(at, kind, frm, data):
        key, _ = _numbered(_block_keys(data))
        p = _digest(*_halves(key, data[3]))
        shard = _pair_shard(p, shards)
        mine = shard % slices == k
        return [(s, PAIR_ASK, at, [d.view(np.int64)]) for s, (d,) in _deal(shard[mine], p[mine])]

    return make


def _tell_pairs(used: int):
    """Customers and summed tables of the pairs asked for, zeros of unseen ones."""

    def make(at: int, by: dict) -> pa.Table:
        if PAIR_ASK not in by:
            return _table([])
        none = np.zeros(0, np.int64)
        one, many = (by[k][0][1] if k in by else [none] * 4 for k in (ONES, MANY))
        p = np.concatenate([_digest(np.repeat(d[0], d[1]), d[2]) for d in (many, one)])
        # the last place stands for all pairs that are not known
        customers = np.concatenate([many[3], np.ones(len(one[2]), np.int64), [0]])
        tables = np.concatenate([by[STATE][0][1][1] if STATE in by else none, np.full(len(one[2]), used), [0]])
        asked = np.concatenate([d[0] for _, d in by[PAIR_ASK]]).view(U)
        i = pc.fill_null(pc.index_in(pa.array(asked), value_set=pa.array(p)), len(p)).to_numpy()
        out, a = [], 0
        for frm, (d,) in by[PAIR_ASK]:
            mine, a = i[a : a + len(d)], a + len(d)
            out.append((frm, PAIR_BACK, at, [customers[mine], tables[mine]]))
        return _table(out)

    return make


SCORES = "key bigint, n_tokens bigint, n_known bigint, base_score double, score double"


def _score_block(model: Model):
    """Rows of a block with the sums of their tokens' logarithms."""

    def make(at: int, by: dict) -> pa.Table:
        keys, null, sizes, x, code = data = by[BLOCK][0][1]
        n = len(model.history)
        cw, cg, *history = _in_order(_word_shard(x, model.shards), by[WORD_BACK], 2 + 3 * n)
        all_, pair = _numbered(_block_keys(data))
        c, t = _in_order(_pair_shard(_digest(*_halves(all_, x)), model.shards), by[PAIR_BACK], 2)
        g, w = all_ >> 32, all_ & 0xFFFFFFFF
        p = c - t / n * model.d
        for h, customers, tables, inner in zip(model.history, history[::3], history[1::3], history[2::3], strict=True):
            p += ((inner * model.d + model.theta)[g] / n) * model.parent(customers, tables, h)[w]
        p = np.log10(p / (cg + model.theta)[g])
        base = np.log10((cw + 0.1) / (model.tokens + 0.1 * (model.types + 1)))
        end = np.cumsum(sizes)
        add = lambda v: np.diff(np.concatenate(([0], np.cumsum(v)))[np.concatenate(([0], end))])
        whole = lambda v, i: add(np.rint(v / PART).astype(np.int64)[i]) * PART
        return pa.table({"key": pa.array(keys, mask=null.astype(bool)), "n_tokens": sizes, "n_known": add((cw > 0).astype(np.int64)[code]), "base_score": whole(base, code), "score": whole(p, pair)})

    return make


def score(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text", slices: int = 3, last: bool = False) -> DataFrame:
    """``key, n_tokens, n_known, train_tokens, base_score, score`` of every row and its whole text.

    ``score`` is the model's log10 probability of the text, ``base_score`` that
    of smoothed word counts, ``n_known`` the tokens seen in training. A model of
    no texts gives every token the probability 1 of its only, unknown, type.
    Pair shards are asked, and blocks put together, in ``slices`` turns, so only
    as large a part is on its way at once. ``last``: the model is not used
    again, and its tables are deleted when they have answered.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    # written, so that a block is the same whenever it is read
    blocks = cut(docs.mapInArrow(_blocks("text", "key"), ROW).withColumn("at", F.monotonically_increasing_id()), "zstd")
    if not model.tokens:
        none = lambda at, by: pa.table({"key": pa.array(by[BLOCK][0][1][0], mask=by[BLOCK][0][1][1].astype(bool)), "n_tokens": by[BLOCK][0][1][2]})
        out = _meet([blocks], none, "key bigint, n_tokens bigint").select("*", F.lit(0).cast("long").alias("n_known"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"))
    else:
        told = []
        for k in range(slices):
            mine = [df.where(F.col("at") % slices == k) for df in (model.counted, model.seated)]
            told.append(cut(_meet([*mine, _each(blocks, _ask_pairs(model.shards, slices, k))], _tell_pairs(len(model.history))), "zstd"))
            release(spark)
        if last:
            drop(*model.written[:2])
        told.append(cut(_meet([model.known, _each(blocks, _ask_words(model.shards))], _tell_words), "zstd"))
        if last:
            drop(*model.written[2:])
        release(spark)
        parts = []
        for k in range(slices):
            parts.append(cut(_meet([df.where(F.pmod(F.xxhash64("at"), F.lit(slices)) == k) for df in (blocks, *told)], _score_block(model.bare()), SCORES)))
            release(spark)
        drop(blocks, *told)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
    return out.select(F.col("key").alias(key), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
