"""Quality classifier: a byte-level convolutional network in numpy.

Input channels are a learned embedding of every byte and one flag: the six
bytes from here also stand up to 40 bytes before (a linear filter over bytes
cannot see that a word is repeated). Learned filters of 8 bytes at every fourth
byte run over the whole text; their rectified responses are max-pooled over
overlapping chunks of 512 bytes (a new chunk each 384), a hidden layer looks at
each chunk, and the mean over all chunks of a document gives one probability.

The network is fitted on whole texts of a sample of labelled documents: those
with the least hash of their id, at most ``sample_rows`` of them and together at
most ``sample_bytes``, so the time of fitting does not grow. Scoring covers all
bytes of all texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridial.llm import _text

CHUNK, STEP, BLOCK, STRIDE, WIDTH = 512, 384, 128, 4, 8
LAGS, RUN = range(2, 41), 6


def repeats(b: np.ndarray) -> np.ndarray:
    """Where the six bytes from here also stand 2 to 40 bytes before."""
    out = np.zeros(len(b), bool)
    for d in LAGS:
        if len(b) < d + RUN:
            break
        same = b[d:] == b[:-d]
        three = same[:-2] & same[1:-1] & same[2:]
        six = three[:-3] & three[3:]
        out[d : d + len(six)] |= six
    return out & (b != 0)


def layout(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of each text, and blocks of 128 bytes that its chunks and padding take."""
    chunks = 1 + np.maximum(0, -(-(lengths - CHUNK) // STEP))
    return chunks, 3 * (chunks - 1) + 4 + 1


class ByteNetwork:
    """Weights and the forward and backward passes."""

    def __init__(self, filters: int = 16, hidden: int = 12, channels: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        wide = channels + 1
        self.w = {
            "embed": rng.normal(0, 0.5, (256, channels)).astype(np.float32),
            "conv": rng.normal(0, (2 / (WIDTH * wide)) ** 0.5, (WIDTH * wide, filters)).astype(np.float32),
            "conv_bias": np.zeros(filters, np.float32),
            "dense": rng.normal(0, (2 / filters) ** 0.5, (filters, hidden)).astype(np.float32),
            "dense_bias": np.zeros(hidden, np.float32),
            "out": rng.normal(0, (1 / hidden) ** 0.5, hidden).astype(np.float32),
            "out_bias": np.zeros(1, np.float32),
        }

    def responses(self, b: np.ndarray, repeated: np.ndarray) -> np.ndarray:
        """Filter responses at every fourth byte; the last position sees zeros behind the end."""
        w, half = self.w, WIDTH // STRIDE
        wide = w["embed"].shape[1] + 1
        x = np.empty((len(b), wide), np.float32)
        x[:, :-1] = w["embed"][b]
        x[:, -1] = repeated
        x = x.reshape(-1, STRIDE * wide)
        parts = w["conv"].reshape(half, STRIDE * wide, -1)
        out = x @ parts[0]
        out[:-1] += x[1:] @ parts[1]
        out += w["conv_bias"]
        return np.maximum(out, 0, out=out)

    def combine(self, pooled: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probabilities of documents whose chunks start at ``first``."""
        w = self.w
        h = np.maximum(pooled @ w["dense"] + w["dense_bias"], 0)
        mean = np.add.reduceat(h, first, axis=0) / np.diff(np.append(first, len(h)))[:, None]
        return 1 / (1 + np.exp(-(mean @ w["out"] + w["out_bias"][0]).astype(np.float64)))

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Probabilities of consecutive texts with byte offsets ``at``, all bytes read."""
        lengths = np.diff(at)
        chunks, blocks = layout(lengths)
        base = np.concatenate(([0], np.cumsum(blocks)))
        b = np.zeros(base[-1] * BLOCK, np.uint8)
        for i, n in enumerate(lengths):
            b[base[i] * BLOCK : base[i] * BLOCK + n] = data[at[i] : at[i + 1]]
        repeated = repeats(b)
        pooled = np.concatenate([self.responses(b[p : p + 4 * (1 << 16) + STRIDE * 32], repeated[p : p + 4 * (1 << 16) + STRIDE * 32])[: (1 << 16)].reshape(-1, BLOCK // STRIDE, self.w["conv"].shape[1]).max(1) for p in range(0, len(b), 4 << 16)])
        first = np.concatenate(([0], np.cumsum(chunks)))
        start = np.repeat(base[:-1] - 3 * first[:-1], chunks) + 3 * np.arange(first[-1])
        top = np.maximum(np.maximum(pooled[start], pooled[start + 1]), np.maximum(pooled[start + 2], pooled[start + 3]))
        return self.combine(top, first[:-1])

    def gradients(self, b: np.ndarray, repeated: np.ndarray, first: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """b, repeated: chunks x (CHUNK + BLOCK), read as positions of the first CHUNK bytes."""
        w, n = self.w, len(b)
        filters = w["conv"].shape[1]
        pooled, where = np.empty((n, filters), w["conv"].dtype), np.empty((n, filters), np.int64)
        for i in range(0, n, 256):  # of each chunk only the largest responses are kept
            part = slice(i, i + 256)
            r = self.responses(b[part].ravel(), repeated[part].ravel()).reshape(-1, (CHUNK + BLOCK) // STRIDE, filters)[:, : CHUNK // STRIDE]
            where[part] = r.argmax(1)
            pooled[part] = np.take_along_axis(r, where[part][:, None], 1)[:, 0]
        z = pooled @ w["dense"] + w["dense_bias"]
        h = np.maximum(z, 0)
        count = np.diff(np.append(first, n))
        mean = np.add.reduceat(h, first, axis=0) / count[:, None]
        p = 1 / (1 + np.exp(-(mean @ w["out"] + w["out_bias"][0])))
        d = ((p - label) * weight / weight.sum()).astype(np.float32)
        g = {"out": mean.T @ d, "out_bias": d.sum(keepdims=True)}
        dz = np.repeat(d[:, None] * w["out"] / count[:, None], count, axis=0) * (z > 0)
        g["dense"], g["dense_bias"] = pooled.T @ dz, dz.sum(0)
        dp = (dz @ w["dense"].T) * (pooled > 0)
        g["conv_bias"] = dp.sum(0)
        # only the winning window of each filter and chunk has a gradient
        at = where[:, :, None] * STRIDE + np.arange(WIDTH)
        rows = np.arange(n)[:, None, None]
        seen = b[rows, at]
        window = np.concatenate([w["embed"][seen], repeated[rows, at][..., None].astype(np.float32)], -1)
        g["conv"] = np.einsum("nfkc,nf->kcf", window, dp, optimize=True).reshape(w["conv"].shape)
        back = np.einsum("kcf,nf->nfkc", w["conv"].reshape(WIDTH, -1, filters)[:, :-1], dp, optimize=True)
        g["embed"] = np.stack([np.bincount(seen.ravel(), back[..., c].ravel(), 256) for c in range(back.shape[-1])], 1)
        return g

    def fit(self, texts: list[bytes], labels: np.ndarray, *, epochs: int = 8, least_steps: int = 800, rate: float = 0.01, batch: int = 32, seed: int = 7) -> ByteNetwork:
        """Adam on the cross entropy over all chunks of whole texts; both classes weigh alike up to a factor of 3."""
        rng = np.random.default_rng(seed)
        chunks, flags, owner = [], [], []
        for i, t in enumerate(texts):
            count = int(layout(np.array([len(t)]))[0][0])
            b = np.zeros(STEP * (count - 1) + CHUNK + BLOCK, np.uint8)
            b[: len(t)] = np.frombuffer(t, np.uint8)
            f = repeats(b)
            for j in range(count):
                chunks.append(b[j * STEP : j * STEP + CHUNK + BLOCK])
                flags.append(f[j * STEP : j * STEP + CHUNK + BLOCK])
                owner.append(i)
        if not chunks or len(set(labels.tolist())) < 2:
            self.w["out"][:] = 0
            self.w["out_bias"][:] = 0 if not len(labels) else 4 * (float(labels.mean()) - 0.5)
            return self
        chunks, flags, owner = np.stack(chunks), np.stack(flags), np.array(owner)
        begin = np.searchsorted(owner, np.arange(len(texts) + 1))
        weight = np.where(labels == 1, 1.0, min(3.0, labels.sum() / (labels == 0).sum()))
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        epochs = max(epochs, -(-least_steps // -(-len(texts) // batch)))
        step, total = 0, epochs * -(-len(texts) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for a in range(0, len(order), batch):
                docs = order[a : a + batch]
                pick = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in docs])
                first = np.concatenate(([0], np.cumsum(begin[docs + 1] - begin[docs])))[:-1]
                g = self.gradients(chunks[pick], flags[pick], first, labels[docs], weight[docs])
                step += 1
                pace = rate * (1 - step / (total + 1))
                for k, x in self.w.items():
                    m[k] += 0.1 * (g[k] - m[k])
                    v[k] += 0.01 * (g[k] ** 2 - v[k])
                    x -= (pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def training_rows(labels: DataFrame, *, key: str = "doc_id", folds: int = 5) -> DataFrame:
    """Labelled rows that may be learned from: crc32(id as text) mod ``folds`` is not 0."""
    return labels.where(F.col("quality").isin(0, 1) & (F.crc32(F.col(key).cast("string").cast("binary")) % folds != 0)).select(key, F.col("quality").cast("int").alias("quality"))


def fit_quality(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", sample_rows: int = 4000, sample_bytes: int = 16 << 20, **options) -> ByteNetwork:
    """A network fitted on whole texts of rows of ``labels`` that have a document.

    Rows are taken by the hash of their key until there are ``sample_rows`` or
    the next would pass ``sample_bytes`` bytes of text together; a longer text
    than that is passed over. Rows with a null key, or without a label of 0 or
    1, are not learned from; without both labels every score is the same.
    """
    chosen = training_rows(labels, key=key).orderBy(F.xxhash64(key), key, "quality").limit(sample_rows)
    # the sample is bounded by its parameters, so it may be sent to all tasks
    met = docs.select(key, F.encode(F.coalesce(text, F.lit("")), "UTF-8").alias("b")).join(F.broadcast(chosen), key)
    met = met.where(F.length("b") <= sample_bytes).withColumns({"order": F.xxhash64(key), "digest": F.xxhash64("b")})
    # lengths first: at most ``sample_rows`` of them are added up in one place
    sizes = met.select("order", key, "quality", "digest", F.length("b").alias("n")).orderBy("order", key, "quality", "digest").limit(sample_rows).collect()
    total, count = 0, 0
    for r in sizes:
        total += r["n"]
        if total > sample_bytes:
            break
        count += 1
    rows = met.orderBy("order", key, "quality", "digest").limit(count).select("b", "quality").collect() if count else []
    return ByteNetwork().fit([bytes(r["b"]) for r in rows], np.array([r["quality"] for r in rows], np.float64), **options)


def _scores(network: ByteNetwork, column: pa.Array) -> np.ndarray:
    data, at = _text.utf8_buffers(column)
    parts = [network.score(data, at[a : z + 1]) for a, z in _text.slices(at)]
    return np.concatenate(parts) if parts else np.zeros(0)


def score_quality(docs: DataFrame, network: ByteNetwork, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``score`` (0 to 1) of every whole text; null and empty texts score as one empty chunk."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(key).cast(pa.int64()), pa.array(_scores(network, b.column(text)))], [key, "score"])

    return docs.select(key, text).mapInArrow(rows, f"{key} bigint, score double")


def keep_quality(docs: DataFrame, network: ByteNetwork, *, text: str = "text", least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text scores ``least`` or more, all columns unchanged."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_scores(network, b.column(text)) >= least))

    return docs.mapInArrow(rows, docs.schema)
