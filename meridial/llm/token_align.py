"""Alignment of two tokenizers' tokens over the same bytes, and how well they agree.

A text is encoded by a byte-level vocabulary (A: ``tokenizers``, over a space
and the text) and by a sentencepiece vocabulary with byte fallback (B, which
adds that space itself). Coarse cuts come from the libraries: character offsets
of A, byte spans of B's proto. They are not enough where several tokens share a
character: A gives each of them the whole character, B an empty span to all but
the last. There the bytes that the tokens decode to decide. Byte offsets at
which tokens of both end cut them into groups, and tokens whose bytes overlap
are linked.

Words repeat, so a worker encodes a piece of text between two words' spaces
once and keeps what it found, in a table of bounded size. A single space
between two other characters starts a word in both vocabularies: A's pattern
matches no space behind another character, and no piece of B has one (which is
checked when the model is read; such a model's texts are encoded whole).

What an id pair counts for is a matter of the whole corpus. Texts are encoded
once; each row is written with its distinct pairs and how often it has them.
Counts of pairs are one aggregate. The commonest ``common_pairs`` of them, a
bounded table, are looked up in the map task; all others are joined by a
shuffle, so every pair is counted whatever its rank.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridial.llm._work import cut, drop

#: Chunks that a worker keeps, twice over, and the longest chunk that it keeps, in characters.
KEPT_CHUNKS, KEPT_CHARS = 400_000, 48
#: Characters of new chunks that are encoded together, and of text that is split together.
ENCODED_CHARS, SPLIT_CHARS = 1 << 16, 1 << 20
#: Rows of the table of common pairs: 16 bytes each, in every worker.
COMMON_PAIRS = 1 << 18

#: A space between two characters that are no white space of any kind.
_WORD_START = re.compile(r"(?<=\S) (?=\S)")


def byte_decoder() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary.

    Printable bytes stand for themselves, the others for the characters from U+0100 on, in order.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Aligner:
    """Both tokenizers in one process, and what they made of the chunks met so far."""

    def __init__(self, a_file: bytes, b_file: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(a_file)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        self.b_size = self.b.get_piece_size()
        to_byte = byte_decoder()
        self.a_bytes = [b""] * (max(self.a.get_vocab().values()) + 1)
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b_size)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.lengths = [np.array([len(x) for x in table], np.int64) for table in (self.a_bytes, self.b_bytes)]
        self.pair_type = np.dtype(np.int32 if self.b_size * len(self.a_bytes) < 2**31 else np.int64)
        #: ids as text, followed by a comma or by what closes A's or B's side of a group
        self.named = [[np.array([f"{i}{mark}" for i in range(len(table))], object) for mark in marks] for table, marks in ((self.a_bytes, ",|"), (self.b_bytes, ",;"))]
        #: whether no piece goes on behind a word with a space
        self.by_words = not any(re.search("[^▁]▁", p) for p in pieces)
        #: the chunks met last and those before them
        self.kept: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}

    def ends(self, text: str, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids and byte ends of A's and of B's tokens; None if their bytes are not the text's.

        The libraries' spans are taken where they meet their neighbours'. A span
        that overlaps another (tokens that share a character) or is not as long as
        its token ends where the decoded bytes do.
        """
        encoding = self.a.encode(text, add_special_tokens=False)
        a, spans = np.array(encoding.ids, np.int64), np.array(encoding.offsets, np.int64).reshape(-1, 2)
        # B adds the text's first space itself
        pieces = self.b.encode(text[1:], return_type="proto", num_threads=1).pieces
        b, coarse_b = np.array([p.id for p in pieces], np.int64), np.array([p.end for p in pieces], np.int64) + 1
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) != data or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != data:
            return None
        if len(text) < len(data):
            first = np.append(np.flatnonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80), len(data))
            spans = first[spans]
        meets = spans[1:, 0] == spans[:-1, 1]
        alone = np.append(True, meets) & np.append(meets, True)
        fine_a, fine_b = (np.cumsum(own[ids]) for own, ids in zip(self.lengths, (a, b), strict=True))
        as_long = np.diff(coarse_b, prepend=0) == self.lengths[1][b]
        a_ends, b_ends = np.where(alone, spans[:, 1], fine_a), np.where(as_long, coarse_b, fine_b)
        # spans that do not lie where their tokens' bytes do would be the libraries' error
        return (a, a_ends, b, b_ends) if (a_ends == fine_a).all() and (b_ends == fine_b).all() else (a, fine_a, b, fine_b)

    def facts(self, chunks: list[str]) -> list[tuple | None]:
        """(A's tokens, groups as text, id pairs of the links) of each chunk.

        The chunks are encoded as one text; the tokens of each are what it has
        alone, see ``regular``. None if the bytes of A's or B's tokens are not the
        chunk's; which chunk it is, halves find out.
        """
        text = "".join(chunks)
        data = text.encode()
        found = self.ends(text, data)
        if found is None:
            half = len(chunks) // 2
            return self.facts(chunks[:half]) + self.facts(chunks[half:]) if half else [None]
        a, a_ends, b, b_ends = found
        ends_a, ends_b = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
        ends_a[a_ends], ends_b[b_ends] = True, True
        # a stretch between two ends, of whichever tokens, is what one token of A and one of B share
        shared, common = np.flatnonzero(ends_a | ends_b), np.flatnonzero(ends_a & ends_b)
        pairs = a[np.searchsorted(a_ends, shared)] * self.b_size + b[np.searchsorted(b_ends, shared)]
        # tokens in the order of groups, A's side before B's
        to_a, to_b = np.searchsorted(a_ends, common, "right"), np.searchsorted(b_ends, common, "right")
        of_a, of_b = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
        out = np.empty(len(a) + len(b), object)
        for ids, ends, at, named, closing in ((a, a_ends, np.arange(len(a)) + np.append(0, to_b)[of_a], self.named[0], to_a), (b, b_ends, np.arange(len(b)) + to_a[of_b], self.named[1], to_b)):
            words = named[0][ids]
            words[closing - 1] = named[1][ids[closing - 1]]
            out[at] = words
        groups = "".join(out.tolist())
        chars = np.append(0, np.cumsum(np.fromiter(map(len, out), np.int64, len(out))))
        stops = np.cumsum([len(c.encode()) for c in chunks])
        i, j, s = (np.append(0, np.searchsorted(x, stops, "right")) for x in (a_ends, b_ends, shared))
        at, packed = chars[i + j].tolist(), pairs.astype(self.pair_type).tobytes()
        s, n = (self.pair_type.itemsize * s).tolist(), np.diff(i).tolist()
        return [(n[k], groups[at[k] : at[k + 1]], packed[s[k] : s[k + 1]]) for k in range(len(chunks))]

    @staticmethod
    def regular(chunk: str) -> bool:
        """Whether a chunk may stand before and behind others: one space, then no white space at either end."""
        return not (chunk[-1].isspace() or chunk[1].isspace())

    def encode(self, chunks: list[str]) -> Iterator[tuple[str, tuple | None]]:
        some, chars = [], 0
        for c in chunks:
            if self.by_words and self.regular(c):
                some.append(c)
                chars += len(c)
                if chars >= ENCODED_CHARS:
                    yield from zip(some, self.facts(some), strict=True)
                    some, chars = [], 0
            else:
                yield c, self.facts([c])[0]
        if some:
            yield from zip(some, self.facts(some), strict=True)

    def chunks(self, text: str) -> Iterator[list[str]]:
        """The space and the text in chunks that start with a space, some at a time."""
        if not self.by_words:
            yield from ([" " + text] if text else [],)
            return
        at = 0
        while at < len(text):
            stop = at + SPLIT_CHARS
            if stop < len(text):
                found = _WORD_START.search(text, stop)
                stop = found.start() if found else len(text)
            # a block ends where a word does: the space behind it is the next chunk's first character
            yield [" " + c for c in _WORD_START.split(text[at:stop])]
            at = stop + 1

    def learn(self, chunks: set[str]) -> dict[str, tuple | None]:
        """What is known of the chunks; new ones are encoded together, and kept unless they are long."""
        kept, older = self.kept, self.older
        out = {c: kept[c] for c in chunks if c in kept}
        again = {c: older[c] for c in chunks if c in older and c not in out}
        again |= self.encode([c for c in chunks if c not in out and c not in again])
        if len(kept) + len(again) > KEPT_CHUNKS:
            self.kept, self.older = {}, kept
        self.kept.update((c, x) for c, x in again.items() if len(c) <= KEPT_CHARS)
        return out | again

    def align_all(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
        """Counts and digest of each text, its distinct pairs and how often it has them."""
        some, chars = [], 0
        for text in texts:
            if chars + len(text or "") > SPLIT_CHARS:
                yield from self._together(some)
                some, chars = [], 0
            some.append(text or "")
            chars += len(some[-1])
        yield from self._together(some)

    def _together(self, texts: list[str]) -> Iterator[tuple]:
        """Short texts, whose new chunks are encoded together, or one long one, block by block."""
        if len(texts) == 1:
            yield self._align((c, self.learn(set(c))) for c in self.chunks(texts[0]))
        else:
            split = [[*self.chunks(t)] for t in texts]
            known = self.learn(set().union(*(c for blocks in split for c in blocks)))
            yield from (self._align((c, known) for c in blocks) for blocks in split)

    def _align(self, blocks: Iterator[tuple[list[str], dict]]) -> tuple:
        a = groups = links = 0
        digest, last, keys, times = hashlib.sha256(), "", [], []
        for chunks, known in blocks:
            facts = [known[c] for c in chunks]
            if None in facts:
                a = 0
                break
            n, texts, packed = zip(*facts, strict=True)
            said, pairs = "".join(texts), np.frombuffer(b"".join(packed), self.pair_type)
            digest.update((last + said[:-1]).encode())
            last = ";"
            a, groups, links = a + sum(n), groups + said.count(";"), links + len(pairs)
            k, c = np.unique(pairs, return_counts=True)
            keys.append(k)
            times.append(c)
        if not a:
            return 0, 0, 0, 0, "", np.zeros(0, self.pair_type), np.zeros(0, np.int64)
        if len(keys) > 1:
            k, at = np.unique(np.concatenate(keys), return_inverse=True)
            keys, times = [k], [np.bincount(at, np.concatenate(times)).astype(np.int64)]
        # both tokenizers' ends are links and groups at once, so there are a + b - groups links
        return a, links + groups - a, groups, links, digest.hexdigest(), keys[0], times[0]


#: Tokenizers and kept chunks of this process, by the digest of both files.
_aligners: dict[str, Aligner] = {}


class Vocabularies:
    """The two tokenizers' files, read by the driver and sent to the executors (some megabytes, whatever the corpus)."""

    def __init__(self, a_file: str, b_file: str):
        self.files = [open(f, "rb").read() for f in (a_file, b_file)]
        self.key = hashlib.sha256(b"".join(self.files)).hexdigest()

    def aligner(self) -> Aligner:
        """This process's, with the chunks that earlier tasks met."""
        if self.key not in _aligners:
            _aligners[self.key] = Aligner(*self.files)
        return _aligners[self.key]


def _lists(arrays: list[np.ndarray], kind: np.dtype) -> pa.Array:
    ends = np.append(0, np.cumsum([len(x) for x in arrays])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).astype(kind)))


def _align_rows(files):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = files.value.aligner(), TaskContext.get().partitionId() << 33
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                found = list(own.align_all(some.column(1).to_pylist()))
                yield pa.record_batch(
                    {
                        "row": pa.array(range(n, n + len(found)), pa.int64()),
                        "doc_id": some.column(0).cast(pa.int64()),
                        **{name: pa.array([f[i] for f in found], pa.int64()) for i, name in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
                        "groups_sha256": pa.array([f[4] for f in found], pa.string()),
                        "pairs": _lists([f[5] for f in found], own.pair_type),
                        "times": _lists([f[6] for f in found], np.dtype(np.int32)),
                    }
                )
                n += len(found)

    return rows


def align_tokens(docs: DataFrame, files: Vocabularies, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Written rows: the document, its counts, the digest of its groups, its distinct id pairs and their times.

    A row's ``row`` is its own, whatever the key (null and repeated keys are
    rows like others). ``pairs`` are ``A's id * B's vocabulary size + B's id``.
    Null and empty texts, and texts that A's or B's tokens do not give back byte
    by byte, have zeros, an empty digest and no pairs. Other columns are not read.
    """
    kind = "int" if files.aligner().pair_type == np.int32 else "bigint"
    schema = f"row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<{kind}>, times array<int>"
    return cut(docs.select(key, text).mapInArrow(_align_rows(docs.sparkSession.sparkContext.broadcast(files)), schema))


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """Written table: id pair, links that hold it corpus-wide, whether no pair of its B id has more.

    The most of each B id are one row a B id, at most the vocabulary's size.
    """
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("p.pairs", "p.times")
    counts = cut(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n")))
    b = F.col("pair") % b_size
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    out = cut(counts.join(F.broadcast(most), b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")))
    drop(counts)
    return out


def _look_up(common, kind: pa.DataType):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = common.value
        for b in batches:
            pairs, times = b.column("pairs").combine_chunks() if isinstance(b.column("pairs"), pa.ChunkedArray) else b.column("pairs"), b.column("times")
            ends = pairs.offsets.to_numpy()
            ends, p, t = ends - ends[0], pairs.flatten().to_numpy().astype(np.int64), times.flatten().to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(keys, p), max(len(keys) - 1, 0))
            known = keys[at] == p if len(keys) else np.zeros(len(p), bool)
            total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[ends])
            value, top = (np.where(known, n[at] * t, 0), np.where(known & best[at], t, 0)) if len(keys) else (np.zeros(len(p), np.int64),) * 2
            left = np.concatenate(([0], np.cumsum(~known)))[ends].astype(np.int32)
            columns = {c: b.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
            rest = lambda x, to: pa.ListArray.from_arrays(pa.array(left), pa.array(x[~known]).cast(to))
            yield pa.record_batch(columns | {"n_best": pa.array(total(top)), "count_sum": pa.array(total(value)), "pairs": rest(p, kind), "times": rest(t, pa.int32())})

    return rows


def agreement(aligned: DataFrame, counts: DataFrame, common_pairs: int = COMMON_PAIRS) -> DataFrame:
    """Per row of ``aligned``: links whose pair is its B id's most frequent, and the sum of the links' counts."""
    spark = aligned.sparkSession
    table = counts.orderBy(F.desc("n"), "pair").limit(common_pairs).toPandas().sort_values("pair")
    common = spark.sparkContext.broadcast((table["pair"].to_numpy(np.int64), table["n"].to_numpy(np.int64), table["best"].to_numpy(bool)))
    kind = pa.int64() if dict(counts.dtypes)["pair"] == "bigint" else pa.int32()
    found = cut(aligned.mapInArrow(_look_up(common, kind), aligned.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"), "pairs", "times").schema))
    rest = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    settled = rest.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum"))
    plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).cast("long").alias(a)
    return found.drop("pairs", "times").join(settled, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", plus("n_best", "more_best"), plus("count_sum", "more_sum"), "groups_sha256")


def align(docs: DataFrame, a_file: str, b_file: str, key: str = "doc_id", text: str = "text", common_pairs: int = COMMON_PAIRS) -> DataFrame:
    """Alignment of all documents with what their links count for in the whole corpus.

    Null and repeated keys, null and empty texts: see ``align_tokens``. An
    empty table gives no rows. Ties for a B id's most frequent pair all count.
    """
    files = Vocabularies(a_file, b_file)
    aligned = align_tokens(docs, files, key, text)
    return agreement(aligned, pair_counts(aligned, files.aligner().b_size), common_pairs)
