"""Secret scans: patterns, and dictionary-primed zstandard novelty.

Besides three fixed patterns, strings next to sensitive words are judged by
how little is known about them: a candidate's marginal size is what zstandard
needs for its surroundings with it, less what it needs for them without it, with
a compressor primed by a dictionary of identifiers and by the surrounding text.
Prose, paths and names shrink to little; keys do not. No text shrinks below the
entropy of its alphabet, and a long key comes near to it (0.75 bytes a character
in base64, 0.5 in hexadecimal digits), so the size is held against the
candidate's own alphabet. Names of things are short and new to any dictionary,
so they do not always shrink: a candidate whose letters stand mostly in parts
like words (between separators, changes of case and digits), or that has the
form of a UUID, is a name and not reported, however it compresses.
Incompressible candidates in a sensitive context are reported as ``novel``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

#: Kinds in the order that breaks ties, patterns and least lengths.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16

#: What makes a context sensitive, and what may be a secret there.
SENSITIVE = re.compile(r"pass(?:word|wd|phrase|code)|secret|token|api[_-]?key|private[_-]?key|access[_-]?key|credential|authoriz|bearer|client[_-]?id|signature", re.I | re.A)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=~-]{16,}")

#: Cheap signs that a text may match at all: parts of the words above in lower
#: case, and runs of 16 hexadecimal digits in a translation of its bytes.
_ASSIGN_PARTS = ("passw", "secret", "token", "api")
_SENSITIVE_PARTS = ("pass", "secret", "token", "key", "credential", "authoriz", "bearer", "client", "signature")
_HEX_MAP = bytes(1 if chr(i) in "0123456789abcdef" else 0 for i in range(256))
_HEX_RUN = b"\x01" * LEAST_HEX

#: Identifiers and phrases that stand around secrets without being any.
IDENTIFIERS = """
import export return function class const static public private protected string integer boolean
config configuration settings environment default example sample placeholder changeme your_token_here
password passwd passphrase secret token api_key apikey access_key private_key client_id client_secret
credentials authorization bearer basic header request response session cookie signature public_key
username user_name email address hostname localhost database connection postgresql mysql mongodb redis
http:// https:// www. .com/ .org/ .net/ /usr/local/bin /etc/ /home/ /var/log/ .json .yaml .properties .txt
-----BEGIN PRIVATE KEY----- -----END PRIVATE KEY----- 0123456789 abcdefghijklmnopqrstuvwxyz
ABCDEFGHIJKLMNOPQRSTUVWXYZ the and that with from this which would there their about other these
"""

#: Pairs of letters that make up most of words and few of random letters.
PAIRS = frozenset(
    "th he in er an re nd at on nt ha es st en ed to it ou ea hi is or ti as te et ng of al de se le sa si ar ve ra ld ur ro ri li ne me el io ic ll "
    "co ta ce ch om ma ns la be di ac ee ec us ss il ho ow tr no em ot sh ol ge pe un ut pr ad su ul id po so ap ct lo fi ei ie qu ue os do da ca ai".split()
)


#: Parts of a name: a capital with small letters, a run of capitals, small letters, digits.
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")


_CONSONANTS = re.compile(r"[^aeiouy]{3}")


def like_word(part: str, least: float = 0.36) -> bool:
    """Whether three letters or more have ``least`` of their pairs common, or four or more can be spoken.

    To be spoken, a fifth to two thirds must be vowels, no three consonants may
    stand in a row, and half as many pairs must be common.
    """
    low = part.lower()
    if not low.isalpha() or len(low) < 3:
        return False
    common = sum(low[i : i + 2] in PAIRS for i in range(len(low) - 1)) / (len(low) - 1)
    vowels = sum(c in "aeiouy" for c in low) / len(low)
    return common >= least or (len(low) > 3 and 0.2 <= vowels <= 0.67 and common >= least / 2 and not _CONSONANTS.search(low))


def word_share(value: str) -> float:
    """Share of the letters and digits of ``value`` in parts like words, or in numbers of up to 8 digits if those are nearly half."""
    parts = _PART.findall(value)
    letters, words = sum(map(len, parts)), sum(len(p) for p in parts if like_word(p))
    numbers = sum(len(p) for p in parts if p[0].isdigit() and len(p) <= 8) if words > 0.45 * letters else 0
    return (words + numbers) / max(1, letters)


#: Segments of a name: letters of one case or humps, and digits only behind them.
_SEGMENT = re.compile(r"(?:[A-Z]?[a-z]{2,}(?:[A-Z][a-z]+)*|[A-Z]{2,})[0-9]{0,4}")
_BETWEEN = re.compile(r"[+/_.=~-]+")


def in_segments(value: str) -> bool:
    """Whether ``value`` is put together like a name: two parts or more, of 3 to 14 letters on average, no digits amid letters.

    Random characters of any usual alphabet hardly ever are: their case changes
    every other letter, and digits stand between them. Codes in three groups or more
    of equal length (``abcd-efgh-ijkl-mnop``) are not taken for names.
    """
    segments = [x for x in _BETWEEN.split(value) if x]
    if len(segments) > 2 and len(set(map(len, segments))) == 1:
        return False
    if not all(_SEGMENT.fullmatch(x) or (x.isdigit() and len(x) <= 4) for x in segments):
        return False
    parts = [p for p in _PART.findall(value) if p.isalpha()]
    return len(parts) > 1 and 3 <= sum(map(len, parts)) / len(parts) and max(map(len, parts)) <= 14


class NoveltyScanner:
    """Finds secrets in one text at a time.

    A candidate stands within ``reach`` characters behind a sensitive word. It
    is reported if its marginal compressed size is ``least_ratio`` of the
    entropy of its own characters, were they drawn alike, or more, and less than
    ``most_words`` of it is like words, or ``most_in_segments`` if it is put together
    like a name: acronyms and names of products are no words. Without letters it
    needs 16 digits in a row.
    """

    def __init__(self, reach: int = 64, around: int = 512, least_ratio: float = 0.8, most_words: float = 0.6, most_in_segments: float = 0.35, identifiers: str = IDENTIFIERS):
        self.reach, self.around, self.least_ratio, self.most_words = reach, around, least_ratio, most_words
        self.most_in_segments = most_in_segments
        self._dictionary = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self._compressor = zstandard.ZstdCompressor(level=9, dict_data=self._dictionary, write_content_size=False, write_checksum=False)

    def _size(self, text: str) -> int:
        return len(self._compressor.compress(text.encode("utf-8", "replace")))

    def marginal_bytes(self, before: str, candidate: str, after: str = "") -> int:
        """Bytes that the candidate adds to its surroundings."""
        return self._size(before + after + candidate) - self._size(before + after)

    def is_novel(self, before: str, candidate: str, after: str = "") -> bool:
        """Whether the candidate is incompressible."""
        if not (re.search(r"[A-Za-z]", candidate) or re.search(r"[0-9]{16}", candidate)) or _UUID.fullmatch(candidate):
            return False
        if word_share(candidate) >= (self.most_in_segments if in_segments(candidate) else self.most_words):
            return False
        own = len(candidate) * math.log2(len(set(candidate))) / 8
        return self.marginal_bytes(before, candidate, after) >= self.least_ratio * own > 0

    def base_spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) of the fixed patterns: leftmost, non-overlapping within a kind."""
        lower = text.lower()
        out = []
        if any(p in lower for p in _ASSIGN_PARTS):
            out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
        if "AKIA" in text:
            out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
        if _HEX_RUN in text.encode("utf-8", "replace").translate(_HEX_MAP):
            out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
        return out

    def novel_spans(self, text: str, known: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """Spans of incompressible strings in a sensitive context that ``known`` does not meet."""
        out, done = [], 0
        lower = text.lower()
        if not any(p in lower for p in _SENSITIVE_PARTS):
            return out
        for word in SENSITIVE.finditer(text):
            at = max(word.end(), done)
            for m in CANDIDATE.finditer(text, at, min(len(text), word.end() + self.reach + 256)):
                if m.start() > word.end() + self.reach:
                    break
                start, end = m.start(), m.end()
                if end == word.end() + self.reach + 256:  # cut off by the search's end
                    end = CANDIDATE.match(text, start).end()
                done = end
                value = text[start:end]
                if any(start < z and a < end for a, z, _ in known):
                    continue
                if self.is_novel(text[max(0, start - self.around) : start], value, text[end : end + self.around]):
                    out.append((start, end, "novel"))
        return out

    def spans(self, text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """The base spans and all spans, each by start, then kind."""
        order = lambda s: (s[0], KINDS.index(s[2]))
        base = sorted(self.base_spans(text), key=order)
        return base, sorted(base + self.novel_spans(text, base), key=order)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[secret]") -> str:
    """``text`` with every run of overlapping spans replaced by one ``mark``."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def scan_secrets(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Spans of secrets in every whole text (null: as empty).

    Returns ``key, n_assign, n_access, n_hex, n_novel, base_spans, spans``;
    spans are ``kind:start:end`` in code points, end exclusive, comma-joined by
    start, then kind. Spans of different kinds may overlap. No shuffle; texts
    are read one after the other.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = NoveltyScanner(**options)
        for b in batches:
            counts: dict[str, list] = {k: [] for k in KINDS}
            based, every = [], []
            for t in b.column(text):
                base, spans = scanner.spans(t.as_py() or "")
                for k in KINDS:
                    counts[k].append(sum(s[2] == k for s in spans))
                based.append(joined(base))
                every.append(joined(spans))
            yield pa.record_batch([b.column(key).cast(pa.int64()), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(based, pa.string()), pa.array(every, pa.string())], [key, *(f"n_{k}" for k in KINDS), "base_spans", "spans"])

    return docs.select(key, text).mapInArrow(rows, f"{key} bigint, n_assign bigint, n_access bigint, n_hex bigint, n_novel bigint, base_spans string, spans string")


def redact_secrets(docs: DataFrame, *, text: str = "text", n_chars: str | None = "n_chars", **options) -> DataFrame:
    """``docs`` with all found spans replaced; other columns and null texts as they were.

    ``n_chars``, if the table has such a column, follows the new text.
    """
    schema = docs.schema

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = NoveltyScanner(**options)
        for b in batches:
            texts = [None if t is None else redact(t, scanner.spans(t)[1]) for t in b.column(text).to_pylist()]
            cols = []
            for f, c in zip(b.schema, b.columns, strict=True):
                if f.name == text:
                    c = pa.array(texts, f.type)
                elif f.name == n_chars:
                    c = pa.array([v if t is None else len(t) for v, t in zip(c.to_pylist(), texts, strict=True)], f.type)
                cols.append(c)
            yield pa.record_batch(cols, schema=b.schema)

    return docs.mapInArrow(rows, schema)


