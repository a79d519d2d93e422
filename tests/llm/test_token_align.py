"""Aligned tokens against both libraries' encodings of whole texts."""

import hashlib
import random
from collections import Counter

import pytest
from conftest import SF

from meridial.llm import token_align
from meridial.llm.token_align import Vocabularies, align

A, B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
ODD = [
    None, "", " ", "  ", "x", " x", "a  b \n c ", "tab\there  and\r\n\r\nthere", "Hello é漢🂡 <s> \n\x00 a  b <|endoftext|> <0x0A> ok", "▁ not its bytes", "no▁bytes either",
    "it's we'll  'll x", "　 a   b\x1c c\x85 d", "ﬁ ﬂ é", "漢字かな交じり文" * 40, "a" * 3000, "é" * 1000 + " " + "ñ" * 1000, "twice it is", "twice it is",
]


def whole(text, own):
    """Token ids and byte ends of a whole text, from decoded bytes alone."""
    full = (" " + text).encode()
    a, b = own.a.encode(" " + text, add_special_tokens=False).ids, own.b.encode(text)
    if not text or b"".join(own.a_bytes[i] for i in a) != full or b"".join(own.b_bytes[i] for i in b) != full:
        return None
    ends = []
    for ids, table in ((a, own.a_bytes), (b, own.b_bytes)):
        at, out = 0, []
        for i in ids:
            at += len(table[i])
            out.append(at)
        ends.append(out)
    return a, b, *ends


def expected(texts, own):
    facts, counts = [], Counter()
    for text in texts:
        w = whole(text or "", own)
        if w is None:
            facts.append(None)
            continue
        a, b, a_ends, b_ends = w
        groups, i, j = [], 0, 0
        for z in sorted(set(a_ends) & set(b_ends)):
            p, q = a_ends.index(z) + 1, b_ends.index(z) + 1
            groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
            i, j = p, q
        starts = [[0, *e[:-1]] for e in (a_ends, b_ends)]
        links, j0 = [], 0
        for i in range(len(a)):
            while b_ends[j0] <= starts[0][i]:
                j0 += 1
            j = j0
            while j < len(b) and starts[1][j] < a_ends[i]:
                links.append((a[i], b[j]))
                j += 1
        counts.update(links)
        facts.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else (*f[:3], len(f[3]), sum(counts[x] == most[x[1]] for x in f[3]), sum(counts[x] for x in f[3]), f[4]) for f in facts]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("common", [0, 50, token_align.COMMON_PAIRS])
def test_alignment_equals_whole_encodings(spark, common, monkeypatch):
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect()]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)], "doc_id long, text string, pairs string, row int").repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in align(docs, A, B, common_pairs=common).collect()}
    want = expected(texts, Vocabularies(A, B).aligner())
    assert [got[i] for i in range(len(texts))] == want
    assert got[9] == got[10] == got[0] == (0, 0, 0, 0, 0, 0, "") and got[8][0] > 0


def test_null_and_repeated_keys_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "some words"), (None, "other"), (3, "some words"), (3, "some words")], "doc_id long, text string")
    rows = sorted((r["doc_id"] or 0, r["n_a"], r["count_sum"]) for r in align(docs, A, B).collect())
    assert len(rows) == 4 and rows[2] == rows[3] and rows[2][2] == 3 * rows[2][1]
    assert align(docs.where("false"), A, B).count() == 0


def test_blocks_and_a_full_table_change_nothing(monkeypatch):
    own = Vocabularies(A, B).aligner()
    rng = random.Random(3)
    texts = ["".join(rng.choice([" ", "  ", "\n", "é", "漢", "a", "B", "'s", ",", "🂡", "word", " the"]) for _ in range(rng.randint(1, 200))) for _ in range(300)]
    found = [x[:5] for x in own.align_all(texts)]
    want = [(f[0], f[1], f[2], f[3], f[6]) for f in expected(texts, own)]
    assert found == want
    monkeypatch.setattr(token_align, "SPLIT_CHARS", 40)
    monkeypatch.setattr(token_align, "KEPT_CHUNKS", 20)
    assert [x[:5] for x in own.align_all(texts)] == want
