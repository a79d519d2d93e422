"""Personal data and disclosing terms against brute force in Python."""

import math
import random
import re
from collections import Counter, defaultdict

from conftest import SF

from meridial.llm.sanitise import REACH, Disclosures, find_private, running, sanitise
from pyspark.sql import functions as F

#: The contract's patterns, as they are stated.
CONTRACT = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]"
ODD = [
    None, "", "x", "a@b.c_d@e.f", "a@b@c.d é@é.de x@y..z q@r.s. t@u.v-w.", "@.@.a@b", "1.2.3.4.5.6.7.8 256.1.1.1 0255.00.1.0001 1.2.3 9.9.9.999 1..2.3.4.5",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 41111111 11111111 4111  1111", "4111111111111111" * 3 + " 0000000000000 12 3 4",
    "+1 (136) 555-7479, +49.30.1234567. +1 2, +12345678, +123456789012345, +1234567890123456 ++44 20 7946 0958) +1-",
    "漢字🂡 me@host.example.org 🂡 +1 (136) 555-7479 é 10.0.0.1", "a" * 50_000, "1" * 20_000, "1." * 5_000, "a." * 5_000 + "@b.c", "+1" + "(" * 20_000, ("me@x.y 1.2.3.4 " * 700),
    "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9" * 200, "twice me@x.org", "twice me@x.org",
]


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def holds(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if holds(k, m[0])] for k, p in CONTRACT.items()}


def said(spans):
    return ",".join(f"{k}:{a}:{z}" for k, found in spans.items() for a, z in found)


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)], "doc_id long, text string, told string, email int")


def test_running_sums(spark):
    rows = spark.createDataFrame([([i % 7 for i in range(n)],) for n in (0, 1, 63, 64, 65, 1000)], "x array<int>")
    for r in rows.select("x", running(F.col("x")).alias("y")).collect():
        assert r["y"] == [sum(r["x"][: i + 1]) for i in range(len(r["x"]))]


def test_patterns_equal_the_contract(spark):
    rng = random.Random(2)
    bits = ["a", "b.c", "@", ".", "1", "22", "333", "-", " ", "+", "(", ")", "4111111111111111", "é", "_", "x@y.z", "1.2.3.4", "+1 ", "\n"]
    texts = ODD + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    for r in find_private(frame(spark, texts)).collect():
        want = base(texts[r["doc_id"]])
        assert r["base_spans"] == said(want), texts[r["doc_id"]][:80]
        assert [r[f"n_{k}"] for k in CONTRACT] == [len(x) for x in want.values()] and r["spans"].startswith(r["base_spans"])


def corpus():
    """A name that always stands with one address, a firm that mostly does, and words that do not."""
    rng = random.Random(5)
    filler = ["this", "that", "with", "from", "letter", "meeting", "about", "Straße", "paper"]
    some = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    texts = [f"{some(9)} Grünwald {some(2)} write to ann@firm.example {some(3)} holding {some(30)}" for _ in range(12)]
    texts += [f"{some(20)} holding {some(20)}" for _ in range(6)] + [f"{some(60)}" for _ in range(300)]
    texts += [f"{some(30)} GRüNWALD {some(5)} GRÜNWALD", f"{some(10)} Grünwalder {some(5)}", "grünwald,Grünwald", None, ""]
    texts += [f"exact copies have one odd word unikat and bob@firm.example {'always ' * 9}"] * 20
    return texts


def lowered(text):
    """Only A-Z: letters like a capital umlaut make another term."""
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def told(texts, threshold, support):
    """term: disclosure, from all contexts and all words."""
    words = lambda t: [w for w in re.findall(LETTERS + "+", lowered(t)) if len(w) >= 3]
    together, contexts, places = defaultdict(Counter), defaultdict(lambda: defaultdict(set)), Counter()
    for t in texts:
        places.update(words(t or ""))
        for kind, pattern in CONTRACT.items():
            found, gaps, at = [m for m in re.finditer(pattern, t or "")], [], 0
            for m in found:
                gaps.append(t[at : m.start()])
                at = m.end()
            gaps.append((t or "")[at:])
            for m, a, b in zip(found, gaps, gaps[1:], strict=False):
                if holds(kind, m[0]):
                    a = re.sub(r"^\S+", " ", a[-REACH:]) if len(a) > REACH else a
                    b = re.sub(r"\S+$", " ", b[:REACH]) if len(b) > REACH else b
                    near = words(re.sub(r"\S*@\S*", " ", a + " " + b))
                    entity = kind, m[0].lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", m[0])
                    together[entity].update(near)
                    for w in near:
                        contexts[entity][w].add(tuple(near))
    total, out = places.total(), {}
    for e, counts in together.items():
        content = math.log(total / counts.total())
        for w, n in counts.items():
            if len(contexts[e][w]) >= support:
                out[w] = max(out.get(w, -9e9), 1 + math.log(min(1, n / places[w])) / content)
    return {w: d for w, d in out.items() if d >= threshold}


def test_disclosures_equal_brute_force(spark):
    texts = corpus()
    for threshold, support in ((0.9, 3), (0.5, 3), (0.9, 13)):
        got = {r["term"]: r["disclosure"] for r in Disclosures(frame(spark, texts), threshold=threshold, support=support).terms.collect()}
        want = told(texts, threshold, support)
        assert got.keys() == want.keys() and all(abs(got[w] - want[w]) < 1e-9 for w in want)
    assert "grünwald" in told(texts, 0.9, 3) and "unikat" not in told(texts, 0.9, 3)
    rows = {r["doc_id"]: r for r in find_private(frame(spark, texts)).collect()}
    terms = told(texts, 0.95, 3)
    pattern = re.compile("|".join(rf"(?<!{LETTERS})(?:{w})(?!{LETTERS})" for w in terms))
    for i, t in enumerate(texts):
        want = base(t) | {"term": [(m.start(), m.end()) for m in pattern.finditer(lowered(t))]}
        assert rows[i]["spans"] == said(want) and rows[i]["n_term"] == len(want["term"])


def test_sanitised_texts(spark, monkeypatch):
    texts = corpus() + ["card 4111 1111 1111 1111, not 4111 1111 1111 1112; 10.0.0.1 or 10.0.0.256; +1 (136) 555-7479"]
    docs = frame(spark, texts)
    own = Disclosures(docs)
    out = {r["doc_id"]: r for r in sanitise(docs, disclosures=own).collect()}
    assert len(out) == len(texts) and sanitise(docs, disclosures=own).columns == docs.columns
    assert out[len(texts) - 1]["text"] == "card [card], not 4111 1111 1111 1112; [ip] or 10.0.0.256; [phone]"
    joined = "\n".join(lowered(r["text"]) for r in out.values())
    assert "ann@firm" not in joined and not re.search(rf"(?<!{LETTERS})grünwald(?!{LETTERS})", joined) and "grünwalder" in joined
    assert [r["text"] for i, r in sorted(out.items()) if texts[i] in (None, "")] == [None, ""]
    untouched = [i for i, t in enumerate(texts) if t and not any(base(t).values()) and "grünwald" not in lowered(t)]
    assert untouched and all(out[i]["text"] == texts[i] for i in untouched)
    forms = {r["term"]: r["form"] for r in own.forms().collect()}
    assert forms.keys() == {r["term"] for r in own.terms.collect()} and all(t.startswith(f[:-1]) and len(f) <= len(t) for t, f in forms.items())
    # many terms: nothing is sent to all executors
    monkeypatch.setattr("meridial.llm.sanitise.MAX_BROADCAST_TERMS", 0)
    far = Disclosures(docs)
    assert {tuple(r) for r in far.terms.collect()} == {tuple(r) for r in own.terms.collect()}
    assert {(r["doc_id"], r["spans"]) for r in find_private(docs, disclosures=far).collect()} == {(r["doc_id"], r["spans"]) for r in find_private(docs, disclosures=own).collect()}


def test_null_keys_repeats_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "me@x.org"), (None, "me@x.org"), (1, None), (1, "+1 (136) 555-7479")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["spans"]) for r in find_private(docs).collect()) == [(0, "email:0:8"), (0, "email:0:8"), (1, ""), (1, "phone:0:17")]
    assert find_private(docs.where("false")).count() == sanitise(docs.where("false")).count() == 0
    plan = find_private(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
