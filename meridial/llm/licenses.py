"""License scans: a positional index of rare words.

Templates are licence texts, notices and short phrases. The words of all templates
are weighted by their inverse document frequency over the whole corpus. The
index posts each template under its rarest words, those of its mandatory phrase
first, with their positions. In a file every word of the index proposes places
where a template may start (position in the file less position in the template);
a place where at least two posted words agree is a candidate. It counts if the
mandatory phrase stands there word by word, and if words of enough weight stand
where the template has them.

Two words of the mandatory phrase are posted always, so no place of it is lost.
All of it is DataFrame expressions within one row: the only shuffle counts
documents by template word, a table as small as the templates' vocabulary.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    """A licence text of some words, of which ``mandatory`` must stand as it is."""

    label: str
    text: str
    mandatory: str

    @property
    def words(self) -> list[str]:
        return re.findall(WORD, self.text.lower())

    @property
    def offset(self) -> int:
        """Where the mandatory phrase starts in the template."""
        phrase = self.mandatory.split()
        return next(i for i in range(len(self.words)) if self.words[i : i + len(phrase)] == phrase)


_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
    FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
    ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
    Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
    Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
    provided with the distribution."""
_GNU = """is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation,
    either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
    without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details."""

#: Licence texts as they are published (without names and years), and notices.
TEMPLATES = (
    Template("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the
        Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
        permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all
        copies or substantial portions of the Software. """ + _AS_IS, "hereby granted free of charge"),
    Template("bsd-2", _BSD, "source and binary forms"),
    Template("bsd-3", _BSD + """ Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
        without specific prior written permission.""", "endorse or promote products derived"),
    Template("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
        and this permission notice appear in all copies.""", "with or without fee is hereby granted"),
    Template("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of
        this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to
        the following restrictions""", "alter it and redistribute it freely"),
    Template("boost", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this
        license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software""", "execute and transmit the software"),
    Template("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
        License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under
        the License.""", "except in compliance with the license"),
    Template("gpl-2", _GNU.format("", "2"), "either version 2 of the license"),
    Template("gpl-3", _GNU.format("", "3"), "either version 3 of the license"),
    Template("lgpl", _GNU.format("Lesser ", "2.1"), "gnu lesser general public license"),
    Template("agpl", _GNU.format("Affero ", "3"), "gnu affero general public license"),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", "subject to the terms of the mozilla public license"),
    Template("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
        software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""", "unencumbered software released into the public domain"),
    Template("cc0", """To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This
        software is distributed without any warranty.""", "neighboring rights to this software"),
    Template("gpl-2", "gnu general public license version 2", "general public license version 2"),
    Template("gpl-3", "gnu general public license version 3", "general public license version 3"),
    Template("lgpl", "gnu lesser general public license", "lesser general public license"),
    Template("agpl", "gnu affero general public license", "affero general public license"),
    Template("apache-2", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("cc-by-nc", "licensed under cc by nc", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa", "cc by sa"),
    Template("cc-by-nd", "licensed under cc by nd", "cc by nd"),
    Template("cc0", "cc0 1 0 universal", "cc0 1 0"),
    Template("bsd", "licensed under the bsd license", "bsd license"),
    Template("isc", "licensed under the isc license", "isc license"),
    Template("mpl-2", "mozilla public license version 2 0", "mozilla public license"),
)


def lowered(text: Column) -> Column:
    """The text with A-Z (and no other letters) in lower case; null: empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def idf(docs: DataFrame, vocabulary: list[str], text: str = "text") -> dict[str, float]:
    """ln((N + 1) / (n + 1)) of each word, n of N documents having it."""
    words = F.array_intersect(F.split(lowered(F.col(text)), SEPARATORS), F.array(*map(F.lit, vocabulary)))
    counts = docs.select(F.explode_outer(F.concat(F.array(F.lit(" ")), words)).alias("word")).groupBy("word").count()
    # one row a vocabulary word at most; the blank counts all documents
    n = {r["word"]: r["count"] for r in counts.collect()}
    return {w: math.log((n.get(" ", 0) + 1) / (n.get(w, 0) + 1)) for w in vocabulary}


def posted(template: Template, weight: dict[str, float], most: int = 8) -> list[tuple[str, int]]:
    """The words under which a template stands in the index, with their positions.

    The two rarest of the mandatory phrase (both all the same if there are no
    more), then the rarest others, up to ``most`` and half of the template.
    """
    rarest = lambda x: (-weight[x[0]], x)
    words = list(enumerate(template.words))
    inside = sorted(((w, i) for i, w in words if template.offset <= i < template.offset + len(template.mandatory.split())), key=rarest)[:2]
    others = sorted(((w, i) for i, w in words if (w, i) not in inside), key=rarest)
    return inside + others[: max(0, min(most, len(words) // 2) - 2)]


def _strings(words: list[str]) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def scan_licenses(docs: DataFrame, *, key: str = "doc_id", text: str = "text", phrases: dict[str, str] = PHRASES, templates: tuple[Template, ...] = TEMPLATES, least: float = 0.6) -> DataFrame:
    """Licence phrases and labels of every whole text.

    Returns ``key, n_words, n_base, first_word, last_word, base_labels, labels,
    score``. ``n_base`` counts the places of all phrases, ``first_word`` and
    ``last_word`` are their least and largest starts (words from 0, null without
    any). A template adds its label where its mandatory phrase stands and words
    of ``least`` of its weight agree; ``score`` is the largest such share, 1 if a
    phrase stands, 0 without any. Null and empty texts have no words; a repeated
    row is scanned again.
    """
    known = [Template(label, p, p) for p, label in phrases.items()]
    every = [*known, *templates]
    weight = idf(docs, sorted({w for t in every for w in t.words}), text)
    index: dict[str, list[tuple[int, int]]] = {}
    anchors: set[str] = set()
    for i, t in enumerate(every):
        for w, at in posted(t, weight):
            index.setdefault(w, []).append((i, at))
        anchors.add(posted(t, weight)[0][0])
    # literals, which Spark folds: nothing of this is a join
    postings = F.expr("map(" + ", ".join(f"'{w}', array({', '.join(f'struct({i} AS t, {at} AS at)' for i, at in x)})" for w, x in index.items()) + ")")
    texts = F.expr(f"array({', '.join(_strings(t.words) for t in every)})")
    musts = F.expr(f"array({', '.join(_strings(t.mandatory.split()) for t in every)})")
    offsets = F.expr(f"array({', '.join(str(t.offset) for t in every)})")
    total = [sum(weight[w] for w in t.words) or 1.0 for t in every]
    shares = F.expr("array(" + ", ".join("array(" + ", ".join(f"{weight[w] / x!r}D" for w in t.words) + ")" for t, x in zip(every, total, strict=True)) + ")")
    labels = F.expr(_strings([t.label for t in every]))

    base = docs.select(F.col(key).cast("long").alias(key), F.filter(F.split(lowered(F.col(text)), SEPARATORS), lambda w: w != "").alias("words"))
    words = F.col("words")
    # (template, start) for every word of the index and each of its postings
    hits = F.filter(F.transform(words, lambda w, i: F.when(w.isin(list(index)), F.struct(w.alias("w"), i.alias("i")))), lambda x: x.isNotNull())
    proposed = F.flatten(F.transform(hits, lambda x: F.transform(F.element_at(postings, x["w"]), lambda p: F.struct(p["t"].alias("t"), (x["i"] - p["at"]).alias("start")))))
    none = F.expr("array()").cast("array<struct<t:int,start:int>>")
    # a file without the rarest word of any mandatory phrase is not looked up
    found = base.withColumn("places", F.when(F.exists(words, lambda w: w.isin(sorted(anchors))), F.array_sort(proposed)).otherwise(none))
    # two posted words agree where a place stands twice in the sorted list; a template of one word has one
    short = [i for i, t in enumerate(every) if len(t.words) == 1]
    agreed = lambda x, i: (x == F.get("places", i + 1)) | x["t"].isin(short) if short else x == F.get("places", i + 1)
    twice = F.array_distinct(F.filter(F.col("places"), agreed))
    first = lambda c: c["start"] + F.get(offsets, c["t"])
    stands = lambda c: (first(c) >= 0) & (F.slice(words, F.greatest(first(c) + 1, F.lit(1)), F.size(F.get(musts, c["t"]))) == F.get(musts, c["t"]))
    found = found.withColumn("places", F.filter(twice, stands))
    is_base = lambda c: c["t"] < len(known)
    # the added weight of the words that stand where the template has them
    agreement = lambda c: F.aggregate(F.sequence(F.lit(0), F.size(F.get(texts, c["t"])) - 1), F.lit(0.0), lambda sum_, j: sum_ + F.when(F.get(words, c["start"] + j) == F.get(F.get(texts, c["t"]), j), F.get(F.get(shares, c["t"]), j)).otherwise(F.lit(0.0)))
    found = found.withColumn("places", F.transform("places", lambda c: F.struct(c["t"].alias("t"), c["start"].alias("start"), F.when(is_base(c), F.lit(1.0)).otherwise(agreement(c)).alias("share"))))
    named = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda c: F.get(labels, c["t"])))), ",")
    starts = F.transform(F.filter("places", is_base), lambda c: c["start"])
    return found.select(
        key,
        F.size("words").cast("long").alias("n_words"),
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        named(F.filter("places", is_base)).alias("base_labels"),
        named(F.filter("places", lambda c: c["share"] >= least - 1e-9)).alias("labels"),
        F.least(F.lit(1.0), F.round(F.coalesce(F.array_max(F.transform("places", lambda c: c["share"])), F.lit(0.0)), 9)).alias("score"),
    )
