"""Licence scans: phrases that name a licence, and a positional index of each template's rarest words.

Base: every place where a phrase's words stand consecutively.  Method: templates
are usual notices and the passages of whole licence texts (``license_texts``);
one scan counts in how many of the files each of their words occurs, and each
template is indexed, with positions, by its words of highest IDF, never by those
that many files hold.  In a file each indexed word votes for (template, its
position minus the posting's); votes that agree on one shift mean that the words
stand as in the template.  A template with enough votes on a shift is reported if
its mandatory key phrase stands in the file.  The score is the best share of
votes among reported templates; a base phrase alone counts as PHRASE.

Both scans are made of built-in functions; the first shuffles counts of template
words only (a few thousand, which is what reaches the driver), the second
nothing.  A substring test (at memory speed) for a few stems, one of which is in
every phrase, keeps the word arrays of the second to the texts that can have a
hit; since a mandatory phrase is needed for any label, that test loses nothing.
Work within a text is O(n log n) in its words.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import ascii_lower, fresh, let, table

#: The base phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Usual notices by label, whatever stands around them; each is its own key phrase.
NOTICES = {
    "apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache license v2 0", "apache license v 2 0", "apache license v2", "apache 2 0", "apache software license 2 0", "apache software license version 2 0", "apache version 2 0"),
    "cc-by-nc": ("cc by nc", "creative commons attribution noncommercial", "creative commons attribution non commercial", "attribution noncommercial 4 0"),
    "cc-by-sa": ("cc by sa", "cc by nc sa", "creative commons attribution sharealike", "creative commons attribution share alike", "attribution sharealike 4 0"),
    "cc-by-nd": ("cc by nd", "cc by nc nd", "creative commons attribution noderivatives", "creative commons attribution noderivs", "creative commons attribution no derivatives"),
    "gpl-3.0": ("gnu general public license version 3", "gnu general public license v3", "gnu general public license v 3", "gnu general public license 3 0", "version 3 of the gnu general public license", "gnu gpl version 3", "gnu gpl v3", "gpl version 3", "gpl v3", "gplv3", "gpl 3 0", "gnu general public license as published by the free software foundation either version 3", "gnu general public license as published by the free software foundation version 3"),
    "gpl-2.0": ("gnu general public license version 2", "gnu general public license v2", "gnu general public license v 2", "gnu general public license 2 0", "version 2 of the gnu general public license", "gnu gpl version 2", "gnu gpl v2", "gpl version 2", "gpl v2", "gplv2", "gpl 2 0", "gnu general public license as published by the free software foundation either version 2", "gnu general public license as published by the free software foundation version 2"),
    "lgpl": ("gnu lesser general public license version", "gnu lesser general public license v2 1", "gnu lesser general public license v3", "under the gnu lesser general public license", "terms of the gnu lesser general public license", "under the gnu library general public license", "terms of the gnu library general public license", "lgpl version", "lgplv2", "lgplv2 1", "lgplv3", "lgpl v3", "lgpl 2 1", "lgpl 3 0", "under the lgpl", "lgpl license"),
    "agpl-3.0": ("gnu affero general public license version 3", "gnu affero general public license v3", "terms of the gnu affero general public license", "under the gnu affero general public license", "agplv3", "agpl v3", "agpl 3 0"),
    "mpl-2.0": ("mozilla public license version 2 0", "mozilla public license v 2 0", "mozilla public license v2 0", "mozilla public license 2 0", "mpl 2 0", "mpl v2", "mplv2"),
    "mit-text": ("permission is hereby granted free of charge to any person obtaining a copy",),
    "mit-release": ("under the mit license", "under the terms of the mit license", "under an mit license", "under mit license", "mit licensed", "spdx license identifier mit"),
    "bsd": ("redistribution and use in source and binary forms", "bsd 3 clause", "bsd 2 clause", "3 clause bsd", "2 clause bsd", "new bsd license", "under the bsd license", "under a bsd style license"),
    "isc": ("under the isc license", "isc license isc", "spdx license identifier isc"),
    "rights-reserved": ("all rights reserved",),
}
#: The files of whole licence texts by label; CC BY-NC and BY-ND have notices alone.
TEXTS = {"apache-2.0": ("apache-2.0",), "bsd": ("bsd-2", "bsd-3"), "cc-by-sa": ("cc-by-sa",), "gpl-2.0": ("gpl-2.0",), "gpl-3.0": ("gpl-3.0",), "isc": ("isc",), "lgpl": ("lgpl-2.1", "lgpl-3.0"), "mit-text": ("mit",), "mpl-2.0": ("mpl-2.0",)}
#: Words of a passage, and words of its key phrase.
PASSAGE, KEY = 60, 5
#: Words in more than this share of the files are not indexed; what a base phrase alone scores.
COMMON, PHRASE = 0.1, 0.5
#: Stems for the substring test.
STEMS = ("licens", "copy", "warrant", "distribut", "software", "rights", "library", "program", "modif", "gpl", "cc by", "creative", "clause bsd")
#: Rare words a template is indexed by, and the share of them that must agree on a shift.
RARE, SHARE = 6, 0.6


def _key(w: list[str], idf: dict[str, float], elsewhere: set[tuple]) -> str | None:
    """The rarest KEY words in a row that no other label's text has, those with a stem first; none if all are shared."""
    runs = [w[i : i + KEY] for i in range(len(w) - KEY + 1)]
    stem = lambda r: any(x in " ".join(r) for x in STEMS)
    return max(((stem(r), sum(idf[x] for x in r), " ".join(r)) for r in runs if tuple(r) not in elsewhere), default=(0, 0, None))[2]


@cache
def full_templates() -> tuple[tuple[str, str, str], ...]:
    """(label, key phrase, words) of the notices and of each passage of the licence texts that is its label's own."""
    out = [(label, n, n) for label, ns in NOTICES.items() for n in ns]
    words = {(label, f): re.findall("[a-z0-9]+", (Path(__file__).parent / "license_texts" / f"{f}.txt").read_text("utf-8").lower()) for label, fs in TEXTS.items() for f in fs}
    runs = {at: {tuple(w[i : i + KEY]) for i in range(len(w) - KEY + 1)} for at, w in words.items()}
    passages = [(at, w[i : i + PASSAGE]) for at, w in words.items() for i in range(0, len(w), PASSAGE)]
    df = Counter(x for _, p in passages for x in set(p))
    idf = {x: math.log(len(passages) / n) for x, n in df.items()}
    for (label, _), p in passages:
        if key := _key(p, idf, set().union(*(r for at, r in runs.items() if at[0] != label))):
            out.append((label, key, " ".join(p)))
    return tuple(out)


def index(templates, df: dict[str, int], n_docs: int, rare: int = RARE, common: float = COMMON) -> tuple[dict[str, list[tuple[int, int]]], list[int]]:
    """word -> [(template, position)] for each template's words of highest IDF (ties: alphabetical), and their number by template.

    df says how many of n_docs files hold a word.  Words in more than a share
    common of the files are left out, unless a template has no others.
    """
    postings: dict[str, list[tuple[int, int]]] = {}
    sizes = []
    for k, t in enumerate(x.split() for _, _, x in templates):
        own = {w for w in t if df.get(w, 0) <= common * n_docs} or set(t)
        chosen = set(sorted(own, key=lambda w: (df.get(w, 0), w))[:rare])
        places = [(w, i) for i, w in enumerate(t) if w in chosen]
        sizes.append(len(places))
        for w, i in places:
            postings.setdefault(w, []).append((k, i))
    return postings, sizes


def frequencies(docs: DataFrame, text: str = "text", templates=None) -> tuple[dict[str, int], int]:
    """In how many files each word of the templates occurs, and the number of files."""
    templates = full_templates() if templates is None else templates
    known = sorted({w for _, _, t in templates for w in t.split()})
    words = F.split(ascii_lower(_spaced(F.coalesce(F.col(text), F.lit("")))), " ")
    own = F.array_distinct(F.filter(words, lambda w: w.isin(known)))
    # The empty word stands for the file itself.
    rows = docs.select(F.explode(F.concat(F.array(F.lit("")), own)).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    df = {r["word"]: r["n"] for r in rows}
    return df, df.pop("", 0)


def _spaced(text: Column) -> Column:
    """The words with single spaces between them, in their own case."""
    return F.trim(F.regexp_replace(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "))


def _places(w: Column, phrases) -> Column:
    """Where each phrase's words stand consecutively: array of (pos, label)."""
    found = []
    for phrase, label in phrases:
        p = phrase.split()
        first = F.filter(F.transform(w, lambda x, i: F.when(x == p[0], i)), lambda i: i.isNotNull())  # noqa: B023
        whole = lambda i: _all([F.coalesce(F.get(w, i + k) == x, F.lit(False)) for k, x in enumerate(p)])  # noqa: E731, B023
        found.append(F.transform(F.filter(first, whole), lambda i: F.struct(i.alias("pos"), F.lit(label).alias("label"))))  # noqa: B023
    return F.concat(*found)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _votes(w: Column, postings) -> Column:
    """Sorted array of (template, shift), one for each posting of each indexed word in the text."""
    entries = json.dumps({word: [{"t": k, "i": i} for k, i in ps] for word, ps in sorted(postings.items())})
    table_ = F.from_json(F.lit(entries), "map<string,array<struct<t:int,i:int>>>")
    hits = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))), lambda x: x["w"].isin(sorted(postings)))
    return F.sort_array(F.flatten(F.transform(hits, lambda x: F.transform(F.element_at(table_, x["w"]), lambda p: F.struct(p["t"].alias("t"), (x["i"] - p["i"]).alias("shift"))))))


def scan(docs: DataFrame, text: str = "text", phrases=PHRASES, templates=None, share: float = SHARE) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels, labels and score to docs.

    templates are (label, key phrase, words); full_templates() if not given.
    Their words' IDF is taken from docs.  An empty table gives an empty result.
    Null text counts as empty: no words, no labels (empty strings), score 0.
    first_word and last_word are null without a base hit.  Repeated rows get the
    same result each; columns of docs named like a result are replaced.
    """
    templates = full_templates() if templates is None else templates
    postings, sizes = index(templates, *frequencies(docs, text, templates))
    phrases_ = {p for p, _ in phrases} | {k for _, k, _ in templates}
    shorter = {k for k in phrases_ if not any(x in k for x in STEMS)}
    keys = sorted({k for k in shorter if not any(x != k and x in k for x in shorter)} | {x for x in STEMS if any(x in k for k in phrases_)})
    spaced, found_ = fresh(docs, "spaced", "found")
    d = docs.withColumn(spaced, _spaced(F.coalesce(F.col(text), F.lit(""))))
    low = F.lower(spaced)
    maybe = low.contains(keys[0])
    for k in keys[1:]:
        maybe = maybe | low.contains(k)
    words = F.when(maybe, F.split(ascii_lower(F.col(spaced)), " "))
    need = [math.ceil(share * s) for s in sizes]

    def named(w: Column) -> Column:
        padded = F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))

        def best(v: Column) -> Column:
            """The largest share of a template's words that agree on a shift; votes are sorted."""
            return F.least(F.lit(1.0), F.aggregate(
                v,
                F.struct(F.lit(-1).alias("t"), F.lit(0).alias("shift"), F.lit(0).alias("n"), F.lit(0.0).alias("best")),
                lambda a, x: let(
                    F.when((a["t"] == x["t"]) & (a["shift"] == x["shift"]), a["n"] + 1).otherwise(1),
                    lambda n: F.struct(x["t"].alias("t"), x["shift"].alias("shift"), n.alias("n"), F.greatest(a["best"], n / F.element_at(F.array(*map(F.lit, sizes)), x["t"] + 1)).alias("best")),
                ),
                lambda a: a["best"],
            ))

        def templates_in(pair: Column) -> Column:
            v, whole = pair["votes"], pair["whole"]
            enough = F.filter(v, lambda x, k: F.coalesce(F.get(v, k + F.element_at(F.array(*map(F.lit, need)), x["t"] + 1) - 1) == x, F.lit(False)))
            labels = F.array(*[F.lit(t[0]) for t in templates])
            phrase = F.array(*[F.lit(f" {t[1]} ") for t in templates])
            ok = F.filter(F.array_distinct(F.transform(enough, lambda x: x["t"])), lambda t: F.contains(whole, F.element_at(phrase, t + 1)))
            return let(ok, lambda ts: F.struct(F.transform(ts, lambda t: F.element_at(labels, t + 1)).alias("labels"), best(F.filter(v, lambda x: F.array_contains(ts, x["t"]))).alias("best")))

        return let(F.struct(_votes(w, postings).alias("votes"), padded.alias("whole")), templates_in)

    d = d.withColumn(found_, F.when(maybe, let(words, lambda w: F.struct(_places(w, phrases).alias("places"), named(w).alias("named")))))
    place, named_ = F.col(found_)["places"], F.col(found_)["named"]["labels"]
    base = F.coalesce(F.transform(place, lambda x: x["label"]), F.array().cast("array<string>"))
    joined = lambda a: F.array_join(F.sort_array(F.array_distinct(a)), ",")
    d = d.withColumns({
        "n_words": F.when(F.col(spaced) == "", 0).otherwise(F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit(""))) + 1).cast("long"),
        "n_base": F.size(base).cast("long"),
        "first_word": F.array_min(F.transform(place, lambda x: x["pos"])).cast("long"),
        "last_word": F.array_max(F.transform(place, lambda x: x["pos"])).cast("long"),
        "base_labels": joined(base),
        "labels": joined(F.concat(base, F.coalesce(named_, F.array().cast("array<string>")))),
        "score": F.round(F.greatest(F.when(F.size(base) > 0, PHRASE).otherwise(0.0), F.coalesce(F.col(found_)["named"]["best"], F.lit(0.0))), 6),
    })
    return d.drop(spaced, found_)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def _sql() -> str:
    p = ", ".join(f"('{x}', '{label}', {len(x.split())})" for x, label in PHRASES)
    t = ", ".join(f"({k}, '{label}', '{key}', '{words}')" for k, (label, key, words) in enumerate(full_templates()))
    return rf"""
WITH p(phrase, label, k) AS (VALUES {p}), t(t, label, key, words) AS (VALUES {t}),
tw AS (SELECT t, unnest(string_split(words, ' ')) AS w, unnest(range(len(string_split(words, ' ')))) AS i FROM t),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
u AS (SELECT doc_id, ws, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d),
df AS (SELECT w, count(DISTINCT doc_id) AS n FROM u WHERE w IN (SELECT w FROM tw) GROUP BY 1),
own AS (SELECT DISTINCT t, w, coalesce(n, 0) AS n, coalesce(n, 0) <= {COMMON}::DOUBLE * (SELECT count(*) FROM documents) AS rare FROM tw LEFT JOIN df USING (w)),
cand AS (SELECT * FROM (SELECT *, bool_or(rare) OVER (PARTITION BY t) AS any_rare FROM own) WHERE rare OR NOT any_rare),
pick AS (SELECT t, w FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY n, w) AS r FROM cand) WHERE r <= {RARE}),
x AS (SELECT t, w, i FROM tw JOIN pick USING (t, w)),
size AS (SELECT t, count(*) AS size, ceil({SHARE}::DOUBLE * count(*)) AS need FROM x GROUP BY 1),
b AS (SELECT doc_id, i, label FROM u JOIN p ON w = string_split(phrase, ' ')[1] AND array_to_string(ws[i + 1:i + k], ' ') = phrase),
bb AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM b GROUP BY 1),
vote AS (SELECT doc_id, t, u.i - x.i AS shift, count(*) AS n FROM u JOIN x USING (w) GROUP BY ALL),
m AS (SELECT doc_id, label, max(least(1.0::DOUBLE, n / size)) AS best FROM (SELECT doc_id, t, max(n) AS n FROM vote GROUP BY ALL) JOIN size USING (t) JOIN t USING (t) JOIN d USING (doc_id)
      WHERE n >= need AND contains(' ' || array_to_string(ws, ' ') || ' ', ' ' || key || ' ') GROUP BY ALL),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY 1),
a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM b UNION SELECT doc_id, label FROM m) GROUP BY 1),
best AS (SELECT doc_id, max(best) AS best FROM m GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       round(greatest(CASE WHEN n_base > 0 THEN {PHRASE}::DOUBLE ELSE 0 END, coalesce(best, 0)), 6)::DOUBLE AS score
FROM d LEFT JOIN bb USING (doc_id) LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN a ON a.doc_id = d.doc_id LEFT JOIN best ON best.doc_id = d.doc_id
"""


OP10_SQL = _sql()
