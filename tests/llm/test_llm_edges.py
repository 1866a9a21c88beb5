"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for each operator."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import bpe, chat, dedup, fingerprint, licenses, minhash, packing, quality, sharding, toxicity, urlfilter

P = pytest.importorskip("public_tokenizers")
LONG = "word " * 30_000 + "Permission is hereby granted. Licensed under the Apache License, Version 2.0."
SCHEMA = "doc_id long, text string, n_words string, score string, ids string"
ROWS = [(1, "a b c d e f", "x", "x", "x"), (1, "a b c d e f", "x", "x", "x"), (2, None, "x", "x", "x"), (3, "", "x", "x", "x"), (4, LONG, "x", "x", "x"), (5, " \n\t ", "x", "x", "x"), (None, "ünï \U0001f600 MIT LICENSE", "x", "x", "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_quality(docs, none):
    r = by_id(quality.judge(docs))
    assert quality.judge(docs).count() == len(ROWS) and quality.judge(none).count() == 0
    assert r[2]["n_words"] == r[3]["n_words"] == r[5]["n_words"] == 0 and not r[2]["kept"]
    assert r[4]["n_repeat_words"] == 30_000 and r[4]["base_failed"]
    assert r[1]["word_chars"] == 6


def test_repeat_words(spark):
    random.seed(2)
    texts = [" ".join(random.choice("abc") for _ in range(random.randrange(30))) for _ in range(60)]

    def count(t):
        w = t.split()
        win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        return len({p for i, x in enumerate(win) if win.count(x) > 1 for p in (i, i + 1, i + 2)})

    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert [r["n_repeat_words"] for r in quality.judge(d).orderBy("doc_id").collect()] == [count(t) for t in texts]


def test_repeat_words_of_very_long_texts(spark, monkeypatch):
    """Texts of more words than a place has bits for take the other sort: the same counts."""
    random.seed(12)
    d = spark.createDataFrame([(k, " ".join(random.choice("abcd") for _ in range(random.randrange(40)))) for k in range(60)], "doc_id long, text string")
    before = [r["n_repeat_words"] for r in quality.judge(d).orderBy("doc_id").collect()]
    monkeypatch.setattr(quality, "PLACE_BITS", 3)
    assert [r["n_repeat_words"] for r in quality.judge(d).orderBy("doc_id").collect()] == before and max(before) > 8


def test_each_rule_rejects(spark):
    """Texts that the base accepts and one rule rejects; columns of the caller's with inner names stay."""
    w = [f"the word{k} of" for k in range(60)]
    line = "one line of the text that is said again and again by the author of it"
    texts = {
        "fine": " ".join(w), "long": " ".join("the" if k % 9 == 0 else f"{k}" + "x" * 30 for k in range(90)), "symbols": " ".join(f"{x} #{k}$" for k, x in enumerate(w)), "stops": " ".join(f"word{k}" for k in range(90)),
        "bullets": "\n".join(f"- {x}{k}" for k, x in enumerate(w)), "ellipsis": "\n".join(f"{x}..." for x in w),
    }
    d = spark.createDataFrame([(k, t, "mine", "mine") for k, t in texts.items()], "doc_id string, text string, words string, _lines string")
    r = {x["doc_id"]: x for x in quality.judge(d).collect()}
    assert not any(x["base_failed"] for x in r.values()) and [k for k in texts if r[k]["kept"]] == ["fine"]
    assert all(x["words"] == x["_lines"] == "mine" for x in r.values())
    short = spark.createDataFrame([(1, "\n".join([line] * 3 + [f"and the {k}" for k in range(30)]))], "doc_id long, text string")
    assert quality.measured(short).first()["dup_line_chars"] == 2 * len(line)


def test_licenses(docs, none):
    r = by_id(licenses.scan(docs))
    assert licenses.scan(docs).count() == len(ROWS) and licenses.scan(none).count() == 0
    assert r[2]["n_words"] == 0 and r[2]["labels"] == "" and r[2]["first_word"] is None and r[2]["score"] == 0
    assert r[4]["labels"] == "apache,apache-2.0" and r[4]["first_word"] == 30_007 and r[4]["n_base"] == 1
    assert r[None]["n_base"] == 1 and r[None]["n_words"] == 4 and r[None]["base_labels"] == "mit"


def test_urls(spark):
    urls = ["http://WWW.Example.com/en/1?x", "https://a.example.com/en/2", "http://example.com", "x.net/es/", None, "http://shop.net/es/a#b", "ftp://com/x", "http://h.co.uk/p\nq"]
    pages = spark.createDataFrame([(k, u, "mine") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(pages, pages.sparkSession.createDataFrame([], "host string, good long")).orderBy("page_id").collect()]
    assert got[:7] == [("www.example.com", "/en/1", "www.example.com/en/", "allow"), ("a.example.com", "/en/2", "example.com/en/", "block"), ("example.com", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("shop.net", "/es/a", "net/es/", "block"), ("com", "/x", "com/", "allow")]
    assert got[7][:2] == ("h.co.uk", "/p\nq")


def test_urls_with_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", "p", "q", "r")], "page_id long, url string, m_host string, suffix string, domain string")
    none = spark.createDataFrame([], "host string, good long")
    r = urlfilter.judge(pages, none).first()
    assert (r["m_host"], r["suffix"], r["domain"], r["host"]) == ("p", "q", "r", "a.org")
    assert urlfilter.judge(pages.where("false"), none).collect() == []


def test_beta_quantile(spark):
    """Against the distribution function, summed up numerically."""
    x = (np.arange(200_000) + 0.5) / 200_000
    for mean, weight in ((0.75, 12.0), (0.5, 4.0), (0.9, 220.0), (0.2, 40.0), (0.98, 300.0)):
        d = x ** (mean * weight - 1) * (1 - x) ** ((1 - mean) * weight - 1)
        want = x[np.searchsorted(np.cumsum(d) / d.sum(), 0.8)]
        got = spark.range(1).select(urlfilter.beta_upper(F.lit(mean), F.lit(weight), 0.8416)).first()[0]
        assert abs(got - want) < 0.012, (mean, weight)


def test_reputation_decides(spark):
    """On given tables some hosts without a rule are blocked, and their labelled pages are worse than the others'."""
    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    outcomes = urlfilter.labelled(pages, spark.read.parquet(f"{sf}/labels.parquet"))
    r = urlfilter.judge(pages, outcomes).where("rule IS NULL").toPandas()
    seen = outcomes.toPandas()
    blocked = set(r.host[r.verdict == "block"])
    assert blocked and (r.verdict == "allow").any()
    assert seen.good[seen.host.isin(blocked)].mean() < seen.good.mean() - 0.1


def test_reputation_blocks_bad_hosts(spark):
    pages = spark.createDataFrame([(1, "http://bad.org/x"), (2, "http://new.bad.org/x"), (3, "http://fine.org/x")], "page_id long, url string")
    seen = spark.createDataFrame([("bad.org", 0)] * 40 + [("fine.org", 1)] * 40 + [(f"h{k}.org", 1) for k in range(20)], "host string, good long")
    r = {x["page_id"]: x["verdict"] for x in urlfilter.judge(pages, seen).collect()}
    assert r == {1: "block", 2: "block", 3: "allow"}


def test_fingerprints(spark, docs, none):
    assert fingerprint.digests(docs).count() == len(ROWS)
    r = fingerprint.edited_by_next(docs).collect()
    assert len(r) == len(ROWS) and fingerprint.edited_by_next(none).count() == 0
    alone = fingerprint.edited_by_next(docs.where("doc_id = 4")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0
    d = fingerprint.Digest("some text here".encode())
    again = fingerprint.parsed(d.text())
    assert again.text() == d.text() and fingerprint.likeness(d, again) == 1.0


def test_bpe(docs, none):
    path = P.path("byte_bpe_50k.tiktoken")
    r = bpe.encode(docs, path, P.PATTERN, decoded=True).collect()
    assert sorted(bytes(x["decoded"]) for x in r) == sorted((t or "").encode() for _, t, *_ in ROWS)
    assert bpe.encode(none, path, P.PATTERN).count() == 0
    again = bpe.decode(bpe.encode(docs, path, P.PATTERN), path, P.PATTERN).collect()
    assert sorted(bytes(x["decoded"]) for x in again) == sorted((t or "").encode() for _, t, *_ in ROWS)


def test_bpe_as_the_library():
    """Random runs of spaces, line ends, Unicode white space, marks and apostrophes; a long text; another pattern."""
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    other = r"\p{L}+|\s|[^\p{L}\s]+"
    random.seed(8)
    parts = [" ", " ", " ", "  ", "\n", "\t", "\x1e", "\x1c", "\u00a0", "\u2028", "\u3000", "a", "b", "word", "'s", "'ll", "1", "22", "!", "\u00e9", "e\u0301", "\U0001f600", "\x00"]
    texts = ["".join(random.choice(parts) for _ in range(random.randrange(30))) for _ in range(3000)]
    for pattern, some in ((bpe.PATTERN, [*texts, "a b  c\n" * 700_000]), (other, texts[:300])):
        e = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        own = bpe.codec(path, pattern)
        for t, ids in zip(some[:3000], own.ids_of(bpe.pa.array(some[:3000])), strict=True):
            assert ids.tolist() == e.encode_ordinary(t), t
            assert own.decode(ids) == t.encode()
        assert own.encode(some[-1]) == np.array(e.encode_ordinary(some[-1]), "<u4").tobytes()


def test_bpe_needs_all_bytes():
    with pytest.raises(ValueError):
        bpe.serialised({b"a": 0, b"b": 1})


def test_dedup(spark, docs, none):
    r = dedup.near_duplicates(docs).collect()
    assert len(r) == len(ROWS) and dedup.near_duplicates(none).count() == 0
    got = {x["doc_id"]: x for x in r}
    assert got[1]["n_shingles"] == 2 and got[1]["component_id"] == 1 and got[2]["n_shingles"] == 0 and got[2]["kept"]
    assert got[None]["component_id"] is None and got[None]["kept"]


def test_dedup_chain_and_short_texts(spark):
    """A chain of near copies is one component though its ends differ; short texts compare as wholes."""
    base = [f"w{k}" for k in range(100)]
    texts = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :] if k else base) for k in range(0, 60, 6)]
    chain = [base[:]]
    for k in range(5):
        nxt = chain[-1][:]
        nxt[k * 18] = f"y{k}"
        chain.append(nxt)
    rows = [(k, t) for k, t in enumerate(texts + [" ".join(c) for c in chain] + ["A b", "a B", "a b c"])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in dedup.near_duplicates(d).collect()}
    assert {got[k] for k in range(16)} == {0} and got[16] == got[17] == 16 and got[18] == 18


def test_components(spark):
    path = [(k, k + 1) for k in range(200)]
    e = spark.createDataFrame(path + [(500, 400), (400, 450), (9, 9)], "src long, dst long")
    got = {r["node"]: r["component"] for r in dedup.components(e).collect()}
    assert all(got[k] == 0 for k in range(201)) and got[450] == got[500] == got[400] == 400


def test_forest():
    random.seed(3)
    for _ in range(20):
        base = [random.randrange(60) for _ in range(30)]
        sets = []
        for _ in range(random.randrange(2, 30)):
            x = set(base) if random.random() < 0.5 else {random.randrange(200) for _ in range(30)}
            x |= {random.randrange(100) for _ in range(random.randrange(8))}
            sets.append(np.array(sorted(x), np.uint64))

        def roots(edges, n):
            at = list(range(n))

            def find(x):
                while at[x] != x:
                    x = at[x]
                return x

            for i, j in edges:
                a, b = sorted((find(i), find(j)))
                at[b] = a
            return [find(i) for i in range(n)]

        pairs = [(i, j) for i in range(len(sets)) for j in range(i) if minhash.similar(sets[i], sets[j])]
        assert roots(pairs, len(sets)) == roots(dedup.forest(sets), len(sets))


def test_packing(spark, docs, none):
    path = P.path("word_bpe_49k.json")
    r = packing.pack(docs, path).collect()
    assert sum(x["length"] for x in r if x["start"] == 0 and x["doc_tokens"] == 1) == 3 and packing.pack(none, path).count() == 0
    assert sum(x["length"] for x in r if x["doc_id"] == 4) == next(x["doc_tokens"] for x in r if x["doc_id"] == 4)


def test_column_generation_fills_sequences():
    random.seed(1)
    histogram = {x: 1 + random.randrange(4000) * 64 // (x + 64) for x in [*range(1, 64), *range(64, 4096, 64), 4096]}
    plan = packing.solve(histogram)
    used, held = {}, 0
    for pattern, times in plan:
        assert sum(k * v for k, v in pattern.items()) <= 4096
        held += times
        for k, v in pattern.items():
            used[k] = used.get(k, 0) + v * times
    total = sum(k * v for k, v in histogram.items())
    assert used == histogram and held * 4096 / total < 1.004


def test_plans_cut_only_what_gaps_need():
    """Whole documents where they fit well; where they can't (all just over half a sequence), cut ones fill the gaps."""
    random.seed(6)
    easy = {n: 1 + random.randrange(120_000) // (n + 300) for n in range(1, 4097, 3)}
    hard = {n: 50 for n in range(2049, 2149)}
    short = {n: 900 for n in range(1, 30)}
    for histogram, least, most in ((easy, 0.0, 0.0), (hard, 1.0, 1.0), (short, 0.0, 0.0)):
        p = packing.plan(histogram)
        total, pieces = sum(n * k for n, k in histogram.items()), sum(histogram.values())
        assert p.sequences * 4096 <= total * 1.012 + 4096
        assert least <= sum(p.cut.tolist()) / pieces <= most


def test_tokens_as_the_library():
    from tokenizers import Tokenizer

    t, own = Tokenizer.from_file(P.path("word_bpe_49k.json")), packing.Tokens(P.path("word_bpe_49k.json"))
    for text in ["Don't STOP, now... 3.14!", "É.é, İ. é.", "a b　c d", "<|endoftext|>. x <|startoftext|>,", "", "  ", "word.,;", "K.", "don't'll 'S.", "<|STARTOFTEXT|> a.", "x.\v\fy,\r\nz", "a\u0301. e\u0301, \u00a0b", "word, " * 900_000, "#" * (packing.TOGETHER + 5) + " a."]:
        assert own.ids(text) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_other_vocabularies_see_whole_texts(tmp_path):
    """A vocabulary with another normaliser is given each text uncut."""
    import json

    from tokenizers import Tokenizer

    with open(P.path("word_bpe_49k.json")) as f:
        spec = json.load(f)
    spec["normalizer"]["normalizers"].pop(1)
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    t, own = Tokenizer.from_file(str(path)), packing.Tokens(str(path))
    assert not own.cuttable
    for text in ["A b, c", "", "x. <|endoftext|>"]:
        assert own.ids(text) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    train = spark.createDataFrame([(k, "you awful idiot go " * 2 + "the plain words" if k % 2 else "the plain words stand here") for k in range(40)], "doc_id long, text string")
    m = toxicity.fit(train, labels)
    r = toxicity.passages(docs, m, keep=("doc_id", "score")).collect()
    assert len(r) == len(ROWS) and toxicity.passages(none, m).count() == 0 and all(0 <= x["score"] <= 1 for x in r)
    assert toxicity.fit(train, labels.where("toxic = 0")).beta[0] < 0
    assert toxicity.fit(none.select("doc_id", "text"), labels).weights == {}


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, window string"
    rows = [(1, 0, "system", "be good", "x"), (1, 1, "user", None, "x"), (1, 2, None, "hm", "x"), (1, 3, "assistant", "yes </turn> ### \\", "x"), (1, 3, "assistant", "yes </turn> ### \\", "x"), (None, None, "user", "q", "x"), (None, None, "user", "q", "x"), (None, 1, "assistant", "b " * 40, "x"), (2, 0, "assistant", "word " * 5000, "x")]
    c = spark.createDataFrame(rows, schema)
    path = P.path("byte_bpe_50k.tiktoken")
    w = chat.format_windows(c, path, chat.Budget(20, 8))
    rows = chat.read_back(w).collect()
    r = {x["conv_id"]: x for x in rows}
    assert r[1]["n_turns"] == 5 and r[1]["loss_chars"] == 2 * len("yes </turn> ### \\") and r[2]["loss_chars"] == 25_000
    assert [x["n_turns"] for x in rows if x["conv_id"] is None] == [1, 1, 1]
    assert chat.format_windows(c.where("false"), path).count() == 0


@pytest.mark.parametrize("budget", [chat.Budget(16, 0), chat.Budget(30, 14), chat.Budget(60, 25)])
def test_windows_round_trip(budget):
    random.seed(4)
    codec = bpe.codec(P.path("byte_bpe_50k.tiktoken"), bpe.PATTERN)
    charge = lambda role, text: chat.charges(bpe.pa.array([role]), bpe.pa.array([text]), codec)[0]
    parts = ["\\", "#", "### ", "</turn>", "</", "<", "/", "\n", ": ", "a", "word here", "assistant"]
    for _ in range(400):
        turns = [(random.choice(["user", "assistant", "system", "", " a: b\n", "#:\\"]), "".join(random.choice(parts) for _ in range(random.randrange(12)))) for _ in range(random.randrange(1, 9))]
        got, loss = [], []
        for text, spans, repeated, new in chat.windows_of(((r, t, charge(r, t)) for r, t in turns), budget):
            p = list(chat.parse(text))
            assert len(p) == repeated + new == text.count("</turn>")
            assert sum(charge(*y) for y in p) <= budget.window or new == 1
            held = p[1 if turns[0][0] == "system" and got else 0 : repeated]
            assert sum(charge(*y) for y in held) <= budget.history and held == (got[-len(held) :] if held else [])
            got += p[repeated:]
            loss += [chat.unescaped(text[a:b]) for a, b in spans]
            if turns[0][0] == "system":
                assert p[0] == turns[0]
        assert got == turns and loss == [t for r, t in turns if r == "assistant"]


def test_sharding(spark, docs, none, tmp_path):
    store = sharding.Store(spark, f"file://{tmp_path}/store", sharding.Policy(target=1 << 20, fanout=3))
    assert store.version() == 0 and store.manifest() == []
    for k in range(7):
        store.append(docs.withColumn("lot", F.lit(k)))
        store.compact()
    assert store.read().count() == 7 * len(ROWS) and max(len(v) for v in store.tiers(store.manifest()).values()) < 3
    assert store.read(1).count() == len(ROWS)
    with pytest.raises(RuntimeError):
        store.commit(store.version() - 1, [])
    before = store.version()
    store.vacuum()
    assert store.read().count() == 7 * len(ROWS) and store.version() == before


def test_licenses_in_other_words(spark):
    """Wordings that stand in no given document, whole texts without their headings, and words that only resemble a notice."""
    said = {
        "Licensed under the GNU General Public License version 3.": {"gpl", "gpl-3.0"},
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or later": {"gpl", "gpl-3.0"},
        "Distributed under GPLv2, see COPYING": {"gpl-2.0"},
        "You may use this under version 2.0 of the Apache License or not": {"apache"},
        "SPDX-License-Identifier: Apache-2.0": {"apache-2.0"},
        "This Source Code Form is subject to the Mozilla Public License 2.0": {"mpl-2.0"},
        "This library comes under the terms of the GNU Lesser General Public License, version 3": {"lgpl"},
        "Creative Commons Attribution-NonCommercial 4.0 International": {"cc-by-nc"},
        "The code is MIT licensed": {"mit-release"},
        "BSD 3-Clause": {"bsd"},
        "this work is general and gnu 3": set(),
        "the terms of a public license are subject to v 2 0": set(),
    }
    for label, names in licenses.TEXTS.items():
        for name in names:
            text = (licenses.Path(licenses.__file__).parent / "license_texts" / f"{name}.txt").read_text().split()
            said[" ".join(text[len(text) // 2 :])] = {label}
    r = licenses.scan(spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")).orderBy("doc_id").collect()
    for row, (text, want) in zip(r, said.items(), strict=True):
        got = set(row["labels"].split(",")) - {""}
        if len(text) > 400:
            assert want <= got, text[:80]
        else:
            assert got == want, text


def test_license_scores_and_inner_names(spark):
    """A whole text scores more than a torn one, a phrase alone least; votes without the key phrase count nothing; a caller's columns stay."""
    text = (licenses.Path(licenses.__file__).parent / "license_texts" / "gpl-3.0.txt").read_text().split()
    torn = " ".join(w for k, w in enumerate(text[:400]) if k % 9)
    every = licenses.full_templates()
    label, key, passage = next(t for t in every if t[0] == "mpl-2.0" and len(t[2].split()) > 40 and sum(k in t[2] for _, k, _ in every) == 1)
    said = [" ".join(text[:400]), torn, "as in the GNU General Public License it says", passage.replace(key, "x y z v w"), ""]
    d = spark.createDataFrame([(k, t, "mine", "mine") for k, t in enumerate(said)], "doc_id long, text string, spaced string, found string")
    r = licenses.scan(d).orderBy("doc_id").collect()
    assert r[0]["score"] == 1.0 and 0.5 <= r[1]["score"] <= 1.0 and r[2]["score"] == 0.5 and r[3]["labels"] == "" and r[3]["score"] == r[4]["score"] == 0
    assert {x["spaced"] for x in r} == {x["found"] for x in r} == {"mine"}


def test_license_index_takes_the_rarest_words_of_the_files():
    postings, sizes = licenses.index([("a", "k", "one two three two")], {"one": 90, "two": 3, "three": 7}, 100, rare=2)
    assert postings == {"two": [(0, 1), (0, 3)], "three": [(0, 2)]} and sizes == [3]
    assert set(licenses.index([("a", "k", "one two")], {"one": 90, "two": 80}, 100, rare=1)[0]) == {"two"}


def test_sharding_without_rows(spark, none, tmp_path):
    store = sharding.Store(spark, f"file://{tmp_path}/store", sharding.Policy(fanout=2))
    for _ in range(2):
        store.append(none)
        store.compact()
        store.vacuum()
    assert store.manifest() == [] and store.read().collect() == [] and store.read().dtypes == none.dtypes
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/in/documents.parquet")
    r = sharding.op3_sharding(spark, f"{tmp_path}/in")
    assert r.columns == ["doc_id", "lang", "source", "n_chars", "text_sha256"] and r.collect() == []


def test_sharding_with_two_writers(spark, docs, tmp_path):
    """A writer that loses the race commits on top; a vacuum meanwhile leaves its shards alone; a merge of runs that are gone is dropped."""
    root = f"file://{tmp_path}/store"
    one, two = (sharding.Store(spark, root, sharding.Policy(fanout=2)) for _ in range(2))
    waiting = one._write(docs, "waiting")
    two.append(docs)
    two.append(docs)
    two.compact()
    two.vacuum()
    with pytest.raises(sharding.Conflict):
        one.commit(0, waiting, docs.schema)
    assert one._add(waiting, docs.schema) == two.version() and two.read().count() == 3 * len(ROWS)
    with pytest.raises(RuntimeError, match="gone"):
        one.commit(one.version(), [*one.manifest(), sharding.Shard("data/lost/x.parquet", 1, 1, "lost")])

    class Beaten(sharding.Store):
        def _write(self, df, run):
            out = super()._write(df, run)
            if run[0] == "m" and two.version() == before:
                two.compact()
            return out

    two.append(docs)
    before = two.version()
    Beaten(spark, root, sharding.Policy(fanout=2)).compact()
    assert two.read().count() == 4 * len(ROWS)
    two.vacuum(grace=-5)
    assert two.read().count() == 4 * len(ROWS) and len(list((tmp_path / "store" / "data").rglob("*.parquet"))) == len(two.manifest())
    with pytest.raises(ValueError):
        sharding.Store(spark, f"file://{tmp_path}/new").read()


def test_lots_are_runs(spark, docs, tmp_path):
    store = sharding.Store(spark, f"file://{tmp_path}/store")
    seen = []
    for version in store.append_lots(docs.withColumn("lot", F.lit("mine")), F.pmod(F.xxhash64("doc_id"), F.lit(3)), 3):
        seen.append(store.read().count())
        assert version == len(seen)
    assert seen == sorted(seen) and seen[-1] == len(ROWS) and {r["lot"] for r in store.read().collect()} == {"mine"}


def test_inner_names_do_not_clash(spark):
    from sparkloom.llm.common import without

    d = spark.createDataFrame([(1, "mine", "a", "b"), (2, "mine", "a", "b"), (None, "mine", "a", "b")], "doc_id long, place string, word string, maybe string")
    left = without(d, "doc_id", spark.createDataFrame([(2,)], "doc_id long")).collect()
    assert sorted(str(r["doc_id"]) for r in left) == ["1", "None"] and all(r["place"] == "mine" and r["word"] == "a" and r["maybe"] == "b" for r in left)


def test_dedup_where_the_pivot_is_unlike_the_rest(spark, monkeypatch):
    """Groups whose pivot links nobody, in several blocks: clusters are found by the digests and the exact comparison."""
    monkeypatch.setattr(dedup, "BLOCK", 3)
    random.seed(10)
    words = [f"w{k}" for k in range(400)]
    texts = []
    for c in range(4):
        base = random.sample(words, 120)
        texts += [" ".join(base[:k] + [f"z{c}{k}"] + base[k + 1 :]) for k in range(0, 120, 15)]
    texts.insert(0, " ".join(random.sample(words, 120)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sig = dedup.signatures(docs).toPandas()
    # One band that all share, so that the first text is everybody's pivot.
    rows = [(int(r.doc_id), [1], int(r.n_shingles), bytearray(r.sketch)) for r in sig.itertuples()]
    reps = spark.createDataFrame(rows, "rep long, bands array<long>, n_shingles long, sketch binary")
    got = {r["node"]: r["component"] for r in dedup.linked(reps, docs).collect()}
    assert got == {1 + 8 * c + k: 1 + 8 * c for c in range(4) for k in range(8)}
