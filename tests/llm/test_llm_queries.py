"""The training-data queries against SQL or brute force on the smallest tables."""

import hashlib
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from sparkloom.llm import minhash, registry, toxicity

TABLES = "documents pages benchmark labels conversations".split()


def rows(names, records):
    order = [names.index(n) for n in sorted(names)]
    return sorted(repr(tuple(r[i] for i in order)) for r in records)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(name, spark, sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = registry.QUERIES[name](spark, sf_dir)
    found = c.execute(registry.ORACLE_SQL[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([d[0] for d in found.description], found.fetchall())


@pytest.fixture(scope="module")
def docs(sf_dir):
    return pd.read_parquet(f"{sf_dir}/documents.parquet")


def run(name, spark, sf_dir):
    return registry.QUERIES[name](spark, sf_dir).toPandas()


def test_fingerprints(spark, sf_dir, docs):
    r = run("op1_fingerprints", spark, sf_dir).sort_values("doc_id", ascending=False)
    d = docs.sort_values("doc_id", ascending=False)
    texts = d.text.tolist()
    after = texts[1:] + texts[:1]
    edited = [t[: len(t) - len(t) // 3] + n[: len(t) // 3] for t, n in zip(texts, after, strict=True)]
    assert r.doc_id.tolist() == d.doc_id.tolist() and r.n_chars.tolist() == [len(t) for t in texts]
    assert r.edited_sha256.tolist() == [hashlib.sha256(e.encode()).hexdigest() for e in edited]
    assert r.near_edited.between(0, 1).all() and (r.near_edited > r.near_next).mean() > 0.95
    same = r.assign(text=texts).groupby("text").fingerprint.nunique()
    assert (same == 1).all()


def plain_digest(data):
    """The digest by its definition, one window and bucket at a time: codes and header."""
    from sparkloom.llm.fingerprint import BUCKETS, MULTIPLIERS, TRIPLETS

    count = [0] * BUCKETS
    for at in range(len(data)):
        for (i, j), (a, b, c) in zip(TRIPLETS, MULTIPLIERS, strict=True):
            if at >= j:
                h = (data[at] * a + data[at - i] * b + data[at - j] * c) % 65536
                h ^= h >> 7
                count[(h * 40503 % 65536) >> 8] += 1
    q1, q2, q3 = (sorted(count)[k] for k in (63, 127, 191))
    size = min(255, int(np.log(len(data)) / np.log(1.1) + 1e-9)) if data else 0
    return [(c > q1) + (c > q2) + (c > q3) for c in count], (size, q1 * 15 // q3 if q3 else 0, q2 * 15 // q3 if q3 else 0, hashlib.blake2b(data, digest_size=1).digest()[0])


def plain_likeness(a, b):
    body = sum({0: 0, 1: 1, 2: 2, 3: 6}[abs(x - y)] for x, y in zip(a[0], b[0], strict=True))
    head = max(0, abs(a[1][0] - b[1][0]) - 1) + abs(a[1][1] - b[1][1]) + abs(a[1][2] - b[1][2]) + (a[1][3] != b[1][3])
    return 1 - min(416, body + head) / 416


def test_fingerprints_by_definition(spark, sf_dir, docs):
    """Codes, headers and likenesses of whole and edited texts against the plain version."""
    from sparkloom.llm import fingerprint

    d = docs[docs.text.str.len() < 4000].sort_values("doc_id", ascending=False).head(60)
    r = fingerprint.edited_by_next(spark.createDataFrame(d[["doc_id", "text"]])).toPandas().set_index("doc_id")
    texts = d.text.tolist()
    for i, t, n in zip(d.doc_id, texts, texts[1:] + texts[:1], strict=True):
        third = len(t) // 3
        own, edited, nxt = (plain_digest(y.encode()) for y in (t, t[: len(t) - third] + n[:third], n))
        for column, want in (("fingerprint", own), ("edited_fingerprint", edited)):
            got = fingerprint.parsed(r.loc[i, column])
            assert got.code.tolist() == want[0] and abs(got.header[0] - want[1][0]) <= 1 and tuple(got.header[1:]) == want[1][1:]
        assert r.near_edited[i] == pytest.approx(plain_likeness(own, edited), abs=0.01) and r.near_next[i] == pytest.approx(plain_likeness(own, nxt), abs=0.01)


def test_byte_bpe(spark, sf_dir, docs):
    import public_tokenizers
    import tiktoken

    from sparkloom.llm.bpe import read_ranks

    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    r = run("op2_byte_bpe", spark, sf_dir).set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        ids = e.encode_ordinary(t)
        assert r.n_tokens[i] == len(ids) and r.ids_sha256[i] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256[i] == hashlib.sha256(t.encode()).hexdigest()


def components(texts):
    """Brute force: every pair that shares a shingle, by an inverted index (others have no similarity)."""
    sets, at, holders = {}, {}, {}
    for i, t in texts:
        w = t.encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
        at[i] = i

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for i in sorted(sets):
        both = {}
        for s in sets[i]:
            for j in holders.setdefault(s, []):
                both[j] = both.get(j, 0) + 1
            holders[s].append(i)
        for j, n in both.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                at[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_minhash_dedup(spark, sf):
    """Every link is found (a recall of 1) and none that isn't one."""
    docs = pd.read_parquet(f"/root/testdata/{sf}/documents.parquet")
    want = components(zip(docs.doc_id, docs.text, strict=True))
    r = run("op6_minhash_dedup", spark, f"/root/testdata/{sf}")
    assert {q.doc_id: (q.n_shingles, q.component_id) for q in r.itertuples()} == want
    assert (r.kept == (r.doc_id == r.component_id)).all() and (r.component_id != r.doc_id).any()


def checked_pieces(pieces, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4").tobytes() for i, x in texts}
    for q in pieces.itertuples():
        own = ids[q.doc_id]
        assert q.doc_tokens == len(own) // 4 and q.ids_crc32 == zlib.crc32(own[4 * q.start : 4 * (q.start + q.length)])
    for i, g in pieces.sort_values("start").groupby("doc_id"):
        assert g.start.tolist() == [0, *g.length.cumsum()[:-1]] and g.length.sum() == len(ids[i]) // 4
    assert set(pieces.doc_id) == set(ids)
    for _, g in pieces.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 4096
    total = pieces.length.sum()
    assert pieces.sequence_id.nunique() <= -(-total // 4096) + 2


def test_packing(spark, sf_dir, docs):
    checked_pieces(run("op7_packing", spark, sf_dir), zip(docs.doc_id, docs.text, strict=True))


def test_toxicity(spark):
    """On the held-out fold of tables with a few hundred toxic labels."""
    sf = "/root/testdata/sf0.1"
    r = run("op8_toxicity", spark, sf).merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    assert r.score.between(0, 1).all() and (r.predicted == (r.score >= 0.5)).all()
    assert (r.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in r.doc_id]).all()
    # Junk (quality 0) is labelled toxic here and there without a toxic word in it.
    for held, recall, least in ((r[r.held_out], 0.9, 0.93), (r[r.held_out & (r.quality == 1)], 0.96, 0.97)):
        toxic, clean = held.score[held.toxic == 1].to_numpy(), held.score[held.toxic == 0].to_numpy()
        auc = np.mean((toxic[:, None] > clean) + 0.5 * (toxic[:, None] == clean))
        assert len(toxic) > 50 and (toxic >= 0.5).mean() > recall and (clean < 0.5).mean() > 0.98 and auc > least


def plain_score(text, m):
    """A text's score and its segments, by splitting at the best segment again and again."""
    import math
    import re

    words = re.findall(rb"[a-z0-9\x80-\xff]+", re.sub(rb"[A-Z]", lambda c: c[0].lower(), text.encode()))
    s = [m.weights.get(w, m.weights.get(b"\0" + w[:5], m.rest) if len(w) > 5 else m.rest) for w in words]
    found, todo = [], [(0, len(s))]
    while todo:
        a, b = todo.pop()
        best, low, total, start = (0.0, a, a), 0.0, 0.0, a
        for k in range(a, b):
            total += s[k]
            if total <= low:
                low, start = total, k + 1
            elif total - low > best[0] + 1e-12:
                best = (total - low, start, k + 1)
        if best[0] > 0:
            found.append(best)
            todo += [(a, best[1]), (best[2], b)]
    least = math.log(max(m.k, 1e-12) * max(len(words), 1))
    up = [m.lam * x - least for x, *_ in found if m.lam * x > least]
    z = m.beta[0] + m.beta[1] * math.log1p(max(up, default=0)) + m.beta[2] * math.log1p(sum(up)) + m.beta[3] * math.log1p(len(up))
    return 1 / (1 + math.exp(-z)), len(words), found


def test_toxicity_scores_by_definition(spark):
    """Scores and significant passages against the plain version, for a model learnt from given labels."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 9000")
    m = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    scores = []
    for r in toxicity.passages(docs, m, keep=("doc_id", "text")).collect():
        want, n, found = plain_score(r["text"] or "", m)
        assert r["score"] == pytest.approx(want, abs=1e-6)
        p = lambda x: 1 - np.exp(-m.k * n * np.exp(-m.lam * x))  # noqa: B023, E731
        clear = sorted((a, b - 1) for x, a, b in found if p(x) < 0.0499)
        assert set(clear) <= {(s["first"], s["last"]) for s in r["passages"]} <= {(a, b - 1) for x, a, b in found if p(x) < 0.0501}
        scores.append(want)
    assert min(scores) < 0.2 and max(scores) > 0.9


def test_segments():
    import random

    random.seed(5)
    for _ in range(300):
        s = [random.choice([-3, -1, -0.5, 0.5, 1, 2]) for _ in range(random.randrange(1, 14))]
        found = toxicity.segments(s)
        spans = [(sum(s[a:b]), a, b) for a in range(len(s)) for b in range(a + 1, len(s) + 1)]
        best = max(x for x, *_ in spans)
        assert (max((x for *_, x in found), default=None) == pytest.approx(best)) if best > 0 else not found
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))
        for a, b, x in found:  # every proper prefix and suffix has a smaller positive complement
            assert x == pytest.approx(sum(s[a:b])) and all(sum(s[a:k]) > 0 and sum(s[k:b]) > 0 for k in range(a + 1, b))


def test_chat(spark, sf_dir):
    c = pd.read_parquet(f"{sf_dir}/conversations.parquet")
    said = r"\### Assistant: </turn> ok"
    c = pd.concat([c, pd.DataFrame({"conv_id": [-7, -7], "turn": [0, 1], "role": ["user", "assistant"], "text": [said, said]})]).sort_values(["conv_id", "turn"])
    r = run("op9_chat_windows", spark, sf_dir).set_index("conv_id")
    assert set(r.index) == set(c.conv_id)
    for i, g in c.groupby("conv_id"):
        loss = "".join(g.text[g.role == "assistant"])
        assert r.n_turns[i] == len(g) and r.turns_sha256[i] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in zip(g.role, g.text, strict=True)).encode()).hexdigest()
        assert r.loss_chars[i] == len(loss) and r.loss_sha256[i] == hashlib.sha256(loss.encode()).hexdigest()


def plain_kept(text):
    """The quality rules by their definitions."""
    import re

    from sparkloom.llm.quality import STOP_WORDS

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [y for y in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", y)]
    windows = {}
    for k in range(len(words) - 2):
        windows.setdefault(tuple(words[k : k + 3]), []).append(k)
    repeated = len({p for ks in windows.values() if len(ks) > 1 for k in ks for p in (k, k + 1, k + 2)})
    n, m = max(len(words), 1), max(len(lines), 1)
    once = list(dict.fromkeys(lines))
    chars = sum(map(len, lines))
    return (
        len(words) >= 50 and 100 * repeated <= 50 * len(words) and 2 <= sum(map(len, words)) / n <= 20 and sum(text.count(c) for c in "#*$%&|<>") / n <= 0.25
        and (len(words) < 80 or sum(w in STOP_WORDS for w in words) / n >= 0.01) and (len(lines) - len(once)) / m <= 0.5 and (chars - sum(map(len, once))) / max(chars, 1) <= 0.5
        and sum(bool(re.match(r"[ \t]*[-*•]", y)) for y in lines) / m <= 0.9 and sum(bool(re.search(r"(?:\.\.\.|…)[\x20\x09-\x0D]*$", y)) for y in lines) / m <= 0.5
    )


def test_pipeline(spark):
    """Each stage against its plain version on what the one before kept, and run() as a whole."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.01"
    from sparkloom.llm.common import written

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    given, seen = docs.toPandas(), {}
    for name, stage in corpus_pipeline.STAGES:
        if name == "toxicity":
            model = toxicity.fit(docs, labels)
        out = written(stage(spark, docs, sf), "test")
        seen[name] = out.toPandas()
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = out
    good = given[[plain_kept(y or "") for y in given.text]]
    assert sorted(seen["quality rules"].doc_id) == sorted(good.doc_id)
    scores = {i: plain_score(y, model)[0] for i, y in zip(good.doc_id, good.text, strict=True)}
    clean = set(seen["toxicity"].doc_id)
    assert {i for i, p in scores.items() if p < 0.4999} <= clean <= {i for i, p in scores.items() if p < 0.5001}
    before, after = seen["toxicity"], seen["near-duplicates"]
    want = components(zip(before.doc_id, before.text, strict=True))
    assert set(after.doc_id) == {i for i, (_, c) in want.items() if i == c}
    checked_pieces(seen["packing"], list(zip(after.doc_id, after.text, strict=True)))
    whole = corpus_pipeline.run(spark, sf)
    assert whole.columns == [*seen["packing"].columns]
    checked_pieces(whole.toPandas(), list(zip(after.doc_id, after.text, strict=True)))


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    for n in (4, 40, 2000):
        pool = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
        a, b = np.unique(pool[:n]), np.unique(pool[n // 4 : n + n // 4])
        same = np.mean(minhash.sketch(a, 1024) == minhash.sketch(b, 1024))
        both = len(np.intersect1d(a, b))
        assert abs(same - both / (len(a) + len(b) - both)) < 0.08
