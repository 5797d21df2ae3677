"""Operators over documents against brute force, with nulls, empty texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from scanforge.llm import decontaminate, line_dedup, lm_score, mixing, secret_scan, simhash, toxicity
from scanforge.llm.components import components
from scanforge.llm.perfect_hash import PerfectHash

DOC = "doc_id long, text string"


def make(spark, rows, schema=DOC):
    return spark.createDataFrame(rows, schema)


def words(rng, n, stock=400):
    return " ".join(f"w{rng.randrange(stock)}" for _ in range(n))


def test_perfect_hash():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 20_000, np.uint64)
    index = PerfectHash.build(keys)
    assert sorted(index.find(keys)) == list(range(keys.size))
    assert PerfectHash.build(keys[:0]).find(keys[:3]).tolist() == [-1, -1, -1]
    with pytest.raises(ValueError):
        PerfectHash.build(np.array([5, 5], np.uint64))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, i) for i in range(1001, 1060)] + [(i, i + 1) for i in range(2000, 2040)] + [(7, 7), (None, 3)]
    root = {i: i for e in edges for i in e if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None and find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.root for r in components(make(spark, edges, "a long, b long"), "a", "b").collect()}
    assert all(find(n) == r for n, r in got.items()) and set(got) == {i for a, b in edges if a is not None and a != b for i in (a, b)}
    assert components(make(spark, [], "a long, b long"), "a", "b").count() == 0


def brute_lines(rows):
    keys = lambda t: [x.strip(" \t\n\x0b\x0c\r").encode().lower().decode() for x in (t or "").split("\n")]
    holders = {}  # a document is an id; rows without one are one document
    for i, t in rows:
        for k in {k for k in keys(t) if len(k) >= 20}:
            holders.setdefault(k, set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        drop = [len(holders.get(k, [])) >= 3 and max(x if x is not None else -1 for x in holders[k]) != (i if i is not None else -1) for k in keys(t)]
        out.append((i, len(lines), sum(drop), "\n".join(x for x, d in zip(lines, drop, strict=True) if not d)))
    return sorted(out, key=repr)


def test_line_dedup(spark):
    rng = random.Random(3)
    lines = [f"A recurring line number {i:03d} é" for i in range(6)] + ["short", "", "  \tA RECURRING line number 000 é \r", "é" * 19, "É" * 20]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 8)))) for i in range(40)] + [(40, None), (41, ""), (5, lines[0]), (None, lines[1]), (None, lines[1])]
    rows += [(7, "a line of two ids, thrice over"), (7, "a line of two ids, thrice over"), (3, "a line of two ids, thrice over")]
    df = make(spark, rows).withColumn("n_lines", F.lit("clash"))
    for limit in ({}, {"shard_keys": 40, "routed_lines": 5}):
        got = line_dedup.dedup_lines(df, **limit)
        assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()), key=repr) == brute_lines(rows)
    assert line_dedup.dedup_lines(make(spark, [])).count() == 0


def brute_fingerprint(text):
    w = (text or "").encode().lower().decode("utf-8").split()
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    rng = random.Random(4)
    base = [words(rng, 60) for _ in range(12)]
    rows = [(i, base[i % 12] + (" extra" if i > 24 else "")) for i in range(36)] + [(50, None), (51, " \t\n"), (52, "one"), (53, "ONE"), (54, "a b"), (55, "a b")]
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(make(spark, rows)).collect()}
    fps = {i: brute_fingerprint(t) for i, t in rows}
    assert {i: f for i, (f, _) in got.items()} == fps
    assert {i: c for i, (_, c) in got.items()} == brute_components(fps, 3)
    assert simhash.near_duplicates(make(spark, [])).count() == 0


def brute_components(fps, radius):
    root = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for i in fps:
            for j in fps:
                if bin(fps[i] ^ fps[j]).count("1") <= radius and root[j] < root[i]:
                    root[i], changed = root[j], True
    return root


def test_simhash_links_of_near_fingerprints(spark):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(30)]
    fps = {i: rng.choice(seeds) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for i in range(400)}
    df = make(spark, [((f ^ 1 << 63) - (1 << 63),) for f in set(fps.values())], "fp long")
    found = {r.node & (1 << 64) - 1: r.root for r in components(simhash.links(df, 3, tile=16), "a", "b").collect()}
    want = brute_components({f: f for f in set(fps.values())}, 3)
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert groups({f: found.get(f, f) for f in want}) == groups(want)


def test_secrets(spark):
    hexa, akia = "0123456789abcdef" * 2, "AKIA" + "ABCDEFGHIJKL"
    rows = [
        (1, f"é token: '{'x' * 8}' and {hexa}, {akia}"), (2, "password=token :abcdefgh"), (3, None), (4, ""), (5, f"{hexa[:31]} {akia[:15]} token=short"), (6, "API_KEY = aaa.bbb/ccc=="), (6, "API_KEY = aaa.bbb/ccc=="),
        (7, "see q9X2vL7mZ4kT8wR1nB6yH3sD here and an_ordinary_identifier_name"),
    ]
    ordinary = [f"{a}_{b}" for a in ("ordinary", "name", "identifier", "value", "reader") for b in ("list", "items", "of", "index", "name")] * 5
    made = [hashlib.sha256(str(i).encode()).hexdigest()[:40] for i in range(60)] + ["".join(random.Random(i).choices(secret_scan.ALPHABET, k=32)) for i in range(200)]
    model = secret_scan.train(make(spark, [(t, False) for t in ordinary] + [(t, True) for t in made] + [(None, True)], "token string, random boolean"))
    got = sorted(secret_scan.scan(make(spark, rows).withColumn("spans", F.lit(1)), model).collect(), key=lambda r: r.doc_id)
    for r in got:
        assert [(s.start, s.kind, s.end) for s in r.base] == brute_spans(r.text or "")
    text = got[-1].text
    assert [text[s.start : s.end] for s in got[-1].spans] == ["q9X2vL7mZ4kT8wR1nB6yH3sD"]
    assert secret_scan.scan(make(spark, []), model).count() == 0
    assert secret_scan.train(make(spark, [], "token string, random boolean")) == pytest.approx([0.0] * secret_scan.SYMBOLS**2)


def test_secret_models_against_loops(spark):
    """Samples are the same however rows are dealt; ratios equal a plain loop's; held-out keys are found and words are not."""
    rng = random.Random(12)
    key = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    name = lambda: "_".join(rng.choice(["reader", "value", "index", "document", "length", "number", "context", "window"]) for _ in range(4))
    docs = [(i, f"{name()} holds token={key(24)} and {name()}") for i in range(300)]
    df = make(spark, docs)
    sample = [sorted(map(tuple, secret_scan.samples(d, 200, 150).collect())) for d in (df, df.repartition(7))]
    assert sample[0] == sample[1] and 0 < len(sample[0]) <= 300
    model = secret_scan.train(secret_scan.samples(df))

    def ratio(token):
        at, total = 0, 0.0
        for c in token:
            total += model[at * secret_scan.SYMBOLS + secret_scan.ALPHABET.index(c) + 1]
            at = secret_scan.ALPHABET.index(c) + 1
        return total

    tokens = [key(rng.randrange(20, 40)) for _ in range(100)] + [name() for _ in range(100)]
    got = [r.x for r in spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "i int, t string").orderBy("i").select(secret_scan.ratio(F.col("t"), model).alias("x")).collect()]
    assert got == pytest.approx([ratio(t) for t in tokens])
    out = [len(r.spans) for r in secret_scan.scan(make(spark, list(enumerate(tokens))), model).orderBy("doc_id").collect()]
    assert sum(out[:100]) >= 90 and sum(out[100:]) <= 5
    found = {r.doc_id: r.spans for r in secret_scan.find_secrets(df).collect()}
    assert len(found) == 300 and all(any(s.kind == 0 for s in v) for v in found.values())
    long = "an_identifier_of_words " * 40_000 + tokens[0]
    (r,) = secret_scan.scan(make(spark, [(1, long)]), model).collect()
    assert [(s.start, s.end) for s in r.spans] == [(len(long) - len(tokens[0]), len(long))]


def brute_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def test_decontamination(spark):
    rng = random.Random(6)
    items = [(i, words(rng, rng.randrange(6, 70), 5000)) for i in range(30)] + [(100, "tiny item"), (101, None), (102, " ")]
    rows = []
    for i in range(60):
        w = words(rng, rng.choice([5, 200, 3000]), 5000).split()
        own = items[i % 30][1].upper().split()
        if i % 3 == 0:
            at = rng.randrange(len(w))
            w[at:at] = own
        elif i % 3 == 1:
            w[2:2] = own[: int(len(own) * rng.uniform(0.5, 1))]
        rows.append((i, " ".join(w)))
    rows += [(200, "a TINY\nitem here"), (201, None), (202, ""), (203, rows[0][1]), (203, rows[0][1])]
    sh = lambda t, n: {tuple(w[i : i + n]) for w in [(t or "").lower().split()] for i in range(len(w) - n + 1)}
    want = []
    for d, t in rows:
        for k, x in items:
            if n := min(5, len((x or "").split())):
                own = sh(x, n)
                if len(own & sh(t, n)) >= 0.8 * len(own):
                    want.append((d, k, len(own), len(own & sh(t, n))))
    for limit in (decontaminate.GROUP_BYTES, 2_000):
        got = decontaminate.find(make(spark, rows), make(spark, items, "item_id long, text string"), group_bytes=limit)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert decontaminate.find(make(spark, []), make(spark, items, "item_id long, text string")).count() == 0
    assert decontaminate.find(make(spark, rows), make(spark, [], "item_id long, text string")).count() == 0


def test_lm_scores(spark):
    rng = random.Random(7)
    rows = [(i, words(rng, rng.randrange(0, 60), 50).upper() if i % 2 else words(rng, 20, 50)) for i in range(60)] + [(60, None), (61, ""), (62, "né " * 5), (62, "né " * 5)]
    df = make(spark, rows).withColumn("score", F.lit("clash"))
    train = F.col("doc_id") % 5 != 1
    got = lm_score.score(df, train).collect()
    count = {}
    for i, t in rows:
        if i % 5 != 1:
            for w in [*(t or "").encode().lower().split(), b"\0"]:
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    for r in got:
        w = [*(r.text or "").encode().lower().split(), b"\0"]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in count for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((count.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w))
    many = lm_score.score(df, train, group_grams=300, group_words=10)
    assert sorted(many.columns) == sorted(lm_score.score(df, train).columns)
    small = {(r.doc_id, r.score, r.base_score) for r in many.collect()}
    assert sorted((a, round(b, 8), round(c, 8)) for a, b, c in small) == sorted({(r.doc_id, round(r.score, 8), round(r.base_score, 8)) for r in got})
    assert lm_score.score(make(spark, []), F.lit(True)).count() == 0


def test_context_trees_equal_the_sequential_ones():
    """The closed form against a tree that is updated bit by bit, and probabilities that sum to one."""
    text, depth = b"abracadabra abracadabra", 3
    grams, _ = lm_score.byte_strings([text], depth)
    u, n = np.unique(grams, return_counts=True)
    s = lm_score.Subtrees(u, n, depth)
    top = lm_score.Top([s.first])
    counts = {}
    for g in grams.tolist():
        for i in range(8):
            z, bit = (1 << i) | (g & 255) >> (8 - i), (g & 255) >> (7 - i) & 1
            for d in range(depth + 1):
                counts.setdefault((d, (g >> 8) & ((1 << 8 * d) - 1), z), [0, 0])[bit] += 1

    def kt(a, b):
        p, x, y = 0.0, 0, 0
        for bit in [0] * a + [1] * b:
            p += math.log(((x, y)[bit] + 0.5) / (x + y + 1))
            x, y = x + (not bit), y + bit
        return p

    def weighted(d, ctx, z):
        own = kt(*counts[d, ctx, z])
        if d == depth:
            return own
        below = sum(weighted(d + 1, c, z) for e, c, y in counts if e == d + 1 and y == z and c & ((1 << 8 * d) - 1) == ctx)
        return float(np.logaddexp(math.log(0.5) + own, math.log(0.5) + below))

    for z in (1, 2, 3, 0b110):
        if (0, 0, z) in counts:
            assert top.w0[z] == pytest.approx(math.exp(math.log(0.5) + kt(*counts[0, 0, z]) - weighted(0, 0, z)))
    built = lm_score._build(type("B", (), {"value": top}), depth)(__import__("pyarrow").table({"bucket": [0] * len(u), "gram": u.view(np.int64), "n": n}))
    row = type("R", (), {"bucket": 0, "parts": built["parts"][0].as_py()})
    trees = lm_score.Trees(lm_score.join_buckets(iter([row]), 1, depth), top, depth)
    for ctx in (b"abr", b"zzz", b"\0\0a"):
        every = np.array([int.from_bytes(ctx, "big") << 8 | x for x in range(256)], np.uint64)
        at, hit = trees._find(trees.grams, every)
        assert np.allclose(trees._unseen(every[hit]), trees.values[at[hit]], atol=1e-5)
        assert (10 ** trees._unseen(every)).sum() == pytest.approx(1, abs=1e-6)

    def ahead(d, ctx, z, bit):
        """Probability of a bit after all of training, from the tree itself: what the weighted probability grows by."""
        n = counts.get((d, ctx & ((1 << 8 * d) - 1), z), [0, 0])
        own = (n[bit] + 0.5) / (sum(n) + 1)
        if d == depth or not sum(n):
            return own if sum(n) else 0.5
        stop = math.exp(math.log(0.5) + kt(*n) - weighted(d, ctx & ((1 << 8 * d) - 1), z))
        return stop * own + (1 - stop) * ahead(d + 1, ctx, z, bit)

    for ctx, byte in ((b"abr", 97), (b"abr", 120), (b"xyz", 97), (b"rab", 114)):
        gram = np.array([int.from_bytes(ctx, "big") << 8 | byte], np.uint64)
        want = sum(math.log10(ahead(0, int.from_bytes(ctx, "big"), (1 << i) | byte >> (8 - i), byte >> (7 - i) & 1)) for i in range(8))
        assert trees._unseen(gram)[0] == pytest.approx(want, abs=1e-5)


def test_scores_stay_finite_after_very_many_occurrences():
    depth = 3
    grams = np.array([int.from_bytes(b"abcd", "big"), int.from_bytes(b"zbcd", "big")], np.uint64)
    s = lm_score.Subtrees(grams, np.array([10**9, 10**9]), depth)
    top = lm_score.Top([s.first])
    built = lm_score._build(type("B", (), {"value": top}), depth)(__import__("pyarrow").table({"bucket": [0, 0], "gram": grams.view(np.int64), "n": [10**9, 10**9]}))
    trees = lm_score.Trees(lm_score.join_buckets(iter([type("R", (), {"bucket": 0, "parts": built["parts"][0].as_py()})]), 1, depth), top, depth)
    odd = np.array([int.from_bytes(x, "big") for x in (b"abce", b"qbc\x9b", b"qqc\x9b", b"qqqq")], np.uint64)
    assert np.isfinite(trees._unseen(odd)).all() and trees._unseen(odd)[0] < -8


def test_toxicity(spark):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(400):
        w = words(rng, 60, 300).split()
        if i % 4 == 0:
            for k in range(5):
                w.insert(rng.randrange(len(w)), rng.choice(["grumble", "snarling", "vexatious"]) + ("s" if k % 2 else ""))
        docs.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    docs += [(1000, None), (1001, ""), (1001, "")]
    labels += [(1002, 1), (None, 1), (3, None)]
    model = toxicity.train(make(spark, docs), make(spark, labels, "doc_id long, toxic int"))
    got = toxicity.score(make(spark, docs).withColumn("score", F.lit("clash")), model).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and r.doc_id < 1000]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got) and all(r.predicted == 0 for r in got if r.doc_id >= 1000)
    empty = toxicity.train(make(spark, []), make(spark, [], "doc_id long, toxic int"))
    assert toxicity.score(make(spark, docs), empty).where("predicted = 1").count() == 0
    assert toxicity.score(make(spark, []), model).count() == 0


def test_mixing(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None]), words(rng, rng.randrange(0, 30))) for i in range(600)] + [(5000, "d", None), (5001, "e", "x"), (None, "a", "y z"), (7, "a", "again again")]
    df = make(spark, rows, "doc_id long, source string, text string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
    source = {i: s for i, s, _ in rows}
    for r in got:
        x = by.setdefault(source[r.doc_id], [0, r.target, r.source_size, 0])
        x[0] += r.taken
        x[3] = max(x[3], r.size)
    total = sum(x[2] for x in by.values())
    assert sum(x[1] for x in by.values()) == pytest.approx(total)
    for taken, target, size, largest in by.values():
        assert abs(taken - target) <= largest + 3 and target <= 3 * size + 1e-9
    assert sorted(map(tuple, mixing.mix(df.repartition(7)).collect()), key=repr) == sorted(map(tuple, got), key=repr)
    kept = mixing.mixed_documents(df)
    assert kept.agg(F.sum("taken")).first()[0] == sum(r.taken for r in got) and kept.where("taken = 0").count() == 0
    assert mixing.mix(make(spark, [], "doc_id long, source string, text string")).count() == 0
