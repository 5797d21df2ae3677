"""Divergence audit, spelling groups and licence scan against brute force, with nulls, ties, repeats, long texts and clashing columns."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from scanforge.llm import divergence, license_scan, spelling

FULL = "doc_id long, text string, lang string, source string, rank int, word string, labels string"


def make(spark, rows):
    """Rows (doc_id, text, lang, source) with columns whose names clash with those of results."""
    return spark.createDataFrame([(*r, 1, "w", "l") for r in rows], FULL)


def lowered(text):
    return (text or "").encode().lower().decode()


# ---- divergence


def brute_audit(rows, min_docs, ranks):
    count, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))
        groups.add((lang, source))
        count[lang, source].update(terms)
        df[lang].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        sources = sorted({s for x, s in groups if x == lang}, key=str.encode)
        all_n = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        p = lambda n, total: 1 + 10**9 * (n + 5) // (total + 5 * len(kept))  # noqa: B023, E731
        total = {t: sum(count[lang, s][t] for s in sources) for t in kept}
        for s in sources:
            far = [(-sum(abs(p(count[lang, s][t], all_n[s]) - p(count[lang, o][t], all_n[o])) for t in kept), o.encode(), o) for o in sources if o != s]
            out |= {(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(sorted(far), 1)}
            over = [(p(total[t], sum(total.values())) - p(count[lang, s][t], all_n[s]), t.encode(), t) for t in kept if count[lang, s][t]]
            out |= {(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(sorted(x for x in over if x[0] < 0)[:ranks], 1)}
    return out


def corpus(rng, n):
    rows = [(i, " ".join(rng.choices("Alpha beta GAMMA délta epsi-lon ζήτα x1y eta théta iota".split(), k=rng.randrange(30))), rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s2", "s3", "é", None])) for i in range(n)]
    return [*rows, rows[0], rows[0], (None, None, "en", "empty"), (7, "", "solo", "one"), (8, "\x00\x01 12 []", "bare", "a"), (9, None, "bare", "b"), (10, "beta " * 30_000, "en", "s1")]


@pytest.mark.parametrize("block", [divergence.BLOCK_POSTINGS, 3])
def test_divergence(spark, block):
    rows = corpus(random.Random(5), 200)
    got = divergence.audit(make(spark, rows), min_docs=4, ranks=3, block=block)
    assert {tuple(r) for r in got.collect()} == brute_audit(rows, 4, 3) and got.count() == len(brute_audit(rows, 4, 3))
    assert divergence.audit(make(spark, []), block=block).count() == 0


def test_divergence_beyond_64_bits(spark):
    p = spark.createDataFrame([(4 * 10**17, 10**18, 3)], "n long, n_all long, v long").select(F.expr(divergence._probability("n"))).first()[0]
    assert p == 1 + 10**9 * (4 * 10**17 + 5) // (10**18 + 15)


def test_terms_of_a_long_text(monkeypatch):
    monkeypatch.setattr(divergence, "TEXT_BYTES", 7)
    text = "Ab,cd  efghijklmnop é" * 9
    assert [t.decode() for part in divergence._terms(text.encode()) for t in part] == re.findall("[a-zé]+", text.lower())


# ---- spelling


def brute_words(rows):
    n = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_groups(words):
    out = {}
    for w, n in words.items():
        close = [o for o in words if near(w, o)]
        best = min(close, key=lambda o: (-words[o], o), default=None)
        form = best if best is not None and words[best] >= 10 * n else None
        out[w] = (form, n, len(close), words[form] if form else None)
    root = lambda w: w if out[w][0] is None else root(out[w][0])
    return {(w, f, root(w), n, k, m) for w, (f, n, k, m) in out.items()}


def edited(rng, w):
    i, kind = rng.randrange(len(w)), rng.randrange(3)
    c = rng.choice("abéÿ")
    return w[:i] + (c if kind < 2 else "") + w[i + (kind > 0) :]


def spelt(rng):
    words = ["letters", "aaaaaaa", "aaaaaaab", "abababab", "Àbcd×fgh", "x" * 31, "x" * 32, "x" * 33, "x" * 34, "long" * 15, "Straße" * 2]
    words += ["".join(rng.choices("abc", k=rng.randrange(7, 10))) for _ in range(25)]
    some = words + [edited(rng, w) for w in words for _ in range(6)]
    some += [edited(rng, w) for w in some[-80:]]
    rows = [(i, " ".join(w for w in rng.choices(some, k=40))) for i in range(20)] + [(99, "letters " * 300), (None, "Letters,leters;leters 7letterz letterz"), (3, None), (4, ""), (5, ("lettres " * 12 + "lattres ") * 3)]
    return [(*r, "en", "s") for r in rows]


@pytest.mark.parametrize("small", [spelling.SMALL_EDGES, 0])
def test_spelling(spark, monkeypatch, small):
    monkeypatch.setattr(spelling, "SMALL_EDGES", small)
    rows = spelt(random.Random(3))
    want = brute_groups(brute_words(rows))
    got = spelling.group(make(spark, rows)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert sum(f is not None for _, f, *_ in want) > 3 and any(len(w) > spelling.MAX_LEVELS and k for w, _, _, _, k, _ in want)


def test_spelling_chain_and_empty(spark):
    text = "chained " * 1000 + "chainede " * 100 + "chainedes " * 10 + "chainedest chainedest "
    rows = [(1, text * 3, "en", "s")]
    got = {tuple(r) for r in spelling.group(make(spark, rows)).collect()}
    assert got == brute_groups(brute_words(rows))
    assert spelling.group(make(spark, [])).count() == 0


# ---- licences


def brute_licenses(text, order_free_templates):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    base = sorted((i, label) for p, label in license_scan.PHRASES.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split())
    labels, best = {x for _, x in base}, 0.0
    for label, must, words in order_free_templates:
        width = next(c for c in license_scan.CLASSES if len(words) <= c)
        for k in range(-(-len(ws) // width)):
            held = words & set(ws[k * width : (k + 2) * width])
            if len(held) / len(words) >= license_scan.CONTAINMENT - 1e-12 and must <= held:
                labels.add(label)
                best = max(best, len(held) / len(words))
    return (len(ws), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), 1.0 if base else best)


def test_licenses(spark):
    rng = random.Random(4)
    stock = [w for _, _, t in license_scan.TEMPLATES for w in t.split()]
    texts = [None, "", "  ", "Under the MIT-License; under\nthe mit license.", "cc by nc cc-by-nc, 4.0 CC BY ND", "APACHE LICENSE, Version 2.0", "apache license version 20", "aunder the mit licenses", "undér the mit license", "KLicensed under the GNU GPL"]
    for _, _, t in license_scan.TEMPLATES:
        words = t.split()
        texts += [f"{' '.join(rng.choices(stock, k=rng.randrange(90)))} {' '.join(words)}. tail" for _ in range(2)]
        texts += [" \n".join(w for w in words if rng.random() > 0.12) for _ in range(2)]
        texts += [" ".join(words[: len(words) // 2] + ["filler"] * rng.choice([3, 200]) + words[len(words) // 2 :])]
    texts.append("prose words " * 20_000 + "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted " + "more prose " * 5_000)
    rows = [(i % 40 if i % 9 else None, t, None, "s") for i, t in enumerate(texts)] + [(1, texts[3], None, "s")] * 3
    got = sorted(map(repr, map(tuple, license_scan.scan(make(spark, rows)).collect())))
    assert got == sorted(repr((i, *brute_licenses(t, license_scan.templates()))) for i, t, *_ in rows)
    assert license_scan.scan(make(spark, [])).count() == 0
    assert "Python" not in license_scan.scan(make(spark, rows))._jdf.queryExecution().toString()


def test_licenses_read_each_text_once(spark):
    """One pass over the texts, whatever they hold: no word order, index or join goes back to the documents."""
    every = "".join(f"{chr(c)}a{chr(c)} " for c in [*range(0x300), 0x2028, 0xFFFD, 0x1F600, 0x10FFFF])
    notices = [t for *_, t in license_scan.TEMPLATES]
    texts = [None, "", every, "Released under the permit license", "GNUs in general, all under the public licensed version", *notices, *(every + t + every for t in notices), *(t.replace(" ", "x ") for t in notices)]
    rows = [(i, t, None, "s") for i, t in enumerate(texts)]
    seen = spark.sparkContext.accumulator(0)

    def look(text):
        seen.add(1)
        return text

    docs = make(spark, rows).withColumn("text", F.udf(look, "string").asNondeterministic()("text"))
    got = sorted(map(repr, map(tuple, license_scan.scan(docs).collect())))
    assert got == sorted(repr((i, *brute_licenses(t, license_scan.templates()))) for i, t, *_ in rows)
    assert seen.value == len(rows)


def test_license_index_is_lossless(spark):
    """Prefix, length and positional filters drop no pair, in any word order."""
    rng = random.Random(6)
    rows = tuple((f"l{i}", "", " ".join(rng.sample("a b c d e f g h i j k l m n".split(), rng.randrange(1, 12)))) for i in range(12))
    texts = [(str(i), " ".join(rng.choices("a b c d e f g h i j k l m n zz".split(), k=rng.randrange(1, 30)))) for i in range(60)]
    words = sorted(set().union(*(w for *_, w in license_scan.templates(rows))))
    rng.shuffle(words)
    found = license_scan.matches(spark.createDataFrame(texts, "key string, text string"), {w: i for i, w in enumerate(words)}, 0.8, rows)
    want = set()
    for key, text in texts:
        ws = text.split()
        for n, (_, _, t) in enumerate(license_scan.templates(rows)):
            width = next(c for c in license_scan.CLASSES if len(t) <= c)
            want |= {(key, n, k) for k in range(-(-len(ws) // width)) if len(t & set(ws[k * width : (k + 2) * width])) >= 0.8 * len(t) - 1e-9}
    got = [(r.key, r.template, r.block) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)
    with pytest.raises(ValueError):
        license_scan.templates((("x", "gone", "only these"),))
