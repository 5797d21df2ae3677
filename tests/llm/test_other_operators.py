"""Pages, conversations, vectors and the pipeline."""

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from scanforge.llm import chat_format, embed_dedup, html_extract, near_copies
from scanforge.llm.html_parse import parse

CHROME = "<nav><ul><li><a href=/>Home</a></li></ul></nav><div class='ad'>Buy</div>"
FOOT = "<aside>side</aside><div id=comments><p>reader says</p></div><form><p>mail</p></form><footer>&copy; us</footer>"


def test_main_text():
    text = lambda h: html_extract.main_text(parse(h))
    page = f"<!doctype html><head><title>T</title><style>p{{}}</style><script>'</p>'</script></head><body>{CHROME}<article><h1>A &amp; B</h1><p>x<b>y</b>  z<br>w<p>caf&eacute;\n&#x41;<!-- no --></article>{FOOT}"
    assert text(page) == "A & B xy z w café A"
    assert text("<p>only<p>this") == "only this" and text(None) == "" and text("") == "" and text("<div><p>open") == "open"
    assert text("<article class=post>kept<div class='share'>no</div><section hidden>no</section></article>") == "kept"
    assert text("<b>x" * 3000) == " ".join(["x" * 3000]) and text("a < b & c") == "a < b & c"


def test_templates(spark):
    rng = random.Random(1)
    body = lambda: " ".join(f"w{rng.randrange(999)}" for _ in range(30))
    texts = [body() for _ in range(12)]
    promo = "<div><p>Join our club for more of this</p></div>"
    rows = [(i, f"https://Site.example/{i}", f"<body>{promo}<div><p>{t}</p></div></body>") for i, t in enumerate(texts)]
    rows += [(20 + i, "https://copies.example/x", f"<body><article><p>{texts[0]}</p></article></body>") for i in range(8)]
    rows += [(30 + i, "https://prose.example/x", f"<body><article><p>A passage that many articles quote</p><p>{t}</p></article></body>") for i, t in enumerate(texts)]
    rows += [(50, None, None), (51, "no url", ""), (51, "no url", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    for limit in (html_extract.BROADCAST_ROWS, 0):
        got = [(r.page_id, r.text) for r in html_extract.extract(df, broadcast_rows=limit).collect()]
        assert len(got) == len(rows)
        got = dict(got)
        assert all(got[i] == t for i, t in enumerate(texts)) and all(got[20 + i] == texts[0] for i in range(8))
        assert all(got[30 + i] == f"A passage that many articles quote {t}" for i, t in enumerate(texts)) and got[50] == got[51] == ""
    assert html_extract.extract(df.limit(0)).count() == 0


def test_what_articles_share_is_not_the_template(spark):
    """Lists, tables, quotations and sections that a part of a host's articles have in common stay; what the host puts into most pages goes."""
    rng = random.Random(3)
    rows, want = [], {}
    lists = "<ul><li>flour</li><li>two eggs</li></ul>"
    tables = [f"<table><tr><td>size {k}</td></tr></table>" for k in range(3)]
    for i in range(40):
        t = " ".join(f"w{rng.randrange(999)}" for _ in range(40))
        extra, said = (lists, "flour two eggs") if i < 3 else ("", "")
        table, told = tables[i % 3], f"size {i % 3}"
        quote, words = ("<p>A passage that three of them quote</p>", "A passage that three of them quote") if i % 15 == 0 else ("", "")
        body = f"<p>{t}</p>{extra}{table}<div class='related-work'><p>earlier {t[:9]}</p></div><section class=comment-period><p>until {i}</p></section>{quote}"
        box = "<div class='share-widget'>tweet</div><div><p>Join our club</p></div>"
        if i % 2:
            rows.append((i, "https://h.example/a", f"<body><div>Home</div><article>{body}<div class='share-widget'>tweet</div></article></body>"))
        else:
            rows.append((i, "https://h.example/b", f"<body><div>Home</div>{box}<div class=content>{body.replace('related-work', 'w').replace('comment-period', 'p')}</div></body>"))
        want[i] = " ".join(x for x in (t, said, told, f"earlier {t[:9]}".strip(), f"until {i}", words) if x)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(c) for c in ("__id", "__of", "__found", "__host")})
    for limit in (html_extract.BROADCAST_ROWS, 0):
        out = html_extract.extract(df, broadcast_rows=limit)
        assert out.columns == [*df.columns, "text"] and all(r["__id"] == "__id" and r["__found"] == "__found" for r in out.collect())
        assert {r.page_id: r.text for r in out.collect()} == want


def test_templates_without_articles_or_telling_classes(spark):
    """Pages of bare divs: the counts alone remove the template, and equal those of a plain loop."""
    rng = random.Random(2)
    body = lambda n=30: " ".join(f"w{rng.randrange(999)}" for _ in range(n))
    frame = ["<div><div><a href=/>Home</a> <a href=/b>Books</a></div></div>", "<div><ul><li>All rights kept<li>Imprint</ul></div>"]
    rows, want = [], {}
    for k, n in (("a", 12), ("b", 2), ("c", 4)):
        for i in range(n):
            t = body()
            want[len(rows)] = t if n >= 3 else f"Home Books {t} All rights kept Imprint"
            rows.append((len(rows), f"https://{k}.example/{i}", f"<body>{frame[0]}<div><div>{t}</div></div>{frame[1]}</body>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("__host", F.lit("clash"))
    for limit in (html_extract.BROADCAST_ROWS, 0):
        out = html_extract.extract(df, broadcast_rows=limit)
        assert out.columns == [*df.columns, "text"] and {r.page_id: r.text for r in out.collect()} == want
    plain, seen = {}, {}
    for _, url, h in rows:
        for x in html_extract.block_hashes(parse(h)):
            seen.setdefault((url.split("/")[2], x), set()).add(html_extract.main_text(parse(h)))
    for (k, x), texts in seen.items():
        if len(texts) >= html_extract.MIN_PAGES:
            plain.setdefault(k, set()).add(x)
    assert set(plain) == {"a.example", "c.example"}
    assert all(html_extract.main_text(parse(h), plain.get(u.split("/")[2], set())) == want[i] for i, u, h in rows)
    deep = spark.createDataFrame([(None, "https://d.example/", "<div>" * 20_000 + "x"), (None, "https://d.example/", f"<p>{'long ' * 200_000}")], "page_id long, url string, html string")
    assert sorted(len(r.text) for r in html_extract.extract(deep).collect()) == [1, 999_999]


def test_chats(spark):
    hard = r"\### Assistant: </turn> ok \\ <|endoftext|> é 😀"
    rows = [(1, 0, "user", hard), (1, 1, "assistant", hard), (1, 2, "assistant", ""), (1, 3, "assistant", "end"), (2, 1, "assistant", None), (2, 0, None, "hi"), (3, 0, "a: b###", "x"), (3, 0, "a: b###", "x"), (None, None, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(1))
    tok = chat_format.read_tokenizer(spark)
    for part in (chat_format.PART_TOKENS, 1):
        got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(df, tok, part_tokens=part), tok).collect()}
        for c in (1, 2, 3, None):
            own = sorted(((t if t is not None else -1, r or "", x or "") for k, t, r, x in rows if k == c))
            loss = "".join(x for _, r, x in own if r == "assistant")
            assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
            assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.format_chats(df.limit(0), tok).count() == 0
    assert chat_format.loss_mask([1, 2, 0, 3], [False, True, True, False]).tolist() == [0, 1, 1, 0, 0, 0]


def test_vectors(spark):
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for label in (0, 1):
        centres = rng.normal(size=(25, 16))
        for _ in range(260):
            v = centres[rng.integers(25)] + rng.normal(size=16) * rng.choice([0.05, 0.3])
            rows.append((n, v.tolist(), label))
            n += 1
    rows += [(n + i, rows[0][1], 0) for i in range(5)]  # equal vectors
    odd = [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, rows[0][1], None), (904, [1.0, None], 0), (905, [], 0), (906, rows[0][1][:8], 0), (907, [float("inf")] * 16, 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumn("n_links", F.lit("clash"))
    out = embed_dedup.near_vectors(df, shard=120)
    got = {r.vec_id: r for r in out.collect()}
    assert len(got) == len(rows + odd)
    links, root = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, x, k in rows:
        for b, y, m in rows:
            if a != b and k == m and np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                links[a] += 1
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    assert sum(got[i].n_links for i in links) >= 0.98 * sum(links.values()) and all(got[i].n_links <= links[i] for i in links)
    assert sum(got[i].component_id == find(i) for i in links) >= 0.98 * len(links)
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i, _, _ in odd)
    assert embed_dedup.audit_recall(df.where("vec_id < 900"), out.where("vec_id < 900")) >= 0.9
    assert embed_dedup.near_vectors(df.limit(0)).count() == 0


def test_vectors_of_many_shards(spark):
    rng = np.random.default_rng(8)
    tight, wide = rng.normal(size=16), rng.normal(size=(40, 16))
    x = [tight + rng.normal(size=16) * 0.12 for _ in range(300)]  # a dense group, larger than a shard
    x += [wide[i % 40] + rng.normal(size=16) * 0.2 for i in range(900)]
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embed_dedup.near_vectors(df, shard=15).collect()}
    u = np.array(x) / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & ~np.eye(len(x), dtype=bool)
    assert near[:300, :300].mean() > 0.9 and sum(got[i].n_links for i in range(len(x))) >= 0.995 * near.sum()
    assert all(got[i].n_links <= near[i].sum() for i in range(len(x))) and len({got[i].component_id for i in range(300)}) == 1


def test_vectors_of_null_and_repeated_ids(spark):
    v, w = [1.0, 0.0, 0.0], [0.0, 3.0, 0.0]
    rows = [(1, v, 0), (1, v, 0), (2, [2.0, 0.02, 0.0], 0), (3, w, 0), (None, v, 0), (None, w, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, embed_dedup.near_vectors(df).collect()), key=str)
    # rows of one id are vectors of their own; a row without an id links with nothing
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (None, 0, None, True), (None, 0, None, True)]


def test_pipeline(spark, tmp_path):
    rng = random.Random(4)
    body = lambda n=60: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    shared, item = "a line that recurs in many documents", body(30)
    docs = [(i, f"{shared}\n{body()}", "en", f"s{i % 3}", 0) for i in range(60)]
    twice = body()
    docs += [(99, twice, "en", "s0", 0), (100, twice, "en", "s0", 0), (101, f"{body()} {item}", "en", "s1", 0), (102, None, None, None, None)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    now, seen = spark.read.parquet(f"file://{tmp_path}/documents.parquet"), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, f"file://{tmp_path}")
        if i < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"file://{tmp_path}/{i}")
        now = spark.read.parquet(f"file://{tmp_path}/{i}")
        seen[name] = {r.doc_id: r.text for r in now.collect()}
    assert len(seen["toxicity"]) == 64 and sum(shared in (t or "") for t in seen["line_dedup"].values()) == 1
    assert 100 not in seen["simhash_dedup"] and len(seen["simhash_dedup"]) == 63
    assert set(seen["simhash_dedup"]) - set(seen["decontamination"]) == {101}
    assert 0 < len(seen["mixing"]) <= 62


def written(spark, df, path):
    df.write.parquet(path)
    return spark.read.parquet(path)


def test_pipeline_drops_toxic_documents(spark, tmp_path):
    """With labels the first stage rejects what it was shown, also among documents whose labels it never saw."""
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(400):
        w = [f"w{rng.randrange(300)}" for _ in range(60)]
        if i % 4 == 0:
            for k in range(5):
                w.insert(rng.randrange(len(w)), rng.choice(["grumble", "snarling", "vexatious"]) + ("s" if k % 2 else ""))
        docs.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(i % 4 == 0)))
    docs = spark.createDataFrame([*docs, (None, None, None, None, None), (900, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    written(spark, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), f"file://{tmp_path}/labels.parquet")
    kept = corpus_pipeline.STAGES[0][1](spark, docs, f"file://{tmp_path}")
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and {None, 900} <= ids
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    for some in (range(400), held):
        assert sum((i in ids) == (i % 4 != 0) for i in some) >= 0.97 * len(some)


def test_pipeline_of_awkward_tables(spark, tmp_path):
    """Empty tables, nulls, repeated rows and ids, and columns with the names that stages use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted string, size string, key string, n_lines string, kept string"
    rows = [(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (1, "another text of the same id", None, None, None), (None, None, None, None, None), (None, "", "en", None, 0), (2, "word " * 30_000, "en", "s", 1), (3, "\n\n", "en", "s", 2)]
    written(spark, spark.createDataFrame([], "doc_id long, quality int, toxic int"), f"file://{tmp_path}/labels.parquet")
    written(spark, spark.createDataFrame([(None, None), (1, ""), (2, "no such item in any of them at all")], "item_id long, text string"), f"file://{tmp_path}/benchmark.parquet")
    for name, data in (("none", []), ("some", [(*r, *"abcdef") for r in rows])):
        now = spark.createDataFrame(data, schema)
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = written(spark, stage(spark, now, f"file://{tmp_path}"), f"file://{tmp_path}/{name}{i}")
            if i < 4:
                assert out.columns == now.columns
                assert all((r.score, r.key, r.kept) == ("a", "d", "f") for r in out.collect())
                now = out
        assert (now.count() == 0) == (name == "none")
        if data:  # of equal texts one row stays; nulls and empty texts are no copies of others
            texts = [(r.text or "") for r in now.collect()]
            assert texts.count("a b c") == 1 and "another text of the same id" in texts and any(len(t) > 100_000 for t in texts)


def test_pipeline_near_copies(spark):
    rng = random.Random(6)
    docs, want = [], {}
    for i in range(60):
        w = [f"w{rng.randrange(9000)}" for _ in range(400)]
        copy = list(w)
        for at in rng.sample(range(400), 1 + i % 12):
            copy[at] = "changed"
        a, b = ({tuple(x[k : k + 5]) for k in range(396)} for x in (w, copy))
        docs += [(2 * i, " ".join(w), "en", "s", 0), (2 * i + 1, " ".join(copy), "en", "s", 0)]
        want[2 * i + 1] = len(a & b) / len(a | b)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()}
    assert min(want.values()) < 0.8 and kept == {2 * i for i in range(60)} | {i for i, j in want.items() if j < 0.8}


def test_pipeline_judges_rows_not_ids(spark):
    rng = random.Random(7)
    body = lambda: " ".join(f"w{rng.randrange(9000)}" for _ in range(60))
    a, b, c, d, e = (body() for _ in range(5))
    docs = [(1, a, "en", "s", 0), (2, a, "en", "s", 0), (2, b, "en", "s", 0), (3, c, "en", "s", 0), (3, d, "en", "s", 0), (None, e, "en", "s", 0), (None, body(), "en", "s", 0), (None, a, "en", "s", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()]
    assert sorted(kept, key=str) == sorted([docs[i][:2] for i in (0, 2, 3, 4, 5, 6)], key=str)


def test_near_copies_do_not_hang_on_fingerprints(spark):
    """Whatever the bits say is looked at first, the groups are those of brute force: no forest, one tree of all, no likely pair."""
    rng = random.Random(8)
    docs = []
    for i in range(12):  # texts that drift from version to version, and some that share a passage only
        w = [f"w{rng.randrange(9000)}" for _ in range(60 + 40 * (i % 3))]
        for _ in range(14):
            docs.append(" ".join(w))
            w = list(w)
            for at in rng.sample(range(len(w)), rng.choice([1, 2, 4])):
                w[at] = f"w{rng.randrange(9000)}"
    passage = " ".join(f"p{i}" for i in range(30))
    docs += [passage + " " + " ".join(f"w{rng.randrange(9000)}" for _ in range(rng.choice([2, 4, 8, 30]))) for _ in range(40)]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, docs)]
    want = list(range(len(docs)))
    for b in range(len(docs)):
        for a in range(b):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and want[a] != want[b]:
                old, new = max(want[a], want[b]), min(want[a], want[b])
                want = [new if x == old else x for x in want]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)
    for near, far in ((8, 22), (-1, -1), (64, 64), (20, 0)):
        group: dict[int, list[int]] = {}
        for r in near_copies.groups(df, near, far).collect():
            group.setdefault(r.group, []).append(r.doc_id)
        got = {i: min(ids) for ids in group.values() for i in ids}
        assert [got[i] for i in range(len(docs))] == want, (near, far)
    assert 20 < len(set(want)) < len(docs)


def test_parities_never_overstate():
    rng = np.random.default_rng(9)
    sets = [rng.integers(0, 1 << 63, int(k)).astype(np.uint64) for k in (1, 5, 40, 300, 300, 70_000)]
    sets += [np.concatenate([s[: s.size * 9 // 10], rng.integers(0, 1 << 63, s.size // 8 + 1).astype(np.uint64)]) for s in sets]
    bits = [near_copies.parities(s) for s in sets]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    least = near_copies.differences(bits, i, j)
    true = [len(set(sets[a].tolist()) ^ set(sets[b].tolist())) for a, b in zip(i.tolist(), j.tolist())]
    assert (least <= true).all() and least[(i != j)].max() > 100
