"""Vectors, classifiers, archives, pages and the pipeline."""

import base64
import gzip
import hashlib
import io
import random
import time

import numpy as np
import pytest

from tidemark.llm import html, quality, toxicity, vectors, warc
from tidemark.llm.common import cut, shared_dir
from tidemark.llm.components import components

SF = "/root/testdata/sf0.001"


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3), (7, None)]
    parent = {i: i for e in edges for i in e if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {r["id"]: r["component_id"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got and all(root(i) == c for i, c in got.items())
    assert {i for i in parent if sum(root(j) == root(i) for j in parent) > 1} == set(got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute(x, least=0.9):
    n = np.linalg.norm(x, axis=1, keepdims=True)
    sim = (x / n) @ (x / n).T >= least
    np.fill_diagonal(sim, False)
    low = np.arange(len(x))
    while True:
        new = np.array([min([low[i], *low[np.flatnonzero(sim[i])]]) for i in range(len(x))])
        if (new == low).all():
            return sim.sum(1), low
        low = new


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    near = base[rng.integers(0, 60, 240)] + 0.12 * rng.normal(size=(240, 16))
    x = np.concatenate([base, near, np.repeat(base[:1], 30, 0), base[1:2] * 3]).astype("f4")
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(900, None, 0), (901, [0.0] * 16, 0), (902, [None] + [1.0] * 15, 0), (903, [float("nan")] + [1.0] * 15, 0), (904, [], 0), (905, x[0].tolist()[:8], 0), (None, x[0].tolist(), 0)]
    df = spark.createDataFrame([*rows, *odd, rows[3]], "vec_id long, embedding array<float>, N_Links int")
    for shard in (600, 40, 6):  # one shard; several; a tree of shards that are split again
        got = vectors.near_duplicates(df, shard=shard).collect()
        n, low = brute(x.astype("f8"))
        different = len(np.unique(x, axis=0))
        by = {r["vec_id"]: r for r in got}
        links = np.array([by[i]["n_links"] for i in range(len(x))])
        assert (links <= n).all() and links.sum() >= 0.97 * n.sum()
        assert all(by[i]["n_distinct"] <= min(links[i], different) for i in range(len(x)))
        if shard == 600:
            assert (links == n).all() and [by[i]["component_id"] for i in range(len(x))] == low.tolist()
        assert all(by[i]["n_links"] == 0 and by[i]["component_id"] == i and by[i]["kept"] for i in range(900, 906))
        assert by[None]["n_links"] == 0 and not by[None]["kept"]
        assert len(got) == len(rows) + len(odd) + 1
    assert vectors.near_duplicates(df.filter("false")).count() == 0


def test_vectors_of_many_shards(spark):
    """6,000 vectors in clusters that reach over shards: no link lost, within shards or between."""
    rng = np.random.default_rng(21)
    base = rng.normal(size=(400, 24))
    x = (base[rng.integers(0, 400, 6000)] + 0.2 * rng.normal(size=(6000, 24))).astype("f4")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    n, low = brute(x.astype("f8"))
    found = cut(vectors.near_duplicates(df, shard=200, overlap=2))
    got = found.toPandas().set_index("vec_id").loc[range(len(x))]
    links = got["n_links"].to_numpy()
    assert (links <= n).all() and links.sum() >= 0.999 * n.sum() and (got["n_distinct"] == got["n_links"]).all()
    same = got["component_id"].to_numpy() == low
    assert same.mean() > 0.999
    asked = np.arange(0, len(x), 50)
    assert vectors.audit(df, found) == (links[asked].sum(), n[asked].sum())


def test_links_between_shards(spark):
    """A chain of three vectors, no two neighbours of which share a shard with the third."""
    angle = np.arccos(0.95)
    v = [[float(np.cos(k * angle)), float(np.sin(k * angle))] for k in range(5)]
    info = spark.createDataFrame([(k, v[k], k + 1, [f"s{k // 2}"]) for k in range(5)], "id long, v array<double>, copies long, shards array<string>")
    united = spark.createDataFrame([(0, [1]), (1, [0, 2]), (2, [3, 1]), (3, [2, 4]), (4, [3])], "id long, near array<long>")
    first = spark.createDataFrame([(0, [2]), (1, [2, 3])], "id long, far array<long>")
    got = {tuple(r) for r in vectors._between_shards(first, united, info, 0.949).collect()}
    assert got == {(1, 2, 2, 3)}  # 3 and 4 share no list that 1 and 2 lead to but 2's: (1, 3) is too far
    wider = {tuple(r)[:2] for r in vectors._between_shards(first, united, info, 0.8).collect()}
    assert wider == {(0, 2), (1, 2), (1, 3)}
    assert vectors._between_shards(first.filter("false"), united, info, 0.9).count() == 0


def test_recall_on_the_table(spark):
    """Every vector whose id 50 divides, against all rows."""
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    p = df.toPandas()
    n, low = brute(np.stack(p["embedding"]).astype("f8"))
    got = vectors.near_duplicates(df).toPandas().set_index("vec_id").loc[p["vec_id"]]
    asked = (p["vec_id"] % 50 == 0).to_numpy()
    assert got["n_links"].to_numpy()[asked].sum() >= 0.9 * n[asked].sum() and (got["n_links"].to_numpy() <= n).all()


def test_robust_graph_and_range_search():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = vectors.range_search(x, vectors.robust_graph(x), 0.9)
    true = {(i, j) for i, j in zip(*np.nonzero(x @ x.T >= 0.9), strict=True) if i != j}
    found = set(zip(a.tolist(), b.tolist(), strict=True))
    assert found <= true and len(found) >= 0.95 * len(true)


def labelled(n, rng):
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7)))
    texts, toxic = [], []
    for _ in range(n):
        words = [word() for _ in range(rng.randint(20, 120))]
        bad = rng.random() < 0.25
        if bad:
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(len(words))] = "vexq" + word()
        texts.append(" ".join(words))
        toxic.append(int(bad))
    return texts, toxic


def test_toxicity_learns_from_positives_and_unlabelled(spark):
    texts, toxic = labelled(1500, random.Random(4))
    model = toxicity.train([t for t, y in zip(texts[:1000], toxic, strict=False) if y], texts[:1000], 0.25)
    s, y = model.score(texts[1000:]), np.array(toxic[1000:])
    assert ((s >= 0.5) == y).mean() > 0.97
    rows = [(i, t, 1) for i, t in enumerate(texts[:200])] + [(None, None, 1), (7, "", 1), (7, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Score int")
    labels = spark.createDataFrame([(i, y) for i, y in enumerate(toxic[:200])] + [(None, 1), (3, None)], "doc_id long, toxic int")
    out = toxicity.score(df, toxicity.fit(df, labels)).collect()
    assert len(out) == 203 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    nothing = toxicity.score(df, toxicity.fit(df, labels.filter("false"))).collect()
    assert {r["predicted"] for r in nothing} == {0}


def test_non_negative_risk():
    """The slope is that of the plain risk, and training brings the risk down without going below 0."""
    rng = np.random.default_rng(5)
    draw = lambda p: np.flatnonzero(rng.random(60) < p)
    toxic, clean = np.where(np.arange(60) < 12, 0.3, 0.1), np.where(np.arange(60) < 12, 0.02, 0.1)
    pos = [draw(toxic) for _ in range(150)]
    unl = [draw(toxic) for _ in range(160)] + [draw(clean) for _ in range(640)]
    pu = toxicity.NonNegativePU(0.2)

    def plain(s):
        loss = lambda z: float(np.log(1 + np.exp(-z)))
        positive = 0.2 * sum(loss(z) for z in s[:4]) / 4
        negative = sum(loss(-z) for z in s[4:]) / len(s[4:]) - 0.2 * sum(loss(-z) for z in s[:4]) / 4
        return positive, negative

    for s in (np.array([0.5, -1, 2, 0.1, -0.3, 1.5, -2, 0.7, 0.2]), np.array([5.0, 4, 6, 5, -9, -9, -9, -9, -9])):
        assert pu.risk(s, 4) == pytest.approx(plain(s))
        below = plain(s)[1] < 0
        for i in range(len(s)):
            up, down = s.copy(), s.copy()
            up[i] += 1e-5
            down[i] -= 1e-5
            total = [-plain(x)[1] if below else sum(plain(x)) for x in (up, down)]
            assert pu.slope(s, 4)[i] == pytest.approx((total[0] - total[1]) / 2e-5, abs=1e-6)
    pu.fit(pos, unl, 60)
    score = lambda sets: np.array([pu.weights[x].sum() + pu.bias for x in sets])
    before, after = (pu.risk(s, len(pos)) for s in (np.zeros(950), score([*pos, *unl])))
    assert after[0] + max(0, after[1]) < before[0] + max(0, before[1])
    s = score(unl) >= 0
    assert s[:160].mean() > 0.85 and s[160:].mean() < 0.1


def test_toxicity_against_plain_counts(spark):
    """The tables' model against one trained from lists, and scores against sums over plain features."""
    import re
    import zlib

    texts, toxic = labelled(400, random.Random(6))
    texts[5], texts[7], texts[9] = "", None, "vexq" + " ".join(texts[:9:2]) * 50
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, f string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, y in enumerate(toxic) if i % 3], "doc_id long, toxic int")
    rows = [(i, y) for i, y in enumerate(toxic) if i % 3 and not out(i)]
    prior = sum(y for _, y in rows) / len(rows)
    plain = toxicity.train([texts[i] for i, y in rows if y and texts[i] is not None], [t for i, t in enumerate(texts) if t is not None and not out(i)], prior)
    model = toxicity.fit(df, labels)
    assert model.vocabulary == plain.vocabulary and np.allclose(model.weights, plain.weights, atol=1e-9) and abs(model.prior - prior) < 1e-12

    def slow(t):
        found = set()
        for word in re.findall(r"[^\W\d_]+", (t or "").lower()):
            found |= {"w" + word} | {f"{n}{word[:n]}" for n in (3, 4, 5, 6) if len(word) >= n}
        return 1 / (1 + np.exp(-(model.bias + sum(model.weights[i] for f, i in model.vocabulary.items() if f in found))))

    got = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    assert all(abs(got[i]["score"] - slow(t)) < 1e-9 and got[i]["predicted"] == (got[i]["score"] >= 0.5) for i, t in enumerate(texts))
    assert toxicity.score(df.filter("false"), model).count() == 0 and toxicity.fit(df.filter("false"), labels).weights is None


def test_held_out_rule(spark):
    import zlib

    got = spark.range(50).select("id", toxicity.held_out(__import__("pyspark").sql.functions.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)


def test_toxicity_held_out_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.score(docs, toxicity.fit(docs, labels), keep=["doc_id"]).join(labels, "doc_id").filter(toxicity.held_out(__import__("pyspark").sql.functions.col("doc_id"))).toPandas()
    assert (out["predicted"] == out["toxic"]).mean() > 0.9


def plain_quality(rows, model):
    """{(id, text): (evidence, host's posterior, path's, probability)} of (id, text, path, host) rows."""
    sig, logit = (lambda x: 1 / (1 + np.exp(-x))), (lambda p: np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6))))
    e = [float(model.evidence(quality.describe((t or "").encode())[None, :])[0]) for _, t, *_ in rows]
    p = [sig(x + np.log(model.prior / (1 - model.prior))) for x in e]

    def group(key):
        out = {}
        for r, x in zip(rows, p, strict=True):
            out.setdefault(key(r), []).append(x)
        return out

    hosts, paths = group(lambda r: r[3]), group(lambda r: (r[3], r[2]))
    world = sum(p) / len(p)

    def strength(groups, expected):
        n, k = sum(map(len, groups.values())), len(groups)
        pq = sum(expected(g) * (1 - expected(g)) * len(v) for g, v in groups.items()) / n
        var = sum(len(v) * (sum(v) / len(v) - expected(g)) ** 2 for g, v in groups.items()) / n
        extra = max((var - pq * k / n) / (1 - k / n), 1e-4 * pq)
        return min(max(pq / extra - 1, 1.0), 1e4)

    a = strength(hosts, lambda g: world)
    host = {g: (sum(v) + a * world) / (len(v) + a) for g, v in hosts.items()}
    b = strength(paths, lambda g: host[g[0]])
    want = {}
    for (i, t, lang, source), x, q in zip(rows, e, p, strict=True):
        v = paths[source, lang]
        rest = max((sum(v) - q + b * host[source]) / (len(v) - 1 + b), 1e-6)
        want[i, t] = (x, host[source], (sum(v) + b * host[source]) / (len(v) + b), sig(x + logit(rest)))
    return want


def test_quality_against_plain_posteriors(spark, monkeypatch):
    """Every probability by the formulas, host by host and path by path; sent or joined alike."""
    rng = random.Random(14)
    words = lambda: " ".join(rng.choice(["some", "plain", "words", "here", "!!!", "$$$", "a|b"]) for _ in range(rng.randint(0, 40)))
    rows = [(i if i != 9 else None, words() if i != 8 else None, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None])) for i in range(300)]
    rows += [rows[3], (500, "x" * 100_000, "fr", "solo")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    labels = spark.createDataFrame([(i, int("!!!" not in (t or "!!!"))) for i, t, *_ in rows if i is not None and i < 120], "doc_id long, quality int")
    want = plain_quality(rows, quality.fit(df, labels))
    for sent in (quality.MOST_SENT, 0):
        monkeypatch.setattr(quality, "MOST_SENT", sent)
        got = quality.classify(df, labels).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r["evidence"], r["host_quality"], r["path_quality"], r["quality_prob"]) == pytest.approx(want[r["doc_id"], r["text"]], abs=1e-9)
            assert r["accepted"] == (r["quality_prob"] >= 0.5)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    train, test = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    out = quality.classify(docs, train).join(test, "doc_id").toPandas()
    assert (out["accepted"] == (out["quality"] == 1)).mean() > 0.97


def test_quality_rows(spark):
    rows = [(1, "good prose here.", None, "h", "clash"), (1, "good prose here.", None, "h", "clash"), (2, None, "en", None, "c"), (None, "", "en", "h", "c"), (3, "!!! $$$ ***", "en", "h", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, Evidence string")
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, 0), (None, 1), (2, None)], "doc_id long, quality int")
    out = quality.classify(df, labels)
    assert out.count() == 5 and "Evidence" not in out.columns and out.filter("quality_prob is null or accepted is null").count() == 0
    free = quality.classify(df, labels.filter("false"))
    assert free.filter("accepted").count() == 5 and quality.classify(df.filter("false"), labels).count() == 0


def test_sparse_groups_shrink(spark):
    from pyspark.sql import functions as F

    g = spark.createDataFrame([(1.0, 1), (900.0, 1000)], "good double, n long").withColumn("strength", F.lit(20.0))
    got = [r[0] for r in g.select(quality.shrunk(g, F.lit(0.5))).collect()]
    assert abs(got[0] - 11 / 21) < 1e-12 and abs(got[1] - 910 / 1020) < 1e-12


def test_warc_round_trip(spark):
    pages = ["<p>one</p>", "", None, "<p>one</p>", "é" * 1000, "two\r\n\r\nWARC/1.0\r\n", "<p>one</p>", "big " * 50_000, "long url"]
    rows = [(i * 10, (f"http://h/{i}" if t != "long url" else "data:" + "u" * 400_000) if i != 4 else None, t, "x") for i, t in enumerate(pages)] + [(None, "http://n", "<p>one</p>", "x"), (0, "http://h/0", "<p>one</p>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, Payload string").repartition(3)
    for compress in (True, False):
        files = warc.write(df, f"{shared_dir(spark)}/w{compress}", compress=compress)
        records = cut(warc.read(files))
        assert records.filter("kind = 'gap'").count() == 0
        got = warc.pages(records).collect()
        assert len(got) == len(rows)
        first = {}
        for i, _, t, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
            first.setdefault(t or "", i)
        for r in got:
            want = next(t for i, _, t, _ in rows if i == r["page_id"]) or ""
            b = want.encode()
            assert (r["payload_bytes"], r["payload_digest"]) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
            own = first[want] == r["page_id"]
            assert (r["record_type"], r["refers_to"]) == (("response", None) if own else ("revisit", first[want]))
    least = warc.pages(warc.read(warc.write(df, f"{shared_dir(spark)}/wl", least=100))).collect()
    assert {r["record_type"] for r in least} == {"response"}
    assert warc.read(warc.write(df.filter("false"), f"{shared_dir(spark)}/we")).count() == 0


def recovered(data):
    return [(k, at, n, b, reason) for k, at, n, h, b, reason in warc.salvage(io.BytesIO(data), len(data))]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    pack = warc.member if packed else bytes
    made = [pack(warc.record("response", f"urn:page:{i}", "http://h", "2024-01-01T00:00:00Z", f"page {i} ".encode() * 40)) for i in range(6)]
    starts = np.cumsum([0, *map(len, made)]).tolist()
    whole = b"".join(made)
    assert [r[0] for r in recovered(whole)] == ["record"] * 6
    broken = bytearray(whole)
    broken[starts[2] + len(made[2]) // 2] ^= 0xFF
    got = recovered(bytes(broken))
    assert [(k, at, n) for k, at, n, _, _ in got] == [("gap" if i == 2 else "record", starts[i], len(made[i])) for i in range(6)]
    assert got[2][4]
    junk = b"junk" + whole[: starts[1]] + b"\x1f\x8b\x08 WARC/1.0\r\n" + whole[starts[1] : starts[3] + 30]
    assert [r[0] for r in recovered(junk)] == ["gap", "record", "gap", "record", "record", "gap"]
    assert sum(r[2] for r in recovered(junk)) == len(junk)
    assert recovered(b"") == [] and [r[0] for r in recovered(b"\0" * 3_000_000)] == ["gap"]
    if packed:
        assert [r[0] for r in recovered(gzip.compress(b"not a record") + whole)] == ["gap"] + ["record"] * 6


PAGE = '<html><head><title>t</title><style>p{}</style><script>if (a<b) "</p>";</script></head><body><nav><ul><li>Home</li></ul></nav>{}<footer>&copy; x</footer></body></html>'


@pytest.mark.parametrize(("body", "text"), [
    ("<article><h1>A &amp; B&lt;</h1><p>one\n two&nbsp;three<p>four<br>five</article>", "A & B<\none two three\nfour five"),
    ("<article><p><b>open.<br><p>next</p></article><div class='ad'>buy</div>", "open.\nnext"),
    ("<main><aside>x</aside><p>m</p></main>", "m"),
    ("<main><p>intro</p><article><p>a</p></article></main>", "a"),
    ("<article><p>a</p><div class=\"comments\"><p>c</p></div><form>f</form><p hidden>h</p><p>b</p></article>", "a\nb"),
    ("<article><ul><li>x<li>y</ul><table><tr><td>1<td>2</table></article>", "x\ny\n1\n2"),
    ("<article><p>a <!-- c <p> --> b <a title='x>y'>c</a></p><script>var x='<p>n</p>'</script></article>", "a b c"),
    ("<article><p>&#233;&eacute;&unknown; &am</p></article>", "éé&unknown; &am"),
    ("<article></article>", ""),
    ("", ""),
    ('<article><p style="overflow:hidden">a</p><p>see <a href="/the-hidden-valley">the valley</a> now</p><p data-id="widget">d</p></article>', "a\nsee the valley now\nd"),
    ('<article><div class="ad-free">e</div><h2 class="section-header">f</h2><p class="comment">g</p></article>', "e\nf\ng"),
    ("<article><p title=it's>one</p><p title='a>b' data-x=\"c>d\">two</p></article>", "one\ntwo"),
    ("<b><article>a</b> c</article> out", "a c"),
    ("<article>a <b>b</article></b><p>out</p>", "a b"),
    ('<article><div class="comments">x</div><div role="navigation">y</div><section id="share-links">z</section></article>', "z"),
])
def test_articles(spark, body, text):
    assert html.finish(html.blocks(PAGE.replace("{}", body)), [])[0] == text


def test_pages_without_an_article(spark):
    shared = "<div>subscribe to our weekly letter and get all of the news</div>"
    own = [f"<div>story {i} " + " ".join(f"w{i}x{j}" for j in range(20)) + "</div>" for i in range(4)]
    rows = [(i, "http://A.com/x" if i < 3 else "http://b.com/y", f"<html><body>{shared}{own[i]}<nav>menu</nav></body></html>", "c") for i in range(4)]
    rows += [(10, "http://a.com/z", f"<body><article><p>{'same words ' * 9}</p></article>{shared}</body>", "c"), (11, None, None, "c"), (12, "no url", "", "c"), (0, *rows[0][1:])]
    rows += [(13, "http://a.com/z", f"<body><article><p>{'same words ' * 9}</p></article></body>", "c"), (None, "http://c.com", "<p>only &amp; this</p>", "c")]
    out = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, N_Chars string"))
    assert out.columns == ["page_id", "url", "text", "n_chars", "cut_repeated", "cut_structure"]
    got = {(r["page_id"], r["url"]): r["text"] for r in out.collect()}
    assert out.count() == len(rows)
    for i in range(4):
        want = own[i][5:-6] if i < 3 else shared[5:-6] + "\n" + own[i][5:-6]  # b.com has one page
        assert got[i, rows[i][1]] == want
    assert got[10, "http://a.com/z"] == got[13, "http://a.com/z"] == ("same words " * 9).strip()
    assert got[11, None] == got[12, "no url"] == "" and got[None, "http://c.com"] == "only & this"
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
    assert html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, t string").filter("false")).count() == 0


def test_a_head_left_open_and_a_long_page():
    body = "<title>t</title><meta a=b><style>x</style><p>one</p><p>two"
    assert [b[0] for b in html.blocks("<html><head>" + body)] == ["one", "two"] == [b[0] for b in html.blocks("<head><title>t</title>" + body[16:].replace("<p>one</p>", "one"))]
    for part in ("<div>", "</p>", "<p>", '<a b="', "<script>", "<b c='x'", "<td>", "<", "<!--"):
        started = time.perf_counter()
        html.blocks(part * 60_000 + "</p>" * 60_000)
        assert time.perf_counter() - started < 3, part


def plain_extract(rows, depth=html.DEPTH):
    """Every stretch of ``depth`` tokens of each page against all those of the host's other pages."""
    streams = []
    for _, url, page in rows:
        got, words, origin = html.blocks(page or ""), [], []
        for i, (text, _, _, border) in enumerate(got):
            words += ["\n" + border, *text.split(" ")]
            origin += [None, *[i] * len(text.split(" "))]
        streams.append((url.split("/")[2].lower(), "\n".join(b[0] for b in got), got, [*words, "\n"], [*origin, None]))
    runs = [{tuple(w[i : i + depth]) for i in range(len(w) - depth + 1)} for _, _, _, w, _ in streams]
    out = []
    for k, (host, body, got, words, origin) in enumerate(streams):
        gone = set()
        for i in range(len(words) - depth + 1):
            if any(h == host and b != body and tuple(words[i : i + depth]) in runs[j] for j, (h, b, *_) in enumerate(streams)):
                edges = [j for j in range(i, i + depth) if origin[j] is None]
                gone |= set(range(edges[0], edges[-1] + 1) if edges else range(i, i + depth))
        article = any(main and mark < 2 for _, main, mark, _ in got)
        lines = []
        for b, (text, main, mark, _) in enumerate(got):
            if main and not mark:
                lines.append(text)
            elif mark < 2 and (main or not article):
                lines.append(" ".join(words[j] for j in range(len(words)) if origin[j] == b and j not in gone))
        out.append("\n".join(x for x in lines if x))
    return out


@pytest.mark.parametrize("most_sent", [html.MOST_SENT, 0])
def test_pages_against_all_stretches(spark, most_sent):
    rng = random.Random(12)
    word = lambda: rng.choice("ab") + str(rng.randint(0, 6))
    some = lambda n: " ".join(word() for _ in range(rng.randint(1, n)))
    phrases = [some(14) for _ in range(12)]
    block = lambda: rng.choice(["<p>{}</p>", "<div class='share-box'>{}</div>", "<nav><li>{}<li>x</nav>", "<div>{}</div>"]).format(rng.choice([rng.choice(phrases), some(20), rng.choice(phrases) + " " + some(5)]))
    page = lambda: "".join(block() for _ in range(rng.randint(0, 6)))
    rows = []
    for i in range(60):
        kind = rng.randrange(3)
        body = page() if kind else f"{page()}<article>{page()}</article>{page()}"
        rows.append((i, f"http://h{rng.randrange(3)}.com/{i}", body))
    rows += [(100 + i, f"http://h0.com/{i}", rows[i][2]) for i in range(3)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), most_sent=most_sent).collect()}
    want = plain_extract(rows)
    assert [got[r[0]] for r in rows] == want and sum(map(bool, want)) > 40
    hinted = [r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), most_sent=most_sent).collect() if r["cut_repeated"]]
    assert len(hinted) > 10


def test_pages_with_clashing_columns(spark):
    rows = [(1, "http://h/1", f"<p>{'a b c ' * 9}</p>", "h", 2, "x", 1, "t"), (2, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, page long, article string, __key long, c0 string")
    for most_sent in (html.MOST_SENT, 0):
        got = sorted(html.extract(df, most_sent=most_sent).drop("cut_repeated", "cut_structure").collect(), key=lambda r: r["page_id"])
        assert tuple(got[0]) == (1, "http://h/1", "h", 2, "x", 1, "t", ("a b c " * 9).strip(), 53) and got[1]["text"] == "" and got[1]["article"] is None


def test_copies_of_a_page_without_an_article(spark):
    menu = "<div>subscribe to our weekly letter and get all of the news</div>"
    story = [" ".join(f"w{i}x{j}" for j in range(20)) for i in range(3)]
    page = lambda i, tag="div": f"<body>{menu}<{tag}>{story[i]}</{tag}></body>"
    rows = [(1, "http://a.com/x", page(0)), (2, "http://a.com/y", page(0)), (3, "http://a.com/z", page(0, "p"))]
    rows += [(4, "http://b.com/x", page(1)), (5, "http://b.com/y", page(1)), (6, "http://b.com/z", page(2))]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == menu[5:-6] + "\n" + story[0] for i in (1, 2, 3))  # one page: nothing recurs
    assert got[4] == got[5] == story[1] and got[6] == story[2]


def test_audit(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([b + 0.02 * rng.normal(size=(20, 8)) for b in rng.normal(size=(15, 8))]).astype("f4")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    n, _ = brute(x.astype("f8"))
    asked = n[np.arange(0, len(x), 50)].sum()
    assert vectors.audit(df, vectors.audited(df)) == (asked, asked)
    twice = df.union(df.selectExpr("vec_id + 1000", "embedding"))  # copies weigh nothing
    assert vectors.audit(twice, vectors.audited(twice)) == (asked, asked)
    none = df.selectExpr("vec_id", "0L as n_distinct")
    assert vectors.audit(df, none) == (0, asked) and vectors.audit(df.filter("false"), none) == (0, 0)
