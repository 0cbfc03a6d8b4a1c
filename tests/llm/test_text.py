"""Tokens, fingerprints, windows and lines against plain versions."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash

from tidemark.llm import bpe, decontaminate, line_dedup, similar, simhash, token_counts
from tidemark.llm import components as components_of

BPE, UNIGRAM = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, Decoded string"


def docs(spark, texts):
    rows = [(i if i != 4 else None, t, "en", "s", len(t or ""), "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


HARD = ["", None, "a", "the the the the", "x", "<|endoftext|> it's <|endoftext|>", "naïve  \t\n\nÉCOLE 漢字かな 12½ \x1c\x85 z", "w" * 5000, "é" * 700, " ".join(f"w{i % 97}" for i in range(4000)), "a", "퟿🏽 ___ 'll!!"]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def test_bpe_equals_the_library(reference):
    own, rng = bpe.ByteBPE(BPE), random.Random(3)
    pieces = [t.decode("utf-8", "ignore") for t in own.tokens]
    texts = [t for t in HARD if t] + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 15))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randint(0, 0x2FFF), rng.randint(0xA000, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(12)) for _ in range(500)]
    for t in texts:
        ids = reference.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(t), "<u4").tolist() == ids
        assert own.decode(own.encode(t)) == reference.decode(ids, skip_special_tokens=False)


def test_bpe_checks_its_vocabulary(monkeypatch):
    own = bpe.ByteBPE(BPE)
    own.check()
    a, b, c = (own.rank[x] for x in (b"a", b"b", b"c"))
    # A merge of ab before one of bc and a|bc: "abc" would be made of ab and c.
    monkeypatch.setattr(own, "merged", {(a, b): 256, (b, c): 257, (a, 257): 258})
    monkeypatch.setattr(own, "halves", [*own.halves[:256], (a, b), (b, c), (a, 257)])
    monkeypatch.setattr(own, "tokens", [*own.tokens[:256], b"ab", b"bc", b"abc"])
    with pytest.raises(ValueError, match="b'abc'"):
        own.check()


def test_bpe_decodes_any_ids(reference):
    own, rng = bpe.ByteBPE(BPE), random.Random(4)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 20))]
        assert own.decode(np.array(ids, "<u4").tobytes()) == reference.decode(ids, skip_special_tokens=False)


def test_bpe_on_rows(spark, reference):
    out = bpe.round_trip(docs(spark, HARD), BPE)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "token_ids", "n_tokens", "decoded"]
    rows = out.collect()
    assert len(rows) == len(HARD)
    for r in rows:
        ids = reference.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["token_ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids) and r["decoded"] == (r["text"] or "")
    again = bpe.decode(out.select("doc_id", "token_ids"), BPE).collect()
    assert Counter(r["decoded"] for r in again) == Counter(t or "" for t in HARD)
    assert bpe.round_trip(docs(spark, HARD).filter("false"), BPE).count() == 0


def viterbi(trie, word):
    s = token_counts.SPACE + word
    best = [(0.0, 0)] + [None] * len(s)
    for d in range(1, len(s) + 1):
        n = len(s[d - 1].encode())
        choices = [(best[d - 1][0] + n * trie.byte_score, -(best[d - 1][1] + n))]
        for start in range(d):
            if s[start:d] in trie.pieces:
                choices.append((best[start][0] + trie.pieces[s[start:d]], -(best[start][1] + 1)))
        top = max(choices)
        best[d] = (top[0], -top[1])
    return best[-1][1]


def test_token_counts(spark):
    trie, rng = token_counts.load(UNIGRAM), random.Random(5)
    words = ["".join(rng.choice("abcdefgéñ漢thering") for _ in range(rng.randint(1, 12))) for _ in range(800)] + ["w" * 300]
    for w in [*words, *words[:50]]:
        assert trie.count(w) == viterbi(trie, w)
    rows = token_counts.count_tokens(docs(spark, HARD), UNIGRAM).collect()
    assert {(r["text"], r["n_words"], r["n_tokens"]) for r in rows} == {(t, len((t or "").split()), sum(viterbi(trie, w) for w in (t or "").split())) for t in HARD}
    small = token_counts.UnigramTrie({"a": -1.0, "ab": -2.0, "b": -1.0}, -9.0)
    state = small._state(small._state(0, "a"), "b")
    assert small._forward("ab", 2, state, [0, 1, 2], [0.0, -1.0], [0, 1]) == (-2.0, 1)  # of equal scores, the fewer tokens
    trie.clear()
    assert trie.count(words[0]) == viterbi(trie, words[0]) and words[0] in trie.before


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(links, ids):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_golay_code():
    rem, error, near = simhash.golay()
    words = np.arange(4096) << 11 | rem
    assert min(int(w).bit_count() for w in words[1:]) == 7
    assert len(set(error.tolist())) == 2048
    x = np.arange(0, 1 << 23, 977)
    own, keys = simhash.golay_keys(x)
    for v, k in zip(x[::50].tolist(), keys[::50], strict=True):
        assert set(k.tolist()) == {i for i, w in enumerate(words.tolist()) if (v ^ w).bit_count() <= 4} | {int(k[0])}
    for b in range(23):
        other = simhash.golay_keys(x ^ (1 << b))[1]
        assert (other == own[:, None]).any(axis=1).all()


def test_keys_meet_within_three_bits():
    rng = np.random.default_rng(1)
    x = rng.integers(-(2**63), 2**63, 400, dtype=np.int64)
    flips = list(combinations(range(64), 1)) + [tuple(rng.choice(64, n, replace=False)) for n in (2, 3) for _ in range(600)]
    for bits in flips:
        a = x[rng.integers(len(x))]
        b = a ^ np.bitwise_or.reduce(np.array([1], np.uint64) << np.array(bits, np.uint64)).view(np.int64)
        pair = np.array([a, b])
        row, key, prow, pkey = simhash.keys(pair)
        assert set(key[row == 0].tolist()) & set(pkey[prow == 1].tolist())


def test_simhash_on_rows(spark):
    rng = random.Random(6)
    base = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta".split()) + str(rng.randint(0, 50)) for _ in range(300)) for _ in range(6)]
    texts = [*HARD, *base]
    for t in base:
        for _ in range(6):
            w = t.split()
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    rows = simhash.near_duplicates(docs(spark, texts)).collect()
    ids = [i for i in range(len(texts)) if i != 4]
    fps = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    root = groups([(a, b) for a, b in combinations(range(len(texts)), 2) if (fps[a] ^ fps[b]).bit_count() <= 3], range(len(texts)))
    assert {(r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in rows if r["doc_id"] is not None} == {(i, fps[i], root[i]) for i in ids}
    assert len(rows) == len(texts) and root[4] == 4  # alone, and so its group has no name
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None]
    assert simhash.near_duplicates(docs(spark, texts).filter("false")).count() == 0


def test_simhash_keys_are_never_broadcast(spark):
    few = similar.cut(spark.createDataFrame([(i * 2654435761,) for i in range(100)], "fp long"))  # of a known size
    plan = simhash.links(few)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_pipeline_finds_similar_texts(spark):
    import corpus_pipeline

    rng = random.Random(10)
    base = [" ".join(f"w{rng.randint(0, 10**5)}" for _ in range(rng.randint(40, 300))) for _ in range(8)]
    texts = [*HARD, *base]
    for t in base:
        for _ in range(8):
            w = t.split()
            for _ in range(rng.randint(1, max(1, len(w) // 20))):
                w[rng.randrange(len(w))] = rng.choice(["Changed", "other"])
            texts.append(" ".join(w))
    words = [(t or "").encode().lower().split() for t in texts]
    sets = [{b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    alike = lambda a, b: a == b or 100 * len(a & b) >= 80 * len(a | b)
    links = [(a, b) for a, b in combinations(range(len(texts)), 2) if alike(sets[a], sets[b])]
    fps = [plain_fingerprint(t) for t in texts]
    assert sum((fps[a] ^ fps[b]).bit_count() > 3 for a, b in links) > 20  # 3 bits would miss these
    root = groups(links, range(len(texts)))
    df = docs(spark, texts)
    assert {(r["doc_id"], r["component_id"]) for r in similar.near_duplicates(df).collect() if r["doc_id"] is not None} == {(i, root[i]) for i in range(len(texts)) if i != 4}
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, df, "").collect() if r["doc_id"] is not None)
    assert kept == sorted(i for i in range(len(texts)) if root[i] == i and i != 4)
    assert similar.near_duplicates(df.filter("false")).count() == 0


def test_pairs_of_a_large_group_of_edited_copies(spark, monkeypatch):
    """Copies that mostly don't reach 0.8 with each other share bands by the thousand; few pairs are compared, no link is lost."""
    rng = random.Random(12)
    base = [f"w{rng.randint(0, 10**5)}" for _ in range(150)]
    texts = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randint(2, 9)):
            w[rng.randrange(len(w))] = f"edit{rng.randint(0, 30)}"
        texts.append(" ".join(w))
        if i % 10 == 0:  # its own copies
            for at in rng.sample(range(150), 2):
                texts.append(" ".join([*w[:at], "again", *w[at + 1 :]]))
    sets = [{" ".join(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    root = groups([(a, b) for a, b in combinations(range(len(sets)), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])], range(len(sets)))
    counts, put = {}, similar.cut

    def counted(df, label="cut"):
        out = put(df, label)
        counts[label] = out.count()
        return out

    monkeypatch.setattr(similar, "cut", counted)
    rows = similar.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in rows} == {(i, root[i]) for i in range(len(texts))}
    assert len(set(root.values())) > 100 and counts["open"] > 100
    assert counts["rest-pairs"] < 10 * len(texts)


def test_few_rows_go_to_few_files(spark, monkeypatch):
    """Tables of a few rows are one file each though a shuffle has many partitions, and links stay whole."""
    rng = random.Random(9)
    base = [[f"w{rng.randrange(3000)}" for _ in range(60)] for _ in range(40)]
    texts = [" ".join(w) for w in base] + [" ".join([*w, f"x{i}"]) for w in base for i in range(2)]
    files, put = {}, similar.cut

    def counted(df, label="cut"):
        out = put(df, label)
        files.setdefault(label, []).append(len(out.inputFiles()))
        return out

    for of in (similar, components_of):
        monkeypatch.setattr(of, "cut", counted)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        rows = similar.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert {(r["doc_id"], r["component_id"]) for r in rows} == {(i, i if i < 40 else (i - 40) // 2) for i in range(120)}
    narrow = ("many", "shared", "met", "centres", "bands", "fingerprints", "star-wanted", "grouped", "open", "open-wanted", "result")
    assert {label: max(files[label]) for label in narrow} == dict.fromkeys(narrow, 1)
    assert set(files["edges"][1:]) >= {1} and sum(n > 1 for n in files["edges"]) <= 2  # the first of either call is as it comes


def test_pipeline_links_by_fingerprints(spark, monkeypatch):
    """Sets that share no band are linked by their fingerprints' Golay keys, if they are alike."""
    from pyspark.sql import functions as F

    rng = random.Random(14)
    base = [" ".join(f"w{rng.randint(0, 10**5)}" for _ in range(200)) for _ in range(5)]
    texts = [*base, *(f"{t} more" for t in base), "one two", "three four"]
    sets = [similar.shingles(t.encode()) for t in texts]
    fps = [simhash.majority(x) for x in sets]
    assert all((fps[i] ^ fps[i + 5]).bit_count() <= 3 for i in range(5))
    assert fps[-1] == simhash.fingerprint(b"three four")
    sketches = similar._sketches
    monkeypatch.setattr(similar, "_sketches", lambda *a: sketches(*a).withColumn("bands", F.array().cast("array<bigint>")))
    rows = similar.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {i: i - 5 if 5 <= i < 10 else i for i in range(12)}
    same = spark.createDataFrame([(b"a", 100, 7), (b"b", 100, 7), (b"c", 10, 7), (b"d", 90, 8), (b"e", 90, 7 ^ 15 << 20), (b"f", 95, 6)], "key binary, n int, fp long")
    assert {(bytes(r["a"]), bytes(r["b"])) for r in similar._by_fingerprint(same, 80).collect()} == {(b"a", b"b"), (b"f", b"a"), (b"f", b"d")}


def plain_windows(documents, items):
    word, low = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: word.findall((t or "").translate(low))
    windows = defaultdict(set)
    for i, t in items:
        w = split(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    out = []
    for t in documents:
        w, hit, found = split(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[g]
        out.append((t, len(w), len(hit), tuple(sorted(found))))
    return Counter(out)


@pytest.mark.parametrize("short", [False, True])
def test_decontamination(spark, short):
    rng = random.Random(7)
    some = lambda n: " ".join(rng.choice("red Green BLUE café ÉTÉ 7up tan".split()) for _ in range(n))
    items = [(i, some(rng.randint(10, 30))) for i in range(8)] + [(0, "red " * 25), (9, None), (9, "")]
    items += [(20, "tan"), (21, "Blue, café"), (22, some(4)), (23, some(7))] if short else []
    texts = [*HARD, *(some(rng.randint(0, 60)) for _ in range(40)), "red " * 300, *(some(20) + " -- " + (rng.choice(items)[1] or "")[:60] + "! " + (items[i][1] or "") + some(5) for i in range(8)), items[2][1], "Σίγμα ΑΣ " + items[3][1]]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n_hit int")
    out = decontaminate.decontaminate(docs(spark, texts).withColumnRenamed("Decoded", "N_HIT"), bench).collect()
    assert Counter((r["text"], r["n_words"], r["n_hit"], tuple(r["item_ids"])) for r in out) == plain_windows(texts, items)
    assert all(r["contaminated"] == (r["n_hit"] > 0) and r["n_items"] == len(r["item_ids"]) for r in out)


def test_decontamination_of_nothing(spark):
    bench = spark.createDataFrame([(1, None)], "item_id long, text string")
    out = decontaminate.decontaminate(docs(spark, HARD), bench).collect()
    assert len(out) == len(HARD) and not any(r["n_hit"] for r in out)
    assert decontaminate.decontaminate(docs(spark, HARD).filter("false"), bench).count() == 0


def test_line_dedup(spark):
    rng = random.Random(8)
    line = lambda: " ".join(rng.choice("one two three four five six".split()) + str(rng.randint(0, 999)) for _ in range(8))
    passage, long_ = [line() for _ in range(9)], " ".join(f"q{i}" for i in range(60))
    clean = ["\n".join(line() for _ in range(12)) for _ in range(5)]
    planted = ["\n".join([line(), line(), *passage, line()]) for _ in range(4)] + [line() + "\n" + long_ + "\n" + line(), long_, long_]
    texts = ["", None, "a\nb", "a\nb", "x", *clean, *planted, clean[0]]
    out = line_dedup.dedup_lines(docs(spark, texts).withColumnRenamed("Decoded", "N_Removed"))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_removed"]
    rows = {r["doc_id"]: r for r in out.collect()}
    assert len(rows) == len(texts)
    got = lambda i: rows[i]
    for i in range(10):
        if i != 4:
            assert got(i)["text"] == texts[i] and got(i)["n_removed"] == 0
    assert got(10)["text"] == texts[10]  # the first copy stays whole
    for i in (11, 12, 13):
        left = (got(i)["text"] or "").split("\n")
        assert not [x for x in left if x in passage] and all(x in left for x in texts[i].split("\n") if x not in passage)
        assert got(i)["n_removed"] == 12 - len(left) and got(i)["n_chars"] == len(got(i)["text"])
    assert got(14)["text"] == texts[14] and got(15)["text"] == got(16)["text"] == ""
    assert got(17)["n_removed"] >= 10
    same = spark.createDataFrame([(1, clean[1]), (1, clean[1])], "doc_id long, text string")
    assert [r["n_removed"] for r in line_dedup.dedup_lines(same).collect()] == [0, 0]
    assert line_dedup.dedup_lines(docs(spark, texts).filter("false")).count() == 0


def test_digests(spark):
    from tidemark.llm import queries

    row = queries.op9_bpe(spark, "/root/testdata/sf0.001").filter("doc_id = 3").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id = 3").first()["text"]
    assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_line_dedup_of_short_lines(spark):
    rng = random.Random(9)
    line = lambda n=7: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    shapes = [(30, 30), (20, 20, 20), (15,) * 4, (12,) * 5, (49, 2), (2, 49), (6,) * 10, (60, 30)]
    passages = [[line(n) for n in shape] for shape in shapes for _ in range(6)]
    texts = []
    for _ in range(3):
        texts += ["\n".join([line() for _ in range(rng.randint(0, 3))] + p + [line() for _ in range(rng.randint(0, 3))]) for p in passages]
    few, same = [line(25), line(24)], " ".join(f"x{i}" for i in range(1, 11))
    texts += ["\n".join([line(), *few, line()]) for _ in range(2)] + ["\n".join([same] * 30)]
    rows = {r["doc_id"]: r["text"].split("\n") for r in line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts[: 3 * len(passages)]):
        p = passages[i % len(passages)]
        assert rows[i] == ([x for x in t.split("\n") if x not in p] or [""] if i >= len(passages) else t.split("\n"))
    assert rows[len(texts) - 1][:6] == [same] * 6  # the first place stays whole, though later ones overlap it


def test_line_dedup_of_a_very_long_text(spark):
    """Linear in the lines: 200,000 of them, twice."""
    N = 200_000
    text = "\n".join(f"line {i} {i * 7919 % 100_003} of a long text" for i in range(N))
    df = spark.createDataFrame([(1, text), (2, "head\n" + text + "\ntail"), (3, "a\nb")], "doc_id long, text string").cache()
    df.count()
    started = time.perf_counter()
    rows = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    assert time.perf_counter() - started < 90
    assert rows[1]["text"] == text and rows[2]["text"] == "head\ntail" and rows[2]["n_removed"] == N and rows[3]["n_removed"] == 0


def test_line_dedup_compares_texts(spark, monkeypatch):
    """Chunks whose hashes all agree are told apart by their bytes."""
    from pyspark.sql import functions as F

    rng = random.Random(11)
    line = lambda: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(9))
    texts = ["\n".join(line() for _ in range(4)) for _ in range(6)]
    monkeypatch.setattr(line_dedup.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    df = spark.createDataFrame(list(enumerate([*texts, texts[0]])), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    assert all(rows[i]["text"] == texts[i] for i in range(6)) and rows[6]["n_removed"] >= 3


def test_hot_groups_are_joined_once(spark):
    from pyspark.sql import functions as F

    from tidemark.llm.common import join_groups

    rows = spark.range(3000).select("id", F.when(F.col("id") < 1500, 0).otherwise(F.col("id") % 400).alias("k"))
    groups = rows.groupBy("k").agg(F.count("*").alias("times"), F.max("id").alias("top"))
    got = join_groups(rows, groups.filter("k <> 7"), ["k"], ["id"])
    want = rows.join(groups.filter("k <> 7"), "k")
    assert sorted(map(tuple, got.select("id", "k", "top").collect())) == sorted(map(tuple, want.select("id", "k", "top").collect()))
    assert join_groups(rows.filter("false"), groups.filter("false"), ["k"], ["id"]).count() == 0
