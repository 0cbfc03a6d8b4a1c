"""The pipeline: each stage's rows, and the whole against plain versions."""

from itertools import combinations

import duckdb
import pandas as pd
import pytest
from test_others import plain_quality

import corpus_pipeline as p
from tidemark.llm import queries, quality
from tidemark.llm.common import cut, shared_dir

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for name, stage in p.STAGES:
        out = cut(stage(spark, docs, SF), name)
        counts.append(out.count())
        if name != "tokens":
            assert out.columns == p.DOCUMENTS
            docs = out
    assert counts[0] > counts[1] == counts[2] >= counts[3] >= counts[4] == counts[5] > 0
    assert docs.filter("n_chars <> length(text)").count() == 0


def test_the_whole_against_plain_versions(spark):
    from tokenizers import Tokenizer

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    good = plain_quality([r[:4] for r in rows], quality.fit(docs, labels))
    rows = [r for r in rows if good[r[0], r[1]][3] >= 0.5]

    def sql(name):
        db = duckdb.connect()
        db.register("documents", pd.DataFrame(rows, columns=p.DOCUMENTS))
        db.execute(f"create view benchmark as select * from '{SF}/benchmark.parquet'")
        got = db.execute(queries.ORACLE_SQL[name]).df().set_index("doc_id")
        return {i: got.loc[i] for i in got.index}

    lines = sql("op4_line_dedup")
    rows = [(r[0], lines[r[0]]["text"], r[2], r[3], int(lines[r[0]]["n_chars"])) for r in rows]
    sets = {}
    for i, t, *_ in rows:
        w = t.encode().lower().split()
        sets[i] = {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    low = {i: i for i in sets}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x == y or 100 * len(x & y) >= 80 * len(x | y):
            a, b = sorted((root(a), root(b)))
            low[b] = a
    rows = [r for r in rows if root(r[0]) == r[0]]
    hits = sql("op5_decontaminate")
    rows = [r for r in rows if not hits[r[0]]["contaminated"]]
    library = Tokenizer.from_file(f"{queries.TOKENIZERS}/byte_bpe_50k.json")
    want = {(r[0], r[2], r[3], tuple(library.encode(r[1], add_special_tokens=False).ids)) for r in rows}
    got = p.run(spark, SF).collect()
    ids = lambda b: tuple(int.from_bytes(b[k : k + 4], "little") for k in range(0, len(b), 4))
    assert {(r["doc_id"], r["lang"], r["source"], ids(r["token_ids"])) for r in got} == want and len(got) == len(want) > 50
    assert all(r["n_tokens"] == len(r["token_ids"]) // 4 for r in got)


LONG = " ".join(f"word{i % 977}x{i}" for i in range(20_000))
PASSAGE = "\n".join(" ".join(f"p{i}q{k}" for k in range(9)) for i in range(8))
ODD = [
    (None, "alpha beta gamma delta epsilon zeta", "en", "s", 35, "h"), (None, None, None, None, None, None), (1, None, None, None, None, "h"), (2, "", "en", "s", 0, "h"),
    (3, LONG, "en", "s", len(LONG), "h"), (4, "tie one two three four five six", "en", "s", 31, "h"), (4, "tie one two three four five six", "en", "s", 31, "h"),
    (5, "TIE one two three four five six", "de", None, 31, "h"), (6, "first\n" + PASSAGE, None, "s", 6 + len(PASSAGE), "h"), (7, PASSAGE + "\nlast", "en", "s", len(PASSAGE) + 5, "h"),
]
CLASH = "doc_id long, text string, lang string, source string, n_chars long, {} string"


@pytest.fixture
def folder(spark):
    """Labels and a benchmark for small tables."""
    path = f"{shared_dir(spark)}/odd"
    spark.createDataFrame([(4, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "nothing of this here at all in any of these texts"), (2, None)], "item_id long, text string").write.mode("overwrite").parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize(("name", "clash"), [("quality", "evidence"), ("quality", "__host"), ("line_dedup", "n_removed"), ("near_dedup", "component_id"), ("near_dedup", "text_key"), ("decontamination", "N_Words"), ("tokens", "n_tokens")])
def test_odd_rows_in_every_stage(spark, folder, name, clash):
    df = spark.createDataFrame(ODD, CLASH.format(clash)).repartition(3)
    got = dict(p.STAGES)[name](spark, df, folder)
    assert got.filter("false").count() == 0 and dict(p.STAGES)[name](spark, df.filter("false"), folder).count() == 0
    rows = sorted(got.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, str(r)))
    ids = [r["doc_id"] for r in rows]
    if name == "tokens":
        assert ids == [1, 2, 3, 4, 4, 5, 6, 7, None, None] and [r["n_tokens"] for r in rows][:2] == [0, 0]
        return
    assert got.columns == p.DOCUMENTS
    texts = {r["doc_id"]: r["text"] for r in rows}
    if name == "near_dedup":  # 2 has no words like 1; 5 is 4 but for letter case; 7 has but one word that 6 hasn't
        assert ids == [1, 3, 4, 4, 6, None, None]
        return
    assert ids == [1, 2, 3, 4, 4, 5, 6, 7, None, None] and texts[1] is None and texts[2] == "" and texts[3] == LONG
    if name == "line_dedup":
        assert texts[6] == "first\n" + PASSAGE and texts[7] == "last" and [r["n_chars"] for r in rows if r["doc_id"] == 7] == [4]
    else:
        assert texts[7] == PASSAGE + "\nlast"


def test_rows_of_one_id_with_other_texts(spark, folder):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(1, a), (5, b), (5, a)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], CLASH.split(", {}")[0])
    assert sorted((r["doc_id"], r["text"]) for r in p.near_dedup_stage(spark, df, folder).collect()) == [(1, a), (5, b)]
