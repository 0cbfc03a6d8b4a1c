"""Similar texts by word shingles: SimHash keys and MinHash bands for candidates, whole sets compared."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, few, join_groups, made, map_text, remove, text_key
from .components import components
from .simhash import SEED, links, majority

#: Bands of a sketch and minima in each: a pair at similarity 0.8 shares a band in 99.96% of cases.
BANDS, ROWS = 20, 5
#: Sets whose names are sent to all texts to have their shingles read again; more are joined.
MOST_SENT = 200_000


def shingles(text: bytes | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles, words as in ``simhash``. Fewer
    words than ``size`` make one shingle, none make none."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h, join = xxhash.xxh64_intdigest, b" ".join
    return np.unique(np.array([h(join(words[i : i + size]), SEED) for i in range(max(1, len(words) - size + 1))], np.uint64))


@lru_cache(maxsize=1)
def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    a, b = rng.integers(0, 2**64, (2, BANDS * ROWS), dtype=np.uint64)
    return a | np.uint64(1), b


def bands(hashes: np.ndarray) -> list[int]:
    """Keys of the bands of a set's MinHash sketch; no hashes have none."""
    if not len(hashes):
        return []
    a, b = _factors()
    least = np.full(len(a), 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 256):
        x = hashes[at : at + 256]
        np.minimum(least, (x[:, None] * a + b).min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(row.tobytes(), i) - 2**63 for i, row in enumerate(least.reshape(BANDS, ROWS))]


def _sketches(df: DataFrame, text: str, keep: list[str], size: int) -> DataFrame:
    """Add key (of the set: equal sets have equal ones), n, fp (the set's SimHash) and bands of every text."""

    def make():
        def do(texts: list[bytes | None]) -> list[list]:
            sets = [shingles(t, size) for t in texts]
            fps = np.array([majority(x) for x in sets], np.uint64).view(np.int64)
            return [[_key(x) for x in sets], [len(x) for x in sets], fps.tolist(), [bands(x) for x in sets]]

        return do

    fields = [("key", T.BinaryType()), ("n", T.IntegerType()), ("fp", T.LongType()), ("bands", T.ArrayType(T.LongType()))]
    return map_text(df, text, [T.StructField(n, t) for n, t in fields], make, keep)


def _key(hashes: np.ndarray) -> bytes:
    return hashlib.sha256(hashes.tobytes()).digest()[:16]


def _sets(texts: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(key, s): the shingles of the sets in ``wanted`` (key, and doc_id and text_key of one text that
    has it), read again from the texts: whole sets of all texts are never kept."""

    def make():
        return lambda found: [[x.view(np.int64) for x in (shingles(t, size) for t in found)]]

    same = (F.col("t.doc_id").eqNullSafe(F.col("w.doc_id"))) & (F.col("t.text_key") == F.col("w.text_key"))
    n = wanted.count()
    own = F.broadcast(wanted) if n <= MOST_SENT else wanted.hint("merge")  # MOST_SENT names of 60 bytes
    rows = texts.alias("t").join(own.alias("w"), same).select("w.key", "t.text")
    found = map_text(rows, "text", [T.StructField("s", T.ArrayType(T.LongType()))], make, ["key"])
    return found.dropDuplicates(["key"])  # rows repeated with one id and text


def _by_fingerprint(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b), keys of sets (key, n, fp) whose fingerprints differ in 3 bits or fewer, by the Golay
    keys of ``simhash``: the first set of each fingerprint against those of the fingerprints that are
    near, and against the other sets of its own."""
    near = lambda a, b: F.least(a, b) * 100 >= F.greatest(a, b) * percent
    firsts = cut(few(sets.groupBy("fp").agg(F.min(F.struct("key", "n")).alias("m"), F.count("*").alias("times")), sets.count()), "fingerprints")
    own = join_groups(sets.select("fp", "key", "n"), firsts.filter("times > 1"), ["fp"], ["key"]).filter((F.col("key") != F.col("m.key")) & near(F.col("n"), F.col("m.n")))
    x, y = (firsts.select(F.col("fp").alias(side), F.col("m").alias(f"{side}_m")) for side in ("a", "b"))
    other = cut(links(firsts).distinct(), "near").join(x, "a").join(y, "b").filter(near(F.col("a_m.n"), F.col("b_m.n")))
    return own.select(F.col("m.key").alias("a"), F.col("key").alias("b")).union(other.select("a_m.key", "b_m.key"))


def _rare(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b), keys of sets (key, s, group) of two groups: all pairs that reach the similarity, and few others.

    Each set's shingles are put in one order, the rarest first. Where two sets reach it, the first
    shingle that they share has places in both after which enough are left for what they must have
    in common; so pairs meet only by shingles at such places. The smaller set has such places among
    its rarest ninth only (at 80 percent): those of a text that many copies have are among them in
    the text's nearest copies alone, which the star has linked. Places are held against each other
    once for all sets of one group and size, by the first, and only then for each set.
    """
    reach = lambda n, at, other: (n - at) * (100 + percent) >= (n + other) * percent
    each = cut(sets.select("key", "group", F.size("s").cast("long").alias("n"), F.explode("s").alias("h")), "shingles")
    shared = cut(each.groupBy("h").agg(F.count("*").alias("times")).filter("times > 1"), "shared-shingles")
    of_set = Window.partitionBy("key")
    at = F.col("n") - F.count("*").over(of_set) + F.row_number().over(of_set.orderBy("times", "h")) - 1  # shingles of no other set come first
    found = join_groups(each, shared, ["h"], ["key"]).withColumn("at", at)
    places = cut(found.filter((F.col("n") - F.col("at")) * 100 >= F.col("n") * percent).select("h", "group", "n", "at", "key"), "places")
    firsts = cut(places.groupBy("h", "group", "n").agg(F.min("at").alias("at")), "firsts")
    small = lambda df: df.filter(reach(F.col("n"), F.col("at"), F.col("n"))).select("h", *(F.col(c).alias(f"o_{c}") for c in df.columns if c != "h"))
    both = reach(F.col("n"), F.col("at"), F.col("o_n")) & reach(F.col("o_n"), F.col("o_at"), F.col("n"))
    near = (F.col("o_n") <= F.col("n")) & (F.col("o_n") * 100 >= F.col("n") * percent)
    meet = cut(firsts.join(small(firsts), "h").filter((F.col("group") != F.col("o_group")) & near & both).drop("at", "o_at"), "meet")
    pairs = meet.join(places, ["h", "group", "n"]).join(small(places), ["h", "o_group", "o_n"]).filter(both)
    return pairs.select(F.least("key", "o_key").alias("a"), F.greatest("key", "o_key").alias("b"))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text_key, component_id) for every row; doc_id and text_key name it.

    Rows link if the sets of their texts' ``size``-word shingles have a Jaccard similarity of
    ``percent`` or more; component_id is the smallest doc_id reachable. Null texts and texts without
    words are alike; rows with a null id link others but name no component; repeated rows stay; no
    rows give no rows.

    Candidates are sets whose SimHash fingerprints differ in 3 bits or fewer, found by Golay keys as in
    ``simhash``, and, as most pairs at 0.8 differ in more bits, sets in one MinHash band. These are
    held against the band's centre, the set that shares bands with most others, which links most of a
    group of near copies by one pair each; then those that these links
    leave in different components against each other, see ``_rare``. All candidates are compared as
    whole sets.
    """
    body = F.col(f"`{text}`")
    with made() as paths:
        ids = df.select(F.col(f"`{doc_id}`").alias("doc_id"), text_key(body).alias("text_key"), body.alias("text"))
        each = cut(_sketches(ids, "text", ["doc_id", "text_key"], size), "sketches")
        name = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
        grouped = each.groupBy("key").agg(F.min(name).alias("least"), F.count("*").alias("times"), F.max("n").alias("n"), F.max("fp").alias("fp"), F.min_by("bands", name).alias("bands"))
        sets = cut(grouped.select("key", "least.doc_id", "least.text_key", "times", "n", "fp", "bands"), "sets")
        total = sets.count()  # bounds the narrow tables below
        listed = sets.select("key", "n", F.explode("bands").alias("band"))
        many = cut(few(listed.groupBy("band").agg(F.count("*").alias("times")).filter("times > 1"), BANDS * total // 2), "many")
        shared = cut(few(join_groups(listed, many, ["band"], ["key"]), BANDS * total), "shared")
        # How many others each set meets in its bands: a base meets more than its copies do.
        central = shared.groupBy("key").agg(F.sum("times").alias("met"))
        met = cut(few(shared.drop("times").join(central, "key"), BANDS * total), "met")
        centre = met.groupBy("band").agg(F.max(F.struct("met", "key", "n")).alias("m"), F.count("*").alias("times"))
        together = cut(few(join_groups(met.drop("met"), cut(few(centre, BANDS * total // 2), "centres"), ["band"], ["key"]).drop("times"), BANDS * total), "bands")
        near_size = lambda a, b: F.least(a, b) * 100 >= F.greatest(a, b) * percent

        def read(wanted: DataFrame, label: str) -> DataFrame:
            return cut(_sets(ids, cut(few(sets.select("key", "doc_id", "text_key").join(wanted, "key", "left_semi"), total), f"{label}-wanted"), size), f"{label}-sets")

        def verified(pairs: DataFrame, label: str, held: DataFrame | None = None) -> DataFrame:
            pairs = cut(pairs.distinct(), f"{label}-pairs")
            if held is None:
                held = read(pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct(), label)
            often = cut(pairs.groupBy("a").agg(F.count("*").alias("times")).join(held.select(F.col("key").alias("a"), F.col("s").alias("x")), "a"), f"{label}-left")
            both = join_groups(pairs, often, ["a"], ["b"]).join(held.select(F.col("key").alias("b"), F.col("s").alias("y")), "b")
            both = both.select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("common"), (F.size("x") + F.size("y")).cast("long").alias("total"))
            return cut(both.filter(F.col("common") * 100 >= (F.col("total") - F.col("common")) * percent).select("a", "b"), f"{label}-links")

        about = together.filter((F.col("key") != F.col("m.key")) & near_size(F.col("n"), F.col("m.n"))).select(F.col("m.key").alias("a"), F.col("key").alias("b"))
        star = verified(about.union(_by_fingerprint(sets, percent)), "star")
        found = cut(few(_grouped(star), total), "grouped")
        named = together.join(found, "key", "left").select("band", "key", "n", F.coalesce("group", "key").alias("group"))
        apart = named.groupBy("band").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).filter("lo != hi").select("band")
        open_ = cut(few(named.join(apart, "band", "left_semi").select("key", "group").distinct(), total), "open")
        held = read(open_.select("key"), "open")
        rest = verified(_rare(held.join(open_, "key"), percent), "rest", held)
        groups = _grouped(star.union(rest))
        known = sets.select("key", "doc_id", "times").join(groups, "key", "left").withColumn("group", F.coalesce("group", "key"))
        ids_of = known.groupBy("group").agg(F.min("doc_id").alias("component_id"))
        named_sets = cut(few(known.join(ids_of, "group").select("key", "times", "component_id"), total), "result")
        result = cut(join_groups(each.select("doc_id", "text_key", "key"), named_sets, ["key"], ["doc_id"]).select("doc_id", "text_key", "component_id"), "components")
    remove(df.sparkSession, paths[:-1])  # the last is the result
    return result


def _grouped(links: DataFrame) -> DataFrame:
    """(key, group) of every key with a link; group is the least key reachable."""
    return components(links, small=True).withColumnRenamed("id", "key").withColumnRenamed("component_id", "group")
