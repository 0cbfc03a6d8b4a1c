"""Benchmark decontamination by winnowing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, join_groups, let, text_key, without

#: Words of a window, and of a k-gram whose hash may be its fingerprint.
WINDOW, K = 10, 4
#: What parts words, and the same with capitals left in the words.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_EVEN_CAPITAL = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Fixed value: characters beyond ASCII that lower() might change.
OTHER_CAPITALS = r"[\p{Lu}\p{Lt}\p{Nl}\p{So}\p{M}&&[^\x00-\x7F]]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased and no other letter."""
    low = F.when(F.regexp_like(text, F.lit(OTHER_CAPITALS)), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.filter(F.split(low, NOT_WORD), lambda w: w != "")


def how_many(text: Column) -> Column:
    """The number of words of a text as it is, 0 of null. Splitting costs less than matching words."""
    return F.coalesce(F.size(F.array_remove(F.split(text, NOT_EVEN_CAPITAL), "")), F.lit(0)).cast("long")


def _windows(a: Column, n: int, f) -> Column:
    """f(a[i], ..., a[i + n - 1]) for each i; ``a`` must be a column or a bound variable."""
    starts = F.slice(a, 1, F.greatest(F.size(a) - (n - 1), F.lit(0)))
    return F.transform(starts, lambda x, i: f(x, *[F.get(a, i + k) for k in range(1, n)]))


def _span(w: Column, at: Column, n: Column) -> Column:
    """``n`` words from a place (from 0) on. A slice inside a lambda copies the whole array first."""
    return F.array_join(F.transform(F.sequence(at, at + n - 1), lambda i: F.get(w, i)), " ")


def marks(hashes: Column, length: int) -> Column:
    """One fingerprint for each window of ``length`` words, from the words' hashes: the least hash
    of its k-grams, so a window has the same one wherever it stands. A window of no more than K
    words has the hash of them all. The length is part of the fingerprint."""
    grams = lambda h, n: _windows(h, n, lambda *x: F.xxhash64(*x, F.lit(length)))
    if length <= K:
        return let(hashes, lambda h: grams(h, length))
    return let(hashes, lambda h: let(grams(h, K), lambda g: _windows(g, length - K + 1, lambda *x: F.least(*x) if len(x) > 1 else x[0])))


def _others(docs: DataFrame, text: str) -> Column:
    """A hash of a row's other plain columns, which tells copies of a text apart."""
    plain = [F.col(f"`{f.name}`") for f in docs.schema if isinstance(f.dataType, T.AtomicType) and f.name != text]
    return F.xxhash64(*plain, F.lit(0))


def decontaminate(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW
) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items (long), item_ids (array<string>, sorted) and
    contaminated (boolean), which replace columns of those names.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is
    one window. A document's word inside any occurrence of a window is hit. Fingerprints of
    documents and items are joined; around each match the words themselves are compared, so a hash
    met by chance counts for nothing and no window is missed. Equal texts are compared once. Null
    texts have no words; null item ids name no item but their windows hit; repeated items count
    once; no items or no documents give no hits or no rows.
    """
    names = ["n_words", "n_hit", "n_items", "item_ids", "contaminated"]
    body = F.col(f"`{text}`")
    item = items.select(F.col(f"`{item_id}`").cast("string").alias("item"), words(F.col(f"`{item_text}`")).alias("w")).filter(F.size("w") > 0)
    item = item.withColumn("len", F.least(F.size("w"), F.lit(window)))
    spans = F.transform(F.sequence(F.lit(0), F.size("w") - F.col("len")), lambda i: _span(F.col("w"), i, F.col("len")))
    windows = item.select("item", "len", F.explode(F.array_distinct(spans)).alias("span"))
    windows = cut(windows.groupBy("len", "span").agg(F.collect_set("item").alias("items")), "windows")
    lengths = sorted(r[0] for r in windows.select("len").distinct().collect())  # at most ``window`` numbers
    if not lengths:
        none = F.array().cast("array<string>")
        zero = F.lit(0).cast("long")
        n_words = how_many(body)
        return docs.select(*without(docs, names), n_words.alias("n_words"), zero.alias("n_hit"), zero.alias("n_items"), none.alias("item_ids"), F.lit(False).alias("contaminated"))

    hashes = lambda w: F.transform(w, lambda x: F.xxhash64(x))
    kinds = windows.withColumn("h", hashes(F.split("span", " ")))
    marked = F.lit(None).cast("long")
    for n in lengths:
        marked = F.when(F.col("len") == n, F.get(marks(F.col("h"), n), F.lit(0))).otherwise(marked)
    prints = kinds.select(marked.alias("mark")).distinct()

    known = docs.select(text_key(body).alias("key"), body.alias("t"))
    h = known.filter(F.col("t").isNotNull()).select("key", hashes(words(F.col("t"))).alias("h"))
    own = F.array_distinct(F.concat(*[marks(F.col("h"), n) for n in lengths])) if len(lengths) > 1 else F.array_distinct(marks(F.col("h"), lengths[0]))
    seeds = h.select("key", F.explode(own).alias("mark")).join(prints, "mark")
    seeds = cut(seeds.groupBy("key").agg(F.collect_set("mark").alias("marks"), F.count("*").alias("times")).filter("key > ''"), "seeds")

    # Extend: the whole windows at the matched marks, compared as words, of one row a text. The
    # matched texts grow with the documents, so their keys are never broadcast but for the few of
    # texts that very many rows have.
    known = docs.filter(body.isNotNull()).select(text_key(body).alias("key"), body.alias("t"), _others(docs, text).alias("part"))
    texts = join_groups(known, seeds, ["key"], ["part"], merge=True).groupBy("key").agg(F.first("t").alias("t"), F.first("marks").alias("marks"))
    found = texts.select("key", "marks", words(F.col("t")).alias("w")).withColumn("h", hashes(F.col("w")))
    hit = None
    for n in lengths:
        at = F.filter(F.transform(marks(F.col("h"), n), lambda m, i: F.when(F.array_contains("marks", m), i)), lambda i: i.isNotNull())
        # Windows are cut out inside the array: a row a window with all words would copy the text for each.
        cut_out = F.transform(at, lambda i: F.struct(i.alias("at"), _span(F.col("w"), i, F.lit(n)).alias("span")))  # noqa: B023
        some = found.select("key", F.explode(cut_out).alias("x")).select("key", "x.at", F.lit(n).alias("len"), "x.span")
        hit = some if hit is None else hit.unionByName(some)
    hit = hit.join(windows, ["len", "span"])
    covered = F.size(F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("at"), F.col("at") + F.col("len") - 1)))))
    hits = hit.groupBy("key").agg(covered.cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"))
    hits = cut(hits.join(seeds.select("key", "times"), "key"), "hits")

    n_words = how_many(body)
    out = docs.select(*without(docs, names), n_words.alias("n_words"), text_key(body).alias("__key"), _others(docs, text).alias("__part"))
    kept = out.columns[:-3]
    found = hits.select(F.col("key").alias("__key"), F.col("n_hit").alias("__hit"), F.col("item_ids").alias("__items"), F.col("times").alias("__times"))
    out = join_groups(out, found, ["__key"], ["__part"], "__times", how="left", merge=True)
    ids = F.coalesce("__items", F.array().cast("array<string>"))
    return out.select(
        *(F.col(f"`{c}`") for c in kept), "n_words", F.coalesce("__hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), F.col("__hit").isNotNull().alias("contaminated"),
    )
