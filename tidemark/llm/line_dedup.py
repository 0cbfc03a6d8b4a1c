"""Line deduplication by content-defined chunks of lines, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_groups, let, made, remove, row_key

#: Chunkings: (whether the rolling window of two lines looks ahead, multiplier, addend).
#: A window that looks ahead settles the boundary at a repeated passage's start from its own lines,
#: one that looks back that at its end.
CHUNKINGS = ((True, 31, 1), (True, 1009, 7), (False, 31, 3), (False, 1009, 11))
#: A line of so many words is a chunk by itself; chunks of fewer words than LEAST are left alone.
LONG_LINE, LEAST = 50, 8
#: Lines whose words are added up in one go, so that the sums of a long text take linear time.
BLOCK = 256


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def _span(at: Column, n: Column) -> Column:
    """A run of lines as one number, which sets of them are made of by hashing."""
    return F.shiftleft(at.cast("long"), 31) + n


def _at(span: Column) -> Column:
    return F.shiftright(span, 31).cast("int")


def _n(span: Column) -> Column:
    return span.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")


def _places(span: Column) -> Column:
    """The lines of a run, by number. They are got one by one: a slice inside a lambda copies the
    whole array first."""
    return F.sequence(_at(span), _at(span) + _n(span) - 1)


def _text(lines: Column, span: Column) -> Column:
    return F.array_join(F.transform(_places(span), lambda i: F.get(lines, i)), "\n")


def _starts(hashes: Column, words: Column, ahead: bool, mul: int, add: int) -> Column:
    """Places (from 0) of the lines that begin a chunk: those whose rolling hash of two line
    hashes has its 16th bit set, and those on either side of a border of a long line."""

    def begins(i: Column) -> Column:
        a, b = (i, i + 1) if ahead else (i - 2, i - 1)
        rolled = F.coalesce(F.get(hashes, a), F.lit(0)) * mul + F.coalesce(F.get(hashes, b), F.lit(0)) + add
        cut_here = F.shiftright(rolled, 16).bitwiseAND(F.lit(1)) == 1
        long_ = (F.get(words, i) >= LONG_LINE) | (F.get(words, i - 1) >= LONG_LINE)
        return (i == 0) | cut_here | long_

    return F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), begins)


def _chunks(lines: Column) -> Column:
    """Spans of a text's chunks that matter; those that several chunkings make are taken once."""

    def spans_of(h: Column, w: Column, chunking: tuple) -> Column:
        ends = lambda at: F.concat(F.slice(at, 2, F.size(at)), F.array(F.size(h)))
        return let(_starts(h, w, *chunking), lambda at: F.zip_with(at, ends(at), lambda a, b: _span(a, b - a)))

    def matters(x: Column, w: Column) -> Column:
        total = F.aggregate(_places(x), F.lit(0), lambda a, i: a + F.get(w, i))
        return let(total, lambda t: ((_n(x) >= 2) | (t >= LONG_LINE)) & (t >= LEAST))

    hashed, counted = F.transform(lines, line_hash), F.transform(lines, lambda x: F.size(F.split(x, " ")))
    return let(hashed, lambda h: let(counted, lambda w: F.filter(F.array_distinct(F.concat(*[spans_of(h, w, c) for c in CHUNKINGS])), lambda x: matters(x, w))))


def _windows(lines: Column) -> Column:
    """Spans of the shortest runs of lines with over LONG_LINE words that begin or end at each
    line with words, but for single lines. Those of a repeated run are repeated, and cover it."""
    words = F.transform(lines, lambda x: F.size(F.array_remove(F.split(x, " "), "")))

    def runs(w: Column) -> Column:
        line_of = F.flatten(F.transform(w, lambda n, i: F.array_repeat(i, n)))  # by number of word
        add = lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(w, b * BLOCK + 1, F.lit(BLOCK)), F.array(F.lit(0)), add))

        def about(of: Column, parts: Column, base: Column) -> Column:
            block = lambda i: F.shiftright(i, BLOCK.bit_length() - 1)
            start = lambda i: F.get(base, block(i)) + F.get(F.get(parts, block(i)), i % BLOCK)
            run = lambda a, b: _span(a, b - a + 1)
            ahead = F.transform(w, lambda n, i: F.when(n > 0, run(i, F.get(of, start(i) + LONG_LINE))))
            back = F.transform(w, lambda n, i: F.when((n > 0) & (start(i) + n > LONG_LINE), run(F.get(of, start(i) + n - 1 - LONG_LINE), i)))
            return F.filter(F.array_distinct(F.concat(ahead, back)), lambda x: x.isNotNull() & (_n(x) > 1))

        offsets = lambda parts: F.aggregate(parts, F.array(F.lit(0)), lambda a, p: add(a, F.element_at(p, -1)))
        return let(line_of, lambda of: let(blocks, lambda parts: let(offsets(parts), lambda base: about(of, parts, base))))

    return F.when(F.size(lines) > 1, let(words, lambda w: F.when(F.aggregate(w, F.lit(0), lambda a, n: a + n) > LONG_LINE, runs(w))))


#: The order that says which of equal places stays.
_FIRST = ("__id", "__key", "at")


def _pieces(each: DataFrame) -> DataFrame:
    """(__key, __id, at, n, h, d) of all chunks, with their hash in h, and of all windows, with their
    SHA-256 in d. Texts are hashed inside the array: a row a piece with all lines would copy them."""
    lines = F.col("lines")
    none = F.lit(None)
    chunks = F.transform(_chunks(lines), lambda c: F.struct(_at(c).alias("at"), _n(c).alias("n"), F.xxhash64(_text(lines, c)).alias("h"), none.cast("binary").alias("d")))
    windows = F.transform(_windows(lines), lambda c: F.struct(_at(c).alias("at"), _n(c).alias("n"), none.cast("long").alias("h"), F.unhex(F.sha2(_text(lines, c), 256)).alias("d")))
    both = F.concat(chunks, F.coalesce(windows, F.array().cast("array<struct<at:int,n:int,h:bigint,d:binary>>")))
    return each.select("__key", "__id", F.explode(both).alias("c")).select("__key", "__id", "c.*")


def _repeated(pieces: DataFrame, by: str) -> DataFrame:
    """The pieces whose hash another one has."""
    own = pieces.filter(F.col(by).isNotNull()).select("__key", "__id", "at", "n", by)
    often = cut(own.groupBy(by).agg(F.count("*").alias("times")).filter("times > 1"), "often")
    return join_groups(own, often, [by], ["__key", "at"]).drop("times")


def _later(again: DataFrame, same: list[str]) -> DataFrame:
    """``again`` with ``first``, the first place of all rows alike in ``same``."""
    first = again.groupBy(*same).agg(F.min(F.struct(F.col("__id").isNull(), *_FIRST)).alias("first"), F.count("*").alias("times"))
    first = cut(first.filter("times > 1"), "first")
    return join_groups(again, first, same, ["__key", "at"]).drop("times")


def _repeated_chunks(pieces: DataFrame, each: DataFrame) -> DataFrame:
    """(__key, at, n) of the chunks that an earlier place has. Found by hash, then compared as texts:
    only chunks whose hash comes again are taken out of their documents, a row a document."""
    wanted = _repeated(pieces, "h").groupBy("__key").agg(F.collect_set(F.struct("at", "n", "h")).alias("w"))  # of one text, so bounded by it
    text = F.transform("w", lambda x: F.struct(x["at"].alias("at"), x["n"].alias("n"), x["h"].alias("h"), _text(F.col("lines"), _span(x["at"], x["n"])).alias("chunk")))
    again = cut(each.join(wanted, "__key").select("__key", "__id", F.explode(text).alias("c")).select("__key", "__id", "c.*"), "chunks")
    found = _later(again, ["h", "chunk"])
    return found.filter((F.col("first.__key") != F.col("__key")) | (F.col("first.at") != F.col("at"))).select("__key", "at", "n")


def _repeated_windows(pieces: DataFrame) -> DataFrame:
    """(__key, at, n) of the runs of over LONG_LINE words that an earlier place has, by SHA-256 of
    their text. What overlaps the first place in its own document stays with it."""
    found = _later(cut(_repeated(pieces, "d"), "again"), ["d"])
    return found.filter((F.col("first.__key") != F.col("__key")) | (F.col("at") >= F.col("first.at") + F.col("n"))).select("__key", "at", "n")


def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``df`` with globally repeated chunks of lines taken out of ``text``; adds n_removed (long),
    the lines taken out of each text; ``n_chars``, where there is such a column, is counted anew.

    Lines are what newlines part. A chunk counts if it has two lines or more, or one of LONG_LINE
    words, and LEAST words in all. Of chunks equal byte by byte, that in the row of the smallest id
    (nulls last, then by text key) and there the first stays; all others go, those of the same
    document as well. Candidates are found by their hash, and only they are compared as texts.
    Besides, every run of lines of over LONG_LINE words (spaces part them) that an earlier place has
    goes, whatever its chunks are; only blank lines may stay of it. Rows that share id and text are
    one document and keep the same lines. Null texts stay null, empty ones empty, with 0 removed; a
    text may become empty but no row goes; an empty table gives no rows. The time is linear in a
    text's lines.
    """
    names = df.columns
    idc, body = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    docs = df.select(*(F.col(f"`{c}`") for c in names), row_key(idc, body).alias("__key"))
    some = (F.instr(body, "\n") > 0) | (F.size(F.split(body, " ")) >= LONG_LINE)
    each = docs.filter(some).select("__key", idc.alias("__id"), F.split(body, "\n").alias("lines"))
    with made() as paths:
        pieces = cut(_pieces(each), "pieces")  # finding them costs more than reading them twice
        gone = _repeated_chunks(pieces, each).unionByName(_repeated_windows(pieces))
        removed = gone.groupBy("__key").agg(F.collect_set(_span(F.col("at"), F.col("n"))).alias("__gone"))  # of one text, so bounded by it
        removed = cut(removed, "gone")
    remove(df.sparkSession, paths[:-1])  # the last is the result
    out = docs.join(removed, "__key", "left")
    hit = F.col("__gone").isNotNull()
    covered = F.array_distinct(F.flatten(F.transform("__gone", lambda g: F.sequence(_at(g), _at(g) + _n(g) - 1))))
    out = out.withColumn("__covered", F.when(hit, covered))
    kept = let(F.split(body, "\n"), lambda parts: F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "__covered"), lambda i: F.get(parts, i)))
    fresh = F.when(hit, F.array_join(kept, "\n")).otherwise(body)
    n_removed = F.when(hit, F.size("__covered").cast("long")).otherwise(F.lit(0).cast("long"))
    cols = []
    for c in names:
        if c == text:
            cols.append(fresh.alias(c))
        elif n_chars and c == n_chars:
            cols.append(F.when(hit, F.length(fresh).cast(df.schema[c].dataType)).otherwise(F.col(f"`{c}`")).alias(c))
        elif c.lower() != "n_removed":
            cols.append(F.col(f"`{c}`"))
    return out.select(*cols, n_removed.alias("n_removed"))
