"""Main text of web pages: repeated runs of each host's suffixes, and document structure."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.ship import ship

from .common import cut, slices, text_key

#: Tokens of a run that counts as long; borders of blocks count as tokens.
DEPTH = 8
#: Repeated runs that are sent to every task (16 bytes each); more are joined to their pages.
MOST_SENT = 2_000_000
#: Elements that are no text, boilerplate by their kind, ends of blocks, without end,
#: what a head may hold, headings and paragraphs.
HIDDEN = {"script", "style", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "audio", "video", "textarea", "select", "title", "head"}
RAW = ("script", "style", "noscript", "template", "iframe", "svg", "math", "textarea", "title")
BOILERPLATE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button"}
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html"
    " legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
IN_HEAD = set("base basefont bgsound link meta noscript script style template title".split())
PLAIN = set("h1 h2 h3 h4 h5 h6 p".split())
#: Fixed value: words of a class or id that tell boilerplate, and words that say nothing beside them.
BOILERPLATE_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsored sponsor promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay"
    " sidebar rail menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments disqus replies reply respond share sharing social related"
    " recommended newsletter subscribe subscription signup login search widget pagination pager toolbar skip".split()
)
NEUTRAL = set("site page main top bottom left right global primary secondary box bar block container wrapper wrap area section list slot unit inner outer".split())
ROLES = set("navigation banner contentinfo complementary search menu menubar dialog alertdialog alert form toolbar".split())
NOT_AN_ARTICLE = set("comment comments reply replies related ad advert sponsored".split())
#: Elements of these kinds that a new one of the second list ends.
IMPLIED = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}
ENDS = {tag: [name for name, ends in IMPLIED.items() if tag in ends] for tag in {t for ends in IMPLIED.values() for t in ends}}
SCOPES = {"ul", "ol", "dl", "table", "article", "main", "section", "div", "body", "nav", "aside", "footer", "header", "form"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'][^\s=/]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s]*+))?""")
_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}


def _mark(tag: str, attributes: str, in_article: bool) -> tuple[int, str]:
    """(2 for an element that is boilerplate, 1 for one whose class hints at it, else 0; its class).

    A class or id tells boilerplate if one of its names is such a word, or, outside articles, such
    words with neutral ones; a name that only holds such a word (section-header, ad-free), or any on
    a heading or paragraph, is a hint, which needs a repeated run to count."""
    mark = 2 if tag in BOILERPLATE or tag in HIDDEN else 0
    if "=" not in attributes and "hidden" not in attributes.lower():
        return mark, ""
    names: list[str] = []
    own = ""
    for m in _ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        if name not in ("class", "id", "role", "hidden", "aria-hidden"):
            continue
        value = (m[2] or "").strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value.strip() in ROLES):
            mark = 2
        elif name in ("class", "id"):
            names += value.split()
            own = value if name == "class" else own
    if mark == 2 or tag in ("html", "body", "main"):
        return mark, own
    if tag == "article":
        return 2 if not NOT_AN_ARTICLE.isdisjoint(names) else 0, own
    for n in names:
        parts = [p for p in re.split(r"[^a-z0-9]+", n) if p]
        if BOILERPLATE_WORDS.isdisjoint(parts):
            continue
        whole = len(parts) == 1 or (not in_article and all(p in BOILERPLATE_WORDS or p in NEUTRAL for p in parts))
        mark = max(mark, 2 if whole and tag not in PLAIN else 1)
    return mark, own


def blocks(page: str) -> list[tuple[str, bool, int, str]]:
    """(text, in the article, mark, border) of the page's blocks, in order.

    The article is what <article> holds, or <main> where there is no <article>; mark is 2 inside an
    element that is boilerplate, 1 inside one whose class only hints at it, else 0; border is the
    tag and class of the element that the block is in. Elements left open end with what holds them,
    a head with the first thing that can't be in it; a tag that never ends is no text. The time is
    linear in the page: open elements are found by their names' own lists of places.
    """
    out: list[tuple[str, int, int, str]] = []
    stack: list[tuple[str, int, int, str]] = []  # tag, mark, kind of article before, border before
    where: dict[str, list[int]] = {}  # places of open elements by name
    scopes: list[int] = []
    tall: list[int] = []  # places of open block elements
    text: list[str] = []
    sure = hints = kind = 0  # kind: 2 in an article, 1 in main
    border = ""

    def flush() -> None:
        if text:
            whole = "".join(text)
            text.clear()
            joined = " ".join((entities.unescape(whole) if "&" in whole else whole).split())
            if joined:
                out.append((joined, kind, 2 if sure else 1 if hints else 0, border))

    def pop_to(depth: int) -> None:
        nonlocal sure, hints, kind, border
        while len(stack) > depth:
            name, mark, before, border_before = stack.pop()
            if mark:
                flush()
            where[name].pop()
            if scopes and scopes[-1] == len(stack):
                scopes.pop()
            if tall and tall[-1] == len(stack):
                tall.pop()
            sure -= mark == 2
            hints -= mark == 1
            kind, border = before, border_before

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        upto = n if m is None else m.start()
        if upto > at:
            if where.get("head") and not page[at:upto].isspace():
                pop_to(where["head"][-1])
            text.append(page[at:upto])
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag == "br":
            text.append(" ")
            continue
        block = tag in BLOCKS or tag in HIDDEN
        if m[1]:
            if block:
                flush()
            if where.get(tag) and (block or not tall or where[tag][-1] > tall[-1]):
                pop_to(where[tag][-1])
            continue
        if where.get("head") and tag not in IN_HEAD:
            pop_to(where["head"][-1])
        if block:
            flush()
        for name in ENDS.get(tag, ()):
            if where.get(name) and (not scopes or where[name][-1] > scopes[-1]):
                flush()
                pop_to(where[name][-1])
        if tag in VOID or m[3].rstrip().endswith("/") and tag in ("svg", "path", "img"):
            continue
        if tag in _END:
            end = _END[tag].search(page, at)
            at = end.end() if end else n
            continue
        mark, own = _mark(tag, m[3], kind == 2 or kind == 1)
        if mark:
            flush()
        where.setdefault(tag, []).append(len(stack))
        if tag in SCOPES:
            scopes.append(len(stack))
        if block:
            tall.append(len(stack))
        stack.append((tag, mark, kind, border))
        sure += mark == 2
        hints += mark == 1
        kind = 2 if tag == "article" or kind == 2 else 1 if tag == "main" else kind
        if block:
            border = f"{tag}.{own}" if own else tag
    flush()
    best = max((k for _, k, d, _ in out if d < 2), default=0)
    return [(t, best > 0 and k >= best, d, b) for t, k, d, b in out]


def suffixes(host: str, page: list[tuple[str, bool, int, str]], depth: int = DEPTH) -> list[tuple[bytes, int, int]]:
    """(run, lo, hi) of the page's suffixes: the ``depth`` tokens from a place of its token stream on,
    as a 128-bit hash with the host's name, which is as deep as suffixes need to be sorted to find
    long runs. The stream has a border, with its element, before each block and one at the end.

    lo to hi (exclusive) are the places that a repeated run covers: all of them inside one block,
    else those of the blocks that it holds whole, from its first border to its last. Every place of
    blocks outside the article, or with a mark, begins a suffix; a plain block of the article, whose
    repeats are copies and stay, only has those at its borders."""
    words: list[str] = []
    edge: list[bool] = []
    starts: list[int] = []
    for text, main, mark, border in page:
        own = text.split(" ")
        if not (main and not mark):
            starts += range(len(words), len(words) + len(own) + 1)
        else:
            starts.append(len(words))
        words.append("\n" + border)
        words += own
        edge.append(True)
        edge += [False] * len(own)
    words.append("\n")
    edge.append(True)
    out = []
    h, head = xxhash.xxh3_128_digest, host + "\0"
    for i in starts:
        if i + depth > len(words):
            break
        e = edge[i : i + depth]
        lo, hi = i, i + depth
        if True in e:
            lo, hi = i + e.index(True), i + depth - e[::-1].index(True)
        out.append((h((head + " ".join(words[i : i + depth])).encode("utf-8", "surrogatepass")), lo, hi))
    return out


def finish(page: list[tuple[str, bool, int, str]], covered: list[tuple[int, int]]) -> tuple[str, int, int]:
    """(text, tokens that repeated runs took, tokens that structure alone took) of a page whose
    token stream has repeated runs at ``covered``. In order:

    * plain blocks of the article stay, repeated or not: a run that articles share is a copy;
    * of all else, tokens in a repeated run go;
    * of what the host shows once, blocks in boilerplate elements go, and on pages with an article
      those outside it; the unique runs of other blocks stay."""
    gone = np.zeros(sum(b[0].count(" ") + 2 for b in page) + 1, bool)
    for lo, hi in covered:
        gone[lo:hi] = True
    has_article = any(main and mark < 2 for _, main, mark, _ in page)
    lines, at, repeated, structure = [], 0, 0, 0
    for text, main, mark, _ in page:
        n = text.count(" ") + 1
        here = gone[at + 1 : at + 1 + n]
        at += n + 1
        if main and not mark:
            lines.append(text)
            continue
        cut_here = int(here.sum())
        repeated += cut_here
        if mark == 2 or (has_article and not main):
            structure += n - cut_here
        elif cut_here < n:
            lines.append(text if not cut_here else " ".join(w for w, g in zip(text.split(" "), here.tolist(), strict=True) if not g))
    return "\n".join(lines), repeated, structure


def shown(page: list[tuple[str, bool, int, str]]) -> int:
    """A page's identity: pages that show the same text are one page, whatever their ids and markup."""
    return xxhash.xxh3_64_intdigest("\n".join(b[0] for b in page).encode("utf-8", "surrogatepass")) - 2**63


def _host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str], list[list]]]:
    """(rows, hosts, parsed pages) of batches whose last two columns are __host and __html."""
    for batch in batches:
        for start, n in slices(batch.column(batch.num_columns - 1)):
            part = batch.slice(start, n)
            html = part.column(part.num_columns - 1).to_pylist()
            yield part, part.column(part.num_columns - 2).to_pylist(), [blocks(p.decode("utf-8", "replace")) if p else [] for p in html]


def _longs(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(runs), "<i8").reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def all_suffixes(work: DataFrame, depth: int) -> DataFrame:
    """(a, b, page) of the suffixes of all pages: a run's hash in two longs, and the page's identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, hosts, pages in _pages(batches):
            runs, ids = [], []
            for host, page in zip(hosts, pages, strict=True):
                own = {s[0] for s in suffixes(host, page, depth)}
                runs += own
                ids += [shown(page)] * len(own)
            yield pa.RecordBatch.from_arrays([*map(pa.array, _longs(runs)), pa.array(ids, pa.int64())], names=["a", "b", "page"])

    return work.select("__host", "__html").mapInArrow(run, "a long, b long, page long")


def repeated(runs: DataFrame) -> DataFrame:
    """(a, b) of the runs that distinct pages of a host share: equal neighbours in the order of
    suffixes, grouped with partial minima, so that no host and no run has to meet in one task."""
    both = runs.groupBy("a", "b").agg(F.min("page").alias("x"), F.max("page").alias("y"))
    return both.filter("x != y").select("a", "b")


def extract(df: DataFrame, html: str = "html", url: str = "url", depth: int = DEPTH, most_sent: int = MOST_SENT) -> DataFrame:
    """``df`` without html, with text (string), n_chars (long, its code points), cut_repeated and
    cut_structure (long, the words that repeated runs and that structure alone took).

    Each host's pages are one stream of words and borders of blocks; runs of ``depth`` tokens or more
    that distinct pages of the host share are found among its suffixes, and ``finish`` takes them out
    of every page, but for plain blocks of articles. Structure settles what a host shows once. Pages
    of a host that show the same text count as one page, so copies without an article stay whole as
    well; pages without an article that share only a part of their text lose that part.

    Repeated runs are sent to all tasks if they are ``most_sent`` or fewer; else they are joined to
    the pages' suffixes. Null and empty pages have text "" and 0; null urls, and those without a
    host, make one host; columns of the results' names are replaced, others kept as they are,
    whatever their names; repeated rows stay; an empty table gives no rows.
    """
    ship(df.sparkSession)
    results = [("text", T.StringType()), ("n_chars", T.LongType()), ("cut_repeated", T.LongType()), ("cut_structure", T.LongType())]
    gone = {html.lower(), *(n for n, _ in results)}
    rest = [c for c in df.columns if c.lower() not in gone]
    # By number, so that no name of the input can clash with one of the work.
    body = F.col(f"`{html}`").cast("binary")
    work = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)), _host(F.col(f"`{url}`")).alias("__host"), body.alias("__html"))
    kept = [f"c{i}" for i in range(len(rest))]
    shared = cut(repeated(all_suffixes(work, depth)), "repeated")
    schema = T.StructType([*(work.schema[c] for c in kept), *(T.StructField(n, t) for n, t in results)])
    width = len(kept)

    def made(part: pa.RecordBatch, done: list[tuple[str, int, int]]) -> pa.RecordBatch:
        texts, by_run, by_structure = (list(v) for v in zip(*done, strict=True)) if done else ([], [], [])
        arrays = [pa.array(texts, pa.string()), *(pa.array(v, pa.int64()) for v in ([len(t) for t in texts], by_run, by_structure))]
        return pa.RecordBatch.from_arrays([*part.columns[:width], *arrays], names=schema.names)

    if shared.count() <= most_sent:
        pairs = shared.toPandas().sort_values(["a", "b"])  # at most ``most_sent`` pairs of longs
        sent = df.sparkSession.sparkContext.broadcast((pairs["a"].to_numpy(), pairs["b"].to_numpy()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a, b = sent.value
            for part, hosts, pages in _pages(batches):
                found = [suffixes(h, p, depth) for h, p in zip(hosts, pages, strict=True)]
                x, y = _longs([s[0] for f in found for s in f])
                at = np.minimum(np.searchsorted(a, x), max(len(a) - 1, 0))
                hit = ((a[at] == x) & (b[at] == y) if len(a) else np.zeros(len(x), bool)).tolist()
                done, i = [], 0
                for page, f in zip(pages, found, strict=True):
                    done.append(finish(page, [s[1:] for s, k in zip(f, hit[i : i + len(f)], strict=True) if k]))
                    i += len(f)
                yield made(part, done)

        out = work.mapInArrow(run, schema)
    else:
        span = "array<struct<lo:int,hi:int>>"

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, hosts, pages in _pages(batches):
                found = [(k, h, s) for k, h, p in zip(part.column(0).to_pylist(), hosts, pages, strict=True) for s in suffixes(h, p, depth)]
                ints = [pa.array([f[2][i] for f in found], pa.int32()) for i in (1, 2)]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string()), *map(pa.array, _longs([f[2][0] for f in found])), *ints], names=["__key", "__host", "a", "b", "lo", "hi"])

        key = text_key(F.col("__html"))
        once = work.select(key.alias("__key"), "__host", "__html").dropDuplicates(["__key", "__host"])
        at = once.mapInArrow(places, "__key string, __host string, a long, b long, lo int, hi int").join(shared, ["a", "b"])
        spans = at.groupBy("__key", "__host").agg(F.collect_set(F.struct("lo", "hi")).alias("__at"))  # one page's, so bounded by its length
        joined = work.withColumn("__key", key).join(spans, ["__key", "__host"], "left").select(*kept, F.coalesce("__at", F.array().cast(span)).alias("__at"), "__host", "__html")

        def join_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, _, pages in _pages(batches):
                covered = part.column(width).to_pylist()
                yield made(part, [finish(p, [(s["lo"], s["hi"]) for s in c]) for p, c in zip(pages, covered, strict=True)])

        out = joined.mapInArrow(join_run, schema)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(rest)), *(n for n, _ in results))
