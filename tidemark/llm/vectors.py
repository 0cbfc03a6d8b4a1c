"""Near-duplicate vectors by a robust-pruned flat graph over overlapping cluster shards.

Shards: a tree of k-means centroids puts every vector into its nearest few leaves. Build: each shard
inserts its vectors into a graph by greedy search and robust pruning. Union: a vector's lists of
all its shards become one. Search: greedy from each shard's medoids, then the range expands over
everything near enough; where lists lead out of the shard, the search goes on between shards in
rounds. Every link is verified in double precision, and recall is audited by brute force.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.ship import ship

from .common import cut
from .components import components

#: Bounded samples (vectors, and numbers in all) that the tree's centroids are fitted on, vectors
#: aimed at per shard, children of the root and of any other split shard.
SAMPLE, SAMPLE_NUMBERS, SHARD, ROOT, FAN = 20_000, 1 << 24, 600, 512, 32
#: Out-degree, candidate pool, pruning factor, beam of the greedy search, vectors put in at once.
DEGREE, POOL, ALPHA, BEAM, BATCH = 32, 64, 1.2, 32, 128
OVERLAP = 3
#: Query vectors of one block of an audit.
BLOCK = 4096


def centroids(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means in numpy over a bounded sample."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmax(sample @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        n = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(n > 0, total / np.maximum(n, 1e-30), c)
    return c


def medoids(x: np.ndarray, k: int) -> np.ndarray:
    """Node numbers nearest to the middle of all and to the middles of ``k`` clusters of a few."""
    some = x[:: max(1, len(x) // 256)][:256]
    middles = np.concatenate([x.mean(axis=0)[None, :], centroids(some, k, 4)])
    return np.unique(np.argmax(middles @ x.T, axis=1))


class Walk:
    """Greedy beam search of several queries at once over a graph (rows of node numbers, -1 for
    none), from ``starts``. ``seen`` marks every node whose similarity has been looked at."""

    def __init__(self, x: np.ndarray, graph: np.ndarray, queries: np.ndarray, starts: np.ndarray, beam: int, slack: float = np.inf):
        self.x, self.graph, self.queries, self.slack = x, graph, queries, slack
        n, width = len(queries), max(beam, len(starts))
        self.seen = np.zeros((n, len(x)), bool)
        self.waiting = np.zeros((n, len(x)), bool)  # near enough, and not yet expanded
        self.ids = np.zeros((n, width), np.int64)
        self.sims = np.full((n, width), -np.inf)
        self.ids[:, : len(starts)] = starts
        self.sims[:, : len(starts)] = queries @ x[starts].T
        self.seen[:, starts] = True
        self.waiting[:, starts] = self.sims[:, : len(starts)] >= slack
        self.open = np.isfinite(self.sims)
        self.width = width

    def look(self, who: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unseen neighbours of ``nodes`` (a row for each of ``who``) and their similarities."""
        around = self.graph[nodes].reshape(len(who), -1)
        sim = np.full(around.shape, -np.inf)
        a, b = np.nonzero((around >= 0) & ~self.seen[who[:, None], around])
        sim[a, b] = np.einsum("nd,nd->n", self.queries[who[a]], self.x[around[a, b]])
        self.seen[who[a], around[a, b]] = True
        hit = sim[a, b] >= self.slack
        self.waiting[who[a[hit]], around[a[hit], b[hit]]] = True
        return around, sim

    def descend(self) -> Walk:
        """Expand the best open node of each beam until none is open."""
        n = np.arange(len(self.queries))
        while True:
            key = np.where(self.open, self.sims, -np.inf)
            best = np.argmax(key, axis=1)
            who = n[np.isfinite(key[n, best])]
            if not len(who):
                return self
            self.open[who, best[who]] = False
            node = self.ids[who, best[who]]
            self.waiting[who, node] = False
            around, sim = self.look(who, node[:, None])
            # A node listed twice among the neighbours is kept once.
            order = np.argsort(around, axis=1, kind="stable")
            sorted_ = np.take_along_axis(around, order, 1)
            twice = np.zeros_like(sim, bool)
            np.put_along_axis(twice, order[:, 1:], sorted_[:, 1:] == sorted_[:, :-1], 1)
            sim[twice] = -np.inf
            ids, sims = np.concatenate([self.ids[who], around], 1), np.concatenate([self.sims[who], sim], 1)
            opened = np.concatenate([self.open[who], np.isfinite(sim)], 1)
            top = np.argpartition(-sims, self.width - 1, axis=1)[:, : self.width]
            self.ids[who], self.sims[who], self.open[who] = (np.take_along_axis(v, top, 1) for v in (ids, sims, opened))

    def expand(self, ahead: int = 8) -> Walk:
        """Go on from every node within the range, until no new one comes up."""
        while len(who := np.flatnonzero(self.waiting.any(axis=1))):
            nodes = np.empty((len(who), ahead), np.int64)
            for c in range(ahead):
                first = np.argmax(self.waiting[who], axis=1)
                nodes[:, c] = first
                self.waiting[who, first] = False
            self.look(who, nodes)
        return self


def prune(x: np.ndarray, nodes: np.ndarray, cand: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """The lists (-1 padded) of ``nodes`` out of their rows of candidates (-1 for none): keep the
    nearest, drop those that the kept one is ``alpha`` times nearer to than the node is, and go on."""
    q = np.arange(len(nodes))
    near = np.einsum("qd,qcd->qc", x[nodes], x[cand])
    near[(cand < 0) | (cand == nodes[:, None])] = -np.inf
    dist = np.sqrt(np.maximum(2 - 2 * np.where(np.isfinite(near), near, 1), 0))
    between = x[cand] @ x[cand].transpose(0, 2, 1)
    out = np.full((len(nodes), degree), -1, np.int64)
    for r in range(degree):
        best = np.argmax(near, axis=1)
        alive = np.isfinite(near[q, best])
        if not alive.any():
            break
        pick = cand[q, best]
        out[alive, r] = pick[alive]
        apart = np.sqrt(np.maximum(2 - 2 * between[q, best], 0))
        near[(alpha * apart <= dist) | (cand == pick[:, None])] = -np.inf
    return out


def robust_graph(x: np.ndarray, degree: int = DEGREE, pool: int = POOL, alpha: float = ALPHA, seed: int = 7) -> np.ndarray:
    """Adjacency (rows of node numbers, -1 padded) of unit vectors. Nodes go in by random order, at
    first one by one and then BATCH at a time: each searches the graph so far, its pool of what it
    saw and of the batch is pruned to its list, and the nodes in it list it too, pruned again where
    that makes a list too long."""
    m = len(x)
    graph = np.full((m, degree), -1, np.int64)
    order = np.random.default_rng(seed).permutation(m)
    done = 1
    while done < m:
        new = order[done : done + min(BATCH, done, m - done)]
        walk = Walk(x, graph, x[new], order[:1], BEAM).descend()
        rows, cols = np.nonzero(walk.seen)
        sims = np.full((len(new), len(new) + int(walk.seen.sum(axis=1).max())), -2.0)
        cand = np.full(sims.shape, -1, np.int64)
        cand[:, : len(new)], sims[:, : len(new)] = new, x[new] @ x[new].T
        place = len(new) + np.arange(len(rows)) - np.concatenate([[0], np.cumsum(walk.seen.sum(axis=1))[:-1]])[rows]
        cand[rows, place], sims[rows, place] = cols, np.einsum("nd,nd->n", x[new[rows]], x[cols])
        top = np.argpartition(-sims, min(pool, sims.shape[1] - 1), axis=1)[:, : pool + 1]
        graph[new] = prune(x, new, np.take_along_axis(cand, top, 1), degree, alpha)
        done += len(new)
        # The other direction: what lists a new node is listed by it.
        a, b = np.repeat(new, degree), graph[new].reshape(-1)
        a, b = a[b >= 0], b[b >= 0]
        by = np.argsort(b, kind="stable")
        a, b = a[by], b[by]
        ends, first, count = np.unique(b, return_index=True, return_counts=True)
        incoming = np.full((len(ends), int(count.max())), -1, np.int64)
        incoming[np.repeat(np.arange(len(ends)), count), np.arange(len(b)) - np.repeat(first, count)] = a
        known = (incoming[:, :, None] == graph[ends][:, None, :]).any(axis=2)
        incoming[known] = -1
        both = np.concatenate([graph[ends], incoming], 1)
        total = (both >= 0).sum(axis=1)
        fits = total <= degree
        packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)
        graph[ends[fits]] = packed[fits, :degree]
        if not fits.all():
            graph[ends[~fits]] = prune(x, ends[~fits], packed[~fits, : int(total.max())], degree, alpha)
    return graph


def range_search(x: np.ndarray, graph: np.ndarray, least: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(query, found) node numbers, every node a query: all found at ``least`` or more.

    The search goes from the medoids down to the query's neighbourhood; then every node within the
    range has its list looked at, until no new one comes up. A query whose walk has not come by its
    own node starts again from there."""
    m = len(x)
    slack = least - 1e-4
    starts = medoids(x, max(1, int(np.sqrt(m) / 4)))
    left, right = [], []
    for at in range(0, m, 512):
        q = np.arange(at, min(at + 512, m))
        walk = Walk(x, graph, x[q], starts, beam, slack).descend()
        lost = np.flatnonzero(~walk.seen[np.arange(len(q)), q])
        walk.seen[lost, q[lost]] = walk.waiting[lost, q[lost]] = True
        walk.expand()
        a, b = np.nonzero(walk.seen)
        sure = np.zeros(len(a), bool)
        for s in range(0, len(a), 1 << 18):
            sure[s : s + (1 << 18)] = np.einsum("nd,nd->n", x[q[a[s : s + (1 << 18)]]], x[b[s : s + (1 << 18)]]) >= least
        sure &= q[a] != b
        left.append(q[a[sure]])
        right.append(b[sure])
    return np.concatenate(left) if left else np.empty(0, np.int64), np.concatenate(right) if right else np.empty(0, np.int64)


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable(v: str) -> Column:
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col("vec_id").isNotNull() & F.col(v).isNotNull() & whole & F.exists(v, lambda x: x != 0)


def _rows(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    return df.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{embedding}`").alias("v"))


def audit(df: DataFrame, found: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least: float = 0.9, every: int = 50) -> tuple[int, int]:
    """(links found, links there are) of the vectors of all rows whose id ``every`` divides, against
    all rows by brute force in double precision. Equal vectors count once on either side, so that
    copies, which need no search, can't make up for links between different vectors.

    Queries go in blocks of BLOCK vectors, one pass over the distinct vectors a block; a task
    returns a count for each query of the block."""
    rows = _rows(df, vec_id, embedding).filter(_usable("v"))
    nodes = rows.groupBy("v").agg(F.min(F.when(F.col("vec_id") % every == 0, F.col("vec_id"))).alias("q"))
    nodes = cut(nodes, "audit")
    asked = nodes.filter("q is not null")
    n = asked.count()
    blocks = -(-n // BLOCK)
    there = 0
    for k in range(blocks):
        some = asked.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == k).toPandas()  # about BLOCK vectors
        by = {d: _unit(g["v"]) for d, g in some.groupby(some["v"].map(len))}
        shared = df.sparkSession.sparkContext.broadcast(by)

        def count(batches, shared=shared):
            total = 0
            for b in batches:
                for d, g in b.groupby(b["v"].map(len)):
                    if (q := shared.value.get(d)) is not None:
                        x = _unit(g["v"])
                        for at in range(0, len(x), 2048):
                            total += int((q @ x[at : at + 2048].T >= least).sum())
            yield pd.DataFrame({"c": [total]})

        # Each query finds itself; that isn't a link.
        there += int(nodes.select("v").mapInPandas(count, "c long").agg(F.sum("c")).first()[0] or 0) - len(some)
        shared.destroy()
    got = found.select("vec_id", "n_distinct").join(asked.select(F.col("q").alias("vec_id")), "vec_id").groupBy("vec_id").agg(F.max("n_distinct").alias("n"))
    return int(got.agg(F.sum("n")).first()[0] or 0), there


def audited(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least: float = 0.9, recall: float = 0.95) -> DataFrame:
    """near_duplicates, its recall measured; while it is under ``recall``, done again with a wider
    overlap of shards. Fails if the widest doesn't reach it."""
    for overlap in (OVERLAP, 2 * OVERLAP, 4 * OVERLAP):
        found = cut(near_duplicates(df, vec_id, embedding, least, overlap=overlap), "linked")
        got, there = audit(df, found, vec_id, embedding, least)
        if got >= recall * there:
            return found
    raise RuntimeError(f"the search found {got} of {there} links of the audited vectors")


def _sample(df: DataFrame, want: str, have: str) -> DataFrame:
    """Rows by the order of a hash of the id: about ``want`` of ``have`` (SQL texts)."""
    return df.filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < F.expr(f"least(1.0D, {want} / greatest({have}, 1)) * {1 << 30}"))


def _children(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centroids of each vector."""
    sim = x @ c.T
    n = min(n, c.shape[0])
    return np.argpartition(-sim, n - 1, axis=1)[:, :n]


def shards(nodes: DataFrame, total: int, shard: int, overlap: int) -> DataFrame:
    """(id, v, copies, shard) of every node in each of its shards, by a tree of centroids.

    The root's are fitted on a bounded sample on the driver; a shard of over 4 ``shard`` times
    ``overlap`` nodes is split in turn by centroids of a bounded sample of its own, in tasks that
    hold no more than such a part of it, until none is left. Nodes go to the nearest ``overlap``
    centroids of the root and the nearest two of every further split. A shard that its centroids
    can't split is dealt out at random, each node to two parts, as vectors that lie so close can
    reach one another through any."""
    spark = nodes.sparkSession
    k = max(1, min(ROOT, -(-total // shard)))
    centres: dict[int, np.ndarray] = {}
    if total:
        widest = nodes.agg(F.max("dim")).first()[0]
        bound = max(256, min(SAMPLE, SAMPLE_NUMBERS // widest))
        for dim, group in _sample(nodes.select("v", "dim", "id"), str(bound), str(total)).toPandas().groupby("dim"):
            centres[int(dim)] = centroids(_unit(group["v"]), max(1, round(k * len(group) / max(1, min(total, bound)))))
    shared = spark.sparkContext.broadcast(centres)  # at most ROOT vectors a length

    def assign(batches):
        for b in batches:
            out = []
            for dim, g in b.groupby("dim"):
                c = shared.value.get(int(dim))
                near = _children(_unit(g["v"]), c if c is not None else np.ones((1, int(dim))), overlap)
                out.append(g.assign(shards=[[f"{dim}.{i}" for i in row] for row in near.tolist()]))
            yield pd.concat(out) if out else b.assign(shards=[])

    v = dict(nodes.dtypes)["v"]
    placed = nodes.mapInPandas(assign, f"v {v}, id long, copies long, dim int, shards array<string>")
    placed = cut(placed.select("id", "v", "copies", F.explode("shards").alias("shard")), "placed")
    most = 4 * shard * overlap
    while True:
        sizes = cut(placed.groupBy("shard").agg(F.count("*").alias("n")).filter(f"n > {most}"), "sizes")
        if not sizes.count():
            return placed
        sample = _sample(placed.join(sizes, "shard"), str(FAN * 64), "n")

        def fit(g: pd.DataFrame) -> pd.DataFrame:
            x = _unit(g["v"])
            c = centroids(x, int(min(FAN, max(2, -(-int(g["n"].iloc[0]) // shard)))))
            held = np.bincount(np.argmax(x @ c.T, axis=1), minlength=len(c))
            # Without a real split the parts are dealt at random.
            return pd.DataFrame({"shard": g["shard"].iloc[0], "c": [c.reshape(-1).tolist() if held.max() < 0.8 * len(x) else None], "k": len(c)})

        fitted = sample.groupBy("shard").applyInPandas(fit, "shard string, c array<double>, k int")
        salts = sizes.withColumn("salts", F.ceil(F.col("n") / most).cast("int"))
        fitted = cut(fitted.join(salts, "shard"), "fitted")
        big = placed.join(salts.select("shard", "salts"), "shard").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
        each = fitted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("shard", "salt", "c", "k")

        def split(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left):
                return pd.DataFrame({"id": [], "v": [], "copies": [], "shard": []})
            c, k = right["c"].iloc[0], int(right["k"].iloc[0])
            if c is None:
                near = (left["id"].to_numpy()[:, None] * np.array([0x9E3779B1, 0x85EBCA6B]) >> 7) % (2 * k)
                near[:, 1] = np.where(near[:, 0] == near[:, 1], (near[:, 1] + 1) % (2 * k), near[:, 1])
            else:
                near = _children(_unit(left["v"]), np.asarray(c).reshape(k, -1), 2)
            out = left.assign(child=near.tolist()).explode("child")
            return pd.DataFrame({"id": out["id"], "v": out["v"], "copies": out["copies"], "shard": out["shard"] + "." + out["child"].astype(str)})

        parts = max(24, min(20_000, total * overlap // most))
        finer = big.repartition(parts, "shard", "salt").groupBy("shard", "salt").cogroup(each.groupBy("shard", "salt")).applyInPandas(split, f"id long, v {v}, copies long, shard string")
        placed = cut(placed.join(sizes, "shard", "left_anti").select("id", "v", "copies", "shard").unionByName(finer), "placed")


def _between_shards(first: DataFrame, united: DataFrame, info: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b, linked though no shard has both: the search goes on where lists lead out.

    ``first`` has (id, far): nodes of other shards on the lists of what is near to id. Each round
    joins candidates to their vectors, verifies them, and takes the lists of the new links' ends,
    until no new link comes up; a pair is looked at once."""

    def pairs(q: DataFrame) -> DataFrame:
        return q.filter("q != u").select(F.least("q", "u").alias("a"), F.greatest("q", "u").alias("b")).distinct()

    def verify(batches):
        for b in batches:
            for _, g in b.groupby(b["va"].map(len)):
                yield g[["a", "b", "ca", "cb"]][np.einsum("nd,nd->n", _unit(g["va"]), _unit(g["vb"])) >= least]

    left = info.select(F.col("id").alias("a"), F.col("v").alias("va"), F.col("copies").alias("ca"), F.col("shards").alias("sa"))
    right = info.select(F.col("id").alias("b"), F.col("v").alias("vb"), F.col("copies").alias("cb"), F.col("shards").alias("sb"))

    def check(candidates: DataFrame) -> DataFrame:
        # By shards first, so that vectors are only carried for what no shard has compared.
        apart = candidates.join(left.select("a", "sa"), "a").join(right.select("b", "sb"), "b").filter(~F.arrays_overlap("sa", "sb")).select("a", "b")
        both = cut(apart, "apart").join(left.drop("sa"), "a").join(right.drop("sb"), "b").filter(F.size("va") == F.size("vb"))
        return cut(both.select("a", "b", "ca", "cb", "va", "vb").mapInPandas(verify, "a long, b long, ca long, cb long"), "across")

    frontier = cut(pairs(first.select(F.col("id").alias("q"), F.explode("far").alias("u"))), "frontier")
    seen, out = frontier, None
    while True:
        new = check(frontier)
        out = new if out is None else out.unionByName(new)
        if not new.count():
            return out
        ends = new.select(F.col("a").alias("q"), F.col("b").alias("id")).union(new.select(F.col("b").alias("q"), F.col("a").alias("id")))
        frontier = cut(pairs(ends.join(united, "id").select("q", F.explode("near").alias("u"))).join(seen, ["a", "b"], "left_anti"), "frontier")
        seen = seen.union(frontier)


def near_duplicates(
    df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least: float = 0.9, shard: int = SHARD, overlap: int = OVERLAP
) -> DataFrame:
    """(vec_id, n_links, component_id, kept, n_distinct) for every row; n_distinct counts linked
    vectors that differ from one another and from the row's own.

    Equal vectors are one node with a count, and nodes go to overlapping shards (``shards``). Each
    shard builds its robust-pruned graph; a node's lists are united over its shards; each shard
    searches with every member as query, and where a list of a node near the query names one of
    another shard, that pair is looked at by the rounds between shards. A pair that several shards
    hold counts in the first they share. Only counts, one link to the least member found, and names
    of other shards' nodes leave a task, so a group of copies isn't expanded into pairs.

    Vectors that are null, empty, zero or hold nulls or non-finite numbers have no link; only
    vectors of one length are compared; a null id has no links and a null component; rows repeated
    with one id and vector count once; no rows give no rows.
    """
    spark = df.sparkSession
    ship(spark)
    rows = _rows(df, vec_id, embedding).withColumn("ok", F.coalesce(_usable("v"), F.lit(False)))
    usable = rows.filter("ok").select("vec_id", "v")
    nodes = cut(usable.distinct().groupBy("v").agg(F.min("vec_id").cast("long").alias("id"), F.count("*").alias("copies")).withColumn("dim", F.size("v")), "nodes")
    total = nodes.count()
    placed = shards(nodes, total, shard, overlap)
    of = cut(placed.groupBy("id").agg(F.sort_array(F.collect_set("shard")).alias("shards")), "shards")
    members = cut(placed.join(of, "id"), "members")
    # Asked for by number, so that Spark doesn't put the shards of a few MB into one task.
    parts = max(24, min(20_000, total * overlap // shard))

    def build(g: pd.DataFrame) -> pd.DataFrame:
        graph, ids = robust_graph(_unit(g["v"])), g["id"].to_numpy()
        return pd.DataFrame({"id": ids, "near": [ids[row[row >= 0]] for row in graph]})

    lists = members.select("id", "v", "shard").repartition(parts, "shard").groupBy("shard").applyInPandas(build, "id long, near array<long>")
    united = cut(lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "united")

    def search(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id", ignore_index=True)
        ids, x = g["id"].to_numpy(), _unit(g["v"])
        flat = np.concatenate([np.asarray(n, np.int64) for n in g["near"]]) if len(g) else np.empty(0, np.int64)
        sizes = np.array([len(n) for n in g["near"]])
        at = np.searchsorted(ids, flat)
        local = (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == flat)
        row = np.repeat(np.arange(len(ids)), sizes)
        here = np.bincount(row[local], minlength=len(ids))
        graph = np.full((len(ids), max(1, int(here.max()))), -1, np.int64)
        start = np.concatenate([[0], np.cumsum(here)[:-1]])
        graph[row[local], np.arange(int(local.sum())) - start[row[local]]] = at[local]
        a, b = range_search(x, graph, least)
        # What either end found is a link of both.
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
        code = np.unique(a * len(ids) + b)
        a, b = code // len(ids), code % len(ids)
        outside = [flat[e - n : e][~local[e - n : e]] for e, n in zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True)]
        far: list[np.ndarray | None] = [None] * len(ids)
        for q, s, e in zip(*(v.tolist() for v in _runs(a)), strict=True):
            found = [outside[i] for i in b[s:e].tolist() if len(outside[i])]
            if found:
                far[q] = np.unique(np.concatenate(found))
        low = np.arange(len(ids))
        while len(a):  # the least member each reaches by the links of this task
            new = low.copy()
            np.minimum.at(new, a, low[b])
            new = new[new]
            if (new == low).all():
                break
            low = new
        names, own = np.unique(np.concatenate(g["shards"].to_list()), return_inverse=True)
        mine = int(np.searchsorted(names, g["shard"].iloc[0]))
        width = max(map(len, g["shards"]))
        held = np.full((len(ids), width), -1, np.int64)
        ends = np.cumsum([len(s) for s in g["shards"]]).tolist()
        for r, e in enumerate(ends):
            n = len(g["shards"].iloc[r])
            held[r, :n] = own[e - n : e]
        first = np.ones(len(a), bool)
        for c in range(width):  # an earlier shard that both have counts the pair
            s = held[a, c]
            first &= ~((s >= 0) & (s < mine) & (held[b] == s[:, None]).any(axis=1))
        a, b = a[first], b[first]
        n = np.bincount(a, weights=g["copies"].to_numpy()[b], minlength=len(ids)).astype(np.int64)
        out = pd.DataFrame({"id": ids, "n": n, "d": np.bincount(a, minlength=len(ids)), "low": ids[low], "far": far})
        return out[(out["n"] > 0) | (out["low"] != out["id"]) | out["far"].notna()]

    found = members.join(united, "id").repartition(parts, "shard").groupBy("shard").applyInPandas(search, "id long, n long, d long, low long, far array<long>")
    found = cut(found, "found")
    info = nodes.select("id", "v", "copies").join(of, "id")
    across = _between_shards(found.filter("far is not null").select("id", "far"), united, info, least)
    one, two = across.selectExpr("a as id", "cb as n", "1L as d"), across.selectExpr("b as id", "ca as n", "1L as d")
    counts = found.select("id", "n", "d").unionByName(one).unionByName(two).groupBy("id").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    groups = components(found.select(F.col("id").alias("a"), F.col("low").alias("b")).union(across.select("a", "b")))
    result = nodes.select("v", "id", "copies").join(counts, "id", "left").join(groups, "id", "left")
    result = result.select("v", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce("d", F.lit(0)).cast("long").alias("n_distinct"))
    result = cut(result, "result")
    # Vectors with many copies, 1,000 at most as each holds a thousandth of all rows, are sent to the
    # rows, so that copies needn't meet in one task; the others are joined.
    often = max(1000, usable.count() // 1000)
    hot, cold = result.filter(F.col("copies") >= often).drop("copies"), result.filter(F.col("copies") < often).drop("copies")
    columns = ["vec_id", "n_links", "component_id", "n_distinct"]
    linked = usable.join(F.broadcast(hot), "v").select(*columns)
    linked = linked.unionByName(usable.join(F.broadcast(hot.select("v")), "v", "left_anti").join(cold, "v").select(*columns))
    alone = rows.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(0).cast("long").alias("n_distinct"))
    out = linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    return out.select("vec_id", "n_links", "component_id", "kept", "n_distinct")


def _runs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, start, end) of the runs of equal numbers in a sorted array."""
    values, start = np.unique(a, return_index=True)
    return values, start, np.concatenate([start[1:], [len(a)]]).astype(np.int64) if len(a) else start
