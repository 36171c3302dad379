"""Embedding near-dedup: one navigable small-world graph per shard, every shard queried.

Null, zero and non-finite vectors (and those holding nulls) link with nothing. Bit-equal vectors
are folded first and counted as links of each other. A shard's graph is built in one task and stored
as a row. There are SHARDS shards until each holds SHARD_ROWS vectors, and more beyond: as long as
their number stays, work grows little faster than the input. Each two shards meet in one task, where
the vectors of the later one query the earlier one's graph; within a shard each vector asks for those
before it. Every two vectors are thus asked about once, and a link counts for both ends.

Beams double until an audit against brute force, over members of all shards and query by query,
reaches ``recall`` for each; they double for a single query while its whole beam is within the
threshold, so that no number of partners is a cap. Where a beam comes near the cost of it, brute
force takes over, for a query or, if the audit keeps failing, for a shard. Each hit is confirmed by
cosine in double precision. Vectors of different lengths never link.

Rows are told apart by place, so repeated and null vec_ids are vectors of their own; a component is
named after its least vec_id that is not null, and a null vec_id is not ``kept``. Extra columns, whatever
their names, don't matter; an empty table gives an empty result.
"""

from collections.abc import Iterator

import pickle

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm.common import components, cut


#: Shards at least (but for SMALL vectors a shard), and vectors of a shard at most.
SHARDS, SHARD_ROWS, SMALL = 4, 65_536, 256
#: In place of a beam: the shard failed its audit at every beam and is searched by brute force.
BRUTE = 0
#: Own members that a shard's audit asks; four times as many are drawn from all shards together.
AUDIT = 64


class Graph:
    """Small-world graph over the rows ``raw``; the first rows form the upper layers."""

    def __init__(self, raw: np.ndarray, m: int = 16, build: int = 48, seed: int = 3):
        self.raw, self.norm, self.m = raw, np.linalg.norm(raw.astype(np.float64), axis=1), m
        n = len(raw)
        self.f = (raw / self.norm[:, None]).astype(np.float32)
        level = np.floor(-np.log(np.random.default_rng(seed).random(n)) / np.log(m)).astype(int)
        order = np.argsort(-level, kind="stable")
        self.order, self.f = order, self.f[order]
        sizes = [int((level >= k).sum()) for k in range(1, int(level.max(initial=0)) + 1)]
        self.upper = [self.nearest(k) for k in sizes if k > 1][::-1]
        self.g = np.full((n, 2 * m), -1, np.int32)
        done = min(n, 2 * m + 1)
        first = self.nearest(done)
        self.g[:done, : first.shape[1]] = first
        while done < n:
            new = np.arange(done, min(n, done + min(512, done)))
            ids, sims = self.search(self.f[new], build, done)
            own = self.f[new] @ self.f[new].T
            np.fill_diagonal(own, -2)
            k = min(build, len(new))
            near = np.argpartition(-own, k - 1, 1)[:, :k]
            ids = np.concatenate([ids, new[near]], 1)
            sims = np.concatenate([sims, np.take_along_axis(own, near, 1)], 1)
            links = self.diverse(ids, sims, m)
            self.g[new, :m] = links
            self.backlink(np.repeat(new, m), links.ravel())
            done = int(new[-1]) + 1

    def __getstate__(self):
        return self.__dict__ | {"f": None}

    def __setstate__(self, state):
        self.__dict__ = state
        self.f = (self.raw / self.norm[:, None]).astype(np.float32)[self.order]

    def nearest(self, k: int) -> np.ndarray:
        s = self.f[:k] @ self.f[:k].T
        np.fill_diagonal(s, -2)
        return self.diverse(np.argsort(-s, 1)[:, : 4 * self.m], -np.sort(-s, 1)[:, : 4 * self.m], self.m)

    def diverse(self, ids, sims, m):
        """Up to m links per row, preferring candidates nearer to the row than to a chosen one."""
        o = np.argsort(-sims, 1)
        ids, sims = np.take_along_axis(ids, o, 1), np.take_along_axis(sims, o, 1)
        good = (ids >= 0) & (sims > -2)
        v = self.f[np.maximum(ids, 0)]
        pair = v @ v.transpose(0, 2, 1)
        worst = np.full(ids.shape, -2, np.float32)
        taken, count = np.zeros(ids.shape, bool), np.zeros(len(ids), int)
        for j in range(ids.shape[1]):
            ok = good[:, j] & (count < m) & (sims[:, j] > worst[:, j])
            taken[:, j] = ok
            count += ok
            worst = np.where(ok[:, None], np.maximum(worst, pair[:, j]), worst)
        rank = np.where(taken, 0, np.where(good, 1, 2)) * 10_000 + np.arange(ids.shape[1])
        pick = np.argsort(rank, 1)[:, :m]
        out = np.where(np.take_along_axis(good, pick, 1), np.take_along_axis(ids, pick, 1), -1)
        return np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1).astype(np.int32)

    def backlink(self, src, dst):
        src, dst = src[dst >= 0], dst[dst >= 0]
        sims = np.einsum("nd,nd->n", self.f[src], self.f[dst])
        o = np.lexsort((-sims, dst))
        src, dst = src[o], dst[o]
        first = np.flatnonzero(np.concatenate([[True], dst[1:] != dst[:-1]])) if len(dst) else np.zeros(0, int)
        place = np.arange(len(dst)) - np.repeat(first, np.diff(np.concatenate([first, [len(dst)]])))
        # A hub's links come in turns of 64, nearest first, so that all are considered.
        for low in range(0, int(place.max(initial=-1)) + 1, 64):
            now = (place >= low) & (place < low + 64)
            rows, at = np.unique(dst[now], return_inverse=True)
            new = np.full((len(rows), int(place[now].max()) - low + 1), -1, np.int32)
            new[at, place[now] - low] = src[now]
            ids = np.concatenate([self.g[rows], new], 1)
            s = np.einsum("rd,rcd->rc", self.f[rows], self.f[np.maximum(ids, 0)])
            s[ids < 0] = -2
            self.g[rows] = self.diverse(ids, s, 2 * self.m)

    def search(self, q, beam: int, n: int | None = None):
        """Beam search for all rows of q together: positions (-1 where none) and similarities."""
        n = n or len(self.f)
        rows = np.arange(len(q))
        at = np.zeros(len(q), np.int64)
        best = q @ self.f[0]
        for layer in self.upper:
            if len(layer) > n:
                continue
            while True:
                nb = layer[at]
                s = np.where(nb >= 0, np.einsum("bd,bcd->bc", q, self.f[np.maximum(nb, 0)]), -2)
                j = s.argmax(1)
                better = s[rows, j] > best
                if not better.any():
                    break
                at, best = np.where(better, nb[rows, j], at), np.maximum(best, s[rows, j])
        beam = min(beam, n)
        ids, sims = np.full((len(q), beam), -1, np.int64), np.full((len(q), beam), -2, np.float32)
        ids[:, 0], sims[:, 0] = at, best
        open_, seen = ids >= 0, np.zeros((len(q), n), bool)
        seen[rows, at] = True
        wide = 2
        while True:
            live = np.flatnonzero(open_.any(1))
            if not len(live):
                return ids, sims
            look = np.where(open_[live], sims[live], -3)
            pick = np.argsort(-look, 1)[:, :wide]
            valid = np.take_along_axis(look, pick, 1) > -3
            nodes = np.where(valid, np.take_along_axis(ids[live], pick, 1), -1)
            open_[live[:, None], pick] = False
            nb = np.where(nodes[:, :, None] >= 0, self.g[np.maximum(nodes, 0)], -1).reshape(len(live), -1)
            nb = np.sort(nb, 1)
            ok = (nb >= 0) & (nb < n)
            ok[:, 1:] &= nb[:, 1:] != nb[:, :-1]
            ok &= ~seen[live[:, None], np.where(ok, nb, 0)]
            r, c = np.nonzero(ok)
            seen[live[r], nb[r, c]] = True
            s = np.full(nb.shape, -2, np.float32)
            s[r, c] = np.einsum("nd,nd->n", q[live[r]], self.f[nb[r, c]])
            every, al = np.concatenate([sims[live], s], 1), np.concatenate([ids[live], np.where(ok, nb, -1)], 1)
            op = np.concatenate([open_[live], ok], 1)
            top = np.argpartition(-every, beam - 1, 1)[:, :beam]
            sims[live], ids[live], open_[live] = (np.take_along_axis(a, top, 1) for a in (every, al, op))

    def sure(self, q: np.ndarray, a: np.ndarray, b: np.ndarray, low: float) -> tuple[np.ndarray, np.ndarray]:
        """The pairs whose cosine in double precision is at least ``low``; q has unit rows."""
        ok = np.concatenate([np.zeros(0, bool), *(np.einsum("nd,nd->n", q[a[i : i + 65536]], self.raw[b[i : i + 65536]].astype(np.float64)) / self.norm[b[i : i + 65536]] >= low for i in range(0, len(a), 65536))])
        return a[ok], b[ok]

    def within(self, q: np.ndarray, low: float, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All (query, position) pairs found with cosine of at least ``low``, block by block, widening single beams."""
        todo = np.arange(len(q))
        while len(todo) and beam * 16 <= max(len(self.f), 1024):
            again = []
            step = max(1, min(1024, 8_000_000 // max(len(self.f), 1)))
            for i in range(0, len(todo), step):
                t = todo[i : i + step]
                ids, sims = self.search(q[t].astype(np.float32), beam)
                full = (sims.min(1) >= low - 0.02) & (beam < len(self.f))
                again.append(t[full])
                r, c = np.nonzero((sims >= low - 1e-4) & (ids >= 0) & ~full[:, None])
                yield self.sure(q, t[r], self.order[ids[r, c]], low)
            todo, beam = np.concatenate(again), beam * 2
        yield from self.brute(q, low, todo)

    def brute(self, q: np.ndarray, low: float, todo: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All such pairs of the queries ``todo``, by blocked products."""
        todo = np.arange(len(q)) if todo is None else todo
        step = max(1, 2_000_000 // max(len(self.f), 1))
        for i in range(0, len(todo), step):
            t = todo[i : i + step]
            r, c = np.nonzero(q[t].astype(np.float32) @ self.f.T >= low - 1e-4)
            yield self.sure(q, t[r], self.order[c], low)

    def links(self, q: np.ndarray, low: float, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        return self.brute(q, low) if beam == BRUTE else self.within(q, low, beam)

    def audited(self, q: np.ndarray, own: np.ndarray, low: float, recall: float, beam: int = 32) -> int:
        """The beam at which every query's links are found as by brute force, or BRUTE if none does.

        ``own`` is a query's own position (-1 for those of other shards); it is no link. Each query
        with links must reach ``recall`` by itself, so that no large group hides a small one.
        """

        def count(blocks):
            return sum((np.bincount(a[b != own[a]], minlength=len(q)) for a, b in blocks), np.zeros(len(q), int))

        want = count(self.brute(q, low))
        while True:
            if (count(self.within(q, low, beam)) >= recall * want).all():
                return beam
            beam *= 2
            if beam * 16 > max(len(self.f), 1024):
                return BRUTE


def unit(rows) -> np.ndarray:
    x = np.stack([np.asarray(r, np.float64) for r in rows])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (positions) after the nodes a and b of each link come together under the least."""
    x, y = label[a], label[b]
    pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1)[x != y], axis=0)
    if not len(pairs):
        return label
    up: dict[int, int] = {}

    def root(v):
        while (w := up.get(v, v)) != v:
            up[v] = up.get(w, w)
            v = w
        return v

    for v, w in pairs.tolist():
        v, w = root(v), root(w)
        if v != w:
            up[max(v, w)] = min(v, w)
    to = np.arange(len(label))
    for v in list(up):
        to[v] = root(v)
    return to[label]


def near_duplicates(vectors: DataFrame, low: float = 0.9, shards: int = SHARDS, shard_rows: int = SHARD_ROWS, recall: float = 0.99) -> DataFrame:
    """vec_id, n_links, component_id, kept."""

    @F.pandas_udf("string")
    def key(e: pd.Series) -> pd.Series:
        def one(v):
            a = None if v is None else np.asarray([np.nan if c is None else c for c in v], np.float64)
            return xxhash.xxh128_hexdigest((a + 0.0).tobytes()) if a is not None and len(a) and np.isfinite(a).all() and a.any() else None

        return pd.Series([one(v) for v in e], dtype="object")

    keyed = cut(vectors.select("vec_id", "embedding").withColumn("g", key("embedding")).withColumn("row", F.monotonically_increasing_id()))
    reps = keyed.where("g is not null").groupBy("g").agg(F.min("row").alias("rep"), F.min("vec_id").alias("name"), F.count("*").alias("copies"), F.any_value("embedding").alias("e"))
    reps = cut(reps.withColumn("dim", F.size("e")))
    n = reps.count()
    shards = max(1, -(-n // shard_rows), min(shards, n // SMALL))
    reps = reps.withColumn("shard", F.pmod(F.xxhash64("g"), F.lit(shards)).cast("int"))

    picked = {}
    for r in reps.orderBy(F.xxhash64("g", F.lit(2)), "g").limit(4 * AUDIT).select("dim", "shard", "e").collect():
        picked.setdefault(r["dim"], []).append((r["shard"], r["e"]))
    sample = vectors.sparkSession.sparkContext.broadcast(picked)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        graph, rep, copies = Graph(np.stack(pdf["e"])), pdf["rep"].to_numpy(), pdf["copies"].to_numpy()
        q, place = unit(pdf["e"]), np.arange(len(pdf))
        pick = np.unique(np.linspace(0, len(pdf) - 1, AUDIT).astype(int))
        other = [e for shard, e in sample.value.get(int(pdf["dim"].iloc[0]), []) if shard != pdf["shard"].iloc[0]]
        asks = np.concatenate([q[pick], unit(other)]) if other else q[pick]
        beam = graph.audited(asks, np.concatenate([pick, np.full(len(other), -1)]), low, recall)
        links, label = np.zeros(len(pdf), np.int64), place
        for a, b in graph.links(q, low, beam):
            a, b = a[b < a], b[b < a]
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            label = merged(label, a, b)
        names = rep[label]
        blob = pickle.dumps((graph, beam, names, rep, copies))
        return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "shard": [pdf["shard"].iloc[0]], "blob": [blob], "rep": [rep], "links": [links], "label": [names]})

    graphs = cut(reps.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, blob binary, rep array<long>, links array<long>, label array<long>"))

    def ask(q: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(g):
            return pd.DataFrame({"rep": [], "links": [], "labels": pd.Series([], dtype="object")})
        graph, beam, names, rep, copies = pickle.loads(g["blob"].iloc[0])
        ids, times = q["rep"].to_numpy(), q["copies"].to_numpy()
        mine, theirs, near = np.zeros(len(ids), np.int64), np.zeros(len(rep), np.int64), [[] for _ in ids]
        for a, b in graph.links(unit(q["e"]), low, beam):
            np.add.at(mine, a, copies[b])
            np.add.at(theirs, b, times[a])
            for i, name in np.unique(np.stack([a, names[b]], 1), axis=0).tolist():
                near[i].append(name)
        met = np.flatnonzero(theirs)
        return pd.DataFrame({"rep": np.concatenate([ids, rep[met]]), "links": np.concatenate([mine, theirs[met]]), "labels": pd.Series([*near, *([] for _ in met)], dtype="object")})

    earlier = F.when(F.col("later") > 0, F.sequence(F.lit(0), F.col("later") - 1)).otherwise(F.array().cast("array<int>"))
    asked = reps.select("rep", "e", "copies", "dim", F.col("shard").alias("later")).select("*", F.explode(earlier).alias("shard"))
    ahead = F.when(F.col("shard") < shards - 1, F.sequence(F.col("shard") + 1, F.lit(shards - 1))).otherwise(F.array().cast("array<int>"))
    stored = graphs.select("dim", "shard", "blob", F.explode(ahead).alias("later"))
    hits = cut(asked.groupBy("dim", "shard", "later").cogroup(stored.groupBy("dim", "shard", "later")).applyInPandas(ask, "rep long, links long, labels array<long>"))
    within = graphs.select(F.explode(F.arrays_zip("rep", "links", "label")).alias("z")).select("z.rep", "z.links", "z.label")
    links = hits.select("rep", "links").unionByName(within.select("rep", "links")).groupBy("rep").agg(F.sum("links").alias("links"))
    edges = hits.select(F.col("rep").alias("a"), F.explode("labels").alias("b")).unionByName(within.select(F.col("rep").alias("a"), F.col("label").alias("b")))
    comp = components(edges).withColumnRenamed("id", "rep")
    named = cut(reps.select("g", "rep", "name", "copies").join(links, "rep", "left").join(comp, "rep", "left").withColumn("c", F.coalesce("component_id", "rep")))
    least = named.groupBy("c").agg(F.min("name").alias("least"))
    per = named.select("g", "c", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")).join(least, "c")
    out = keyed.select("vec_id", "g").join(per.select("g", "n_links", "least"), "g", "left")
    cid = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), cid.alias("component_id"), F.coalesce(F.col("vec_id") == cid, F.lit(False)).alias("kept"))


#: The same by all pairs, for tables that are small enough for it.
SQL = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id, vec_id AS at_ FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.at_),
c AS (SELECT vec_id, min(at_) AS component_id FROM r GROUP BY vec_id)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c"""
