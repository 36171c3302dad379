"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

Sketches fill every coordinate: in the first t rounds each element draws a bin and a value, in the
next t rounds bin i is filled by all elements. Bands of ``rows`` coordinates propose candidates; with
t = 128 and rows = 5 a pair of similarity 0.85 is missed with chance 4e-7, one of 0.8 with 4e-5.

Documents with equal sets are first folded into one representative, so copies never meet in pairs.
Candidates that share a band are joined to clusters. A cluster of bounded size is settled in one task,
which gets each member's whole set (64-bit hashes of shingles) once and links its candidates by exact
intersection, skipping pairs that are connected already. Larger clusters go on in rounds: each bucket's
most connected member is a centre that its bucket mates are compared with, and further centres follow
until every member outside a bucket's main component has been one, so that no candidate link between
components goes unseen and no pairs are made within a component.

Null and empty texts, and texts without words, are empty sets: linked with nothing, each its own
component. Repeated rows and repeated doc_ids are told apart by row; a component is named after its
least doc_id that is not null. A null doc_id gets that name (its own component has a null name) and is
not ``kept``. Extra columns, whatever their names, don't matter. An empty table gives an empty result.
"""

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from foldspark.llm.common import components, cut, drop, slices, small

MIX = np.uint64(0x9E3779B97F4A7C15)
NONE = np.iinfo(np.uint64).max
#: Members and shingles up to which a cluster is settled in one task.
MEMBERS, SHINGLES = 4096, 4_000_000


def scramble(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch(a: np.ndarray, t: int) -> np.ndarray:
    """t coordinates of the set of 64-bit hashes ``a``; rounds stop once every bin is full."""
    out = np.full(t, NONE, np.uint64)
    filled = np.zeros(t, bool)
    with np.errstate(over="ignore"):
        for i in range(2 * t):
            h = scramble(a + MIX * np.uint64(i + 1))
            low = h >> np.uint64(9)  # the round is kept above the value, as in value + round
            if i < t:
                bins = (h % np.uint64(t)).astype(np.int64)
                now = np.full(t, NONE, np.uint64)
                np.minimum.at(now, bins, low)
                fresh = ~filled & (now != NONE)
                out[fresh] = now[fresh] ^ np.uint64(i)
                filled |= fresh
            elif not filled[i - t]:
                out[i - t] = low.min() ^ np.uint64(i)
                filled[i - t] = True
            if filled.all():
                break
    return out


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a whole text.

    Lower-casing bytes changes A-Z only, and splitting them separates at 0x20 and 0x09 to 0x0D only.
    """
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    k = min(k, len(w))
    with np.errstate(over="ignore"):
        out = np.full(len(w) - k + 1, np.uint64(k))
        for i in range(k):
            out = scramble(out * MIX + h[i : len(w) - k + 1 + i])
    return np.unique(out)


class Hashes(dict):
    """64-bit hashes of words, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_sets(texts: list[str | None], k: int, known: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """The shingle sets of many texts one after the other, and the number of elements of each."""
    split = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    n = np.array([len(w) for w in split], np.int64)
    h = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.uint64, int(n.sum()))
    ends = np.cumsum(n)
    with np.errstate(over="ignore"):
        every = np.full(max(0, len(h) - k + 1), np.uint64(k))
        for i in range(k):
            every = scramble(every * MIX + h[i : len(h) - k + 1 + i])
    parts = []
    for i, (m, end) in enumerate(zip(n.tolist(), ends.tolist())):
        if m < k:
            parts.append(shingle_set(texts[i], k))
            continue
        part = np.sort(every[end - m : end - k + 1])
        new = part[1:] != part[:-1]
        parts.append(part if new.all() else part[np.concatenate([[True], new])])
    return np.concatenate([np.zeros(0, np.uint64), *parts]), np.array([len(x) for x in parts], np.int64)


def sketches(flat: np.ndarray, n: np.ndarray, t: int) -> np.ndarray:
    """``sketch`` of many sets (not empty) at once: [sets, t]. Full sets leave after each round."""
    out = np.full((len(n), t), NONE, np.uint64)
    filled = np.zeros((len(n), t), bool)
    live = np.arange(len(n))
    with np.errstate(over="ignore"):
        for i in range(2 * t):
            if not len(live):
                break
            h = scramble(flat + MIX * np.uint64(i + 1))
            low = h >> np.uint64(9)
            if i < t:
                now = np.full(len(live) * t, NONE, np.uint64)
                np.minimum.at(now, np.repeat(np.arange(len(live)) * t, n) + (h % np.uint64(t)).astype(np.int64), low)
                now = now.reshape(-1, t)
                fresh = ~filled[live] & (now != NONE)
                at, b = np.nonzero(fresh)
                out[live[at], b] = now[fresh] ^ np.uint64(i)
                filled[live[at], b] = True
            else:
                least = np.minimum.reduceat(low, np.concatenate([[0], np.cumsum(n)[:-1]])) ^ np.uint64(i)
                at = np.flatnonzero(~filled[live, i - t])
                out[live[at], i - t] = least[at]
                filled[live[at], i - t] = True
            stay = ~filled[live].all(1)
            if not stay.all():
                flat, live, n = flat[np.repeat(stay, n)], live[stay], n[stay]
    return out


def shingled(docs: DataFrame, carry: list[str], k: int, t: int, rows: int) -> DataFrame:
    """``doc`` (a struct of the columns ``carry``), ``text``, the set's size, ``g``, a 128-bit digest of the
    set (null for an empty one), ``keys``, one 64-bit key for each band of its sketch, and ``row``.

    Sets are not kept: only texts that share a band need theirs again, and texts compress better."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bands = Hashes(), range(0, t - rows + 1, rows)
        for batch in batches:
            for part, text in slices(batch, batch.column(1)):
                flat, n = shingle_sets(text.to_pylist(), k, known)
                ends = np.cumsum(n)
                v = sketches(flat, n[n > 0], t)
                keys = np.empty((len(v), len(bands)), np.uint64)
                with np.errstate(over="ignore"):
                    for b, j in enumerate(bands):
                        keys[:, b] = b + 1
                        for c in range(j, j + rows):
                            keys[:, b] = scramble(keys[:, b] * MIX + v[:, c])
                offsets = np.concatenate([[0], np.cumsum(n > 0) * len(bands)])
                g = [xxhash.xxh128_digest(flat[e - m : e].tobytes()) if m else None for e, m in zip(ends.tolist(), n.tolist())]
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), text, pa.array(n), pa.array(g, pa.binary()), lists], names=["doc", "text", "size", "g", "keys"])

    given = docs.select(F.struct(*[docs[c] for c in carry]).alias("doc"), docs["text"].cast("string").alias("text"))
    kind = StructType([given.schema["doc"], given.schema["text"], StructField("size", LongType()), StructField("g", BinaryType()), StructField("keys", ArrayType(LongType()))])
    return given.mapInArrow(one, kind).withColumn("row", F.monotonically_increasing_id())


def sizes_allow(x: str, y: str, percent: int) -> str:
    """Sizes that allow the similarity; others need no comparison."""
    return f"100 * least({x}, {y}) >= {percent} * greatest({x}, {y})"


def alike(one: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of ``others`` (sorted distinct, not empty) reach ``percent`` with ``one``."""
    sizes = np.array([len(x) for x in others])
    flat = np.concatenate(others)
    hit = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    both = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(sizes)[:-1]]), dtype=np.int64)
    return 100 * both >= percent * (len(one) + sizes - both)


def settle(keys: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Each member's component (the place of its first member), given band keys [members, bands].

    Members of many large buckets come first: they tend to connect a group at once.
    """
    n = len(sets)
    score = np.zeros(n, np.int64)
    for band in keys.T:
        _, at, count = np.unique(band, return_inverse=True, return_counts=True)
        score += count[at]
    label, done, sizes = np.arange(n), np.zeros(n, bool), np.array([len(s) for s in sets])
    for p in np.argsort(-score, kind="stable"):
        done[p] = True
        fits = 100 * np.minimum(sizes, sizes[p]) >= percent * np.maximum(sizes, sizes[p])
        mates = np.flatnonzero(fits & ~done & (label != label[p]))
        mates = mates[(keys[mates] == keys[p]).any(1)]
        for i in range(0, len(mates), 1024):
            part = mates[i : i + 1024]
            part = part[label[part] != label[p]]
            if len(part):
                for q in part[alike(sets[p], [sets[j] for j in part], percent)]:
                    label[label == max(label[p], label[q])] = min(label[p], label[q])
    return label


def sets_of(texts: list[str | None], k: int, known: Hashes) -> list[np.ndarray]:
    flat, n = shingle_sets(texts, k, known)
    return np.split(flat, np.cumsum(n)[:-1]) if len(n) else []


def settled(percent: int, k: int):
    """mapInArrow over rows (cluster, row, keys, text) ordered by cluster: links (a, b) to the first member."""
    known = Hashes()

    def solve(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        t = pa.Table.from_batches(held).combine_chunks()
        rows = t["row"].to_numpy()
        keys = pc.list_flatten(t["keys"]).to_numpy().reshape(len(rows), -1)
        sets = sets_of(t["text"].to_pylist(), k, known)
        label = settle(keys, sets, percent)
        far = np.flatnonzero(label != np.arange(len(label)))
        return rows[label[far]], rows[far]

    def batch(out):
        a, b = (np.concatenate(x) for x in zip(*out))
        return pa.RecordBatch.from_pydict({"a": a, "b": b})

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, out = [], None, []
        for b in batches:
            c = b.column("cluster").to_numpy()
            starts = [0, *(np.flatnonzero(c[1:] != c[:-1]) + 1)] if len(c) else []
            for low, high in zip(starts, [*starts[1:], len(c)]):
                if held and c[low] != last:
                    out.append(solve(held))
                    held = []
                    if len(out) >= 1000:
                        yield batch(out)
                        out = []
                held.append(b.slice(low, high - low))
                last = c[low]
        if held:
            out.append(solve(held))
        if out:
            yield batch(out)

    return one


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach ``percent``. A centre of very many pairs makes a skewed join
    key, which adaptive execution splits over tasks."""

    def one(batches):
        for b in batches:
            ok = [bool(alike(np.frombuffer(x.as_buffer(), np.uint64), [np.frombuffer(y.as_buffer(), np.uint64)], percent)[0]) for x, y in zip(b.column("sa"), b.column("sb"))]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(sets.select(F.col("row").alias("b"), F.col("s").alias("sb")), "b").join(sets.select(F.col("row").alias("a"), F.col("s").alias("sa")), "a")
    return both.select("a", "b", "sa", "sb").mapInArrow(one, "a long, b long")


def stored_sets(texts: DataFrame, k: int) -> DataFrame:
    """row and the bytes of its set, ``s``."""

    def one(batches):
        known = Hashes()
        for batch in batches:
            for part, text in slices(batch, batch.column(1)):
                sets = [s.tobytes() for s in sets_of(text.to_pylist(), k, known)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["row", "s"])

    return texts.select("row", "text").mapInArrow(one, "row long, s binary")


def in_rounds(many: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect the members of large clusters; ``many`` has (bucket, row, size, n)."""
    score = many.groupBy("row").agg(F.sum("n").alias("score"))
    many = cut(many.join(score, "row"))
    links = cut(many.select(F.col("row").alias("a"), F.col("row").alias("b")).where("false"))
    done, width = cut(many.select("bucket", "row").where("false")), 0
    while True:
        comp = cut(components(links))
        at = many.join(comp.withColumnRenamed("id", "row"), "row", "left").withColumn("c", F.coalesce("component_id", "row"))
        per = at.groupBy("bucket", "c").agg(F.count("*").alias("m"))
        main = per.groupBy("bucket").agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.sum("m").alias("all"), F.max("m").alias("most"), F.count("*").alias("parts")).where("parts > 1")
        out = at.join(main, "bucket").join(done, ["bucket", "row"], "left_anti")
        out = out if not width else out.where("c <> main")
        # A bucket's most connected member, and about ``width`` others by hash, four times as many each round.
        lead = out.groupBy("bucket").agg(F.max_by("row", F.struct("score", "row")).alias("lead"))
        drawn = F.pmod(F.xxhash64("row", F.lit(width)), F.greatest(F.col("all") - F.col("most"), F.lit(1))) < width
        centre = cut(out.join(lead, "bucket").where((F.col("row") == F.col("lead")) | drawn).select("bucket", F.col("row").alias("centre"), F.col("c").alias("cc"), F.col("size").alias("cs")))
        width = max(1, 4 * width)
        if centre.isEmpty():
            drop(comp, many, done, centre)
            return links
        # The join itself leaves out pairs that are linked already or differ too much in size.
        here = at.alias("m").join(centre.alias("o"), F.expr("m.bucket = o.bucket and m.row <> o.centre and m.c <> o.cc and " + sizes_allow("m.size", "o.cs", percent)))
        pairs = here.selectExpr("least(centre, row) as a", "greatest(centre, row) as b").distinct()
        old = links, done, comp, centre
        links, done = cut(links.unionByName(confirmed(pairs, sets, percent))), cut(done.unionByName(centre.selectExpr("bucket", "centre as row")))
        drop(*old)


def links_of(base: DataFrame, reps: DataFrame, percent: int, k: int, members: int, shingles: int) -> DataFrame:
    """Links (a, b) between representatives' rows that span each component."""
    buckets = base.select("row", "size", "keys").join(small(reps.select("row"), reps.count()), "row").select("row", "size", F.explode("keys").alias("bucket"))
    sized = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min("row").alias("low")).where("n > 1")
    member = cut(buckets.join(sized, "bucket"))
    cluster = components(member.select(F.col("low").alias("a"), F.col("row").alias("b")).where("a <> b").distinct()).withColumnsRenamed({"id": "row", "component_id": "cluster"})
    who = cut(member.select("row", "size").distinct().join(cluster, "row"))
    stats = who.groupBy("cluster").agg((F.count("*") > members).alias("many"), (F.sum("size") > shingles).alias("wide"))
    large = cut(stats.where("many or wide").select("cluster"))
    n_large = large.count()
    few = cut(who.join(small(large, n_large), "cluster", "left_anti"))
    wanted = base.select("row", "keys", "text").join(small(few.select("row", "cluster"), few.count()), "row")
    ordered = wanted.repartition("cluster").sortWithinPartitions("cluster", "row").select("cluster", "row", "keys", "text")
    links = cut(ordered.mapInArrow(settled(percent, k), "a long, b long"))
    if n_large:
        big = cut(who.join(small(large, n_large), "cluster", "left_semi").select("row"))
        sets = cut(stored_sets(base.select("row", "text").join(small(big, big.count()), "row", "left_semi"), k))
        found = in_rounds(member.join(big, "row", "left_semi").select("bucket", "row", "size", "n"), sets, percent)
        links, old = cut(links.unionByName(found)), links
        drop(big, sets, found, old)
    drop(member, who, large, few)
    return links


def grouped(docs: DataFrame, carry: list[str], percent: int = 80, k: int = 5, t: int = 128, rows: int = 5, members: int = MEMBERS, shingles: int = SHINGLES) -> tuple[DataFrame, DataFrame]:
    """Per row of ``docs`` its ``row``, doc_id, ``size`` of its set, component_id and ``first``, true for
    exactly one row of each group: among the rows of its least doc_id, the first in the input's order (null
    ids come last); and, by ``row``, ``doc`` (a struct of the columns ``carry``, doc_id first) and ``text``."""
    base = cut(shingled(docs, carry, k, t, rows))
    ident = F.struct(F.col("doc.doc_id").isNull().alias("none"), F.col("doc.doc_id").alias("id"), F.col("row").alias("row"))
    reps = cut(base.where("g is not null").groupBy("g").agg(F.min("row").alias("row"), F.min(ident).alias("lead")))
    links = links_of(base, reps, percent, k, members, shingles)
    comp = cut(components(links).withColumnRenamed("id", "row"))
    named = reps.join(comp, "row", "left").withColumn("c", F.coalesce("component_id", "row")).select("g", "c", "lead")
    lead = named.groupBy("c").agg(F.min("lead").alias("lead"))
    per = named.select("g", "c").join(lead, "c").select("g", F.col("lead.id").alias("id"), F.col("lead.row").alias("lead"))
    out = base.select("row", "doc.doc_id", "size", "g").join(per, "g", "left")
    # Empty sets have no digest: each is a group of its own.
    first = F.when(F.col("lead").isNull(), True).otherwise(F.col("lead") == F.col("row"))
    cid = F.when(F.col("lead").isNull(), F.col("doc_id")).otherwise(F.col("id"))
    out = cut(out.select("row", "doc_id", "size", cid.alias("component_id"), first.alias("first")))
    drop(reps, links, comp)
    return out, base


def near_duplicates(docs: DataFrame, percent: int = 80, **how) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (doc_id = component_id; false for a null doc_id)."""
    found, base = grouped(docs, ["doc_id"], percent, **how)
    drop(base)
    same = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return found.select("doc_id", F.col("size").alias("n_shingles"), "component_id", same.alias("kept"))


def one_of_each(docs: DataFrame, percent: int = 80, **how) -> DataFrame:
    """The rows of ``docs``, one for each group of near duplicates, with all columns as they are.

    The rows that go are looked up by row; no text is shuffled while their ids can be broadcast."""
    found, base = grouped(docs, ["doc_id", *[c for c in docs.columns if c not in ("doc_id", "text")]], percent, **how)
    gone = cut(found.where(~F.col("first")).select("row"))
    left = base.select("row", "doc", "text").join(small(gone, gone.count()), "row", "left_anti")
    return left.select(*[F.col("text") if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns])


#: The same by all pairs that share a shingle, for tables that are small enough for it.
SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS both_ FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * both_ >= 85 * (na + nb - both_)),
r AS (SELECT doc_id, doc_id AS at_ FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.at_),
c AS (SELECT doc_id, min(at_) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)"""
