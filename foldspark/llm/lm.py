"""LM scoring: a log-bilinear model trained by noise-contrastive estimation, in numpy.

Counts cover all training documents (crc32(doc_id) mod 7 is not 2) and grow with the corpus. The
network predicts the next word from the two before: first one of the ``classes`` most frequent
words (the end among them) or "rare"; then, for every other word, three hash digits one after the
other, each normalised given the digits before. Digits have embeddings that words share, both as
targets and as contexts, and biases from the corpus counts. There is about one leaf of digits for
``LEAF`` distinct words, so the digits' range grows with the vocabulary; words of one leaf divide its
probability by add-one smoothed counts, with one share for all unknown words. Token probabilities
sum to one. Null texts are empty and hold only the end. The network is fitted in one pass over the
whole texts of all training documents, by as many trainers as the cluster has cores.

The most frequent words, HOT at most and all of a count or none, are broadcast. All others are counted
per document and meet their corpus counts in a shuffle join by word.
"""

import pickle
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from foldspark.llm.common import cut, fold, short_batches, slices

HOT = 200_000
LEAF = 8
END = 0  # class of the end token; also the context before a text


#: What a document's own task finds: hot words are settled, the others go on with their times.
LOCAL = pa.schema([("n", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("words", pa.list_(pa.string())), ("times", pa.list_(pa.int64()))])


#: Distinct words that a task counts before it hands its counts on.
COUNTED = 200_000
#: Bytes of text that are split into words at once (one text at least).
BYTES = 2_000_000


def split(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after the other, A-Z lower-cased, and each word's text by its place."""
    # Arrow's ASCII kernels read bytes: white space is 0x20 and 0x09 to 0x0D only. They give empty words at the edges.
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(text, "")))
    owner = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    words = words.flatten()
    full = pc.greater(pc.binary_length(words), 0)
    return words.filter(full), owner[full.to_numpy(zero_copy_only=False)]


def indexed(words: pa.Array) -> tuple[pa.Array, np.ndarray, list[bytes]]:
    """The distinct words, each word's place among them, and the distinct words as bytes."""
    d = words.dictionary_encode()
    # Through numpy, as to_pylist() makes a scalar of each first.
    return d.dictionary, d.indices.to_numpy(zero_copy_only=False), d.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()


def corpus_counts(train: DataFrame) -> DataFrame:
    """word and its number of tokens: counted in each task first, then summed by word."""

    def one(batches):
        held: list[pa.Table] = []
        for batch in batches:
            for _, text in slices(batch, batch.column(0), BYTES):
                word, c = split(text)[0].value_counts().flatten()
                held.append(pa.table({"word": word, "c": c}))
                if sum(map(len, held)) > 2 * COUNTED:
                    held = [summed(held)]
                    if len(held[0]) > COUNTED:
                        yield from held.pop().to_batches()
        if held:
            yield from summed(held).to_batches()

    def summed(held: list[pa.Table]) -> pa.Table:
        t = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")])
        return pa.table({"word": t["word"], "c": t["c_sum"]})

    return train.select("text").mapInArrow(one, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def scatter(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` by their row numbers."""
    k = values.shape[1]
    return np.bincount((rows[:, None] * k + np.arange(k)).ravel(), values.ravel(), n * k).reshape(n, k)


class Codes:
    """A word's code: its class, or for a rare word the class "rare" plus its leaf. Words are bytes."""

    def __init__(self, ids: dict[str, int], rare: int, leaves: int):
        self.ids, self.rare, self.leaves = {w.encode(): i for w, i in ids.items()}, rare, leaves

    def each(self, words: list[bytes]) -> np.ndarray:
        known = np.fromiter(map(self.ids.get, words, repeat(END)), np.int64, len(words))
        leaf = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % self.leaves
        return np.where(known == END, self.rare + leaf, known)

    def of(self, words: list[bytes]) -> np.ndarray:
        """The codes of one text's words and END."""
        return np.append(self.each(words), END)

    def flat(self, distinct: list[bytes], place: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
        """The codes of ``texts`` texts one after the other, each ending in END; words as split and indexed."""
        out = np.full(len(place) + texts, END)
        out[np.arange(len(place)) + owner] = self.each(distinct)[place]
        return out


def contexts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes two before and one before each, END before and after the end of a text."""
    one, two = np.concatenate([[END], codes[:-1]]), np.concatenate([[END, END], codes[:-2]])[: len(codes)]
    return np.where(one == END, END, two), one


class Shape:
    """Classes with their counts, and the leaves of rare words with their smoothed mass."""

    def __init__(self, freq: np.ndarray, mass: np.ndarray):
        self.k, self.q = len(freq), (freq + 1.0) / (freq + 1.0).sum()
        self.cdf, self.lq = np.cumsum(self.q)[:-1], np.log(self.q).astype(np.float32)
        self.base = b = round(len(mass) ** (1 / 3))
        m = mass.reshape(b, b, b).astype(np.float64)
        # Biases of a digit by the digits before: at the start, leaves have their corpus shares.
        self.bias = [np.log(x / x.sum(-1, keepdims=True)).reshape(-1, b).astype(np.float32) for x in (m.sum((1, 2)), m.sum(2), m)]
        self.against = [np.exp(-x).ravel() for x in self.bias]
        self.rows = self.k + 3 * b
        self.mass_log = np.log10(mass)

    def digits(self, codes: np.ndarray) -> list[np.ndarray]:
        leaf, b = codes - (self.k - 1), self.base
        return [leaf // (b * b), leaf // b % b, leaf % b]

    def embed(self, table: np.ndarray, codes: np.ndarray) -> np.ndarray:
        far = np.flatnonzero(codes >= self.k - 1)
        return self.looked_up(table, np.minimum(codes, self.k - 1), far, self.digits(codes[far]))

    def looked_up(self, table: np.ndarray, near: np.ndarray, far: np.ndarray, digits: list[np.ndarray]) -> np.ndarray:
        """The rows ``near``, with those of their digits added at ``far``."""
        out = table.take(near, 0)
        add = out.take(far, 0)
        for j, x in enumerate(digits):
            add += table.take(x + (self.k + j * self.base), 0)
        out[far] = add
        return out


def start(shape: Shape, dim: int = 16) -> dict[str, np.ndarray]:
    """The parameters that every trainer starts from: embeddings, context matrices and biases."""
    r = np.random.default_rng(5)
    p = {"R": r.normal(0, 0.1, (shape.rows, dim)), "E": r.normal(0, 0.1, (shape.rows, dim)), "C": r.normal(0, 0.1, (2, dim, dim)) + np.eye(dim), "b": np.log(shape.q)}
    return {k: a.astype(np.float32) for k, a in p.items()}


def contrast(h, e, own_logit, against, t, w, share: float):
    """Derivatives of the contrastive loss for the targets' and the shared noise rows' logits.

    ``against`` is the exponential of the noise rows' negated biases plus their log shares; a block
    shares its noise rows ``w``, which stand for ``share`` of a row of each token.
    """
    et, ew = e.take(t, 0), e.take(w, 0)
    own = -1 / (1 + np.exp(np.einsum("nd,nd->n", h, et) + own_logit))
    z = h @ -ew.T
    np.exp(z, out=z)
    z *= against
    z += 1
    other = np.divide(np.float32(share), z, out=z)  # where the exponential overflows, 0
    dh = other @ ew
    et *= own[:, None]
    dh += et
    return own, other, dh


def step(p, s, r, shape: Shape, two: int, one: int, codes: np.ndarray, noise: int = 10, shared: int = 64, rate: float = 0.1) -> None:
    """One step of noise-contrastive estimation with Adagrad, in place, over consecutive codes, of which
    the first follows ``two`` and ``one``."""
    n, k, base = len(codes), shape.k, shape.base
    seq = np.concatenate([[two, one], codes])
    near, far = np.minimum(seq, k - 1), np.flatnonzero(seq >= k - 1)
    digits = shape.digits(seq[far])
    # Each code's embedding is looked up once; it stands one before its follower and two before the next.
    at = far[: np.searchsorted(far, n + 1)]
    x = shape.looked_up(p["R"], near[:-1], at, [d[: len(at)] for d in digits])
    first = np.flatnonzero(seq[1:-1] == END)  # texts begin here: END stands two before as well
    x0, x1 = x[:-1].copy(), x[1:]
    x0[first] = p["R"][END]
    h = x0 @ p["C"][0] + x1 @ p["C"][1]
    t, w, lq = near[2:], np.searchsorted(shape.cdf, r.random(shared)), shape.lq + np.float32(np.log(noise))
    own, other, dh = contrast(h, p["E"], p["b"][t] - lq[t], np.exp(lq[w] - p["b"][w]), t, w, noise / shared)
    rows, values = [t, w], [own[:, None] * h, other.T @ h]
    gb = np.bincount(t, own, k) + np.bincount(w, np.ones(n, np.float32) @ other, k)
    skip = np.searchsorted(far, 2)
    if len(to := far[skip:] - 2):
        prefix, hf, ratio = np.zeros(len(to), int), h.take(to, 0), np.float32(noise / base)
        for j, d in enumerate(x[skip:] for x in digits):
            u, low = r.integers(0, base, shared // 2), k + j * base
            against = np.take(shape.against[j], prefix[:, None] * base + u if j else u) * ratio
            a, o, dhf = contrast(hf, p["E"], shape.bias[j][prefix, d] - np.log(ratio), against, low + d, low + u, noise / len(u))
            dh[to] += dhf
            rows += [low + d, low + u]
            values += [a[:, None] * hf, o.T @ hf]
            prefix = prefix * base + d
    scale = np.float32(n**0.5)
    dh /= scale
    g = {"E": scatter(np.concatenate(rows), np.concatenate(values), shape.rows) / scale, "b": gb / scale, "C": np.stack([x0.T @ dh, x1.T @ dh])}
    dx, d0 = np.zeros_like(x), dh @ p["C"][0].T
    ends = d0[first].sum(0)
    d0[first] = 0
    dx[:-1] = d0
    dx[1:] += dh @ p["C"][1].T
    below = dx.take(at, 0)
    g["R"] = scatter(np.concatenate([near[:-1], *[k + j * base + d[: len(at)] for j, d in enumerate(digits)]]), np.concatenate([dx, below, below, below]), shape.rows)
    g["R"][END] += ends
    for name in p:
        now = g[name].astype(np.float32)
        s[name] += now * now
        now *= np.float32(rate)
        now /= np.sqrt(s[name])
        p[name] -= now


def train_on(texts: Iterator[np.ndarray], shape: Shape, block: int = 1024) -> tuple[dict[str, np.ndarray], int]:
    """The parameters after one pass over the codes of whole texts (ends included), and their tokens."""
    p, r = start(shape), np.random.default_rng(6)
    s = {n: np.full_like(a, 1e-2) for n, a in p.items()}
    held, size, total, before = [], 0, 0, (END, END)

    def flush(last: bool) -> list:
        nonlocal before
        t = np.concatenate(held)
        full = len(t) if last else len(t) // block * block
        for i in range(0, full, block):
            part = t[i : min(i + block, full)]
            step(p, s, r, shape, *before, part)
            one = int(part[-1])
            before = END if one == END else int(part[-2]) if len(part) > 1 else before[1], one
        return [t[full:]]

    np.seterr(over="ignore")  # see contrast()
    for x in texts:
        held.append(x)
        size, total = size + len(x), total + len(x)
        if size >= 64 * block:
            held = flush(False)
            size = len(held[0])
    if size:
        flush(True)
    return p, total


def fit(texts: DataFrame, ids: dict[str, int], shape: Shape) -> dict[str, np.ndarray]:
    """Parameters from one pass over all ``texts``: every core trains on its share of them from the
    same start, and the results are averaged by their numbers of tokens."""
    sc = texts.sparkSession.sparkContext
    share = sc.broadcast((ids, shape))

    def one(batches):
        ids, shape = share.value
        codes = Codes(ids, shape.k - 1, shape.base**3)

        def every():
            for batch in batches:
                for _, text in slices(batch, batch.column(0), BYTES):
                    words, owner = split(text)
                    _, place, distinct = indexed(words)
                    yield codes.flat(distinct, place, owner, len(text))

        p, total = train_on(every(), shape)
        yield pa.RecordBatch.from_pydict({"total": [total], "p": [pickle.dumps(p)]})

    out, n = {k: np.zeros(a.shape) for k, a in start(shape).items()}, 0
    for r in texts.coalesce(max(1, sc.defaultParallelism)).mapInArrow(one, "total long, p binary").where("total > 0").collect():
        n += r["total"]
        for k, a in pickle.loads(r["p"]).items():
            out[k] += r["total"] * a
    return {k: a / n for k, a in out.items()} if n else start(shape)


class Model:
    def __init__(self, p: dict[str, np.ndarray], shape: Shape):
        self.shape, k, b = shape, shape.k, p["b"].astype(np.float32)
        self.e, self.b = p["E"].astype(np.float32), b - b.max()
        self.top, self.mass = np.ascontiguousarray(self.e[:k].T), np.exp(self.b)
        self.low = [np.ascontiguousarray(self.e[i : i + shape.base].T) for i in range(k, shape.rows, shape.base)]
        self.low_mass = [np.exp(x) for x in shape.bias]
        self.ctx = [(p["R"] @ p["C"][c]).astype(np.float32) for c in (0, 1)]
        # Normalisers of the classes after every two classes; other contexts are settled as they come.
        self.known = np.stack([self.normaliser(x + self.ctx[1][: k - 1], self.top, self.mass) for x in self.ctx[0][: k - 1]])

    @staticmethod
    def normaliser(h: np.ndarray, e: np.ndarray, mass: np.ndarray, room: np.ndarray | None = None) -> np.ndarray:
        """Logarithms of the sums of the logits' exponentials, weighted by ``mass`` (one row for all, or one each).
        The logits may take ``room``, which is overwritten."""
        z, top = np.matmul(h, e, out=None if room is None else room[: len(h) * e.shape[1]].reshape(len(h), -1)), np.float32(0)
        # Lengths bound most logits; only then are the logits themselves looked at.
        if z.size and np.einsum("nd,nd->n", h, h).max() * np.einsum("dk,dk->k", e, e).max() > 3600 and max(z.max(), -z.min()) > 60:
            top = z.max(1)
            z -= top[:, None]
        np.exp(z, out=z)
        return np.log(z @ mass if mass.ndim == 1 else np.einsum("nk,nk->n", z, mass)) + top

    def log_probabilities(self, codes: np.ndarray, block: int = 512, most: int = 16_384) -> np.ndarray:
        """Normalised log10 probabilities of the classes and leaves of texts, each ending in END."""
        k, base = self.shape.k, self.shape.base
        twos, ones = contexts(codes)
        out, room = np.empty(len(codes)), np.empty(block * max(k, 2 * base), np.float32)
        for i in range(0, len(codes), most):
            c, two, one = (x[i : i + most] for x in (codes, twos, ones))
            h = self.shape.embed(self.ctx[0], two) + self.shape.embed(self.ctx[1], one)
            t = np.minimum(c, k - 1)
            z = self.known[np.minimum(two, k - 2), np.minimum(one, k - 2)]
            rest = np.flatnonzero((two >= k - 1) | (one >= k - 1))
            for j in range(0, len(rest), block):
                at = rest[j : j + block]
                z[at] = self.normaliser(h.take(at, 0), self.top, self.mass, room)
            out[i : i + most] = np.einsum("nd,nd->n", h, self.e.take(t, 0)) + self.b[t] - z
            far = np.flatnonzero(c >= k - 1)
            for low in range(0, len(far), 2 * block):
                at = far[low : low + 2 * block]
                prefix, hf = np.zeros(len(at), int), h.take(at, 0)
                for j, d in enumerate(self.shape.digits(c[at])):
                    own = np.einsum("nd,nd->n", hf, self.e.take(k + j * base + d, 0)) + self.shape.bias[j][prefix, d]
                    out[i + at] += own - self.normaliser(hf, self.low[j], self.low_mass[j].take(prefix, 0) if j else self.low_mass[j][0], room)
                    prefix = prefix * base + d
        return out / np.log(10)


def leaf_mass(counts: DataFrame, top: list[str], rare_words: int) -> np.ndarray:
    """Each leaf's tokens, plus one for each of its words and one for unknown words."""
    base = 4
    while base**3 * LEAF < rare_words:
        base += 1
    mass = np.ones(base**3)
    leaf = F.crc32(F.col("word").cast("binary")) % base**3
    held = counts.where(~F.col("word").isin(top)).groupBy(leaf.alias("leaf")).agg(F.sum(F.col("c") + 1).alias("m")).toPandas()
    mass[held["leaf"].to_numpy(int)] += held["m"].to_numpy(float)
    return mass


def score(docs: DataFrame, classes: int = 400) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    short_batches(docs.sparkSession)
    train = docs.where((fold(F.col("doc_id"), 7) != 2) | F.col("doc_id").isNull())
    counts = cut(corpus_counts(train))
    ends = train.count()
    # Words by count; there are at most the root of twice the tokens of these.
    words_of = {c: m for c, m in zip(*counts.groupBy("c").count().toArrow().to_pydict().values())}
    total, distinct = sum(c * m for c, m in words_of.items()), sum(words_of.values())
    n, v = total + ends, distinct + (1 if ends else 0)
    floor, held = max(words_of, default=0) + 1, 0
    for c in sorted(words_of, reverse=True):
        if (held := held + words_of[c]) > HOT:
            break
        floor = c
    hot = dict(zip(*counts.where(F.col("c") >= floor).select("word", "c").toArrow().to_pydict().values()))  # at most HOT rows
    top = [r["word"] for r in counts.orderBy(F.desc("c"), "word").limit(classes).collect()]
    ids = {w: i + 1 for i, w in enumerate(top)}
    rare = len(top) + 1
    freq = np.array([ends, *[r["c"] for r in counts.where(F.col("word").isin(top)).orderBy(F.desc("c"), "word").collect()], 0.0])
    freq[rare] = max(0, n - freq.sum())
    shape = Shape(freq, leaf_mass(counts, top, distinct - len(top)))
    model = fit(train.select("text"), ids, shape)
    share = docs.sparkSession.sparkContext.broadcast((Model(model, shape), hot, ids, shape.mass_log))
    base_of, end_base = np.log10(float(n + v + 1)), np.log10(ends + 1.0) - np.log10(float(n + v + 1))

    def local(batches):
        model, hot, ids, leaf_log = share.value
        codes = Codes(ids, rare, len(leaf_log))
        # Of hot words: the smoothed count's logarithm, and whether they have a class.
        place = {w.encode(): i for i, w in enumerate(hot)}
        log_c, classed = np.log10(np.array([*hot.values(), 0.0]) + 1), np.array([*(w in ids for w in hot), False])
        for batch, text in (x for b in batches for x in slices(b, b.column("text"), BYTES)):
            docs = batch.num_rows
            words, owner = split(text)
            distinct, at, plain = indexed(words)
            flat = codes.flat(plain, at, owner, docs)
            sizes = np.bincount(owner, minlength=docs) + 1
            logs, far = model.log_probabilities(flat), flat >= rare
            logs[far] -= leaf_log[flat[far] - rare]
            hot_at = np.fromiter(map(place.get, plain, repeat(-1)), np.int64, len(plain))[at]
            cold = hot_at < 0
            known = np.bincount(owner, ~cold, docs).astype(np.int64) + int(ends > 0)
            base = np.bincount(owner, np.where(cold, 0.0, log_c[hot_at] - base_of), docs) + end_base
            score = np.add.reduceat(logs, np.cumsum([0, *sizes[:-1]])) + np.bincount(owner, np.where(cold | classed[hot_at], 0.0, log_c[hot_at]), docs)
            pairs, times = np.unique(owner[cold] * max(1, len(distinct)) + at[cold], return_counts=True)
            who, which = np.divmod(pairs, max(1, len(distinct)))
            ends_at = pa.array(np.searchsorted(who, np.arange(docs + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends_at, x) for x in (distinct.take(pa.array(which)), pa.array(times, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), *map(pa.array, (sizes, known, base, score)), *lists], names=["doc_id", "h", *LOCAL.names])

    kind = StructType([docs.schema["doc_id"], StructField("h", LongType()), *from_arrow_schema(LOCAL).fields])
    part = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(local, kind)
    part = cut(part.withColumn("m", F.aggregate("times", F.lit(0).cast("bigint"), lambda a, b: a + b)))
    rest = part.select("doc_id", "h", F.explode(F.arrays_zip("words", "times")).alias("z")).select("doc_id", "h", F.col("z.words").alias("word"), F.col("z.times").alias("k"))
    # Top words below the hot bound are few and have a class; they take no rare share.
    classed = F.col("word").isin([w for w in top if w not in hot]) if any(w not in hot for w in top) else F.lit(False)
    met = rest.join(counts.where(F.col("c") < floor), "word", "left").withColumn("l", F.log10(F.coalesce("c", F.lit(0)) + F.lit(1.0)))
    per = met.groupBy("doc_id", "h").agg(
        F.sum("k").alias("all"), F.sum(F.when(F.col("c").isNotNull(), F.col("k")).otherwise(0)).alias("k1"),
        F.sum(F.col("k") * (F.col("l") - base_of)).alias("b1"), F.sum(F.when(classed, 0.0).otherwise(F.col("k") * F.col("l"))).alias("s1"),
    ).withColumnsRenamed({"doc_id": "_d", "h": "_h"})
    out = part.drop("words", "times").join(per, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h")), "left")

    def plus(a, b):
        # Repeated rows were summed together; "all" over one row's own number of words undoes it.
        return F.col(a) + F.when(F.col("all") > 0, F.col(b) * F.col("m") / F.col("all")).otherwise(0.0)

    held = F.coalesce(fold(F.col("doc_id"), 7) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), F.col("n").alias("n_tokens"), F.round(plus("known", "k1")).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), plus("base", "b1").alias("base_score"), plus("score", "s1").alias("score"))
