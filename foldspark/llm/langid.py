"""Language ID: a bidirectional gated recurrent network over bytes, in numpy.

Trained by backpropagation through time on at most ``sample`` labelled windows (a documented
bound); every byte of every whole text is labelled and the position probabilities are averaged. A
text is labelled in segments of ``SEGMENT`` bytes; before each, both directions read ``LEAD`` bytes of
the neighbouring segment, so that they know what stands around it. Null texts and texts without a
letter are ``und``, score 0; without labelled rows every text is ``und``. Ties go to the first language
by code point. Null and repeated doc_ids are rows like others; extra columns, whatever their names,
don't matter; an empty table gives an empty result.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm.common import fold

SEGMENT = 64
#: Bytes of the neighbouring segments that lead into a segment from either side.
LEAD = 12


def sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def start(k: int, hidden: int, seed: int = 7) -> dict:
    r = np.random.default_rng(seed)
    p = {"c": np.zeros(k)}
    for d in "fb":
        p["T" + d] = r.normal(0, 0.3, (256, 3 * hidden))
        p["U" + d] = r.normal(0, 0.3, (hidden, 3 * hidden))
        p["V" + d] = r.normal(0, 0.3, (hidden, k))
    return {n: v.astype(np.float32) for n, v in p.items()}


def run(table, u, x, keep: bool):
    """Hidden states [T, B, H] over byte columns x [T, B]; with ``keep`` also the gates."""
    hidden = u.shape[0]
    h = np.zeros((x.shape[1], hidden), np.float32)
    hs, gates = np.empty((*x.shape, hidden), np.float32), []
    for t in range(len(x)):
        g, a = table[x[t]], h @ u
        zr = sigmoid(g[:, : 2 * hidden] + a[:, : 2 * hidden])
        z, r = zr[:, :hidden], zr[:, hidden:]
        n = np.tanh(g[:, 2 * hidden :] + r * a[:, 2 * hidden :])
        if keep:
            gates.append((h, z, r, n, a[:, 2 * hidden :]))
        h = n + z * (h - n)
        hs[t] = h
    return hs, gates


def back(u, x, gates, dhs, dtable, du):
    """Backpropagation through time; adds to the gradients in place."""
    dh = np.zeros_like(dhs[0])
    for t in range(len(x) - 1, -1, -1):
        h, z, r, n, an = gates[t]
        dh = dh + dhs[t]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * an * r * (1 - r)
        dg = np.concatenate([dz, dr, dn], 1)
        da = np.concatenate([dz, dr, dn * r], 1)
        np.add.at(dtable, x[t], dg)
        du += h.T @ da
        dh = dh * z + da @ u.T


def probabilities(p, x, lead: int = 0):
    """Class probabilities of each position of the byte columns x [T, B], but for ``lead`` rows at either end."""
    n = len(x) - 2 * lead
    f, _ = run(p["Tf"], p["Uf"], x[: lead + n], False)
    b, _ = run(p["Tb"], p["Ub"], x[lead:][::-1], False)
    o = f[lead:] @ p["Vf"] + b[lead:][::-1] @ p["Vb"] + p["c"]
    o = np.exp(o - o.max(-1, keepdims=True))
    return o / o.sum(-1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, k: int, hidden: int = 8, steps: int = 400, batch: int = 96, rate: float = 0.02) -> dict:
    """x [N, SEGMENT] bytes, y [N] classes; Adam over random batches with a fixed seed."""
    p = start(k, hidden)
    m, v = ({n: np.zeros_like(a) for n, a in p.items()} for _ in range(2))
    r = np.random.default_rng(11)
    for step in range(1, steps + 1):
        i = r.integers(0, len(x), batch)
        xb = x[i].T
        f, gf = run(p["Tf"], p["Uf"], xb, True)
        b, gb = run(p["Tb"], p["Ub"], xb[::-1], True)
        b = b[::-1]
        o = f @ p["Vf"] + b @ p["Vb"] + p["c"]
        o = np.exp(o - o.max(-1, keepdims=True))
        d = o / o.sum(-1, keepdims=True)
        d[:, np.arange(batch), y[i]] -= 1
        d /= d.shape[0] * batch
        g = {n: np.zeros_like(a) for n, a in p.items()}
        g["c"] = d.sum((0, 1))
        g["Vf"], g["Vb"] = np.einsum("tbh,tbk->hk", f, d), np.einsum("tbh,tbk->hk", b, d)
        back(p["Uf"], xb, gf, d @ p["Vf"].T, g["Tf"], g["Uf"])
        back(p["Ub"], xb[::-1], gb, (d @ p["Vb"].T)[::-1], g["Tb"], g["Ub"])
        for n in p:
            m[n] = 0.9 * m[n] + 0.1 * g[n]
            v[n] = 0.99 * v[n] + 0.01 * g[n] ** 2
            p[n] = (p[n] - rate * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


def segments(data: bytes) -> np.ndarray:
    """Whole text in rows of SEGMENT bytes, the last padded with spaces."""
    a = np.frombuffer(data + b" " * (-len(data) % SEGMENT), np.uint8)
    return a.reshape(-1, SEGMENT)


def with_lead(rows: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Segments with the LEAD bytes that stand before and after each, columns as ``probabilities`` takes them."""
    x = np.concatenate([before, rows.ravel(), after])
    return np.lib.stride_tricks.as_strided(x, (len(rows), SEGMENT + 2 * LEAD), (SEGMENT, 1))


def pooled(p: dict, texts: list[str], block: int = 2048) -> np.ndarray:
    """Mean position probabilities of each text; memory is bounded by ``block`` segments."""
    k = len(p["c"])
    out, sizes = np.zeros((len(texts), k)), np.zeros(len(texts))
    held, owner, have = [], [], 0

    def flush():
        if held:
            x, o = np.concatenate(held), np.concatenate(owner)
            np.add.at(out, o, probabilities(p, x.T, LEAD).sum(0))

    for i, t in enumerate(texts):
        s = segments(t.encode("utf-8", "replace"))
        sizes[i] = s.size
        edge = np.full(LEAD, 32, np.uint8)
        for j in range(0, len(s), block):
            part = s[j : j + block]
            held.append(with_lead(part, s[j - 1][-LEAD:] if j else edge, s[j + block][:LEAD] if j + block < len(s) else edge))
            owner.append(np.full(len(part), i))
            have += len(part)
            if have >= block:
                flush()
                held, owner, have = [], [], 0
    flush()
    return out / np.maximum(sizes, 1)[:, None]


def fit(docs: DataFrame, sample: int = 2000, width: int = 512):
    """Languages and network from at most ``sample`` rows with a lang outside fold 0 of 5, of each a window
    of ``width`` characters that begins at a place drawn evenly by hash."""
    rows = docs.where((fold(F.col("doc_id"), 5) != 0) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    mark = F.col("doc_id").cast("string")
    # A share of the rows by hash, half as many again as are taken, so that no task sends more than its part.
    drawn = F.pmod(F.xxhash64(mark, F.lit("drawn")), F.lit(1_000_003))
    rows = rows.where(drawn < 1_000_003 * min(1.0, 1.5 * sample / max(1, rows.count())))
    room = F.greatest(F.length("text") - width + 1, F.lit(1))
    at = 1 + F.crc32(F.concat(F.lit("w"), mark).cast("binary")) % room
    got = rows.select("lang", F.substring(F.col("text"), at.cast("int"), F.lit(width)).alias("t"), F.md5(mark.cast("binary")).alias("o")).orderBy("o", "lang", "t").limit(sample).collect()
    langs = sorted({r["lang"] for r in got})
    x = [segments(r["t"].encode("utf-8", "replace")) for r in got]
    y = [np.full(len(s), langs.index(r["lang"])) for s, r in zip(x, got)]
    return langs, train(np.concatenate(x), np.concatenate(y), len(langs)) if langs else None


def predict(docs: DataFrame, model=None) -> DataFrame:
    """The documents with lang_pred and score, which take the place of columns of these names."""
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return labelled(docs, model).select(*[F.col("doc").getField(c).alias(c) for c in names], F.col("found.lang_pred").alias("lang_pred"), F.col("found.score").alias("score"))


def kept(docs: DataFrame, model=None) -> DataFrame:
    """The documents with a predicted language, with all columns as they are; ``und`` is rejected."""
    return labelled(docs, model).where("found.lang_pred <> 'und'").select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def labelled(docs: DataFrame, model=None) -> DataFrame:
    """``doc``, a struct of all columns, and ``found``, a struct of lang_pred and score."""
    langs, p = model or fit(docs)

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def label(text: pd.Series) -> pd.DataFrame:
        use = [i for i, t in enumerate(text) if t is not None and p is not None and any(c.isalpha() for c in t)]
        lang, score = ["und"] * len(text), np.zeros(len(text))
        probs = pooled(p, [text.iloc[i] for i in use]) if use else []
        for i, q in zip(use, probs):
            lang[i], score[i] = langs[int(np.argmax(q))], min(1.0, round(float(q.max()), 6))
        return pd.DataFrame({"lang_pred": lang, "score": score})

    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), label(docs["text"]).alias("found"))
