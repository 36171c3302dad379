"""Token counts by a linear longest-match automaton.

A trie of the vocabulary with failure links; popped[v] is the number of tokens given up when
following the link of v. Each word, with a leading space, is walked once, byte by byte, and only
counts are kept. A word that no sequence of pieces covers counts as one unknown token. Null and
empty texts have no words. Repeated rows and doc_ids, null ones too, are counted one by one; texts of
any length are read whole; extra columns, whatever their names, don't matter; an empty table gives an
empty result.
"""

import base64
import hashlib
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_built: dict = {}


def load(path: str) -> list[bytes]:
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Automaton:
    def __init__(self, pieces: list[bytes]):
        self.child: list[dict[int, int]] = [{}]
        ends = [False]
        for piece in pieces:
            v = 0
            for c in piece:
                if c not in self.child[v]:
                    self.child[v][c] = len(ends)
                    self.child.append({})
                    ends.append(False)
                v = self.child[v][c]
            ends[v] = v != 0
        self.link, self.popped = [-1] * len(ends), [0] * len(ends)
        queue = [0]
        for u in queue:
            for c, v in self.child[u].items():
                queue.append(v)
                if ends[v]:
                    self.link[v], self.popped[v] = 0, 1
                    continue
                z, n = self.link[u], self.popped[u]
                while z >= 0 and c not in self.child[z]:
                    n += self.popped[z]
                    z = self.link[z]
                if z >= 0:
                    self.link[v], self.popped[v] = self.child[z][c], n

    def count(self, data: bytes) -> int:
        child, link, popped, u, n = self.child, self.link, self.popped, 0, 0
        for c in data:
            while c not in child[u]:
                n += popped[u]
                u = link[u]
                if u < 0:
                    return 1
            u = child[u][c]
        while u > 0:
            n += popped[u]
            u = link[u]
        return n if u == 0 else 1


def count(docs: DataFrame, path: str = VOCABULARY, cache: int = 200_000) -> DataFrame:
    """doc_id, n_words, n_tokens; ``path`` is read on the driver and its pieces broadcast (one vocabulary)."""
    read = load(path)
    # The content, not the path, names what a worker keeps between batches.
    mark = hashlib.sha256(b"".join(len(x).to_bytes(4, "big") + x for x in read)).hexdigest()
    pieces = docs.sparkSession.sparkContext.broadcast(read)

    @F.pandas_udf("struct<n_words:bigint,n_tokens:bigint>")
    def counts(text: pd.Series) -> pd.DataFrame:
        if mark not in _built:
            _built.clear()
            _built[mark] = (Automaton(pieces.value), {})
        auto, known = _built[mark]
        rows = []
        for t in text:
            words = Counter(WORD.findall(t or ""))
            total = 0
            for w, k in words.items():
                n = known.get(w)
                if n is None:
                    n = auto.count(b" " + w.encode("utf-8", "replace"))
                    if len(known) < cache and len(w) < 64:
                        known[w] = n
                total += n * k
            rows.append((words.total(), total))
        return pd.DataFrame(rows, columns=["n_words", "n_tokens"])

    return docs.select("doc_id", counts("text").alias("c")).select("doc_id", "c.*")
