"""URL filter: host and path rules, then logistic regression on hashed character n-grams.

Null urls, and urls without ``://``, have an empty host and path, fit no rule and are judged by
the model, which has learnt to allow them. Repeated urls get equal verdicts, repeated and null page_ids
are rows like others; urls of any length are read whole; extra columns, whatever their names, don't
matter; an empty table gives an empty result.
"""

import csv
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm.common import ascii_lower

#: The rules as (verdict, host and path).
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
#: The small labelled table: (url, 1 to block). Rows without a url teach the model to allow what has no host.
with (Path(__file__).parent / "labelled_urls.csv").open(newline="") as _f:
    LABELLED = [(r["url"], int(r["blocked"])) for r in csv.DictReader(_f)]


def host_path(url):
    """Host (A-Z lower-cased) and path of ``url`` as columns."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return ascii_lower(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host, path, rules):
    """The longest fitting rule as struct(verdict, rule), or null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        at, tail = rule.split("/", 1)
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + tail)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def features(host: str, path: str, bits: int) -> np.ndarray:
    """Hashed positions of the character 3- to 5-grams of host and path, each once."""
    found = set()
    for part, s in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in (3, 4, 5):
            found.update(part + s[i : i + n] for i in range(len(s) - n + 1))
    return np.unique([zlib.crc32(g.encode("utf-8", "replace")) & ((1 << bits) - 1) for g in found] or [0])


def train(labelled, bits: int = 14, epochs: int = 60, rate: float = 0.5, l2: float = 1e-3):
    """Weights and bias by plain gradient steps over the labelled table, in its order."""
    w, b = np.zeros(1 << bits), 0.0
    rows = []
    for url, y in labelled:
        rest = url.partition("://")[2]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        path = rest[cut:].partition("?")[0].partition("#")[0]
        rows.append((features(rest[:cut].lower(), path, bits), y))
    for _ in range(epochs):
        for f, y in rows:
            g = 1 / (1 + np.exp(-(w[f].sum() / np.sqrt(len(f)) + b))) - y
            w[f] -= rate * (g / np.sqrt(len(f)) + l2 * w[f])
            b -= rate * g
    return w, b


def judge(pages: DataFrame, rules=RULES, labelled=LABELLED, bits: int = 14, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's probability that the url is unwanted."""
    w, b = train(labelled, bits)

    @F.pandas_udf("double")
    def unwanted(host: pd.Series, path: pd.Series) -> pd.Series:
        def one(h, p):
            f = features(h, p, bits)
            return float(1 / (1 + np.exp(-(w[f].sum() / np.sqrt(len(f)) + b))))

        return pd.Series([one(h, p) for h, p in zip(host, path)], dtype="float64")

    host, path = host_path(F.col("url"))
    parts = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    parts = parts.withColumn("r", fitting_rule(F.col("host"), F.col("path"), rules)).withColumn("p", unwanted("host", "path"))
    model = F.when(F.col("p") >= threshold, "block").otherwise("allow")
    return parts.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", model).alias("verdict"), F.col("p").alias("block_score"))
