"""Personal data: expressions propose spans, checksums confirm, nearby words adjust the score.

Null texts count as empty. Every text is read whole; each search takes time linear in the text,
also on long runs of word characters or digits. Offsets are code points, ends exclusive. Repeated rows
and doc_ids, null ones too, are read one by one and get equal results; a kind's spans don't overlap,
spans of different kinds may. Extra columns, whatever their names, don't matter; an empty table gives
an empty result.
"""

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The kinds in their order; those after phone are added by the method.
KINDS = ["email", "ip", "card", "phone", "iban", "ssn", "secret"]
#: Words that raise a candidate's score within CONTEXT characters before it.
NEAR = {
    "email": ["mail", "contact", "write"],
    "ip": ["ip", "address", "host", "server"],
    "card": ["card", "visa", "mastercard", "credit", "payment"],
    "phone": ["phone", "call", "tel", "mobile", "fax"],
    "iban": ["iban", "account", "bank", "konto", "compte", "cuenta"],
    "ssn": ["ssn", "social", "security", "taxpayer"],
    "secret": ["key", "secret", "token", "password", "credential"],
}
#: Start score of each kind's valid candidates; a context word adds NEARBY.
START = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.6, "iban": 0.6, "ssn": 0.3, "secret": 0.6}
#: Added kinds are confirmed from this score on; valid base candidates always stay, with their score.
CONFIRM = 0.6
NEARBY = 0.4
CONTEXT = 40

LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
#: Keys of known forms, private key headers, and values that are assigned to a name like password.
SECRET = re.compile(
    r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36}\b|\bxox[abprs]-[A-Za-z0-9-]{10,}|\bAIza[0-9A-Za-z_-]{35}|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
    r"|(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?[ ]{0,3}[:=][ ]{0,3}[\"']?)(?P<value>[A-Za-z0-9+/_=-]{8,})"
)


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Searched from each @ to the left, so that long runs without one cost nothing."""
    free = 0
    for m in AT.finditer(text):
        left = local_start(text, m.start(), free)
        if left < m.start():
            yield left, m.end()
            free = m.end()


def local_start(text: str, at: int, low: int) -> int:
    while at > low and text[at - 1] in LOCAL_CHARS:
        at -= 1
    return at


def secret(m: re.Match) -> bool:
    """An assigned value must mix letters and digits and not be repetitive, as passwords and keys do."""
    v = m["value"]
    if v is None:
        return True
    share = [n / len(v) for n in Counter(v).values()]
    return any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and -sum(p * math.log2(p) for p in share) >= 2.5


def valid_ssn(s: str) -> bool:
    return s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000"


def valid_ip(s: str) -> bool:
    parts = [p.lstrip("0") or "0" for p in s.split(".")]
    return all(len(p) <= 3 and int(p) <= 255 for p in parts)


def score(text: str, kind: str, start: int) -> float:
    before = text[max(0, start - CONTEXT) : start].lower()
    return round(min(1.0, START[kind] + NEARBY * any(w in before for w in NEAR[kind])), 2)


def spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """All spans as (kind, start, end, score), by kind and start."""
    text = text or ""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    out += [("ip", *m.span()) for m in IP.finditer(text) if valid_ip(m[0])]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(d := digits(m[0])) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]
    out += [("iban", *m.span()) for m in IBAN.finditer(text) if mod97(m[0])]
    out += [("ssn", *m.span()) for m in SSN.finditer(text) if valid_ssn(m[0])]
    out += [("secret", *m.span("value" if m["value"] else 0)) for m in SECRET.finditer(text) if secret(m)]
    scored = [(kind, a, b, score(text, kind, a)) for kind, a, b in out]
    return [s for s in scored if s[0] in KINDS[:4] or s[3] >= CONFIRM]


def find(docs: DataFrame) -> DataFrame:
    """doc_id and its spans, an array of (kind, start, end, score)."""
    kind = "array<struct<kind:string,start:int,end:int,score:double>>"

    @F.pandas_udf(kind)
    def every(text: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("kind", "start", "end", "score"), s)) for s in spans(t)] for t in text], dtype="object")

    return docs.select("doc_id", every("text").alias("found"))


def is_kind(kind: str):
    return lambda s: s["kind"] == kind


def digest(found: DataFrame, base=KINDS[:4]) -> DataFrame:
    """Counts of the base kinds, their sha256, all spans as one string, the number of all spans and the best score."""

    def joined(a):
        return F.concat_ws(",", F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    only = F.filter("found", lambda s: s["kind"].isin(base))
    counts = [F.size(F.filter("found", is_kind(k))).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(joined(only), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), F.size("found").cast("long").alias("n_total"), F.array_max(F.col("found.score")).alias("top_score"))


def mask(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind in angle brackets; other columns stay, and
    n_chars, where there is one, follows the text (but for null texts)."""

    @F.pandas_udf("string")
    def masked(text: pd.Series) -> pd.Series:
        return pd.Series([mask_text(t) for t in text], dtype="object")

    out = docs.withColumn("text", masked("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)


def mask_text(text: str | None) -> str | None:
    if text is None:
        return None
    out, at = [], 0
    for kind, a, b, _ in sorted(spans(text), key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])
