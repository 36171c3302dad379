"""Full-text and n-gram search over plain string columns."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def terms(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


WORDS = r"[^\W_]+"


def wanted(query: str) -> list[str]:
    """The query's words, split as ``terms`` splits texts."""
    return re.findall(WORDS, query.lower())


def all_terms(c: Column, query: str) -> Column:
    """Every word of the query occurs."""
    return F.size(F.array_except(F.array(*map(F.lit, wanted(query))).cast("array<string>"), terms(c))) == 0


def phrase(c: Column, query: str) -> Column:
    return F.concat(F.lit(" "), F.array_join(terms(c), " "), F.lit(" ")).contains(" " + " ".join(wanted(query)) + " ")


def begins(c: Column, start: str) -> Column:
    return F.exists(terms(c), lambda w: w.startswith(start))


def prefix(c: Column, starts: str) -> Column:
    """Every word of ``starts`` begins some word of the text."""
    out = F.lit(True)
    for start in wanted(starts):
        out = out & begins(c, start)
    return out


def web_style(c: Column, query: str) -> Column:
    """Words are and-ed and bind tighter than ``or``; quotes keep a phrase; ``-`` excludes a word or a phrase."""
    sides = [[]]
    for neg, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', query):
        if word.lower() == "or" and not neg:
            sides.append([])
            continue
        one = phrase(c, quoted or word)
        sides[-1].append(~one if neg else one)
    out = F.lit(False)
    for side in filter(None, sides):
        hit = side[0]
        for s in side[1:]:
            hit = hit & s
        out = out | hit
    return out if any(sides) else F.lit(True)


def search(c: Column, query: str) -> Column:
    """Words joined by ``&``, ``|``, ``!`` and brackets; ``:*`` behind a word matches beginnings."""
    marks = re.findall(r"[&|!()]|[^\s&|!():*]+(?::\*)?", query)

    def either(i):
        left, i = every(i)
        while i < len(marks) and marks[i] == "|":
            right, i = every(i + 1)
            left = left | right
        return left, i

    def every(i):
        left, i = one(i)
        while i < len(marks) and marks[i] == "&":
            right, i = one(i + 1)
            left = left & right
        return left, i

    def one(i):
        if i >= len(marks):
            raise ValueError(f"incomplete query: {query}")
        if marks[i] == "!":
            x, i = one(i + 1)
            return ~x, i
        if marks[i] == "(":
            x, i = either(i + 1)
            if i >= len(marks) or marks[i] != ")":
                raise ValueError(f"bracket left open: {query}")
            return x, i + 1
        return (prefix(c, marks[i][:-2]) if marks[i].endswith(":*") else phrase(c, marks[i])), i + 1

    out, i = either(0)
    if i != len(marks):
        raise ValueError(f"unknown query: {query}")
    return out


def unaccent(c: Column) -> Column:
    """Without the accents of Latin letters."""
    plain, accented = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY", "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
    return F.translate(c, accented, plain)


def like_literal(c: Column, part: str, ignore_case: bool = False) -> Column:
    """``part`` occurs as it is: ``%`` and ``_`` stand for themselves."""
    return F.lower(c).contains(part.lower()) if ignore_case else c.contains(part)


def gram_rank(c: Column, query: str, n: int = 3) -> Column:
    """The share of the query's n-grams that the value has: an order of best matches."""
    want = grams(F.lit(query), n)
    return F.size(F.array_intersect(want, grams(c, n))) / F.size(want)


def grams(c: Column, n: int = 3) -> Column:
    """Distinct character n-grams of the lower-cased value."""
    s = F.lower(c)
    return F.when(F.length(s) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - (n - 1)), lambda i: F.substring(s, i, F.lit(n))))).otherwise(F.array(s))


def has_grams(c: Column, query: str, n: int = 3) -> Column:
    return F.size(F.array_except(grams(F.lit(query), n), grams(c, n))) == 0
