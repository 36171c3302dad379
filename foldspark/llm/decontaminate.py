"""Benchmark decontamination over a positional inverted index, in DataFrame functions only.

Items are cut into windows of ``n`` words (shorter items are one window). Each window keeps its
``depth`` rarest terms by training-token count; only those terms' postings (document, position)
are stored, and postings of a window's rarest term keep the words around them. Candidates come
from the rarest list; each is then looked up in the window's other lists at the position that its
offset demands. What is left is compared word for word with the stored words, so that results are
exact and no text is shuffled. Lists go by ``lower``, which folds more than A-Z but keeps every
word's place; the comparison folds A-Z only.

Null and empty texts have no words and no hits; repeated items count under each of their ids, items
without an id count as none; repeated document ids are told apart by their text, and null ids are kept.
Extra columns, whatever their names, don't matter; without documents or items nothing is found.

Tables made from the benchmark are broadcast up to BROADCAST_ROWS counted rows. Beyond it words are
counted before they meet the benchmark's, and postings are found without the words around them, which
are fetched from each document once; adaptive execution splits the lists of frequent terms.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm.common import ascii_lower, cut, words

#: Fixed value: what separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before A-Z are lower-cased: they belong to words.
RAW_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Rows up to which a table made from the benchmark is broadcast; beyond it, joins shuffle.
BROADCAST_ROWS = 200_000


def tokens(text):
    return words(ascii_lower(text), SEPARATORS)


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def windows(items: DataFrame, n: int = 10) -> DataFrame:
    """window_id, words of every distinct window of the items, and the items that hold it."""
    w = items.select("item_id", tokens(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1)))
    w = w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, n))).alias("words"))
    w = w.groupBy("words").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    return w.select(F.monotonically_increasing_id().alias("window_id"), "words", "items")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, its words as written, and ``h``, which tells rows of equal id apart by text."""
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("h"), words(F.col("text"), RAW_SEPARATORS).alias("w"))


def rarest(win: DataFrame, docs: DataFrame, depth: int, vocab_rows: int) -> DataFrame:
    """window_id and ``lists``: its ``depth`` rarest terms as (tf, term, offset), rarest first.

    Windows holding a term that no document has cannot occur and are left out.
    """
    terms = win.select("window_id", F.posexplode("words").alias("offset", "term")).withColumn("term", F.lower("term"))
    vocabulary = terms.select("term").distinct()
    corpus = keyed(docs).select(F.explode("w").alias("term")).select(F.lower("term").alias("term"))
    if vocab_rows <= BROADCAST_ROWS:
        corpus = corpus.join(F.broadcast(vocabulary), "term", "left_semi")
    freq = corpus.groupBy("term").agg(F.count("*").alias("tf"))
    freq = cut(freq.join(vocabulary, "term", "left_semi"))
    first = terms.groupBy("window_id", "term").agg(F.min("offset").alias("offset")).join(small(freq, vocab_rows), "term", "left")
    lists = first.groupBy("window_id").agg(F.sort_array(F.collect_list(F.struct("tf", "term", "offset"))).alias("lists"))
    return lists.where(F.col("lists")[0]["tf"].isNotNull()).select("window_id", F.slice("lists", 1, depth).alias("lists"))


def occurrences(docs: DataFrame, items: DataFrame, n: int = 10, depth: int = 2, slack: int = 0):
    """Where each window's rare terms meet: doc_id, h, start (0-based), window_id and the words ``here``.

    With ``slack`` the other terms may stand up to so many places off: a proximity match.
    """
    win = cut(windows(items, n))
    count = win.count()
    vocab_rows = win.select(F.explode("words").alias("word")).distinct().count()
    lists = cut(rarest(win, docs, depth, vocab_rows))
    terms = cut(lists.select(F.posexplode("lists").alias("k", "x")).groupBy(F.col("x.term").alias("listed")).agg((F.min("k") == 0).alias("anchor")))
    rows = keyed(docs)
    low = F.greatest(F.col("pos") - (n - 1), F.lit(0))
    around = F.when(F.col("anchor"), F.slice("w", low + 1, F.col("pos") - low + n))
    if terms.count() <= BROADCAST_ROWS:
        every = rows.select("doc_id", "h", "w", F.posexplode("w").alias("pos", "word"))
        held = every.join(F.broadcast(terms), F.lower("word") == F.col("listed"))
    else:
        every = rows.select("doc_id", "h", F.posexplode("w").alias("pos", "word")).withColumn("word", F.lower("word"))
        met = every.join(terms, F.col("word") == F.col("listed")).groupBy(F.col("doc_id").alias("_d"), F.col("h").alias("_h")).agg(F.collect_set(F.struct("pos", "listed", "anchor")).alias("at"))
        held = rows.dropDuplicates(["doc_id", "h"]).join(met, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h"))).select("doc_id", "h", "w", F.inline("at"))
    index = cut(held.select("doc_id", "h", F.col("listed").alias("term"), "pos", around.alias("around")))
    plan = lists.select("window_id", "lists", F.col("lists")[0]["term"].alias("term"), F.col("lists")[0]["offset"].alias("offset"))
    at = index.where("around is not null").join(small(plan, count), "term").withColumn("start", F.col("pos") - F.col("offset")).where("start >= 0")
    here = F.slice("around", F.least(F.col("pos"), F.lit(n - 1)) - F.col("offset") + 1, n)
    at = at.select("doc_id", "h", "start", "window_id", "lists", here.alias("here"))
    wide = slack + 1
    for k in range(1, depth):
        # A window of fewer distinct terms meets its rarest list again.
        step = F.coalesce(F.get("lists", F.lit(k)), F.col("lists")[0])
        at = at.withColumn("term", step["term"]).withColumn("want", F.col("start") + step["offset"])
        if slack:
            bins = F.array(*[F.floor(F.col("want") / wide) + j for j in (-1, 0, 1)])
            side = index.select("h", "term", F.floor(F.col("pos") / wide).alias("bin"), "pos").distinct()
            met = at.select("h", "start", "window_id", "term", "want", F.explode(bins).alias("bin")).join(side, ["h", "term", "bin"])
            met = met.where(F.abs(F.col("pos") - F.col("want")) <= slack).select("h", "start", "window_id").distinct()
            at = at.join(met, ["h", "start", "window_id"], "left_semi")
        else:
            at = at.join(index.select("h", "term", F.col("pos").alias("want")), ["h", "term", "want"], "left_semi")
    return at.select("doc_id", "h", "start", "window_id", "here"), win, count


def found(docs: DataFrame, items: DataFrame, n: int = 10, depth: int = 2) -> DataFrame:
    """Per exact occurrence of a window: doc_id, h, start (0-based), length, items."""
    at, win, count = occurrences(docs, items, n, depth)
    cand = at.join(small(win.withColumnRenamed("words", "want"), count), "window_id")
    same = ascii_lower(F.concat_ws(" ", F.slice("here", F.lit(1), F.size("want")))) == F.concat_ws(" ", "want")
    return cand.where(same).select("doc_id", "h", "start", F.size("want").alias("length"), "items")


def proximity(docs: DataFrame, items: DataFrame, n: int = 10, depth: int = 3, slack: int = 3) -> DataFrame:
    """Per proximity match doc_id, start (where the window would begin) and items: the window's
    ``depth`` rarest terms stand at most ``slack`` places from where the window has them."""
    at, win, count = occurrences(docs, items, n, depth, slack)
    return at.join(small(win, count), "window_id").select("doc_id", "start", "items").distinct()


def clean(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """The rows of ``docs`` that hold no window, with all columns as they are. Null doc_ids are rows like
    others; rows of equal doc_id and text go or stay together."""
    bad = cut(found(docs, items, n).select(F.col("doc_id").alias("_d"), F.col("h").alias("_h")).distinct())
    left = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs["doc_id"].alias("_i"), F.xxhash64(docs["doc_id"], docs["text"]).alias("_k"))
    left = left.join(small(bad, bad.count()), F.col("_i").eqNullSafe(F.col("_d")) & (F.col("_k") == F.col("_h")), "left_anti")
    return left.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def report(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = found(docs, items, n).groupBy("doc_id", "h").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence("start", F.col("start") + F.col("length") - 1))))).alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("ids"),
    )
    base = keyed(docs).select("doc_id", "h", F.size("w").cast("long").alias("n_words"))
    out = base.join(hit.withColumnsRenamed({"doc_id": "_d", "h": "_h"}), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
n AS (SELECT DISTINCT item_id, x, len(x) AS k FROM (SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: w[i:i + 9])) AS x FROM b WHERE len(w) > 0)),
g AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS s, w FROM d, (SELECT DISTINCT k FROM n) WHERE len(w) >= k),
m AS (SELECT doc_id, s, g.k, item_id FROM g JOIN n ON g.k = n.k AND w[s:s + g.k - 1] = x),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
