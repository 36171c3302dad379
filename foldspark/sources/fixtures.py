"""Nested documents made row by row from the flat tables, without a shuffle, with the SQL that makes the same."""

from pyspark.sql import DataFrame, SparkSession

from foldspark.sources.tables import table

TARGET = [
    "o_orderkey AS id", "CAST(o_custkey % 100 AS INT) AS number", "CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS flag", "o_orderpriority AS name",
    "CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE CAST(o_custkey % 7 AS INT) END AS maybe", "o_totalprice AS total", "o_orderdate AS date",
    """CASE WHEN o_custkey % 11 = 0 THEN NULL WHEN o_custkey % 4 = 0 THEN CAST(array() AS ARRAY<INT>) ELSE transform(sequence(1, CAST(o_custkey % 4 AS INT)),
        i -> CASE WHEN (i + o_orderkey) % 9 = 0 THEN NULL ELSE CAST((i * o_custkey) % 10 AS INT) END) END AS numbers""",
    """CASE WHEN o_custkey % 3 = 0 THEN CAST(array() AS ARRAY<STRUCT<n: INT, score: DOUBLE, tags: ARRAY<INT>>>) ELSE transform(sequence(1, CAST(o_custkey % 3 AS INT)),
        i -> named_struct('n', i, 'score', o_totalprice * i, 'tags', sequence(1, i))) END AS children""",
    "CASE WHEN o_custkey % 6 = 0 THEN CAST(map() AS MAP<STRING, INT>) ELSE map('a', CAST(o_custkey % 3 AS INT), 'b', CAST(o_custkey % 5 AS INT)) END AS dict",
    "named_struct('n', CAST(o_custkey % 4 AS INT), 'word', lower(o_orderpriority)) AS inner",
]
#: The same in DuckDB's SQL, as the common table expression ``t``.
TARGET_SQL = """WITH t AS (SELECT o_orderkey AS id, (o_custkey % 100)::INT AS number, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS flag, o_orderpriority AS name,
  CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE (o_custkey % 7)::INT END AS maybe, o_totalprice AS total, o_orderdate AS date,
  CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE list_transform(range(1, o_custkey % 4 + 1), lambda i: CASE WHEN (i + o_orderkey) % 9 = 0 THEN NULL ELSE ((i * o_custkey) % 10)::INT END) END AS numbers,
  list_transform(range(1, o_custkey % 3 + 1), lambda i: {'n': i::INT, 'score': o_totalprice * i, 'tags': range(1, i + 1)::INT[]}) AS children,
  CASE WHEN o_custkey % 6 = 0 THEN MAP([]::VARCHAR[], []::INT[]) ELSE MAP(['a', 'b'], [(o_custkey % 3)::INT, (o_custkey % 5)::INT]) END AS dict,
  {'n': (o_custkey % 4)::INT, 'word': lower(o_orderpriority)} AS inner_ FROM orders) """


def target(spark: SparkSession, root: str) -> DataFrame:
    """Orders as documents with scalars, nulls, arrays, child documents, a map and an inner document."""
    return table(spark, root, "orders").selectExpr(*TARGET)
