"""What the registered queries share: the register, the tables, and passes made of orders, with the SQL that makes the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.operators import bcbp

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Day that stands for today, so that results do not change with the clock.
AS_OF = "2001-08-01"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows in a set number of tasks: narrow rows with much work each, whose few files would make few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


PLACE = lambda c: F.concat(*[F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (F.pmod(c * m + a, F.lit(26)) + 1).cast("int"), F.lit(1)) for m, a in ((1, 0), (7, 3), (11, 5))])
PLACE_SQL = lambda c: " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', (({c} * {m} + {a}) % 26 + 1)::INT, 1)" for m, a in ((1, 0), (7, 3), (11, 5)))


def passes(spark, sf_dir, *also: str) -> DataFrame:
    """A pass of each order, and ``also`` of the order and its customer."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_orderkey")
    return o.select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("day"), F.upper(F.substring(F.md5(key.cast("string").cast("binary")), 1, 6)).alias("pnr"), PLACE(F.col("c_nationkey")).alias("origin"), PLACE(F.col("c_nationkey") + 1 + key % 20).alias("destination"),
        F.when(key % 3 == 0, "BA").when(key % 3 == 1, "QX").otherwise("LH").alias("carrier"), (key % 9998 + 1).alias("flight"), F.concat((key % 60 + 1).cast("string"), F.substring(F.lit("ABCDEFGHK"), (key % 9 + 1).cast("int"), F.lit(1))).alias("seat"), "c_name", *also,
    )


PASSES_SQL = f"""p AS (SELECT o_orderkey, o_orderdate::DATE AS day, upper(substr(md5(o_orderkey::VARCHAR), 1, 6)) AS pnr, {PLACE_SQL("c_nationkey")} AS origin, {PLACE_SQL("(c_nationkey + 1 + o_orderkey % 20)")} AS destination,
    CASE o_orderkey % 3 WHEN 0 THEN 'BA' WHEN 1 THEN 'QX' ELSE 'LH' END AS carrier, o_orderkey % 9998 + 1 AS flight, (o_orderkey % 60 + 1)::VARCHAR || substr('ABCDEFGHK', (o_orderkey % 9 + 1)::INT, 1) AS seat, c_name
    FROM orders JOIN customer ON o_custkey = c_custkey)"""


def encoded(p: DataFrame) -> Column:
    c = F.col
    return bcbp.encode(c("c_name"), c("pnr"), c("origin"), c("destination"), c("carrier"), c("flight"), F.dayofyear("day"), F.lit("Y"), c("seat"), c("o_orderkey") % 9999)


WORDS_SQL = """
    raw AS (SELECT doc_id, lang, i AS li, unnest(string_split(l, ' ')) AS t, generate_subscripts(string_split(l, ' '), 1) AS k
            FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
    w AS (SELECT doc_id, lang, li, t, row_number() OVER (PARTITION BY doc_id, li ORDER BY k) AS k FROM raw WHERE trim(t, ' ') <> ''),
    line AS (SELECT doc_id, li, string_agg(t, ' ' ORDER BY k) AS text, count(*) AS n FROM w GROUP BY doc_id, li)"""
