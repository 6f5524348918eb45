"""The driver's tables in the roles the operators work on, for both engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T


def read(spark, d, name, *columns):
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return df.select(*columns) if columns else df


def sentences(spark, d):
    """Order lines as sentences: country, year and month, dataset, speaker, score, label. Only the dimension is sent round, if it is small."""
    o = read(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    c = read(spark, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    n = read(spark, d, "nation", "n_nationkey", "n_name")
    line = read(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_linenumber", "l_discount", "l_returnflag", "l_quantity")
    j = line.join(o, line.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.select(F.col("n_name").alias("country"), F.year("o_orderdate").alias("year"), F.date_format("o_orderdate", "yyyy-MM").alias("ym"), F.col("c_mktsegment").alias("source_dataset"), F.col("c_custkey").alias("speaker_id"), F.col("l_discount").alias("score"), (F.col("l_returnflag") == "R").alias("label"), "l_suppkey", "o_orderkey", "l_linenumber", F.to_date("o_orderdate").alias("at"), F.col("l_quantity").alias("quantity"))


SENT = """sent AS (SELECT n_name country, CAST(year(o_orderdate) AS INTEGER) AS year, strftime(o_orderdate, '%Y-%m') ym, c_mktsegment source_dataset, c_custkey speaker_id,
  l_discount score, l_returnflag = 'R' label, l_suppkey, o_orderkey, l_linenumber, CAST(o_orderdate AS DATE) "at", l_quantity quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
YEAR = "CASE WHEN regexp_matches(date, '^[0-9]{4}') THEN CAST(substr(date, 1, 4) AS INTEGER) END"


def dated(spark, d, *columns):
    """Accusations with year and month of their date text."""
    return read(spark, d, "accusations", "id", "date", *columns).withColumns({"year": T.year_of(F.col("date")), "ym": T.month_of(F.col("date"))})


def register(queries, oracles):
    """A decorator that enters a query and its SQL, if it has one."""

    def add(sql=None):
        def wrap(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return wrap

    return add
