"""Tables that the queries start from, as SQL for Spark and DuckDB alike: users of the event table as objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import SQL_EVENTS, SQL_PRESENCE, view_tables

#: Three fixed partitions of the users (labels), a fixed bagging of two of them, and three aligned methods.
SQL_PARTS = """select 1 as src, cast(user_id as string) as obj, cast(user_id % 3 + 1 as int) as cluster from (select distinct user_id from events) u1
union all select 2 as src, cast(user_id as string) as obj, cast(user_id % 4 + 1 as int) as cluster from (select distinct user_id from events) u2
union all select 3 as src, cast(user_id as string) as obj, cast((user_id * 7 + 3) % 5 + 1 as int) as cluster from (select distinct user_id from events) u3"""
SQL_BAGS = """select cast(s.s as int) as src, cast(s.it as int) as iter, cast(u.user_id as string) as obj, cast((u.user_id * (s.it + 1) + s.s) % (3 + s.it % 3) + 1 as int) as cluster
from (select distinct user_id from events) u cross join (select a.s, b.it from (select 1 as s union all select 2) a cross join (select 1 as it union all select 2 union all select 3 union all select 4 union all select 5 union all select 6) b) s
where (u.user_id * 13 + s.it * 7 + s.s * 3) % 5 <> 0"""
SQL_ALIGNED = """select cast(src as int) as method, obj, cast(case when cluster > 3 then 3 else cluster end as int) as label from parts"""
SQL_DOCS = """select cast(doc_id as string) as obj, cast(case lang when 'de' then 1 when 'en' then 2 when 'es' then 3 else 4 end as int) as cluster, source from documents"""
SQL_EXPR = """select 'g' || cast(l_suppkey as string) as gene, cast(p_size as string) as obj, sum(l_quantity) as val from lineitem join part on p_partkey = l_partkey group by l_suppkey, p_size"""


def users(spark: SparkSession, sf: str) -> DataFrame:
    view_tables(spark, sf, "events")
    return spark.sql(SQL_EVENTS)


def presence(spark: SparkSession, sf: str) -> DataFrame:
    view_tables(spark, sf, "events")
    return spark.sql(SQL_PRESENCE)


def both(spark: SparkSession, sf: str) -> DataFrame:
    return users(spark, sf).unionByName(presence(spark, sf))


def parts(spark: SparkSession, sf: str) -> DataFrame:
    view_tables(spark, sf, "events")
    return spark.sql(SQL_PARTS)


def bags(spark: SparkSession, sf: str) -> DataFrame:
    view_tables(spark, sf, "events")
    return spark.sql(SQL_BAGS)


def aligned(spark: SparkSession, sf: str) -> DataFrame:
    parts(spark, sf).createOrReplaceTempView("parts")
    return spark.sql(SQL_ALIGNED)


def expression(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as genes over part sizes as objects: total quantity, zero where none."""
    view_tables(spark, sf, "lineitem", "part")
    return spark.sql(SQL_EXPR)
