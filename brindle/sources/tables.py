"""Sources: multi-source feature tables from Parquet, in-memory matrices and a simulator; CSV and Parquet sinks.

A source is a slice of `cells(src int, obj string, feat string, val double)`; `objects` is the same
packed, one row for each object with its values ordered by feature.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import uniform

CELLS = "src int, obj string, feat string, val double"

#: Cells of driver tables, as SQL that Spark and DuckDB both run.
SQL_EVENTS = """select 1 as src, cast(u.user_id as string) as obj, t.event_type || '_n' as feat, cast(coalesce(c.n, 0) as double) as val
from (select distinct user_id from events) u cross join (select distinct event_type from events) t
left join (select user_id, event_type, count(*) as n from events group by user_id, event_type) c on c.user_id = u.user_id and c.event_type = t.event_type
union all
select 1 as src, cast(u.user_id as string) as obj, t.event_type || '_v' as feat, cast(coalesce(c.v, 0) as double) as val
from (select distinct user_id from events) u cross join (select distinct event_type from events) t
left join (select user_id, event_type, round(avg(value), 11) as v from events group by user_id, event_type) c on c.user_id = u.user_id and c.event_type = t.event_type"""
SQL_PRESENCE = """select 2 as src, cast(u.user_id as string) as obj, 'slot' || cast(t.slot as string) as feat, case when c.user_id is null then cast(0 as double) else cast(1 as double) end as val
from (select distinct user_id from events) u cross join (select distinct event_id % 60 as slot from events) t
left join (select distinct user_id, event_id % 60 as slot from events) c on c.user_id = u.user_id and c.slot = t.slot"""
SQL_NATIONS = """select 3 as src, cast(c_nationkey as string) as obj, c_mktsegment as feat, round(avg(c_acctbal), 11) as val from customer group by c_nationkey, c_mktsegment"""


def view_tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)


def event_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source 1: counts and mean values for each event type, by user."""
    view_tables(spark, sf_dir, "events")
    return spark.sql(SQL_EVENTS)


def presence_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source 2: 0/1 presence of a user in each of sixty slots."""
    view_tables(spark, sf_dir, "events")
    return spark.sql(SQL_PRESENCE)


def two_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_cells(spark, sf_dir).unionByName(presence_cells(spark, sf_dir))


def embedding_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, obj, x) of the embeddings table."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.lit(1).alias("src"), F.col("vec_id").cast("string").alias("obj"), F.col("embedding").cast("array<double>").alias("x"))


def from_matrix(spark: SparkSession, values: np.ndarray, objects, features, src: int = 1) -> DataFrame:
    """Cells of an in-memory matrix, objects in rows."""
    v = np.asarray(values, float)
    rows = [(src, str(o), str(f), float(v[i, j])) for i, o in enumerate(objects) for j, f in enumerate(features)]
    return spark.createDataFrame(rows, CELLS)


def pack(cells: DataFrame) -> DataFrame:
    """(src, obj, x): values of an object ordered by feature name."""
    return cells.groupBy("src", "obj").agg(F.array_sort(F.collect_list(F.struct("feat", "val"))).alias("c")).select("src", "obj", F.col("c.val").alias("x"))


def unpack(objects: DataFrame) -> DataFrame:
    return objects.select("src", "obj", F.posexplode("x").alias("i", "val")).select("src", "obj", F.format_string("f%05d", F.col("i")).alias("feat"), "val")


def align(cells: DataFrame) -> DataFrame:
    """Cells of the objects that the first source has; fails when another source lacks one of them."""
    first = cells.groupBy().agg(F.min("src").alias("s"))
    names = cells.join(F.broadcast(first), cells.src == F.col("s")).select("obj").distinct()
    n = names.count()
    got = cells.join(names, "obj", "left_semi")
    short = got.groupBy("src").agg(F.countDistinct("obj").alias("n")).where(F.col("n") != n).head(1)
    if short:
        raise ValueError(f"source {short[0].src} lacks objects of the first source")
    return got


def simulate(spark: SparkSession, n: int = 60, groups: int = 3, features=(120, 150), informative=(20, 25), effect: float = 2.5, sources: int = 2, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Planted groups: normal noise, informative feature j shifts group j mod `groups`. (cells, truth)."""
    per = lambda v, k: v[k % len(v)] if isinstance(v, (tuple, list)) else v
    obj = spark.range(n).select(F.format_string("obj%02d", F.col("id") + 1).alias("obj"), (F.floor(F.col("id") * groups / n) + 1).cast("int").alias("g"))
    parts = None
    for k in range(sources):
        feat = spark.range(per(features, k)).select(F.col("id").alias("j"), F.format_string(f"src{k + 1}_f%03d", F.col("id") + 1).alias("feat"))
        u1, u2 = uniform(seed, k, F.col("obj"), F.col("feat"), "a"), uniform(seed, k, F.col("obj"), F.col("feat"), "b")
        noise = F.sqrt(-2 * F.log(F.lit(1.0) - u1)) * F.cos(2 * np.pi * u2)
        shift = F.when((F.col("j") < per(informative, k)) & (F.col("j") % groups + 1 == F.col("g")), F.lit(float(effect))).otherwise(0.0)
        one = obj.crossJoin(F.broadcast(feat)).select(F.lit(k + 1).alias("src"), "obj", "feat", (noise + shift).alias("val"))
        parts = one if parts is None else parts.unionByName(one)
    return parts, obj.select("obj", "g")


def toy(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The planted two-source toy: 60 objects, 120 and 150 features, three groups."""
    return simulate(spark, seed=42)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def write_parquet(df: DataFrame, path: str, *partition: str) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition) if partition else w).parquet(path)
