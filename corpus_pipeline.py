"""The corpus pipeline: language ID, near duplicates, decontamination, PII, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. `run` writes each stage's rows as Parquet in the shared folder and reads them back.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import decontaminate, jaccard_join, langid, packing, pii
from brindle.llm._store import scoped, small_batches, stage


def _row(docs: DataFrame):
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told: null texts, texts without a letter, and texts that share no n-gram with any profile go."""
    small_batches(spark)
    profiles = langid.learn(docs, langid.fold(F.col("doc_id"), 4) != 2)
    # Whole rows travel in a struct, so that no column of theirs can clash and nothing has to be joined.
    told = langid.identify(docs.select(_row(docs), "text"), profiles).where("lang_pred <> 'und' and score > 0")
    return told.select("row.*")


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with _row, a number of its own for each row: null and repeated doc_ids are no key.

    Stages read written Parquet, where a row's place, and so its number, is the same in a task made anew.
    """
    return docs.withColumn("_row", F.monotonically_increasing_id())


def duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates: the one with the smallest doc_id (null last), of rows that share it the first."""
    rows = _numbered(docs)
    classes = jaccard_join.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id")
    named = rows.select("_row", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row").alias("rank")).join(classes, "_row")
    first = stage(named.groupBy("component_id").agg(F.min("rank").alias("rank")).select(F.col("rank._row").alias("_row")), "firsts")
    # Rows that stay are most rows: joined by shuffle at every size, never broadcast.
    return rows.join(first.hint("merge"), "_row", "left_semi").select(*[f"`{c}`" for c in docs.columns])


def benchmark(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = _numbered(docs)
    hit = stage(decontaminate.contaminated(rows.select(F.col("_row").alias("doc_id"), "text"), items).select(F.col("doc_id").alias("_row")).distinct(), "hits")
    return rows.join(hit, "_row", "left_anti").select(*[f"`{c}`" for c in docs.columns])


def private(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal numbers, dates and addresses by pseudonyms; n_chars follows the text."""
    done = pii.pseudonymise(docs.select(_row(docs), "text"), pii.key_of(spark))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return done.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def packed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places the documents' token pieces in sequences."""
    small_batches(spark)
    return packing.pack(packing.pieces(docs, packing.default_tokenizer()))


STAGES = [("language", language), ("duplicates", duplicates), ("benchmark", benchmark), ("private", private), ("packed", packed)]
#: SQL can express neither the profiles nor the packing; tests hold each stage against brute force.
ORACLE_SQL = None


@scoped
def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES[:-1]:
        docs = scoped(lambda docs=docs, f=f, name=name: stage(f(spark, docs, sf_dir), name))()
    return STAGES[-1][1](spark, docs, sf_dir)
