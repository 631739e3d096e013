"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Both sides are cut to lower-case words.  A mask is a set of word positions in a window; the hash
of a window takes these words and no others, so that a changed word at an ignored position does
not hide a match.  Windows of all test items and all documents are joined on mask and hash.  Each
hit fixes an alignment (document word - item word); around it all words of the item are held
against the document's, and an alignment counts where `share` of the item's words and `least`
words (or all, of a shorter item) agree.

The masks are complete for this rule: whatever words are replaced, an alignment that SHARE and LEAST
accept has a window in which one of them finds all its words.  The most words that can agree in n
without a hit is subadditive in n and below the rule's count for all n from 3 to 200, so for all n.

The windows of the test items (hash, item and place) and their words are broadcast only while they
take BROADCAST_BYTES at most; beyond that the hits come from a shuffled join and are verified after
a join by document.  Of a run of hits on one alignment only the first is verified: a window goes
when the one before it, of the same mask, hits the same item at the place before.

Defined results: null or empty texts have no words and give no row; items with fewer words than
a window is wide are looked for as a whole window of their own words (from 1 word up, exactly);
rows with one doc_id, null included, give one row for each item, the best over all their texts, and items without an id
are one item with id null; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The words that each mask takes, by position in its window.
MASKS = ((0, 1, 2), (0, 2, 3))
SHARE, LEAST = 0.6, 8
BROADCAST_BYTES = 64 << 20
KEY_BYTES, ITEM_BYTES, WORD_BYTES = 64, 64, 8  # of a broadcast window, item and word, generously
SPACE = "[ \\t\\n\\x0B\\f\\r]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), lambda w: w != "")


def _hashed(h: Column, tag: int, places):
    return lambda i: F.xxhash64(F.lit(tag), *[F.get(h, i + F.lit(j)) for j in places])


def _windows(h: Column, n: Column, masks) -> list[Column]:
    """For each mask the hashes of all its windows, by first word."""
    parts = []
    for k, m in enumerate(masks):
        last = n - F.lit(max(m) + 1)
        at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        parts.append(F.transform(at, _hashed(h, k, m)))
    return parts


def _cut(rows: DataFrame, h: str, n: str, masks) -> DataFrame:
    """rows and, for each window of each mask, key, at (its first word) and key_before (the same mask's window one word earlier, or 0)."""
    names = [f"_w{k}" for k in range(len(masks))]
    rows = rows.withColumns(dict(zip(names, _windows(F.col(h), F.col(n), masks), strict=True)))
    # The generator's input is an expression: of a column, Catalyst would infer a filter that computes the windows anew.
    rows = rows.select("*", F.posexplode(F.concat(*names)).alias("_p", "key"))
    start, at, before = F.lit(0), None, None
    for w, m in zip(names, masks, strict=True):
        end, here = start + F.greatest(F.col(n) - F.lit(max(m)), F.lit(0)), F.col("_p") - start
        last = F.get(w, here - 1)
        at, before = (F.when(F.col("_p") < end, here), F.when(F.col("_p") < end, last)) if at is None else (at.when(F.col("_p") < end, here), before.when(F.col("_p") < end, last))
        start = end
    return rows.select("*", at.alias("at"), F.coalesce(before, F.lit(0)).alias("key_before")).drop("_p", *names)


def contaminated(docs: DataFrame, items: DataFrame, masks=MASKS, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) -> (doc_id, item_id, word, n_matched, n_words, n_changed).

    One row for each document and item: its best alignment (most words, then the first place).
    doc_id may be of any type.
    """
    width = min(max(m) + 1 for m in masks)
    t = items.select(F.col("item_id").cast("long").alias("item_id"), F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("b"))
    t = t.withColumn("nb", F.size("b")).where("nb > 0")
    item = t.select(F.col("item_id").alias("whole"), "b", "nb")
    same = F.col("item_id").eqNullSafe(F.col("whole"))
    keys = _cut(t.where(F.col("nb") >= width), "b", "nb", masks).select("key", "item_id", F.col("at").alias("ib"), F.col("key_before").alias("item_before"))
    d = docs.select("doc_id", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h")).withColumn("n", F.size("h"))
    size = t.agg(F.count("*").alias("items"), F.sum("nb").alias("words"), F.sum(F.when(F.col("nb") >= width, F.col("nb") * len(masks)).otherwise(F.lit(0))).alias("keys"), F.sum((F.col("nb") < width).cast("int")).alias("few")).first()
    weight = (size.keys or 0) * KEY_BYTES + (size.words or 0) * WORD_BYTES + size["items"] * ITEM_BYTES

    def agree(h: Column, b: Column, nb: Column, diag: Column) -> Column:
        return F.size(F.filter(F.sequence(F.lit(0), nb - 1), lambda i: (i + diag >= 0) & (F.get(h, F.greatest(i + diag, F.lit(0))) == F.get(b, i))))

    cut = _cut(d, "h", "n", masks)
    matched = agree(F.col("h"), F.col("b"), F.col("nb"), F.col("diag")).alias("m")
    if weight <= BROADCAST_BYTES:
        starts = (F.col("ib") == 0) | (F.col("at") == 0) | (F.col("key_before") != F.col("item_before"))
        hits = cut.join(F.broadcast(keys), "key").where(starts).select("doc_id", "item_id", (F.col("at") - F.col("ib")).alias("diag"), "h")
        found = hits.join(F.broadcast(item), same).select("doc_id", "item_id", "nb", "diag", matched)
    else:
        seeds = cut.select("doc_id", "key", "at").join(keys, "key").select("doc_id", "item_id", (F.col("at") - F.col("ib")).alias("diag")).distinct()
        texts = d.select(F.col("doc_id").alias("text_of"), "h")
        found = seeds.join(item, same).join(texts, F.col("doc_id").eqNullSafe(F.col("text_of"))).select("doc_id", "item_id", "nb", "diag", matched)
    if size.few:  # items shorter than a window, whole; their words number less than a window's, so the sizes are a handful
        few = t.where(F.col("nb") < width)
        for n in range(1, width):
            own = few.where(F.col("nb") == n).select("item_id", F.xxhash64(F.lit(-n), *[F.get("b", F.lit(j)) for j in range(n)]).alias("key"))
            at = F.when(F.col("n") >= n, F.sequence(F.lit(0), F.col("n") - n)).otherwise(F.array().cast("array<int>"))
            win = F.transform(at, _hashed(F.col("h"), -n, range(n)))
            own = F.broadcast(own) if size.few * KEY_BYTES <= BROADCAST_BYTES else own
            found = found.union(d.select("doc_id", F.posexplode(win).alias("diag", "key")).join(own, "key").select("doc_id", "item_id", F.lit(n).alias("nb"), "diag", F.lit(n).alias("m")))
    best = found.where((F.col("m") >= F.least(F.lit(least), F.col("nb"))) & (F.col("m") >= F.col("nb") * share))
    best = best.groupBy("doc_id", "item_id").agg(F.max(F.struct("m", (-F.col("diag")).alias("back"), "nb")).alias("x"))
    return best.select(
        "doc_id", "item_id", (-F.col("x.back")).cast("long").alias("word"),
        F.col("x.m").cast("long").alias("n_matched"), F.col("x.nb").cast("long").alias("n_words"), (F.col("x.nb") - F.col("x.m")).cast("long").alias("n_changed"),
    )


def op9_spaced_seed_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
