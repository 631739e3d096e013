"""The pipeline's stages: what goes, what stays, and the shape of what they return."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from brindle.llm import decontaminate, jaccard_join, pii


@pytest.fixture(scope="module")
def made(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("score", F.lit("clash")).withColumn("found", F.lit(1))
    out = {"start": docs}
    for name, f in C.STAGES:
        docs = f(spark, docs, sf).persist()
        out[name] = docs
    return out


def test_columns(made):
    for name, _ in C.STAGES[:-1]:
        assert made[name].schema.names == made["start"].schema.names
    assert [n for n, _ in C.STAGES] == ["language", "duplicates", "benchmark", "private", "packed"]


def test_decisions(spark, sf, made):
    ids = {k: {r.doc_id for r in v.select("doc_id").collect()} for k, v in made.items()}
    assert ids["language"] == {r.doc_id for r in made["start"].collect() if any(c.isalpha() for c in r.text or "")}
    near = jaccard_join.near_duplicates(made["language"]).collect()  # doc_ids are unique here
    assert ids["duplicates"] == {r.doc_id for r in near if r.doc_id == r.component_id}
    bad = {r.doc_id for r in decontaminate.contaminated(made["duplicates"], spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert ids["benchmark"] == ids["duplicates"] - bad and bad
    assert ids["private"] == ids["benchmark"] == ids["packed"]
    old = {r.doc_id: r.text for r in made["benchmark"].collect()}
    again = {r.doc_id: r.text for r in pii.pseudonymise(made["benchmark"].select("doc_id", "text"), pii.key_of(spark)).collect()}
    for r in made["private"].collect():
        assert r.text == again[r.doc_id] and r.n_chars == len(r.text) and (r.found, r.score) == (1, "clash")
    assert any(again[k] != old[k] for k in old)


def test_edges(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    none = spark.createDataFrame([(1, None, None, None, None), (None, "the and of that is in", None, None, None), (3, "", "en", "s", 0)], docs.schema)
    for rows in (docs.where("false"), docs.limit(40).unionByName(none)):
        out = rows
        for _, f in C.STAGES:
            out = f(spark, out, sf)
        out.count()


def test_rows_without_or_with_shared_ids(spark, sf):
    """Null and repeated doc_ids: decisions are by row, never by id."""
    items = spark.read.parquet(f"{sf}/benchmark.parquet").where("length(text) > 60").limit(2).collect()
    w = lambda a, n: " ".join(f"w{a}x{j}" for j in range(n))
    rows = [(None, f"before {items[0].text} after"), (None, w(1, 30)), (None, w(1, 30)), (5, w(2, 40)), (5, w(3, 40)), (5, w(3, 40)), (4, w(2, 40) + " more"), (6, items[1].text), (7, ""), (7, None), (None, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    key = lambda df: sorted(((r.doc_id is None, r.doc_id, r.text or "") for r in df.collect()), key=str)
    kept = C.duplicates(spark, df, sf)
    want = [rows[0], rows[1], rows[4], rows[6], rows[7], rows[8], rows[9], rows[10]]
    assert key(kept) == sorted(((i is None, i, t or "") for i, t in want), key=str)
    assert key(C.benchmark(spark, df, sf)) == sorted(((i is None, i, t or "") for k, (i, t) in enumerate(rows) if k not in (0, 7)), key=str)


def test_whole_pipeline_brute_force(spark, sf):
    """All five stages in plain Python, without any operator's code but the cutting of n-grams, on a small table."""
    import zlib

    import numpy as np
    import test_llm_operators as T
    import test_pii as P
    from brindle.llm import packing

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    learned = T.learned_profiles([(r.lang, r.text) for r in rows.values() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2])
    texts = {k: r.text for k, r in rows.items()}
    texts = {k: t for k, t in texts.items() for name, score in [T.told(t, learned)] if name != "und" and score > 0}
    texts = {k: texts[k] for k, (n, root) in T.classes(texts).items() if k == root}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    bad = {d for d, _ in T.passages(texts, items)}
    old, P.KEY = P.KEY, pii.key_of(spark)
    texts = {k: P.ANY.sub(lambda m: P.second(m[0]), t) for k, t in texts.items() if k not in bad}
    P.KEY = old
    tok = packing.encoder(packing.default_tokenizer()).tok
    want, total = set(), 0
    for k, t in texts.items():
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        at, piece = 0, 0
        while at < len(ids):
            end = at + ((len(ids) - at) % 2048 or 2048)
            want.add((k, piece, at, end - at, zlib.crc32(ids[at:end].tobytes())))
            at, piece = end, piece + 1
    got = C.run(spark, sf).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    assert len({r.sequence_id for r in got}) == -(-total // 2048)  # the size bound


def test_run(spark, sf):
    from brindle.llm import _store

    assert C.run(spark, sf).count() > 0
    folder = _store.shared_dir(spark).removeprefix("file://") + "/brindle"
    assert {n.partition("-")[0] for n in os.listdir(folder)} <= {"pieces", "hits", "firsts", "parsed", "candidates", "templates", "secrets", "owners", "checks", "hot", "classes", "language", "duplicates", "benchmark", "private"}
