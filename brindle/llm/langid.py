"""Language identification by rank-order profiles.

A profile is the `size` most frequent n-grams (n = 1 to 3) of a language in order of frequency; a
text's own profile is made the same way, and the language with the least out-of-place distance
wins: the sum over the text's n-grams of how far their ranks are apart, `size` for an n-gram that
the language's profile lacks.  N-grams are taken within words of lower-cased letters, with a blank
on either side of a word; everything but letters is a blank.

Profiles are counted from labelled rows only, at most about `sample` of them (picked by a hash of
doc_id), whole texts.  Counting n-grams of a slice is a sort of packed code points.

Defined results: null text, or text without a letter, is `und` with score 0; equal distances go to
the language that sorts first, equal counts to the n-gram with the smaller code; extra columns are
kept by `identify` (where one is named lang_pred or score, the new one takes the next free name);
with no labelled row every document is `und`; a row without doc_id is held out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._store import drop, free_name, small_batches, stage

SIZE = 400
SAMPLE = 20_000
_tables: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For every code point its lower-case letter, or 32."""
    if not _tables:
        t = np.full(0x110000, 32, np.uint32)
        for i in range(0x110000):
            ch = chr(i)
            if ch.isalpha():
                low = ch.lower()
                t[i] = ord(low) if len(low) == 1 else i
        _tables.append(t)
    return _tables[0]


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of every text and each text's first (length n+1); a text without letters has none."""
    cp, off = X.code_points(data, offsets)
    n = len(off) - 1
    if not len(cp):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    # One blank before each text and one at the very end, so that no n-gram crosses texts.
    c = np.full(len(cp) + n + 1, 32, np.uint64)
    doc = np.repeat(np.arange(n), np.diff(off))
    c[np.arange(len(cp)) + doc + 1] = _letters()[cp]
    owner = np.full(len(c), n, np.int64)
    owner[np.arange(len(cp)) + doc + 1] = doc
    keep = c != 32
    keep[1:] |= c[:-1] != 32  # of a run of blanks, the first stays
    keep[0] = True
    c, owner = c[keep], owner[keep]
    letter = c != 32
    b = np.uint64(21)
    one = c[letter]
    o1 = owner[letter]
    pair = (c[:-1] << b) | c[1:]
    ok2 = letter[:-1] | letter[1:]
    o2 = np.where(letter[:-1], owner[:-1], owner[1:])
    trip = (c[:-2] << np.uint64(42)) | (c[1:-1] << b) | c[2:]
    ok3 = letter[1:-1]
    o3 = owner[1:-1]
    code = np.concatenate([one, pair[ok2], trip[ok3]])
    own = np.concatenate([o1, o2[ok2], o3[ok3]])
    order = np.argsort(own, kind="stable")
    return code[order], np.searchsorted(own[order], np.arange(n + 1))


def ranked(code: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams of one text, most frequent first."""
    x = np.sort(code)
    cut = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    count = np.diff(np.append(cut, len(x)))
    u = x[cut]
    if len(u) > size:
        least = np.partition(count, len(u) - size)[len(u) - size]
        top = count >= least
        u, count = u[top], count[top]
    return u[np.argsort(-count, kind="stable")][:size]


def _count(batches):
    for rows in X.slices(batches, "text"):
        lang = np.asarray(rows.column(1).to_pylist(), object)
        code, first = grams(*X.utf8(rows.column(0)))
        who = np.repeat(lang, np.diff(first))
        for name in sorted(set(lang)):
            u, n = np.unique(code[who == name], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(u), pa.string()), pa.array(u.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


def learn(docs: DataFrame, usable: Column, size: int = SIZE, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """{language: its n-grams, most frequent first}, from rows with lang for which usable holds."""
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    total = rows.count()
    if total > sample:
        rows = rows.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_000)) < F.lit(int(1_000_000 * sample / total)))
    counts = rows.select("text", "lang").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = stage(counts, "grams")
    names = sorted(r.lang for r in counts.select("lang").distinct().collect())  # one row for each language
    out = {}
    for name in names:
        top = counts.where(F.col("lang") == name).orderBy(F.desc("n"), "gram").limit(size).toPandas()
        out[name] = top["gram"].to_numpy(np.int64).view(np.uint64)
    drop(counts)
    return out


def _predict(held, size: int, new: tuple[str, str]):
    def run(batches):
        names, codes, ranks = held.value
        for rows in X.slices(batches, "text"):
            code, first = grams(*X.utf8(rows.column(rows.schema.get_field_index("text"))))
            lang, score = [], np.zeros(rows.num_rows)
            for i in range(rows.num_rows):
                if first[i] == first[i + 1] or not names:
                    lang.append("und")
                    continue
                top = ranked(code[first[i] : first[i + 1]], size)
                at = np.arange(len(top))
                best = []
                for c, r in zip(codes, ranks, strict=True):
                    j = np.minimum(np.searchsorted(c, top), len(c) - 1)
                    best.append(int(np.where(c[j] == top, np.abs(r[j] - at), size).sum()))
                k = int(np.argmin(best))
                lang.append(names[k])
                score[i] = 1 - min(best[k], size * len(top)) / (size * len(top))
            rest = [c for c in rows.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[rows.column(rows.schema.get_field_index(c)) for c in rest], pa.array(lang, pa.string()), pa.array(score)], names=[*rest, *new])

    return run


def identify(rows: DataFrame, profiles: dict[str, np.ndarray], size: int = SIZE) -> DataFrame:
    """rows (any columns of plain types and text) -> the columns but text, and lang_pred and score."""
    names = sorted(profiles)
    codes, ranks = [], []
    for k in names:
        o = np.argsort(profiles[k])
        codes.append(profiles[k][o])
        ranks.append(o.astype(np.int64))
    held = rows.sparkSession.sparkContext.broadcast((names, codes, ranks))
    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    new = (free_name(rows, "lang_pred"), free_name(rows, "score"))
    return rows.mapInArrow(_predict(held, size, new), f"{rest}, {new[0]} string, {new[1]} double")


def fold(col: Column, n: int) -> Column:
    return F.pmod(F.crc32(col.cast("string")), F.lit(n))


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = learn(docs, fold(F.col("doc_id"), 4) != 2)
    return identify(docs.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(True)).alias("held_out"), "text"), profiles)
