"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(bias + sum of weights + sum over pairs of terms of the product of their factor
vectors): pairs such as an insult with the mention of a group count beyond their single weights.
A text's terms are the hashes of its distinct lower-cased words (ASCII letters, digits, and all
bytes of other characters) and of their beginnings of 4 to 7 bytes, which carry inflected and
compound forms; each counts once.

Learning: from labelled rows only, at most about `sample` of them by a hash of doc_id.  Terms are
counted over their whole texts by Spark; weights go to the terms in `least` rows or more that are most
telling by themselves by a two-sample statistic (`terms` of them, over Z), and to those in most toxic
rows (`support` of them, in `least` toxic rows or more), so that a term which tells nothing alone keeps
its place in pairs.  Only chosen terms of the sample come to the driver: at most sample x (terms +
support) numbers, whatever the texts' lengths.  Training there is minibatch Adam on the logistic loss
with weight decay.  Scoring sees every text whole.

Defined results: null and empty texts score what the bias says; with no labelled row every score
is 0; repeated rows are scored alike; a row without doc_id is held out; extra columns are kept (where
one is named score, the new one takes the next free name).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._store import drop, free_name, small_batches, stage

BITS = 20
SAMPLE, TERMS, SUPPORT, LEAST, Z, FACTORS = 12_000, 2000, 2000, 6, 2.5, 4
STARTS = (4, 5, 6, 7)  # bytes of the beginnings that are terms
#: Bytes that end a term, all of ASCII but letters and digits.
_ENDS = np.ones(256, bool)
_ENDS[128:] = False
_ENDS[48:58] = _ENDS[65:91] = _ENDS[97:123] = False


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed term, its text's index) for all words and beginnings of words, with repeats."""
    lower = data.copy()
    up = (lower >= 65) & (lower <= 90)
    lower[up] += 32
    lower[_ENDS[lower]] = 32
    s, e, first = X.words(lower, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first)).astype(np.int32)
    out, who = [X.word_hashes(lower, s, e)], [doc]
    part = np.zeros(len(s), np.uint64)
    for k in range(max(STARTS)):
        long = e - s > k + 1  # a whole word has a term of its own already
        s, e, doc, part = s[long], e[long], doc[long], part[long]
        part = part + X._LUT[lower[s + k]] * X._POW[k]
        if k + 1 in STARTS:
            out.append(X.mix(part + X._MULT[30 + k]))
            who.append(doc)
    return (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int32), np.concatenate(who)


def _bags(batches, chosen: np.ndarray | None):
    """(toxic, bag): distinct terms of each row, of the chosen ones if given."""
    keep = np.ones(1 << BITS, bool)
    if chosen is not None:
        keep[:] = False
        keep[chosen] = True
    for rows in X.slices(batches, "text"):
        h, doc = terms(*X.utf8(rows.column(1)))
        h, doc = h[keep[h]], doc[keep[h]]
        both = np.unique((doc.astype(np.int64) << BITS) | h)
        cut = np.searchsorted(both >> BITS, np.arange(rows.num_rows + 1))
        flat = (both & ((1 << BITS) - 1)).astype(np.int32)
        bags = [flat[cut[i] : cut[i + 1]] for i in range(rows.num_rows)]
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(bags, pa.list_(pa.int32()))], names=["toxic", "bag"])


class Machine:
    """Terms with weights w, factors v and a bias; slot maps a hashed term to its row or -1."""

    def __init__(self, bias: float, chosen: np.ndarray, factors: int = FACTORS, seed: int = 7):
        self.bias, self.chosen = bias, chosen
        self.slot = np.full(1 << BITS, -1, np.int32)
        self.slot[chosen] = np.arange(len(chosen))
        self.w = np.zeros(len(chosen))
        self.v = np.random.default_rng(seed).normal(0, 0.01, (len(chosen), factors))

    def raw(self, idx: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Scores before the sigmoid of texts given as rows of terms, distinct within a text."""
        n = len(first) - 1
        doc = np.repeat(np.arange(n), np.diff(first))
        out = np.full(n, self.bias) + np.bincount(doc, self.w[idx], n)
        for f in range(self.v.shape[1]):
            x = self.v[idx, f]
            out += 0.5 * (np.bincount(doc, x, n) ** 2 - np.bincount(doc, x * x, n))
        return out


def choose(df: np.ndarray, hit: np.ndarray, n: int, pos: float, terms: int = TERMS, support: int = SUPPORT, least: int = LEAST) -> np.ndarray:
    """Terms that get weights, of the numbers of rows and of toxic rows that hold each of the hashed terms."""
    p = min(max(pos / max(n, 1), 1e-4), 1 - 1e-4)
    z = np.abs(hit - df * p) / np.sqrt(np.maximum(df * p * (1 - p), 1e-9))
    z[df < least] = 0
    telling = np.argsort(-z, kind="stable")[:terms]
    often = np.argsort(-hit, kind="stable")[:support]
    return np.union1d(telling[z[telling] > Z], often[hit[often] >= least])


def train(bags: list[np.ndarray], y: np.ndarray, chosen: np.ndarray, epochs: int = 12, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Machine:
    """bags: distinct hashed terms of each row; only chosen ones count."""
    n, pos = len(bags), float(y.sum())
    p = min(max(pos / max(n, 1), 1e-4), 1 - 1e-4)
    m = Machine(float(np.log(p / (1 - p))), chosen, seed=seed)
    flat = np.concatenate(bags) if n else np.zeros(0, np.int32)
    doc = np.repeat(np.arange(n), [len(b) for b in bags])
    idx = m.slot[flat]
    keep = idx >= 0
    idx, doc = idx[keep], doc[keep]
    first = np.searchsorted(doc, np.arange(n + 1))
    rng = np.random.default_rng(seed)
    params = [np.zeros(1) + m.bias, m.w, m.v]
    mom, var = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for a in range(0, n, 256):
            docs = order[a : a + 256]
            counts = first[docs + 1] - first[docs]
            at = np.repeat(first[docs] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            i, row = idx[at], np.repeat(np.arange(len(docs)), counts)
            m.bias = float(params[0][0])
            sums = np.stack([np.bincount(row, m.v[i, f], len(docs)) for f in range(m.v.shape[1])], 1)
            raw = m.raw(i, np.concatenate([[0], np.cumsum(counts)]))
            err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[docs]) / len(docs)
            gw, gv = np.bincount(i, err[row], len(m.w)), np.zeros_like(m.v)
            for f in range(m.v.shape[1]):
                gv[:, f] = np.bincount(i, err[row] * (sums[row, f] - m.v[i, f]), len(m.w))
            step += 1
            for k, g in enumerate((np.array([err.sum()]), gw + decay * m.w, gv + decay * m.v)):
                mom[k] += 0.1 * (g - mom[k])
                var[k] += 0.001 * (g * g - var[k])
                params[k] -= rate * (mom[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.999**step)) + 1e-8)
    m.bias = float(params[0][0])
    return m


def _counts(batches):
    """(term, n, toxic) over a task's rows: at most 2^BITS terms."""
    n, hit = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for part in _bags(batches, None):
        bags = part.column(1)
        flat = np.asarray(bags.flatten())
        size = np.diff(np.asarray(bags.offsets))
        n += np.bincount(flat, minlength=1 << BITS)
        hit += np.bincount(flat[np.repeat(np.asarray(part.column(0)) > 0, size)], minlength=1 << BITS)
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), pa.array(hit[at])], names=["term", "n", "toxic"])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine | None:
    """docs (doc_id, text), labels (doc_id, toxic): rows that may be learned from."""
    marked = labels.where(F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    total = marked.count()
    if not total:
        return None
    if total > sample:
        marked = marked.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_000)) < F.lit(int(1_000_000 * sample / total)))
    rows = stage(docs.join(F.broadcast(marked), "doc_id").select("toxic", "text"), "labelled")  # the sample is bounded by its parameter
    seen = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("pos")).first()
    if not seen.n:
        return None
    counts = rows.mapInArrow(_counts, "term int, n long, toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).toPandas()  # at most 2^BITS rows
    df, hit = np.zeros(1 << BITS), np.zeros(1 << BITS)
    df[counts["term"]], hit[counts["term"]] = counts["n"], counts["toxic"]
    chosen = choose(df, hit, seen.n, float(seen.pos))
    held = rows.sparkSession.sparkContext.broadcast(chosen)
    got = rows.mapInArrow(lambda batches: _bags(batches, held.value), "toxic int, bag array<int>").toArrow()
    drop(rows)
    bags = [np.asarray(b.values, np.int32) for b in got.column("bag")]
    return train(bags, got.column("toxic").to_numpy().astype(float), chosen)


def score(rows: DataFrame, machine: Machine | None) -> DataFrame:
    """rows (any columns of plain types and text) -> the columns but text, and score."""
    held = rows.sparkSession.sparkContext.broadcast(machine)
    rest = [c for c in rows.columns if c != "text"]
    new = free_name(rows, "score")

    def run(batches):
        m = held.value
        for part in X.slices(batches, "text"):
            h, doc = terms(*X.utf8(part.column(part.schema.get_field_index("text"))))
            if m is None:
                p = np.zeros(part.num_rows)
            else:
                slot = m.slot[h]
                both = np.unique((doc[slot >= 0].astype(np.int64) << BITS) | slot[slot >= 0])
                p = 1 / (1 + np.exp(-np.clip(m.raw(both & ((1 << BITS) - 1), np.searchsorted(both >> BITS, np.arange(part.num_rows + 1))), -30, 30)))
            yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in rest], pa.array(p)], names=[*rest, new])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    return rows.mapInArrow(run, f"{kept}, {new} double")


def op5_factorization_toxicity(spark, sf_dir: str) -> DataFrame:
    from .langid import fold

    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = learn(docs, labels.where(fold(F.col("doc_id"), 3) != 1))
    out = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(True)).alias("held_out"), "text"), machine)
    return out.withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))
