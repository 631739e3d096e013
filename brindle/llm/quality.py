"""Quality rules: line sequence labelling by a linear-chain conditional random field.

Every line with a word gets features (lengths, shares of symbols, capitals, digits and separators,
repetition); Viterbi decoding of a CRF with two labels, content and boilerplate, marks each line by
its features and its neighbours' labels.  A document is kept while the code points of its content
lines make `share` of all code points in words or more.  Base rules on word counts and repeated
windows come first and fail a document by themselves.

Learning: from documents' labels alone, lines are latent.  Labelled documents, at most about `sample`
of them by a hash of doc_id, are cut in chains of at most CHAIN lines, of which about `lines` lines
are taken by a hash.  EM with posterior constraints: the posterior of a chain's lines is tilted, no
more than needed, until boilerplate holds BAD of its characters or more where the document is bad,
and GOOD or less where it is good; the CRF's likelihood climbs towards these posteriors by Adam steps
with exact forward-backward sums, for all chains at once, on the driver.

Base counts: words are runs of anything but the six ASCII separators; a repeated word is one in a
window of 8 words that the text holds twice or more.

Defined results: null and empty texts have no words and fail the base rules; without labels of both
kinds the CRF has zero weights but for symbols, capitals and repetition; repeated rows are judged alike;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._store import drop, small_batches, stage

SAMPLE, LINES, CHAIN, SHARE, WINDOW = 3000, 200_000, 64, 0.5, 8
BAD, GOOD = 0.7, 0.1  # shares of boilerplate that the labels ask for when learning
LEAST_WORDS, MOST_REPEATED = 20, 30
#: The symbols that are counted.
SYMBOLS = b"#*$%&|<>"
FEATURES = ("bias", "log words", "word length", "symbols", "capitals", "digits", "separators", "repeated words", "repeated line", "no full stop", "first", "last")

_CLASS = np.zeros((5, 256), np.int8)
_CLASS[0, list(SYMBOLS)] = 1
_CLASS[1, 65:91] = 1
_CLASS[2, 97:123] = 1
_CLASS[3, 48:58] = 1
_CLASS[4, list(b"|!\\/=_~^{}[]")] = 1


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Base counts of every text, and for each line with a word its text, code points in words and features."""
    n = len(offsets) - 1
    s, e, first = X.words(data, offsets)
    out = {"n_words": np.diff(first)}
    if not len(s):
        z = np.zeros(n, np.int64)
        return out | {"word_chars": z, "n_symbols": z, "n_dup_lines": z, "n_repeat_words": z, "line_doc": np.zeros(0, np.int64), "line_chars": np.zeros(0, np.int64), "x": np.zeros((0, len(FEATURES)))}
    h = X.word_hashes(data, s, e)
    doc = np.repeat(np.arange(n), np.diff(first))
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    word_cp = lead[e] - lead[s]
    out["word_chars"] = np.bincount(doc, word_cp, n).astype(np.int64)
    cum = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    sym = cum(_CLASS[0, data])
    out["n_symbols"] = sym[offsets[1:]] - sym[offsets[:-1]]
    # Repeated windows.
    again = np.zeros(len(s) + 1, np.int64)
    w, w_first = X.shingles(h, first, WINDOW)
    for i in np.flatnonzero(np.diff(first) > WINDOW):
        x = w[w_first[i] : w_first[i + 1]]
        o = np.argsort(x, kind="stable")
        y = x[o]
        twin = np.zeros(len(x), bool)
        same = y[1:] == y[:-1]
        twin[1:] |= same
        twin[:-1] |= same
        p = o[twin] + first[i]
        np.add.at(again, p, 1)
        np.add.at(again, p + WINDOW, -1)
    rep = np.cumsum(again[:-1]) > 0
    out["n_repeat_words"] = np.bincount(doc, rep, n).astype(np.int64)
    # Lines: from the byte after a line feed (or a text's start) to the next (or its end).
    feeds = np.flatnonzero(data == 10)
    begin = np.union1d(offsets[:-1][offsets[:-1] < offsets[1:]], feeds[np.searchsorted(offsets, feeds, "right") - 1 == np.searchsorted(offsets, np.minimum(feeds + 1, len(data) - 1), "right") - 1] + 1)
    begin = begin[begin < len(data)]
    line = np.searchsorted(begin, s, "right") - 1  # of each word
    used, l_first = np.unique(line, return_index=True)
    l_end_word = np.append(l_first[1:], len(s))
    l_doc = doc[l_first]
    a = begin[used]
    b = np.minimum(np.append(begin[1:], len(data))[used], offsets[l_doc + 1])
    b = b - ((data[b - 1] == 10) & (b > a))
    text_hash = _span_hashes(data, a, b)
    key = X.mix(text_hash ^ X.mix(l_doc.astype(np.uint64) + np.uint64(1)))
    o = np.argsort(key, kind="stable")
    dup = np.zeros(len(used), bool)
    dup[o[1:]] = key[o[1:]] == key[o[:-1]]
    out["n_dup_lines"] = np.bincount(l_doc, dup, n).astype(np.int64)
    sums = [cum(_CLASS[k, data]) for k in range(5)]
    got = [c[b] - c[a] for c in sums]
    n_w = l_end_word - l_first
    cps = np.add.reduceat(word_cp, l_first)
    reps = np.add.reduceat(rep.astype(np.int64), l_first)
    size = np.maximum(cps, 1)
    letters = np.maximum(got[1] + got[2], 1)
    last_byte = data[e[l_end_word - 1] - 1]
    head = np.append(True, l_doc[1:] != l_doc[:-1])
    tail = np.append(head[1:], True)
    x = np.stack(
        [np.ones(len(used)), np.log1p(n_w) / 3, cps / n_w / 8, np.minimum(got[0] / size * 5, 3), np.minimum(got[1] / letters * 3, 3), np.minimum(got[3] / size * 4, 3),
         np.minimum(got[4] / size * 5, 3), reps / n_w * 2, dup * 2.0, (~np.isin(last_byte, [46, 33, 63])).astype(float), head.astype(float), tail.astype(float)],
        1,
    )
    return out | {"line_doc": l_doc, "line_chars": cps, "x": x}


def _span_hashes(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span; every byte counts, separators too."""
    size = b - a
    at = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())
    pos = at - np.repeat(a, size)
    v = (data[at].astype(np.uint64) + np.uint64(1)) * X._LUT[65] * (X._POW[pos & (X._POW_LEN - 1)] + (pos >> 12).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C16))
    v = X.mix(v)
    ends = np.cumsum(size)
    c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v, dtype=np.uint64)])
    return X.mix(c[ends] - c[ends - size] + size.astype(np.uint64) * X._MULT[7])


class Chain:
    """Weights of the two-label CRF: emission of boilerplate against content, and label changes."""

    def __init__(self):
        self.w = np.zeros(len(FEATURES))
        self.w[[0, 3, 4, 7, 8]] = [-3.0, 2.0, 2.0, 2.0, 2.0]
        self.t = np.array([[0.5, -0.5], [-0.5, 0.5]])

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        """True for boilerplate lines of one document."""
        u = (x @ self.w).tolist()
        (c, d), (f, g) = self.t.tolist()
        p, q, back = 0.0, u[0], []
        for v in u[1:]:
            stay0, from1 = p + c, q + f
            from0, stay1 = p + d, q + g
            back.append((from1 > stay0, stay1 >= from0))
            p, q = (from1 if from1 > stay0 else stay0), (stay1 if stay1 >= from0 else from0) + v
        y = [q > p]
        for b0, b1 in reversed(back):
            y.append(b1 if y[-1] else b0)
        return np.array(y[::-1], bool)


class Chains:
    """Chains of lines as padded arrays, the longest first, for forward-backward over all of them at once."""

    def __init__(self, x: list[np.ndarray], chars: list[np.ndarray]):
        self.order = sorted(range(len(x)), key=lambda i: -len(x[i]))
        size = np.array([len(x[i]) for i in self.order])
        self.top = int(size[0])
        self.live = np.arange(self.top)[None] < size[:, None]
        self.x = np.concatenate([x[i] for i in self.order])  # all lines, chain by chain, as live lists them
        self.share = np.zeros(self.live.shape)
        self.share[self.live] = np.concatenate([chars[i] / max(chars[i].sum(), 1) for i in self.order])
        self.at = [int((size > i).sum()) for i in range(self.top)]  # chains that have line i

    def emission(self, w: np.ndarray) -> np.ndarray:
        e = np.zeros(self.live.shape)
        e[self.live] = self.x @ w
        return e

    def sums(self, e: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Posterior of boilerplate for every line, and expected label changes over all chains (2 x 2)."""
        s = 1 / (1 + np.exp(-np.clip(e, -30, 30)))
        em = np.stack([1 - s, s], 2)
        tr = np.exp(t)
        f, b = np.zeros_like(em), np.ones_like(em)
        f[:, 0] = em[:, 0] / em[:, 0].sum(1, keepdims=True)
        for i in range(1, self.top):
            n = self.at[i]
            a = (f[:n, i - 1] @ tr) * em[:n, i]
            f[:n, i] = a / a.sum(1, keepdims=True)
        changes = np.zeros((2, 2))
        for i in range(self.top - 2, -1, -1):
            n = self.at[i + 1]
            nxt = em[:n, i + 1] * b[:n, i + 1]
            back = nxt @ tr.T
            both = f[:n, i, :, None] * tr[None] * nxt[:, None, :]
            changes += (both / both.sum((1, 2), keepdims=True)).sum(0)
            b[:n, i] = back / back.sum(1, keepdims=True)
        p = f * b
        return np.where(self.live, p[..., 1] / np.maximum(p.sum(2), 1e-300), 0.0), changes

    def tilted(self, e: np.ndarray, t: np.ndarray, good: np.ndarray, most: float = 40.0) -> np.ndarray:
        """Emissions, tilted by a multiple of each line's share of its chain until boilerplate's expected share is as the label asks."""
        want = np.where(good, GOOD, BAD)
        held = (self.sums(e, t)[0] * self.share).sum(1)
        fine = np.where(good, held <= want, held >= want)
        lines = self.live.sum(1)
        lo, hi = np.where(good, -most * lines, 0.0), np.where(good, 0.0, most * lines)
        for _ in range(14):
            mid = (lo + hi) / 2
            high = (self.sums(e + mid[:, None] * self.share, t)[0] * self.share).sum(1) > want
            lo, hi = np.where(high, lo, mid), np.where(high, mid, hi)
        return e + np.where(fine, 0.0, (lo + hi) / 2)[:, None] * self.share


def train(x: list[np.ndarray], chars: list[np.ndarray], good: np.ndarray, steps: int = 120, every: int = 15, rate: float = 0.1, decay: float = 1e-3) -> Chain:
    """EM from labels of whole chains: every `every` steps the latent lines' posteriors are made anew."""
    m = Chain()
    k = len(FEATURES)
    parts = []  # chains of good and of bad documents; both kinds weigh alike, whatever their numbers
    for kind in (True, False):
        some = [i for i, v in enumerate(x) if len(v) and bool(good[i]) == kind]
        if not some:
            return m
        c = Chains([x[i] for i in some], [chars[i] for i in some])
        parts.append((c, np.full(len(some), kind), 0.5 / c.live.sum()))
    theta = np.zeros(k + 4)
    mom, var = np.zeros_like(theta), np.zeros_like(theta)
    wanted: list[tuple[np.ndarray, np.ndarray]] = []
    for step in range(1, steps + 1):
        w, t = theta[:k], theta[k:].reshape(2, 2)
        grad = np.zeros_like(theta)
        if step % every == 1:
            wanted = []
        for n, (c, kind, scale) in enumerate(parts):
            e = c.emission(w)
            if len(wanted) <= n:
                wanted.append(c.sums(c.tilted(e, t, kind), t))
            q, q_changes = wanted[n]
            got, changes = c.sums(e, t)
            grad[:k] += scale * (c.x.T @ (got - q)[c.live])
            grad[k:] += scale * (changes - q_changes).ravel()
        grad += decay * theta
        mom += 0.1 * (grad - mom)
        var += 0.01 * (grad * grad - var)
        theta = theta - rate * (mom / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-8)
    m.w, m.t = theta[:k], theta[k:].reshape(2, 2)
    return m


def _chains(batches):
    """(doc_id, quality, chain, x, chars): features and code points of the lines of each chain."""
    for rows in X.slices(batches, "text"):
        got = measure(*X.utf8(rows.column(2)))
        cut = np.searchsorted(got["line_doc"], np.arange(rows.num_rows + 1))
        at = [(i, a, min(a + CHAIN, cut[i + 1])) for i in range(rows.num_rows) for a in range(cut[i], cut[i + 1], CHAIN)]
        doc = pa.array([i for i, _, _ in at], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [rows.column(0).take(doc), rows.column(1).take(doc), pa.array([int(a - cut[i]) for i, a, _ in at], pa.int64()),
             pa.array([got["x"][a:b].ravel() for _, a, b in at], pa.list_(pa.float64())), pa.array([got["line_chars"][a:b] for _, a, b in at], pa.list_(pa.int64()))],
            names=["doc_id", "quality", "chain", "x", "chars"],
        )


def _hash_share(share: float, *cols: str):
    return F.pmod(F.xxhash64(*cols), F.lit(1_000_000)) < F.lit(int(1_000_000 * min(share, 1.0)))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lines: int = LINES) -> Chain:
    marked = labels.where(F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    total = marked.count()
    if not total:
        return Chain()
    marked = marked.where(_hash_share(sample / total, "doc_id"))
    rows = docs.join(F.broadcast(marked), "doc_id").select("doc_id", "quality", "text")  # the sample is bounded by its parameter
    kind = dict(rows.dtypes)["doc_id"]
    chains = stage(rows.mapInArrow(_chains, f"doc_id {kind}, quality int, chain long, x array<double>, chars array<long>"), "chains")
    found = chains.agg(F.sum(F.size("chars"))).first()[0] or 0
    got = chains.where(_hash_share(lines / max(found, 1), "doc_id", "chain")).select("quality", "x", "chars").toArrow()
    drop(chains)
    x = [np.asarray(v.values).reshape(-1, len(FEATURES)) for v in got.column("x")]
    return train(x, [np.asarray(v.values) for v in got.column("chars")], got.column("quality").to_numpy())


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, chain: Chain, share: float = SHARE) -> DataFrame:
    """docs (doc_id, text) -> doc_id, counts, base_failed, kept, content_share."""
    held = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        m = held.value
        for rows in X.slices(batches, "text"):
            got = measure(*X.utf8(rows.column(1)))
            cut = np.searchsorted(got["line_doc"], np.arange(rows.num_rows + 1))
            content = np.zeros(rows.num_rows)
            for i in range(rows.num_rows):
                a, b = cut[i], cut[i + 1]
                if b > a:
                    junk = m.viterbi(got["x"][a:b])
                    chars = got["line_chars"][a:b]
                    content[i] = chars[~junk].sum() / chars.sum()
            failed = (got["n_words"] < LEAST_WORDS) | (100 * got["n_repeat_words"] > MOST_REPEATED * got["n_words"])
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), *[pa.array(got[c].astype(np.int64)) for c in COLUMNS], pa.array(failed), pa.array(~failed & (content >= share)), pa.array(content)],
                names=["doc_id", *COLUMNS, "base_failed", "kept", "content_share"],
            )

    kinds = ", ".join(f"{c} long" for c in COLUMNS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {kinds}, base_failed boolean, kept boolean, content_share double")


def op3_crf_quality(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
