"""N-gram Jaccard join, size-aware heavy-light, with the classes of near-duplicate documents.

The method.  A set of s shingles that reaches the threshold t with a partner shares at least
c = ceil(t*s) of them, so that under one global order of shingles the first s-c+k of both hold k
common ones at least.  Small sets (light) enumerate the k = 2 subsets of that prefix, which are
selective; large sets (heavy) go through inverted lists of single shingles (k = 1), since the
subsets of a large prefix are too many.  The boundary between them is the size at which
enumerating plus scanning costs least, by the figures of the first pass over the data.

Global order: any one order is exact.  Ours puts frequent shingles last, so that passages that
many documents share stay out of the prefixes; which are frequent is gathered from all documents.

Lists.  Postings travel packed (12 bytes each) to buckets of bounded size, where keys held by one
set vanish and keys with equal lists become one; lists of frequent keys are dealt over salted
buckets.  A first round compares the members of a list with its first by hash; verified links join
classes.  Lists with the same first member are then joined, and large lists that hang together as well
where that leaves fewer pairs to compare than the lists by themselves: near copies share many
nearly equal lists.  Joined lists that still hold more than one class go through blocks of bitmaps
(below), block by block, where pairs within a class are passed over.  Where such lists are large, a
pass that keeps each member's nearest few partners joins classes first; the pass after it, over all
pairs of different classes, is the exact one.  No step makes a row for each pair of a list.

Verification.  A candidate pair is first held against a bitmap of each set, one bit of parity for
every shingle or fewer: the bits in which two bitmaps differ bound the symmetric difference from
below, so that this filter drops no link.  The texts of the few pairs that pass are compared
shingle by shingle.

Defined results: null or empty text, or one without words, is linked with nothing and is its own
class; texts with equal shingle sets are linked (one of them stands for all); rows that share a doc_id
are documents of their own, each with its own row, links and class; rows without doc_id have no name
to be reported under and are left out.  Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._store import scoped, small_batches, stage
from .components import components

CHUNK = 1_500_000  # shingles that a task counts at once
LIST = 8192  # longest packed list
BUCKET_BYTES = 32 << 20
HOT_SHARE, HOT_LEAST, HOT_MOST = 0.0005, 16, 1_000_000
SEEN = 3  # a shingle in fewer sets of a chunk is not frequent
BINS = np.unique(np.round(2 ** (np.arange(0, 97) / 4)).astype(np.int64))
BLOCK, BLOCK_BYTES = 4096, 32 << 20  # members of a list that are compared at once, and their bitmaps
LARGE, LARGE_PAIRS, NEAREST = 256, 50, 4  # members of a large list; its pairs a document from which the pass of nearest partners pays
BROADCAST_IDS = 100_000  # ids of texts to fetch that are broadcast; more are joined by shuffle


def need(s, num: int, den: int):
    """ceil(t*s): the least overlap of a set of size s with any partner."""
    return -(-num * s // den)


def _sets(rows: pa.RecordBatch, k: int):
    """(index, sorted distinct shingles) of every text with words."""
    data, off = X.utf8(rows.column(rows.schema.get_field_index("text")))
    s, e, first = X.words(data, off)
    sh, at = X.shingles(X.word_hashes(data, s, e, lower=True), first, k)
    for i in range(rows.num_rows):
        yield i, X.distinct(sh[at[i] : at[i + 1]])


def _digest(x: np.ndarray) -> int:
    h = np.add.reduce(X.mix(x + np.uint64(0x632BE59BD9B4E019)), keepdims=True)
    return int(X.mix(h + np.array([len(x)], np.uint64) * np.uint64(0xDA942042E4DD58B5)).view(np.int64)[0])


def _bits(x: np.ndarray) -> bytes:
    """Parity bitmap of a set; its number of bits is the least power of two, 64 at least, that is not below the size."""
    b = max(64, 1 << (len(x) - 1).bit_length())
    return np.packbits((np.bincount((x & np.uint64(b - 1)).astype(np.int64), minlength=b) & 1).astype(np.uint8), bitorder="little").tobytes()


def _apart(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference: differing bits, the longer bitmap folded to the shorter."""
    if len(a) < len(b):
        a, b = b, a
    x, n = int.from_bytes(a, "little"), len(a)
    while n > len(b):
        n //= 2
        x = (x >> (8 * n)) ^ (x & ((1 << (8 * n)) - 1))
    return (x ^ int.from_bytes(b, "little")).bit_count()


def _close(num: int, den: int):
    """Of pairs with sizes and bitmaps, those that may reach the threshold."""

    def run(batches):
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("na", "nb", "bits_a", "bits_b")]
            ok = [_apart(x, y) * (den + num) <= (m + n) * (den - num) for m, n, x, y in zip(*cols, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _scan(k: int, num: int, den: int):
    """First pass. kind 0: doc_id, size, digest, bitmap; 1: shingle, sets of a chunk with it; 2: size bin, sets, prefix, subsets, scanned."""

    def run(batches):
        held: list[np.ndarray] = []
        seen: set[int] = set()
        total = 0

        def flush():
            x = np.concatenate(held)
            u, inv, c = np.unique(x, return_inverse=True, return_counts=True)
            often = c >= SEEN
            out = [_rows(1, u[often].view(np.int64), c[often])]
            sizes = np.array([len(h) for h in held])
            ends = np.cumsum(sizes)
            p1 = sizes - need(sizes, num, den) + 1
            cc = np.concatenate([[0], np.cumsum(np.minimum(c[inv] - 1, LIST))])
            scanned = cc[ends - sizes + p1] - cc[ends - sizes]
            b = np.searchsorted(BINS, sizes, "right") - 1
            p2 = p1 + 1
            t = [np.bincount(b, w, len(BINS)).astype(np.int64) for w in (np.ones(len(b)), p1, p2 * (p2 - 1) // 2, scanned)]
            i = np.flatnonzero(t[0])
            out.append(_rows(2, i, t[0][i], t[1][i], t[2][i], t[3][i]))
            held.clear()
            return out

        for rows in X.slices(batches, "text"):
            n, g = np.zeros(rows.num_rows, np.int64), np.zeros(rows.num_rows, np.int64)
            bits: list[bytes | None] = [None] * rows.num_rows
            for i, x in _sets(rows, k):
                n[i] = len(x)
                if len(x):
                    bits[i] = _bits(x)
                    g[i] = _digest(x)
                    if int(g[i]) not in seen:
                        seen.add(int(g[i]))
                        held.append(x)
                        total += len(x)
            yield _rows(0, rows.column(rows.schema.get_field_index("doc_id")), n, g, bits=bits)
            if total >= CHUNK:
                yield from flush()
                total = 0
                seen.clear()
        if held:
            yield from flush()

    return run


def _rows(kind: int, a, *more, bits=None) -> pa.RecordBatch:
    n = len(a)
    cols = [*more, *[np.zeros(n, np.int64)] * (4 - len(more))]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int32)), a.cast(pa.int64()) if isinstance(a, pa.Array) else pa.array(np.asarray(a, np.int64)), *[pa.array(np.asarray(c, np.int64)) for c in cols], pa.array(bits or [None] * n, pa.binary())],
        names=["kind", "a", "b", "c", "d", "e", "bits"],
    )


def _boundary(bins: list) -> int:
    """The size up to which enumerating 2-subsets costs less than scanning lists of single shingles."""
    best, at = math.inf, 0
    for x in [0, *(int(BINS[min(r.a + 1, len(BINS) - 1)]) - 1 for r in bins)]:
        cost = sum(r.d for r in bins if BINS[r.a] <= x) + sum(r.c + r.e for r in bins if BINS[r.a] > 0.75 * x)
        if cost < best:
            best, at = cost, x
    return at


def _post(k: int, num: int, den: int, hot_b, boundary: int, n_buckets: int):
    """Second pass: postings of every distinct set of a task, packed by bucket; buckets of frequent keys are negative."""

    def run(batches):
        hot, size = hot_b.value
        rank = np.log2(np.maximum(size, 1)).astype(np.int64)
        toks: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        salts: list[np.ndarray] = []
        seen: set[int] = set()
        held = 0

        def flush():
            t, g, s = np.concatenate(toks), np.concatenate(owners), np.concatenate(salts)
            for v in (toks, owners, salts):
                v.clear()
            cold = ((t >> np.uint64(40)) % np.uint64(n_buckets)).astype(np.int64)
            salted = X.mix(t + (X.mix(g.view(np.uint64)) % np.maximum(s, 1).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15))
            b = np.where(s > 0, -1 - (salted % np.uint64(n_buckets)).astype(np.int64), cold)
            o = np.argsort(b, kind="stable")
            b, t, g = b[o], t[o], g[o]
            cut = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
            ends = np.append(cut[1:], len(b))
            pay = [np.concatenate([t[i:j], g[i:j].view(np.uint64)]).tobytes() if b[i] < 0 else (t[i:j] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + g[i:j].tobytes() for i, j in zip(cut, ends, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(b[cut]), pa.array(pay, pa.binary())], names=["bucket", "payload"])

        for rows in X.slices(batches, "text"):
            for _, x in _sets(rows, k):
                if not len(x):
                    continue
                g = _digest(x)
                if g in seen:
                    continue
                seen.add(g)
                s = len(x)
                p = s - need(s, num, den) + 1
                i = np.minimum(np.searchsorted(hot, x), max(len(hot) - 1, 0))
                is_hot = hot[i] == x if len(hot) else np.zeros(s, bool)
                if is_hot[: p + 1].any():  # frequent ones go last, the most frequent at the very end
                    cold = x[~is_hot]
                    h, w = x[is_hot], i[is_hot]
                    h_o = np.lexsort((h, rank[w]))
                    x = np.concatenate([cold, h[h_o]])
                    count = np.concatenate([np.zeros(len(cold), np.int64), size[w[h_o]]])
                else:
                    count = np.zeros(s, np.int64)
                if s <= boundary and s > 1:
                    a, b = np.triu_indices(p + 1, 1)
                    toks.append(X.mix(x[a] * X._MULT[50] + x[b] * X._MULT[51]))
                    salts.append(-(-np.minimum(count[a], count[b]) // LIST))
                    owners.append(np.full(len(a), g, np.int64))
                    held += len(a)
                if s * den > boundary * num:
                    toks.append(x[:p])
                    salts.append(-(-count[:p] // LIST))
                    owners.append(np.full(p, g, np.int64))
                    held += p
            if held >= 500_000:
                yield flush()
                held = 0
        if held:
            yield flush()

    return run


def _lists(table: pa.Table) -> pa.Table:
    """One bucket: its keys held by two sets or more, keys with equal lists once, as (key, packed list)."""
    bucket = table.column("bucket")[0].as_py()
    width = 16 if bucket < 0 else 12
    t, g = [], []
    for v in table.column("payload"):
        raw = v.as_buffer()
        n = len(raw) // width
        t.append(np.frombuffer(raw, np.uint64 if bucket < 0 else np.uint32, n).astype(np.uint64))
        g.append(np.frombuffer(raw, np.int64, n, len(raw) - 8 * n) if bucket >= 0 else np.frombuffer(raw, np.int64, n, 8 * n))
    t, g = np.concatenate(t), np.concatenate(g)
    o = np.argsort(t)
    t, g = t[o], g[o]
    new = np.append(True, t[1:] != t[:-1])
    twice = ~new | np.append(~new[1:], False)
    if bucket >= 0:
        t, g = t[twice], g[twice]
    o = np.lexsort((g, t))
    t, g = t[o], g[o]
    if len(t):
        keep = np.append(True, (t[1:] != t[:-1]) | (g[1:] != g[:-1]))
        t, g = t[keep], g[keep]
    cut = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else np.zeros(0, np.int64)
    end = np.append(cut[1:], len(t))
    keys, packs, heads, done = [], [], [], set()
    if len(cut):
        same = np.add.reduceat(X.mix(g.view(np.uint64)), cut)
        order = X.mix(g.view(np.uint64))
        for i, j, h in zip(cut, end, same.view(np.int64), strict=True):
            if bucket >= 0 and (j - i < 2 or int(h) in done):
                continue
            done.add(int(h))
            for a in range(i, j, LIST):
                b = min(a + LIST, j)
                # A salted key's lists meet again by key; others are whole, and known by their first member.
                keys.append(int(t[i].view(np.int64)) if bucket < 0 or j - i > LIST else None)
                heads.append(int(g[a + int(np.argmin(order[a:b]))]))
                packs.append(g[a:b].tobytes())
    return pa.table({"key": pa.array(keys, pa.int64()), "head": pa.array(heads, pa.int64()), "gs": pa.array(packs, pa.binary())})


def _first_star(batches):
    """(a, b): every member of a list with the list's first by hash; repeats within a batch are left out."""
    for batch in batches:
        out = []
        for r, v in zip(np.asarray(batch.column(0)), batch.column(1), strict=True):
            m = np.frombuffer(v.as_buffer(), np.int64)
            m = m[m != r]
            out.append(np.stack([np.minimum(m, r), np.maximum(m, r)], 1))
        if out:
            p = np.unique(np.concatenate(out), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])


def _unpack(batches):
    """(head, g, large) of lists whose members are not all compared yet; a whole list's first member is."""
    for batch in batches:
        parts = []
        for key, r, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            m = np.frombuffer(v.as_buffer(), np.int64)
            if key is None:
                m = m[m != r]
                if len(m) < 2:
                    continue
            parts.append(np.stack([np.full(len(m), r if key is None else key), m, np.full(len(m), int(len(m) >= LARGE))], 1))
        if parts:
            p = np.unique(np.concatenate(parts), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(p[:, 2] > 0)], names=["head", "g", "large"])


def _matrix(bits: list[bytes], at: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps of the rows at `at`, folded to `size` bytes, as 64-bit words."""
    m = np.frombuffer(b"".join(bits[i] for i in at), np.uint64).reshape(len(at), -1)
    while m.shape[1] * 8 > size:
        h = m.shape[1] // 2
        m = m[:, :h] ^ m[:, h:]
    return m


def _cross(ga, na, ca, ba, gb, nb, cb, bb, num: int, den: int, most: int | None):
    """Pairs of different classes between two blocks that sizes and bitmaps let through; most: each row's nearest only."""
    la, lb = np.array([len(x) for x in ba]), np.array([len(x) for x in bb])
    for x in np.unique(la):
        i = np.flatnonzero(la == x)
        for y in np.unique(lb[(lb >= x // 2) & (lb <= 2 * x)]):
            j = np.flatnonzero(lb == y)
            size = int(min(x, y))
            a, b = _matrix(ba, i, size), _matrix(bb, j, size)
            step = max(1, (1 << 20) // (len(j) * a.shape[1]))
            for k in range(0, len(i), step):
                r = i[k : k + step]
                diff = np.bitwise_count(a[k : k + step, None, :] ^ b[None]).sum(2, dtype=np.int32)
                m, n = na[r][:, None], nb[j][None]
                ok = (diff * (den + num) <= (m + n) * (den - num)) & (ca[r][:, None] != cb[j][None]) & (m * den >= n * num) & (n * den >= m * num)
                if most is not None and ok.shape[1] > most:
                    cost = np.where(ok, diff, np.iinfo(np.int32).max)
                    keep = np.argpartition(cost, most, 1)[:, :most]
                    near = np.zeros_like(ok)
                    np.put_along_axis(near, keep, True, 1)
                    ok &= near
                p, q = np.nonzero(ok)
                if len(p):
                    yield ga[r[p]], gb[j[q]]


def _blocks(num: int, den: int, most: int | None = None):
    """Rows of one block x, or of two blocks x and y of one list (members g, n, comp, bits) -> pairs to verify."""

    def run(batches):
        for batch in batches:
            found: list[np.ndarray] = []
            for row in range(batch.num_rows):
                side = []
                for x in "xy" if "y" in batch.schema.names else "xx":
                    v = batch.column(batch.schema.get_field_index(x))[row].values
                    g, n, c = (np.asarray(v.field(f)) for f in ("g", "n", "comp"))
                    side += [g, n.astype(np.int64), c, v.field("bits").to_pylist()]
                found += [np.stack([np.minimum(a, b), np.maximum(a, b)], 1) for a, b in _cross(*side, num, den, most)]
            if found:
                pairs = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def _verify(k: int, num: int, den: int):
    def run(batches):
        for batch in X.slices(batches, "ta", X.SLICE_BYTES // 2):
            for rows in X.slices([batch], "tb", X.SLICE_BYTES // 2):
                sides = []
                for col in ("ta", "tb"):
                    one = pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index(col))], names=["text"])
                    sides.append([x for _, x in _sets(one, k)])
                ok = []
                for x, y in zip(*sides, strict=True):
                    common = 0
                    if len(x) and len(y):
                        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                        common = int((y[at] == x).sum())
                    ok.append(den * common >= num * (len(x) + len(y) - common) > 0)
                keep = pa.array(ok, pa.bool_())
                yield rows.select(["a", "b"]).filter(keep)

    return run


def _own_texts(k: int):
    """Rows (g, text) whose text has the set g: where rows share a doc_id, others come along."""

    def run(batches):
        for rows in X.slices(batches, "text"):
            want = rows.column(rows.schema.get_field_index("g")).to_pylist()
            yield rows.filter(pa.array([len(x) > 0 and _digest(x) == want[i] for i, x in _sets(rows, k)], pa.bool_()))

    return run


def _regrouped(joined: DataFrame) -> DataFrame:
    """joined (head, g, large) with connected large lists as one, where the square of their union is below the sum of their squares.

    A list is large as a whole when one of its parts is: the small parts of a frequent key's list move
    with the others, so that all pairs of the list are still compared.  Lists are linked through the
    members they share, each member linking its lists to the first of them, so that the graph is one
    of lists, not of members.
    """
    large = joined.join(joined.where("large").select("head").distinct(), "head", "left_semi")
    of_g = stage(large.groupBy("g").agg(F.min("head").alias("first"), F.collect_set("head").alias("heads")), "members")  # a member has a prefix of lists
    if not of_g.head(1):
        return joined.select("head", "g")
    links = of_g.select(F.col("first").alias("a"), F.explode("heads").alias("b")).where("a <> b").distinct()
    comp = stage(components(links).select(F.col("g").alias("head"), "comp"), "lists")
    size = large.groupBy("head").agg(F.count("*").alias("m")).join(comp, "head", "left").select("head", "m", F.coalesce("comp", "head").alias("comp"))
    size = stage(size, "sizes")
    union = of_g.select("g", F.col("first").alias("head")).join(comp, "head", "left").select(F.coalesce("comp", "head").alias("head"), "g")
    cost = size.groupBy("comp").agg(F.sum(F.col("m") * F.col("m")).alias("q"), F.count("*").alias("lists")).where("lists > 1").select(F.col("comp").alias("head"), "q")
    pays = union.groupBy("head").agg(F.count("*").alias("n")).join(cost, "head").where(F.col("n") * F.col("n") <= F.col("q")).select("head")
    pays = stage(pays, "pays")
    gone = size.join(pays.select(F.col("head").alias("comp")), "comp").select("head")
    return stage(joined.join(gone, "head", "left_anti").select("head", "g").union(union.join(pays, "head").select("head", "g")), "regrouped")


@scoped
def near_duplicates(docs: DataFrame, k: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links): documents linked at Jaccard num/den or more over k-word shingles.

    component_id is the smallest doc_id reachable by links. Exact, but for 64-bit hash collisions.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = stage(text.mapInArrow(_scan(k, num, den), "kind int, a long, b long, c long, d long, e long, bits binary"), "scan")
    sets = first.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n"), F.col("c").alias("g"))
    bins = first.where("kind = 2").groupBy("a").agg(*[F.sum(c).alias(c) for c in "bcde"]).collect()  # one row for each size bin
    n_docs = sets.count()
    hot_rows = (
        first.where("kind = 1").groupBy("a").agg(F.sum("b").alias("b")).where(F.col("b") >= max(HOT_LEAST, HOT_SHARE * n_docs)).orderBy(F.desc("b"), "a").limit(HOT_MOST).toPandas()
    )  # at most HOT_MOST; the order is free, so that this bound drops no link
    hot = hot_rows["a"].to_numpy(np.int64).view(np.uint64)
    o = np.argsort(hot)
    hot_b = spark.sparkContext.broadcast((hot[o], hot_rows["b"].to_numpy(np.int64)[o]))
    boundary = _boundary(bins)
    postings = sum((r.d if BINS[r.a] <= boundary else 0) + (r.c if BINS[r.a] > 0.7 * boundary else 0) for r in bins)
    n_buckets = max(16, math.ceil(postings * 12 / BUCKET_BYTES))
    packed = text.mapInArrow(_post(k, num, den, hot_b, boundary, n_buckets), "bucket long, payload binary")
    lists = stage(packed.groupBy("bucket").applyInArrow(_lists, "key long, head long, gs binary"), "lists")
    # One row for each distinct set: its size, bitmap and one document.
    info = stage(
        first.where("kind = 0 and b > 0").groupBy(F.col("c").alias("g")).agg(F.min(F.struct(F.col("a").alias("doc_id"), F.col("b").alias("n"), "bits")).alias("i")).select("g", "i.*"), "info"
    )
    near = (F.col("na") * den >= F.col("nb") * num) & (F.col("nb") * den >= F.col("na") * num)

    def side(x: str) -> DataFrame:
        return info.select(F.col("g").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits_{x}"))

    def close(pairs: DataFrame) -> DataFrame:
        """Pairs that pass the lossless filters on sizes and bitmaps."""
        return pairs.join(side("b"), "b").join(side("a"), "a").where(near).mapInArrow(_close(num, den), "a long, b long")

    def verified(pairs: DataFrame) -> DataFrame:
        """pairs: a staged table of pairs that passed close()."""
        ids = pairs.select(F.col("a").alias("g")).union(pairs.select(F.col("b").alias("g"))).distinct().join(info.select("g", "doc_id"), "g")
        ids = stage(ids, "ids")
        few = ids.count() <= BROADCAST_IDS
        part = text.join(F.broadcast(ids) if few else ids, "doc_id").select("g", "text").mapInArrow(_own_texts(k), "g long, text string")
        part = stage(part.dropDuplicates(["g"]), "texts")
        a, b = part.select(F.col("g").alias("a"), F.col("text").alias("ta")), part.select(F.col("g").alias("b"), F.col("text").alias("tb"))
        return pairs.join(b, "b").join(a, "a").select("a", "b", "ta", "tb").mapInArrow(_verify(k, num, den), "a long, b long").distinct()

    pairs = stage(close(lists.select("head", "gs").mapInArrow(_first_star, "a long, b long").distinct()), "pairs")
    links = stage(verified(pairs), "links")
    comp = components(links)
    # Joined lists that still hold more than one class, in blocks of bounded size.
    joined = lists.mapInArrow(_unpack, "head long, g long, large boolean").groupBy("head", "g").agg(F.max("large").alias("large"))
    joined = _regrouped(stage(joined, "joined"))

    def tried(classes: DataFrame, least: int, most: int | None) -> DataFrame:
        """Pairs of different classes in joined lists of `least` members or more that pass the filters."""
        named = joined.join(classes, "g", "left").join(info.select("g", "n"), "g").select("head", "g", "n", F.coalesce("comp", "g").alias("comp"))
        # A bitmap takes a quarter of a byte for each shingle at most, and 8 bytes at least.
        weight = F.sum(F.greatest(F.col("n") / 4, F.lit(8.0)))
        counts = named.groupBy("head").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m"), weight.alias("w"))
        blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("w") / BLOCK_BYTES)).alias("blocks")
        open_lists = stage(counts.where((F.col("lo") != F.col("hi")) & (F.col("m") >= least)).select("head", blocks), "open")
        rest = named.drop("n").join(open_lists, "head").join(info.select("g", "n", "bits"), "g")
        member = F.collect_list(F.struct("g", "n", "comp", "bits")).alias("x")
        small = rest.where("blocks = 1").groupBy("head").agg(member).select("x").mapInArrow(_blocks(num, den, most), "a long, b long")
        if not open_lists.where("blocks > 1").head(1):
            return small.distinct()
        block = F.pmod(F.xxhash64("g"), F.col("blocks")).alias("block")
        blocks = stage(rest.where("blocks > 1").groupBy("head", block).agg(member), "blocks")
        other = blocks.select("head", F.col("block").alias("to"), F.col("x").alias("y"))
        large = blocks.join(other, "head").where("block <= to").select("x", "y").mapInArrow(_blocks(num, den, most), "a long, b long")
        return small.union(large).distinct()

    heavy = joined.groupBy("head").agg(F.count("*").alias("m")).where(F.col("m") >= LARGE).agg(F.sum(F.col("m") * F.col("m"))).first()[0] or 0
    for least, most in ((LARGE, NEAREST), (2, None)) if heavy > LARGE_PAIRS * n_docs else ((2, None),):
        more = stage(tried(comp, least, most).join(pairs, ["a", "b"], "left_anti"), "pairs")
        links = links.union(stage(verified(more), "links"))
        pairs = pairs.union(more)
        comp = components(links)
    ends = links.select(F.col("a").alias("g")).union(links.select(F.col("b").alias("g"))).groupBy("g").agg(F.count("*").alias("n_links"))
    named = sets.where("n > 0").join(comp, "g", "left").select("doc_id", "n", "g", F.coalesce("comp", "g").alias("comp"))
    least = stage(named.groupBy("comp").agg(F.min("doc_id").alias("component_id")), "least")
    linked = named.join(ends, "g", "left").join(least, "comp").select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    alone = sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return stage(linked.union(alone), "classes")


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
