"""Pairwise dissimilarities: pairs(src, i, j, d) with i < j.

Objects are dealt to blocks of bounded size by a hash; two blocks meet in one row, joined on the
pair of blocks, and a matrix kernel makes all their pairs at once.  The work is quadratic, as the result is; what moves is each
object once for each block, and no task ever holds more than two blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import pack
from .normalize import normalization

BLOCK = 512
WIDE = 16_384  # objects of a source beyond which blocks are four times as large
ROWS = 1 << 17  # rows of a batch
MEASURES = ("tanimoto", "jaccard", "euclidean", "gower", "hamming", "cosine", "cont tanimoto", "chi.squared", "MCA_coord", "l2", "manhattan", "correlation")


def kernel(a: np.ndarray, b: np.ndarray, measure: str, scale: np.ndarray | None = None) -> np.ndarray:
    """All distances between rows of a and b. scale: ranges (gower) or masses (chi.squared) of the columns."""
    if measure in ("tanimoto", "jaccard"):
        ok_a, ok_b = ~np.isnan(a), ~np.isnan(b)
        x, y = np.where(ok_a, a, 0), np.where(ok_b, b, 0)
        both = x @ y.T
        union = x @ ok_b.T.astype(float) + ok_a.astype(float) @ y.T - both  # over the features that both know
        s = np.where(union > 0, both / np.where(union > 0, union, 1), 0.0)
        return 1 - s if measure == "tanimoto" else np.sqrt(np.maximum(1 - s, 0))
    if measure in ("l2", "euclidean_l2"):
        return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))
    if measure == "cosine":
        na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        return 2 * np.arccos(np.clip(a @ b.T / np.maximum(na[:, None] * nb[None], 1e-300), -1, 1)) / np.pi
    if measure == "cont tanimoto":
        dot = a @ b.T
        return 1 - dot / ((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - dot)
    if measure == "correlation":
        x, y = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
        return 1 - x @ y.T / np.maximum(np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None], 1e-300)
    if measure == "chi.squared":
        x, y = a / np.sqrt(scale), b / np.sqrt(scale)
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0))
    out = np.zeros((len(a), len(b)))
    step = max(1, (1 << 21) // max(1, len(b) * a.shape[1]))
    for k in range(0, len(a), step):
        x, y = a[k : k + step, None, :], b[None]
        if measure == "hamming":
            out[k : k + step] = (x != y).sum(2)
        elif measure == "manhattan":
            out[k : k + step] = np.abs(x - y).sum(2)
        else:  # gower: mean of range-scaled differences over the features that both know; a zero range is unknown
            with np.errstate(invalid="ignore", divide="ignore"):
                v = np.abs(x - y) / scale
            known = ~np.isnan(v)
            n = known.sum(2)
            out[k : k + step] = np.where(n > 0, np.where(known, v, 0).sum(2) / np.maximum(n, 1), np.nan)
    return out


class Tiled:
    """Tiled(v, ...)(y)(x): the kernel's distances of any rows x and y of v, without matrices of features."""

    def __init__(self, v: np.ndarray, how: str, scale: np.ndarray | None = None, places: int | None = None):
        self.how, self.scale, self.places = how, scale, places
        known = np.zeros(0, bool) if how != "gower" or np.isnan(v).any() else ~np.isnan(scale)
        self.n = int(known.sum())  # 0: as the kernel does it
        if self.n:
            self.binary = known & ((v == 0) | (v == scale)).all(0)
            self.rest = known & ~self.binary

    def __call__(self, y: np.ndarray):
        if not self.n:
            return lambda x: self.rounded(kernel(x, y, self.how, self.scale))
        rest, binary = self.rest, self.binary
        z = np.ascontiguousarray((y[:, rest] / self.scale[rest]).T)
        hit = y[:, binary] != 0
        hit_t, many = np.ascontiguousarray(hit.T, dtype=float), hit.sum(1).astype(float)

        def rows(x):
            u, b = x[:, rest] / self.scale[rest], (x[:, binary] != 0).astype(float)
            out = np.zeros((len(x), len(y)))
            if b.shape[1]:  # of features with two values: those that only one has
                np.matmul(b * -2, hit_t, out=out)
                out += b.sum(1)[:, None]
                out += many
            wide = 1024
            one = np.empty((len(x), min(wide, len(y))))
            for q in range(0, len(y), wide):
                o = out[:, q : q + wide]
                t = one[:, : o.shape[1]]
                for f in range(len(z)):
                    np.subtract(u[:, f, None], z[f, None, q : q + wide], out=t)
                    np.abs(t, out=t)
                    o += t
                o /= self.n
                self.rounded(o, o)
            return out

        return rows

    def rounded(self, d: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
        return d if self.places is None else np.round(d, self.places, out=out)


def met_blocks(objects: DataFrame, block: int | None = None, large: bool = False) -> DataFrame:
    """objects(src, obj, x) -> (src, p, q, mp, mq), p <= q: the members of two blocks, in order of their names, in one row.

    An object travels once for each block. Sources of more than WIDE objects have larger blocks, so that
    these copies stay in proportion. Pairs of blocks are dealt over as many tasks as shuffles have.
    large: sources of more than 2 * WIDE have larger ones yet, for what makes no matrix of whole blocks.
    """
    tasks = int(objects.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per = F.when(F.count("*") > WIDE, 4 * BLOCK).otherwise(BLOCK)
    per = F.lit(block) if block else F.when(F.count("*") > 2 * WIDE, 16 * BLOCK).otherwise(per) if large else per
    n = objects.groupBy("src").agg(F.ceil(F.count("*") / per).alias("blocks"))  # one row for each source
    dealt = objects.join(F.broadcast(n), "src").withColumn("b", F.pmod(F.xxhash64("obj"), F.col("blocks")))
    parts = dealt.groupBy("src", "b").agg(F.array_sort(F.collect_list(F.struct("obj", "x"))).alias("m"), F.max("blocks").alias("blocks"))
    # A row for each block pair that a block is in: pairs, not sources, are what the join deals out.
    left = parts.select("src", F.col("b").alias("p"), F.explode(F.sequence(F.col("b"), F.col("blocks") - 1)).alias("q"), F.col("m").alias("mp"))
    right = parts.select("src", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("b"))).alias("p"), F.col("b").alias("q"), F.col("m").alias("mq"))
    keys = ["src", "p", "q"]
    return left.repartition(tasks, *keys).join(right.repartition(tasks, *keys), keys).select(*keys, "mp", "mq")


def each_meeting(objects: DataFrame, run, schema: str, block: int | None = None, large: bool = False) -> DataFrame:
    """run(src, same, names, x, other names, other x) yields record batches for each two blocks that meet; same: a block meets itself."""

    def rows(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                src, p, q = (batch.column(c)[r].as_py() for c in range(3))
                v, w = batch.column(3)[r].values, batch.column(4)[r].values
                yield from run(src, p == q, v.field("obj"), v.field("x"), w.field("obj"), w.field("x"))

    return met_blocks(objects, block, large).mapInArrow(rows, schema)


def meet_blocks(objects: DataFrame, kernel, values: str, block: int | None = None, keep: bool = False, own: bool = False, named: bool = True, large: bool = False) -> DataFrame:
    """objects(src, obj, x) -> (src, i, j, values), i < j: kernel(x of one block, x of another) gives a matrix for each value.

    x reaches the kernel as an Arrow array, one entry for each object of the block.  A kernel that has
    `source` set takes the source's number as well.  keep: the kernel gives one more matrix, that says
    which pairs have a row.  own: objects meet themselves too.  Without `named` a row has its values only.
    large: as `met_blocks` has it; the kernel then gets a part of a block's objects at once, with all of the other's.
    """
    names = [v.split()[0] for v in values.split(", ")]

    def run(src, same, a, x, b, y):
        every, place = np.unique(np.asarray(a.to_pylist() + b.to_pylist(), object), return_inverse=True)
        every, place = pa.array(every, pa.string()), place.astype(np.int32)
        at, to = place[: len(a)], place[len(a) :]
        step = max(1, ROWS // max(1, len(to)))
        part = max(step, step * ((BLOCK << 11) // ROWS)) if large else len(at)
        for k in range(0, len(at), step):
            if k % part == 0:
                some = x.slice(k, part) if large else x
                made = kernel(some, y, src) if getattr(kernel, "source", False) else kernel(some, y)
                made, chosen = (made[:-1], made[-1]) if keep else (made, None)
            cut, within = slice(k, k + step), slice(k % part, k % part + step)
            lo, hi = np.minimum(at[cut, None], to[None]), np.maximum(at[cut, None], to[None])
            use = None if chosen is None else chosen[within]
            if same:
                half = at[cut, None] <= to[None] if own else at[cut, None] < to[None]
                use = half if use is None else use & half
            pick = np.ravel if use is None else (lambda m, use=use: m[use])
            got = [pa.array(pick(m[within])) for m in made]
            if len(got[0]) and named:
                got = [pa.array(np.full(len(got[0]), src, np.int32)), *[every.take(pa.array(pick(m))) for m in (lo, hi)], *got]
            if len(got[0]):
                yield pa.RecordBatch.from_arrays(got, names=["src", "i", "j", *names] if named else names)

    return each_meeting(objects, run, f"src int, i string, j string, {values}" if named else values, block, large)


def largest(objects: DataFrame, kernel, nn: int, block: int | None = None) -> DataFrame:
    """(src, obj, top): of each object the nn largest values of kernel(x, other x) over all others, falling.

    A block of a meeting sends one row for each object with its nn largest there, so that no row is made for a pair.
    """

    def run(src, same, a, x, b, y):
        m = kernel(x, y)
        m[np.isnan(m)] = -np.inf
        if same:
            m[a.to_numpy(False)[:, None] == b.to_numpy(False)[None]] = -np.inf
        for names, side in ((a, m),) if same else ((a, m), (b, m.T)):
            k = min(nn, side.shape[1])
            top = -np.sort(-np.partition(side, side.shape[1] - k, 1)[:, side.shape[1] - k :], 1) if k else side
            has = np.isfinite(top)
            ends = np.concatenate([[0], np.cumsum(has.sum(1))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), src, np.int32)), names, pa.ListArray.from_arrays(pa.array(ends), pa.array(top[has]))], names=["src", "obj", "top"])

    near = each_meeting(objects, run, "src int, obj string, top array<double>", block)
    every = F.sort_array(F.flatten(F.collect_list("top")), False)
    return near.groupBy("src", "obj").agg(F.slice(every, 1, nn).alias("top"))


def block_pairs(objects: DataFrame, measure: str, scales: dict | None = None, block: int | None = None) -> DataFrame:
    """objects(src, obj, x) of equal length by source -> pairs(src, i, j, d)."""
    scales = scales or {}

    def made(a, b, src):
        x, y = (np.asarray(s.flatten(), float).reshape(len(s), -1) for s in (a, b))
        return [kernel(x, y, measure, scales.get(src))]

    made.source = True
    return meet_blocks(objects, made, "d double", block)


def indicators(cells: DataFrame) -> DataFrame:
    """Complete disjunctive coding: a 0/1 feature for each level of each feature."""
    level = cells.select("src", "feat", "val").distinct()
    objs = cells.select("src", "obj").distinct()
    one = cells.select("src", "obj", "feat", "val", F.lit(1.0).alias("hit"))
    full = objs.join(level, "src").join(one, ["src", "obj", "feat", "val"], "left")
    return full.select("src", "obj", F.concat_ws("=", "feat", F.col("val").cast("string")).alias("feat"), F.coalesce("hit", F.lit(0.0)).alias("val"))


def mca_coordinates(cells: DataFrame) -> DataFrame:
    """Multiple correspondence coordinates of factors with more than one level, as cells."""
    many = cells.groupBy("src", "feat").agg(F.countDistinct("val").alias("k")).where("k > 1").select("src", "feat")
    coded = pack(indicators(cells.join(many, ["src", "feat"])))

    def run(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("obj")
        z = np.stack([np.asarray(v, float) for v in pdf["x"]])
        p = z / z.sum()
        r, c = p.sum(1), p.sum(0)
        s = (p - np.outer(r, c)) / np.sqrt(np.outer(r, c))
        u, w, vt = np.linalg.svd(s, full_matrices=False)
        k = int((w > 1e-9).sum())
        f = u[:, :k] * w[:k] / np.sqrt(r)[:, None]
        f = f * np.sign(np.where(vt[:k].sum(1) == 0, 1, vt[:k].sum(1)))[None]
        return pd.DataFrame([(int(key[0]), o, f"dim{j + 1:03d}", float(f[i, j])) for i, o in enumerate(pdf["obj"]) for j in range(k)], columns=["src", "obj", "feat", "val"])

    return coded.groupBy("src").applyInPandas(run, "src int, obj string, feat string, val double")


def prepared(cells: DataFrame, measure: str = "tanimoto", normalize: str | bool | None = None) -> tuple[DataFrame, str, dict]:
    """(objects(src, obj, x), the kernel's measure, its scales by source) of a measure on cells."""
    if measure not in MEASURES:
        raise ValueError(f"unknown measure {measure!r}; one of {', '.join(MEASURES)}")
    if measure in ("euclidean", "cont tanimoto"):
        cells = normalization(cells, normalize)
    scales: dict = {}
    if measure == "MCA_coord":
        cells, measure = mca_coordinates(cells), "gower"
    if measure == "chi.squared":
        coded = indicators(cells)
        total = coded.groupBy("src", "feat").agg(F.sum("val").alias("m"))
        rows = coded.groupBy("src", "obj").agg(F.sum("val").alias("s"))
        prof = coded.join(rows, ["src", "obj"]).select("src", "obj", "feat", (F.col("val") / F.col("s")).alias("val"))
        mass = total.toPandas()  # one number for each level
        for src, g in mass.groupby("src"):
            v = g.sort_values("feat")["m"].to_numpy(float)
            scales[int(src)] = v / v.sum()
        return pack(prof), "chi.squared", scales
    if measure in ("euclidean", "gower"):
        spans = cells.groupBy("src", "feat").agg((F.max("val") - F.min("val")).alias("r")).toPandas()  # one number for each feature
        for src, g in spans.groupby("src"):
            r = g.sort_values("feat")["r"].to_numpy(float)
            scales[int(src)] = np.where(r > 0, r, np.nan)
        measure = "gower"
    return pack(cells), measure, scales


def distance(cells: DataFrame, measure: str = "tanimoto", normalize: str | bool | None = None) -> DataFrame:
    """pairs(src, i, j, d). `euclidean` is Gower's mean of range-scaled differences, `l2` the Euclidean length.

    Normalisation applies to euclidean and cont tanimoto only. made_of says what the pairs are of, for
    what needs a source's matrix in one task (`trees.agglomerate`).
    """
    made = prepared(cells, measure, normalize)
    pairs = block_pairs(*made)
    pairs.made_of = made
    return pairs


def _several(sources) -> tuple[DataFrame, list]:
    """Objects of several sources in one row, x(s, x) by source, and each source's distances between two such blocks."""
    ways, rows = [], None
    for at, (cells, measure) in enumerate(sources):
        objects, how, scales = prepared(cells, measure)
        ways.append((how, next(iter(scales.values()), None)))
        one = objects.select("obj", F.struct(F.lit(at).alias("s"), "x").alias("x"))
        rows = one if rows is None else rows.union(one)
    packed = rows.groupBy("obj").agg(F.array_sort(F.collect_list("x")).alias("x")).select(F.lit(0).alias("src"), "obj", "x")

    def side(m, at: int) -> tuple[np.ndarray, np.ndarray]:
        flat = m.flatten()
        own = np.asarray(flat.field("s")) == at
        x = flat.field("x").filter(pa.array(own))
        return np.repeat(np.arange(len(m)), np.diff(np.asarray(m.offsets)))[own], np.asarray(x.flatten(), float).reshape(len(x), -1)

    def per_source(a, b):
        """For each source the rows and columns that have it, and their distances."""
        for at, (how, scale) in enumerate(ways):
            (i, x), (j, y) = side(a, at), side(b, at)
            if len(i) and len(j):
                yield at, np.ix_(i, j), kernel(x, y, how, scale)

    return packed, per_source


def joint_distances(sources, named: bool = True) -> DataFrame:
    """(src = 0, i, j, d1, d2, ...) of [(cells of one source, measure), ...]: all distances of a pair in one row, where every source has both objects."""
    packed, per_source = _several(sources)
    n = len(sources)

    def run(a, b):
        out, seen = [np.zeros((len(a), len(b))) for _ in range(n)], np.zeros((len(a), len(b)), np.int8)
        for at, ix, d in per_source(a, b):
            out[at][ix] = d
            seen[ix] += 1
        return [*out, seen == n]

    return meet_blocks(packed, run, ", ".join(f"d{k + 1} double" for k in range(n)), keep=True, named=named)


def combined_distances(sources, weights) -> DataFrame:
    """pairs(src = 0, i, j, d) of [(cells of one source, measure), ...]: as weighted_combination of their distances, made pair by pair, so that none is moved."""
    packed, per_source = _several(sources)
    share = [float(w) / float(sum(weights)) for w in weights]

    def run(a, b):
        out, seen = np.zeros((len(a), len(b))), np.zeros((len(a), len(b)), bool)
        for at, ix, d in per_source(a, b):
            out[ix] += share[at] * d
            seen[ix] = True
        return [out, seen]

    return meet_blocks(packed, run, "d double", keep=True, large=True)


def distance_v2(cells: DataFrame, measure: str = "tanimoto", normalize=None) -> DataFrame:
    """The same under its other name."""
    return distance(cells, measure, normalize)


def mirrored(pairs: DataFrame) -> DataFrame:
    """Both directions of every pair."""
    return pairs.union(pairs.select("src", F.col("j").alias("i"), F.col("i").alias("j"), "d"))


def weighted_combination(pairs: DataFrame, weights: dict[int, float]) -> DataFrame:
    """pairs(src = 0, i, j, d): sum of the sources' distances times their weights, scaled to 1."""
    total = float(sum(weights.values()))
    w = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (int(k), float(v) / total)])
    return pairs.groupBy("i", "j").agg(F.sum(F.col("d") * F.element_at(w, F.col("src"))).alias("d")).select(F.lit(0).alias("src"), "i", "j", "d")
