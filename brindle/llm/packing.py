"""Best-fit packing of tokenised documents by a configuration linear program.

Tokens: byte-level BPE of a public tokenizer file (a parameter).  Words are cut by the file's own
pre-tokenizer rule, vectorised over code points; each distinct word is encoded once by the
`tokenizers` library and looked up after that.  Texts for which the rule is not vectorised (an
apostrophe, or code points beyond the tables) go through the library whole, so ids are always its.

Packing: documents count only by length, so the demand is a histogram of at most `size` lengths
(bounded, on the driver).  The configuration LP  min sum x_c  s.t.  sum_c x_c n_c(l) >= d(l)  is
solved by multiplicative weights: each round prices lengths by their weights, a knapsack dynamic
program finds the best configurations at these prices (the best of all, and the best with each of
the lengths that are covered least), and the weights of lengths fall exponentially with their cover.
The configurations of all rounds are averaged.  Every round's prices also give a lower bound of the
LP, sum d y / V(y), so that the gap is known.  The average, scaled to stay within the demand, is
rounded: down first, then up in order of size while the demand lasts, for configurations without
slack at the best prices; what is left is solved again, and the last remainder is placed best fit,
longest first.  Should best fit alone need fewer sequences, its plan is taken.

Full pieces are a sequence each.  Every other piece finds its sequence and offset from its rank
within its length, which is counted over salted groups of about GROUP rows, as many as the length's
count asks for: no task holds a whole length.

Defined results: null text counts as empty and gives one piece of one token, the end mark;
repeated rows give repeated pieces, each with a place of its own; a null doc_id stays null; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as X
from ._store import small_batches, stage

SIZE = 2048
GROUP = 500_000  # rows of a length that are ranked in one task
SLOTS, WIDE = 1 << 20, 8  # distinct words that a worker keeps, and their most ids
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _ragged(first: np.ndarray, num: np.ndarray) -> np.ndarray:
    """first[i], first[i]+1, ... for num[i] places each."""
    ends = np.cumsum(num)
    return np.repeat(first - (ends - num), num) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Ids of texts, equal to the library's; words are encoded once."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.one = self._merger(path)
        top = 0x2000  # code points above it go to the library
        text = "".join(map(chr, range(top)))
        kind = np.full(top, 3, np.uint8)
        for n, p in ((0, r"\s"), (1, r"\p{L}"), (2, r"\p{N}")):
            kind[[m.start() for m in regex.finditer(p, text)]] = n
        self.kind = kind
        unsure = np.zeros(top + 1, bool)
        unsure[[m.start() for m in regex.finditer(r"\p{Cn}", text)]] = True
        unsure[[ord("'"), 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0x180E, top]] = True
        self.unsure, self.top = unsure, top
        self.clear()

    def _merger(self, path: str):
        """Ids of one word (bytes): the same merges through tiktoken, whose call for a single word is cheap."""
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        # The printable stand-ins of bytes in a byte-level vocabulary, by their published rule.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))}
        ranks = {bytes(back[c] for c in w): i for w, i in vocab.items() if all(c in back for c in w)}
        core = tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})._core_bpe
        return core.encode_single_piece

    def clear(self) -> None:
        self.key = np.zeros(SLOTS, np.uint64)
        self.ids = np.zeros((SLOTS, WIDE), np.uint32)
        self.n = np.zeros(SLOTS, np.uint8)

    def lookup(self, h: np.ndarray, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids in a row, first and count for each distinct word; a slot holds the word that came last."""
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        miss = np.flatnonzero(self.key[slot] != h)
        num = self.n[slot].astype(np.int64)
        got = [self.one(t.encode()) for t in texts(miss)] if len(miss) else []
        num[miss] = [len(g) for g in got]
        first = np.cumsum(num) - num
        flat = np.zeros(int(num.sum()), np.uint32)
        hit = np.ones(len(h), bool)
        hit[miss] = False
        for w in range(WIDE):
            i = np.flatnonzero(hit & (num > w))
            flat[first[i] + w] = self.ids[slot[i], w]
        if got:
            at = _ragged(first[miss], num[miss])
            flat[at] = np.fromiter((x for g in got for x in g), np.uint32, len(at))
            small = miss[num[miss] <= WIDE]
            s = slot[small]
            self.key[s], self.n[s] = h[small], num[small]
            for w in range(WIDE):
                i = small[num[small] > w]
                self.ids[slot[i], w] = flat[first[i] + w]
            # of two new words in one slot the last one wins in every array, as they are written in order
        return flat, first, num

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and each text's first (length n+1)."""
        cp, off = X.code_points(data, offsets)
        n = len(off) - 1
        odd = np.zeros(n, bool)
        if len(cp):
            bad = self.unsure[np.minimum(cp, self.top)]
            sums = np.concatenate([[0], np.cumsum(bad)])
            odd = sums[off[1:]] > sums[off[:-1]]
            odd |= self._special(data, offsets)
        own: dict[int, np.ndarray] = {}
        if odd.any():
            at = np.flatnonzero(odd)
            texts = [data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in at]
            own = {int(i): np.array(e.ids, np.uint32) for i, e in zip(at, self.tok.encode_batch_fast(texts, add_special_tokens=False), strict=True)}
            keep = np.repeat(~odd, np.diff(off))
            cp = cp[keep]
            lens = np.where(odd, 0, np.diff(off))
            off = np.concatenate([[0], np.cumsum(lens)])
        ids, counts = self._words(cp, off, n)
        if own:
            parts, new, a = [], counts.copy(), np.concatenate([[0], np.cumsum(counts)])
            last = 0
            for i, x in own.items():
                parts += [ids[last : a[i]], x]
                last = a[i]
                new[i] = len(x)
            ids, counts = np.concatenate([*parts, ids[last:]]), new
        return ids, np.concatenate([[0], np.cumsum(counts)])

    @staticmethod
    def _special(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts with '<|', which may start a special token."""
        hit = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)) if len(data) > 1 else np.zeros(0, np.int64)
        out = np.zeros(len(offsets) - 1, bool)
        out[np.searchsorted(offsets, hit, "right") - 1] = True
        return out

    def _words(self, cp: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        if not len(cp):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        c = self.kind[cp]
        heads = off[:-1][off[:-1] < off[1:]]
        first = np.zeros(len(cp) + 1, bool)
        first[heads] = True
        first[-1] = True
        start = first[:-1].copy()
        start[1:] |= c[1:] != c[:-1]
        last = np.zeros(len(cp), bool)  # the last space before a word of the same text
        last[:-1] = (c[:-1] == 0) & (c[1:] != 0) & ~first[1:-1]
        start |= last
        j = np.flatnonzero(last & (cp == 32))
        start[j + 1] = False
        s = np.flatnonzero(start)
        e = np.append(s[1:], len(cp))
        pos = np.arange(len(cp)) - np.repeat(s, e - s)
        w = X._POW[pos & (X._POW_LEN - 1)] + (pos >> 12).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C16)
        h = X.mix(np.add.reduceat((cp.astype(np.uint64) + np.uint64(1)) * w, s) + (e - s).astype(np.uint64) * X._MULT[0])
        u, where, inv = np.unique(h, return_index=True, return_inverse=True)
        text: list[str] = []

        def texts(miss):
            text.append(cp.tobytes().decode("utf-32-le"))
            a, b = s[where[miss]].tolist(), e[where[miss]].tolist()
            return [text[0][x:y] for x, y in zip(a, b, strict=True)]

        flat, word_first, word_n = self.lookup(u, texts)
        num = word_n[inv]
        ends = np.cumsum(num)
        ids = flat[_ragged(word_first[inv], num)]
        upto = np.concatenate([[0], ends])
        word_at = np.searchsorted(s, off)
        return ids, np.diff(upto[word_at])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, path: str, size: int = SIZE, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and the end mark, cut to at most size."""

    def run(batches):
        enc = encoder(path)
        for rows in X.slices(batches, "text"):
            ids, first = enc.encode(*X.utf8(rows.column(1)))
            out = []
            for i in range(rows.num_rows):
                x = np.append(ids[first[i] : first[i + 1]], np.uint32(end_id)).astype("<u4")
                a, k = 0, 0
                b = len(x) % size or size
                while a < len(x):
                    out.append((i, k, a, b - a, zlib.crc32(x[a:b].tobytes())))
                    a, b, k = b, b + size, k + 1
            t = np.array(out, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(pa.array(t[:, 0])), pa.array(t[:, 1].astype(np.int32)), *[pa.array(t[:, c]) for c in (2, 3, 4)]],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECE)


class Knapsack:
    """Unbounded knapsack at given values: for every room the configuration of the most value that fits."""

    def __init__(self, value: np.ndarray, lengths: np.ndarray, size: int):
        """lengths in rising order."""
        self.lengths, self.size = lengths, size
        self.best, self.pick = np.zeros(size + 1), np.full(size + 1, -1)
        best, pick = self.best, self.pick
        fit = np.searchsorted(lengths, np.arange(size + 1), "right")
        for cap in range(int(lengths[0]), size + 1):
            n = fit[cap]
            v = best[cap - lengths[:n]] + value[:n]
            k = int(v.argmax())
            best[cap] = best[cap - 1]
            if v[k] > best[cap] + 1e-15:
                best[cap], pick[cap] = v[k], k

    def within(self, room: int) -> dict[int, int]:
        """The best configuration of at most `room`, as {index of a length: copies}."""
        got: dict[int, int] = {}
        while room > 0:
            i = int(self.pick[room])
            if i < 0:
                room -= 1
                continue
            got[i] = got.get(i, 0) + 1
            room -= int(self.lengths[i])
        return got

    def with_one(self, i: int) -> dict[int, int]:
        """The best configuration that holds length i."""
        got = self.within(self.size - int(self.lengths[i]))
        got[i] = got.get(i, 0) + 1
        return got


def solve_lp(lengths: np.ndarray, demand: np.ndarray, size: int, rounds: int = 60, eps: float = 1.0, lean: float = 0.02, near: float = 0.1, most: int = 128) -> tuple[list[tuple[dict[int, int], float]], float, np.ndarray]:
    """Multiplicative weights for the configuration LP: ([(configuration, amount)], lower bound, its prices).

    lengths in rising order.  The amounts are averages, scaled so that no length is covered more than
    once.  The prices start at length / size, the size bound, which is feasible and, where sequences
    can be filled, optimal; they lean a little to long pieces, as short ones are worth more in gaps.
    A step takes a configuration as often as its scarcest length's demand allows, times the step
    width, which falls with the rounds; a round takes the best one, and of the best ones with each of
    the `most` least covered lengths those within `near` of it, but none whose lengths the round has
    covered.  The bound is the best over the rounds' prices and their averages.
    """
    cover = np.zeros(len(lengths))
    amount: dict[tuple, float] = {}
    plain = lengths / size
    bound, prices, mean = float(demand @ plain), plain, np.zeros(len(lengths))

    def told(y: np.ndarray, top: float):
        nonlocal bound, prices
        if float(demand @ y) / top > bound + 1e-9:
            bound, prices = float(demand @ y) / top, y / top

    for r in range(rounds):
        width = 1 / (1 + r / 8)
        y = plain ** (1 + lean) * np.exp(-eps * (cover - cover.min()))
        k = Knapsack(y, lengths, size)
        top = float(k.best[size])
        told(y, top)
        mean += y / top * width
        before = cover.copy()
        for i in [-1, *(int(i) for i in np.argsort(cover, kind="stable")[:most])]:
            if i >= 0 and (cover[i] > before[i] or k.best[size - int(lengths[i])] + y[i] < (1 - near) * top):
                continue
            c = k.within(size) if i < 0 else k.with_one(i)
            j, m = np.fromiter(c, np.int64), np.fromiter(c.values(), float)
            if (cover[j] > before[j] + width).any():
                continue
            step = width * float((demand[j] / m).min())
            cover[j] += step * m / demand[j]
            key = tuple(sorted(c.items()))
            amount[key] = amount.get(key, 0.0) + step
        if r % 20 == 19 or r == rounds - 1:
            told(mean, float(Knapsack(mean, lengths, size).best[size]))
    scale = float(cover.max()) or 1.0
    return [(dict(c), x / scale) for c, x in amount.items()], bound, prices


def best_fit(lengths: np.ndarray, demand: np.ndarray, size: int) -> list[tuple[dict[int, int], int]]:
    """Best fit, longest first, over a histogram: groups of equal sequences are filled together."""
    from collections import defaultdict

    room: dict[int, list[list]] = defaultdict(list)
    for i in np.argsort(-lengths):
        length, left = int(lengths[i]), int(demand[i])
        for r in sorted(x for x in room if x >= length):
            for group in list(room[r]):
                if not left:
                    break
                cfg, count = group
                m = min(r // length, max(1, left // count))
                use = min(count, left // m)
                if not use:
                    continue
                group[1] -= use
                if not group[1]:
                    room[r].remove(group)
                room[r - m * length].append([{**cfg, int(i): cfg.get(int(i), 0) + m}, use])
                left -= m * use
            if not left:
                break
        if left:
            m = size // length
            if left // m:
                room[size - m * length].append([{int(i): m}, left // m])
            if left % m:
                room[size - (left % m) * length].append([{int(i): left % m}, 1])
    return [(c, n) for groups in room.values() for c, n in groups if n]


def lower_bound(hist: dict[int, int], size: int = SIZE, rounds: int = 60) -> int:
    """No packing of the histogram has fewer sequences: the LP's dual bound, rounded up."""
    full = hist.get(size, 0)
    lengths = np.array(sorted(k for k, v in hist.items() if v > 0 and k != size), np.int64)
    if not len(lengths):
        return full
    return full + int(np.ceil(solve_lp(lengths, np.array([hist[int(x)] for x in lengths], float), size, 3 * rounds)[1] - 1e-6))


def rounded_lp(hist: dict[int, int], size: int = SIZE, rounds: int = 60, near: float = 0.1, passes: int = 12) -> list[tuple[dict[int, int], int]]:
    """The plan by the LP: solved, rounded within the demand, and solved again for what is left; best fit for the end."""
    out: list[tuple[dict[int, int], int]] = []
    left = {k: v for k, v in hist.items() if v > 0}
    for _ in range(passes):
        if not left:
            return out
        lengths = np.array(sorted(left), np.int64)
        demand = np.array([left[int(x)] for x in lengths], np.int64)
        found, _, prices = solve_lp(lengths, demand.astype(float), size, rounds, near=near)
        served = 0
        for way in (np.floor, np.ceil):
            for c, x in sorted(found, key=lambda f: -f[1]):
                i, m = np.fromiter(c, np.int64), np.fromiter(c.values(), np.int64)
                n = int(min(way(x), (demand[i] // m).min()))
                if n > 0 and float(prices[i] @ m) > 1 - 1e-9:
                    out.append(({int(lengths[a]): int(b) for a, b in zip(i, m, strict=True)}, n))
                    demand[i] -= n * m
                    served += n
        left = {int(a): int(b) for a, b in zip(lengths, demand, strict=True) if b}
        if not served:
            break
    if left:
        lengths = np.array(sorted(left), np.int64)
        rest = best_fit(lengths, np.array([left[int(x)] for x in lengths]), size)
        out += [({int(lengths[i]): m for i, m in c.items()}, n) for c, n in rest]
    return out


def plan(hist: dict[int, int], size: int = SIZE, rounds: int = 60) -> list[tuple[dict[int, int], int]]:
    """[(configuration {length: copies}, sequences)] that serves the histogram exactly: the rounded LP, or best fit where that needs fewer.

    The LP is rounded from wide rounds (any configuration with a little covered length) and, unless
    those reach the lower bound, from narrow ones (only configurations near the best).
    """
    lengths = np.array(sorted(k for k, v in hist.items() if v > 0), np.int64)
    if not len(lengths):
        return []
    count = lambda p: sum(n for _, n in p)
    best = rounded_lp(hist, size, rounds, 1.0)
    if count(best) > -(-sum(k * v for k, v in hist.items()) // size) and count(best) > lower_bound(hist, size, rounds):
        best = min((best, rounded_lp(hist, size, rounds)), key=count)
    by_fit = [({int(lengths[i]): m for i, m in c.items()}, n) for c, n in best_fit(lengths, np.array([hist[int(x)] for x in lengths]), size)]
    return min((best, by_fit), key=count)


def pack(cut: DataFrame, size: int = SIZE, rounds: int = 60) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32)."""
    cut = stage(cut, "pieces")
    spark = cut.sparkSession
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    # One sequence each; the place of a row in the written table is a number that a task made anew finds again.
    full = cut.where(F.col("length") == size).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    cut = cut.where(F.col("length") < size)
    hist = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # fewer than size rows
    salts = spark.createDataFrame([(k, -(-n // GROUP)) for k, n in hist.items()], "length long, salts long")
    salted = cut.join(F.broadcast(salts), "length").select(*columns, F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts")).cast("int").alias("salt"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).toPandas()  # a row for some GROUP pieces, and one for a length at least
    before: dict[int, np.ndarray] = {}
    for k, g in counts.groupby("length"):
        n = np.zeros(int(g["salt"].max()) + 1, np.int64)
        n[g["salt"].to_numpy()] = g["n"].to_numpy()
        before[int(k)] = np.concatenate([[0], np.cumsum(n)[:-1]])
    slots: dict[int, list] = {}
    base = 0
    for cfg, n in plan(hist, size, rounds):
        at = 0
        for length in sorted(cfg, reverse=True):
            slots.setdefault(length, []).append((n * cfg[length], base, cfg[length], at))
            at += length * cfg[length]
        base += n
    tables = {k: (np.concatenate([[0], np.cumsum([s[0] for s in v])]), *(np.array([s[i] for s in v], np.int64) for i in (1, 2, 3))) for k, v in slots.items()}
    held = spark.sparkContext.broadcast((before, tables))  # bounded: lengths, salts and configurations

    def run(batches):
        before, tables = held.value
        for batch in batches:
            length, salt, rank = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("length", "salt", "rank"))
            seq, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for k in np.unique(length):
                i = np.flatnonzero(length == k)
                ends, first, m, at = tables[int(k)]
                r = before[int(k)][salt[i]] + rank[i] - 1
                p = np.searchsorted(ends, r, "right") - 1
                j = r - ends[p]
                seq[i] = first[p] + j // m[p]
                offset[i] = at[p] + (j % m[p]) * k
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(order).cast("long"))
    return full.union(ranked.select(*columns, "salt", "rank").mapInArrow(run, PIECE + ", sequence_id long, offset long"))


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pack(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer()))
