"""HTML main text by equivalence-class template deduction.

Tokens of a page are its block elements' tags, each told apart by the path of elements (with class,
id and role) that leads to it, and its text blocks.  The occurrence vector of a token over the pages
of a host is kept as one value: the exclusive or of a hash of (row, count) over the pages that have
it, which partial aggregation makes without ever holding a host's pages together.  Tokens with equal
vectors form an equivalence class; classes of two tokens or more (or of one text block) on `support`
of the host's pages, two at least, are candidates.

A class is valid when it is ordered and nested, which a second pass checks page by page: its tokens
follow each other in one order, repeated as often as they occur, and the same order on every page;
and all its tuples lie in one slot, the gap between two tokens that occur once a page, the same slot
on every page.  Classes whose tokens occur once a page are the frame; the others are nested in the
frame's slots.  Invalid classes take no part.

The template chooses the text.  For every element of the frame (a tag of it and its end) the second pass also sums how much of the pages' plain text, outside links and template text,
lies in its slots.  The main region of a host is the deepest element that holds REGION of it; an
article or main element around it, or blocks in such elements within it, are taken instead, and names
say only which elements can't be the region (text-level ones, chrome) and which blocks inside go (a
form or advert within the article).
A text block that is a token of a valid class on `text_support` of the host's distinct contents goes
wherever it is: it is the template's.  All other blocks of the region are the main text.  A content is
told by a page's two longest blocks, so that repeated rows and copies of a page under other addresses
are one content and keep their text; fewer than `least` contents tell no template text, and a host
with a single content has no template.

Pages of hosts without a valid frame and pages that lack their host's region are read
by element, role and class names alone: the article or main element, or else all blocks that are not
mostly links, without chrome.  `by_template` says which way a page went, `n_slots` how many slots of
its frame hold its text.

Defined results: null html is empty text; pages without a host, or alone on it, are read by their
names; broken markup at the end of a page is dropped as markup; repeated rows all get the same text;
extra columns are ignored.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._store import scoped, small_batches, stage

SUPPORT, TEXT_SUPPORT, LEAST_CONTENTS = 0.5, 0.8, 4
REGION = 2 / 3  # of the plain text, that the region holds
HOT_HOSTS = 1000  # hosts with a share of 1 / HOT_HOSTS of the pages or more get their template by broadcast

#: Elements by what they do to text.
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "canvas", "title", "xmp", "noframes", "noembed")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
CHROME = frozenset("nav footer aside form menu dialog select button fieldset input label datalist head".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pagination paywall popup promo promoted promotion related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
#: Names that are chrome outside articles only, first parts of class names that speak of other elements, and elements whose class names say nothing of themselves.
HEADS = frozenset(["header", "masthead"])
ABOUT = frozenset("with has have no without is not hide show".split())
FRAMES = frozenset("html body main".split())
#: Elements of the level of text, which are no region.
TEXT_LEVEL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote figcaption caption legend summary address center option thead tbody tfoot html a b i u em strong span small label title".split())
CLOSES = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in RAW}
_NAME = re.compile(r"[a-z0-9]+")
_DIGITS = re.compile(r"[0-9]+")
OPEN, CLOSE, TEXT = 0, 1, 2
REGION_LIKE, ARTICLE_LIKE = 1, 2  # flags of an open tag


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower().rstrip(".") if m else ""


def _attributes(raw: str) -> tuple[str, bool, bool, str]:
    """Key of class, id and role; whether it says chrome or hidden; whether it says page header; role."""
    if "=" not in raw and "hidden" not in raw:
        return "", False, False, ""
    parts, chrome, head, role = [], False, False, ""
    for name, a, b, c in _ATTR.findall(raw):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id"):
            parts.append(_DIGITS.sub("0", value))
            for one in value.split():
                words = _NAME.findall(one)
                if words and words[0] not in ABOUT:
                    chrome |= any(w in NAMES and w not in HEADS for w in words)
                    head |= any(w in HEADS for w in words)
        elif name == "role":
            role = value
            parts.append("@" + value)
            chrome |= value in ROLES
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            chrome = True
    return ".".join(parts), chrome, head, role


def read(page: str) -> tuple[list[tuple[int, int, int]], list[tuple[str, bool, bool, float, int]]]:
    """Tokens in order as (hash, kind, detail), and text blocks as (text, chrome, in article, share of it in links, plain characters).

    Only tags of block elements are tokens and part of paths.  A tag's hash is of the path that leads
    to it; an open and its close tag are the same but for the last bit.  The detail of a text token is its block, that of an open tag its flags.
    """
    tokens: list[tuple[int, int, int]] = []
    blocks: list[tuple[str, bool, bool, float, int]] = []
    stack: list[tuple[str, bool, bool, int]] = []  # element, chrome, article, hash of the path
    buf: list[str] = []
    linked = total = 0
    links = 0
    chrome = article = False

    def flush():
        nonlocal linked, total
        if buf:
            text = " ".join(html.unescape("".join(buf)).split())
            if text:
                tokens.append((_text_hash(text), TEXT, len(blocks)))
                blocks.append((text, chrome, article, linked / total if total else 0.0, total - linked))
            buf.clear()
        linked = total = 0

    def add(text: str):
        nonlocal linked, total
        buf.append(text)
        n = len(text) - text.count(" ")
        total += n
        if links:
            linked += n

    def close_to(depth: int):
        nonlocal chrome, article, links
        for name, *_ in stack[depth:]:
            links -= name == "a"
        del stack[depth:]
        chrome, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        if lt > at:
            add(page[at:lt])
        m = _TOKEN.match(page, lt)
        if not m:
            if lt + 1 == n or page[lt + 1] == "/" and "<" not in page[lt + 1 :] and ">" not in page[lt:]:
                break  # markup cut off at the end
            if page[lt + 1] == "/":
                gt = page.find(">", lt)
                at = n if gt < 0 else gt + 1
                continue
            add("<")
            at = lt + 1
            continue
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if page.startswith("<![CDATA[", lt):
                add(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        closing, raw = bool(m[1] or m[4]), m[3] or m[6] or ""
        if closing:
            if name in BLOCK:
                flush()
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    if name in BLOCK:
                        tokens.append((stack[depth][3] | 1, CLOSE, 0))
                    close_to(depth)
                    break
            continue
        key, bad, head, role = _attributes(raw)
        if name in RAW:
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else n
            if name == "title":
                flush()
            continue
        if name in BLOCK:
            flush()
        elif name == "br":
            add("\n")
        while stack and name in CLOSES.get(stack[-1][0], ()):
            close_to(len(stack) - 1)
        if name in VOID or raw.endswith("/") and name not in BLOCK:
            if name == "hr":
                tokens.append((_path(name, stack), OPEN, 0))
            continue
        here = _path(f"{name} {key}" if key else name, stack) if name in BLOCK else stack[-1][3] if stack else 2
        in_article = article or name in ("article", "main") or role in ("main", "article")
        if name in FRAMES:
            bad = head = False
        bad = bad or name in CHROME or ((head or name == "header") and not article)
        stack.append((name, chrome or bad, in_article, here))
        if name in BLOCK:
            can = name not in TEXT_LEVEL and not (chrome or bad)
            tokens.append((here, OPEN, REGION_LIKE * can + ARTICLE_LIKE * (can and (name in ("article", "main") or role in ("main", "article")))))
        links += name == "a"
        chrome, article = stack[-1][1], stack[-1][2]
    flush()
    return tokens, blocks


def _signed(h: int) -> int:
    return h - (1 << 63)


def _path(key: str, stack: list) -> int:
    """Hash of a tag under the open elements; even, as the last bit tells its close tag."""
    return xxhash.xxh64_intdigest(key, seed=stack[-1][3] if stack else 2) & ~1


def _text_hash(text: str) -> int:
    return xxhash.xxh64_intdigest("\t" + text)


PARSED = "page_id long, url string, host string, content long, tokens binary, kinds binary, texts array<string>, flags array<int>, plain array<int>"
CHROME_BLOCK, IN_ARTICLE, LINKY = 1, 2, 4


def _parse(batches):
    """Every page: its tokens (hashes, and kind + 4 * detail), blocks and content."""
    for batch in batches:
        col = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()
        rows = []
        for url, body in zip(col("url"), col("html"), strict=True):
            tokens, blocks = read(body or "")
            hashes = np.array([t[0] for t in tokens], np.uint64)
            kinds = np.array([t[1] + 4 * t[2] for t in tokens], np.int32)
            longest = sorted((b[0] for b in blocks), key=lambda t: (-len(t), t))[:2]
            rows.append((
                host_of(url), _signed(xxhash.xxh64_intdigest("\n".join(longest))), hashes.tobytes(), kinds.tobytes(),
                [b[0] for b in blocks], [CHROME_BLOCK * b[1] + IN_ARTICLE * b[2] + LINKY * (b[3] >= 0.5) for b in blocks], [b[4] for b in blocks],
            ))
        kinds_of = (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()))
        cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds_of)]
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("page_id")), batch.column(batch.schema.get_field_index("url")), *cols], names=[x.split()[0] for x in PARSED.split(", ")])


def _occurrences(batches):
    """(host, token, mark, n, place, is_text) of each distinct open tag and text of each page; the mark hashes (row, n); a page's start is token 0."""
    for batch in batches:
        at = lambda c: batch.column(batch.schema.get_field_index(c))
        out = []
        for i, (host, row) in enumerate(zip(at("host").to_pylist(), at("row").to_pylist(), strict=True)):
            if not host:
                continue
            h = np.frombuffer(at("tokens")[i].as_py(), np.uint64)
            kind = np.frombuffer(at("kinds")[i].as_py(), np.int32) % 4
            place = np.flatnonzero(kind != CLOSE)
            u, first, n = np.unique(h[place], return_index=True, return_counts=True)
            first = place[first]
            count = np.append(n, 1).astype(np.uint64)
            mark = X.mix(X.mix(np.full(len(count), row, np.uint64)) ^ count * np.uint64(0x9E3779B97F4A7C15))
            out.append((host, np.append(u, np.uint64(0)), mark, count, np.append(first / max(len(h), 1), -1.0), np.append(kind[first] == TEXT, False)))
        if out:
            tok, mark, n, place, text = (np.concatenate([o[k] for o in out]) for k in range(1, 6))
            hosts = pa.array(np.repeat(np.array([o[0] for o in out], object), [len(o[1]) for o in out]), pa.string())
            yield pa.RecordBatch.from_arrays(
                [hosts, pa.array(tok.view(np.int64)), pa.array(mark.view(np.int64)), pa.array(n.astype(np.int32)), pa.array(place.astype(np.float32)), pa.array(text.astype(bool))],
                names=["host", "token", "mark", "n", "place", "is_text"],
            )


def deduce(parsed: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(host, tokens): for each host of two contents or more its candidate tokens as (vector, at, token, once, is_text), by class and mean place; classes are not validated yet.

    parsed is a written table, so that a row's place in it is the same in a task made anew.
    """
    rows = parsed.select("host", F.monotonically_increasing_id().alias("row"), "tokens", "kinds")
    seen = rows.mapInArrow(_occurrences, "host string, token long, mark long, n int, place float, is_text boolean")
    seen = seen.withColumn("host", F.xxhash64("host"))
    vectors = seen.groupBy("host", "token").agg(F.bit_xor("mark").alias("vector"), F.count("*").alias("n"), F.max("n").alias("most"), F.avg("place").alias("place"), F.max("is_text").alias("is_text"))
    vectors = stage(vectors.where("n > 1"), "vectors")
    size = vectors.where("token = 0").select("host", F.col("n").alias("pages"))
    named = parsed.where("host <> ''").groupBy("host", "content").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("contents")).where("contents > 1")
    size = size.join(named.select(F.xxhash64("host").alias("host"), F.col("host").alias("name"), "contents"), "host")
    often = vectors.where("token <> 0").join(size, "host").where(F.col("n") >= F.col("pages") * support)
    item = F.struct("place", "token", (F.col("most") == 1).alias("once"), "is_text")
    classes = often.groupBy("name", "vector").agg(F.first("contents").alias("contents"), F.array_sort(F.collect_list(item)).alias("c")).where("size(c) > 1 or c[0].is_text")
    one = classes.select(F.col("name").alias("host"), "contents", F.struct("vector", F.col("c").alias("tokens")).alias("class"))
    return one.groupBy("host").agg(F.first("contents").alias("contents"), F.sort_array(F.collect_list("class")).alias("cand"))


class Frame:
    """One host's candidate tokens, by hash; bad: classes that are left out."""

    def __init__(self, classes: list[dict], bad: set[int] = frozenset()):
        self.of = {t["token"]: (c["vector"], t["once"], t["is_text"]) for c in classes if c["vector"] not in bad for t in c["tokens"]}

    def known(self, h: np.ndarray, kind: np.ndarray) -> list:
        """For each token of a page (vector, once a page, is text), or None."""
        return [None if k % 4 == CLOSE else self.of.get(x) for x, k in zip(h.view(np.int64).tolist(), kind.tolist(), strict=True)]


def _order(hashes: np.ndarray) -> int:
    """Hash of the order in which a class's tokens follow each other; 0 where they are no repeated tuple."""
    n = len(np.unique(hashes))
    first = hashes[:n]
    if len(hashes) % n or (hashes.reshape(-1, n) != first).any():
        return 0
    return _signed(xxhash.xxh64_intdigest(first.tobytes()) | 1)


def _elements(h: np.ndarray, kind: np.ndarray, known: list) -> list[tuple[int, int, int, int]]:
    """Elements of the frame on a page, as (hash, open place, close place, flags): open tags that occur once a page, closed on this one."""
    ends = {int(x): i for i, (x, k) in enumerate(zip(h.view(np.int64).tolist(), kind.tolist(), strict=True)) if k % 4 == CLOSE}
    out = []
    for i, k in enumerate(known):
        if k is not None and k[1] and not k[2]:
            token = int(h[i : i + 1].view(np.int64)[0])
            if ends.get(token | 1, -1) > i:
                out.append((token, i, ends[token | 1], int(kind[i]) >> 2))
    return out


def _check(batches):
    """(host, id, kind, order, slot, inside, total): page by page each candidate class's order and slot (kind 0), each element's plain text (1), and each candidate text's contents (2, in order)."""
    for batch in batches:
        at = lambda c: batch.column(batch.schema.get_field_index(c))
        memo: dict[str, Frame] = {}
        out: list[tuple] = []
        for i, (host, content) in enumerate(zip(at("host").to_pylist(), at("content").to_pylist(), strict=True)):
            if host not in memo:
                memo[host] = Frame(at("cand")[i].as_py())
            h = np.frombuffer(at("tokens")[i].as_py(), np.uint64)
            kind = np.frombuffer(at("kinds")[i].as_py(), np.int32)
            known = memo[host].known(h, kind)
            signed = h.view(np.int64).tolist()
            gate, slot_of = 0, []  # the frame's token that opens the slot of each place
            where: dict[int, list[int]] = {}
            for p, k in enumerate(known):
                if k is not None:
                    if k[1] and not k[2]:
                        gate = signed[p]
                    elif k[2]:
                        out.append((host, signed[p], 2, content, 0, 0, 0))
                    where.setdefault(k[0], []).append(p)
                slot_of.append(gate)
            for vector, ps in where.items():
                slots = set() if known[ps[0]][1] else {slot_of[p] for p in ps}
                out.append((host, vector, 0, _order(h[ps]) if len(slots) < 2 else 0, slots.pop() if len(slots) == 1 else 0, 0, 0))
            plain = np.zeros(len(h), np.int64)
            is_text = kind % 4 == TEXT
            plain[is_text] = np.array(at("plain")[i].as_py(), np.int64)[kind[is_text] >> 2]
            sums = np.concatenate([[0], np.cumsum(plain)])
            for token, a, b, _ in _elements(h, kind, known):
                out.append((host, token, 1, 0, 0, int(sums[b] - sums[a]), int(sums[-1])))
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=["host", "id", "kind", "order", "slot", "inside", "total"])


CHECK = "host string, id long, kind int, order long, slot long, inside long, total long"


def verdicts(said: DataFrame) -> DataFrame:
    """(host, id, kind, valid, inside, total, contents) from what _check says of single pages."""
    same = (F.min("order") == F.max("order")) & (F.min("order") != 0) & (F.min("slot") == F.max("slot"))
    first = said.where("kind < 2").groupBy("host", "id", "kind").agg(same.alias("valid"), F.sum("inside").alias("inside"), F.sum("total").alias("total"), F.lit(0).cast("long").alias("contents"))
    texts = said.where("kind = 2").groupBy("host", "id", "kind", "order").agg(F.lit(1).alias("one")).groupBy("host", "id", "kind").agg(F.count("*").alias("contents"))
    zero = F.lit(0).cast("long")
    return first.unionByName(texts.select("host", "id", "kind", F.lit(True).alias("valid"), zero.alias("inside"), zero.alias("total"), "contents"))


def _extract(text_support: float, least: int, region: float):
    def learned(cand, contents, checks) -> tuple[Frame, set[int], dict[int, tuple[int, int]]]:
        bad = {c["id"] for c in checks if c["kind"] == 0 and not c["valid"]}
        frame = Frame(cand, bad)
        enough = max(least, text_support * contents)
        return frame, {c["id"] for c in checks if c["kind"] == 2 and c["contents"] >= enough and c["id"] in frame.of}, {c["id"]: (c["inside"], c["total"]) for c in checks if c["kind"] == 1}

    def chosen(h, kind, flags, frame, fixed, held) -> tuple[list[int], int, bool]:
        """Blocks of the main text, the slots that hold them, and whether the template chose them."""
        blocks = range(len(flags))
        live = [j for j in blocks if not flags[j] & CHROME_BLOCK]
        if frame is None:
            return [j for j in live if flags[j] & IN_ARTICLE] or [j for j in live if not flags[j] & LINKY], 0, False
        known = frame.known(h, kind)
        is_text = kind % 4 == TEXT
        place = np.zeros(len(flags), np.int64)
        place[kind[is_text] >> 2] = np.flatnonzero(is_text)
        signed = h.view(np.int64)
        live = [j for j in live if int(signed[place[j]]) not in fixed]
        rich = [(a, b, f) for t, a, b, f in _elements(h, kind, known) if f & REGION_LIKE and t in held and held[t][1] and held[t][0] >= region * held[t][1]]
        a, b, f = min((x for x in rich if x[2] & ARTICLE_LIKE), default=max(rich, default=(-1, len(h), 0)))
        got = [j for j in live if a < place[j] < b]
        if not f & ARTICLE_LIKE:  # names break the tie where no deeper element holds enough
            got = [j for j in got if flags[j] & IN_ARTICLE] or [j for j in got if not flags[j] & LINKY]
        spine = np.cumsum([k is not None and k[1] and not k[2] for k in known])
        return got, len({int(spine[place[j]]) for j in got}), bool(rich)

    def run(batches):
        for batch in batches:
            at = lambda c: batch.column(batch.schema.get_field_index(c))
            memo: dict[str, tuple] = {}
            made = []
            for i, host in enumerate(at("host").to_pylist()):
                if host not in memo:
                    cand = at("cand")[i].as_py()
                    memo[host] = learned(cand, at("contents")[i].as_py(), at("checks")[i].as_py() or []) if cand else (None, set(), {})
                h, kind = np.frombuffer(at("tokens")[i].as_py(), np.uint64), np.frombuffer(at("kinds")[i].as_py(), np.int32)
                texts = at("texts")[i].as_py()
                got, slots, way = chosen(h, kind, at("flags")[i].as_py(), *memo[host])
                made.append(("\n".join(texts[j] for j in got), slots, way))
            yield pa.RecordBatch.from_arrays(
                [at("page_id"), at("url"), pa.array([m[0] for m in made], pa.string()), pa.array([len(m[0]) for m in made], pa.int64()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.bool_())],
                names=["page_id", "url", "text", "n_chars", "n_slots", "by_template"],
            )

    return run


@scoped
def extract(pages: DataFrame, support: float = SUPPORT, text_support: float = TEXT_SUPPORT, least: int = LEAST_CONTENTS, region: float = REGION) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars, n_slots, by_template."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    parsed = stage(pages.mapInArrow(_parse, PARSED), "parsed", "zstd")
    candidates = stage(deduce(parsed, support), "candidates")
    total = parsed.count()
    hot = stage(parsed.groupBy("host").agg(F.count("*").alias("rows")).where(F.col("rows") * HOT_HOSTS >= total).select("host", F.lit(True).alias("hot")), "hot")

    def with_host(rows: DataFrame, of: DataFrame) -> DataFrame:
        """Pages with what is known of their host; hosts with many pages, HOT_HOSTS of them at most, get it by broadcast."""
        marked = rows.join(F.broadcast(hot), "host", "left")
        few, rest = of.join(F.broadcast(hot.select("host")), "host", "left_semi"), of.join(F.broadcast(hot.select("host")), "host", "left_anti")
        return marked.where("hot").drop("hot").join(F.broadcast(few), "host", "left").unionByName(marked.where("hot is null").drop("hot").join(rest, "host", "left"))

    said = with_host(parsed.select("host", "content", "tokens", "kinds", "plain"), candidates.select("host", "cand")).where("cand is not null").mapInArrow(_check, CHECK)
    checks = stage(verdicts(said), "checks").groupBy("host").agg(F.collect_list(F.struct("id", "kind", "valid", "inside", "total", "contents")).alias("checks"))
    template = stage(candidates.join(checks, "host", "left"), "templates")
    rows = with_host(parsed.drop("content", "plain"), template)
    return rows.mapInArrow(_extract(text_support, least, region), "page_id long, url string, text string, n_chars long, n_slots long, by_template boolean")


def op8_template_extraction(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
