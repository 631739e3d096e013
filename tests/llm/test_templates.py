"""HTML main text: articles, templates without article elements, classes against brute force, hard cases."""

import collections
import html
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import templates

PAGE = "page_id long, url string, html string"


def test_html_articles(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {}
    for r in pages.collect():
        m = re.search(r"<article>(.*?)(</article>|$)", r.html or "", re.S)
        cut = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", m[1])]
        want[r.page_id] = "\n".join(b for b in cut if b)
    got = {r.page_id: (r.text, r.n_chars) for r in templates.extract(pages).collect()}
    assert got == {k: (v, len(v)) for k, v in want.items()}


def test_html_templates_without_articles(spark):
    frame = '<html><body><div>Site notice for all</div><p>Story {i} says &lt;b&gt; &amp; more{i}<p>second&nbsp;part {i}<ul><li>x{i}<li>y{i}</ul><div class="comments"><p>bad {i}</div><aside>no</aside><script>var a="<p>"</script><div>All rights reserved</div></body></html>'
    rows = [(i, f"http://user@Host.example:80/{i}?q", frame.format(i=i)) for i in range(6)] + [(10, None, None), (11, "", ""), (12, "http://one.example/", "<p>alone <a href='x'>link</a> here <b unfinished"), (13, "x", "a < b &amp")]
    got = {r.page_id: r.text for r in templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()}
    for i in range(6):
        assert got[i] == f"Story {i} says <b> & more{i}\nsecond part {i}\nx{i}\ny{i}"
    assert (got[10], got[11], got[12], got[13]) == ("", "", "alone link here", "a < b &")
    assert templates.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_names():
    page = "<body class='nav-open has-sidebar'><div class='site-header'>no</div><div class='with-sidebar'><article><header class='post-header'><h1>T</h1></header><p>x</p><div class='share-bar'>no</div><form>no</form></article></div><main id='main'><p hidden>no</p></main>"
    assert [b[0] for b in templates.read(page)[1] if not b[1]] == ["T", "x"]


def host_pages(n, seed=1, host="h.example", notice=True):
    """Pages without article or main elements and without telling names: menu, story in a plain div, notice within it, side text."""
    rng = np.random.default_rng(seed)
    word = lambda k: " ".join("w" + str(x) for x in rng.integers(0, 10**6, k))
    rows, want = [], []
    for i in range(n):
        paras = [word(int(rng.integers(15, 40))) for _ in range(int(rng.integers(2, 6)))]
        items = "".join(f"<li><a href='/{j}'>{word(2)}</a></li>" for j in range(int(rng.integers(2, 5))))
        said = "<div class='x9'>Read this in our application now</div>" if notice else ""
        body = "".join(f"<p>{t}</p>" + (said if k == 0 else "") for k, t in enumerate(paras))
        rows.append((i, f"http://{host}/{i}", f"<html><body><div class='a1'><ul>{items}</ul></div><div class='b2'><span>{word(3)}</span></div><div class='c3'><h2>{word(4)}</h2>{body}</div><div class='d4'>{word(5)}</div></body></html>"))
        want.append("\n".join([re.search("<h2>(.*?)</h2>", rows[-1][2])[1], *paras]))
    return rows, want


def test_template_chooses_the_text(spark):
    rows, want = host_pages(12)
    got = spark.createDataFrame(rows, PAGE)
    out = {r.page_id: r for r in templates.extract(got).collect()}
    assert [out[i].text for i in range(12)] == want and all(out[i].by_template and out[i].n_slots > 0 for i in range(12))
    alone = {r.page_id: r for r in templates.extract(got.withColumn("url", F.concat(F.lit("http://"), F.col("page_id").cast("string"), F.lit(".example/")))).collect()}
    assert sum(alone[i].text != out[i].text for i in range(12)) == 12 and not any(r.by_template for r in alone.values())  # names alone keep side text and notice


def test_notice_inside_articles_goes(spark):
    rows = [(i, "http://a.example/", f"<body><article><h1>t{i}</h1><p>story {i} of its own</p><p>Subscribe to our letter now</p></article></body>") for i in range(6)]
    got = {r.page_id: r.text for r in templates.extract(spark.createDataFrame(rows, PAGE)).collect()}
    assert got == {i: f"t{i}\nstory {i} of its own" for i in range(6)}
    few = {r.page_id: r.text for r in templates.extract(spark.createDataFrame(rows[:3], PAGE)).collect()}
    assert all("Subscribe" in few[i] for i in few)  # too few contents to tell


def test_repeated_rows_and_copies_keep_their_text(spark):
    page = "<body><div>one block of text</div><p>another longer block of text</p><p>third</p></body>"
    rows = [(i, "http://r.example/x", page) for i in range(8)]  # repeated rows
    rows += [(100 + i, f"http://m.example/{i}", f"<body><div>ad {i}</div><p>the story that all mirrors have</p><p>and its second part</p></body>") for i in range(8)]  # copies
    own, want = host_pages(10, 3, "n.example")
    rows += [(200 + r[0], r[1], r[2]) for r in own for _ in range(5)]
    got = collections.defaultdict(set)
    for r in templates.extract(spark.createDataFrame(rows, PAGE)).collect():
        got[r.page_id].add(r.text)
    assert all(got[i] == {"one block of text\nanother longer block of text\nthird"} for i in range(8))
    assert all("the story that all mirrors have\nand its second part" in next(iter(got[100 + i])) for i in range(8))
    assert [got[200 + i] for i in range(10)] == [{w} for w in want]


def test_hosts_that_are_not_hot(spark, monkeypatch):
    monkeypatch.setattr(templates, "HOT_HOSTS", 0)
    rows, want = host_pages(12)
    assert [r.text for r in sorted(templates.extract(spark.createDataFrame(rows, PAGE)).collect())] == want


def brute(rows):
    """Valid classes of one host, the contents of its repeated texts, and the plain text in elements of the frame, from all pages at once."""
    pages = [templates.read(body) for _, _, body in rows]
    counts = [collections.Counter(h for h, kind, _ in tokens if kind != templates.CLOSE) for tokens, _ in pages]
    kinds = {h: kind for tokens, _ in pages for h, kind, _ in tokens}
    content = ["\n".join(sorted((b[0] for b in blocks), key=lambda t: (-len(t), t))[:2]) for _, blocks in pages]
    classes = collections.defaultdict(list)
    for t in set().union(*counts):
        v = tuple(c[t] for c in counts)
        if sum(x > 0 for x in v) > 1 and sum(x > 0 for x in v) >= templates.SUPPORT * len(pages):
            classes[v].append(t)
    classes = {v: ts for v, ts in classes.items() if len(ts) > 1 or kinds[ts[0]] == templates.TEXT}
    once = {t for v, ts in classes.items() if max(v) == 1 for t in ts if kinds[t] != templates.TEXT}
    valid = set()
    for v, ts in classes.items():
        orders, slots, ok = set(), set(), True
        for (tokens, _), n in zip(pages, v, strict=True):
            seq = [h for h, kind, _ in tokens if h in ts and kind != templates.CLOSE]
            if not n:
                continue
            ok &= seq == seq[: len(ts)] * n
            orders.add(tuple(seq[: len(ts)]))
            if max(v) > 1:
                at, here = 0, set()
                for h, kind, _ in tokens:
                    at = h if h in once else at
                    if h in ts and kind != templates.CLOSE:
                        here.add(at)
                ok &= len(here) == 1
                slots |= here
        if ok and len(orders) == 1 and len(slots) < 2:
            valid.add(frozenset(ts))
    texts = {t: len({c for c, n in zip(content, v, strict=True) if n}) for v, ts in classes.items() for t in ts if kinds[t] == templates.TEXT}
    held = collections.Counter()
    for tokens, blocks in pages:
        hs = [h for h, _, _ in tokens]
        for t in once:
            if t in hs and t | 1 in hs:
                held[t] += sum(blocks[d][4] for h, kind, d in tokens[hs.index(t) : hs.index(t | 1)] if kind == templates.TEXT)
    return valid, texts, {t: n for t, n in held.items()}


@pytest.mark.parametrize("seed", range(5))
def test_classes_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    bits = ["<div class='k1'>Fixed line one</div>", "<ul><li>i{r}</li><li>Same item</li></ul>", "<table><tr><td>{r}</td></tr></table>", "<p>Own text {r} and more {r}</p>", "<div class='k2'><b>Label</b> {r}</div>", "<hr>"]
    rows = []
    for i in range(int(rng.integers(5, 14))):
        order = list(range(len(bits))) if rng.random() < 0.7 else list(rng.permutation(len(bits)))
        body = "".join(bits[k].replace("{r}", str(rng.integers(10**6))) * (1 if rng.random() < 0.8 else int(rng.integers(0, 4))) for k in order)
        rows.append((i, "http://z.example/", f"<html><body><div class='m'>{body}</div></body></html>"))
    rows += rows[:2]
    valid, texts, held = brute(rows)
    parsed = spark.createDataFrame(rows, PAGE).coalesce(1).mapInArrow(templates._parse, templates.PARSED)
    cand = templates.deduce(parsed)
    got = {c.vector: frozenset(t.token % 2**64 for t in c.tokens) for c in cand.first().cand}
    said = templates.verdicts(parsed.join(cand, "host").mapInArrow(templates._check, templates.CHECK)).collect()
    assert {got[r.id] for r in said if r.kind == 0 and r.valid} == valid and (valid or seed > 2)  # in seeds 3 and 4 every class is out of order on some page
    assert {r.id % 2**64: r.contents for r in said if r.kind == 2} == texts
    assert {r.id % 2**64: r.inside for r in said if r.kind == 1 and r.inside} == {k: v for k, v in held.items() if v}


def test_edges(spark):
    rows = [(1, None, None), (2, "http://e.example/", None), (3, "http://e.example/", ""), (4, "http://e.example/", "   "), (None, "http://e.example/", "<p>x"), (5, None, "<p>no host</p>"), (6, "http://e.example/", "<p>" + "long " * 200000 + "</p>"), (6, "http://e.example/", "<p>x"), (7, "http://e.example/", "<" * 5000), (8, "http://e.example/", "<div>" * 3000 + "deep")]
    df = spark.createDataFrame(rows, PAGE).withColumn("text", F.lit("clash")).withColumn("host", F.lit(1)).withColumn("tokens", F.lit(2)).withColumn("cand", F.lit(3))
    got = collections.defaultdict(list)
    for r in templates.extract(df).collect():
        got[r.page_id].append(r.text)
        assert r.n_chars == len(r.text)
    assert got[1] == [""] and got[2] == [""] and got[3] == [""] and got[4] == [""] and got[None] == ["x"] and got[5] == ["no host"] and sorted(map(len, got[6])) == [1, 999999] and got[8] == ["deep"]
    assert templates.extract(df.where("false")).count() == 0
