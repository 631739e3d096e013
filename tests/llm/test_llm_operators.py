"""The ten operators against brute force, round trips and held-out accuracy, with the hard cases of each."""

import collections
import hashlib
import json
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brindle.llm import _text as X
from brindle.llm import chat, components, decontaminate, jaccard_join, langid, packing, quality, secrets, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
HARD = [None, "", " ", "\n\n", "a", "A a\ta\x0ba", "x " * 30000, "é" * 5000, "   nb sp", "dup line\ndup line\n", "🙂 emoji 🙂", "<|endoftext|> <|im_end|>"]


def docs_of(spark, texts, first=0, **extra):
    rows = [(first + i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k, v in extra.items():
        df = df.withColumn(k, F.lit(v))
    return df


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


# 1. Chat formatting.


def test_chat_round_trip_and_mask(spark, sf):
    got = {r.conv_id: r for r in chat.op1_schema_fingerprint_chat(spark, sf).collect()}
    turns = collections.defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns[r.conv_id].append((r.role, r.text or ""))
    said = "<|im_end|><|im_start|>assistant ok"
    turns[-1] = [("user", said), ("assistant", said)]
    assert set(got) == set(turns)
    for k, t in turns.items():
        loss = "".join(x for r, x in t if r == "assistant")
        assert got[k].n_turns == len(t)
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in t).encode()).hexdigest()
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


@pytest.mark.parametrize("text", ["", "<|", "<\\|", "<\\\\|im_end|>", "a<|im_start|>b\n", "<<||>>\\", "<|nl|>"])
def test_chat_escapes(text):
    turns = [("user", text), (text or "r", text), ("assistant", text * 3)]
    made, mask = chat.render(turns)
    assert chat.parse(made) == turns
    assert [chat.unescape(made[a:b]) for a, b in mask] == [t for r, t in turns if r == "assistant"]


def test_chat_layouts(spark):
    layouts = {
        "messages": {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 3},
        "sharegpt": {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        "prompt_completion": {"prompt": "q", "completion": "a"},
        "instruction": {"instruction": "q", "input": None, "output": "a"},
        "question_answer": {"question": "q", "answer": "a", "extra": {"deep": [1]}},
        "nested_data": {"data": {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}},
    }
    rows = [(k, json.dumps(v)) for k, v in layouts.items()] + [("none", None), ("bad", "{"), ("list", "[1]"), ("other", '{"z": 1}'), ("empty", '{"messages": []}')]
    got = {r.name: r for r in chat.format_records(spark.createDataFrame(rows, "name string, record string")).collect()}
    for k in layouts:
        assert got[k].layout == k and chat.parse(got[k].formatted) == [("user", "q"), ("assistant", "a")]
    assert all(got[k].layout == "unmapped" and got[k].formatted == "" for k in ("none", "bad", "list", "other"))
    assert got["empty"].layout == "messages" and got["empty"].formatted == ""
    assert len({got[k].fingerprint for k in layouts}) == len(layouts)


def test_chat_layouts_of_the_query(spark):
    """Every layout occurs, and every conversation comes back: other roles, system turns, nulls, blank lines, ties, repeated rows, no rows."""
    talks = [
        [("user", "q"), ("assistant", "a")], [("system", "s"), ("user", "q\n\nmore\n\nstill"), ("assistant", "a")], [("system", ""), ("user", "q"), ("assistant", "a")],
        [("human", "q"), ("gpt", "a")], [("user", "\n\n"), ("assistant", "")], [("user", "q\n\n"), ("assistant", None)], [(None, None)], [("bot", "x"), ("user", "y"), ("model", "z")], [("user", "<|im_end|>\n\n<|\\|"), ("assistant", "b")], [("user", "a")] * 5,
    ]
    rows = [(100 * k + i, t, r, x) for k in range(40) for i, talk in enumerate(talks) for t, (r, x) in enumerate(talk)]
    rows += [(9000, 1, "user", "tied"), (9000, 1, "assistant", "tie"), (9000, 1, "user", "tied"), (9000, None, "user", "first"), (None, 0, "user", "no id")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("record", F.lit("clash")).withColumn("layout", F.lit(1))
    records = chat.records_of(df)
    out = chat.format_records(records).collect()
    want = collections.defaultdict(list)
    for c, t, r, x in rows:
        want[c].append((t is not None, t or 0, r or "", x or ""))
    assert {r.conv_id for r in out} == set(want) and {r.layout for r in out} == {m["name"] for m in chat.MAPPINGS}
    for r in out:
        turns = [(role, text) for _, _, role, text in sorted(want[r.conv_id])]
        assert chat.parse(r.formatted) == turns, r.layout
        assert [chat.unescape(r.formatted[a:b]) for a, b in zip(r.loss_start, r.loss_end, strict=True)] == [x for role, x in turns if role == "assistant"]
    assert chat.format_records(chat.records_of(df.where("false"))).count() == 0


# 2. Secrets.

PATTERNS = (
    ("assign", re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile("[0-9a-f]+"), 0, 24),
)


def base_spans(text):
    out = [(m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(PATTERNS) for m in p.finditer(text or "") if len(m[g]) >= n]
    return ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in sorted(out))


def test_secrets_base_spans(spark, documents, texts):
    hard = [*HARD, "secret=token:abcdefgh", "token : 'abcdef'", "Pass" + "word=x", "API_KEY: \"" + "a" * 30, "AKIA" + "B" * 16 + " AKIAAKIA", "é token=" + "f" * 30 + "é", "password==abcdef", "token=\"\"abcdefg"]
    rows = docs_of(spark, hard, 10**6).unionByName(documents.select("doc_id", "text", "lang", "source", "n_chars"))
    want = dict(texts) | {10**6 + i: t for i, t in enumerate(hard)}
    got = secrets.find_secrets(rows).collect()
    assert len(got) == len(want)
    for r in got:
        b = base_spans(want[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(b.encode()).hexdigest(), (want[r.doc_id] or "")[:80]
        assert set(filter(None, b.split(","))) <= set(r.spans.split(","))


@pytest.mark.parametrize("least", [1000, 2])
def test_secrets_ownership(spark, monkeypatch, least):
    monkeypatch.setattr(secrets, "COMMON_LEAST", least)  # 2: repeated values are broadcast, as frequent ones are
    live, example, copied = "Zx9" + "qW7e" * 6, "Ab1" + "cD2f" * 6, "Vv7" + "nM4k" * 6
    texts = [f"key {example} end", f"key {example} end", f"key {example} end", f"mine {live} end", f"again {live}", None, *[f"vendored {copied} file token={example}"] * 25]
    df = docs_of(spark, texts).withColumn("source", F.when(F.col("doc_id") > 2, F.lit("s9")).otherwise(F.col("source")))
    got = {r.doc_id: r for r in secrets.find_secrets(df).collect()}
    assert all(got[i].spans == "" and got[i].n_example == 1 for i in range(3))
    assert all(got[i].n_live == 1 and "owned" in got[i].spans and (got[i].most_owners, got[i].most_repositories) == (1, 2) for i in (3, 4))
    assert (got[5].n_live, got[5].most_owners, got[5].spans) == (0, 0, "")
    assert all((got[i].n_live, got[i].n_example, got[i].n_copied, got[i].n_assign) == (0, 1, 1, 1) and "owned" not in got[i].spans for i in range(6, 31))
    freq = {(r.n_owners, r.n_repositories, r.n, r.verdict) for r in secrets.verdicts(secrets.frequencies(secrets.scan(df, F.col("source"), F.col("doc_id")))).collect()}
    assert freq == {(4, 28, 28, 1), (1, 2, 2, 0), (1, 25, 25, 2)}


def test_secrets_many_in_one_text(spark):
    """Hundreds of spans of every kind in one text, over blocks, and rows that are empty, repeated, null or named like ours."""
    rng = np.random.default_rng(3)
    word = lambda k, n: "".join(rng.choice(list(k), n))
    parts = [[word("0123456789abcdef", 32), "token=" + word("abcXYZ019", 12), "AKIA" + word("ABCDEF0123", 18), word("abcdefGHIJ0123+/", 40), "é🙂 filler"][i] for i in rng.integers(0, 5, 1500)]
    text = " ".join(parts)
    df = docs_of(spark, [text, text, None, ""]).withColumn("value", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("all", F.lit(2))
    got = secrets.find_secrets(df.union(df.limit(1)).union(df.limit(1).withColumn("doc_id", F.lit(None).cast("long")))).collect()
    assert len(got) == 6 and secrets.find_secrets(df.where("false")).count() == 0
    want = hashlib.sha256(base_spans(text).encode()).hexdigest()
    assert sum(r.base_sha256 == want for r in got) == 4 and {r.doc_id for r in got} == {0, 1, 2, 3, None}
    base = [tuple(map(int, x.split(":")[1:])) for x in base_spans(text).split(",")]
    owned = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}", text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
    owned = [w for w in owned if not any(a < w[1] and w[0] < b for a, b in base)]
    spans = next(r.spans for r in got if r.doc_id == 1).split(",")
    assert [tuple(map(int, x.split(":")[1:])) for x in spans if x.startswith("owned")] == owned and len(owned) > 200


# 3. Quality.


def counts(text):
    w = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = collections.Counter(win)
    mark = {j for i, x in enumerate(win) if n[x] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(mark)


def test_quality_counts_and_verdicts(spark, sf, documents, texts):
    chain = quality.learn(documents, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = docs_of(spark, HARD, 10**6, kept="clash").select("doc_id", "text").unionByName(documents.select("doc_id", "text"))
    want = dict(texts) | {10**6 + i: t for i, t in enumerate(HARD)}
    for r in quality.judge(rows, chain).collect():
        c = counts(want[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == c
        assert r.base_failed == (c[0] < 20 or 100 * c[4] > 30 * c[0]) and not (r.kept and r.base_failed)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id: (r.kept, r.base_failed) for r in quality.judge(documents, chain).collect()}
    good = [kept[d][0] for d, q in labels.items() if q == 1 and d in kept and not kept[d][1]]
    assert np.mean(good) > 0.97


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    m = quality.Chain()
    m.w, m.t = rng.normal(size=len(quality.FEATURES)), rng.normal(size=(2, 2))
    for n in (1, 2, 5, 8):
        x = rng.normal(size=(n, len(quality.FEATURES)))
        u = x @ m.w
        score = lambda y: sum(u[i] * y[i] for i in range(n)) + sum(m.t[y[i], y[i + 1]] for i in range(n - 1))
        best = max(np.ndindex(*[2] * n), key=score)
        assert m.viterbi(x).astype(int).tolist() == list(best)


def test_forward_backward_brute_force():
    rng = np.random.default_rng(4)
    size = [4, 1, 3, 5]
    x, t, w = [rng.normal(size=(n, len(quality.FEATURES))) for n in size], rng.normal(size=(2, 2)), rng.normal(size=len(quality.FEATURES))
    c = quality.Chains(x, [np.ones(n, np.int64) for n in size])
    got, changes = c.sums(c.emission(w), t)
    total = np.zeros((2, 2))
    for row, i in enumerate(c.order):
        u = x[i] @ w
        ys = list(np.ndindex(*[2] * size[i]))
        weight = np.exp([sum(u[k] * y[k] for k in range(size[i])) + sum(t[y[k], y[k + 1]] for k in range(size[i] - 1)) for y in ys])
        weight /= weight.sum()
        for k in range(size[i]):
            assert math.isclose(got[row, k], sum(p * y[k] for p, y in zip(weight, ys, strict=True)))
        for p, y in zip(weight, ys, strict=True):
            for k in range(size[i] - 1):
                total[y[k], y[k + 1]] += p
    assert np.allclose(total, changes)


def test_latent_lines_are_told_by_document_labels():
    """Bad documents mix junk and content lines under one label; the labels of lines come out though none is given."""
    rng = np.random.default_rng(5)
    k, x, chars, good, truth = len(quality.FEATURES), [], [], [], []
    for i in range(400):
        bad = i % 4 == 0
        junk = (rng.random(int(rng.integers(3, 12))) < 0.8) if bad else np.zeros(int(rng.integers(3, 12)), bool)
        v = rng.normal(0, 0.3, (len(junk), k))
        v[:, 0] = 1
        v[junk, 3] += 1.5
        x.append(v)
        chars.append(rng.integers(20, 80, len(junk)))
        good.append(0 if bad else 1)
        truth.append(junk)
    m = quality.train(x, chars, np.array(good))
    got = np.concatenate([m.viterbi(v) for v in x])
    assert (got == np.concatenate(truth)).mean() > 0.95
    c = quality.Chains(x, chars)
    kind = np.array(good, bool)[c.order]
    share = (c.sums(c.tilted(c.emission(m.w * 0), m.t * 0, kind), m.t * 0)[0] * c.share).sum(1)
    assert np.allclose(share[kind], quality.GOOD, atol=0.02) and np.allclose(share[~kind], quality.BAD, atol=0.02)


def test_quality_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    df = docs_of(spark, [*HARD, "same", "same"], kept="clash", n_words=1, chain=2, x=3)
    assert np.array_equal(quality.learn(df, none).w, quality.Chain().w)
    marks = spark.createDataFrame([(i, i % 2) for i in range(14)] + [(None, 1), (3, None), (99, 1)], "doc_id long, quality int")
    chain = quality.learn(df, marks)
    got = quality.judge(df, chain).collect()
    assert len(got) == len(HARD) + 2 and not any(r.kept for r in got if r.base_failed) and quality.judge(df.where("false"), chain).count() == 0
    long = docs_of(spark, ["\n".join(f"line {i} of a long text" for i in range(3000))])
    assert quality.learn(long, spark.createDataFrame([(0, 1)], "doc_id long, quality int")).w.shape == quality.Chain().w.shape
    assert quality.judge(long, chain).first().n_words == 18000


# 4. Language.


def profile(text, size):
    n = collections.Counter()
    for w in "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else " " for c in text or "").split():
        p = f" {w} "
        for k in (1, 2, 3):
            n.update(p[i : i + k] for i in range(len(p) - k + 1) if k > 1 or p[i] != " ")
    code = lambda g: sum(ord(c) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    return [code(g) for g, _ in sorted(n.items(), key=lambda x: (-x[1], code(x[0])))][:size]


def test_language_profiles_and_distance(spark, documents, texts):
    some = [t for t in list(texts.values())[:15]] + HARD[:-1]
    code, first = langid.grams(*X.utf8(pa.array(some, pa.string())))
    for i, t in enumerate(some):
        got = langid.ranked(code[first[i] : first[i + 1]], 400).tolist() if first[i] < first[i + 1] else []
        assert got == profile(t, 400)
    held = langid.fold(F.col("doc_id"), 4) == 2
    profiles = langid.learn(documents, ~held)
    got = langid.identify(documents.select("doc_id", "lang", "text"), profiles).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)
    odd = langid.identify(docs_of(spark, HARD, lang_x="y").select("doc_id", "text"), profiles).collect()
    assert {r.doc_id for r in odd if r.lang_pred == "und"} == {i for i, t in enumerate(HARD) if not any(c.isalpha() for c in t or "")}
    assert {r.lang_pred for r in langid.identify(documents.select("doc_id", "text"), {}).collect()} == {"und"}
    clash = langid.identify(docs_of(spark, ["the and of"], lang_pred="mine", score="own").select("doc_id", "text", "lang_pred", "score"), profiles)
    assert clash.columns == ["doc_id", "lang_pred", "score", "lang_pred_", "score_"] and clash.first().lang_pred == "mine" and clash.where("false").count() == 0


def told(text, learned, size=400):
    """Language and score by the out-of-place distance, in plain Python; learned: {language: its n-grams, most frequent first}."""
    own = profile(text, size)
    if not own or not learned:
        return "und", 0.0
    best = {}
    for name, grams in learned.items():
        rank = {g: i for i, g in enumerate(grams)}
        best[name] = sum(abs(rank[g] - i) if g in rank else size for i, g in enumerate(own))
    name = min(sorted(best), key=lambda k: best[k])
    return name, 1 - min(best[name], size * len(own)) / (size * len(own))


def learned_profiles(rows, size=400):
    """Profiles of (lang, text) rows, counted in plain Python."""
    n = collections.defaultdict(collections.Counter)
    for lang, text in rows:
        if lang is not None and text is not None:
            code, _ = langid.grams(*X.utf8(pa.array([text], pa.string())))
            n[lang].update(code.view(np.int64).tolist())
    return {k: [g % 2**64 for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:size]] for k, c in n.items()}


def test_language_brute_force(spark, documents):
    rows = [r for r in documents.select("doc_id", "lang", "text").collect()]
    learned = learned_profiles([(r.lang, r.text) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 != 2])
    got = {k: v.tolist() for k, v in langid.learn(documents, langid.fold(F.col("doc_id"), 4) != 2).items()}
    assert got == learned
    extra = docs_of(spark, HARD, 10**6).select("doc_id", "text")
    for r in langid.identify(documents.select("doc_id", "text").union(extra), langid.learn(documents, langid.fold(F.col("doc_id"), 4) != 2)).collect():
        text = HARD[r.doc_id - 10**6] if r.doc_id >= 10**6 else next(x.text for x in rows if x.doc_id == r.doc_id)
        name, score = told(text, learned)
        assert (r.lang_pred, round(r.score, 9)) == (name, round(score, 9)), r.doc_id


# 5. Toxicity.


def test_toxicity_held_out(spark, sf, documents):
    labels = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet")
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    held = langid.fold(F.col("doc_id"), 3) == 1
    m = toxicity.learn(docs, labels.where(~held))
    got = toxicity.score(docs.where(held).select("doc_id", "text"), m).join(labels, "doc_id").collect()
    p, n = [r.score for r in got if r.toxic], [r.score for r in got if not r.toxic]
    assert np.mean([[a > b for b in n] for a in p]) > 0.85 and max(n) < 0.9
    empty = toxicity.score(docs_of(spark, HARD).select("doc_id", "text"), m).collect()
    assert all(0 <= r.score <= 1 for r in empty) and len(empty) == len(HARD)
    assert toxicity.learn(docs, labels.where("false")) is None
    assert {r.score for r in toxicity.score(documents.select("doc_id", "text"), None).collect()} == {0.0}
    clash = toxicity.score(docs_of(spark, ["a", "a", None], score="own").select("doc_id", "text", "score"), m).collect()
    assert {r.score for r in clash} == {"own"} and clash[0].score_ == clash[1].score_
    assert toxicity.score(documents.select("doc_id", "text").where("false"), m).count() == 0


def test_machine_adds_pairwise_products():
    m = toxicity.Machine(0.3, np.arange(5), 3, seed=1)
    m.w = np.arange(5) / 10
    m.v = np.random.default_rng(1).normal(size=(5, 3))
    idx = [0, 2, 4]
    want = 0.3 + m.w[idx].sum() + sum(m.v[a] @ m.v[b] for i, a in enumerate(idx) for b in idx[i + 1 :])
    assert np.allclose(m.raw(np.array(idx), np.array([0, 3, 3])), [want, 0.3])


def test_machine_learns_what_additive_weights_cannot():
    """Toxic is what holds exactly one of two terms: neither tells anything alone, and no sum of weights can say it."""
    rng = np.random.default_rng(3)
    x = rng.random((4000, 30)) < np.r_[0.5, 0.5, np.full(28, 0.3)]
    y = (x[:, 0] ^ x[:, 1]).astype(float)
    bags = [np.flatnonzero(r).astype(np.int32) for r in x]
    df, hit = np.zeros(1 << toxicity.BITS), np.zeros(1 << toxicity.BITS)
    df[:30], hit[:30] = x.sum(0), x[y > 0].sum(0)
    p = y.mean()
    z = np.abs(hit - df * p)[:2] / np.sqrt(df[:2] * p * (1 - p))
    assert (z < toxicity.Z).all()  # not telling by themselves
    chosen = toxicity.choose(df, hit, len(y), y.sum())
    assert {0, 1} <= set(chosen)
    m = toxicity.train(bags, y, chosen, epochs=40)
    at = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    right = ((m.raw(m.slot[np.concatenate(bags)], at) > 0) == (y > 0)).mean()
    design = np.c_[np.ones(len(x)), x].astype(float)
    additive = ((design @ np.linalg.lstsq(design, y - 0.5, rcond=None)[0] > 0) == (y > 0)).mean()
    assert right > 0.95 and additive < 0.65


def test_terms_are_counted_over_whole_texts(spark):
    texts = ["bad group " * 3, "bad " + "filler " * 200000 + "group", None, "", "Bad-GROUP"]
    df = spark.createDataFrame([(i % 2, t) for i, t in enumerate(texts)], "toxic int, text string")
    got = {r.term: (r.n, r.toxic) for r in df.mapInArrow(toxicity._counts, "term int, n long, toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).collect()}
    want = collections.defaultdict(lambda: [0, 0])
    for i, t in enumerate(texts):
        for term in set(toxicity.terms(*X.utf8(pa.array([t], pa.string())))[0].tolist()):
            want[term][0] += 1
            want[term][1] += i % 2
    assert got == {k: tuple(v) for k, v in want.items()}


# 6. Near duplicates.


def classes(texts, k=5, num=75, den=100):
    sets = {}
    for d, t in texts.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()
    inv, root = collections.defaultdict(list), {d: d for d in sets}

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for d in sorted(sets):
        n = collections.Counter(o for s in sets[d] for o in inv[s])
        for o, i in n.items():
            if den * i >= num * (len(sets[d]) + len(sets[o]) - i):
                a, b = find(d), find(o)
                root[max(a, b)] = min(a, b)
        for s in sets[d]:
            inv[s].append(d)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def near(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df).collect()}


def test_near_duplicates_brute_force(spark, documents, texts):
    assert near(documents) == classes(texts)


@pytest.mark.parametrize("small_blocks", [False, True])
def test_near_duplicates_hot_groups(spark, monkeypatch, small_blocks):
    if small_blocks:  # many blocks, salted lists and the pass of nearest partners, on few rows
        for k, v in (("BLOCK", 7), ("LARGE", 8), ("LARGE_PAIRS", 0), ("LIST", 16), ("SEEN", 2), ("HOT_LEAST", 8)):
            monkeypatch.setattr(jaccard_join, k, v)
    rng = np.random.default_rng(5)
    base = [f"w{rng.integers(400)}" for _ in range(60)]
    texts = {}
    for i in range(120):
        w = list(base)
        for p in rng.choice(60, rng.integers(0, 4), replace=False):
            w[p] = f"n{rng.integers(10**6)}"
        texts[i] = " ".join(w)
    for i in range(120, 160):
        texts[i] = " ".join([*base[:25], *(f"u{rng.integers(10**6)}" for _ in range(40))])
    for i in range(160, 200):
        texts[i] = texts[0]
    for i in range(200, 240):
        texts[i] = " ".join(f"q{x}" for x in rng.integers(0, 6, rng.integers(1, 12)))
    texts |= {300 + i: t for i, t in enumerate(HARD)}
    df = spark.createDataFrame([(d, t, 1) for d, t in texts.items()], "doc_id long, text string, g long").repartition(3)
    assert near(df) == classes(texts)


def test_regrouped_keeps_the_small_parts_of_a_list(spark):
    # Key 1 is dealt over two parts, one large and one small; key 2 holds the same large part.
    rows = [(1, g, True) for g in range(10)] + [(1, g, False) for g in (20, 21, 22)] + [(2, g, True) for g in range(10)] + [(3, g, False) for g in (30, 31)]
    got = collections.defaultdict(set)
    for r in jaccard_join._regrouped(spark.createDataFrame(rows, "head long, g long, large boolean")).collect():
        got[r.head].add(r.g)
    assert sorted(map(sorted, got.values())) == [[*range(10), 20, 21, 22], [30, 31]]


def test_near_duplicates_edges(spark):
    assert near(docs_of(spark, []).where("false")) == {}
    df = docs_of(spark, ["a b c d e f", "a b c d e f", None])
    df = df.union(df).union(spark.createDataFrame([(None, "a b c d e f", None, None, None)], df.schema))
    got = jaccard_join.near_duplicates(df).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 2), (2, 2)]


def test_near_duplicates_shared_ids(spark):
    """Two texts under one doc_id are verified each by its own text; repeated rows are copies; null ids are left out."""
    w = lambda a, n: " ".join(f"w{a}x{j}" for j in range(n))
    rows = [(5, w(1, 60)), (5, w(2, 60)), (6, w(1, 60) + " end"), (7, w(2, 60) + " end"), (8, w(3, 60)), (8, w(3, 60)), (None, w(1, 60)), (9, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("g", F.lit("clash")).withColumn("n", F.lit(1))
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.near_duplicates(df).collect())
    assert got == [(5, 56, 5, 1), (5, 56, 5, 1), (6, 57, 5, 1), (7, 57, 5, 1), (8, 56, 8, 0), (8, 56, 8, 0), (9, 0, 9, 0), (9, 0, 9, 0)]


def test_parity_bitmaps_bound_the_difference():
    rng = np.random.default_rng(8)
    for n, m in ((3, 4), (60, 70), (64, 65), (300, 420), (1000, 1300)):
        pool = rng.integers(1, 1 << 63, n + m, dtype=np.uint64)
        a, b = X.distinct(pool[:n]), X.distinct(np.concatenate([pool[: n // 2], pool[n:]]))
        assert jaccard_join._apart(jaccard_join._bits(a), jaccard_join._bits(b)) <= len(np.setxor1d(a, b))


def test_components(spark):
    rng = np.random.default_rng(9)
    ids = rng.integers(-(1 << 62), 1 << 62, 300)
    edges = [(int(ids[i]), int(ids[i + 1])) for i in range(120)] + [(int(ids[130]), int(ids[131 + j])) for j in range(60)] + [(int(ids[250]), int(ids[250]))]
    got = {r.g: r.comp for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[int(x)] for x in ids[:121]}) == 1 and len({got[int(x)] for x in ids[130:191]}) == 1
    assert got[int(ids[0])] != got[int(ids[130])] and int(ids[250]) not in got
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0




# 9. Decontamination.


def passages(texts, items, share=0.6, least=8):
    split = lambda t: re.split(r"[ \t\n\x0b\f\r]+", t.strip(" \t\n\x0b\f\r").lower()) if t and t.strip(" \t\n\x0b\f\r") else []
    out = set()
    for d, t in texts.items():
        w = split(t)
        for k, it in items.items():
            b = split(it)
            for g in range(-len(b) + 1, len(w)):
                m = sum(1 for j in range(len(b)) if 0 <= g + j < len(w) and w[g + j] == b[j])
                if b and m >= min(least, len(b)) and m >= share * len(b):
                    out.add((d, k))
                    break
    return out


def test_decontamination_finds_passages_and_changes(spark, sf, texts):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    some = {d: t for d, t in texts.items() if len(t or "") < 3000}
    rng = np.random.default_rng(1)
    for i, t in enumerate(list(items.values())[:12]):
        w = t.split()
        for p in rng.choice(len(w), max(1, len(w) // 12), replace=False):
            w[p] = "changed"
        some[10**6 + i] = "before it " + " ".join(w) + " after it"
    df = spark.createDataFrame(list(some.items()), "doc_id long, text string")
    it = spark.createDataFrame([*items.items(), (900, "only five words in here"), (901, None), (902, "")], "item_id long, text string")
    some[10**7] = "x only five words in here y"
    df = df.union(spark.createDataFrame([(10**7, some[10**7]), (10**7 + 1, None), (10**7 + 2, "")], df.schema))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, it).collect()}
    assert got == passages(some, items | {900: "only five words in here"})


def test_masks_hit_whatever_the_rule_accepts():
    for n in range(3, 19):
        x = np.arange(1 << n)
        hit = np.zeros(1 << n, bool)
        for m in decontaminate.MASKS:
            for i in range(n - max(m)):
                v = sum(1 << (i + j) for j in m)
                hit |= (x & v) == v
        agree = np.bitwise_count(x)
        assert hit[(agree >= min(decontaminate.LEAST, n)) & (agree >= decontaminate.SHARE * n)].all()


def test_decontamination_with_many_words_replaced(spark):
    rng = np.random.default_rng(2)
    items = {i: " ".join(f"i{i}w{j}" for j in range(n)) for i, n in enumerate((8, 10, 12, 15, 20, 59))}
    some = {}
    for t in items.values():
        n = len(t.split())
        gone = [set(range(3, n, 4)), set(range(0, n, 4)), set(range(2, n, 3)), {j for j in range(n) if j % 5 in (1, 3)}]
        gone += [set(rng.choice(n, int(n * r), replace=False)) for r in (0.2, 0.3, 0.4, 0.45) for _ in range(10)]
        for g in gone:
            some[len(some)] = "before it " + " ".join(f"x{j}" if j in g else w for j, w in enumerate(t.split())) + " after it"
    df = spark.createDataFrame(list(some.items()), "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    assert got == passages(some, items)


def test_decontamination_without_broadcast(spark, sf, monkeypatch):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = sorted(map(tuple, decontaminate.contaminated(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, decontaminate.contaminated(docs, items).collect())) == want
    assert decontaminate.contaminated(docs.where("false"), items).count() == decontaminate.contaminated(docs, items.where("false")).count() == 0


@pytest.mark.parametrize("most", [64 << 20, -1])
def test_decontamination_ids(spark, monkeypatch, most):
    """Null ids, one id with different texts, text ids, short and null items, extra columns."""
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", most)
    items = {1: " ".join(f"w{j}" for j in range(20)), 2: "one", 3: "two words", 4: None, 5: "", 6: " ".join(f"w{j}" for j in range(5, 30))}
    rows = [(None, f"x {items[1]} y"), (None, "nothing"), (13, "so n1 n2 n3 n4 n5 n6 n7 n8 n9"), (7, f"a {items[6]}"), (7, items[1]), (7, "clean"), (7, items[1]), (8, "is ONE of"), (9, "the two words"), (10, None), (11, ""), (12, items[1] * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("key", F.lit(0))
    it = spark.createDataFrame([*items.items(), (None, "n1 n2 n3 n4 n5 n6 n7 n8")], "item_id long, text string").withColumn("n", F.lit(1))
    got = {(r.doc_id, r.item_id): (r.word, r.n_matched) for r in decontaminate.contaminated(df, it).collect()}
    assert got == {(None, 1): (1, 20), (None, 6): (6, 15), (7, 6): (1, 25), (7, 1): (0, 20), (8, 2): (1, 1), (9, 3): (1, 2), (12, 1): (0, 19), (12, 6): (43, 15), (13, None): (1, 8)}
    named = decontaminate.contaminated(df.withColumn("doc_id", F.md5(F.coalesce("text", F.lit("")))), it)
    assert dict(named.dtypes)["doc_id"] == "string" and named.where("item_id = 2").count() == 1


# 10. Packing.


def test_ids_are_the_librarys(texts):
    enc = packing.Encoder(packing.default_tokenizer())
    hard = [*[t for t in HARD if t is not None], "it's  a\n\n 'test' ", "a\t b  \n", "中文 test é", "  ", " 's", "x  y", "tab\t\tend\n "]
    some = [*list(texts.values())[:60], *hard]
    for _ in range(2):  # the second time from the cache
        ids, first = enc.encode(*X.utf8(pa.array(some, pa.string())))
        for i, e in enumerate(enc.tok.encode_batch([t or "" for t in some], add_special_tokens=False)):
            assert ids[first[i] : first[i + 1]].tolist() == e.ids


def test_packing_places_every_piece_once(spark, documents, texts):
    got = packing.pack(packing.pieces(documents, packing.default_tokenizer())).collect()
    tok = packing.encoder(packing.default_tokenizer()).tok
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for d, t in texts.items():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        rs = sorted(by_doc[d], key=lambda r: r.piece)
        assert [r.piece for r in rs] == list(range(len(rs))) and rs[0].start == 0 and sum(r.length for r in rs) == len(ids)
        for i, r in enumerate(rs):
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and (i == 0 or r.length == 2048) and r.length <= 2048
    for places in by_seq.values():
        at = 0
        for a, n in sorted(places):
            assert a == at
            at += n
        assert at <= 2048
    assert len(by_seq) == packing.lower_bound(collections.Counter(r.length for r in got))


def test_packing_edges(spark):
    df = docs_of(spark, [*HARD, *HARD]).union(spark.createDataFrame([(None, "no id", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long"))
    got = packing.pack(packing.pieces(df, packing.default_tokenizer())).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got) and sum(r.doc_id is None for r in got) == 1
    assert packing.pack(packing.pieces(df.where("false"), packing.default_tokenizer())).count() == 0


def fit_alone(hist, size):
    lengths = np.array(sorted(hist))
    return sum(n for _, n in packing.best_fit(lengths, np.array([hist[int(x)] for x in lengths]), size))


def served(plan, size):
    got = collections.Counter()
    for c, n in plan:
        assert sum(k * v for k, v in c.items()) <= size and n > 0
        for k, v in c.items():
            got[k] += n * v
    return got


@pytest.mark.parametrize("seed", range(6))
def test_plan_serves_the_histogram(seed):
    """Every size goes through the LP, none needs more sequences than best fit, and none fewer than the bound."""
    rng = np.random.default_rng(seed)
    size = 512
    low, high = ((1, 513), (170, 300), (257, 500), (1, 40), (100, 513), (60, 200))[seed]
    for pieces in (1, 7, 60, 4000):
        hist = dict(collections.Counter(rng.integers(low, high, pieces).tolist()))
        by_lp, best = packing.rounded_lp(hist, size), packing.plan(hist, size)
        assert served(by_lp, size) == served(best, size) == collections.Counter(hist)
        n = sum(x for _, x in best)
        assert packing.lower_bound(hist, size) <= n <= fit_alone(hist, size) and n <= sum(x for _, x in by_lp)


def test_plan_reaches_the_least_number():
    """Against the true optimum of small cases, by search; in some of them best fit needs more."""
    import functools

    def optimum(items, size):
        @functools.cache
        def go(left):
            if not left:
                return 0
            top, rest = left[-1], left[:-1]
            best = 10**9
            sets = {()}
            for i, x in enumerate(rest):
                sets |= {(*s, i) for s in sets if top + x + sum(rest[j] for j in s) <= size}
            for s in sets:
                best = min(best, 1 + go(tuple(x for i, x in enumerate(rest) if i not in s)))
            return best

        return go(tuple(sorted(items)))

    rng = np.random.default_rng(5)
    better = worse = 0
    for _ in range(60):
        items = rng.integers(2, 14, 9).tolist()
        hist = dict(collections.Counter(items))
        n, least = sum(x for _, x in packing.plan(hist, 20)), optimum(items, 20)
        assert packing.lower_bound(hist, 20) <= least <= n <= fit_alone(hist, 20)
        better += n < fit_alone(hist, 20)
        worse += n > least
    assert worse <= 1
    odd = {2: 2, 3: 2, 5: 2}  # best fit puts 5 with 5 and needs three
    assert sum(x for _, x in packing.plan(odd, 10)) == 2 or fit_alone(odd, 10) == 2


def test_lp_bound_and_average():
    """Pieces over half a sequence: the size bound is far off, the LP's dual is not."""
    lengths, demand = np.array([300, 310, 400]), np.array([50.0, 40.0, 30.0])
    found, bound, prices = packing.solve_lp(lengths, demand, 512, rounds=180)
    assert 118.5 <= bound <= 120 + 1e-6
    cover = np.zeros(3)
    for c, x in found:
        for i, m in c.items():
            cover[i] += m * x
    assert (cover <= demand + 1e-9).all() and (cover > 0.5 * demand).all()
    assert packing.plan({}, 512) == [] and packing.lower_bound({512: 3}, 512) == 3


@pytest.mark.parametrize("group", [1, 3])
def test_packing_ranks_over_many_salts(spark, monkeypatch, group):
    monkeypatch.setattr(packing, "GROUP", group)
    df = docs_of(spark, ["same words here"] * 40 + ["one two three four five"] * 25 + ["word " * 5000] * 3)
    got = packing.pack(packing.pieces(df, packing.default_tokenizer())).collect()
    by_seq = collections.defaultdict(list)
    for r in got:
        by_seq[r.sequence_id].append((r.offset, r.length))
    for places in by_seq.values():
        at = 0
        for a, n in sorted(places):
            assert a == at
            at += n
        assert at <= 2048
    assert len({r.sequence_id for r in got if r.length == 2048}) == 6 and len(by_seq) <= math.ceil(sum(r.length for r in got) / 2048) + 1


def test_knapsack_brute_force():
    rng = np.random.default_rng(1)
    lengths, value = np.array([3, 5, 7]), rng.random(3)
    worth = lambda c: sum(value[i] * n for i, n in c.items())
    k = packing.Knapsack(value, lengths, 21)
    every = [c for c in np.ndindex(8, 5, 4) if 3 * c[0] + 5 * c[1] + 7 * c[2] <= 21]
    best = max(float(value @ c) for c in every)
    assert math.isclose(k.best[21], best) and math.isclose(worth(k.within(21)), best)
    for i in range(3):
        assert math.isclose(worth(k.with_one(i)), max(float(value @ c) for c in every if c[i]))
