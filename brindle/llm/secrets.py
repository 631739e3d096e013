"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

One pass finds the spans of the base kinds (assign, access, hex) and the candidates of a wider one
(owned: runs of 20 or more of letters, digits and + / _ - with letters and digits, outside base
spans).  Values are hashed and counted over the corpus by distinct owner and by distinct
repository, pre-aggregated by (value, owner, repository), so that a value in a third of all rows is
still one row for each owner before the last step.  Both counts decide:

- example: `wide_owners` owners or more have the value;
- copied: fewer owners, but `wide_repositories` repositories or more: spread within its owners, as
  vendored files and templates are;
- live: owner-specific in few repositories, and so looks like a credential in use.

Base spans stay whatever their class; a candidate of the wider kind becomes a span only while it is
live.  Verdicts come back to the rows by a join on the value; frequent values, of which there are
COMMON_VALUES at most by the way they are chosen, are broadcast, so that no join key is hot.

Owners and repositories are column expressions; by default a document's source is its owner and
each document a repository.

Defined results: null text counts as empty, with no spans and the digest of the empty string; a
null owner is an owner of its own, a null repository a repository; repeated rows stay rows of their
own and are one repository; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import stage

#: The patterns of the base kinds, in the order of the listing; the wider kind comes last.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # a maximal run: what a shorter match would leave out is dropped anyway
OWNED = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "owned")
WIDE_OWNERS, WIDE_REPOSITORIES = 3, 20
COMMON_VALUES, COMMON_LEAST = 100_000, 1000  # values that are broadcast, at most, and their occurrences, at least
BLOCK = 64  # matches of a text that are taken at once
SPAN = "array<struct<start:bigint,kind:int,end:bigint,value:bigint>>"


def _let(value: Column, f) -> Column:
    """Binds an expression, so that it is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _blocks(items: Column) -> Column:
    """An array cut in blocks: appending within blocks and over blocks keeps long arrays from quadratic copying."""
    last = F.ceil(F.size(items) / BLOCK).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda j: F.slice(items, j * BLOCK + 1, F.lit(BLOCK)))


def _spans(text: Column, pattern: str, kind: int, value_group: int, least_whole: int, least_value: int) -> Column:
    """All matches as structs, in order, with places in code points; those that are too short are left out."""

    def made(whole: Column) -> Column:
        each = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)), whole, lambda p, w: F.struct(F.length(p).alias("gap"), w.alias("w"), F.length(w).alias("n")))
        return F.when(F.size(whole) > 0, _let(_let(each, _blocks), placed)).otherwise(F.array().cast(SPAN))

    def placed(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda acc, m: acc + m["gap"] + m["n"]))
        first = F.aggregate(sums, F.array(F.lit(0).cast("bigint")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        return _let(first, lambda at: F.flatten(F.transform(blocks, lambda b, j: F.aggregate(b, F.struct(F.get(at, j).alias("at"), F.array().cast(SPAN).alias("out")), step)["out"])))

    def step(acc: Column, m: Column) -> Column:
        a = acc["at"] + m["gap"]
        b = a + m["n"]
        value = F.regexp_extract(m["w"], pattern, value_group) if value_group else m["w"]
        ok = (m["n"] >= least_whole) & (F.length(value) >= least_value)
        one = F.array(F.struct(a.cast("bigint").alias("start"), F.lit(kind).alias("kind"), b.cast("bigint").alias("end"), F.xxhash64(value).alias("value")))
        return F.struct(b.cast("bigint").alias("at"), F.when(ok, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), made)


def _outside(wide: Column, base: Column) -> Column:
    """Spans of wide that no span of base overlaps; base is looked through by blocks of one kind, by their first and last place."""

    def by_blocks(blocks: Column) -> Column:
        ends = F.transform(F.filter(blocks, lambda b: F.size(b) > 0), lambda b: F.struct(F.get(b, F.lit(0))["start"].alias("lo"), F.element_at(b, -1)["end"].alias("hi"), b.alias("b")))
        meets = lambda w, x: (x["lo"] < w["end"]) & (w["start"] < x["hi"]) & F.exists(x["b"], lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"]))
        return _let(ends, lambda e: F.filter(wide, lambda w: ~F.exists(e, lambda x: meets(w, x))))

    def of(kind: int) -> Column:
        return _blocks(F.filter(base, lambda s: s["kind"] == kind))

    return F.when((F.size(base) == 0) | (F.size(wide) == 0), wide).otherwise(_let(F.concat(*map(of, range(3))), by_blocks))


def scan(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """doc_id, owner, repository, base and owned spans of every row."""
    t = F.coalesce(F.col("text"), F.lit(""))
    both = (t.rlike("[A-Za-z]")) & (t.rlike("[0-9]"))
    none = F.array().cast(SPAN)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), owner.cast("string").alias("owner"), repository.cast("string").alias("repository"),
        F.concat(
            F.when(both | t.rlike("[:=]"), _spans(t, ASSIGN, 0, 2, 0, 6)).otherwise(none),
            F.when(F.instr(t, "AKIA") > 0, _spans(t, ACCESS, 1, 0, 20, 0)).otherwise(none),
            _spans(t, HEX, 2, 0, 24, 0),
        ).alias("base"),
        F.when(both, _spans(t, OWNED, 3, 0, 20, 0)).otherwise(none).alias("wide"),
    )
    rows = rows.withColumn("wide", _outside(F.col("wide"), F.col("base")))
    return rows.select("doc_id", "owner", "repository", "base", "wide", F.monotonically_increasing_id().alias("row"))


def frequencies(found: DataFrame) -> DataFrame:
    """(value, n_owners, n_repositories, n) over the corpus; n counts occurrences."""
    one = found.select("owner", "repository", F.explode(F.concat("base", "wide")).alias("s")).select(F.col("s.value").alias("value"), "owner", "repository")
    by_repo = one.groupBy("value", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("value", "owner").agg(F.count("*").alias("r"), F.sum("n").alias("n"))
    return by_owner.groupBy("value").agg(F.count("*").alias("n_owners"), F.sum("r").alias("n_repositories"), F.sum("n").alias("n"))


LIVE, EXAMPLE, COPIED = 0, 1, 2


def verdicts(freq: DataFrame, wide_owners: int = WIDE_OWNERS, wide_repositories: int = WIDE_REPOSITORIES) -> DataFrame:
    """freq and verdict: live, example or copied."""
    verdict = F.when(F.col("n_owners") >= wide_owners, EXAMPLE).when(F.col("n_repositories") >= wide_repositories, COPIED).otherwise(LIVE)
    return freq.withColumn("verdict", verdict.cast("bigint"))


def _listing(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, owner: Column | None = None, repository: Column | None = None, wide_owners: int = WIDE_OWNERS, wide_repositories: int = WIDE_REPOSITORIES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, n_copied, most_owners, most_repositories: one row for each row of docs."""
    owner = F.col("source") if owner is None else owner
    repository = F.col("doc_id") if repository is None else repository
    found = stage(scan(docs, owner, repository), "secrets")
    freq = stage(verdicts(frequencies(found), wide_owners, wide_repositories), "owners")
    total = freq.agg(F.sum("n")).first()[0] or 0
    # Values of a share of 1 / COMMON_VALUES of all occurrences or more number COMMON_VALUES at most.
    common = F.col("n") >= max(COMMON_LEAST, -(-total // COMMON_VALUES))
    of = freq.select("value", F.struct("verdict", "n_owners", "n_repositories").alias("f"), common.alias("common"))
    each = found.select("row", F.explode(F.concat("base", "wide")).alias("s")).select("row", "s", F.col("s.value").alias("value"))
    each = each.join(F.broadcast(of.where("common").select("value", F.col("f").alias("c"))), "value", "left")
    rare = of.where("not common").select("value", "f")
    known = each.where("c is not null").select("row", "s", F.col("c").alias("f")).union(each.where("c is null").join(rare, "value").select("row", "s", "f"))
    known = known.select("row", F.struct("s.start", "s.kind", "s.end", F.col("f.verdict").alias("value")).alias("s"), "f")
    by_row = known.groupBy("row").agg(F.collect_list("s").alias("all"), F.max("f.n_owners").alias("most_owners"), F.max("f.n_repositories").alias("most_repositories"))
    none = F.array().cast(SPAN)
    rows = found.join(by_row, "row", "left").withColumn("all", F.coalesce("all", none))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    told = lambda v: F.size(F.filter("all", lambda s: s["value"] == v)).cast("long")
    kept = F.filter("all", lambda s: (s["kind"] < 3) | (s["value"] == LIVE))
    zero = F.lit(0).cast("long")
    return rows.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_listing(F.col("base")), 256).alias("base_sha256"), _listing(kept).alias("spans"),
        told(LIVE).alias("n_live"), told(EXAMPLE).alias("n_example"), told(COPIED).alias("n_copied"),
        F.coalesce("most_owners", zero).alias("most_owners"), F.coalesce("most_repositories", zero).alias("most_repositories"),
    )


def op2_ownership_secrets(spark, sf_dir: str) -> DataFrame:
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
