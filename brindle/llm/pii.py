"""PII: format-preserving Feistel pseudonyms, in DataFrame functions only.

Validated values are found by one pattern and replaced by a keyed permutation of their own domain,
so that equal values become equal pseudonyms in every document, different ones stay different, and
the pseudonym is again a valid value of the same format:

- card: 13 to 19 digits with a valid check digit (plain or in groups); all digits but the check
  digit are permuted and the check digit is made anew; separators stay.
- phone: ten digits, area and exchange from 200 up, after +1 or as (ddd) ddd-dddd, ddd-ddd-dddd or
  ddd.ddd.dddd; both parts stay in range, and the same number in another form gets the same digits.
- intl: + and another country code, 8 to 15 digits in all, in groups or not; the first group (of
  ungrouped ones the first two digits) stays, the other digits are permuted.
- ip: four octets of at most 255.
- ssn: ddd-dd-dddd in the valid ranges.
- date: year-month-day or day/month/year (also with dots) from 1900 to 2099, real days only.  Where
  day or month is written with one digit, the pseudonym's has one digit too: years and days are
  then permuted among the dates of that width, 29 February among the leap years.
- email: letters and digits of the whole part before @ are permuted, each within its class, 24 at
  a time, keyed by their place and by what stands before them.

A value is split in two parts of sizes M1 and M2, which in turn take the sum with a keyed hash of
the other, modulo their size: a permutation for any sizes.  The round function is SHA-256 over key,
kind, round, sizes, tweak and half.  The key has no default.  What does not validate stays as it is.

No pattern repeats a group without a bound, as such groups recurse in the JVM's matcher, and every
run of characters is scanned a bounded number of times, so that hostile texts cost linear time.

Defined results: null text stays null, with no values; empty text stays empty; repeated rows are
treated alike; other columns are kept, also one named like the column of found values, which then
takes the next free name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import free_name

ROUNDS = 8
FIRST_DAY, DAYS, DAYS_1, DAYS_2 = "1900-01-01", 73049, 17, 4297  # 1900 to 2099; 17 * 4297 days
BLOCK, SEGMENT = 24, 64  # letters and digits of an email that are permuted at once; characters that are cut at once

#: The kinds and their patterns, in the order in which they are tried at one place.
PATTERNS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]*[A-Za-z0-9-]\.[A-Za-z]{2,}"),
    ("phone", r"\+1[ .-]?(?:\([2-9][0-9]{2}\)|[2-9][0-9]{2})[ .-]?[2-9][0-9]{2}[ .-]?[0-9]{4}(?![0-9])|(?<![0-9A-Za-z+(.-])(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[.-])[2-9][0-9]{2}[.-][0-9]{4}(?![0-9.-][0-9])(?![0-9])"),
    ("intl", r"(?<![0-9A-Za-z+])\+[2-9][0-9]{0,2}(?:[ .-][0-9]{2,4}){2,5}(?![0-9])|(?<![0-9A-Za-z+])\+[2-9][0-9]{7,14}(?![0-9])"),
    ("card", r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5})(?![0-9])"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("date", r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9/-])"),
)
#: All kinds; all but the first start with a digit, a plus or a bracket, so that at a letter only one of them is tried.
ANY = PATTERNS[0][1] + "|(?=[0-9+(])(?:" + "|".join(p for _, p in PATTERNS[1:]) + ")"
KINDS = [k for k, _ in PATTERNS]
#: The key of the registered queries, whose tables are synthetic; any other use passes its own.
DEMO_KEY = "synthetic tables only"


def key_of(spark: SparkSession) -> str:
    """The key of this session: spark.brindle.pii.key, or the one for synthetic tables."""
    return spark.conf.get("spark.brindle.pii.key", DEMO_KEY)


def feistel(kind: str, a: Column, b: Column, m1: Column, m2: Column, key: str, tweak: Column | None = None) -> Column:
    """struct(a, b) with 0 <= a < m1 and 0 <= b < m2 (bigint), permuted."""
    tweak = F.lit("") if tweak is None else tweak

    def hashed(i: Column, half: Column) -> Column:
        said = F.concat_ws("\x1f", F.lit(key), F.lit(kind), i.cast("string"), m1.cast("string"), m2.cast("string"), tweak, half.cast("string"))
        return F.conv(F.substring(F.sha2(said, 256), 1, 15), 16, 10).cast("bigint")

    def step(acc: Column, i: Column) -> Column:
        return F.when(
            i % 2 == 0, F.struct(F.pmod(acc["a"] + F.pmod(hashed(i, acc["b"]), m1), m1).alias("a"), acc["b"].alias("b"))
        ).otherwise(F.struct(acc["a"].alias("a"), F.pmod(acc["b"] + F.pmod(hashed(i, acc["a"]), m2), m2).alias("b")))

    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _let(value: Column, f) -> Column:
    """Binds an expression, so that it is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))



def _zero_pad(x: Column, n: Column) -> Column:
    return F.concat(F.repeat(F.lit("0"), n - F.length(x.cast("string"))), x.cast("string"))


def _fill(shape: Column, digits: Column) -> Column:
    """The digits of shape replaced in turn by those of digits; all else stays."""
    step = lambda acc, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(acc["s"], F.substr(digits, acc["i"], F.lit(1))).alias("s"), (acc["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(acc["s"], c).alias("s"), acc["i"].alias("i")))
    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("s"), F.lit(1).alias("i")), step)["s"]


def luhn_sum(digits: Column, doubled_last: bool) -> Column:
    """Sum of the check rule over digits from the right; doubled_last: the last digit counts twice."""
    off = 0 if doubled_last else 1

    def one(c: Column, i: Column) -> Column:
        v = c.cast("int")
        twice = v * 2
        return F.when((i + off) % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(v)

    return F.aggregate(F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), one), F.lit(0), lambda x, y: x + y)


def _card(m: Column, key: str) -> Column:
    def made(d: Column) -> Column:
        n = F.length(d) - 1
        h = F.floor(n / 2).cast("int")
        one = lambda k: F.pow(F.lit(10), k).cast("bigint")
        left, right = F.substr(d, F.lit(1), h).cast("bigint"), F.substr(d, h + 1, n - h).cast("bigint")
        body = lambda s: F.concat(_zero_pad(s["a"], h), _zero_pad(s["b"], n - h))
        check = lambda b: F.concat(b, F.pmod(F.lit(10) - luhn_sum(b, True) % 10, F.lit(10)).cast("string"))
        return _let(_let(feistel("card", left, right, one(h), one(n - h), key), body), check)

    return _let(F.regexp_replace(m, "[^0-9]", ""), lambda d: F.when(luhn_sum(d, False) % 10 == 0, _fill(m, made(d))).otherwise(m))


def _phone(m: Column, key: str) -> Column:
    def made(d: Column) -> Column:
        last = F.right(d, F.lit(10))
        area, rest = F.substr(last, F.lit(1), F.lit(3)).cast("bigint"), F.substr(last, F.lit(4), F.lit(7)).cast("bigint")
        mixed = feistel("phone", area - 200, rest - 2_000_000, F.lit(800).cast("bigint"), F.lit(8_000_000).cast("bigint"), key)
        code = F.when(F.length(d) > 10, F.lit("1")).otherwise(F.lit(""))
        return _let(mixed, lambda s: F.concat(code, (s["a"] + 200).cast("string"), (s["b"] + 2_000_000).cast("string")))

    return _fill(m, _let(F.regexp_replace(m, "[^0-9]", ""), made))


def _intl(m: Column, key: str) -> Column:
    """The digits after the country's group, as a number in two halves."""
    first = F.when(m.rlike("^\\+[0-9]+$"), F.lit(2)).otherwise(F.length(F.regexp_extract(m, "^\\+([0-9]+)", 1)))
    one = lambda k: F.pow(F.lit(10), k).cast("bigint")

    def made(d: Column) -> Column:
        def of(n: Column) -> Column:
            h = F.floor(n / 2).cast("int")
            left, right = F.substr(d, first + 1, h).cast("bigint"), F.substr(d, first + h + 1, n - h).cast("bigint")
            body = lambda s: F.concat(F.substr(d, F.lit(1), first), _zero_pad(s["a"], h), _zero_pad(s["b"], n - h))
            return _let(feistel("intl", left, right, one(h), one(n - h), key, F.substr(d, F.lit(1), first)), body)

        return F.when((F.length(d) >= 8) & (F.length(d) <= 15), _fill(m, _let(F.length(d) - first, of))).otherwise(m)

    return _let(F.regexp_replace(m, "[^0-9]", ""), made)


def _ip(m: Column, key: str) -> Column:
    def made(p: Column) -> Column:
        v = lambda i: F.get(p, F.lit(i)).cast("bigint")
        out = lambda s: F.concat_ws(".", F.floor(s["a"] / 256).cast("string"), (s["a"] % 256).cast("string"), F.floor(s["b"] / 256).cast("string"), (s["b"] % 256).cast("string"))
        mixed = feistel("ip", v(0) * 256 + v(1), v(2) * 256 + v(3), F.lit(65536).cast("bigint"), F.lit(65536).cast("bigint"), key)
        return F.when(F.forall(p, lambda x: x.cast("int") < 256), _let(mixed, out)).otherwise(m)

    return _let(F.split(m, r"\."), made)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substr(m, F.lit(i), F.lit(n)).cast("bigint") for i, n in ((1, 3), (5, 2), (8, 4)))
    ok = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    rank = F.when(area > 666, area - 2).otherwise(area - 1)
    mixed = feistel("ssn", rank, (group - 1) * 9999 + serial - 1, F.lit(898).cast("bigint"), F.lit(99 * 9999).cast("bigint"), key)

    def out(s: Column) -> Column:
        a = F.when(s["a"] >= 665, s["a"] + 2).otherwise(s["a"] + 1)
        g = F.floor(s["b"] / 9999)
        return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad((g + 1).cast("string"), 2, "0"), F.lpad((s["b"] - g * 9999 + 1).cast("string"), 4, "0"))

    return F.when(ok, _let(mixed, out)).otherwise(m)


def _date(m: Column, key: str) -> Column:
    iso = m.rlike("^[0-9]{4}-")
    sep = F.regexp_extract(m, "[-/.]", 0)
    part = lambda i: F.get(F.split(m, "[-/.]"), F.lit(i))
    big = lambda v: F.lit(v).cast("bigint")
    pad = lambda v: F.lpad(v.cast("string"), 2, "0")
    year, month, day = F.when(iso, part(0)).otherwise(part(2)).cast("int"), part(1).cast("int"), F.when(iso, part(2)).otherwise(part(0)).cast("int")
    short_day, short_month = F.length(F.when(iso, part(2)).otherwise(part(0))) == 1, F.length(part(1)) == 1
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), pad(month), pad(day))
    number = F.datediff(F.try_to_date(text, "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date")).cast("bigint")
    written = lambda d, mo, y: F.concat_ws("", F.when(short_day, d.cast("string")).otherwise(pad(d)), sep, F.when(short_month, mo.cast("string")).otherwise(pad(mo)), sep, y.cast("string"))

    def full(n: Column) -> Column:
        def out(s: Column) -> Column:
            x = F.date_add(F.lit(FIRST_DAY).cast("date"), (s["a"] * DAYS_2 + s["b"]).cast("int"))
            return F.when(iso, F.date_format(x, "yyyy-MM-dd")).otherwise(written(F.dayofmonth(x), F.month(x), F.year(x)))

        return _let(feistel("date", F.floor(n / DAYS_2), n % DAYS_2, big(DAYS_1), big(DAYS_2), key), out)

    months = F.when(short_month, F.lit(9)).otherwise(F.lit(12))
    few = feistel("date d", year - 1900, (month - 1) * 9 + day - 1, big(200), (months * 9).cast("bigint"), key)  # days of one digit
    few_out = lambda s: written((s["b"] % 9 + 1).cast("int"), (F.floor(s["b"] / 9) + 1).cast("int"), s["a"] + 1900)
    leap = feistel("date leap", F.floor((year - 1904) / 4), big(0), big(49), big(1), key)
    leap_out = lambda s: written(F.lit(29), F.lit(2), s["a"] * 4 + 1904)
    # Months of one digit: the day's place in a year without 29 February, 273 of them up to September.
    place = F.datediff(F.try_to_date(F.concat(F.lit("2001-"), pad(month), F.lit("-"), pad(day)), "yyyy-MM-dd"), F.lit("2001-01-01").cast("date"))
    nine = feistel("date m", year - 1900, place, big(200), big(273), key)

    def nine_out(s: Column) -> Column:
        x = F.date_add(F.lit("2001-01-01").cast("date"), s["b"].cast("int"))
        return written(F.dayofmonth(x), F.month(x), s["a"] + 1900)

    def made(n: Column) -> Column:
        is_leap = (month == 2) & (day == 29)
        short = F.when(short_day, _let(few, few_out)).when(is_leap, _let(leap, leap_out)).otherwise(_let(nine, nine_out))
        return F.when((n >= 0) & (n < DAYS), F.when(iso | ~(short_day | short_month), full(n)).otherwise(short)).otherwise(m)

    return _let(number, made)


def _email(m: Column, key: str) -> Column:
    """The part before @ in segments; of each, letters and digits in blocks, as mixed-radix numbers in two halves."""
    local, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    radix = lambda c: F.when(c.rlike("[0-9]"), F.lit(10)).when(c.rlike("[A-Za-z]"), F.lit(26))
    base = lambda c: F.when(c.rlike("[0-9]"), F.lit(48)).when(c.rlike("[a-z]"), F.lit(97)).otherwise(F.lit(65))
    one = F.lit(1)

    def number(cs: Column) -> Column:
        return F.aggregate(cs, F.lit(0).cast("bigint"), lambda acc, c: acc * radix(c) + (F.ascii(c) - base(c)))

    def span(cs: Column) -> Column:
        return F.aggregate(cs, F.lit(1).cast("bigint"), lambda acc, c: acc * radix(c))

    def spell(v: Column, cs: Column) -> Column:
        start = F.struct(v.alias("v"), F.lit("").alias("s"))
        step = lambda acc, c: F.struct(F.call_function("div", acc["v"], radix(c)).alias("v"), F.concat(F.char(base(c) + acc["v"] % radix(c)), acc["s"]).alias("s"))
        return F.aggregate(F.reverse(cs), start, step)["s"]

    def block(cs: Column, tweak: Column) -> Column:
        h = F.floor(F.size(cs) / 2).cast("int")
        left, right = F.slice(cs, one, h), F.slice(cs, h + 1, F.size(cs) - h)
        mixed = feistel("email", number(left), number(right), span(left), span(right), key, tweak)
        return _let(mixed, lambda s: F.concat(spell(s["a"], left), spell(s["b"], right)))

    def segment(text: Column, before: Column, at: Column) -> Column:
        def of(cs: Column) -> Column:
            n = F.ceil(F.size(cs) / BLOCK).cast("int")
            cut = lambda j: F.slice(cs, j * BLOCK + 1, F.lit(BLOCK))
            tweak = lambda j: F.concat_ws("|", at.cast("string"), j.cast("string"), before, F.array_join(F.slice(cs, one, j * BLOCK), ""))
            word = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda j: block(cut(j), tweak(j))), "")
            step = lambda w: F.aggregate(
                F.split(text, ""),
                F.struct(F.lit("").alias("s"), one.alias("i")),
                lambda acc, c: F.when(c.rlike("[A-Za-z0-9]"), F.struct(F.concat(acc["s"], F.substr(w, acc["i"], one)).alias("s"), (acc["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(acc["s"], c).alias("s"), acc["i"].alias("i"))),
            )["s"]
            return F.when(F.size(cs) > 0, _let(word, step)).otherwise(text)

        return _let(F.filter(F.split(text, ""), lambda c: c.rlike("[A-Za-z0-9]")), of)

    def made(parts: Column) -> Column:
        each = F.transform(parts, lambda p, j: segment(p, F.coalesce(F.get(parts, j - 1), F.lit("")), j))
        return F.concat(F.array_join(each, ""), F.lit("@"), host)

    return _let(F.regexp_extract_all(local, F.lit(f".{{1,{SEGMENT}}}"), F.lit(0)), made)


MAKE = {"email": _email, "phone": _phone, "intl": _intl, "card": _card, "ip": _ip, "ssn": _ssn, "date": _date}


def kind_of(m: Column) -> Column:
    """Kind of a match, by shape."""
    return (
        F.when(F.instr(m, "@") > 0, F.lit("email"))
        .when(m.startswith("+1") | m.startswith("(") | m.rlike(r"^[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}$"), F.lit("phone"))
        .when(m.startswith("+"), F.lit("intl"))
        .when(m.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), F.lit("ip"))
        .when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.lit("ssn"))
        .when(m.rlike(r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[/.][0-9]{1,2}[/.][0-9]{4})$"), F.lit("date"))
        .otherwise(F.lit("card"))
    )


def pseudonym(m: Column, key: str) -> Column:
    kind = kind_of(m)
    out = None
    for k in KINDS:
        out = F.when(kind == k, MAKE[k](m, key)) if out is None else out.when(kind == k, MAKE[k](m, key))
    return out.otherwise(m)


def pseudonymise(docs: DataFrame, key: str, text: str = "text", found: str = "found") -> DataFrame:
    """docs with text pseudonymised, and found: array of (kind, value, pseudonym), changed ones only.

    Where docs has a column of that name, the new one takes the name with underscores after it.
    """
    found = free_name(docs, found)
    t, f = F.col(f"`{text}`"), F.col(f"`{found}`")
    some = t.rlike("[0-9]") | (F.instr(t, "@") > 0)  # every kind has a digit or an @
    hits = docs.withColumn(found, F.when(some, F.regexp_extract_all(t, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")))
    hits = hits.withColumn(found, F.transform(f, lambda m: F.struct(kind_of(m).alias("kind"), m.alias("value"), pseudonym(m, key).alias("pseudonym"))))
    parts = F.split(t, ANY, -1)
    joined = F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(f, i)["pseudonym"], F.lit("")))), "")
    out = hits.withColumn(text, F.when(F.size(f) > 0, joined).otherwise(t))
    return out.withColumn(found, F.filter(f, lambda x: x["value"] != x["pseudonym"]))


def op7_feistel_pseudonyms(spark, sf_dir: str) -> DataFrame:
    done = pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), key_of(spark))
    count = lambda k: F.size(F.filter("found", lambda f: f["kind"] == k)).cast("long").alias(f"n_{k}")
    return done.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.size("found").cast("long").alias("n_values"), *[count(k) for k in KINDS])
