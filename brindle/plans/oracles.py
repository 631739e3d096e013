"""DuckDB SQL of whole methods: trees, consensus, voting and alignment, for the queries of the same names."""

from __future__ import annotations

from ..functions.stats import uniform_duck
from . import fixtures as X
from . import queries as Q
from . import tree_sql as T

rd = Q.rd
ORACLES: dict[str, str] = {}


def rec(sql: str) -> str:
    return sql.replace("with ", "with recursive ", 1)


def put(name: str, *parts: str) -> None:
    """CTEs, joined by commas, and the select at the end."""
    ORACLES[name] = ",\n".join(parts[:-1]) + "\n" + parts[-1]


# Distances of the two sources, rounded as the queries round them, so that ties are ties in both engines.
TWO = rec(Q._TWO) + ", pp as (select 1 as src, i, j, round(d, 9) as d from p1 union all select 2 as src, i, j, round(d, 9) as d from p2), half as (select i, j, sum(0.5::double * d) as d from pp group by i, j)"
ONE = TWO + ", p as (select i, j, d from pp where src = 1)"
SHARE = rec(f"with {Q.PARTS}") + ", sh as (select a.obj as i, b.obj as j, sum(case when a.cluster = b.cluster then 1 else 0 end) / 3.0::double as s from parts a join parts b on a.src = b.src and a.obj < b.obj group by a.obj, b.obj), p as (select i, j, 1 - s as d from sh), objs as (select distinct obj from parts)"
LABELS = "select cast({0} as int) as src, obj, cluster from l{1}"

for _l in ("average", "single", "complete", "ward", "weighted", "flexible", "ward.D", "centroid", "median", "mcquitty"):
    put(f"agnes_{_l.replace('.', '_')}", ONE, T.agglomeration(_l), T.merges())
put("cophenetic", ONE, T.agglomeration("ward"), T.members(), T.cophenetic(), f"select cast(1 as int) as src, i, j, {rd('d')} as d from co")
put("cophenetic_mean", TWO, T.agglomeration("average", "pp", by="src"), T.members(by="src"), T.cophenetic(by="src"), f"select i, j, {rd('avg(d)')} as d from co group by i, j")
put("hclust_of_labels", ONE, T.agglomeration("ward"), T.cut("4"), LABELS.format(1, ""))
put("cluster_cols", ONE, T.agglomeration("ward"), T.cut("4"), T.leaves(), "select lo.obj, cast(pos as int) as pos, cluster, case cluster when 1 then '#1F77B4' when 2 then '#FF7F0E' when 3 then '#2CA02C' else '#D62728' end as color from lo join l on l.obj = lo.obj")
put("weighted_clust", TWO, T.agglomeration("ward", "half"), T.cut("4"), LABELS.format(5, ""))

_MERGED = f"""with recursive cells as (select '1:' || feat as feat, obj, val from ({X.SQL_EVENTS}) a union all select '2:' || feat, obj, val from ({X.SQL_PRESENCE}) b), e as (select feat, max(val) - min(val) as rg from cells group by feat),
p as (select a.obj as i, b.obj as j, round(sum(abs(a.val - b.val) / rg) / count(*), 12) as d from cells a join cells b on a.feat = b.feat and a.obj < b.obj join e on e.feat = a.feat and rg > 0 group by a.obj, b.obj)"""
put("adc", _MERGED, T.agglomeration("flexible"), T.cut("4"), LABELS.format(0, ""))

put(
    "dist_fisher_yates_gower", Q._RANK, f"t as (select distinct rk, {Q.qnorm_sql('(rk / (n + 1.0))')} as t from k)",
    "y as (select q.obj, q.feat, a.t + (q.ar - floor(q.ar)) * (b.t - a.t) as val from q join t a on a.rk = floor(q.ar) join t b on b.rk = ceil(q.ar))",
    "e as (select feat, max(val) - min(val) as rg from y group by feat)",
    f"g as (select a.obj as i, b.obj as j, {rd('sum(abs(a.val - b.val) / rg) / count(*)')} as d from y a join y b on a.feat = b.feat and a.obj < b.obj join e on e.feat = a.feat and rg > 0 group by a.obj, b.obj)",
    "select i, j, d from g",
)


def agreement_of(a: str, b: str) -> tuple[str, str]:
    """CTE and select of ari, nmi, jaccard and purity of two label tables."""
    return (
        f"""ct as (select x.cluster as a, y.cluster as b, cast(count(*) as double) as n from {a} x join {b} y on x.obj = y.obj group by x.cluster, y.cluster), rw as (select sum(n * (n - 1) / 2) as sr, sum(n * ln(n)) as hr from (select sum(n) as n from ct group by a) z),
cl as (select sum(n * (n - 1) / 2) as sc, sum(n * ln(n)) as hc from (select sum(n) as n from ct group by b) z), al as (select sum(n * (n - 1) / 2) as s, sum(n * ln(n)) as h, sum(n) as t from ct), pu as (select sum(m) as top from (select max(n) as m from ct group by a) z)""",
        f"select {rd('(s - sr * sc / (t * (t - 1) / 2)) / ((sr + sc) / 2 - sr * sc / (t * (t - 1) / 2))')} as ari, {rd('2 * (h / t - hr / t - hc / t + ln(t)) / (2 * ln(t) - hr / t - hc / t)')} as nmi, {rd('s / (sr + sc - s)')} as jaccard, {rd('top / t')} as purity from rw, cl, al, pu",
    )


put("compare_clusterings", TWO, T.agglomeration("ward.D2", "pp", by="src"), T.cut("greatest(2, floor(sqrt(n)))", by="src"), "la as (select obj, cluster from l where src = 1)", "lb as (select obj, cluster from l where src = 2)", *agreement_of("la", "lb"))

# Weighting on membership: cuts at 3 to 7 classes.
put(
    "wonm", TWO, T.agglomeration("flexible", "pp", by="src"), "ks as (select range as nk from range(3, 8))",
    "mk as (select ks.nk, m.* from m cross join ks where m.step <= (select count(distinct obj) from o) - ks.nk)",
    "ck as (select ks.nk, src, obj, k as root from o cross join ks union all select r.nk, r.src, r.obj, mk.mi from ck r join mk on mk.mj = r.root and mk.src = r.src and mk.nk = r.nk)",
    "lk as (select nk, src, obj, min(root) as cluster from ck group by nk, src, obj)",
    "xx as (select a.src, a.obj as i, b.obj as j, avg(case when a.cluster = b.cluster then 1.0 else 0.0 end) as s from lk a join lk b on a.src = b.src and a.nk = b.nk and a.obj < b.obj group by a.src, a.obj, b.obj)",
    "wp as (select i, j, round(1 - avg(s), 9) as d from xx group by i, j)", T.agglomeration("ward", "wp", "w"), T.cut("4", "w", tree="w"), LABELS.format(0, "w"),
)

# Partitions of the same objects.
put("ensemble_cspa", SHARE, T.agglomeration("average"), T.cut("4"), LABELS.format(0, ""))
put("evidence_sl_agnes", SHARE, T.agglomeration("single"), T.cut("4"), LABELS.format(0, ""))
put("clustering_aggregation_aggl", SHARE, T.agglomeration("average"), T.cut("n - (select count(*) from m where h < 0.8)", tree=""), LABELS.format(0, ""))
put("evidence_sl", SHARE, "ed as (select i, j from sh where s > 0.4)", T.components("ed", "objs"), "select cast(0 as int) as src, obj, cluster from k")
put("evidence_mst", SHARE, "ed as (select i, j from sh where s >= 0.4)", T.components("ed", "objs"), "select cast(0 as int) as src, obj, cluster from k")
_CLASSES = "cn as (select obj, src * 1000 + cluster as c, lpad(cast(src * 1000 + cluster as varchar), 6, '0') as p from parts), cz as (select p, count(*) as n from cn group by p)"
put(
    "ensemble_mcla", SHARE, _CLASSES,
    "cj as (select x.p as i, y.p as j, 1 - coalesce(w.b, 0) / greatest(x.n + y.n - coalesce(w.b, 0), 1)::double as d from cz x join cz y on x.p < y.p left join (select a.p, b.p as q, count(*) as b from cn a join cn b on a.obj = b.obj group by a.p, b.p) w on w.p = x.p and w.q = y.p)",
    T.agglomeration("average", "cj", "c"), T.cut("4", "c", tree="c"), "ms as (select cluster as meta, count(*) as n from lc group by cluster)",
    "vt as (select cn.obj, lc.cluster as meta, count(*) / any_value(ms.n)::double as v from cn join lc on lc.obj = cn.p join ms on ms.meta = lc.cluster group by cn.obj, lc.cluster)",
    "wn as (select obj, meta from (select *, row_number() over (partition by obj order by v desc, meta) as r from vt) z where r = 1)",
    "fs as (select meta, min(obj) as first from wn group by meta)", "select cast(0 as int) as src, obj, cast(dense_rank() over (order by first) as int) as cluster from wn join fs on fs.meta = wn.meta",
)
put(
    "clustering_aggregation_balls", SHARE, "bp as (select i, j, d from p union all select j, i, d from p)",
    "od as (select i as obj, row_number() over (order by round(sum(d), 9), i) as ord from bp group by i)",
    """bl as (select 0 as step, obj, ord, null::int as c from od union all
select step + 1, obj, ord, case when c is null and (obj = u or (near and mean <= 0.5)) then step + 1 else c end from (
select *, avg(case when near then d end) over () as mean from (select s.*, s.u <> s.obj and s.c is null and q.d <= 0.5 as near, q.d from (select *, first_value(obj) over (order by c is not null, ord) as u from bl) s left join bp q on q.i = s.u and q.j = s.obj) t) v
where exists (select 1 from bl where c is null))""",
    "be as (select obj, max(c) as c from bl group by obj)", "fs as (select c, min(obj) as first from be group by c)", "select cast(0 as int) as src, obj, cast(dense_rank() over (order by first) as int) as cluster from be join fs on fs.c = be.c",
)

# Voting.
_WIN = "select obj, ref as cluster from (select *, row_number() over (partition by obj order by round(p, 9) desc, ref) as r from {0}) z where r = 1"
ORACLES["cvaa"] = f"{Q._VOTE} {_WIN.format('u2')}"
put(
    "wcvaa_merged", rec(f"with {Q.PARTS}"), "rf as (select obj, cluster from parts where src = 3)", "ks as (select distinct cluster as ref from rf)", "u0 as (select obj, ref, case when cluster = ref then 1.0::double else 0.0::double end as p from rf cross join ks)",
    "en as (select src, sum(-n / t * ln(n / t)) as h from (select src, cast(count(*) as double) as n, sum(count(*)) over (partition by src) as t from parts where src < 3 group by src, cluster) z group by src)",
    "sc as (select src, h / (select max(h) from en) as sc, row_number() over (order by h desc, src) as pl from en)",
    "q1 as (select parts.*, sc from parts join sc on sc.src = parts.src and pl = 1)", "q2 as (select parts.*, sc from parts join sc on sc.src = parts.src and pl = 2)",
    "u1 as (select u.obj, ref, sc * avg(p) over (partition by q.cluster, ref) as p from u0 u join q1 q on q.obj = u.obj)", "u2 as (select u.obj, ref, (p + sc * avg(p) over (partition by q.cluster, ref)) / 2 as p from u1 u join q2 q on q.obj = u.obj)",
    "qn as (select obj, ref, p / sum(p) over (partition by ref) as p from u2)", "hh as (select ref, -sum(case when p > 0 then p * ln(p) else 0 end) as h from qn group by ref)",
    "js as (select lpad(cast(a.ref as varchar), 4, '0') as i, lpad(cast(b.ref as varchar), 4, '0') as j, round(greatest(-sum(case when a.p + b.p > 0 then (a.p + b.p) / 2 * ln((a.p + b.p) / 2) else 0 end) - (any_value(x.h) + any_value(y.h)) / 2, 0), 9) as d from qn a join qn b on a.obj = b.obj and a.ref < b.ref join hh x on x.ref = a.ref join hh y on y.ref = b.ref group by a.ref, b.ref)",
    T.agglomeration("average", "js"), T.cut("3"), "mg as (select u2.obj, l.cluster as ref, sum(p) as p from u2 join l on cast(l.obj as int) = u2.ref group by u2.obj, l.cluster)", _WIN.format("mg"),
)
_START = f"c0 as (select obj, cast(floor({uniform_duck(chr(39) + '1|' + chr(39) + ' || obj')} * 4) as int) + 1 as c from (select distinct obj from parts) z)"


def _rounds(step: str, after: str = "") -> list[str]:
    out = []
    for n in range(6):
        out.append(step.replace("{cur}", f"c{n}").replace("{n}", str(n)).replace("{next}", f"c{n + 1}"))
    return out


_IVC = """n{n} as (select c, src, cluster, count(*) as n from parts join {cur} on {cur}.obj = parts.obj group by c, src, cluster), m{n} as (select c, src, cluster as mode from (select *, row_number() over (partition by c, src order by n desc, cluster) as k from n{n}) z where k = 1),
d{n} as (select obj, c, sum(case when cluster <> mode then 1 else 0 end) as miss from parts join m{n} on m{n}.src = parts.src group by obj, c), {next} as (select obj, c from (select *, row_number() over (partition by obj order by miss, c) as k from d{n}) z where k = 1)"""
_IPVC = """n{n} as (select c, src, cluster, count(*) as n from parts join {cur} on {cur}.obj = parts.obj group by c, src, cluster), t{n} as (select c, src, sum(n) as t from n{n} group by c, src), cs{n} as (select distinct c from {cur}),
d{n} as (select parts.obj, x.c, sum(1 - coalesce(y.n / z.t, 0.0)) as d from parts cross join cs{n} x left join n{n} y on y.c = x.c and y.src = parts.src and y.cluster = parts.cluster left join t{n} z on z.c = x.c and z.src = parts.src group by parts.obj, x.c), {next} as (select obj, c from (select *, row_number() over (partition by obj order by round(d, 9), c) as k from d{n}) z where k = 1)"""
_IPC = """z{n} as (select c, count(*) as n from {cur} group by c), g{n} as (select i, q.c, sum(s) as t from both_ join {cur} q on q.obj = j group by i, q.c), x{n} as (select g.i, g.c, case when g.c = o.c then t / greatest(n - 1, 1) else t / n end as m from g{n} g join {cur} o on o.obj = g.i join z{n} z on z.c = g.c),
y{n} as (select i, c from (select *, row_number() over (partition by i order by round(m, 9) desc, c) as k from x{n}) w where k = 1), {next} as (select a.obj, coalesce(y.c, a.c) as c from {cur} a left join y{n} y on y.i = a.obj)"""
for _n, _s in (("ivc", _IVC), ("ipvc", _IPVC), ("ipc", _IPC)):
    put(f"consensus_{_n}", SHARE, "both_ as (select i, j, s from sh where s > 0 union all select j, i, s from sh where s > 0)", _START, *_rounds(_s), "select obj, c as cluster from c6")

# Hierarchies.
_DEPTH = """sz as (select src, step, count(*) as n, any_value(h) as h from mb group by src, step),
ins as (select a.src, a.step, b.step as out, count(*) as n from mb a join mb b on a.src = b.src and a.obj = b.obj group by a.src, a.step, b.step), dp as (select ins.src, ins.step, count(*) - 1 as depth from ins join sz on sz.src = ins.src and sz.step = ins.step where ins.n = sz.n group by ins.src, ins.step),
en as (select src, min(h) as lo, max(h) as hi from sz group by src), tp as (select src, max(depth) as top from dp group by src),
vv as (select dp.src, dp.step, depth * (1 - case when lo < 0 or hi > 1 then (h - lo) / (hi - lo) else h end) / greatest(top, 1) as v from dp join sz on sz.src = dp.src and sz.step = dp.step join en on en.src = dp.src join tp on tp.src = dp.src),
th as (select a.obj as i, b.obj as j, sum(v) as s from mb a join mb b on a.src = b.src and a.step = b.step and a.obj < b.obj join vv on vv.src = a.src and vv.step = a.step group by a.obj, b.obj)"""
put("ehc_theta", TWO, T.agglomeration("flexible", "pp", by="src"), T.members(by="src"), _DEPTH, f"select i, j, {rd('s')} as s from th")
put(
    "hec", TWO, T.agglomeration("flexible", "pp", by="src"), T.members(by="src"), T.cophenetic(by="src"), "mean_ as (select i, j, avg(d) as d from co group by i, j)",
    T.agglomeration("single", "mean_", "x"), T.members("x"), T.cophenetic("x"), T.agglomeration("single", "cox", "y"), T.cut("4", "y", tree="y"), LABELS.format(0, "y"),
)

# Link-based similarity of classes.
_NAMED = "nm as (select obj, src, cast(src as varchar) || ':' || cast(cluster as varchar) as p from parts)"


def _linked(classes: str) -> str:
    return f"p as (select a.obj as i, b.obj as j, round(1 - avg(coalesce(cast(x.s as double), 0.0)), 12) as d from nm a join nm b on a.src = b.src and a.obj < b.obj left join {classes} x on x.p = a.p and x.q = b.p group by a.obj, b.obj)"


put("link_based_labels_cts", rec(Q._CTS), _NAMED, _linked("cts"), T.agglomeration("ward"), T.cut("4"), LABELS.format(0, ""))
_ASRS = """cas as (select a.obj as i, b.obj as j, count(*) / 3.0 as s from parts a join parts b on a.src = b.src and a.cluster = b.cluster group by a.obj, b.obj), zz as (select p, count(*) as n from nm group by p), xa as (select a.p, b.p as q, sum(s) as t from cas join nm a on a.obj = cas.i join nm b on b.obj = cas.j group by a.p, b.p),
ya as (select xa.p, xa.q, t / (sa.n * sb.n) as s from xa join zz sa on sa.p = xa.p join zz sb on sb.p = xa.q), asrs as (select p, q, case when p = q then 1.0 else s / (select max(s) from ya where p <> q) * 0.8 end as s from ya)"""
put("link_based_labels_asrs", rec(f"with {Q.PARTS}"), _NAMED, _ASRS, _linked("asrs"), T.agglomeration("ward"), T.cut("4"), LABELS.format(0, ""))
_SRS = [_NAMED, "kk as (select p, count(*) as n from nm group by p)", "s0 as (select a.p, b.p as q, case when a.p = b.p then 1.0::double else 0.0::double end as s from kk a cross join kk b)"]
for _r in range(5):
    _SRS += [
        f"ob{_r} as (select a.obj as i, b.obj as j, case when a.obj = b.obj then 1.0::double else 0.8 * avg(s) end as s from nm a join s{_r} x on x.p = a.p join nm b on b.p = x.q group by a.obj, b.obj)",
        f"s{_r + 1} as (select a.p, b.p as q, case when a.p = b.p then 1.0::double else 0.8 * avg(s) end as s from ob{_r} x join nm a on a.obj = x.i join nm b on b.obj = x.j group by a.p, b.p)",
    ]
_SRS.append("srs as (select p, q, case when p = q then 1.0 else s / (select max(s) from s5 where p <> q) * 0.8 end as s from s5)")
put("srs_similarity", rec(f"with {Q.PARTS}"), *_SRS, f"select p, q, {rd('s')} as s from srs")
put("link_based_labels_srs", rec(f"with {Q.PARTS}"), *_SRS, _linked("srs"), T.agglomeration("ward"), T.cut("4"), LABELS.format(0, ""))

# Sampled cuts.

def _sampled(cells: str, iters: int, r: int, tries: int = 20) -> str:
    """CTE cs(it, src, obj, feat, val): r features by hash order in each iteration; of `tries` draws the first in which no object's values sum to zero, or the last."""
    key = "'1|' || cast(f.src as varchar) || '|' || cast(t.it as varchar) || '|' || f.feat || case when w.a = 0 then '' else '|' || cast(w.a as varchar) end"
    return f"""cells as ({cells}), dr as (select src, it, a, feat from (select f.src, t.it, w.a, f.feat, row_number() over (partition by f.src, t.it, w.a order by {uniform_duck(key)}, f.feat) as pl from (select distinct src, feat from cells) f cross join (select range as it from range(1, {iters + 1})) t cross join (select range as a from range(0, {tries})) w) z where pl <= {r}),
em as (select distinct src, it, a from (select dr.src, it, a, obj, sum(val) as s from dr join cells on cells.src = dr.src and cells.feat = dr.feat group by dr.src, it, a, obj) z where s = 0),
pk as (select src, it, coalesce(min(a) filter (where not exists (select 1 from em where em.src = q.src and em.it = q.it and em.a = q.a)), {tries - 1}) as a from (select distinct src, it, a from dr) q group by src, it),
cs as (select dr.it, cells.* from dr join pk on pk.src = dr.src and pk.it = dr.it and pk.a = dr.a join cells on cells.src = dr.src and cells.feat = dr.feat)"""


_CUTS35 = """ks as (select unnest([3, 5]) as nk), mk as (select ks.nk, m.* from m cross join ks where m.step <= (select count(distinct obj) from o) - ks.nk),
ck as (select ks.nk, g, obj, k as root from o cross join ks union all select r.nk, r.g, r.obj, mk.mi from ck r join mk on mk.mj = r.root and mk.g = r.g and mk.nk = r.nk), lk as (select nk, g, obj, min(root) as cluster from ck group by nk, g, obj)"""
put(
    "adec", "with recursive " + _sampled(f"select 0 as src, obj, '2:' || feat as feat, val from ({X.SQL_PRESENCE}) z", 5, 30),
    "sp as (select a.it as g, a.obj as i, b.obj as j, 1 - case when sum(a.val + b.val - a.val * b.val) > 0 then sum(a.val * b.val) / sum(a.val + b.val - a.val * b.val) else 0.0 end as d from cs a join cs b on a.it = b.it and a.feat = b.feat and a.obj < b.obj group by a.it, a.obj, b.obj)",
    T.agglomeration("flexible", "sp", by="g"), _CUTS35, "ic as (select a.obj as i, b.obj as j, sum(case when a.cluster <> b.cluster then 1 else 0 end)::double as d from lk a join lk b on a.nk = b.nk and a.g = b.g and a.obj < b.obj group by a.obj, b.obj)",
    T.agglomeration("ward", "ic", "w"), T.cut("4", "w", tree="w"), LABELS.format(0, "w"),
)
put(
    "cec", "with recursive " + _sampled(f"{X.SQL_EVENTS} union all {X.SQL_PRESENCE}", 4, 8), "rg as (select src, it, feat, max(val) - min(val) as rg from cs group by src, it, feat)",
    "sp as (select a.src * 100 + a.it as g, a.obj as i, b.obj as j, round(sum(abs(a.val - b.val) / rg) / count(*), 12) as d from cs a join cs b on a.src = b.src and a.it = b.it and a.feat = b.feat and a.obj < b.obj join rg on rg.src = a.src and rg.it = a.it and rg.feat = a.feat and rg > 0 group by a.src, a.it, a.obj, b.obj)",
    T.agglomeration("flexible", "sp", by="g"), _CUTS35,
    "ic as (select a.g // 100 as src, a.obj as i, b.obj as j, sum(case when a.cluster <> b.cluster then 1 else 0 end)::double as d from lk a join lk b on a.nk = b.nk and a.g = b.g and a.obj < b.obj group by a.g // 100, a.obj, b.obj)",
    "hf as (select i, j, sum(0.5::double * d) as d from ic group by i, j)", T.agglomeration("ward", "hf", "w"), T.cut("4", "w", tree="w"), LABELS.format(5, "w"),
)

# Selection of weights.
put(
    "weight_by_similarity", TWO, T.agglomeration("ward", "pp", by="src"), T.cut("3", by="src"), "gw as (select unnest([0.0, 0.25, 0.5, 0.75, 1.0])::double as w)", "gp as (select w, i, j, sum(case when src = 1 then w else 1 - w end * d) as d from pp cross join gw group by w, i, j)",
    T.agglomeration("ward", "gp", "g", by="w"), T.cut("3", "g", by="w", tree="g"), "cn as (select lg.w, l.src, lg.cluster as a, l.cluster as b, count(*)::double as n from lg join l on l.obj = lg.obj group by lg.w, l.src, lg.cluster, l.cluster)",
    "js as (select s.w, s.src, s / (rr + k - s) as jac from (select w, src, sum(n * (n - 1) / 2) as s from cn group by w, src) s join (select w, src, sum(n * (n - 1) / 2) as rr from (select w, src, a, sum(n) as n from cn group by w, src, a) z group by w, src) x on x.w = s.w and x.src = s.src join (select w, src, sum(n * (n - 1) / 2) as k from (select w, src, b, sum(n) as n from cn group by w, src, b) z group by w, src) y on y.w = s.w and y.src = s.src)",
    "ds as (select a.w as weight, abs(a.jac / b.jac - 1) as distance from js a join js b on a.w = b.w and a.src = 1 and b.src = 2)", f"select weight, {rd('distance')} as distance, weight = (select weight from ds order by distance, weight limit 1) as best from ds",
)

# Alignment and plots.
_MATCH = """rf as (select obj, cluster as r from parts where src = 1), rs as (select r, count(*) as nr from rf group by r),
sr as (select src as method, rs.r, cluster as o, count(*) / any_value(nr)::double as s from parts join rf on rf.obj = parts.obj join rs on rs.r = rf.r group by src, rs.r, cluster),
sq as (select *, row_number() over (partition by method order by s desc, r, o) as rn from sr),
gr as (select method, 0::bigint as rn, []::int[] as rr, []::int[] as oo from (select distinct method from sr) z union all
select gr.method, sq.rn, case when list_contains(rr, sq.r) or list_contains(oo, sq.o) then rr else list_append(rr, sq.r) end, case when list_contains(rr, sq.r) or list_contains(oo, sq.o) then oo else list_append(oo, sq.o) end from gr join sq on sq.method = gr.method and sq.rn = gr.rn + 1),
ge as (select method, max_by(rr, rn) as rr, max_by(oo, rn) as oo from gr group by method), mt as (select method, unnest(rr) as label, unnest(oo) as o from ge),
al as (select a.method, a.o, coalesce(mt.label, (select max(r) from rs) + row_number() over (partition by a.method, mt.label is null order by a.o)) as label from (select distinct method, o from sr) a left join mt on mt.method = a.method and mt.o = a.o),
aligned as (select p.src as method, p.obj, cast(case when p.src = 1 then p.cluster else al.label end as int) as label from parts p join al on al.method = p.src and al.o = p.cluster)"""
put("reorder_to_reference", rec(f"with {Q.PARTS}"), _MATCH, "select method, obj, label from aligned")
put("compare_single_multi", rec(f"with {Q.PARTS}"), _MATCH, "si as (select a.method, avg(case when a.label = b.label then 1.0 else 0.0 end) as share from aligned a join aligned b on b.obj = a.obj and b.method = 1 group by a.method)", f"select case when a.method < 3 then 'single' else 'multi' end as kind, a.method, label, obj, {rd('share')} as share from aligned a join si on si.method = a.method")
_PLOT = f"""with {Q.ALIGNED}, n as (select method, label, count(*) as n from aligned group by method, label), d as (select method, count(*) as d from n group by method), o as (select obj, row_number() over (order by label, obj) as pos from aligned where method = 1),
cp as (select a.method, a.obj, cast(o.pos as int) as pos, cast(case when n.n = 1 then 5000 else a.label end as int) as label, case when d.d = 1 then '#BEBEBE' when n.n = 1 then '#FFFFFF' when a.label = 1 then '#1F77B4' when a.label = 2 then '#FF7F0E' else '#2CA02C' end as color from aligned a join n on n.method = a.method and n.label = a.label join d on d.method = a.method join o on o.obj = a.obj)"""
ORACLES["compare_plot"] = f"{_PLOT} select method, obj, pos, label, color from cp"
ORACLES["cyclogram"] = f"{_PLOT} select method, obj, pos, label, color, {rd('2 * 3.141592653589793 * (pos - 1) / count(*) over (partition by method)')} as angle, method as ring from cp"


# Bags: sampled features by rank weights, drawn objects, and what is made of them.
def _bagged(iters: int) -> list[str]:
    """CTE cs(src, it, obj, feat, val) of both sources' bags."""
    n1, n2 = Q.bisect_weight_c(10), Q.bisect_weight_c(60)
    u = uniform_duck("'1|' || cast(w.src as varchar) || '|' || cast(t.it as varchar) || '|' || w.feat")
    b = uniform_duck("'1|boot|' || cast(o.src as varchar) || '|' || cast(t.it as varchar) || '|' || cast(o.place as varchar)")
    return [
        f"with recursive cells as ({X.SQL_EVENTS} union all {X.SQL_PRESENCE})",
        f"rk as (select src, feat, row_number() over (partition by src order by round(v, 12) desc, feat) as rk, count(*) over (partition by src) as g from (select src, feat, coalesce(var_samp(val), 0.0) as v from cells group by src, feat) z), rw as (select src, feat, g, 1 / (rk + case when g = 10 then {n1!r} else {n2!r} end) as raw from rk), w as (select src, feat, g, raw / sum(raw) over (partition by src) as p from rw)",
        f"fs as (select src, it, feat from (select w.src, t.it, w.feat, g, row_number() over (partition by w.src, t.it order by -ln(greatest({u}, 1e-12)) / p, w.feat) as pl from w cross join (select range as it from range(1, {iters + 1})) t) z where pl <= greatest(2, floor(sqrt(g))))",
        "ob as (select src, obj, row_number() over (partition by src order by obj) as place, count(*) over (partition by src) as n from (select distinct src, obj from cells) z)",
        f"dr as (select distinct o.src, t.it, cast(floor({b} * n) as bigint) + 1 as place from ob o cross join (select range as it from range(1, {iters + 1})) t)",
        "cs as (select fs.it, c.* from cells c join fs on fs.src = c.src and fs.feat = c.feat join ob on ob.src = c.src and ob.obj = c.obj join dr on dr.src = c.src and dr.it = fs.it and dr.place = ob.place)",
        "rg as (select src, it, feat, max(val) - min(val) as rg from cs group by src, it, feat)",
        "bd as (select a.src, a.it, a.obj as i, b.obj as j, sum(case when rg > 0 then abs(a.val - b.val) / rg end) / count(case when rg > 0 then 1 end) as g, sqrt(sum(power(a.val - b.val, 2))) as l2 from cs a join cs b on a.src = b.src and a.it = b.it and a.feat = b.feat and a.obj < b.obj join rg on rg.src = a.src and rg.it = a.it and rg.feat = a.feat group by a.src, a.it, a.obj, b.obj)",
    ]


put("abc_labels", *_bagged(3), "sp as (select src * 100 + it as g, i, j, round(coalesce(g, l2), 12) as d from bd)", T.agglomeration("ward.D2", "sp", by="g"), T.cut("4", by="g"), "select cast(g // 100 as int) as src, cast(g % 100 as int) as iter, obj, cluster from l")
put(
    "m_abc_whole", *_bagged(3), "sp as (select src * 100 + it as g, i, j, round(coalesce(g, l2), 12) as d from bd)", T.agglomeration("ward.D2", "sp", by="g"), T.cut("5", by="g"),
    "cc as (select a.obj as i, b.obj as j, count(*) as n, sum(case when a.cluster = b.cluster then 1 else 0 end) as s from l a join l b on a.g = b.g and a.obj < b.obj group by a.obj, b.obj)",
    "ao as (select distinct obj from l)", "cp as (select a.obj as i, b.obj as j, sqrt(greatest(0.0, 1 - power(coalesce(s / n::double, 0.0), 2))) as d from ao a join ao b on a.obj < b.obj left join cc on cc.i = a.obj and cc.j = b.obj)",
    T.agglomeration("ward", "cp", "w"), T.cut("4", "w", tree="w"), LABELS.format(0, "w"),
)
_DIST = "mn as (select src, i, j, avg(coalesce(g, l2)) as d from bd group by src, i, j), tp as (select src, max(d) as m from mn group by src), fd as (select a.src, a.obj as i, b.obj as j, coalesce(mn.d, m) / case when m > 0 then m else 1.0 end as d from ob a join ob b on a.src = b.src and a.obj < b.obj join tp on tp.src = a.src left join mn on mn.src = a.src and mn.i = a.obj and mn.j = b.obj)"
put("m_abcdist_pairs", *_bagged(6), _DIST, f"select cast(src as int) as src, i, j, {rd('d')} as d from fd")
put("m_abcdist", *_bagged(10), _DIST, "hf as (select i, j, sum(0.5::double * d) as d from fd group by i, j)", T.agglomeration("ward", "hf"), T.cut("4"), LABELS.format(0, ""))
ORACLES["cluster_plot"] = ORACLES["cluster_cols"]
put("m_abcdist_wc", *_bagged(6), _DIST, "hf as (select i, j, sum(0.5::double * d) as d from fd group by i, j)", T.agglomeration("ward", "hf"), T.cut("4"), LABELS.format(5, ""))

# Weighted ward: costs by Lance and Williams from the first costs, with weights as sizes; heights are running means of the sorted costs.
put(
    "weighted_hclust", rec(f"with {Q.CELLS}"), "wt as (select distinct obj, cast(cast(obj as int) % 4 + 1 as double) as w from cells)",
    "p as (select a.obj as i, b.obj as j, sum(power(a.val - b.val, 2)) * any_value(x.w) * any_value(y.w) / (any_value(x.w) + any_value(y.w)) as d from cells a join cells b on a.feat = b.feat and a.obj < b.obj join wt x on x.obj = a.obj join wt y on y.obj = b.obj group by a.obj, b.obj)",
    T.agglomeration("ward.D", weights="wt"), "hh as (select row_number() over (order by h) as step, sum(h) over (order by h rows unbounded preceding) / row_number() over (order by h) as h from m)",
    f"select cast(0 as int) as src, cast(m.step as int) as step, cast(li as int) as \"left\", cast(lj as int) as \"right\", {rd('hh.h')} as height from m join hh on hh.step = m.step",
)

# Similarity network fusion of two sources: local kernels, then diffusion of each through the other.
_SNF = [
    TWO, "names as (select distinct i as obj from pp union select distinct j from pp)",
    "bp as materialized (select src, i, j, d from pp union all select src, j, i, d from pp union all select s.src, obj, obj, 0.0 from names cross join (select distinct src from pp) s)",
    "nr as (select src, i, avg(d) + 2.220446e-16 as m from (select *, row_number() over (partition by src, i order by d, i <> j, j) as r from bp) z where r between 2 and 21 group by src, i)",
    "sg as (select bp.src, bp.i, bp.j, d, greatest((x.m + y.m + d) / 3, 2.220446e-16) * 0.5 as s from bp join nr x on x.src = bp.src and x.i = bp.i join nr y on y.src = bp.src and y.i = bp.j)",
    "af as materialized (select src, i, j, exp(-power(d / s, 2) / 2) / (s * sqrt(2 * pi())) as v from sg)",
    "lc as materialized (select src, i, j, v / sum(v) over (partition by src, i) as v from (select *, row_number() over (partition by src, i order by v desc, j) as r from af) z where r <= 20)",
]


def _full(table: str, name: str) -> list[str]:
    return [
        f"{name}x as materialized (select src, i, j, case when i = j then 0.5 else v / (2 * case when rest = 0 then 1 else rest end) end as v from (select *, sum(case when i = j then 0 else v end) over (partition by src, i) as rest from {table}) z)",
        f"{name} as materialized (select a.src, a.i, a.j, (a.v + b.v) / 2 as v from {name}x a join {name}x b on b.src = a.src and b.i = a.j and b.j = a.i)",
    ]


_SNF += _full("af", "f0")
for _r in range(20):
    _SNF += [
        f"h{_r} as materialized (select a.src, a.i, p.j, sum(a.v * p.v) as v from lc a join f{_r} p on p.src <> a.src and p.i = a.j group by a.src, a.i, p.j)",
        f"g{_r} as materialized (select a.src, h.i, a.i as j, sum(h.v * a.v) as v from h{_r} h join lc a on a.src = h.src and a.j = h.j group by a.src, h.i, a.i)",
        *_full(f"g{_r}", f"f{_r + 1}"),
    ]
put(
    "snf", *_SNF, "ww as (select i, j, avg(v) as v from f20 group by i, j)", "wn as (select i, j, v / sum(v) over (partition by i) as v from ww)",
    "fu as (select a.i, a.j, 1 - (a.v + b.v) / 2 as d from wn a join wn b on b.i = a.j and b.j = a.i where a.i < a.j)", T.agglomeration("ward", "fu", "w"), T.cut("4", "w", tree="w"), LABELS.format(0, "w"),
)


# Student's t: the incomplete beta function by its continued fraction, a step a row.
_BETA = """bt as (select grp, feat, df / 2 as a0, df / (df + t * t) as x0, df / (df + t * t) > (df / 2 + 1) / (df / 2 + 2.5) as turned from tt), bu as (select grp, feat, turned, case when turned then 0.5 else a0 end as a, case when turned then a0 else 0.5 end as b, case when turned then 1 - x0 else x0 end as x from bt),
cf as (select *, 1 as m, 1.0::double as c, 1 / (1 - (a + b) * x / (a + 1)) as d, 1 / (1 - (a + b) * x / (a + 1)) as h from bu union all
select grp, feat, turned, a, b, x, m + 1, 1 + n2 / c1, 1 / (1 + n2 * d1), h1 * (1 / (1 + n2 * d1)) * (1 + n2 / c1) from (select *, -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)) as n2, h * d1 * c1 as h1 from (
select *, 1 / (1 + n1 * d) as d1, 1 + n1 / c as c1 from (select *, m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) as n1 from cf where m < 120) q1) q2) q3),
be as (select grp, feat, turned, exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * ln(x) + b * ln(1 - x)) * h / a as i from cf where m = 120), tp as (select grp, feat, case when turned then 1 - i else i end as p from be)"""
put(
    "characteristic_features", rec(Q._FISH), f"ce as ({X.SQL_EVENTS})", "xs as (select g.grp, c.feat, c.val, case when m.grp = g.grp then 1 else 0 end as ins from ce c join grp m on m.obj = c.obj cross join (select distinct grp from grp) g)",
    "su as (select grp, feat, count(*) filter (where ins = 1) as n1, count(*) filter (where ins = 0) as n2, avg(val) filter (where ins = 1) as m1, avg(val) filter (where ins = 0) as m2, var_samp(val) filter (where ins = 1) as v1, var_samp(val) filter (where ins = 0) as v2 from xs group by grp, feat)",
    "tt as (select grp, feat, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) as t, power(v1 / n1 + v2 / n2, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v2 / n2, 2) / (n2 - 1)) as df from su where n1 > 1 and n2 > 1 and v1 / n1 + v2 / n2 > 1e-12)", _BETA,
    "al as (select grp, 'binary' as kind, feat, p from fp union all select grp, 'continuous' as kind, feat, p from tp)", "ra as (select *, row_number() over (partition by grp, kind order by round(p, 12), feat) as rk, count(*) over (partition by grp, kind) as m from al)",
    "ad as (select *, least(1.0, min(p * m / rk) over (partition by grp, kind order by rk desc rows between unbounded preceding and current row)) as adj_p from ra)", f"select grp, kind, feat, {rd('p')} as p, {rd('adj_p')} as adj_p from ad where rk <= 10",
)


def _digamma(x: str) -> str:
    y = f"({x} + 6)"
    return f"(ln({y}) - 0.5 / {y} - 1 / ({y} * {y}) * (1 / 12.0 - 1 / ({y} * {y}) * (1 / 120.0 - 1 / ({y} * {y}) / 252.0)) - {' - '.join(f'1 / ({x} + {k})' for k in range(6))})"


def _trigamma(x: str) -> str:
    y = f"({x} + 6)"
    return f"(1 / {y} + 0.5 / ({y} * {y}) + 1 / ({y} * {y} * {y}) * (1 / 6.0 - 1 / ({y} * {y}) * (1 / 30.0 - 1 / ({y} * {y}) / 42.0)) + {' + '.join(f'1 / (({x} + {k}) * ({x} + {k}))' for k in range(6))})"


def _moderated(groups: str) -> list[str]:
    """CTEs tt(grp, feat, diff, t, df) and tp(grp, feat, p) of the moderated tests of groups(grp, obj)."""
    return [
        f"with recursive ex as ({X.SQL_EXPR.replace('as string', 'as varchar')}), gr as ({groups})",
        "xs as (select g.grp, e.gene, e.val, case when gr.grp = g.grp then 1 else 0 end as ins from ex e left join gr on gr.obj = e.obj cross join (select distinct grp from gr) g)",
        "su as (select grp, gene, count(*) filter (where ins = 1)::double as n1, count(*) filter (where ins = 0)::double as n2, avg(val) filter (where ins = 1) as m1, avg(val) filter (where ins = 0) as m2, sum(val * val) as q from xs group by grp, gene)",
        "tg as (select grp, gene as feat, m1 - m2 as diff, greatest(q - n1 * m1 * m1 - n2 * m2 * m2, 0.0) / (n1 + n2 - 2) as s2, n1 + n2 - 2 as df, 1 / n1 + 1 / n2 as u from su where n1 > 0 and n2 > 0 and n1 + n2 > 2)",
        f"ee as (select grp, ln(s2) - {_digamma('(df / 2)')} + ln(df / 2) as e, {_trigamma('(df / 2)')} as tri from tg where s2 > 0)", "sp as (select grp, var_samp(e) - avg(tri) as spread, avg(e) as mean from ee group by grp)",
        f"bi as (select grp, spread, mean, 0 as n, 1e-6::double as lo, 1e6::double as hi from sp union all select grp, spread, mean, n + 1, case when {_trigamma('mid')} > spread then mid else lo end, case when {_trigamma('mid')} > spread then hi else mid end from (select *, sqrt(lo * hi) as mid from bi where n < 200) z)",
        f"pr as (select grp, case when spread <= 0 then null else 2 * lo end as d0, case when spread <= 0 then exp(mean) else exp(mean + {_digamma('lo')} - ln(lo)) end as s0 from bi where n = 200)",
        "tt as (select tg.grp, feat, diff, diff / sqrt(case when d0 is null then s0 else (d0 * s0 + df * s2) / (d0 + df) end * u) as t, df + coalesce(d0, 1e9) as df from tg join pr on pr.grp = tg.grp)", _BETA,
    ]


put(
    "diff_genes", *_moderated("select distinct cast(obj as int) % 2 + 1 as grp, obj from ex"),
    "ra as (select tt.grp, tt.feat, diff, t, p, row_number() over (partition by tt.grp order by round(p, 12), tt.feat) as rk, count(*) over (partition by tt.grp) as m from tt join tp on tp.grp = tt.grp and tp.feat = tt.feat)",
    "ad as (select *, least(1.0, min(p * m / rk) over (partition by grp order by rk desc rows between unbounded preceding and current row)) as adj_p from ra)", f"select cast(grp as int) as grp, feat as gene, {rd('diff')} as diff, {rd('t')} as t, {rd('p')} as p, {rd('adj_p')} as adj_p from ad where rk <= 10",
)
put(
    "pathway_analysis", *_moderated("select distinct 1 as grp, obj from ex where cast(obj as int) <= 25"), "v as (select feat as gene, -log10(greatest(p, 1e-300)) as v from tp)",
    "kk as (select greatest(1, count(distinct gene) // 10) as k from ex)", "us as (select distinct 's' || cast(cast(substr(gene, 2) as int) % k as varchar) as st, gene from ex cross join kk where gene in (select gene from v))",
    "zs as (select st, count(*) as size from us group by st having count(*) between 5 and 100)", "ob as (select us.st, size, avg(v) as stat from us join zs on zs.st = us.st join v on v.gene = us.gene group by us.st, size)", "ow as (select gene, row_number() over (order by gene) as n from v)",
    f"pl as (select run, v, row_number() over (partition by run order by {uniform_duck(chr(39) + '1|1|' + chr(39) + ' || cast(run as varchar) || ' + chr(39) + '|' + chr(39) + ' || gene')}, gene) as n from v cross join range(1, 41) t(run))",
    "nu as (select us.st, run, avg(pl.v) as nul from us join zs on zs.st = us.st join ow on ow.gene = us.gene join pl on pl.n = ow.n group by us.st, run)",
    "fi as (select nu.st, (run - 1) // 20 as it, any_value(size) as size, any_value(stat) as stat, (sum(case when round(nul, 9) >= round(stat, 9) then 1 else 0 end) + 1) / 21.0::double as p from nu join ob on ob.st = nu.st group by nu.st, (run - 1) // 20)",
    f"select cast(1 as int) as grp, st as \"set\", any_value(size) as size, {rd('avg(stat)')} as stat, {rd('avg(p)')} as p from fi group by st having count(*) = 2",
)

# Neighbourhood fusion of both sources, standardised, to its tree.
put(
    "nemo_tree", f"with recursive cells as ({X.SQL_EVENTS} union all {X.SQL_PRESENCE})", "sd as (select src, obj, feat, coalesce((val - avg(val) over (partition by src, feat)) / nullif(stddev_samp(val) over (partition by src, feat), 0), 0.0) as val from cells)",
    "dd as materialized (select a.src, a.obj as i, b.obj as j, sqrt(sum(power(a.val - b.val, 2))) as d from sd a join sd b on a.src = b.src and a.feat = b.feat and a.obj <> b.obj group by a.src, a.obj, b.obj)",
    "sg as (select src, i, avg(d) as sg from (select *, row_number() over (partition by src, i order by d, j) as n from dd) z where n <= 20 group by src, i)",
    "aa as (select dd.src, dd.i, dd.j, exp(-d * d / greatest(x.sg * y.sg, 1e-300)) as a from dd join sg x on x.src = dd.src and x.i = dd.i join sg y on y.src = dd.src and y.i = dd.j)",
    "kp as (select src, i, j, a from (select *, rank() over (partition by src, i order by round(a, 12) desc) as n from aa) z where n <= 20)", "sy as (select src, i, j, max(a) as a from (select src, i, j, a from kp union all select src, j, i, a from kp) z group by src, i, j)",
    "tt as (select src, i, j, a / sum(a) over (partition by src, i) as s from sy)", "ff as (select src, i, j, sum(s) / 2 as s from (select src, i, j, s from tt union all select src, j, i, s from tt) z group by src, i, j)",
    "fu as (select dd.i, dd.j, avg(coalesce(ff.s, 0.0)) as s from dd left join ff on ff.src = dd.src and ff.i = dd.i and ff.j = dd.j where dd.i < dd.j group by dd.i, dd.j)", "p as (select i, j, 1 - s / (select greatest(max(s), 1e-300) from fu) as d from fu)",
    T.agglomeration("ward"), T.cut("4"), LABELS.format(0, ""),
)
