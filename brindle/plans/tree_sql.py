"""DuckDB SQL of trees: agglomeration, cuts and cophenetic distances as recursive common table expressions.

Every builder gives a list of CTEs over a table p(i, j, d), i < j, of one source.  The working table
of `agglomeration` holds the pairs of living clusters; a step takes the least pair, merges it by the
Lance-Williams formula and hands on the pairs that remain.
"""

from __future__ import annotations

#: New distance of a cluster of size sk from the merged ones (sizes si, sj; distances di, dj; their own h), by linkage.
FORMULA = {
    "single": "least(di, dj)",
    "complete": "greatest(di, dj)",
    "average": "(si * di + sj * dj) / (si + sj)",
    "mcquitty": "0.5::double * (di + dj)",
    "weighted": "0.5::double * (di + dj)",
    "ward": "((sk + si) * di + (sk + sj) * dj - sk * h) / (sk + si + sj)",
    "ward.D2": "((sk + si) * di + (sk + sj) * dj - sk * h) / (sk + si + sj)",
    "ward.D": "((sk + si) * di + (sk + sj) * dj - sk * h) / (sk + si + sj)",
    "centroid": "(si * di + sj * dj) / (si + sj) - si * sj * h / power(si + sj, 2)",
    "median": "0.5::double * di + 0.5::double * dj - 0.25::double * h",
    "flexible": "{alpha}::double * (di + dj) + (1 - 2 * {alpha}::double) * h",
}
SQUARED = ("ward", "ward.D2", "centroid", "median")


def agglomeration(method: str, pairs: str = "p", tag: str = "", alpha: float = 0.625, by: str | None = None, weights: str | None = None) -> str:
    """CTEs o{tag}(obj, k), s{tag}, m{tag}(step, mi, mj, h, li, lj): objects by number, states, and merges. by: a column of pairs that tells trees apart; weights: a table (obj, w) of sizes instead of 1."""
    g = f"{by}, " if by else ""
    on = f" and a.{by} = {pairs}.{by} and b.{by} = {pairs}.{by}" if by else ""
    base = "cast(d as double) * cast(d as double)" if method in SQUARED else "cast(d as double)"
    height = "sqrt(greatest(d, 0.0::double))" if method in SQUARED else "d"
    part = f"partition by {by} " if by else ""
    new = FORMULA[method].format(alpha=alpha)
    size = lambda x: f"(select w from {weights} where {weights}.obj = {x}.obj)" if weights else "1.0::double"
    return f"""o{tag} as (select {g}obj, row_number() over ({part}order by obj) as k from (select {g}i as obj from {pairs} union select {g}j from {pairs}) z{tag}),
s{tag} as (select {"a." + by + " as " + by + ", " if by else ""}0 as step, a.k as i, b.k as j, {base} as d, {size("a")} as ni, {size("b")} as nj, -a.k as li, -b.k as lj from {pairs} join o{tag} a on a.obj = {pairs}.i join o{tag} b on b.obj = {pairs}.j{on}
union all
select {g}step + 1, x, y, case when not touched then d else {new} end, case when x = mi then si + sj else sx end, case when y = mi then si + sj else sy end, case when x = mi then step + 1 else lx end, case when y = mi then step + 1 else ly end from (
select {g}step, mi, mj, any_value(h) as h, any_value(si) as si, any_value(sj) as sj, x, y, bool_or(i in (mi, mj) or j in (mi, mj)) as touched, max(d) as d,
max(case when i = mi or j = mi then d end) as di, max(case when i = mj or j = mj then d end) as dj, max(case when i in (mi, mj) then nj else ni end) as sk,
max(case when i = x then ni when j = x then nj end) as sx, max(case when i = y then ni when j = y then nj end) as sy, max(case when i = x then li when j = x then lj end) as lx, max(case when i = y then li when j = y then lj end) as ly
from (select *, least(case when i = mj then mi else i end, case when j = mj then mi else j end) as x, greatest(case when i = mj then mi else i end, case when j = mj then mi else j end) as y from (
select *, first_value(i) over w as mi, first_value(j) over w as mj, first_value(d) over w as h, first_value(ni) over w as si, first_value(nj) over w as sj from s{tag} window w as ({part}order by d, i, j)) q{tag}) r{tag}
where not (i = mi and j = mj) group by {g}step, mi, mj, x, y) t{tag}),
m{tag} as (select {g}step + 1 as step, i as mi, j as mj, {height} as h, li, lj from (select *, row_number() over (partition by {g}step order by d, i, j) as first from s{tag}) f{tag} where first = 1)"""


def merges(tag: str = "", by: str | None = None, src: str = "1") -> str:
    """Rows (src, step, left, right, height) of the merges, as the trees list them."""
    s = by or src
    ahead = "(sign(li) = sign(lj) and abs(li) < abs(lj)) or (li < 0 and lj > 0)"
    return f"select cast({s} as int) as src, cast(step as int) as step, cast(case when {ahead} then li else lj end as int) as \"left\", cast(case when {ahead} then lj else li end as int) as \"right\", (round(h, 6) + 0.0) as height from m{tag}"


def cut(k: str, tag: str = "", by: str | None = None, tree: str = "") -> str:
    """CTE l{tag}(obj, cluster) of the tree `tree`: k classes (an expression of n, the number of objects), by first appearance."""
    g = f"{by}, " if by else ""
    part = f"partition by {by} " if by else ""
    same = f" and m.{by} = r.{by}" if by else ""
    grouped = f" group by {by}" if by else ""
    return f"""n{tag} as (select {g}count(*) as n from o{tree}{grouped}),
mm{tag} as (select m.* from m{tree} m join n{tag} on {f"m.{by} = n{tag}.{by}" if by else "true"} where m.step <= n{tag}.n - ({k})),
c{tag} as (select {g}obj, k as root from o{tree} union all select {"r." + by + ", " if by else ""}r.obj, m.mi from c{tag} r join mm{tag} m on m.mj = r.root{same}),
l{tag} as (select {g}obj, cast(dense_rank() over ({part}order by root) as int) as cluster from (select {g}obj, min(root) as root from c{tag} group by {g}obj) e{tag})"""


def leaves(tag: str = "") -> str:
    """CTE lo{tag}(obj, pos): leaves from left to right."""
    return f"""up{tag} as (select obj, k as root, 0 as step, '' as path from o{tag} union all
select r.obj, m.mi, m.step, case when (m.mi = r.root) = ((sign(li) = sign(lj) and abs(li) < abs(lj)) or (li < 0 and lj > 0)) then '0' else '1' end || path from up{tag} r join (select *, lead(step) over (order by step) as z from m{tag}) m on (m.mi = r.root or m.mj = r.root) and m.step > r.step
where m.step = (select min(q.step) from m{tag} q where (q.mi = r.root or q.mj = r.root) and q.step > r.step)),
lo{tag} as (select obj, row_number() over (order by max_by(path, step)) as pos from up{tag} group by obj)"""


def components(edges: str, nodes: str, tag: str = "") -> str:
    """CTE k{tag}(obj, cluster): components over edges(i, j), numbered by first appearance."""
    return f"""b{tag} as (select i, j from {edges} union all select j, i from {edges}),
w{tag}(obj, root) as (select obj, obj from {nodes} union select b{tag}.j, w{tag}.root from w{tag} join b{tag} on b{tag}.i = w{tag}.obj),
k{tag} as (select obj, cast(dense_rank() over (order by min(root)) as int) as cluster from w{tag} group by obj)"""


def cophenetic(tag: str = "", by: str | None = None) -> str:
    """CTE co{tag}(i, j, d): height of the lowest merge that holds both objects; needs `members`."""
    g = f"a.{by}, " if by else ""
    same = f" and a.{by} = b.{by}" if by else ""
    return f"co{tag} as (select {g}a.obj as i, b.obj as j, min_by(a.h, a.step) as d from mb{tag} a join mb{tag} b on a.step = b.step and a.obj < b.obj{same} group by {g}a.obj, b.obj)"


def members(tag: str = "", by: str | None = None) -> str:
    """CTE mb{tag}(step, obj, h): objects of the cluster that each merge makes."""
    g = f"{by}, " if by else ""
    r = f"r.{by}, " if by else ""
    same = f" and m.{by} = r.{by}" if by else ""
    return f"""u{tag} as (select {g}obj, k as root, 0 as step, 0.0::double as h from o{tag} union all
select {r}r.obj, m.mi, m.step, m.h from u{tag} r join m{tag} m on (m.mi = r.root or m.mj = r.root){same} and m.step > r.step
where m.step = (select min(q.step) from m{tag} q where (q.mi = r.root or q.mj = r.root) and q.step > r.step{same.replace('m.', 'q.')})),
mb{tag} as (select * from u{tag} where step > 0)"""
