"""SQL text for statistics the checking engine has no function for.

Written from the definitions, by other methods than the library uses: sums of
log-gamma terms, numeric integration and unrolled reweighting steps.
"""

from __future__ import annotations

Z = 1.959963984540054


def binomial_ctes(source: str, n: str, k: str, tag: str) -> str:
    """CTE ``q{tag}(n, k, lower, upper)`` for the distinct (n, k) of ``source``."""
    return f"""
  pairs{tag} as (select distinct {n} as n, {k} as k from {source} where {n} > 0),
  terms{tag} as (select n, k, i, exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
      + i * ln(cast(k as double) / n) + (n - i) * ln(1 - cast(k as double) / n)) as w
    from (select n, k, unnest(range(0, n + 1)) as i from pairs{tag} where k > 0 and k < n)),
  cum{tag} as (select n, k, i, sum(w) over (partition by n, k order by i rows unbounded preceding) as c from terms{tag}),
  q{tag} as (select n, k, cast(min(i) filter (c >= 0.025) as double) / n as lower,
      cast(min(i) filter (c >= 0.975) as double) / n as upper from cum{tag} group by n, k
    union all select n, k, 0.0, 0.0 from pairs{tag} where k = 0
    union all select n, k, 1.0, 1.0 from pairs{tag} where k = n)"""


def normal_tail_ctes(source: str, key: str, z: str, tag: str, points: int = 2000) -> str:
    """CTE ``tail{tag}({key}, p)``: two-sided normal tail by Simpson's rule."""
    h = f"(10.0 / {points})"
    weight = f"case when i in (0, {points}) then 1 when i % 2 = 1 then 4 else 2 end"
    x = f"(abs({z}) + i * {h})"
    return f"""
  tail{tag} as (select {key}, sum(({weight}) * exp(-{x} * {x} / 2)) * 2 * {h} / 3 / sqrt(2 * pi()) as p
    from (select {key}, {z}, unnest(range(0, {points} + 1)) as i from {source}) group by {key})"""


def t_tail_ctes(source: str, key: str, t: str, dof: str, tag: str, points: int = 4000) -> str:
    """CTE ``tail{tag}({key}, p)``: two-sided Student tail, with t = sqrt(v) tan(angle)."""
    weight = f"case when i in (0, {points}) then 1 when i % 2 = 1 then 4 else 2 end"
    return f"""
  angle{tag} as (select {key}, {dof} as v, atan(abs({t}) / sqrt({dof})) as a0 from {source} where {t} is not null and {dof} > 0),
  tail{tag} as (select {key}, 2 * exp(lgamma((v + 1) / 2.0) - lgamma(v / 2.0)) / sqrt(pi())
      * sum(({weight}) * pow(abs(cos(a0 + i * (pi() / 2 - a0) / {points})), v - 1)) * (pi() / 2 - a0) / {points} / 3 as p
    from (select *, unnest(range(0, {points} + 1)) as i from angle{tag}) group by {key}, v, a0)"""


def t_quantile_ctes(source: str, key: str, dof: str, tag: str, points: int = 40000) -> str:
    """CTE ``crit{tag}({key}, t_crit)``: 95 % two-sided Student value from a cumulated density
    (trapezoids with end correction)."""
    step = f"(pi() / 2 / {points})"
    return f"""
  dens{tag} as (select {key}, v, i, 2 * exp(lgamma((v + 1) / 2.0) - lgamma(v / 2.0)) / sqrt(pi())
      * pow(abs(cos(i * {step})), v - 1) as f
    from (select {key}, {dof} as v, unnest(range(0, {points} + 1)) as i from {source} where {dof} > 0)),
  cdf{tag} as (select *, {step} * (sum(f) over w - f / 2 - first_value(f) over w / 2)
      + {step} * {step} / 12 * (v - 1) * tan(i * {step}) * f as c, lag(f) over w as f0
    from dens{tag} window w as (partition by {key} order by i rows unbounded preceding)),
  hit{tag} as (select {key}, v, i, c, f + (f0 - f) * (c - 0.95) / f / (2 * {step}) as f, row_number() over (partition by {key} order by i) as rn from cdf{tag} where c >= 0.95),
  crit{tag} as (select {key}, sqrt(v) * tan(i * {step} - (c - 0.95) / f) as t_crit from hit{tag} where rn = 1)"""


def _mu(link: str, eta: str) -> str:
    return f"exp({eta})" if link == "log" else f"(1 / (1 + exp(-({eta}))))"


def deviance(y: str, mu: str, w: str) -> str:
    return (
        f"2 * {w} * (case when {y} > 0 then {y} * ln({y} / {mu}) else 0 end"
        f" + case when {y} < 1 then (1 - {y}) * ln((1 - {y}) / (1 - {mu})) else 0 end)"
    )


def irls_ctes(rows: str, link: str, tag: str, steps: int = 12) -> str:
    """CTE ``fit{tag}`` of one row: a, b, v00, v01, v11, deviance, null_deviance,
    pearson, n and ll (log density without the choose term), from ``rows(x, y, w)``."""
    start = "ln(m)" if link == "log" else "ln(m / (1 - m))"
    out = [
        f"share{tag} as materialized (select sum(w * y) / sum(w) as m from {rows})",
        f"b{tag}_0 as materialized (select {start} as a, cast(0 as double) as b from share{tag})",
    ]
    for i in range(steps):
        if link == "log":
            weight, z = "w * mu / (1 - mu)", "eta + (y - mu) / mu"
        else:
            weight, z = "w * mu * (1 - mu)", "eta + (y - mu) / (mu * (1 - mu))"
        out.append(
            f"""b{tag}_{i + 1} as materialized (
    select (sxx * sz - sx * sxz) / (s * sxx - sx * sx) as a, (s * sxz - sx * sz) / (s * sxx - sx * sx) as b
    from (select sum(g) as s, sum(g * x) as sx, sum(g * x * x) as sxx, sum(g * z) as sz, sum(g * x * z) as sxz
      from (select x, {weight} as g, {z} as z from (select x, y, w, eta, {_mu(link, 'eta')} as mu
        from (select x, y, w, a + b * x as eta from {rows}, b{tag}_{i})))))"""
        )
    info = "w * mu / (1 - mu)" if link == "log" else "w * mu * (1 - mu)"
    out.append(
        f"""fit{tag} as materialized (select any_value(a) as a, any_value(b) as b, count(*) as n,
    sum(g * x * x) / (sum(g) * sum(g * x * x) - sum(g * x) * sum(g * x)) as v00,
    -sum(g * x) / (sum(g) * sum(g * x * x) - sum(g * x) * sum(g * x)) as v01,
    sum(g) / (sum(g) * sum(g * x * x) - sum(g * x) * sum(g * x)) as v11,
    sum({deviance('y', 'mu', 'w')}) as deviance, sum({deviance('y', 'm', 'w')}) as null_deviance,
    sum(w * (y - mu) * (y - mu) / (mu * (1 - mu))) as pearson
    from (select *, {info} as g from (select x, y, w, a, b, m, {_mu(link, 'a + b * x')} as mu
      from {rows}, b{tag}_{steps}, share{tag})))"""
    )
    return ",\n  ".join(out)


def irls_group_ctes(rows: str, by: str, steps: int = 12) -> str:
    """CTE ``fits`` with a logit fit per ``by``: the columns of ``fit{tag}`` above, from ``rows(by, x, y, w)``.

    NULL figures where the predictor is constant or there are only successes or only failures.
    """
    out = [
        f"shares as materialized (select {by}, sum(w * y) / sum(w) as m, max(x) > min(x) as varies from {rows} group by {by})",
        f"""g_0 as materialized (select {by}, ln(m / (1 - m)) as a, cast(0 as double) as b from shares
    where varies and m > 0 and m < 1)""",
    ]
    for i in range(steps):
        out.append(
            f"""g_{i + 1} as materialized (
    select {by}, (sxx * sz - sx * sxz) / (s * sxx - sx * sx) as a, (s * sxz - sx * sz) / (s * sxx - sx * sx) as b
    from (select {by}, sum(g) as s, sum(g * x) as sx, sum(g * x * x) as sxx, sum(g * z) as sz, sum(g * x * z) as sxz
      from (select {by}, x, w * mu * (1 - mu) as g, eta + (y - mu) / (mu * (1 - mu)) as z
        from (select {by}, x, y, w, eta, {_mu('logit', 'eta')} as mu
          from (select {by}, x, y, w, a + b * x as eta from {rows} join g_{i} using ({by}))))
      group by {by}))"""
        )
    out.append(
        f"""fits as materialized (select {by}, any_value(a) as a, any_value(b) as b, count(*) as n,
    sum(g * x * x) / (sum(g) * sum(g * x * x) - sum(g * x) * sum(g * x)) as v00,
    sum(g) / (sum(g) * sum(g * x * x) - sum(g * x) * sum(g * x)) as v11,
    sum({deviance('y', 'mu', 'w')}) as deviance, sum({deviance('y', 'm', 'w')}) as null_deviance
    from (select *, w * mu * (1 - mu) as g from (select {by}, x, y, w, a, b,
      case when a is not null then m end as m, {_mu('logit', 'a + b * x')} as mu
      from {rows} left join g_{steps} using ({by}) join shares using ({by}))) group by {by})"""
    )
    return ",\n  ".join(out)


def fitted(link: str, x: str = "x") -> str:
    return _mu(link, f"a + b * {x}")


def fitted_se(link: str, x: str = "x") -> str:
    mu = _mu(link, f"a + b * {x}")
    slope = mu if link == "log" else f"{mu} * (1 - {mu})"
    return f"{slope} * sqrt(v00 + 2 * v01 * {x} + v11 * {x} * {x})"


def profile_ctes(rows: str, fit: str, link: str, tag: str, outer: int = 8, inner: int = 3) -> str:
    """CTE ``bounds{tag}(j, side, b)``: unrolled profile search for four bounds.

    The probed coefficient is rescaled along the signed root of the deviance;
    the other one takes ``inner`` scoring steps before each look.
    """
    out = [
        f"""p{tag}_0 as materialized (select j, side, best_j, best_o, best_j + side * {Z} * sqrt(vj) as bj, best_o as bo, d0
    from (select 0 as j, a as best_j, b as best_o, v00 as vj, deviance as d0 from {fit}
      union all select 1, b, a, v11, deviance from {fit}), (values (-1), (1)) s(side))"""
    ]
    last = 0
    eta = "(case when j = 0 then bj + bo * x else bo + bj * x end)"
    other = "(case when j = 0 then x else 1 end)"
    mu = _mu(link, eta)
    score = "w * (y - mu) / (1 - mu)" if link == "log" else "w * (y - mu)"
    info = "w * mu / (1 - mu)" if link == "log" else "w * mu * (1 - mu)"
    keys = "j, side, best_j, best_o, bj, bo, d0"
    for _ in range(outer):
        for _ in range(inner):
            out.append(
                f"""p{tag}_{last + 1} as materialized (select j, side, best_j, best_o, bj,
    bo + sum({score} * o) / sum({info} * o * o) as bo, d0
    from (select {keys}, y, w, {other} as o, {mu} as mu from p{tag}_{last}, {rows}) group by {keys})"""
            )
            last += 1
        out.append(
            f"""p{tag}_{last + 1} as materialized (select j, side, best_j, best_o,
    best_j + (bj - best_j) * {Z} / sqrt(sum({deviance('y', 'mu', 'w')}) - d0) as bj, bo, d0
    from (select {keys}, y, w, {mu} as mu from p{tag}_{last}, {rows}) group by {keys})"""
        )
        last += 1
    out.append(f"bounds{tag} as (select j, side, bj as b from p{tag}_{last})")
    return ",\n  ".join(out)




def _gauss_jordan(first: str, tag: str, size: int) -> str:
    """Unrolled elimination of ``first(s, i, j, v)``; the last CTE is ``{tag}_{size}``."""
    out, last = [], first
    for k in range(size):
        out.append(
            f"""{tag}_{k + 1} as materialized (select m.s, m.i, m.j,
    case when m.i = {k} then r.v / d.v else m.v - c.v * r.v / d.v end as v from {last} m
    join {last} d on d.s = m.s and d.i = {k} and d.j = {k} join {last} r on r.s = m.s and r.i = {k} and r.j = m.j
    join {last} c on c.s = m.s and c.i = m.i and c.j = {k})"""
        )
        last = f"{tag}_{k + 1}"
    return ",\n  ".join(out)


def spline_ctes(source: str, penalty: float, knots: int = 10) -> str:
    """CTE ``curve(s, date, smooth)`` from daily ``source(s, date, y)``: the penalised
    natural spline by explicit normal equations, solved by elimination."""
    top, inner, d0, rhs = knots - 1, knots - 2, 100, 1000
    return f"""
  days as materialized (select s, date, y, date_diff('day', date '1970-01-01', date) as d,
    row_number() over (partition by s order by date) - 1 as r, count(*) over (partition by s) as cnt from {source}),
  kn as (select s, t.i, d as k from days join (select unnest(range(0, {knots})) as i) t
    on r = cast(round(t.i * (cnt - 1) / cast({top} as double)) as bigint)),
  box as (select s, min(k) as lo, max(k) as hi from kn group by s),
  z as materialized (select s, i, (k - lo) / cast(hi - lo as double) as k from kn join box using (s)),
  h as materialized (select a.s, a.i, b.k - a.k as h from z a join z b on b.s = a.s and b.i = a.i + 1),
  dd as materialized (select s, i as r, i as p, 1 / h as v from h where i < {inner}
    union all select s, i - 1, i + 1, 1 / h from h where i >= 1
    union all select a.s, a.i, a.i + 1, -(1 / a.h + 1 / b.h) from h a join h b on b.s = a.s and b.i = a.i + 1),
  band as (select a.s, a.i as r, a.i as c, (a.h + b.h) / 3 as v from h a join h b on b.s = a.s and b.i = a.i + 1
    union all select s, i - 1, i, h / 6 from h where i between 1 and {inner - 1}
    union all select s, i, i - 1, h / 6 from h where i between 1 and {inner - 1}
    union all select s, r, p + {d0}, v from dd),
  cells as (select s, i, j from (select distinct s from z), (select unnest(range(0, {inner})) as i),
    (select unnest(range(0, {inner})) as j union all select unnest(range({d0}, {d0 + knots})))),
  m0 as materialized (select cells.s, i, j, coalesce(band.v, 0) as v from cells left join band on band.s = cells.s and r = i and c = j),
  {_gauss_jordan('m0', 'm', inner)},
  f as materialized (select s, i + 1 as j, j - {d0} as p, v from m_{inner} where j >= {d0}),
  rough as (select dd.s, dd.p, f.p as q, sum(dd.v * f.v) as v from dd join f on f.s = dd.s and f.j = dd.r + 1 group by 1, 2, 3),
  placed as materialized (select days.s, date, y, least(max(i), {top - 1}) as j, (d - lo) / cast(hi - lo as double) as x
    from days join box using (s) join z on z.s = days.s and z.k <= (d - lo) / cast(hi - lo as double) group by days.s, date, y, d, lo, hi),
  near as (select placed.*, b.k - x as l, x - a.k as g, b.k - a.k as w from placed join z a on a.s = placed.s and a.i = j join z b on b.s = placed.s and b.i = j + 1),
  parts as (select s, date, y, j as p, l / w as b from near union all select s, date, y, j + 1, g / w from near
    union all select near.s, date, y, f.p, (l * l * l / w - w * l) / 6 * v from near join f on f.s = near.s and f.j = near.j
    union all select near.s, date, y, f.p, (g * g * g / w - w * g) / 6 * v from near join f on f.s = near.s and f.j = near.j + 1),
  basis as materialized (select s, date, any_value(y) as y, p, sum(b) as b from parts group by s, date, p),
  gram as (select a.s, a.p, b.p as q, sum(a.b * b.b) as v from basis a join basis b on b.s = a.s and b.date = a.date group by 1, 2, 3),
  n0 as materialized (select gram.s, gram.p as i, gram.q as j, gram.v + {penalty} * coalesce(rough.v, 0) as v
      from gram left join rough on rough.s = gram.s and rough.p = gram.p and rough.q = gram.q
    union all select s, p, {rhs}, sum(b * y) from basis group by s, p),
  {_gauss_jordan('n0', 'n', knots)},
  curve as (select basis.s, date, sum(b * v) as smooth from basis join n_{knots} n on n.s = basis.s and n.i = p and n.j = {rhs} group by 1, 2)"""
