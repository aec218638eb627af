"""The same queries as SQL over the raw tables, written independently of the operators.

Statements are assembled from common table expressions. Model queries use the closed
form of a two-feature ridge regression, with the seed's weights as literals.
"""

from __future__ import annotations

from panelgrid.operators.counterfactual import sign_stream
from panelgrid.operators.kernel import draw_weights
from panelgrid.operators.tidy import PREDICTORS, SHARED_PREDICTORS
from workload.frames import NAIVE_CELLS
from workload.inputs import SUPPLIER_PREDICTORS

END = "(select last_day(max(cast(l_shipdate as date)) + interval 1 day - interval 1 month) from lineitem)"
ORDINAL = "cast(year({0})*12 + month({0}) as bigint)"


def rnd(expression: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0"


def out(source: str, plain: str, doubles: str, digits: int = 6, where: str = "") -> str:
    """``plain`` columns as they are, ``doubles`` rounded under their own names."""
    cols = [c for c in plain.split()] + [f"{rnd(c, digits)} as {c}" for c in doubles.split()]
    return f"select {', '.join(cols)} from {source} {where}"


# --- inputs ------------------------------------------------------------------------


def source(series: str = "'market'", name: str = "src") -> str:
    return f"""
{name}_raw as (
  select {series} as series_id, last_day(cast(l_shipdate as date)) as date,
    avg(l_extendedprice/l_quantity) as price, sum(l_extendedprice*l_tax) as d12,
    sum(l_extendedprice*(1-l_discount)) as e12,
    sum(l_extendedprice*l_discount)/sum(l_extendedprice) as bm,
    avg(case when l_returnflag='A' then l_discount end) as "AAA",
    avg(case when l_returnflag='R' then l_discount end) as "BAA",
    avg(l_tax) as lty, avg(l_discount) as tbl, var_samp(l_discount) as svar, avg(l_discount)/100 as "Rfree",
    sum(case when l_linestatus='O' then l_quantity end) as qo,
    sum(case when l_linestatus='F' then l_quantity end) as qf, sum(l_quantity) as q, count(*) as n
  from lineitem group by 1, 2),
{name} as (
  select series_id, {ORDINAL.format('date')} as t, date, price, d12, e12, bm, "AAA", "BAA", lty, tbl, svar,
    e12/lag(e12) over w - 1 as ret, qo/lag(qo) over w - 1 as ltr, qf/lag(qf) over w - 1 as corpr, "Rfree",
    q/lag(q) over w - 1 as infl, n/lag(n) over w - 1 as ntis
  from {name}_raw window w as (partition by series_id order by date))"""


ORDERS = """
ord as (select last_day(cast(o_orderdate as date)) as date, sum(o_totalprice) as turnover from orders group by 1),
idx as (select date, turnover/lag(turnover) over (order by date) - 1 as vwretd from ord)"""

TIDY_COLUMNS = """
  ret-"Rfree" as mkt_excess, "BAA"-"AAA" as dfy, infl, svar, ln(d12)-ln(e12) as de, lty, lty-tbl as tms, tbl,
  corpr-ltr as dfr, ln(d12)-ln(price) as dp, ln(d12)-ln(prior_price) as dy, ltr, ln(e12)-ln(price) as ep, bm, ntis,
  ret-"Rfree" as lag_mkt_excess"""

TIDY = f"""{source()},{ORDERS},
tidy as (
  select s.series_id, s.t, s.date, {TIDY_COLUMNS}
  from (select *, lag(price) over (partition by series_id order by t) as prior_price from src) s
  left join idx on s.date = idx.date
  where s.ret is not null and idx.vwretd is not null)"""


def standardized(panel: str, name: str, target: str, predictors, own_lag: str, where: str = "true",
                 window: int = 12, burn: int = 36, keys: str = "series_id, t, date", drop: bool = True) -> str:
    """Scale a panel; with ``drop`` keep complete rows only."""
    sd = "".join(
        f",\n    case when count({c}) over past >= {burn} then stddev_samp({c}) over past end as sd_{c}"
        for c in predictors if c != own_lag
    )
    scaled = "".join(
        f", {target}/nullif(scale, 0) as {c}" if c == own_lag else f", {c}/nullif(sd_{c}, 0) as {c}"
        for c in predictors
    )
    full = " and ".join([f"{target} is not null", *[f"{c} is not null" for c in predictors]]) if drop else "true"
    return f"""
{name}_scale as (
  select *, case when count({target}) over near = {window} then sqrt(avg({target}*{target}) over near) end as scale{sd}
  from {panel} where {where}
  window near as (partition by series_id order by t rows between {window} preceding and 1 preceding),
    past as (partition by series_id order by t rows between unbounded preceding and 1 preceding)),
{name}_all as (select {keys}, {target}/nullif(scale, 0) as {target}{scaled} from {name}_scale),
{name} as (select * from {name}_all where {full})"""


MARKET = f"{TIDY},{standardized('tidy', 'std', 'mkt_excess', PREDICTORS, 'lag_mkt_excess', f'date <= {END}')}"

SUPPLIER_SOURCE = f"""
cell as (
  select cast(l_suppkey as varchar) as series_id, last_day(cast(l_shipdate as date)) as date, count(*) as n,
    sum(l_quantity) as qty, sum(case when l_returnflag='R' then l_quantity else 0 end) as rqty,
    sum(l_extendedprice*(1-l_discount)) as rev, sum(l_extendedprice*l_tax) as tax
  from lineitem group by 1, 2),
sup_span as (select series_id, min({ORDINAL.format('date')}) as lo, max({ORDINAL.format('date')}) as hi from cell group by 1),
axis as (select series_id, unnest(generate_series(lo, hi)) as t from sup_span),
sup as (
  select a.series_id, a.t, last_day(make_date(cast((a.t-1)//12 as int), cast((a.t-1)%12+1 as int), 1)) as date,
    coalesce(n, 0)::double as n, coalesce(qty, 0) as qty, coalesce(rqty, 0) as rqty, coalesce(rev, 0) as rev,
    coalesce(tax, 0) as tax
  from axis a left join cell c on a.series_id = c.series_id and a.t = {ORDINAL.format('c.date')})"""

SUPPLIER = f"""{SUPPLIER_SOURCE},
panel as (
  select series_id, t, date, dr as y, ln(1+tax)-ln(1+rev) as dp, dq as ltr, drq-dq as dfr, n as svar, dr as own_lag
  from (select *, ln(1+rev)-lag(ln(1+rev)) over w as dr, ln(1+qty)-lag(ln(1+qty)) over w as dq,
      ln(1+rqty)-lag(ln(1+rqty)) over w as drq
    from sup window w as (partition by series_id order by t))
  where dr is not null)"""

SUPPLIER_STD = f"{SUPPLIER},{standardized('panel', 'std', 'y', SUPPLIER_PREDICTORS, 'own_lag', f'date <= {END}')}"

HOURLY_CELLS = """
hcell as (
  select event_type as series_id, cast(floor(epoch(ts)/3600) as bigint) as t, count(*)::double as n,
    sum(value) as total, avg(value) as mean from events group by 1, 2)"""

HOURLY = f"""{HOURLY_CELLS},
hour as (
  select a.series_id, a.t, coalesce(n, 0) as n, coalesce(total, 0) as total, coalesce(mean, 0) as mean
  from (select series_id, unnest(generate_series(min(t), max(t))) as t from hcell group by 1) a
  left join hcell c on a.series_id = c.series_id and a.t = c.t)"""

NATION = f"""
nat as (
  select cast(c_nationkey as varchar) as series_id, last_day(cast(o_orderdate as date)) as date,
    sum(o_totalprice) as value from orders join customer on o_custkey = c_custkey group by 1, 2),
natm as (select *, {ORDINAL.format('date')} as t from nat)"""

_cells = ", ".join(f"({s}, {p}, {z})" for s, p, z in NAIVE_CELLS)
NAIVE = f"""{SUPPLIER},
naive as (
  select p.series_id, c.seed::bigint as seed, c.p as "P", c.z::double as z, p.t, p.date as obs,
    p.prev*(c.seed+1)/c.p - 0.1*p.ltr + c.z*0.001 as forecast, p.y as realized
  from (select *, lag(y) over (partition by series_id order by t) as prev from panel) p,
    (values {_cells}) c(seed, p, z)
  where p.prev is not null),
fc as (select *, forecast*realized as strategy, abs(forecast) as beta_norm from naive)"""

STATS = "r2 mean_return volatility sharpe alpha information_ratio alpha_tstat"
STATS_NORM = "r2 beta_norm mean_return volatility sharpe alpha information_ratio alpha_tstat"


def scored(rows: str, keys: str, name: str = "scored", norm: bool = True) -> str:
    """Statistics by explicit residuals: fit a line per group, join it back, square."""
    on = " and ".join(f"r.{k} is not distinct from l.{k}" for k in keys.replace(" ", "").split(","))
    keyed = ", ".join(f"r.{k}" for k in keys.replace(" ", "").split(","))
    first = f"{keys}, " if keys else ""
    beta = ", avg(r.beta_norm) as beta_norm" if norm else ""
    return f"""
{name}_line as (
  select {first} regr_slope(forecast*realized, realized) as slope, regr_intercept(forecast*realized, realized) as alpha,
    avg(realized) as mx, regr_sxx(forecast*realized, realized) as sxx, count(*) as n
  from {rows} group by {keys}),
{name}_fit as (
  select {keyed}, any_value(l.alpha) as alpha, any_value(l.mx) as mx, any_value(l.sxx) as sxx, any_value(l.n) as n,
    sum(pow(r.forecast*r.realized - l.alpha - l.slope*r.realized, 2)) as ssr,
    1 - var_pop(r.realized-r.forecast)/nullif(var_pop(r.realized), 0) as r2,
    avg(r.forecast*r.realized) as mean_return, stddev_pop(r.forecast*r.realized) as volatility{beta}
  from {rows} r join {name}_line l on {on} group by {keyed}),
{name} as (
  select *, sqrt(12)*mean_return/nullif(volatility, 0) as sharpe,
    sqrt(12)*alpha/nullif(sqrt(ssr/n), 0) as information_ratio,
    alpha/nullif(sqrt(ssr/(n-2)*(1.0/n + mx*mx/nullif(sxx, 0))), 0) as alpha_tstat
  from {name}_fit)"""


def averages(table: str, keys: str, stats: str = STATS, name: str = "means") -> str:
    cols = ", ".join(f"avg({c}) as {c}" for c in stats.split())
    return f"\n{name} as (select {keys}, {cols} from {table} group by {keys})"


CELL = 'series_id, seed, "P", z'
CELL_OUT = 'series_id seed "P" z'


def momentum_sql(panel: str, target: str, weights, name: str = "mom") -> str:
    terms = " + ".join(f"{w!r}*{target if k == 0 else f'lag({target}, {k}) over w'}" for k, w in enumerate(weights))
    n = len(weights)
    return f"""
{name}_all as (
  select *, {terms} as fir, lead({target}) over w as nxt, lag({target}, {n}) over w as edge,
    t - min(t) over (partition by series_id) as oos_index
  from {panel} window w as (partition by series_id order by t)),
{name} as (
  select series_id, t, oos_index, fir as forecast, nxt as realized, fir*nxt as strategy
  from {name}_all where edge is not null and nxt is not null)"""


def timed_sql(panel: str, target: str, predictors, window: int = 12, name: str = "timed",
              keys: str = "series_id") -> str:
    weights = [(window - k) / (window * (window + 1) / 2.0) for k in range(window)]
    variance = " + ".join(f"var_samp({c}) over prior" for c in predictors)
    terms = " + ".join(f"{w!r}*{target if k == 0 else f'lag({target}, {k}) over w'}" for k, w in enumerate(weights))
    return f"""
{name}_all as (
  select *, {terms} as fir, greatest(({variance})/{len(predictors)}, 1e-12) as predictor_variance,
    lead({target}) over w as nxt, lag({target}, {window}) over w as edge,
    t - min(t) over (partition by {keys}) as oos_index
  from {panel}
  window w as (partition by {keys} order by t),
    prior as (partition by {keys} order by t rows between {window} preceding and 1 preceding)),
{name} as (
  select {keys}, t, oos_index, 0.05*fir/predictor_variance as forecast, nxt as realized,
    0.05*fir/predictor_variance*nxt as strategy, predictor_variance
  from {name}_all where edge is not null and nxt is not null)"""


WEIGHTS_12 = [(12 - k) / 78.0 for k in range(12)]


def features_sql(panel: str, predictors, seeds, target: str, name: str = "feat", keys: str = "series_id") -> str:
    """Both features of a two-feature model per row and seed."""
    parts = []
    for seed in seeds:
        w = draw_weights(1, len(predictors), seed)[0]
        angle = " + ".join(f"({float(v)!r})*{c}" for v, c in zip(w, predictors))
        parts.append(f"select {keys}, t, date, {target} as y, {seed} as seed, 2.0*({angle}) as a from {panel}")
    return f"\n{name} as (select *, sin(a) as s1, cos(a) as s2 from ({' union all '.join(parts)}))"


def engine_sql(panel: str, predictors, seeds, zs, target: str, keys: str = "series_id", window: int = 12,
               uncentered: bool = False, tag: str = "") -> str:
    """Every rolling two-feature ridge forecast from windowed sums and a 2x2 inverse."""
    scale = "sqrt(avg({0}*{0}) over w)" if uncentered else "stddev_samp({0}) over w"
    levels = ", ".join(f"({z!r})" for z in zs)
    return f"""{features_sql(panel, predictors, seeds, target, f"feat{tag}", keys)},
lead_feat{tag} as (
  select *, lead(y) over s as rn, lead(date) over s as obs from feat{tag} window s as (partition by {keys}, seed order by t)),
win{tag} as (
  select *, count(*) over w as nw, {scale.format('s1')} as r1, {scale.format('s2')} as r2,
    sum(s1*s1) over w as q11, sum(s2*s2) over w as q22, sum(s1*s2) over w as q12,
    sum(s1*rn) over w as d1, sum(s2*rn) over w as d2
  from lead_feat{tag}
  window w as (partition by {keys}, seed order by t rows between {window} preceding and 1 preceding)),
unit{tag} as (
  select *, case when r1 > 1e-12 then r1 else 1 end as c1, case when r2 > 1e-12 then r2 else 1 end as c2
  from win{tag} where nw = {window} and rn is not null),
sys{tag} as (
  select {keys}, seed, z.z as z, t, obs, rn, s1/c1 as u1, s2/c2 as u2, q11/(c1*c1) + z.z*{window} as a11,
    q22/(c2*c2) + z.z*{window} as a22, q12/(c1*c2) as a12, d1/c1 as b1, d2/c2 as b2
  from unit{tag}, (values {levels}) z(z)),
sol{tag} as (
  select *, (a22*b1 - a12*b2)/(a11*a22 - a12*a12) as g1, (a11*b2 - a12*b1)/(a11*a22 - a12*a12) as g2 from sys{tag}),
fc{tag} as (
  select {keys}, seed::bigint as seed, 2 as "P", z::double as z, t, obs, u1*g1 + u2*g2 as forecast, rn as realized,
    sqrt(g1*g1 + g2*g2) as beta_norm, (u1*g1 + u2*g2)*rn as strategy
  from sol{tag})"""


SUPPLIER_ENGINE = f"{SUPPLIER_STD},{engine_sql('std', SUPPLIER_PREDICTORS, (0, 1), (0.1, 10.0), 'y')}"
MARKET_ENGINE = f"{MARKET},{engine_sql('std', PREDICTORS, (0, 1), (0.1, 10.0), 'mkt_excess')}"


def dual_sql(panel: str, predictors, seeds, zs, ps, target: str, keys: str = "series_id", tag: str = "") -> str:
    """Every rolling forecast of a two-row window with any number of features, from the 2 x 2 dual system.

    The rows are rotated to their mean and their difference: a feature scaled by the spread of two rows has a
    difference of one in that basis, so nothing is lost by subtraction however flat the feature is.
    """
    rows = []
    for seed in seeds:
        for i, w in enumerate(draw_weights(max(ps) // 2, len(predictors), seed)):
            rows.append(f"({seed}, {i}, {', '.join(repr(float(v)) for v in w)})")
    names = ", ".join(f"w{j}" for j in range(len(predictors)))
    total = " + ".join(f"w{j}*{c}" for j, c in enumerate(predictors))
    on_keys = f"partition by {keys}"
    return f"""
rows{tag} as (
  select {keys}, t, date, {target} as y, {', '.join(predictors)} from {panel}),
ahead{tag} as (
  select *, lead(y) over s as rn, lead(date) over s as obs from rows{tag} window s as ({on_keys} order by t)),
wave{tag} as (
  select {keys}, t, w.seed as seed, w.pair as pair, f.f as f, case f.f when 0 then sin(2.0*({total})) else cos(2.0*({total})) end as s
  from rows{tag}, (values {', '.join(rows)}) w(seed, pair, {names}), (values (0), (1)) f(f)),
lagged{tag} as (
  select *, lag(s, 2) over g as a, lag(s, 1) over g as b, row_number() over g as k
  from wave{tag} window g as (partition by {keys}, seed, pair, f order by t)),
unit{tag} as (
  select *, case when abs(a - b)/sqrt(2) > 1e-12 then abs(a - b)/sqrt(2) else 1 end as c from lagged{tag} where k > 2),
basis{tag} as (
  select {keys}, t, seed, pair, (a + b)/sqrt(2)/c as p, (a - b)/sqrt(2)/c as m, s/c as u from unit{tag}),
gram{tag} as (
  select {keys}, t, seed, n.n as "P", sum(p*p) as pp, sum(p*m) as pm, sum(m*m) as mm, sum(u*p) as up, sum(u*m) as um
  from basis{tag} join (values {', '.join(f'({n})' for n in ps)}) n(n) on pair < n.n/2 group by {keys}, t, seed, n.n),
tied{tag} as (
  select {keys}, t, obs, rn, (lag(rn, 2) over s + lag(rn, 1) over s)/sqrt(2) as rp,
    (lag(rn, 2) over s - lag(rn, 1) over s)/sqrt(2) as rm from ahead{tag} window s as ({on_keys} order by t)),
sys{tag} as (
  select g.*, z.z as z, r.obs, r.rn, r.rp, r.rm, g.pp + 2*z.z as ap, g.mm + 2*z.z as am
  from gram{tag} g join tied{tag} r using ({keys}, t), (values {', '.join(f'({z!r})' for z in zs)}) z(z) where r.rn is not null),
sol{tag} as (
  select *, case when am = 0 then rp/ap else (am*rp - pm*rm)/(ap*am - pm*pm) end as gp,
    case when am = 0 then 0 else (ap*rm - pm*rp)/(ap*am - pm*pm) end as gm from sys{tag}),
fc{tag} as (
  select {keys}, seed::bigint as seed, "P"::integer as "P", z::double as z, t, obs, up*gp + um*gm as forecast, rn as realized,
    sqrt(greatest(pp*gp*gp + 2*pm*gp*gm + mm*gm*gm, 0)) as beta_norm
  from sol{tag})"""


def targets_sql() -> str:
    shared = ", ".join(f"s.{c}" for c in SHARED_PREDICTORS)
    return f"""{MARKET},
bond as (
  select series_id, t, date, 'ltr_excess' as target, ltr-"Rfree" as raw from src where ltr is not null and corpr is not null
  union all
  select series_id, t, date, 'corpr_excess', corpr-"Rfree" from src where ltr is not null and corpr is not null),
bond_std as (
  select *, raw/nullif(case when count(raw) over w = 12 then sqrt(avg(raw*raw) over w) end, 0) as y
  from bond window w as (partition by target order by t rows between 12 preceding and 1 preceding)),
tgt as (
  select b.series_id, b.target, b.t, b.date, b.y, b.y as own_lag, {shared}
  from bond_std b join std s on b.t = s.t where b.y is not null and b.date <= {END})"""


def importance_sql() -> str:
    parts, ctes = [], [SUPPLIER_STD]
    for i, excluded in enumerate(("none", *SUPPLIER_PREDICTORS)):
        kept = [c for c in SUPPLIER_PREDICTORS if c != excluded]
        ctes.append(engine_sql("std", kept, (0, 1), (10.0,), "y", tag=f"_{i}"))
        parts.append(f"select '{excluded}' as excluded, * from fc_{i}")
    return ",".join(ctes) + f",\nvi_fc as ({' union all '.join(parts)})"


def spanning_sql(rows: str, keys: str, strategy: str = "strategy", name: str = "span") -> str:
    """Two-regressor least squares by partialling the market out of both sides."""
    k = keys.replace(" ", "").split(",")
    on = lambda a, b: " and ".join(f"{a}.{c} = {b}.{c}" for c in k)
    ks = ", ".join(f"r.{c}" for c in k)
    return f"""
{name}_m as (
  select {keys}, regr_slope({strategy}, realized) as ys, regr_intercept({strategy}, realized) as yi,
    regr_slope(benchmark, realized) as bs, regr_intercept(benchmark, realized) as bi from {rows} group by {keys}),
{name}_p as (
  select {ks}, r.{strategy} as y, r.benchmark as b, r.realized as m,
    r.{strategy} - l.yi - l.ys*r.realized as ry, r.benchmark - l.bi - l.bs*r.realized as rb
  from {rows} r join {name}_m l on {on('r', 'l')}),
{name}_b as (
  select {keys}, sum(ry*rb)/nullif(sum(rb*rb), 0) as beta_benchmark, avg(y) as my, avg(b) as mb, avg(m) as mm,
    var_pop(b) as vb, var_pop(m) as vm, covar_pop(b, m) as cbm, count(*) as n from {name}_p group by {keys}),
{name}_c as (
  select b.*, l.ys - b.beta_benchmark*l.bs as beta_market,
    b.my - b.beta_benchmark*b.mb - (l.ys - b.beta_benchmark*l.bs)*b.mm as alpha
  from {name}_b b join {name}_m l on {on('b', 'l')}),
{name}_r as (
  select {', '.join(f'p.{c}' for c in k)}, sum(pow(p.y - c.alpha - c.beta_benchmark*p.b - c.beta_market*p.m, 2)) as ssr
  from {name}_p p join {name}_c c on {on('p', 'c')} group by {', '.join(f'p.{c}' for c in k)}),
{name} as (
  select c.*, sqrt(r.ssr/c.n) as resid_std, sqrt(12)*alpha/nullif(sqrt(r.ssr/c.n), 0) as information_ratio,
    alpha/nullif(sqrt(r.ssr/(n-3)*(1.0/n + (mb*mb*vm - 2*mb*mm*cbm + mm*mm*vb)/(n*(vb*vm - cbm*cbm)))), 0) as alpha_tstat
  from {name}_c c join {name}_r r on {on('c', 'r')})"""


NAIVE_SPAN = f"""{NAIVE},{momentum_sql('panel', 'y', WEIGHTS_12)},
both_rows as (
  select f.*, m.strategy as benchmark, m.forecast as benchmark_forecast
  from fc f join mom m on f.series_id = m.series_id and f.t = m.t + 1)"""

SPAN = "alpha beta_benchmark beta_market alpha_tstat information_ratio resid_std"


def calibrated(k: int = 24) -> str:
    return f"""
sig_raw as (
  select *, 0.6*cos(dp) + 0.4*sin(ltr)*sin(dfr) as raw, row_number() over (partition by series_id order by t) as rn
  from std),
sig_cal as (select series_id, avg(raw) as center, stddev_samp(raw) as sd from sig_raw where rn <= {k} group by 1),
sig as (select r.*, (r.raw - c.center)/c.sd as g from sig_raw r join sig_cal c on r.series_id = c.series_id)"""


SHOCK = "sin(12.9898*(t - lo))"
TWIN = f"""{SUPPLIER_STD},{calibrated()},
shock as (
  select series_id, t, sin(12.9898*(t - min(t) over (partition by series_id))) as epsilon from std),
world as (
  select s.series_id, s.t, w.strength, w.market, sqrt(w.r2/(1-w.r2))*s.g as truth,
    coalesce(lag(s.g) over (partition by s.series_id, w.strength, w.market order by s.t), 0.0) as planted,
    e.epsilon + w.sign*sqrt(w.r2/(1-w.r2))
      * coalesce(lag(s.g) over (partition by s.series_id, w.strength, w.market order by s.t), 0.0) as y, s.dfr
  from sig s join shock e on s.series_id = e.series_id and s.t = e.t,
    (values ('easy', 0.2, 'plus', 1.0), ('easy', 0.2, 'minus', -1.0), ('realistic', 0.02, 'plus', 1.0),
      ('realistic', 0.02, 'minus', -1.0)) w(strength, r2, market, sign)),
twin as (select *, 0.8*y + 0.3*dfr*truth as forecast from world),
pair as (
  select p.series_id, p.strength, p.t, p.truth, 0.5*(p.forecast - m.forecast) as recovered
  from twin p join twin m on p.series_id = m.series_id and p.strength = m.strength and p.t = m.t
  where p.market = 'plus' and m.market = 'minus'),
rec as (
  select series_id, strength, corr(recovered, truth) as correlation, regr_intercept(recovered, truth) as intercept,
    regr_slope(recovered, truth) as slope, sqrt(avg(pow(recovered-truth, 2))) as rmse,
    sqrt(avg(pow(recovered-truth, 2)))/stddev_pop(truth) as nrmse, avg(recovered-truth) as bias
  from pair group by 1, 2)"""


def ar1_sql(panel: str, columns, bound: float | None = None) -> str:
    parts = " union all ".join(
        f"select series_id, t, '{c}' as predictor, {c} as x, lag({c}) over (partition by series_id order by t) as l from {panel}"
        for c in columns
    )
    phi = "regr_slope(x, l) + (1 + 3*regr_slope(x, l))/(count(*) - 1)"
    if bound is not None:
        phi = f"greatest(least({phi}, {bound}), -{bound})"
    return f"""
long as ({parts}),
ar as (
  select series_id, predictor, count(*) as n, {phi} as phi, avg(x) as mean, regr_slope(x, l) as phi_ols,
    regr_intercept(x, l) as intercept_ols from long group by 1, 2),
ar1 as (select *, (1-phi)*mean as intercept from ar)"""


def summary_sql(panel: str, columns, names=None, keys: str = "series_id", tag: str = "") -> str:
    names = names or {}
    parts = " union all ".join(
        f"select {keys}, '{names.get(c, c)}' as variable, t, {c} as x from {panel} where {c} is not null" for c in columns
    )
    return f"""
long{tag} as (select *, lag(x) over (partition by {keys}, variable order by t) as l from ({parts})),
summ{tag} as (
  select {keys}, variable, count(*) as count, avg(x) as mean, stddev_samp(x) as sd, min(x) as min, max(x) as max,
    corr(x, l) as ac1 from long{tag} group by {keys}, variable)"""


def anatomy_sql() -> str:
    """Two lags: the 2x2 normal equations in closed form."""
    return f"""{NAIVE},
made as (
  select series_id, t - 1 as t, avg(forecast) as forecast from fc
  where z = 0 and "P" = (select max("P") from fc where z = 0) group by 1, 2),
lags as (select series_id, t, y as x0, lag(y) over (partition by series_id order by t) as x1 from panel),
mo as (
  select m.series_id, avg(x0) as m0, avg(x1) as m1, avg(forecast) as mf, var_pop(x0) as v0, var_pop(x1) as v1,
    covar_pop(x0, x1) as c01, covar_pop(x0, forecast) as c0, covar_pop(x1, forecast) as c1, var_pop(forecast) as vf
  from made m join lags l on m.series_id = l.series_id and m.t = l.t where l.x1 is not null group by 1),
an as (select *, (c0*v1 - c1*c01)/(v0*v1 - c01*c01) as w0, (c1*v0 - c0*c01)/(v0*v1 - c01*c01) as w1 from mo),
anatomy as (
  select series_id, mf - w0*m0 - w1*m1 as intercept, w0, w1, (w0*c0 + w1*c1)/vf as r2 from an)"""


def projection_sql(made: str, returns: str, window: int = 12, name: str = "proj") -> str:
    """Forecasts ``made(series_id, t, forecast)`` on the last ``window`` returns ``y``: the normal equations, eliminated
    column by column. ``name``: series_id, w0.., intercept, r2."""
    n = window
    lags = ", ".join(f"lag(y, {k}) over w as x{k}" for k in range(n))
    cov = ", ".join(
        [f"covar_pop(x{i}, x{j}) as a{i}_{j}" for i in range(n) for j in range(n)] + [f"covar_pop(x{i}, f) as a{i}_{n}" for i in range(n)]
    )
    steps = []
    for k in range(n):
        cells = []
        for i in range(n):
            for j in range(k + 1, n + 1):
                unit = f"a{k}_{j}/a{k}_{k}"
                cells.append(f"{unit} as a{i}_{j}" if i == k else f"a{i}_{j} - a{i}_{k}*({unit}) as a{i}_{j}")
        source_ = f"{name}_{k - 1}" if k else f"{name}_mo"
        steps.append(f"{name}_{k} as materialized (select series_id, {', '.join(cells)} from {source_})")
    fit = " + ".join(f"s.a{k}_{n}*m.b{k}" for k in range(n))
    return f"""
{name}_lag as (select series_id, t, {lags} from {returns} window w as (partition by series_id order by t)),
{name}_row as (
  select m.series_id, m.forecast as f, {', '.join(f'l.x{k}' for k in range(n))}
  from {made} m join {name}_lag l on m.series_id = l.series_id and m.t = l.t where l.x{n - 1} is not null),
{name}_mo as materialized (
  select series_id, {cov}, {', '.join(f'avg(x{k}) as m{k}, covar_pop(x{k}, f) as b{k}' for k in range(n))},
    avg(f) as mf, var_pop(f) as vf from {name}_row group by 1),
{', '.join(steps)},
{name} as (
  select s.series_id, {', '.join(f's.a{k}_{n} as w{k}' for k in range(n))},
    m.mf - ({' + '.join(f's.a{k}_{n}*m.m{k}' for k in range(n))}) as intercept, ({fit})/m.vf as r2
  from {name}_{n - 1} s join {name}_mo m on s.series_id = m.series_id)"""


def boot_seed_sizes() -> str:
    return f"""{SUPPLIER},{ar1_sql('panel', ('dp',))},
resid as (
  select l.series_id, l.t, abs(l.x - a.intercept - a.phi*l.l) as size
  from long l join ar1 a on l.series_id = a.series_id where l.l is not null)"""


SHARED = tuple(c for c in SUPPLIER_PREDICTORS if c != "own_lag")
REVERSED = "y + {0} - 0.2*{1} - 0.2*{2}".format(*[f"sin(12.9898*(t - lo + {k}))" for k in (0, -1, -2)])
REVERSED_PANEL = f"""
rev_panel as (
  select * exclude (y, own_lag, lo), {REVERSED} as y, {REVERSED} as own_lag
  from (select *, min(t) over (partition by series_id) as lo from panel))"""


SIGNS = 500  # signs of a seed's stream written into a statement: five columns of at most a hundred months


def bootstrap_sql(panel: str, columns, seeds, base_seed: int) -> str:
    """Artificial predictors by running each recursion row after row; the seeds' signs are literals."""
    signs = ", ".join(
        f"({seed}, {k}, {int(v)})" for seed in seeds for k, v in enumerate(sign_stream(base_seed + seed, 0, SIGNS))
    )
    place = " ".join(f"when '{c}' then {j}" for j, c in enumerate(columns))
    wide = ", ".join(f"max(case when predictor = '{c}' then x end) as {c}" for c in columns)
    return f"""{ar1_sql(panel, columns)},
signs(seed, k, s) as (values {signs}),
fitted as (
  select l.*, a.phi, a.intercept, a.n, case l.predictor {place} end as j,
    l.t - min(l.t) over (partition by l.series_id, l.predictor) as step
  from long l join ar1 a on l.series_id = a.series_id and l.predictor = a.predictor),
moves as (
  select series_id, predictor, seed, t, phi, intercept + s*(x - intercept - phi*l) as move
  from fitted join signs on k = j*(n - 1) + step - 1 where step > 0),
path as (
  select series_id, predictor, seed, t, x from fitted, (select distinct seed from signs) where step = 0
  union all
  select p.series_id, p.predictor, p.seed, m.t, m.move + m.phi*p.x
  from path p join moves m on p.series_id = m.series_id and p.predictor = m.predictor and p.seed = m.seed and m.t = p.t + 1),
boot as (select series_id, seed::bigint as seed, t, {wide} from path group by 1, 2, 3)"""


def bootstrap_design_sql() -> str:
    """Two-feature models of each seed on that seed's artificial predictors, with their benchmark."""
    predictors = ", ".join(f"b.{c}" for c in SUPPLIER_PREDICTORS)
    seeds = (0, 1)
    panels = ",".join(
        f"""
seen_{s} as (
  select b.series_id, b.t, p.date, p.y, {predictors} from boot b join panel p on b.series_id = p.series_id and b.t = p.t
  where b.seed = {s}),{with_benchmark(f'seen_{s}', SUPPLIER_PREDICTORS, 'series_id', f'_b{s}', (s,))}"""
        for s in seeds
    )
    union = " union all ".join(f"select * from pairs_b{s}" for s in seeds)
    return f"recursive {SUPPLIER_STD},{bootstrap_sql('std', SUPPLIER_PREDICTORS, seeds, 2909)},{panels},\npairs as ({union})"


def with_benchmark(panel: str, predictors, keys: str, tag: str = "", seeds=(0, 1)) -> str:
    """Minimum-norm forecasts of a two-feature model next to timed momentum."""
    on = " and ".join(f"f.{k} = b.{k}" for k in [*keys.replace(" ", "").split(","), "t"])
    return f"""{engine_sql(panel, predictors, seeds, (0.0,), 'y', keys, tag=tag)},{timed_sql(panel, 'y', predictors, name=f'timed{tag}', keys=keys)},
pairs{tag} as (
  select f.*, b.strategy as benchmark, b.forecast as benchmark_forecast, b.oos_index
  from fc{tag} f join timed{tag} b on {on})"""


def designs_sql() -> str:
    predictors = ", ".join(f"s.{c}" for c in SUPPLIER_PREDICTORS)
    return f"""{SUPPLIER_STD},{REVERSED_PANEL},{standardized('rev_panel', 'rev_std', 'y', SUPPLIER_PREDICTORS, 'own_lag', f'date <= {END}')},
design as (
  select s.series_id, 'historical' as experiment, s.t, s.date, p.y, {predictors}
  from std s join panel p on s.series_id = p.series_id and s.t = p.t
  union all
  select s.series_id, 'ma2_reversal', s.t, s.date, p.y, {predictors}
  from rev_std s join rev_panel p on s.series_id = p.series_id and s.t = p.t),
{with_benchmark('design', SUPPLIER_PREDICTORS, 'series_id, experiment')}"""


def twin_designs_sql() -> str:
    world = "series_id, strength, market"
    tagged = ", ".join(f"p.{c}" for c in ("series_id", "strength", "market", "seed", "t", "obs", "forecast", "realized", "benchmark", "oos_index"))
    return f"""{SUPPLIER_STD},{calibrated()},
start as (select series_id, min(t) as lo from panel group by 1),
worlds as (
  select s.*, w.strength, w.market, w.r2 as signal_r2, sqrt(w.r2/(1-w.r2))*s.g as truth,
    sin(12.9898*(s.t - lo)) + w.sign*sqrt(w.r2/(1-w.r2))
      * coalesce(lag(s.g) over (partition by s.series_id, w.strength, w.market order by s.t), 0.0) as world_return
  from (select * exclude (y) from sig) s join start on s.series_id = start.series_id,
    (values ('easy', 0.2, 'plus', 1.0), ('easy', 0.2, 'minus', -1.0), ('realistic', 0.02, 'plus', 1.0),
      ('realistic', 0.02, 'minus', -1.0)) w(strength, r2, market, sign)),
world_y as (select *, world_return as y from worlds),
{with_benchmark('world_y', SHARED, world, '_s')},{with_benchmark('world_y', (*SHARED, 'world_return'), world, '_o')},
twin_rows as (
  select 'x14_shared' as predictor_set, {tagged}, p.strategy, w.truth, w.signal_r2 from pairs_s p
  join worlds w on p.series_id = w.series_id and p.strength = w.strength and p.market = w.market and p.t = w.t
  union all
  select 'x15_world_lag', {tagged}, p.strategy, w.truth, w.signal_r2 from pairs_o p
  join worlds w on p.series_id = w.series_id and p.strength = w.strength and p.market = w.market and p.t = w.t),
halves as (
  select p.series_id, p.predictor_set, p.strength, p.signal_r2, p.seed, p.oos_index, p.obs, p.truth,
    0.5*(p.forecast - m.forecast) as recovered
  from twin_rows p join twin_rows m on p.series_id = m.series_id and p.predictor_set = m.predictor_set
    and p.strength = m.strength and p.seed = m.seed and p.t = m.t
  where p.market = 'plus' and m.market = 'minus')"""


def _with(body: str, final: str) -> str:
    return f"with {body}\n{final}"


SOURCE_DOUBLES = 'price d12 e12 bm "AAA" "BAA" lty tbl svar ret ltr corpr "Rfree" infl ntis'


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    q["month_end_scan"] = """
select cast(year(l_shipdate)*100 + month(l_shipdate) as integer) as yyyymm, last_day(cast(l_shipdate as date)) as date,
  count(*) as n, sum(l_quantity) as qty from lineitem group by 1, 2"""
    q["bounded_scan"] = """
select o_orderkey, cast(o_orderdate as date) as o_orderdate, o_totalprice from orders
where o_orderdate between timestamp '1996-01-31' and timestamp '1999-06-30'"""
    q["landed_bounds"] = """
select o_orderkey, cast(o_orderdate as date) as o_orderdate, o_totalprice from orders
where o_orderdate between timestamp '1996-01-17' and timestamp '1999-06-30'"""
    q["landed_revisions"] = f"""
select o_orderkey, cast(o_orderdate as date) as o_orderdate,
  {rnd("o_totalprice + case when o_orderdate >= timestamp '1996-01-01' then 0 else 1 end", 2)} as o_totalprice from orders"""
    q["landed_target_join"] = _with(
        source("l_returnflag"),
        f"""select series_id, src.date, {rnd('e12', 5)} as e12, {rnd('tbl', 5)} as tbl, {rnd('turnover', 5)} as turnover
from src join (select last_day(cast(o_orderdate as date)) as date, sum(o_totalprice) as turnover from orders group by 1) o
  on src.date = o.date where month(src.date) in (6, 12)""",
    )
    q["percent_factor_ingest"] = f"""
select last_day(cast(l_shipdate as date)) as date, {rnd('sum(l_discount)/100.0')} as intl_mkt_excess,
  {rnd('sum(l_tax)/100.0')} as rf from lineitem group by 1"""
    q["pruned_scan"] = "select c_custkey, c_mktsegment, c_acctbal from customer"
    q["monthly_source"] = _with(source(), out("src", "series_id t date", SOURCE_DOUBLES, 5))
    q["stored_source"] = _with(source("l_returnflag"), out("src", "series_id t date", SOURCE_DOUBLES, 5))
    q["period_artifacts"] = _with(
        SUPPLIER,
        f"""select series_id, date, {rnd('y')} as y, '1997-06' as period from panel where date <= date '1997-06-30'
union all select series_id, date, {rnd('y')}, '2020-12' from panel where date <= date '2020-12-31'""",
    )
    q["default_predictor_levels"] = _with(
        SUPPLIER_STD,
        "\nunion all ".join(
            f"select '{c}' as predictor, count({c}) as n_rows, {rnd(f'avg({c})')} as mean from std"
            for c in SUPPLIER_PREDICTORS
        ),
    )
    q["tidy_market"] = _with(TIDY, out("tidy", "series_id t date", "mkt_excess " + " ".join(PREDICTORS)))
    q["bond_excess_returns"] = _with(
        source("l_returnflag"),
        f"""select series_id, date, {rnd('ltr-"Rfree"')} as ltr_excess, {rnd('corpr-"Rfree"')} as corpr_excess
from src where ltr-"Rfree" is not null and corpr-"Rfree" is not null""",
    )
    q["sample_trim"] = _with(
        SUPPLIER,
        out("panel", "series_id date", "y", where="where date <= date '1999-12-31'"),
    )
    q["analysis_start"] = _with(
        SUPPLIER_STD,
        out("std", "series_id t date", "y " + " ".join(SUPPLIER_PREDICTORS), where="where date >= date '1999-06-30'"),
    )
    complete = " and ".join(f"{c} is not null" for c in SOURCE_DOUBLES.split())
    q["complete_rows"] = _with(source(), out("src", "series_id t date", SOURCE_DOUBLES, 5, f"where {complete}"))
    q["source_span"] = _with(
        SUPPLIER_SOURCE,
        "select series_id, min(date) as first_month, max(date) as last_month, count(*) as n_rows from sup group by 1",
    )
    q["nonlinear_signal"] = _with(f"{SUPPLIER_STD},{calibrated()}", out("sig", "series_id t", "g"))
    q["display_labels"] = """
select case l_returnflag when 'A' then 'Accepted' when 'R' then 'Returned' else l_returnflag end as flag,
  case l_linestatus when 'O' then 'Open' end as status, sum(l_quantity) as qty from lineitem group by 1, 2"""
    q["study_metadata"] = _with(
        f"{NAIVE},{scored('fc', CELL)},{averages('scored', chr(34) + 'P' + chr(34) + ', z')}",
        f"""select "P", z, {rnd('"P"/12.0')} as c, 12 as "T", 2.0::double as gamma, strftime({END}, '%Y-%m') as sample_end,
  {rnd('sharpe')} as sharpe from means""",
    )
    q["one_to_one_left_join"] = _with(
        f"{source()},{ORDERS}",
        f"""select src.date, {rnd('ret', 4)} as ret, {rnd('turnover', 4)} as turnover
from src left join ord on src.date = ord.date""",
    )
    q["target_predictor_join"] = _with(targets_sql(), out("tgt", "target date", "y own_lag dp ltr ntis"))
    q["key_ordered_lookup"] = _with(
        SUPPLIER_STD,
        f"""select s.series_id, s.t, {rnd('s.y')} as y, {rnd('p.y')} as raw_y
from std s join panel p on s.series_id = p.series_id and s.t = p.t""",
    )
    q["neighbour_rows"] = _with(
        HOURLY,
        """select series_id, t, n, lag(n) over w as n_before, lead(n) over w as n_after
from hour window w as (partition by series_id order by t)""",
    )
    q["seed_config_product"] = _with(
        SUPPLIER_STD,
        f"""select e.excluded, s.seed::bigint as seed, count(*) as n_rows, count(distinct d.series_id) as n_series
from (select *, row_number() over w as rn, lead(t) over w as nxt
    from std window w as (partition by series_id order by t)) d,
  (values ('none'), {', '.join(f"('{c}')" for c in SUPPLIER_PREDICTORS)}) e(excluded), (values (0), (1)) s(seed)
where d.rn > 12 and d.nxt is not null group by 1, 2""",
    )
    q["axis_difference"] = _with(
        f"{source()},{ORDERS}",
        """select coalesce(src.date, ord.date) as date, case when ord.date is null then 1 else -1 end::bigint as side
from src full join ord on src.date = ord.date where src.date is null or ord.date is null""",
    )
    q["oos_r2"] = _with(
        NAIVE, f"select {CELL}, {rnd('1 - var_pop(realized-forecast)/var_pop(realized)')} as r2 from fc group by {CELL}"
    )
    q["sharpe_ratio"] = _with(
        NAIVE, f"select {CELL}, {rnd('sqrt(12)*avg(strategy)/stddev_pop(strategy)')} as sharpe from fc group by {CELL}"
    )
    full = f"{NAIVE},{scored('fc', CELL)}"
    q["alpha_statistics"] = _with(full, out("scored", CELL_OUT, "alpha information_ratio alpha_tstat"))
    q["alpha_by_residuals"] = q["alpha_statistics"]
    q["model_scores"] = _with(full, out("scored", CELL_OUT, STATS_NORM))
    near = NAIVE + """,
near as (select series_id, seed, "P", z, t, realized, 0.5 + 1e-6*sin(t*(seed + 1)) as forecast, 0.0 as beta_norm
  from fc where "P" = 2 and z = 0)"""
    q["near_spanned_scores"] = _with(
        f"{near},{scored('near', CELL, 'sn')}",
        f"select {CELL}, {rnd('alpha*1e6', 4)} as alpha, {rnd('information_ratio', 4)} as information_ratio, "
        f"{rnd('alpha_tstat', 4)} as alpha_tstat from sn",
    )
    q["spanning_collinear"] = _with(
        f"{full}",
        f"""select {CELL}, {rnd('alpha')} as alpha, {rnd('0.4*slope')} as beta_benchmark, {rnd('0.2*slope')} as beta_market,
  {rnd('alpha/sqrt(ssr/(n-3)*(1.0/n + mx*mx/sxx))')} as alpha_tstat, {rnd('information_ratio')} as information_ratio,
  {rnd('sqrt(ssr/n)')} as resid_std
from (select s.*, l.slope from scored s join scored_line l using ({CELL}))""",
    )
    q["benchmark_scores"] = _with(
        f"{SUPPLIER},{timed_sql('panel', 'y', SUPPLIER_PREDICTORS)},{scored('timed', 'series_id', norm=False)}",
        out("scored", "series_id", STATS),
    )
    q["averaged_statistics"] = _with(
        f"{full},{averages('scored', 'series_id, ' + chr(34) + 'P' + chr(34) + ', z', STATS_NORM)}",
        out("means", 'series_id "P" z', STATS_NORM),
    )
    stat_avgs = ", ".join(f"{rnd(f'avg({c})')} as {c}" for c in STATS.split())
    q["averages_with_seed_count"] = _with(
        full, f'select "P", z, {stat_avgs}, count(distinct seed) as n_seeds from scored group by "P", z'
    )
    q["mean_of_rows"] = _with(full, f"select {stat_avgs} from scored")
    anchor = 'z = 0 and "P" = (select max("P") from fc where z = 0)'
    q["ensemble_forecasts"] = _with(
        NAIVE,
        f"""select series_id, obs, {rnd('avg(forecast)')} as forecast, {rnd('avg(realized)')} as realized,
  {rnd('avg(strategy)')} as strategy from fc where {anchor} group by 1, 2""",
    )
    q["anchor_paths"] = _with(NAIVE, out("fc", "series_id seed obs", "forecast realized", where=f"where {anchor}"))
    q["path_lengths"] = _with(
        NAIVE,
        f"select series_id, seed, count(*) as n_rows, min(obs) as first_obs from fc where {anchor} group by 1, 2",
    )
    q["summary_panel"] = _with(
        f"{SUPPLIER},{summary_sql('panel', ('y', 'dp', 'ltr', 'dfr', 'svar'), {'y': 'target', 'dp': 'd/p'})}",
        out("summ", "series_id variable count", "mean sd min max ac1"),
    )
    q["hourly_summary"] = _with(
        f"{HOURLY_CELLS},\nholed as (select series_id, t, n, case when t % 7 <> 0 then total end as total, mean from hcell),"
        f"{summary_sql('holed', ('n', 'total', 'mean'))}",
        out("summ", "series_id variable count", "mean sd min max ac1"),
    )
    names = {"mkt_excess": "mkt excess", "bm": "b/m", "lag_mkt_excess": "lag mkt"}
    columns = ("mkt_excess", *PREDICTORS)
    q["market_summary"] = _with(
        f"{MARKET},\ntidy_in as (select * from tidy where date <= {END}),"
        f"{summary_sql('tidy_in', columns, names)},{summary_sql('std', columns, names, tag='2')}",
        " union all ".join(
            f"""select series_id, variable, count, {', '.join(f'{rnd(c)} as {c}' for c in 'mean sd min max ac1'.split())},
  (select min(date) from {src}) as first, (select max(date) from {src}) as last, '{panel}' as panel from {summ}"""
            for src, summ, panel in (("tidy_in", "summ", "raw"), ("std", "summ2", "standardized"))
        ),
    )
    q["source_cross_check"] = _with(
        f"{source()},{ORDERS}",
        f"""select {rnd('corr(ret-"Rfree", vwretd-"Rfree")')} as correlation, count(*) as n_overlap
from src join idx on src.date = idx.date where ret is not null and vwretd is not null""",
    )
    q["spanning_regression"] = _with(f"{NAIVE_SPAN},{spanning_sql('both_rows', CELL)}", out("span", CELL_OUT, SPAN))
    q["forecast_anatomy_two_lags"] = _with(anatomy_sql(), out("anatomy", "series_id", "intercept w0 w1 r2"))
    q["ar1_kendall"] = _with(
        f"{SUPPLIER},{ar1_sql('panel', ('dp', 'ltr', 'dfr', 'svar'))}",
        out("ar1", "series_id predictor n", "phi intercept phi_ols intercept_ols"),
    )
    q["ar1_kendall_bounded"] = _with(
        f"{HOURLY},{ar1_sql('hour', ('n', 'total', 'mean'), 0.05)}",
        out("ar1", "series_id predictor n", "phi intercept phi_ols intercept_ols"),
    )
    q["ar1_innovations"] = _with(
        f"""{SUPPLIER},{ar1_sql('panel', ('dp', 'ltr'))},
resid as (
  select l.series_id, l.t, l.predictor, l.x - a.intercept - a.phi*l.l as e
  from long l join ar1 a on l.series_id = a.series_id and l.predictor = a.predictor where l.l is not null)""",
        f"""select series_id, t, {rnd("max(case when predictor='dp' then e end)")} as dp,
  {rnd("max(case when predictor='ltr' then e end)")} as ltr from resid group by 1, 2""",
    )
    q["twin_worlds"] = _with(TWIN, out("world", "series_id t strength market", "truth planted y"))
    q["recovery_statistics"] = _with(
        TWIN, out("rec", "series_id strength", "correlation intercept slope rmse nrmse bias")
    )
    q["twin_paths"] = _with(
        TWIN,
        f"select strength, t, {rnd('avg(truth)')} as truth, {rnd('avg(recovered)')} as recovered from pair group by 1, 2",
    )
    prior = "rows between {0} preceding and 1 preceding"
    q["trailing_volatility"] = _with(
        SUPPLIER,
        f"""select series_id, t, {rnd('case when count(y) over w = 12 then sqrt(avg(y*y) over w) end')} as vol
from panel window w as (partition by series_id order by t {prior.format(12)})""",
    )
    q["trailing_volatility_hourly"] = _with(
        HOURLY,
        f"""select series_id, t, {rnd('case when count(total) over w = 24 then sqrt(avg(total*total) over w) end')} as vol
from hour window w as (partition by series_id order by t {prior.format(24)})""",
    )
    past = "rows between unbounded preceding and 1 preceding"
    q["expanding_volatility"] = _with(
        SUPPLIER,
        f"""select series_id, t, {rnd('case when count(dp) over w >= 36 then stddev_samp(dp) over w end')} as sd_dp,
  {rnd('case when count(ltr) over w >= 36 then stddev_samp(ltr) over w end')} as sd_ltr
from panel window w as (partition by series_id order by t {past})""",
    )
    q["expanding_volatility_hourly"] = _with(
        HOURLY,
        f"""select series_id, t, {rnd('case when count(mean) over w >= 48 then stddev_samp(mean) over w end')} as sd
from hour window w as (partition by series_id order by t {past})""",
    )
    every = " ".join(SUPPLIER_PREDICTORS)
    valid = " and ".join(f"{c} is not null" for c in ("y", *SUPPLIER_PREDICTORS))
    q["standardized_inputs"] = _with(
        f"{SUPPLIER},{standardized('panel', 'std', 'y', SUPPLIER_PREDICTORS, 'own_lag', drop=False)}",
        out("std", "series_id t date", f"y {every}").replace(" from std", f", ({valid}) as valid from std"),
    )
    q["standardized_market"] = _with(MARKET, out("std", "series_id t date", "mkt_excess " + " ".join(PREDICTORS)))
    hourly_std = f"""{HOURLY},
hpan as (select series_id, t, total as y, n, mean from hour),
{standardized('hpan', 'std', 'y', ('n', 'mean'), '', window=24, burn=48, keys='series_id, t')}"""
    q["standardized_hourly"] = _with(hourly_std, out("std", "series_id t", "y n mean"))
    q["contiguity_gaps"] = _with(
        HOURLY_CELLS,
        """select series_id, t from (
  select series_id, t, t - lag(t) over (partition by series_id order by t) as d from hcell) where d > 1""",
    )
    health = """select series_id, min(t) as t_min, max(t) as t_max, count(*) as n_rows,
  max(t) - min(t) + 1 - count(*) as n_missing, 0::bigint as n_non_finite from natm group by 1"""
    q["series_health"] = _with(NATION, health)
    q["rejected_series"] = _with(
        NATION,
        f"""select series_id, n_rows, case when n_missing > 0 then 'gap in the time axis'
  when n_rows < 80 then 'fewer than 80 rows' else 'usable' end as reason from ({health})""",
    )
    q["non_finite_series"] = _with(
        SUPPLIER_SOURCE,
        """select *, case when n_non_finite > 0 then 'non-finite cells' when n_missing > 0 then 'gap in the time axis'
  when n_rows < 80 then 'fewer than 80 rows' end as reason
from (select series_id, min(t) as t_min, max(t) as t_max, count(*) as n_rows, max(t) - min(t) + 1 - count(*) as n_missing,
  sum(case when rev > 0 then 0 else 1 end)::bigint as n_non_finite from sup group by 1)
where n_non_finite > 0 or n_missing > 0 or n_rows < 80""",
    )
    q["dense_positions"] = _with(
        HOURLY_CELLS,
        """select series_id, t as hour, row_number() over (partition by series_id order by t) - 1 as t from hcell""",
    )
    q["weighted_momentum"] = _with(
        f"{SUPPLIER},{momentum_sql('panel', 'y', WEIGHTS_12)}",
        out("mom", "series_id t oos_index", "forecast realized strategy"),
    )
    q["weighted_momentum_custom"] = _with(
        f"{HOURLY},{momentum_sql('hour', 'n', (0.5, 0.3, 0.2))}",
        out("mom", "series_id t oos_index", "forecast realized strategy"),
    )
    q["volatility_timed_momentum"] = _with(
        f"{SUPPLIER},{timed_sql('panel', 'y', SUPPLIER_PREDICTORS)}",
        out("timed", "series_id t oos_index", "forecast realized strategy predictor_variance"),
    )
    q["moving_average_reversal"] = _with(
        SUPPLIER,
        f"""select series_id, t, {rnd('y')} as y, {rnd(REVERSED)} as y_reversed
from (select *, min(t) over (partition by series_id) as lo from panel)""",
    )
    q["reversal_inputs"] = _with(
        f"""{SUPPLIER},{REVERSED_PANEL},
{standardized('rev_panel', 'std', 'y', SUPPLIER_PREDICTORS, 'own_lag')}""",
        f"""select s.series_id, s.t, {rnd('p.y')} as raw_y, {', '.join(f'{rnd("s." + c)} as {c}' for c in SUPPLIER_PREDICTORS)}
from std s join rev_panel p on s.series_id = p.series_id and s.t = p.t where s.date <= {END}""",
    )
    for name, scale in (
        ("training_window_scaling", "stddev_samp({0}) over w"),
        ("training_window_scaling_uncentered", "sqrt(avg({0}*{0}) over w)"),
    ):
        unit = lambda c, scale=scale: (
            f"{c}/(case when {scale.format(c)} > 1e-12 then {scale.format(c)} else 1 end)"
        )
        q[name] = _with(
            f"{SUPPLIER_STD},{features_sql('std', SUPPLIER_PREDICTORS, (0,), 'y')},\n"
            f"sc as (select series_id, t, {unit('s1')} as s1, {unit('s2')} as s2, count(*) over w as nw from feat "
            f"window w as (partition by series_id order by t {prior.format(12)}))",
            out("sc", "series_id t", "s1 s2", where="where nw = 12"),
        )
    totals = ", ".join(f"({s}, {float(draw_weights(4, len(SUPPLIER_PREDICTORS), s).sum())!r})" for s in range(3))
    q["rff_weight_table"] = _with(
        SUPPLIER,
        f"""select series_id, n_rows, w.seed::bigint as seed, {rnd('w.total::double')} as total,
  {4 * len(SUPPLIER_PREDICTORS)}::bigint as n_weights
from (select series_id, count(*) as n_rows from panel group by 1) s
join (values {totals}) w(seed, total) on cast(s.series_id as bigint) % 3 = w.seed""",
    )
    wide = draw_weights(2, len(SUPPLIER_PREDICTORS), 1)
    angle = [" + ".join(f"({float(v)!r})*{c}" for v, c in zip(w, SUPPLIER_PREDICTORS)) for w in wide]
    q["fourier_features_native"] = _with(
        SUPPLIER_STD,
        "select series_id, t, "
        + ", ".join(
            f"{rnd(f'{fn}(2.0*({angle[i]}))')} as s{2 * i + 1 + j}"
            for i in range(2)
            for j, fn in enumerate(("sin", "cos"))
        )
        + " from std",
    )
    many = draw_weights(32, len(SUPPLIER_PREDICTORS), 1)
    pairs = ", ".join(f"({i}, {', '.join(repr(float(v)) for v in w)})" for i, w in enumerate(many))
    names = ", ".join(f"w{j}" for j in range(len(SUPPLIER_PREDICTORS)))
    total = " + ".join(f"w{j}*{c}" for j, c in enumerate(SUPPLIER_PREDICTORS))
    q["fourier_features_wide"] = _with(
        f"{SUPPLIER_STD},\nangles as (select series_id, t, pair, 2.0*({total}) as a from std, (values {pairs}) w(pair, {names}))",
        f"""select series_id, t, (2*pair)::integer as k, {rnd('sin(a)')} as feature from angles
union all select series_id, t, (2*pair + 1)::integer as k, {rnd('cos(a)')} as feature from angles""",
    )
    fc_plain = 'series_id seed "P" z t obs'
    q["ridge_forecasts"] = _with(SUPPLIER_ENGINE, out("fc", fc_plain, "forecast realized beta_norm", 5))
    q["uncentered_ridge_forecasts"] = _with(
        f"{SUPPLIER_STD},{engine_sql('std', SUPPLIER_PREDICTORS, (0, 1), (1.0,), 'y', uncentered=True)}",
        out("fc", fc_plain, "forecast realized beta_norm", 5),
    )
    q["ridgeless_forecasts"] = _with(
        f"{MARKET},{engine_sql('std', PREDICTORS, (0, 1), (0.0,), 'mkt_excess')}",
        out("fc", fc_plain, "forecast realized beta_norm", 4),
    )
    q["wide_forecasts"] = _with(
        f"{SUPPLIER_STD},{dual_sql('std', SUPPLIER_PREDICTORS, (0, 1), (0.1, 10.0, 0.0), (8, 24, 96), 'y')}",
        out("fc", fc_plain, "forecast realized beta_norm", 2),
    )
    wide = dual_sql('std', SUPPLIER_PREDICTORS, (0, 1), (0.1, 10.0, 0.0), (8, 24, 96), 'y')
    q["wide_grid"] = _with(
        f"{SUPPLIER_STD},{wide},{scored('fc', CELL)},{averages('scored', 'series_id, ' + chr(34) + 'P' + chr(34) + ', z', STATS_NORM)}",
        out("means", 'series_id "P" z', STATS.replace("r2", ""), 3).replace(
            " from means", f", {rnd('asinh(means.r2)', 3)} as r2_asinh, {rnd('means.' + chr(34) + 'P' + chr(34) + '/2.0', 3)} as c from means"
        ),
    )
    q["ridgeless_wide"] = _with(
        f"{MARKET},{dual_sql('std', PREDICTORS, (3,), (0.0,), (48, 600), 'mkt_excess')}",
        out("fc", fc_plain, "forecast realized beta_norm", 4),
    )
    pz = 'series_id, "P", z'
    for name, engine in (("market", MARKET_ENGINE), ("supplier", SUPPLIER_ENGINE)):
        body = f"{engine},{scored('fc', CELL)}"
        c = f", {rnd('2/12.0', 5)} as c"
        q[f"{name}_grid_per_seed"] = _with(
            body, out("scored", CELL_OUT, STATS_NORM, 5).replace(" from scored", f"{c} from scored")
        )
        q[f"{name}_grid"] = _with(
            f"{body},{averages('scored', pz, STATS_NORM)}",
            out("means", 'series_id "P" z', STATS_NORM, 5).replace(" from means", f"{c} from means"),
        )
    q["forecast_export"] = _with(
        MARKET_ENGINE, out("fc", 'series_id seed "P" z obs', "forecast realized strategy", 5)
    )
    q["anchor_export"] = _with(
        f"{SUPPLIER_STD},{engine_sql('std', SUPPLIER_PREDICTORS, (0, 1), (1000.0, 0.0), 'y')}",
        out("fc", 'series_id seed "P" z obs', "forecast realized strategy", 4),
    )
    tz = 'series_id, target, "P", z'
    target_engine = (
        f"{targets_sql()},{engine_sql('tgt', ('own_lag', *SHARED_PREDICTORS), (0, 1), (0.1, 10.0), 'y', 'series_id, target')},"
        + scored("fc", 'series_id, target, seed, "P", z')
    )
    q["target_grid"] = _with(
        f"{target_engine},{averages('scored', tz, STATS_NORM)}",
        out("means", 'series_id target "P" z', STATS_NORM, 5).replace(
            " from means", f", {rnd('2/12.0', 5)} as c from means"
        ),
    )
    vi = f"{importance_sql()},{scored('vi_fc', 'series_id, excluded, seed')}"
    q["predictor_importance"] = _with(
        f"{vi},\nvim as (select series_id, excluded, avg(r2) as r2, avg(sharpe) as sharpe, count(distinct seed) as n_seeds "
        "from scored group by 1, 2)",
        f"""select m.series_id, m.excluded as variable, {rnd('f.r2 - m.r2', 5)} as vi_r2,
  {rnd('f.sharpe - m.sharpe', 5)} as vi_sharpe, m.n_seeds
from vim m join vim f on m.series_id = f.series_id and f.excluded = 'none' where m.excluded <> 'none'""",
    )
    q["importance_leaders"] = _with(
        f"{vi},\nvim as (select excluded, avg(r2) as r2, avg(sharpe) as sharpe, count(distinct seed) as n_seeds "
        "from scored group by 1)",
        f"""select m.excluded as variable, {rnd('f.r2 - m.r2', 5)} as vi_r2, {rnd('f.sharpe - m.sharpe', 5)} as vi_sharpe,
  m.n_seeds from vim m, vim f where f.excluded = 'none' and m.excluded <> 'none'
order by f.r2 - m.r2 desc, m.excluded limit 3""",
    )
    hourly_dated = hourly_std.replace(
        "hpan as (select series_id, t, total as y, n, mean from hour)",
        "hpan as (select series_id, t, t as date, total as y, n, mean from hour)",
    ).replace("select series_id, t, y/", "select series_id, t, date, y/")
    q["hourly_grid"] = _with(
        f"{hourly_dated},{engine_sql('std', ('n', 'mean'), (0, 1), (1.0,), 'y', window=24)},{scored('fc', CELL)}",
        out("scored", CELL_OUT, STATS_NORM, 5),
    )
    q["anchor_selection"] = _with(
        f"{full},{averages('scored', pz)}",
        out("means", 'series_id "P" z', "sharpe alpha_tstat", where='where z = 0 and "P" = 12'),
    )
    q["ridge_panel_rows"] = _with(
        f"{target_engine},{averages('scored', tz, STATS_NORM)}",
        f"""select target, "P", z, {rnd('2/12.0', 5)} as c, {rnd('r2', 5)} as r2, {rnd('sharpe', 5)} as sharpe from means""",
    )
    q["grid_panel_rows"] = _with(
        f"{full},{averages('scored', pz)}",
        f"""select series_id as target, "P", z, {rnd('"P"/12.0')} as c, {rnd('r2')} as r2, {rnd('sharpe')} as sharpe from means""",
    )
    q["distinct_levels"] = _with(NAIVE, 'select distinct z, "P" from fc')
    q["sorted_paths"] = _with(NAIVE, out("fc", "seed obs series_id", "forecast", where=f"where {anchor}"))
    q["union_of_studies"] = _with(
        f"{source('l_returnflag')},{ORDERS}",
        f"""select series_id, date, {rnd('ret')} as value from src where ret is not null
union all select 'orders', date, {rnd('vwretd')} from idx where vwretd is not null""",
    )
    q["bootstrap_innovation_sizes"] = _with(boot_seed_sizes(), out("resid", "series_id t", "size"))
    q["bootstrap_panel"] = _with(
        f"recursive {SUPPLIER},{bootstrap_sql('panel', ('dp', 'ltr', 'dfr'), (0, 1), 2909)}",
        out("boot", "series_id seed t", "dp ltr dfr"),
    )
    mean_of = lambda stats, digits=4: ", ".join(f"{rnd(f'avg({c})', digits)} as {c}" for c in stats.split())
    designs = designs_sql()
    timed_rows = "timed_rows as (select * exclude (forecast), benchmark_forecast as forecast from pairs)"
    q["reversal_designs"] = _with(
        f"{designs},\n{timed_rows},{scored('pairs', 'series_id, experiment, seed', 'model')},"
        f"{scored('timed_rows', 'series_id, experiment, seed', 'bench')}",
        " union all ".join(
            f"""select series_id, experiment, '{label}' as strategy, {mean_of(STATS)}, count(distinct seed) as n_seeds
from {rows} group by 1, 2"""
            for rows, label in (("model", "RFF"), ("bench", "Volatility-timed momentum"))
        ),
    )
    q["reversal_design_spanning"] = _with(
        f"{designs},{spanning_sql('pairs', 'series_id, experiment, seed')}",
        f"select series_id, experiment, {mean_of(SPAN)}, count(distinct seed) as n_seeds from span group by 1, 2",
    )
    drawn = bootstrap_design_sql()
    q["bootstrap_design"] = _with(
        f"{drawn},\n{timed_rows},{scored('pairs', 'series_id, seed', 'model')},{scored('timed_rows', 'series_id, seed', 'bench')}",
        " union all ".join(
            f"""select series_id, 'wild_bootstrap' as experiment, '{label}' as strategy, {mean_of(STATS)}, count(distinct seed) as n_seeds
from {rows} group by 1"""
            for rows, label in (("model", "RFF"), ("bench", "Volatility-timed momentum"))
        ),
    )
    q["bootstrap_design_spanning"] = _with(
        f"{drawn},{spanning_sql('pairs', 'series_id, seed')}",
        f"select series_id, 'wild_bootstrap' as experiment, {mean_of(SPAN)}, count(distinct seed) as n_seeds from span group by 1",
    )
    twins = twin_designs_sql()
    q["twin_design_recovery"] = _with(
        f"""{twins},
rec as (
  select series_id, predictor_set, strength, seed, corr(recovered, truth) as correlation,
    regr_intercept(recovered, truth) as intercept, regr_slope(recovered, truth) as slope,
    sqrt(avg(pow(recovered-truth, 2))) as rmse, sqrt(avg(pow(recovered-truth, 2)))/stddev_pop(truth) as nrmse,
    avg(recovered-truth) as bias from halves group by 1, 2, 3, 4)""",
        f"""select series_id, predictor_set, strength, {mean_of('correlation intercept slope rmse nrmse bias')},
  count(distinct seed) as n_seeds from rec group by 1, 2, 3""",
    )
    world = "series_id, predictor_set, strength, market, seed"
    market = ", ".join(
        f"{rnd(f'avg(m.{c})', 4)} as {n}"
        for c, n in (("sharpe", "sharpe"), ("alpha", "market_alpha"), ("alpha_tstat", "market_alpha_tstat"),
                     ("information_ratio", "market_information_ratio"))
    )
    spanned = ", ".join(f"{rnd(f'avg(s.{c})', 4)} as {c}" for c in SPAN.split())
    matched = " and ".join(f"m.{k} = s.{k}" for k in world.split(", "))
    q["twin_design_spanning"] = _with(
        f"{twins},{scored('twin_rows', world, 'model', norm=False)},{spanning_sql('twin_rows', world)}",
        f"""select m.series_id, m.predictor_set, m.strength, m.market, {market}, {spanned}, count(distinct m.seed) as n_seeds
from model m join span s on {matched} group by 1, 2, 3, 4""",
    )
    q["twin_design_paths"] = _with(
        twins,
        f"""select series_id, predictor_set, strength, signal_r2::double as signal_r2, oos_index, obs, {mean_of('truth recovered')},
  count(distinct seed) as n_seeds from halves group by 1, 2, 3, 4, 5, 6""",
    )
    anchored = f"{SUPPLIER_STD},{with_benchmark('std', SUPPLIER_PREDICTORS, 'series_id')}"
    q["study_diagnostics"] = _with(
        f"{anchored},{scored('pairs', 'series_id, seed', 'model')},{scored('timed', 'series_id', 'bench', norm=False)}",
        f"""select series_id, {mean_of(STATS)}, count(distinct seed) as n_seeds, 'RFF (ridgeless)' as strategy,
  'standardized' as target_scale from model group by 1
union all select series_id, {', '.join(f'{rnd(c, 4)} as {c}' for c in STATS.split())}, 1, 'Volatility-timed momentum',
  'standardized' from bench""",
    )
    q["metrics_display"] = _with(
        f"{anchored},{scored('pairs', 'series_id, seed', 'model')},{scored('timed', 'series_id', 'bench', norm=False)}",
        " union all ".join(
            f"select '{label}' as strategy, {mean_of('sharpe alpha information_ratio alpha_tstat r2')} from {rows}"
            for rows, label in (("model", "RFF (ridgeless)"), ("bench", "Volatility-timed momentum"))
        ),
    )
    q["twin_spanning_display"] = _with(
        f"{twins},{spanning_sql('twin_rows', world)}",
        f"""select case predictor_set when 'x14_shared' then '14 shared' else '15 world' end as inputs, strength as signal,
  case market when 'plus' then '+' else '-' end as twin, {mean_of('alpha_tstat information_ratio beta_benchmark')}
from span group by 1, 2, 3""",
    )
    made = """
made as (select series_id, t - 1 as t, avg(forecast) as forecast from fc
  where z = 0 and "P" = (select max("P") from fc where z = 0) group by 1, 2)"""
    each = lambda digits: ", ".join(f"({k}, {rnd(f'w{k}', digits)})" for k in range(12))
    q["forecast_anatomy_full"] = _with(
        f"{NAIVE},{made},{projection_sql('made', 'panel')}",
        f"""select series_id, l.lag::integer as lag, l.weight as weight, {rnd('intercept')} as intercept, {rnd('r2')} as r2
from proj, lateral (values {each(6)}) l(lag, weight)""",
    )
    q["study_anatomy"] = _with(
        f"{anchored},\nmean_path as (select series_id, t, avg(forecast) as forecast from pairs group by 1, 2),"
        f"{projection_sql('mean_path', 'std')}",
        f"""select series_id, (l.lag + 1)::integer as lag, l.weight as projection_weight, l.weight as lag_weight,
  {rnd('(12 - l.lag)/78.0::double', 5)} as benchmark_weight from proj, lateral (values {each(5)}) l(lag, weight)""",
    )
    q["study_spanning"] = _with(
        f"{anchored},{spanning_sql('pairs', 'series_id, seed')}",
        f"""select series_id, {mean_of(SPAN)}, count(distinct seed) as n_seeds, 'mean of per-seed statistics' as aggregation,
  'standardized' as target_scale from span group by 1""",
    )
    text = lambda e, d: f"format('{{:,.{d}f}}', {e})"
    rows = [
        ("MktSharpe", "(select sharpe from means where z = 0 and \"P\" = 12)", 2),
        ("MktBestSharpe", "(select sharpe from means where z = 10 and \"P\" = 12)", 2),
        ("MktAlphaT", "(select alpha_tstat from means where z = 0 and \"P\" = 12)", 2),
        ("Months", "(select count(distinct t)::double from panel)", 0),
        ("PanelRows", f"(select count(*)::double from panel where date <= {END})", 0),
    ]
    q["report_values"] = _with(
        f"{full},{averages('scored', chr(34) + 'P' + chr(34) + ', z')}",
        " union all ".join(f"select '{n}' as name, {rnd(e)} as value, {text(e, d)} as text" for n, e, d in rows),
    )
    exp = f"""{NAIVE_SPAN},
exp_rows as (
  select *, case seed when 0 then 'historical' when 1 then 'ma2_reversal' else 'wild_bootstrap' end as experiment
  from both_rows where "P" = 12 and z = 0),
exp_bench as (select * exclude (forecast), benchmark_forecast as forecast from exp_rows),
{scored('exp_rows', 'experiment, series_id', 'model')},{scored('exp_bench', 'experiment, series_id', 'bench')},
{spanning_sql('exp_rows', 'experiment, series_id')}"""
    q["comparison_panel"] = _with(
        exp,
        f"""select case m.experiment when 'historical' then 'Historical' when 'ma2_reversal' then 'MA(2) reversal'
    else 'Wild predictors' end as experiment, {rnd('m.ir')} as rff_ir, {rnd('m.at')} as rff_alpha_t,
  {rnd('b.ir')} as benchmark_ir, {rnd('b.at')} as benchmark_alpha_t, {rnd('s.ir')} as spanned_ir,
  {rnd('s.at')} as spanned_alpha_t
from (select experiment, avg(information_ratio) as ir, avg(alpha_tstat) as at from model group by 1) m
join (select experiment, avg(information_ratio) as ir, avg(alpha_tstat) as at from bench group by 1) b on m.experiment = b.experiment
join (select experiment, avg(information_ratio) as ir, avg(alpha_tstat) as at from span group by 1) s on m.experiment = s.experiment""",
    )
    q["recovery_display"] = _with(
        TWIN,
        f"""select '14 shared inputs' as inputs, strength as signal, {rnd('avg(correlation)')} as correlation,
  {rnd('avg(slope)')} as slope, {rnd('avg(nrmse)')} as nrmse from rec group by 2""",
    )
    return q
