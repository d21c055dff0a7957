"""The estimator's queries: stand-ins for its tables are lineitem's numeric columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.kde import losses, model as M
from quern.kde.config import Config, Metric
from quern.queries.base import query, table
from quern.session import shared_path

COLS = ["l_quantity", "l_extendedprice", "l_discount"]
#: The sample: as many rows as the setting says, in a pseudo-random order of the keys that SQL can repeat.
PICK = "(l_orderkey * 7919 + l_linenumber * 104729) % 1000003"
PICK_ORDER = ["l_orderkey", "l_linenumber", *COLS]
SIZE = Config().kde_samplesize
SQL_SAMPLE = f"select {', '.join(f'cast({c} as double) as {c}' for c in COLS)} from (select * from lineitem order by {PICK}, {', '.join(PICK_ORDER)} limit {SIZE})"
SQL_STD = f"s as ({SQL_SAMPLE}), m as (select count(*) as n, {', '.join(f'avg({c}) as m_{c}, stddev_samp({c}) as d_{c}' for c in COLS)} from s)"
#: Query boxes in raw units: id, then low and high of each column.
BOXES = [(1, 5, 15, 5000, 40000, 0.01, 0.05), (2, 20, 40, 20000, 60000, 0.03, 0.09), (3, 1, 50, 900, 100000, 0.0, 0.1), (4, 45, 49, 60000, 90000, 0.06, 0.08), (5, 60, 70, 0, 1, 0.2, 0.3)]
SQL_BOXES = "q(query_id, " + ", ".join(f"a_{c}, b_{c}" for c in COLS) + ") as (values " + ", ".join(str(tuple(float(v) if i else v for i, v in enumerate(b))) for b in BOXES) + ")"


def sample(spark: SparkSession, d: str) -> DataFrame:
    """A deterministic sample of kde_samplesize rows, by arithmetic on keys; the best rows of each partition are merged, nothing is sorted whole."""
    rows = table(spark, d, "lineitem").select(*PICK_ORDER).orderBy(F.expr(PICK), *PICK_ORDER).limit(SIZE)
    return rows.select(*(F.col(c).cast("double").alias(c) for c in COLS))


def standard(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, int]:
    """(standardised sample, standardised boxes, sample size)."""
    s = sample(spark, d)
    n, mean, sd = M.moments(s, COLS)
    st = s.select(*(((F.col(c) - float(m)) / float(v)).alias(c) for c, m, v in zip(COLS, mean, sd, strict=True)))
    rows = [(b[0], *(float((v - mean[i // 2]) / sd[i // 2]) for i, v in enumerate(b[1:]))) for b in BOXES]
    q = spark.createDataFrame(rows, "query_id int, " + ", ".join(f"lo_{c} double, hi_{c} double" for c in COLS))
    return st, q, n


def _sql_factor(c: str, kernel: str, h: str = "h") -> str:
    x, lo, hi = (f"((s.{c} - m_{c}) / d_{c})", f"((a_{c} - m_{c}) / d_{c})", f"((b_{c} - m_{c}) / d_{c})")
    if kernel == "epanechnikov":
        a, b = f"greatest({lo}, {x} - {h})", f"least({hi}, {x} + {h})"
        return f"(0.75 * case when {b} > {a} then (({h} * {h} - {x} * {x}) * ({b} - {a}) + {x} * ({b} * {b} - {a} * {a}) - ({b} * {b} * {b} - {a} * {a} * {a}) / 3.0) / ({h} * {h} * {h}) else 0.0 end)"
    return f"(0.5 * (erf_(({hi} - {x}) / (sqrt(2.0) * {h})) - erf_(({lo} - {x}) / (sqrt(2.0) * {h}))))"


def _erf_sql(text: str) -> str:
    """Expand erf_(x) to the polynomial, innermost text balanced by parentheses."""
    while (at := text.find("erf_(")) >= 0:
        i, depth = at + 5, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(text[i], 0)
            i += 1
        x = "(" + text[at + 5 : i - 1] + ")"
        t = f"(1.0 / (1.0 + {M.ERF_P} * abs({x})))"
        p = "0.0"
        for a in reversed(M.ERF_A):
            p = f"(({p}) + {a}) * {t}"
        text = text[:at] + f"(sign({x}) * (1.0 - ({p}) * exp(-{x} * {x})))" + text[i:]
    return text


def _sql_estimate(kernel: str, digits: int = 6) -> str:
    mass = " * ".join(_sql_factor(c, kernel) for c in COLS)
    return _erf_sql(f"with {SQL_STD}, {SQL_BOXES}, hh as (select pow(4.0 / ({len(COLS) + 2} * n), 1.0 / {len(COLS) + 4}) as h from m) select query_id, round(sum({mass}) / count(*), {digits}) as estimate from q, s, m, hh group by query_id")


def _truth(df: DataFrame) -> DataFrame:
    row = df.agg(*(F.count_if(F.expr(" and ".join(f"{c} > {b[1 + 2 * i]} and {c} < {b[2 + 2 * i]}" for i, c in enumerate(COLS)))).alias(f"q{b[0]}") for b in BOXES), F.count("*").alias("n"))
    return row.select(F.explode(F.array(*(F.struct(F.lit(b[0]).alias("query_id"), F.col(f"q{b[0]}").alias("qualified"), F.col("n").alias("alltuples")) for b in BOXES))).alias("r")).select("r.*")


SQL_TRUTH = "select query_id, count(*) filter (where " + " and ".join(f"{c} > a_{c} and {c} < b_{c}" for c in COLS) + ") as qualified, count(*) as alltuples from lineitem, q group by query_id"


@query("kde_range_slice", _erf_sql(f"with {SQL_STD}, {SQL_BOXES}, hh as (select pow(4.0 / (5 * n), 1.0 / 7) as h from m), e as (select query_id, sum({' * '.join(_sql_factor(c, 'epanechnikov') for c in COLS)}) / count(*) as e from q, s, m, hh group by query_id), t as ({SQL_TRUTH}) select query_id, qualified, round(e, 6) as estimate, round((e - qualified::double / alltuples) * (e - qualified::double / alltuples), 6) as quadratic_error from e join t using (query_id)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    s, q, n = standard(spark, d)
    e = M.estimate_batch(q, s, COLS, [M.scott(3, n)] * 3)
    t = _truth(table(spark, d, "lineitem"))
    truth = F.col("qualified") / F.col("alltuples")
    return e.join(F.broadcast(t), "query_id").select("query_id", "qualified", F.round("estimate", 6).alias("estimate"), F.round(losses.loss(Metric.QUADRATIC, F.col("estimate"), truth), 6).alias("quadratic_error"))


@query("kde_normalise", f"with {SQL_STD} select round(avg((s.l_quantity - m_l_quantity) / d_l_quantity), 6) + 0.0 as mean, round(stddev_samp((s.l_quantity - m_l_quantity) / d_l_quantity), 6) as sd, count(*) as n from s, m")
def _(spark: SparkSession, d: str) -> DataFrame:
    s, _, _ = standard(spark, d)
    return s.agg((F.round(F.avg("l_quantity"), 6) + 0.0).alias("mean"), F.round(F.stddev_samp("l_quantity"), 6).alias("sd"), F.count("*").alias("n"))


@query("kde_scott_bandwidth", f"with {SQL_STD} select n, round(pow(4.0 / (5 * n), 1.0 / 7), 8) as h from m")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = sample(spark, d)
    return s.agg(F.count("*").alias("n")).select("n", F.round(F.pow(4.0 / (5 * F.col("n")), F.lit(1.0 / 7)), 8).alias("h"))


for _kernel in ("epanechnikov", "gauss"):

    def _run(spark: SparkSession, d: str, kernel: str = _kernel) -> DataFrame:
        s, q, n = standard(spark, d)
        return M.estimate_batch(q, s, COLS, [M.scott(3, n)] * 3, kernel).select("query_id", F.round("estimate", 6).alias("estimate"))

    query(f"kde_{_kernel}_batch", _sql_estimate(_kernel))(_run)


_G = "((a_{c} - m_{c}) / d_{c} - (s.{c} - m_{c}) / d_{c})", "((b_{c} - m_{c}) / d_{c} - (s.{c} - m_{c}) / d_{c})"


def _sql_gradient() -> str:
    cols = []
    for c in COLS:
        lo, hi = (g.format(c=c) for g in _G)
        rest = " * ".join(_sql_factor(o, "gauss") for o in COLS if o != c)
        cols.append(f"round(sum(({lo} * exp(-{lo} * {lo} / (2.0 * h * h)) - {hi} * exp(-{hi} * {hi} / (2.0 * h * h))) * {rest}) / count(*) / (any_value(h) * any_value(h) * sqrt(2 * pi())), 5) + 0.0 as g_{c}")
    return _erf_sql(f"with {SQL_STD}, {SQL_BOXES}, hh as (select pow(4.0 / (5 * n), 1.0 / 7) as h from m) select query_id, {', '.join(cols)} from q, s, m, hh group by query_id")


@query("kde_batch_gradient", _sql_gradient())
def _(spark: SparkSession, d: str) -> DataFrame:
    s, q, n = standard(spark, d)
    return M.gradient_batch(q, s, COLS, [M.scott(3, n)] * 3).select("query_id", *((F.round(f"g_{c}", 5) + 0.0).alias(f"g_{c}") for c in COLS))


@query("kde_losses", f"with {SQL_BOXES}, t as ({SQL_TRUTH}), p as (select query_id, qualified::double / alltuples as t, query_id * 0.01::double as e from t) select query_id, round(abs(e - t), 8) as absolute, round(abs(e - t) / (1e-10 + t), 4) as relative, round((e - t) * (e - t), 8) as quadratic, round(pow(ln(1e-10 + t) - ln(1e-10 + e), 2), 4) as squared_q, round(pow((t - e) / (1e-10 + t), 2), 3) as squared_relative from p where t > 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = _truth(table(spark, d, "lineitem")).select("query_id", (F.col("qualified") / F.col("alltuples")).alias("t"), (F.col("query_id") * 0.01).alias("e")).where("t > 0")
    digits = {Metric.ABSOLUTE: 8, Metric.RELATIVE: 4, Metric.QUADRATIC: 8, Metric.SQUARED_Q: 4, Metric.SQUARED_RELATIVE: 3}
    return t.select("query_id", *(F.round(losses.loss(m, "e", "t"), n).alias(m.name.lower()) for m, n in digits.items()))


@query("kde_workload_truth", f"with {SQL_BOXES} {SQL_TRUTH}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _truth(table(spark, d, "lineitem"))


@query("kde_karma", _erf_sql(f"with {SQL_STD}, {SQL_BOXES}, hh as (select pow(4.0 / (5 * n), 1.0 / 7) as h from m), c as (select s.*, {' * '.join(_sql_factor(c, 'gauss') for c in COLS)} as c, n from q, s, m, hh where query_id = 2), e as (select avg(c) as e from c), t as (select qualified::double / alltuples as t from ({SQL_TRUTH}) where query_id = 2) select least(4.0, round(n * (abs((e * n - c) / (n - 1) - t) - abs(e - t)), 4)) + 0.0 as karma, count(*) as points from c, e, t group by 1"))
def _(spark: SparkSession, d: str) -> DataFrame:
    from quern.kde.maintenance import karma_column

    s, q, n = standard(spark, d)
    h = M.scott(3, n)
    mass = F.lit(1.0)
    for c in COLS:
        mass = mass * M.gauss(F.col(c), F.col(f"lo_{c}"), F.col(f"hi_{c}"), h) * F.lit(0.5)
    p = s.crossJoin(F.broadcast(q.where("query_id = 2"))).select(mass.alias("c"))
    e = p.agg(F.avg("c").alias("e"))  # one row
    t = _truth(table(spark, d, "lineitem")).where("query_id = 2").select((F.col("qualified") / F.col("alltuples")).alias("t"))
    k = p.crossJoin(F.broadcast(e)).crossJoin(F.broadcast(t)).select((F.round(karma_column("c", "e", "t", n, F.lit(0.0)), 4) + 0.0).alias("karma"))
    return k.groupBy("karma").agg(F.count("*").alias("points"))


def _model(spark: SparkSession, d: str) -> M.Model:
    return M.Model.analyze(table(spark, d, "lineitem"), "lineitem", COLS, Config().kde_samplesize)


def _observed(spark: SparkSession, d: str):
    from quern.kde.ranges import Range

    return [([Range(c, float(b[1 + 2 * i]), False, float(b[2 + 2 * i]), False) for i, c in enumerate(COLS)], r["qualified"] / r["alltuples"]) for b, r in zip(BOXES, sorted(_truth(table(spark, d, "lineitem")).collect(), key=lambda r: r["query_id"]), strict=True)]


def _report(spark: SparkSession, name: str, before: float, after: float, h) -> DataFrame:
    return spark.createDataFrame([(name, float(before), float(after), [float(x) for x in h])], "step string, loss_before double, loss_after double, bandwidth array<double>")


def batch_optimised(spark: SparkSession, d: str) -> DataFrame:
    from quern.kde import optimise

    m = _model(spark, d)
    path = optimise.batch(m, _observed(spark, d))
    return _report(spark, "batch", path[0], path[-1], m.bandwidth)


def online(spark: SparkSession, d: str, kind: str) -> DataFrame:
    from quern.kde import optimise

    m, f = _model(spark, d), _observed(spark, d) * 4
    before = optimise.mean_loss(m, f, Metric.QUADRATIC)[0]
    optimise.learn_online(m, f, optimise.RmsProp(3) if kind == "rmsprop" else optimise.VSgd(3))
    return _report(spark, kind, before, optimise.mean_loss(m, f, Metric.QUADRATIC)[0], m.bandwidth)


_LEARNED = ["step", "not isnan(loss_after) and loss_after < 1 as finite", "array_min(bandwidth) > 0 as positive"]


@query("kde_batch_optimised", "select 'batch' as step, true as lower, true as positive")
def _(spark: SparkSession, d: str) -> DataFrame:
    return batch_optimised(spark, d).selectExpr("step", "loss_after <= loss_before as lower", "array_min(bandwidth) > 0 as positive")


@query("kde_rmsprop", "select 'rmsprop' as step, true as finite, true as positive")
def _(spark: SparkSession, d: str) -> DataFrame:
    return online(spark, d, "rmsprop").selectExpr(*_LEARNED)


@query("kde_vsgd", "select 'vsgd' as step, true as finite, true as positive")
def _(spark: SparkSession, d: str) -> DataFrame:
    return online(spark, d, "vsgd").selectExpr(*_LEARNED)


def _sql_evaluated(h: dict[str, str], tables: str) -> str:
    """query_id, e and g_<c> at the bandwidths h, as SQL over s, m, q and those tables."""
    factor = lambda c: _sql_factor(c, "gauss", h[c])
    cols = [f"sum({' * '.join(factor(c) for c in COLS)}) / count(*) as e"]
    for c in COLS:
        lo, hi = (g.format(c=c) for g in _G)
        rest = " * ".join(factor(o) for o in COLS if o != c)
        cols.append(f"sum(({lo} * exp(-{lo} * {lo} / (2.0 * {h[c]} * {h[c]})) - {hi} * exp(-{hi} * {hi} / (2.0 * {h[c]} * {h[c]}))) * {rest}) / count(*) / (any_value({h[c]}) * any_value({h[c]}) * sqrt(2 * pi())) as g_{c}")
    return f"select query_id, {', '.join(cols)} from q, s, m, {tables} group by query_id"


def _sql_loss_gradient(evaluated: str) -> str:
    return f"select {', '.join(f'avg(2 * (e - t) * g_{c}) as d_loss_{c}' for c in COLS)} from {evaluated} join (select query_id, qualified::double / alltuples as t from tr) using (query_id)"


def _sql_steps() -> str:
    first = _sql_evaluated(dict.fromkeys(COLS, "h"), "hh")
    second = _sql_evaluated({c: f"h_{c}" for c in COLS}, "h2")
    rows = []
    for c in COLS:
        g, gs, h = f"a.d_loss_{c}", f"b.d_loss_{c}", "h"
        shift = f"(case when abs({g}) > 1e-12 then {g} else 1e-12 end)"
        curve = f"abs(({gs} - {g}) / {shift})"
        w = f"(case when {curve} <> 1 then 1.0 / 3 else 0.5 end)"
        h1, h2 = f"((1 - {w}) + {w} * {curve})", f"((1 - {w}) + {w} * {curve} * {curve})"
        g2 = f"((1 - {w}) * ({g} * {g} + 1e-12) + {w} * {g} * {g})"
        rate = f"({h1} / greatest({h2}, 1e-12) * 5 * {g} * {g} / greatest({g2} + 4 * {g} * {g}, 1e-300))"
        rows += [
            f"select 'plain' as step, '{c}' as col, round(greatest({h} - {g}, 1e-4), 5) as bandwidth from a, hh", f"select 'rmsprop', '{c}', round(case when {g} > 0 then greatest({h} - 1, 0.5 * {h}) when {g} < 0 then {h} + 1 else {h} end, 5) from a, hh",
            f"select 'vsgd', '{c}', round(greatest({h} - {rate} * {g}, 0.5 * {h}), 5) from a, b, hh",
        ]
    moved = ", ".join(f"greatest(h + d_loss_{c}, 1e-10) as h_{c}" for c in COLS)
    return _erf_sql(f"with {SQL_STD}, {SQL_BOXES}, hh as (select pow(4.0 / (5 * n), 1.0 / 7) as h from m), tr as ({SQL_TRUTH}), e1 as ({first}), a as ({_sql_loss_gradient('e1')}), h2 as (select {moved} from a, hh), e2 as ({second}), b as ({_sql_loss_gradient('e2')}) {' union all '.join(rows)}")


@query("kde_online_steps", _sql_steps())
def _(spark: SparkSession, d: str) -> DataFrame:
    """The first step of each optimiser from Scott's bandwidth, by gradients of the mean quadratic loss over the boxes."""
    import numpy as np

    from quern.kde import optimise

    s, q, n = standard(spark, d)
    truth = {r["query_id"]: r["qualified"] / r["alltuples"] for r in _truth(table(spark, d, "lineitem")).collect()}  # a row for each box

    def gradient(h: list[float]) -> np.ndarray:
        rows = M.gradient_batch(q, s, COLS, h).collect()
        return np.mean([[2 * (r["estimate"] - truth[r["query_id"]]) * r[f"g_{c}"] for c in COLS] for r in rows], 0)

    h = np.full(3, M.scott(3, n))
    g = gradient(h.tolist())
    moved = gradient(np.maximum(h + g, 1e-10).tolist())
    steps = {"plain": optimise.plain_step(h, g, 1.0), "rmsprop": optimise.RmsProp(3).step(h, g), "vsgd": optimise.VSgd(3).step(h, g, moved)}
    return spark.createDataFrame([(k, c, round(float(x), 5)) for k, v in steps.items() for c, x in zip(COLS, v, strict=True)], "step string, col string, bandwidth double")


def _sql_masses() -> str:
    out = []
    for b in BOXES:
        mass = " * ".join(_sql_factor(c, "gauss") for c in COLS)
        for i, c in enumerate(COLS):
            mass = mass.replace(f"a_{c}", f"({float(b[1 + 2 * i])}::double)").replace(f"b_{c}", f"({float(b[2 + 2 * i])}::double)")
        out.append(f"{mass} as c{b[0]}")
    return ", ".join(out)


def _sql_karma() -> str:
    k = "0.0::double"
    for b in BOXES:
        i = b[0]
        k = f"least({k} + n * (abs((e{i} * n - c{i}) / (n - 1) - t{i}) - abs(e{i} - t{i})), 4.0)"
    es = ", ".join(f"avg(c{b[0]}) as e{b[0]}" for b in BOXES)
    ts = ", ".join(f"(select qualified::double / alltuples from tr where query_id = {b[0]}) as t{b[0]}" for b in BOXES)
    return _erf_sql(f"with {SQL_STD}, {SQL_BOXES}, hh as (select pow(4.0 / (5 * n), 1.0 / 7) as h from m), tr as ({SQL_TRUTH}), p as (select n, {_sql_masses()} from s, m, hh), es as (select {es} from p), ts as (select {ts}), k as (select {k} as karma from p, es, ts) select count(*) filter (where karma < -0.5) as under, count(*) filter (where karma >= 3.999999) as capped, round(min(karma), 4) as least, count(*) as points from k")


@query("kde_karma_threshold", _sql_karma())
def _(spark: SparkSession, d: str) -> DataFrame:
    """Karma of all sample points after the five boxes, one after another; how many a threshold would replace."""
    from quern.kde.maintenance import karma_column

    s, q, n = standard(spark, d)
    h = M.scott(3, n)
    boxes = {r["query_id"]: r for r in q.collect()}
    cols = []
    for i, r in boxes.items():
        mass = F.lit(1.0)
        for c in COLS:
            mass = mass * M.gauss(F.col(c), F.lit(r[f"lo_{c}"]), F.lit(r[f"hi_{c}"]), h) * F.lit(0.5)
        cols.append(mass.alias(f"c{i}"))
    p = s.select(*cols)
    e = p.agg(*(F.avg(f"c{i}").alias(f"e{i}") for i in boxes)).first()
    truth = {r["query_id"]: r["qualified"] / r["alltuples"] for r in _truth(table(spark, d, "lineitem")).collect()}
    k = F.lit(0.0)
    for i in boxes:
        k = karma_column(F.col(f"c{i}"), F.lit(e[f"e{i}"]), F.lit(truth[i]), n, k)
    return p.select(k.alias("k")).agg(F.count_if(F.col("k") < -0.5).alias("under"), F.count_if(F.col("k") >= 3.999999).alias("capped"), F.round(F.min("k"), 4).alias("least"), F.count("*").alias("points"))


def sample_maintenance(spark: SparkSession, d: str) -> DataFrame:
    import numpy as np

    from quern.kde import maintenance as K

    m, rng, out = _model(spark, d), np.random.default_rng(1), []
    for ranges, truth in _observed(spark, d) * 3:
        K.update_karma(m, ranges, truth)
    out.append(("tkr", len(K.tkr_slots(m, -0.5)), m.rows))
    out.append(("pkr", int(K.pkr_slot(m)[0]), m.rows))
    out.append(("prr", int(K.prr_slot(m, rng)[0]), m.rows))
    for _ in range(100):
        K.car_insert(m, m.mean, rng)
    out.append(("car_insert", int((np.abs(m.points).max(1) < 1e-9).sum()), m.rows))
    out.append(("car_delete", K.car_delete(m, m.points[0] * m.sd + m.mean, lambda n: np.repeat(m.mean[None], n, 0)), m.rows))
    return spark.createDataFrame(out, "strategy string, value long, table_rows long")


_SQL_ROWS = "select count(*) from lineitem"


@query("kde_sample_maintenance", f"select strategy, true as possible, ({_SQL_ROWS}) + change as table_rows from (values ('tkr', 0), ('pkr', 0), ('prr', 0), ('car_insert', 100), ('car_delete', 99)) as t(strategy, change)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return sample_maintenance(spark, d).select("strategy", F.col("value").between(0, SIZE).alias("possible"), "table_rows")


@query("kde_baseline_independence", "select query_id, true as near, 1.25e-7::double as constant from (values (1), (2), (3), (4), (5)) as t(query_id)")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Equi-depth histograms under independence, against the product of the true shares of the columns."""
    from quern.kde import baselines

    df = table(spark, d, "lineitem")
    hist = baselines.histograms(df, COLS)
    row = df.agg(F.count("*").alias("n"), *(F.count_if(F.col(c).between(b[1 + 2 * i], b[2 + 2 * i])).alias(f"{c}_{b[0]}") for b in BOXES for i, c in enumerate(COLS))).first()
    out = []
    for b, (r, _) in zip(BOXES, _observed(spark, d), strict=True):
        true = 1.0
        for c in COLS:
            true *= row[f"{c}_{b[0]}"] / row["n"]
        out.append((b[0], abs(baselines.independent(hist, r) - true) < 0.03, float(f"{baselines.constant(r):.6g}")))
    return spark.createDataFrame(out, "query_id int, near boolean, constant double")


_DRILLED = [b for b in BOXES if b[0] in (1, 2, 4)]  # apart from one another


def _sql_stholes() -> str:
    low = lambda c, v: f"greatest({float(v)}, lo_{c})"
    high = lambda c, v: f"least({float(v)}, hi_{c})"
    vol = lambda b: " * ".join(f"greatest({high(c, b[2 + 2 * i])} - {low(c, b[1 + 2 * i])}, 0)" for i, c in enumerate(COLS))
    inside = lambda b: " and ".join(f"{c} >= {float(b[1 + 2 * i])} and {c} <= {float(b[2 + 2 * i])}" for i, c in enumerate(COLS))
    facts = "select count(*) as n, " + ", ".join(f"min({c}) as lo_{c}, max({c}) + 1e-9 as hi_{c}" for c in COLS) + ", " + ", ".join(f"count(*) filter (where {inside(b)}) as c{b[0]}" for b in _DRILLED) + " from lineitem"
    rows, taken, gone = [], "0", "0"
    whole = " * ".join(f"(hi_{c} - lo_{c})" for c in COLS)
    for b in _DRILLED:
        rows.append(f"select {b[0]} as query_id, round((n - ({taken})) * ({vol(b)}) / ({whole} - ({gone})), 3) as before, c{b[0]}::double as after from f")
        taken, gone = f"{taken} + c{b[0]}", f"{gone} + {vol(b)}"
    return f"with f as ({facts}) {' union all '.join(rows)}"


@query("kde_stholes", _sql_stholes())
def _(spark: SparkSession, d: str) -> DataFrame:
    from quern.kde.stholes import STHoles

    df = table(spark, d, "lineitem")
    b = df.agg(*(F.min(c) for c in COLS), *(F.max(c) for c in COLS), F.count("*")).first()
    hist = STHoles(b[:3], [x + 1e-9 for x in b[3:6]], b[6], limit=50)
    count = lambda lo, hi: df.where(" and ".join(f"{c} >= {x} and {c} <= {y}" for c, x, y in zip(COLS, lo, hi, strict=True))).count()
    out = []
    for box in _DRILLED:
        lo, hi = box[1::2], box[2::2]
        before = hist.estimate(lo, hi)
        hist.learn(lo, hi, count)
        out.append((box[0], round(before, 3), round(hist.estimate(lo, hi), 3)))
    return spark.createDataFrame(out, "query_id int, before double, after double")


@query("kde_workload_generate", "select kind, query, true as sized, true as counted from (values ('dv'), ('uv'), ('dt'), ('ut'), ('rnd')) as k(kind), (values (0), (1), (2), (3)) as q(query)")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Four queries of each kind; those by volume cover just their share of the domain, and all counts lie within the table."""
    from quern.kde.workload import generate, truth

    df, out = table(spark, d, "lineitem"), []
    b = df.agg(*(F.min(c) for c in COLS), *(F.max(c) for c in COLS), F.count("*")).first()
    for kind in ("dv", "uv", "dt", "ut", "rnd"):
        qs = generate(df, COLS, kind, 4, 0.05)
        for i, (q, n) in enumerate(zip(qs, truth(df, qs), strict=True)):
            part = 1.0
            for r, lo, hi in zip(q, b[:3], b[3:6], strict=True):
                part *= (r.hi - r.lo) / (hi - lo)
            out.append((kind, i, abs(part - 0.05) < 1e-6 if kind in ("dv", "uv") else part > 0, 0 <= n <= b[6]))
    return spark.createDataFrame(out, "kind string, query int, sized boolean, counted boolean")


@query("kde_scv_bandwidth", "select true as positive, true as near_scott")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Smoothed cross-validation over the sample gives bandwidths of the order of Scott's."""
    m = _model(spark, d)
    ratio = M.scv_bandwidth(m.points) / M.scott(3, len(m.points))
    return spark.createDataFrame([(bool((ratio > 0).all()), bool(((ratio > 0.02) & (ratio < 5)).all()))], "positive boolean, near_scott boolean")


@query("kde_estimator_loop", "select * from (values ('adapt', 2), ('analyze', 1), ('estimate', 10), ('karma', 10), ('optimise', 1), ('refresh', 2)) as t(step, calls)")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Ten queries through the estimator: steps of the bandwidth after five, a sample row replaced after five, one batch optimisation."""
    from quern.kde.estimator import Estimator

    config = Config(kde_enable=True, kde_collect_feedback=True, kde_enable_bandwidth_optimization=True, kde_enable_adaptive_bandwidth=True, kde_sample_maintenance="pkr", kde_sample_maintenance_period=5, kde_error_metric=Metric.QUADRATIC)
    e = Estimator(table(spark, d, "lineitem"), "lineitem", COLS, config)
    for ranges, truth in _observed(spark, d) * 2:
        e.estimate(ranges)
        e.observe(ranges, truth)
    e.optimise()
    return e.counters.table(spark).select("step", F.col("calls").cast("int").alias("calls"))


@query("kde_feedback_collect", "select 'lineitem' as \"table\", 4 as n_ranges, count(*) as alltuples, count(*) filter (where l_quantity > 5 and l_quantity <= 20 and l_discount >= 0.02 and l_tax < 0.05 and l_extendedprice = l_extendedprice and l_extendedprice > 1000) as qualifiedtuples from lineitem")
def _(spark: SparkSession, d: str) -> DataFrame:
    from quern.kde.feedback import observe

    row = observe(table(spark, d, "lineitem"), "lineitem", [("l_quantity", ">", 5), (20, ">=", "l_quantity"), ("l_discount", ">=", 0.02), ("l_tax", "<", 0.05), ("l_extendedprice", ">", 1000)])
    return row.select("table", F.size("ranges").alias("n_ranges"), "alltuples", "qualifiedtuples")


def explain_rows(spark: SparkSession, d: str) -> DataFrame:
    from quern.plans.explain import estimate_rows

    m = _model(spark, d)
    return spark.createDataFrame([(estimate_rows(m, [("l_quantity", ">", 10), ("l_quantity", "<", 30), ("l_discount", "<=", 0.05), ("l_returnflag", "=", "R")]),)], "rows double")


@query("kde_explain_estimate", "select count(*) as actual, true as near from lineitem where l_quantity > 10 and l_quantity < 30 and l_discount <= 0.05 and l_returnflag = 'R'")
def _(spark: SparkSession, d: str) -> DataFrame:
    """EXPLAIN's rows for three ranges and a clause that the model doesn't know, beside the true number."""
    actual = table(spark, d, "lineitem").where("l_quantity > 10 and l_quantity < 30 and l_discount <= 0.05 and l_returnflag = 'R'").agg(F.count("*").alias("actual"))
    return actual.crossJoin(explain_rows(spark, d)).select("actual", (F.abs(F.col("rows") - F.col("actual")) < 0.25 * F.col("actual") + 20).alias("near"))


@query("stream_feedback_loop", f"select 'lineitem' as \"table\", least(({_SQL_ROWS}), {SIZE})::int as sample, 1 as version")
def _(spark: SparkSession, d: str) -> DataFrame:
    from quern.kde import feedback as FB, ranges as R, store
    from quern.streaming.feedback import learn_from

    base = shared_path(spark, "loop")
    m = _model(spark, d)
    rows = [(None, "lineitem", 1, R.encode(r), 1_000_000, int(t * 1_000_000)) for r, t in _observed(spark, d)]
    FB.append(spark.createDataFrame(rows, FB.FEEDBACK), f"{base}/feedback")
    learn_from(spark.readStream.schema(FB.FEEDBACK).parquet(f"{base}/feedback"), m, f"{base}/model", f"{base}/checkpoint").awaitTermination()
    s = store.stats(store.load(spark, f"{base}/model"))
    return spark.createDataFrame([(s["table"], s["sample"], s["version"])], "table string, sample int, version int")


@query("stream_sample_maintenance", f"select least(count(*) filter (where l_orderkey % 2 = 0), {SIZE})::int as sample, count(*) filter (where l_orderkey % 2 = 1) - count(*) filter (where l_orderkey % 6 = 0) as net_change from lineitem")
def _(spark: SparkSession, d: str) -> DataFrame:
    from quern.streaming.feedback import maintain

    base = shared_path(spark, "changes")
    # lineitem's even orders are the table at first; odd ones come in and every third of the even ones goes
    df = table(spark, d, "lineitem").where(" and ".join(f"{c} is not null" for c in COLS))
    even, third = F.col("l_orderkey") % 2 == 0, F.col("l_orderkey") % 6 == 0
    m = M.Model.analyze(df.where(even), "lineitem", COLS, Config().kde_samplesize)
    before = m.rows
    ch = df.where(~even | third).select(F.monotonically_increasing_id().alias("seq"), F.when(third, "delete").otherwise("insert").alias("op"), *COLS)
    ch.write.parquet(f"{base}/changes")
    maintain(spark.readStream.schema(ch.schema).parquet(f"{base}/changes"), m, df.where(~third), f"{base}/checkpoint").awaitTermination()
    return spark.createDataFrame([(len(m.points), m.rows - before)], "sample int, net_change long")


# the protocol of estimation time: eight dimensions, one hundred queries
WIDE = [f"e{i}" for i in range(1, 9)]
_WIDE_PICK = "vec_id * 7919 % 1000003"
_WIDE_COLS = ", ".join(f"embedding[{i}]::double as e{i}" for i in range(1, 9))
_WIDE_SQL = (
    f"with v as (select vec_id, {_WIDE_COLS} from embeddings), s as (select {', '.join(WIDE)} from v order by {_WIDE_PICK}, vec_id limit {SIZE}), "
    f"m as (select count(*) as n, {', '.join(f'avg({c}) as m_{c}, stddev_samp({c}) as d_{c}' for c in WIDE)} from s), "
    f"q as (select vec_id as query_id, {', '.join(f'{c} - 0.25 as a_{c}, {c} + 0.25 as b_{c}' for c in WIDE)} from v where vec_id < 100), hh as (select pow(4.0 / (10 * n), 1.0 / 12) as h from m) "
)


@query("kde_estimate_8d", _erf_sql(_WIDE_SQL + f"select query_id, round(sum({' * '.join(_sql_factor(c, 'gauss') for c in WIDE)}) / count(*), 6) as estimate from q, s, m, hh group by query_id"))
def _(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", *(F.col("embedding")[i - 1].cast("double").alias(f"e{i}") for i in range(1, 9)))
    s = v.orderBy(F.expr(_WIDE_PICK), "vec_id").limit(SIZE).select(*WIDE)
    n, mean, sd = M.moments(s, WIDE)
    st = s.select(*(((F.col(c) - float(m)) / float(x)).alias(c) for c, m, x in zip(WIDE, mean, sd, strict=True)))
    edge = lambda c, i, by: ((F.col(c) + by - float(mean[i])) / float(sd[i]))
    q = v.where("vec_id < 100").select(F.col("vec_id").alias("query_id"), *(edge(c, i, by).alias(f"{side}_{c}") for i, c in enumerate(WIDE) for side, by in (("lo", -0.25), ("hi", 0.25))))
    return M.estimate_batch(q, st, WIDE, [M.scott(8, n)] * 8, "gauss").select("query_id", F.round("estimate", 6).alias("estimate"))
