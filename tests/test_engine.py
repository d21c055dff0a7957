"""Results against DuckDB for every query with an oracle, and unit tests of what SQL can't check."""

import os
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern import registry, semantics as S
from quern.functions import arrays as A, bits as B, datetimes as T, documents as J, extensions as X, geometry as G, maths as M, network as N, ranges as R, strings as ST, textsearch as TS
from quern.queries.base import TABLES

DIR = "/root/testdata/sf0.001"


def cell(x):
    if x is None or x != x:
        return None
    if hasattr(x, "item"):
        x = x.item()
    return round(float(x), 5) if isinstance(x, float) else x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([cell(r[i]) for i in order]) for r in data)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    if not os.path.isdir(DIR):
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DIR)
    got = [tuple(r) for r in df.collect()]
    text = registry.oracle_sql().get(name)
    if text is None:
        assert got
        return
    want = duck.sql(text)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, got) == rows(want.columns, want.fetchall())


def one(spark, *cols):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first()


L = F.lit


def test_semantics(spark):
    r = one(spark, S.int_div(L(-7), L(2)), S.concat(L("a"), L(None), L(1)), S.round_double(L(2.5)), S.dow(L("2024-01-07").cast("date")), S.subscript(F.array(L(1), L(2)), 0), S.subscript(F.array(L(1), L(2)), 3), S.not_in(L(3), [1, None]))
    assert list(r) == [-3, "a1", 2.0, 0, None, None, None]


def test_strings(spark):
    r = one(spark, ST.initcap(L("hi THOMAS-o'neil")), ST.substr(L("string"), -2, 5), ST.left(L("abcde"), -2), ST.right(L("abcde"), -2), ST.chr_(L(0x4E2D)), ST.ascii_(L("é")), ST.regexp_replace(L("foobarbaz"), "b(..)", "X\\1Y"), ST.regexp_replace(L("foobarbaz"), "b(..)", "X\\1Y", "g"))
    assert list(r) == ["Hi Thomas-O'Neil", "st", "abc", "cde", "中", 233, "fooXarYbaz", "fooXarYXazY"]
    r = one(spark, ST.similar_to(L("abcdefg"), "%#_x%", "#"), ST.similar_to(L("abc"), "(a|b)bc"), ST.sql_substring(L("abcdefg"), 'a#"(b_d)#"%'), ST.quote_literal(L("O'R\\")), ST.quote_nullable(L(None).cast("string")), ST.quote_ident(L('A"b')), ST.format_("%s|%2$-4s|%1$3s|%%", L("a"), L("b")), ST.get_byte(L("AB"), 1), ST.bpchar_length(L("ab  ")))
    assert list(r) == [False, True, "bcd", "E'O''R\\\\'", "NULL", '"A""b"', "a|b   |  a|%", 66, 2]
    assert one(spark, ST.regexp_matches(L("ab12cd34"), "([a-z]+)([0-9]+)", "g"))[0] == [["ab", "12"], ["cd", "34"]]
    with pytest.raises(ValueError):
        ST.split_part(L("a"), ",", 0)


def test_maths(spark):
    r = one(spark, M.trunc(L(-1.57), 1), M.round_numeric(L("2.5"), 0).cast("int"), M.factorial(L(25)).cast("string"), M.width_bucket(L(5.0), 10.0, 0.0, 5), M.roman(L(1994)), M.ordinal(L(112)), M.log(L(1000.0)))
    assert list(r)[1:] == [3, "15511210043330985984000000", 3, "MCMXCIV", "112th", 3.0] and abs(r[0] + 1.5) < 1e-9
    with pytest.raises(Exception, match="square root"):
        one(spark, M.sqrt(L(-1.0)))


def test_datetimes(spark):
    t = lambda s: L(s).cast("timestamp_ntz")
    a = T.age(t("2024-03-01 01:00:00"), t("2024-01-31 02:00:00"))
    r = one(spark, a["months"], a["days"], T.date_trunc("century", t("2000-06-01 00:00:00")), T.extract("century", t("2001-01-01 00:00:00")), T.overlaps(L(1), L(3), L(3), L(5)), T.overlaps(L(3), L(1), L(2), L(2)), T.to_char(t("2024-02-03 14:05:06"), 'YYYY-MM-DD "at" HH24:MI'))
    assert (r[0], r[1]) == (1, 0) and r[2] == datetime(1901, 1, 1) and list(r)[3:] == [21, False, True, "2024-02-03 at 14:05"]
    j = T.justify_interval(T.interval(1, 35, -3_600_000_000))
    assert list(one(spark, j["months"], j["days"], j["micros"])) == [2, 4, 23 * 3_600_000_000]


def test_arrays(spark):
    a = F.array(L(1), L(None), L(2), L(1))
    r = one(spark, A.array_remove(a, None), A.array_replace(a, 1, 9), A.array_to_string(a, ",", "*"), A.array_to_string(a, ","), A.string_to_array(L("a,,b"), ",", ""), A.string_to_array(L("abc"), None), A.contains(a, F.array(L(None).cast("int"))), A.array_length(F.array().cast("array<int>")), A.subscripts(a, True), A.array_fill(7, 2, 2), S.array_agg(L(None).cast("int")))
    assert list(r) == [[1, 2, 1], [9, None, 2, 9], "1,*,2,1", "1,2,1", ["a", None, "b"], ["a", "b", "c"], False, None, [4, 3, 2, 1], [[7, 7], [7, 7]], [None]]


def test_documents(spark):
    r = one(spark, J.extract_path_text(L('{"a":[1,{"b c":"x"}]}'), "a", 1, "b c"), J.array_elements(L('[1,"x",{"y":2}]')), J.each_text(L('{"k":"v","n":null}')), J.xmlelement("a", {"x": L(None), "y": L('<"')}, J.xml_escape(L("1<2"))), J.xmlelement("e"), J.xmlpi("p", L(" t")), J.xpath_exists(L("<a><b/></a>"), "/a/b"), J.is_document(L("<a/>")), J.is_document(L("<a>")))
    assert list(r) == ["x", ["1", '"x"', '{"y":2}'], {"k": "v", "n": None}, '<a y="&lt;&quot;">1&lt;2</a>', "<e/>", "<?p t?>", True, True, False]


def test_ranges(spark):
    a, b, c = R.make(L(1), L(5)), R.make(L(5), L(8)), R.make(L(3), L(6), "[]")
    e = R.make(L(3), L(3))
    inf = R.make(L(None).cast("int"), L(4))
    r = one(spark, R.is_empty(e), R.overlaps(a, b), R.adjacent(a, b), R.overlaps(a, c), R.to_text(R.intersect(a, c)), R.to_text(R.union(a, b)), R.to_text(R.difference(a, c)), R.contains(inf, R.make(L(-9), L(4))), R.contains_elem(inf, 4), R.left_of(a, b), R.to_text(R.make(L(1), L(3), "(]", True)), R.lower_inf(inf), R.to_text(e))
    assert list(r) == [True, False, True, True, "[3,5)", "[1,8)", "[1,3)", True, False, True, "[2,4)", True, "empty"]
    with pytest.raises(Exception, match="contiguous"):
        one(spark, R.union(R.make(L(1), L(2)), R.make(L(5), L(6)))["lo"])


def test_bits_network_geometry(spark):
    r = one(spark, B.bit_xor(L("1100"), L("1010")), B.shift_left(L("1101"), 1), B.bit_not(L("10")), B.to_int(L("101")), N.network(L("192.168.5.9/22")), N.broadcast(L("192.168.5.9/22")), N.contained(L("10.1.2.3"), L("10.0.0.0/8")), N.mac_trunc(L("08:00:2b:01:02:03")), N.add(L("10.0.0.255"), 1))
    assert list(r) == ["0110", "1010", "01", 5, "192.168.4.0/22", "192.168.7.255/22", True, "08:00:2b:00:00:00", "10.0.1.0"]
    p = lambda x, y: G.point(L(x), L(y))
    square = F.array(p(0, 0), p(4, 0), p(4, 4), p(0, 4))
    m = G.point_div(G.point_mul(p(1, 2), p(3, 4)), p(3, 4))
    r = one(spark, G.distance(p(0, 0), p(3, 4)), G.polygon_area(square), G.polygon_contains(square, p(1, 1)), G.polygon_contains(square, p(5, 1)), G.path_length(square, True), G.segments_cross(p(0, 0), p(2, 2), p(0, 2), p(2, 0)), G.point_segment_distance(p(0, 3), p(-1, 0), p(1, 0)), G.box_area(G.box(p(1, 1), p(3, 4))), G.circle_contains(G.circle(p(0, 0), L(5)), G.circle(p(1, 0), L(2))), m["x"], m["y"])
    assert list(r) == [5.0, 16.0, True, False, 16.0, True, 3.0, 6.0, True, 1.0, 2.0]


def test_text_search(spark):
    v = TS.to_tsvector(L("The quick brown fox, the lazy fox"))
    q = TS.to_tsquery("fox & (quick | slow) & !cat")
    r = one(spark, v, q.match(v), TS.to_tsquery("qui:*").match(v), TS.headline(L("A fox ran"), q), TS.ts_rank(v, TS.to_tsquery("fox")))
    assert r[0] == {"quick": [2], "brown": [3], "fox": [4, 7], "lazy": [6]} and list(r)[1:4] == [True, True, "A <b>fox</b> ran"]
    assert r[4] == pytest.approx((0.1 + 0.1 / 4) / 1.64493406685)
    assert q.numnode() == 8 and q.rewrite(TS.Query("word", ("cat",)), TS.Query("word", ("dog",))).words()[-1] == "dog"


def test_extensions(spark):
    import hashlib
    import hmac

    cube = lambda a, b: X.cube(F.array(*map(L, a)), F.array(*map(L, b)))
    r = one(spark, X.show_trgm(L("cat")), X.similarity(L("word"), L("two words")), X.difference(L("Anne"), L("Ann")), X.uniq(F.array(L(1), L(1), L(2), L(1))), X.subpath(L("a.b.c.d"), -2), X.lca(L("a.b.c"), L("a.b.d")), X.ean13_valid(L("978-0-306-40615-7")), X.isbn10_check(L("0-306-40615")), X.unaccent(L("Hôtel ñ")), X.hmac(L("m"), "key"), X.cube_distance(cube([0.0, 0.0], [1.0, 1.0]), cube([4.0, 5.0], [6.0, 6.0])))
    assert list(r) == [["  c", " ca", "cat", "at "], pytest.approx(4 / 11), 4, [1, 2, 1], "c.d", "a.b", True, "2", "Hotel n", hmac.new(b"key", b"m", hashlib.sha256).hexdigest(), 5.0]


def test_joins_with_nulls(spark):
    from quern.operators.joins import not_in, range_join

    a = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    for other, want in (([(1,)], [2]), ([(None,)], []), ([], [1, 2, None])):
        b = spark.createDataFrame(other, "o int")
        assert [r.k for r in not_in(a, b, "k", "o").collect()] == want or sorted(map(str, (r.k for r in not_in(a, b, "k", "o").collect()))) == sorted(map(str, want))
    pts = spark.createDataFrame([(float(x),) for x in range(-5, 20)], "x double")
    rs = spark.createDataFrame([(-3.5, 2.0), (2.0, 2.0), (7.0, 30.0)], "lo double, hi double")
    got = {(r.x, r.lo) for r in range_join(pts, rs, "x", "lo", "hi", 4.0).collect()}
    assert got == {(float(x), lo) for x in range(-5, 20) for lo, hi in ((-3.5, 2.0), (7.0, 30.0)) if lo <= x < hi}


def test_dml(spark):
    from quern.operators import dml

    t = spark.createDataFrame([(1, 10), (2, None)], "k int, v int")
    new, back = dml.update(t, F.col("v") > 5, v=F.col("v") + 1)
    assert sorted(map(str, new.collect())) == sorted(["Row(k=1, v=11)", "Row(k=2, v=None)"]) and back.count() == 1
    assert [r.k for r in dml.delete(t, F.col("v") > 5)[0].collect()] == [2]
    assert dml.insert(t, spark.createDataFrame([(3,)], "k int"))[0].count() == 3 and dml.truncate(t).count() == 0


def model(n=200, d=2, seed=1):
    from quern.kde.model import Model, scott

    p = np.random.default_rng(seed).normal(size=(n, d))
    return Model("t", [f"c{i}" for i in range(d)], p, np.zeros(d), np.ones(d), np.full(d, scott(d, n)), 10_000, karma=np.zeros(n))


def box(lo, hi):
    from quern.kde.ranges import Range

    return [Range(f"c{i}", a, False, b, False) for i, (a, b) in enumerate(zip(lo, hi, strict=True))]


def test_range_extraction():
    from quern.kde.ranges import extract

    found, rest = extract([("a", ">", 1), (5, ">=", "a"), ("a", "<", 9), ("b", "=", 3)])
    assert [(r.col, r.lo, r.lo_inc, r.hi, r.hi_inc) for r in found] == [("a", 1, False, 5, True), ("b", 3, True, 3, True)] and rest == []
    assert extract([("a", ">", 1), ("a", "<", 1)])[0] is None and extract([("a", "like", "x")])[0] is None
    assert extract([("a", ">", 1), ("a", "like", "x")], strict=False)[1] == [("a", "like", "x")]
    assert extract([("a", ">=", 1), ("a", "<=", 1)])[0][0].lo == 1 and extract([("a", ">", 1), ("a", "<=", 1)])[0] is None


def test_kde_model():
    from quern.kde.ranges import INF

    m = model()
    assert m.estimate(box([-INF] * 2, [INF] * 2)) == pytest.approx(1)
    m.kernel = "epanechnikov"
    assert m.estimate(box([-50] * 2, [50] * 2)) == pytest.approx(1)
    m.kernel = "gauss"
    for representation in ("plain", "log"):
        if representation == "log":
            m.to_log()
        q = box([-0.5, -1], [0.7, INF])
        g = m.gradient(q)
        for k in range(2):
            h = m.bandwidth.copy()
            h[k] += 1e-5
            up = m.estimate(q, np.exp(h) if representation == "log" else h)
            h[k] -= 2e-5
            down = m.estimate(q, np.exp(h) if representation == "log" else h)
            assert g[k] == pytest.approx((up - down) / 2e-5, abs=1e-7)


def test_losses_slopes():
    from quern.kde import losses
    from quern.kde.config import Metric

    for m in Metric:
        for e, t in ((0.2, 0.1), (0.05, 0.3)):
            d = (losses.value(m, e + 1e-7, t) - losses.value(m, e - 1e-7, t)) / 2e-7
            assert losses.slope(m, e, t) == pytest.approx(d, rel=1e-4)


def test_learning_lowers_loss():
    from quern.kde import optimise
    from quern.kde.config import Metric

    rng = np.random.default_rng(3)
    data = rng.normal(size=(20_000, 2))
    f = []
    for _ in range(30):
        c = data[rng.integers(len(data))]
        q = box(c - 0.3, c + 0.3)
        f.append((q, float((np.abs(data - c) < 0.3).all(1).mean())))
    start = optimise.mean_loss(model(100), f, Metric.QUADRATIC)[0]
    for constrained in (True, False):
        m = model(100)
        path = optimise.batch(m, f, constrained=constrained)
        assert path[-1] < start and (m.bandwidth > 0).all()
    for o in (optimise.RmsProp(2), optimise.VSgd(2)):
        m = model(100)
        m.bandwidth = m.bandwidth * 4
        before = optimise.mean_loss(m, f, Metric.QUADRATIC)[0]
        optimise.learn_online(m, f, o)
        assert optimise.mean_loss(m, f, Metric.QUADRATIC)[0] < before


def test_maintenance():
    from quern.kde import maintenance as K

    m, rng = model(50), np.random.default_rng(1)
    m.points[7] = [3, 3]
    for _ in range(5):
        K.update_karma(m, box([2.8, 2.8], [3.2, 3.2]), 0.0)
    assert K.pkr_slot(m)[0] == 7 and 7 in K.tkr_slots(m, -0.1) and m.karma.max() <= 4.0
    assert 7 in K.tkr_slots(m, -99, box([2.8, 2.8], [3.2, 3.2]), 0.0)
    for n, k in ((5, 5), (10, 3), (1, 0)):
        got = K.floyd(n, k, rng)
        assert len(set(got)) == k and all(0 <= x < n for x in got)
    m.rows = 50
    taken = 0
    for _ in range(400):
        K.car_insert(m, np.array([9.0, 9.0]), rng)
    taken = int((m.points == 9.0).all(1).sum())
    assert 35 <= taken <= 50 and m.rows == 450
    assert K.car_delete(m, np.array([9.0, 9.0]), lambda n: np.zeros((n, 2))) == taken


def test_stholes():
    from quern.kde.stholes import STHoles

    data = np.random.default_rng(2).normal(0.5, 0.1, (5000, 2))
    count = lambda lo, hi: int(((data >= lo) & (data <= hi)).all(1).sum())
    h = STHoles([0, 0], [1, 1], 5000, limit=20)
    q = ([0.4, 0.4], [0.6, 0.6])
    before = abs(h.estimate(*q) - count(*map(np.array, q)))
    h.learn(*q, count)
    assert abs(h.estimate(*q) - count(*map(np.array, q))) < 1e-6 < before
    rng = np.random.default_rng(4)
    for _ in range(60):
        c = rng.uniform(0.1, 0.9, 2)
        h.learn(c - 0.08, c + 0.08, count)
    assert sum(1 for _ in h.boxes()) <= 21


def lineitem(spark, path, n, quantity=None):
    rng = np.random.default_rng(6)
    raw = np.stack([rng.integers(1, 51, n) if quantity is None else np.full(n, quantity), rng.uniform(900, 100_000, n), rng.integers(0, 11, n) / 100], 1).astype(float)
    rows = [(i // 4, i % 4, *r, "R") for i, r in enumerate(raw.tolist())]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string").write.parquet(f"{path}/lineitem.parquet")
    return raw


def test_kde_queries_model_the_table(spark, tmp_path):
    from math import erf, sqrt

    from quern.queries import kde

    d, few = str(tmp_path / "few"), 1500  # fewer rows than kde_samplesize, so the sample is the table
    raw = lineitem(spark, d, few)
    mean, sd, h = raw.mean(0), raw.std(0, ddof=1), (4 / (5 * few)) ** (1 / 7)

    def estimate(lo, hi):
        f = lambda b, x, j: erf((b - x) / sd[j] / (sqrt(2) * h))
        return sum(np.prod([(f(hi[j], x[j], j) - f(lo[j], x[j], j)) / 2 for j in range(3)]) for x in raw) / few

    inf = float("inf")
    queries = registry.queries()
    assert np.isclose(kde.explain_rows(spark, d).first()[0], few * estimate([10, -inf, -inf], [30, inf, 0.05]) / 3, rtol=1e-6)
    want = np.mean([(estimate(b[1::2], b[2::2]) - ((raw > b[1::2]) & (raw < b[2::2])).all(1).mean()) ** 2 for b in kde.BOXES])
    for name in ("kde_rmsprop", "kde_vsgd"):
        got = kde.online(spark, d, name.removeprefix("kde_")).first()
        assert np.isclose(got.loss_before, want, rtol=1e-6) and np.isfinite(got.loss_after) and min(got.bandwidth) > 0
    got = kde.batch_optimised(spark, d).first()
    assert got.loss_after <= got.loss_before and min(got.bandwidth) > 0
    got = {r.strategy: r for r in kde.sample_maintenance(spark, d).collect()}
    assert got["car_delete"].table_rows == few + 99 and 0 <= got["pkr"].value < few
    assert queries["stream_feedback_loop"](spark, d).first().sample == few

    d = str(tmp_path / "many")
    raw = lineitem(spark, d, 20_000)
    m = kde._model(spark, d)
    assert len(m.points) == 4300 and m.rows == 20_000
    assert (np.abs(m.mean - raw.mean(0)) < 5 * raw.std(0) / 4300**0.5).all() and (np.abs(m.sd / raw.std(0) - 1) < 0.1).all()
    d = str(tmp_path / "same")
    lineitem(spark, d, 500, quantity=1)
    assert np.isfinite(kde._model(spark, d).points).all()


def test_stream_maintains_the_table(spark, tmp_path, monkeypatch):
    from quern.kde import model as M
    from quern.streaming import feedback

    d, n, samples, models = str(tmp_path), 6000, [], []
    raw = lineitem(spark, d, n)
    real, maintain = M.random_sample, feedback.maintain
    for place in (M, feedback):
        monkeypatch.setattr(place, "random_sample", lambda *a: samples.append(a[2]) or real(*a))
    monkeypatch.setattr(feedback, "maintain", lambda *a: models.append(a[1]) or maintain(*a))
    got = registry.queries()["stream_sample_maintenance"](spark, d).first()
    key = np.arange(n) // 4
    left = raw[key % 6 != 0]
    assert got.net_change == (key % 2 == 1).sum() - (key % 6 == 0).sum() and got.sample == (key % 2 == 0).sum()
    assert len(samples) == 3  # ANALYZE, one for the inserted and one for all deleted points of the micro-batch
    m = models[0]
    points = np.round(m.points * m.sd + m.mean, 4)
    assert m.rows == len(left) and {tuple(p) for p in points} <= {tuple(p) for p in np.round(left, 4)}
    assert 0.2 < np.isin(points[:, 1], np.round(raw[key % 2 == 1][:, 1], 4)).mean() < 0.9  # inserted rows take their share


def test_store_round_trip(spark, tmp_path):
    from quern.kde import store

    m = model(20)
    store.save(spark, m, str(tmp_path))
    m.bandwidth = m.bandwidth * 2
    store.save(spark, m, str(tmp_path))
    got = store.load(spark, str(tmp_path))
    assert got.version == 2 and np.allclose(got.points, m.points) and np.allclose(got.bandwidth, m.bandwidth)
    store.reset_bandwidth(got)
    assert not np.allclose(got.bandwidth, m.bandwidth)


def test_entry_without_llm(spark, monkeypatch):
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def no_llm(name, *a, **k):
        if name.startswith(("quern.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name, name=name)
        return real(name, *a, **k)

    for n in [n for n in sys.modules if n.startswith(("quern.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, n)
    monkeypatch.setattr(builtins, "__import__", no_llm)
    e = importlib.import_module("__spark_entry__")
    assert set(e.queries()) == set(registry.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
