"""Joins that keep rows, trees, sample upkeep, replayed streams, sources: against brute force on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import datetimes as T, extensions as X
from quern.kde import maintenance as K
from quern.kde.config import Config, Metric
from quern.kde.model import Model, scv_bandwidth
from quern.kde.ranges import Range
from quern.operators import joins, procedures as P, recursion
from quern.sources import copy, largeobjects as LO


def test_salted_join_keeps_rows_once(spark):
    big = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (9, "e")], "k int, v string")
    small = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, w string")
    for how, want in (("inner", 3), ("left", 5), ("left_semi", 3), ("left_anti", 2)):
        assert joins.salted_join(big, small, "k", 4, how).count() == want
    for how in ("right", "full", "outer"):
        with pytest.raises(ValueError):
            joins.salted_join(big, small, "k", 4, how)


def test_range_join(spark):
    rng = np.random.default_rng(1)
    pts = [(i, float(x)) for i, x in enumerate(rng.uniform(0, 1000, 60))] + [(60, 5.0), (61, None), (62, -700.5)]
    rs = [(i, float(a), float(a + w)) for i, (a, w) in enumerate(zip(rng.uniform(0, 1000, 25), rng.choice([0.5, 3, 40, 900, 50_000], 25), strict=True))] + [(25, 3.0, 3.0), (26, 9.0, 2.0), (27, None, 4.0)]
    p, r = spark.createDataFrame(pts, "i int, x double"), spark.createDataFrame(rs, "j int, lo double, hi double")
    hits = {(i, j) for i, x in pts for j, a, b in rs if x is not None and a is not None and a <= x < b}
    assert {(t.i, t.j) for t in joins.range_join(p, r, "x", "lo", "hi", 2.0).select("i", "j").collect()} == hits
    found = {i for i, _ in hits}
    left = joins.range_join(p, r, "x", "lo", "hi", 2.0, "left").collect()
    assert {(t.i, t.j) for t in left} == hits | {(i, None) for i, _ in pts if i not in found} and len(left) == len(hits) + len(pts) - len(found)
    assert sorted(t.i for t in joins.range_join(p, r, "x", "lo", "hi", 2.0, "left_semi").collect()) == sorted(found)
    assert sorted(t.i for t in joins.range_join(p, r, "x", "lo", "hi", 2.0, "left_anti").collect()) == sorted({i for i, _ in pts} - found)
    assert joins.range_join(p, r.limit(0), "x", "lo", "hi", 2.0).count() == 0
    with pytest.raises(ValueError):
        joins.range_join(p, r, "x", "lo", "hi", 2.0, "full")


def test_connectby(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(8)], "k int, up int")
    assert X.connectby(chain, "k", "up", 0).count() == 8  # no silent depth
    got = {r.k: (r.level, r.branch) for r in X.connectby(chain, "k", "up", 0, max_depth=2, separator=".").collect()}
    assert got == {0: (0, "0"), 1: (1, "0.1"), 2: (2, "0.1.2")}
    loop = spark.createDataFrame([(1, 3), (2, 1), (3, 2)], "k int, up int")
    with pytest.raises(ValueError, match="loop"):
        X.connectby(loop, "k", "up", 1, separator=".")
    assert X.connectby(chain, "k", "up", 99).count() == 0


def test_recursion_over_many_rounds(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a int, b int")
    got = recursion.recursive_union(spark.createDataFrame([(0,)], "a int"), lambda t: t.join(edges, "a").select(F.col("b").alias("a")))
    assert sorted(r.a for r in got.collect()) == list(range(41))


def box(lo, hi):
    return [Range(f"c{i}", a, False, b, False) for i, (a, b) in enumerate(zip(lo, hi, strict=True))]


@pytest.mark.parametrize("d", [1, 2, 3])
def test_zero_selectivity_bound(d):
    """The bound is the most that any point outside the ranges contributes: no such point goes, and one just inside may."""
    rng = np.random.default_rng(d)
    for _ in range(5):
        lo = rng.uniform(-1, 0, d)
        hi = lo + rng.uniform(0.2, 1.5, d)
        h = rng.uniform(0.1, 0.8, d)
        inside = rng.uniform(lo, hi, (4000, d))
        edge = inside.copy()
        k = rng.integers(0, d, len(edge))
        side = rng.integers(0, 2, len(edge))
        edge[np.arange(len(edge)), k] = np.where(side == 1, hi[k], lo[k])
        middle = np.tile((lo + hi) / 2, (d, 1))
        middle[np.arange(d), np.arange(d)] = hi
        outside = np.concatenate([edge, middle, rng.uniform(-4, 4, (4000, d))])
        outside = outside[((outside <= lo) | (outside >= hi)).any(1)]
        make = lambda pts: Model("t", [f"c{i}" for i in range(d)], pts, np.zeros(d), np.ones(d), h, len(pts), karma=np.zeros(len(pts)))
        assert len(K.tkr_slots(make(outside), -9, box(lo, hi), 0.0)) == 0
        m = make(outside)
        most = m.contributions(box(lo, hi)).max()
        deep = make(((lo + hi) / 2)[None, :])
        gone = K.tkr_slots(deep, -9, box(lo, hi), 0.0)
        assert (len(gone) == 1) == (deep.contributions(box(lo, hi))[0] > most + 1e-9)
        assert len(K.tkr_slots(deep, -9, [], 0.0)) == 0  # no range, nothing outside
        assert len(K.tkr_slots(deep, -9, box(lo, hi), 0.1)) == 0


def test_batch_upkeep_keeps_shares():
    rng, shares = np.random.default_rng(2), []
    for seed in range(40):
        m = Model("t", ["c0"], np.zeros((200, 1)), np.zeros(1), np.ones(1), np.ones(1), 1000, karma=np.full(200, 3.0))
        taken = K.car_batch(m, 3000, 0, np.empty(0, np.int64), np.random.default_rng(seed), lambda k: np.ones((k, 1)), lambda k: np.zeros((k, 1)))
        assert m.rows == 4000 and len(set(taken.tolist())) == len(taken) and (m.karma[taken] == 0).all()
        shares.append((m.points == 1).mean())
    assert abs(np.mean(shares) - 0.75) < 0.02 and np.std(shares) < 0.08  # new rows have 3000 of 4000
    m = Model("t", ["c0"], np.arange(10.0)[:, None], np.zeros(1), np.ones(1), np.ones(1), 10, karma=np.zeros(10))
    K.car_batch(m, 0, 3, np.array([2, 5]), rng, None, lambda k: np.full((k, 1), 77.0))
    assert m.rows == 7 and (m.points[[2, 5], 0] == 77).all() and m.points[3, 0] == 3
    K.car_batch(m, 0, 7, np.array([0, 1]), rng, None, lambda k: np.empty((0, 1)))
    assert len(m.points) == 8 and m.rows == 0


def test_replayed_batches_change_nothing(spark, tmp_path):
    from quern.kde import feedback as FB, ranges as R, store
    from quern.streaming.feedback import learn_from, maintain

    rng = np.random.default_rng(3)
    pts = rng.normal(size=(50, 2))
    m = Model("t", ["c0", "c1"], pts, np.zeros(2), np.ones(2), np.full(2, 0.4), 50, karma=np.zeros(50))
    for _ in range(3):  # saved before any stream starts
        store.save(spark, m, str(tmp_path / "model"))
    before = m.bandwidth.copy()
    rows = [(None, "t", 1, R.encode(box([-1, -1], [1, 1])), 1000, 20)]
    FB.append(spark.createDataFrame(rows * 6, FB.FEEDBACK), str(tmp_path / "fb"))
    stream = lambda: spark.readStream.schema(FB.FEEDBACK).parquet(str(tmp_path / "fb"))
    learn_from(stream(), m, str(tmp_path / "model"), str(tmp_path / "cp")).awaitTermination()
    assert not np.allclose(m.bandwidth, before) and m.version == 4  # the first batch counts
    got = store.load(spark, str(tmp_path / "model"))
    assert got.batches == {str(tmp_path / "cp"): 0}
    (tmp_path / "cp" / "commits" / "0").unlink()  # as if the driver died after the save
    for f in (tmp_path / "cp" / "commits").glob(".0.crc"):
        f.unlink()
    learn_from(stream(), got, str(tmp_path / "model"), str(tmp_path / "cp")).awaitTermination()
    assert np.allclose(got.bandwidth, m.bandwidth) and got.version == 4

    table = spark.createDataFrame([(float(a), float(b)) for a, b in rng.normal(size=(300, 2))], "c0 double, c1 double")
    m = Model("t", ["c0", "c1"], pts.copy(), np.zeros(2), np.ones(2), np.full(2, 0.4), 350, karma=np.zeros(50))
    changes = [(i, "delete", float(p[0]), float(p[1])) for i, p in enumerate(pts[:20])] + [(99, "delete", 50.0, 50.0)]
    spark.createDataFrame(changes, "seq long, op string, c0 double, c1 double").write.parquet(str(tmp_path / "ch"))
    maintain(spark.readStream.schema("seq long, op string, c0 double, c1 double").parquet(str(tmp_path / "ch")), m, table, str(tmp_path / "cp2"), path=str(tmp_path / "m2")).awaitTermination()
    assert m.rows == 329 and len(m.points) == 50 and (m.points[20:] == pts[20:]).all() and not np.isclose(m.points[:20], pts[:20]).all(1).any()
    assert store.load(spark, str(tmp_path / "m2")).rows == 329


def test_estimator_follows_settings(spark):
    from quern.kde.estimator import Estimator

    rng = np.random.default_rng(4)
    data = rng.normal(0.5, 0.15, (3000, 2))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in data], "c0 double, c1 double")
    q = [Range("c0", 0.4, False, 0.6, False), Range("c1", 0.3, False, 0.7, False)]
    truth = float(((data > [0.4, 0.3]) & (data < [0.6, 0.7])).all(1).mean())
    kde = Estimator(df, "t", ["c0", "c1"], Config(kde_enable=True, kde_samplesize=800, kde_error_metric=Metric.QUADRATIC, kde_bandwidth_representation="log"))
    holes, plain = Estimator(df, "t", ["c0", "c1"], Config(stholes_enable=True, stholes_hole_limit=30)), Estimator(df, "t", ["c0", "c1"], Config(statistics_target=50))
    assert abs(kde.estimate(q) - truth) < 0.08 and abs(plain.estimate(q) - truth) < 0.05 and kde.model.representation == "log"
    off = abs(holes.estimate(q) - truth)
    holes.observe(q, truth)
    assert abs(holes.estimate(q) - truth) < min(off, 0.01)
    assert kde.optimise() == [] and kde.feedback == []  # neither is switched on
    tkr = Estimator(df, "t", ["c0", "c1"], Config(kde_enable=True, kde_samplesize=100, kde_sample_maintenance="tkrp", kde_sample_maintenance_karma_threshold=10.0))
    tkr.observe(q, truth)
    assert tkr.counters.rows_moved == 100  # every karma is under the threshold
    row = tkr.model.points[0] * tkr.model.sd + tkr.model.mean
    tkr.deleted(row)
    assert tkr.model.rows == 2999 and tkr.counters.rows_moved >= 101
    h = scv_bandwidth(rng.normal(size=(400, 2)))
    assert (h > 0.1).all() and (h < 1.0).all()


def test_copy_forms(spark, tmp_path):
    rows = [(1, "a\tb\\c\nd\re\x08\x0c\x0b", 1.5), (2, None, None), (3, "\\N", 2.0), (4, "", 0.0), (5, "\\.", 1.0), (6, "x|y\\|z\\\\", 3.0)]
    df = spark.createDataFrame(rows, "k int, t string, v double")
    for i, options in enumerate(({}, {"delimiter": "|"}, {"null": "NULL"})):
        path = str(tmp_path / f"t{i}")
        copy.copy_to(df, path, **options)
        assert sorted(map(tuple, copy.copy_from(spark, path, df.schema, **options).collect())) == rows
    spark.createDataFrame([("1\tx",)], "value string").write.text(str(tmp_path / "short"))
    with pytest.raises(Exception, match="hasn't 3 columns"):
        copy.copy_from(spark, str(tmp_path / "short"), df.schema).collect()
    spark.createDataFrame([("one\tx\t2",)], "value string").write.text(str(tmp_path / "bad"))
    with pytest.raises(Exception, match="invalid input|CAST_INVALID"):
        copy.copy_from(spark, str(tmp_path / "bad"), df.schema).collect()
    m = copy.copy_to_binary(df.repartition(3), f"file://{tmp_path}/bin")
    assert sorted(map(tuple, copy.copy_from_binary(m, df.schema).collect())) == rows
    with pytest.raises(Exception, match="field count"):
        copy.copy_from_binary(m, "k int, t string").collect()


def test_large_objects(spark):
    data = bytes(range(256)) * 40
    pages = LO.lo_import(spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"")), (3, None)], "id long, b binary"), "id", "b")
    get = lambda p, *a: {r.loid: bytes(r.data) for r in LO.lo_get(p, *a).collect()}
    assert get(pages)[1] == data and get(pages)[2] == b"" and get(pages, 2000, 100)[1] == data[2000:2100] and get(pages, 10_200, 500)[1] == data[10_200:10_700]
    assert get(LO.lo_put(pages, 1, 2040, b"Z" * 20))[1] == data[:2040] + b"Z" * 20 + data[2060:]
    assert get(LO.lo_put(pages, 1, 10_240, b"end"))[1] == data + b"end"
    assert get(LO.lo_put(pages, 2, 3000, b"x"))[2] == bytes(3000) + b"x"
    assert get(LO.lo_truncate(pages, 1, 2500))[1] == data[:2500] and 1 not in get(LO.lo_unlink(pages, 1))


def test_functions_see_nan_and_null(spark):
    f = P.function(lambda x: -1.0 if x != x else x * 2, "double")
    got = [r[0] for r in spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double").select(f("x")).collect()]
    assert got == [2.0, -1.0, None]
    twice = P.vectorised(lambda s: s * 2, "double", 1)
    assert spark.createDataFrame([(1.5,)], "x double").select(twice("x")).first()[0] == 3.0


def test_cursor(spark):
    c = copy.Cursor(spark.range(10).repartition(3), [F.col("id")])
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(c.fetch(3)) == [0, 1, 2] and ids(c.fetch(2)) == [3, 4] and ids(c.fetch(-2)) == [3, 2]
    assert ids(c.absolute(-1)) == [9] and ids(c.fetch(5)) == [] and ids(c.fetch(-1)) == [9]
    assert ids(c.absolute(4)) == [3] and ids(c.relative(-2)) == [1] and ids(c.absolute(0)) == []


def test_interval_errors():
    for bad in ("1 second 2 seconds", "10 milliseconds 20 milliseconds", "5.5 seconds 3 milliseconds", "1:20:05 5 microseconds", "1 day 1 day", "123 11", "123 2:03 -2:04", "", "soon"):
        with pytest.raises(ValueError):
            T.parse_interval(bad)
    for bad in ("1997-02-30", "Feb 35 17:32:01 1997", "nonsense", "13:00 PM 1997-01-01"):
        with pytest.raises(ValueError):
            T.parse_timestamp(bad)
