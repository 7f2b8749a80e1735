"""Kaplan-Meier on a hand fixture: ties, a censored subject, S reaching 0."""

import math

from holdfast.operators import survival as SV


def test_km_with_ties_and_zero(spark):
    rows = [(1, 1, "a"), (2, 1, "a"), (2, 1, "a"), (3, 0, "a"), (4, 1, "a"), (5, 1, "a"),
            (2, 1, "b"), (6, 0, "b")]
    df = spark.createDataFrame(rows, "t int, e int, g string")
    curve = {(r["grp"], r["time"]): r["survival"]
             for r in SV.km_curve(df, "t", "e", "g").collect()}
    # group a: n=6; S(1)=5/6; S(2)=5/6*3/5=1/2; S(3)=1/2 (censored); S(4)=1/2*1/2; S(5)=0
    assert math.isclose(curve[("a", 1)], 5 / 6)
    assert math.isclose(curve[("a", 2)], 0.5)
    assert math.isclose(curve[("a", 4)], 0.25)
    assert curve[("a", 5)] == 0.0
    med = {r["grp"]: r["median_time"] for r in SV.median_survival(
        SV.km_curve(df, "t", "e", "g")).collect()}
    assert med["a"] == 2 and med["b"] == 2
    at = {(r["grp"], r["horizon"]): r["survival"] for r in SV.horizons(
        SV.km_curve(df, "t", "e", "g"), [0, 3, 10]).collect()}
    assert at[("a", 0)] == 1.0 and math.isclose(at[("a", 3)], 0.5) and at[("a", 10)] == 0.0


def test_logrank_identical_groups_is_zero(spark):
    rows = [(t, 1, g) for g in ("x", "y") for t in (1, 2, 3, 4)]
    df = spark.createDataFrame(rows, "t int, e int, g string")
    r = SV.logrank_test(df, "t", "e", "g").first()
    assert abs(r["chi2"]) < 1e-9 and r["dof"] == 1


def _logrank_numpy(t, e, g):
    import numpy as np
    groups = sorted(set(g))
    k = len(groups)
    o, ex, v = np.zeros(k), np.zeros(k), np.zeros((k, k))
    t, e, g = np.array(t), np.array(e), np.array(g)
    for time in sorted(set(t[e == 1])):
        at = t >= time
        n = at.sum()
        d = ((t == time) & (e == 1)).sum()
        ng = np.array([(at & (g == x)).sum() for x in groups], dtype=float)
        dg = np.array([((t == time) & (e == 1) & (g == x)).sum() for x in groups], dtype=float)
        o += dg
        ex += ng * d / n
        if n > 1:
            p = ng / n
            v += d * (n - d) / (n - 1) * (np.diag(p) - np.outer(p, p))
    diff = (o - ex)[:-1]
    return float(diff @ np.linalg.inv(v[:-1, :-1]) @ diff)


def test_logrank_matches_brute_force(spark):
    import random
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 30), int(rnd.random() < 0.6), rnd.choice("abc")) for _ in range(400)]
    df = spark.createDataFrame(rows, "t int, e int, g string")
    got = SV.logrank_test(df, "t", "e", "g").first()["chi2"]
    want = _logrank_numpy(*zip(*rows))
    assert math.isclose(got, round(want, 4), abs_tol=1e-4)


def test_logrank_many_groups_and_times(spark):
    """2,000 groups, 10,000 distinct times: pair sums in blocks of times."""
    import numpy as np
    rng = np.random.default_rng(11)
    k, t_max, n = 2000, 10_000, 30_000
    t = np.concatenate([np.arange(t_max), rng.integers(0, t_max, n - t_max)])
    g = np.concatenate([rng.permutation(k), rng.integers(0, k, n - k)])
    e = rng.random(n) < 0.5
    at = np.zeros((t_max + 1, k))
    np.add.at(at, (t, g), 1)
    dead = np.zeros((t_max, k))
    np.add.at(dead, (t[e], g[e]), 1)
    at = at[::-1].cumsum(axis=0)[::-1][:t_max]
    n_t, d_t = at.sum(axis=1), dead.sum(axis=1)
    w = np.where(n_t > 1, d_t * (n_t - d_t) / np.maximum(n_t - 1, 1), 0)
    share = at / n_t[:, None]
    v = np.diag((w[:, None] * share).sum(axis=0)) - (share * w[:, None]).T @ share
    diff = (dead.sum(axis=0) - (share * d_t[:, None]).sum(axis=0))[:-1]
    want = float(diff @ np.linalg.solve(v[:-1, :-1], diff))
    import pyarrow as pa
    df = spark.createDataFrame(pa.table({"t": t, "e": e.astype(int), "g": g}))
    r = SV.logrank_test(df, "t", "e", "g").first()
    assert (r["groups"], r["dof"]) == (k, k - 1)
    assert math.isclose(r["chi2"], want, rel_tol=1e-6)
    assert 0.0 < r["p_value"] < 1.0


def test_logrank_null_group_single_group_and_none(spark):
    rows = [(t, t % 2, g) for g in (None, "x") for t in range(6)] + [(None, 1, "x")]
    df = spark.createDataFrame(rows, "t int, e int, g string")
    r = SV.logrank_test(df, "t", "e", "g").first()
    assert r["groups"] == 2 and abs(r["chi2"]) < 1e-9
    one = SV.logrank_test(df.filter("g = 'x'"), "t", "e", "g").first()
    assert (one["groups"], one["dof"], one["chi2"], one["p_value"]) == (1, 0, 0.0, 1.0)
    assert SV.logrank_test(df.limit(0), "t", "e", "g").count() == 0


def test_as_of_lookup_is_a_merge(spark):
    df = spark.createDataFrame([(2, 1, "a"), (4, 1, "a"), (9, 0, "b")], "t int, e int, g string")
    at = SV.survival_at(SV.km_curve(df, "t", "e", "g"), upto=5)
    plan = at._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    got = {(r["grp"], r["t"]): r["survival"] for r in at.collect()}
    assert [got[("a", t)] for t in range(1, 6)] == [1.0, 0.5, 0.5, 0.0, 0.0]
    assert {got[("b", t)] for t in range(1, 6)} == {1.0}
