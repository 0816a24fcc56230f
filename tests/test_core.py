import numpy as np
import pytest
from pyspark.sql import functions as F

from blockloom.operators import evaluate, inference, knn, preprocess, report, solver, tuning
from blockloom.operators.models import MBsPCA, MBsPLS, MBsPLSXY, Model
from blockloom.operators.moments import Moments, moments, moments_by
from blockloom.sources import tables
from blockloom.sources.tables import BlockTable
from blockloom.streaming.scoring import MomentStream


def signal(spark, n=60, seed=1):
    rng = np.random.default_rng(seed)
    z = rng.normal(size=n)
    x = np.column_stack([z + rng.normal(0, 0.2, n), rng.normal(size=n), z + rng.normal(0, 0.2, n), rng.normal(size=n)])
    rows = [(i, *map(float, r), "A" if i % 2 else "B") for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "row_id long, x1 double, x2 double, y1 double, y2 double, y string")
    return BlockTable(df, {"x": ("x1", "x2"), "y": ("y1", "y2")}), x


def test_moments_do_not_depend_on_partitions(spark):
    t, x = signal(spark)
    for parts in (1, 7):
        m = moments(t.df.repartition(parts), t.columns)
        assert np.allclose(m.g, x.T @ x) and np.allclose(m.s, x.sum(axis=0)) and m.n == 60
    a = moments_by(t.df, t.columns, replicates=3, row_id="row_id", seed=4)
    b = moments_by(t.df.repartition(5), t.columns, replicates=3, row_id="row_id", seed=4)
    assert all(np.allclose(a[r].g, b[r].g) for r in range(3)) and a[0].n != a[1].n


def test_moments_refuse_missing_values(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "a double")
    with pytest.raises(Exception, match="finite"):
        moments(df, ["a"])


def test_sparse_unit_keeps_its_bounds():
    g = np.array([3.0, -2.0, 1.0, 0.1])
    for c in (1.0, 1.3, 1.7, 2.0):
        w = solver.sparse_unit(g, c)
        assert abs(np.linalg.norm(w) - 1) < 1e-9 and np.abs(w).sum() <= c + 1e-6
    assert np.allclose(solver.sparse_unit(g, 2.0), g / np.linalg.norm(g))


def test_fit_equals_a_fit_on_rows_and_scores_are_deflated(spark):
    t, x = signal(spark)
    model = MBsPLS(2, np.full((2, 2), np.sqrt(2))).fit(t)
    assert model.objectives[0] > 0.9 and sum(model.ev_comp) <= 1 + 1e-9
    scores = model.transform(t).orderBy("row_id").toPandas()
    blocks = [x[:, :2].copy(), x[:, 2:].copy()]
    for k in range(2):
        for b, name in enumerate(("x", "y")):
            s = blocks[b] @ model.weights[k][name]
            assert np.allclose(s, scores[f"LV{k + 1}_{name}"], atol=1e-8)
            blocks[b] -= np.outer(s, s @ blocks[b] / (s @ s))
    assert abs(scores.LV1_x @ scores.LV2_x) < 1e-6
    again = Model.from_json(model.to_json())
    assert np.allclose(again.weights[0]["x"], model.weights[0]["x"])
    assert np.allclose(model.flipped(-1).weights[0]["x"], -model.weights[0]["x"])


def test_supervised_and_pca(spark):
    t, _ = signal(spark)
    sup = BlockTable(t.df, t.blocks, "y", "classif")
    out = MBsPLSXY(1).fit(sup).transform(sup)
    assert {"LV1_x", "LV1_y"} <= set(out.columns) and not any(".target" in c for c in out.columns)
    assert any(".target" in c for c in MBsPLSXY(1, emit_y_scores=True).fit(sup).weights[0])
    pca = MBsPCA(1).fit(t)
    assert all(abs(np.linalg.norm(w) - 1) < 1e-9 for w in pca.weights[0].values())


def test_block_rules(spark):
    df = spark.createDataFrame([(i, 1.0, float(i), None if i % 2 else 1.0 * i) for i in range(10)], "row_id long, c double, a double, b double")
    with pytest.raises(ValueError, match="disjoint"):
        BlockTable(df, {"p": ("a", "b"), "q": ("b",)})
    t = BlockTable(df, {"p": ("c", "a", "b"), "q": ("c2",)} if "c2" in df.columns else {"p": ("c", "a", "b")})
    assert t.resolved().columns == ["a", "b"]
    assert tables.synthetic(spark).df.count() == 90


def test_tests_and_selection(spark):
    t, _ = signal(spark)
    e = MBsPLS(1, np.full((2, 1), np.sqrt(2)))
    model = e.fit(t)
    assert inference.permutation_test(model, t, 60)[0]["p_value"] < 0.1
    assert inference.bootstrap_test(model, t, 40)[0]["low"] > 0
    assert MBsPLS(1, np.full((2, 1), np.sqrt(2)), permutations=30).fit(t).p_values[0] < 0.1
    stable, summary = inference.StabilitySelection(20).fit(t, model, e)
    kept = {r["feature"] for r in inference.select_stable(summary).collect()}
    assert {"x1", "y1"} <= kept and stable.chosen("stable_ci").weights[0]["x"][0] != 0
    with pytest.raises(ValueError, match="stable_frequency"):
        stable.chosen("stable_frequency")
    _, none = inference.StabilitySelection(5, min_score_cor=1.01).fit(t, model, e)
    assert none.agg(F.max("n_eff")).first()[0] == 0


def test_stated_measures():
    p = {"mac": [0.5, 0.25], "ev_comp": [0.2, 0.8], "ev_block": [[0.1, 0.3], [0.2, 0.4]], "blocks": ["a", "b"], "metric": "mac"}
    got = {m: evaluate.measure(p, m)["score"] for m in ("mac", "ev", "block_ev", "mac_evwt")}
    assert np.allclose([got[k] for k in ("mac", "ev", "block_ev", "mac_evwt")], [0.375, 0.5, 0.25, 0.30])
    assert evaluate.measure({**p, "mac": [0.2, 0.8, 0.5], "ev_comp": [-1, 2, -3]}, "mac_evwt")["score"] == pytest.approx(0.8)
    assert evaluate.measure({**p, "ev_comp": [-2, -1]}, "mac_evwt")["reason"] == "nonpositive_ev"
    assert evaluate.measure(None, "mac")["reason"] == "missing_payload"
    assert evaluate.measure({"mac": [3**0.5], "ev_comp": [1], "ev_block": [[1]], "blocks": list("abc"), "metric": "frobenius"}, "mac")["score"] == pytest.approx(1)


def test_combined_p_values():
    n = evaluate.NORMAL
    want = 1 - n.cdf((10**0.5 * n.inv_cdf(0.9) + 12**0.5 * n.inv_cdf(0.8)) / 22**0.5)
    assert evaluate.stouffer([0.1, 0.2], [10**0.5, 12**0.5]) == pytest.approx(want, abs=1e-12)
    assert evaluate.fisher([0.5]) == pytest.approx(0.5)


def test_scores_without_variance_give_no_correlation():
    m = Moments(("a", "b"), 5, np.array([5.0, 5.0]), np.full((2, 2), 5.0))
    model = Model({"x": ("a",), "y": ("b",)}, [{"x": np.array([0.5]), "y": np.array([0.5])}], [{"x": np.array([1.0]), "y": np.array([1.0])}], [0], [{}], [0], [0])
    assert np.isnan(evaluate.test_ev(m, model)["mac"][0])


def test_overview_of_stated_rows(spark):
    rows = [("A", 40, 21, 1, None), ("A", 40, None, 2, 1), ("B", 40, 25, 3, 0), ("B", 40, 26, 4, 1), ("A", 40, None, 5, 0), ("B", 40, 29, 6, 1)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_id long, site string, clin_age int, clin_bmi int, omics_1 int, omics_2 int")
    t = BlockTable(df, {"clin": ("clin_age", "clin_bmi"), "omics": ("omics_1", "omics_2")})
    got = {r["issue"] for r in report.issues(t).collect()}
    assert {"constant_numeric_features", "missing_values"} <= got
    assert report.overview(t).first()["missing_cells"] == 3


def test_unseen_sites(spark):
    rows = [(i, "A" if i < 20 else "B", float(i % 7) + (0 if i < 20 else 5), float(i % 3)) for i in range(40)]
    t = BlockTable(spark.createDataFrame(rows, "row_id long, site string, x double, z double"), {"a": ("x",), "b": ("z",)})
    new = t.with_df(spark.createDataFrame([(1, "A", 2.5, 1.0), (2, "C", 2.5, 1.0)], "row_id long, site string, x double, z double"))
    for fit, same in ((preprocess.PartialCorrection("site", unknown_site="baseline"), True), (preprocess.PartialCorrection("site"), False), (preprocess.ComBat("site", unknown="baseline"), True)):
        a, b = [r["x"] for r in fit.fit(t).transform(new).df.orderBy("row_id").collect()]
        assert (a == pytest.approx(b)) == same
    assert [r["x"] for r in preprocess.PartialCorrection("site").fit(t).transform(new).df.where("row_id = 2").collect()] == [2.5]


def test_suffix_collision(spark):
    t = BlockTable(spark.createDataFrame([(1, 1.0, 2.0)], "row_id long, x double, x_sfx double"), {"a": ("x",), "b": ("x_sfx",)})
    got = preprocess.Suffix(skip_already_suffixed=False).fit(t).transform(t)
    assert set(got.columns) == {"x_sfx", "x_sfx_sfx"}


def test_label_filter(spark):
    t = BlockTable(spark.createDataFrame([(1, 1.0, "A"), (2, 2.0, "B")], "row_id long, x double, y string"), {"a": ("x",)}, "y")
    got = preprocess.LabelFilter(("A",)).fit(t).transform(t)
    assert got.df.count() == 1 and len(got.levels) == 2
    with pytest.raises(ValueError, match="no rows"):
        preprocess.LabelFilter(("Z",)).fit(t)


def test_neighbours_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.normal()) if i % 5 else None, str(rng.choice(list("abc"))), str(rng.choice(["n", "p"]))) for i in range(60)]
    test = spark.createDataFrame([r[:3] for r in rows[:15]], "test_id long, x double, c string")
    train = spark.createDataFrame(rows[15:], "train_id long, x double, c string, y string")
    xs = [r[1] for r in rows[15:] if r[1] is not None]
    span = max(xs) - min(xs)

    def dist(a, b):
        d = [] if a[1] is None or b[1] is None else [abs(a[1] - b[1]) / span]
        d.append(float(a[2] != b[2]))
        return sum(d) / len(d)

    want = {(a[0], b[0]) for a in rows[:15] for b in sorted(rows[15:], key=lambda b: (round(dist(a, b), 12), b[0]))[:3]}  # noqa: B023
    for most in (200_000, 10):
        monkeypatch.setattr(knn, "BROADCAST_ROWS", most)
        assert {(r["test_id"], r["train_id"]) for r in knn.neighbours(test, train, ["x"], ["c"], 3).collect()} == want
    prob = knn.classify(test, train, "y", ["x"], ["c"], 3, levels=("n", "p", "q")).first()
    assert prob["prob_q"] == 0 and prob["prob_n"] + prob["prob_p"] == pytest.approx(1)


def test_tuning_and_nested_cv(spark):
    t, _ = signal(spark)
    c, log = tuning.SequentialTuner(1, budget=4).fit(t)
    assert c.shape == (2, 1) and np.isfinite(log[0]["score"])
    rows = tuning.NestedCV([preprocess.BlockScaling()], 2, tuning.SequentialTuner(1, budget=3)).run(t)
    assert all(r["defined"] for r in rows)
    with pytest.raises(ValueError, match="selection"):
        tuning.Pipeline([], MBsPLS(1), stability_only=True).fit(t)


def test_moment_stream_counts_a_batch_once(spark):
    t, x = signal(spark)
    s = MomentStream(t.columns)
    s.add(t.df.where("row_id < 30"), 0)
    s.add(t.df.where("row_id < 30"), 0)
    s.add(t.df.where("row_id >= 30"), 1)
    assert np.allclose(s.moments.g, x.T @ x)


def test_average_ranks(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([3.0, 1.0, 3.0, 2.0])], "i int, v double")
    assert [r["v"] for r in evaluate.ranked(df, ["v"]).orderBy("i").collect()] == [3.5, 1.0, 3.5, 2.0]


def test_assignment_is_exact():
    from itertools import permutations

    rng = np.random.default_rng(3)
    for _ in range(60):
        k = int(rng.integers(1, 6))
        gain = rng.random((k, k + int(rng.integers(0, 3)))).round(1)
        got = inference.assignment(gain)
        best = max(sum(gain[i, j] for i, j in enumerate(p)) for p in permutations(range(gain.shape[1]), k))
        assert len(set(got)) == k and abs(sum(gain[i, j] for i, j in enumerate(got)) - best) < 1e-9
    big = np.eye(30)[::-1] + rng.random((30, 30)) * 0.4  # more than a greedy choice would get right for sure
    assert inference.assignment(big) == list(range(30))[::-1]


def test_stable_scores_deflate_by_their_own_loadings(spark):
    t, x = signal(spark, 80)
    e = MBsPLS(2, np.full((2, 2), np.sqrt(2)))
    model = e.fit(t)
    weights = [{"x": np.array([1.0, 0.0]), "y": np.array([0.6, 0.8])}, {"x": np.array([0.0, 1.0]), "y": np.array([1.0, 0.0])}]
    stable = model.with_stable("ci", weights, moments(t.df, t.columns))
    got = Model.from_json(stable.to_json()).transform(t, "stable_ci").orderBy("row_id").toPandas()
    blocks = [x[:, :2].copy(), x[:, 2:].copy()]
    for k in range(2):
        for b, name in enumerate(("x", "y")):
            s = blocks[b] @ weights[k][name]
            assert np.allclose(s, got[f"LV{k + 1}_{name}"], atol=1e-8)
            blocks[b] -= np.outer(s, s @ blocks[b] / (s @ s))


def test_knn_keeps_every_row_and_says_what_is_missing(spark):
    train = spark.createDataFrame([(1, 0.0, "a"), (2, 1.0, "b"), (3, 5.0, None)], "train_id int, x double, y string")
    test = spark.createDataFrame([(10, 0.1), (11, None)], "test_id int, x double")
    with pytest.warns(UserWarning, match="2 training rows"):
        got = {r["test_id"]: r["response"] for r in knn.classify(test, train, "y", ["x"], k=3).collect()}
    assert got == {10: "a", 11: None}
    with pytest.raises(Exception, match="no neighbour"):
        knn.classify(test, train, "y", ["x"], k=1, no_neighbours="fail").collect()
    with pytest.raises(ValueError, match="1 training rows have no y"):
        knn.classify(test, train, "y", ["x"], k=1, missing_target="fail")
    numbers = train.withColumn("z", F.col("train_id").cast("double"))
    assert {r["test_id"]: r["response"] for r in knn.regress(test, numbers, "z", ["x"], k=1).collect()} == {10: 1.0, 11: None}


def test_concordance_uses_complete_pairs(spark):
    rows = [(1.0, 2.0), (2.0, 2.5), (3.0, 4.5), (4.0, None), (None, 100.0), (9.0, float("nan"))]
    got = evaluate.concordance(spark.createDataFrame(rows, "a double, b double"), [("a", "b")]).first()
    x = np.array(rows[:3])
    c = np.cov(x.T)
    assert got["n"] == 3 and abs(got["ccc"] - 2 * c[0, 1] / (c[0, 0] + c[1, 1] + (x[:, 0].mean() - x[:, 1].mean()) ** 2)) < 1e-12


def test_every_small_class_is_named(spark):
    rows = [(i, float(i), f"c{i % 1500}") for i in range(3000)] + [(9000, 1.0, "alone")]
    t = BlockTable(spark.createDataFrame(rows, "row_id long, x double, y string"), {"a": ("x",)}, "y", "classif")
    assert report.issues(t).where("issue = 'small_class'").count() == 1501


def test_strict_objective_and_mean_z(spark):
    assert evaluate.strict_objective({"mac": [0.5, 0.7]}, 2) == pytest.approx(0.6)
    for bad in ({"mac": [0.5, float("nan")]}, {"mac": []}):
        with pytest.raises(ValueError, match="undefined"):
            evaluate.strict_objective(bad, 2)
    df = spark.createDataFrame([(1, 1.0, 5.0, 7.0), (2, 2.0, 5.0, None), (3, 3.0, 5.0, 9.0)], "row_id int, a double, b double, c double")
    got = {r["row_id"]: r["LC"] for r in evaluate.mean_z_score(df, "row_id", ["a", "b", "c"]).collect()}
    assert got[2] == 0 and got[1] == pytest.approx((-1 - 2**-0.5) / 2)


def test_synthetic_tables_do_not_depend_on_partitions(spark):
    a, b = (tables.synthetic(spark, 200, 3, "classif").df for _ in range(2))
    spread = b.repartition(7).orderBy("row_id").toPandas()
    assert a.orderBy("row_id").toPandas().equals(spread) and set(spread.site_batch) == {"A", "B", "C"}
    assert abs(spread.response.mean()) < 1e-9 and spread.subtype.value_counts().max() <= 68
    big = tables.synthetic(spark, 20_000).df.agg(F.corr("block_a_1", "block_a_2").alias("r"), F.stddev("block_c_1").alias("s")).first()
    shift = 0.0144 * 2 / 3
    assert big["s"] == pytest.approx((0.1**2 + 1.1**2 + 0.8**2 + 0.35**2 + shift) ** 0.5, rel=0.03)


def test_names_dummies_and_strata(spark):
    from blockloom.operators.models import parse_score_name

    assert parse_score_name("LV12_a_b") == ("LV", 12, "a_b") and parse_score_name("PC1_x") == ("PC", 1, "x") and parse_score_name("LVx_a") is None
    assert tables.expanded(["x", "c.a", "c.b", "cc"], {"p": ["x", "c"], "q": ["cc"]}) == {"p": ("x", "c.a", "c.b"), "q": ("cc",)}
    df = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "b"), (3, 1.0, "c")], "row_id int, x double, y string")
    t = BlockTable(df, {"p": ("x",)}, "y", "classif", roles={"stratum": ("y",)})
    assert preprocess.LabelFilter(("c",), invert=True, drop_stratum=True).fit(t).transform(t).roles == {"stratum": ()}


def test_early_stop_of_permutations(spark):
    calls = []
    work = lambda rng: float(rng.random())
    real = inference._replicates
    try:
        inference._replicates = lambda *a: calls.append(a[1]) or real(*a)
        assert inference._p_value(spark, 1000, work, 1, 0.5, early=0.04) > 0.3 and sum(calls) < 1000
        calls.clear()
        assert inference._p_value(spark, 200, work, 1, 2.0, early=0.05) == 1 / 201 and sum(calls) == 200
    finally:
        inference._replicates = real


def test_neighbours_by_blocks_equal_those_by_joins(spark, monkeypatch):
    rng = np.random.default_rng(8)
    row = lambda i: (i, float(rng.integers(0, 6)) if rng.random() < 0.8 else None, float(rng.normal()), rng.choice(["a", "b", "c"]) if rng.random() < 0.8 else None, rng.choice(["low", "mid", "high"]))
    cols = "x double, z double, c string, o string"
    test, train = (spark.createDataFrame([tuple(v.item() if hasattr(v, "item") else v for v in row(i)) for i in range(n)], f"{side}_id int, {cols}") for side, n in (("test", 40), ("train", 70)))
    got = []
    for bound in (200_000, 15):
        monkeypatch.setattr(knn, "BROADCAST_ROWS", bound)
        found = knn.neighbours(test, train, ["x", "z"], ["c"], 4, 0.5, {"o": ["low", "mid", "high"]}, keep=("z",))
        got.append(sorted((r["test_id"], r["nn"], r["train_id"], round(r["dist"], 12), r["z"]) for r in found.collect()))
    assert got[0] == got[1] and len(got[0]) == 160
    assert knn.neighbours(test, train.limit(0), ["x"], [], 2).count() == 0 and knn.neighbours(test.limit(0), train, ["x"], [], 2).count() == 0


def test_tuner_prepares_each_fold_by_its_training_part(spark):
    t, x = signal(spark, 90)
    t = t.with_df(t.df.withColumn("x1", F.col("x1") * 50 + F.when(F.col("row_id") > 80, 400).otherwise(0)))
    tuner = tuning.SequentialTuner(1, budget=4, folds=3, seed=2, steps=[preprocess.BlockScaling("feature_zscore")])
    whole, blocks, folds = tuner._prepared(t, None)
    pdf = tuning.with_folds(t.df, "row_id", 3, 2).toPandas()
    for f, (train, test) in enumerate(folds):
        a, b = (pdf[mask][["x1", "x2", "y1", "y2"]].to_numpy() for mask in (pdf.fold != f, pdf.fold == f))
        scale = a.std(axis=0, ddof=1) * np.sqrt(2)
        za, zb = (a - a.mean(axis=0)) / scale, (b - a.mean(axis=0)) / scale
        assert np.allclose(train.g, za.T @ za) and np.allclose(test.g, zb.T @ zb) and np.allclose(test.s, zb.sum(axis=0))
    assert whole.n == 90 and blocks == {"x": ("x1", "x2"), "y": ("y1", "y2")}
    c, log = tuner.fit(t)
    assert c.shape == (2, 1) and np.isfinite(log[0]["score"])
    assert tuner._prepared(t, t)[2][0][0].n == folds[0][0].n + 90


def test_correction_fitted_to_a_subgroup(spark):
    rows = [(1, "s", "c", 1.0), (2, "s", "c", 3.0), (3, "s", "d", 9.0), (4, "t", "c", 5.0), (5, "t", "d", 50.0), (6, "u", "d", 7.0)]
    t = BlockTable(spark.createDataFrame(rows, "row_id int, site string, g string, x double"), {"a": ("x",)})
    got = {r["row_id"]: round(r["x"], 9) for r in preprocess.PartialCorrection("site", subgroup=("g", ("c",))).fit(t).transform(t).df.collect()}
    assert got == {1: 2.0, 2: 4.0, 3: 10.0, 4: 3.0, 5: 48.0, 6: 7.0}
    with pytest.raises(ValueError, match="no row"):
        preprocess.PartialCorrection("site", subgroup=("g", ("z",))).fit(t)


def test_grouped_quantiles_are_exact_over_many_chunks(spark, monkeypatch):
    from blockloom.operators import quantiles

    rng = np.random.default_rng(5)
    n = 6000
    x = np.round(rng.normal(size=n) * 50, 1)
    y = np.where(rng.random(n) < 0.7, 3.0, rng.normal(size=n) * 1e-3)
    rows = [(["a", "b", "c", None][i % 4 if i % 8 < 5 else 0], None if i % 11 == 0 else float(x[i]), float("nan") if i % 500 == 3 else float(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(3)
    probs = [i / 20 for i in range(21)]
    at = ", ".join(f"{p}D" for p in probs)
    want = {r["g"]: r for r in df.where("g is not null").groupBy("g").agg(*[F.expr(f"percentile({c}, array({at}))").alias(c) for c in ("x", "y")]).collect()}
    for cells in (1 << 22, 64):
        monkeypatch.setattr(quantiles, "CELLS", cells)
        got = quantiles.grouped_quantiles(df, "g", ["x", "y"], probs)
        assert set(got) == {(g, c) for g in want for c in ("x", "y")}
        assert all(np.array_equal(got[g, c], want[g][c], equal_nan=True) for g, c in got)
    points = np.arange(0, 3200, quantiles.STEP)
    low, high = quantiles._brackets(points, 1, np.array([1600, 2400]))
    assert len(low) == 2 and (high - low).max() <= 2 * quantiles.STEP


def test_quantile_repair_of_stated_rows(spark):
    rows = [(i, "s" if i % 2 else "t", float(i)) for i in range(8)] + [(8, "s", None), (9, None, 5.0), (10, "s", float("nan"))]
    t = BlockTable(spark.createDataFrame(rows, "row_id int, site string, x double"), {"a": ("x",)})
    fit = preprocess.QuantileRepair("site", 1.0, 4).fit(t.filter("row_id < 8"))
    got = {r["row_id"]: r["x"] for r in fit.transform(t).df.collect()}
    assert [round(got[i], 9) for i in range(8)] == [0.5, 0.5, 2.5, 2.5, 4.5, 4.5, 6.5, 6.5]
    assert got[8] is None and got[9] == 5.0 and np.isnan(got[10])


def test_neighbours_visit_few_leaves_and_miss_none(spark, monkeypatch):
    monkeypatch.setattr(knn, "LEAF", 8)
    rng = np.random.default_rng(11)
    n = 900
    x, z, c = np.round(rng.normal(size=n), 1), np.where(rng.random(n) < 0.2, np.nan, rng.normal(size=n)), rng.choice(list("abcd"), n)
    x[:200], z[:200], c[:200] = 0.5, 0.25, "a"  # alike in all: the least ids count
    train = [(int(i), float(x[i]), None if np.isnan(z[i]) else float(z[i]), None if i % 13 == 0 else str(c[i])) for i in rng.permutation(n)]
    test = [(i, float(np.round(rng.normal(), 1)), None if i % 7 == 0 else float(rng.normal()), None if i % 9 == 0 else str(rng.choice(list("abce")))) for i in range(60)] + [(99, 0.5, 0.25, "a")]
    a, b = spark.createDataFrame(test, "test_id int, x double, z double, c string"), spark.createDataFrame(train, "train_id int, x double, z double, c string")
    spans = [max(r[f] for r in train if r[f] is not None) - min(r[f] for r in train if r[f] is not None) for f in (1, 2)]

    def dist(p, q):
        d = [abs(p[f] - q[f]) / s for f, s in zip((1, 2), spans, strict=True) if p[f] is not None and q[f] is not None]
        d += [float(p[3] != q[3])] if p[3] and q[3] else []
        return sum(d) / len(d)

    want = [(p[0], i + 1, q) for p in test for i, (_, q) in enumerate(sorted((dist(p, q), q[0]) for q in train)[:4])]
    for rows in (1_000_000, 400):
        monkeypatch.setattr(knn, "BROADCAST_ROWS", rows)
        got = sorted((r["test_id"], r["nn"], r["train_id"]) for r in knn.neighbours(a, b, ["x", "z"], ["c"], 4).collect())
        assert got == want
    order, firsts = knn._tree(np.array([x, z]), np.zeros((1, n), np.int64), spans)
    assert sorted(order) == list(range(n)) and np.diff(np.r_[firsts, n]).max() <= 8


def test_correction_reads_arrays_of_fits_and_treats_unseen_levels_as_the_first(spark):
    rows = [(i, "st"[i % 2], "pqr"[i % 3], float(i % 5), float(i * i % 17)) for i in range(60)]
    names = "row_id int, site string, kind string, z double, x double"
    t = BlockTable(spark.createDataFrame(rows, names), {"a": ("x",)})
    fit = preprocess.PartialCorrection("site", ("kind", "z")).fit(t)
    design = np.array([[1.0, r[1] == "t", r[2] == "q", r[2] == "r", r[3]] for r in rows], float)
    y = np.array([r[4] for r in rows])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    got = [r["x"] for r in fit.transform(t).df.orderBy("row_id").collect()]
    assert np.allclose(got, y - design @ beta + y.mean())
    new = t.with_df(spark.createDataFrame([(1, "s", "new", 0.0, 1.0), (2, "u", "p", 0.0, 1.0), (3, None, "p", 0.0, 1.0)], names))
    after = {r["row_id"]: r["x"] for r in fit.transform(new).df.collect()}
    assert after[1] == pytest.approx(1 - beta[0] + y.mean()) and after[2] == after[3] == 1.0
    plan = fit.transform(t).df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CASE WHEN") <= 4  # one for site and one for kind, and the column's own


def test_label_filter_reads_levels_only_to_transform(spark):
    df = spark.createDataFrame([(i, float(i), "AB"[i % 2]) for i in range(8)], "row_id int, x double, y string").repartition(1)
    read = []
    for use in (lambda t: preprocess.LabelFilter(("A",), invert=True).fit(t), lambda t: preprocess.LabelFilter(("A",), invert=True).fit(t).transform(t)):
        seen = spark.sparkContext.accumulator(0)
        counted = df.withColumn("y", F.udf(lambda y, seen=seen: seen.add(1) or y, "string")("y"))
        use(BlockTable(counted, {"a": ("x",)}, "y"))
        read.append(seen.value)
    assert read[1] - read[0] >= 8 > read[0] - 8


def test_ranks_of_few_values_are_broadcast_and_of_many_joined(spark, monkeypatch):
    df = spark.createDataFrame([(i, float(i % 7), None if i % 5 == 0 else float(i * 37 % 11)) for i in range(200)], "i int, v double, w double")
    got = {}
    for most in (2_000_000, 1):
        monkeypatch.setattr(evaluate, "BROADCAST_RANKS", most)
        out = evaluate.ranked(df, ["v", "w"])
        hinted = out._jdf.queryExecution().optimizedPlan().toString().count("rightHint=(strategy=broadcast)")
        assert hinted == (4 if most > 1 else 2)  # two for the partitions' sums
        got[most] = sorted(map(tuple, out.collect()), key=lambda r: r[0])
    assert got[1] == got[2_000_000] and sum(r[2] is None for r in got[1]) == 40


def test_concordance_merges_parts_and_keeps_digits(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 3)) + [1e8, 1e8, 0]
    x[:, 1] += x[:, 0] - 1e8
    df = spark.createDataFrame([tuple(map(float, r)) for r in x] + [(None, 1.0, None), (float("nan"), None, 2.0)], "a double, b double, c double").withColumn("k", F.lit(3.0)).repartition(5)
    got = {(r["a"], r["b"]): r for r in evaluate.concordance(df, [("a", "b"), ("b", "c"), ("c", "k")]).collect()}
    for i, j in ((0, 1), (1, 2)):
        c, r = np.cov(x[:, i], x[:, j]), got["abc"[i], "abc"[j]]
        assert r["n"] == 500 and r["r"] == pytest.approx(c[0, 1] / np.sqrt(c[0, 0] * c[1, 1]), rel=1e-7)
        assert r["slope"] == pytest.approx(c[0, 1] / c[0, 0], rel=1e-6)
        assert r["ccc"] == pytest.approx(2 * c[0, 1] / (c[0, 0] + c[1, 1] + (x[:, i].mean() - x[:, j].mean()) ** 2), rel=1e-6)
    assert got["c", "k"]["n"] == 501 and got["c", "k"]["r"] is None
    plan = evaluate.concordance(df, [("a", "b")])._jdf.queryExecution().optimizedPlan().toString()
    assert "corr(" not in plan and "MapInArrow" in plan


def test_orders_design_shuffles_lineitem_by_part_and_order_only(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "5000")
        plan = tables.orders_design(spark, "/root/testdata/sf0.01").df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    at = next(line for line in joins if "o_custkey" in line)
    assert "l_orderkey" in joins[0] and joins.index(at) > 0 and "l_" not in at
