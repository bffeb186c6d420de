import numpy as np
import pytest
from pyspark.sql import functions as F

from skyload.operators import tuning
from skyload.operators.staging import STAGED, stage

FEATURES = ["a", "b", "c"]


def data(size=300, seed=2):
    source = np.random.default_rng(seed)
    x = source.random((size, 3))
    x[:, 2] = np.round(x[:, 2], 1)
    y = 3 * x[:, 0] + x[:, 1] - 2 * x[:, 2] + source.normal(size=size) / 2
    return x, y


def design(spark, x, y, folds=5):
    rows = [(n, n % folds, *map(float, row), float(t)) for n, (row, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "key int, fold int, x_a double, x_b double, x_c double, target double")


def project(v):
    """Projection on the simplex by bisection on the shift, independent of the sorted formula."""
    low, high = v.min() - 1, v.max()
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if np.maximum(v - mid, 0).sum() > 1 else (low, mid)
    return np.maximum(v - high, 0)


def test_simplex_projection(spark):
    source = np.random.default_rng(1)
    points = {str(n): source.normal(size=5) for n in range(20)} | {"corner": np.array([5.0, 0, 0, 0, 0]), "inside": np.full(5, 0.2), "tied": np.ones(5)}
    rows = [(name, str(at), float(v)) for name, point in points.items() for at, v in enumerate(point)]
    found = {}
    for row in tuning.simplex_projection(spark.createDataFrame(rows, "candidate string, feature string, value double")).collect():
        found.setdefault(row["candidate"], {})[int(row["feature"])] = row["weight"]
    for name, point in points.items():
        assert [found[name][at] for at in range(5)] == pytest.approx(project(point), abs=1e-9)


def test_product_sums_and_folds(spark):
    x, y = data()
    cells = {(r["fold"], r["part"], r["i"], r["j"]): r["s"] for r in tuning.fold_sums(design(spark, x, y), FEATURES).collect()}
    full = np.column_stack([np.ones(len(y)), x, y])
    names = ["one", *FEATURES, "target"]
    for fold in range(5):
        test = np.arange(len(y)) % 5 == fold
        for part, chosen in (("test", test), ("train", ~test)):
            gram = full[chosen].T @ full[chosen]
            for p, i in enumerate(names):
                for q in range(p, len(names)):
                    assert cells[fold, part, i, names[q]] == pytest.approx(gram[p, q])


def test_correlation_matrix(spark):
    x, y = data()
    df = design(spark, x, y).withColumn("flat", F.lit(0.3))
    columns = {"a": "x_a", "b": "x_b", "c": "x_c", "flat": "flat"}
    found = {(r["feature_a"], r["feature_b"]): r["corr"] for r in tuning.correlation_matrix(df, columns).collect()}
    expected = np.corrcoef(x.T)
    assert len(found) == 16
    for p, i in enumerate(FEATURES):
        assert found[i, "flat"] is None
        for q, j in enumerate(FEATURES):
            assert found[i, j] == pytest.approx(expected[p, q], abs=1e-9)


@pytest.mark.parametrize("rows", [15_000, 1_000_000])
def test_correlations_far_from_zero(spark, rows):
    """A constant column has none at any number of rows; columns near ten million keep theirs."""
    noise = F.col("id") * 7919 % 1000 / 1000
    df = spark.range(rows).select(
        F.lit(7.3).alias("flat"), (noise + 1e7).alias("far"), (noise + 1e7).alias("same"), (noise + F.col("id") * 104729 % 997 / 997).alias("mixed")
    )
    found = {(r["feature_a"], r["feature_b"]): r["corr"] for r in tuning.correlation_matrix(df, {n: n for n in df.columns}).collect()}
    assert all(found["flat", name] is None for name in df.columns)
    values = df.select("far", "mixed").toPandas()
    expected = np.corrcoef(values["far"] - 1e7, values["mixed"])[0, 1]
    assert found["far", "same"] == pytest.approx(1, abs=1e-9) and found["far", "mixed"] == pytest.approx(expected, abs=1e-7)


def test_candidate_scores(spark):
    x, y = data()
    df = design(spark, x, y)
    candidates = spark.createDataFrame(tuning.start_candidates(FEATURES, {"a": 2.0, "b": 1.0}), tuning.CANDIDATE_SCHEMA)
    train = tuning.fold_covariances(df, FEATURES).where("part = 'train'")
    found = {(r["fold"], r["candidate"]): r["corr"] for r in tuning.score_candidates(candidates, train, ["fold"]).collect()}
    for fold in range(5):
        keep = np.arange(len(y)) % 5 != fold
        for label, weights in (("uniform", [1 / 3] * 3), ("default", [2 / 3, 1 / 3, 0]), ("only:c", [0, 0, 1]), ("mix:a+c", [0.5, 0, 0.5])):
            assert found[fold, label] == pytest.approx(np.corrcoef(x[keep] @ np.array(weights), y[keep])[0, 1], abs=1e-9)


def stepwise(x, y, steps=60, rate=0.05, eps=1e-5):
    """The search as defined on rows: finite differences through the projection, best point kept."""
    quality = lambda w: np.corrcoef(x @ project(w), y)[0, 1]
    w = np.full(x.shape[1], 1 / x.shape[1])
    best, best_quality = w, quality(w)
    for _ in range(steps):
        base = quality(w)
        slope = np.array([(quality(w + eps * np.eye(len(w))[j]) - base) / eps for j in range(len(w))])
        w = project(w + rate * slope)
        if quality(w) > best_quality:
            best, best_quality = w, quality(w)
    return best, best_quality


def test_gradient_search_equals_search_on_rows(spark):
    x, y = data()
    whole = tuning.product_matrices(tuning.shifted(design(spark, x, y), FEATURES), FEATURES)
    c = tuning.covariance(F.col("sums"))
    found = whole.select(tuning.gradient_weights(c, 3, steps=60).alias("w"), c.alias("c")).select("w", tuning.weighted_corr(F.col("c"), F.col("w"), 3).alias("q")).first()
    expected, expected_quality = stepwise(x, y)
    assert found["w"] == pytest.approx(expected, abs=1e-3)
    assert found["q"] == pytest.approx(expected_quality, abs=1e-6)


def test_gradient_search_of_flat_columns(spark):
    """A target, or features, that do not vary leave the uniform weights and no correlation."""
    x, y = data()
    for flat in ({"target": F.lit(3.0)}, {f"x_{name}": F.lit(0.1) for name in FEATURES}):
        rows = tuning.tune_weights(design(spark, x, y).withColumns(flat), FEATURES, {}, "gradient").collect()
        assert [row["weight"] for row in rows] == pytest.approx([1 / 3] * 3)
        assert all(row["train_corr"] is None and row["test_corr"] is None for row in rows)


def test_only_the_sums_are_worked_out_before_the_result(spark):
    x, y = data()
    df = stage(design(spark, x, y))
    staged = len(STAGED)
    tuning.tune_weights(df, FEATURES, {}, "gradient")
    assert len(STAGED) == staged + 1


@pytest.mark.parametrize("method", ["gradient", "candidates"])
def test_tuned_weights(spark, method):
    x, y = data()
    df = design(spark, x, y)
    tuned = tuning.tune_weights(df, FEATURES, {"a": 1.0}, method).collect()
    weights = {row["feature"]: row["weight"] for row in tuned}
    assert set(weights) == set(FEATURES)
    assert sum(weights.values()) == pytest.approx(1.0) and min(weights.values()) >= 0
    assert weights["a"] > weights["b"] > weights["c"]
    assert [row["weight"] for row in tuned] == sorted(weights.values(), reverse=True)
    uniform = np.corrcoef(x.mean(axis=1), y)[0, 1]
    assert tuned[0]["train_corr"] > uniform and tuned[0]["test_corr"] > uniform - 0.05


@pytest.mark.parametrize("seed", [1, 2])
def test_rank_quality(spark, seed):
    source = np.random.default_rng(seed)
    score, hit = np.round(source.random(200), 2), source.random(200) < 0.3
    df = spark.createDataFrame([(float(s), float(h)) for s, h in zip(score, hit)], "blend double, target double")
    pairs = [(1.0 if p > n else 0.5 if p == n else 0.0) for p in score[hit] for n in score[~hit]]
    found = tuning.rank_quality(df).first()
    assert found["auc"] == pytest.approx(np.mean(pairs), abs=1e-12)
    assert (found["positives"], found["negatives"]) == (hit.sum(), (~hit).sum())
    assert tuning.rank_quality(df.where("target = 1")).first()["auc"] is None


def test_design_columns(spark):
    df = spark.createDataFrame([(1.0, 0.2, 5.0), (3.0, 0.4, 5.0), (None, 0.6, 5.0)], "a double, b_scaled double, c double").withColumn("b", F.lit(9))
    rows = tuning.design_columns(df, ["a", "b", "c"]).collect()
    assert [(row["x_a"], row["x_b"], row["x_c"]) for row in rows] == [(0.0, 0.2, 0.0), (1.0, 0.4, 0.0), (0.0, 0.6, 0.0)]


def test_target(spark):
    df = spark.createDataFrame([("Difficult", 4.0), ("Easy", None), (None, 1.0)], "difficulty_class string, dep_delay_minutes double")
    delay, binary = tuning.with_target(df, "delay")
    assert ([row["target"] for row in delay.collect()], binary) == ([4.0, 0.0, 1.0], False)
    hard, binary = tuning.with_target(df.drop("dep_delay_minutes"), "delay")
    assert ([row["target"] for row in hard.collect()], binary) == ([1.0, 0.0, 0.0], True)
