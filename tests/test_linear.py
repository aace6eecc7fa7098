import numpy as np
import pytest

from shotlab.operators.newton import fit_binary, fit_multinomial, fit_predict, gradient_norm


@pytest.mark.parametrize("L", [2, 4])
@pytest.mark.parametrize("C", [0.01, 1.0, 10.0])
def test_kernel_newton_stationary(L, C):
    rng = np.random.default_rng(L)
    X = rng.poisson(2, (24, 60)).astype(float)
    y = np.arange(24) % L
    K = X @ X.T
    if L == 2:
        a, b = fit_binary(K, y.astype(float), C)
        g = gradient_norm(K, y.astype(float), 2, C, a, b)
    else:
        A, b = fit_multinomial(K, y, L, C)
        g = gradient_norm(K, y, L, C, A, b)
    assert g < 1e-5 * max(1.0, np.abs(K).max())


def test_single_class_predicts_it():
    K = np.eye(3)
    assert list(fit_predict(K, np.array([2, 2, 2]), np.ones((2, 3)), 1.0)) == [2, 2]


def test_kernel_fit_equals_spark_ml(spark):
    """K2 (kernel Newton) and K1 (pyspark.ml, regParam = 1/(C n)) agree on one data set."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors
    rng = np.random.default_rng(3)
    X = rng.normal(size=(40, 5))
    y = (X[:, 0] + 0.5 * rng.normal(size=40) > 0).astype(int)
    C = 0.5
    a, b = fit_binary(X @ X.T, y.astype(float), C)
    w = X.T @ a
    df = spark.createDataFrame([(Vectors.dense(x.tolist()), float(t)) for x, t in zip(X, y)], ["features", "label"])
    m = LogisticRegression(regParam=1.0 / (C * len(y)), elasticNetParam=0.0, standardization=False,
                           maxIter=1000, tol=1e-12, family="binomial").fit(df)
    assert np.allclose(m.coefficients.toArray(), w, atol=1e-4)
    assert m.intercept == pytest.approx(b, abs=1e-4)


def test_large_k_with_many_classes_stays_in_memory():
    """600 rows, 14 classes (a Hessian would have 70 million numbers): stationary in a few matrices."""
    import tracemalloc
    rng = np.random.default_rng(1)
    n, L = 600, 14
    X = rng.poisson(1.0, (n, 900)).astype(float)
    y = rng.integers(0, L, n)
    X[np.arange(n), y] += 5
    K = X @ X.T
    tracemalloc.start()
    A, b = fit_multinomial(K, y, L, 1.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert gradient_norm(K, y, L, 1.0, A, b) < 1e-6 * K.max() and peak < 12 * 8 * n * n


def test_grid_of_600_rows_a_replicate(spark):
    from shotlab.operators.linear import fitted_predictions
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choice(words[i % 3::3], 6)) + " " + " ".join(rng.choice(words, 2)), i % 3) for i in range(700)]
    d = spark.createDataFrame(docs, "doc_id long, text string, y int")
    rows = d.selectExpr("0 as rep", "doc_id", "y")
    out = fitted_predictions(rows.filter("doc_id < 600"), rows.filter("doc_id >= 600"), d.select("doc_id", "text"), False, 600, cs=[0.1, 1.0], ngc=[1], ngw=[1, 2], rows=700).toPandas()
    assert len(out) == 4 * 100 and (out.gold_idx == out.pred_idx).mean() > 0.95
