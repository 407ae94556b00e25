"""L1 fits on the moments of the rows."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from airsignal.ml import models as M


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 4)).round(2)
    y = np.where(x[:, 1] > 0.3, 5.0, 0.0) + x[:, 0] + rng.normal(scale=0.1, size=700)
    df = spark.createDataFrame([(Vectors.dense(a.tolist()), float(b)) for a, b in zip(x, y)], ["features", "label"])
    return x, y, df


def test_lasso_needs_one_pass(rows):
    """The iterations run on the moments; the optimum is that of the iterations over the rows."""
    from pyspark.ml.regression import LinearRegression

    _, _, df = rows
    ours, theirs = M.fit_lasso(df, 0.1), LinearRegression(regParam=0.1, elasticNetParam=1.0, standardization=False, solver="l-bfgs", tol=1e-10, maxIter=500).fit(df)
    assert ours.getSolver() == "normal"
    assert ours.coefficients.toArray() == pytest.approx(theirs.coefficients.toArray(), abs=1e-5)
