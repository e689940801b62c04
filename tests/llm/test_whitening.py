"""Whitening against brute force with fractions."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from entityspark.llm import queries, whitening
from entityspark.llm.textio import table


def brute(vectors, components=8):
    """Exact sums, deviations and covariance in fractions; whitened values by a singular value decomposition of the rows."""
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]
    n, dims = len(x), len(x[0])
    sums = [sum(row[i] for row in x) for i in range(dims)]
    deviation = [sum((n * row[i] - sums[i]) ** 2 for i in range(dims)) for row in x]
    centred = np.array([[float(Fraction(n * row[i] - sums[i], n)) for i in range(dims)] for row in x])
    _, s, rows = np.linalg.svd(centred, full_matrices=False)
    e = s**2 / n
    keep = [k for k in range(min(components, len(e))) if e[k] > 1e-9 * e[0]]
    white = {k: centred @ rows[k] / math.sqrt(e[k]) for k in keep}
    return n, deviation, white, {k: e[k] / e.sum() for k in keep}


def check(found, ids, vectors):
    n, deviation, white, explained = brute(vectors)
    got = {}
    for r in found.collect():
        got.setdefault(r["component"] - 1, {})[r["vec_id"]] = r
    assert sorted(got) == sorted(white)
    for k, rows in got.items():
        assert sorted(rows) == sorted(ids)
        values = np.array([rows[i]["whitened"] for i in ids])
        sign = 1.0 if values @ white[k] > 0 else -1.0
        assert np.abs(values - sign * white[k]).max() < 1e-6
        for i, d in zip(ids, deviation):
            assert int(rows[i]["deviation"]) == d and rows[i]["n"] == n
            assert abs(rows[i]["explained"] / explained[k] - 1) < 1e-6 and rows[i]["identity_error"] < 1e-6


def test_brute_force(spark):
    r = np.random.default_rng(4)
    vectors = (r.normal(size=(300, 12)) @ r.normal(size=(12, 12)) + 40).astype(np.float32).tolist()
    docs = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(5)
    check(whitening.whitened_components(docs), list(range(300)), vectors)


def test_large_entries_stay_exact(spark):
    """Squares beyond 64 bits, far from and near to zero."""
    r = np.random.default_rng(1)
    vectors = (r.normal(size=(40, 3)) * [1e9, 3e11, 5e10] + [0, 1e12, 0]).tolist()
    docs = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(3)
    check(whitening.whitened_components(docs), list(range(40)), vectors)


def test_rows_that_are_dropped(spark):
    good = [[1.0, 2.0], [2.0, -1.0], [0.5, 4.0], [1.0, 2.0]]
    rows = [(i, v) for i, v in enumerate(good)] + [(10, None), (11, [1.0, None]), (12, [float("nan"), 1.0]), (13, [1.0, float("-inf")])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("n", F.lit("clash")).withColumn("v", F.lit(1)).withColumn("id", F.lit(None).cast("string"))
    check(whitening.whitened_components(docs), [0, 1, 2, 3], good)


def test_edges(spark):
    kind = "vec_id long, embedding array<float>"
    for rows in ([], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0]), (2, [1.0])], [(1, None)]):
        assert whitening.whitened_components(spark.createDataFrame(rows, kind)).count() == 0
    line = whitening.whitened_components(spark.createDataFrame([(None, [1.0, 2.0]), (5, [2.0, 4.0]), (5, [4.0, 8.0])], kind)).collect()
    assert [r["component"] for r in line] == [1, 1, 1] and {r["vec_id"] for r in line} == {None, 5}
    for rows in ([(1, [1.0]), (2, [1.0, 2.0])], [(1, [1e30]), (2, [1.0])]):
        with pytest.raises(Exception, match="entries"):
            whitening.whitened_components(spark.createDataFrame(rows, kind)).count()


def test_given_vectors(spark):
    sf = "/root/testdata/sf0.01"
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding").collect()
    found = queries.op13_polarisation_whitening(spark, sf)
    assert dict(found.dtypes)["deviation"] == "bigint"
    check(found, [r["vec_id"] for r in rows], [r["embedding"] for r in rows])
