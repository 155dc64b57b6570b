"""Grid summaries and clustering against NumPy and by invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions.columns import floor_div, ordinal, uniform
from cairn.operators import grid, kmeans, sweep


def points(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>")


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(0)
    return np.concatenate([rng.normal(c, 0.3, (80, 2)) for c in ((0, 0), (5, 5), (0, 6))])


def test_smallest_resolution():
    assert [grid.smallest_resolution(d, k) for d, k in ((1, 3), (2, 3), (2, 9), (2, 4), (8, 9), (3, 27), (3, 1))] == [4, 2, 4, 2, 2, 4, 1]


def test_floor_division_as_floats_divide(spark):
    rows = spark.createDataFrame([(1.0, 0.1), (0.3, 0.1), (7.0, 2.0), (0.0, 0.7)], "a double, b double")
    assert [r.q for r in rows.select(floor_div(F.col("a"), F.col("b")).alias("q")).collect()] == [a // b for a, b in ((1.0, 0.1), (0.3, 0.1), (7.0, 2.0), (0.0, 0.7))]


def test_grid_is_numpy(spark, cloud):
    df = points(spark, cloud)
    lo, hi = grid.bounds(df, 2)
    assert np.allclose([lo, hi], [cloud.min(0), cloud.max(0)])
    m = 8
    cell = np.minimum((cloud - lo) // ((np.array(hi) - lo) / m), m - 1).astype(int)
    got = {tuple(r.cell): (r.rep, r.card) for r in grid.representatives(df, m, lo, hi).collect()}
    keys = np.unique(cell, axis=0)
    assert set(got) == set(map(tuple, keys.tolist())) and sum(c for _, c in got.values()) == len(cloud)
    for k in keys:
        own = cloud[(cell == k).all(1)]
        assert np.allclose(got[tuple(k)][0], own.mean(0)) and got[tuple(k)][1] == len(own)
    heavy, single = grid.split(grid.representatives(df, m, lo, hi))
    assert heavy.count() + single.count() == len(got)


def test_constant_dimension_has_one_cell(spark):
    df = points(spark, [[1, 2], [3, 2], [5, 2]])
    assert {tuple(r.cell) for r in grid.representatives(df, 2, *grid.bounds(df, 2)).collect()} == {(0, 0), (1, 0)}


def test_fine_grids_of_many_dimensions_dont_collide(spark):
    x = np.random.default_rng(1).random((200, 8))
    df = points(spark, x)
    assert grid.representatives(df, 1 << 20, *grid.bounds(df, 8)).count() == 200


def test_nearest_center_ties_go_to_the_lowest(spark):
    got = kmeans.assign(points(spark, [[0, 0], [1, 0], [2, 0]]), [[0, 0], [2, 0], [0, 0]]).orderBy("id").collect()
    assert [(r.label, r.d2) for r in got] == [(0, 0.0), (0, 1.0), (1, 0.0)]


def test_empty_cluster_keeps_its_center(spark):
    df = points(spark, [[0, 0], [1, 1]])
    c = [[0.0, 0.0], [100.0, 100.0]]
    assert kmeans.updated(kmeans.assign(df, c), c) == [[0.5, 0.5], [100.0, 100.0]]


def test_metrics(spark, cloud):
    df, c = points(spark, cloud), [[0.0, 0.0], [5.0, 5.0]]
    d = ((cloud[:, None] - np.array(c)) ** 2).sum(2)
    assert kmeans.inertia(df, c, "features") == round(d.min(1).sum())
    assert kmeans.error(kmeans.assign(df, c), c) == pytest.approx(np.sqrt(d.min(1)).sum())
    assert kmeans.shift([[0.0, 0.0]], [[3.0, 4.0]]) == 25.0


def test_lloyd_is_numpy(spark, cloud):
    c = np.array([[0.0, 1.0], [4.0, 4.0], [1.0, 5.0]])
    got, *_ = kmeans.lloyd(points(spark, cloud), c.tolist(), 4, 0.0)
    for _ in range(4):
        label = ((cloud[:, None] - c) ** 2).sum(2).argmin(1)
        c = np.array([cloud[label == k].mean(0) for k in range(3)])
    assert np.allclose(got, c)


def test_fit(spark, cloud):
    df = points(spark, cloud)
    f = kmeans.fit(df, 3, 5, 50, 1)
    labels = f.labels.collect()
    assert len(labels) == len(cloud) and {r.label for r in labels} <= {0, 1, 2} and f.n_part >= 1 and f.partitions >= 3 and f.distances > 0
    again = kmeans.fit(df.repartition(7), 3, 5, 50, 1)
    assert np.allclose(f.centers, again.centers) and f.predict(df).count() == len(cloud)
    assert f.metrics(spark).first().error == pytest.approx(f.error)
    full, _ = kmeans.seeded(df, f.centers, 20)
    assert kmeans.error(kmeans.assign(df, full), full) <= f.error * 1.05


@pytest.mark.parametrize("bad", [{"clusters": 0}, {"max_part": 0}, {"max_iter": 0}, {"seed": -1}, {"tol": -1.0}, {"verbose": 2}, {"clusters": 99}])
def test_parameters_are_checked(spark, bad):
    with pytest.raises(ValueError):
        kmeans.fit(points(spark, [[0, 0], [1, 1], [2, 2]]), **({"clusters": 2} | bad))


def test_points_that_no_grid_splits_raise(spark):
    with pytest.raises(ValueError):
        kmeans.fit(points(spark, [[1.0, 1.0]] * 5), 2)
    with pytest.raises(ValueError):
        kmeans.fit(points(spark, [[0.0], [1.0], [1.0], [1.0]]), 3)


def test_baselines_and_sweep(spark, cloud):
    df = points(spark, cloud)
    c, n = kmeans.plus_plus(df, 3, 1, 20)
    assert len(c) == 3 and n >= 1
    c, n = kmeans.mini_batch(df, 3, 60, 8)
    assert len(c) == 3 and 1 <= n <= 8
    assert sweep.relative_error(9.0, 10.0) == pytest.approx(0.1) and sweep.full_cost(2, 3, 10) == 60 and sweep.batch_cost(2, 3, 100) == 600
    facts = sweep.sweep(lambda n, d, k, rep: sweep.blobs(spark, n, k, d, rep), [3], [1, 2], [60], 1, 1, (), max_iter=3)
    assert facts.where("status <> 'ok'").count() <= 1 and sweep.means(facts).count() >= 2


def test_blobs_and_subsets_are_the_same_in_every_partitioning(spark):
    a, b = sweep.blobs(spark, 200, 3, 2, 4), sweep.blobs(spark, 200, 3, 2, 4).repartition(9)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert sorted(map(str, sweep.subset(a, [1], 20, 1).collect())) == sorted(map(str, sweep.subset(b, [1], 20, 1).collect()))


def test_helpers(spark):
    df = spark.range(500).select((F.col("id") * 37 % 501).alias("x")).repartition(6)
    got = ordinal(df, "x").orderBy("x").collect()
    assert [r.idx for r in got] == list(range(500))
    u = [r.u for r in spark.range(2000).select(uniform("id", seed=1).alias("u")).collect()]
    assert 0 < min(u) and max(u) < 1 and abs(np.mean(u) - 0.5) < 0.03
