import numpy as np

from stratalog.config import AnomalyConfig
from stratalog.operators import forest, scoring


def data(n, p=6, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.poisson(8, (n, p)).astype(float)
    x[3], x[7, 0] = 60, 90
    return x


def counts_of(spark, x):
    rows = [(w, f"t{j}", float(v)) for w, row in enumerate(x) for j, v in enumerate(row) if v]
    return spark.createDataFrame(rows, "Window int, EventTemplate string, cnt double").repartition(3)


def plain_depth(row, tree, at=0):
    feature, cut, left, right, depth = (c[at] for c in tree)
    if feature < 0:
        return depth
    return plain_depth(row, tree, left if row[feature] <= cut else right)


def test_against_a_recursive_walk(spark):
    x = data(300)
    counts = counts_of(spark, x)
    got = {r.Window: r for r in scoring.detect(counts, AnomalyConfig(algorithm="isolation_forest")).collect()}
    dictionary = {r.feature: r.feature_id for r in scoring._dictionary(counts)[0].collect()}
    dense = np.zeros_like(x)
    for j in range(x.shape[1]):
        dense[:, dictionary[f"t{j}"]] = x[:, j]
    vectors = scoring._vectors(counts.selectExpr("Window", "EventTemplate AS feature", "cnt AS value"), scoring._dictionary(counts)[0])
    trees = forest.fit_forest(vectors, 300)
    assert len(trees) == forest.TREES and all(len(t[0]) <= 2 * forest.SAMPLE for t in trees)
    want = [2 ** -(np.mean([plain_depth(row, t) for t in trees]) / forest.expected_depth(256)) for row in dense]
    assert np.allclose([got[w].AnomalyScore for w in range(300)], want)
    assert set(sorted(got, key=lambda w: -got[w].AnomalyScore)[:2]) == {3, 7}
    limit = np.quantile(want, 0.9)
    assert [got[w].IsAnomaly for w in range(300)] == [s > limit for s in want] and sum(r.IsAnomaly for r in got.values()) == 30


def test_samples_are_bounded_and_fixed(spark):
    vectors = spark.range(5000).selectExpr("CAST(id AS INT) AS Window", "array(0) AS ids", "array(CAST(id % 9 AS DOUBLE)) AS values")
    sizes = forest.samples(vectors, 5000, 1).groupBy("tree").count().collect()
    assert len(sizes) == forest.TREES and all(r["count"] == forest.SAMPLE for r in sizes)
    one, two = (sorted(map(tuple, forest.samples(v, 5000, 1).selectExpr("tree", "values[0]").collect())) for v in (vectors, vectors.repartition(7)))
    assert one == two


def test_few_windows(spark):
    for n in (0, 1, 2):
        rows = [(w, "a", 1.0 + w) for w in range(n)]
        got = scoring.detect(spark.createDataFrame(rows, "Window int, EventTemplate string, cnt double"), AnomalyConfig(algorithm="isolation_forest")).collect()
        assert len(got) == n and all(0 <= r.AnomalyScore <= 1 for r in got)
