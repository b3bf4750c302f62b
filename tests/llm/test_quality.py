import numpy as np

from tabaudit.llm import quality

DATA = "/root/testdata/sf0.01"


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality_scores(docs, labels)
    held = rows.filter("held_out").join(labels, "doc_id").collect()
    assert rows.count() == 1000 and len(held) > 50
    assert sum(r.predicted == r.quality for r in held) >= 0.93 * len(held)
    good, bad = ([r.score for r in held if r.quality == q] for q in (1, 0))
    assert np.mean(np.subtract.outer(good, bad) > 0) > 0.95


def test_isotonic():
    good, total = np.array([0.0, 3, 1, 0, 9, 0]), np.array([4.0, 4, 4, 0, 10, 0])
    levels = quality.isotonic(good, total)
    assert np.allclose(levels[[0, 1, 2, 4, 5]], [0, 0.5, 0.5, 0.9, 0.9]) and (np.diff(levels) >= 0).all()
    assert np.allclose(quality.isotonic(np.zeros(3), np.zeros(3)), 0.5)


def test_normal_equations_are_the_direct_fit(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(300, len(quality.STATISTICS)))
    y = (x[:, 0] > 0).astype(float)
    known = spark.createDataFrame([(r.tolist(), float(q)) for r, q in zip(x, y, strict=True)], "statistics array<float>, quality double")
    model = quality.train(known.repartition(5))
    z = model.features(x.astype(np.float32).astype(float))
    direct = np.linalg.solve(z.T @ z + quality.RIDGE * np.eye(z.shape[1]), z.T @ y)
    assert np.allclose(model.weights, direct, atol=1e-6)


def test_waves_approximate_the_kernel():
    model = quality.Model(np.zeros(len(quality.STATISTICS)), np.ones(len(quality.STATISTICS)))
    x = np.random.default_rng(4).normal(size=(30, len(quality.STATISTICS)))
    waves = model.features(x)[:, 1 + x.shape[1] :]
    apart = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert np.abs(waves @ waves.T - np.exp(-apart / (2 * quality.WIDTH**2))).max() < 0.35


def test_edges(edges, no_documents, spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (None, 0), (99, 1), (5, None)], "doc_id long, quality int")
    rows = quality.quality_scores(edges, labels).collect()
    assert len(rows) == edges.count() and all(0 <= r.score <= 1 for r in rows)
    none = quality.quality_scores(edges, labels.filter("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.quality_scores(no_documents, labels).count() == 0
