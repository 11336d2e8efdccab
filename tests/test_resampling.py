import math
import random

import numpy as np

from stratamill.operators import spatial
from stratamill.plans.fits import cluster_bootstrap, group_folds


def test_bootstrap_draws_clusters_with_all_their_repeats(spark):
    rnd = random.Random(3)
    rows = [(c, r, rnd.randint(1, 9), rnd.random() * 9, rnd.random() * 9) for c in "abcde" for r in (0, 1)]
    rows += [("a", 0, 2, 1.0, 0.5)]
    got = [r["gain"] for r in cluster_bootstrap(spark.createDataFrame(rows, "cluster string, repeat int, n long, base_sse double, cand_sse double"), 50, 7).orderBy("draw").collect()]
    want = []
    for picked in np.random.default_rng(7).integers(0, 5, (50, 5)):
        gains = []
        for repeat in (0, 1):
            drawn = [x for p in picked for x in rows if x[0] == "abcde"[p] and x[1] == repeat]
            n, base, cand = (sum(x[i] for x in drawn) for i in (2, 3, 4))
            gains.append(math.sqrt(base / n) - math.sqrt(cand / n))
        want.append(sum(gains) / 2)
    assert np.allclose(got, want)


def test_nearest_and_components(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.gauss(0, 1), rnd.choice([0.0, 50.0])) for i in range(120)] + [(500, 0.0, -300.0), (501, None, 1.0)]
    points = spark.createDataFrame(rows, "id long, x double, y double")
    got = {(r["a"], r["rank"]): r["b"] for r in spatial.nearest(points, points, 0.02, 2).collect()}
    whole = [r for r in rows if r[1] is not None]
    for i, x, y in whole:
        order = sorted((((x - u) * (x - u) + (y - v) * (y - v)), j) for j, u, v in whole if j != i)
        assert [got[i, 1], got[i, 2]] == [j for _, j in order[:2]]
    edges = spark.createDataFrame([(i, i + 3) for i in range(0, 60)] + [(70, 71)], "a long, b long")
    found = {r["id"]: r["component"] for r in spatial.components(points.select("id"), edges).collect()}
    assert all(found[i] == i % 3 for i in range(63)) and found[71] == 70 and found[500] == 500


def test_group_folds_are_balanced_and_keep_groups_whole(spark):
    rows = spark.createDataFrame([(g,) for g, n in (("a", 9), ("b", 5), ("c", 4), ("d", 3), (None, 3)) for _ in range(n)], "g string")
    assert {r["g"]: (r["size"], r["fold"]) for r in group_folds(rows, "g", 2).collect()} == {"a": (9, 0), "b": (5, 1), "c": (4, 1), "d": (3, 0), None: (3, 1)}
