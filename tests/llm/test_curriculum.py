from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratamill.llm.curriculum import curriculum, when_reached


def filled(sizes, weights=(5, 2, 1), total=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), total * sum(sizes.values())
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            out |= share
            break
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


def check(frame):
    rows = curriculum(frame).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size and all(0 <= t.position <= 1 for t in r.takes) and sum(t.words for t in r.takes) == r.taken
    want = filled(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in sizes)
    return rows


def test_targets_and_words_taken(odd, docs):
    assert len(check(odd)) == odd.count()
    many = docs([(i, "w " * (i % 37), "en", "hot" if i % 3 else f"s{i % 8}") for i in range(900)])
    first = check(many)
    assert sorted(map(str, first)) == sorted(map(str, curriculum(many.repartition(7)).collect()))
    at = [r.position for r in first if r.position is not None]
    assert at == sorted(at)
    assert curriculum(docs([])).count() == 0


def test_the_schedule_is_inverted(spark):
    knots = ((0.0, 0.5), (0.5, 0.75), (1.0, 1.75))
    got = [r[0] for r in spark.range(101).select(when_reached(F.col("id") / 100, knots)).collect()]
    t = np.linspace(0, 1, 200001)
    w = np.interp(t, *zip(*knots))
    area = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
    assert np.allclose(got, np.interp(np.arange(101) / 100, area / area[-1], t), atol=1e-4)
