import numpy as np
import pytest

from stratamill.llm import vector_join as module
from stratamill.llm.vector_join import vector_join

SCHEMA = "vec_id long, embedding array<float>, label int, rep string, key string, n int"


def brute(rows, least):
    n = len(rows)
    unit = []
    for _, v, label in rows:
        x = np.array([np.nan if c is None else c for c in v or []], np.float64)
        good = label is not None and len(x) and np.isfinite(x).all() and x.any()
        unit.append(x / np.linalg.norm(x) if good else None)
    links = [[y for y in range(n) if y != x and unit[x] is not None and unit[y] is not None and rows[x][2] == rows[y][2] and len(unit[x]) == len(unit[y]) and unit[x] @ unit[y] >= least] for x in range(n)]
    label = [r[0] for r in rows]
    changed = True
    while changed:
        changed = False
        for x in range(n):
            best = min([label[x], *(label[y] for y in links[x])], key=order)
            if order(best) < order(label[x]):
                label[x], changed = best, True
    return sorted(((r[0], len(links[x]), label[x], r[0] is not None and label[x] == r[0]) for x, r in enumerate(rows)), key=str)


def order(x):
    return (x is None, x or 0)


def found(spark, rows, **kw):
    frame = spark.createDataFrame([(*r, "x", "y", 3) for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in vector_join(frame, **kw).collect()), key=str)


@pytest.mark.parametrize("block, leaf", [(2048, 64), (8, 3)])
def test_brute_force(spark, block, leaf):
    rng = np.random.default_rng(2)
    rows = []
    for f in range(30):
        base = rng.normal(size=16)
        for _ in range(rng.integers(1, 25)):
            v = base + rng.normal(size=16) * rng.choice([0, 0.05, 0.15, 0.25])
            rows.append(((len(rows) * 37) % 1009, [float(np.float32(x)) for x in v * rng.choice([1, 2])], int(f % 3) if f % 7 else None))
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [None, *[1.0] * 15], 1), (2004, [], 1), (2005, [1.0, 2.0], 1), (2006, [1.0, 2.0], 1), (2007, [float("inf")] * 16, 0)]
    assert found(spark, rows, block=block, leaf=leaf) == brute(rows, 0.98)


def test_shared_and_null_ids(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.0], 1), (3, [0.0, 1.0], 1)]
    assert found(spark, rows) == brute(rows, 0.98) and {r[1] for r in brute(rows, 0.98)} == {1}
    rows = [(None, [1.0, 0.0], 2), (None, [1.0, 0.01], 2), (7, [1.0, 0.02], 2), (None, [3.0, 3.0], 4), (None, [0.0, -1.0], 2)]
    assert found(spark, rows) == brute(rows, 0.98) and found(spark, rows)[0][:2] == (7, 2)


def test_leaves_are_skipped_or_linked_without_comparing():
    rng = np.random.default_rng(5)
    base = np.repeat(rng.normal(size=(40, 32)) * 0.8 ** np.arange(32), 64, axis=0)
    u = base + rng.normal(size=base.shape) * 1e-3
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    eps = float(np.sqrt(0.04)) + module.SLACK
    y = module.turned(u, module.axes(u, module.DIMS))
    order = np.lexsort(np.floor(y / eps).T[::-1])
    sequence, met = module.Sequence(u[order], y[order]), []
    module.join(sequence, sequence, eps, lambda p, q, sure: met.append(sure))
    leaves = len(sequence.starts)
    assert len(met) < leaves * (leaves + 1) / 8 and sum(met) > 10


def test_empty_and_repeated(spark):
    assert vector_join(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, [1.0, 0.0], 1, "", "", 0)] * 2 + [(None, [1.0, 0.0], 1, "", "", 0), (2, None, None, "", "", 0)]
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in vector_join(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [("1", 2, 1, True), ("1", 2, 1, True), ("2", 0, 2, True), ("None", 2, 1, False)]
