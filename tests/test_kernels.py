import itertools

import numpy as np

from stratamill.operators import kernels
from stratamill.operators import landscape as L


def test_a_known_shift_is_found_and_gaps_are_not_bridged(spark):
    curve = lambda t: 70 + 15 * np.sin(t / 4) + 8 * (t > 45) - 12 * (t > 68)
    cells = lambda t, shift: spark.createDataFrame([("k", int(x), *(float(curve(x + shift) + d) for d in (-1, 0, 1))) for x in t], "key string, cell long, a double, b double, c double")
    query, reference = cells(range(20, 75), 6), cells(range(101), 0)
    found = L.landscape(L.offset_costs(query, reference, "key", 1.0), query.select("key").distinct(), "key").first()
    assert abs(found.best - 6) <= 0.5 and found.cells == 55 and not found.at_edge
    few = L.landscape(L.offset_costs(query.limit(3), reference, "key", 1.0), query.select("key").distinct(), "key").first()
    assert (few.best, few.sharpness, few.width, few.cells, few.at_edge) == (None, 0.0, 60.0, 0, 1.0)
    spans = L.spans(cells([0, 1, 3, 20, 21], 0), "key")
    assert sorted((r["from"], r["to"], r["at"]) for r in spans.collect()) == [(0, 0, -1), (0, 1, 0), (1, 3, 1), (1, 3, 2), (20, 21, 20)]


def test_cheapest_path_is_the_least_of_all_paths():
    rng = np.random.default_rng(3)
    unary, moves, start = rng.random((4, 5)), rng.random((4, 2 * kernels.REACH + 1)), rng.random(5)
    total = lambda s, p: start[s] + sum(moves[t, b - a + kernels.REACH] + unary[t, b] for t, (a, b) in enumerate(zip((s, *p), p)))
    want = min((total(s, p), p) for s in range(5) for p in itertools.product(range(5), repeat=4))
    path, cost = kernels.cheapest_path(unary, moves, start)
    assert np.isclose(cost, want[0]) and tuple(path) == want[1]


def test_loop_angle_turns_with_the_mirror_and_not_with_the_frame():
    rng = np.random.default_rng(4)
    loop = rng.normal(size=(7, 3))
    angle = kernels.loop_angle(loop)
    turned = loop @ np.linalg.qr(rng.normal(size=(3, 3)))[0]
    wrap = lambda x: (x + np.pi) % (2 * np.pi) - np.pi
    assert min(abs(wrap(kernels.loop_angle(turned) - s * angle)) for s in (1, -1)) < 1e-9 and abs(angle) > 1e-3
    flat = np.array([[0, 0, 0], [2, 0, 0], [2, 1, 0], [0, 1, 0.0]])
    assert abs(wrap(kernels.loop_angle(flat))) < 1e-9
    assert np.isnan(kernels.loop_angle(flat[[0, 0, 1, 2]]))
