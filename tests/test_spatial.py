import math
import random

import duckdb
import pytest

from stratamill.operators import spatial
from stratamill.plans.spatial import CLASS_RADIUS, ORACLE_SQL, o6_equality_classes


def linked(rows, r):
    """Every pair by the text of the SQL, and a search from each id."""
    found = {i: {i} for i, *_ in rows if i is not None}
    for i, x, y in rows:
        for j, u, v in rows:
            if None not in (i, j, x, y, u, v) and i != j and (x - u) * (x - u) + (y - v) * (y - v) <= r * r:
                found[i].add(j)
    out = {None: None} if any(i is None for i, *_ in rows) else {}
    for i in sorted(found):
        todo = [] if i in out else [i]
        while todo:
            if (j := todo.pop()) not in out:
                out[j] = i
                todo += found[j]
    return out


def shapes():
    rnd = random.Random(5)
    spread = [(rnd.uniform(-4, 4), rnd.uniform(-4, 4)) for _ in range(150)]
    arc = lambda radius, x, n: [(x + radius * math.cos(t), radius * math.sin(t)) for t in (i / n - 0.5 for i in range(n))]
    yield "spread, with copies", spread + spread[:40] * 3, 0.6
    yield "on the grid's lines, at just the radius", [(i * 0.25, j * 0.25) for i in range(-5, 6) for j in range(-5, 6) if (i * j) % 3], 0.25
    # many points on both sides of a gap that follows a curve: no box tells whether it is wider than the radius
    for name, width in (("gap", 1 + 1e-6), ("no gap", 1 - 1e-6)):
        yield name, arc(3, 0, 60) + arc(3 + width, 0, 61), 1.0
    yield "dense halves", [(x + d, y) for x, y in ((rnd.random() * 0.3, rnd.random() * 0.3) for _ in range(60)) for d in (0, 1.25)], 1.0


@pytest.mark.parametrize("name, places, r", list(shapes()), ids=lambda x: x if isinstance(x, str) else "")
def test_classes_of_shapes(spark, name, places, r):
    ids = random.Random(6).sample(range(1000), len(places))
    rows = [(i, x, y) for i, (x, y) in zip(ids, places)]
    got = spatial.classes(spark.createDataFrame(rows, "id long, x double, y double"), r).collect()
    assert len(got) == len(rows) and dict(map(tuple, got)) == linked(rows, r)


def test_equality_classes_of_odd_vectors(spark, tmp_path):
    """No place, places out of range, no id, and an id that stands for two places: a row for each id, as in the SQL."""
    nan, r = math.nan, CLASS_RADIUS
    rows = [(1, None), (2, [None, 0.5]), (3, [nan, 0.5]), (4, [nan, 0.5]), (5, [math.inf, 0.0]), (6, [math.inf, 0.0]), (7, [1e30, 0.5]), (8, [1e30, 0.5]), (9, [-1e30, 0.5])]
    rows += [(None, [0.5, 0.5]), (None, [0.5, 0.5]), (12, [0.5, 0.5]), (11, [0.5, 0.5 + r / 2]), (20, [-0.5, 0.0]), (21, [-0.5, r / 2]), (20, [-0.5, 0.25]), (30, [-0.5, 0.25 + r / 2]), (20, None), (40, [0.0, 0.0]), (40, [0.0, 0.0]), (41, [-1e-30, 0.0])]
    spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [tuple(x) for x in o6_equality_classes(spark, str(tmp_path)).collect()]
    alone = {i: i for i in (1, 2, 3, 4, 5, 6, 9)}
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    by_id = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r))
    assert by_id(got) == by_id(db.sql(ORACLE_SQL["o6_equality_classes"]).fetchall())
    assert dict(got) == alone | {7: 7, 8: 7, None: None, 11: 11, 12: 11, 20: 20, 21: 20, 30: 20, 40: 40, 41: 40}


def test_copies_make_no_pairs(spark, tmp_path):
    """Twenty places with 20,000 vectors each: four billion pairs of copies."""
    vectors = spark.range(400_000).selectExpr("id AS vec_id", "array(cast(id % 20 AS float) / 100, 0.0F) AS embedding", "0 AS label")
    vectors.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = o6_equality_classes(spark, str(tmp_path))
    assert got.count() == 400_000 and got.filter("component <> vec_id % 20").isEmpty()


def test_rounds_hand_nothing_on(spark):
    """What the planner knows of the columns doubled with every few rounds, on a long chain until the driver was full."""
    nodes = spark.range(3000)
    found = spatial.components(nodes, nodes.filter("id < 2999").selectExpr("id AS a", "id + 1 AS b"))
    assert "LogicalRDD" not in found._jdf.queryExecution().analyzed().toString()
    assert found.filter("component <> 0").isEmpty()
