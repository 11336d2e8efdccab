import random
import re
from collections import Counter

import numpy as np
import pytest

from stratamill.llm import ngram_join as module
from stratamill.llm.common import components
from stratamill.llm.ngram_join import forest, may_link, ngram_join, overlaps, parity


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    label = [i for i, _ in sets]
    links = [[100 * len(a & b) >= percent * len(a | b) and bool(a) for _, b in sets] for _, a in sets]
    changed = True
    while changed:
        changed = False
        for x in range(len(sets)):
            best = min((label[y] for y in range(len(sets)) if links[x][y] and label[y] is not None), default=label[x])
            if label[x] is None and best is not None or label[x] is not None and best is not None and best < label[x]:
                label[x], changed = best, True
    return Counter((i, len(s), c) for (i, s), c in zip(sets, label))


@pytest.mark.parametrize("pairs, block", [(12, 1_000_000), (2, 4_000)])
def test_brute_force(docs, odd, monkeypatch, pairs, block):
    monkeypatch.setattr(module, "PAIRS", pairs)
    monkeypatch.setattr(module, "BLOCK", block)
    rnd = random.Random(5)
    rows = []
    for f in range(14):
        base = [f"w{rnd.randint(0, 60)}" for _ in range(rnd.choice([2, 5, 30, 90, 300]))]
        for _ in range(rnd.randint(1, 18)):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 50))):
                w[rnd.randrange(len(w))] = f"W{rnd.randint(0, 500)}"
            rows.append((len(rows) * 7 % 1009, " ".join(w).upper() if rnd.random() < 0.2 else "  ".join(w), "en", "s"))
    rows += [(5000 + i, "one two three four five six seven eight", "en", "s") for i in range(30)] + [rows[3], (None, rows[4][1], "en", "s")]
    long = [f"v{i}" for i in range(60)]
    rows += [(i, " ".join([*long, *w]), "en", "s") for i, w in ((None, ["x"]), (None, ["y"]), (7001, ["z"]), (7002, long), (7002, ["z", "a"]), (7003, [*long, "b"]))]
    got = Counter(tuple(r) for r in ngram_join(docs(rows)).collect())
    assert got == brute([r[:2] for r in rows], 4, 85)
    if pairs == 12:
        assert Counter(tuple(r) for r in ngram_join(odd).collect()) == brute([(r.doc_id, r.text) for r in odd.collect()], 4, 85)
        assert ngram_join(docs([])).count() == 0


def test_overlaps_and_forest():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 50)).astype(np.uint64)) for _ in range(40)]
    got = overlaps(sets)
    assert all(got[i, j] == len(set(a) & set(b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)
    linked = np.zeros((6, 6), bool)
    linked[[0, 2, 2, 5], [2, 0, 5, 2]] = True
    assert sorted(forest(linked)) == [(0, 2), (2, 5)]


def test_bitmaps_lose_no_link():
    rng = np.random.default_rng(2)
    sets = []
    for n in (1, 3, 60, 64, 70, 120, 135, 900):
        base = rng.integers(0, 1 << 63, n, np.uint64)
        sets += [np.unique(np.append(base[rng.random(n) > drop], rng.integers(0, 1 << 63, n // 20, np.uint64))) for drop in (0, 0.05, 0.1, 0.4)]
    sets = sorted((s for s in sets if len(s)), key=len)
    n = np.array([len(s) for s in sets])
    may = may_link(n, [parity(s) for s in sets], 85)
    common = overlaps(sets)
    linked = 100 * common >= 85 * (n[:, None] + n[None, :] - common)
    np.fill_diagonal(linked, False)
    assert not (linked & ~may).any() and linked.sum() <= may.sum() < 3 * linked.sum()


def test_components_of_a_long_chain(spark):
    edges = spark.range(40).selectExpr("(id * 17) % 41 AS a", "((id + 1) * 17) % 41 AS b")
    assert {tuple(r) for r in components(edges).collect()} == {(i, 0) for i in range(41)}
