import hashlib
import random
import re
from collections import Counter

import numpy as np

from stratamill.llm import words as W
from stratamill.llm.substring_dedup import LEVELS, depths, kept_texts, ordering, substring_dedup


def brute(rows, k):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for p in range(len(w) - k + 1):
            if i is not None:
                key = tuple(w[p : p + k])
                first[key] = min(i, first.get(key, i))
    out = Counter()
    for i, w in words:
        gone = set()
        for p in range(len(w) - k + 1):
            if i is not None and first[tuple(w[p : p + k])] < i:
                gone |= set(range(p, p + k))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out[(i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


def test_brute_force(docs, odd, spark):
    rnd = random.Random(3)
    word = lambda: rnd.choice(["a", "bb", "é", "D", "x1", "zz.", "no", "the"])
    passages = [[word() for _ in range(rnd.randint(10, 40))] for _ in range(12)]
    rows = []
    for i in range(250):
        w = []
        for _ in range(rnd.randint(0, 4)):
            w += rnd.choice(passages) if rnd.random() < 0.5 else [f"u{rnd.random()}" if rnd.random() < 0.3 else word() for _ in range(rnd.randint(0, 30))]
        rows.append((i if i % 50 else None, rnd.choice([" ", "  ", "\n"]).join(w) if i % 40 else None, "en", "s"))
    rows += [(1000 + i, rows[7][1], "en", "s") for i in range(40)] + [(2000 + i, "same word " * 30, "en", "s") for i in range(60)] + [rows[9]]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        for coalesce in ("true", "false"):
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
            got = Counter(tuple(r) for r in substring_dedup(docs(rows), 13, support=0.05).collect())
            assert got == brute([r[:2] for r in rows], 13)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    odd_rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert Counter(tuple(r) for r in substring_dedup(odd, 13).collect()) == brute(odd_rows, 13)
    assert Counter(tuple(r) for r in substring_dedup(odd, 2).collect()) == brute(odd_rows, 2)
    assert substring_dedup(docs([])).count() == 0


def test_rows_that_share_an_id_and_have_different_words(docs):
    t1 = " ".join(f"w{i}" for i in range(40))
    t2 = " ".join([*(f"w{i}" for i in range(5, 25)), *(f"v{i}" for i in range(30))])
    rows = [(1, t1, "en", "s"), (2, t1, "en", "s"), (2, t2, "en", "s"), (3, t2, "en", "s"), (3, t1, "en", "s"), (4, t2, "en", "s")]
    for support in (1e-3, 0.9):
        got = Counter(tuple(r) for r in substring_dedup(docs(rows), 13, support=support).collect())
        assert got == brute([r[:2] for r in rows], 13) and sorted(x[2] for x in got if x[0] == 2) == [20, 40]


def test_depths_are_those_of_a_suffix_tree():
    rnd = random.Random(5)
    texts = [[rnd.choice("abc") for _ in range(60)] for _ in range(5)]
    for window in (2, 5, 12, 13, 20):
        text = " ".join(w for t in texts for w in t).encode()
        h, _, _, bounds = W.words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        path, ok = W.grams(h, bounds, window)
        at = np.flatnonzero(ok)
        columns = ordering(h, at, window)
        order = np.lexsort((path[at], *(c.view(np.int64) for c in reversed(columns))))
        got = depths([c[order].view(np.int64) for c in columns], path[at][order].view(np.int64), window)
        words = text.decode().split()
        suffixes = [words[a : a + window] for a in at[order]]
        shared = [0] + [next((i for i in range(window) if x[i] != y[i]), window) for x, y in zip(suffixes, suffixes[1:])]
        assert got.tolist() == [d if d == window else min(d, LEVELS, window - 1) for d in shared]
        # equal suffixes stand together, as below one node
        nodes = [tuple(s) for s, d in zip(suffixes, got) if d < window]
        assert len(nodes) == len(set(nodes)) == len({tuple(s) for s in suffixes})


def test_spans_are_the_runs_that_go(docs):
    passage = [f"w{i}" for i in range(30)]
    rows = [(1, " ".join(["a", *passage]), "en", "s"), (2, " ".join(["b", "c", *passage, "d", *passage[:13]]), "en", "s"), (3, "no repeat of any other text here", "en", "s")]
    found = kept_texts(docs(rows)).collect()
    assert [(r.doc_id, r.kept, [(s.start, s.length) for s in r.spans]) for r in found] == [(2, "b c d", [(2, 30), (33, 13)])]
