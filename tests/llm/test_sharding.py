import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from stratamill.llm.sharding import jump, shard


def one(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=20), st.integers(1, 300))
def test_jump_is_the_published_loop(keys, n):
    got, more = jump(np.array(keys, np.uint64), n), jump(np.array(keys, np.uint64), n + 1)
    assert list(got) == [one(k, n) for k in keys]
    assert all(a == b or b == n for a, b in zip(got, more))


def test_slots_and_sizes(odd, docs):
    rows = shard(odd, 4).collect()
    texts = defaultdict(list)
    for r in odd.collect():
        texts[r.doc_id].append((r.text or "").encode())
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert (r.size, r.text_crc32) in [(len(t) + 16, zlib.crc32(t)) for t in texts[r.doc_id]] and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(rows) == odd.count()
    assert shard(docs([]), 4).count() == 0
