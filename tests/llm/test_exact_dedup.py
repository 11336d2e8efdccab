import hashlib
import re
from collections import Counter

from stratamill.llm.exact_dedup import exact_dedup


def test_odd_rows(odd):
    got = [r.asDict() for r in exact_dedup(odd).collect()]
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    digest = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
    assert Counter((r["doc_id"], r["text_sha256"]) for r in got) == Counter((i, digest(t)) for i, t in rows)
    for r in got:
        same = [i for i, t in rows if digest(t) == r["text_sha256"]]
        assert r["group_size"] == len(same) and r["keep_id"] == min((i for i in same if i is not None), default=None)
    assert all(n == 1 for n in Counter(r["text_sha256"] for r in got if r["kept"]).values())
    assert {r["text_sha256"] for r in got if r["kept"]} == {r["text_sha256"] for r in got}


def test_a_group_of_most_rows_and_an_empty_table(docs):
    got = exact_dedup(docs([(i, "hot" if i % 3 else f"cold {i // 2}", "en", "s") for i in range(600)]), support=0.01).collect()
    hot = [r for r in got if r.group_size == 400]
    assert len(got) == 600 and len(hot) == 400 and {r.keep_id for r in hot} == {1} and [r.doc_id for r in hot if r.kept] == [1]
    assert exact_dedup(docs([])).count() == 0
