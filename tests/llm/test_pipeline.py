import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from stratamill.llm import language_id
from stratamill.llm.common import materialize, table
from stratamill.llm.packing import Encoder
from stratamill.llm.queries import word_tokenizer
from tests.llm.test_curriculum import filled
from tests.llm.test_ngram_join import brute
from tests.llm.test_packing import best_fit, check

SF = "/root/testdata/sf0.001"


def test_each_stage_against_plain_code(spark):
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, [docs.collect()]
    for _, stage in pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF))
        assert docs.columns == columns
        seen.append(docs.collect())
    raw, known, exact, near, mix = seen
    labelled = {r.doc_id: r for r in language_id.identify(table(spark, SF, "documents")).collect()}
    assert sorted(r.doc_id for r in known) == sorted(r.doc_id for r in raw if labelled[r.doc_id].lang_pred != "und" and not labelled[r.doc_id].ambiguous)
    assert len(known) >= len([r for r in raw if r.text and any(c.isalpha() for c in r.text)]) * 0.99
    first = {}
    for r in sorted(known, key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text), r.doc_id)
    assert sorted(r.doc_id for r in exact) == sorted(first.values())
    assert sorted(r.doc_id for r in near) == sorted(i for i, _, c in brute([(r.doc_id, r.text) for r in exact], 5, 80) if i == c)
    assert {r.doc_id for r in mix} <= {r.doc_id for r in near}
    words = lambda rows: sum(len(r.text.split()) for r in rows)
    sizes, taken, whole = Counter(), Counter(), {r.doc_id: " ".join(r.text.split()) for r in near}
    for r in near:
        sizes[r.source] += len(r.text.split())
    for r in mix:
        taken[r.source] += len(r.text.split())
        assert whole[r.doc_id].startswith(" ".join(r.text.split()))
    want = filled(sizes)
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in sizes) and abs(words(mix) / words(near) - 1.5) < 1e-3
    packed = pipeline.STAGES[-1][1](spark, docs, SF).collect()
    lengths = sorted(len(ids) for ids in (Encoder.of(word_tokenizer()).tokenizer.encode(r.text, add_special_tokens=False).ids + [0] for r in mix))
    assert sorted(r.length for r in packed if r.length < 2048 or r.piece) == sorted(x for n in lengths for x in ([2048] * (n // 2048) + [n % 2048] * (n % 2048 > 0))[0 if n < 2048 else 1:])
    assert check(packed, 2048) == best_fit([r.length for r in packed], 2048)


def test_odd_rows(spark, odd):
    clash = "_row size lang_pred score ambiguous _letters _position _sha256 _id _words _n _h _c target taken key row label".split()
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars", *(F.lit("x").alias(c) for c in clash))
    for k, (_, stage) in enumerate(pipeline.STAGES):
        before = docs.columns
        docs = materialize(stage(spark, docs, SF))
        assert k == 4 or docs.columns == before and {tuple(r)[5:] for r in docs.collect()} == {("x",) * len(clash)}
    ids = {r.doc_id for r in docs.collect()}
    assert 1 in ids and not ids & {2, 3, 4, 5, 8}


def test_near_copies_are_linked_by_five_words(spark, docs):
    words = [f"w{i}" for i in range(100)]
    changed = [f"x{i}" if i in (30, 70) else w for i, w in enumerate(words)]
    rows = [(1, " ".join(words), "en", "s"), (2, " ".join(changed), "en", "s"), (3, "another text of six words", "en", "s")]
    want = sorted(i for i, _, c in brute([r[:2] for r in rows], 5, 80) if i == c)
    assert want == [1, 3] and len([i for i, _, c in brute([r[:2] for r in rows], 4, 85) if i == c]) == 3
    assert sorted(r.doc_id for r in pipeline.one_of_near(spark, docs(rows), SF).collect()) == want


def test_different_texts_under_one_id_stay(spark, docs):
    words = [f"w{i}" for i in range(100)]
    rows = [(None, "one text of five words", "en", "s"), (None, "quite another text than that", "en", "s"), (4, "the first text of four", "en", "s"), (4, "and a second text of it", "en", "s")]
    rows += [(None, " ".join(words), "en", "s"), (7, " ".join([*words, "end"]), "en", "s"), (9, " ".join(words[1:]), "en", "s"), (8, "same row", "en", "s"), (8, "same row", "en", "s")]
    got = sorted((r.doc_id or 0, r.text) for r in pipeline.one_of_near(spark, docs(rows), SF).collect())
    assert got == sorted([(i or 0, t) for i, t, *_ in rows[:4]] + [(7, rows[5][1]), (8, "same row")])
