import zlib

import numpy as np
import pyarrow as pa

from stratamill.llm.common import table
from stratamill.llm.language_id import codewords, features, fit, identify, predict


def test_codewords_are_far_apart():
    for k in (1, 2, 4, 5, 12, 40):
        c = codewords(k).astype(int)
        far = (c[:, None] != c[None]).sum(axis=2) + 10**6 * np.eye(k, dtype=int)
        assert k == 1 or far.min() >= max(1, c.shape[1] // 4)


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = identify(docs).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95


def test_odd_rows(odd, docs):
    rows = {(r.doc_id, r.lang_pred) for r in identify(odd).collect()}
    assert {(3, "und"), (4, "und"), (5, "und")} <= rows and (1, "und") not in rows
    assert identify(docs([])).count() == 0
    assert {r.lang_pred for r in identify(docs([(1, "abc", None, "s")])).collect()} == {"und"}
    assert {r.lang_pred for r in identify(docs([(i, "abc def", "xx", "s") for i in range(20)])).collect()} == {"xx"}


def test_decoding_is_that_of_plain_losses(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    model = fit(docs)
    texts = [r.text for r in docs.filter("text IS NOT NULL").limit(40).collect()]
    x = np.concatenate([v for _, _, v in features(pa.array(texts, pa.string()))])
    best, share, lead = model.decode(x)
    for i, v in enumerate(x):
        margins = v @ model.weights + model.bias
        like = np.array([np.exp(-sum(np.log1p(np.exp(-float(c) * m)) for c, m in zip(code, margins))) for code in model.codes])
        like /= like.sum()
        assert best[i] == like.argmax() and abs(share[i] - like.max()) < 1e-4 and abs(lead[i] - (like.max() - np.sort(like)[-2])) < 1e-4
    assert fit(docs, per_language=1).languages == fit(docs, most=3).languages == model.languages


def test_clashing_columns_and_extremes(spark):
    long = "the cat and the dog " * 40_000
    rows = [(i, t, "en", "q", 7, "k", True, "x") for i, t in enumerate(["the cat", long, None, "", "12 34", "the dog and", "the dog and"])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, _n int, h string, ambiguous boolean, _letters string")
    got = predict(frame, fit(frame))
    assert got.columns == [*frame.columns, "lang_pred_", "score", "ambiguous_"]
    assert [r.lang_pred_ for r in sorted(got.collect())] == ["en", "en", "und", "und", "und", "en", "en"]
    assert sorted(r.lang_pred for r in identify(frame).collect()) == ["en"] * 4 + ["und"] * 3
