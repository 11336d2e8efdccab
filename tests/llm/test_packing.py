import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratamill.llm.packing import Encoder, pack, pieces

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")


def best_fit(lengths, capacity):
    """Number of sequences of best fit one by one, the longest first."""
    count, opened = Counter(), 0
    for length in sorted(lengths, reverse=True):
        width = next((w for w in range(length, capacity + 1) if count[w]), None)
        if width is None:
            width, opened = capacity, opened + 1
        else:
            count[width] -= 1
        count[width - length] += 1
    return opened


def check(rows, capacity):
    """Gapless sequences of no more than capacity; their number."""
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= capacity
    return len(seqs)


SHAPES = {
    "even": lambda rng: rng.integers(1, 257, 3000),
    "short": lambda rng: np.minimum(256, rng.geometric(0.04, 3000)),
    "long": lambda rng: rng.integers(60, 257, 1500),
    "thirds": lambda rng: rng.choice([85, 86, 128, 129, 64, 256, 1], 2000),
    "one": lambda rng: np.full(1000, 100),
    "cut": lambda rng: np.concatenate([np.full(500, 256), rng.integers(1, 257, 400), np.full(2000, 3)]),
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("rows", [200_000, 300])
def test_as_few_sequences_as_best_fit_one_by_one(spark, shape, rows, request):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    request.addfinalizer(lambda v=spark.conf.get(name): spark.conf.set(name, v))
    spark.conf.set(name, "false")
    lengths = SHAPES[shape](np.random.default_rng(8)).tolist()
    frame = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(4)
    found = pack(frame, 256, rows=rows).collect()
    assert sorted(r.doc_id for r in found) == list(range(len(lengths)))
    want = best_fit(lengths, 256)
    got = check(found, 256)
    assert got == want


@settings(deadline=None, max_examples=400)
@given(st.lists(st.text(st.one_of(st.characters(min_codepoint=1, max_codepoint=0x250), st.characters(), st.sampled_from("'sStdrevml <|>.é́ß"))), max_size=8))
def test_words_have_the_tokenizers_ids(words):
    path, text = public.path("word_bpe_49k.json"), " ".join(words)
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    ids = Encoder.of(path).tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(Encoder.of(path).encode(text, 100), "<u4").tolist() == ids


def test_whole_texts_in_gapless_sequences(odd, docs):
    path = public.path("word_bpe_49k.json")
    t = tokenizers.Tokenizer.from_file(path)
    extra = docs([(100 + i, f"Word{i} it's <|endoftext|>\x1cx  Y{i}́ " * (i % 9), "en", "s") for i in range(300)])
    for frame, size in ((odd, 2048), (extra, 64), (docs([]), 64)):
        rows = pack(pieces(frame, path, size), size).collect()
        want = []
        for r in frame.collect():
            ids = t.encode(r.text or "", add_special_tokens=False).ids + [0]
            want += [(r.doc_id, p, s, len(ids[s : s + size]), zlib.crc32(np.array(ids[s : s + size], "<u4").tobytes())) for p, s in enumerate(range(0, len(ids), size))]
        key = lambda x: tuple(-1 if v is None else v for v in x)
        assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(want, key=key)
        check(rows, size)
