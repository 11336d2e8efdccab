"""Language identification by error-correcting output codes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratamill.llm import words as W
from stratamill.llm.common import fresh, materialize, small

#: Classes of the hashed byte n-grams.
FEATURES = 4096
UNKNOWN = "und"
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, row after the last, root shares of hashed byte bigrams and trigrams of the whole texts)."""
    for i, j, raw, at in W.chunks(column):
        for a in range(0, j - i, 512):
            b = min(j - i, a + 512)
            out = np.zeros((b - a, FEATURES), np.float32)
            for r in range(a, b):
                x = _LOWER[raw[at[r] : at[r + 1]]]
                if len(x) > 2:
                    two = x[:-1] | (x[1:] << np.uint32(8))
                    three = two[:-1] | (x[2:] << np.uint32(16))
                    for g, salt in ((two, 0x9E3779B1), (three, 0x85EBCA77)):
                        h = (g * np.uint32(salt)) >> np.uint32(20)
                        out[r - a] += np.bincount(h, minlength=FEATURES)
            total = out.sum(axis=1, keepdims=True)
            yield i + a, i + b, np.sqrt(out / np.maximum(total, 1))


def codewords(k: int, seed: int = 11) -> np.ndarray:
    """k codewords of +-1, far apart: all splits into two where there are few languages, else the best of random ones."""
    if k <= 5:
        bits = [[1] + [1 if (s >> i) & 1 else -1 for i in range(k - 1)] for s in range(2 ** max(k - 1, 0) - 1)]
        return np.array(bits, np.int8).reshape(-1, k).T
    rng, n = np.random.default_rng(seed), int(np.ceil(10 * np.log2(k)))
    tried = [rng.choice(np.array([-1, 1], np.int8), (k, n)) for _ in range(200)]
    return min(tried, key=lambda c: (c.astype(int) @ c.T - 2 * n * np.eye(k)).max())


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its share of the likelihood, and its lead over the next, by the codewords' logistic losses."""
        margins = x @ self.weights + self.bias
        loss = np.logaddexp(0, -margins[:, None, :] * self.codes[None].astype(np.float32)).sum(axis=2)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share /= share.sum(axis=1, keepdims=True)
        top = np.sort(share, axis=1)
        return share.argmax(axis=1), top[:, -1], top[:, -1] - (top[:, -2] if share.shape[1] > 1 else 0)


def held_out(id_col: str) -> Column:
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % 4 == 2


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400, most: int = 8_000, rounds: int = 150) -> Model | None:
    """Learns from labelled rows that aren't held out; None if there is none.

    The sample is bounded: of each language the per_language rows whose ids' hashes are least, spread over all rows,
    or fewer where that would be more than most rows in all (one at least). Only their feature vectors, one size for any text, come to the driver. Each bit of the codewords is a logistic
    classifier, languages weighing alike.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(~held_out("id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1_000_000)))
    counts = materialize(known.groupBy("lang").agg(F.count("*").alias("n")))
    per_language = max(1, min(per_language, most // max(1, counts.count())))
    near = known.join(small(counts), "lang").filter(F.col("h") * F.col("n") <= 1_000_000 * (2 * per_language + 50))
    order = Window.partitionBy("lang").orderBy("h", "id")
    sample = near.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= per_language).select("lang", "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, x in features(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([v.tobytes() for v in x])], names=["lang", "x"])

    rows = sample.mapInArrow(vectors, "lang string, x binary").collect()
    if not rows:
        return None
    languages = tuple(sorted({r["lang"] for r in rows}))
    codes = codewords(len(languages))
    rows.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in rows])
    k = np.array([languages.index(r["lang"]) for r in rows])
    share = (1 / (np.bincount(k)[k] * len(languages))).astype(np.float32)[:, None]
    y = codes[k].astype(np.float32)
    w, b = np.zeros((FEATURES, y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    step = 40.0
    for _ in range(rounds):
        g = -y * share / (1 + np.exp(y * (x @ w + b)))
        w -= step * (x.T @ g + 1e-5 * w)
        b -= step / 10 * g.sum(axis=0)
    return Model(languages, codes, w, b)


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", unsure: float = 0.05) -> DataFrame:
    """docs with lang_pred, score and ambiguous; only the text is looked at. Where docs has a column of such a name, the
    new one's has an underscore more.

    lang_pred is und, with score 0, where the text is null, has no letter or no language was learned. score is the
    likelihood share of the nearest codeword; ambiguous says that it leads the next by less than unsure.
    """
    spark = docs.sparkSession
    extra = [T.StructField(fresh(docs, n), t) for n, t in (("lang_pred", T.StringType()), ("score", T.DoubleType()), ("ambiguous", T.BooleanType()))]
    sent, at = spark.sparkContext.broadcast(model), docs.columns.index(text_col)
    names = [*docs.columns, *(f.name for f in extra)]
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            n = batch.num_rows
            has = batch.column(n_cols := batch.num_columns - 1).to_numpy(zero_copy_only=False)
            best, score, lead = np.zeros(n, np.int64), np.zeros(n), np.ones(n)
            if model is not None:
                for i, j, x in features(batch.column(at)):
                    best[i:j], score[i:j], lead[i:j] = model.decode(x)
            known = has & (model is not None)
            lang = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_cols], pa.array(lang, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(known & (lead < unsure))], names=names)

    return docs.withColumn(fresh(docs, "_letters"), letters).mapInArrow(label, T.StructType([*docs.schema, *extra]))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, held_out, lang_pred, score, ambiguous for each row of docs.

    Texts are taken whole, however long; repeated rows are labelled each, equal texts alike. A null id is in no fold of
    those held out. Other columns are ignored; an empty table gives no rows.
    """
    model = fit(docs, id_col, text_col, lang_col)
    found = predict(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), model, "_text")
    return found.select(F.col("_id").alias(id_col), held_out("_id").alias("held_out"), "lang_pred", "score", "ambiguous")
