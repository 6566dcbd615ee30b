"""Operator 7: language of whole texts by averaged hashed subword embeddings with a linear softmax."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import workspace

#: Hashed subword buckets, embedding size, subword lengths.
BUCKETS, DIM, GRAMS = 1 << 15, 16, (2, 3, 4)
#: Bounds of the training sample: rows a language, and rows in all, but for one a language (those of least hash).
ROWS_A_LANGUAGE, ROWS = 500, 16_000
EPOCHS, RATE, SEED = 6, 0.5, 7
#: Words of the short extracts that training adds for each row, so that short texts are calibrated too.
EXTRACTS = (8, 3)
#: The rejection threshold lets through all but this share of correct validation rows, and is never above ``MOST``.
LOST, MOST = 0.001, 0.5
#: Characters taken at a time from a long text, up to the next blank, so that no subword is cut.
SLICE = 1 << 18
UNDEFINED = "und"

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def subwords(text: str):
    """Bucket arrays of a text's subwords: runs of 2 to 4 characters inside a word, its ends marked by a blank."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    at = 0
    while at < len(points):
        end = at + SLICE
        while end < len(points):  # a slice ends where a word does
            blanks = np.flatnonzero(~letters()[points[end : end + SLICE]])
            end += int(blanks[0]) if len(blanks) else SLICE
            if len(blanks):
                break
        own, at = points[at:end], end
        a = np.where(letters()[own], own, 32).astype(np.uint32)
        a = np.concatenate([[32], a, [32]]).astype(np.uint32)
        blank = a == 32
        keep = np.ones(len(a), bool)
        keep[1:] = ~(blank[1:] & blank[:-1])
        a = a[keep]
        blank = a == 32
        h = a * np.uint32(0x9E3779B1)
        inside = np.ones(len(a), bool)
        for n in range(2, max(GRAMS) + 1):
            if len(a) < n:
                break
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + a[n - 1 :] * np.uint32(0xC2B2AE35)
            if n > 2:
                inside = inside[: len(h)] & ~blank[n - 2 : n - 2 + len(h)]
            else:
                inside = inside[: len(h)]
            if n in GRAMS:
                mixed = h ^ (h >> np.uint32(16))
                yield (mixed[inside] % np.uint32(BUCKETS)).astype(np.int64)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    found = list(subwords(text))
    return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    """Languages, the logit of each language for each bucket, temperature, rejection threshold."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for b in subwords(text):
            total += self.table[b].sum(axis=0, dtype=np.float64)
            n += len(b)
        return total / max(n, 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, calibrated probability); ``und`` and 0 for a text that is null or has no letter."""
        if not self.languages or not has_letter(text):
            return UNDEFINED, 0.0
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        return self.languages[int(z.argmax())], float(p.max() / p.sum())


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, int, np.ndarray, np.ndarray]]) -> Model:
    """Rows (language, document, buckets, counts) -> model, by stochastic gradient descent; the rows of one document in
    five set the calibration and are not learned from."""
    names = sorted({r[0] for r in rows})
    if not names:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(SEED)
    embed = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((DIM, len(names)), np.float32)
    bias = np.zeros(len(names), np.float32)
    y = np.array([names.index(r[0]) for r in rows])
    share = [(r[3] / max(1, r[3].sum())).astype(np.float32) for r in rows]
    document = np.array([r[1] for r in rows])
    documents = np.unique(document)
    kept = np.isin(document, rng.permutation(documents)[: len(documents) // 5])
    check, train = np.flatnonzero(kept), np.flatnonzero(~kept)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(train):
            b, s = rows[i][2], share[i]
            x = s @ embed[b]
            g = _softmax(x @ out + bias)
            g[y[i]] -= 1
            back = out @ g
            out -= rate * np.outer(x, g)
            bias -= 0.1 * rate * g
            # the mean spreads a row's gradient over its subwords; scaled up so that short and long rows both move
            embed[b] -= (rate * min(len(b), 50)) * np.outer(s, back)
    table = embed @ out
    z = np.array([share[i] @ table[rows[i][2]] + bias for i in check]).reshape(len(check), len(names))
    right = y[check]
    temperature, threshold = 1.0, 0.0
    if len(check):
        grid = np.geomspace(0.05, 20, 60)
        temperature = float(min(grid, key=lambda t: -np.log(_softmax(z / t)[np.arange(len(check)), right] + 1e-12).sum()))
        p = _softmax(z / temperature)
        good = p.max(axis=1)[p.argmax(axis=1) == right]
        threshold = min(MOST, float(np.quantile(good, LOST))) if len(good) else 0.0
    return Model(names, table.astype(np.float32), bias.astype(np.float64), temperature, threshold)


def held_out(doc_id: Column | str) -> Column:
    """Documents that are never learned from: crc32 of the id as text leaves 2 by 4, or the id is null."""
    c = doc_id if isinstance(doc_id, Column) else F.col(doc_id)
    return F.coalesce(F.crc32(c.cast("string")) % 4 == 2, F.lit(True))


def sample(spark: SparkSession, docs: DataFrame, most: int = ROWS_A_LANGUAGE, total: int = ROWS) -> DataFrame:
    """(lang, hash, text): of the rows with text and lang that are not held out, about the ``most`` of each language with
    the least hashed doc_id, one a doc_id (the least text); about ``total`` in all, but at least one a language.

    A language's rows are counted where they are, and a bound on the hash follows from its count; so no language's rows
    meet in one task. All languages are kept; the driver holds one row of each.
    """
    usable = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out("doc_id"))
    usable = usable.select("lang", "text", F.xxhash64(F.col("doc_id").cast("long"), F.lit(SEED)).alias("hash"))
    sizes = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("hash").alias("least")).collect()
    quota = max(1, min(most, total // max(1, len(sizes))))
    cut = [(r["lang"], max(r["least"], min((1 << 63) - 1, -(1 << 63) + (quota << 64) // r["n"]))) for r in sizes]
    bounds = F.broadcast(workspace.small_table(spark, cut, pa.schema({"lang": pa.string(), "bound": pa.int64()})))  # a row a language; the model has 128 KB of each
    chosen = usable.join(bounds, "lang").where("hash <= bound")
    return chosen.groupBy("lang", "hash").agg(F.min("text").alias("text"))


def train(spark: SparkSession, docs: DataFrame) -> Model:
    """Fit on a bounded sample of the rows with text and lang that are not held out."""
    workspace.prepare(spark)

    def features(batches):
        for batch in batches:
            out = []
            for lang, key, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "hash", "text"))):
                words = text.split()
                for own in (text, *(" ".join(words[len(words) // 3 :][:n]) for n in EXTRACTS)):
                    b, n = counted(own)
                    if len(b):
                        out.append((lang, key, b.astype(np.int32).tobytes(), n.astype(np.int64).tobytes()))
            columns = list(zip(*out)) if out else [()] * 4
            kinds = [pa.string(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "hash", "buckets", "counts"])

    found = sample(spark, docs).select("lang", "hash", "text").mapInArrow(workspace.giving_back(features), "lang string, hash long, buckets binary, counts binary").collect()  # the bounded sample
    found = sorted((r["lang"], r["hash"], bytes(r["buckets"]), bytes(r["counts"])) for r in found)
    model = fit([(a, k, np.frombuffer(b, np.int32).astype(np.int64), np.frombuffer(c, np.int64).astype(np.float64)) for a, k, b, c in found])
    del found
    workspace.give_back()  # the driver's Python, too, would keep through later stages what training took
    return model


def labels(spark: SparkSession, model: Model):
    """A function of a text column: struct of lang_pred, score and accepted. Only the texts go to Python."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, accepted boolean")
    def label(texts: pa.Array) -> pa.Array:
        m = shared.value
        found = [m.predict(t.as_py()) for t in texts]
        accepted = [lang != UNDEFINED and score >= m.threshold for lang, score in found]
        return pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array(accepted, pa.bool_())], names=["lang_pred", "score", "accepted"])

    return label


def predict(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with all its columns and ``lang_pred``, ``score`` and ``accepted``, which replace columns of those names."""
    workspace.prepare(spark)
    own = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "accepted")]
    rows = workspace.packed(docs).withColumn("x", labels(spark, model)("r.text"))
    return rows.select(*[F.col("r").getField(c).alias(c) for c in own], "x.lang_pred", "x.score", "x.accepted")


def keep_accepted(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """``docs``, whole rows with all their columns, whose language the model accepts.

    Nulls: a null text, like an empty one or one without a letter, goes. Repeated rows stay or go together. Very long
    texts are read whole. An empty table stays empty. Further columns may have any name and type, and none is replaced.
    """
    workspace.prepare(spark)
    return workspace.packed(docs).where(labels(spark, model)("r.text").getField("accepted")).select("r.*")


def language_id(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, lang, ...) -> (doc_id, held_out, lang_pred, score, accepted), one row per input row.

    The model is fitted on a bounded sample of the rows that are not held out; a prediction reads the text alone, whole.
    ``accepted`` is false where the calibrated score is below the threshold found in training. The calibration's
    documents are not learned from.

    Nulls: a null text is ``und`` with score 0, not accepted; a null lang is not learned from; a null doc_id is held
    out. Empty texts and texts without a letter: ``und``. Ties go to the first language by name. Repeated rows give
    repeated results. Without a usable row every prediction is ``und``. Further columns are not read.
    """
    model = train(spark, docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return predict(spark, texts, model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "accepted")
