"""Language identification by sparse multinomial logistic regression on character n-grams.

Features are TF-IDF weights of hashed character n-grams, scaled to length 1. The weights are learned by
follow-the-regularised-leader with an elastic net, and a temperature, fitted on documents left out of
that, calibrates the probabilities.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize, texts_of

#: Hashed n-grams fall into 2^HASH_BITS features, fewer where there are very many languages (see Settings.bits).
HASH_BITS = 16
ORDERS = (1, 2, 3)
#: Characters of a text taken at a time, to bound memory; its n-grams are counted over the whole text.
SLICE = 1 << 18
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_MULT = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def has_letter(text: str) -> bool:
    """Whether any character is a letter of some script."""
    return any(m.group().isalpha() for m in _LETTER.finditer(text))


def counts(text: str, bits: int = HASH_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Features, of 2^bits, present in the lower-cased whole text and how often, white space and digits folded."""
    folded = re.sub(r"[\s\d]+", " ", f" {text.lower()} ")
    points = np.frombuffer(folded.encode("utf-32-le", "surrogatepass"), np.uint32)
    total = np.zeros(1 << bits, np.int64)
    longest = max(ORDERS)
    with np.errstate(over="ignore"):
        for at in range(0, len(points), SLICE):
            part = points[at : at + SLICE + longest - 1].astype(np.uint64)
            end = min(SLICE, len(points) - at)
            h = np.zeros(len(part), np.uint64)
            seen = []
            for n in range(1, longest + 1):
                h = (h[: len(part) - n + 1] + part[n - 1 :] + np.uint64(n)) * np.uint64(_MULT[(n - 1) % 3])
                h ^= h >> np.uint64(29)
                if n in ORDERS:
                    seen.append((h[:end] >> np.uint64(64 - bits)).view(np.int64))
            total += np.bincount(np.concatenate(seen), minlength=1 << bits)
    found = np.flatnonzero(total)
    return found.astype(np.int32), total[found]


def tf_idf(found: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weights of a document's features: 1 + log of the count, times IDF, scaled to length 1."""
    x = (1 + np.log(n)) * idf[found]
    size = np.sqrt(x @ x)
    return x / size if size else x


@dataclass
class Settings:
    """Bounds and penalties of the fit."""

    #: At most about this many labelled documents of each language are learned from, and of all languages together; the sample is
    #: the only part of the corpus that reaches the driver, as sparse counts.
    per_language: int = 300
    most_rows: int = 10_000
    #: Numbers in one table of the fit (features x languages): with many languages the n-grams are hashed to fewer features.
    most_weights: int = 1 << 23
    epochs: int = 3
    alpha: float = 1.0
    beta: float = 1.0
    #: Great enough to set most weights to zero; see the tests for how many.
    l1: float = 0.1
    l2: float = 1e-4
    #: One in so many sampled documents is left out of the fit, for the temperature.
    calibrate_one_in: int = 5

    def bits(self, languages: int) -> int:
        """Features are 2^bits: HASH_BITS for up to 128 languages, with the defaults."""
        return max(1, min(HASH_BITS, (self.most_weights // max(languages, 1)).bit_length() - 1))


@dataclass
class Model:
    """Weights that are not zero only: those of feature f are at first[f] to first[f + 1], each of the language `of`."""

    languages: list[str]
    idf: np.ndarray
    first: np.ndarray
    of: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    @property
    def bits(self) -> int:
        return len(self.idf).bit_length() - 1

    def logits(self, found: np.ndarray, n: np.ndarray) -> np.ndarray:
        times = self.first[found + 1] - self.first[found]
        at = np.repeat(self.first[found], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        x = np.repeat(tf_idf(found, n, self.idf), times)
        return np.bincount(self.of[at], x * self.weights[at], len(self.languages)) + self.bias

    def predict(self, text: str) -> tuple[str, float]:
        """The likeliest language and its probability; UNKNOWN and 0 for a text without a letter."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        p = _softmax(self.logits(*counts(text, self.bits)) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dim: int, k: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x languages) and bias of multinomial logistic regression by FTRL-Proximal with elastic net.

    Per coordinate, z gathers gradients less the proximal term and n their squares; the weight is read
    from both in closed form and is exactly zero while |z| is within the L1 penalty. The last feature is the
    bias, which has no penalty.
    """
    dim += 1
    z, n = np.zeros((dim, k)), np.zeros((dim, k))

    def weights(at):
        zz, free = z[at], np.asarray(at)[..., None] == dim - 1
        l1, l2 = np.where(free, 0, s.l1), np.where(free, 0, s.l2)
        return np.where(np.abs(zz) <= l1, 0.0, (np.sign(zz) * l1 - zz) / ((s.beta + np.sqrt(n[at])) / s.alpha + l2))

    order = np.arange(len(rows))
    for epoch in range(s.epochs):
        np.random.default_rng(epoch).shuffle(order)
        for r in order.tolist():
            at, x = rows[r]
            at, x = np.append(at, dim - 1), np.append(x, 1.0)
            w = weights(at)
            p = _softmax(x @ w)
            p[labels[r]] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(dim))
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        z = logits / np.exp(log_t)
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(labels)), labels]).mean())

    lo, hi, g = np.log(0.25), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        if loss(a) <= loss(b):
            hi = b
        else:
            lo = a
    return float(np.exp((lo + hi) / 2))


def document_frequencies(docs: DataFrame, bits: int = HASH_BITS) -> DataFrame:
    """(feature, df): in how many texts each feature occurs, over all rows of `docs`. Partial sums by task."""

    def run(batches):
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for t in texts_of(batch):
                total[counts(t, bits)[0]] += 1
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["feature", "df"])

    bound_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(run, "feature int, df long").groupBy("feature").agg(F.sum("df").alias("df"))


def _sample(docs: DataFrame, s: Settings) -> tuple[int, int, DataFrame]:
    """The number of rows and of languages, and a bounded sample: a hash of the id draws about the same number of each language."""
    sizes = materialize(docs.groupBy("lang").count())
    total, languages = sizes.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    each = min(float(s.per_language), s.most_rows / max(languages, 1))
    shares = sizes.select("lang", F.least(F.lit(1.0), F.lit(each) / F.col("count")).alias("share"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    # A short list of languages is broadcast; a longer one is joined as Spark sees fit.
    drawn = docs.join(F.broadcast(shares) if languages <= 10_000 else shares, "lang").where(draw < F.col("share"))
    return total, languages, drawn.select("doc_id", "text", "lang")


def fit(docs: DataFrame, settings: Settings | None = None) -> Model:
    """Learn from doc_id, text and lang of `docs`; rows with a null text or lang are passed over.

    Document frequencies cover every remaining row. The regression sees at most about `per_language` rows of each
    language, and `most_rows` in all, drawn by a hash of the id, as sparse counts: this bounds what reaches the driver. It learns
    every language in that sample, however many: of more than `most_rows` labels those without a row there are not known.
    """
    s = settings or Settings()
    rows = docs.where("text is not null and lang is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    )
    total, labels, sample = _sample(rows, s)
    bits = s.bits(min(labels, 2 * s.most_rows))

    def sparse(batches):
        for batch in batches:
            got = [counts(t, bits) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.list_(pa.int64()))],
                ["doc_id", "lang", "found", "n"],
            )

    bound_batches(docs.sparkSession)
    drawn = sample.mapInArrow(sparse, "doc_id long, lang string, found array<int>, n array<long>").toArrow().combine_chunks()
    drawn = drawn.sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    languages = sorted(set(drawn["lang"].to_pylist()))
    number = {x: k for k, x in enumerate(languages)}
    idf = np.full(1 << bits, np.log(1 + total) + 1.0)
    table = document_frequencies(rows, bits).toArrow()
    idf[table["feature"].to_numpy()] = np.log((1 + total) / (1 + table["df"].to_numpy().astype(np.float64))) + 1
    taken: dict[str, int] = {}
    xs, ys, cal = [], [], []
    for lang, found, n in zip(drawn["lang"].to_pylist(), drawn["found"], drawn["n"]):
        taken[lang] = taken.get(lang, 0) + 1
        if taken[lang] > s.per_language:
            continue
        found = found.values.to_numpy()
        xs.append((found, tf_idf(found, n.values.to_numpy(), idf)))
        ys.append(number[lang])
        cal.append(taken[lang] % s.calibrate_one_in == 0)
    ys_, cal_ = np.array(ys, np.int64), np.array(cal, bool)
    if not len(languages):
        return Model([], idf, np.zeros(len(idf) + 1, np.int64), np.zeros(0, np.int32), np.zeros(0), np.zeros(0), 1.0)
    learn = [k for k in range(len(xs)) if not cal_[k]]
    w, b = ftrl([xs[k] for k in learn], ys_[learn], len(idf), len(languages), s)
    feature, of = np.nonzero(w)
    model = Model(languages, idf, np.searchsorted(feature, np.arange(len(idf) + 1)), of.astype(np.int32), w[feature, of], b, 1.0)
    held = [k for k in range(len(xs)) if cal_[k]]
    logits = np.array([xs[k][1] @ w[xs[k][0]] + b for k in held]).reshape(-1, len(languages))
    model.temperature = fit_temperature(logits, ys_[held])
    return model


def in_fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4: fold 2 is held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def fold_of(doc_id: int) -> int:
    """As `in_fold`, of one id."""
    return zlib.crc32(str(doc_id).encode()) % 4


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of each whole text; null texts and those without a letter are UNKNOWN, 0.
    A very long text is counted slice by slice.

    The model goes to the tasks as one broadcast: its weights that are not zero, Settings.most_weights at most.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            got = [m.predict(t) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    bound_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, lang_pred string, score double")


def learn_and_identify(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): fit on the folds other than 2, predict every row.

    A null doc_id is in no fold and is not learned from. Repeated rows are predicted each; an empty
    table gives an empty one; with no labelled row every prediction is UNKNOWN; other columns are ignored.
    """
    fold = in_fold(F.col("doc_id"))
    model = fit(docs.where(fold != 2), settings)
    out = identify(docs, model)
    return out.select("doc_id", F.coalesce(in_fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least_score: float = 0.5, settings: Settings | None = None) -> DataFrame:
    """The rows of `docs` whose text has a language the model tells with `least_score` or more.

    The verdict is a filter on each row's own text, so rows keep their columns, whatever their names, and are not
    shuffled. Null and empty texts and those without a letter go; a very long text counts as a whole; repeated rows
    are judged each; an empty table gives an empty one. With no labelled row no language is known and all go.
    """
    model = fit(docs.where(in_fold(F.col("doc_id")) != 2), settings)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bound_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        m = shared.value
        for batch in batches:
            got = [m.predict(t or "") for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([g[0] != UNKNOWN and g[1] >= least_score for g in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
