"""Operator 8, language identification by hierarchical discrimination.

A text's features are its hashed byte 1- to 4-grams in lower case (square roots of their shares). A first set of
one-versus-one linear support vector machines tells language families apart; within the predicted family another set
separates its languages. Both are trained on the driver from ``per_language`` labelled texts of each language at most (those
with the least hash of their id; over ``most_texts / per_language`` languages share ``most_texts``, with ``LEAST_TEXTS`` of
each at least), and every language is learned. Prediction streams whole texts past the broadcast weights. Model and sample
are bounded by the number of languages: machines by its square in a family, the sample by 16 KB a text. To choose the sample, labels
are counted and ids with a hash under a bound drawn from the counts are shuffled, about twice as many as are taken. The sample stays in
half precision on the driver; machines of up to ``DIMENSIONS / 2`` sampled texts take their steps on the texts' inner products.

``score`` is the probability of the family times that of the language in it, each from its votes' mean margin. The winner
of a set has hardly less than 0.5, whatever the text, so ``certain`` asks for a floor under the lesser of the two, learned by
``calibrate`` from texts that the judging machines have not seen. It tells what lies between the learned languages: a text of
another language that is close to one of them can pass, and with one learned language alone every text with a letter does.
A null text or one without a letter is ``und`` with score 0; so is every text if there is nothing to learn from. Null
labels and null ids teach nothing; repeated rows of an id teach as one (its least features under each label). Languages that
``FAMILIES`` does not list are one family together. Ties go to the first language in alphabetic order; repeated rows, equal
and null ids get a result for each row; empty tables give no rows; extra columns are not read. One text bounds a
task's memory, and takes 20 bytes for each of its own.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import salted, slices, table, text_column

#: Families of common languages: fixed values (ISO 639-1 codes).
FAMILIES = {
    **dict.fromkeys(["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"], "germanic"),
    **dict.fromkeys(["fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"], "romance"),
    **dict.fromkeys(["ru", "uk", "be", "pl", "cs", "sk", "bg", "mk", "sr", "hr", "bs", "sl"], "slavic"),
    **dict.fromkeys(["lt", "lv"], "baltic"),
    **dict.fromkeys(["ga", "gd", "cy", "br"], "celtic"),
    **dict.fromkeys(["fi", "et", "hu"], "uralic"),
    **dict.fromkeys(["tr", "az", "kk", "ky", "uz", "tk", "tt", "ug"], "turkic"),
    **dict.fromkeys(["hi", "ur", "bn", "pa", "gu", "mr", "ne", "si", "sd", "or", "as", "sa"], "indic"),
    **dict.fromkeys(["fa", "ku", "ps", "tg"], "iranian"),
    **dict.fromkeys(["ta", "te", "kn", "ml"], "dravidian"),
    **dict.fromkeys(["ar", "he", "am", "mt", "ti"], "semitic"),
    **dict.fromkeys(["id", "ms", "jv", "su", "tl", "mg", "mi", "sm", "haw"], "austronesian"),
    **dict.fromkeys(["sw", "zu", "xh", "st", "sn", "rw", "ln"], "bantu"),
    **dict.fromkeys(["zh", "bo", "my"], "sino-tibetan"),
}
OTHER = "other"
LEAST_TEXTS = 20
DIMENSIONS, GRAMS = 1 << 13, 4
BLOCK = 128
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    m = _LETTER.search(text)
    return m is not None and (m[0].isalpha() or any(map(str.isalpha, text)))


def features(texts: list[str]) -> Iterator[np.ndarray]:
    """For each text a vector of unit length."""
    for text in texts:
        data = np.frombuffer(text.lower().encode(), np.uint8).astype(np.uint32)
        out, h = np.zeros(DIMENSIONS, np.float32), np.zeros(len(data), np.uint32)
        for n in range(1, GRAMS + 1):
            if len(data) < n:
                break
            h = h[: len(data) - n + 1] * np.uint32(0x01000193) + data[n - 1 :] + np.uint32(1)
            x = h * np.uint32(0x9E3779B1)
            out += np.bincount(x >> np.uint32(19), minlength=DIMENSIONS)
        yield np.sqrt(out / max(1.0, float(out.sum())))


def products(x: np.ndarray) -> np.ndarray:
    """The inner products of all rows in single precision. ``x`` may be kept in half precision: ``BLOCK`` rows are converted at a time."""
    out = np.empty((len(x), len(x)), np.float32)
    for i in range(0, len(x), BLOCK):
        a = x[i : i + BLOCK].astype(np.float32)
        for j in range(i, len(x), BLOCK):
            part = a @ (x[j : j + BLOCK].astype(np.float32).T if j > i else a.T)
            out[i : i + BLOCK, j : j + BLOCK], out[j : j + BLOCK, i : i + BLOCK] = part, part.T
    return out


def hinge_machine(x: np.ndarray, y: np.ndarray, rows: np.ndarray, inner: np.ndarray | None = None, turns: int = 150, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Linear support vector machine (squared hinge, classes weighted alike) of some rows by accelerated gradient steps. y: 1 or -1 for each of them. ``x`` may be kept in half precision.

    The weights are a sum of rows. With all rows' products ``inner`` the steps are taken on the rows' shares in it, and ``x`` is read once, in blocks.
    """
    if inner is None:
        ahead = back = x[rows].astype(np.float32, copy=False)
    else:
        ahead, back = inner if len(rows) == len(x) else inner[np.ix_(rows, rows)], None
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, b = np.zeros(ahead.shape[1], np.float32), 0.0
    v, c = w.copy(), b
    step = 0.25  # rows have length 1, so the gradient's Lipschitz bound is 2 * (1 + 1)
    for t in range(turns):
        slack = np.maximum(0, 1 - y * (ahead @ v + c))
        g = weight * slack * y
        w2, b2 = v + step * (2 * (g if back is None else back.T @ g) - l2 * v), c + step * 2 * float(g.sum())
        momentum = t / (t + 3)
        v, c = w2 + momentum * (w2 - w), b2 + momentum * (b2 - b)
        w, b = w2, b2
    if back is None:
        w = sum((w[k : k + BLOCK] @ x[rows[k : k + BLOCK]].astype(np.float32) for k in range(0, len(rows), BLOCK)), np.zeros(x.shape[1], np.float32))
    return w, b


def _inner(x: np.ndarray) -> np.ndarray | None:
    """The rows' products if they take no more than the rows in half precision; else machines convert their rows."""
    return products(x) if 2 * len(x) <= x.shape[1] else None


@dataclass
class Duels:
    """One-versus-one machines between names."""

    names: list[str]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray | None = None
    biases: np.ndarray | None = None

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, rows: np.ndarray | None = None, inner: np.ndarray | None = None) -> Duels:
        rows = np.arange(len(x)) if rows is None else rows
        names = sorted(set(y[rows].tolist()))
        out = Duels(names, list(itertools.combinations(range(len(names)), 2)))
        fitted = []
        for a, b in out.pairs:
            own = rows[(y[rows] == names[a]) | (y[rows] == names[b])]
            fitted.append(hinge_machine(x, np.where(y[own] == names[a], 1, -1).astype(np.float32), own, inner))
        out.weights = np.array([w for w, _ in fitted], np.float32).reshape(len(fitted), x.shape[1])
        out.biases = np.array([b for _, b in fitted], np.float32)
        return out

    def decide(self, x: np.ndarray) -> tuple[str, float]:
        """The name with most votes (on a tie the larger sum of margins, then the first), and its probability."""
        if len(self.names) == 1:
            return self.names[0], 1.0
        margins = self.weights @ x + self.biases
        votes, sums = np.zeros(len(self.names)), np.zeros(len(self.names))
        for (a, b), m in zip(self.pairs, margins.tolist()):
            votes[a if m >= 0 else b] += 1
            sums[a] += m
            sums[b] -= m
        best = max(range(len(self.names)), key=lambda k: (votes[k], sums[k], -k))
        return self.names[best], float(1 / (1 + np.exp(-4.0 * sums[best] / (len(self.names) - 1))))


@dataclass
class Model:
    family: Duels | None
    within: dict[str, Duels]
    floor: float | None = None

    @staticmethod
    def fit(x: np.ndarray, languages: np.ndarray, rows: np.ndarray | None = None, inner: np.ndarray | None = None) -> Model:
        rows = np.arange(len(x)) if rows is None else rows
        if not len(rows):
            return Model(None, {})
        families = np.array([FAMILIES.get(v, OTHER) for v in languages.tolist()])
        return Model(Duels.fit(x, families, rows, inner), {f: Duels.fit(x, languages, rows[families[rows] == f], inner) for f in sorted(set(families[rows].tolist()))})

    def parts(self, x: np.ndarray) -> tuple[str, float, float]:
        """The language, the probability of its family and its own in the family."""
        family, p = self.family.decide(x)
        language, q = self.within[family].decide(x)
        return language, p, q

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or self.family is None or not has_letter(text):
            return "und", 0.0
        language, p, q = self.parts(next(features([text])))
        return language, p * q

    def weakest(self, text: str | None) -> float | None:
        """The lesser of the two probabilities; None for ``und``."""
        if text is None or self.family is None or not has_letter(text):
            return None
        return min(self.parts(next(features([text])))[1:])


def calibrate(x: np.ndarray, languages: np.ndarray, inner: np.ndarray | None = None) -> float:
    """The probability at half the margin that 99 of 100 texts reach whose language is told rightly by a model of the other fold.

    Equal texts share a fold. 0 if no such text is there.
    """
    fold = np.array([zlib.crc32(v.tobytes()) & 1 for v in x], np.int64)
    found = []
    for k in (0, 1):
        own = Model.fit(x, languages, np.flatnonzero(fold == k), inner)
        if own.family is not None:
            said = ((languages[j], own.parts(x[j].astype(np.float32))) for j in np.flatnonzero(fold != k))
            found += [min(p, q) for truth, (name, p, q) in said if name == truth]
    if not found:
        return 0.0
    # A probability is 1 / (1 + exp(-4 * margin)), so half the margin is the square root of the odds.
    least = min(float(np.quantile(found, 0.01)), 1 - 1e-12)
    odds = (least / (1 - least)) ** 0.5
    return odds / (1 + odds)


def train(docs: DataFrame, allowed: Column, *, id_column: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 600, most_texts: int = 4_000, calibrated: bool = False) -> Model:
    """A model from the labelled rows that ``allowed`` admits: of each language those with the least hash of their id. With ``calibrated``, it has the floor that ``certain`` needs."""
    known = docs.where(allowed & F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(id_column).isNotNull())
    ids = known.select(F.col(id_column).alias("_id"), F.col(lang).alias("_lang"))
    counts = {r["_lang"]: r["count"] for r in ids.groupBy("_lang").count().collect()}  # a row for each language
    each = max(LEAST_TEXTS, min(per_language, most_texts // max(1, len(counts))))
    # The ``each`` least hashes of a language are below a bound that leaves about twice as many; only those are ranked.
    bounds = [(name, -(1 << 63) + min((1 << 64) - 1, int((2 * each + 100) / n * (1 << 64)))) for name, n in counts.items()]
    below = docs.sparkSession.createDataFrame(bounds, f"_lang {docs.schema[lang].dataType.simpleString()}, _bound bigint")
    near = ids.join(F.broadcast(below), "_lang").where(F.xxhash64("_id") <= F.col("_bound")).select("_id", "_lang").distinct()
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id"))
    chosen = near.withColumn("_rank", rank).where(F.col("_rank") <= each).select("_id", "_lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, x) for i, t in enumerate(text_column(batch, "_text").to_pylist()) if has_letter(t) for x in features([t])]
            taken = [c.take(pa.array([i for i, _ in found], pa.int64())) for c in batch.columns[:2]]
            yield pa.record_batch([*taken, pa.array([x.astype(np.float16).tobytes() for _, x in found], pa.binary())], names=["_id", "_lang", "x"])

    texts = docs.where(allowed).select(F.col(id_column).alias("_id"), F.col(lang).alias("_lang"), F.col(text).alias("_text")).join(F.broadcast(chosen), ["_id", "_lang"], "left_semi")
    kinds = ", ".join(f"{a} {docs.schema[b].dataType.simpleString()}" for a, b in (("_id", id_column), ("_lang", lang)))
    once = texts.mapInArrow(run, f"{kinds}, x binary").groupBy("_id", "_lang").agg(F.min("x").alias("x"))
    held = once.toArrow()
    order = pc.sort_indices(held, [("_lang", "ascending"), ("_id", "ascending")]).to_numpy()
    languages = np.array(held.column("_lang").to_pylist(), object)[order]
    x, places, batches = np.empty((len(order), DIMENSIONS), np.float16), iter(np.argsort(order).tolist()), held.to_batches()[::-1]
    del held  # each batch goes once its rows are copied
    while batches:
        for v in batches.pop().column("x"):
            x[next(places)] = np.frombuffer(v.as_buffer(), np.float16)
    v = None  # a value holds its batch
    pa.default_memory_pool().release_unused()
    inner = _inner(x)
    model = Model.fit(x, languages, inner=inner)
    if calibrated:
        model.floor = calibrate(x, languages, inner)
    return model


def identify(docs: DataFrame, model: Model, *, id_column: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs``: its id, the columns in ``keep``, ``lang_pred`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [id_column, *(c for c in keep if c not in (id_column, text))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = batch.column(len(columns))
            said = [own.predict(t.as_py()) for t in texts]
            yield pa.record_batch([*batch.columns[: len(columns)], pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())], names=[*columns, "lang_pred", "score"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.select(*(f"`{c}`" for c in columns), F.col(text)).mapInArrow(run, f"{kinds}, lang_pred string, score double")


def certain(docs: DataFrame, model: Model, *, text: str = "text", least: float | None = None) -> DataFrame:
    """The rows of ``docs`` in some learned language, both family and language at ``least`` that certain (the model's floor by default); texts without a letter go. Decided by row, so nothing is shuffled."""
    least = model.floor if least is None else least
    if least is None:
        raise ValueError("the model has no floor; train it with calibrated=True")
    shared, extra, schema = docs.sparkSession.sparkContext.broadcast(model), salted(docs), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            said = [own.weakest(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            kept = pa.array([s is not None and s >= least for s in said], pa.bool_())
            yield batch.select(range(batch.num_columns - 1)).filter(kept)

    return docs.withColumn(extra, F.col(text)).mapInArrow(run, schema)


def held_out(column: str) -> Column:
    """Rows whose crc32 of the id, as text, has remainder 2 by 4; rows without an id are not."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, ~held_out("doc_id"))
    return identify(docs, model).withColumn("held_out", held_out("doc_id")).select("doc_id", "held_out", "lang_pred", "score")
