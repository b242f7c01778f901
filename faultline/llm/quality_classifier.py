r"""Operator 1, quality classifier: attention-based multiple-instance learning.

A text is a bag of passages of ``PASSAGE_WORDS`` words. Each passage is encoded from what it says: hashed words and hashed
runs of three bytes (signed square roots of counts, of unit length) go through a learned projection, beside some statistics of its form.
Gated attention weighs the codes (softmax of w . (tanh(V h) * sigmoid(U h)), Ilse et al. 2018), and a logistic unit scores
the weighted sum. Projection, gates and scorer are trained together from document labels on the driver, on ``sample_rows``
labelled ids at most (those with the least hash) and ``sample_passages`` passages of each at most, evenly spread over its
text (2 KB each). Scoring streams whole texts past the broadcast weights (some 70 KB). Nothing but the chosen ids and their
passages is shuffled.

A null, empty or blank text has no passages and scores 0. Null labels and null ids teach nothing; several labels of one id count as
their least and several rows of an id teach as one, that with the least features; without labels of both kinds every text with words scores the share
of label 1 (0.5 without any label). Rows are scored by themselves: ties, repeated rows, equal and null ids get equal scores for equal texts;
empty tables give no rows; extra columns are not read. Passages are encoded in blocks, so the longest text bounds a
task's memory, at some 60 bytes for each of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import mix, slices, span_hashes, table, text_column, word_spans

PASSAGE_WORDS = 64
WORD_BUCKETS, GRAM_BUCKETS, BLOCK = 512, 512, 2048
_CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "mark": b"#*$%&|<>", "cry": b"!", "stop": b".?", "comma": b",;:", "line": b"\n", "other": range(128, 192)}
_CLASS = np.zeros(256, np.uint8)
for _k, _bytes in enumerate(_CLASSES.values()):
    _CLASS[list(_bytes)] = _k + 1
FORM = len(_CLASSES) + 7
FEATURES = WORD_BUCKETS + GRAM_BUCKETS + FORM


@dataclass
class Passages:
    """The passages of a slice: statistics of form, their words' and bytes' spans, and for each text the number of passages before it (n + 1 values)."""

    form: np.ndarray
    bag: np.ndarray
    words: np.ndarray  # bucket and sign of each word
    grams: np.ndarray  # bucket and sign of the run of three bytes that begins at each byte
    word_at: np.ndarray  # first word of each passage, and one more
    byte_at: np.ndarray  # first byte and end of each passage

    def block(self, a: int, b: int) -> np.ndarray:
        """The features of passages a .. b - 1."""
        out = np.empty((b - a, FEATURES), np.float32)
        out[:, WORD_BUCKETS + GRAM_BUCKETS :] = self.form[a:b]
        sizes = self.byte_at[a:b, 1] - self.byte_at[a:b, 0] - 2  # runs that end within the passage
        sizes = np.maximum(0, sizes)
        for held, begins, counts, at, width in ((self.words, self.word_at[a:b], np.diff(self.word_at[a : b + 1]), 0, WORD_BUCKETS), (self.grams, self.byte_at[a:b, 0], sizes, WORD_BUCKETS, GRAM_BUCKETS)):
            who = np.repeat(np.arange(b - a), counts)
            x = held[np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(len(who))]
            sums = np.bincount(who * width + (x >> 1), weights=1.0 - 2.0 * (x & 1), minlength=(b - a) * width).reshape(b - a, width)
            sums = np.sign(sums) * np.sqrt(np.abs(sums))
            out[:, at : at + width] = sums / np.maximum(1e-6, np.linalg.norm(sums, axis=1, keepdims=True))
        return out


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and sign of hashes in one number."""
    return (hashes >> np.uint64(64 - (2 * buckets - 1).bit_length())).astype(np.int64)


def passages(data: np.ndarray, offsets: np.ndarray) -> Passages:
    starts, ends, first = word_spans(data, offsets)
    words = np.diff(first)
    per_text = -(-words // PASSAGE_WORDS)
    bag = np.concatenate([[0], np.cumsum(per_text)])
    if not bag[-1]:
        none = np.zeros(0, np.int64)
        return Passages(np.zeros((0, FORM), np.float32), bag, none, none, np.zeros(1, np.int64), np.zeros((0, 2), np.int64))
    text = np.repeat(np.arange(len(words)), per_text)
    begin = first[text] + PASSAGE_WORDS * (np.arange(bag[-1]) - bag[text])  # first word of each passage
    n = np.minimum(PASSAGE_WORDS, first[text + 1] - begin).astype(np.float64)
    # A passage's bytes run from its first word to that of the next passage, or to the end of its text.
    a = starts[begin]
    last = np.append(text[1:] != text[:-1], True)
    b = np.where(last, offsets[text + 1], np.append(a[1:], len(data)))
    kinds, out = _CLASS[data], []
    size = np.maximum(1, b - a).astype(np.float64)
    edges = np.stack([a, b], axis=1).ravel()
    for k in range(1, len(_CLASSES) + 1):
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(kinds == k, out=total[1:], dtype=np.int32)
        got = total[edges].reshape(-1, 2)
        out.append((got[:, 1] - got[:, 0]) / size)
    raised = np.zeros(len(data) + 1, np.int32)
    np.cumsum(np.concatenate([[False], (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)]), out=raised[1:], dtype=np.int32)
    out.append((raised[b] - raised[a]) / size)

    def mean(x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x.astype(np.float64), begin) / n

    length = (ends - starts).astype(np.float64)
    out += [mean(length) / 10, np.sqrt(np.maximum(0, mean(length**2) - mean(length) ** 2)) / 10]
    owner = np.repeat(np.arange(len(words)), words).astype(np.uint64)
    h = span_hashes(data, starts, ends)
    own = mix(owner + np.uint64(1))
    for width in (1, 3):  # the share of words, and of 3-word windows, that the text has had before
        rolled = mix(h + own)
        for k in range(1, width):
            rolled[: len(h) - k] = mix(rolled[: len(h) - k] * np.uint64(31) + h[k:])
        seen = np.ones(len(h), bool)
        seen[np.unique(rolled, return_index=True)[1]] = False
        out.append(mean(seen))
    out += [np.log1p(n) / 5, np.log1p(words[text]) / 10]
    padded = np.concatenate([data, np.zeros(2, np.uint8)]).astype(np.uint64)
    runs = mix(padded[:-2] | padded[1:-1] << np.uint64(8) | padded[2:] << np.uint64(16))
    return Passages(np.stack(out, axis=1).astype(np.float32), bag, _bucket(h, WORD_BUCKETS), _bucket(runs, GRAM_BUCKETS), np.append(begin, len(h)), np.stack([a, b], axis=1))


def _by_bag(x: np.ndarray, bag: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, bag[:-1], axis=0)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray] | None
    prior: float

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes of standardized passages."""
        return np.tanh(x @ self.weights["E"] + self.weights["e"])

    def forward(self, h: np.ndarray, bag: np.ndarray) -> dict[str, np.ndarray]:
        """All layers over non-empty bags of codes."""
        w, text = self.weights, np.repeat(np.arange(len(bag) - 1), np.diff(bag))
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        s = (t * g) @ w["w"]
        s = np.exp(s - np.maximum.reduceat(s, bag[:-1])[text])
        a = s / _by_bag(s, bag)[text]
        z = _by_bag(a[:, None] * h, bag)
        return {"text": text, "h": h, "t": t, "g": g, "a": a, "z": z, "p": 1 / (1 + np.exp(-(z @ w["c"] + w["d"])))}

    def standard(self, x: np.ndarray) -> np.ndarray:
        """A copy with the statistics of form centred and scaled; hashed parts have unit length already."""
        x = x.astype(np.float32)
        x[:, -FORM:] = np.clip((x[:, -FORM:] - self.mean) / self.scale, -6, 6)
        return x

    def score(self, held: Passages) -> np.ndarray:
        """A score for each bag, 0 for one without passages."""
        bag = held.bag
        out, full = np.zeros(len(bag) - 1), np.flatnonzero(np.diff(bag))
        if len(full) and self.weights is None:
            out[full] = self.prior
        elif len(full):
            codes = np.concatenate([self.encode(self.standard(held.block(k, min(k + BLOCK, bag[-1])))) for k in range(0, bag[-1], BLOCK)])
            out[full] = self.forward(codes, np.append(bag[full], bag[-1]))["p"]
        return out

    @staticmethod
    def fit(x: np.ndarray, bag: np.ndarray, y: np.ndarray, *, hidden: int = 16, gate: int = 8, turns: int = 150, rate: float = 0.01, l2: float = 1e-4, seed: int = 1) -> Model:
        """Adam over all bags at once; y: 0 or 1, one for each non-empty bag."""
        form = x[:, -FORM:].astype(np.float32)
        model = Model(form.mean(axis=0) if len(x) else np.zeros(FORM), (form.std(axis=0) if len(x) else np.ones(FORM)) + 1e-3, None, float(y.mean()) if len(y) else 0.5)
        if not len(y) or y.min() == y.max():
            return model
        rng = np.random.default_rng(seed)
        shapes = {"E": (x.shape[1], hidden), "e": (hidden,), "V": (hidden, gate), "U": (hidden, gate), "w": (gate,), "c": (hidden,), "d": ()}
        w = {k: (rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 or k in "wc" else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}
        model.weights, x = w, model.standard(x)
        m, v = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}
        for turn in range(1, turns + 1):
            f = model.forward(model.encode(x), bag)
            dp = ((f["p"] - y) / len(y)).astype(np.float32)
            dz = dp[:, None] * w["c"]
            through = (f["h"] * dz[f["text"]]).sum(axis=1)  # by each passage's weight
            ds = f["a"] * (through - _by_bag(f["a"] * through, bag)[f["text"]])
            dtg = ds[:, None] * w["w"]
            dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
            dh = f["a"][:, None] * dz[f["text"]] + dt @ w["V"].T + dg @ w["U"].T
            de = dh * (1 - f["h"] ** 2)
            grads = {"E": x.T @ de, "e": de.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ ds, "c": f["z"].T @ dp, "d": dp.sum()}
            for k in w:
                grad = grads[k] + l2 * w[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * grad, 0.999 * v[k] + 0.001 * grad**2
                w[k] = (w[k] - rate * (m[k] / (1 - 0.9**turn)) / (np.sqrt(v[k] / (1 - 0.999**turn)) + 1e-8)).astype(np.float32)
        return model


def train(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, *, id_column: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = 4_000, sample_passages: int = 16) -> Model:
    """A model from the texts of labelled ids; ``allowed``: a condition on ``_id``, the id of a label."""
    known = labels.select(F.col(id_column).alias("_id"), F.col(label).alias("_label")).where("_id is not null and _label is not null")
    known = known.where(allowed) if allowed is not None else known
    chosen = known.groupBy("_id").agg(F.min("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(text_column(batch, "_text")):
                held, rows = passages(data, offsets), []
                for a, b in zip(held.bag[:-1].tolist(), held.bag[1:].tolist()):
                    some = np.unique(np.linspace(a, b - 1, min(sample_passages, b - a)).astype(int)) if b > a else []
                    rows.append(np.concatenate([np.zeros((0, FEATURES)), *(held.block(k, k + 1) for k in some)]).astype(np.float16).tobytes())
                yield pa.record_batch([*(c.slice(first, end - first) for c in batch.columns[:2]), pa.array(rows, pa.binary())], names=["_id", "_label", "x"])

    texts = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")
    kind = labels.schema[id_column].dataType.simpleString()
    found = texts.select("_id", F.col("_label").cast("double").alias("_label"), "_text").mapInArrow(run, f"_id {kind}, _label double, x binary")
    once = found.where("x <> X''").groupBy("_id", "_label").agg(F.min("x").alias("x"))
    held = once.toArrow()
    held = held.take(pc.sort_indices(held, [("_id", "ascending")])).combine_chunks()
    column = held.column("x").combine_chunks()
    bag = np.concatenate([[0], np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))]).astype(int) // (2 * FEATURES)
    x = np.frombuffer(b"" if not len(held) else column.buffers()[2], np.float16)[: bag[-1] * FEATURES].reshape(bag[-1], FEATURES)
    return Model.fit(x, bag, held.column("_label").to_numpy().astype(np.float32))


def score(docs: DataFrame, model: Model, *, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its id and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for first, end, data, offsets in slices(text_column(batch, text)):
                yield pa.record_batch([batch.column(0).slice(first, end - first), pa.array(own.score(passages(data, offsets)), pa.float64())], names=[id_column, "score"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text).mapInArrow(run, f"`{id_column}` {kind}, score double")


def held_out(column: str) -> Column:
    """Rows whose crc32 of the id, as text, has remainder 0 by 5; rows without an id are not."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(False))


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), ~held_out("_id"))
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", F.expr("if(score >= 0.3, 1, 0)").alias("predicted"))
