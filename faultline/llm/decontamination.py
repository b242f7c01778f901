"""Operator 7, benchmark decontamination: q-gram lemma filtering with banded verification.

An item of m characters that occurs with at most k edits shares at least m - q + 1 - k * q of its q-grams with the
place, and all of them on diagonals (place in the text minus place in the item) at most k apart. Texts stream past an
index of the items' q-grams; hits are counted, each item place once, in diagonal bands of width 2 * (k + 1) that overlap
by half; bands that meet the bound are verified by an alignment over the band's diagonals and k more on each side.
Nothing is shuffled. The index goes to the workers in blocks of ``block_chars`` characters of items, one block after the
other and each against all texts, so one index is held at a time.

Texts and items are compared in lower case with white space runs as one space. The budget of an item is ``rate`` of its
length, rounded down. Items for which grams of ``q`` characters leave no bound have an index of their own with grams of
``SHORT_Q``, for which the bound holds at any length from there on; still shorter items have no budget and must occur as
they are; items without other characters than white space match nothing. Null and empty texts match nothing. Rows are
judged by themselves, whatever their ids: repeated rows, equal and null ids each give their own rows, one for each item
found; of equal places the first counts. Items of one text under several ids are each found. Empty tables give no rows.
Extra columns are not read by ``leaks`` and pass through ``clean``. A text and its grams bound a task's memory.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from faultline.llm.common import _BASE, _UNBASE, Scratch, _power, mix, salted, slices, table, text_column

Q, SHORT_Q, RATE = 8, 4, 0.1


def normal(text: str) -> str:
    return " ".join(text.replace("\0", " ").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(chars: np.ndarray, q: int) -> np.ndarray:
    """Hash of each run of q characters, from one prefix sum."""
    n = len(chars) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum((chars.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x2545F4914F6CDD1D)) * _power("up", _BASE, len(chars)), out=total[1:])
    return mix((total[q:] - total[:n]) * _power("down", _UNBASE, n))


def has_bound(length: int, q: int, rate: float) -> bool:
    """Whether an item within its budget shares a q-gram with the place at least."""
    return length - q + 1 - int(rate * length) * q >= 1


@dataclass
class Index:
    """The q-grams of a block of items, each of which has a bound for this q or is shorter than q."""

    q: int
    ids: list
    texts: list[str]
    budgets: np.ndarray
    needed: np.ndarray
    seen: np.ndarray  # a bit for each value of a hash's highest bits
    shift: int
    hashes: np.ndarray  # distinct, sorted
    first: np.ndarray  # of each hash, its first place among ``item`` and ``place``; one more at the end
    item: np.ndarray
    place: np.ndarray

    @staticmethod
    def build(items: list[tuple], q: int, rate: float) -> Index:
        texts = [normal(t or "") for _, t in items]
        grams = [gram_hashes(codes(t), q) for t in texts]
        h = np.concatenate([*grams, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(items)), [len(g) for g in grams])
        place = np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, int)]).astype(np.int64)
        order = np.argsort(h, kind="stable")
        hashes, first = np.unique(h[order], return_index=True)
        bits = max(16, int(len(hashes)).bit_length() + 3)
        seen = np.zeros(1 << bits, bool)
        seen[(hashes >> np.uint64(64 - bits)).astype(np.int64)] = True
        budgets = np.array([int(rate * len(t)) if has_bound(len(t), q, rate) else 0 for t in texts], np.int64)
        needed = np.array([len(t) - q + 1 for t in texts], np.int64) - budgets * q
        return Index(q, [i for i, _ in items], texts, budgets, needed, seen, 64 - bits, hashes, np.append(first, len(h)), item[order], place[order])

    def regions(self, chars: np.ndarray, begins: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, least and largest diagonal) of retained bands; ``chars`` holds texts from ``begins``, parted by NULs that no item has."""
        h = gram_hashes(chars, self.q)
        at = np.flatnonzero(self.seen[(h >> np.uint64(self.shift)).astype(np.int64)])
        if not len(at) or not len(self.hashes):
            return []
        k = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        true = self.hashes[k] == h[at]
        at, k = at[true], k[true]
        n = self.first[k + 1] - self.first[k]
        where = np.repeat(self.first[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        item, place, diagonal = self.item[where], self.place[where], np.repeat(at, n) - self.place[where]
        half = self.budgets[item] + 1
        out = []
        text = np.searchsorted(begins, np.repeat(at, n), "right") - 1
        diagonal = diagonal - begins[text]  # within the text, so that bands do not depend on its neighbours
        for shift in (0, 1):
            band = (diagonal + shift * half) // (2 * half)
            order = np.lexsort((place, band, item, text))
            key = np.stack([text[order], item[order], band[order], place[order]])
            new = np.ones(key.shape[1], bool)
            new[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
            key = key[:, new]  # each place of an item once in a band
            start = np.ones(key.shape[1], bool)
            start[1:] = (key[:3, 1:] != key[:3, :-1]).any(axis=0)
            begin = np.flatnonzero(start)
            count = np.diff(np.append(begin, key.shape[1]))
            t, i, b = key[:3, begin]
            for j in np.flatnonzero(count >= self.needed[i]):
                low = b[j] * 2 * (self.budgets[i[j]] + 1) - shift * (self.budgets[i[j]] + 1)
                out.append((int(t[j]), int(i[j]), int(low), int(low + 2 * self.budgets[i[j]] + 1)))
        return out


def banded_distance(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int]:
    """Least edits that turn ``item`` into a part of ``text`` on an alignment that stays on the diagonals ``low`` .. ``high``, and the part's end; (most + 1, 0) beyond ``most``.

    A row holds the edits after so many characters of the item on each diagonal, so work is len(item) * (high - low + 1).
    """
    width, far = high - low + 1, most + 1
    at = np.arange(low, high + 1)  # the text place of each diagonal before the first character of the item
    steps = np.arange(width)
    row = np.where((at >= 0) & (at <= len(text)), 0, far)
    padded = np.concatenate([np.zeros(1, text.dtype), text, np.zeros(1, text.dtype)])  # place t has text[t - 1]
    for c in item:
        at = at + 1
        inside = (at >= 1) & (at <= len(text))
        now = row + ((padded[np.clip(at, 0, len(text) + 1)] != c) | ~inside)
        now[:-1] = np.minimum(now[:-1], row[1:] + 1)  # the item's character has no counterpart
        now[(at < 0) | (at > len(text))] = far
        row = np.minimum(np.minimum.accumulate(now - steps) + steps, far)  # the text's characters have none
        row[(at < 0) | (at > len(text))] = far
        if row.min() > most:
            return far, 0
    best = int(row.argmin())
    return int(row[best]), int(at[best])


def find(index: Index, texts: list[str]) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, edits, end in the normal text), one for each text and item found: the place of fewest edits, the first of such."""
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    best: dict[tuple[int, int], tuple[int, int]] = {}
    spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for t, i, low, high in index.regions(codes("\0".join(texts)), begins):
        spans.setdefault((t, i), []).append((low, high))
    for (t, i), found in spans.items():
        item, k = index.texts[i], int(index.budgets[i])
        if (at := texts[t].find(item)) >= 0:
            best[t, i] = (0, at + len(item))
            continue
        chars, own = codes(texts[t]), codes(item)
        for low, high in sorted(found):
            edits, end = banded_distance(own, chars, low - k, high + k, k)
            if edits <= k and (edits, end) < best.get((t, i), (k + 1, 0)):
                best[t, i] = (edits, end)
    for i, item in enumerate(index.texts):
        if 0 < len(item) < index.q:
            for t, text in enumerate(texts):
                if (at := text.find(item)) >= 0:
                    best[t, i] = (0, at + len(item))
    yield from ((t, i, e, end) for (t, i), (e, end) in sorted(best.items()))


def indexes(items: list[tuple], q: int, rate: float) -> list[Index]:
    """One index of the items that have a bound for q, one with short grams of the others."""
    long = [has_bound(len(normal(t or "")), q, rate) for _, t in items]
    groups = (([x for x, own in zip(items, long) if own], q), ([x for x, own in zip(items, long) if not own], min(q, SHORT_Q)))
    return [Index.build(group, width, rate) for group, width in groups if group]


def blocks(benchmark: DataFrame, item_id: str, text: str, block_chars: int) -> Iterator[list[tuple]]:
    """The items in the order of their ids, in blocks of so many characters (one item at least)."""
    held, size = [], 0
    for row in benchmark.where(F.col(text).isNotNull()).select(item_id, text).distinct().orderBy(item_id, text).toLocalIterator():
        if held and size + len(row[1]) > block_chars:
            yield held
            held, size = [], 0
        held.append((row[0], row[1]))
        size += len(row[1])
    if held:
        yield held


def leaks(
    docs: DataFrame, benchmark: DataFrame, *, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", q: int = Q, rate: float = RATE, block_chars: int = 2_000_000
) -> DataFrame:
    """(id, item_id, edits, budget, end_at): a row for each row of ``docs`` and item that occurs in it within the item's budget."""
    spark, scratch, parts = docs.sparkSession, Scratch(docs.sparkSession, "leaks"), []
    kinds = f"`{id_column}` {docs.schema[id_column].dataType.simpleString()}, item_id {benchmark.schema[item_id].dataType.simpleString()}, edits int, budget int, end_at bigint"
    kind = to_arrow_type(benchmark.schema[item_id].dataType)
    held = list(blocks(benchmark, item_id, item_text, block_chars))
    for k, block in enumerate(held):
        shared = spark.sparkContext.broadcast(indexes(block, q, rate))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = text_column(batch, "_text")
                for first, end, _, _ in slices(texts, 1 << 20):
                    plain = [normal(t) for t in texts.slice(first, end - first).to_pylist()]
                    rows = [(t, own.ids[i], edits, int(own.budgets[i]), at) for own in shared.value for t, i, edits, at in find(own, plain)]
                    ids = batch.column(0).slice(first, end - first).take(pa.array([r[0] for r in rows], pa.int64()))
                    columns = [pa.array([r[j] for r in rows], t) for j, t in ((1, kind), (2, pa.int32()), (3, pa.int32()), (4, pa.int64()))]
                    yield pa.record_batch([ids, *columns], names=[id_column, "item_id", "edits", "budget", "end_at"])

        part = docs.select(id_column, F.col(text).alias("_text")).mapInArrow(run, kinds)
        if len(held) > 1:  # one block after the other; what is found is written, so that its index can go
            part = scratch.save(part, f"block-{k}")
            shared.unpersist()
        parts.append(part)
    return functools.reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], kinds)


def clean(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", q: int = Q, rate: float = RATE, block_chars: int = 2_000_000) -> DataFrame:
    """The rows of ``docs`` in which no item occurs. Decided by row as the texts stream by, so nothing is shuffled."""
    spark, scratch, extra, schema = docs.sparkSession, Scratch(docs.sparkSession, "clean"), salted(docs), docs.schema
    held = list(blocks(benchmark, item_id, item_text, block_chars))
    for k, block in enumerate(held):
        shared = spark.sparkContext.broadcast(indexes(block, q, rate))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, hit = batch.column(batch.num_columns - 1).cast(pa.large_string()).fill_null(""), set()
                for first, end, _, _ in slices(texts, 1 << 20):
                    plain = [normal(t) for t in texts.slice(first, end - first).to_pylist()]
                    hit |= {first + row[0] for own in shared.value for row in find(own, plain)}
                yield batch.select(range(batch.num_columns - 1)).filter(pa.array([i not in hit for i in range(batch.num_rows)], pa.bool_()))

        docs = docs.withColumn(extra, F.col(text)).mapInArrow(run, schema)
        if len(held) > 1:
            docs = scratch.save(docs, f"block-{k}")
            shared.unpersist()
            if k:
                scratch.drop(f"block-{k - 1}")
    return docs


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
