"""Operator 3, token counts: a map-side two-tier lookup of pre-token lengths.

A piece of the vocabulary never continues over the start of a run of spaces, nor over a line feed (it has none), so
the token count of a text is the sum over its pre-tokens ``" +[^ \\n]*"``, ``"\\n"`` and ``"[^ \\n]+"``. They are found as byte
spans of a slice of texts and made distinct by 64-bit hashes; each distinct one is looked up once for the slice. Tier one is a broadcast
table of the frequent pre-tokens' hashes in order, with their lengths and bytes, which a hit is held against. Tier two encodes a
miss once for each worker's bounded cache.

What is frequent is told by bounded summaries of all texts: each task counts its own pre-tokens and hands on its
``table_size`` most frequent ones, which are summed up by a shuffle of those summaries; pre-tokens with less than one part in
``8 * table_size`` of all are not ranked. Texts and the pre-tokens that occur in them
are never shuffled. Pre-tokens of over ``LONGEST`` bytes are left out of summaries, table and cache and are encoded where they occur, so the table
has ``table_size * (LONGEST + 20)`` bytes at most and a cache some 60 MB. The table only saves time; counts are those of the library, whatever
it holds, unless two different pre-tokens of one slice (``slice_bytes``, or the longest text) have equal 64-bit hashes.

Null and empty texts: 0 bytes, 0 tokens. Ties, repeated rows, equal and null ids: each row is counted by itself. Empty tables: no
rows. Extra columns are neither read nor returned. The longest text bounds a task's memory, at some 40 bytes for each of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import Scratch, slices, span_hashes, text_column

LONGEST = 64
_MARK = "▁".encode()
_PROCESSORS: dict[str, object] = {}
_CACHES: dict[str, Lengths] = {}


def processor(path: str):
    """The worker's own copy of the model."""
    if path not in _PROCESSORS:
        import sentencepiece

        _PROCESSORS[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _PROCESSORS[path]


def splits_at_spaces(path: str) -> bool:
    """Whether the sum over pre-tokens is exact for this model: spaces only at the start of a piece, no line feed in any, and the text taken as it is."""
    model = processor(path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    probe = model.encode(" a  ﬁ ", out_type=str)
    return not any("\n" in p or "▁" in p.lstrip("▁") for p in pieces) and "".join(probe).replace("▁", " ") == "  a  ﬁ "


def pre_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts of a slice as the model takes them, in one run of bytes; starts and ends of their pre-tokens in it; and for each text the number of pre-tokens before it (n + 1 values).

    The model puts a space before each text that is not empty, and its space mark counts as a space.
    """
    raw = data.tobytes()
    if _MARK in raw:
        texts = [raw[a:b].replace(_MARK, b" ") for a, b in zip(offsets, offsets[1:])]
        data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    full = np.diff(offsets) > 0
    data = np.insert(data, offsets[:-1][full], 32)
    offsets = offsets + np.concatenate([[0], np.cumsum(full)])
    space, line = data == 32, data == 10
    start = line | space
    start[1:] &= ~(space[1:] & space[:-1])
    start[1:] |= line[:-1]
    start[offsets[:-1][full]] = True
    starts = np.flatnonzero(start)
    return data.tobytes(), starts, np.append(starts[1:], len(data)), np.searchsorted(starts, offsets)


def distinct(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct spans, the place of one of each, its number of occurrences, and for each span its place among the distinct ones."""
    hashes = span_hashes(np.frombuffer(raw, np.uint8), starts, ends)
    found, first, back, n = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    return found, first, n, back


@dataclass(frozen=True)
class Table:
    """Pre-tokens in the order of their hashes: hashes, lengths, and bytes from ``at`` on."""

    hashes: np.ndarray
    lengths: np.ndarray
    at: np.ndarray
    data: bytes

    @staticmethod
    def build(tokens: list[bytes], lengths: list[int]) -> Table:
        ends = np.cumsum([len(t) for t in tokens], dtype=np.int64) if tokens else np.zeros(0, np.int64)
        starts = np.concatenate([[0], ends])[:-1].astype(np.int64) if tokens else ends
        hashes = span_hashes(np.frombuffer(b"".join(tokens), np.uint8), starts, ends) if tokens else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable").tolist()
        held = [tokens[k] for k in order]
        return Table(hashes[order], np.array([lengths[k] for k in order], np.uint16), np.concatenate([[0], np.cumsum([len(t) for t in held])]).astype(np.int64), b"".join(held))


class Lengths:
    """Pre-token to number of tokens: the broadcast table, then a cache of the worker's own, which starts anew beyond ``most`` entries."""

    def __init__(self, path: str, known: Table, most: int = 300_000):
        self.model, self.known, self.most, self.cache = processor(path), known, most, {}

    def encoded(self, tokens: list[bytes]) -> list[int]:
        """Their numbers of tokens, by the model. It puts a space before what it is given, so a leading space is left out; a line feed ends any merge."""
        given = [t[1:].decode() if t[:1] == b" " else "\n" + t.decode() for t in tokens]
        pieces = self.model.encode(given, num_threads=1) if given else []
        return [max(1, len(p)) if t[:1] == b" " else len(p) - 2 for t, p in zip(tokens, pieces)]

    def look_up(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Lengths of distinct spans with their hashes, which are in order."""
        out, t = np.zeros(len(hashes), np.int64), self.known
        at = np.minimum(np.searchsorted(t.hashes, hashes), max(0, len(t.hashes) - 1))
        hit = t.hashes[at] == hashes if len(t.hashes) else np.zeros(len(hashes), bool)
        same = [raw[a:b] == t.data[x:y] for a, b, x, y in zip(starts[hit].tolist(), ends[hit].tolist(), t.at[at[hit]].tolist(), t.at[at[hit] + 1].tolist())]
        hit[np.flatnonzero(hit)[~np.array(same, bool)]] = False
        out[hit] = t.lengths[at[hit]]
        rest = np.flatnonzero(~hit)
        tokens = [raw[a:b] for a, b in zip(starts[rest].tolist(), ends[rest].tolist())]
        if len(self.cache) + len(tokens) > self.most:
            self.cache.clear()
        missing = [x for x in tokens if x not in self.cache]
        found = dict(zip(missing, self.encoded(missing)))
        out[rest] = [found[x] if x in found else self.cache[x] for x in tokens]
        self.cache.update((x, n) for x, n in found.items() if len(x) <= LONGEST)
        return out

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Token counts of the whole texts of a slice."""
        raw, starts, ends, first = pre_tokens(data, offsets)
        if not len(starts):
            return np.zeros(len(offsets) - 1, np.int64)
        hashes, one, _, back = distinct(raw, starts, ends)
        total = np.concatenate([[0], np.cumsum(self.look_up(raw, starts[one], ends[one], hashes)[back])])
        return total[first[1:]] - total[first[:-1]]


def frequent(docs: DataFrame, text: str, size: int, most: int = 200_000, slice_bytes: int = 4 << 20) -> list[bytes]:
    """The pre-tokens that are frequent over all rows, ``size`` at most. Each task keeps ``most`` counters at a time (halving its least ones out), and hands on ``size``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}

        def top(n: int) -> list[tuple[bytes, int]]:
            return sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:n]

        for batch in batches:
            for _, _, data, offsets in slices(text_column(batch, text), slice_bytes):
                raw, starts, ends, _ = pre_tokens(data, offsets)
                _, one, n, _ = distinct(raw, starts, ends)
                short = ends[one] - starts[one] <= LONGEST
                for a, b, k in zip(starts[one][short].tolist(), ends[one][short].tolist(), n[short].tolist()):
                    token = raw[a:b]
                    counts[token] = counts.get(token, 0) + k
                if len(counts) > most:
                    counts = dict(top(most // 2))
        if counts:
            best = top(size)
            yield pa.record_batch([pa.array([t for t, _ in best], pa.binary()), pa.array([n for _, n in best], pa.int64())], names=["token", "n"])

    scratch = Scratch(docs.sparkSession, "tokens")
    summaries = scratch.save(docs.select(text).mapInArrow(count, "token binary, n bigint"), "summaries")
    total = summaries.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # At most 8 * size pre-tokens have that share of all, so what is ranked has a bound whatever the number of tasks.
    best = summaries.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= total / (8 * size)).orderBy(F.desc("n"), "token").limit(size)
    found = [bytes(r.token) for r in best.collect()]
    scratch.drop("summaries")
    return found


def count_tokens(docs: DataFrame, model_path: str, *, id_column: str = "doc_id", text: str = "text", table_size: int = 16_384, slice_bytes: int = 4 << 20) -> DataFrame:
    """One row for each row of ``docs``: its id, ``n_bytes`` and ``n_tokens`` (long) of its whole text."""
    if not splits_at_spaces(model_path):
        raise ValueError("this model's pieces cross spaces or it changes the text; pre-token sums would not be exact")
    top = frequent(docs, text, table_size, slice_bytes=slice_bytes)
    known = docs.sparkSession.sparkContext.broadcast(Table.build(top, Lengths(model_path, Table.build([], [])).encoded(top)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _CACHES.get(model_path)
        if own is None or own.known is not known.value:
            own = _CACHES[model_path] = Lengths(model_path, known.value)
        for batch in batches:
            texts = text_column(batch, text)
            for first, end, data, offsets in slices(texts, slice_bytes):
                size = pc.binary_length(texts.slice(first, end - first)).cast(pa.int64())
                yield pa.record_batch([batch.column(0).slice(first, end - first), size, pa.array(own.count(data, offsets), pa.int64())], names=[id_column, "n_bytes", "n_tokens"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text).mapInArrow(count, f"`{id_column}` {kind}, n_bytes bigint, n_tokens bigint")


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from faultline.llm.common import table

    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)
