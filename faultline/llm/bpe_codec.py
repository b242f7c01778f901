"""Operator 4, BPE encoding and decoding: content-defined chunk reuse.

A rolling hash over 32 bytes cuts each text into chunks whose ends depend on the content alone, so that passages which
documents share give the same chunks. The inside of a chunk, between its first and last place where white space
follows another character, is encoded once and kept
in the worker's bounded cache. Each join (the last piece of one chunk
and the first of the next) is repaired: the window around it is encoded afresh and accepted where it gives exactly the
ids that both sides have next to it; else the window grows by a piece on each side, over whole chunks where those end, until it agrees
with what is outside of it. Decoding maps ids to bytes.

A chunk is encoded once in each worker, not once in the cluster: a common dictionary would shuffle every chunk twice.
Memory: two generations of ``cache_bytes`` at most, and the longest text, whose ids take up to four times its bytes.

Null and empty texts give no ids and an empty text. Special tokens inside texts are taken as the library takes them.
Ties, repeated rows, equal and null ids are rows of their own; empty tables give no rows; extra columns are neither read nor returned.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import slices, text_column

#: Unicode's white space: fixed values.
WHITE = " \t\n\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space and what follows up to the next white space; no token crosses from one such piece to the next.
PIECE = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: The first and the last place where a piece ends and another begins.
CUT = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")
LAST_CUT = re.compile(f"(?s:.*)[^{WHITE}]([{WHITE}])")
#: How byte-level BPE splits a text before merging: a fixed value of the public GPT-2 format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MASK, LEAST = 0x1FF, 64
_GEAR = np.random.Generator(np.random.PCG64(77)).integers(0, 1 << 32, 256, dtype=np.uint32)
_CODECS: dict[str, Codec] = {}


def boundaries(data: np.ndarray) -> np.ndarray:
    """Places where the rolling hash of the 32 bytes before has its lowest bits at 0, between characters."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):  # the sum of gear[b[i - j]] << j over j < 32, by doubling
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    at = np.flatnonzero((h >> np.uint32(20) & np.uint32(MASK)) == 0) + 1
    at = at[at < len(data)]
    return at[(data[at] & 0xC0) != 0x80]


def byte_table(vocabulary: dict[str, int], special: dict[str, int]) -> list[bytes]:
    """The bytes of each id, by the public byte-to-character rule of byte-level BPE."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    out = [b""] * (max([*vocabulary.values(), *special.values()]) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(byte[c] for c in token)
    for token, i in special.items():
        out[i] = token.encode()
    return out


class Codec:
    """The tokenizer of a worker with its caches."""

    def __init__(self, path: str, cache_bytes: int):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        kind = said["pre_tokenizer"]
        if said["model"]["type"] != "BPE" or said["normalizer"] or kind["type"] != "ByteLevel" or kind["add_prefix_space"] or not kind["use_regex"]:
            raise ValueError("only plain byte-level BPE is supported")
        special = {t["content"]: t["id"] for t in said["added_tokens"]}
        table = byte_table(said["model"]["vocab"], special)
        ranks = {t: i for i, t in enumerate(table) if t and i not in special.values()}
        # The merges in their order make tokens in the order of their ids, so ranks decide alike.
        self.engine = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)._core_bpe
        # A special token with white space can lie across pieces, so windows reach over more pieces than it has.
        spaced = [t for t in special if re.search(f"[{WHITE}]", t)]
        if any(a[-k:] == b[:k] for a in spaced for b in special for k in range(1, min(len(a), len(b)))):
            raise ValueError("special tokens with white space that overlap others are not supported")
        self.reach = max((len(PIECE.findall(t)) + 1 for t in spaced), default=1)
        self.specials, self.mark = set(special), re.compile("|".join(map(re.escape, special)) or "(?!)")
        self.flat = np.frombuffer(b"".join(table), np.uint8)
        self.sizes = np.array([len(t) for t in table], np.int64)
        self.at = np.cumsum(self.sizes) - self.sizes
        self.young, self.old, self.held, self.most = {}, {}, 0, cache_bytes
        self.encoded = 0

    def encode_all(self, text: str) -> np.ndarray:
        self.encoded += 1
        return np.array(self.engine.encode(text, self.specials) if self.mark.search(text) else self.engine.encode_ordinary(text), np.int32)

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found, 0)
        return found

    def put(self, key, value, size: int):
        self.held += size + 300
        if self.held > self.most:
            self.old, self.young, self.held = self.young, {}, 0
        self.young[key] = value
        return value

    def ids(self, text: str) -> np.ndarray:
        found = self.get(text)
        return found if found is not None else self.put(text, self.encode_all(text), 3 * len(text))

    def prepare(self, chunk: bytes) -> tuple:
        """Of a chunk: head, ids of its inside, tail, the first and the last ``reach`` pieces of the inside (None for a chunk without an inside)."""
        found = self.get(chunk)
        if found is not None:
            return found
        text = chunk.decode()
        first, last = CUT.search(text), LAST_CUT.match(text)
        if first is None or (a := first.start()) == (b := last.start(1)):
            return text, None, "", "", ""
        if self.reach > 1:
            pieces = PIECE.findall(text, a, b)
            if len(pieces) < self.reach:
                return text, None, "", "", ""
            outer = "".join(pieces[: self.reach]), "".join(pieces[-self.reach :])
        else:
            inner = LAST_CUT.match(text, a, b)
            outer = PIECE.match(text, a, b)[0], text[inner.start(1) if inner else a : b]
        ids = self.encode_all(text[a:b])
        return self.put(chunk, (text[:a], ids, text[b:], *outer), 2 * len(chunk) + 4 * len(ids))

    def join(self, last: str, middle: str, first: str) -> np.ndarray | None:
        """Ids of ``middle`` between pieces known on its left and on its right; None if the window does not agree with both."""
        left, right = self.ids(last) if last else _NONE, self.ids(first) if first else _NONE
        key = (last, middle, first)
        window = self.get(key)
        if window is None:
            window = self.put(key, self.encode_all(last + middle + first), 3 * (len(last) + len(middle) + len(first)))
        return _between(window, left, right)

    def widen(self, before: str, done: np.ndarray, middle: str, inside: str, ids: np.ndarray) -> np.ndarray | None:
        """Ids of all of ``before``, ``middle`` and ``inside``, where ``done`` and ``ids`` are known of the first and the last.

        The window takes one more piece on each side until it begins and ends with the ids of its outermost pieces and the known ids
        go on from there. At the text's end (``inside`` empty) and at its beginning there is nothing to agree with; None where
        the window would have to go beyond the inside.
        """
        pieces, after = PIECE.findall(before), PIECE.findall(inside)
        n = self.reach
        for k in range(n + 1, len(after) + 1 if inside else max(len(pieces), n) + 2):
            start, end = "".join(pieces[-k:]) if k <= len(pieces) else before, "".join(after[:k])
            a = self.ids("".join(pieces[len(pieces) - k : len(pieces) - k + n])) if k <= len(pieces) else _NONE
            b = self.ids("".join(after[k - n : k])) if inside else _NONE
            left, right = self.encode_all(start), self.encode_all(end)
            cut = len(done) - len(left) if k <= len(pieces) else 0
            if cut < 0 or len(right) > len(ids) or cut and not np.array_equal(done[cut:], left) or not np.array_equal(ids[: len(right)], right):
                continue
            inner = _between(self.encode_all(start + middle + end), a, b)
            if inner is not None:
                return np.concatenate([done[:cut], a, inner, b, ids[len(right) :]])
        return None

    def assemble(self, chunks: list[bytes]) -> list[np.ndarray]:
        """The ids of a text that its chunks make up."""
        out, last, open_text = [], "", ""
        for k, chunk in enumerate([*chunks, b""]):  # after the last chunk comes the text's end
            head, ids, tail, first, final = self.prepare(chunk) if chunk else ("", _NONE, "", "", "")
            open_text += head
            if ids is None:
                continue
            middle = self.join(last, open_text, first)
            if middle is not None:
                out += [middle, ids]
            else:
                before = b"".join(chunks[:k]).decode() + head
                inside = chunk.decode()[len(head) : len(chunk.decode()) - len(tail)]
                wider = self.widen(before[: len(before) - len(open_text)], np.concatenate([_NONE, *out]), open_text, inside, ids)
                if wider is None:  # the window takes the whole chunk in
                    open_text += inside + tail
                    continue
                out = [wider]
            last, open_text = final, tail
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, and each text's end among them."""
        cuts, raw = boundaries(data), data.tobytes()
        parts, sizes = [], []
        for k in range(len(offsets) - 1):
            a, b = int(offsets[k]), int(offsets[k + 1])
            places = [a]
            for c in cuts[np.searchsorted(cuts, a + LEAST) : np.searchsorted(cuts, b)].tolist():
                if c - places[-1] >= LEAST:
                    places.append(c)
            places.append(b)
            mine = self.assemble([raw[x:y] for x, y in zip(places, places[1:])]) if b > a else []
            parts += mine
            sizes.append(sum(map(len, mine)))
        return np.concatenate(parts) if parts else _NONE, np.cumsum(sizes)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Texts of runs of ids; bytes that are no UTF-8 become U+FFFD, as in the library."""
        sizes = self.sizes[ids]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        data = self.flat[np.repeat(self.at[ids] - bounds[:-1], sizes) + np.arange(bounds[-1])].tobytes()
        places = bounds[np.concatenate([[0], ends])]
        try:
            data.decode()
            texts = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(places.astype(np.int64)), pa.py_buffer(data))
            if not any(x < len(data) and data[x] & 0xC0 == 0x80 for x in places.tolist()):
                return texts.cast(pa.string())
        except UnicodeDecodeError:
            pass
        return pa.array([data[a:b].decode(errors="replace") for a, b in zip(places, places[1:])], pa.string())


_NONE = np.zeros(0, np.int32)


def _between(window: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray | None:
    """What stands between ``left`` and ``right`` in the window; None if it does not begin and end with them."""
    end = len(window) - len(right)
    if end < len(left) or not np.array_equal(window[: len(left)], left) or not np.array_equal(window[end:], right):
        return None
    return window[len(left) : end]


def codec(path: str, cache_bytes: int = 48 << 20) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path, cache_bytes)
    return _CODECS[path]


def encode_and_decode(docs: DataFrame, tokenizer_path: str, *, id_column: str = "doc_id", text: str = "text", slice_bytes: int = 1 << 20) -> DataFrame:
    """One row for each row of ``docs``: its id, ``ids`` (array of int) and ``decoded`` (the text that the ids give)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer_path)
        for batch in batches:
            for first, end, data, offsets in slices(text_column(batch, text), slice_bytes):
                ids, ends = own.encode(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.record_batch([batch.column(0).slice(first, end - first), lists, own.decode(ids, ends)], names=[id_column, "ids", "decoded"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>, decoded string")


def digests() -> list[Column]:
    """n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256 of what ``encode_and_decode`` returns."""
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return [F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")]


def op4_bpe_codec(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from faultline.llm.common import table

    return encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", *digests())
