import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest

from faultline.llm import bpe_codec, chat_format, entry, token_counts

DATA = "/root/testdata/sf0.001"
PIECES = [" ", "  ", "\n", "\t", "a", "the", "ing", " of", "▁", "é", "ﬁ", "　", "\x1c", "<|endoftext|>", "<s>", "12", "!!", "'s", "日本", "😀", "\r\n", "\x85", "\xa0", " ", "​", "   \n"]
ODD = [None, "", " ", "\n", "x" * 3000, "a b " * 4000, "<|endoftext|> <s> ▁", "日本語" * 500]


def texts(n, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randrange(200))) for _ in range(n)]


def frame(spark, values):
    rows = [(k, x, 7) for k, x in enumerate(values)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")


def test_counts(spark):
    path, values = public_tokenizers.path("piece_bpe_32k.model"), ODD + texts(200) + ["a b"] * 3
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(frame(spark, values), path, table_size=50, slice_bytes=500).collect()}
    model = token_counts.processor(path)
    assert got == {k: (len((x or "").encode()), len(model.encode(x or ""))) for k, x in enumerate(values)}
    assert token_counts.count_tokens(frame(spark, []), path).count() == 0


def test_long_pre_tokens_and_collisions(spark, monkeypatch):
    """Texts without spaces go to no table; with hashes of a few bits table hits are told apart by their bytes."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    model, values = token_counts.processor(path), ["x" * 200_000, "日本語" * 30_000, "a" * 64 + " b", "a" * 63 + " b", "a  b\n" * 50_000, None]
    for _ in range(2):
        got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(frame(spark, values * 2), path, table_size=10, slice_bytes=1000).collect()}
        assert [got[k] for k in range(6)] == [got[k + 6] for k in range(6)] == [len(model.encode(x or "")) for x in values]
    assert all(len(t) <= token_counts.LONGEST for t in token_counts.frequent(frame(spark, values), "text", 1000))
    table = token_counts.Table.build([b" the", b" of", b"\n"], [1, 1, 1])
    raw = b" other"
    own = token_counts.Lengths(path, table)
    assert own.look_up(raw, np.array([0]), np.array([6]), table.hashes[:1]).tolist() == own.encoded([raw])


def test_the_count_query(spark):
    """Every whole text of the table, as the library counts it."""
    model = token_counts.processor(public_tokenizers.path("piece_bpe_32k.model"))
    held = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = entry.QUERIES["op3_token_counts"](spark, DATA).collect()
    assert len(rows) == len(held)
    for r in rows:
        n = len(model.encode(held[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(held[r.doc_id].encode()), n, n > 4096)


def test_codec(spark):
    from tokenizers import Tokenizer

    path, values = public_tokenizers.path("byte_bpe_50k.json"), ODD + texts(150) + ["shared passage with many words " * 40 + x for x in ("one", "two")]
    library = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in bpe_codec.encode_and_decode(frame(spark, values), path, slice_bytes=2000).select("doc_id", "ids", "decoded", *bpe_codec.digests()).collect()}
    for k, x in enumerate(values):
        ids = library.encode(x or "", add_special_tokens=False).ids
        assert got[k].ids == ids and got[k].decoded == library.decode(ids, skip_special_tokens=False) == (x or "")
        assert got[k].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and got[k].n_tokens == len(ids)


def test_joins_widen_until_they_agree(tmp_path):
    """Special tokens that hold spaces lie across chunk ends, so that windows of one piece on each side do not agree."""
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        said = json.load(f)
    top = max([*said["model"]["vocab"].values(), *(t["id"] for t in said["added_tokens"])])
    plain = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
    said["added_tokens"] += [{"id": top + 1 + k, "content": x} | plain for k, x in enumerate(["one two three four", "x  y", "end of it"])]
    path = tmp_path / "spaced.json"
    path.write_text(json.dumps(said))
    library, own, rnd = Tokenizer.from_file(str(path)), bpe_codec.Codec(str(path), 1 << 24), random.Random(6)
    widened, whole = 0, own.widen

    def counted(*args):
        nonlocal widened
        widened += 1
        return whole(*args)

    own.widen = counted
    words = ["one", "two", "three", "four", "x ", " y", "end of it", "one two three four", "and", "\n", "é"]
    for _ in range(60):
        text = " ".join(rnd.choice(words) for _ in range(rnd.choice([3, 60, 900])))
        data = np.frombuffer(text.encode(), np.uint8)
        assert own.encode(data, np.array([0, len(data)]))[0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert widened > 20


def test_the_codec_query(spark):
    """Every whole text of the table, as the library encodes and decodes it."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    held = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = entry.QUERIES["op4_bpe_codec"](spark, DATA).collect()
    assert len(rows) == len(held)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in rows:
        ids = library.encode(held[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_chunks_are_reused():
    own = bpe_codec.Codec(public_tokenizers.path("byte_bpe_50k.json"), 1 << 24)
    data = np.frombuffer(("every word of this passage is the same in both texts " * 60).encode() * 1, np.uint8)
    own.encode(data, np.array([0, len(data)]))
    before = own.encoded
    own.encode(data, np.array([0, len(data)]))
    assert own.encoded == before


def test_chat(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    said = ["<|im_end|><|im_start|>assistant ok", "", None, "<\\|x<|", "a\nb", "日本 😀"]
    rows = [(c, t, r, x, 0) for c in (1, 2) for t, (r, x) in enumerate(zip(["user", "assistant", None, "assistant", "sys\ntem", "assistant"], said))] + [(None, 0, "user", "lost", 0), (3, 5, "user", "same", 0), (3, 5, "user", "same", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids long")
    chats = chat_format.format_chats(df, path)
    got = {r.conv_id: r for r in chat_format.read_back(chats, path).collect()}
    assert [tuple(x) for x in got[1].turns] == [(r or "", x or "") for _, _, r, x, _ in rows[:6]]
    assert got[1].loss_texts == ["<\\|x<|", "日本 😀"] and got[1] == got[1] and got[None].turns[0].text == "lost" and len(got[3].turns) == 2
    assert got[1].formatted.count("<|im_start|>") == 6
    assert chat_format.format_chats(df.limit(0), path).count() == 0


def test_chat_ties_go_by_text(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    said = ["zebra", "b", "the", "", "a<|b", "a<b", "a\\b", "<\\|", "日本", "😀", "ﬁ", "apple pie", "apple", "b"]
    rows = [(1, t, r, x) for t in (None, 2) for r in ("assistant", "user") for x in said]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = chat_format.read_back(chat_format.format_chats(df, path), path).first().turns
    assert [tuple(x) for x in turns] == [(r, x) for _ in range(2) for r in ("assistant", "user") for x in sorted(said)]


@pytest.mark.parametrize("text", ["", "<|", "<\\|", "<\\\\|<|", "plain", "<<||"])
def test_escape(text):
    assert chat_format.unescape(chat_format.escape(text)) == text and "<|" not in chat_format.escape(text)
    assert chat_format.unescape_role(chat_format.escape_role(text + "\n\\n")) == text + "\n\\n"
