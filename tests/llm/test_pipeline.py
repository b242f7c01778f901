import hashlib

import corpus_pipeline
import public_tokenizers
from faultline.llm import decontamination, language_id, quality_rules
from faultline.llm.common import Scratch, table
from tests.llm.test_documents import brute_components, brute_statistics

DATA = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    from tokenizers import Tokenizer

    docs, scratch = table(spark, DATA, "documents"), Scratch(spark, "stages")
    columns, held = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.save(stage(spark, docs, DATA), name)
        outs.append(docs)
        assert name == "bpe" or docs.columns == columns
    quality, language, dedup, clean, bpe = ({r.doc_id for r in o.collect()} for o in outs)
    # The base rules hold for all that is kept; learned rules only remove more.
    passing = {k for k, x in held.items() if (s := brute_statistics(x))[0] >= 50 and 2 * s[4] <= s[0]}
    assert quality <= passing and len(quality) >= 0.8 * len(passing) and language <= quality and len(language) >= 0.97 * len(quality)
    order = sorted(language)
    found = brute_components([held[k] for k in order], 5, 80)
    assert dedup == {order[k] for k, (_, c) in found.items() if k == c}
    items = [decontamination.normal(r.text) for r in table(spark, DATA, "benchmark").collect()]
    assert clean <= dedup and not any(i in decontamination.normal(held[k]) for k in clean for i in items)
    assert all(any(i[: len(i) // 2] in decontamination.normal(held[k]) or i[len(i) // 2 :] in decontamination.normal(held[k]) for i in items) for k in dedup - clean)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in outs[-1].collect():
        ids = library.encode(held[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(held[r.doc_id].encode()).hexdigest()
    assert bpe == clean and language_id and quality_rules


def test_odd_rows_pass_through(spark):
    """Nulls, repeated rows and ids, very long texts, columns with clashing names, and tables that run empty."""
    docs = table(spark, DATA, "documents").limit(60)
    kept = [r for r in quality_rules.keep(docs, []).collect() if r.lang]
    long = " ".join(r.text for r in kept) * 30
    odd = [(None, kept[0].text, "en"), (None, None, None), (900_001, "", "en"), (900_002, " \n", None), (900_003, long, kept[0].lang), (kept[1].doc_id, kept[1].text, kept[1].lang)]
    more = spark.createDataFrame([(i, t, x, "s", 0) for i, t, x in odd], docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    held = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(more).selectExpr("*", "1 as _id", "'x' as _text", "2 as node", "doc_id as mark", "'y' as kept", "0 as s")
    for given in (held, held.limit(0)):
        out, scratch = given, Scratch(spark, "odd")
        for name, stage in corpus_pipeline.STAGES:
            out = scratch.save(stage(spark, out, DATA), name)
            assert name == "bpe" or out.columns == given.columns
        ids = [r.doc_id for r in out.collect()]
        assert not {900_001, 900_002} & set(ids) and (given is held) == bool(ids)
