import json
import urllib.error
import zipfile
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline import vocabulary as v
from faultline.functions.text import first_evidence
from faultline.operators import causal, cases, extraction, fusion, graph, privacy, votes
from faultline.plans.pipeline import STAGES, Run, run_stages
from faultline.settings import Causal, Extraction, Fusion, GraphDatabase, Settings, load_settings
from faultline.sources import documents, jsonl
from faultline.sources import graph as sinks
from faultline.sources.ports import DryRun, HashEmbedder, HttpService, evidence_of
from faultline.streaming import resume

PARAGRAPHS = ["前言说明", "【案例1】 示例坍塌事故", "【事故类别】坍塌", "直接原因：未设置支护", "【补充】现场无人巡查", "第二章 其他", "事故案例 2-1", "示例触电事故", "时间： 2001年1月1日"]


def paragraphs(spark, rows=PARAGRAPHS):
    return spark.createDataFrame([("sample.docx", 0, k, x) for k, x in enumerate(rows)], "source_file string, file_seq int, para_no int, text string")


def test_cases(spark):
    a, b = cases.build_cases(paragraphs(spark), 1).orderBy("seq").collect()
    assert (a.case_id, a.source_case_no, a.title, a.accident_type) == ("HCA-920ebaac83", "1", "示例坍塌事故", "坍塌")
    assert a.direct_cause_text == "未设置支护\n现场无人巡查" and "第二章 其他" in a.raw_text and a.measures_text == ""
    assert (b.case_id, b.source_case_no, b.title, b.time) == ("HCA-77fc21c12f", "2-1", "示例触电事故", "2001年1月1日")
    assert cases.build_cases(paragraphs(spark), 10_000).count() == 0
    assert cases.build_cases(paragraphs(spark).repartition(7), 1).count() == 2


def test_documents(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = f"{p('一')}<w:tbl><w:tr><w:tc>{p('甲')}</w:tc><w:tc>{p('乙')}</w:tc></w:tr></w:tbl>{p(' ')}{p('二')}"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    (tmp_path / "b.txt").write_text("x\n\n y　z \n", encoding="utf-8")
    rows = documents.read_paragraphs(spark, f"{tmp_path}/a.docx", f"{tmp_path}/b.txt").orderBy("seq").collect()
    assert [(r.source_file, r.text) for r in rows] == [("a.docx", "一"), ("a.docx", "二"), ("a.docx", "甲 | 乙"), ("b.txt", "x"), ("b.txt", "y z")]
    for bad in ("x.doc", "x.pdf"):
        with pytest.raises(ValueError):
            documents.read_paragraphs(spark, bad)


def test_json_lines(spark, tmp_path):
    df = spark.createDataFrame([("甲", None), ("b", 2)], "a string, b int")
    assert jsonl.write_jsonl(df, f"{tmp_path}/x") == 2 and jsonl.append_jsonl(df, f"{tmp_path}/x") == 2
    assert jsonl.read_jsonl(spark, f"{tmp_path}/x", df.schema).count() == 4
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n\n{oops\n')
    with pytest.raises(Exception):
        jsonl.read_jsonl(spark, f"{tmp_path}/bad.jsonl", "a int").collect()
    jsonl.reset(spark, f"{tmp_path}/x")
    assert not jsonl.exists(spark, f"{tmp_path}/x")


def test_privacy(spark):
    m = privacy.Masker()
    assert m.text("死者张某在基坑作业。") == "死者A在基坑作业。" and m.counts() == (1, 0, 0)
    df = spark.createDataFrame([("死者张某在基坑作业。", "张某未系安全带", ["张某"], 1), ("伤者李某在现场。", None, None, 2)], "raw_text string, title string, aliases array<string>, n int")
    rows = privacy.anonymize(df).orderBy("n").collect()
    assert [tuple(r)[:3] for r in rows] == [("死者A在基坑作业。", "死者A未系安全带", ["死者A"]), ("伤者A在现场。", None, None)]
    assert privacy.report(privacy.anonymize(df)).first().n_persons == 2
    both = privacy.anonymize(spark.createDataFrame([("某某水电有限公司", "张某")], "raw_text string, k string")).first()
    assert (both.raw_text, both.k, both.privacy_status) == (privacy.Masker().text("某某水电有限公司"), "张某", "anonymized")
    letters = privacy.Masker()
    assert [letters.name("person", str(k), "P") for k in range(28)][-3:] == ["PZ", "P27", "P28"]


def test_patterns_run_on_what_they_need(monkeypatch):
    """Texts without what a pattern needs are not searched, and no match is lost by that."""
    steps = [s for s in privacy._STEPS if isinstance(s, privacy.Step)]
    bits = [x for s in steps for x in s.needs] + list("张王李某、（男）第一3A在由，。 ab") + ["有限公司", "有限责任公司", "监理部", "集团公司", "水电站", "水电一局", "C2标", "张三分包队", "第一工程处", "死者张、李", "伤者张某，", "张三（男", "某某"]
    rng = np.random.default_rng(3)
    hits = [0] * len(steps)
    for _ in range(4000):
        text = "".join(rng.choice(bits, rng.integers(1, 12)))
        for k, s in enumerate(steps):
            found = s.pattern.search(text)
            hits[k] += found is not None
            assert found is None or any(x in found[0] or x in text for x in s.needs), (s.pattern.pattern, text)
            assert s(privacy.Masker(), text) == s.pattern.sub(lambda m, s=s, masker=privacy.Masker(): s.stand_in(masker, m), text)
    assert min(hits) > 0
    for s in steps:
        monkeypatch.setattr(s, "pattern", None)
    assert privacy.Masker().text("Ein langer Text, déjà vu. " * 1000) == "Ein langer Text, déjà vu. " * 1000


def test_votes(spark):
    rows = [("a", 0, "yes", 0.6), ("a", 1, "no", 0.9), ("a", 2, "是", 0.8), ("b", 0, "yes", 0.7), ("b", 1, "no", 0.7), ("c", 0, "no", 0.2), ("c", 1, "no", 0.4), ("c", 2, "maybe", 0.4)]
    df = spark.createDataFrame(rows, "k string, vote_idx int, answer string, confidence double")
    got = {r.k: (r.answer, r.margin, r.accepted, r.needs_review, r.confidence, r.vote_idx) for r in votes.tally(df, ["k"]).collect()}
    assert got == {"a": ("yes", 1, True, False, 0.8, 2), "b": ("no", 0, False, True, 0.7, 1), "c": ("no", 3, False, False, 0.4, 1)}
    assert {r.k: (r.yes, r.no, r.accepted) for r in votes.tally_counts(df, ["k"]).collect()} == {"a": (2, 1, True), "b": (1, 1, False), "c": (0, 3, False)}


def test_validation(spark):
    rows = [("no", "x", "", "", ""), ("yes", "x", "", "", ""), ("yes", "SafetyCultureDefect", "l", "方案有误", "长期"), ("yes", "SafetyCultureDefect", "l", "抢工期", ""), ("yes", "SafetyCultureDefect", "l", "e", "r"), ("yes", "UnsafeAction", "l", "e", "")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, answer string, entity_type string, label string, evidence_text string, rationale string")
    got = [r.errors for r in votes.validate_decisions(df).orderBy("k").collect()]
    assert got == [[], ["entity_type_illegal", "label_missing", "evidence_missing"], ["management_evidence_only"], [], ["culture_marker_missing"], []]


def test_dedupe_decisions(spark):
    rows = [(1, True, "q", "SafetyCultureDefect", "抢工期", 2, 0.5), (2, False, "q", "t", "x", 0, 0.1), (3, True, "q", "SafetyCultureDefect", "重生产", 3, 0.5), (4, True, "q", "SafetyCultureDefect", "进度", 3, 0.5)]
    df = spark.createDataFrame(rows, "seq long, accepted boolean, question_id string, entity_type string, label string, yes int, confidence double").withColumns({"c": F.lit(1), "relation_type": F.lit("r")})
    assert [(r.seq, r.label) for r in votes.dedupe_decisions(df, ["c"]).orderBy("pos").collect()] == [(2, "x"), (3, "重进度轻安全")]


def test_relationship_merge(spark):
    rows = [(1, "c1", "e1", 3, 0, "valid"), (2, "c1", "e2", 2, 1, "valid"), (3, "c2", "e1", 1, 2, "")]
    df = spark.createDataFrame(rows, "seq long, case_id string, evidence_text string, vote_yes_count long, vote_no_count long, validation_status string").withColumns({"source_id": F.lit("a"), "type": F.lit("t"), "target_id": F.lit("b")})
    r = graph.merge_relationships(df).first()
    assert (r.weight, r.case_count, r.evidence_count, r.avg_confidence, r.validation_status, r.source_cases, r.evidence_texts) == (3, 2, 2, 0.0, "needs_review", ["c1", "c2"], ["e1", "e2"])
    assert abs(r.vote_yes_ratio - 6 / 9) < 1e-12


def test_thresholds(spark):
    df = spark.createDataFrame([(None,), (0.8,), (0.7999,), (0.68,), (0.6799,)], "s double")
    assert [r[0] for r in df.select(fusion.decide(F.col("s"))).collect()] == ["nil_no_candidate", "matched", "review_low_margin", "review_low_margin", "nil_low_score"]


def test_fusion_is_an_ordered_fold(spark):
    rows = [(1, "未系安全带", "UnsafeAction"), (2, "未戴安全带", "UnsafeAction"), (3, "abcd", "UnsafeAction"), (4, "bcde", "UnsafeAction"), (5, "未系安全带", "Other"), (6, "c", "AccidentCase")]
    df = spark.createDataFrame([(f"id{s}", s, n, lb, n, f"case{s}", False) for s, n, lb in rows], "id string, seq long, name string, label string, normalized_name string, case_id string, needs_review boolean")
    how = Fusion(use_embeddings=False)
    got = {r.seq: (r.alignment_status, r.canonical_id) for r in fusion.fuse(df, how).collect()}
    assert [got[k][0] for k in range(1, 7)] == ["nil_no_candidate", "matched", "nil_no_candidate", "review_low_margin", "nil_no_candidate", "preserved_case_identity"]
    assert got[1][1] == got[2][1] != got[5][1]
    merged = {r.id: r for r in fusion.canonical_entities(df, fusion.fuse(df, how)).collect()}
    assert len(merged) == 5 and merged[got[1][1]].mention_count == 2 and merged[got[1][1]].aliases == ["未系安全带", "未戴安全带"] or merged[got[1][1]].mention_count == 2
    assert merged[got[3][1]].mention_count is None and merged[got[4][1]].needs_review
    assert fusion.name_conflicts(df).first().labels == ["Other", "UnsafeAction"] and fusion.margin_conflicts(fusion.fuse(df, how)).count() == 1
    sets = {r.source_entity_id: r.canonical_id for r in fusion.fuse_sets(df, how).collect()}
    assert sets["id1"] == sets["id2"] and len(set(sets.values())) == 5
    vectors = fusion.embed_missing(spark.createDataFrame([("未系安全带",), ("未戴安全带",), ("未戴安全带",)], "text string"), spark.createDataFrame([], "text string, embedding array<double>"), HashEmbedder)
    assert vectors.count() == 2 and fusion.fuse(df, Fusion(), vectors).count() == 6
    found = fusion.recall(df.select(F.col("id").alias("mention_id"), "label", F.col("name").alias("norm")), df.select(F.col("id").alias("canonical_id"), "label", F.col("name").alias("norm"), F.array("name").alias("names"), "seq"))
    assert {(r.mention_id, r.canonical_id, r["rank"]) for r in found.where("mention_id = 'id2'").collect()} == {("id2", "id2", 1), ("id2", "id1", 2)}


TABLES = [(416, 33, 7, 0, "low_control_support:7<min_support:20"), (408, 32, 15, 1, "low_control_support:16<min_support:20"), (384, 25, 39, 8, ""), (285, 19, 138, 14, ""), (21, 0, 402, 33, "separation_or_empty_cell:[21, 0, 402, 33]"), (17, 3, 406, 30, ""), (20, 0, 403, 33, "separation_or_empty_cell:[20, 0, 403, 33]"), (5, 1, 400, 50, "low_support:6<min_support:20")]


def test_contingency(spark):
    df = spark.createDataFrame([t[:4] for t in TABLES], "treated_severe_n long, treated_nonsevere_n long, control_severe_n long, control_nonsevere_n long")
    rows = causal.risk_summary(df).withColumn("why", causal.skip_reason(20)).collect()
    assert [r.why for r in rows] == [t[4] for t in TABLES]
    assert [round(r.unadjusted_risk_difference, 4) for r in rows[:4]] == [-0.0735, -0.0102, 0.1091, 0.0296]


def test_effects(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    t, c = rng.integers(0, 2, 400), rng.integers(0, 2, 400)
    y = ((0.3 * t + 0.2 * c + rng.random(400)) > 0.7).astype(int)
    wide = spark.createDataFrame([(int(k), int(a), int(b), int(b), int(d)) for k, (a, b, d) in enumerate(zip(t, c, y))], "case_id long, t int, c int, c2 int, y int")
    x = np.column_stack([np.ones(400), t, c, c])
    want = np.linalg.lstsq(x, y.astype(float), rcond=None)[0][1]
    assert abs(causal.linear_effect(wide, "t", "y", ["c", "c2"]) - want) < 1e-9  # collinear
    rows = causal.design_cells(wide.repartition(5), {"d": ["t", "c", "c2"], "e": ["t"]}, "y").collect()
    cells = causal.Cells.of([(r["mask"], r.y, r.n) for r in rows if r.design == "d"], 3)
    assert abs(cells.effect() - want) < 1e-9 and cells.n.sum() == 400
    alone = causal.Cells.of([(r["mask"], r.y, r.n) for r in rows if r.design == "e"], 1)
    assert alone.table() == {n: int(((t == a) & (y == b)).sum()) for n, a, b in causal.TABLE_CELLS}
    # Rows drawn one by one, as the cells' draws stand for them.
    drawn = [np.linalg.lstsq(x[i], y[i].astype(float), rcond=None)[0][1] for i in (rng.integers(0, 400, 400) for _ in range(400))]
    boot = cells.bootstrap(400, 1)
    assert boot["bootstrap_n"] == 400 and boot["ci95_low"] < want < boot["ci95_high"] and boot["p_value_normal_approx"] < 0.01
    assert abs(boot["bootstrap_se"] / np.std(drawn, ddof=1) - 1) < 0.2 and boot == cells.bootstrap(400, 1)
    dealt = [np.linalg.lstsq(np.column_stack([np.ones(400), rng.permutation(t), c]), y.astype(float), rcond=None)[0][1] for _ in range(400)]
    placebo = cells.placebo(400, 2)
    assert abs(np.mean(placebo)) < 0.02 and abs(np.std(placebo) / np.std(dealt) - 1) < 0.2
    noisy = cells.random_cause(200, 3)
    assert abs(np.mean(noisy) - want) < 0.01 and 0 < np.std(noisy) < 0.02
    assert causal.refutation("r", want, placebo, 0.0)["p_value"] > 0.05 and causal.refutation("r", want, [1.0, 2.0], 0.0)["p_value"] == 0.0
    many = causal.deal(rng, np.array([4 * 10**9, 10**9]), 10**9)
    assert many.sum() == 10**9 and abs(many[0] / 10**9 - 0.8) < 0.001
    for n, cell in enumerate(TABLES):
        assert causal.why_skipped(dict(zip([c[0] for c in causal.TABLE_CELLS], cell)), 20) == cell[4], n


def test_dot():
    assert causal.dot_edges().splitlines()[1] == '  "SafetyCultureDefect" -> "SafetyManagementDefect";' and len(v.CAUSAL_EDGES) == 11
    assert causal.treatment_edges("t", "y", ["c"]) == [("t", "y"), ("c", "t"), ("c", "y")]


def case_rows(spark, n):
    return spark.createDataFrame([(f"HCA-{k}", "f.docx", f"案例{k}", f"第{k}号现场未设置支护导致坍塌。", "", "", k) for k in range(n)], "case_id string, source_file string, title string, raw_text string, consequence_text string, economic_loss_text string, seq long")


def test_dry_run_counts(spark, tmp_path):
    n, known = 3, case_rows(spark, 3)
    save = lambda d, name: (d.write.mode("overwrite").parquet(f"{tmp_path}/{name}"), spark.read.parquet(f"{tmp_path}/{name}"))[1]
    found = extraction.extract(known, DryRun, Extraction(), save)
    assert (found["nodes"].count(), found["edges"].count()) == (8 * n, 13 * n)
    kinds = {r.type: r["count"] for r in found["edges"].groupBy("type").count().collect()}
    assert kinds == {"hasDirectCause": 2 * n, "hasCapabilityCause": 4 * n, "hasManagementCause": 5 * n, "leadTo": n, "controlledBy": n}
    assert found["results"].where("needs_review").count() == n and found["decisions"].where("stage = 'culture' and accepted").count() == 0
    at = lambda d: d.join(known.select("case_id", "source_file", known.seq.alias("_k")), "case_id").withColumn("seq", F.col("seq") + 100_000 * F.col("_k"))
    nodes, edges = graph.build_from_extraction(found["results"], at(found["nodes"]), at(found["edges"]))
    nodes, edges = save(nodes, "n"), save(edges, "e")
    assert (nodes.count(), edges.count()) == (n + 6, 13 * n)
    alignment = fusion.fuse(nodes, Fusion(use_embeddings=False))
    merged = graph.merge_relationships(graph.remap(edges, alignment))
    assert sorted(r.weight for r in merged.collect()) == sorted([1] * (2 * n) + [4 * n, 5 * n, n, n])


def test_graph_from_cases(spark):
    df = spark.createDataFrame([("c1", "f", "t", "坍塌", "死亡", "支护不足", "加固", 0), ("c2", "f", "t", "坍塌", "", "", "加固", 1)], "case_id string, source_file string, title string, accident_type string, consequence_text string, direct_cause_text string, measures_text string, seq long")
    nodes, edges = graph.build_from_cases(df)
    assert nodes.count() == 6 and sorted(r.type for r in edges.collect()) == ["controlledBy", "hasAccidentType", "hasAccidentType", "hasConsequence", "hasDirectCause"]
    checked = graph.check_relations(edges, nodes, graph.relation_table(spark))
    assert checked.where("valid").count() == 5 and graph.graph_validity(checked).first() == (True, 0)
    wrong = graph.check_relations(edges.withColumn("type", F.lit("nope")), nodes, graph.relation_table(spark))
    assert wrong.first().errors == ["relation_illegal"]
    rows = sinks.export_rows(nodes.withColumn("l", F.array(F.lit("a"), F.lit("b")))).first()
    assert list(rows.asDict()) == sorted(rows.asDict()) and rows.l == "['a', 'b']"


class Memory:
    def ping(self):
        return True

    def clear(self):
        pass

    def ensure_unique_id(self):
        pass

    def merge_nodes(self, rows):
        assert all(r["id"] for r in rows)

    def merge_edges(self, rows):
        assert all(r["source_id"] for r in rows)


def test_service_tries_again_within_bounds(monkeypatch):
    service, waits, said = HttpService(replace(Settings().service, api_key="k", base_url="http://x", max_retries=4)), [], []
    monkeypatch.setattr("time.sleep", waits.append)
    answers = [OSError("lost"), {"choices": []}, urllib.error.HTTPError("u", 503, "busy", {}, None), {"choices": [{"message": {"content": "{\"a\": 1}"}}]}]

    def post(path, body):
        said.append(path)
        x = answers.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    monkeypatch.setattr(service, "_post", post)
    assert service.json_chat("p") == {"a": 1} and waits == [1, 2, 4] and not answers
    answers += [urllib.error.HTTPError("u", 401, "no", {}, None)]
    with pytest.raises(RuntimeError):
        service.json_chat("p")
    answers += [OSError("lost")] * 4
    with pytest.raises(RuntimeError):
        service.json_chat("p")
    assert len(said) == 9


def test_dry_run_answers(spark):
    asked = '"question_id": "Q1" "entity_type": "" "relation_type": "leadTo"\n事故文本： 短。\n现场未设置支护导致坍塌。其后'
    got = DryRun().json_chat(asked)
    assert (got["question_id"], got["entity_type"], got["relation_type"], got["answer"], got["evidence_text"]) == ("Q1", "UnsafeObjectState", "leadTo", "yes", "现场未设置支护导致坍塌")
    assert DryRun().json_chat("事故文本：平安")["answer"] == "no" and DryRun().json_chat("事故文本：平安")["question_id"] == "DRY_RUN"
    texts = [asked, "没有标记的一段话在这里", "事故文本：" + "长" * 300, "事故文本：a。b"]
    by_column = spark.createDataFrame([(t,) for t in texts], "t string").select(first_evidence(F.col("t")).alias("e")).collect()
    assert [r.e for r in by_column] == [evidence_of(t) for t in texts]


def test_graph_store(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "z", 3)], "id string, name string, seq long")
    edges = spark.createDataFrame([("a", "t", "b", 1), ("a", "t", "b", 2), ("a", "t", "gone", 3)], "source_id string, type string, target_id string, seq long")
    assert sinks.write_graph(nodes, edges, Memory, clear=True) == (2, 1) and sinks.check_graph(Memory)
    assert sinks.stored_form(nodes, edges)[0].where("id = 'a'").first().name == "y"
    sinks.export_csv(nodes, f"{tmp_path}/parts")
    assert all(p.read_bytes().startswith(b"\xef\xbb\xbf") for p in (tmp_path / "parts").glob("*.csv"))
    assert sorted(tuple(r) for r in sinks.read_csv(spark, f"{tmp_path}/parts").select("id", "name").collect()) == [("a", "x"), ("a", "y"), ("b", "z")]
    assert sinks.export_csv_file(nodes, f"{tmp_path}/n.csv") == 3 and open(f"{tmp_path}/n.csv", "rb").read(3) == b"\xef\xbb\xbf"
    with pytest.raises(RuntimeError):
        HttpService(Settings().service)


def test_http_graph(monkeypatch):
    store, said = sinks.HttpGraph(GraphDatabase("http://x", "u", "p")), []
    monkeypatch.setattr(store, "_post", lambda body: said.append(body) or {"results": [1], "errors": []})
    store.ensure_unique_id()
    store.clear()
    store.merge_nodes([{"id": "a", "label": "UnsafeAction"}, {"id": "b", "label": "Consequence"}])
    store.merge_edges([{"source_id": "a", "type": "leadTo", "target_id": "b"}])
    assert store.ping() and len(said) == 5 and len(said[2]["statements"]) == 2 and said[3]["statements"][0]["parameters"] == {"rows": [{"source_id": "a", "type": "leadTo", "target_id": "b"}]}
    with pytest.raises(ValueError):
        store.merge_nodes([{"id": "a", "label": "x`) DETACH DELETE n //"}])
    monkeypatch.setattr(store, "_post", lambda body: {"errors": [{"code": "no"}]})
    assert not store.ping()
    with pytest.raises(RuntimeError):
        store.clear()
    with pytest.raises(RuntimeError):
        sinks.HttpGraph(GraphDatabase("bolt://x"))


def test_recall_loses_no_candidate(spark):
    import random

    rnd = random.Random(9)
    names = sorted({"".join(rnd.choice("未系安全带戴帽人员") for _ in range(rnd.randrange(1, 9))) for _ in range(70)})
    df = spark.createDataFrame([(f"i{k}", "L", n, k) for k, n in enumerate(names)], "id string, label string, norm string, seq long")
    got = fusion.recall(df.select(F.col("id").alias("mention_id"), "label", "norm"), df.select(F.col("id").alias("canonical_id"), "label", "norm", F.array("norm").alias("names"), "seq"), Fusion(top_k=1000))
    want = {(f"i{a}", f"i{b}"): fusion.py_similarity(x, y) for a, x in enumerate(names) for b, y in enumerate(names)}
    assert {(r.mention_id, r.canonical_id): round(r.string_score, 9) for r in got.collect()} == {k: round(s, 9) for k, s in want.items() if s >= 0.72}


def test_matrix(spark):
    known = case_rows(spark, 3).withColumn("raw_text", F.when(F.col("seq") == 0, "死亡").otherwise("x"))
    nodes = spark.createDataFrame([("AccidentCase:HCA-0", "AccidentCase", "c", None, ["HCA-0"], 0), ("u1", "UnsafeAction", "未系安全带", None, [], 1), ("m1", "SafetyManagementDefect", "培训不足", "HCA-1", [], 2), ("q", "Consequence", "重伤", None, [], 3)], "id string, label string, name string, case_id string, source_cases array<string>, seq long")
    edges = spark.createDataFrame([("AccidentCase:HCA-0", "hasDirectCause", "u1", None, [], "", 0), ("u1", "hasManagementCause", "m1", "HCA-9", [], "", 1), ("AccidentCase:HCA-2", "hasConsequence", "q", "HCA-2", [], "", 2)], "source_id string, type string, target_id string, case_id string, source_cases array<string>, evidence_text string, seq long")
    got = {(r.case_id, r.label) for r in causal.features_long(nodes, edges, known).collect()}
    assert got == {("HCA-0", "UnsafeAction"), ("HCA-1", "SafetyManagementDefect")}
    assert {r.case_id: r.severe_consequence for r in causal.outcomes(nodes, edges, known).collect()} == {"HCA-0": 1, "HCA-1": 0, "HCA-2": 1}
    names = causal.variables(nodes)
    assert names.where("not is_layer_variable").count() == 2 and names.where("is_layer_variable").count() == 8
    columns = [r["column"] for r in names.where("not is_layer_variable").collect()]
    wide = causal.export_matrix(known, causal.outcomes(nodes, edges, known), causal.features_long(nodes, edges, known), columns)
    assert wide.columns[:4] == ["case_id", "title", "source_file", "severe_consequence"] and len(wide.columns) == 22 and wide.where("layer_UnsafeAction = 1").count() == 1
    ones = {(r.case_id, r["column"]) for r in causal.long_form(wide).collect()}
    assert ones == {(r.case_id, r["column"]) for r in causal.matrix_long(causal.features_long(nodes, edges, known)).collect()}
    assert causal.resolve_treatment("未系安全带", names)["entity_id"] == "u1"
    with pytest.raises(ValueError):
        causal.resolve_treatment("存在", names)
    assert "effect_estimate" in causal.markdown_report(causal.analyse_batch(nodes, edges, known, Causal(min_support=1, bootstrap_n=5)), Causal())


def test_features_by_any_way_are_the_same(spark, monkeypatch):
    """Bits, broadcast and shuffle give the features that the memberships of all entities give."""
    rng = np.random.default_rng(5)
    factors = [(f"u{k}", "UnsafeAction" if k % 2 else "EnvironmentCondition", f"n{k % 7}", f"c{k}" if k % 3 else None, [f"c{k + 1}", "", None], k) for k in range(12)] + [("", "UnsafeAction", "x", "c1", [], 50), ("AccidentCase:c2", "UnsafeAction", "both", None, [], 51)]
    nodes = spark.createDataFrame(factors + [(f"AccidentCase:c{k}", "AccidentCase", "a", None, [f"c{k}", f"c{k + 30}"] if k % 2 else [], 100 + k) for k in range(30)], "id string, label string, name string, case_id string, source_cases array<string>, seq long")
    ends = [f"u{k}" for k in range(12)] + [f"AccidentCase:c{k}" for k in range(32)] + ["", None, "other"]
    edges = spark.createDataFrame([(ends[rng.integers(len(ends))], "leadTo", ends[rng.integers(len(ends))], f"c{rng.integers(50)}" if k % 2 else None, [f"c{rng.integers(50)}", ""] if k % 3 else [], k) for k in range(300)], "source_id string, type string, target_id string, case_id string, source_cases array<string>, seq long")
    known = spark.createDataFrame([(f"c{k}",) for k in range(40)] + [("c1",), (None,)], "case_id string")
    plain = graph.memberships(nodes, edges).join(causal._labelled(nodes).select(F.col("id").alias("entity_id"), "column", "label"), "entity_id").join(known, "case_id", "left_semi").select("case_id", "column", "label").distinct()
    want = sorted(map(tuple, plain.collect()))
    assert len(want) > 100
    for few, bits in ((20_000, 62), (20_000, 3), (3, 3)):
        monkeypatch.setattr(causal, "BROADCAST_FACTORS", few)
        monkeypatch.setattr(causal, "MASK_COLUMNS", bits)
        assert sorted(map(tuple, causal.features_long(nodes, edges, known).collect())) == want
    assert not causal.features_long(nodes.where("label = 'AccidentCase'"), edges, known).collect()


def test_supports_and_matrix_read_features_once(spark):
    rows = [(f"c{k % 9}", f"x_ua_{k % 4}", "UnsafeAction") for k in range(36)] + [("c1", "x_uos_1", "UnsafeObjectState")]
    features = spark.createDataFrame(rows, "case_id string, column string, label string").distinct()
    plan = causal.supports(features.select("case_id", "column"), 9)._jdf.queryExecution().optimizedPlan().toString()
    assert "distinct" not in plan and {tuple(r) for r in causal.supports(causal.matrix_long(features), 9).collect()} >= {("x_uos_1", 1, 9), ("layer_UnsafeAction", 9, 9)}
    cases_of, outcome = (spark.createDataFrame([(f"c{k}", "t", "f") for k in range(11)], "case_id string, title string, source_file string"), spark.createDataFrame([("c0", 1)], "case_id string, severe_consequence int"))
    wide = causal.export_matrix(cases_of, outcome, features, ["x_ua_1", "x_uos_1"])
    got = {r.case_id: (r.severe_consequence, r.layer_UnsafeAction, r.count_UnsafeAction, r.count_UnsafeObjectState, r.x_ua_1, r.x_uos_1) for r in wide.collect()}
    by_case = {c: {x[1] for x in rows if x[0] == c} for c in got}
    assert got == {c: (int(c == "c0"), int(any("_ua_" in x for x in xs)), sum("_ua_" in x for x in xs), int("x_uos_1" in xs), int("x_ua_1" in xs), int("x_uos_1" in xs)) for c, xs in by_case.items()}
    assert wide._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2


def test_resume(spark, tmp_path):
    work = spark.createDataFrame([(f"c{k}", k) for k in range(5)], "case_id string, seq long")
    done = spark.createDataFrame([("c0", 10.0), ("c1", 20.0), ("gone", 30.0)], "case_id string, elapsed_seconds double")
    assert sorted(r.case_id for r in resume.pending(work, done).collect()) == ["c2", "c3", "c4"]
    assert [r.case_id for r in resume.pending(work, done, limit=3).collect()] == ["c2"]
    r = resume.progress(work, done).first()
    assert (r.completed_cases, r.percent, r.elapsed_hms, r.remaining_hms) == (3, 60.0, "00:01:00", "00:00:40")
    source = tmp_path / "in"
    source.mkdir()
    for name in ("a", "b"):
        (source / f"{name}.json").write_text(json.dumps({"case_id": name}) + "\n")
        resume.stream_new(spark, str(source), "case_id string", lambda d: d, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert sorted(r.case_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b"]


def test_whole_experiment(spark, tmp_path):
    (tmp_path / "s.txt").write_text("\n".join(x for k in range(2) for x in (f"【案例{k + 1}】 第{k}号坍塌事故", "事故经过：现场未设置支护导致边坡坍塌并造成死亡。", "防范措施：加强支护。")), encoding="utf-8")
    run = Run(spark, Settings(extraction=Extraction(min_case_chars=1), causal=Causal(min_support=1, bootstrap_n=5)), f"{tmp_path}/out", [f"{tmp_path}/s.txt"], DryRun, progress_path=f"{tmp_path}/p.json")
    assert [s["name"] for s in run_stages(run)] == ["clean", "anonymize", "extract", "build", "fuse", "export", "matrix", "effects"]
    assert run.load("entities").count() == 2 + 6 and json.load(open(f"{tmp_path}/p.json"))["status"] == "completed"
    assert len(list((tmp_path / "p.json.logs").glob("*.json"))) == 8 and sinks.read_csv(spark, f"{tmp_path}/out/export/matrix").count() == 2
    with pytest.raises(ZeroDivisionError):
        run_stages(run, [("bad", lambda r: 1 / 0)])
    assert "ZeroDivisionError" in json.load(open(tmp_path / "p.json.logs" / "01_bad.json"))["error"]
    before = run.load("results").count()
    run_stages(run, [s for s in __import__("faultline.plans.pipeline", fromlist=["STAGES"]).STAGES if s[0] == "extract"])
    assert run.load("results").count() == before == 2


def test_fuse_stage_embeds(spark, tmp_path):
    class Meanings:
        known = {"高处坠落": [1.0, 0.0], "高空坠落": [1.0, 0.0], "未系安全带": [1.0, 0.0], "未戴安全带": [0.0, 1.0]}

        def embed(self, texts):
            return [self.known[t] for t in texts]

    class Silent:
        def embed(self, texts):
            raise AssertionError(texts)

    names = ["高处坠落", "高空坠落", "未系安全带", "未戴安全带"]
    rows = [(f"id{k}", k, n, "UnsafeAction", n, f"case{k}", False) for k, n in enumerate(names)] + [("id9", 9, "事故", "AccidentCase", "事故", "case9", False)]
    run = Run(spark, Settings(), f"{tmp_path}/out", embed=Meanings)
    run.save(spark.createDataFrame(rows, "id string, seq long, name string, label string, normalized_name string, case_id string, needs_review boolean"), "entities")
    run.save(spark.createDataFrame([("id0", "leadTo", "id1", 1)], "source_id string, type string, target_id string, seq long"), "triples")
    fused = [s for s in STAGES if s[0] == "fuse"]

    def said():
        run_stages(run, fused)
        status = {r.source_entity_id: r.alignment_status for r in run.load("alignment").collect()}
        return [status[f"id{k}"] for k in (1, 3)], json.loads(spark.read.text(f"{run.root}/fusion_report").first()[0])["use_embeddings"]

    assert said() == (["matched", "nil_low_score"], True)
    run.embed = Silent  # all names are in the cache
    assert said() == (["matched", "nil_low_score"], True) and run.load("embedding_cache").count() == 4
    for run.embed in (None, lambda: HttpService(Settings().service)):
        assert said() == (["review_low_margin", "matched"], False)


def test_settings(tmp_path):
    (tmp_path / "c.yaml").write_text("fusion:\n  nil_threshold: 0.5\nservice:\n  model: m\n")
    s = load_settings(tmp_path / "c.yaml", {"LLM_MODEL": "z", "NEO4J_URI": "bolt://x"})
    assert (s.fusion.nil_threshold, s.service.model, s.graph.uri, s.graph.password, s.service.base_url) == (0.5, "z", "bolt://x", "", "")
    assert s.path("a/b") == "./a/b" and s.path("/x") == "/x"


def test_near_names_lose_no_pair(spark):
    """All pairs of names that score at the threshold are met, for several thresholds, with repeated characters, other labels and an empty name."""
    rng = np.random.default_rng(3)
    names = sorted({"".join(rng.choice(list("abab漏水管c"), rng.integers(0, 9))) for _ in range(150)})
    rows = [(label, x) for label in ("A", "B") for x in names]
    for t in (0.6, 0.72, 0.8, 1.0):
        left, right = (spark.createDataFrame(rows, f"label string, {c} string") for c in "lr")
        met = {tuple(r) for r in fusion.near_names(left, right, t).collect()}
        assert {(label, a, b) for label in ("A", "B") for a in names for b in names if fusion.py_similarity(a, b) >= t} <= met
        assert len(met) < 2 * len(names) ** 2
