import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faultline.functions import text as t
from faultline.functions import values
from faultline.operators.fusion import py_normalize_name, py_similarity, score_pairs


def column(spark, fn, rows):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "k int, x string")
    return [r.y for r in df.select("k", fn(F.col("x")).alias("y")).orderBy("k").collect()]


def test_normalization(spark):
    assert column(spark, t.normalize_text, ["　a\r\nb\rc  \t d\n\n\n\ne\x1c ", ""]) == ["a\nb\nc d\n\ne", ""]
    assert column(spark, t.normalize_paragraph, [" a　\n\x1cb\xa0 c "]) == ["a b c"]
    assert column(spark, t.strip_bracket_heading, ["【补充】 现场", "x【y】"]) == ["现场", "x【y】"]


def test_names(spark):
    rows = [("隐患排查不到位", "SafetyManagementDefect", "隐患排查治理"), ("高处坠落事故", "AccidentType", "高处坠落"), ("触电事故", None, "触电事故"), ("触电事故", "AccidentType", "触电"), ("安全 培训　流于形式", "SafetyManagementDefect", "安全培训不足"), ("设备管理不到位问题", None, "设备管理不到位"), ("设备管理不到位", None, "设备管理"), ("。；，", None, "。；，"), (None, None, ""), ("A（1），", "x", "A(1)")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, n string, l string, want string")
    got = [r.y for r in df.select("k", t.normalize_name(F.col("n"), F.col("l")).alias("y")).orderBy("k").collect()]
    assert got == [r[2] for r in rows]
    assert [py_normalize_name(n, label) for n, label, _ in rows] == got


def test_similarity(spark):
    rows = [("触电", "触电", 1.0), ("", "触电", 0.0), ("基坑开挖", "基坑开挖作业", 4 / 6), ("安全培训不足", "安全教育不足", 0.6666666666666666), ("未系安全带", "未戴安全带", 0.8), ("abcd", "bcde", 0.75), ("监督检查", "检查监督", 0.5)]
    df = spark.createDataFrame(rows, "a string, b string, want double")
    assert all(r.string_score == r.want for r in score_pairs(df, "a", "b").collect())
    assert all(py_similarity(a, b) == w for a, b, w in rows)


def test_spans_and_evidence(spark):
    spans = column(spark, t.evidence_spans, ["甲。乙；；丙\n丁", "x" * 800, None, "。"])
    assert [tuple(s) for s in spans[0]] == [("S001", "甲"), ("S002", "乙"), ("S003", "丙"), ("S004", "丁")]
    assert [(s.span_id, len(s.text)) for s in spans[1]] == [("S001_1", 360), ("S001_2", 360), ("S001_3", 80)]
    assert spans[2:] == [[], []]
    assert column(spark, t.first_evidence, ["事故文本：短。这是一个证据句子。", "无标记的证据句子\n后", "x"]) == ["这是一个证据句子", "无标记的证据句子", "x"]
    assert column(spark, lambda c: t.between(c, '"q": "', '"'), ['{"q": "Z1"}', "none", '"q": "open']) == ["Z1", "", ""]


def test_ids_and_formats(spark):
    pair = spark.createDataFrame([("a", None, "b")], "a string, n string, b string")
    assert pair.select(t.stable_id(F.col("a"), F.col("n"), F.col("b"))).first()[0] == "94ddde09e26aeff0d730e3a2a6684dc7"
    df = spark.createDataFrame([("SafetyManagementDefect", "隐患排查治理"), ("UnsafeAction", "未系安全带")], "l string, n string")
    assert [r[0] for r in df.select(t.feature_column(F.col("l"), F.col("n"))).collect()] == ["x_smd_1eecc6cddb", "x_ua_aeb6821bfa"]
    seconds = spark.createDataFrame([(66939.423,), (146.797,), (0.0,), (-5.0,)], "s double")
    assert [r[0] for r in seconds.select(t.hms(F.col("s"))).collect()] == ["18:35:39", "00:02:27", "00:00:00", "00:00:00"]
    assert column(spark, t.dot_id, ["1a-b", "", "x y"]) == ["v_1a_b", "v", "x_y"]
    assert column(spark, t.normalize_answer, [" YES ", "是", "有", "maybe", None, "1"]) == ["yes", "yes", "yes", "no", "no", "yes"]
    assert column(spark, t.is_severe, ["造成1人死亡", "轻伤", None]) == [1, 0, 0]


def test_values(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0, 9.0]), ([0.0], [1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(values.cosine(F.col("a"), F.col("b"))).collect()]
    assert abs(got[0] - 1 / 83**0.5) < 1e-12 and got[1] == 0.0
    lists = spark.createDataFrame([(["b", "", None, "a", "b"], None)], "a array<string>, n array<string>")
    assert lists.select(values.unique_in_order(F.col("a"), F.col("n"))).first()[0] == ["b", "a"]
    assert lists.select(values.safe_double(F.lit("x"), 0.5), values.safe_double(F.lit("2"))).first() == (0.5, 2.0)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab （），；。:　\t\x1c事故问题", max_size=12), min_size=1, max_size=40))
def test_names_match_a_plain_model(spark, names):
    assert column(spark, lambda c: t.normalize_name(c), names) == [py_normalize_name(n) for n in names]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(max_size=8), min_size=1, max_size=20))
def test_md5_matches_hashlib(spark, parts):
    parts = [p.encode("utf-8", "ignore").decode() for p in parts]
    assert column(spark, lambda c: t.stable_id(c, F.lit("z")), parts) == [hashlib.md5(f"{p}::z".encode()).hexdigest() for p in parts]
