"""Every query on the driver tables, with the SQL that gives the same rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import vocabulary as v
from faultline.functions import text as t
from faultline.functions import values
from faultline.operators import causal, cases, fusion, graph, privacy, votes
from faultline.settings import Causal, Fusion
from faultline.sources.graph import export_rows, stored_form
from faultline.streaming import resume

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
Query = Callable[..., DataFrame]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query over the tables that its parameters name."""

    def add(fn: Query) -> Query:
        names = fn.__code__.co_varnames[: fn.__code__.co_argcount]
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(*(spark if n == "spark" else spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names))
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def stripped(x: str) -> str:
    return rf"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


# --- relationship merge ---


def edges_of(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(F.col("l_suppkey").alias("source_id"), F.col("l_returnflag").alias("type"), F.col("l_partkey").alias("target_id"), F.col("l_orderkey").alias("case_id"), F.col("l_discount").alias("confidence"), (F.col("l_linestatus") == "O").cast("int").alias("vote_yes_count"), (F.col("l_linestatus") == "F").cast("int").alias("vote_no_count"))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


MERGE_SQL = """SELECT {0} AS source_id, l_returnflag AS type, {1} AS target_id, count(*)::BIGINT AS weight, count(DISTINCT l_orderkey)::BIGINT AS case_count,
  round(avg(l_discount), 6) AS avg_confidence, round(sum((l_linestatus = 'O')::INT) / count(*)::DOUBLE, 6) AS vote_yes_ratio,
  'REL:canonical:' || md5({0}::VARCHAR || '::' || l_returnflag || '::' || {1}::VARCHAR) AS id
FROM lineitem {2} GROUP BY 1, 2, 3"""


@query(MERGE_SQL.format("l_suppkey", "l_partkey", ""))
def relationship_merge(lineitem):
    return rounded(graph.summarize_relationships(edges_of(lineitem)), "avg_confidence", "vote_yes_ratio")


@query(MERGE_SQL.format("l_suppkey::VARCHAR", "p_brand", "JOIN part ON p_partkey = l_partkey"))
def relationship_merge_remapped(lineitem, part):
    edges = edges_of(lineitem).withColumns({"source_id": F.col("source_id").cast("string"), "target_id": F.concat(F.lit("part:"), "target_id")})
    brands = part.select(F.concat(F.lit("part:"), "p_partkey").alias("source_entity_id"), F.col("p_brand").alias("canonical_id"))
    return rounded(graph.summarize_relationships(graph.remap(edges, brands)), "avg_confidence", "vote_yes_ratio")


@query("""SELECT l_suppkey::VARCHAR AS source_id, l_returnflag AS type, l_linestatus AS target_id, count(*)::BIGINT AS weight, count(DISTINCT l_linenumber)::BIGINT AS case_count,
  array_to_string(list_sort(list(DISTINCT l_linenumber::VARCHAR)), ',') AS cases FROM lineitem GROUP BY 1, 2, 3""")
def relationship_lists(lineitem):
    edges = lineitem.select(F.col("l_suppkey").cast("string").alias("source_id"), F.col("l_returnflag").alias("type"), F.col("l_linestatus").alias("target_id"), F.col("l_linenumber").cast("string").alias("case_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return graph.merge_relationships(edges).select("source_id", "type", "target_id", "weight", "case_count", F.array_join(F.array_sort("source_cases"), ",").alias("cases"))


@query("SELECT p_partkey, p_brand || ':' || md5(p_brand || '::' || p_name) AS node_id, p_brand || ':canonical:' || md5(p_brand || '::' || p_name) AS canonical_id FROM part")
def stable_ids(part):
    return part.select("p_partkey", t.node_id(F.col("p_brand"), F.col("p_name")).alias("node_id"), t.canonical_id(F.col("p_brand"), F.col("p_name")).alias("canonical_id"))


# --- text ---


@query(rf"""SELECT doc_id, md5({stripped(r"regexp_replace(regexp_replace(regexp_replace(replace(text, chr(12288), ' '), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")}) AS normal FROM documents""")
def normalize_text(documents):
    return documents.select("doc_id", F.md5(t.normalize_text(F.col("text"))).alias("normal"))


@query(f"SELECT doc_id, md5({stripped(f"regexp_replace(replace(text, chr(12288), ' '), '{WS}+', ' ', 'g')")}) AS normal FROM documents")
def normalize_paragraph(documents):
    return documents.select("doc_id", F.md5(t.normalize_paragraph(F.col("text"))).alias("normal"))


SPANS_SQL = rf"""WITH parts AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[\n。；;]+'), lambda x: {stripped("x")}), lambda x: x <> '') AS p FROM documents),
s AS (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM parts),
c AS (SELECT doc_id, x, i, unnest(range(0, (length(x) - 1) // 360 + 1)) AS k FROM s)
SELECT doc_id, printf('S%03d', i::INT) || CASE WHEN length(x) > 360 THEN '_' || (k + 1)::VARCHAR ELSE '' END AS span_id, md5(substr(x, (k * 360 + 1)::INT, 360)) AS span FROM c"""


@query(SPANS_SQL)
def evidence_spans(documents):
    return documents.select("doc_id", F.explode(t.evidence_spans(F.col("text"))).alias("s")).select("doc_id", "s.span_id", F.md5("s.text").alias("span"))


@query(rf"""WITH v AS (SELECT doc_id, {stripped("text")} AS x FROM documents)
SELECT doc_id, coalesce(list_filter(list_transform(regexp_split_to_array(x, '[\n。]'), lambda y: {stripped("y")}), lambda y: length(y) BETWEEN 6 AND 120)[1], substr(x, 1, 120)) AS evidence FROM v""")
def first_evidence(documents):
    return documents.select("doc_id", t.first_evidence(F.col("text")).alias("evidence"))


@query("""SELECT event_id, CASE WHEN position('"k": ' IN props) > 0 AND position('}' IN substr(props, position('"k": ' IN props) + 5)) > 0
  THEN split_part(substr(props, position('"k": ' IN props) + 5), '}', 1) ELSE '' END AS field FROM events""")
def field_extract(events):
    return events.select("event_id", t.between(F.col("props"), '"k": ', "}").alias("field"))


@query("""SELECT page_id, CASE WHEN position('<title>' IN html) > 0 AND position('</title>' IN substr(html, position('<title>' IN html) + 7)) > 0
  THEN split_part(substr(html, position('<title>' IN html) + 7), '</title>', 1) ELSE '' END AS title FROM pages""")
def page_titles(pages):
    return pages.select("page_id", t.between(F.col("html"), "<title>", "</title>").alias("title"))


@query("SELECT doc_id, (contains(text, 'lower') OR contains(text, 'idiot') OR contains(text, '###'))::INT AS flagged FROM documents")
def keyword_flag(documents):
    return documents.select("doc_id", t.is_severe(F.col("text"), ("lower", "idiot", "###")).alias("flagged"))


@query("""SELECT event_id, CASE WHEN event_type IN ('purchase', 'click') THEN 'yes' ELSE 'no' END AS answer FROM events""")
def normalized_answers(events):
    said = F.when(F.col("event_type").isin("purchase", "click"), F.lit(" YES ")).otherwise(F.col("event_type"))
    return events.select("event_id", t.normalize_answer(said).alias("answer"))


PART_ALIASES = {"ECONOMY": {"smallred": "tiny"}, "PROMO": {"largeblue": "big"}}
PART_SUFFIXES = ("red", "blue", "widget", "bolt")


@query("""WITH a AS (SELECT p_partkey, p_type, regexp_replace(p_name, '\\s+', '', 'g') AS x FROM part),
b AS (SELECT *, CASE WHEN length(x) > 4 THEN CASE WHEN ends_with(x, 'red') AND length(x) >= 7 THEN left(x, length(x) - 3) WHEN ends_with(x, 'blue') AND length(x) >= 8 THEN left(x, length(x) - 4)
  WHEN ends_with(x, 'widget') AND length(x) >= 10 THEN left(x, length(x) - 6) WHEN ends_with(x, 'bolt') AND length(x) >= 8 THEN left(x, length(x) - 4) ELSE x END ELSE x END AS y FROM a)
SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' AND y = 'smallred' THEN 'tiny' WHEN p_type = 'PROMO' AND y = 'largeblue' THEN 'big' ELSE y END AS name FROM b""".replace("\\\\", "\\"))
def name_normalize(part):
    return part.select("p_partkey", t.normalize_name(F.col("p_name"), F.col("p_type"), aliases=PART_ALIASES, suffixes=PART_SUFFIXES).alias("name"))


@query("SELECT doc_id, md5(text) AS masked, 'anonymized' AS privacy_status, 0::BIGINT AS n_persons FROM documents")
def anonymize_text(documents):
    """Texts without Han characters have no name that the patterns know."""
    return privacy.anonymize(documents.select("doc_id", F.col("text").alias("raw_text"))).select("doc_id", F.md5("raw_text").alias("masked"), "privacy_status", "n_persons")


@query("""WITH k AS (SELECT c_custkey, substr('张王李赵刘陈杨', (c_custkey % 7 + 1)::INT, 1) AS a, substr('周吴郑孙胡', (c_custkey % 5 + 1)::INT, 1) AS b, c_custkey % 3 AS m FROM customer)
SELECT c_custkey, CASE m WHEN 0 THEN '死者A在' ELSE '伤者A在' END || c_custkey || '号基坑作业。' || CASE WHEN m = 2 THEN '管理人员B未巡查。' ELSE '伤者B因坠落送医。' END || CASE m WHEN 0 THEN '死者A' ELSE '伤者A' END || '未系安全带。' AS masked,
  CASE m WHEN 0 THEN '死者A' ELSE '伤者A' END AS title, 2::BIGINT AS n_persons FROM k""")
def anonymize_names(customer):
    """Two persons in roles; the first is met again, in the text and in another field."""
    def pick(names: str, n: int):
        return F.substring(F.lit(names), (F.col("c_custkey") % n + 1).cast("int"), F.lit(1))

    first, second, kind = F.concat(pick("张王李赵刘陈杨", 7), F.lit("某")), F.concat(pick("周吴郑孙胡", 5), F.lit("某")), F.col("c_custkey") % 3
    role = F.when(kind == 0, "死者").otherwise("伤者")
    other = F.when(kind == 2, F.concat(F.lit("管理人员"), second, F.lit("未巡查。"))).otherwise(F.concat(F.lit("伤者"), second, F.lit("因坠落送医。")))
    told = F.concat(role, first, F.lit("在"), F.col("c_custkey").cast("string"), F.lit("号基坑作业。"), other, first, F.lit("未系安全带。"))
    return privacy.anonymize(customer.select("c_custkey", told.alias("raw_text"), first.alias("title"))).select("c_custkey", F.col("raw_text").alias("masked"), "title", "n_persons")


@query("""SELECT printf('%02d:%02d:%02d', (s // 3600)::INT, (s % 3600 // 60)::INT, (s % 60)::INT) AS hms, event_id FROM (SELECT event_id, round_even(greatest(value * 100, 0), 0)::BIGINT AS s FROM events)""")
def elapsed_times(events):
    return events.select("event_id", t.hms(F.col("value") * 100).alias("hms"))


# --- windows, dedupe, votes ---


@query("""SELECT conv_id, turn, (sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))::BIGINT AS session FROM conversations""")
def segment_sessions(conversations):
    return cases.sessions(conversations, F.col("role") == "user", ["conv_id"], ["turn"]).select("conv_id", "turn", "session")


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS signup FROM events""")
def fill_forward_fields(events):
    return cases.fill_forward(events, F.when(F.col("event_type") == "signup", F.col("event_id")), ["user_id"], ["ts", "event_id"], "signup").select("event_id", "signup")


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def first_wins_dedupe(events):
    return graph.first_wins(events, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


def as_votes(events: DataFrame) -> DataFrame:
    return events.select("user_id", F.to_date("ts").alias("day"), F.col("event_id").alias("vote_idx"), F.when(F.col("event_type").isin("click", "view", "purchase"), "yes").otherwise("no").alias("answer"), F.col("value").alias("confidence"))


VOTES_SQL = "WITH e AS (SELECT user_id, ts::DATE AS day, event_id, value, (event_type IN ('click', 'view', 'purchase'))::INT AS y FROM events)"


@query(f"""{VOTES_SQL}, g AS (SELECT user_id, day, count(*)::BIGINT AS vote_count, sum(y)::BIGINT AS yes FROM e GROUP BY ALL)
SELECT *, vote_count - yes AS no, abs(2 * yes - vote_count) AS margin, CASE WHEN 2 * yes > vote_count THEN 'yes' ELSE 'no' END AS answer, 2 * yes > vote_count AND abs(2 * yes - vote_count) >= 2 AS accepted FROM g""")
def vote_majority(events):
    return votes.tally_counts(as_votes(events), ["user_id", "day"], min_margin=2)


@query(f"""{VOTES_SQL}, g AS (SELECT *, 2 * sum(y) OVER (PARTITION BY user_id, day) > count(*) OVER (PARTITION BY user_id, day) AS m FROM e)
SELECT user_id, day, CASE WHEN m THEN 'yes' ELSE 'no' END AS answer, event_id AS vote_idx FROM g QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY ((y = 1) = m)::INT DESC, value DESC, event_id) = 1""")
def vote_representative(events):
    return votes.tally(as_votes(events), ["user_id", "day"]).select("user_id", "day", "answer", "vote_idx")


@query("""WITH d AS (SELECT event_id, user_id, event_type, event_type <> 'error' AS accepted, value FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, accepted ORDER BY value DESC, event_id) AS best, min(event_id) OVER (PARTITION BY user_id, event_type, accepted) AS place FROM d)
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY accepted, CASE WHEN accepted THEN place ELSE event_id END)::INT AS pos FROM k WHERE NOT accepted OR best = 1""")
def decision_dedupe(events):
    d = events.select("user_id", "event_id", F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("accepted"), F.col("event_type").alias("question_id"), F.lit("t").alias("entity_type"), F.lit("r").alias("relation_type"), F.lit("x").alias("label"), F.lit(0).alias("yes"), F.col("value").alias("confidence"))
    return votes.dedupe_decisions(d, ["user_id"]).select("user_id", "event_id", "pos")


@query("""SELECT event_id, CASE WHEN event_type = 'error' OR value >= 90 THEN 1 ELSE 0 END + CASE WHEN value < 5 THEN 1 ELSE 0 END AS n_errors FROM (SELECT event_id, event_type, value FROM events)""")
def validate_decisions(events):
    d = events.select("event_id", F.lit("yes").alias("answer"), F.when((F.col("event_type") == "error") | (F.col("value") >= 90), "x").otherwise("UnsafeAction").alias("entity_type"), F.when(F.col("value") < 5, " ").otherwise("l").alias("label"), F.lit("e").alias("evidence_text"), F.lit("").alias("rationale"))
    return votes.validate_decisions(d).select("event_id", F.size("errors").alias("n_errors"))


# --- graph ---

ORDER_RELATIONS = {"1-URGENT": (("BUILDING", "MACHINERY"), ("O", "F")), "2-HIGH": (("BUILDING", "AUTOMOBILE", "FURNITURE"), ("O",)), "5-LOW": (("HOUSEHOLD",), ("O", "F", "P"))}


@query("""WITH r(type, subjects, objects) AS (VALUES ('1-URGENT', ['BUILDING', 'MACHINERY'], ['O', 'F']), ('2-HIGH', ['BUILDING', 'AUTOMOBILE', 'FURNITURE'], ['O']), ('5-LOW', ['HOUSEHOLD'], ['O', 'F', 'P']))
SELECT o_orderkey, array_to_string(list_filter([CASE WHEN r.type IS NULL THEN 'relation_illegal' END, CASE WHEN NOT list_contains(subjects, coalesce(c_mktsegment, '')) THEN 'subject_type_illegal' END,
  CASE WHEN NOT list_contains(objects, o_orderstatus) THEN 'object_type_illegal' END], lambda x: x IS NOT NULL), ',') AS errors
FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN r ON r.type = o_orderpriority""")
def validate_relations(spark, orders, customer):
    nodes = customer.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_mktsegment").alias("label")).unionByName(orders.select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.col("o_orderstatus").alias("label")))
    edges = orders.select("o_orderkey", F.concat(F.lit("c"), "o_custkey").alias("source_id"), F.concat(F.lit("o"), "o_orderkey").alias("target_id"), F.col("o_orderpriority").alias("type"), F.lit("e").alias("evidence_text"))
    return graph.check_relations(edges, nodes, graph.relation_table(spark, ORDER_RELATIONS)).select("o_orderkey", F.array_join("errors", ",").alias("errors"))


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def endpoint_semi_join(lineitem, part, supplier):
    nodes = part.where("p_size > 25").select(F.concat(F.lit("p"), "p_partkey").alias("id")).unionByName(supplier.where("s_acctbal > 0").select(F.concat(F.lit("s"), "s_suppkey").alias("id")))
    edges = lineitem.select("l_orderkey", "l_linenumber", F.concat(F.lit("s"), "l_suppkey").alias("source_id"), F.concat(F.lit("p"), "l_partkey").alias("target_id"))
    return graph.with_ends(edges, nodes).select("l_orderkey", "l_linenumber")


@query("""WITH n AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' END AS type FROM orders)
SELECT o_orderkey::VARCHAR AS target_id, type FROM n WHERE type IS NOT NULL AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""")
def context_edges_anti(orders, lineitem):
    key = F.col("o_orderkey").cast("string")
    nodes = orders.select(key.alias("id"), key.alias("case_id"), F.col("o_orderpriority").alias("label"), F.lit("").alias("evidence_text"), F.lit("").alias("source_file"), F.col("o_orderkey").alias("seq"))
    order = F.col("l_orderkey").cast("string")
    stated = lineitem.where("l_returnflag = 'R'").select(order.alias("case_id"), F.concat(F.lit("AccidentCase:"), order).alias("source_id"), F.explode(F.array(F.lit("urgent"), F.lit("high"))).alias("type"), order.alias("target_id"))
    return graph.context_edges(nodes, stated, {"1-URGENT": "urgent", "2-HIGH": "high"}).select("target_id", "type")


@query("""WITH e AS (SELECT 's' || l_suppkey AS a, 'p' || l_partkey AS b, l_orderkey::VARCHAR AS c FROM lineitem) SELECT DISTINCT entity_id, case_id FROM (SELECT a AS entity_id, c AS case_id FROM e UNION ALL SELECT b, c FROM e)""")
def case_propagation(lineitem, part):
    none = F.array().cast("array<string>")
    nodes = part.select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.lit("Part").alias("label"), none.alias("source_cases"), F.lit(None).cast("string").alias("case_id"))
    edges = lineitem.select(F.concat(F.lit("s"), "l_suppkey").alias("source_id"), F.concat(F.lit("p"), "l_partkey").alias("target_id"), none.alias("source_cases"), F.col("l_orderkey").cast("string").alias("case_id"))
    return graph.entity_cases(nodes, edges)


@query("""SELECT l_suppkey::VARCHAR AS source_id, l_returnflag AS type, l_partkey::VARCHAR AS target_id, max(l_orderkey * 10 + l_linenumber)::VARCHAR AS seq FROM lineitem GROUP BY 1, 2, 3""")
def graph_export_rows(lineitem, part, supplier):
    edges = lineitem.select(F.concat(F.lit("s"), "l_suppkey").alias("source_id"), F.col("l_returnflag").alias("type"), F.concat(F.lit("p"), "l_partkey").alias("target_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    nodes = part.select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.lit(0).alias("seq")).unionByName(supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.lit(0).alias("seq")))
    return export_rows(stored_form(nodes, edges)[1].withColumns({c: F.substring(c, 2, 100) for c in ("source_id", "target_id")}))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in v.CAUSAL_EDGES) + ") AS e(source, target)")
def dot_edges(spark):
    """The edges as a reader of the written graph finds them."""
    text = spark.createDataFrame([(causal.dot_edges(),)], "dot string")
    lines = text.select(F.explode(F.split("dot", ";\n")).alias("line")).where("line like '%->%'")
    return lines.select(F.regexp_extract("line", '"([^"]*)" ->', 1).alias("source"), F.regexp_extract("line", '-> "([^"]*)"', 1).alias("target"))


# --- resume ---


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(documents, labels):
    return resume.pending(documents.select("doc_id"), labels, "doc_id")


@query("""SELECT (SELECT count(DISTINCT doc_id) FROM documents)::BIGINT AS total_cases, (SELECT count(DISTINCT doc_id) FROM labels)::BIGINT AS completed_cases,
  round_even((SELECT count(DISTINCT doc_id) FROM labels) * 100.0 / (SELECT count(DISTINCT doc_id) FROM documents), 2)::DOUBLE AS percent""")
def progress_stats(documents, labels):
    return resume.progress(documents.select("doc_id"), labels.select("doc_id", F.lit(1.0).alias("elapsed_seconds")), "doc_id").select("total_cases", "completed_cases", F.col("percent").cast("double").alias("percent"))


# --- fusion ---


@query("""WITH n AS (SELECT DISTINCT p_type AS label, p_name AS x FROM part), w AS (SELECT label, x, split_part(x, ' ', 1) AS c FROM n), c AS (SELECT DISTINCT label, c FROM w),
s AS (SELECT n.label, n.x, c.c, CASE WHEN x = c.c THEN 1.0 WHEN contains(replace(x, ' ', ''), replace(c.c, ' ', '')) THEN length(replace(c.c, ' ', ''))::DOUBLE / length(replace(x, ' ', '')) END AS score FROM n JOIN c ON n.label = c.label)
SELECT label, x AS mention, c AS candidate, round(score, 6) AS score FROM s WHERE score >= 0.61 QUALIFY row_number() OVER (PARTITION BY label, x ORDER BY score DESC, c) <= 2""")
def candidate_topk(part):
    """Whole names against the first words of names; other pairs than containing ones stay below the threshold on these words."""
    names = part.select(F.col("p_type").alias("label"), F.col("p_name").alias("name")).distinct()
    mentions = names.select(F.concat_ws("/", "label", "name").alias("mention_id"), "label", F.col("name").alias("norm"))
    first = names.select("label", F.split_part("name", F.lit(" "), F.lit(1)).alias("norm")).distinct()
    canonicals = first.select(F.concat_ws("/", "label", "norm").alias("canonical_id"), "label", "norm", F.array("norm").alias("names"), F.col("norm").alias("seq"))
    found = fusion.recall(mentions, canonicals, Fusion(string_threshold=0.61, top_k=2))
    label, mention = (F.split_part("mention_id", F.lit("/"), F.lit(k)) for k in (1, 2))
    return found.select(label.alias("label"), mention.alias("mention"), F.split_part("canonical_id", F.lit("/"), F.lit(2)).alias("candidate"), F.round("string_score", 6).alias("score"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_tax = 0 THEN 'nil_no_candidate' WHEN l_discount * 10 >= 0.8 THEN 'matched' WHEN l_discount * 10 < 0.68 THEN 'nil_low_score' ELSE 'review_low_margin' END AS status FROM lineitem""")
def threshold_classify(lineitem):
    return lineitem.select("l_orderkey", "l_linenumber", fusion.decide(F.when(F.col("l_tax") != 0, F.col("l_discount") * 10)).alias("status"))


@query("""WITH c AS (SELECT label, embedding AS e FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1),
s AS (SELECT m.vec_id, c.label, CASE WHEN m.label = c.label THEN 0.9 ELSE 0.75 END AS s, list_cosine_similarity(m.embedding::DOUBLE[], c.e::DOUBLE[]) AS z FROM embeddings m CROSS JOIN c)
SELECT vec_id, label AS candidate, round(z, 6) AS vector_score, round(0.4 * s + 0.6 * z, 6) AS combined_score FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY 0.4 * s + 0.6 * z DESC, label) = 1""")
def cosine_rerank(embeddings):
    heads = graph.first_wins(embeddings, ["label"], ["vec_id"])  # one for each label
    name = F.concat(F.lit("h"), "label")
    vectors = embeddings.select(F.concat(F.lit("v"), "vec_id").alias("text"), "embedding").unionByName(heads.select(name.alias("text"), "embedding"))
    pairs = embeddings.select("vec_id", "label").crossJoin(F.broadcast(heads.select(F.col("label").alias("candidate"), name.alias("name"))))
    candidates = pairs.select(F.col("vec_id").alias("mention_id"), F.concat(F.lit("v"), "vec_id").alias("mention"), "name", F.when(F.col("label") == F.col("candidate"), 0.9).otherwise(0.75).alias("string_score"), F.col("candidate").alias("rank"))
    best = fusion.rerank(candidates, vectors).where("best")
    return best.select(F.col("mention_id").alias("vec_id"), F.col("rank").alias("candidate"), F.round("vector_score", 6).alias("vector_score"), F.round("combined_score", 6).alias("combined_score"))


@query("""SELECT regexp_replace(p_name, '\\s+', '', 'g') AS normalized_name, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS labels FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1""".replace("\\\\", "\\"))
def conflict_same_name(part):
    return fusion.name_conflicts(part.select(F.col("p_name").alias("name"), F.col("p_type").alias("label"))).select("normalized_name", F.array_join("labels", ",").alias("labels"))


@query("""SELECT p_type || ':canonical:' || md5(p_type || '::' || p_name) AS id, count(*)::BIGINT AS n, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS brands, round(avg(DISTINCT p_size), 6) AS mean_size FROM part GROUP BY p_type, p_name""")
def entity_group_merge(part):
    members = part.select(t.canonical_id(F.col("p_type"), F.col("p_name")).alias("canonical_id"), F.col("p_type").alias("label"), F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_name").alias("normalized_name"), F.col("p_brand").alias("case_id"), F.col("p_size").cast("double").alias("confidence"), F.col("p_partkey").alias("seq"))
    return graph.merge_entities(members).select("id", F.size("source_entity_ids").cast("bigint").alias("n"), F.array_join(F.array_sort("source_cases"), ",").alias("brands"), F.round(values.mean_of(F.col("confidence_values")), 6).alias("mean_size"))


def part_entities(part: DataFrame) -> DataFrame:
    """Distinct names of a type, with their first part's key."""
    return part.groupBy(F.col("p_name").alias("name"), F.col("p_type").alias("label")).agg(F.min("p_partkey").alias("seq")).withColumns({"id": F.concat("label", F.lit(":"), "name"), "normalized_name": F.col("name")})


@query()
def fuse_entities_greedy(part):
    return fusion.fuse(part_entities(part), Fusion(use_embeddings=False)).select("source_entity_id", "canonical_id", "alignment_status")


@query()
def fuse_entities_sets(part):
    return fusion.fuse_sets(part_entities(part))


# --- causal ---


def order_graph(orders: DataFrame, lineitem: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and cases: an order's case has its return flags as unsafe actions, by edges from its accident node, and its line states as unsafe states, by edges of the case."""
    none, key = F.array().cast("array<string>"), F.col("l_orderkey").cast("string")
    known = F.concat(F.lit("AccidentCase:"), key)
    names = lineitem.select(F.explode(F.array(F.struct(F.lit("UnsafeAction").alias("label"), F.col("l_returnflag").alias("name")), F.struct(F.lit("UnsafeObjectState").alias("label"), F.col("l_linestatus").alias("name")))).alias("x")).select("x.*").distinct()
    factors = names.select(F.concat_ws(":", "label", "name").alias("id"), "label", "name", F.lit(None).cast("string").alias("case_id"), none.alias("source_cases"), F.ascii("name").cast("long").alias("seq"))
    anchors = orders.select(F.concat(F.lit("AccidentCase:"), F.col("o_orderkey").cast("string")).alias("id"), F.lit("AccidentCase").alias("label"), F.lit("order").alias("name"), F.lit(None).cast("string").alias("case_id"), F.array(F.col("o_orderkey").cast("string")).alias("source_cases"), F.col("o_orderkey").alias("seq"))
    by_anchor = lineitem.select(known.alias("source_id"), F.lit("hasDirectCause").alias("type"), F.concat(F.lit("UnsafeAction:"), "l_returnflag").alias("target_id"), F.lit(None).cast("string").alias("case_id"), none.alias("source_cases"))
    by_case = lineitem.select(F.lit("other").alias("source_id"), F.lit("leadTo").alias("type"), F.concat(F.lit("UnsafeObjectState:"), "l_linestatus").alias("target_id"), key.alias("case_id"), none.alias("source_cases"))
    cases_of = orders.select(F.col("o_orderkey").cast("string").alias("case_id"), F.lit("t").alias("title"), F.lit("f").alias("source_file"), F.when(F.col("o_orderstatus") == "F", "死亡").otherwise("").alias("consequence_text"), F.lit("").alias("economic_loss_text"), F.lit("").alias("raw_text"))
    return factors.unionByName(anchors), by_anchor.unionByName(by_case), cases_of


def order_features(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    return causal.features_long(*order_graph(orders, lineitem))


def column_sql(label: str, name: str) -> str:
    return f"""'x_{v.FEATURE_LABELS[label]}_' || substr(md5('{label}::' || {name}), 1, 10)"""


FEATURES_SQL = f"""WITH f AS (SELECT DISTINCT l_orderkey::VARCHAR AS case_id, {column_sql("UnsafeAction", "l_returnflag")} AS "column", 'UnsafeAction' AS label FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  UNION SELECT DISTINCT l_orderkey::VARCHAR, {column_sql("UnsafeObjectState", "l_linestatus")}, 'UnsafeObjectState' FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


@query(f'{FEATURES_SQL} SELECT case_id, "column", label FROM f')
def feature_matrix_long(orders, lineitem):
    return order_features(orders, lineitem)


@query(f'{FEATURES_SQL} SELECT case_id, label, count(*)::BIGINT AS n FROM f GROUP BY 1, 2')
def layer_counts(orders, lineitem):
    return causal.layers_long(order_features(orders, lineitem))


@query(f"""{FEATURES_SQL}, w AS (SELECT case_id, sum((label = 'UnsafeAction')::INT)::INT AS actions, sum((label = 'UnsafeObjectState')::INT)::INT AS states, max(("column" = {column_sql("UnsafeAction", "'A'")})::INT) AS flag_a, max(("column" = {column_sql("UnsafeAction", "'R'")})::INT) AS flag_r FROM f GROUP BY 1)
SELECT o_orderkey::VARCHAR AS case_id, (o_orderstatus = 'F')::INT AS severe_consequence, (coalesce(actions, 0) > 0)::INT AS layer_action, coalesce(actions, 0) AS actions, coalesce(states, 0) AS states, coalesce(flag_a, 0) AS flag_a, coalesce(flag_r, 0) AS flag_r FROM orders LEFT JOIN w ON case_id = o_orderkey::VARCHAR""")
def feature_pivot(orders, lineitem):
    nodes, edges, known = order_graph(orders, lineitem)
    names = {n: "x_" + v.FEATURE_LABELS["UnsafeAction"] + "_" + hashlib.md5(f"UnsafeAction::{n}".encode()).hexdigest()[:10] for n in "AR"}
    wide = causal.export_matrix(known, causal.outcomes(nodes, edges, known), causal.features_long(nodes, edges, known), list(names.values()))
    return wide.select("case_id", "severe_consequence", F.col("layer_UnsafeAction").alias("layer_action"), F.col("count_UnsafeAction").alias("actions"), F.col("count_UnsafeObjectState").alias("states"), F.col(names["A"]).alias("flag_a"), F.col(names["R"]).alias("flag_r"))


@query(f'{FEATURES_SQL} SELECT "column", count(DISTINCT case_id)::BIGINT AS support FROM f GROUP BY 1 ORDER BY support DESC, "column" LIMIT 3')
def treatment_support_topk(spark, orders, lineitem):
    nodes, edges, known_cases = order_graph(orders, lineitem)
    known = causal.variables(nodes).where("not is_layer_variable").withColumn("seq", F.col("column"))
    features = causal.features_long(nodes, edges, known_cases).select("case_id", "column")
    chosen = causal.treatments(known, causal.supports(features, 0), Causal(min_support=1, top_k=3), ("UnsafeAction", "UnsafeObjectState"))
    return chosen.select("column", "support")


@query("""SELECT 'layer_' || label AS "column", label, true AS is_layer_variable FROM (VALUES """ + ", ".join(f"('{x}')" for x in v.FEATURE_LABELS) + f""") AS x(label)
UNION ALL SELECT DISTINCT {column_sql("UnsafeAction", "l_returnflag")}, 'UnsafeAction', false FROM lineitem UNION ALL SELECT DISTINCT {column_sql("UnsafeObjectState", "l_linestatus")}, 'UnsafeObjectState', false FROM lineitem""")
def variable_map(orders, lineitem):
    return causal.variables(order_graph(orders, lineitem)[0]).select("column", "label", "is_layer_variable")


VARIABLES = [("x_t", "UnsafeAction", False), ("x_m1", "SafetyManagementDefect", False), ("x_m2", "SafetyManagementDefect", True), ("x_u", "UnsafeAction", False), ("x_o", "UnsafeObjectState", False), ("x_a", "AccidentType", False), ("x_e", "EnvironmentCondition", False)]


@query("""WITH s AS (SELECT * FROM (VALUES ('x_m1', (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT'), false), ('x_m2', (SELECT count(*) FROM orders WHERE o_orderpriority = '2-HIGH'), true), ('x_e', (SELECT count(*) FROM orders WHERE o_orderstatus = 'O'), false)) AS v("column", support, layer))
SELECT "column", support::BIGINT AS support, row_number() OVER (ORDER BY layer DESC, support DESC)::INT AS rank FROM s WHERE support >= 5 AND (SELECT count(*) FROM orders) - support >= 5""")
def common_causes(spark, orders):
    known = spark.createDataFrame([(*x, k) for k, x in enumerate(VARIABLES)], "column string, label string, is_layer_variable boolean, seq long")
    tests = {"x_t": "o_totalprice > 100000", "x_m1": "o_orderpriority = '1-URGENT'", "x_m2": "o_orderpriority = '2-HIGH'", "x_u": "o_orderstatus = 'F'", "x_o": "o_orderstatus = 'P'", "x_a": "o_orderpriority = '5-LOW'", "x_e": "o_orderstatus = 'O'"}
    counts = orders.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.expr(x)).alias(c) for c, x in tests.items()))
    support = counts.select("n", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("support")) for c in tests))).alias("x")).select("x.*", "n")
    return causal.common_causes(known.where("column = 'x_t'"), known, support, Causal(min_support=5)).select("column", "support", "rank")


TABLE_SQL = """SELECT l_shipmode_t AS treatment, count(*) FILTER (t = 1 AND y = 1)::BIGINT AS treated_severe_n, count(*) FILTER (t = 1 AND y = 0)::BIGINT AS treated_nonsevere_n,
  count(*) FILTER (t = 0 AND y = 1)::BIGINT AS control_severe_n, count(*) FILTER (t = 0 AND y = 0)::BIGINT AS control_nonsevere_n
FROM (SELECT 'quantity' AS l_shipmode_t, (l_quantity > 25)::INT AS t, (l_returnflag = 'R')::INT AS y FROM lineitem UNION ALL SELECT 'status', (l_linestatus = 'F')::INT, (l_returnflag = 'R')::INT FROM lineitem) GROUP BY 1"""


def tables(lineitem: DataFrame) -> DataFrame:
    flags = F.array(F.struct(F.lit("quantity").alias("treatment"), (F.col("l_quantity") > 25).cast("int").alias("t")), F.struct(F.lit("status").alias("treatment"), (F.col("l_linestatus") == "F").cast("int").alias("t")))
    rows = lineitem.select((F.col("l_returnflag") == "R").cast("int").alias("y"), F.explode(flags).alias("x")).select("y", "x.*")
    return rows.groupBy("treatment").agg(*causal.contingency(F.col("t"), F.col("y")))


@query(f"""WITH c AS ({TABLE_SQL}) SELECT *, treated_severe_n + treated_nonsevere_n AS treated_n, control_severe_n + control_nonsevere_n AS control_n,
  round(treated_severe_n / (treated_severe_n + treated_nonsevere_n)::DOUBLE, 6) AS treated_severe_rate, round(control_severe_n / (control_severe_n + control_nonsevere_n)::DOUBLE, 6) AS control_severe_rate,
  round(treated_severe_n / (treated_severe_n + treated_nonsevere_n)::DOUBLE - control_severe_n / (control_severe_n + control_nonsevere_n)::DOUBLE, 6) AS unadjusted_risk_difference FROM c""")
def contingency_2x2(lineitem):
    return rounded(causal.risk_summary(tables(lineitem)), "treated_severe_rate", "control_severe_rate", "unadjusted_risk_difference")


@query(f"""WITH c AS ({TABLE_SQL}), d AS (SELECT treatment, treated_severe_n AS a, treated_nonsevere_n AS b, control_severe_n AS c, control_nonsevere_n AS d FROM c)
SELECT treatment, CASE WHEN a + b < 20 THEN 'low_support' WHEN c + d < 20 THEN 'low_control_support' WHEN a + c = 0 OR b + d = 0 THEN 'outcome_has_no_variation'
  WHEN least(a, b, c, d) = 0 THEN 'separation_or_empty_cell:[' || a || ', ' || b || ', ' || c || ', ' || d || ']' ELSE '' END AS reason FROM d""")
def skip_reason(lineitem):
    return tables(lineitem).select("treatment", causal.skip_reason(20).alias("reason"))


def design(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("k"), (F.col("l_quantity") > 25).cast("int").alias("t"), (F.col("l_linestatus") == "F").cast("int").alias("c1"), (F.col("l_discount") > 0.05).cast("int").alias("c2"), (F.col("l_extendedprice") > 30000).cast("int").alias("y"))


DESIGN_SQL = "SELECT l_orderkey || '-' || l_linenumber AS k, (l_quantity > 25)::INT AS t, (l_linestatus = 'F')::INT AS c1, (l_discount > 0.05)::INT AS c2, (l_extendedprice > 30000)::INT AS y FROM lineitem"


@query(f"SELECT round(regr_slope(y, t), 6) AS effect FROM ({DESIGN_SQL})")
def ols_effect_1(spark, lineitem):
    return spark.createDataFrame([(round(causal.linear_effect(design(lineitem), "t", "y"), 6),)], "effect double")


@query(f"""WITH m AS (SELECT covar_pop(t, t) AS tt, covar_pop(c1, c1) AS aa, covar_pop(c2, c2) AS bb, covar_pop(t, c1) AS ta, covar_pop(t, c2) AS tb, covar_pop(c1, c2) AS ab, covar_pop(t, y) AS ty, covar_pop(c1, y) AS ay, covar_pop(c2, y) AS yb FROM ({DESIGN_SQL}))
SELECT round((ty * (aa * bb - ab * ab) - ta * (ay * bb - ab * yb) + tb * (ay * ab - aa * yb)) / (tt * (aa * bb - ab * ab) - ta * (ta * bb - ab * tb) + tb * (ta * ab - aa * tb)), 6) AS effect FROM m""")
def ols_effect_k(spark, lineitem):
    return spark.createDataFrame([(round(causal.linear_effect(design(lineitem), "t", "y", ["c1", "c2"]), 6),)], "effect double")


CELLS = {"t": ["t"], "t|c": ["t", "c1", "c2"]}


@query(f"""WITH d AS ({DESIGN_SQL}) SELECT 't' AS design, t::BIGINT AS mask, y, count(*)::BIGINT AS n FROM d GROUP BY ALL
UNION ALL SELECT 't|c', (t + 2 * c1 + 4 * c2)::BIGINT, y, count(*)::BIGINT FROM d GROUP BY ALL""")
def design_cells(lineitem):
    return causal.design_cells(design(lineitem), CELLS, "y")


def cells_of(lineitem: DataFrame, name: str) -> causal.Cells:
    rows = causal.design_cells(design(lineitem), {name: CELLS[name]}, "y").collect()
    return causal.Cells.of([(r["mask"], r.y, r.n) for r in rows], len(CELLS[name]))


@query(f"SELECT round(regr_slope(y, t), 6) AS effect FROM ({DESIGN_SQL})")
def cells_effect(spark, lineitem):
    return spark.createDataFrame([(round(cells_of(lineitem, "t").effect(), 6),)], "effect double")


@query()
def bootstrap_ci(spark, lineitem):
    """500 replicates; random draws, so there is no SQL for it."""
    b = cells_of(lineitem, "t|c").bootstrap(Causal().bootstrap_n, Causal().seed)
    return spark.createDataFrame([(b["bootstrap_n"], b["ci95_low"], b["ci95_high"], b["bootstrap_se"], b["p_value_normal_approx"])], "n bigint, low double, high double, se double, p double")


def refuted(spark: SparkSession, refuter: str, estimate: float, found: list[float], expected: float) -> DataFrame:
    r = causal.refutation(refuter, estimate, found, expected)
    return spark.createDataFrame([(refuter, r["estimated_effect"], r["new_effect"], r["p_value"])], "refuter string, estimated_effect double, new_effect double, p_value double")


@query()
def placebo_refute(spark, lineitem):
    cells = cells_of(lineitem, "t|c")
    return refuted(spark, "placebo_treatment_refuter", cells.effect(), cells.placebo(Causal().refuter_n, Causal().seed), 0.0)


@query()
def random_cause_refute(spark, lineitem):
    cells = cells_of(lineitem, "t|c")
    return refuted(spark, "random_common_cause", cells.effect(), cells.random_cause(Causal().refuter_n, Causal().seed), cells.effect())
