"""More queries on the driver tables: cases and their fields, staged votes, graphs of cases, fusion records and the batch of effects.

Tables stand in for reports: a user's events are the paragraphs of a file, orders are cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline import vocabulary as v
from faultline.catalogue import FEATURES_SQL, column_sql, order_graph, query
from faultline.functions import text as t
from faultline.functions import values
from faultline.operators import causal, cases, extraction, fusion, graph, privacy, votes
from faultline.settings import Extraction


def literals(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def any_of(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


# --- cases of a file ---


def paragraphs(events: DataFrame) -> DataFrame:
    kind, key = F.col("event_type"), F.col("event_id").cast("string")
    text = (
        F.when((kind == "signup") & (F.col("value") > 50), F.concat(F.lit("【案例"), key, F.lit("】 signup"), key))
        .when(kind == "signup", F.concat(F.lit("事故案例 "), F.col("user_id").cast("string"), F.lit("-"), key))
        .when(kind == "purchase", F.concat(F.lit("【事故经过】 bought "), F.col("props")))
        .when(kind == "click", F.concat(F.lit("事故原因：clicked "), key))
        .when(kind == "error", F.concat(F.lit("第3章 "), key))
        .otherwise(F.when(F.col("value") > 50, F.repeat(F.lit("v"), 130)).otherwise(F.concat(F.lit("view "), key)))
    )
    return events.select(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("source_file"), F.col("user_id").alias("file_seq"), F.col("event_id").alias("para_no"), text.alias("text"))


CASES_SQL = """WITH p AS (SELECT user_id, event_id, event_type, event_type = 'signup' AS h, CASE WHEN event_type = 'signup' THEN CASE WHEN value > 50 THEN event_id::VARCHAR ELSE user_id || '-' || event_id END END AS no,
  CASE WHEN event_type = 'signup' AND value > 50 THEN 'signup' || event_id END AS ht,
  CASE event_type WHEN 'purchase' THEN 'process_text' WHEN 'click' THEN 'cause_text' END AS own_key, CASE event_type WHEN 'purchase' THEN 'bought ' || props WHEN 'click' THEN 'clicked ' || event_id END AS own_body,
  CASE WHEN event_type = 'signup' THEN CASE WHEN value > 50 THEN '【案例' || event_id || '】 signup' || event_id ELSE '事故案例 ' || user_id || '-' || event_id END WHEN event_type = 'purchase' THEN '【事故经过】 bought ' || props
    WHEN event_type = 'click' THEN '事故原因：clicked ' || event_id WHEN event_type = 'error' THEN '第3章 ' || event_id WHEN value > 50 THEN repeat('v', 130) ELSE 'view ' || event_id END AS text FROM events),
s AS (SELECT *, (sum(h::INT) OVER (PARTITION BY user_id ORDER BY event_id))::BIGINT AS case_ord FROM p),
c AS (SELECT user_id, case_ord, max(no) AS no, coalesce(max(ht), arg_min(text, event_id) FILTER (NOT h AND length(text) <= 120), '') AS title FROM s WHERE case_ord > 0 GROUP BY ALL)"""


@query(f"""{CASES_SQL} SELECT user_id AS file_seq, case_ord, event_id AS para_no, c.no AS source_case_no, title, h AS is_heading, md5(text) AS text FROM s JOIN c USING (user_id, case_ord)""")
def split_cases(events):
    return cases.split_cases(paragraphs(events)).select("file_seq", "case_ord", "para_no", "source_case_no", "title", "is_heading", F.md5("text").alias("text"))


@query(f"""{CASES_SQL}, k AS (SELECT s.*, c.no AS case_no, title, CASE WHEN NOT h THEN last_value(own_key IGNORE NULLS) OVER (PARTITION BY user_id, case_ord ORDER BY event_id ROWS UNBOUNDED PRECEDING) END AS key,
  CASE WHEN own_key IS NOT NULL THEN own_body WHEN NOT h AND event_type <> 'error' THEN text END AS said FROM s JOIN c USING (user_id, case_ord)),
g AS (SELECT user_id, case_ord, case_no, title, string_agg(text, chr(10) ORDER BY event_id) AS raw, coalesce(string_agg(said, chr(10) ORDER BY event_id) FILTER (key = 'process_text'), '') AS process_text, coalesce(string_agg(said, chr(10) ORDER BY event_id) FILTER (key = 'cause_text'), '') AS cause_text FROM k GROUP BY ALL)
SELECT 'HCA-' || substr(md5('f' || user_id || '::' || case_no || '::' || title), 1, 10) AS case_id, case_no AS source_case_no, title, md5(raw) AS raw_text, md5(process_text) AS process_text, md5(cause_text) AS cause_text, '' AS location FROM g WHERE length(raw) >= 80""")
def parse_cases(events):
    found = cases.build_cases(paragraphs(events))
    return found.select("case_id", "source_case_no", "title", *(F.md5(c).alias(c) for c in ("raw_text", "process_text", "cause_text")), "location")


# --- text and values ---


@query("""SELECT p_partkey, p_name AS plain, CASE WHEN p_size > 25 THEN p_brand || chr(10) || p_type ELSE p_type END AS joined FROM part""")
def headings_and_joins(part):
    parts = F.array(F.lit(None).cast("string"), F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise(""), F.col("p_type"))
    return part.select("p_partkey", t.strip_bracket_heading(F.concat(F.lit("【"), "p_brand", F.lit("】  "), "p_name")).alias("plain"), t.join_filled(parts).alias("joined"))


CULTURE_WORDS = ("工期", "投入", "重视", "无关", "生产与投入", "安全责任")
CULTURE_SQL = f"""WITH e AS (SELECT event_id, event_type <> 'view' AS culture, [{literals(CULTURE_WORDS)}][event_id % {len(CULTURE_WORDS)} + 1] AS label FROM events)"""


def culture_rows(events: DataFrame) -> DataFrame:
    label = F.element_at(F.array(*map(F.lit, CULTURE_WORDS)), (F.col("event_id") % len(CULTURE_WORDS) + 1).cast("int"))
    return events.select("event_id", F.when(F.col("event_type") == "view", "UnsafeAction").otherwise("SafetyCultureDefect").alias("kind"), label.alias("label"))


@query(f"""{CULTURE_SQL} SELECT event_id, CASE WHEN NOT culture THEN label {" ".join(f"WHEN {any_of('label', words)} THEN '{name}'" for words, name in v.CULTURE_LABELS)} ELSE label END AS label FROM e""")
def culture_labels(events):
    return culture_rows(events).select("event_id", t.culture_label(F.col("kind"), F.concat(F.lit(" "), "label")).alias("label"))


EVIDENCE = ("监督检查不力", "监督检查不力，长期如此", "安全文化缺失", "无", "方案")


@query(f"""WITH e AS (SELECT event_id, event_type = 'click' AS culture, value > 50 AS said, [{literals(EVIDENCE)}][event_id % {len(EVIDENCE)} + 1] AS x FROM events),
m AS (SELECT *, {any_of("x", v.CULTURE_MARKERS)} AS marked, {any_of("x", v.MANAGEMENT_MARKERS)} AS management FROM e)
SELECT event_id, CASE WHEN NOT culture THEN '' WHEN NOT marked AND NOT said THEN 'culture_marker_missing' WHEN management AND NOT marked THEN 'management_evidence_only' ELSE '' END AS errors FROM m""")
def culture_evidence(events):
    evidence = F.element_at(F.array(*map(F.lit, EVIDENCE)), (F.col("event_id") % len(EVIDENCE) + 1).cast("int"))
    kind = F.when(F.col("event_type") == "click", "SafetyCultureDefect").otherwise("UnsafeAction")
    d = events.select("event_id", F.lit("yes").alias("answer"), kind.alias("entity_type"), F.lit("l").alias("label"), evidence.alias("evidence_text"), F.when(F.col("value") > 50, "流于形式").alias("rationale"))
    return votes.validate_decisions(d).select("event_id", F.array_join("errors", ",").alias("errors"))


@query(f"""WITH p AS (SELECT p_partkey, replace(p_name, ' ', '') AS n, p_size || ' ' || p_name AS d, [{literals(v.FEATURE_LABELS)}][p_partkey % 8 + 1] AS label, [{literals(v.FEATURE_LABELS.values())}][p_partkey % 8 + 1] AS short FROM part)
SELECT p_partkey, 'x_' || short || '_' || substr(md5(label || '::' || n), 1, 10) AS feature, 'layer_' || label AS layer, 'v_' || replace(d, ' ', '_') AS dot FROM p""")
def variable_names(part):
    label = F.element_at(F.array(*map(F.lit, v.FEATURE_LABELS)), (F.col("p_partkey") % 8 + 1).cast("int"))
    dot = t.dot_id(F.concat(F.col("p_size").cast("string"), F.lit(" "), "p_name"))
    return part.select("p_partkey", t.feature_column(label, F.col("p_name")).alias("feature"), t.layer_column(label).alias("layer"), dot.alias("dot"))


@query("""SELECT event_id, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS n_items, CASE WHEN event_type = 'error' THEN -1.0 ELSE value::DOUBLE END AS number, CASE event_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'L' ELSE 'KGNode' END AS kind,
  CASE WHEN event_type = 'error' THEN 0.0 ELSE round(value / (event_id % 5 + 1), 6) * greatest(3 - event_id % 5, 0) END AS remaining, event_type = 'click' AS running FROM events""")
def plain_values(events):
    """Lists of one, numbers read from text, kinds by precedence, averages and times left; a start that is no time or in the future has run for 0 seconds."""
    kind = F.col("event_type")
    n = F.col("event_id") % 5
    number = values.safe_double(F.when(kind == "error", "1,5").otherwise(F.col("value").cast("string")), -1.0)
    average = F.round(values.average_seconds(F.col("value"), F.when(kind == "error", 0).otherwise(n + 1)), 6)
    started = F.when(kind == "click", "2020-01-01T00:00:00+00:00").when(kind == "view", "2999-01-01T00:00:00+00:00").otherwise("soon")
    return events.select(
        "event_id",
        F.size(values.as_list(F.when(kind != "view", kind).otherwise(""))).alias("n_items"),
        number.alias("number"),
        values.entity_type(F.when(kind == "click", kind).otherwise(""), F.when(kind == "view", "L")).alias("kind"),
        values.remaining_seconds(average, 3 - n).alias("remaining"),
        (values.running_seconds(started) > 0).alias("running"),
    )


@query("""WITH s AS (SELECT n_nationkey, n_nationkey / 8.0 AS z, unnest(range(2000)) AS k FROM nation)
SELECT n_nationkey, CASE WHEN n_nationkey % 7 <> 0 THEN round(1 - 2 * sum(exp(-power((k + 0.5) * z / 2000, 2) / 2) / sqrt(2 * pi()) * z / 2000), 6) END AS p FROM s GROUP BY 1""")
def normal_p(spark, nation):
    """Of a few rows, by the driver; the SQL integrates the density."""
    rows = [(r[0], values.two_sided_p(r[0] / 8, float(r[0] % 7 != 0))) for r in nation.select("n_nationkey").collect()]
    return spark.createDataFrame([(k, None if p is None else round(p, 6)) for k, p in rows], "n_nationkey bigint, p double")


# --- staged extraction ---


def mentions(events: DataFrame) -> DataFrame:
    name = F.when(F.col("event_id") % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), F.floor(F.col("value") / 10).cast("string"), F.lit(" ")))
    return events.select(F.col("user_id").cast("string").alias("case_id"), F.col("event_id").cast("int").alias("pos"), name.alias("entity_name"), F.lit("UnsafeAction").alias("entity_type"), F.when(F.col("event_id") % 11 != 0, "e").alias("evidence_text"), "event_type")


MENTIONS_SQL = """WITH m AS (SELECT user_id::VARCHAR AS case_id, event_id::INT AS pos, floor(value / 10)::BIGINT::VARCHAR AS entity_name, event_type FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0)"""


@query(f"""{MENTIONS_SQL} SELECT case_id, entity_name, pos, (event_type <> 'click')::INT AS round FROM m WHERE event_type IN ('click', 'view')
QUALIFY row_number() OVER (PARTITION BY case_id, entity_name ORDER BY event_type <> 'click', pos) = 1""")
def merged_rounds(events):
    """Entities found in two rounds, those without a name or evidence left out."""
    found = extraction.clean_entities(mentions(events))
    rounds = [found.where(F.col("event_type") == k).drop("event_type") for k in ("click", "view")]
    return extraction.merge_found(*rounds).select("case_id", "entity_name", "pos", "round")


class Builder:
    """A chat service that says yes to all questions about building."""

    def json_chat(self, prompt: str) -> dict:
        return {"answer": "yes" if "BUILDING" in prompt else "no", "label": "l", "confidence": 0.5}


DIRECT = [(k, q.question_id) for k, q in enumerate(v.questions_of("direct_cause"))]


@query(f"""SELECT c_custkey::VARCHAR AS case_id, q AS asked_id, c_custkey * 100 + k AS seq, 3 AS vote_count, CASE WHEN c_mktsegment = 'BUILDING' THEN 3 ELSE 0 END AS yes, c_mktsegment = 'BUILDING' AS accepted
FROM customer CROSS JOIN (VALUES {", ".join(f"({k}, '{q}')" for k, q in DIRECT)}) AS q(k, q)""")
def question_votes(customer):
    """Each case meets the questions of a stage; three votes each, tallied."""
    asked = customer.select(F.col("c_custkey").cast("string").alias("case_id"), F.col("c_mktsegment").alias("raw_text"), F.lit("").alias("context_id"), F.lit("").alias("context"), F.col("c_custkey").alias("seq"))
    cast = extraction.cast_votes(asked, v.questions_of("direct_cause"), Builder, Extraction())
    return votes.tally(cast, ["case_id", "context_id", "seq"]).select("case_id", "asked_id", "seq", "vote_count", "yes", "accepted")


KINDS = {"click": ("hasDirectCause", "UnsafeAction", "direct"), "view": ("hasDirectCause", "UnsafeObjectState", "direct"), "signup": ("hasCapabilityCause", "SafetyCapabilityDefect", "capability"), "purchase": ("hasManagementCause", "SafetyManagementDefect", "management"), "error": ("hasCultureCause", "SafetyCultureDefect", "culture")}


def decided(events: DataFrame) -> DataFrame:
    """A user's events as decisions, some without a label, in the order of their ids."""
    kinds = F.create_map(*(x for k, row in KINDS.items() for x in (F.lit(k), F.array(*map(F.lit, row)))))[F.col("event_type")]
    key = F.col("event_id").cast("string")
    return events.select(
        F.col("user_id").cast("string").alias("case_id"), F.concat(F.lit("Q"), key).alias("question_id"), F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("n"), key)).alias("label"),
        kinds[0].alias("relation_type"), kinds[1].alias("entity_type"), kinds[2].alias("stage"), F.col("event_id").cast("int").alias("pos"), F.col("event_id").cast("int").alias("step"), (F.col("value") > 10).alias("accepted"),
        F.lit("yes").alias("answer"), F.lit("e").alias("evidence_text"), F.lit("r").alias("rationale"), F.lit(3).alias("yes"), F.lit(1).alias("no"), F.lit(4).alias("vote_count"), F.lit(2).alias("margin"), F.lit(1).alias("min_vote_margin"),
        F.lit(0.5).alias("confidence"), F.lit(False).alias("needs_review"), F.lit("valid").alias("validation_status"),
    )


DECIDED_SQL = f"""WITH k(event_type, type, label, stage) AS (VALUES {", ".join(f"('{k}', {literals(row)})" for k, row in KINDS.items())}),
d AS (SELECT user_id::VARCHAR AS case_id, event_id, type, stage, value > 10 AS accepted, CASE WHEN event_id % 3 = 0 THEN 'Q' ELSE 'n' END || event_id AS name, k.label || ':' || md5(k.label || '::' || CASE WHEN event_id % 3 = 0 THEN 'Q' ELSE 'n' END || event_id) AS node, k.label AS label FROM events JOIN k USING (event_type))"""
ANCHORS_SQL = """a AS (SELECT case_id, arg_max(node, event_id) FILTER (label = 'UnsafeAction') AS action, arg_max(node, event_id) FILTER (type = 'hasDirectCause') AS cause, arg_max(node, event_id) FILTER (type = 'hasManagementCause') AS defect FROM d WHERE accepted GROUP BY 1),
e AS (SELECT d.case_id, CASE type WHEN 'hasDirectCause' THEN 'AccidentCase:' || d.case_id WHEN 'hasCapabilityCause' THEN action WHEN 'hasManagementCause' THEN coalesce(cause, 'AccidentCase:' || d.case_id) ELSE defect END AS source_id, type, node AS target_id FROM d JOIN a USING (case_id) WHERE accepted)"""


def case_graph(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    known = events.select(F.col("user_id").cast("string").alias("case_id")).distinct().withColumn("title", F.lit(""))
    none = known.where("false").select("case_id", *(F.lit("").alias(c) for c in ("entity_type", "entity_name", "evidence_text", "source_span_id", "entity_description")), F.lit(0).alias("pos"))
    return extraction.decisions_to_graph(known, none, decided(events))


@query(f"{DECIDED_SQL}, {ANCHORS_SQL} SELECT * FROM e WHERE source_id IS NOT NULL")
def decision_edges(events):
    return case_graph(events)[1].select("case_id", "source_id", "type", "target_id")


@query(f"""{DECIDED_SQL} SELECT case_id, node AS id, label, name, '{{"vote_count":4,"yes":3,"no":1,"margin":2,"min_vote_margin":1}}' AS vote_summary FROM d WHERE accepted
UNION ALL SELECT DISTINCT user_id::VARCHAR, 'AccidentCase:' || user_id, 'AccidentCase', user_id::VARCHAR, NULL FROM events""")
def decision_nodes(events):
    return case_graph(events)[0].select("case_id", "id", "label", "name", "vote_summary")


@query(f"""{DECIDED_SQL} SELECT case_id, stage, (list_position(['direct', 'capability', 'management', 'culture', 'process'], stage) - 1) * 10000 + event_id AS step, 3 AS yes, accepted FROM d""")
def collected_votes(events):
    """The groups of decisions, one after the other."""
    rows = decided(events).drop("step")
    found = {g: rows.where(F.col("stage") == g) for g in extraction.GROUPS}
    return extraction.collect_votes(extraction.all_decisions(found)).select("case_id", "stage", "step", "yes", "accepted")


@query("""SELECT event_id, '{"question_id":"Q' || event_id || '","answer":"yes",' || CASE WHEN event_id % 3 <> 0 THEN '"label":"n' || event_id || '",' ELSE '' END || '"entity_type":"UnsafeAction","relation_type":"hasDirectCause","evidence_text":"e","confidence":0.5,"needs_review":false}' AS snapshot
FROM events WHERE event_type = 'click'""")
def decision_snapshots(events):
    return decided(events.where("event_type = 'click'")).select(F.col("pos").cast("bigint").alias("event_id"), F.to_json(votes.snapshot()).alias("snapshot"))


# --- graphs of cases ---


def reported(orders: DataFrame) -> DataFrame:
    """Orders as cleaned cases: a type, and for some a consequence, a direct cause and measures."""
    status, customer = F.col("o_orderstatus"), F.col("o_custkey").cast("string")
    return orders.select(F.col("o_orderkey").cast("string").alias("case_id"), F.lit("f").alias("source_file"), F.lit("t").alias("title"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("accident_type"), F.when(status == "F", "死亡").otherwise(" ").alias("consequence_text"), F.when(status != "O", F.concat(F.lit(" d"), customer)).alias("direct_cause_text"), F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("m"), customer)).alias("measures_text"))


REPORTED_SQL = """WITH c AS (SELECT o_orderkey, 'AccidentCase:' || o_orderkey AS anchor, o_orderpriority AS prio, o_orderstatus AS s, CASE WHEN o_orderstatus <> 'O' THEN 'd' || o_custkey END AS cause, CASE WHEN o_custkey % 3 = 0 THEN 'm' || o_custkey END AS measure FROM orders),
i AS (SELECT *, 'AccidentType:' || md5('AccidentType::' || prio) AS i_type, 'Consequence:' || md5('Consequence::死亡') AS i_end, 'UnsafeObjectState:' || md5('UnsafeObjectState::' || cause) AS i_cause, 'PreventiveMeasure:' || md5('PreventiveMeasure::' || measure) AS i_measure FROM c)"""


@query(f"""{REPORTED_SQL} SELECT anchor AS source_id, 'hasAccidentType' AS type, i_type AS target_id, o_orderkey::VARCHAR AS case_id FROM i UNION ALL SELECT anchor, 'hasConsequence', i_end, o_orderkey::VARCHAR FROM i WHERE s = 'F'
UNION ALL SELECT anchor, 'hasDirectCause', i_cause, o_orderkey::VARCHAR FROM i WHERE cause IS NOT NULL UNION ALL SELECT i_cause, 'controlledBy', i_measure, o_orderkey::VARCHAR FROM i WHERE cause IS NOT NULL AND measure IS NOT NULL""")
def case_report_edges(orders):
    return graph.build_from_cases(reported(orders))[1].select("source_id", "type", "target_id", "case_id")


@query(f"""{REPORTED_SQL}, n AS (SELECT anchor AS id, 'AccidentCase' AS label, 't' AS name, false AS needs_review FROM i UNION SELECT i_type, 'AccidentType', prio, false FROM i UNION SELECT i_end, 'Consequence', '死亡', false FROM i WHERE s = 'F'
UNION SELECT i_cause, 'UnsafeObjectState', cause, true FROM i WHERE cause IS NOT NULL UNION SELECT i_measure, 'PreventiveMeasure', measure, false FROM i WHERE measure IS NOT NULL) SELECT * FROM n""")
def case_report_nodes(orders):
    return graph.build_from_cases(reported(orders))[0].select("id", "label", "name", "needs_review")


def extracted(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of extraction results: a type for each order, labels outside the ontology, foreign accident nodes, edges without an end."""
    key = F.col("o_orderkey").cast("string")
    base = orders.select(key.alias("case_id"), F.lit("f").alias("source_file"), F.lit("").alias("title"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("status"))
    anchor, bogus = F.concat(F.lit("AccidentCase:"), "case_id"), F.concat(F.lit("Bogus:"), "case_id")
    kind = F.concat(F.lit("AccidentType:"), "name")
    listed = F.array(F.struct(kind.alias("id"), F.lit("AccidentType").alias("label")), F.when(F.col("status") == "P", F.struct(bogus.alias("id"), F.lit("Bogus").alias("label"))), F.when(F.col("status") == "O", F.struct(F.lit("AccidentCase:x").alias("id"), F.lit("AccidentCase").alias("label"))))
    entities = base.select("case_id", "source_file", F.explode(F.array_compact(listed)).alias("x"), "name", F.concat(F.lit("e"), "case_id").alias("evidence_text"), F.lit(False).alias("needs_review"), "seq").select("*", "x.*").drop("x")
    stated = base.where("status <> 'O'").select("case_id", "source_file", anchor.alias("source_id"), F.when(F.col("status") == "F", "hasAccidentType").otherwise("leadTo").alias("type"), F.when(F.col("status") == "F", kind).otherwise(bogus).alias("target_id"), F.lit("said").alias("evidence_text"), "seq")
    return graph.build_from_extraction(base.select("case_id", "source_file", "title", "seq"), entities, stated)


@query("""SELECT 'AccidentCase:' || o_orderkey AS source_id, 'hasAccidentType' AS type, 'AccidentType:' || o_orderpriority AS target_id, CASE WHEN o_orderstatus = 'F' THEN 'said' ELSE 'e' || min(o_orderkey) OVER (PARTITION BY o_orderpriority) END AS evidence_text, o_orderkey::VARCHAR AS cases FROM orders""")
def extraction_edges(orders):
    return extracted(orders)[1].select("source_id", "type", "target_id", "evidence_text", F.array_join("source_cases", ",").alias("cases"))


@query("""SELECT 'AccidentType:' || o_orderpriority AS id, 'AccidentType' AS label, o_orderpriority AS name, min(o_orderkey)::VARCHAR AS cases FROM orders GROUP BY o_orderpriority
UNION ALL SELECT 'AccidentCase:' || o_orderkey, 'AccidentCase', o_orderkey::VARCHAR, o_orderkey::VARCHAR FROM orders""")
def extraction_nodes(orders):
    return extracted(orders)[0].select("id", "label", "name", F.array_join("source_cases", ",").alias("cases"))


@query("""SELECT c_mktsegment, bool_and(c_acctbal >= 0 AND n_name <> 'NATION_3') AS valid, count(*) FILTER (NOT (c_acctbal >= 0 AND n_name <> 'NATION_3'))::BIGINT AS invalid_edges FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""")
def edge_validity(spark, customer, nation):
    """Edges without evidence, or whose nation is of another type, are invalid."""
    nodes = customer.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit("C").alias("label")).unionByName(nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.when(F.col("n_name") == "NATION_3", "X").otherwise("N").alias("label")))
    edges = customer.select("c_mktsegment", F.concat(F.lit("c"), "c_custkey").alias("source_id"), F.lit("in").alias("type"), F.concat(F.lit("n"), "c_nationkey").alias("target_id"), F.when(F.col("c_acctbal") >= 0, "e").otherwise(" ").alias("evidence_text"))
    return graph.graph_validity(graph.check_relations(edges, nodes, graph.relation_table(spark, {"in": (("C",), ("N",))})), ["c_mktsegment"])


def anchored(orders: DataFrame) -> DataFrame:
    """Accident nodes: those of even keys list two cases, the others none."""
    key = F.col("o_orderkey").cast("string")
    listed = F.when(F.col("o_orderkey") % 2 == 0, F.array(key, F.concat(key, F.lit("b")))).otherwise(F.array().cast("array<string>"))
    return orders.select(F.concat(F.lit("AccidentCase:"), key).alias("id"), F.lit("AccidentCase").alias("label"), F.lit("order").alias("name"), F.lit(None).cast("string").alias("case_id"), listed.alias("source_cases"))


@query("""WITH a AS (SELECT o_orderkey, unnest(CASE WHEN o_orderkey % 2 = 0 THEN [o_orderkey::VARCHAR, o_orderkey || 'b'] ELSE [o_orderkey::VARCHAR] END) AS of_case FROM orders)
SELECT 'c' || o_custkey AS target_id, of_case FROM a JOIN orders USING (o_orderkey) UNION ALL SELECT 'c' || o_custkey, 'own' || o_orderkey FROM orders WHERE o_orderstatus = 'F'""")
def edge_memberships(orders):
    """Cases of edges: their own, and those of the accident node that they start from."""
    edges = orders.select(F.concat(F.lit("AccidentCase:"), F.col("o_orderkey").cast("string")).alias("source_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("target_id"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("own"), F.col("o_orderkey").cast("string"))).alias("case_id"), F.array().cast("array<string>").alias("source_cases"))
    return graph.edge_cases(edges, graph.accident_cases(anchored(orders))).select("target_id", "of_case")


@query("""SELECT o_orderkey::VARCHAR AS case_id, (o_orderstatus = 'F' OR o_orderpriority = '1-URGENT')::INT AS severe_consequence FROM orders""")
def severe_outcomes(orders):
    """A case is severe by its own text or by the evidence of a consequence edge."""
    key = F.col("o_orderkey").cast("string")
    known = orders.select(key.alias("case_id"), F.when(F.col("o_orderstatus") == "F", "一人死亡").alias("consequence_text"), F.lit("").alias("economic_loss_text"), F.lit(None).cast("string").alias("raw_text"))
    edges = orders.select(F.concat(F.lit("AccidentCase:"), key).alias("source_id"), F.lit("hasConsequence").alias("type"), F.lit("Consequence:1").alias("target_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "造成重伤").alias("evidence_text"), F.lit(None).cast("string").alias("case_id"), F.array().cast("array<string>").alias("source_cases"))
    return causal.outcomes(anchored(orders), edges, known)


# --- privacy and fusion records ---


@query("""SELECT count(*)::BIGINT AS case_count, (2 * count(*) - count(*) FILTER (c_custkey % 2 = 0))::BIGINT AS n_persons, 0::BIGINT AS n_organizations, 0::BIGINT AS n_projects, false AS mapping_saved FROM customer""")
def anonymization_totals(customer):
    """Two persons in a text, or one; a name in a column that is not sensitive does not count."""
    told = F.when(F.col("c_custkey") % 2 == 0, "死者张某在作业。").otherwise("死者张某在作业。伤者李某送医。")
    return privacy.report(privacy.anonymize(customer.select("c_custkey", told.alias("raw_text"), F.lit("死者王某").alias("note"))))


def aligned(part: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mentions, and their alignment by equal names; large ones are marked for review."""
    entities = part.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("label"), F.col("p_brand").alias("case_id"), F.col("p_partkey").alias("seq"), F.lit(False).alias("needs_review"))
    status = F.when(F.col("p_size") > 40, "review_low_margin").otherwise("matched")
    alignment = part.select(F.col("p_partkey").cast("string").alias("source_entity_id"), t.canonical_id(F.col("p_type"), F.col("p_name")).alias("canonical_id"), F.col("p_name").alias("canonical_name"), status.alias("alignment_status"), F.lit("c").alias("candidate_canonical_id"), F.lit(0.75).alias("string_score"), F.lit(None).cast("double").alias("vector_score"), (F.col("p_size") / 64).alias("combined_score"))
    return entities, alignment


@query("""SELECT p_type || ':canonical:' || md5(p_type || '::' || p_name) AS id, p_name AS normalized_name, CASE WHEN count(*) > 1 THEN count(*) END::BIGINT AS mention_count, bool_or(p_size > 40) AS needs_review, arg_min(p_partkey, p_partkey)::VARCHAR AS first_mention FROM part GROUP BY p_type, p_name""")
def canonical_rows(part):
    found = fusion.canonical_entities(*aligned(part))
    return found.select("id", "normalized_name", "mention_count", "needs_review", F.element_at("source_entity_ids", 1).alias("first_mention"))


CONFLICTS_SQL = """WITH n AS (SELECT replace(p_name, ' ', '') AS name FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1)"""


@query(f"""{CONFLICTS_SQL} SELECT 'same_name_different_type' AS conflict_type, name AS what, NULL::DOUBLE AS combined_score FROM n UNION ALL SELECT 'low_margin_entity_alignment', p_partkey::VARCHAR, round(p_size / 64.0, 6) FROM part WHERE p_size > 40""")
def all_conflicts(part):
    return fusion.conflicts(*aligned(part)).select("conflict_type", F.coalesce("normalized_name", "source_entity_id").alias("what"), F.round("combined_score", 6).alias("combined_score"))


@query(f"""{CONFLICTS_SQL}, c AS (SELECT count(*)::BIGINT AS raw, count(DISTINCT p_type || '/' || p_name)::BIGINT AS canonical, count(DISTINCT p_brand || '/' || p_type || '/' || p_name)::BIGINT AS triples, (count(*) FILTER (p_size > 40))::BIGINT AS doubts FROM part)
SELECT unnest(['raw_entity_count', 'raw_triple_count', 'canonical_entity_count', 'canonical_triple_count', 'merged_entity_count', 'conflict_count']) AS name, unnest([raw, raw, canonical, triples, raw - canonical, doubts + (SELECT count(*) FROM n)]) AS n FROM c""")
def fusion_counts(spark, part):
    entities, alignment = aligned(part)
    triples = part.select(F.col("p_brand").alias("source_id"), F.lit("in").alias("type"), F.col("p_partkey").cast("string").alias("target_id"))
    merged = graph.merge_relationships(graph.remap(triples, alignment))
    found = fusion.fusion_report(entities, triples, fusion.canonical_entities(entities, alignment), merged, fusion.conflicts(entities, alignment))
    return spark.createDataFrame([(k, n) for k, n in found.items() if k.endswith("_count")], "name string, n bigint")


# --- causal ---


MATRIX_SQL = f"""{FEATURES_SQL}, m AS (SELECT DISTINCT case_id, "column" FROM f UNION SELECT DISTINCT case_id, 'layer_' || label FROM f)"""


@query(f'{MATRIX_SQL} SELECT case_id, "column" FROM m')
def matrix_read_back(orders, lineitem):
    """The wide matrix with all its columns, made long again."""
    nodes, edges, known = order_graph(orders, lineitem)
    columns = [r[0] for r in causal.variables(nodes).where("not is_layer_variable").select("column").collect()]
    wide = causal.export_matrix(known, causal.outcomes(nodes, edges, known), causal.features_long(nodes, edges, known), columns)
    return causal.long_form(wide)


ORDERED = sorted(v.FEATURE_LABELS)


@query(f"""WITH x AS (SELECT DISTINCT {column_sql("UnsafeAction", "l_returnflag")} AS "column" FROM lineitem), c AS (SELECT unnest(range(4)) AS place, unnest(['case_id', 'title', 'source_file', 'severe_consequence']) AS "column"
UNION ALL SELECT 4 + unnest(range(8)), 'layer_' || unnest([{literals(ORDERED)}]) UNION ALL SELECT 12 + unnest(range(8)), 'count_' || unnest([{literals(ORDERED)}]) UNION ALL SELECT 19 + row_number() OVER (ORDER BY "column"), "column" FROM x) SELECT place::BIGINT AS place, "column" FROM c""")
def matrix_columns(spark, orders, lineitem):
    """The order of the wide matrix's columns."""
    nodes, edges, known = order_graph(orders, lineitem)
    columns = [r[0] for r in causal.variables(nodes).where("label = 'UnsafeAction' and not is_layer_variable").select("column").collect()]
    wide = causal.export_matrix(known, causal.outcomes(nodes, edges, known), causal.features_long(nodes, edges, known), columns)
    return spark.createDataFrame(list(enumerate(wide.columns)), "place bigint, column string")


def known_variables(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    return causal.variables(order_graph(orders, lineitem)[0])


@query(f"""SELECT asked, "column" FROM (SELECT unnest(['R', 'UnsafeObjectState:O', 'layer_UnsafeAction', '{v.LAYER_NAMES["SafetyCultureDefect"][2:]}']) AS asked, unnest([{column_sql("UnsafeAction", "'R'")}, {column_sql("UnsafeObjectState", "'O'")}, 'layer_UnsafeAction', 'layer_SafetyCultureDefect']) AS "column")""")
def resolved_treatments(spark, orders, lineitem):
    """By name, entity, column and a part of a name."""
    known = known_variables(orders, lineitem).cache()
    try:
        asked = ["R", "UnsafeObjectState:O", "layer_UnsafeAction", v.LAYER_NAMES["SafetyCultureDefect"][2:]]
        rows = [(x, causal.resolve_treatment(x, known)["column"]) for x in asked]
    finally:
        known.unpersist()
    return spark.createDataFrame(rows, "asked string, column string")


@query(f"""{MATRIX_SQL}, y AS (SELECT o_orderkey::VARCHAR AS case_id, (o_orderstatus = 'F')::INT AS y FROM orders), k AS (SELECT sum(y)::BIGINT AS severe, count(*)::BIGINT AS n FROM y),
t AS (SELECT "column", sum(y)::BIGINT AS a, count(*)::BIGINT AS s FROM m JOIN y USING (case_id) GROUP BY 1), q AS (SELECT "column", s, n, a, s - a AS b, severe - a AS c, n - s - severe + a AS d FROM t, k WHERE s >= 20),
r AS (SELECT *, CASE WHEN c + d < 20 THEN 'low_control_support:' || (c + d) || '<min_support:20' WHEN a + c = 0 OR b + d = 0 THEN 'outcome_has_no_variation' WHEN least(a, b, c, d) = 0 THEN 'separation_or_empty_cell:[' || a || ', ' || b || ', ' || c || ', ' || d || ']' ELSE '' END AS skip_reason FROM q)
SELECT "column", s AS support, n, a AS treated_severe_n, skip_reason, skip_reason = '' AS run_success, CASE WHEN skip_reason = '' THEN round(a / s::DOUBLE - c / (c + d)::DOUBLE, 6) END AS effect, true AS needs_review, 0::BIGINT AS common_cause_count FROM r""")
def batch_effects(spark, orders, lineitem):
    """All treatments of the order graph. No factor stands in an earlier layer, so none is adjusted for, and each wants review."""
    found = causal.analyse_batch(*order_graph(orders, lineitem))
    rows = [(r["treatment_column"], r["support"], r["n"], r["treated_severe_n"], r["skip_reason"], r["run_success"], round(r["effect_estimate"], 6) if r["run_success"] else None, r["needs_review"], r["common_cause_count"]) for r in found]
    return spark.createDataFrame(rows, "column string, support bigint, n bigint, treated_severe_n bigint, skip_reason string, run_success boolean, effect double, needs_review boolean, common_cause_count bigint")
