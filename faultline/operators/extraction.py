"""Staged extraction: evidence, entities, yes/no votes by stage, validation with repair, and the graph of each case.

Every stage is a DataFrame keyed by case; the chat port is called inside mapInPandas, one instance a task. Later stages
join on the accepted rows of earlier ones, so they run only where there is something to ask.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline import vocabulary as v
from faultline.functions.text import evidence_spans, first_filled, node_id, or_empty, strip
from faultline.operators.graph import check_relations, first_wins, relation_table
from faultline.operators.votes import dedupe_decisions, snapshot, tally, validate_decisions
from faultline.settings import Extraction
from faultline.sources.ports import ChatPort

Connect = Callable[[], ChatPort]
ENTITY = "case_id string, pos int, entity_name string, entity_type string, entity_description string, evidence_text string, source_span_id string"
ANSWER = "question_id string, answer string, label string, entity_type string, relation_type string, evidence_text string, rationale string, confidence double"
_FIELDS = [c.split()[0] for c in ANSWER.split(", ")]


# --- prompts (our own wording; field names are the protocol) ---


def entity_prompt(text: str, types: Sequence[str], known: list[dict] | None = None) -> str:
    more = f"已有结果：{json.dumps(known, ensure_ascii=False)}\n只返回补充的实体。\n" if known is not None else ""
    return f'从报告中找出实体，类型限于：{"、".join(types)}。\n返回 {{"entities": [{{"entity_name": "", "entity_type": "", "entity_description": "", "evidence_text": "", "source_span_id": ""}}]}}\n{more}事故文本：\n{text}'


def question_prompt(text: str, q: v.Question, context: str) -> str:
    rule = "\n须引用能证明组织长期价值取向的原文，一般管理缺陷不足以证明。" if q.stage == "culture_cause" else ""
    return (
        f"判断：{q.text}\n定义：{q.definition}{rule}\n证据不足或未提及时回答 no。\n背景：{context}\n"
        f'返回 {{"question_id": "{q.question_id}", "answer": "yes/no", "label": "{q.yes_label}", "entity_type": "{q.target_type}", "relation_type": "{q.relation_type or ""}", "evidence_text": "", "rationale": "", "confidence": 0.0}}\n事故文本：\n{text}'
    )


def relation_prompt(text: str, subject: str, relation: str, target: str) -> str:
    return f'判断“{subject}”与“{target}”之间是否存在关系 {relation}。\n返回 {{"answer": "yes/no", "relation_type": "{relation}", "evidence_text": "", "rationale": "", "confidence": 0.0}}\n事故文本：\n{text}'


def repair_prompt(text: str, decision: str, errors: str) -> str:
    return f"修正下列判断，使其不再有所列错误。\n判断：{decision}\n错误：{errors}\n事故文本：\n{text}"


# --- stages ---


def spans(cases: DataFrame) -> DataFrame:
    return cases.select("case_id", F.posexplode(evidence_spans(F.col("raw_text"))).alias("pos", "s")).select("case_id", "pos", "s.span_id", "s.text")


def clean_entities(entities: DataFrame) -> DataFrame:
    """Entities with a name, a type and evidence, all stripped."""
    e = entities.withColumns({c: strip(or_empty(F.col(c))) for c in ("entity_name", "entity_type", "evidence_text")})
    return e.where("entity_name <> '' and entity_type <> '' and evidence_text <> ''")


def merge_found(*rounds: DataFrame) -> DataFrame:
    """Union of rounds, the first mention of a (name, type) in a case kept."""
    parts = [r.withColumn("round", F.lit(k)) for k, r in enumerate(rounds)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return first_wins(whole, ["case_id", "entity_name", "entity_type"], ["round", "pos"])


def discover(cases: DataFrame, connect: Connect, how: Extraction, types: Sequence[str] = v.ENTITY_CLASSES) -> DataFrame:
    """Entities of each case: a first pass and gleaning rounds that know what was found."""
    names = [c.split()[0] for c in ENTITY.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        port = connect()
        for frame in frames:
            out = []
            for case_id, text in zip(frame["case_id"], frame["raw_text"]):
                found = list(port.json_chat(entity_prompt(text or "", types)).get("entities", []))
                for _ in range(how.gleaning_rounds):
                    found += port.json_chat(entity_prompt(text or "", types, found)).get("entities", [])
                out += [(case_id, k, e.get("entity_name") or e.get("name"), e.get("entity_type") or e.get("label"), e.get("entity_description"), e.get("evidence_text"), e.get("source_span_id")) for k, e in enumerate(found)]
            yield pd.DataFrame(out, columns=names)

    return merge_found(clean_entities(cases.select("case_id", "raw_text").mapInPandas(run, ENTITY))).drop("round")


def _answer(item: dict) -> tuple:
    return (*(None if item.get(k) is None else str(item[k]) for k in _FIELDS[:-1]), float(item.get("confidence") or 0))


def cast_votes(asked: DataFrame, questions: Sequence[v.Question], connect: Connect, how: Extraction) -> DataFrame:
    """Raw votes in long form. asked: case_id, raw_text, context_id, context, seq; each row meets each question (a few)."""
    listed = asked.sparkSession.createDataFrame([(k, json.dumps(asdict(q))) for k, q in enumerate(questions)], "q_seq int, question string")
    pairs = asked.crossJoin(F.broadcast(listed)).withColumn("seq", F.col("seq") * 100 + F.col("q_seq")).select("case_id", "context_id", "seq", "raw_text", "context", "question")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        port = connect()
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                prompt = question_prompt(r.raw_text or "", q := v.Question(**json.loads(r.question)), r.context or "")
                for k in range(how.vote_count):
                    item = port.json_chat(prompt)
                    out.append((r.case_id, r.context_id, r.seq, q.question_id, q.target_type, q.relation_type or "", k, *_answer(item)))
            yield pd.DataFrame(out, columns=["case_id", "context_id", "seq", "asked_id", "asked_type", "asked_relation", "vote_idx", *_FIELDS])

    return pairs.mapInPandas(run, f"case_id string, context_id string, seq bigint, asked_id string, asked_type string, asked_relation string, vote_idx int, {ANSWER}")


def repair(decisions: DataFrame, texts: DataFrame, connect: Connect, rounds: int) -> DataFrame:
    """Asks anew about invalid decisions, ``rounds`` times at most. A repaired decision loses its acceptance and votes, as it was not voted on."""
    done = decisions.withColumn("repairs", F.array().cast("array<string>"))
    for _ in range(rounds):
        wrong = done.where("not valid").join(texts.select("case_id", "raw_text"), "case_id").withColumn("before", F.to_json(snapshot()))
        kept = ["case_id", "context_id", "seq", "asked_id", "asked_type", "asked_relation"]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            port = connect()
            for frame in frames:
                out = []
                for r in frame.itertuples(index=False):
                    item = {"question_id": r.asked_id, "entity_type": r.asked_type, "relation_type": r.asked_relation} | port.json_chat(repair_prompt(r.raw_text or "", json.dumps(json.loads(r.before), ensure_ascii=False), "; ".join(r.errors)))
                    out.append((*(getattr(r, k) for k in kept), list(r.repairs) + [r.before], *_answer(item)))
                yield pd.DataFrame(out, columns=[*kept, "repairs", *_FIELDS])

        again = wrong.select(*kept, "raw_text", "before", "errors", "repairs").mapInPandas(run, f"case_id string, context_id string, seq bigint, asked_id string, asked_type string, asked_relation string, repairs array<string>, {ANSWER}")
        again = validate_decisions(again.withColumns({"accepted": F.lit(False), "needs_review": F.lit(False), "yes": F.lit(0), "no": F.lit(0)}))
        done = done.where("valid").unionByName(again, allowMissingColumns=True)
    return done.withColumn("needs_review", F.col("needs_review") | ~F.col("valid"))


def decide(asked: DataFrame, questions: Sequence[v.Question], connect: Connect, how: Extraction) -> DataFrame:
    votes = cast_votes(asked, questions, connect, how)
    decided = validate_decisions(tally(votes, ["case_id", "context_id", "seq"], min_margin=how.min_vote_margin))
    return repair(decided, asked.select("case_id", "raw_text").distinct(), connect, how.validation_rounds)


def stages(cases: DataFrame, connect: Connect, how: Extraction, save: Callable[[DataFrame, str], DataFrame] = lambda d, _: d) -> dict[str, DataFrame]:
    """All stages. ``save`` may write a stage and read it again, so that no later stage asks the service twice."""
    texts = cases.select("case_id", "raw_text")
    base = texts.withColumns({"context_id": F.lit(""), "context": F.lit(""), "seq": F.lit(0).cast("bigint")})
    direct = save(decide(base, v.questions_of("direct_cause"), connect, how), "direct")
    accepted = direct.where("accepted").join(texts, "case_id")
    said = F.concat(F.lit("直接原因: "), or_empty(F.col("label")), F.lit("; 证据: "), or_empty(F.col("evidence_text")))
    context = accepted.select("case_id", "raw_text", F.col("asked_id").alias("context_id"), said.alias("context"), "seq")
    capability = save(decide(context, v.questions_of("capability_cause"), connect, how), "capability")
    management = save(decide(context, v.questions_of("management_cause"), connect, how), "management")
    line = F.concat(F.lit("- "), or_empty(F.col("label")), F.lit(": "), or_empty(F.col("evidence_text")))
    lines = management.where("accepted").groupBy("case_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", line.alias("x")))), lambda s: s["x"]), "\n").alias("context"))
    culture = save(decide(lines.join(texts, "case_id").withColumns({"context_id": F.lit("management"), "seq": F.lit(0).cast("bigint")}), v.questions_of("culture_cause"), connect, how), "culture")
    process = save(decide(base.withColumns({"context_id": F.lit("process"), "context": F.lit("请依据事故原因、经过与措施判断。")}), v.questions_of("accident_process", "control_measure"), connect, how), "process")
    deduped = {k: dedupe_decisions(d, ["case_id"]) for k, d in (("direct", direct), ("capability", capability), ("management", management), ("culture", culture))}
    return {"spans": spans(cases), "entities": save(discover(cases, connect, how), "entities"), **deduped, "process": process.withColumn("pos", F.row_number().over(Window.partitionBy("case_id").orderBy("seq")))}


GROUPS = ("direct", "capability", "management", "culture", "process")


def all_decisions(found: dict[str, DataFrame]) -> DataFrame:
    """All groups with ``step``, their place in the case's order."""
    whole = None
    for k, g in enumerate(GROUPS):
        part = found[g].withColumns({"stage": F.lit(g), "step": F.lit(k * 10_000) + F.col("pos")})
        whole = part if whole is None else whole.unionByName(part, allowMissingColumns=True)
    return whole


def decisions_to_graph(cases: DataFrame, entities: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of each case. Capability hangs on the last unsafe action, management, process and measures on the last
    direct cause, culture on the last management defect; all direct causes of a case come before the rest."""
    label = first_filled(F.col("label"), F.col("question_id"))
    nodes = decisions.where("accepted").withColumns({"name": label, "node": node_id(F.col("entity_type"), label)})

    def last(condition: str, name: str) -> DataFrame:
        return nodes.where(condition).groupBy("case_id").agg(F.max_by("node", "step").alias(name))

    anchors = last("relation_type = 'hasDirectCause' and entity_type = 'UnsafeAction'", "action").join(last("relation_type = 'hasDirectCause'", "cause"), "case_id", "full").join(last("relation_type = 'hasManagementCause'", "defect"), "case_id", "full")
    case_node = F.concat(F.lit("AccidentCase:"), F.col("case_id"))
    kind = F.col("relation_type")
    # A management defect is placed while groups run in order: it stands before culture, after direct causes.
    source = F.when(kind == "hasDirectCause", case_node).when(kind == "hasCapabilityCause", F.col("action")).when(kind == "hasManagementCause", F.coalesce(F.col("cause"), case_node)).when(kind == "hasCultureCause", F.col("defect")).when(kind.isin("leadTo", "controlledBy"), F.col("cause"))
    edges = nodes.join(anchors, "case_id", "left").withColumn("source_id", source).where("source_id is not null")
    edges = edges.select("case_id", "source_id", kind.alias("type"), F.col("node").alias("target_id"), "question_id", "answer", "evidence_text", F.col("yes").cast("bigint").alias("vote_yes_count"), F.col("no").cast("bigint").alias("vote_no_count"), "validation_status", "needs_review", F.col("step").cast("bigint").alias("seq"))
    summary = F.to_json(F.struct("vote_count", "yes", "no", "margin", "min_vote_margin"))
    found = [
        cases.select("case_id", case_node.alias("id"), F.lit("AccidentCase").alias("label"), first_filled(F.col("title"), F.col("case_id")).alias("name"), F.lit(-2).cast("bigint").alias("seq")),
        entities.select("case_id", node_id(F.col("entity_type"), F.col("entity_name")).alias("id"), F.col("entity_type").alias("label"), F.col("entity_name").alias("name"), "evidence_text", "source_span_id", F.col("entity_description").alias("rationale"), F.lit(-1).cast("bigint").alias("seq"), "pos"),
        nodes.select("case_id", F.col("node").alias("id"), F.col("entity_type").alias("label"), "name", "evidence_text", "rationale", summary.alias("vote_summary"), "validation_status", "needs_review", F.col("step").cast("bigint").alias("seq")),
    ]
    whole = found[0].unionByName(found[1], allowMissingColumns=True).unionByName(found[2], allowMissingColumns=True)
    return first_wins(whole, ["case_id", "id"], ["seq", "pos"]).drop("pos").withColumn("normalized_name", F.col("name")), edges


def collect_votes(decisions: DataFrame) -> DataFrame:
    return decisions.select("case_id", "stage", "step", "question_id", "vote_count", "yes", "no", "accepted")


def extract(cases: DataFrame, connect: Connect, how: Extraction = Extraction(), save: Callable[[DataFrame, str], DataFrame] = lambda d, _: d) -> dict[str, DataFrame]:
    """The stages, the graph and a row for each case (case_id, source_file, title, valid, needs_review)."""
    found = stages(cases, connect, how, save)
    decisions = all_decisions(found)
    nodes, edges = decisions_to_graph(cases, found["entities"], decisions)
    # Ids are unique within a case, so ends are typed by case and id.
    scoped = lambda c: F.concat(F.col("case_id"), F.lit("\x1f"), F.col(c))
    checked = check_relations(edges.withColumns({"source_id": scoped("source_id"), "target_id": scoped("target_id")}), nodes.withColumn("id", scoped("id")), relation_table(cases.sparkSession))
    verdicts = checked.groupBy("case_id").agg(F.bool_and("valid").alias("valid"))
    doubts = decisions.groupBy("case_id").agg(F.bool_or("needs_review").alias("doubt"))
    results = cases.select("case_id", "source_file", "title", "seq").join(verdicts, "case_id", "left").join(doubts, "case_id", "left").withColumn("valid", F.coalesce("valid", F.lit(True)))
    return found | {"decisions": decisions, "votes": collect_votes(decisions), "nodes": nodes, "edges": edges, "results": results.withColumn("needs_review", ~F.col("valid") | F.coalesce("doubt", F.lit(False))).drop("doubt")}
