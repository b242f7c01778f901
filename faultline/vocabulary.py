"""Fixed values of the incident domain. Results depend on them, so they are stated as they must be; all are parameters of the operators."""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: headings of a report and the field that each starts ---
FIELD_ALIASES = {
    "日期": "date", "时间": "time", "地点": "location", "发生时间": "date_time", "发生地点": "location",
    "事故类别": "accident_type", "事故性质": "accident_type", "事故后果": "consequence_text", "伤亡情况": "consequence_text",
    "经济损失": "economic_loss_text", "事故直接原因": "direct_cause_text", "直接原因": "direct_cause_text",
    "间接原因": "indirect_cause_text", "事故经过": "process_text", "事故原因": "cause_text", "改进措施": "measures_text",
    "防范措施": "measures_text", "处理措施": "measures_text", "单位名称": "organization", "严重级别": "severity_level",
}
CASE_FIELDS = (
    "accident_type", "date", "time", "date_time", "location", "organization", "severity_level", "direct_cause_text",
    "indirect_cause_text", "cause_text", "process_text", "consequence_text", "economic_loss_text", "measures_text",
)

# --- fixed values: endings that carry no meaning, and other names of the same thing by label ---
WEAK_SUFFIXES = ("事故", "问题", "原因", "因素", "缺陷", "不到位", "不落实")
NAME_ALIASES = {
    "AccidentType": {
        "坍塌事故": "坍塌", "边坡坍塌": "坍塌", "高处坠落事故": "高处坠落", "触电事故": "触电", "起重伤害事故": "起重伤害",
        "机械伤害事故": "机械伤害", "涌水突泥": "涌水/突泥", "突泥涌水": "涌水/突泥",
    },
    "SafetyManagementDefect": {
        "安全教育不到位": "安全培训不足", "未开展安全培训": "安全培训不足", "培训不足": "安全培训不足", "安全培训流于形式": "安全培训不足",
        "培训流于形式": "安全培训不足", "隐患排查整改不落实": "隐患排查治理不到位", "隐患排查不到位": "隐患排查治理不到位",
        "现场监督检查不力": "现场安全监督不足", "安全管理不到位": "安全管理体系不完善",
    },
    "SafetyCultureDefect": {
        "重生产轻安全": "重进度轻安全", "重效益轻安全": "重进度轻安全", "安全意识淡薄": "安全责任意识淡薄",
        "安全责任意识不强": "安全责任意识淡薄", "安全投入不够": "安全投入不足",
    },
    "UnsafeAction": {"未佩戴安全带": "未系安全带", "未正确佩戴安全带": "未系安全带", "违章指挥作业": "违章指挥", "冒险施工": "冒险作业"},
    "UnsafeObjectState": {"防护措施缺失": "防护设施缺失", "临边防护缺失": "防护设施缺失", "设备带病运转": "设备带病运行", "支护不足": "支护结构不足"},
    "ConstructionActivity": {"吊装": "吊装作业", "起吊作业": "吊装作业", "混凝土浇筑": "混凝土浇筑作业", "基坑开挖": "基坑开挖作业"},
}

# --- fixed values: words of a severe consequence; labels of the case matrix ---
SEVERE_KEYWORDS = ("死亡", "抢救无效", "重伤", "较大事故", "重大事故", "特别重大事故", "直接经济损失")
FEATURE_LABELS = {
    "SafetyCultureDefect": "scd", "SafetyManagementDefect": "smd", "SafetyCapabilityDefect": "scap", "UnsafeAction": "ua",
    "UnsafeObjectState": "uos", "AccidentType": "atype", "ConstructionActivity": "act", "EnvironmentCondition": "env",
}
CAUSAL_LABELS = ("SafetyCultureDefect", "SafetyManagementDefect", "SafetyCapabilityDefect", "UnsafeAction", "UnsafeObjectState")
BATCH_LABELS = ("SafetyManagementDefect", "UnsafeAction", "UnsafeObjectState")
LAYER_ORDER = {"SafetyCultureDefect": 0, "SafetyManagementDefect": 1, "SafetyCapabilityDefect": 2, "UnsafeAction": 3, "UnsafeObjectState": 3}
CONTROL_LABELS = ("ConstructionActivity", "EnvironmentCondition")
LAYER_NAMES = {
    "SafetyCultureDefect": "存在安全文化缺陷", "SafetyManagementDefect": "存在安全管理体系缺陷", "SafetyCapabilityDefect": "存在人的安全能力缺陷",
    "UnsafeAction": "存在人的不安全动作", "UnsafeObjectState": "存在物的不安全状态", "AccidentType": "存在事故类型信息",
    "ConstructionActivity": "存在施工活动信息", "EnvironmentCondition": "存在环境条件信息",
}
CAUSAL_EDGES = (
    ("SafetyCultureDefect", "SafetyManagementDefect"), ("SafetyManagementDefect", "SafetyCapabilityDefect"), ("SafetyManagementDefect", "UnsafeObjectState"),
    ("SafetyCapabilityDefect", "UnsafeAction"), ("UnsafeAction", "severe_consequence"), ("UnsafeObjectState", "severe_consequence"),
    ("AccidentType", "severe_consequence"), ("ConstructionActivity", "UnsafeAction"), ("ConstructionActivity", "UnsafeObjectState"),
    ("EnvironmentCondition", "UnsafeObjectState"), ("EnvironmentCondition", "severe_consequence"),
)

# --- fixed values: the ontology ---
ENTITY_CLASSES = (
    "AccidentCase", "AccidentType", "ConstructionActivity", "EngineeringObject", "EnvironmentCondition", "EquipmentFacility", "UnsafeAction",
    "UnsafeObjectState", "SafetyCapabilityDefect", "SafetyManagementDefect", "SafetyCultureDefect", "AccidentProcess", "Consequence", "PreventiveMeasure",
)
RELATIONS = {
    "hasAccidentType": (("AccidentCase",), ("AccidentType",)),
    "occursInActivity": (("AccidentCase",), ("ConstructionActivity",)),
    "involvesObject": (("AccidentCase",), ("EngineeringObject",)),
    "involvesEquipment": (("AccidentCase",), ("EquipmentFacility",)),
    "hasEnvironmentCondition": (("AccidentCase",), ("EnvironmentCondition",)),
    "hasDirectCause": (("AccidentCase",), ("UnsafeAction", "UnsafeObjectState")),
    "hasCapabilityCause": (("UnsafeAction",), ("SafetyCapabilityDefect",)),
    "hasManagementCause": (("UnsafeAction", "UnsafeObjectState", "SafetyCapabilityDefect"), ("SafetyManagementDefect",)),
    "hasCultureCause": (("SafetyManagementDefect",), ("SafetyCultureDefect",)),
    "leadTo": (("UnsafeAction", "UnsafeObjectState", "AccidentProcess"), ("AccidentProcess", "Consequence")),
    "controlledBy": (("UnsafeAction", "UnsafeObjectState", "SafetyCapabilityDefect", "SafetyManagementDefect"), ("PreventiveMeasure",)),
    "hasConsequence": (("AccidentCase",), ("Consequence",)),
}
CONTEXT_RELATIONS = {
    "AccidentType": "hasAccidentType", "ConstructionActivity": "occursInActivity", "EngineeringObject": "involvesObject",
    "EnvironmentCondition": "hasEnvironmentCondition", "EquipmentFacility": "involvesEquipment", "Consequence": "hasConsequence",
}

# --- fixed values: what evidence of a cultural defect must or must not rest on; its labels by keyword ---
CULTURE_MARKERS = (
    "抢工程进度", "抢工期", "重生产", "轻安全", "对安全重视不够", "安全重视不够", "安全投入不足", "置若罔闻", "流于形式", "责任意识", "安全文化",
    "长期", "未达到培训的目的",
)
MANAGEMENT_MARKERS = ("培训不到位", "监督检查不力", "方案", "技术措施", "隐患排查", "安全管理不到位")
CULTURE_LABELS = (
    (("抢", "进度", "工期", "生产"), "重进度轻安全"),
    (("投入", "保障", "防护", "资源"), "安全投入不足"),
    (("责任", "重视", "置若罔闻", "执行"), "安全责任意识淡薄"),
)
YES_WORDS = ("yes", "y", "1", "true", "是", "有")

# --- fixed values: fields that privacy covers ---
SENSITIVE_FIELDS = (
    "title", "organization", "severity_level", "location", "direct_cause_text", "indirect_cause_text", "cause_text", "process_text",
    "consequence_text", "economic_loss_text", "measures_text", "raw_text", "evidence_text", "rationale", "description", "context",
    "source_sentence", "original_mention",
)
SENSITIVE_LISTS = ("evidence_texts", "aliases", "rationales")


@dataclass(frozen=True)
class Question:
    question_id: str
    stage: str
    target_type: str
    relation_type: str | None
    yes_label: str
    text: str
    definition: str


#: Ids, stages, types and labels are fixed values; the wording is our own.
QUESTIONS = (
    Question("D1_UNSAFE_ACTION", "direct_cause", "UnsafeAction", "hasDirectCause", "人的不安全动作", "是否有人的行为直接引发了本次事故？", "违章、冒险、误操作或未用防护用品等行为。"),
    Question("D2_UNSAFE_OBJECT_STATE", "direct_cause", "UnsafeObjectState", "hasDirectCause", "物的不安全状态", "是否有设备、结构或环境的危险状态直接引发了本次事故？", "设备、材料、结构或场地处于危险状态。"),
    Question("C1_SAFETY_KNOWLEDGE", "capability_cause", "SafetyCapabilityDefect", "hasCapabilityCause", "安全知识不足", "上述原因是否因为人员缺少安全知识？", "不熟悉规程、方案、设备或应急要求。"),
    Question("C2_SAFETY_AWARENESS", "capability_cause", "SafetyCapabilityDefect", "hasCapabilityCause", "安全意识薄弱", "上述原因是否因为人员安全意识薄弱？", "轻视危险或抱有侥幸心理。"),
    Question("C3_SAFETY_HABIT", "capability_cause", "SafetyCapabilityDefect", "hasCapabilityCause", "安全习惯不良", "上述原因是否因为人员安全习惯不良？", "习惯性地不按规程作业。"),
    Question("C4_PSYCHO_PHYSIO", "capability_cause", "SafetyCapabilityDefect", "hasCapabilityCause", "心理或生理状态不佳", "上述原因是否因为人员身心状态不佳？", "疲劳、急躁、身体不适等。"),
    Question("M1_TRAINING", "management_cause", "SafetyManagementDefect", "hasManagementCause", "安全培训不足", "上述原因是否因为安全培训不足？", "教育、交底缺失或走过场。"),
    Question("M2_PLAN", "management_cause", "SafetyManagementDefect", "hasManagementCause", "专项方案或技术措施缺陷", "上述原因是否因为方案或技术措施有缺陷？", "方案未编、未审、不具体或未执行。"),
    Question("M3_SUPERVISION", "management_cause", "SafetyManagementDefect", "hasManagementCause", "监督检查不到位", "上述原因是否因为监督检查不到位？", "巡查、旁站、制止违章有缺失。"),
    Question("M4_HAZARD", "management_cause", "SafetyManagementDefect", "hasManagementCause", "隐患排查治理不到位", "上述原因是否因为隐患治理不到位？", "危险源未识别或整改未闭环。"),
    Question("M5_RESPONSIBILITY", "management_cause", "SafetyManagementDefect", "hasManagementCause", "安全责任落实不到位", "上述原因是否因为责任未落实？", "职责不清或协调失效。"),
    Question("S1_SAFETY_PRIORITY", "culture_cause", "SafetyCultureDefect", "hasCultureCause", "重进度轻安全", "原文是否写明组织为进度或成本而放松安全？", "须有组织层面的明确证据。"),
    Question("S2_SAFETY_INVESTMENT", "culture_cause", "SafetyCultureDefect", "hasCultureCause", "安全投入不足", "原文是否写明组织的安全投入不足？", "须有组织层面的明确证据。"),
    Question("S3_ACCOUNTABILITY_CULTURE", "culture_cause", "SafetyCultureDefect", "hasCultureCause", "安全责任意识淡薄", "原文是否写明管理层对安全责任漠视？", "须有组织层面的明确证据。"),
    Question("P1_ACCIDENT_PROCESS", "accident_process", "AccidentProcess", "leadTo", "事故过程节点", "原文是否写明事故如何一步步发展？", "从危险状态到后果的事件链。"),
    Question("R1_CONTROL_MEASURE", "control_measure", "PreventiveMeasure", "controlledBy", "防控措施", "原文是否给出可以预防的措施？", "技术、管理、培训、监测或应急措施。"),
)


def questions_of(*stages: str) -> list[Question]:
    return [q for q in QUESTIONS if q.stage in stages]


def question_ids() -> list[str]:
    return [q.question_id for q in QUESTIONS]
