"""Schemas of the graph tables, and the lookup tables that fix labels and relations."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {
    "string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()), "map<string,string>": T.MapType(T.StringType(), T.StringType()),
}


def _struct(columns: str) -> T.StructType:
    """A schema from "name type, ..."; unlike Spark's own parser it needs no session."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (c.split(" ") for c in columns.split(", "))])


RAW_TRIPLE = _struct(
    "head string, head_type string, relation string, tail string, tail_type string, source string, confidence string, is_property boolean, evidence string"
)
FUSED_TRIPLE = _struct(
    "head string, relation string, tail string, frequency int, source_score double, confidence double, edge_score double, conflict boolean, sources array<string>"
)
NODES = _struct("label string, name string, aliases array<string>, props map<string,string>, created_at timestamp, updated_at timestamp")
EDGES = _struct(
    "src_label string, src string, rel_type string, dst_label string, dst string, source string, confidence double, frequency int, edge_score double, "
    "conflict boolean, predicted boolean, relation_type string, rule_id string, via string, change_id string, revision int, active boolean, "
    "valid_from timestamp, valid_to timestamp, created_at timestamp"
)
CHANGESETS = _struct("change_id string, actor string, reason string, source string, created_at timestamp, status string, rolled_back_at timestamp")
AUDIT_EVENTS = _struct(
    "change_id string, timestamp timestamp, action string, head string, relation string, tail string, revision int, rolled_back boolean"
)
EVAL_SET = _struct("question string, intent string, entity_mentions array<string>, gold_answers array<string>")

# What names of types, relations and predicates mean. The three vocabularies differ on purpose.
TYPE_NAMES = {"疾病": "Disease", "症状": "Symptom", "药物": "Drug", "药品": "Drug", "检查": "Exam", "指标": "Indicator", "科室": "Department", "食物": "Food"}
EAV_RELATIONS = {
    "症状": ("HAS_SYMPTOM", "Symptom"),
    "并发症": ("HAS_COMPLICATION", "Disease"),
    "推荐药品": ("RECOMMEND_DRUG", "Drug"),
    "常用药品": ("COMMON_DRUG", "Drug"),
    "宜吃食物": ("DO_EAT", "Food"),
    "忌吃食物": ("NOT_EAT", "Food"),
    "推荐食谱": ("RECOMMEND_EAT", "Food"),
    "一级科室分类": ("DEPT_L1", "Department"),
    "二级科室分类": ("DEPT_L2", "Department"),
    "三级科室分类": ("DEPT_L3", "Department"),
    "就诊科室": ("TREATED_IN", "Department"),
}
EAV_MULTI = ("常用药品", "就诊科室", "并发症")
EAV_REVERSED = {"可能疾病": ("HAS_SYMPTOM", "Symptom", "Disease")}
EAV_PROPERTIES = {
    "简介": "desc", "病因": "cause", "预防方式": "prevent", "治疗概述": "treatment_overview", "患病比例": "get_prob", "易感人群": "susceptible_pop",
    "传染方式": "transmission", "治疗方式": "cure_way", "治疗周期": "cure_time", "治愈率": "cure_rate", "治疗费用": "cost", "医保疾病": "is_insured",
}
WIDE_LISTS = {
    "symptom": ("HAS_SYMPTOM", "Symptom"),
    "check": ("NEEDS_EXAM", "Exam"),
    "recommand_drug": ("RECOMMEND_DRUG", "Drug"),
    "common_drug": ("COMMON_DRUG", "Drug"),
    "cure_department": ("TREATED_IN", "Department"),
    "cure_way": ("HAS_TREATMENT", "Treatment"),
    "do_eat": ("DO_EAT", "Food"),
    "not_eat": ("NOT_EAT", "Food"),
    "recommand_eat": ("RECOMMEND_EAT", "Food"),
    "acompany": ("HAS_COMPLICATION", "Disease"),
}
WIDE_PROPERTIES = ["desc", "prevent", "cause", "get_prob", "get_way", "cured_prob", "cure_lasttime", "cost_money", "yibao_status"]
LABELS = {"Disease", "Symptom", "Drug", "Exam", "Indicator", "Entity", "Food", "Department", "Treatment", "Text"}
#: Relation name in lower case to (head label, relation type, tail label).
RELATION_LABELS = {
    "has_symptom": ("Disease", "HAS_SYMPTOM", "Symptom"),
    "症状": ("Disease", "HAS_SYMPTOM", "Symptom"),
    "recommended_drug": ("Disease", "RECOMMENDED_DRUG", "Drug"),
    "推荐药物": ("Disease", "RECOMMENDED_DRUG", "Drug"),
    "recommend_drug": ("Disease", "RECOMMEND_DRUG", "Drug"),
    "common_drug": ("Disease", "COMMON_DRUG", "Drug"),
    "treats": ("Drug", "TREATS", "Disease"),
    "治疗": ("Drug", "TREATS", "Disease"),
    "needs_exam": ("Disease", "NEEDS_EXAM", "Exam"),
    "检查": ("Disease", "NEEDS_EXAM", "Exam"),
    "has_indicator": ("Exam", "HAS_INDICATOR", "Indicator"),
    "指标": ("Exam", "HAS_INDICATOR", "Indicator"),
    "contraindicated_for": ("Drug", "CONTRAINDICATED_FOR", "Disease"),
    "禁忌": ("Drug", "CONTRAINDICATED_FOR", "Disease"),
    "related_to": ("Entity", "RELATED_TO", "Entity"),
    "has_complication": ("Disease", "HAS_COMPLICATION", "Disease"),
    "do_eat": ("Disease", "DO_EAT", "Food"),
    "not_eat": ("Disease", "NOT_EAT", "Food"),
    "recommend_eat": ("Disease", "RECOMMEND_EAT", "Food"),
    "dept_l1": ("Disease", "DEPT_L1", "Department"),
    "dept_l2": ("Disease", "DEPT_L2", "Department"),
    "dept_l3": ("Disease", "DEPT_L3", "Department"),
    "treated_in": ("Disease", "TREATED_IN", "Department"),
    "has_treatment": ("Disease", "HAS_TREATMENT", "Treatment"),
}
PROPERTY_NAMES = [
    "desc", "cause", "prevent", "treatment_overview", "get_prob", "susceptible_pop", "transmission", "cure_way", "cure_time", "cure_rate", "cost",
    "is_insured", "get_way", "cured_prob", "cure_lasttime", "cost_money", "yibao_status",
]
#: Relations that may have many tails without a conflict.
MULTI_VALUED = [
    "HAS_SYMPTOM", "RECOMMENDED_DRUG", "RECOMMEND_DRUG", "COMMON_DRUG", "NEEDS_EXAM", "HAS_INDICATOR", "TREATS", "CONTRAINDICATED_FOR", "COMPLICATION",
    "HAS_COMPLICATION", "RELATED_DISEASE", "AFFECTS_BODY", "ADVERSE_REACTION", "DRUG_INTERACTION", "BELONGS_TO", "CAUSED_BY_MICROBE", "DO_EAT", "NOT_EAT",
    "RECOMMEND_EAT", "DEPT_L1", "DEPT_L2", "DEPT_L3", "TREATED_IN", "HAS_TREATMENT", "PROP_DESC", "PROP_CAUSE", "PROP_PREVENT",
]
SOURCE_WEIGHTS = {"default": 1.0, "CMeKG": 1.2, "CM3KG_DiseaseCSV": 1.0, "CM3KG_MedicalCSV": 1.0, "rule": 0.8}
