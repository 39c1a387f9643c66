from datetime import date

import pytest
from pyspark.sql import functions as F

from sievelight.operators import answers, assistant, metadata
from sievelight.service import ResponseCache, Sessions, Settings, resolve_collection


def test_json_is_salvaged():
    assert answers.salvaged('{"a": 1}') == {"a": 1}
    assert answers.salvaged('text ```json\n{"a": 2}\n``` more') == {"a": 2}
    assert answers.salvaged('so: {"a": {"b": 3}} end') == {"a": {"b": 3}}
    assert answers.salvaged('{"final_answer": "half a\\nline') == {"final_answer": "half a\nline"}
    assert answers.salvaged("just words") == {"final_answer": "just words"} and answers.salvaged(None) == {}


def test_reader_tasks():
    assert answers.reader_tasks("deadline_query", ["material"]) == ["deadline", "material"]
    assert answers.reader_tasks("answer_question", []) == ["general"]


def test_references():
    out = answers.canonical_references("see\n参考信息源\n[1] A https://wrong/1\n[2] B https://wrong/2\n[9] https://x", ["https://a", "https://b"])
    assert "[1] A https://a" in out and "[2] B https://b" in out and "[9] https://x" in out


def test_cache_sessions_settings():
    cache = ResponseCache(2)
    for k in "abc":
        cache.put(k, k)
    assert cache.get("a") is None and cache.get("c") == "c"
    sessions = Sessions(3, 2)
    sessions.remember("s", "转专业")
    assert sessions.contextual("s", "那什么时候") == "转专业 那什么时候" and sessions.contextual("s", "奖学金") == "奖学金"
    for i in range(4):
        sessions.remember(str(i), "x")
    assert len(sessions.last) <= 3
    assert Settings.from_environment({"SIEVELIGHT_LIMIT": "5", "SIEVELIGHT_RERANK": "off"}) == Settings(limit=5, rerank=False)
    with pytest.raises(LookupError):
        resolve_collection([{"id": 1, "is_enabled": False}], None)
    assert resolve_collection([{"id": 1, "is_enabled": True, "slug": "a"}, {"id": 2, "is_enabled": True, "slug": "default"}], None)["id"] == 2


def test_blocks_and_metadata(spark):
    df = spark.createDataFrame([(["a" * 100, "b" * 300, "c"], '{"topics": ["x y", "x  y", ""], "confidence": 7, "time_points": [{"type": "ODD", "date": "d"}]}'), ([], "broken")], "b array<string>, j string")
    rows = df.select(answers.packed_blocks(F.col("b"), 250).alias("p"), metadata.normalised(F.col("j")).alias("m")).collect()
    assert len(rows[0]["p"]) == 250 and "c" not in rows[0]["p"] and rows[1]["p"] == ""
    assert rows[0]["m"]["topics"] == ["x y"] and rows[0]["m"]["confidence"] == 1.0 and rows[0]["m"]["time_points"][0]["type"] == "other"
    assert rows[1]["m"]["topics"] == [] and rows[1]["m"]["confidence"] == 0.0


def test_assistant(spark):
    service = assistant.Service("travel", {"amount": r"(\d+)元"}, ["amount", "city"], ["报销"], ["policy"], [("amount", r"^\d{5,}$", "large sum")])
    slots, missing = assistant.filled(service, "出差报销12000元")
    assert slots == {"amount": "12000"} and missing == ["city"] and assistant.warnings(service, slots) == ["large sum"]
    facts = spark.createDataFrame([(1, "travel", "process", "travel 报销 流程", "q1", "u1"), (2, "travel", "policy", "rules", "q2", "u2"), (3, "other", "policy", "报销", "q3", "u3"), (4, "travel", "process", "travel 报销 流程", "q1", "u1")], "id long, service_type string, slot string, fact_text string, quote string, url string")
    found = assistant.search_facts(facts, service, "报销")
    assert [r["id"] for r in found.collect()] == [1, 4, 2] and assistant.sources(found).count() == 2
    assert {r["slot"]: len(r["facts"]) for r in assistant.by_slot(found).collect()} == {"process": 2, "policy": 1}
    assert assistant.stats(facts).first()["services"] == 2 and date is not None
