"""Response contracts."""

import json

import pytest
from pyspark.sql import functions as F

from faultline.functions import contract as C

GOOD = {"Suggested_Code": "x", "Reasoning": "r", "Confidence_Score": "High", "Review_Flag": False}


def reasons(spark, contract, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw_response string")
    return [r.reason for r in C.check_response(df, contract).orderBy("i").collect()]


def changed(**kw):
    return json.dumps({k: v for k, v in {**GOOD, **kw}.items() if v != "DROP"})


def test_classification(spark):
    cases = [
        (json.dumps(GOOD), None),
        ("```json\n" + json.dumps(GOOD) + "\n```", None),
        ("nope", "<root>: not valid JSON"),
        (None, "<root>: empty response"),
        ("null", "<root>: expected object"),
        (changed(Review_Flag="DROP"), "<root>: missing Review_Flag"),
        (changed(Note=1, Aside=2), "<root>: unexpected Aside, Note"),
        (changed(Review_Flag="true"), "Review_Flag: expected boolean"),
        (changed(Suggested_Code=5), "Suggested_Code: expected string"),
        (changed(Suggested_Code=None), "Suggested_Code: expected string"),
        (changed(Confidence_Score="Certain"), "Confidence_Score: not an allowed value"),
        ('{"Reasoning":"a","Reasoning":"b"}', "<root>: not valid JSON"),
    ]
    assert reasons(spark, C.CLASSIFICATION, [c for c, _ in cases]) == [r for _, r in cases]


def extraction(**kw):
    mode = {"Failure_Mode": "f", "Mechanism": "m", "Cause": "c", "Symptom_Effect": "s", "Frequency_in_Logs": 2}
    base = {"System_Code": "c", "System_Name": "n", "Topology": None, "Total_Logs_Analyzed": 1,
            "Unclassified_Logs_Count": 0, "Empirical_Actions_Taken": ["a"], "Failure_Modes": [mode],
            "Reasoning": "r", "Confidence_Score": "Low", "Review_Flag": True}
    return json.dumps({**base, **kw}), mode


def test_extraction(spark):
    _, mode = extraction()
    cases = [
        (extraction()[0], None),
        (extraction(Topology="t")[0], None),
        (extraction(Total_Logs_Analyzed=1.0)[0], None),
        (extraction(Total_Logs_Analyzed=1.5)[0], "Total_Logs_Analyzed: expected integer"),
        (extraction(Empirical_Actions_Taken=["a", 1])[0], "Empirical_Actions_Taken: expected array of strings"),
        (extraction(Failure_Modes="x")[0], "Failure_Modes: expected array of objects"),
        (extraction(Failure_Modes=[mode, {**mode, "More": 1}])[0], "Failure_Modes.1: not a valid item"),
        (extraction(Failure_Modes=[{**mode, "Frequency_in_Logs": "2"}])[0], "Failure_Modes.0: not a valid item"),
        (extraction(Failure_Modes=[])[0], None),
        (extraction(Empirical_Actions_Taken=[])[0], None),
    ]
    assert reasons(spark, C.EXTRACTION, [c for c, _ in cases]) == [r for _, r in cases]


def test_registry_names(spark):
    assert len(C.CONTRACTS) == 7
    assert reasons(spark, C.ACTION_CLUSTERING, ['{"Standardized_New_Actions":["a"],"Reasoning":"r","Confidence_Score":"Low","Review_Flag":true}']) == [None]


@pytest.mark.parametrize("selection, ok", [
    (("Wear", "m", "c", "s"), True),
    (("Wear", "m", "c", "other"), False),
    (("Escape", "any", "thing", ""), True),
    (("Both", "m", "c", "s"), False),  # listed and an escape at once
    (("Unlisted", "m", "c", "s"), False),
])
def test_exactly_one_mode(spark, selection, ok):
    names = ("failure_mode", "mechanism", "cause", "symptom")

    def struct(v):
        return F.struct(*[F.lit(x).alias(n) for n, x in zip(names, v)])

    modes = F.array(struct(("Wear", "m", "c", "s")), struct(("Both", "m", "c", "s")))
    escapes = F.array(F.lit("Escape"), F.lit("Both"))
    assert spark.range(1).select(C.check_mode(modes, escapes, struct(selection))).first()[0] is ok


def test_failure_selection_prefers_the_nested_object(spark):
    texts = ['{"Failure_Mode":"flat","Failure_Mode_Selection":{"Failure_Mode":"in"}}', '{"Failure_Mode":"flat"}',
             '{"Failure_Mode":"flat","Failure_Mode_Selection":{}}']
    df = C.parse_response(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw_response string"))
    assert [r[0] for r in df.orderBy("i").select(C.failure_selection("Failure_Mode")).collect()] == ["in", "flat", None]
