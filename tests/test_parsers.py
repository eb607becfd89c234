"""Extraction rules, column and row versions alike."""

from __future__ import annotations

import json

import pytest

from rillflow.functions.grok import compile_grok
from rillflow.functions.syntax import ExpressionError
from rillflow.operators.extraction import rule_of
from rillflow.operators.parser import parse

WINDOWS = "07/30/2031 06:15:00 PM\nLogName=Harbour\nEventCode=9150\nMessage=A berth was taken.\n\nVessel:\n\tName:\t\t\tGULL\\EIDER\n\tBerth No:\t\t0x2B\n\nCargo:\t\t\tSalt\n\t\t\tRope\nCustoms Level:\tNone\nDescription:\nIt came at dusk\nand left at dawn\nEvent Xml:\n<Event k=\"v\">\n  <pier>4</pier>\n</Event>\n"
CASES = [
    ({"type": "grok", "grokExpression": "%{IP:src}:%{NUMBER:port} %{GREEDYDATA:rest}"}, "1.2.3.4:80 and more", {"src": "1.2.3.4", "port": "80", "rest": "and more"}),
    ({"type": "delimited_text", "delimiter": ",", "columns": ["a", "b", "c"]}, '1,"x, ""y""",3', {"a": "1", "b": 'x, "y"', "c": "3"}),
    ({"type": "delimited_text", "delimiter": "|", "columns": ["a", "b", "c"]}, "1||", {"a": "1", "b": "", "c": ""}),
    ({"type": "panw_traffic"}, 'x,2025/01/24,007,TRAFFIC,"a,b",,,', {"receiveTime": "2025/01/24", "serialNumber": "007", "type": "TRAFFIC", "subtype": "a,b"}),
    ({"type": "syslog", "componentList": ["PRIORITY", "TIMESTAMP", "DEVICE", "APP"], "timestampPattern": "MMM dd HH:mm:ss", "messageBodyDelimiter": ":"}, "<77>Aug 09 23:04:50 pier4 crane[7]: load is up", {"priority": 77, "timestamp": "Aug 09 23:04:50", "deviceId": "pier4", "appName": "crane[7]", "content": "load is up"}),
    ({"type": "syslog", "componentList": ["PRIORITY", "VERSION", "TIMESTAMP", "DEVICE", "APP", "PROC_ID", "MSG_ID"], "timestampPattern": "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"}, "<120>1 2031-07-30T18:15:42.250Z quay buoy 12 tide low water", {"priority": 120, "version": "1", "timestamp": "2031-07-30T18:15:42.250Z", "deviceId": "quay", "appName": "buoy", "procId": "12", "msgId": "tide", "content": "low water"}),
]


@pytest.mark.parametrize("config,line,want", CASES)
def test_columns_and_rows_agree(spark, config, line, want):
    assert {k: v for k, v in rule_of(config).read(line).items() if v is not None} == want
    r = parse(spark.createDataFrame([(line, 1), (None, 2), ("", 3)], "line string, id long"), {"targetField": "line", "removeTargetField": True, "extractionConfig": config})
    got = {x["id"]: x.asDict() for x in r.output.collect()}
    assert {k: v for k, v in got[1].items() if v is not None} == want | {"id": 1}
    assert set(got) == {1, 2, 3}


DYNAMIC = [
    ({"type": "kv_pair", "pairSeparator": " ", "kvSeparator": "="}, 'a=1 b="x =\\" y" msg=two words a=3 e=', {"a": ["1", "3"], "b": 'x =" y', "msg": "two words", "e": ""}),
    ({"type": "kv_pair", "pairSeparator": "\\t", "kvSeparator": ":"}, "k:v\tq:r s", {"k": "v", "q": "r s"}),
    ({"type": "cef"}, "CEF:0|V\\|x|P|1.0|id|Name here|5|src=1.2.3.4 msg=has spaces and more cs1Label=policy cs1=allow all empty= last=x", {"version": 0, "deviceVendor": "V|x", "deviceProduct": "P", "deviceVersion": "1.0", "deviceEventClassId": "id", "name": "Name here", "severity": 5, "src": "1.2.3.4", "msg": "has spaces and more", "cs1Label": "policy", "cs1": "allow all", "policy": "allow all", "empty": "", "last": "x"}),
    ({"type": "syslog", "componentList": ["PRIORITY", "STRUCTURED_DATA"]}, '<1>[a@1 k="v\\"w"][b@2 x="1"] body', {"priority": 1, "structuredData": {"a@1": {"k": 'v"w'}, "b@2": {"x": "1"}}, "content": "body"}),
    ({"type": "json", "outputFieldName": "j"}, '{"a": [1, null]}', {"j": {"a": [1, None]}}),
    (
        {"type": "windows_multiline", "timestampLocationType": "FIRST_LINE"},
        WINDOWS,
        {"LogName": "Harbour", "EventCode": "9150", "Message": "A berth was taken.", "Vessel": {"Name": "GULL\\EIDER", "Berth No": "0x2B"}, "Cargo": "Salt\nRope", "Customs Level": "None", "Description": "It came at dusk\nand left at dawn", "Event Xml": '<Event k="v">\n  <pier>4</pier>\n</Event>', "__raw__": WINDOWS, "__ts__": "07/30/2031 06:15:00 PM"},
    ),
]


@pytest.mark.parametrize("config,line,want", DYNAMIC)
def test_rules_with_free_names(spark, config, line, want):
    assert rule_of(config).read(line) == want
    r = parse(spark.createDataFrame([(line,)], "line string").selectExpr("line", "parse_json('1') as v" if config["type"] == "json" else "1 as one"), {"targetField": "line", "removeTargetField": True, "extractionConfig": config})
    assert r.output.count() == 1


def test_dispatch_and_failures(spark):
    grok = lambda field, g, **more: {"targetField": field, "removeTargetField": True, "extractionConfig": {"type": "grok", "grokExpression": g}} | more
    config = grok("line", "%{WORD:kind} %{GREEDYDATA:rest}", dispatchConfig={"dispatchField": "kind", "dispatchMap": {"a": grok("rest", "x=%{INT:x}"), "b": grok("rest", "y=%{WORD:y} %{GREEDYDATA:more}", dispatchConfig={"dispatchField": "y", "dispatchMap": {"deep": grok("more", "z=%{INT:z}")}})}})
    df = spark.createDataFrame([("a x=5",), ("b y=deep z=7",), ("b y=flat w",), ("c free",), ("a bad",), ("?",)], "line string")
    r = parse(df, config)
    got = sorted(({k: v for k, v in x.asDict().items() if v is not None} for x in r.output.collect()), key=repr)
    assert got == sorted([{"kind": "a", "x": "5"}, {"kind": "b", "y": "deep", "z": "7"}, {"kind": "b", "y": "flat", "more": "w"}, {"kind": "c", "rest": "free"}], key=repr)
    assert sorted(json.loads(e["event"])["line"] for e in r.errors.collect()) == ["?", "a bad"]


def test_dynamic_failures_and_fields(spark):
    config = {"targetField": "line", "extractionConfig": {"type": "cef"}, "fields": ["name", "src"]}
    r = parse(spark.createDataFrame([("CEF:0|a|b|c|d|n|1|src=9",), ("junk",)], "line string"), config)
    assert [tuple(x) for x in r.output.collect()] == [("n", "9")] and r.errors.count() == 1


def test_too_many_values_is_an_error(spark):
    r = parse(spark.createDataFrame([("1,2,3",)], "line string"), {"targetField": "line", "extractionConfig": {"type": "delimited_text", "delimiter": ",", "columns": ["a", "b"]}})
    assert r.output.count() == 0 and r.errors.count() == 1


def test_grok_library():
    g = compile_grok("%{SYSLOGBASE} %{LOGLEVEL:level}")
    assert [n for n, _ in g.fields] == ["timestamp", "facility", "priority", "logsource", "program", "pid", "level"]
    for bad in ("%{NOPE:x}",):
        with pytest.raises(ExpressionError):
            compile_grok(bad)
    with pytest.raises(ExpressionError):
        rule_of({"type": "nope"})
