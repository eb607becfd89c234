"""Graphs, the builder, the server, the command line, streams."""

from __future__ import annotations

import base64
import json
import urllib.error
import urllib.request

import pytest

from rillflow import Dag, Flow, execute, plan, register
from rillflow.operators.core import noop
from rillflow.plans.dag import TRANSFORMS, DagError
from rillflow.plans.server import WorkflowServer
from rillflow.streaming.metrics import log_metrics
from rillflow.streaming.runner import poll_jdbc, run_stream
from tests.conftest import rows


def node(id, command, outputs=(), **config):
    return {"id": id, "commandName": command, "config": config, "outputs": list(outputs)}


@pytest.mark.parametrize(
    "nodes,message",
    [
        ([], "no nodes"),
        ([node("a", "stdin", ["b"])], "unknown nodes"),
        ([node("a", "stdin", ["b"]), node("b", "nope")], "unknown command"),
        ([node("a", "stdin", ["b"]), node("b", "stdin")], "has inputs"),
        ([node("a", "stdin", ["b"]), node("b", "stdout", ["c"]), node("c", "noop")], "has outputs"),
        ([node("a", "stdin", ["b"]), node("b", "noop", ["c"]), node("c", "noop", ["b"])], "cycle"),
        ([node("a", "stdin", ["b"]), node("b", "stdout"), node("c", "stdin", ["d"]), node("d", "stdout")], "not connected"),
        ([node("b", "noop", ["c"]), node("c", "stdout")], "no input"),
    ],
)
def test_bad_graphs(nodes, message):
    with pytest.raises(DagError, match=message):
        Dag.from_dict({"dag": nodes}).validate()


def test_ids_and_names_are_unique():
    with pytest.raises(DagError, match="twice"):
        Dag.from_dict({"dag": [node("a", "stdin"), node("a", "stdin")]})
    with pytest.raises(DagError, match="exists"):
        register("eval", lambda df, c: noop(df))
    register("my_command", lambda df, c: noop(df.limit(c["n"])))
    try:
        assert "my_command" in TRANSFORMS
    finally:
        del TRANSFORMS["my_command"]


def even_odd(tmp_path, spark) -> str:
    (tmp_path / "in").mkdir(exist_ok=True)
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"num": i}) for i in range(6)))
    return f"""
jobContext:
  dlqConfig: {{path: "{tmp_path}/dlq"}}
dag:
  - id: a
    commandName: filesource
    config: {{filePath: "{tmp_path}/in", encodingType: JSON_OBJECT_LINE}}
    outputs: [even, odd, bad]
  - {{id: even, commandName: filter, config: {{expression: "$.num % 2 == 0"}}, outputs: [b]}}
  - {{id: odd, commandName: filter, config: {{expression: "$.num % 2 == 1"}}, outputs: [c]}}
  - {{id: b, commandName: eval, config: {{expression: "dict(type='even', num=$.num)"}}, outputs: [d]}}
  - {{id: c, commandName: eval, config: {{expression: "dict(type='odd', num=$.num)"}}, outputs: [d]}}
  - {{id: bad, commandName: eval, config: {{expression: "dict(type='x', num=floor(6 / ($.num - 3)))"}}, outputs: [d]}}
  - id: d
    commandName: s3sink
    config: {{path: "{tmp_path}/out", encodingType: JSON_OBJECT_LINE}}
"""


def test_run_with_dead_letters(spark, tmp_path):
    run = execute(spark, Dag.from_yaml(even_odd(tmp_path, spark)))
    assert (run.deliveries["d"].inputCount, run.deliveries["d"].successCount) == (11, 11)
    out = spark.read.json(str(tmp_path / "out"))
    assert rows(out.groupBy("type").count()) == [("even", 3), ("odd", 3), ("x", 5)]
    letters = spark.read.parquet(str(tmp_path / "dlq/dead-letters"))
    assert {"dt", "hr", "nodeId", "value", "processingTimestamp"} <= set(letters.columns)
    assert [(r["errorMessage"], r["nodeId"]) for r in letters.collect()] == [("division by zero", "bad")]
    assert run.counters()["bad"] == {"outputEventCount": 5, "errorEventCount": 1}


def test_definitions_round_trip(tmp_path, spark, monkeypatch):
    text = even_odd(tmp_path, spark)
    dag = Dag.from_yaml(text)
    assert Dag.from_json(json.dumps(dag.to_dict())).to_dict() == dag.to_dict()
    monkeypatch.setenv("PLACE", "here")
    assert Dag.from_yaml("jobContext: {a: '${PLACE}', b: '${NOT_SET_AT_ALL}'}").context == {"a": "here", "b": "${NOT_SET_AT_ALL}"}


def test_flows_are_immutable_and_share_prefixes(spark):
    base = Flow.start().filter("$.id > 1")
    a, b = base.eval("dict(x=$.id)"), base.eval("dict(x=$.id * 10)")
    assert rows(a.result(spark.range(4))) == [(2,), (3,)]
    merged = Flow.merge(a, b)
    assert rows(merged.result(spark.range(4))) == [(2,), (20,), (3,), (30,)]
    assert sum(n.command == "filter" for n in merged.dag().nodes.values()) == 1
    assert rows(merged.sql("select count(*) c from events").result(spark.range(4))) == [(4,)]


def test_sql_after_paths_of_different_shape_runs_per_path(spark):
    a, b = Flow.start().eval("dict(x=$.id)"), Flow.start().filter("$.id > 0").eval("dict(x=$.id, y=1)")
    got = plan(spark, Dag.from_dict({"dag": [node("s", "stdin", ["a", "b"], encodingType="TEXT"), node("a", "noop", ["q"]), node("b", "filter", ["q"], expression="$.id > 0"), node("q", "sqleval", sql="select count(*) c from records")]}), inputs={"s": spark.range(3)})
    assert rows(got.outputs["q"]) == [(2,), (3,)]
    assert a.node.id != b.node.id


def test_server(spark):
    server = WorkflowServer(spark)
    url = server.start()
    call = lambda path, body=None, method=None: json.loads(urllib.request.urlopen(urllib.request.Request(url + path, data=None if body is None else json.dumps(body).encode(), method=method)).read())
    try:
        i = Flow.start().filter("$.n > 1").eval("dict(m=10 / ($.n - 3))").submit_api_endpoint(url)
        assert i in call("/api/v1/workflows") and call(f"/api/v1/workflows/{i}")["dag"]
        got = call(f"/api/v1/execution/run/{i}/batch?includeOutputByStep=true&includeErrorByStep=true", [{"n": 1}, {"n": 2}, {"n": 3}])
        assert list(got["outputEvents"].values()) == [[{"m": -10.0}]]
        assert len(got["outputByStep"]) == 2 and next(iter(got["errorByStep"].values()))[0]["errorMessage"] == "division by zero"
        assert call(f"/api/v1/workflows/{i}", method="DELETE")["deleted"]
        with pytest.raises(urllib.error.HTTPError):
            call(f"/api/v1/execution/run/{i}/batch", [])
        with pytest.raises(urllib.error.HTTPError):
            call("/api/v1/workflows", {"dag": [node("a", "nope")]})
    finally:
        server.shutdown()


def test_command_line(spark, tmp_path, capsys):
    from rillflow.__main__ import main

    text = even_odd(tmp_path, spark)
    (tmp_path / "d.yml").write_text(text)
    assert main(["-id", "j", "-f", str(tmp_path / "d.yml")]) == 0
    assert main(["-id", "j", "-d", base64.b64encode(text.encode()).decode()]) == 0
    assert "11 delivered" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["-id", "j"])


def stream_dag(tmp_path) -> Dag:
    return Dag.from_dict({"dag": [node("s", "filesource", ["e"], filePath=str(tmp_path / "in"), encodingType="JSON_OBJECT_LINE", schema="num long"), node("e", "eval", ["q"], expression="dict(x=10 / $.num)"), node("q", "sqleval", ["o"], sql="select count(*) c from events"), node("o", "s3sink", path=str(tmp_path / "out"), encodingType="JSON_OBJECT_LINE")]})


def test_stream_aggregates_per_batch_and_resumes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    seen, errors = [], []

    def on_batch(run, n):
        seen.append([r["c"] for r in run.outputs["q"].collect()])
        errors.append(run.all_errors().count())

    metrics = log_metrics(spark, emit=lambda m: None)
    for i, numbers in enumerate(([0, 1, 2], [4, 5])):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps({"num": k}) for k in numbers))
        for q in run_stream(spark, stream_dag(tmp_path), str(tmp_path / "cp"), available_now=True, on_batch=on_batch):
            q.awaitTermination()
    spark.streams.removeListener(metrics)
    assert seen == [[2], [2]] and errors == [1, 0]
    assert rows(spark.read.json(str(tmp_path / "out"))) == [(2,), (2,)]


def test_jdbc_polling_moves_the_watermark(spark, monkeypatch):
    from rillflow.sources import inputs

    stored, asked = {"w": None}, []

    def fake(spark, config, streaming=False):
        asked.append(config["query"].replace(":watermark", inputs.sql_literal(config["watermark"])))
        return spark.range(5).where(f"id > {config['watermark'] if config['watermark'] is not None else -1}")

    monkeypatch.setitem(inputs.SOURCES, "jdbcsource", fake)
    config = {"query": "select * from t where id > :watermark", "watermarkColumn": "id"}
    counts = [poll_jdbc(spark, config, lambda: stored["w"], lambda v: stored.update(w=v), lambda df: df.count()) for _ in range(2)]
    assert counts == [5, 0] and stored["w"] == 4 and asked[1].endswith("id > 4")
