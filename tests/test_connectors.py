"""Sources, sinks, encodings and schemas, with local files and local servers in place of services."""

from __future__ import annotations

import gzip
import json
import socket
import sqlite3
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.functions.syntax import ExpressionError
from rillflow.operators.files import read_listed_files
from rillflow.sources import clients, inputs, outputs
from rillflow.sources.avro_schema import fitted, spark_type
from rillflow.sources.encodings import decode, encode, read_files, write_files
from rillflow.sources.inputs import SOURCES, read
from rillflow.sources.outputs import PREPARE, SINKS, write
from tests.conftest import rows


class Service:
    """A local HTTP server that keeps requests and answers from a list."""

    def __init__(self, answers=(), fail_first: int = 0):
        service, self.requests, self.fail = self, [], fail_first
        self.answers = list(answers)

        class Handler(BaseHTTPRequestHandler):
            def answer(self):
                body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()
                if service.fail > 0:
                    service.fail -= 1
                    self.send_error(503)
                    return
                service.requests.append((self.command, self.path, body, dict(self.headers)))
                data = json.dumps(service.answers.pop(0) if service.answers else {}).encode()
                self.send_response(200)
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            do_GET = do_POST = answer

            def log_message(self, *_):
                pass

        self.server = HTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_address[1]}"


EXPECTED_SOURCES = "filesource fssource stdin reader jdbcsource kafkasource kinesissource splunksource syslogudp activemqsource mqttsource sqssource s3rtsource imapsource ldapsource azuremonitorsource elasticsearchsource pubsubsource azureeventhubsource azureiothubsource"
EXPECTED_SINKS = "stdout s3sink gcssink azureblobsink deltalakesink databrickssink zerobussink clickhousesink jdbcsink timescaledbsink influxdbsink kafkasink kinesissink sqssink pubsubsink azureeventhubsink elasticsearchsink splunkhecsink azuremonitorsink smtpsink"


def test_every_command_is_there():
    assert set(EXPECTED_SOURCES.split()) <= set(SOURCES) and set(EXPECTED_SINKS.split()) <= set(SINKS)


def test_file_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ID, Name ,D\n1, x ,\n2,y,z\n")
    assert rows(read_files(spark, str(tmp_path / "a.csv"), "CSV")) == [("1", "x", None), ("2", "y", "z")]
    (tmp_path / "a.json").write_text('[{"v": 1}, {"v": 2}]')
    assert rows(read_files(spark, str(tmp_path / "a.json"), "JSON_ARRAY")) == [(1,), (2,)]
    with gzip.open(tmp_path / "b.json.gz", "wt") as f:
        f.write('{"v": 1}\n{"v": 2}\n')
    assert rows(read(spark, "filesource", {"filePath": str(tmp_path / "b.json.gz"), "encodingType": "JSON_OBJECT_LINE"})) == [(1,), (2,)]
    (tmp_path / "bad.json").write_text('{"v": 1}\n{oops\n')
    with pytest.raises(Exception):
        read_files(spark, str(tmp_path / "bad.json"), "JSON_OBJECT_LINE").collect()
    kept = read_files(spark, str(tmp_path / "bad.json"), "JSON_OBJECT_LINE", schema="v long, _corrupt_record string").cache()
    assert kept.where("_corrupt_record is not null").count() == 1
    (tmp_path / "t.txt").write_text("one\ntwo\n")
    assert rows(read_files(spark, str(tmp_path / "t.txt"), "STRING_LINE")) == [("one",), ("two",)]
    assert rows(read_files(spark, str(tmp_path / "t.txt"), "TEXT")) == [("one\ntwo\n",)]
    (tmp_path / "p.xml").write_text('<ps><p id="1"><n>a</n></p><p id="2"><n>b</n></p></ps>')
    assert rows(read_files(spark, str(tmp_path / "p.xml"), "XML", options={"rowTag": "p"}).select("id", "n")) == [("1", "a"), ("2", "b")]
    with pytest.raises(ExpressionError):
        read_files(spark, "x", "NOPE")


@pytest.mark.parametrize("encoding", ["JSON_OBJECT_LINE", "CSV", "PARQUET"])
def test_written_files_read_back(spark, tmp_path, encoding):
    df = spark.createDataFrame([("1", "a"), ("2", None)], "i string, s string")
    write_files(df, str(tmp_path / "o"), encoding)
    assert rows(read_files(spark, str(tmp_path / "o"), encoding, schema="i string, s string")) == [("1", "a"), ("2", None)]


def test_messages(spark):
    df = spark.createDataFrame([('{"a": 1}\n{"a": 2}\n{bad',)], "value string")
    good, bad = decode(df, "value", "JSON_OBJECT_LINE", schema="a long")
    assert rows(good) == [(1,), (2,)] and bad.count() == 1
    assert decode(df, "value", "JSON_OBJECT_LINE")[0].columns == ["event"]
    assert rows(decode(spark.createDataFrame([("a,b\n1,2\n",)], "value string"), "value", "CSV", schema="a string, b string")[0]) == [("1", "2")]
    assert encode(spark.createDataFrame([(1, "x,y")], "a int, b string"), "CSV").first()[0] == '1,"x,y"'


def test_file_system_source(spark, tmp_path):
    for i in range(8):
        (tmp_path / f"log-{i}.txt").write_text(f"line {i}")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "log-9.txt").write_text("line 9")
    (tmp_path / "other.bin").write_text("no")
    config = {"root": str(tmp_path), "fileNameRegex": r"log-(?P<ts>\d+)\.txt", "encodingType": "STRING_LINE"}
    assert read(spark, "fssource", config).count() == 9
    shares = [set(rows(read(spark, "fssource", config | {"replicas": 3, "replica": k}))) for k in range(3)]
    assert sum(map(len, shares)) == 9 and len(set.union(*shares)) == 9
    meta = read(spark, "s3rtsource", {"path": str(tmp_path), "encodingType": "TEXT", "maxObjectSizeBytes": 5, "includeObjectMetadata": True})
    assert meta.columns == ["__raw__", "__s3_bucket", "__s3_key"] and meta.count() == 1
    config = {"path": str(tmp_path), "encodingType": "TEXT", "maxObjectSizeBytes": 5}
    errors = rows(inputs.open_source(spark, "s3rtsource", config).errors)
    assert len(errors) == 9 and all(path.endswith(".txt") and "5 bytes" in why for path, why in errors)
    found, got = inputs.open_source(spark, "s3rtsource", config, streaming=True), []
    stream = found.raw.writeStream.foreachBatch(lambda batch, n: got.extend([*rows(found.decoded(batch).output), *rows(found.decoded(batch).errors)])).option("checkpointLocation", str(tmp_path) + "-checkpoint")
    stream.trigger(availableNow=True).start().awaitTermination()
    assert len(got) == 10 and ("no",) in got and sorted(e for e in got if len(e) == 2) == sorted(errors)
    with pytest.raises(ExpressionError):
        read(spark, "fssource", {"encodingType": "TEXT"})
    with pytest.raises(ExpressionError):
        read(spark, "nope")


def test_files_named_by_events(spark, tmp_path):
    (tmp_path / "a b.txt").write_text("x\r\ny\n")
    with gzip.open(tmp_path / "z", "wt") as f:
        f.write('{"k": 1}\n{"k": 2}')
    df = spark.createDataFrame([(str(tmp_path / "a+b.txt"),), (str(tmp_path / "missing"),), (None,)], "path string")
    r = read_listed_files(df, {"pathField": "path"})
    assert [x[0] for x in sorted(r.output.collect())] == ["x", "y"] and r.errors.count() == 2
    z = spark.createDataFrame([(str(tmp_path / "z"),)], "path string")
    assert rows(read_listed_files(z, {"pathField": "path", "emission": "DESERIALIZE", "schema": "k long"}).output) == [(1,), (2,)]


def test_stdin(spark, monkeypatch):
    import io

    monkeypatch.setattr("sys.stdin", io.StringIO('{"a": 1}\n{"a": 2}\n\n{"a": 3}\n'))
    assert rows(read(spark, "stdin", {"encodingType": "JSON_OBJECT_LINE", "schema": "a long"})) == [(1,), (2,)]


def test_http_sources(spark):
    es = Service([{"_scroll_id": "s", "hits": {"hits": [{"_id": "1", "_index": "i", "_source": {"a": 1}}]}}, {"_scroll_id": "s", "hits": {"hits": []}}])
    got = read(spark, "elasticsearchsource", {"host": es.url, "index": "i", "schema": "a long, `__md_id` string"})
    assert rows(got) == [(1, "1")]
    sp = Service([{"sid": "7"}, {"entry": [{"content": {"isDone": True}}]}, {"results": [{"x": "1"}, {"x": "2"}]}, {"results": []}])
    assert rows(read(spark, "splunksource", {"splunkUrl": sp.url, "searchQuery": "search *", "schema": "x string"})) == [("1",), ("2",)]
    az = Service([{"access_token": "t"}, {"tables": [{"columns": [{"name": "A"}, {"name": "B"}], "rows": [[1, None]]}]}])
    assert rows(read(spark, "azuremonitorsource", {"tenantId": "t", "workspaceId": "w", "kqlQuery": "q", "loginUrl": az.url, "apiUrl": az.url, "schema": "A string, B string"})) == [("1", None)]


def test_udp_source():
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind(("127.0.0.1", 0))
        port = s.getsockname()[1]
    pages = clients.syslog_udp({"host": "127.0.0.1", "port": port, "pollSeconds": 0.3})
    assert next(pages) == []
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.sendto(b"<1>hello", ("127.0.0.1", port))
    assert [json.loads(x) for x in next(pages)] == [{"__raw__": "<1>hello"}]
    pages.close()


def test_client_streams_replay_until_commit(monkeypatch):
    monkeypatch.setitem(clients.CLIENTS, "fake", lambda config: iter([["a"], ["b", "c"]]))
    s = clients.ClientStream("fake", {})
    first, end = s.read(s.initialOffset())
    assert list(first) == [("a",)] and list(s.readBetweenOffsets({"page": 0}, end)) == [("a",)]
    more, end2 = s.read(end)
    assert list(more) == [("b",), ("c",)]
    s.commit(end2)
    assert list(s.readBetweenOffsets({"page": 0}, end2)) == []


def test_mail_record_and_missing_libraries():
    from email.message import EmailMessage

    m = EmailMessage()
    m["From"], m["To"], m["Subject"], m["Message-ID"] = "a@x.org", "b@x.org, c@x.org", "s", "<1>"
    m.set_content("body")
    m.add_attachment(b"data", maintype="application", subtype="octet-stream", filename="f.bin")
    r = clients.message_record(m, True)
    assert r["to"] == ["b@x.org", "c@x.org"] and r["bodyText"].strip() == "body" and r["attachments"][0]["filename"] == "f.bin"
    with pytest.raises(RuntimeError, match="boto3"):
        next(clients.sqs({"queueUrl": "q"}))


def test_iot_envelope(spark):
    raw = spark.sql("""SELECT cast('{"t": 5}' AS binary) AS value, timestamp '2024-01-01' AS timestamp, array(named_struct('key', 'iothub-connection-device-id', 'value', cast('d1' AS binary))) AS headers""")
    bad = spark.sql("SELECT cast('{' AS binary) AS value, timestamp '2024-01-01' AS timestamp, cast(null AS array<struct<key:string,value:binary>>) AS headers")
    got = inputs.with_iothub(raw.union(bad), {"schema": "t long"})
    assert rows(got.errors) == [("{", "can't read as JSON_OBJECT")]
    (r,) = got.output.collect()
    assert r["t"] == 5 and r["_iothub"]["deviceId"] == "d1" and r["_iothub"]["properties"]["iothub-connection-device-id"] == "d1"


def test_prepared_messages(spark):
    df = spark.createDataFrame([("h 1", 1, 2.5, True, 'q"x', 1700)], "host string, n long, d double, b boolean, s string, at long")
    line = PREPARE["influxdbsink"](df, {"measurement": "m x", "tagFields": ["host"], "timestampField": "at"}).first()[0]
    assert line == 'm\\ x,host=h\\ 1 n=1i,d=2.5,b=true,s="q\\"x" 1700'
    assert PREPARE["influxdbsink"](df.select("host"), {"measurement": "m", "tagFields": ["host"]}).count() == 0
    assert json.loads(PREPARE["splunkhecsink"](df.select("n"), {"index": "i"}).first()[0]) == {"event": {"n": 1}, "index": "i"}
    key = PREPARE["kafkasink"](df, {"partitionKeyFieldExpressionStr": "$.host"}).first()
    assert key["key"] == "h 1" and json.loads(key["value"])["n"] == 1
    mail = PREPARE["smtpsink"](df, {"toTemplate": "{{ $.host }}@x.org", "subjectTemplate": "n is {{$.n}}", "bodyTemplate": "b"}).first()
    assert (mail["to"], mail["cc"], mail["subject"], mail["body"]) == ("h 1@x.org", None, "n is 1", "b")
    assert "TimeGenerated" in json.loads(PREPARE["azuremonitorsink"](df.select("n"), {}).first()[0])
    times = PREPARE["timescaledbsink"](df, {"timeColumn": "at", "timeUnit": "SECONDS"}).select(F.unix_seconds(F.col("at"))).first()[0]
    assert times == 1700 and "create_hypertable('s.t', 'at'" in outputs.hypertable_sql({"schemaName": "s", "tableName": "t", "timeColumn": "at"})


def test_posting_with_retries(spark):
    service = Service(fail_first=2)
    d = write(spark.range(5).repartition(1), "elasticsearchsink", {"host": service.url, "index": "i", "batchSize": 3, "firstDelaySeconds": 0.01})
    assert (d.inputCount, d.successCount) == (5, 5)
    assert [len(r[2].splitlines()) for r in service.requests] == [6, 4]
    down = Service(fail_first=99)
    d = write(spark.range(5).repartition(1), "splunkhecsink", {"hecUrl": down.url, "firstDelaySeconds": 0.01})
    assert (d.inputCount, d.successCount) == (5, 0)


def test_upserts(spark, tmp_path):
    db = str(tmp_path / "d.db")
    with sqlite3.connect(db) as c:
        c.execute("CREATE TABLE t (k INTEGER PRIMARY KEY, v TEXT)")
        c.execute("INSERT INTO t VALUES (1, 'old')")

    def connect(db=db):
        import sqlite3

        return sqlite3.connect(db, timeout=30)

    df = spark.createDataFrame([(1, "new"), (2, "two")], "k long, v string").repartition(1)
    d = write(df, "jdbcsink", {"jdbcUrl": "x", "tableName": "t", "writeMode": "UPSERT", "upsertKeyColumns": "k", "connect": connect})
    assert d.successCount == 2
    with sqlite3.connect(db) as c:
        assert c.execute("SELECT * FROM t ORDER BY k").fetchall() == [(1, "new"), (2, "two")]
    assert outputs.upsert_sql("t", ["k"], ["k"]).endswith("DO NOTHING")


def test_lake_sinks_append(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, p string")
    schema = {"type": "record", "name": "r", "fields": [{"name": "k", "type": "int"}, {"name": "p", "type": ["null", "string"]}, {"name": "none", "type": ["null", "double"]}]}
    for _ in range(2):
        d = write(df, "deltalakesink", {"tablePath": str(tmp_path / "t"), "partitionColumns": ["p"], "avroSchema": schema, "format": "parquet"})
    back = spark.read.parquet(str(tmp_path / "t"))
    assert d.successCount == 2 and back.count() == 4 and back.schema["k"].dataType == T.IntegerType()


def test_stdout_sink(spark, capsys):
    assert write(spark.range(2), "stdout", {}).successCount == 2
    assert capsys.readouterr().out.count('"id"') == 2
    with pytest.raises(ExpressionError):
        write(spark.range(1), "nope")


def test_avro_schemas(spark):
    t = spark_type({"type": "record", "name": "r", "fields": [{"name": "d", "type": {"type": "int", "logicalType": "date"}}, {"name": "t", "type": ["null", {"type": "long", "logicalType": "timestamp-millis"}]}, {"name": "m", "type": {"type": "map", "values": "double"}}, {"name": "a", "type": {"type": "array", "items": "string"}}, {"name": "c", "type": {"type": "bytes", "logicalType": "decimal", "precision": 9, "scale": 2}}, {"name": "e", "type": {"type": "enum", "name": "x", "symbols": ["A"]}}]})
    assert t.simpleString() == "struct<d:date,t:timestamp,m:map<string,double>,a:array<string>,c:decimal(9,2),e:string>"
    df = fitted(spark.createDataFrame([(19000, 1700000000000)], "d long, t long"), {"type": "record", "name": "r", "fields": [{"name": "d", "type": {"type": "int", "logicalType": "date"}}, {"name": "t", "type": {"type": "long", "logicalType": "timestamp-millis"}}]})
    r = df.select("d", F.unix_millis("t")).first()
    assert str(r[0]) == "2022-01-08" and r[1] == 1700000000000
    with pytest.raises(ExpressionError):
        spark_type(["null", "int", "string"])


def test_refused_items_are_sent_again_then_given_back(spark, tmp_path):
    from rillflow.plans.dag import Dag, execute

    refusal = {"errors": True, "items": [{"index": {"status": 201}}, {"index": {"status": 400, "error": {"reason": "no"}}}]}
    service = Service([refusal, {"errors": True, "items": [{"index": {"status": 400, "error": {"reason": "no"}}}]}] + [{"errors": True, "items": [{"index": {"status": 400, "error": {"reason": "still no"}}}]}] * 2)
    df = spark.createDataFrame([(1,), (2,)], "a long").coalesce(1)
    config = {"host": service.url, "index": "i", "firstDelaySeconds": 0}
    nodes = [{"id": "in", "commandName": "filesource", "config": {"filePath": "given", "encodingType": "JSON_OBJECT"}, "outputs": ["es"]}, {"id": "es", "commandName": "elasticsearchsink", "config": config}]
    run = execute(spark, Dag.from_dict({"jobContext": {"dlqConfig": {"path": str(tmp_path)}}, "dag": nodes}), inputs={"in": df})
    assert (run.deliveries["es"].inputCount, run.deliveries["es"].successCount) == (2, 1)
    # of four posts the later ones hold the refused record alone
    assert [b.count("_index") for _, _, b, _ in service.requests] == [2, 1, 1, 1]
    (lost,) = spark.read.parquet(f"{tmp_path}/dead-letters").collect()
    assert '\\"a\\":2' in bytes(lost["value"]).decode() and "still no" in lost["errorMessage"] and lost["nodeId"] == "es"


def test_a_sink_that_fails_without_dead_letters_fails_the_run(spark):
    from rillflow.plans.dag import Dag, execute

    service = Service(fail_first=99)
    nodes = [{"id": "in", "commandName": "filesource", "config": {"filePath": "given", "encodingType": "JSON_OBJECT"}, "outputs": ["hec"]}, {"id": "hec", "commandName": "splunkhecsink", "config": {"hecUrl": service.url, "firstDelaySeconds": 0}}]
    with pytest.raises(RuntimeError, match="took 0 of 1"):
        execute(spark, Dag.from_dict({"dag": nodes}), inputs={"in": spark.createDataFrame([(1,)], "a long")})
    assert not service.requests


def test_messages_are_fetched_once_and_unreadable_ones_reach_the_dead_letters(spark, tmp_path, monkeypatch):
    from rillflow.plans.dag import Dag, execute

    fetched = spark.sparkContext.accumulator(0)

    def queue(spark, config, streaming=False):
        @F.udf("string")
        def fetch(i):
            fetched.add(1)
            return "{bad" if i == 3 else json.dumps({"a": i})

        return inputs.messages(config, spark.range(5).select(fetch("id").alias("value")), schema="a long")

    monkeypatch.setitem(SOURCES, "testqueue", queue)
    sink = lambda name: {"id": name, "commandName": "s3sink", "config": {"path": str(tmp_path / name), "encodingType": "PARQUET"}}
    nodes = [{"id": "in", "commandName": "testqueue", "config": {}, "outputs": ["x", "y"]}, sink("x"), sink("y")]
    run = execute(spark, Dag.from_dict({"jobContext": {"dlqConfig": {"path": str(tmp_path)}}, "dag": nodes}))
    assert fetched.value == 5
    assert all(sorted(rows(spark.read.parquet(str(tmp_path / s)))) == [(0,), (1,), (2,), (4,)] for s in "xy")
    (lost,) = spark.read.parquet(f"{tmp_path}/dead-letters").collect()
    assert bytes(lost["value"]) == b"{bad" and lost["nodeId"] == "in"
    (path,) = run.kept
    run.discard()
    with pytest.raises(Exception):
        spark.read.parquet(path)


def test_delta_is_never_replaced_silently(spark, tmp_path):
    with pytest.raises(ExpressionError, match="Delta is not installed"):
        write(spark.createDataFrame([(1,)], "a long"), "deltalakesink", {"tablePath": str(tmp_path / "t")})
