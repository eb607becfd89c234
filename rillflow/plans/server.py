"""A small HTTP server for source-less workflows.

POST/GET/DELETE ``/api/v1/workflows`` and POST ``/api/v1/execution/run/{id}/batch`` with a JSON array of events.
"""

from __future__ import annotations

import json
import threading
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from ..functions.syntax import ExpressionError
from ..operators.base import event_json
from .dag import Dag, DagError, plan


class WorkflowServer(ThreadingHTTPServer):
    def __init__(self, spark: SparkSession, address: tuple[str, int] = ("127.0.0.1", 0)):
        super().__init__(address, Handler)
        self.spark, self.workflows, self.lock = spark, {}, threading.Lock()

    def start(self) -> str:
        threading.Thread(target=self.serve_forever, daemon=True).start()
        return f"http://{self.server_address[0]}:{self.server_address[1]}"

    def run(self, dag: Dag, events: list[dict], by_step: bool, errors_by_step: bool) -> dict:
        rows = self.spark.createDataFrame([(json.dumps(e),) for e in events], "value string")
        inferred = self.spark.read.json(rows.select("value").rdd.map(lambda r: r[0])) if events else rows
        done = plan(self.spark, dag, entry=inferred)
        dump = lambda df: [json.loads(r[0]) for r in df.select(event_json(df)).collect()] if df.columns else [{}] * df.count()
        last = {i: df for i, df in done.outputs.items() if not dag.nodes[i].outputs} | done.sink_inputs
        out: dict = {"outputEvents": {i: dump(df) for i, df in last.items()}}
        if by_step:
            out["outputByStep"] = {i: dump(df) for i, df in done.outputs.items()}
        if errors_by_step:
            out["errorByStep"] = {i: [r.asDict() for e in es for r in e.collect()] for i, es in done.errors.items()}
        return out


class Handler(BaseHTTPRequestHandler):
    server: WorkflowServer

    def reply(self, code: int, body) -> None:
        data = json.dumps(body).encode()
        self.send_response(code)
        self.send_header("Content-Type", "application/json")
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def body(self):
        return json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"null")

    def do_POST(self):
        path, _, query = self.path.partition("?")
        parts = path.strip("/").split("/")
        try:
            if parts[:3] == ["api", "v1", "workflows"] and len(parts) == 3:
                dag = Dag.from_dict(self.body())
                dag.validate(need_source=False)
                with self.server.lock:
                    self.server.workflows[i := uuid.uuid4().hex] = dag
                return self.reply(200, {"id": i})
            if parts[:4] == ["api", "v1", "execution", "run"] and parts[5:] == ["batch"]:
                dag = self.server.workflows.get(parts[4])
                if dag is None:
                    return self.reply(404, {"error": "no such workflow"})
                flags = query.lower()
                return self.reply(200, self.server.run(dag, self.body() or [], "includeoutputbystep=true" in flags, "includeerrorbystep=true" in flags))
        except (DagError, ExpressionError, KeyError, json.JSONDecodeError) as e:
            return self.reply(400, {"error": str(e)})
        return self.reply(404, {"error": "no such path"})

    def do_GET(self):
        parts = self.path.strip("/").split("/")
        if parts[:3] == ["api", "v1", "workflows"]:
            if len(parts) == 3:
                return self.reply(200, sorted(self.server.workflows))
            dag = self.server.workflows.get(parts[3])
            return self.reply(200, dag.to_dict()) if dag else self.reply(404, {"error": "no such workflow"})
        return self.reply(404, {"error": "no such path"})

    def do_DELETE(self):
        gone = self.server.workflows.pop(self.path.strip("/").split("/")[-1], None)
        return self.reply(200 if gone else 404, {"deleted": gone is not None})

    def log_message(self, *_):
        pass
