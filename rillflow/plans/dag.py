"""Pipeline definitions: a graph of commands, checked and run as lazy DataFrames.

A node's events are a DataFrame; failures are a second one. Nothing runs until a sink writes or a
result is asked for, so Catalyst sees a whole path from source to sink.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.syntax import ExpressionError
from ..operators import core
from ..operators.base import Result
from ..operators.files import read_listed_files
from ..operators.parser import parse
from ..sources.inputs import SOURCES, Messages, open_source
from ..sources.kept import remove, shared_path, written_once
from ..sources.outputs import SINKS, Delivery, settle, write, write_dead_letters
from .sql import sqleval

Transform = Callable[[DataFrame, dict], Result]

TRANSFORMS: dict[str, Transform] = {
    "noop": lambda df, c: core.noop(df),
    "eval": lambda df, c: core.evaluate(df, c["expression"], lenient=bool(c.get("lenient"))),
    "filter": lambda df, c: core.keep(df, c["expression"]),
    "assertion": lambda df, c: core.assertion(df, c["expression"]),
    "parser": parse,
    "sqleval": lambda df, c: sqleval(df, c["sql"]),
    "s3filereader": read_listed_files,
}


class DagError(ValueError):
    """The graph is no pipeline."""


def register(name: str, transform: Transform) -> None:
    """Adds a command of one's own; a name that is taken is an error."""
    if name in TRANSFORMS or name in SOURCES or name in SINKS:
        raise DagError(f"the command {name} exists already")
    TRANSFORMS[name] = transform


@dataclass
class Node:
    id: str
    command: str
    config: dict = field(default_factory=dict)
    outputs: list[str] = field(default_factory=list)


@dataclass
class Dag:
    nodes: dict[str, Node]
    context: dict = field(default_factory=dict)

    @classmethod
    def from_dict(cls, definition: dict) -> "Dag":
        nodes: dict[str, Node] = {}
        for n in definition.get("dag") or []:
            if n["id"] in nodes:
                raise DagError(f"the node id {n['id']} is used twice")
            config = n.get("config") or {}
            nodes[n["id"]] = Node(n["id"], n["commandName"], json.loads(config) if isinstance(config, str) else config, list(n.get("outputs") or []))
        return cls(nodes, definition.get("jobContext") or {})

    @classmethod
    def from_json(cls, text: str) -> "Dag":
        return cls.from_dict(json.loads(text))

    @classmethod
    def from_yaml(cls, text: str) -> "Dag":
        import yaml

        return cls.from_dict(yaml.safe_load(expand_environment(text)))

    @classmethod
    def from_file(cls, path: str) -> "Dag":
        text = Path(path).read_text()
        return cls.from_json(text) if path.endswith(".json") else cls.from_yaml(text)

    def to_dict(self) -> dict:
        return {"jobContext": self.context, "dag": [{"id": n.id, "commandName": n.command, "config": n.config, "outputs": n.outputs} for n in self.nodes.values()]}

    def parents(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {i: [] for i in self.nodes}
        for n in self.nodes.values():
            for o in n.outputs:
                out[o].append(n.id)
        return out

    def kind(self, node: Node) -> str:
        for kind, names in (("transform", TRANSFORMS), ("source", SOURCES), ("sink", SINKS)):
            if node.command in names:
                return kind
        raise DagError(f"unknown command {node.command} at node {node.id}")

    def validate(self, *, need_source: bool = True) -> list[str]:
        """The node ids in order of evaluation; raises if the graph is empty, torn, cyclic or misplaces sources and sinks."""
        if not self.nodes:
            raise DagError("the graph has no nodes")
        for n in self.nodes.values():
            if missing := [o for o in n.outputs if o not in self.nodes]:
                raise DagError(f"node {n.id} leads to unknown nodes {missing}")
        parents = self.parents()
        for n in self.nodes.values():
            kind = self.kind(n)
            if kind == "source" and parents[n.id]:
                raise DagError(f"the source {n.id} has inputs")
            if kind == "sink" and n.outputs:
                raise DagError(f"the sink {n.id} has outputs")
            if kind != "source" and not parents[n.id] and need_source:
                raise DagError(f"node {n.id} has no input")
        near = {i: {*self.nodes[i].outputs, *parents[i]} for i in self.nodes}
        reached, front = set(), [next(iter(self.nodes))]
        while front:
            i = front.pop()
            if i not in reached:
                reached.add(i)
                front += near[i]
        if need_source and len(reached) != len(self.nodes):
            raise DagError("the graph is not connected")
        order, waiting = [], {i: len(set(p)) for i, p in parents.items()}
        ready = [i for i, n in waiting.items() if not n]
        while ready:
            i = ready.pop(0)
            order.append(i)
            for o in dict.fromkeys(self.nodes[i].outputs):
                waiting[o] -= 1
                if not waiting[o]:
                    ready.append(o)
        if len(order) != len(self.nodes):
            raise DagError("the graph has a cycle")
        if need_source and sum(self.kind(n) == "source" for n in self.nodes.values()) == 0:
            raise DagError("the graph has no source")
        return order


def expand_environment(text: str) -> str:
    """``${NAME}`` by the environment's value; unknown names stay."""
    return re.sub(r"\$\{(\w+)\}", lambda m: os.environ.get(m[1], m[0]), text)


def bag_union(frames: list[DataFrame]) -> DataFrame:
    """All events of several paths; fields that a path lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


@dataclass
class Run:
    """What a pipeline gave: every node's events and failures as DataFrames, and what sinks delivered."""

    outputs: dict[str, DataFrame]
    errors: dict[str, list[DataFrame]]
    sink_inputs: dict[str, DataFrame]
    deliveries: dict[str, Delivery] = field(default_factory=dict)
    kept: list[str] = field(default_factory=list)

    def all_errors(self) -> DataFrame | None:
        frames = [e for es in self.errors.values() for e in es]
        return reduce(lambda a, b: a.unionByName(b), frames) if frames else None

    def discard(self) -> None:
        """Removes the fetched messages; the run's DataFrames cannot be read any more."""
        while self.kept:
            remove(SparkSession.active(), self.kept.pop())

    def counters(self) -> dict[str, dict[str, int]]:
        """Output and error counts of each node (each runs a job)."""
        return {i: {"outputEventCount": df.count(), "errorEventCount": sum(e.count() for e in self.errors.get(i, []))} for i, df in self.outputs.items()}


def plan(spark: SparkSession, dag: Dag, *, inputs: dict[str, DataFrame | Result] | None = None, entry: DataFrame | None = None, streaming: bool = False) -> Run:
    """Builds the DataFrames of a graph without running any.

    ``inputs`` stand in for sources by node id; ``entry`` feeds the nodes without inputs of a graph that
    has no source. A node with several paths takes each path on its own, as an aggregate needs.
    """
    order = dag.validate(need_source=entry is None)
    paths: dict[str, list[tuple[str, DataFrame]]] = {i: [] for i in order}
    run = Run({}, {}, {})
    parents = dag.parents()
    for i in order:
        node, kind = dag.nodes[i], dag.kind(dag.nodes[i])
        if kind == "source":
            found = inputs[i] if inputs and i in inputs else open_source(spark, node.command, node.config, streaming=streaming)
            given = found.result if isinstance(found, Messages) else found if isinstance(found, Result) else Result(found)
            if given.errors is not None:
                run.errors.setdefault(i, []).append(given.errors.withColumns({"nodeId": F.lit(i), "upstreamId": F.lit("")}))
            frames = [(i, given.output)]
        elif not parents[i] and entry is not None:
            frames = [("", entry)]
        else:
            frames = paths[i]
        if kind == "sink":
            run.sink_inputs[i] = bag_union([f for _, f in frames])
            continue
        if kind == "transform":
            out = []
            per_path = node.command == "sqleval"
            for upstream, df in frames if per_path or len({tuple(f.dtypes) for _, f in frames}) > 1 else [(frames[0][0] if len(frames) == 1 else ",".join(u for u, _ in frames), bag_union([f for _, f in frames]))]:
                try:
                    result = TRANSFORMS[node.command](df, node.config)
                except ExpressionError as e:
                    raise DagError(f"node {i}: {e}") from e
                out.append((upstream, result.output))
                if result.errors is not None:
                    run.errors.setdefault(i, []).append(result.errors.withColumns({"nodeId": F.lit(i), "upstreamId": F.lit(upstream)}))
            frames = [(i, df) for _, df in out]
        run.outputs[i] = bag_union([df for _, df in frames])
        for o in node.outputs:
            paths[o] += [(i, df) for _, df in frames]
    return run


def execute(spark: SparkSession, dag: Dag, *, inputs: dict[str, DataFrame | Result] | None = None) -> Run:
    """Runs a batch pipeline: every sink writes, failures go to the dead letters if the context names a place.

    Messages are fetched once, into the shared folder: a queue gives each only once, and sinks and
    dead letters are jobs of their own. ``Run.discard`` removes them; a run that fails leaves them there.
    """
    dag.validate()
    given, kept = dict(inputs or {}), []
    for i, node in dag.nodes.items():
        if dag.kind(node) == "source" and i not in given:
            found = open_source(spark, node.command, node.config)
            if isinstance(found, Messages):
                kept.append(shared_path(spark, f"messages-{i}"))
                found = found.decoded(written_once(found.raw, kept[-1]))
            given[i] = found
    run = plan(spark, dag, inputs=given)
    run.kept = kept
    for i, df in run.sink_inputs.items():
        run.deliveries[i] = write(df, dag.nodes[i].command, dag.nodes[i].config)
    place = dead_letter_path(dag.context)
    settle(run.deliveries, place)
    errors = run.all_errors()
    if place and errors is not None:
        write_dead_letters(errors, place)
    return run


def dead_letter_path(context: dict) -> str | None:
    c = context.get("dlqConfig") or {}
    if c.get("path"):
        return c["path"]
    prefix = (context.get("otherProperties") or {}).get("dataKeyPrefix", "")
    return f"{'gs' if c.get('type') == 'gcs' else 's3a'}://{c['bucket']}/{prefix}" if c.get("bucket") else None
