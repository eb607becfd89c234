"""The parser node: extraction from a text field, merged over the record, then dispatch to nested parsers.

Where every rule names its fields beforehand the node is Columns only. Else the whole tree of rules
runs in Arrow batches and the event becomes one VARIANT column; ``fields`` in the configuration asks
for named string columns instead.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.compiler import EVENT, Compiler, quoted
from ..functions.syntax import ExpressionError
from ..functions.values import converted, unified
from .base import Result, event_json
from .extraction import Rule, rule_of


class ParseTree:
    """A parser configuration with its rules built."""

    def __init__(self, config: dict):
        if not config.get("targetField"):
            raise ExpressionError("parser: no targetField")
        self.target, self.remove = config["targetField"], bool(config.get("removeTargetField"))
        self.rule: Rule = rule_of(config["extractionConfig"])
        dispatch = config.get("dispatchConfig") or {}
        self.field = dispatch.get("dispatchField")
        self.branches = {str(k): ParseTree(v) for k, v in (dispatch.get("dispatchMap") or {}).items()} if self.field else {}
        self.default = ParseTree(dispatch["defaultConfig"]) if self.field and dispatch.get("defaultConfig") else None

    def native(self) -> bool:
        return self.rule.columns is not None and all(t.native() for t in [*self.branches.values(), *([self.default] if self.default else [])])

    def read(self, record: dict) -> dict:
        text = record.get(self.target)
        if not isinstance(text, str) or not text:
            return record
        record = record | self.rule.read(text)
        if self.remove:
            record.pop(self.target, None)
        if self.field is None or record.get(self.field) is None:
            return record
        follower = self.branches.get(str(record[self.field]), self.default)
        return follower.read(record) if follower else record


Fields = dict[str, tuple[Column, T.DataType]]


def extracted(tree: ParseTree, fields: Fields, active: Column | None) -> tuple[Fields, Column | None, Column | None]:
    """The fields that one rule changes (with target removal), where it applies, and its failure message."""
    if tree.target not in fields or not isinstance(fields[tree.target][1], T.StringType):
        return {}, None, None
    text = fields[tree.target][0]
    on = F.coalesce(text != "", F.lit(False))
    on = on if active is None else active & on
    found, err = tree.rule.columns(text)
    out: Fields = {}
    for name, (col, t) in found.items():
        old = fields.get(name)
        both = unified(old[1], t) if old else t
        new = F.when(on, converted(col, t, both))
        out[name] = (new.otherwise(converted(old[0], old[1], both)) if old else new, both)
    if tree.remove:
        kept, t = out.get(tree.target, fields[tree.target])
        out[tree.target] = (F.when(~on, kept), t)
    return out, on, None if err is None else F.when(on, err)


def applied(df: DataFrame, tree: ParseTree, active: str | None, failure: str) -> DataFrame:
    """``df`` after a parse tree on the rows where the column ``active`` holds; messages gather in the column ``failure``.

    Each level is a projection of its own, so nested rules read plain columns.
    """
    fields: Fields = {f.name: (F.col(quoted(f.name)), f.dataType) for f in df.schema if not f.name.startswith("_rf_")}
    changed, on, err = extracted(tree, fields, F.col(active) if active else None)
    if on is None:
        return df
    new = {n: c for n, (c, _) in changed.items()}
    new[failure] = F.coalesce(F.col(failure), err) if err is not None else F.col(failure)
    new["_rf_on"] = on
    df = df.withColumns(new)
    if tree.field is None or tree.field not in df.columns:
        return df.drop("_rf_on")
    key = F.col(quoted(tree.field)).cast("string")
    branches = [(b, key == v) for v, b in tree.branches.items()]
    if tree.default:
        branches.append((tree.default, ~key.isin(list(tree.branches))))
    plain = [(b, c) for b, c in branches if b.field is None]
    fields = {f.name: (F.col(quoted(f.name)), f.dataType) for f in df.schema if not f.name.startswith("_rf_")}
    chosen: dict[str, list] = {}
    failures = [F.col(failure)]
    for b, c in plain:  # branches exclude each other, so all read this level's columns
        changed, on, err = extracted(b, fields, F.col("_rf_on") & F.coalesce(c, F.lit(False)))
        if on is None:
            continue
        failures += [] if err is None else [err]
        for n, (col, t) in changed.items():
            chosen.setdefault(n, []).append((on, col, t))
    new = {}
    for n, cases in chosen.items():
        t = fields[n][1] if n in fields else cases[0][2]
        for _, _, other in cases:
            t = unified(t, other)
        col = F
        for on, c, own in cases:
            col = col.when(on, converted(c, own, t))
        new[n] = col.otherwise(converted(*fields[n], t)) if n in fields else col
    new[failure] = F.coalesce(*failures) if len(failures) > 1 else failures[0]
    nested = [(i, b, c) for i, (b, c) in enumerate(branches) if b.field is not None]
    for i, _, c in nested:
        new[f"_rf_{failure}_{i}"] = F.col("_rf_on") & F.coalesce(c, F.lit(False))
    df = df.withColumns(new).drop("_rf_on")
    for i, b, _ in nested:
        df = applied(df, b, f"_rf_{failure}_{i}", failure).drop(f"_rf_{failure}_{i}")
    return df


def can_fail(tree: ParseTree) -> bool:
    return tree.rule.columns(F.lit(""))[1] is not None or any(can_fail(t) for t in [*tree.branches.values(), *([tree.default] if tree.default else [])])


def parse(df: DataFrame, config: dict) -> Result:
    """``parser``: rows whose target is no text, or empty, stay as they are; rows that a rule can't read become errors."""
    tree = ParseTree(config)
    dynamic = Compiler(df.schema).dynamic
    if tree.native() and not dynamic:
        failure = "_rf_failure"
        before = df.columns
        done = applied(df.withColumn(failure, F.lit(None).cast("string")), tree, None, failure)
        errors = None
        if done.schema[failure].dataType != T.NullType() and can_fail(tree):
            kept = df.withColumn("_rf_event", event_json(df)).withColumn(failure, F.lit(None).cast("string"))
            errors = applied(kept, tree, None, failure).where(F.col(failure).isNotNull()).select(F.col("_rf_event").alias("event"), F.col(failure).alias("errorMessage"))
            done = done.where(F.col(failure).isNull())
        done = done.drop(failure)
        if tree.remove and tree.target in before and isinstance(df.schema[tree.target].dataType, T.StringType):
            done = done.drop(tree.target) if tree.target not in tree.rule.columns(F.lit(""))[0] else done  # null on every parsed row
        return Result(done, errors)

    @F.pandas_udf("out string, err string")
    def run(events: pd.Series) -> pd.DataFrame:
        out, errors = [], []
        for e in events:
            try:
                out.append(json.dumps(tree.read(json.loads(e)), ensure_ascii=False))
                errors.append(None)
            except Exception as x:  # the row fails, not the job
                out.append(None)
                errors.append(f"failed to parse input: {x}")
        return pd.DataFrame({"out": out, "err": errors}, dtype=object)

    event = F.to_json(F.col(EVENT)) if dynamic else event_json(df)
    done = df.select(event.alias("event"), run(event).alias("r"))
    failed = done.where("r.err is not null").select("event", F.col("r.err").alias("errorMessage"))
    good = done.where("r.err is null").select(F.parse_json(F.col("r.out")).alias(EVENT))
    if config.get("fields"):
        good = good.select(*[F.try_variant_get(EVENT, "$[" + json.dumps(n) + "]", "string").alias(n) for n in config["fields"]])
    return Result(good, failed)
