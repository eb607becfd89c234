"""SQL statements of the dialect to DataFrames.

Relations keep their columns under names of their own, so that scoping is settled here and Catalyst sees
plain filters, joins and aggregates: comma lists with conditions become equi-joins, filters reach scans.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import sql_functions as fn
from ..functions.compiler import quoted
from ..functions.sql_syntax import AGGREGATES, SET_FUNCTIONS, Cast, Col, Func, Item, Lit, Op, Select, Star, When, parse_sql
from ..functions.syntax import ExpressionError
from ..functions.values import BOOL, DOUBLE, LONG, STRING, Value, converted, kind_of, literal, storable, unified


@dataclass
class Relation:
    """An alias and its columns: (visible name, stored name, type)."""

    alias: str | None
    columns: list[tuple[str, str, T.DataType]]
    scalar: bool = False


@dataclass
class Scope:
    relations: list[Relation] = field(default_factory=list)
    outer: "Scope | None" = None

    def find(self, col: Col, first: list[Relation] | None = None) -> Value | None:
        table, name = col.table and col.table.lower(), col.name.lower()
        hits = []
        for r in first or self.relations:
            if table is not None and (r.alias or "").lower() != table:
                continue
            for visible, stored, t in r.columns:
                if visible.lower() == name or r.scalar and (r.alias or "").lower() == name:
                    hits.append((stored, t))
                    break
            else:  # a member of a set-returning function's record
                if r.scalar and table is not None and isinstance(t := r.columns[0][2], T.StructType):
                    f = next((f for f in t if f.name.lower() == name), None)
                    if f is not None:
                        return Value(F.col(quoted(r.columns[0][1])).getField(f.name), f.dataType)
        if table is None and not hits:  # a bare name may be a relation: its value, or its record
            for r in self.relations:
                if (r.alias or "").lower() == name and not r.scalar:
                    t = T.StructType([T.StructField(v, x) for v, _, x in r.columns])
                    return Value(F.struct(*[F.col(quoted(s)).alias(v) for v, s, _ in r.columns]), t)
        if len(hits) > 1:
            raise ExpressionError(f"ambiguous column {col.name}")
        if hits:
            return stored_value(*hits[0])
        return self.outer.find(col) if self.outer is not None else None


def stored_value(stored: str, t: T.DataType) -> Value:
    """A stored column; whole numbers are long and floats double, times stay times."""
    col = F.col(quoted(stored))
    if isinstance(t, T.IntegralType) and not isinstance(t, T.LongType):
        return Value(col.cast(LONG), LONG)
    if isinstance(t, T.FloatType):
        return Value(col.cast(DOUBLE), DOUBLE)
    return Value(col, t)


class Query:
    """Builds one SELECT over named DataFrames."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], serial=None, outer: Scope | None = None, rows: DataFrame | None = None):
        """``outer`` and ``rows``: of a lateral sub-select, the scope and the rows it is computed beside."""
        self.spark, self.tables = spark, {k.lower(): v for k, v in tables.items()}
        self.serial, self.outer, self.rows = serial or count(1), outer, rows
        #: what a lateral sub-select carries along: the outer row's columns, the first of which tells rows apart
        self.carried = [] if rows is None else rows.columns

    # --- FROM --------------------------------------------------------------------------------

    def relation(self, df: DataFrame, alias: str | None) -> tuple[DataFrame, Relation]:
        n = next(self.serial)
        names = [(c, f"r{n}_{i}") for i, c in enumerate(df.columns)]
        renamed = df.select(*[df[quoted(c)].alias(s) for c, s in names])
        return renamed, Relation(alias, [(c, s, df.schema[c].dataType) for c, s in names])

    def sources(self, q: Select) -> tuple[DataFrame, Scope]:
        scope = Scope(outer=self.outer)
        df, pending = self.rows, []
        for s in q.sources:
            if s.function is not None:
                pending.append((s.function, s.alias))
                continue
            if s.query is not None and s.lateral:
                df = self.expanded(df, scope, pending)
                pending = []
                if df is None:
                    df = self.spark.range(1).select()
                # computed beside the rows it refers to: one pass, no plan per row
                row = f"row{next(self.serial)}"
                df = df.select(F.monotonically_increasing_id().alias(row), *[df[quoted(c)] for c in df.columns])
                own = df.columns
                df = Query(self.spark, self.tables, self.serial, scope, df).build(s.query)
                names = [(c, f"r{next(self.serial)}") for c in df.columns[len(own) :]]
                types = [f.dataType for f in df.schema][len(own) :]
                df = df.toDF(*own, *[n for _, n in names])
                relation = Relation(s.alias, [(c, n, t) for (c, n), t in zip(names, types)])
            else:
                if s.query is not None:
                    right = Query(self.spark, self.tables, self.serial).build(s.query)
                elif s.name.lower() in self.tables:
                    right = self.tables[s.name.lower()]
                else:
                    raise ExpressionError(f"unknown table {s.name}")
                right, relation = self.relation(right, s.alias or s.name)
                if any((r.alias or "").lower() == (relation.alias or "").lower() for r in scope.relations):
                    raise ExpressionError(f"the relation name {relation.alias} is used twice")
                if df is None:
                    df = right
                elif s.join == "cross":
                    df = df.crossJoin(right)
                else:
                    on = Scope([*scope.relations, relation], self.outer)
                    how = {"left": "left", "right": "right", "full": "full"}.get(s.join, "inner")
                    df = df.join(right, self.matching(s.on, on), how)
            scope.relations.append(relation)
        if df is None:
            df = self.spark.range(1).select()
        return self.expanded(df, scope, pending), scope

    def expanded(self, df: DataFrame, scope: Scope, functions: list) -> DataFrame:
        """Set-returning functions side by side: shorter ones are padded with nulls, rows without any element drop."""
        if not functions:
            return df
        lists, relations = [], []
        for f, alias in functions:
            v = self.set_function(f, scope)
            name = f"s{next(self.serial)}"
            lists.append(v.col.alias(name))
            relations.append(Relation(alias or name, [(alias or name, name, v.type.elementType)], scalar=True))
        rows = df.withColumn("_zip", F.explode(F.arrays_zip(*lists)))
        names = [r.columns[0][1] for r in relations]
        df = rows.select(*[rows[quoted(c)] for c in df.columns], *[F.col("_zip").getField(n).alias(n) for n in names])
        scope.relations += relations
        return df

    def set_function(self, f: Func, scope: Scope) -> Value:
        args = [self.expr(a, scope) for a in f.args]
        if f.name == "json_array_elements":
            v = fn.elements(args[0])
            t = T.ArrayType(storable(v.type.elementType))
            return Value(F.coalesce(converted(v.col, v.type, t), F.array().cast(t)), t)
        if f.name == "regexp_split_to_table":
            t = T.ArrayType(T.StructType([T.StructField("row", STRING)]))
            return Value(F.transform(fn.pieces(*args), lambda x: F.struct(x.alias("row"))), t)
        if f.name in ("json_each", "json_each_text"):
            kind = "string" if f.name == "json_each_text" else "variant"
            t = T.ArrayType(T.StructType([T.StructField("key", STRING), T.StructField("value", STRING if kind == "string" else T.VariantType())]))
            text = fn.as_text(args[0]) if args[0].type == STRING else F.to_json(args[0].col)
            pairs = F.map_entries(F.try_variant_get(F.try_parse_json(text), "$", f"map<string,{kind}>"))
            return Value(F.coalesce(pairs, F.array().cast(t)), t)
        raise ExpressionError(f"{f.name} is no set-returning function")

    # --- expressions -------------------------------------------------------------------------

    def expr(self, e, scope: Scope, known: dict | None = None) -> Value:
        """``known`` holds values that are computed already: group keys, aggregates, lifted functions."""
        if known and e in known:
            return known[e]
        go = lambda x: self.expr(x, scope, known)
        if isinstance(e, Lit):
            return literal(e.value)
        if isinstance(e, Col):
            v = scope.find(e)
            if v is None:
                raise ExpressionError(f"unknown column {(e.table + '.') if e.table else ''}{e.name}")
            if known is not None and known.get("grouped"):
                raise ExpressionError(f"column {e.name} must be in GROUP BY or in an aggregate")
            return v
        if isinstance(e, Cast):
            return fn.cast(go(e.expr), e.type)
        if isinstance(e, When):
            cases = [(go(c), go(r)) for c, r in e.cases]
            default = literal(None) if e.default is None else go(e.default)
            t = reduce(unified, [r.type for _, r in cases], default.type)
            col = F
            for c, r in cases:
                col = col.when(F.coalesce(fn.truth(c), F.lit(False)), converted(r.col, r.type, t))
            return Value(col.otherwise(converted(default.col, default.type, t)), t)
        if isinstance(e, Op):
            return self.operator(e, [go(a) for a in e.args])
        if isinstance(e, Func):
            if e.name in AGGREGATES:
                raise ExpressionError(f"{e.name} is not allowed here")
            if e.name not in fn.SCALARS:
                raise ExpressionError(f"function {e.name} does not exist")
            return fn.SCALARS[e.name](*[go(a) for a in e.args])
        raise ExpressionError("* is not allowed here")

    def operator(self, e: Op, a: list[Value]) -> Value:
        if e.op in ("+", "-", "*", "/", "%", "^"):
            return fn.arithmetic(e.op, *a)
        if e.op == "negate":
            return fn.arithmetic("-", Value(F.lit(0).cast(a[0].type) if a[0].kind == "number" else F.lit(0).cast(LONG), a[0].type if a[0].kind == "number" else LONG), a[0])
        if e.op == "||":
            return fn.joined(*a)
        if e.op in ("=", "!=", "<", ">", "<=", ">="):
            return fn.compared(e.op, *a)
        if e.op in ("and", "or"):
            x, y = (fn.truth(v) for v in a)
            both = x & F.coalesce(y, F.lit(False)) if e.op == "and" else x | F.coalesce(y, F.lit(False))
            return Value(F.when(x.isNotNull(), both), BOOL)
        if e.op == "not":
            return Value(F.coalesce(~fn.truth(a[0]), F.lit(True)), BOOL)
        if e.op in ("is null", "is not null"):
            gone = F.lit(True) if a[0].kind == "null" else a[0].col.isNull()
            return Value(gone if e.op == "is null" else ~gone, BOOL)
        if e.op in ("like", "ilike"):
            return fn.like(*a, e.op == "ilike")
        if e.op in ("->", "->>"):
            return fn.json_get(*a, e.op == "->>")
        if e.op == "in":
            return Value(reduce(lambda x, y: x | y, [fn.compared("=", a[0], v).col for v in a[1:]]), BOOL)
        if e.op == "between":
            return Value(fn.compared(">=", a[0], a[1]).col & fn.compared("<=", a[0], a[2]).col, BOOL)
        raise ExpressionError(f"unknown operator {e.op}")

    def condition(self, e, scope: Scope, known: dict | None = None) -> Column:
        """A condition of WHERE, HAVING or ON: conjunctions and disjunctions stay plain, as null drops the row or pair anyway."""
        if isinstance(e, Op) and e.op in ("and", "or"):
            x, y = (self.condition(x, scope, known) for x in e.args)
            # a null left side makes the whole null, so 'null or true' drops the row too
            return x & y if e.op == "and" else x | (y & self.expr(e.args[0], scope, known).col.isNotNull()) if may_be_null(e.args[0]) else x | y
        return fn.truth(self.expr(e, scope, known))

    def matching(self, e, scope: Scope) -> Column:
        """The condition of an explicit join. Its conjuncts stay plain, so that equalities make equi-joins and filters reach scans.
        If some may fail, the whole follows as it is written, for pairs that meet the first conjunct and those that can't fail."""
        parts = conjuncts(e)
        plain = [c for i, c in enumerate(parts) if i == 0 or self.settled(c, scope)]
        if len(plain) == len(parts):
            return self.condition(e, scope)
        return reduce(lambda x, y: x & y, [self.veiled(c, scope) for c in plain]) & fn.truth(self.expr(e, scope))

    def settled(self, e, scope: Scope) -> bool:
        """Whether a condition can't fail: columns and literals of one kind are compared, nothing is computed or converted."""
        if isinstance(e, Op) and e.op in ("and", "or", "not"):
            return all(self.settled(a, scope) for a in e.args)
        args = e.args if isinstance(e, Op) and e.op in ("=", "!=", "<", ">", "<=", ">=", "in", "between", "is null", "is not null") else (e,)
        if not all(isinstance(a, (Col, Lit)) for a in args):
            return False
        types = [v.type for v in (self.expr(a, scope) for a in args) if v.kind != "null"]
        kinds = {kind_of(t) for t in types}
        if not isinstance(e, Op):
            return kinds <= {"boolean"}
        return len(set(types)) < 2 or kinds in ({"number"}, {"string"})

    def veiled(self, e, scope: Scope) -> Column:
        """A condition whose equal sides Spark doesn't take for one: else it infers from them that what may fail holds for one side's rows alone."""
        if isinstance(e, Op) and e.op in ("=", "in") and len(e.args) == 2:
            a, b = (self.expr(x, scope) for x in e.args)
            if a.kind not in ("null", "variant"):
                return fn.compared("=", Value(F.greatest(a.col, a.col), a.type), b).col
        return self.condition(e, scope)

    # --- SELECT ------------------------------------------------------------------------------

    def build(self, q: Select) -> DataFrame:
        df, scope = self.sources(q)
        unnamed = count(1)
        known: dict = {}
        lifted = []
        for item in q.items:
            for f in found(item.expr, SET_FUNCTIONS):
                if f not in [x for x, _ in lifted]:
                    lifted.append((f, None))
                    next(unnamed)
        if lifted:
            before = len(scope.relations)
            df = self.expanded(df, scope, lifted)
            for (f, _), r in zip(lifted, scope.relations[before:]):
                known[f] = stored_value(r.columns[0][1], r.columns[0][2])
            hidden, scope.relations = scope.relations[before:], scope.relations[:before]
        if q.where is not None:
            df = df.where(self.condition(q.where, scope, known))
        items = self.star(q.items, scope)
        aggregates = list(dict.fromkeys(f for e in [*(i.expr for i in items), q.having, *(e for e, _ in q.order)] for f in found(e, AGGREGATES)))
        if q.group or aggregates:
            df, known = self.grouped(df, scope, q.group, aggregates, known)
        if q.having is not None:
            df = df.where(self.condition(q.having, scope, known))
        values: list[tuple[str, Value]] = []
        taken: set[str] = set()
        lifted_at = {f: f"col_{i + 1}" for i, (f, _) in enumerate(lifted)}
        for i in items:
            name = i.alias or (i.expr.name if isinstance(i.expr, Col) else lifted_at.get(i.expr) if isinstance(i.expr, Func) else None) or f"col_{next(unnamed)}"
            if name.lower() in taken and isinstance(i.expr, Col) and i.expr.table:
                name = f"{i.expr.table}.{name}"
            base, k = name, 2
            while name.lower() in taken:
                name, k = f"{base}_{k}", k + 1
            taken.add(name.lower())
            values.append((name, self.expr(i.expr, scope, known)))
        named = dict((n.lower(), v) for n, v in values)
        order = []
        for e, ascending in q.order:
            try:
                v = self.expr(e, scope, known)
            except ExpressionError:
                if not isinstance(e, Col) or e.table or e.name.lower() not in named:
                    raise
                v = named[e.name.lower()]
            order.append(v.col.asc_nulls_last() if ascending else v.col.desc_nulls_first())
        columns = [*self.carried, *[converted(v.col, v.type, storable(v.type)).alias(n) for n, v in values]]
        if self.carried and q.limit is not None and not q.distinct:
            df = df.withColumn("_nth", F.row_number().over(Window.partitionBy(self.carried[0]).orderBy(*(order or [F.lit(0)])))).where(F.col("_nth") <= q.limit)
            return df.select(*columns)
        if q.distinct_on:
            keys = [named[e.name.lower()].col if isinstance(e, Col) and not e.table and e.name.lower() in named else self.expr(e, scope, known).col for e in q.distinct_on]
            window = Window.partitionBy(*self.carried[:1], *keys).orderBy(*(order or [F.lit(0)]))
            df = df.withColumn("_nth", F.row_number().over(window)).where("_nth = 1")
        if q.distinct:
            out = df.select(*columns).distinct()
            if order:
                order = [named_order(out, e, asc) for e, asc in q.order]
                out = out.orderBy(*order)
        else:
            out = (df.orderBy(*order) if order else df).select(*columns)
        return out if q.limit is None else out.limit(q.limit)

    def star(self, items: list[Item], scope: Scope) -> list[Item]:
        out = []
        for i in items:
            if isinstance(i.expr, Star) or isinstance(i.expr, Col) and i.expr.name == "*":
                only = None if isinstance(i.expr, Star) else i.expr.table.lower()
                for r in scope.relations:
                    if only is None or (r.alias or "").lower() == only:
                        out += [Item(Col(r.alias, v)) for v, _, _ in r.columns]
            else:
                out.append(i)
        return out

    def grouped(self, df: DataFrame, scope: Scope, group: list, aggregates: list[Func], known: dict) -> tuple[DataFrame, dict]:
        """Group keys and aggregates as columns. Without GROUP BY one constant key groups, so that no input gives no row."""
        keys = []
        for i, e in enumerate(group):
            v = self.expr(e, scope, known)
            t = storable(v.type)
            if kind_of(t) == "variant":
                t, v = STRING, Value(fn.as_text(v), STRING)
            keys.append((e, f"_k{i}", converted(v.col, v.type, t), t))
        keyed = df.withColumns({n: c for _, n, c, _ in keys} or {"_k": F.lit(1)})
        names = [n for _, n, _, _ in keys] or ["_k"]
        columns, results = [], {}
        for i, f in enumerate(aggregates):
            col, t = self.aggregate(f, scope, known)
            columns.append(col.alias(f"_a{i}"))
            results[f] = Value(F.col(f"_a{i}"), t)
        if self.carried:
            names.append(self.carried[0])
            columns += [F.first(quoted(c)).alias(c) for c in self.carried[1:]]
        grouped = keyed.groupBy(*names)
        out = grouped.agg(*columns) if columns else keyed.select(*names).distinct()
        new: dict = dict(results)
        for e, n, _, t in keys:
            new[e] = stored_value(n, t)
            if isinstance(e, Col):  # other spellings of a grouped column
                for r in scope.relations:
                    for visible, stored, _ in r.columns:
                        if scope.find(e) is not None and visible.lower() == e.name.lower() and (e.table is None or (r.alias or "").lower() == e.table.lower()):
                            for spelt in (Col(None, e.name), Col(r.alias, e.name), Col(r.alias, visible), Col(None, visible)):
                                new.setdefault(spelt, new[e])
        return out, new | {"grouped": True}

    def aggregate(self, f: Func, scope: Scope, known: dict) -> tuple[Column, T.DataType]:
        if f.name == "count":
            if not f.args or isinstance(f.args[0], Star):
                return F.count(F.lit(1)), LONG
            a = self.expr(f.args[0], scope, known)  # null rows count too
            return (F.count_distinct(F.struct(a.col)) if f.distinct else F.count(F.lit(1))), LONG
        a = [self.expr(x, scope, known) for x in f.args]
        if f.name in ("sum", "avg"):
            t = LONG if isinstance(a[0].type, T.IntegralType) else DOUBLE if not isinstance(a[0].type, T.DecimalType) else a[0].type
            x = fn.as_number(a[0], t)
            if f.name == "avg":
                return F.avg(x), DOUBLE
            total = F.sum_distinct(x) if f.distinct else F.sum(x)
            return F.coalesce(total, F.lit(0).cast(t)), t
        if f.name in ("min", "max"):
            return (F.min if f.name == "min" else F.max)(a[0].col), a[0].type
        if f.name == "string_agg":
            text = F.coalesce(fn.as_text(a[0]), F.lit("null"))
            return F.array_join(F.collect_set(text) if f.distinct else F.collect_list(text), str(a[1].literal) if len(a) > 1 else ""), STRING
        if a[0].kind not in ("record", "variant"):
            raise ExpressionError("json_agg takes one record")
        t = storable(a[0].type)
        return F.collect_list(converted(a[0].col, a[0].type, t)), T.ArrayType(t)


def conjuncts(e) -> list:
    return [c for a in e.args for c in conjuncts(a)] if isinstance(e, Op) and e.op == "and" else [e]


def may_be_null(e) -> bool:
    return not (isinstance(e, Op) and e.op in ("is null", "is not null", "not"))


def named_order(df: DataFrame, e, ascending: bool) -> Column:
    name = next((c for c in df.columns if isinstance(e, Col) and c.lower() == e.name.lower()), None)
    if name is None:
        raise ExpressionError("with DISTINCT the order must name selected columns")
    return df[quoted(name)].asc_nulls_last() if ascending else df[quoted(name)].desc_nulls_first()


def found(e, names: set[str]) -> list[Func]:
    """Calls of ``names`` in an expression, outermost first."""
    if isinstance(e, Func):
        return [e] if e.name in names else [f for a in e.args for f in found(a, names)]
    if isinstance(e, Op):
        return [f for a in e.args for f in found(a, names)]
    if isinstance(e, Cast):
        return found(e.expr, names)
    if isinstance(e, When):
        return [f for c, r in e.cases for x in (c, r) for f in found(x, names)] + found(e.default, names)
    return []


def run_sql(text: str, tables: dict[str, DataFrame], spark: SparkSession | None = None) -> DataFrame:
    """A statement of the dialect over named DataFrames."""
    spark = spark or next(iter(tables.values())).sparkSession
    return Query(spark, tables).build(parse_sql(text))


def sqleval(df: DataFrame, sql: str):
    """The ``sqleval`` node: the events are the tables ``records`` and ``events``."""
    from ..operators.base import Result

    return Result(run_sql(sql, {"records": df, "events": df}, df.sparkSession))
