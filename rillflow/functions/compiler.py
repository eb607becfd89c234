"""Expressions to Columns: types are inferred from the input schema, so that evaluation is plain Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import syntax as S
from .syntax import ExpressionError
from .values import BOOL, DOUBLE, LONG, NULL, STRING, VARIANT, Value, as_type, converted, event_value, expect, fail_if, failing, literal, narrowed, unified

TOLERANCE = 1e-6
EVENT = "event"


class Compiler:
    """Compiles trees against one input schema; ``functions`` maps names to builders (compiler, nodes, scope) -> Value."""

    def __init__(self, schema: T.StructType, functions=None):
        from .builtins import FUNCTIONS

        self.schema, self.functions = schema, FUNCTIONS | (functions or {})
        #: dynamic mode: the whole event is one VARIANT column
        self.dynamic = len(schema) == 1 and schema[0].name == EVENT and isinstance(schema[0].dataType, T.VariantType)

    def compile(self, tree, scope: dict[str, Value] | None = None) -> Value:
        return getattr(self, f"_{type(tree).__name__.lower()}")(tree, scope or {})

    def _literal(self, tree, scope):
        return literal(tree.value)

    def _root(self, tree, scope):
        if self.dynamic:
            return Value(F.col(EVENT), VARIANT)
        fields = [(f.name, event_value(F.col(quoted(f.name)), f.dataType)) for f in self.schema]
        t = T.StructType([T.StructField(n, v.type) for n, v in fields])
        return Value(F.struct(*[v.col.alias(n) for n, v in fields]), t)

    def _variable(self, tree, scope):
        if tree.name not in scope:
            raise ExpressionError(f"unknown name {tree.name}")
        return scope[tree.name]

    def _field(self, tree, scope):
        if isinstance(tree.base, S.Root) and not self.dynamic:
            found = next((f for f in self.schema if f.name == tree.name), None)
            return event_value(F.col(quoted(tree.name)), found.dataType) if found else literal(None)
        return self.field(self.compile(tree.base, scope), tree.name)

    def field(self, base: Value, name: str) -> Value:
        """A named member: null where the record, or the member, is absent."""
        if isinstance(base.type, T.StructType):
            found = next((f for f in base.type if f.name == name), None)
            if found is None:
                return Value(F.lit(None), NULL, base.err)
            v = event_value(base.col.getField(name), found.dataType)
            return Value(v.col, v.type, base.err)
        if isinstance(base.type, T.MapType):
            v = event_value(F.try_element_at(base.col, F.lit(name)), base.type.valueType)
            return Value(v.col, v.type, base.err)
        if base.kind == "variant":
            return Value(F.try_variant_get(base.col, "$[" + repr(name) + "]", "variant"), VARIANT, base.err)
        return Value(F.lit(None), NULL, base.err)

    def _index(self, tree, scope):
        base, at = self.compile(tree.base, scope), self.compile(tree.index, scope)
        if at.kind == "string" and at.literal is not ...:
            return self.field(base, at.literal)
        err = failing(base.err, at.err)
        if base.kind == "array" and at.kind == "number":
            v = event_value(F.get(base.col, at.col.cast("int")), base.type.elementType)
            return Value(v.col, v.type, err)
        if base.kind == "variant" and isinstance(at.literal, int):
            return Value(F.try_variant_get(base.col, f"$[{at.literal}]", "variant"), VARIANT, err)
        if isinstance(base.type, T.MapType) and at.kind == "string":
            v = event_value(F.try_element_at(base.col, at.col), base.type.valueType)
            return Value(v.col, v.type, err)
        return Value(F.lit(None), NULL, err)

    def _unary(self, tree, scope):
        v = self.compile(tree.operand, scope)
        if tree.op == "-":
            v = narrowed(v, "number")
            return Value(-v.col, v.type, v.err) if v.kind == "number" else Value(F.lit(None), NULL, v.err)
        v = narrowed(v, "boolean")
        return Value(~v.col, BOOL, v.err) if v.kind == "boolean" else Value(F.lit(None), NULL, v.err)

    def _binary(self, tree, scope):
        if tree.op in ("and", "or"):
            return self.logical(tree, scope)
        a, b = self.compile(tree.left, scope), self.compile(tree.right, scope)
        err = failing(a.err, b.err)
        if tree.op in ("==", "!="):
            same = equal(a, b)
            return Value(same if tree.op == "==" else ~same, BOOL, err)
        if a.kind == "variant" or b.kind == "variant":
            kind = next((v.kind for v in (a, b) if v.kind in ("number", "string", "boolean")), "number")
            a, b = narrowed(a, kind), narrowed(b, kind)
        if tree.op in ("<", ">", "<=", ">="):
            if "null" in (a.kind, b.kind):
                return Value(F.lit(None).cast("boolean"), BOOL, err)
            if a.kind != b.kind or a.kind not in ("number", "string", "boolean"):
                raise ExpressionError(f"can't compare {a.type.simpleString()} with {b.type.simpleString()}")
            ops = {"<": a.col < b.col, ">": a.col > b.col, "<=": a.col <= b.col, ">=": a.col >= b.col}
            return Value(ops[tree.op], BOOL, err)
        if "null" in (a.kind, b.kind):
            return Value(F.lit(None), NULL, err)
        if tree.op == "+" and a.kind == b.kind == "string":
            return Value(F.concat(a.col, b.col), STRING, err)
        if a.kind != "number" or b.kind != "number":
            raise ExpressionError(f"can't apply {tree.op} to {a.type.simpleString()} and {b.type.simpleString()}")
        whole = isinstance(a.type, T.LongType) and isinstance(b.type, T.LongType)
        t = LONG if whole else DOUBLE
        x, y = (a.col, b.col) if whole else (a.col.cast(DOUBLE), b.col.cast(DOUBLE))
        if tree.op == "/":
            return Value(F.try_divide(a.col.cast(DOUBLE), b.col.cast(DOUBLE)), DOUBLE, err if b.literal not in (..., 0, 0.0) else failing(err, fail_if(b.col == 0, "division by zero")))
        if tree.op == "%":
            return Value(F.try_mod(x, y), t, err if b.literal not in (..., 0, 0.0) else failing(err, fail_if(b.col == 0, "division by zero")))
        tried = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[tree.op](x, y)
        if not whole:
            return Value(tried, t, err)
        # whole numbers beyond a long saturate, as they do through double
        wide = {"+": x.cast(DOUBLE) + y.cast(DOUBLE), "-": x.cast(DOUBLE) - y.cast(DOUBLE), "*": x.cast(DOUBLE) * y.cast(DOUBLE)}[tree.op]
        edge = F.when(wide > 0, F.lit(2**63 - 1)).when(wide < 0, F.lit(-(2**63)))
        return Value(F.coalesce(tried, edge), t, err)

    def logical(self, tree, scope):
        """Null counts as false; the right side matters, failures too, only where the left one doesn't decide."""
        a, b = (expect(self.compile(t, scope), tree.op, "boolean") for t in (tree.left, tree.right))
        x, y = F.coalesce(a.col.cast(BOOL), F.lit(False)), F.coalesce(b.col.cast(BOOL), F.lit(False))
        needed = x if tree.op == "and" else ~x
        late = None if b.err is None else F.when(needed, b.err)
        return Value(x & y if tree.op == "and" else x | y, BOOL, failing(a.err, late))

    def _record(self, tree, scope):
        values: dict[str, Value] = {}
        for k, node in tree.pairs:
            values[k] = self.compile(node, scope)
        t = T.StructType([T.StructField(k, v.type) for k, v in values.items()])
        col = F.struct(*[v.col.alias(k) for k, v in values.items()]) if values else F.expr("named_struct()")
        return Value(col, t, failing(*(v.err for v in values.values())))

    def _case(self, tree, scope):
        whens = [(expect(self.compile(c, scope), "case", "boolean"), self.compile(r, scope)) for c, r in tree.whens]
        default = self.compile(tree.default, scope)
        t = default.type
        for _, r in reversed(whens):
            t = unified(r.type, t)
        value, err = None, None
        may_fail = default.err is not None or any(v.err is not None for pair in whens for v in pair)
        for c, r in whens:
            test = F.coalesce(c.col.cast(BOOL), F.lit(False))
            value = (F if value is None else value).when(test, converted(r.col, r.type, t))
            if may_fail:
                step = F.coalesce(c.err, F.lit("")) if c.err is not None else F.lit("")
                own = r.err if r.err is not None else F.lit(None).cast(STRING)
                err = F if err is None else err
                if c.err is not None:
                    err = err.when(step != "", step)
                err = err.when(test, own)
        value = value.otherwise(converted(default.col, default.type, t))
        if may_fail:
            err = err.otherwise(default.err if default.err is not None else F.lit(None).cast(STRING))
        return Value(value, t, err if may_fail else None)

    def predicate(self, tree) -> tuple[Column, Column | None]:
        """A condition as a WHERE sees it, where null drops a row anyway: plain comparisons that reach the scan."""
        if isinstance(tree, S.Binary) and tree.op in ("and", "or"):
            (x, e), (y, f) = self.predicate(tree.left), self.predicate(tree.right)
            if e is None and f is None:
                return (x & y if tree.op == "and" else x | y), None
        elif isinstance(tree, S.Binary) and tree.op == "==":
            a, b = self.compile(tree.left), self.compile(tree.right)
            if a.literal is not ...:
                a, b = b, a
            if a.kind == b.kind and a.err is None and b.literal not in (..., None):
                if isinstance(a.type, T.DoubleType) or isinstance(b.literal, float):
                    return a.col.between(b.literal - TOLERANCE, b.literal + TOLERANCE), None
                if a.kind in ("number", "string", "boolean"):
                    return a.col == b.col, None
        v = expect(self.compile(tree), "a condition", "boolean")
        return v.col.cast(BOOL), v.err

    def _call(self, tree, scope):
        if tree.name not in self.functions:
            raise ExpressionError(f"unknown function {tree.name}")
        return self.functions[tree.name](self, tree.args, scope)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def equal(a: Value, b: Value) -> Column:
    """Total equality: null equals null, numbers within the tolerance, different kinds differ."""
    if a.kind == "variant" and b.kind == "variant":
        return F.to_json(a.col).eqNullSafe(F.to_json(b.col))
    if a.kind == "variant" or b.kind == "variant":
        v, w = (a, b) if a.kind == "variant" else (b, a)
        if w.kind == "null":
            return v.col.isNull() | F.is_variant_null(v.col)
        if w.kind not in ("number", "string", "boolean"):
            return F.to_json(v.col).eqNullSafe(F.to_json(w.col))
        numeric = F.schema_of_variant(v.col).isin("BIGINT", "DOUBLE", "FLOAT") | F.schema_of_variant(v.col).startswith("DECIMAL")
        own = {"number": numeric, "string": F.schema_of_variant(v.col) == "STRING", "boolean": F.schema_of_variant(v.col) == "BOOLEAN"}[w.kind]
        n = narrowed(v, w.kind)
        return F.coalesce(own & equal(n, w), F.lit(False))
    if a.kind == "null" or b.kind == "null":
        return F.lit(True) if a.kind == b.kind else (a if b.kind == "null" else b).col.isNull()
    if a.kind != b.kind:
        return a.col.isNull() & b.col.isNull()
    if a.kind == "number":
        near = F.abs(a.col.cast(DOUBLE) - b.col.cast(DOUBLE)) <= TOLERANCE
        if isinstance(a.type, T.LongType) and isinstance(b.type, T.LongType):
            return a.col.eqNullSafe(b.col)
        return F.when(a.col.isNull() & b.col.isNull(), True).when(a.col.isNull() | b.col.isNull(), False).otherwise(near)
    if a.kind in ("array", "record"):
        t = unified(a.type, b.type)
        return F.to_json(as_type(a, t).col).eqNullSafe(F.to_json(as_type(b, t).col))
    return a.col.eqNullSafe(b.col)


def compile_expression(text: str, source: DataFrame | T.StructType, functions=None) -> Value:
    """An expression over a DataFrame's (or schema's) columns."""
    schema = source.schema if isinstance(source, DataFrame) else source
    return Compiler(schema, functions).compile(S.parse(text))


def compile_path(text: str, source: DataFrame | T.StructType) -> Value:
    """A path such as ``$.a["b"][0]``, as used for message keys and templates."""
    tree = S.parse(text)
    node = tree
    while isinstance(node, (S.Field, S.Index)):
        node = node.base
    if not isinstance(node, S.Root):
        raise ExpressionError(f"not a path: {text}")
    return Compiler(source.schema if isinstance(source, DataFrame) else source).compile(tree)


def compile_template(text: str, source: DataFrame | T.StructType) -> Column:
    """Text with ``{{ $.path }}`` placeholders; null paths leave the word null."""
    import re

    from .values import text_of

    parts = re.split(r"\{\{\s*(.*?)\s*\}\}", text)
    cols = [F.lit(p) if i % 2 == 0 else F.coalesce(text_of(compile_path(p, source)).cast(STRING), F.lit("null")) for i, p in enumerate(parts)]
    return F.concat(*cols)
