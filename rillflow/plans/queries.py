"""Registered queries over the driver's tables, one or more per operator and function, with their DuckDB SQL.

All run on whole tables. Results are plain columns, so that both engines' values compare as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.base import Result
from ..operators.core import assertion, evaluate, keep, noop
from ..operators.parser import parse
from ..sources.encodings import decode, encode, read_files, write_files
from ..sources.inputs import read
from ..sources.kept import shared_path
from ..sources.outputs import write
from .dag import Dag, execute, plan
from .flow import Flow
from .sql import run_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, oracle: str | None = None):
    def register(build: Query) -> Query:
        QUERIES[name] = build
        if oracle:
            ORACLES[name] = oracle
        return build

    return register


def evals(name: str, source: str, expression: str, oracle: str) -> None:
    """An ``eval`` node over a table."""
    query(name, oracle)(lambda spark, d: evaluate(table(spark, d, source), expression).output)


def sqls(name: str, statement: str, oracle: str | None = None, *, records: str | None = None) -> None:
    """A statement of the SQL dialect; the same text is the oracle where DuckDB reads it alike."""

    def build(spark: SparkSession, d: str) -> DataFrame:
        names = [n for n in TABLES if n in statement.lower()]
        tables = {n: table(spark, d, n) for n in names}
        if records:
            tables |= dict.fromkeys(("records", "events"), table(spark, d, records))
        return run_sql(statement, tables, spark)

    query(name, oracle or statement)(build)


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

# --- pipeline nodes -------------------------------------------------------------------------------

query("node_noop", "SELECT r_regionkey, r_name FROM region")(lambda s, d: noop(table(s, d, "region")).output)
query("node_filter", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")(
    lambda s, d: keep(table(s, d, "lineitem"), '$.l_quantity > 45 and $.l_returnflag == "R"').output.select("l_orderkey", "l_linenumber", "l_quantity")
)
query("node_filter_failure_is_no", "SELECT p_partkey FROM part WHERE p_size <> 10 AND 100.0 / (p_size - 10) > 10")(
    lambda s, d: keep(table(s, d, "part"), "100 / ($.p_size - 10) > 10").output.select("p_partkey")
)
query("node_assertion", "SELECT o_orderkey FROM orders WHERE o_totalprice < 300000")(
    lambda s, d: assertion(table(s, d, "orders"), "$.o_totalprice < 300000").output.select("o_orderkey")
)
query("node_assertion_errors", "SELECT count(*) AS n FROM orders WHERE NOT o_totalprice < 300000")(
    lambda s, d: assertion(table(s, d, "orders"), "$.o_totalprice < 300000").errors.agg(F.count(F.lit(1)).alias("n"))
)
evals("node_eval_record", "customer", "dict(key=$.c_custkey, name=lower($.c_name), rich=$.c_acctbal > 5000)", "SELECT c_custkey AS key, lower(c_name) AS name, c_acctbal > 5000 AS rich FROM customer")
evals("node_eval_array", "orders", 'arr_foreach(range(2), i, dict(o=$.o_orderkey, i=i, price=$.o_totalprice * (i + 1)))', "SELECT o_orderkey AS o, i, o_totalprice * (i + 1) AS price FROM orders, (SELECT unnest(range(0, 2)) AS i)")
evals("node_eval_null_drops", "part", 'case($.p_size > 25 => dict(p=$.p_partkey), _ => null)', "SELECT p_partkey AS p FROM part WHERE p_size > 25")
query("node_eval_errors", "SELECT count(*) AS n FROM part WHERE p_size = 7")(
    lambda s, d: evaluate(table(s, d, "part"), "dict(x=1 / ($.p_size - 7))").errors.agg(F.count(F.lit(1)).alias("n"))
)
query("node_eval_lenient", "SELECT p_partkey AS p, '>>> Failed to evaluate expression: unknown function no_such' AS bad FROM part")(
    lambda s, d: evaluate(table(s, d, "part"), "dict(p=$.p_partkey, bad=no_such(1))", lenient=True).output
)


@query("node_sqleval", "SELECT o_orderpriority AS p, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY o_orderpriority")
def node_sqleval(spark, d):
    return Flow.start().sql("select o_orderpriority as p, count(*) as n, sum(o_totalprice) as total from records group by o_orderpriority").result(table(spark, d, "orders"))


@query("dag_fan_out_merge", "SELECT n_nationkey::BIGINT AS num, CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS type FROM nation UNION ALL SELECT n_nationkey::BIGINT, 'all' FROM nation")
def dag_fan_out_merge(spark, d):
    even = Flow.start().filter("$.n_nationkey % 2 == 0").eval("dict(type='even', num=$.n_nationkey)")
    odd = Flow.start().filter("$.n_nationkey % 2 == 1").eval("dict(type='odd', num=$.n_nationkey)")
    every = Flow.start().eval("dict(type='all', num=$.n_nationkey)")
    return Flow.merge(even, odd, every).result(table(spark, d, "nation"))


@query("dag_merge_sql_per_path", "SELECT count(*) AS c FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT count(*) FROM nation WHERE n_nationkey % 3 = 0")
def dag_merge_sql_per_path(spark, d):
    definition = {
        "dag": [
            {"id": "src", "commandName": "filesource", "config": {"filePath": f"{d}/nation.parquet", "encodingType": "TEXT"}, "outputs": ["a", "b"]},
            {"id": "a", "commandName": "filter", "config": {"expression": "$.n_nationkey % 2 == 0"}, "outputs": ["q"]},
            {"id": "b", "commandName": "eval", "config": {"expression": "case($.n_nationkey % 3 == 0 => dict(n_nationkey=$.n_nationkey), _ => null)"}, "outputs": ["q"]},
            {"id": "q", "commandName": "sqleval", "config": {"sql": "select count(*) as c from events"}, "outputs": []},
        ]
    }
    return plan(spark, Dag.from_dict(definition), inputs={"src": table(spark, d, "nation")}).outputs["q"]


@query("dag_error_output", "SELECT 'e' AS nodeId, 'src' AS upstreamId, 'division by zero' AS errorMessage, count(*) AS n FROM part WHERE p_size = 5")
def dag_error_output(spark, d):
    definition = {"dag": [{"id": "src", "commandName": "stdin", "config": {"encodingType": "TEXT"}, "outputs": ["e"]}, {"id": "e", "commandName": "eval", "config": {"expression": "dict(x=10 / ($.p_size - 5))"}}]}
    run = plan(spark, Dag.from_dict(definition), inputs={"src": table(spark, d, "part")})
    return run.all_errors().groupBy("nodeId", "upstreamId", "errorMessage").agg(F.count(F.lit(1)).alias("n"))


# --- expression operators -------------------------------------------------------------------------

evals("expr_logical", "lineitem", "dict(k=$.l_orderkey, n=$.l_linenumber, a=$.l_quantity > 25 and $.l_tax > 0.02, o=$.l_quantity > 45 or null, x=not ($.l_tax > 0.02))", "SELECT l_orderkey AS k, l_linenumber::BIGINT AS n, l_quantity > 25 AND l_tax > 0.02 AS a, l_quantity > 45 AS o, NOT (l_tax > 0.02) AS x FROM lineitem")
evals("expr_equality", "lineitem", "dict(k=$.l_orderkey, n=$.l_linenumber, e=$.l_discount == 0.05, d=$.l_linenumber != 3, s=$.l_returnflag == 'A', m=$.l_returnflag == 1, z=$.nope == null)", "SELECT l_orderkey AS k, l_linenumber::BIGINT AS n, abs(l_discount - 0.05) <= 1e-6 AS e, l_linenumber <> 3 AS d, l_returnflag = 'A' AS s, false AS m, true AS z FROM lineitem")
evals("expr_compare", "customer", "dict(k=$.c_custkey, lt=$.c_nationkey < 10, le=$.c_nationkey <= 10, gt=$.c_acctbal > 0, ge=$.c_name >= 'Customer#000000100')", "SELECT c_custkey AS k, c_nationkey < 10 AS lt, c_nationkey <= 10 AS le, c_acctbal > 0 AS gt, c_name >= 'Customer#000000100' AS ge FROM customer")
evals("expr_arithmetic", "lineitem", "dict(k=$.l_orderkey, n=$.l_linenumber, p=$.l_extendedprice * (1 - $.l_discount) * (1 + $.l_tax), q=$.l_linenumber / 2, r=$.l_orderkey % 7, i=$.l_linenumber * 3 - 1, s=$.l_returnflag + $.l_linestatus, u=-$.l_linenumber)", "SELECT l_orderkey AS k, l_linenumber::BIGINT AS n, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS p, l_linenumber / 2.0::DOUBLE AS q, l_orderkey % 7 AS r, (l_linenumber * 3 - 1)::BIGINT AS i, l_returnflag || l_linestatus AS s, (-l_linenumber)::BIGINT AS u FROM lineitem")
evals("expr_case", "part", 'dict(k=$.p_partkey, size=case($.p_size < 10 => "s", $.p_size < 30 => "m", _ => "l"))', "SELECT p_partkey AS k, CASE WHEN p_size < 10 THEN 's' WHEN p_size < 30 THEN 'm' ELSE 'l' END AS size FROM part")
evals("expr_paths", "embeddings", 'dict(k=$.vec_id, first=$.embedding[0], third=$["embedding"][1 + 1], past=$.embedding[100000] == null, none=$.label.x == null)', "SELECT vec_id AS k, embedding[1]::DOUBLE AS first, embedding[3]::DOUBLE AS third, true AS past, true AS none FROM embeddings")
evals("expr_dict_nested", "supplier", 'dict(a=dict(x=$.s_suppkey, y=dict(z=$.s_name))["y"].z, "b.c"=$.s_nationkey, d::e=1.5)', "SELECT s_name AS a, s_nationkey::BIGINT AS \"b.c\", 1.5::DOUBLE AS \"d::e\" FROM supplier")
evals("expr_literals", "region", r'''dict(k=$.r_regionkey, i=42, f=.5, s="a\"b\n", t=true, n=coalesce(null, 'x'))''', "SELECT r_regionkey::BIGINT AS k, 42::BIGINT AS i, 0.5::DOUBLE AS f, 'a\"b' || chr(10) AS s, true AS t, 'x' AS n FROM region")
query("expr_dynamic_variant", """SELECT (props::JSON->>'k')::DOUBLE AS k, (props::JSON->>'k')::DOUBLE > 50 AS big, event_id AS id FROM events""")(
    lambda s, d: evaluate(table(s, d, "events").select(F.to_variant_object(F.struct("event_id", F.parse_json("props").alias("props"))).alias("event")), "dict(k=$.props.k * 1.0, big=$.props.k > 50, id=floor($.event_id + 0))").output
)

# --- expression functions -------------------------------------------------------------------------

evals("fn_ts_str_to_epoch", "orders", 'dict(k=$.o_orderkey, ms=ts_str_to_epoch(epoch_to_ts_str($.o_orderdate, "yyyy-MM-dd HH:mm:ss"), "yyyy-MM-dd HH:mm:ss"))', "SELECT o_orderkey AS k, epoch_ms(o_orderdate) AS ms FROM orders")
evals("fn_epoch_to_ts_str", "events", 'dict(k=$.event_id, t=epoch_to_ts_str($.ts, "yyyy/MM/dd HH:mm:ss.SSS"))', "SELECT event_id AS k, strftime(date_trunc('millisecond', ts), '%Y/%m/%d %H:%M:%S.%g') AS t FROM events")
evals("fn_duration_str_to_mills", "part", 'dict(k=$.p_partkey, ms=duration_str_to_mills(concat(to_str($.p_size), ":05:30")))', "SELECT p_partkey AS k, (p_size * 3600 + 330)::BIGINT * 1000 AS ms FROM part")
evals("fn_now", "region", "dict(k=$.r_regionkey, later=now() > 1600000000000)", "SELECT r_regionkey::BIGINT AS k, true AS later FROM region")
evals("fn_date_component_eq_any", "orders", 'dict(k=$.o_orderkey, y=date_component_eq_any($.o_orderdate, "year", 1997), m=date_component_eq_any($.o_orderdate, "month", 5), w=date_component_eq_any($.o_orderdate, "week", 20), u=date_component_eq_any($.o_orderdate, "era", 1))', "SELECT o_orderkey AS k, year(o_orderdate) = 1997 AS y, month(o_orderdate) = 5 AS m, week(o_orderdate) = 20 AS w, false AS u FROM orders")
evals("fn_str_contains", "part", 'dict(k=$.p_partkey, c=str_contains($.p_name, "ring"), n=str_contains($.nope, "x"))', "SELECT p_partkey AS k, contains(p_name, 'ring') AS c, false AS n FROM part")
evals("fn_str_split", "part", 'dict(k=$.p_partkey, first=str_split($.p_name, " ")[0], n=size_of(str_split($.p_name, "i")))', "SELECT p_partkey AS k, split_part(p_name, ' ', 1) AS first, len(string_split(p_name, 'i'))::BIGINT AS n FROM part")
evals("fn_str_replace", "part", 'dict(k=$.p_partkey, r=str_replace($.p_name, "r", "RR"))', "SELECT p_partkey AS k, replace(p_name, 'r', 'RR') AS r FROM part")
evals("fn_substr", "customer", "dict(k=$.c_custkey, a=substr($.c_name, 0, 4), b=substr($.c_name, -3), c=substr($.c_name, 100), d=substr($.c_name, 9, 2))", "SELECT c_custkey AS k, c_name[1:4] AS a, right(c_name, 3) AS b, '' AS c, substr(c_name, 10, 2) AS d FROM customer")
evals("fn_upper_lower", "customer", "dict(k=$.c_custkey, u=upper($.c_name), l=lower($.c_mktsegment))", "SELECT c_custkey AS k, upper(c_name) AS u, lower(c_mktsegment) AS l FROM customer")
evals("fn_concat", "nation", 'dict(c=concat($.n_name, "-", $.n_regionkey, null), z=concat(null, null) == null)', "SELECT n_name || '-' || n_regionkey AS c, true AS z FROM nation")
evals("fn_to_str", "nation", "dict(k=to_str($.n_nationkey), b=to_str($.n_nationkey > 3))", "SELECT n_nationkey::VARCHAR AS k, (n_nationkey > 3)::VARCHAR AS b FROM nation")
evals("fn_parse_int", "customer", 'dict(k=$.c_custkey, i=parse_int(substr($.c_name, 9)), h=parse_int("ff", 16), o=parse_int("-17", 8))', "SELECT c_custkey AS k, substr(c_name, 10)::BIGINT AS i, 255::BIGINT AS h, -15::BIGINT AS o FROM customer")
evals("fn_parse_float", "part", 'dict(k=$.p_partkey, f=parse_float(concat($.p_size, ".25 kg")), c=parse_float("1,234.5"))', "SELECT p_partkey AS k, p_size + 0.25::DOUBLE AS f, 1234.5::DOUBLE AS c FROM part")
evals("fn_regex_match", "part", 'dict(k=$.p_partkey, full=regex_match($.p_name, "red .*"), half=regex_match($.p_name, "red"))', "SELECT p_partkey AS k, regexp_full_match(p_name, 'red .*') AS full, regexp_full_match(p_name, 'red') AS half FROM part")
evals("fn_regex_match_any", "part", 'dict(k=$.p_partkey, m=regex_match_any(array($.p_name, array($.p_brand)[0]), "Brand#1.*"))', "SELECT p_partkey AS k, regexp_full_match(p_brand, 'Brand#1.*') OR regexp_full_match(p_name, 'Brand#1.*') AS m FROM part")
evals("fn_regex_search_any", "part", 'dict(k=$.p_partkey, m=regex_search_any(str_split($.p_name, " "), "^w"))', "SELECT p_partkey AS k, len(list_filter(string_split(p_name, ' '), lambda x: x[1] = 'w')) > 0 AS m FROM part")
evals("fn_num_compare_any", "part", 'dict(k=$.p_partkey, m=num_compare_any(array(to_str($.p_size), "x", "3"), "gte", 45), n=num_compare_any($.p_retailprice, "lt", 950))', "SELECT p_partkey AS k, p_size >= 45 AS m, p_retailprice < 950 AS n FROM part")
evals("fn_grok", "customer", 'dict(k=$.c_custkey, w=grok($.c_name, "%{WORD:kind}#%{INT:num}").kind, n=grok($.c_name, "%{WORD:kind}#%{INT:num}").num)', "SELECT c_custkey AS k, split_part(c_name, '#', 1) AS w, split_part(c_name, '#', 2) AS n FROM customer")
evals("fn_cidr_match", "part", 'dict(k=$.p_partkey, m=cidr_match(concat("10.0.", $.p_size, ".7"), "10.0.0.0/20"), a=cidr_match(array("1.2.3.4", concat("192.168.", $.p_size, ".1")), "192.168.16.0/22"), six=cidr_match("2001:db8::5", "2001:db8::/64"), bad=cidr_match("nonsense", "10.0.0.0/8"))', "SELECT p_partkey AS k, p_size < 16 AS m, p_size BETWEEN 16 AND 19 AS a, true AS six, false AS bad FROM part")
evals("fn_deep_contains", "part", 'dict(k=$.p_partkey, m=deep_contains($, "BRAND#17"), n=deep_contains(dict(a=array($.p_type), b=dict(c=$.p_size)), "pro"))', "SELECT p_partkey AS k, lower(p_brand) LIKE '%brand#17%' AS m, lower(p_type) LIKE '%pro%' AS n FROM part")
evals("fn_size_of", "embeddings", 'dict(k=$.vec_id, a=size_of($.embedding), s=size_of("abc"), d=size_of(dict(a=1, b=2)))', "SELECT vec_id AS k, len(embedding)::BIGINT AS a, 3::BIGINT AS s, 2::BIGINT AS d FROM embeddings")
evals("fn_array_range", "nation", "dict(k=$.n_nationkey, a=array($.n_regionkey, 7)[1], n=size_of(range($.n_nationkey)), last=range(0, 10, 3)[3], down=range(5, 0, -2)[2])", "SELECT n_nationkey::BIGINT AS k, 7::BIGINT AS a, n_nationkey::BIGINT AS n, 9::BIGINT AS last, 1::BIGINT AS down FROM nation")
evals("fn_arr_flatten", "part", 'dict(k=$.p_partkey, n=size_of(arr_flatten(array(str_split($.p_name, " "), array("x")))))', "SELECT p_partkey AS k, len(string_split(p_name, ' '))::BIGINT + 1 AS n FROM part")
evals("fn_arr_foreach", "embeddings", "dict(k=$.vec_id, x=arr_foreach($.embedding, e, e * 2)[1], n=size_of(arr_foreach(array(1, 0, 2), e, 4 / e)))", "SELECT vec_id AS k, embedding[2]::DOUBLE * 2 AS x, 2::BIGINT AS n FROM embeddings")
evals("fn_arr_filter", "embeddings", "dict(k=$.vec_id, n=size_of(arr_filter($.embedding, e, e > 0.1)))", "SELECT vec_id AS k, len(list_filter(embedding, lambda x: x::DOUBLE > 0.1))::BIGINT AS n FROM embeddings")
evals("fn_arr_find", "embeddings", "dict(k=$.vec_id, x=arr_find($.embedding, e, e > 0.2))", "SELECT vec_id AS k, list_filter(embedding, lambda x: x::DOUBLE > 0.2)[1]::DOUBLE AS x FROM embeddings")
evals("fn_arr_to_dict", "part", 'dict(k=$.p_partkey, n=arr_to_dict(array(dict(n="a", v=$.p_size), dict(n="b", v=2), dict(n="a", v=9)), x, x.n, x.v)["a"])', "SELECT p_partkey AS k, 9::BIGINT AS n FROM part")
evals("fn_dict_merge", "nation", 'dict_merge(dict(k=$.n_nationkey, a=1, b="x"), null, dict(b="y", c=$.n_name))', "SELECT n_nationkey::BIGINT AS k, 1::BIGINT AS a, 'y' AS b, n_name AS c FROM nation")
evals("fn_dict_remove", "nation", 'dict_remove($, "n_name", "nope")', "SELECT n_nationkey::BIGINT AS n_nationkey, n_regionkey::BIGINT AS n_regionkey FROM nation")
evals("fn_dict_remove_values", "nation", 'dict(k=$.n_nationkey, r=exists(dict_remove_values(dict(a=$.n_regionkey, b=7), 1, 7).a))', "SELECT n_nationkey::BIGINT AS k, n_regionkey <> 1 AS r FROM nation")
evals("fn_dict_set", "nation", 'dict_set(dict(k=$.n_nationkey), "name", lower($.n_name), "k", $.n_nationkey + 1)', "SELECT (n_nationkey + 1)::BIGINT AS k, lower(n_name) AS name FROM nation")
evals("fn_floor_ceil", "customer", "dict(k=$.c_custkey, f=floor($.c_acctbal), c=ceil($.c_acctbal))", "SELECT c_custkey AS k, floor(c_acctbal)::BIGINT AS f, ceil(c_acctbal)::BIGINT AS c FROM customer")
evals("fn_random_long", "region", "dict(k=$.r_regionkey, r=random_long() != random_long())", "SELECT r_regionkey::BIGINT AS k, true AS r FROM region")
evals("fn_in", "nation", 'dict(k=$.n_nationkey, a=in($.n_regionkey, array(1, 3)), b=in($.n_name, array("NATION_3")), c=in(null, array(1)))', "SELECT n_nationkey::BIGINT AS k, n_regionkey IN (1, 3) AS a, n_name = 'NATION_3' AS b, false AS c FROM nation")
evals("fn_exists", "nation", "dict(k=$.n_nationkey, a=exists($.n_name), b=exists($.nope), c=exists(array(1, 2)[1]), d=exists(array(1, 2)[2]))", "SELECT n_nationkey::BIGINT AS k, true AS a, false AS b, true AS c, false AS d FROM nation")
evals("fn_coalesce", "nation", 'dict(k=coalesce($.nope, null, $.n_name))', "SELECT n_name AS k FROM nation")
query("fn_python", "SELECT n_nationkey::BIGINT AS k, n_name || '/' || (n_regionkey * 2) AS p FROM nation")(
    lambda s, d: evaluate(table(s, d, "nation"), """dict(k=$.n_nationkey, p=python("def f(a, b):\\n    return a + '/' + str(b * 2)", $.n_name, $.n_regionkey))""").output.select("k", F.try_variant_get("p", "$", "string").alias("p"))
)

# --- SQL: relations -------------------------------------------------------------------------------

sqls("sql_project_extend_rename", "select c_custkey as k, c_name, c_acctbal * 2 as twice from customer where c_mktsegment = 'BUILDING'")
sqls("sql_star", "select * from nation", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
sqls("sql_empty_from", "select 1 + 1 as two, 'x' as t", "SELECT 2::BIGINT AS two, 'x' AS t")
sqls("sql_cross_product", "select a.r_name as a, b.r_name as b from region a, region b")
sqls("sql_comma_join", "select n.n_name, r.r_name from nation n, region r where n.n_regionkey = r.r_regionkey")
sqls("sql_join_three", "select c.c_custkey, o.o_orderkey, n.n_name from customer c, orders o, nation n where c.c_custkey = o.o_custkey and c.c_nationkey = n.n_nationkey and o.o_totalprice > 400000")
sqls("sql_explicit_joins", "select c.c_custkey, o.o_orderkey from customer c left join orders o on c.c_custkey = o.o_custkey and o.o_totalprice > 450000")
sqls("sql_lateral_function", "select e.vec_id as v, count(x) as n, sum(x) as s from embeddings e, json_array_elements(e.embedding) x group by e.vec_id", "SELECT vec_id AS v, count(*) AS n, sum(x::DOUBLE) AS s FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY vec_id")
sqls("sql_select_list_function", "select p_partkey as k, json_array_elements(regexp_split_to_array(p_name, ' ')) as w from part", "SELECT p_partkey AS k, unnest(string_split(p_name, ' ')) AS w FROM part")
sqls("sql_lateral_zip", "select p_partkey as k, json_array_elements(regexp_split_to_array(p_name, ' ')) as w, json_array_elements(regexp_split_to_array('1,2,3', ',')) as n from part", "SELECT p_partkey AS k, string_split(p_name, ' ')[i] AS w, ['1', '2', '3'][i] AS n FROM part, (SELECT unnest(range(1, 4)) AS i)")
sqls("sql_lateral_subselect", "select e.vec_id as v, t.top from embeddings e, lateral (select max(x) as top from json_array_elements(e.embedding) x) t", "SELECT vec_id AS v, list_max(embedding)::DOUBLE AS top FROM embeddings")
sqls("sql_regexp_split_to_table", "select count(*) as n from part, regexp_split_to_table(p_name, ' ')", "SELECT sum(len(string_split(p_name, ' ')))::BIGINT AS n FROM part")
sqls("sql_json_each_text", "select x.key as k, count(*) as n, max(x.value) as top from orders o, json_each_text(json_build_object('s', o.o_orderstatus, 'p', o.o_orderpriority)) x group by x.key", "SELECT 's' AS k, count(*) AS n, max(o_orderstatus) AS top FROM orders UNION ALL SELECT 'p', count(*), max(o_orderpriority) FROM orders")
sqls("sql_derived_table", "select x.n_regionkey as r, x.n from (select n_regionkey, count(*) as n from nation group by n_regionkey) x where x.n > 4", "SELECT n_regionkey::BIGINT AS r, count(*) AS n FROM nation GROUP BY n_regionkey HAVING count(*) > 4")
sqls("sql_group_by", "select l_returnflag, l_linestatus, count(*) as n, sum(l_quantity) as q, min(l_tax) as lo, max(l_extendedprice) as hi from lineitem group by l_returnflag, l_linestatus")
sqls("sql_group_by_expression", "select upper(l_returnflag) as f, sum(l_linenumber) as n from lineitem group by upper(l_returnflag)", "SELECT upper(l_returnflag) AS f, sum(l_linenumber)::BIGINT AS n FROM lineitem GROUP BY 1")
sqls("sql_group_by_constant", "select count(*) as n from orders group by 1", "SELECT count(*) AS n FROM orders")
sqls("sql_implicit_group", "select count(*) as n, sum(o_totalprice) as s from orders")
sqls("sql_implicit_group_empty", "select count(*) as n from orders where o_totalprice < 0", "SELECT count(*) AS n FROM orders WHERE false GROUP BY o_orderkey")
sqls("sql_aggregate_distinct", "select o_orderpriority as p, count(distinct o_custkey) as c, sum(distinct o_custkey) as s from orders group by o_orderpriority", "SELECT o_orderpriority AS p, count(DISTINCT o_custkey) AS c, sum(DISTINCT o_custkey)::BIGINT AS s FROM orders GROUP BY o_orderpriority")
sqls("sql_avg", "select o_orderpriority as p, avg(o_totalprice) as a from orders group by o_orderpriority")
sqls("sql_string_agg", "select n_regionkey as r, length(string_agg(n_name, '; ')) as n from nation group by n_regionkey", "SELECT n_regionkey::BIGINT AS r, length(string_agg(n_name, '; ')) AS n FROM nation GROUP BY n_regionkey")
sqls("sql_json_agg", "select n_regionkey as r, json_array_length(json_agg(json_build_object('n', n_name))) as n from nation group by n_regionkey", "SELECT n_regionkey::BIGINT AS r, count(*) AS n FROM nation GROUP BY n_regionkey")
sqls("sql_distinct", "select distinct l_returnflag, l_linestatus from lineitem")
sqls("sql_distinct_on", "select distinct on (o_custkey) o_custkey, o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
sqls("sql_order_limit", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
sqls("sql_having", "select c_nationkey as n, count(*) as c from customer group by c_nationkey having count(*) > 60", "SELECT c_nationkey::BIGINT AS n, count(*) AS c FROM customer GROUP BY c_nationkey HAVING count(*) > 60")

# --- SQL: expressions -----------------------------------------------------------------------------

sqls("sql_arithmetic", "select p_partkey as k, p_size + 2.7 as a, 2.5 + p_size as b, p_size / 4 as c, p_size % 7 as d, p_size ^ 2 as e, 7 - p_size * 2 as f from part", "SELECT p_partkey AS k, (p_size + 2)::BIGINT AS a, (2.5::DOUBLE + p_size) AS b, (p_size // 4)::BIGINT AS c, (p_size % 7)::BIGINT AS d, (p_size * p_size)::BIGINT AS e, (7 - p_size * 2)::BIGINT AS f FROM part")
sqls("sql_concat_operator", "select n_name || '-' || n_nationkey as c from nation")
sqls("sql_boolean_logic", "select p_partkey as k from part where p_size > 40 or p_size < 3 and p_retailprice > 950", "SELECT p_partkey AS k FROM part WHERE (p_size > 40 OR p_size < 3) AND p_retailprice > 950")
sqls("sql_not_is_null", "select n_nationkey as k, not null as t, n_name is null as a, n_name is not null as b from nation", "SELECT n_nationkey::BIGINT AS k, true AS t, false AS a, true AS b FROM nation")
sqls("sql_like", "select p_partkey as k from part where p_name like 'red%' or p_name ilike '%WIDGET'")
sqls("sql_not_like_in_between", "select p_partkey as k from part where p_name not like 'red%' and p_size in (1, 2, 3) and p_retailprice between 900 and 960")
sqls("sql_case", "select p_partkey as k, case when p_size < 10 then 'small' when p_size < 30 then 'medium' end as c from part")
sqls("sql_casts", "select n_nationkey as k, n_nationkey::text as t, '12'::int as i, '1.5'::double precision as d, 'yes'::boolean as b, null::int as z, null::boolean as f from nation", "SELECT n_nationkey::BIGINT AS k, n_nationkey::VARCHAR AS t, 12::BIGINT AS i, 1.5::DOUBLE AS d, true AS b, 0::BIGINT AS z, false AS f FROM nation")
sqls("sql_json_get", "select event_id as k, props->>'k' as s, (props->'k')::int as i, props->'nope' is null as n from events", "SELECT event_id AS k, props::JSON->>'k' AS s, (props::JSON->>'k')::BIGINT AS i, true AS n FROM events")
sqls("sql_json_cast", "select event_id as k, props::json->>'k' as s from events", "SELECT event_id AS k, props::JSON->>'k' AS s FROM events")
sqls("sql_case_insensitive", "select N.N_NAME as n from Nation N where n.N_RegionKey = 1", "SELECT n_name AS n FROM nation WHERE n_regionkey = 1")
sqls("sql_auto_names", "select n_nationkey, n_regionkey * 2, upper(n_name) from nation", "SELECT n_nationkey::BIGINT AS n_nationkey, (n_regionkey * 2)::BIGINT AS col_1, upper(n_name) AS col_2 FROM nation")

# --- SQL: functions -------------------------------------------------------------------------------

sqls("sql_fn_text", "select p_partkey as k, replace(p_name, 'r', 'x') as a, upper(p_name) as b, lower(p_brand) as c, reverse(p_name) as d, length(p_name) as e, char_length(null) as f, left(p_name, 3) as g, right(p_name, 3) as h, substring(p_name, 2, 4) as i, position('i', p_name) as j, concat(p_name, null, p_size) as l from part", "SELECT p_partkey AS k, replace(p_name, 'r', 'x') AS a, upper(p_name) AS b, lower(p_brand) AS c, reverse(p_name) AS d, length(p_name) AS e, 0::BIGINT AS f, left(p_name, 3) AS g, right(p_name, 3) AS h, substr(p_name, 2, 4) AS i, instr(p_name, 'i') AS j, p_name || 'null' || p_size AS l FROM part")
sqls("sql_fn_trims", "select n_name as k, ltrim(concat('  ', n_name)) as a, rtrim(concat(n_name, '  ')) as b, trim(concat(' ', n_name, ' ')) as c, btrim(concat('xy', n_name, 'yx'), 'xy') as d from nation", "SELECT n_name AS k, n_name AS a, n_name AS b, n_name AS c, n_name AS d FROM nation")
sqls("sql_fn_regexp", "select p_partkey as k, split_part(p_name, ' ', 2) as a, regexp_replace(p_name, '[aeiou]', '') as b, json_array_length(regexp_matches(p_name, '[a-z]+')) as c, json_array_length(regexp_split_to_array(p_name, 'i')) as d from part", "SELECT p_partkey AS k, split_part(p_name, ' ', 2) AS a, regexp_replace(p_name, '[aeiou]', '', 'g') AS b, len(regexp_extract_all(p_name, '[a-z]+'))::BIGINT AS c, len(string_split(rtrim(p_name, 'i'), 'i'))::BIGINT AS d FROM part")
sqls("sql_fn_format", "select p_partkey as k, format('%5d|', p_size) as a, concat_ws('-', p_brand, p_type) as b, md5(p_name) as c, to_hex(p_size) as d, to_hex(-1) as e from part", "SELECT p_partkey AS k, lpad(p_size::VARCHAR, 5, ' ') || '|' AS a, p_brand || '-' || p_type AS b, md5(p_name) AS c, lower(hex(p_size)) AS d, 'ffffffff' AS e FROM part")
sqls("sql_fn_grok", "select c_custkey as k, grok('%{WORD:kind}#%{INT:num}', c_name)->>'num' as n from customer", "SELECT c_custkey AS k, split_part(c_name, '#', 2) AS n FROM customer")
sqls("sql_fn_json", "select n_nationkey as k, json_build_object('a', n_name, 'b', n_regionkey)->>'a' as a, json_array_length(regexp_split_to_array('a,b,c', ',')) as n, json_array_length(n_name) as z from nation", "SELECT n_nationkey::BIGINT AS k, n_name AS a, 3::BIGINT AS n, 0::BIGINT AS z FROM nation")
sqls("sql_fn_rounding", "select c_custkey as k, round(c_acctbal) as a, trunc(c_acctbal) as b, ceil(c_acctbal) as c, floor(c_acctbal) as d, abs(c_acctbal) as e, sign(c_acctbal) as f, round(-2.5) as g from customer", "SELECT c_custkey AS k, floor(c_acctbal + 0.5)::BIGINT AS a, floor(c_acctbal)::BIGINT AS b, ceil(c_acctbal) AS c, floor(c_acctbal) AS d, abs(c_acctbal) AS e, sign(c_acctbal)::DOUBLE AS f, -2::BIGINT AS g FROM customer")
sqls("sql_fn_round_digits", "select p_partkey as k, round(p_retailprice, 0) as a, trunc(p_retailprice / 8, 2) as b from part", "SELECT p_partkey AS k, floor(p_retailprice * 1.0::DOUBLE + 0.5) AS a, floor(p_retailprice / 8 * 100.0::DOUBLE) / 100.0::DOUBLE AS b FROM part")
sqls("sql_fn_math", "select p_partkey as k, sqrt(p_size) as a, power(p_size, 2) as b, mod(p_size, 5) as c, gcd(p_size, 12) as d, lcm(p_size, 4) as e from part", "SELECT p_partkey AS k, sqrt(p_size) AS a, (p_size * p_size)::DOUBLE AS b, (p_size % 5)::DOUBLE AS c, gcd(p_size, 12)::BIGINT AS d, lcm(p_size, 4)::BIGINT AS e FROM part")
sqls("sql_fn_logs", "select p_partkey as k, round(ln(p_size) * 1000000) as a, round(log(p_size) * 1000000) as b, round(log10(p_size) * 1000000) as c, round(log2(p_size) * 1000000) as d, round(exp(p_size / 10) * 1000) as e from part", "SELECT p_partkey AS k, floor(ln(p_size) * 1000000 + 0.5)::BIGINT AS a, floor(ln(p_size) * 1000000 + 0.5)::BIGINT AS b, floor(log10(p_size) * 1000000 + 0.5)::BIGINT AS c, floor(log2(p_size) * 1000000 + 0.5)::BIGINT AS d, floor(exp(p_size // 10) * 1000 + 0.5)::BIGINT AS e FROM part")
sqls("sql_fn_trigonometry", "select p_partkey as k, round(sin(p_size) * 1000000) as a, round(cos(p_size) * 1000000) as b, round(tan(p_size) * 1000) as c, round(degrees(p_size) * 1000) as d, round(radians(p_size) * 1000000) as e, round(pi() * 1000) as f, random() < 1 as g from part", "SELECT p_partkey AS k, floor(sin(p_size) * 1000000 + 0.5)::BIGINT AS a, floor(cos(p_size) * 1000000 + 0.5)::BIGINT AS b, floor(tan(p_size) * 1000 + 0.5)::BIGINT AS c, floor(degrees(p_size) * 1000 + 0.5)::BIGINT AS d, floor(radians(p_size) * 1000000 + 0.5)::BIGINT AS e, 3142::BIGINT AS f, true AS g FROM part")
sqls("sql_fn_extensions", "select o_orderkey as k, greatest(o_custkey, 500) as a, least(o_totalprice, 1000.0) as b, date_trunc('month', o_orderdate) = date_trunc('month', to_timestamp('1997-05-03', 'yyyy-MM-dd')) as c from orders", "SELECT o_orderkey AS k, greatest(o_custkey, 500) AS a, least(o_totalprice, 1000.0) AS b, date_trunc('month', o_orderdate) = TIMESTAMP '1997-05-01' AS c FROM orders")

# --- parsers --------------------------------------------------------------------------------------


def parsed(df: DataFrame, config: dict) -> Result:
    return parse(df, {"targetField": "line", "removeTargetField": True} | config)


def part_lines(spark, d, line) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", line.alias("line"))


@query("parser_grok", "SELECT p_partkey, p_name AS name, p_size::VARCHAR AS size, 'Brand' AS brand FROM part")
def parser_grok(spark, d):
    lines = part_lines(spark, d, F.format_string("part [%s] size=%d by %s", "p_name", "p_size", "p_brand"))
    return parsed(lines, {"extractionConfig": {"type": "grok", "grokExpression": r"part \[%{DATA:name}\] size=%{INT:size} by %{WORD:brand}#%{INT}"}}).output


@query("parser_grok_errors", "SELECT count(*) AS n FROM part WHERE p_name NOT LIKE 'red %'")
def parser_grok_errors(spark, d):
    return parsed(part_lines(spark, d, F.col("p_name")), {"extractionConfig": {"type": "grok", "grokExpression": "^red %{WORD:thing}"}}).errors.agg(F.count(F.lit(1)).alias("n"))


@query("parser_json", "SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events")
def parser_json(spark, d):
    lines = table(spark, d, "events").select("event_id", F.col("props").alias("line"))
    return parsed(lines, {"extractionConfig": {"type": "json", "outputFieldName": "p"}}).output.select("event_id", F.try_variant_get("p", "$.k", "long").alias("k"))


@query("parser_delimited_text", "SELECT p_partkey, p_name AS a, 'x;\"' || p_brand AS b, p_size::VARCHAR AS c FROM part")
def parser_delimited(spark, d):
    lines = part_lines(spark, d, F.concat(F.col("p_name"), F.lit(';"x;""'), F.col("p_brand"), F.lit('";'), F.col("p_size")))
    return parsed(lines, {"extractionConfig": {"type": "delimited_text", "delimiter": ";", "columns": ["a", "b", "c"]}}).output


@query("parser_kv_pair", "SELECT p_name AS name, p_brand AS brand, p_size::VARCHAR AS size FROM part")
def parser_kv(spark, d):
    lines = part_lines(spark, d, F.concat(F.lit('name="'), F.col("p_name"), F.lit('" brand='), F.col("p_brand"), F.lit(" size="), F.col("p_size")))
    return parsed(lines, {"extractionConfig": {"type": "kv_pair", "pairSeparator": " ", "kvSeparator": "="}, "fields": ["name", "brand", "size"]}).output


@query("parser_syslog", "SELECT p_partkey, p_size::BIGINT AS priority, 'Oct 11 22:14:15' AS timestamp, 'host' || p_size AS \"deviceId\", 'app' AS \"appName\", p_name AS content FROM part")
def parser_syslog(spark, d):
    lines = part_lines(spark, d, F.format_string("<%d>Oct 11 22:14:15 host%d app: %s", "p_size", "p_size", "p_name"))
    return parsed(lines, {"extractionConfig": {"type": "syslog", "componentList": ["PRIORITY", "TIMESTAMP", "DEVICE", "APP"], "timestampPattern": "MMM dd HH:mm:ss", "messageBodyDelimiter": ":"}}).output


@query("parser_cef", "SELECT 'Acme' AS \"deviceVendor\", p_brand AS name, p_size::VARCHAR AS severity, p_name AS msg, p_type AS kind FROM part")
def parser_cef(spark, d):
    lines = part_lines(spark, d, F.concat(F.lit("CEF:0|Acme|Shop|1.0|100|"), F.col("p_brand"), F.lit("|"), F.col("p_size"), F.lit("|msg="), F.col("p_name"), F.lit(" cs1Label=kind cs1="), F.col("p_type")))
    return parsed(lines, {"extractionConfig": {"type": "cef"}, "fields": ["deviceVendor", "name", "severity", "msg", "kind"]}).output


@query("parser_panw_traffic", "SELECT p_partkey, '2025/01/24' AS \"receiveTime\", p_name AS \"serialNumber\", 'TRAFFIC' AS type, p_brand || ',x' AS subtype FROM part")
def parser_panw(spark, d):
    lines = part_lines(spark, d, F.concat(F.lit("1,2025/01/24,"), F.col("p_name"), F.lit(',TRAFFIC,"'), F.col("p_brand"), F.lit(',x",,,')))
    return parsed(lines, {"extractionConfig": {"type": "panw_traffic"}}).output.select("p_partkey", "receiveTime", "serialNumber", "type", "subtype")


@query("parser_windows_multiline", "SELECT p_size::VARCHAR AS code, p_name AS account FROM part")
def parser_windows(spark, d):
    lines = part_lines(spark, d, F.concat(F.lit("LogName=Security\nEventCode="), F.col("p_size"), F.lit("\n\nSubject:\n\tAccount Name:\t\t"), F.col("p_name"), F.lit("\n")))
    events = parsed(lines, {"extractionConfig": {"type": "windows_multiline", "timestampLocationType": "NO_TIMESTAMP"}}).output
    return evaluate(events, 'dict(code=$.EventCode + "", account=$.Subject["Account Name"] + "")').output


@query("parser_dispatch", "SELECT p_partkey, p_type AS kind, CASE WHEN p_type = 'PROMO' THEN p_name END AS promo, CASE WHEN p_type = 'ECONOMY' THEN p_size::VARCHAR END AS size, CASE WHEN p_type NOT IN ('PROMO', 'ECONOMY') THEN p_name || '/' || p_size END AS other FROM part")
def parser_dispatch(spark, d):
    lines = part_lines(spark, d, F.concat(F.col("p_type"), F.lit(": "), F.col("p_name"), F.lit("/"), F.col("p_size")))
    grok = lambda g: {"targetField": "rest", "removeTargetField": True, "extractionConfig": {"type": "grok", "grokExpression": g}}
    config = {"extractionConfig": {"type": "grok", "grokExpression": "%{WORD:kind}: %{GREEDYDATA:rest}"}, "dispatchConfig": {"dispatchField": "kind", "dispatchMap": {"PROMO": grok("%{DATA:promo}/%{INT}"), "ECONOMY": grok("/%{INT:size}$")}, "defaultConfig": grok("%{GREEDYDATA:other}")}}
    return parsed(lines, config).output.select("p_partkey", "kind", "promo", "size", "other")


# --- encodings ------------------------------------------------------------------------------------


@query("encoding_json_round_trip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def encoding_json(spark, d):
    return decode(encode(table(spark, d, "nation"), "JSON_OBJECT"), "value", "JSON_OBJECT", schema="n_nationkey int, n_name string, n_regionkey int")[0]


@query("encoding_json_array", "SELECT n_name FROM nation")
def encoding_json_array(spark, d):
    return decode(encode(table(spark, d, "nation").select("n_name"), "JSON_ARRAY"), "value", "JSON_ARRAY", schema="n_name string")[0]


@query("encoding_bad_lines", "SELECT count(*) AS n FROM part WHERE p_size % 2 = 1")
def encoding_bad_lines(spark, d):
    lines = table(spark, d, "part").select(F.when(F.col("p_size") % 2 == 1, "{broken").otherwise('{"a": 1}').alias("value"))
    return decode(lines, "value", "JSON_OBJECT_LINE", schema="a long")[1].agg(F.count(F.lit(1)).alias("n"))


@query("encoding_string_line", "SELECT p_name AS \"__raw__\" FROM part UNION ALL SELECT p_brand FROM part")
def encoding_string_line(spark, d):
    return decode(table(spark, d, "part").select(F.concat_ws("\n", "p_name", "p_brand").alias("value")), "value", "STRING_LINE")[0]


@query("encoding_xml", "SELECT p_partkey::VARCHAR AS id, p_name AS name FROM part")
def encoding_xml(spark, d):
    lines = table(spark, d, "part").select(F.concat(F.lit('<p id="'), F.col("p_partkey"), F.lit('"><name>'), F.col("p_name"), F.lit("</name></p>")).alias("value"))
    return decode(lines, "value", "XML", schema="id string, name string")[0]


# --- sources and sinks: every row is written by a sink and read back by a source -----------------


def scratch(spark: SparkSession) -> str:
    return shared_path(spark, "queries")


def through(name: str, encoding: str, source: str = "filesource", more: dict | None = None) -> None:
    @query(name, "SELECT p_partkey, p_name, p_size FROM part")
    def build(spark, d):
        path = scratch(spark)
        write(table(spark, d, "part").select("p_partkey", "p_name", "p_size"), "s3sink", {"path": path, "encodingType": encoding})
        where = {"root": path} if source == "fssource" else {"path": path} if source in ("s3rtsource", "reader") else {"filePath": path}
        return read(spark, source, where | {"encodingType": encoding, "schema": table(spark, d, "part").select("p_partkey", "p_name", "p_size").schema} | (more or {}))


through("file_csv", "CSV")
through("file_json_lines", "JSON_OBJECT_LINE")
through("source_fssource", "JSON_OBJECT_LINE", "fssource", {"fileNameRegex": "part-.*json"})
through("source_s3rtsource", "JSON_OBJECT_LINE", "s3rtsource", {"maxObjectSizeBytes": 1 << 30})
through("source_reader", "CSV", "reader")


@query("file_parquet", "SELECT p_partkey, p_name, p_size FROM part")
def file_parquet(spark, d):
    path = scratch(spark)
    write(table(spark, d, "part").select("p_partkey", "p_name", "p_size"), "gcssink", {"path": path, "encodingType": "PARQUET"})
    return read_files(spark, path, "PARQUET")


@query("file_text_gzip", "SELECT p_name AS \"__raw__\" FROM part")
def file_text_gzip(spark, d):
    path = scratch(spark)
    write_files(table(spark, d, "part").select(F.col("p_name").alias("__raw__")), path, "STRING_LINE", options={"compression": "gzip"})
    return read(spark, "filesource", {"filePath": path, "encodingType": "STRING_LINE"})


@query("sink_lake", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation")
def sink_lake(spark, d):
    path = scratch(spark)
    for _ in range(2):  # an append
        write(table(spark, d, "nation").select("n_nationkey", "n_name"), "deltalakesink", {"tablePath": path, "format": "parquet"})
    return spark.read.parquet(path)


@query("dead_letters", "SELECT count(*) AS n, 'check' AS node FROM orders WHERE NOT o_totalprice < 300000")
def dead_letters(spark, d):
    path = scratch(spark)
    dag = Dag.from_dict({"jobContext": {"dlqConfig": {"path": f"{path}/dlq"}}, "dag": [{"id": "in", "commandName": "filesource", "config": {"filePath": "given", "encodingType": "JSON_OBJECT"}, "outputs": ["check"]}, {"id": "check", "commandName": "assertion", "config": {"expression": "$.o_totalprice < 300000"}, "outputs": ["out"]}, {"id": "out", "commandName": "s3sink", "config": {"path": f"{path}/out", "encodingType": "PARQUET"}}]})
    execute(spark, dag, inputs={"in": table(spark, d, "orders")})
    found = spark.read.parquet(f"{path}/dlq/dead-letters")
    return found.groupBy(F.col("nodeId").alias("node")).agg(F.count(F.lit(1)).alias("n"))


@query("stream_available_now", "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice FROM lineitem WHERE l_quantity > 49")
def stream_available_now(spark, d):
    path = scratch(spark)
    table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").repartition(3).write.json(f"{path}/in")
    schema = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").schema
    dag = Dag.from_dict({"dag": [
        {"id": "in", "commandName": "filesource", "config": {"filePath": f"{path}/in", "encodingType": "JSON_OBJECT_LINE", "schema": schema, "maxFilesPerTrigger": 1}, "outputs": ["big"]},
        {"id": "big", "commandName": "filter", "config": {"expression": "$.l_quantity > 49"}, "outputs": ["twice"]},
        {"id": "twice", "commandName": "eval", "config": {"expression": "dict(l_orderkey=$.l_orderkey, l_linenumber=$.l_linenumber, twice=$.l_quantity * 2)"}, "outputs": ["out"]},
        {"id": "out", "commandName": "s3sink", "config": {"path": f"{path}/out", "encodingType": "PARQUET"}},
    ]})
    from ..streaming.runner import run_stream

    for running in run_stream(spark, dag, f"{path}/checkpoint", available_now=True):
        running.awaitTermination()
        if running.exception():
            raise running.exception()
    return spark.read.parquet(f"{path}/out")


# --- the flagship ---------------------------------------------------------------------------------


@query(
    "flagship",
    """SELECT l_returnflag AS flag, CASE WHEN l_quantity >= 25 THEN 'bulk' ELSE 'retail' END AS kind, count(*) AS n, sum(l_extendedprice * (1 - l_discount)) AS revenue
FROM lineitem WHERE l_discount >= 0.02 - 1e-9 GROUP BY ALL""",
)
def flagship(spark, d):
    flow = (
        Flow.start()
        .filter("$.l_discount >= 0.02 - 0.000000001")
        .eval("dict(flag=$.l_returnflag, kind=case($.l_quantity >= 25 => 'bulk', _ => 'retail'), price=$.l_extendedprice * (1 - $.l_discount))")
        .sql("select flag, kind, count(*) as n, sum(price) as revenue from events group by flag, kind")
    )
    return flow.result(table(spark, d, "lineitem"))
