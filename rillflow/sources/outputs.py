"""Sinks by command name.

A sink prepares messages as a DataFrame (``prepare``) and sends them: files and tables by Spark's
writers, services in batches from the executors with three retries. Sinks report input and success counts.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.compiler import compile_expression, compile_template, quoted
from ..functions.syntax import ExpressionError
from ..functions.values import text_of
from .avro_schema import fitted
from .clients import basic, credential, http, library
from .encodings import encode, record, write_files

RETRIES, FIRST_DELAY = 3, 1.0


@dataclass(frozen=True)
class Delivery:
    """Counts, and the records that were not taken (event, errorMessage) where there are any."""

    inputCount: int
    successCount: int
    failed: DataFrame | None = None


class NotTaken(Exception):
    """A service took a batch in part: places of the records that it refused, with its words."""

    def __init__(self, refused: dict[int, str]):
        super().__init__(f"{len(refused)} records refused")
        self.refused = refused


SINKS: dict[str, Callable[[DataFrame, dict], Delivery]] = {}
PREPARE: dict[str, Callable[[DataFrame, dict], DataFrame]] = {}


def sink(*names: str):
    def register(write):
        SINKS.update(dict.fromkeys(names, write))
        return write

    return register


def counted(df: DataFrame, write: Callable[[DataFrame], None]) -> Delivery:
    """Counts rows while they are written, without a second pass."""
    from pyspark.sql import Observation

    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("n")))
    n = seen.get["n"]
    return Delivery(n, n)


@sink("stdout")
def stdout(df, config):
    n = 0
    for row in encode(df, config.get("encodingType") or "JSON_OBJECT").toLocalIterator():
        print(row[0])
        n += 1
    return Delivery(n, n)


def object_path(config: dict) -> str:
    if config.get("path"):
        return config["path"]
    if config.get("bucketName") and "objectPrefix" in config:
        return f"gs://{config['bucketName']}/{config['objectPrefix'] or ''}"
    if config.get("bucketName"):
        return f"s3a://{config['bucketName']}/{config.get('keyName', '')}"
    if config.get("containerName"):
        return f"wasbs://{config['containerName']}@{config['storageAccount']}.blob.core.windows.net/{config.get('blobNamePrefix', '')}"
    raise ExpressionError("the sink needs a path, bucketName or containerName")


@sink("s3sink", "gcssink", "azureblobsink", "filesink")
def files(df, config):
    encoding = (config.get("encodingType") or "JSON_OBJECT_LINE").upper()
    if encoding == "PARQUET" and config.get("avroSchema"):
        df = fitted(df, config["avroSchema"])
    return counted(df, lambda d: write_files(d, object_path(config), encoding, partition_by=config.get("partitionColumns")))


@sink("deltalakesink", "databrickssink")
def lake(df, config):
    """An append to a table path (or named table) as Delta, or as ``format`` says."""
    if config.get("avroSchema"):
        df = fitted(df, config["avroSchema"])
    kind = config.get("format") or "delta"
    if kind == "delta" and not has_format(df, "io.delta.sql.DeltaSparkSessionExtension"):
        raise ExpressionError("Delta is not installed; set format to write another table format")

    def write(d):
        w = d.write.format(kind).mode("append")
        if config.get("partitionColumns"):
            w = w.partitionBy(*config["partitionColumns"])
        w.save(config["tablePath"]) if config.get("tablePath") else w.saveAsTable(config["tableName"])

    return counted(df, write)


def has_format(df: DataFrame, java_class: str) -> bool:
    try:
        df.sparkSession._jvm.java.lang.Class.forName(java_class)
        return True
    except Exception:  # the class is not on the class path
        return False


def table_of(config: dict) -> str:
    return f"{config['schemaName']}.{config['tableName']}" if config.get("schemaName") else config["tableName"]


def upsert_sql(table: str, columns: list[str], keys: list[str]) -> str:
    """INSERT with ON CONFLICT: other columns are updated, or nothing if all are keys."""
    names, marks = ", ".join(columns), ", ".join("?" * len(columns))
    changed = ", ".join(f"{c} = EXCLUDED.{c}" for c in columns if c not in keys)
    return f"INSERT INTO {table} ({names}) VALUES ({marks}) ON CONFLICT ({', '.join(keys)}) DO " + (f"UPDATE SET {changed}" if changed else "NOTHING")


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, as tables of plain columns need."""
    nested = (T.StructType, T.ArrayType, T.MapType, T.VariantType)
    return df.select(*[F.to_json(F.col(quoted(f.name))).alias(f.name) if isinstance(f.dataType, nested) else F.col(quoted(f.name)) for f in df.schema])


@sink("jdbcsink", "clickhousesink")
def jdbc(df, config):
    df = flat(df)
    c, url = credential(config), config.get("jdbcUrl") or f"jdbc:clickhouse:{config.get('endpoint')}/{config.get('database', 'default')}"
    if str(config.get("writeMode", "INSERT")).upper() == "UPSERT":
        keys = [k.strip() for k in config["upsertKeyColumns"].split(",")]
        statement, columns = upsert_sql(table_of(config) if config.get("tableName") else config["table"], df.columns, keys), df.columns
        connect = config.get("connect")  # a picklable function that opens a DB-API connection

        def send(rows: list) -> None:
            link = connect() if connect else library("jaydebeapi").connect(config["driverClassName"], url, [c.get("username"), c.get("password")])
            try:
                cursor = link.cursor()
                cursor.executemany(statement, [[r[x] for x in columns] for r in rows])
                link.commit()
            finally:
                link.close()

        return delivered(df, config, send)
    options = {"url": url, "dbtable": table_of(config) if config.get("tableName") else config["table"], "batchsize": str(config.get("batchSize", 1000))}
    options |= {k: v for k, v in (("driver", config.get("driverClassName")), ("user", c.get("username")), ("password", c.get("password"))) if v}
    return counted(df, lambda d: d.write.format("jdbc").mode("append").options(**options).save())


UNITS = {"SECONDS": 1e0, "MILLISECONDS": 1e3, "MICROSECONDS": 1e6, "NANOSECONDS": 1e9}


def timescale_rows(df: DataFrame, config: dict) -> DataFrame:
    """The time column from an epoch number in its unit, or from ISO text."""
    name = config["timeColumn"]
    t = df.schema[name].dataType
    c = F.col(quoted(name))
    if isinstance(t, T.NumericType):
        unit = UNITS[str(config.get("timeUnit", "MILLISECONDS")).upper()]
        c = F.timestamp_micros((c.cast("decimal(38,9)") * F.lit(1e6).cast("decimal(38,0)") / F.lit(unit).cast("decimal(38,0)")).cast("long"))
    elif isinstance(t, T.StringType):
        c = F.try_to_timestamp(c)
    return flat(df.withColumn(name, c))


@sink("timescaledbsink")
def timescale(df, config):
    return jdbc(timescale_rows(df, config), config)


PREPARE["timescaledbsink"] = timescale_rows


def hypertable_sql(config: dict) -> str:
    return f"SELECT create_hypertable('{table_of(config)}', '{config['timeColumn']}', if_not_exists => TRUE)"


# --- message sinks --------------------------------------------------------------------------------


def key_of(df: DataFrame, expression: str | None) -> Column:
    return F.lit(None).cast("string") if not expression else text_of(compile_expression(expression, df)).cast("string")


def keyed(setting: str):
    def prepare(df: DataFrame, config: dict) -> DataFrame:
        """key and value: the event as JSON, and the text of the key expression."""
        return df.select(key_of(df, config.get(setting)).alias("key"), record(df).alias("value"))

    return prepare


for command, setting in {"kafkasink": "partitionKeyFieldExpressionStr", "kinesissink": "partitionKeyFieldExpressionStr", "azureeventhubsink": "partitionKeyFieldExpressionStr", "sqssink": "messageGroupIdExpression", "pubsubsink": "orderingKeyExpression"}.items():
    PREPARE[command] = keyed(setting)


@sink("kafkasink", "azureeventhubsink")
def kafka(df, config):
    options = {f"kafka.{k}": v for k, v in (config.get("properties") or {}).items()}
    options |= {"kafka.bootstrap.servers": config.get("broker") or f"{config['fullyQualifiedNamespace']}:9093", "topic": config.get("topic") or config["eventHubName"]}
    return counted(PREPARE["kafkasink"](df, config), lambda d: d.write.format("kafka").options(**options).save())


def influx_lines(df: DataFrame, config: dict) -> DataFrame:
    """Line protocol: measurement, tags, fields (all other columns unless named) and time; rows without a field drop."""
    tags, at = list(config.get("tagFields") or []), config.get("timestampField")
    from_column = config.get("measurementField")
    names = config.get("fieldFields") or [c for c in df.columns if c not in tags and c not in (at, from_column)]
    name = F.coalesce(F.col(quoted(from_column)).cast("string"), F.lit(config.get("measurement"))) if from_column else F.lit(config.get("measurement"))
    clean = lambda c, chars: F.regexp_replace(c, f"([{chars}])", r"\\$1")
    tag_parts = [F.concat(F.lit(f",{t}="), clean(F.col(quoted(t)).cast("string"), ",= ")) for t in tags if t in df.columns]

    def value(f: str) -> Column:
        t, c = df.schema[f].dataType, F.col(quoted(f))
        if isinstance(t, T.IntegralType):
            return F.concat(c.cast("string"), F.lit("i"))
        if isinstance(t, (T.FractionalType, T.BooleanType)):
            return c.cast("string")
        text = F.to_json(c) if isinstance(t, (T.StructType, T.ArrayType, T.MapType, T.VariantType)) else c.cast("string")
        return F.concat(F.lit('"'), clean(text, '"\\\\\\\\'), F.lit('"'))

    field_parts = [F.concat(F.lit(f.replace(" ", "\\ ").replace(",", "\\,").replace("=", "\\=") + "="), value(f)) for f in names if f in df.columns]
    fields = F.concat_ws(",", *field_parts)
    time_part = F.coalesce(F.concat(F.lit(" "), F.col(quoted(at)).cast("long").cast("string")), F.lit("")) if at and at in df.columns else F.lit("")
    line = F.concat(clean(name, ", "), *[F.coalesce(t, F.lit("")) for t in tag_parts], F.lit(" "), fields, time_part)
    return df.where((fields != "") & name.isNotNull()).select(line.alias("value"))


def splunk_events(df: DataFrame, config: dict) -> DataFrame:
    extra = {k: config[k] for k in ("sourcetype", "index", "source") if config.get(k)}
    event = F.struct(*[F.col(quoted(c)) for c in df.columns])
    return df.select(F.to_json(F.struct(event.alias("event"), *[F.lit(v).alias(k) for k, v in extra.items()])).alias("value"))


def bulk_lines(df: DataFrame, config: dict) -> DataFrame:
    action = json.dumps({"index": {"_index": config["index"]}})
    return df.select(F.concat(F.lit(action + "\n"), record(df), F.lit("\n")).alias("value"))


def monitor_events(df: DataFrame, config: dict) -> DataFrame:
    """Events with the time that the service asks for, now where absent."""
    name = config.get("timeGeneratedField") or "TimeGenerated"
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    df = df.withColumn(name, F.coalesce(F.col(quoted(name)).cast("string"), now) if name in df.columns else now)
    return df.select(record(df).alias("value"))


def mails(df: DataFrame, config: dict) -> DataFrame:
    parts = {"to": "toTemplate", "cc": "ccTemplate", "subject": "subjectTemplate", "body": "bodyTemplate"}
    return df.select(*[(compile_template(config[t], df) if config.get(t) else F.lit(None).cast("string")).alias(n) for n, t in parts.items()])


PREPARE |= {"influxdbsink": influx_lines, "splunkhecsink": splunk_events, "elasticsearchsink": bulk_lines, "azuremonitorsink": monitor_events, "smtpsink": mails, "zerobussink": lambda df, config: (fitted(df, config["avroSchema"]) if config.get("avroSchema") else df).transform(lambda d: d.select(record(d).alias("value")))}


def delivered(df: DataFrame, config: dict, send: Callable[[list], None]) -> Delivery:
    """Sends rows in batches from the executors. What a service refuses, the whole batch or some of it, is sent again up to three times, then given back with the last error."""
    size = int(config.get("batchSize") or 500)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out(got: int, good: int, lost: list) -> pa.RecordBatch:
            events = [None, *(json.dumps(r, default=str) for r, _ in lost)]
            pad = [0] * len(lost)
            return pa.RecordBatch.from_arrays([pa.array([got, *pad]), pa.array([good, *pad]), pa.array(events, pa.string()), pa.array([None, *(e for _, e in lost)], pa.string())], names=["got", "good", "event", "errorMessage"])

        def flush(rows: list) -> pa.RecordBatch:
            left, errors = list(rows), [""] * len(rows)
            for attempt in range(RETRIES + 1):
                try:
                    send(left)
                    return out(len(rows), len(rows), [])
                except NotTaken as e:
                    left, errors = [left[i] for i in sorted(e.refused)], [e.refused[i] for i in sorted(e.refused)]
                except Exception as e:
                    errors = [f"{type(e).__name__}: {e}"] * len(left)
                if attempt < RETRIES:
                    time.sleep(config.get("firstDelaySeconds", FIRST_DELAY) * 2**attempt)
            return out(len(rows), len(rows) - len(left), list(zip(left, errors)))

        rows: list = []
        for b in batches:
            for r in b.to_pylist():
                rows.append(r)
                if len(rows) >= size:
                    yield flush(rows)
                    rows = []
        if rows:
            yield flush(rows)

    from pyspark import StorageLevel

    # kept, as reading the failures must not send anything again
    sent = df.mapInArrow(run, "got long, good long, event string, errorMessage string").persist(StorageLevel.DISK_ONLY)
    got, good = sent.agg(F.coalesce(F.sum("got"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    if got == good:
        sent.unpersist()
        return Delivery(got, good)
    return Delivery(got, good, sent.where("event is not null").select("event", "errorMessage"))


def settle(deliveries: dict[str, Delivery], place: str | None) -> None:
    """Records that sinks did not take go to the dead letters; without a place for them the run fails, so that nothing is lost unseen."""
    for node, d in deliveries.items():
        if d.failed is not None:
            if not place:
                raise RuntimeError(f"sink {node} took {d.successCount} of {d.inputCount} records, and no dead letters are configured")
            write_dead_letters(d.failed.withColumn("nodeId", F.lit(node)), place)


def refused_items(answer: object) -> None:
    """Items of a bulk answer that carry an error."""
    items = answer.get("items") or [] if isinstance(answer, dict) and answer.get("errors") else []
    refused = {i: json.dumps(next(iter(x.values()))["error"]) for i, x in enumerate(items) if "error" in next(iter(x.values()), {})}
    if refused:
        raise NotTaken(refused)


def posts(command: str, address: Callable[[dict], str], join: Callable[[list[str]], str], kind: str, head: Callable[[dict], dict] = basic, check: Callable[[object], None] = lambda answer: None):
    """A sink that posts joined messages to an address."""

    def write(df: DataFrame, config: dict) -> Delivery:
        url, headers = address(config), head(config) | {"Content-Type": kind}

        def send(rows):
            check(http(url, data=join([r["value"] for r in rows]).encode(), headers=headers, method="POST"))

        return delivered(PREPARE[command](df, config), config, send)

    SINKS[command] = write


def token(config: dict) -> dict:
    return {"Authorization": f"Splunk {credential(config).get('key', '')}"}


posts("influxdbsink", lambda c: f"{c['url'].rstrip('/')}/api/v2/write?org={c.get('org', '')}&bucket={c.get('bucket', '')}&precision={str(c.get('precision', 'MS')).lower()}", "\n".join, "text/plain")
posts("splunkhecsink", lambda c: f"{c['hecUrl'].rstrip('/')}/services/collector/event", "\n".join, "application/json", token)
posts("elasticsearchsink", lambda c: f"{c['host'].rstrip('/')}/_bulk", "".join, "application/x-ndjson", check=refused_items)
posts("azuremonitorsink", lambda c: f"{c['dceEndpoint'].rstrip('/')}/dataCollectionRules/{c['dcrImmutableId']}/streams/{c['streamName']}?api-version=2023-01-01", lambda v: "[" + ",".join(v) + "]", "application/json")
posts("zerobussink", lambda c: f"{c['zerobusEndpoint'].rstrip('/')}/{c['tableName']}", lambda v: "[" + ",".join(v) + "]", "application/json")


def queue_sink(command: str, send_of: Callable[[dict], Callable[[list], None]]):
    def write(df: DataFrame, config: dict) -> Delivery:
        return delivered(PREPARE[command](df, config), config, send_of(config))

    SINKS[command] = write


def sqs_send(config):
    def send(rows):
        client, refused = library("boto3").client("sqs"), {}
        for a in range(0, len(rows), 10):
            answer = client.send_message_batch(QueueUrl=config["queueUrl"], Entries=[{"Id": str(i), "MessageBody": r["value"]} | ({"MessageGroupId": r["key"]} if r["key"] else {}) for i, r in enumerate(rows[a : a + 10])])
            refused |= {a + int(x["Id"]): x.get("Message") or x.get("Code") or "refused" for x in (answer or {}).get("Failed") or []}
        if refused:
            raise NotTaken(refused)

    return send


def kinesis_send(config):
    def send(rows):
        answer = library("boto3").client("kinesis").put_records(StreamName=config["streamName"], Records=[{"Data": r["value"].encode(), "PartitionKey": r["key"] or str(i)} for i, r in enumerate(rows)])
        refused = {i: x.get("ErrorMessage") or x["ErrorCode"] for i, x in enumerate((answer or {}).get("Records") or []) if x.get("ErrorCode")}
        if refused:
            raise NotTaken(refused)

    return send


def pubsub_send(config):
    def send(rows):
        client = library("google.cloud.pubsub_v1").PublisherClient()
        path = client.topic_path(config["projectId"], config["topic"])
        for f in [client.publish(path, r["value"].encode(), ordering_key=r["key"] or "") for r in rows]:
            f.result()

    return send


def smtp_send(config):
    def send(rows):
        import smtplib
        from email.message import EmailMessage

        c = credential(config)
        with smtplib.SMTP(config["host"], config.get("port", 587)) as server:
            if config.get("useTls", True):
                server.starttls()
            if c.get("username"):
                server.login(c["username"], c.get("password", ""))
            for r in rows:
                m = EmailMessage()
                m["From"], m["To"], m["Subject"] = config["fromAddress"], r["to"], r["subject"] or ""
                if r["cc"]:
                    m["Cc"] = r["cc"]
                m.set_content(r["body"] or "", subtype=str(config.get("bodyContentType", "text/plain")).partition("/")[2] or "plain")
                server.send_message(m)

    return send


for command, maker in {"sqssink": sqs_send, "kinesissink": kinesis_send, "pubsubsink": pubsub_send, "smtpsink": smtp_send}.items():
    queue_sink(command, maker)


def write(df: DataFrame, command: str, config: dict | None = None) -> Delivery:
    """Sends a DataFrame to a sink command."""
    if command not in SINKS:
        raise ExpressionError(f"unknown sink {command}")
    return SINKS[command](df, config or {})


def write_dead_letters(errors: DataFrame, prefix: str, *, key: str | None = None) -> None:
    """Failed events in the dead-letter layout, partitioned by day and hour; Avro where its format is installed, else Parquet."""
    now = F.current_timestamp()
    rows = errors.select(F.unix_millis(now).alias("processingTimestamp"), F.lit(key).cast("binary").alias("key"), F.col("event").cast("binary").alias("value"), F.create_map().cast("map<string,string>").alias("metadata"), "errorMessage", (F.col("nodeId") if "nodeId" in errors.columns else F.lit(None).cast("string")).alias("nodeId"), F.date_format(now, "yyyy-MM-dd").alias("dt"), F.date_format(now, "HH").alias("hr"))
    kind = "avro" if has_format(errors, "org.apache.spark.sql.v2.avro.AvroDataSourceV2") else "parquet"
    rows.write.format(kind).mode("append").partitionBy("dt", "hr").save(f"{prefix.rstrip('/')}/dead-letters")


