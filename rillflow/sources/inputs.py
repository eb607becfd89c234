"""Sources by command name: settings to a DataFrame of events, batch or streaming."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.compiler import EVENT
from ..functions.syntax import ExpressionError
from ..operators.base import Result
from .clients import ClientSource
from .encodings import DECODED, decode, read_files


@dataclass(frozen=True)
class Messages:
    """Messages as a service gave them, and how they become events and errors: those that cannot be read."""

    raw: DataFrame
    decoded: Callable[[DataFrame], Result]

    @property
    def result(self) -> Result:
        return self.decoded(self.raw)


SOURCES: dict[str, Callable[[SparkSession, dict, bool], DataFrame | Messages | Result]] = {}


def source(*names: str):
    def register(build):
        SOURCES.update(dict.fromkeys(names, build))
        return build

    return register


def needed(config: dict, *keys: str) -> None:
    for k in keys:
        if config.get(k) in (None, ""):
            raise ExpressionError(f"the source needs {k}")


def encoding_of(config: dict, default: str | None = None) -> str:
    e = str(config.get("encodingType") or default or "").upper()
    if e not in DECODED:
        raise ExpressionError(f"unknown or missing encodingType {e!r}")
    return e


def stream_options(config: dict, streaming: bool) -> dict:
    options = dict(config.get("options") or {})
    if streaming and config.get("maxFilesPerTrigger"):
        options["maxFilesPerTrigger"] = config["maxFilesPerTrigger"]
    return options


@source("filesource")
def filesource(spark, config, streaming=False):
    needed(config, "filePath")
    return read_files(spark, config["filePath"], encoding_of(config), schema=config.get("schema"), streaming=streaming, options=stream_options(config, streaming))


BACKENDS = {"file": "file://", "s3": "s3a://", "gs": "gs://", "azblob": "wasbs://", "sftp": "sftp://"}


@source("fssource")
def fssource(spark, config, streaming=False):
    """Files under a root whose names match; corrupt files fail the job unless ``skipCorruptFiles``; a stream's checkpoint is the resume position.

    ``replicas`` and ``replica`` deal the files by a hash of their path.
    """
    needed(config, "root")
    backend = config.get("backend", "file")
    if backend not in BACKENDS:
        raise ExpressionError(f"unknown backend {backend}")
    root = config["root"] if "://" in config["root"] or backend == "file" else BACKENDS[backend] + config["root"]
    options = {"recursiveFileLookup": "true", "ignoreCorruptFiles": str(bool(config.get("skipCorruptFiles"))).lower(), "ignoreMissingFiles": "true"} | stream_options(config, streaming)
    df = read_files(spark, root, encoding_of(config), schema=config.get("schema"), streaming=streaming, options=options)
    columns = df.columns
    if config.get("fileNameRegex"):
        name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
        regex = config["fileNameRegex"].replace("(?P<", "(?<")
        df = df.where(name.rlike(f"^(?:{regex})$"))
    if config.get("replicas"):
        share = F.conv(F.substring(F.sha2(F.col("_metadata.file_path"), 256), 1, 8), 16, 10).cast("long") % config["replicas"]
        df = df.where(share == config.get("replica", 0))
    return df.select(*columns)


@source("reader")
def reader(spark, config, streaming=False):
    needed(config, "path")
    return read_files(spark, config["path"], encoding_of(config, "STRING_LINE"), schema=config.get("schema"), streaming=streaming, options={"recursiveFileLookup": "true"} | dict(config.get("config") or {}))


@source("stdin")
def stdin(spark, config, streaming=False):
    """Lines up to the first empty one."""
    lines = []
    for line in sys.stdin:
        if not line.strip():
            break
        lines.append((line.rstrip("\n"),))
    return messages(config, spark.createDataFrame(lines, "value string"), default="STRING_LINE")


@source("s3rtsource")
def s3_realtime(spark, config, streaming=False):
    """New objects of a bucket as a file stream; the checkpoint takes the queue's place. Oversized objects are errors by their path."""
    needed(config, "path")
    df = read_files(spark, config["path"], encoding_of(config), schema=config.get("schema"), streaming=streaming, options={"recursiveFileLookup": "true", "ignoreMissingFiles": "true"} | stream_options(config, streaming))
    path, most = F.col("_metadata.file_path"), config.get("maxObjectSizeBytes")
    columns = [F.col(f"`{c}`") for c in df.columns]
    if config.get("includeObjectMetadata"):
        columns += [F.regexp_extract(path, r"^\w+://([^/]*)/", 1).alias("__s3_bucket"), F.regexp_extract(path, r"^\w+://[^/]*/(.*)$", 1).alias("__s3_key")]
    if not most:
        return df.select(*columns)
    reason = F.lit(f"object exceeds {most} bytes").alias("errorMessage")
    if streaming:
        # the stream tells of oversized objects only by their rows
        raw = df.select(F.struct(*columns).alias("row"), path.alias("path"), (F.col("_metadata.file_size") <= most).alias("fits"))
        return Messages(raw, lambda part: Result(part.where("fits").select("row.*"), part.where("not fits").select(F.col("path").alias("event"), reason).distinct()))
    # listed without their content; the others' scan leaves them out by the file's size
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(config["path"])
    return Result(df.where(F.col("_metadata.file_size") <= most).select(*columns), listed.where(F.col("length") > most).select(F.col("path").alias("event"), reason))


def messages(config, df: DataFrame, column: str = "value", *, default: str = "JSON_OBJECT", schema: str | None = None) -> Messages:
    """Events of a message column, metadata columns left behind."""
    encoding, schema = encoding_of(config, default), config.get("schema") or schema
    return Messages(df, lambda raw: Result(*decode(raw, column, encoding, schema=schema)))


@source("kafkasource")
def kafka(spark, config, streaming=False):
    needed(config, "broker", "topic")
    options = {"kafka.bootstrap.servers": config["broker"], "subscribe": config["topic"], "startingOffsets": "earliest"} | ({"kafka.group.id": config["groupId"]} if config.get("groupId") else {})
    options |= {f"kafka.{k}": v for k, v in (config.get("properties") or {}).items()}
    if streaming:
        options["maxOffsetsPerTrigger"] = str(config.get("maxOffsetsPerTrigger", 5000 * 200))
    return messages(config, (spark.readStream if streaming else spark.read).format("kafka").options(**options).load())


@source("kinesissource")
def kinesis(spark, config, streaming=False):
    needed(config, "streamName")
    options = {"streamName": config["streamName"], "region": config.get("regionStr", ""), "startingposition": config.get("initialPosition", "TRIM_HORIZON")}
    return messages(config, (spark.readStream if streaming else spark.read).format("aws-kinesis").options(**options).load(), "data")


def event_hub(spark, config, streaming) -> DataFrame:
    """Event Hubs by their Kafka endpoint."""
    needed(config, "eventHubName")
    host = config.get("fullyQualifiedNamespace") or config["connectionString"].split("sb://")[1].split("/")[0]
    login = f'org.apache.kafka.common.security.plain.PlainLoginModule required username="$ConnectionString" password="{config.get("connectionString", "")}";'
    options = {"kafka.bootstrap.servers": f"{host}:9093", "subscribe": config["eventHubName"], "kafka.security.protocol": "SASL_SSL", "kafka.sasl.mechanism": "PLAIN", "kafka.sasl.jaas.config": login, "startingOffsets": str(config.get("initialPosition", "EARLIEST")).lower(), "includeHeaders": "true"}
    return (spark.readStream if streaming else spark.read).format("kafka").options(**options).load()


@source("azureeventhubsource")
def azure_event_hub(spark, config, streaming=False):
    return messages(config, event_hub(spark, config, streaming))


@source("azureiothubsource")
def azure_iot_hub(spark, config, streaming=False):
    return Messages(event_hub(spark, config, streaming), lambda raw: with_iothub(raw, config))


def with_iothub(raw: DataFrame, config: dict) -> Result:
    """Events with the ``_iothub`` envelope: device, enqueued time and properties from the message headers."""
    headers = F.map_from_entries(F.transform("headers", lambda h: F.struct(h.getField("key"), h.getField("value").cast("string"))))
    device = F.try_element_at(headers, F.lit("iothub-connection-device-id"))
    envelope = F.struct(device.alias("deviceId"), F.unix_millis(F.col("timestamp")).alias("enqueuedTime"), headers.alias("properties")).alias("_iothub")
    schema, text = config.get("schema"), F.col("value").cast("string")
    parsed = F.try_parse_json(text)
    broken = raw.where(parsed.isNull()).select(text.alias("event"), F.lit("can't read as JSON_OBJECT").alias("errorMessage"))
    good = raw.where(parsed.isNotNull())
    if schema is None:
        return Result(good.select(parsed.alias(EVENT), envelope), broken)
    return Result(good.select(F.from_json(text, schema).alias("r"), envelope).select("r.*", "_iothub"), broken)


@source("jdbcsource")
def jdbc(spark, config, streaming=False):
    """A query's rows; with a watermark column, those after ``watermark``. A stream polls by foreachBatch (see streaming.poll_jdbc)."""
    needed(config, "jdbcUrl", "query")
    query = config["query"].replace(":watermark", sql_literal(config.get("watermark")))
    options = {"url": config["jdbcUrl"], "query": query, "fetchsize": str(config.get("fetchSize", 1000))} | ({"driver": config["driverClassName"]} if config.get("driverClassName") else {})
    return spark.read.format("jdbc").options(**options).load()


def sql_literal(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


def client(name: str):
    def build(spark, config, streaming=False):
        spark.dataSource.register(ClientSource)
        raw = (spark.readStream if streaming else spark.read).format("rillflow_client").option("client", name).option("config", json.dumps({k: v for k, v in config.items() if k != "schema"})).load()
        return messages(config if name in QUEUES else config | {"encodingType": "JSON_OBJECT"}, raw, schema=SHAPES.get(name))

    return build


# Services whose messages have an encoding of their own; the others' records come as JSON.
QUEUES = {"sqs", "pubsub", "mqtt", "activemq"}
# The shapes of services whose records are fixed.
SHAPES = {
    "imap": "messageId string, `from` string, `to` array<string>, cc array<string>, subject string, bodyText string, bodyHtml string, headers map<string,string>, attachments array<struct<filename:string,contentType:string,contentBase64:string>>, receivedDate string",
    "syslogudp": "`__raw__` string",
}
for command, name in {"splunksource": "splunk", "elasticsearchsource": "elasticsearch", "azuremonitorsource": "azuremonitor", "syslogudp": "syslogudp", "imapsource": "imap", "ldapsource": "ldap", "sqssource": "sqs", "pubsubsource": "pubsub", "mqttsource": "mqtt", "activemqsource": "activemq"}.items():
    SOURCES[command] = client(name)


def open_source(spark: SparkSession, command: str, config: dict | None = None, *, streaming: bool = False) -> DataFrame | Messages | Result:
    """The events of a source command, the messages that hold them, or events beside what could not be read."""
    if command not in SOURCES:
        raise ExpressionError(f"unknown source {command}")
    return SOURCES[command](spark, config or {}, streaming)


def read(spark: SparkSession, command: str, config: dict | None = None, *, streaming: bool = False) -> DataFrame:
    """The events of a source command; a run of a graph gets unreadable messages too (:func:`open_source`)."""
    found = open_source(spark, command, config, streaming=streaming)
    found = found.result if isinstance(found, Messages) else found
    return found.output if isinstance(found, Result) else found
