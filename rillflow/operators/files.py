"""``s3filereader``: reading the files that events name, in the middle of a pipeline."""

from __future__ import annotations

import gzip
import json
import urllib.parse
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.compiler import EVENT, quoted
from ..functions.syntax import ExpressionError
from .base import Result, event_json


def open_lines(path: str, compression: str) -> Iterator[str]:
    """Lines of a file in any store that pyarrow reads; gzip by name or magic bytes with AUTO."""
    fs, name = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    with fs.open_input_stream(name, compression=None) as raw:
        head = raw.read(2)
        rest = _Joined(head, raw)
        packed = compression == "GZIP" or compression == "AUTO" and head == b"\x1f\x8b"
        with gzip.GzipFile(fileobj=rest) if packed else rest as f:
            left = b""
            while chunk := f.read(1 << 20):
                *lines, left = (left + chunk).split(b"\n")
                for line in lines:
                    yield line.rstrip(b"\r").decode("utf-8", "replace")
            if left:
                yield left.rstrip(b"\r").decode("utf-8", "replace")


class _Joined:
    """Bytes that were looked at, then the rest of a stream."""

    def __init__(self, head: bytes, rest):
        self.head, self.rest = head, rest

    def read(self, n: int = -1) -> bytes:
        if self.head:
            out, self.head = self.head, b""
            return out
        return self.rest.read(n if n >= 0 else None)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass


def read_listed_files(df: DataFrame, config: dict) -> Result:
    """Events of the files whose paths stand in ``pathField``: {line, file} with LINE, decoded JSON lines with DESERIALIZE.

    Paths are read where their rows are, so many files spread over the executors. A path that is null,
    or a file that can't be read, is an error row.
    """
    name = config.get("pathField")
    if not name or name not in df.columns:
        raise ExpressionError("s3filereader: no such pathField")
    compression, emission = str(config.get("compression", "AUTO")).upper(), str(config.get("emission", "LINE")).upper()
    decode_keys = config.get("urlDecodeKey", True)

    def read(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("line", pa.string()), ("file", pa.string()), ("event", pa.string()), ("errorMessage", pa.string())])
        for batch in stream:
            rows: list[tuple] = []
            for path, event in zip(batch.column("path").to_pylist(), batch.column("event").to_pylist()):
                try:
                    if not path:
                        raise ValueError("no path")
                    where = urllib.parse.unquote_plus(path) if decode_keys else path
                    for line in open_lines(where.replace("s3a://", "s3://"), compression):
                        if emission != "LINE":
                            json.loads(line)
                        rows.append((line, path, None, None))
                        if len(rows) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows = []
                except Exception as e:  # the event fails, not the job
                    rows.append((None, path, event, f"s3filereader: {e}"))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    found = df.select(F.col(quoted(name)).cast("string").alias("path"), event_json(df).alias("event")).mapInArrow(read, "line string, file string, event string, errorMessage string")
    good, bad = found.where("errorMessage is null"), found.where("errorMessage is not null").select("event", "errorMessage")
    if emission == "LINE":
        return Result(good.select("line", "file"), bad)
    if config.get("schema"):
        return Result(good.select(F.from_json("line", config["schema"]).alias("r")).select("r.*"), bad)
    return Result(good.select(F.parse_json("line").alias(EVENT)), bad)
