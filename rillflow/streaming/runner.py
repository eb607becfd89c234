"""Pipelines on Structured Streaming.

Per-event nodes are part of the streaming plan. From the first ``sqleval`` on, and for every sink, the
graph runs per micro-batch, so aggregates are those of the batch at hand. The checkpoint keeps the
position; a batch is committed after all its sinks took it (at least once).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.dag import Dag, Run, dead_letter_path, plan
from ..sources.inputs import Messages, open_source, read
from ..sources.outputs import settle, write, write_dead_letters


def run_stream(spark: SparkSession, dag: Dag, checkpoint: str, *, available_now: bool = False, trigger: str = "5 seconds", on_batch: Callable[[Run, int], None] | None = None) -> list[StreamingQuery]:
    """Starts one query per source; ``on_batch`` sees each micro-batch's run after its sinks."""
    dag.validate()
    queries = []
    for node in dag.nodes.values():
        if dag.kind(node) != "source":
            continue
        found = open_source(spark, node.command, node.config, streaming=True)
        events = found.raw if isinstance(found, Messages) else found

        def one(batch: DataFrame, n: int, source=node.id, found=found) -> None:
            batch.persist()
            try:
                part = reachable(dag, source)
                run = plan(batch.sparkSession, part, inputs={source: found.decoded(batch) if isinstance(found, Messages) else batch})
                for i, df in run.sink_inputs.items():
                    run.deliveries[i] = write(df, part.nodes[i].command, part.nodes[i].config)
                place, errors = dead_letter_path(dag.context), run.all_errors()
                settle(run.deliveries, place)
                if place and errors is not None:
                    write_dead_letters(errors, place)
                if on_batch:
                    on_batch(run, n)
            finally:
                batch.unpersist()

        writer = events.writeStream.foreachBatch(one).option("checkpointLocation", f"{checkpoint}/{node.id}").queryName(f"{node.id}")
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger)
        queries.append(writer.start())
    return queries


def reachable(dag: Dag, start: str) -> Dag:
    """The part of a graph that one source feeds."""
    seen, front = set(), [start]
    while front:
        i = front.pop()
        if i not in seen:
            seen.add(i)
            front += dag.nodes[i].outputs
    return Dag({i: n for i, n in dag.nodes.items() if i in seen}, dag.context)


def poll_jdbc(spark: SparkSession, config: dict, load: Callable[[], object], save: Callable[[object], None], handle: Callable[[DataFrame], None]) -> int:
    """One poll of an incremental query: rows after the stored watermark are handled, then the new watermark is stored."""
    df = read(spark, "jdbcsource", config | {"watermark": load()}).persist()
    try:
        row = df.selectExpr("count(*)", f"max(`{config['watermarkColumn']}`)").first()
        if row[0]:
            handle(df)
            save(row[1])
        return row[0]
    finally:
        df.unpersist()
