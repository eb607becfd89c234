"""``python -m rillflow -id JOB (-f FILE | -d BASE64) [-s SERVICE] [-e ENVIRONMENT] [--stream --checkpoint DIR]``: runs a pipeline."""

from __future__ import annotations

import argparse
import base64

from .plans.dag import Dag, execute
from .session import session


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="rillflow", description=__doc__)
    p.add_argument("-id", "--job-id", default="job")
    given = p.add_mutually_exclusive_group(required=True)
    given.add_argument("-f", "--dag-file", help="YAML or JSON definition")
    given.add_argument("-d", "--dag", help="the definition in base64")
    p.add_argument("-s", "--service", default="default")
    p.add_argument("-e", "--environment", default="default")
    p.add_argument("--metric-client-type", default="noop", choices=["noop", "listener"])
    p.add_argument("--stream", action="store_true", help="run sources as streams until stopped")
    p.add_argument("--available-now", action="store_true", help="a stream that ends with what is there")
    p.add_argument("--checkpoint", help="where a stream keeps its position")
    a = p.parse_args(args)
    dag = Dag.from_file(a.dag_file) if a.dag_file else Dag.from_yaml(base64.b64decode(a.dag).decode())
    spark = session(f"{a.service}-{a.environment}-{a.job_id}")
    if a.metric_client_type == "listener":
        from .streaming.metrics import log_metrics

        log_metrics(spark)
    if a.stream:
        from .streaming.runner import run_stream

        for q in run_stream(spark, dag, a.checkpoint or f"checkpoints/{a.job_id}", available_now=a.available_now):
            q.awaitTermination()
        return 0
    run = execute(spark, dag)
    for node, d in run.deliveries.items():
        print(f"{node}: {d.inputCount} in, {d.successCount} delivered")
    run.discard()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
