"""Structured Streaming: case state, operational metrics, request de-duplication."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from landshift.operators.cases import STATE, VERDICT, judge_action
from landshift.operators.ordered import _none
from landshift.session import scratch_path

ACTION_COLUMNS = (
    "case_id string, seq bigint, ts timestamp, actor_id string, actor_role string, action string, target string, "
    "inspector_id string, inspector_active boolean, reason string"
)
JUDGED_COLUMNS = (
    ACTION_COLUMNS + ", " + ", ".join(f"{k} {v}" for k, v in VERDICT.items())
    + ", " + ", ".join(f"after_{k} {v}" for k, v in STATE.items())
)
_NAMES = [part.split()[0] for part in ACTION_COLUMNS.split(", ")]
_JUDGED_NAMES = [part.split()[0] for part in JUDGED_COLUMNS.split(", ")]


ROWS_OUT = 10_000
LATE = "LATE_SEQUENCE"


class CaseProcessor(StatefulProcessor):
    """Keeps the current state of a case and the last sequence number, and judges arriving actions in order.

    The rows of a trigger are put in order; their number is bounded by the source's limit per trigger. An
    action whose number is not above the last one came too late and is refused, as the actions after it
    are judged already.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("case", ", ".join(f"{k} {v}" for k, v in STATE.items()) + ", last bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, last = None, None
        if self._state.exists():
            *kept, last = self._state.get()
            state = dict(zip(STATE, kept)) if kept[0] is not None else None
        arrived = pd.concat([part[_NAMES] for part in rows]).sort_values("seq", kind="stable")
        for a in range(0, len(arrived), ROWS_OUT):
            out = []
            for row in arrived.iloc[a:a + ROWS_OUT].to_dict("records"):
                seq = _none(row["seq"])
                if last is not None and (seq is None or seq <= last):
                    verdict = {"error_code": LATE, "previous_status": None if state is None else state["status"]}
                else:
                    state, verdict = judge_action(state, row)
                    last = last if seq is None else int(seq)
                after = [None] * len(STATE) if state is None else [_none(state[k]) for k in STATE]
                out.append([row[n] for n in _NAMES] + list(verdict.values()) + after)
            yield pd.DataFrame(out, columns=_JUDGED_NAMES)
        self._state.update((*[None if state is None else state[k] for k in STATE], last))

    def close(self) -> None:
        pass


def case_stream(actions: DataFrame) -> DataFrame:
    """Judged actions of a stream; refused ones carry an error code and go to a side output.

    State lives in the RocksDB state store (set spark.sql.streaming.stateStore.providerClass to
    the RocksDB provider), keyed by case and checkpointed with the query.
    """
    return actions.select(*_NAMES).groupBy("case_id").transformWithStateInPandas(
        statefulProcessor=CaseProcessor(), outputStructType=T.StructType.fromDDL(JUDGED_COLUMNS),
        outputMode="Append", timeMode="None")


def accepted(judged: DataFrame) -> DataFrame:
    """Actions that changed or confirmed a case."""
    return judged.where("error_code is null")


def refused(judged: DataFrame) -> DataFrame:
    """The side output: refused actions with their codes, late ones included."""
    return judged.where("error_code is not null")


def metrics_stream(events: DataFrame, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Counts and total seconds per code and time window; late rows beyond the delay are dropped."""
    return (
        events.withWatermark("ts", delay).groupBy(F.window("ts", width), "code")
        .agg(F.count("*").alias("n"), F.sum("seconds").alias("total_seconds"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "code", "n", "total_seconds")
    )


def dedupe_stream(requests: DataFrame, key: str = "request_key", delay: str = "1 day") -> DataFrame:
    """First arrival of a request key within the watermark delay."""
    return requests.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def run_to_table(stream: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """Processes everything available now into a Parquet table under the shared checkpoint folder."""
    base = scratch_path(spark, name)
    query = (
        stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        .option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A Parquet table as a stream: its folder, or the one file next to the other tables."""
    path = f"{root.rstrip('/')}/{name}.parquet"
    stored = spark.read.parquet(path)
    reader = spark.readStream.schema(stored.schema)
    files = stored.inputFiles()
    if len(files) == 1 and files[0].endswith(f"/{name}.parquet"):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(root)
    return reader.parquet(path)


def run_case_stream(actions: DataFrame, spark: SparkSession) -> DataFrame:
    """Judges all actions available now, with the RocksDB state store."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        return run_to_table(case_stream(actions), spark, "cases")
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
