"""Streaming forms: job state, window counts, sweep of new text, ledger, edit replay."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from segloom.operators import jobs as J
from segloom.operators import ledger as L
from segloom.operators import sweep as W
from segloom.operators.review import REPLAY_SCHEMA, Draft, _outcome
from segloom.plans.cut import shared_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_SCHEMA = "job_id bigint, state string, ended_by bigint"


def use_rocksdb(spark: SparkSession) -> None:
    """State larger than memory and ``transformWithState`` both need the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class JobStateProcessor(StatefulProcessor):
    """Per job: its earliest complete or error, its latest cancel, and whether it started.

    These are minima and maxima over event time, so the order of arrival does not matter and a
    busy job is folded batch by batch. A cancel overwrites any other ending.
    """

    def __init__(self, ttl_ms: int | None) -> None:
        self._ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._job = handle.getValueState(
            "job", "end_at long, end_id long, end_kind string, cancel_at long, cancel_id long, started boolean", self._ttl
        )

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        end, cancel, started = None, None, False
        if self._job.exists():
            end_at, end_id, end_kind, cancel_at, cancel_id, started = self._job.get()
            end = None if end_at is None else (end_at, end_id, end_kind)
            cancel = None if cancel_at is None else (cancel_at, cancel_id)
        for frame in rows:
            frame = frame.assign(at=frame["ts"].astype("int64")).sort_values(["at", "event_id"])
            ended = frame[frame["event_type"].isin(["complete", "error"])].head(1)
            for e in ended.itertuples(index=False):
                first = (int(e.at), int(e.event_id), e.event_type)
                end = first if end is None else min(end, first)
            for e in frame[frame["event_type"] == "cancelled"].tail(1).itertuples(index=False):
                last = (int(e.at), int(e.event_id))
                cancel = last if cancel is None else max(cancel, last)
            started = started or bool((frame["event_type"] == "started").any())
        self._job.update((*(end or (None, None, None)), *(cancel or (None, None)), started))
        if cancel:
            state, ended_by = "cancelled", cancel[1]
        elif end:
            state, ended_by = ("completed" if end[2] == "complete" else "failed"), end[1]
        else:
            state, ended_by = ("running" if started else "pending"), None
        yield pd.DataFrame({"job_id": [key[0]], "state": [state], "ended_by": pd.array([ended_by], dtype="Int64")})

    def close(self) -> None:
        pass


def job_state_stream(events: DataFrame, *, ttl_ms: int | None = None) -> DataFrame:
    """Changes of job state as they happen (update mode); newest row per job is its state.

    With ``ttl_ms``, jobs without an event for so long are forgotten (for streams that run on: it needs processing time).
    """
    return events.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=JobStateProcessor(ttl_ms), outputStructType=STATE_SCHEMA, outputMode="Update",
        timeMode="ProcessingTime" if ttl_ms else "None",
    )


class _Texts:
    """Texts of a draft in map state; only the places asked for are read or written."""

    def __init__(self, state: Any) -> None:
        self._state = state

    def get(self, idx: int, base: str) -> str:
        return self._state.getValue((idx,))[0] if self._state.containsKey((idx,)) else base

    def update(self, changed: dict[int, str]) -> None:
        for idx, text in changed.items():
            self._state.updateValue((idx,), (text,))


class _Steps:
    """Undo steps of a draft in map state by height."""

    def __init__(self, state: Any, height: int) -> None:
        self._state, self.height = state, height

    def __bool__(self) -> bool:
        return self.height > 0

    def append(self, step: dict[int, str]) -> None:
        self._state.updateValue((self.height,), (list(step), list(step.values())))
        self.height += 1

    def pop(self) -> dict[int, str]:
        self.height -= 1
        idx, text = self._state.getValue((self.height,))
        self._state.removeKey((self.height,))
        return dict(zip(idx, text))


_WAITING = (
    "ops array<struct<seq:bigint,action:string,expected:bigint,idx:array<bigint>,text:array<string>,base:array<string>>>"
)
#: Stands for "no operation before": map state takes no null key.
_NONE = -(1 << 63)


def _refused(draft: Draft, session: int, seq: int, action: str) -> dict:
    return {
        "session_id": session, "seq": seq, "action": action, "accepted": False, "revision": draft.revision,
        "dirty": draft.revision != draft.committed, "changes": [],
    }


class ReplayProcessor(StatefulProcessor):
    """Edit log of one session. Operations wait until the one they follow has been applied, however late it comes.

    Each link of the chain is taken by one operation, the one with the smallest ``seq`` that is there when its turn comes. Others
    that name the same predecessor are answered as not accepted and change nothing, at once or whenever they come.
    """

    def __init__(self, ttl_ms: int | None) -> None:
        self._ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._texts = handle.getMapState("texts", "idx long", "text string", self._ttl)
        self._steps = handle.getMapState("steps", "height int", "idx array<long>, text array<string>", self._ttl)
        self._waiting = handle.getMapState("waiting", "prior long", _WAITING, self._ttl)
        self._passed = handle.getMapState("passed", "prior long", "seq long", self._ttl)
        self._head = handle.getValueState("head", "revision int, committed int, height int, last long", self._ttl)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        draft, height, last = Draft(), 0, _NONE
        if self._head.exists():
            draft.revision, draft.committed, height, last = self._head.get()
        draft.texts, draft.stack = _Texts(self._texts), _Steps(self._steps, height)
        out = []
        for frame in rows:
            for r in frame.itertuples(index=False):
                edits = [(int(e["idx"]), e["text"], e["base"]) for e in r.edits]
                op = (int(r.seq), r.action, int(r.expected_revision), *([e[k] for e in edits] for k in range(3)))
                prior = _NONE if pd.isna(r.prior) else int(r.prior)
                if self._passed.containsKey((prior,)):
                    if self._passed.getValue((prior,))[0] != op[0]:  # a repeated delivery has had its answer
                        out.append(_refused(draft, key[0], op[0], op[1]))
                    continue
                there = [tuple(w) for w in self._waiting.getValue((prior,))[0]] if self._waiting.containsKey((prior,)) else []
                if op[0] not in [w[0] for w in there]:
                    self._waiting.updateValue((prior,), ([*there, op],))
        while self._waiting.containsKey((last,)):
            ops = sorted((tuple(w) for w in self._waiting.getValue((last,))[0]), key=lambda w: w[0])
            self._waiting.removeKey((last,))
            seq, action, expected, *parts = ops[0]
            edits = [{"idx": i, "text": t, "base": b} for i, t, b in zip(*parts)]
            out.append(_outcome(draft, key[0], seq, action, expected, edits))
            out.extend(_refused(draft, key[0], w[0], w[1]) for w in ops[1:])
            self._passed.updateValue((last,), (seq,))
            last = seq
        self._head.update((draft.revision, draft.committed, draft.stack.height, last))
        if out:
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def replay_stream(operations: DataFrame, *, ttl_ms: int | None = None) -> DataFrame:
    """Outcomes of ``replay_edit_log`` for operations that arrive in any order, over any number of micro-batches.

    ``prior`` is the ``seq`` of the session's previous operation (null for its first). With ``ttl_ms``, sessions idle
    for so long lose their state (for streams that run on: it needs processing time).
    """
    return operations.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=ReplayProcessor(ttl_ms), outputStructType=REPLAY_SCHEMA, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None"
    )


def event_counts_stream(events: DataFrame, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Window counts with a watermark; ``ts`` must be a timestamp with time zone."""
    return J.event_counts(events.withWatermark("ts", late), width, slide)


def idle_sessions_stream(events: DataFrame, gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Activity sessions that have gone idle; emitted once the watermark passes their end."""
    return J.activity_sessions(events.withWatermark("ts", late), gap)


def incremental_sweep(new_bitext: DataFrame, glossary: DataFrame, **untranslated) -> DataFrame:
    """Terminology and untouched-text findings of one arriving batch against a static glossary."""
    rows = W.with_norms(new_bitext)
    return W.term_violation_join(rows, glossary).unionByName(W.check_untranslated(rows, **untranslated))


def sweep_available(arriving: DataFrame, glossary: DataFrame, **untranslated) -> DataFrame:
    """Check everything that has arrived, micro-batch by micro-batch, and return the findings written.

    Each batch overwrites a folder of its own number, so a batch that is repeated after a failure counts once.
    """
    spark = arriving.sparkSession
    base = f"{shared_dir(spark)}/segloom/{uuid.uuid4().hex}"

    def check(batch: DataFrame, number: int) -> None:
        incremental_sweep(batch, glossary, **untranslated).write.mode("overwrite").parquet(f"{base}/out/n={number}")

    schema = incremental_sweep(spark.createDataFrame([], arriving.schema), glossary, **untranslated).schema
    writer = arriving.writeStream.option("checkpointLocation", f"{base}/log").trigger(availableNow=True)
    writer.foreachBatch(check).start().awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/out")


def quality_stream(actions: DataFrame, late: str = "1 hour") -> DataFrame:
    """Ledger rows of arriving reviewer actions, each action (session and number) recorded once.

    ``actions`` carry their event time in ``ts``.
    """
    once = actions.withWatermark("ts", late).dropDuplicatesWithinWatermark(["session_id", "seq"])
    return L.review_records(once)


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process everything there is and return what the stream wrote.

    Append streams go to Parquet files; others write each micro-batch with its number, for the
    caller to keep the newest row of a key.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/segloom/{uuid.uuid4().hex}"
    out, log = f"{base}/out", f"{base}/log"
    writer = stream.writeStream.option("checkpointLocation", log).trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", out).start()
        schema = stream.schema
    else:
        def keep(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch_id", F.lit(number)).write.mode("overwrite").parquet(f"{out}/n={number}")

        query = writer.outputMode(mode).foreachBatch(keep).start()
        schema = stream.withColumn("batch_id", F.lit(0)).schema
    query.awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out)
