"""Stateful streams: divergence with withdrawals, dismissals, progress, and reaping of ended jobs.

Each emits changes and holds no more than its answer depends on. The order of arrival does not matter (within the watermark, where
one is used): state is made of minima, maxima and last writers by event place, not of what came last.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from segloom.functions import text as T
from segloom.functions import values as V
from segloom.operators.jobs import IDLE_SECONDS, TERMINAL
from segloom.operators.sweep import with_norms

CHANGES = (
    "deck_id string, source string, target string, idx bigint, slide bigint, paragraph int, anchor_idx bigint, "
    "related_slide bigint, description string, change int"
)
_CHANGED = [c.split()[0] for c in CHANGES.split(", ")]
#: The sweep's message with places that Python fills.
_MESSAGE = re.sub(r"%(\d)\$[sd]", lambda m: f"{{{int(m[1]) - 1}}}", V.DIVERGENCE_MESSAGE)
#: Texts share a state by digest, so that Python reads and writes one state for many of them.
TEXT_STATES = 4096
_VARIANTS = (
    "deck_id array<string>, src array<binary>, tgt array<binary>, idx array<long>, slide array<long>, paragraph array<int>, "
    "source array<string>, target array<string>"
)


class DivergenceProcessor(StatefulProcessor):
    """Source texts that share a state: the first place of each way each was translated, and its anchor, the earliest of them.

    Every batch ends with the difference to what has been reported: +1 for a finding, -1 for one withdrawn. A new variant changes
    its own finding only; an earlier anchor changes those of all variants of the text, as their message names it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        #: the anchor of a text is its first variant
        self._variants = handle.getValueState("variants", _VARIANTS)

    def _finding(self, deck: str, v: tuple, anchor: tuple) -> tuple:
        idx, slide, paragraph, source, target = v
        text = _MESSAGE.format(source, anchor[1] + 1, anchor[4], slide + 1, target)
        return deck, source, target, idx, slide + 1, paragraph, anchor[0], anchor[1] + 1, text

    def _changes(self, deck: str, before: dict[bytes, tuple], now: dict[bytes, tuple], anchor: bytes) -> Iterator[tuple]:
        old_anchor = next(iter(before), None)
        was, first = before.get(old_anchor), now[anchor]
        every = was != first
        for tgt, place in now.items():
            old = before.get(tgt)
            if not every and old == place:
                continue
            past = None if old is None or tgt == old_anchor else self._finding(deck, old, was)
            present = None if tgt == anchor else self._finding(deck, place, first)
            if past != present:
                yield from ((*f, n) for f, n in ((past, -1), (present, 1)) if f)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known: dict[tuple, dict[bytes, tuple]] = {}
        if self._variants.exists():
            for deck, src, tgt, *place in zip(*self._variants.get()):
                known.setdefault((deck, bytes(src)), {})[bytes(tgt)] = tuple(place)
        before: dict[tuple, dict[bytes, tuple]] = {}
        for frame in rows:
            columns = ("deck_id", "src", "tgt", "idx", "slide_index", "paragraph_index", "original_text", "target")
            for deck, src, tgt, *place in zip(*(frame[c].tolist() for c in columns)):
                variants = known.setdefault((deck, src), {})
                if tgt not in variants or place[0] < variants[tgt][0]:
                    before.setdefault((deck, src), dict(variants))
                    variants[tgt] = tuple(place)
        out = []
        for text, past in before.items():
            now, old_anchor = known[text], next(iter(past), None)
            anchor = min(now, key=lambda tgt: (now[tgt][0], tgt != old_anchor))
            out += self._changes(text[0], past, now, anchor)
            known[text] = {anchor: now[anchor], **now}
        if before:
            self._variants.update(tuple(map(list, zip(*(
                (*text, tgt, *place) for text, variants in known.items() for tgt, place in variants.items()
            )))))
        if out:
            yield pd.DataFrame(out, columns=_CHANGED)

    def close(self) -> None:
        pass


def divergence_stream(arriving: DataFrame, min_len: int = 4, states: int = TEXT_STATES) -> DataFrame:
    """Findings of ``check_divergence`` and their withdrawals as segments arrive (``net`` leaves what stands).

    A batch reads and writes whole states: few make its calls cheap, many keep what a small batch rewrites small.
    """
    rows = with_norms(arriving).filter((F.length("src_n") >= min_len) & (F.col("tgt_n") != ""))
    changes = rows.select(
        "deck_id", T.digest(F.col("src_n")).alias("src"), T.digest(F.col("tgt_n")).alias("tgt"), "idx", "slide_index",
        "paragraph_index", "original_text", "target",
    ).withColumn("__state", F.pmod(F.xxhash64("deck_id", "src"), F.lit(states))).groupBy("__state").transformWithStateInPandas(
        statefulProcessor=DivergenceProcessor(), outputStructType=CHANGES, outputMode="Append", timeMode="None"
    )
    forms = {"src_n": T.norm_text("source"), "tgt_n": T.norm_text("target")}
    return changes.withColumns(forms).select("deck_id", "src_n", "tgt_n", *_CHANGED[3:])


def net(changes: DataFrame) -> DataFrame:
    """What stands after all changes (``change`` of +1 and -1)."""
    rest = [c for c in changes.columns if c not in ("change", "batch_id")]
    return changes.groupBy(*rest).agg(F.sum("change").alias("__n")).filter("__n > 0").drop("__n")


#: A session's places share a state by ranges of ``2**PLACE_BITS``.
PLACE_BITS = 8


class DismissalProcessor(StatefulProcessor):
    """Last writers by ``seq`` of a range of places; emits those whose state a batch turns."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "idx array<long>, seq array<long>, action array<string>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        stored = self._last.get() if self._last.exists() else ([], [], [])
        was = {idx: (seq, action) for idx, seq, action in zip(*stored)}
        now = dict(was)
        for frame in rows:
            newest = frame.sort_values("seq").drop_duplicates("idx", keep="last")
            for idx, seq, action in zip(newest["idx"].tolist(), newest["seq"].tolist(), newest["action"].tolist()):
                if idx not in now or seq > now[idx][0]:
                    now[idx] = (seq, action)
        if now != was:
            self._last.update((list(now), [seq for seq, _ in now.values()], [action for _, action in now.values()]))
        turned = [(idx, seq, action) for idx, (seq, action) in now.items() if action != was.get(idx, (None, "restore"))[1]]
        if turned:
            out = pd.DataFrame(turned, columns=["idx", "seq", "action"])
            out.insert(0, "session_id", key[0])
            yield out

    def close(self) -> None:
        pass


def dismissal_stream(actions: DataFrame) -> DataFrame:
    """Changes of what is dismissed, per session and place, whatever the order of arrival; the newest row of a place is its state."""
    acts = actions.filter("action in ('dismiss', 'restore') and idx >= 0").select(
        "session_id", F.col("idx").cast("long").alias("idx"), F.col("seq").cast("long").alias("seq"), "action"
    )
    return acts.withColumn("__range", F.shiftright("idx", PLACE_BITS)).groupBy("session_id", "__range").transformWithStateInPandas(
        statefulProcessor=DismissalProcessor(), outputStructType="session_id bigint, idx bigint, seq bigint, action string",
        outputMode="Update", timeMode="None",
    )


def _micros(ts: pd.Series) -> pd.Series:
    return ts.astype("datetime64[us, UTC]" if ts.dt.tz is not None else "datetime64[us]").astype("int64")


class ProgressProcessor(StatefulProcessor):
    """One job: its earliest end, the newest progress behind the watermark, and all progress ahead of it.

    Progress is an orphan if the job had ended. An end that is still to come is not behind the watermark, so of the progress behind it
    only the newest can matter, while any of that ahead may turn out an orphan. When the watermark has passed the end, nothing but the end stays,
    until ``keep`` later.
    """

    def __init__(self, keep_ms: int) -> None:
        self._keep = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._job = handle.getValueState("job", "end_at long, end_id long, at long, id long, value double, out_id long")
        self._ahead = handle.getListState("ahead", "at long, id long, value double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        end_at, end_id, *best, out_id = self._job.get() if self._job.exists() else (None,) * 6
        end = None if end_at is None else (end_at, end_id)
        best = None if best[0] is None else tuple(best)
        ahead = [tuple(x) for x in self._ahead.get()] if self._ahead.exists() else []
        for frame in rows:
            at = _micros(frame["ts"])
            for kind, a, i, v in zip(frame["event_type"], at, frame["event_id"], frame["value"]):
                if kind in TERMINAL:
                    end = (int(a), int(i)) if end is None else min(end, (int(a), int(i)))
                else:
                    ahead.append((int(a), int(i), float(v)))
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        timely = [p for p in ahead if end is None or p[:2] < end]
        behind = [p for p in timely if p[0] < mark]
        best = max([*behind, *([best] if best else [])], default=None)
        ahead = [p for p in timely if p[0] >= mark]
        newest = max([*ahead, *([best] if best else [])], default=None)
        if end is not None:
            for timer in list(self._handle.listTimers()):
                self._handle.deleteTimer(timer)
            self._handle.registerTimer(end[0] // 1000 + 1 + self._keep)
        said = newest[1] if newest else None
        self._job.update((*(end or (None, None)), *(best or (None, None, None)), said))
        if ahead:
            self._ahead.put(ahead)
        else:
            self._ahead.clear()
        if said is not None and said != out_id or said is None and out_id is not None:
            yield pd.DataFrame({
                "job_id": [key[0]], "event_id": pd.array([said], dtype="Int64"), "value": [newest[2] if newest else None],
            })

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self._job.clear()
        self._ahead.clear()
        return iter(())

    def close(self) -> None:
        pass


def progress_stream(events: DataFrame, late: str = "10 minutes", keep_seconds: int = IDLE_SECONDS) -> DataFrame:
    """Changes of the last progress of each job before it ended (null: there is none after all); the newest row of a job counts.

    ``ts`` must be a timestamp with time zone. Equals ``latest_progress`` for any order of arrival within ``late``.
    """
    asked = events.filter(F.col("event_type").isin("progress", *TERMINAL)).withColumn("value", F.col("value").cast("double"))
    return asked.withWatermark("ts", late).groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=ProgressProcessor(keep_seconds * 1000), outputStructType="job_id bigint, event_id bigint, value double",
        outputMode="Update", timeMode="EventTime",
    )


class ReaperProcessor(StatefulProcessor):
    """Activity of one job. A timer stands an idle gap behind the last event of a job that has ended and reaps it; every event moves it."""

    def __init__(self, gap_ms: int) -> None:
        self._gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._job = handle.getValueState("job", "last long, ended boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last, ended = self._job.get() if self._job.exists() else (None, False)
        for frame in rows:
            newest = int(_micros(frame["ts"]).max())
            last = newest if last is None else max(last, newest)
            ended = bool(ended) or bool(frame["event_type"].isin(TERMINAL).any())
        self._job.update((last, ended))
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        if ended:
            self._handle.registerTimer(last // 1000 + 1 + self._gap)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        last, _ = self._job.get()
        self._job.clear()
        yield pd.DataFrame({"job_id": [key[0]], "last_activity": [pd.Timestamp(last, unit="us", tz="UTC")]})

    def close(self) -> None:
        pass


def expire_idle_stream(events: DataFrame, late: str = "0 seconds", gap_seconds: int = IDLE_SECONDS) -> DataFrame:
    """Jobs that have ended and then been idle for the gap, each once, when event time (the watermark) has passed it."""
    return events.withWatermark("ts", late).select("job_id", "ts", "event_type").groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=ReaperProcessor(gap_seconds * 1000), outputStructType="job_id bigint, last_activity timestamp",
        outputMode="Append", timeMode="EventTime",
    )


def glossary_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Spellings whose entry is new, gone, or has another target or place: ``source``."""
    def settled(glossary: DataFrame) -> DataFrame:
        return glossary.groupBy("source").agg(F.min("pos").cast("long").alias("pos"), F.max_by("target", "pos").alias("target"))

    one, two = settled(before), settled(after)
    same = one.join(two, [one["source"] == two["source"], one["pos"] == two["pos"], one["target"].eqNullSafe(two["target"])], "left_semi")
    return one.select("source").union(two.select("source")).distinct().join(same.select("source"), "source", "left_anti")


def refresh_terminology(
    findings: DataFrame, segments: DataFrame, arrived: DataFrame, before: DataFrame, after: DataFrame, check: Column | None = None
) -> DataFrame:
    """Stored terminology findings brought up to date: ``findings`` of ``segments`` under the glossary ``before``, now with the
    segments ``arrived`` too and the glossary ``after``.

    Old segments are checked against changed terms only, arrived ones against all; findings of terms that changed or went are withdrawn.
    """
    from segloom.operators.sweep import term_violation_join

    changed = glossary_changes(before, after)
    kept = findings.join(changed.withColumnRenamed("source", "term_source"), "term_source", "left_anti")
    again = term_violation_join(segments, after.join(changed, "source", "left_semi"))
    return kept.select(*again.columns).unionByName(again).unionByName(term_violation_join(arrived, after))
