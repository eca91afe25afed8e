"""Review: dismissals, edits, phrase propagation, replay of the edit log."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segloom.functions import text as T
from segloom.functions import values as V
from segloom.plans.cut import cut
from segloom.plans.ordering import running
from segloom.plans.skew import attach, attach_weighted

_SEGMENT = ["deck_id", "idx"]


def dismissal_anti_join(findings: DataFrame, dismissals: DataFrame) -> DataFrame:
    """Findings attached to a segment and not dismissed for it."""
    muted = dismissals.select("deck_id", "idx", "type")
    return findings.filter("idx >= 0").join(muted, ["deck_id", "idx", "type"], "left_anti")


def phrase_spans(target: Column, phrase: Column) -> Column:
    """0-based starts where a phrase stands on its own, overlapping ones included.

    A Hangul edge is blocked by a Hangul neighbour, other CJK edges never, word characters by
    word characters.
    """
    n = F.length(phrase)

    def blocked(edge: Column, beside: Column) -> Column:
        hangul, cjk, word = f"^[{V.HANGUL_CLASS}]$", f"^[{V.PHRASE_CJK_CLASS}]$", r"^[\p{L}\p{N}_]$"
        return F.when(edge.rlike(hangul), beside.rlike(hangul)).when(edge.rlike(cjk), F.lit(False)).otherwise(
            edge.rlike(word) & beside.rlike(word)
        )

    # a zero-width split cuts before every occurrence; only an occurrence at the start is silent
    quoted = F.concat(F.lit("(?=\\Q"), F.replace(phrase, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    cuts = F.aggregate(
        F.split(target, quoted, -1),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("s")),
        lambda acc, piece: F.struct(
            (acc["at"] + F.length(piece)).alias("at"), F.concat(acc["s"], F.array(acc["at"])).alias("s")
        ),
        lambda acc: acc["s"],
    )
    starts = F.filter(cuts, lambda p: (p > 0) | F.startswith(target, phrase))
    first, last = F.substring(phrase, 1, 1), F.right(phrase, F.lit(1))
    return F.filter(
        starts,
        lambda p: ~((p > 0) & blocked(first, F.substring(target, p, F.lit(1))))
        & ~((p + n < F.length(target)) & blocked(last, F.substring(target, p + n + 1, F.lit(1)))),
    )


def replace_phrase_once(target: Column, phrase: Column, new: Column, spans: Column) -> Column:
    """Replace the only span (null if there is none or several); a deletion takes one space along."""
    start = F.get(spans, F.lit(0))
    stop = start + F.length(phrase)
    space = r"(?U)^\s$"
    eat_right = (new == "") & F.substring(target, stop + 1, F.lit(1)).rlike(space)
    eat_left = (new == "") & ~eat_right & (start > 0) & F.substring(target, start, F.lit(1)).rlike(space)
    left = F.substring(target, F.lit(1), F.when(eat_left, start - 1).otherwise(start))
    right = F.substring(target, F.when(eat_right, stop + 2).otherwise(stop + 1), F.length(target))
    return F.when(F.size(spans) == 1, F.concat(left, new, right))


_TOKEN = r"[\p{L}\p{N}_]+"
#: So many hash buckets of asked words go to every task, however many words are asked.
_ASKED_BUCKETS = 1 << 20
_UNSPACED = f"[{V.PHRASE_CJK_CLASS}{V.HANGUL_CLASS}]"


def _bigrams_with_cjk(c: Column) -> Column:
    return F.when(c.rlike(_UNSPACED), F.filter(T.char_grams(c, 2), lambda g: g.rlike(_UNSPACED))).otherwise(
        F.array().cast("array<string>")
    )


def partial_phrase_candidates(edits: DataFrame, bitext: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Other segments of the deck whose target holds an edited phrase exactly once.

    ``edits``: ``deck_id, edit_id, idx, old_phrase, new_phrase``; ``excluded``: ``edit_id, deck_id,
    idx`` (already propagated). Edits meet segments through a word of the phrase (or a character
    pair for CJK text, where words are not separated), so neither side is paired as a whole. Only places and asked words
    are exchanged for that; texts move once, to the pairs.
    """
    phrase = T.strip("old_phrase")
    # written as they come: every test below would work out again how a phrase was made
    edits = cut(edits.select("deck_id", "edit_id", "idx", "old_phrase", "new_phrase"))
    strong = edits.withColumn("old_phrase", phrase).filter(
        T.is_meaningful_phrase("old_phrase") & (F.col("old_phrase") != F.col("new_phrase"))
    )
    words = F.regexp_extract_all("old_phrase", F.lit(_TOKEN), F.lit(0))
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    key = F.coalesce(F.get(_bigrams_with_cjk(F.col("old_phrase")), F.lit(0)), longest)
    asked = strong.select("deck_id", "edit_id", F.col("idx").alias("edit_idx"), "old_phrase", "new_phrase", key.alias("__key"))
    keys = F.array_distinct(F.concat(F.regexp_extract_all("target", F.lit(_TOKEN), F.lit(0)), _bigrams_with_cjk(F.col("target"))))
    asked = cut(asked)
    # most words are asked by nobody: a bounded number of hash buckets, carried to the texts, says so before they are exchanged
    bucket = F.pmod(F.xxhash64("deck_id", "__key"), F.lit(_ASKED_BUCKETS))
    heard = F.broadcast(asked.select(bucket.alias("__bucket")).distinct())
    words = bitext.select("deck_id", "idx", F.explode(keys).alias("__key")).withColumn("__bucket", bucket)
    index = cut(words.join(heard, "__bucket", "left_semi").drop("__bucket").join(
        asked.select("deck_id", "__key").distinct(), ["deck_id", "__key"], "left_semi"
    ))
    heat = index.groupBy("deck_id", "__key").agg(F.count(F.lit(1)).alias("__n"))
    keyed = asked.join(heat, ["deck_id", "__key"])
    near = attach(index, keyed, ["deck_id", "__key"], "__n", spread=["idx"]).drop("__key").filter(F.col("idx") != F.col("edit_idx"))
    met = near.join(bitext.select(*_SEGMENT, "slide_index", "is_note", "original_text", "target"), _SEGMENT).filter(
        F.contains("target", F.col("old_phrase"))
    )
    if excluded is not None:
        met = met.join(excluded.select("deck_id", "edit_id", "idx"), ["deck_id", "edit_id", "idx"], "left_anti")
    proposed = T.let(phrase_spans(F.col("target"), F.col("old_phrase")), lambda spans: replace_phrase_once(
        F.col("target"), F.col("old_phrase"), F.col("new_phrase"), spans
    ))
    # as a generator, so that the spans are looked for once and not again by a filter
    changed = F.explode(F.filter(F.array(proposed), lambda p: p.isNotNull() & (p != F.col("target"))))
    return met.select(
        "deck_id", "edit_id", "idx", (F.col("slide_index") + 1).alias("slide"), "is_note",
        F.col("original_text").alias("source"), "target", changed.alias("proposed_target"), "old_phrase", "new_phrase",
    )


def propagate_edits(edits: DataFrame, plan: DataFrame, bitext: DataFrame) -> DataFrame:
    """Carry edits to all identical segments: ``deck_id, op_id, idx, target`` of real changes.

    ``edits``: ``deck_id, op_id, pos, idx, target``. A segment edited by itself in the same
    operation keeps its own text. Of several edits to one repeat group the last that differs from
    a member's text counts for it, so each group passes on its last two texts.
    """
    current = bitext.select("deck_id", "idx", F.col("target").alias("__now"))
    own = edits.join(current, _SEGMENT).filter("target <> __now").select("deck_id", "op_id", "idx", "target")
    group_cols = ["deck_id", "op_id", "canonical"]
    grouped = edits.join(plan.select("deck_id", "idx", "canonical", "repeat_count"), _SEGMENT).filter("canonical is not null")
    texts = grouped.groupBy(*group_cols, "repeat_count", "target").agg(F.max("pos").alias("pos"))
    newest = texts.withColumn("__n", F.row_number().over(Window.partitionBy(*group_cols).orderBy(F.col("pos").desc()))).filter("__n <= 2")
    pair = newest.groupBy(*group_cols, "repeat_count").agg(
        F.max(F.when(F.col("__n") == 1, F.col("target"))).alias("last"), F.max(F.when(F.col("__n") == 2, F.col("target"))).alias("second")
    )
    members = plan.filter("canonical is not null").select("deck_id", "idx", "canonical", "repeat_count").join(current, _SEGMENT)
    reached = attach_weighted(members, pair, ["deck_id", "canonical"], "repeat_count", spread=["idx"])
    target = F.when(F.col("__now") != F.col("last"), F.col("last")).when(F.col("__now") != F.col("second"), F.col("second"))
    carried = reached.select("deck_id", "op_id", "idx", target.alias("target")).filter("target is not null").join(
        edits.select("deck_id", "op_id", "idx"), ["deck_id", "op_id", "idx"], "left_anti"
    )
    return own.unionByName(carried)


def effective_edits(log: DataFrame) -> DataFrame:
    """Final text per session and position from an accepted log, by bracket matching.

    An edit opens a level and an undo closes one; an edit lives on if the level never falls below
    its own afterwards. Levels come from running sums and minima over ranges of the log, so a
    session of any length is spread over tasks.
    """
    steps = log.filter("action in ('edit', 'undo')").withColumn(
        "__step", F.when(F.col("action") == "edit", 1).otherwise(-1)
    )
    summed = running(steps, ["session_id"], "seq", {"__sum": ("sum", F.col("__step"))})
    # an undo with nothing to take back does nothing: levels are counted from the lowest sum so far
    lowest = running(cut(summed), ["session_id"], "seq", {"__low": ("min", F.col("__sum"))})
    level = lowest.withColumn("__level", F.col("__sum") - F.least(F.lit(0), F.col("__low")))
    after = running(cut(level), ["session_id"], "seq", {"__after": ("min", F.col("__level"))}, reverse=True)
    live = after.filter((F.col("action") == "edit") & (F.col("__after") >= F.col("__level")))
    return live.groupBy("session_id", "idx").agg(F.max_by("new_target", "seq").alias("target"))


def dismissal_state(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Currently dismissed keys, and the log rows that really changed something.

    ``log``: ``session_id, seq, action, idx`` (and optional ``type``) with dismiss/restore rows.
    """
    key = ["session_id", "idx", *(["type"] if "type" in log.columns else [])]
    acts = log.filter("action in ('dismiss', 'restore') and idx >= 0")
    state = acts.groupBy(*key).agg(F.max_by("action", "seq").alias("action")).filter("action = 'dismiss'").select(*key)
    before = running(acts, key, "seq", {"__before": ("max", F.struct("seq", "action"))}, exclusive=True, bits=20)
    changes = before.filter(F.col("action") != F.coalesce("__before.action", F.lit("restore"))).select(*key, "seq", "action")
    return state, changes


class Draft:
    """One review session as the log drives it: texts, undo stack, revisions."""

    def __init__(self) -> None:
        self.texts: dict[int, str] = {}
        self.stack: list[dict[int, str]] = []
        self.revision = 0
        self.committed = 0

    def apply(self, action: str, expected: int, edits: list[tuple[int, str, str]]) -> tuple[bool, list[tuple[int, str]]]:
        """Edits are (idx, new text, base text). Returns (accepted, changed texts)."""
        if expected != self.revision:
            return False, []
        if action == "edit":
            old = {i: self.texts.get(i, base) for i, new, base in edits if self.texts.get(i, base) != new}
            if not old:
                return True, []
            self.stack.append(old)
            changed = {i: new for i, new, _ in edits if i in old}
        elif action == "undo":
            if not self.stack:
                return True, []
            changed = self.stack.pop()
        else:
            if action == "commit":
                self.committed = self.revision
            return True, []
        self.texts.update(changed)
        self.revision += 1
        return True, sorted(changed.items())


REPLAY_SCHEMA = (
    "session_id bigint, seq bigint, action string, accepted boolean, revision int, dirty boolean, "
    "changes array<struct<idx:bigint,text:string>>"
)


def _outcome(draft: Draft, session, seq, action, expected, edits) -> dict:
    accepted, changes = draft.apply(action, int(expected), [(int(e["idx"]), e["text"], e["base"]) for e in edits])
    return {
        "session_id": session, "seq": seq, "action": action, "accepted": accepted, "revision": draft.revision,
        "dirty": draft.revision != draft.committed, "changes": [{"idx": i, "text": t} for i, t in changes],
    }


def replay_edit_log(operations: DataFrame) -> DataFrame:
    """Exact replay with optimistic concurrency: one outcome row per operation.

    ``operations``: ``session_id, seq, action, expected_revision, edits`` where ``edits`` is an
    array of ``(idx, text, base)``. The rule is sequential per session, so sessions are spread
    over tasks and each is read in order as a stream of Arrow batches; only its texts and undo
    stack are held. ``effective_edits`` is the parallel form for logs already known to be accepted.
    """
    ordered = operations.repartition("session_id").sortWithinPartitions("session_id", "seq")

    def replay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, draft = None, Draft()
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                if r.session_id != session:
                    session, draft = r.session_id, Draft()
                rows.append(_outcome(draft, r.session_id, r.seq, r.action, r.expected_revision, r.edits))
            if rows:
                yield pd.DataFrame(rows)

    return ordered.select("session_id", "seq", "action", "expected_revision", "edits").mapInPandas(replay, REPLAY_SCHEMA)


def drafts(outcomes: DataFrame) -> DataFrame:
    """Latest text per session and position after a replay."""
    return outcomes.select("session_id", "seq", F.explode("changes").alias("c")).groupBy(
        "session_id", F.col("c.idx").alias("idx")
    ).agg(F.max_by("c.text", "seq").alias("target"))


def edit_preview(proposed: DataFrame, bitext: DataFrame, plan: DataFrame, budgets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What an edit would change, without changing it: ``(previews, partial candidates)``.

    ``proposed``: ``deck_id, edit_id, idx, new_target, propagate``.
    """
    now = bitext.select("deck_id", "idx", F.col("target").alias("old_target"))
    base = proposed.join(now, _SEGMENT).join(budgets.select("deck_id", "idx", "budget"), _SEGMENT, "left")
    phrase = T.changed_phrase("old_target", "new_target")
    base = base.withColumn("__p", phrase).withColumns({"old_phrase": F.col("__p.old_phrase"), "new_phrase": F.col("__p.new_phrase")}).drop("__p")
    as_edits = base.filter("propagate").select("deck_id", F.col("edit_id").alias("op_id"), F.lit(0).alias("pos"), "idx", F.col("new_target").alias("target"))
    alone = base.filter("not propagate and old_target <> new_target").select("deck_id", "edit_id", "idx")
    # a segment with a proposal of its own keeps that text, whatever the others would carry to it
    own = as_edits.select("deck_id", "idx").distinct().withColumn("__own", F.lit(True))
    spread = propagate_edits(as_edits, plan, bitext).select("deck_id", F.col("op_id").alias("edit_id"), "idx").join(own, _SEGMENT, "left").join(
        as_edits.select("deck_id", F.col("op_id").alias("edit_id"), "idx").distinct().withColumn("__mine", F.lit(True)), ["deck_id", "edit_id", "idx"], "left"
    ).filter("__own is null or __mine").select("deck_id", "edit_id", "idx")
    changed = alone.unionByName(spread)
    counts = changed.groupBy("deck_id", "edit_id").agg(F.count(F.lit(1)).alias("changed"))
    groups = base.filter("propagate").select("deck_id", "edit_id", "idx").join(
        plan.select("deck_id", "idx", "canonical", "repeat_count"), _SEGMENT
    ).filter("canonical is not null").select("deck_id", "edit_id", "canonical", "repeat_count")
    members = attach_weighted(
        plan.filter("canonical is not null").select("deck_id", "idx", "canonical", "repeat_count"), groups,
        ["deck_id", "canonical"], "repeat_count", spread=["idx"],
    ).select("deck_id", "edit_id", "idx")
    partial = partial_phrase_candidates(
        base.select("deck_id", "edit_id", "idx", "old_phrase", "new_phrase"), bitext, members
    )
    found = partial.groupBy("deck_id", "edit_id").agg(F.count(F.lit(1)).alias("partial"))
    zero = F.lit(0).cast("long")
    previews = base.join(counts, ["deck_id", "edit_id"], "left").join(found, ["deck_id", "edit_id"], "left").select(
        "deck_id", "edit_id", "idx", "old_target", "new_target", "old_phrase", "new_phrase",
        F.coalesce("changed", zero).alias("changed"), F.coalesce("partial", zero).alias("partial"),
        F.coalesce(F.length("new_target") > F.col("budget"), F.lit(False)).alias("over_budget"),
    )
    return previews, partial


def review_table(
    bitext: DataFrame, plan: DataFrame, findings: DataFrame, dismissals: DataFrame, edited: DataFrame,
    budgets: DataFrame, statuses: DataFrame, styled: DataFrame | None = None,
) -> DataFrame:
    """One row per segment as the review screen needs it; findings in order, dismissed ones gone."""
    shown = dismissal_anti_join(findings, dismissals).groupBy(*_SEGMENT).agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "type", "severity", "description", "suggested_fix", "term_source"))).alias("findings")
    )
    muted = dismissals.filter("type = 'style.mapping_dropped'").select(*_SEGMENT).distinct().withColumn("__muted", F.lit(True))
    lost = F.col("style_status").isin("dropped", "partial") & F.col("__muted").isNull()
    no_text = F.lit(None).cast("string")
    style_finding = F.struct(
        F.lit(None).cast("int").alias("ordinal"), F.lit("style.mapping_dropped").alias("type"), F.lit("minor").alias("severity"),
        F.lit(V.STYLE_MESSAGE).alias("description"), no_text.alias("suggested_fix"), no_text.alias("term_source"),
    )
    rows = (
        bitext.join(plan.select(*_SEGMENT, "repeat_count"), _SEGMENT, "left")
        .join(budgets.select(*_SEGMENT, "budget"), _SEGMENT, "left")
        .join(statuses.select(*_SEGMENT, F.col("status").alias("style_status")), _SEGMENT, "left")
        .join(shown, _SEGMENT, "left").join(muted, _SEGMENT, "left")
        .join(edited.select(*_SEGMENT).distinct().withColumn("edited", F.lit(True)), _SEGMENT, "left")
    )
    if styled is not None:
        segments = styled.groupBy(*_SEGMENT).agg(
            F.array_sort(F.collect_list(F.struct("seg_no", "text", "group_index"))).alias("style_segments")
        )
        rows = rows.join(segments, _SEGMENT, "left")
    none = F.array().cast("array<struct<ordinal:int,type:string,severity:string,description:string,suggested_fix:string,term_source:string>>")
    listed = F.coalesce("findings", none)
    return rows.select(
        *_SEGMENT, (F.col("slide_index") + 1).alias("slide"), F.col("shape_index").alias("shape"),
        F.col("paragraph_index").alias("paragraph"), "slide_title", "is_note", F.col("original_text").alias("source"),
        "target", F.coalesce("repeat_count", F.lit(1).cast("long")).alias("repeat_count"), F.col("budget").alias("length_budget"),
        F.when(lost, F.concat(listed, F.array(style_finding))).otherwise(listed).alias("findings"),
        F.coalesce("edited", F.lit(False)).alias("edited"), F.coalesce("style_status", F.lit("single_style")).alias("style_status"),
        *(["style_segments"] if styled is not None else []), "container_id", "container_kind",
    )


def relocalise_blocks(blocks: DataFrame, fn: Callable[[list[str], bool], list[str]], budgets: DataFrame | None = None) -> DataFrame:
    """Translate each block as one sentence and wrap the result back over its segments.

    ``blocks``: merged segments with ``block_id``; ``fn(texts, strict)`` gets one text per block. A
    result over the block's budget (``deck_id, block_id, budget``) is asked for once more, strictly.
    Lines the wrapping leaves empty are omitted.
    """
    key = ["deck_id", "block_id"]
    packed = blocks.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("idx", T.strip("original_text").alias("t")))).alias("l")
    ).select(
        *key, F.col("l.idx").alias("members"), F.transform("l.t", lambda t: F.greatest(F.lit(1), F.length(t))).alias("weights"),
        F.array_join(F.filter("l.t", lambda t: t != ""), " ").alias("joined"),
    ).filter("joined <> ''")
    packed = cut(packed)

    def ask(rows: DataFrame, strict: bool) -> DataFrame:
        def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield frame[key].assign(text=fn(list(frame["joined"]), strict))

        return rows.select(*key, "joined").mapInPandas(call, "deck_id string, block_id int, text string")

    first = cut(ask(packed, False))
    final = first
    if budgets is not None:
        over = first.join(budgets.filter("budget is not null").select(*key, "budget"), key).filter(
            F.length("text") > F.col("budget")
        ).select(*key)
        second = ask(packed.join(over, key, "left_semi"), True).withColumnRenamed("text", "again")
        final = first.join(second, key, "left").withColumn("text", F.coalesce("again", "text")).drop("again")
    lines = packed.join(final, key).select(
        "deck_id", "members", F.posexplode(T.wrap_to_weights(F.col("text"), F.col("weights"))).alias("n", "target")
    )
    return lines.filter("target <> ''").select("deck_id", F.get("members", F.col("n")).alias("idx"), "target")
