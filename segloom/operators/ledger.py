"""Quality ledger: run and record rows, counts and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segloom.functions import text as T
from segloom.functions import values as V

RUNS_TABLE, RECORDS_TABLE = "quality_runs", "quality_records"


def findings_by_type(findings: DataFrame) -> DataFrame:
    return findings.groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy("type")


def findings_by_severity(findings: DataFrame, run_meta: DataFrame | None = None) -> DataFrame:
    """Counts per deck of the three known severities; others are ignored.

    With ``run_meta`` (one row per run, keyed by ``deck_id``) every run gets a row, also clean ones.
    """
    s = F.col("severity")
    counts = findings.groupBy("deck_id").agg(*[F.count_if(s == name).alias(name) for name in V.SEVERITY_RANK])
    if run_meta is None:
        return counts
    zero = F.lit(0).cast("long")
    return run_meta.join(counts, "deck_id", "left").withColumns({n: F.coalesce(n, zero) for n in V.SEVERITY_RANK})


def _direction(source_lang: str, target_lang: str) -> Column:
    return T.direction_code(F.lit(source_lang), F.lit(target_lang))


def quality_runs(
    findings: DataFrame, run_meta: DataFrame, *, source_lang: str, target_lang: str, client: str = "segloom",
    model: str | None = None,
) -> DataFrame:
    """One ledger row per run. ``run_meta``: ``deck_id, started_at, doc_words`` (and ``notes``)."""
    counted = findings_by_severity(findings, run_meta)
    return counted.select(
        F.concat(F.lit("run_"), F.substring(F.sha2(F.concat_ws("|", "deck_id", "started_at"), 256), 1, 16)).alias("id"),
        F.lit(client).alias("client"), F.col("deck_id").alias("project_id"), "started_at",
        F.lit("s1_translate").alias("stage"), F.lit("app").alias("executor"), F.lit(model).cast("string").alias("model"),
        _direction(source_lang, target_lang).alias("direction"), F.lit(None).cast("string").alias("route_id"), "doc_words",
        F.struct(*V.SEVERITY_RANK).alias("findings_count"),
        (F.col("notes") if "notes" in run_meta.columns else F.lit(None).cast("string")).alias("notes"),
    )


def quality_records(
    findings: DataFrame, created_at: Column, *, source_lang: str, target_lang: str, client: str = "segloom",
    model: str | None = None,
) -> DataFrame:
    """One ledger row per numbered finding. Ids derive from deck and ordinal, so a retried task or a
    replayed micro-batch writes the same id again and duplicates can be dropped."""
    none = F.lit(None).cast("string")
    return findings.select(
        F.concat(F.lit("qr_"), F.substring(F.sha2(F.concat_ws("|", "deck_id", "ordinal", "type"), 256), 1, 16)).alias("id"),
        F.lit(client).alias("client"), F.col("deck_id").alias("project_id"), created_at.alias("created_at"),
        F.col("deck_id").alias("doc_ref"), none.alias("route_id"), _direction(source_lang, target_lang).alias("direction"),
        F.lit("presentation").alias("content_type"), "location",
        F.struct("segment.source", "segment.output", none.alias("corrected"), none.alias("context")).alias("segment"),
        F.struct("type", "severity", "description", "suggested_fix").alias("finding"),
        F.struct(
            F.lit("s4_consistency").alias("stage"), F.lit("s4_consistency").alias("caught_by"), F.lit("app").alias("executor"),
            F.lit(model).cast("string").alias("producer_model"), none.alias("reviewer_model"),
        ).alias("origin"),
        F.lit("proposed").alias("disposition"),
        F.struct(F.lit("candidate").alias("status"), none.alias("matched_rule")).alias("promotion"),
    )


def review_records(actions: DataFrame) -> DataFrame:
    """Ledger rows of reviewer actions: a dismissal is ``rejected``, an edit an ``accepted`` triplet.

    ``actions``: ``session_id, seq, action, idx, new_target`` and optional ``finding_type,
    propagated``. Restores, undos and commits write nothing.
    """
    accepted = F.col("action") == "edit"
    kind = F.coalesce("finding_type", F.lit("manual.edit")) if "finding_type" in actions.columns else F.lit("manual.edit")
    spread = F.coalesce("propagated", F.lit(0)) if "propagated" in actions.columns else F.lit(0)
    return actions.filter("action in ('edit', 'dismiss')").select(
        F.concat(F.lit("qr_"), F.substring(F.sha2(F.concat_ws("|", "session_id", "seq"), 256), 1, 16)).alias("id"),
        F.col("session_id").alias("project_id"), "seq", "idx",
        F.when(accepted, F.col("new_target")).alias("corrected"), kind.alias("type"), F.lit("minor").alias("severity"),
        F.when(accepted, F.format_string(V.ACCEPTED_MESSAGE, spread)).otherwise(F.lit(V.REJECTED_MESSAGE)).alias("description"),
        F.lit("manual_edit").alias("stage"), F.when(accepted, "accepted").otherwise("rejected").alias("disposition"),
        F.when(accepted, "candidate").otherwise("rejected").alias("promotion_status"),
    )


def append_json(rows: DataFrame, path: str) -> None:
    """Append ledger rows as JSON lines in gzip; readers should drop duplicate ids."""
    rows.write.mode("append").option("compression", "gzip").json(path)


def corpus_rollup(findings: DataFrame) -> DataFrame:
    """Findings per deck, severity and type with subtotals at each level (nulls mark totals).

    ``segments`` counts places: equal positions of different decks are different segments. Findings shrink to
    one row per place and kind before the levels multiply them.
    """
    places = findings.groupBy("deck_id", "severity", "type", "idx").agg(F.count(F.lit(1)).alias("__n")).withColumn(
        "__place", F.struct("deck_id", "idx")
    )
    return places.rollup("deck_id", "severity", "type").agg(
        F.sum("__n").alias("findings"), F.count_distinct("__place").alias("segments"), F.grouping_id().alias("level")
    )


def corpus_cube(findings: DataFrame) -> DataFrame:
    """Findings for every combination of severity and type, totals included."""
    return findings.cube("severity", "type").agg(F.count(F.lit(1)).alias("findings"), F.grouping_id().alias("level"))
