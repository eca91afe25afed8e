"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query is timed with a fresh set of derived tables, so its time includes cutting the documents
into numbered segments. ``segments_per_sec`` is the sweep with a 200-term glossary.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from segloom import catalog  # noqa: E402
from segloom.catalog import fixtures as X  # noqa: E402
from segloom.operators import sweep as W  # noqa: E402
from segloom.plans.session import local_session  # noqa: E402

HEADLINE = (
    "segments_from_documents repetition_plan check_divergence check_terminology run_sweep glossary_match "
    "apply_glossary enforce_glossary merge_blocks fragment_summary review_queue resolve_outputs localise "
    "format_groups style_audit free_width_right frame_overflow_ratio partial_phrase_candidates effective_edits "
    "job_state event_counts_sliding corpus_rollup detect_language"
).split()


def sweep_200(spark, sf_dir: str):
    """The whole sweep with a 200-term glossary: the most frequent words of eight or more letters."""
    words = X.lexicon(spark, sf_dir).filter(F.col("source").rlike(r"^\p{L}{8,}$")).groupBy(F.lower("source").alias("source")).count()
    top = words.orderBy(F.col("count").desc(), "source").limit(200).select(
        "source", F.concat(F.lit("t-"), "source").alias("target"), F.crc32("source").alias("pos")
    )
    return W.run_sweep(X.bitext(spark, sf_dir), top, source_lang="영어", target_lang="한국어")


def timed(build, spark, sf_dir: str) -> float:
    X.forget()
    began = time.perf_counter()
    build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - began, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, "segloom-bench")
    X.table(spark, sf_dir, "documents").count()
    names = sys.argv[1:] or HEADLINE
    queries = {}
    for name in names:
        queries[name] = timed(catalog.QUERIES[name], spark, sf_dir)
        print(name, queries[name], file=sys.stderr, flush=True)
    out = {"metric": "headline_total", "value": round(sum(queries.values()), 3), "unit": "sec", "queries": queries}
    if not sys.argv[1:]:
        segments = X.segments(spark, sf_dir).count()
        queries["sweep_200_terms"] = timed(sweep_200, spark, sf_dir)
        out["value"] = round(sum(queries.values()), 3)
        out.update(segments=segments, segments_per_sec=round(segments / queries["sweep_200_terms"]))
    found = re.search(r"sf([0-9.]+)", sf_dir)
    out.update(sf=float(found.group(1)) if found else sf_dir, cores=cpus)
    print(json.dumps(out))


if __name__ == "__main__":
    main()
