"""Queries that SQL cannot express, over their whole tables, against plain Python."""

import collections
import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from segloom.catalog import queue
from segloom.functions import values as V
from segloom.sources import glossary_files as S

SF = "/root/testdata/sf0.001"


def half_even(n, d):
    q, r = divmod(n, d)
    return q + (2 * r > d or (2 * r == d and q % 2 == 1))


def plain_wrap(text, weights):
    rest, share, lines = text.strip(V.WHITESPACE), sum(weights), []
    for i, w in enumerate(weights[:-1]):
        later = len(weights) - 1 - i
        room = len(rest) - later
        if room > 0:
            want = max(1, min(room, half_even(len(rest) * w, max(share, 1))))
            reach = max(4, want // 4)
            places = range(max(1, want - reach), min(len(rest) - 1, want + reach) + 1)
            spaces = [(abs(at - want), at) for at in places if rest[at] in V.WHITESPACE]
            end = max(1, min(room, min(spaces)[1] if spaces else want))
            lines.append(rest[:end].strip(V.WHITESPACE))
            rest = rest[end:].lstrip(V.WHITESPACE)
        else:
            lines.append("")
        share -= w
    return [*lines, rest]


def test_wrapping_of_all_documents(spark):
    got = collections.defaultdict(dict)
    for r in entry.queries()["wrap_to_weights"](spark, SF).collect():
        got[r.doc_id][r.line_no] = r.line
    for d in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        weights = [max(1, len(x)) for x in d.text.split("\n")]
        want = plain_wrap(d.text.replace("\n", " "), weights)
        assert [got[d.doc_id][i] for i in range(len(want))] == want, d.doc_id


def test_signatures_of_files(spark, tmp_path):
    heads = {"a.pptx": b"PK\x03\x04rest", "b.ppt": bytes.fromhex("D0CF11E0A1B11AE1") + b"x", "c.txt": b"PK\x03", "d.bin": b"-", "e.ppt": bytes.fromhex("D0CF11E0A1B11A")}
    for name, body in heads.items():
        (tmp_path / name).write_bytes(body)
    rows = S.file_signature_filter(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert {os.path.basename(r.path): (r.format, r.valid) for r in rows} == {
        "a.pptx": ("zip", True), "b.ppt": ("ole2", True), "c.txt": (None, False), "d.bin": (None, False), "e.ppt": (None, False),
    }


def norm(text):
    return re.sub(r"\s+", " ", text).strip().casefold()


def dice(a, b):
    x, y = (collections.Counter(s[i : i + 2] for i in range(len(s) - 1)) for s in (a, b))
    total = sum(x.values()) + sum(y.values())
    return 2 * sum((x & y).values()) / total if total else 0.0


def plain_guess(target, fix):
    """Word run most like the term; the first of equally good ones."""
    fix_key = norm(fix)
    words = fix_key.split(" ")
    tokens = [(m.start(), m.end()) for m in re.finditer(r"\S+", target)]
    best = (0.0, None)
    for i in range(len(tokens)):
        for n in range(1, min(len(words) + 1, len(tokens) - i) + 1):
            s, e = tokens[i][0], tokens[i + n - 1][1]
            key = norm(target[s:e])
            if not (any(len(w) >= 2 and w in key for w in words) or any(len(w) >= 2 and w in fix_key for w in key.split(" "))):
                continue
            for a, b in [(s, e)] + ([(s, s + len(fix))] if e - s > len(fix) else []):
                score = dice(norm(target[a:b]), fix_key)
                if score >= 0.5 and score > best[0] + 1e-12:
                    best = (score, (a, b))
    return best[1]


def plain_fix(target, fix, src):
    at = target.lower().find(src.lower()) if src else -1
    if at >= 0:
        return at, at + len(src), "certain"
    m = re.search(r"\s*".join(map(re.escape, fix.split())), target, re.I)
    if m:
        return m.start(), m.end(), "certain"
    guess = plain_guess(target, fix)
    return None if guess is None else (*guess, "estimated")


def test_suggestions_for_all_findings(spark):
    _, findings = queue.merged_and_findings(spark, SF)
    rows = findings.select("deck_id", "idx", "ordinal", "type", "target", "suggested_fix", "term_source").collect()
    got = {(r.deck_id, r.idx, r.ordinal): (r.start, r.stop, r.confidence) for r in entry.queries()["suggest_fix"](spark, SF).collect()}
    want = {}
    for r in rows:
        fix, src = (r.suggested_fix or "").strip(), (r.term_source or "").strip()
        if r.type.startswith("terminology.") and fix and r.target and fix not in r.target:
            found = plain_fix(r.target, fix, src)
            if found:
                want[r.deck_id, r.idx, r.ordinal] = found
    assert want and got == want


@pytest.mark.parametrize("limit", [40, 10_000])
def test_relocalised_blocks_of_all_decks(spark, limit):
    from segloom.operators import review

    blocks, _ = queue.merged_and_findings(spark, SF)
    blocks = blocks.select("deck_id", "idx", "block_id", "original_text")

    def double(texts, strict):
        return [t[: max(1, len(t) * 2 // 3)] if strict else f"{t} {t}" for t in texts]

    budgets = blocks.select("deck_id", "block_id").distinct().withColumn("budget", F.lit(limit))
    got = {(r.deck_id, r.idx): r.target for r in review.relocalise_blocks(blocks, double, budgets).collect()}
    members, want = collections.defaultdict(list), {}
    for r in blocks.collect():
        members[r.deck_id, r.block_id].append((r.idx, r.original_text.strip(V.WHITESPACE)))
    for (deck, _), rows in members.items():
        rows.sort()
        joined = " ".join(t for _, t in rows if t)
        if joined:
            text = double([joined], False)[0]
            if len(text) > limit:
                text = double([joined], True)[0]
            for (idx, _), line in zip(rows, plain_wrap(text, [max(1, len(t)) for _, t in rows])):
                if line:
                    want[deck, idx] = line
    assert got == want and want


@pytest.mark.parametrize("name", ["run_summary", "primary_finding", "assign_ordinals"])
def test_counts_and_ranks_move_no_texts(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    exchanged = plan.partition("Exchange")[0]
    assert "original_text" not in exchanged and "target" not in plan


def test_suggestions_write_no_findings(spark, monkeypatch):
    monkeypatch.setattr(queue, "cut", None)
    plan = entry.queries()["suggest_fix"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "src_n" not in plan and "Exchange" in plan
