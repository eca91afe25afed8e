"""Glossary and rules files: CSV in and out, JSON in, rules in, signatures."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from functools import partial
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segloom.functions import text as T
from segloom.functions import values as V
from segloom.operators.glossary import duplicate_terms, spreadsheet_safe


def _sniff(text: str) -> str:
    """Most frequent of comma, tab, semicolon on the first line outside quotes."""
    plain, quoted = [], False
    for ch in text:
        if ch == '"':
            quoted = not quoted
        elif ch in "\r\n" and not quoted:
            break
        elif not quoted:
            plain.append(ch)
    return max([",", "\t", ";"], key=plain.count)


def _entries(text: str) -> list[tuple]:
    """Entries of one file (place among its rows that are not blank, source, target, notes), without the header."""
    csv.field_size_limit(1 << 30)
    text = text.removeprefix("\ufeff")
    found, pos = [], -1
    for row in csv.reader(io.StringIO(text, newline=""), delimiter=_sniff(text), strict=False):
        cells = [c.strip() for c in row[:3]]
        if not any(cells) and not any(c.strip() for c in row[3:]):
            continue
        pos += 1
        if len(cells) > 1 and cells[0] and cells[1]:
            found.append((pos, cells[0], cells[1], cells[2] or None if len(cells) > 2 else None))
    if found and found[0][1].lower() in V.HEADER_SOURCE and found[0][2].lower() in V.HEADER_TARGET:
        del found[0]
    return found


#: Files are handed on when they have about so many entries together.
_LOT = 20_000
_FILE = "path string, entries array<struct<pos:int,source:string,target:string,notes:string>>"


def _parsed(most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files (``path, value``) with their entries. However many files a batch has, only a lot of entries is held."""
    kinds = {"pos": pa.int32(), "source": pa.string(), "target": pa.string(), "notes": pa.string()}

    def lot(paths: list[str], listed: list[list[tuple]]) -> pa.RecordBatch:
        columns = list(zip(*(e for entries in listed for e in entries))) or [()] * 4
        flat = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], list(kinds))
        offsets = pa.array([0, *accumulate(map(len, listed))], pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.ListArray.from_arrays(offsets, flat)], ["path", "entries"])

    for batch in batches:
        paths, listed, held = [], [], 0
        for path, text in zip(batch["path"], batch["value"]):
            paths.append(path.as_py())
            listed.append(_entries(text.as_py() or ""))
            held += len(listed[-1])
            if held >= most:
                yield lot(paths, listed)
                paths, listed, held = [], [], 0
        if paths:
            yield lot(paths, listed)


def read_glossary_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV/TSV/semicolon glossaries, one or many files: ``path, pos, source, target, notes``.

    A glossary file is small by contract (the entry and term limits bound it), so a file is the
    unit of parallelism: quoted line breaks make record order a property of the whole file.
    """
    return glossary_records(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"))


def glossary_records(files: DataFrame) -> DataFrame:
    """``read_glossary_csv`` for files kept as rows (``path, value``), as millions of small uploads should be; nothing is exchanged."""
    return glossary_lists(files).select("path", F.inline("entries"))


def glossary_lists(files: DataFrame) -> DataFrame:
    """``glossary_records`` with one row per file, for callers that need a file's entries together: ``path, entries`` in the order of the file."""
    return files.select("path", "value").mapInArrow(partial(_parsed, _LOT), _FILE)


def write_glossary_csv(glossary: DataFrame, path: str) -> None:
    """Spreadsheet-safe CSV with BOM and all cells quoted; duplicate terms are refused.

    A glossary within the entry limit becomes one file. A larger one becomes ordered part files, written by as many tasks; the parts
    in the order of their names are the file, and only the first has the header.
    """
    if not duplicate_terms(glossary).isEmpty():
        raise ValueError("glossary has duplicate terms")
    lines = glossary_csv_lines(glossary)
    header = glossary.sparkSession.createDataFrame([(None, "\ufeff" + ",".join(V.EXPORT_HEADER))], "pos long, line string")
    ordered = header.unionByName(lines).orderBy(F.col("pos").asc_nulls_first())
    if glossary.limit(V.MAX_GLOSSARY_ENTRIES + 1).count() <= V.MAX_GLOSSARY_ENTRIES:
        ordered = ordered.coalesce(1)
    ordered.select("line").write.option("lineSep", "\r\n").text(path)


def glossary_csv_lines(glossary: DataFrame) -> DataFrame:
    """Guarded and quoted rows, ready for export: ``pos, line``."""
    return glossary.select(F.col("pos").cast("long").alias("pos"), csv_line("source", "target", "notes").alias("line"))


def csv_line(*cells) -> Column:
    """Guarded and quoted cells of one row."""
    safe = [spreadsheet_safe(F.coalesce(T.strip(c), F.lit(""))) for c in cells]
    return F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')) for c in safe])


def read_glossary_json(payloads: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Glossaries sent as ``{source: target}`` or as an array of pairs: ``id, pos, source, target``.

    Empty payloads give no rows; header-like terms are kept.
    """
    pair = "struct<source string, src string, target string, tgt string, dest string>"
    text = T.strip(json_col)
    as_map = F.transform(
        F.map_entries(F.from_json(F.when(F.startswith(text, F.lit("{")), text), "map<string,string>")),
        lambda e: F.struct(e["key"].alias("source"), e["value"].alias("target")),
    )
    as_list = F.transform(
        F.from_json(F.when(F.startswith(text, F.lit("[")), text), f"array<{pair}>"),
        lambda e: F.struct(
            F.coalesce(e["source"], e["src"]).alias("source"),
            F.coalesce(e["target"], e["tgt"], e["dest"]).alias("target"),
        ),
    )
    return payloads.select(id_col, F.posexplode(F.coalesce(as_map, as_list)).alias("pos", "e")).select(
        id_col, "pos", T.strip("e.source").alias("source"), T.strip("e.target").alias("target")
    ).filter("source <> '' and target <> ''")


_RULE = (
    "struct<id string, summary string, avoid array<string>, prefer array<string>, severity string, "
    "locked_term string, examples array<struct<bad string, good string>>>"
)
# Rule buckets and the bucket of each target language.
RULE_BUCKETS = ["kr_target_rules", "en_target_rules", "bidirectional"]
BUCKET_OF_TARGET = {"한국어": "kr_target_rules", "영어": "en_target_rules"}


def rules_from_json(docs: DataFrame, json_col: str, *keep: str) -> DataFrame:
    """Rules documents flattened to ``bucket, pos, rule fields``; documents without a bucket give none."""
    schema = ", ".join(f"{b} array<{_RULE}>" for b in RULE_BUCKETS)
    parsed = docs.select(*keep, F.from_json(json_col, schema).alias("d"))

    def tagged(bucket: str):
        return F.transform(
            F.coalesce(F.col(f"d.{bucket}"), F.array().cast(f"array<{_RULE}>")),
            lambda r, i: F.struct(F.lit(bucket).alias("bucket"), i.alias("pos"), r.alias("rule")),
        )

    stacked = F.concat(*[tagged(b) for b in RULE_BUCKETS])
    return parsed.select(*keep, F.explode(stacked).alias("x")).select(*keep, "x.bucket", "x.pos", "x.rule.*")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules files under ``path``; a file without any known bucket is an error."""
    files = spark.read.text(path, wholetext=True)
    schema = ", ".join(f"{b} array<{_RULE}>" for b in RULE_BUCKETS)
    present = F.lit(False)
    for bucket in RULE_BUCKETS:
        present = present | F.col(f"d.{bucket}").isNotNull()
    known = files.select(F.from_json("value", schema).alias("d")).filter(present)
    if known.limit(1).count() == 0:
        raise ValueError("a rules file needs at least one of " + ", ".join(RULE_BUCKETS))
    return rules_from_json(files, "value")


def _applicable(rules: DataFrame, target_lang: str) -> DataFrame:
    own = BUCKET_OF_TARGET.get(target_lang)
    order = F.when(F.col("bucket") == F.lit(own or ""), 0).otherwise(1)
    return rules.filter(F.col("bucket").isin(*([own] if own else []), "bidirectional")).withColumn("__dir", order)


def format_rules(rules: DataFrame, target_lang: str, *by: str) -> DataFrame:
    """Guidance text of the rules for a direction; ``None`` when no rule has a summary."""
    def joined(c: str):
        kept = F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), T.strip), lambda x: x != "")
        return F.coalesce(F.nullif(F.array_join(kept, ", "), F.lit("")), F.lit("—"))

    avoid, prefer = joined("avoid"), joined("prefer")
    bad, good = T.strip(F.try_element_at("examples", F.lit(1))["bad"]), T.strip(F.try_element_at("examples", F.lit(1))["good"])
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("- "), T.strip("summary")),
        F.when(~((avoid == "—") & (prefer == "—")), F.concat(F.lit("  avoid: "), avoid, F.lit(" → use: "), prefer)),
        F.when(F.coalesce("locked_term", F.lit("")) != "", F.concat(F.lit("  [LOCKED TERM, use exactly: "), "locked_term", F.lit("]"))),
        F.when(
            (F.col("severity") == "red") & (bad != "") & (good != ""),
            F.concat(F.lit('  e.g. "'), bad, F.lit('" → "'), good, F.lit('"')),
        ),
    )
    shown = F.when(~T.is_blank("summary"), F.struct("__dir", "pos", text.alias("text")))
    listed = _applicable(rules, target_lang).groupBy(*by).agg(
        F.array_sort(F.collect_list(shown)).alias("l")
    )
    return listed.select(
        *by, F.lit(target_lang).alias("target_lang"),
        F.coalesce(F.nullif(F.array_join("l.text", "\n"), F.lit("")), F.lit("None")).alias("text"),
    )


def locked_terms(rules: DataFrame, target_lang: str, *by: str) -> DataFrame:
    """Exact terms demanded by red rules: ``rule_id, term, pos``; a repeated id keeps its last term."""
    red = _applicable(rules, target_lang).filter(
        (F.col("severity") == "red") & (F.coalesce("locked_term", F.lit("")) != "")
    )
    place = (F.col("__dir") * 1000000 + F.col("pos")).cast("long")
    return red.groupBy(*by, F.coalesce("id", "locked_term").alias("rule_id")).agg(
        F.max_by("locked_term", place).alias("term"), F.min(place).alias("pos")
    )


_ZIP, _OLE2 = "504B0304", "D0CF11E0A1B11AE1"
#: Files that Spark's text reader would unpack.
_PACKED = r"(?i)\.(gz|gzip|bz2|deflate|snappy|lz4|zst|zstd)$"


def file_signature_filter(files: DataFrame) -> DataFrame:
    """Classify binary files by their first bytes: ``format`` and ``valid``."""
    head = F.hex(F.substring("content", 1, 8))
    kind = F.when(F.startswith(head, F.lit(_ZIP)), "zip").when(head == _OLE2, "ole2")
    return files.withColumn("format", kind).withColumn("valid", F.col("format").isNotNull())


def file_signatures(spark: SparkSession, path: str) -> DataFrame:
    """``file_signature_filter`` of the files under ``path`` without their contents: ``path, length, format, valid``.

    Files are read as lines, in splits, so that a large one is many tasks: neither signature has a line feed, so it lies in
    the first line, the one with the smallest row number of the split that begins the file. The reader leaves out a byte order mark,
    which the lengths show. Files that the reader would unpack are read whole.
    """
    at, size = F.col("_metadata.file_path"), F.col("_metadata.file_size")
    listed = spark.read.format("binaryFile").load(path).select("path", "length", at.alias("__at"))
    plain = ~F.col("_metadata.file_name").rlike(_PACKED)
    head = F.hex(F.substring(F.col("value").cast("binary"), 1, 8))
    kind = F.when(F.startswith(head, F.lit(_ZIP)), 1).when(head == _OLE2, 2).otherwise(0)
    # row number and kind in one number, whose least is that of the first line
    lines = spark.read.text(path, lineSep="\n").filter(plain).select(
        at.alias("__at"), size.alias("__size"), (F.octet_length("value") + 1).cast("long").alias("__bytes"),
        F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id() * 4 + kind).alias("__first"),
    )
    seen = lines.groupBy("__at", "__size").agg(F.sum("__bytes").alias("__bytes"), F.min("__first").alias("__first"))
    told = seen.filter(F.col("__bytes") >= F.col("__size")).select("__at", (F.col("__first") % 4).alias("__kind"))
    packed = spark.read.format("binaryFile").load(path).filter(~plain)
    whole = file_signature_filter(packed.withColumn("__at", at)).select(
        "__at", F.when(F.col("format") == "zip", 1).when(F.col("format") == "ole2", 2).otherwise(0).cast("long").alias("__kind")
    )
    found = listed.join(told.unionByName(whole), "__at", "left")
    named = F.when(F.col("__kind") == 1, "zip").when(F.col("__kind") == 2, "ole2")
    return found.withColumn("format", named).withColumn("valid", F.col("format").isNotNull()).select("path", "length", "format", "valid")
