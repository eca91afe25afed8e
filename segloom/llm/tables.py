"""Written intermediate tables whose shuffle files go as soon as the table stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segloom.plans.cut import cut, released  # noqa: F401


def drop(df: DataFrame) -> None:
    """Delete the table that ``cut`` wrote for ``df``; nothing may read it any more."""
    jvm, files = df.sparkSession._jvm, df.inputFiles()
    if files:
        folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(files[0])).getParent()
        folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def row_key(docs: DataFrame) -> Column:
    """Hash of a whole row. With the document number it names a row; equal rows share it. Maps hash as strings."""
    return F.xxhash64(*[
        F.col(f"`{f.name}`").cast("string") if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema
    ])


def without(docs: DataFrame, gone: DataFrame, doc: str = "doc_id", how: str = "left_anti") -> DataFrame:
    """Rows of ``docs`` whose number and key are not in ``gone`` (columns ``doc_id, key``)."""
    keyed = docs.withColumn("__key", row_key(docs))
    return keyed.join(
        gone.select(F.col("doc_id").alias("__gone"), F.col("key").alias("__gone_key")),
        (F.col("__key") == F.col("__gone_key")) & F.col(doc).eqNullSafe(F.col("__gone")), how,
    ).drop("__key")


def within(docs: DataFrame, chosen: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose number and key are in ``chosen``."""
    return without(docs, chosen, doc, "left_semi")
