"""XML report sink (S-14): FOR XML PATH('Query'), ROOT('Queries'), ELEMENTS."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def write_xml_report(df: DataFrame, path: str, root_tag: str = "Queries",
                     row_tag: str = "Query", mode: str = "overwrite",
                     single_document: bool = False) -> str:
    """Write ``df`` as XML, one element per row, columns as child elements.

    Each output part is a complete document with the root element; the write is one job
    that commits atomically through the output committer, so a lost executor only reruns
    its tasks. By default the data is never gathered into one task. ``single_document``
    writes one file (one task): only for reports of bounded size, such as a day's
    distinct statements, where one document is what the reader expects.
    """
    out = df.coalesce(1) if single_document else df
    (out.write.mode(mode).option("rootTag", root_tag).option("rowTag", row_tag)
        .option("nullValue", "").xml(path))
    return path


def read_xml_report(spark: SparkSession, path: str, schema: T.StructType,
                    row_tag: str = "Query") -> DataFrame:
    """Read a report written by :func:`write_xml_report` back with a fixed schema."""
    return spark.read.schema(schema).option("rowTag", row_tag).xml(path)
