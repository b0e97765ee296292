"""Sinks for assembled results."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sutur.operators.assembly import document_json


def write_text_results(documents: DataFrame, path: str, text: str = "document_text", overwrite: bool = False) -> None:
    """Assembled texts, one row per document; Spark's commit protocol makes the folder appear at once."""
    documents.select(text).write.mode("overwrite" if overwrite else "errorifexists").option("lineSep", "\n").text(path)


def write_json_results(documents: DataFrame, path: str, overwrite: bool = False) -> None:
    """One JSON object with sorted names per document."""
    document_json(documents, pretty=False).write.mode("overwrite" if overwrite else "errorifexists").text(path)


@F.pandas_udf(StringType())
def _indented(records: pd.Series) -> pd.Series:
    return pd.Series([json.dumps(json.loads(r), ensure_ascii=False, indent=2, sort_keys=True) for r in records], dtype=object)


def document_record(documents: DataFrame) -> Column:
    """A row as readable JSON: indented, names sorted, nulls kept, text not escaped."""
    return _indented(F.to_json(F.struct(*documents.columns), {"ignoreNullFields": "false"}))


def _write_each(values: DataFrame, path: str, overwrite: bool) -> None:
    values.write.mode("overwrite" if overwrite else "errorifexists").option("lineSep", "\n").partitionBy("document").text(path)


def write_text_documents(documents: DataFrame, path: str, key: str = "document", text: str = "document_text", overwrite: bool = False) -> None:
    """The text of every document and an end of line, in a file of its own under ``document=<key>``; keys are unique."""
    _write_each(documents.select(F.col(key).alias("document"), F.col(text).alias("value")), path, overwrite)


def write_json_documents(documents: DataFrame, path: str, key: str = "document", overwrite: bool = False) -> None:
    """The record of every document and an end of line, in a file of its own under ``document=<key>``; keys are unique."""
    _write_each(documents.select(F.col(key).alias("document"), document_record(documents).alias("value")), path, overwrite)
