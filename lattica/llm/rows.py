"""Which rows are one document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def identified(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, h, text).

    Documents are known, and stand in order, by (doc_id, h): null ids first, and h the text's XXH64
    wherever a doc_id comes more than once, so that rows that share an id with different texts (or have none) are
    documents of their own.  Rows that repeat both are copies of one document.  Where all ids are different h is zero
    and takes no room.
    """
    texts = docs.select("doc_id", "text")
    unique = texts.groupBy("doc_id").count().where("count > 1").isEmpty()
    return texts.select("doc_id", (F.lit(0).cast("long") if unique else F.xxhash64("text")).alias("h"), "text")
