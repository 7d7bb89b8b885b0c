"""Table functions for SQL: generators of several rows from one value."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="at: int, chunk: string")
class TextChunks:
    """Overlapping windows of so many words; the last one reaches the end. A null or blank text gives no row."""

    def eval(self, text: str, size: int, stride: int) -> Iterator[tuple[int, str]]:
        words, at, k = (text or "").split(), 0, 0
        while words and (k == 0 or at + size - stride < len(words)):
            yield k, " ".join(words[at : at + size])
            at, k = at + stride, k + 1


@udtf(returnType="at: int, xml: string")
class XmlRecords:
    """The elements of one name in a batch of XML, each as XML of its own."""

    def eval(self, batch: str, name: str) -> Iterator[tuple[int, str]]:
        for k, element in enumerate(ET.fromstring(batch).iter(name) if batch else ()):
            element.tail = None
            yield k, ET.tostring(element, encoding="unicode")


def register(spark: SparkSession) -> None:
    """Make text_chunks(text, size, stride) and xml_records(batch, name) known to SQL."""
    spark.udtf.register("text_chunks", TextChunks)
    spark.udtf.register("xml_records", XmlRecords)
