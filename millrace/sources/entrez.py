"""A Spark data source for E-utilities style services: one partition per day, bounded retries, batched XML."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from datetime import date, timedelta

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MOST = 9999  # rows that one query of the abstracts' database gives
#: The answers that a later try may mend, and the dates that a query can go by.
RETRY = {400, 408, 429, 500, 502, 503, 504}
DATES = ("pdat", "crdt", "edat")


class Day(InputPartition):
    def __init__(self, day: str):
        self.day = day


def days(start: str, end: str) -> list[str]:
    a, b = date.fromisoformat(start.replace("/", "-")), date.fromisoformat(end.replace("/", "-"))
    if b < a:
        raise ValueError("the last day comes before the first")
    return [(a + timedelta(n)).isoformat() for n in range((b - a).days + 1)]


def request(url: str, fields: dict[str, str], tries: int = 5, wait: float = 1.0, send: Callable | None = None, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """POST with bounded exponential waits; Retry-After is honoured, and errors that a retry can't mend are raised."""
    body = urllib.parse.urlencode(fields).encode()
    send = send or (lambda u, b: urllib.request.urlopen(u, b, timeout=60).read())
    for n in range(tries):
        try:
            return send(url, body)
        except urllib.error.HTTPError as e:
            if e.code not in RETRY or n == tries - 1:
                raise
            after = e.headers.get("Retry-After") if e.headers else None
            sleep(float(after) if after and after.isdigit() else wait * 2**n)
        except urllib.error.URLError:
            if n == tries - 1:
                raise
            sleep(wait * 2**n)
    raise AssertionError("unreachable")


class EntrezReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        for name in ("url", "db", "term", "start", "end"):
            if not options.get(name):
                raise ValueError(f"option {name} is needed")
        self.options = dict(options)
        if self.options.get("datetype", "pdat").lower() not in DATES or self.options.get("overflow", "error") not in ("error", "truncate"):
            raise ValueError(f"datetype must be one of {', '.join(DATES)}, overflow error or truncate")

    def partitions(self) -> list[Day]:
        return [Day(d) for d in days(self.options["start"], self.options["end"])]

    def read(self, partition: Day) -> Iterator[tuple[str, int, str]]:
        o, day = self.options, partition.day.replace("-", "/")
        common = {"db": o["db"], "tool": o.get("tool", "millrace")} | ({"api_key": o["key"]} if o.get("key") else {})
        found = json.loads(request(f"{o['url']}/esearch.fcgi", common | {"term": o["term"], "mindate": day, "maxdate": day, "datetype": o.get("datetype", "pdat").lower(), "usehistory": "y", "retmode": "json", "retmax": "0"}))["esearchresult"]
        count, size = int(found["count"]), int(o.get("batch", "200"))
        if o["db"] == "pubmed" and count > MOST:
            if o.get("overflow", "error") == "error":
                raise ValueError(f"{day} has {count} rows, more than a query gives: narrow the term")
            count = MOST  # the first ones of the day, as asked for
        for at in range(0, count, size):
            xml = request(f"{o['url']}/efetch.fcgi", common | {"query_key": found["querykey"], "WebEnv": found["webenv"], "retstart": str(at), "retmax": str(min(size, count - at)), "retmode": "xml"})
            yield partition.day, at, xml.decode()


class Entrez(DataSource):
    """spark.read.format("entrez").options(url=, db=, term=, start=, end=, [batch, key, datetype, overflow]): (day, batch_start, xml)."""

    @classmethod
    def name(cls) -> str:
        return "entrez"

    def schema(self) -> str:
        return "day string, batch_start long, xml string"

    def reader(self, schema) -> EntrezReader:
        return EntrezReader(self.options)
