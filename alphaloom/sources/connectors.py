"""A data source for providers that are asked symbol by symbol and date range by date range.

    spark.dataSource.register(ProviderSource)
    spark.read.format("provider").option("fetch", "my_module:daily").option("symbols", "000001,600000").option("start", "2020-01-01").option("end", "2024-12-31").schema(...).load()

A partition is one symbol and one range of years, so a lost executor repeats only its own requests. `fetch(symbol, start, end)` yields
rows as tuples of the schema.

Options: tries and wait (seconds) of a request that fails to connect; on_failure "raise" (the default) or "skip", which gives no rows for a request
that failed as often as it may; and cache, a folder that all executors mount, where finished requests are kept, so that a later read asks for
the others only. A request is kept whole or not at all.
"""

from __future__ import annotations

import importlib
import os
import pickle
import time
from datetime import date, timedelta

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def ranges(start: date, end: date, years: int = 12) -> list[tuple[date, date]]:
    out = []
    while start <= end:
        after = start.replace(year=start.year + years, day=min(start.day, 28) if start.month == 2 else start.day)
        out.append((start, min(after - timedelta(days=1), end)))
        start = after
    return out


class Request(InputPartition):
    def __init__(self, symbol: str, start: date, end: date):
        self.symbol, self.start, self.end = symbol, start, end


class ProviderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}

    def partitions(self):
        o = self.options
        spans = ranges(date.fromisoformat(o["start"]), date.fromisoformat(o["end"]), int(o.get("years", 12)))
        return [Request(s.strip(), a, b) for s in o["symbols"].split(",") if s.strip() for a, b in spans]

    def read(self, partition: Request):
        kept = self.options.get("cache")
        page = os.path.join(kept, f"{partition.symbol}-{partition.start}-{partition.end}.page") if kept else None
        if page and os.path.exists(page):
            with open(page, "rb") as f:
                yield from pickle.load(f)
            return
        rows = self._asked(partition)
        if rows is None:
            return
        if page:
            os.makedirs(kept, exist_ok=True)
            part = f"{page}.{os.getpid()}"
            with open(part, "wb") as f:
                pickle.dump(rows, f)
            os.replace(part, page)
        yield from rows

    def _asked(self, request: Request) -> list | None:
        """The rows of a request, asked for until it connects; None if it never does and may be skipped."""
        module, _, name = self.options["fetch"].partition(":")
        fetch = getattr(importlib.import_module(module), name)
        tries = int(self.options.get("tries", 3))
        for k in range(tries):
            try:
                return list(fetch(request.symbol, request.start, request.end))
            except ConnectionError:
                if k == tries - 1:
                    if self.options.get("on_failure", "raise") == "skip":
                        return None
                    raise
                time.sleep(float(self.options.get("wait", 60)))
        return None


class ProviderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "provider"

    def reader(self, schema) -> ProviderReader:
        return ProviderReader(self.options)
