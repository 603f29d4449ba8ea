"""Cursors: a result set page by page, in the order of a key.

Scrolling types: forward-only, scrollable, random. Operation modes:

- dynamic: every page looks at the table as it is now, after the key of the last row seen; forward only, no counting.
- indexed: the keys of the start are kept, in order and numbered; a page joins its keys to the table as it is now, so it
  shows changed rows and leaves out deleted and new ones.
- static: all rows of the start are kept, in order and numbered; counts, and sorts by any columns.

Numbers come from a range sort, so files hold neighbouring rows and a page reads only the files of its numbers. A page is
a DataFrame of at most the page's rows; a position is a small text that opens the cursor again at the same place.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.arrays import number_rows
from lumenframe.storage import discard, materialize

SCROLLING, MODES = ("forward-only", "scrollable", "random"), ("dynamic", "indexed", "static")
_ROW = "__row"


def parse_mode(mode: str) -> tuple[str, str]:
    """Scrolling type and operation mode of a text that names either, both or none; forward-only and dynamic otherwise."""
    words = mode.split()
    if unknown := [w for w in words if w not in SCROLLING + MODES]:
        raise ValueError(f"unknown cursor mode {unknown[0]!r}")
    pick = lambda names: next((w for w in words if w in names), names[0])
    scroll, kind = pick(SCROLLING), pick(MODES)
    if scroll != "forward-only" and kind == "dynamic":
        raise ValueError(f"a {scroll} cursor is indexed or static")
    return scroll, kind


class Cursor:
    """key: columns that tell rows apart; order: columns to sort by before the key (static cursors only)."""

    def __init__(self, table: DataFrame | Callable[[], DataFrame], key: Sequence[str], mode: str = "", order: Sequence[str] = (), where: Column | None = None, position: str | None = None, seed: int = 0):
        self.scroll, self.kind = parse_mode(mode)
        if order and self.kind != "static":
            raise ValueError("only static cursors sort rows")
        self.read = table if callable(table) else lambda: table
        self.key, self.where, self.seed = list(key), where, seed
        self.order = [*order, *(k for k in key if k not in order)]
        self.at, self.last, self.turns, self.rows = 0, None, 0, None
        if self.kind != "dynamic":
            held = self._live() if self.kind == "static" else self._live().select(*self.key)
            self.rows = materialize(number_rows(held, self.order, _ROW), "cursor")
        if position is not None:
            state = json.loads(position)
            self.at, self.last, self.turns = state["at"], state["last"], state["turns"]

    def _live(self) -> DataFrame:
        df = self.read()
        return df if self.where is None else df.where(self.where)

    def position(self) -> str:
        """Where the cursor stands; key values are kept as text."""
        return json.dumps({"at": self.at, "last": self.last, "turns": self.turns})

    def count(self) -> int:
        if self.kind != "static":
            raise ValueError("only static cursors count rows")
        return self.rows.count()

    def fetch(self, size: int) -> DataFrame:
        """The next rows, at most so many; a random cursor draws so many with replacement."""
        if size < 0 or (size == 0 and self.scroll == "random"):
            raise ValueError("a page has at least one row")
        if self.scroll == "random":
            return self._draw(size)
        if self.kind == "dynamic":
            return self._after(size)
        page = self._numbers(self.at, self.at + size)
        self.at += size
        return page

    def scroll_to(self, row: int) -> Cursor:
        """Stand before a row by its number from 0."""
        if self.scroll != "scrollable":
            raise ValueError(f"a {self.scroll} cursor does not scroll")
        self.at = max(0, row)
        return self

    def scroll_by(self, rows: int) -> Cursor:
        return self.scroll_to(self.at + rows)

    def pages(self, size: int) -> DataFrame:
        """(page, first, rows): the number of the first row of every page, for scroll_to, and its size."""
        if self.kind == "dynamic":
            raise ValueError("pages of a dynamic cursor are not known")
        page = F.floor(F.col(_ROW) / size)
        return self.rows.groupBy(page.alias("page")).agg(F.min(_ROW).alias("first"), F.count("*").alias("rows"))

    def close(self) -> None:
        if self.rows is not None:
            discard(self.rows)

    def _numbers(self, low: int, high: int) -> DataFrame:
        page = self.rows.where((F.col(_ROW) >= low) & (F.col(_ROW) < high))
        if self.kind == "indexed":  # the page's keys, a bounded number, to the rows as they are now
            page = self._live().join(F.broadcast(page), self.key)
        return page.orderBy(_ROW).drop(_ROW)

    def _after(self, size: int) -> DataFrame:
        df = self._live()
        if self.last is not None:
            values = [F.lit(v).cast(df.schema[k].dataType) for k, v in zip(self.key, self.last, strict=True)]
            later = [reduce(Column.__and__, [F.col(k) == v for k, v in zip(self.key[:n], values[:n], strict=True)], F.col(self.key[n]) > values[n]) for n in range(len(values))]
            df = df.where(reduce(Column.__or__, later))
        page = materialize(df.orderBy(*self.key).limit(size), "page")  # the rows that were seen, whatever happens to the table
        end = page.orderBy(*(F.desc(k) for k in self.key)).select(*(F.col(k).cast("string") for k in self.key)).first()
        if end is not None:
            self.last = list(end)
        return page

    def _draw(self, size: int) -> DataFrame:
        n, self.turns = self.rows.count(), self.turns + 1
        spark = self.rows.sparkSession
        draws = spark.range(size if n else 0).select(F.col("id").alias("__draw"), F.pmod(F.xxhash64("id", F.lit(self.turns), F.lit(self.seed)), F.lit(max(n, 1))).alias(_ROW))
        drawn = self.rows.join(draws, _ROW)
        if self.kind == "indexed":
            drawn = self._live().join(drawn.drop(_ROW), self.key)
        return drawn.orderBy("__draw").drop(_ROW, "__draw")
