"""What stands around the rows of a report."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Row


@dataclass(frozen=True)
class Frame:
    """head, rows as `item` writes them, with `between` from one to the next, tail; lead: before each row. none: follows the
    head where there are no rows."""

    head: str
    tail: str
    between: str
    item: Callable[[Row], str]
    none: str
    lead: str = ""

    def chunks(self, rows: Iterable[Row]) -> Iterator[str]:
        yield self.head
        empty = True
        for r in rows:
            yield ("" if empty else self.between) + self.lead + self.item(r)
            empty = False
        yield self.none if empty else self.tail
