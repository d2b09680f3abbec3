"""Tables that micro-batches add to, kept in few parts: small ones are merged into larger ones, generation by generation.

A part is a folder ``span=first-last`` of the batches it holds. Which parts make up the table after batch ``n`` is said by the marker
``_parts/n``, a small text that is renamed into place when all the parts are there. So

* a batch that broke off before its marker has changed nothing: it runs again and replaces its own folders;
* a batch whose marker is there is done: when the stream runs it again, nothing is written;
* whoever reads the table takes the last marker and the parts it names, which no later batch changes. Parts that a merge
  replaced are deleted ``GRACE`` batches later.

``FAN_IN`` neighbours of equal span become one part, so after n batches there are at most (FAN_IN - 1) x log(n) parts, and
a row is written again once for each generation.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from tillbook.sources import files

FAN_IN, GRACE = 8, 4
Span = tuple[int, int]


@dataclass(frozen=True)
class State:
    """The table after a batch (-1: before the first): its spans, and what the writer noted."""

    batch: int = -1
    spans: tuple[Span, ...] = ()
    note: dict = field(default_factory=dict)


def merged_spans(spans: Sequence[Span], fan_in: int = FAN_IN) -> tuple[Span, ...]:
    """``spans`` with every ``fan_in`` last ones of equal length made one, again and again."""
    out = list(spans)
    while len(out) >= fan_in and len({last - first for first, last in out[-fan_in:]}) == 1:
        out[-fan_in:] = [(out[-fan_in][0], out[-1][1])]
    return tuple(out)


class Generations:
    """The parts below ``path``. ``owner`` names the stream that writes them; two streams can't write to one path."""

    def __init__(self, spark: SparkSession, path: str, owner: str = "", fan_in: int = FAN_IN, grace: int = GRACE):
        self.spark, self.path, self.owner, self.fan_in, self.grace = spark, path, owner, fan_in, grace

    def folder(self, span: Span) -> str:
        return f"{self.path}/span={span[0]}-{span[1]}"

    def folders(self, state: State) -> list[str]:
        return [self.folder(span) for span in state.spans]

    def _markers(self) -> list[int]:
        return sorted(int(name) for name in files.names(self.spark, f"{self.path}/_parts") if name.isdigit())

    def _state(self, batch: int) -> State:
        said = json.loads(files.read_text(self.spark, f"{self.path}/_parts/{batch}"))
        if self.owner and said["owner"] != self.owner:
            raise ValueError(f"another stream writes to {self.path}")
        return State(batch, tuple(map(tuple, said["spans"])), said["note"])

    def latest(self) -> State:
        """The table now; empty before the first batch."""
        there = self._markers()
        return self._state(there[-1]) if there else State()

    def done(self, batch: int) -> bool:
        """Whether the batch is part of the table already, because the stream runs it again."""
        last = self.latest().batch
        if last > batch or (last < batch - 1):
            raise ValueError(f"{self.path} holds batches up to {last}; batch {batch} can't follow")
        return last == batch

    def add(self, batch: int, write: Callable[[str], dict | None], merge: Callable[[list[str], str], None]) -> State:
        """Add what ``write`` puts into the folder it is given, with the note it returns, after all earlier batches.

        ``merge`` writes what the folders of its first argument hold into that of its second. Both replace what is there.
        """
        if self.done(batch):
            return self.latest()
        own = (batch, batch)
        note = write(self.folder(own)) or {}
        before = (*self.latest().spans, own)
        spans = merged_spans(before, self.fan_in)
        if spans[-1] != own:
            merge([self.folder(span) for span in before if span[0] >= spans[-1][0]], self.folder(spans[-1]))
        self._mark(batch, {"owner": self.owner, "spans": spans, "note": note})
        self._clear(batch)
        return State(batch, spans, note)

    def _mark(self, batch: int, said: dict) -> None:
        files.write_text(self.spark, f"{self.path}/_parts/{batch}", json.dumps(said))

    def _clear(self, batch: int) -> None:
        """Markers older than ``grace`` batches go, and with them the parts that no marker names any more."""
        kept: set[Span] = set()
        for marker in self._markers():
            if marker < batch - self.grace:
                files.delete(self.spark, f"{self.path}/_parts/{marker}")
            else:
                kept.update(self._state(marker).spans)
        keep = {self.folder(span).rpartition("/")[2] for span in kept}
        for name in files.names(self.spark, self.path):
            if name.startswith("span=") and name not in keep:
                files.delete(self.spark, f"{self.path}/{name}")
