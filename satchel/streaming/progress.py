"""What running streams have read so far."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql.streaming import StreamingQueryListener


@dataclass
class Progress(StreamingQueryListener):
    """Rows and batches of each query, by its name or id; add it with ``spark.streams.addListener``.

    An empty trigger is no batch, and a batch that is repeated after a restart counts again, as it is read again.
    """

    rows: dict[str, int] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)
    ended: dict[str, str | None] = field(default_factory=dict)
    _names: dict[str, str] = field(default_factory=dict)

    def onQueryStarted(self, event) -> None:
        name = event.name or str(event.id)
        self._names[str(event.id)] = name
        self.rows.setdefault(name, 0)
        self.batches.setdefault(name, 0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        name = p.name or str(p.id)
        if p.numInputRows:
            self.rows[name] = self.rows.get(name, 0) + p.numInputRows
            self.batches[name] = self.batches.get(name, 0) + 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[self._names.get(str(event.id), str(event.id))] = event.exception
