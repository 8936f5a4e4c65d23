"""Hooks that run when a stream starts, makes progress, goes idle or ends, and streams that resume."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

EVENTS = ("started", "progress", "idle", "ended")


class Hooks(StreamingQueryListener):
    """Named callbacks by event, in the order in which they were added; add it with spark.streams.addListener."""

    def __init__(self) -> None:
        self._own: dict[str, dict[str, Callable]] = defaultdict(dict)

    def on(self, event: str, callback: Callable, name: str = "") -> None:
        """Adds a callback under a name, or its own; a name that is there already is replaced."""
        if event not in EVENTS:
            raise ValueError(f"{event} is none of {', '.join(EVENTS)}")
        self._own[event][name or callback.__name__] = callback

    def off(self, event: str, name: str) -> None:
        self._own[event].pop(name, None)

    def registered(self, event: str) -> list[str]:
        return list(self._own[event])

    def _run(self, event: str, said) -> None:
        for callback in list(self._own[event].values()):
            callback(said)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._run("started", event)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self._run("progress", event.progress)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self._run("idle", event)

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._run("ended", event)


def resumed(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", every: str | None = None) -> StreamingQuery:
    """Writes a stream as Parquet from where its checkpoint left off, all there is or every so often."""
    writer = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start(out)
