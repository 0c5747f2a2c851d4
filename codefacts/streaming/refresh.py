"""A streaming wrapper of the incremental refresh: arriving files trigger it, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine


def watch(engine: Engine, checkpoint: str, on_change: Callable[[DataFrame], None] | None = None, once: bool = True) -> StreamingQuery:
    """Refresh the engine whenever new or changed sources arrive under its root.

    The file stream only says that something changed; the refresh compares content, so a batch that
    is replayed after a failure changes nothing. ``once`` handles what is there and stops.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = engine.spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.rs").load(f"file://{engine.root}")

    def handle(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        changed = engine.refresh()
        if on_change:
            on_change(changed)

    stream = files.select("path").writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream.trigger(processingTime="10 seconds")).start()
