"""Resumable runs: new clips are described as they arrive and appended to the cache, batch by batch."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame

from cutgrain.sources.cache import append


def describe_stream(clips: DataFrame, describe: Callable[[DataFrame], DataFrame], cache_path: str, checkpoint: str):
    """A streaming table of clips -> a started query that appends described clips to the cache folder, a part a batch.

    describe() gives records as record_lines() takes them. A batch that is replayed after a failure overwrites its own part, so
    no record appears twice; runs with other checkpoints have parts of their own.
    """
    run = zlib.crc32(checkpoint.encode())

    def write(batch: DataFrame, number: int) -> None:
        append(describe(batch), cache_path, f"r{run:08x}-{number:012d}")

    return clips.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
