"""Watching a folder: a streaming source of its changes, and the events that an update of the index gives."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from skein.functions.glob import matches_any
from skein.sources.discovery import EXCLUDED, entries
from skein.streaming import live

#: Fixed value: paths that an event names at most.
SHOWN = 20
#: Folders of this depth and what is below them are a partition each.
SPREAD = 2


class _Folder(InputPartition):
    def __init__(self, folder: str, deep: bool, since: int, until: int):
        self.folder, self.deep, self.since, self.until = folder, deep, since, until


class _Reader(DataSourceStreamReader):
    """Offsets are times of listings in milliseconds; the events between two are what has changed between them.

    Tasks list the folders, one partition for each down to ``SPREAD``. A file that is gone shows as a change of its folder,
    which whoever updates the index compares with it anyway, so the source keeps no listing."""

    def __init__(self, root: str, since: int | None = None):
        self.root, self.since = root, since

    def initialOffset(self) -> dict:
        return {"until": int(time.time() * 1000) if self.since is None else self.since}

    def latestOffset(self) -> dict:
        return {"until": int(time.time() * 1000)}

    def partitions(self, start: dict, end: dict) -> list[_Folder]:
        level, out = [""], []
        for _ in range(SPREAD):
            out += [_Folder(f, False, start["until"], end["until"]) for f in level]
            level = [path for f in level for path, folder, _, _ in entries(self.root, f) if folder]
        return out + [_Folder(f, True, start["until"], end["until"]) for f in level]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        from datetime import datetime, timezone

        row = lambda path, kind, ms: (self.root, path, kind, datetime.fromtimestamp(ms / 1000, timezone.utc), int(ms))
        level = [partition.folder]
        while level:
            below = []
            for folder in level:
                try:
                    own = os.stat(os.path.join(self.root, folder)).st_mtime * 1000
                except OSError:
                    continue
                if partition.since < own <= partition.until:
                    yield row(folder or ".", "folder", own)
                for path, is_folder, _, ms in entries(self.root, folder):
                    if is_folder:
                        below.append(path)
                    elif partition.since < ms <= partition.until:
                        yield row(path, "update", ms)
            level = below if partition.deep else []


class FolderEvents(DataSource):
    """``spark.readStream.format("skein-folder").load(path)``: root, path, type, ts, event_id of what changes below a folder.

    Option ``since``: the time in milliseconds from which a new stream tells changes, by default that of its start."""

    @classmethod
    def name(cls) -> str:
        return "skein-folder"

    def schema(self) -> str:
        return "root string, path string, type string, ts timestamp, event_id long"

    def streamReader(self, schema) -> _Reader:
        since = self.options.get("since")
        return _Reader(self.options["path"].removeprefix("file://").rstrip("/"), int(since) if since else None)


def shown(paths: list[str]) -> dict:
    return {"filePaths": paths[:SHOWN], "totalFiles": len(paths), "complete": len(paths) <= SHOWN}


class Listener(StreamingQueryListener):
    """Tells when the stream of one name begins, fails and ends."""

    def __init__(self, name: str, root: str, emit: Callable[[dict], None]):
        self.name, self.root, self.emit, self.id = name, root, emit, None

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.id = event.id

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.id == self.id:
            if event.exception:
                self.emit({"event": "error", "code": "watch_subscription_failed", "message": event.exception.split("\n")[0]})
            self.emit({"event": "stopped", "workspaceRoot": self.root})


def lines(out) -> Callable[[dict], None]:
    """Events as lines of JSON."""
    return lambda event: (out.write(json.dumps(event, sort_keys=True) + "\n"), out.flush())[0]


def watch(workspace, emit: Callable[[dict], None], checkpoint: str, quiet: int = live.QUIET_MS, longest: int = live.LONGEST_MS) -> StreamingQuery:
    """Keep the index of a workspace up to date until the returned query is stopped.

    Events: ready once the index is fresh; updating and updated, or error, for each batch of changes; stopped. An update
    that fails is told, and the next batch brings what it has missed, as an update compares all files with the index."""
    spark, root = workspace.spark, workspace.root
    spark.dataSource.register(FolderEvents)
    name = f"watch-{time.time_ns()}"
    spark.streams.addListener(Listener(name, root, emit))
    spark.conf.set(*live.STATE_STORE)
    since = int(time.time() * 1000)  # what changes while the index is made, or before the stream has begun, is told too
    workspace.update()
    emit({"event": "ready", "workspaceRoot": root, "indexedFiles": workspace.cache.counts()["files"]})
    never = [*EXCLUDED, *workspace.settings.filter_patterns]
    changes = spark.readStream.format("skein-folder").option("since", since).load(root).where(~matches_any(F.col("path"), never, "full"))

    def apply(batch: DataFrame, number: int) -> None:
        # a few paths to show and their number; the update finds out itself what has changed
        paths = batch.select("path").distinct().persist()  # the state behind it may be read once
        try:
            run(paths)
        finally:
            paths.unpersist()

    def run(paths: DataFrame) -> None:
        count = paths.count()
        if not count:
            return
        told = {"filePaths": [r[0] for r in paths.orderBy("path").limit(SHOWN).collect()], "totalFiles": count, "complete": count <= SHOWN}
        began = time.monotonic()
        try:
            emit({"event": "updating", **told})
            done = workspace.update()
            emit({"event": "updated", "durationMs": round((time.monotonic() - began) * 1000), "changed": done is not None, **told})
        except Exception as e:
            emit({"event": "error", "code": "watch_update_failed", "message": str(e).split("\n")[0], **told})

    writer = live.debounced(changes, quiet, longest).writeStream.queryName(name).foreachBatch(apply).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=live.QUIET).start()
