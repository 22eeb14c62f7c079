"""A streaming source that polls an event log behind a cursor.

The log is a folder of JSON lines files, each in the order of seq. The offset of the stream is the
last seq taken. As a reader of a ring buffer would, the source gives the last ring events at most: what is older
than that when a trigger plans is gone. A stream that restarts goes on behind its checkpoint's offset.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Events that the ring holds; bytes read at a time from a file's end to find its last line.
RING, TAIL = 4000, 1 << 16
FIELDS = "seq long, type string, run_id string, site string, status string, stage string, rank int, processed int, total int, timestamp string, payload string"


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _seq(line: bytes) -> int | None:
    try:
        value = json.loads(line)
    except ValueError:
        return None
    return value.get("seq") if isinstance(value, dict) and isinstance(value.get("seq"), int) else None


class Part(InputPartition):
    def __init__(self, path: str, after: int, upto: int) -> None:
        self.path, self.after, self.upto = path, after, upto


class CursorReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.root, self.ring, self.names = options["path"], int(options.get("ring", RING)), schema.names

    def _files(self) -> list[str]:
        from pyarrow import fs

        system, root = _opened(self.root)
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted(f.path for f in found if f.is_file and f.base_name.endswith((".json", ".jsonl")) and f.size)

    def _last(self, path: str) -> int:
        """seq of the last whole line of a file, read from its end."""
        system, _ = _opened(self.root)
        with system.open_input_file(path) as f:
            size, text = f.size(), b""
            at = size
            while at > 0:
                step = min(TAIL, at)
                at -= step
                f.seek(at)
                text = f.read(step) + text
                lines = text[: text.rfind(b"\n") + 1].splitlines()
                for line in reversed(lines if at == 0 else lines[1:]):
                    if (seq := _seq(line)) is not None:
                        return seq
        return 0

    def initialOffset(self) -> dict:
        return {"seq": 0}

    def latestOffset(self) -> dict:
        return {"seq": max(map(self._last, self._files()), default=0)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        after = max(start["seq"], end["seq"] - self.ring)
        return [Part(p, after, end["seq"]) for p in self._files() if end["seq"] > after]

    def read(self, partition: Part) -> Iterator[tuple]:
        system, _ = _opened(self.root)
        with system.open_input_stream(partition.path) as f:
            rest = b""
            while block := f.read(1 << 20):
                *lines, rest = (rest + block).split(b"\n")
                for line in lines:
                    seq = _seq(line)
                    if seq is not None and partition.after < seq <= partition.upto:
                        value = json.loads(line)
                        yield tuple(value.get(n) for n in self.names)

    def commit(self, end: dict) -> None:
        pass


class EventCursor(DataSource):
    """Format event_cursor; options path (a folder that all machines see, or a URI) and ring."""

    @classmethod
    def name(cls) -> str:
        return "event_cursor"

    def schema(self) -> str:
        return FIELDS

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return CursorReader(schema, dict(self.options))


def poll_events(spark: SparkSession, path: str, ring: int = RING):
    """The stream of the events behind the cursor."""
    spark.dataSource.register(EventCursor)
    return spark.readStream.format("event_cursor").option("path", path).option("ring", ring).load()
