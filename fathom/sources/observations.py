"""A pluggable batch source of series observations, as a Python data source: one partition per file."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class ObservationFiles(DataSource):
    """``spark.read.format("fathom_observations").load(folder)``: files of {"observations": [{"date", "value"}]}; a value of "." is null."""

    @classmethod
    def name(cls) -> str:
        return "fathom_observations"

    def schema(self) -> str:
        return "series string, date string, value double"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options.get("path", ""))


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        return [_File(str(p)) for p in sorted(Path(self.folder).glob("*.json"))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        p = Path(partition.path)
        for o in json.loads(p.read_text()).get("observations", []):
            try:
                value = float(o.get("value"))
            except (TypeError, ValueError):
                value = None
            yield p.stem, o.get("date"), value
