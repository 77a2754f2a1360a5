"""A paged JSON source through Spark's Python data source interface.

``spark.dataSource.register(PagedJson)`` then
``spark.read.format("paged_json").option("path", ...).load()``. Captured
pages are files of a folder that all executors share, on any file system
that pyarrow opens; ``start`` resumes after a page that is done already.
"""

from __future__ import annotations

import json

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def _opened(path: str):
    """The file system of a path or URI, and the path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Page(InputPartition):
    def __init__(self, path: str, page: int):
        self.path, self.page = path, page


class PagedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "page int, ticker string, cik string, name string, type string, active boolean, delisted_utc string"

    def reader(self, schema):
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.start = options["path"], int(options.get("start", "0"))

    def partitions(self):
        from pyarrow import fs

        files, root = _opened(self.path)
        names = sorted(f.base_name for f in files.get_file_info(fs.FileSelector(root)) if f.base_name.endswith(".json"))
        return [_Page(f"{self.path.rstrip('/')}/{name}", i) for i, name in enumerate(names) if i >= self.start] or [_Page("", -1)]

    def read(self, partition):
        if not partition.path:
            return
        files, path = _opened(partition.path)
        with files.open_input_stream(path) as f:
            for r in json.loads(f.read()).get("results", []):
                yield partition.page, r.get("ticker"), r.get("cik"), r.get("name"), r.get("type"), r.get("active"), r.get("delisted_utc")
