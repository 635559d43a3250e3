"""Files of any format, each a sequence of chunks: ``(name, place, data)`` rows.

A task streams its files to a staging folder of its own attempt; when all tasks have
ended, the driver renames what their commits name. A failed or repeated attempt leaves
no file, and a reader never sees half of one.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def open_uri(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, or of a local path."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def list_files(path: str, suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """(path, bytes) of the files at or below ``path``, by name; folders that begin with
    an underscore are none of a reader's business."""
    store, at = open_uri(path)
    info = store.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        return []
    found = [info] if info.is_file else store.get_file_info(pafs.FileSelector(at, recursive=True))
    return sorted((i.path, i.size) for i in found if i.is_file and i.path.lower().endswith(suffixes) and "/_" not in i.path[len(at) :])


@dataclass
class Staged(WriterCommitMessage):
    files: list[tuple[str, str]]


class FilesWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.suffix, self.overwrite = options["path"], options["suffix"], overwrite
        self.head, self.between, self.tail = (options.get(k, "").encode() for k in ("head", "between", "tail"))
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator) -> Staged:
        store, at = open_uri(self.path)
        folder = f"{at}/{self.staging}/{uuid.uuid4().hex}"
        store.create_dir(folder, recursive=True)
        done, name, out, first = [], None, None, True

        def end() -> None:
            if out is not None:
                out.write(self.tail)
                out.close()

        try:
            for row in iterator:
                if row["name"] != name:
                    end()
                    name, first = row["name"], True
                    done.append((f"{folder}/{name}{self.suffix}", f"{at}/{name}{self.suffix}"))
                    out = store.open_output_stream(done[-1][0])
                    out.write(self.head)
                if row["data"] is not None:
                    out.write(bytes(row["data"]) if first else self.between + bytes(row["data"]))
                    first = False
            end()
        except BaseException:
            if out is not None and not out.closed:
                out.close()
            raise
        return Staged(done)

    def commit(self, messages) -> None:
        store, at = open_uri(self.path)
        moved = [x for m in messages if m is not None for x in m.files]
        if self.overwrite:
            keep = {to for _, to in moved}
            for path, _ in list_files(self.path, (self.suffix,)):
                if path not in keep:
                    store.delete_file(path)
        for source, to in moved:
            store.move(source, to)
        self._clear(store, at)

    def abort(self, messages) -> None:
        self._clear(*open_uri(self.path))

    def _clear(self, store, at: str) -> None:
        if store.get_file_info(f"{at}/{self.staging}").type != pafs.FileType.NotFound:
            store.delete_dir(f"{at}/{self.staging}")


class FilesSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landcube_files"

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        return FilesWriter(dict(self.options), overwrite)


def write_files(chunks: DataFrame, path: str, suffix: str, head: str = "", between: str = "", tail: str = "", overwrite: bool = False) -> None:
    """One file ``{name}{suffix}`` for each name: ``head``, its chunks in order of
    ``place`` with ``between`` between them, ``tail``. A chunk without data only makes
    its file be there. ``overwrite`` removes other files of that suffix."""
    chunks.sparkSession.dataSource.register(FilesSink)
    # a file's bytes pass through one task in order, a chunk at a time
    rows = chunks.select("name", "place", "data").repartition("name").sortWithinPartitions("name", "place")
    out = rows.write.format("landcube_files").option("path", path).option("suffix", suffix)
    for k, v in (("head", head), ("between", between), ("tail", tail)):
        if v:
            out = out.option(k, v)
    out.mode("overwrite" if overwrite else "append").save()
