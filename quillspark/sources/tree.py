"""Trees of source files as a data source of their own, as Spark's readers skip names that start with a dot."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

#: Folders that are not looked into.
IGNORED = (
    ".git", ".hg", ".svn", ".venv", "venv", "env", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox",
    "node_modules", "dist", "build", ".idea", ".vscode", "site-packages", "tests", "test",
)
#: Configuration files.
CONFIG = ("config.yaml", "config.yml", "settings.yaml", "settings.yml")
NAME = "source_tree"
#: Folders that the driver opens at most before it hands the rest to tasks.
SLICES = 256


def _source(slices: int) -> type[DataSource]:
    """The data source; made in a function, so that it is sent to workers whole and needs no module there."""
    import pyspark.sql.datasource as base

    class Tree(base.DataSource):
        @classmethod
        def name(cls) -> str:
            return "source_tree"

        def schema(self) -> str:
            return "project string, file string, kind string, content string"

        def reader(self, schema) -> base.DataSourceReader:
            return Reader(self.options)

    class Slice(base.InputPartition):
        """Folders of a project, each with all below it or by its own files only."""

        def __init__(self, project: str, folder: str, deep: bool):
            self.project, self.folder, self.deep = project, folder, deep

    class Reader(base.DataSourceReader):
        def __init__(self, options):
            self.roots, self.ignored = json.loads(options["roots"]), set(json.loads(options["ignored"]))
            self.config, self.slices = set(json.loads(options["config"])), slices

        def entries(self, project: str, folder: str):
            """``(store, files, folders)`` right in a folder, without ignored folders and links to folders."""
            import os

            from pyarrow import fs

            store, top = fs.FileSystem.from_uri(project)
            where = f"{top.rstrip('/')}/{folder}".rstrip("/") if folder else top
            local = isinstance(store, fs.LocalFileSystem)
            files, folders = [], []
            for x in sorted(store.get_file_info(fs.FileSelector(where, allow_not_found=True)), key=lambda x: x.base_name):
                name = f"{folder}/{x.base_name}" if folder else x.base_name
                if x.type == fs.FileType.File:
                    files.append((name, x.path))
                elif x.type == fs.FileType.Directory and x.base_name not in self.ignored and not (local and os.path.islink(x.path)):
                    folders.append(name)
            return store, files, folders

        def partitions(self) -> list[Slice]:
            todo = [(root, "") for root in self.roots]
            out = []
            # Breadth first, a level of folders at a time, until there is enough to hand out.
            while todo and len(todo) < self.slices:
                below = []
                for project, folder in todo:
                    _, files, folders = self.entries(project, folder)
                    if files:
                        out.append(Slice(project, folder, False))
                    below += [(project, f) for f in folders]
                todo = below
            return out + [Slice(p, f, True) for p, f in todo]

        def kind(self, path: str) -> str | None:
            name = path.rsplit("/", 1)[-1].lower()
            if name in self.config:
                return "config"
            if name.endswith(".env") or name in (".env.local", ".env.example", ".env.sample"):
                return "env"
            return "python" if name.endswith(".py") else None

        def read(self, partition):
            todo = [partition.folder]
            while todo:
                store, files, folders = self.entries(partition.project, todo.pop())
                for name, path in files:
                    if kind := self.kind(name):
                        with store.open_input_stream(path) as f:
                            yield partition.project, name, kind, f.read().decode("utf-8", errors="replace")
                if partition.deep:
                    todo += folders

    return Tree


def load_corpus(spark: SparkSession, roots: Sequence[str], ignore_dirs: Sequence[str] = IGNORED, slices: int = SLICES) -> DataFrame:
    """``(project, file, kind, content)`` of all files under project roots, without ignored folders.

    ``kind`` is ``python``, ``env`` or ``config``, by the name in any case; other files are not read, ignored folders
    and links to folders are not looked into. A ``config.py`` is ``python``. Bytes that are no UTF-8 are replaced. A root
    that is not there has no files. ``roots`` are folders, or URIs of a store that Arrow opens (``file``, ``hdfs``,
    ``s3``, ``gs``), that the driver and all executors reach.

    The driver opens folders level by level until there are ``slices`` of them; each of these, with all below it, is a
    task's to list and read.
    """
    spark.dataSource.register(_source(slices))
    reader = spark.read.format(NAME).option("roots", json.dumps([r if r == "/" else r.rstrip("/") for r in roots]))
    return reader.option("ignored", json.dumps(list(ignore_dirs))).option("config", json.dumps(CONFIG)).load()


def write_tree(files: DataFrame, root: str) -> int:
    """Land ``(file, content)`` as files below ``root``, by tasks; how many. A repeated task writes the same again."""

    def land(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(root)
        for batch in batches:
            for file, content in zip(batch["file"], batch["content"], strict=True):
                path = f"{top.rstrip('/')}/{file}"
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(path) as out:
                    out.write((content or "").encode())
            yield pd.DataFrame({"n": [len(batch)]})

    return files.select("file", "content").mapInPandas(land, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
