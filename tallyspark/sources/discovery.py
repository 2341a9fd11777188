"""Transcripts as a data source: files found by walking folders, filters that prune the walk, whole files as rows.

`spark.read.format("transcript_files").option("path", root).option("tool", tool).load()` gives a row for each
transcript. Folders are walked on the driver, which sees names, sizes and times only; a folder that a tool's rules or
a pushed filter leaves out is not listed. Files are dealt to partitions of about PART_BYTES. A task reads the first
HEAD_BYTES of a file, where transcripts say the folder they were made in, and the rest only if that is wanted.
register() turns on the pushdown of filters: equality and substrings of `project`, `kind` and `cwd`.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, StringContains

# executors need no copy of this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HEAD_BYTES, PART_BYTES = 2_048, 32 << 20
# Where tools keep transcripts, and folders that aren't a user's sessions.
DEEPEST = 10
TEMPORARY, TEMPORARY_PART = "-tmp", "var-folders"
AGENTS = "subagents"
# End of fixed values.
SCHEMA = "path string, name string, project string, kind string, size long, modified timestamp, cwd string, raw string"


@dataclass
class Part(InputPartition):
    """Files of one task: path, name, project, kind, size and modified."""

    files: list[tuple]


def cwd_of(head: bytes) -> str | None:
    """The folder that a transcript's first line says it was made in; null if it can't be told."""
    try:
        first = json.loads(head.decode("utf-8", "replace").split("\n")[0])
        return first.get("cwd") or (first.get("payload") or {}).get("cwd") or (first.get("session") or {}).get("cwd") or ""
    except (ValueError, AttributeError):
        return None


def _matches(value: str | None, wanted: list[tuple[str, str]]) -> bool:
    return all(value is not None and (value == x if how == "=" else x in value) for how, x in wanted)


class TranscriptReader(DataSourceReader):
    def __init__(self, root: str, tool: str, project: str):
        self.root, self.tool, self.project = root, tool, project.lower()
        self.wanted: dict[str, list[tuple[str, str]]] = {"project": [], "kind": [], "cwd": []}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, StringContains)) and len(f.attribute) == 1 and f.attribute[0] in self.wanted and isinstance(f.value, str):
                self.wanted[f.attribute[0]].append(("=" if isinstance(f, EqualTo) else "in", f.value))
            else:
                yield f

    def _found(self) -> Iterator[tuple]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (fs.LocalFileSystem(), self.root)

        def listed(folder: str) -> list:
            return sorted(files.get_file_info(fs.FileSelector(folder, allow_not_found=True)), key=lambda i: i.path)

        def row(i, project: str, kind: str) -> tuple:
            return (i.path, i.base_name, project, kind, i.size, i.mtime_ns)

        is_file = lambda i, *ends: i.type == fs.FileType.File and i.base_name.endswith(ends)
        if self.tool == "claude-code":
            for folder in listed(root):
                name = folder.base_name
                if folder.type != fs.FileType.Directory or name.startswith(".") or name == TEMPORARY or TEMPORARY_PART in name:
                    continue
                if self.project not in name.lower() or not _matches(name, self.wanted["project"]):
                    continue
                for i in listed(folder.path):
                    if is_file(i, ".jsonl") and _matches("session", self.wanted["kind"]):
                        yield row(i, name, "session")
                    elif i.type == fs.FileType.Directory and i.base_name == AGENTS and _matches("subagent", self.wanted["kind"]):
                        yield from (row(j, name, "subagent") for j in listed(i.path) if is_file(j, ".jsonl"))
            return
        open_ = [(root, 0)]
        while open_:
            folder, depth = open_.pop()
            for i in listed(folder):
                if i.type == fs.FileType.Directory and depth < DEEPEST:
                    open_.append((i.path, depth + 1))
                elif i.base_name.startswith("rollout-") and is_file(i, ".jsonl", ".json"):
                    if _matches("session", self.wanted["kind"]) and not self.wanted["project"]:
                        yield row(i, None, "session")

    def partitions(self) -> list[InputPartition]:
        parts, size = [Part([])], 0
        for f in self._found():
            if parts[-1].files and size + f[4] > PART_BYTES:
                parts.append(Part([]))
                size = 0
            parts[-1].files.append(f)
            size += f[4]
        return parts

    def read(self, partition: Part) -> Iterator[tuple]:
        from pyarrow import fs

        files = fs.FileSystem.from_uri(self.root)[0] if "://" in self.root or self.root.startswith("file:") else fs.LocalFileSystem()
        for path, name, project, kind, size, modified in partition.files:
            try:
                stream = files.open_input_stream(path)
            except FileNotFoundError:  # gone since it was listed
                continue
            with stream:
                head = stream.read(HEAD_BYTES)
                cwd = cwd_of(head)
                # of a file that can't be told, a project is not denied; a filter is
                if self.tool != "claude-code" and self.project and cwd is not None and self.project not in cwd.lower():
                    continue
                if not _matches(cwd, self.wanted["cwd"]):
                    continue
                yield (path, name, project, kind, size, datetime.fromtimestamp(modified / 1e9, timezone.utc), cwd, (head + stream.read()).decode("utf-8", "replace"))


class TranscriptFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "transcript_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TranscriptReader(self.options["path"], self.options.get("tool", "claude-code"), self.options.get("project", ""))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TranscriptFiles)


def discover(spark: SparkSession, root: str, tool: str, project: str = "") -> DataFrame:
    """The transcripts of a tool below a folder, of projects whose folder has a text; see SCHEMA."""
    register(spark)
    return spark.read.format("transcript_files").option("path", root).option("tool", tool).option("project", project).load()
