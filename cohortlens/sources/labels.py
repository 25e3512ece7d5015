"""A Spark data source for bulk label files: one JSON object with a `results` array, read element by element.

A file is one partition; only the element at hand is held as text, and only the asked fields of those that have any
go on, in Arrow batches. Files are opened through pyarrow's file systems (local, hdfs, s3, gs).
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a file that are read at a time, and rows and characters of an Arrow batch.
CHUNK, BATCH_ROWS, BATCH_CHARS = 1 << 20, 1024, 4 << 20
SPACE = re.compile(r"[ \t\n\r﻿]*")
_decode = json.JSONDecoder().raw_decode


class Reading:
    """Text of a stream of UTF-8 bytes from the place on that is not read yet."""

    def __init__(self, stream, chunk: int = CHUNK):
        self.stream, self.chunk, self.text, self.at, self.over = stream, chunk, "", 0, False
        self.decoder = codecs.getincrementaldecoder("utf-8")()

    def more(self, size: int) -> None:
        got = self.stream.read(size)
        self.over = not got
        self.text, self.at = self.text[self.at :] + self.decoder.decode(got, final=self.over), 0

    def sign(self) -> str:
        """The next character that is no white space; empty at the end."""
        while True:
            self.at = SPACE.match(self.text, self.at).end()
            if self.at < len(self.text) or self.over:
                return self.text[self.at : self.at + 1]
            self.more(self.chunk)

    def take(self, *signs: str) -> str:
        found = self.sign()
        if found not in signs or not found:
            raise ValueError(f"expected one of {' '.join(signs)}, found {found or 'the end'}")
        self.at += 1
        return found

    def value(self):
        """The JSON value that comes next; what is held doubles until it is whole."""
        size = self.chunk
        self.sign()
        while True:
            try:
                out, end = _decode(self.text, self.at)
                # A number at the end of what is held may go on.
                if end < len(self.text) or self.over:
                    self.at = end
                    return out
            except json.JSONDecodeError:
                if self.over:
                    raise
            self.more(size)
            size *= 2


def elements(stream, name: str = "results", chunk: int = CHUNK) -> Iterator[object]:
    """Elements of the array `name` of the object that the stream holds. Text that is cut off or no JSON is a ValueError."""
    text = Reading(stream, chunk)
    text.take("{")
    while text.sign() != "}":
        key = text.value()
        text.take(":")
        if key == name and text.sign() == "[":
            text.take("[")
            while text.sign() != "]":
                yield text.value()
                if text.take(",", "]") == "]":
                    break
            else:
                text.take("]")
        else:
            text.value()
        if text.take(",", "}") == "}":
            return


def _text(x) -> str | None:
    return x if x is None or isinstance(x, str) else json.dumps(x, ensure_ascii=False)


def _texts(x) -> list | None:
    return None if x is None else [_text(y) for y in x] if isinstance(x, list) else [_text(x)]


def label_batches(stream, fields: list[str], chunk: int = CHUNK) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.string(), *[pa.list_(pa.string())] * len(fields)]
    names, rows, held = ["id", "effective_time", *fields], [], 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for one in elements(stream, chunk=chunk):
        if not isinstance(one, dict) or all(one.get(f) is None for f in fields):
            continue
        rows.append([_text(one.get("id")), _text(one.get("effective_time")), *[_texts(one.get(f)) for f in fields]])
        held += sum(len(t or "") for x in rows[-1][2:] for t in x or ())
        if len(rows) >= BATCH_ROWS or held >= BATCH_CHARS:
            yield made()
            rows, held = [], 0
    if rows:
        yield made()


class LabelReader(DataSourceReader):
    def __init__(self, files: list[str], fields: list[str]):
        self.files, self.fields = files, fields

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in self.files]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None or partition.value is None:
            return
        store, path = pyarrow.fs.FileSystem.from_uri(quote(partition.value, safe="/:@+,="))  # Spark names files unquoted
        with store.open_input_stream(path) as stream:
            try:
                yield from label_batches(stream, self.fields)
            except ValueError as bad:
                raise ValueError(f"{partition.value}: {bad}") from bad


class LabelSource(DataSource):
    """Options: files (URIs, one a line) and fields (names, one a line)."""

    @classmethod
    def name(cls) -> str:
        return "label_json"

    def _fields(self) -> list[str]:
        return self.options["fields"].split("\n")

    def schema(self) -> str:
        return ", ".join(["id string", "effective_time string", *[f"`{f}` array<string>" for f in self._fields()]])

    def reader(self, schema) -> DataSourceReader:
        return LabelReader([f for f in self.options.get("files", "").split("\n") if f], self._fields())


def read_labels(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """(id, effective_time, fields) of all label files at `path` (a file, folder or glob), whose names Spark lists."""
    if not fields:
        raise ValueError("name the fields to read")
    files = [r.path for r in spark.read.format("binaryFile").load(path).select("path").collect()]  # names of files only
    spark.dataSource.register(LabelSource)
    if not files:
        return spark.createDataFrame([], LabelSource({"fields": "\n".join(fields)}).schema())
    return spark.read.format("label_json").option("files", "\n".join(sorted(files))).option("fields", "\n".join(fields)).load()
