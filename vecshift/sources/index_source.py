"""A stored vector index as a data source: spark.read.format("vecshift_index").load(path), once IndexSource is registered.

A version's cells are its partitions, so a filter on `cell` decides what is planned at all; filters on doc_id are pushed into the
Parquet reader of each task. Options: path, version. Files are opened by PyArrow in the tasks, so the path must be one that PyArrow
reads (local, HDFS, S3, GCS). Subclasses may change `open_cell` to read from elsewhere."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

COLUMNS = pa.schema([("doc_id", pa.int64()), ("v", pa.list_(pa.float64())), ("cell", pa.int32())])


@dataclass
class Cell(InputPartition):
    number: int
    files: list[str]

    def __post_init__(self):
        super().__init__(self.number)


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"^[a-z0-9]+:", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", path))
    return fs.LocalFileSystem(), path


class IndexReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.version = options["path"].rstrip("/"), options.get("version")
        self.cells: set[int] | None = None
        self.ids: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        kinds = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in"}
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("cell",) and isinstance(f, (EqualTo, In)):
                some = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.cells = some if self.cells is None else self.cells & some
            elif column == ("doc_id",) and type(f) in kinds and f.value is not None:
                self.ids.append((kinds[type(f)], list(f.value) if isinstance(f, In) else f.value))
            else:
                yield f

    def partitions(self) -> list[Cell]:
        files, root = _place(self.path)
        versions = sorted(f.base_name for f in files.get_file_info(fs.FileSelector(f"{root}/versions")) if re.fullmatch(r"\d+\.json", f.base_name))
        name = versions[-1] if self.version is None else f"{int(self.version):012d}.json"
        if name not in versions:
            raise ValueError(f"no version {self.version} in {self.path}")
        with files.open_input_stream(f"{root}/versions/{name}") as f:
            parts = json.loads(f.read())["parts"]
        cells: dict[int, list[str]] = {}
        for part in parts:
            for f in files.get_file_info(fs.FileSelector(f"{root}/{part}", recursive=True)):
                if (at := re.search(r"/cell=(\d+)/[^/]+\.parquet$", f.path)) and (self.cells is None or int(at[1]) in self.cells):
                    cells.setdefault(int(at[1]), []).append(f.path)
        return [Cell(c, sorted(x)) for c, x in sorted(cells.items())] or [Cell(-1, [])]

    def open_cell(self, cell: Cell) -> Iterator[pa.RecordBatch]:
        files, _ = _place(self.path)
        wanted = None
        for kind, value in self.ids:
            field = ds.field("doc_id")
            one = {"==": field.__eq__, ">": field.__gt__, ">=": field.__ge__, "<": field.__lt__, "<=": field.__le__, "in": field.isin}[kind](value)
            wanted = one if wanted is None else wanted & one
        yield from ds.dataset(cell.files, format="parquet", filesystem=files, schema=COLUMNS.remove(2)).to_batches(columns=["doc_id", "v"], filter=wanted)

    def read(self, partition: Cell) -> Iterator[pa.RecordBatch]:
        for b in self.open_cell(partition) if partition.files else ():
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([partition.number] * b.num_rows, pa.int32())], schema=COLUMNS)


class IndexSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vecshift_index"

    def schema(self) -> str:
        return "doc_id bigint, v array<double>, cell int"

    def reader(self, schema) -> IndexReader:
        return IndexReader(self.options)
