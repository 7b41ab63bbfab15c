"""Tables from files: delimited text, JSON, Markdown; by extension, else by the first letter.

A path may name many files. Each file is parsed exactly (ragged rows, repeated headers, nested JSON) and its rows
get ``_ord``, the row number in the file: on the driver if all files together have at most ``DRIVER_BYTES``,
else file by file in the tasks, with the same result. The columns are those of all files, in order of file names;
cells are texts. A file must fit one task (2 GB).
"""

from __future__ import annotations

import csv
import io
import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError
from ..functions.names import clean_headers
from .pipes import find_tables, squared

DRIVER_BYTES = 64 << 20
#: Different headers that the files of one table may have.
MOST_HEADERS = 1000
ORD = "_ord"


def delimiter_of(first_line: str) -> str:
    """Tab if there are as many as of the others, semicolon if more than commas, else comma."""
    tabs, semis, commas = (first_line.count(x) for x in "\t;,")
    return "\t" if tabs and tabs >= commas and tabs >= semis else ";" if semis > commas else ","


def parse_delimited(text: str, sep: str | None = None) -> tuple[list[str], list[list[str]]]:
    """(columns, rows) of RFC 4180 text: cells trimmed, blank records dropped, rows squared."""
    text = text.removeprefix("﻿")
    sep = sep or delimiter_of(text.split("\n", 1)[0])
    if _open_quote(text, sep):
        raise EngineError("bad_csv", "a quoted cell is not closed", "Check the quotes")
    records = [[c.strip() for c in r] for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep)]
    records = [r for r in records if any(r)]
    return squared(records[0], records[1:]) if records else ([], [])


def _open_quote(text: str, sep: str) -> bool:
    inside, start = False, True
    i = 0
    while i < len(text):
        c = text[i]
        if inside:
            if c == '"':
                if text[i + 1 : i + 2] == '"':
                    i += 1
                else:
                    inside = False
        elif c == '"' and start:
            inside = True
        start = not inside and c in (sep, "\n", "\r")
        i += 1
    return inside


def _shown(v) -> str | None:
    return v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False) if isinstance(v, (dict, list, bool)) else str(v)


def parse_json(text: str) -> tuple[list[str], list[list[str | None]]]:
    """(columns, rows) of an array of objects, of arrays (first row: header) or of scalars, or of the
    first such array inside an object, arrays of objects before others, three levels deep at most."""
    data = json.loads(text)
    rows = _array_in(data, 0)
    if rows is None:
        raise EngineError("bad_json", "no array of rows was found", "Give an array of objects")
    if all(isinstance(r, dict) for r in rows):
        names = list(dict.fromkeys(k for r in rows for k in r))
        return clean_headers(names), [[_shown(r.get(k)) for k in names] for r in rows]
    if all(isinstance(r, list) for r in rows):
        return squared([_shown(c) or "" for c in rows[0]], [[_shown(c) for c in r] for r in rows[1:]])
    return ["value"], [[_shown(r)] for r in rows]


def _array_in(data, depth: int):
    if isinstance(data, list):
        return data if data else None
    if not isinstance(data, dict) or depth >= 3:
        return None
    inner = [v for v in data.values() if isinstance(v, (list, dict))]
    for v in inner:
        if isinstance(v, list) and v and all(isinstance(r, dict) for r in v):
            return v
    for v in inner:
        if (got := _array_in(v, depth + 1)) is not None:
            return got
    return None


def parse(text: str, name: str = "") -> tuple[list[str], list[list]]:
    """(columns, rows) of a text by the extension of its name, else by what it looks like."""
    ext = name.rpartition(".")[2].lower()
    if ext in ("xlsx", "xls", "ods"):
        raise EngineError("bad_format", f"`.{ext}` files are not read", "Export the sheet as CSV")
    if ext == "json" or (ext not in ("csv", "tsv", "md", "markdown") and text.lstrip()[:1] in ("[", "{")):
        return parse_json(text)
    if ext == "tsv":
        return parse_delimited(text, "\t")
    if ext in ("md", "markdown") or ext not in ("csv",):
        found = find_tables(text)
        if found:
            return found[0][0], found[0][1]
        if ext in ("md", "markdown"):
            raise EngineError("no_table", "the text has no pipe table")
    return parse_delimited(text)


def read_table(spark: SparkSession, path: str, driver_bytes: int = DRIVER_BYTES) -> DataFrame:
    """The table in a file or folder; see the module text."""
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    size = files.agg(F.sum("length")).first()[0] or 0
    if size <= driver_bytes:
        read = [parse(bytes(r.content).decode("utf-8", "replace"), r.path) for r in files.select("path", "content").orderBy("path").collect()]  # bounded by driver_bytes
        names = list(dict.fromkeys(c for columns, _ in read for c in columns))
        rows = [(i, *map(dict(zip(columns, row)).get, names)) for columns, lines in read for i, row in enumerate(lines)]
        return spark.createDataFrame(rows, _text_schema(names))

    def columns_of(batches):
        for b in batches:
            heads = [(p, parse(c.decode("utf-8", "replace"), p)[0]) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_pydict({"path": pa.array([h[0] for h in heads], pa.string()), "columns": pa.array([h[1] for h in heads], pa.list_(pa.string()))})

    heads = files.select("path", "content").mapInArrow(columns_of, "path string, columns array<string>")
    # one row for each kind of header, with the first file that has it
    kinds = heads.groupBy("columns").agg(F.min("path").alias("path")).orderBy("path").limit(MOST_HEADERS + 1).collect()
    if len(kinds) > MOST_HEADERS:
        raise EngineError("bad_format", f"the files have more than {MOST_HEADERS} different headers")
    names = list(dict.fromkeys(c for r in kinds for c in r.columns))

    def rows_of(batches):
        for b in batches:
            for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                columns, lines = parse(c.decode("utf-8", "replace"), p)
                at = {n: i for i, n in enumerate(columns)}
                for first in range(0, len(lines), 20_000):
                    part = lines[first : first + 20_000]
                    made = {ORD: pa.array(range(first, first + len(part)), pa.int64())}
                    made |= {n: pa.array([r[at[n]] if n in at else None for r in part], pa.string()) for n in names}
                    yield pa.RecordBatch.from_pydict(made)

    return files.select("path", "content").mapInArrow(rows_of, _text_schema(names))


def frame(spark: SparkSession, columns: list[str], rows: list[list]) -> DataFrame:
    """A DataFrame of text columns and ``_ord``."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], _text_schema(columns))


def _text_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(ORD, T.LongType()), *[T.StructField(c, T.StringType()) for c in names]])


def read_pipe_tables(docs: DataFrame, id_col: str = "doc_id", body: str = "body") -> DataFrame:
    """(id, line, ordinal, columns, cells): every row of every pipe table in documents."""
    from ..operators.documents import per_document

    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("line", T.IntegerType()), T.StructField("ordinal", T.IntegerType()),
        T.StructField("columns", T.ArrayType(T.StringType())), T.StructField("cells", T.ArrayType(T.StringType()))])

    def make(key, text):
        return [(key, line, i, names, row) for names, rows, line in (find_tables(text) if text else []) for i, row in enumerate(rows, 1)]

    return per_document(docs, [id_col, body], make, schema)
