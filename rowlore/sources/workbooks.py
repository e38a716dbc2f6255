"""Workbooks. A file is cut into its worksheets, still compressed; each is streamed by a task of its own."""

from __future__ import annotations

import io
import re
import struct
import tempfile
import zipfile
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlore.functions.maps import last_wins
from rowlore.functions.names import normalize_header
from rowlore.functions.values import cell_variant, format_cell
from rowlore.model import DecodeOptions
from rowlore.sources.folders import scan_files

CELL = "array<struct<kind:string,raw:string>>"
RAW_SCHEMA = (
    "path string, file string, sheet_index int, worksheet string, first_row int, row_number int, hidden boolean, "
    f"columns array<int>, header {CELL}, cells {CELL}, error string"
)
ARROW_CELL = pa.list_(pa.struct([("kind", pa.string()), ("raw", pa.string())]))
ARROW_SCHEMA = pa.schema(
    [
        ("path", pa.string()), ("file", pa.string()), ("sheet_index", pa.int32()), ("worksheet", pa.string()),
        ("first_row", pa.int32()), ("row_number", pa.int32()), ("hidden", pa.bool_()),
        ("columns", pa.list_(pa.int32())), ("header", ARROW_CELL), ("cells", ARROW_CELL), ("error", pa.string()),
    ]
)
ROWS_PER_BATCH = 2000
# A worksheet as it lies in its file: the compressed bytes of its part and of the shared texts, and the kinds of its styles.
SHEETS = (
    "path string, file string, sheet_index int, worksheet string, method int, part binary, texts_method int, texts binary, "
    "kinds array<string>, error string"
)
# Shared texts of a workbook up to this many bytes stay in memory, more go to a file of the task.
TEXTS_IN_MEMORY = 16 << 20
CACHED_TEXTS = 4096
UNREADABLE = (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, EOFError, IndexError, zlib.error, struct.error, NotImplementedError)
BLANK = {"kind": "blank", "raw": None}
# Number formats of the file format that show a date or a time.
DATE_FORMATS = frozenset((14, 15, 16, 17, 22))
TIME_FORMATS = frozenset((18, 19, 20, 21, 45, 46, 47))


def _tag(element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _column(ref: str) -> int:
    n = 0
    for ch in ref:
        if ch.isdigit():
            break
        n = n * 26 + ord(ch) - 64
    return n


def _style_kinds(book: zipfile.ZipFile) -> list[str]:
    """Cell kind (date, time or number) per style index."""
    if "xl/styles.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    custom, kinds = {}, []
    for e in root.iter():
        if _tag(e) == "numFmt":
            code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", e.get("formatCode", "")).lower()
            dated = re.search(r"[yd]", code)
            custom[int(e.get("numFmtId"))] = "date" if dated else "time" if re.search(r"[hs]", code) else "number"
    for e in root.iter():
        if _tag(e) == "cellXfs":
            for xf in e:
                n = int(xf.get("numFmtId", "0"))
                kinds.append("date" if n in DATE_FORMATS else "time" if n in TIME_FORMATS else custom.get(n, "number"))
    return kinds


class _Inflated(io.RawIOBase):
    """Compressed bytes as a stream of the bytes they stand for."""

    def __init__(self, data: bytes):
        self.inflate, self.rest = zlib.decompressobj(-zlib.MAX_WBITS), data

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        while not self.inflate.eof:
            found = self.inflate.decompress(self.rest, len(out))
            self.rest = self.inflate.unconsumed_tail
            if found:
                out[: len(found)] = found
                return len(found)
            if not self.rest:
                raise EOFError("a part of the file ends early")
        return 0


def _stream(method: int, data: bytes) -> io.IOBase:
    return io.BufferedReader(_Inflated(data), 1 << 16) if method == zipfile.ZIP_DEFLATED else io.BytesIO(data)


def _member(book: zipfile.ZipFile, content: bytes, name: str) -> tuple[int, bytes]:
    """How a part is compressed, and its bytes as they lie in the file."""
    info = book.getinfo(name)
    if info.flag_bits & 1 or info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise NotImplementedError(f"{name} is encrypted or compressed in an unknown way")
    lengths = struct.unpack_from("<HH", content, info.header_offset + 26)
    start = info.header_offset + 30 + sum(lengths)
    return info.compress_type, content[start : start + info.compress_size]


class SharedTexts:
    """The shared texts of a workbook by number, read as a stream; large tables lie in a file."""

    def __init__(self, method: int | None, data: bytes | None):
        self.file, self.ends = tempfile.SpooledTemporaryFile(max_size=TEXTS_IN_MEMORY), array("Q", [0])
        self.get = lru_cache(CACHED_TEXTS)(self._read)
        if data is not None:
            root = None
            for event, e in ElementTree.iterparse(_stream(method, data), ("start", "end")):
                root = e if root is None else root
                if event == "end" and _tag(e) == "si":
                    text = "".join(t.text or "" for t in e.iter() if _tag(t) == "t").encode()
                    self.file.write(text)
                    self.ends.append(self.ends[-1] + len(text))
                    root.clear()

    def _read(self, number: int) -> str:
        self.file.seek(self.ends[number])
        return self.file.read(self.ends[number + 1] - self.ends[number]).decode()


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    rels = {
        r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    }
    found = []
    for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter():
        if _tag(e) == "sheet":
            rid = next(v for k, v in e.attrib.items() if k.endswith("}id"))
            target = rels[rid].lstrip("/")
            found.append((e.get("name"), target if target.startswith("xl/") else f"xl/{target}"))
    return found


def _value(c, ns: str):
    """The element holding a cell's value, None for a blank cell."""
    v = c.find(f"{ns}is" if c.get("t") == "inlineStr" else f"{ns}v")
    return None if v is None or (not len(v) and not v.text) else v


def _cell(c, v, texts: SharedTexts, kinds: list[str]) -> dict:
    raw, t = "".join(v.itertext()), c.get("t", "n")
    if t == "s":
        return {"kind": "text", "raw": texts.get(int(raw))}
    if t == "n":
        style = int(c.get("s", "0"))
        return {"kind": kinds[style] if style < len(kinds) else "number", "raw": raw}
    return {"kind": {"b": "boolean", "e": "error"}.get(t, "text"), "raw": raw}


def _rows(stream: io.IOBase, hidden_columns: set[int]):
    """(row element, its non-blank cells), streamed; fills `hidden_columns` on the way."""
    parents = []
    for event, e in ElementTree.iterparse(stream, ("start", "end")):
        if event == "start":
            parents.append(e)
            continue
        parents.pop()
        tag = e.tag
        if tag.endswith("row") and _tag(e) == "row":
            ns = tag[: tag.rfind("}") + 1]
            filled = [(_column(c.get("r")), c, v) for c in e if (v := _value(c, ns)) is not None]
            if filled:
                yield e, filled
            # What is read is forgotten: a sheet of any length takes the room of a row.
            parents[-1].clear()
        elif tag.endswith("col") and _tag(e) == "col" and e.get("hidden") in ("1", "true"):
            hidden_columns.update(range(int(e.get("min")), int(e.get("max")) + 1))


def _decode(sheet: dict, header_index: int, skip_hidden: bool) -> Iterator[dict]:
    """Rows of one worksheet: cells and header dense over the used columns."""
    texts, kinds = SharedTexts(sheet["texts_method"], sheet["texts"]), sheet["kinds"]
    first_row, low, high, header, hidden_columns = None, 1 << 30, 0, {}, set()
    for e, filled in _rows(_stream(sheet["method"], sheet["part"]), hidden_columns):
        number = int(e.get("r"))
        first_row = number if first_row is None else first_row
        if number == first_row + header_index:
            header = {col: _cell(c, v, texts, kinds) for col, c, v in filled}
        low, high = min(low, filled[0][0]), max(high, filled[-1][0])
    columns = [c for c in range(low, high + 1) if not (skip_hidden and c in hidden_columns)]
    names = [header.get(c, BLANK) for c in columns]
    for e, filled in _rows(_stream(sheet["method"], sheet["part"]), set()):
        found = {col: _cell(c, v, texts, kinds) for col, c, v in filled}
        yield {
            "path": sheet["path"], "file": sheet["file"], "sheet_index": sheet["sheet_index"], "worksheet": sheet["worksheet"],
            "first_row": first_row, "row_number": int(e.get("r")), "hidden": e.get("hidden") in ("1", "true"), "columns": columns,
            "header": names, "cells": [found.get(c, BLANK) for c in columns],
        }


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each worksheet of a file, or one with what is wrong with the file."""
    names = ("path", "file", "sheet_index", "worksheet", "method", "part", "texts_method", "texts", "kinds", "error")
    types = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.string()), pa.string())
    schema = pa.schema(list(zip(names, types)))
    for batch in batches:
        for i in range(batch.num_rows):
            path, file, content = (batch.column(c)[i].as_py() for c in range(3))
            try:
                with zipfile.ZipFile(io.BytesIO(content or b"")) as book:
                    kinds = _style_kinds(book)
                    texts = _member(book, content, "xl/sharedStrings.xml") if "xl/sharedStrings.xml" in book.namelist() else (None, None)
                    sheets = [(path, file, n, sheet, *_member(book, content, part), *texts, kinds, None) for n, (sheet, part) in enumerate(_sheets(book))]
            except UNREADABLE as exc:
                sheets = [(path, file, 0, None, None, None, None, None, None, f"{type(exc).__name__}: {exc}")]
            for sheet in sheets:
                yield pa.RecordBatch.from_pylist([dict(zip(names, sheet))], schema=schema)


def _decode_sheets(header_index: int, skip_hidden: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sheet, rows = batch.slice(i, 1).to_pylist()[0], []
                failed = {k: sheet[k] for k in ("path", "file", "sheet_index", "worksheet")} | {"row_number": 0}
                try:
                    for row in () if sheet["error"] else _decode(sheet, header_index, skip_hidden):
                        rows.append(row)
                        if len(rows) >= ROWS_PER_BATCH:
                            yield pa.RecordBatch.from_pylist(rows, schema=ARROW_SCHEMA)
                            rows = []
                    if sheet["error"]:
                        rows.append(failed | {"error": sheet["error"]})
                except UNREADABLE as exc:
                    rows.append(failed | {"error": f"{type(exc).__name__}: {exc}"})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=ARROW_SCHEMA)

    return run


def worksheets(files: DataFrame) -> DataFrame:
    """`(path, file, content)` to one row per worksheet, dealt to as many tasks; parts stay compressed.

    The shared texts of a file go with each of its worksheets.
    """
    split = files.select("path", "file", "content").mapInArrow(_split, SHEETS)
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return split.repartition(parts, "path", "sheet_index")


def decode_workbooks(files: DataFrame, options: DecodeOptions = DecodeOptions()) -> DataFrame:
    """Raw cells of every used row of `(path, file, content)`, an error row for what cannot be decoded.

    Each worksheet is a task's own; its rows are streamed, so what a task holds is
    the worksheet's compressed bytes and the file's shared texts.
    """
    decode = _decode_sheets(options.header_row_index, options.skip_hidden_columns)
    return worksheets(files).mapInArrow(decode, RAW_SCHEMA)


def raw_workbooks(
    spark: SparkSession, path: str | list[str], options: DecodeOptions = DecodeOptions(), pattern: str = "*.xlsx", recursive: bool = True
) -> DataFrame:
    """The same for the workbooks of a folder."""
    return decode_workbooks(scan_files(spark, path, pattern, recursive, content=True), options)


def decode_errors(raw: DataFrame) -> DataFrame:
    """One note per undecodable file with the processing error."""
    failed = raw.where(F.col("error").isNotNull()).groupBy("path", "file").agg(F.min("error").alias("error"))
    return failed.select(
        "path", "file",
        F.concat(F.lit("This workbook could not be read: "), F.col("file")).alias("text"),
        F.create_map(F.lit("processing_error"), F.col("error")).alias("metadata"),
    )


def workbook_rows(raw: DataFrame, options: DecodeOptions = DecodeOptions()) -> DataFrame:
    """`(path, file, worksheet, sheet_index, row_number, cells, data)` per data row.

    Headers go by column position; a used column without a header is named after
    its number. `cells` are text, `data` keeps booleans and numbers.
    """
    rows = raw.where(F.col("error").isNull())
    if not options.process_all_worksheets:
        rows = rows.where(F.lower("worksheet").isin(*[w.lower() for w in options.worksheets]))
    if options.skip_hidden_rows:
        rows = rows.where(~F.col("hidden"))
    if options.use_first_row_as_header:
        rows = rows.where(F.col("row_number") > F.col("first_row") + options.header_row_index)

    def name_of(number, cell):
        text = format_cell(cell["kind"], cell["raw"], options)
        named = normalize_header(text) if options.normalize_headers else text
        generated = F.concat(F.lit(options.column_prefix), number.cast("string"))
        usable = F.lit(options.use_first_row_as_header) & (F.trim(named) != "")
        return F.when(usable, named).otherwise(generated)

    # Own columns, so that each expression is evaluated once.
    entries = (
        rows.withColumn("_names", F.zip_with("columns", "header", name_of))
        .withColumn(
            "_entries",
            F.zip_with("_names", "cells", lambda n, c: F.struct(n.alias("key"), c.alias("value"))),
        )
        .withColumn("_entries", last_wins(F.col("_entries")))
    )
    text = F.transform(
        "_entries",
        lambda e: F.struct(
            e["key"].alias("key"), format_cell(e["value"]["kind"], e["value"]["raw"], options).alias("value")
        ),
    )
    data = F.to_variant_object(
        F.map_from_arrays(
            F.transform("_entries", lambda e: e["key"]),
            F.transform("_entries", lambda e: cell_variant(e["value"]["kind"], e["value"]["raw"], options)),
        )
    )
    return entries.select(
        "path", "file", "worksheet", "sheet_index", "row_number", text.alias("cells"), data.alias("data")
    )


def xlsx_rows(spark: SparkSession, path: str | list[str], options: DecodeOptions = DecodeOptions(), **how) -> DataFrame:
    return workbook_rows(raw_workbooks(spark, path, options, **how), options)
