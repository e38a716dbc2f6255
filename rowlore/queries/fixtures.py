"""Files that queries decode, made from the given tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlore.queries.book import load

HEADER = ("Order Key", "", "Date", "Price", "Urgent")
BOOK_ROWS = 20_000  # order keys per workbook


def _sheet(orders: Iterable[dict], texts: dict[str, int]) -> Iterator[str]:
    """One worksheet in pieces; its texts are shared ones."""
    shared = lambda column, row, value: f'<c r="{column}{row}" t="s"><v>{texts.setdefault(value, len(texts))}</v></c>'
    yield f'<worksheet><sheetData><row r="1">{"".join(shared(c, 1, h) for c, h in zip("ABCDE", HEADER) if h)}</row>'
    for n, o in enumerate(orders, 2):
        yield (
            f'<row r="{n}"><c r="A{n}"><v>{o["key"]}</v></c>{shared("B", n, o["priority"])}'
            f'<c r="C{n}" s="1"><v>{o["day"]}</v></c><c r="D{n}"><v>{o["price"]!r}</v></c><c r="E{n}" t="b"><v>{int(o["urgent"])}</v></c></row>'
        )
    yield "</sheetData></worksheet>"


def _book(orders: Iterable[dict]) -> bytes:
    """A workbook of orders sorted by status, compressed as they come."""
    names, texts, out = [], {}, io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for i, (status, some) in enumerate(groupby(orders, itemgetter("status"))):
            names.append(status)
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as part:
                for piece in _sheet(some, texts):
                    part.write(piece.encode())
        listed = "".join(f'<sheet name="{escape(s)}" r:id="r{i}"/>' for i, s in enumerate(names))
        z.writestr("xl/workbook.xml", f'<workbook xmlns:r="http://r"><sheets>{listed}</sheets></workbook>')
        targets = "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(len(names)))
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{targets}</Relationships>")
        z.writestr("xl/styles.xml", '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f"<sst>{''.join(f'<si><t>{escape(t)}</t></si>' for t in texts)}</sst>")
    return out.getvalue()


def _books(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Orders sorted by file and status to workbooks, each given on as soon as it is whole."""
    rows = (row for batch in batches for row in batch.to_pylist())
    for file, orders in groupby(rows, itemgetter("file")):
        path = None if file is None else f"/{file}"
        yield pa.RecordBatch.from_pydict({"path": pa.array([path], pa.string()), "file": pa.array([file], pa.string()), "content": [_book(orders)]})


def order_workbooks(spark: SparkSession, sf: str) -> DataFrame:
    """`(path, file, content)`: all orders as workbooks of so many keys, a worksheet for each status.

    A task streams its sorted orders: it holds a batch of them and one compressed workbook.
    """
    rows = load(spark, sf, "orders").select(
        F.concat(F.floor(F.col("o_orderkey") / BOOK_ROWS).cast("string"), F.lit(".xlsx")).alias("file"),
        F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
        (F.unix_date(F.to_date("o_orderdate")) + 25569).alias("day"), F.col("o_totalprice").alias("price"),
        (F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
    )
    # A fixed partition count keeps AQE from putting all workbooks into one task.
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartition(parts, "file").sortWithinPartitions("file", "status", "key", "priority", "day", "price", "urgent")
    return dealt.mapInArrow(_books, "path string, file string, content binary")
