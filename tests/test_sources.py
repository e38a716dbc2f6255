import os
import zipfile
import zlib
from collections import Counter
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowlore.functions.maps import entries_to_map
from rowlore.model import DecodeOptions
from rowlore.operators.aggregates import import_summary
from rowlore.operators.store import RecordStore, Written
from rowlore.plans.ingest import ingest_tabular, store_schemas
from rowlore.queries import files, fixtures
from rowlore.sources.decoders import decode, register_decoder
from rowlore.sources.delimited import csv_rows, read_lines
from rowlore.sources.folders import extension_counts, read_texts, route, scan_files, whole_files
from rowlore.sources.workbooks import SharedTexts, decode_errors, decode_workbooks, raw_workbooks, workbook_rows, worksheets, xlsx_rows
from rowlore.streaming.incremental import file_stream, ingest_new_files, ingest_new_tables, line_stream, run_once

CSV = 'Server Name,Env,,Env\nA1,Prod,x,y,EXTRA\n\n"B ""2""",,z\n'


def as_dicts(df):
    rows = df.select("row_number", entries_to_map(F.col("cells")).alias("m")).orderBy("row_number").collect()
    return {r["row_number"]: r["m"] for r in rows}


def test_csv_golden(spark, tmp_path):
    (tmp_path / "a.csv").write_text(CSV)
    assert as_dicts(csv_rows(spark, str(tmp_path))) == {
        2: {"Server_Name": "A1", "Env": "y", "Column3": "x", "Column5": "EXTRA"},
        4: {"Server_Name": 'B "2"', "Env": "", "Column3": "z"},
    }
    kept = as_dicts(csv_rows(spark, str(tmp_path), DecodeOptions(skip_empty_rows=False)))
    assert sorted(kept) == [2, 3, 4]


def reference_fields(line):
    """Brute force: one character at a time."""
    fields, out, quoted, i = [], "", False, 0
    if line == "":
        return fields
    while i < len(line):
        c = line[i]
        if c == '"' and quoted and line[i + 1 : i + 2] == '"':
            out, i = out + '"', i + 1
        elif c == '"':
            quoted = not quoted
        elif c == "," and not quoted:
            fields, out = [*fields, out], ""
        else:
            out += c
        i += 1
    return [*fields, out]


def test_csv_lines_against_brute_force(spark, tmp_path):
    import itertools

    lines = ["".join(p) for n in range(1, 7) for p in itertools.product('",a', repeat=n)]
    (tmp_path / "q.csv").write_text("h\n" + "\n".join(lines) + "\n")
    got = {r["row_number"]: r["fields"] for r in read_lines(spark, str(tmp_path)).collect()}
    assert got == {i + 2: reference_fields(line) for i, line in enumerate(lines)}


def test_csv_header_offset_and_split_files(spark, tmp_path, table):
    """Line numbers hold when files are cut into many splits."""
    part = table("part").orderBy("p_partkey").toPandas()
    for n in range(3):
        part.to_csv(tmp_path / f"p{n}.csv", index=False)
    (tmp_path / "c.csv").write_text("title\nA,B\n1,2\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        rows = csv_rows(spark, str(tmp_path), pattern="p*.csv").select(
            "file", "row_number", entries_to_map(F.col("cells"))["p_partkey"].alias("k")
        )
        assert rows.rdd.getNumPartitions() > 3
        assert rows.where(F.col("row_number") != F.col("k") + 2).count() == 0
        assert rows.count() == 3 * len(part)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert as_dicts(csv_rows(spark, str(tmp_path), DecodeOptions(header_row_index=1), "c.csv")) == {3: {"A": "1", "B": "2"}}


SHEET = """<worksheet xmlns="m"><cols><col min="3" max="3" hidden="1"/></cols><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Secret</t></is></c><c r="D1" t="inlineStr"><is><t>When</t></is></c><c r="E1" t="str"><v>At</v></c><c r="F1" t="str"><v>Err</v></c></row>
<row r="2"><c r="A2" t="inlineStr"><is><t>SVR01</t></is></c><c r="B2" t="b"><v>1</v></c><c r="C2"><v>9</v></c><c r="D2" s="1"><v>45296</v></c><c r="E2" s="2"><v>0.5</v></c><c r="F2" t="e"><v>#N/A</v></c></row>
<row r="3" hidden="1"><c r="A3"><v>1</v></c></row>
<row r="4"/>
<row r="5"><c r="A5"><v>1.5</v></c></row>
</sheetData></worksheet>"""
SHEET2 = """<worksheet xmlns="m"><sheetData><row r="3"><c r="B3" t="inlineStr"><is><t>X Y</t></is></c></row>
<row r="4"><c r="B4"><v>7</v></c></row></sheetData></worksheet>"""


def write_workbook(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="m" xmlns:r="http://r"><sheets><sheet name="One" r:id="r1"/><sheet name="Two" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="m"><si><t>Server Name</t></si></sst>')
        z.writestr("xl/styles.xml", '<styleSheet xmlns="m"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="21"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", SHEET)
        z.writestr("xl/worksheets/sheet2.xml", SHEET2)


def test_workbook_golden(spark, tmp_path):
    write_workbook(tmp_path / "w.xlsx")
    (tmp_path / "bad.xlsx").write_bytes(b"not a zip")
    raw = raw_workbooks(spark, str(tmp_path))
    rows = workbook_rows(raw).orderBy("sheet_index", "row_number").collect()
    assert [(r["worksheet"], r["row_number"]) for r in rows] == [("One", 2), ("One", 5), ("Two", 4)]
    assert rows[0]["data"].toPython() == {
        "Server_Name": "SVR01", "Column2": True, "When": "2024-01-05", "At": "12:00:00", "Err": "#N/A",
    }
    assert rows[1]["data"].toPython() == {"Server_Name": 1.5, "Column2": "", "When": "", "At": "", "Err": ""}
    assert rows[2]["data"].toPython() == {"X_Y": 7.0}
    errors = decode_errors(raw).collect()
    assert [e["file"] for e in errors] == ["bad.xlsx"] and "BadZipFile" in errors[0]["metadata"]["processing_error"]


def test_workbook_options(spark, tmp_path):
    write_workbook(tmp_path / "w.xlsx")
    options = DecodeOptions(process_all_worksheets=False, worksheets=("two",), use_first_row_as_header=False)
    rows = xlsx_rows(spark, str(tmp_path), options).orderBy("row_number").collect()
    assert [r["data"].toPython() for r in rows] == [{"Column2": "X Y"}, {"Column2": 7.0}]
    shown = xlsx_rows(spark, str(tmp_path), DecodeOptions(skip_hidden_rows=False, skip_hidden_columns=False))
    assert shown.count() == 4
    assert "Secret" in shown.where("row_number = 2 and worksheet = 'One'").first()["data"].toPython()


def test_folder_scan_and_route(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a b+c.CSV").write_text("x\n1\n")
    (tmp_path / "n.txt").write_text("hello\nworld")
    (tmp_path / "sub" / "m.xlsx").write_bytes(b"x")
    files = {r["file"]: r["route"] for r in route(scan_files(spark, str(tmp_path))).collect()}
    assert files == {"a b+c.CSV": "tabular", "n.txt": "text", "m.xlsx": "tabular"}
    assert {r["file"] for r in scan_files(spark, str(tmp_path), recursive=False).collect()} == {"a b+c.CSV", "n.txt"}
    assert {r["file"] for r in scan_files(spark, str(tmp_path), "*.txt").collect()} == {"n.txt"}
    assert {r["extension"]: r["files"] for r in extension_counts(scan_files(spark, str(tmp_path))).collect()} == {
        "csv": 1, "txt": 1, "xlsx": 1,
    }
    assert read_texts(spark, str(tmp_path), "*.txt").first()["text"] == "hello\nworld"


def test_decoder_registry(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("A\tB\n1\t2\n")

    def tsv(session, path, options):
        from rowlore.functions.maps import entries_to_variant
        from rowlore.functions.values import typed_variant

        lines = session.read.option("wholetext", True).text(path + "/a.tsv")
        cells = F.array(F.struct(F.lit("A").alias("key"), F.lit("1").alias("value")))
        return lines.select(
            F.lit("a.tsv").alias("path"), F.lit("a.tsv").alias("file"), F.lit("a").alias("worksheet"),
            F.lit(2).alias("row_number"), cells.alias("cells"),
        ).withColumn("data", entries_to_variant(F.col("cells"), typed_variant))

    register_decoder(".TSV", tsv)
    assert decode(spark, str(tmp_path), "tsv").first()["data"].toPython() == {"A": 1}


def test_ingest(spark, tmp_path):
    (tmp_path / "srv.csv").write_text("Server Name,Count\nA1,5\nA2,\n")
    write_workbook(tmp_path / "w.xlsx")
    at = datetime(2024, 1, 5)
    done = ingest_tabular(spark, str(tmp_path), "csv", "default", at, width=16)
    rows = done.records.orderBy("row_number").collect()
    assert [r["data"].toPython() for r in rows] == [{"server_name": "A1", "count": 5}, {"server_name": "A2", "count": None}]
    assert rows[0]["dataset"] == "srv" and rows[0]["text"].startswith("Record from worksheet srv.csv, row 2: schema_id is schema_srv_")
    assert len(rows[0]["embedding"]) == 16
    catalog = store_schemas(None, done.schemas).first()
    assert [(c["name"], c["data_type"], c["common_values"]) for c in catalog["columns"]] == [
        ("Server_Name", "string", ["A1", "A2"]), ("Count", "string", ["5"]),
    ]
    assert catalog["id"] == rows[0]["schema_id"] and catalog["metadata"] == {"document_type": "schema"}
    again = ingest_tabular(spark, str(tmp_path), "csv", "default", at, width=16)
    assert {r["id"] for r in again.records.collect()} == {r["id"] for r in rows}
    book = ingest_tabular(spark, str(tmp_path), "xlsx", "servers", at, width=16)
    assert book.records.count() == 3
    summary = import_summary(book.records, ("file", "worksheet")).collect()
    assert {(r["worksheet"], r["imported_rows"]) for r in summary} == {("One", 2), ("Two", 1)}


def test_incremental_second_run_adds_nothing(spark, tmp_path):
    src, out, check = tmp_path / "in", tmp_path / "out", tmp_path / "check"
    src.mkdir()
    (src / "a.csv").write_text("x\n1\n")
    run = lambda: run_once(file_stream(spark, str(src)).drop("content"), str(out), str(check))
    run()
    assert spark.read.parquet(str(out)).count() == 1
    run()
    assert spark.read.parquet(str(out)).count() == 1
    (src / "b.csv").write_text("x\n2\n")
    run()
    assert {r["file"] for r in spark.read.parquet(str(out)).collect()} == {"a.csv", "b.csv"}
    seen = []
    ingest_new_files(spark, str(src), lambda df, n: seen.append(df.count()), str(tmp_path / "check2"))
    ingest_new_files(spark, str(src), lambda df, n: seen.append(df.count()), str(tmp_path / "check2"))
    assert sum(seen) == 2
    run_once(line_stream(spark, str(src)), str(tmp_path / "out3"), str(tmp_path / "check3"))
    assert spark.read.parquet(str(tmp_path / "out3")).count() == 4


def test_incremental_tables_reach_the_store(spark, tmp_path):
    """A second run, a repeated batch and a file written again add no record; new files do."""
    src = tmp_path / "in"
    src.mkdir()
    (src / "a [1]{x}.csv").write_text("Name,Size\nA,1\nB,2\n")
    (src / "b.csv").write_text("Name,Size\nC,3\n")
    store = RecordStore(spark, str(tmp_path / "store"))
    store.create("c", 4, 2)
    run = lambda check: ingest_new_tables(spark, str(src), "csv", "d", store, "c", str(tmp_path / check), width=4, batches=done)
    done = []
    run("check")
    run("check")
    assert [w for _, w in done] == [Written(3, 0, 3, 0, 0)]
    run("another")  # the same files as a batch that was not known to be done
    assert done[-1][1] == Written(3, 0, 0, 3, 0)
    (src / "c.csv").write_text("Name,Size\nD,4\n")
    run("check")
    assert done[-1][1] == Written(1, 0, 1, 0, 0) and len(done) == 3
    rows = store.read("c").collect()
    assert {(r["file"], r["row_number"], r["data"].toPython()["name"]) for r in rows} == {("a [1]{x}.csv", 2, "A"), ("a [1]{x}.csv", 3, "B"), ("b.csv", 2, "C"), ("c.csv", 2, "D")}
    assert [f.name for f in tmp_path.iterdir() if f.name == "in"] and spark.conf.get("spark.sql.files.minPartitionNum", None) is None


def test_worksheets_are_tasks_of_their_own(spark, tmp_path):
    write_workbook(tmp_path / "w.xlsx")
    (tmp_path / "cut.xlsx").write_bytes((tmp_path / "w.xlsx").read_bytes()[:-400])
    parts = worksheets(scan_files(spark, str(tmp_path), "*.xlsx", content=True))
    whole = parts.where("error IS NULL")
    assert [(r["sheet_index"], r["worksheet"]) for r in whole.orderBy("sheet_index").collect()] == [(0, "One"), (1, "Two")]
    assert parts.where("error IS NOT NULL").count() == 1
    plan = raw_workbooks(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "hashpartitioning(path" in plan
    many = spark.range(40).select(F.concat(F.lit("p"), "id").alias("path"), F.lit("w.xlsx").alias("file"), F.lit((tmp_path / "w.xlsx").read_bytes()).alias("content"))
    assert worksheets(many).select(F.spark_partition_id()).distinct().count() > 4


def test_shared_texts_beyond_memory(monkeypatch):
    monkeypatch.setattr("rowlore.sources.workbooks.TEXTS_IN_MEMORY", 100)
    listed = [f"text {i} é" * (i % 5) for i in range(300)]
    xml = "<sst>" + "".join(f"<si><r><t>{t[:3]}</t></r><r><t>{t[3:]}</t></r></si>" for t in listed) + "</sst>"
    deflate = zlib.compressobj(wbits=-15)
    texts = SharedTexts(8, deflate.compress(xml.encode()) + deflate.flush())
    assert [texts.get(i) for i in range(300)] == listed and SharedTexts(0, xml.encode()).get(7) == listed[7]
    with pytest.raises(EOFError):
        SharedTexts(8, (zlib.compressobj(wbits=-15).compress(os.urandom(5000)) or b"") + b"")


def test_workbooks_are_built_as_their_orders_come(spark, tmp_path):
    """A task holds the orders of a batch, not those of all its workbooks."""
    taken = []

    def batches():
        for n in range(4):
            taken.append(n)
            order = {"file": f"{n}.xlsx", "key": n, "status": "O", "priority": "5-LOW", "day": 45296, "price": 1.5, "urgent": False}
            yield pa.RecordBatch.from_pylist([order])

    books = fixtures._books(batches())
    assert next(books).column("file").to_pylist() == ["0.xlsx"] and taken == [0, 1]
    n = F.col("id")
    orders = spark.range(50_000).select(
        n.alias("o_orderkey"), F.substring(F.lit("FOP"), (n % 3 + 1).cast("int"), F.lit(1)).alias("o_orderstatus"),
        F.lit("1-URGENT").alias("o_orderpriority"), F.lit(datetime(2024, 1, 5)).alias("o_orderdate"), (n / 4).alias("o_totalprice"),
    )
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    books = fixtures.order_workbooks(spark, str(tmp_path))
    assert "collect_list" not in books._jdf.queryExecution().executedPlan().toString()
    got = workbook_rows(decode_workbooks(books)).groupBy("file", "worksheet").agg(F.count("*").alias("n"), F.max("row_number").alias("last"))
    found = {(r["file"], r["worksheet"]): (r["n"], r["last"]) for r in got.collect()}
    want = Counter((f"{i // 20_000}.xlsx", "FOP"[i % 3]) for i in range(50_000))
    assert found == {k: (n, n + 1) for k, n in want.items()}


@pytest.fixture
def many_tasks(spark, tmp_path):
    """Tables of one language and type whose exports take several tasks."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")}
    n, rows = F.col("id"), spark.range(400).repartition(4)
    tables = {
        "documents": rows.select(n.alias("doc_id"), F.concat(F.lit('a "b", '), n).alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"), n.alias("n_chars")),
        "customer": rows.select(n.alias("c_custkey"), F.concat(F.lit("c"), n).alias("c_name"), F.lit("X").alias("c_mktsegment"), (n - 100.0).alias("c_acctbal")),
        "part": rows.select(n.alias("p_partkey"), F.lit("PROMO").alias("p_type")),
    }
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    for key, value in zip(kept, ("false", "0", "4k")):
        spark.conf.set(key, value)
    yield str(tmp_path)
    for key, value in kept.items():
        spark.conf.set(key, value)


def test_csv_of_many_tasks_is_one_file(spark, many_tasks):
    """No task writes a whole language, and lines are numbered as in one file."""
    path = files.export_documents(spark, many_tasks)
    parts = scan_files(spark, path, "*.csv")
    assert parts.count() > 3 and whole_files(parts).count() == 1
    assert {r["file"].split(".", 1)[1] for r in whole_files(parts).collect()} == {"csv"}
    rows = files.q_csv_rows(spark, many_tasks).collect()
    assert sorted((r["row_number"], r["doc_id"]) for r in rows) == [(i + 2, i) for i in range(400)]
    # Headers further down, and parts shorter than that.
    lines = lambda at, whole: csv_rows(spark, path, DecodeOptions(header_row_index=at), whole=whole)
    assert sorted(r["row_number"] for r in lines(3, True).collect()) == list(range(5, 405 - 3 * parts.count()))
    assert lines(3, False).agg(F.max("row_number")).first()[0] < 404 and lines(10_000, True).count() == 0


def test_scans_of_many_tasks_count_files(spark, many_tasks):
    """No task writes a whole language, segment or type; the parts of a file count once."""
    root = files.export_mixed(spark, many_tasks)
    scanned = scan_files(spark, root)
    assert all(r["files"] > 1 for r in extension_counts(scanned).collect())
    whole = extension_counts(whole_files(scanned)).select("extension", "bytes").collect()
    assert set(whole) == set(extension_counts(scanned).select("extension", "bytes").collect())
    assert {tuple(r) for r in files.q_folder_scan(spark, many_tasks).collect()} == {("csv", 1), ("json", 1), ("txt", 1)}
    assert [tuple(r) for r in files.q_folder_scan_flat(spark, many_tasks).collect()] == [("PROMO", "json", 1)]
    assert {tuple(r) for r in files.q_route_by_extension(spark, many_tasks).collect()} == {("tabular", 1), ("text", 2)}
    assert [tuple(r) for r in files.q_import_summary(spark, many_tasks).collect()] == [("X", 400, 300, 100)]
    assert [tuple(r) for r in files.q_decode_errors(spark, many_tasks).collect()] == [("en", "web", "BadZipFile")]


def test_only_parts_of_one_write_are_one_file(spark, tmp_path):
    for _ in range(2):
        spark.range(6).repartition(3).write.mode("append").json(str(tmp_path / "a"))
    (tmp_path / "a" / "part-1-notes.json").write_text("{}")
    (tmp_path / "b.json").write_text("{}")
    assert scan_files(spark, str(tmp_path), "*.json").count() == 8
    got = whole_files(scan_files(spark, str(tmp_path), "*.json"))
    assert got.count() == 4 and {r["file"] for r in got.collect()} > {"b.json", "part-1-notes.json"}
