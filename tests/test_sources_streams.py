"""Files, recognition with a cache, session tables, and streams."""

import io
import zipfile

from pyspark.sql import functions as F

from inkstone.functions.register import register
from inkstone.sources import files
from inkstone.streaming import events

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def p(text, style=""):
    return f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'


def test_parse(spark, tmp_path):
    table = "<w:tbl><w:tr><w:tc>" + p("a") + "</w:tc><w:tc>" + p("b") + "</w:tc></w:tr></w:tbl>"
    for name, content in {"x.docx": docx(table + p("Head", "Heading2") + p("body")), "z.docx": docx(""), "w.docx": b"junk", "a.PDF": b"%PDF", "b.xyz": b"1", "first.pdf": b"x"}.items():
        (tmp_path / name).write_bytes(content)
    docs = files.files(spark, str(tmp_path))
    empty = spark.createDataFrame([("y.docx", b"")], "path string, content binary")  # Spark's reader skips files without bytes
    got = {r.path.rsplit("/")[-1]: r for r in files.parse(docs.select("path", "content").unionByName(empty), {"pdf": lambda b: ["page 1", "page 2"] if b == b"%PDF" else []}).collect()}
    assert got["x.docx"].text == "## Head\nbody\na | b"
    assert {k: got[k].error_class for k in ("y.docx", "z.docx", "w.docx", "b.xyz", "first.pdf")} == {"y.docx": "FileCorruptedError", "z.docx": "EmptyDocumentError", "w.docx": "FileCorruptedError", "b.xyz": "FileNotSupportedError", "first.pdf": "EmptyDocumentError"}
    kinds = {r.path.rsplit("/")[-1]: r.s for r in docs.select("path", files.source_class(F.col("path")).alias("s")).collect()}
    assert kinds["first.pdf"] == "ir_report" and kinds["a.PDF"] == "pdf" and kinds["x.docx"] == "docx" and kinds["b.xyz"] == "generic"
    meta = {r.filename: r for r in files.metadata(docs).collect()}
    assert meta["a.PDF"].file_format == "pdf" and meta["a.PDF"].file_size_bytes == 4 and meta["a.PDF"].language is None


def test_recognition_reads_only_what_is_missing(spark):
    docs = spark.createDataFrame([("p1", b"one"), ("p2", b"two"), ("p3", b"one")], "path string, content binary")
    cache = docs.where("path = 'p2'").select(files.content_hash(F.col("content")).alias("content_hash"), F.lit(0).alias("page_index"), F.lit("cached").alias("text"))
    pages, new = files.recognise(docs, cache, lambda b: [b.decode() + "!"])
    assert sorted((r.path, r.text) for r in pages.collect()) == [("p1", "one!"), ("p2", "cached"), ("p3", "one!")] and new.count() == 1


def test_language(spark):
    cases = {"매출이 늘었다 B2B": "ko", "The sum of the parts is in the table": "en", "le chat et la souris dans une maison": "fr", "der Hund und die Katze ist im Haus": "de", "el perro y los gatos con una casa": "es", "123": None, "": None}
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string").select("i", files.language(F.col("t")).alias("l")).orderBy("i").collect()
    assert [r.l for r in rows] == list(cases.values())


def test_functions_and_tables(spark):
    assert "terms" in register(spark)
    r = spark.sql("SELECT fix_tildes('3.0~~3.5') AS a, collection_name('x') AS b, bullet_budget(11) AS c, terms('ROE 12.3%') AS d").first()
    assert r.a == "3.0-3.5" and len(r.b) == 12 and r.c == 8 and r.d == ["ROE", "12", "3"]


def test_stages(spark):
    rows = [(1, "search_start", "2024-01-01 00:00:00"), (1, "search_done", "2024-01-01 00:00:03"), (1, "rerank_done", "2024-01-01 00:00:04"), (1, "answer_start", "2024-01-01 00:00:05"), (2, "x", "2024-01-01 00:00:05")]
    df = spark.createDataFrame(rows, "thread_id long, event string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert sorted((r.stage, r.seconds) for r in events.stages(df).collect()) == [("answer", None), ("search", 3.0)]


def test_streams_agree_with_tables(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{source}/events.parquet")
    stream = spark.readStream.schema(table.schema).option("pathGlobFilter", "events.parquet").parquet(source)
    for name, op in {"tumbling": events.tumbling, "session": events.sessions}.items():
        q = op(stream).writeStream.outputMode("complete" if name == "tumbling" else "append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = {tuple(r[:2]) for r in spark.sql(f"SELECT * FROM {name}").collect()}
        want = {tuple(r[:2]) for r in op(table).collect()}
        assert got == want if name == "tumbling" else got and got <= want
    docs = spark.readStream.schema("scope string, item int, text string").json(str(tmp_path / "in"))if (tmp_path / "in").mkdir() is None else None
    (tmp_path / "in" / "a.json").write_text('{"scope": "s", "item": 1, "text": "a b a"}\n')
    events.index_arrivals(docs, str(tmp_path / "idx"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted((r.term, r.tf) for r in spark.read.parquet(str(tmp_path / "idx")).collect()) == [("a", 2), ("b", 1)]
