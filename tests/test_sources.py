import io
import zipfile

from sievelight.lexicon import LATIN
from sievelight.sources import attachments, pages
from sievelight.streaming import tasks

PAGE = """<html><head><title>Long title of the page - site</title></head><body><nav>Home About</nav>
<div class="article-content"><p>First paragraph with enough words to count as text.</p><p>Second paragraph, also long enough.</p>
<a href="/files/form.pdf">Form</a><span class="wp_pdf_player" pdfsrc="/x/y.pdf"></span></div>
<a href="/next.htm#top">next</a><a href="javascript:void(0)">no</a><a href="https://other.org/">other</a><footer>footer text</footer></body></html>"""


def read(spark, *rows):
    return pages.parsed(spark.createDataFrame(rows, "url string, html string"), LATIN).collect()


def test_page(spark):
    out = read(spark, ("https://www.x.org/2023/0918/a.htm", PAGE))[0]
    assert out["kind"] == "article" and "First paragraph" in out["body"] and "footer" not in out["body"]
    assert out["links"] == ["https://www.x.org/next.htm"]
    assert {a["url"] for a in out["attachments"]} == {"https://www.x.org/files/form.pdf", "https://www.x.org/x/y.pdf"}
    assert pages.title_of(pages.Tree("<title>A long title -  Some School home</title>").root, "Some School") == "A long title"


def test_broken_pages_do_not_crash(spark):
    broken = (None, "", "<", "<p", "<div><div>" * 2000, "text only", "<a href='http://[bad'>x</a>")
    out = read(spark, *(("https://x.org/", page) for page in broken), (None, PAGE))
    assert len(out) == 8 and {r["kind"] for r in out} == {"home"}


def package(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in files.items():
            z.writestr(name.replace("__", "/").replace("_x", ".x"), content)
    return out.getvalue()


def test_office_files(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    docx = package(word__document_xml=f"<w:document {w}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    r = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    xlsx = package(xl__workbook_xml=f'<workbook {r}><sheets><sheet name="S" r:id="r1"/></sheets></workbook>', xl__worksheets__sheet1_xml='<worksheet><sheetData><row><c t="s"><v>0</v></c><c><v>2</v></c></row></sheetData></worksheet>', xl__sharedStrings_xml="<sst><si><t>name</t></si></sst>")
    ole = b"\xd0\xcf\x11\xe0" + b"\x00" * 8 + "关于转专业工作安排的通知内容如下所示".encode("utf-16le")
    for name, data in {"a.docx": docx, "b.xlsx": xlsx, "c.doc": ole, "d.pdf": b"%PDF-1.4", "e.docx": b"PK\x03\x04broken", "f.bin": b"??"}.items():
        (tmp_path / name).write_bytes(data)
    out = {r["path"].rsplit("/", 1)[-1]: r for r in attachments.parsed(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert out["a.docx"]["text"] == "Hello\na | b" and out["a.docx"]["n_rows"] == 1
    assert out["b.xlsx"]["sheets"][0]["text"] == "name | 2"
    assert "转专业工作安排" in out["c.doc"]["text"] and out["d.pdf"]["status"] == "no_reader"
    assert out["e.docx"]["status"].startswith("error") and out["f.bin"]["status"] == "unsupported"


def test_reachable(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    start = spark.createDataFrame([(1,)], "node long")
    assert {(r["node"], r["depth"]) for r in pages.reachable(edges, start, 2).collect()} == {(1, 0), (2, 1), (3, 2)}


def test_stream_ingest(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string").write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema("id long, t string").parquet(str(tmp_path / "in"))
    tasks.ingest(stream, lambda batch, n: seen.append((n, batch.count())), str(tmp_path / "cp")).awaitTermination()
    assert sum(n for _, n in seen) == 2


def test_entry_works_without_the_corpus_operators():
    import subprocess
    import sys

    code = "import sys, importlib.util as u; f = u.find_spec; u.find_spec = lambda n, *a: None if n.startswith(('sievelight.llm', 'corpus_pipeline')) else f(n, *a); import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q); assert not any(k.startswith('op') and k[2].isdigit() for k in q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])


def test_pages_are_read_in_small_batches(spark):
    pages_read = pages.parsed(spark.createDataFrame([("https://x.org/", PAGE)], "url string, html string"), LATIN)
    plan = pages_read._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
