from __future__ import annotations

import io
import zipfile

from fojas.sources import files, html
from fojas.streaming import ingest

PAGE = """<html><body><header>H</header><div class="main-menu">M</div><div id="content"><h1>Título</h1><p>Uno <b>dos</b><br>tres</p>
<aside>A</aside><ul><li>x<li>y</ul></div><script>var a = "<p>";</script><a href="/d/f.PDF">f</a><a href="p?q=1">p</a><a href="mailto:x">m</a><a href="https://otro/">o</a></body>"""


def test_page_text():
    assert html.page_text(PAGE) == "Título\nUno dos\ntres\nx\ny"
    assert html.page_text("") == "" and html.page_text("solo <b>texto") == "solo texto"


def test_links():
    assert html.page_links(PAGE, "https://h.example/a/") == (["https://h.example/a/p?q=1"], ["https://h.example/d/f.PDF"])




def test_office_files(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>Hola </w:t></w:r><w:r><w:t>mundo</w:t></w:r></w:p><w:p/></w:body></w:document>")
    (tmp_path / "x.docx").write_bytes(out.getvalue())
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    r = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {s} {r}><sheets><sheet name="Uno" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {s}><si><t>a, b</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3</v></c></row></sheetData></worksheet>')
    (tmp_path / "y.xlsx").write_bytes(out.getvalue())
    (tmp_path / "z.odt").write_bytes(b"?")
    (tmp_path / "k.html").write_text("<p>hola", encoding="utf-8")
    got = {r["formato"]: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got["docx"]["texto"] == "Hola mundo\na | b" and got["xlsx"]["texto"] == '[Hoja: Uno]\n"a, b",,3' and got["html"]["texto"] == "hola"
    assert got["odt"]["texto"] is None and got["odt"]["error"] == "format not supported"


def test_vectors_and_json(spark, tmp_path):
    import numpy as np

    np.arange(12, dtype="<f4").tofile(tmp_path / "v.f32")
    assert files.read_vectors(spark, str(tmp_path / "v.f32"), 4, 4) is None
    assert [r["vector"] for r in files.read_vectors(spark, str(tmp_path / "v.f32"), 3, 4).orderBy("pos").collect()][1] == [4.0, 5.0, 6.0, 7.0]
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert files.read_json_lines(spark, str(tmp_path / "a.jsonl"), "a int").count() == 2


def test_streams(spark, tmp_path):
    base = spark.sql("SELECT 'd' AS doc_id, 0 AS chunk_index, 'h' AS doc_hash, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS ts, 'hybrid' AS modo, 2.0D AS latencia_ms")
    base.unionByName(base).unionByName(base.selectExpr("doc_id", "1 AS chunk_index", "CAST(NULL AS string) AS doc_hash", "ts", "modo", "latencia_ms")).write.parquet(str(tmp_path / "in"))
    schema = "doc_id string, chunk_index int, doc_hash string, ts timestamp_ntz, modo string, latencia_ms double"
    q = ingest.into_table(ingest.new_pieces(ingest.read_stream(spark, str(tmp_path / "in"), schema), "ts"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
