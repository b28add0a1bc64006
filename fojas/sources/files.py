"""Reading files of several formats as texts, JSON lines and vector files; writing tables."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fojas.sources.html import page_text

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def docx_text(data: bytes) -> str:
    """Paragraphs that aren't blank, then the rows of all tables with cells joined by `` | ``."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))[0]

    def text(e) -> str:
        return "".join(x.text or "" for x in e.iter(_W + "t"))

    lines = [t for t in (text(e) for e in body if e.tag == _W + "p") if t.strip()]
    for table in body.iter(_W + "tbl"):
        lines += [" | ".join(text(c).strip() for c in row.iter(_W + "tc")) for row in table.iter(_W + "tr")]
    return "\n".join(lines)


def xlsx_text(data: bytes) -> str:
    """For each sheet a line with its name, then its rows as comma-separated values."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in e.iter(_S + "t")) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
    targets = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(_S + "sheet"):
        out.append(f"[Hoja: {sheet.get('name')}]")
        for row in ElementTree.fromstring(z.read("xl/" + targets[sheet.get(_R + "id")].lstrip("/").removeprefix("xl/"))).iter(_S + "row"):
            cells: dict[int, str] = {}
            for c in row.iter(_S + "c"):
                v = c.find(_S + "v")
                value = "".join(t.text or "" for t in c.iter(_S + "t")) if v is None else v.text or ""
                letters = re.match("[A-Z]+", c.get("r", "A"))[0]
                at = 0
                for x in letters:
                    at = at * 26 + ord(x) - 64
                cells[at - 1] = shared[int(value)] if c.get("t") == "s" and value else value
            values = [cells.get(i, "") for i in range(max(cells, default=-1) + 1)]
            out.append(",".join(f'"{v.replace(chr(34), chr(34) * 2)}"' if re.search('[",\n]', v) else v for v in values))
    return "\n".join(out)


def pdf_text(data: bytes) -> str:
    """Text of the pages that have any, where the optional library is installed."""
    from pypdf import PdfReader

    return "\n".join(t for t in (p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages) if t)


#: Reader by the ending of the path; others can be added. Formats without a reader are reported, not dropped.
READERS: dict[str, Callable[[bytes], str]] = {
    ".html": lambda b: page_text(b.decode("utf-8", "ignore")), ".htm": lambda b: page_text(b.decode("utf-8", "ignore")),
    ".docx": docx_text, ".xlsx": xlsx_text, ".pdf": pdf_text,
}


def read_files(spark: SparkSession, path: str, readers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(path, formato, bytes, texto, error) of every file below a folder; a file that can't be read has its error and a null text."""
    readers = readers or READERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, errors = [], []
            for p, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                ending = re.search(r"\.[^./]*$", p.lower())
                try:
                    texts.append(readers[ending[0] if ending else ""](data))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - any broken file
                    texts.append(None)
                    errors.append("format not supported" if isinstance(e, KeyError) else f"{type(e).__name__}: {e}"[:200])
            yield pa.record_batch([b.column("path"), b.column("formato"), b.column("length"), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["path", "formato", "bytes", "texto", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.select("path", F.regexp_extract(F.lower("path"), r"\.([^./]*)$", 1).alias("formato"), "length", "content")
    return files.mapInArrow(run, "path string, formato string, bytes long, texto string, error string")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines file with a declared schema; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_vectors(spark: SparkSession, path: str, n: int, dim: int) -> DataFrame | None:
    """(pos, vector) of flat little-endian float32 files; None if their size isn't n * dim numbers.

    ``path`` names one file, read by one task; large collections belong in Parquet.
    """
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    if size != n * dim * 4:
        return None
    rows = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column("content").to_pylist():
                v = np.frombuffer(raw, "<f4").reshape(-1, dim)
                for i in range(0, len(v), 4096):
                    some = v[i : i + 4096]
                    yield pa.record_batch({"pos": pa.array(np.arange(i, i + len(some))), "vector": pa.array(list(some), pa.list_(pa.float32()))})

    return rows.mapInArrow(run, "pos long, vector array<float>")


def create_or_replace(df: DataFrame, path: str, recreate: bool = False) -> None:
    """Write a table; without ``recreate`` an existing one is left as it is."""
    df.write.mode("overwrite" if recreate else "ignore").parquet(path)


def append(df: DataFrame, path: str) -> None:
    """Add rows to a table, for logs and incremental indexing."""
    df.write.mode("append").parquet(path)


def export_json_lines(df: DataFrame, path: str) -> None:
    """JSON lines without null fields."""
    df.write.mode("overwrite").option("ignoreNullFields", "true").json(path)
