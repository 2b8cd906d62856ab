"""DOCX packages as ordered blocks, read by Spark's binaryFile source and the standard library alone."""

from __future__ import annotations

import hashlib
import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
PARTS = ("word/document.xml", "word/styles.xml", "docProps/core.xml")
FLAGS = {"b": "bold", "i": "italic", "u": "underline", "strike": "strike"}
#: The schema of a block row.
BLOCKS = "file string, source_hash string, part string, position int, block_id string, type string, raw_text string, style_id string, runs array<struct<position int, raw_text string, bold boolean, italic boolean, underline boolean, strike boolean>>, cells array<struct<row_index int, column_index int, paragraphs array<string>>>"


def member(archive: bytes, name: str) -> bytes:
    """The one member of that exact name; anything else is an error."""
    try:
        with zipfile.ZipFile(io.BytesIO(archive)) as z:
            found = [i for i in z.infolist() if i.filename == name]
            if len(found) != 1:
                raise ValueError(f"{name}: found {len(found)}, not 1")
            return z.read(found[0])
    except zipfile.BadZipFile as e:
        raise ValueError("not a ZIP archive") from e


def visible_text(node: ET.Element) -> str:
    """Text nodes in order; tab as a tab, cr and line breaks as a newline, page breaks as nothing."""
    out = []
    for x in node.iter():
        if x.tag == W + "t":
            out.append(x.text or "")
        elif x.tag == W + "tab" and not list(x) and x.get(W + "pos") is None:
            out.append("\t")
        elif x.tag == W + "cr" or x.tag == W + "br" and x.get(W + "type", "textWrapping") == "textWrapping":
            out.append("\n")
    return "".join(out)


def _flag(properties: ET.Element | None, tag: str) -> bool | None:
    found = None if properties is None else properties.find(W + tag)
    return None if found is None else found.get(W + "val", "true") not in ("0", "false", "none")


def _paragraph(p: ET.Element) -> dict:
    style, runs = p.find(f"{W}pPr/{W}pStyle"), []
    for child in p:
        if child.tag == W + "r":
            own = child.find(W + "rPr")
            runs.append({"position": len(runs), "raw_text": visible_text(child)} | {name: _flag(own, tag) for tag, name in FLAGS.items()})
        elif child.tag != W + "pPr":  # its text would be in no run
            raise ValueError(f"unexpected {child.tag} in a paragraph")
    return {"type": "paragraph", "raw_text": "".join(visible_text(c) for c in p if c.tag != W + "pPr"), "style_id": None if style is None else style.get(W + "val"), "runs": runs, "cells": None}


def _table(t: ET.Element) -> dict:
    cells = []
    for r, row in enumerate(t.findall(W + "tr")):
        for c, cell in enumerate(row.findall(W + "tc")):
            if cell.find(f"{W}tcPr/{W}gridSpan") is not None or cell.find(f"{W}tcPr/{W}vMerge") is not None or cell.find(W + "tbl") is not None:
                raise ValueError("merged cells and nested tables are not supported")
            cells.append({"row_index": r, "column_index": c, "paragraphs": [visible_text(p) for p in cell.findall(W + "p")]})
    return {"type": "table", "raw_text": None, "style_id": None, "runs": None, "cells": cells}


def blocks_of(content: bytes, file: str = "") -> list[dict]:
    """Ordered blocks of the body, then of each header and footer part; positions count all children of a part."""
    source = hashlib.sha256(content).hexdigest()
    for name in PARTS:
        member(content, name)
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        extra = sorted(n for n in z.namelist() if n.startswith(("word/header", "word/footer")))
    out = []
    for part in (PARTS[0], *extra):
        root = ET.fromstring(member(content, part))
        top = root.find(W + "body") if part == PARTS[0] else root
        if top is None:
            raise ValueError("no body")
        for position, child in enumerate(top):
            if child.tag == W + "sectPr":
                continue
            if child.tag not in (W + "p", W + "tbl"):
                raise ValueError(f"unexpected {child.tag} in {part}")
            path = f"/{position}"
            own = _paragraph(child) if child.tag == W + "p" else _table(child)
            out.append({"file": file, "source_hash": source, "part": part, "position": position, "block_id": hashlib.sha256(f"{source}:{part}:{path}".encode()).hexdigest()} | own)
    return out


def core_properties(content: bytes) -> list[dict]:
    """Children of docProps/core.xml in order: qualified_name, name, raw_value, attributes."""
    root = ET.fromstring(member(content, PARTS[2]))
    return [{"qualified_name": x.tag, "name": x.tag.rpartition("}")[2], "raw_value": x.text, "attributes": dict(x.attrib)} for x in root]


def read_docx(spark: SparkSession, path: str, inside: str | None = None) -> DataFrame:
    """Block rows of the DOCX files at ``path``; with ``inside`` the files are ZIP archives and that member is the DOCX."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(BLOCKS)
    shape = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_pylist(blocks_of(member(content, inside) if inside else content, name), shape)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)
