"""Registered queries of document packages and workbooks, made of the customers' table and read again, each with its SQL.

Files are read and written in Python, one at a time; everything between is DataFrame operations.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import dealt, table
from ..sources import docx, tables, xlsx
from .catalog import Query

S = "c_mktsegment"
_NS = f'xmlns:w="{docx.W}" xmlns:r="{docx.R}"'
_LINKS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="h" Target="header1.xml"/><Relationship Id="f" Target="footer1.xml"/></Relationships>'


def _paragraph(*runs: str) -> str:
    return "<w:p>" + "".join(f'<w:r><w:t xml:space="preserve">{escape(r)}</w:t></w:r>' for r in runs) + "</w:p>"


def package(key: str, name: str, segment: str) -> bytes:
    """A document with a header, three paragraphs (one in runs, one with odd spaces), a table, a box, a footer and properties."""
    cells = "".join(f"<w:tc>{_paragraph(c)}</w:tc>" for c in (name, f"key {key}"))
    body = _paragraph(f"Segment {segment}") + _paragraph("Mail u", f"{key}@exam", "ple.com now") + _paragraph(f"to  {segment}  now") + f"<w:tbl><w:tr>{cells}</w:tr></w:tbl><w:sdt><w:sdtContent>{_paragraph(f'Box {segment}')}</w:sdtContent></w:sdt>"
    parts = {
        "word/document.xml": f'<w:document {_NS}><w:body>{body}<w:sectPr><w:headerReference w:type="default" r:id="h"/><w:footerReference w:type="default" r:id="f"/></w:sectPr></w:body></w:document>',
        "word/header1.xml": f"<w:hdr {_NS}>{_paragraph(f'Head {name}')}</w:hdr>",
        "word/footer1.xml": f"<w:ftr {_NS}>{_paragraph(f'Foot {key}')}</w:ftr>",
        "word/_rels/document.xml.rels": _LINKS,
        "docProps/core.xml": f'<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>Report {escape(name)}</dc:title><dc:creator></dc:creator></cp:coreProperties>',
        "docProps/custom.xml": f'<Properties xmlns="{docx.CUSTOM_NS}" xmlns:vt="x"><property name="Client"><vt:lpwstr>{escape(segment)}</vt:lpwstr></property></Properties>',
    }
    return docx.packed({part: content.encode() for part, content in parts.items()}, zipfile.ZIP_STORED)


def _customers(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("doc_id"), "c_name", S)


def _files(spark, d) -> DataFrame:
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for g in docx.pieces(f):
                yield pd.DataFrame({"doc_id": g["doc_id"], "content": [package(*r) for r in g.itertuples(index=False)]})

    return dealt(_customers(spark, d)).mapInPandas(rows, "doc_id string, content binary")


def _uuid():
    return tx.hash_uuid(F.lit("mail"), F.col("doc_id"))


def _spans(spark, d, text) -> DataFrame:
    """Where the address, the name, the key and the segment stand in the documents, with their new texts."""
    rows = _customers(spark, d)
    mail = F.concat(F.lit("u"), F.col("doc_id"), F.lit("@example.com"))
    places = [("paragraph_1", 5, mail, "mail"), ("table_0_cell_0_0", 0, F.col("c_name"), "name"), ("sdt_0", 4, F.col(S), "segment"), ("header_0_0", 5, F.col("c_name"), "name"), ("footer_0_0", 5, F.col("doc_id"), "key"), ("paragraph_2", 3, F.col(S), "segment")]
    items = F.array(*(F.struct(F.lit(b).alias("block_id"), F.lit(a).alias("start"), (F.lit(a) + F.length(v)).alias("end"), text(k, v).alias("text")) for b, a, v, k in places))
    return rows.select("doc_id", F.explode(items).alias("s")).select("doc_id", "s.*")


def q77(spark, d):
    return docx.blocks(_files(spark, d)).select("doc_id", "block_id", "type", "text", "applies_to", "row_idx", "cell_idx")


def q78(spark, d):
    return docx.metadata(_files(spark, d))


def q79(spark, d):
    """Documents with spans and a property replaced: their blocks and properties, and how many spans were put in."""
    titles = _customers(spark, d).select("doc_id", F.lit("core").alias("section"), F.lit("title").alias("property"), F.concat(F.lit("T"), "doc_id").alias("value"))
    out = docx.rewritten(_files(spark, d), _spans(spark, d, lambda kind, value: F.lit(f"<{kind}>")), titles, highlight=True)
    place = lambda name, text: F.struct(name.alias("place"), text.alias("text"))
    blocks = F.transform("blocks", lambda b: place(b["block_id"], b["text"]))
    values = F.transform("properties", lambda p: place(F.concat_ws(":", p["section"], p["property"]), p["value"]))
    read = docx.opened(out).select("doc_id", F.explode(F.concat(blocks, values, F.array(place(F.lit("replaced"), F.col("replaced").cast("string"))))).alias("r"))
    return read.select("doc_id", "r.*")


def q80(spark, d):
    """Documents whose addresses and names are uuids, restored by the table of these."""
    named = lambda kind, value: tx.hash_uuid(F.lit(kind), value)
    spans = _spans(spark, d, named)
    values = _customers(spark, d).select(F.explode(F.array(*(F.struct(named(k, v).alias("uuid"), v.alias("original_value")) for k, v in (("mail", F.concat(F.lit("u"), F.col("doc_id"), F.lit("@example.com"))), ("name", F.col("c_name")), ("segment", F.col(S)), ("key", F.col("doc_id")))))).alias("v")).select("v.*").distinct()
    back = docx.restored(docx.rewritten(_files(spark, d), spans).select("doc_id", "content"), values)
    return docx.blocks(back).select("doc_id", "block_id", "text")


def q81(spark, d):
    """Payloads, decoded and read as documents."""
    sent = docx.encoded(_files(spark, d))
    return docx.blocks(sent.select("doc_id", F.unbase64("payload").alias("content"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"))


def _replacements(spark, d) -> DataFrame:
    rows = _customers(spark, d).select((F.col("doc_id").cast("long") % 7).alias("doc_id"), F.col("c_name").alias("original_value"), _uuid().alias("uuid"), F.lit("paragraph_0").alias("block_id"), F.col("doc_id").cast("int").alias("number"))
    return rows


def q82(spark, d):
    """The cells of the workbooks of replacement tables."""
    books = tables.replacement_workbooks(_replacements(spark, d))
    return xlsx.cells(books).select("doc_id", "row", F.array_join(F.transform("cells", lambda c: F.coalesce(c, F.lit(""))), "|").alias("cells"))


def q83(spark, d):
    """Replacement tables read from their workbooks by the names of their columns."""
    return tables.replacement_table(xlsx.table_of(xlsx.cells(tables.replacement_workbooks(_replacements(spark, d)))))


_C = f"c AS (SELECT CAST(c_custkey AS VARCHAR) AS doc_id, c_name AS n, {S} AS s FROM customer)"
_BLOCKS = """SELECT doc_id, 'header_0_0' AS block_id, 'header' AS type, 'Head ' || n AS text, 'section_0' AS applies_to, CAST(NULL AS INTEGER) AS row_idx, CAST(NULL AS INTEGER) AS cell_idx FROM c
UNION ALL SELECT doc_id, 'paragraph_0', 'paragraph', 'Segment ' || s, NULL, NULL, NULL FROM c UNION ALL SELECT doc_id, 'paragraph_1', 'paragraph', 'Mail u' || doc_id || '@example.com now', NULL, NULL, NULL FROM c
UNION ALL SELECT doc_id, 'paragraph_2', 'paragraph', 'to ' || s || ' now', NULL, NULL, NULL FROM c UNION ALL SELECT doc_id, 'table_0_cell_0_0', 'table_cell', n, NULL, 0, 0 FROM c UNION ALL SELECT doc_id, 'table_0_cell_0_1', 'table_cell', 'key ' || doc_id, NULL, 0, 1 FROM c
UNION ALL SELECT doc_id, 'sdt_0', 'sdt', 'Box ' || s, NULL, NULL, NULL FROM c UNION ALL SELECT doc_id, 'footer_0_0', 'footer', 'Foot ' || doc_id, 'section_0', NULL, NULL FROM c"""
_UUID = "regexp_replace(md5('mail' || chr(1) || CAST(c_custkey AS VARCHAR)), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5')"

QUERIES: dict[str, tuple[Query, str | None]] = {
    "q77_docx_blocks": (q77, f"WITH {_C} {_BLOCKS}"),
    "q78_docx_metadata": (q78, f"WITH {_C} SELECT doc_id, 'core' AS section, 'title' AS property, 'Report ' || n AS value FROM c UNION ALL SELECT doc_id, 'custom', 'Client', s FROM c"),
    "q79_docx_rewritten": (q79, f"""WITH {_C} SELECT doc_id, place, CASE place WHEN 'header_0_0' THEN 'Head <name>' WHEN 'paragraph_0' THEN 'Segment ' || s WHEN 'paragraph_1' THEN 'Mail <mail> now' WHEN 'paragraph_2' THEN 'to <segment> now' WHEN 'table_0_cell_0_0' THEN '<name>' WHEN 'table_0_cell_0_1' THEN 'key ' || doc_id
  WHEN 'sdt_0' THEN 'Box <segment>' WHEN 'footer_0_0' THEN 'Foot <key>' WHEN 'core:title' THEN 'T' || doc_id WHEN 'custom:Client' THEN s ELSE '6' END AS text
FROM c, (SELECT unnest(['header_0_0', 'paragraph_0', 'paragraph_1', 'paragraph_2', 'table_0_cell_0_0', 'table_0_cell_0_1', 'sdt_0', 'footer_0_0', 'core:title', 'custom:Client', 'replaced']) AS place)"""),
    "q80_docx_restored": (q80, f"WITH {_C}, b AS ({_BLOCKS}) SELECT doc_id, block_id, text FROM b"),
    "q81_payloads": (q81, "SELECT CAST(c_custkey AS VARCHAR) AS doc_id, CAST(8 AS BIGINT) AS blocks FROM customer"),
    "q82_workbooks": (q82, f"""WITH k AS (SELECT CAST(c_custkey % 7 AS BIGINT) AS doc_id, c_custkey, c_name, {_UUID} AS u FROM customer)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY c_custkey) AS INTEGER) AS row, concat_ws('|', CAST(c_custkey AS VARCHAR), c_name, u, 'paragraph_0') AS cells FROM k
UNION ALL SELECT DISTINCT CAST(doc_id AS VARCHAR), 0, '{"|".join(tables.WRITTEN.values())}' FROM k"""),
    "q83_replacements_of_workbooks": (q83, f"SELECT {_UUID} AS uuid, c_name AS original_value FROM customer"),
}
