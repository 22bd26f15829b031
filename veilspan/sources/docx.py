"""Word documents: blocks, metadata, rewriting and restoring, from the bytes of a package, with the standard library only.

Files are read as bytes by Spark and parsed one at a time in Python workers; blocks are ordinary rows from then on. Replacements
are put in by position: a block's normalized text is mapped to the text nodes of its paragraphs, so a span may cross runs.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import accumulate, chain
from xml.etree import ElementTree as ET
from xml.parsers import expat

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Namespaces of the format, and the properties that are read.
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
CORE = {
    "title": "http://purl.org/dc/elements/1.1/", "subject": "http://purl.org/dc/elements/1.1/", "creator": "http://purl.org/dc/elements/1.1/", "description": "http://purl.org/dc/elements/1.1/",
    "keywords": "http://schemas.openxmlformats.org/package/2006/metadata/core-properties", "lastModifiedBy": "http://schemas.openxmlformats.org/package/2006/metadata/core-properties",
    "category": "http://schemas.openxmlformats.org/package/2006/metadata/core-properties", "created": "http://purl.org/dc/terms/", "modified": "http://purl.org/dc/terms/",
}
APP = ("Application", "Company", "Manager", "Template", "HyperlinkBase")
APP_NS = "http://schemas.openxmlformats.org/officeDocument/2006/extended-properties"
CUSTOM_NS = "http://schemas.openxmlformats.org/officeDocument/2006/custom-properties"
#: Files whose results a worker holds at once.
PIECE = 200
_BLOCK = "block_id string, block_seq int, type string, text string, applies_to string, row_idx int, cell_idx int"
_PROPERTY = "section string, property string, value string"
BLOCK_SCHEMA = f"doc_id string, {_BLOCK}"


def _w(name: str) -> str:
    return f"{{{W}}}{name}"


_P, _R, _TBL, _SDT = _w("p"), _w("r"), _w("tbl"), _w("sdt")
_TEXTS = (_w("t"), f"{{{A}}}t")
# Records of a zip file: a part's own head, its entry in the list, the end of the list.
_HEAD, _ENTRY, _END = struct.Struct("<4s5H3L2H"), struct.Struct("<4s6H3L5H2L"), struct.Struct("<4s4H2LH")
#: The prefixes that parts were last read with (prefix to namespace), as ElementTree knows them too.
_PREFIXES: dict[str, str] = {}


def unpacked(content: bytes) -> dict[str, bytes]:
    """Names and bytes of a package's parts. The plain layout is read here, as opening each part costs more than its content; any other by zipfile."""
    try:
        end, disk, first, here, n, size, at, comment = _END.unpack_from(content, max(len(content) - _END.size, 0))
        if end == b"PK\5\6" and not (disk or first or comment) and here == n and at + size + _END.size == len(content):
            out: dict[str, bytes] | None = {}
            for _ in range(n):
                mark, _, _, flags, method, _, _, crc, small, plain, name_n, extra_n, comment_n, _, _, _, head = _ENTRY.unpack_from(content, at)
                name = content[at + _ENTRY.size : at + _ENTRY.size + name_n]
                at += _ENTRY.size + name_n + extra_n + comment_n
                local = _HEAD.unpack_from(content, head)
                body = head + _HEAD.size + local[9] + local[10]
                if mark != b"PK\1\2" or local[0] != b"PK\3\4" or flags & ~0x80E or method not in (0, 8) or not name.isascii() or b"\0" in name or content[head + _HEAD.size : head + _HEAD.size + local[9]] != name:
                    break
                data = content[body : body + small]
                data = zlib.decompress(data, -15) if method else data
                if len(data) != plain or zlib.crc32(data) != crc:
                    break
                out[name.decode()] = data
            else:
                return out
    except (struct.error, zlib.error):
        pass
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return {i.filename: z.read(i) for i in z.infolist()}


def packed(parts: dict[str, bytes], method: int = zipfile.ZIP_DEFLATED) -> bytes:
    """A package of parts, deflated or stored; equal parts give equal bytes, as no time is written."""
    out, entries, at = [], [], 0
    for name, data in parts.items():
        raw, crc = name.encode(), zlib.crc32(data)
        if method == zipfile.ZIP_DEFLATED:
            press = zlib.compressobj(zlib.Z_DEFAULT_COMPRESSION, zlib.DEFLATED, -15)
            body = press.compress(data) + press.flush()
        else:
            body = data
        common = (20, 0 if raw.isascii() else 0x800, method, 0, 33, crc, len(body), len(data), len(raw), 0)
        out += _HEAD.pack(b"PK\3\4", *common), raw, body
        entries += _ENTRY.pack(b"PK\1\2", 20, *common, 0, 0, 0, 0, at), raw
        at += _HEAD.size + len(raw) + len(body)
    listed = b"".join(entries)
    return b"".join([*out, listed, _END.pack(b"PK\5\6", 0, 0, len(parts), len(parts), len(listed), at, 0)])


@dataclass
class Block:
    block_id: str
    type: str
    #: Text nodes in order, None where paragraphs of one block meet.
    nodes: list
    part: str
    applies_to: str | None = None
    row: int | None = None
    cell: int | None = None
    raw: str = field(init=False)

    def __post_init__(self) -> None:
        self.raw = "".join("\n" if n is None else n.text or "" for n in self.nodes)

    def text(self) -> str:
        """The normalized text alone."""
        return " ".join(self.raw.split())

    def normalized(self) -> tuple[str, Sequence[int]]:
        """The normalized text, and each of its characters' place in the raw text."""
        plain = self.text()
        if plain == self.raw:
            return plain, range(len(plain))
        out, places, gap = [], [], None
        for i, c in enumerate(self.raw):
            if c.isspace():
                gap = i if gap is None else gap
                continue
            if gap is not None and out:
                out.append(" ")
                places.append(gap)
            gap = None
            out.append(c)
            places.append(i)
        return "".join(out), places


class Package:
    """A document package and its blocks: headers of all sections, the body in its order, footers."""

    def __init__(self, content: bytes):
        self.files = unpacked(content)
        self.trees: dict[str, ET.Element] = {}
        self.changed: set[str] = set()
        self.main = "word/document.xml"

    def tree(self, name: str) -> ET.Element:
        if name not in self.trees:
            self.trees[name] = ET.fromstring(self.files[name])
        return self.trees[name]

    def _parts(self, kind: str) -> Iterator[tuple[int, str]]:
        """Section and part of each header or footer that a section defines."""
        rels = "word/_rels/document.xml.rels"
        targets = {r.get("Id"): r.get("Target") for r in self.tree(rels)} if self.files.get(rels) else {}
        for s, section in enumerate(self.tree(self.main).iter(_w("sectPr"))):
            for ref in section.findall(_w(f"{kind}Reference")):
                target = targets.get(ref.get(f"{{{R}}}id"))
                name = target.lstrip("/") if target and target.startswith("/") else f"word/{target}"
                if ref.get(_w("type"), "default") == "default" and target and name in self.files:
                    yield s, name

    def blocks(self) -> list[Block]:
        out = [b for s, part in self._parts("header") for b in self._margin("header", s, part)]
        body = self.tree(self.main).find(_w("body"))
        paragraphs = tables = boxes = 0
        for child in body if body is not None else ():
            if child.tag == _P:
                b = Block(f"paragraph_{paragraphs}", "paragraph", list(_texts(child)), self.main)
                paragraphs += 1
                if b.text():
                    out.append(b)
            elif child.tag == _TBL:
                out += _cells(child, tables, self.main)
                tables += 1
            elif child.tag == _SDT:
                b = Block(f"sdt_{boxes}", "sdt", _joined(child), self.main)
                if b.text():
                    out.append(b)
                    boxes += 1
        return out + [b for s, part in self._parts("footer") for b in self._margin("footer", s, part)]

    def _margin(self, kind: str, s: int, part: str) -> Iterator[Block]:
        n = {"p": 0, "tbl": 0, "sdt": 0}
        for child in self.tree(part):
            name = child.tag.rpartition("}")[2]
            if name not in n:
                continue
            infix = {"p": "", "tbl": "table_", "sdt": "sdt_"}[name]
            b = Block(f"{kind}_{infix}{s}_{n[name]}", kind, list(_texts(child)) if name == "p" else _joined(child), part, f"section_{s}")
            n[name] += 1
            if b.text():
                yield b

    def replace(self, spans: Iterable[tuple[str, int, int, str]], highlight: bool = False) -> int:
        """Puts texts in place of spans (block, start, end, text) of normalized block texts; the number put in.

        Spans of a block must not overlap; those of unknown blocks or outside a text are left out.
        """
        known, done, runs = {b.block_id: b for b in self.blocks()}, 0, {}
        for block_id, start, end, text in sorted(spans, key=lambda s: (s[0], -s[1])):
            block = known.get(block_id)
            if block is None:
                continue
            plain, places = block.normalized()
            if not 0 <= start < end <= len(plain):
                continue
            _splice(block.nodes, places[start], places[end - 1] + 1, text)
            block.__post_init__()
            self.changed.add(block.part)
            if highlight:
                if block.part not in runs:
                    runs[block.part] = {id(n): run for run in self.tree(block.part).iter(_R) for n in run}
                _highlight(runs[block.part], block.nodes, text)
            done += 1
        return done

    def metadata(self) -> list[tuple[str, str, str]]:
        """section, property, value of the properties that have one."""
        return [(s, p, e.text or "") for s, p, e in self._properties() if (e.text or "").strip()]

    def _properties(self) -> Iterator[tuple[str, str, ET.Element]]:
        if "docProps/core.xml" in self.files:
            for name, ns in CORE.items():
                e = self.tree("docProps/core.xml").find(f"{{{ns}}}{name}")
                if e is not None:
                    yield "core", name, e
        if "docProps/app.xml" in self.files:
            for name in APP:
                e = self.tree("docProps/app.xml").find(f"{{{APP_NS}}}{name}")
                if e is not None:
                    yield "app", name, e
        if "docProps/custom.xml" in self.files:
            for p in self.tree("docProps/custom.xml").iter(f"{{{CUSTOM_NS}}}property"):
                for value in p:
                    yield "custom", p.get("name") or "", value

    def set_metadata(self, values: dict[tuple[str, str], str]) -> None:
        for section, name, element in list(self._properties()) if values else ():
            if (section, name) in values:
                element.text = values[section, name]
                self.changed.add(f"docProps/{section}.xml")

    def _written(self, name: str) -> bytes:
        """A part as it is now, with the prefixes that it was read with."""
        parser = expat.ParserCreate(namespace_separator="}")
        parser.StartNamespaceDeclHandler = _keep_prefix
        parser.Parse(self.files[name], True)
        return b"<?xml version='1.0' encoding='UTF-8'?>\n" + ET.tostring(self.trees[name], encoding="unicode").encode("utf-8", "xmlcharrefreplace")

    def content(self) -> bytes:
        """The package; parts in which nothing was changed stay as they are."""
        return packed({name: self._written(name) if name in self.changed else data for name, data in self.files.items()})


def _keep_prefix(prefix: str | None, uri: str | None) -> None:
    prefix, uri = prefix or "", uri or ""
    if _PREFIXES.get(prefix) != uri and not re.fullmatch(r"ns\d+", prefix):
        ET.register_namespace(prefix, uri)
        for other in [p for p, u in _PREFIXES.items() if u == uri]:
            del _PREFIXES[other]
        _PREFIXES[prefix] = uri


def _texts(element: ET.Element) -> Iterator[ET.Element]:
    return (e for e in element.iter() if e.tag in _TEXTS)


def _joined(element: ET.Element) -> list:
    """The text nodes of all paragraphs below, parted by None; each node once."""
    out: list = []
    for p in element.iter(_P):
        nodes = list(_texts(p))
        if nodes:
            out += [None, *nodes] if out else nodes
    return out or list(_texts(element))


def _cells(table: ET.Element, t: int, part: str) -> Iterator[Block]:
    """A block for each cell; a cell merged over columns counts for its columns but is one block. Empty cells stay."""
    for r, row in enumerate(table.findall(_w("tr"))):
        c = 0
        for cell in row.findall(_w("tc")):
            span = cell.find(f"{_w('tcPr')}/{_w('gridSpan')}")
            yield Block(f"table_{t}_cell_{r}_{c}", "table_cell", _joined(cell), part, row=r, cell=c)
            c += int(span.get(_w("val"), "1")) if span is not None else 1


def _splice(nodes: list, start: int, end: int, text: str) -> None:
    """Puts text in place of raw characters start to end: in the first node they touch; the rest is cut from the others."""
    at, first = 0, True
    for n in nodes:
        size = 1 if n is None else len(n.text or "")
        a, b = max(start - at, 0), min(end - at, size)
        if n is not None and a < b:
            old = n.text or ""
            n.text = old[:a] + (text if first else "") + old[b:]
            n.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
            first = False
        at += size


def _highlight(runs: dict[int, ET.Element], nodes: list, text: str) -> None:
    """Marks the runs (by the nodes they hold) that hold the text in yellow."""
    for n in nodes:
        run = runs.get(id(n)) if n is not None and text in (n.text or "") else None
        if run is None:
            continue
        props = run.find(_w("rPr"))
        if props is None:
            props = ET.Element(_w("rPr"))
            run.insert(0, props)
        if props.find(_w("highlight")) is None:
            ET.SubElement(props, _w("highlight"), {_w("val"): "yellow"})


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path), content of the files below a path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select(F.col("path").alias("doc_id"), "content")


def pieces(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """A batch in pieces of PIECE files, so that what is made of them leaves the worker before the batch ends."""
    return (frame.iloc[i : i + PIECE] for i in range(0, len(frame), PIECE))


def _batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same of Arrow batches."""
    return (b.slice(i, PIECE) for b in batches for i in range(0, b.num_rows, PIECE))


def _fields(schema: str) -> pa.StructType:
    return pa.struct([(n, {"string": pa.string(), "int": pa.int32()}[t]) for n, t in (f.split() for f in schema.split(", "))])


def _listed(rows: list[list[tuple] | None], kind: pa.StructType) -> pa.Array:
    """A list of structs for each list of rows."""
    full = [r or [] for r in rows]
    columns = list(zip(*chain.from_iterable(full), strict=True)) or [()] * kind.num_fields
    flat = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind))
    return pa.ListArray.from_arrays(pa.array(accumulate(map(len, full), initial=0), pa.int32()), flat, mask=pa.array([r is None for r in rows]))


def _lists(column: pa.Array, names: tuple[str, ...]) -> Iterator[list[tuple]]:
    """The rows (their fields of these names) of each list of structs; none for null."""
    flat = column.flatten()
    rows = zip(*(flat.field(n).to_pylist() for n in names), strict=True)
    return ([next(rows) for _ in range(n or 0)] for n in column.value_lengths().to_pylist())


def opened(files: DataFrame) -> DataFrame:
    """files (doc_id, content, perhaps more) with the blocks and properties of each in place of its content, read once; null where it is no document."""
    kinds, kept = {"blocks": _fields(_BLOCK), "properties": _fields(_PROPERTY)}, [c for c in files.columns if c != "content"]

    def read(content: bytes) -> tuple[list | None, list | None]:
        try:
            package = Package(content)
            found = [(b.block_id, i, b.type, b.text(), b.applies_to, b.row, b.cell) for i, b in enumerate(package.blocks())]
        except (zipfile.BadZipFile, KeyError, ET.ParseError):
            return None, None
        return found, package.metadata()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches):
            found = [read(c) for c in b.column("content").to_pylist()]
            lists = [_listed([f[k] for f in found], kind) for k, kind in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *lists], names=[*kept, *kinds])

    carried = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in files.schema if f.name != "content")
    return files.mapInArrow(rows, f"{carried}blocks array<struct<{_BLOCK}>>, properties array<struct<{_PROPERTY}>>")


def blocks(files: DataFrame) -> DataFrame:
    """The blocks of each file (doc_id, content); a file that is no document has none."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches):
            out = []
            for doc_id, content in zip(b.column("doc_id").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    found = Package(content).blocks()
                except (zipfile.BadZipFile, KeyError, ET.ParseError):
                    continue
                out += [(doc_id, b.block_id, i, b.type, b.text(), b.applies_to, b.row, b.cell) for i, b in enumerate(found)]
            yield pa.RecordBatch.from_struct_array(_listed([out], _fields(BLOCK_SCHEMA)).flatten())

    return files.select("doc_id", "content").mapInArrow(rows, BLOCK_SCHEMA)


def metadata(files: DataFrame) -> DataFrame:
    """doc_id, section, property, value."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches):
            contents = zip(b.column("doc_id").to_pylist(), b.column("content").to_pylist(), strict=True)
            out = [(d, *m) for d, c in contents if zipfile.is_zipfile(io.BytesIO(c)) for m in Package(c).metadata()]
            yield pa.RecordBatch.from_struct_array(_listed([out], _fields(f"doc_id string, {_PROPERTY}")).flatten())

    return files.select("doc_id", "content").mapInArrow(rows, f"doc_id string, {_PROPERTY}")


def rewritten(files: DataFrame, spans: DataFrame, properties: DataFrame | None = None, highlight: bool = False) -> DataFrame:
    """doc_id, content, replaced: files with spans (doc_id, block_id, start, end, text) and properties (doc_id, section, property, value) put in."""
    per = spans.groupBy("doc_id").agg(F.collect_list(F.struct("block_id", "start", "end", "text")).alias("spans"))
    rows = files.select("doc_id", "content").join(per, "doc_id", "left")
    if properties is not None:
        rows = rows.join(properties.groupBy("doc_id").agg(F.collect_list(F.struct("section", "property", "value")).alias("properties")), "doc_id", "left")
    else:
        rows = rows.withColumn("properties", F.lit(None).cast("array<struct<section:string,property:string,value:string>>"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches):
            out, done = [], []
            for content, mine, values in zip(b.column("content").to_pylist(), _lists(b.column("spans"), ("block_id", "start", "end", "text")), _lists(b.column("properties"), ("section", "property", "value")), strict=True):
                package = Package(content)
                done.append(package.replace(mine, highlight))
                package.set_metadata({(section, name): value for section, name, value in values})
                out.append(package.content())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.binary()), pa.array(done, pa.int32())], names=["doc_id", "content", "replaced"])

    return rows.mapInArrow(write, "doc_id string, content binary, replaced int")


def restored(files: DataFrame, table: DataFrame) -> DataFrame:
    """doc_id, content, replaced: files with each uuid of the table (uuid, original_value) put back, in every kind of block.

    Files are dealt by doc_id first: searching them and writing them read the same shuffle, so they are made once.
    """
    from ..operators.rewrite import restored as restore_blocks

    files = files.select("doc_id", "content").repartition("doc_id")
    _, found = restore_blocks(blocks(files).select("doc_id", "block_id", "text"), table)
    return rewritten(files, found.where("success").select("doc_id", "block_id", "start", "end", F.col("original_value").alias("text")))


def encoded(files: DataFrame) -> DataFrame:
    """doc_id, payload: the content in base64."""
    return files.select("doc_id", F.base64("content").alias("payload"))
