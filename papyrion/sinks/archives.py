"""Office files written back with other texts: the archive is copied, texts are replaced by their ids."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from html import escape
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.sources.containers import UNREAD, Refused, Tree, decoded, local, opened, spine, text_of, xml


def _set(element: ElementTree.Element, text: str) -> None:
    """All text of an element into its first text run, the others empty."""
    runs = [e for e in element.iter() if local(e) == "t"]
    for k, run in enumerate(runs):
        run.text = text if k == 0 else ""
        run.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")


def _rewritten(content: bytes, texts: dict[str, str], parts: str, elements: str, naming) -> bytes:
    source, out = opened(content), io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
        for name in source.namelist():
            data = source.read(name)
            if re.fullmatch(parts, name):
                for event, pair in ElementTree.iterparse(io.BytesIO(data), events=["start-ns"]):
                    ElementTree.register_namespace(*pair)
                root = xml(data)
                for k, e in enumerate(x for x in root.iter() if local(x) == elements):
                    if (key := naming(name, k, e)) in texts:
                        _set(e, texts[key])
                data = ElementTree.tostring(root, xml_declaration=True, encoding="UTF-8")
            target.writestr(name, data)
    return out.getvalue()


def pptx(content: bytes, texts: dict[str, str]) -> bytes:
    """Paragraphs of slides and notes replaced by id."""
    return _rewritten(content, texts, r"ppt/(slides/slide|notesSlides/notesSlide)\d+\.xml", "p", lambda name, k, e: f"{posixpath.basename(name)[:-4]}#{k}")


def xlsx(content: bytes, texts: dict[str, str]) -> bytes:
    """Cells replaced by sheet and coordinate, as inline strings, so that what looks like a formula stays text."""
    source, out = opened(content), io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
        for name in source.namelist():
            data = source.read(name)
            if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", name):
                root = xml(data)
                space = root.tag.rpartition("}")[0] + "}"
                for cell in (e for e in root.iter() if local(e) == "c"):
                    if (key := f"{posixpath.basename(name)[:-4]}!{cell.get('r')}") in texts:
                        for child in list(cell):
                            cell.remove(child)
                        cell.set("t", "inlineStr")
                        ElementTree.SubElement(ElementTree.SubElement(cell, f"{space}is"), f"{space}t").text = texts[key]
                ElementTree.register_namespace("", space[1:-1])
                data = ElementTree.tostring(root, xml_declaration=True, encoding="UTF-8")
            target.writestr(name, data)
    return out.getvalue()


def _copied(content: bytes, changed: dict[str, bytes]) -> bytes:
    """The archive with some parts replaced; the others, their order and their compression stay."""
    source, out = opened(content), io.BytesIO()
    with zipfile.ZipFile(out, "w") as target:
        for part in source.infolist():
            target.writestr(part.filename, changed.get(part.filename, source.read(part)), compress_type=part.compress_type)
    return out.getvalue()


def _markup(data: bytes, root: ElementTree.Element) -> bytes:
    """A changed tree as XML, with the prefixes that its source has."""
    for _, pair in ElementTree.iterparse(io.BytesIO(data), events=["start-ns"]):
        if not re.fullmatch(r"ns\d+", pair[0]):
            ElementTree.register_namespace(*pair)
    return ElementTree.tostring(root, xml_declaration=True, encoding="UTF-8")


def docx(content: bytes, texts: dict[str, str]) -> bytes:
    """Paragraphs, table cells, headers, footers and notes replaced by the ids of :func:`docx_blocks`; runs keep the first one's style.

    A table's text is its rows by line and its cells by tab; one of another shape is refused, as its cells can't be told.
    """
    archive, changed, count = opened(content), {}, 0
    data = archive.read("word/document.xml")
    root = xml(data)
    body = next(e for e in root if local(e) == "body")
    for element in body:
        if local(element) == "p" and text_of(element).strip():
            if f"p{count}" in texts:
                _set(element, texts[f"p{count}"])
            count += 1
        elif local(element) == "tbl":
            if f"t{count}" in texts:
                rows = [[c for c in r if local(c) == "tc"] for r in element if local(r) == "tr"]
                grid = [line.split("\t") for line in texts[f"t{count}"].split("\n")]
                if [len(r) for r in rows] != [len(g) for g in grid]:
                    raise Refused("the table's new text has another shape")
                for cells, new in zip(rows, grid, strict=True):
                    for cell, text in zip(cells, new, strict=True):
                        _set(cell, text)
            count += 1
    changed["word/document.xml"] = _markup(data, root)
    for name in archive.namelist():
        if re.fullmatch(r"word/(header|footer|footnotes|endnotes|comments)\d*\.xml", name):
            data = archive.read(name)
            root = xml(data)
            for k, p in enumerate(e for e in root.iter() if local(e) == "p"):
                if (key := f"{posixpath.basename(name)}#{k}") in texts:
                    _set(p, texts[key])
            changed[name] = _markup(data, root)
    return _copied(content, changed)


def odt(content: bytes, texts: dict[str, str]) -> bytes:
    """Headings, paragraphs and list items replaced in walk order by the ids of :func:`odt_blocks`, table cells as in :func:`docx`."""
    data = opened(content).read("content.xml")
    root, count = xml(data), 0

    def put(element: ElementTree.Element, text: str) -> None:
        for child in list(element):
            element.remove(child)
        element.text = text

    stack = [root]
    while stack:
        element = stack.pop()
        name = local(element)
        if name == "table":
            if f"o{count}" in texts:
                rows = [[c for c in r.iter() if local(c) == "table-cell"] for r in element.iter() if local(r) == "table-row"]
                grid = [line.split("\t") for line in texts[f"o{count}"].split("\n")]
                if [len(r) for r in rows] != [len(g) for g in grid]:
                    raise Refused("the table's new text has another shape")
                for cells, new in zip(rows, grid, strict=True):
                    for cell, text in zip(cells, new, strict=True):
                        own = [e for e in cell.iter() if local(e) == "p"]
                        for k, p in enumerate(own):
                            put(p, text if k == 0 else "")
            count += 1
        elif name in ("h", "p"):
            if "".join(element.itertext()).strip():
                if f"o{count}" in texts:
                    put(element, texts[f"o{count}"])
                count += 1
        else:
            stack += reversed(element)
    return _copied(content, {"content.xml": _markup(data, root)})


class _Rewriter(Tree):
    """Markup written again as it's read, but for texts that have been replaced."""

    def __init__(self, texts: dict[str, str], item: str, direction: str | None) -> None:
        super().__init__()
        self.texts, self.item, self.direction = texts, item, direction
        self.out: list[str] = []
        self.count = 0

    def handle_starttag(self, tag, attrs):
        super().handle_starttag(tag, attrs)
        raw = self.get_starttag_text()
        if tag == "html" and self.direction:
            raw = re.sub(r"\s+dir\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", raw)
            raw = f'{raw[:5]} dir="{self.direction}"{raw[5:]}'
        self.out.append(raw)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        super().handle_endtag(tag)

    def handle_endtag(self, tag):
        super().handle_endtag(tag)
        self.out.append(f"</{tag}>")

    def handle_data(self, data):
        if any(n["name"] in UNREAD for n in self.stack):
            self.out.append(data if self.stack[-1]["name"] in ("script", "style") else escape(data, quote=False))
            return
        key, self.count = f"{self.item}#{self.count}", self.count + 1
        if data.strip() and key in self.texts:
            lead, trail = data[: len(data) - len(data.lstrip())], data[len(data.rstrip()) :]
            data = lead + self.texts[key] + trail
        self.out.append(escape(data, quote=False))

    def handle_comment(self, data):
        self.out.append(f"<!--{data}-->")

    def handle_decl(self, decl):
        self.out.append(f"<!{decl}>")

    def handle_pi(self, data):
        self.out.append(f"<?{data}>")


def epub(content: bytes, texts: dict[str, str], direction: str | None = None) -> bytes:
    """Texts of the spine's items replaced by the ids of :func:`epub_blocks`; a direction (`rtl`) is set on their root."""
    archive, changed = opened(content), {}
    for item, path in spine(archive):
        rewriter = _Rewriter(texts, item, direction)
        rewriter.feed(decoded(archive.read(path)))
        rewriter.close()
        changed[path] = "".join(rewriter.out).encode()
    return _copied(content, changed)


_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_PARTS = {
    "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
    "_rels/.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
}


def _run(text: str, style: dict | None = None) -> str:
    """A run with its marks."""
    marks = "".join(f"<w:{tag}/>" for name, tag in (("bold", "b"), ("italic", "i"), ("strike", "strike"), ("caps", "caps"), ("rtl", "rtl")) if (style or {}).get(name))
    marks += '<w:u w:val="single"/>' if (style or {}).get("underline") else ""
    marks += f'<w:vertAlign w:val="{"superscript" if style.get("sup") else "subscript"}"/>' if style and (style.get("sup") or style.get("sub")) else ""
    return f'<w:r>{f"<w:rPr>{marks}</w:rPr>" if marks else ""}<w:t xml:space="preserve">{escape(text, quote=False)}</w:t></w:r>'


def _paragraph(block: dict) -> str:
    """A paragraph by its type and level; list levels beyond the third are the third's."""
    level = block.get("level") or 0
    named = {"title": "Title", "heading": f"Heading{min(max(level, 1), 9)}", "list_item": "ListBullet" + ("" if level <= 0 else str(min(level, 2) + 1)), "caption": "Caption"}.get(block.get("type", ""))
    marks = (f'<w:pStyle w:val="{named}"/>' if named else "") + ("<w:bidi/>" if block.get("rtl") else "") + (f'<w:jc w:val="{block["align"]}"/>' if block.get("align") else "")
    runs = block.get("runs") or [(block.get("text") or "", {"rtl": block.get("rtl")})]
    return f'<w:p>{f"<w:pPr>{marks}</w:pPr>" if marks else ""}{"".join(_run(t, s) for t, s in runs)}</w:p>'


def _table(rows: list[list]) -> str:
    """A table of cells (text) or (text, colspan, rowspan); a cell that a merged one above covers is a continuation."""
    open_above: dict[int, tuple[int, int]] = {}  # column: rows to go, width
    out = []
    for row in rows:
        cells, column, queue = [], 0, list(row)
        while queue or column in open_above:
            if column in open_above:
                left, width = open_above.pop(column)
                cells.append(f'<w:tc><w:tcPr>{f"""<w:gridSpan w:val="{width}"/>""" if width > 1 else ""}<w:vMerge/></w:tcPr><w:p/></w:tc>')
                if left > 1:
                    open_above[-column - 1] = (left - 1, width)  # kept for the next row
                column += width
                continue
            cell = queue.pop(0)
            text, width, height = cell if isinstance(cell, tuple) else (cell, 1, 1)
            marks = (f'<w:gridSpan w:val="{width}"/>' if width > 1 else "") + ('<w:vMerge w:val="restart"/>' if height > 1 else "")
            cells.append(f'<w:tc>{f"<w:tcPr>{marks}</w:tcPr>" if marks else ""}<w:p>{_run(text)}</w:p></w:tc>')
            if height > 1:
                open_above[-column - 1] = (height - 1, width)
            column += width
        open_above = {-k - 1 if k < 0 else k: v for k, v in open_above.items()}
        out.append(f"<w:tr>{''.join(cells)}</w:tr>")
    return f"<w:tbl>{''.join(out)}</w:tbl>"


def docx_built(blocks: list[dict]) -> bytes:
    """A new document of blocks in order: dicts with type, text, and where there is one level, align, rtl, runs [(text, style)], rows of a table."""
    body = "".join(_table(b["rows"]) if b.get("rows") else _paragraph(b) for b in blocks)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
        for name, text in _PARTS.items():
            target.writestr(name, text)
        target.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_W}"><w:body>{body}<w:sectPr/></w:body></w:document>')
    return out.getvalue()


WRITERS = {"pptx": pptx, "xlsx": xlsx, "docx": docx, "odt": odt, "epub": epub}


def written_back(files: DataFrame, segments: DataFrame, kind: str) -> DataFrame:
    """(path, content) of files (path, content) with the texts of segments (path, id, text). A file's texts meet in one row, as the file does."""
    texts = segments.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("id", "text"))).alias("texts"))
    writer = WRITERS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_pydict({"path": pa.array([path]), "content": pa.array([writer(content, dict(own or []))], pa.binary())})

    return files.join(texts, "path", "left").select("path", "content", "texts").mapInArrow(run, "path string, content binary")
