"""Files as rows: kinds by content, archives opened in Arrow batches, markup parsed into blocks.

Files come from ``spark.read.format("binaryFile")``, so listing, pruning and reading stay Spark's. A worker holds one file
at a time. Archives are refused by the size their directory states before anything is unpacked, and XML with a DTD or
entities isn't parsed.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_FILE_MB, MAX_UNPACKED_MB, CHECK_RATIO_MB, MAX_RATIO = 300, 1000, 50, 200
#: Kinds by leading bytes, and by extension where content alone doesn't tell.
MAGIC = {"25504446": "pdf", "89504E47": "image", "FFD8FF": "image", "47494638": "image", "49492A00": "image", "4D4D002A": "image", "504B0304": "zip", "D0CF11E0": "legacy", "7B5C727466": "rtf"}
EXTENSIONS = {"docx": "docx", "xlsx": "xlsx", "pptx": "pptx", "odt": "odt", "epub": "epub", "srt": "subtitle", "vtt": "subtitle", "html": "html", "htm": "html", "md": "text", "txt": "text"}


def files(spark: SparkSession, folder: str, *globs: str) -> DataFrame:
    """Files of a folder tree by name patterns, without hidden folders and side files. Files over the size limit come without their content, which isn't read, so that readers report them."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if globs:
        reader = reader.option("pathGlobFilter", globs[0] if len(globs) == 1 else "{" + ",".join(globs) + "}")
    found, small = reader.load(folder), F.col("length") <= MAX_FILE_MB * 2**20
    large = found.where(~small).select("path", "modificationTime", "length", F.lit(None).cast("binary").alias("content"))
    rows = found.where(small).unionByName(large)
    return rows.where(~sidecar(F.col("path")) & ~F.col("path").rlike(r"/(?:\.[^/]+|__pycache__|node_modules)/"))


def sidecar(path: Column) -> Column:
    """Files that belong to another: references, golds, orders, layouts and reviews."""
    return path.rlike(r"\.(?:gold\.txt|ref\.[A-Za-z-]+\.txt|order\.json|layout\.json|types\.json|tables\.html|review\.tsv)$")


def kind(path: Column, content: Column) -> Column:
    """Kind of a file: some by extension at once, then by leading bytes, archives and plain text by extension after."""
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    named = F.create_map(*(F.lit(v) for pair in EXTENSIONS.items() for v in pair))[extension]
    head = F.hex(F.substring(content, 1, 8))
    by_content = F.coalesce(*(F.when(head.startswith(m), k) for m, k in MAGIC.items()))
    text = F.when(F.lower(F.decode(F.substring(content, 1, 256), "ISO-8859-1")).rlike(r"^\s*<(?:!doctype html|html)"), "html").when(F.is_valid_utf8(content.cast("string")), "text")
    first = F.when(extension.isin("srt", "vtt", "epub"), named)
    return F.coalesce(first, F.when(by_content == "zip", F.coalesce(named, F.lit("zip"))).otherwise(by_content), text, F.lit("unknown"))


def decoded(content: bytes) -> str:
    """UTF-8, else UTF-16, else Latin-1."""
    for name in ("utf-8", "utf-16"):
        try:
            return content.decode(name)
        except UnicodeDecodeError:
            continue
    return content.decode("latin-1")


class Refused(ValueError):
    """A file that isn't opened for its size or markup."""


def opened(content: bytes) -> zipfile.ZipFile:
    """An archive, if its directory promises no more than the limits."""
    archive = zipfile.ZipFile(io.BytesIO(content))
    size = sum(i.file_size for i in archive.infolist())
    if size > MAX_UNPACKED_MB * 2**20 or size > CHECK_RATIO_MB * 2**20 and size > MAX_RATIO * max(1, len(content)):
        raise Refused("the archive unpacks to too much")
    return archive


class _Begun(Exception):
    """The root element has come, after which no document type can."""


def xml(content: bytes) -> ElementTree.Element:
    """The tree of a text without a document type, which may only stand before the root, however far that is."""

    def refuse(*_) -> None:
        raise Refused("XML with a document type isn't read")

    def begun(*_) -> None:
        raise _Begun

    prolog = expat.ParserCreate()
    prolog.StartDoctypeDeclHandler = prolog.EntityDeclHandler = refuse
    prolog.StartElementHandler = begun
    try:
        prolog.Parse(content, True)
    except _Begun:
        pass
    except expat.ExpatError as e:
        raise ElementTree.ParseError(str(e)) from e
    return ElementTree.fromstring(content)


def local(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


Block = tuple[str, str, str]  # id, type, text


class Tree(HTMLParser):
    """A tree in which an end tag closes the nearest open element of its name, as in forgiving parsers."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root: dict = {"name": "", "children": [], "attributes": {}}
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        node = {"name": tag, "children": [], "attributes": dict(attrs)}
        self.stack[-1]["children"].append(node)
        if tag not in self.VOID:
            self.stack.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i]["name"] == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        self.stack[-1]["children"].append(data)


_DROPPED = frozenset("script style noscript template head".split())
_HTML_TYPES = {"h1": "title", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "li": "list_item", "p": "paragraph", "blockquote": "paragraph", "caption": "paragraph", "figcaption": "paragraph", "table": "table"}


def html_tree(markup: str) -> dict:
    parser = Tree()
    parser.feed(markup)
    parser.close()
    return parser.root


def flat(node, separator: str = " ") -> str:
    """Texts of a tree, each stripped, joined; without dropped elements. Iterative, as nesting may be deep."""
    out, stack = [], [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            if s := n.strip():
                out.append(s)
        elif n["name"] not in _DROPPED:
            stack += reversed(n["children"])
    return separator.join(out)


def rows_of(table: dict) -> list[list[str]]:
    """Texts of a table's own cells, row by row, not those of tables within."""
    rows, stack = [], [(c, None) for c in reversed(table["children"])]
    while stack:
        node, row = stack.pop()
        if isinstance(node, str) or node["name"] in _DROPPED:
            continue
        if node["name"] == "tr":
            row = []
            rows.append(row)
        elif node["name"] in ("td", "th") and row is not None:
            row.append(flat(node))
            continue
        elif node["name"] == "table":
            continue
        stack += [(c, row) for c in reversed(node["children"])]
    return [r for r in rows if r]


def html_blocks(content: bytes) -> list[Block]:
    """Titles, headings, list items, paragraphs and whole tables in order; the flat text where there is none of these."""
    tree, out = html_tree(decoded(content)), []
    stack: list = [tree]
    while stack:
        node = stack.pop()
        if isinstance(node, str) or node["name"] in _DROPPED:
            continue
        found = _HTML_TYPES.get(node["name"])
        if found == "table":
            rows = rows_of(node)
            if rows:
                out.append((f"b{len(out)}", "table", "\n".join("\t".join(r) for r in rows)))
            continue
        if found and (text := flat(node)):
            out.append((f"b{len(out)}", found, text))
        stack += reversed(node["children"])
    if not out and (text := flat(tree, "\n")):
        out.append(("b0", "paragraph", text))
    return out


def text_of(element: ElementTree.Element, names: tuple[str, ...] = ("t",)) -> str:
    return "".join("\t" if local(e) == "tab" else (e.text or "") for e in element.iter() if local(e) in (*names, "tab"))


def docx_blocks(content: bytes) -> list[Block]:
    """Paragraphs and tables in body order, then headers, footers and notes."""
    archive, out = opened(content), []
    body = next(e for e in xml(archive.read("word/document.xml")) if local(e) == "body")
    for element in body:
        if local(element) == "p" and (text := text_of(element)).strip():
            style = next((v for e in element.iter() if local(e) == "pStyle" for k, v in e.attrib.items() if k.endswith("val")), "")
            numbered = any(local(e) == "numPr" for e in element.iter())
            typed = "title" if style == "Title" else "heading" if re.match(r"(?i)heading", style) else "list_item" if numbered or style.startswith("List") else "paragraph"
            out.append((f"p{len(out)}", typed, text))
        elif local(element) == "tbl":
            grid = [[text_of(c) for c in r if local(c) == "tc"] for r in element if local(r) == "tr"]
            out.append((f"t{len(out)}", "table", "\n".join("\t".join(r) for r in grid)))
    for name in sorted(archive.namelist()):
        if m := re.fullmatch(r"word/(header|footer|footnotes|endnotes|comments)\d*\.xml", name):
            for k, p in enumerate(e for e in xml(archive.read(name)).iter() if local(e) == "p"):
                if (text := text_of(p)).strip():
                    out.append((f"{posixpath.basename(name)}#{k}", m[1].rstrip("s"), text))
    return out


def xlsx_blocks(content: bytes) -> list[Block]:
    """A block for each cell that holds text, by sheet and coordinate."""
    archive, out = opened(content), []
    names = archive.namelist()
    strings = [text_of(e) for e in xml(archive.read("xl/sharedStrings.xml")) if local(e) == "si"] if "xl/sharedStrings.xml" in names else []
    for name in sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n))):
        for cell in (e for e in xml(archive.read(name)).iter() if local(e) == "c"):
            value = next((e.text or "" for e in cell if local(e) == "v"), "")
            text = strings[int(value)] if cell.get("t") == "s" and value else text_of(cell) if cell.get("t") == "inlineStr" else value if cell.get("t") == "str" else ""
            if text.strip() and not text.startswith("=") and not any(local(e) == "f" for e in cell):
                out.append((f"{posixpath.basename(name)[:-4]}!{cell.get('r')}", "cell", text))
    return out


def pptx_blocks(content: bytes) -> list[Block]:
    """Paragraphs of slides and notes, in slide order, groups and tables included."""
    archive, out = opened(content), []
    number = lambda n: (int(re.sub(r"\D", "", n)), n)
    for folder, typed in (("slides/slide", "paragraph"), ("notesSlides/notesSlide", "note")):
        for name in sorted((n for n in archive.namelist() if re.fullmatch(rf"ppt/{folder}\d+\.xml", n)), key=number):
            for k, p in enumerate(e for e in xml(archive.read(name)).iter() if local(e) == "p"):
                if (text := text_of(p)).strip():
                    out.append((f"{posixpath.basename(name)[:-4]}#{k}", typed, text))
    return out


def odt_blocks(content: bytes) -> list[Block]:
    """Headings, paragraphs and list items, and whole tables."""
    out: list[Block] = []
    stack: list[tuple[ElementTree.Element, str]] = [(xml(opened(content).read("content.xml")), "paragraph")]
    while stack:
        element, typed = stack.pop()
        name = local(element)
        if name == "table":
            grid = [["".join(c.itertext()) for c in r.iter() if local(c) == "table-cell"] for r in element.iter() if local(r) == "table-row"]
            out.append((f"o{len(out)}", "table", "\n".join("\t".join(r) for r in grid)))
        elif name in ("h", "p"):
            if (text := "".join(element.itertext())).strip():
                out.append((f"o{len(out)}", "heading" if name == "h" else typed, text))
        else:
            stack += [(e, "list_item" if name == "list-item" else typed) for e in reversed(element)]
    return out


#: Elements of a book's pages whose texts are no blocks.
UNREAD = _DROPPED | {"title"}


def spine(archive: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(id, path) of a book's items in reading order."""
    package = next(e.get("full-path") for e in xml(archive.read("META-INF/container.xml")).iter() if local(e) == "rootfile")
    root = xml(archive.read(package))
    items = {e.get("id"): e.get("href") for e in root.iter() if local(e) == "item"}
    return [(ref, posixpath.normpath(posixpath.join(posixpath.dirname(package), items[ref]))) for ref in (e.get("idref") for e in root.iter() if local(e) == "itemref")]


def epub_blocks(content: bytes) -> list[Block]:
    """Texts of the spine's items in order, by item and number."""
    archive = opened(content)
    out: list[Block] = []
    for ref, path in spine(archive):
        stack, k = [html_tree(decoded(archive.read(path)))], 0
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                if node.strip():
                    out.append((f"{ref}#{k}", "paragraph", node.strip()))
                k += 1
            elif node["name"] not in UNREAD:
                stack += reversed(node["children"])
    return out


READERS: dict[str, Callable[[bytes], list[Block]]] = {"html": html_blocks, "docx": docx_blocks, "xlsx": xlsx_blocks, "pptx": pptx_blocks, "odt": odt_blocks, "epub": epub_blocks}


def blocks(rows: DataFrame, reader: str | None = None) -> DataFrame:
    """(path, ord, id, type, text, error) of rows (path, content[, kind]). A file that can't be read gives one row with the error."""
    source = rows.select("path", "content", F.lit(reader).alias("kind") if reader else F.col("kind"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, named in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if content is None:
                    found, error = [], f"no content: larger than {MAX_FILE_MB} MB, or lost"
                elif named not in READERS:
                    found, error = [], f"no reader for {named}"
                else:
                    try:
                        found, error = READERS[named](content), None
                    except (Refused, zipfile.BadZipFile, ElementTree.ParseError, KeyError, StopIteration, ValueError) as e:
                        found, error = [], f"{type(e).__name__}: {e}"
                lines = found or ([(None, None, None)] if error else [])
                yield pa.RecordBatch.from_pydict({
                    "path": pa.array([path] * len(lines), pa.string()), "ord": pa.array(range(len(lines)), pa.int64()), **{n: pa.array([x[i] for x in lines], pa.string()) for i, n in enumerate(("id", "type", "text"))},
                    "error": pa.array([error] * len(lines), pa.string()),
                })

    return source.mapInArrow(run, "path string, ord bigint, id string, type string, text string, error string")
