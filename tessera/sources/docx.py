"""Word files: text runs in, rewritten files out, with nothing but the standard library.

A file's runs, in order: the body, then the headers and footers that its sections refer to (for each
section headers for usual, first and even pages, then footers), each part once and only if it has text;
tables cell by cell, nested ones too; a cell that is merged downwards is read once. After every
paragraph comes a blank line that belongs to no run.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
BREAK = "\n\n"
BLOCKS = "path string, i int, text string, char_offset int, paragraph_index int, run_index int, part string"


def _parts(archive: zipfile.ZipFile) -> list[str]:
    """The document and the parts that its sections refer to, in order, each once; unknown references lead nowhere."""
    names, found = set(archive.namelist()), ["word/document.xml"]
    links = {}
    if "word/_rels/document.xml.rels" in names:
        for link in ElementTree.fromstring(archive.read("word/_rels/document.xml.rels")):
            links[link.get("Id")] = posixpath.normpath(posixpath.join("/word", link.get("Target", ""))).lstrip("/")
    for section in ElementTree.fromstring(archive.read(found[0])).iter(W + "sectPr"):
        for kind in ("header", "footer"):
            own = {x.get(W + "type"): links.get(x.get(R + "id")) for x in section.iter(f"{W}{kind}Reference")}
            found += [part for pages in ("default", "first", "even") if (part := own.get(pages)) in names and part not in found]
    return found


def _has_text(root: ElementTree.Element) -> bool:
    return any(_text(run) for paragraph in _paragraphs(root) for run in _runs(paragraph))


def _paragraphs(node: ElementTree.Element) -> Iterator[ElementTree.Element]:
    for child in node:
        if child.tag == W + "p":
            yield child
        elif child.tag == W + "tc":
            merged = child.find(f"{W}tcPr/{W}vMerge")
            if merged is None or merged.get(W + "val") == "restart":
                yield from _paragraphs(child)
        elif child.tag in (W + "body", W + "tbl", W + "tr", W + "sdt", W + "sdtContent"):
            yield from _paragraphs(child)


def _runs(paragraph: ElementTree.Element) -> Iterator[ElementTree.Element]:
    for child in paragraph:
        if child.tag == W + "r":
            yield child
        elif child.tag in (W + "hyperlink", W + "ins", W + "smartTag", W + "sdt", W + "sdtContent"):
            yield from _runs(child)


def _text(run: ElementTree.Element) -> str:
    out = ""
    for child in run:
        out += (child.text or "") if child.tag == W + "t" else "\t" if child.tag == W + "tab" else "\n" if child.tag in (W + "br", W + "cr") else ""
    return out


def _walk(archive: zipfile.ZipFile) -> Iterator[tuple[str, ElementTree.ElementTree, list[tuple[int, int, ElementTree.Element, str, int]]]]:
    """For each part its tree and its runs with paragraph, run number, text and offset."""
    at = paragraph_index = 0
    for part in _parts(archive):
        tree = ElementTree.ElementTree(ElementTree.fromstring(archive.read(part)))
        root = tree.getroot()
        if part != "word/document.xml" and not _has_text(root):
            continue
        found = []
        for paragraph in _paragraphs(root):
            for k, run in enumerate(_runs(paragraph)):
                if text := _text(run):
                    found.append((paragraph_index, k, run, text, at))
                    at += len(text)
            at += len(BREAK)
            paragraph_index += 1
        yield part, tree, found


def blocks_of(content: bytes) -> list[tuple[str, int, int, int, str]]:
    """``text, char_offset, paragraph_index, run_index, part`` of each run that isn't empty."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        return [(text, at, p, k, part) for part, _, runs in _walk(archive) for p, k, _, text, at in runs]


def text_of(content: bytes) -> str:
    """The flattened text: runs, and a blank line after every paragraph."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        out = ""
        for _, _, runs in _walk(archive):
            for _, _, _, text, at in runs:
                out += "\n" * (at - len(out)) + text
    return out


def rewritten(content: bytes, replacements: list[tuple[int, int, str]]) -> bytes:
    """The file with spans of its flattened text replaced; formats stay.

    The first run that a span touches takes the new text, later ones lose their part.
    """
    todo = sorted(replacements, reverse=True)
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as archive, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
        changed = {}
        for part, tree, runs in _walk(archive):
            touched = False
            texts = {id(run): text for _, _, run, text, _ in runs}
            for start, end, new in todo:
                hit = [(run, at, text) for _, _, run, text, at in runs if at < end and start < at + len(text)]
                for n, (run, at, text) in enumerate(hit):
                    a, b = max(start - at, 0), min(end - at, len(text))
                    now = texts[id(run)]
                    texts[id(run)] = now[:a] + (new if n == 0 else "") + now[b:]
                    touched = True
            if touched:
                for _, _, run, text, _ in runs:
                    if texts[id(run)] != text:
                        for child in [c for c in run if c.tag in (W + "t", W + "tab", W + "br", W + "cr")]:
                            run.remove(child)
                        node = ElementTree.SubElement(run, W + "t")
                        node.text = texts[id(run)]
                        node.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
                changed[part] = ElementTree.tostring(tree.getroot(), encoding="utf-8", xml_declaration=True)
        for item in archive.infolist():
            target.writestr(item, changed.get(item.filename, archive.read(item.filename)))
    return out.getvalue()


def read_blocks(files: DataFrame) -> DataFrame:
    """Runs of the files of a ``binaryFile`` table (``path, content``); files that can't be read have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows += [(path, i, *b) for i, b in enumerate(blocks_of(bytes(content)))]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "i", "text", "char_offset", "paragraph_index", "run_index", "part"])

    return files.select("path", "content").mapInPandas(run, BLOCKS)


def read_texts(files: DataFrame) -> DataFrame:
    """``path, text``: the flattened text of each file; null where it can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for content in batch["content"]:
                try:
                    texts.append(text_of(bytes(content)))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    texts.append(None)
            yield pd.DataFrame({"path": batch["path"], "text": texts})

    return files.select("path", "content").mapInPandas(run, "path string, text string")


def write_redacted(files: DataFrame) -> DataFrame:
    """``path, content`` of files with a ``plan`` column (see ``redact.plan``) applied to their runs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "content": [rewritten(bytes(c), [(p["start"], p["end"], p["replacement"]) for p in plan]) for c, plan in zip(batch["content"], batch["plan"], strict=True)]})

    return files.select("path", "content", F.transform("plan", lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["replacement"].alias("replacement"))).alias("plan")).mapInPandas(run, "path string, content binary")
