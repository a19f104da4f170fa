"""Finding files, and what plain Python can read of them: facts of pictures, word-processor documents and their pictures."""

from __future__ import annotations

import io
import struct
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# File kinds by extension, folders whose pictures are our own extracts, and forms of extracted file names.
KINDS = {
    "pdf": ["pdf"],
    "docx": ["docx", "doc"],
    "image": ["png", "jpg", "jpeg", "gif", "bmp", "tiff", "webp"],
    "audio": ["mp3", "wav", "m4a", "flac", "ogg", "opus", "wma", "aac"],
}
SKIPPED = ["extracted_data", "docx_extracted", "pdf_extracted"]
NAMED = ["figure-{n}.*[.]jpg", "figure-{n}.*[.]png", "figure-{n}.*[.]jpeg", "figure-{n}-.*[.]jpg", "figure-{n}-.*[.]png", ".*-{n}[.]jpg", ".*-{n}[.]png"]


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def file_kind(path: Column) -> Column:
    """pdf, docx, image or audio by extension; null for others and for pictures in folders of our own extracts."""
    ext = F.lower(F.regexp_extract(file_name(path), r"\.([^.]+)$", 1))
    folder = F.regexp_extract(path, r"^(.*)[/\\]", 1)
    own = sum((folder.contains(s).cast("int") for s in SKIPPED), F.lit(0)) > 0
    kind = F.lit(None).cast("string")
    for name, exts in KINDS.items():
        kind = F.when(ext.isin(exts), F.lit(name)).otherwise(kind)
    return F.when((kind == "image") & own, F.lit(None).cast("string")).otherwise(kind)


def find_files(spark: SparkSession, folder: str, kind: str | None = None, recursive: bool = True, content: bool = False) -> DataFrame:
    """(path, length, modificationTime, file_kind[, content]) of all files of known kinds, or of one kind, in folder; contents are read only if asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    files = files.select("path", "length", "modificationTime", *(["content"] if content else []))
    files = files.withColumn("file_kind", file_kind(F.col("path")))
    return files.filter("file_kind is not null" if kind is None else F.col("file_kind") == kind)


def in_order(files: DataFrame) -> DataFrame:
    """Files in order of their paths."""
    return files.orderBy("path")


def valid_audio(files: DataFrame) -> DataFrame:
    """The files that are recordings by their extension; a listing holds only files that exist."""
    return files.filter(file_kind(F.col("path")) == "audio")


def image_for(candidates: DataFrame) -> DataFrame:
    """Of (source, number, path) the file of a source's number-th picture, from 0: the first of the forms NAMED that a file name has, else the number-th
    picture by name; no row where there is neither. Of several files of a form the first by path."""
    name, n = file_name(F.col("path")), F.col("number").cast("string")
    fits = F.lit(len(NAMED))
    for i, form in reversed(list(enumerate(NAMED))):
        before, after = form.split("{n}")
        fits = F.when(F.rlike(name, F.concat(F.lit(f"^{before}"), n, F.lit(f"{after}$"))), F.lit(i)).otherwise(fits)
    picture = F.rlike(name, F.lit(r"[.](jpg|png|jpeg)$"))
    by_name = F.sum(picture.cast("int")).over(Window.partitionBy("source", "number").orderBy(name, "path").rowsBetween(Window.unboundedPreceding, 0))
    ranked = candidates.withColumns({"fits": fits, "nth": F.when(picture, by_name - 1)}).filter((F.col("fits") < len(NAMED)) | (F.col("nth") == F.col("number")))
    first = F.row_number().over(Window.partitionBy("source", "number").orderBy("fits", "path"))
    return ranked.withColumn("n", first).filter("n = 1").select("source", "number", "path")


# --- pictures -----------------------------------------------------------------------------------------------------------------


def image_facts(content: bytes) -> tuple[str, str, int, int]:
    """(format, mode, width, height) from the head of a PNG, JPEG, GIF, BMP or WEBP file; ValueError for anything else."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 26:
        width, height, _, colour = struct.unpack(">IIBB", content[16:26])
        return "PNG", {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}.get(colour, "RGB"), width, height
    if content[:6] in (b"GIF87a", b"GIF89a") and len(content) >= 10:
        return "GIF", "P", *struct.unpack("<HH", content[6:10])
    if content[:2] == b"BM" and len(content) >= 30:
        width, height, _, bits = struct.unpack("<iiHH", content[18:30])
        return "BMP", "P" if bits <= 8 else "RGB", width, abs(height)
    if content[:4] == b"RIFF" and content[8:12] == b"WEBP" and len(content) >= 30:
        if content[12:16] == b"VP8X":
            return "WEBP", "RGB", 1 + int.from_bytes(content[24:27], "little"), 1 + int.from_bytes(content[27:30], "little")
        if content[12:16] == b"VP8L":
            bits = int.from_bytes(content[21:25], "little")
            return "WEBP", "RGB", 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        width, height = struct.unpack("<HH", content[26:30])
        return "WEBP", "RGB", width & 0x3FFF, height & 0x3FFF
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(content) and content[at] == 0xFF:
            marker, size = content[at + 1], int.from_bytes(content[at + 2 : at + 4], "big")
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                height, width, parts = struct.unpack(">HHB", content[at + 5 : at + 10])
                return "JPEG", {1: "L", 3: "RGB", 4: "CMYK"}.get(parts, "RGB"), width, height
            at += 2 + size
    raise ValueError("not a picture of a known format")


# --- word-processor documents -------------------------------------------------------------------------------------------------

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _parts(content: bytes) -> zipfile.ZipFile:
    return zipfile.ZipFile(io.BytesIO(content))


def docx_elements(content: bytes) -> list[tuple]:
    """(element_idx, element_type, style, text, cells) of a document's body in order; style is the style's name where the document names it."""
    z = _parts(content)
    styles = {}
    if "word/styles.xml" in z.namelist():
        for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
            name = s.find(f"{_W}name")
            if name is not None:
                styles[s.get(f"{_W}styleId")] = (name.get(f"{_W}val") or "").replace("heading", "Heading", 1)
    body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    out = []
    for e in body if body is not None else []:
        if e.tag == f"{_W}p":
            style = e.find(f"{_W}pPr/{_W}pStyle")
            named = style.get(f"{_W}val") if style is not None else None
            out.append((len(out), "Paragraph", styles.get(named, named), said(e), None))
        elif e.tag == f"{_W}tbl":
            cells = [["\n".join(said(p) for p in c.findall(f"{_W}p")).strip() for c in r.findall(f"{_W}tc")] for r in e.findall(f"{_W}tr")]
            out.append((len(out), "Table", None, "", cells))
    return out


def docx_images(content: bytes, stem: str) -> list[tuple[str, bytes]]:
    """Pictures of a document, in the order in which it relates to them, with the names they are saved under; what is no picture is passed over."""
    z = _parts(content)
    related = "word/_rels/document.xml.rels"
    if related not in z.namelist():
        return []
    out = []
    for r in ElementTree.fromstring(z.read(related)):
        target = r.get("Target") or ""
        if "image" in target and r.get("TargetMode") != "External":
            try:
                picture = z.read(target.lstrip("/") if target.startswith("/") else f"word/{target}")
                image_facts(picture)
            except (KeyError, ValueError):
                continue
            out.append((f"{stem}_image_{len(out)}.png", picture))
    return out
