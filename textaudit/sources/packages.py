"""Word packages as a source: each file is checked within byte limits and read to text units, or is a row that says why it isn't.

Files come through Spark's binary reader, so from any store, and one at a time through a task. Nothing is unpacked to disk or
inflated whole: parts stream through the checks and the parser. Nothing is written back.
"""

from __future__ import annotations

import io
import re
import stat
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """Most bytes of a file, of all its parts, of a part, of an XML part and of a part that must be there; most parts; most times that a part
    of ratio_from bytes or more may grow."""

    file: int = 128 << 20
    total: int = 512 << 20
    part: int = 128 << 20
    xml: int = 64 << 20
    metadata: int = 4 << 20
    parts: int = 4096
    ratio: float = 1000.0
    ratio_from: int = 4 << 20


class Unfit(Exception):
    """The reason why a file is no package to be read."""


MAIN, TYPES, LINKS = "word/document.xml", "[Content_Types].xml", "_rels/.rels"
_TYPE = b"application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
_SPACES = (b"schemas.openxmlformats.org/wordprocessingml", b"purl.oclc.org/ooxml/wordprocessingml")
_DECLARATION = re.compile(rb"<!(?:doctype|entity)", re.IGNORECASE)
_PIECE = 1 << 20


def _unsafe(name: str) -> bool:
    """Whether a part's name isn't a relative path of plain steps."""
    steps = name.removesuffix("/").split("/")
    return len(name) > 1024 or "\\" in name or "\0" in name or steps[0][1:2] == ":" or bool({"", ".", ".."} & set(steps))


def _pieces(archive: zipfile.ZipFile, info: zipfile.ZipInfo) -> Iterator[bytes]:
    size = 0
    with archive.open(info) as part:
        while piece := part.read(_PIECE):
            size += len(piece)
            if size > info.file_size:
                raise Unfit("size_differs")
            yield piece
    if size != info.file_size:
        raise Unfit("size_differs")


def _check_part(archive: zipfile.ZipFile, info: zipfile.ZipInfo, limits: Limits) -> None:
    xml = info.filename == TYPES or info.filename.endswith((".xml", ".rels"))
    rules = (
        ("encrypted", info.flag_bits & 1), ("link", stat.S_ISLNK(info.external_attr >> 16 & 0xFFFF)), ("compression_method", info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED)),
        ("part_too_large", info.file_size > (limits.xml if xml else limits.part)), ("ratio", info.file_size >= limits.ratio_from and info.file_size > limits.ratio * max(1, info.compress_size)),
    )
    for reason, broken in rules:
        if broken:
            raise Unfit(reason)
    if xml:
        tail = b""
        for piece in _pieces(archive, info):
            if _DECLARATION.search(tail + piece):
                raise Unfit("declaration")
            tail = piece[-16:]
    else:
        with archive.open(info) as part:  # its headers are compared
            part.read(1)


def check_package(archive: zipfile.ZipFile, limits: Limits) -> dict[str, int]:
    """Raises Unfit with the first reason, in the order of the parts; else how many parts and bytes there are."""
    every = archive.infolist()
    names = [i.filename for i in every]
    if not every or len(every) > limits.parts:
        raise Unfit("too_many_parts" if every else "missing_part")
    if any(map(_unsafe, names)):
        raise Unfit("unsafe_part_name")
    if len(set(names)) < len(names):
        raise Unfit("duplicate_part")
    files = [i for i in every if not i.is_dir()]
    total, packed = sum(i.file_size for i in files), sum(i.compress_size for i in files)
    if total > limits.total:
        raise Unfit("too_large")
    if total >= limits.ratio_from and total > limits.ratio * max(1, packed):
        raise Unfit("ratio")
    for info in files:
        _check_part(archive, info, limits)
    if not {MAIN, TYPES, LINKS} <= set(names):
        raise Unfit("missing_part")
    for name, wanted, reason in ((TYPES, (_TYPE, b"/word/document.xml"), "content_type"), (LINKS, (b"officedocument", b"word/document.xml"), "relationship")):
        if archive.getinfo(name).file_size > limits.metadata:
            raise Unfit("part_too_large")
        body = b"".join(_pieces(archive, archive.getinfo(name))).lower()
        if not all(w in body for w in wanted):
            raise Unfit(reason)
    with archive.open(MAIN) as part:
        head = part.read(16 << 10).lower()
    if not any(s in head for s in _SPACES):
        raise Unfit("not_word")
    return {"parts": len(every), "bytes": total}


def text_units(archive: zipfile.ZipFile) -> list[tuple[int, str | None, int, bool, str]]:
    """(number, style, list level or -1, whether in a table, text) of the main part's paragraphs in order. Tabs and breaks are \\t and \\n; deleted text and
    field codes are none of it. A paragraph inside another (a text box) is a unit of its own, behind the one that holds it."""
    units, open_, tables = [], [], 0
    with archive.open(MAIN) as part:
        for event, e in ElementTree.iterparse(part, events=("start", "end")):
            tag = e.tag.rsplit("}", 1)[-1]
            value = lambda e=e: next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == "val"), None)
            if event == "start":
                if tag == "p":
                    open_.append([len(units), None, -1, tables > 0, []])
                    units.append(open_[-1])
                tables += tag == "tbl"
                continue
            tables -= tag == "tbl"
            if open_:
                p = open_[-1]
                if tag == "pStyle":
                    p[1] = value()
                elif tag == "ilvl":
                    p[2] = int(value() or 0)
                elif tag in ("t", "tab", "br", "cr"):
                    p[4].append(e.text or "" if tag == "t" else "\t" if tag == "tab" else "\n")
                elif tag == "p":
                    open_.pop()
            if tag in ("p", "tbl", "r", "drawing"):
                e.clear()
    return [(n, style, level, table, "".join(text)) for n, style, level, table, text in units]


UNITS = "path string, ok boolean, reason string, parts int, bytes long, unit int, style string, level int, in_table boolean, text string"
_TYPES = (pa.string(), pa.bool_(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.string())


def read_package(content: bytes, limits: Limits) -> tuple[str | None, dict[str, int], list[tuple]]:
    """(reason or None, sizes, units) of a file's bytes; no bytes make it raise."""
    if content[:4] != b"PK\x03\x04":
        return "no_package", {}, []
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            sizes = check_package(archive, limits)
            return None, sizes, text_units(archive)
    except Unfit as e:
        return str(e), {}, []
    except ElementTree.ParseError:
        return "bad_xml", {}, []
    except (zipfile.BadZipFile, zipfile.LargeZipFile, zlib.error, OSError, EOFError, RuntimeError, NotImplementedError, ValueError):
        return "damaged", {}, []


def scan_packages(files: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008  frozen
    """UNITS: a row for each text unit of each fit file, and one row with its reason (and no unit) for each other; a fit file without
    paragraphs gives one row without a unit.

    files: path, length, content, as Spark's binary reader has them. The content of a file beyond limits.file is not read. Empty and null content is no package.
    """
    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                reason, sizes, units = read_package(content.as_py() or b"", limits)
                units = units or [(None,) * 5]
                rows = [(path, reason is None, reason, sizes.get("parts"), sizes.get("bytes"), *u) for u in units]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], [x.split()[0] for x in UNITS.split(", ")])

    fine = files.where(F.col("length") <= limits.file).select("path", "content").mapInArrow(run, UNITS)
    over = files.where(F.col("length") > limits.file).select("path", F.lit(False).alias("ok"), F.lit("file_too_large").alias("reason"), *[F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in UNITS.split(", ")[3:]])
    return fine.unionByName(over)


def read_packages(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """scan_packages over the .docx files under a folder of any store that Spark reads."""
    return scan_packages(spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path), limits)


def plain_lines(units: DataFrame) -> DataFrame:
    """(path, text): what a reader sees, units that aren't blank with blank lines between them, for each fit file."""
    lines = F.array_sort(F.collect_list(F.when(F.trim("text") != "", F.struct("unit", "text"))))
    return units.where("ok").groupBy("path").agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n\n").alias("text"))
