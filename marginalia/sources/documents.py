"""Document sources: Markdown, HTML, EPUB, DOCX, plain text and catalogue CSV, as rows of paragraphs."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from html import escape, unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PARAGRAPHS = "path string, ordinal int, text string"
_BREAK = re.compile(r"(?i)</(?:p|div|h[1-6]|li|blockquote|section|tr|title)\s*>|<br\s*/?>")
_TAG = re.compile(r"<[^>]*>")


def markdown(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ordinal, section, text): paragraphs with the last heading above them."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("ordinal", "line"))
    heading = F.when(F.col("line").rlike("^#{1,6}\\s"), F.trim(F.regexp_replace("line", "^#{1,6}\\s+|\\s+#+\\s*$", "")))
    w = Window.partitionBy(key).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("section", F.last(heading, True).over(w)).where((F.trim("line") != "") & ~F.col("line").rlike("^#{1,6}\\s")).select(key, "ordinal", "section", F.trim("line").alias("text"))


def plain(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ordinal, text): paragraphs between line ends; line ends are unified and a byte-order mark goes."""
    unified = F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")
    return docs.select(key, F.posexplode(F.split(unified, "\n+")).alias("ordinal", "text")).where(F.trim("text") != "")


def _markup_paragraphs(markup: str) -> list[str]:
    markup = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", "", markup)
    return [t for t in (" ".join(unescape(_TAG.sub("", x)).split()) for x in _BREAK.split(markup)) if t]


def _part(z: zipfile.ZipFile, name: str) -> str:
    return z.read(name).decode("utf-8", "replace")


def _attributes(markup: str, tag: str) -> list[dict[str, str]]:
    return [dict(re.findall(r"([\w:.-]+)\s*=\s*[\"']([^\"']*)[\"']", t)) for t in re.findall(rf"<(?:\w+:)?{tag}\b([^>]*)>", markup)]


def _spine(z: zipfile.ZipFile) -> list[str]:
    """Names of the reading order's parts; without a package file all markup parts by name."""
    names = set(z.namelist())
    roots = [a["full-path"] for a in _attributes(_part(z, "META-INF/container.xml"), "rootfile") if a.get("full-path") in names] if "META-INF/container.xml" in names else []
    if not roots:
        return sorted(n for n in names if n.lower().endswith((".xhtml", ".html", ".htm")))
    package = _part(z, roots[0])
    hrefs = {a.get("id"): posixpath.normpath(posixpath.join(posixpath.dirname(roots[0]), unescape(a.get("href", "")))) for a in _attributes(package, "item")}
    return [hrefs[a["idref"]] for a in _attributes(package, "itemref") if hrefs.get(a.get("idref")) in names]


def _epub(data: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return [p for n in _spine(z) for p in _markup_paragraphs(_part(z, n))]


def _docx(data: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        xml = z.read("word/document.xml").decode("utf-8", "replace")
    out = []
    for p in re.findall(r"<w:p[ >].*?</w:p>", xml, re.S):
        text = "".join(unescape(t) for t in re.findall(r"<w:t(?: [^>]*)?>([^<]*)</w:t>", p))
        if text.strip():
            out.append(text.strip())
    return out


def _html(data: bytes) -> list[str]:
    return _markup_paragraphs(data.decode("utf-8", "replace"))


READERS = {"epub": _epub, "docx": _docx, "html": _html}


def binary_documents(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Paragraph rows of all files of a kind below path; a file that cannot be read gives one row with null text."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").option("recursiveFileLookup", "true").load(path)
    return read_contents(files, kind)


def read_contents(files: DataFrame, kind: str) -> DataFrame:
    """The same of (path, content)."""
    read = READERS[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, content in zip(b["path"], b["content"], strict=True):
                try:
                    rows += [(name, i, t) for i, t in enumerate(read(content))]
                except (zipfile.BadZipFile, KeyError):
                    rows.append((name, 0, None))
            yield pd.DataFrame(rows, columns=["path", "ordinal", "text"])

    return files.select("path", "content").mapInPandas(run, PARAGRAPHS)


#: Parts of a document that show text beside its body.
SHOWN_PARTS = re.compile(r"word/(?:document|(?:header|footer|footnotes|endnotes)\d*)\.xml")


def docx_census(files: DataFrame) -> DataFrame:
    """(path, part, paragraphs, drawings, fonts): counts over every shown part of each document; drawings counts paragraphs that hold one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, content in zip(b["path"], b["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for part in sorted(filter(SHOWN_PARTS.fullmatch, z.namelist())):
                        xml = _part(z, part)
                        held = re.findall(r"<w:p[ >].*?</w:p>", xml, re.S)
                        rows.append((name, part, len(held), sum("<w:drawing" in p for p in held), sorted(set(re.findall(r'w:(?:ascii|hAnsi|cs)="([^"]+)"', xml)))))
            yield pd.DataFrame(rows, columns=["path", "part", "paragraphs", "drawings", "fonts"])

    return files.select("path", "content").mapInPandas(run, "path string, part string, paragraphs long, drawings long, fonts array<string>")


def _zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()


def _as_docx(lines: list[str]) -> bytes:
    return _zipped({"word/document.xml": "<w:document><w:body>" + "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in lines) + "</w:body></w:document>"})


def _as_epub(lines: list[str], a_part: int = 50) -> bytes:
    """Parts are named against the reading order, which only the spine gives."""
    cuts = range(0, len(lines), a_part)
    names = [f"part{len(cuts) - i:06d}.xhtml" for i in range(len(cuts))]
    items = "".join(f'<item id="p{i}" href="{n}"/>' for i, n in enumerate(names))
    package = f"<package><manifest>{items}</manifest><spine>" + "".join(f'<itemref idref="p{i}"/>' for i in range(len(names))) + "</spine></package>"
    parts = {"META-INF/container.xml": '<container><rootfile full-path="book/package.opf"/></container>', "book/package.opf": package}
    return _zipped(parts | {f"book/{n}": "".join(f"<p>{escape(x)}</p>" for x in lines[at : at + a_part]) for n, at in zip(names, cuts, strict=True)})


WRITERS = {"docx": _as_docx, "epub": _as_epub}


def as_contents(docs: DataFrame, key: str, text: str, kind: str) -> DataFrame:
    """(path, content): each text as a document of that kind, a paragraph for each line."""
    write = WRITERS[kind]

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: write((t or "").split("\n")))

    return docs.select(F.col(key).cast("string").alias("path"), run(text).alias("content"))


def write_catalogue_csv(df: DataFrame, path: str) -> None:
    """CSV whose cells cannot be read as formulas: a leading = + - @ gets an apostrophe."""
    safe = [F.when(F.col(c).cast("string").rlike("^[=+\\-@\\t\\r]"), F.concat(F.lit("'"), F.col(c).cast("string"))).otherwise(F.col(c).cast("string")).alias(c) for c in df.columns]
    df.select(*safe).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_catalogue_csv(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """The inverse; rows whose key occurs more than once are an error when they are read."""
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    plain_cells = [F.regexp_replace(c, "^'(?=[=+\\-@\\t\\r])", "").alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    n = F.count("*").over(Window.partitionBy(key))
    once = df.select(*plain_cells).withColumn("_n", n)
    return once.where(F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.concat(F.lit("duplicate id "), F.col(key).cast("string"))).cast("boolean"))).drop("_n")


def catalogue_line(columns: list[str]) -> Column:
    """A catalogue row as a CSV line: every cell quoted, line ends as spaces, formulas disarmed."""

    def cell(c: str) -> Column:
        v = F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "\r?\n", " ")
        v = F.when(v.rlike("^[=+\\-@\t\r]"), F.concat(F.lit("'"), v)).otherwise(v)
        return F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))

    return F.concat_ws(",", *map(cell, columns))
