"""Readers that give (doc_id, content, metadata) rows."""

from __future__ import annotations

import io
import json
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_SUFFIXES = ("txt", "md", "markdown", "rst", "log")
SKIPPED_TAGS = {"script", "style", "nav", "footer", "header", "aside"}


def document_id(content: Column | str) -> Column:
    return F.substring(F.md5(content), 1, 12)


class _Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.skip, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in SKIPPED_TAGS

    def handle_endtag(self, tag):
        self.skip = max(0, self.skip - (tag in SKIPPED_TAGS))

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def html_to_text(html: str) -> str:
    """Visible text, its blank lines dropped and the rest set apart by blank lines."""
    p = _Text()
    p.feed(html)
    p.close()
    return "\n\n".join(x for x in (y.strip() for y in "\n".join(p.parts).split("\n")) if x)


def html_title(html: Column | str) -> Column:
    return F.regexp_extract(html, r"(?s)<title>([^<]*)</title>", 1)


def html_text(html: Column | str) -> Column:
    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.fillna("").map(html_to_text)

    return run(html)


def docx_to_text(raw: bytes) -> str:
    """Paragraphs, then table rows with cells set apart by bars."""
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml")).find(f"{ns}body")
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{ns}t"))
    paragraphs = [said(p) for p in body.findall(f"{ns}p")]
    rows = [" | ".join(said(c).strip() for c in r.findall(f"{ns}tc")) for t in body.findall(f"{ns}tbl") for r in t.findall(f"{ns}tr")]
    return "\n\n".join(x for x in (*paragraphs, *rows) if x.strip())


def pdf_to_text(raw: bytes) -> str:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF files needs pypdf") from e
    pages = [(p.extract_text() or "").strip() for p in PdfReader(io.BytesIO(raw)).pages]
    return "\n\n".join(p for p in pages if p)


def bytes_to_text(raw: bytes, suffix: str) -> str:
    if suffix in TEXT_SUFFIXES or suffix == "csv":
        return raw.decode("utf-8", "ignore")
    if suffix == "json":
        return json.dumps(json.loads(raw), indent=2, ensure_ascii=False)
    if suffix in ("html", "htm"):
        return html_to_text(raw.decode("utf-8", "ignore"))
    if suffix == "docx":
        return docx_to_text(raw)
    if suffix == "pdf":
        return pdf_to_text(raw)
    raise ValueError(f"no reader for .{suffix}")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path, wholetext=True).select(F.col("value").alias("content"), F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_name").alias("filename"))
    return rows.select(document_id("content").alias("doc_id"), "content", F.create_map(F.lit("source"), F.col("source"), F.lit("filename"), F.col("filename")).alias("metadata"))


def read_directory(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (*TEXT_SUFFIXES, "html", "htm", "docx", "csv", "json")) -> DataFrame:
    """All known files below a folder; parts that begin with a dot are skipped, files that can't be read give a null content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    inner = F.regexp_replace("path", "^.*?" + re.escape(path.rstrip("/")), "")
    files = files.filter(~inner.rlike(r"/\.")).withColumn("suffix", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))).filter(F.col("suffix").isin(*suffixes))

    @F.pandas_udf("string")
    def parse(content: pd.Series, suffix: pd.Series) -> pd.Series:
        def one(c, s):
            try:
                return bytes_to_text(bytes(c), s)
            except Exception:  # a broken file must not end the scan of the others
                return None

        return pd.Series([one(c, s) for c, s in zip(content, suffix, strict=True)], dtype=object)

    rows = files.select("path", "suffix", parse("content", "suffix").alias("content"))
    return rows.select(document_id("content").alias("doc_id"), "content", F.create_map(F.lit("source"), F.col("path"), F.lit("type"), F.col("suffix")).alias("metadata"))


def rows_to_text(df: DataFrame, columns: list[str] | None = None) -> Column:
    """'column: value' of every column that isn't null, set apart by bars."""
    parts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in columns or df.columns]
    return F.concat_ws(" | ", *parts)


def read_csv(spark: SparkSession, path: str, separator: str = ",", one_document: bool = False) -> DataFrame:
    """A document a row, or one a file with its rows in order."""
    df = spark.read.csv(path, header=True, sep=separator)
    if not one_document:
        return df.select(rows_to_text(df).alias("content")).select(document_id("content").alias("doc_id"), "content")
    rows = df.select(rows_to_text(df).alias("line"), F.col("_metadata.file_path").alias("source"), F.monotonically_increasing_id().alias("at"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x["line"])
    return rows.groupBy("source").agg(F.array_join(lines, "\n").alias("content")).select(document_id("content").alias("doc_id"), "content")


def scan_texts(spark: SparkSession, path: str) -> DataFrame:
    """(source, content) of the text files that match a path or glob; blank ones are skipped, broken bytes replaced."""
    rows = spark.read.format("binaryFile").load(path).select(F.col("path").alias("source"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    return rows.filter(F.coalesce(F.length(F.regexp_replace("content", r"\s+", "")), F.lit(0)) > 0)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(qid, question, answer, relevant) of a JSON array or of JSON lines; fields that are missing are null."""
    schema = "qid string, question string, answer string, relevant array<string>"
    head = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
    array = bool(head) and head[0][0].lstrip().startswith("[")
    return spark.read.schema(schema).option("multiLine", array).json(path).filter("question is not null")


#: The namespace of addresses, of version 5 identifiers.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column | str, namespace: str = URL_NAMESPACE) -> Column:
    """The version 5 identifier of a name: the same name has the same, so that writing a point again replaces it."""
    text = F.col(name) if isinstance(name, str) else name
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(text, "UTF-8")))
    variant = F.substr(F.lit("89ab"), F.conv(F.substr(h, F.lit(17), F.lit(1)), 16, 10).cast("int") % 4 + 1, F.lit(1))
    part = lambda at, n: F.substr(h, F.lit(at), F.lit(n))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def video_id(url: Column | str) -> Column:
    """The 11-character id of a video address, or of a bare id."""
    return F.regexp_extract(url, r"(?:v=|youtu\.be/|embed/|shorts/|^)([A-Za-z0-9_-]{11})(?:[?&#/]|$)", 1)
