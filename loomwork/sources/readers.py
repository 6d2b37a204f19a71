"""Readers: files, tables and pages become documents (identity, source, file_name, page, content, metadata)."""

from __future__ import annotations

import html
import re
import zipfile
from collections.abc import Callable, Iterator
from io import BytesIO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions.text import html_to_text, is_blank, latin1
from loomwork.sources.pdf import paragraphs, pdf_pages

# File name endings and the kind of document they hold.
KINDS = {
    "pdf": "PDF",
    "md": "WIKI",
    "markdown": "WIKI",
    **{e: "FILE" for e in ("txt", "json", "xlsx", "xls", "docx", "doc", "pptx", "ppt", "html", "htm")},
}
COLUMNS = ["identity", "source", "file_name", "page", "content", "metadata"]
DOCUMENT = "identity string, source string, file_name string, page int, content string, metadata map<string,string>"
OCR_LEAST_CHARS = 40


class UnsupportedDocument(ValueError):
    pass


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def kind(name: Column) -> Column:
    """The kind of a file by its name; null for an unknown one."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair)), extension(name))


def kind_of(name: str) -> str:
    ext = name.rpartition(".")[2].lower() if "." in name else ""
    if ext not in KINDS:
        raise UnsupportedDocument(f"unsupported file: {name}")
    return KINDS[ext]


def document(df: DataFrame, source: Column, name: Column, content: Column, page: Column | None = None) -> DataFrame:
    empty = F.create_map().cast("map<string,string>")
    return df.select(F.concat(source, F.lit("#"), name).alias("identity"), source.alias("source"), name.alias("file_name"), (page if page is not None else F.lit(None)).cast("int").alias("page"), content.alias("content"), empty.alias("metadata"))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def text_files(spark: SparkSession, path: str, glob: str = "*.txt", source: str = "FILE") -> DataFrame:
    """Each file is one document."""
    files = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    return document(files.select("value", "_metadata"), F.lit(source), F.col("_metadata.file_name"), F.col("value"))


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    return text_files(spark, path, "*.md", "WIKI")


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """Each JSON value is one document, written out again as JSON."""
    rows = spark.read.option("pathGlobFilter", "*.json").json(path, multiLine=True)
    named = rows.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns))).alias("value"), "_metadata")
    return document(named, F.lit("FILE"), F.col("_metadata.file_name"), F.col("value"))


# --- office files: parsers of bytes to (page, text), run on Arrow batches


def sheet_rows(data: bytes) -> list[tuple[str, list[list[str]]]]:
    """Sheets of a spreadsheet as (name, rows of cell texts), read from its XML parts."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{{{ns['m']}}}sheet"):
            part = targets[s.get(rel)].lstrip("/")
            tree = ElementTree.fromstring(z.read(part if part.startswith("xl/") else f"xl/{part}"))
            rows = []
            for row in tree.iter(f"{{{ns['m']}}}row"):
                cells: dict[int, str] = {}
                for i, c in enumerate(row.findall("m:c", ns)):
                    letters = re.match("[A-Z]+", c.get("r") or "")
                    place = i if not letters else sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters.group()))) - 1
                    v, t = c.find("m:v", ns), c.get("t")
                    text = "".join(x.text or "" for x in c.iter(f"{{{ns['m']}}}t")) if t == "inlineStr" else (v.text or "" if v is not None else "")
                    cells[place] = shared[int(text)] if t == "s" and text else text
                rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
            out.append((s.get("name"), rows))
    return out


def markdown_cell(text: str) -> str:
    return text.replace("|", r"\|").replace("\r", "").replace("\n", " ").strip()


def markdown_table(name: str, rows: list[list[str]]) -> str:
    """A sheet as a Markdown table; empty for a sheet without any text."""
    width = max((len(r) for r in rows), default=0)
    if not any(c.strip() for r in rows for c in r):
        return ""
    line = lambda cells: "| " + " | ".join(cells) + " |"
    body = [line([markdown_cell(c) for c in r] + [""] * (width - len(r))) for r in rows]
    return f"## {name}\n\n" + "\n".join([body[0], line(["---"] * width), *body[1:]])


def xlsx_pages(data: bytes) -> list[tuple[int | None, str]]:
    return [(None, t) for n, rows in sheet_rows(data) if (t := markdown_table(n, rows))]


def xml_text(data: bytes, part: str, block: str) -> list[tuple[int | None, str]]:
    """Text of the parts of an office file whose names match, one paragraph a line."""
    out = []
    with zipfile.ZipFile(BytesIO(data)) as z:
        for name in sorted((n for n in z.namelist() if re.fullmatch(part, n)), key=lambda n: [int(x) for x in re.findall(r"\d+", n)]):
            lines = ["".join(t.text or "" for t in p.iter() if t.tag.endswith("}t")) for p in ElementTree.fromstring(z.read(name)).iter() if p.tag.endswith(block)]
            out.append("\n".join(x for x in lines if x))
    return [(None, "\n\n".join(out))]


def html_pages(data: bytes) -> list[tuple[int | None, str]]:
    text = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]+>", " ", data.decode("utf-8", "replace"))
    return [(None, re.sub(r"\s+", " ", html.unescape(text)).strip())]


#: Parsers by file ending; another is registered as parser(bytes) -> [(page, text)].
PARSERS: dict[str, Callable[[bytes], list[tuple[int | None, str]]]] = {
    "pdf": pdf_pages,
    "xlsx": xlsx_pages,
    "docx": lambda d: xml_text(d, r"word/document\.xml", "}p"),
    "pptx": lambda d: xml_text(d, r"ppt/slides/slide\d+\.xml", "}p"),
    "html": html_pages,
    "htm": html_pages,
    "txt": lambda d: [(None, d.decode("utf-8", "replace"))],
    "md": lambda d: [(None, d.decode("utf-8", "replace"))],
}


def parsers_of(granularity: str = "page") -> dict[str, Callable[[bytes], list[tuple[int | None, str]]]]:
    """The parsers by file ending; of PDF files a document is a page or a paragraph."""
    if granularity not in ("page", "paragraph"):
        raise ValueError(f"unknown granularity: {granularity}")
    return PARSERS | ({"pdf": paragraphs} if granularity == "paragraph" else {})


def rows_of_file(path: str, data: bytes, known: dict, ocr: Callable[[bytes, int | None], str] | None = None, least_chars: int = OCR_LEAST_CHARS) -> list[tuple]:
    """The documents of one file."""
    name = path.rpartition("/")[2]
    try:
        label = kind_of(name)
        pages = known[name.rpartition(".")[2].lower()](data)
    except Exception as e:  # one unreadable file must not end the job: it is reported in its row
        return [(f"FILE#{name}", "FILE", name, None, None, [("error", f"{type(e).__name__}: {e}")])]
    rows = []
    for page, text in pages:
        meta = []
        if ocr and len(text) < least_chars:
            try:
                seen = ocr(data, page)
            except Exception:
                seen = ""
            if seen.strip():
                text, meta = seen, [("ocr", "true")]
        rows.append((f"{label}#{name}", label, name, page, text, meta))
    return rows


def files(spark: SparkSession, path: str, parsers: dict | None = None, glob: str = "*", ocr: Callable[[bytes, int | None], str] | None = None, least_chars: int = OCR_LEAST_CHARS, granularity: str = "page") -> DataFrame:
    """Documents of a folder by file ending. Files without a parser give a row with null content and metadata.error.

    Pages with fewer than least_chars characters are read again by ocr, if there is one; blank or failed OCR changes nothing.
    """
    known = {**parsers_of(granularity), **(parsers or {})}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path_, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows += rows_of_file(path_, data, known, ocr, least_chars)
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], COLUMNS)

    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    return raw.mapInArrow(run, DOCUMENT)


#: Rows of a table that are written as one text.
MOST_ROWS = 100_000


def table_as_markdown(df: DataFrame, name: str, order: str, most: int = MOST_ROWS) -> DataFrame:
    """One row (content): a sheet-sized table as Markdown, in the given order, all columns as text. More than `most` rows,
    which would be one text of one row, are an error."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows in one text")
    cells = [F.trim(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))) for c in df.columns]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    head = f"## {name}\n\n| " + " | ".join(df.columns) + " |\n| " + " | ".join(["---"] * len(df.columns)) + " |"
    rows = df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda r: r["l"]), "\n").alias("_b"))
    return rows.select(F.concat(F.lit(head + "\n"), F.col("_b")).alias("content"))


def pages_as_text(pages: DataFrame) -> DataFrame:
    """page_id, url, content: HTML reduced to text within the JVM."""
    return pages.select("page_id", "url", html_to_text(F.col("html")).alias("content"))


# --- relational rows


def faqs(df: DataFrame) -> DataFrame:
    text = F.concat(F.lit("Question: "), F.coalesce("question", F.lit("")), F.lit("\nAnswer: "), F.coalesce("answer", F.lit("")))
    return rows(df, "faqs", text, "department", "visibility")


def release_notes(df: DataFrame) -> DataFrame:
    text = F.concat(F.lit("Version: "), F.coalesce("version", F.lit("")), F.lit("\nSummary: "), F.coalesce("summary", F.lit("")), F.lit("\nDetails: "), F.coalesce("details", F.lit("")))
    return rows(df, "release_notes", text, "version", "release_date")


def announcements(df: DataFrame) -> DataFrame:
    text = F.concat(F.lit("Subject: "), F.coalesce("subject", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit("")))
    return rows(df, "announcements", text, "category", "effective_from", "effective_to")


def rows(df: DataFrame, table: str, text: Column, *meta: str) -> DataFrame:
    """Database rows as documents with identity DB#table#id; nulls in metadata become empty."""
    pairs = [x for c in meta for x in (F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("")))]
    id_ = F.col("id").cast("string")
    return df.select(F.concat(F.lit(f"DB#{table}#"), id_).alias("identity"), F.lit("DB").alias("source"), F.lit(None).cast("string").alias("file_name"), F.lit(None).cast("int").alias("page"), text.alias("content"), F.create_map(F.lit("table"), F.lit(table), *pairs).alias("metadata"))


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A database table; give partitionColumn, lowerBound, upperBound and numPartitions to read it in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def union(*sources: DataFrame) -> DataFrame:
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def gold_set(spark: SparkSession, path: str) -> DataFrame:
    """query_id, query, relevant_sources of a JSON list of {query, relevantSources}."""
    raw = spark.read.schema("query string, relevantSources array<string>").json(path, multiLine=True)
    return raw.select(F.xxhash64("query").alias("query_id"), "query", F.col("relevantSources").alias("relevant_sources"))


def printable(df: DataFrame, column: str = "content") -> DataFrame:
    return df.withColumn(column, F.when(is_blank(F.col(column)), F.lit("")).otherwise(latin1(F.col(column))))
