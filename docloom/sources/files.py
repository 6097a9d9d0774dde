"""Document sources: files of a folder as rows, texts out of plain, JSON and paged documents, plug-in PDF parsers."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import annotate_sections, clean_pdf_noise, has_tables, section_titles, split_headings, suffix
from docloom.schema import PAGE

#: Suffixes in the order in which a folder is scanned.
SUFFIXES = (".pdf", ".txt", ".json")


def scan(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """path, doc_name, doc_type, size_bytes, modified, content of the folder's own files with these suffixes.

    Suffixes match as written; files of subfolders are left out. Content is read only where it is selected.
    """
    pattern = "*{" + ",".join(suffixes) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "false").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    order = F.array_position(F.array(*map(F.lit, suffixes)), F.regexp_extract(name, r"(\.[^.]+)$", 1))
    return files.select("path", name.alias("doc_name"), suffix(name).alias("doc_type"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), order.alias("scan_order"), "content")


def store(spark: SparkSession, folder: str, name: str, content: bytes) -> str:
    """Write an uploaded document into the folder of documents; its path. Only the suffixes that are read are allowed."""
    if not name.lower().endswith(SUFFIXES) or "/" in name or "\\" in name:
        raise ValueError(f"unsupported file: {name}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, name)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    return path.toString()


def listing(files: DataFrame) -> DataFrame:
    """doc_name, doc_type, size_bytes, modified: the folder without its contents."""
    return files.select("doc_name", "doc_type", "size_bytes", "modified").orderBy("doc_name")


def _decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for contents in batches:
        yield contents.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))


def decode(content: Column | str) -> Column:
    """UTF-8 text without the bytes that aren't; where all are, no Python is needed: see `decode_valid`."""
    return F.pandas_udf(_decoded, "string")(content)


def decode_valid(content: Column | str) -> Column:
    """UTF-8 text, null where a byte isn't; without Python."""
    return F.try_validate_utf8((F.col(content) if isinstance(content, str) else content).cast("string"))


def json_text(raw: str | None) -> str:
    """An object's text, else its content, else itself dumped; a list's objects joined by blank lines; any other as str."""
    try:
        value = json.loads(raw or "")
    except ValueError:
        return ""

    def one(x: dict, otherwise) -> str:
        return str(x.get("text", x.get("content", otherwise(x))))

    if isinstance(value, dict):
        return one(value, json.dumps)
    if isinstance(value, list):
        return "\n\n".join(one(x, str) for x in value if isinstance(x, dict))
    return str(value)


def _json_texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for raws in batches:
        yield raws.map(json_text)


def text_of_json(raw: Column | str) -> Column:
    return F.pandas_udf(_json_texts, "string")(raw)


def pages_of_markdown(text: Column, source_file: Column, parser: str = "markdown") -> Column:
    """array of pages, one for each part from heading to heading; a text without any is one page."""
    parts = split_headings(text)
    some = F.when(F.size(parts) > 0, parts).otherwise(F.array(F.trim(text)))
    return F.transform(some, lambda p, i: page(i + 1, p, source_file, F.size(some), parser)).cast(f"array<{PAGE}>")


def page(number: Column, text: Column, source_file: Column, total: Column, parser: Column | str, tables: Column | None = None) -> Column:
    meta = F.struct(source_file.alias("source_file"), total.alias("total_pages"), F.lit(None).cast("double").alias("page_width"), F.lit(None).cast("double").alias("page_height"), (F.lit(parser) if isinstance(parser, str) else parser).alias("parser"), (has_tables(text) if tables is None else tables).alias("has_tables"), section_titles(text).alias("sections"))
    return F.struct(number.cast("int").alias("page_num"), text.alias("text"), meta.alias("metadata"))


def pages_of_texts(texts: Column, source_file: Column, parser: Column | str, tables: Column | None = None) -> Column:
    """array of pages from an array of raw page texts: noise removed, tables appended as they are, section references
    made headings. tables: per page an array of markdown tables."""
    cleaned = F.transform(texts, clean_pdf_noise)
    held = cleaned if tables is None else F.zip_with(cleaned, tables, lambda t, own: F.when(F.size(own) > 0, F.concat_ws("\n\n", t, F.array_join(own, "\n\n"))).otherwise(t))
    made = F.transform(held, annotate_sections)
    has = (lambda i: None) if tables is None else (lambda i: F.size(F.element_at(tables, i + 1)) > 0)
    name = F.lit(parser) if isinstance(parser, str) else parser
    return F.transform(made, lambda t, i: page(i + 1, t, source_file, F.size(made), name, has(i))).cast(f"array<{PAGE}>")


def text_of_pages(pages: Column) -> Column:
    """Non-empty pages joined by blank lines."""
    return F.array_join(F.filter(F.transform(pages, lambda p: p["text"]), lambda t: t != ""), "\n\n")


#: From a document to its pages: texts, or (text, tables) with tables as rows of cells.
PdfParser = Callable[[bytes], list]


def tabled_pages(content: bytes) -> list:
    """Pages with their tables, by the parser that finds them."""
    import io

    import pdfplumber

    with pdfplumber.open(io.BytesIO(content)) as pdf:
        return [(p.extract_text() or "", p.extract_tables() or []) for p in pdf.pages]


def plain_pages(content: bytes) -> list:
    """Pages without tables."""
    import io

    from PyPDF2 import PdfReader

    return [p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages]


#: Tried in order; a parser that isn't installed, fails or finds no page gives way to the next.
PARSERS: tuple[tuple[str, PdfParser], ...] = (("pdfplumber", tabled_pages), ("pypdf2", plain_pages))


def parse_first(content: bytes, parsers: tuple[tuple[str, PdfParser], ...] = PARSERS) -> tuple[str | None, list, str | None]:
    """The first parser's name and pages; if none has any, the errors."""
    errors = []
    for name, parser in parsers:
        try:
            if pages := parser(content):
                return name, pages, None
        except Exception as e:  # one broken document must not end the job; its error is kept
            errors.append(f"{name}: {type(e).__name__}: {e}")
    return None, [], "; ".join(errors) or "no pages"


def installed_pdf_parser() -> PdfParser:
    """The parsers that are there, as one plug-in."""

    def parse(content: bytes) -> list:
        _, pages, error = parse_first(content)
        if error:
            raise ValueError(error)
        return pages

    return parse


def table_text(rows: list) -> str:
    """A table's rows of cells as a pipe table with a separator after its first row."""
    lines = ["| " + " | ".join(str(c if c is not None else "").replace("\n", " ").strip() for c in row) + " |" for row in rows]
    return "\n".join([lines[0], "| " + " | ".join("---" for _ in rows[0]) + " |", *lines[1:]]) if lines else ""


def parse_pdf(content: Column | str, parser: Callable[[], PdfParser] = installed_pdf_parser) -> Column:
    """struct (texts, tables, error): page texts and markdown tables by a plug-in; a document that fails has its error."""

    @F.pandas_udf("struct<texts: array<string>, tables: array<array<string>>, error: string>")
    def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        loaded = parser()
        for contents in batches:
            rows = []
            for c in contents:
                _, pages, error = parse_first(bytes(c), (("parser", loaded),))
                pages, error = [p if isinstance(p, tuple) else (p, []) for p in pages], error and error.removeprefix("parser: ")
                rows.append(([t for t, _ in pages], [[x for x in map(table_text, own) if x] for _, own in pages], error))
            yield pd.DataFrame(rows, columns=["texts", "tables", "error"])

    return parsed(content)


def read_documents(spark: SparkSession, folder: str, pdf_parser: Callable[[], PdfParser] | None = None) -> DataFrame:
    """doc_name, doc_type, text, pages, error of a folder's documents; PDF files need a parser."""
    files = scan(spark, folder)
    none = F.lit(None).cast(f"array<{PAGE}>")
    plain = files.where("doc_type = '.txt'").select("doc_name", "doc_type", decode("content").alias("text"), none.alias("pages"), F.lit(None).cast("string").alias("error"))
    objects = files.where("doc_type = '.json'").select("doc_name", "doc_type", text_of_json(decode("content")).alias("text"), none.alias("pages"), F.lit(None).cast("string").alias("error"))
    pdfs = files.where("doc_type = '.pdf'")
    if pdf_parser is None:
        paged = pdfs.select("doc_name", "doc_type", F.lit("").alias("text"), none.alias("pages"), F.lit("no PDF parser given").alias("error"))
    else:
        held = pdfs.select("doc_name", "doc_type", parse_pdf("content", pdf_parser).alias("p")).select("doc_name", "doc_type", pages_of_texts(F.col("p.texts"), F.col("doc_name"), "plugin", F.col("p.tables")).alias("pages"), F.col("p.error").alias("error"))
        paged = held.select("doc_name", "doc_type", text_of_pages(F.col("pages")).alias("text"), "pages", "error")
    return plain.unionByName(objects).unionByName(paged)
