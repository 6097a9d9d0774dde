"""Text functions as Spark columns: cleaning, sentences, tokens, headings.

Python's str patterns know Unicode classes and break lines only at LF; the JVM does so under (?Ud), which the patterns
here carry where it matters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.constants import HEADING_WORDS, TOKEN

MARK = "\x01"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once; a lambda would compute an outer expression again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column | str) -> Column:
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def collapse(c: Column | str) -> Column:
    """Runs of white space become one space, ends are stripped."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def fix_encoding(c: Column | str) -> Column:
    curly = "".join(map(chr, (0x2018, 0x2019, 0x201C, 0x201D, 0x2013, 0x2014, 0xA0, 0x200B)))
    # the last one has no counterpart and is deleted
    return F.replace(F.translate(c, curly, "''\"\"-- "), F.lit(chr(0x2026)), F.lit("..."))


def remove_control_chars(c: Column | str) -> Column:
    """Without characters of the Unicode categories C*, line feeds, tabs and returns excepted."""
    return F.regexp_replace(c, r"[\p{C}&&[^\n\t\r]]", "")


def _nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def nfkc(c: Column | str) -> Column:
    return F.pandas_udf(_nfkc, "string")(c)


def fix_hyphenation(c: Column | str) -> Column:
    return F.regexp_replace(c, r"(?U)(\w)-\s*\n\s*(\w)", "$1$2")


def normalize_whitespace(c: Column | str) -> Column:
    spaced = F.regexp_replace(F.replace(c, F.lit("\t"), F.lit("    ")), r"(?U)[^\S\n]+", " ")
    return F.regexp_replace(spaced, r"\n{3,}", "\n\n")


def remove_repeated_lines(c: Column | str, most: int = 3, shorter: int = 100) -> Column:
    """Without the lines that occur more than `most` times and are short; blank lines stay.

    A sorted array holds a line more than `most` times if it equals the one `most` places on: n log n, no shuffle.
    """
    c = F.col(c) if isinstance(c, str) else c

    def kept(lines: Column) -> Column:
        short = F.array_sort(F.filter(F.transform(lines, strip), lambda s: (s != "") & (F.length(s) < shorter)))
        return let(short, lambda found: let(often(found), lambda many: F.when(F.size(many) == 0, lines).otherwise(F.filter(lines, lambda s: ~F.array_contains(many, strip(s))))))

    def often(short: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(short) - most, F.lit(1))), lambda i: i <= F.size(short) - most)
        return F.array_distinct(F.filter(F.transform(places, lambda i: F.when(F.element_at(short, i) == F.element_at(short, i + most), F.element_at(short, i))), lambda s: s.isNotNull()))

    return let(F.split(c, "\n", -1), lambda lines: F.array_join(kept(lines), "\n"))


def clean(c: Column | str, normal_form: bool = True) -> Column:
    """All cleaning steps in order; null becomes empty. Form feeds are control characters and gone before any OCR step."""
    fixed = remove_control_chars(fix_encoding(F.coalesce(c, F.lit(""))))
    fixed = nfkc(fixed) if normal_form else fixed
    return strip(remove_repeated_lines(normalize_whitespace(fix_hyphenation(fixed))))


def clean_pdf_noise(c: Column | str) -> Column:
    """Without header and footer lines, page numbers and watermarks; a footer takes the line up to its number."""
    t = F.regexp_replace(c, r"(?imdu)^(page\s*\d+|confidential|draft|privileged|©.*\d{4}).*$", "")
    t = F.regexp_replace(t, r"(?imdu)^.*?(page\s*\d+\s*of\s*\d+|\d+\s*$)", "")
    t = F.regexp_replace(t, r"(?md)^\s*\d{1,4}\s*$", "")
    t = F.regexp_replace(t, r"(?iu)(CONFIDENTIAL|DRAFT|PRIVILEGED)\s*", "")
    return strip(F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r" {2,}", " "))


def annotate_sections(c: Column | str) -> Column:
    """Section references become headings, unless the two characters before them start, stripped, with #."""
    return F.regexp_replace(c, rf"(?iuU)(?<!#[\s\S])(?<!\s#)(?<!\A#)\b({HEADING_WORDS})\s*[\d\.]+", "\n## $0\n")


def section_titles(c: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"(?md)^(#{1,6})\s+(.+)$"), F.lit(2)), strip)


def has_tables(c: Column | str) -> Column:
    return F.regexp_like(c, F.lit(r"(?md)^\|.+\|$"))


def table_markdown(rows: Column | str) -> Column:
    """array<array<string>> as a pipe table with a separator after its first row."""
    cell = lambda x: strip(F.replace(F.coalesce(x, F.lit("")), F.lit("\n"), F.lit(" ")))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    rows = F.col(rows) if isinstance(rows, str) else rows
    made = F.transform(rows, lambda r, i: F.when(i == 0, F.concat(line(F.transform(r, cell)), F.lit("\n"), line(F.transform(r, lambda _: F.lit("---"))))).otherwise(line(F.transform(r, cell))))
    return F.when(F.size(rows) > 0, F.array_join(made, "\n"))


def split_headings(c: Column | str) -> Column:
    """Markdown parts from one first- to third-level heading to the next, stripped, empty ones dropped."""
    return F.filter(F.transform(F.split(c, r"(?md)(?=^#{1,3} )"), strip), lambda p: p != "")


def preview(c: Column | str, limit: int = 240) -> Column:
    short = collapse(c)
    return F.when(F.length(short) <= limit, short).otherwise(F.concat(F.regexp_replace(F.substring(short, 1, limit - 3), r"(?U)\s+\z", ""), F.lit("...")))


def sentences(c: Column | str) -> Column:
    """Pieces that end in . ! or ? before white space, stripped, empty ones dropped."""
    marked = F.regexp_replace(c, r"(?U)([.!?])\s+", f"$1{MARK}")
    return F.filter(F.transform(F.split(marked, MARK), strip), lambda s: s != "")


def clean_sentence(c: Column | str) -> Column:
    bare = F.regexp_replace(F.regexp_replace(strip(c), r"(?U)^\d+\.\s*", ""), r"(?U)\s+", " ")
    return F.regexp_replace(bare, r"\A[ -]+|[ -]+\z", "")


def answer_sentences(c: Column | str) -> Column:
    return F.filter(F.transform(sentences(collapse(c)), clean_sentence), lambda s: s != "")


def tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def run_lengths(terms: Column) -> Column:
    """array of (term, tf): how often each term is in an array, by sorting it: n log n, no shuffle."""

    def counted(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.element_at(s, i) != F.element_at(s, F.greatest(i - 1, F.lit(1)))))
        ends = lambda at: F.transform(at, lambda p, k: F.struct(F.element_at(s, p).alias("term"), (F.coalesce(F.try_element_at(at, (k + 2).cast("int")), F.size(s) + 1) - p).cast("long").alias("tf")))
        return let(starts, ends)

    return F.when(F.size(terms) > 0, let(F.array_sort(terms), counted))


def word_set(c: Column | str) -> Column:
    """Distinct white-space separated words, lower-cased."""
    return F.array_distinct(words(c))


def words(c: Column | str) -> Column:
    return F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda w: w != "")


def key(c: Column | str) -> Column:
    return F.lower(strip(c))


def suffix(name: Column | str) -> Column:
    found = F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1))
    return F.when(found != "", found).otherwise(F.lit("unknown"))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def contains_any(c: Column, markers: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(c, F.lit(m))
    return out


def round4(c: Column) -> Column:
    """Four decimals, halves up, the same in every engine for values that aren't negative."""
    return F.floor(c * 10000 + 0.5) / 10000


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))
