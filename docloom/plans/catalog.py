"""The engine's queries over the fixture tables, and the DuckDB SQL of each that SQL can express.

The fixtures hold no legal text, so entity queries run over documents under a legal template (LEGAL), one expression
that both engines read. Benchmark items are the questions, and a document that holds an item verbatim is relevant to it.
Every query takes whole tables and whole texts; k is the only limit, where top-k is the operator.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions.arrow import with_python
from docloom.functions.constants import CLAIM_STOP_WORDS, ENTITY_PATTERNS, LEGEND, NO_CONTEXT, QUERY_STOP_WORDS, SECTION_PATTERNS, WEAK_SUPPORT
from docloom.operators import answer, chunking, corpus, entities, evaluate, explain, index, lexical, retrieval, vectors
from docloom.schema import CHUNK
from docloom.session import materialize, shared_dir
from docloom.sources import files, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHARED: dict[tuple, DataFrame] = {}


def shared(spark: SparkSession, source: DataFrame, what: str, build: Callable[[], DataFrame], files: int = 1000) -> DataFrame:
    """What build makes of source, written once per application and state of source's files, for all queries that read it.

    Sources of more files are not told apart cheaply; what is made of them is written for each query.
    """
    found = source.inputFiles()
    if len(found) > files:
        return materialize(build(), what)
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()

    def status(file: str):
        path = hadoop.Path(file)
        s = path.getFileSystem(conf).getFileStatus(path)
        return file, s.getLen(), s.getModificationTime()

    def there(df: DataFrame) -> bool:
        return all(hadoop.Path(f).getFileSystem(conf).exists(hadoop.Path(f)) for f in df.inputFiles()[:1])

    key = (spark.sparkContext.applicationId, what, *sorted(map(status, found)))
    if key not in _SHARED or not there(_SHARED[key]):
        _SHARED[key] = materialize(build(), what)
    return _SHARED[key]


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where it would be read in fewer parts than there are cores: one small file would be one task's
    work. Tables that are read in as many parts stay as they are.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df._jdf.rdd().getNumPartitions() < n else df


# --- text -----------------------------------------------------------------------------------------------------------

LEGAL = (
    "concat('SECTION ', doc_id % 500 + 1, '. Title', chr(10), text, ' under Section ', doc_id % 500 + 1, ' of the Indian Penal Code. "
    "The Supreme Court of India granted bail on 12/03/', 2000 + doc_id % 20, '. See Article ', doc_id % 30 + 1, ' of the Constitution of India and the Evidence Act, 1872. "
    "Justice R. Lodha held in Ram Kumar v. State Board (1999) that the accused pays a fine of Rs. ', doc_id % 9 + 1, '00. AIR 1973 SC 1461.')"
)
PAGED = "concat('Page 1 of 9', chr(10), 'CONFIDENTIAL copy', chr(10), '# Heading ', doc_id, chr(10), text, chr(10), '## Second part', chr(10), '| a | b |', chr(10), 'convicted under Section ', doc_id % 500 + 1, chr(10), ' 17 ', chr(10), 'end')"


def documents(spark: SparkSession, sf_dir: str, expr: str = "text") -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.expr(expr).alias("text"))


def _digest(rows: DataFrame, made) -> DataFrame:
    """doc_id, n_chars, digest of a text function over all documents."""
    out = rows.select("doc_id", made.alias("t"))
    return out.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"))


def _digest_sql(source: str, made: str) -> str:
    return f"WITH d AS (SELECT doc_id, {source} AS t FROM documents), m AS (SELECT doc_id, {made} AS t FROM d) SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM m"


_ODD = "concat(chr(8220), text, chr(8221), chr(8230), chr(160), chr(8211), chr(8203), chr(7))"
_FIXED = "replace(translate(replace(t, chr(8203), ''), concat(chr(8216), chr(8217), chr(8220), chr(8221), chr(8211), chr(8212), chr(160)), concat(chr(39), chr(39), '\"\"-- ')), chr(8230), '...')"
_PLAIN = r"regexp_replace({t}, '[^\P{{C}}\n\t\r]', '', 'g')"
_JOINED = r"regexp_replace({t}, '([\pL\pN_])-\s*\n\s*([\pL\pN_])', '\1\2', 'g')"
_SPACED = r"regexp_replace(regexp_replace(replace({t}, chr(9), '    '), '[^\S\n]+', ' ', 'g'), '\n{{3,}}', concat(chr(10), chr(10)), 'g')"
_TRIM = "trim({t}, concat(' ', chr(10), chr(9), chr(13)))"
_REPEATED = "array_to_string(list_filter(string_split({t}, chr(10)), lambda l: NOT (length(trim(l)) > 0 AND length(trim(l)) < 100 AND len(list_filter(string_split({t}, chr(10)), lambda m: trim(m) = trim(l))) > 3)), chr(10))"


def _spark(expr: str) -> str:
    """chr of code points beyond 255 for Spark SQL, whose chr has one byte."""
    import re

    return re.sub(r"chr\((\d+)\)", lambda m: f"decode(encode('{chr(int(m[1]))}', 'UTF-8'), 'UTF-8')" if int(m[1]) > 127 else m[0], expr)


@query(_digest_sql(_ODD, _FIXED))
def text_fix_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(documents(spark, sf_dir, _spark(_ODD)), T.fix_encoding("text"))


@query(_digest_sql(_ODD, _PLAIN.format(t="t")))
def text_control_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(documents(spark, sf_dir, _spark(_ODD)), T.remove_control_chars("text"))


_BROKEN = "replace(text, 'th', concat('t-', chr(10), ' h'))"


@query(_digest_sql(_BROKEN, _JOINED.format(t="t")))
def text_hyphenation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(documents(spark, sf_dir, _BROKEN), T.fix_hyphenation("text"))


_WIDE = "replace(replace(text, ' ', concat(chr(9), ' ')), chr(10), concat(chr(10), chr(10), chr(10), chr(10)))"


@query(_digest_sql(_WIDE, _SPACED.format(t="t")))
def text_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(documents(spark, sf_dir, _WIDE), T.normalize_whitespace("text"))


@query(_digest_sql("text", _REPEATED.format(t="t")))
def text_remove_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(documents(spark, sf_dir), T.remove_repeated_lines("text"))


_DIRTY = "concat(text, chr(10), 'pre-', chr(10), ' trial', chr(9), 'x', chr(10), 'same', chr(10), 'same', chr(10), 'same', chr(10), 'same ')"


@query(
    f"WITH d AS (SELECT doc_id, {_DIRTY} AS t FROM documents), a AS (SELECT doc_id, {_PLAIN.format(t=_FIXED)} AS t FROM d), "
    f"b AS (SELECT doc_id, {_JOINED.format(t='t')} AS t FROM a), c AS (SELECT doc_id, {_SPACED.format(t='t')} AS t FROM b), "
    f"e AS (SELECT doc_id, {_TRIM.format(t=_REPEATED.format(t='t'))} AS t FROM c) SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM e"
)
def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(documents(spark, sf_dir, _DIRTY), T.clean("text"))


_COLLAPSED = r"trim(regexp_replace({t}, '\s+', ' ', 'g'))"


@query(f"WITH c AS (SELECT doc_id, {_COLLAPSED.format(t='text')} AS t FROM documents) SELECT doc_id, CASE WHEN length(t) <= 240 THEN t ELSE concat(rtrim(substr(t, 1, 237)), '...') END AS preview FROM c")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.preview("text").alias("preview"))


_COMPATIBLE = f"concat('{chr(0xFB01)}{chr(0xFF21)}{chr(0x2460)}', text, '{chr(0xB2)}{chr(0xFF76)}{chr(0xFF9E)}')"


@query(f"WITH m AS (SELECT doc_id, concat('fiA1', text, '2{chr(0x30AC)}') AS t FROM documents) SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM m")
def text_nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(documents(spark, sf_dir, _COMPATIBLE), T.nfkc("text"))


_TOKENS = r"regexp_extract_all(lower({t}), '[a-z0-9][a-z0-9\.\-/]*')"


@query(f"WITH t AS (SELECT doc_id, {_TOKENS.format(t='text')} AS w FROM documents) SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct, md5(array_to_string(w, ' ')) AS digest FROM t")
def tokenize_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", T.tokens("text").alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), F.md5(F.array_join("w", " ")).alias("digest"))


_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower({t}), '\s+'), lambda w: w <> ''))"


@query(f"SELECT doc_id, len({_WORDS.format(t='text')}) AS n_words, md5(array_to_string(list_sort({_WORDS.format(t='text')}), ' ')) AS digest FROM documents")
def word_set_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", T.word_set("text").alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n_words"), F.md5(F.array_join(F.array_sort("w"), " ")).alias("digest"))


_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace({t}, '([.!?])\s+', concat('\1', chr(1)), 'g'), chr(1)), lambda s: trim(s, concat(' ', chr(10)))), lambda s: s <> '')"


@query(f"WITH s AS (SELECT doc_id, {_SENTENCES.format(t='text')} AS s FROM documents) SELECT doc_id, len(s) AS n_sentences, md5(array_to_string(s, '|')) AS digest FROM s")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", T.sentences("text").alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.md5(F.array_join("s", "|")).alias("digest"))


_CLEAN_SENTENCE = r"trim(regexp_replace(regexp_replace(trim({t}), '^\d+\.\s*', ''), '\s+', ' ', 'g'), ' -')"
_ANSWER_SENTENCES = f"list_filter(list_transform({_SENTENCES.format(t=_COLLAPSED)}, lambda s: {_CLEAN_SENTENCE.format(t='s')}), lambda s: s <> '')"


@query(f"WITH s AS (SELECT doc_id, {_ANSWER_SENTENCES.format(t='text')} AS s FROM documents) SELECT doc_id, len(s) AS n_sentences, md5(array_to_string(s, '|')) AS digest FROM s")
def answer_sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", T.answer_sentences("text").alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.md5(F.array_join("s", "|")).alias("digest"))


_NOISE = (
    r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({t}, '(?im)^(page\s*\d+|confidential|draft|privileged|©.*\d{{4}}).*$', '', 'g'), "
    r"'(?im)^.*?(page\s*\d+\s*of\s*\d+|\d+\s*$)', '', 'g'), '(?m)^\s*\d{{1,4}}\s*$', '', 'g'), '(?i)(CONFIDENTIAL|DRAFT|PRIVILEGED)\s*', '', 'g'), '\n{{3,}}', concat(chr(10), chr(10)), 'g'), ' {{2,}}', ' ', 'g'), concat(' ', chr(10)))"
)


@query(_digest_sql(PAGED, _NOISE.format(t="t")))
def pdf_noise_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(documents(spark, sf_dir, PAGED), T.clean_pdf_noise("text"))


@query(_digest_sql(LEGAL, r"regexp_replace(t, '(?i)\b(section|clause|article|paragraph|schedule|annexure|exhibit)\s*[\d\.]+', concat(chr(10), '## \0', chr(10)), 'g')"))
def annotate_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(documents(spark, sf_dir, LEGAL), T.annotate_sections("text"))


@query(
    rf"WITH d AS (SELECT doc_id, {PAGED} AS t FROM documents), p AS (SELECT doc_id, t, list_filter(list_transform(string_split(regexp_replace(t, '(?m)^(#{{1,3}} )', concat(chr(1), '\1'), 'g'), chr(1)), lambda x: trim(x, concat(' ', chr(10)))), lambda x: x <> '') AS parts FROM d) "
    r"SELECT doc_id, len(parts) AS n_parts, md5(array_to_string(parts, '|')) AS digest, array_to_string(list_transform(regexp_extract_all(t, '(?m)^(#{1,6})\s+(.+)$', 2), lambda x: trim(x)), '|') AS titles, regexp_matches(t, '(?m)^\|.+\|$') AS has_tables FROM p"
)
def markdown_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, PAGED).withColumn("parts", T.split_headings("text"))
    return rows.select("doc_id", F.size("parts").cast("long").alias("n_parts"), F.md5(F.array_join("parts", "|")).alias("digest"), F.array_join(T.section_titles("text"), "|").alias("titles"), T.has_tables("text").alias("has_tables"))


@query("SELECT l_orderkey AS id, concat('| a | b |', chr(10), '| --- | --- |', chr(10), '| ', l_returnflag, ' | ', l_linestatus, ' |') AS markdown FROM lineitem")
def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array(F.array(F.lit("a"), F.lit("b")), F.array("l_returnflag", F.concat(F.lit("\n"), "l_linestatus")))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), T.table_markdown(rows).alias("markdown"))


# --- chunks ---------------------------------------------------------------------------------------------------------

_CUT = "trim(substr(t, s + 1, 1000), concat(' ', chr(10)))"


@query(
    f"WITH w AS (SELECT doc_id, text AS t, unnest(range(0, length(text), 800)) AS s FROM documents WHERE length(text) > 0), c AS (SELECT doc_id, s, {_CUT} AS c FROM w) "
    "SELECT doc_id, s AS start, length(c) AS n_chars, md5(c) AS digest FROM c WHERE length(c) >= 150"
)
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    made = chunking.windows(F.col("text"), none, none, F.lit(0), chunking.DEFAULTS)
    rows = documents(spark, sf_dir).select("doc_id", F.explode(made).alias("c"))
    return rows.select("doc_id", F.col("c.start").cast("long").alias("start"), F.length("c.text").cast("long").alias("n_chars"), F.md5("c.text").alias("digest"))


_SPREAD = "replace(text, chr(10), concat(chr(10), chr(10)))"
_PACKED = (
    f"WITH d AS (SELECT doc_id, trim({_SPREAD}, concat(' ', chr(10))) AS t FROM documents), "
    r"p AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(t, '(\S)\n\s*\n', concat('\1', chr(1)), 'g'), chr(1)), lambda x: trim(x, concat(' ', chr(10)))), lambda x: x <> '') AS ps FROM d WHERE t <> ''), "
    "n AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM p), "
)


@query(
    "WITH RECURSIVE " + _PACKED[5:] + "f AS (SELECT doc_id, 1 AS i, p AS cur, CAST(NULL AS VARCHAR) AS flushed FROM n WHERE i = 1 UNION ALL "
    "SELECT f.doc_id, n.i, CASE WHEN length(f.cur) + 2 + length(n.p) > 1000 THEN concat(right(f.cur, 200), chr(10), chr(10), n.p) ELSE concat(f.cur, chr(10), chr(10), n.p) END, "
    "CASE WHEN length(f.cur) + 2 + length(n.p) > 1000 THEN f.cur END FROM f JOIN n ON n.doc_id = f.doc_id AND n.i = f.i + 1), "
    "e AS (SELECT doc_id, i, flushed AS c FROM f WHERE flushed IS NOT NULL UNION ALL SELECT doc_id, i + 1, cur FROM (SELECT doc_id, i, cur, row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) AS r FROM f) WHERE r = 1), "
    "k AS (SELECT doc_id, i, c FROM e WHERE length(c) >= 150), o AS (SELECT doc_id, c, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, count(*) OVER (PARTITION BY doc_id) AS total_chunks FROM k) "
    "SELECT doc_id, chunk_index, total_chunks, substr(md5(concat(doc_id, '_', chunk_index)), 1, 12) AS chunk_id, length(c) AS n_chars, md5(c) AS digest FROM o"
)
def chunk_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, _SPREAD).select("doc_id", T.strip("text").alias("text"))
    made = with_python(docs, "text", chunking.chunk_paragraphs, f"array<{CHUNK}>", "cs")
    rows = made.select("doc_id", F.size("cs").cast("long").alias("total_chunks"), F.posexplode("cs").alias("i", "c"))
    return rows.select("doc_id", F.col("i").cast("long").alias("chunk_index"), "total_chunks", chunking.chunk_id(F.col("doc_id"), F.col("i")).alias("chunk_id"), F.length("c.text").cast("long").alias("n_chars"), F.md5("c.text").alias("digest"))


_SECTIONED = "concat('SECTION ', doc_id % 500 + 1, '. Title', chr(10), text, chr(10), 'Article 21. Life', chr(10), text, chr(10), '1. Short title', chr(10), text)"



def _found_sql(source: str, parts: list[tuple[str, str]]) -> str:
    """f: doc_id, t, j (the pattern's number), label, raw, start of all matches of (label, pattern), by split texts."""
    marked = lambda p: "string_split(regexp_replace(t, '" + p.replace("'", "''") + r"', concat(chr(2), '\0', chr(3)), 'g'), chr(2))"
    each = " UNION ALL ".join(f"SELECT doc_id, {j} AS j, '{label}' AS label, unnest({marked(p)}) AS piece, generate_subscripts({marked(p)}, 1) AS i FROM d0" for j, (label, p) in enumerate(parts))
    return (
        f"d0 AS (SELECT doc_id, {source} AS t FROM documents), z AS ({each}), zz AS (SELECT *, length(replace(piece, chr(3), '')) AS n FROM z), "
        "f AS (SELECT doc_id, j, label, split_part(piece, chr(3), 1) AS raw, sum(n) OVER (PARTITION BY doc_id, j ORDER BY i) - n AS start, i FROM zz QUALIFY i > 1)"
    )


_BLANK = "concat(' ', chr(10), chr(9), chr(13))"


def _sections_sql() -> str:
    """sc: doc_id, type, number, title, start, end, pos of the headings of _SECTIONED."""
    found = _found_sql(_SECTIONED, [(str(j), "(?m)" + p) for j, p in enumerate(SECTION_PATTERNS)])
    group = lambda k: "CASE j " + " ".join("WHEN {} THEN regexp_extract(raw, '{}', {})".format(j, p.replace("'", "''"), k) for j, p in enumerate(SECTION_PATTERNS)) + " END"
    return (
        f"WITH {found}, g AS (SELECT doc_id, j, raw, start, start + length(raw) AS end_, upper(trim({group(1)}, {_BLANK})) AS type, trim({group(2)}, {_BLANK}) AS title FROM f), "
        f"u AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY doc_id, start, end_, lower(trim(raw, {_BLANK})) ORDER BY j) = 1), "
        r"sc AS (SELECT doc_id, type, regexp_extract(title, '^\S+') AS number, title, start, end_, row_number() OVER (PARTITION BY doc_id ORDER BY start, j) - 1 AS pos FROM u)"
    )


@query(
    f"{_sections_sql()}, n AS (SELECT doc_id, type, number, start, pos, lead(start) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM sc), "
    f"b AS (SELECT doc_id, pos, type, number, start, trim(substr(t, start::BIGINT + 1, coalesce(next, length(t))::BIGINT - start::BIGINT), {_BLANK}) AS c FROM n JOIN d0 USING (doc_id)), k AS (SELECT * FROM b WHERE length(c) >= 150), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS chunk_index, count(*) OVER (PARTITION BY doc_id) AS total_chunks FROM k) "
    "SELECT substr(md5(concat(doc_id, '_', chunk_index)), 1, 12) AS chunk_id, CAST(doc_id AS VARCHAR) AS doc_name, chunk_index, total_chunks, type AS section, number AS section_num, CAST(start AS BIGINT) AS char_start, md5(c) AS digest FROM o"
)
def chunk_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.chunk_documents(documents(spark, sf_dir, _SECTIONED).withColumn("doc_name", F.col("doc_id").cast("string")))
    long_ = lambda c: F.col(c).cast("long").alias(c)
    return rows.select("chunk_id", "doc_name", long_("chunk_index"), long_("total_chunks"), "section", "section_num", long_("char_start"), F.md5("text").alias("digest"))


@query(f'{_sections_sql()} SELECT doc_id, pos, type, number, title, CAST(start AS BIGINT) AS start, CAST(end_ AS BIGINT) AS "end" FROM sc')
def detect_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, _SECTIONED).select("doc_id", F.posexplode(chunking.detect_sections("text")).alias("pos", "s"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "s.type", "s.number", "s.title", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


@query("SELECT doc_id, o AS \"offset\", CASE WHEN length(text) >= o OR length(text) + 2 + 7 < o THEN CASE WHEN length(text) >= o THEN 1 ELSE 4 END ELSE 4 END AS page_num FROM documents, (VALUES (0), (500), (100000)) AS v(o)")
def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets in documents of two pages, the text and seven characters more; pages are numbered 1 and 4."""
    pages = F.array(F.struct(F.lit(1).alias("page_num"), F.col("text")), F.struct(F.lit(4).alias("page_num"), F.lit("the end").alias("text")))
    rows = documents(spark, sf_dir).select("doc_id", "text", F.explode(F.array(F.lit(0), F.lit(500), F.lit(100000))).alias("offset"))
    return rows.select("doc_id", "offset", chunking.page_number(F.col("offset"), pages).alias("page_num"))


# --- entities -------------------------------------------------------------------------------------------------------


def _matches_sql() -> str:
    """doc_id, label, text of all matches over the legal texts."""
    parts = []
    for label, pattern, fold in ENTITY_PATTERNS:
        p = (("(?i)" if fold else "") + pattern).replace("'", "''")
        parts.append(f"SELECT doc_id, '{label}' AS label, trim(unnest(regexp_extract_all(t, '{p}')), concat(' ', chr(10))) AS text FROM d")
    return f"WITH d AS (SELECT doc_id, {LEGAL} AS t FROM documents), m AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE length(text) >= 2)"


_M = _matches_sql()


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id (the document's), label, text, pos of the legal texts, by expressions alone."""
    made = lambda: entities.matches(documents(spark, sf_dir, LEGAL), "doc_id").withColumnRenamed("doc_id", "chunk_id")
    return shared(spark, table(spark, sf_dir, "documents"), "mentions", made)


@query(f"{_M} SELECT label, count(*) AS n_mentions, count(DISTINCT doc_id) AS n_docs FROM m GROUP BY label")
def ner_counts_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n_mentions"), F.countDistinct("chunk_id").alias("n_docs"))


@query(f"{_M} SELECT doc_id, label, text, count(*) AS n FROM m GROUP BY doc_id, label, text")
def ner_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through the span operator, offsets dropped."""
    rows = documents(spark, sf_dir, LEGAL).select("doc_id", F.explode(entities.extract_spans("text")).alias("e"))
    return rows.groupBy("doc_id", "e.label", "e.text").agg(F.count("*").alias("n"))


_SPANS = (
    f"WITH {_found_sql(LEGAL, [(label, ('(?i)' if fold else '') + p) for label, p, fold in ENTITY_PATTERNS])}, "
    f"sp AS (SELECT doc_id, label, trim(raw, {_BLANK}) AS text, start::BIGINT AS start, start::BIGINT + length(raw) AS end_, row_number() OVER (PARTITION BY doc_id ORDER BY start, -length(raw), j, i) - 1 AS pos FROM f WHERE length(trim(raw, {_BLANK})) >= 2)"
)


@query(f'{_SPANS} SELECT doc_id, pos, text, label, start, end_ AS "end", substr(t, greatest(start - 50, 0) + 1, end_ + 50 - greatest(start - 50, 0)) AS context FROM sp JOIN d0 USING (doc_id)')
def ner_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, LEGAL).select("doc_id", "text", F.posexplode(entities.extract_spans("text")).alias("pos", "e"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "e.text", "e.label", F.col("e.start").cast("long").alias("start"), F.col("e.end").cast("long").alias("end"), entities.with_context(F.col("text"), F.col("e.start"), F.col("e.end")).alias("context"))


@query(f"{_M} SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, label, lower(text) FROM m) GROUP BY doc_id")
def ner_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = entities.extract_spans("text")
    rows = documents(spark, sf_dir, LEGAL).select("doc_id", spans.alias("a"))
    return rows.select("doc_id", F.size(entities.merge(F.col("a"), F.col("a"))).cast("long").alias("n")).where("n > 0")


_ACT = r"trim(regexp_extract(text, '(?i)(?:of|under)\s+(?:the\s+)?(.+)', 1))"
_NUM = r"upper(regexp_extract(text, '(\d+[A-Za-z]?)', 1))"
_CANON = (
    f"CASE WHEN label = 'STATUTE' AND {_NUM} <> '' THEN trim(concat('SECTION_', {_NUM}, '_', {_ACT}), '_') WHEN label = 'PROVISION' AND {_NUM} <> '' THEN concat('ARTICLE_', {_NUM}) "
    r"WHEN label = 'COURT' AND contains(lower(text), 'supreme') THEN 'SUPREME_COURT_OF_INDIA' WHEN label = 'COURT' AND contains(lower(text), 'high court') THEN CASE WHEN regexp_extract(lower(text), 'high\s+court\s+of\s+(\w+)', 1) <> '' THEN concat('HIGH_COURT_', upper(regexp_extract(lower(text), 'high\s+court\s+of\s+(\w+)', 1))) ELSE 'HIGH_COURT' END "
    r"WHEN label = 'JUDGE' THEN concat('JUSTICE_', replace(upper(trim(replace(regexp_replace(text, '(?:Hon''?ble|Honourable|Chief)?\s*Justice\s*', '', 'g'), '.', ''))), ' ', '_')) ELSE replace(upper(text), ' ', '_') END"
)


@query(f"{_M} SELECT label, {_CANON} AS canonical, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM m GROUP BY 1, 2")
def ner_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mentions(spark, sf_dir).withColumn("canonical", entities.canonical(F.col("text"), F.col("label")))
    return rows.groupBy("label", "canonical").agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("n_docs"))


_KB_ROWS = f"{_M}, l AS (SELECT doc_id, label, text, {_CANON} AS canonical FROM m)"


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions(spark, sf_dir).select(F.col("chunk_id").alias("doc_name"), "label", "text", entities.canonical(F.col("text"), F.col("label")).alias("canonical"))


@query(f"{_KB_ROWS} SELECT canonical, count(*) AS mention_count, count(DISTINCT doc_id) AS n_docs, array_to_string(list_sort(list(DISTINCT text))[1:5], '|') AS mentions FROM l GROUP BY canonical")
def knowledge_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = entities.knowledge_base(_linked(spark, sf_dir))
    return base.select("canonical", "mention_count", "n_docs", F.array_join("mentions", "|").alias("mentions"))


@query(f"{_KB_ROWS} SELECT doc_id AS document, label, text, canonical, count(*) AS n FROM l GROUP BY ALL")
def entity_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    held = mentions(spark, sf_dir).select(F.col("chunk_id").alias("doc_name"), "label", "text", none.alias("section"), none.alias("section_num"), F.lit(None).cast("int").alias("page_num"))
    return entities.link(held).groupBy(F.col("linked_to.document").alias("document"), "label", "text", "canonical").agg(F.count("*").alias("n"))


@query(
    f"{_KB_ROWS}, s AS (SELECT DISTINCT canonical, doc_id FROM l), f AS (SELECT canonical, min(doc_id) AS d FROM s GROUP BY 1), "
    "p AS (SELECT DISTINCT a.canonical AS target, b.canonical FROM s a JOIN s b USING (doc_id) WHERE a.canonical <> b.canonical AND a.canonical LIKE 'ARTICLE%'), "
    "r AS (SELECT target, p.canonical, row_number() OVER (PARTITION BY target ORDER BY d, p.canonical) AS rank FROM p JOIN f USING (canonical)) SELECT target, canonical, rank FROM r WHERE rank <= 10"
)
def entity_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = _linked(spark, sf_dir)
    targets = linked.select("canonical").where("canonical LIKE 'ARTICLE%'").distinct()
    return entities.related(linked, targets).select("target", "canonical", F.col("rank").cast("long").alias("rank"))


_LABELLED = "SELECT * FROM (VALUES ('ORG', 'Supreme Court'), ('ORG', 'Acme Ltd'), ('PERSON', 'Justice R. Lodha'), ('PERSON', 'judge, X'), ('PERSON', 'Ann Lee'), ('LAW', 'Evidence Act'), ('GPE', 'India'), ('CARDINAL', '12'), ('NORP', 'Indian'), ('EVENT', 'Trial')) AS v(label, text)"


@query(
    f"WITH v AS ({_LABELLED}), r AS (SELECT n_nationkey AS id, label, text FROM nation, v) SELECT id, text, CASE WHEN label = 'ORG' AND (contains(lower(text), 'court') OR contains(lower(text), 'tribunal') OR contains(lower(text), 'bench') OR contains(lower(text), 'commission')) THEN 'COURT' "
    "WHEN label = 'PERSON' AND (lower(text) LIKE 'justice %' OR lower(text) LIKE 'judge %' OR split_part(replace(lower(text), ',', ' '), ' ', 1) IN ('justice', 'judge', 'cj', 'c.j.')) THEN 'JUDGE' WHEN label = 'LAW' THEN 'STATUTE' WHEN label = 'GPE' THEN 'LOCATION' WHEN label IN ('CARDINAL', 'ORDINAL', 'NORP', 'FAC', 'PRODUCT') THEN NULL ELSE label END AS mapped FROM r"
)
def ml_label_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id")).crossJoin(F.broadcast(spark.sql(_LABELLED)))
    return rows.select("id", "text", entities.model_label(F.col("label"), F.col("text")).alias("mapped"))


# --- entity index ---------------------------------------------------------------------------------------------------

_KEYED = f"{_M}, k AS (SELECT doc_id, label, text, lower(trim(text)) AS key FROM m), x AS (SELECT DISTINCT key, doc_id FROM k)"


@query(f"{_KEYED} SELECT key, count(*) AS n_chunks FROM x GROUP BY key")
def entity_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.postings(mentions(spark, sf_dir)).groupBy("key").agg(F.count("*").alias("n_chunks"))


@query(f"{_KEYED} SELECT 'total_entities' AS name, count(DISTINCT key) AS value FROM x UNION ALL SELECT 'total_postings', count(*) FROM x UNION ALL SELECT concat('label:', label), count(DISTINCT key) FROM k GROUP BY label")
def entity_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mentions(spark, sf_dir)
    return index.statistics(index.postings(m), index.labels(m))


@query(f"{_KEYED} SELECT DISTINCT label, key FROM k")
def entities_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.entities_by_label(index.labels(mentions(spark, sf_dir)))


@query(f"{_KEYED} SELECT 'total_entities' AS name, count(DISTINCT key) AS value FROM x UNION ALL SELECT 'total_postings', count(*) FROM x UNION ALL SELECT 'vector_store_size', count(*) FROM embeddings UNION ALL SELECT concat('label:', label), count(DISTINCT key) FROM k GROUP BY label")
def retrieval_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mentions(spark, sf_dir)
    return index.statistics(index.postings(m), index.labels(m), table(spark, sf_dir, "embeddings"))


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, table(spark, sf_dir, "documents"), "postings", lambda: index.postings(mentions(spark, sf_dir)))


_ASKED = "SELECT * FROM (VALUES (1, ' Supreme Court of India'), (1, 'bail'), (2, 'fine of Rs. 300'), (2, 'article 7 of the constitution of india'), (3, 'nothing of the kind')) AS v(query_id, entity)"


@query(f"{_KEYED} SELECT v.query_id, v.entity, x.doc_id AS chunk_id FROM x JOIN ({_ASKED}) v ON x.key = lower(trim(v.entity))")
def entity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.lookup(index.postings(mentions(spark, sf_dir)), spark.sql(_ASKED)).select("query_id", "entity", "chunk_id")


_SET = "list_distinct(string_split({t}, ' '))"
_FUZZY = (
    f"{_KEYED}, q AS (SELECT DISTINCT entity, lower(trim(entity)) AS w FROM ({_ASKED}) v), u AS (SELECT DISTINCT key FROM x), "
    f"z AS (SELECT entity, key, CASE WHEN key = w THEN 1.0::DOUBLE ELSE len(list_intersect({_SET.format(t='key')}, {_SET.format(t='w')}))::DOUBLE / len(list_distinct(list_concat({_SET.format(t='key')}, {_SET.format(t='w')}))) END AS similarity FROM q, u), h AS (SELECT entity, key, similarity FROM z WHERE similarity >= 0.7)"
)


@query(f"{_FUZZY} SELECT entity, key, doc_id AS chunk_id, round(similarity, 6) AS similarity FROM h JOIN x USING (key)")
def entity_lookup_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = index.lookup_fuzzy(_postings(spark, sf_dir), spark.sql(_ASKED))
    return rows.select("entity", "key", "chunk_id", F.round("similarity", 6).alias("similarity"))


@query(
    f"{_FUZZY}, s AS (SELECT v.query_id, doc_id, sum(similarity) AS total FROM ({_ASKED}) v JOIN h USING (entity) JOIN x USING (key) GROUP BY 1, 2), n AS (SELECT query_id, count(*) AS n FROM ({_ASKED}) v GROUP BY 1), "
    "r AS (SELECT query_id, doc_id, total, row_number() OVER (PARTITION BY query_id ORDER BY round(total, 9) DESC, doc_id) AS rank FROM s) SELECT query_id, doc_id AS chunk_id, round(total / n, 6) AS score, rank FROM r JOIN n USING (query_id) WHERE rank <= 10"
)
def entity_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = index.retrieve(_postings(spark, sf_dir), spark.sql(_ASKED))
    return rows.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


# --- vectors --------------------------------------------------------------------------------------------------------

_DOT = "list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE))"


def _corpus_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _asked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: vectors whose id is divisible by 20."""
    return _corpus_vectors(spark, sf_dir).where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")


_PAIRS = f"WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {_DOT} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)"
_TOP = "SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM {s}"


@query(f"{_PAIRS} SELECT query_id, count(*) AS n, round(max(score), 6) AS best, round(sum(score), 4) AS total FROM p GROUP BY query_id")
def vector_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.scores(_corpus_vectors(spark, sf_dir), _asked_vectors(spark, sf_dir))
    return rows.groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("best"), F.round(F.sum("score"), 4).alias("total"))


@query(f"{_PAIRS}, r AS ({_TOP.format(s='p')}) SELECT query_id, id, rank, round(score, 6) AS score FROM r WHERE rank <= 20")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.search(_corpus_vectors(spark, sf_dir), _asked_vectors(spark, sf_dir))
    return rows.select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query()
def vector_ivf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.CellIndex(_corpus_vectors(spark, sf_dir)).search(_asked_vectors(spark, sf_dir))
    return found.select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query("SELECT item_id, 384 AS dim, 1.0::DOUBLE AS norm FROM benchmark")
def vector_fallback_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select("item_id", vectors.embed_fallback("text").alias("v"))
    return rows.select("item_id", F.size("v").alias("dim"), F.round(vectors.dot(F.col("v"), F.col("v")), 4).alias("norm"))


# --- lexical and hybrid retrieval -----------------------------------------------------------------------------------


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _index(spark: SparkSession, sf_dir: str) -> lexical.Bm25Index:
    """The documents' index with its postings written once: they feed term weights and scores."""
    docs = documents(spark, sf_dir)
    terms = shared(spark, table(spark, sf_dir, "documents"), "terms", lambda: lexical.build(docs, "doc_id").postings)
    return lexical.of_postings(terms, lexical.document_count(table(spark, sf_dir, "documents")))


def _bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.scores(_index(spark, sf_dir), _questions(spark, sf_dir))


_BM25 = (
    f"t AS (SELECT doc_id, {_TOKENS.format(t='text')} AS w FROM documents), dl AS (SELECT doc_id, len(w) AS dl FROM t), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), "
    "tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM t) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, st), "
    "idf AS (SELECT term, CASE WHEN raw < 0 THEN (SELECT 0.25 * avg(raw) FROM raw) ELSE raw END AS idf FROM raw), "
    f"q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({_TOKENS.format(t='text')}) AS term FROM benchmark) GROUP BY 1, 2), "
    "bm AS (SELECT * FROM (SELECT query_id, doc_id AS id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN idf USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), st GROUP BY 1, 2) WHERE score > 0), "
    "nm AS (SELECT query_id, id, score, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0::DOUBLE ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS norm FROM bm WINDOW w AS (PARTITION BY query_id)), "
    f"bt AS ({_TOP.format(s='bm')})"
)


@query(f"WITH {_BM25} SELECT query_id, id, round(score, 6) AS score FROM bm")
def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir).select("query_id", "id", F.round("score", 6).alias("score"))


@query(f"WITH {_BM25} SELECT query_id, id, rank, round(score, 6) AS score FROM bt WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lexical.top_k(_bm25(spark, sf_dir), 10)
    return rows.select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"WITH {_BM25} SELECT query_id, id, round(norm, 6) AS norm FROM nm")
def minmax_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.normalized_scores(_bm25(spark, sf_dir)).select("query_id", "id", F.round("norm", 6).alias("norm"))


_INTENT = (
    "CASE WHEN contains(q, 'what is') OR contains(q, 'define') OR contains(q, 'meaning of') OR contains(q, 'definition') THEN 'definition' WHEN contains(q, 'section') THEN 'section' WHEN contains(q, 'why') OR contains(q, 'reason') THEN 'reasoning' "
    "WHEN contains(q, 'can') OR contains(q, 'when') OR contains(q, 'if') THEN 'condition' WHEN contains(q, 'how to') OR contains(q, 'procedure') OR contains(q, 'process') OR contains(q, 'steps') THEN 'procedure' "
    "WHEN contains(q, 'compare') OR contains(q, 'difference') OR contains(q, 'versus') OR contains(q, 'vs') THEN 'comparison' WHEN contains(q, 'case') OR contains(q, 'judgment') OR contains(q, 'ruling') OR contains(q, 'verdict') OR contains(q, 'held') THEN 'case_based' "
    "WHEN contains(q, 'who') OR contains(q, 'which court') OR contains(q, 'which judge') THEN 'factual' ELSE 'general' END"
)


@query(f"WITH c AS (SELECT conv_id, turn, lower(text) AS q FROM conversations) SELECT conv_id, turn, {_INTENT} AS intent FROM c")
def query_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", retrieval.intent(F.col("text")).alias("intent"))


_BONUS = "(CASE WHEN contains(lower(x), 'section') THEN 0.08::DOUBLE ELSE 0 END) + (CASE WHEN doc_id % 20 / 20.0::DOUBLE <= 0.15 THEN 0.03::DOUBLE ELSE 0 END) - (CASE WHEN contains(lower(x), 'prayer') THEN 0.08::DOUBLE ELSE 0 END)"


@query(f"WITH d AS (SELECT doc_id, {LEGAL} AS x FROM documents) SELECT doc_id, round({_BONUS}, 6) AS bonus FROM d")
def structure_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, LEGAL)
    bonus = retrieval.structure_bonus(F.col("text"), F.lit("section"), F.col("doc_id") % 20, F.lit(20))
    return rows.select("doc_id", F.round(bonus, 6).alias("bonus"))


@query(f"{_M}, e AS (SELECT doc_id, count(*) AS n FROM m WHERE len(list_intersect({_TOKENS.format(t='text')}, ['supreme', 'court', 'section'])) > 0 GROUP BY 1) SELECT doc_id, least(1.0::DOUBLE, 0.25 * coalesce(n, 0)) AS overlap FROM documents LEFT JOIN e USING (doc_id)")
def entity_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, LEGAL).select("doc_id", F.flatten(F.transform(entities.label_matches("text"), lambda m: m["texts"])).alias("es"))
    return rows.select("doc_id", retrieval.entity_overlap(F.lit("Supreme Court section"), F.col("es")).alias("overlap"))


# Vectors aren't keyed to documents: vector i stands for document i, and item i asks with vector i.
_DENSE = f"ds AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {_DOT} AS score FROM embeddings a JOIN benchmark ON a.vec_id = item_id, embeddings b JOIN documents ON b.vec_id = doc_id), dt AS ({_TOP.format(s='ds')})"
_HYBRID = (
    f"{_M}, {_BM25}, {_DENSE}, d6 AS (SELECT * FROM dt WHERE rank <= 60), dn AS (SELECT query_id, id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0::DOUBLE ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS semantic FROM d6 WINDOW w AS (PARTITION BY query_id)), "
    "ln AS (SELECT query_id, id, norm AS lexical, row_number() OVER (PARTITION BY query_id ORDER BY round(norm, 9) DESC, id) AS place FROM nm), "
    "cd AS (SELECT query_id, id, coalesce(semantic, 0) AS semantic, coalesce(lexical, 0) AS lexical FROM dn FULL JOIN ln USING (query_id, id) WHERE semantic IS NOT NULL OR place <= 40), "
    f"qn AS (SELECT query_id, qt, {_INTENT} AS intent FROM (SELECT item_id AS query_id, lower(text) AS q, {_TOKENS.format(t='text')} AS qt FROM benchmark)), "
    f"eo AS (SELECT cd.query_id, cd.id, least(1.0::DOUBLE, 0.25 * count(*)) AS overlap FROM cd JOIN qn ON cd.query_id = qn.query_id JOIN m ON m.doc_id = cd.id WHERE len(list_intersect({_TOKENS.format(t='m.text')}, qt)) > 0 GROUP BY 1, 2), "
    "cf AS (SELECT cd.query_id, cd.id, semantic, lexical, coalesce(overlap, 0) AS overlap, intent FROM cd JOIN qn ON cd.query_id = qn.query_id LEFT JOIN eo ON cd.query_id = eo.query_id AND cd.id = eo.id), "
    "hs AS (SELECT query_id, id, floor(least(greatest(0.7::DOUBLE * semantic + 0.2::DOUBLE * lexical + 0.08::DOUBLE * overlap + (CASE WHEN intent = 'section' AND contains(lower(text), 'section') THEN 0.08::DOUBLE ELSE 0 END) "
    "+ (CASE WHEN intent = 'definition' AND (contains(lower(text), 'means') OR contains(lower(text), 'refers to') OR contains(lower(text), 'includes')) THEN 0.06::DOUBLE ELSE 0 END) "
    "+ (CASE WHEN intent = 'condition' AND (contains(lower(text), 'provided that') OR contains(lower(text), 'subject to') OR contains(lower(text), 'shall')) THEN 0.06::DOUBLE ELSE 0 END) + (CASE WHEN id % 20 / 20.0::DOUBLE <= 0.15 THEN 0.03::DOUBLE ELSE 0 END) - (CASE WHEN contains(lower(text), 'prayer') THEN 0.08::DOUBLE ELSE 0 END), 0), 1) * 10000 + 0.5) / 10000 AS score FROM cf JOIN documents ON id = doc_id), "
    f"hr AS ({_TOP.format(s='hs')})"
)


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _corpus_vectors(spark, sf_dir)
    held = store.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), "id", "left_semi")
    asked = store.join(_questions(spark, sf_dir).select(F.col("query_id").alias("id")), "id", "left_semi").select(F.col("id").alias("query_id"), "vector")
    return vectors.search(held, asked, 60).drop("rank")


@query(f"{_HYBRID} SELECT query_id, id, rank, round(score, 4) AS score FROM hr WHERE rank <= 20")
def hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = mentions(spark, sf_dir).groupBy(F.col("chunk_id").alias("id")).agg(F.collect_list("text").alias("entity_texts"))
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", (F.col("doc_id") % 20).alias("chunk_index"), F.lit(20).alias("total_chunks")).join(named, "id")
    asked = _questions(spark, sf_dir).withColumn("intent", retrieval.intent(F.col("text")))
    rows = retrieval.hybrid(_dense(spark, sf_dir), _bm25(spark, sf_dir), chunks, asked)
    return rows.select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"))


def _ranked_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return vectors.best(_dense(spark, sf_dir), 20), lexical.top_k(_bm25(spark, sf_dir), 20)


_FUSED = f"WITH {_BM25}, {_DENSE}, u AS (SELECT query_id, id, 1.0::DOUBLE / (60 + rank) AS part, score FROM dt WHERE rank <= 20 UNION ALL SELECT query_id, id, 0.5::DOUBLE / (60 + rank), score FROM bt WHERE rank <= 20), fs AS (SELECT query_id, id, sum(part) AS score, max(score) AS original FROM u GROUP BY 1, 2)"


@query(f"{_FUSED}, r AS (SELECT query_id, id, score, original, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM fs) SELECT query_id, id, rank, round(score, 6) AS score, round(original, 6) AS original_score FROM r")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retrieval.fuse(list(_ranked_pair(spark, sf_dir)), weights=[1.0, 0.5])
    return rows.select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), F.round("original_score", 6).alias("original_score"))


@query(f"WITH {_BM25}, {_DENSE}, u AS (SELECT query_id, id, score FROM dt WHERE rank <= 20 UNION ALL SELECT query_id, id, score FROM bt WHERE rank <= 10), g AS (SELECT query_id, id, max(score) AS score FROM u GROUP BY 1, 2), r AS ({_TOP.format(s='g')}) SELECT query_id, id, rank, round(score, 6) AS score FROM r WHERE rank <= 20")
def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, other = _ranked_pair(spark, sf_dir)
    rows = retrieval.expanded(own.select("query_id", "id", "score").unionByName(other.where("rank <= 10").select("query_id", "id", "score")))
    return rows.select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"WITH {_BM25}, {_DENSE}, b AS (SELECT DISTINCT query_id FROM dt INTERSECT SELECT DISTINCT query_id FROM bt), u AS (SELECT query_id, id, 1.0::DOUBLE / (60 + rank) AS part FROM dt WHERE rank <= 20 UNION ALL SELECT query_id, id, 1.0::DOUBLE / (60 + rank) FROM bt WHERE rank <= 20), fs AS (SELECT query_id, id, sum(part) AS score FROM u JOIN b USING (query_id) GROUP BY 1, 2), r AS ({_TOP.format(s='fs')}), o AS (SELECT query_id, id, score, rank FROM dt WHERE rank <= 20 UNION ALL SELECT query_id, id, score, rank FROM bt WHERE rank <= 20) SELECT query_id, id, rank, round(score, 6) AS score FROM r WHERE rank <= 10 UNION ALL SELECT query_id, id, rank, round(score, 6) FROM o WHERE rank <= 10 AND query_id NOT IN (SELECT query_id FROM b)")
def search_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense, words = _ranked_pair(spark, sf_dir)
    rows = retrieval.combined(dense, words, top=10)
    return rows.select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"WITH {_BM25} SELECT query_id, id, rank, round(score, 6) AS score FROM bt WHERE rank <= 5")
def rerank_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retrieval.rerank(lexical.top_k(_bm25(spark, sf_dir), 20), 5)
    return rows.select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


_SPLIT = r"list_distinct(list_filter(regexp_split_to_array({t}, '\s+'), lambda w: w <> ''))"


@query(
    f"WITH {_BM25}, p AS (SELECT bt.query_id, bt.id, bt.score AS original, {_SPLIT.format(t='b.text')} AS qs, {_SPLIT.format(t='d.text')} AS ts FROM bt JOIN documents d ON bt.id = doc_id JOIN benchmark b ON bt.query_id = item_id WHERE rank <= 20), "
    f"s AS (SELECT query_id, id, original, len(list_intersect(qs, ts))::DOUBLE / greatest(len(qs), 1) AS score FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s) "
    "SELECT query_id, id, rank, round(score, 6) AS score, round(original, 6) AS original_score FROM r WHERE rank <= 5"
)
def rerank_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a plug-in scorer: the share of the question's characters that are in the text."""
    found = lexical.top_k(_bm25(spark, sf_dir), 20).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "id").join(_questions(spark, sf_dir).select("query_id", F.col("text").alias("question")), "query_id")

    def load():
        import pandas as pd

        return lambda qs, ts: pd.Series([len(set(q.split()) & set(t.split())) / max(len(set(q.split())), 1) for q, t in zip(qs, ts, strict=True)])

    return retrieval.rerank(found, 5, load).select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), F.round("original_score", 6).alias("original_score"))


_TOP3 = "SELECT query_id, list(norm ORDER BY rank) AS s FROM (SELECT query_id, norm, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM nm) WHERE rank <= 3 GROUP BY 1"
_ROUTE = f"WITH {_BM25}, s AS ({_TOP3}), c AS (SELECT query_id, floor(least(greatest((0.6::DOUBLE * s[1] + coalesce(0.3::DOUBLE * s[2], 0) + coalesce(0.1::DOUBLE * s[3], 0)) / (0.6::DOUBLE + (CASE WHEN len(s) > 1 THEN 0.3::DOUBLE ELSE 0 END) + (CASE WHEN len(s) > 2 THEN 0.1::DOUBLE ELSE 0 END)), 0), 1) * 10000 + 0.5) / 10000 AS confidence FROM s)"


def _route_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = lexical.top_k(lexical.normalized_scores(_bm25(spark, sf_dir)), 3)
    held = scaled.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "norm"))), lambda r: r["norm"]).alias("s"))
    return held.select("query_id", answer.route_confidence(F.col("s")).alias("confidence"))


@query(f"{_ROUTE} SELECT query_id, round(confidence, 4) AS confidence FROM c")
def router_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _route_rows(spark, sf_dir).select("query_id", F.round("confidence", 4).alias("confidence"))


@query(f"{_ROUTE} SELECT query_id, CASE WHEN confidence < 0.75 THEN 'web_search' ELSE 'local' END AS route, 'local' AS default_route FROM c")
def route_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("confidence")
    return _route_rows(spark, sf_dir).select("query_id", answer.route(c, True).alias("route"), answer.route(c).alias("default_route"))


# --- answers --------------------------------------------------------------------------------------------------------


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _questions(spark, sf_dir)
    return q.select("query_id", F.col("text").alias("question"), retrieval.intent(F.col("text")).alias("intent"), F.array().cast("array<string>").alias("entity_texts"))


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents of each item, with scaled scores, as passages."""
    top = lexical.top_k(lexical.normalized_scores(_bm25(spark, sf_dir)).drop("score").withColumnRenamed("norm", "score"), 5)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("doc_name"), "lang")
    spans = F.flatten(F.transform(entities.label_matches("text"), lambda m: F.transform(m["texts"], lambda t: F.struct(t.alias("text"), m["label"].alias("label")))))
    return top.join(docs, "id").select("query_id", "rank", F.col("id").cast("string").alias("chunk_id"), "text", "score", "doc_name", (F.col("id") % 7).cast("int").alias("page_num"), F.col("lang").alias("section"), F.lit("local").alias("source"), spans.alias("entities"))


_STOP = "[" + ", ".join(f"'{w}'" for w in QUERY_STOP_WORDS) + "]"
_ANSWER = (
    f"WITH {_BM25}, pr AS (SELECT query_id, id, norm AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(norm, 9) DESC, id) AS rank FROM nm), ps AS (SELECT query_id, id, score, rank, text, source AS doc_name, lang FROM pr JOIN documents ON id = doc_id WHERE rank <= 5), "
    f"sa AS (SELECT query_id, id, rank, score AS passage_score, {_ANSWER_SENTENCES.format(t='text')} AS ss FROM ps), sx AS (SELECT query_id, id, rank, passage_score, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS sent_idx FROM sa), "
    f"qt AS (SELECT item_id AS query_id, lower(text) AS q, list_filter(list_distinct({_TOKENS.format(t='text')}), lambda w: NOT list_contains({_STOP}, w)) AS terms FROM benchmark), qi AS (SELECT query_id, terms, {_INTENT} AS intent FROM qt), "
    f"so AS (SELECT query_id, id, rank, sent_idx, sentence, passage_score, intent, lower(sentence) AS l, list_distinct({_TOKENS.format(t='sentence')}) AS st, terms FROM sx JOIN qi USING (query_id)), sl AS (SELECT *, len(list_intersect(terms, st)) AS o FROM so), "
    "sc AS (SELECT query_id, id, rank, sent_idx, sentence, passage_score, CASE WHEN len(st) = 0 THEN 0 ELSE floor(least(greatest(0.7::DOUBLE * o / greatest(len(terms), 1) + 0.3::DOUBLE * o / greatest(len(st), 1) "
    "+ (CASE WHEN intent = 'definition' AND (contains(l, 'means') OR contains(l, 'refers to') OR contains(l, 'defined as')) THEN 0.12::DOUBLE ELSE 0 END) + (CASE WHEN intent = 'section' AND contains(l, 'section') THEN 0.12::DOUBLE ELSE 0 END) "
    "+ (CASE WHEN intent = 'condition' AND (contains(l, 'if') OR contains(l, 'provided that') OR contains(l, 'subject to') OR contains(l, 'shall')) THEN 0.12::DOUBLE ELSE 0 END) + (CASE WHEN intent = 'reasoning' AND (contains(l, 'because') OR contains(l, 'therefore') OR contains(l, 'since') OR contains(l, 'held')) THEN 0.12::DOUBLE ELSE 0 END) "
    "- (CASE WHEN length(sentence) < 25 THEN 0.1::DOUBLE ELSE 0 END) - (CASE WHEN length(sentence) > 400 THEN 0.08::DOUBLE ELSE 0 END) - (CASE WHEN l LIKE 'prayer%' OR contains(l, 'it is therefore prayed') THEN 0.4::DOUBLE ELSE 0 END), 0), 1.2) * 10000 + 0.5) / 10000 END AS score FROM sl)"
)


@query(f"{_ANSWER} SELECT query_id, CAST(id AS VARCHAR) AS chunk_id, rank AS passage_rank, sent_idx, round(score, 4) AS score, md5(sentence) AS digest FROM sc")
def sentence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answer.scored_sentences(_passages(spark, sf_dir), _asked(spark, sf_dir))
    return rows.select("query_id", "chunk_id", F.col("passage_rank").cast("long").alias("passage_rank"), F.col("sent_idx").cast("long").alias("sent_idx"), F.round("score", 4).alias("score"), F.md5("sentence").alias("digest"))


_CHOSEN = (
    _ANSWER.replace("WITH ", "WITH RECURSIVE ", 1)
    + f", cn AS (SELECT query_id, CAST(id AS VARCHAR) AS chunk_id, id, rank, sent_idx, sentence, score, passage_score, lower(sentence) AS l, {_WORDS.format(t='sentence')} AS ws, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, round(passage_score, 9) DESC, rank, sent_idx) AS n FROM sc WHERE score > 0), "
    "pk AS (SELECT query_id, n, true AS picked, [l] AS ls, [ws] AS sets FROM cn WHERE n = 1 UNION ALL SELECT cn.query_id, cn.n, w.picked, CASE WHEN w.picked THEN list_append(pk.ls, cn.l) ELSE pk.ls END, CASE WHEN w.picked THEN list_append(pk.sets, cn.ws) ELSE pk.sets END "
    "FROM pk JOIN cn ON cn.query_id = pk.query_id AND cn.n = pk.n + 1, LATERAL (SELECT len(pk.ls) < 5 AND NOT list_contains(pk.ls, cn.l) AND len(list_filter(pk.sets, lambda s: len(s) > 0 AND len(cn.ws) > 0 AND len(list_intersect(s, cn.ws))::DOUBLE / len(list_distinct(list_concat(s, cn.ws))) > 0.8)) = 0 AS picked) w), "
    "ch AS (SELECT cn.*, row_number() OVER (PARTITION BY cn.query_id ORDER BY rank, sent_idx) AS pos FROM pk JOIN cn USING (query_id, n) WHERE picked), "
    "ci AS (SELECT query_id, chunk_id, id, passage_score, row_number() OVER (PARTITION BY query_id ORDER BY min(pos)) AS citation_id FROM ch GROUP BY query_id, chunk_id, id, passage_score)"
)


@query(f"{_CHOSEN} SELECT query_id, pos, chunk_id, rank AS passage_rank, sent_idx, round(score, 4) AS score, sentence FROM ch")
def answer_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answer.selected(answer.scored_sentences(_passages(spark, sf_dir), _asked(spark, sf_dir)))
    long_ = lambda c: F.col(c).cast("long").alias(c)
    return rows.select("query_id", long_("pos"), "chunk_id", long_("passage_rank"), long_("sent_idx"), F.round("score", 4).alias("score"), "sentence")


@query(f"{_CHOSEN} SELECT query_id, citation_id, chunk_id, source AS doc_name, id % 7 AS page_num, lang AS section, 'local' AS source FROM ci JOIN documents ON id = doc_id")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    passages = materialize(_passages(spark, sf_dir), "passages")
    chosen = answer.selected(answer.scored_sentences(passages, _asked(spark, sf_dir)))
    rows = answer.citations(chosen, passages)
    return rows.select("query_id", F.col("citation_id").cast("long").alias("citation_id"), "chunk_id", "doc_name", F.col("page_num").cast("long").alias("page_num"), "section", "source")


# The first sentence of a fifth of the items' passages is all that they have: too little for a sentence that scores.
_WEAK = "query_id % 5 = 2"
_ANSWERED = (
    f"{_CHOSEN.replace('FROM pr JOIN documents ON id = doc_id WHERE rank <= 5)', f'FROM pr JOIN documents ON id = doc_id WHERE rank <= 5 AND query_id % 7 <> 3)').replace('AS ss FROM ps)', 'AS ss FROM (SELECT * REPLACE (CASE WHEN ' + _WEAK + ' THEN concat(chr(45), chr(32), chr(35), id) ELSE text END AS text) FROM ps))')}, "
    "sg AS (SELECT ch.query_id, pos, sentence, citation_id, ch.id, lang, concat(sentence, ' [', citation_id, ']') AS line FROM ch JOIN ci USING (query_id, chunk_id) JOIN documents d ON ch.id = d.doc_id), "
    "ga AS (SELECT query_id, string_agg(sentence, ' ' ORDER BY pos) AS text, string_agg(line, ' ' ORDER BY pos) AS lines, string_agg(concat('- ', line, ' (', lang, ', p.', id % 7, ')'), chr(10) ORDER BY pos) AS points FROM sg GROUP BY 1), "
    "gc AS (SELECT query_id, string_agg(concat('- [', citation_id, '] ', source, ', section ', lang, ', page ', id % 7, ', source local'), chr(10) ORDER BY citation_id) AS cites, count(*) AS n, avg(passage_score) AS p, string_agg(chunk_id, '|' ORDER BY citation_id) FILTER (citation_id <= 3) AS ids FROM ci JOIN documents ON id = doc_id GROUP BY 1), "
    "gs AS (SELECT query_id, avg(score) AS s FROM ch GROUP BY 1), gk AS (SELECT query_id, text, lines, points, cites, n, ids, floor(least(greatest(0.55::DOUBLE * least(greatest(s, 0), 1) + 0.45::DOUBLE * least(greatest(p, 0), 1), 0), 1) * 10000 + 0.5) / 10000 AS confidence FROM ga JOIN gc USING (query_id) JOIN gs USING (query_id)), "
    "tp AS (SELECT query_id, min(id) FILTER (rank = 1) AS top, max(score) FILTER (rank = 1) AS score, count(*) FILTER (rank <= 3) AS n, string_agg(CAST(id AS VARCHAR), '|' ORDER BY rank) FILTER (rank <= 3) AS ids FROM ps GROUP BY 1), "
    "kd AS (SELECT item_id AS query_id, CASE WHEN top IS NULL THEN 'insufficient_context' WHEN gk.text IS NULL THEN 'weak_support' ELSE 'grounded_extractive' END AS answer_type, gk.text AS text, lines, points, cites, gk.n AS gn, gk.ids AS gids, gk.confidence AS gc, top, tp.score AS ts, tp.n AS tn, tp.ids AS tids FROM benchmark LEFT JOIN tp ON item_id = tp.query_id LEFT JOIN gk ON item_id = gk.query_id), "
    "dt2 AS (SELECT *, CASE WHEN text LIKE '%.' THEN text ELSE concat(text, '.') END AS said, concat('#', top, '.') AS short FROM kd)"
)


@query(
    f"{_ANSWERED} SELECT query_id, answer_type, CASE answer_type WHEN 'grounded_extractive' THEN said WHEN 'weak_support' THEN '{WEAK_SUPPORT}' ELSE '{NO_CONTEXT}' END AS simple_answer, CASE answer_type WHEN 'grounded_extractive' THEN text WHEN 'weak_support' THEN short ELSE '' END AS answer_text, "
    f"CASE answer_type WHEN 'grounded_extractive' THEN concat('## Answer', chr(10), chr(10), lines, chr(10), chr(10), '## Evidence', chr(10), chr(10), points, chr(10), chr(10), '## Citations', chr(10), chr(10), cites) WHEN 'weak_support' THEN concat('{WEAK_SUPPORT}', chr(10), chr(10), '## Best Available Passage', chr(10), '> ', short) ELSE '{NO_CONTEXT}' END AS markdown_answer, "
    "CASE answer_type WHEN 'grounded_extractive' THEN gn WHEN 'weak_support' THEN tn ELSE 0 END AS n_citations, CASE answer_type WHEN 'grounded_extractive' THEN gids WHEN 'weak_support' THEN tids ELSE '' END AS supporting, "
    "CASE answer_type WHEN 'grounded_extractive' THEN gc WHEN 'weak_support' THEN floor(least(greatest(ts, 0), 1) * 10000 + 0.5) / 10000 ELSE 0 END AS confidence FROM dt2"
)
def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All outcomes: a fifth of the items have passages too short to score, a seventh have none."""
    passages = _passages(spark, sf_dir).where("query_id % 7 <> 3")
    passages = passages.withColumn("text", F.when(F.expr(_WEAK), F.concat(F.lit("- #"), "chunk_id")).otherwise(F.col("text")))
    rows = answer.answers(materialize(passages, "passages"), _asked(spark, sf_dir))
    ids = F.array_join(F.transform("supporting_passages", lambda p: p["chunk_id"]), "|")
    return rows.select("query_id", "answer_type", "simple_answer", "answer_text", "markdown_answer", F.size("citations").cast("long").alias("n_citations"), ids.alias("supporting"), "confidence")


@query(
    f"{_CHOSEN} SELECT query_id, pos, sentence AS text, citation_id, chunk_id, 'local' AS source, id % 7 AS page_num, lang AS section FROM (SELECT ch.query_id, ch.pos, ch.sentence, ci.citation_id, ch.chunk_id, ch.id FROM ch JOIN ci USING (query_id, chunk_id)) JOIN documents ON id = doc_id"
)
def evidence_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answer.answers(materialize(_passages(spark, sf_dir), "passages"), _asked(spark, sf_dir)).where("answer_type = 'grounded_extractive'")
    rows = rows.select("query_id", F.posexplode("evidence_points").alias("pos", "e"))
    return rows.select("query_id", (F.col("pos") + 1).cast("long").alias("pos"), "e.text", F.col("e.citation_ids")[0].cast("long").alias("citation_id"), "e.chunk_id", "e.source", F.col("e.page_num").cast("long").alias("page_num"), "e.section")


@query(f"{_ROUTE} SELECT query_id, round(confidence, 4) AS confidence, 0.75::DOUBLE AS threshold, true AS fallback_enabled, CASE WHEN confidence < 0.75 THEN 'web_search' ELSE 'local' END AS route FROM c")
def route_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = lexical.top_k(lexical.normalized_scores(_bm25(spark, sf_dir)), 3)
    held = scaled.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "norm"))), lambda r: r["norm"]).alias("s"))
    return held.select("query_id", answer.route_info(F.col("s"), True).alias("i")).select("query_id", F.round("i.confidence", 4).alias("confidence"), "i.threshold", "i.fallback_enabled", "i.route")


@query(
    f"{_ROUTE}, p AS (SELECT query_id, id, norm AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(norm, 9) DESC, id) AS rank FROM nm), w AS (SELECT query_id, CAST(x.r AS BIGINT) AS rank, concat('http://w/', x.r) AS chunk_id, least(1.0, x.r * 0.6::DOUBLE) AS score FROM c, (VALUES (1), (2)) AS x(r) WHERE confidence < 0.95 AND query_id % 2 = 0), "
    "n AS (SELECT query_id, count(*) AS n FROM w GROUP BY 1), a AS (SELECT query_id, rank, chunk_id, score, 0 AS part FROM w UNION ALL SELECT query_id, rank, CAST(id AS VARCHAR), score, 1 FROM p WHERE rank <= 5) "
    "SELECT a.query_id, row_number() OVER (PARTITION BY a.query_id ORDER BY part, a.rank) AS rank, chunk_id, round(score, 6) AS score, CASE WHEN confidence < 0.95 THEN 'web_search' ELSE 'local' END AS route, coalesce(n, 0) AS web_results, CASE WHEN confidence < 0.95 AND n IS NULL THEN 'web_search_returned_no_results' END AS web_error FROM a JOIN c ON a.query_id = c.query_id LEFT JOIN n ON a.query_id = n.query_id"
)
def web_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search that finds two pages for every second item."""
    passages = materialize(_passages(spark, sf_dir), "passages")
    asked = passages.select("query_id").distinct()
    pages = spark.createDataFrame([(1,), (2,)], "rank int")
    external = asked.where("query_id % 2 = 0").crossJoin(F.broadcast(pages)).select("query_id", "rank", F.concat(F.lit("http://w/"), "rank").alias("chunk_id"), F.lit("web text").alias("text"), (F.col("rank") * 0.6).alias("score"))
    used, routes = answer.routed(passages, asked, external, True, 0.95)
    rows = used.join(routes, "query_id")
    return rows.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", F.round("score", 6).alias("score"), "route", F.col("web_results_count").cast("long").alias("web_results"), "web_error")


@query(f"{_M}, f AS (SELECT doc_id, label, text, concat(text, ' (', label, ')') AS name FROM m) SELECT doc_id, count(DISTINCT lower(name)) AS n FROM f GROUP BY doc_id")
def key_entity_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mentions(spark, sf_dir)
    held = m.groupBy(F.col("chunk_id").alias("query_id")).agg(F.collect_list(F.struct("text", "label")).alias("entities")).withColumn("pos", F.lit(1))
    rows = answer.key_entities(held, most=1_000_000)
    return rows.select(F.col("query_id").alias("doc_id"), F.size("key_entities").cast("long").alias("n"))


# --- explanations ---------------------------------------------------------------------------------------------------

_TURNS = "SELECT u.conv_id * 1000 + u.turn AS query_id, u.text AS question, a.text AS answer, lag(a.text) OVER (PARTITION BY u.conv_id ORDER BY u.turn) AS before FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, question, answer, before (the conversation's previous answer): each user turn with its reply."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations")
    u, a = c.where("role = 'user'"), c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    rows = u.join(a, ["conv_id", "turn"])
    before = F.lag("answer").over(Window.partitionBy("conv_id").orderBy("turn"))
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("question"), "answer", before.alias("before"))


_CLAIMS = r"list_filter(" + _SENTENCES.format(t=r"regexp_replace(regexp_replace(concat_ws(' ', nullif(question, ''), nullif(answer, '')), '\*\*.*?\*\*', '', 'g'), '\[.*?\]', '', 'g')") + ", lambda s: length(s) > 20 AND NOT starts_with(s, 'Note:') AND NOT starts_with(s, '*'))"


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir)
    return explain.claim_table(t.select("query_id", F.col("question").alias("simple_answer"), F.col("answer").alias("answer_text")))


@query(f"WITH t AS ({_TURNS}), c AS (SELECT query_id, {_CLAIMS} AS cs FROM t) SELECT query_id, unnest(cs) AS claim, generate_subscripts(cs, 1) - 1 AS claim_idx FROM c")
def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claims(spark, sf_dir).select("query_id", F.col("claim_idx").cast("long").alias("claim_idx"), "claim")


def _turn_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn's passages: its answer, and the answer before it where there is one."""
    t = _turns(spark, sf_dir)
    own = t.select("query_id", F.lit(1).alias("rank"), F.concat(F.col("query_id").cast("string"), F.lit("a")).alias("chunk_id"), F.col("answer").alias("text"))
    old = t.where("before IS NOT NULL").select("query_id", F.lit(2).alias("rank"), F.concat(F.col("query_id").cast("string"), F.lit("b")).alias("chunk_id"), F.col("before").alias("text"))
    return own.unionByName(old)


_CSTOP = "[" + ", ".join(f"'{w}'" for w in CLAIM_STOP_WORDS) + "]"
_SOURCES = (
    f"WITH t AS ({_TURNS}), c AS (SELECT query_id, {_CLAIMS} AS cs FROM t), cl AS (SELECT query_id, unnest(cs) AS claim, generate_subscripts(cs, 1) - 1 AS claim_idx FROM c), pa AS (SELECT query_id, 1 AS rank, concat(query_id, 'a') AS chunk_id, answer AS text FROM t UNION ALL SELECT query_id, 2, concat(query_id, 'b'), before FROM t WHERE before IS NOT NULL), "
    f"cw AS (SELECT *, list_filter({_WORDS.format(t='claim')}, lambda w: NOT list_contains({_CSTOP}, w)) AS cw FROM cl), pw AS (SELECT *, list_filter({_WORDS.format(t='text')}, lambda w: NOT list_contains({_CSTOP}, w)) AS pw FROM pa), "
    "sc AS (SELECT query_id, claim_idx, claim, rank, chunk_id, text, len(list_intersect(cw, pw))::DOUBLE / len(list_distinct(list_concat(cw, pw))) AS sim FROM cw JOIN pw USING (query_id) WHERE len(cw) > 0 AND len(pw) > 0), "
    "bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, claim_idx ORDER BY sim DESC, rank) AS r FROM sc) WHERE r = 1 AND sim >= 0.05)"
)


@query(f"{_SOURCES} SELECT query_id, claim_idx, rank - 1 AS source_passage_idx, chunk_id, floor(sim * 10000 + 0.5) / 10000 AS similarity FROM bs")
def claim_best_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = explain.best_sources(_claims(spark, sf_dir), _turn_passages(spark, sf_dir))
    return rows.select("query_id", F.col("claim_idx").cast("long").alias("claim_idx"), F.col("source_passage_idx").cast("long").alias("source_passage_idx"), "chunk_id", "similarity")


@query(
    f"{_SOURCES}, se AS (SELECT query_id, claim_idx, claim, text, {_SENTENCES.format(t='text')} AS ss FROM bs), sx AS (SELECT query_id, claim_idx, claim, text, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM se), "
    f"so AS (SELECT query_id, claim_idx, s, i, len(list_intersect({_WORDS.format(t='claim')}, {_WORDS.format(t='s')})) AS o FROM sx), sb AS (SELECT query_id, claim_idx, s FROM (SELECT *, row_number() OVER (PARTITION BY query_id, claim_idx ORDER BY o DESC, i) AS r FROM so WHERE o > 0) WHERE r = 1) "
    "SELECT query_id, claim_idx, substr(coalesce(s, text), 1, 200) AS snippet FROM bs LEFT JOIN sb USING (query_id, claim_idx)"
)
def evidence_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = explain.best_sources(_claims(spark, sf_dir), _turn_passages(spark, sf_dir))
    return rows.select("query_id", F.col("claim_idx").cast("long").alias("claim_idx"), F.col("evidence_snippet").alias("snippet"))


@query(f"{_SOURCES}, f AS (SELECT query_id, claim_idx, floor(sim * 10000 + 0.5) / 10000 AS s FROM bs) SELECT query_id, claim_idx, floor(least(1.0::DOUBLE, s * 1.5) * 10000 + 0.5) / 10000 AS confidence, least(1.0::DOUBLE, s * 1.5) > 0.4 AS supported FROM f")
def claim_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = explain.best_sources(_claims(spark, sf_dir), _turn_passages(spark, sf_dir))
    return rows.select("query_id", F.col("claim_idx").cast("long").alias("claim_idx"), explain.claim_confidence(F.col("similarity")).alias("c")).select("query_id", "claim_idx", "c.confidence", "c.supported")


_AGREE = "SELECT l_orderkey AS id, list(l_discount * 10 ORDER BY l_linenumber, l_discount, l_tax) AS s, list(l_tax * 10 ORDER BY l_linenumber, l_discount, l_tax) AS t, list(l_suppkey ORDER BY l_linenumber) AS d, list(lower(l_returnflag)) AS f, list(lower(l_linestatus)) AS l FROM lineitem GROUP BY 1"


@query(
    f"WITH r AS ({_AGREE}), m AS (SELECT id, list_sum(s) / len(s) AS a, list_max(s) AS top, list_sum(t) / len(t) AS b, len(list_filter(t, lambda x: x > 0.3))::DOUBLE / len(t) AS g, len(list_distinct(d)) AS n, len(list_filter(['r', 'a', 'o'], lambda e: list_contains(f, e) OR len(list_filter(l, lambda x: contains(x, e))) > 0)) / 3.0::DOUBLE AS e FROM r) "
    "SELECT id, floor((0.3::DOUBLE * (0.6::DOUBLE * (CASE WHEN a > 1 THEN least(1, (a + 10) / 20) ELSE a END) + 0.4::DOUBLE * (CASE WHEN top > 1 THEN least(1, (top + 10) / 20) ELSE top END)) + 0.25::DOUBLE * e + 0.3::DOUBLE * (0.5::DOUBLE * b + 0.5::DOUBLE * g) + 0.15::DOUBLE * (CASE WHEN n >= 3 THEN 1.0::DOUBLE WHEN n = 2 THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END)) * 10000 + 0.5) / 10000 AS confidence, round(e, 6) AS coverage FROM m"
)
def confidence_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over order lines as stand-ins: discounts as passage scores, taxes as similarities, suppliers as documents, flags as
    the passages' entities and line states as their texts."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_discount") * 10).alias("s"), (F.col("l_tax") * 10).alias("t"), "l_suppkey", "l_returnflag", "l_linestatus"))).alias("x"))
    pick = lambda f: F.transform("x", lambda r: r[f])
    asked = F.array(F.lit("R"), F.lit("A"), F.lit("o"), F.lit("r"))
    covered = explain.entity_coverage(asked, pick("l_linestatus"), pick("l_returnflag"))
    whole = explain.overall_confidence(explain.retrieval_quality(pick("s")), covered, explain.claim_alignment(pick("t")), explain.source_diversity(pick("l_suppkey")), passages=F.size("x"))
    return rows.select("id", whole.alias("confidence"), F.round(covered, 6).alias("coverage"))


_MARKED = (
    _SPANS.replace("WITH ", "WITH RECURSIVE ", 1)
    + ", an AS (SELECT doc_id, pos, label, text, start, end_, true AS kept, end_ AS reach FROM sp WHERE pos = 0 UNION ALL SELECT sp.doc_id, sp.pos, sp.label, sp.text, sp.start, sp.end_, sp.start >= an.reach, CASE WHEN sp.start >= an.reach THEN sp.end_ ELSE an.reach END FROM an JOIN sp ON sp.doc_id = an.doc_id AND sp.pos = an.pos + 1), "
    "mk AS (SELECT doc_id, label, text, start, end_, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos, coalesce(lag(end_) OVER (PARTITION BY doc_id ORDER BY pos), 0) AS before FROM an WHERE kept)"
)


@query(f'{_MARKED} SELECT doc_id, pos, text, label, start, end_ AS "end" FROM mk')
def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, LEGAL).withColumn("e", entities.extract_spans("text")).select("doc_id", F.posexplode(explain.annotations(F.col("text"), F.col("e"))).alias("pos", "a"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "a.text", "a.label", F.col("a.start").cast("long").alias("start"), F.col("a.end").cast("long").alias("end"))


_STYLE = "CASE label " + " ".join(f"WHEN '{label}' THEN 'background:{bg};color:{text};border:1px solid {border}'" for label, bg, text, border, _ in LEGEND) + " END"


@query(
    f"{_MARKED}, pc AS (SELECT doc_id, pos, substr(t, before + 1, start - before) AS lead, substr(t, start + 1, end_ - start) AS own, label, {_STYLE} AS style FROM mk JOIN d0 USING (doc_id)), "
    "md AS (SELECT doc_id, string_agg(concat(lead, '**', own, '** `[', label, ']`'), '' ORDER BY pos) AS markdown, string_agg(concat(lead, '<span class=\"entity\" style=\"', style, ';padding:2px 6px;border-radius:4px;font-weight:500;\" data-label=\"', label, '\" title=\"', label, '\">', own, '<sup style=\"font-size:0.7em;margin-left:2px;opacity:0.7;\">', label, '</sup></span>'), '' ORDER BY pos) AS html FROM pc GROUP BY 1), "
    "en AS (SELECT doc_id, max(end_) AS reach FROM mk GROUP BY 1) SELECT doc_id, md5(concat(markdown, substr(t, reach + 1))) AS markdown, md5(concat(html, substr(t, reach + 1))) AS html FROM md JOIN en USING (doc_id) JOIN d0 USING (doc_id)"
)
def highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, LEGAL).withColumn("e", entities.extract_spans("text")).withColumn("marks", explain.annotations(F.col("text"), F.col("e")))
    return rows.select("doc_id", F.md5(explain.highlight_markdown(F.col("text"), F.col("marks"))).alias("markdown"), F.md5(explain.highlight_html(F.col("text"), F.col("marks"))).alias("html"))


@query("SELECT event_id, round(CASE WHEN value - 50 BETWEEN 0 AND 1 THEN value - 50 ELSE 1 / (1 + exp(-(value - 50))) END, 6) AS shown FROM events")
def display_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.round(explain.display_score(F.col("value") - 50), 6).alias("shown"))


@query("SELECT * FROM (VALUES " + ", ".join("('" + "', '".join(row) + "')" for row in LEGEND) + ") AS v(label, bg, text, border, description)")
def entity_legend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain.legend(spark)


# --- evaluation -----------------------------------------------------------------------------------------------------

_HITS = f"WITH {_BM25}, r AS (SELECT query_id, id, rank FROM bt WHERE rank <= 10), rel AS (SELECT item_id AS query_id, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance by containment."""
    docs, q = documents(spark, sf_dir), _questions(spark, sf_dir)
    relevant = evaluate.containing(docs.select(F.col("doc_id").alias("id"), "text"), q)
    return evaluate.retrieval_metrics(lexical.top_k(_bm25(spark, sf_dir), 10), relevant, q)


@query(
    f"{_HITS}, g AS (SELECT r.query_id, count(*) FILTER (rank <= 5) AS n, count(rel.id) FILTER (rank <= 5) AS h FROM r LEFT JOIN rel ON r.query_id = rel.query_id AND r.id = rel.id GROUP BY 1), k AS (SELECT query_id, count(*) AS total FROM rel GROUP BY 1) "
    "SELECT item_id AS query_id, round(coalesce(h / nullif(n, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(h / total::DOUBLE, 0), 6) AS recall FROM benchmark LEFT JOIN g ON item_id = g.query_id LEFT JOIN k ON item_id = k.query_id"
)
def precision_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).select("query_id", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"{_HITS}, f AS (SELECT r.query_id, min(rank) AS first FROM r JOIN rel ON r.query_id = rel.query_id AND r.id = rel.id GROUP BY 1) SELECT round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr FROM benchmark LEFT JOIN f ON item_id = query_id")
def mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.mean_reciprocal_rank(_metrics(spark, sf_dir)).select(F.round("mrr", 6).alias("mrr"))


@query(
    f"{_M}, s AS (SELECT DISTINCT doc_id, lower(text) AS x, label FROM m), p AS (SELECT * FROM s WHERE label IN ('COURT', 'STATUTE', 'ACT')), g AS (SELECT * FROM s WHERE label IN ('COURT', 'JUDGE', 'ACT')), "
    "n AS (SELECT doc_id, (SELECT count(*) FROM p WHERE p.doc_id = d.doc_id)::DOUBLE AS a, (SELECT count(*) FROM g WHERE g.doc_id = d.doc_id)::DOUBLE AS b, (SELECT count(*) FROM p WHERE p.doc_id = d.doc_id AND p.label <> 'STATUTE')::DOUBLE AS t FROM documents d), "
    "f AS (SELECT doc_id, t / a AS p, t / b AS r FROM n) SELECT doc_id, floor(p * 10000 + 0.5) / 10000 AS precision, floor(r * 10000 + 0.5) / 10000 AS recall, floor(2 * p * r / (p + r) * 10000 + 0.5) / 10000 AS f1 FROM f"
)
def entity_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = F.flatten(F.transform(entities.label_matches("text"), lambda m: F.transform(m["texts"], lambda t: F.struct(t.alias("text"), m["label"].alias("label")))))
    rows = documents(spark, sf_dir, LEGAL).select("doc_id", every.alias("es"))
    some = lambda *labels: F.filter("es", lambda e: e["label"].isin(*labels))
    return rows.select("doc_id", evaluate.entity_f1(some("COURT", "STATUTE", "ACT"), some("COURT", "JUDGE", "ACT")).alias("f")).select("doc_id", "f.*")


_LIST = r"list_filter(regexp_split_to_array(lower({t}), '\s+'), lambda w: w <> '')"


@query(
    f"WITH RECURSIVE t AS ({_TURNS}), w AS (SELECT query_id, {_LIST.format(t='answer')} AS a, {_LIST.format(t=chr(34) + 'r' + chr(34))} AS b FROM (SELECT *, concat_ws(' ', before, question) AS r FROM t)), "
    "g AS (SELECT query_id, 0 AS i, list_transform(b, lambda x: 0) AS row FROM w UNION ALL SELECT g.query_id, g.i + 1, list_transform(range(1, len(s.met) + 1), lambda j: list_max(s.met[1:j])) FROM g JOIN w ON w.query_id = g.query_id AND g.i < len(w.a) AND len(w.b) > 0, "
    "LATERAL (SELECT list_transform(range(1, len(w.b) + 1), lambda j: greatest(g.row[j], (CASE WHEN j > 1 THEN g.row[j - 1] ELSE 0 END) + (w.b[j] = w.a[g.i + 1])::INT)) AS met) s), "
    "n AS (SELECT w.query_id, len(a) AS na, len(b) AS nb, coalesce(g.row[len(b)], 0)::DOUBLE AS n FROM w JOIN g ON g.query_id = w.query_id AND g.i = len(w.a)), f AS (SELECT query_id, n, n / nullif(na, 0) AS p, n / nullif(nb, 0) AS r FROM n) "
    "SELECT query_id, coalesce(floor(p * 10000 + 0.5) / 10000, 0) AS precision, coalesce(floor(r * 10000 + 0.5) / 10000, 0) AS recall, coalesce(floor((CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) * 10000 + 0.5) / 10000, 0) AS f1 FROM f"
)
def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir)
    return t.select("query_id", evaluate.rouge_l(F.col("answer"), F.concat_ws(" ", "before", "question")).alias("r")).select("query_id", "r.*")


_CONTEXTS = "CASE WHEN before IS NULL THEN [question] ELSE [question, before] END"


def _with_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).withColumn("contexts", F.when(F.col("before").isNull(), F.array("question")).otherwise(F.array("question", "before")))


@query(f"WITH t AS ({_TURNS}), w AS (SELECT query_id, {_WORDS.format(t='answer')} AS a, {_WORDS.format(t=f'array_to_string({_CONTEXTS}, chr(32))')} AS c FROM t) SELECT query_id, CASE WHEN len(a) > 0 THEN floor(len(list_intersect(a, c))::DOUBLE / len(a) * 10000 + 0.5) / 10000 ELSE 0 END AS faithfulness FROM w")
def faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_contexts(spark, sf_dir).select("query_id", evaluate.faithfulness(F.col("answer"), F.col("contexts")).alias("faithfulness"))


@query(f"WITH t AS ({_TURNS}), w AS (SELECT query_id, {_WORDS.format(t='question')} AS q, {_WORDS.format(t='answer')} AS a, {_WORDS.format(t='before')} AS b, before FROM t) SELECT query_id, floor(((len(list_intersect(q, a)) > 0)::INT + (CASE WHEN before IS NULL THEN 0 ELSE (len(list_intersect(q, b)) > 0)::INT END))::DOUBLE / (CASE WHEN before IS NULL THEN 1 ELSE 2 END) * 10000 + 0.5) / 10000 AS precision FROM w")
def context_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    contexts = F.when(F.col("before").isNull(), F.array("answer")).otherwise(F.array("answer", "before"))
    return _turns(spark, sf_dir).select("query_id", evaluate.context_precision(F.col("question"), contexts).alias("precision"))


_CHECKSTOP = "['the', 'a', 'an', 'is', 'are', 'was', 'were', 'in', 'of', 'to', 'for', 'and', 'or', 'not', 'with', 'that', 'this']"
_HCLAIMS = r"list_filter(" + _SENTENCES.format(t=r"regexp_replace(regexp_replace(coalesce(nullif(answer, ''), ''), '\*\*.*?\*\*', '', 'g'), '\[.*?\]', '', 'g')") + ", lambda s: length(s) > 20 AND NOT starts_with(s, 'Note'))"


@query(
    f"WITH t AS ({_TURNS}), h AS (SELECT query_id, {_HCLAIMS} AS cs, concat_ws(' ', question, before) AS ev FROM t), c AS (SELECT query_id, unnest(cs) AS claim, ev FROM h), "
    f"w AS (SELECT query_id, list_filter({_WORDS.format(t='claim')}, lambda w: NOT list_contains({_CHECKSTOP}, w)) AS cw, {_WORDS.format(t='ev')} AS ew, ev FROM c), l AS (SELECT query_id, trim(ev) <> '' AND len(cw) > 0 AND len(list_intersect(cw, ew))::DOUBLE / nullif(len(cw), 0) >= 0.6 AS good FROM w), "
    "g AS (SELECT query_id, count(*) AS n, count(*) FILTER (good) AS s FROM l GROUP BY 1) SELECT h.query_id, coalesce(n, 0) AS total_claims, coalesce(s, 0) AS supported, coalesce(n - s, 0) AS unsupported, coalesce(floor((n - s)::DOUBLE / n * 10000 + 0.5) / 10000, 0) AS hallucination_rate FROM h LEFT JOIN g ON h.query_id = g.query_id"
)
def hallucination(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir).select("query_id", F.lit("").alias("simple_answer"), F.col("answer").alias("answer_text"), F.concat_ws(" ", "question", "before").alias("evidence"))
    return evaluate.hallucination(t)


@query(f"WITH t AS ({_TURNS}), w AS (SELECT {_WORDS.format(t='answer')} AS a, {_WORDS.format(t=f'array_to_string({_CONTEXTS}, chr(32))')} AS c FROM t WHERE question <> '' AND answer <> ''), f AS (SELECT CASE WHEN len(a) > 0 THEN floor(len(list_intersect(a, c))::DOUBLE / len(a) * 10000 + 0.5) / 10000 ELSE 0 END AS f FROM w) SELECT count(*) AS total_samples, round(avg(f), 3) AS faithfulness_mean FROM f")
def eval_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_contexts(spark, sf_dir).withColumn("reference_answer", F.lit(None).cast("string"))
    return evaluate.evaluate_dataset(rows).select("total_samples", F.round("faithfulness_mean", 3).alias("faithfulness_mean"))


_SHARES = f"len(list_intersect({_WORDS.format(t='claim')}, {_WORDS.format(t='s')}))"


@query(
    f"WITH t AS ({_TURNS}), c AS (SELECT query_id, question AS claim, concat_ws(' ', answer, before) AS ev FROM t), x AS (SELECT query_id, claim, {_SENTENCES.format(t='ev')} AS ss FROM c), y AS (SELECT query_id, claim, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM x), "
    f"r AS (SELECT query_id, s, row_number() OVER (PARTITION BY query_id ORDER BY {_SHARES} DESC, i) AS k FROM y), g AS (SELECT query_id, substr(string_agg(s, ' ' ORDER BY k), 1, 1500) AS trimmed FROM r WHERE k <= 8 GROUP BY 1) SELECT query_id, coalesce(trimmed, '') AS trimmed FROM c LEFT JOIN g USING (query_id)"
)
def trimmed_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir)
    return t.select("query_id", evaluate.trim_evidence(F.col("question"), F.concat_ws(" ", "answer", "before")).alias("trimmed"))


# --- sources and tables -----------------------------------------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/docloom/folder-{uuid.uuid4().hex}"


def _saved_documents(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a JSON file for each nation (text or content) and a text file for each region."""
    folder = _folder(spark)
    nations = table(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("text"), F.when(F.col("n_nationkey") % 2 == 1, F.col("n_name")).alias("content"))
    nations.coalesce(1).write.option("maxRecordsPerFile", 1).json(folder)
    table(spark, sf_dir, "region").select(F.concat("r_name", F.lit(" region"))).coalesce(1).write.mode("append").option("maxRecordsPerFile", 1).text(folder)
    return folder


@query("SELECT '.json' AS doc_type, n_name AS text, true AS unpaged FROM nation UNION ALL SELECT '.txt', concat(r_name, ' region'), true FROM region")
def source_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files.read_documents(spark, _saved_documents(spark, sf_dir))
    return rows.select("doc_type", T.strip("text").alias("text"), (F.col("pages").isNull() & F.col("error").isNull()).alias("unpaged"))


@query("SELECT 'notes.txt' AS doc_name, 'some text' AS text, NULL::VARCHAR AS error UNION ALL SELECT 'run.exe', NULL, 'unsupported file: run.exe'")
def source_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document that is stored and read, and one that isn't allowed."""
    folder, refused = _folder(spark), []
    for name in ("notes.txt", "run.exe"):
        try:
            files.store(spark, folder, name, b"some text")
        except ValueError as e:
            refused.append((name, None, str(e)))
    schema = "doc_name string, text string, error string"
    return files.read_documents(spark, folder).select("doc_name", "text", "error").unionByName(spark.createDataFrame(refused, schema))


@query("SELECT '.json' AS doc_type, count(*) AS n, 3 AS scan_order FROM nation UNION ALL SELECT '.txt', count(*), 2 FROM region")
def source_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.scan(spark, _saved_documents(spark, sf_dir))
    listed = files.listing(found)
    return listed.join(found.select("doc_name", "scan_order"), "doc_name").groupBy("doc_type", F.col("scan_order").cast("int").alias("scan_order")).agg(F.count("*").alias("n"))


@query("SELECT doc_id AS id, 'kept' AS state FROM documents UNION ALL SELECT NULL, 'cleared' UNION ALL SELECT NULL, 'absent'")
def table_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved and read again; cleared; never saved."""
    base, schema = _folder(spark), "doc_id long, text string"
    docs = documents(spark, sf_dir)
    for name in ("kept", "cleared"):
        tables.save(docs, f"{base}/{name}")
    tables.clear(spark, f"{base}/cleared", schema)
    rows = tables.load(spark, f"{base}/kept", schema).select(F.col("doc_id").alias("id"), F.lit("kept").alias("state"))
    empty = lambda n: tables.load(spark, f"{base}/{n}", schema).agg(F.when(F.count("*") == 0, F.lit(n)).alias("state")).select(F.lit(None).cast("long").alias("id"), "state")
    return rows.unionByName(empty("cleared")).unionByName(empty("absent"))


@query("SELECT event_type AS question, CAST(event_id AS VARCHAR) AS answer, value AS confidence FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def history_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appended in three parts, then the newest 500."""
    path = _folder(spark)
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("question"), F.col("event_id").cast("string").alias("answer"), F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(" "), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("timestamp"), F.col("value").alias("confidence"), F.lit(1).alias("num_sources"), (F.col("event_id") % 3).alias("part"))
    for part in range(3):
        tables.append_history(rows.where(F.col("part") == part), path)
    return tables.history(spark, path).select("question", "answer", "confidence")


@query("SELECT 0 AS kept, count(*) AS after FROM region")
def history_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session's start empties the history; questions after it stand."""
    path = _folder(spark)
    rows = table(spark, sf_dir, "region").select(F.col("r_name").alias("question"), F.lit("a").alias("answer"), F.col("r_regionkey").cast("string").alias("timestamp"), F.lit(0.5).alias("confidence"), F.lit(1).alias("num_sources"))
    tables.append_history(rows, path)
    tables.fresh_history(spark, path)
    kept = tables.history(spark, path).agg(F.count("*").cast("int").alias("kept")).first().kept
    tables.append_history(rows, path)
    return tables.history(spark, path).agg(F.lit(kept).alias("kept"), F.count("*").alias("after"))


@query(
    "SELECT r_regionkey AS done, CASE WHEN r_regionkey = 0 THEN 'error' WHEN r_regionkey >= 3 THEN 'completed' ELSE 'processing' END AS status, CASE WHEN r_regionkey = 0 OR r_regionkey >= 3 THEN 'completed' ELSE 'parsing' END AS stage, "
    "CASE WHEN r_regionkey = 0 THEN 100.0 ELSE (r_regionkey + 1) / 4.0 * 100 END::DOUBLE AS progress FROM region UNION ALL SELECT NULL, 'idle', 'idle', 0"
)
def ingestion_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs over four documents, one failed; one in which all failed; one without documents."""
    done = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("done"))
    failed = F.when(F.col("done") == 0, 4).otherwise(1)
    runs = done.select("done", corpus.status(F.col("done"), F.lit(4), failed).alias("s")).unionByName(spark.range(1).select(F.lit(None).cast("int").alias("done"), corpus.status(F.lit(0), F.lit(0), F.lit(0)).alias("s")))
    return runs.select("done", "s.status", F.col("s.current_stage").alias("stage"), "s.progress")


@query(f"{_M}, g AS (SELECT doc_id FROM documents WHERE source = 'src1') SELECT 'chunks' AS name, count(*) AS n FROM documents WHERE doc_id NOT IN (FROM g) UNION ALL SELECT 'mentions', count(*) FROM m WHERE doc_id NOT IN (FROM g)")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's chunks go by its name, what hangs on them by their ids."""
    chunks = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_name"), F.col("doc_id").alias("chunk_id"))
    left = tables.delete_documents({"chunks": chunks, "mentions": mentions(spark, sf_dir)}, spark.createDataFrame([("src1",)], "doc_name string"))
    count = lambda n: left[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
    return count("chunks").unionByName(count("mentions"))


@query("SELECT r_name AS question, NULL::VARCHAR AS error FROM region WHERE r_regionkey = 0 UNION ALL SELECT NULL, 'No QA evaluation data found'")
def qa_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first file of a folder with one for each region; a folder that isn't there."""
    folder = _folder(spark)
    rows = table(spark, sf_dir, "region").orderBy("r_regionkey").coalesce(1).select(F.col("r_name").alias("question"), F.lit("a").alias("answer"))
    rows.write.option("maxRecordsPerFile", 1).json(folder)
    found = tables.qa_dataset(spark, folder).unionByName(tables.qa_dataset(spark, f"{folder}-absent"))
    return found.select("question", "error")


@query("SELECT r_name AS text, r_regionkey AS start, 4 AS \"end\", 'ACT' AS label FROM region WHERE r_regionkey = 0")
def ner_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    rows = table(spark, sf_dir, "region").orderBy("r_regionkey").coalesce(1)
    span = F.array(F.col("r_regionkey").cast("string"), F.lit("4"), F.lit("ACT"))
    rows.select(F.col("r_name").alias("text"), F.array(span).alias("entities")).write.option("maxRecordsPerFile", 1).json(folder)
    return tables.ner_dataset(spark, folder).select("text", F.explode("entities").alias("e")).select("text", "e.start", "e.end", "e.label")


@query("SELECT 'added' AS state, 2 * count(*) AS n FROM embeddings UNION ALL SELECT 'cleared', 0")
def vector_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, schema = _folder(spark), "id long, vector array<float>"
    store = _corpus_vectors(spark, sf_dir).select("id", "vector")
    tables.save(vectors.add_vectors(store, store.withColumn("id", -F.col("id") - 1)), f"{base}/added")
    tables.save(store, f"{base}/cleared")
    tables.clear(spark, f"{base}/cleared", schema)
    size = lambda n: tables.load(spark, f"{base}/{n}", schema).agg(F.count("*").alias("n")).select(F.lit(n).alias("state"), "n")
    return size("added").unionByName(size("cleared"))


# --- corpus ---------------------------------------------------------------------------------------------------------


@query(f"{_M} SELECT (SELECT count(*) FROM documents) AS total_chunks, (SELECT round(avg(length(t)), 1) FROM d) AS avg_chunk_chars, (SELECT max(length(t)) FROM d) AS max_chunk_chars, (SELECT count(*) FROM m) AS total_entities, (SELECT count(DISTINCT (source, lang)) FROM documents WHERE doc_id % 3 > 0) AS distinct_pages, (SELECT count(DISTINCT source) + 1 FROM documents) AS total_documents, "
    "(SELECT concat('.pdf=1|.txt=', count(DISTINCT source)) FROM documents) AS types, (SELECT string_agg(concat(label, '=', n), '|' ORDER BY label) FROM (SELECT label, count(*) AS n FROM m GROUP BY label)) AS labels")
def corpus_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the chunks have no page; one document has no chunks."""
    page = F.when(F.col("doc_id") % 3 > 0, F.col("lang"))
    chunks = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_name"), page.alias("page_num"), F.expr(LEGAL).alias("text"))
    names = table(spark, sf_dir, "documents").select(F.concat("source", F.lit(".txt")).alias("doc_name")).distinct().unionByName(spark.createDataFrame([("Empty.PDF",)], "doc_name string"))
    counts = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "|")
    found = corpus.metrics(chunks, mentions(spark, sf_dir), names)
    return found.select("total_chunks", "avg_chunk_chars", "max_chunk_chars", "total_entities", "distinct_pages", "total_documents", counts("documents_by_type").alias("types"), counts("entities_by_label").alias("labels"))


@query(
    "SELECT source AS doc_name, '.txt' AS document_type, count(*) AS chunks, count(*) FILTER (doc_id % 3 > 0) AS sections, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1 "
    "UNION ALL SELECT 'none.pdf', '.pdf', 0, 0, 0"
)
def metrics_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the chunks have no section; one document has no chunks."""
    docs = table(spark, sf_dir, "documents")
    listed = docs.select(F.col("source").alias("doc_name"), F.lit(".txt").alias("document_type")).distinct().unionByName(spark.createDataFrame([("none.pdf", ".pdf")], "doc_name string, document_type string"))
    chunks = docs.select(F.col("source").alias("doc_name"), F.when(F.col("doc_id") % 3 == 1, F.col("lang")).when(F.col("doc_id") % 3 == 2, "x").otherwise("").alias("section"), F.lit("x").alias("section_num"), "text")
    return corpus.by_document(chunks, listed)


_PAGES = r"list_filter(list_transform(string_split(regexp_replace(t, '(?m)^(#{1,3} )', concat(chr(1), '\1'), 'g'), chr(1)), lambda x: trim(x, concat(' ', chr(10)))), lambda x: x <> '')"
_PREVIEW = f"CASE WHEN length({_COLLAPSED.format(t='{t}')}) <= 240 THEN {_COLLAPSED.format(t='{t}')} ELSE concat(rtrim(substr({_COLLAPSED.format(t='{t}')}, 1, 237)), '...') END"


@query(
    rf"WITH d AS (SELECT doc_id, {PAGED} AS t FROM documents), p AS (SELECT doc_id, {_PAGES} AS ps FROM d), r AS (SELECT doc_id, ps, array_to_string(ps, concat(chr(10), chr(10))) AS t FROM p), "
    rf"a AS (SELECT doc_id, ps, t AS raw, {_PLAIN.format(t=_FIXED)} AS t FROM r), b AS (SELECT doc_id, ps, raw, {_JOINED.format(t='t')} AS t FROM a), c AS (SELECT doc_id, ps, raw, {_SPACED.format(t='t')} AS t FROM b), e AS (SELECT doc_id, ps, raw, {_TRIM.format(t=_REPEATED.format(t='t'))} AS t FROM c) "
    r"SELECT concat(doc_id, '.pdf') AS doc_name, '.pdf' AS document_type, 'markdown' AS parser, length(raw) AS raw_chars, length(t) AS clean_chars, len(ps) AS page_count, "
    r"array_to_string(list_sort(list_distinct(flatten(list_transform(ps[1:8], lambda x: list_transform(regexp_extract_all(x, '(?m)^(#{1,6})\s+(.+)$', 2), lambda y: trim(y)))))), '|') AS titles, "
    r"array_to_string(list_transform(ps[1:8], lambda x: concat(length(x), ' ', CASE WHEN regexp_matches(x, '(?m)^\|.+\|$') THEN 'true' ELSE 'false' END)), '|') AS pages, "
    rf"{_PREVIEW.format(t='raw')} AS raw_preview, {_PREVIEW.format(t='t')} AS clean_preview FROM e"
)
def document_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, PAGED).select(F.concat("doc_id", F.lit(".pdf")).alias("doc_name"), "text")
    docs = docs.withColumn("pages", files.pages_of_markdown(F.col("text"), F.col("doc_name")))
    raw = files.text_of_pages(F.col("pages"))
    docs = docs.select("doc_name", "pages", raw.alias("raw"), T.clean(raw).alias("clean"))
    rows = corpus.traces(docs, chunking.chunk_documents(docs.select("doc_name", F.col("clean").alias("text"))))
    pages = F.transform("page_samples", lambda p: F.concat(p["char_count"].cast("string"), F.lit(" "), p["has_tables"].cast("string")))
    return rows.select("doc_name", "document_type", "parser", "raw_chars", "clean_chars", F.col("page_count").cast("long").alias("page_count"), F.array_join("section_titles", "|").alias("titles"), F.array_join(pages, "|").alias("pages"), "raw_preview", "clean_preview")


@query(f"{_M} SELECT doc_id AS doc_name, count(*) AS total, count(DISTINCT label) AS n_labels FROM m GROUP BY 1")
def trace_entity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mentions(spark, sf_dir).select(F.col("chunk_id").alias("doc_name"), F.lit(0).alias("chunk_index"), "pos", "label", "text")
    return corpus.entity_rollup(m).select("doc_name", "total", F.size("by_label").cast("long").alias("n_labels"))


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def history_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.latest(table(spark, sf_dir, "events"), by="ts", tie="event_id").select("event_id", "event_type")


@query("SELECT doc_id FROM documents WHERE source <> 'src0'")
def delete_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return index.without_documents(docs, spark.createDataFrame([("src0",)], "source string"), "source").select("doc_id")


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming aggregation, run until all that is there has been read."""
    from docloom.streaming.ingest import count_events

    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if path.endswith("/") else sf_dir + "/events.parq*")
    out = f"{shared_dir(spark)}/docloom/events-{uuid.uuid4().hex}"
    counted = count_events(stream.withColumn("ts", F.col("ts").cast("timestamp")), f"{out}/counts", f"{out}/checkpoint")
    return counted.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query()
def answer_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole path over legal documents for all items."""
    from docloom.plans import ingest
    from docloom.plans import query as plan

    docs = documents(spark, sf_dir, LEGAL).select(F.concat("doc_id", F.lit(".txt")).alias("doc_name"), "text")
    chunks = materialize(ingest.tagged(ingest.chunks_of(docs)), "chunks")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat("text", F.lit(" under Section 7 of the Indian Penal Code?")).alias("question"))
    return plan.run(asked, chunks, materialize(index.postings(ingest.mentions_of(chunks)), "postings")).select("query_id", "answer_type", "confidence", "route", "num_sources", "simple_answer", "highlighted")
