"""The engine's tables: saved, loaded (empty where there is none yet), cleared, documents deleted from all of them."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.config import DEFAULTS
from docloom.operators.corpus import latest
from docloom.schema import HISTORY, NER_ROWS, QA_ROWS


def save(df: DataFrame, path: str, buckets: int | None = None, key: str | None = None) -> None:
    """Overwrite a table; with buckets, co-locate it by key for later joins (then path is a table name)."""
    if buckets and key:
        df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(path)
    else:
        df.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, or an empty one of this schema where nothing was saved."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def clear(spark: SparkSession, path: str, schema: str) -> None:
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def append_history(df: DataFrame, path: str) -> None:
    """Append query rows; readers take the newest (`history`), so nothing is rewritten."""
    df.select(*(f.split()[0] for f in HISTORY.split(", "))).write.mode("append").parquet(path)


def fresh_history(spark: SparkSession, path: str) -> str:
    """An empty history, for a session that starts without the questions of the last; its path."""
    clear(spark, path, HISTORY)
    return path


def history(spark: SparkSession, path: str, n: int = DEFAULTS.history_limit) -> DataFrame:
    return latest(load(spark, path, HISTORY), n, "timestamp", "question")


def delete_documents(tables: dict[str, DataFrame], names: DataFrame, key: str = "doc_name", chunk_key: str = "chunk_id") -> dict[str, DataFrame]:
    """All tables without the named documents: those with the document's name by it, others by the chunks' ids."""
    gone = names.select(key).distinct()
    chunks = tables["chunks"].join(gone, key, "left_semi").select(chunk_key).distinct()
    return {n: t.join(gone, key, "left_anti") if key in t.columns else t.join(chunks, chunk_key, "left_anti") for n, t in tables.items()}


def first_dataset(spark: SparkSession, folder: str) -> str | None:
    """The first *.json file of a folder by name; None if there is none."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "false")
    try:
        return names.load(folder).agg(F.min("path")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _dataset(spark: SparkSession, path: str, schema: str, what: str) -> DataFrame:
    """Rows of a dataset file, or of the first one of a folder, with an error: one row where it can't be read or is empty."""
    columns = [f.name for f in spark.createDataFrame([], schema).schema]
    failed = lambda text: spark.createDataFrame([(None,) * len(columns) + (text,)], f"{schema}, error string")
    file = path if path.endswith(".json") else first_dataset(spark, path)
    if file is None:
        return failed(f"No {what} data found")
    try:
        rows = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(file)
        found = rows.agg(F.count("*").alias("n"), F.count("_corrupt_record").alias("bad"), F.count(columns[0])).first()
    except AnalysisException as e:
        return failed(f"Failed to load {what} data: {e.getCondition()}")
    if found.bad:
        return failed(f"Failed to load {what} data: MALFORMED_RECORD")
    if not found.n:
        return failed(f"{what} data is empty")
    return spark.read.schema(schema).option("multiLine", True).json(file).withColumn("error", F.lit(None).cast("string"))


def qa_dataset(spark: SparkSession, path: str) -> DataFrame:
    """QA rows of a file, or of a folder's first file, with an error column (see _dataset)."""
    return _dataset(spark, path, QA_ROWS, "QA evaluation")


def ner_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Entity rows of a file, or of a folder's first file, with an error column."""
    raw = _dataset(spark, path, "text string, entities array<array<string>>", "NER training")
    return raw.select("text", _spans(), "error")


def _spans():
    spans = F.transform("entities", lambda e: F.struct(e[0].cast("int").alias("start"), e[1].cast("int").alias("end"), e[2].alias("label")))
    return spans.cast(NER_ROWS.split("entities ")[1]).alias("entities")


def read_qa(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a QA dataset: one JSON array of objects, or objects by line; missing fields are null."""
    return spark.read.schema(QA_ROWS).option("multiLine", True).json(path)


def read_ner(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an entity dataset whose entities are [start, end, label] arrays."""
    raw = spark.read.schema("text string, entities array<array<string>>").option("multiLine", True).json(path)
    return raw.select("text", _spans())


def read_traces(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return load(spark, path, schema)
