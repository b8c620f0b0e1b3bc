"""What the operators of this package share: tables, Arrow batches of texts cut to a bounded size, shared folders."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from millrace.session import shared_folder

#: Texts are worked on in slices of about this many bytes; one longer text makes a slice of its own.
SLICE_BYTES = 2 << 20
#: Texts that are taken together where many share words.
GATHER_BYTES = 8 << 20
#: Rows of an Arrow batch between Spark and Python: bounds the batch where texts are long.
BATCH_ROWS = 500
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of this package: small Arrow batches, so that memory follows neither row counts nor long texts.

    Python workers also look for this package where the driver found it, if it is not installed for them.
    """
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, known]))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut so that their texts have at most `limit` bytes, or one row."""
    for batch in batches:
        start = size = 0
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        for row, length in enumerate(lengths.tolist()):
            if row > start and size + length > limit:
                yield batch.slice(start, row - start)
                start, size = row, 0
            size += length
        if batch.num_rows > start:
            yield batch.slice(start)


def gathered(batches: Iterator[pa.RecordBatch], limit: int = GATHER_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches joined and cut so that their texts have about `limit` bytes, for work that gains from seeing many texts at once."""
    held, size = [], 0
    for batch in slices(batches, limit, column):
        more = pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if held and size + more > limit:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += more
    if held:
        yield pa.concat_batches(held)


def map_texts(docs: DataFrame, work: Callable[[pa.RecordBatch], dict], schema: str, cut: Callable = slices) -> DataFrame:
    """One output batch per slice of (doc_id, text), as `cut` makes them: `work` gives its columns by name. No shuffle; a null
    text stays null."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for part in cut(batches):
            columns = work(part)
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type, from_pandas=False) for f in fields], schema=fields)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes a frame to the shared folder and reads it: cuts the lineage, and lost executors cost no recomputation."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables of one run, in a folder of their own below the shared one, to be removed when it is over."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path, self.n = spark, shared_folder(spark, label), 0

    def stored(self, df: DataFrame, label: str) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n}-{label}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(columns: list[str], stem: str) -> str:
    """A beginning for column names that no given column has."""
    while any(name.lower().startswith(stem.lower()) for name in columns):
        stem += "_"
    return stem
