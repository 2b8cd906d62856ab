"""What the operators of this subpackage share: folds, batches of whole texts, bounded samples, durable cuts of lineage."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: these six ASCII characters and no others; ``bytes.split()`` cuts at exactly these.
WHITE = b" \t\n\r\x0b\f"

#: Rows of a batch that goes to Python.  Texts can be very long, so few rows; a batch of ordinary texts is about 2 MB.
BATCH_ROWS = 512

#: Rows of ids that may be broadcast: some 25 MB.  Above that, joins shuffle.
BROADCAST_IDS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo parts; a null key falls in fold -1."""
    return F.coalesce(F.crc32(key.cast("string")) % parts, F.lit(-1))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by spark.checkpoint.dir.

    Where the session names none, a temporary one will do on a single machine (tests); elsewhere it is an error, as
    executors would write where nobody else can read."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or tempfile.mkdtemp(prefix="spanlake-")).rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Cuts lineage with a checkpoint in the shared folder, which outlives any executor."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def few_rows(spark: SparkSession) -> None:
    """Batches of BATCH_ROWS rows, unless the session has its own setting of the batch size.

    Spark reads it when a plan runs, not when it is made, so it cannot be put back here."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, BATCH_ROWS)


def map_texts(df: DataFrame, columns: list[str], schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], rows: int = BATCH_ROWS) -> DataFrame:
    """Maps record batches of at most ``rows`` rows of the named columns; ``make`` runs once in each task and returns the
    function of a batch.  What a Python worker holds of very long texts is bounded by Spark's own batch of 64 MB."""
    few_rows(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches:
            step = step or make()
            for at in range(0, batch.num_rows, rows):
                out = step(batch.slice(at, rows))
                if out is not None and out.num_rows:
                    yield out
        pa.default_memory_pool().release_unused()  # workers are used again: what one task's texts took goes back

    return df.select(*columns).mapInArrow(run, schema)


def filter_texts(df: DataFrame, make: Callable[[], Callable[[list[bytes | None]], np.ndarray]]) -> DataFrame:
    """The rows of ``df``, with all their columns, whose text the function that ``make`` returns holds true; no shuffle."""
    few_rows(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = None
        for batch in batches:
            keep = keep or make()
            yield batch.filter(pa.array(keep(raw(batch, "text")), pa.bool_()))
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, df.schema)


def small(ids: DataFrame) -> DataFrame:
    """``ids`` written durably, marked for broadcast if their number is proven to be at most BROADCAST_IDS."""
    ids = durable(ids)
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def without(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose doc_id is not among ``ids``; rows without doc_id stay."""
    return df.join(small(ids.select("doc_id").distinct()), "doc_id", "left_anti").select(*df.columns)


def raw(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def labels_of(labels: DataFrame, name: str) -> DataFrame:
    """(doc_id, label): rows without id or label are left out; of contradicting rows of one id the larger label holds."""
    rows = labels.select(F.col("doc_id"), F.col(name).cast("int").alias("label"))
    return rows.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))


def _below(many: dict[object, int], wanted: int) -> Column:
    """True for rows of (label, _o) in the low end of the hash's range that holds about ``wanted`` rows of each label."""
    held = F.lit(False)
    for label, n in many.items():
        least = F.lit(True) if n <= wanted else F.col("_o") < -(2**63) + 2**64 * wanted // n
        held = F.when(F.col("label") == F.lit(label), least).otherwise(held)
    return held


def bounded_sample(docs: DataFrame, labelled: DataFrame, per_label: int, make: Callable[[], Callable[[bytes], bytes]], most_labels: int = 256) -> list[tuple[int, bytes, object]]:
    """At most ``per_label`` documents of each label, chosen by the hash of doc_id: (doc_id, features, label), in that order.

    ``labelled`` has (doc_id, label).  ``make`` returns a function from a whole UTF-8 text to its packed features; it runs
    where the texts lie, so texts of any length are used and none comes to the driver.  A null text is not used.  More
    than ``most_labels`` labels are an error, so the number of rows is bounded whatever the size of the corpus.  The
    scans that count labels and pick ids read no text column.  Ids come to the driver from the low end of the hash's
    range alone, about twice per_label of each label, so no task sees all ids of a label.
    """
    many = {r.label: r["count"] for r in labelled.groupBy("label").count().limit(most_labels + 1).collect()}
    if len(many) > most_labels:
        raise ValueError(f"more than {most_labels} labels")
    low = labelled.select("doc_id", "label", F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")).alias("_o")).where(_below(many, 2 * per_label))
    of_label: dict[object, list] = {}
    for r in sorted(low.collect(), key=lambda r: (r._o, r.doc_id)):
        of_label.setdefault(r.label, []).append(r)
    picked = [r for rows in of_label.values() for r in rows[:per_label]]
    if not picked:
        return []
    spark = docs.sparkSession
    chosen = F.broadcast(spark.createDataFrame([(int(r.doc_id),) for r in {r.doc_id: r for r in picked}.values()], "doc_id long"))

    def featured():
        features = make()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t) for t in raw(batch, "text")], pa.binary())], ["doc_id", "features"])

        return step

    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id", "left_semi")
    found: dict[int, bytes] = {}
    for r in map_texts(texts, ["doc_id", "text"], "doc_id long, features binary", featured).collect():
        found[r.doc_id] = max(bytes(r.features), found.get(r.doc_id, b""))  # of repeated ids one text, whatever the order
    return [(r.doc_id, found[r.doc_id], r.label) for r in sorted(picked, key=lambda r: (r._o, r.doc_id)) if r.doc_id in found]


class WordRows(dict):
    """Word (bytes) to the number of its row in ``block``, filled by ``make`` on first sight.

    Once it has ``most`` words it is set aside between documents and begun anew; words that come up again are taken over
    from what was set aside, so usual words stay.  A worker's memory is bounded by twice that and by the longest text."""

    def __init__(self, width: int, make: Callable[[bytes], object], kind=np.float32, most: int = 120_000):
        super().__init__()
        self.make, self.most = make, most
        self.block = np.zeros((4096, width), kind)
        self.aside: dict[bytes, int] = {}
        self.block_aside = self.block

    def __missing__(self, word: bytes) -> int:
        old = self.aside.get(word)
        row = self.make(word) if old is None else self.block_aside[old]
        n = len(self)
        if n == len(self.block):
            self.block = np.concatenate([self.block, np.zeros_like(self.block)])
        self.block[n] = row
        self[word] = n
        return n

    def trim(self) -> None:
        if len(self) > self.most:
            self.aside, self.block_aside = dict(self), self.block
            self.clear()
            self.block = np.zeros_like(self.block[:4096])

    def rows(self, words: list[bytes]) -> np.ndarray:
        self.trim()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))
