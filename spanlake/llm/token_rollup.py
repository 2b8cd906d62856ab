"""Token counts as additive totals that signed changes keep up to date.

A ledger is a folder with two tables: ``counts`` (the count of each live document, written batch by batch) and
``deltas`` (what each batch adds to the totals).  A batch inserts, deletes or revises documents; its rows become signed
counts, a revision being minus the old and plus the new.  A batch is committed by one marker file, created last and
exclusively under the next number; it names the batch and its data.  Of two writers that want the same number one gets
it and the other computes its batch anew on what is then there.  Committing an id again changes nothing, and what a
writer that died left behind is never read.  ``compact`` folds the changes so far into one table of live counts, so that
a later batch reads that and the changes since.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import map_texts, raw, shared_folder, small
from .subwords import chunk_ids, default_path

KEYS = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_tokens", "n_chars")
_COUNTED = "doc_id long, source string, lang string, tokenizer string, n_tokens long, n_chars long"
_CHANGE = f"{_COUNTED}, sign int"
_KEYS = [c.split()[0] for c in _COUNTED.split(", ")]
_DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"


def count_tokens(docs: DataFrame, versions: dict[str, str | None]) -> DataFrame:
    """doc_id, source, lang, tokenizer, n_tokens, n_chars: a row for each document and tokenizer version.

    ``versions`` maps a version's name to the path of its tokenizer, or to None for words (runs without ASCII white
    space).  Null and empty texts have no tokens and no characters, and texts of any length are counted whole; null
    sources, languages and ids stay null; repeated rows are counted each; other columns are ignored.  An empty table gives
    no row."""
    import pyarrow as pa

    def make():
        tables = {name: path and chunk_ids(path) for name, path in versions.items()}

        def step(batch):
            texts, n = raw(batch, "text"), batch.num_rows
            out = []
            for name, ids in tables.items():
                counts = [len(ids.of(t)) // 4 if ids is not None else len((t or b"").split()) for t in texts]
                out.append(pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([name] * n), pa.array(counts, pa.int64()), batch.column(4)], ["doc_id", "source", "lang", "tokenizer", "n_tokens", "n_chars"]))
            return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if n else None

        return step

    rows = docs.select(*[F.col(c).cast("long" if c == "doc_id" else "string").alias(c) for c in ("doc_id", "source", "lang", "text")], F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
    return map_texts(rows, ["doc_id", "source", "lang", "text", "n_chars"], _COUNTED, make)


def totals(changes: DataFrame) -> DataFrame:
    """Signed rows summed by source, language and tokenizer version, partly before the shuffle, so a hot source is no hot task."""
    return changes.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("n_docs"), *[F.sum(F.col(c) * F.col("sign")).cast("long").alias(c) for c in SUMS[1:]])


class Ledger:
    """The rollup in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, patience: float = 30.0):
        self.spark, self.path, self.patience = spark, path.rstrip("/"), patience
        jvm = spark.sparkContext._jvm
        self._jvm, self._jpath = jvm, jvm.org.apache.hadoop.fs.Path
        self._fs = self._jpath(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _marks(self, kind: str) -> list[dict]:
        """What the markers of a kind say, in the order of their numbers.  A marker that its writer has created but not
        yet filled ends the list: nothing after it is read before it is filled."""
        top = self._jpath(f"{self.path}/{kind}")
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(top)) if self._fs.exists(top) else []
        out = []
        for name in names:
            stream = self._fs.open(self._jpath(f"{self.path}/{kind}/{name}"))
            said = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            if not said:
                break
            out.append(json.loads(said))
        return out

    def _claim(self, kind: str, number: int, said: dict) -> bool:
        """Creates marker ``number`` if nobody has; the file system's exclusive create decides between writers."""
        at = self._jpath(f"{self.path}/{kind}/{number:08d}")
        try:
            out = self._fs.create(at, False)
        except Py4JJavaError as e:
            if self._fs.exists(at):
                return False
            raise e
        out.write(bytearray(json.dumps(said).encode()))
        out.close()
        return True

    def batches(self) -> list[str]:
        """Ids of the committed batches, in the order of their numbers."""
        return [m["batch"] for m in self._marks("commits")]

    def _tables(self, kind: str, schema: str, marks: list[dict]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{kind}/{m['data']}" for m in marks]) if marks else self.spark.createDataFrame([], schema)

    def live(self, ids: DataFrame | None = None, marks: list[dict] | None = None) -> DataFrame:
        """The counts that hold now (of the documents in ``ids``): a document's signed rows cancel but for the last.

        Reads the newest compacted table and the changes after it; the range of ``ids`` is pushed to the files, which a
        compacted table holds in order of doc_id."""
        marks = self._marks("commits") if marks is None else marks
        folded = [m for m in self._marks("compactions") if m["upto"] <= len(marks)]
        done = folded[-1]["upto"] if folded else 0
        rows = self._tables("changes", _CHANGE, marks[done:])
        if folded:
            rows = rows.unionByName(self._tables("live", _CHANGE, folded[-1:]))
        if ids is not None:
            ids = small(ids.select("doc_id").distinct())
            low, high = ids.agg(F.min("doc_id"), F.max("doc_id")).first()
            rows = rows.where(F.col("doc_id").between(low, high)) if low is not None else rows.where("false")
            rows = rows.join(ids, "doc_id", "left_semi")
        return rows.groupBy(*_KEYS).agg(F.sum("sign").cast("int").alias("sign")).where("sign <> 0")

    def compact(self) -> bool:
        """Folds the changes so far into one table of live counts in order of doc_id; False if there is nothing new."""
        marks, folded = self._marks("commits"), self._marks("compactions")
        if len(marks) <= (folded[-1]["upto"] if folded else 0):
            return False
        name = uuid.uuid4().hex
        self.live(marks=marks).repartitionByRange("doc_id", "tokenizer").sortWithinPartitions("doc_id").write.parquet(f"{self.path}/live/{name}")
        return self._claim("compactions", len(folded), {"upto": len(marks), "data": name})

    def commit(self, batch: str, inserts: DataFrame | None = None, deletes: DataFrame | None = None, revisions: DataFrame | None = None) -> bool:
        """Applies a batch once; False if ``batch`` was committed before.

        ``inserts`` and ``revisions`` have the columns of ``count_tokens``, ``deletes`` has doc_id.  Deleting or revising
        an unknown document removes nothing; a null doc_id matches nothing, so a row without one can come in but not go.
        A revision replaces the counts of the tokenizer versions that it brings and leaves other versions; repeated rows
        count as often as they stand.  Empty tables change nothing but are a committed batch."""
        if not batch:
            raise ValueError("a batch id is not empty")
        waited = time.monotonic() + self.patience
        while True:
            marks = self._marks("commits")
            if batch in [m["batch"] for m in marks]:
                return False
            if self._fs.exists(self._jpath(f"{self.path}/commits/{len(marks):08d}")):  # claimed, not yet filled
                if time.monotonic() > waited:
                    raise RuntimeError(f"batch number {len(marks)} was claimed but never described; delete its marker if its writer is dead")
                time.sleep(0.1)
                continue
            name = f"{len(marks):08d}-{uuid.uuid4().hex}"
            changes = f"{self.path}/changes/{name}"
            self._signed(marks, inserts, deletes, revisions).write.parquet(changes)
            totals(self.spark.read.schema(_CHANGE).parquet(changes)).write.parquet(f"{self.path}/deltas/{name}")
            if self._claim("commits", len(marks), {"batch": batch, "data": name}):  # the one step that makes the batch count
                return True
            for kind in ("changes", "deltas"):  # another writer was first, and what it wrote may concern this batch
                self._fs.delete(self._jpath(f"{self.path}/{kind}/{name}"), True)

    def _signed(self, marks: list[dict], inserts: DataFrame | None, deletes: DataFrame | None, revisions: DataFrame | None) -> DataFrame:
        signed = [rows.select(*_KEYS, F.lit(1).alias("sign")) for rows in (inserts, revisions) if rows is not None]
        gone = []
        if deletes is not None:
            gone.append(self.live(deletes, marks))
        if revisions is not None:
            old = self.live(revisions, marks)
            if deletes is not None:
                old = old.join(deletes.select("doc_id").distinct(), "doc_id", "left_anti")
            gone.append(old.join(revisions.select("doc_id", "tokenizer").distinct(), ["doc_id", "tokenizer"], "left_semi"))
        signed += [x.select(*_KEYS, (-F.col("sign")).alias("sign")) for x in gone]
        rows = signed[0] if signed else self.spark.createDataFrame([], _CHANGE)
        for more in signed[1:]:
            rows = rows.unionByName(more)
        return rows.select(*_KEYS, F.col("sign").cast("int").alias("sign"))

    def rollup(self) -> DataFrame:
        """Totals by source, language and tokenizer version: the sum of the committed deltas, which are as small as the
        number of groups.  A group whose documents have all gone is left out."""
        deltas = self._tables("deltas", _DELTA, self._marks("commits"))
        return deltas.groupBy(*KEYS).agg(*[F.sum(c).cast("long").alias(c) for c in SUMS]).where("n_docs <> 0")


def maintained(docs: DataFrame, labels: DataFrame, versions: dict[str, str | None] | None = None, path: str | None = None) -> DataFrame:
    """Totals of ``docs`` after three batches: all documents come in, those labelled of low quality are taken down, those
    labelled toxic come back with masked digits as revised counts; the second batch is also sent twice."""
    spark = docs.sparkSession
    versions = versions or {"words": None, "word_bpe_49k": default_path()}
    path = path or f"{shared_folder(spark)}/token-ledger-{uuid.uuid4().hex}"
    ledger = Ledger(spark, path)
    ledger.commit("ingest", inserts=count_tokens(docs, versions))
    low = small(labels.where("quality = 0 and doc_id is not null").select("doc_id").distinct())
    ledger.commit("takedown", deletes=low)
    ledger.commit("takedown", deletes=low)
    toxic = small(labels.where("toxic = 1 and doc_id is not null").select("doc_id").distinct().join(low, "doc_id", "left_anti"))
    masked = docs.join(toxic, "doc_id", "left_semi").withColumn("text", F.regexp_replace("text", "[0-9]+", "#"))
    ledger.commit("mask", revisions=count_tokens(masked, versions))
    return ledger.rollup()
