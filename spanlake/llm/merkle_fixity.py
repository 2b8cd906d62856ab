"""Merkle fixity audit of WARC replicas.

A record's digest is a leaf; a node's digest covers the relative offset ranges and the digests of its sixteen children
in order; a file's root covers the whole file.  Two replicas are compared root by root, and only below nodes that differ
are the children compared, level by level, down to the records at fault.  All of it is DataFrame operations; groups are
of sixteen children at most.
"""

from __future__ import annotations

import gzip
import io
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frames import durable, map_texts

FANOUT = 16
#: Records of a file, so that a file is bounded.
RECORDS = 1000


def record_text(key: Column, url: Column, payload: Column) -> Column:
    """A WARC/1.0 resource record; nulls are written as empty."""
    lines = ["WARC/1.0", "WARC-Type: resource", F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(">")), F.concat(F.lit("WARC-Target-URI: "), F.coalesce(url, F.lit(""))), F.concat(F.lit("Content-Length: "), F.octet_length(payload).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *[F.lit(x) if isinstance(x, str) else x for x in lines]), F.lit("\r\n\r\n"), payload, F.lit("\r\n\r\n"))


def records(pages: DataFrame, payload: Column | None = None) -> DataFrame:
    """file, seq, start, length, digest: how ``pages`` (page_id, url, html) lie in WARC files of RECORDS ids each.

    Within a file, records stand in the order of page_id, url, html; a null page_id goes to the file of a hash of its
    url; repeated rows are records of their own."""
    html = F.coalesce(payload if payload is not None else F.col("html"), F.lit(""))
    key = F.coalesce(F.col("page_id"), F.crc32(F.coalesce(F.col("url"), F.lit(""))))
    text = record_text(F.col("page_id"), F.col("url"), html)
    rows = pages.select(F.expr("0L").alias("_z"), F.floor(key / RECORDS).cast("long").alias("file"), key.alias("key"), F.col("url"), F.sha2(F.coalesce(F.col("html"), F.lit("")), 256).alias("tie"), F.octet_length(text).cast("long").alias("length"), F.sha2(text, 256).alias("digest"))
    own = Window.partitionBy("file").orderBy("key", "url", "tie")
    return rows.select("file", (F.row_number().over(own) - 1).cast("long").alias("seq"), (F.sum("length").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("length")).alias("start"), "length", "digest")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The same rows for the WARC files below ``path``, plain or compressed record by record; ``file`` is the file's name.

    Spark's binaryFile source reads them, so any store will do; one file must fit a task's memory."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[], [], [], [], []]
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for seq, (start, length, digest) in enumerate(scan(content)):
                    for column, value in zip(out, (name.rsplit("/", 1)[-1], seq, start, length, digest)):
                        column.append(value)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["file", "seq", "start", "length", "digest"])

        return step

    files = spark.read.format("binaryFile").load(path)
    return map_texts(files, ["path", "content"], "file string, seq long, start long, length long, digest string", make, rows=1)


def scan(content: bytes) -> list[tuple[int, int, str]]:
    """(start, length, sha256 of the stored bytes) of each record; bytes that are no record are one record to the end."""
    import hashlib

    out, at = [], 0
    while at < len(content):
        end = len(content)
        if content[at : at + 2] == b"\x1f\x8b":
            inflate = zlib.decompressobj(31)
            try:
                inflate.decompress(content[at:])
                end = len(content) - len(inflate.unused_data) if inflate.eof else end
            except zlib.error:
                pass
        elif content.startswith(b"WARC/", at) and (head := content.find(b"\r\n\r\n", at)) >= 0:
            for line in content[at:head].split(b"\r\n"):
                name, _, value = line.partition(b":")
                if name.strip().lower() == b"content-length" and value.strip().isdigit():
                    end = min(len(content), head + 4 + int(value) + 4)
        out.append((at, end - at, hashlib.sha256(content[at:end]).hexdigest()))
        at = end
    return out


def write_warc(rows: list[tuple[int | None, str | None, str | None]], compress: bool = False) -> bytes:
    """Records as ``record_text`` writes them, joined to one file; with ``compress`` a gzip member for each."""
    out = io.BytesIO()
    for key, url, html in rows:
        body = (html or "").encode()
        head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{'' if key is None else key}>\r\nWARC-Target-URI: {url or ''}\r\nContent-Length: {len(body)}\r\n\r\n"
        whole = head.encode() + body + b"\r\n\r\n"
        out.write(gzip.compress(whole, mtime=0) if compress else whole)
    return out.getvalue()


def tree(leaves: DataFrame, height: int) -> list[DataFrame]:
    """``height`` levels above the leaves, up to one root for each file: file, node, length, digest.

    A parent's digest covers each child's place, relative start and length, and digest, in order, so it does not change
    when an earlier part of the file grows.  Files of any size have the same number of levels, so that trees of equal
    height are compared node by node."""
    levels = [durable(leaves.select("file", F.col("seq").alias("node"), "length", "digest"))]
    for _ in range(height):
        child = F.struct("node", "length", "digest")
        parent = levels[-1].groupBy("file", F.floor(F.col("node") / FANOUT).cast("long").alias("up")).agg(F.array_sort(F.collect_list(child)).alias("c"))
        said = F.transform("c", lambda x, i: F.concat_ws(":", x.node.cast("string"), F.aggregate(F.slice("c", F.lit(1), i), F.lit(0).cast("long"), lambda s, y: s + y.length).cast("string"), x.length.cast("string"), x.digest))
        levels.append(durable(parent.select("file", F.col("up").alias("node"), F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + x.length).alias("length"), F.sha2(F.array_join(said, "\n"), 256).alias("digest"))))
    return levels


def height_of(*replicas: DataFrame) -> int:
    """Levels that the largest file of all replicas needs, one at least."""
    most = max(r.agg(F.max("seq")).first()[0] or 0 for r in replicas)
    height = 1
    while (most := most // FANOUT) > 0:
        height += 1
    return height


def audit(one: DataFrame, two: DataFrame) -> DataFrame:
    """file, seq, kind, start_one, start_two, length_one, length_two, digest_one, digest_two: the records that differ.

    ``one`` and ``two`` have the columns of ``records``; others, whatever their names, are ignored.  kind is 'altered', or
    'missing' or 'extra' for a record that only the first or only the second replica has.  Records are told apart by
    (file, seq); of rows that repeat one, the smallest digest, then the smallest length, stands for the record in that
    replica.  Rows without file or seq are no records.  Equal replicas and two empty ones give no row."""
    one, two = [durable(_told_apart(x)) for x in (one, two)]
    height = height_of(one, two)
    a, b = tree(one, height), tree(two, height)
    wrong = None
    for x, y in zip(reversed(a), reversed(b)):
        if wrong is not None:
            parents = wrong.select("file", F.col("node").alias("_up"))
            x, y = [z.join(parents, (z["file"] == parents["file"]) & (F.floor(z["node"] / FANOUT) == parents["_up"]), "left_semi") for z in (x, y)]
        both = x.select("file", "node", F.col("digest").alias("da")).join(y.select("file", "node", F.col("digest").alias("db")), ["file", "node"], "full")
        wrong = durable(both.where(~F.col("da").eqNullSafe(F.col("db"))).select("file", "node"))
    at = wrong.select("file", F.col("node").alias("seq"))
    names = ("start", "length", "digest")
    left, right = [z.join(at, ["file", "seq"], "left_semi").select("file", "seq", *[F.col(c).alias(f"{c}_{n}") for c in names]) for n, z in (("one", one), ("two", two))]
    kind = F.when(F.col("digest_two").isNull(), "missing").when(F.col("digest_one").isNull(), "extra").otherwise("altered")
    return left.join(right, ["file", "seq"], "full").select("file", "seq", kind.alias("kind"), *[f"{c}_{n}" for c in names for n in ("one", "two")])


def _told_apart(replica: DataFrame) -> DataFrame:
    """One row for each (file, seq)."""
    rows = replica.where("file is not null and seq is not null").groupBy("file", "seq")
    return rows.agg(F.min(F.struct("digest", "length", "start")).alias("_r")).select("file", "seq", "_r.start", "_r.length", "_r.digest")


def damaged(pages: DataFrame) -> DataFrame:
    """Second replica of ``records`` in the query.  By the md5 of the url, one page in sixteen has its first character
    overwritten and one in sixteen has lost its last five.  Of each file with an even number the last record is lost, and
    each other file has a record of zeros at its end."""
    html, d = F.coalesce(F.col("html"), F.lit("")), F.substring(F.md5(F.coalesce(F.col("url"), F.lit(""))), 1, 1)
    payload = F.when(d == "0", F.concat(F.lit("~"), F.substring(html, 2, 2**31 - 1))).when(d == "1", F.substring(html, F.lit(1), F.greatest(F.length(html) - 5, F.lit(0)))).otherwise(html)
    rows = records(pages, payload)
    last = rows.groupBy("file").agg(F.max("seq").alias("seq"), F.max(F.col("start") + F.col("length")).alias("start"))
    lost = last.where("file % 2 = 0").select("file", "seq")
    more = last.where("file % 2 <> 0").select("file", (F.col("seq") + 1).alias("seq"), "start", F.lit(len(ZEROS)).cast("long").alias("length"), F.sha2(F.lit(ZEROS), 256).alias("digest"))
    return rows.join(lost, ["file", "seq"], "left_anti").select(*rows.columns).unionByName(more)


#: A record that was added by mistake.
ZEROS = "0" * 64


def replicas(pages: DataFrame) -> DataFrame:
    """The audit of ``pages`` against a copy with known damage."""
    return audit(records(pages), damaged(pages))


#: The records at fault, straight from a comparison of all records (DuckDB).
ORACLE = """
with p as (
  select page_id, coalesce(url, '') url, coalesce(html, '') html, substr(md5(coalesce(url, '')), 1, 1) d from pages
), q as (
  select *, case when d = '0' then '~' || substr(html, 2) when d = '1' then substr(html, 1, greatest(length(html) - 5, 0)) else html end other from p
), r as (
  select page_id // 1000 as file, row_number() over (partition by page_id // 1000 order by page_id, url, sha256(html)) - 1 as seq,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' as head,
    html, other from q
), s as (
  select file, seq, head || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) as a,
    head || strlen(other) || chr(13) || chr(10) || chr(13) || chr(10) || other || chr(13) || chr(10) || chr(13) || chr(10) as b from r
), t as (
  select file, seq, strlen(a) la, strlen(b) lb, sha256(a) da, sha256(b) db,
    sum(strlen(a)) over w - strlen(a) sa, sum(strlen(b)) over w - strlen(b) sb, max(seq) over (partition by file) as last from s window w as (partition by file order by seq)
)
select file, seq, 'altered' as kind, cast(sa as bigint) start_one, cast(sb as bigint) start_two, cast(la as bigint) length_one, cast(lb as bigint) length_two, da digest_one, db digest_two
from t where da <> db and not (file % 2 = 0 and seq = last)
union all select file, seq, 'missing', cast(sa as bigint), null, cast(la as bigint), null, da, null from t where file % 2 = 0 and seq = last
union all select file, seq + 1, 'extra', null, cast(sb + lb as bigint), null, 64, null, sha256(repeat('0', 64)) from t where file % 2 <> 0 and seq = last
"""
