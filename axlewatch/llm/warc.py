"""WARC archives with payload dedup, and an index of all captures by external merge.

Writing: each task sorts its captures by (URL key, timestamp, page_id) and writes one gzip-per-record archive to the shared
folder. Scanning an archive gives its index entries in that order, a locally sorted run, which is a Parquet file of small row
groups there. Merging: the key space is cut into ranges at keys of a bounded sample of row groups, and each range
streams the row groups of up to FAN runs that meet it through a loser tree, one of each at a time; more runs are merged in
passes. So no task ever holds a run or a range.

Of captures with equal payloads of at least `min_bytes` bytes, that of the smallest page_id is the response and the others
are revisits of it.

Defined results: a null html is an empty payload; a null url has an empty key; a null page_id ranks last and, having no
smaller twin without an id, is a revisit where an id holds the payload; rows that repeat a response's page_id are responses;
an empty table gives an empty result. `pages` has no capture time, so a capture's timestamp is page_id seconds after
EPOCH (modulo 2 ** 31; that of a null page_id is EPOCH).
"""

from __future__ import annotations

import base64
import bisect
import datetime
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axlewatch.llm.common import new_path, settled

EPOCH = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
URL = re.compile(r"^(?:([A-Za-z][\w+.-]*):)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)(?::(\d+))?([^?#]*)(\?[^#]*)?")
#: Runs that one task merges at once; rows of a row group of a run; row groups that are sampled for the ranges.
FAN, GROUP_ROWS, SAMPLE = 256, 1000, 50_000
ENTRY = "url_key string, timestamp string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"


def url_key(url: str | None) -> str:
    """A sortable key: host labels in reverse, then path and sorted query; scheme, port, user, www and fragment go."""
    m = URL.match((url or "").strip())
    if not m or not m[2]:
        return (url or "").strip().lower()
    host = [x for x in m[2].lower().rstrip(".").split(".") if x]
    host = host[1:] if host[:1] == ["www"] and len(host) > 2 else host
    query = "&".join(sorted((m[5] or "")[1:].lower().split("&")))
    return ",".join(reversed(host)) + ")" + (m[4] or "/").lower() + ("?" + query if query else "")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, at: int, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit has no body; its payload's length and digest stand in its head."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url or '')}",
        f"WARC-Date: {(EPOCH + datetime.timedelta(seconds=at)).strftime('%Y-%m-%dT%H:%M:%SZ')}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    body = payload if refers_to is None else b""
    head += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Index fields of one record; a response's payload is measured and hashed anew."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:] if ": " in x)
    body = rest[: int(fields["Content-Length"])]
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    response = fields["WARC-Type"] == "response"
    if response and digest_of(body) != stated:
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload doesn't have its digest")
    number = lambda x: int(x.removeprefix("<urn:page:").rstrip(">")) if x and x != "<urn:page:>" else None
    return {
        "url_key": url_key(fields.get("WARC-Target-URI", "")),
        "timestamp": re.sub(r"[^0-9]", "", fields["WARC-Date"]),
        "page_id": number(fields["WARC-Record-ID"]),
        "payload_bytes": len(body) if response else int(fields["X-Payload-Length"]),
        "payload_digest": stated,
        "record_type": fields["WARC-Type"],
        "refers_to": number(fields.get("WARC-Refers-To")),
    }


def members(stream) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member of an archive, read piece by piece."""
    at, pending, unzip, out, used = 0, b"", None, [], 0
    while True:
        if not pending:
            pending = stream.read(1 << 20)
            if not pending:
                return
        if unzip is None:
            unzip, out, used = zlib.decompressobj(31), [], 0
        size = len(pending)
        out.append(unzip.decompress(pending))
        pending = unzip.unused_data
        used += size - len(pending)
        if unzip.eof:
            yield at, used, b"".join(out)
            at, unzip = at + used, None


class LoserTree:
    """Merges sorted runs: an inner node keeps the loser of its match, so the next winner takes one match a level."""

    def __init__(self, runs: list[Iterator]):
        self.runs = [iter(r) for r in runs]
        self.k = len(runs)
        self.heads = [next(r, None) for r in self.runs]
        self.tree = [-1] * self.k
        for i in range(self.k):
            self.climb(i)

    def before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x[0], a) < (y[0], b))

    def climb(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other == -1:
                self.tree[node] = winner  # waits for its match while the tree is built
                return
            if self.before(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator:
        while self.k and self.heads[w := self.tree[0]] is not None:
            yield self.heads[w][1]
            self.heads[w] = next(self.runs[w], None)
            self.climb(w)


def captures(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, payload, refers_to. Digests alone are grouped; a frequent payload is one
    row of its group after partial aggregation, and payloads are joined by page_id, which no page shares with many."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("sha", F.unhex(F.sha1("payload")))
    seen = p.where(F.length("payload") >= min_bytes).select("page_id", "sha")
    first = seen.groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select(F.col("sha").alias("f_sha"), "first").repartition("f_sha")
    again = seen.join(first, F.col("sha") == F.col("f_sha")).where(~F.col("page_id").eqNullSafe(F.col("first")))
    again = settled(again.select(F.col("page_id").alias("r_page"), F.col("sha").alias("r_sha"), F.col("first").alias("refers_to")).distinct(), "warc-revisits")
    return p.join(again, F.col("page_id").eqNullSafe(F.col("r_page")) & (F.col("sha") == F.col("r_sha")), "left").select("page_id", "url", "payload", "refers_to")


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """rows(page_id, url, payload, refers_to) -> the archives' paths. An archive of a task that failed is never listed."""
    key = F.udf(url_key, "string", useArrow=True)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        out, path = None, f"{base}/{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(i) for i in range(4)), strict=True):
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(path, compression=None)
                i = page_id.as_py()
                zip_one = zlib.compressobj(1, zlib.DEFLATED, 31)
                out.write(zip_one.compress(record(i, url.as_py(), (i or 0) % (1 << 31), payload.as_py(), refers_to.as_py())) + zip_one.flush())
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path.rsplit("/", 1)[1]])], names=["archive"])

    at = F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1 << 31))
    ordered = rows.withColumn("k", key("url")).withColumn("at", at).sortWithinPartitions("k", "at", F.col("page_id").asc_nulls_last()).select("page_id", "url", "payload", "refers_to")
    return ordered.mapInArrow(each, "archive string")


def order(entry: dict) -> tuple:
    """Where an entry stands in the index."""
    return entry["url_key"], entry["timestamp"], entry["page_id"] is None, entry["page_id"] or 0


class RunWriter:
    """Writes sorted entries as a run: a Parquet file of row groups of GROUP_ROWS rows, with the URL keys' least and greatest in its footer."""

    def __init__(self, store, path: str, schema: pa.Schema):
        import pyarrow.parquet as pq

        self.out = store.open_output_stream(path)
        self.writer, self.schema, self.rows = pq.ParquetWriter(self.out, schema, compression="zstd"), schema, []
        self.firsts: list[dict] = []

    def put(self, row: dict) -> None:
        self.rows.append(row)
        if len(self.rows) == GROUP_ROWS:
            self.flush()

    def flush(self) -> None:
        if self.rows:
            self.firsts.append(self.rows[0])
            self.writer.write_batch(pa.RecordBatch.from_pylist(self.rows, schema=self.schema))
            self.rows = []

    def close(self) -> None:
        self.flush()
        self.writer.close()
        self.out.close()


def read_run(store, path: str, low: tuple | None, high: tuple | None, places: list[int] | None = None) -> Iterator[tuple[tuple, dict]]:
    """(order, entry) of a run's entries from low on and before high, a row group at a time: those at the given places, or those that the footer doesn't rule out."""
    import pyarrow.parquet as pq

    with store.open_input_file(path) as f:
        run = pq.ParquetFile(f)
        for g in range(run.num_row_groups) if places is None else sorted(places):
            keys = run.metadata.row_group(g).column(0).statistics
            if keys is not None and keys.has_min_max and ((low is not None and keys.max < low[0]) or (high is not None and keys.min > high[0])):
                continue
            for row in run.read_row_group(g).to_pylist():
                at = order(row)
                if (low is None or at >= low) and (high is None or at < high):
                    yield at, row


def scan_archives(archives: DataFrame, folder: str) -> DataFrame:
    """archives(archive) -> run, and the place and first url_key, timestamp and page_id of each of its row groups. Writes a run for each archive."""
    schema = T._parse_datatype_string("run string, place int, url_key string, timestamp string, page_id long")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                run = f"{uuid.uuid4().hex}.run"
                writer = RunWriter(store, f"{base}/{run}", arrow)
                with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for offset, length, raw in members(stream):
                        writer.put(parse(raw) | {"archive": name, "offset": offset, "length": length})
                writer.close()
                yield pa.RecordBatch.from_pylist([{"run": run, "place": i, **{c: x[c] for c in ("url_key", "timestamp", "page_id")}} for i, x in enumerate(writer.firsts)], schema=out)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, out = to_arrow_schema(T._parse_datatype_string(ENTRY)), to_arrow_schema(schema)
    return archives.mapInArrow(each, schema)


def range_cuts(groups: DataFrame, ranges: int) -> list[tuple]:
    """Places that cut the key space into ranges of about as many row groups, from at most about SAMPLE of them."""
    step = groups.count() // SAMPLE + 1
    rows = groups.where(F.pmod(F.xxhash64("run", "url_key", "timestamp", "page_id"), F.lit(step)) == 0).drop("run", "place").collect()
    places = sorted({order(r.asDict()) for r in rows})
    return [places[len(places) * i // ranges] for i in range(1, min(ranges, len(places)))]


def met_ranges(groups: DataFrame, cuts: list[tuple]) -> DataFrame:
    """run, job, places: the ranges between the cuts that a run's row groups meet, with the places of those row groups in its file.

    A row group reaches from its first key to the first key of the next one of its run, that one included; the last of a run has no upper end.
    """
    place = F.struct("url_key", "timestamp", F.col("page_id").isNull().alias("none"), F.coalesce("page_id", F.lit(0)).alias("page"))
    ahead = Window.partitionBy("run").orderBy("place")

    @F.pandas_udf("array<long>")
    def ranges(first: pd.DataFrame, following: pd.DataFrame, last: pd.Series) -> pd.Series:
        out = []
        for a, b, end in zip(first.itertuples(index=False, name=None), following.itertuples(index=False, name=None), last, strict=True):
            low = bisect.bisect_right(cuts, a)
            high = len(cuts) if end else bisect.bisect_right(cuts, b)
            out.append(list(range(low, high + 1)))
        return pd.Series(out)

    g = groups.select("run", "place", place.alias("first")).withColumn("next", F.lead("first").over(ahead))
    g = g.withColumn("last", F.col("next").isNull()).withColumn("next", F.coalesce("next", "first"))
    return g.withColumn("job", F.explode(ranges("first", "next", "last"))).groupBy("run", "job").agg(F.collect_list("place").alias("places"))


def merged_runs(jobs: DataFrame, folder: str, keep: bool) -> DataFrame:
    """jobs(job, low, high, runs: run and the places of its row groups, or NULL for all of them) -> the entries of each job in order, with `position` inside it; or, to keep them, the run (job, run) that each job writes."""
    entry = ENTRY + ", position long"
    schema = T._parse_datatype_string("job long, run string" if keep else entry)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for job in batch.to_pylist():
                low, high = (None if job[c] is None else order(job[c]) for c in ("low", "high"))
                tree = LoserTree([read_run(store, f"{base}/{r['run']}", low, high, r["places"]) for r in sorted(job["runs"], key=lambda r: r["run"])])
                if keep:
                    run = f"{uuid.uuid4().hex}.run"
                    writer = RunWriter(store, f"{base}/{run}", plain)
                    for row in tree:
                        writer.put(row)
                    writer.close()
                    yield pa.RecordBatch.from_pylist([{"job": job["job"], "run": run}], schema=arrow)
                    continue
                part: list[dict] = []
                for i, row in enumerate(tree):
                    part.append({**row, "position": i})
                    if len(part) == 5000:
                        yield pa.RecordBatch.from_pylist(part, schema=arrow)
                        part = []
                yield pa.RecordBatch.from_pylist(part, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, plain = to_arrow_schema(schema), to_arrow_schema(T._parse_datatype_string(ENTRY))
    return jobs.repartitionByRange(max(jobs.count(), 1), "job").mapInArrow(each, schema)


def merge_runs(groups: DataFrame, folder: str, ranges: int) -> DataFrame:
    """The index entries of all runs (groups: run and the first key of each row group), globally ordered by (url_key, timestamp, page_id)."""
    spark = groups.sparkSession
    cuts = range_cuts(groups, ranges)
    place = "struct<url_key:string,timestamp:string,page_id:long>"
    as_place = lambda x: None if x is None else (x[0], x[1], None if x[2] else x[3])
    bounds = [(j, as_place(a), as_place(b)) for j, (a, b) in enumerate(zip([None, *cuts], [*cuts, None], strict=True))]
    spans = F.broadcast(spark.createDataFrame(bounds, f"job long, low {place}, high {place}"))  # a row per range
    runs = settled(met_ranges(groups, cuts), "warc-met")
    number = runs.groupBy("job").count().agg(F.max("count")).first()[0] or 0
    gathered = F.collect_list(F.struct("run", "places")).alias("runs")  # FAN runs or so; their row groups' places are numbers
    while number > FAN:  # a pass merges FAN runs to one for each range
        parts = -(-number // FAN)
        part = runs.withColumn("part", F.pmod(F.xxhash64("run"), F.lit(parts)))
        jobs = part.join(spans.withColumnRenamed("job", "s_job"), F.col("job") == F.col("s_job")).groupBy("s_job", "part", "low", "high").agg(gathered)
        jobs = settled(jobs.select((F.col("s_job") * parts + F.col("part")).alias("job"), "low", "high", "runs"), "warc-jobs")
        runs = settled(merged_runs(jobs, folder, True), "warc-merged").select("run", F.floor(F.col("job") / parts).alias("job"), F.lit(None).cast("array<int>").alias("places"))
        number = parts
    jobs = runs.join(spans.withColumnRenamed("job", "s_job"), F.col("job") == F.col("s_job")).groupBy(F.col("s_job").alias("job"), "low", "high").agg(gathered)
    return merged_runs(settled(jobs, "warc-jobs"), folder, False)


def capture_index(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes pages as archives, reads them back and merges their indexes."""
    spark: SparkSession = pages.sparkSession
    folder = new_path(spark, "warc")
    archives = settled(write_archives(captures(pages, min_bytes), folder), "warc-list")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = settled(scan_archives(archives.repartition(tasks), folder), "warc-runs")
    return merge_runs(groups, folder, tasks)
