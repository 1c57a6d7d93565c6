"""Queries of change detection, incremental maintenance, the file stream, and search from end to end."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.functions import text as T
from rankweave.operators import incremental, index, merkle
from rankweave.sources import io
from rankweave.sources.io import table
from rankweave.streaming import debounce, deliver, watch

from .folders import settled, working_folder
from .search import search
from .sql import ABBR, tokens

ORDER_COLUMNS = ["o_custkey", "o_orderpriority", "o_orderstatus", "price"]


def _orders(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots: some orders went, some changed their price, some came."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    old = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", cents.alias("price"))
    kept = old.where("o_orderkey % 97 <> 0").withColumn("price", F.when(F.col("o_orderkey") % 89 == 0, F.col("price") + 1).otherwise(F.col("price")))
    came = old.where("o_orderkey % 53 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 100_000_000)
    return old, kept.unionByName(came)


ORDERS_SQL = """old AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) AS price FROM orders),
new AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus, CASE WHEN o_orderkey % 89 = 0 THEN price + 1 ELSE price END AS price FROM old WHERE o_orderkey % 97 <> 0
  UNION ALL SELECT o_orderkey + 100000000, o_custkey, o_orderpriority, o_orderstatus, price FROM old WHERE o_orderkey % 53 = 0),
ha AS (SELECT o_orderkey AS id, sha256(concat_ws('|', o_custkey, o_orderpriority, o_orderstatus, price)) AS hash FROM old),
hb AS (SELECT o_orderkey AS id, sha256(concat_ws('|', o_custkey, o_orderpriority, o_orderstatus, price)) AS hash FROM new),
ch AS (SELECT coalesce(ha.id, hb.id) AS id, CASE WHEN ha.id IS NULL THEN 'new' WHEN hb.id IS NULL THEN 'deleted' WHEN ha.hash <> hb.hash THEN 'changed' ELSE 'unchanged' END AS change FROM ha FULL OUTER JOIN hb ON ha.id = hb.id)"""


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _orders(spark, sf)
    return incremental.classify(incremental.ledger(old, "o_orderkey", ORDER_COLUMNS), incremental.ledger(new, "o_orderkey", ORDER_COLUMNS))


def row_hash_cdc(spark: SparkSession, sf: str) -> DataFrame:
    return _changes(spark, sf)


def merkle_changes(spark: SparkSession, sf: str) -> DataFrame:
    """What differs between two snapshots of few changes, from the buckets whose hashes differ."""
    old = _orders(spark, sf)[0]
    moved = old.where("o_orderkey % 997 <> 0").withColumn("price", F.when(F.col("o_orderkey") % 1499 == 1, F.col("price") + 1).otherwise(F.col("price")))
    new = moved.unionByName(old.where("o_orderkey % 1999 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 100_000_000))
    base = f"{working_folder(spark)}/trees-{uuid.uuid4().hex}"
    for rows, name in ((old, "old"), (new, "new")):
        merkle.write_tree(rows, "o_orderkey", ORDER_COLUMNS, f"{base}/{name}", buckets=256)
    return merkle.changes(spark, f"{base}/old", f"{base}/new")


MERKLE_SQL = """SELECT o_orderkey AS id, 'deleted' AS change FROM orders WHERE o_orderkey % 997 = 0 UNION ALL SELECT o_orderkey, 'changed' FROM orders WHERE o_orderkey % 1499 = 1 AND o_orderkey % 997 <> 0
UNION ALL SELECT o_orderkey + 100000000, 'new' FROM orders WHERE o_orderkey % 1999 = 0"""


def row_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Short hashes of the index's ledger."""
    return incremental.ledger(_orders(spark, sf)[1], "o_orderkey", ORDER_COLUMNS, 16)


def cdc_summary(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.summary(_changes(spark, sf))


def key_changes(spark: SparkSession, sf: str) -> DataFrame:
    """New and deleted keys by anti joins."""
    old, new = (df.select(F.col("o_orderkey").alias("id")) for df in _orders(spark, sf))
    return incremental.new_keys(new, old).withColumn("change", F.lit("new")).unionByName(incremental.deleted_keys(new, old).withColumn("change", F.lit("deleted")))


def table_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _orders(spark, sf)
    one = lambda df, name: incremental.fingerprint(df, ["o_orderkey", *ORDER_COLUMNS]).select(F.lit(name).alias("snapshot"), "n", "a", "b")
    return one(old, "old").unionByName(one(new, "new"))


FINGERPRINT_SQL = f"""WITH {ORDERS_SQL}, u AS (SELECT 'old' AS snapshot, * FROM old UNION ALL SELECT 'new', * FROM new),
h AS (SELECT snapshot, md5(sha256(concat_ws('|', o_custkey, o_orderkey, o_orderpriority, o_orderstatus, price))) AS h FROM u)
SELECT snapshot, count(*) AS n, CAST(sum(CAST('0x' || substr(h, 1, 8) AS BIGINT)) AS BIGINT) AS a, CAST(sum(CAST('0x' || substr(h, 9, 8) AS BIGINT)) AS BIGINT) AS b FROM h GROUP BY snapshot"""


def _documents(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    old = table(spark, sf, "documents").select("doc_id", "text")
    kept = old.where("doc_id % 11 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" newly added words"))).otherwise(F.col("text")))
    return old, kept.unionByName(old.where("doc_id % 13 = 0").withColumn("doc_id", F.col("doc_id") + 10_000_000))


NEW_DOCS_SQL = """docs AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || ' newly added words' ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0
  UNION ALL SELECT doc_id + 10000000, text FROM documents WHERE doc_id % 13 = 0)"""


def _updated(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Postings and document frequencies after an incremental update."""
    old, new = _documents(spark, sf)
    post = lambda df: index.token_rows(df, "doc_id", "text").groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    before = settled(post(old))
    changes = settled(incremental.classify(incremental.ledger(old, "doc_id", ["text"]), incremental.ledger(new, "doc_id", ["text"])))
    fresh = settled(post(incremental.touched(new, changes, "doc_id")))
    gone = changes.where("change in ('changed', 'deleted')").select(F.col("id").alias("doc_id"))
    removed = before.join(gone, "doc_id", "left_semi")
    df = before.groupBy("term").agg(F.count("*").alias("df"))
    return incremental.apply_delta(before, changes, fresh), incremental.adjust_term_stats(df, removed, fresh)


def incremental_index(spark: SparkSession, sf: str) -> DataFrame:
    """Postings after the update, summed up by document; the same as building anew."""
    return _updated(spark, sf)[0].groupBy("doc_id").agg(F.sum("tf").alias("dl"), F.count("*").alias("terms"))


def incremental_terms(spark: SparkSession, sf: str) -> DataFrame:
    return _updated(spark, sf)[1]


REBUILT = f"WITH {ABBR}, {NEW_DOCS_SQL}, {tokens('docs')}, post AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY doc_id, term)"


def file_stream_cdc(spark: SparkSession, sf: str) -> DataFrame:
    """Two files of orders arrive one after the other; the target that the stream maintains is the new snapshot without deletions."""
    old, new = _orders(spark, sf)
    base = f"{working_folder(spark)}/watch-{uuid.uuid4().hex}"
    source, target = f"{base}/in", f"{base}/target"
    schema = old.schema.simpleString().removeprefix("struct<").removesuffix(">")
    columns = ["o_orderkey", *ORDER_COLUMNS]

    def apply(changes: DataFrame, rows: DataFrame) -> None:
        known = io.load_index(spark, target)["orders"] if io.manifest(spark, target) else rows.limit(0)
        io.save_index({"orders": known.join(rows.select("o_orderkey"), "o_orderkey", "left_anti").unionByName(rows.select(*known.columns))}, target)

    for snapshot in (old, new):
        snapshot.select(*columns).write.mode("append").parquet(source)
        watch.upsert_stream(spark, source, ", ".join(f"{n} {t}" for n, t in snapshot.select(*columns).dtypes) if schema else "", "o_orderkey", ORDER_COLUMNS, f"{base}/state", f"{base}/checkpoint", apply).awaitTermination()
    return io.load_index(spark, target)["orders"].select(*columns)


STREAM_SQL = f"WITH {ORDERS_SQL} SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus, price FROM new UNION ALL SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus, price FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new)"


QUIET_HOURS, GAP_HOURS, JITTER_HOURS = 6, 12, 30


def _event_stream(spark: SparkSession, sf: str, files: int = 4) -> tuple[DataFrame, str]:
    """Events as a stream of files, out of order by up to JITTER_HOURS, and a last file whose one event, of no user, moves the clock on."""
    base = f"{working_folder(spark)}/events-{uuid.uuid4().hex}"
    rows = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    low, high = rows.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    # An event arrives up to the jitter after its time; files hold equal spans of arrival.
    span = (high - low).total_seconds() / files
    arrival = F.unix_seconds("ts") - int(low.timestamp()) + F.pmod(F.xxhash64("event_id"), F.lit(JITTER_HOURS * 3600))
    placed = settled(rows.withColumn("file", F.least(F.floor(arrival / max(span, 1)), F.lit(files - 1)).cast("int")))
    for i in range(files):
        placed.where(F.col("file") == i).drop("file").coalesce(1).write.mode("append").parquet(f"{base}/in")
    clock = rows.limit(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit(high + timedelta(days=30)).cast(rows.schema["ts"].dataType).alias("ts"), F.lit(-1).cast(rows.schema["user_id"].dataType).alias("user_id"), "event_type")
    clock.coalesce(1).write.mode("append").parquet(f"{base}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in"), base


def _streamed(found: DataFrame, base: str) -> DataFrame:
    """Run a stream to the end of its files, and read what it put out."""
    found.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start(f"{base}/out").awaitTermination()
    return found.sparkSession.read.schema(found.schema).parquet(f"{base}/out")


def burst_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's bursts of events, put out once after six quiet hours, with the last event."""
    events, base = _event_stream(spark, sf)
    found = _streamed(debounce.quiet_bursts(events, "user_id", "ts", f"{QUIET_HOURS} hours", f"{JITTER_HOURS + 1} hours"), base)
    return found.where("user_id >= 0").select("user_id", *[F.unix_micros(c).alias(c) for c in ("first", "last")], "n", F.col("change.event_type").alias("event_type"))


BURST_SQL = f"""WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL {QUIET_HOURS} HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS burst FROM m)
SELECT user_id, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last, count(*) AS n, arg_max(event_type, ts) AS event_type FROM g GROUP BY user_id, burst"""


def leading_edge_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events that apply at once, none within twelve hours after another that did."""
    events, base = _event_stream(spark, sf)
    return _streamed(debounce.leading_edges(events, "user_id", "ts", timedelta(hours=GAP_HOURS), f"{JITTER_HOURS + 1} hours"), base).where("user_id >= 0").select("user_id", F.unix_micros("ts").alias("at"))


LEADING_SQL = f"""WITH RECURSIVE e AS (SELECT DISTINCT user_id, ts FROM events),
nx AS (SELECT a.user_id, a.ts, min(b.ts) AS next FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND b.ts >= a.ts + INTERVAL {GAP_HOURS} HOUR GROUP BY a.user_id, a.ts),
r AS (SELECT user_id, min(ts) AS ts FROM e GROUP BY user_id UNION ALL SELECT nx.user_id, nx.next FROM r JOIN nx ON nx.user_id = r.user_id AND nx.ts = r.ts WHERE nx.next IS NOT NULL)
SELECT user_id, epoch_us(ts) AS at FROM r"""


def sync_retries(spark: SparkSession, sf: str) -> DataFrame:
    """Orders sent to a sink that fails: every fifth twice, every 41st always. What is delivered with which try, and what is given up."""
    base = f"{working_folder(spark)}/sync-{uuid.uuid4().hex}"
    orders, row = _orders(spark, sf)[0], "o_orderkey long, o_custkey long, o_orderpriority string, price long"
    orders.select("o_orderkey", "o_custkey", "o_orderpriority", "price").write.parquet(f"{base}/in")

    def send(order: dict, attempt: int) -> None:
        if order["o_orderkey"] % 41 == 0 or order["o_orderkey"] % 5 == 0 and attempt < 3:
            raise ConnectionError("busy")

    hour = iter(range(1 << 30)).__next__
    deliver.deliver_stream(spark, f"{base}/in", row, "o_orderkey", f"{base}/state", f"{base}/checkpoint", send, clock=hour).awaitTermination()
    deliver.drain(spark, row, "o_orderkey", f"{base}/state", send, clock=hour, sleep=lambda _: None)
    found = deliver.relations(spark, f"{base}/state", row)
    one = lambda name: found[name].select("row.o_orderkey", "row.price", F.lit(name).alias("state"), "attempt")
    return one("done").unionByName(one("quarantine")).unionByName(one("waiting"))


RETRIES_SQL = f"""WITH {ORDERS_SQL} SELECT o_orderkey, price, CASE WHEN o_orderkey % 41 = 0 THEN 'quarantine' ELSE 'done' END AS state, CAST(CASE WHEN o_orderkey % 41 = 0 OR o_orderkey % 5 = 0 THEN 3 ELSE 1 END AS INTEGER) AS attempt FROM old"""


def index_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Relations saved twice as versions and loaded again."""
    path = f"{working_folder(spark)}/index-{uuid.uuid4().hex}"
    docs = table(spark, sf, "documents").select("doc_id", "text")
    relations = index.build(docs, "doc_id", T.simple_tokens(F.col("text")))
    io.save_index({"doc_stats": relations["doc_stats"]}, path)
    io.save_index({"doc_stats": relations["doc_stats"].withColumn("dl", F.col("dl") * 2)}, path, {"scale": 2})
    return io.load_index(spark, path, {"skill_postings": "skill string, doc_id long, weight double"})["doc_stats"]


ROUND_TRIP_SQL = """SELECT doc_id, CAST(2 * len(w) AS BIGINT) AS dl FROM (SELECT doc_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) > 1) AS w FROM documents) WHERE len(w) > 0"""

QUERIES = {
    "row_hash_cdc": (row_hash_cdc, f"WITH {ORDERS_SQL} SELECT id, change FROM ch"),
    "merkle_changes": (merkle_changes, MERKLE_SQL),
    "row_hashes": (row_hashes, f"WITH {ORDERS_SQL} SELECT id, substr(hash, 1, 16) AS hash FROM hb"),
    "cdc_summary": (cdc_summary, f"WITH {ORDERS_SQL} SELECT change, count(*) AS n FROM ch GROUP BY change"),
    "key_changes": (key_changes, f"WITH {ORDERS_SQL} SELECT id, change FROM ch WHERE change IN ('new', 'deleted')"),
    "table_fingerprint": (table_fingerprint, FINGERPRINT_SQL),
    "incremental_index": (incremental_index, f"{REBUILT} SELECT doc_id, CAST(sum(tf) AS BIGINT) AS dl, count(*) AS terms FROM post GROUP BY doc_id"),
    "incremental_terms": (incremental_terms, f"{REBUILT} SELECT term, count(*) AS df FROM post GROUP BY term"),
    "burst_stream": (burst_stream, BURST_SQL),
    "leading_edge_stream": (leading_edge_stream, LEADING_SQL),
    "sync_retries": (sync_retries, RETRIES_SQL),
    "index_round_trip": (index_round_trip, ROUND_TRIP_SQL),
    "file_stream_cdc": (file_stream_cdc, STREAM_SQL),
    "search_end_to_end": (search, None),
}
