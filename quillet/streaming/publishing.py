"""Publishing as a stream: each batch of requests and uploads becomes one version that readers see as a whole.

The store is a log in a folder that all executors share: ``shares``, ``assets`` and ``outcomes`` hold what each batch
changed, in a folder per batch, and ``commits`` names the batches that are whole. A batch writes its changes first and its
commit last; readers take what the last commit covers. So a batch that fails leaves nothing to see, one that comes again
after a failure overwrites what it had written, and one that was committed changes nothing. Work grows with the batch: only
shares and assets of its tokens are looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillet.operators import share
from quillet.operators.components import cut_lineage

#: A request has kind publish (owner_hash, title, manifest, fresh) or upload (owner_hash, hash, bytes), for a token.
REQUESTS = "id long, seq long, kind string, token string, owner_hash string, title string, manifest string, fresh string, hash string, bytes binary"
_SHARES = "token string, owner_hash string, title string, manifest string, created_at timestamp, updated_at timestamp"
_ASSETS = "token string, hash string, bytes binary"
_LOGS = {"shares": _SHARES + ", gone boolean, batch long", "assets": _ASSETS + ", gone boolean, batch long", "outcomes": "id long, kind string, status int, token string, batch long", "commits": "batch long"}


def create_store(spark: SparkSession, root: str) -> None:
    """An empty store: its first commit is batch -1."""
    for name, schema in _LOGS.items():
        rows = [(-1,)] if name == "commits" else []
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{root}/{name}/b=-1")


def _log(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(_LOGS[name]).option("recursiveFileLookup", "true").parquet(f"{root}/{name}")


def committed(spark: SparkSession, root: str) -> int:
    """The last batch that is whole."""
    return _log(spark, root, "commits").agg(F.max("batch")).first()[0]


def read_store(spark: SparkSession, root: str, at: int | None = None) -> dict[str, DataFrame]:
    """shares, assets and outcomes as of a commit, the last one if not said."""
    at = committed(spark, root) if at is None else at
    out = {}
    for name, keys in (("shares", ["token"]), ("assets", ["token", "hash"])):
        log = _log(spark, root, name).where(F.col("batch") <= at)
        rest = [c for c in log.columns if c not in (*keys, "batch")]
        last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).where("NOT r.gone")
        out[name] = last.select(*keys, *[f"r.{c}" for c in rest if c != "gone"])
    return out | {"outcomes": _log(spark, root, "outcomes").where(F.col("batch") <= at)}


def _parsed(shares: DataFrame) -> DataFrame:
    return shares.select("token", share.read_manifest(F.col("manifest")).alias("m"))


def apply_batch(requests: DataFrame, batch: int, root: str, now: Column) -> None:
    """One batch: publications first, then uploads for what the shares name after them."""
    spark = requests.sparkSession
    last = committed(spark, root)
    if batch <= last:
        return
    requests = cut_lineage(requests)
    store = read_store(spark, root, last)
    tokens = requests.select(F.explode(F.array("token", "fresh")).alias("token")).where("token IS NOT NULL").distinct()
    held = cut_lineage(store["shares"].join(tokens, "token", "left_semi"))
    after, said = share.publish(held, requests.where("kind = 'publish'"), now)
    after, said = cut_lineage(after), cut_lineage(said)
    # What the batch's shares no longer name goes; uploads come in for what they name and have not got.
    changed = after.join(said.where("status IN (200, 201)").select("token").distinct(), "token", "left_semi")
    stored = store["assets"].join(tokens, "token", "left_semi")
    named = cut_lineage(share.referenced(_parsed(after)).select("token", "hash").distinct())
    dropped = stored.join(changed.select("token"), "token", "left_semi").join(named, ["token", "hash"], "left_anti")
    sent = requests.where("kind = 'upload'").select("id", "seq", "token", "hash", "owner_hash", "bytes")
    judged = sent.join(after.select("token", F.col("owner_hash").alias("holder")), "token", "left").join(named.withColumn("named", F.lit(True)), ["token", "hash"], "left")
    status = share.asset_status(F.col("holder").isNotNull(), F.col("holder").eqNullSafe(F.col("owner_hash")), F.octet_length("bytes"), F.coalesce(F.sha2("bytes", 256) == F.col("hash"), F.lit(False)), F.coalesce("named", F.lit(False)))
    judged = cut_lineage(judged.withColumn("status", status))
    good = judged.where("status = 200").join(stored.select("token", "hash"), ["token", "hash"], "left_anti")
    added = good.groupBy("token", "hash").agg(F.min_by("bytes", F.struct("seq", "id")).alias("bytes"))
    flagged = lambda df, gone: df.withColumns({"gone": F.lit(gone), "batch": F.lit(batch).cast("long")})
    written = {
        "shares": flagged(changed, False),
        "assets": flagged(added, False).unionByName(flagged(dropped.select("token", "hash", F.lit(None).cast("binary").alias("bytes")), True)),
        "outcomes": said.select("id", F.lit("publish").alias("kind"), "status", "token").unionByName(judged.select("id", F.lit("upload").alias("kind"), "status", "token")).withColumn("batch", F.lit(batch).cast("long")),
        "commits": spark.range(1).select(F.lit(batch).cast("long").alias("batch")),
    }
    for name, rows in written.items():  # the commit comes last
        rows.write.mode("overwrite").parquet(f"{root}/{name}/b={batch}")


def publish_stream(requests: DataFrame, root: str, checkpoint: str, now: Column | None = None) -> StreamingQuery:
    """A stream of REQUESTS into a store; ``now`` is the time of a batch if not said."""
    run = lambda df, batch: apply_batch(df, batch, root, F.current_timestamp() if now is None else now)
    return requests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
