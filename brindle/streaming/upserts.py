"""A live corpus: a stream of changed chunks, each micro-batch committed to an index as a new version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.plans.index import Files, IndexWriter
from brindle.session import stored

SCHEMA = "chunk_id string, text string, meta map<string,string>, deleted boolean, changed_at timestamp"


def changes(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """JSON lines of changes that appear in a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", max_files).json(path)


def upsert(spark: SparkSession, index: str, embedder, batch: DataFrame, batch_id: int, **knobs) -> None:
    """Commits one micro-batch: of an id's changes the last counts. A batch that was committed before is skipped."""
    files = Files(spark, index)
    mark = f"stream-{batch_id}.done"
    if files.exists(mark):
        return
    w = IndexWriter.open(spark, index, embedder) if files.versions() else IndexWriter.create(spark, index, embedder, **knobs)
    last = Window.partitionBy("chunk_id").orderBy(F.desc("changed_at"), F.desc("_m"))
    b = stored(batch.withColumn("_m", F.monotonically_increasing_id()).withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_m"))
    live = w.live().select("chunk_id", "sha256")
    same = b.where("not coalesce(deleted, false)").withColumn("sha256", F.sha2("text", 256)).join(live, ["chunk_id", "sha256"], "left_semi").select("chunk_id")
    b = stored(b.join(same, "chunk_id", "left_anti"))
    gone = b.select("chunk_id").join(live, "chunk_id", "left_semi")
    add = b.where("not coalesce(deleted, false)")
    if gone.head(1):
        w.delete_chunks(gone)
    if add.head(1):
        w.add_chunks(add.select("chunk_id", "text", F.coalesce("meta", F.create_map().cast("map<string,string>")).alias("meta"), F.unix_micros("changed_at").alias("pos")))
    w.commit()
    files.write(mark, str(w.version))


def follow(spark: SparkSession, source: str, index: str, embedder, checkpoint: str, once: bool = False, **knobs):
    """Starts the query; with ``once`` it stops when what is there now has been committed."""
    s = changes(spark, source).writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: upsert(spark, index, embedder, df, n, **knobs))
    return (s.trigger(availableNow=True) if once else s).start()
