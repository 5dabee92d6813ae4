"""Optional: layout blocks that arrive as a stream, to sentence nodes and running counts. Batch operators define the results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import build

SCHEMA = "paper_id string, index int, block string, at timestamp"


def block_stream(spark: SparkSession, path: str, files_per_trigger: int = 10) -> DataFrame:
    """JSON lines of blocks, new files as they come."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)


def streamed_nodes(blocks: DataFrame) -> DataFrame:
    """Nodes of a stream of blocks: per-block work only, so no state."""
    return build.blocks_to_nodes(build.routed(blocks)).select(*build.NODE)


def windowed_counts(blocks: DataFrame, length: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Blocks by kind and time window; what is later than the watermark is left out."""
    kinds = blocks.withWatermark("at", late).withColumn("kind", F.lower(F.get_json_object("block", "$.type")))
    return kinds.groupBy(F.window("at", length).alias("window"), "kind").count()


def write_linked(blocks: DataFrame, path: str, checkpoint: str):
    """Each micro-batch's papers as node and edge tables below path; a paper must arrive whole in one batch for its links."""

    def write(batch: DataFrame, number: int) -> None:
        nodes, edges, _ = build.blocks_to_graph(batch.drop("at"))
        nodes.write.mode("overwrite").parquet(f"{path}/nodes/batch={number}")
        edges.write.mode("overwrite").parquet(f"{path}/edges/batch={number}")

    return blocks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
