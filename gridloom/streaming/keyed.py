"""Stateful streams: order within a key, and ancestors kept up to date while edges change."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridloom.operators import hierarchy, impact

ORDERED = "id string, key string, ts timestamp, number long, late boolean"


def ordered(stream: DataFrame, lateness: str = "10 minutes", forget_ms: int = 86_400_000) -> DataFrame:
    """Messages (id, key, ts) with their number within their key, in order of arrival and, within a micro-batch, of time;
    late: a later message of the key has been numbered before.

    The state of a key is its count and its latest time; it goes `forget_ms` after that time, so it does not grow with
    all keys ever seen. Its numbers then begin anew."""

    def number(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, latest = state.get if state.exists else (0, -(1 << 62))
        rows = pd.concat(batches).sort_values(["ts", "id"], kind="stable")
        at = rows["ts"].astype("datetime64[ns]").astype("int64") // 1000
        rows = rows.assign(number=range(count + 1, count + 1 + len(rows)), late=(at < latest).to_numpy())
        latest = max(latest, int(at.max()))
        state.update((count + len(rows), latest))
        state.setTimeoutTimestamp(max(latest // 1000 + forget_ms, state.getCurrentWatermarkMs() + 1))
        yield rows[["id", "key", "ts", "number", "late"]]

    rows = stream.select(F.col("id").cast("string").alias("id"), F.col("key").cast("string").alias("key"), "ts").withWatermark("ts", lateness)
    return rows.groupBy("key").applyInPandasWithState(number, ORDERED, "count long, latest long", "append", GroupStateTimeout.EventTimeTimeout)


def latest_version(spark, path: str) -> int:
    """The last version that is complete."""
    return spark.read.option("recursiveFileLookup", True).parquet(f"{path}/done").agg(F.max("version")).first()[0]


def _versions(changes: DataFrame, first: dict[str, DataFrame], merge, path: str, checkpoint: str):
    """Start a query that writes a version of tables for each batch of changes: first is version 0, merge(batch, tables of the
    version before) makes the next one. A batch that runs again writes the same version again."""
    spark = changes.sparkSession

    def write(version: int, tables: dict[str, DataFrame]) -> None:
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{path}/{name}/version={version}")
        spark.createDataFrame([(version,)], "version int").write.mode("overwrite").parquet(f"{path}/done/v{version}")

    def take(batch: DataFrame, number: int) -> None:
        write(number + 1, merge(batch, {name: spark.read.parquet(f"{path}/{name}/version={number}") for name in first}))

    write(0, first)
    return changes.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _replaced(old: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The edges after a batch: those of a key that it names are the batch's."""
    return old.join(batch.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(batch.select(*old.columns).distinct())


def refresh_ancestors(changes: DataFrame, edges: DataFrame, path: str, checkpoint: str):
    """Start a query that keeps the ancestors of all concepts while edges change.

    changes: stream of (child_id, parent_id, relation); a child's edges are replaced by those of the batch that names it.
    edges: the hierarchy before. Each batch writes `edges` and `ancestors` under path as a version of its own, from the
    version before it, and walks again only from concepts at or below a changed child."""

    def merge(batch: DataFrame, old: dict[str, DataFrame]) -> dict[str, DataFrame]:
        new = _replaced(old["edges"], batch, "child_id")
        return {"edges": new, "ancestors": hierarchy.refreshed(old["ancestors"], new, batch.select(F.col("child_id").alias("concept_id")).distinct())}

    first = edges.select("child_id", "parent_id", "relation").distinct()
    return _versions(changes, {"edges": first, "ancestors": hierarchy.closure(first)}, merge, path, checkpoint)


def refresh_downstream(changes: DataFrame, nodes: DataFrame, edges: DataFrame, path: str, checkpoint: str, max_depth: int = 10):
    """Start a query that keeps sketches of what each node reaches (`impact.downstream_sketches`) while edges change.

    changes: stream of (src, dst, edge_type, criticality, mitigated); a source's edges are replaced by those of the batch that
    names it. nodes (column node) and edges: the graph before; nodes that a batch names are added. Each batch writes
    `edges` and `sketches` as a version of its own, and makes only those sketches anew whose node leads to a changed source."""

    def merge(batch: DataFrame, old: dict[str, DataFrame]) -> dict[str, DataFrame]:
        new = _replaced(old["edges"], batch, "src")
        ends = batch.select(F.col("src").alias("node")).unionByName(batch.select(F.col("dst").alias("node"))).distinct()
        return {"edges": new, "sketches": impact.refreshed_sketches(old["sketches"], ends, new, batch.select(F.col("src").alias("node")), max_depth)}

    first = edges.select("src", "dst", "edge_type", "criticality", "mitigated").distinct()
    return _versions(changes, {"edges": first, "sketches": impact.downstream_sketches(nodes, first, max_depth)}, merge, path, checkpoint)


def downstream(spark, path: str, max_depth: int = 10) -> DataFrame:
    """(node, downstream) of the newest version."""
    return impact.estimates(spark.read.parquet(f"{path}/sketches/version={latest_version(spark, path)}"), max_depth)


def ancestors(spark, path: str) -> DataFrame:
    """The newest version."""
    return spark.read.parquet(f"{path}/ancestors/version={latest_version(spark, path)}")
