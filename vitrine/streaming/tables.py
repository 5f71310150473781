"""Tables kept current by micro-batches.

A batch adds its rows as one part and commits a small manifest that lists the live parts. Parts of like numbers of batches
are merged as they meet, so a table of n batches has at most log2(n) + 1 parts and a row is rewritten as often. A manifest
appears whole or not at all, names everything a reader needs, and leaves earlier ones as they are; a batch that is run
again after a failure starts from the manifest before it, whatever its first run left behind.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from ..operators.similarity import index_matches
from ..sources.index import build_index
from .jobs import job_state, merge_states


def _place(spark: SparkSession, path: str):
    """The file system of ``path`` and the path in it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _names(spark: SparkSession, path: str) -> list[str]:
    files, place = _place(spark, path)
    return [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """The batch's partition, in place of what an earlier run of the batch wrote, also where it has no rows now."""
    files, place = _place(df.sparkSession, f"{path}/batch_id={batch_id}")
    files.delete(place, True)
    df.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("append").partitionBy("batch_id").parquet(path)


class BatchTable:
    """Rows of micro-batches, combined by ``merge`` (associative; applying it again changes nothing).

    Manifests of the last two batches are kept, since the last batch may be run again, and with them the parts that they
    name; everything older is deleted after each commit.
    """

    def __init__(self, path: str, merge: Callable[[DataFrame], DataFrame]):
        self.path, self.merge = path.rstrip("/"), merge

    def _manifests(self, spark: SparkSession) -> list[tuple[int, str]]:
        """(batch, file name) of the committed manifests, oldest first; of the runs of one batch the last one comes last."""
        found = [n for n in _names(spark, f"{self.path}/manifests") if n.endswith(".json") and not n.startswith((".", "_"))]
        return sorted((int(n.split("-")[0]), n) for n in found)

    def _manifest(self, spark: SparkSession, before: int | None) -> dict | None:
        """The newest manifest of batches before ``before`` (None: of any)."""
        usable = [n for b, n in self._manifests(spark) if before is None or b < before]
        if not usable:
            return None
        row = spark.read.option("wholetext", True).text(f"{self.path}/manifests/{usable[-1]}").first()
        return json.loads(row[0])

    def _rows(self, spark: SparkSession, manifest: dict, parts: list[dict]) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        return spark.read.schema(schema).parquet(*[f"{self.path}/parts/{p['name']}" for p in parts])

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame | None:
        """The merged rows of all batches before ``before``; None where there was none."""
        manifest = self._manifest(spark, before)
        return None if manifest is None else self.merge(self._rows(spark, manifest, manifest["parts"]))

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Add a batch: write its part, merge parts of like size, commit, and delete what no manifest needs any more."""
        spark = rows.sparkSession
        earlier = self._manifest(spark, batch_id)
        parts = list(earlier["parts"]) if earlier else []
        part = {"name": f"{batch_id:012d}-1-{uuid.uuid4().hex}", "batches": 1}
        rows.write.parquet(f"{self.path}/parts/{part['name']}")
        manifest = {"batch": batch_id, "schema": json.loads(rows.schema.json()), "parts": [*parts, part]}
        merging = 1
        while merging < len(manifest["parts"]) and manifest["parts"][-merging - 1]["batches"] <= sum(p["batches"] for p in manifest["parts"][-merging:]):
            merging += 1
        if merging > 1:
            old = manifest["parts"][-merging:]
            n = sum(p["batches"] for p in old)
            whole = {"name": f"{batch_id:012d}-{n}-{uuid.uuid4().hex}", "batches": n}
            self.merge(self._rows(spark, manifest, old)).select(rows.columns).write.parquet(f"{self.path}/parts/{whole['name']}")
            manifest["parts"] = [*manifest["parts"][:-merging], whole]
        self._commit(spark, manifest)
        self._vacuum(spark, batch_id)

    def _commit(self, spark: SparkSession, manifest: dict) -> None:
        """Write the manifest beside its place and rename it, which is one step."""
        name = f"{manifest['batch']:012d}-{time.time_ns():020d}-{uuid.uuid4().hex}.json"
        files, hidden = _place(spark, f"{self.path}/manifests/_{name}")
        out = files.create(hidden, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not files.rename(hidden, _place(spark, f"{self.path}/manifests/{name}")[1]):
            raise OSError(f"manifest of batch {manifest['batch']} could not be put in its place")

    def _vacuum(self, spark: SparkSession, batch_id: int) -> None:
        """Keep the newest manifest and those since the batch before it; parts of later batches are being written."""
        committed = self._manifests(spark)
        earlier = max((b for b, _ in committed if b < batch_id), default=batch_id)
        kept = [(b, n) for b, n in committed if b >= earlier]
        needed = set()
        for _, n in kept:
            text = spark.read.option("wholetext", True).text(f"{self.path}/manifests/{n}").first()[0]
            needed |= {p["name"] for p in json.loads(text)["parts"]}
        gone = [f"manifests/{n}" for b, n in committed if b < earlier]
        gone += [f"parts/{n}" for n in _names(spark, f"{self.path}/parts") if n not in needed and int(n.split("-")[0]) <= batch_id]
        for name in gone:
            files, place = _place(spark, f"{self.path}/{name}")
            files.delete(place, True)

    def stored_bytes(self, spark: SparkSession) -> int:
        files, place = _place(spark, f"{self.path}/parts")
        return files.getContentSummary(place).getLength()


def with_asset_key(assets: DataFrame) -> DataFrame:
    """``asset_key`` names an asset where several merchants show one content hash."""
    return assets.withColumn("asset_key", F.concat_ws("|", "asset_hash", F.col("merchant_id").cast("string"), "domain"))


def _keyed_matches(assets: DataFrame, index: DataFrame) -> DataFrame:
    asked = with_asset_key(assets.select("asset_hash", "merchant_id", "domain", "embedding"))
    return index_matches(asked, index, key="asset_key").withColumn("asset_hash", F.substring_index("asset_key", "|", 1))


class IncrementalIndex:
    """K5. Score each micro-batch against the index as it was before, then add its assets.

    The index before batch ``n`` is that of the last manifest of a smaller batch number;
    a batch therefore never sees its own assets, also when it is repeated.
    """

    def __init__(self, index_path: str, matches_path: str):
        self.table, self.matches_path = BatchTable(index_path, build_index), matches_path

    def index_before(self, spark: SparkSession, batch_id: int | None) -> DataFrame | None:
        return self.table.read(spark, batch_id)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        index = self.index_before(batch.sparkSession, batch_id)
        if index is not None:
            _write_batch(_keyed_matches(batch, index), self.matches_path, batch_id)
        self.table.add(build_index(batch), batch_id)

    def start(self, assets: DataFrame, checkpoint: str) -> DataStreamWriter:
        return assets.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)


class JobStateTable:
    """K2. Latest job states over micro-batches.

    A batch writes the states of its own events only; they are mergeable, so reading
    combines the parts and no batch ever rewrites the states of all jobs.
    """

    def __init__(self, path: str):
        self.table = BatchTable(path, merge_states)

    def process(self, events: DataFrame, batch_id: int) -> None:
        self.table.add(job_state(events), batch_id)

    def current(self, spark: SparkSession) -> DataFrame | None:
        return self.table.read(spark)

    def start(self, events: DataFrame, checkpoint: str) -> DataStreamWriter:
        return events.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)


def incremental_matches(assets: DataFrame, batches: list[int]) -> DataFrame:
    """K5 (batch form). Matches of every batch against the index of the batches before it.

    ``assets`` carries batch_no and ts; one plan per batch, united.
    """
    out: DataFrame | None = None
    for b in batches[1:]:
        index = build_index(assets.filter(F.col("batch_no") < b))
        found = _keyed_matches(assets.filter(F.col("batch_no") == b), index)
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("at least two batches are needed")
    return out
