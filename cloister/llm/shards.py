"""Sharding with size-tiered compaction and versioned manifests.

Arrivals are appended as small immutable shards, one file for each input task and without a shuffle.
Compaction looks at the live shards' sizes: a tier holds shards whose sizes lie within a factor of
each other, and a tier with enough shards is merged into larger ones, up to files of the target size, which are never
rewritten.  Each document is so rewritten about log(target / arrival size) times.

What a reader sees is decided by manifests alone.  A manifest is an immutable, numbered file that
holds the schema and lists the live shards; it is written under another name and renamed to its number, which fails if
the number is taken, so of two writers one commits and the other starts again from the newer version.  That needs a store whose
rename is atomic (HDFS, local and POSIX file systems); object stores that copy on rename need one with such a layer.  Files that
no manifest lists (of lost executors or failed commits) are invisible, and are deleted by ``vacuum``.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import read_table, scratch_path

TARGET_BYTES = 256 << 20
#: Shards of a tier that are merged at once, at least; also the factor between tiers.
FAN_IN = 4
#: Merges in one job, and so in one commit: a plan of bounded size, and little to repeat after a conflict.
MERGES_PER_JOB = 200


@dataclass(frozen=True)
class Shard:
    path: str  # relative to the store
    bytes: int
    rows: int


class ManifestConflict(RuntimeError):
    """Another writer committed this version first."""


def tier(size: int, target: int, fan_in: int = FAN_IN) -> int:
    """0 for shards of at least three quarters of the target, then 1, 2 ... for each factor ``fan_in`` below it."""
    if 4 * size >= 3 * target:
        return 0
    return 1 + int(math.log(target / max(size, 1), fan_in))


def plan_merges(shards: list[Shard], target: int, fan_in: int = FAN_IN) -> list[list[Shard]]:
    """Groups of similarly sized shards to merge into one file each: full groups only, none larger than the target and a quarter."""
    tiers: dict[int, list[Shard]] = {}
    for shard in sorted(shards, key=lambda s: (s.bytes, s.path)):
        tiers.setdefault(tier(shard.bytes, target, fan_in), []).append(shard)
    groups = []
    for level, members in tiers.items():
        if level == 0:
            continue
        group: list[Shard] = []
        for shard in members:
            if group and sum(s.bytes for s in group) + shard.bytes > 1.25 * target:
                groups.append(group)
                group = []
            group.append(shard)
            if len(group) >= fan_in and tier(sum(s.bytes for s in group), target, fan_in) < level:
                groups.append(group)
                group = []
    return [g for g in groups if len(g) > 1]


def united(one: StructType | None, two: StructType) -> StructType:
    """The fields of both schemas, all nullable; a name with two types is an error."""
    fields = {f.name: f for f in (one or ())}
    for f in two:
        if f.name in fields and fields[f.name].dataType != f.dataType:
            raise ValueError(f"column {f.name} is {fields[f.name].dataType.simpleString()} in the store and {f.dataType.simpleString()} in the arrival")
        fields.setdefault(f.name, StructField(f.name, f.dataType, True))
    return StructType([StructField(f.name, f.dataType, True) for f in fields.values()])


class ShardStore:
    """A folder of immutable parquet shards and numbered manifests.

    Rows are kept as they arrive: nulls in any column, empty texts, repeated rows and ties all stay, in no order; a row
    of any length is one row of one shard, which is then larger than its target.  An arrival without rows adds no shard, and a
    store without shards reads as None.  Columns that only some arrivals have are null elsewhere; names are the caller's own.
    """

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN):
        self.spark, self.path, self.target, self.fan_in = spark, path.rstrip("/"), target_bytes, fan_in

    # Manifests, through Hadoop's file system on the driver.

    def _hadoop(self, path: str):
        hadoop_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop_path.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop_path

    def version(self) -> int:
        """The newest committed version; 0 for an empty store."""
        system, folder = self._hadoop(f"{self.path}/_manifests")
        if not system.exists(folder):
            return 0
        names = [f.getPath().getName() for f in system.listStatus(folder)]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> tuple[list[Shard], StructType | None]:
        """Live shards and schema of a version; nothing for an empty store."""
        version = self.version() if version is None else version
        if version == 0:
            return [], None
        lines = [json.loads(r["value"]) for r in self.spark.read.text(f"{self.path}/_manifests/v{version:010d}.json").collect()]  # one line for each file
        schema = next((StructType.fromJson(x["schema"]) for x in lines if "schema" in x), None)
        return [Shard(**x) for x in lines if "schema" not in x], schema

    def shards(self, version: int | None = None) -> list[Shard]:
        return self.manifest(version)[0]

    def commit(self, shards: list[Shard], base: int, schema: StructType | None = None) -> int:
        """Make ``shards`` the live ones as version ``base + 1``, under the schema of version ``base`` if none is given; raises
        ``ManifestConflict`` if that version exists."""
        schema = schema or self.manifest(base)[1]
        system, folder = self._hadoop(f"{self.path}/_manifests")
        system.mkdirs(folder)
        lines = ([{"schema": schema.jsonValue()}] if schema else []) + [asdict(s) for s in sorted(shards, key=lambda s: s.path)]
        body = "".join(json.dumps(x) + "\n" for x in lines)
        _, draft = self._hadoop(f"{self.path}/_manifests/.draft-{uuid.uuid4().hex}")
        out = system.create(draft, False)
        out.write(bytearray(body.encode()))
        out.close()
        _, final = self._hadoop(f"{self.path}/_manifests/v{base + 1:010d}.json")
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri() if final.toUri().getScheme() else system.getUri(), self.spark._jsc.hadoopConfiguration())
        no_overwrite = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        no_overwrite[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(draft, final, no_overwrite)
        except Exception as error:
            system.delete(draft, False)
            if system.exists(final):
                raise ManifestConflict(f"version {base + 1} exists") from error
            raise
        return base + 1

    # Data, through DataFrames.

    def _write(self, df: DataFrame) -> list[Shard]:
        folder = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        return self._described([folder])

    def _described(self, folders: list[str]) -> list[Shard]:
        files = self.spark.read.parquet(*(f"{self.path}/{f}" for f in folders))
        about = files.metadataColumn("_metadata")  # the reader's, also if the table has a column of that name
        files = files.select(about["file_path"].alias("file_path"), about["file_size"].alias("file_size"))
        found = files.groupBy("file_path").agg(F.max("file_size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()
        return [Shard("/".join(r["file_path"].split("/")[-3:]), r["bytes"], r["rows"]) for r in found]

    def append(self, arrivals: DataFrame) -> int:
        """Add rows as new shards, as they are partitioned; an arrival without rows changes nothing."""
        united(self.manifest()[1], arrivals.schema)  # a clash is noticed before anything is written
        new = self._write(arrivals)
        if not new:
            return self.version()
        while True:
            base = self.version()
            live, schema = self.manifest(base)
            try:
                return self.commit([*live, *new], base, united(schema, arrivals.schema))
            except ManifestConflict:
                continue  # new shards depend on nothing that the other writer did

    def compact(self) -> int:
        """Merge tiers until none has enough shards; each round is one job and one commit."""
        while True:
            base = self.version()
            live, schema = self.manifest(base)
            groups = plan_merges(live, self.target, self.fan_in)[:MERGES_PER_JOB]
            if not groups:
                return base
            merged = self._merge(groups, schema)
            gone = {s.path for g in groups for s in g}
            try:
                self.commit([*(s for s in live if s.path not in gone), *merged], base)
            except ManifestConflict:
                continue  # the merged files stay unlisted; start again from the newer version

    def _merge(self, groups: list[list[Shard]], schema: StructType) -> list[Shard]:
        """All groups of a round in one job: a group's files are read and written by one task, without a shuffle."""
        parts = [self.spark.read.schema(schema).parquet(*(f"{self.path}/{s.path}" for s in group)).coalesce(1) for group in groups]
        while len(parts) > 1:
            parts = [a.unionByName(b, allowMissingColumns=True) for a, b in zip(parts[::2], parts[1::2], strict=False)] + parts[len(parts) // 2 * 2 :]
        return self._write(parts[0])

    def read(self, version: int | None = None, shard_column: str = "_shard") -> DataFrame | None:
        """Rows of the live shards of a version, with the shard each is in as ``shard_column`` unless the table has a column of
        that name; None for an empty store."""
        live, schema = self.manifest(version)
        if not live:
            return None
        rows = self.spark.read.schema(schema).parquet(*(f"{self.path}/{s.path}" for s in live))
        return rows if shard_column in rows.columns else rows.withColumn(shard_column, F.element_at(F.split(rows.metadataColumn("_metadata")["file_path"], "/"), -1))

    def vacuum(self, versions: int = 1) -> int:
        """Delete data folders without a shard that is live in one of the newest ``versions``; returns how many.  Not while others
        read older versions or write."""
        system, folder = self._hadoop(f"{self.path}/data")
        newest = self.version()
        live = {s.path.split("/")[1] for v in range(newest, max(newest - versions, 0), -1) for s in self.shards(v)}
        dead = [f.getPath() for f in system.listStatus(folder) if f.getPath().getName() not in live] if system.exists(folder) else []
        for path in dead:
            system.delete(path, True)
        return len(dead)


def load_in_arrivals(store: ShardStore, table: DataFrame, order: str, arrivals: int = 4) -> None:
    """Append a table as arrivals of halving sizes by ranges of a column (rows with a null there come first), compacting after each."""
    span = table.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    lo, hi = span["lo"], span["hi"]
    if lo is None:
        store.append(table)
        return
    cuts = [lo + (hi - lo + 1) * (2**k - 1) // 2**k for k in range(1, arrivals)]
    column = F.col(order)
    for k, (start, end) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):
        chosen = F.lit(True) if start is None else column >= start
        chosen = chosen if end is None else chosen & (column < end)
        store.append(table.where(chosen | column.isNull() if k == 0 else chosen))
        store.compact()
        store.vacuum(versions=2)  # the version before stays readable


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after arrival, compaction and commit, read back through the last manifest: each row once, repeated ones as often as they
    are there.  A null text has a null digest, an empty one that of no bytes; texts of any length are stored whole; an empty table gives an empty one."""
    store = ShardStore(spark, scratch_path(spark, "shards"), target_bytes=64 << 20)
    load_in_arrivals(store, read_table(spark, sf_dir, "documents"), "doc_id")
    rows = store.read()
    if rows is None:
        return spark.createDataFrame([], "doc_id long, text_md5 string, lang string, source string, n_chars long")
    return rows.select("doc_id", F.md5("text").alias("text_md5"), "lang", "source", "n_chars")


OP5_SQL = "SELECT doc_id, md5(text) AS text_md5, lang, source, n_chars FROM documents"
