"""Size-tiered compaction of Parquet shards under a versioned manifest."""

from __future__ import annotations

import json
import math
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Commits after which a writer adds the whole list of shards, so that readers need few deltas.
SNAPSHOT_EVERY = 16
#: Merges that run side by side, and tries of a commit that other writers win.
MERGES_AT_ONCE, TRIES = 8, 100
#: Shares of the rows in each arrival of ``store_dealt``: the Fibonacci numbers, so that sizes differ widely.
SHARES = (1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144)


@dataclass(frozen=True)
class Shard:
    """One immutable file of the store."""

    path: str
    rows: int
    bytes: int


class ConcurrentCommit(RuntimeError):
    """Another writer committed the version first."""


class ShardStore:
    """A table of immutable shards in one folder that driver and executors share.

    ``_manifest/v<number>.json`` tells what a version adds and removes; ``s<number>.json`` is the whole list at
    some versions. A commit writes its delta beside them and renames it to its number without
    overwriting, which is atomic: readers see a whole version or the one before, and of two writers one
    has to read on and try again. Files that no version names (a job that died, a task that ran twice) are
    never read and go with ``vacuum``. Only lists of files pass the driver, never rows: about 200 bytes for
    each ``target_bytes`` of the table.
    """

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, least_bytes: int = 1 << 20, fanout: int = 4):
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.least_bytes, self.fanout, self.merges = target_bytes, least_bytes, fanout, 0
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), spark._jsc.hadoopConfiguration())
        self._no_overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        self._no_overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE

    def versions(self, kind: str = "v") -> list[int]:
        """The numbers of the deltas (``v``) or snapshots (``s``) that are there."""
        folder = self._path(f"{self.root}/_manifest")
        if not self._fs.exists(folder):
            return []
        names = [status.getPath().getName() for status in self._fs.listStatus(folder)]
        return sorted(int(name[1:-5]) for name in names if name.startswith(kind) and name.endswith(".json"))

    def _file(self, kind: str, version: int) -> str:
        return f"{self.root}/_manifest/{kind}{version:08d}.json"

    def manifest(self, version: int | None = None) -> tuple[int, list[Shard]]:
        """A version's number and shards; 0 and none before the first commit."""
        known = self.versions()
        version = (known[-1] if known else 0) if version is None else version
        if not version:
            return 0, []
        start = max((s for s in self.versions("s") if s <= version), default=0)
        paths = [self._file("s", start)] * (start > 0) + [self._file("v", v) for v in known if start < v <= version]
        live: dict[str, Shard] = {}
        for entry in sorted((json.loads(line[0]) for line in self.spark.read.text(paths).collect() if line[0]), key=lambda e: e["version"]):
            if entry["gone"]:
                live.pop(entry["path"], None)
            else:
                live[entry["path"]] = Shard(entry["path"], entry["rows"], entry["bytes"])
        return version, sorted(live.values(), key=lambda s: s.path)

    def _publish(self, path: str, version: int, added: list[Shard], removed: list[Shard]) -> bool:
        """Write entries beside ``path`` and rename them to it, unless it is there."""
        temporary = self._path(f"{self.root}/_manifest/.{uuid.uuid4().hex}")
        lines = [json.dumps({"version": version, "gone": gone, **asdict(s)}) for gone, shards in ((True, removed), (False, added)) for s in shards]
        out = self._fs.create(temporary, False)
        out.write(bytearray("\n".join(lines).encode() + b"\n"))
        out.close()
        try:
            self._files.rename(temporary, self._path(path), self._no_overwrite)
            return True
        except Exception:
            self._fs.delete(temporary, False)
            if not self._fs.exists(self._path(path)):
                raise
            return False

    def _commit(self, after: int, added: list[Shard], removed: list[Shard]) -> int:
        if not self._publish(self._file("v", after + 1), after + 1, added, removed):
            raise ConcurrentCommit(f"version {after + 1} exists")
        if (after + 1) % SNAPSHOT_EVERY == 0:
            self._snapshot(after + 1)
        return after + 1

    def _snapshot(self, version: int) -> None:
        if version not in self.versions("s"):
            self._publish(self._file("s", version), version, self.manifest(version)[1], [])

    def _write(self, df: DataFrame) -> list[Shard]:
        return self._written(df, f"{self.root}/data/{uuid.uuid4().hex}")[""]

    def _written(self, df: DataFrame, folder: str, by: str | None = None) -> dict[str, list[Shard]]:
        """Write ``df`` and list its shards, by the folders of a partition column if one is named."""
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(folder)
        # Row counts come from the footers of the committed files alone.
        stored = self.spark.read.schema(df.schema).parquet(folder)
        found = stored.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(F.count(F.lit(1)).alias("rows"))
        shards: dict[str, list[Shard]] = {} if by else {"": []}
        for row in found.collect():
            shards.setdefault(row.path.rsplit("/", 2)[-2] if by else "", []).append(Shard(row.path, row.rows, row.bytes))
        return shards

    def _add(self, new: list[Shard]) -> int:
        for _ in range(TRIES):
            known = self.versions()
            try:
                return self._commit(known[-1] if known else 0, new, [])
            except ConcurrentCommit:
                continue
        self._discard(new)
        raise ConcurrentCommit(f"lost {TRIES} commits to other writers; the new shards are deleted")

    def _discard(self, shards: list[Shard]) -> None:
        for shard in shards:
            self._fs.delete(self._path(shard.path), False)

    def append(self, df: DataFrame) -> int:
        """Add an arrival as the shards that its partitions make; nothing is shuffled or rewritten.

        Shards are in the manifest once their arrival is whole; where another writer commits first, the
        commit is tried again. An arrival without rows commits nothing.
        """
        new = self._write(df)
        return self._add(new) if new else self.manifest()[0]

    def tier(self, size: int) -> int:
        """Sizes within a factor of ``fanout`` share a tier; files of half the target are done."""
        if size >= self.target_bytes / 2:
            return -1
        return max(0, int(math.log(max(size, self.least_bytes) / self.least_bytes, self.fanout)))

    def plans(self, shards: list[Shard]) -> list[tuple[list[Shard], int]]:
        """Runs of at least ``fanout`` shards of one tier, of about the target each where there are enough,
        and the number of files to merge each into."""
        tiers: dict[int, list[Shard]] = {}
        for shard in sorted(shards, key=lambda s: (s.bytes, s.path)):
            tiers.setdefault(self.tier(shard.bytes), []).append(shard)
        found = []
        for tier in sorted(t for t in tiers if t >= 0):
            run: list[Shard] = []
            for shard in tiers[tier]:
                run.append(shard)
                if len(run) >= self.fanout and sum(s.bytes for s in run) >= self.target_bytes:
                    found.append(run)
                    run = []
            if len(run) >= self.fanout:
                found.append(run)
        return [(run, max(1, round(sum(s.bytes for s in run) / self.target_bytes))) for run in found]

    def _merge(self, planned: tuple[list[Shard], int]) -> list[Shard]:
        """Shards of a tier are of like size, so an equal number of them makes files of like size:
        ``coalesce`` joins scan splits within a task and no row is shuffled."""
        run, files = planned
        merged = self._write(self.spark.read.parquet(*sorted(s.path for s in run)).coalesce(files))
        if sum(s.rows for s in merged) != sum(s.rows for s in run):
            raise RuntimeError("a merge changed the number of rows")
        return merged

    def compact(self) -> int:
        """Merge full tiers, side by side, until none is full; what one round merges is a version.

        Where another writer commits first, the merge stands if its shards are still there; else its
        files are deleted and the round begins anew.
        """
        while True:
            version, shards = self.manifest()
            planned = self.plans(shards)
            if not planned:
                return version
            with ThreadPoolExecutor(MERGES_AT_ONCE) as pool:
                merged = [shard for new in pool.map(self._merge, planned) for shard in new]
            gone = [shard for run, _ in planned for shard in run]
            while True:
                try:
                    self._commit(version, merged, gone)
                    self.merges += len(planned)
                    break
                except ConcurrentCommit:
                    version, shards = self.manifest()
                    if not {s.path for s in gone} <= {s.path for s in shards}:
                        self._discard(merged)
                        break

    def vacuum(self, keep_versions: int = 1) -> int:
        """Delete old versions, then the files that the versions left do not name. No writer may be active."""
        known = self.versions()
        if not known:
            return 0
        kept = known[-keep_versions:]
        self._snapshot(kept[0])
        for version in known[:-keep_versions]:
            self._fs.delete(self._path(self._file("v", version)), False)
        for version in self.versions("s"):
            if version < kept[0]:
                self._fs.delete(self._path(self._file("s", version)), False)
        plain = lambda path: self._path(path).toUri().getPath()
        named = {plain(shard.path) for version in kept for shard in self.manifest(version)[1]}
        deleted = 0
        data = self._path(f"{self.root}/data")
        files = self._fs.listFiles(data, True) if self._fs.exists(data) else None
        unused = []
        while files is not None and files.hasNext():
            path = files.next().getPath()
            if path.getName().endswith(".parquet") and plain(path.toString()) not in named:
                unused.append(path)
        for path in unused:
            deleted += bool(self._fs.delete(path, False))
        return deleted

    def read(self, schema, version: int | None = None) -> DataFrame:
        """The rows of a version; an empty table of the schema before the first commit."""
        _, shards = self.manifest(version)
        if not shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[s.path for s in shards])


def store_arrivals(store: ShardStore, arrivals: list[DataFrame], every: int = 8) -> DataFrame:
    """Append arrivals in turn, compact after each ``every`` of them and at the end, and read all rows.

    Rows are kept as they are: nulls, empty and long texts, repeated rows and any columns. Arrivals
    without rows leave no shard; no arrivals at all is an error, as there is no schema.
    """
    for number, arrival in enumerate(arrivals, 1):
        store.append(arrival)
        if number % every == 0 or number == len(arrivals):
            store.compact()
            store.vacuum()
    return store.read(arrivals[0].schema)


def store_dealt(store: ShardStore, rows: DataFrame, shares: tuple[int, ...] = SHARES, every: int = 4) -> DataFrame:
    """Deal a table into arrivals of unequal size, store them as ``store_arrivals`` does, and read all rows.

    Rows are dealt by a hash of all their columns. One job writes the shards of all arrivals, each task one
    for each arrival it has rows of; they are committed one arrival after the other. An empty table
    leaves an empty store.
    """
    at = F.pmod(F.xxhash64(*rows.columns), F.lit(sum(shares)))
    arrival, below = F.lit(len(shares) - 1), sum(shares)
    for number in range(len(shares) - 1, -1, -1):
        arrival = F.when(at < below, F.lit(number)).otherwise(arrival)
        below -= shares[number]
    dealt = store._written(rows.withColumn("__arrival", arrival), f"{store.root}/data/{uuid.uuid4().hex}", "__arrival")
    for number in range(len(shares)):
        new = dealt.get(f"__arrival={number}")
        if new:
            store._add(new)
        if (number + 1) % every == 0 or number == len(shares) - 1:
            store.compact()
    store.vacuum()
    return store.read(rows.schema)
