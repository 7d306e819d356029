"""Shards over fixed virtual slots: records hash into thousands of slots, and a versioned map says which shard has each slot.

A record's slot never changes; rebalancing edits the map, so only the slots that it moves move rows. Versions are folders of
edits, each written once: a reader takes those up to its version, and of two writers of one version the second fails. What
the driver holds and broadcasts is by slot, so it doesn't grow with the table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cutgrain.session import cut

#: Virtual slots; one holds about a 1024th of a shard of eight.
SLOTS = 8192
#: A slot that alone holds more than this share of a shard is split: its records are dealt over all slots by row.
HOT_SHARE = 1 / 16


@dataclass
class SlotMap:
    """shard[slot], and which slots are split; edits are what differs from the version before."""

    shards: int
    shard: np.ndarray
    version: int = 1
    split: frozenset[int] = field(default_factory=frozenset)

    @staticmethod
    def even(shards: int, slots: int = SLOTS, split: frozenset[int] = frozenset()) -> SlotMap:
        """The first version: as many neighbouring slots to each shard."""
        return SlotMap(shards, np.arange(slots) * shards // slots, 1, split)

    def rebalanced(self, sizes: np.ndarray) -> SlotMap:
        """The next version: slots move from the fullest shard to the emptiest while one narrows the gap between them."""
        shard = self.shard.copy()
        load = np.bincount(shard, sizes, self.shards).astype(np.int64)
        while True:
            high, low = int(load.argmax()), int(load.argmin())
            gap = int(load[high] - load[low])
            own = np.flatnonzero((shard == high) & (sizes > 0) & (sizes < gap))
            if not len(own):
                return SlotMap(self.shards, shard, self.version + 1, self.split)
            best = own[np.abs(2 * sizes[own] - gap).argmin()]
            shard[best] = low
            load[high] -= sizes[best]
            load[low] += sizes[best]

    def grown(self, sizes: np.ndarray) -> SlotMap:
        """The next version, with one more shard: it takes slots from the fullest ones, and nothing else moves."""
        shard = self.shard.copy()
        load = np.bincount(shard, sizes, self.shards + 1).astype(np.int64)
        goal = int(sizes.sum()) // (self.shards + 1)
        for s in np.argsort(-sizes, kind="stable").tolist():
            if load[-1] + sizes[s] <= goal and load[shard[s]] - sizes[s] >= goal - int(sizes.max(initial=0)):
                load[shard[s]] -= sizes[s]
                load[-1] += sizes[s]
                shard[s] = self.shards
        return SlotMap(self.shards + 1, shard, self.version + 1, self.split)

    def save(self, spark: SparkSession, folder: str, before: SlotMap | None = None) -> None:
        """Writes the edits since `before` as a new version; an error if that version is there."""
        changed = np.flatnonzero(self.shard != before.shard) if before else np.arange(len(self.shard))
        rows = [(int(s), int(self.shard[s]), int(s) in self.split) for s in changed]
        whole = spark.createDataFrame(rows or [], "vslot int, shard int, split boolean").withColumn("shards", F.lit(self.shards))
        whole.coalesce(1).write.parquet(f"{folder}/version={self.version}")

    @staticmethod
    def load(spark: SparkSession, folder: str, version: int | None = None) -> SlotMap:
        """The map at a version, the newest if none is named: each slot's last edit."""
        edits = spark.read.schema("vslot int, shard int, split boolean, shards int, version int").parquet(folder)
        if version is not None:
            edits = edits.where(F.col("version") <= version)
        rows = sorted(edits.collect(), key=lambda r: r["version"])  # slots times versions
        shard = np.zeros(max(r["vslot"] for r in rows) + 1, np.int64)
        for r in rows:
            shard[r["vslot"]] = r["shard"]
        last = rows[-1]
        return SlotMap(last["shards"], shard, last["version"] if version is None else version, frozenset(r["vslot"] for r in rows if r["split"]))

    def vslot(self, record: Column, row: Column) -> Column:
        """A record's slot by its hash; those of split slots are dealt over all slots by row."""
        n = len(self.shard)
        own = F.pmod(record, F.lit(n)).cast("int")
        if not self.split:
            return own
        return F.when(own.isin(sorted(self.split)), F.pmod(F.xxhash64(record, row), F.lit(n)).cast("int")).otherwise(own)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, int(s)) for i, s in enumerate(self.shard)], "vslot int, shard int")


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (id, size, text_crc32, record, row): a row's bytes, checksum, hash of id and text, and number in the table as it is
    kept. It is computed once into shared storage, some 30 bytes a row, so every later look finds the same numbers."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    data = text.cast("binary")
    return cut(docs.select(F.col(id_col), (F.octet_length(data) + F.lit(1)).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.xxhash64(F.col(id_col), text).alias("record"), F.monotonically_increasing_id().alias("row")))


def slot_sizes(slotted: DataFrame, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """(vslot, size) -> bytes and rows of each slot: as many numbers as there are slots come to the driver."""
    size, rows = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    for r in slotted.groupBy("vslot").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect():
        size[r["vslot"]], rows[r["vslot"]] = r["size"], r["rows"]
    return size, rows


def place(docs: DataFrame, shards: int, folder: str, slots: int = SLOTS, hot_share: float = HOT_SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (id, size, text_crc32, law, shard, slot, grown_shard, vslot, map_version): every row in one shard, with its place there.

    The law is `bytes`: version 1 of the map in `folder` is even, version 2 moves slots until no move narrows the gap between
    the fullest and the emptiest shard. A slot that holds more than `hot_share` of a shard, such as one of a third of all
    rows that are the same record, is split by row before. Places are by slot, then by id, checksum and row, without gaps from 0.
    Null texts have size 1 and count as empty in the checksum; null and repeated ids and repeated rows have a place each; other
    columns are dropped; grown_shard is null under this law. An empty table gives no rows, and an even map.
    """
    spark = docs.sparkSession
    rec = records(docs, id_col, text_col)
    first = SlotMap.even(shards, slots)
    slotted = rec.withColumn("vslot", first.vslot(F.col("record"), F.col("row")))
    size, rows = slot_sizes(slotted, slots)
    hot = np.flatnonzero(size > hot_share * size.sum() / shards)
    if len(hot):
        hot = frozenset(int(s) for s in hot if rows[s] > 1)
        first = SlotMap.even(shards, slots, hot)
        slotted = rec.withColumn("vslot", first.vslot(F.col("record"), F.col("row")))
        size, rows = slot_sizes(slotted, slots)
    first.save(spark, folder)
    first.rebalanced(size).save(spark, folder, first)
    now = SlotMap.load(spark, folder)
    # where each slot's rows begin in its shard
    order = np.argsort(now.shard, kind="stable")
    ends = np.cumsum(rows[order])
    begin = np.zeros(slots, np.int64)
    begin[order] = ends - rows[order]
    of_shard = np.bincount(now.shard, rows, shards).astype(np.int64)
    begin -= (np.cumsum(of_shard) - of_shard)[now.shard]
    where = spark.createDataFrame([(i, int(s), int(b)) for i, (s, b) in enumerate(zip(now.shard, begin, strict=True))], "vslot int, shard int, begin long")
    within = Window.partitionBy("vslot").orderBy(id_col, "text_crc32", "row")
    placed = slotted.join(F.broadcast(where), "vslot").withColumn("slot", F.col("begin") + F.row_number().over(within) - 1)
    return placed.select(F.col(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", F.lit(now.version).alias("map_version"))


def write_shards(docs: DataFrame, now: SlotMap, folder: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Whole rows, all columns, as Parquet below folder/shard=N by the map; rows don't move between tasks, each writes its own.

    A column named `shard` of docs is refused. Of split slots, a row's shard is by its number in docs, so two writes of the
    same files agree, and place() of them, as long as both read them alike.
    """
    if "shard" in docs.columns:
        raise ValueError("the rows have a column named shard")
    vslot = now.vslot(F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit(""))), F.monotonically_increasing_id())
    shard = F.element_at(F.lit([int(s) for s in now.shard]), vslot + 1)
    docs.withColumn("shard", shard).write.partitionBy("shard").parquet(folder)
