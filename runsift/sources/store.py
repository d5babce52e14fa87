"""A table of rows by key that grows by appends and reads only what an append touches.

Rows lie in folders by bucket (hash of the key).  A manifest, one small file per
version, names the live folders of each bucket, so

* an append reads the key columns of the buckets its own keys fall into;
* a write that dies before its manifest leaves a folder nobody reads;
* buckets are merged when they have too many folders, and doubled in number when
  they get too large, so that what a batch of given size reads is bounded.

The driver holds bucket numbers and folder names, never rows.  One writer at a
time; a second one that commits the same version fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runsift.operators.scale import keep_one

BUCKET = "store_bucket"


class KeyedStore:
    """Rows by key below ``root``; a null key is a key like any other.

    ``buckets`` is the first number of buckets, ``target_bytes`` the mean size at
    which their number doubles, ``max_parts`` the folders a bucket may have.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: Sequence[str], fmt: str = "parquet",
                 buckets: int = 8, target_bytes: int = 128 << 20, max_parts: int = 8):
        self.spark, self.root, self.fmt = spark, root.rstrip("/"), fmt
        self.schema = spark.createDataFrame([], schema).schema
        self.keys = list(keys)
        if BUCKET in self.schema.names:
            raise ValueError(f"the name {BUCKET} is taken by the store")
        self.buckets, self.target_bytes, self.max_parts = buckets, target_bytes, max_parts
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._text = jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # Manifest

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def _versions(self) -> list[str]:
        return [n for n in self._names("manifest") if n.endswith(".json")]

    def _load(self) -> dict:
        found = self._versions()
        if not found:
            return {"version": 0, "buckets": self.buckets, "live": {}, "done": {}}
        return self._manifest(found[-1])

    def _manifest(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/manifest/{name}"))
        try:
            return json.loads(self._text.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, state: dict) -> None:
        """Make a state the newest one: written beside, then renamed, so it is seen whole or not at all."""
        state["version"] += 1
        final = self._path(f"{self.root}/manifest/{state['version']:010d}.json")
        beside = self._path(f"{self.root}/manifest/{uuid.uuid4().hex}.tmp")
        out = self._fs.create(beside)
        try:
            out.write(json.dumps(state).encode("utf-8"))
        finally:
            out.close()
        if self._fs.exists(final) or not self._fs.rename(beside, final):
            raise RuntimeError(f"another writer has committed version {state['version']} of {self.root}")

    # Reading

    def read(self) -> DataFrame:
        """All rows of the newest version."""
        return self._rows(self._load(), None)

    def _folders(self, state: dict, only: Iterable[int] | None) -> list[str]:
        wanted = state["live"] if only is None else [str(b) for b in only if str(b) in state["live"]]
        return [f"{self.root}/data/{folder}" for b in wanted for folder, _ in state["live"][b]]

    def _rows(self, state: dict, only: Iterable[int] | None) -> DataFrame:
        folders = self._folders(state, only)
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        reader = self.spark.read.schema(self.schema)
        if self.fmt == "json":
            reader = reader.option("mode", "FAILFAST")
        return reader.format(self.fmt).load(folders)

    def doubled_keys(self) -> DataFrame:
        """Keys stored more than once; appends make none, so a row here is an error."""
        return self.read().groupBy(*self.keys).agg(F.count("*").alias("rows")).where("rows > 1")

    # Writing

    def _place(self, df: DataFrame, buckets: int) -> DataFrame:
        return df.select(*self.schema.names).withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int"))

    def _touched(self, placed: DataFrame) -> list[int]:
        """Bucket numbers of a batch: at most as many as the store has buckets."""
        return [r[0] for r in placed.select(BUCKET).distinct().collect()]

    def _write(self, placed: DataFrame, state: dict) -> tuple[str, dict[str, list]]:
        folder = f"{state['version'] + 1:010d}-{uuid.uuid4().hex[:8]}"
        writer = placed.hint("rebalance", F.col(BUCKET)).write.partitionBy(BUCKET)
        if self.fmt == "json":
            writer = writer.option("ignoreNullFields", False)
        writer.format(self.fmt).save(f"{self.root}/data/{folder}")
        written = {}
        for name in self._names(f"data/{folder}"):
            if name.startswith(f"{BUCKET}="):
                size = self._fs.getContentSummary(self._path(f"{self.root}/data/{folder}/{name}")).getLength()
                written[name.split("=")[1]] = [f"{folder}/{name}", size]
        return folder, written

    def append(self, batch: DataFrame, order: Sequence[Column], source: str | None = None, batch_id: int | None = None) -> DataFrame:
        """Store the rows whose key is new, one per key (first by ``order``); returns the rows stored.

        With ``source`` and ``batch_id`` a batch that this source has already
        committed is skipped; without them a replay finds all its keys stored.
        """
        state = self._load()
        if source is not None and batch_id <= state["done"].get(source, -1):
            return self.spark.createDataFrame([], self.schema)
        placed = self._place(batch, state["buckets"])
        if state["live"]:
            stored = self._rows(state, self._touched(placed)).select(*[F.col(k).alias(f"stored_{i}") for i, k in enumerate(self.keys)])
            same = reduce(lambda a, b: a & b, [placed[k].eqNullSafe(stored[f"stored_{i}"]) for i, k in enumerate(self.keys)])
            # The keys of a bucket never pass through the driver, which a broadcast in each batch would make them do.
            placed = placed.join(stored.hint("merge"), same, "left_anti")
        _, written = self._write(keep_one(placed, self.keys, order), state)
        for bucket, part in written.items():
            state["live"].setdefault(bucket, []).append(part)
        self._finish(state, source, batch_id)
        return self._rows({"live": {b: [part] for b, part in written.items()}}, None)

    def add(self, amounts: DataFrame, source: str, batch_id: int) -> None:
        """Add the columns beside the key to the stored sums, once per (source, batch).

        The touched buckets are written anew and replace the old ones in one
        commit.  Sums do not depend on the order of batches.
        """
        state = self._load()
        if batch_id <= state["done"].get(source, -1):
            return
        placed = self._place(amounts, state["buckets"])
        touched = self._touched(placed)
        both = placed.unionByName(self._place(self._rows(state, touched), state["buckets"]))
        sums = [c for c in self.schema.names if c not in self.keys]
        _, written = self._write(both.groupBy(BUCKET, *self.keys).agg(*[F.sum(c).alias(c) for c in sums]), state)
        state["live"].update({b: [part] for b, part in written.items()})
        self._finish(state, source, batch_id)

    def _finish(self, state: dict, source: str | None, batch_id: int | None) -> None:
        if source is not None:
            state["done"][source] = batch_id
        self._commit(state)
        self._tidy(state)

    # Upkeep

    def _tidy(self, state: dict) -> None:
        """Double the buckets that got too large; merge those with too many folders."""
        size = sum(part[1] for parts in state["live"].values() for part in parts)
        buckets = state["buckets"]
        while size > buckets * self.target_bytes:
            buckets *= 2
        crowded = [b for b, parts in state["live"].items() if len(parts) > self.max_parts]
        if buckets > state["buckets"]:
            self._rewrite(state, list(state["live"]), buckets)
        elif crowded:
            self._rewrite(state, crowded, buckets)

    def _rewrite(self, state: dict, old: list[str], buckets: int) -> None:
        _, written = self._write(self._place(self._rows(state, old), buckets), state)
        live = {b: parts for b, parts in state["live"].items() if b not in set(old)}
        live.update({b: [part] for b, part in written.items()})
        state.update(live=live, buckets=buckets)
        self._commit(state)

    def vacuum(self, keep_versions: int = 2) -> int:
        """Delete folders that none of the newest versions names; returns their number.

        Plans made from older versions can no longer run, and no writer may be
        at work: its folder is in no manifest yet.
        """
        versions = self._versions()
        kept = versions[-keep_versions:]
        live = {part[0] for name in kept for parts in self._manifest(name)["live"].values() for part in parts}
        gone = 0
        for folder in self._names("data"):
            inside = [n for n in self._names(f"data/{folder}") if n.startswith(f"{BUCKET}=")]
            dead = [n for n in inside if f"{folder}/{n}" not in live]
            for name in dead if len(dead) < len(inside) else [""]:
                self._fs.delete(self._path(f"{self.root}/data/{folder}/{name}".rstrip("/")), True)
            gone += len(dead)
        for name in versions[:-keep_versions]:
            self._fs.delete(self._path(f"{self.root}/manifest/{name}"), False)
        return gone
