"""Merkle fixity audit of archive replicas.

A record has a digest; records whose offsets fall into the same range of
``range_bytes`` bytes of a file make a leaf, and ``fanout`` neighbouring nodes
make a node of the next level, up to one root per file.  A node's hash is that of the
positions and hashes of its children in order, so a record that stands at another
offset changes every node above it.  The roots of two replicas are compared first;
below a root that matches nothing is looked at, and below one that does not, only
mismatching children are followed, down to the records.

Trees are kept as one table per replica, so a later audit needs no payload of
files whose roots agree.  All steps are grouped aggregates and equi-joins of
digests; payloads are hashed where they are read and never shuffled.

Defined cases: a null file is a file of its
own; a record that only one replica holds is reported as missing in the other;
a null offset is a position of its own and a null digest an empty one;
records that repeat file and offset are compared as a sorted list of digests; an
empty replica makes every record of the other missing; two empty ones give no
rows; further columns are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runsift.llm.shared import materialize
from runsift.operators.scale import null_safe_join

RANGE_BYTES = 1 << 16
FANOUT = 16


def record(url: Column, body: Column) -> Column:
    """Bytes of a response record; the header is reduced to the fields that an audit needs."""
    body = F.coalesce(body, F.lit(""))
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
                    F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def record_digests(pages: DataFrame, bodies: dict[str, Column], file_records: int = 200) -> DataFrame:
    """(file, offset, id, one digest per body) of the records of (page_id, url, html) rows, in id order.

    The first body sets the offsets.  A file holds one range of ``file_records``
    ids, so its size does not grow with the table; rows that repeat an id follow
    each other by digest.  A null body as given is a record that is not there.
    """
    first = next(iter(bodies))
    digests = {name: F.when(body.isNotNull(), F.sha2(record(F.col("url"), body).cast("binary"), 256)) for name, body in bodies.items()}
    rows = pages.select(
        F.floor(F.col("page_id") / file_records).cast("long").alias("file"), F.col("page_id").alias("id"),
        F.octet_length(record(F.col("url"), bodies[first])).cast("long").alias("length"), *[d.alias(n) for n, d in digests.items()])
    order = Window.partitionBy("file").orderBy("id", first).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0))).select("file", "offset", "id", *bodies)


def _nodes(children: DataFrame, at: Column) -> DataFrame:
    pair = lambda c: F.concat(F.coalesce(c["at"].cast("string"), F.lit("")), F.lit(":"), c["hash"])
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "hash"))), pair), ",")
    return children.groupBy("file", at.alias("parent")).agg(F.sha2(ordered, 256).alias("hash")).withColumnRenamed("parent", "at")


def build_trees(digests: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> tuple[DataFrame, int]:
    """(level, file, at, hash) of every node, level 0 being the offset ranges, and the level of the roots."""
    records = digests.select("file", F.col("offset").alias("at"), F.coalesce("digest", F.lit("")).alias("hash"))
    level = materialize(_nodes(records, F.floor(F.col("at") / range_bytes)), "tree-level")
    trees = level.withColumn("level", F.lit(0))
    top, highest = 0, level.agg(F.max("at")).first()[0] or 0
    while highest > 0:
        level = materialize(_nodes(level, F.floor(F.col("at") / fanout)), "tree-level")
        top, highest = top + 1, highest // fanout
        trees = trees.unionByName(level.withColumn("level", F.lit(top)))
    return trees, top


def _apart(left: DataFrame, right: DataFrame) -> DataFrame:
    """(file, at, hash, other) where the hashes of two tables of (file, at, hash) differ or one is missing."""
    mine = left.withColumn("held", F.lit(True))
    named = right.select(F.col("file").alias("rf"), F.col("at").alias("ra"), F.col("hash").alias("other"))
    both = mine.join(named, mine["file"].eqNullSafe(named["rf"]) & mine["at"].eqNullSafe(named["ra"]), "full")
    side = lambda one, other: F.when(F.col("held"), F.col(one)).otherwise(F.col(other)).alias(one)
    return both.where(~F.col("hash").eqNullSafe(F.col("other"))).select(side("file", "rf"), side("at", "ra"), "hash", "other")


def _differing(left: DataFrame, right: DataFrame) -> DataFrame:
    return _apart(left, right).select("file", "at")


def _below(nodes: DataFrame, parents: DataFrame, width: int) -> DataFrame:
    keyed = nodes.withColumn("up", F.floor(F.col("at") / width))
    wanted = parents.select("file", F.col("at").alias("up"))
    return null_safe_join(keyed, wanted, ["file", "up"]).drop("up")


def audit(primary: DataFrame, replica: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """(file, offset, primary_digest, replica_digest, found_at) of every record on which (file, offset, digest) tables disagree.

    ``found_at`` is the first offset among the replica's disagreeing records of the
    file that holds the primary's digest: a record that only moved, as all do behind
    one that was lost or changed its length.  Null means that the replica lacks it.
    """
    sides = [materialize(d.select("file", "offset", "digest"), "digests") for d in (primary, replica)]
    trees, tops = zip(*[build_trees(d, range_bytes, fanout) for d in sides])
    # A tree of fewer levels than the other differs at its root, so both are followed from the level they share.
    shared = min(tops)
    levels = [[t.where(F.col("level") == k).drop("level") for k in range(shared + 1)] for t in trees]
    wrong = _differing(levels[0][shared], levels[1][shared])
    for k in range(shared - 1, -1, -1):
        wrong = materialize(wrong, "mismatches")
        wrong = _differing(*[_below(side[k], wrong, fanout) for side in levels])
    wrong = materialize(wrong, "mismatches")
    records = [d.select("file", F.col("offset").alias("at"), F.coalesce("digest", F.lit("")).alias("digest")) for d in sides]
    held = [_below(r, wrong, range_bytes).groupBy("file", "at").agg(F.array_join(F.sort_array(F.collect_list("digest")), ",").alias("hash")) for r in records]
    report = materialize(_apart(*held), "disagreements").select(
        "file", F.col("at").alias("offset"), F.col("hash").alias("primary_digest"), F.col("other").alias("replica_digest"))
    moved = report.where("replica_digest is not null").groupBy("file", F.col("replica_digest").alias("primary_digest")).agg(F.min("offset").alias("found_at"))
    return null_safe_join(report, moved, ["file", "primary_digest"], "left")
