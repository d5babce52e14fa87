"""Exact Jaccard join of word n-gram sets: rare-first prefixes, filters in the join, one check per pair.

1. Texts become sets of hashed n-grams.  Equal sets form a class, known by the hash
   of the set, and its document with the smallest id goes on, so copies cost one row.
2. The n-grams of all documents are counted in ``SLOTS`` hashed counters (a task adds
   up its own, tasks are merged block by block), which gives one order for all:
   rare first, then by hash.  Counters that n-grams share only make the order less
   sharp; every order gives the same links.  The counters are the only data sent to
   all tasks and have ``4 * SLOTS`` bytes whatever the corpus is.
3. Of n n-grams, the first ``n - ceil(percent * n / 100) + 1`` are posted: sets that
   link share one of them.  N-grams posted once are dropped.
4. Lists of posted n-grams are joined under three filters, inside the join: sizes
   (length filter), places of the shared n-gram in both orders (positional filter),
   and the parities of both sets, a lower bound of their difference (suffix filter).
   Pairs of a list are not all listed.  In each round a member proposes itself to one
   hub of its lists; pairs are checked on the full sets, once each, and links are
   merged into components.  A list whose members are in one component is done.
   Only texts of pairs to check move, and their sets are made anew.  When few pairs that cross components are left, or rounds hardly lower their
   number, all of them are joined under the filters, in salted blocks of
   ``BLOCK_ROWS`` members, so no link that could join two components is lost.  A pair
   is left out where it has met in the list of an n-gram shortly before.

Links are exact up to equal 64-bit hashes of different n-grams or sets.

Defined cases: a text without words (or null) has an empty set and is linked with
nothing; fewer words than ``words`` make one n-gram of all of them; equal texts get
equal answers; a row with a null id takes part in nothing and has a null component;
repeated rows are answered each, and rows of one id with different texts are
different documents; an empty table gives no rows; further columns are
not returned.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsift.llm import bloom
from runsift.llm.components import components
from runsift.llm.neardup import _shingles
from runsift.llm.shared import SpanHasher, chunks, materialize, mix64

#: Counters of the n-gram order, and counters in one block of them.
SLOTS = 1 << 20
SLOT_BLOCK = 1 << 16
#: Bits of a set's parities; beyond about as many n-grams that differ, the suffix filter lets pairs pass.
PARITIES = 256
#: Columns of these bits, 64 in each.
PARITY = [f"p{k}" for k in range(1, PARITIES // 64 + 1)]
#: The shared n-grams right before a posted one: a pair that shares one of them has met already.
BEFORE = ["before1", "before2"]
#: Larger sets also have so many parities, with which their pairs are filtered once more before any text moves.
WIDE_FROM, WIDE_PARITIES = 600, 4096
#: Members of a list in one salted block of the last join.
BLOCK_ROWS = 512
#: Bytes of sets that one group of checked pairs holds, about (both sets of every pair counted).
CHECK_BYTES = 1 << 24


def _slots(items: np.ndarray) -> np.ndarray:
    return (mix64(items) % np.uint64(SLOTS)).astype(np.int64)


def _sets(batches, words: int) -> Iterator[tuple[pa.Array, pa.Array, list[np.ndarray]]]:
    """(ids, hashes of the sets or null, sorted distinct n-gram hashes of each row) for about a megabyte of text at a time."""
    hasher = SpanHasher()
    for batch in batches:
        for first, end, raw, offsets in chunks(batch.column(1)):
            sets = _shingles(hasher, raw, offsets, words)
            nodes = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None for s in sets]
            yield batch.column(0).slice(first, end - first), pa.array(nodes, pa.int64()), sets


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate([np.zeros(0, np.int64), *[a.view(np.int64) for a in arrays]])
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, arrays)]).astype(np.int32), flat)


def _summaries(words: int) -> Callable:
    """mapInArrow function over (id, text): size and hash of every set, and at the end the task's counters."""

    def run(batches):
        names = ["id", "n_shingles", "node", "block", "counts"]
        counts = np.zeros(SLOTS, np.int64)
        for ids, nodes, sets in _sets(batches, words):
            counts += np.bincount(_slots(np.concatenate([*sets, np.zeros(0, np.uint64)])), minlength=SLOTS)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(s) for s in sets], pa.int64()), nodes, pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())], names)
        blocks = [(at // SLOT_BLOCK, counts[at : at + SLOT_BLOCK]) for at in range(0, SLOTS, SLOT_BLOCK)]
        blocks = [(block, zlib.compress(part.tobytes(), 1)) for block, part in blocks if part.any()]
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(blocks), pa.int64()), pa.nulls(len(blocks), pa.int64()), pa.nulls(len(blocks), pa.int64()),
             pa.array([b for b, _ in blocks], pa.int32()), pa.array([c for _, c in blocks], pa.binary())], names)

    return run


def _added(batches):
    """mapInArrow function: the sums of the counters by block, read as a stream."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
            part = np.frombuffer(zlib.decompress(packed.as_py()), np.int64)
            sums[block] = sums[block] + part if block in sums else part
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array([np.minimum(s, 0xFFFFFFFF).astype(np.uint32).tobytes() for s in sums.values()], pa.binary())],
        ["block", "counts"])


def _order(summaries: DataFrame) -> np.ndarray:
    """How often n-grams of each slot occur in all documents."""
    blocks = summaries.where("block is not null").select("block", "counts")
    added = blocks.repartition(SLOTS // SLOT_BLOCK, "block").mapInArrow(_added, "block int, counts binary")
    counts = np.zeros(SLOTS, np.uint32)
    for row in materialize(added, "ngram-counts").toLocalIterator():
        counts[row.block * SLOT_BLOCK : (row.block + 1) * SLOT_BLOCK] = np.frombuffer(row.counts, np.uint32)
    return counts


def _parities(items: np.ndarray, bits: int = PARITIES) -> np.ndarray:
    """Whether each remainder modulo ``bits`` is that of an odd number of items, packed into 64-bit numbers."""
    odd = np.bincount((items % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _prefixes(words: int, percent: int, counts: np.ndarray) -> Callable:
    """mapInArrow function over (id, text): the set's size, its first n-grams in the common order, and its parities."""

    def run(batches):
        for ids, nodes, sets in _sets(batches, words):
            keys = []
            for items in sets:
                short = len(items) + 1 - -(-percent * len(items) // 100) if len(items) else 0
                order = np.lexsort((items, counts[_slots(items)]))[:short]
                keys.append(items[order])
            yield pa.RecordBatch.from_arrays(
                [ids, nodes, pa.array([len(s) for s in sets], pa.int32()), _lists(keys), *map(pa.array, np.stack([_parities(s) for s in sets]).T),
                 pa.array([_parities(s, WIDE_PARITIES) if len(s) > WIDE_FROM else None for s in sets], pa.list_(pa.int64()))],
                ["id", "node", "n", "keys", *PARITY, "wide"])

    return run


def _checked(words: int, percent: int) -> Callable:
    """Function over the texts and the pairs of a bin: whether each pair links, from the full sets."""

    def run(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        items = {}
        for _, nodes, sets in _sets(texts.select(["id", "text"]).to_batches(), words):
            items.update(zip(nodes.to_pylist(), sets))
        linked = []
        for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist()):
            one, other = items[a], items[b]
            both = len(np.intersect1d(one, other, assume_unique=True))
            linked.append(100 * both >= percent * (len(one) + len(other) - both))
        return pa.table({"a": pairs["a"], "b": pairs["b"], "linked": pa.array(linked, pa.bool_())})

    return run


def _may_link(one: str, other: str, percent: int) -> Column:
    """False only for pairs of a list that the length, positional or suffix filter rules out."""
    get = lambda side, name: F.col(f"{side}{name}")
    (n, o), (i, j) = [get(s, "n") for s in (one, other)], [get(s, "pos") for s in (one, other)]
    common = F.least(i, j) + 1 + F.least(n - i - 1, o - j - 1)  # at most
    apart = sum(F.bit_count(get(one, p).bitwiseXOR(get(other, p))) for p in PARITY)  # at least
    return ((F.least(n, o) * 100 >= F.greatest(n, o) * percent) & (common * (100 + percent) >= (n + o) * percent)
            & (apart * (100 + percent) <= (n + o) * (100 - percent)))


def _pair(one: str, other: str) -> list[Column]:
    return [F.greatest(one, other).alias("a"), F.least(one, other).alias("b")]


def _proposals(lists: DataFrame, turn: int, percent: int) -> DataFrame:
    """(a, b, n) pairs across components: each member with one hub of its lists; n is the size of both sets."""
    rank = F.col("node") if turn == 0 else F.xxhash64("node", F.lit(turn))
    hubs = lists.groupBy("key").agg(F.min_by(F.struct("node", "comp", "n", "pos", *PARITY), rank).alias("hub"))
    met = lists.join(hubs, "key").where((F.col("comp") != F.col("hub.comp")) & _may_link("", "hub.", percent))
    rank = F.col("hub.node") if turn == 0 else F.xxhash64("hub.node", F.lit(turn))
    best = met.groupBy("node").agg(F.min_by(F.struct(F.col("hub.node").alias("hub"), (F.col("n") + F.col("hub.n")).alias("n")), rank).alias("best"))
    return best.select(*_pair("node", "best.hub"), F.col("best.n").alias("n")).distinct()


def _posts(nodes: DataFrame) -> DataFrame:
    """A row for each shared n-gram of a node, with the ``BEFORE`` shared ones in front of it."""
    before = lambda i: [F.get("posts", i - k)["key"].alias(name) for k, name in enumerate(BEFORE, 1)]
    posts = F.transform("posts", lambda post, i: F.struct(post["key"].alias("key"), post["pos"].alias("pos"), post["held"].alias("held"), *before(i)))
    post = nodes.select("node", "comp", "n", *PARITY, F.explode(posts).alias("post"))
    return post.select("node", "comp", "n", *PARITY, "post.key", "post.pos", "post.held", *[f"post.{name}" for name in BEFORE])


def _meetings(lists: DataFrame, percent: int) -> DataFrame:
    """The crossing pairs of the lists that pass the filters, a block of members at a time.

    Near copies share run after run of n-grams.  Two sets that share one of the n-grams
    right before this one have met in its list, where the filters hold as well if the
    pair links, so nearly all pairs become one row and not one for each shared n-gram.
    """
    blocks = F.ceil(F.col("held") / BLOCK_ROWS).cast("int")
    left = lists.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).drop("held")
    right = lists.select(*[F.col(c).alias(c if c == "key" else f"o_{c}") for c in lists.columns if c != "held"],
                         F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    apart = (F.col("node") > F.col("o_node")) & (F.col("comp") != F.col("o_comp"))
    for one in BEFORE:
        for other in BEFORE:
            apart &= F.coalesce(F.col(one) != F.col(f"o_{other}"), F.lit(True))
    return left.join(right, ["key", "block"]).where(apart & _may_link("", "o_", percent))


def _crossing(lists: DataFrame, percent: int) -> DataFrame:
    """Every pair that crosses components and passes the filters wherever it meets."""
    return _meetings(lists, percent).select(*_pair("node", "o_node"), (F.col("n") + F.col("o_n")).alias("n")).distinct()


def _open_pairs(lists: DataFrame) -> tuple[int, int]:
    """Members of the lists, and pairs in them that cross components."""
    held = lists.groupBy("key", "comp").agg(F.count("*").cast("double").alias("n"))
    of_list = held.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"))
    row = of_list.agg(F.sum("n"), F.sum(F.col("n") * F.col("n") - F.col("same")) / 2).first()
    return int(row[0] or 0), int(row[1] or 0)


def _near(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs but those of large sets whose many parities differ too much: the suffix filter once more."""
    side = lambda k: nodes.where("wide is not null").select(F.col("node").alias(k), F.col("wide").alias(f"wide_{k}"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    apart = F.aggregate(F.zip_with("wide_a", "wide_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return both.where(F.coalesce(apart * (100 + percent) <= F.col("n") * (100 - percent), F.lit(True))).select("a", "b", "n")


def _verified(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs with a boolean ``linked``, from their full sets.

    Pairs are dealt into bins by the smallest node around their first one, so a family
    meets in one bin; a family too large for a bin is dealt further, by its nodes.  A text
    moves once to each bin that needs it, being smaller than its set, which is made there.
    """
    pairs = materialize(_near(materialize(pairs, "pairs"), nodes, percent), "near-pairs")
    bins = max(1, -(-8 * (pairs.agg(F.sum("n")).first()[0] or 0) // CHECK_BYTES))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("a"), F.col("b").alias("low"))  # b is the smaller one
    rooted = pairs.join(ends.groupBy("a").agg(F.min("low").alias("root")), "a")
    parts = rooted.groupBy("root").agg(F.ceil(F.sum("n") * 8 / CHECK_BYTES).alias("parts"))
    share = F.pmod(F.xxhash64("a"), F.col("parts"))
    binned = materialize(rooted.join(parts, "root").select("a", "b", F.pmod(F.xxhash64("root", share), F.lit(bins)).alias("bin")), "bins")
    asked = binned.select("bin", F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "id"), "node")
    # An id may have several texts; all of them move with it.
    asked = materialize(asked.groupBy("id").agg(F.collect_set("bin").alias("bins")), "asked")
    found = bloom.maybe_in(texts, asked, "id", "asked-bits").join(asked, "id").select("id", "text", F.explode("bins").alias("bin"))
    return found.groupBy("bin").cogroup(binned.groupBy("bin")).applyInArrow(_checked(words, percent), "a long, b long, linked boolean")


def _links(texts: DataFrame, nodes: DataFrame, shared: DataFrame, words: int, percent: int) -> DataFrame | None:
    """(member, component) of the nodes that have a link, or None."""
    checked, labels, turn, new, before = None, None, 0, 1, float("inf")
    held = F.col("held").cast("double")
    members, crossing = [int(x) for x in shared.agg(F.sum(held), F.sum(held * (held - 1) / 2)).first()]
    while True:
        if turn == 0:
            lists = _posts(nodes.withColumn("comp", F.col("node")))
        else:
            named = nodes if labels is None else nodes.join(labels, nodes["node"] == labels["member"], "left")
            posts = _posts(named.withColumn("comp", F.col("node") if labels is None else F.coalesce("component", "node")))
            unsettled = posts.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
            lists = materialize(posts.join(unsettled, "key", "left_semi"), "lists")
            members, crossing = _open_pairs(lists)
        last = crossing <= 4 * members or not new or crossing > 0.7 * before
        before = crossing
        pairs = _crossing(lists, percent) if last else _proposals(lists, turn, percent)
        if checked is not None:
            pairs = pairs.join(checked, ["a", "b"], "left_anti")
        found = materialize(_verified(pairs, texts, nodes, words, percent), "checked")
        new = found.where("linked").count()
        checked = found if checked is None else checked.unionByName(found)
        if new:
            labels = materialize(components(checked.where("linked").select("a", "b")).withColumnRenamed("node", "member"), "components")
        if last:
            return labels
        turn += 1


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles (size of its set), component_id (smallest id reachable by links)."""
    quoted = lambda name: F.col("`" + name.replace("`", "``") + "`")
    texts = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text"))
    schema = "id long, n_shingles long, node long, block int, counts binary"
    summaries = materialize(texts.mapInArrow(_summaries(words), schema), "summaries")
    rows = summaries.where("block is null").select("id", "n_shingles", "node")
    classes = materialize(rows.where("id is not null and node is not null").groupBy("node").agg(F.min("id").alias("id")), "classes")
    # Few copies get through the bit filter; they post the same class again, which changes no list of two classes.
    first = bloom.maybe_in(texts.where("id is not null"), classes, "id", "class-bits")
    prefixes = first.mapInArrow(
        _prefixes(words, percent, _order(summaries)), f"id long, node long, n int, keys array<long>, {', '.join(f'{p} long' for p in PARITY)}, wide array<long>")
    prefixes = materialize(prefixes.where("n > 0"), "prefixes")
    posts = prefixes.select("node", F.posexplode("keys").alias("pos", "key"))
    shared = materialize(posts.groupBy("key").agg(F.count("*").alias("held")).where("held > 1"), "shared-ngrams")
    own = bloom.maybe_in(posts, shared, "key", "shared-bits").join(shared, "key").groupBy("node").agg(
        F.sort_array(F.collect_set(F.struct("pos", "key", "held"))).alias("posts"))
    nodes = own.join(prefixes.drop("keys", "id").dropDuplicates(["node"]), "node").join(classes, "node")
    nodes = materialize(nodes, "nodes")

    labels = None if nodes.isEmpty() else _links(texts, nodes, shared, words, percent)
    named = classes.select("node", F.col("id").alias("smallest"))
    if labels is not None:
        linked = labels.join(classes, labels["member"] == classes["node"]).select("member", "component", "id")
        least = linked.groupBy("component").agg(F.min("id").alias("least"))
        least = linked.join(least, "component").select(F.col("member").alias("node"), "least")
        named = named.join(least, "node", "left").select("node", F.coalesce("least", "smallest").alias("smallest"))
    out = rows.join(named, "node", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("smallest", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"))
