"""Near-duplicate groups by MinHash: an inverted join over signature coordinates.

1. A task turns texts into sets of hashed word shingles and MinHash signatures.
   Equal sets form a class; only the class representative (smallest id) goes on,
   so thousands of copies cost one row.
2. A signature coordinate is the joint value of ``width`` minima, so that texts
   which only share common phrases rarely agree in one.  Every representative is
   posted under each (coordinate, value) pair and the pairs are counted.  Ordered
   from rare to frequent, two signatures that agree in ``agree`` of ``coords``
   coordinates share one of the first ``coords - agree + 1`` pairs of each, so
   only this prefix is kept; pairs that one document alone holds fill the prefix
   and need no list, and the most frequent lists are skipped and only probed when
   the collisions of a candidate are counted.
3. Inside a list not all pairs are emitted.  Each round a list proposes its
   members against one or two of them; proposals whose parities, a lower bound
   of the difference of two sets, allow a link and that share ``SHARED_MINIMA``
   minima are compared on their full sets, and the links are merged into
   components.  A list whose members are all in one component needs nothing more.
   When few pairs that cross components are left, or rounds hardly lower their
   number, each of them is compared, so no link that could join two components is
   lost; parities rule most of these pairs out inside the join, before they become
   rows.

The only chance is in the signature.  Coordinates draw from the same minima, so
their agreements are correlated and the miss rate is simulated, with the picks
used here: of 2.4 million pairs at similarity 0.8 none agreed in fewer than 2 of
128 coordinates over 256 minima (80 over 128: 3.3e-4), nor did any of 600,000 at
0.82.  The binomial chance to fail ``SHARED_MINIMA`` or ``DIFFERENT_BITS`` at 0.8
is below 2e-10.  ``width`` should grow with the logarithm of the corpus: unrelated
texts of similarity s share a list with ``documents * s ** width`` others.

Defined cases: a text without words (or null) has an empty set and is linked with
nothing; fewer words than ``words`` make one shingle; a ``percent`` below
``LEAST_PERCENT`` is refused, because the limits on minima would lose its links; rows with equal text get
equal answers; a row with a null id takes part in nothing and has a null
component; an empty table gives no rows; further columns are not returned by
``near_groups`` and pass unchanged through ``keep_one_each``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsift.llm import bloom
from runsift.llm.components import components
from runsift.llm.shared import SpanHasher, chunks, materialize, mix64, word_bounds

MINIMA = 256
WIDTH = 7
COORDS = 128
AGREE = 2
#: The limits below are those of similarity 0.8; they are only looser for higher ones.
LEAST_PERCENT = 80
#: Minima that a pair must share before its full sets are read; seven deviations below the mean at similarity 0.8.
SHARED_MINIMA = 160
#: Of the lowest bits of the minima, so many may differ: seven deviations above the mean at similarity 0.8.
DIFFERENT_BITS = 60
#: Columns of those bits, 64 in each.
SKETCH = [f"s{k}" for k in range(1, MINIMA // 64 + 1)]
#: Bits of a set's parities.  They rule pairs out up to about as many shingles; a longer set only has more pairs compared.
PARITIES = 1024
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _shingles(hasher: SpanHasher, raw: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    raw = LOWER[raw]
    starts, ends, rows = word_bounds(raw, offsets)
    hashes = hasher(raw, starts, ends)
    step = np.uint64(0xD6E8FEB86659FD93)
    rolled = hashes.copy()
    for k in range(1, words):
        rolled = rolled[:-1] if len(rolled) else rolled
        rolled = mix64(rolled * step + hashes[k : k + len(rolled)])
    bounds = np.searchsorted(rows, np.arange(len(offsets)))
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        if hi - lo >= words:
            out.append(np.unique(rolled[lo : hi - words + 1]))
            continue
        short = hashes[lo:hi]
        if len(short):
            one = short[:1]
            for h in short[1:]:
                one = mix64(one * step + h)
            short = mix64(one + np.uint64(len(short)))
        out.append(short)
    return out


class _Signer:
    """Signature of a set: ``coords`` joint values of ``width`` minima out of ``MINIMA``."""

    def __init__(self, width: int, coords: int):
        draws = mix64(np.arange(1, 2 * MINIMA + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.odd, self.add = (draws[:MINIMA] | np.uint64(1))[:, None], draws[MINIMA:, None]
        order = np.random.default_rng(20).permuted(np.tile(np.arange(MINIMA), (coords, 1)), axis=1)
        self.picks = order[:, :width]
        self.salt = mix64(np.arange(1, coords + 1, dtype=np.uint64))

    def minima(self, values: np.ndarray) -> np.ndarray:
        best = np.zeros(0 if not len(values) else MINIMA, np.uint64)
        for at in range(0, len(values), 2048):
            low = ((values[at : at + 2048] * self.odd + self.add) >> np.uint64(32)).min(axis=1)
            best = low if not at else np.minimum(best, low)
        return best

    def joint(self, minima: np.ndarray) -> np.ndarray:
        """Values of the coordinates."""
        if not len(minima):
            return np.zeros(0, np.int64)
        joint = self.salt.copy()
        for column in minima[self.picks].T:
            joint = mix64(joint ^ column)
        return joint.view(np.int64)


def _sketch(minima: list[np.ndarray]) -> list[pa.Array]:
    """The lowest bit of each minimum, as the numbers of ``SKETCH`` a row."""
    bits = np.stack([m & np.uint64(1) if len(m) else np.zeros(MINIMA, np.uint64) for m in minima]).astype(np.uint8)
    packed = np.packbits(bits, axis=1).view(np.int64)
    return [pa.array(column) for column in packed.T]


def _parities(items: np.ndarray) -> np.ndarray:
    """Whether each remainder modulo ``PARITIES`` is that of an odd number of items, packed into 64-bit numbers."""
    counts = np.bincount((items % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def _sets_of(words: int, width: int, coords: int, with_sets: bool) -> Callable:
    """mapInArrow function over (id, text): the set's size, digest and coordinates, or sketches, minima and set."""

    def lists(arrays: list[np.ndarray], kind) -> pa.ListArray:
        return pa.ListArray.from_arrays(np.cumsum([0, *map(len, arrays)]).astype(np.int32), np.concatenate(arrays).astype(kind))


    def run(batches):
        hasher, signer = SpanHasher(), _Signer(width, coords)
        for batch in batches:
            for first, end, raw, offsets in chunks(batch.column(1)):
                sets = _shingles(hasher, raw, offsets, words)
                ids = batch.column(0).slice(first, end - first)
                minima = [signer.minima(s) for s in sets]
                if with_sets:
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array([len(v) for v in sets], pa.int32()), *_sketch(minima), lists([_parities(v) for v in sets], np.int64),
                         lists([m.astype(np.uint32).view(np.int32) for m in minima], np.int32), lists([v.view(np.int64) for v in sets], np.int64)],
                        ["id", "n", *SKETCH, "parity", "minima", "items"])
                else:
                    digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), lists([signer.joint(m) for m in minima], np.int64)],
                        ["id", "n_shingles", "digest", "sig"])

    return run


def _collisions(a: str, b: str) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))


def _similar(a: str, b: str, percent: int) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both * 100 >= (F.size(a) + F.size(b) - both) * percent


def _lists(reps: DataFrame, coords: int, agree: int) -> DataFrame:
    """(id, keys): the shared pairs in the prefix of each representative that has enough of them."""
    posts = reps.select("id", F.explode("sig").alias("key"))
    often = materialize(posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "pair-counts")
    # Most pairs are held by one document alone; a bit filter keeps them from the exchange.
    posts = bloom.maybe_in(posts, often, "key", "pair-bits")
    shared = posts.join(often, "key").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("keys"))
    prefix = F.slice("keys", 1, F.size("keys") - (agree - 1))
    return shared.where(F.size("keys") >= agree).select("id", F.transform(prefix, lambda pair: pair["key"]).alias("keys"))


def _may_link(one: str, other: str, percent: int) -> Column:
    """False only for pairs whose sizes rule a link out or whose sketches differ too much."""
    bits = sum(F.bit_count(F.col(f"{one}{k}").bitwiseXOR(F.col(f"{other}{k}"))) for k in SKETCH)
    sizes = [F.col(f"{one}n"), F.col(f"{other}n")]
    return (F.least(*sizes) * 100 >= F.greatest(*sizes) * percent) & (bits <= DIFFERENT_BITS)


def _proposals(open_lists: DataFrame, rounds: int, percent: int) -> DataFrame:
    """(a, b) pairs across components: each member of a list against one or two members of it."""
    member = F.struct("id", "comp", "n", *SKETCH)
    orders = [F.col("id")] if rounds == 0 else [F.xxhash64("id", F.lit(2 * rounds + i)) for i in (0, 1)]
    hubs = F.array(*[F.min_by(member, order) for order in orders])
    chosen = open_lists.groupBy("key").agg(hubs.alias("hubs")).select("key", F.explode("hubs").alias("hub"))
    pairs = open_lists.join(chosen, "key").where((F.col("comp") != F.col("hub.comp")) & _may_link("", "hub.", percent))
    return pairs.select(F.greatest("id", "hub.id").alias("a"), F.least("id", "hub.id").alias("b")).distinct()


def _few_apart(one: str, other: str, percent: int) -> Column:
    """False only for pairs whose parities rule a link out.

    An item that only one of two sets has flips one parity, so sets with more
    different parities than the items they may differ in are not similar.
    """
    apart = sum(F.bit_count(F.col(f"{one}parity")[k].bitwiseXOR(F.col(f"{other}parity")[k])) for k in range(PARITIES // 64))
    return apart * (100 + percent) <= (F.col(f"{one}n") + F.col(f"{other}n")) * (100 - percent)


def _without_apart(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that their parities do not rule out, before minima and sets are asked for.

    Around a large group many texts are near it and few are linked, so most
    proposals end here.
    """
    left, right = (sets.select(F.col("id").alias(k), F.col("n").alias(f"{k}_n"), F.col("parity").alias(f"{k}_parity")) for k in ("a", "b"))
    return pairs.join(left, "a").join(right, "b").where(_few_apart("a_", "b_", percent)).select("a", "b").distinct()


def _crossing(open_lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Every pair of a list that crosses components and may link."""
    lists = materialize(open_lists.join(sets.select("id", "parity"), "id"), "parity-lists")
    other = lists.select(*[F.col(c).alias(c if c == "key" else f"o_{c}") for c in lists.columns])
    crossing = (F.col("id") > F.col("o_id")) & (F.col("comp") != F.col("o_comp"))
    pairs = lists.join(other, "key").where(crossing & _may_link("", "o_", percent) & _few_apart("", "o_", percent))
    return pairs.select(F.col("id").alias("a"), F.col("o_id").alias("b")).distinct()


def _open_pairs(open_lists: DataFrame) -> tuple[int, int]:
    """Members of the lists with more than one component, and pairs in them that cross components."""
    held = open_lists.groupBy("key", "comp").agg(F.count("*").cast("double").alias("n"))
    lists = held.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same")).where("n * n > same")
    row = lists.agg(F.sum("n"), F.sum(F.col("n") * F.col("n") - F.col("same")) / 2).first()
    return int(row[0] or 0), int(row[1] or 0)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with a boolean ``linked``: enough shared minima, and then similar on the full sets.

    Only sets that a pair asks for move, behind a bit filter.
    """

    def both_sides(rows: DataFrame, column: str) -> DataFrame:
        wanted = materialize(rows.select(F.explode(F.array("a", "b")).alias("id")).distinct(), f"{column}-asked")  # counted and read again
        asked = bloom.maybe_in(sets.select("id", column), wanted, "id", f"{column}-bits")
        left, right = (asked.select(F.col("id").alias(k), F.col(column).alias(f"{column}_{k}")) for k in ("a", "b"))
        return rows.join(left, "a").join(right, "b")

    close = both_sides(materialize(pairs, "pairs"), "minima").select("a", "b", (_collisions("minima_a", "minima_b") >= SHARED_MINIMA).alias("close"))
    close = materialize(close, "collisions")
    full = both_sides(close.where("close").select("a", "b"), "items").select("a", "b", _similar("items_a", "items_b", percent).alias("linked"))
    return full.unionByName(close.where("not close").select("a", "b", F.lit(False).alias("linked")))


def _classes(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int,
             width: int, coords: int, agree: int) -> tuple[DataFrame, DataFrame]:
    """(id, n_shingles, digest) of every row, and (digest, component) of the classes with more than one document."""
    if percent < LEAST_PERCENT:
        raise ValueError(f"percent must be at least {LEAST_PERCENT}")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, n_shingles long, digest binary, sig array<long>"
    rows = materialize(texts.mapInArrow(_sets_of(words, width, coords, False), schema), "signatures")
    reps = materialize(
        rows.where("id is not null and n_shingles > 0").groupBy("digest")
        .agg(F.min("id").alias("id"), F.first("sig").alias("sig"), F.count("*").alias("copies")), "classes")
    lists = materialize(_lists(reps, coords, agree), "prefix-lists")
    copied = reps.where("copies > 1").select("digest", F.col("id").alias("component"))
    if lists.isEmpty():
        return rows, copied

    wanted = lists.select("id")
    bits = bloom.size_for(wanted.count())
    maybe = bloom.with_maybe(texts, "id", materialize(bloom.present_bits(wanted, "id", bits), "candidate-bits"), bits, "maybe")
    schema = f"id long, n int, {', '.join(f'{k} long' for k in SKETCH)}, parity array<long>, minima array<int>, items array<long>"
    sets = materialize(
        maybe.where("maybe").select("id", "text").join(wanted, "id", "left_semi").mapInArrow(_sets_of(words, width, coords, True), schema), "sets")

    nodes = materialize(lists.join(sets.select("id", "n", *SKETCH), "id"), "candidates")
    checked, labels, rounds, new, before = None, None, 0, 1, float("inf")
    while True:
        member = ["id", "comp", "n", *SKETCH, F.explode("keys").alias("key")]
        if labels is None:
            open_lists = nodes.withColumn("comp", F.col("id")).select(*member)  # a list of one member proposes nothing
        else:
            labelled = nodes.join(labels, nodes["id"] == labels["node"], "left").withColumn("comp", F.coalesce("component", "id")).select(*member)
            unsettled = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
            unsettled = materialize(unsettled, "unsettled")
            open_lists = materialize(bloom.maybe_in(labelled, unsettled, "key", "unsettled-bits").join(unsettled, "key", "left_semi"), "open-lists")
        members, crossing = _open_pairs(open_lists)
        last = crossing <= 4 * members or not new or crossing > 0.7 * before
        before = crossing
        pairs = _crossing(open_lists, sets, percent) if last else _proposals(open_lists, rounds, percent)
        if checked is not None:
            pairs = pairs.join(checked, ["a", "b"], "left_anti")
        if not last:
            pairs = _without_apart(pairs, sets, percent)
        found = materialize(_verified(pairs, sets, percent), "compared")
        new = found.where("linked").count()
        checked = found if checked is None else checked.unionByName(found)
        if new:
            labels = materialize(components(checked.where("linked").select("a", "b")), "components")
        if last:
            break
        rounds += 1
    if labels is None:
        return rows, copied
    found = reps.join(labels, reps["id"] == labels["node"], "left").where("copies > 1 or node is not null")
    return rows, found.select("digest", F.coalesce("component", "id").alias("component"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80,
                width: int = WIDTH, coords: int = COORDS, agree: int = AGREE) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept (the id is its component's smallest)."""
    rows, classes = _classes(docs, id_col, text_col, words, percent, width, coords, agree)
    classes = materialize(classes, "class-components")
    named = rows.join(classes, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return named.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"),
                        F.col("id").eqNullSafe(component).alias("kept"))


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those that have a smaller near copy, all columns.

    Only ids of dropped rows are joined, behind a bit filter, so the rows that
    stay are not shuffled unless the filter lets them through.
    """
    gone = near_groups(docs, id_col, text_col, words, percent).where("not kept").select(F.col(id_col).alias("__gone"))
    gone = materialize(gone.distinct(), "near-copies")
    bits = bloom.size_for(gone.count())
    table = materialize(bloom.present_bits(gone, "__gone", bits), "near-copy-bits")
    marked = bloom.with_maybe(docs.withColumn("__id", F.col(id_col).cast("long")), "__id", table, bits, "__maybe")
    doubtful = marked.where("__maybe").join(gone, F.col("__id") == F.col("__gone"), "left_anti")
    return marked.where("not __maybe").select(*docs.columns).unionByName(doubtful.select(*docs.columns))
