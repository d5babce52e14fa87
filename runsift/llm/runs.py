"""Periodic runs of words, found on a Re-Pair grammar of the word ids.

A run is a stretch of words with smallest period ``q`` and at least
``max(MIN_WORDS, MIN_PERIODS * q)`` words that no neighbouring word extends
keeping that period.

1. A task takes about a megabyte of texts at a time (a longer text alone),
   numbers their words and builds one Re-Pair grammar over all of them: in every
   round each repeated pair that outranks the pairs it overlaps (by frequency
   class, then by hash) becomes a nonterminal, everywhere at once, until no pair
   of neighbours occurs twice.  Pairs never cross texts.
2. What is left of a text is bound by a balanced binary tree, whose nodes occur
   once each.  A run lies in a lowest node and crosses the boundary between its
   two children, with two periods at least on one side.  So for each nonterminal,
   and each tree node, the runs across its boundary are computed once: a period
   ``q`` comes into question where the words at the boundary recur ``q`` words
   later (or earlier), and is extended both ways by binary search over prefix
   hashes.  Nonterminals are looked at once however often they occur.
3. Runs of nonterminals are carried to all places where the derivation holds
   them.  A place where a neighbouring word extends the run is left out, because
   the whole run crosses the boundary of a node further up; equal intervals are
   merged and keep the smallest period.

Every interval is compared word by word before it counts, so hashes decide
nothing: should they fail for a chunk, its texts are compared shift by shift.
Work is O(n log n) hashed comparisons in a text of n words.

Defined cases: a null or empty text, or one without words, has no run and an
empty collapsed text; a row with a null id is answered like any other (and not
rearranged); repeated rows each get their answer; runs are ordered by start,
then period; an empty table gives no rows; further columns are not returned.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsift.llm.shared import chunks, mix64

MIN_WORDS = 6
MIN_PERIODS = 4
#: Boundary tests done at once.
SLICE = 1 << 21
#: Words compared at the boundary, by period: never more than the period.
GRAMS = np.array([1, 2, 4, 8])
GRAM_OF = np.array([0, 0, 1, 1, 2, 2, 2, 2, 3])


def _ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place in its owner) of every element of groups of the given sizes."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


class Grammar:
    """Re-Pair rules over the word ids of several texts, and the sequences that are left of them."""

    def __init__(self, words: np.ndarray, text: np.ndarray):
        self.terminals = int(words.max()) + 1 if len(words) else 0
        self.left = self.right = self.at = np.zeros(0, np.int64)
        #: Rules below each round's end, so that a round uses earlier rounds only.
        self.rounds = [0]
        self.sizes = np.ones(self.terminals, np.int64)
        self.symbols, self.starts, self.text = words.astype(np.int64), np.arange(len(words)), text
        self._known, self._names = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while self._round():
            pass

    def _repeated(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and pairs of the neighbours in one text that occur twice or more."""
        pairs = (self.symbols[:-1] << 32) | self.symbols[1:]
        inside = np.flatnonzero(self.text[:-1] == self.text[1:])
        slots = (mix64(pairs[inside].astype(np.uint64)) >> np.uint64(44)).astype(np.int64)
        inside = inside[np.bincount(slots, minlength=1)[slots] > 1]  # most pairs that occur once go here, unsorted
        return inside, pairs[inside]

    def _round(self) -> bool:
        places, pairs = self._repeated() if len(self.symbols) > 1 else (np.zeros(0, np.int64),) * 2
        distinct, which, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        order = (np.log2(counts).astype(np.uint64) << np.uint64(58)) | (mix64(distinct.astype(np.uint64)) >> np.uint64(6))
        ranks = np.empty(len(distinct), np.int64)
        ranks[np.lexsort((distinct, order))] = np.arange(1, len(distinct) + 1)
        rank = np.zeros(len(self.symbols), np.int64)
        rank[places] = np.where(counts > 1, ranks, 0)[which]
        # Stretches of one pair (a a a a) take every second place.
        heads = np.flatnonzero(np.diff(rank, prepend=-1))
        around = np.concatenate(([0], rank[heads], [0]))
        wins = (around[1:-1] > around[:-2]) & (around[1:-1] > around[2:])
        lengths = np.diff(np.append(heads, len(rank)))[wins]
        owner, step = _ragged((lengths + 1) // 2)
        taken = heads[wins][owner] + 2 * step
        if not len(taken):
            return False
        self._replace(taken)
        return True

    def _replace(self, taken: np.ndarray) -> None:
        pairs = (self.symbols[taken] << 32) | self.symbols[taken + 1]
        distinct, first, which = np.unique(pairs, return_index=True, return_inverse=True)
        spot = np.searchsorted(self._known, distinct)
        known = spot < len(self._known)
        known[known] = self._known[spot[known]] == distinct[known]
        names = np.empty(len(distinct), np.int64)
        names[known] = self._names[spot[known]]
        fresh = ~known
        names[fresh] = self.terminals + len(self.left) + np.arange(fresh.sum())
        left, right = distinct[fresh] >> 32, distinct[fresh] & 0xFFFFFFFF
        self.left, self.right = np.append(self.left, left), np.append(self.right, right)
        self.at = np.append(self.at, self.starts[taken[first[fresh]]])
        self.sizes = np.append(self.sizes, self.sizes[left] + self.sizes[right])
        self.rounds.append(len(self.left))
        order = np.argsort(np.append(self._known, distinct[fresh]), kind="stable")
        self._known = np.append(self._known, distinct[fresh])[order]
        self._names = np.append(self._names, names[fresh])[order]
        self.symbols[taken] = names[which]
        stay = np.ones(len(self.symbols), bool)
        stay[taken + 1] = False
        self.symbols, self.starts, self.text = self.symbols[stay], self.starts[stay], self.text[stay]

    def rule_nodes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window start, boundary and window end of every rule, at its first place."""
        return self.at, self.at + self.sizes[self.left], self.at + self.sizes[self.terminals :]

    def tree_nodes(self, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of the nodes of balanced trees over what is left of each text."""
        m = len(self.symbols)
        head = np.searchsorted(self.text, self.text, side="left")
        place, last = np.arange(m) - head, np.searchsorted(self.text, self.text, side="right")
        found, half = [], 1
        while (here := np.flatnonzero(place % (2 * half) == half)).size:
            stop = here + half
            whole = stop < last[here]
            end = np.where(whole, self.starts[np.minimum(stop, m - 1)], ends[self.text[here]])
            found.append((self.starts[here - half], self.starts[here], end))
            half *= 2
        return tuple(np.concatenate(part) for part in zip(*found)) if found else (np.zeros(0, np.int64),) * 3

    def places(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rule, position) of every occurrence of the wanted rules (a mask) in the texts."""
        below = np.concatenate((np.zeros(self.terminals, bool), wanted))
        for a, b in zip(self.rounds[:-1], self.rounds[1:]):
            below[self.terminals + a : self.terminals + b] |= below[self.left[a:b]] | below[self.right[a:b]]
        symbols, at = self.symbols, self.starts
        rules, positions = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while True:
            hold = below[symbols]
            rule, at = symbols[hold] - self.terminals, at[hold]
            if not len(rule):
                return np.concatenate(rules), np.concatenate(positions)
            keep = wanted[rule]
            rules.append(rule[keep])
            positions.append(at[keep])
            symbols = np.concatenate((self.left[rule], self.right[rule]))
            at = np.concatenate((at, at + self.sizes[self.left[rule]]))


class Stretches:
    """Equality of stretches of words by prefix hashes."""

    BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        powers = np.full(self.n + 1, self.BASE, np.uint64)
        powers[0] = 1
        self.down = np.full(self.n + 1, self.INVERSE, np.uint64)
        self.down[0] = 1
        np.cumprod(self.down, out=self.down)
        self.upto = np.zeros(self.n + 1, np.uint64)
        np.cumsum(mix64(words.astype(np.uint64) + np.uint64(1)) * np.cumprod(powers)[:-1], out=self.upto[1:])
        ends = np.minimum(np.arange(self.n)[None, :] + GRAMS[:, None], self.n)
        self.grams = ((self.upto[ends] - self.upto[:-1]) * self.down[:-1]).ravel()

    def _same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.upto[a + size] - self.upto[a]) * self.down[a] == (self.upto[b + size] - self.upto[b]) * self.down[b]

    def reach(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words after (before) the positions a and b agree, ``most`` at most."""
        low, high = np.zeros_like(most), most.copy()
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            shift = middle if back else 0
            same = self._same(a - shift, b - shift, middle)
            low = np.where(open_ & same, middle, low)
            high = np.where(open_ & ~same, middle - 1, high)
        return low

    def across(self, lo: np.ndarray, cut: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(node, start, end, period) of the long repeats across the boundary of nodes, inside their windows."""
        room = np.where(hi - lo >= MIN_WORDS, (hi - lo) // MIN_PERIODS, 0)
        for back in (False, True):
            most = np.minimum(room, (cut - lo if back else hi - cut) // 2)
            nodes = np.flatnonzero(most)
            upto = np.cumsum(most[nodes])
            first = 0
            while first < len(nodes):
                done = upto[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(upto, done + SLICE, side="right")))
                owner, place = _ragged(most[nodes[first:last]])
                node, period = nodes[first:last][owner], place + 1
                gram = GRAM_OF[np.minimum(period, 8)]
                probe = cut[node] - (GRAMS[gram] if back else 0)
                other = probe - period if back else probe + period
                row = gram * self.n
                hit = self.grams[row + probe] == self.grams[row + other]
                yield self._extended(lo, cut, hi, node[hit], period[hit], back)
                first = last

    def _extended(self, lo, cut, hi, node, period, back: bool):
        b = cut[node]
        one, two = (b - period, b) if back else (b, b + period)
        start = one - self.reach(one, two, one - lo[node], back=True)
        end = two + self.reach(one, two, hi[node] - two)
        long = end - start >= np.maximum(MIN_WORDS, MIN_PERIODS * period)
        return node[long], start[long], end[long], period[long]


def _smallest(owner, start, end, period) -> tuple[np.ndarray, ...]:
    """One row per owner and interval, with its smallest period."""
    order = np.lexsort((period, end, start, owner))
    rows = [column[order] for column in (owner, start, end, period)]
    new = np.ones(len(order), bool)
    new[1:] = np.any([column[1:] != column[:-1] for column in rows[:3]], axis=0)
    return tuple(column[new] for column in rows)


def _holds(words, start, end, period) -> bool:
    """Whether all intervals have their period, word by word."""
    sizes = end - start - period
    upto = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        done = upto[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(upto, done + SLICE, side="right")))
        owner, place = _ragged(sizes[first:last])
        at = start[first:last][owner] + place
        if not np.array_equal(words[at], words[at + period[first:last][owner]]):
            return False
        first = last
    return True


def _by_shifts(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, end, period) of all runs by comparing each text with itself, shift by shift."""
    found = [np.zeros((0, 3), np.int64)]
    for a, b in zip(bounds[:-1], bounds[1:]):
        for q in range(1, (b - a) // MIN_PERIODS + 1):
            same = np.concatenate(([False], words[a : b - q] == words[a + q : b], [False]))
            edges = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
            edges = edges[edges[:, 1] - edges[:, 0] + q >= max(MIN_WORDS, MIN_PERIODS * q)]
            found.append(np.column_stack((edges[:, 0] + a, edges[:, 1] + a + q, np.full(len(edges), q))))
    start, end, period = np.concatenate(found).T
    return _smallest(np.zeros(len(start), np.int64), start, end, period)[1:]


def word_runs(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of the texts whose word ids lie between ``bounds``, ordered by start, then period."""
    empty = (np.zeros(0, np.int64),) * 3
    if not len(words):
        return empty
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    ends = bounds[1:]
    grammar, stretches = Grammar(words, text), Stretches(words)

    def collected(nodes):
        parts = [empty + (empty[0],), *stretches.across(*nodes)]
        rows = _smallest(*[np.concatenate(part) for part in zip(*parts)])
        return rows if _holds(words, *rows[1:]) else None

    of_rules, of_trees = collected(grammar.rule_nodes()), collected(grammar.tree_nodes(ends))
    if of_rules is None or of_trees is None:
        start, end, period = _by_shifts(words, bounds)
    else:
        rule, start, end, period = of_rules
        wanted = np.zeros(len(grammar.left), bool)
        wanted[rule] = True
        which, at = grammar.places(wanted)
        low, high = np.searchsorted(rule, which, side="left"), np.searchsorted(rule, which, side="right")
        owner, place = _ragged(high - low)
        one, moved = low[owner] + place, (at - grammar.at[which])[owner]
        start, end, period = (np.concatenate((mine, tree)) for mine, tree in zip(
            (start[one] + moved, end[one] + moved, period[one]), of_trees[1:]))
        home = text[start]
        left = np.maximum(start - 1, bounds[home])
        right = np.minimum(end, ends[home] - 1)
        ends_left = (start == bounds[home]) | (words[left] != words[left + period])
        ends_right = (end == ends[home]) | (words[right] != words[right - period])
        whole = ends_left & ends_right
        start, end, period = start[whole], end[whole], period[whole]
    _, start, end, period = _smallest(np.zeros(len(start), np.int64), start, end, period)
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _rows(rearrange: Callable[[int, int], np.ndarray | None] | None) -> Callable:
    """mapInArrow function over (id, text): the words' number, runs and collapsed text of every row."""
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            for first, end, raw, offsets in chunks(batch.column(1)):
                ids = batch.column(0).slice(first, end - first)
                names: dict[bytes, int] = defaultdict(count().__next__)
                texts, numbers = [], []
                data = raw.tobytes()
                for id_, a, b in zip(ids.to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                    words = data[a:b].split()
                    order = rearrange(id_, len(words)) if rearrange and id_ is not None and words else None
                    if order is not None:
                        words = [words[i] for i in order.tolist()]
                    texts.append(words)
                    numbers.extend(map(names.__getitem__, words))
                bounds = np.cumsum([0, *map(len, texts)])
                start, stop, period = word_runs(np.array(numbers, np.int64), bounds)
                fall = np.zeros(bounds[-1] + 1, np.int64)
                np.add.at(fall, start + period, 1)
                np.add.at(fall, stop, -1)
                kept = np.cumsum(fall[:-1]) == 0
                home = np.searchsorted(bounds, start, side="right") - 1
                cut = np.searchsorted(home, np.arange(len(texts) + 1)).astype(np.int32)
                collapsed = [b" ".join(compress(words, kept[a:b].tolist())) for words, a, b in zip(texts, bounds[:-1], bounds[1:])]
                found = pa.StructArray.from_arrays(
                    [pa.array(start - bounds[home]), pa.array(stop - start), pa.array(period)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(cut), found).cast(run_type),
                     pa.array(collapsed, pa.binary()).cast(pa.string())], ["id", "n_words", "runs", "collapsed"])

    return run


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              rearrange: Callable[[int, int], np.ndarray | None] | None = None) -> DataFrame:
    """One row per row of ``docs``: id, n_words, runs (start, length, period) and the text with repeats collapsed.

    Words are runs of other bytes than space and 0x09 to 0x0D.  Of each run the
    first period stays.  ``rearrange(id, number of words)`` may give an order of
    word numbers that replaces the text's own.
    """
    quoted = lambda name: F.col("`" + name.replace("`", "``") + "`")
    texts = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text"))
    schema = "id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return texts.mapInArrow(_rows(rearrange), schema).withColumnRenamed("id", id_col)
