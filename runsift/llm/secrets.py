"""Secrets in texts: fixed patterns, and a linear-chain conditional random field that adds spans.

The patterns give the base spans.  The field tags every token of a line as begin,
inside or outside; words (runs of letters, digits, + / _ - and bytes outside
ASCII) and single other signs are the elements of its chains, and a line is a
chain.  Features are the shape of a token, the words and signs beside it and
rates of the whole text.  Viterbi is exact: tokens that are outside whatever
their neighbours are cut a chain, and only what lies between them is decoded.

The field learns from at most ``sample`` texts that hold a base span and as many
others, in hash order, in pieces of lines of at most ``PIECE`` tokens: every
piece that holds a base span, and one in ``DRAWN`` of the others with that weight.
The value of an assignment is its span.  Features of the pattern match itself are
not among its inputs, so it also finds secrets that the patterns miss.  Scoring
reads every whole text once, a megabyte at a time, and shuffles nothing.

Defined cases: null counts as the empty text, which has no spans; offsets are
code points; equal spans of different kinds are listed in the order of the
kinds; equal texts get equal spans; without a base span in the sample only base
spans are given; an empty table gives no rows; further columns are not used.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsift.llm.crf import Chains, LinearChain
from runsift.llm.shared import chunks, mix64

SAMPLE = 2000
PIECE = 32
DRAWN = 16
#: Fixed patterns; a match of the first kind counts if its second group has 12 characters.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "field")
KEY_WORD = re.compile(rb"key|secret|token|passw|pwd|auth|credential|bearer|private|access", re.I)
OUT, BEGIN, INSIDE = 0, 1, 2


def _bytes(members) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


DIGIT, UPPER, LOWER, JOIN, WIDE = _bytes(range(48, 58)), _bytes(range(65, 91)), _bytes(range(97, 123)), _bytes(b"+/_-"), _bytes(range(128, 256))
WORD, BLANK = DIGIT | UPPER | LOWER | JOIN | WIDE, _bytes(b" \t\n\v\f\r")
KIND = DIGIT + 2 * UPPER + 3 * LOWER + 4 * JOIN + 5 * WIDE
FEATURES = 37


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches in order."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def _targets(text: str) -> list[tuple[int, int]]:
    """(start, end) of the base spans; of an assignment, its value."""
    spans = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    return spans + [m.span() for pattern in (ACCESS, HEX) for m in pattern.finditer(text)]


def _sums(hits: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(hits, dtype=np.int32)))


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end (code points) of every token, lengths of the chains (lines), and features."""
    word, edge = WORD[raw], np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    solid = ~BLANK[raw]
    before, after = np.append(False, word[:-1])[: len(raw)], np.append(word[1:], False)[: len(raw)]
    starts = np.flatnonzero(solid & (~word | ~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~word | ~after | edge[1:])) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    points = _sums((raw & 0xC0) != 0x80)
    base = points[offsets[rows]]
    if not len(starts):
        return rows, starts, ends, np.zeros(0, np.int64), np.zeros((0, FEATURES), np.float32)
    lines = _sums(raw == 10)[starts]
    fresh = np.append(True, (rows[1:] != rows[:-1]) | (lines[1:] != lines[:-1]))
    heads = np.flatnonzero(fresh)
    lengths = np.diff(np.append(heads, len(starts)))
    place = np.arange(len(starts)) - np.repeat(heads, lengths)

    n = (ends - starts).astype(np.float32)
    share = lambda table: (lambda sums: (sums[ends] - sums[starts]) / n)(_sums(table[raw]))
    digits, upper, lower, signs, wide = map(share, (DIGIT, UPPER, LOWER, JOIN, WIDE))
    kind = KIND[raw]
    turn = _sums(np.append(kind[1:] != kind[:-1], False))
    turns = (turn[ends - 1] - turn[starts]) / n
    distinct, long = np.zeros(len(starts), np.float32), np.flatnonzero(n >= 10)
    if len(long):
        size = ends[long] - starts[long]
        owner = np.repeat(np.arange(len(long)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + starts[long][owner]
        pairs = np.unique(owner * 256 + raw[at])
        distinct[long] = np.bincount(pairs >> 8, minlength=len(long)) / size
    key = np.zeros(len(raw), bool)
    key[[m.start() for m in KEY_WORD.finditer(raw.tobytes())]] = True
    held = _sums(key)
    key = held[ends] > held[starts]
    sign = raw[starts]
    single = ~WORD[sign]
    equals, quote = single & ((sign == 61) | (sign == 58)), single & ((sign == 34) | (sign == 39) | (sign == 96))
    gap = np.append(True, starts[1:] > ends[:-1])

    def shifted(values: np.ndarray, by: int) -> np.ndarray:
        """Values of the token ``by`` places before (after, where negative) in the line, else 0."""
        out = np.zeros(len(values), values.dtype)
        if by > 0:
            out[by:] = values[:-by]
            out[place < by] = 0
        else:
            out[:by] = values[-by:]
            out[np.append(fresh[1:], True)] = 0
        return out

    near = np.zeros(len(starts), bool)
    for by in range(1, 6):
        near |= shifted(key, by) if len(starts) > by else False
    one, two = (shifted(equals, k) if len(starts) > k else np.zeros(len(starts), bool) for k in (1, 2))
    quoted = shifted(quote, 1) if len(starts) > 1 else np.zeros(len(starts), bool)
    closed = shifted(quote, -1) if len(starts) > 1 else np.zeros(len(starts), bool)
    odd = single & ~equals & ~quote
    mixed = (digits > 0) & (upper + lower > 0)
    size = np.maximum(np.diff(offsets), 1)
    rates = [np.minimum(np.diff(_sums(raw == c)[offsets]) * 50 / size, 1)[rows] for c in b"={;\n"]
    columns = [
        np.ones(len(starts)), *[n >= k for k in (4, 7, 10, 16, 20, 32, 64)], distinct, digits, digits > 0.25, upper, upper == 0, signs, turns, turns > 0.4,
        mixed, mixed & (n >= 10), mixed & (n >= 16), wide > 0, single, equals, quote, odd, key, near, near & (one | two), one, two,
        quoted, closed, gap, place == 0, *rates]
    x = np.empty((FEATURES, len(starts)), np.float32)
    for k, column in enumerate(columns):
        x[k] = column
    return rows, points[starts] - base, points[ends] - base, lengths, x.T


def _labels(starts: np.ndarray, ends: np.ndarray, targets: list[tuple[int, int]]) -> np.ndarray:
    """Begin, inside or outside of each token of a text."""
    y = np.full(len(starts), OUT, np.int64)
    for a, b in targets:
        lo, hi = np.searchsorted(ends, a, side="right"), np.searchsorted(starts, b)
        if lo < hi:
            y[lo] = y[lo] or BEGIN
            y[lo + 1 : hi] = np.where(y[lo + 1 : hi] == OUT, INSIDE, y[lo + 1 : hi])
    return y


def _sample_tokens(batches):
    for batch in batches:
        for first, end, raw, offsets in chunks(batch.column(1)):
            part = batch.slice(first, end - first)
            rows, starts, ends, lengths, x = tokens(raw, offsets)
            heads = np.cumsum(lengths) - lengths
            place = np.arange(len(rows)) - np.repeat(heads, lengths)
            cuts = np.flatnonzero(place % PIECE == 0)
            ids, pieces = [], []
            for row, (key, text) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist())):
                lo, hi = np.searchsorted(rows, [row, row + 1])
                y = _labels(starts[lo:hi], ends[lo:hi], _targets(text or ""))
                own = np.append(cuts[np.searchsorted(cuts, lo) : np.searchsorted(cuts, hi)], hi)
                drawn = mix64(np.arange(len(own), dtype=np.uint64) + np.uint64(zlib.crc32(str(key).encode()) << 20)) % np.uint64(DRAWN) == 0
                for k, (a, b) in enumerate(zip(own[:-1], own[1:])):
                    tags = y[a - lo : b - lo]
                    hit = bool(tags.any())
                    if not hit and not drawn[k]:
                        continue
                    if tags[0] == INSIDE:  # a span cut by the end of a piece begins anew
                        tags = np.append(BEGIN, tags[1:])
                    ids.append(key)
                    pieces.append(np.column_stack([tags, np.full(b - a, 1 if hit else DRAWN), x[a:b]]).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(pieces, pa.binary())], ["id", "chain"])


def fit(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> LinearChain | None:
    """The field, or None without a base span in the sample."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # A cheap superset of the texts with base spans; the spans themselves come from the patterns.
    maybe = F.coalesce(F.col("text").rlike(r"(?i)(passw|secret|token|api_?key)|AKIA|[0-9a-f]{16}"), F.lit(False))
    marked = texts.select("id", maybe.alias("maybe"))
    order = [F.xxhash64("id"), F.col("id")]
    chosen = marked.where("maybe").orderBy(*order).limit(sample).unionByName(marked.where("not maybe").orderBy(*order).limit(sample))
    # At most 2 * ``sample`` ids are broadcast.
    rows = texts.join(F.broadcast(chosen.select("id").distinct()), "id", "left_semi")
    frame = rows.mapInArrow(_sample_tokens, f"id {texts.schema['id'].dataType.simpleString()}, chain binary").toPandas().sort_values(["id", "chain"])
    width = FEATURES + 2
    parts = [np.frombuffer(b, "<f4").reshape(-1, width) for b in frame["chain"]]
    if not parts:
        return None
    stacked = np.concatenate(parts).astype(float)
    y = stacked[:, 0].astype(int)
    if not y.any():
        return None
    field = LinearChain(3, FEATURES, forbidden=[(OUT, INSIDE)], not_first=[INSIDE])
    return field.fit(stacked[:, 2:], y, Chains([len(p) for p in parts]), weight=stacked[:, 1])


def _decoded(field: LinearChain, raw: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of the spans that the field tags, for each text."""
    rows, starts, ends, lengths, x = tokens(raw, offsets)
    out: list[list[tuple[int, int, int]]] = [[] for _ in offsets[1:]]
    if not len(rows):
        return out
    tags = field.viterbi_mostly_out(x, lengths)
    for k in np.flatnonzero(tags).tolist():
        spans = out[rows[k]]
        if tags[k] == BEGIN:
            spans.append((int(starts[k]), 3, int(ends[k])))
        else:
            spans[-1] = (spans[-1][0], 3, int(ends[k]))
    return out


def _finder(field: LinearChain | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    name = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)

    def run(batches):
        for batch in batches:
            for first, end, raw, offsets in chunks(batch.column(1)):
                part = batch.slice(first, end - first)
                texts = [t or "" for t in part.column(1).to_pylist()]
                base = [base_spans(t) for t in texts]
                added = _decoded(field, raw, offsets) if field is not None else [[] for _ in texts]
                counts = [pa.array([sum(k == kind for _, k, _ in spans) for spans in base], pa.int64()) for kind in range(3)]
                shas = [hashlib.sha256(name(spans).encode()).hexdigest() for spans in base]
                both = [name(sorted(b + a)) for b, a in zip(base, added)]
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array(shas, pa.string()), pa.array(both, pa.string())],
                                                 ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def find(docs: DataFrame, field: LinearChain | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_assign, n_access, n_hex, base_sha256, spans (base and tagged, ``kind:start:end``)."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {texts.schema['id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return texts.mapInArrow(_finder(field), schema).withColumnRenamed("id", id_col)
