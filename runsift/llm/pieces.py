"""Token counts and encodings with a subword model whose pieces never cross a whitespace marker.

Such a text falls apart at its spaces: a chunk is the spaces before a word and
the word.  Each distinct chunk of a task is segmented once.

``count_tokens`` merges all new chunks of a batch at the same time in ragged
numpy arrays: every step finds the best pair of each sequence and applies it,
until no sequence has a pair left, and the symbols that survive are counted (a
symbol outside the vocabulary counts as its bytes).  ``encode`` keeps a table
from chunk to ids and joins the ids back by position.

Defined cases: null counts as the empty text, which has no tokens; texts of any
length are whole; an empty table gives no rows; further columns are not used.
A model in which a piece crosses a marker is refused.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsift.llm.shared import chunks as text_groups

MARK = "▁"
#: Distinct chunks that a task remembers between groups of texts; beyond that it starts a new table.
TABLE_SIZE = 200_000
#: Characters merged at once in count_tokens.
MERGE_CHARS = 1 << 20


def load(model: bytes):
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_proto=model)
    for i in range(processor.get_piece_size()):
        if MARK in processor.id_to_piece(i).lstrip(MARK):
            raise ValueError("a piece of this model crosses a whitespace marker")
    return processor


class RankMerger:
    """Applies the best pair of many symbol sequences at once."""

    def __init__(self, processor):
        special = lambda i: processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i) or processor.is_unused(i)
        plain = [i for i in range(processor.get_piece_size()) if not special(i)]
        pieces = [processor.id_to_piece(i) for i in plain]
        # Rank of a piece: place in falling score.  Symbols are numbered by rank.
        order = np.argsort([-processor.get_score(i) for i in plain], kind="stable")
        self.pieces = [pieces[k] for k in order]
        self.number = {p: k for k, p in enumerate(self.pieces)}
        self.known = len(self.pieces)
        pairs = {}
        for whole, k in self.number.items():
            for cut in range(1, len(whole)):
                left, right = self.number.get(whole[:cut]), self.number.get(whole[cut:])
                if left is not None and right is not None:
                    pairs[left * self.known + right] = k
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.singles = np.full(0x110000, -1, np.int64)
        for piece, k in self.number.items():
            if len(piece) == 1:
                self.singles[ord(piece)] = k

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = np.where((left < 0) | (right < 0), -1, left * self.known + right)
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_rank[at], self.known)

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each word: symbols that survive, bytes of those outside the vocabulary."""
        out = np.zeros(len(words), np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        symbols = self.singles[codes]
        extra = np.where(codes < 0x80, 1, np.where(codes < 0x800, 2, np.where(codes < 0x10000, 3, 4)))
        np.add.at(out, owner, np.where(symbols < 0, extra, 1))
        following = np.append(owner[1:] == owner[:-1], False)
        ranks = np.full(len(symbols), self.known, np.int64)
        ranks[:-1] = np.where(following[:-1], self._ranks(symbols[:-1], symbols[1:]), self.known)
        while len(symbols):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(ranks, starts)
            # Sequences without a pair are done; the others go on.
            alive = best < self.known
            if not alive.any():
                break
            lengths = np.diff(np.append(starts, len(symbols)))
            if not alive.all():
                keep = np.repeat(alive, lengths)
                symbols, ranks, owner = symbols[keep], ranks[keep], owner[keep]
                best, lengths = best[alive], lengths[alive]
                starts = np.append(0, np.cumsum(lengths)[:-1])
            hits = np.flatnonzero(ranks == np.repeat(best, lengths))
            at = hits[np.append(True, owner[hits[1:]] != owner[hits[:-1]])]  # the leftmost of each sequence
            symbols[at] = best
            np.subtract.at(out, owner[at], 1)
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            symbols, ranks, owner, at = symbols[keep], ranks[keep], owner[keep], moved[at]
            for i in (at, at[at > 0] - 1):  # pairs beside the merged symbol
                j = np.minimum(i + 1, len(symbols) - 1)
                inside = (j > i) & (owner[i] == owner[j])
                ranks[i] = np.where(inside, self._ranks(symbols[i], symbols[j]), self.known)
        return out


CHUNK = re.compile(r" *[^ \n]+| +|\n")
MARKED = re.compile(r" *[^ ]+| +")


def _groups_of(column: pa.Array):
    """The texts of a batch in groups of about a megabyte, so a batch is never held as Python strings."""
    for first, end, _, _ in text_groups(column):
        yield [text or "" for text in column.slice(first, end - first).to_pylist()]


def _counter(model: bytes) -> Callable:
    def run(batches):
        merger, table = RankMerger(load(model)), {}
        for batch in batches:
            n_bytes, n_tokens = [], []
            for texts in _groups_of(batch.column(1)):
                n_bytes += [len(text.encode()) for text in texts]
                # A line break is in no piece, so it ends a chunk as well.
                split = [CHUNK.findall(" " + text.replace(MARK, " ")) if text else [] for text in texts]
                if len(table) > TABLE_SIZE:
                    table.clear()
                fresh = list({chunk for chunks in split for chunk in chunks}.difference(table))
                for group in _groups(fresh):
                    table.update(zip(group, merger.counts([w.replace(" ", MARK) for w in group]).tolist()))
                n_tokens += [sum(map(table.__getitem__, chunks)) for chunks in split]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())],
                                             ["id", "n_bytes", "n_tokens"])

    return run


def _groups(words: list[str]):
    group, held = [], 0
    for word in words:
        group.append(word)
        held += len(word)
        if held >= MERGE_CHARS:
            yield group
            group, held = [], 0
    if group:
        yield group


def count_tokens(docs: DataFrame, model: bytes, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = texts.mapInArrow(_counter(model), f"id {texts.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _segment(processor, words: list[str]) -> list[bytes]:
    """Ids of each marked chunk as little-endian 32-bit integers."""
    # The library puts a marker in front of what it gets; a chunk brings its own.
    lists = processor.encode([w[1:] for w in words], num_threads=1)
    alone = processor.piece_to_id(MARK)
    return [np.array(ids if w != " " else [alone], "<u4").tobytes() for w, ids in zip(words, lists)]


def _encoder(model: bytes, keep_ids: bool) -> Callable:
    def run(batches):
        processor, table = load(model), {}
        begin, end = (np.array([i], "<u4").tobytes() for i in (processor.bos_id(), processor.eos_id()))
        for batch in batches:
            at = 0
            for texts in _groups_of(batch.column(1)):
                first, at = at, at + len(texts)
                split = [MARKED.findall(" " + text.replace(MARK, " ")) if text else [] for text in texts]
                if len(table) > TABLE_SIZE:
                    table.clear()
                fresh = list({chunk for chunks in split for chunk in chunks}.difference(table))
                table.update(zip(fresh, _segment(processor, fresh)))
                lists, counts, shas, texts_out = [], [], [], []
                for chunks in split:
                    raw = begin + b"".join(map(table.__getitem__, chunks)) + end
                    counts.append(len(raw) // 4)
                    shas.append(hashlib.sha256(raw).hexdigest())
                    ids = np.frombuffer(raw, "<u4").tolist()
                    decoded = processor.decode(ids)
                    texts_out.append(decoded if keep_ids else hashlib.sha256(decoded.encode()).hexdigest())
                    if keep_ids:
                        lists.append(ids)
                columns = [batch.column(0).slice(first, at - first), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(texts_out, pa.string())]
                names = ["id", "n_tokens", "ids_sha256", "decoded" if keep_ids else "decoded_sha256"]
                if keep_ids:
                    columns.append(pa.array(lists, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", digests_only: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, ids_sha256, decoded and ids (begin and end included).

    ``digests_only`` gives decoded_sha256 in place of the decoded text and the ids.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    tail = "decoded_sha256 string" if digests_only else "decoded string, ids array<int>"
    out = texts.mapInArrow(_encoder(model, not digests_only),
                           f"id {texts.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, {tail}")
    return out.withColumnRenamed("id", id_col)


def _digester(batches):
    for batch in batches:
        texts, lists = batch.column(1), batch.column(2)
        raw = [np.asarray(lists.values[a:b], "<u4").tobytes() for a, b in zip(lists.offsets[:-1].to_pylist(), lists.offsets[1:].to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(ids) // 4 for ids in raw], pa.int64()), pa.array([hashlib.sha256(ids).hexdigest() for ids in raw], pa.string()),
             pa.array([hashlib.sha256(text.as_py().encode()).hexdigest() for text in texts], pa.string())],
            ["id", "n_tokens", "ids_sha256", "decoded_sha256"])


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per row of an encoding: id, n_tokens, ids_sha256 and decoded_sha256, from its ids and decoded text."""
    rows = encoded.select(F.col(id_col).alias("id"), "decoded", "ids")
    out = rows.mapInArrow(_digester, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
