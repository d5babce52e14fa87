import hashlib
import random
import zlib

import numpy as np

from runsift.llm import runs
from runsift.llm.queries import QUERIES


def brute(words):
    """{(start, end): smallest period} by comparing the list with itself for every shift."""
    out = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, q, b - a) for (a, b), q in out.items())


def collapse(words, found):
    gone = {i for start, q, size in found for i in range(start + q, start + size)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_against_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        texts = []
        for _ in range(rng.randrange(1, 6)):
            kinds, words = rng.choice([1, 2, 3, 5, 30]), []
            for _ in range(rng.randrange(0, 12)):
                unit = [rng.randrange(kinds) for _ in range(rng.randrange(1, 14))]
                words += (unit * rng.randrange(1, 9))[: rng.randrange(1, 100)] if rng.random() < 0.5 else unit
            texts += [words] * rng.choice([1, 1, 2])
        bounds = np.cumsum([0, *map(len, texts)])
        start, end, period = runs.word_runs(np.array(sum(texts, []), np.int64), bounds)
        want = [(a + at, q, size) for text, at in zip(texts, bounds.tolist()) for a, q, size in brute(text)]
        assert list(zip(start.tolist(), period.tolist(), (end - start).tolist())) == want


def test_shifts_agree_where_hashes_fail(monkeypatch):
    words = np.array([0, 1] * 10 + list(range(30)) + [5] * 9 + [0, 1, 2] * 4)
    bounds = np.array([0, 25, 25, len(words)])
    want = [part.tolist() for part in runs.word_runs(words, bounds)]
    monkeypatch.setattr(runs.Stretches, "_same", lambda self, a, b, size: np.ones(len(a), bool))
    assert [part.tolist() for part in runs.word_runs(words, bounds)] == want and len(want[0]) == 3


def test_grammar_spells_the_texts():
    rng = np.random.default_rng(2)
    words = np.tile(rng.integers(0, 4, 50), 6)
    grammar = runs.Grammar(words, np.repeat([0, 1], 150))
    assert len(grammar.symbols) < 40 and len(grammar.left) > 10

    def spell(s):
        return [s] if s < grammar.terminals else spell(grammar.left[s - grammar.terminals]) + spell(grammar.right[s - grammar.terminals])

    assert sum(map(spell, grammar.symbols.tolist()), []) == words.tolist()


def test_run_cases(odd_docs, no_docs, spark):
    rows = {r.doc_id: r for r in runs.find_runs(odd_docs).collect()}
    assert runs.find_runs(odd_docs).count() == odd_docs.count() and None in rows
    assert rows[4].n_words == 0 and rows[4].runs == [] and rows[4].collapsed == "" and rows[6].collapsed == ""
    assert [(r.start, r.length, r.period) for r in rows[7].runs] == [(0, 9000, 700)] and len(rows[7].collapsed.split()) == 700
    assert rows[8].runs == rows[7].runs and rows[8].collapsed.endswith(" x")
    assert runs.find_runs(no_docs).count() == 0
    odd = spark.createDataFrame([(1, "a a a a a a b", 2)], "id long, `te.xt` string, runs int")
    row = runs.find_runs(odd, "id", "te.xt").first()
    assert (row.id, row.collapsed, len(row.runs)) == (1, "a b", 1)


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(5)
    texts = {i: " ".join(rng.choice(["x", "x", "x", "y\t", "é"]) for _ in range(rng.choice([0, 3, 40, 300]))) for i in range(120)}
    texts[7] = None
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()}
    bent = 0
    for i, text in texts.items():
        words = (text or "").split()
        h, n = zlib.crc32(str(i).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
            bent += 1
        found = brute(words)
        top = min(found, key=lambda r: (-r[2], r[0], r[1]), default=None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        best = (top[0], top[2], top[1], top[2] * 1000 // top[1]) if top else (None,) * 4
        assert got[i] == (len(found), *best, sha("".join(f"{a},{size},{q}\n" for a, q, size in found)), sha(collapse(words, found)))
    assert bent > 5 and sum(r[0] > 1 for r in got.values()) > 10
