import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa

from runsift.llm import ngramjoin


def brute(texts, words, percent):
    """[(id, size, smallest id reachable)] of a list of (id, text), by comparing all pairs."""
    sets = []
    for _, t in texts:
        w = (t or "").encode().lower().split()
        sets.append(({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)}) if w else set())
    near = defaultdict(list)
    for x in range(len(texts)):
        for y in range(x):
            if sets[x] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                near[x].append(y)
                near[y].append(x)
    out, seen = [None] * len(texts), set()
    for x in range(len(texts)):
        if x in seen:
            continue
        group, todo = {x}, [x]
        while todo:
            todo = [z for y in todo for z in near[y] if z not in group and not group.add(z)]
        seen |= group
        for y in group:
            out[y] = (texts[y][0], len(sets[y]), min(texts[z][0] for z in group))
    return sorted(out)


def joined(spark, texts, **kw):
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    return sorted(tuple(r) for r in ngramjoin.join_components(docs, **kw).collect())


def families(rng, count, longest):
    texts = []
    for _ in range(count):
        words = [f"w{rng.randrange(40)}" for _ in range(rng.choice([1, 2, 9, longest]))]
        for _ in range(rng.choice([1, 2, 25])):
            edited = list(words)
            for _ in range(rng.randrange(4)):
                edited[rng.randrange(len(edited))] = f"n{rng.randrange(1000)}"
            texts.append((rng.randrange(10**6), " ".join(edited)))
    return texts


def test_join_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(ngramjoin, "BLOCK_ROWS", 4)
    monkeypatch.setattr(ngramjoin, "WIDE_FROM", 30)
    texts = families(rng, 20, 70)
    for words, percent in ((3, 90), (2, 60), (1, 75)):
        want = brute(texts, words, percent)
        assert joined(spark, texts, words=words, percent=percent) == want
        assert 5 < len({c for _, _, c in want}) < len(texts) - 20


def test_one_family_around_the_limit(spark):
    rng = random.Random(9)
    words, texts = [f"w{i}" for i in range(120)], []
    for doc in range(150):
        edited = list(words)
        for _ in range(rng.randrange(1, 5)):
            edited[rng.randrange(len(edited))] = f"n{rng.randrange(100000)}"
        texts.append((doc, " ".join(edited)))
    want = brute(texts, 3, 90)
    assert joined(spark, texts) == want and 1 < len({c for _, _, c in want}) < 150


def test_filters_never_rule_out_a_link():
    rng = np.random.default_rng(3)
    for n in (1, 40, 3000):
        one = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        other = np.unique(np.concatenate([one[: len(one) // 2], rng.integers(0, 1 << 63, 30).astype(np.uint64)]))
        for size in (ngramjoin.PARITIES, ngramjoin.WIDE_PARITIES):
            bits = sum(int(x).bit_count() for x in (ngramjoin._parities(one, size) ^ ngramjoin._parities(other, size)).view(np.uint64))
            assert bits <= len(set(one.tolist()) ^ set(other.tolist()))


def test_counters_cover_all_documents():
    texts = ["a b c d", None, "a b c", "", "x y"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5), pa.int64()), pa.array(texts)], ["id", "text"])
    out = list(ngramjoin._summaries(3)(iter([batch, batch])))
    blocks = pa.Table.from_batches(out[-1:]).select(["block", "counts"]).to_batches()
    added = pa.Table.from_batches(ngramjoin._added(iter(blocks * 2)))
    total = sum(np.frombuffer(c, np.uint32).sum() for c in added["counts"].to_pylist())
    assert total == 2 * 2 * 4 and max(np.frombuffer(c, np.uint32).max() for c in added["counts"].to_pylist()) == 8
    assert len(zlib.decompress(out[-1]["counts"][0].as_py())) == 8 * ngramjoin.SLOT_BLOCK


def test_prefixes_start_with_the_rarest():
    counts = np.arange(ngramjoin.SLOTS, dtype=np.uint32)
    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([" ".join(f"w{i}" for i in range(102))])], ["id", "text"])
    row = next(ngramjoin._prefixes(3, 90, counts)(iter([batch]))).to_pylist()[0]
    places = counts[ngramjoin._slots(np.array(row["keys"], np.int64).view(np.uint64))]
    assert row["n"] == 100 and len(places) == 11 and (np.diff(places.astype(int)) >= 0).all()


def test_join_cases(spark, odd_docs, no_docs):
    rows = ngramjoin.join_components(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    got = defaultdict(set)
    for r in rows:
        got[r.doc_id].add((r.n_shingles, r.component_id))
    assert got[2] == {(16, 1)} and got[3] == {(17, 1)} and got[8] == {(701, 7)} and got[4] == {(0, 4)} and got[6] == {(0, 6)}
    assert got[9] == {(1, 9)} and got[None] == {(16, None)}
    assert ngramjoin.join_components(no_docs).count() == 0
    two = [(1, "a b c d"), (1, "p q r s t"), (1, "p q r s t"), (0, "P Q R S T"), (5, "a b")]
    assert sorted(map(tuple, joined(spark, two))) == [(0, 3, 0), (1, 2, 1), (1, 3, 0), (1, 3, 0), (5, 1, 5)]
    odd = spark.createDataFrame([(1, "a b c", 2, 3)], "`i.d` long, `te.xt` string, n int, node int")
    assert ngramjoin.join_components(odd, "i.d", "te.xt").collect()[0].component_id == 1


def test_near_copies_meet_once(spark):
    posts = [(node, node, 100, [(pos, 1000 + pos, 3) for pos in range(11)]) for node in (1, 2, 3)]
    nodes = spark.createDataFrame(posts, "node long, comp long, n int, posts array<struct<pos:int,key:long,held:long>>")
    nodes = nodes.selectExpr("*", *[f"0L AS {p}" for p in ngramjoin.PARITY])
    met = ngramjoin._meetings(ngramjoin._posts(nodes), 90)
    assert sorted((r.node, r.o_node) for r in met.collect()) == [(2, 1), (3, 1), (3, 2)]


def test_pairs_with_broken_runs_meet(spark):
    rng = random.Random(9)
    lists = {node: sorted(rng.sample(range(12), 5)) for node in range(1, 9)}
    held = {key: sum(key in keys for keys in lists.values()) for key in range(12)}
    posts = [(node, node, 100, [(pos, key, held[key]) for pos, key in enumerate(keys)]) for node, keys in lists.items()]
    nodes = spark.createDataFrame(posts, "node long, comp long, n int, posts array<struct<pos:int,key:long,held:long>>")
    nodes = nodes.selectExpr("*", *[f"0L AS {p}" for p in ngramjoin.PARITY])
    met = {(r.a, r.b) for r in ngramjoin._crossing(ngramjoin._posts(nodes), 90).collect()}
    assert met == {(x, y) for x in lists for y in lists if x > y and set(lists[x]) & set(lists[y])}
