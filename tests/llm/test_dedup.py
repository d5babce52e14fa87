from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from runsift.llm import bloom, exact, neardup, shared
from runsift.llm.components import components


def test_exact_cases(spark, odd_docs, no_docs):
    rows = exact.label_copies(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert {r.keep_id for r in by[1]} == {2} and {r.group_size for r in by[1]} == {4} and not by[1][0].kept
    assert all(r.kept for r in by[2]) and not by[None][0].kept
    assert by[4][0].keep_id == 5 and by[5][0].kept  # null is the empty text
    assert by[7][0].group_size == 1 and by[7][0].kept
    kept = exact.drop_copies(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 5, 6, 7, 8, 9, 10, 11]
    assert exact.label_copies(no_docs).count() == 0 and exact.drop_copies(no_docs).count() == 0


def test_exact_is_right_with_a_full_filter(spark):
    docs = spark.range(60000).selectExpr("id as doc_id", "cast(id % 50000 as string) as text")
    rows = exact.label_copies(docs, max_bits=bloom.BLOCK)
    assert rows.where("kept").count() == 50000 and rows.where("group_size = 2").count() == 20000


def brute(texts, words, percent=80):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = ({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)}) if w else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_against_brute_force(spark):
    import random

    rng = random.Random(4)
    texts = {}
    for family in range(12):
        words = [f"w{rng.randrange(60)}" for _ in range(rng.choice([3, 12, 60, 90]))]
        for copy in range(rng.choice([1, 3, 9])):
            edited = list(words)
            for _ in range(rng.randrange(4)):
                edited[rng.randrange(len(edited))] = f"n{rng.randrange(1000)}"
            texts[len(texts)] = " ".join(edited)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for words in (2, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_groups(docs, words=words).collect()}
        assert got == brute(texts, words)


def test_near_family_around_the_limit(spark):
    import random

    rng = random.Random(9)
    words = [f"w{i}" for i in range(90)]
    texts = {}
    for doc in range(120):
        edited = list(words)
        for _ in range(rng.randrange(2, 12)):
            edited[rng.randrange(len(edited))] = f"n{rng.randrange(100000)}"
        texts[doc] = " ".join(edited)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_groups(docs, words=2).collect()}
    want = brute(texts, 2)
    assert got == want and 1 < len({c for _, c in want.values()}) < 120


def test_few_pairs_at_the_limit_are_missed():
    import numpy as np

    signer, rng = neardup._Signer(neardup.WIDTH, neardup.COORDS), np.random.default_rng(1)
    member = np.zeros((neardup.MINIMA, neardup.COORDS), np.float32)
    for coordinate, picks in enumerate(signer.picks):
        member[picks, coordinate] = 1
    missed = 0
    for _ in range(10):
        differ = (rng.random((20000, neardup.MINIMA), dtype=np.float32) >= 0.8).astype(np.float32)
        missed += int(((differ @ member < 0.5).sum(axis=1) < neardup.AGREE).sum())
    assert missed <= 2  # of 200,000; 66 with 80 coordinates over 128 minima


def test_similarities_that_would_lose_links_are_refused(odd_docs):
    with pytest.raises(ValueError, match="percent"):
        neardup.near_groups(odd_docs, words=2, percent=79)
    assert neardup.near_groups(odd_docs, words=2, percent=95).count() == odd_docs.count()


def test_parities_never_exceed_the_difference():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (1, 40, 3000):
        one = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        other = np.unique(np.concatenate([one[: len(one) // 2], rng.integers(0, 1 << 63, 30).astype(np.uint64)]))
        bits = sum(int(x).bit_count() for x in (neardup._parities(one) ^ neardup._parities(other)).view(np.uint64))
        assert bits <= len(set(one.tolist()) ^ set(other.tolist()))


def test_near_cases(odd_docs, no_docs):
    rows = neardup.near_groups(odd_docs, words=2).collect()
    assert len(rows) == odd_docs.count()
    got = {r.doc_id: r for r in rows}
    assert got[3].component_id == 1 and got[2].component_id == 1 and got[8].component_id == 7
    assert got[4].n_shingles == 0 and got[4].component_id == 4 and got[6].kept and got[9].n_shingles == 1
    assert got[None].component_id is None and got[None].kept
    kept = neardup.keep_one_each(odd_docs, words=2)
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()} == {None, 1, 4, 5, 6, 7, 9, 10, 11}
    assert neardup.near_groups(no_docs).count() == 0 and neardup.keep_one_each(no_docs).count() == 0


def test_components_of_a_path(spark):
    edges = spark.range(40).selectExpr("id as a", "id + 1 as b")
    assert {(r.node, r.component) for r in components(edges).collect()} == {(i, 0) for i in range(41)}


def test_only_what_is_asked_for_moves(spark, monkeypatch):
    passed, real = {}, bloom.maybe_in

    def spy(rows, wanted, key, name):
        out = real(rows, wanted, key, name)
        passed[name] = (rows.count(), out.count())
        return out

    monkeypatch.setattr(bloom, "maybe_in", spy)
    alone = [(i, [1000 * i + k for k in range(11)]) for i in range(3, 200)]
    reps = spark.createDataFrame([(i, [1000 * i + k for k in range(9)] + [7, 8]) for i in (1, 2)] + alone, "id long, sig array<long>")
    lists = neardup._lists(reps, 11, 2).collect()
    assert sorted((r.id, r["keys"]) for r in lists) == [(1, [7]), (2, [7])]
    assert passed["pair-bits"][0] == 199 * 11 and passed["pair-bits"][1] < 40

    sets = spark.createDataFrame([(i, list(range(256)), list(range(i, i + 100))) for i in range(300)], "id long, minima array<int>, items array<long>")
    pairs = spark.createDataFrame([(5, 4), (90, 4)], "a long, b long")
    found = neardup._verified(pairs, sets, 80)
    assert sorted(map(tuple, found.collect())) == [(5, 4, True), (90, 4, False)]
    assert passed["minima-bits"][1] < 20 and passed["items-bits"][1] < 20


def test_batches_are_bounded_while_rows_are_written(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["size"])

    texts = spark.range(0, 12, 1, 1).selectExpr("repeat('x', 1 << 20) AS text")
    largest = shared.materialize(texts.mapInArrow(sizes, "size long"), "sizes").agg({"size": "max"}).first()[0]
    assert largest <= shared.BATCH_BYTES + (2 << 20) and spark.conf.get(name) == before


def test_unlike_proposals_are_ruled_out_before_they_are_compared(spark, monkeypatch):
    """Texts around one base, similar by 0.67 to each other: they share lists and sketches, but parities rule them out."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(80):
        words = [f"w{k}" for k in range(200)]
        for at in rng.choice(200, 20, replace=False):
            words[at] = f"own{i}x{at}"
        rows.append((i, " ".join(words)))
    rows.append((80, rows[5][1] + " more"))
    compared, real = [], neardup._verified

    def spy(pairs, sets, percent):
        pairs = pairs.cache()
        compared.append(pairs.count())
        return real(pairs, sets, percent)

    monkeypatch.setattr(neardup, "_verified", spy)
    out = neardup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), words=1).collect()
    assert {r.doc_id: r.component_id for r in out} == {i: 5 if i == 80 else i for i in range(81)}
    assert 1 <= sum(compared) <= 10
