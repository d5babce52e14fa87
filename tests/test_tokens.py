import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from runsift.functions import hashing as H
from runsift.functions import tokens as K


def lit(*v):
    return F.array(*map(F.lit, v)) if v else F.array().cast("array<int>")


def test_find_subsequence_and_stops(spark):
    df = spark.createDataFrame([([1, 2, 3, 2, 3],), ([2, 3],), ([],)], "a array<int>")
    a = F.col("a")
    rows = df.select(K.find_subsequence(a, lit(2, 3)), K.find_subsequence(a, lit(2, 3), 2), K.first_stop(a, lit(3, 9)), K.trim_at_stop(a, lit(3)), K.trim_at_stop(a, lit(3), True)).collect()
    assert [tuple(r) for r in rows] == [(1, 3, 2, [1, 2], [1, 2, 3]), (0, None, 1, [2], [2, 3]), (None, None, None, [], [])]


def test_channel_split(spark):
    rows = [([7, 1], [5, 8, 6, 9]), ([7], [1, 1]), ([], [3, 9, 4])]
    df = spark.createDataFrame(rows, "p array<int>, g array<int>")
    out = K.split_channels(df, F.col("p"), F.col("g"), lit(7), lit(8), lit(9), F.lit(3), F.lit(None).cast("string")).collect()
    assert [(r.parse_status, r.thought_ids, r.answer_ids, r.truncated) for r in out] == [
        ("ok", [1, 5], [6], True), ("missing_answer_boundary", [1, 1], [], False), ("missing_reasoning_open", [], [3], True)]


def cut(pieces, ratio):
    n = len(pieces)
    if n < 12:
        return None
    target = max(4, min(n - 2, round(n * ratio)))
    radius = max(8, round(n * 0.12))
    found = []
    for k in range(max(4, target - radius), min(n - 1, target + radius) + 1):
        text = "".join(pieces[:k])
        if re.search(r"(?:[.!?](?:[\"')\]]*)|\n)\s*$", text):
            q = 0
        elif text.endswith((" ", "\n", "\t")):
            q = 1
        elif text.rstrip().endswith((",", ";", ":")):
            q = 2
        else:
            q = 3
        found.append((q, abs(k - target), k))
    return min(found)


def test_token_safe_cut_matches_every_prefix(spark):
    rng = random.Random(2)
    rows = [[rng.choice(["a", "b ", ".", "!)", ", ", "\n", " ", "word", '"']) for _ in range(rng.randint(5, 90))] for _ in range(40)]
    rows.append(["x."] + [" "] * 70)
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, p array<string>")
    for ratio in (0.3, 0.5):
        out = K.token_safe_cut(df, F.col("p"), ratio).orderBy("i").collect()
        assert [None if r["cut"] is None else tuple(r["cut"]) for r in out] == [cut(p, ratio) for p in rows]


def test_first_visible_token(spark):
    pieces = ["so ", "x=", "1", "2", " or x=9"]
    df = spark.createDataFrame([(pieces,)], "p array<string>")
    r = K.first_visible_token(df, F.col("p"), {"Q": F.lit("x=12"), "QSTAR": F.lit("x=9")}).first()["visible"]
    assert tuple(r) == (4, "Q")


def test_hashes_and_seed(spark):
    ids = [0, 1, 255, 70000, -1]
    df = spark.createDataFrame([(ids, "id1")], "a array<int>, s string")
    r = df.select(H.sha256_decimal_list(F.col("a")), H.sha256_int32_list(F.col("a")), H.stable_seed(F.lit("rev"), F.col("s"), F.lit(3))).first()
    assert r[0] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert r[1] == hashlib.sha256(b"".join(i.to_bytes(4, "little", signed=True) for i in ids)).hexdigest()
    seed = int.from_bytes(hashlib.sha256(b"rev|id1|3").digest()[:8], "big") % (2**31 - 1)
    assert r[2] == seed


def test_source_mask_protects_structure(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5, 6],)], "a array<int>")
    for cond, want in {"none": [1] * 6, "question": [1, 0, 1, 1, 1, 1], "trace": [1, 1, 1, 0, 0, 1], "joint": [1, 0, 1, 0, 0, 1]}.items():
        m = K.source_mask(F.col("a"), (F.lit(1), F.lit(3)), (F.lit(3), F.lit(5)), lit(3), F.lit(cond))
        assert df.select(m).first()[0] == want
