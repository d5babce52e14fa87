import pytest

from runsift.sources import files, sinks


def test_result_csv_keeps_quotes_and_line_breaks(spark, tmp_path):
    df = spark.createDataFrame([('a "q" b\nz', 1)], "t string, n int")
    sinks.write_results({"x": df}, str(tmp_path), "csv")
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path / "x"))
    assert [tuple(r) for r in back.collect()] == [('a "q" b\nz', "1")]


def test_glob_raises_on_a_torn_line(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"n":1}\n{"n":\n')
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ"):
        files.read_glob(spark, str(tmp_path / "*.jsonl"), "n int").collect()


def test_only_invalid_json_ends_a_file(spark, tmp_path):
    (tmp_path / "torn.jsonl").write_text('{"id":1}\n{"id":2}\n{"id":\n{"id":4}\n')
    rows = files.read_jsonl_until_bad(spark, str(tmp_path / "torn.jsonl"), "id bigint").select("line_no", "id")
    assert sorted(map(tuple, rows.collect())) == [(1, 1), (2, 2)]
    (tmp_path / "typed.jsonl").write_text('{"id":1}\n{"id":"x"}\n{"id":3}\n')
    with pytest.raises(Exception, match="MALFORMED"):
        files.read_jsonl_until_bad(spark, str(tmp_path / "typed.jsonl"), "id bigint").collect()


def test_latest_file_opens_no_other(spark, tmp_path):
    import os

    (tmp_path / "a.json").write_text("not json\n")
    (tmp_path / "b [1].json").write_text('{"n": 1}\n{"n": 2}\n')
    os.utime(tmp_path / "a.json", (1, 1))
    rows = files.latest_file(spark, f"{tmp_path}/*.json", "n int").collect()
    assert [r.n for r in rows] == [1, 2] and rows[0].source_file.endswith("1%5D.json")


def _arrays(spark, folder, schema="n int, t string"):
    rows = files.read_array_glob(spark, f"{folder}/*.json", schema).collect()
    return sorted((r.source_file, r.position, r.n, r.t) for r in rows)


def test_array_files_in_any_layout(spark, tmp_path):
    import json

    objects = [{"n": 1, "t": 'a "q" }]{[, \\'}, {"n": 2, "t": "ü€𝄞\n\\\\"}, {"n": None, "t": None, "more": {"x": [{"y": "}"}]}}]
    (tmp_path / "a.json").write_text(json.dumps(objects))
    (tmp_path / "b c%.json").write_bytes(b"\xef\xbb\xbf" + json.dumps(objects, indent=2, ensure_ascii=False).encode())
    (tmp_path / "c.json").write_text(" [ ]\n")
    (tmp_path / "d.json").write_text('{"n": 7}')
    want = [(1, objects[0]["t"]), (2, objects[1]["t"]), (None, None)]
    assert _arrays(spark, tmp_path) == [(f, i, *row) for f in ("a.json", "b c%.json") for i, row in enumerate(want)] + [("d.json", 0, 7, None)]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1 << 20])
def test_elements_do_not_depend_on_the_blocks(size):
    import json

    from runsift.sources.blocks import json_elements

    objects = [{"k" * i: "\\" * i + '"' * i + "€𝄞{[", "l": [{}, [{"z": i}]]} for i in range(9)]
    data = json.dumps(objects, indent=1, ensure_ascii=False).encode()
    parts = [data[i:i + size] for i in range(0, len(data), size)]
    assert [json.loads(e) for e in json_elements(parts, "x")] == objects


@pytest.mark.parametrize("text", ["", "  ", "[", '[{"n":1}', '[{"n":1},]', '[{"n":1} {"n":2}]', "[1]", "[null]", '[{"n":1}] x', '{"n":1}{"n":2}', '[{"n":"}]', "[[]]", "[,]"])
def test_torn_or_foreign_arrays_raise(text):
    from runsift.sources.blocks import json_elements

    with pytest.raises(ValueError, match="in f|early: f"):
        list(json_elements([text.encode()], "f"))


def test_array_glob_fails_on_misfits(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.read_array_glob(spark, f"{tmp_path}/*.json", "n int")
    with pytest.raises(ValueError, match="position"):
        files.read_array_glob(spark, f"{tmp_path}/*.json", "position int")
    (tmp_path / "a.json").write_text("")
    with pytest.raises(Exception, match="ends early"):
        _arrays(spark, tmp_path)
    (tmp_path / "a.json").write_text('[{"n": 1}, {"n": "x"}]')
    with pytest.raises(Exception, match="MALFORMED"):
        _arrays(spark, tmp_path)


def test_inventory_digests_in_blocks(spark, tmp_path, monkeypatch):
    import hashlib

    from runsift.sources.blocks import blocks_of

    (tmp_path / "deep" / "er").mkdir(parents=True)
    contents = {"a b%.bin": b"x" * 9_000_000, "deep/er/ü.txt": b"", "deep/c": b"\x00\xff", "deep/d.tmp3": b"skipped"}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    del contents["deep/d.tmp3"]
    rows = files.file_inventory(spark, str(tmp_path)).collect()
    assert {r.relative_path: (r.size_bytes, r.sha256) for r in rows} == {
        n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in contents.items()}
    assert [len(b) for b in blocks_of(f"file:{tmp_path}/a b%.bin")] == [4 << 20, 4 << 20, 9_000_000 - (8 << 20)]
