from palimpsest.sources import files


def test_jsonl_round_trip(spark, tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text('{"a": 1, "b": "x"}\n\n[1, 2]\n{"a": 2, "b": null}\n')
    rows = files.read_jsonl(spark, str(path))
    assert sorted((r.a, r.b) for r in rows.collect()) == [(1, "x"), (2, None)]
    files.write_jsonl(rows.select("a", "b"), str(tmp_path / "out"))
    again = files.read_jsonl(spark, str(tmp_path / "out"), "a long, b string")
    assert sorted(r.a for r in again.collect()) == [1, 2]


def test_directory_and_digests(spark, tmp_path):
    (tmp_path / "d" / "sub").mkdir(parents=True)
    (tmp_path / "d" / "a.py").write_text("def x(): pass\n")
    (tmp_path / "d" / "sub" / "b.md").write_text("# b\n")
    (tmp_path / "d" / "c.bin").write_text("no")
    rows = files.read_directory(spark, str(tmp_path / "d")).collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in rows) == ["a.py", "b.md"]
    import hashlib

    own = files.file_digests(spark, str(tmp_path / "d" / "a.py")).first()
    assert own.sha256 == hashlib.sha256(b"def x(): pass\n").hexdigest()


def test_snapshots_gain_columns(spark, tmp_path):
    files.write_snapshot(spark.createDataFrame([(1, "x")], "id long, status string"), str(tmp_path / "s"), "status")
    row = files.read_snapshot(spark, str(tmp_path / "s"), {"origin": ""}).first()
    assert (row.id, row.status, row.origin) == (1, "x", "")


def test_entry_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
