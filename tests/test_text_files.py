from maskweave.sources import files


def test_one_file_a_key_in_few_folders(spark, tmp_path):
    rows = [(i, f"text {i} é\nmore") for i in range(300)] + [(7, "again"), (8, None), (301, ""), (None, "no key"), (None, "twice")]
    folder = f"file:{tmp_path}/texts"
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    before = spark.conf.get(files._LIST_TASKS)
    files.write_texts(df, "doc_id", "text", folder)
    want = {}
    for k, t in rows:
        want.setdefault(files._NO_KEY if k is None else str(k), []).append(t or "")
    got = {r["name"][len("doc_id="):-len(".txt")]: r for r in files.read_texts(spark, folder, "*.txt").collect()}
    assert {k: sorted(r["content"][:-1].split("\n")) for k, r in got.items()} == {k: sorted("\n".join(v).split("\n")) for k, v in want.items()}
    assert all(r["content"].endswith("\n") and r["extension"] == ".txt" and r["bytes"] == len(r["content"].encode()) for r in got.values())
    # a folder a task, not one a key, and nothing beside the texts
    assert len(list((tmp_path / "texts").iterdir())) <= 4 * spark.sparkContext.defaultParallelism
    assert sum(1 for f in (tmp_path / "texts").rglob("*") if f.is_file()) == len(want)
    assert spark.conf.get(files._LIST_TASKS) == before


def test_other_file_systems_take_sparks_writer(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    files.write_texts(df, "doc_id", "text", str(tmp_path / "texts"))
    got = sorted((r["path"].split("doc_id=")[1][0], r["content"]) for r in files.read_texts(spark, str(tmp_path / "texts"), "*.txt").collect())
    assert got == [("1", "a\n"), ("2", "b\n")]


def test_local_files_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """As Spark's reader gives them, but without an entry for each file in the plan."""
    top = tmp_path / "a b%20c"
    made = {"x.txt": b"x", "empty.txt": b"", "no.TXT": b"n", "é.txt": "é\n".encode(), "bad.txt": b"\xff\xfe", ".hidden.txt": b"h", "_gone.txt": b"g",
            "_k=1.txt": b"k", "_metadata.txt": b"m", "half._COPYING_": b"c", "d/y.txt": b"y" * 500, "d/deep/k=1/z.txt": b"z", "_out/w.txt": b"w", "e/one.md": b"1", "e/.git/v.txt": b"v"}
    for name, content in made.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(content)
    (top / "linked").symlink_to(top / "d")
    (top / "lost.txt").symlink_to(top / "nothing")
    (top / "none").mkdir()
    monkeypatch.setattr(files, "_STEP_BYTES", 300)
    for glob in (None, "*.txt", "{x,y,[é-ü]}.t?t", "nothing*"):
        got = files.read_texts(spark, f"file:{top}", glob)
        assert not [f for f in got.inputFiles() if f.startswith(f"file://{tmp_path}")]
        want = files._spark_files(spark, f"file:{top}", glob).select("path", "content", "length")
        rows = sorted((r["path"], None if r["reason"] else r["content"].encode(), r["bytes"]) for r in got.collect())
        assert rows == sorted((r["path"], bytes(r["content"]) if b"\xff" not in r["content"] else None, r["length"]) for r in want.collect())
    assert files.read_texts(spark, f"file:{top}").count() == 10
    assert [r["content"] for r in files.read_texts(spark, f"file:{top}/x.txt").collect()] == ["x"]
