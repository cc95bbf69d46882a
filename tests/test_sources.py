from __future__ import annotations

import random
from pathlib import Path

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from tablewright.functions import staging
from tablewright.sources import catalog, files, records as sources_records, store


def put(tmp_path: Path, name: str, text: str) -> str:
    target = tmp_path / name
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text, encoding="utf-8")
    return "file:" + str(target)


def test_scan_types_and_null_tokens(spark, tmp_path):
    text = "id,price,ok,name,code,empty\n1,2.5,true,NA,007,\n2,NULL,False,x,1d,\n3,1e3,,N/A,,\n"
    df = files.scan_csv(spark, put(tmp_path, "a.csv", text))
    assert dict(df.dtypes) == {
        "id": "bigint", "price": "double", "ok": "boolean", "name": "string", "code": "string", "empty": "string",
    }
    assert rows_of(df, "id", "price", "ok", "name") == [
        (1, 2.5, True, None),
        (2, None, False, "x"),
        (3, 1000.0, None, None),
    ]


def test_scan_keeps_quoted_and_multiline_fields(spark, tmp_path):
    text = 'id;note\n1;"a;b"\n2;"say ""hi"""\n3;"two\nlines"\n4; spaced \n'
    df = files.scan_csv(spark, put(tmp_path, "a.csv", text), ";")
    assert rows_of(df) == [(1, "a;b"), (2, 'say "hi"'), (3, "two\nlines"), (4, " spaced ")]


def test_scan_with_schema_is_lazy_and_tolerant(spark, tmp_path):
    path = put(tmp_path, "a.csv", "id,price\n1,2.5\nx,oops\n")
    df = files.scan_csv(spark, path, schema="id int, price double", multiline=False)
    assert rows_of(df) == [(1, 2.5), (None, None)]
    assert df.dtypes == [("id", "int"), ("price", "double")]


def test_infer_delimiter(spark, tmp_path):
    cases = {
        "comma.csv": ("a,b\n1,2\n", ","),
        "with space & 100%.csv": ("a;b\n1;2\n", ";"),
        "semi.csv": ('a;b\n"1,5";2\n"2,5,7";3\n', ";"),
        "tab.csv": ("a\tb c\n1\t2\n", "\t"),
        "pipe.csv": ("a|b\n1|2", "|"),
        "one.csv": ("a\n1\n", ","),
        "blank.csv": ("  \n\n", ","),
        "tie.csv": ("a,b;c\n1,2;3\n", ","),
        "long.csv": ("a|b\n" + "x,y|z\n1|2\n" * 3000 + "5|6,", "|"),
    }
    for name, (text, _) in cases.items():
        put(tmp_path, f"in/{name}", text)
    got = files.infer_delimiter(spark, "file:" + str(tmp_path / "in"))
    got = {r["file"].rsplit("/", 1)[-1]: r["delimiter"] for r in got.collect()}
    assert got == {name: d for name, (_, d) in cases.items()}


def test_conform_schema(spark, tmp_path):
    put(tmp_path, "in/a.csv", '"id","Sale Date"\r\n1,2\r\n')
    put(tmp_path, "in/b.csv", "id,extra\n1,2\n")
    wide = ",".join(["id", "Sale Date", *[f"column_{i}" for i in range(1000)]])
    put(tmp_path, "in/wide.csv", wide + "\n")
    got = files.conform_schema(spark, "file:" + str(tmp_path / "in"), ["id", "Sale Date"])
    got = got.withColumn("file", F.regexp_extract("file", "([^/]+)$", 1))
    assert rows_of(got.where("file <> 'wide.csv'")) == [("b.csv", "Sale Date", "missing"), ("b.csv", "extra", "extra")]
    assert got.where("file = 'wide.csv' AND status = 'extra'").count() == 1000


@pytest.mark.parametrize("format", ["csv", "parquet", "json"])
def test_sink_round_trip(spark, folder, people, format):
    path = files.sink_clean_table(people, f"{folder}/out", format)
    files.sink_clean_table(people, path, format)  # a second run replaces the first
    back = files.scan_csv(spark, path) if format == "csv" else spark.read.format(format).load(path)
    assert rows_of(back.select(*people.columns)) == rows_of(people)


def test_catalog(spark, tmp_path, folder):
    put(tmp_path, "in/Sales.CSV", "a;b\n1;2\n")
    put(tmp_path, "in/book.xlsx", "not read")
    put(tmp_path, "in/notes.txt", "left out")
    where = "file:" + str(tmp_path / "in")
    entries = catalog.describe_files(spark, where, files.infer_delimiter(spark, where))
    catalog.register(entries, f"{folder}/catalog")
    known = catalog.load_catalog(spark, f"{folder}/catalog")
    got = rows_of(known, "original_filename", "raw_filename", "file_type", "delimiter", "file_size_bytes")
    assert got == [("Sales.CSV", "raw.csv", "csv", ";", 8), ("book.xlsx", "raw.xlsx", "excel", None, 8)]
    health = catalog.catalog_health(known).first()
    assert (health["status"], health["datasets"]) == ("up", 2) and health["latest_dataset"] is not None
    assert catalog.generate_dataset_id().startswith("dataset_")


def test_store_replaces_only_its_dataset(spark, folder):
    schema = "dataset_id string, issue_id string, accepted boolean, reason string, updated_at timestamp"
    assert store.load(spark, folder, "decisions").count() == 0
    store.save(spark.createDataFrame([("a", "1", True, None, None), ("b", "1", False, "r", None)], schema), folder, "decisions")
    store.save(spark.createDataFrame([("a", "2", True, None, None)], schema), folder, "decisions")
    assert rows_of(store.load(spark, folder, "decisions"), "dataset_id", "issue_id") == [("a", "2"), ("b", "1")]
    assert store.load(spark, folder, "decisions", "b").count() == 1


def test_staged_tables_use_the_configured_folder(spark):
    folder = staging.shared_folder(spark)
    assert staging.new_folder(spark, "x").startswith(folder)
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert configured is None or folder == configured.rstrip("/")


def decided(spark, *rows):
    schema = "dataset_id string, issue_id string, accepted boolean, reason string, updated_at timestamp"
    return spark.createDataFrame([(*r, True, None, None) for r in rows], schema)


def test_a_write_that_fails_midway_leaves_the_old_rows(spark, folder, monkeypatch):
    store.save(decided(spark, ("a", "1"), ("b", "1")), folder, "decisions")
    store.append(decided(spark, ("a", "2")), folder, "decisions")
    old = [("a", "1"), ("a", "2"), ("b", "1")]
    # a task fails while rows are written
    broken = decided(spark, *[("a", str(i)) for i in range(50)]).repartition(5).withColumn(
        "issue_id", F.when(F.col("issue_id") == "49", F.raise_error(F.lit("lost"))).otherwise(F.col("issue_id"))
    )
    for write in (store.save, store.append, lambda *a: store.save_one(*a, "a")):
        with pytest.raises(Exception, match="lost"):
            write(broken, folder, "decisions")
        assert rows_of(store.load(spark, folder, "decisions"), "dataset_id", "issue_id") == old
    # the driver dies between the rows and the commit
    with monkeypatch.context() as patch:
        patch.setattr(store, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("gone")))
        with pytest.raises(RuntimeError, match="gone"):
            store.save_one(decided(spark, ("a", "9")), folder, "decisions", "a")
    assert rows_of(store.load(spark, folder, "decisions"), "dataset_id", "issue_id") == old
    store.save_one(decided(spark, ("a", "9")), folder, "decisions", "a")
    assert rows_of(store.load(spark, folder, "decisions"), "dataset_id", "issue_id") == [("a", "9"), ("b", "1")]


def test_versions_replace_add_and_go(spark, folder):
    store.save(decided(spark, ("a", "1"), ("b", "1")), folder, "decisions")
    read_before = store.load(spark, folder, "decisions", "a")
    store.save(store.load(spark, folder, "decisions").withColumn("issue_id", F.concat("issue_id", F.lit("x"))), folder, "decisions")
    assert rows_of(read_before, "issue_id") == [("1",)]  # what was read stays readable
    store.append(decided(spark, ("a", "2")), folder, "decisions")
    store.save_one(decided(spark, ("c", "none")), folder, "decisions", "b")  # nothing left of b
    assert rows_of(store.load(spark, folder, "decisions"), "dataset_id", "issue_id") == [("a", "1x"), ("a", "2")]
    assert store.load(spark, folder, "decisions", "b").count() == 0
    assert store.vacuum(spark, folder, "decisions") == 1
    assert rows_of(store.load(spark, folder, "decisions"), "dataset_id", "issue_id") == [("a", "1x"), ("a", "2")]
    assert store.vacuum(spark, folder, "issues") == 0
    with pytest.raises(ValueError, match="unsuitable"):
        store.save_one(decided(spark), folder, "decisions", "../x")


def test_empty_files_are_listed(spark, tmp_path, folder):
    put(tmp_path, "in/a.csv", "id;Sale Date\n1;2\n")
    put(tmp_path, "in/deep/nothing here.csv", "")
    where = "file:" + str(tmp_path / "in")
    listed = files.list_files(spark, where).withColumn("path", F.regexp_extract("path", "([^/]+)$", 1))
    assert rows_of(listed, "path", "length") == [("a.csv", 17), ("nothing here.csv", 0)]
    assert listed.where("modified IS NULL").count() == 0
    found = files.infer_delimiter(spark, where).withColumn("file", F.regexp_extract("file", "([^/]+)$", 1))
    assert rows_of(found) == [("a.csv", ";"), ("nothing here.csv", ",")]
    lacks = files.conform_schema(spark, where, ["id", "Sale Date"], ";").withColumn("file", F.regexp_extract("file", "([^/]+)$", 1))
    assert rows_of(lacks) == [("nothing here.csv", "Sale Date", "missing"), ("nothing here.csv", "id", "missing")]
    catalog.register(catalog.describe_files(spark, where, files.infer_delimiter(spark, where)), f"{folder}/catalog")
    known = catalog.load_catalog(spark, f"{folder}/catalog")
    assert rows_of(known, "original_filename", "file_size_bytes", "delimiter") == [("a.csv", 17, ";"), ("nothing here.csv", 0, ",")]
    assert catalog.catalog_health(known).first()["datasets"] == 2
    assert files.scan_csv(spark, where + "/deep").columns == []


def records(seed: int, lines: int) -> tuple[str, list]:
    """A file with quoted line ends, doubled quotes, stray quotes within fields and blank lines, and its rows."""
    rng = random.Random(seed)
    text, rows = ["id,note,last"], []
    for i in range(lines):
        note = rng.choice(["plain", "", 'say "hi"', "two\nlines", "a\n\nb\n", 'x,"y"\n,"', "é" * 20, "\r\nwin", '"'])
        if rng.random() < 0.3:
            text.append(f'{i},5" pipe {i},x"y')
            rows.append((i, f'5" pipe {i}', 'x"y'))
            continue
        quoted = '"' + note.replace('"', '""') + '"' if rng.random() < 0.7 or set(note) & set('",\n\r') else note
        text.append(f"{i},{quoted},{i % 7}")
        rows.append((i, note or None, str(i % 7)))
        if rng.random() < 0.05:
            text.append("  " if rng.random() < 0.5 else "")
    return "\n".join(text) + ("\n" if rng.random() < 0.5 else ""), rows


@pytest.mark.parametrize("split", ["64", "1000", "128m"])
def test_quoted_line_ends_are_read_by_several_tasks(spark, tmp_path, split):
    texts = {f"{k}.csv": records(k, 300) for k in range(3)}
    for name, (text, _) in texts.items():
        put(tmp_path, f"in/{name}", text)
    want = sorted((r for _, rows in texts.values() for r in rows), key=str)
    conf = {"spark.sql.files.maxPartitionBytes": split, "spark.sql.files.openCostInBytes": "1"}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        df = files.scan_csv(spark, "file:" + str(tmp_path / "in"), schema="id bigint, note string, last string", null_tokens=("",))
        tasks = df.rdd.getNumPartitions()
        assert sorted(map(tuple, df.collect()), key=str) == want
        assert files.scan_csv(spark, "file:" + str(tmp_path / "in")).count() == len(want)
    finally:
        for key in conf:
            spark.conf.unset(key)
    assert tasks > 15 or split == "128m"  # three files


def test_one_field_over_many_splits(spark, tmp_path, monkeypatch):
    long = "\n".join(f"line {i} of one field" for i in range(400))
    path = put(tmp_path, "a.csv", f'id,note\n1,"{long}"\n2,end\n3,"never closed\n4,still inside')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = []
        for few in (10**6, 0):  # how splits begin: broadcast, or joined and sorted
            monkeypatch.setattr(sources_records, "FEW_SPLITS", few)
            got.append(rows_of(files.scan_csv(spark, path, schema="id bigint, note string")))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got[0] == got[1] and got[0][:2] == [(1, long), (2, "end")] and got[0][2][0] == 3 and len(got[0]) == 3


def test_scratch_removes_what_was_staged_inside(spark):
    with staging.scratch(spark) as made:
        staging.stage(spark.range(3), "inner")
        kept = staging.stage(spark.range(5), "kept")
        inner, outer = made[0], made.pop()
    assert kept.count() == 5
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(inner)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    assert not fs.exists(hadoop) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(outer))
    staging.remove(spark, outer)
