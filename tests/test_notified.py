from pyspark.sql import functions as F

from newsmill.streaming import notified as N


def stored(spark, root, ids, text="object "):
    rows = [("b", f"dir {i % 3}/{i}.eml", f"{text}{i}".encode()) for i in ids]
    return N.store_objects(spark.createDataFrame(rows, "bucket string, key string, content binary"), root)


def test_each_new_object_once(spark, tmp_path):
    root, log, out = (str(tmp_path / n) for n in ("root", "log", "out"))
    N.announce(stored(spark, root, range(40)), log)
    assert N.ingest_notified(spark, log, root, out).count() == 40
    N.announce(stored(spark, root, range(30, 60), "changed "), log)  # ten of them again
    gone = spark.createDataFrame([("b", "never/there"), ("b", "never/there"), (None, None)], "bucket string, key string")
    N.announce(gone, log)
    rows = N.ingest_notified(spark, log, root, out).collect()
    by = {r.key: r for r in rows}
    assert len(rows) == 62 and by["never/there"].reject_reason == "missing" and by["dir 2/35.eml"].text == "object 35"
    assert by["dir 2/50.eml"].text == "changed 50" and by["dir 2/50.eml"].length == 10


def test_a_restart_reads_only_new_batches(spark, tmp_path):
    root, log = str(tmp_path / "root"), str(tmp_path / "log")
    for part in range(3):
        N.announce(stored(spark, root, range(part * 10, part * 10 + 10)).coalesce(1), log)
    reader = N.NotifiedReader(log, root, 4)
    assert reader.initialOffset() == {"batch": -1} and reader.latestOffset() == {"batch": 2}
    parts = reader.partitions({"batch": 1}, {"batch": 2})
    assert [(p.first, p.n) for p in parts] == [(0, 4), (4, 4), (8, 2)] and all(f"/{2:012d}/" in p.file for p in parts)
    assert [k for b in reader.read(parts[1]) for k in b.column("content").to_pylist()] == [f"object {i}".encode() for i in range(24, 28)]
    assert reader.partitions({"batch": 2}, {"batch": 2}) == []


def test_an_unfinished_batch_does_not_count(spark, tmp_path):
    root, log = str(tmp_path / "root"), str(tmp_path / "log")
    assert N.NotifiedReader(log, root, 4).latestOffset() == {"batch": -1}
    N.announce(stored(spark, root, range(3)), log)
    N.announce(stored(spark, root, range(3, 6)), log)
    (tmp_path / "log" / f"{1:012d}" / "_SUCCESS").unlink()
    assert N.NotifiedReader(log, root, 4).latestOffset() == {"batch": 0}
    N.announce(stored(spark, root, range(6, 8)), log)  # written over the unfinished one
    assert N.NotifiedReader(log, root, 4).latestOffset() == {"batch": 1}
    assert sorted(r.text for r in N.ingest_notified(spark, log, root, str(tmp_path / "out")).select(F.col("text")).collect()) == [f"object {i}" for i in (0, 1, 2, 6, 7)]
