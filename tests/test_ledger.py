import hashlib

import pyarrow as pa
import pytest

from newsmill.operators import messages
from newsmill.sources import ledger

SCHEMA = "key string, v long"


def key(i):
    return hashlib.sha256(str(i).encode()).hexdigest()


def frame(spark, ids, v=0):
    return spark.createDataFrame([(key(i), i + v) for i in ids], SCHEMA)


def test_what_is_written_is_read(spark, tmp_path):
    path = str(tmp_path / "a")
    assert ledger.rows(spark, path, SCHEMA).count() == 0
    ledger.append(frame(spark, range(300)), path, "key")
    ledger.append(frame(spark, range(300, 400)), path, "key")
    assert sorted(r.v for r in ledger.rows(spark, path, SCHEMA).collect()) == list(range(400))
    assert ledger.manifest(spark, path).agg({"n": "sum"}).first()[0] == 400
    ledger.append(frame(spark, []), path, "key")  # an empty write is a commit too
    assert ledger.rows(spark, path, SCHEMA).count() == 400


def test_look_up_reads_the_buckets_of_its_keys(spark, tmp_path):
    path = str(tmp_path / "b")
    for part in range(3):
        ledger.append(frame(spark, range(part * 500, part * 500 + 500)), path, "key")
    files = ledger.manifest(spark, path)
    asked = frame(spark, [3, 777, 10**6])
    names = {r.file for r in ledger.touched(files, asked, "key").collect()}
    buckets = {key(i)[0] for i in (3, 777, 10**6)}
    assert {n.split("/")[0] for n in names} <= {f"bucket={b}" for b in buckets}
    assert len(names) <= 3 * len(buckets) < files.count() / 4
    for r in files.collect():
        meets = any(key(i)[0] == r.bucket and r.low <= key(i) <= r.high for i in (3, 777, 10**6))
        assert not meets or r.file in names
    assert sorted(r.v for r in ledger.look_up(asked, path, "key", SCHEMA).collect()) == [3, 777]
    assert names == {f.removeprefix(f"file://{path}/") for f in ledger.read(spark, path, ledger.touched(files, asked, "key"), SCHEMA).inputFiles()}


def test_killed_before_the_commit(spark, tmp_path):
    """A task's files without a manifest are no part of the ledger, and the same rows
    written again are there once."""
    path = str(tmp_path / "c")
    ledger.append(frame(spark, range(10)), path, "key")
    batch = pa.RecordBatch.from_pydict({ledger.BUCKET: ["0", "0", "1"], "key": ["00a", "00b", "11a"], "v": [100, 101, 102]})
    writer = ledger.LedgerWriter(path, "key", "batch-7")
    done = [writer.write(iter([batch.slice(0, 1), batch.slice(1)])) for _ in range(2)]
    assert [f[0] for f in done[0].files] == ["0", "1"] and [f[2:] for f in done[0].files] == [("00a", "00b", 2), ("11a", "11a", 1)]
    assert ledger.rows(spark, path, SCHEMA).count() == 10
    writer.abort(done[:1])
    assert not any((tmp_path / "c" / f[1]).exists() for f in done[0].files)
    writer.commit(done[1:])
    assert sorted(r.v for r in ledger.rows(spark, path, SCHEMA).collect()) == [*range(10), 100, 101, 102]


def test_a_batch_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "d")
    ledger.append(frame(spark, range(5)), path, "key", 1)
    ledger.append(frame(spark, range(5, 9)), path, "key", 2)
    ledger.append(frame(spark, range(3), v=50), path, "key", 1)
    assert sorted(r.v for r in ledger.rows(spark, path, SCHEMA).collect()) == [5, 6, 7, 8, 50, 51, 52]


@pytest.mark.parametrize("batch_id", [None, 4])
def test_sink_after_a_killed_write(spark, tmp_path, batch_id):
    path = str(tmp_path / "e")
    df = spark.createDataFrame([("u1", "m1"), ("u2", "m2")], "url string, message string")
    keyed = messages.undelivered(df).withColumn(ledger.BUCKET, ledger.bucket_of("message_key")).sort(ledger.BUCKET).toArrow()
    ledger.LedgerWriter(path, "message_key", "batch-4").write(iter(keyed.to_batches()))  # and no commit
    assert messages.message_sink(df, path, batch_id).count() == 2
    assert messages.message_sink(df, path, batch_id).count() == 2
    assert sorted(r.url for r in messages.message_sink(df, path, 5).collect()) == ["u1", "u2"]


def test_a_call_of_the_sink_works_its_messages_out_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(f"u{i}", f"m{i}") for i in range(20)], "url string, message string")
    for call in (1, 2):
        counted = rows.mapInArrow(count, rows.schema)
        assert messages.message_sink(counted, str(tmp_path / "sent")).count() == 20
        assert seen.value == 20 * call
