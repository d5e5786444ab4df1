import json

from pyspark.sql import functions as F

from newsmill.sources import events, payloads


def rec(bucket="b", key="k", source="aws:s3"):
    return {"eventSource": source, "s3": {"bucket": {"name": bucket}, "object": {"key": key}}}


def frame(spark, docs):
    rows = [(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, "event_id int, event_json string")


def test_records(spark):
    df = frame(spark, [{"Records": [rec(key="test-email.html")]}, {"Records": [rec(key="a"), rec(key="b")]},
                       {"Records": [rec(key="folder%2Ftest%20email.html")]}, {"Records": [rec(key="a+b%zz")]}])
    rows = events.event_records(df).orderBy("event_id", "pos").collect()
    assert [(r.event_id, r.pos, r.key) for r in rows] == [
        (0, 0, "test-email.html"), (1, 0, "a"), (1, 1, "b"), (2, 0, "folder/test email.html"), (3, 0, "a b%zz")]


def test_rejects(spark):
    bad = [{}, {"Records": []}, {"Records": "x"}, {"Records": [rec(source="other")]}, {"Records": [{"eventSource": "aws:s3"}]},
           {"Records": [{"eventSource": "aws:s3", "s3": {"object": {"key": "k"}}}]}, {"Records": [rec(bucket="")]},
           {"Records": [rec(key=5)]}, {"Records": [rec(), rec(key="")]}, {"Records": [7]}, "not json", "[1]"]
    rows = events.event_rejects(frame(spark, bad)).orderBy("event_id").collect()
    assert [r.reject_reason for r in rows] == [
        "records_missing", "records_empty", "records_not_a_list", "event_source", "s3", "bucket", "bucket", "key", "key",
        "record", "not_json", "not_json"]
    assert events.event_records(frame(spark, bad)).count() == 0


def test_decode(spark):
    data = [(0, "café".encode()), (1, b"\xe9\xe8\xe7"), (2, b""), (3, bytes(range(256)) * 4), (4, b" \n")]
    df = spark.createDataFrame(data, "i int, content binary")
    rows = events.raw_object_decode(df).orderBy("i").collect()
    assert [r.text for r in rows[:2]] == ["café", "éèç"]
    assert rows[3].text == bytes(range(256)).decode("latin-1") * 4
    assert [r.reject_reason for r in rows] == [None, None, "blank", None, "blank"]


def test_payload_forms(spark):
    docs = [{"payload": "This is email content"}, {"payload": {"content": "c", "body": "b", "x": 1}}, {"payload": {"content": "c", "body": ""}},
            {"payload": {"html": "h", "message": "m", "content": None}}, {"payload": {"subject": "s"}}, {}, {"payload": ""}, {"payload": {}},
            {"payload": 5}, {"payload": True}, {"payload": None}, "nope", {"payload": {"body": 0, "content": False, "html": [], "message": {}}},
            {"payload": {"body": 7}}, {"payload": [1, 2]}]
    rows = payloads.payload_normalize(frame(spark, docs)).orderBy("event_id").collect()
    assert [r.content for r in rows] == [
        "This is email content", "b", "c", "h", '{"subject":"s"}', None, None, None, "5", "True", "None", None,
        '{"body":0,"content":false,"html":[],"message":{}}', "7", "[1,2]"]
    assert [r.reject_reason for r in rows if r.content is None] == ["missing", "empty", "empty", "invalid"]


def test_execution_input(spark):
    df = spark.sql("SELECT 'mail' c, 'b' b, 'k' k, timestamp'2024-01-01 00:00:00' t")
    row = events.execution_input(df, "c", "b", "k", "t").select("input_json").first()
    assert json.loads(row.input_json) == {"payload": "mail", "timestamp": 1704067200, "source": "s3_event", "s3": {"bucket": "b", "key": "k"}}


def test_trigger_response_of_bad_event(spark):
    df = frame(spark, [{"Records": []}]).withColumn("seconds", F.lit(0.123))
    r = events.trigger_response(df).first()
    assert (r.status_code, r.processed_records, r.execution_time, r.results) == (400, 0, 0.12, None)
