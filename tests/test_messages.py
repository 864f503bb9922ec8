import pytest
from helpers import rows

from clicktide.plans.scratch import exists
from clicktide.sources import files, messages

GOOD = '{"timestamp":1433221332117,"visitorid":257597,"event":"view","itemid":355908,"transactionid":null}'
FLOAT_ID = '{"timestamp":1,"visitorid":2,"event":"transaction","itemid":3,"transactionid":4000.0}'
BAD = [
    "not json", "[]", "", None, '{"timestamp":"abc","visitorid":1}', '{"timestamp":1,"itemid":3.0}',
    '{"timestamp":1,"visitorid":2,"event":"view"}', GOOD[:-1],
]


def test_parse(spark):
    df = spark.createDataFrame([(m,) for m in [GOOD, FLOAT_ID, *BAD]], "value string")
    valid, invalid = messages.parse_events(df)
    got = {r.itemid: r for r in valid.collect()}
    assert set(got) == {355908, 3}
    assert got[3].transactionid == "4000" and got[355908].transactionid is None
    assert got[355908].event_time.microsecond == 117000
    assert sorted(map(str, (r.raw_message for r in invalid.collect()))) == sorted(map(str, BAD))


def test_hostile_messages_stay_whole(spark):
    huge = GOOD.replace("1433221332117", "9223372036854775807")
    far = GOOD.replace("1433221332117", "253402300800000")
    bad = [huge, far, GOOD + " garbage", GOOD + GOOD, GOOD + "," + GOOD, GOOD + "],[" + GOOD, GOOD + ",0],[" + GOOD, "1", GOOD + "]"]
    odd = [FLOAT_ID.replace("4000.0", '"T-4000"'), FLOAT_ID.replace("4000.0", "4000.7"), " " + GOOD + "\n"]
    df = spark.createDataFrame([(m,) for m in [*bad, *odd]], "value string")
    valid, invalid = messages.parse_events(df)
    assert sorted(r.raw_message for r in invalid.collect()) == sorted(bad)
    assert sorted(str(r.transactionid) for r in valid.collect()) == ["4000.7", "None", "T-4000"]


def test_binary_values(spark):
    df = spark.createDataFrame([(bytearray(GOOD, "utf8"),)], "value binary")
    assert messages.parse_events(df)[0].count() == 1


def test_dead_letters(spark):
    invalid = spark.createDataFrame([("oops",)], "raw_message string")
    row = messages.dead_letter(invalid).first()
    assert (row.raw_message, row.error_message) == ("oops", "JSON parsing failed") and row.error_timestamp


def test_messages_keep_nulls(spark):
    df = spark.createDataFrame([(1, float("nan")), (None, 2.5)], "visitorid long, transactionid double")
    got = rows(messages.to_messages(df), "value")
    assert ("1", '{"visitorid":1,"transactionid":null}') in got
    assert all(key is not None for key, _ in got)
    keyless = messages.to_messages(df.drop("visitorid"))
    assert len({r.key for r in keyless.collect()}) == 2


def test_unknown_stream_source(spark):
    with pytest.raises(ValueError):
        messages.read_stream(spark, "carrier pigeon")


def test_events_csv(spark, tmp_path):
    path = tmp_path / "events.csv"
    path.write_text("timestamp,visitorid,event,itemid,transactionid\n1,2,view,3,\n4,5,transaction,6,7.0\n")
    assert rows(files.read_events_csv(spark, str(path)), "timestamp") == [
        (1, 2, "view", 3, None), (4, 5, "transaction", 6, 7.0)
    ]
    assert files.read_events_csv(spark, str(path), sample=1).count() == 1
    swapped = tmp_path / "swapped.csv"
    swapped.write_text("itemid,timestamp,visitorid,event,transactionid\n3,1,2,view,\n")
    assert rows(files.read_events_csv(spark, str(swapped))) == [(1, 2, "view", 3, None)]


def test_csv_cells_that_do_not_fit(spark, tmp_path):
    path = tmp_path / "events.csv"
    path.write_text("timestamp,visitorid,event,itemid,transactionid\n1,x,view,3,\n4,5,transaction,y,z\n")
    counts = dict(rows(files.unreadable_cells(spark, str(path))))
    assert counts == {"timestamp": 0, "visitorid": 1, "event": 0, "itemid": 1, "transactionid": 1}
    with pytest.raises(Exception):
        files.read_events_csv(spark, str(path)).collect()
    for text in ("categoryid,parentid\n1,abc\n", "categoryid,parentid\n1,2,3\n", "categoryid,other\n1,2\n"):
        path.write_text(text)
        with pytest.raises(Exception):
            files.load_category_tree(spark, str(path), str(tmp_path / "tree"))
    path.write_text("parentid,categoryid\n,1\n1,2\n")
    assert rows(files.read_category_tree(spark, str(path)), "categoryid") == [(1, None), (2, 1)]
    path.write_text("timestamp,itemid,property,value\n1,2," + "p" * 101 + ",red\n")
    with pytest.raises(ValueError):
        files.load_item_properties(spark, [str(path)], str(tmp_path / "properties"))


def test_category_tree(spark, tmp_path):
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    good.write_text("categoryid,parentid\n1,\n2,1\n")
    bad.write_text("categoryid,parentid\n1,\n1,2\n")
    target = str(tmp_path / "tree")
    assert files.load_category_tree(spark, str(good), target) == 2
    assert files.load_category_tree(spark, str(good), target) == 2  # replaced, not appended
    with pytest.raises(ValueError):
        files.load_category_tree(spark, str(bad), target)
    assert rows(spark.read.parquet(target), "categoryid") == [(1, None), (2, 1)]


def test_item_properties(spark, tmp_path):
    one = tmp_path / "one.csv"
    one.write_text("timestamp,itemid,property,value\n1,2,color,red\n")
    target = str(tmp_path / "properties")
    missing = str(tmp_path / "two.csv")
    assert not exists(spark, missing)
    assert files.load_item_properties(spark, [str(one), missing], target) == 1
    assert files.load_item_properties(spark, [missing], target) == 0
    one.write_text("timestamp,itemid,property,value\n1,,color,red\n")
    with pytest.raises(ValueError):
        files.load_item_properties(spark, [str(one)], target)
