import random

import pytest
from helpers import clicks, random_clicks, rows

from clicktide.operators import features


def events_of(spark, **counts):
    made = [(int(v[1:]), "view", i) for v, n in counts.items() for i in range(n)]
    return clicks(spark, made)


def sizes(df):
    return dict(rows(df.groupBy("visitorid").count()))


@pytest.mark.parametrize("max_group_rows", [1000, 2])
def test_split_sizes(spark, max_group_rows):
    data = events_of(spark, v1=1, v2=2, v3=3, v5=5, v10=10)
    train, test = features.split_by_user(data, max_group_rows=max_group_rows)
    assert sizes(train) == {1: 1, 2: 1, 3: 2, 5: 4, 10: 8}
    assert sizes(test) == {2: 1, 3: 1, 5: 1, 10: 2}


@pytest.mark.parametrize("max_group_rows", [1000, 15])
def test_split_is_chronological_and_complete(spark, max_group_rows):
    made = random_clicks(random.Random(1), 400, 15, 20, hot=3)
    data = clicks(spark, made)
    train, test = features.split_by_user(data, 0.3, max_group_rows)
    train_rows, test_rows = rows(train), rows(test)
    assert sorted(train_rows + test_rows) == rows(data, "id")
    for visitor in {r[2] for r in test_rows}:
        newest_train = max(r[1] for r in train_rows if r[2] == visitor)
        assert all(r[1] > newest_train for r in test_rows if r[2] == visitor)


@pytest.mark.parametrize("test_size", [0.0, 0.2, 0.5, 1.0])
def test_time_split(spark, test_size):
    data = clicks(spark, random_clicks(random.Random(2), 97, 9, 9))
    train, test = features.split_by_time(data, test_size)
    ordered = [r[0] for r in rows(data, "timestamp", "id")]
    cut = int(97 * (1 - test_size))
    assert sorted(r[0] for r in rows(train)) == ordered[:cut]
    assert sorted(r[0] for r in rows(test)) == ordered[cut:]


@pytest.mark.parametrize("untimed", [0, 1, 5, 9, 10])
def test_time_split_with_missing_times(spark, untimed):
    made = [(i, None if i % 2 == 0 and i < 2 * untimed or untimed == 10 else 1000 + i, 1, "view", 1, None) for i in range(10)]
    data = spark.createDataFrame(made, "id long, timestamp long, visitorid long, event string, itemid long, transactionid long")
    train, test = features.split_by_time(data)
    order = sorted(made, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert sorted(r.id for r in train.collect()) == sorted(r[0] for r in order[:8])
    assert sorted(r.id for r in test.collect()) == sorted(r[0] for r in order[8:])


def test_time_split_inside_one_moment(spark):
    data = spark.createDataFrame(
        [(i, 5 if 2 <= i < 90 else i, 1, "view", 1, None) for i in range(100)],
        "id long, timestamp long, visitorid long, event string, itemid long, transactionid long",
    )
    train, test = features.split_by_time(data)
    ordered = [r[0] for r in rows(data, "timestamp", "id")]
    assert sorted(r[0] for r in rows(train)) == sorted(ordered[:80])
    assert train.count() + test.count() == 100


def test_sequences_by_length(spark):
    data = events_of(spark, v5=5, v6=6, v8=8)
    got = rows(features.item_sequences(data, 5), "visitorid", "position")
    assert [(r[0], r[3]) for r in got] == [(6, 5), (8, 5), (8, 6), (8, 7)]
    assert got[0][2] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("max_group_rows", [4, 7, 50])
def test_sequences_of_a_large_visitor(spark, max_group_rows):
    data = clicks(spark, random_clicks(random.Random(5), 300, 10, 40, hot=2))
    want = rows(features.item_sequences(data, 4), "visitorid", "position")
    got = rows(features.item_sequences(data, 4, max_group_rows=max_group_rows), "visitorid", "position")
    assert got == want
    events = sizes(data)
    assert len(got) == sum(max(0, n - 4) for n in events.values())


def test_active_users(spark):
    data = events_of(spark, v1=1, v2=2, v3=3, v4=4)
    assert sizes(features.active_user_events(data)) == {3: 3, 4: 4}
    first = rows(features.active_user_events(data, limit=4))
    assert [r[2] for r in first] == [3, 3, 3, 4]


def test_event_features(spark):
    data = clicks(spark, [(1, "view", 10), (1, "transaction", 11), (2, "signup", 10)])
    got = {r["id"]: r for r in features.event_features(data).collect()}
    assert (got[0].event_view, got[0].event_transaction) == (True, False)
    assert not any((got[2].event_view, got[2].event_addtocart, got[2].event_transaction))
    assert got[0].conversion_rate == 0.5 and got[2].conversion_rate == 0.0
    assert [got[i].item_popularity for i in range(3)] == [2, 1, 2]
    assert got[0].dayofweek == 1 and got[0].hour == 22  # Tuesday 2023-11-14 22:13:20 UTC
    assert got[0].activity_days == 1 / 86400


def test_features_round_trip_as_csv(spark, tmp_path):
    data = clicks(spark, [(1, "view", 10), (2, "view", 11)])
    made = features.event_features(data)
    features.save_features(made, str(tmp_path / "out"), "csv")
    back = spark.read.option("header", True).schema(made.schema).csv(str(tmp_path / "out"))
    assert rows(back, "id") == rows(made, "id")


def test_split_summary(spark):
    data = events_of(spark, v1=4, v2=1)
    train, test = features.split_by_user(data, 0.5)
    got = features.split_summary(train, test).first()
    assert (got.train_events, got.test_events, got.common_users) == (3, 2, 1)
    assert got.train_percent == 60.0 and got.common_percent == 100.0
    empty = features.split_summary(train, test.limit(0)).first()
    assert empty.common_percent == 0.0
