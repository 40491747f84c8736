"""The versioned record store."""

import hashlib
import os
import tempfile
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from casebook.operators.writes import apply_updates
from casebook.schema import CASE_SCHEMA, VALUE_COLUMNS
from casebook.sources.store import RecordStore, VersionTaken
from tests.conftest import CASE_ROWS

UPDATES = ("Patient_ID long, seq long, set_fields array<string>, Age int, Gender string, Condition string, Procedure string, Cost double, "
           "Length_of_Stay int, Readmission string, Outcome string, Satisfaction int")


@pytest.fixture
def store(spark):
    return RecordStore(spark, f"{tempfile.mkdtemp(prefix='casebook-store-')}/records")


@pytest.fixture
def filled(spark, store, small_cases):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    store.create(small_cases)
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    return store


def update(spark, rows):
    full = [(key, seq, names, *[dict(zip(names, values)).get(c) for c in VALUE_COLUMNS]) for key, seq, names, values in rows]
    return spark.createDataFrame(full, UPDATES)


def files(store):
    return {r["file"]: (r["low"], r["high"], r["rows"]) for r in store.manifest().collect()}


def digest(file):
    with open(urlparse(file).path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def records(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_files_have_narrow_key_ranges(filled, small_cases):
    ranges = sorted(files(filled).values())
    assert len(ranges) > 3 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    assert records(filled.read()) == records(small_cases)
    assert filled.highest_id() == small_cases.agg(F.max("Patient_ID")).first()[0]


def test_update_rewrites_only_touched_files(spark, filled, small_cases):
    before = files(filled)
    sums = {f: digest(f) for f in before}
    low, high, _ = sorted(before.values())[1]
    keys = [r[0] for r in small_cases.where(F.col("Patient_ID").between(low, high)).select("Patient_ID").limit(3).collect()]
    batch = update(spark, [(keys[0], 1, ["Cost"], [1.5]), (keys[0], 2, ["Cost", "Outcome"], [2.5, None]),
                           (keys[1], 1, ["Satisfaction"], [5]), (-7, 1, ["Cost"], [9.0]), (keys[2], 1, ["Ward"], [1])])
    done = filled.update(batch)
    assert done.version == 1 and [tuple(r) for r in done.rejected.collect()] == [(-7, 1)]
    after = files(filled)
    gone = set(before) - set(after)
    assert [before[f] for f in gone] == [sorted(before.values())[1]]
    assert all(digest(f) == sums[f] for f in before)  # untouched and old ones alike
    expected, _ = apply_updates(small_cases, batch)
    assert records(filled.read()) == records(expected)
    assert records(filled.read(0)) == records(small_cases)


def test_insert_numbers_on_without_a_scan(spark, filled, small_cases):
    batch = spark.createDataFrame([(2, *CASE_ROWS[1][1:]), (1, *CASE_ROWS[0][1:]), (3, *CASE_ROWS[5][1:])],
                                  "seq long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CASE_SCHEMA.fields[1:]))
    top = filled.highest_id()
    done = filled.insert(batch, ["seq"])
    assert [r["seq"] for r in done.rejected.collect()] == [3]
    assert records(filled.read().where(F.col("Patient_ID") > top)) == [(top + 1, *CASE_ROWS[0][1:]), (top + 2, *CASE_ROWS[1][1:])]
    assert filled.highest_id() == top + 2
    assert filled.read().count() == small_cases.count() + 2


def test_failed_write_leaves_the_old_version(spark, filled, small_cases):
    key = small_cases.agg(F.min("Patient_ID")).first()[0]

    def broken(batches):
        for _ in batches:
            raise RuntimeError("lost")
        yield from ()

    bad = small_cases.mapInArrow(broken, small_cases.schema)
    with pytest.raises(Exception, match="lost"):
        filled.append(bad)
    assert filled.versions() == [0] and records(filled.read()) == records(small_cases)
    assert filled.update(update(spark, [(key, 1, ["Age"], [33])])).version == 1


def test_stopped_before_publishing(spark, filled, small_cases, monkeypatch):
    """Data files without a manifest are not read."""
    key = small_cases.agg(F.min("Patient_ID")).first()[0]
    monkeypatch.setattr(RecordStore, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(RuntimeError, match="stopped"):
        filled.update(update(spark, [(key, 1, ["Age"], [33])]))
    monkeypatch.undo()
    assert filled.versions() == [0] and records(filled.read()) == records(small_cases)


def test_two_writers_cannot_publish_one_version(filled, small_cases):
    extra = small_cases.limit(1)
    filled.append(extra, on=0)
    with pytest.raises(VersionTaken):
        filled.append(extra, on=0)
    assert filled.versions() == [0, 1]
    with pytest.raises(VersionTaken):
        filled.create(extra)


def test_updates_that_touch_nothing(spark, filled):
    for batch in (update(spark, []), update(spark, [(-1, 1, ["Age"], [3])]), update(spark, [(None, 1, ["Age"], [3])]),
                  update(spark, [(10 ** 9, 1, ["Ward"], [3])])):
        assert filled.update(batch).version == 0
    assert filled.versions() == [0]


def test_empty_store(spark, store, empty_cases, tiny_cases):
    with pytest.raises(ValueError, match="no version"):
        store.read()
    store.create(empty_cases)
    assert store.read().count() == 0 and store.highest_id() == 0
    assert store.update(update(spark, [(1, 1, ["Age"], [3])])).version == 0
    store.append(tiny_cases)
    assert records(store.read()) == records(tiny_cases)
    assert os.path.isdir(f"{store.path}/manifests/1")
