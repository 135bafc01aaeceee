"""The indexed journal reads only what may hold a batch's keys, and its two sinks change together."""

from pyspark.sql.types import StructType

from loadloom.sources.indexed import IndexedJournal

SCHEMA = "series_id string, t long, value double, received long"


def journal(path, **more):
    return IndexedJournal(str(path), StructType.fromDDL(SCHEMA), ["series_id", "t"], "t", content=["value"], first_by="received", buckets=4, **more)


def told(df):
    return sorted(map(tuple, df.collect()))


def test_a_batch_reads_only_folders_that_may_hold_its_keys(spark, tmp_path):
    j = journal(tmp_path / "j")
    day = lambda d, v=0.0: spark.createDataFrame([("a", 100 * d + k, v, 0) for k in range(40)], SCHEMA)
    for d in range(6):
        j.append(day(d), d)
        assert j.looked_at == []  # nothing old is met by records in order of time
    j.append(day(2, 1.0), 6)
    assert len(j.looked_at) == 4 and all("batch=2/" in p for p in j.looked_at)  # of 24 folders
    j.append(spark.createDataFrame([("a", 305, 7.0, 1)], SCHEMA), 7)
    assert len(j.looked_at) == 1 and "batch=3/" in j.looked_at[0]
    assert j.rows(spark).count() == 240 and j.corrections(spark).count() == 41


def test_first_receipt_stays_and_others_are_corrections_once(spark, tmp_path):
    j = journal(tmp_path / "j")
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    first = frame([("a", 1, 5.0, 30), ("a", 1, 4.0, 20), ("a", 1, 4.0, 25), ("a", 2, 1.0, 9), ("b", None, 2.0, 9), ("b", 3, None, 9)])
    later = frame([("a", 1, 4.0, 99), ("a", 1, 6.0, 98), ("a", 2, 1.0, 97), ("b", 3, 8.0, 96), ("c", 1, 1.0, 95), ("b", None, 2.0, 94)])
    for batch, k in ((first, 0), (first, 0), (later, 1), (later, 1), (later, 1)):  # each may come again
        j.append(batch, k)
    rows = {(r.series_id, r.t): (r.value, r.received, r.batch) for r in j.rows(spark).collect()}
    assert rows == {("a", 1): (4.0, 20, 0), ("a", 2): (1.0, 9, 0), ("b", None): (2.0, 9, 0), ("b", 3): (None, 9, 0), ("c", 1): (1.0, 95, 1)}
    assert told(j.corrections(spark).select("series_id", "t", "value", "batch")) == [("a", 1, 5.0, 0), ("a", 1, 6.0, 1), ("b", 3, 8.0, 1)]


def test_a_crash_between_the_writes_changes_nothing(spark, tmp_path, monkeypatch):
    j = journal(tmp_path / "j")
    j.append(spark.createDataFrame([("a", 1, 1.0, 1)], SCHEMA), 0)
    batch = spark.createDataFrame([("a", 1, 2.0, 2), ("a", 2, 2.0, 2)], SCHEMA)
    monkeypatch.setattr(j, "_ranges", lambda rows: (_ for _ in ()).throw(OSError("lost")))
    for _ in range(2):
        try:
            j.append(batch, 1)
        except OSError:
            pass
    monkeypatch.undo()
    j.append(batch, 1)
    assert told(j.rows(spark).select("t", "value")) == [(1, 1.0), (2, 2.0)]
    assert told(j.corrections(spark).select("t", "value")) == [(1, 2.0)]


def test_stream_into_the_journal_over_a_restart(spark, tmp_path):
    j = journal(tmp_path / "j")
    for part in ([("a", 1, 1.0, 1), ("a", 2, 1.0, 1)], [("a", 1, 3.0, 2), ("a", 3, 1.0, 2)]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")).writeStream.foreachBatch(j.append).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert told(j.rows(spark).select("t", "value")) == [(1, 1.0), (2, 1.0), (3, 1.0)]
    assert told(j.corrections(spark).select("t", "value")) == [(1, 3.0)]
