"""The shard store after dead writers, on empty tables, with odd column names; orphans and old versions."""

import os
import time

import pytest

from loadloom.llm import sharding
from loadloom.llm.queries import op5_sharding


def store_at(spark, tmp_path):
    return sharding.ShardStore(spark, f"file://{tmp_path}/s", target=1 << 20)


def test_an_empty_table_reads_as_no_rows(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    store = sharding.shard_documents(docs, f"file://{tmp_path}/s")
    assert store.version() == 0 and store.read().columns == ["doc_id", "text", "_shard", "_tier"] and store.read().collect() == []
    store.append(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    assert [tuple(r)[1:3] for r in store.read().select("_shard", "doc_id", "text").collect()] == [(1, "a")]
    docs.write.parquet(f"{tmp_path}/t/documents.parquet")
    assert op5_sharding(spark, f"{tmp_path}/t").collect() == []


def test_a_dead_writer_locks_nothing(spark, tmp_path, monkeypatch):
    store = store_at(spark, tmp_path)
    one = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    store.append(one)
    with monkeypatch.context() as m:  # dies between the manifest and the rename, leaving a draft
        m.setattr(store, "_put", lambda name, content: True if name == "schema" else (_ for _ in ()).throw(OSError("died")))
        with pytest.raises(OSError):
            store.append(one)
    open(f"{tmp_path}/s/commits/0000000002", "w").close()  # an empty file, as writers of an older kind left it
    assert store.version() == 1
    assert [store.append(one) for _ in range(3)] == [2, 3, 4]
    assert store.read().count() == 4
    with pytest.raises(sharding.Conflict):
        store.commit(store.manifest(1), 1)
    assert store.version() == 4 and store.read().count() == 4


def test_a_beaten_writer_leaves_nothing_and_vacuum_removes_the_rest(spark, tmp_path, monkeypatch):
    store = store_at(spark, tmp_path)
    one = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for _ in range(3):
        store.append(one)
    monkeypatch.setattr(store, "version", lambda: 1)
    with pytest.raises(sharding.Conflict):
        store.append(one)
    monkeypatch.undo()
    listed = lambda what: sorted(n for n in os.listdir(f"{tmp_path}/s/{what}") if not n.startswith("."))
    assert len(listed("data")) == 3 == len(listed("manifests")) and listed("drafts") == []
    one.write.parquet(f"{tmp_path}/s/data/orphan")
    store.compact()
    assert store.version() == 4 and len(listed("data")) == 5
    assert store.vacuum(age=3600) == 0 and len(listed("data")) == 5  # too young: may be a writer's
    assert store.vacuum(versions=4, age=0) == 1 and store.read(2).count() == 2
    time.sleep(0.01)
    assert store.vacuum(age=0) == 3
    assert store.version() == 4 and store.read().count() == 3 and listed("commits") == ["0000000004"] and len(listed("manifests")) == 1
    assert store.append(one) == 5 and store.read().count() == 4


def test_column_names(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"t{k}", k) for k in range(9)], "doc_id long, `a.b` string, `x y` int")
    store = sharding.shard_documents(docs, f"file://{tmp_path}/s")
    assert sorted(map(tuple, store.read().select("doc_id", "`a.b`", "`x y`").collect())) == sorted(map(tuple, docs.collect()))
    assert store.manifest().count() == 1
    for name in ("_Tier", "_SHARD", "_run", "_No"):
        with pytest.raises(ValueError):
            sharding.shard_documents(docs.withColumnRenamed("x y", name), f"file://{tmp_path}/t")
