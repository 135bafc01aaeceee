from loadloom.plans import extensions
from loadloom.sources.journal import idempotent_append, read_points


def test_points_and_corrupt_lines(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"metric":"a","data":{"time":"2024-01-01T00:00:00Z","value":1.5}}\n{broken\n')
    rows = read_points(spark, str(tmp_path / "p.json")).collect()
    assert sorted(r.metric or "" for r in rows) == ["", "a"]
    assert [r["_line"] for r in rows if not r.metric] == ["{broken"]


def test_journal_is_idempotent(spark, tmp_path):
    path, odd = str(tmp_path / "j"), str(tmp_path / "odd")
    write = idempotent_append(path, ["k"], odd)
    first = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k long, v string")
    write(first, 0)
    write(first, 0)
    write(spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string"), 1)
    told = lambda p: sorted(map(tuple, spark.read.parquet(p).select("k", "v").collect()))
    assert told(path) == [(1, "a"), (2, "b"), (3, "d")]
    assert told(odd) == [(2, "c")]
    both = spark.createDataFrame([(4, "x"), (4, "y"), (1, "a"), (3, "d")], "k long, v string")  # a new key with two contents
    for _ in range(2):  # the second time after a crash
        write(both, 2)
    assert len(told(path)) == 4 and {(4, "x"), (4, "y")} == {r for r in told(path) + told(odd) if r[0] == 4}
    assert len(told(odd)) == 2


def test_transforms_by_name(spark):
    @extensions.transform("double")
    def double(df):
        return df.selectExpr("id * 2 id")

    assert [r.id for r in extensions.TRANSFORMS["double"](spark.range(3)).collect()] == [0, 2, 4]
