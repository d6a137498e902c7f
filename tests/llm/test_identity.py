from chatterlake.llm import identity


def named(spark, rows):
    return identity.with_twins(spark.createDataFrame(rows, "id long, text string").repartition(3))


def test_rows_of_one_key_are_told_apart(spark, monkeypatch):
    rows = [(1, "a"), (2, "a"), (2, "b"), (2, "b"), (2, None), (3, None), (4, ""), (4, None)] + [(5, f"t{i % 9}") for i in range(40)]
    for size in (identity.BROADCAST_ROWS, 0):
        monkeypatch.setattr(identity, "BROADCAST_ROWS", size)
        df = named(spark, rows)
        assert df.columns == ["id", "text", "twin"]
        got = {(r.id, r.text): r.twin for r in df.collect()}
        assert df.count() == len(rows) and len(set((r.id, r.text, r.twin) for r in df.collect())) == len(set(rows))
        assert got[1, "a"] == got[3, None] == 0
        for key in (2, 4, 5):
            twins = sorted(t for (k, _), t in got.items() if k == key)
            assert twins == list(range(1, len(twins) + 1))
        once = identity.one_of_each(df).collect()
        assert sorted((r.id, r.twin) for r in once) == sorted((k, t) for (k, _), t in got.items())


def test_keys_of_their_own_and_no_rows(spark):
    assert {r.twin for r in named(spark, [(1, "a"), (2, "a"), (-3, None)]).collect()} == {0}
    assert named(spark, []).collect() == []
