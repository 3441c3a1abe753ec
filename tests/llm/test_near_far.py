"""Members that are near their bucket's leader make no rows on the way to the members in doubt."""

from patchloom.llm import near_dup


def test_only_far_members_are_joined(spark, monkeypatch):
    made = {}
    monkeypatch.setattr(near_dup, "written", lambda df, name: made.setdefault(name, df))
    pairs = spark.createDataFrame([(1, v) for v in range(2, 40)], "u long, node long")
    links = spark.createDataFrame([(1, v, 95 if v < 38 else 60, 100) for v in range(2, 39)], "u long, v long, shared long, joint long")
    far = near_dup._far(pairs, links, 80)
    assert sorted(map(tuple, far.collect())) == [(1, 38, False), (1, 39, True)]
    members = spark.createDataFrame([(key, 1, v) for key in (7, 8) for v in range(2, 40)], "key long, u long, node long")
    found = near_dup._unsettled(members, far)
    # Both keys hold the same group, which is given once.
    assert sorted(map(tuple, found.select("key", "node", "n").collect())) == [(7, 38, 2), (7, 39, 2)]
    assert made["unsettled"].count() == 4
