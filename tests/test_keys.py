import random
from collections import Counter

from pyspark.sql import functions as F

from tabsight.operators import keys, validate
from tabsight.sources import dictionary


def test_orphans_equal_brute_force_with_a_hot_key(spark, monkeypatch):
    rng = random.Random(1)
    child = [(None if rng.random() < 0.05 else rng.choice([7, 7, 7, rng.randint(0, 60)]), rng.choice(["a", "b", None])) for _ in range(3000)]
    parent = [(rng.randint(0, 60), rng.choice(["a", "b", None])) for _ in range(60)] + [(7, "a")] * 500
    want = Counter(k for k in child if None not in k and k not in set(parent))
    left = spark.createDataFrame(child, "x int, y string").withColumn("n", F.lit(0))
    right = spark.createDataFrame([(str(a), b) for a, b in parent], "p string, q string")  # another type
    for most in (keys.BLOOM_KEYS, 0):  # with and without the filter
        monkeypatch.setattr(keys, "BLOOM_KEYS", most)
        got = keys.fk_orphans(left.drop("n"), ["x", "y"], right, ["p", "q"]).collect()
        assert {(r.x, r.y): r.n for r in got} == dict(want)
    got = keys.pk_duplicates(left.drop("n"), ["x", "y"]).collect()
    assert {(r.x, r.y): r.n for r in got} == {k: n for k, n in Counter(child).items() if n > 1 and None not in k}
    assert keys.pk_nulls(left, ["x", "y"]).first()["n"] == sum(None in k for k in child)


def test_filter_has_no_false_negatives(spark):
    bits = keys.bloom_filter(spark.range(5000).selectExpr("id * 3 AS k"), ["k"])
    passed = {r.k for r in keys._passing(spark.range(15000).selectExpr("id AS k"), ["k"], bits).collect()}
    assert set(range(0, 15000, 3)) <= passed and len(passed) < 5200


def test_empty_tables_and_nan(spark):
    empty = spark.createDataFrame([], "x double")
    some = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert keys.fk_orphans(empty, ["x"], some, ["x"]).count() == 0
    assert [(r.x, r.n) for r in keys.fk_orphans(some, ["x"], empty, ["x"]).collect()] == [(1.0, 1)]
    assert keys.pk_duplicates(empty, ["x"]).count() == 0 and keys.pk_nulls(some, ["x"]).first()["n"] == 2


def test_keys_of_a_dictionary(spark):
    text = '{"primary_keys": ["a"], "foreign_keys": [{"columns": ["b"], "table": "t"}, {"columns": ["b"]}, {"columns": ["a", "b"], "table": "t", "references": ["x"]}]}'
    found = dictionary.keys_of(spark, text)
    assert found.primary == ("a",) and [(k.columns, k.table, k.references) for k in found.foreign] == [(("b",), "t", ("b",))]
    assert dictionary.keys_of(spark, "no json") == dictionary.Keys()


def test_verdict_takes_keys_in(spark):
    df = spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "a int, b int")
    other = spark.createDataFrame([(5,), (6,)], "b int")
    text = '{"columns": {"a": {}, "b": {}}, "primary_keys": ["a"], "foreign_keys": [{"columns": ["b"], "table": "t"}, {"columns": ["z"], "table": "t", "references": ["b"]}]}'
    listed = dictionary.parse_dictionary(spark, text)
    issues = validate.validate(df, listed, dictionary.rules_of(listed), dictionary.keys_of(spark, text), {"t": other})
    assert {(r.rule, r.column, r.n) for r in issues.collect()} == {("primary_key", "a", 2), ("foreign_key", "b", 1), ("key_column_missing", "z", 1)}
    assert tuple(validate.verdict(issues).first()) == (False, 3, 0)
    assert validate.verdict(validate.validate(df, listed, dictionary.rules_of(listed))).first().is_valid
