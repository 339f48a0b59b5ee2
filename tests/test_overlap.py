import random

import pytest
from pyspark.sql import functions as F

from intervale.functions.scalars import Region
from intervale.operators import overlap as O
from intervale.operators import recipes
from intervale.plans.index import from_rows, merge
from intervale.plans.search import Search, all_against_all

#: (id, chrom, start, end)
DIAGRAM = [(0, "1", 1, 10), (1, "1", 11, 13), (2, "1", 2, 4), (3, "1", 5, 8), (4, "1", 3, 6), (5, "1", 7, 9), (6, "1", 7, 12), (7, "1", 11, 18), (8, "1", 1, 17), (9, "1", 15, 18)]
FEW = {"A": "1-100 5-9 10-15 40-50 60-70 80-90", "B": "1-105 21-31 41-51 61-71 81-91", "C": "2-300 25-35 45-55 65-75 85-95"}


@pytest.fixture(scope="module")
def diagram(spark):
    return spark.createDataFrame(DIAGRAM, "id int, chrom string, start bigint, end bigint")


@pytest.fixture(scope="module")
def few(spark):
    return from_rows(spark, [(f, "1", *map(int, x.split("-"))) for f, xs in FEW.items() for x in xs.split()])


@pytest.mark.parametrize("q, ids", [((2, 5), {0, 2, 3, 4, 8}), ((5, 15), {0, 1, 3, 4, 5, 6, 7, 8, 9}), ((19, 20), set()), ((18, 20), {7, 9}), ((20, 18), set())])
def test_diagram(spark, diagram, q, ids):
    assert {r.id for r in O.overlap([Region("1", *q)], diagram).collect()} == ids
    rows = spark.createDataFrame([("1", *q)], "chrom string, start bigint, end bigint")
    assert {r.id for r in O.overlap_binned(rows, diagram).collect()} == ids
    if ids:
        assert O.count_rank(rows, diagram.withColumn("f", F.lit("x")), ["f"]).first().overlaps == len(ids)


def test_few(few):
    assert [r.overlaps for r in Search(few, "1:1-25").counts().orderBy("file_id").collect()] == [3, 2, 2]
    assert Search(few, "chr1:20-50").total() == 8
    assert Search(few, "2:1-1000").total() == 0 and Search(few, "2:1-1000").counts().count() == 3
    assert Search(few, "1:1-25,1:1-25").total() == 14
    assert sorted(r.file_name for r in Search(few, "1:1-25", files=["A", "C"]).counts().collect()) == ["A", "C"]
    assert len(list(Search(few, "1:1-25").iterate())) == 7


def _random(rng, n, long):
    out = []
    for i in range(n):
        s = rng.randrange(1, 3_000_000)
        out.append((str(rng.randrange(1, 4)), s, s + rng.choice([0, 1, 50, 5000, long]), f"f{i % 3}"))
    return out


@pytest.mark.parametrize("bits", [8, 20])
def test_strategies_agree(spark, bits):
    rng = random.Random(bits)
    schema = "chrom string, start bigint, end bigint, f string"
    c = spark.createDataFrame(_random(rng, 400, 1_500_000), schema)
    q = spark.createDataFrame(_random(rng, 150, 20_000_000), schema).drop("f")
    want = sorted(map(tuple, O.count_pairs(O.overlap_naive(q, c), ["f"]).collect()))
    assert sorted(map(tuple, O.count_pairs(O.overlap_binned(q, c), ["f"]).collect())) == want
    assert sorted(map(tuple, O.count_pairs(O.overlap_binned(q.repartition(7), c.repartition(5), wide=True), ["f"]).collect())) == want
    assert sorted(map(tuple, O.count_rank(q, c, ["f"], bits).collect())) == want
    regions = [Region(r.chrom, r.start, r.end) for r in q.collect()[:60]]
    few = q.limit(60)
    assert sorted(map(tuple, O.count_pairs(O.overlap_literal(regions, c), ["f"]).collect())) == sorted(map(tuple, O.count_pairs(O.overlap_naive(spark.createDataFrame([(r.chrom, r.start, r.end) for r in regions], few.schema), c), ["f"]).collect()))


def test_binned_plan_is_an_equi_join(spark, diagram):
    q = spark.createDataFrame([("1", 2, 5)], "chrom string, start bigint, end bigint")
    plan = O.overlap_binned(q, diagram, wide=False)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_exploded_queries_are_not_broadcast(spark, diagram, tmp_path):
    """Spark's estimate is of the queries before they are dealt over the levels."""
    spark.range(400_000).select(F.lit("1").alias("chrom"), F.col("id").alias("start"), (F.col("id") + 9).alias("end")).write.parquet(str(tmp_path / "q"))
    plan = lambda q: O.overlap_binned(q, diagram, wide=False, levels=dict.fromkeys(O.LEVELS, 1 << 62))._jdf.queryExecution().executedPlan().toString()
    many = spark.read.parquet(str(tmp_path / "q"))
    assert "SortMergeJoin" in plan(many) and "Broadcast" not in plan(many)
    assert "BroadcastHashJoin" in plan(many.limit(5))


def test_edges(spark):
    i = from_rows(spark, [("a", "chr1", 1, 5), ("a", "1", 7, 7), ("b", "1", 6, 9)])
    assert Search(i, "1:5-5").total() == 1 and Search(i, "1:7-7").total() == 2 and Search(i, "1:10-12").total() == 0


def test_significance_and_merge(spark, few):
    q = spark.createDataFrame([("1", 1, 25), ("1", 1, 25), ("1", 60, 70)], "chrom string, start bigint, end bigint")
    got = Search(few, q).significance(1000).collect()
    assert [r.file_name for r in sorted(got, key=lambda r: r.file_name)] == ["A", "B", "C"]
    assert all(0 <= r.fishers_two_tail <= 1 for r in got)
    both = merge(few, from_rows(spark, [("D", "1", 1, 2)]))
    assert [r.file_id for r in both.files().collect()] == [0, 1, 2, 3]
    assert Search(both, "1:1-1").total() == 3
    sets = q.withColumn("query_file", F.lit("q"))
    per = {r.file_name: r for r in all_against_all(sets, few, 1000).collect()}
    assert all(per[r.file_name].overlaps == r.overlaps and per[r.file_name].combo_score == pytest.approx(r.combo_score) for r in got)


def test_recipes(spark):
    d = spark.createDataFrame([("x_E1_a",), ("E12",), ("none",)], "n string")
    labels = spark.createDataFrame([("E1",), ("E12",)], "l string")
    assert [r.l for r in recipes.longest_match(d, labels, "n", "l").collect()] == ["E1", "E12", None]
    c = spark.createDataFrame([("1", 1, 5), ("1", 4, 8)], "chrom string, start bigint, end bigint")
    assert sorted(map(tuple, recipes.coverage_depth(c).collect())) == [("1", 1, 3, 1), ("1", 4, 5, 2), ("1", 6, 8, 1)]
    with pytest.raises(Exception, match="no name for"):
        recipes.dictionary_join(d, spark.createDataFrame([("E12", "z")], "code string, v string"), "n", strict=True).collect()
