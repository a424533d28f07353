import pytest
from compare import same_rows
from pyspark.sql import functions as F

from heddle import catalog, functions
from heddle.operators import constraints, errors, lookup, options, records
from heddle.streaming import events

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, name):
    same_rows(catalog.QUERIES[name](spark, SF), catalog.ORACLES[name], SF)


@pytest.mark.parametrize(
    ("given", "kind", "items"),
    [
        (None, None, None), ([], None, None), (["a", "a"], "scalar", ["a"]), (["a", "b", "a"], "list", ["a", "b"]),
        ([None], None, None), (["a", None], "list", ["a"]), ([None, ""], "list", []), (["a", "A"], "list", ["a", "A"]),
    ],
)
def test_error_list(spark, given, kind, items):
    schema = "k int, content string, errors array<struct<message:string,extra:int>>"
    lists = None if given is None else [None if m is None else (m, i) for i, m in enumerate(given)]
    found = errors.reduce_errors(spark.createDataFrame([(1, "", lists)], schema), "k", content="content").collect()
    assert [(r.kind, r["items"]) for r in found] == ([(kind, items)] if kind else [])
    told = errors.reduce_errors(spark.createDataFrame([(1, "x", lists)], schema), "k", content="content").collect()
    assert [(r.kind, r["items"]) for r in told] == [("content", ["x"])]


def test_whole_errors(spark):
    schema = "k int, content string, errors array<struct<message:string,extra:int>>"
    lists = spark.createDataFrame([(1, "", [("a", 1), ("b", 2), ("a", 3), None]), (2, "x", [("a", 1)]), (3, None, [None])], schema)
    found = errors.reduce_errors(lists, "k", content="content", whole=True).collect()
    assert sorted((r.k, r.kind, [tuple(x) for x in r["items"]]) for r in found) == [(1, "list", [("a", 3), ("b", 2)]), (2, "content", [("x", None)])]


def test_search_constraints_update_lookup(spark):
    rows = spark.createDataFrame([("Next.js", True), ("next", None), (None, False)], "item string, c boolean")
    assert options.search(rows, "item", "NEXT").count() == 2
    assert constraints.valid(rows, required=("item",), domains={"item": ("next",)}).count() == 1
    held = rows.select(F.struct(F.lit(True).alias("a"), F.lit(True).alias("b")).alias("s"), "c")
    assert [r.s.b for r in records.set_flag(held, "s", "b", F.col("c")).collect()] == [True, False, False]
    assert [r[0] for r in rows.select(lookup.variant(F.col("item"), {"next": "n", "d": "x"}, "d")).collect()] == ["x", "n", "x"]
    table = spark.createDataFrame([("next", "n"), ("d", "x")], "key string, value string")
    assert sorted(r.variant for r in lookup.join_variants(rows, "item", table, "d").collect()) == ["n", "x", "x"]
    assert rows.select(functions.include((F.col("c"), F.lit("y"))).alias("v")).collect()[1].v == []


def test_stream_gives_the_batch_rows(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/events.parquet")
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = events.hourly(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("hours").collect())) == sorted(map(tuple, events.hourly(table).collect()))


def test_empty_result_order_and_unknown_keys(spark):
    rows = spark.createDataFrame([("Next.js",), ("next",), (None,)], "item string")
    found = lambda q: sorted(map(tuple, options.search_or_message(rows, "item", q, "none").collect()), key=repr)
    assert found("NEXT") == [("Next.js", None), ("next", None)]
    assert found("x!") == [(None, "none")] == sorted(map(tuple, options.search_or_message(rows.limit(0), "item", "", "none").collect()))
    lists = spark.createDataFrame([(["b", "a", None],), ([],), (None,)], "a array<string>")
    shown = lists.select(options.items_of(F.col("a"), key=lambda x, i: i, value=lambda x, i: x).alias("v")).collect()
    assert [None if r.v is None else [tuple(x) for x in r.v] for r in shown] == [[(0, "b"), (1, "a"), (2, None)], [], None]
    look = {"next": "n", "d": "x"}
    one = lambda **o: [r[0] for r in rows.select(lookup.variant(F.col("item"), look, "d", **o)).collect()]
    assert one() == ["x", "n", "x"] and one(on_unknown="nothing") == [None, "n", "x"]
    axes = rows.select(lookup.variants_of((F.col("item"), look, "d"), (F.lit(None), {"e": "z"}, "e")).alias("v")).collect()
    assert [r.v for r in axes] == [["z"], ["n", "z"], ["x", "z"]]
