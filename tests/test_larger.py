"""What grows with the tables: what goes through the driver, tasks, work for each row."""

import random

import duckdb
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from kelpie.operators import cells, inverted, lexical, routing
from kelpie.plans import queries

DATA = "/root/testdata/sf0.001"


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def copied_joins(df) -> list[str]:
    return [line for line in final_plan(df).splitlines() if "Join" in line and "salt" in line]


def test_copies_of_queries_are_not_broadcast(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(rng.choices("abcdefgh", k=9)), [rng.gauss(0, 1) for _ in range(4)]) for i in range(200)], "id long, text string, embedding array<double>")
    words = inverted.visited(docs.select(F.col("id").alias("query_id"), F.col("text").alias("query")), inverted.build(docs), 3)
    models = cells.fit(docs)
    near = cells.visited(docs.select(F.col("id").alias("query_id"), "embedding"), cells.build(docs, models=models), 3, models)
    joins = copied_joins(near)
    assert joins and not any("Broadcast" in j for j in joins)
    assert not any("Broadcast" in j for j in copied_joins(words))
    assert "collect_list" not in final_plan(words)  # ranges and queries stream past, one at a time


def test_pages_are_parsed_once_in_many_tasks(spark, tmp_path):
    part = spark.read.parquet(f"{DATA}/part.parquet").coalesce(1)
    part.write.parquet(f"{tmp_path}/part.parquet")
    for name in ("enriched_products", "described_products", "page_faqs"):
        plan = final_plan(queries.QUERIES[name](spark, str(tmp_path)))
        assert plan.count("ArrowEvalPython") == 1, name
        below = plan[plan.index("ArrowEvalPython") :]
        assert "REPARTITION_BY_NUM" in below, name


def test_headings_with_references_as_in_sql(spark, tmp_path):
    pages = [(1, "u1", "<h1>a &amp; b&amp</h1>"), (2, "u2", "<h1>x = &quot;0&quot; &lt;i&gt;</h1>"), (3, "u3", "<h1> &eacute;&#39;&amp;lt; </h1>"), (4, "u4", "<p>no</p>"), (5, "u5", "<h1> </h1>"), (6, "u6", "<h1>a & b &amp;amp;\n c</h1>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = queries.h1_backfill(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(queries.SQL["h1_backfill"]).fetchall())


def test_ids_of_a_series_are_joined_once_for_each_name(spark):
    plan = final_plan(queries.series_expand(spark, DATA))
    assert "array_join" not in plan[: plan.index("Join ")]  # nothing above a join works on a query's ids


def test_texts_are_shuffled_not_postings(spark):
    plan = final_plan(lexical.postings(spark.createDataFrame([(1, "a b a"), (2, "b"), (1, "a c")], "id long, text string")))
    assert plan.count("Exchange") == 1 and "hashpartitioning(id#" in plan


def test_all_documents_and_vectors_are_asked_and_found(spark, tmp_path):
    rng = random.Random(7)
    spark.createDataFrame([(i, " ".join(f"w{rng.randrange(200)}" for _ in range(9))) for i in range(40, 260)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in [*range(110), 400, 401]], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    got = queries.rrf_fusion(spark, str(tmp_path)).collect()
    assert {r.query_id for r in got} == {0, 50, 100, 150, 200, 250, 400}  # some have a vector only, some a text only
    assert {r.id for r in got} & {401, 400, 0} and sorted(map(tuple, got)) == sorted(con.sql(queries.SQL["rrf_fusion"]).fetchall())


def test_few_rows_of_an_index_are_held_at_a_time(spark, monkeypatch):
    kept, write = [], lexical.written
    monkeypatch.setattr(lexical, "written", lambda *a: kept.append(write(*a)) or kept[-1])
    docs = spark.range(40_000).select("id", F.concat_ws(" ", F.lit("a"), F.concat(F.lit("b"), "id")).alias("text"))
    assert [r.id for r in lexical.bm25(spark.createDataFrame([(1, "b7")], "query_id long, query string"), docs, 3).collect()] == [7]
    groups = [f.metadata.row_group(i).num_rows for p in kept[0].inputFiles() for f in [pq.ParquetFile(p.removeprefix("file://"))] for i in range(f.num_row_groups)]
    assert sum(groups) > 20 and max(groups) <= 2


def test_ids_stand_in_no_sort_of_queries(spark):
    """Lists of ids are joined last, a copy for some queries each, so they aren't carried with every query through a shuffle or a sort."""
    products = spark.createDataFrame([(f"p{i}", f"abc {i % 3}", i) for i in range(60)], "pid string, name string, ord long")
    bases = routing.base_to_ids(products)
    asks = spark.createDataFrame([(i, ["giá abc 1", "dòng abc 2", "abc"][i % 3]) for i in range(90)], "query_id long, query string")
    matched = routing.longest_match(asks, bases)
    tree = routing.series_ids(matched, bases)._jdf.queryExecution().optimizedPlan().toString()
    assert tree.count("Join ") == 1 and "part#" in tree.split("Join ")[1].splitlines()[0]
    want = {i: sorted(f"p{j}" for j in range(60) if j % 3 == 1 + i % 3) for i in range(90) if i % 3 < 2}
    assert {r.query_id: r.pids for r in routing.series_ids(matched, bases, copies=8).collect()} == want
