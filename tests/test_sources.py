"""The Python data sources: listings as batch and stream, and the parallel JSON array."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kelpie.sources import files, shop


def page(n, more):
    return "".join(f'<a class="product__link" href="/p-{k}.html?x=1"><p class="product__name">P{k}</a>' for k in range(n)) + ('<a class="button__show-more-product">more</a>' if more else "")


def fetch_from(folder):
    """Pages of a listing that grows: files u-k of a folder; a press beyond the last shows the last."""

    def fetch(url, pressed):
        name = url.rsplit("/", 1)[-1]
        have = sorted(Path(folder).glob(f"{name}-*"), key=lambda p: int(p.name.rsplit("-", 1)[-1]))
        return have[min(pressed, len(have) - 1)].read_text()

    return fetch


@pytest.fixture
def shops(tmp_path):
    for name, sizes in (("a", (2, 4, 5)), ("b", (3,))):
        for k, n in enumerate(sizes):
            (tmp_path / f"{name}-{k}").write_text(page(n, k + 1 < len(sizes)))
    return tmp_path


URLS = json.dumps(["https://x.vn/a", "https://x.vn/b", "https://x.vn/a", ""])


def test_listings_as_batch(spark, shops):
    spark.dataSource.register(shop.listing_source(fetch_from(shops), "listing_batch"))
    rows = spark.read.format("listing_batch").option("urls", URLS).load()
    assert rows.rdd.getNumPartitions() == 2
    got = {(r.listing[-1], r.pressed, r.href, r.name) for r in rows.collect()}
    assert got == {("a", 0 if k < 2 else 1 if k < 4 else 2, f"/p-{k}.html?x=1", f"P{k}") for k in range(5)} | {("b", 0, f"/p-{k}.html?x=1", f"P{k}") for k in range(3)}
    assert {(r.id, r.url) for r in shop.products(rows).collect()} == {(f"p-{k}", f"https://x.vn/p-{k}.html?x=1") for k in range(5)}
    assert spark.read.format("listing_batch").load().count() == 0


def test_listings_as_stream(spark, shops, tmp_path):
    """A page that is added between two runs gives its own links only; a restart repeats none."""
    spark.dataSource.register(shop.listing_source(fetch_from(shops), "listing_stream"))
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        rows = spark.readStream.format("listing_stream").option("urls", URLS).load()
        q = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None
        return sorted((r.listing[-1], int(r.href[3:].split(".")[0])) for r in spark.read.parquet(out).collect())

    first = run()
    assert first == run() == [("a", k) for k in range(5)] + [("b", k) for k in range(3)]
    (shops / "a-2").write_text(page(5, True))
    (shops / "a-3").write_text(page(7, False))
    assert run() == [("a", k) for k in range(7)] + [("b", k) for k in range(3)]


def whole(path):
    return json.loads("".join(p.read_text() for p in sorted(Path(path).glob("part-*"))))


def test_array_by_many_tasks(spark, tmp_path):
    path = str(tmp_path / "array")
    df = spark.range(1000).repartition(7).selectExpr("id", "concat('tên \"', id, '\"\n') as name", "if(id = 3, null, id) as n")
    shop.write_json_array(df, path, ["id"])
    assert [r["id"] for r in whole(path)] == list(range(1000)) and whole(path)[3] == {"id": 3, "name": 'tên "3"\n', "n": None}
    shop.write_json_array(df, path)
    assert sorted(r["id"] for r in whole(path)) == list(range(1000)) and len(list(Path(path).glob("part-*-1.json"))) == 7 and not list(Path(path).glob("_staging*"))
    back = files.read_json_array(spark, path, "id long, name string, n long")
    assert sorted(map(tuple, back.collect()), key=lambda r: r[0]) == sorted(map(tuple, df.collect()), key=lambda r: r[0])
    shop.write_json_array(df.limit(0), path)
    assert whole(path) == [] and files.read_json_array(spark, path, "id long").count() == 0
    shop.write_json_array(df.where("id < 2").coalesce(1), path, ["id"])
    assert [r["id"] for r in whole(path)] == [0, 1]


def test_failed_task_leaves_nothing(spark, tmp_path):
    path = tmp_path / "array"
    bad = spark.range(100).repartition(4).select(F.when(F.col("id") == 57, F.raise_error(F.lit("killed"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="killed"):
        shop.write_json_array(bad, str(path))
    assert not path.exists() or not list(path.iterdir())
