import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kelpie.functions import chunking, tables
from kelpie.functions import text as T
from kelpie.operators import evaluate, fusion
from kelpie.sources import files, html


def one(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)).select(expr.alias("x")).first().x


def test_scalars(spark):
    name = lambda s: one(spark, T.base_name(F.col("a")), a=s)
    assert name("Điện thoại iPhone 14 Pro Max 256GB | Chính hãng VN/A") == "iPhone 14 Pro Max"
    assert name("IPHONE 13 128GB") == ""
    assert one(spark, T.url_id(F.col("a")), a="https://x.vn/iphone-13-256gb.html?a=1") == "iphone-13-256gb"
    assert one(spark, T.normalize(F.col("a")), a="a–b​“") == 'a-b"'
    assert one(spark, T.clean_lines(F.col("a")), a=" x \n\n \n y") == "x\ny"
    assert one(spark, T.without_ad_tail(F.col("a"), "Shop"), a="ok\nmua X giá rẻ tại shop nay\nz") == "ok\n\nz"
    assert one(spark, T.is_junk(F.col("a"), F.col("b")), a="PHẦN I", b="PHẦN I")
    assert one(spark, T.answer_html(F.col("a")), a="**b** <i>\n- x") == "<strong>b</strong> &lt;i&gt;<br>• x"


def test_urls(spark):
    from urllib.parse import urljoin

    base = "https://x.vn/a/b.html?q=1"
    for href in ("/c", "c", "?z=1", "//y.vn/d", "https://z.vn/e"):
        assert one(spark, T.resolve_url(base, F.col("a")), a=href) == urljoin(base, href)


def test_tables():
    assert tables.tabs_to_tables("A\tB\n1\t2\n- x") == "\n| A | B |\n| --- | --- |\n| 1 | 2<br>- x |\n"
    assert tables.tabs_to_tables("a\tb\n\nc") == "\n| a | b |\n| --- | --- |\n\n\nc"
    assert tables.tabs_to_tables("no\n- tab") == "no\n- tab"


def test_policy_split(spark):
    x = one(spark, chunking.policy_pieces(F.col("a")), a="T\n1. a\nb\n12 c")
    assert [(r.sub_title, r.text) for r in x] == [("Giới thiệu chung", "T"), ("1. a", "1. a\nb\n12 c")]


def test_paragraphs():
    assert chunking.split_paragraphs("a" * 500 + "\n" + "b" * 100 + "\n" + "c" * 300) == ["a" * 500 + "\n" + "b" * 100, "b" * 100 + "\n" + "c" * 300]
    assert chunking.split_paragraphs("x. " * 300)[0].startswith("x. x.")


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=3000))
def test_paragraphs_lose_nothing(text):
    got = "".join(chunking.split_paragraphs(text, 60, 10)).replace(" ", "").replace("\n", "")
    want = text.replace(" ", "").replace("\n", "")
    assert len(got) >= len(want) and set(got) >= set(want)


def test_fusion_and_cap(spark):
    v = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, id string, rank int")
    b = spark.createDataFrame([(1, "a", 1), (1, "c", 2)], "query_id int, id string, rank int")
    r = fusion.rrf(v, b, 10).orderBy("rank").collect()
    assert [x.id for x in r] == ["a", "b", "c"] and math.isclose(r[0].rrf_score, 2 / 61)
    pool = spark.createDataFrame([(1, i, "description" if i < 6 else "faq") for i in range(8)], "query_id int, pool_pos int, type string")
    assert sorted(x.pool_pos for x in fusion.capped(pool, F.col("type"), ["query_id"], ["pool_pos"]).collect()) == [0, 1, 2, 3, 6, 7]


def test_evaluation(spark):
    ranked = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 0), (2, 1, 0)], "query_id int, rank int, rel int")
    m = {r.query_id: r for r in evaluate.query_metrics(ranked).collect()}
    assert math.isclose(m[1].dcg, 1 + 3 / math.log2(3)) and abs(m[1].ndcg - 0.7967) < 1e-4 and m[1].rr == 0.5
    assert m[2].ndcg == 0 and m[2].hit == 0
    assert spark.range(1).select(evaluate.product_matches(F.array(F.lit("iphone-13")), F.lit("iphone-13-pro-max"))).first()[0]
    f = lambda s, v: spark.range(1).select(evaluate.faithfulness(F.expr(s), F.expr(v)).alias("x")).first().x
    some = "array(named_struct('supported', true), named_struct('supported', false))"
    assert f("array('a', 'b')", some) == 0.5
    assert f("cast(array() as array<string>)", some) == 1.0
    assert f("array('a')", "cast(array() as array<struct<supported:boolean>>)") is None


def test_shop_pages():
    page = """<section class="technical-content-section"><p class="title">t</p><table class="technical-content"><tr class="technical-content-item"><td> Chip </td><td>A16</td></tr><tr class="technical-content-item"><td></td><td>x</td></tr></table></section>
    <a class="button__change-color"><b class="item-variant-name">Đỏ</b><i class="item-variant-price">1₫</i></a><div id="cpsContent">mô tả</div>
    <div class="accordion-item"><p class="accordion-label">Q</p><p class="accordion-content">A</p></div><h1> Tên </h1>"""
    root = html.tree(page)
    assert html.specs(root) == [{"key": "Chip", "value": "A16"}]
    assert html.variants(root) == [{"color": "Đỏ", "price": "1₫", "stock": "Còn hàng"}]
    assert (html.description(root), html.faq(root), html.heading(root)) == ("mô tả", [{"key": "Q", "value": "A"}], "Tên")


def test_files(spark, tmp_path):
    assert files.read_json(spark, str(tmp_path / "none.json"), "id string").count() == 0
    (tmp_path / "a.json").write_text('[{"id": "1"}, {"id": "2"}]')
    assert [r.id for r in files.read_json(spark, str(tmp_path / "a.json"), "id string").orderBy("ord").collect()] == ["1", "2"]
    (tmp_path / "b.json").write_text("{broken")
    assert files.read_json(spark, str(tmp_path / "b.json"), "id string", tolerant=True).count() == 0
    assert files.read_index(spark, str(tmp_path / "no")) is None
    assert {r.collection: r.n for r in files.counts(spark, str(tmp_path / "no")).collect()} == {"policy_collection": 0, "product_collection": 0}


def test_optional_end_tags():
    page = '<section class="technical-content-section"><p class="title">T<table class="technical-content"><tr class="technical-content-item"><td>A<td>1<tr class="technical-content-item"><td>B<td>2</table></section>'
    assert html.specs(html.tree(page)) == [{"key": "A", "value": "1"}, {"key": "B", "value": "2"}]
    text = lambda p: html.tree(p).text()
    assert text("<ul><li>a<ul><li>b<li>c</ul><li>d</ul><dl><dt>q<dd>r<dt>s</dl><p>x<div>y</div>z") == "a\nb\nc\nd\nq\nr\ns\nx\ny\nz"
    assert text("<table><tr><td>a<td>b<tr><td>c<table><tr><td>in</table>after<td>d</table>tail") == "a\tb\nc\nin\nafter\td\ntail"
    items = list(html.tree("<ul><li>a<p>b<li>c<ul><li>d</ul></ul><li>e").find(tag="li"))
    assert [i.text() for i in items] == ["a\nb", "c\nd", "d", "e"]
    rows = list(html.tree("<table><thead><tr><th>h<tbody><tr><td>1<tr><td>2<tfoot><tr><td>3</table>").find(tag="tr"))
    assert [r.text() for r in rows] == ["h", "1", "2", "3"]
    assert [o.text() for o in html.tree("<select><option>a<option>b<optgroup><option>c</select>d").find(tag="option")] == ["a", "b", "c"]
    assert [a.text() for a in html.tree("<a>x<p>y</a>z<a>v<a>w</a><div><a>u</div>t").find(tag="a")] == ["x\ny", "v", "w", "u"]
    assert html.tree("<td>x</div>y</td></table></p>z").text() == "xy\tz"
    assert [p.text() for p in html.tree("<p>a<p>b<button><p>c</button>d</p>e").find(tag="p")] == ["a", "b\nc\nd", "c"]


def test_finding_is_by_place():
    root = html.tree('<div class="a b" id="i"><p class="a">x</p><div class="b">y<p class="a c">z</p></div></div><p class="a">w')
    assert [n.text() for n in root.find(cls="a")] == ["x\ny\nz", "x", "z", "w"]
    assert [n.text() for n in root.first(id_="i").find(tag="p")] == ["x", "z"]
    assert [n.text() for n in root.first(cls="b").find(cls="b")] == ["y\nz"] and root.first(tag="p", cls="c").text() == "z"
    assert root.first(tag="q") is None and html.tree(None).text() == "" and list(html.tree("").find(tag="a")) == []


def test_deep_pages():
    """Elements without end tags, and 100,000 nested ones, take time in proportion; no reader recurses."""
    import time

    for page in ("<p>a" * 1200, "<li>x" * 1200, "<tr><td>a<td>b" * 600, "<div>" * 100_000 + "x", "<ul><li>" * 30_000 + "z", "<b><i>t" * 30_000):
        began = time.process_time()
        root = html.tree(page)
        for name, read in html.READERS.items():
            read(root), name
        assert len(root.text().replace("\n", "").replace("\t", "")) == len("".join(c for c in page.replace("<", " <").replace(">", "> ").split() if not c.startswith("<") for c in c))
        assert time.process_time() - began < 8
