"""Settings, services, retries, pages of the web, evaluation and commands, all offline."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kelpie import __main__ as commands
from kelpie import config, providers
from kelpie.functions import chunking
from kelpie.operators import lexical, search
from kelpie.plans import chat, evaluation, retrieve, stages
from kelpie.sources import files, html, shop, web
from kelpie.streaming import answers

PRODUCTS = [{"id": f"p-{i}", "name": f"Fon {i} 128GB", "url": f"https://x.vn/p-{i}.html", "specs": {"Chipset": f"A{i}"}, "variants": [{"color": "Đỏ", "price": f"{i}₫", "stock": "Còn hàng"}], "description": f"Máy Fon {i} rất tốt."} for i in range(10, 14)]
POLICIES = [{"section_index": 1, "title": "Bảo hành", "content": "Giới thiệu về bảo hành\n1. Bảo hành mười hai tháng cho mọi máy, kể từ ngày mua, với hóa đơn và hộp máy đầy đủ."}]


@pytest.fixture(scope="module")
def index_path(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("shop")
    (path / "products.json").write_text(json.dumps(PRODUCTS, ensure_ascii=False))
    (path / "policies.json").write_text(json.dumps(POLICIES, ensure_ascii=False))
    said = commands.main(["build", "--products", f"{path}/products.json", "--policies", f"{path}/policies.json", "--out", f"{path}/out"], spark)
    assert said.endswith("all stages done") and said.count("\n") == 3
    return str(path / "out")


def test_settings(spark, tmp_path, monkeypatch):
    monkeypatch.delenv("KELPIE_API_KEY", raising=False)
    (tmp_path / "env").write_text("# a comment\n\nexport KELPIE_API_KEY='k1'\nOTHER = x\n")
    assert config.load_env(str(tmp_path / "env")) == {"KELPIE_API_KEY": "k1", "OTHER": "x"} and config.load_env(str(tmp_path / "none")) == {}
    assert config.setting("api_key", spark, str(tmp_path / "none")) is None
    assert config.setting("api_key", spark, str(tmp_path / "env")) == "k1"
    monkeypatch.setenv("KELPIE_API_KEY", "k2")
    assert config.setting("api_key", spark, str(tmp_path / "env")) == "k2"
    spark.conf.set("kelpie.api_key", "k3")
    assert config.setting("api_key", spark, str(tmp_path / "env")) == "k3"
    spark.conf.unset("kelpie.api_key")


def test_retry():
    waits: list[float] = []

    def failing(*errors):
        left = list(errors)

        def call():
            if left:
                raise left.pop(0)
            return "done"

        return call

    many = providers.TooMany
    run = lambda call, wait, also=(): (providers.retry(call, wait, also=also, sleep=waits.append), waits.copy(), waits.clear())[:2]
    assert run(failing(many(), many()), providers.PLANNER_WAIT) == ("done", [3.0, 5.0])
    assert run(failing(many(), many(), many()), providers.GENERATOR_WAIT) == (None, [3.0, 6.0])
    assert run(failing(ValueError()), providers.PLANNER_WAIT) == (None, [])
    judge = (providers.Refused, providers.Late)
    assert run(failing(many(7.0), many()), providers.JUDGE_WAIT, judge) == ("done", [7.0, 10.0])
    assert run(failing(providers.Refused(), providers.Late()), providers.JUDGE_WAIT, judge) == ("done", [3.0, 4.0])
    assert providers.patient(lambda q, c: failing(many(), many(), many())(), sleep=waits.append)("q", "c") in ("done", providers.BUSY)


def test_service():
    sent = []

    def post(url, headers, body, timeout):
        sent.append((url, headers["Authorization"], json.loads(body), timeout))
        return json.dumps({"choices": [{"message": {"content": "hi"}}]}).encode()

    assert providers.Service("u", "k", "m", 12, 0.3, post).ask("p", "s", as_json=False) == "hi"
    assert sent == [("u", "Bearer k", {"model": "m", "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "p"}], "temperature": 0.3}, 12)]
    providers.Service("u", "k", "m", post=post).ask("p")
    assert sent[1][2]["response_format"] == {"type": "json_object"}


def test_configured(spark, tmp_path, monkeypatch):
    for name in ("KEY", "URL", "MODEL"):
        monkeypatch.delenv(f"KELPIE_API_{name}", raising=False)
    assert providers.configured(spark, str(tmp_path / "none")).planner is providers.identity_plan
    (tmp_path / "env").write_text("KELPIE_API_KEY=k\n")
    with pytest.raises(ValueError):
        providers.configured(spark, str(tmp_path / "env"))
    (tmp_path / "env").write_text("KELPIE_API_KEY=k\nKELPIE_API_URL=u\nKELPIE_API_MODEL=m\n")
    post = lambda url, headers, body, timeout: json.dumps({"choices": [{"message": {"content": "the answer"}}]}).encode()
    assert providers.configured(spark, str(tmp_path / "env"), post).generator("q", "c") == "the answer"


def test_plans(spark):
    q = spark.createDataFrame([(1, "giá ip 15 pm"), (2, "two parts"), (3, "broken")], "query_id int, query string")
    assert providers.spelled_plan(q).orderBy("query_id").first().plan.cleaned_query == "giá iPhone 15 Pro Max"

    def ask(text):
        if text == "two parts":
            return json.dumps({"cleaned_query": "two", "need_decomposition": True, "sub_queries": ["a", "b"]})
        if text == "broken":
            raise ValueError("down")
        return "no json"

    got = {r.query_id: r.plan for r in providers.service_plan(ask)(q).collect()}
    assert got[2].sub_queries == ["a", "b"] and got[1].sub_queries == ["giá ip 15 pm"] and got[3].cleaned_query == "broken" and not got[3].need_decomposition


def test_judges(spark):
    rows = spark.createDataFrame([(1, "One is two. Three is four.", ["one is two"]), (2, "", ["x"]), (3, None, None), (4, "Lost.", ["y"])], "id int, answer string, contexts array<string>")
    off = {r.id: r.score for r in evaluation.faithfulness(rows).collect()}
    assert off == {1: 0.5, 2: 1.0, 3: 1.0, 4: 0.0}

    def ask(prompt):
        if "Split" in prompt:
            return json.dumps({"statements": ["s1", "s2"] if "One" in prompt else ["lost"] if "Lost" in prompt else []})
        return json.dumps({"verifications": [{"statement": "s1", "supported": True, "reason": "r"}, {"statement": "s2", "supported": "yes"}]}) if "s1" in prompt else "no json"

    got = {r.id: r for r in evaluation.faithfulness(rows, providers.service_judge(ask, sleep=lambda s: None)).collect()}
    assert {i: r.score for i, r in got.items()} == {1: 0.5, 2: 1.0, 3: 1.0, 4: None}
    assert [(v.statement, v.supported, v.reason) for v in got[1].verifications] == [("s1", True, "r"), ("s2", False, "")]


def test_golden_questions(spark):
    rows = evaluation.golden(spark, [{"query": "a", "expected_product_id": "p-1", "expected_type": "faq"}, {"query": "b", "expected_product_id": ["p-2", "N/A"], "expected_type": ["policy"]}, {"query": "c", "expected_product_id": "p-9", "expected_type": "faq"}])
    results = spark.createDataFrame([(0, 1, "p-1-pro", "specs"), (0, 2, "p-1", "faq"), (1, 1, None, "policy"), (1, 9, "p-2", "policy")], "query_id int, rank int, product_id string, type string")
    for each in (False, True):
        by, total = evaluation.evaluate_retrieval(rows, lambda q, n: results.join(q.select("query_id"), "query_id"), each=each)
        got = {r.query_id: (r.hit, r.rr) for r in by.collect()}
        assert got == {0: (1, 0.5), 1: (1, 1.0), 2: (0, 0.0)}
        r = total.first()
        assert (r.queries, r.k) == (3, 3) and abs(r.hit_rate - 200 / 3) < 1e-9 and abs(r.mrr - 0.5) < 1e-9 and r.latency > 0
        assert "66.67%" in evaluation.report(total)


def test_evaluation_end_to_end(spark, index_path, tmp_path):
    golden = [{"query": "giá Fon 12 màu đỏ", "expected_product_id": "p-12", "expected_type": "variants"}, {"query": "chính sách bảo hành", "expected_product_id": "N/A", "expected_type": "policy"}]
    (tmp_path / "golden.json").write_text(json.dumps(golden))
    assert "hit rate @ 3  100.00%" in commands.main(["evaluate", "--index", f"{index_path}/index", "--golden", f"{tmp_path}/golden.json"], spark)


def test_commands(spark, index_path):
    assert json.loads(commands.main(["health", "--index", f"{index_path}/index"], spark)) == {"status": "healthy", "policy_chunks": 2, "product_chunks": 12, "models": {}}
    assert json.loads(commands.main(["health", "--index", f"{index_path}/none"], spark))["product_chunks"] == 0
    empty = chat.chat(spark, "giá Fon 12", retrieve.open_index(spark, f"{index_path}/none"))
    assert empty["sources"] == []


def test_json_array(spark, index_path, tmp_path):
    whole = lambda path: json.loads("".join(p.read_text(encoding="utf-8") for p in sorted(Path(path).glob("part-*"))))
    chunks = whole(f"{index_path}/product_chunks")
    assert [c["chunk_id"] for c in chunks] == [f"chunk_{i:04d}" for i in range(1, 13)]
    again = files.read_json(spark, f"{index_path}/product_chunks", "chunk_id string, product_id string, text string")
    assert again.count() == 12
    shop.write_json_array(spark.createDataFrame([], "a int"), f"{tmp_path}/none")
    assert whole(f"{tmp_path}/none") == []


def test_metadata(spark, index_path):
    find = lambda **x: {r.id for r in files.read_index(spark, f"{index_path}/index", **x).collect()}
    both = {"$and": [{"type": "specs"}, {"product_id": {"$in": ["p-10", "p-11"]}}]}
    assert len(find(where=both)) == 2 and find(where=both) == find(where="type = 'specs' and product_id in ('p-10', 'p-11')")
    assert find(collection="policy_collection", where={"type": "policy"}) == {"policy_chunk_001", "policy_chunk_002"}
    with pytest.raises(ValueError):
        files.matching({"a": {"$gt": 1}})
    df = spark.sql("select named_struct('a', 1, 'b', array(1, 2), 'c', cast(null as string), 'd', date'2020-01-02', 'e', true) as metadata")
    assert files.flat_metadata(df).first().metadata.asDict() == {"a": 1, "b": "[1,2]", "c": None, "d": "2020-01-02", "e": True}


def test_url_lines(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("https://x.vn/a.html\n\n  https://x.vn/b.html?q=1 \n")
    assert [(r.id, r.name, r.url) for r in files.read_urls(spark, f"{tmp_path}/urls.txt").orderBy("ord").collect()] == [("a", None, "https://x.vn/a.html"), ("b", None, "https://x.vn/b.html?q=1")]


def _link(n):
    return f'<a class="product__link" href="/f-{n}.html"><h3 class="product__name"> F {n} </h3></a>'


def test_listing_and_pages(spark):
    def fetch(url, pressed):
        more = "" if pressed == 2 else '<a class="button__show-more-product">more</a>'
        return "".join(map(_link, range(2 + pressed))) + '<a class="product__link">no target</a>' + more

    got = sorted((r.id, r.name, r.url) for r in web.listing(spark, "https://x.vn/all.html", fetch).collect())
    assert got == [(f"f-{n}", f"F {n}", f"https://x.vn/f-{n}.html") for n in range(4)]

    def page(url, pressed):
        if url.endswith("f-1.html"):
            raise OSError("gone")
        spec = '<section class="technical-content-section"><p class="title">t</p><table class="technical-content"><tr class="technical-content-item"><td>RAM</td><td>8</td></tr></table></section>'
        return f'{spec}<a class="button__change-color"><b class="item-variant-name">Đỏ</b><i class="item-variant-price">1</i></a><div class="ksp-content">mô tả</div><div class="accordion-item"><p class="accordion-label">q</p><p class="accordion-content">a</p></div>'

    products = spark.createDataFrame([(n, f"f-{n}", f"F {n}", f"https://x.vn/f-{n}.html") for n in range(3)], "ord int, id string, name string, url string")
    full, faqs = web.crawled(products, page)
    assert {r.id for r in full.collect()} == {"f-0", "f-2"} and {r.id: r.faq for r in faqs.collect()} == {"f-0": {"q": "a"}, "f-2": {"q": "a"}}
    failed = web.pages(products.select("url"), page).where("html is null").collect()
    assert [(r.url, r.error) for r in failed] == [("https://x.vn/f-1.html", "OSError: gone")]


def test_policy_pages(spark):
    page = '<li class="warranty-options-item">One</li><li class="warranty-options-item">Two</li><div class="warranty-content">A–​b<table><tr><td>x</td><td>y</td></tr></table></div>'
    got = [(r.section_index, r.title, r.content) for r in html.policies(spark.createDataFrame([(page,)], "html string")).orderBy("section_index").collect()]
    assert got[0][:2] == (1, "One") and got[0][2].startswith("A-b") and "| x | y |" in got[0][2] and got[1] == (2, "Two", "")


def test_stages(spark):
    def broken():
        raise ValueError("no")

    rows = stages.run(spark, [("a", broken), ("b", lambda: None)])
    assert [(r.stage, r.ok, r.error) for r in rows.collect()] == [("a", False, "ValueError: no"), ("b", True, None)]
    assert stages.summary(rows).endswith("done with errors")


def test_numbers_of_many_rows(spark):
    rows = spark.range(2000).select((F.col("id") * 7919 % 2003).alias("k"))
    got = sorted((r.k, r.n) for r in chunking.ranked(rows, ["k"]).collect())
    assert [n for _, n in got] == list(range(1, 2001))


def test_own_tokenizer(spark):
    corpus = spark.createDataFrame([("a", "New York city"), ("b", "york new"), ("c", "other words here")], "id string, text string")
    q = spark.createDataFrame([(1, "new york")], "query_id int, query string")
    joined = lambda c: F.split(F.replace(F.lower(c), F.lit("new york"), F.lit("new_york")), " ")
    assert [r.id for r in lexical.bm25(q, corpus, 5).orderBy("rank").collect()] == ["b", "a"]
    assert [r.id for r in lexical.bm25(q, corpus, 5, tokenizer=joined).collect()] == ["a"]
    assert lexical.bm25(q.limit(0), corpus, 5).count() == 0 and lexical.bm25(q, corpus.limit(0), 5).count() == 0


def test_hybrid_scopes_and_ties(spark):
    corpus = spark.createDataFrame([(i, "same text", [1.0, 0.0] if i < 4 else None, "s" if i % 2 else "t") for i in range(6)] + [(9, None, [0.0, 0.0], "s"), (10, "", [1.0, float("nan")], "s"), (11, "", [1.0], "s")], "id int, text string, embedding array<float>, place string")
    q = spark.createDataFrame([(1, "same", [2.0, 0.0], "s")], "query_id int, query string, embedding array<float>, place string")
    got = search.hybrid(q.withColumnRenamed("place", "scope"), corpus.withColumnRenamed("place", "scope"), 5, "scope").orderBy("rank").collect()
    assert {r.id for r in got if r.vrank} == {1, 3} and [r.vrank for r in got if r.id == 1] == [1]


def test_answer_stream(spark, index_path, tmp_path):
    schema = "query_id int, query string"
    spark.createDataFrame([(1, "giá Fon 12 màu đỏ")], schema).write.json(f"{tmp_path}/in")
    stream = answers.answer_stream(spark.readStream.schema(schema).json(f"{tmp_path}/in"), retrieve.open_index(spark, f"{index_path}/index"), f"{tmp_path}/out", f"{tmp_path}/check", 2)
    stream.awaitTermination(120)
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert rows and all("Fon 12" in r.text for r in rows)
