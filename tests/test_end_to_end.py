import pytest

from kelpie.functions import chunking
from kelpie.operators import routing
from kelpie.plans import chat, retrieve
from kelpie.sources import files

PRODUCTS = "ord int, id string, name string, url string, specs map<string,string>, variants array<struct<color:string,price:string,stock:string>>, description string"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    products = spark.createDataFrame([(i, f"p-{i}", f"Điện thoại Fon {i} 128GB", "u", {"Chipset": f"A{i}", "Pin": "4000"}, [("Đỏ", f"{i}₫", "Còn hàng")], f"Máy Fon {i} rất tốt. " * 3) for i in range(10, 14)], PRODUCTS)
    policies = spark.createDataFrame([(0, 1, "Bảo hành", "Giới thiệu về bảo hành\n1. Bảo hành mười hai tháng cho mọi máy, kể từ ngày mua, với hóa đơn và hộp máy đầy đủ.")], "ord int, section_index int, title string, content string")
    path = str(tmp_path_factory.mktemp("index"))
    files.write_index(retrieve.build(chunking.product_chunks(products), chunking.policy_chunks(policies)), path)
    return retrieve.Index(files.read_index(spark, path))


def test_retrieve(spark, index):
    q = spark.createDataFrame([(1, "giá Fon 12 màu đỏ"), (2, "chính sách bảo hành thế nào"), (3, "dòng Fon 1 pin")], "query_id int, query string")
    rows = retrieve.retrieve(q, index, 3).collect()
    assert {r.product_id for r in rows if r.query_id == 1} == {"p-12"}
    assert {r.type for r in rows if r.query_id == 2} == {"policy"}
    assert all(r.rank <= 3 for r in rows)


def test_chat(spark, index):
    out = chat.chat(spark, "giá Fon 12", index)
    assert set(out) == {"answer", "sources", "cleaned_query", "sub_queries"} and out["sources"]
    with pytest.raises(ValueError):
        chat.chat(spark, "  ", index)


def test_names(spark):
    """Short names, names inside words, equal beginnings, a series by a short name, questions without text."""
    bases = spark.createDataFrame([("X2", ["a"], 1), ("X2 Pro", ["b"], 2), ("Fon", ["c"], 3), ("Fox", ["d"], 4), ("Y", ["e"], 5)], "base string, pids array<string>, ord int")
    q = spark.createDataFrame([(1, "x2 pro max"), (2, "dòng x2"), (3, "a fox"), (4, "megafons y"), (5, ""), (6, None), (7, "zz")], "query_id int, query string")
    got = {r.query_id: r.base for r in routing.longest_match(q, bases).collect()}
    assert got == {1: "X2 Pro", 2: "X2", 3: "Fox", 4: "Fon", 5: None, 6: None, 7: None}
    ids = {r.query_id: r.pids for r in routing.series_ids(routing.longest_match(q, bases), bases).collect()}
    assert ids == {1: ["b"], 2: ["a", "b"], 3: ["d"], 4: ["c"]}
