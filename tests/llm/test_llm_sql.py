"""Queries, and columns of queries, that SQL expresses, against DuckDB."""

import duckdb
import pytest

from kelpie.llm import mixing, queries

DATA = "/root/testdata/sf0.001"
#: Columns by query where SQL has no word for the others.
SOME = {
    "op4_token_counts": "select doc_id, strlen(coalesce(text, '')) as n_bytes from documents",
    "op6_media_chunks": "select doc_id, strlen(coalesce(text, '')) as n_bytes, greatest(1, (strlen(coalesce(text, '')) + 575) // 576) * 576 as payload_bytes, sha256(cast(encode(coalesce(text, '')) || repeat('\\xFF'::blob, cast(greatest(1, (strlen(coalesce(text, '')) + 575) // 576) * 576 - strlen(coalesce(text, '')) as bigint)) as blob)) as payload_sha256 from documents",
    "op13_license_scan": r"""with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
p as (select doc_id, len(w) as n_words, flatten([list_transform(list_filter(range(1, len(w) + 1), lambda i: array_to_string(w[i:i + x.more], ' ') = x.phrase), lambda i: {'at': i - 1, 'label': x.label}) for x in [{'phrase': 'gnu general public license', 'more': 3, 'label': 'gpl'}, {'phrase': 'apache license', 'more': 1, 'label': 'apache'}, {'phrase': 'cc by', 'more': 1, 'label': 'cc-by'}, {'phrase': 'mit license', 'more': 1, 'label': 'mit'}]]) as x from d)
select doc_id, n_words, len(x) as n_base, list_min(list_transform(x, lambda y: y.at)) as first_word, list_max(list_transform(x, lambda y: y.at)) as last_word, array_to_string(list_sort(list_distinct(list_transform(x, lambda y: y.label))), ',') as base_labels from p""",
    "op8_mixing": r"with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents) select doc_id, size, cast(sum(size) over (partition by source) as bigint) as source_size from d",
}


def tables():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "benchmark"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(found, cols):
    return sorted(repr([round(x, 3) if isinstance(x, float) else x for x in (r[c] for c in cols)]) for r in found)


@pytest.mark.parametrize("name", [*queries.ORACLE_SQL, *SOME])
def test_same_as_sql(spark, name):
    rel = tables().sql(queries.ORACLE_SQL.get(name) or SOME[name])
    df = queries.QUERIES[name](spark, DATA)
    assert name in SOME or sorted(rel.columns) == sorted(df.columns)
    assert rows(df.collect(), rel.columns) == rows([dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()], rel.columns)


def test_mixing_targets(spark):
    """Targets are the smaller of 3 times the source and its weight times one level, found by bisection, that makes them all words."""
    sources = sorted({r.source for r in spark.read.parquet(f"{DATA}/documents.parquet").select("source").collect()})
    for size, order in ((None, sources), ({"a": 10, "b": 1000, "c": 50, "d": 1, "e": 300}, list("abcde"))):
        if size is None:
            got = {r.source: (r.source_size, r.target) for r in queries.op8_mixing(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "source"), "doc_id").collect()}
            size = {s: got[s][0] for s in order}
            target = {s: got[s][1] for s in order}
        else:
            target = mixing.shares(list(size.items()))
        low, high = 0.0, 3.0 * sum(size.values())
        level = lambda x, size=size, order=order: {s: min(3.0 * size[s], (i % 3 + 1) * x) for i, s in enumerate(order)}
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(level(mid).values()) < sum(size.values()) else (low, mid)
        assert all(abs(target[s] - level(high)[s]) < 1e-6 * sum(size.values()) for s in order)
