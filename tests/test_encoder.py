"""The learned encoder against numpy, and its hit rate against the hashed bag."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kelpie import providers
from kelpie.operators import encoder, vector


def corpus(spark, n=300):
    """Texts of topics whose words are synonyms: two texts of a topic may share none."""
    rng = random.Random(7)
    topics = [[f"t{k}w{j}" for j in range(12)] for k in range(15)]
    rows = [(i, i % 15, " ".join(rng.choices(topics[i % 15], k=rng.randint(4, 9)))) for i in range(n)]
    return spark.createDataFrame(rows + [(9000, -1, None), (9001, -1, "")], "id long, topic int, text string"), topics, rng


def test_singular_values_against_numpy(spark):
    df, _, _ = corpus(spark)
    texts = [r.text or "" for r in df.collect()]
    text, term, w = encoder.weights(pa.array([t.split() for t in texts], pa.list_(pa.string())), 256)
    x = np.zeros((len(texts), 256))
    x[text, term] = w
    assert np.allclose((x * x).sum(1), [1.0 if t else 0.0 for t in texts])
    u, s, vt = np.linalg.svd(x)
    found = encoder.fit(df.repartition(5), 15, 256, passes=4)
    assert np.allclose(found.values[:10], s[:10], rtol=1e-3) and np.allclose(found.values, s[:15], rtol=3e-2)
    assert np.allclose(np.abs(np.diag(vt[:5] @ found.vectors[:, :5])), 1, atol=0.05)
    got = {r.id: np.array(r.e) for r in df.select("id", found.udf()("text").alias("e")).collect()}
    want = x @ found.vectors
    for i, t in enumerate(texts[:50]):
        assert np.allclose(got[i], want[i] / np.linalg.norm(want[i]), atol=1e-5), t
    assert not got[9000].any() and not got[9001].any()


def test_hit_rate(spark):
    """Questions whose words the best texts lack: the learned encoder finds their topic, the hashed bag does less often."""
    df, topics, rng = corpus(spark)
    asks = [(k, " ".join(rng.sample(words, 2))) for k, words in enumerate(topics)]
    q = spark.createDataFrame(asks, "query_id long, query string")
    rate = {}
    for name, encode in (("learned", encoder.fit(df, 15).udf()), ("hashed", providers.hashed_bag())):
        found = vector.cosine(q.select("query_id", encode("query").alias("embedding")), df.select("id", "topic", encode("text").alias("embedding")), 10)
        hits = found.join(df.select("id", "topic"), "id").select((F.col("topic") == F.col("query_id")).cast("int").alias("hit"))
        rate[name] = hits.agg(F.avg("hit")).first()[0]
    print(rate)
    assert rate["learned"] > 0.95 and rate["learned"] > rate["hashed"]
