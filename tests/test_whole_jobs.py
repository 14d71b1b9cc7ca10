"""Cases that a query over a part of its input, or of its candidates, would miss."""

from datetime import datetime
from random import Random

from brinework.operators import duplicates
from brinework.plans import registry


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_duplicates_among_boilerplate(spark, tmp_path):
    """Near-duplicates and copies in a family of lesser ids, each about half alike by other paragraphs."""
    rng = Random(3)
    paragraph = lambda k: " ".join(f"p{k}w{i}" for i in range(12))
    form = [paragraph(k) for k in range(20)]
    texts = {i: " ".join(paragraph(f"{i}x{k}") if k in own else x for k, x in enumerate(form)) for i in range(1, 301) for own in [set(rng.sample(range(20), 7))]}
    texts |= {900: " ".join(form), 901: " ".join([*form[:-2], paragraph("b"), form[-1]]), 902: paragraph("c"), 903: paragraph("c")}
    spark.createDataFrame([(i, x) for i, x in texts.items()], "doc_id long, text string").selectExpr("*", "'s' AS source", "'ru' AS lang").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = dict(rows(registry.queries()["minhash_clusters"](spark, str(tmp_path))))
    assert found.get(901) == 900 and found.get(900) == 900 and found.get(902) == found.get(903) == 902


def test_buckets_in_cells(spark, monkeypatch):
    """A bucket cut into blocks gives each pair still."""
    monkeypatch.setattr(duplicates, "CELL", 8)
    bands = spark.range(50).selectExpr("id", "0 AS band", "1 AS key")
    sizes = spark.range(50).selectExpr("id", "if(id = 49, 100, 10) AS n")
    assert rows(duplicates.bucket_candidates(bands, sizes, "id", 0.8)) == [(a, b) for a in range(49) for b in range(a + 1, 49)]


def test_overlaps_of_late_rows(spark, tables):
    """Orders meet whatever their lines' dates."""
    lines = [(1, 5, "1995-02-01"), (2, 5, "1999-07-01"), (3, 6, "2001-01-01"), (2, 6, "2001-01-02"), (4, 7, "1995-02-01"), (2, 5, "1999-07-02")]
    path = tables(lineitem=[{"l_orderkey": o, "l_partkey": p, "l_shipdate": datetime.fromisoformat(d)} for o, p, d in lines])
    assert rows(registry.queries()["array_overlap_all"](spark, path)) == [(1, 2), (2, 3)]


def test_chains_and_best_pairs_of_all_keys(spark, tables):
    """Customers above 130 end somewhere, parts above 300 count for both sides."""
    score = lambda k: (k * 7919 + 104729) % 9973
    top = max(range(301, 400), key=score)
    path = tables(customer=[{"c_custkey": k} for k in (140, 148, 156)], part=[{"p_partkey": k, "p_size": 5} for k in (1, 2, top)], supplier=[{"s_suppkey": 1, "s_nationkey": 0}])
    assert rows(registry.queries()["merged_chain_all"](spark, path)) == [(140, 140, 0), (148, 140, 1), (156, 140, 2)]
    assert score(top) > score(1) > score(2) and rows(registry.queries()["mutual_best_all"](spark, path)) == [(top, 1, score(top))]


def test_levels_over_the_whole_side(spark, tables):
    """An even vector that isn't asked for still makes an odd one a hub."""
    vectors = {0: (1.0, 0.0), 1: (0.9, 0.9), 3: (0.8, 0.0), 2: (0.0, 1.0)}
    path = tables(embeddings=[{"vec_id": k, "embedding": [float(x) for x in v]} for k, v in vectors.items()])
    # Levels: vector 0 has 0.85; vector 1 has (0.9 + 0.9) / 2, vector 3 has (0.8 + 0) / 2.
    assert rows(registry.queries()["csls_best_all"](spark, path)) == [(0, 3, round(1.6 - 0.85 - 0.4, 6))]
