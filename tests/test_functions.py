"""Text functions and HTML tables on small cases."""

from pyspark.sql import functions as F

from brinework.functions import text as X
from brinework.functions.common import dyadic, from_dyadic, round6
from brinework.functions.tables import cells_of, table_cells_udtf
from brinework.operators import retrieval


def one(spark, value, how):
    return spark.createDataFrame([(value,)], "t string").select(how(F.col("t")).alias("x")).first()[0]


def test_text(spark):
    assert one(spark, "прог-\nноз ﬁne​  \x07 да ", X.normalize_text) == "прогноз fine да"
    assert one(spark, "ё", X.composed) == "ё" and one(spark, None, X.composed) is None
    assert one(spark, "Ёлка-2, ОК!", X.norm_key) == one(spark, "елка 2 OK", X.norm_key)
    assert one(spark, "Один. Два! Три", X.sentences) == ["Один.", "Два!", "Три"]
    assert one(spark, "соль salt соль", X.language_majority) == "mixed"
    assert one(spark, "loadings", X.stem) == "load"
    assert one(spark, "a b c", lambda t: X.shingles(X.words(t), 2)) == ["a b", "b c"]
    assert one(spark, "a", lambda t: X.shingles(X.words(t), 2)) == [] and one(spark, "", X.words) == []
    assert one(spark, "me@x.org token=abc /home/me/f", X.redacted) == "[mail] [secret] [home]/f"


def test_rounding(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (0.3,)], "x double")
    assert df.select(round6(F.lit(0.1234565))).first()[0] == 0.123457
    sums = {df.orderBy(o).agg(from_dyadic(F.sum(dyadic(F.col("x"))))).first()[0] for o in ("x", F.desc("x"))}
    assert len(sums) == 1


def test_html(spark):
    html = "<table><tr><th rowspan=2>A<th>B</tr><tr><td>1 &lt; 2<br>x</td></tr><tr><td colspan='2'>z</table>"
    assert cells_of(html) == [(0, 0, 2, 1, True, "A"), (0, 1, 1, 1, True, "B"), (1, 1, 1, 1, False, "1 < 2\nx"), (2, 0, 1, 2, False, "z")]
    assert cells_of(None) == cells_of("") == cells_of("no table") == []
    df = spark.createDataFrame([(html,), (None,)], "html string")
    assert df.lateralJoin(table_cells_udtf()(F.col("html").outer())).count() == 4


def test_fusion_and_measures(spark):
    a = spark.createDataFrame([(1, 10, 3.0, 1), (1, 11, 2.0, 2), (1, 12, 1.0, 3)], "qid int, doc int, score double, rank int")
    b = spark.createDataFrame([(1, 12, 9.0, 1), (1, 10, 9.0, 2)], "qid int, doc int, score double, rank int")
    rrf = {r["doc"]: r["score"] for r in retrieval.rrf([(a, 1.0), (b, 1.0)]).collect()}
    assert rrf[10] == 1 / 61 + 1 / 62 and rrf[11] == 1 / 62
    flat = {r["doc"]: r["score"] for r in retrieval.normalized(b, "minmax").collect()}
    assert flat == {12: 1.0, 10: 1.0}
    mixed = {r["doc"]: r["score"] for r in retrieval.weighted_fusion([(a, 1.0), (b, 1.0)], "rank").collect()}
    assert abs(mixed[11] - (2 / 3 + 0.5)) < 1e-12
    q = spark.createDataFrame([(1, 12, 3), (1, 11, 1), (1, 99, 2), (2, 5, 1)], "qid int, doc int, grade int")
    m = retrieval.measures(a, q, 2).collect()
    assert len(m) == 1 and m[0]["recall"] == 0 and m[0]["mrr"] == 0 and m[0]["judged"] == 0.5


def test_sequences(spark):
    import random

    from brinework.functions import sequences as Q

    assert Q.longest_ordered([3, 1, 2, 2, 5, 4]) == [1, 2, 3, 5] and Q.longest_ordered([]) == []

    def every_distance(p, t):
        """Each substring against the pattern: by recursion over what becomes of their last characters."""
        from functools import cache

        @cache
        def edits(i, a, j):
            if not i or j == a:
                return max(i, j - a)
            return min(edits(i - 1, a, j - 1) + (p[i - 1] != t[j - 1]), 1 + edits(i - 1, a, j), 1 + edits(i, a, j - 1))

        return min((edits(len(p), a, j), j) for a in range(len(t) + 1) for j in range(a, len(t) + 1))

    rng = random.Random(4)
    for _ in range(60):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(0, n))) for n in (5, 9))
        assert Q.best_substring(p, t) == (every_distance(p, t) if p else (0, 0))
    assert Q.greedy_pairs([(0.9, "a", "x"), (0.8, "a", "y"), (0.8, "b", "x"), (0.5, "b", "y")]) == [("a", "x", 0.9), ("b", "y", 0.5)]
    df = spark.createDataFrame([("соль", "камсоли"), (None, "x"), ("a", None)], "p string, t string")
    assert sorted(r[0]["distance"] for r in df.select(Q.alignment(F.col("p"), F.col("t"))).collect()) == [0, 1, 1]
    assert spark.createDataFrame([([2, 1, 3],)], "v array<int>").select(Q.ordered_length(F.col("v"))).first()[0] == 2
