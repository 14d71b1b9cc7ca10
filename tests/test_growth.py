"""Queries whose work must follow the distinct rows and the result, not the pairs of rows."""

from brinework.operators import bibliography, joins
from brinework.plans import bibliography as references
from brinework.plans import registry
from brinework.plans.catalog import Tables


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def inner(node):
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return [node.executedPlan()]
    if kind.endswith("QueryStageExec"):
        return [node.plan()]
    children = node.children()
    return [children.apply(i) for i in range(children.size())]


def count_of(node):
    """Rows that a step handed on, as it or the nearest step below says."""
    for name in ("numOutputRows", "shuffleRecordsWritten"):
        metric = node.metrics().get(name)
        if metric.isDefined():
            return metric.get().value()
    return max((count_of(x) for x in inner(node)), default=0)


def run(df, condition="none"):
    """The result, the most rows that a step of its plan handed on, and the most pairs that a join with such a condition can compare."""
    found, most, pairs = rows(df), 0, 0
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        below = inner(node)
        most = max(most, count_of(node))
        if len(below) == 2 and "Join" in node.getClass().getSimpleName() and condition in node.verboseString(1000):
            pairs = max(pairs, count_of(below[0]) * count_of(below[1]))
        todo += below
    return found, most, pairs


def test_titles_of_equal_stems_meet_once(spark, tables):
    """twentieth titles don't meet every copy of a title; the asking one is not its own neighbour."""
    path = tables(part=[{"p_partkey": k, "p_name": "cold plate" if k % 3 else "plate cold", "p_type": "LARGE"} for k in range(1, 2001)])
    found, most, _ = run(registry.queries()["literature_resolution"](spark, path))
    assert found == sorted((a, b, 3, 1.0) for a in range(20, 2001, 20) for b in (1, 2, 3)) and most <= 2000


def test_an_asking_title_among_the_least(spark, tables):
    path = tables(part=[{"p_partkey": k, "p_name": name, "p_type": "LARGE"} for k, name in ((0, "cold plate"), (1, "cold plate"), (2, "hot plate"), (3, "cold plate"), (4, "hot plate"), (5, "cold plate"))])
    assert rows(registry.queries()["literature_resolution"](spark, path)) == [(0, 1, 3, 1.0), (0, 3, 3, 1.0), (0, 5, 3, 1.0)]


def test_best_pairs_without_pairs(spark, tables):
    """the best of both sides is found without a pair of every part and supplier; keys beyond the modulus tie."""
    keys = [*range(300), *range(9973, 10073), *range(19946, 19996)]
    parts, suppliers = [{"p_partkey": k, "p_size": k % 7} for k in keys], [{"s_suppkey": 3 * k, "s_nationkey": k % 25} for k in keys]
    found, most, _ = run(registry.queries()["mutual_best_all"](spark, tables(part=parts, supplier=suppliers)))
    pairs = [(p["p_partkey"], s["s_suppkey"], (p["p_partkey"] * 7919 + s["s_suppkey"] * 104729) % 9973) for p in parts for s in suppliers if p["p_size"] % 5 == s["s_nationkey"] % 5]
    of_a, of_b = ({x: max(p[2] for p in pairs if p[side] == x) for x in {p[side] for p in pairs}} for side in (0, 1))
    assert found == sorted(p for p in pairs if p[2] == of_a[p[0]] == of_b[p[1]]) and most < 2000


def test_distances_of_distinct_names(spark, tables):
    """a distance is taken once for each two names of a block, however many rows have them."""
    names = ["cold plate", "cold plates", "zebra"]
    path = tables(part=[{"p_partkey": k, "p_name": names[k % 3], "p_brand": "Brand#1", "p_size": 7} for k in range(150)])
    found, _, pairs = run(registry.queries()["fuzzy_name_match"](spark, path), "levenshtein")
    alike = lambda a, b: 1.0 if a % 3 == b % 3 else 0.909091 if 2 not in (a % 3, b % 3) else None
    assert found == [(a, b, alike(a, b)) for a in range(150) for b in range(a + 1, 150) if alike(a, b)] and 0 < pairs <= 9


def test_distinct_boxes_are_compared(spark, tables, monkeypatch):
    """boxes of one place and size are compared once, whatever their number, and their keys stand in bounded lists."""
    parts = [{"p_partkey": 600 * k + 50 * (k % 2), "p_size": 1 + 30 * (k % 3 == 0)} for k in range(120)]
    box = {p["p_partkey"]: (k % 40, k % 30, k % 40 + s, k % 30 + s / 2) for p in parts for k, s in [(p["p_partkey"], p["p_size"])]}
    want = sorted((a, b) for a, x in box.items() for b, y in box.items() if a != b and x[0] <= y[0] and x[1] <= y[1] and x[2] >= y[2] and x[3] >= y[3])
    path = tables(part=parts)
    found, _, pairs = run(registry.queries()["boxes_within"](spark, path), "ax0#")
    assert found == want and 0 < pairs <= 4 * 4 * 16
    monkeypatch.setattr(joins, "MEMBERS", 7)
    assert rows(registry.queries()["boxes_within"](spark, path)) == want


def test_works_are_never_broadcast(spark, tables):
    """a small file of works may make a large table, which must not pass through the driver."""
    works = references._works(Tables(spark, tables(part=[{"p_partkey": k, "p_name": "cold plate", "p_brand": "Brand#1", "p_type": "LARGE"} for k in range(60)])))
    found = bibliography.matches(works.withColumnRenamed("work_id", "entry_id"), works)
    assert found.count() > 0 and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_an_entry_of_several_texts(spark):
    """a match that two texts of an entry make counts once; rivals count over all of its texts."""
    found = spark.createDataFrame([(1, 7, "DOI", 1.0, 3), (2, 7, "DOI", 1.0, 3), (2, 8, "FUZZY", 0.9, 1), (3, 9, "DOI", 1.0, 3)], "text_id long, work_id long, method string, score double, level int")
    texts = spark.createDataFrame([(10, 1), (10, 2), (11, 1), (11, 3), (12, 3)], "entry_id long, text_id long")
    assert rows(bibliography.of_entries(found, texts)) == [(10, 7, "DOI", 1.0, 3), (10, 8, "FUZZY", 0.9, 1), (11, 7, "DOI", 1.0, 3), (11, 9, "DOI", 1.0, 3), (12, 9, "DOI", 1.0, 3)]
    assert [r[:2] + r[4:] for r in rows(bibliography.settled(found, texts))] == [(10, 7, 3), (10, 8, 1), (11, 7, 1), (11, 9, 1), (12, 9, 3)]
