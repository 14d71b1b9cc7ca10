import random

from brinework.llm import truncation as U

PARTS = ["Соляная толща", "Камерный блок", "Опорный целик", "Кривая ползучести"], ["сохраняла устойчивость", "реагировала на взрывные работы", "зависела от ширины прохода"], ["по скважинным данным", "на глубине 300 м", "за отчётный период", "без признаков расслоения"]


def text(rng, n):
    return " ".join(f"{rng.choice(PARTS[0])} {rng.choice(PARTS[1])} {rng.choice(PARTS[2])}." for _ in range(n))


def test_found(spark):
    rng = random.Random(2)
    rows, want = [], set()

    def add(source, t, cut=False):
        rows.append((len(rows), source, t))
        if cut:
            want.add(len(rows) - 1)

    for _ in range(150):
        t = text(rng, rng.randint(2, 9))
        add("plain", t)
        add("noted", t + "\n\nИсточник: архив.")
        add("listed", t + "\n\n1) целики\n2) закладка")
        long = text(rng, 12)
        cut = long[:400]
        add("limit", cut, not U.closed(U.bare(cut)))
        add("limit", t)
        where = rng.randint(60, 300)
        part = long[:where]
        add("lost", part + "\n--\nвыгрузка завершена.", not U.closed(U.bare(part)))
        add("lost", t + "\n--\nвыгрузка завершена.")
        add("marked", long[:where] + " [...]", not U.closed(U.bare(long[:where])))
    for t in (None, "", "  \n ", "я" * 200000 + "."):
        add("odd", t)
    add(None, "Без источника и без кон", True)
    add("broken", "Соляная толща сохраняла.�", True)
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "'x' AS h", "1 AS ending", "2 AS kind")
    out = U.truncated(spark, df)
    got = {r["doc_id"]: r["kind"] for r in out.collect()}
    flagged = {i for i, k in got.items() if k}
    assert len(flagged & want) >= 0.97 * len(want) and len(flagged - want) <= 0.02 * len(rows)
    at_limit = [got[i] for i, s, t in rows if s == "limit" and i in want and len(U.bare(t)) == 400]
    assert at_limit and all(k == "LIMIT" for k in at_limit)
    assert {i for i, s, _ in rows if s == "odd"} & set(got) == {max(i for i, s, _ in rows if s == "odd")}


def test_whole_fixed_length_records_are_no_cases(spark):
    rows = [(i, "forms", f"Запись номер {i:04} заполнена полностью.") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert U.truncated(spark, df).filter("kind is not null").count() == 0


def test_rules():
    assert U.bare("x. \n--\n [...] ") == "x."
    assert U.closed("Да!»") and not U.closed("Да")

    def stop(t, *endings):
        end, inside = U.stop_of(t, U.by_leading((U.leading(e), U.key_of(e)) for e in endings))
        return t[:end], inside

    assert stop("Начало. Середина без кон\n\n© Фонд 12", "© Фонд 0") == ("Начало. Середина без кон", True)
    assert stop("Начало.\n\n© Фонд 12", "© Фонд 0") == ("Начало.\n\n© Фонд 12", False)
    assert stop("Начало. Середина без кон...") == stop("Начало. Середина без кон …") == ("Начало. Середина без кон", True)
    assert stop("Всё сказано. ...") == ("Всё сказано.", False) and stop("Всё сказано!…") == ("Всё сказано!", False)
    # Any number of shared endings, of any length.
    note = "Примечание " + "о порядке хранения дел " * 20
    assert stop("Начало. Середина без кон" + f"\n{note}" * 9, note.strip()) == ("Начало. Середина без кон", True)


def test_ellipsis_at_limits(spark):
    rng = random.Random(5)
    rows, want, limit = [], set(), set()

    def add(source, t, cut, at_limit=False):
        rows.append((len(rows), source, t))
        if cut:
            want.add(len(rows) - 1)
            if at_limit:
                limit.add(len(rows) - 1)

    for _ in range(60):
        long = text(rng, 14)
        for source, core, mark in (("inside", long[:297], "..."), ("behind", long[:300], "..."), ("sign", long[:299], "…")):
            add(source, core + mark, not U.closed(U.bare(core)), True)
        whole = text(rng, rng.randint(2, 9))
        add(rng.choice(["inside", "behind", "sign"]), whole, False)
        add("talk", whole + " ...", False)
        add("talk", whole[:-1] + "!…", False)
    got = {r["doc_id"]: r["kind"] for r in U.truncated(spark, spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert {i for i, k in got.items() if k} == want
    assert all(got[i] == "LIMIT" for i in limit)


def test_one_source_in_a_corpus_of_any_size(spark):
    rng = random.Random(6)
    few = [("small", text(rng, rng.randint(2, 6)) + f"\n\nДело {i}, опись 4") for i in range(12)]
    for others in (0, 15000):
        rows = [(i, s, t) for i, (s, t) in enumerate(few + [("large", text(rng, 1)[:-1] + f" {i}.") for i in range(others)])]
        out = U.truncated(spark, spark.createDataFrame(rows, "doc_id long, source string, text string"))
        assert out.filter("kind is not null").count() == 0
