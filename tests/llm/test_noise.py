import random

from brinework.llm import noise as Z

_RNG = random.Random(0)
#: A vocabulary large enough to learn letters from: three syllables and an ending.
NAMES = sorted({"".join(_RNG.choice(("то", "ка", "ми", "пор", "ску", "лен", "гра", "вы", "ре", "со", "дол", "нит", "пе", "зак")) for _ in range(3)) + _RNG.choice(("ние", "та", "нос", "тель", "ка", "ность")) for _ in range(500)})
NAMES += ["толща", "камера", "порода", "период", "скважина", "сохраняла"]
VERBS = ["сохраняла", "проявила", "достигла", "показала", "вступила", "зависела", "определялась", "уточнялась", "отвечала", "разрушалась"]


KINDS = [("н", "и"), ("т", "г"), ("п", "л"), ("о", "0"), ("о", "o"), ("а", "a"), ("д", "л")]


def sentence(rng):
    return f"Соляная {rng.choice(NAMES)} {rng.choice(VERBS)} физико-механическими {rng.choice(NAMES)} при одно- и трёхосном {rng.choice(NAMES)}."


def damaged(word, rng):
    """One kind of misreading, as scans have it."""
    return word.replace(*rng.choice(KINDS))


def model():
    rng = random.Random(1)
    clean = [" ".join(sentence(rng) for _ in range(8)) for _ in range(150)]
    scanned = []
    for _ in range(150):
        words = " ".join(sentence(rng) for _ in range(6)).split(" ")
        for at in rng.sample(range(len(words)), 4):
            words[at] = damaged(words[at], rng)
        scanned.append(" ".join(words))
    blocks = [("PAGE_HEADER" if i % 2 else "TEXT", "Геомеханика соляных рудников" + ("  7" if i % 3 else ""), 0, 4) for i in range(40)] + [("PAGE_NUMBER", f"– {i} –", 4, 0) for i in range(40)] + [("TEXT", "Короткая строка текста.", 2, 2)] * 40
    return Z.fit(clean, scanned, blocks)


READER = Z.Reader(model())


def kinds(text, scanned=True, page=True):
    return READER.findings(text, scanned, page)


def test_halves():
    text = "Соляная тол-\nща сохраняла физико-\nмеханическими породa при одно- и трёхосном пери­\nод."
    assert [k for k in kinds(text) if k[0] in ("BROKEN", "COMPOUND")] == [("BROKEN", 2), ("COMPOUND", 5), ("BROKEN", 12)]


def test_characters():
    found = kinds("Соляная толша дoстигла сква�ина камера периол 12,5 МПа.")
    assert {n for k, n in found if k == "CHAR"} >= {3, 4}
    assert not {1, 5} & {n for _, n in found}


def test_furniture():
    text = "12 Геомеханика соляных рудников\n\nСоляная толща сохраняла камера.\n\nГеом*ханика соляных рудников  13\n\nСоляная порода достигла\n12.\n\n– 13 –"
    found = kinds(text)
    assert ("HEAD", 1) in found and ("HEAD", 9) in found and ("PAGENO", 17) in found
    assert not any(k == "CHAR" and 9 <= n <= 12 for k, n in found)


def test_repair():
    out = READER.repaired("Геомеханика соляных рудников  12\n\nСоляная тол-\nща сохраняла\nфизико-\nмеханическими камера.\n\nСоляная порода достигла камера.\n\n– 12 –", True, True)
    assert out == "Соляная толща сохраняла физико-механическими камера.\n\nСоляная порода достигла камера."


def test_clean_pages_are_left_alone():
    rng = random.Random(8)
    for _ in range(50):
        text = "\n\n".join(sentence(rng) for _ in range(5))
        assert kinds(text, scanned=True) == []
        assert READER.repaired(text, True, True) == text


def test_held_out_characters():
    """Damage of the kinds seen in fitting is found in sentences that weren't."""
    rng = random.Random(21)
    hit = wrong = total = 0
    for _ in range(200):
        words = sentence(rng).split(" ")
        kind = rng.choice(KINDS)
        places = [i for i, w in enumerate(words) if len(w) > 5 and "-" not in w and kind[0] in w]
        if not places:
            continue
        at = rng.choice(places)
        words[at] = words[at].replace(*kind)
        found = {n - 1 for k, n in kinds(" ".join(words)) if k == "CHAR"}
        total += 1
        hit += at in found
        wrong += len(found - {at})
    assert hit >= 0.9 * total and wrong <= 0.05 * total


def test_odd_texts():
    for t in ("", "   ", "\n", "-", "­", "—", "a" * 100000, "x-\n" * 3000, "� " * 500):
        READER.findings(t, True, True)
        READER.repaired(t, True, True)
    assert Z.Reader(Z.fit([], [], [])).findings("Любой текст-\nвот.", True, True) is not None


def test_words_and_heads_outside_the_samples(spark, tables, monkeypatch):
    """A word on one clean page and a head of few blocks count though the samples are small."""
    for name in ("CLEAN_PAGES", "SCANNED_PAGES", "BLOCKS"):
        monkeypatch.setattr(Z, name, 1)
    pages = [{"page_id": f"p{i}", "normalized_text": f"слово{chr(1072 + i)} порода", "primary_text_layer": "TEXT"} for i in range(30)]
    blocks = [{"object_id": f"b{i}", "page_id": f"p{i}", "block_type": "PAGE_HEADER", "normalized_text": f"Глава соляная {chr(1072 + i // 3)}"} for i in range(30)]
    model = Z.fitted(spark, tables(pages=pages, blocks=blocks), Z.Workspace(spark, "test")).model
    assert model.lexicon.words == {"порода": 30} | {f"слово{chr(1072 + i)}": 1 for i in range(30)}
    assert set(model.heads) == {f"глава соляная {chr(1072 + i)}" for i in range(10)}


def edits(a, b):
    """Levenshtein distance by common ends, then rows."""
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def spoilt(text, rng, kinds, lost=0.5):
    """A text as a scan might give it: misread words, lost characters, words cut in two at line ends."""
    out = []
    for w in text.split(" "):
        r = rng.random()
        fit = [(m, s) for m, s in kinds if m in w.lower() and w.isalpha() and len(w) > 4]
        if r < 0.08 and fit:
            m, s = rng.choice(fit)
            w = w.replace(m, s)
        elif r < 0.08 + 0.04 * lost and w.isalpha() and len(w) > 6:
            i = rng.randint(2, len(w) - 2)
            w = w[:i] + w[i + 1 :]
        elif r < 0.16 and w.isalpha() and len(w) > 6:
            i = rng.randint(3, len(w) - 3)
            w = w[:i] + "-\n" + w[i:]
        out.append(w)
    return " ".join(out)


def character_error(reader, texts, rng, kinds):
    before = after = size = 0
    for t in texts:
        t = t.replace("\n\n", " ").replace("\n", " ")
        bad = spoilt(t, rng, kinds)
        size += len(t)
        before += edits(t, bad)
        after += edits(t, reader.repaired(bad, True, True))
    return before / size, after / size


def test_repair_lowers_the_character_error():
    """Words known from other sentences: misread, robbed of a character or cut in two, then repaired."""
    rng = random.Random(31)
    texts = [" ".join(sentence(rng) for _ in range(6)) for _ in range(40)]
    before, after = character_error(READER, texts, rng, KINDS[:4])
    assert before > 0.005 and after < 0.25 * before, (before, after)


def test_lost_characters_are_put_in():
    assert READER.repaired("Соляная сохрняла камера.", True, True) == "Соляная сохраняла камера."
    assert ("CHAR", 2) in kinds("Соляная сохрняла камера.")


def test_long_words():
    """Beyond the words kept by their gaps the same readings hold, and every place of a long token is read."""
    long = "".join("породасольнаякамера"[i % 19] for i in range(120))
    words = {long: 2, long[:60] + "ж" + long[61:]: 1, "короткое": 3}
    lexicon = Z.Lexicon(words).open()
    assert lexicon.readings(long[:100] + "ъ" + long[101:], 100, 1) == long[100]
    assert lexicon.readings(long[:100] + long[101:], 100, 0) == long[100]
    assert lexicon.readings(long[:100] + "ъъ" + long[101:], 100, 2) == long[100]
    assert lexicon.readings(long[:60] + "ъ" + long[61:], 60, 1) == long[60] and lexicon.readings(long, 60, 1, long) == "ж"
    assert lexicon.readings("коро*кое", 4, 1) == "т" and lexicon.readings("корокое", 4, 0) == "т"
    assert ("CHAR", 1) in kinds("а" * 90 + "�" + "а" * 90)


def test_roman():
    assert [Z.roman(w) for w in ("iv", "xii", "mcmxciv", "iiii", "vx", "", "abc", "ic", "mmmm")] == [4, 12, 1994, 0, 0, 0, 0, 0, 0]


def test_too_many_words_to_broadcast(spark, sf_dir, monkeypatch):
    """Joined with what each block asks, records give what they give with all words at hand."""
    broadcast = {tuple(r) for r in Z.found(spark, sf_dir).collect()}
    texts = {tuple(r) for r in Z.repaired(spark, sf_dir).collect()}
    monkeypatch.setattr(Z, "WORDS_MOST", 10)
    monkeypatch.setattr(Z, "BLOCK_RECORDS", 50)
    joined = {tuple(r) for r in Z.found(spark, sf_dir).collect()}
    assert len(broadcast) > 100 and len(joined ^ broadcast) <= 0.01 * len(broadcast)
    changed = texts ^ {tuple(r) for r in Z.repaired(spark, sf_dir).collect()}
    assert len(changed) <= 0.02 * len(texts)


def test_answers_are_what_a_reader_asks(spark):
    """With answers for its block a reader reads as with the whole lexicon, by the same perceptrons."""
    rng = random.Random(77)
    m = model()
    words = spark.createDataFrame(list(m.lexicon.words.items()) + [("ы" * 60 + "ъ", 4)], "w string, n long")
    heads = spark.createDataFrame([(h,) for h in m.heads], "form string")
    m.lexicon.words["ы" * 60 + "ъ"] = 4
    m.lexicon.open()
    texts = [spoilt(" ".join(sentence(rng) for _ in range(4)), rng, KINDS) + " Геом*ханика соляных рудников 13 " + "ы" * 30 + "ж" + "ы" * 29 + "ъ" for _ in range(20)]
    df = spark.createDataFrame([(i % 3, t, True) for i, t in enumerate(texts)], "block long, text string, scanned boolean")
    facts = Z.answers(df, words, heads, Z.Workspace(spark, "test-answers")).toPandas()
    for i, t in enumerate(texts):
        lexicon, forms = Z.told(facts[facts["block"] == i % 3], m.lexicon.mined)
        local = Z.Reader(Z.replace(m, lexicon=lexicon, heads={" ".join(f): f for f in forms}))
        whole = Z.Reader(m)
        assert local.findings(t, True, True) == whole.findings(t, True, True)
        assert local.repaired(t, True, True) == whole.repaired(t, True, True)
