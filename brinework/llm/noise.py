"""Problem 3: noise in text from scanned pages.

Four averaged perceptrons, fitted on bounded samples of the corpus itself; the
words that clean pages have and the forms of running heads are counted over all
pages and blocks:

* an editor of characters (keep, replace, delete, insert before) for words that
  clean pages don't have, learning from clean words damaged by the confusions
  mined from scans or robbed of a character, and from scanned words with one
  clean reading;
* a writer, which names the character that a replacement or insertion puts in,
  learning from the same places;
* a joiner of word halves (join without the mark, join with it, leave), learning
  from clean words cut in two, compounds cut at their hyphen and hyphens that
  clean pages leave hanging;
* a judge of furniture (running head, page number, text) over short stretches,
  with features of their place on the page.

Everything else - every page, every block, every token - is read in one pass
without a shuffle; words known from clean pages cost one lookup.  That holds
while the words and the heads are few enough to be broadcast (WORDS_MOST,
HEADS_MOST).  Beyond, records are cut into blocks, and each block is joined
with what its own tokens ask of the words and heads, and with nothing else.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from random import Random

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoint import Workspace
from ..tables import current, hash_sample, load

#: Rows the models are fitted on, about, chosen by hash over all rows.
CLEAN_PAGES, SCANNED_PAGES, BLOCKS = 5_000, 3_000, 20_000
#: Words the editor learns from, and rounds over them.
EDITED_WORDS, ROUNDS = 9_000, 4
#: A form is a running head if at least so many blocks of it, and this part of them, are typed as heads or feet.
HEAD_LEAST, HEAD_SHARE = 3, 0.2
#: Most words and forms of heads that are collected and broadcast: about 40 MB together.
WORDS_MOST, HEADS_MOST = 400_000, 50_000
#: Records of a block that is joined with its words, on average.
BLOCK_RECORDS = 1_000
#: Part of a head's characters that may be misread.
HEAD_NOISE = 0.25
#: Words the joiner learns from, of each kind, chosen at random.
JOINED_WORDS = 3_000
#: Words up to this length are found by their gaps, longer ones by common beginnings and ends: the same readings.
GAP_WORD = 48

# Fixed values.
MARKS = "-­¬‐"
HANGING = {"и", "или", "до", "and", "or", "to", "und", "oder", "bis"}
TOKEN = re.compile(r"[^ \t\r\n]+")
_EDGE = ".,;:!?…()[]{}«»„“”\"'’"
_DIGITS = re.compile(r"\d+")
_NUMBER = re.compile(r"\d{1,4}")
_PAGE_NUMBER = re.compile(r"(?:\d{1,4}\.?|[-–—~] \d{1,4} [-–—~]|\[\d{1,4}\]|(?:стр|с|p|pp|S)\. ?\d{1,4})", re.I)


_NUMBERED = re.compile(r"(?:стр|с|p|pp|S)\.", re.I)
# Roman digits.
_ROMAN_DIGITS = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def roman(word: str) -> int:
    """The number a word in small Roman digits writes in the usual way; 0 if it doesn't."""
    values = [_ROMAN_DIGITS.get(c, 0) for c in word]
    if not values or not all(values) or len(values) > 15:
        return 0
    total = sum(-v if v < max(values[k:]) else v for k, v in enumerate(values))
    out, rest = "", total
    for unit, one, five, ten in ((1000, "m", "", ""), (100, "c", "d", "m"), (10, "x", "l", "c"), (1, "i", "v", "x")):
        digit, rest = divmod(rest, unit)
        if unit == 1000:
            out += one * digit
        else:
            out += one + ten if digit == 9 else one + five if digit == 4 else five * (digit >= 5) + one * (digit % 5)
    return total if 0 < total < 4000 and out == word else 0


class Perceptron:
    """Averaged multi-class perceptron over sparse named features; a feature's weights are (class, weight) pairs."""

    def __init__(self, classes: tuple[str, ...]):
        self.classes = classes
        self.weights: dict[str, list[tuple[int, float]]] = {}

    def scores(self, features: Iterable[str]) -> list[float]:
        total = [0.0] * len(self.classes)
        for f in features:
            for k, v in self.weights.get(f, ()):
                total[k] += v
        return total

    def best(self, features: Iterable[str]) -> str:
        s = self.scores(features)
        return self.classes[s.index(max(s))]

    def fit(self, examples: list[tuple[list[str], str]], rounds: int = ROUNDS, seed: int = 5) -> Perceptron:
        at = 0
        #: feature -> class -> [weight, its sum over the steps up to stamp, stamp]
        learnt: dict[str, dict[int, list[float]]] = {}
        index = {c: k for k, c in enumerate(self.classes)}
        random, order = Random(seed), list(range(len(examples)))
        for _ in range(rounds):
            random.shuffle(order)
            for e in order:
                at += 1
                features, label = examples[e]
                s = [0.0] * len(self.classes)
                for f in features:
                    for k, w in learnt.get(f, {}).items():
                        s[k] += w[0]
                guess, right = s.index(max(s)), index[label]
                if guess == right:
                    continue
                for f in features:
                    of = learnt.setdefault(f, {})
                    for k, step in ((right, 1.0), (guess, -1.0)):
                        w = of.setdefault(k, [0.0, 0.0, at])
                        w[1] += (at - w[2]) * w[0]
                        w[2] = at
                        w[0] += step
        for f, of in learnt.items():
            mean = [(k, (total + (at + 1 - stamp) * w) / (at + 1)) for k, (w, total, stamp) in sorted(of.items())]
            if kept := [(k, v) for k, v in mean if abs(v) > 1e-6]:
                self.weights[f] = kept
        return self


def key_of(word: str) -> str:
    """A word as the lexicon has it: lower case, digits as 0."""
    return _DIGITS.sub("0", word).lower()


def _script(c: str) -> str:
    return "0" if c.isdigit() else "L" if "a" <= c <= "z" or c in "äöüß" else "C" if "Ѐ" <= c <= "ӿ" else "x"


def _common(a: str, b: str) -> int:
    """Length of the common beginning."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


@dataclass
class Lexicon:
    """Words of clean pages, and the characters they allow at an unknown place."""

    words: dict[str, int]
    gaps: dict[str, dict[str, int]] = field(default_factory=dict)
    #: Words over GAP_WORD characters by length.
    long: dict[int, list[str]] = field(default_factory=dict)
    #: (seen, meant) that scans show more than once.
    mined: set[tuple[str, str]] = field(default_factory=set)
    #: Whether gaps and long are complete as they are.
    opened: bool = False
    #: The long word last asked for, with its common beginning and end with words of nearly its length.
    near: tuple[str, list[tuple[str, int, int]]] = ("", [])

    def open(self) -> Lexicon:
        gaps: dict[str, dict[str, int]] = defaultdict(dict)
        for w, n in self.words.items():
            if 2 < len(w) <= GAP_WORD:
                for i, c in enumerate(w):
                    g = gaps[w[:i] + "\0" + w[i + 1 :]]
                    g[c] = g.get(c, 0) + n
            elif len(w) > GAP_WORD:
                self.long.setdefault(len(w), []).append(w)
        self.gaps, self.opened = dict(gaps), True
        return self

    def readings(self, w: str, i: int, width: int, own: str = "") -> str:
        """The most frequent character that clean words have for w[i : i + width], its own word apart; a width of 0 asks for one lost before i."""
        size = len(w) - width + 1
        if size <= GAP_WORD:
            found = self.gaps.get(w[:i] + "\0" + w[i + width :])
        else:
            found = self._of_long(w, i, width, size)
        if not found:
            return ""
        if own:
            found = {c: n for c, n in found.items() if w[:i] + c + w[i + width :] != own}
        return max(found, key=lambda c: (found[c], c)) if found else ""

    def _of_long(self, w: str, i: int, width: int, size: int) -> dict[str, int]:
        if self.near[0] != w:
            back = w[::-1]
            self.near = (w, [(x, _common(w, x), _common(back, x[::-1])) for n in range(len(w) - 1, len(w) + 2) for x in self.long.get(n, ())])
        return {x[i]: self.words[x] for x, head, tail in self.near[1] if len(x) == size and head >= i and tail >= len(w) - i - width}


def look_of(w: str, cased: str) -> tuple[str, str]:
    """(main script, shape) of a word."""
    scripts = Counter(map(_script, w))
    shape = ("N" if cased[:1].isupper() else "n") + ("d" if scripts["0"] else "") + ("m" if scripts["L"] and scripts["C"] else "")
    return "L" if scripts["L"] >= scripts["C"] else "C", shape


def place_readings(w: str, i: int, lexicon: Lexicon, own: str = "") -> tuple[str, str, str]:
    """What clean words have for one character, for two, and for one lost before it."""
    return lexicon.readings(w, i, 1, own), lexicon.readings(w, i, 2, own) if i + 1 < len(w) else "", lexicon.readings(w, i, 0, own)


def char_features(w: str, i: int, lexicon: Lexicon, own: str = "", look: tuple[str, str] = ("C", "n"), read: tuple[str, str, str] | None = None) -> list[str]:
    """What the editor sees at a character; ``own`` is the word itself where the lexicon has it (in fitting)."""
    a, b, c = w[i - 2] if i > 1 else "^", w[i - 1] if i else "^", w[i]
    d, e = (w[i + 1 : i + 3] + "$$")[:2]
    main, shape = look
    one, two, lost = read or place_readings(w, i, lexicon, own)
    if one == c:
        one = ""
    return [
        "1" + c, "2" + b + c, "3" + c + d, "4" + b + c + d, "5" + a + b + c, "6" + c + d + e, "7" + a + b + c + d, "8" + b + c + d + e,
        "s" + _script(c) + main + shape, "o" + ("=" if one else "-") + shape, "r" + c + ">" + one, "t" + c + d + ">" + two, "w" + ("=" if two else "-"), "c" + c + shape,
        "q" + str((c, one) in lexicon.mined) + str((c + d, two) in lexicon.mined), "Q" + str((c, one) in lexicon.mined) + shape,
        "z" + ("=" if lost else "-") + ("=" if one or two else "-") + shape, "Z" + b + c + ">" + lost,
    ]


def written_features(w: str, i: int, operation: str, width: int, lexicon: Lexicon, own: str = "") -> list[str]:
    """What the writer sees at a place that the editor would change."""
    a, b = w[i - 2] if i > 1 else "^", w[i - 1] if i else "^"
    d, e = (w[i + width : i + width + 2] + "$$")[:2]
    seen = w[i : i + width]
    read = lexicon.readings(w, i, width, own)
    o = operation[0]
    return [o, "r" + read, "s" + o + seen, "sr" + seen + ">" + read, "b" + o + b + d, "c" + o + a + b, "d" + o + d + e, "e" + seen + b + d, "m" + str((seen, read) in lexicon.mined) + o + read]


JOINS = ("JOIN", "KEEP", "LEAVE")


def join_features(a: str, mark: str, b: str, lexicon: Lexicon) -> list[str]:
    """What the joiner sees at a word half, its mark and the next word."""
    x, y = key_of(a), key_of(b)
    whole, hyphened = x + y in lexicon.words, x + "-" + y in lexicon.words
    known = ("w" if whole else "") + ("h" if hyphened else "")
    shape = ("A" if a[:1].isupper() else "a") + ("B" if b[:1].isupper() else "0" if b[:1].isdigit() else "b")
    return ["k" + known, "m" + ("-" if mark == "-" else "s"), "km" + known + ("-" if mark == "-" else "s"), "s" + shape + known, "h" + (y if y in HANGING else ""), "hk" + (y if y in HANGING else "") + known, "e" + x[-3:], "b" + y[:3], "l" + str(min(len(x), 3)) + str(min(len(y), 3)), "p" + ("=" if any(v in lexicon.words for v in (x + "-",)) else "")]


PLACES = ("HEAD", "PAGENO", "TEXT")


def place_features(kind: str, alone: bool, from_top: int, from_bottom: int, numbered: bool, near_number: bool) -> list[str]:
    """What the judge sees of a stretch: what it looks like, and where on the page it stands."""
    t, u = min(from_top, 3), min(from_bottom, 3)
    return ["k" + kind, "a" + str(alone), "ka" + kind + str(alone), f"p{kind}{t}{u}", f"t{kind}{t}", f"u{kind}{u}", f"n{kind}{numbered}", f"q{kind}{near_number}{alone}"]


@dataclass
class Model:
    lexicon: Lexicon
    editor: Perceptron
    writer: Perceptron
    joiner: Perceptron
    judge: Perceptron
    heads: dict[str, tuple[str, ...]]


def head_form(text: str) -> tuple[str, ...]:
    """A stretch's words as a form: its page number off, digits as 0, lower case."""
    words = TOKEN.findall(text)
    if words and _NUMBER.fullmatch(words[0]):
        words = words[1:]
    if len(words) > 1 and _NUMBER.fullmatch(words[-1]) and len(words) > 2:
        words = words[:-1]
    return tuple(key_of(w) for w in words)


def _substituted(w: str, lexicon: Lexicon) -> tuple[str, list[tuple[str, str]]] | None:
    """The one clean word that w is a misreading of in one place, with that place's (seen, meant)."""
    found = {}
    for i in range(len(w)):
        for width in (1, 2):
            meant = lexicon.readings(w, i, width)
            if meant and meant != w[i : i + width] and i + width <= len(w):
                found[w[:i] + meant + w[i + width :]] = (i, width, w[i : i + width], meant)
    if len(found) != 1:
        return None
    clean, (i, width, seen, meant) = next(iter(found.items()))
    return clean, [(seen, meant), (str(i), str(width))]


def page_words(text: str) -> Iterator[str]:
    """Keys of a page's words, as the lexicon counts them."""
    for t in TOKEN.findall(text):
        if w := t.strip(_EDGE):
            yield key_of(w)


def may_be_head(form: tuple[str, ...]) -> bool:
    return 2 <= len(form) <= 10 and sum(map(len, form)) >= 8 and any(c.isalpha() for w in form for c in w)


def fit(clean: list[str], scanned: list[str], blocks: list[tuple[str, str, int, int]], seed: int = 11, lexicon: Lexicon | None = None, head_forms: list[tuple[str, ...]] | None = None) -> Model:
    """Fits all four perceptrons.

    clean, scanned: texts of pages; blocks: (block_type, text, from top, from
    bottom) of short blocks.  Any of them may be empty.  lexicon, head_forms:
    of all clean pages and of all running heads; without them those of the
    given texts and blocks.
    """
    random = Random(seed)
    counts: Counter[str] = Counter()
    hyphened: Counter[str] = Counter()
    hanging: Counter[tuple[str, str]] = Counter()
    cased: dict[str, str] = {}
    for text in clean:
        tokens = TOKEN.findall(text)
        for t, u in zip(tokens, [*tokens[1:], ""], strict=False):
            w = t.strip(_EDGE)
            if not w:
                continue
            counts[key_of(w)] += 1
            cased.setdefault(key_of(w), w)
            if w.endswith("-") and len(w) > 1 and u:
                hanging[w[:-1], u.strip(_EDGE)] += 1
            elif "-" in w.strip("-"):
                hyphened[w] += 1
    lexicon = Lexicon(dict(counts)).open() if lexicon is None else lexicon

    # Confusions: what scans show where clean words have something else.
    confusions: Counter[tuple[str, str]] = Counter()
    damaged: list[tuple[str, str, int, int, str]] = []
    for text in scanned:
        tokens = TOKEN.findall(text)
        for t, before in zip(tokens, ["", *tokens[:-1]], strict=False):
            w = t.strip(_EDGE)
            k = key_of(w)
            raw = w.lower()
            if len(raw) < 4 or k in lexicon.words or w[-1:] in MARKS or before[-1:] in MARKS or not any(c.isalpha() for c in w):
                continue
            if one := _substituted(raw, lexicon):
                (seen, meant), (i, width) = one[1]
                confusions[seen, meant] += 1
                damaged.append((raw, one[0], int(i), int(width), w))
    confusions = Counter({c: n for c, n in confusions.items() if n >= 2 and c[0] != c[1]})
    lexicon.mined = set(confusions)
    by_meant: dict[str, list[tuple[str, int]]] = defaultdict(list)
    for (seen, meant), n in confusions.items():
        by_meant[meant].append((seen, n))
    learnt = [w for w in counts if len(w) > 3 and any(c.isalpha() for c in w)]
    learnt.sort(key=lambda w: (-counts[w], w))
    chosen = learnt[: EDITED_WORDS // 3] + random.sample(learnt, min(len(learnt), EDITED_WORDS // 3))
    examples: list[tuple[list[str], str]] = []
    written: list[tuple[list[str], str]] = []

    def learn(word: str, labels: list[str], shown: str, own: str = "") -> None:
        look = look_of(word, shown)
        examples.extend((char_features(word, i, lexicon, own, look), label) for i, label in enumerate(labels))

    for w in chosen:
        shown = cased[w]
        learn(w, ["KEEP"] * len(w), shown, w)
        places = [i for i, c in enumerate(w) if c in by_meant]
        if places:
            # One confusion or two, each at one place or at all of them.
            swaps: dict[int, str] = {}
            for _ in range(random.choice((1, 1, 2))):
                meant = w[random.choice(places)]
                seen = random.choices([x for x, _ in by_meant[meant]], [n for _, n in by_meant[meant]])[0]
                spots = [i for i, c in enumerate(w) if c == meant]
                swaps |= dict.fromkeys(spots if random.random() < 0.5 else [random.choice(spots)], seen)
            out, labels, at = "", [], []
            for i, c in enumerate(w):
                if i in swaps:
                    at.append((len(out), len(swaps[i]), c))
                labels += ["REPLACE"] + ["DELETE"] * (len(swaps[i]) - 1) if i in swaps else ["KEEP"]
                out += swaps.get(i, c)
            learn(out, labels, shown)
            written += [(written_features(out, i, "REPLACE", n, lexicon), c) for i, n, c in at]
        if len(w) > 5:
            # A lost character is shown at the one behind it.
            i = random.randint(1, len(w) - 2)
            if w[i] not in (w[i - 1], w[i + 1]) and (robbed := w[:i] + w[i + 1 :]) not in lexicon.words:
                learn(robbed, ["INSERT" if k == i else "KEEP" for k in range(len(robbed))], shown)
                written.append((written_features(robbed, i, "INSERT", 0, lexicon), w[i]))
    for raw, meant, i, width, shown in random.sample(damaged, min(len(damaged), EDITED_WORDS // 3)):
        learn(raw, ["REPLACE" if k == i else "DELETE" if i < k < i + width else "KEEP" for k in range(len(raw))], shown)
        written.append((written_features(raw, i, "REPLACE", width, lexicon), meant[i]))
    editor = Perceptron(("KEEP", "REPLACE", "DELETE", "INSERT")).fit(examples)
    writer = Perceptron(tuple(sorted({c for _, c in written})) or ("",)).fit(written)

    joins: list[tuple[list[str], str]] = []
    for w in random.sample(learnt, min(len(learnt), JOINED_WORDS)):
        w = cased[w]
        if len(w) > 4 and w.isalpha():
            for mark in ("-", "­"):
                at = random.randint(2, len(w) - 2)
                joins.append((join_features(w[:at], mark, w[at:], lexicon), "JOIN"))
    for w, n in random.sample(sorted(hyphened.items()), min(len(hyphened), JOINED_WORDS)):
        a, _, b = w.partition("-")
        if a and b:
            joins += [(join_features(a, "-", b, lexicon), "KEEP")] * min(3, n)
    for (a, b), n in random.sample(sorted(hanging.items()), min(len(hanging), JOINED_WORDS)):
        joins += [(join_features(a, "-", b, lexicon), "LEAVE")] * min(5, n)
    joiner = Perceptron(JOINS).fit(joins)

    forms: dict[tuple[str, ...], list[int]] = defaultdict(lambda: [0, 0])
    for kind, text, _, _ in blocks:
        form = head_form(text)
        if may_be_head(form):
            forms[form][0] += 1
            forms[form][1] += kind in ("PAGE_HEADER", "PAGE_FOOTER")
    if head_forms is None:
        head_forms = [f for f, (n, h) in forms.items() if h >= HEAD_LEAST and h >= HEAD_SHARE * n]
    heads = {" ".join(f): f for f in head_forms}

    shapes: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for kind, text, _, _ in blocks:
        shapes[_look(text, heads)][0] += 1
        shapes[_look(text, heads)][1] += kind in ("PAGE_NUMBER", "PAGE_FOOTER")
    places: list[tuple[list[str], str]] = []
    for _, text, top, bottom in blocks:
        look = _look(text, heads)
        n, m = shapes[look]
        label = "HEAD" if look == "head" else "PAGENO" if look != "text" and m >= HEAD_SHARE * n else "TEXT"
        places.append((place_features(look, True, top, bottom, bool(_NUMBER.search(text)), False), label))
    judge = Perceptron(PLACES).fit(places)
    return Model(lexicon, editor, writer, joiner, judge, heads)


def _look(text: str, heads: dict[str, tuple[str, ...]]) -> str:
    """head, number, roman or text."""
    bare = text.strip()
    if " ".join(head_form(bare)) in heads:
        return "head"
    if _PAGE_NUMBER.fullmatch(bare):
        return "number"
    return "roman" if roman(bare) else "text"


class Reader:
    """A model at work on records: findings, and the repaired text."""

    def __init__(self, model: Model):
        self.m = model
        if not model.lexicon.opened:
            model.lexicon.open()
        self.by_word: dict[str, list[tuple[tuple[str, ...], int]]] = defaultdict(list)
        for form in model.heads.values():
            for k, w in enumerate(form):
                if len(w) > 2:
                    self.by_word[w].append((form, k))
        #: raw token -> (known, key if it is a word of a head else "")
        self.seen: dict[str, tuple[bool, str]] = {}
        self.edited: dict[str, tuple[tuple[int, str], ...]] = {}

    def look_up(self, raw: str) -> tuple[bool, str]:
        w = raw.strip(_EDGE)
        key = key_of(w)
        known = not w or key in self.m.lexicon.words or not any(c.isalpha() or c == "�" for c in w) and "*" not in w
        whole = key_of(raw)
        found = known, whole if whole in self.by_word else ""
        if len(raw) <= GAP_WORD:
            if len(self.seen) > 400_000:
                self.seen.clear()
            self.seen[raw] = found
        return found

    def _heads(self, tokens: list[str], keys: list[str], starts: set[int]) -> list[tuple[int, int]]:
        """Spans of running heads, their page number in them."""
        votes: Counter[tuple[tuple[str, ...], int]] = Counter()
        for i, key in enumerate(keys):
            if key:
                for form, k in self.by_word[key]:
                    if i >= k:
                        votes[form, i - k] += 1
        spans: list[tuple[int, int]] = []
        for (form, at), n in sorted(votes.items(), key=lambda v: (-v[1], -len(v[0][0]), v[0][1])):
            end = at + len(form)
            if end > len(tokens) or 2 * n < sum(len(w) > 2 for w in form) or any(at < y and x < end for x, y in spans):
                continue
            seen, meant = " ".join(map(str.lower, tokens[at:end])), " ".join(form)
            if not _alike(seen, meant):
                continue
            begin = at
            if at and at not in starts and _page_part(tokens[at - 1]) and (at - 1 in starts or tokens[at - 2][-1] in ".!?)]-–—~") and not (at > 1 and _NUMBERED.fullmatch(tokens[at - 2])):
                begin = at - 1
            if begin not in starts and tokens[begin - 1][-1] not in ".!?…)]" and not _PAGE_NUMBER.fullmatch(tokens[begin - 1]) and not any(c.isupper() for c in tokens[at][:1]):
                continue
            if begin == at and end < len(tokens) and end not in starts and _page_part(tokens[end]) and not (tokens[end].endswith(".") and end + 1 < len(tokens)):
                end += 1
            spans.append((begin, end))
        return sorted(spans)

    def _bad_places(self, word: str) -> tuple[tuple[int, str], ...]:
        """(place, operation) where the editor would change a word that clean pages don't have."""
        if (known := self.edited.get(word)) is not None:
            return known
        low = word.lower()
        found: list[tuple[int, str]] = []
        lexicon, look = self.m.lexicon, look_of(low, word)
        # A capitalised word in one script may be a name: only a clean reading speaks against it.
        plain_name = word[:1].isupper() and len({_script(c) for c in low if c.isalnum()}) == 1 and not any(c.isdigit() for c in low)
        for i, c in enumerate("" if roman(word) else low):
            if c == "\ufffd":
                found.append((i, "REPLACE"))
            elif c.isalnum():
                read = place_readings(low, i, lexicon)
                if plain_name and not any(read):
                    continue
                if (operation := self.m.editor.best(char_features(low, i, lexicon, look=look, read=read))) != "KEEP":
                    found.append((i, operation))
        if len(word) <= GAP_WORD:
            if len(self.edited) > 400_000:
                self.edited.clear()
            self.edited[word] = tuple(found)
        return tuple(found)

    def findings(self, text: str, scanned: bool, whole_page: bool, order: int = 0) -> list[tuple[str, int]]:
        """(kind, token number from 1) of a record."""
        spans = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
        if not spans:
            return []
        tokens = [text[a:b] for a, b in spans]
        seen, look = self.seen, self.look_up
        facts = [seen.get(t) or look(t) for t in tokens]
        keys = [f[1] for f in facts]
        starts = {0}
        if "\n" in text:
            starts |= {k for k in range(1, len(spans)) if "\n" in text[spans[k - 1][1] : spans[k][0]]}
        heads = self._heads(tokens, keys, starts) if any(keys) else []
        out: list[tuple[str, int]] = []
        furniture: set[int] = set()
        lines = sorted(starts)
        line_of = {}
        for k, s in enumerate(lines):
            line_of[s] = k
        for a, b in heads:
            near = max((k for k in lines if k <= a), default=0)
            top, bottom = line_of[near], len(lines) - 1 - line_of[near]
            alone = a in starts and (b in starts or b == len(tokens))
            if self.m.judge.best(place_features("head", alone or not whole_page, top, bottom, any(map(_page_part, tokens[a:b])), False)) == "HEAD":
                out.append(("HEAD", a + 1))
                furniture.update(range(a, b))
        for k, s in enumerate(lines):
            e = lines[k + 1] if k + 1 < len(lines) else len(tokens)
            wrapped = k > 0 and s - 1 not in furniture and tokens[s - 1][-1] not in ".!?…:)]" and "\n\n" not in text[spans[s - 1][1] : spans[s][0]]
            self._numbers(tokens, s, e, k, len(lines) - 1 - k, furniture, whole_page, wrapped, out)
        if scanned:
            for k, (t, (known, _)) in enumerate(zip(tokens, facts, strict=True)):
                if k in furniture:
                    continue
                if t[-1] in MARKS and len(t) > 1 and t[-2].isalnum() and k + 1 < len(tokens) and k + 1 not in furniture and tokens[k + 1][0].isalnum():
                    a, b = t[:-1].lstrip(_EDGE), tokens[k + 1].strip(_EDGE)
                    choice = self.m.joiner.best(join_features(a, t[-1], b, self.m.lexicon))
                    if choice == "LEAVE" and t[-1] != "-":
                        choice = "JOIN"
                    if choice != "LEAVE":
                        out.append(("BROKEN" if choice == "JOIN" else "COMPOUND", k + 1))
                        joined = a + b if choice == "JOIN" else a + "-" + b
                        if key_of(joined) not in self.m.lexicon.words:
                            self._chars(a, 0, k, joined, out)
                            self._chars(b, len(joined) - len(b), k + 1, joined, out)
                        furniture.add(k + 1) if choice == "JOIN" else None
                        continue
                if not known and k not in furniture:
                    w = t.strip(_EDGE)
                    if w[-1:] in MARKS:
                        w = w[:-1]
                    if self._bad_places(w):
                        out.append(("CHAR", k + 1))
        return list(dict.fromkeys(out))

    def _chars(self, part: str, offset: int, at: int, word: str, out: list[tuple[str, int]]) -> None:
        if any(offset <= i < offset + len(part) for i, _ in self._bad_places(word)):
            out.append(("CHAR", at + 1))

    def _numbers(self, tokens: list[str], s: int, e: int, top: int, bottom: int, furniture: set[int], whole_page: bool, wrapped: bool, out: list[tuple[str, int]]) -> None:
        """Page numbers alone on their line, or set off at an end of a page that was run together."""

        def take(a: int, b: int) -> None:
            out.append(("PAGENO", a + 1))
            furniture.update(range(a, b))

        rest = [k for k in range(s, e) if k not in furniture]
        if not rest:
            return
        if len(rest) == e - s <= 3:
            look = _look(" ".join(tokens[s:e]), {})
            if look != "text":
                sure = look == "roman" or not tokens[s].rstrip(".").isdigit()
                if (sure or not wrapped) and self.m.judge.best(place_features(look, True, top, bottom, look == "number", False)) == "PAGENO":
                    take(s, e)
                return
        if not whole_page:
            return
        for size in (3, 2, 1):
            if e - s <= size:
                continue
            if bottom == 0 and not furniture & set(range(e - size, e)):
                last, before = " ".join(tokens[e - size : e]), tokens[e - size - 1]
                closed = before[-1] in ".!?…)]" or e - size - 1 in furniture
                decorated = size > 1 or last[0] == "[" or roman(last)
                if (_PAGE_NUMBER.fullmatch(last) or roman(last)) and (closed or decorated and before[-1].isdigit()):
                    take(e - size, e)
            if top == 0 and not furniture & set(range(s, s + size)):
                first, after = " ".join(tokens[s : s + size]), tokens[s + size]
                if (_PAGE_NUMBER.fullmatch(first) or roman(first)) and (after[0].isupper() or s + size in furniture):
                    take(s, s + size)

    def repaired(self, text: str, scanned: bool, whole_page: bool) -> str:
        """The text with halves joined, furniture gone, misread characters replaced, deleted or put in as the editor and the writer say, and lines flowing into paragraphs."""
        found = defaultdict(set)
        for kind, n in self.findings(text, scanned, whole_page):
            found[n - 1].add(kind)
        spans = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
        tokens = [text[a:b] for a, b in spans]
        facts = [self.seen.get(t) or self.look_up(t) for t in tokens]
        starts = {0} | {k for k in range(1, len(spans)) if "\n" in text[spans[k - 1][1] : spans[k][0]]}
        gone: set[int] = set()
        for a, b in self._heads(tokens, [f[1] for f in facts], starts):
            if "HEAD" in found[a]:
                gone.update(range(a, b))
        for k in range(len(tokens)):
            if "PAGENO" in found[k]:
                end = next((j for j in range(k + 1, min(k + 3, len(tokens))) if _PAGE_NUMBER.fullmatch(" ".join(tokens[k : j + 1]))), k)
                gone.update(range(k, end + 1))
        out, glue = "", ""
        for k, t in enumerate(tokens):
            if k in gone:
                continue
            if k and not glue and out:
                between = text[spans[k - 1][1] : spans[k][0]]
                glue = "\n\n" if between.count("\n") > 1 and out[-1] in ".!?…:)]»" else " "
            if "CHAR" in found[k]:
                t = self._mended(t)
            if found[k] & {"BROKEN", "COMPOUND"}:
                out += glue + (t[:-1] if "BROKEN" in found[k] else t[:-1] + "-")
                glue = "\0"
                continue
            out += ("" if glue == "\0" else glue) + t
            glue = ""
        return out

    def _mended(self, token: str) -> str:
        """The token after the editor's operations, their characters as the writer names them."""
        w = token.strip(_EDGE)
        at = token.find(w) if w else 0
        low, bad = w.lower(), dict(self._bad_places(w))
        out = ""
        for i, c in enumerate(low):
            operation = bad.get(i, "KEEP")
            shown = w[i] if len(w) == len(low) else c
            if operation == "DELETE":
                continue
            if operation == "KEEP" or not self.m.writer.weights:
                out += shown
                continue
            width = 0 if operation == "INSERT" else 2 if bad.get(i + 1) == "DELETE" else 1
            meant = self.m.writer.best(written_features(low, i, operation, width, self.m.lexicon))
            out += (meant.upper() if shown.isupper() and operation == "REPLACE" else meant) + (shown if operation == "INSERT" else "")
        return token[:at] + out + token[at + len(w) :]


def _page_part(token: str) -> bool:
    """A page number beside a running head, one character of it misread at most."""
    if len(token) > 4 or "." in token or "," in token:
        return False
    return token.isdigit() or any(c.isdigit() for c in token) and sum(not c.isdigit() for c in token) == 1 and token[0] not in "([" and token[-1] not in ")]:;"


def _alike(seen: str, meant: str) -> bool:
    """Whether one could be a misreading of the other: few characters differ, digits count as equal."""
    seen = _DIGITS.sub("0", seen)
    most = int(HEAD_NOISE * len(meant))
    if abs(len(seen) - len(meant)) > min(most, 2):
        return False
    if len(seen) == len(meant):
        return sum(a != b for a, b in zip(seen, meant, strict=True)) <= most
    previous = list(range(len(meant) + 1))
    for i, a in enumerate(seen, 1):
        row = [i]
        for j, b in enumerate(meant, 1):
            row.append(min(previous[j] + 1, row[-1] + 1, previous[j - 1] + (a != b)))
        previous = row
    return previous[-1] <= most


_READERS: dict[int, Reader] = {}


def _reader(model) -> Reader:
    """The worker's reader of a broadcast model, kept from task to task."""
    if (key := id(model.value)) not in _READERS:
        _READERS.clear()
        _READERS[key] = Reader(model.value)
    return _READERS[key]


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, text, scanned, whole_page of all current pages and blocks that have a text."""
    pages = current(spark, sf_dir, "pages", ["primary_text_origin", "primary_text_layer", "normalized_text"])
    pages = pages.select(F.col("page_id").alias("record_id"), F.col("normalized_text").alias("text"), F.col("primary_text_layer").contains("OCR").alias("scanned"), F.lit(True).alias("whole_page"))
    # Exact repeats of a block give the same findings; the result is made distinct, not the input.
    blocks = load(spark, sf_dir, "blocks")
    blocks = blocks.select(F.col("object_id").alias("record_id"), F.col("normalized_text").alias("text"), F.col("text_layer").contains("OCR").alias("scanned"), F.lit(False).alias("whole_page"))
    return pages.unionByName(blocks).filter("text is not null and record_id is not null").withColumn("scanned", F.coalesce("scanned", F.lit(False)))


def word_counts(pages: DataFrame) -> DataFrame:
    """w, n: every word of the clean pages and its count."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter[str] = Counter()
        for batch in batches:
            for text in batch["normalized_text"]:
                n.update(page_words(text))
            if len(n) > 200_000:
                yield pd.DataFrame({"w": list(n.keys()), "n": list(n.values())})
                n.clear()
        if n:
            yield pd.DataFrame({"w": list(n.keys()), "n": list(n.values())})

    return pages.select("normalized_text").mapInPandas(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))


def head_counts(blocks: DataFrame) -> DataFrame:
    """form: those of running heads among all short blocks."""

    def form(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(" ".join(f), kind in ("PAGE_HEADER", "PAGE_FOOTER")) for kind, text in zip(batch["block_type"], batch["normalized_text"], strict=True) if may_be_head(f := head_form(text))]
            if rows:
                yield pd.DataFrame(rows, columns=["form", "head"])

    counted = blocks.select("block_type", "normalized_text").mapInPandas(form, "form string, head boolean").groupBy("form").agg(F.count(F.lit(1)).alias("n"), F.count_if("head").alias("h"))
    return counted.filter((F.col("h") >= HEAD_LEAST) & (F.col("h") >= HEAD_SHARE * F.col("n"))).select("form")


#: Kinds of questions that tokens ask.
_KNOWN, _EDIT, _HEAD = 0, 1, 2


def _questions(text: str, scanned: bool) -> Iterator[tuple[int, str, str]]:
    """(kind, text, key): words to look up, words to edit unless their key is known, and words that may be of a head."""
    tokens = TOKEN.findall(text)
    for k, raw in enumerate(tokens):
        yield _HEAD, key_of(raw), ""
        if not scanned:
            continue
        w = raw.strip(_EDGE)
        if w:
            key = key_of(w)
            yield _KNOWN, key, ""
            yield _EDIT, (w[:-1] if w[-1:] in MARKS else w).lower(), key
        if raw[-1] in MARKS and len(raw) > 1 and k + 1 < len(tokens):
            a, b = raw[:-1].lstrip(_EDGE), tokens[k + 1].strip(_EDGE)
            x, y = key_of(a), key_of(b)
            for asked in (x + y, x + "-" + y, x + "-"):
                yield _KNOWN, asked, ""
            for joined in (a + b, a + "-" + b):
                yield _KNOWN, key_of(joined), ""
                yield _EDIT, joined.lower(), key_of(joined)


def answers(records: DataFrame, words: DataFrame, heads: DataFrame, work: Workspace, every: bool = False) -> DataFrame:
    """block, kind, a, b, n: what the blocks' tokens ask of the words and heads: W word a with count n, G gap a filled by b, L long word a, H head a.

    records: block, text, scanned.  Questions are made distinct per block
    before they are shuffled, edits of unknown words (for fitting: of ``every``
    word) once over all blocks.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            asked = {(block, *q) for block, text, scanned in zip(batch["block"], batch["text"], batch["scanned"], strict=True) for q in _questions(text, scanned)}
            yield pd.DataFrame(sorted(asked), columns=["block", "kind", "text", "key"])

    asked = work.cut(records.select("block", "text", "scanned").mapInPandas(ask, "block long, kind int, text string, key string").distinct(), "asked")
    of = lambda kind: asked.filter(F.col("kind") == kind)
    known = of(_KNOWN).select("block", F.col("text").alias("w")).join(words, "w").select("block", F.lit("W").alias("kind"), F.col("w").alias("a"), F.lit("").alias("b"), "n")
    edited = of(_EDIT) if every else of(_EDIT).join(words.select(F.col("w").alias("key")), "key", "left_anti")
    unknown = edited.select("block", F.col("text").alias("low"))
    if every:
        unknown = unknown.union(of(_KNOWN).select("block", "text"))
    unknown = unknown.distinct()
    unknown = work.cut(unknown, "unknown")
    low = unknown.select("low").distinct()
    size = F.length("low")
    gap = lambda c, i, width: F.concat(F.substring(c, F.lit(1), i), F.lit("\0"), F.substring(c, i + width + 1, F.length(c)))
    gaps_of = lambda c, at, width: F.transform(at, lambda i: gap(c, i, width))
    places = F.sequence(F.lit(0), size)
    keys = F.array_distinct(F.flatten(F.array(*(gaps_of("low", places, width) for width in (0, 1, 2)))))
    open_gaps = low.filter(size.between(1, GAP_WORD + 1)).select("low", F.explode(keys).alias("g"))
    short = words.filter(F.length("w").between(3, GAP_WORD))
    filled = short.select("n", F.posexplode(F.transform(F.sequence(F.lit(0), F.length("w") - 1), lambda i: F.struct(gap("w", i, 1).alias("g"), F.substring("w", i + 1, F.lit(1)).alias("c")))).alias("i", "x")).select(F.col("x.g").alias("g"), F.col("x.c").alias("c"), "n")
    read = open_gaps.join(filled, "g").select("low", F.lit("G").alias("kind"), F.col("g").alias("a"), F.col("c").alias("b"), "n")
    # Words an edit apart share their first or their last half.
    half = GAP_WORD // 2 - 1
    ends = lambda df, c: df.select("*", F.explode(F.array(F.concat(F.lit("^"), F.left(F.col(c), F.lit(half))), F.concat(F.lit("$"), F.right(F.col(c), F.lit(half))))).alias("end"))
    long = ends(low.filter(size >= GAP_WORD), "low").join(ends(words.filter(F.length("w") > GAP_WORD), "w"), "end").filter(F.abs(F.length("w") - size) <= 1)
    read = read.unionByName(long.select("low", F.lit("L").alias("kind"), F.col("w").alias("a"), F.lit("").alias("b"), "n").distinct())
    edits = unknown.join(read, "low").drop("low").distinct()
    # Half of a head's longer words must be in a record: then one of its rarest (half and one more) is.
    form = heads.select("form", F.explode(F.array_distinct(F.filter(F.split("form", " "), lambda w: F.length(w) > 2))).alias("w"))
    rated = form.join(form.groupBy("w").agg(F.count(F.lit(1)).alias("forms")), "w")
    rare = rated.select("form", "w", F.row_number().over(Window.partitionBy("form").orderBy("forms", "w")).alias("r"), F.count(F.lit(1)).over(Window.partitionBy("form")).alias("m")).filter("r <= floor(m / 2) + 1")
    met = of(_HEAD).select("block", F.col("text").alias("w")).join(rare.select("w", "form"), "w").select("block", F.lit("H").alias("kind"), F.col("form").alias("a"), F.lit("").alias("b"), F.lit(0).cast("long").alias("n")).distinct()
    return known.distinct().unionByName(edits).unionByName(met)


def told(facts: pd.DataFrame, mined: set[tuple[str, str]]) -> tuple[Lexicon, list[tuple[str, ...]]]:
    """The lexicon and heads of answers."""
    lexicon = Lexicon({}, mined=mined, opened=True)
    heads = []
    for kind, a, b, n in zip(facts["kind"], facts["a"], facts["b"], facts["n"], strict=True):
        if kind == "W":
            lexicon.words[a] = int(n)
        elif kind == "G":
            lexicon.gaps.setdefault(a, {})[b] = int(n)
        elif kind == "L":
            lexicon.words[a] = int(n)
            lexicon.long.setdefault(len(a), []).append(a)
        else:
            heads.append(tuple(a.split(" ")))
    return lexicon, sorted(set(heads))


@dataclass
class Fitted:
    """A fitted model; words and heads beside it where they are too many to be in it."""

    model: Model
    words: DataFrame | None = None
    heads: DataFrame | None = None


def fitted(spark: SparkSession, sf_dir: str, work: Workspace) -> Fitted:
    """The model of a corpus: perceptrons fitted on the documented samples, words and heads of all pages and blocks."""
    pages = load(spark, sf_dir, "pages").filter("normalized_text is not null").select("page_id", "normalized_text", F.coalesce(F.col("primary_text_layer").contains("OCR"), F.lit(False)).alias("scanned"))
    clean = sorted(r[0] for r in hash_sample(pages.filter("not scanned"), ["page_id"], CLEAN_PAGES).select("normalized_text").collect())
    scanned = sorted(r[0] for r in hash_sample(pages.filter("scanned"), ["page_id"], SCANNED_PAGES).select("normalized_text").collect())
    blocks = load(spark, sf_dir, "blocks").select("block_type", "normalized_text", "reading_order", "object_id", "page_id").filter("length(normalized_text) < 90")
    rows = hash_sample(blocks, ["page_id"], BLOCKS).select("block_type", "normalized_text", F.coalesce("reading_order", F.lit(0)), "page_id").collect()
    rows.sort(key=lambda r: (r[3] or "", r[2], r[1], r[0] or ""))
    last: dict[str, int] = {}
    for r in rows:
        last[r[3]] = max(last.get(r[3], 0), r[2])
    short = [(r[0] or "", r[1], r[2], last[r[3]] - r[2]) for r in rows]
    words, heads = work.cut(word_counts(pages.filter("not scanned")), "words"), work.cut(head_counts(blocks), "heads")
    if words.count() <= WORDS_MOST and heads.count() <= HEADS_MOST:
        counted = words.toPandas()
        lexicon = Lexicon(dict(sorted(zip(counted["w"], map(int, counted["n"]), strict=True)))).open()
        forms = [tuple(r[0].split(" ")) for r in sorted(heads.collect())]
        return Fitted(fit(clean, scanned, short, lexicon=lexicon, head_forms=forms))
    # What the samples ask, as one block; bounded as they are.
    sample = [(0, t, True) for t in clean + scanned] + [(0, t, False) for _, t, _, _ in short]
    facts = answers(spark.createDataFrame(sample, "block long, text string, scanned boolean"), words, heads, Workspace(spark, "noise-sample"), every=True).toPandas()
    lexicon, forms = told(facts, set())
    return Fitted(fit(clean, scanned, short, lexicon=lexicon, head_forms=forms), words, heads)


def _read_all(spark: SparkSession, sf_dir: str, read: Callable[[Reader, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``read`` over all records, with a reader that knows all words and heads their tokens ask for."""
    work = Workspace(spark, "noise")
    fit_ = fitted(spark, sf_dir, work)
    rows = records(spark, sf_dir)
    if fit_.words is None:
        model = spark.sparkContext.broadcast(fit_.model)

        def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            reader = _reader(model)
            for batch in batches:
                yield read(reader, batch)

        return rows.mapInPandas(whole, schema)
    m = fit_.model
    bare = spark.sparkContext.broadcast(replace(m, lexicon=Lexicon({}, mined=m.lexicon.mined, opened=True), heads={}))
    blocks = max(1, rows.count() // BLOCK_RECORDS)
    rows = work.cut(rows.withColumn("block", F.pmod(F.xxhash64("record_id", "text"), F.lit(blocks))), "records")
    facts = answers(rows, fit_.words, fit_.heads, work)

    def by_block(batch: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        model = bare.value
        lexicon, heads = told(known, model.lexicon.mined)
        return read(Reader(replace(model, lexicon=lexicon, heads={" ".join(f): f for f in heads})), batch)

    return rows.groupBy("block").cogroup(facts.groupBy("block")).applyInPandas(by_block, schema)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, kind, token_no of all noise in all records.

    Null texts and texts without a token give no rows.
    """

    def read(reader: Reader, batch: pd.DataFrame) -> pd.DataFrame:
        rows = [(r, kind, n) for r, t, s, w in zip(batch["record_id"], batch["text"], batch["scanned"], batch["whole_page"], strict=True) for kind, n in reader.findings(t, s, w)]
        return pd.DataFrame(rows, columns=["record_id", "kind", "token_no"])

    return _read_all(spark, sf_dir, read, "record_id string, kind string, token_no long").distinct()


def repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, text: every record as continuous paragraphs."""

    def read(reader: Reader, batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"record_id": batch["record_id"], "text": [reader.repaired(t, s, w) for t, s, w in zip(batch["text"], batch["scanned"], batch["whole_page"], strict=True)]})

    return _read_all(spark, sf_dir, read, "record_id string, text string")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir)


def p3_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(spark, sf_dir)
