"""Problem 8: texts that stop before their end.

Two kinds of evidence are read from length histograms and endings over all
documents:

* per source and column, lengths in characters and in bytes, each with and
  without an omission mark at the stop; a length is a spike when it holds
  significantly and many times more different texts than the lengths around
  it.  A text of a spike length without terminal punctuation was cut by that
  limit.  A limit often holds for a part of a source only (one form, one
  export), so spikes are looked for at every length, the source's longest
  among them;
* a text that stops without terminal punctuation and whose ending isn't an
  ending that many different texts share (captions, list items, signatures,
  page numbers) was cut on the way.

What was added after the stop is taken off first: transfer trailers and source
notes as endings that many different texts of the source share, omission marks
("...", "…", "[...]") by their form.  Dots of omission are no end of a sentence:
a text is whole before them only if it closes before them.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoint import Workspace
from ..tables import load

#: An ending is shared if at least this part of the different texts of its source has it, and LEAST of them, or if
#: this part of the whole corpus has it.  A text has at most three endings, so a source shares at most 3 / OF_SOURCE,
#: the corpus 3 / OF_CORPUS of them: that bounds what is broadcast (a few dozen bytes each).
OF_SOURCE, OF_CORPUS, LEAST = 0.003, 0.0003, 3
#: Most characters of an added line that ends with a terminal mark, to tell it from a repeated sentence.
LONGEST_NOTE = 40
#: A spike has SPIKE_TIMES the average of the lengths around it, and would hold so many texts by chance at any of the
#: source's lengths with a probability below SPIKE_CHANCE (Chernoff's bound of the Poisson tail).
SPIKE_TIMES, SPIKE_AROUND, SPIKE_CHANCE = 8.0, 40, 0.01

# Marks that end a sentence, and closing marks that may follow them.
TERMINAL = ".!?…。"
CLOSING = "\"'»”“’)]"
#: Blanks say nothing about where a text stops.
BLANKS = " \t\r\n\f\v\u00a0\u2028\u2029\u200b\ufeff"
#: Nor do separator lines and omission marks; of four dots the first is a full stop.
_OMITTED = re.compile(r"(?:\[\s*(?:\.{2,}|…)\s*\]|(?<=\n)-{2,}|^-{2,}|…+|(?<!\.)(?:\.{3}|\.{5,})|(?<=[^.]\.)\.{3}|(?<=\s)\.{2,})$")
_SENTENCE = re.compile(rf"[{re.escape(TERMINAL)}][{re.escape(CLOSING)}]*\s+(?=[«\"„]?[^\W\d_a-zа-яё])")
_DIGITS = re.compile(r"\d+")
_WORD = re.compile(r"[^\W\d_]*[-,]?")
_LEADING = re.compile(r"\D{0,6}")


def bare_end(text: str, end: int) -> int:
    """Where ``text[:end]`` ends without blanks, separator lines and omission marks."""
    while True:
        at = end
        while at and text[at - 1] in BLANKS:
            at -= 1
        tail = text[max(0, at - 64) : at]
        if m := _OMITTED.search(tail):
            at -= len(m.group())
        if at == end:
            return end
        end = at


def bare(text: str) -> str:
    """Without blanks, separator lines and omission marks at the end."""
    return text[: bare_end(text, len(text))]


def with_mark(text: str, end: int) -> int:
    """Where the omission marks that directly follow ``end`` stop."""
    m = re.compile(r"(?:\s*\[\s*(?:\.{2,}|…)\s*\]|[ \u00a0]*(?:…|\.{2,})+)").match(text, end)
    return m.end() if m else end


def closed(text: str, end: int | None = None) -> bool:
    """Whether the text (up to ``end``) ends with a terminal mark, closing marks after it allowed."""
    at = len(text) if end is None else end
    while at and text[at - 1] in CLOSING:
        at -= 1
    return at > 0 and text[at - 1] in TERMINAL


def leading(ending: str) -> str:
    """The first characters before any digit, the same before and after digits are written as 0."""
    return _LEADING.match(ending).group()


def key_of(ending: str) -> int:
    return int.from_bytes(hashlib.blake2b(ending.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def spans_of(text: str, end: int) -> list[int]:
    """Where the endings of ``text[:end]`` (bare) begin: its last paragraph, line and sentence, longest first.

    An ending that closes like a sentence counts only as a short line of its
    own; a single word tells nothing.
    """
    line = text.rfind("\n", 0, end) + 1
    paragraph = text.rfind("\n\n", 0, end) + 1
    while paragraph < end and text[paragraph] == "\n":
        paragraph += 1
    starts = [paragraph, line]
    whole = closed(text, end)
    if not whole:
        last = line
        for m in _SENTENCE.finditer(text, line, end):
            last = m.end()
        starts.append(last)
    return [s for s in dict.fromkeys(starts) if s < end and (not whole or end - s <= LONGEST_NOTE) and not _WORD.fullmatch(text, s, end)]


def written(text: str, start: int, end: int) -> str:
    """An ending with its numbers as 0."""
    return _DIGITS.sub("0", text[start:end])


def stop_of(text: str, shared: dict[str, set[int]]) -> tuple[int, bool]:
    """(where the text stops, whether that is inside a sentence).  shared: by leading characters, keys of endings.

    Shared endings are taken off while there are any; a text that is nothing
    but shared endings, or closes before them, is whole.
    """
    end = bare_end(text, len(text))
    while True:
        start = next((s for s in spans_of(text, end) if (keys := shared.get(leading(text[s : min(end, s + 6)]))) and key_of(written(text, s, end)) in keys), None)
        if start is None:
            return end, not closed(text, end)
        rest = bare_end(text, start)
        if not rest or closed(text, rest) and not closed(text, end):
            # Complete before an ending that is no sentence: whole as it stands, whichever it is.
            return end, False
        end = rest


def by_leading(endings: Iterable[tuple[str, int]]) -> dict[str, set[int]]:
    out: dict[str, set[int]] = {}
    for start, key in endings:
        out.setdefault(start, set()).add(key)
    return out


def shared_endings(texts: DataFrame, work: Workspace) -> DataFrame:
    """source, key, leading: endings that many different texts share, and that texts seldom go on after.

    texts: source, text, neither null.  source is null where the whole corpus
    shares the ending.  The beginning of a sentence that happens to be cut at
    one place in several texts recurs too; but elsewhere that sentence goes on.
    """

    def units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for source, t, hash_ in zip(batch["source"], batch["text"], batch["h"], strict=True):
                end = bare_end(t, len(t))
                for s in spans_of(t, end):
                    e = written(t, s, end)
                    rows.append((source, key_of(e), len(e), leading(e), sum(map(str.isalpha, e)) >= 3, hash_))
            yield pd.DataFrame(rows, columns=["source", "key", "size", "leading", "letters", "h"])

    hashed = texts.select("source", "text", F.xxhash64("text").alias("h"))
    sizes = hashed.select("source", "h").distinct().groupBy("source").agg(F.count(F.lit(1)).alias("texts"))
    total = hashed.agg(F.count_distinct("h").alias("total"))
    found = hashed.mapInPandas(units, "source string, key long, size int, leading string, letters boolean, h long")
    found = work.cut(found.distinct(), "found")
    seen = found.groupBy("source", "key").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("leading").alias("leading"), F.first("letters").alias("letters"))
    of_source = seen.join(sizes, "source").filter((F.col("n") >= LEAST) & (F.col("n") >= F.col("texts") * OF_SOURCE)).select("source", "key", "size", "leading", "letters", "n")
    # A text that several sources hold is one text of the corpus.
    everywhere = found.drop("source").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("leading").alias("leading"), F.first("letters").alias("letters"))
    of_corpus = everywhere.crossJoin(F.broadcast(total)).filter((F.col("n") >= LEAST) & (F.col("n") >= F.col("total") * OF_CORPUS))
    of_corpus = of_corpus.select(F.lit(None).cast("string").alias("source"), "key", "size", "leading", "letters", "n")
    often = work.cut(of_source.unionByName(of_corpus), "often")
    wanted: dict[str, dict[int, set[int]]] = {}
    for r in often.filter("letters").select("leading", "size", "key").distinct().toLocalIterator():
        wanted.setdefault(r["leading"], {}).setdefault(r["size"], set()).add(r["key"])
    known = texts.sparkSession.sparkContext.broadcast(wanted)

    def followed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        going_on: Counter[tuple[str, int]] = Counter()
        for batch in batches:
            for source, t in zip(batch["source"], batch["text"], strict=True):
                going_on.update((source, k) for k in set(_gone_on(t, known.value)))
        yield pd.DataFrame([(s, k, m) for (s, k), m in sorted(going_on.items())], columns=["source", "key", "m"])

    on = hashed.select("source", "text").mapInPandas(followed, "source string, key long, m long").groupBy("source", "key").agg(F.sum("m").alias("m"))
    on = on.unionByName(on.groupBy("key").agg(F.sum("m").alias("m")).select(F.lit(None).cast("string").alias("source"), "key", "m"))
    o = on.select(F.col("source").alias("_s"), F.col("key").alias("_k"), "m")
    both = often.join(o, often["source"].eqNullSafe(o["_s"]) & (often["key"] == o["_k"]), "left")
    return both.filter(F.coalesce("m", F.lit(0)) < F.col("n")).select("source", "key", "leading")


def _gone_on(text: str, wanted: dict[str, dict[int, set[int]]]) -> Iterator[int]:
    """Keys of endings that a sentence of the text starts with and goes on after."""
    for line in text.split("\n"):
        for s in _SENTENCE.split(line):
            sizes = wanted.get(leading(s[:6]))
            if sizes:
                s = _DIGITS.sub("0", s)
                for size, keys in sizes.items():
                    if len(s) > size + 1 and (k := key_of(s[:size])) in keys:
                        yield k


def stops(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """Where each text stops: doc_id, source, chars, bytes, chars_marked, bytes_marked, inside, marked, point, h; nothing for blank texts.

    chars and bytes are lengths up to the stop, those with _marked up to the
    end of omission marks behind it.  marked: a replacement character is at the
    stop; point: it stops behind a number and a point, in a text that uses the
    point as decimal mark; h tells different texts apart.
    """
    by_source: dict[str | None, list[tuple[str, int]]] = {}
    for r in shared.toLocalIterator():
        by_source.setdefault(r["source"], []).append((r["leading"], r["key"]))
    corpus = by_source.pop(None, [])
    known = docs.sparkSession.sparkContext.broadcast((by_leading(corpus), {s: by_leading(own + corpus) for s, own in by_source.items()}))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        corpus_wide, own = known.value
        for batch in batches:
            rows = []
            for doc, source, text, h in zip(batch["doc_id"], batch["source"], batch["text"], batch["h"], strict=True):
                if not bare_end(text, len(text)):
                    continue
                end, inside = stop_of(text, own.get(source, corpus_wide))
                core = text[:end]
                size = len(core.encode("utf-8", "surrogatepass"))
                marked_end = with_mark(text, end)
                mark = len(text[end:marked_end].encode("utf-8", "surrogatepass"))
                point = re.search(r"\s\d+\.$", core[-20:]) is not None and re.search(r"\d\.\d", core) is not None and re.search(r"\d,\d", core) is None
                rows.append((doc, source, end, size, marked_end, size + mark, inside, core.endswith("\ufffd"), point, h))
            yield pd.DataFrame(rows, columns=["doc_id", "source", *LENGTHS, "inside", "marked", "point", "h"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, source string, {', '.join(f'{c} int' for c in LENGTHS)}, inside boolean, marked boolean, point boolean, h long"
    return docs.select("doc_id", "source", "text", F.xxhash64("text").alias("h")).mapInPandas(walk, schema)


LENGTHS = ["chars", "bytes", "chars_marked", "bytes_marked"]


def spikes(rows: DataFrame) -> DataFrame:
    """source, spikes (map of a column of LENGTHS to an array of lengths): where far more different texts stop than around.

    Texts of one length are counted before any window: a window's rows are
    the lengths of a source, however many texts it has.
    """
    stacked = rows.select("source", "h", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("length")) for c in LENGTHS))).alias("x")).select("source", "x.*", "h")
    counts = stacked.distinct().groupBy("source", "column", "length").agg(F.count(F.lit(1)).alias("n"))
    of = Window.partitionBy("source", "column")
    around = of.orderBy("length").rangeBetween(-SPIKE_AROUND, SPIKE_AROUND)
    # One text more than seen around: a gap in the histogram doesn't prove that nothing falls there.
    mean = (F.sum("n").over(around) - F.col("n") + 1) / (2 * SPIKE_AROUND)
    rated = counts.select("source", "column", "length", "n", mean.alias("mean"), F.count(F.lit(1)).over(of).alias("lengths"))
    chance = F.col("n") * F.log(F.col("mean") / F.col("n")) + F.col("n") - F.col("mean") + F.log("lengths")
    high = rated.filter((F.col("n") >= SPIKE_TIMES * F.col("mean")) & (F.col("n") > 1) & (chance < F.log(F.lit(SPIKE_CHANCE))))
    lists = high.groupBy("source", "column").agg(F.collect_list("length").alias("at"))
    return lists.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("column", "at"))).alias("spikes"))


def truncated(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, source, kind of every text that isn't blank.

    kind is LIMIT (cut at a spike length), TRANSFER (cut elsewhere) or null
    (whole).  Null, empty and blank texts have no row; a null source is a
    source of its own; extra columns are ignored.
    """
    work = Workspace(spark, "truncation")
    docs = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text").filter("text is not null")
    shared = work.cut(shared_endings(docs.select("source", "text"), work), "endings")
    work.drop("found")
    work.drop("often")
    rows = work.cut(stops(docs, shared), "stops")
    # One row per source, of at most a few lengths: smaller than the list of sources' names by construction of a spike.
    rows = rows.join(spikes(rows), "source", "left")
    limit = F.lit(False)
    for c in LENGTHS:
        limit = limit | F.coalesce(F.array_contains(F.col("spikes")[c], F.col(c)), F.lit(False))
    kind = F.when(limit & (F.col("inside") | F.col("point")), "LIMIT").when(F.col("marked") | F.col("inside"), "TRANSFER")
    return rows.select("doc_id", "source", kind.alias("kind"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated(spark, load(spark, sf_dir, "documents")).filter("kind is not null").select("doc_id").distinct()


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source the number of texts, of those cut by a limit and on the way, and their share."""
    rows = truncated(spark, load(spark, sf_dir, "documents"))
    out = rows.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.count_if(F.col("kind") == "LIMIT").alias("at_limit"), F.count_if(F.col("kind") == "TRANSFER").alias("in_transfer"))
    return out.withColumn("share", (F.col("at_limit") + F.col("in_transfer")) / F.col("texts"))
