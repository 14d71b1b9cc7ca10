"""Text units (X-25): the blocks of a page or document packed into passages, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A unit is full from LEAST characters on, has MOST at most, and one under SHORT joins the unit before it.
LEAST, MOST, SHORT = 900, 1600, 200


def _joined(left: Column, right: Column, sep: str) -> Column:
    return F.when(left == "", right).otherwise(F.concat(left, F.lit(sep), right))


def _fits(left: Column, right: Column) -> Column:
    return F.length(left) + 1 + F.length(right) <= MOST


def _sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s != "")


def _by_sentences(text: Column) -> Column:
    """Parts of a text of at most MOST characters, cut between sentences; a longer sentence is a part of its own."""
    start = F.array().cast("array<string>")

    def step(parts: Column, s: Column) -> Column:
        last = F.element_at(parts, -1)
        return F.when(F.size(parts) == 0, F.array(s)).when(_fits(last, s), F.concat(F.slice(parts, 1, F.size(parts) - 1), F.array(F.concat(last, F.lit(" "), s)))).otherwise(F.concat(parts, F.array(s)))

    return F.aggregate(_sentences(text), start, step)


def units(blocks: Column) -> Column:
    """array<struct<heading boolean, text string>> in reading order -> array<struct<n int, text string>>.

    A heading starts a unit unless only headings stand before it; a unit that
    is full takes no more; blocks over MOST characters are cut between
    sentences, their first part staying with headings before it.  Null texts
    count as empty blocks and are left out; no blocks give no units.
    """
    piece = "struct<heading:boolean,first:boolean,text:string>"
    none = F.array().cast(f"array<{piece}>")

    def pieces(b: Column) -> Column:
        long = F.transform(_by_sentences(b["text"]), lambda t, i: F.struct(F.lit(False).alias("heading"), (i == 0).alias("first"), t.alias("text")))
        whole = F.array(F.struct(F.coalesce(b["heading"], F.lit(False)).alias("heading"), F.lit(False).alias("first"), b["text"].alias("text")))
        return F.when(F.length(b["text"]) > MOST, long).otherwise(whole).cast(f"array<{piece}>")

    kept = F.filter(blocks, lambda b: F.coalesce(b["text"], F.lit("")) != "")
    flat = F.aggregate(kept, none, lambda acc, b: F.concat(acc, pieces(b)))
    unit = "struct<n:int,text:string,heads:boolean,full:boolean>"

    def place(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        fresh = (F.size(done) == 0) | last["full"] | (x["heading"] & ~last["heads"]) | (~_fits(last["text"], x["text"]) & ~(last["heads"] & x["first"]))
        text = F.when(fresh, x["text"]).otherwise(F.concat(last["text"], F.lit("\n"), x["text"]))
        heads = F.when(fresh, x["heading"]).otherwise(last["heads"] & x["heading"])
        n = F.when(fresh, F.lit(1)).otherwise(last["n"] + 1)
        new = F.struct(n.alias("n"), text.alias("text"), heads.alias("heads"), ((F.length(text) >= LEAST) & ~x["heading"]).alias("full")).cast(unit)
        return F.concat(F.when(fresh, done).otherwise(F.slice(done, 1, F.size(done) - 1)), F.array(new))

    packed = F.aggregate(flat, F.array().cast(f"array<{unit}>"), place)
    result = "struct<n:int,text:string>"

    def gather(done: Column, u: Column) -> Column:
        last = F.element_at(done, -1)
        alone = (F.size(done) == 0) | (F.length(u["text"]) >= SHORT) | ~_fits(last["text"], u["text"])
        n = F.when(alone, u["n"]).otherwise(last["n"] + u["n"])
        text = F.when(alone, u["text"]).otherwise(F.concat(last["text"], F.lit("\n"), u["text"]))
        return F.concat(F.when(alone, done).otherwise(F.slice(done, 1, F.size(done) - 1)), F.array(F.struct(n.alias("n"), text.alias("text")).cast(result)))

    return F.aggregate(packed, F.array().cast(f"array<{result}>"), gather)


def units_sql(blocks: str) -> str:
    """The same as SQL over a relation (k, i, h, t) of blocks: key, place, heading, text."""
    return rf"""
WITH RECURSIVE b AS ({blocks}), s0 AS (SELECT k, i, list_filter(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS l FROM b WHERE length(t) > {MOST}),
s AS (SELECT k, i, unnest(l) AS t, unnest(range(1, len(l) + 1)) AS j FROM s0),
c AS (SELECT k, i, j, 1 AS part, length(t) AS size FROM s WHERE j = 1 UNION ALL
  SELECT s.k, s.i, s.j, CASE WHEN c.size + 1 + length(s.t) <= {MOST} THEN c.part ELSE c.part + 1 END, CASE WHEN c.size + 1 + length(s.t) <= {MOST} THEN c.size + 1 + length(s.t) ELSE length(s.t) END FROM c JOIN s ON s.k = c.k AND s.i = c.i AND s.j = c.j + 1),
p AS (SELECT k, i, part, false AS h, part = 1 AS f, string_agg(t, ' ' ORDER BY j) AS t FROM c JOIN s USING (k, i, j) GROUP BY k, i, part UNION ALL SELECT k, i, 1, h, false, t FROM b WHERE length(t) BETWEEN 1 AND {MOST}),
n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY i, part) AS r FROM p),
u AS (SELECT k, r, 1 AS unit, length(t) AS size, h AS heads, length(t) >= {LEAST} AND NOT h AS full_ FROM n WHERE r = 1 UNION ALL
  SELECT k, r, unit + fresh::INT, size, heads, size >= {LEAST} AND NOT h FROM (
    SELECT n.k, n.r, u.unit, n.h, x.fresh, CASE WHEN x.fresh THEN length(n.t) ELSE u.size + 1 + length(n.t) END AS size, CASE WHEN x.fresh THEN n.h ELSE u.heads AND n.h END AS heads
    FROM u JOIN n ON n.k = u.k AND n.r = u.r + 1, LATERAL (SELECT u.full_ OR (n.h AND NOT u.heads) OR (u.size + 1 + length(n.t) > {MOST} AND NOT (u.heads AND n.f)) AS fresh) x)),
g AS (SELECT k, unit, count(*) AS n, string_agg(t, chr(10) ORDER BY r) AS t FROM u JOIN n USING (k, r) GROUP BY k, unit),
m AS (SELECT k, unit, 0 AS no, length(t) AS size FROM g WHERE unit = 1 UNION ALL
  SELECT g.k, g.unit, CASE WHEN length(g.t) < {SHORT} AND m.size + 1 + length(g.t) <= {MOST} THEN m.no ELSE m.no + 1 END, CASE WHEN length(g.t) < {SHORT} AND m.size + 1 + length(g.t) <= {MOST} THEN m.size + 1 + length(g.t) ELSE length(g.t) END FROM m JOIN g ON g.k = m.k AND g.unit = m.unit + 1)
SELECT k, no AS unit_no, sum(n)::BIGINT AS n_blocks, md5(string_agg(t, chr(10) ORDER BY unit)) AS text_md5 FROM m JOIN g USING (k, unit) GROUP BY k, no"""
