"""Problem 6: token ids of a whole corpus by a public byte-level BPE.

For a prefix of a piece of text at most one token can be the last of the
prefix's encoding: the one that ends the prefix and follows validly on the last
token of what remains before it.  Storing that token for every prefix (dynamic
programming over prefixes) gives the encoding by walking back, lets bytes be
appended without encoding anything again, and makes an edit cost only the
bytes after it, never those before.  Two tokens follow validly on one another
when encoding their joined bytes gives back just the two.

An empty text and a null text both have the empty list of ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import load

#: Where the public vocabularies lie; a parameter of every operator here.
TOKENIZERS = "/opt/tokenizers"
DEFAULT = "byte_bpe_50k"
# Fixed value: the published pattern that cuts text into pieces for this vocabulary.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces kept with their ids by a worker; beyond it, its oldest half is dropped. It only saves time.
CACHE = 1 << 18


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Tokens by bytes, with the relation "may follow" between them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self._follows: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}

    def merge(self, text: bytes) -> list[int]:
        """Byte-pair encoding by its definition: join the pair of least rank until none is left."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            joins = [(self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            rank, at = min(joins)
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def whole(self, token: int) -> bool:
        """Whether the token's bytes encode as that token."""
        if (known := self._whole.get(token)) is None:
            known = self._whole[token] = self.merge(self.bytes_of[token]) == [token]
        return known

    def follows(self, before: int, token: int) -> bool:
        if (known := self._follows.get((before, token))) is None:
            if len(self._follows) > 4 * CACHE:
                self._follows.clear()
            known = self._follows[before, token] = self.merge(self.bytes_of[before] + self.bytes_of[token]) == [before, token]
        return known


class PrefixTable:
    """The last token of every prefix of one piece."""

    def __init__(self, vocabulary: Vocabulary, text: bytes = b""):
        self.vocabulary, self.text, self.last = vocabulary, b"", [-1]
        self.append(text)

    def append(self, more: bytes) -> PrefixTable:
        """Adds bytes at the end; nothing that was there is encoded again."""
        v, ranks, last = self.vocabulary, self.vocabulary.ranks, self.last
        start = len(self.text)
        text = self.text = self.text + more
        for end in range(start + 1, len(text) + 1):
            found = -1
            for begin in range(max(0, end - v.longest), end):
                token = ranks.get(text[begin:end])
                if token is not None and (v.whole(token) if begin == 0 else v.follows(last[begin], token)):
                    found = token
                    break
            last.append(found)
        return self

    def edit(self, at: int, gone: int, new: bytes) -> PrefixTable:
        """Replaces ``gone`` bytes at ``at``; the table of the bytes before stays, and so does that of those behind from where it agrees.

        A prefix's last token depends on no more bytes, and last tokens, than
        the longest token has before it: once as many in a row are what they
        were, all others are.
        """
        text, last, window = self.text, self.last, self.vocabulary.longest + 1
        shift = len(new) - gone
        self.text, self.last = text[:at], last[: at + 1]
        self.append(new)
        agreed, end = 0, at + gone
        while end < len(text) and agreed < window:
            upto = min(len(text), end + window)
            self.append(text[end:upto])
            for k in range(end + 1, upto + 1):
                agreed = agreed + 1 if self.last[k + shift] == last[k] else 0
            end = upto
        self.text += text[end:]
        self.last += last[end + 1 :]
        return self

    def ids(self) -> list[int]:
        out, end = [], len(self.text)
        while end:
            token = self.last[end]
            out.append(token)
            end -= len(self.vocabulary.bytes_of[token])
        return out[::-1]


class Encoder:
    """Ids of texts, keeping the pieces it has met."""

    def __init__(self, ranks: dict[bytes, int]):
        self.vocabulary = Vocabulary(ranks)
        self.pieces = regex.compile(PIECES)
        self.known: dict[str, tuple[int, ...]] = {}

    def piece(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8")
        whole = self.vocabulary.ranks.get(raw)
        ids = (whole,) if whole is not None and self.vocabulary.whole(whole) else tuple(PrefixTable(self.vocabulary, raw).ids())
        if len(piece) <= 64:
            if len(self.known) >= CACHE:
                for old in list(self.known)[: CACHE // 2]:
                    del self.known[old]
            self.known[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        known, out = self.known, []
        for piece in self.pieces.findall(text):
            out += known.get(piece) or self.piece(piece)
        return out

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        known = self.known
        return sum(len(known.get(piece) or self.piece(piece)) for piece in self.pieces.findall(text))


class Document:
    """A text under editing with its ids: an edit encodes only the pieces it touches.

    Pieces are cut again from the piece before the edit until the new cuts meet
    an old one behind it; the ids of all other pieces are kept.
    """

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.pieces = encoder, encoder.pieces.findall(text)
        self.encoded = [encoder.known.get(p) or encoder.piece(p) for p in self.pieces]

    @property
    def text(self) -> str:
        return "".join(self.pieces)

    def ids(self) -> list[int]:
        return [i for p in self.encoded for i in p]

    def append(self, more: str) -> int:
        return self.edit(sum(map(len, self.pieces)), 0, more)

    def edit(self, at: int, gone: int, new: str) -> int:
        """Replaces ``gone`` characters at ``at`` by ``new``; gives the number of pieces encoded again."""
        starts, first, begin, n = [], 0, 0, 0
        for k, p in enumerate(self.pieces):
            starts.append(n)
            n += len(p)
            if n < at:
                first, begin = k, n - len(p)
        # Two pieces back: a piece's end may depend on the character after it.
        first = max(0, first - 1)
        begin = starts[first] if starts else 0
        text = self.text
        changed = text[begin:at] + new + text[at + gone :]
        old = {s + len(new) - gone: k for k, s in enumerate(starts) if s >= at + gone + 2}
        fresh, upto = [], len(self.pieces)
        for m in self.encoder.pieces.finditer(changed):
            if (k := old.get(begin + m.start())) is not None:
                upto = k
                break
            fresh.append(m.group())
        self.pieces[first:upto] = fresh
        self.encoded[first:upto] = [self.encoder.known.get(p) or self.encoder.piece(p) for p in fresh]
        return len(fresh)


_ENCODERS: dict[bytes, Encoder] = {}


def _encoder(ranks: bytes) -> Encoder:
    """The worker's encoder of a vocabulary file; it is kept from task to task, by the file's digest."""
    key = hashlib.blake2b(ranks, digest_size=16).digest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder({base64.b64decode(t): int(r) for t, r in (line.split() for line in ranks.splitlines() if line.strip())})
    return _ENCODERS[key]


def _shipped(spark: SparkSession, name: str, folder: str):
    """The vocabulary file, broadcast: its size is fixed (under 1 MB), and executors need no copy of the folder."""
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def token_ids(spark: SparkSession, text: Column, name: str = DEFAULT, folder: str = TOKENIZERS) -> Column:
    """array<int> of the text's ids, without special tokens; [] for null and empty texts."""
    ranks = _shipped(spark, name, folder)

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(ranks.value)
        for texts in batches:
            yield pd.Series([encoder.encode(t) for t in texts], dtype=object)

    return encode(F.coalesce(text.cast("string"), F.lit("")))


def token_count(spark: SparkSession, text: Column, name: str = DEFAULT, folder: str = TOKENIZERS) -> Column:
    """Number of the text's ids; 0 for null and empty texts."""
    ranks = _shipped(spark, name, folder)

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(ranks.value)
        for texts in batches:
            yield pd.Series([encoder.count(t) for t in texts], dtype="int32")

    return count(F.coalesce(text.cast("string"), F.lit("")))


def decode(ids: Iterable[int], vocabulary: Vocabulary) -> bytes:
    return b"".join(vocabulary.bytes_of[i] for i in ids)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return docs.select("doc_id", token_ids(spark, F.col("text")).alias("ids"))
