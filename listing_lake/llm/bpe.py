"""BPE encoding and decoding with public vocabularies, in batched numpy merge rounds.

The distinct words of a batch lie in one flat array of symbol ids. A round looks up every neighbouring pair in the
sorted array of pair keys by binary search, takes each word's lowest rank and joins the pairs that have it, left to
right. A merge only uses symbols made by earlier merges (checked when a vocabulary is read), so this gives the same
ids as merging one pair at a time. Words without a pair left leave the array.

Worker memory: words and their ids are kept between batches up to `keep` entries, then forgotten.
Rows: a null text is an empty one, which has no ids; null and repeated ids stay, each row for itself; texts of any
length are taken whole; an empty table gives no rows; other columns of the table, whatever their names, are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: White space as the tokenizers library's patterns have it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Small letters that the tokenizers library has from newer Unicode tables than Python's.
NEWER = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B}
NEWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_NEWER = regex.compile("[" + "".join(map(chr, NEWER)) + "]")
_NONE = np.int64(1) << 40


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Vocabulary:
    """A tokenizer file of the tokenizers library: byte-level BPE, with or without word ends."""

    def __init__(self, path: str, keep: int = 200_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.keep = model["vocab"], keep
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        letters = byte_letters()
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.inner = np.array([vocab.get(c, -1) for c in letters], np.int64)
        self.last = np.array([vocab.get(c + self.suffix, -1) for c in letters], np.int64)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made: dict[str, int] = {}
        for rank, (x, y) in enumerate(merges):
            made.setdefault(x + y, rank)
        if any(made.get(x, -1) > rank or made.get(y, -1) > rank for rank, (x, y) in enumerate(merges)) or len(made) < len(merges):
            raise ValueError("a merge uses a symbol that a later merge makes")
        keys = np.array([vocab[x] << 20 | vocab[y] for x, y in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.joined = np.array([vocab[x + y] for x, y in merges], np.int64)
        self.words_only = spec["normalizer"] is not None  # lower-cased words, white space dropped
        apostrophes = "'s|'t|'re|'ve|'m|'ll|'d"
        if self.words_only:
            self.pattern = regex.compile(rf"{apostrophes}|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
        else:
            self.pattern = regex.compile(rf"{apostrophes}| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.known: dict[str, tuple] = {}

    def words(self, text: str) -> list[str]:
        """The words of a text in order; a special token's string is a word of its own."""
        if any(x in text for x in self.special):
            return [w for part in self.marks.split(text) for w in ([part] if part in self.special else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if self.words_only:
            text = text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")
            text = text.translate(NEWER) if _NEWER.search(text) else text
            text = text.lower()
        return self.pattern.findall(text)

    def merged(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word, by merge rounds over all of them."""
        raw = [w.encode("utf-8") for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(size)
        symbols = self.inner[flat]
        symbols[ends - 1] = self.last[flat[ends - 1]]
        if (symbols < 0).any():
            raise ValueError("the vocabulary lacks a byte")
        out: list[np.ndarray] = [None] * len(words)  # type: ignore[list-item]
        number = np.arange(len(words))
        while len(number):
            starts = ends - size
            key = symbols[:-1] << 20 | symbols[1:]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            rank = np.append(np.where(self.keys[at] == key, self.ranks[at], _NONE), _NONE)
            rank[ends - 1] = _NONE
            least = np.minimum.reduceat(rank, starts)
            done = least == _NONE
            for n, s, e in zip(number[done].tolist(), starts[done].tolist(), ends[done].tolist(), strict=True):
                out[n] = symbols[s:e]
            hit = (rank == np.repeat(least, size)) & (rank < _NONE)
            place = np.nonzero(hit)[0]
            if len(place) > 1:  # of pairs that overlap, the first, third, fifth go
                fresh = np.append(True, np.diff(place) != 1)
                first = np.maximum.accumulate(np.where(fresh, place, 0))
                place = place[(place - first) % 2 == 0]
            symbols = symbols.copy()
            symbols[place] = self.joined[rank[place]]
            stay = np.repeat(~done, size)
            stay[place + 1] = False
            gone = np.zeros(len(stay) + 1, np.int64)
            np.cumsum(~stay, out=gone[1:])
            size = (size - (gone[ends] - gone[starts]))[~done]
            symbols, number, ends = symbols[stay], number[~done], np.cumsum(size)
        return out

    def learn(self, words: set[str], make) -> None:
        """Keep make(ids) of every word that isn't known yet."""
        if len(self.known) > self.keep:
            self.known.clear()
        if not self.known:
            self.known |= {t: make([i]) for t, i in self.special.items()}
        new = sorted(words - self.known.keys())  # a long list is cut, so that the flat array stays small
        for at in range(0, len(new), 100_000):
            part = new[at : at + 100_000]
            self.known |= {w: make(ids.tolist()) for w, ids in zip(part, self.merged(part), strict=True)}

    def encode(self, text: str) -> list[int]:
        words = self.words(text)
        found = dict(zip(plain := sorted({*words} - self.special.keys()), self.merged(plain) if plain else [], strict=True))
        return [int(i) for w in words for i in ([self.special[w]] if w in self.special else found[w])]

    def decode(self, ids: list[int]) -> str:
        """As the library decodes: tokens joined by spaces where the file names no decoder, else their bytes as text."""
        if self.words_only:
            return " ".join(self.tokens[i] for i in ids)
        return b"".join(self.token_bytes(i) for i in ids).decode("utf-8", "replace")

    def token_bytes(self, i: int) -> bytes:
        token = self.tokens[i]
        return token.encode() if token in self.special else bytes(self.byte_of[c] for c in token)


@functools.lru_cache(maxsize=4)
def vocabulary(path: str, use: str = "") -> Vocabulary:
    """One vocabulary for each worker process and use; what a use keeps of words is its own."""
    return Vocabulary(path)


def texts_of(batch: pa.RecordBatch, column: int) -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): every whole text's token ids. A null text is an empty one; an empty text has no ids."""
    common.share_code(docs.sparkSession)

    def work(batches):
        vocab = vocabulary(path, "ids")
        for batch in common.slices(batches, 1):
            words = [vocab.words(t) for t in texts_of(batch, 1)]
            vocab.learn({w for ws in words for w in ws}, tuple)
            ids = [[i for w in ws for i in vocab.known[w]] for ws in words]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, "id long, ids array<int>")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every whole text, encoded and decoded again.

    Rows: a null text is an empty one; empty texts have no tokens and the digests of the empty string; null ids
    and repeated rows stay as they are; a text of any length is taken whole.
    """
    common.share_code(docs.sparkSession)

    def work(batches):
        vocab = vocabulary(path, "digests")
        if not vocab.words_only:
            raise ValueError("digests() joins decoded words by spaces; a byte-level vocabulary decodes otherwise")
        make = lambda ids: (len(ids), " ".join(map(str, ids)), vocab.decode(ids))
        for batch in common.slices(batches, 1):
            words = [vocab.words(t) for t in texts_of(batch, 1)]
            vocab.learn({w for ws in words for w in ws}, make)
            rows = []
            for ws in words:
                found = list(map(vocab.known.__getitem__, ws))
                rows.append((sum(x[0] for x in found), *(hashlib.sha256(" ".join([x[k] for x in found]).encode()).hexdigest() for k in (1, 2))))
            n, ids, text = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")
