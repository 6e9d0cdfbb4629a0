"""Alignment of two tokenizers: which tokens overlap, where both have a boundary, and which id pairs go together.

Both tokenizers encode the text with one space before it. The tokens of a batch's documents lie in two flat arrays with
the byte offset of each token's end. A state vector holds a pointer into A and one into B for every lane; in one step
all lanes emit the link of their two tokens, emit a cut where both end at the same byte, and move on the pointer (or
both) whose token ends first; lanes that are done leave the vector. A lane is a document, or a run of `LANE` A tokens of a
longer one, whose B pointer is found by binary search: a batch takes no more steps than its longest lane.

Texts are encoded by chunks, cut where a character that isn't white space meets a space or a line feed: no token of
either vocabulary reaches over such a place (checked when B's is read; if one could, texts are encoded whole). A worker
keeps the ids of chunks up to a bound, then forgets them.

Scale: one pass over the texts leaves each document's figures and its distinct id pairs with their numbers, written to
the shared folder. Counts of pairs are added up before the shuffle. Pairs that hold more than one of `most_hot` links
(so fewer pairs than that) are broadcast, and so is each B id's highest count (no more rows than B has ids); all other
pairs meet their counts by a shuffled join, in which no key is hot. Links of a document are added up where they are read.
Rows: null and empty texts, and texts whose joined token bytes differ from space and text (a U+2581 in them), have no
tokens: zeros and ''. Null and repeated ids stay, each row for itself; an empty table gives no rows; other columns of the
table are not read. Very long texts are taken whole; a batch needs some 60 bytes of memory a byte.
"""

from __future__ import annotations

import functools
import hashlib
import json
import posixpath
import re
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bpe import byte_letters, texts_of

LANE = 512
FIGURES = "id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<{kind}>, times array<int>"
GROUPS = "id long, groups array<struct<start: long, stop: long, a: array<int>, b: array<int>>>"


class Tokenizers:
    """Tokenizer A, a byte-level file of the tokenizers library, and B, a file of sentencepiece, and what is known of chunks.

    A's file is read as ranks, by which tiktoken encodes several times faster, one short text at a time; that gives the
    same ids if ids grow along the merges, which is checked. Special tokens' strings are plain text.
    """

    def __init__(self, a_path: str, b_path: str, keep: int = 400_000):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        plain = {*made, *(model["vocab"][c] for c in byte_of)}
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in model["vocab"].items() if i in plain}
        if made != sorted(set(made)) or min(made) < max(ranks[bytes([b])] for b in range(256)):
            raise ValueError("ids of the byte-level vocabulary don't grow along its merges")
        self.a = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        tokens = {i: t for t, i in ranks.items()}
        self.a_bytes = [tokens.get(i, b"") for i in range(max(model["vocab"].values()) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        self.space = self.b.piece_to_id("▁")
        whole = any("▁" in p.lstrip("▁") or ("\n" in p and len(p) > 1) for p in pieces) or self.b.encode("\nx")[0] != self.space
        self.cut = re.compile("(?!)" if whole else r"(?<=\S)(?=[ \n])")
        self.strings = [f"{i}{end}" for n, ends in ((len(self.a_bytes), ",|"), (len(pieces), ",;")) for i in range(n) for end in ends]
        self.keep = keep
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.same = np.zeros(0, bool)
        self.ids = [(np.zeros(0, np.int64), np.zeros(1, np.int64))] * 2  # flat ids of all known chunks and where each begins

    def chunks(self, text: str) -> list[str]:
        """Space and text, cut into chunks; each begins with a space or a line feed."""
        return self.cut.split(" " + text)

    def encoded(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Each chunk's ids by A and by B, as within a text; B adds a space of its own, which a chunk's first space is."""
        b = self.b.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        b = [[self.space] if c == " " else ids if c[0] == " " else ids[1:] for c, ids in zip(chunks, b, strict=True)]
        return list(map(self.a.encode_ordinary, chunks)), b

    def learn(self, chunks: set[str]) -> None:
        if len(self.known) > self.keep:
            self.forget()
        new = sorted(chunks - self.known.keys())
        if not new:
            return
        both = self.encoded(new)
        self.known |= {c: k for k, c in enumerate(new, len(self.known))}
        raw = [c.encode() for c in new]
        same = np.ones(len(new), bool)
        for k, (many, tokens) in enumerate(zip(both, (self.a_bytes, self.b_bytes), strict=True)):
            (flat, at), size = self.ids[k], np.fromiter(map(len, many), np.int64, len(many))
            ids = list(chain.from_iterable(many))
            self.ids[k] = np.append(flat, np.array(ids, np.int64)), np.append(at, at[-1] + np.cumsum(size))
            same &= np.array([sum(map(len, map(tokens.__getitem__, x))) for x in many]) == np.array(list(map(len, raw)))
            if b"".join(map(tokens.__getitem__, ids)) != b"".join(raw):
                same &= np.array([b"".join(map(tokens.__getitem__, x)) == c for x, c in zip(many, raw, strict=True)])
        self.same = np.append(self.same, same)

    def batch(self, texts: list[str]) -> Batch:
        chunks = [self.chunks(t) if t else [] for t in texts]
        self.learn(set().union(*chunks))
        number = np.array(list(map(self.known.__getitem__, chain.from_iterable(chunks))), np.int64)
        doc = np.repeat(np.arange(len(texts)), [len(cs) for cs in chunks])
        bad = np.zeros(len(texts), bool)
        bad[doc[~self.same[number]]] = True  # bytes of some chunk differ
        number, doc = number[~bad[doc]], doc[~bad[doc]]
        out = []
        for flat, at in self.ids:
            size = at[number + 1] - at[number]
            ends = np.cumsum(size)
            out += [flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(at[number] - ends + size, size)], np.repeat(doc, size)]
        return Batch(self, len(texts), *out)


@functools.lru_cache(maxsize=2)
def tokenizers_of(a_path: str, b_path: str) -> Tokenizers:
    """One pair for each worker process."""
    return Tokenizers(a_path, b_path)


class Batch:
    """Aligned documents: flat ids and documents of both sides, cuts after tokens, links as pairs of token places."""

    def __init__(self, both: Tokenizers, n: int, a: np.ndarray, a_doc: np.ndarray, b: np.ndarray, b_doc: np.ndarray):
        self.both, self.n, self.a, self.a_doc, self.b, self.b_doc = both, n, a, a_doc, b, b_doc
        self.a_at, self.b_at = (np.searchsorted(doc, np.arange(n + 1)) for doc in (a_doc, b_doc))
        self.a_end, self.b_end = np.cumsum(both.a_size[a]), np.cumsum(both.b_size[b])
        self.a_cut, self.b_cut = np.zeros(len(a), bool), np.zeros(len(b), bool)
        self.link_a, self.link_b = self.merged()

    def merged(self, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
        """All links, by lockstep merging; cuts are marked in a_cut and b_cut."""
        size = np.diff(self.a_at)
        lanes = -(-size // lane)
        of = np.repeat(np.arange(self.n), lanes)
        i = self.a_at[of] + lane * (np.arange(len(of)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        stop = np.minimum(i + lane, self.a_at[of + 1])
        j = np.searchsorted(self.b_end, self.a_end[i] - self.both.a_size[self.a[i]], "right")
        links = [], []
        while len(i):
            links[0].append(i)
            links[1].append(j)
            x, y = self.a_end[i], self.b_end[j]
            cut = x == y
            self.a_cut[i[cut]] = self.b_cut[j[cut]] = True
            i, j = i + (x <= y), j + (x >= y)
            going = i < stop
            if not going.all():
                i, j, stop = i[going], j[going], stop[going]
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in links)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each document's distinct pairs begin, the pairs (A id times B's size plus B id), how often each is linked."""
        most = len(self.both.a_bytes) * len(self.both.b_bytes)
        key, times = np.unique(self.a_doc[self.link_a] * most + self.a[self.link_a] * len(self.both.b_bytes) + self.b[self.link_b], return_counts=True)
        return np.searchsorted(key, np.arange(self.n + 1) * most), key % most, times

    def digests(self) -> list[str]:
        """Of each document's groups as `a1,a2|b1;a3|b2,b3`; '' without tokens."""
        a_ends, b_ends = (np.append(0, np.flatnonzero(cut) + 1) for cut in (self.a_cut, self.b_cut))
        code = np.empty(len(self.a) + len(self.b), np.int64)
        code[np.arange(len(self.a)) + b_ends[np.cumsum(self.a_cut) - self.a_cut]] = 2 * self.a + self.a_cut
        code[np.arange(len(self.b)) + a_ends[np.cumsum(self.b_cut) - self.b_cut + 1]] = 2 * (len(self.both.a_bytes) + self.b) + self.b_cut
        at, text = (self.a_at + self.b_at).tolist(), self.both.strings.__getitem__
        return [hashlib.sha256("".join(map(text, code[s:e].tolist()))[:-1].encode()).hexdigest() if e > s else "" for s, e in zip(at, at[1:], strict=False)]

    def figures(self, ids: pa.Array, kind: pa.DataType) -> pa.RecordBatch:
        at, key, times = self.pairs()
        groups = np.bincount(self.a_doc[self.a_cut], minlength=self.n)
        links = np.bincount(self.a_doc[self.link_a], minlength=self.n)
        pairs, times = (pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, t)) for x, t in ((key, kind), (times, pa.int32())))
        columns = [ids, *(pa.array(x, pa.int64()) for x in (np.diff(self.a_at), np.diff(self.b_at), groups, links)), pa.array(self.digests(), pa.string()), pairs, times]
        return pa.RecordBatch.from_arrays(columns, names=["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    def groups(self, ids: pa.Array) -> pa.RecordBatch:
        """Each document's groups: byte range in space and text, ids of A and of B."""
        a_ends, b_ends = (np.append(0, np.flatnonzero(cut) + 1) for cut in (self.a_cut, self.b_cut))
        stop = self.a_end[a_ends[1:] - 1]
        at = np.searchsorted(a_ends[1:], self.a_at[:-1], "right")  # the first group of each document
        first = np.append(0, stop)[at]
        start = np.append(0, stop)[:-1]
        shift = first[self.a_doc[a_ends[1:] - 1]]
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for ends, x in ((a_ends, self.a), (b_ends, self.b))]
        rows = pa.StructArray.from_arrays([pa.array(start - shift), pa.array(stop - shift), *lists], names=["start", "stop", "a", "b"])
        return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(np.append(at, len(stop)), pa.int32()), rows)], names=["id", "groups"])


def _over(docs: DataFrame, a_path: str, b_path: str, make, schema: str, id_col: str, text_col: str) -> DataFrame:
    common.share_code(docs.sparkSession)

    def work(batches):
        both = tokenizers_of(a_path, b_path)
        for batch in common.slices(batches, 1):
            yield make(both.batch(texts_of(batch, 1)), batch.column(0))

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(work, schema)


def groups(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, groups): each text's groups of tokens between common boundaries, with byte ranges in space and text."""
    return _over(docs, a_path, b_path, lambda found, ids: found.groups(ids.cast(pa.int64())), GROUPS, id_col, text_col)


def figures(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's figures and its distinct linked id pairs with their numbers."""
    both = tokenizers_of(a_path, b_path)
    small = len(both.a_bytes) * len(both.b_bytes) < 1 << 31
    kind = pa.int32() if small else pa.int64()
    return _over(docs, a_path, b_path, lambda found, ids: found.figures(ids.cast(pa.int64()), kind), FIGURES.format(kind="int" if small else "bigint"), id_col, text_col)


def pair_counts(links: DataFrame, b_ids: int) -> DataFrame:
    """(pair, count, best): how many links hold each id pair; best where no pair of its B id has more."""
    counts = common.cut(links.groupBy("pair").agg(F.sum("times").alias("count")))
    highest = counts.groupBy((F.col("pair") % b_ids).alias("b")).agg(F.max("count").alias("highest"))  # at most b_ids rows
    return counts.join(F.broadcast(highest), F.col("pair") % b_ids == F.col("b")).select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def aligned(docs: DataFrame, a_path: str, b_path: str, most_hot: int = 1 << 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    spark = docs.sparkSession
    path = posixpath.join(common.shared_dir(spark), f"alignment-{uuid.uuid4().hex}")
    figures(docs, a_path, b_path, id_col, text_col).withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    found = spark.read.parquet(path)
    links = found.select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    counts = pair_counts(links, len(tokenizers_of(a_path, b_path).b_bytes))
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    many = F.col("count") * most_hot > total  # holds for fewer than most_hot pairs
    hot, rest = F.broadcast(counts.where(many)), counts.where(~many)
    sums = F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum")
    parts = links.join(hot, "pair").groupBy("row").agg(*sums).unionByName(links.join(hot, "pair", "left_anti").join(rest, "pair").groupBy("row").agg(*sums))
    whole = parts.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    added = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")]
    return found.join(whole, "row", "left").select("id", "n_a", "n_b", "n_groups", "n_links", *added, "groups_sha256")


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents")
    return aligned(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")
