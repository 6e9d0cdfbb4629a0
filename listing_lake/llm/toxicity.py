"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes.

Fitting takes a bounded sample of labelled rows (`most_examples`, the lowest hashes of their ids); of equal texts one
is an example. Terms are all words that at least `least_docs` examples have. A term weighs (1 + log of its count) times
its IDF over all documents times the chi-square of its document frequency among toxic examples against all examples, so
words that say nothing about the label count little; none is left out. All examples are indexed, and a query's vector
has all its terms. So the index is bounded by the sample's texts and may go to every worker; scoring covers every
whole text.

The index: examples lie in blocks; each term has its postings, its largest weight, and the largest in each block that
has it. A query's terms are traversed from the largest bound (its weight times the term's largest) on. When the
k-th best sum so far is known, only examples can still come in whose sum plus their block's bound on the terms left
reaches it; when these are few, they are probed by their own vectors, else the other postings are traversed as well.
Lists of very frequent terms are full arrays. So the k neighbours are exact (ties: smaller example number). A neighbour at cosine c votes with weight 1 / (1 - c + spread); `prior_votes` of the share of toxic
examples are added, which also is the score of a text without known terms. Scores are shares of votes, between 0 and 1.

Rows: null texts are empty ones and score the prior; null ids and repeated rows stay; labelled rows whose document is
missing or whose label is null teach nothing, of several labels of one id the highest counts; without examples every
score is 0. Columns of other names stay as they are. A text of any length is taken whole.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bpe import texts_of

_WORD = re.compile(r"[^\W\d_]+")
FOLDS, HELD_OUT, REJECT = 4, 2, 0.3
FIRST_POSTINGS, FULL = 4096, 16  # a term of a sixteenth of all examples has a full list, with zeros
SLACK = 4e-6  # more than the last digits of sums in single precision; what is kept is summed again in double


def counts_of(text: str) -> Counter:
    return Counter(_WORD.findall(text.lower()))


@dataclass
class Index:
    """Examples as sparse rows of unit length, their postings by term, and the largest weights by term and block.

    Examples' weights are kept in single precision, cosines are summed in double.
    """

    terms: dict[str, int]
    weight: np.ndarray  # of each term, without its count
    ids: np.ndarray
    labels: np.ndarray
    rows: np.ndarray  # example, term and weight of each entry, by example and term
    cols: np.ndarray
    values: np.ndarray
    prior: float
    size: int = 64
    k: int = 24
    prior_votes: float = 1.0
    spread: float = 0.05

    def __getstate__(self) -> dict:
        """What is sent to workers; they make postings and bounds of it."""
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def __post_init__(self) -> None:
        n_terms, self.blocks = len(self.weight), -(-len(self.ids) // self.size)
        self.row_ends = np.searchsorted(self.rows, np.arange(len(self.ids) + 1))
        order = np.lexsort((self.rows, self.cols))  # postings: by term, then example
        self.values = self.values.astype(np.float32)
        self.posted, self.posted_values = self.rows[order].astype(np.int64), self.values[order].astype(np.float64)  # as they are counted
        self.ends = np.searchsorted(self.cols[order], np.arange(n_terms + 1))
        place = self.cols[order].astype(np.int64) * max(self.blocks, 1) + self.posted // self.size
        heads = np.flatnonzero(np.append(True, place[1:] != place[:-1])[: len(place)])
        self.block_most = np.maximum.reduceat(self.posted_values, heads) if len(heads) else np.zeros(0)
        self.block = place[heads] % max(self.blocks, 1)
        self.block_ends = np.searchsorted(place[heads] // max(self.blocks, 1), np.arange(n_terms + 1))
        self.most = np.zeros(n_terms)
        np.maximum.at(self.most, self.cols, self.values)
        self.row_length = len(self.cols) / max(len(self.ids), 1)
        often = np.flatnonzero(np.diff(self.ends) * FULL > len(self.ids))
        self.full = np.zeros((len(often), len(self.ids)), np.float32)
        self.full_of = np.full(n_terms, -1)
        self.full_of[often] = np.arange(len(often))
        at = self.full_of[self.cols] >= 0
        self.full[self.full_of[self.cols[at]], self.rows[at]] = self.values[at]
        self.scratch = np.zeros(n_terms)  # one query by term, empty between calls

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """(terms ascending, TF-IDF weights of unit length)."""
        found = [(t, n) for word, n in counts.items() if (t := self.terms.get(word)) is not None]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0)
        t, n = np.array(found, np.int64).T
        order = np.argsort(t)
        t, w = t[order], ((1 + np.log(n)) * self.weight[t])[order]
        norm = np.sqrt((w * w).sum())
        return (t[w > 0], w[w > 0] / norm) if norm > 0 else (np.zeros(0, np.int64), np.zeros(0))

    def cosines(self, examples: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Of some examples with a query given for all terms, by the examples' own vectors."""
        starts, n = self.row_ends[examples], self.row_ends[examples + 1] - self.row_ends[examples]
        at = np.arange(int(n.sum())) + np.repeat(starts - (np.cumsum(n) - n), n)
        return np.bincount(np.repeat(np.arange(len(examples)), n), self.values[at].astype(np.float64) * query[self.cols[at]], len(examples))

    def _traversed(self, terms: np.ndarray, weights: np.ndarray, lengths: np.ndarray, work: dict | None) -> np.ndarray:
        """Each example's sum over some terms."""
        full = self.full_of[terms]
        some = full < 0
        lists = [slice(self.ends[t], self.ends[t + 1]) for t in terms[some].tolist()]
        sums = np.zeros(len(self.ids))
        if lists:
            found = np.concatenate([self.posted[x] for x in lists])
            sums += np.bincount(found, np.concatenate([self.posted_values[x] for x in lists]) * np.repeat(weights[some], lengths[some]), len(self.ids))
        if not some.all():
            sums += weights[~some].astype(np.float32) @ self.full[full[~some]]
        if work is not None:
            work["postings"] = work.get("postings", 0) + int(lengths.sum())
        return sums

    def _least(self, sums: np.ndarray) -> float:
        """The k-th best sum."""
        return float(np.partition(sums, len(sums) - self.k)[len(sums) - self.k]) if len(sums) > self.k else 0.0

    def nearest(self, terms: np.ndarray, weights: np.ndarray, work: dict | None = None) -> list[tuple[int, float]]:
        """The k examples of highest cosine over zero, with the cosine. work, if given, counts postings and probes."""
        n = len(self.ids)
        if not len(terms) or not n:
            return []
        order = np.argsort(-weights * self.most[terms], kind="stable")
        terms, weights = terms[order], weights[order]
        lengths = self.ends[terms + 1] - self.ends[terms]
        upto = np.cumsum(lengths)
        # essential terms: those with the largest bounds
        essential = max(1, int(np.searchsorted(upto, FIRST_POSTINGS, "right")))
        sums = self._traversed(terms[:essential], weights[:essential], lengths[:essential], work)
        least = self._least(sums)
        near = None
        if (weights[essential:] * self.most[terms[essential:]]).sum() < 2 * least:  # else no block is out of reach
            rest = terms[essential:].tolist()
            blocks = [slice(self.block_ends[t], self.block_ends[t + 1]) for t in rest] or [slice(0, 0)]
            bounds = np.concatenate([self.block_most[x] for x in blocks]) * np.repeat(weights[essential:], [x.stop - x.start for x in blocks][: len(rest)])
            bound = np.bincount(np.concatenate([self.block[x] for x in blocks]), bounds, self.blocks)
            near = np.flatnonzero(sums + np.repeat(bound, self.size)[:n] >= least - SLACK)
            if len(near) * self.row_length > upto[-1] - upto[essential - 1]:
                near = None  # probing them would cost more than the other postings
        if near is None:
            if essential < len(terms):
                sums += self._traversed(terms[essential:], weights[essential:], lengths[essential:], work)
            least = self._least(sums)
            near = np.flatnonzero(sums >= least - SLACK if least > SLACK else sums > 0)
        if work is not None:
            work["probed"] = work.get("probed", 0) + len(near)
        self.scratch[terms] = weights
        c = self.cosines(near, self.scratch)
        self.scratch[terms] = 0.0
        best = np.lexsort((near, -c))[: self.k]
        return [(int(near[i]), float(min(c[i], 1.0))) for i in best if c[i] > 0]

    def score(self, near: list[tuple[int, float]]) -> float:
        votes, toxic = self.prior_votes, self.prior_votes * self.prior
        for n, c in near:
            w = 1 / (1 - c + self.spread)
            votes, toxic = votes + w, toxic + w * self.labels[n]
        return float(toxic / votes)


def fit(docs: DataFrame, labels: DataFrame, most_examples: int = 4000, least_docs: int = 2, block: int = 64, seed: int = 7) -> Index:
    """Learn from labels (doc_id, toxic); the caller has taken out the rows that aren't for learning."""
    common.share_code(docs.sparkSession)
    chosen = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    chosen = chosen.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(most_examples)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    taught = texts.join(F.broadcast(chosen), "id").select("id", "toxic", F.coalesce("text", F.lit("")).alias("text"))  # most_examples rows of two numbers
    once = common.cut(taught.groupBy("text").agg(F.min("id").alias("id"), F.max((F.col("toxic") != 0).cast("int")).alias("toxic")).select("id", "toxic", "text"))
    n_toxic, n = once.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()

    def seen(batches):
        for batch in common.slices(batches, 2):
            df = (Counter(), Counter())
            for y, text in zip(batch.column(1).to_pylist(), texts_of(batch, 2), strict=True):
                df[y].update(set(_WORD.findall(text.lower())))
            every = sorted(df[0].keys() | df[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *(pa.array([d[t] for t in every], pa.int64()) for d in df)], names=["term", "clean", "toxic"])

    found = once.mapInArrow(seen, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    found = found.where(F.col("clean") + F.col("toxic") >= least_docs).toArrow().sort_by("term")  # words of most_examples texts
    number = {t: i for i, t in enumerate(found.column("term").to_pylist())}
    clean, toxic = (found.column(c).to_numpy().astype(float) for c in ("clean", "toxic"))

    def having(batches):
        held, texts = np.zeros(len(number), np.int64), 0
        for batch in common.slices(batches, 0):
            for text in texts_of(batch, 0):
                held[[t for w in set(_WORD.findall(text.lower())) if (t := number.get(w)) is not None]] += 1
            texts += batch.num_rows
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(held[at], texts))], names=["t", "n"])

    weight = np.zeros(len(number))
    if len(number):
        of = texts.select("text").mapInArrow(having, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
        held, times = of.column("t").to_numpy(), of.column("n").to_numpy()
        df = np.zeros(len(number))
        df[held[held >= 0]] = times[held >= 0]
        weight = np.log((1 + times[held < 0].sum()) / (1 + df)) * chi_square(clean, toxic, n - n_toxic, n_toxic)
    none = np.zeros(0, np.int64)
    empty = Index(number, weight, none, np.zeros(0), none, none, np.zeros(0, np.float32), 0.0, block)

    def vectors(batches):
        for batch in common.slices(batches, 2):
            rows = [empty.vector(counts_of(t)) for t in texts_of(batch, 2)]
            columns = [pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1].astype(np.float32) for r in rows], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["id", "toxic", "t", "w"])

    rows = once.mapInArrow(vectors, "id long, toxic int, t array<int>, w array<float>").collect() if n else []  # most_examples vectors
    heaviest = lambda r: tuple(t for _, t in sorted(zip(r.w, r.t, strict=True), key=lambda x: (-x[0], x[1]))[:4])
    rows.sort(key=lambda r: (heaviest(r), r.id))  # like examples share blocks
    sizes = [len(r.t) for r in rows]
    joined = lambda parts, kind: np.concatenate([np.zeros(0, kind), *(np.array(x, kind) for x in parts)])
    entries = np.repeat(np.arange(len(rows)), sizes).astype(np.int32), joined((r.t for r in rows), np.int32), joined((r.w for r in rows), np.float32)
    return Index(number, weight, np.array([r.id for r in rows], np.int64), np.array([r.toxic for r in rows], np.float64), *entries, n_toxic / n if n else 0.0, block)


def chi_square(clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int) -> np.ndarray:
    """How far a term's share of toxic examples is from that of all, squared, in units of chance."""
    both, base = clean + toxic, n_toxic / max(n_clean + n_toxic, 1)
    return (toxic - both * base) ** 2 / np.maximum(both * base * (1 - base), 1e-9)


def _judged(index: Index, cache: dict, text: str) -> tuple[float, list[tuple[int, float]]]:
    """(score, neighbours) of a text; copies are asked once."""
    key = xxhash.xxh3_128_digest(text.encode())
    if key not in cache:
        if len(cache) > 50_000:
            cache.clear()
        near = index.nearest(*index.vector(counts_of(text)))
        cache[key] = index.score(near), near
    return cache[key]


def score(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, evidence): evidence is the neighbours' example ids, cosines and labels, nearest first."""
    spark = docs.sparkSession
    common.share_code(spark)
    sent = spark.sparkContext.broadcast(index)  # bounded: most_examples texts

    def work(batches):
        index = sent.value
        judged = functools.partial(_judged, index, {})
        kind = pa.list_(pa.struct([("id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
        for batch in common.slices(batches, 1):
            found = [judged(text) for text in texts_of(batch, 1)]
            evidence = [[{"id": int(index.ids[n]), "cosine": c, "toxic": int(index.labels[n])} for n, c in near] for _, near in found]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([s for s, _ in found], pa.float64()), pa.array(evidence, kind)], names=["id", "score", "evidence"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(work, "id long, score double, evidence array<struct<id: long, cosine: double, toxic: int>>")


def without_toxic(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """The documents, with their columns as they are, that score below `reject`; texts cross no shuffle."""
    common.share_code(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(index)
    rows, n = common.carried(docs, id_col, text_col)
    flag = common.free_name(docs, "toxicity")

    def work(batches):
        judged = functools.partial(_judged, sent.value, {})
        for batch in common.slices(batches, n + 1):
            yield common.appended(batch, n, **{flag: pa.array([judged(t)[0] for t in texts_of(batch, n + 1)], pa.float64())})

    return rows.mapInArrow(work, common.widened(docs, **{flag: "double"})).where(F.col(flag) < reject).drop(flag)


def training_labels(labels: DataFrame) -> DataFrame:
    """The labelled rows to learn from: crc32 of the id modulo 4 is not 2."""
    return labels.where(common.fold_of("doc_id", FOLDS) != HELD_OUT)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    index = fit(docs, training_labels(common.table(spark, sf_dir, "labels")))
    out = score(docs, index)
    return out.select(F.col("id").alias("doc_id"), (common.fold_of("id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"), F.transform("evidence", lambda e: e["id"]).alias("evidence"))
