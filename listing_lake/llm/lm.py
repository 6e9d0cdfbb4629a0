"""Interpolated modified Kneser-Ney bigram model: counted in Spark, stored as sorted hash arrays, mapped by workers.

Tokens are words (A-Z lower-cased, cut at ASCII white space) as 64-bit hashes, then one end of text; the first
token's context is the start of text. Two words of a corpus share a hash by chance only, once in some billions of
different words; counts have 64 bits. Tasks count distinct tokens and bigrams of a batch before the shuffle and send
them as packed arrays, dealt by hash into shards of bounded size. A shard of bigrams holds whole contexts, so it has
all that a context's discounts and back-off weight need; contexts with very many tokens are spread over all shards
and added up in a last step. Scoring maps the shards' arrays and looks a batch's distinct bigrams up by binary search.

p(w | u) = max(c(u w) - D(c(u w)), 0) / c(u) + gamma(u) * p(w), with p(w) from the numbers of contexts of w in the
same way over the uniform distribution of the vocabulary and one unknown word. D are the three modified discounts
from counts of counts, by order; a discount that these can't give (a zero count of counts) is half its count.

The order is two: with three the distinct trigrams (80 % of all tokens on the test documents) would not fit the disk
the check tool allows. Rows: a null or empty text is its end alone; null ids and repeated rows are scored each and
learned each; with nothing to learn from, every token has the probability of an unknown word, one. A text of any
length is taken whole, in arrays of about a hundred bytes for each of its bytes. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays, common

START, END = np.uint64(0x5BD1E995A5A5A5A5), np.uint64(0xC2B2AE3D27D4EB4F)
BATCH = 2 << 20
FOLDS, HELD_OUT = 5, 1


def word_hashes(data: np.ndarray, first: np.ndarray, size: np.ndarray, long: int = 256) -> np.ndarray:
    """64-bit hashes of words, eight bytes at a time; of longer words than `long` bytes the rest by xxh3.

    data must go on for eight bytes after the last word. Every step is one-to-one in what it takes in.
    """
    w, h = arrays.words(data), size.astype(np.uint64)
    left, k = np.arange(len(first)), 0
    while len(left) and 8 * k < long:
        rest = np.minimum(size[left] - 8 * k, 8)
        mine = w[first[left] + 8 * k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (64 - 8 * rest).astype(np.uint64))
        h[left] = arrays.stirred(h[left], mine, k)
        k += 1
        left = left[size[left] > 8 * k]
    for i in left.tolist():
        h[i] ^= np.uint64(xxhash.xxh3_64_intdigest(data[first[i] + 8 * k : first[i] + size[i]].tobytes()))
    return arrays.mix(h)


def tokens(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text) of the tokens of some texts, end of text included, in order; the hash is of a word's bytes."""
    lo, hi = int(ends[0]), int(ends[-1])
    data, ends = data[lo:hi], ends - lo
    n = len(data)
    low = np.zeros(n + 8, np.uint8)
    low[:n] = np.where((data >= 65) & (data <= 90), data | 32, data)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(n + 1, bool)
    edge[ends] = True
    starts = np.nonzero(word & (np.append(True, ~word[:-1]) | edge[:-1]))[0] if n else np.zeros(0, np.int64)
    stops = np.nonzero(word & (np.append(~word[1:], True) | edge[1:]))[0] + 1 if n else np.zeros(0, np.int64)
    hashes = word_hashes(low, starts, stops - starts)
    text = np.searchsorted(ends, starts, "right") - 1
    n = len(ends) - 1
    at = np.searchsorted(text, np.arange(n), "right")  # an end after each text's words
    return np.insert(hashes, at, END), np.insert(text, at, np.arange(n))


def contexts(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The token before each token; the start of text before the first."""
    before = np.empty_like(hashes)
    before[1:] = hashes[:-1]
    before[np.append(True, text[1:] != text[:-1])[: len(hashes)]] = START
    return before


def pair(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return arrays.mix(u * np.uint64(0xD6E8FEB86659FD93) + w)


def _send(shard: np.ndarray, n: int, *columns: np.ndarray) -> list[tuple]:
    """Rows (shard, bytes of each column) of columns that are cut by shard."""
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(n + 1))
    columns = [c[order] for c in columns]
    return [(s, *(c[a:b].tobytes() for c in columns)) for s, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a]


def merged_pairs(u: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs by context, with summed counts."""
    order = np.lexsort((w, u))
    u, w, n = u[order], w[order], n[order]
    starts = arrays.heads(u, w)
    return u[starts], w[starts], np.add.reduceat(n.astype(np.int64), starts)


def _send_pairs(n_shards: int, shard: np.ndarray, u: np.ndarray, w: np.ndarray, n: np.ndarray) -> list[tuple]:
    """Rows (shard, distinct contexts, pairs of each, words, counts): a context is sent once for all its pairs."""
    order = np.lexsort((w, u, shard))
    shard, u, w, n = shard[order], u[order], w[order], n[order]
    starts = arrays.heads(u, w, shard)
    shard, u, w, n = shard[starts], u[starts], w[starts], np.add.reduceat(n, starts).astype("<u4")  # of some million tokens
    cuts = np.searchsorted(shard, np.arange(n_shards + 1)).tolist()
    out = []
    for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if b > a:
            heads = arrays.heads(u[a:b])
            run = np.diff(np.append(heads, b - a)).astype("<u4")
            out.append((s, u[a:b][heads].tobytes(), run.tobytes(), w[a:b].tobytes(), n[a:b].tobytes()))
    return out


def _join(blobs: pd.Series, kind: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in blobs]) if len(blobs) else np.zeros(0, kind)


def discounts(counts_of_counts: list[int]) -> list[float]:
    """D1, D2 and D3+ from the numbers of n-grams counted once, twice, three and four times."""
    n = counts_of_counts
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0.5
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), float(k)) if n[k - 1] and n[k] else k / 2 for k in (1, 2, 3)]


def _classes(counts: np.ndarray) -> np.ndarray:
    return np.minimum(counts, 3).astype(np.int64)


class Model:
    """A fitted model: its folder, shards and the few numbers that go with it; workers open the arrays.

    hot: sorted hashes of the contexts that are spread over all shards; hot_rows: their total and their numbers of
    followers seen once, twice and more often.
    """

    def __init__(self, folder: str, shards: int, hot: np.ndarray, hot_rows: np.ndarray, n: int, v: int, low: list[float], high: list[float], types: int, low_gamma: float):
        self.folder, self.shards, self.hot, self.hot_rows, self.n, self.v = folder, shards, hot, hot_rows, n, v
        self.low, self.high, self.types, self.low_gamma = np.array([0.0, *low]), np.array([0.0, *high]), types, low_gamma

    def log10(self, hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability, training count) of each token."""
        words, inverse = np.unique(hashes, return_inverse=True)
        of = arrays.shard_of(words, self.shards)
        count = arrays.look_up(self.folder, "word", of, words, count=0)["count"]
        cont = arrays.look_up(self.folder, "low", of, words, contexts=0)["contexts"]
        low = np.full(len(words), self.low_gamma / (self.v + 1))
        if self.types:
            low += np.maximum(cont - self.low[_classes(cont)], 0) / self.types
        before = contexts(hashes, text)
        us, ui = np.unique(before, return_inverse=True)
        got = arrays.look_up(self.folder, "context", arrays.shard_of(us, self.shards), us, total=0, once=0, twice=0, more=0)
        rows = np.stack([got[f] for f in ("total", "once", "twice", "more")], axis=1)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, us), len(self.hot) - 1)
            rows[self.hot[at] == us] = self.hot_rows[at[self.hot[at] == us]]
        total = np.maximum(rows[:, 0], 1)
        gamma = np.where(rows[:, 0] > 0, rows[:, 1:] @ self.high[1:] / total, 1.0)
        keys, first, back = np.unique(pair(before, hashes), return_index=True, return_inverse=True)
        n = arrays.look_up(self.folder, "pair", pair_shard(self.hot, self.shards, before[first], keys), keys, n=0)["n"]
        share = np.maximum(n - self.high[_classes(n)], 0)
        return np.log10(share[back] / total[ui] + gamma[ui] * low[inverse]), count[inverse]


def pair_shard(hot: np.ndarray, shards: int, u: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A context's pairs lie in one shard; those of the hot contexts (sorted) in all."""
    spread = np.isin(u, hot) if len(hot) else np.zeros(len(u), bool)
    return arrays.shard_of(np.where(spread, key, u), shards)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bytes_per_shard: int = 16 << 20) -> Model:
    """Count and store a model of every whole text of docs."""
    spark = docs.sparkSession
    common.share_code(spark)
    folder = common.mounted_dir(spark, "lm")
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = common.tuned_groups(size, bytes_per_shard)

    def batches_of(batches):
        for batch in common.slices(batches, 0, BATCH):
            yield tokens(*common.utf8(batch.column(0)))

    def gathered(batches, make, *kinds):
        """make() of each batch, sent when about a million rows are there."""
        held: list[list[np.ndarray]] = []

        def flush():
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            rows = _send_pairs(shards, *columns) if len(kinds) == 4 else _send(columns[0], shards, *columns[1:])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * len(kinds)), strict=True)], names=["shard", *kinds])

        for hashes, text in batches_of(batches):
            held.append(make(hashes, text))
            if sum(len(x[0]) for x in held) > 1_000_000:
                yield from flush()
        if held:
            yield from flush()

    def count_words(batches):
        def make(hashes, text):
            keys, n = np.unique(hashes, return_counts=True)
            return [arrays.shard_of(keys, shards), keys, n.astype("<u4")]

        yield from gathered(batches, make, "keys", "n")

    def store_words(key, rows: pd.DataFrame) -> pd.DataFrame:
        keys, n = arrays.summed(_join(rows["keys"], "<u8"), _join(rows["n"], "<u4"))
        arrays.write(folder, "word", int(key[0]), keys, count=arrays.small(n))
        top = np.argsort(-n, kind="stable")[: 4 * shards]
        top = top[n[top] > 10_000]
        return pd.DataFrame({"n": [int(n.sum())], "v": [len(keys)], "hot": [keys[top].tobytes()], "hot_n": [n[top].astype("<i8").tobytes()]})

    found = texts.mapInArrow(count_words, "shard int, keys binary, n binary").repartition(shards, "shard").groupBy("shard").applyInPandas(store_words, "n long, v long, hot binary, hot_n binary")
    n = v = 0
    names, weights = [np.zeros(0, "<u8")], [np.zeros(0, "<i8")]
    for r in common.cut(found).toLocalIterator():  # two numbers and the commonest words of each shard
        n, v = n + r.n, v + r.v
        names.append(np.frombuffer(r.hot, "<u8"))
        weights.append(np.frombuffer(r.hot_n, "<i8"))
        if sum(map(len, names)) > 16 * shards + 64:
            names, weights = [np.concatenate(names)], [np.concatenate(weights)]
            keep = np.argsort(-weights[0], kind="stable")[: 4 * shards]
            names, weights = [names[0][keep]], [weights[0][keep]]
    keys, weights = np.concatenate(names), np.concatenate(weights)
    hot = np.sort(np.append(keys[weights * 4 * shards > n], START))  # at most 4 x shards words

    def count_pairs(batches):
        def make(hashes, text):
            u = contexts(hashes, text)
            keys, first, n = np.unique(pair(u, hashes), return_index=True, return_counts=True)
            return [pair_shard(hot, shards, u[first], keys), u[first], hashes[first], n]

        yield from gathered(batches, make, "u", "run", "w", "n")

    def merge_pairs(key, rows: pd.DataFrame) -> pd.DataFrame:
        u = np.repeat(_join(rows["u"], "<u8"), _join(rows["run"], "<u4"))
        u, w, n = merged_pairs(u, _join(rows["w"], "<u8"), _join(rows["n"], "<u4"))
        shard = int(key[0])
        names = pair(u, w)
        order = np.argsort(names)
        arrays.write(folder, "pair", shard, names[order], n=arrays.small(n[order]))
        of_counts = np.bincount(np.minimum(n, 5), minlength=6)[1:5].tolist()
        heads = arrays.heads(u)
        facts = [np.add.reduceat(x, heads) for x in (n, *((_classes(n) == c).astype(np.int64) for c in (1, 2, 3)))]
        spread = np.isin(u[heads], hot)
        arrays.write(folder, "context", shard, u[heads][~spread], **{f: arrays.small(x[~spread]) for f, x in zip(("total", "once", "twice", "more"), facts, strict=True)})
        hot_rows = (u[heads][spread], *(x[spread].astype("<i8") for x in facts))
        words, times = arrays.summed(w, np.ones(len(w), np.int64))
        common.give_back()
        out = [{"kind": 0, "shard": shard, "of_counts": of_counts, "blobs": [x.tobytes() for x in hot_rows]}]
        out += [{"kind": 1, "shard": s, "of_counts": [], "blobs": [a, b]} for s, a, b in _send(arrays.shard_of(words, shards), shards, words, times.astype("<u4"))]
        return pd.DataFrame(out)

    merged = texts.mapInArrow(count_pairs, "shard int, u binary, run binary, w binary, n binary").repartition(shards, "shard").groupBy("shard").applyInPandas(merge_pairs, "kind int, shard int, of_counts array<long>, blobs array<binary>")
    merged = common.cut(merged)

    def store_low(key, rows: pd.DataFrame) -> pd.DataFrame:
        keys, n = arrays.summed(np.concatenate([np.frombuffer(x[0], "<u8") for x in rows["blobs"]]), np.concatenate([np.frombuffer(x[1], "<u4") for x in rows["blobs"]]))
        arrays.write(folder, "low", int(key[0]), keys, contexts=arrays.small(n))
        c = np.bincount(np.minimum(n, 5), minlength=6)
        return pd.DataFrame({"types": [int(n.sum())], "of_counts": [c[1:5].tolist()], "over": [[int((_classes(n) == k).sum()) for k in (1, 2, 3)]]})

    low = merged.where("kind = 1").select("shard", "blobs").repartition(shards, "shard").groupBy("shard").applyInPandas(store_low, "types long, of_counts array<long>, over array<long>")
    add = lambda c, k: F.coalesce(F.sum(F.element_at(c, k)), F.lit(0))
    row = low.agg(F.coalesce(F.sum("types"), F.lit(0)), *(add("of_counts", k) for k in (1, 2, 3, 4)), *(add("over", k) for k in (1, 2, 3))).first()
    types, d1, over = row[0], discounts(list(row[1:5])), list(row[5:8])
    low_gamma = sum(d * o for d, o in zip(d1, over, strict=True)) / types if types else 1.0
    d2 = discounts(list(merged.where("kind = 0").agg(*(add("of_counts", k) for k in (1, 2, 3, 4))).first()))
    hot_rows = np.zeros((len(hot), 4), np.int64)
    for r in merged.where("kind = 0").select("blobs").toLocalIterator():  # at most 4 x shards contexts of each shard
        u, *facts = (np.frombuffer(x, "<u8" if i == 0 else "<i8") for i, x in enumerate(r.blobs))
        hot_rows[np.searchsorted(hot, u)] += np.stack(facts, axis=1)
    return Model(folder, shards, hot, hot_rows, n, v, d1, d2, types, low_gamma)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score, perplexity) of every whole text."""
    common.share_code(docs.sparkSession)

    def work(batches):
        for batch in common.slices(batches, 1, BATCH):
            hashes, text = tokens(*common.utf8(batch.column(1)))
            logs, counts = model.log10(hashes, text)
            base = np.log10((counts + 0.5) / (model.n + 0.5 * (model.v + 1)))
            rows = batch.num_rows
            add = lambda x: np.bincount(text, weights=x, minlength=rows)
            n, known, score = add(np.ones(len(text))).astype(np.int64), add(counts > 0).astype(np.int64), add(logs)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *map(pa.array, (n, known, add(base), score, 10 ** (-score / n)))], names=["id", "n_tokens", "n_known", "base_score", "score", "perplexity"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, "id long, n_tokens long, n_known long, base_score double, score double, perplexity double")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs.where(common.fold_of("doc_id", FOLDS) != HELD_OUT))
    out = scored(docs, model)
    return out.select(F.col("id").alias("doc_id"), (common.fold_of("id", FOLDS) == HELD_OUT).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
