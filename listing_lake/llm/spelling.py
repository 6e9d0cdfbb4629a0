"""Spelling variants: words one inserted, deleted or replaced code point apart, grouped below their common form.

Two words one edit apart agree in a prefix and a suffix that together reach the longer length minus one, so one of the
two has at least half of that. Rows are dealt by that half: for each length m of the longer word, words of m and m - 1
code points meet by their first m // 2 or by their last m // 2. Within such a group words lie in padded matrices of
code points, left-aligned and right-aligned, and blocks of rows are compared with blocks of rows: columns are matched
from the front and from the back while any pair is still alike, and the two counts decide. A pair that has the prefix
counts on the prefix's side only, so none counts twice.

Scale: words are counted in the JVM, with partial counts before the shuffle; what follows has one row for each word.
A group of more words than a bound (by cells of the matrix, so fewer for long words) is cut into parts that meet in
pairs, each pair of parts a group of its own: no task has more than two parts in memory at a time. A tile leaves one row for each word,
not its pairs. Chains of forms are followed by doubling; n at least doubles along a chain, so there are few rounds.
Rows: null texts have no words; a null id counts as the text ''; repeated rows count as often as they are there; an
empty table gives no words. Words of any length are compared whole. Other columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LETTERS = "A-Za-z\\u00C0-\\u00FF"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a block, cells of the matrices in a worker's memory at a time, and words of a part at most.
BLOCK, CELLS, PART = 64, 1 << 21, 2048
NEAR = "word string, n_near long, best_n long, best string"


def runs(docs: DataFrame, least: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, run): every maximal run of letters with at least `least` code points, A to Z lower-cased."""
    text = F.translate(F.col(f"`{text_col}`").cast("string"), UPPER, LOWER)
    doc = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    return docs.select(doc.alias("doc"), F.explode(F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))).alias("run"))


def misspelt(doc: Column, run: Column, every: int = 97) -> Column:
    """The run without one code point where the checksum of document and run is divisible by `every`, else the run."""
    h = F.crc32(F.concat(doc, F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def counted(words: DataFrame, least_length: int = 5, least_n: int = 3) -> DataFrame:
    """(word, n) of the words with enough code points and occurrences."""
    return words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' code points left-aligned and right-aligned, a column each row of the result, padded with zeros; lengths."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    width = int(size.max())
    left, right = np.zeros((2, len(words), width), np.uint32)
    row = np.repeat(np.arange(len(words)), size)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    left[row, column] = flat
    right[row, np.repeat(size, size) - 1 - column] = flat
    return np.ascontiguousarray(left.T), np.ascontiguousarray(right.T), size


def common_length(columns: np.ndarray, x: np.ndarray, y: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """How many columns from the first on agree, for rows x by rows y of pairs of blocks, where alive."""
    alive, count = alive.copy(), np.zeros(alive.shape, np.int32)
    for column in columns:
        alive &= column[x][:, :, None] == column[y][:, None, :]
        if not alive.any():
            break
        count += alive
    return count


def tiles(words: list[str], group: np.ndarray, long: np.ndarray, half: np.ndarray, suffix: np.ndarray, part: np.ndarray, mixed: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, of words one edit apart within groups of consecutive rows.

    long: the longer length of the row's group, half: the length by which its words met, at the end where suffix.
    mixed: only rows of different parts meet.
    """
    left, right, size = matrices(words)
    n = len(words)
    blocks = -(-n // block)
    last = np.minimum(np.searchsorted(group, group[np.minimum(np.arange(1, blocks + 1) * block, n) - 1], "right"), n) - 1  # last row of the group that a block ends in
    reach = last // block - np.arange(blocks) + 1
    first = np.repeat(np.arange(blocks), reach)
    second = first + np.arange(len(first)) - np.repeat(np.cumsum(reach) - reach, reach)
    lane, found = np.arange(block), []
    for at in range(0, len(first), 64):
        x, y = ((b[at : at + 64, None] * block + lane) for b in (first, second))
        there = (x < n)[:, :, None] & (y < n)[:, None, :] & (x[:, :, None] < y[:, None, :])
        x, y = np.minimum(x, n - 1), np.minimum(y, n - 1)
        there &= group[x][:, :, None] == group[y][:, None, :]
        there &= np.maximum(size[x][:, :, None], size[y][:, None, :]) == long[x][:, :, None]
        there &= ~mixed[x][:, :, None] | (part[x][:, :, None] != part[y][:, None, :])
        if not there.any():
            continue
        front = common_length(left, x, y, there)
        there &= ~suffix[x][:, :, None] | (front < half[x][:, :, None])
        both = front + common_length(right, x, y, there)
        k, i, j = np.nonzero(there & (both >= long[x][:, :, None] - 1))
        found.append((x[k, i], y[k, j]))
    i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    different = np.fromiter((words[a] != words[b] for a, b in zip(i.tolist(), j.tolist(), strict=True)), bool, len(i))
    return i[different], j[different]


def best_of(words: list[str], n: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that have pairs, how many, and the partner of largest n (ties: the smallest word)."""
    a, b = np.append(i, j), np.append(j, i)
    used = np.unique(b)
    rank = np.empty(len(words), np.int64)
    rank[used[np.array(sorted(range(len(used)), key=lambda k: words[used[k]]), np.int64)]] = np.arange(len(used))
    order = np.lexsort((rank[b], -n[b], a))
    rows, at, count = np.unique(a[order], return_index=True, return_counts=True)
    return rows, count, b[order][at]


def dealt(words: DataFrame, cells: int = CELLS, most: int = PART) -> DataFrame:
    """Every word once for each group that it may meet a near word in, sorted by group within partitions."""
    spread = words.select("word", "n", F.char_length("word").alias("size"))
    spread = spread.select("*", F.explode(F.array("size", F.col("size") + 1)).alias("long"))
    spread = spread.withColumn("half", F.floor(F.col("long") / 2).cast("int")).select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("suffix"))
    at = F.when(F.col("suffix"), F.col("size") - F.col("half") + 1).otherwise(1)
    spread = spread.withColumn("shared", F.substring("word", at, F.col("half")))
    group = ["suffix", "long", "shared"]
    sizes = spread.groupBy(group).agg(F.count("*").alias("words"), F.max("size").alias("longest")).where("words > 1 and longest = long").drop("longest")
    bound = F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.lit(cells) / F.col("long"))))
    found = spread.join(sizes, group).withColumn("parts", F.ceil(F.col("words") / bound).cast("int"))
    found = found.withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")).select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    found = found.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})
    key = [*group, "low", "high"]
    return found.select(*key, "half", "part", "word", "n").repartition(*map(F.col, key)).sortWithinPartitions(*key, "word")


def grouped(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[tuple]:
    """The sorted rows as tables of whole groups, each of about `cells` cells or of one group, with the groups' numbers."""
    kept: list[pa.RecordBatch] = []

    def flush(rows: pa.Table, whole: bool):
        number = group_numbers(rows)
        width = rows["long"].to_numpy()
        starts = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
        ends = np.append(starts[1:], len(number))
        at = 0
        while at < len(starts) - (0 if whole else 1):
            wide = np.maximum.accumulate(width[starts[at:]]) * (ends[at:] - starts[at])
            to = max(at + 1, at + int(np.searchsorted(wide, cells, "right")))
            to = min(to, len(starts) - (0 if whole else 1))
            yield rows.slice(starts[at], ends[to - 1] - starts[at]), number[starts[at] : ends[to - 1]]
            at = to
        return rows.slice(starts[at]) if at < len(starts) else None

    size = 0
    for batch in batches:
        if batch.num_rows:
            kept.append(batch)
            size += int(pc.sum(batch.column("long")).as_py())
        if size >= cells:
            rest = yield from flush(pa.Table.from_batches(kept).combine_chunks(), False)
            kept = rest.to_batches() if rest is not None else []
            size = sum(int(pc.sum(b.column("long")).as_py()) for b in kept)
    if kept:
        yield from flush(pa.Table.from_batches(kept).combine_chunks(), True)


def group_numbers(rows: pa.Table) -> np.ndarray:
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for name in ("suffix", "long", "shared", "low", "high"):
        column = rows[name].combine_chunks()
        new[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return np.cumsum(new)


def _pairs_of(rows: pa.Table, number: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    words = rows["word"].to_pylist()
    column = {c: rows[c].to_numpy() for c in ("long", "half", "suffix", "part", "low", "high")}
    return words, *tiles(words, number, column["long"], column["half"], column["suffix"], column["part"], column["low"] != column["high"])


def near_pairs(words: DataFrame, cells: int = CELLS, most: int = PART) -> DataFrame:
    """(a, b), a < b: every pair of words one edit apart, once. words: (word, n), distinct words."""
    common.share_code(words.sparkSession)

    def work(batches):
        for rows, number in grouped(batches, cells):
            found, i, j = _pairs_of(rows, number)
            a, b = (pa.array([f(found[x], found[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)], pa.string()) for f in (min, max))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"])

    return dealt(words, cells, most).mapInArrow(work, "a string, b string")


def nearest(words: DataFrame, cells: int = CELLS, most: int = PART) -> DataFrame:
    """(word, n_near, best_n, best) of the words that have near words."""
    common.share_code(words.sparkSession)

    def work(batches):
        for rows, number in grouped(batches, cells):
            found, i, j = _pairs_of(rows, number)
            if len(i):
                n = rows["n"].to_numpy()
                at, count, best = best_of(found, n, i, j)
                yield pa.RecordBatch.from_arrays([pa.array([found[k] for k in at], pa.string()), pa.array(count, pa.int64()), pa.array(n[best], pa.int64()), pa.array([found[k] for k in best], pa.string())], names=["word", "n_near", "best_n", "best"])

    parts = dealt(words, cells, most).mapInArrow(work, NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.word").alias("best"))


def roots(forms: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(word, root): where each word's chain of forms ends. forms: (word, form), form null at an end of a chain."""
    now = common.cut(forms.select("word", F.coalesce("form", "word").alias("root")))
    for _ in range(most_rounds):
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = common.cut(now.join(further, "root").select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        now = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            return now
    raise RuntimeError(f"chains of forms don't end after {most_rounds} doublings")


def variants(words: DataFrame, ratio: int = 2, cells: int = CELLS, most: int = PART) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words (word, n); the form has at least `ratio` (2 or more) times the word's n."""
    words = common.cut(words)
    found = words.join(nearest(words, cells, most), "word", "left")
    common_enough = F.col("best_n") >= ratio * F.col("n")
    found = common.cut(found.select("word", F.when(common_enough, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(common_enough, F.col("best_n")).alias("form_n")))
    return found.join(roots(found.select("word", "form")), "word").select("word", "form", "root", "n", "n_near", "form_n")


def op13_spelling_variant_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs(common.table(spark, sf_dir, "documents"))
    return variants(counted(found.select(misspelt(F.col("doc"), F.col("run")).alias("word"))))


#: The same by wildcards and deletions: near words share a pattern with one code point left open, or one is the other
#: without a code point. DuckDB has no crc32, so it is folded from the bytes (letters here are below U+0100).
OP13_SQL = """
with recursive bits as (
  select list(c order by i) as crcs from (
    select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) as c
    from (select unnest(range(256)) as i))
), texts as (
  select coalesce(cast(doc_id as varchar), '') as doc, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents where text is not null
), found as (
  select doc, run, count(*) as n from (select doc, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as run from texts) group by all having length(run) >= 5
), summed as (
  select run, n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc || ':' || run, ''),
    lambda x: case when ord(x) < 128 then [ord(x)::bigint] else [(192 + ord(x) // 64)::bigint, (128 + ord(x) % 64)::bigint] end))),
    lambda c, b: xor(c // 256, crcs[1 + xor(c % 256, b)])), 4294967295) as h from found, bits
), words as (
  select word, sum(n)::bigint as n from (
    select case when h % 97 = 0 then substring(run, 1, (h % length(run))::int) || substring(run, (h % length(run))::int + 2) else run end as word, n from summed)
  where length(word) >= 5 group by word having sum(n) >= 3
), places as (
  select word, unnest(range(length(word))) as i from words
), opened as (
  select word, i, substring(word, 1, i::int) || '*' || substring(word, i::int + 2) as pattern, substring(word, 1, i::int) || substring(word, i::int + 2) as less from places
), shorter as (
  select distinct o.word as a, w.word as b from opened o join words w on w.word = o.less
), near as (
  select a.word as a, b.word as b from opened a join opened b on a.pattern = b.pattern and a.word <> b.word
  union select a, b from shorter union select b, a from shorter
), best as (
  select a as word, count(*) as n_near, arg_min(b, (-w.n, b)) as best, max(w.n) as best_n from near join words w on w.word = b group by a
), forms as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when best_n >= 2 * w.n then best end as form, case when best_n >= 2 * w.n then best_n end as form_n
  from words w left join best using (word)
), chains as (
  select word, word as root, form from forms
  union all select c.word, c.form as root, f.form from chains c join forms f on f.word = c.form
)
select f.word, f.form, c.root, f.n::bigint as n, f.n_near::bigint as n_near, f.form_n::bigint as form_n from forms f join chains c on c.word = f.word and c.form is null
"""
