"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by pigeonring filtering.

A fingerprint is cut into a ring of four 16-bit segments. If two fingerprints differ in at most three bits,
some segment starts a chain whose first segment has no difference, whose first two have at most one and whose
first three have at most two (budgets 3/4 of a bit for each segment of the chain, rounded down). The first two
conditions are the key of the candidate join: one side brings its two segments as they are, the other brings the
second segment also with each single bit turned. The third condition and the full distance are checked in the join.

Rows: a null text is an empty one; an empty text has fingerprint zero and links like any other. Rows with a null
id keep their fingerprint, link with nothing and have a null component. Repeated ids give repeated rows. Texts of any
length are taken whole; an empty table gives no rows; other columns of the table, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import arrays, common

SEGMENTS, WIDTH = 4, 16
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_PLACE = np.arange(8) * 256


def shingle_hashes(text: bytes, words: int, seed: int) -> np.ndarray:
    """Hashes of the word shingles of a text in order; a text of fewer words is one shingle."""
    found = text.lower().split()  # bytes: only A-Z and the six ASCII white spaces
    if not found:
        return np.zeros(0, "<u8")
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(found))
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[i:j], seed) for i, j in zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], "<u8")


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text as an unsigned number."""
    return fingerprint_of(shingle_hashes(text, words, seed))


def fingerprint_of(hashes: np.ndarray) -> int:
    """The fingerprint of a text's shingle hashes, repeats included; bit i is set if more than half of them set it."""
    if not len(hashes):
        return 0
    counts = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _PLACE).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits((counts.ravel() * 2 > len(hashes)), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""
    common.share_code(docs.sparkSession)

    def work(batches):
        for batch in common.slices(batches, 1):
            data, ends = common.utf8(batch.column(1))
            raw = data.tobytes()
            fps = np.array([fingerprint(raw[i:j], words, seed) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, "id long, fp long")


def links(fps: DataFrame, most_bits: int = 3) -> DataFrame:
    """Pairs (a, b) of representatives whose distinct fingerprints differ in at most three bits.

    fps: (rep, fp) with distinct fp. Everything is built-in expressions; the join condition drops a pair before it
    becomes a row, and a hot key is an ordinary sort-merge join that Spark splits. Spark takes the 68 rows of an explode
    for one and would send them through the driver, so both sides ask to be merged.
    """
    if most_bits != 3:
        raise ValueError("the key of the candidate join is made for distances up to three")
    segment = lambda i: F.shiftrightunsigned(F.col("fp"), WIDTH * (i % SEGMENTS)).bitwiseAND(F.lit(0xFFFF))
    key = lambda first, second, i: (first * F.lit(1 << WIDTH) + second) * F.lit(SEGMENTS) + F.lit(i)
    flips = [0, *(1 << b for b in range(WIDTH))]
    plain = fps.select("rep", "fp", F.explode(F.array(*[key(segment(i), segment(i + 1), i) for i in range(SEGMENTS)])).alias("k"))
    turned = fps.select("rep", "fp", F.explode(F.array(*[key(segment(i), segment(i + 1).bitwiseXOR(F.lit(f)), i) for i in range(SEGMENTS) for f in flips])).alias("k"))
    x, y = plain.alias("x"), turned.alias("y")
    differ = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    i = (F.col("x.k") % SEGMENTS).cast("int")
    third = F.bit_count(differ.bitwiseAND(F.element_at(F.array(*[F.lit(_mask(j)) for j in range(SEGMENTS)]), i + 1)))
    close = (F.col("x.fp") != F.col("y.fp")) & (third <= 2) & (F.bit_count(differ) <= most_bits)
    return x.hint("merge").join(y.hint("merge"), (F.col("x.k") == F.col("y.k")) & close).select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def _mask(i: int) -> int:
    """Bits of the three segments of the chain that starts at segment i, as a signed long."""
    bits = sum(0xFFFF << (WIDTH * ((i + j) % SEGMENTS)) for j in range(3))
    return bits - (1 << 64) if bits >> 63 else bits


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """One row per document: id, fp, component (smallest id reachable by links)."""
    fps = common.cut(fingerprints(docs, id_col, text_col, words, seed))
    classes = common.cut(fps.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep")))
    comps = common.components(links(classes)).select(F.col("node").alias("rep"), "component")
    of = classes.join(comps, "rep", "left").select("fp", F.coalesce("component", "rep").alias("component"))
    out = fps.join(of.withColumnRenamed("fp", "fp2"), F.col("fp") == F.col("fp2"), "left").drop("fp2")
    return out.withColumn("component", F.when(F.col("id").isNotNull(), F.col("component")))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with their columns as they are, of which each group keeps one with the smallest id.

    Groups are by five words and a similarity of 0.8 (`shingledup`): fingerprints of these words, linked as here, give the
    first links, which are verified; an exact search behind them finds those that three bits lose. Rows
    with one id whose texts are unlike are in different groups and stay; of equal rows, or like ones with that id,
    one stays. Rows with a null id all stay.
    """
    from . import shingledup

    found = common.cut(shingledup.near_duplicates(docs, id_col, text_col).where("id is not null"))
    kept = found.groupBy("cluster").agg(F.min(F.struct("id", "key")).alias("k"))  # of each group one id and text
    names = {c: common.free_name(docs, c) for c in ("keep_one", "own_key", "own_pair", "place")}
    rows = found.groupBy("id", "key").agg((F.count("*") > 1).cast("long").alias("several"))
    kept = kept.select("k.id", "k.key").distinct().join(rows, ["id", "key"])
    kept = common.cut(kept.select(F.xxhash64("id", "key").alias("pair"), "id", "key", "several"))
    few = kept.count() <= shingledup.FEW  # by either way no text is moved
    store = None if few else arrays.stored(kept, common.mounted_dir(docs.sparkSession, "kept"), "pairs")
    own, n = F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))), len(docs.columns)
    known = docs.where(F.col(f"`{id_col}`").cast("long").isNotNull()).withColumn(names["own_key"], F.struct(F.col(f"`{id_col}`").cast("long").alias("id"), own.alias("key")))
    known = known.withColumn(names["own_pair"], F.xxhash64(F.col(names["own_key"])["id"], F.col(names["own_key"])["key"]))

    def work(batches):
        for batch in batches:
            there = arrays.held(store, batch.column(n + 1), id=np.int64(0), key=np.int64(0), several=np.int64(0))
            same = there["hit"] & np.all([pc.struct_field(batch.column(n), f).to_numpy() == there[f] for f in ("id", "key")], axis=0)
            yield common.appended(batch, n + 1, **{names["keep_one"]: pa.array(there["several"])}).filter(pa.array(same))
            common.give_back()

    if few:
        kept_ = kept.toDF(*(common.free_name(known, c) for c in kept.columns))
        _, id_, key_, several_ = map(kept_.__getitem__, kept_.columns)
        known = known.join(F.broadcast(kept_), (F.col(names["own_key"])["id"] == id_) & (F.col(names["own_key"])["key"] == key_))
        known = known.withColumn(names["keep_one"], several_).drop(names["own_pair"], *kept_.columns)
    else:
        known = known.mapInArrow(work, common.widened(known.drop(names["own_pair"]), **{names["keep_one"]: "long"}))
    out = known.where(F.col(names["keep_one"]) == 0).drop(*names.values())
    if kept.where("several = 1").limit(1).count():  # equal rows of one id: one of them
        order = Window.partitionBy(names["own_key"]).orderBy(F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
        again = known.where(F.col(names["keep_one"]) == 1).withColumn(names["place"], F.row_number().over(order)).where(F.col(names["place"]) == 1)
        out = out.unionByName(again.drop(*names.values()))
    return out.unionByName(docs.where(F.col(f"`{id_col}`").isNull()))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(common.table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
