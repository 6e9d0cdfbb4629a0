"""Language of texts by profiles of character n-grams, which Spark counts from labelled texts.

A text's words (letters only, lower-cased, with a space before and after; runs of letters are cut after 64) give
n-grams. A profile has each language's log probabilities with add-alpha smoothing over all n-grams seen in any language;
a text is in the language under which its n-grams are likeliest (ties: the first by name).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import scratch

LONGEST_RUN = 64


def grams(df: DataFrame, text: str, *keep: str, n: int = 3) -> DataFrame:
    """(keep..., gram): a row for each n-gram of each word."""
    return grams_of(words(df, text, *keep), *keep, n=n)


def words(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep..., _w): a row for each word."""
    return df.select(*keep, F.explode(F.regexp_extract_all(F.lower(text), F.lit(f"\\p{{L}}{{1,{LONGEST_RUN}}}"), F.lit(0))).alias("_w"))


def grams_of(found: DataFrame, *keep: str, n: int = 3) -> DataFrame:
    """(keep..., gram): a row for each n-gram of the words `_w`."""
    padded = found.withColumn("_w", F.concat(F.lit(" "), "_w", F.lit(" ")))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length("_w") - n + 1))
    return padded.select(*keep, F.explode(F.transform(starts, lambda i: F.substring(F.col("_w"), i, F.lit(n)))).alias("gram"))


@dataclass(frozen=True)
class Profiles:
    """Languages by name, the log probability of an n-gram that a language hasn't, and each n-gram's gain over it by language."""

    languages: list[str]
    unseen: list[float]
    gains: DataFrame
    n: int


def learned(df: DataFrame, text: str = "text", lang: str = "lang", n: int = 3, alpha: float = 0.5) -> Profiles:
    """Profiles from labelled texts; rows without a label are left out. The driver sees a row for each language.

    Words are counted first, so a word is cut into n-grams once for each language and not each time that it stands in a text.
    """
    several = words(df.where(F.col(lang).isNotNull()), text, lang).groupBy(lang, "_w").agg(F.count("*").alias("_c"))
    counts = scratch.kept(grams_of(several, lang, "_c", n=n).groupBy(lang, "gram").agg(F.sum("_c").alias("c")))
    totals = {r[0]: r.c for r in counts.groupBy(lang).agg(F.sum("c").alias("c")).orderBy(lang).collect()}
    different = counts.select("gram").distinct().count()
    unseen = [math.log(alpha / (c + alpha * different)) for c in totals.values()]
    gain = lambda name: F.log((F.coalesce(F.sum(F.when(F.col(lang) == name, F.col("c"))), F.lit(0)) + alpha) / alpha)
    gains = scratch.kept(counts.groupBy("gram").agg(F.array(*(gain(name) for name in totals)).alias("gains")))
    return Profiles(list(totals), unseen, F.broadcast(gains) if different <= 1 << 20 else gains, n)


def identified(df: DataFrame, key: str, profiles: Profiles, text: str = "text") -> DataFrame:
    """(key, language, n_grams, margin) of every row by a distinct key: margin is how much likelier, for each n-gram, the
    language is than the next one, in logs. A text without letters, or without any profile, has NULLs."""
    found = grams(df, text, key, n=profiles.n).join(profiles.gains, "gram", "left")
    each = range(len(profiles.languages))
    sums = found.groupBy(key).agg(F.count("*").alias("n_grams"), *(F.coalesce(F.sum(F.col("gains")[i]), F.lit(0.0)).alias(f"_{i}") for i in each))
    best = F.sort_array(F.array(*(F.struct((-F.col(f"_{i}") - F.col("n_grams") * profiles.unseen[i]).alias("cost"), F.lit(profiles.languages[i]).alias("language")) for i in each)))
    if profiles.languages:
        sums = sums.withColumn("_best", best).select(key, F.col("_best")[0]["language"].alias("language"), "n_grams", ((F.try_element_at("_best", F.lit(2))["cost"] - F.col("_best")[0]["cost"]) / F.col("n_grams")).alias("margin"))
    else:
        sums = sums.select(key, F.lit(None).cast("string").alias("language"), "n_grams", F.lit(None).cast("double").alias("margin"))
    return df.select(key).join(sums, key, "left")


def already(df: DataFrame, key: str, profiles: Profiles, language: str, text: str = "text", least: float = 0.0) -> DataFrame:
    """(key, is_language): texts that need no translation, with at least this margin."""
    return identified(df, key, profiles, text).select(key, F.coalesce((F.col("language") == language) & (F.coalesce("margin", F.lit(math.inf)) >= least), F.lit(False)).alias("is_language"))
