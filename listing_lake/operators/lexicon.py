"""Vocabulary translation by lexicon and translation memory, as joins over distinct values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import col

#: Ordered rules (pattern, translation); the first that fits decides.
RULES = (
    (r"\boccupat[oiae]?\b", "inhabited"),
    (r"\bocupad[oiae]\b", "inhabited"),
    (r"\bliber[oiae]?\b", "vacant"),
    (r"\blibr[oiae]\b", "vacant"),
    (r"\blibrr[oa]\b", "vacant"),
    (r"\bvaci[oa]\b", "vacant"),
    (r"\bautonom[oa]\b", "independent"),
    (r"\bv\.", "via"),
    (r"\bn\.", "number"),
    (r"\bp\.zza\b", "square"),
    (r"\btelematic[oia]\b", "on line"),
    (r"\btelematiche\b", "on line"),
    (r"\bmq\b", "squared meters"),
    (r"\bpl\.", "floor"),
    (r"\bimm\.", "real estate"),
    (r"\bv\.le\b", "avenue"),
    (r"\bviale\b", "avenue"),
    (r"\b(?<!in )corso\b", "boulevard"),
    (r"\bc\.so\b", "boulevard"),
    (r"\bcucina abitabile\b", "eat-in kitchen"),
    (r"\bcucina cucinotto\b", "kitchenette"),
    (r"\bcucina a vista\b", "open kitchen"),
    (r"\bcucina semi abitabile\b", "semi eat-in kitchen"),
    (r"\bcucina angolo cottura\b", "cooking corner"),
    (r"\bportiere\b", "doorman"),
    (r"\bpasso carrabile\b", "driveway"),
    (r"\bbox privato\b", "private parking spot"),
    (r"\bterratetto\b", "terraced house"),
    (r"\bvilletta a schiera\b", "terraced house"),
    (r"\bvilla a schiera\b", "terraced house"),
    (r"\barea accoglienza\b", "front desk"),
    (r"\binfissi\b", "window frames"),
    (r"\bdb_fullname_external_fixtures\. ♪", "window frames outdoor glass / wood"),
)
Rules = tuple[tuple[str, str], ...]


def whole_value(x: Column | str, rules: Rules = RULES) -> Column:
    """the translation of a value that a rule fits from end to end; NULL if none does."""
    out = F.lit(None).cast("string")
    for pattern, text in reversed(rules):
        out = F.when(col(x).rlike(f"(?i)^(?:{pattern})$"), text).otherwise(out)
    return out


def in_text(x: Column | str, rules: Rules = RULES) -> Column:
    """every rule in order within a text; what a rule has put in is safe from later rules."""
    out = col(x)
    for i, (pattern, _) in enumerate(rules):  # a private-use letter stands for each translation meanwhile
        out = F.regexp_replace(out, f"(?i){pattern}", chr(0xE000 + i))
    for i, (_, text) in enumerate(rules):
        out = F.replace(out, F.lit(chr(0xE000 + i)), F.lit(text))
    return out


def translated(x: Column | str, rules: Rules = RULES) -> Column:
    return F.coalesce(whole_value(x, rules), in_text(x, rules))


MEMORY_KEY = ("source_text", "source_lang", "target_lang")


def looked_up(texts: DataFrame, memory: DataFrame) -> DataFrame:
    """texts (source_text, source_lang, target_lang) with the memory's translation, NULL where it has none."""
    return texts.join(last_written(memory).drop("ts"), list(MEMORY_KEY), "left")


def missing(texts: DataFrame, memory: DataFrame) -> DataFrame:
    """what has to be translated anew."""
    return texts.select(*MEMORY_KEY).distinct().join(memory.select(*MEMORY_KEY).distinct(), list(MEMORY_KEY), "left_anti")


def last_written(memory: DataFrame) -> DataFrame:
    """one row for each key, the last written."""
    return memory.groupBy(*MEMORY_KEY).agg(F.max(F.struct("ts", "translated_text")).alias("m")).select(*MEMORY_KEY, "m.translated_text", "m.ts")


def saved(memory: DataFrame, new: DataFrame) -> DataFrame:
    """the memory with new rows; the last written wins."""
    return last_written(memory.unionByName(new))


def memory_statistics(memory: DataFrame) -> DataFrame:
    """F4"""
    return memory.groupBy("source_lang", "target_lang").agg(F.count("*").alias("n"))


def translated_values(df: DataFrame, column: str, out: str = "translated", rules: Rules = RULES) -> DataFrame:
    """rules run on the distinct values only, which are then joined back; NULL stays NULL."""
    values = df.select(F.col(column).alias("_v")).where("_v is not null").distinct().withColumn(out, translated("_v", rules))
    return df.join(values, F.col(column) == F.col("_v"), "left").drop("_v")


def conflicts(members: DataFrame, key: str, value: str) -> DataFrame:
    """(value, primary, secondary): a row for each further member of a value; the primary is its smallest key."""
    first = members.groupBy(value).agg(F.min(key).alias("primary"), F.max(key).alias("_last")).where(F.col("primary") != F.col("_last"))
    return members.join(first.drop("_last"), value).where(F.col(key) != F.col("primary")).select(value, "primary", F.col(key).alias("secondary"))


def primary_keys(members: DataFrame, key: str, natural: list[str]) -> DataFrame:
    """(old, new) keys of members that became equal in their whole natural key (NULL equals NULL)."""
    low = members.groupBy(*natural).agg(F.min(key).alias("new"))
    on = [members[c].eqNullSafe(low[c]) for c in natural]
    return members.join(low, on).select(members[key].alias("old"), "new").where("old <> new")


def remapped(facts: DataFrame, fk: str, mapping: DataFrame) -> DataFrame:
    """facts point to the members that stay."""
    return facts.join(mapping.select(F.col("old").alias(fk), "new"), fk, "left").withColumn(fk, F.coalesce("new", fk)).select(*facts.columns)


def survivors(members: DataFrame, key: str, mapping: DataFrame) -> DataFrame:
    """members without those merged into others."""
    return members.join(mapping.select(F.col("old").alias(key)), key, "left_anti")


#: F8: the columns whose values are translated, by table.
TARGETS = {
    "dim_seller_type": ["seller_type"], "dim_category": ["category_name"], "dim_availability": ["availability"], "dim_condition": ["condition"], "dim_type_of_property": ["type_of_property"],
    "dim_rooms_info": ["kitchen_status", "garage"], "dim_building_info": ["building_usage"], "dim_energy_info": ["heating_type", "air_conditioning"], "dim_features": ["feature_name"],
}


def translated_members(members: DataFrame, key: str, natural: list[str], columns: list[str], rules: Rules = RULES) -> tuple[DataFrame, DataFrame]:
    """F8: (members that stay with translated values, old-to-new keys of those merged)."""
    out = members
    for c in columns:
        out = translated_values(out, c, "_t", rules).withColumn(c, F.coalesce("_t", c)).drop("_t")
    mapping = primary_keys(out, key, natural)
    return survivors(out, key, mapping), mapping


#: Common words by language.
STOP_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "it", "for", "on", "that", "with", "as", "was"),
    "de": ("der", "die", "das", "und", "zu", "in", "ist", "nicht", "für", "mit", "von", "den", "ein", "eine"),
    "fr": ("le", "la", "les", "de", "des", "du", "et", "un", "une", "que", "qui", "en", "pour", "dans", "est"),
    "es": ("el", "la", "los", "las", "de", "que", "y", "en", "un", "una", "con", "por", "para", "se", "del"),
}


def stop_word_share(x: Column | str, words: tuple[str, ...]) -> Column:
    tokens = F.filter(F.split(F.lower(col(x)), r"[^\p{L}]+"), lambda t: t != "")
    return F.when(F.size(tokens) > 0, F.size(F.filter(tokens, lambda t: t.isin(*words))) / F.size(tokens)).otherwise(0.0)


def is_language(x: Column | str, lang: str, least: float = 0.1) -> Column:
    """the text is already in a language: its stop words are common and no other language's are more so."""
    mine = stop_word_share(x, STOP_WORDS[lang])
    others = [stop_word_share(x, w) for other, w in STOP_WORDS.items() if other != lang]
    return (mine >= least) & (mine >= F.greatest(*others))
