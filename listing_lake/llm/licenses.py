"""Licence scans: notices and identifier tags in texts, and the expressions of licences that they make.

A text becomes its words (A to Z lower-cased, cut at ASCII characters that are neither letters nor digits) with single
spaces between them; one Aho-Corasick automaton finds, in one pass, all places of the base phrases, the notice phrases
and the words of identifier tags. Behind a tag and a colon or equals sign the original text is read up to the line's
end; a shunting-yard parser takes the longest expression of licences, `and`, `or`, `with` and parentheses there (`with`
binds closest, then `and`). Notices with only one such word and some small words between them are operands of an
expression too ("under the MIT License or, at your option, the Apache License, Version 2.0").

Evaluating an expression gives how freely its texts may be reused, 0 to 1: of `or` the freer side, of `and` the stricter,
and `with` an exception lifts a licence to the level of a weak copyleft. All of a text's expressions hold at once.

Scale: one pass over the texts without a shuffle; a worker has one text and the places in it in memory.
Rows: null and empty texts have no words and score 0; null and repeated ids stay as they are; texts of any length are
read whole; an empty table gives no rows; other columns of the table are not read.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Phrases of the contract, names of licences, versions, and how freely a family may be reused.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
VERSIONED = {
    "gpl": (["gnu general public license", "general public license", "gnu gpl", "gpl"], ["1.0", "2.0", "3.0"]),
    "lgpl": (["gnu lesser general public license", "lesser general public license", "gnu library general public license", "gnu lgpl", "lgpl"], ["2.0", "2.1", "3.0"]),
    "agpl": (["gnu affero general public license", "affero general public license", "gnu agpl", "agpl"], ["1.0", "3.0"]),
    "apache": (["apache license", "apache software license", "apache"], ["1.0", "1.1", "2.0"]),
    "mpl": (["mozilla public license", "mpl"], ["1.0", "1.1", "2.0"]),
    "epl": (["eclipse public license", "epl"], ["1.0", "2.0"]),
    "cddl": (["common development and distribution license", "cddl"], ["1.0", "1.1"]),
    "eupl": (["european union public licence", "european union public license", "eupl"], ["1.0", "1.1", "1.2"]),
    "artistic": (["artistic license"], ["1.0", "2.0"]),
    "bsl": (["boost software license"], ["1.0"]),
    "ofl": (["sil open font license", "open font license"], ["1.0", "1.1"]),
    "cc0": (["cc0", "creative commons zero"], ["1.0"]),
}
LATER = ["or later", "or any later version", "or at your option any later version", "or newer"]
PLAIN = {
    "mit license": "mit", "expat license": "mit", "isc license": "isc", "zlib license": "zlib", "unlicense": "unlicense", "public domain": "public-domain",
    "bsd license": "bsd", "bsd 2 clause": "bsd-2-clause", "bsd 3 clause": "bsd-3-clause", "2 clause bsd": "bsd-2-clause", "3 clause bsd": "bsd-3-clause", "new bsd license": "bsd-3-clause", "simplified bsd license": "bsd-2-clause",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "all rights reserved": "all-rights-reserved",
}
EXCEPTIONS = {"classpath exception": "classpath-exception", "linking exception": "linking-exception", "runtime library exception": "runtime-library-exception", "font exception": "font-exception"}
SHARING = {"": "", "nc": "noncommercial", "sa": "sharealike", "nd": "noderivatives", "nc sa": "noncommercial sharealike", "nc nd": "noncommercial noderivatives"}
TAGS = {"spdx license identifier": True, "license expression": True, "license": False, "licence": False, "licenses": False}
GLUE = set("the a an either both under terms of at your option license licensed gnu".split())
OPERATORS = {"or": 1, "and": 2, "with": 3}
REUSE = [  # by the start of an id, the first that fits
    ("public-domain", 1.0), ("unlicense", 1.0), ("cc0", 1.0), ("0bsd", 1.0), ("mit", 0.9), ("bsd", 0.9), ("apache", 0.9), ("isc", 0.9), ("zlib", 0.9), ("bsl", 0.9), ("artistic", 0.8),
    ("cc-by-nc-nd", 0.1), ("cc-by-nc", 0.2), ("cc-by-nd", 0.2), ("cc-by-sa", 0.6), ("cc-by", 0.8), ("lgpl", 0.6), ("mpl", 0.6), ("epl", 0.6), ("cddl", 0.6), ("eupl", 0.5), ("ofl", 0.7),
    ("gpl", 0.4), ("agpl", 0.3), ("all-rights-reserved", 0.0), ("proprietary", 0.0),
]
UNKNOWN, LIFTED = 0.5, 0.6
#: How sure each kind of evidence makes: a tag with an expression, a notice, a base phrase outside of any notice.
SURE = {"tag": 0.99, "notice": 0.9, "base": 0.5}
# End of the fixed values.

OUT = (
    "id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, "
    "places array<struct<label: string, kind: string, word: long, start: long, stop: long>>, expressions array<struct<expression: string, kind: string, start: long, stop: long, reuse: double>>, score double, reuse double"
)
PLACE = pa.struct([("label", pa.string()), ("kind", pa.string()), ("word", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])
EXPRESSION = pa.struct([("expression", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("reuse", pa.float64())])
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BEHIND = re.compile(rb"[\"'` \t]*[:=][\"'` \t\[]*")
_TOKEN = re.compile(rb"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+:_-]*)")


def notices() -> dict[str, str]:
    """Every notice phrase, as words, with its id; versions, their spellings and `or later` by rule."""
    out = dict(PLAIN)
    for family, (names, versions) in VERSIONED.items():
        later = LATER if family in ("gpl", "lgpl", "agpl") else []
        for name in names:
            if name not in (family, "apache"):
                out.setdefault(name, family)
            for version in versions:
                written = {version.replace(".", " ")} | ({version[0]} if version.endswith(".0") else set())
                for w in (f"{name} {v}{x}" for x in written for v in ("", "version ", "v ", "v")):
                    if name != "apache" or w.endswith("2 0"):
                        out[w] = f"{family}-{version}"
                        out |= {f"{w} {x}": f"{family}-{version}-or-later" for x in later}
    for short, long in SHARING.items():
        end = f"-{short.replace(' ', '-')}" if short else ""
        for name in (f"cc by {short}".strip(), f"creative commons attribution {long}".strip()):
            out[name] = f"cc-by{end}"
            for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
                out |= {f"{name} {v}{version.replace('.', ' ')}": f"cc-by{end}-{version}" for v in ("", "version ", "v")}
    return out


def reuse_of(name: str) -> float | None:
    """How freely texts under a licence may be reused; None where the family isn't known."""
    return next((value for start, value in REUSE if name == start or name.startswith(start + "-")), None)


def whole_expression(tokens: list[str], known_only: bool = False) -> int:
    """How many tokens from the first on make the longest complete expression; 0 if none do.

    known_only: operands must be of a known family. Else the first one can be any, and so can others that don't look like
    plain words (a digit, hyphen, dot or plus sign in them). An exception after `with` can be any.
    """
    depth, operand, whole, after_with = 0, True, 0, False
    for k, token in enumerate(tokens):
        if operand and token == "(" and not after_with:
            depth += 1
        elif operand and token not in OPERATORS and token not in "()" and (after_with or reuse_of(token) is not None or (not known_only and (not k or any(c in "-.+0123456789" for c in token)))):
            operand = False
        elif not operand and token == ")" and depth:
            depth -= 1
        elif not operand and token in OPERATORS and (token != "with" or (tokens[k - 1] != ")" and not after_with)):
            operand, after_with = True, token == "with"
            continue
        else:
            break
        if not operand and not depth:
            whole = k + 1
        after_with = after_with and not operand and token != ")"  # the exception itself can't take another `with`
    return whole


def postfix(tokens: Iterable[str]) -> list[str]:
    """A complete expression in postfix order, by the shunting-yard rule; all operators are left-associative."""
    out, waiting = [], []
    for token in tokens:
        if token == "(":
            waiting.append(token)
        elif token == ")":
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
        elif token in OPERATORS:
            while waiting and waiting[-1] != "(" and OPERATORS[waiting[-1]] >= OPERATORS[token]:
                out.append(waiting.pop())
            waiting.append(token)
        else:
            out.append(token)
    return out + waiting[::-1]


def evaluated(order: list[str]) -> tuple[str, list[str], float]:
    """Of an expression in postfix order: it in writing with the fewest parentheses, its licences, how freely it allows reuse."""
    stack: list[tuple[str, int, float]] = []
    names = []
    for token in order:
        if token not in OPERATORS:
            stack.append((token, 4, UNKNOWN if (value := reuse_of(token)) is None else value))
            names.append(token)
            continue
        (y, y_level, y_value), (x, x_level, x_value) = stack.pop(), stack.pop()
        level = OPERATORS[token]
        text = f"{x if x_level >= level else f'({x})'} {token} {y if y_level > level else f'({y})'}"
        if token == "with":
            names.pop()
            value = max(x_value, LIFTED)
        else:
            value = max(x_value, y_value) if token == "or" else min(x_value, y_value)
        stack.append((text, level, value))
    return stack[0][0], names, stack[0][2]


class Scanner:
    """The automaton of all phrases, and what is done with its hits in a text."""

    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        kinds: dict[str, dict[str, object]] = {}
        for kind, phrases in (("base", BASE), ("notice", notices()), ("exception", EXCEPTIONS), ("tag", TAGS)):
            for phrase, value in phrases.items():
                kinds.setdefault(phrase, {})[kind] = value
        for phrase, value in kinds.items():
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 2, len(phrase.split()), value))
        self.automaton.make_automaton()

    def hits(self, words: list[bytes]) -> list[tuple[int, int, dict]]:
        """(first word, number of words, what the phrase stands for) of every place, in order."""
        text = " " + b" ".join(words).decode("latin-1") + " "
        found = sorted(((end - size + 1, n, value) for end, (size, n, value) in self.automaton.iter(text)), key=lambda x: x[:2])
        out, at, word = [], 0, 0
        for start, n, value in found:
            word, at = word + text.count(" ", at, start), start
            out.append((word, n, value))
        return out

    def scan(self, raw: bytes) -> tuple:
        """The row of a text without its id."""
        folded = raw.translate(FOLD)
        words = folded.split()
        hits = self.hits(words) if words else []
        if not hits:
            return len(words), 0, None, None, [], [], [], [], 0.0, None
        letters = np.frombuffer(b" " + folded + b" ", np.uint8) != 32
        edges = np.flatnonzero(letters[1:] != letters[:-1])
        starts, stops = edges[::2], edges[1::2]
        base = [(word, n, value["base"]) for word, n, value in hits if "base" in value]
        tagged = self._tagged(raw, hits, stops)
        inside = np.searchsorted([e[0] for e in tagged], starts, "right") - 1  # the last expression behind a tag that begins before a word
        read = np.array([*(e[1] for e in tagged), 0])[inside] > starts
        chosen = [x for x in self._chosen(hits) if not read[x[0]]]
        expressions, labels = [], set()
        for start, stop, kind, tokens in [*tagged, *self._noticed(words, chosen, starts, stops)]:
            text, names, value = evaluated(postfix(tokens))
            expressions.append({"expression": text, "kind": kind, "start": start, "stop": stop, "reuse": value})
            labels |= set(names)
        alone = sum(not any(w <= word and word + n <= w + m for w, m, *_ in chosen) for word, n, _ in base)
        doubt = (1 - SURE["base"]) ** alone
        for e in expressions:
            doubt *= 1 - SURE[e["kind"]]
        places = [(word, n, kind, label) for word, n, kind, label in chosen] + [(word, n, "base", label) for word, n, label in base]
        places = [{"label": label, "kind": kind, "word": word, "start": int(starts[word]), "stop": int(stops[word + n - 1])} for word, n, kind, label in sorted(places)]
        base_labels = {label for *_, label in base}
        first, last = (base[0][0], base[-1][0]) if base else (None, None)
        free = min((e["reuse"] for e in expressions), default=None)
        return len(words), len(base), first, last, sorted(base_labels), sorted(labels | base_labels), places, expressions, 1 - doubt, free

    @staticmethod
    def _chosen(hits: list) -> list[tuple[int, int, str, str]]:
        """Notices and exceptions from the left, the longest where several begin, none within another."""
        out, free = [], 0
        best: dict[int, tuple[int, str, str]] = {}
        for word, n, value in hits:
            for kind in ("notice", "exception"):
                if kind in value and n > best.get(word, (0,))[0]:
                    best[word] = (n, kind, value[kind])
        for word, (n, kind, label) in sorted(best.items()):
            if word >= free:
                out.append((word, n, kind, label))
                free = word + n
        return out

    @staticmethod
    def _tagged(raw: bytes, hits: list, stops: np.ndarray) -> list[tuple[int, int, str, list[str]]]:
        """Expressions behind identifier tags: byte range, kind and tokens."""
        out, free = [], 0
        for word, n, value in hits:
            behind = _BEHIND.match(raw, at := int(stops[word + n - 1])) if "tag" in value and int(stops[word + n - 1]) >= free else None
            if not behind:
                continue
            tokens, ends, at = [], [], behind.end()
            while found := _TOKEN.match(raw, at):
                at = found.end()
                token = found[1].decode().lower()
                tokens.append(token.rstrip(".:"))
                ends.append(found.end() - len(token) + len(tokens[-1]))
                if tokens[-1] != token:  # a full stop ends the expression
                    break
            k = whole_expression(tokens, known_only=not value["tag"])
            if k:
                out.append((behind.end(), ends[k - 1], "tag", tokens[:k]))
                free = ends[k - 1]
        return out

    @staticmethod
    def _noticed(words: list[bytes], chosen: list, starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int, str, list[str]]]:
        """Expressions of notices: each one alone, or joined by one operator and small words between."""
        out: list[list] = []
        for word, n, kind, label in chosen:
            if out:
                between = [w.decode() for w in words[out[-1][1] : word]] if word - out[-1][1] <= 8 else ["far"]
                joining = [w for w in between if w in OPERATORS]
                if len(joining) == 1 and all(w in GLUE or w in OPERATORS for w in between) and (joining[0] == "with") == (kind == "exception") and (kind == "notice" or out[-1][2][-2:-1] != ["with"]):
                    out[-1][1] = word + n
                    out[-1][2] += [joining[0], label]
                    continue
            if kind == "notice":
                out.append([word, word + n, [label]])
        return [(int(starts[a]), int(stops[b - 1]), "notice", tokens) for a, b, tokens in out]


@functools.lru_cache(maxsize=1)
def scanner() -> Scanner:
    """One for each worker process."""
    return Scanner()


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of the table with its words, places, expressions (byte ranges of UTF-8), labels and score."""
    common.share_code(docs.sparkSession)
    kinds = [pa.int64()] * 4 + [pa.list_(pa.string())] * 2 + [pa.list_(PLACE), pa.list_(EXPRESSION), pa.float64(), pa.float64()]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "places", "expressions", "score", "reuse"]

    def work(batches):
        scan = scanner().scan
        for batch in common.slices(batches, 1):
            data, at = common.utf8(batch.column(1))
            raw, at = data[at[0] : at[-1]].tobytes(), (at - at[0]).tolist()
            rows = [scan(raw[s:e]) for s, e in zip(at, at[1:], strict=False)]
            columns = [pa.array(list(x), kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], names=["id", *names])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(work, OUT)


def op11_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scanned(common.table(spark, sf_dir, "documents"))
    joined = [F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")]
    written = F.array_join(F.transform("expressions", lambda e: e["expression"]), "; ").alias("expressions")
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", *joined, "score", written, "reuse")
