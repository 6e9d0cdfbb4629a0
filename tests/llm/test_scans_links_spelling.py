"""License scans, alignment of tokenizers and spelling variants against SQL, the libraries and brute force."""

import bisect
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from listing_lake.llm import alignment, licenses, spelling

from .test_operators import ODD, SF, docs, table  # noqa: F401

tokenizers = pytest.importorskip("public_tokenizers")
A, B = tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model")

BASE_SQL = r"""
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), places as (
  select doc_id, i, case when w[i] = 'mit' and w[i + 1] = 'license' then 'mit' when w[i] = 'apache' and w[i + 1] = 'license' then 'apache'
    when w[i] = 'general' and w[i + 1] = 'public' and w[i + 2] = 'license' then 'gpl' end as label
  from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from words)
)
select doc_id, len(w), count(label), min(i - 1) filter (label is not null), max(i - 1) filter (label is not null), coalesce(string_agg(distinct label, ',' order by label), '')
from words left join places using (doc_id) group by doc_id, len(w) order by 1
"""


def test_base_phrases_equal_sql(spark):
    place = SF.replace("0.001", "0.01")
    got = licenses.op11_license_scans(spark, place).orderBy("doc_id").collect()
    want = duckdb.connect().execute(BASE_SQL.replace("from documents", f"from '{place}/documents.parquet'")).fetchall()
    assert [tuple(r)[:6] for r in got] == want
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) for r in got)
    assert {"gpl-3.0", "mit", "apache-2.0", "cc-by-nc-4.0"} <= {x for r in got for x in r.labels.split(",")}


SCANS = [
    ("Released under the MIT License.", "mit", "mit", 0.9),
    ("// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND BSD-3-Clause", "bsd-3-clause,gpl-2.0-only,mit", "(mit or gpl-2.0-only) and bsd-3-clause", 0.9),
    ("SPDX-License-Identifier: GPL-2.0 WITH Classpath-exception-2.0 and more words", "gpl-2.0", "gpl-2.0 with classpath-exception-2.0", 0.6),
    ("SPDX-License-Identifier: X-Own OR (MIT AND", "x-own", "x-own", 0.5),
    ('"license" = "MIT OR Apache-2.0".', "apache-2.0,mit", "mit or apache-2.0", 0.9),
    ("license: free for all", "", "", None),
    ("GNU General Public License, version 3 or later; or: the MIT license", "gpl,gpl-3.0-or-later,mit", "gpl-3.0-or-later or mit", 0.9),
    ("the GNU General Public License v2 with the classpath exception", "gpl,gpl-2.0", "gpl-2.0 with classpath-exception", 0.6),
    ("Apache License, Version 2.0 and CC BY-NC-SA 4.0", "apache,apache-2.0,cc-by-nc-sa-4.0", "apache-2.0 and cc-by-nc-sa-4.0", 0.2),
    ("MIT License far away from other words here and the Apache License", "apache,mit", "mit; apache", 0.9),
    ("mitt licenses general public", "", "", None),
    ("é MIT—license", "", "", None),
]


def test_license_labels(spark):
    frame = docs(spark, [(i, t) for i, (t, *_) in enumerate(SCANS)] + [(None, None), (99, ""), (99, ""), (100, "x " * 50_000 + "mit license")])
    by = {}
    for r in licenses.scanned(frame).collect():
        by.setdefault(r.id, []).append(r)
    for i, (text, labels, expressions, reuse) in enumerate(SCANS):
        r = by[i][0]
        assert (",".join(r.labels), "; ".join(e.expression for e in r.expressions), r.reuse) == (labels, expressions, reuse), text
        assert all(text.encode()[p.start : p.stop].decode().lower().startswith(tuple("abcdefghijklmnopqrstuvwxyz")) for p in r.places)
    assert by[None][0].n_words == 0 and len(by[99]) == 2 and by[99][0].score == 0 and by[100][0].first_word == 50_000
    assert [p.label for p in by[100][0].places] == ["mit", "mit"]
    assert licenses.scanned(docs(spark, [])).count() == 0


def test_expressions_like_pythons_own_parser():
    """Postfix order and values against Python's parser, with & for and, | for or (a minimum and a maximum)."""

    class V(float):
        __and__ = lambda x, y: V(min(x, y))
        __or__ = lambda x, y: V(max(x, y))

    rng, names = random.Random(4), ["mit", "gpl-2.0", "cc-by-nc", "lgpl", "x-1"]

    def tree(depth):
        if not depth or rng.random() < 0.2:
            return [rng.choice(names)]
        return ["("] * (p := rng.random() < 0.6) + tree(depth - 1) + [rng.choice(["and", "or"])] + tree(depth - 1) + [")"] * p

    for _ in range(300):
        tokens = tree(4)
        values = {n: V(licenses.UNKNOWN if (v := licenses.reuse_of(n)) is None else v) for n in names}
        code = " ".join(f"v[{t!r}]" if t in names else {"and": "&", "or": "|"}.get(t, t) for t in tokens)
        text, found, value = licenses.evaluated(licenses.postfix(tokens))
        assert licenses.whole_expression(tokens) == len(tokens) and value == eval(code, {"v": values}) and sorted(found) == sorted(t for t in tokens if t in names)
        again = text.replace("(", "( ").replace(")", " )").split()
        assert licenses.evaluated(licenses.postfix(again))[0] == text


@pytest.mark.parametrize(("text", "n"), [("a with b with c", 3), ("( a-1 or b-2", 0), ("a or", 1), ("a ) b", 1), ("( a-1 ) with b", 3), ("a and ( b.2 with c ) or mit", 9), ("or a", 0), ("with", 0), ("( ( a-1 )", 0), ("a with ( b", 1), ("a or more", 1), ("mit and more", 1)])
def test_longest_whole_expression(text, n):
    assert licenses.whole_expression(text.split()) == n


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


MORE = ["  a  b ", "a b ", "\n\n x\n", "x\n foo\n\n  bar", "x\r\n\ty ▁ z", "▁", "<|endoftext|> <s>", "\x00a", " ", "\n", "abc \n \n  d\x1c e", "a　 b", "x \u0085 y   z", "naïve   words", "a" * 3000]


def by_hand(rows, libraries):
    """Groups from the offsets of both libraries' tokens, links by comparing all tokens' ranges within groups."""
    a, b = libraries
    letters = {c: i for i, c in enumerate(alignment.byte_letters())}
    out, counts = [], Counter()
    for i, text in rows:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bytes_a = [bytes(letters[c] for c in a.id_to_token(x)) for x in ids_a]
        pieces = [b.id_to_piece(x) for x in ids_b]
        bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in pieces]
        if text and not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            ids_a, ids_b, bytes_a, bytes_b = [], [], [], []
        ends_a, ends_b = (list(itertools.accumulate(map(len, x))) for x in (bytes_a, bytes_b))
        groups, s = [], 0
        for cut in sorted({*ends_a} & {*ends_b}):
            groups.append((s, cut, *(ids[bisect.bisect_right(ends, s) : bisect.bisect_right(ends, cut)] for ids, ends in ((ids_a, ends_a), (ids_b, ends_b)))))
            s = cut
        links = []
        j = 0
        for k, x in enumerate(ids_a):
            start = ends_a[k - 1] if k else 0
            while ends_b[j] <= start:
                j += 1
            links += [(x, ids_b[m]) for m in range(j, len(ids_b)) if m == j or ends_b[m - 1] < ends_a[k]] if len(ids_b) < 200 else [(x, ids_b[m]) for m in range(j, bisect.bisect_left(ends_b, ends_a[k]) + 1)]
        counts.update(links)
        out.append((i, ids_a, ids_b, groups, links))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    done = []
    for i, ids_a, ids_b, groups, links in out:
        text = ";".join(",".join(map(str, g[2])) + "|" + ",".join(map(str, g[3])) for g in groups)
        done.append((i, len(ids_a), len(ids_b), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return done, [(i, [tuple(g) for g in groups]) for i, _, _, groups, _ in out]


@pytest.mark.parametrize("most_hot", [1 << 17, 300])
def test_alignment(spark, table, libraries, most_hot):  # noqa: F811
    rows = [(r.doc_id, r.text) for r in table.collect()] + ODD + [(1000 + i, t) for i, t in enumerate(MORE)]
    key = lambda r: tuple(map(str, r))
    got = sorted((tuple(r) for r in alignment.aligned(docs(spark, rows), A, B, most_hot=most_hot).collect()), key=key)
    want, _ = by_hand(rows, libraries)
    assert got == sorted(want, key=key)


def test_groups_of_tokens(spark, libraries):
    rows = ODD + [(1000 + i, t) for i, t in enumerate(MORE)]
    got = [(r.id, [(g.start, g.stop, list(g.a), list(g.b)) for g in r.groups]) for r in alignment.groups(docs(spark, rows), A, B).collect()]
    assert got == by_hand(rows, libraries)[1]
    assert alignment.aligned(docs(spark, []), A, B).count() == 0


def test_lanes_give_what_whole_documents_give():
    both = alignment.Tokenizers(A, B)
    texts = ["some words of a text, " * 400, "", "é∑ x" * 200, "word"]
    found = [both.batch(texts) for _ in range(2)]
    for lane in (1, 7, 100_000):
        i, j = found[1].merged(lane)
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(found[0].link_a.tolist(), found[0].link_b.tolist(), strict=True)) and len(i) == len(found[0].link_a)
    both.keep = 0
    assert (both.batch(texts).a == found[0].a).all()  # after forgetting


def edits(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def small_words(n, seed):
    rng = random.Random(seed)
    out = {"".join(rng.choice("abé") for _ in range(rng.randint(5, 8))) for _ in range(n)} | {"aaaaa", "aaaaaa", "ééééé", "z" * 300, "z" * 301, "z" * 150 + "y" + "z" * 149}
    return [(w, rng.choice([3, 4, 9, 20, 60, 200])) for w in sorted(out)]


@pytest.mark.parametrize(("cells", "most"), [(spelling.CELLS, spelling.PART), (600, 3)])
def test_near_words(spark, cells, most):
    words = small_words(400, 7)
    frame = spark.createDataFrame(words, "word string, n long").repartition(3)
    want = {(a, b) for (a, _), (b, _) in itertools.combinations(words, 2) if edits(a, b)}
    pairs = [tuple(r) for r in spelling.near_pairs(frame, cells, most).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    n, near = dict(words), {}
    for a, b in want:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    form = {w: min(near[w], key=lambda x: (-n[x], x)) for w in near}
    form = {w: f for w, f in form.items() if n[f] >= 2 * n[w]}
    got = {r.word: r for r in spelling.variants(frame, cells=cells, most=most).collect()}
    assert got.keys() == n.keys() and any(form.get(f) for f in form.values())
    for w, r in got.items():
        root = w
        while root in form:
            root = form[root]
        assert (r.form, r.root, r.n, r.n_near, r.form_n) == (form.get(w), root, n[w], len(near.get(w, [])), n.get(form.get(w)))


def test_runs_and_misspelling(spark):
    texts = [(1, "Über-Straße naïve NAÏVE ab abcd abcde×fghij"), (None, "words words"), (2, None), (3, ""), (1, "tables " * 3)]
    got = Counter(tuple(r) for r in spelling.runs(docs(spark, texts)).collect())
    assert got == Counter([("1", "straße"), ("1", "naïve"), ("1", "naÏve"), ("1", "abcde×fghij"), ("", "words"), ("", "words"), *[("1", "tables")] * 3])
    many = [(i, "abcdefgh ijklmn") for i in range(200)]
    want = Counter()
    for i, t in many:
        for run in t.split():
            h = zlib.crc32(f"{i}:{run}".encode())
            at = h % len(run)
            want[run if h % 97 else run[:at] + run[at + 1 :]] += 1
    words = spelling.runs(docs(spark, many)).select(spelling.misspelt(F.col("doc"), F.col("run")).alias("word"))
    assert {r.word: r.n for r in spelling.counted(words, 1, 1).collect()} == dict(want) and len(want) > 2
    assert spelling.variants(spelling.counted(words.limit(0))).count() == 0


def test_spelling_equals_sql(spark):
    from .test_operators import SF

    got = [tuple(r) for r in spelling.op13_spelling_variant_grouping(spark, SF).collect()]
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    assert sorted(got, key=str) == sorted(con.execute(spelling.OP13_SQL).fetchall(), key=str)


def test_common_length_stops_early():
    columns = np.array([[1, 1], [2, 3], [4, 4]], np.uint32)
    x = np.array([[0, 1]])
    assert spelling.common_length(columns, x, x, np.ones((1, 2, 2), bool)).tolist() == [[[3, 1], [1, 3]]]
