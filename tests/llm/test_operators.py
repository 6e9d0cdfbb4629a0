"""The operators on small inputs against brute force, with nulls, empty and repeated rows, ties and odd columns."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from listing_lake.llm import bpe, common, htmltext, lm, packing, simhash, suffixdup, topk, toxicity, urlfilter, vectordup

tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, id string, score double, fp int"  # the last three clash with working names


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1.0, 2) for i, t in rows], DOCS)


ODD = [(1, None), (2, ""), (3, "   \n"), (None, "no id at all"), (4, "é ∑ 😀 words here"), (5, "same text twice here now"), (6, "same text twice here now"), (6, "same text twice here now"), (7, "A" * 5000)]


@pytest.fixture(scope="module")
def table(spark):
    return common.table(spark, SF, "documents").select("doc_id", "text")


def small_components(n, links):
    parent = list(range(n))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [tuple(map(int, x)) for x in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(300, 340)] + [(400, i) for i in range(401, 480)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = small_components(480, links)
    assert all(want[i] == c for i, c in got.items())
    assert {i for x in links for i in x if x[0] != x[1]} == set(got)
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash(spark, table):
    rows = [(r.doc_id, r.text) for r in table.collect()]
    got = {r.id: r for r in simhash.near_duplicates(table).collect()}
    fps = [simhash.fingerprint((t or "").encode()) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    place = {i: k for k, i in enumerate(order)}
    want = small_components(len(rows), [(place[a], place[b]) for a, b in links])
    assert all(got[rows[i][0]].component == rows[order[want[place[i]]]][0] and got[rows[i][0]].fp & (1 << 64) - 1 == fps[i] for i in range(len(rows)))


def test_simhash_links_every_close_pair(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = {int(b) ^ sum(1 << int(x) for x in rng.choice(64, k, replace=False)) for b in base for k in (0, 1, 2, 3, 3, 4, 5)}
    fps = sorted(fps)
    frame = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "rep long, fp long")
    got = {(r.a, r.b) for r in simhash.links(frame).collect()}
    assert got == {(i, j) for j in range(len(fps)) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= 3}


def test_simhash_odd_rows(spark):
    out = simhash.near_duplicates(docs(spark, ODD)).collect()
    by = {(r.id, r.fp): r.component for r in out}
    assert len(out) == len(ODD) and by[(2, 0)] == 1 and by[(3, 0)] == 1 and [c for (i, _), c in by.items() if i is None] == [None]
    kept = simhash.without_near_duplicates(docs(spark, ODD))
    assert kept.columns == ["doc_id", "text", "id", "score", "fp"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "5", "7", "None"]
    assert simhash.without_near_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_equals_the_library(name, table):
    lib = pytest.importorskip("tokenizers").Tokenizer.from_file(tokenizers.path(name))
    texts = [r.text or "" for r in table.limit(60).collect()] + [t or "" for _, t in ODD]
    texts += ["ΣΑΣ İstanbul", "x<|endoftext|>y <|startoftext|> z", "I'LL don't 123 ½² 中文 \x1c\x85\u3000 t", "e\u0301 café", "\x00\x01 � 😀😀", "Ᲊ Ɤ a\ua7dcb \U00010d50 \U00016ea0", "a b   c   ", "aaaa aaaaaaa"]
    vocab = bpe.Vocabulary(tokenizers.path(name))
    for text in texts:
        ids = lib.encode(text, add_special_tokens=False).ids
        assert vocab.encode(text) == ids
        assert vocab.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_bpe_frames(spark):
    path = tokenizers.path("word_bpe_49k.json")
    vocab = bpe.vocabulary(path)
    frame = docs(spark, ODD)
    got = bpe.digests(frame, path).collect()
    assert len(got) == len(ODD)
    for (i, t), r in zip(ODD, got, strict=True):
        ids = vocab.encode(t or "")
        assert (r.id, r.n_tokens, r.ids_sha256, r.decoded_sha256) == (i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(vocab.decode(ids).encode()).hexdigest())
    assert [r.ids for r in bpe.encoded(frame, path).collect()] == [vocab.encode(t or "") for _, t in ODD]
    assert bpe.digests(docs(spark, []), path).count() == 0


def test_packing(spark, table):
    path = tokenizers.path("byte_bpe_50k.tiktoken")
    lib = pytest.importorskip("tokenizers").Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    rows = [(r.doc_id, r.text) for r in table.collect()] + [(9001, None), (9002, ""), (9003, "x<|endoftext|>y")]
    got = packing.packed(packing.pieces(docs(spark, rows), path), per_group=64).toPandas()
    for i, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        mine = got[got.id == i].sort_values("piece")
        assert mine.length.sum() == len(ids) and mine.start.tolist() == [0, *mine.length.cumsum().tolist()[:-1]]
        assert all(zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) == c for s, n, c in zip(mine.start, mine.length, mine.ids_crc32, strict=True))
        assert (len(mine) == 1) == (len(ids) <= 1024) and (mine.length[1:] == 1024).all()
    got = got.sort_values(["sequence_id", "offset"])
    ends = (got.offset + got.length).groupby(got.sequence_id).shift().fillna(0)
    assert (ends == got.offset).all() and (got.offset + got.length).max() <= 1024
    assert packing.packed(packing.pieces(docs(spark, []), path)).count() == 0


def test_sum_of_squares_packs_tightly():
    lengths = np.sort(np.random.default_rng(1).integers(1, 1024, 6000))[::-1]
    place, offset = packing.sum_of_squares(lengths, 1024)
    fill = np.bincount(place, weights=lengths)
    assert fill.max() <= 1024 and len(fill) <= 1.01 * math.ceil(lengths.sum() / 1024) and offset.min() == 0


def test_toxicity(spark):
    rng = np.random.default_rng(2)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        text = " ".join(rng.choice(words, 60)) + (" vilest" + chr(97 + i % 26) * 2 + " grim" if toxic else "")
        rows.append((i, text))
        labels.append((i, int(toxic)))
    frame = docs(spark, rows + [(9001, None), (9002, ""), (None, "grim grim")])
    lab = spark.createDataFrame(labels + [(None, 1), (9001, None), (77777, 1)], "doc_id long, toxic int")
    index = toxicity.fit(frame, lab.where("doc_id is null or doc_id % 4 <> 1"))
    got = toxicity.score(frame, index).collect()
    assert len(got) == 603 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.id is not None and r.id < 600 and r.id % 4 == 1]
    assert all((r.score >= 0.3) == (r.id % 6 == 0) for r in held)
    kept = toxicity.without_toxic(frame, index)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {i for i in range(600) if i % 6} | {9001, 9002}
    empty = toxicity.fit(frame, lab.where("doc_id = -1"))
    assert {r.score for r in toxicity.score(frame, empty).collect()} == {0.0}


def brute_removals(rows, length=50):
    low = {}
    for i, t in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - length + 1):
            low[raw[p : p + length]] = min(i, low.get(raw[p : p + length], i))
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if low[raw[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        out.append((i, len(raw), sum(gone), sum(1 for j, g in enumerate(gone) if g and not (j and gone[j - 1])), bytes(b for b, g in zip(raw, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("small", [0, 4, 10_000])
def test_deep_shallow_orders_windows(small):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 1500).astype(np.uint8)
    data = np.concatenate([data, data[:400], np.full(200, 97, np.uint8), data[100:700], rng.integers(0, 256, 300).astype(np.uint8), np.zeros(8, np.uint8)])
    starts = rng.permutation(len(data) - 58)
    for length, buckets in ((50, 1), (50, 7), (41, 3), (48, 1)):
        bucket = starts * 31 % buckets
        order, group = suffixdup.deep_shallow(data, starts, bucket, length, small=small)
        found = [(int(bucket[i]), data[starts[i] : starts[i] + length].tobytes()) for i in order]
        assert found == sorted(found) and sorted(order.tolist()) == list(range(len(starts)))
        assert all((found[i] == found[i - 1]) == (group[i] == group[i - 1]) for i in range(1, len(found)))


def test_blind_trie_ranks_strings():
    from listing_lake.llm import blindtrie

    rng = np.random.default_rng(2)
    data = np.concatenate([rng.choice([0, 1, 128, 255], 4000).astype(np.uint8), np.zeros(8, np.uint8)])
    chars = np.ndarray((len(data) - 7,), ">u8", data, 0, (1,))
    starts = rng.choice(np.arange(0, 3900), 900)  # some twice
    group = np.sort(rng.integers(0, 60, 900))
    members, rank = blindtrie.ordered_by_tries(chars, starts, np.arange(900), group, np.array([0, 8, 13]))
    text = lambda i: data[starts[i] : starts[i] + 21].tobytes()
    for g in range(60):
        mine = members[group == g].tolist()
        assert sorted(mine) == np.nonzero(group == g)[0].tolist() and [text(i) for i in mine] == sorted(map(text, mine))
        assert rank[group == g].tolist() == [sum(text(j) < text(i) for j in mine) for i in mine]


def test_hashes_that_collide_are_told_apart(monkeypatch):
    monkeypatch.setattr(suffixdup, "string_hashes", lambda data, first, size: np.full(len(first), 7, np.uint64))
    rng = np.random.default_rng(3)
    data = np.append(rng.integers(97, 101, 400).astype(np.uint8), np.zeros(8, np.uint8))
    first, size = np.arange(0, 300, 10), np.full(30, 60)
    arrays_ = dict(size=size, place=np.full(30, 20), doc=np.arange(30), several=np.ones(30, bool), length=50)
    store, n = suffixdup.stored_strings(data, first, **arrays_)
    assert n == 330 and len(store["keys"]) == 30
    other = np.append(np.append(data[300:360], data[:360]), np.zeros(8, np.uint8))
    at = np.append(0, first + 60)
    asked, found = suffixdup.found_strings(store.get, other, at, np.full(31, 60), np.full(31, 7, np.uint64))
    assert sorted(asked.tolist()) == list(range(1, 31))
    assert all(store["pool"][store["at"][f] :][:60].tobytes() == other[at[a] :][:60].tobytes() for a, f in zip(asked, found, strict=True))


def test_suffix_dedup(spark, table):
    rng = np.random.default_rng(4)
    passage = "".join(rng.choice(list("abcdefgh éß"), 400))
    rows = [(r.doc_id, r.text) for r in table.collect()]
    rows += [(5000 + i, "".join(rng.choice(list("abcd "), 70)) + passage[i : i + 300] + "".join(rng.choice(list("abcd "), 70))) for i in range(40)]
    rows += [(6000, "ab" * 200), (6001, "ab" * 100 + "c"), (6002, "x" * 49), (6003, "x" * 49), (6004, "x" * 51), (6005, "x" * 50)]
    want = brute_removals(rows)
    got = suffixdup.removals(docs(spark, rows), bytes_per_shard=20_000)
    assert [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()] == want
    assert got.columns[:5] == ["doc_id", "text", "id", "score", "fp"]
    cut = {r.doc_id: r.text for r in suffixdup.without_repeats(docs(spark, rows)).collect()}
    assert all(cut[i] == k.decode("utf-8", "ignore") for i, _, _, _, k in want)
    odd = suffixdup.removals(docs(spark, [*ODD, (8, "same text twice here now, and so on and so on for long enough"), (9, "same text twice here now, and so on and so on for long enough")])).collect()
    assert {r.doc_id: r.n_removed for r in odd}[9] > 0 and sum(r.n_removed for r in odd if r.doc_id != 9) == 0
    assert suffixdup.removals(docs(spark, [])).count() == 0


def test_many_texts_of_one_anchor(spark):
    rng = np.random.default_rng(9)
    line = "".join(rng.choice(list("abcdefgh"), 90))
    rows = [(i, "".join(rng.choice(list("abcd"), 60)) + line + "".join(rng.choice(list("abcd"), 60))) for i in range(120)]
    for many in (8, 1 << 15):
        got = suffixdup.removals(docs(spark, rows), many=many, bytes_per_shard=5000).collect()
        assert [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got] == brute_removals(rows)


def test_long_texts_are_worked_on_in_pieces():
    rng = np.random.default_rng(10)
    texts = ["".join(rng.choice(list("abcdefgh"), n)) for n in (30, 900, 10, 5000, 60, 700)]
    data, ends = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    whole, cut = suffixdup.Runs(data, ends, 50), suffixdup.Runs(data, ends, 50, piece=256)
    windows = lambda r: sorted((int(r.row[i]), int(r.first[i] + j), int(r.anchor[i]), int(r.place[i] - j)) for i in range(len(r.row)) for j in range(r.count[i]))
    assert windows(whole) == windows(cut) and len(cut.row) > len(whole.row)
    assert len(windows(whole)) == sum(max(len(x) - 49, 0) for x in texts)


def test_language_model(spark, table):
    rows = [(r.doc_id, r.text) for r in table.collect()] + [(9001, None), (9002, ""), (9003, "Unseen WORDS only zqx zqx")]
    train = [t or "" for i, t in rows if i % 5]
    frame = docs(spark, rows)
    model = lm.fit(frame.where("doc_id % 5 <> 0"), bytes_per_shard=50_000)
    got = {r.id: r for r in lm.scored(frame, model).collect()}
    words = lambda t: [*(t or "").encode().lower().split(), None]
    uni, bi = Counter(), Counter()
    for t in train:
        uni.update(words(t))
        bi.update(zip([0, *words(t)], words(t), strict=False))
    n, v, cont, ctx = sum(uni.values()), len(uni), Counter(w for _, w in bi), {}
    for (u, _), c in bi.items():
        row = ctx.setdefault(u, [0, 0, 0, 0])
        row[0] += c
        row[min(c, 3)] += 1
    coc = lambda x: [sum(1 for c in x if c == k) for k in (1, 2, 3, 4)]
    d1, d2 = [0, *lm.discounts(coc(cont.values()))], [0, *lm.discounts(coc(bi.values()))]
    spare = sum(d1[k] * sum(1 for c in cont.values() if min(c, 3) == k) for k in (1, 2, 3)) / len(bi)

    def low(w):
        return max(cont[w] - d1[min(cont[w], 3)], 0) / len(bi) + spare / (v + 1)

    def p(u, w):
        row, c = ctx.get(u), bi.get((u, w), 0)
        return low(w) if row is None else max(c - d2[min(c, 3)], 0) / row[0] + sum(d2[k] * row[k] for k in (1, 2, 3)) / row[0] * low(w)

    assert (model.n, model.v) == (n, v)
    assert math.isclose(sum(map(low, uni)) + spare / (v + 1), 1) and math.isclose(sum(p(b"the", w) for w in uni) + p(b"the", b"in no text"), 1)
    for i, t in rows:
        w, r = words(t), got[i]
        assert math.isclose(r.score, sum(math.log10(p(a, b)) for a, b in zip([0, *w], w, strict=False)), rel_tol=1e-9)
        assert math.isclose(r.base_score, sum(math.log10((uni[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)
        assert (r.n_tokens, r.n_known) == (len(w), sum(x in uni for x in w))
    nothing = lm.fit(docs(spark, []))
    assert {r.score for r in lm.scored(docs(spark, ODD), nothing).collect()} == {0.0}


def test_url_rules_and_propagation(spark):
    pages = [
        (1, "http://a.net/x", '<a href="http://b.com/">'), (2, "http://b.com/q", '<A HREF="//c.com/z">'), (3, "http://c.com", '<a href="http://A.net/y">'), (4, "HTTP://E.example.NET/en/q?a", "<a href=http://d.com/>"),
        (5, "http://d.com/a", None), (6, None, None), (7, "nourl", ""), (8, "x://org/fr/a#b", ""), (9, "http://sub.example.com/de/?q", ""), (10, "http://notexample.com/de/", ""), (11, "http://f.net", ""),
    ]
    out = {r.page_id: r for r in urlfilter.filtered(spark.createDataFrame(pages, "page_id long, url string, html string"), urlfilter.RULES).collect()}
    assert {i: (r.host, r.path, r.rule, r.verdict) for i, r in out.items()} == {
        1: ("a.net", "/x", "net/", "block"), 2: ("b.com", "/q", None, "block"), 3: ("c.com", "", None, "block"), 4: ("e.example.net", "/en/q", "example.net/en/", "allow"), 5: ("d.com", "/a", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"),
        8: ("org", "/fr/a", "org/fr/", "allow"), 9: ("sub.example.com", "/de/", "example.com/de/", "block"), 10: ("notexample.com", "/de/", None, "allow"), 11: ("f.net", "", None, "allow"),
    }
    assert out[5].trust > 0 and out[2].distrust > 0
    assert urlfilter.filtered(spark.createDataFrame([], "page_id long, url string, html string"), urlfilter.RULES).count() == 0


def brute_ranks(seeds, edges, damping=0.85, rounds=200):
    """Personalised PageRank by hand: mass on hosts without outgoing edges is lost."""
    total = sum(seeds.values())
    base = {h: n / total for h, n in seeds.items()} if total else {}
    out = Counter()
    for (u, _), n in edges.items():
        out[u] += n
    now = dict(base)
    for _ in range(rounds if edges else 0):
        new = Counter({h: (1 - damping) * m for h, m in base.items()})
        for (u, v), n in edges.items():
            new[v] += damping * now.get(u, 0.0) * n / out[u]
        now = dict(new)
    return now


def test_url_ranks_equal_brute_force(spark):
    rng = np.random.default_rng(14)
    hosts = [f"h{i}.{'net' if i % 7 == 0 else 'example.net' if i % 5 == 0 else 'com'}" for i in range(40)]
    pages, edges, seeds = [], Counter(), (Counter(), Counter())
    for i in range(400):
        h = hosts[int(rng.integers(0, 40)) if i % 3 else 0]  # a third of all pages on one host
        path = "/en/" if "example" in h else "/"
        links = sorted({hosts[j] for j in rng.integers(0, 40, 3)})
        html = "x" * 200_000 * (i == 5) + "".join(f"<a class=k href='https://{x.upper()}/p{i}'>" for x in links)
        pages.append((i // 2, f"http://{h}{path}{i}", html, 7, "t", 1.5, "v", "r"))
        edges.update((h, x) for x in links if x != h)
        seeds[0][h] += "example.net" in h
        seeds[1][h] += h.endswith(".net") and "example.net" not in h
    schema = "page_id long, url string, html string, host int, host2 string, trust double, verdict string, rule string"
    frame = spark.createDataFrame([*pages, (None, None, None, None, None, None, None, None)], schema)
    got = urlfilter.filtered(frame, urlfilter.RULES, tolerance=1e-9).collect()
    assert len(got) == 401
    trust = brute_ranks({h: n for h, n in seeds[0].items() if n}, edges)
    distrust = brute_ranks({h: n for h, n in seeds[1].items() if n}, Counter({(v, u): n for (u, v), n in edges.items()}))
    for r in got:
        if r.url is None:
            assert (r.host, r.path, r.rule, r.verdict) == ("", "", None, "allow")
            continue
        t, d = trust.get(r.host, 0.0), distrust.get(r.host, 0.0)
        assert math.isclose(r.trust or 0.0, t, abs_tol=1e-7) and math.isclose(r.distrust or 0.0, d, abs_tol=1e-7)
        ruled = "allow" if "example.net" in r.host else "block" if r.host.endswith(".net") else None
        assert r.verdict == (ruled or ("block" if d > 0.5 * (t + d) else "allow")) and r.host2 == "t"
    assert {r.verdict for r in got if r.host.endswith(".com")} == {"allow", "block"}


def test_words_of_a_language_model_are_told_apart(spark):
    word = "a"
    for _ in range(10):  # a word and its complement, which hashes by powers of a number can't tell apart
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [word, other, "x" * 300, "x" * 299 + "y", "x" * 299, "ab", "ba", "abcdefgh", "abcdefghi", "abcdefgh i", "", "a\x00", "a"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    hashes, of = lm.tokens(data, np.cumsum([0, *map(len, texts)]))
    named = {}
    for h, w in zip(hashes.tolist(), [w for t in texts for w in [*t.split(), None]], strict=True):
        assert named.setdefault(h, w) == w
    assert len(named) == len({w for t in texts for w in t.split()}) + 1
    rows = [(i, t) for i, t in enumerate([*texts, *texts, None, None])]
    model = lm.fit(docs(spark, [(1, word), (1, word), (2, other)]), bytes_per_shard=500)
    got = {r.id: r for r in lm.scored(docs(spark, rows), model).collect()}
    assert (model.n, model.v) == (6, 3) and got[0].score > got[1].score and got[2].n_known == 1
    assert {got[i].score for i in (10, 23, 26, 27)} == {got[10].score}


def vectors(spark, x, extra=()):
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


BAD = [(900, None), (901, []), (902, [1.0, None] * 4), (903, [float("nan")] * 8), (904, [1.0, 2.0]), (None, [1.0] * 8)]


def test_top_k(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 0.2, (700, 8))
    x[50:90] = x[50]  # ties
    frame = topk.whole_numbers(vectors(spark, x, BAD))
    got = topk.top_k(frame, frame.where("id % 20 = 0"), 5, rows_per_shard=150, queries_per_block=10).collect()
    whole = np.floor(x * 256).astype(np.int64)
    want = []
    for q in range(0, 700, 20):
        s = whole @ whole[q]
        order = [i for i in np.lexsort((np.arange(700), -s)) if i != q][:5]
        want += [(q, k + 1, i, int(s[i])) for k, i in enumerate(order)]
    assert sorted((r.query_id, r["rank"], r.id, r.score) for r in got) == sorted(want)
    few = topk.whole_numbers(vectors(spark, x[:3]))
    assert topk.top_k(few, few, 5).count() == 6
    none = topk.whole_numbers(vectors(spark, []))
    assert topk.top_k(none, none).count() == 0


def test_top_k_repeated_ids_and_odd_columns(spark):
    rng = np.random.default_rng(16)
    x = rng.normal(0, 0.2, (90, 8))
    ids = [i // 3 for i in range(90)]  # each id three times
    rows = [(i, [float(c) for c in v], 1, "x", 2.0) for i, v in zip(ids, x, strict=True)]
    frame = topk.whole_numbers(spark.createDataFrame(rows, "vec_id long, embedding array<double>, part int, v string, id double"))
    got = [tuple(r) for r in topk.top_k(frame, frame.where("id % 10 = 0"), 4, rows_per_shard=40, queries_per_block=5, chunk=8).collect()]
    whole = np.floor(x * 256).astype(np.int64)
    for q in (0, 10, 20):
        best = sorted(((-int(whole[j] @ whole[i]), ids[j]) for i in range(90) if ids[i] == q for j in range(90) if ids[j] != q))[:4]
        assert sorted(r for r in got if r[0] == q) == [(q, k + 1, j, -s) for k, (s, j) in enumerate(best)]


@pytest.mark.parametrize("kind", ["even", "falling", "groups", "copies", "huge"])
def test_maxscore_is_exact_and_saves_work(kind):
    rng = np.random.default_rng(12)
    x = rng.normal(0, 1, (4096, 64))
    if kind == "falling":
        x *= np.exp(-np.arange(64) / 8)
    if kind == "groups":
        x = rng.normal(0, 1, (16, 64))[rng.integers(0, 16, 4096)] + 0.2 * x
    if kind == "copies":
        x[:1500] = x[0]
    x = np.floor(x / np.sqrt((x * x).sum(1, keepdims=True)) * (1 << 40 if kind == "huge" else 256)).astype(np.int64)
    order, ends = topk.chunks_of(x, 256)
    own = rng.choice(4096, 256, replace=False)
    work = {}
    best = topk.maxscore(topk.Shard(x[order], order, ends), x[own], own, 5, work)
    scores = x[own] @ x.T
    want = []
    for i, q in enumerate(own.tolist()):
        want += [(i, int(j), int(scores[i, j])) for j in [j for j in np.lexsort((np.arange(4096), -scores[i])) if j != q][:5]]
    assert list(zip(best.query.tolist(), best.id.tolist(), best.score.tolist(), strict=True)) == want
    assert work["done"] <= work["all"] * {"falling": 0.7, "groups": 0.7}.get(kind, 1)


def test_maxscore_costs_no_more_than_the_plain_product():
    import time

    rng = np.random.default_rng(13)
    x = rng.normal(0, 1, (4096, 64))
    x = np.floor(x / np.sqrt((x * x).sum(1, keepdims=True)) * 256).astype("<i2")
    asked, own = x[:1024].astype(np.int64), np.arange(1024)
    order, ends = topk.chunks_of(x, topk.CHUNK)
    shard = topk.Shard(x[order], order, ends)

    def plain():  # whole numbers, a partition and the order of what it gives
        scores = asked.astype(np.float64) @ x.astype(np.float64).T
        scores[own, own] = -np.inf
        near = np.argpartition(-scores, 5, axis=1)[:, :5]
        return np.lexsort((near, -np.take_along_axis(scores, near, axis=1)), axis=1)

    def took(f):
        runs = []
        for _ in range(5):
            began = time.perf_counter()
            f()
            runs.append(time.perf_counter() - began)
        return min(runs)

    assert took(lambda: topk.maxscore(shard, asked, own, 5)) <= 2 * took(plain)  # twice, for a busy machine


def test_vector_near_duplicates(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (400, 8))
    for i in range(0, 300, 3):
        x[i + 1] = x[i] + rng.normal(0, 0.12, 8)
    x[310:330], x[331], x[340] = x[310], x[310] * 3, 0
    frame = vectors(spark, x, BAD)
    got = {r.id: r for r in vectordup.near_duplicates(frame, block=64, tile=16).collect()}
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    u = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    comp = small_components(400, [(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True)])
    assert all((got[i].n_links, got[i].component) == (near[i].sum(), comp[i]) for i in range(400))
    assert all((got[i].n_links, got[i].component) == (0, i) for i in (900, 901, 902, 903, 904, None))
    assert vectordup.near_duplicates(vectors(spark, [])).count() == 0


def test_vectors_of_any_scale_and_repeated_ids(spark):
    tiny, huge = [1e-200, 1e-200, 2e-200, 0.0], [1e200, 1e200, 2e200, 0.0]
    rows = [(1, tiny), (2, huge), (3, [1.0, 1.0, 2.0, 0.0]), (4, [1.0, 0.0, 0.0, 0.0]), (4, [1.0, 0.0, 0.0, 0.0]), (4, [0.0, 0.0, 0.0, 1.0]), (5, [-0.0, 0.0, 0.0, 7.0]), (6, [5e-324, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame([(i, v, 1, "x", 2.0) for i, v in rows], "vec_id long, embedding array<double>, n int, key string, block double")
    got = sorted((r.id, r.n_links, r.component) for r in vectordup.near_duplicates(frame).collect())
    assert got == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 1, 4), (4, 2, 4), (4, 2, 4), (5, 1, 4), (6, 2, 4)]


def test_vectors_of_several_lengths(spark):
    rows = [(5, [1.0, 0.0, 0.0]), (2, [1.0, 0.01, 0.0]), (9, [0.0, 1.0, 0.0]), (1, [1.0, 0.0]), (3, [1.0, 0.02]), (4, [1.0, 0.0]), (8, [2.0]), (7, [3.0]), (6, [-3.0]), (10, []), (11, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.id: (r.n_links, r.component) for r in vectordup.near_duplicates(frame).collect()}
    assert got == {5: (1, 2), 2: (1, 2), 9: (0, 9), 1: (2, 1), 3: (2, 1), 4: (2, 1), 8: (1, 7), 7: (1, 7), 6: (0, 6), 10: (0, 10), 11: (0, 11)}


def test_html(spark, table):
    page = (
        '<html><head><title>t</title></head><body><div class="topmenu"><a href=x>Home</a></div><div class="cookie-notice">We use cookies, ok?</div><div id="content"><h2>Title here</h2><p>First para &amp; more,&nbsp;text.'
        '<ul><li>one<li>two</ul><form><input> name <button>send</button></form><div class="comments"><p>Nice post, really great stuff, I like it very much.</p></div></div><div id="sidebar"><p>links and more.</p></div><p class=footer>c 2020</body>'
    )
    cases = {1: (page, "Title here\n\nFirst para & more, text.\n\none\n\ntwo"), 2: (None, ""), 3: ("", ""), 4: ("plain text", "plain text"), 5: ("<p>a<p>b", "a\n\nb"), 6: ("<div", ""), 7: ("<b>x</b> y <i>z", "x y z"), 8: ('<script>var x="<p>";</script><p>hi</p>', "hi"), 9: ("<article></article>", "")}
    rows = [(i, f"u{i}" if i % 2 else None, h) for i, (h, _) in cases.items()]
    got = {r.id: r for r in htmltext.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: r.text for i, r in got.items()} == {i: t for i, (_, t) in cases.items()}
    assert got[2].url is None


def test_html_keeps_whole_articles(spark):
    import html
    import re

    for r in common.table(spark, SF, "pages").collect():
        article = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        blocks = (" ".join(html.unescape(re.sub(r"</?b>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", article))
        assert htmltext.main_text(r.html) == "\n\n".join(x for x in blocks if x)


def test_fold_column(spark):
    rows = [(0,), (7,), (123456,), (None,)]
    got = spark.createDataFrame(rows, "doc_id long").select("doc_id", common.fold_of("doc_id", 5).alias("f")).collect()
    assert all(r.f == common.fold(r.doc_id, 5) for r in got)


def test_pipeline(spark):
    import corpus_pipeline

    frame, columns = common.table(spark, SF, "documents"), None
    before = frame.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, SF)
        if name != "best_fit_packing":
            columns = columns or frame.columns
            assert out.columns == columns
            assert out.where(F.col("n_chars") != F.char_length("text")).count() == 0
            frame = common.cut(out)
            assert 0 < frame.count() <= before
    pieces = corpus_pipeline.run(spark, SF)
    ids = {r.doc_id for r in pieces.select("doc_id").distinct().collect()}
    assert ids == {r.doc_id for r in frame.select("doc_id").collect()}


def test_rows_of_one_id_with_unlike_texts_stay(spark):
    say = lambda k: " ".join(f"{k}word{i}" for i in range(40))
    rows = [(1, say("a")), (1, say("b")), (1, say("a")), (2, say("b") + " more"), (2, say("c")), (3, None), (3, ""), (3, say("d")), (None, say("a")), (None, say("a"))]
    kept = sorted(((r.doc_id, r.text) for r in simhash.without_near_duplicates(docs(spark, rows)).collect()), key=str)
    assert [t or "" for i, t in kept if i == 3 and not t] == [""]
    assert [x for x in kept if x[1]] == sorted([(1, say("a")), (1, say("b")), (2, say("c")), (3, say("d")), (None, say("a")), (None, say("a"))], key=str)


def test_pipeline_on_odd_tables(spark, monkeypatch):
    import corpus_pipeline

    say = lambda k: " ".join(f"{k}word{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, say("a")), (4, say("a")), (4, say("b")), (None, "no id at all"), (5, "é" * 60_000), (5, "é" * 60_000)]
    frame = spark.createDataFrame([(i, t, "x", 2.0, "p", 3) for i, t in rows], "doc_id long, text string, id string, toxicity double, place string, key int")
    for table_ in (frame, frame.limit(0)):
        monkeypatch.setattr(common, "table", lambda spark, sf_dir, name, t=table_: t if name == "documents" else spark.createDataFrame([(3, 0), (None, 1), (4, None)], "doc_id long, toxic int"))
        out, now = corpus_pipeline.run(spark, SF).collect(), table_
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = common.cut(stage(spark, now, SF))
            assert now.columns == table_.columns
        assert sorted({str(r.doc_id) for r in out}) == sorted({str(r.doc_id) for r in now.collect()})
        assert (len(out) == 0) == (table_ is not frame)
    kept = Counter(str(r.doc_id) for r in out) if out else Counter(str(r.doc_id) for r in corpus_pipeline.drop_near_duplicates(spark, frame, SF).collect())
    assert kept == Counter({"1": 1, "3": 1, "4": 1, "5": 1, "None": 1})


def brute_groups(rows):
    """Smallest id of each row's group of pairs with a five-word Jaccard similarity of 0.8 or more, by all pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))})
    near = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    comp = small_components(len(rows), [(i, j) for j in range(len(order)) for i in range(j) if near(sets[order[i]], sets[order[j]])])
    return {rows[order[k]][0]: rows[order[c]][0] for k, c in enumerate(comp)}


def test_near_duplicate_stage_is_five_words_and_similarity(spark, table):
    import corpus_pipeline
    from listing_lake.llm import shingledup

    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(400)]
    line = "a line that very many of the texts have in common"
    rows = [(r.doc_id, r.text) for r in table.collect()]
    for g in range(30):
        base = list(rng.choice(words, 60 + 9 * g))
        for m in range(5):  # copies with 0 to 4 other words: similarities on both sides of 0.8
            text = list(base)
            for at in rng.choice(len(base), m, replace=False):
                text[at] = f"x{g}-{m}-{at}"
            rows.append((10_000 + 10 * g + m, " ".join(text)))
    rows += [(20_000 + i, line + " " + " ".join(rng.choice(words, 30))) for i in range(40)]
    base = list(rng.choice(words, 100))
    rows += [(30_000 + i, " ".join([*base[:i], f"y{i}", *base[i + 1 :]])) for i in range(60)]
    rows += [(40_000, None), (40_001, ""), (40_002, "one two"), (40_003, "One  two"), (40_004, "one two three")]
    want = brute_groups(rows)
    assert {r.id: r.component for r in shingledup.near_duplicates(docs(spark, rows)).collect()} == want
    kept = corpus_pipeline.drop_near_duplicates(spark, docs(spark, rows), SF)
    assert {r.doc_id for r in kept.collect()} == set(want.values())


def test_sketches_never_rule_out_a_similar_pair(spark):
    from listing_lake.llm import shingledup

    rng = np.random.default_rng(12)
    rows, want = [], {}
    for i, n in enumerate([1, 4, 5, 9, 40, 300, 2_000, 20_000] * 6):
        x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        gone = int(rng.integers(0, n // 4 + 1))
        y = np.concatenate([x[gone:], rng.integers(0, 1 << 63, int(rng.integers(0, n // 5 + 1)), dtype=np.uint64)]) if i % 3 else rng.integers(0, 1 << 63, n, dtype=np.uint64)
        same = len(np.intersect1d(x, y))
        want[i] = 5 * same >= 4 * (len(x) + len(y) - same)
        rows.append((i, len(x), shingledup.sketch(x), len(y), shingledup.sketch(y)))
    frame = spark.createDataFrame(rows, "i int, nx long, sx array<long>, ny long, sy array<long>")
    both = frame.selectExpr("i", "struct(nx AS n, sx AS sketch) AS x", "struct(ny AS n, sy AS sketch) AS y")
    got = {r.i: r.near for r in both.select("i", shingledup.may_be_near("x", "y", (4, 5)).alias("near")).collect()}
    assert all(got[i] for i in want if want[i]) and any(want.values())
    assert not any(got[i] for i in want if i % 3 == 0 and 5 <= rows[i][1] <= 2_000)  # unlike sets are ruled out


def test_html_keeps_all_parts_of_pages_without_article():
    say = lambda k, n: " ".join(f"Sentence {k} {i} tells something, in some words." for i in range(n))
    menu = '<div class="menu"><a href=x>Home</a> <a href=y>News</a></div>'
    items = [f"Point {i} of the list is long enough, it has a mark and a good many words." for i in range(12)]
    lists = {
        "ul": "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", "dl": "<dl>" + "".join(f"<dd>{x}</dd>" for x in items) + "</dl>",
        "table": "<table><tbody>" + "".join(f"<tr><td>{x}</td></tr>" for x in items) + "</tbody></table>",
    }
    page = lambda inner: f"<html><body>{menu}<div>{inner}</div></body></html>"
    two = f"<section><p>{say('a', 4)}</p></section><section><p>{say('b', 6)}</p></section>"
    assert htmltext.main_text(page(two)) == f"{say('a', 4)}\n\n{say('b', 6)}"
    assert htmltext.main_text(page(two.replace("section", "div"))) == f"{say('a', 4)}\n\n{say('b', 6)}"
    for markup in lists.values():
        assert htmltext.main_text(page(f"<h2>Head</h2><p>Short one.</p>{markup}<p>End.</p>")) == "\n\n".join(["Head", "Short one.", *items, "End."])
        assert htmltext.main_text(page(f"<section><p>Short one.</p></section><section>{markup}</section>")) == "\n\n".join(["Short one.", *items])
        assert htmltext.main_text(page(f"<p>Short one.</p><div>{markup}</div>")) == "\n\n".join(["Short one.", *items])
    assert htmltext.main_text(page(two.replace("section", "article"))) == f"{say('a', 4)}\n\n{say('b', 6)}"
    assert htmltext.main_text(f"<body>{menu}<article><p>{say('c', 3)} <math><mi>x</mi></math></p><noscript><p>Fallback.</p></noscript></article></body>") == f"{say('c', 3)} x\n\nFallback."
    assert htmltext.main_text(f"<body><noscript>Please allow scripts.</noscript>{menu}<div>{two}</div></body>") == f"{say('a', 4)}\n\n{say('b', 6)}"


def brute_neighbours(index, terms, weights):
    """By all cosines."""
    flat = np.zeros((len(index.ids), len(index.weight)))
    flat[index.rows, index.cols] = index.values
    cos = flat[:, terms] @ weights if len(terms) else np.zeros(len(index.ids))
    return [(int(n), cos[n]) for n in np.lexsort((np.arange(len(cos)), -np.round(cos, 12)))[: index.k] if cos[n] > 1e-12]


@pytest.mark.parametrize("kind", ["even", "few strong terms", "copies"])
def test_block_max_index_gives_the_exact_neighbours(kind, monkeypatch):
    monkeypatch.setattr(toxicity, "FIRST_POSTINGS", 128)
    rng = np.random.default_rng(21)
    n, v = 900, 1500
    rows, cols = np.nonzero(rng.random((n, v)) < 0.02 + 0.3 * (np.arange(v) % 50 == 0) + 0.1 * (np.arange(v) % 50 == 1))
    values = rng.random(len(rows))
    if kind == "few strong terms":
        values *= np.where(cols % 50 == 1, 1000.0, 1.0)
    if kind == "copies":  # a hundred rows with the same vector: ties at the last place
        keep = rows >= 100
        one = np.nonzero(rows == 100)[0]
        rows, cols, values = np.append(np.repeat(np.arange(100), len(one)), rows[keep]), np.append(np.tile(cols[one], 100), cols[keep]), np.append(np.tile(values[one], 100), values[keep])
    values /= np.sqrt(np.bincount(rows, values * values, n))[rows]
    index = toxicity.Index({}, np.ones(v), np.arange(n), np.zeros(n), rows.astype(np.int32), cols.astype(np.int32), values, 0.1)
    work, all_postings = {}, 0
    for i in range(60):
        mine = rows == (100 if i == 0 else i * 13)
        terms, weights = cols[mine], values[mine] * rng.random(mine.sum()) if i % 3 else values[mine]
        weights = weights / np.sqrt((weights * weights).sum())
        all_postings += int((index.ends[terms + 1] - index.ends[terms]).sum())
        got, want = index.nearest(terms.astype(np.int64), weights, work), brute_neighbours(index, terms, weights)
        assert [a for a, _ in got] == [a for a, _ in want] and np.allclose([c for _, c in got], [min(c, 1) for _, c in want])
    assert not index.scratch.any() and index.nearest(np.zeros(0, np.int64), np.zeros(0)) == []
    if kind == "few strong terms":
        assert work["postings"] < 0.8 * all_postings


def test_toxicity_on_held_out_labels(spark):
    """Learned as op7 does on the smallest tables: most labelled documents that were held out are told."""
    out = toxicity.op7_toxicity(spark, "/root/testdata/sf0.01").join(common.table(spark, "/root/testdata/sf0.01", "labels").select("doc_id", "toxic"), "doc_id")
    rows = out.where("held_out").select("score", "toxic", "predicted").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert len(toxic) >= 5 and sum(r.predicted for r in toxic) >= 0.6 * len(toxic) and sum(r.predicted for r in clean) <= 0.1 * len(clean)
    assert np.mean([(r.score - r.toxic) ** 2 for r in rows]) < 0.06


def test_toxicity_copied_text_leaves_no_term_out(spark):
    rng = np.random.default_rng(7)
    letters = lambda i: "".join(chr(97 + (i // 26**k) % 26) for k in range(3))
    words = ["w" + letters(i) for i in range(300)]
    copied = " ".join("q" + letters(7 * i) * 2 for i in range(600))  # some hundred words of its own
    rows = [(i, " ".join(rng.choice(words, 40)) + (" vilest grim" if i % 6 == 0 else "")) for i in range(600)]
    labels = [(i, int(i % 6 == 0)) for i in range(600)] + [(1000 + i, 1) for i in range(200)]
    frame = docs(spark, rows + [(1000 + i, copied) for i in range(200)] + [(2000, "vilest grim"), (2001, " ".join(rng.choice(words, 40)))])
    index = toxicity.fit(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {"vilestgrim"} & set(index.terms) == set() and {"vilest", "grim"} <= set(index.terms)
    assert not [t for t in index.terms if t.startswith("q")]  # one text's own words: of copies one is an example
    n = sum("grim" in t for _, t in rows) + 1
    examples = [t for _, t in rows] + [copied]
    base, held = 101 / 601, sum("grim" in t.split() for t in examples)
    chi = (held - held * base) ** 2 / (held * base * (1 - base))
    assert math.isclose(index.weight[index.terms["grim"]], math.log(803 / (1 + n)) * chi)
    got = {r.id: r.score for r in toxicity.score(frame, index).collect()}
    assert got[2000] >= 0.3
    # six hundred words, each of eight toxic texts: all are terms
    many = [(i, " ".join("v" + letters(7 * (i % 25 + 25 * j)) * 2 for j in range(24)) if i < 200 else " ".join(rng.choice(words, 24))) for i in range(2000)]
    wide = toxicity.fit(docs(spark, [(i, f"{t} u{letters(i)}") for i, t in many]), spark.createDataFrame([(i, int(i < 200)) for i, _ in many], "doc_id long, toxic int"))
    assert {"v" + letters(7 * k) * 2 for k in range(600)} <= set(wide.terms)


def _say(k, n):
    return " ".join(f"Sentence {k} {i} tells something, in some words." for i in range(n))


#: Pages without article or main and with names that say nothing: only the ratios tell what is content.
ODD_PAGES = {
    "paragraphs": (
        '<body><div class="q1"><a href=a>Home</a> <a href=b>News</a> <a href=c>All about us</a></div><div class="q2">Buy now. Cheap!</div>'
        f'<div class="q3"><h1>A title of it</h1><p>{_say("a", 3)}</p><p>Short.</p><p>{_say("b", 4)} <a href=x>with a link</a></p></div><div class="q4">All rights, 2020.</div></body>',
        f"A title of it\n\n{_say('a', 3)}\n\nShort.\n\n{_say('b', 4)} with a link",
    ),
    "sections": (
        f'<body><ul class=z><li><a href=a>One</a><li><a href=b>Two</a></ul><div id=k9><section><p>{_say("a", 9)}</p></section><section><p>{_say("b", 1)}</p></section></div><div>Call us.</div></body>',
        f"{_say('a', 9)}\n\n{_say('b', 1)}",
    ),
    "stray quotes": (
        f'<body><div class=x"><a href="a>">Home</a></div><div id="m" class=y\'><p title="a > b" class=z">{_say("a", 3)} "quoted".</p><p data-x=\'>\'>{_say("b", 2)}</p></div><div>Fin</div></body>',
        f"{_say('a', 3)} \"quoted\".\n\n{_say('b', 2)}",
    ),
    "table layout": (
        f"<body><table><tr><td><a href=a>Home</a><br><a href=b>News</a></td><td><p>{_say('a', 4)}</p><p>{_say('b', 2)}</p></td><td>Weather today</td></tr></table></body>",
        f"{_say('a', 4)}\n\n{_say('b', 2)}",
    ),
}


@pytest.mark.parametrize("name", sorted(ODD_PAGES))
def test_html_ratios_find_the_content(name, monkeypatch):
    page, want = ODD_PAGES[name]
    assert htmltext.main_text(page) == want
    monkeypatch.setattr(htmltext, "content_nodes", lambda page: ([page.nodes[0]], {}))  # without the method: the whole page
    assert htmltext.main_text(page) != want


def test_html_names_of_parts_only_weigh():
    main = f"<p>{_say('a', 4)}</p>"
    for kept in ('<p class="share-price">Kept, too.</p>', '<p id="legal">Kept, too.</p>', '<div class="widget-review">Kept, too.</div>', "<header><h1>Kept, too.</h1></header>"):
        assert htmltext.main_text(f"<body><article>{main}{kept}</article></body>") == f"{_say('a', 4)}\n\nKept, too."
    for gone in ('<div class="ad">', '<section id="comments-section">', '<div class="cookie notice">', '<div class="sidebar-right">', "<aside>", "<form>", '<div role="search">', "<div hidden>", "<footer>", '<ul class="menu"><li>'):
        for box in ("article", "div"):
            assert htmltext.main_text(f"<body><{box}>{main}{gone}Gone, all of it. {_say('c', 6)}</{gone[1:].split()[0].strip('>')}></{box}></body>") == _say("a", 4), gone
    # a page whose whole text stands in such a part keeps it
    assert htmltext.main_text(f'<body><div class="widget post"><p>{_say("a", 4)}</p></div></body>') == _say("a", 4)
    assert htmltext.main_text(f'<body><div id="comments"><p>{_say("a", 4)}</p></div></body>') == _say("a", 4)
    assert htmltext.main_text('<body><nav>Menu</nav><div class="ad">Buy now, it is cheap.</div><article></article></body>') == ""


def test_html_deep_and_wide_pages(spark):
    deep = "<div>" * 50_000 + f"<p>{_say('a', 2)}</p>"
    wide = "<body>" + "<b>" * 20_000 + "</i>" * 50_000 + "".join(f"<p>Line {i}, of many.</b>" for i in range(20_000))
    cards = "<body>" + "".join(f"<article><p>Card {i}, with words.</p></article>" for i in range(5000))
    rows = [(1, "u", deep, 5, "x"), (1, "u", deep, 5, "x"), (None, None, wide, None, None), (3, "u", cards, 1, "y"), (4, "u", "é" * 3_000_000, 1, "y")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text int, id string")  # the last two clash with working names
    got = sorted(((r.id, r.url, r.text) for r in htmltext.extracted(frame).collect()), key=str)
    want = [(1, "u", _say("a", 2)), (1, "u", _say("a", 2)), (3, "u", "\n\n".join(f"Card {i}, with words." for i in range(5000)))]
    want += [(4, "u", "é" * 3_000_000), (None, None, "\n\n".join(f"Line {i}, of many." for i in range(20_000)))]
    assert got == want
    assert htmltext.extracted(spark.createDataFrame([], frame.schema)).count() == 0


def test_near_duplicates_begin_with_fingerprints(spark, monkeypatch):
    """Near copies of one text, chains of them and texts of a common passage, against brute force; verified pairs grow with the rows."""
    from listing_lake.llm import shingledup

    rng = np.random.default_rng(11)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    base, rows = word(160), []
    for k in (0, 1, 1, 1, 1, 2, 2, 2, 3, 3, 4, 5, 6) * 6:
        text = list(base)
        for at in rng.integers(0, 160, k):
            text[at] = word(1)[0]
        rows.append(" ".join(text))
    long = word(2000)
    rows += [" ".join([*long[:at], *word(1), *long[at:]]) for at in (5, 900, 1700)] + [" ".join([*base[:30], *word(60)]) for _ in range(12)] + ["", "a b", None]
    table = list(enumerate(rows))
    sets = [frozenset(shingledup.np.unique(shingledup.shingle_hashes((t or "").encode(), 5, 42)).tolist()) for t in rows]
    alike = lambda x, y: x == y or 5 * len(x & y) >= 4 * len(x | y) > 0
    links = [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j])]
    pairs, verified = [], shingledup.verified
    monkeypatch.setattr(shingledup, "verified", lambda p, *a: pairs.append(p.count()) or verified(p, *a))
    got = {r.id: r.component for r in shingledup.near_duplicates(docs(spark, table)).collect()}
    assert [got[i] for i in range(len(rows))] == small_components(len(rows), links)
    assert pairs[0] >= 2  # fingerprints come first, and find the long copies at least
    assert pairs[0] <= len(rows) and sum(pairs) < len(links) / 2


def test_turned_keys_are_not_broadcast(spark):
    """68 rows for each fingerprint, which Spark sizes as one, don't go through the driver."""
    fps = spark.range(2000).select(F.col("id").alias("rep"), F.xxhash64("id").alias("fp"))
    plan = simhash.links(fps)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_a_stored_table_is_looked_up_in_tasks(spark, tmp_path):
    """Any number of rows, in several shards; keys may be negative."""
    import pyarrow as pa

    from listing_lake.llm import arrays

    rows = spark.range(-50, 50).select((F.col("id") * 7).alias("a"), (F.col("id") * 3).alias("b"))
    store = arrays.stored(rows, str(tmp_path), "t", per_shard=9)
    found = arrays.held(store, pa.array(range(-400, 400), pa.int64()), b=np.int64(0))
    assert store[2] == 12 and [(k, b) for k, b, hit in zip(range(-400, 400), found["b"].tolist(), found["hit"], strict=True) if hit] == [(7 * i, 3 * i) for i in range(-50, 50)]
    assert not arrays.held(arrays.stored(rows.limit(0), str(tmp_path), "none"), pa.array([1], pa.int64()), b=np.int64(0))["hit"].any()


def test_texts_are_not_joined_to_find_those_that_stay(spark, monkeypatch):
    """Beyond the bound, neither a shuffle of texts nor a broadcast of what is kept, whose size follows the table."""
    from listing_lake.llm import shingledup

    monkeypatch.setattr(shingledup, "FEW", 0)
    kept = simhash.without_near_duplicates(docs(spark, list(enumerate(["a b c d e f", "a b c d e f", "g", None]))))
    plan = kept._jdf.queryExecution().sparkPlan().toString()
    assert kept.count() == 3 and "Join" not in plan and "Exchange" not in plan
