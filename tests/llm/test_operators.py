"""Each operator against a plain reading of its rule on small tables, and on awkward rows."""

from __future__ import annotations

import hashlib
import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import ann, decontam, langid, lines, packing, recompress, simhash, suffixes, toxicity, urls
from tidemark.llm.common import components
from tidemark.llm.hilbert import hilbert_keys

DOCS = "doc_id long, text string, lang string, source string, n_chars long, name string, h string, fp string, a int, start int"


def docs_of(spark, texts, ids=None):
    """A documents table whose extra columns clash with the operators' own names."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "s", len(t or ""), "x", "y", "z", 1, 2) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n, vocabulary=200):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Nulls, empties, blanks, copies, near copies, shared passages, runs and one long text."""
    rng = random.Random(4)
    passage = prose(rng, 60)
    base = [prose(rng, n) for n in (1, 3, 40, 80, 120)]
    near = base[4].split()
    near[7] = "changed"
    long = prose(rng, 6000)
    return [
        None, "", "  \n\t ", *base, base[3], base[3], " ".join(near), "a " * 90, "a " * 70 + "b", prose(rng, 20) + " " + passage + " " + prose(rng, 9),
        passage + " " + prose(rng, 30), "é ü " + passage, long, "x " + " ".join(long.split()[100:300]), "word" * 300, "ab" * 150, None, "",
    ]


def empty(spark):
    return spark.createDataFrame([], DOCS)


def plain_fingerprint(text, width):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    out = 0
    for bit in range(64):
        ones = sum(xxhash.xxh64_intdigest(s, 42) >> bit & 1 for s in shingles)
        out |= (2 * ones > len(shingles)) << bit
    return out


def roots_of(nodes, links):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


@pytest.mark.parametrize("tile", [3, simhash.TILE])
def test_near_groups_equal_all_pairs(spark, texts, tile):
    ids = [5 * i + 3 for i in range(len(texts))]
    prints = {i: plain_fingerprint(t, 4) for i, t in zip(ids, texts)}
    links = [(a, b) for a, b in itertools.combinations(ids, 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    want = roots_of(ids, links)
    got = {r.doc_id: r for r in simhash.near_dedup_groups(docs_of(spark, texts, ids), tile=tile).collect()}
    assert {i: r.fp[0] % (1 << 64) for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == want


def test_links_lose_nothing_and_stay_linear():
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 1 << 63, 1, dtype=np.uint64)
    near = centre ^ (np.uint64(1) << rng.integers(0, 63, 400).astype(np.uint64))
    every = np.unique(np.concatenate([near, rng.integers(0, 1 << 63, 500, dtype=np.uint64)]))
    every = every[np.argsort(np.bitwise_count(every), kind="stable")][None]
    got = {(i, j) for a, b in simhash.links_between(every, every, 4) for i, j in zip(a.tolist(), b.tolist())}
    apart = np.bitwise_count(every[0][:, None] ^ every[0][None])
    assert got == set(zip(*(x.tolist() for x in np.nonzero(apart <= 4))))


def test_near_dedup_keeps_one_of_each_group(spark, texts):
    kept = {r.doc_id for r in simhash.near_dedup(docs_of(spark, texts)).collect()}
    assert {6, 8, 9} & kept == {6} and not {7, 10} <= kept and 7 in kept
    assert simhash.near_dedup(empty(spark)).count() == 0
    odd = docs_of(spark, ["same text here"] * 3 + [None], [None, 4, 4, None])
    assert simhash.near_dedup(odd).count() == 4


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 140)] + [(7, x) for x in range(200, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    want = roots_of({x for link in links for x in link}, links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: r for n, r in want.items() if any(n in link and link[0] != link[1] for link in links)}


@pytest.mark.parametrize(
    "url, verdict, rule",
    [
        (None, "allow", None), ("", "allow", None), ("no scheme.com/", "allow", None), ("http://a.com/casino", "allow", "com/"),
        ("http://Example.COM/en/x", "block", "example.com/en/"), ("http://www.example.com/en/", "allow", "www.example.com/en/"),
        ("http://badexample.com/en/", "allow", "com/"), ("http://a.net/es/1", "block", "net/es/"), ("http://a.net?x=/es/", "allow", None),
        ("http://casino.org", "block", None), ("http://casinos.org", "allow", None), ("http://free.org/free", "allow", None),
        ("http://FREE.org/BETS", "block", None), ("a://b://c.com/", "allow", None), ("http://" + "a" * 50000 + ".org/porn", "block", None),
    ],
)
def test_url_verdicts(spark, url, verdict, rule):
    from tidemark.llm.queries import URL_RULES

    page = spark.createDataFrame([(1, url, "h")], "page_id long, url string, host string")
    got = urls.url_verdicts(page, URL_RULES).first()
    assert (got.verdict, got.rule) == (verdict, rule)


def test_url_verdicts_of_nothing(spark):
    assert urls.url_verdicts(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_packing_places_every_word_once(spark, texts):
    sizes = (16, 64, 128)
    rows = packing.pack(docs_of(spark, texts), sizes, group=5).collect()
    for i, t in enumerate(texts):
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert sum(r.n_words for r in mine) == len((t or "").split()) and [r.start for r in mine] == [128 * k for k in range(len(mine))]
    bins = {}
    for r in rows:
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append(r)
    for inside in bins.values():
        inside.sort(key=lambda r: r.bin_offset)
        assert [r.bin_offset for r in inside] == [0, *itertools.accumulate(r.n_words for r in inside)][:-1]
        used = sum(r.n_words for r in inside)
        assert {(r.capacity, r.bin_words) for r in inside} == {(min(c for c in sizes if c >= used), used)}
    assert packing.pack(empty(spark)).count() == 0


def test_packed_texts_are_the_documents(spark, texts):
    sequences = packing.packed_sequences(docs_of(spark, texts), (16, 64, 128)).collect()
    words = sorted(w for s in sequences for w in s.text.split())
    assert words == sorted(w for t in texts for w in (t or "").split())
    assert all(s.n_words == len(s.text.split()) <= s.capacity for s in sequences)


def test_best_fit_wastes_little():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 2049, 3000)
    where, _, final = packing.best_fit(lengths)
    assert lengths.sum() / final.sum() > 0.98 and (np.bincount(where, lengths) <= final).all()


def plain_lines(texts, reach):
    seen, gone = set(), {}
    for i, t in enumerate(texts):
        listed = [(p, line.strip(" ")) for p, line in enumerate((t or "").split("\n")) if line.strip(" ")]
        cover = set()
        for k in range(len(listed) - reach + 1):
            window = tuple(line for _, line in listed[k : k + reach])
            if window in seen:
                cover |= set(range(k, k + reach))
            seen.add(window)
        out, ranks = set(), sorted(cover)
        for a, b in zip(ranks, ranks):
            out.add(listed[a][0])
            if a + 1 in cover:
                out |= set(range(listed[a][0], listed[a + 1][0]))
        gone[i] = out
    return gone


@pytest.mark.parametrize("gram, window", [(2, 2), (1, 2), (1, 1), (1, 4), (2, 5)])
def test_line_dedup_equals_brute_force(spark, gram, window):
    rng = random.Random(9)
    texts = ["\n".join(rng.choice(["a", "b", "c", "", " a ", "dd"]) for _ in range(rng.randrange(0, 14))) for _ in range(60)] + [None, "", "\n\n\n", "x\n" * 500]
    gone = plain_lines(texts, gram + window - 1)
    got = {r.doc_id: r for r in lines.line_dedup(docs_of(spark, texts), gram, window).collect()}
    for i, t in enumerate(texts):
        want = None if t is None else "\n".join(line for p, line in enumerate(t.split("\n")) if p not in gone[i])
        assert (got[i].text, got[i].n_removed) == (want, len(gone[i]))
    assert lines.line_dedup(empty(spark)).count() == 0
    twice = docs_of(spark, ["p\nq\nr\ns"] * 3, [1, 1, None])
    assert {r.text for r in lines.line_dedup(twice).collect()} == {"p\nq\nr\ns"}


def test_hilbert_curve_visits_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    path = grid[np.argsort(hilbert_keys(grid, 3))]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_nearest_neighbours_recall_scores_and_ties(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(1500, 16))
    vectors[700:1000] = vectors[700]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    rows += [(2000, None, 0), (2020, [0.0] * 16, 0), (2040, [float("nan")] * 16, 0), (2060, [1.0] * 15, 0), (2080, [None] + [1.0] * 15, 0), (40, rows[40][1], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in ann.nearest(table, table.filter("vec_id % 20 = 0"), block=64).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 20))
    found = 0
    for q, answers in got.items():
        answers.sort()
        score = (vectors * vectors[q]).sum(1)
        best = sorted((i for i in range(1500) if i != q), key=lambda i: (-score[i], i))[:20]
        assert [a[0] for a in answers] == list(range(1, 21))
        assert all(abs(a[2] - score[a[1]]) < 1e-12 for a in answers)
        assert [(a[2], -a[1]) for a in answers] == sorted(((a[2], -a[1]) for a in answers), reverse=True)
        found += len({a[1] for a in answers} & set(best))
    assert found >= 0.9 * 20 * len(got)
    assert ann.nearest(table.limit(0), table.limit(0)).count() == 0
    few = table.filter("vec_id < 3")
    assert ann.nearest(few, few).count() == 6


def plain_cover(units, window, earlier_only):
    first, count = {}, {}
    for d in sorted(units):
        for s in range(len(units[d]) - window + 1):
            key = tuple(units[d][s : s + window])
            first.setdefault(key, (d, s))
            count[key] = count.get(key, 0) + 1
    gone = {}
    for d in units:
        gone[d] = set()
        for s in range(len(units[d]) - window + 1):
            key = tuple(units[d][s : s + window])
            if count[key] > 1 and not (earlier_only and first[key] == (d, s)):
                gone[d] |= set(range(s, s + window))
    return gone


def random_texts(rng, letters, sizes, glue):
    stock = [glue.join(rng.choice(letters) for _ in range(rng.choice(sizes))) for _ in range(12)]
    return [glue.join(rng.choice(stock) for _ in range(rng.randrange(1, 6))) for _ in range(60)]


@pytest.mark.parametrize("seed, letters", [(1, "abcdefghijkl"), (2, "ab"), (3, "a")])
def test_word_dedup_equals_brute_force(spark, seed, letters):
    texts = random_texts(random.Random(seed), letters, (3, 20, 40), " ") + ["a " * 80, "b " * 40, "a b " * 50]
    gone = plain_cover({i: t.split() for i, t in enumerate(texts)}, 35, False)
    for r in recompress.substring_dedup(docs_of(spark, texts)).collect():
        words = texts[r.doc_id].split()
        kept = " ".join(w for p, w in enumerate(words) if p not in gone[r.doc_id])
        assert (r.n_words, r.n_removed) == (len(words), len(gone[r.doc_id]))
        assert r.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def test_word_dedup_of_awkward_rows(spark, texts):
    gone = plain_cover({i: (t or "").split() for i, t in enumerate(texts)}, 35, False)
    got = {r.doc_id: r.n_removed for r in recompress.substring_dedup(docs_of(spark, texts)).collect()}
    assert got == {i: len(g) for i, g in gone.items()}
    assert recompress.substring_dedup(empty(spark)).count() == 0
    twice = docs_of(spark, [texts[6]] * 4, [1, 1, None, None])
    assert [r.n_removed for r in recompress.substring_dedup(twice).collect()] == [0] * 4


@pytest.mark.parametrize("seed, letters, most", [(1, "abcdefghé", 8000), (2, "ab", 8000), (3, "abc", 2), (4, "a", 2)])
def test_byte_dedup_equals_brute_force(spark, seed, letters, most):
    texts = random_texts(random.Random(seed), letters, (10, 60, 150), "") + ["a" * 300, "ab" * 120, None, "", "é" * 60]
    raw = {i: (t or "").encode() for i, t in enumerate(texts)}
    gone = plain_cover(raw, 100, True)
    for r in suffixes.suffix_dedup(docs_of(spark, texts), most=most).collect():
        kept = bytes(b for p, b in enumerate(raw[r.doc_id]) if p not in gone[r.doc_id])
        places = sorted(gone[r.doc_id])
        spans = sum(p - 1 not in gone[r.doc_id] for p in places)
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(raw[r.doc_id]), len(places), spans)
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_byte_dedup_of_awkward_rows(spark, texts):
    raw = {i: (t or "").encode() for i, t in enumerate(texts)}
    gone = plain_cover(raw, 100, True)
    assert {r.doc_id: r.n_removed for r in suffixes.suffix_dedup(docs_of(spark, texts)).collect()} == {i: len(g) for i, g in gone.items()}
    assert suffixes.suffix_dedup(empty(spark)).count() == 0
    twice = docs_of(spark, [texts[6]] * 4, [1, 1, None, None])
    assert [r.n_removed for r in suffixes.suffix_dedup(twice).collect()] == [0] * 4


def test_interval_expansion_finds_common_prefixes():
    rng = np.random.default_rng(6)
    text = np.concatenate([np.concatenate(([0], rng.integers(1, 4, 40))) for _ in range(12)] + [[0]]).astype(np.int16)
    order = suffixes.sorted_suffixes(text, 9)
    known = suffixes.split_ranks(text, order, 9)

    def shared(a, b):
        n = 0
        while n < 9 and max(a, b) + n < len(text) and text[a + n] == text[b + n] and text[a + n] > 0:
            n += 1
        return n

    for r in range(1, len(text)):
        if 0 not in text[order[r] : order[r] + 9] and 0 not in text[order[r - 1] : order[r - 1] + 9]:
            assert known[r] == (shared(order[r - 1], order[r]) < 9)


def test_decontamination_finds_substituted_passages(spark):
    rng = random.Random(5)
    item = [f"item{i}" for i in range(40)]
    changed = list(item)
    for p in (6, 15, 27):
        changed[p] = "other"
    benchmark = spark.createDataFrame(
        [(1, " ".join(item), 0), (2, "one two three four five six seven", 0), (3, "too short", 0), (4, None, 0), (5, "", 0), (None, " ".join(item), 0)],
        "item_id long, text string, doc_id long",
    )
    filler = lambda: prose(rng, 50)
    texts = [
        filler() + " " + " ".join(item).upper().replace(" ", ", ") + " " + filler(), filler() + " " + " ".join(changed) + ". " + filler(), filler(),
        " ".join(item[:9]) + " " + filler(), " ".join(item[10:25]) + " " + filler(), filler() + " One two three; four five six seven. " + filler(),
        "too short", None, "", " ".join(x for w in item for x in (w, "gap")),
    ]
    got = {(r.doc_id, r.item_id): (r.doc_start, r.item_start, r.n_words, r.n_agree) for r in decontam.overlaps(docs_of(spark, texts), benchmark).collect()}
    assert got == {(0, 1): (50, 0, 40, 40), (1, 1): (50, 0, 40, 37), (4, 1): (0, 10, 15, 15), (5, 2): (50, 0, 7, 7)}
    blocks = decontam.overlaps(docs_of(spark, texts), benchmark, block_seeds=10)
    assert {(r.doc_id, r.item_id) for r in blocks.collect()} == set(got)
    assert [r.doc_id for r in decontam.decontaminate(docs_of(spark, texts), benchmark).orderBy("doc_id").collect()] == [2, 3, 6, 7, 8, 9]
    assert decontam.overlaps(docs_of(spark, texts), benchmark.limit(0)).count() == 0
    assert decontam.decontaminate(empty(spark), benchmark).count() == 0


def test_thickness_of_an_opening_is_a_feature_of_its_rate():
    """One word in 64, in 160 or in 400 with an opening sets as many features, whatever the text's length."""
    bad = lambda n, of: toxicity.text_features(" ".join(["zzzzzx"] * n + [f"w{i}" for i in range(of - n)]).encode(), {})
    ids = [toxicity.xxhash.xxh64_intdigest(f"{i}~zzzzz") % toxicity.FEATURES for i in range(3)]
    held = lambda f: [i in set(f.tolist()) for i in ids]
    assert held(bad(1, 64)) == [True, True, True] and held(bad(1, 65)) == [False, True, True]
    assert held(bad(1, 400)) == [False, False, True] and held(bad(1, 401)) == [False] * 3
    assert held(bad(2, 320)) == [False, True, True] and len(toxicity.text_features(b"", {})) == 0


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(1200):
        bad = rng.random() < 0.2
        words = prose(rng, 40, 3000).split()
        if bad:
            words[rng.randrange(40)] = rng.choice(["vile", "rotten"]) + rng.choice(["", "er", "ly"])
        rows.append(" ".join(words))
        if i % 2 == 0:
            labels.append((i, int(bad), "t"))
    docs = docs_of(spark, rows + [None, ""])
    told = spark.createDataFrame(labels + [(None, 1, "t"), (1, None, "t"), (9999, 1, "t")], "doc_id long, toxic int, text string")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, told)).collect()}
    assert len(got) == 1202 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [(got[i].predicted, bad) for i, bad, _ in labels if got[i].held_out]
    assert sum(p == b for p, b in held) >= 0.93 * len(held) and sum(p and b for p, b in held) >= 0.8 * sum(b for _, b in held)
    assert got[1200].score == got[1201].score < 0.5
    none = toxicity.fit(docs, told.limit(0))
    assert all(r.predicted == 0 for r in toxicity.score(docs, none).collect()) and toxicity.score(empty(spark), none).count() == 0


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(4)
    lengths, k = np.array([3, 1, 4]), 3
    emit, steps, start = rng.normal(size=(8, k)), rng.normal(size=(k, k)), rng.normal(size=k)
    post, pairs = langid.forward_backward(emit, lengths, steps, start)
    want, met, lo = np.zeros((8, k)), np.zeros((k, k)), 0
    for n in lengths:
        total, mine, links = 0.0, np.zeros((n, k)), np.zeros((k, k))
        for path in itertools.product(range(k), repeat=int(n)):
            w = np.exp(start[path[0]] + sum(emit[lo + t, y] for t, y in enumerate(path)) + sum(steps[a, b] for a, b in zip(path, path[1:])))
            total += w
            for t, y in enumerate(path):
                mine[t, y] += w
            for a, b in zip(path, path[1:]):
                links[a, b] += w
        want[lo : lo + n], met, lo = mine / total, met + links / total, lo + n
    assert np.allclose(post, want) and np.allclose(pairs, met)


def test_language_of_words_and_documents(spark):
    rng = random.Random(2)
    stems = {"xx": ["pako", "tilu", "mera", "sodi"], "yy": ["grund", "strack", "pflem", "zwisch"], "zz": ["ção", "ñara", "ülle", "éton"]}
    speak = lambda lang, n: " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(i, speak(lang, rng.randrange(5, 60)), lang) for i, lang in enumerate(sorted(stems) * 60)]
    rows += [(500, None, "xx"), (501, "", "xx"), (502, "12 34 -- !!", None), (503, speak("xx", 30) + " " + speak("yy", 12), None), (504, "x" * 100_000, None), (505, speak("zz", 9), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    held = [(got[i].lang_pred, lang) for i, _, lang in rows[:180]]
    assert sum(p == t for p, t in held) >= 0.97 * len(held)
    assert [got[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3 and got[503].lang_pred == "xx" and 0.5 < got[503].score < 0.85
    assert got[504].lang_pred in stems and got[505].lang_pred == "zz"
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and {500, 501, 502}.isdisjoint(r.doc_id for r in kept.collect()) and kept.filter("doc_id = 503").count() == 1
    nothing = langid.fit(docs.filter("lang = 'none'"))
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"} and langid.identify(docs.limit(0), model).count() == 0
