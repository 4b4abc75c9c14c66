"""SimHash components, delta-maintained codebooks and phrase collocations against brute force and SQL."""

import hashlib
import math
import os
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from conftest import same_as_sql
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from cases import ODD, counted, documents, no_docs, odd_docs, with_clashes  # noqa: E402

from tessera.llm import op11_simhash, op12_delta_lloyd, op13_collocations, registry  # noqa: E402

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


# 11: SimHash


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_rows(pairs, radius=3):
    prints = [simhash(t) for _, t in pairs]
    distinct = sorted(set(prints))
    parent = {p: p for p in distinct}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    all_prints = np.array(distinct, np.uint64)
    for p in distinct:
        for q in all_prints[np.bitwise_count(all_prints ^ np.uint64(p)) <= radius].tolist():
            parent[root(p)] = root(q)
    ids = defaultdict(list)
    for (doc_id, _), p in zip(pairs, prints, strict=True):
        ids[root(p)] += [] if doc_id is None else [doc_id]
    return counted((doc_id, f"{p:016x}", min(ids[root(p)], default=None)) for (doc_id, _), p in zip(pairs, prints, strict=True))


def hex_rows(df):
    return counted(df.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id").collect())


def test_simhash_of_all_documents(spark, sf):
    want = simhash_rows([(r["doc_id"], r["text"]) for r in documents(spark, sf).collect()])
    assert counted(registry.queries()["op11_simhash_components"](spark, sf).collect()) == want


def test_simhash_of_odd_rows(spark):
    assert hex_rows(op11_simhash.simhash_components(odd_docs(spark))) == simhash_rows(ODD)
    assert op11_simhash.simhash_components(no_docs(spark)).count() == 0
    assert hex_rows(op11_simhash.simhash_components(odd_docs(spark, [(None, "a"), (None, "a")]))) == simhash_rows([(None, "a"), (None, "a")])


def near_prints(seed, groups=40, size=30):
    """Fingerprints in chains and clusters of a few bits, and far from all others."""
    r = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        p = int(r.integers(0, 1 << 63)) * 2 + g % 2
        for _ in range(size):
            for bit in r.choice(64, r.integers(0, 4), replace=False):
                p ^= 1 << int(bit)
            out.append(p)
    return np.unique(np.array(out + [0, 1, (1 << 64) - 1, (1 << 64) - 8, (1 << 64) - 16], np.uint64))


def joined(prints, links):
    parent = {int(p): int(p) for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in links:
        parent[root(a)] = root(b)
    found = defaultdict(set)
    for p in parent:
        found[root(p)].add(p)
    return sorted(map(sorted, found.values()))


def pairs_within(prints, radius=3):
    return [(int(p), int(q)) for p in prints for q in prints[np.bitwise_count(prints ^ p) <= radius]]


def test_tiles_skip_pairs_and_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(op11_simhash, "TILE", 16)
    monkeypatch.setattr(op11_simhash, "STRIP", 8)
    prints = near_prints(1)
    df = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fp long")
    packed = op11_simhash.tiles(df)
    n = packed.count()
    assert op11_simhash.tile_pairs(packed, 3).count() < 0.7 * n * (n + 1) / 2
    links = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in op11_simhash.links(packed).collect()]
    assert all(bin(a ^ b).count("1") <= 3 for a, b in links)
    assert joined(prints, links) == joined(prints, pairs_within(prints))


def test_strips_skip_pairs_and_links_are_few(monkeypatch):
    monkeypatch.setattr(op11_simhash, "STRIP", 8)
    prints, met = near_prints(2), []
    prints = prints[np.lexsort([np.bitwise_count(prints >> np.uint64(16 * i) & np.uint64(0xFFFF)) for i in range(4)])]
    links = op11_simhash.tile_links(prints, prints, True, met=met)
    assert sum(met) < 0.4 * len(prints) ** 2
    assert joined(prints, links) == joined(prints, pairs_within(prints)) and len(links) < len(prints)
    half = len(prints) // 2
    between = op11_simhash.tile_links(prints[:half], prints[half:], False)
    within = [x for part in (prints[:half], prints[half:]) for x in op11_simhash.tile_links(part, part, True)]
    assert joined(prints, between + within) == joined(prints, pairs_within(prints))


def test_a_bit_needs_more_than_half():
    for text in ("", " \t\n", "one", "one two", "A b C d", "x y z x y z x y z", "É é ÀB \x0b tab\ttab", "w " * 70000):
        assert op11_simhash.fingerprint(text) == simhash(text)


# 12: codes


def brute_codes(rows, parts=16, entries=64, rounds=2):
    """vec_id, code, error, label_error, digest by plain integers; rows of one width."""
    good = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for *_, v in good), default=1) // parts) * parts
    good = [(i, label, v + [0] * (width - len(v))) for i, label, v in good]
    size = width // parts
    cut = lambda v, p: v[p * size : (p + 1) * size]
    first = sorted(good, key=lambda x: (x[0] is None, x[0] or 0, x[2]))[:entries]
    book = [[cut(v, p) for *_, v in first] for p in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min(range(len(book[p])), key=lambda e: (away(cut(v, p), book[p][e]), e)) for p in range(parts)] for *_, v in good]
    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for e in range(len(book[p])):
                own = [cut(v, p) for (*_, v), c in zip(good, codes, strict=True) if c[p] == e]
                if own:
                    book[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    codes = assign()
    errors = [sum(away(cut(v, p), book[p][c[p]]) for p in range(parts)) for (*_, v), c in zip(good, codes, strict=True)]
    by_label = Counter()
    for (_, label, _), e in zip(good, errors, strict=True):
        by_label[label] += e
    told = hashlib.sha256(",".join(str(x) for b in book for e in b for x in e).encode()).hexdigest()
    return counted((i, bytes(c).hex(), e, by_label[label], told) for (i, label, _), c, e in zip(good, codes, errors, strict=True))


def test_codes_same_as_sql(spark, sf, duck):
    same_as_sql(registry.queries()["op12_delta_lloyd"](spark, sf), duck, registry.oracle_sql()["op12_delta_lloyd"])


def test_codes_of_odd_vectors(spark):
    r = np.random.default_rng(1)
    nan, inf = math.nan, math.inf
    rows = [(i, i % 3, r.normal(0, 1, 32).tolist()) for i in range(150)] + [(i, None, r.normal(0, 1, 32).tolist()) for i in range(150, 160)]
    rows += [(5, 1, rows[7][2]), (5, 1, rows[7][2]), (None, 2, rows[9][2]), (200, 1, None), (201, 1, [nan] * 32), (202, 1, [1.0, inf] * 16), (203, 1, [None] * 32), (204, None, [0.5, -0.001]), (205, 0, []), (206, 0, [3e5, -4e5] * 16), (207, 2, [0.0] * 32)]
    df = with_clashes(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3))
    assert counted(op12_delta_lloyd.vector_codes(df).collect()) == brute_codes(rows)
    few = [x for x in rows if x[0] in (3, 4)]
    assert counted(op12_delta_lloyd.vector_codes(df.where("vec_id in (3, 4)")).collect()) == brute_codes(few)
    assert op12_delta_lloyd.vector_codes(df.limit(0)).count() == 0
    beyond = spark.createDataFrame([(1, 0, [1e300, -1e300]), (2, 0, [0.0, 1.0])], "vec_id long, label int, embedding array<double>")
    assert op12_delta_lloyd.vector_codes(beyond).count() == 2


def test_sums_are_kept_by_changes_alone(spark, monkeypatch):
    """The running sums equal fresh ones, and a round reads only the rows that changed."""
    r = np.random.default_rng(3)
    centres = r.normal(0, 1, (8, 32))
    rows = [(i, 0, (centres[i % 8] + r.normal(0, 0.02, 32)).tolist()) for i in range(800)]
    seen, keep = [], op12_delta_lloyd.changes
    monkeypatch.setattr(op12_delta_lloyd, "changes", lambda state, shape: seen.append((state.where("was is null or was != codes").count(), keep(state, shape).count())) or keep(state, shape))
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(4)
    assert counted(op12_delta_lloyd.vector_codes(df, entries=8, rounds=4).collect()) == brute_codes(rows, entries=8, rounds=4)
    assert seen[0][0] == 800 and seen[-1][0] < 400 and seen[-1][1] < seen[0][1], seen


# 13: collocations


def brute_collocations(rows, least, longest=5, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    found = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    longer = Counter()
    for (lang, w), a in found.items():
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                if j - i < len(w):
                    longer[lang, w[i:j]] = max(longer[lang, w[i:j]], a)
    by_lang = defaultdict(list)
    for (lang, w), a in found.items():
        if 100 * longer[lang, w] < 100 * a:
            score, _, left, right = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            by_lang[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return counted((lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, found in by_lang.items() for i, (s, a, p, x, y) in enumerate(sorted(found)[:top]))


def test_collocations_same_as_sql(spark, sf, duck):
    same_as_sql(registry.queries()["op13_collocations"](spark, sf), duck, registry.oracle_sql()["op13_collocations"])


@pytest.mark.parametrize("bits", [26, 12])  # the small map lets most phrases through
def test_collocations_of_odd_texts(spark, monkeypatch, bits):
    monkeypatch.setattr(op13_collocations, "BITS", bits)
    r = np.random.default_rng(5)
    words = ["New", "york", "city", "Été", "東京", "a", "of", "the", "x y"]
    texts = ["".join(r.choice(words) + str(r.choice([" ", "  ", "\t", " ", ". ", ",", "\n"])) for _ in range(60)) + "new york city hall" for _ in range(80)]
    rows = [(r.choice(["en", "fr", None]), t) for t in texts] + [("en", None), ("fr", ""), (None, " .\t!"), ("", "new york city hall " * 30), ("de", "one " * 5000)] + [("en", texts[0])] * 3
    rows = [(None if lang is None else str(lang), t) for lang, t in rows]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "doc_id long, lang string, text string").repartition(3)
    df = df.withColumns({c: F.lit(7) for c in ("phrase", "f", "k", "a", "l", "n", "word", "bits", "cut", "score", "rank")})
    for least, top in ((20, 2000), (5, 7)):
        assert counted(op13_collocations.collocations(df, least, top=top).collect()) == brute_collocations(rows, least, top=top)
    assert op13_collocations.collocations(df.limit(0)).count() == 0


def test_passes_emit_only_what_may_be_frequent():
    bits = np.zeros(1 << op13_collocations.BITS - 6, np.uint64)
    words = op13_collocations.Words([b"a b c. a b", b"b c"])
    assert sorted(zip(*(w.to_pylist() for w in words.phrases(1, "en", None)[0]), strict=True)) == [(b"a",), (b"b",), (b"c",)]
    for w in (b"a", b"b"):
        h = op13_collocations.phrase_hashes([op13_collocations.word_hashes(op13_collocations.pa.array([w]))], "en") >> np.uint64(64 - op13_collocations.BITS)
        bits[int(h[0]) >> 6] |= np.uint64(1) << (h[0] & np.uint64(63))
    found, n = words.phrases(2, "en", bits)
    assert [w.to_pylist() for w in found] == [[b"a"], [b"b"]] and n.tolist() == [2]


def test_counts_pass_64_bits(spark):
    """1000 a n of 10**9 times 10**9 words, by the score's own expression."""
    row = spark.sql("select div(cast(1000 as decimal(38,0)) * cast(4000000000000 as decimal(38,0)) * cast(90000000000000 as decimal(38,0)), cast(5000000000000 as decimal(38,0)) * cast(7000000000000 as decimal(38,0))) as x").first()
    assert row["x"] == 1000 * 4000000000000 * 90000000000000 // (5000000000000 * 7000000000000)


def test_long_texts_are_cut_at_pieces(monkeypatch):
    monkeypatch.setattr(op13_collocations, "PIECE_BYTES", 10)
    parts = op13_collocations.cut(b"one two three four, five six. seven eight nine ten eleven")
    assert b"".join(parts) == b"one two three four, five six. seven eight nine ten eleven" and len(parts) == 3
    assert all(p[:1] in b",." for p in parts[1:])
