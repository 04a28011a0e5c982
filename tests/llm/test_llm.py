"""The text operators against brute force, and their edge cases."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quantloom.llm import brown, common, decontam, graph, langid, licences, lzprint, mixing, queries, recompression, simhash, suffixes, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty and blank texts, copies, a repeated row, repeated ids, ties, clashing extra columns.
_LONG = " ".join(f"w{i % 97}{i % 89}" for i in range(3000))
_PASSAGE = " ".join(f"passage{i}" for i in range(60))
ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two"), (6, "A b c \u0085d"), (7, _LONG), (8, _LONG), (8, _LONG), (9, _LONG + " end"),
    (None, "no id " + _PASSAGE), (None, None), (10, "x " + _PASSAGE + " y"), (11, "z " + _PASSAGE.upper() + " " + _PASSAGE), (12, "aaa " * 60), (13, "aaa " * 60 + "b"), (14, "ab" * 700), (15, "ab" * 700 + "c"), (15, "other text of the same id"), (16, "éß\U0001f600 " * 300), (17, "éß\U0001f600 " * 299 + "tail"),
]
EXTRA = ", n_words long, grp int, kind int, kept_text string, component long, row_key long"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, 3, "k", 4, 5) for i, t in ODD], DOCS + EXTRA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def words(t):
    return (t or "").encode().split()


def fingerprint(t, n=3):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(ids, fps, near):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if near(fps[i], fps[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            r = root(i)
            least[r] = min(least.get(r, d), d)
    return [least.get(root(i)) for i in range(len(ids))]


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_simhash(request, which):
    df = request.getfixturevalue(which)
    rows = simhash.near_duplicates(df).select("doc_id", "fp", "component_id").collect()
    data = [(r.doc_id, r.text) for r in df.collect()]
    fps = [fingerprint(t) for _, t in data]
    want = components([i for i, _ in data], fps, lambda a, b: (a ^ b).bit_count() <= 2)
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((r.doc_id, r.fp[0] & (1 << 64) - 1, r.component_id) for r in rows), key=key) == sorted(((i, f, c) for (i, _), f, c in zip(data, fps, want, strict=True)), key=key)


def test_simhash_large_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 4)
    base = 0x0123456789ABCDEF
    rng = np.random.default_rng(0)
    fps = sorted({base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in range(60)})
    nodes = spark.createDataFrame([(i, [common.signed(f)], []) for i, f in enumerate(fps)], "id long, fp array<long>, keys array<long>")
    found = dict(graph.connected_components(simhash.links(simhash.with_tables(nodes, 1), 2, 1, "segments")).collect())
    want = components(list(range(len(fps))), fps, lambda a, b: (a ^ b).bit_count() <= 2)
    assert [found.get(i, i) for i in range(len(fps))] == want


def test_simhash_stage_groups_near_copies(spark):
    rng = np.random.default_rng(3)
    rows, origin = [], {}
    for g in range(25):
        w = [f"t{rng.integers(5000)}" for _ in range(200)]
        for c in range(3):
            v = list(w)
            if c:
                v[int(rng.integers(200))] = "edited"
            origin[len(rows)] = g
            rows.append((len(rows), " ".join(v), "en", "s", 0))
    kept = simhash.keep_one(spark.createDataFrame(rows, DOCS), shingle_words=5, lanes=4, max_bits=51, blocking="shingles", n_keys=8)
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert sorted(r.doc_id for r in kept.collect()) == [3 * g for g in range(25)]


def test_keep_one_of_odd_rows(odd):
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_one(odd).collect()), key=str)
    assert len([x for x in kept if x[0] in (7, 8)]) == 1 and (1, None) in kept and (2, "") not in kept


def test_components_of_long_paths(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    assert {r.node: r.component for r in graph.connected_components(edges).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_older_rounds_of_components_are_deleted(spark):
    import pathlib

    where = pathlib.Path(common.checkpoint_dir(spark).removeprefix("file:"))
    folders = lambda: {p for p in where.glob("**/rdd-*")}
    before = folders()
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r.component for r in graph.connected_components(edges).collect()} == {0}
    assert len(folders() - before) == 1


def removed_words(rows, window=13):
    first = {}
    for i, t in rows:
        if i is not None:
            w = words(t)
            for j in range(len(w) - window + 1):
                k = tuple(w[j : j + window])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        stays = [True] * len(w)
        if i is not None:
            for j in range(len(w) - window + 1):
                if first[tuple(w[j : j + window])] < i:
                    stays[j : j + window] = [False] * window
        out.append((i, len(w), stays.count(False), b" ".join(x for x, s in zip(w, stays, strict=True) if s).decode()))
    return out


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_recompression(request, which):
    df = request.getfixturevalue(which)
    got = recompression.dedup(df).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert sorted(map(tuple, got), key=str) == sorted(removed_words([(r.doc_id, r.text) for r in df.collect()]), key=str)


def test_equal_windows_pick_alike():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 3, 4000).astype(np.uint64)  # few kinds of words: many runs and ties
    pick, name = recompression.picked(x, 13)
    seen = {}
    for s in range(len(pick)):
        assert s + 2 <= pick[s] <= s + 7
        assert seen.setdefault(x[s : s + 13].tobytes(), (pick[s] - s, name[pick[s]])) == (pick[s] - s, name[pick[s]])


def removed_bytes(texts, length=400):
    count = collections.Counter()
    for t in texts:
        for j in range(len(t) - length + 1):
            count[t[j : j + length]] += 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for j in range(len(t) - length + 1):
            if count[t[j : j + length]] > 1:
                gone[j : j + length] = b"\1" * length
        out.append((len(t), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), bytes(a for a, g in zip(t, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_suffixes(request, which):
    df = request.getfixturevalue(which)
    data = [(r.doc_id, (r.text or "").encode()) for r in df.collect()]
    want = [(i, n, g, s, hashlib.sha256(k).hexdigest()) for (i, _), (n, g, s, k) in zip(data, removed_bytes([t for _, t in data]), strict=True)]
    got = suffixes.dedup(df).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)), "n_removed", F.size("spans"), F.sha2("kept_bytes", 256)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_window_groups_by_suffix_sorting():
    rng = np.random.default_rng(2)
    text = bytes(rng.integers(0, 3, 300, dtype=np.uint8))
    pieces = [text[:120], text[60:200], text[10:90] + b"\x00\x00\x05", b"\x00" * 70, text[:25]]
    got = suffixes.repeated_starts(pieces, 30)
    count = collections.Counter(p[i : i + 30] for p in pieces for i in range(len(p) - 29))
    names = {}
    for p, g in zip(pieces, got, strict=True):
        for i in range(len(p) - 29):
            w = p[i : i + 30]
            assert (g[i] >= 0) == (count[w] > 1)
            if g[i] >= 0:
                assert names.setdefault(w, g[i]) == g[i]
    assert len(set(names.values())) == len(names)


@pytest.mark.parametrize("most", [0, 500, 1 << 18])
def test_large_sets_of_pieces_are_cut_without_loss(monkeypatch, most):
    monkeypatch.setattr(suffixes, "SORT_BYTES", most)
    rng = np.random.default_rng(3)
    length, half = 40, 20
    anchor = bytes(rng.integers(0, 2, half, dtype=np.uint8))
    pieces, at = [], []
    for _ in range(60):
        left, right = int(rng.integers(0, half + 1)), int(rng.integers(half, length + 1))
        if left + right >= length:
            pieces.append(bytes(rng.integers(0, 2, left, dtype=np.uint8) * (rng.random(left) < 0.1)) + anchor + bytes(rng.integers(0, 2, right - half, dtype=np.uint8) * (rng.random(right - half) < 0.1)))
            at.append(left)
    want = collections.defaultdict(set)
    for i, (p, a) in enumerate(zip(pieces, at, strict=True)):
        for s in range(len(p) - length + 1):
            want[a - s, p[s : s + length]].add((i, s))
    want = {x for v in want.values() if len(v) > 1 for x in v}
    got = set()
    for own, cuts in suffixes.sets_to_sort(list(range(len(pieces))), pieces, at, 0, half + 1, length):
        groups = suffixes.repeated_starts([pieces[i][a:b] for i, (a, b) in zip(own, cuts, strict=True)], length)
        got |= {(i, a + int(s)) for i, (a, _), g in zip(own, cuts, groups, strict=True) for s in np.flatnonzero(g >= 0)}
    assert len(want) > 50 and want <= got


def test_symbols_of_equal_words_agree():
    rng = np.random.default_rng(4)
    part = rng.integers(0, 1 << 60, 400).astype(np.uint64)
    texts = [np.concatenate([rng.integers(0, 1 << 60, n).astype(np.uint64), part, rng.integers(0, 1 << 60, n).astype(np.uint64)]) for n in (0, 7, 90)]
    inside = []
    for k, t in enumerate(texts):
        first, size = recompression.symbols(t, np.zeros(len(t), np.int64), 24)
        n = (0, 7, 90)[k]
        inside.append({(f - n, s) for f, s in zip(first.tolist(), size.tolist(), strict=True) if f >= n and f + s <= n + 400})
    shared = inside[0] & inside[1] & inside[2]
    covered = np.zeros(400, bool)
    for f, s in shared:
        covered[f : f + s] = True
    assert max(s for _, s in shared) >= 96 and covered.sum() > 250


def lz_signature(text):
    """Plain LZ78 over a set of strings; then per bin of the top seven bits the least scrambled phrase hash."""
    known, phrase, found = set(), "", []
    for c in text:
        phrase += c
        if phrase not in known:
            known.add(phrase)
            found.append(phrase)
            phrase = ""
    least, mask = {}, (1 << 64) - 1
    for p in found:
        h = 1
        for c in p:
            h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) & mask
        h = ((h ^ (h >> 32)) * 0x9E3779B97F4A7C15) & mask
        h = ((h ^ (h >> 29)) * 0xD6E8FEB86659FD93) & mask
        h ^= h >> 32
        least[h >> 57] = min(least.get(h >> 57, mask), h)
    return [least[b] % 65535 + 1 if b in least else 0 for b in range(128)]


def lz_likeness(a, b):
    used = [(x, y) for x, y in zip(a, b, strict=True) if x or y]
    return sum(x == y for x, y in used) / len(used) if used else 1.0


@pytest.mark.parametrize("buckets", [1, 7])
@pytest.mark.parametrize("which", ["odd", "docs"])
def test_lz_fingerprints(request, monkeypatch, which, buckets):
    monkeypatch.setattr(lzprint, "groups_for", lambda n: buckets)
    df = request.getfixturevalue(which)
    rows = df.selectExpr("doc_id", "coalesce(text, '') AS text", "xxhash64(doc_id, coalesce(text, '')) AS k").collect()
    rows.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.k), reverse=True)
    want, sigs = [], {t: lz_signature(t) for t in {r.text for r in rows}}
    for r, after in zip(rows, rows[1:] + rows[:1], strict=True):
        k = len(r.text) // 3
        edited = r.text[: len(r.text) - k] + after.text[:k]
        own, other = sigs[r.text], lz_signature(edited)
        want.append((r.doc_id, len(r.text), edited, *("".join(f"{x:04x}" for x in s) for s in (own, other)), lz_likeness(own, other), lz_likeness(own, sigs[after.text])))
    got = [tuple(r) for r in lzprint.with_neighbours(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    if which == "docs":
        assert np.mean([r[5] for r in got]) > 2 * np.mean([r[6] for r in got])


def test_lz_single_and_fork(spark):
    one = lzprint.with_neighbours(spark.createDataFrame([(1, "abcabcabc")], "doc_id long, text string")).first()
    assert one.edited_text == "abcabcabc" and one.near_edited == 1 and one.near_next == 1
    t = "the cat sat on the mat " * 5
    assert (lzprint.Parse(t, 70).fork("else") == lzprint.Parse(t[:70] + "else").signature()).all()


def test_langid_held_out(docs):
    m = langid.fit(docs)
    rows = langid.predict(docs, m).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"  # smaller tables hold too few labels to learn from
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    m = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, m).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit / sum(r.toxic for r in rows) > 0.85 and hit / max(sum(r.predicted for r in rows), 1) > 0.9
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)


def test_toxicity_features_of_short_texts():
    lexicon = toxicity.Lexicon({b"idiot": 2.0, b"\x01idio": 0.5})
    texts = ["you idiot"] + [" ".join(["you", *["x"] * n, "idiot"]) for n in range(6)] + ["idiot", "you", "", "  ", None, "YOU idi0t, no!!!"]
    rows = dict(zip(texts, (dict(zip(toxicity.FEATURES, r, strict=True)) for r in lexicon.features(pa.array(texts)).tolist()), strict=True))
    for n in range(6):  # a hit counts as near if a second-person word is at most three words away
        assert rows[" ".join(["you", *["x"] * n, "idiot"])]["near_second_person"] == ((n < 3) / (n + 2))
    assert rows["you idiot"]["lexicon_density"] == rows["you idiot"]["second_person"] == 0.5
    assert not any(rows[None].values()) and not any(rows[""].values()) and not any(rows["  "].values())
    loud = rows["YOU idi0t, no!!!"]
    assert loud["hidden_density"] == loud["all_caps"] == loud["obfuscated"] == 1 / 3 and loud["exclamations"] == 1


def test_isotonic_rises():
    x, y = toxicity.isotonic(np.array([3.0, 1.0, 2.0, 2.0, 5.0]), np.array([1.0, 0.0, 1.0, 0.0, 1.0]))
    assert (np.diff(x) > 0).all() and (np.diff(y) >= -1e-12).all() and y.min() > 0 and y.max() < 1


def test_brown_counts_and_gain(docs, monkeypatch):
    model, vocab, buckets = brown.fit(docs, head=500)  # most words are looked up by the exchange
    rows = {r.doc_id: r for r in brown.score(docs, model, vocab, buckets).collect()}
    tokens = {r.doc_id: [*r.text.encode().lower().split(), b" "] for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    c = collections.Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in tokens.items():
        r = rows[i]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and math.isfinite(r.score)
    assert sum(r.score for r in rows.values()) > sum(r.base_score for r in rows.values())
    total = model.step.sum(axis=1)  # over classes, per token of the class: never more than lam
    assert (model.step >= 0).all() and total.shape == (48,)


def test_brown_scores_by_plain_sums(docs):
    """Own classes of head words, and scores, token by token in plain Python."""
    model, vocab, buckets = brown.fit(docs, words=200, endings=100, head=2000)
    got = {r.doc_id: r for r in brown.score(docs, model, vocab, buckets).collect()}
    tokens = {r.doc_id: [*r.text.encode().lower().split(), b" "] for r in docs.collect()}
    train = [t for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 10]
    c = collections.Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    item = {int(h): k + 1 for k, h in enumerate(model.items.hashes)}
    own = {int(h): int(k) for h, k in zip(model.head, model.head_class, strict=True) if k >= 0}

    def by_item(w):
        ending = xxhash.xxh64_intdigest(w[-4:].rstrip(b".,;:!?\"')")[-3:]) ^ int(brown._MARK)
        return int(model.klass[item.get(xxhash.xxh64_intdigest(w), item.get(ending, 0))])

    old = {w: by_item(w) for t in tokens.values() for w in t}
    klass = {w: own.get(xxhash.xxh64_intdigest(w), k) for w, k in old.items()}
    between, left, right = np.zeros((48, 48)), collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for t in train:
        for x, y in zip([b" ", *t], t, strict=False):
            between[old[x], old[y]] += 1
            left[y][old[x]] += 1
            right[x][old[y]] += 1
    share = between.sum(axis=0) / between.sum()
    logs = np.maximum(np.log((between + share[None, :]) / (between.sum(axis=1, keepdims=True) + 1) + 1e-300), -50)
    checked = 0
    for w in [w for w in c if xxhash.xxh64_intdigest(w) in own][:200]:
        gain = sum(m * logs[k] for k, m in left[w].items()) + sum(m * logs[:, k] for k, m in right[w].items()) - c[w] * np.log(np.maximum(between.sum(axis=0), 1))
        gain[old[b" "]] = -np.inf
        checked += gain[klass[w]] >= gain.max() - 1e-6
    assert checked == 200 and sum(klass[w] != old[w] for w in c) > 100
    emitted = np.zeros(48)
    for w, m in c.items():
        emitted[klass[w]] += m
    assert (model.step @ emitted <= 1 - model.rest + 1e-9).all()  # no class gives away more than lam
    for i, t in tokens.items():
        total = 0.0
        for x, y in zip([b" ", *t], t, strict=False):
            total += math.log10(model.step[klass[x], klass[y]] * c[y] + model.rest * (c[y] + 0.1) / (n + 0.1 * (v + 1)))
        assert got[i].score == pytest.approx(total, rel=1e-9)


def test_brown_classes_raise_the_likelihood():
    rng = np.random.default_rng(0)
    b = rng.integers(0, 5, (40, 40)) + 60.0 * ((np.arange(40)[:, None] + np.arange(40)[None, :]) % 2)
    def gain(k):
        one = np.zeros((40, 4))
        one[np.arange(40), k] = 1
        n = one.T @ b @ one
        return brown._plogp(n).sum() - brown._plogp(n.sum(0)).sum() - brown._plogp(n.sum(1)).sum()
    start = np.zeros(40, np.int64)
    start[np.argsort(-b.sum(axis=0), kind="stable")] = 1 + np.arange(40) % 3
    start[0] = 0
    assert gain(brown.exchange(b, 4, 0)) > gain(start)


def test_licences():
    s = licences.Scanner()
    text = licences.SENTENCES["mit-grant"].replace(" to deal", "\nto deal") + "\n\n" + licences.SENTENCES["mit-notice"] + "\n\n" + licences.SENTENCES["as-is"]
    assert [x[:2] for x in s.licences(text.encode())] == [("MIT", 3)]
    bsd2 = " ".join(licences.SENTENCES[k] for k in ("bsd-grant", "bsd-source", "bsd-binary"))
    assert [x[0] for x in s.licences(bsd2.encode())] == ["BSD-2-Clause"]
    assert [x[0] for x in s.licences((bsd2 + " " + licences.SENTENCES["bsd-endorse"]).encode())] == ["BSD-3-Clause"]
    shuffled = " ".join(licences.SENTENCES[k] for k in ("bsd-source", "bsd-grant", "bsd-binary"))
    assert s.licences(shuffled.encode()) == [] and s.licences(b"") == []
    assert [x[0] for x in s.licences(b"Foo bar.\nThis work is licensed under the GNU General Public License, version 3. Baz.")] == ["GPL-3.0"]


@pytest.mark.parametrize(
    ("text", "licence", "n"),
    [
        (" ".join(licences.SENTENCES[k] for k in ("mit-grant", "mit-notice", "as-is", "mit-no-event")), "MIT", 4),
        (" ".join(licences.SENTENCES[k] for k in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-no-event")), "BSD-2-Clause", 5),
        (" ".join(licences.SENTENCES[k] for k in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is", "bsd-no-event")), "BSD-3-Clause", 6),
        ("This program is free software; you can redistribute it and/or\nmodify it under the terms of the GNU General Public License as published by the\nFree Software Foundation; either version 2 of the License, or (at your option) any later version.", "GPL-2.0-or-later", 1),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. " + licences.SENTENCES["gpl-warranty"], "AGPL-3.0-or-later", 2),
        ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; version 2.1.", "LGPL-2.1-only", 1),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0", 1),
        ("Licensed under CC BY-NC-ND 4.0.", "CC-BY-NC-ND-4.0", 1),
        ("This project is licensed under the ISC License.", "ISC", 1),
        (licences.SENTENCES["zlib-as-is"] + " " + licences.SENTENCES["zlib-no-event"] + "\n\n" + licences.SENTENCES["zlib-grant"], "Zlib", 3),
    ],
)
def test_licence_texts(text, licence, n):
    assert [x[:2] for x in licences.Scanner().licences(f"Some words.\n\n{text}\n\nMore of them.".encode())] == [(licence, n)]


def test_licence_query_against_patterns(spark, sf, docs):
    got = {(r.doc_id, r.licence) for r in queries.QUERIES["op10_licences"](spark, sf).collect()}
    pats = {"MIT": "Released under the MIT License\\.", "Apache-2.0": "Licensed under the Apache License, Version 2\\.0\\.", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3\\.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4\\.0\\."}
    assert got == {(r.doc_id, k) for r in docs.collect() for k, p in pats.items() if re.search(p, r.text)}


def test_decontamination_finds_reparameterised_questions(spark):
    item = "Yesterday the farmer John Smith carried 25 kg of apples to market and sold 12 apples to John Smith near the river for 3 dollars each"
    bench = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    swap = item.replace("John Smith", "Mary Jones").replace("25 kg", "40 lb").replace("12", "7")
    torn = item.replace("John Smith", "Mary Jones", 1)
    rows = [(1, f"Intro words here. {item} Outro."), (2, f"Intro words here. {swap} Outro."), (3, f"Intro words here. {torn} Outro."), (4, "nothing to see"), (5, None), (6, ""), (6, f"{item}")]
    got = {r.doc_id: (r.n_changed > 0) for r in decontam.matches(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {1: False, 2: True, 6: False}
    kept = decontam.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted([(3, rows[2][1]), (4, rows[3][1]), (5, ""), (6, "")])


def test_decontamination_of_short_questions(spark):
    """Names begin sentences; other values must stand for other values."""
    item = "John has 12 apples and buys 7 more. Mary gives John 25 pears. How many fruits has John now?"
    swap = {"John": "Peter", "Mary": "Susan", "12": "31", "25": "64", "7": "8"}
    other = re.sub("|".join(swap), lambda m: swap[m[0]], item)
    merged = item.replace("25", "9").replace("12", "9")
    rows = [(1, item), (2, other), (3, f"Some words before, {other} And some after."), (4, merged), (5, "Peter has many apples and buys pears."), (6, item.replace("12", "\u0663\u0664"))]
    bench = spark.createDataFrame([(1, item), (2, "John Smith 25 kg"), (3, "Ann 7 Bob 8 Tom 9 Jim 10 Sue 11")], "item_id long, text string")
    got = {r.doc_id: (r.item_id, r.n_windows, r.n_changed) for r in decontam.matches(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert set(got) == {1, 2, 3, 6} and {v[0] for v in got.values()} == {1}
    assert got[1][1] == got[2][1] == got[3][1] and got[1][2] == 0 < got[2][2]


def test_decontamination_against_brute_force(spark, sf, docs):
    norm = lambda t: [w.lower() for w in re.findall(r"[^\W\d_]+", t)]
    bench = {r.item_id: norm(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = set()
    for r in docs.collect():
        joined = " " + " ".join(norm(r.text)) + " "
        want |= {(r.doc_id, i) for i, w in bench.items() if " " + " ".join(w) + " " in joined}
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op1_templates"](spark, sf).collect()}
    assert want and want <= got


def test_mixing_budgets(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 30))), "en", "big" if i % 10 else f"small{i % 3}", 0) for i in range(600)] + [(None, "a b", "en", None, 0), (700, None, "en", "empty", 0)]
    df = spark.createDataFrame(rows, DOCS)
    out = mixing.schedule(df, entropy_share=0.9).collect()
    tokens, taken = collections.Counter(), collections.Counter()
    for _, t, _, s, _ in rows:
        tokens[s or ""] += len((t or "").split())
    for r in out:
        taken[r.source] += r.n_tokens
    tokens = {k: v for k, v in tokens.items() if v}
    total = sum(tokens.values())
    share = {k: v / total for k, v in tokens.items()}

    def weights(a):
        w = {k: s**a for k, s in share.items()}
        return {k: v / sum(w.values()) for k, v in w.items()}

    def fine(a):
        w = weights(a)
        return -sum(v * math.log(v) for v in w.values()) >= 0.9 * math.log(len(w))

    repeats = lambda a: max(weights(a)[k] * total / tokens[k] for k in tokens)
    lo = max([i / 1000 for i in range(1001) if fine(i / 1000)], default=0)
    hi = min(i / 1000 for i in range(1001) if repeats(i / 1000) <= 4)
    w = weights(max(lo, hi))
    for k in tokens:
        assert taken[k] <= w[k] * total + 3 + 0.01 * total and taken[k] >= w[k] * total - 31 - 0.01 * total
    seen = collections.Counter((r.doc_id, r["pass"]) for r in out)
    assert max(seen.values()) == 1 and len({r.order_key for r in out}) == len(out)


def test_mixing_against_exponent_sections(spark):
    totals = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 100)], "source string, tokens long")
    a = mixing.exponent(totals, 1110, 0.8, 100.0)
    t = np.array([1000, 10, 100]) / 1110
    def entropy(x):
        q = t**x / (t**x).sum()
        return -(q * np.log(q)).sum() / math.log(3)
    assert entropy(a) >= 0.8 > entropy(a + 1e-5)
    b = mixing.exponent(totals, 1110, 1.0, 2.0)
    def repeats(x):
        q = t**x / (t**x).sum()
        return (q / t).max()
    assert repeats(b) <= 2 + 1e-6 < repeats(b - 1e-4) + 1e-3


def test_all_operators_take_odd_and_empty_tables(spark, odd, none):
    labels = spark.createDataFrame([(1, None, 1), (4, 1, 1), (None, 1, 1), (5, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, _PASSAGE), (None, None)], "item_id long, text string")
    n = odd.count()
    m = langid.fit(odd)
    assert langid.predict(odd, m).count() == n and {r.lang_pred for r in langid.predict(odd, m).where("doc_id in (1, 2, 3)").collect()} == {"und"}
    assert toxicity.score(odd, toxicity.fit(odd, labels)).count() == n and toxicity.keep_clean(odd, labels).columns == odd.columns
    assert brown.score(odd, *brown.fit(odd)).count() == n
    assert {r.doc_id for r in decontam.matches(odd, bench).collect()} == {None, 10, 11}
    assert mixing.schedule(odd).count() > 0 and licences.scan(odd).count() == 0
    lm = brown.fit(none)
    for out in (simhash.near_duplicates(none), recompression.dedup(none), suffixes.dedup(none), lzprint.with_neighbours(none), langid.predict(none, langid.fit(none)), toxicity.score(none, toxicity.fit(none, labels.limit(0))), brown.score(none, *lm), decontam.matches(none, bench), decontam.matches(odd, bench.limit(0)), mixing.schedule(none), licences.scan(none), simhash.keep_one(none)):
        assert out.count() == 0


def test_brown_repeated_rows(odd):
    model, vocab, buckets = brown.fit(odd, head=2)
    rows = brown.score(odd, model, vocab, buckets).where("doc_id in (7, 8)").collect()
    assert len(rows) == 3 and len({(r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in rows}) == 1


def test_pipeline_stages_by_brute_force(spark, sf):
    """What each stage keeps, of its own input."""
    import corpus_pipeline as c

    stages = dict(c.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    rows = {r.doc_id: r for r in docs.collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect() if r.score >= 0.3}
    assert {r.doc_id for r in stages["toxicity"](spark, docs, sf).collect()} == set(rows) - toxic

    def shingles(t):
        w = t.encode().lower().split()
        return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    ids, sets = sorted(rows), {i: shingles(rows[i].text or "") for i in rows}
    alike = lambda a, b: (not a and not b) or len(a & b) >= 0.8 * len(a | b) - 1e-9
    least = components(ids, [sets[i] for i in ids], alike)
    assert sorted(r.doc_id for r in stages["simhash_near_dedup"](spark, docs, sf).collect()) == [i for i, m in zip(ids, least, strict=True) if i == m]

    cut = {i: (n, gone, t) for i, n, gone, t in removed_words([(i, r.text) for i, r in rows.items()])}
    got = {r.doc_id: r for r in stages["substring_dedup"](spark, docs, sf).collect()}
    assert set(got) == {i for i, (n, gone, _) in cut.items() if not gone or gone < n}
    for i, r in got.items():
        want = cut[i][2] if cut[i][1] else rows[i].text
        assert r.text == want and r.n_chars == (len(want) if cut[i][1] else rows[i].n_chars)

    found = {r.doc_id for r in decontam.matches(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert found and {r.doc_id for r in stages["benchmark_decontamination"](spark, docs, sf).collect()} == set(rows) - found


def test_pipeline_stages_take_odd_and_empty_tables(spark, sf, odd, none):
    import corpus_pipeline as c

    for name, stage in c.STAGES:
        assert stage(spark, none, sf).count() == 0
        out = stage(spark, odd, sf)
        assert out.count() > 0 and (name == "source_mixing" or out.columns == odd.columns)


def test_pipeline_stages(spark, sf, tmp_path):
    import corpus_pipeline as c

    docs, names = spark.read.parquet(f"{sf}/documents.parquet"), None
    for k, (_, stage) in enumerate(c.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        names, before, docs = docs.columns, docs, spark.read.parquet(str(tmp_path / str(k)))
        if k < len(c.STAGES) - 1:
            assert docs.columns == names and 0 < docs.count() <= before.count()
    assert docs.count() > 0 and {"doc_id", "source", "pass", "order_key"} <= set(docs.columns)


def _alike(texts, n=5, least=0.8):
    """Component of each text by brute force on the distinct shingles."""
    own = []
    for t in texts:
        w = (t or "").encode().lower().split()
        own.append({b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    return components(list(range(len(texts))), own, lambda a, b: a == b or len(a & b) >= least * len(a | b) - 1e-9)


def _near(spark, texts):
    import corpus_pipeline as c

    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    return {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS), **c.NEAR).collect()}


def test_near_duplicate_stage_loses_no_link(spark):
    rng = np.random.default_rng(5)
    line, texts = " ".join(f"boiler{i}" for i in range(15)), []
    for g in range(12):  # lengths from 6 words on; edits around a likeness of 0.8; some under one repeated line
        w = [f"g{g}w{i}" for i in range(int(rng.integers(6, 300)))]
        for c in range(5):
            v = list(w)
            for i in rng.choice(len(v), int(rng.integers(0, 2 + len(v) // 40)), replace=False):
                v[i] = f"edit{g}c{c}i{i}"
            texts.append((f"{line} " * 200 if g % 3 == 0 else "") + " ".join(v))
    texts += [" ".join(f"family{i}" if i != k else f"own{k}" for i in range(200)) for k in range(30)]  # one large block
    got = _near(spark, texts)
    assert [got[i] for i in range(len(texts))] == _alike(texts)


def test_near_duplicate_stage_keeps_what_is_less_alike(spark):
    # 196 shingles shared and 36 to each: a likeness of 0.73
    texts = [" ".join([*(f"g{g}w{i}" for i in range(200)), *(f"g{g}c{c}w{i}" for i in range(36))]) for g in range(20) for c in range(2)]
    got = _near(spark, texts)
    assert [got[i] for i in range(len(texts))] == list(range(len(texts))) == _alike(texts)


def test_equal_fingerprints_keep_the_keys_of_all_members(spark):
    # a line so often that it alone decides the fingerprint: three texts are one node, two words apart
    line = " ".join(f"line{i}" for i in range(7)) + " "
    texts = [line * 400 + " ".join(f"own{c}w{i}" for i in range(40)) for c in range(3)]
    fps = simhash.fingerprints(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS), 5, 1, 8).collect()
    assert len({tuple(r.fp) for r in fps}) == 1 and len({tuple(r.keys) for r in fps}) == 3
    # each of the members' keys leads to a further fingerprint
    near = [common.signed((fps[0].fp[0] & (1 << 64) - 1) ^ 1 << k) for k in range(3)]
    rows = [(r.fp[0], list(r.fp), list(r.keys)) for r in fps] + [(f, [f], [max(set(r.keys) - {k for o in fps if o is not r for k in o.keys})]) for f, r in zip(near, fps, strict=True)]
    table = spark.createDataFrame(rows, "id long, fp array<long>, keys array<long>")
    nodes = table.groupBy("id").agg(F.min("fp").alias("fp"))
    found = graph.connected_components(simhash.links(simhash.with_tables(nodes, 1), 1, 1, "shingles", table)).collect()
    assert len(found) == 4 and len({r.component for r in found}) == 1


def test_decontamination_finds_short_items_inside_texts(spark):
    bench = spark.createDataFrame([(1, "how many moons orbit jupiter"), (2, "is the ocean green or blue"), (3, "we sold 12 apples today")], "item_id long, text string")
    rows = [(1, "Well then. how many moons orbit jupiter is asked by many people in this long text"), (2, "how many moons orbit jupiter"), (3, "how many moons orbit saturn, as is asked by many people here"), (4, "so is the ocean green or blue"), (5, "then we sold 40 apples today and they were all rather good ones"), (6, "how many moons"), (7, None)]
    got = {(r.doc_id, r.item_id, r.n_windows, r.n_changed) for r in decontam.matches(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(1, 1, 1, 0), (2, 1, 1, 0), (4, 2, 1, 0), (5, 3, 1, 1)}


def test_shingles_of_all_texts_are_counted(spark):
    # one half of the texts share a line; all of it, however many texts there are, is in the counters
    texts = [f"{i} own words of text {i} only" + (" the line that very many texts share" if i % 2 else "") for i in range(400)] + [None, ""]
    got = simhash.shingle_counts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5), 5)
    least = np.zeros_like(got)
    for t in texts:
        np.add.at(least, simhash.shingle_set((t or "").encode(), 5) >> simhash.COUNTER_SHIFT, 1)
    assert (got == least).all() and got.max() >= 200
    line = simhash.shingle_set(b"the line that very many texts share", 5)
    assert (simhash.hot_counts(got)[line >> simhash.COUNTER_SHIFT] >= 200).all()


def test_pairs_that_share_the_key_before_do_not_meet_again():
    keys, ids = np.arange(1, 31, dtype=np.uint64), np.array([7, 9], np.int64)
    key, at = np.repeat(keys, 2), np.repeat(np.arange(30), 2).astype(np.int32)
    id_, n = np.tile(ids, 30), np.full(60, 145, np.int32)
    before = np.stack([np.where(at >= k, key.astype(np.int64) - k + 100, 0).astype(np.uint32) for k in (1, 2)], axis=1)
    a, b, _ = simhash._meet(key, id_, n, at, id_, before, 0.8, False)
    assert [x.tolist() for x in a if len(x)] == [[7]] and [x.tolist() for x in b if len(x)] == [[9]]


def test_tokens_of_a_match_are_not_taken_for_each_slot(spark):
    text = "a train of 12 cars leaves Boston at 7 and needs 45 minutes for the way to the next large town"
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    found = decontam.matches(spark.createDataFrame([(5, f"we know that {text.replace('12', '14')} by now")], "doc_id long, text string"), bench)
    assert [(r.doc_id, r.n_changed) for r in found.collect()] == [(5, 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_pairs_alike_in_part_only_become_no_rows(spark, monkeypatch):
    # three words edited in each of 300 copies: most pairs have a likeness of 0.71, those with edits close together link
    rng, texts = np.random.default_rng(7), []
    for c in range(300):
        w = [f"w{i}" for i in range(180)]
        for i in rng.choice(180, 3, replace=False):
            w[i] = f"edit{c}i{i}"
        texts.append(" ".join(w))
    made, alike = [], simhash.alike

    def counted(docs, nodes, pairs, *how):
        made.append(pairs.where("a <> b").count())
        return alike(docs, nodes, pairs, *how)

    monkeypatch.setattr(simhash, "alike", counted)
    got, want = _near(spark, texts), _alike(texts)
    assert [got[i] for i in range(300)] == want and 20 < len(set(want)) < 300
    assert len(made) == 2 and made[1] < 10 * 300


def test_sketches_differ_in_no_more_than_the_sets():
    rng = np.random.default_rng(8)
    for n in (1, 30, 500, 5000):
        own = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for gone in (0, 1, n // 10, n):
            other = np.concatenate([own[gone:], np.unique(rng.integers(0, 1 << 63, gone // 2).astype(np.uint64))])
            both = np.stack([simhash.sketch(own), simhash.sketch(other)])
            for x, y in (both, simhash.folded(both)):
                assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(own, other))


def test_bits_of_keys_tell_all_keys(spark):
    rng = np.random.default_rng(9)
    keys = rng.integers(0, 1 << 64, 2000, dtype=np.uint64)
    bits = simhash.key_bits(spark.createDataFrame([(int(k),) for k in keys[:1000].view(np.int64)], "a long").repartition(5))
    assert simhash.has_bit(bits, keys[:1000]).all() and simhash.has_bit(bits, keys[1000:]).sum() < 5
    assert not simhash.key_bits(spark.createDataFrame([], "a long")).any()
