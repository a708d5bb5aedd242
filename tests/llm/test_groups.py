"""Line dedup, Jaccard join, suffix-array dedup and components against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from lamina.llm import line_dedup, ngram_join, suffix_array, suffix_dedup
from lamina.llm.components import components

ODD = [None, "", " \n\t", "one", "a b", "a b", "x" * 20_000, "w " * 3_000, "a\n\nb\n", "\na\nb"]
DOCS = "doc_id long, text string, n_lines string, component_id string, text2 string"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "n", "c", "t") for i, t in enumerate(texts)], DOCS)


# ---- components


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(-50, 200), rng.randrange(-50, 200)) for _ in range(130)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7), (2000, 5), (2000, 5)]
    edges += [(5000, 5000 + i) for i in range(1, 80)]
    root: dict = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    joined = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in joined}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- line dedup


def _lines(rows, run=3, words=50):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        lines = (text or "").split("\n")
        at = [k for k, x in enumerate(lines) if word.search(x)]
        dead = set()
        windows = [(k, run) for k in range(len(at) - run + 1)] + [(k, 1) for k in range(len(at)) if len(word.findall(lines[at[k]])) >= words]
        for k, n in sorted(set(windows)):
            key = (n, tuple(lines[j] for j in at[k : k + n]))
            if key in seen:
                dead.update(range(k, k + n))
            seen.add(key)
        gone = {at[k] for k in dead}
        out[i] = (len(at), len(dead), sum(k - 1 not in dead for k in dead), None if text is None else "\n".join(x for j, x in enumerate(lines) if j not in gone))
    return out


def test_line_dedup(spark):
    rng = random.Random(2)
    pool = [f"line {k}" for k in range(12)] + ["", "  ", " ".join(f"w{k}" for k in range(50)), " ".join(f"v{k}" for k in range(49))]
    texts = ODD + ["\n".join(rng.choices(pool, k=rng.randrange(9))) for _ in range(80)]
    df = documents(spark, texts)
    done = line_dedup.dedup_lines(df)
    assert done.columns == ["doc_id", "text", "component_id", "text2", "n_lines", "n_removed", "n_runs"]
    assert {r.doc_id: (r.n_lines, r.n_removed, r.n_runs, r.text) for r in done.collect()} == _lines(list(enumerate(texts)))
    for run in (1, 2, 5):
        got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df, run_lines=run).collect()}
        assert got == {i: x[3] for i, x in _lines(list(enumerate(texts)), run).items()}
    twice = df.filter("doc_id = 9").unionAll(df.filter("doc_id = 9"))
    assert sorted(r.n_removed for r in line_dedup.dedup_lines(twice, run_lines=2).collect()) == [0, 2]
    lines = "p q\nr s\nt u\nv w"
    null = spark.createDataFrame([(1, lines, "x"), (None, lines, "y"), (None, f"z\n{lines}", "z")], "doc_id long, text string, _rid string")
    assert sorted((r.doc_id or 0, r.text) for r in line_dedup.dedup_lines(null).collect()) == [(0, lines), (0, "z"), (1, "")]
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_fingerprints_are_minima(spark):
    """Only window minima are looked at, every window by one of them; without them nothing is found."""
    rng = random.Random(8)
    texts = ["\n".join(f"line {rng.randrange(10**6)}" for _ in range(400)) for _ in range(3)]
    rows = documents(spark, texts).selectExpr("doc_id as _rid", "doc_id as _id", "text as _text")
    for run in (3, 8):
        found = line_dedup.fingerprints(rows, run, 50).collect()
        assert len({(r._rid, r.at) for r in found}) == len(found) < 3 * 400 * 2.4 / (run + 1)
        windows = Counter((r._rid, r.at + w.s) for r in found for w in r.around)
        assert windows == Counter((d, i) for d in range(3) for i in range(1, 400 - run + 2))
        for r in found:
            assert all(r.fp <= min(x.fp for x in found if x._rid == r._rid and r.at + w.s <= x.at < r.at + w.s + run) for w in r.around[:1])


# ---- Jaccard join


def _sets(texts, k):
    out = []
    for t in texts:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        out.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set()))
    return out


def _groups(texts, k, least):
    sets, root = _sets(texts, k), list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and Fraction(len(a & b), len(a | b)) >= least:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {(i, len(s), find(i)) for i, s in enumerate(sets)}


def _near_copies(rng, n):
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 8, 12, 30, 80, 200]))] for _ in range(n // 8)]
    texts = []
    for _ in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            words[rng.randrange(len(words))] = f"w{rng.randrange(400)}"
        cut = rng.choice([0, 0, 1, 4])
        texts.append((" " if rng.random() < 0.7 else "\n").join(words[: len(words) - cut] if len(words) > cut else words).title())
    return texts


@pytest.mark.parametrize("k,least", [(3, Fraction(9, 10)), (5, Fraction(4, 5)), (1, Fraction(1, 2)), (2, Fraction(1))])
def test_jaccard(spark, k, least, monkeypatch):
    texts = ODD + _near_copies(random.Random(k), 160)
    df, want = documents(spark, texts), _groups(texts, k, least)
    got = lambda: {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df, k, least).collect()}
    assert got() == want
    if k == 5:
        monkeypatch.setattr(ngram_join, "TILE_CLASSES", 4)
        monkeypatch.setattr(ngram_join, "TILE_SHINGLES", 300)
        assert got() == want
    monkeypatch.setattr(ngram_join, "PAIRED", 1)  # every group counts as large
    assert got() == want


def test_segments_meet():
    rng, bands = np.random.default_rng(3), ngram_join.Bands(Fraction(9, 10))
    for _ in range(300):
        n = int(rng.integers(10, 700))
        a = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
        apart = int(rng.integers(0, n // 10 + 2))
        b = np.unique(np.concatenate((a[apart:], rng.integers(0, 2**63, int(rng.integers(0, 3)), dtype=np.uint64))))
        a = np.unique(a)
        if ngram_join.linked(a, b, Fraction(9, 10)) and not np.array_equal(a, b):
            (x, x_need), (y, y_need) = bands.keys(a), bands.keys(b)
            common = np.intersect1d(x, y)
            odd = (common >> np.uint64(16)) & np.uint64(1)
            tile = max(int(bands.of(len(a))), int(bands.of(len(b)))) & 1
            assert (odd == tile).sum() >= max((x_need >> 16 * tile) & 0x7FFF, (y_need >> 16 * tile) & 0x7FFF, 1)


def test_shingler_slices():
    texts = pa.array(["a b c d", "X y", None, "p q r s t", "A B C d"])
    whole = ngram_join.Shingler(3).sets(texts)
    part = ngram_join.Shingler(3).sets(texts.slice(3))
    assert all(np.array_equal(a, b) for a, b in zip(whole[3:], part, strict=True)) and np.array_equal(whole[0], whole[4])


def test_one_of_each_group_stays(spark):
    texts = _near_copies(random.Random(9), 60) + [None, ""]
    df = documents(spark, texts)
    stay = {i for i, n, c in _groups(texts, 5, Fraction(4, 5)) if i == c or not n}
    kept = ngram_join.drop_near_duplicates(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == stay
    assert ngram_join.jaccard_components(df.limit(0)).count() == 0 and ngram_join.drop_near_duplicates(df.limit(0)).count() == 0
    null = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (None, "e")], "doc_id long, text string")
    assert Counter((r.doc_id, r.component_id) for r in ngram_join.jaccard_components(null).collect()) == Counter([(None, 3), (3, 3), (None, None)])


def test_rows_go_by_themselves(spark):
    """Shared, null and repeated ids: one row of each group stays, and no row that is similar to nothing goes."""
    a, b, c = "a b c d e f g", "p q r s t u v", "k l m n o p q r"
    rows = [(3, a), (5, a), (5, b), (1, c), (1, c), (None, b), (None, "n n n"), (None, "n n n"), (8, None), (8, ""), (9, ""), (None, None)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, _rid string")
    kept = ngram_join.drop_near_duplicates(df)
    assert kept.columns == df.columns
    want = [(3, a), (5, b), (1, c), (None, "n n n"), (8, None), (8, ""), (9, ""), (None, None)]
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(want)


# ---- suffix arrays


def _string(rng, pieces):
    rows, at = [], 3
    for k in range(pieces):
        n = rng.randrange(1, 40)
        body = [rng.randrange(3) for _ in range(n)] if k % 3 else ([1, 2] * 40)[:n]
        rows += [(at + i, s) for i, s in enumerate([*body, -(at + n) - 1])]
        at += n + 1 + rng.randrange(1, 60_000)
    return rows


def test_suffix_array(spark):
    rows = _string(random.Random(4), 14)
    symbol = dict(rows)

    def suffix(i):
        out = []
        while i in symbol:
            out.append(symbol[i])
            i += 1
        return out

    want = {i: r for r, i in enumerate(sorted(symbol, key=suffix), 1)}
    i, s = map(np.array, zip(*rows, strict=True))
    assert dict(zip(i.tolist(), suffix_array.sort_small(i, s).tolist(), strict=True)) == want
    df = spark.createDataFrame(rows, "i long, s long")
    assert {r.i: r.r for r in suffix_array.suffix_ranks(df, base=90).collect()} == want
    assert suffix_array.suffix_ranks(df.limit(0)).count() == 0


def _repeats(texts, length):
    count, out = Counter(), []
    data = [(t or "").encode() for t in texts]
    for b in data:
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    for i, b in enumerate(data):
        dead = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                dead[k : k + length] = b"\1" * length
        kept = bytes(x for x, d in zip(b, dead, strict=True) if not d)
        out.append((i, len(b), sum(dead), len(re.findall(rb"\x01+", bytes(dead))), sha256(kept).hexdigest()))
    return out


def test_suffix_dedup(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choices("abcd ", k=n))
    base = [word(rng.randrange(300, 2500)) for _ in range(8)]
    texts = ODD + ["a" * 1500, "ab" * 700, "y" * 400, "y" * 400, "x" * 399, "x" * 399, "é" * 300, "z" + "é" * 300, base[0], base[0]]
    for _ in range(40):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            b = rng.choice(base)
            low = rng.randrange(len(b))
            parts.append(b[low : rng.randrange(low, len(b) + 1)] if rng.random() < 0.7 else word(rng.randrange(600)))
        texts.append("".join(parts))
    df = documents(spark, texts)
    run = lambda length: sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df, length).collect())
    want = _repeats(texts, 400)
    assert sum(x[2] for x in want) > 10_000
    assert run(400) == want and run(300) == _repeats(texts, 300)
    monkeypatch.setattr(suffix_array, "BASE", 300)
    assert run(400) == want
    null = spark.createDataFrame([(None, base[1], "x"), (4, base[1], "y"), (4, base[1], "z"), (None, None, "z"), (5, base[2], "z")], "doc_id long, text string, did string")
    got = Counter((r.doc_id, r.n_removed) for r in suffix_dedup.remove_repeats(null).collect())
    n = len(base[1]) if len(base[1]) >= 400 else 0
    assert got == Counter([(None, n), (4, n), (4, n), (None, 0), (5, 0)])
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0
