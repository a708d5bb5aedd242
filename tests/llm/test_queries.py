"""Registered queries against their SQL, and the pipeline stage by stage."""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from lamina.llm import line_dedup, mixing, quality, registry

Tokenizer = pytest.importorskip("tokenizers").Tokenizer

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in DATA.iterdir():
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(want, key=repr)


def test_all_ten_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 11))


def _one_of_each(docs):
    """Ids that stay, by brute force over all pairs of five-word sets."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [re.findall(r"[^\x20\x09-\x0D]+", t.translate(lower)) for t in docs["text"].fillna("")]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in words]
    owners = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            owners[x].append(i)
    common = Counter((i, j) for some in owners.values() for i, j in itertools.combinations(some, 2))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, j), c in common.items():
        if 5 * c >= 4 * (len(sets[i]) + len(sets[j]) - c):
            root[find(j)] = find(i)
    ids, least = docs["doc_id"].tolist(), {}
    for i, s in enumerate(sets):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return sorted(x for i, x in enumerate(ids) if not sets[i] or least[find(i)] == x)


def _packed_whole(pieces, docs):
    """Every document's ids and its end id, cut only beyond 2048, gapless in sequences of at most 2048."""
    library = Tokenizer.from_file(corpus_pipeline._tokenizer())
    want = Counter()
    for doc, text in zip(docs["doc_id"].tolist(), docs["text"].fillna(""), strict=True):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        want.update((doc, k, 2048 * k, len(part), zlib.crc32(part.tobytes())) for k, part in enumerate(ids[i : i + 2048] for i in range(0, len(ids), 2048)))
    assert Counter(zip(*[pieces[c].tolist() for c in ("doc_id", "piece", "start", "length", "ids_crc32")], strict=True)) == want
    for _, rows in pieces.sort_values("offset").groupby("sequence_id"):
        ends = rows["length"].cumsum()
        assert ends.iloc[-1] <= 2048 and (ends - rows["length"]).tolist() == rows["offset"].tolist()


def test_pipeline(spark, duck, tmp_path):
    """Each stage, over what the one before kept, against SQL or brute force over the same rows."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    for i, (name, step) in enumerate(corpus_pipeline.STAGES):
        before = docs.toPandas()
        duck.register("stage_in", before)
        docs = step(spark, docs, str(DATA))
        path = str(tmp_path / str(i))
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        if i < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
        ids = sorted(r.doc_id for r in docs.select("doc_id").collect())
        if i == 0:
            want = duck.execute(f"WITH {quality.measured_ctes('stage_in')} SELECT doc_id FROM judged WHERE kept ORDER BY 1").fetchall()
            assert [(x,) for x in ids] == want and 0 < len(ids) < len(before)
        elif i == 1:
            want = duck.execute(f"WITH {line_dedup.dedup_ctes('stage_in')} SELECT doc_id, text FROM cleaned WHERE n_removed = 0 OR n_removed < n_lines ORDER BY 1").fetchall()
            assert sorted((r.doc_id, r.text) for r in docs.collect()) == want
        elif i == 2:
            assert ids == _one_of_each(before)
        elif i == 3:
            want = duck.execute(f"WITH {mixing.mixed_ctes('stage_in')} SELECT doc_id FROM ({mixing.mixed_sql('stage_in', '*')}) ORDER BY 1").fetchall()
            assert [(x,) for x in ids] == want
        else:
            _packed_whole(docs.toPandas(), before)
    assert names[0] == "quality rules" and len(names) == 5


def test_pipeline_takes_odd_rows(spark, tmp_path):
    """Null and repeated ids, null, empty and long texts, null groups, columns with clashing names; and no rows at all."""
    good = " ".join(f"w{i * i % 97}x{i}" for i in range(60))
    rows = [(None, good, None, None, None, "a"), (1, good, "en", "s", 5, "b"), (1, None, "en", "s", 5, "c"), (2, "", "en", None, 5, "d"), (3, good + " end", "en", "s", 5, "e"), (4, "word " * 30_000, "en", "s", 5, "f")]
    rows += [(100 + k, " ".join(f"{chr(97 + (k * i) % 26)}ord{k * i % 101}" for i in range(60)), None, "t", None, "g") for k in range(3, 33)]
    shape = "doc_id long, text string, lang string, source string, n_chars long, copy string, _rid string"
    for part in (rows, []):
        docs = spark.createDataFrame([(*r, "x") for r in part], shape)
        for i, (_, step) in enumerate(corpus_pipeline.STAGES):
            docs = step(spark, docs, str(tmp_path))
            path = str(tmp_path / f"{len(part)}-{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
        assert (docs.count() > 0) == bool(part)
