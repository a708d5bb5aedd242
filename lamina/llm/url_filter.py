"""URL filters: longest domain/path rule first, else glob rules run as one bit-parallel Shift-And automaton.

Every glob (``*`` any run, ``?`` any one character, all else literal, whole-URL match) takes one bit per literal
plus a start bit.  The bits of all globs lie side by side in 64-bit words; one pass over the characters of a URL
advances all of them: ``D = ((D << 1) & accept[c]) | (D & loop)``, with the carry taken from word to word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Domain rules of the production filter: (verdict, rule); a rule is a host, a slash and a path prefix.
DOMAIN_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Globs over the canonical URL that block it where no domain rule speaks.
BLOCK_GLOBS = (
    "*://*adult*/*",
    "*://*spam-farm*/*",
    "*://*cheap-pills*/*",
    "*://*casino*/*",
    "*://*/*.exe",
    "*://*/*.zip",
    "*/login*return=*",
    "*://*/de/9??",
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^(.*?)://([^/?#]*)([^?#]*)([^#]*)"


class GlobAutomaton:
    """All globs as one multiword Shift-And automaton."""

    def __init__(self, globs: Sequence[str]):
        self.globs = list(globs)
        chars = sorted({c for g in self.globs for c in g if c not in "*?"})
        self.codes = np.array([ord(c) for c in chars], dtype=np.uint32)
        cells: list[tuple[str | None, bool]] = []  # per bit: literal (None: start bit), self-loop
        ends = []
        for glob in self.globs:
            cells.append((None, False))
            for c in glob:
                if c == "*":
                    cells[-1] = (cells[-1][0], True)
                else:
                    cells.append((c, False))
            ends.append(len(cells) - 1)
        self.words = max(1, -(-len(cells) // 64))
        self.accept = np.zeros((len(chars) + 1, self.words), dtype=np.uint64)
        self.loop = np.zeros(self.words, dtype=np.uint64)
        self.start = np.zeros(self.words, dtype=np.uint64)
        self.ends = np.array(ends, dtype=np.int64)
        for i, (c, loops) in enumerate(cells):
            word, bit = i >> 6, np.uint64(1 << (i & 63))
            if c is None:
                self.start[word] |= bit
            elif c == "?":
                self.accept[:, word] |= bit
            else:
                self.accept[chars.index(c) + 1, word] |= bit
            if loops:
                self.loop[word] |= bit

    def match(self, urls: Sequence[str]) -> np.ndarray:
        """For each URL the index of the first glob that matches it, or -1."""
        out = np.full(len(urls), -1, dtype=np.int64)
        if not len(urls) or not self.globs:
            return out
        raw = [np.frombuffer(u.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for u in urls]
        size = np.array([len(r) for r in raw], dtype=np.int64)
        order = np.argsort(-size, kind="stable")
        at = np.concatenate(([0], np.cumsum(size[order])))[:-1]
        flat = np.concatenate([raw[i] for i in order]) if size.any() else np.zeros(0, np.uint32)
        if len(self.codes):
            spot = np.searchsorted(self.codes, flat).clip(0, len(self.codes) - 1)
            classes = np.where(self.codes[spot] == flat, spot + 1, 0)
        else:
            classes = np.zeros(len(flat), np.int64)
        state = np.repeat(self.start[None, :], len(urls), axis=0)
        sorted_size = -size[order]  # ascending
        one, top = np.uint64(1), np.uint64(63)
        for step in range(int(size.max(initial=0))):
            live = int(np.searchsorted(sorted_size, -step, side="left"))  # longest first: URLs that have this character
            now = state[:live]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:live] = (moved & self.accept[classes[at[:live] + step]]) | (now & self.loop)
        hit = (state[:, self.ends >> 6] >> (self.ends & 63).astype(np.uint64)) & one
        found = np.where(hit.any(axis=1), hit.argmax(axis=1), -1)
        out[order] = found
        return out


def _host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2), _UPPER, _LOWER)


def _path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 3)


def canonical(url: Column) -> Column:
    """Scheme and host in lower case (A-Z), path, query; no fragment. Null, or a URL without ://: empty."""
    whole = F.coalesce(url, F.lit(""))
    scheme = F.translate(F.regexp_extract(whole, _URL, 1), _UPPER, _LOWER)
    rest = F.concat(F.regexp_extract(whole, _URL, 3), F.regexp_extract(whole, _URL, 4))
    return F.when(whole.contains("://"), F.concat(scheme, F.lit("://"), _host(url), rest)).otherwise(F.lit(""))


def domain_rule(host: Column, path: Column, rules: Iterable[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does; of equal rules, block comes first."""
    rule = verdict = None
    for word, text in sorted(rules, key=lambda r: (-len(r[1]), r[1], r[0] != "block")):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, word) if verdict is None else verdict.when(fits, word)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def filter_urls(
    pages: DataFrame, domain_rules: Iterable[tuple[str, str]] = DOMAIN_RULES, globs: Sequence[str] = BLOCK_GLOBS,
    id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """Judge every URL: id, url, host, path, rule, glob (first that matches), verdict.

    Null URLs and those without ``://`` have an empty host and path, fit no rule and are judged by the globs over the
    empty string.  Repeated rows are judged each; other columns (names that clash included) are left out.
    Row-wise, no shuffle; memory is bounded by an Arrow batch.
    """
    globs = list(globs)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.select("id", "url", _host(F.col("url")).alias("host"), _path(F.col("url")).alias("path"), canonical(F.col("url")).alias("canon"))
    schema = T.StructType([*rows.schema.fields[:4], T.StructField("hit", T.IntegerType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = GlobAutomaton(globs)
        for batch in batches:
            hit = automaton.match(batch.column(4).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(hit.astype(np.int32))], names=["id", "url", "host", "path", "hit"])

    judged = rows.mapInArrow(judge, schema)
    rule, verdict = domain_rule(F.col("host"), F.col("path"), domain_rules)
    names = F.array(*[F.lit(g) for g in globs]) if globs else F.array().cast("array<string>")
    return judged.select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), "host", "path", rule.alias("rule"),
        F.when(F.col("hit") >= 0, F.get(names, F.col("hit"))).alias("glob"),
        F.coalesce(verdict, F.when(F.col("hit") >= 0, "block").otherwise("allow")).alias("verdict"),
    )


def _like(glob: str) -> str:
    text = "".join({"*": "%", "?": "_"}.get(c, "\\" + c if c in "%_\\" else c) for c in glob)
    return "canon LIKE '" + text.replace("'", "''") + "' ESCAPE '\\'"


def oracle() -> str:
    fits, words = [], []
    for word, text in sorted(DOMAIN_RULES, key=lambda r: -len(r[1])):
        name, _, rest = text.partition("/")
        test = f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}')"
        fits.append(f"WHEN {test} THEN '{text}'")
        words.append(f"WHEN {test} THEN '{word}'")
    globs = " OR ".join(map(_like, BLOCK_GLOBS))
    part = lambda k: f"regexp_extract(coalesce(url, ''), '{_URL}', {k})"
    low = lambda x: f"translate({x}, '{_UPPER}', '{_LOWER}')"
    return f"""
WITH parts AS (
  SELECT page_id, {low(part(2))} AS host, {part(3)} AS path,
    CASE WHEN contains(coalesce(url, ''), '://') THEN {low(part(1))} || '://' || {low(part(2))} || {part(3)} || {part(4)} ELSE '' END AS canon
  FROM pages)
SELECT page_id, host, path, CASE {' '.join(fits)} END AS rule,
  CASE {' '.join(words)} WHEN {globs} THEN 'block' ELSE 'allow' END AS verdict
FROM parts"""


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    return filter_urls(read_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
