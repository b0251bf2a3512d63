"""Source files that were not written by hand in their repository.

Grammars tell: a Re-Pair grammar over a file's masked tokens (see ``repair``) shows how much of the file one rule
repeats. Generators repeat one production for most of a file; minifiers do so on very long lines; blobs are literals
that no rule compresses; tables of data are nearly all literals. Across files, phrases of a locally consistent grammar
(cut where neighbouring tokens say so, hence the same in every copy) that are found in two or more repositories mark
copies of other projects' files, patched or not.

Only the code counts: file names, directories and comments that merely mention generated files have no influence, except
that a leading comment may attribute the file to an upstream project, not the repository's own, if it names the upstream's
release or files of two or more other repositories bear the name.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.common import cut, lookup
from kelpie.llm import repair

MIN_TOKENS = 40  # shorter files are broken or trivial, and counted as hand-written unless literals fill them
USES, EXPANSION, REUSE, SMALL = 10, 8, 0.5, 0.3  # one rule of at least 8 tokens, used 10 times or more, stands for half the file, and the whole grammar is small
LITERALS, LITERAL_CHARS = 0.68, 300
LINE, COMPRESSED, BLANK = 200, 0.38, 0.12
SHARED, FEWEST = 0.8, 10  # of a file's phrases; a file of fewer phrases may be boilerplate only
_PHRASES = 6  # base phrases in a phrase that is compared across repositories
_SLICE = 4 << 20  # characters handled at once

_STRING = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`[^`]*`')
_NUMBER = re.compile(r"\b\d[\d._]*\b")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")
_WORD = re.compile(r"[A-Za-z_]\w*|\d+|[^\s\w]")
# Phrases by which a leading comment attributes a file to an upstream project.
_LEADING = re.compile(r"\ufeff?(?:\s+|#[^\r\n]*|//[^\r\n]*|/\*[\s\S]*?\*/)*+")
_UPSTREAM = re.compile(r"(?:\(c\) the (\w+) contributors|this file is part of (\w+), version|copyright (?:\(c\) )?\d{4}(?:-\d{4})? the (\w+) project)", re.I)

_SCHEMA = "file_id long, repo string, n_tokens int, reuse double, ratio double, literals double, literal_chars int, longest int, blank double, upstream string, release boolean, phrases array<long>"


def _phrases(words: list[str], cache: dict[str, int]) -> np.ndarray:
    """Hashes of all runs of ``_PHRASES`` base phrases; a base phrase ends where the hash of two tokens says so."""
    h = np.fromiter((cache[w] if w in cache else cache.setdefault(w, zlib.crc32(w.encode("utf-8", "replace"))) for w in words), np.uint64, len(words))
    if len(h) < 8:
        return np.empty(0, np.int64)
    odd = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        two = (h[1:] * odd) ^ (h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F))
        ends = np.flatnonzero((two >> np.uint64(33)) % np.uint64(8) == 0) + 1
        starts = np.r_[0, ends]
        powers = odd ** np.arange(len(h), dtype=np.uint64)
        inside = np.arange(len(h)) - np.repeat(starts, np.diff(np.r_[starts, len(h)]))
        base = np.add.reduceat((h + np.uint64(1)) * powers[inside], starts)
        if len(base) < _PHRASES:
            base = np.r_[base, np.zeros(_PHRASES - len(base), np.uint64)]
        runs = np.lib.stride_tricks.sliding_window_view(base, _PHRASES)
        mixed = (runs * (odd ** np.arange(1, _PHRASES + 1, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed).astype(np.int64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache: dict[str, int] = {}
    for b in batches:
        texts = b.column("source_text").to_pylist()
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end] or "") <= _SLICE):
                chars += len(texts[end] or "")
                end += 1
            yield _measure(b.slice(at, end - at), [t or "" for t in texts[at:end]], cache)
            at = end
            if len(cache) > 1 << 20:
                cache.clear()


def _measure(b: pa.RecordBatch, texts: list[str], cache: dict[str, int]) -> pa.RecordBatch:
    n = len(texts)
    syms, lit, longest, blank, up, release, phrases = [], [], [], [], [], [], []
    for t in texts:
        strings = sum(map(len, _STRING.findall(t)))
        plain = _STRING.sub(" s ", t)
        lit.append(strings + sum(map(len, _NUMBER.findall(plain))))
        toks = _TOKEN.findall(plain)
        syms.append(np.fromiter((1 if (c := x[0]).isascii() and c.isalpha() else 2 if c.isdigit() else 3 + ord(c) for x in toks), np.int64, len(toks)))
        longest.append(max(map(len, re.split(r"[\r\n]+", t))))
        solid = len("".join(t.split()))
        blank.append((solid, len(t)))
        m = _UPSTREAM.search(head := re.sub(r"[\s*#/]+", " ", _LEADING.match(t).group()))
        up.append(next((g.lower() for g in m.groups() if g), None) if m else None)
        release.append(bool(m) and re.search(rf"\b{up[-1]},? (?:version )?v?\d+\.\d", head, re.I) is not None)
        phrases.append(_phrases(_WORD.findall(t), cache))
    fid = np.repeat(np.arange(n), [len(s) for s in syms])
    sym = np.concatenate(syms)
    size = np.bincount(fid, minlength=n)
    owner, uses, span, _, final = repair.infer(fid, repair.dense(fid, sym), n)
    reuse = np.zeros(n)
    ok = (uses >= USES) & (span >= EXPANSION)
    np.maximum.at(reuse, owner[ok], uses[ok] * span[ok] / np.maximum(size[owner[ok]], 1))
    ratio = (final + 2 * np.bincount(owner, minlength=n)) / np.maximum(size, 1)
    solid = np.array([max(s, 1) for s, _ in blank])
    space = np.array([1 - s / max(total, 1) for s, total in blank])
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(p) for p in phrases])], pa.int32()), pa.array(np.concatenate(phrases)))
    cols = [b.column("file_id"), b.column("repo"), pa.array(size.astype(np.int32)), pa.array(reuse), pa.array(ratio), pa.array(np.array(lit) / solid), pa.array(np.array(lit, np.int32)), pa.array(np.array(longest, np.int32)), pa.array(space), pa.array(up, pa.string()), pa.array(release, pa.bool_()), lists]
    return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in _SCHEMA.split(", ")])


def features(files: DataFrame) -> DataFrame:
    """One row of grammar figures per file; a null or empty text has zeros and no phrases."""
    rows = files.select(F.col("file_id").cast("long").alias("file_id"), F.coalesce("repo", F.lit("")).alias("repo"), "source_text")
    return rows.mapInArrow(_features, _SCHEMA)


def judge(modules: DataFrame, files: DataFrame) -> DataFrame:
    """module_id, repo, kind, shared and the grammar figures, one row per module.

    ``kind`` is generated, minified, data, vendored or hand. Modules are the distinct module_ids of ``modules`` that
    ``files`` (file_id, repo, source_text) has a text for; rows stored twice count once; a null, empty or broken text is
    hand-written. A phrase is shared if files of two or more repositories hold it; its repositories are
    pre-aggregated to their minimum and maximum, so phrases of any frequency cost the same.
    """
    known = modules.select(F.col("module_id").cast("long").alias("file_id")).distinct()
    f = cut(features(files).join(known, "file_id", "left_semi").dropDuplicates(["file_id"]))
    phrases = f.select("file_id", "repo", F.explode("phrases").alias("phrase"))
    common = phrases.groupBy("phrase").agg(F.min("repo").alias("a"), F.max("repo").alias("b")).filter("a <> b").select("phrase")
    hits = lookup(phrases, common, "phrase", "inner").groupBy("file_id").agg(F.count("*").alias("n_shared"))
    j = f.join(hits, "file_id", "left").withColumn("shared", F.coalesce(F.col("n_shared") / F.size("phrases"), F.lit(0.0)))
    # a project's own header names no release of it, and is not found in other repositories
    elsewhere = f.filter(F.element_at(F.split(F.lower("repo"), "/"), -1) != F.col("upstream"))
    spread = elsewhere.groupBy("upstream").agg(F.min("repo").alias("a"), F.max("repo").alias("b")).filter("a <> b").select("upstream", F.lit(True).alias("spread"))
    own = F.element_at(F.split(F.lower("repo"), "/"), -1) == F.col("upstream")
    j = lookup(j, spread, "upstream").withColumn("attributed", F.coalesce((F.col("release") | F.coalesce("spread", F.lit(False))) & ~own, F.lit(False)))
    enough = F.col("n_tokens") >= MIN_TOKENS
    data = (F.col("literals") >= LITERALS) & (F.col("literal_chars") >= LITERAL_CHARS)
    minified = enough & (F.col("longest") >= LINE) & (F.col("ratio") < COMPRESSED) & (F.col("blank") < BLANK)
    copied = enough & ((F.col("shared") >= SHARED) & (F.size("phrases") >= FEWEST) | F.col("attributed"))
    kind = F.when(data, "data").when(minified, "minified").when(enough & (F.col("reuse") >= REUSE) & (F.col("ratio") <= SMALL), "generated").when(copied, "vendored").otherwise("hand")
    return j.select(F.col("file_id").alias("module_id"), "repo", kind.alias("kind"), "shared", "n_tokens", "reuse", "ratio", "literals", "literal_chars", "longest", "blank", "upstream", F.size("phrases").alias("n_phrases"))


def not_by_hand(modules: DataFrame, files: DataFrame) -> DataFrame:
    """module_id of each module whose file was generated, minified, copied or is data; each once."""
    return judge(modules, files).filter("kind <> 'hand'").select("module_id")
