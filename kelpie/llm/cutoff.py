"""Texts cut off by field limits or transfers.

Lengths of all texts are recomputed under alternative encodings (characters, UTF-8 bytes, UTF-16 units, HTML and JSON
escaping, CRLF line ends) and counted per source; a length that is far more frequent than its neighbours is a hidden
storage limit. Endings are then inspected against statistics of the whole corpus:

* a last word that hardly occurs elsewhere, but begins frequent words, was cut;
* a last line of a log or list is whole if lines of its shape occur inside texts, and any line is if most lines that begin
  alike have its shape or its last word nearly always ends a line (sign-offs, closing lines of logs);
* a subject or other line without a full stop is whole if its last words usually end such lines;
* prose ends in a full stop or the like, unless the point belongs to a number or an abbreviation.

Copies are no evidence for one another: limits and statistics count each distinct text once, and a text is judged by
statistics from which its own last line is taken.

A mark left at the cut ("...") makes nothing whole, except after words that are always followed by it. Where an ending
leaves both open, a length exactly at a hidden limit decides.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kelpie.common import attach, blanks, cut, lookup

_GROUP = ["source", "hash", "at_limit"]  # what copies have in common
MEASURES = ("chars", "bytes", "utf16", "html", "json", "crlf")
SPIKE, RATIO, NEAR = 5, 8.0, 12  # a limit holds at least 5 texts and 8 times the mean of the 12 lengths on either side
LONG = 32  # characters up to which prefixes of words are counted all at once; longer ones are looked up one by one
ENDS = 0.3  # share of a word's occurrences that end a line, from which the word counts as an ending

_BY_SOURCE = {"subject", "prose", "last", "last2"}  # types of statistics that are kept per source
_OWN = _BY_SOURCE | {"lastall", "head", "form", "marked"}  # types that a text's own last line feeds

_WORD = re.compile(r"\d+(?:[.,:]\d+)*[^\W_]*|(?=[^\W\d_]+\d)[^\W_]+|[^\W\d_]+(?:'[^\W\d_]+)*|\S")
_BREAK = re.compile(r"\r\n|\n|\r")
_FORMAT = re.compile("[\u200b-\u200f\u2060\ufeff\u00ad]")
_ANSI = re.compile(r"\x1b\[[0-9;]*m?|\x1b$")
_MARK = re.compile(r"\s*(?:(?<=\n)\[[a-z][^\]\n]{3,60}\]?|\.\.\.+|…|\[(?:\.\.\.|…|truncated|cut|snip|more)[^\]\n]{0,40}\]|<(?:truncated|cut|snip)[^>\n]{0,40}>|\((?:truncated|cut|snip|more)[^)\n]{0,40}\))$", re.I)
_TERMINAL = re.compile(r"[.!?。！？][\"'”’»」』）)\]*_`]*$")
_LIST = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+\S")
_LOG = re.compile(r"^(?:\d{1,2}:\d\d|tests?/|E  |\x1b\[|##\[|==|\s+File \"|downloading |Job |Process |\[\w+\])")
_SIGN = re.compile(r"^(?:--|—|–)\s?\S|^(?:signed-off-by|co-authored-by|reviewed-by):", re.I)


def shape(line: str) -> str:
    """A line with digits, words and capitals masked."""
    s = re.sub(r"\d+", "0", line.strip())
    s = re.sub(r"[^\W\d_A-Z]+", "w", s)
    s = re.sub(r"[A-Z]+", "W", s)
    return s if len(s) <= 200 else s[:100] + hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


@functools.lru_cache(1 << 16)
def _mask(t: str) -> str:
    """Numbers and words with digits as 0, with up to three letters of a unit."""
    if t.isalpha() or not any(c.isdigit() for c in t):
        return t
    unit = re.sub(r".*\d", "", t)
    return "0" + (unit if len(unit) < 4 and t[0].isdigit() else "")


def _plain(text: str) -> str:
    return _FORMAT.sub("", _ANSI.sub("", text)).replace("\u00a0", " ").rstrip()


def _lines(text: str, source: str, only_last: bool = False) -> Iterator[tuple[str, str, bool]]:
    """(line, kind, last) of the lines that are not blank; kind is log, list, subject (a first line that stands alone) or prose."""
    rows = _BREAK.split(text)
    full = [i for i, x in enumerate(rows) if x and not x.isspace()]
    if not full:
        return
    log = source.endswith("log")
    like = not log and len(full) > 3 and _LOG.match(rows[full[0]]) is not None
    for i in full[-1:] if only_last else full:
        line = rows[i]
        if log or like and _LOG.match(line):
            kind = "log"
        elif _LIST.match(line):
            kind = "list"
        else:
            kind = "subject" if i == full[0] and (i + 1 == len(rows) or not rows[i + 1].strip()) else "prose"
        yield line, kind, i == full[-1]


class _Counts:
    """How often tokens occur (``any``) and end something (``end``), by type and what the type is kept for."""

    def __init__(self) -> None:
        self.any: defaultdict[tuple[str, str], Counter] = defaultdict(Counter)
        self.end: defaultdict[tuple[str, str, int], Counter] = defaultdict(Counter)

    def __len__(self) -> int:
        return sum(map(len, self.any.values()))

    def clear(self) -> None:
        self.any.clear(), self.end.clear()

    def rows(self) -> pa.RecordBatch:
        """type, key, n_any and n_end of the last, the last but one and the last but two tokens."""
        types, keys, n, ends = [], [], [], ([], [], [])
        for (kind, of), c in self.any.items():
            e = [self.end.get((kind, of, d), {}) for d in range(3)]
            types += [kind] * len(c)
            keys += [f"{of} {t}" for t in c] if of else c
            n += c.values()
            for d in range(3):
                ends[d].extend(map(e[d].get, c, [0] * len(c)) if e[d] else [0] * len(c))
        cols = [pa.array(types, pa.string()), pa.array(keys, pa.string()), *(pa.array(x, pa.int64()) for x in (n, *ends))]
        return pa.RecordBatch.from_arrays(cols, names=["type", "key", "n_any", "n_end0", "n_end1", "n_end2"])

    def of(self, kind: str, distance: int, key: str, kept_for: str) -> tuple[int, int]:
        """(n_end, n_any) of one key."""
        t = key[len(kept_for) + 1 :] if kept_for else key
        n = self.any.get((kind, kept_for))
        e = self.end.get((kind, kept_for, distance))
        return (e.get(t, 0) if e else 0), (n.get(t, 0) if n else 0)


def _count(text: str, source: str, into: _Counts, at_limit: bool, own: bool = False, per_source: bool = False) -> None:
    """Counts of one text, or of its last line if ``own``; the end of a text at a storage limit is no example of how lines end.

    ``per_source`` takes only what is kept per source. Every token that ends something also occurs, so all keys are in ``any``.
    """
    any_, end = into.any, into.end
    text = _plain(text)
    for line, kind, last in _lines(text, source, own):
        raw = _WORD.findall(_MARK.sub("", line) if last else line)
        if not raw:
            continue
        toks = [_mask(t) for t in raw]
        alpha = [t for t in toks if t[0].isalpha()]
        two = [f"{a} {b}" for a, b in zip(toks, toks[1:])]
        open_ = not _TERMINAL.search(line.rstrip()) and not (last and at_limit)
        closed = open_ or kind == "log" and not (last and at_limit)
        if kind in ("subject", "prose"):
            any_[kind, source].update(toks)
            if open_:
                for d in range(min(3, len(toks))):
                    end[kind, source, d][toks[-1 - d]] += 1
        any_["last", source].update(alpha)
        any_["last2", source].update(two)
        if closed and toks[-1][0].isalpha():
            end["last", source, 0][toks[-1]] += 1
        if closed and two:
            end["last2", source, 0][two[-1]] += 1
        if per_source:
            continue
        scope = "log" if kind == "log" else "text"
        form = shape(line)
        any_["head", ""][toks[0]] += 1
        any_["form", ""][f"{toks[0]} {form}"] += 1
        any_["lastall", ""].update(alpha)
        if closed and toks[-1][0].isalpha():
            end["lastall", "", 0][toks[-1]] += 1
        if kind in ("subject", "prose"):
            any_["marked", ""].update(two)
        if last and not at_limit and two and _MARK.search(text):
            any_["marked", ""][two[-1]] += 0
            end["marked", "", 0][two[-1]] += 1
        if own:
            continue
        any_["vocabulary", scope].update(alpha)
        any_["word", scope].update(alpha[:-1] if last and toks[-1][0].isalpha() else alpha)
        if not last:
            any_["shape", ""][form] += 1
        # a point at a line's end, or before a capital, ends a sentence; one at the text's end tells nothing
        if "." in toks:
            for i, t in enumerate(toks):
                if t == "." and i and not (last and i + 1 == len(toks)):
                    k = toks[i - 1] if toks[i - 1] != "0" else f"{toks[i - 2] if i > 1 else ''} 0"
                    any_["stop", ""][k] += 1
                    end["stop", "", 0][k] += i + 1 == len(toks) or toks[i + 1][:1].isupper() or not toks[i + 1][:1].isascii()
        for a, b in zip(toks, raw[1:]):
            if b[0].isdigit():
                any_["frac", ""][a] += 1
                end["frac", "", 0][a] += "." in b


_STATS = "type string, key string, n_any long, n_end0 long, n_end1 long, n_end2 long"


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = _Counts()
    for b in batches:
        for i, (text, source, at_limit, lead, near) in enumerate(zip(*(b.column(c).to_pylist() for c in ("text", "source", "at_limit", "lead", "near")))):
            if lead or near:  # near only: counted under another source; here what is kept per source
                _count(text, source, counts, at_limit, per_source=not lead)
            if i % 256 == 255 and len(counts) > 200_000:
                yield counts.rows()
                counts.clear()
    yield counts.rows()


def _last(source: str, toks: list[str]) -> list[tuple[str, int, str]]:
    one = [("last", 0, f"{source} {toks[-1]}" if source else toks[-1]), ("lastall", 0, toks[-1])] if toks[-1][0].isalpha() else []
    two = f"{toks[-2]} {toks[-1]}" if len(toks) > 1 else ""
    return one + ([("last2", 0, f"{source} {two}" if source else two)] if two else [])


def _own(text: str, source: str, here: bool, home: str, home_limit: bool):
    """A function of a key: what the text's own last line added to its counts, (n_end, n_any)."""
    near = far = _Counts()
    _count(text, source, near, here, True)
    if (home, home_limit) != (source, here):
        far = _Counts()
        _count(text, home, far, home_limit, True)

    def of(key: tuple[str, int, str]) -> tuple[int, int]:
        if key[0] in _BY_SOURCE:
            return near.of(*key, source)
        return far.of(*key, "") if key[0] in _OWN else (0, 0)

    return of


def _ending(text: str, source: str, own) -> dict:
    """What the end of a text shows by itself, and the keys under which the corpus tells more, with the text's own share."""
    text = _plain(text)
    mark = bool(_MARK.search(text))
    body = _MARK.sub("", text)
    *_, (line, kind, _) = [("", "prose", True), *_lines(body, source, True)]
    toks = [_mask(t) for t in _WORD.findall(line)]
    last = toks[-1] if toks else ""
    keys: list[tuple[str, int, str]] = []
    sure = None
    stripped = line.strip()
    fences = len(re.findall(r"^\s*```", body, re.M))
    if body.endswith("\ufffd"):
        sure = "cut inside a character"
    elif fences % 2:
        sure = "cut inside code"
    elif mark:
        if len(toks) > 1:
            keys.append(("marked", 0, f"{toks[-2]} {toks[-1]}"))
    elif stripped.startswith("```") or _SIGN.match(stripped):
        sure = "whole"
    elif stripped.startswith("|"):
        sure = "whole" if stripped.endswith("|") and stripped.count("|") > 1 else "cut inside a table"
    elif stripped and (unicodedata.category(stripped[-1]) == "So" or stripped[-1] in "️‍" or re.search(r"(?:^|\s):[a-z0-9_+-]+:$", stripped)):
        sure = "whole"
    elif _TERMINAL.search(stripped):
        sure = "whole"
        if kind == "log":
            sure = None
            keys += [("shape", 0, shape(line)), ("head", 0, toks[0]), ("form", 0, f"{toks[0]} {shape(line)}"), *_last(source, toks)]
        elif stripped.endswith(".") and len(toks) > 1:
            before = toks[-2]
            if before == "0" or len(before) == 1 and len(toks) > 3 and toks[-3] == ".":
                keys.append(("stop", 0, f"{toks[-3] if len(toks) > 2 else ''} 0" if before == "0" else before))
                sure = None
                if before == "0" and "." not in _WORD.findall(line)[-2]:
                    keys.append(("frac", 0, toks[-3] if len(toks) > 2 else ""))
    elif toks:
        keys += [("shape", 0, shape(line)), ("head", 0, toks[0]), ("form", 0, f"{toks[0]} {shape(line)}")]
        keys += _last(source, toks)
        if kind in ("subject", "prose"):
            keys += [(kind, d, f"{source} {toks[-1 - d]}" if source else toks[-1 - d]) for d in range(min(3, len(toks)))]
    if last and last[0].isalpha() and sure is None:
        scope = "log" if kind == "log" else "text"
        keys += [("word", 0, f"{scope} {last}"), ("prefix", 0, f"{scope} {last}")]
    return {"kind": kind, "mark": mark, "sure": sure, "last": last, "terminal": bool(_TERMINAL.search(stripped)) and not mark, "keys": [{"type": k[0], "at": k[1], "key": k[2], "own_end": (o := own(k))[0], "own_any": o[1]} for k in dict.fromkeys(keys)]}


def _endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [_ending(t, s, _own(t, s, *o)) for t, s, *o in zip(*(b.column(c).to_pylist() for c in ("text", "source", "here", "home", "home_limit")))]
        key = pa.struct([("type", pa.string()), ("at", pa.int32()), ("key", pa.string()), ("own_end", pa.int64()), ("own_any", pa.int64())])
        yield pa.RecordBatch.from_arrays(
            [*(b.column(c) for c in _GROUP), *(pa.array([r[c] for r in rows], t) for c, t in (("kind", pa.string()), ("mark", pa.bool_()), ("sure", pa.string()), ("last", pa.string()), ("terminal", pa.bool_()), ("keys", pa.list_(key))))],
            names=[*_GROUP, "kind", "mark", "sure", "last", "terminal", "keys"],
        )


def lengths():
    """The stored length of a text under every measure, in the order of ``MEASURES``."""
    t = F.col("text")
    n = F.length(t)
    count = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    breaks = count("\n")
    quotes, returns = count('"'), count("\r")
    values = {
        "chars": n,
        "bytes": F.octet_length(t),
        "utf16": (F.octet_length(F.encode(t, "UTF-16BE")) / 2).cast("int"),
        "html": n + count("&") * 4 + count("<") * 3 + count(">") * 3 + quotes * 5 + count("'") * 4,
        "json": n + quotes + count("\\") + breaks + count("\t") + returns,
        "crlf": n + breaks - F.when(returns > 0, F.regexp_count(t, F.lit("\r\n"))).otherwise(0),
    }
    return F.array(*[values[m].cast("int") for m in MEASURES])


def limits(documents: DataFrame) -> DataFrame:
    """(source, measure, length, n): hidden storage limits, the lengths that hold far more texts than their neighbours."""
    names = F.array(*[F.lit(m) for m in MEASURES])
    return _limits(documents.select("source", lengths().alias("lengths"))).select("source", names[F.col("measure")].alias("measure"), "length", "n")


def _limits(texts: DataFrame) -> DataFrame:
    counts = texts.select("source", F.posexplode("lengths").alias("measure", "length")).groupBy("source", "measure", "length").agg(F.count("*").alias("n"))
    near = Window.partitionBy("source", "measure").orderBy("length").rangeBetween(-NEAR, NEAR)
    mean = (F.sum("n").over(near) - F.col("n")) / (2 * NEAR)
    return counts.withColumn("mean", mean).filter((F.col("n") >= SPIKE) & (F.col("n") >= RATIO * F.col("mean"))).select("source", "measure", "length", "n")


def _texts(documents: DataFrame) -> DataFrame:
    source = F.lower(blanks(F.coalesce("source", F.lit(""))))
    return documents.select("doc_id", source.alias("source"), "text").filter(F.col("text").rlike(r"(?U)[^\s\u200b-\u200f\u2060\ufeff]") & F.col("doc_id").isNotNull())


# Fixed value: characters that Unicode counts as white space.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _hash():
    """The same for copies, whatever ``_plain`` takes away."""
    t = F.col("text")
    t = F.when(F.contains(t, F.lit("\x1b")), F.regexp_replace(t, r"\x1b\[[0-9;]*m?|\x1b$", "")).otherwise(t)
    t = F.translate(t, "\u00a0\u200b\u200c\u200d\u200e\u200f\u2060\ufeff\u00ad", " ")
    return F.sha2(F.rtrim(t, F.lit(_WHITE)), 256)


def inspect(documents: DataFrame) -> DataFrame:
    """doc_id, source, reason (null for a whole text), at_limit; null, empty and blank texts and null ids are left out.

    Reads doc_id, text, source; sources are compared without case and outer blanks. A repeated doc_id is judged once,
    by any of its rows. Limits and corpus statistics count every distinct text once, and copies of a source are judged
    together, so a text that holds a third of the rows costs and tells as much as one; keys of any frequency are summed
    before the shuffle.
    """
    text_id = F.xxhash64("text").alias("text_id")
    base = cut(_texts(documents).select("doc_id", "source", _hash().alias("hash"), lengths().alias("lengths"), text_id))  # texts are measured once
    held = _limits(base.select("source", "hash", "lengths").distinct()).groupBy("source").agg(F.collect_set(F.struct("measure", "length")).alias("limits"))
    at = F.exists("limits", lambda x: F.get("lengths", x["measure"]) == x["length"])
    rows = attach(base, held, "source").select("doc_id", "source", "hash", F.coalesce(at, F.lit(False)).alias("at_limit"), "text_id")
    # a text counts once per source for what is kept per source, and once, under its first source, for all else
    first = F.min(F.struct("source", "at_limit")).over(Window.partitionBy("hash"))
    here = F.min("at_limit").over(Window.partitionBy("hash", "source"))
    groups = rows.groupBy(*_GROUP).agg(F.min(F.struct("doc_id", "text_id")).alias("of")).select(*_GROUP, "of.*", first.alias("first"), here.alias("here"))
    # one text of every group, found by its row
    texts = _texts(documents).select("doc_id", "text", text_id).join(groups, ["doc_id", "text_id"]).dropDuplicates(["doc_id", "text_id"])
    texts = cut(texts.select(*_GROUP, "text", "here", F.col("first.source").alias("home"), F.col("first.at_limit").alias("home_limit")))
    near = F.col("at_limit") == F.col("here")
    counted = texts.select("text", "source", "at_limit", (near & (F.col("source") == F.col("home"))).alias("lead"), near.alias("near"))
    sums = [F.sum(c).alias(c) for c in ("n_any", "n_end0", "n_end1", "n_end2")]
    stats = cut(counted.mapInArrow(_stats, _STATS).groupBy("type", "key").agg(*sums))
    ends = cut(texts.mapInArrow(_endings, "source string, hash string, at_limit boolean, kind string, mark boolean, sure string, last string, terminal boolean, keys array<struct<type string, at int, key string, own_end long, own_any long>>"))
    asked = ends.select(*_GROUP, F.inline("keys"))
    zero = F.lit(0).cast("long")
    prefixes = _prefixes(stats.filter("type = 'vocabulary'").select("key", "n_any"), asked.filter("type = 'prefix'").select("key").distinct())
    prefixes = prefixes.select(F.lit("prefix").alias("type"), "key", "n_any", zero.alias("n_end0"), zero.alias("n_end1"), zero.alias("n_end2"))
    known = lookup(asked, stats.union(prefixes), ["type", "key"], "inner")
    n_end = F.when(F.col("at") == 0, F.col("n_end0")).when(F.col("at") == 1, F.col("n_end1")).otherwise(F.col("n_end2"))
    v = F.struct((n_end - F.col("own_end")).alias("n_end"), (F.col("n_any") - F.col("own_any")).alias("n_any"))
    name = F.when(F.col("type").isin("subject", "prose"), F.concat("type", F.col("at").cast("string"))).otherwise(F.col("type"))
    facts = known.groupBy(*_GROUP).agg(F.map_from_entries(F.collect_set(F.struct(name.alias("type"), v.alias("v")))).alias("f"))
    e = ends.join(facts, _GROUP, "left")
    n = lambda t, c="n_any": F.coalesce(F.col("f")[t][c], F.lit(0))
    judged = e.withColumn("reason", _reason(n)).select(*_GROUP, "kind", "reason")
    return lookup(rows.select("doc_id", *_GROUP), judged, _GROUP, "inner").dropDuplicates(["doc_id"]).select("doc_id", "source", "kind", "reason", "at_limit")


def _prefixes(words: DataFrame, asked: DataFrame) -> DataFrame:
    """(key, n_any): how often words (key, n_any) occur that are longer than each ``asked`` key and begin with it.

    Prefixes of up to ``LONG`` characters are taken of all words and summed where they are asked; longer asked ones meet the
    words that share their first ``LONG`` characters.
    """
    cuts = F.sequence(F.lit(1), F.least(F.length("key") - 1, F.lit(LONG)))
    every = words.filter(F.length("key") > 1).select(F.explode(F.transform(cuts, lambda i: F.substring("key", F.lit(1), i))).alias("key"), "n_any")
    short = attach(every, asked.filter(F.length("key") <= LONG), "key", "inner").groupBy("key").agg(F.sum("n_any").alias("n_any"))
    head = F.substring("key", 1, LONG)
    far = asked.filter(F.length("key") > LONG).select(head.alias("head"), F.col("key").alias("asked"))
    long = words.filter(F.length("key") > LONG).select(head.alias("head"), "key", "n_any").join(far, "head")
    hit = long.filter(F.startswith("key", F.col("asked")) & (F.col("key") != F.col("asked")))
    return short.union(hit.groupBy(F.col("asked").alias("key")).agg(F.sum("n_any").alias("n_any")))


def _reason(n):
    word = (F.col("last") != "") & F.col("last").rlike(r"^\p{L}") & (n("prefix") > 0) & (n("word") * 20 <= n("prefix")) & (F.col("sure").isNull())
    always = (n("marked", "n_end") >= 3) & (n("marked", "n_end") * 2 >= n("marked"))
    stops = (n("stop", "n_end") * 4 >= n("stop")) & ((n("frac") < 3) | (n("frac", "n_end") * 2 < n("frac")))
    ends = lambda t: (n(t) >= 5) & (n(t, "n_end") * 10 >= n(t) * 8)
    usual = (n("form") >= 3) & (n("form") * 2 >= n("head")) | ends("last") | ends("lastall") | ends("last2")
    known = (n("shape") >= 3) | usual
    ending = F.lit(False)
    for kind in ("subject", "prose"):
        best, ratio = F.lit(-1), F.lit(0.0)
        for d in range(3):
            c = n(f"{kind}{d}")
            better = c > best
            ratio = F.when(better & (c >= 3), n(f"{kind}{d}", "n_end") / c).otherwise(ratio)
            best = F.when(better, c).otherwise(best)
        ending = F.when(F.col("kind") == kind, ratio >= ENDS).otherwise(ending)
    return (
        F.when(F.col("sure") == "whole", None)
        .when(F.col("sure").isNotNull(), F.col("sure"))
        .when(F.col("mark") & (word | ~always), "ends in a mark left at the cut")
        .when(F.col("mark"), None)
        .when(F.col("terminal") & (F.col("kind") != "log"), F.when(~stops, "ends inside a number or an abbreviation"))
        .when(word, "ends inside a word")
        .when(F.col("kind").isin("log", "list"), F.when(~known, F.concat(F.lit("ends inside a line of a "), F.col("kind"))).when(F.col("at_limit") & ~F.col("terminal") & ~usual, "ends at a storage limit"))
        .when(usual, None)
        .when(F.col("kind") == "subject", F.when(~ending | F.col("at_limit"), "ends inside a subject"))
        .when(~ending, "ends inside a sentence")
    )


def found(documents: DataFrame) -> DataFrame:
    """doc_id of each text that was cut off."""
    return inspect(documents).filter("reason IS NOT NULL").select("doc_id")


def report(documents: DataFrame) -> DataFrame:
    """Per source: texts, cut texts and their share; texts that are blank, empty or null count as not cut."""
    source = F.lower(blanks(F.coalesce("source", F.lit(""))))
    total = documents.groupBy(source.alias("source")).agg(F.count("*").alias("n_texts"))
    bad = inspect(documents).groupBy("source").agg(F.count("reason").alias("n_cut"))
    n = F.coalesce("n_cut", F.lit(0)).cast("long")
    return total.join(bad, "source", "left").select("source", "n_texts", n.alias("n_cut"), (n / F.col("n_texts")).alias("cut_share"))
