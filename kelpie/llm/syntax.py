"""Source files that do not parse, by the language of the path's extension.

Files are lexed into rows, one per bracket and per run of tokens between brackets (one per logical line for Python, whose lexer
needs the brackets to find them). Three checks follow on the rows:

1. adjacent pairs of tokens are anti-joined against the pairs the grammar permits; for Python these are derived from the
   grammar's rules, for the others from classes of tokens;
2. nesting: running sums over each file give every token its depth, and every bracket its partner; for Python, windows
   over neighbouring lines check blocks (indents, clauses, decorators, what a match holds);
3. productions: windowed reductions collapse each bracket group to one symbol of the group around it; each distinct group
   (or Python line) of the corpus is derived once from the productions of its role and joined back.

No language's own parser is asked.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kelpie.common import attach, cut
from kelpie.llm import lexers, productions, python_grammar

# Languages by extension.
LANGUAGES = {"py": "python", "java": "java", "js": "js", "mjs": "js", "go": "go"}
_ROWS = 100_000

_SCHEMA = "row long, lang string, pos int, prev string, sym string, delta int, role string"


def language(path: Column) -> Column:
    """The language named by a path's extension in any letter case; null for others."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit(None).cast("string")
    for e, name in LANGUAGES.items():
        out = F.when(ext == e, name).otherwise(out)
    return out


def _runs(tokens: list[lexers.Token]) -> list[lexers.Token]:
    """Tokens with those between two brackets joined to one; faults and empty symbols stay alone."""
    out: list[lexers.Token] = []
    run: list[str] = []
    for t in tokens:
        if not t[1] and t[0] and not t[0].startswith("fault:"):
            run.append(t[0])
            continue
        if run:
            out.append((" ".join(run), 0, ""))
            run = []
        out.append(t)
    if run:
        out.append((" ".join(run), 0, ""))
    return out


def _lexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cols: list[list] = [[], [], [], [], [], [], []]

    def batch() -> pa.RecordBatch:
        types = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string())
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["row", "lang", "pos", "prev", "sym", "delta", "role"])
        for c in cols:
            c.clear()
        return out

    for b in batches:
        for row, fid, lang, text in zip(*(b.column(i).to_pylist() for i in range(4))):
            if lang == "python":
                rows = [(line, level, "line") for level, line in lexers.python_lines(text)]
            else:
                rows = _runs(lexers.lex(text, lang)) or [("", 0, "empty")]
            syms = [r[0] for r in rows]
            n = len(rows)
            ends = [x[x.rfind(" ") + 1 :] for x in syms[:-1]]
            for c, v in zip(cols, ([row] * (n + 1), [lang] * (n + 1), range(-1, n), [str(fid), *["", *ends][:n]], ["", *syms], [0, *[r[1] for r in rows]], ["file", *[r[2] for r in rows]])):
                c.extend(v)
            if len(cols[0]) >= _ROWS:
                yield batch()
    yield batch()


def tokens(files: DataFrame) -> DataFrame:
    """Token rows (row, lang, pos, prev, sym, delta, role): a bracket, or the tokens between two brackets with blanks between them.

    ``prev`` is the token before. A Python row is a logical line, and delta its indent level.

    ``row`` numbers the files, as a file_id may be repeated; a file's first row, at -1, has its file_id in ``prev``.
    """
    rows = files.select(F.monotonically_increasing_id().alias("row"), F.col("file_id").cast("long").alias("file_id"), language(F.col("file_path")).alias("lang"), "source_text")
    return rows.filter("lang IS NOT NULL AND source_text IS NOT NULL AND file_id IS NOT NULL").mapInArrow(_lexed, _SCHEMA)


def permitted() -> list[tuple[str, str, str]]:
    """(lang, prev, sym): the pairs of symbols that a sentence of the language may hold side by side.

    For Python they are derived from the grammar; for the others all pairs of its alphabet but those that no sentence holds.
    """
    closers = [")", "]", "}"]
    openers = {"java": ["(", "[", "{b", "{c", "{e", "{s", "{i"], "js": ["(", "[", "{b", "{c", "{o", "{s", "{n"], "go": ["(", "[", "{b", "{l", "{s", "{i"]}
    words = {"java": lexers.JAVA_WORDS, "js": lexers.JS_WORDS, "go": lexers.GO_WORDS}
    ops = {"java": lexers.JAVA_OPS, "js": lexers.JS_OPS, "go": lexers.GO_OPS}
    out = [("python", a, b) for a, b in sorted(python_grammar.permitted())]
    for lang in words:
        between = {"==", "!=", "&&", "||", "<=", ">=", "<<", "+=", "-=", "=", "/", "%"} | ({"===", "!==", "**", "??", "=>"} if lang == "js" else set())
        alphabet = sorted({"", "i", "n", "s", "N", *closers, *openers[lang], *words[lang], *ops[lang]})
        for a in alphabet:
            for b in alphabet:
                bad = (
                    a in between and b in between  # an operator needs an operand on either side
                    or a in between and b in (")", "]", "}", ";", ",", ":")
                    or a in ("(", "[", ",") and b in between - {"=>"}
                    or a in ("n", "s") and b in ("i", "n") and not (lang == "js" and a == "s")
                    or a == "n" and b in ("s", "(")
                    or a == "s" and b == "s" and lang != "js"
                    or a == "." and not (b[:1].isalpha() or b in ("(", "*", "#", "<", "[", "N", "."))
                    or a == ")" and b == "n"
                    or lang == "java" and a == "," and b == ")"
                )
                if not bad:
                    out.append((lang, a, b))
    return out


def _pair_faults(tok: DataFrame) -> DataFrame:
    spark = tok.sparkSession
    table = F.broadcast(spark.createDataFrame([p for p in permitted() if p[0] != "python"], "lang string, prev string, sym string"))
    rows = tok.filter("lang <> 'python' AND sym <> '' AND NOT sym LIKE 'fault:%'")
    words = F.split("sym", " ")
    say = F.concat(F.lit("misplaced "), F.col("sym"), F.lit(" after "), F.col("prev")).alias("fault")
    across = rows.filter("prev <> ''").select("lang", "prev", words[0].alias("sym"), "row").distinct()
    out = across.join(table, ["lang", "prev", "sym"], "left_anti").select("row", say)
    # pairs inside a run, once for every distinct run
    runs = rows.filter("sym LIKE '% %'").select("lang", F.col("sym").alias("run"))
    w = F.split("run", " ")
    held = runs.groupBy("lang", "run").agg(F.lit(1).alias("one")).select("lang", "run", F.explode(F.array_distinct(F.arrays_zip(F.slice(w, F.lit(1), F.size(w) - 1).alias("prev"), F.slice(w, F.lit(2), F.size(w) - 1).alias("sym")))).alias("p"))
    odd = held.select("lang", "run", "p.prev", "p.sym").join(table, ["lang", "prev", "sym"], "left_anti").groupBy("lang", "run").agg(F.min(say).alias("fault"))
    return out.union(attach(rows.select("row", "lang", F.col("sym").alias("run")), odd, ["lang", "run"], "inner").select("row", "fault"))


def _group_faults(tok: DataFrame) -> DataFrame:
    code = tok.filter("lang <> 'python' AND NOT sym LIKE 'fault:%'")
    by_file = Window.partitionBy("row").orderBy("pos")
    d = code.withColumn("d", F.sum("delta").over(by_file))
    # an opener starts a group at its inner depth and stands for it at the depth around
    part = lambda depth, order, what, content: F.struct(depth.alias("depth"), F.lit(order).alias("o"), F.when(F.lit(what) == "start", F.col("pos")).alias("start"), F.when(F.lit(what) == "start", F.struct("role", F.substring("sym", 1, 1).alias("opener"))).alias("open"), F.when(F.lit(what) == "end", F.col("sym")).alias("close"), content.alias("content"))
    none = F.lit(None).cast("string")
    sym = F.when(F.col("sym") != "", F.col("sym"))
    parts = (
        F.when(F.col("delta") == 1, F.array(part(F.col("d"), 0, "start", none), part(F.col("d") - 1, 1, "in", sym)))
        .when(F.col("delta") == -1, F.array(part(F.col("d") + 1, 1, "end", none)))
        .otherwise(F.array(part(F.col("d"), 1, "in", sym)))
    )
    rows = d.select("row", "lang", "pos", F.inline(parts))
    by_depth = Window.partitionBy("row", "depth").orderBy("pos", "o")
    rows = rows.withColumn("group", F.coalesce(F.last("start", ignorenulls=True).over(by_depth), F.lit(-1)))
    groups = rows.groupBy("row", "lang", "depth", "group").agg(
        F.max("open").alias("open"), F.count("close").alias("n_close"), F.max("close").alias("close"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("content").isNotNull(), F.struct("pos", "content")))), lambda x: x["content"]), " ").alias("content"),
    )
    want = F.when(F.col("open.opener") == "(", ")").when(F.col("open.opener") == "[", "]").otherwise("}")
    top = F.col("group") == -1
    nesting = (
        F.when(F.col("depth") < 0, "bracket closed but not opened")
        .when(top & ((F.col("depth") > 0) | (F.col("n_close") > 0)), "bracket closed but not opened")
        .when(~top & (F.col("n_close") == 0), "bracket not closed")
        .when(~top & ((F.col("n_close") > 1) | (F.col("close") != want)), "bracket closed by another kind")
    )
    groups = cut(groups.withColumn("nesting", nesting))
    role = F.when(F.col("group") == -1, "top").otherwise(F.col("open.role"))
    runs = F.col("content")
    for one in ("n", "s"):  # tables of literals differ in length only
        runs = F.regexp_replace(runs, f"(?:\\b{one} , (?:N )?){{3,}}+", f"{one} , {one} , ")
    shaped = groups.filter("nesting IS NULL").select("row", "lang", role.alias("role"), runs.alias("content"))
    shapes = shaped.groupBy("lang", "role", "content").agg(F.lit(1).alias("one")).select("lang", "role", "content")
    bad = shapes.mapInArrow(_underived, "lang string, role string, content string")
    hits = attach(shaped, bad, ["lang", "role", "content"], "inner")
    return groups.filter("nesting IS NOT NULL").select("row", F.col("nesting").alias("fault")).union(hits.select("row", F.concat(F.lit("no production of "), "role").alias("fault")))


def _derived(lang: str, role: str, content: str) -> bool:
    tokens = content.split()
    if lang != "python":
        return productions.valid(lang, role, tokens)
    return python_grammar.is_case(tokens) if role == "case" else python_grammar.is_line(tokens)


def _underived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = [not _derived(*x) for x in zip(*(b.column(i).to_pylist() for i in range(3)))]
        yield b.filter(pa.array(keep, pa.bool_()))


def _line_faults(tok: DataFrame) -> DataFrame:
    """(row, fault) of Python files: blocks that do not fit together, and lines with a forbidden pair or no production."""
    lines = tok.filter("lang = 'python'").select("row", "pos", F.col("delta").alias("level"), F.col("sym").alias("content"))
    w, same = Window.partitionBy("row").orderBy("pos"), Window.partitionBy("row", "level").orderBy("pos")
    word = F.split("content", " ")
    x = lines.withColumn("word", word[0]).withColumn("first", F.when(F.col("word") == "async", F.coalesce(F.get(word, F.lit(1)), F.lit(""))).otherwise(F.col("word")))
    x = x.withColumn("opens", F.endswith("content", F.lit(" :"))).withColumn("group", (F.col("first") == "except") & (F.get(word, F.lit(1)) == "*"))
    c = F.col("first")
    before = lambda v, default: F.lag(v, 1, default).over(w)
    x = x.withColumns({"before": before("level", 0), "opened": before("opens", False), "head": F.when(before("opens", False), before("first", "")).otherwise(""), "after": F.lead("level", 1, -1).over(w), "next": F.lead("word", 1, "").over(w), "next2": F.lead("first", 1, "").over(w)})
    x = x.withColumn("begins", F.coalesce(F.col("level") > F.lag("level").over(w), F.lit(True)))
    until = same.rowsBetween(Window.unboundedPreceding, 0)
    clauses = ["else", "elif", "except", "finally"]
    inside = lambda v: F.when(F.col("begins"), "").otherwise(F.coalesce(v, F.lit("")))
    x = x.withColumns({
        "former": inside(F.lag("first").over(same)), "statement": inside(F.last(F.when(~c.isin(clauses), c), True).over(until)), "was_group": F.lag("group", 1, False).over(same),
        "parent": F.coalesce(F.last(F.when(F.col("begins"), F.col("head")), True).over(until), F.lit("")), "follows": F.when(~F.lead("begins", 1, True).over(same), F.lead("first").over(same)),
    })
    f = F.col("former")
    orphan = (
        (c == "else") & ~f.isin("if", "elif", "for", "while", "except")
        | (c == "elif") & ~f.isin("if", "elif")
        | (c == "except") & ~f.isin("try", "except")
        | (c == "finally") & ~(f.isin("try", "except") | (f == "else") & (F.col("statement") == "try"))
    )
    decorated = (F.col("after") == F.col("level")) & (F.col("next").isin("def", "class", "@") | (F.col("next") == "async") & (F.col("next2") == "def"))
    fault = (
        F.when(F.startswith("content", F.lit("fault:")), F.col("content"))
        .when(F.col("opens") & (F.col("after") <= F.col("level")), "expected an indented block")
        .when((F.col("level") > F.col("before")) & ~F.col("opened"), "unexpected indent")
        .when(orphan, "clause without a statement")
        .when((c == "except") & (f == "except") & (F.col("group") != F.col("was_group")), "except beside except*")
        .when((c == "try") & ~F.coalesce(F.col("follows").isin("except", "finally"), F.lit(False)), "try without except or finally")
        .when((c == "@") & ~decorated, "decorator without a definition")
    )
    x = x.select("row", F.when(F.col("parent") == "match", "case").otherwise("line").alias("role"), "content", fault.alias("fault"))
    x = cut(x)
    rows = x.filter("NOT content LIKE 'fault:%'").select("row", "role", "content")
    shapes = cut(rows.select("role", "content").distinct())
    # adjacent pairs of the distinct lines, each once
    t = F.split("content", " ")
    held = shapes.select("role", "content", F.explode(F.array_distinct(F.arrays_zip(F.slice(t, F.lit(1), F.size(t) - 1).alias("prev"), F.slice(t, F.lit(2), F.size(t) - 1).alias("sym")))).alias("p"))
    table = tok.sparkSession.createDataFrame([p[1:] for p in permitted() if p[0] == "python"], "prev string, sym string")
    odd = held.select("role", "content", "p.prev", "p.sym").join(F.broadcast(table), ["prev", "sym"], "left_anti").groupBy("role", "content").agg(F.min(F.concat(F.lit("misplaced "), "sym", F.lit(" after "), "prev")).alias("fault"))
    rest = shapes.join(odd, ["role", "content"], "left_anti").select(F.lit("python").alias("lang"), "role", "content")
    bad = odd.union(rest.mapInArrow(_underived, "lang string, role string, content string").select("role", "content", F.concat(F.lit("no production of "), "role")))
    return x.filter("fault IS NOT NULL").select("row", "fault").union(attach(rows, bad, ["role", "content"], "inner").select("row", "fault"))


def faults(files: DataFrame) -> DataFrame:
    """(file_id, lang, reason) of each file that its language's grammar does not derive, each once.

    Reads file_id, file_path, source_text. Recorded verdicts and language names are ignored. Null texts, null ids and
    extensions of other languages are not judged; an empty file is valid, but for Go, which needs a package clause;
    a repeated file_id is judged by all its rows.
    """
    every = cut(tokens(files.select("file_id", "file_path", "source_text")))
    tok = every.filter("pos >= 0")
    lexical = tok.filter("lang <> 'python' AND sym LIKE 'fault:%'").select("row", F.col("sym").alias("fault"))
    # what follows a lexical fault is not known, so nesting and productions of such a file are not judged
    whole = tok.filter("lang <> 'python'").join(lexical.select("row"), "row", "left_anti")
    found = lexical.union(_pair_faults(tok)).union(_group_faults(whole)).union(_line_faults(tok))
    heads = every.filter("pos = -1").select("row", F.col("prev").cast("long").alias("file_id"), "lang")
    return heads.join(found, "row").groupBy("file_id").agg(F.min("lang").alias("lang"), F.min("fault").alias("reason"))


def found(files: DataFrame) -> DataFrame:
    return faults(files).select("file_id")


def report(files: DataFrame) -> DataFrame:
    """Per repository and language: files, files that do not parse, and their rate."""
    named = files.withColumn("lang", language(F.col("file_path"))).filter("lang IS NOT NULL").select("file_id", "repo", "lang").dropDuplicates(["file_id"])
    bad = faults(files).select("file_id", F.lit(1).alias("bad"))
    return named.join(bad, "file_id", "left").groupBy("repo", "lang").agg(F.count("*").alias("n_files"), F.count("bad").alias("n_invalid"), (F.count("bad") / F.count("*")).alias("invalid_rate"))
