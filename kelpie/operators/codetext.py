"""Text and source structure: paths, regular-expression extraction, diffs, keyword impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kelpie.functions.paths import DETECTED_EXTENSIONS, DIFF_EXTENSIONS, extension, language, one_line_end, stem

# Patterns of imports, functions and classes by language, and how many of each are listed.
STRUCTURE = {
    "python": {"imports": r"^(?:import|from)\s+([\w.]+)", "functions": r"^def\s+(\w+)\s*\(", "classes": r"^class\s+(\w+)\s*[:(]"},
    "javascript": {
        "imports": r"""(?:import|require)\s*[({'"](.+?)["')}]""",
        "functions": r"(?:function|const|let|var)\s+(\w+)\s*(?:=\s*(?:async\s+)?(?:function|\()|\()",
        "classes": r"class\s+(\w+)",
    },
    "java": {"imports": r"^import\s+([\w.]+);", "functions": r"(?:public|private|protected)\s+\w+\s+(\w+)\s*\(", "classes": r"class\s+(\w+)"},
}
TEST_FUNCTIONS = {"python": "^test_", "javascript": "(?i)test|spec|it|describe", "java": "^test"}
LISTED = {"imports": 50, "functions": 100, "classes": 30, "test_functions": 50}

# Patterns of an outline of Java without a parser.
JAVA_IMPORT, JAVA_CLASS = r"import\s+([\w.]+);", r"class\s+(\w+)"
JAVA_METHOD = r"(?:public|private|protected|static|final)[\s\w<>\[\]]+\s+(\w+)\s*\("

# Words that raise the risk of a change, and patterns of what it touches.
RISK_WORDS = ["migration", "schema", "alter table", "drop column", "rename column", "kafka", "message", "event", "contract", "interface", "api"]
KAFKA = [r"(?i)kafka[_\s.]*(topic|consumer|producer|stream)", r"(?i)KafkaProducer|KafkaConsumer|@KafkaListener", r"(?i)send\s*\(.*topic|subscribe\s*\(.*topic"]
TOPIC = r"""["'`]([a-z][a-z0-9._\-]{2,40})["'`]"""
TABLES = [r"(?i)TABLE\s+(\w+)", r"(?i)FROM\s+(\w+)", r"(?i)INSERT\s+INTO\s+(\w+)", r"(?i)UPDATE\s+(\w+)\s+SET"]
CONTRACT = r"@RestController|@RequestMapping|@GetMapping|@PostMapping|FastAPI|flask\.route|@app\.route"
MIGRATION = r"(?i)migration|alembic|flyway|liquibase|alter\s+table|add\s+column"
TAGS = ["auth", "payment", "user", "order", "cart", "api", "db", "kafka", "email", "notification"]


def file_facts(files: DataFrame) -> DataFrame:
    """Name, stem, extension, language by extension, lines and content hash of each file."""
    name = F.element_at(F.split("file_path", "/"), -1)
    t = F.coalesce("source_text", F.lit(""))
    lines = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1
    return files.select("file_id", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), extension("file_path").alias("extension"), language("file_path").alias("language"), lines.alias("n_lines"), F.sha2(t, 256).alias("sha256"))


def structure(files: DataFrame) -> DataFrame:
    """Imports, functions, classes and test functions of each file by the patterns of its language, in order of the text.

    Lists are cut at ``LISTED`` entries, counts are not. Other languages and null texts have empty lists. A file is a test
    file if its name holds test or spec, or it has a test function. Line ends of all kinds count as one.
    """
    t = one_line_end(F.coalesce("source_text", F.lit("")))
    lang = language("file_path")
    lang = F.when(lang == "typescript", "javascript").otherwise(lang)
    rows = files.select("file_id", "file_path", lang.alias("lang"), t.alias("t"))

    def found(what: str) -> Column:
        out = F.array().cast("array<string>")
        for name, pats in STRUCTURE.items():
            out = F.when(F.col("lang") == name, F.regexp_extract_all("t", F.lit("(?md)" + pats[what]), F.lit(1))).otherwise(out)
        return out

    rows = rows.select("file_id", "file_path", "lang", "t", *[found(w).alias(w) for w in ("imports", "functions", "classes")])
    tests = F.array().cast("array<string>")
    for name, pat in TEST_FUNCTIONS.items():
        tests = F.when(F.col("lang") == name, F.expr(f"filter(functions, f -> f RLIKE '{pat}')")).otherwise(tests)
    rows = rows.withColumn("test_functions", tests)
    name = F.lower(F.element_at(F.split("file_path", "/"), -1))
    lines = F.length("t") - F.length(F.replace("t", F.lit("\n"), F.lit(""))) + 1
    is_test = name.contains("test") | name.contains("spec") | (F.size("test_functions") > 0)
    return rows.select(
        "file_id", lines.alias("num_lines"), *[F.size(w).alias(f"num_{w}") for w in ("imports", "functions", "classes")],
        *[F.slice(w, 1, n).alias(w) for w, n in LISTED.items()], F.coalesce(is_test, F.lit(False)).alias("is_test_file"),
    )


def structure_scores(files: DataFrame) -> DataFrame:
    """file_id, score: 0.4 functions + 0.3 imports + 0.2 ln(lines + 1) + 0.1 classes by ``structure``."""
    s = structure(files)
    return s.select("file_id", (0.4 * F.col("num_functions") + 0.3 * F.col("num_imports") + 0.2 * F.ln(F.col("num_lines") + 1.0) + 0.1 * F.col("num_classes")).alias("score"))


def java_outline(files: DataFrame) -> DataFrame:
    """file_id, imports, classes, methods of each Java file, by patterns; null texts have none."""
    java = files.filter(extension("file_path") == "java")
    t = one_line_end(F.coalesce("source_text", F.lit("")))
    get = lambda p: F.regexp_extract_all(t, F.lit(p), F.lit(1))
    return java.select("file_id", get(JAVA_IMPORT).alias("imports"), get(JAVA_CLASS).alias("classes"), get(JAVA_METHOD).alias("methods"))


def diff_lines(diffs: DataFrame, id_col: str = "id", text_col: str = "diff") -> DataFrame:
    """One row per added, removed or context line of unified diffs: id, file_path, op, hunk, line (new side), text.

    ``+++ b/path`` names the file; ``@@`` starts a hunk. Lines are exploded with their position and running windows over one
    diff carry the file, the hunk and the line number; deleted files (``+++ /dev/null``) have no path and are left out.
    """
    rows = diffs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), "\r?\n")).alias("pos", "raw"))
    w = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.startswith("raw", F.lit("+++ ")), F.regexp_extract("raw", r"^\+\+\+ (?:b/)?(.*?)\s*$", 1))
    hunk = F.regexp_extract("raw", r"^@@ -\d+(?:,\d+)? \+(\d+)", 1)
    r = rows.withColumn("file_path", F.last(head, True).over(w)).withColumn("start", F.when(hunk != "", hunk.cast("int")))
    r = r.withColumn("hunk", F.count("start").over(w)).withColumn("first", F.last("start", True).over(w))
    op = F.when(F.col("start").isNotNull() | F.col("raw").rlike(r"^(?:\+\+\+ |--- |diff |index |\\)"), None).when(F.substring("raw", 1, 1).isin("+", "-"), F.substring("raw", 1, 1)).when(F.startswith("raw", F.lit(" ")), F.lit(" "))
    r = r.withColumn("op", op).filter("op IS NOT NULL AND hunk > 0 AND coalesce(file_path, '') <> '/dev/null'")
    in_hunk = Window.partitionBy("id", "hunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    line = F.col("first") + F.sum(F.when(F.col("op") != "-", 1).otherwise(0)).over(in_hunk) - 1
    return r.select("id", "file_path", "op", "hunk", F.when(F.col("op") != "-", line).alias("line"), F.expr("substring(raw, 2)").alias("text"))


def diff_files(lines: DataFrame) -> DataFrame:
    """Added, removed and net lines per file of ``diff_lines``."""
    plus, minus = F.count_if(F.col("op") == "+"), F.count_if(F.col("op") == "-")
    return lines.groupBy("id", "file_path").agg(plus.alias("n_added"), minus.alias("n_removed"), (plus - minus).alias("n_net"))


def changed_files(diffs: DataFrame, id_col: str = "id", text_col: str = "diff", added_only: bool = False) -> DataFrame:
    """One row per file section of unified diffs: id, section, file_path, language, n_changed, added_code, removed_code.

    A section begins at ``+++ b/path`` and ends at the next such line or at ``diff --git``; lines count whether or not a
    hunk header precedes them. Paths of other languages are left out: without ``added_only`` the seven of
    ``DIFF_EXTENSIONS`` are kept; with it the twelve of ``DETECTED_EXTENSIONS``, and sections without an added line are
    dropped. A diff is taken apart inside its row; null and empty diffs give no rows.
    """
    names = DETECTED_EXTENSIONS if added_only else DIFF_EXTENSIONS
    rows = diffs.select(F.col(id_col).alias("id"), F.posexplode(F.filter(F.split(F.concat(F.lit("\n"), one_line_end(F.col(text_col))), r"\n(?=\+\+\+ b/|diff --git)"), lambda x: F.startswith(x, F.lit("+++ b/")))).alias("section", "part"))
    lines = F.split("part", "\n")
    rows = rows.select("id", "section", F.trim(F.substr(lines[0], F.lit(7))).alias("file_path"), F.slice(lines, F.lit(2), F.size(lines)).alias("l"))
    take = lambda c: F.transform(F.filter("l", lambda x: F.startswith(x, F.lit(c)) & ~F.startswith(x, F.lit(c * 3))), lambda x: F.substr(x, F.lit(2)))
    rows = rows.select("id", "section", "file_path", language("file_path", names).alias("language"), take("+").alias("a"), take("-").alias("r")).filter("language <> 'unknown'")
    if added_only:
        rows = rows.filter(F.size("a") > 0)
    return rows.select("id", "section", "file_path", "language", (F.size("a") + F.size("r")).alias("n_changed"), F.array_join("a", "\n").alias("added_code"), F.array_join("r", "\n").alias("removed_code"))


def diff_summary(changed: DataFrame) -> DataFrame:
    """Per diff of ``changed_files``: files, languages, and lines changed."""
    return changed.groupBy("id").agg(F.countDistinct("file_path").alias("n_files"), F.sort_array(F.collect_set("language")).alias("languages"), F.sum("n_changed").alias("lines_changed"))


def file_slice(lines: DataFrame, file_path: str) -> DataFrame:
    """The lines of one file of ``diff_lines``."""
    return lines.filter(F.col("file_path") == file_path)


def added_text(diffs: DataFrame, id_col: str = "id", text_col: str = "diff") -> DataFrame:
    """id, text: the added lines of each diff, or the whole diff where they are blank; null diffs give an empty text."""
    d = F.coalesce(F.col(text_col), F.lit(""))
    plus = F.filter(F.split(d, "\n"), lambda x: F.startswith(x, F.lit("+")) & ~F.startswith(x, F.lit("+++")))
    text = F.array_join(F.transform(plus, lambda x: F.substr(x, F.lit(2))), "\n")
    return diffs.select(F.col(id_col).alias("id"), F.when(F.trim(text, F.lit(" \t\r\n")) == "", d).otherwise(text).alias("text"))


def touched(functions: DataFrame, lines: DataFrame) -> DataFrame:
    """Functions (file_path, name, start_line, end_line) whose span holds an added line: an interval join by file."""
    added = lines.filter("op = '+'").select("file_path", "line")
    return functions.join(added, (functions.file_path == added.file_path) & added.line.between(F.col("start_line"), F.col("end_line")), "left_semi")


def embedded_diffs(documents: DataFrame) -> DataFrame:
    """(id, diff): every fenced diff of a text, with id = (doc_id, block), block from 0: fences named diff, and others that begin like a diff."""
    fences = F.regexp_extract_all("text", F.lit(r"(?s)(?:```diff|(?m:^)[ \t]*```[^\r\n`]*)\r?\n.*?```"), F.lit(0))
    parts = F.transform(fences, lambda x: F.struct(F.regexp_extract(x, r"(?s)^[ \t]*```([^\r\n]*)\r?\n(.*?)```$", 1).alias("named"), F.regexp_extract(x, r"(?s)^[^\n]*\n(.*?)```$", 1).alias("diff")))
    kept = F.filter(parts, lambda x: (x["diff"] != "") & ((x["named"] == "diff") | x["diff"].rlike(r"^(?:---|@@|\+\+\+|diff )")))
    rows = documents.select("doc_id", F.posexplode(kept).alias("block", "part"))
    return rows.select(F.struct("doc_id", "block").alias("id"), "part.diff")


def impact(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What a diff or text touches, by words: id, topics, tables, api_contract, schema_migration, n_words, level.

    Topics are the first five quoted names of a text that mentions a message queue, tables up to eight names behind SQL
    words, each once, in order. The level counts risk words: three or more HIGH, one or more MEDIUM, else LOW. A null text
    touches nothing.
    """
    rows = texts.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    queue = F.lit(False)
    for p in KAFKA:
        queue = queue | F.col("t").rlike(p)
    topics = F.when(queue, F.array_distinct(F.slice(F.regexp_extract_all("t", F.lit(TOPIC), F.lit(1)), 1, 5))).otherwise(F.array().cast("array<string>"))
    named = F.concat(*[F.regexp_extract_all("t", F.lit(p), F.lit(1)) for p in TABLES])
    tables = F.slice(F.array_distinct(F.filter(named, lambda x: F.length(x) > 2)), 1, 8)
    low = F.lower("t")
    n = sum((F.contains(low, F.lit(w)).cast("int") for w in RISK_WORDS), F.lit(0))
    out = rows.select(id_col, topics.alias("topics"), tables.alias("tables"), F.col("t").rlike(CONTRACT).alias("api_contract"), F.col("t").rlike(MIGRATION).alias("schema_migration"), n.alias("n_words"))
    return out.withColumn("level", F.when(F.col("n_words") >= 3, "HIGH").when(F.col("n_words") >= 1, "MEDIUM").otherwise("LOW"))


def tags(paths: DataFrame, by: str = "repo") -> DataFrame:
    """``by``, tags: the sorted tags whose word is found in the stem of a changed file."""
    low = F.lower(stem("file_path"))
    hit = F.explode(F.filter(F.array(*[F.lit(t) for t in TAGS]), lambda t: F.contains(low, t)))
    return paths.select(by, hit.alias("tag")).groupBy(by).agg(F.sort_array(F.collect_set("tag")).alias("tags"))


def summary(paths: DataFrame, levels: DataFrame, by: str = "repo") -> DataFrame:
    """``by``, summary: how many files changed, the first three names, and the level of ``levels`` (``by``, level)."""
    name = F.element_at(F.split("file_path", "/"), -1)
    g = paths.groupBy(by).agg(F.count("*").alias("n"), F.slice(F.sort_array(F.collect_set(F.struct("file_path", name.alias("name")))), 1, 3).alias("first"))
    j = g.join(levels, by, "left")
    return j.select(by, F.format_string("PR modifies %d module(s): %s. Risk level: %s.", "n", F.array_join("first.name", ", "), F.coalesce("level", F.lit("LOW"))).alias("summary"))


ANSWER = "struct<summary string, kafka_topics_affected array<string>, shared_db_tables_affected array<string>, downstream_services_affected array<string>, api_contracts_changed boolean, schema_migrations_present boolean, risk_level string, risk_reason string, recommended_test_tags array<string>, safe_to_prune array<string>>"
# How many entries or characters of an answer's fields are kept.
ANSWER_LISTS = {"kafka_topics_affected": 10, "shared_db_tables_affected": 15, "downstream_services_affected": 10, "recommended_test_tags": 10, "safe_to_prune": 20}
ANSWER_TEXTS = {"summary": 500, "risk_reason": 200}


def answers(raw: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Answers of a language model read as JSON: id and the fields of ``ANSWER``; rows without a JSON object are left out.

    A code fence around the answer is dropped, the first to the last brace is read. Unknown risk levels become MEDIUM, missing
    lists empty, missing flags false; lists and texts are cut at the sizes above.
    """
    body = F.trim(F.regexp_replace(F.trim(F.col(text_col), F.lit(" \t\r\n")), r"^```(?:json)?\n?|`+$", ""))
    got = raw.select(F.col(id_col), F.from_json(F.regexp_extract(body, r"(?s)\{.*\}", 0), ANSWER).alias("a")).filter("a IS NOT NULL")
    some = got.filter("size(filter(map_values(from_json(to_json(a), 'map<string,string>')), x -> x IS NOT NULL)) > 0")
    risk = F.upper(F.coalesce("a.risk_level", F.lit("MEDIUM")))
    lists = [F.slice(F.coalesce(f"a.{k}", F.array().cast("array<string>")), 1, n).alias(k) for k, n in ANSWER_LISTS.items()]
    texts = [F.substring(F.coalesce(f"a.{k}", F.lit("")), 1, n).alias(k) for k, n in ANSWER_TEXTS.items()]
    flags = [F.coalesce(f"a.{k}", F.lit(False)).alias(k) for k in ("api_contracts_changed", "schema_migrations_present")]
    return some.select(id_col, *texts, *lists, *flags, F.when(risk.isin("LOW", "MEDIUM", "HIGH", "CRITICAL"), risk).otherwise("MEDIUM").alias("risk_level"))
