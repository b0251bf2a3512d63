"""Outlines of Python files from their syntax trees, and what joins make of them: calls, spans, fingerprints, differences.

One pass of Python over Arrow batches yields the outline; everything after it is DataFrame expressions.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kelpie.common import lookup

# Nodes that add to the complexity of a function.
BRANCHES = (ast.If, ast.While, ast.For, ast.ExceptHandler, ast.With, ast.Assert, ast.comprehension, ast.BoolOp, ast.IfExp)
CALLS = 20  # calls listed of a function

_FUNCTION = "struct<name string, class_name string, start_line int, end_line int, complexity int, num_args int, has_decorator boolean, is_test boolean, calls array<string>, docstring string>"
_CLASS = "struct<name string, bases array<string>, start_line int, end_line int, num_methods int>"
_SCHEMA = f"file_id long, parsed boolean, num_lines int, functions array<{_FUNCTION}>, classes array<{_CLASS}>, imports array<struct<module string, level int>>, import_names array<string>, global_vars array<string>"


def _name(node: ast.AST) -> str:
    """The dotted name of a node; parts that are neither names nor constants are empty."""
    tail = []
    while isinstance(node, ast.Attribute):
        tail.append(node.attr)
        node = node.value
    head = node.id if isinstance(node, ast.Name) else str(node.value) if isinstance(node, ast.Constant) else ""
    return ".".join([head, *reversed(tail)])


def _function(node, owner: str | None) -> dict:
    inside = list(ast.walk(node))
    calls = [n for n in (_name(x.func) for x in inside if isinstance(x, ast.Call)) if n]
    marks = [_name(d) for d in node.decorator_list]
    test = node.name.startswith(("test_", "Test")) or any("pytest" in m or "unittest" in m for m in marks)
    return {
        "name": node.name, "class_name": owner, "start_line": node.lineno, "end_line": node.end_lineno, "complexity": 1 + sum(isinstance(x, BRANCHES) for x in inside),
        "num_args": len(node.args.args), "has_decorator": bool(marks), "is_test": test, "calls": calls[:CALLS], "docstring": ast.get_docstring(node),
    }


def outline_of(text: str) -> dict:
    """The outline of one source text; without a tree all lists are empty."""
    out: dict = {"parsed": False, "num_lines": text.count("\n") + 1, "functions": [], "classes": [], "imports": [], "import_names": [], "global_vars": []}
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return out
    todo: list[tuple[ast.AST, str | None]] = [(tree, None)]  # nodes in the order of the text, with the class around them
    while todo:
        node, owner = todo.pop()
        inner = owner
        if isinstance(node, ast.ClassDef):
            methods = sum(isinstance(x, ast.FunctionDef) for x in ast.walk(node))
            out["classes"].append({"name": node.name, "bases": [_name(b) for b in node.bases], "start_line": node.lineno, "end_line": node.end_lineno, "num_methods": methods})
            inner = node.name
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out["functions"].append(_function(node, owner))
        elif isinstance(node, ast.Import):
            out["imports"] += [{"module": a.name, "level": 0} for a in node.names]
            out["import_names"] += [a.name for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out["imports"].append({"module": node.module or "", "level": node.level or 0})
            out["import_names"] += [f"{node.module or ''}.{a.name}" for a in node.names]
        elif isinstance(node, ast.Assign) and owner is None:
            out["global_vars"] += [n for n in map(_name, node.targets) if n.isupper()]
        todo.extend((child, inner) for child in reversed(list(ast.iter_child_nodes(node))))
    out["parsed"] = True
    return out


def _outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    strings = pa.list_(pa.string())
    f = [("name", pa.string()), ("class_name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("complexity", pa.int32()), ("num_args", pa.int32()), ("has_decorator", pa.bool_()), ("is_test", pa.bool_()), ("calls", strings), ("docstring", pa.string())]
    c = [("name", pa.string()), ("bases", strings), ("start_line", pa.int32()), ("end_line", pa.int32()), ("num_methods", pa.int32())]
    kinds = {"parsed": pa.bool_(), "num_lines": pa.int32(), "functions": pa.list_(pa.struct(f)), "classes": pa.list_(pa.struct(c)), "imports": pa.list_(pa.struct([("module", pa.string()), ("level", pa.int32())])), "import_names": strings, "global_vars": strings}
    for b in batches:
        rows = [outline_of(t or "") for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], t) for k, t in kinds.items())], names=["file_id", *kinds])


def outlines(files: DataFrame) -> DataFrame:
    """file_id, parsed, num_lines, functions, classes, imports, import_names, global_vars of each Python file.

    ``imports`` are (module, level) as written, ``import_names`` dotted names; functions include methods and nested ones.
    Null texts count as empty; a text without a syntax tree has ``parsed`` false and empty lists.
    """
    py = files.filter(F.endswith(F.lower("file_path"), F.lit(".py")) & F.col("file_id").isNotNull())
    return py.select(F.col("file_id").cast("long").alias("file_id"), F.regexp_replace("source_text", "^\ufeff", "").alias("source_text")).mapInArrow(_outlines, _SCHEMA)


def functions(files: DataFrame) -> DataFrame:
    """One row per function of each Python file."""
    return outlines(files).select("file_id", F.inline("functions"))


def value_scores(files: DataFrame) -> DataFrame:
    """file_id, by_complexity, by_counts: two scores of a Python file's weight.

    By complexity: half the sum of complexities (1 without functions) + 0.3 imports + 0.2 ln(lines + 1); by counts: 0.4
    functions and methods + 0.3 imports + 0.2 ln(lines + 1).
    """
    o = outlines(files)
    work = F.aggregate("functions", F.lit(0), lambda a, f: a + f["complexity"])
    size = 0.3 * F.size("import_names") + 0.2 * F.ln(F.col("num_lines") + 1.0)
    return o.select("file_id", (0.5 * F.greatest(work, F.lit(1)) + size).alias("by_complexity"), (0.4 * F.size("functions") + size).alias("by_counts"))


def fingerprints(files: DataFrame) -> DataFrame:
    """file_id, fingerprint: SHA-256 over the sorted names of classes, functions, imports and methods, as compact JSON.

    Files that differ in layout, comments or bodies only share a fingerprint. Non-ASCII names stay as they are.
    """
    o = outlines(files)
    names = lambda keep, text: F.sort_array(F.transform(F.filter("functions", keep), text))
    doc = F.struct(
        F.sort_array("classes.name").alias("classes"), names(lambda f: f["class_name"].isNull(), lambda f: f["name"]).alias("functions"),
        F.sort_array("import_names").alias("imports"), names(lambda f: f["class_name"].isNotNull(), lambda f: F.concat_ws(".", f["class_name"], f["name"])).alias("methods"),
    )
    return o.select("file_id", F.sha2(F.to_json(doc), 256).alias("fingerprint"))


def snippets(files: DataFrame) -> DataFrame:
    """file_id, identifier (file name, #, class and function), snippet: the source lines of every function."""
    f = functions(files).select("file_id", "name", "class_name", "start_line", "end_line")
    text = F.split(F.replace(F.replace(F.col("source_text"), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), "\n")
    src = files.select(F.col("file_id").cast("long").alias("file_id"), F.element_at(F.split("file_path", "/"), -1).alias("file_name"), text.alias("lines"))
    j = f.join(src, "file_id")
    cut = F.array_join(F.slice("lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    return j.select("file_id", F.concat("file_name", F.lit("#"), F.coalesce(F.concat("class_name", F.lit(".")), F.lit("")), "name").alias("identifier"), cut.alias("snippet"))


def calls(files: DataFrame) -> DataFrame:
    """(repo, caller, callee): calls resolved by their last part to all functions of that name in the repo, as Class.name.

    Functions of a name are gathered per name, never paired with each other; names called everywhere are joined with salt.
    """
    f = functions(files).join(files.select(F.col("file_id").cast("long").alias("file_id"), "repo"), "file_id")
    full = F.concat_ws(".", "class_name", "name")
    index = f.select("repo", F.col("name").alias("short"), full.alias("callee")).groupBy("repo", "short").agg(F.collect_set("callee").alias("callees"))
    c = f.select("repo", full.alias("caller"), F.explode("calls").alias("call")).select("repo", "caller", F.element_at(F.split("call", r"\."), -1).alias("short")).distinct()
    return lookup(c, index, ["repo", "short"], "inner").select("repo", "caller", F.explode("callees").alias("callee")).distinct()


def differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """What changed between two versions of files, by ``file_id`` of ``outlines``: arrays of names, and whether it means anything.

    Functions are matched by class and name, and changed if complexity or arguments differ; of several of one name the
    last counts. A file of one version only has everything added or removed.
    """
    def side(d: DataFrame, tag: str) -> DataFrame:
        f = F.map_from_entries(F.array_distinct(F.transform("functions", lambda x: F.struct(F.concat_ws(".", x["class_name"], x["name"]).alias("k"), F.element_at(F.filter("functions", lambda y: F.concat_ws(".", y["class_name"], y["name"]) == F.concat_ws(".", x["class_name"], x["name"])), -1).alias("v")))))
        return d.select("file_id", f.alias(f"f_{tag}"), F.array_distinct("classes.name").alias(f"c_{tag}"), F.array_distinct("import_names").alias(f"i_{tag}"))

    j = side(old, "o").join(side(new, "n"), "file_id", "full")
    empty = F.array().cast("array<string>")
    keys = lambda t: F.coalesce(F.map_keys(f"f_{t}"), empty)
    less = lambda a, b: F.sort_array(F.array_except(a, b))
    some = lambda c: F.coalesce(F.col(c), empty)
    differ = lambda k: (F.col("f_o")[k]["complexity"] != F.col("f_n")[k]["complexity"]) | (F.col("f_o")[k]["num_args"] != F.col("f_n")[k]["num_args"])
    out = j.select(
        "file_id", less(keys("n"), keys("o")).alias("added_functions"), less(keys("o"), keys("n")).alias("removed_functions"),
        F.sort_array(F.filter(F.array_intersect(keys("o"), keys("n")), differ)).alias("changed_functions"),
        less(some("c_n"), some("c_o")).alias("added_classes"), less(some("c_o"), some("c_n")).alias("removed_classes"),
        less(some("i_n"), some("i_o")).alias("added_imports"), less(some("i_o"), some("i_n")).alias("removed_imports"),
    )
    what = [c for c in out.columns if c != "file_id"]
    n = sum((F.size(c) for c in what), F.lit(0))
    said = F.concat_ws("; ", *[F.when(F.size(c) > 0, F.concat(F.lit(c.replace("_", " ") + ": "), F.array_join(c, ", "))) for c in what])
    return out.withColumn("is_meaningful", n > 0).withColumn("summary", F.when(n > 0, said).otherwise("no structural changes"))


def successive(files: DataFrame) -> DataFrame:
    """``differences`` of every Python file from the one before it in its repo, by id: a stand-in where versions are not kept."""
    o = outlines(files).drop("parsed", "num_lines", "global_vars")
    before = files.select(F.col("file_id").cast("long").alias("file_id"), F.lag("file_id").over(Window.partitionBy("repo").orderBy("file_id")).alias("old_id"))
    old = o.join(before.filter("old_id IS NOT NULL").select(F.col("old_id").alias("file_id"), F.col("file_id").alias("new_id")), "file_id").drop("file_id").withColumnRenamed("new_id", "file_id")
    return differences(old, o)
