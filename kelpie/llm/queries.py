"""Queries of the training-data operators over the test tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kelpie.common import table
from kelpie.llm import cutoff, encode, groups, mixing, neighbours, origin, pieces, syntax, together


def _on(*names: str):
    """A query of (spark, sf_dir) from a function of the tables named."""

    def wrap(f: Callable[..., DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: f(*[table(spark, sf_dir, n) for n in names])

    return wrap


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": _on("file_ast")(syntax.found),
    "p1_rates": _on("file_ast")(syntax.report),
    "p2_found": _on("embedding_result")(pieces.oversized),
    "p2_pieces": _on("embedding_result")(pieces.split),
    "p3_found": _on("combined_submit")(groups.group),
    "p3_splits": _on("combined_submit")(groups.splits),
    "p3_batches": _on("combined_submit")(groups.batched),
    "p3_report": _on("combined_submit")(lambda t: groups.report(groups.splits(t))),
    "p4_found": _on("module_registry", "file_ast")(origin.not_by_hand),
    "p4_kinds": _on("module_registry", "file_ast")(lambda m, f: origin.judge(m, f).select("module_id", "repo", "kind")),
    "p5_found": _on("module_registry")(lambda m: neighbours.similar_pairs(m).select("module_id", "neighbor_id")),
    "p5_neighbours": _on("module_registry", "embedding_result")(neighbours.named),
    "p6_found": _on("pr_run_log")(lambda t: together.pairs(t, 10, 5.0).select("item_a", "item_b")),
    "p6_pairs": _on("pr_run_log")(together.pairs),
    "p8_ids": _on("documents")(encode.encode),
    "p9_mix": _on("documents", "mix_targets")(mixing.mix),
    "p9_likeliest": _on("documents", "mix_targets")(mixing.likeliest),
    "p9_report": _on("documents", "mix_targets")(mixing.report),
    "p10_found": _on("documents")(cutoff.found),
    "p10_rates": _on("documents")(cutoff.report),
}

_HELD = r"""
runs AS (SELECT DISTINCT run_id, item FROM (
  SELECT run_id, trim(regexp_replace(replace(trim(x, ' ' || chr(9) || chr(10) || chr(13)), '\', '/'), '^(\./+)+', ''), ' ' || chr(9)) AS item FROM (
    SELECT run_id, unnest(list_concat(coalesce(changed_files, []), coalesce(selected_tests, []))) AS x FROM pr_run_log WHERE run_id IS NOT NULL))
  WHERE item IS NOT NULL AND item <> ''),
total AS (SELECT count(DISTINCT run_id) AS n_runs FROM pr_run_log),
one AS (SELECT item, count(*) AS c FROM runs GROUP BY item),
two AS (SELECT a.item AS item_a, b.item AS item_b, count(*) AS n FROM runs a JOIN runs b ON a.run_id = b.run_id AND a.item < b.item GROUP BY ALL)
"""

_MISSING = "('', '-', '--', '.', '?', 'n/a', '#n/a', 'n.a.', 'na', 'nan', 'nil', 'none', 'null', 'missing', 'undefined', 'unknown', '(null)', '<null>', '(none)', '<na>', 'tbd')"
_BLANK = "' ' || chr(9) || chr(10) || chr(13)"


def _key(column: str, letter: str, separators: str) -> str:
    """Rows (r, k) of records and their keys of one kind."""
    v = f"lower(trim({column}, {_BLANK}))"
    words = f"list_filter(list_transform(regexp_split_to_array({v}, '{separators}'), lambda x: trim(x, {_BLANK})), lambda x: x <> '')"
    return f"SELECT record_id AS r, '{letter}' || array_to_string({words}, '/') AS k FROM combined_submit WHERE {v} NOT IN {_MISSING} AND len({words}) > 0"


SQL: dict[str, str] = {
    "p3_found": f"""WITH RECURSIVE e AS (SELECT DISTINCT * FROM ({_key('build', 'b', '[/_]')} UNION ALL {_key('test_name', 't', '[./:#_-]')})),
c(n, g) USING KEY (n) AS (SELECT n, min(r) FROM (SELECT k AS n, r FROM e) GROUP BY n
 UNION SELECT f.k, min(c.g) FROM c JOIN e ON e.k = c.n JOIN e f ON f.r = e.r JOIN recurring.c x ON x.n = f.k WHERE c.g < x.g GROUP BY f.k)
SELECT record_id, coalesce(g, record_id) AS group_id FROM combined_submit LEFT JOIN (SELECT r, min(g) AS g FROM e JOIN c ON c.n = e.k GROUP BY r) ON r = record_id""",
    "p2_found": r"SELECT item_id FROM embedding_result WHERE len(regexp_extract_all(coalesce(snippet, ''), '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]')) > 512",
    "p5_found": """
WITH good AS (SELECT module_id, CAST(embedding AS DOUBLE[]) AS v, updated_at FROM module_registry WHERE len(embedding) = 64 AND module_id IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
vec AS (SELECT module_id, arg_max(v, updated_at) AS v FROM good GROUP BY module_id),
near AS (SELECT a.module_id AS a, b.module_id AS b, list_cosine_similarity(a.v, b.v) AS c FROM vec a JOIN vec b ON a.module_id <> b.module_id),
top AS (SELECT a, b FROM near QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) <= 10 AND c >= 0.85)
SELECT DISTINCT least(a, b) AS module_id, greatest(a, b) AS neighbor_id FROM top""",
    "p6_found": f"WITH {_HELD} SELECT item_a, item_b FROM two, total, one x, one y WHERE x.item = item_a AND y.item = item_b AND n >= 10 AND n * n_runs >= 5 * x.c * y.c",
    "p6_pairs": f"""WITH {_HELD} SELECT item_a, item_b, n, x.c AS n_a, y.c AS n_b, n_runs, CAST(n * n_runs AS DOUBLE) / (x.c * y.c) AS lift,
  (n + 0.5::DOUBLE) * (n_runs - x.c - y.c + n + 0.5::DOUBLE) / ((x.c - n + 0.5::DOUBLE) * (y.c - n + 0.5::DOUBLE)) AS odds_ratio
FROM two, total, one x, one y WHERE x.item = item_a AND y.item = item_b""",
}
