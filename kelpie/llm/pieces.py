"""Splitting of oversized items at natural boundaries.

One regular expression with bounded quantifiers walks the text: its alternatives are ordered by the strength of the
boundary they end at (blank line, line end, end of a clause, blank) and each consumes as many tokens as the limit
allows before it falls back to the next, down to a plain cut after the last token that fits. Every piece but the first
then gets the last tokens of the text before it as overlap, found by lookback from the end of the former piece.
All of it is array and regular-expression work inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 512, 32
_BLOCK = 64
TOKEN = r"(?:[A-Za-z0-9_]++|[^A-Za-z0-9_ \t\r\n])"
GAP = r"[ \t\r\n]*+"


def count_tokens(column: str):
    """The number of tokens: longest runs of word characters, or single other characters that are not blank."""
    return F.regexp_count(F.col(column), F.lit(TOKEN))


def pattern(limit: int, overlap: int) -> str:
    """Bounded alternatives, strongest boundary first; ``room`` new tokens fit beside the overlap."""
    room = limit - overlap
    unit = f"(?:{GAP}{TOKEN})"
    least = [max(overlap, 1, room * k // 4) for k in (2, 2, 3, 3)]
    ends = [r"(?=[ \t]*\r?\n[ \t]*\r?\n)", r"(?=[ \t]*\r?\n)", r"(?<=[.!?;:,\)\]\}])(?=[ \t])", r"(?=[ \t])"]
    bounded = [f"{unit}{{{lo},{room}}}{end}" for lo, end in zip(least, ends)]
    return f"{unit}{{1,{room}}}+{GAP}\\z|" + "|".join(bounded) + f"|{unit}{{1,{room}}}"


def split(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, id_col: str = "item_id", text_col: str = "snippet") -> DataFrame:
    """item_id, piece_no (from 0), piece, n_tokens, start (character offset of the piece in the text), n_overlap.

    Items up to the limit, blank and null ones included, give no rows. Every piece is an exact substring of its text
    of at most ``limit`` tokens; consecutive pieces share exactly ``overlap`` tokens; the new parts of the pieces cover
    all tokens of the text once. Repeated rows are split each on its own.
    """
    base = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    big = base.filter((F.length("text") > limit) & (count_tokens("text") > limit))  # a text has no more tokens than characters
    # explode(array(x)) keeps x from being evaluated again for each element of the transforms that read it
    own = big.select("item_id", F.explode(F.array(F.regexp_extract_all("text", F.lit(pattern(limit, overlap)), F.lit(0)))).alias("own"))
    head = F.lit(f"\\A(?:{GAP}{TOKEN}){{{overlap}}}")  # of the reversed piece: tokens read the same from either end
    back = F.transform("own", lambda s: F.reverse(F.regexp_substr(F.reverse(s), head))) if overlap else F.transform("own", lambda s: F.lit(""))
    rows = own.select("item_id", "own", F.explode(F.array(F.struct(back.alias("back"), F.transform("own", F.length).alias("size")))).alias("x")).select("item_id", "own", "x.*")
    # offsets in two levels: the length of all blocks before, then that of the pieces before in the block
    block = f"transform(sequence(0, (size(own) - 1) div {_BLOCK}), b -> aggregate(slice(size, b * {_BLOCK} + 1, {_BLOCK}), 0, (a, n) -> a + n))"
    base = "aggregate(blocks, array(0), (a, n) -> concat(a, array(element_at(a, -1) + n)))"
    rows = rows.withColumn("blocks", F.explode(F.array(F.expr(block)))).withColumn("base", F.explode(F.array(F.expr(base))))
    offset = f"base[i div {_BLOCK}] + aggregate(slice(size, i - i % {_BLOCK} + 1, i % {_BLOCK}), 0, (a, n) -> a + n)"
    lead = "IF(i = 0, '', coalesce(back[i - 1], ''))"
    parts = F.expr(f"transform(own, (s, i) -> struct(i AS piece_no, concat({lead}, s) AS piece, {offset} - length({lead}) AS start, IF(i = 0, 0, {overlap}) AS n_overlap))")
    out = rows.select("item_id", F.inline(parts))
    return out.withColumn("n_tokens", count_tokens("piece")).select("item_id", "piece_no", "piece", "n_tokens", "start", "n_overlap")


def oversized(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """item_id of each item that had to be cut, whatever recorded counters say; each once."""
    return split(items, limit, overlap).select("item_id").distinct()
