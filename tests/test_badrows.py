import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from kelpie.common import table
from kelpie.operators import badrows

SCHEMA = "raw_id long, source_file string, line_no int, raw_line string, sep string, names string, reason string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def rfc(line, sep):
    """Fields of one RFC 4180 record, or None."""
    out, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == '"':
            i, b = i + 1, ""
            while True:
                if i >= n:
                    return None
                if line[i] == '"':
                    if line[i + 1 : i + 2] == '"':
                        b, i = b + '"', i + 2
                        continue
                    i += 1
                    break
                b, i = b + line[i], i + 1
            out.append(b)
            if i < n and line[i] != sep:
                return None
        else:
            j = i
            while j < n and line[j] != sep:
                if line[j] in '"\r\n':
                    return None
                j += 1
            out.append(line[i:j])
            i = j
        if i >= n:
            return out
        i += 1


def loads(header, line):
    sep = next(s for s in ",|\t" if s in header)
    f = rfc(line, sep)
    if f is None or len(f) != 4:
        return False
    d = dict(zip(header.split(sep), [x.strip(" \t\r\n") for x in f]))
    return bool(
        re.fullmatch(r"((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?)?", d["test_duration"], re.A)
        and re.fullmatch(r"[0-9a-fA-F]{10}([/_][0-9a-fA-F]{10})*", d["build"])
        and d["test_name"]
        and d["test_result"].isascii()
        and d["test_result"].upper() in ("PASSED", "FAILED", "SKIPPED")
    )


def test_against_a_parser(spark, sf):
    lines = table(spark, sf, "presubmit_raw")
    rows = lines.collect()
    head = {r.source_file: r.raw_line for r in rows if r.line_no == 1}
    want = {r.raw_id for r in rows if r.line_no > 1 and not loads(head[r.source_file], r.raw_line)}
    assert {r.raw_id for r in badrows.found(lines).collect()} == want
    loaded = badrows.load(lines).collect()
    assert {r.raw_id for r in loaded if r.reasons} == want
    assert len(loaded) == sum(r.line_no > 1 for r in rows)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet='a",\n1\u0001\u0002', max_size=12), min_size=20, max_size=60))
def test_structure_property(spark, texts):
    rows = [(0, "f", 1, "test_duration,build,test_name,test_result")] + [(i + 1, "f", i + 2, t) for i, t in enumerate(texts)]
    got = {r.raw_id: r.fault is None for r in badrows.split_lines(frame(spark, rows).select("raw_id", "source_file", "line_no", "raw_line")).collect()}
    for i, t in enumerate(texts):
        f = rfc(t, ",")
        assert got[i + 1] == (f is not None and len(f) == 4), t


def test_edges(spark):
    h = "test_result|test_name|build|test_duration"
    rows = [
        (1, "a", 1, h), (2, "a", 2, 'passed|"x|y"|0123456789|1e3'), (3, "a", 3, None), (4, "a", 4, ""), (5, "b", 2, "1,2,3,4"), (6, "a", 5, "PASSED|t|0123456789| "),
        (7, "a", 6, "PASSED|" + "t" * 200_000 + "|0123456789|"), (8, "a", 7, "PАSSED|t|0123456789|1"), (9, None, 2, "x"), (2, "a", 2, 'passed|"x|y"|0123456789|1e3'),
    ]
    got = {r.raw_id: r for r in badrows.load(frame(spark, rows)).collect()}
    assert got[2].test_name == "x|y" and got[2].test_duration == 1000.0 and got[2].test_result == "PASSED" and got[2].reasons == []
    assert got[6].test_duration is None and got[6].reasons == [] and got[7].reasons == []
    assert got[3].reasons == ["line is null"] and got[5].reasons == ["file has no usable header"] and got[8].reasons
    assert {r.raw_id for r in badrows.found(frame(spark, rows)).collect()} == {3, 4, 5, 8, 9}
    empty = frame(spark, [])
    assert badrows.found(empty).count() == 0 and badrows.load(empty).count() == 0
