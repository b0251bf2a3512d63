"""Lexers for Python, Java, JavaScript and Go, as far as syntax checks need them.

A token is (symbol, delta, role): symbols are keywords and operators as spelled, ``i`` identifier, ``n`` number, ``s``
string or other literal, ``N`` line end (JavaScript), and openers. ``delta`` is +1 for an opener, -1 for a closer;
``role`` says how the content of a group has to be read. A symbol that begins with ``fault:`` ends the tokens of a file that cannot be lexed.
"""

from __future__ import annotations

import re
import unicodedata

# Reserved words and operators of the languages.
JAVA_WORDS = set(
    "abstract assert boolean break byte case catch char class continue default do double else enum extends final finally float for if implements import "
    "instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws "
    "transient try void volatile while true false null".split()
)
JS_WORDS = set(
    "await async break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof let new "
    "null of return static super switch this throw true false try typeof var void while yield".split()
)
GO_WORDS = set("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
JAVA_OPS = ">>>= <<= >>= >>> ... -> :: ++ -- && || == != <= >= += -= *= /= &= |= ^= %= << + - * / & | ^ % ! ~ ? : = < > . , ; @".split()
JS_OPS = ">>>= **= &&= ||= ??= === !== <<= >>= >>> ... => ?. ?? ** ++ -- && || == != <= >= += -= *= /= &= |= ^= %= << >> + - * / & | ^ % ! ~ ? : = < > . , ; # @".split()
GO_OPS = "<<= >>= &^= ... && || <- ++ -- == != <= >= := += -= *= /= %= &= |= ^= << >> &^ + - * / % & | ^ < > = ! ( ) . , ; : ~".split()


def _ops(ops: list[str]) -> str:
    return "|".join(re.escape(o) for o in sorted(set(ops) - {"(", ")"}, key=len, reverse=True))


_NUM = r"(?:0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)"
_SKIP = r"(?P<skip>[ \t\f\v ﻿]+|//[^\r\n]*)|(?P<note>/\*[\s\S]*?\*/)|(?P<nl>\r\n|\n|\r)"
_QUOTED = r'"(?:[^"\\\r\n]|\\[\s\S])*"'
_CHAR = r"'(?:[^'\\\r\n]|\\[\s\S])+'"
_TAIL = r"|(?P<i>[^\W\d][\w$]*|\$[\w$]*)|(?P<open>[(\[{])|(?P<close>[)\]}])"
_JAVA = re.compile(_SKIP + r'|(?P<s>"""[ \t\f]*(?:\r\n|\n|\r)(?:[^"\\]|\\[\s\S]|"(?!""))*"""|' + _QUOTED + "|" + _CHAR + rf")|(?P<n>{_NUM}[lLfFdD]?)" + _TAIL + f"|(?P<op>{_ops(JAVA_OPS)})")
_GO = re.compile(_SKIP + r"|(?P<s>`[^`]*`|" + _QUOTED + "|" + _CHAR + rf")|(?P<n>{_NUM}i?)" + _TAIL + f"|(?P<op>{_ops(GO_OPS)})")
_JS = re.compile(_SKIP + "|(?P<s>" + _QUOTED + r"|'(?:[^'\\\r\n]|\\[\s\S])*')" + rf"|(?P<n>{_NUM}n?)" + _TAIL + f"|(?P<tick>`)|(?P<op>{_ops(JS_OPS)})")
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/[A-Za-z]*")
_CHUNK = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_CLOSER = {"(": ")", "[": "]", "{": "}"}
_JS_OPERAND_END = {"i", "n", "s", ")", "]", "this", "super", "null", "true", "false", "++", "--"}
_GO_ENDS = {"i", "n", "s", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"}

Token = tuple[str, int, str]


def _role(lang: str, opener: str, stmt: list[str], prev: str, outer: str) -> str:
    """How to read a group, from the tokens of the statement it stands in (groups as their openers)."""
    head = stmt[0] if stmt else ""
    if opener == "[":
        return "index"
    if opener == "(":
        if prev in ("for", "catch") and lang != "go":
            return prev
        if prev in ("if", "while", "switch", "synchronized", "with"):
            return "cond"
        if prev == "try" and lang == "java":
            return "for"
        if lang == "java" and outer == "class" and "=" not in stmt and "->" not in stmt and not (len(stmt) > 1 and stmt[-2] == "@"):
            return "params"
        if prev == "function" or lang == "js" and len(stmt) > 1 and (stmt[-2:-1] == ["function"] or stmt[-2:-1] == ["*"] and "function" in stmt[-3:-2]):
            return "params"
        if lang == "go" and (prev in ("import", "const", "var", "type")):
            return "decls" + prev
        if lang == "go" and "func" in stmt and not any(x.startswith("{") for x in stmt[len(stmt) - stmt[::-1].index("func") :]) and stmt[len(stmt) - stmt[::-1].index("func") :].count("(") < 3:
            return "params"
        return "args"
    if lang == "java":
        # the body of an enum constant
        if outer == "enum" and (stmt[-2:] == ["i", "("] and stmt[-3:-2] in ([], [","]) or stmt[-1:] == ["i"] and stmt[-2:-1] in ([], [","])):
            return "class"
        if any(w in stmt for w in ("class", "interface")) or head == "enum" or "enum" in stmt or "record" in stmt[:-1] and outer in ("top", "class") or len(stmt) > 2 and prev == "(" and "new" in stmt[-4:]:
            return "enum" if "enum" in stmt else "class"
        if "switch" in stmt and prev == "(":
            return "switch"
        if prev in ("=", "]", "[", ",", "") and outer == "init" or prev in ("=", "[", "]"):
            return "init"
        return "block"
    if lang == "js":
        if "class" in stmt and prev not in ("=>", "(", "=") or prev == "class":
            return "class"
        if prev == "(" and "switch" in stmt:
            return "switch"
        if prev in ("import", "export") or head in ("import", "export") and prev == ",":
            return "names"
        if prev in ("=>", "else", "try", "finally", "do", ")", "catch", "static") or prev in ("", ";", "N", "{", "}") and outer not in ("args", "object", "index", "cond") or prev == "(":
            return "block"
        if prev == ":" and head in ("case", "default", "i"):
            return "block"
        return "object"
    if prev in ("struct", "interface"):
        return prev
    if head in ("switch", "select"):
        return "switch" if prev != "]" and not (prev == "i" and len(stmt) > 1 and stmt[-2] in ("]", "[")) else "lit"
    if head in ("if", "for", "else", "func", "go", "defer") or prev in ("else", "") or "func" in stmt:
        if prev == "i" and len(stmt) > 1 and stmt[-2] in ("[", "]") and "func" not in stmt or prev == "[":
            return "lit"
        return "block"
    return "lit"


def _clike(text: str, lang: str) -> list[Token]:
    master, words = {"java": (_JAVA, JAVA_WORDS), "js": (_JS, JS_WORDS), "go": (_GO, GO_WORDS)}[lang]
    out: list[Token] = []
    stack: list[tuple[str, str, list[str]]] = []  # opener, role, statement around it
    stmt: list[str] = []
    outer, prev, at, n = "top", "", 0, len(text)
    if lang == "js" and text.startswith("#!"):
        at = re.match(r"[^\r\n]*", text).end()
    match = master.match

    def line_end() -> None:
        nonlocal prev, stmt
        if lang == "js" and prev not in ("", "N"):
            out.append(("N", 0, ""))
            if prev in _JS_OPERAND_END or prev in ("}", ";"):
                stmt = [] if prev != "," and outer in ("block", "top", "class", "switch") else stmt
        elif lang == "go" and prev in _GO_ENDS:
            out.append((";", 0, ""))
            prev, stmt = ";", []

    while at < n:
        if lang == "js" and text[at] == "/" and prev not in _JS_OPERAND_END and (m := _REGEX.match(text, at)):
            out.append(("s", 0, ""))
            stmt.append("s")
            prev, at = "s", m.end()
            continue
        m = match(text, at)
        if not m:
            c = text[at]
            out.append(("fault: unclosed " + ("string" if c in "\"'`" else "comment") if c in "\"'`" or text.startswith("/*", at) else "fault: character", 0, ""))
            return out
        kind, tok, at = m.lastgroup, m.group(), m.end()
        if kind == "skip":
            continue
        if kind == "nl" or kind == "note":
            if kind == "nl" or "\n" in tok:
                line_end()
            continue
        if kind == "i":
            sym = tok if tok in words else "i"
        elif kind == "n":
            sym = "n"
            if at < n and (text[at].isalnum() or text[at] == "_"):
                out.append(("fault: number", 0, ""))
                return out
        elif kind == "s":
            sym = "s"
        elif kind == "tick":
            out.append(("s", 0, ""))
            stmt.append("s")
            stack.append(("`", outer, stmt))
            at, prev, stmt, outer, bad = _template(text, at, out, stack, stmt, outer)
            if bad:
                return out
            continue
        elif kind == "open":
            role = _role(lang, tok, stmt, prev, outer)
            sym = tok + role[0] if tok == "{" else tok
            out.append((sym, 1, role))
            stmt.append(sym if tok == "{" else tok)
            stack.append((tok, outer, stmt))
            stmt, outer, prev = [], role, ""
            continue
        elif kind == "close":
            if stack and stack[-1][0] == "${" and tok == "}":
                out.append(("}", -1, "${"))
                _, outer, stmt = stack.pop()
                at, prev, stmt, outer, bad = _template(text, at, out, stack, stmt, outer)
                if bad:
                    return out
                continue
            opener = stack[-1][0] if stack else ""
            if lang == "go" and tok == "}" and prev not in ("", ";") and outer in ("block", "switch", "struct", "interface"):
                out.append((";", 0, ""))
            if lang == "go" and tok == ")" and outer.startswith("decls") and prev not in ("", ";"):
                out.append((";", 0, ""))
            out.append((tok, -1, opener))
            if stack:
                _, was, stmt = stack.pop()
                ended = tok == "}" and outer in ("block", "class", "switch", "enum") and lang != "go"
                outer = was
                if ended and outer in ("block", "top", "class", "switch"):
                    stmt = [] if not (stmt and (stmt[0] in ("do", "try") or "=" in stmt or "return" in stmt or "->" in stmt or "=>" in stmt)) else stmt
            prev = "(" if tok == ")" and lang != "go" else tok
            if tok == ")" and lang == "js":
                prev = ")"
            continue
        else:
            sym = tok
        out.append((sym, 0, ""))
        prev = sym
        if sym == ";" and lang == "go" and stmt and stmt[0] in ("if", "for", "switch", "else"):
            stmt.append(sym)  # part of the header
        elif sym == ";" or sym == "," and outer in ("args", "object", "index", "init", "lit"):
            stmt = []
        elif sym == ":" and stmt and stmt[0] in ("case", "default") and lang != "js":
            stmt = []
        else:
            stmt.append(sym)
    if lang == "go" and prev in _GO_ENDS:
        out.append((";", 0, ""))
    return out


def _template(text: str, at: int, out: list[Token], stack: list, stmt: list[str], outer: str):
    """The rest of a template literal from ``at``; stops behind it or inside ${."""
    at = _CHUNK.match(text, at).end()
    if at >= len(text):
        out.append(("fault: unclosed template", 0, ""))
        return at, "", stmt, outer, True
    if text[at] == "`":
        _, outer, stmt = stack.pop()
        return at + 1, "s", stmt, outer, False
    out.append(("", 1, "${"))
    stack.append(("${", outer, stmt))
    return at + 2, "", [], "cond", False


def lex(text: str, lang: str) -> list[Token]:
    return _clike(text, lang)


_PY = re.compile(
    r"(?P<skip>[ \t\f]+|#[^\r\n]*|\\(?:\r\n|\n|\r))|(?P<nl>\r\n|\n|\r)"
    r"|(?P<f>(?i:fr|rf|f)(?:\"\"\"|'''|\"|'))"
    r"|(?P<long>(?i:rb|br|[rbu])?(?:\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''))"
    r"|(?P<s>(?i:rb|br|[rbu])?(?!\"\"\"|''')(?:\"(?:[^\"\\\r\n]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\r\n]|\\(?:\r\n|[\s\S]))*'))"
    r"|(?P<n>(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?))"
    r"|(?P<i>[^\W\d]\w*)|(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|:=|->|\*\*|//|>>|<<|<=|>=|==|!=|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|[-+*/%@&|^~<>=()\[\]{}.,:;])"
)
# Reserved and soft keywords.
PY_WORDS = set(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass "
    "raise return try while with yield match case _ type".split()
)
_ESCAPE = re.compile(r"\\(?:([xuUN])(\{[^}]*\}|[0-9a-fA-F]*)|[\s\S])")
_DIGITS = {"x": 2, "u": 4, "U": 8}
_RUNS = re.compile(r"(?<![^ ])([1s]) , (?:\1 , ){2,}")  # tables of literals differ in length only
_INDENT, _LETTERS = re.compile(r"[ \t\f]*"), re.compile(r"[A-Za-z]*")
_CONTINUED = re.compile(r"(?:\\(?:\r\n|\n|\r)[ \t\f]*)*")
_CONVERSION = re.compile(r"[sra](?!\w)")
_AFTER_NUMBER = re.compile(r"(?:and|else|for|if|in|is|or|not)\b")
_LEADING_ZERO = re.compile(r"0[\d_]*[1-9][\d_]*")
_OPENER = {")": "(", "]": "[", "}": "{"}


def _sound(body: str, of_bytes: bool) -> bool:
    """Whether the escapes of a string that is not raw can be read."""
    for m in _ESCAPE.finditer(body) if "\\" in body else ():
        kind, rest = m.groups()
        if not kind or kind != "x" and of_bytes:
            continue
        if kind == "N":
            try:
                unicodedata.lookup(rest[1:-1])
            except KeyError:
                return False
        elif rest.startswith("{") or len(rest) < _DIGITS[kind] or kind == "U" and int(rest[:8], 16) > 0x10FFFF:
            return False
    return True


def _body(text: str, at: int, quote: str, raw: bool, spec: bool) -> tuple[int, str]:
    """From ``at`` inside an f-string, or a format of it, to what ends its literal part: position of that, and what it is."""
    start, n = at, len(text)
    while at < n:
        c = text[at]
        if c == "\\":
            if not raw and text.startswith("N{", at + 1) and (end := text.find("}", at)) > 0:
                at = end + 1
            else:
                at += 1 if text[at + 1 : at + 2] in ("{", "}") else 2
            continue
        if c in "\r\n" and len(quote) == 1:
            return at, "fault"
        if c == quote[0] and text.startswith(quote, at):
            return (at, "fault") if spec else (at, "end" if raw or _sound(text[start:at], False) else "fault")
        if c == "{":
            if not spec and text.startswith("{{", at):
                at += 2
                continue
            return at, "open" if raw or _sound(text[start:at], False) else "fault"
        if c == "}":
            if not spec and text.startswith("}}", at):
                at += 2
                continue
            return at, "close" if spec else "fault"
        at += 1
    return at, "fault"


def python_lines(text: str) -> list[tuple[int, str]]:
    """(indent level, canonical text) of the logical lines; a text that begins with fault: is one that cannot be lexed.

    Tokens are those of ``python_grammar``. Fields of f-strings are lexed like code; brackets, fields and formats are kept on
    one stack.
    """
    text = text.lstrip("\ufeff")
    lines: list[tuple[int, str]] = []
    indents = [(0, 0)]  # columns with tabs to 8, and with tabs as one
    stack: list[tuple[str, str, bool]] = []  # bracket, f (inside a literal part), field or spec; with quote and rawness
    at, n, start = 0, len(text), True
    cur: list[str] = []
    level = 0

    def line() -> None:
        content = " ".join(cur)
        lines.append((level, _RUNS.sub(r"\1 , \1 , ", content) if len(content) > 100 else content))
        cur.clear()

    while at <= n:
        top = stack[-1][0] if stack else ""
        if top in ("f", "spec"):
            at, what = _body(text, at, stack[-1][1], stack[-1][2], top == "spec")
            if what == "fault":
                return [*lines, (level, "fault: f-string")]
            if what == "open":
                cur.append("{f")
                stack.append(("field", *stack[-1][1:]))
                at += 1
            elif what == "close":
                cur.append("}f")
                stack.pop(), stack.pop()
                at += 1
            else:
                cur.append("f>")
                at += len(stack.pop()[1])
            continue
        if start and not stack:
            m = _INDENT.match(text, at)
            rest = m.end()
            first = _CONTINUED.match(text, rest).end()  # a line that goes on is indented as it begins
            if first < n and text[first] not in "#\r\n":
                blank = m.group().rsplit("\f", 1)[-1]
                width = (len(blank.expandtabs(8)), len(blank))
                if width[0] > indents[-1][0]:
                    if width[1] <= indents[-1][1]:
                        return [*lines, (0, "fault: tabs and blanks")]
                    indents.append(width)
                else:
                    while width[0] < indents[-1][0]:
                        indents.pop()
                    if indents[-1] != width:
                        return [*lines, (0, "fault: unindent" if indents[-1][0] != width[0] else "fault: tabs and blanks")]
                level = len(indents) - 1
                if level > 99:
                    return [*lines, (level, "fault: too many levels of indentation")]
            at, start = rest, False
        if at >= n:
            break
        c = text[at]
        if top == "field":
            if c == "}":
                cur.append("}f")
                stack.pop()
                at += 1
                continue
            if c == ":":
                cur.append(":f")
                stack.append(("spec", *stack[-1][1:]))
                at += 1
                continue
            if c == "!" and text[at + 1 : at + 2] != "=":
                if not (m := _CONVERSION.match(text, at + 1)):
                    return [*lines, (level, "fault: conversion")]
                cur += ["!", "a"]
                at = m.end()
                continue
        m = _PY.match(text, at)
        if not m:
            return [*lines, (level, "fault: token")]
        kind, tok, at = m.lastgroup, m.group(), m.end()
        if kind == "skip":
            if tok[0] == "\\" and at >= n:
                return [*lines, (level, "fault: end after a backslash")]
            continue
        if kind == "nl":
            if not stack:
                if cur:
                    line()
                start = True
            continue
        if kind == "i":
            if not tok.isascii() and not tok.isidentifier():
                return [*lines, (level, "fault: identifier")]
            cur.append(tok if tok in PY_WORDS else "a")
        elif kind == "n":
            if at < n and (text[at].isalnum() or text[at] == "_") and not _AFTER_NUMBER.match(text, at):
                return [*lines, (level, "fault: number")]
            if _LEADING_ZERO.fullmatch(tok):
                return [*lines, (level, "fault: number")]
            cur.append("1j" if tok[-1] in "jJ" else "1")
        elif kind == "f":
            quote = tok.lstrip("fFrR")
            stack.append(("f", quote, "r" in tok.lower()))
            cur.append("f<")
        elif kind in ("s", "long"):
            head = _LETTERS.match(tok).group().lower()
            if "b" in head and not tok.isascii() or "r" not in head and not _sound(tok[len(head) :], "b" in head):
                return [*lines, (level, "fault: string")]
            cur.append("b" if "b" in head else "s")
        else:
            if tok in "([{":
                stack.append((tok, "", False))
                if len(stack) > 199:
                    return [*lines, (level, "fault: too many nested brackets")]
            elif tok in ")]}":
                if not stack or stack[-1][0] != _OPENER[tok]:
                    return [*lines, (level, "fault: closer")]
                stack.pop()
            cur.append(tok)
    if stack:
        return [*lines, (level, "fault: unclosed bracket")]
    if cur:
        line()
    return lines
