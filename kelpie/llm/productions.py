"""Productions of statements and expressions over flat groups of tokens.

A group is the token sequence between two brackets, inner groups reduced to their opener (``{`` with the first letter
of its role). ``valid(lang, role, symbols)`` says whether the role's productions derive the sequence.
"""

from __future__ import annotations

import sys

_BINARY = {
    "java": set("+ - * / % & | ^ && || == != < > <= >= << >>> instanceof".split()),
    "js": set("+ - * / % & | ^ && || == != === !== < > <= >= << >> >>> ** ?? in instanceof".split()),
    "go": set("+ - * / % & | ^ && || == != < > <= >= << >> &^".split()),
}
_ASSIGN = {
    "java": set("= += -= *= /= %= &= |= ^= <<= >>= >>>=".split()),
    "js": set("= += -= *= /= %= &= |= ^= <<= >>= >>>= **= &&= ||= ??=".split()),
    "go": set("= := += -= *= /= %= &= |= ^= <<= >>= &^=".split()),
}
_UNARY = {"java": set("! ~ + - ++ --".split()), "js": set("! ~ + - ++ -- typeof void delete await".split()), "go": set("! ^ + - * & <-".split())}
_PRIMITIVE = set("boolean byte char double float int long short void".split())
_MODIFIERS = set("abstract final native private protected public static strictfp synchronized transient volatile default".split())


class _Bad(Exception):
    pass


class _Parser:
    """A recursive descent over one flat group; each method consumes what its production derives or raises."""

    def __init__(self, lang: str, syms: list[str]):
        self.lang, self.t, self.i = lang, syms, 0

    # -- tokens

    def skip(self) -> None:
        while self.i < len(self.t) and self.t[self.i] == "N":
            self.i += 1

    def peek(self, ahead: int = 0, raw: bool = False) -> str:
        if not raw and self.lang == "js":
            j, left = self.i, ahead
            while j < len(self.t):
                if self.t[j] != "N":
                    if not left:
                        return self.t[j]
                    left -= 1
                j += 1
            return ""
        j = self.i + ahead
        return self.t[j] if j < len(self.t) else ""

    def next(self) -> str:
        if self.lang == "js":
            self.skip()
        if self.i >= len(self.t):
            raise _Bad
        self.i += 1
        return self.t[self.i - 1]

    def take(self, *what: str) -> bool:
        if self.peek() in what and self.peek():
            self.next()
            return True
        return False

    def need(self, *what: str) -> str:
        if self.peek() not in what or not self.peek():
            raise _Bad
        return self.next()

    def done(self) -> bool:
        return not self.peek()

    def attempt(self, rule) -> bool:
        at = self.i
        try:
            rule()
            return True
        except _Bad:
            self.i = at
            return False

    def listed(self, item, sep: str = ",", trailing: bool = True, empty: bool = True) -> None:
        """item (sep item)* to the end of the group."""
        if self.done():
            if empty:
                return
            raise _Bad
        item()
        while self.take(sep):
            if self.done():
                if trailing:
                    return
                raise _Bad
            item()
        if not self.done():
            raise _Bad

    # -- expressions

    def expr(self) -> None:
        """An expression without top-level comma."""
        self.unary()
        while True:
            op = self.peek()
            if op in _BINARY[self.lang]:
                self.next()
                if self.lang == "java" and op == "instanceof":
                    self.take("final")
                    self.type()
                    self.take("i")
                    continue
                while self.lang == "java" and op == ">" and self.t[self.i - 1] == ">" and self.take(">"):
                    pass
                self.unary()
            elif op in _ASSIGN[self.lang] and self.lang != "go":
                self.next()
                if self.lang == "java" and self.peek() == "{i":
                    self.next()
                    return
                self.expr()
                return
            elif op == "?" and self.lang != "go":
                self.next()
                self.expr()
                self.need(":")
                self.expr()
                return
            else:
                return

    def unary(self) -> None:
        while self.peek() in _UNARY[self.lang]:
            self.next()
        if self.lang == "js" and self.peek() == "yield":
            self.next()
            self.take("*")
            if self.peek() in ("", ")", "]", ";", ","):
                return
            return self.expr()
        self.primary()
        while True:
            p = self.peek()
            raw = self.peek(raw=True)
            if p == "." or p == "?.":
                self.next()
                if p == "?." and self.peek() in ("(", "["):
                    continue
                if self.lang == "go" and self.take("("):
                    continue
                if self.lang == "java" and self.peek() == "<":
                    self.type_args()
                if self.lang == "js" and self.take("#"):
                    pass
                w = self.next()
                if not (w == "i" or self.lang == "js" and w[:1].isalpha() or w in ("this", "class", "new", "super")):
                    raise _Bad
                if w == "new":
                    self.need("i")
            elif p == "(" or p == "[":
                self.next()
            elif p in ("++", "--") and self.lang != "go" and raw == p:
                self.next()
            elif p == "::" and self.lang == "java":
                self.next()
                self.need("i", "new")
            elif p == "s" and self.lang == "js" and raw == "s" and self.t[self.i - 1] in ("i", ")"):
                self.next()
            elif p == "{l" and self.lang == "go":
                self.next()
            elif p == "{c" and self.lang == "java" and self.t[self.i - 1] == "(":
                self.next()
            elif p in ("->", "=>") and (self.lang, p) in (("java", "->"), ("js", "=>")) and raw == p and self.t[self.i - 1] in ("i", "("):
                self.next()
                if not self.take("{b"):
                    self.expr()
                return
            elif self.lang == "java" and self.t[self.i - 1] == "(" and self._starts() and self.i >= 1:
                self.unary()  # what stands before was a cast
                return
            else:
                return

    def _starts(self) -> bool:
        return self.peek() in ("i", "n", "s", "this", "super", "new", "true", "false", "null", "!", "~", "switch") or self.peek() in _PRIMITIVE

    def primary(self) -> None:
        t = self.next()
        lang = self.lang
        if t in ("i", "n", "(", "null", "true", "false", "this", "super"):
            if t == "i" and lang == "java" and self.peek() == "<":
                at = self.i
                if not self.attempt(lambda: (self.type_args(), self.need("::"))):
                    self.i = at
                else:
                    self.i -= 1
            return
        if t == "s":
            return
        if lang == "java":
            if t == "new":
                self.name()
                if self.peek() == "<":
                    self.type_args()
                if self.peek() == "(":
                    return
                self.need("[")
                while self.take("["):
                    pass
                self.take("{i")
                return
            if t in _PRIMITIVE:
                while self.take("["):
                    pass
                if self.take("."):
                    self.need("class")
                    return
                self.need("::")
                self.need("new")
                return
            if t == "switch":
                self.need("(")
                self.need("{s")
                return
        elif lang == "js":
            if t in ("[", "{o", "of", "let", "static"):
                return
            if t == "async":
                if self.peek() == "function":
                    t = self.next()
                else:
                    if self.peek() == "i" and self.peek(1) == "=>":
                        self.next()
                    return
            if t == "function":
                self.take("*")
                self.take("i", "async", "of")
                self.need("(")
                self.need("{b")
                return
            if t == "class":
                self.take("i")
                if self.take("extends"):
                    self.unary()
                self.need("{c")
                return
            if t == "new":
                if self.take("."):
                    self.need("i")
                    return
                self.unary()
                return
            if t == "import":
                self.need("(", ".")
                if self.t[self.i - 1] == ".":
                    self.need("i")
                return
            if t == "#":
                self.need("i")
                return
        else:
            if t == "func":
                self.signature()
                self.need("{b")
                return
            if t in ("[", "map", "chan", "struct", "interface"):
                self.i -= 1
                self.type()
                if self.peek() not in ("{l", "("):
                    raise _Bad
                return
        raise _Bad

    # -- types

    def name(self) -> None:
        if self.peek() in _PRIMITIVE:
            self.next()
            return
        while self.take("@"):
            self.need("i")
            self.take("(")
        self.need("i")
        while self.peek() == "." and self.peek(1) == "i":
            self.next()
            self.next()

    def type_args(self) -> None:
        self.need("<")
        if self.take(">"):
            return
        while True:
            if self.take("?"):
                if self.take("extends", "super"):
                    self.type()
            else:
                self.type()
                if self.take("extends"):
                    self.type()
                    while self.take("&"):
                        self.type()
            if not self.take(","):
                break
        self.need(">")

    def type(self) -> None:
        if self.lang == "go":
            return self.go_type()
        self.name()
        if self.peek() == "<":
            self.type_args()
            while self.take("."):
                self.need("i")
                if self.peek() == "<":
                    self.type_args()
        while self.take("["):
            pass
        self.take("...")

    def go_type(self) -> None:
        t = self.next()
        if t == "i":
            if self.take("."):
                self.need("i")
            if self.peek() == "[" :
                self.next()
        elif t == "*" or t == "...":
            self.go_type()
        elif t == "[":
            self.go_type()
        elif t == "map":
            self.need("[")
            self.go_type()
        elif t == "chan":
            self.take("<-")
            self.go_type()
        elif t == "<-":
            self.need("chan")
            self.go_type()
        elif t == "func":
            self.signature()
        elif t in ("struct", "interface"):
            self.need("{" + t[0])
        elif t != "(":
            raise _Bad

    def signature(self) -> None:
        self.need("(")
        if not self.take("("):
            self.attempt(self.go_type)

    # -- Java

    def modifiers(self) -> None:
        while True:
            if self.peek() == "@" and self.peek(1) != "interface":
                self.next()
                self.name()
                self.take("(")
            elif self.peek() in _MODIFIERS and not (self.peek() in ("default", "synchronized") and self.peek(1) in (":", "->", "(")):
                self.next()
            else:
                return

    def declarators(self) -> None:
        while True:
            self.need("i")
            while self.take("["):
                pass
            if self.take("="):
                if not self.take("{i"):
                    self.expr()
            if not self.take(","):
                return

    def java_class(self) -> bool:
        if self.peek() == "@" and self.peek(1) == "interface":
            self.next()
        record = self.peek() == "i" and self.peek(1) == "i" and self.peek(2) == "("
        if self.peek() in ("class", "interface", "enum") or record and self._record_body():
            kind = self.next()
            self.need("i")
            if self.peek() == "<":
                self.type_args()
            if kind == "i":
                self.need("(")
            for w in ("extends", "implements", "extends"):
                if self.take(w):
                    self.type()
                    while self.take(","):
                        self.type()
            self.need("{e" if kind == "enum" else "{c")
            return True
        return False

    def _record_body(self) -> bool:
        j = self.i + 3
        while j < len(self.t) and self.t[j] in ("implements", "i", ",", "<", ">", "."):
            j += 1
        return j < len(self.t) and self.t[j] == "{c"

    def java_top(self) -> None:
        at = self.i
        self.modifiers()
        if self.take("package"):
            self.dotted(";")
        else:
            self.i = at
        while not self.done():
            if self.take(";"):
                continue
            if self.take("import"):
                self.take("static")
                self.dotted(";", star=True)
                continue
            self.modifiers()
            if not self.java_class():
                raise _Bad

    def dotted(self, end: str, star: bool = False) -> None:
        self.need("i")
        while self.take("."):
            if star and self.take("*"):
                break
            self.need("i")
        self.need(end)

    def java_members(self) -> None:
        while not self.done():
            if self.take(";"):
                continue
            if self.take("{b"):
                continue
            self.modifiers()
            if self.take("{b") or self.java_class():
                continue
            if self.peek() == "<":
                self.type_args()
            if self.peek() == "i" and self.peek(1) in ("(", "{b"):
                self.next()
                if self.take("("):
                    self.throws()
                self.need("{b")
                continue
            self.type()
            if self.peek() == "i" and self.peek(1) == "(":
                self.next()
                self.next()
                while self.take("["):
                    pass
                self.throws()
                if self.take("default"):
                    self.expr()
                self.need("{b", ";")
                continue
            self.declarators()
            self.need(";")

    def throws(self) -> None:
        if self.take("throws"):
            self.type()
            while self.take(","):
                self.type()

    def java_enum(self) -> None:
        while self.peek() in ("i", "@"):
            self.modifiers()
            self.need("i")
            self.take("(")
            self.take("{c", "{b", "{i")
            if not self.take(","):
                break
        if self.take(";"):
            self.java_members()
        elif not self.done():
            raise _Bad

    def java_params(self) -> None:
        def one() -> None:
            self.modifiers()
            self.type()
            self.need("i", "this")
            while self.take("["):
                pass

        self.listed(one, trailing=False)

    def local(self) -> None:
        self.modifiers()
        self.type()
        self.declarators()

    def java_stmt(self) -> None:
        t = self.peek()
        if self.take(";") or self.take("{b"):
            return
        if t == "if" or t == "while":
            self.next()
            self.need("(")
            self.java_stmt()
            if t == "if" and self.take("else"):
                self.java_stmt()
        elif t == "for":
            self.next()
            self.need("(")
            self.java_stmt()
        elif t == "do":
            self.next()
            self.java_stmt()
            self.need("while")
            self.need("(")
            self.need(";")
        elif t == "try":
            self.next()
            some = self.take("(")
            self.need("{b")
            while self.take("catch"):
                self.need("(")
                self.need("{b")
                some = True
            if self.take("finally"):
                self.need("{b")
            elif not some:
                raise _Bad
        elif t == "switch":
            self.next()
            self.need("(")
            self.need("{s")
        elif t == "synchronized" and self.peek(1) == "(":
            self.next()
            self.next()
            self.need("{b")
        elif t in ("return", "throw", "assert"):
            self.next()
            if not (t == "return" and self.peek() == ";"):
                self.expr()
            if t == "assert" and self.take(":"):
                self.expr()
            self.need(";")
        elif t in ("break", "continue"):
            self.next()
            self.take("i")
            self.need(";")
        elif t == "i" and self.peek(1) == ":":
            self.next()
            self.next()
            self.java_stmt()
        else:
            at = self.i
            self.modifiers()
            if self.java_class():
                return
            self.i = at
            if self.attempt(lambda: (self.local(), self.need(";"))):
                return
            if t == "i" and self.peek(1) not in (";",) and self.attempt(lambda: (self.need("i"), self.expr(), self.need(";"), (_ for _ in ()).throw(_Bad()))):
                return
            self.expr()
            self.need(";")

    def java_for(self) -> None:
        if self.attempt(lambda: (self.modifiers(), self.type(), self.need("i"), self.need(":"), self.expr(), self.end())):
            return
        if self.attempt(lambda: (self.resources(), self.end())):
            return
        if not self.attempt(self.local):
            self.exprs()
        self.need(";")
        if self.peek() != ";":
            self.expr()
        self.need(";")
        self.exprs()

    def resources(self) -> None:
        while True:
            if not self.attempt(self.local):
                self.expr()
            if not self.take(";") or self.done():
                return

    def exprs(self) -> None:
        if self.peek() in ("", ";"):
            return
        self.expr()
        while self.take(","):
            self.expr()

    def end(self) -> None:
        if not self.done():
            raise _Bad

    def java_switch(self) -> None:
        while not self.done():
            if self.take("case"):
                while True:
                    if self.peek() == "i" and self.peek(1) in ("->", ":", ","):
                        self.next()
                    elif not self.attempt(lambda: (self.type(), self.need("i"))):
                        self.expr()
                    if not self.take(","):
                        break
            else:
                self.need("default")
            arrow = self.need(":", "->") == "->"
            if arrow:
                self.java_stmt()
                continue
            while self.peek() not in ("", "case", "default"):
                self.java_stmt()

    def java_args(self) -> None:
        if self.attempt(lambda: (self.listed(self.expr, trailing=False))):
            return
        if self.attempt(lambda: self.listed(lambda: (self.type(), self.attempt(lambda: self.need("i"))), trailing=False)):
            return
        if self.attempt(lambda: self.listed(lambda: (self.take("{i", "{b") or self.expr()), trailing=False)):
            return
        self.modifiers()
        self.type()
        while self.take("&"):
            self.type()
        self.end()

    # -- JavaScript

    def js_end(self) -> None:
        """The end of a statement: a semicolon, a line end, or the end of the group."""
        if self.peek() == ";":
            self.next()
            return
        if self.peek(raw=True) in ("N", "") or self.t[self.i - 1] in ("N",):
            return
        raise _Bad

    def sequence(self) -> None:
        self.expr()
        while self.take(","):
            self.expr()

    def binding(self) -> None:
        self.need("i", "[", "{o", "{b", "async", "of", "static")

    def js_decl(self, init: bool = True) -> None:
        self.need("var", "let", "const")
        while True:
            self.binding()
            if self.take("="):
                self.expr()
            if not self.take(","):
                return

    def js_function(self) -> bool:
        at = self.i
        if self.peek() == "async" and self.peek(1) == "function":
            self.next()
        if self.take("function"):
            self.take("*")
            self.take("i", "async", "of")
            self.need("(")
            self.need("{b")
            return True
        if self.take("class"):
            self.take("i")
            if self.take("extends"):
                self.unary()
            self.need("{c")
            return True
        self.i = at
        return False

    def js_stmt(self) -> None:
        t = self.peek()
        if self.take(";") or self.take("{b"):
            return
        if t == "{o" and self.i == 0:
            self.next()
            return
        if t == "function" or t == "class" or t == "async" and self.peek(1) == "function":
            self.js_function()
        elif t in ("var", "const") or t == "let" and self.peek(1) in ("i", "[", "{o", "{b", "async", "of"):
            self.js_decl()
            self.js_end()
        elif t in ("if", "while"):
            self.next()
            self.need("(")
            self.js_stmt()
            if t == "if" and self.peek() == "else":
                self.next()
                self.js_stmt()
        elif t == "for":
            self.next()
            self.take("await")
            self.need("(")
            self.js_stmt()
        elif t == "do":
            self.next()
            self.js_stmt()
            self.need("while")
            self.need("(")
            self.take(";")
        elif t == "try":
            self.next()
            self.need("{b")
            some = self.take("catch")
            if some:
                self.take("(")
                self.need("{b")
            if self.take("finally"):
                self.need("{b")
            elif not some:
                raise _Bad
        elif t == "switch":
            self.next()
            self.need("(")
            self.need("{s")
        elif t in ("return", "throw"):
            self.next()
            if self.peek(raw=True) not in ("", "N", ";"):
                self.sequence()
            elif t == "throw":
                raise _Bad
            self.js_end()
        elif t in ("break", "continue"):
            self.next()
            if self.peek(raw=True) == "i":
                self.next()
            self.js_end()
        elif t == "debugger":
            self.next()
            self.js_end()
        elif t == "i" and self.peek(1) == ":":
            self.next()
            self.next()
            self.js_stmt()
        elif t == "import" and self.peek(1) not in ("(", "."):
            self.next()
            if not self.take("s"):
                self.js_clause()
                self.need("i")
                self.need("s")
            self.js_end()
        elif t == "export":
            self.next()
            if self.take("default"):
                if not self.js_function():
                    self.expr()
                    self.js_end()
            elif self.peek() in ("*", "{n"):
                if self.take("*"):
                    if self.take("i"):
                        self.need("i", "default")
                    self.need("i")
                    self.need("s")
                else:
                    self.next()
                    if self.take("i"):
                        self.need("s")
                self.js_end()
            elif not self.js_function():
                self.js_decl()
                self.js_end()
        else:
            self.sequence()
            self.js_end()

    def js_clause(self) -> None:
        while True:
            if self.take("*"):
                self.need("i")
                self.need("i")
            else:
                self.need("i", "{n", "{o")
            if not self.take(","):
                return

    def js_for(self) -> None:
        def each() -> None:
            if not self.take("var", "let", "const"):
                self.unary()
            else:
                self.binding()
            self.need("of", "in")
            self.sequence()
            self.end()

        if self.attempt(each):
            return
        if self.peek() in ("var", "let", "const"):
            self.js_decl()
        elif self.peek() != ";":
            self.sequence()
        self.need(";")
        if self.peek() != ";":
            self.sequence()
        self.need(";")
        if not self.done():
            self.sequence()

    def js_property(self) -> None:
        if self.take("..."):
            return self.expr()
        if self.take("{o"):
            return
        at = self.i
        while self.peek() in ("async", "*", "static", "i") and self.peek(1) not in (":", ",", "(", "=", "", ";", "}"):
            self.next()
        w = self.next()
        if not (w in ("i", "s", "n", "[") or w[:1].isalpha()):
            raise _Bad
        if self.take("("):
            self.need("{b")
        elif self.take(":"):
            self.expr()
        elif self.take("="):
            self.expr()
        elif w in ("s", "n", "[") or w[:1].isalpha() and w not in ("i", "async", "of", "static", "let", "await", "yield"):
            self.i = at
            raise _Bad

    def js_member(self) -> None:
        while self.peek() in ("async", "*", "static", "i") and self.peek(1) not in ("(", "=", ";", "") and not (self.peek(1) == "{b" and self.peek() != "static") and self.t[self.i + 1 : self.i + 2] != ["N"]:
            self.next()
            if self.peek() == "{b":
                self.next()
                return
        self.take("#")
        w = self.next()
        if not (w in ("i", "s", "n", "[") or w[:1].isalpha()):
            raise _Bad
        if self.take("("):
            self.need("{b")
            return
        if self.take("="):
            self.expr()
        self.js_end()

    # -- Go

    def go_exprs(self) -> None:
        self.expr()
        while self.take(","):
            self.expr()

    def go_simple(self) -> None:
        if self.peek() == "range":
            self.next()
            self.expr()
            return
        self.go_exprs()
        if self.peek() in _ASSIGN["go"]:
            self.next()
            if self.take("range"):
                self.expr()
            else:
                self.go_exprs()
        elif self.take("<-"):
            self.expr()
        else:
            self.take("++", "--")

    def go_header(self, body: str) -> None:
        if self.take(body):
            return
        parts = 0
        while True:
            if self.peek() not in (";", body):
                self.go_simple()
            parts += 1
            if self.take(body):
                return
            self.need(";")

    def go_stmt(self) -> None:
        t = self.peek()
        if t in ("", ";", "{b"):
            self.take("{b")
        elif t == "if":
            self.next()
            if self.peek() == "{b":
                raise _Bad
            self.go_header("{b")
            if self.take("else"):
                if self.peek() not in ("if", "{b"):
                    raise _Bad
                self.go_stmt()
                return
        elif t == "for":
            self.next()
            self.go_header("{b")
        elif t in ("switch", "select"):
            self.next()
            self.go_header("{s")
        elif t in ("go", "defer"):
            self.next()
            self.expr()
        elif t == "return":
            self.next()
            if self.peek() not in (";", ""):
                self.go_exprs()
        elif t in ("break", "continue", "goto", "fallthrough"):
            self.next()
            self.take("i")
        elif t in ("var", "const", "type"):
            self.go_decl()
        elif t == "i" and self.peek(1) == ":":
            self.next()
            self.next()
            if self.peek() != "":
                self.go_stmt()
        else:
            self.go_simple()

    def go_spec(self, kind: str) -> None:
        if kind == "import":
            self.take("i", ".")
            self.need("s")
            return
        self.need("i")
        if kind == "type":
            if self.peek() == "[" and self.peek(1) == "i" and False:
                self.next()
            self.take("=")
            self.go_type()
            return
        while self.take(","):
            self.need("i")
        if self.peek() not in ("=", ";", ""):
            self.go_type()
        if self.take("="):
            self.go_exprs()

    def go_decl(self) -> None:
        kind = self.next()
        if not self.take("("):
            self.go_spec(kind)

    def go_list(self, item) -> None:
        while not self.done():
            if self.take(";"):
                continue
            item()
            if not self.done():
                self.need(";")

    def go_top(self) -> None:
        while self.take(";"):
            pass
        self.need("package")
        self.need("i")
        self.need(";")
        self.go_list(self.go_top_decl)

    def go_top_decl(self) -> None:
        if self.take("func"):
            if self.take("("):
                pass
            self.need("i")
            self.take("[")
            self.signature()
            self.take("{b")
            return
        if self.peek() not in ("import", "var", "const", "type"):
            raise _Bad
        self.go_decl()

    def go_switch(self) -> None:
        while not self.done():
            if self.take(";"):
                continue
            if self.take("case"):
                if not self.attempt(lambda: (self.go_simple(), self.need(":"))):
                    self.go_type()
                    while self.take(","):
                        self.go_type()
                    self.need(":")
            else:
                self.need("default")
                self.need(":")
            while self.peek() not in ("", "case", "default"):
                if self.take(";"):
                    continue
                self.go_stmt()
                if self.peek() not in ("", "case", "default"):
                    self.need(";")

    def go_field(self) -> None:
        if self.peek() == "*" or self.peek() == "i" and self.peek(1) in (";", "", ".", "s"):
            self.go_type()
        else:
            self.need("i")
            while self.take(","):
                self.need("i")
            self.go_type()
        self.take("s")

    def go_method(self) -> None:
        if self.peek() == "i" and self.peek(1) == "(":
            self.next()
            self.signature()
            return
        self.take("~")
        self.go_type()
        while self.take("|"):
            self.take("~")
            self.go_type()

    def go_params(self) -> None:
        def one() -> None:
            if self.peek() == "i" and self.peek(1) not in (".", ",", "", "["):
                self.next()
                self.go_type()
            elif self.peek() == "i" and self.peek(1) == "[":
                if not self.attempt(lambda: (self.need("i"), self.go_type(), self.stop())):
                    self.go_type()
            else:
                self.go_type()

        self.listed(one)

    def stop(self) -> None:
        if self.peek() not in ("", ","):
            raise _Bad

    def go_args(self) -> None:
        if self.t == ["type"]:  # of a type switch
            self.next()
            return

        def one() -> None:
            if not self.attempt(lambda: (self.expr(), self.take("..."), self.stop())):
                self.go_type()

        self.listed(one)

    def go_lit(self) -> None:
        def one() -> None:
            if not self.take("{l", "{b"):
                self.expr()
            if self.take(":"):
                if not self.take("{l", "{b"):
                    self.expr()

        self.listed(one)

    # -- roles

    def group(self, role: str) -> None:
        lang = self.lang
        if lang == "java":
            {
                "top": self.java_top,
                "class": self.java_members,
                "enum": self.java_enum,
                "block": lambda: self.stmts(self.java_stmt),
                "switch": self.java_switch,
                "init": lambda: self.listed(lambda: self.take("{i") or self.expr()),
                "cond": lambda: self.expr(),
                "for": self.java_for,
                "catch": lambda: (self.modifiers(), self.type(), [self.type() for _ in iter(lambda: self.take("|"), False)], self.need("i")),
                "params": self.java_params,
                "args": self.java_args,
                "index": lambda: self.done() or self.expr(),
            }[role]()
        elif lang == "js":
            {
                "top": lambda: self.stmts(self.js_stmt),
                "block": lambda: self.stmts(self.js_stmt),
                "class": lambda: self.members(),
                "switch": self.js_switch,
                "cond": self.sequence,
                "${": self.sequence,
                "for": self.js_for,
                "catch": self.binding,
                "object": lambda: self.listed(self.js_property),
                "names": lambda: self.listed(self.js_name),
                "params": lambda: self.listed(lambda: (self.take("..."), self.expr())),
                "args": lambda: self.listed(lambda: (self.take("..."), self.expr())),
                "index": self.js_elements,
            }[role]()
        elif role.startswith("decls"):
            self.go_list(lambda: self.go_spec(role[5:]))
        else:
            {
                "top": self.go_top,
                "block": lambda: self.go_list(self.go_stmt),
                "switch": self.go_switch,
                "lit": self.go_lit,
                "struct": lambda: self.go_list(self.go_field),
                "interface": lambda: self.go_list(self.go_method),
                "params": self.go_params,
                "args": self.go_args,
                "cond": self.go_args,
                "index": lambda: self.go_index(),
            }[role]()
        self.end()

    def stmts(self, one) -> None:
        while not self.done():
            one()

    def members(self) -> None:
        while not self.done():
            if not self.take(";"):
                self.js_member()

    def js_name(self) -> None:
        w = self.next()
        if not w[:1].isalpha():
            raise _Bad
        if self.take("i"):
            if not self.next()[:1].isalpha():
                raise _Bad

    def js_elements(self) -> None:
        while not self.done():
            if self.take(","):
                continue
            self.take("...")
            self.expr()
            if not self.done():
                self.need(",")

    def js_switch(self) -> None:
        while not self.done():
            if self.take("case"):
                self.sequence()
            else:
                self.need("default")
            self.need(":")
            while self.peek() not in ("", "case", "default"):
                self.js_stmt()

    def go_index(self) -> None:
        if self.done() or self.take("..."):
            return
        if self.attempt(lambda: (self.go_args(), self.end())):
            return
        if self.attempt(lambda: (self.go_params(), self.end())):
            return
        for _ in range(3):
            if self.peek() not in (":", ""):
                self.expr()
            if not self.take(":"):
                break


def valid(lang: str, role: str, syms: list[str]) -> bool:
    """Whether the productions of ``role`` derive the group."""
    depth = sys.getrecursionlimit()
    sys.setrecursionlimit(max(depth, 8 * len(syms) + 2000))  # what one symbol can open
    try:
        _Parser(lang, syms).group(role)
        return True
    except _Bad:
        # a block may stand where an object was guessed, and the other way round
        if lang == "js" and role in ("block", "object"):
            try:
                _Parser(lang, syms).group("object" if role == "block" else "block")
                return True
            except _Bad:
                return False
        return False
    finally:
        sys.setrecursionlimit(depth)
