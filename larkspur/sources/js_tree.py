"""A syntax tree of a JavaScript source, by recursive descent; sources are read, never run.

Nodes are few in kind, as the facts need them: what matters is which expressions are
called, what they are called with, which names are bound to what and in which scope.
Patterns and parameters are read as the expressions that they look like.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass, field

#: Fixed value: so deep may brackets lie.
DEPTH = 300
_NAME = r"(?:[A-Za-z_$\u0080-\U0010ffff]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$\u0080-\U0010ffff]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*"
_TOKEN = re.compile(
    r"(?P<space>[\s\ufeff]+|//[^\n]*|/\*[\s\S]*?\*/)"
    rf"|(?P<name>#?{_NAME})"
    r"|(?P<number>0[xXbBoO][0-9a-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?)"
    r"""|(?P<string>'(?:[^'\\\n]|\\[\s\S])*'|"(?:[^"\\\n]|\\[\s\S])*")"""
    r"|(?P<mark>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\*\*|<<|>>|[-+*/%&|^]=|[{}()\[\];,.<>+*/%&|^!~?:=@`-])"
)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
_ESCAPE = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|u\{([0-9a-fA-F]+)\}|(\r\n|[\s\S]))")
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r\n": ""}
_BINARY = {"??": 1, "||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "===": 6, "!==": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "in": 7, "instanceof": 7, "<<": 8, ">>": 8, ">>>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10, "**": 11}
_ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="}
_UNARY = {"!", "~", "+", "-", "typeof", "void", "delete", "++", "--", "await"}
_RESERVED = set("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false".split())


class NotParsed(ValueError):
    """The source has no tree."""


@dataclass(slots=True)
class Node:
    """kind, line, text (a name, operator, module or literal), and children in the order of the source."""

    kind: str
    line: int
    text: str | None = None
    kids: list[Node] = field(default_factory=list)


def cooked(body: str) -> str:
    def one(m: re.Match) -> str:
        code = m[1] or m[2] or m[3]
        return chr(min(int(code, 16), 0x10FFFF)) if code else _PLAIN.get(m[4], m[4])

    return _ESCAPE.sub(one, body) if "\\" in body else body


class Parser:
    def __init__(self, source: str):
        self.source, self.at, self.row, self.depth = source, 0, 1, 0
        if source.startswith("#!"):
            self.at = source.find("\n") if "\n" in source else len(source)
        self.kind = self.text = ""
        self.line, self.start, self.fresh = 1, 0, False
        self.next()

    # -- tokens: one ahead --

    def next(self) -> None:
        self.fresh = False
        while self.at < len(self.source):
            m = _TOKEN.match(self.source, self.at)
            if not m:
                raise NotParsed(f"line {self.row}")
            raw = m[0]
            if m.lastgroup == "space":
                self.fresh |= "\n" in raw
                self.row += raw.count("\n")
                self.at = m.end()
                continue
            self.kind, self.line, self.start = m.lastgroup, self.row, self.at
            self.text = cooked(raw[1:-1]) if self.kind == "string" else cooked(raw) if self.kind == "name" else raw
            self.row += raw.count("\n")
            self.at = m.end()
            return
        self.kind, self.text, self.line, self.start = "end", "", self.row, self.at

    def sees(self, *marks: str) -> bool:
        return self.kind == "mark" and self.text in marks

    def word(self, *names: str) -> bool:
        return self.kind == "name" and self.text in names

    def take(self, mark: str) -> bool:
        found = self.sees(mark) or (self.kind == "name" and self.text == mark)
        if found:
            self.next()
        return found

    def need(self, mark: str) -> None:
        if not self.take(mark):
            raise NotParsed(f"line {self.line}: {mark}")

    def opened(self) -> None:
        self.depth += 1
        if self.depth > DEPTH:
            raise NotParsed("depth")

    def ends(self) -> None:
        """The end of a statement, written or not."""
        if not self.take(";") and not (self.sees("}") or self.kind == "end" or self.fresh):
            raise NotParsed(f"line {self.line}")

    def peek(self) -> tuple[str, str, bool]:
        """Kind and text of the token after this one, and whether a line ends before it."""
        kept = self.kind, self.text, self.line, self.start, self.fresh, self.at, self.row
        self.next()
        found = self.kind, self.text, self.fresh
        self.kind, self.text, self.line, self.start, self.fresh, self.at, self.row = kept
        return found

    # -- statements --

    def program(self) -> Node:
        root = Node("program", 1)
        while self.kind != "end":
            root.kids.append(self.statement())
        return root

    def block(self) -> Node:
        out = Node("block", self.line)
        self.opened()
        self.need("{")
        while not self.sees("}"):
            if self.kind == "end":
                raise NotParsed("open block")
            out.kids.append(self.statement())
        self.next()
        self.depth -= 1
        return out

    def statement(self) -> Node:
        line = self.line
        if self.sees("{"):
            return self.block()
        if self.take(";"):
            return Node("other", line)
        if self.kind == "name":
            if self.text in ("var", "const") or (self.text == "let" and (self.peek()[0] == "name" or self.peek()[1] in ("[", "{"))):
                out = self.declaration()
                self.ends()
                return out
            if self.text == "function" or (self.text == "async" and self.peek()[:2] == ("name", "function") and not self.peek()[2]):
                return self.function(True)
            if self.text == "class":
                return self.class_()
            if self.text == "import" and self.peek()[1] not in ("(", "."):
                return self.import_()
            if f := {"if": self.if_, "for": self.for_, "while": self.while_, "with": self.while_, "do": self.do_, "switch": self.switch_, "try": self.try_, "export": self.export_}.get(self.text):
                return f()
            if self.text in ("return", "throw", "break", "continue", "debugger"):
                jump = self.text
                self.next()
                out = Node("other", line)
                if not (self.sees(";", "}") or self.kind == "end" or self.fresh):
                    out.kids = [self.expression()] if jump in ("return", "throw") else [self.primary()]
                self.ends()
                return out
        found = self.expression()
        if found.kind == "name" and self.take(":"):
            return self.statement()
        self.ends()
        return Node("other", line, None, [found])

    def declaration(self, no_in: bool = False) -> Node:
        out = Node("declare", self.line, self.text)
        self.next()
        while True:
            one = Node("declarator", self.line, None, [self.primary()])
            if self.take("="):
                one.kids.append(self.assignment(no_in))
            out.kids.append(one)
            if not self.take(","):
                return out

    def head(self) -> Node:
        self.need("(")
        found = self.expression()
        self.need(")")
        return found

    def if_(self) -> Node:
        out = Node("other", self.line)
        self.next()
        out.kids = [self.head(), self.statement()]
        if self.take("else"):
            out.kids.append(self.statement())
        return out

    def while_(self) -> Node:
        out = Node("other", self.line)
        self.next()
        out.kids = [self.head(), self.statement()]
        return out

    def do_(self) -> Node:
        out = Node("other", self.line)
        self.next()
        out.kids.append(self.statement())
        self.need("while")
        out.kids.append(self.head())
        self.take(";")
        return out

    def for_(self) -> Node:
        out = Node("block", self.line)
        self.next()
        self.take("await")
        self.need("(")
        if not self.sees(";"):
            declares = self.word("var", "const") or (self.word("let") and (self.peek()[0] == "name" or self.peek()[1] in ("[", "{")))
            out.kids.append(self.declaration(True) if declares else self.expression(True))
        if self.take("of") or self.take("in"):
            out.kids.append(self.expression())
        else:
            for last in (";", ")"):
                self.need(";")
                if not self.sees(last):
                    out.kids.append(self.expression())
        self.need(")")
        out.kids.append(self.statement())
        return out

    def switch_(self) -> Node:
        out = Node("block", self.line)
        self.next()
        out.kids.append(self.head())
        self.need("{")
        while not self.take("}"):
            if self.take("case"):
                out.kids.append(self.expression())
                self.need(":")
            elif self.take("default"):
                self.need(":")
            elif self.kind == "end":
                raise NotParsed("open switch")
            else:
                out.kids.append(self.statement())
        return out

    def try_(self) -> Node:
        out = Node("other", self.line)
        self.next()
        out.kids.append(self.block())
        if self.take("catch"):
            scope = Node("block", self.line)
            if self.take("("):
                scope.kids.append(Node("declare", self.line, "let", [Node("declarator", self.line, None, [self.primary()])]))
                self.need(")")
            scope.kids.append(self.block())
            out.kids.append(scope)
        if self.take("finally"):
            out.kids.append(self.block())
        return out

    def import_(self) -> Node:
        """kids: pairs of the local name and what it stands for (null: the whole module), then the module's literal."""
        out = Node("import", self.line)
        self.next()
        while self.kind != "string":
            if self.take("{"):
                while not self.take("}"):
                    member = self.text
                    self.next()
                    local = member
                    if self.take("as"):
                        local = self.text
                        self.next()
                    out.kids.append(Node("bind", self.line, local, [Node("member", self.line, member)]))
                    if not self.take(",") and not self.sees("}"):
                        raise NotParsed("import")
            elif self.take("*"):
                self.need("as")
                out.kids.append(Node("bind", self.line, self.text))
                self.next()
            elif self.kind == "name" and self.text != "from":
                out.kids.append(Node("bind", self.line, self.text))
                self.next()
            elif not self.take(",") and not self.take("from"):
                raise NotParsed("import")
        out.text = self.text
        out.kids.append(self.primary())
        if self.take("with") or self.take("assert"):
            out.kids.append(self.primary())
        self.ends()
        return out

    def export_(self) -> Node:
        out = Node("other", self.line)
        self.next()
        if self.take("default"):
            if self.word("function", "class") or (self.word("async") and self.peek()[1] == "function"):
                out.kids.append(self.class_() if self.word("class") else self.function(True))
            else:
                out.kids.append(self.assignment())
                self.ends()
        elif self.sees("{", "*"):
            while not (self.sees(";") or self.kind in ("end", "string")) and not (self.fresh and not self.word("from")):
                closes = self.sees("}")
                self.next()
                if closes and not self.word("from"):
                    break
            if self.kind == "string":
                out.kids.append(self.primary())
            self.ends()
        else:
            out.kids.append(self.statement())
        return out

    # -- functions and classes --

    def parameters(self) -> Node:
        out = Node("parameters", self.line)
        self.opened()
        self.need("(")
        while not self.take(")"):
            self.take("...")
            out.kids.append(self.assignment())
            if not self.take(",") and not self.sees(")"):
                raise NotParsed("parameters")
        self.depth -= 1
        return out

    def function(self, declared: bool) -> Node:
        """kids: parameters, body. text: the name, which a declaration binds outside."""
        out = Node("declared" if declared else "function", self.line)
        self.take("async")
        self.need("function")
        self.take("*")
        if self.kind == "name":
            out.text = self.text
            self.next()
        out.kids = [self.parameters(), self.block()]
        return out

    def class_(self) -> Node:
        out = Node("class", self.line)
        self.next()
        if self.kind == "name" and self.text != "extends":
            out.text = self.text
            self.next()
        if self.take("extends"):
            out.kids.append(self.unary())
        self.need("{")
        while not self.take("}"):
            if self.kind == "end":
                raise NotParsed("open class")
            if not self.take(";"):
                out.kids.append(self.member())
        return out

    def member(self) -> Node:
        """A method, field or static block of a class."""
        while self.word("static", "async", "get", "set", "accessor") and self.peek()[1] not in ("(", "=", ";", "}"):
            static = self.word("static")
            self.next()
            if static and self.sees("{"):
                return self.block()
        self.take("*")
        key = self.key()
        if self.sees("("):
            return Node("function", self.line, None, [*key, self.parameters(), self.block()])
        out = Node("other", self.line, None, key)
        if self.take("="):
            out.kids.append(Node("function", self.line, None, [self.assignment()]))
        self.ends()
        return out

    def key(self) -> list[Node]:
        """What a key holds that is more than a name."""
        if self.take("["):
            found = self.assignment()
            self.need("]")
            return [found]
        if self.kind == "string":
            return [self.primary()]
        if self.kind not in ("name", "number"):
            raise NotParsed(f"line {self.line}: key")
        self.next()
        return []

    # -- expressions --

    def expression(self, no_in: bool = False) -> Node:
        found = self.assignment(no_in)
        if self.sees(","):
            found = Node("sequence", found.line, None, [found])
            while self.take(","):
                found.kids.append(self.assignment(no_in))
        return found

    def arrow(self, given: list[Node], line: int) -> Node:
        self.need("=>")
        body = self.block() if self.sees("{") else self.assignment()
        return Node("function", line, None, [Node("parameters", line, None, given), body])

    def assignment(self, no_in: bool = False) -> Node:
        line = self.line
        if self.word("async") and self.peek()[0] == "name" and not self.peek()[2] and self.peek()[1] not in _BINARY:
            if self.peek()[1] == "function":
                return self.rest_of(self.function(False), no_in)
            self.next()
        if self.word("yield"):
            self.next()
            self.take("*")
            ends = self.sees(")", "]", "}", ",", ";", ":") or self.kind == "end" or self.fresh
            return Node("other", line, None, [] if ends else [self.assignment(no_in)])
        if self.take("..."):
            return Node("spread", line, None, [self.assignment(no_in)])
        left = self.conditional(no_in)
        if self.sees("=>"):
            given = left.kids if left.kind in ("group", "sequence") else left.kids[1:] if left.kind == "call" else [left]
            return self.arrow([k for g in given for k in (g.kids if g.kind == "sequence" else [g])], line)
        if self.kind == "mark" and self.text in _ASSIGN:
            op = self.text
            self.next()
            return Node("assign", line, op, [left, self.assignment(no_in)])
        return left

    def rest_of(self, value: Node, no_in: bool) -> Node:
        """An expression that begins with a value already read."""
        return self.choice(self.operators(self.suffixes(value), 0, no_in), no_in)

    def conditional(self, no_in: bool) -> Node:
        return self.choice(self.operators(self.unary(), 0, no_in), no_in)

    def choice(self, test: Node, no_in: bool) -> Node:
        if not self.take("?"):
            return test
        yes = self.assignment()
        self.need(":")
        return Node("other", test.line, None, [test, yes, self.assignment(no_in)])

    def operators(self, left: Node, least: int, no_in: bool) -> Node:
        """Precedence climbing; operands of one level are one node's children, so long sums are not deep."""
        while self.kind in ("mark", "name") and (level := _BINARY.get(self.text, 0)) > least and not (no_in and self.text == "in"):
            found = Node("binary", left.line, self.text, [left])
            while self.kind in ("mark", "name") and _BINARY.get(self.text, 0) == level and not (no_in and self.text == "in"):
                self.next()
                found.kids.append(self.operators(self.unary(), level - (level == 11), no_in))
            left = found
        return left

    def unary(self) -> Node:
        line = self.line
        if self.kind in ("mark", "name") and self.text in _UNARY and not (self.text == "await" and self.peek()[1] in ("=", ",", ")", ";", ".", "=>")):
            op = self.text
            self.next()
            self.opened()
            out = Node("unary", line, op, [self.unary()])
            self.depth -= 1
            return out
        found = self.suffixes(self.primary())
        if self.sees("++", "--") and not self.fresh:
            self.next()
        return found

    def arguments(self) -> list[Node]:
        self.opened()
        self.need("(")
        out = []
        while not self.take(")"):
            out.append(self.assignment())
            if not self.take(",") and not self.sees(")"):
                raise NotParsed(f"line {self.line}: arguments")
        self.depth -= 1
        return out

    def suffixes(self, left: Node, calls: bool = True) -> Node:
        while True:
            line = left.line
            if self.sees(".") or (self.sees("?.") and self.peek()[1] not in ("(", "[", "`")):
                self.next()
                if self.kind != "name":
                    raise NotParsed(f"line {self.line}: member")
                left = Node("member", line, self.text, [left])
                self.next()
                continue
            if self.sees("?."):
                self.next()
            if self.sees("["):
                self.opened()
                self.next()
                left = Node("index", line, None, [left, self.expression()])
                self.need("]")
                self.depth -= 1
            elif self.sees("(") and calls:
                left = Node("call", line, None, [left, *self.arguments()])
            elif self.sees("`"):
                left = Node("other", line, None, [left, self.template()])
            else:
                return left

    def template(self) -> Node:
        out = Node("template", self.line)
        self.opened()
        k = self.at
        while True:
            begin = k
            while k < len(self.source) and self.source[k] != "`" and not self.source.startswith("${", k):
                k += 2 if self.source[k] == "\\" else 1
            if k >= len(self.source):
                raise NotParsed("open template")
            out.kids.append(Node("piece", self.row, cooked(self.source[begin:k])))
            self.row += self.source.count("\n", begin, k)
            if self.source[k] == "`":
                self.at = k + 1
                self.depth -= 1
                self.next()
                return out
            self.at = k + 2
            self.next()
            out.kids.append(self.expression())
            if not self.sees("}"):
                raise NotParsed("template")
            k = self.at

    def primary(self) -> Node:
        line, kind, text = self.line, self.kind, self.text
        if kind == "name":
            if text in ("function",):
                return self.function(False)
            if text == "class":
                return self.class_()
            if text == "new":
                return self.new_()
            if text in ("null", "true", "false"):
                self.next()
                return Node("constant", line, text)
            if text in _RESERVED and text not in ("this", "super", "import"):
                raise NotParsed(f"line {line}: {text}")
            self.next()
            return Node("name", line, text)
        if kind in ("number", "string"):
            self.next()
            return Node(kind, line, text)
        if self.sees("/", "/="):
            m = _REGEX.match(self.source, self.start)
            if not m:
                raise NotParsed(f"line {line}: regular expression")
            self.at = m.end()
            self.next()
            return Node("regex", line, m[0])
        if self.sees("`"):
            return self.template()
        if self.sees("("):
            self.opened()
            self.next()
            out = Node("group", line)
            while not self.take(")"):
                out.kids.append(self.assignment())
                if not self.take(",") and not self.sees(")"):
                    raise NotParsed(f"line {self.line}: group")
            self.depth -= 1
            if not out.kids and not self.sees("=>"):
                raise NotParsed(f"line {line}: empty group")
            return out.kids[0] if len(out.kids) == 1 and not self.sees("=>") else out
        if self.sees("["):
            return self.array()
        if self.sees("{"):
            return self.object_()
        if self.take("@"):  # a decorator, with what it decorates
            return Node("other", line, None, [self.suffixes(self.primary()), self.primary()])
        raise NotParsed(f"line {line}: {text}")

    def new_(self) -> Node:
        line = self.line
        self.next()
        if self.take("."):
            self.next()
            return Node("name", line, "new.target")
        made = self.suffixes(self.new_() if self.word("new") else self.primary(), calls=False)
        return Node("new", line, None, [made, *(self.arguments() if self.sees("(") else [])])

    def array(self) -> Node:
        out = Node("array", self.line)
        self.opened()
        self.next()
        while not self.take("]"):
            if self.sees(","):
                out.kids.append(Node("hole", self.line))
            else:
                out.kids.append(self.assignment())
            if not self.take(",") and not self.sees("]"):
                raise NotParsed(f"line {self.line}: array")
        self.depth -= 1
        return out

    def object_(self) -> Node:
        """kids: property nodes, whose text is the key, and whose last child is the value."""
        out = Node("object", self.line)
        self.opened()
        self.next()
        while not self.take("}"):
            line = self.line
            if self.sees("..."):
                out.kids.append(self.assignment())
            else:
                while self.word("async", "get", "set") and self.peek()[1] not in ("(", ":", ",", "}", "="):
                    self.next()
                self.take("*")
                plain, name = self.kind == "name", self.text
                key = self.key()
                one = Node("property", line, name, key)
                if self.take(":"):
                    one.kids.append(self.assignment())
                elif self.sees("("):
                    one.kids.append(Node("function", line, None, [self.parameters(), self.block()]))
                elif plain:
                    value = Node("name", line, name)
                    one.kids.append(Node("assign", line, "=", [value, self.assignment()]) if self.take("=") else value)
                else:
                    raise NotParsed(f"line {line}: property")
                out.kids.append(one)
            if not self.take(",") and not self.sees("}"):
                raise NotParsed(f"line {self.line}: object")
        self.depth -= 1
        return out


def parse(source: str) -> Node:
    """The tree of a whole source; NotParsed where it has none."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, 20_000))  # DEPTH brackets, each some dozen calls deep
    try:
        return Parser(source).program()
    finally:
        sys.setrecursionlimit(before)
