"""A tokenizer for TypeScript and JavaScript, JSX included."""

from __future__ import annotations

import re
from dataclasses import dataclass


class SyntaxProblem(ValueError):
    """The source can't be read; its file keeps its row and has no facts."""


@dataclass(slots=True)
class Token:
    kind: str  # id, num, str, tpl, regex, punct, jsx, end
    text: str
    start: int
    end: int
    fresh: bool  # first on its line


_SPACE = re.compile(r"[ \t\r\f\v\u00a0\ufeff]+")
_NAME = re.compile(r"#?[A-Za-z_$\u0080-\uffff][\w$\u0080-\uffff]*")
_NUMBER = re.compile(r"0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?")
_PUNCT = re.compile(r"\?\?=|\|\|=|&&=|\*\*=|===|!==|\.\.\.|=>|\?\?|\?\.(?!\d)|\|\||&&|==|!=|<=|>=|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|<<|[{}()\[\];,<>+\-*/%&|^!~?:=.@]")
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}
#: Words after which an expression begins, so that a slash or < doesn't divide or compare.
_BEFORE = {"return", "typeof", "instanceof", "in", "of", "new", "delete", "void", "throw", "case", "do", "else", "yield", "await", "default", "extends", "as", "satisfies"}


def unescape(body: str) -> str:
    def one(m: re.Match) -> str:
        s = m[1]
        if s[0] in "ux":
            try:
                return chr(int(s.strip("ux{}"), 16))
            except (ValueError, OverflowError):
                return s
        return "" if s in "\n\r" else _ESCAPES.get(s, s)

    return re.sub(r"\\(u\{[\da-fA-F]+\}|u[\da-fA-F]{4}|x[\da-fA-F]{2}|\r\n|[\s\S])", one, body)


class Lexer:
    def __init__(self, source: str, jsx: bool):
        self.s, self.jsx, self.i = source, jsx, 0
        self.tokens: list[Token] = []
        self.comments: list[tuple[int, int]] = []
        self.fresh = True

    def run(self) -> list[Token]:
        if self.s.startswith("#!"):
            self.i = (self.s + "\n").index("\n")
        self._code(None)
        self.tokens.append(Token("end", "", len(self.s), len(self.s), True))
        return self.tokens

    def _add(self, kind: str, text: str, start: int) -> None:
        self.tokens.append(Token(kind, text, start, self.i, self.fresh))
        self.fresh = False

    def _operand(self) -> bool:
        """Whether an operand may begin here."""
        if not self.tokens:
            return True
        t = self.tokens[-1]
        if t.kind == "id":
            return t.text in _BEFORE and not (len(self.tokens) > 1 and self.tokens[-2].text in (".", "?."))
        return t.kind == "punct" and t.text not in (")", "]", "}", "`)", "++", "--")

    def _code(self, closer: str | None) -> None:
        """Tokens up to the closing brace that matches, if one is given; that brace isn't consumed."""
        s, depth = self.s, 0
        while self.i < len(s):
            c, at = s[self.i], self.i
            if c == "\n":
                self.fresh = True
                self.i += 1
            elif m := _SPACE.match(s, at):
                self.i = m.end()
            elif s.startswith("//", at):
                self.i = s.find("\n", at)
                if self.i < 0:
                    self.i = len(s)
                self.comments.append((at, self.i))
            elif s.startswith("/*", at):
                stop = s.find("*/", at + 2)
                if stop < 0:
                    raise SyntaxProblem("open comment")
                self.i = stop + 2
                self.fresh = self.fresh or "\n" in s[at : self.i]
                self.comments.append((at, self.i))
            elif c in "'\"":
                self._string(c)
            elif c == "`":
                self._template()
            elif m := _NAME.match(s, at):
                self.i = m.end()
                self._add("id", m[0], at)
            elif c.isdigit() or c == "." and s[at + 1 : at + 2].isdigit():
                self.i = _NUMBER.match(s, at).end()
                self._add("num", s[at : self.i], at)
            elif c == "/" and self._operand() and (m := _REGEX.match(s, at)):
                self.i = m.end()
                self._add("regex", m[0], at)
            elif c == "<" and self.jsx and self._operand() and re.match(r"<(?:[A-Za-z_$]|>)", s[at : at + 2]) and not re.match(r"<\s*[\w$]+\s*(?:,|extends\b)", s[at : at + 80]):
                self._element()
            else:
                if c == "{":
                    depth += 1
                elif c == "}":
                    if not depth and closer == "}":
                        return
                    depth -= 1
                m = _PUNCT.match(s, at)
                if not m:
                    raise SyntaxProblem(f"character {c!r} at {at}")
                self.i = m.end()
                self._add("punct", m[0], at)
        if closer:
            raise SyntaxProblem("open brace")

    def _string(self, quote: str) -> None:
        m = re.compile(rf"{quote}((?:[^\\\n{quote}]|\\[\s\S])*){quote}").match(self.s, self.i)
        if not m:
            raise SyntaxProblem(f"open string at {self.i}")
        start, self.i = self.i, m.end()
        self._add("str", unescape(m[1]), start)

    def _template(self) -> None:
        s, start = self.s, self.i
        self.i += 1
        body, parts, holes = self.i, [], 0
        while self.i < len(s):
            c = s[self.i]
            if c == "\\":
                self.i += 2
            elif c == "`":
                self.i += 1
                if holes:
                    self._add("punct", "`)", self.i - 1)
                else:
                    parts.append(s[body : self.i - 1])
                    self._add("tpl", unescape("".join(parts)), start)
                return
            elif s.startswith("${", self.i):
                if not holes:
                    self._add("punct", "`(", start)
                else:
                    self._add("punct", ",", self.i)
                holes += 1
                self.i += 2
                self._code("}")
                self.i += 1
            else:
                self.i += 1
        raise SyntaxProblem("open template")

    def _element(self) -> None:
        """A JSX element: one token, then the tokens of its expressions, each in braces."""
        s, start = self.s, self.i
        self.i += 1
        self._add("jsx", "<", start)
        if self._tag():
            return
        while self.i < len(s):
            if s.startswith("</", self.i):
                stop = s.find(">", self.i)
                if stop < 0:
                    break
                self.i = stop + 1
                self._add("jsx", ">", stop)
                return
            if s[self.i] == "<":
                self._element()
            elif s[self.i] == "{":
                self._hole()
            else:
                self.fresh = self.fresh or s[self.i] == "\n"
                self.i += 1
        raise SyntaxProblem("open element")

    def _hole(self) -> None:
        self.i += 1
        self._add("punct", "{", self.i - 1)
        self._code("}")
        self.i += 1
        self._add("punct", "}", self.i - 1)

    def _tag(self) -> bool:
        """The rest of an opening tag; whether it closes itself."""
        s = self.s
        while self.i < len(s):
            c = s[self.i]
            if s.startswith("/>", self.i):
                self.i += 2
                self._add("jsx", ">", self.i - 1)
                return True
            if c == ">":
                self.i += 1
                return False
            if c == "{":
                self._hole()
            elif c in "'\"":
                stop = s.find(c, self.i + 1)
                if stop < 0:
                    break
                self.i = stop + 1
            elif c == "<":  # type arguments
                depth = 0
                while self.i < len(s):
                    depth += {"<": 1, ">": -1}.get(s[self.i], 0)
                    self.i += 1
                    if not depth:
                        break
            elif s.startswith("/*", self.i):
                self.i = s.find("*/", self.i) + 2 or len(s)
            else:
                self.i += 1
        raise SyntaxProblem("open tag")
