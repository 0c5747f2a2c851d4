"""Facts of Rust sources: a lexer and an item parser in plain Python.

Indexed are functions, structs, enums, traits, constants, trait and impl methods and inline
modules; statics, type aliases, unions, macros, uses, enum variants, fields and functions within
bodies are not. Calls are ``path(...)`` and ``receiver.method(...)`` in bodies, those of nested
functions and closures counting for the outer one; what stands in a macro call is not looked at.

A file that can't be lexed or whose brackets don't match yields nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import CONST, ENUM, FN, IMPL, METHOD, SITE, STRUCT, TRAIT
from ..store import ship, written

#: Fixed value: characters of a doc line that are kept.
DOC_MOST = 100

_TOKEN = re.compile(
    r"""(?P<space>\s+)
    |(?P<doc>//[/!](?!/)[^\n]*|/\*[*!](?![*/]))
    |(?P<comment>//[^\n]*|/\*)
    |(?P<raw>b?c?r(?P<hash>\#*)")
    |(?P<str>[bc]?"(?:[^"\\]|\\.)*")
    |(?P<char>b?'(?:[^'\\\n]|\\(?:u\{[0-9a-fA-F_]+\}|x[0-9a-fA-F]{2}|.))')
    |(?P<life>'[A-Za-z_]\w*)
    |(?P<ident>(?:r\#)?[^\W\d]\w*)
    |(?P<num>\d[\w]*(?:\.\d[\w]*)?(?:[eE][+-]\d+)?)
    |(?P<punct>::|->|=>|\.\.=|\.\.\.|\.\.|<<=|>>=|&&|\|\||[-+*/%^&|=!<>]=|.)""",
    re.X | re.S,
)
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_NOT_CALLED = frozenset("if while for match return in as move loop else let mut ref box await async unsafe where fn impl dyn".split())


class ParseError(ValueError):
    """A source that can't be read as Rust."""


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    line: int
    col: int


def lex(src: str) -> list[Token]:
    """The tokens without white space and comments; doc comments stay, as ``doc`` tokens."""
    out: list[Token] = []
    at, line, start, n = 0, 1, 0, len(src)
    if src.startswith("#!") and not src.startswith("#!["):
        at = src.find("\n") % (n + 1)
    while at < n:
        m = _TOKEN.match(src, at)
        kind, text, end = m.lastgroup, m.group(), m.end()
        if kind == "hash" or m["raw"] is not None:
            kind, end = "str", src.find('"' + m["hash"], end)
            if end < 0:
                raise ParseError("open raw string")
            end += 1 + len(m["hash"])
            text = src[at:end]
        elif text.startswith("/*"):
            depth, p = 1, at + 2
            while depth:
                mm = re.compile(r"/\*|\*/").search(src, p)
                if not mm:
                    raise ParseError("open comment")
                depth += 1 if mm.group() == "/*" else -1
                p = mm.end()
            end, text = p, src[at:p]
        elif kind == "punct" and text in "'\"":
            raise ParseError("open literal")
        if kind not in ("space", "comment"):
            out.append(Token(kind, text, line, at - start))
        if (breaks := text.count("\n")):
            line += breaks
            start = at + text.rindex("\n") + 1
        at = end
    return out


def _matching(tokens: list[Token]) -> dict[int, int]:
    """The place of each opening bracket's closing one."""
    stack, out = [], {}
    for i, t in enumerate(tokens):
        if t.kind != "punct":
            continue
        if t.text in _OPEN:
            stack.append(i)
        elif t.text in _CLOSE:
            if not stack or _OPEN[tokens[stack[-1]].text] != t.text:
                raise ParseError(f"bracket at line {t.line}")
            out[stack.pop()] = i
    if stack:
        raise ParseError("open bracket")
    return out


def _name(text: str) -> str:
    return text.removeprefix("r#")


@dataclass
class Extract:
    """The facts of one file, by item order; ``sites`` name their caller by its place in ``syms``."""

    syms: list[dict] = field(default_factory=list)
    impls: list[tuple[str, str, int]] = field(default_factory=list)
    sites: list[tuple[int, str, str, int, int, int]] = field(default_factory=list)


#: Tokens of a signature that no space stands before, and after.
_TIGHT_BEFORE = frozenset([")", "]", ">", ",", ";", ":", "::", "(", "<"])
_TIGHT_AFTER = frozenset(["(", "[", "<", "&", "&&", "::"])


def spaced(tokens: list[Token]) -> str:
    """A signature in one line: neighbouring tokens are one space apart unless either is tight."""
    texts = [t.text for t in tokens if t.kind != "doc"]
    out = texts[:1]
    for left, right in zip(texts, texts[1:]):
        if left not in _TIGHT_AFTER and right not in _TIGHT_BEFORE:
            out.append(" ")
        out.append(right)
    return "".join(out)


class _Parser:
    def __init__(self, src: str):
        self.tokens = lex(src)
        self.ends = _matching(self.tokens)
        self.out = Extract()

    def text(self, i: int) -> str:
        return self.tokens[i].text if i < len(self.tokens) else ""

    def angle(self, i: int) -> int:
        """The place after a generic list that begins here, or the same place."""
        if self.text(i) != "<":
            return i
        depth = 0
        while i < len(self.tokens):
            t = self.text(i)
            if t in _OPEN:
                i = self.ends[i]
            elif t == "<":
                depth += 1
            elif t in (">", ">=", ">>="):
                depth -= 1
            if depth == 0:
                return i + 1
            i += 1
        raise ParseError("open generics")

    def items(self, at: int, stop: int, module: list[str], container: str | None, in_test: bool, trait: bool) -> None:
        """The items between two places. ``container`` is set within impls and traits."""
        while at < stop:
            begin, docs, attrs = at, [], []
            while at < stop:
                t = self.tokens[at]
                if t.kind == "doc":
                    if t.text[2] != "!":
                        docs.append(t.text)
                    at += 1
                elif t.text == "#" and self.text(at + 1) in ("[", "!"):
                    bracket = at + 1 + (self.text(at + 1) == "!")
                    if bracket not in self.ends:
                        raise ParseError("attribute")
                    attrs.append(self.tokens[bracket + 1 : self.ends[bracket]])
                    at = self.ends[bracket] + 1
                else:
                    break
            if at >= stop:
                return
            at = max(begin + 1, self.item(at, stop, docs, attrs, module, container, in_test, trait))

    def item(self, at: int, stop: int, docs: list[str], attrs: list[list[Token]], module: list[str], container: str | None, in_test: bool, trait: bool) -> int:
        vis = 3
        if self.text(at) == "pub":
            vis, at = 0, at + 1
            if self.text(at) == "(":
                inner = [t.text for t in self.tokens[at + 1 : self.ends[at]]]
                if inner and inner[0] in ("crate", "super", "self", "in"):
                    vis, at = 1 if inner == ["crate"] else 2, self.ends[at] + 1
        first, is_async = at, 0
        while self.text(at) in ("async", "unsafe", "default", "extern", "const", "safe") and not (
            self.text(at) == "const" and self.text(at + 1) not in ("fn", "async", "unsafe", "extern")
        ):
            if self.text(at) in ("unsafe", "default", "safe") and self.tokens[at + 1].text not in ("fn", "impl", "trait", "extern", "async", "const", "unsafe", "mod"):
                break
            is_async |= self.text(at) == "async"
            at += 1
            if self.tokens[at].kind == "str":
                at += 1
        word = self.text(at)
        is_test = in_test or any(_last_segment(a) == "test" for a in attrs)
        if word == "fn" and at + 1 < stop:
            return self.function(first, at, docs, module, container, vis if not trait else 0, int(is_async), is_test)
        if word in ("struct", "enum") and container is None and self.tokens[at + 1].kind == "ident":
            end = self.closing(at + 2, stop)
            self.symbol(self.tokens[at + 1], STRUCT if word == "struct" else ENUM, vis, 0, is_test, module, "", "", docs, self.tokens[end].line)
            return end + 1
        if word == "const" and container is None and self.tokens[at + 1].kind == "ident":
            end = self.semicolon(at, stop)
            self.symbol(self.tokens[at + 1], CONST, vis, 0, is_test, module, "", "", docs, self.tokens[end].line)
            return end + 1
        if word == "trait" and container is None:
            brace = self.brace(at, stop)
            if brace is None:
                return self.semicolon(at, stop) + 1
            end = self.ends[brace]
            self.symbol(self.tokens[at + 1], TRAIT, vis, 0, is_test, module, "", "", docs, self.tokens[end].line)
            self.items(brace + 1, end, module, _name(self.text(at + 1)), in_test, True)
            return end + 1
        if word == "impl" and container is None:
            return self.implementation(at, stop, module, in_test)
        if word == "mod" and container is None and self.text(at + 2) == "{":
            end = self.ends[at + 2]
            test = in_test or any(a and a[0].text == "cfg" and "test" in "".join(t.text for t in a) for a in attrs)
            self.items(at + 3, end, [*module, _name(self.text(at + 1))], None, test, False)
            return end + 1
        if self.text(at + 1) == "!" or (self.tokens[at].kind == "ident" and self.text(at + 1) == "::"):  # a macro
            while at < stop and self.text(at) not in _OPEN:
                at += 1
            if at >= stop:
                return stop
            end = self.ends[at]
            return end + 1 + (self.text(at) != "{" and self.text(end + 1) == ";")
        if word == "extern" or (word == "{" and self.text(at - 1) != "="):
            brace = self.brace(at, stop)
            return self.ends[brace] + 1 if brace is not None else self.semicolon(at, stop) + 1
        if word == "union":
            return self.closing(at + 2, stop) + 1
        return self.semicolon(at, stop) + 1

    def brace(self, at: int, stop: int) -> int | None:
        """The brace that opens an item's body, None if a semicolon comes first."""
        while at < stop:
            t = self.text(at)
            if t == "{":
                return at
            if t == ";":
                return None
            at = self.ends[at] + 1 if t in _OPEN else at + 1
        return None

    def closing(self, at: int, stop: int) -> int:
        brace = self.brace(at, stop)
        return self.ends[brace] if brace is not None else self.semicolon(at, stop)

    def semicolon(self, at: int, stop: int) -> int:
        while at < stop and self.text(at) != ";":
            at = self.ends[at] + 1 if self.text(at) in _OPEN else at + 1
        return min(at, stop - 1)

    def symbol(self, ident: Token, kind: int, vis: int, is_async: int, is_test: bool, module: list[str], container: str, sig: str, docs: list[str], end: int) -> int:
        self.out.syms.append(
            {
                "name": _name(ident.text), "kind": kind, "vis": vis, "is_async": is_async, "is_test": int(is_test), "module": "::".join(module),
                "container": container, "sig": sig, "doc": _doc(docs), "line": ident.line, "end_line": end, "col": ident.col,
            }
        )
        return len(self.out.syms) - 1

    def function(self, first: int, at: int, docs: list[str], module: list[str], container: str | None, vis: int, is_async: int, is_test: bool) -> int:
        ident, p = self.tokens[at + 1], self.angle(at + 2)
        if self.text(p) != "(":
            raise ParseError("function")
        brace = self.brace(self.ends[p] + 1, len(self.tokens))
        end = self.ends[brace] if brace is not None else self.semicolon(p, len(self.tokens))
        sig = spaced(self.tokens[first : brace if brace is not None else end])
        kind = FN if container is None else METHOD
        caller = self.symbol(ident, kind, vis, is_async, is_test, module, container or "", sig, docs, self.tokens[end].line)
        if brace is not None:
            self.calls(brace + 1, end, caller)
        return end + 1

    def implementation(self, at: int, stop: int, module: list[str], in_test: bool) -> int:
        p = self.angle(at + 1)
        brace = self.brace(p, stop)
        if brace is None:
            return self.semicolon(at, stop) + 1
        head, depth, cut, where = self.tokens[p:brace], 0, None, len(self.tokens[p:brace])
        for i, t in enumerate(head):
            depth += (t.text in ("<", "(", "[")) - (t.text in (">", ")", "]"))
            if depth == 0 and t.text == "for" and cut is None:
                cut = i
            elif depth == 0 and t.text == "where":
                where = i
                break
        own = head[(cut + 1 if cut is not None else 0) : where]
        target = type_name(own)
        if cut is not None:
            path = [t for t in head[:cut] if t.text not in ("!", "?", "const")]
            self.out.impls.append((_path_end(path), target, self.tokens[at].line))
        self.items(brace + 1, self.ends[brace], module, target, in_test, False)
        return self.ends[brace] + 1

    def calls(self, at: int, stop: int, caller: int) -> None:
        """The call-sites of a body."""
        tokens = self.tokens
        while at < stop:
            t = tokens[at]
            if t.text == "#" and self.text(at + 1) == "[":  # an attribute
                at = self.ends[at + 1] + 1
                continue
            if t.kind != "ident":
                at += 1
                continue
            after = at + 1
            if self.text(after) == "!" and self.text(after + 1) in _OPEN:  # a macro: not looked at
                at = self.ends[after + 1] + 1
                continue
            if t.text == "macro_rules" and self.text(after) == "!":
                brace = self.brace(after, stop)
                at = self.ends[brace] + 1 if brace is not None else stop
                continue
            if t.text == "fn" and tokens[after].kind == "ident":  # a nested function: its body only
                p = self.angle(after + 1)
                at = p
                continue
            if self.text(after) == "::" and self.text(after + 1) == "<":  # turbofish
                after = self.angle(after + 1)
            if self.text(after) == "(" and t.text not in _NOT_CALLED:
                before = self.text(at - 1)
                name = _name(t.text)
                if before == ".":
                    self.out.sites.append((caller, name, "", 1, t.line, t.col))
                elif before != "fn":
                    self.out.sites.append((caller, name, self.qualifier(at), 0, t.line, t.col))
            at += 1

    def qualifier(self, at: int) -> str:
        """The path segment before a called name, empty if there is none."""
        if self.text(at - 1) != "::":
            return ""
        p = at - 2
        if self.text(p) in (">", ">>"):
            depth = 0
            while p >= 0:
                depth += {">": 1, ">>": 2, "<": -1}.get(self.text(p), 0)
                if depth <= 0:
                    break
                p -= 1
            p -= 1 + (self.text(p - 1) == "::")
        return _name(self.text(p)) if p >= 0 and self.tokens[p].kind == "ident" and self.text(p) not in _NOT_CALLED else ""


def _last_segment(attribute: list[Token]) -> str:
    last = ""
    for t in attribute:
        if t.kind == "ident":
            last = t.text
        elif t.text != "::":
            break
    return last


def _path_end(tokens: list[Token]) -> str:
    """The last segment of a path, without its generics."""
    depth, last = 0, ""
    for t in tokens:
        depth += (t.text in ("<", "(")) - (t.text in (">", ")"))
        if depth == 0 and t.kind == "ident":
            last = t.text
    return _name(last)


def type_name(tokens: list[Token]) -> str:
    """A type's text up to its first ``<``, without spaces."""
    return "".join(t.text for t in tokens).split("<")[0].replace(" ", "")


def _doc(docs: list[str]) -> str:
    """The first doc line with text, trimmed and cut."""
    for d in docs:
        body = d[3:] if d.startswith("//") else d[3:-2]
        for line in body.split("\n"):
            text = line.strip().removeprefix("* ").strip() if d.startswith("/*") else line.strip()
            if text and text != "*":
                return text[:DOC_MOST]
    return ""


def parse(src: str) -> Extract:
    """The facts of a source; raises ParseError."""
    parser = _Parser(src)
    parser.items(0, len(parser.tokens), [], None, False, False)
    return parser.out


def fnv1a(text: str) -> int:
    h = 2166136261
    for b in text.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h ^ 1 if h == 0xFFFFFFFF else h


def key(*parts: object) -> int:
    """An id: 63 bits of a hash of the parts."""
    return int.from_bytes(hashlib.sha256("\0".join(map(str, parts)).encode("utf-8", "surrogatepass")).digest()[:8], "big") >> 1


def file_key(path: str) -> int:
    return key("file", path)


_FACT = "tag string, path string, crate_ string, " + ", ".join(
    f"{n} {t}" for n, t in (("file_id", "long"), ("a", "long"), ("b", "long"), ("s1", "string"), ("s2", "string"), ("s3", "string"), ("s4", "string"), ("s5", "string"), ("i1", "int"), ("i2", "int"), ("i3", "int"), ("i4", "int"), ("i5", "int"), ("i6", "int"))
)
_COLS = [x.split()[0] for x in _FACT.split(", ")]


def facts_of(path: str, crate: str, src: str) -> list[tuple]:
    """The rows of one file, with a tag that says which table they are of."""
    try:
        got = parse(src)
    except (ParseError, IndexError):
        return []
    fid = file_key(path)
    loc = len(src.split("\n")) - (src.endswith("\n") or not src)
    rows = [("file", path, crate, fid, fnv1a(src), None, None, None, None, None, None, 0, loc, None, None, None, None)]
    ids = [key("sym", path, i) for i in range(len(got.syms))]
    for i, s in zip(ids, got.syms):
        rows.append(("sym", path, crate, fid, i, s["col"], s["name"], s["module"], s["container"], s["sig"], s["doc"], s["kind"], s["vis"], s["is_async"], s["is_test"], s["line"], s["end_line"]))
    for i, (caller, name, qual, method, line, col) in enumerate(got.sites):
        rows.append(("site", path, crate, fid, key("site", path, i), ids[caller], name, qual, None, None, None, method, line, col, None, None, None))
    for name, target, line in got.impls:
        rows.append(("impl", path, crate, fid, None, None, name, target, None, None, None, line, None, None, None, None, None))
    return rows


def tagged(sources: DataFrame) -> DataFrame:
    """The facts of sources (path, crate_, text) as rows with a tag: one pass in Python workers."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [r for p, c, t in zip(part["path"], part["crate_"], part["text"]) for r in facts_of(p, c, t)]
            frame = pd.DataFrame(rows, columns=_COLS, dtype=object)  # floats would round the ids
            for c in ("a", "b", "i1", "i2", "i3", "i4", "i5", "i6"):
                frame[c] = frame[c].astype("Int64")
            yield frame

    ship(sources.sparkSession)
    return sources.select("path", "crate_", "text").mapInPandas(run, _FACT)


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(file, sym with ``col``, site, impl) of tagged rows. Write them first: each of the four reads
    them, and must not parse the sources again."""
    c = F.col
    file = rows.where("tag = 'file'").select("file_id", "path", "crate_", c("i1").alias("lang"), c("i2").alias("loc"), c("a").alias("hash"))
    sym = rows.where("tag = 'sym'").select(
        c("a").alias("sym_id"), c("s1").alias("name"), c("i1").alias("kind"), c("i2").alias("vis"), c("i3").alias("is_async"), c("i4").alias("is_test"), "file_id",
        c("s2").alias("module"), "crate_", c("s3").alias("container"), F.lit("").alias("symbol"), c("s4").alias("sig"), c("s5").alias("doc"),
        c("i5").alias("line"), c("i6").alias("end_line"), c("b").cast("int").alias("col"),
    )
    site = rows.where("tag = 'site'").select(
        c("a").alias("call_id"), c("b").alias("caller"), c("s1").alias("callee"), c("s2").alias("qual"), c("i1").alias("is_method"), "file_id", c("i2").alias("line"), c("i3").alias("col")
    ).select(*SITE.fieldNames())
    impl = rows.where("tag = 'impl'").select(c("s1").alias("trait_name"), c("s2").alias("type_name"), "file_id", c("i1").alias("line")).select(*IMPL.fieldNames())
    return file, sym, site, impl


def extract(sources: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(file, sym, site, impl) of sources, each of which is parsed once."""
    return split(written(tagged(sources), "tagged", keep))
