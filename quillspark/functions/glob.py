"""Glob pattern → regular expression, compiled once on the driver (F1).

The result is an anchored regex string that Spark evaluates with ``rlike``
inside whole-stage codegen; no Python runs per row.

Rules (path context, ``/`` is the only separator):

* ``*`` any run of non-separator characters, ``?`` one non-separator character
* ``**`` any run of characters including ``/``; next to a ``/`` it may also
  stand for zero directory levels (``**/x`` matches ``x``, ``a/**/b`` matches
  ``a/b``, ``a/**`` matches ``a/``)
* ``[abc]``, ``[a-z]``, ``[!x]`` / ``[^x]``, ``[[:digit:]]`` classes; a class
  never matches ``/``
* ``{a,b,{c,d}}`` alternation, empty options allowed
* ``\\`` escapes the next character; a trailing ``\\`` is an error
* the whole string must match (``\\A … \\z``)

A pattern is parsed to a small tree of nodes, which is rendered as a regex.
Two dialects are rendered: ``java`` for Spark and ``re2`` for DuckDB oracles;
they differ in how POSIX classes are spelled.
"""

from __future__ import annotations

from dataclasses import dataclass, field


class GlobError(ValueError):
    """Raised for malformed glob patterns."""


# POSIX class names and their Java spellings.
_POSIX_JAVA = {
    "alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}",
    "upper": r"\p{Upper}", "lower": r"\p{Lower}", "space": r"\p{Space}",
    "punct": r"\p{Punct}", "xdigit": r"\p{XDigit}", "blank": r"\p{Blank}",
    "cntrl": r"\p{Cntrl}", "graph": r"\p{Graph}", "print": r"\p{Print}",
    "word": r"\w", "ascii": r"\p{ASCII}",
}


@dataclass(frozen=True)
class Text:
    """One character that stands for itself."""
    char: str


@dataclass(frozen=True)
class Wild:
    """``?``, ``*`` or ``**``."""
    mark: str


@dataclass(frozen=True)
class Members:
    """Character class; ``parts`` are ``("one", c)``, ``("range", a, b)`` and ``("posix", name)``."""
    parts: tuple
    negated: bool


@dataclass
class Choice:
    """``{…}``: each option is a sequence of nodes."""
    options: list = field(default_factory=lambda: [[]])


class _Reader:
    """Pattern characters in order, one ahead."""

    def __init__(self, pattern: str):
        self.pattern, self.rest = pattern, list(reversed(pattern))

    def peek(self) -> str | None:
        return self.rest[-1] if self.rest else None

    def take(self, problem: str = "") -> str:
        if not self.rest:
            self.fail(problem)
        return self.rest.pop()

    def accept(self, chars: str) -> bool:
        if self.rest and self.rest[-1] in chars:
            self.rest.pop()
            return True
        return False

    def fail(self, problem: str):
        raise GlobError(f"glob {self.pattern!r}: {problem}")


def parse(pattern: str) -> list:
    """Pattern → node sequence.  An open ``{`` is a :class:`Choice` on a stack whose last option takes the nodes."""
    src, root, stack = _Reader(pattern), [], []
    while (c := src.peek()) is not None:
        src.take()
        here = stack[-1].options[-1] if stack else root
        if c == "\\":
            here.append(Text(src.take("nothing follows the last backslash")))
        elif c in "?*":
            here.append(Wild("**" if c == "*" and src.accept("*") else c))
        elif c == "[":
            here.append(_members(src))
        elif c == "{":
            stack.append(Choice())
            here.append(stack[-1])
        elif c == "}" and stack:
            stack.pop()
        elif c == "," and stack:
            stack[-1].options.append([])
        else:
            here.append(Text(c))
    if stack:
        src.fail("a brace is not closed")
    return root


def _members(src: _Reader) -> Members:
    open_class = "a bracket is not closed"
    negated, parts = src.accept("!^"), []
    if src.peek() == "]":
        src.fail("a bracket holds nothing")
    while (c := src.take(open_class)) != "]":
        if c == "[" and src.accept(":"):
            name = ""
            while not name.endswith(":]"):
                name += src.take(open_class)
            parts.append(("posix", name[:-2]))
        elif c == "-" and parts and parts[-1][0] == "one" and src.peek() not in ("]", None):
            end = src.take()
            parts.append(("range", parts.pop()[1], src.take(open_class) if end == "\\" else end))
        else:
            parts.append(("one", src.take(open_class) if c == "\\" else c))
    if unknown := [p[1] for p in parts if p[0] == "posix" and p[1] not in _POSIX_JAVA]:
        src.fail(f"{unknown[0]!r} is no POSIX class")
    return Members(tuple(parts), negated)


def _render_text(char: str) -> str:
    return char if char.isalnum() or char in "/_-, ~@#%&=:;<>!'\"`" or ord(char) > 127 else "\\" + char


def _render_member(char: str) -> str:
    return "\\" + char if char in r"\]^-[&" else char


def _render_members(node: Members, dialect: str) -> str:
    """A class never takes the separator: not as a member, and not through a negation."""
    body = ""
    for kind, *what in node.parts:
        if kind == "posix":
            body += _POSIX_JAVA[what[0]] if dialect == "java" else f"[:{what[0]}:]"
        elif kind == "range":
            low, high = what
            spans = [(low, high)] if not low <= "/" <= high else [(low, "."), ("0", high)]
            body += "".join(f"{_render_member(a)}-{_render_member(b)}" for a, b in spans if a <= b)
        elif what[0] != "/":
            body += _render_member(what[0])
    if node.negated:
        return f"[^/{body}]"
    return f"[{body}]" if body else r"[^\x00-" + "\U0010ffff]"


def _is_separator(node) -> bool:
    return isinstance(node, Text) and node.char == "/"


def _render(nodes: list, dialect: str) -> str:
    """Regex of a node sequence.  ``**`` takes the separators beside it along: each may stand for no directory at all."""
    out, at = "", 0
    while at < len(nodes):
        node = nodes[at]
        deep = [isinstance(n, Wild) and n.mark == "**" for n in nodes[at:at + 2]]
        if _is_separator(node) and deep[1:] == [True] and at + 2 < len(nodes) and _is_separator(nodes[at + 2]):
            out, at = out + "/(?:(?s:.*)/)?", at + 3
        elif deep[0] and at + 1 < len(nodes) and _is_separator(nodes[at + 1]):
            out, at = out + "(?:(?s:.*)/)?", at + 2
        else:
            if isinstance(node, Text):
                out += _render_text(node.char)
            elif isinstance(node, Members):
                out += _render_members(node, dialect)
            elif isinstance(node, Choice):
                out += "(?:" + "|".join(_render(option, dialect) for option in node.options) + ")"
            else:
                out += {"?": "[^/]", "*": "[^/]*", "**": "(?s:.*)"}[node.mark]
            at += 1
    return out


def glob_to_regex(pattern: str, dialect: str = "java") -> str:
    """Anchored regex for ``pattern``; raises :class:`GlobError` when malformed."""
    if dialect not in ("java", "re2"):
        raise ValueError(dialect)
    return rf"\A{_render(parse(pattern), dialect)}\z"


def pattern_to_regex(pattern: str, dialect: str = "java") -> str | None:
    """Exclude-pattern form: ``glb:`` prefix = glob, otherwise a search regex.

    Blank patterns give ``None`` (skipped).
    """
    p = pattern.strip()
    if not p:
        return None
    if p.startswith("glb:"):
        return glob_to_regex(p[4:], dialect)
    return p
