"""POSIX basic regular expressions as Java patterns."""

from __future__ import annotations

import re

# POSIX class names and the Java classes with the same members.
POSIX_CLASSES = {
    "alnum": r"\p{Alnum}",
    "alpha": r"\p{Alpha}",
    "blank": r"\p{Blank}",
    "cntrl": r"\p{Cntrl}",
    "digit": r"\p{Digit}",
    "graph": r"\p{Graph}",
    "lower": r"\p{Lower}",
    "print": r"\p{Print}",
    "punct": r"\p{Punct}",
    "space": r"\p{Space}",
    "upper": r"\p{Upper}",
    "xdigit": r"\p{XDigit}",
}

# Escaped characters that assert a place or stand for a class.
ESCAPED_ASSERTIONS = {
    "<": r"\b(?=\w)",
    ">": r"\b(?<=\w)",
    "b": r"\b",
    "B": r"\B",
    "w": r"\w",
    "W": r"\W",
    "s": r"\s",
    "S": r"\S",
}


def _bracket(pattern: str, start: int) -> tuple[str, int]:
    """Translate the bracket expression that opens at ``start``; also where it ends."""
    at = start + 1
    out = "["
    if pattern[at : at + 1] == "^":
        out += "^"
        at += 1
    first = True
    while at < len(pattern):
        posix = re.compile(r"\[:(\w+):\]").match(pattern, at)
        if posix:
            out += POSIX_CLASSES[posix.group(1)]
            at = posix.end()
        elif pattern[at] == "]" and not first:
            return out + "]", at + 1
        else:
            out += "\\" + pattern[at] if pattern[at] in r"\[]&^" else pattern[at]
            at += 1
        first = False
    raise ValueError(f"unclosed bracket in {pattern!r}")


class _Atoms:
    """A Java pattern in the making: atoms, each with whether it is quantified already."""

    def __init__(self):
        self.open: list[list[list[tuple[str, str]]]] = [[[]]]  # groups, their alternatives, their atoms

    @property
    def here(self) -> list[tuple[str, str]]:
        return self.open[-1][-1]

    def add(self, atom: str) -> None:
        self.here.append((atom, ""))

    def quantify(self, quantifier: str) -> None:
        """A quantifier on a quantified atom repeats the whole; Java would make it possessive or refuse it."""
        atom, before = self.here[-1]
        if before:
            if before == quantifier == "*":
                return
            atom = f"(?:{atom}{before})"
        self.here[-1] = (atom, quantifier)

    @staticmethod
    def _joined(alternatives: list[list[tuple[str, str]]]) -> str:
        return "|".join("".join(map("".join, atoms)) for atoms in alternatives)

    def close(self) -> None:
        if len(self.open) == 1:
            raise ValueError("unmatched \\)")
        self.add(f"({self._joined(self.open.pop())})")

    def text(self) -> str:
        if len(self.open) > 1:
            raise ValueError("unmatched \\(")
        return self._joined(self.open[0])


def basic_to_java(pattern: str) -> str:
    """The Java pattern that finds what the basic regular expression finds.

    Only a line feed ends a line, so a carriage return is an ordinary character.
    """
    out = _Atoms()
    at = 0
    opening = True  # at the start of the pattern, of a group or of an alternative
    while at < len(pattern):
        char = pattern[at]
        rest = pattern[at + 1 :]
        if char == "\\" and rest:
            escaped = rest[0]
            at += 2
            if escaped == "(":
                out.open.append([[]])
                opening = True
                continue
            if escaped == "|":
                out.open[-1].append([])
                opening = True
                continue
            if escaped == ")":
                out.close()
            elif escaped in "+?{" and not opening:
                if escaped == "{":
                    end = pattern.find("\\}", at)
                    bounds = re.fullmatch(r"(\d*)(,?)(\d*)", pattern[at:end]) if end >= 0 else None
                    if bounds is None or not (bounds[1] or bounds[2]):
                        raise ValueError(f"bad interval in {pattern!r}")
                    out.quantify("{" + (bounds[1] or "0") + bounds[2] + bounds[3] + "}")
                    at = end + 2
                else:
                    out.quantify(escaped)
            elif escaped in ESCAPED_ASSERTIONS:
                out.add(ESCAPED_ASSERTIONS[escaped])
            elif escaped.isdigit():
                out.add(f"(?:\\{escaped})")
            else:
                out.add(re.escape(escaped))
        elif char == "[":
            piece, at = _bracket(pattern, at)
            out.add(piece)
        else:
            at += 1
            if char == "*" and not opening:
                out.quantify("*")
            elif char == "^" and opening:
                out.add("^")
                continue
            elif char == "." or (char == "$" and (not rest or rest.startswith(("\\)", "\\|")))):
                out.add(char)
            else:
                out.add("\\" + char if char in r".^$*+?{}()|[]\\" else char)
        opening = False
    return "(?d)" + out.text()


def java_pattern(pattern: str, syntax: str) -> str:
    """``pattern`` in ``bre``, ``java`` or ``fixed`` syntax, as a Java pattern."""
    if syntax == "java":
        return pattern
    if syntax == "bre":
        return basic_to_java(pattern)
    if syntax == "fixed":
        return re.sub(r"([^\w\s])", r"\\\1", pattern)
    raise ValueError(f"unknown pattern syntax {syntax!r}")
