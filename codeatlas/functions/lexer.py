"""Java and Kotlin texts without their comments and literals, at the same offsets.

One pass over what can open or close something; each character is looked at a bounded number of times. A Kotlin string's
``${...}`` is code again, to any depth. What never closes ends with its line (strings, characters) or with the text (blocks).
"""

from __future__ import annotations

import re

CODE = re.compile(r'//|/\*|"""|"|\'|[{}]')
BLOCK = re.compile(r"/\*|\*/")
CHAR = re.compile(r"'(?:\\u+[0-9a-fA-F]{4}|\\[0-7]{1,3}|\\.|[^'\\\n])'")
INSIDE = {
    ("java", '"'): re.compile(r'\\[^\n]|"|\n'), ("java", '"""'): re.compile(r'\\[\s\S]|"""'),
    ("kotlin", '"'): re.compile(r'\\[^\n]|\$\{|"|\n'), ("kotlin", '"""'): re.compile(r'\$\{|"""+'),
}


def _blank(text: str) -> str:
    return "\n".join(" " * len(line) for line in text.split("\n"))


def spans(source: str, kotlin: bool) -> list[tuple[int, int, bool]]:
    """(start, end, whether a comment) of the comments and literals, in order; the marks of a string's code count as literal."""
    language, found, at, n = "kotlin" if kotlin else "java", [], 0, len(source)
    strings: list[tuple[str, int]] = []  # the strings whose code is being read, and the braces open in it

    def string(quote: str, start: int, at: int) -> int:
        """Goes on in a string from ``at``; gives where code goes on."""
        for m in INSIDE[language, quote].finditer(source, at):
            if m[0][0] == "\\":
                continue
            if m[0] == "${":
                strings.append((quote, 0))
            end = m.start() if m[0] == "\n" else m.end()
            found.append((start, end, False))
            return end
        found.append((start, n, False))
        return n

    while m := CODE.search(source, at):
        what, start, at = m[0], m.start(), m.end()
        if what == "//":
            end = source.find("\n", at)
            at = n if end < 0 else end
            found.append((start, at, True))
        elif what == "/*":
            depth = 1
            while depth and (b := BLOCK.search(source, at)):
                depth = depth - 1 if b[0] == "*/" else depth + kotlin
                at = b.end()
            at = n if depth else at
            found.append((start, at, True))
        elif what == "'":
            if c := CHAR.match(source, start):
                at = c.end()
                found.append((start, at, False))
        elif what[0] == '"':
            at = string(what, start, at)
        elif strings:
            quote, depth = strings.pop()
            if what == "}" and not depth:
                at = string(quote, start, at)
            else:
                strings.append((quote, depth + (1 if what == "{" else -1)))
    return found


def cover(source: str, found: list[tuple[int, int, bool]], literals: bool = True) -> str:
    """``source`` with blanks in place of the comments, and of the literals if wanted; line feeds stay."""
    parts, at = [], 0
    for start, end, comment in found:
        if comment or literals:
            parts += [source[at:start], _blank(source[start:end])]
            at = end
    return "".join([*parts, source[at:]])
