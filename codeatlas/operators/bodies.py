"""Helpers that match braces: one linear scan for each file, in Arrow batches.

A method's text (``bodies_of``) counts every brace of the text that it is given; members and calls are read from texts without
comments and literals.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeatlas.functions import lexer, rules
from codeatlas.operators import parse

# Characters that may stand between a line's start and a method's name; words that look like calls.
BEFORE_NAME = re.compile(r"[\w<>\[\]?,\s]+")
BEFORE_BODY = re.compile(r"[({};]")
NOT_DECLARED = re.compile(r"(?:\.|(?<!\w)new(?!\w))\s*")
STOP, FUN = re.compile(r"[(){};=]"), re.compile(r"(?<!\w)fun(?!\w)")
CALL = re.compile(r"(?<!\w)(\w++)\s*\(")
SLICE = 256  # texts of a batch that are Python strings at once
NOT_CALLS = {"if", "for", "while", "switch", "catch", "synchronized", "when", "return"}


def as_python(pattern: str) -> re.Pattern:
    """A pattern of the parser for the scans here: classes are Unicode there by a flag, here always."""
    return re.compile(re.sub(r"^\(\?U\)", "", pattern))


CLASS_HEAD, METHOD_HEAD, FIELD_HEAD = as_python(parse.CLASS), as_python(parse.METHOD), as_python(parse.FIELD)


def brace_ends(source: str, pair: str = "{}") -> dict[int, int]:
    """Offset of each opening brace -> offset after its closing brace (the text's end if it never closes)."""
    ends, stack = {}, []
    for m in re.finditer(f"[{re.escape(pair)}]", source):
        if m[0] == pair[0]:
            stack.append(m.start())
        elif stack:
            ends[stack.pop()] = m.end()
    return ends | dict.fromkeys(stack, len(source))


def bodies_of(source: str, names: set[str]) -> dict[str, str]:
    """For each name the text from its first ``name(`` with what leads to it, to the end of the next braces; '' without any.

    One look at every ``word(`` finds the names that end a word (a name may be the end of a longer word).
    """
    ends, places = brace_ends(source), {}
    sizes = sorted({len(n) for n in names})
    for m in CALL.finditer(source):
        for size in sizes:
            tail = m[1][-size:]
            if len(tail) == size and tail in names and tail not in places:
                places[tail] = m.end(1) - size, m.end()
        if len(places) == len(names):
            break
    runs = [m.span() for m in BEFORE_NAME.finditer(source)]
    found = dict.fromkeys(names, "")
    for name, (start, after) in places.items():
        brace = source.find("{", after)
        if brace < 0:
            continue
        if start and source[start - 1].isspace():
            line = runs[bisect_right(runs, (start, -1)) - 1][0]
            start = line if start - line > 1 else start
        found[name] = source[start : ends[brace]].strip()
    return found


def method_bodies(source: Column, names: Column) -> Column:
    """One text for each name of the array, '' where a method has no body.

    A batch stays in Arrow but for ``SLICE`` texts at a time. Declared as not deterministic, or Spark would infer a filter from an explode of the
    texts and make them twice, in two workers for each task.
    """

    @F.arrow_udf("array<string>")
    def bodies(sources: pa.Array, wanted: pa.Array) -> pa.Array:
        parts = [pa.array([], pa.list_(pa.string()))]
        for at in range(0, len(sources), SLICE):
            out = []
            for text, methods in zip(sources.slice(at, SLICE).to_pylist(), wanted.slice(at, SLICE).to_pylist()):
                known = bodies_of(text or "", set(methods))
                out.append([known[n] for n in methods])
            parts.append(pa.array(out, pa.list_(pa.string())))
        return pa.concat_arrays(parts)

    return bodies.asNondeterministic()(source, names)


def _declares(code: str, kotlin: bool):
    """Whether a head at an offset declares a method: after ``fun`` in Kotlin, not after ``new`` or a dot in Java."""
    if not kotlin:
        used = {m.end() for m in NOT_DECLARED.finditer(code)}
        return lambda at: at not in used
    stops, funs = [m.start() for m in STOP.finditer(code)], [m.start() for m in FUN.finditer(code)]
    last = lambda places, at: places[k - 1] if (k := bisect_right(places, at)) else -1
    return lambda at: last(funs, at) > last(stops, at - 1)


def declared_methods(code: str, kotlin: bool, ends: dict[int, int]) -> list[tuple[str, int, int]]:
    """(name, where the body opens, where it ends) of the methods that a text without comments and literals declares."""
    declares = _declares(code, kotlin)
    return [(m[1], m.end() - 1, ends[m.end() - 1]) for m in METHOD_HEAD.finditer(code) if m[1] not in NOT_CALLS and declares(m.start())]


def calls_of(source: str, language: str) -> list[tuple[str, list[str]]]:
    """(method, names called) for each method with a body: a call counts for all methods around it, a declaration is none."""
    kotlin = language == "kotlin"
    code = lexer.cover(source, lexer.spans(source, kotlin))
    ends, declares = brace_ends(code), _declares(code, kotlin)
    heads = {m.start(): (m[1], m.end() - 1) for m in METHOD_HEAD.finditer(code) if m[1] not in NOT_CALLS and declares(m.start())}
    found, stack = [], []  # open methods: where the body ends, the name, the names called

    def close(at: int) -> None:
        while stack and stack[-1][0] <= at:
            _, name, names = stack.pop()
            found.append((name, sorted(names - {name})))
            if stack:
                stack[-1][2].update(names)

    for m in CALL.finditer(code):
        close(m.start())
        if head := heads.get(m.start()):
            stack.append((ends[head[1]], head[0], set()))
        elif stack and m[1] not in NOT_CALLS:
            stack[-1][2].add(m[1])
    close(len(code))
    return found


def method_calls(source: Column, language: Column) -> Column:
    """An array of (name, calls) of the methods of a text."""

    @F.pandas_udf("array<struct<name: string, calls: array<string>>>")
    def calls(sources: pd.Series, languages: pd.Series) -> pd.Series:
        return pd.Series([[{"name": n, "calls": c} for n, c in calls_of(s or "", k)] for s, k in zip(sources, languages)])

    return calls(source, language)


def _class_brace(code: str, at: int, end: int, brackets: dict[int, int]) -> int | None:
    """Where the body opens of a class whose name ends at ``at``, before ``end``; brackets of a constructor or a supertype are passed over."""
    while at < end and (m := BEFORE_BODY.search(code, at, end)):
        if m[0] != "(":
            return m.start() if m[0] == "{" else None
        at = brackets[m.start()]
    return None


def _members(source: str, language: str) -> list[tuple[str, str, str, str, str]]:
    """(class, kind, name, type, params) of the methods and fields directly inside each class, in one sweep over the braces.

    Comments and literals neither hold members nor count as braces.
    """
    lexed = lexer.spans(source, language == "kotlin")
    code, plain = lexer.cover(source, lexed), lexer.cover(source, lexed, literals=False)
    ends, brackets = brace_ends(code), brace_ends(code, "()")
    found, opened = [], dict.fromkeys(ends, "")  # opening brace -> its class's name, '' for any other
    for m in METHOD_HEAD.finditer(code):
        if m[1] not in NOT_CALLS:
            found.append((m.start(), "method", m[1], m[3] or "void", plain[slice(*m.span(2))].strip()))
    heads = [(m.start(), m.end(1), m[1]) for m in CLASS_HEAD.finditer(code)]
    for (_, at, name), after in zip(heads, [h[0] for h in heads[1:]] + [len(code)]):
        brace = _class_brace(code, at, after, brackets)
        if brace is not None:
            opened[brace] = name
    found += [(m.start(), "field", m[1] or m[4], m[2] or m[3], "") for m in FIELD_HEAD.finditer(code)]
    rows, stack, waiting = [], [], sorted(opened, reverse=True)
    for at, kind, name, type_, params in sorted(found):
        while waiting and waiting[-1] < at:
            stack.append(waiting.pop())
        while stack and ends[stack[-1]] <= at:
            stack.pop()
        if stack and opened[stack[-1]]:
            rows.append((opened[stack[-1]], kind, name, type_, params))
    return rows


def resolve_members(code: DataFrame) -> DataFrame:
    """Methods and fields of each class that encloses them: project_id, path, class_name, kind, name, type, params."""

    @F.pandas_udf("array<struct<class_name: string, kind: string, name: string, type: string, params: string>>")
    def members(sources: pd.Series, languages: pd.Series) -> pd.Series:
        keys = ("class_name", "kind", "name", "type", "params")
        return pd.Series([[dict(zip(keys, r)) for r in _members(s or "", k)] for s, k in zip(sources, languages)])

    return code.select("project_id", "path", F.inline(members(F.col("source"), rules.language_of(F.col("path")))))
