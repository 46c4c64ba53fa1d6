"""Audit rules over whole texts: matches over several lines, and rules for what stands in loops, handlers or certain methods.

Comments and literals are blanked first (``functions.lexer``), so a rule sees code only; rules that need texts in quotes see them, without comments.
Each text is read once: braces and brackets are paired, the regions of every kind are found, a rule's pattern runs once over the text, and
its matches are held against the merged regions in order. A finding has the line on which its match begins, from a list of line ends.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeatlas.functions import lexer, rules, specs
from codeatlas.operators import bodies

LOOP, CATCH = re.compile(r"(?<!\w)(?:for|while)\s*(?=\()"), re.compile(r"(?<!\w)catch\s*(?=\()")
BLOCK = re.compile(r"\s*\{")


def _blocks(code: str, heads: re.Pattern, braces: dict[int, int], brackets: dict[int, int]) -> list[tuple[int, int, int]]:
    """(where the head begins, where the block opens, where it ends) of each ``head (...) {``."""
    found = []
    for m in heads.finditer(code):
        if block := BLOCK.match(code, brackets[m.end()]):
            found.append((m.start(), block.end() - 1, braces[block.end() - 1]))
    return found


def _merged(regions: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    starts, ends = [], []
    for s, e in sorted(regions):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def findings_in(source: str, language: str, compiled: list[tuple]) -> list[tuple[int, int]]:
    """(rule's place, line number) of the findings of a text; a rule finds a line once."""
    kotlin = language == "kotlin"
    lexed = lexer.spans(source, kotlin)
    code, plain = lexer.cover(source, lexed), lexer.cover(source, lexed, literals=False)
    braces, brackets = bodies.brace_ends(code), bodies.brace_ends(code, "()")
    line_ends = [m.start() for m in re.finditer("\n", source)]
    line = lambda at: bisect_left(line_ends, at) + 1
    catches, found = _blocks(code, CATCH, braces, brackets), set()
    kept: dict[str, tuple[list[int], list[int]]] = {}

    def region(scope: str):
        if scope not in kept:
            if scope == "loop":
                spans = [(b, e) for _, b, e in _blocks(code, LOOP, braces, brackets)]
            elif scope == "catch":
                spans = [(b, e) for _, b, e in catches]
            else:
                wanted = re.compile(scope.removeprefix("method:"))
                spans = [(b, e) for name, b, e in bodies.declared_methods(code, kotlin, braces) if wanted.fullmatch(name)]
            kept[scope] = _merged(spans)
        return kept[scope]

    for k, (scope, pattern) in enumerate(compiled):
        if scope == "empty catch":
            found |= {(k, line(s)) for s, b, e in catches if e - b < 2 or code[b + 1 : e - 1].isspace()}
            continue
        where = region(scope) if scope else None
        for m in pattern.finditer(plain if '"' in pattern.pattern else code):
            if where:
                at = bisect_right(where[0], m.start()) - 1
                if at < 0 or where[1][at] <= m.start():
                    continue
            found.add((k, line(m.start())))
    return sorted(found)


def span_scan(sources: DataFrame, rule_list: list[tuple] = specs.SPAN_RULES) -> DataFrame:
    """Findings of ``rule_list`` (rule_id, category, severity, scope, pattern, title, recommendation) in code files (project_id, path, source).

    Scopes: '' (anywhere), 'loop', 'catch', 'method:<pattern of names>', and 'empty catch', which needs no pattern. A file that no rule's
    pattern and no handler can concern stays in the JVM.
    """
    wanted = "|".join([f"(?:{r[4]})" for r in rule_list if r[4]] + [r"catch\s*\(" for r in rule_list if r[3] == "empty catch"])
    rows = sources.filter(F.lower("path").rlike(r"\.(?:java|kt)$") & F.col("source").rlike(wanted))

    @F.pandas_udf("array<struct<rule: int, line_number: int>>")
    def scanned(texts: pd.Series, languages: pd.Series) -> pd.Series:
        compiled = [(r[3], re.compile(r[4])) for r in rule_list]
        return pd.Series([[{"rule": k, "line_number": n} for k, n in findings_in(t, g, compiled)] for t, g in zip(texts, languages)])

    names = ("rule_id", "category", "severity", "title", "recommendation")
    known = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, (*r[:3], *r[5:]))]) for r in rule_list])
    found = rows.select("project_id", "path", F.inline(scanned(F.col("source"), rules.language_of(F.col("path")))))
    return found.select("project_id", "path", "line_number", F.get(known, F.col("rule")).alias("r")).select("project_id", "path", "line_number", "r.*")
