"""From a parsed query to Columns over units with ``text``, ``norm``, ``tokens`` and (for stemming) ``stems``."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import EDGE, SPACE, W
from ..functions.words import stem
from ..query.parser import Node, Query, Term, is_wildcard

SPANS = "array<struct<s:int,e:int>>"


def _escape(text: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", text, flags=re.A) if text.isascii() else "".join("\\" + c if c.isascii() and not c.isalnum() and not c.isspace() and c != "_" else c for c in text)


def word_pattern(part: str) -> str:
    """A word with wildcards as a Java pattern over whole tokens."""
    return "^" + _wild(part) + "$"


def _wild(part: str) -> str:
    return "".join(f"{W}*" if c == "*" else W if c == "?" else _escape(c) for c in part)


def text_pattern(term: Term) -> str:
    """A term as a Java pattern over running text: phrases with flexible blanks, words at word edges."""
    inner = "".join(f"(?:{SPACE}+|[-/])" if c == " " and term.is_phrase else _wild(c) for c in term.core)
    return inner if term.is_phrase else f"{EDGE}{inner}{EDGE}"


def _no_spans() -> Column:
    return F.array().cast(SPANS)


def _part_matches(part: str, query: Query, i: Column) -> Column:
    token = F.get("tokens", i)
    if is_wildcard(part):
        if part.endswith("*") and not is_wildcard(part[:-1]) and part[:-1].isalnum():
            return token.startswith(part[:-1])
        return token.rlike(word_pattern(part))
    same = token == part
    return same | (F.get("stems", i) == stem(part)) if query.stemming else same


def leaf_spans(term: Term, query: Query) -> Column:
    """Where a term stands: first and last word of each occurrence."""
    parts = term.parts
    if not parts or not term.core:
        return _no_spans()
    size = len(parts)

    def here(i: Column) -> Column:
        out = _part_matches(parts[0], query, i)
        for k, p in enumerate(parts[1:], 1):
            out = out & _part_matches(p, query, i + k)
        return out

    starts = F.filter(F.sequence(F.lit(0), F.size("tokens") - size), here)
    spans = F.transform(starts, lambda i: F.struct(i.cast("int").alias("s"), (i + (size - 1)).cast("int").alias("e")))
    return F.when(F.size("tokens") >= size, spans).otherwise(_no_spans())


@dataclass
class Plan:
    """Columns of the leaves by name, and what is made of them."""

    leaves: dict[str, Column]
    matched: Column
    occurrences: Column


def _near(a: Column, b: Column, distance: int) -> Column:
    gap = lambda p, q: F.greatest(q["s"] - p["e"] - 1, p["s"] - q["e"] - 1, F.lit(0))
    return F.exists(a, lambda p: F.exists(b, lambda q: gap(p, q) <= distance))


def compile_query(query: Query, strict_near: bool = False) -> Plan:
    """Leaves become columns once each; the operators combine truth values and spans.

    NEAR looks at spans only: over an AND it may hold though one side is missing, and a NEAR or NOT below
    it has no spans. ``strict_near`` also asks both operands to be true.
    """
    names: dict[Term, str] = {}
    for t in query.terms:
        names.setdefault(t, f"leaf_{len(names)}")

    def walk(node: Node) -> tuple[Column, Column]:
        if node is None:
            return F.lit(False), _no_spans()
        if isinstance(node, Term):
            c = F.col(names[node])
            return F.size(c) > 0, c
        args = [walk(a) for a in node.args]
        if node.name == "NOT":
            return ~args[0][0], _no_spans()
        (a, aspans), (b, bspans) = args
        if node.name == "AND":
            return a & b, F.concat(aspans, bspans)
        if node.name == "OR":
            return a | b, F.concat(aspans, bspans)
        near = _near(aspans, bspans, node.distance)
        return (near & a & b if strict_near else near), _no_spans()

    matched, _ = walk(query.tree)
    occurrences = sum((F.size(names[t]) for t in query.terms), F.lit(0))
    return Plan({n: leaf_spans(t, query) for t, n in names.items()}, matched & (F.col("norm") != ""), occurrences)


def base_score(occurrences: Column, tokens: Column) -> Column:
    """Occurrences per word, scaled by the log of the length, at most 1."""
    n = F.greatest(F.size(tokens), F.lit(1))
    return F.least(F.lit(1.0), occurrences / n * F.log1p(n) / F.log1p(F.lit(1000.0)))


# Snippets


def window_at(text: Column, s: Column, e: Column, width: int) -> Column:
    """Up to ``width`` characters on either side of the middle of ``[s, e)``."""
    n = F.length(text)
    s = F.greatest(F.lit(0), F.least(s, n - 1))
    e = F.greatest(s, F.least(e, n))
    center = F.floor((s + e) / 2).cast("int")
    a = F.greatest(F.lit(0), center - width)
    return F.substring(text, a + 1, F.least(n, center + width) - a)


def first_at(norm: Column, pattern: str) -> tuple[Column, Column]:
    """Start and end of the first match, in code points; both null without one."""
    before = F.length(F.regexp_extract(norm, f"(?s)^(.*?)(?:{pattern})", 1))
    length = F.length(F.regexp_extract(norm, f"(?s)^.*?({pattern})", 1))
    there = norm.rlike(pattern)
    return F.when(there, before), F.when(there, before + length)


def hit_count(query: Query) -> Column:
    """Matches of a simple query in the text; 0 for others."""
    if not query.is_simple or not query.terms[0].core:
        return F.lit(0).cast("bigint")
    return F.regexp_count("norm", F.lit(text_pattern(query.terms[0]))).cast("bigint")


def snippet(query: Query, width: int) -> Column:
    """Around the first hit of a simple query, case kept; else around the first term found in the lower-cased text; else its head."""
    norm, text = F.col("norm"), F.col("text")
    out = window_at(norm, F.lit(0), F.lit(0), width)
    for t in reversed(query.terms):
        if t.core:
            s, e = first_at(norm, text_pattern(t))
            out = F.when(s.isNotNull(), window_at(text if query.is_simple else norm, s, e, width)).otherwise(out)
    return out


def all_hits(query: Query) -> Column:
    """Spans of all matches of a simple query, ``array<struct<s,e>>`` in code points."""
    p = text_pattern(query.terms[0])
    between = F.split("norm", p, -1)
    found = F.regexp_extract_all("norm", F.lit(f"({p})"), F.lit(1))
    start = F.struct(F.lit(0).alias("at"), _no_spans().alias("spans"))

    def step(acc: Column, k: Column) -> Column:
        s = acc["at"] + F.length(F.get(between, k))
        e = s + F.length(F.get(found, k))
        return F.struct(e.alias("at"), F.array_append(acc["spans"], F.struct(s.alias("s"), e.alias("e"))).alias("spans"))

    spans = F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step, lambda acc: acc["spans"])
    return F.when(F.size(found) > 0, spans).otherwise(_no_spans())
