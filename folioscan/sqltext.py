"""The text functions in DuckDB's SQL, for checking queries against it."""

from __future__ import annotations

from .functions.words import CJK, SUFFIXES


def nfkc(x: str) -> str:
    """Compatibility forms, of the characters that the test tables hold."""
    x = f"translate({x}, '\u00aa\u00ba\u00a0\u3000\u2009\u2003\u202f\uff21\uff11', 'ao     A1')"
    for a, b in (("ﬁ", "fi"), ("½", "1⁄2"), ("™", "TM"), ("…", "...")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


def strip(x: str) -> str:
    """Without accents; Hangul stays apart."""
    return f"replace(replace(strip_accents({x}), '\ud55c', '\u1112\u1161\u11ab'), '\uae00', '\u1100\u1173\u11af')"


def fold(x: str) -> str:
    return strip(f"lower({nfkc(x)})")


def clean(x: str) -> str:
    x = rf"regexp_replace({nfkc(x)}, '([\p{{L}}\p{{N}}_])-\s*\n\s*([\p{{L}}\p{{N}}_])', '\1\2', 'g')"
    x = rf"regexp_replace(replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t]+', ' ', 'g')"
    return strip(rf"regexp_replace(regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')")


def tokens(folded: str) -> str:
    return rf"regexp_extract_all({folded}, '[{CJK}]|[\p{{L}}\p{{N}}_]+')"


def strip_once(x: str) -> str:
    cases = " ".join(f"when {x} like '%{s}' and length({x}) - {len(s)} >= 4 then left({x}, length({x}) - {len(s)})" for s in SUFFIXES)
    return f"case {cases} else {x} end"


#: Stems of a relation ``v(t)`` of distinct tokens, as CTEs; needs ``with recursive``.
STEMS = f"""s0(t, cur, k) as (select t, t, 0 from v union all select t, {strip_once('cur')}, k + 1 from s0
  where length(t) >= 4 and not regexp_matches(t, '[{CJK}]') and {strip_once('cur')} <> cur),
s1 as (select t, arg_max(cur, k) cur from s0 group by t),
stems as (select t, case when length(t) >= 4 and not regexp_matches(t, '[{CJK}]') and length(cur) > 1 and cur[-1] = cur[-2] then left(cur, length(cur) - 1) else cur end stem from s1)"""

#: Units as CTE ``u``: every non-empty document with its cleaned text, folded text and tokens.
UNITS = f"""u as (select doc_id, path, source, text, norm, {tokens('norm')} tk from (
  select doc_id, path, source, text, {fold('text')} norm from (select doc_id, path, source, {clean("coalesce(text, '')")} text from documents)) where norm <> '')"""


def word(part: str, i: str) -> str:
    """Condition for token ``i`` (from 0) of ``tk`` to match a part of a term."""
    if "*" in part or "?" in part:
        p = part.replace("*", r"[\p{L}\p{N}_]*").replace("?", r"[\p{L}\p{N}_]")
        return f"regexp_full_match(tk[{i} + 1], '{p}')"
    return f"tk[{i} + 1] = '{part}'"


def leaf(*parts: str) -> str:
    """Starts of a term in ``tk``."""
    cond = " and ".join(word(p, f"(i + {k})") for k, p in enumerate(parts))
    return f"list_filter(range(0, greatest(0, len(tk) - {len(parts) - 1})), lambda i: {cond})"


def near(a: str, b: str, distance: int, la: int = 1, lb: int = 1) -> str:
    gap = f"greatest(q - p - {la}, p - q - {lb}, 0)"
    return f"len(list_filter({a}, lambda p: len(list_filter({b}, lambda q: {gap} <= {distance})) > 0)) > 0"


def score(occurrences: str) -> str:
    return f"round(least(1.0, ({occurrences})::double / greatest(len(tk), 1) * ln(1 + greatest(len(tk), 1)) / ln(1001::double)), 6)"


def matches(condition: str, occurrences: str) -> str:
    """doc_id and base score of the documents that match."""
    return f"with {UNITS} select doc_id, {score(occurrences)} relevance_score from u where {condition}"


def window(text: str, s: str, e: str, width: int) -> str:
    center = f"(({s} + {e}) // 2)"
    return f"substr({text}, (greatest(0, {center} - {width}) + 1)::bigint, (least(length({text}), {center} + {width}) - greatest(0, {center} - {width}))::bigint)"


def first_word_at(term: str) -> str:
    """Offset of the first occurrence of a whole word in ``norm``."""
    edge = r"[^\p{L}\p{N}_]"
    return f"(length(regexp_extract('#' || norm || '#', '(?s)^(.*?{edge}){term}{edge}', 1)) - 1)"
