"""Problem 6: visually equal text made of different characters, brought to one consistent form.

Look-alike classes are found by union-find over strings and code points: the full-width, joined and
mathematical forms with what they stand for, base letters with separate accents with the composed
letters, the kinds of blanks, the invisible characters with the empty string, and letters of Latin,
Greek, Cyrillic, Armenian and Cherokee that share their shape. Blanks, invisible characters, forms and accents have fixed
representatives (the plain blank, nothing, NFKC, NFC); shared letters have one for each script, the
most frequent in the collection where a script has several. Texts are rewritten by an automaton that finds all
other members at once, the longest first; letters of a shape shared between scripts are rewritten only
in words whose script the other letters of the word, or the words around it, tell.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import EncodingModel, Repairer

#: Letters of one shape, as rows of Latin, Greek, Cyrillic, Armenian and Cherokee ('.' where a script has none).
_SHAPES = """
A Α А . Ꭺ|B Β В . Ᏼ|C . С . Ꮯ|D . . . Ꭰ|E Ε Е . Ꭼ|G . . . Ꮐ|H Η Н . Ꮋ|I Ι І . .|J . Ј . Ꭻ|K Κ К . Ꮶ|L . . . Ꮮ|M Μ М . Ꮇ|N Ν . . .|O Ο О Օ .|P Ρ Р . Ꮲ|R . . . Ꭱ|
S . Ѕ Տ Ꮪ|T Τ Т . Ꭲ|U . . Ս .|V . . . Ꮩ|W . Ԝ . Ꮃ|X Χ Х . .|Y Υ У . .|Y . Ү . .|Z Ζ . . Ꮓ|Q . Ԛ . .|
a α а . .|c ϲ с . .|d . ԁ . .|e . е . .|g . . ց .|h . һ հ .|i ι і . .|j ϳ ј յ .|l . ӏ . .|n . . ո .|o ο о օ .|p ρ р . .|q . ԛ զ .|s . ѕ . .|u υ . ս .|v ν ѵ . .|w . ԝ . .|x . х . .|y . у . .|y γ . . .|k κ к . .
"""
_BLANKS = [" ", "\u00a0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u202f", "\u205f", "\u3000"]
_INVISIBLE = ["", "\u00ad", "\u180e", "\u200b", "\u200c", "\u200d", "\u200e", "\u200f", "\u2060", "\u2061", "\u2062", "\u2063", "\u2064", "\ufeff"]
_COMPAT = [*map(chr, range(0xFF01, 0xFF5F)), *"￠￡￢￤￥￦", *map(chr, range(0xFB00, 0xFB07)), *map(chr, range(0xFB13, 0xFB18)), "Ĳ", "ĳ", *map(chr, range(0x1C4, 0x1CD)), *map(chr, range(0x1F1, 0x1F4)), *map(chr, range(0x1D400, 0x1D800))]
SCRIPTS = ("Latin", "Greek", "Cyrillic", "Armenian", "Cherokee")

_CANDIDATE = r"[\u00a0\u00ad\u0300-\u036f\u0370-\u058f\u1100-\u11ff\u13a0-\u13ff\u1680\u180e\u1f00-\u1fff\u2000-\u200f\u202f\u205f-\u2064\u3000\u0132\u0133\u01c4-\u01cc\u01f1-\u01f3\ufb00-\ufb17\ufeff\uff01-\uff5e\uffe0-\uffe2\uffe4-\uffe6]|[\x{1d400}-\x{1d7ff}]"
_WORD = re.compile(r"[^\W\d_]+(?:[\u0300-\u036f]+[^\W\d_]*)*")
_FOREIGN = re.compile(r"[\u0370-\u058f\u13a0-\u13ff\u1f00-\u1fff]")
_SEPARATE = re.compile(r"[A-Za-z\u00c0-\u024f\u0370-\u052f\u1e00-\u1fff][\u0300-\u036f]")
#: Scripts whose spelling needs joiners, and signs that are joined into one picture.
_JOINING = re.compile("[\u0600-\u08ff\u0900-\u0dff\u200d\ufe0f\u2600-\u27bf\U0001f000-\U0001faff]")


def script_of(c: str) -> str | None:
    o = ord(c)
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "Latin" if c.isalpha() else None
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "Greek"
    if 0x13A0 <= o < 0x1400:
        return "Cherokee"
    return "Cyrillic" if 0x400 <= o < 0x530 else "Armenian" if 0x530 <= o < 0x590 else None


class UnionFind:
    """Over strings, with path halving and union by size."""

    def __init__(self):
        self.up: dict[str, str] = {}
        self.size: Counter[str] = Counter()

    def find(self, x: str) -> str:
        if x not in self.up:
            self.up[x], self.size[x] = x, 1
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            if (self.size[a], b) < (self.size[b], a):
                a, b = b, a
            self.up[b] = a
            self.size[a] += self.size[b]

    def classes(self) -> list[list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.up:
            out.setdefault(self.find(x), []).append(x)
        return [sorted(v) for v in out.values()]


def _shapes() -> list[list[str]]:
    return [row.split() for row in _SHAPES.replace("\n", "").split("|") if row.strip()]


@lru_cache(maxsize=1 << 12)
def _kind(member: str) -> str:
    if member in _BLANKS:
        return "blank"
    if member in _INVISIBLE:
        return "invisible"
    if member in _COMPAT:
        return "form"
    return "accent" if len(member) > 1 else "letter"


def find_classes() -> list[list[str]]:
    """The transitive classes of all seeds."""
    u = UnionFind()
    for group in (_BLANKS, _INVISIBLE):
        for x in group[1:]:
            u.union(group[0], x)
    for c in _COMPAT:
        plain = unicodedata.normalize("NFKC", c)
        if plain != c:
            u.union(c, plain)
    for o in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        c = chr(o)
        apart = unicodedata.normalize("NFD", c)
        if len(apart) > 1 and unicodedata.normalize("NFC", apart) == c:
            u.union(c, apart)
            half = unicodedata.normalize("NFC", apart[:-1]) + apart[-1]
            u.union(c, half)
    for row in _shapes():
        for x in row[1:]:
            if x != ".":
                # letters of one shape are kept apart by script; the class joins them transitively
                u.union(row[0], x)
    return u.classes()


@dataclass
class Rewriter:
    """The representatives: of context-free members, and of shared letters for each script."""

    plain: dict[str, str]
    letters: dict[str, dict[str, str]]

    def __post_init__(self):
        self._automata: dict = {}
        self._signs: dict[str, tuple[str | None, bool]] = {}
        self._words: dict[str, tuple[Counter, Counter]] = {}

    def __getstate__(self):
        return {"plain": self.plain, "letters": self.letters, "_automata": {}, "_signs": {}, "_words": {}}

    def _automaton(self, script: str | None):
        import ahocorasick

        if script not in self._automata:
            a = ahocorasick.Automaton()
            for x, y in (self.letters[script] if script else self.plain).items():
                a.add_word(x, (len(x), y))
            a.make_automaton()
            self._automata[script] = a
        return self._automata[script]

    def _rewrite(self, text: str, script: str | None = None, kinds: set[str] | None = None) -> str:
        if script is None:
            if "plain" not in self._automata:  # a text without the last character of any member has no member
                self._automata["plain"] = re.compile(f"[{''.join(sorted({re.escape(x[-1]) for x in self.plain}))}]" if self.plain else r"(?!)")
            if not self._automata["plain"].search(text):
                return text
        parts, at = [], 0
        for end, (n, y) in self._automaton(script).iter_long(text):
            start = end - n + 1
            x = text[start : end + 1]
            if kinds is not None:
                kind = _kind(x)
                kinds.add(kind)
                if kind == "invisible" and _JOINING.search(text[max(0, start - 1) : start] + text[end + 1 : end + 2]):
                    continue  # found, but without it the text would look different
            parts += [text[at:start], y]
            at = end + 1
        return "".join(parts) + text[at:] if parts else text

    def rewrite(self, text: str | None) -> tuple[str | None, list[str]]:
        """The consistent form, and the kinds of what was found: blank, invisible, form, accent, letter."""
        if not text or text.isascii():
            return text, []
        kinds: set[str] = set()
        out = self._rewrite(text, None, kinds)
        if _SEPARATE.search(out):  # accents that no composed letter has
            kinds.add("accent")
        if _FOREIGN.search(out):
            out = self._letters(out, kinds)
        return unicodedata.normalize("NFC", out) if kinds or not unicodedata.is_normalized("NFC", out) else out, sorted(kinds)

    def _letters(self, text: str, kinds: set[str]) -> str:
        spans, own = [], Counter()
        for m in _WORD.finditer(text):
            scripts, sure = self._scripts(m.group())
            if len(sure) == 1:
                own[next(iter(sure))] += 1
            if len(scripts) > 1 or (scripts and "Latin" not in scripts and not sure):
                spans.append((m.start(), m.end(), scripts, sure))
        parts, at = [], 0
        for s, e, scripts, sure in spans:
            if sure:
                target = max(SCRIPTS, key=lambda x: (sure[x], scripts[x]))
            elif len(scripts) > 1:
                target = max(SCRIPTS, key=lambda x: (own[x] > 0, scripts[x], own[x]) if scripts[x] else (False, 0, 0))
            else:  # wholly of letters that Latin shares: real if the text has other words of that script
                target = next(iter(scripts)) if own[next(iter(scripts))] or not own["Latin"] else "Latin"
            word = text[s:e]
            new = self._rewrite(word, target)
            if new != word:
                kinds.add("letter")
                parts += [text[at:s], new]
                at = e
        return "".join(parts) + text[at:] if parts else text

    def _scripts(self, word: str) -> tuple[Counter, Counter]:
        """How many letters of a word are of each script, and of those that no other script has; a bounded number of short words is remembered."""
        if word in self._words:
            return self._words[word]
        scripts, sure = Counter(), Counter()
        for c in word:
            if c not in self._signs:
                self._signs[c] = script_of(c), self._shared(c)
            s, shared = self._signs[c]
            if s:
                scripts[s] += 1
                if not shared:
                    sure[s] += 1
        if len(word) <= 30:
            if len(self._words) >= 50_000:
                self._words.clear()
            self._words[word] = scripts, sure
        return scripts, sure

    def _shared(self, c: str) -> bool:
        base = unicodedata.normalize("NFD", c)[0] if ord(c) > 0x24F else c
        return any(base in self.letters[s] for s in SCRIPTS)


def choose(classes: Iterable[list[str]], frequency: dict[str, int]) -> Rewriter:
    """Fixed representatives, and of several letters of one shape and script the most frequent (ties: the shorter, then the lesser string)."""
    plain: dict[str, str] = {}
    letters: dict[str, dict[str, str]] = {s: {} for s in SCRIPTS}
    best = lambda xs: min(xs, key=lambda x: (-frequency.get(x, 0), len(x), x))
    for members in classes:
        if "" in members:
            plain |= {x: "" for x in members if x}
            continue
        if " " in members:
            # the blank between words, whatever a collection of non-breaking ones would say
            plain |= {x: " " for x in members if x != " "}
            continue
        ordinary = [x for x in members if _kind(x) == "letter" and unicodedata.normalize("NFKC", x) == x]
        by_script = {s: [x for x in ordinary if script_of(x[0]) == s] for s in SCRIPTS}
        found = {s: best(xs) for s, xs in by_script.items() if xs}
        for x in members:
            if x in ordinary and script_of(x[0]):
                continue
            # compatibility and split forms go to the member that is the same letter, not another of its shape
            same = unicodedata.normalize("NFKC", x)
            if x != same:
                plain[x] = same
        if len(found) > 1:
            for s, rep in found.items():
                for x in ordinary:
                    if script_of(x) != s:
                        letters[s][x] = rep
    # the same shapes under an accent
    for o in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        apart = unicodedata.normalize("NFD", chr(o))
        if len(apart) > 1:
            for s in SCRIPTS:
                if apart[0] in letters[s]:
                    other = unicodedata.normalize("NFC", letters[s][apart[0]] + apart[1:])
                    if len(other) == 1 and script_of(chr(o)) != s:
                        letters[s][chr(o)] = other
    return Rewriter(plain, letters)


def code_point_counts(rows: DataFrame, fields: tuple[str, ...]) -> dict[str, int]:
    """How often each member of a class that is a single code point occurs in all rows; only that fixed set of strings comes to the driver."""
    letters = sorted({x for c in find_classes() for x in c if len(x) == 1})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for batch in batches:
            for column in batch.columns:
                text = "".join(v for v in column.to_pylist() if v)
                total[: (n := np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))).size] += n
        points = [ord(x) for x in letters if total[ord(x)]]
        yield pa.record_batch([pa.array([chr(p) for p in points], pa.string()), pa.array(total[points] if points else np.empty(0, np.int64))], names=["member", "n"])

    found = rows.select(*fields).mapInArrow(run, "member string, n bigint").groupBy("member").agg(F.sum("n").alias("n"))
    return {r.member: r.n for r in found.collect()}


def fit_on(rows: DataFrame, fields: tuple[str, ...] = ("context", "document_text")) -> Rewriter:
    """Classes, and representatives by the frequencies in all values of ``fields``."""
    return choose(find_classes(), code_point_counts(rows, fields))


def unify_fields(rows: DataFrame, rewriter: Rewriter, garbled: EncodingModel | None = None, id_col: str = "match_id", fields: tuple[str, ...] = ("context", "document_text")) -> DataFrame:
    """``(id_col, field, kinds, unified)``: each value that holds look-alike coding, with its consistent form.

    With ``garbled``, values that are cases of problem 1 are left out: their odd characters are traces of a
    wrong encoding. Null and empty values are never returned; repeated rows are judged each for itself; other
    columns are not read. No shuffle.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast((rewriter, garbled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewriter, model = shared.value
        judge = Repairer(model) if model is not None else None
        for batch in batches:
            ids, names, all_kinds, texts = [], [], [], []
            for j, field in enumerate(fields, 1):
                values = batch.column(j).to_pylist()
                coded = [(i, *rewriter.rewrite(v)) for i, v in enumerate(values) if v]
                coded = [x for x in coded if x[2]]
                if judge:
                    judge.prepare([values[i] for i, _, _ in coded])
                for i, out, kinds in coded:
                    if not (judge and judge.repair(values[i])[0]):
                        ids.append(i)
                        names.append(field)
                        all_kinds.append(kinds)
                        texts.append(out)
            yield pa.record_batch([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(names, pa.string()), pa.array(all_kinds, pa.list_(pa.string())), pa.array(texts, pa.string())], names=[id_col, "field", "kinds", "unified"])

    cols = [F.when(F.col(f).rlike(_CANDIDATE), F.col(f)).alias(f) for f in fields]
    return rows.select(id_col, *cols).mapInArrow(run, f"`{id_col}` {kind}, field string, kinds array<string>, unified string")
