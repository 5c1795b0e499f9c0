"""Problem 4: noise in text from scanned pages, repaired into continuous readable paragraphs.

Two averaged perceptrons, trained on clean texts that are spoilt on purpose. The first looks at lines
and their place in the page and finds running headings and page numbers. The second is a character
editor: at every place where a confusion could have happened it chooses among keep, replace, delete,
insert and line-join, from the characters around it, the rest of the word and whether the word that
would come out is known. What may have happened is a fixed list of what scanners do, and what the
noisy texts themselves show: letters that stand in unknown words where known words have others, or have one more.
Both work on whole batches of texts at once.

Known words and learnt confusions are counted over all texts. Both perceptrons are trained on all texts as well, a group of
parts at a time, and the groups' weights are averaged, so that training is one pass over the tasks.

Texts are judged in the consistent form of problem 6 (:mod:`.lookalike`) and, with a model of problem 1, after what a
wrong encoding did to them is undone, so that a letter coded in two parts, an invisible character in a word or the
traces of an encoding aren't taken for noise.
"""

from __future__ import annotations

import gc
import math
import random
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import discard, materialize
from .encoding import BUCKETS, LABELS, EncodingModel, Repairer, count, letter_spans, of_counts
from .lookalike import Rewriter, choose, find_classes
from .sampling import distinct_parts
from .spans import _powers

#: What a scan makes of letters, (read as, was).
CONFUSIONS = [
    ("c", "e"), ("e", "c"), ("0", "o"), ("0", "O"), ("0", "о"), ("@", "a"), ("†", "t"), ("l", "i"), ("5", "s"), ("5", "S"), ("ri", "n"), ("|", "l"), ("1", "l"),
    ("1", "I"), ("ii", "u"), ("rn", "m"), ("m", "rn"), ("cl", "d"), ("9", "g"), ("b", "h"), ("h", "b"), ("vv", "w"), ("8", "B"), ("|", "I"), ("l", "I"), ("6", "b"),
    ("l", "ll"), ("t", "tt"), ("s", "ss"), ("n", "nn"), ("f", "ff"), ("I", "l"), ("n", "h"), ("o", "d"),
]
#: So many of them are common; what only the others have is looked at in unknown words.
COMMON = 26
MARKS = [" |", " _", " '", " ·", " ~", " ;."]
#: How often training texts have each confusion; the ones after the first are rarer in scans.
_RATE = {("n", "h"): 0.3, ("o", "d"): 0.3, ("I", "l"): 0.3, ("e", "c"): 0.1, ("m", "rn"): 0.5, ("h", "b"): 0.3, ("6", "b"): 0.3, ("1", "I"): 0.5, ("|", "I"): 0.5, ("l", "I"): 0.5}
BREAKS = ["-\n", "- \n", "¬\n", "¬ \n"]

#: Characters of a group of parts for fitting (about), of a part that the editor learns from at once, and bits of the hash.
GROUP_CHARS, PART_CHARS, BITS = 1 << 21, 1500, 19
EPOCHS, BATCH, LINE_EPOCHS = 4, 512, 4
#: By how much an edit must beat 'keep', in units of the weights' scale.
MARGIN = 1.0
#: Wrongly recognised characters that make a value a case.
SEVERAL = 2
#: Characters that are looked at together; a longer text is looked at in pieces that overlap, and judged as a whole.
CHUNK = 1 << 19
#: A word of more characters may be cut where pieces meet.
LONGEST_WORD = 1 << 19


class Candidates:
    """What could have happened: the patterns that may be noise, and what each may have been."""

    def __init__(self, learnt: Iterable[tuple[str, str]] = ()):
        self.confusions = [*CONFUSIONS, *(c for c in learnt if c not in CONFUSIONS)]
        self.rate = {**dict.fromkeys(self.confusions[len(CONFUSIONS) :], 0.3), **_RATE}
        self.options: dict[str, list[str]] = {}
        for read, was in [*self.confusions, *((m, "") for m in MARKS), *((b, "") for b in BREAKS), (" ", "")]:
            self.options.setdefault(read, []).append(was)
        self.patterns = sorted(self.options, key=lambda p: (-len(p), p))
        self.letters = {read for read, _ in self.confusions if read.isalpha()}
        #: Letters that stand everywhere and are seldom noise; only looked at in unknown words.
        self.common = {*CONFUSIONS[:COMMON], *((m, "") for m in MARKS), *((b, "") for b in BREAKS), (" ", "")}
        self.rare = {read for read, _ in self.confusions if read.isalpha()} - {read for read, _ in self.common}
        self.by_was: dict[str, list[str]] = {}
        for read, was in self.confusions:
            self.by_was.setdefault(was, []).append(read)


#: A confusion is learnt if it explains this many different unknown words, this share of all that have a known word
#: beside them, and this many times as many as its reverse does (chance pairs go both ways).
LEAST_WORDS, LEAST_SHARE, LEAST_RATIO = 8, 0.01, 3.0


def learn_confusions(noisy: Iterable[str], clean: Iterable[str]) -> list[tuple[str, str]]:
    """What stands in unknown words of noisy texts for what known words have: single letters, and letters left out.

    A word that several known words explain counts for none. :func:`confusions_in` does the same for tables.
    """
    words = lambda texts: {w for t in texts for w in _spelt(t)}
    known = words(clean)
    slots: dict[str, set[str]] = {}
    shorter: dict[str, set[tuple[str, str]]] = {}
    for w in known:
        for i in range(len(w)):
            slots.setdefault(f"{w[:i]}*{w[i + 1 :]}", set()).add(w[i])
            if i:
                shorter.setdefault(w[:i] + w[i + 1 :], set()).add((w[i - 1], w[i - 1 : i + 1]))
    counts: Counter[tuple[str, str]] = Counter()
    for u in sorted(words(noisy) - known):
        found = {(u[i], c) for i in range(len(u)) for c in slots.get(f"{u[:i]}*{u[i + 1 :]}", ())} | shorter.get(u, set())
        if len(found) == 1:
            counts.update(found)
    return _frequent(counts)


def _spelt(text: str) -> set[str]:
    """The words that confusions are learnt from."""
    return {w.lower() for w in set(re.findall(r"[^\W\d_]+", text)) if 4 < len(w) <= 20}


def _frequent(counts: Counter[tuple[str, str]]) -> list[tuple[str, str]]:
    total = sum(counts.values())
    good = [p for p, n in counts.items() if n >= LEAST_WORDS and n >= LEAST_SHARE * total and (len(p[1]) > 1 or n >= LEAST_RATIO * counts[p[::-1]])]
    return sorted(good)


def confusions_in(noisy: DataFrame, known: DataFrame) -> list[tuple[str, str]]:
    """:func:`learn_confusions` of tables of distinct words ``(word)``; the counts of pairs of letters come to the driver."""
    unknown = materialize(noisy.join(known, "word", "left_anti"), "p4-unknown")
    n = F.length("word")
    at = lambda i, k=1: F.substring(F.col("word"), i, F.lit(k))
    without = F.concat(at(F.lit(1), F.col("i") - 1), F.lit("*"), at(F.col("i") + 1, n))
    each = lambda df: df.select("word", F.explode(F.sequence(F.lit(1), n)).alias("i"))
    slots = lambda df, c: each(df).select("word", without.alias("slot"), at(F.col("i")).alias(c))
    other = slots(unknown, "read").join(slots(known, "was").drop("word"), "slot").select("word", "read", "was")
    lost = each(known).filter("i > 1").select(F.translate(without, "*", "").alias("word"), at(F.col("i") - 1).alias("read"), at(F.col("i") - 1, F.lit(2)).alias("was"))
    pairs = other.unionByName(lost.join(unknown, "word")).groupBy("word").agg(F.min(F.struct("read", "was")).alias("p"), F.max(F.struct("read", "was")).alias("q"))
    counts = pairs.filter("p = q").groupBy("p").count().collect()
    discard(unknown)
    return _frequent(Counter({(r.p.read, r.p.was): r["count"] for r in counts}))


_PAD = 8


def _norm_table() -> np.ndarray:
    t = np.arange(0x10000, dtype=np.uint32)
    for o in range(0x10000):
        if 0xD800 <= o < 0xE000:
            continue
        c = chr(o)
        low = c.lower()
        t[o] = ord("0") if c.isdigit() else ord(" ") if c.isspace() else ord(low) if len(low) == 1 and ord(low) < 0x10000 else o
    return t


def _class_table() -> np.ndarray:
    """1 letter of an alphabet, 2 digit, 0 other (also signs of scripts that don't part words)."""
    t = np.zeros(0x10000, np.uint8)
    for o in range(0x10000):
        c = chr(o)
        t[o] = 2 if c.isdigit() else 1 if c.isalpha() and o < 0x2E80 else 0
    for c in "@†|":
        t[ord(c)] = 3
    return t


_tables: list[np.ndarray] = []


def _lookup() -> list[np.ndarray]:
    if not _tables:
        _tables.extend((_norm_table(), _class_table()))
    return _tables


def _mix32(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Page:
    """Texts joined into one array of characters, with what the features need."""

    def __init__(self, texts: list[str]):
        norm, kind = _lookup()
        gap = "\x00" * _PAD
        joined = gap + gap.join(texts) + gap
        raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.raw = np.minimum(raw, 0xFFFF).astype(np.uint16)
        self._places: dict[str, np.ndarray] = {}
        lens = np.array([len(t) for t in texts], np.int64)
        self.starts = _PAD + np.concatenate([[0], np.cumsum(lens + _PAD)[:-1]]).astype(np.int64)
        self.norm = norm[self.raw].astype(np.uint64)
        self.kind = kind[self.raw]
        word = self.kind > 0
        n = len(self.raw)
        at = np.arange(n)
        self.word_start = np.maximum.accumulate(np.where(word, -1, at)) + 1
        self.word_end = np.minimum.accumulate(np.where(word, n, at)[::-1])[::-1]
        self.up, self.down = _powers(1 << 21)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_mix32(self.norm + np.uint64(1)) * self.up[:n], out=self.sums[1:])

    def find(self, pattern: str) -> np.ndarray:
        """Where the pattern stands, if an edit could apply there."""
        raw, kind = self.raw, self.kind
        if pattern[0] not in self._places:
            self._places[pattern[0]] = np.flatnonzero(raw[_PAD:-_PAD] == ord(pattern[0])) + _PAD
        pos = self._places[pattern[0]]
        for j, c in enumerate(pattern[1:], 1):
            pos = pos[raw[pos + j] == ord(c)]
        size = len(pattern)
        left, right = kind[pos - 1], kind[pos + size]
        if pattern == " ":  # between two single letters
            single = (left > 0) & (right > 0) & (kind[pos - 2] == 0) & (kind[pos + 2] == 0)
            return pos[single]
        if pattern in BREAKS:
            return pos[((left == 1) | (left == 3)) & ((right == 1) | (right == 3))]
        if pattern in MARKS:
            return pos[right == 0]
        if pattern[0].isdigit():  # a letter beside it, or alone between blanks
            return pos[((left & 1) | (right & 1) == 1) | ((left == 0) & (right == 0) & (raw[pos - 1] == 32))]
        return pos

    def words(self, pos: np.ndarray, size: int) -> np.ndarray:
        """Of the word around each site: the site, how far into the word it stands, and sums of what comes before and after."""
        ws, we = np.minimum(self.word_start[pos], pos), np.maximum(self.word_end[pos + size - 1], pos + size)
        head = (self.sums[pos] - self.sums[ws]) * self.down[ws]
        tail = (self.sums[we] - self.sums[pos + size]) * self.down[pos + size]
        return np.stack([pos.astype(np.uint64), (pos - ws).astype(np.uint64), head, tail])

    def contexts(self, words: np.ndarray, size: int) -> np.ndarray:
        """Hashed contexts of sites, one row for each feature template; two more are for what is known and for all."""
        pos, m = words[0].astype(np.int64), self.norm
        l1, l2, l3, l4 = (m[pos - k] for k in range(1, 5))
        r1, r2, r3, r4 = (m[pos + size - 1 + k] for k in range(1, 5))
        chain = lambda *xs: _chain(xs)
        _, shift, head, tail = words
        cased = (self.kind[pos - 1].astype(np.uint64) << np.uint64(2)) | self.kind[pos + size].astype(np.uint64)
        none = np.zeros(len(pos), np.uint64)
        return np.stack([
            chain(l1, r1), chain(l2, l1), chain(r1, r2), chain(l2, l1, r1, r2), chain(l3, l2, l1), chain(r1, r2, r3), chain(l1, r1, r2), chain(l2, l1, r1),
            chain(l4, l3, l2, l1), chain(r1, r2, r3, r4), chain(l3, l2, l1, r1, r2, r3), _mix32(head * np.uint64(3) + tail), _mix32(head) ^ shift, _mix32(tail * np.uint64(5)), cased, none, none,
        ])

    def word_with(self, words: np.ndarray, new: str) -> np.ndarray:
        """Hash of the word around each site with the site replaced by ``new``."""
        shift, h = words[1].astype(np.int64), words[2]
        for j, c in enumerate(new):
            h = h + _sign(c) * self.up[shift + j]
        return _mix32(h + words[3] * self.up[shift + len(new)])


@lru_cache(maxsize=1 << 12)
def _sign(c: str) -> np.uint64:
    return _mix32(np.array([int(_lookup()[0][min(ord(c), 0xFFFF)]) + 1], np.uint64))[0]


def _chain(xs) -> np.ndarray:
    h = (xs[0] ^ np.uint64(len(xs))) * np.uint64(0x100000001B3)
    for x in xs[1:]:
        high = h >> np.uint64(17)
        h ^= x
        h *= np.uint64(0x100000001B3)
        h += high
    return h


#: Features of an option: of its contexts, of what is known there, of the option, and one that all patterns share.
FEATURES = 18
_SALTS = (np.arange(FEATURES - 1, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)


def _rows(contexts: np.ndarray, pattern: int, option: int) -> np.ndarray:
    """Buckets of the features of one option."""
    h = contexts ^ (_SALTS + np.uint64(pattern * 8191 + option * 131 + 7))[:, None]
    h *= np.uint64(0x9E3779B97F4A7C15)
    h >>= np.uint64(64 - BITS)
    return h


#: Bits of the table of known words, by their hashes: 16 MB, of which ten million words take less than a twelfth.
_LEX_BITS = 27


def lexicon_of(texts: Iterable[str]) -> np.ndarray:
    """A table of bits for the hashes of the words of clean texts."""
    table = np.zeros(1 << _LEX_BITS - 6, np.uint64)
    bits = _word_bits({w for t in texts for w in _WORDS.findall(t)})
    np.bitwise_or.at(table, bits >> 6, np.uint64(1) << (bits & 63).astype(np.uint64))
    return table


_WORDS = re.compile(r"[^\W_]+")


def _word_bits(words: Iterable[str]) -> np.ndarray:
    """The places of words in the table, each once. A word that may be cut into pieces has none."""
    out, group, chars = [np.empty(0, np.int64)], [], 0
    for w in [*sorted(w for w in words if len(w) <= LONGEST_WORD), None]:
        if group and (w is None or chars + len(w) > LONGEST_WORD):
            out.append(_bit(_whole(Page(group))))
            group, chars = [], 0
        if w is not None:
            group.append(w)
            chars += len(w) + _PAD
    return np.unique(np.concatenate(out))


def _bit(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - _LEX_BITS)).astype(np.int64)


def _knows(lexicon: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bits = _bit(hashes)
    return (lexicon[bits >> 6] >> (bits & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def _whole(page: Page) -> np.ndarray:
    ws = page.starts
    we = page.word_end[ws]
    return _mix32((page.sums[we] - page.sums[ws]) * page.down[ws])


@dataclass
class Site:
    """Sites of one pattern in a page."""

    pattern: int
    pos: np.ndarray
    features: np.ndarray  # buckets of keep and each option: (option, feature, site)


def sites_of(page: Page, lexicon: np.ndarray, candidates: Candidates) -> list[Site]:
    by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
    for k, p in enumerate(candidates.patterns):
        pos = page.find(p)
        if len(pos):
            by_size.setdefault(len(p), []).append((k, pos))
    out = []
    for size, found in by_size.items():
        words = page.words(np.concatenate([pos for _, pos in found]), size)
        own: list[tuple[int, np.ndarray, np.ndarray]] = []
        at = 0
        for k, pos in found:
            p, mine = candidates.patterns[k], words[:, at : at + len(pos)]
            at += len(pos)
            known_now = _knows(lexicon, page.word_with(mine, p)) if p.strip("-¬ \n") == p else np.zeros(len(pos), bool)
            if p in candidates.rare:
                mine = mine[:, ~known_now]
                known_now = np.zeros(mine.shape[1], bool)
            own.append((k, mine, known_now))
        contexts = page.contexts(np.concatenate([mine for _, mine, _ in own], axis=1), size)
        at = 0
        for k, mine, known_now in own:
            n = mine.shape[1]
            if n:
                out.append(_site(page, lexicon, candidates, k, mine, known_now, contexts[:, at : at + n]))
            at += n
    return sorted(out, key=lambda site: site.pattern)


def _site(page: Page, lexicon: np.ndarray, candidates: Candidates, k: int, words: np.ndarray, known_now: np.ndarray, contexts: np.ndarray) -> Site:
    p = candidates.patterns[k]
    options = [p, *candidates.options[p]]
    features = np.empty((len(options), FEATURES, len(known_now)), np.int32)
    for j, new in enumerate(options):
        known = known_now if j == 0 else _knows(lexicon, page.word_with(words, new))
        extra = known.astype(np.uint64) + np.uint64(2) * known_now.astype(np.uint64)
        contexts[-2] = extra
        features[j, :-1] = _rows(contexts, k, j)
        kind = 0 if j == 0 else 1 if (p, new) in candidates.common else 2
        features[j, -1] = ((extra + np.uint64(4 * kind + 1)) * np.uint64(0xA24BAED4963EE407)) >> np.uint64(64 - BITS)
    return Site(k, words[0].astype(np.int64), features)


def _scores(weights: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Sums of the weights of features ``(feature, option, site)``, added up in pairs."""
    w = weights.take(features, mode="clip")
    s = w[:8] + w[8:16]
    s = s[::2] + s[1::2]
    s = s[::2] + s[1::2]
    s = s[0] + s[1]
    for x in w[16:]:
        s += x
    return s


def spoil(text: str, rng: random.Random, rate: float, breaks: float, spaced: float, marks: float, candidates: Candidates | None = None, spans: tuple[list[int], list[int]] | None = None) -> tuple[str, dict[tuple[int, str], str]]:
    """A clean text with scan noise, and what each noisy place (offset, pattern) was. ``spans``: its :func:`letter_spans`."""
    candidates = candidates or Candidates()
    by_was = candidates.by_was
    starts, ends = spans or next(letter_spans([text]))
    events: dict[int, list[tuple[int, str, str]]] = {}  # by offset: how many characters, read as, was
    cuts: dict[int, int] = {}  # where words are broken, -1 if spaced out
    for k in _chosen(rng, len(starts), spaced):
        s, e = starts[k], ends[k]
        if e - s > 2:
            cuts[k] = -1
            events.update((i, [(0, " ", "")]) for i in range(s + 1, e))
    for k in _chosen(rng, len(starts), breaks):
        s, e = starts[k], ends[k]
        if e - s > 4 and k not in cuts:
            cuts[k] = rng.randrange(s + 2, e - 1)
            events[cuts[k]] = [(0, rng.choice(BREAKS), "")]
    at_pairs: dict[int, bool] = {}  # two characters that were looked at, and whether they were replaced
    for size, share in ((2, rate * 0.5), (1, rate)):
        for at in _chosen(rng, len(text) + 1 - size, share):
            was = text[at : at + size]
            if was not in by_was or at in at_pairs or at_pairs.get(at - 1):
                continue
            k = bisect_right(starts, at) - 1
            if k < 0 or at + size > ends[k] or cuts.get(k) == -1 or (size > 1 and cuts.get(k) == at + 1):
                continue
            read = rng.choice(by_was[was])
            happens = rng.random() < candidates.rate.get((read, was), 1.0)
            if happens:
                events.setdefault(at, []).append((size, read, was))
            if size > 1:
                at_pairs[at] = happens
    for k in _chosen(rng, len(starts), marks):
        e = ends[k]
        if text[e : e + 1] in (" ", "\n", ""):
            events.setdefault(e, []).append((0, rng.choice(MARKS), ""))
    parts, gold, at, grown = [], {}, 0, 0
    for i in sorted(events):
        parts.append(text[at:i])
        at = i
        for size, read, was in events[i]:
            gold[at + grown, read] = was
            parts.append(read)
            grown += len(read) - size
            at += size
    return "".join(parts) + text[at:], gold


def _chosen(rng: random.Random, n: int, share: float) -> Iterator[int]:
    """Numbers below ``n``, each with the chance ``share`` (below 1), drawn by the gaps between them."""
    if share <= 0:
        return
    scale = 1 / math.log(1 - share)
    at = int(math.log(1 - rng.random()) * scale)
    while at < n:
        yield at
        at += 1 + int(math.log(1 - rng.random()) * scale)


@dataclass
class ScanModel:
    weights: np.ndarray
    lexicon: np.ndarray
    lines: dict[str, float]
    margin: float = MARGIN
    candidates: Candidates = field(default_factory=Candidates)


def fit_editor(texts: list[str], rng: random.Random, candidates: Candidates, lexicon: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Averaged perceptron over sites of spoilt texts, by mini-batches of sites.

    Some words of the texts must be missing in the lexicon, so that unknown words are learnt too.
    """
    if lexicon is None:
        lexicon = lexicon_of(texts[: len(texts) * 4 // 5])
    spoilt, golds = [], []
    for k, (t, spans) in enumerate(zip(texts, letter_spans(texts))):
        level = k % 3
        if level == 0:
            spoilt.append(t)
            golds.append({})
        else:
            s, g = spoil(t, rng, (0.02, 0.06)[level - 1], 0.03, 0.01, 0.01, candidates, spans)
            spoilt.append(s)
            golds.append(g)
    groups = []
    for a in range(0, len(spoilt), 300):
        page = Page(spoilt[a : a + 300])
        answer: dict[str, list[tuple[int, int]]] = {}
        for start, g in zip(page.starts.tolist(), golds[a : a + 300]):
            for (o, p), was in g.items():
                answer.setdefault(p, []).append((start + o, 1 + candidates.options[p].index(was)))
        for site in sites_of(page, lexicon, candidates):
            right = np.zeros(len(site.pos), np.int64)
            if own := answer.get(candidates.patterns[site.pattern]):
                at, option = np.array(own, np.int64).T
                where = np.minimum(np.searchsorted(site.pos, at), len(site.pos) - 1)
                met = site.pos[where] == at
                right[where[met]] = option[met]
            groups.append((np.ascontiguousarray(site.features.transpose(2, 0, 1)), right))
    w = np.zeros(1 << BITS)
    late = np.zeros(1 << BITS)  # of what was added, how much the averaged states didn't have yet
    order = np.random.default_rng(5)
    steps, numbers = 0, np.arange(BATCH)
    for _ in range(EPOCHS):
        for g in order.permutation(len(groups)):
            features, right = groups[g]
            shuffled = order.permutation(len(right))
            features, right = features.take(shuffled, axis=0).transpose(2, 1, 0), right[shuffled]
            for b in range(0, len(right), BATCH):
                f, r = features[:, :, b : b + BATCH], right[b : b + BATCH]
                guess = _scores(w, f)
                guess[r, numbers[: len(r)]] -= 1.0  # a margin, so that right answers are also well apart
                wrong = guess.argmax(axis=0) if len(guess) > 2 else (guess[1] > guess[0]).view(np.int8)
                bad = np.flatnonzero(wrong != r)
                if len(bad):
                    step = 1.0 / np.sqrt(len(bad))
                    for sign, option in ((step, r), (-step, wrong)):
                        at = f[:, option[bad], bad].ravel()
                        np.add.at(w, at, sign)
                        np.add.at(late, at, sign * (steps // 8))
                steps += 1
    n = steps // 8  # every eighth state is averaged
    return ((w * n - late) / max(1, n)).astype(np.float32), lexicon


#: The forms of page numbers.
_NUMBERS = ["— {n} —", "- {n} -", "[p. {n}]", "p.{n}", "Page {n} of {m}", "Folha {n}/{m}", "S. {n}", "{n}"]
_NUMBER_LINE = re.compile(r"[—–-] ?\d{1,4} ?[—–-]|\[?[pPsS]\. ?\d{1,4}\]?|(?:Page|Folha|Seite|Página|Стр\.?|Σελ\.?) \d{1,4}(?: ?(?:of|/|von|de|из) ?\d{1,4})?|\d{1,4}|\d{1,4} ?/ ?\d{1,4}")
_TITLE = re.compile(r"[^\W\d_][\w’'-]*(?: [^\W\d_][\w’'-]*){0,5}(?: \d{1,5})?")


_DIGITS = re.compile(r"\d+")
_TAIL = re.compile(r" {2,}(\S.*)$")
_MARK = re.compile(r"[#*|•]|\d+[.)] ")
_SHAPES = [(_DIGITS, "0"), (re.compile(r"[a-zß-ÿα-ωά-ώа-яё]+"), "a"), (re.compile(r"[A-ZÀ-ÞΑ-ΩА-Я]+"), "A"), (re.compile(r"(A )+"), "A "), (re.compile(r"(Aa ?)+"), "T ")]


@lru_cache(maxsize=1 << 14)
def _shape(line: str) -> str:
    for pattern, new in _SHAPES:
        line = pattern.sub(new, line)
    return line[:16]


def candidate_lines(lines: list[str]) -> list[int]:
    """Lines that might be furniture: short, a page number, or like a title; never the only one."""
    if len(lines) < 2:
        return []
    out = []
    for i, line in enumerate(lines):
        s = line.strip()
        if s and len(s) <= 60 and s[-1] not in ".,;:!?”»" and (s[-1].isdigit() or (s[-1] in "—–-]" and s[0] in "—–-[") or (s[0].isupper() and s[-1] not in "-¬")):
            out.append(i)
    return out


def line_features(lines: list[str], i: int, common: Counter, joined: str) -> tuple[str, ...]:
    """Of line ``i``: its form, its neighbours, its place in the page and whether it recurs. ``joined`` is all of :func:`_joined`."""
    above, below, n = i - 1, i + 1, len(lines)
    while above >= 0 and not lines[above].strip():
        above -= 1
    while below < n and not lines[below].strip():
        below += 1
    up, down = _short(_beside, lines[above] if above >= 0 else ""), _short(_beside, lines[below] if below < n else "")
    s = lines[i].strip()
    room = (above < i - 1 or above < 0, below > i + 1 or below == n)
    begins = joined.count("\n" + s) > lines[i].startswith(s)
    return _line_names(_own(s), up, down, i == 0, room, begins, common[_short(_key, s)] > 1)


def _short(f, line: str):
    """A remembered result, but for longer lines, which aren't remembered."""
    return f(line) if len(line) <= 200 else f.__wrapped__(line)


@lru_cache(maxsize=1 << 14)
def _key(line: str) -> str:
    return _DIGITS.sub("#", line.strip()).lower()


def _joined(lines: list[str]) -> str:
    return "\n" + "\n".join(lines)


@lru_cache(maxsize=1 << 14)
def _own(s: str) -> tuple:
    """What features need of a line itself."""
    number = bool(_NUMBER_LINE.fullmatch(s))
    tail = _TAIL.search(s) if "  " in s else None
    title = bool(_TITLE.fullmatch(s.split("    ")[0]))
    form = "bare" if number and s.isdigit() else "number" if number else "title+number" if tail and _NUMBER_LINE.fullmatch(tail.group(1)) else "title" if title else "other"
    return form, "caps" if s.isupper() else "", _shape(s), "mark" if _MARK.match(s) else "", any(c in s for c in "|\t;"), len(s) // 8


@lru_cache(maxsize=1 << 14)
def _beside(line: str) -> tuple:
    """What features need of a line that stands beside one: before it, and after it."""
    up, down = line.rstrip(), line.strip()
    end = "none" if not up else "stop" if up[-1] in ".!?”»\"" else "hyphen" if up[-1] in "-¬" else "comma" if up[-1] in ",;:" else "digit" if up[-1].isdigit() else "word"
    begin = "none" if not down else "lower" if down[0].islower() else "upper" if down[0].isupper() else "digit" if down[0].isdigit() else "sign"
    blanks, last = up.count(" "), up[-80:]
    title = blanks < 4 and bool(_TITLE.fullmatch(down))
    cells = "|" in last or "\t" in last or ";" in last
    return end, begin, bool(_NUMBER_LINE.fullmatch(down)), title, cells, (len(up) > 40, blanks > 4), (len(down) > 40, down.count(" ") > 4)


@lru_cache(maxsize=1 << 14)
def _line_names(own: tuple, above: tuple, below: tuple, start: bool, blank: tuple[bool, bool], prefix: bool, recurs: bool) -> tuple[str, ...]:
    form, caps, shape, mark, parted, size = own
    end, _, number_up, title_up, cells_up, up, _ = above
    _, begin, number_down, _, _, _, down = below
    room = f"{blank[0]}{blank[1]}"
    place = "first" if start or end == "none" else "last" if begin == "none" else "amid"
    wide, prose = (f"{a}{b}" for a, b in zip(up, down))
    partner = number_up or number_down
    begins = "begins" if prefix else ""
    over = "title" if title_up else "text"
    again = "again" if recurs else ""
    cells = "cells" if parted or cells_up else ""
    return (
        "1", f"form={form}", f"{form},{place}", f"{form},{end},{begin}", f"{form},{end}", f"{form},{begin}", f"{form},{room}", f"{form},{wide}", f"{form},{prose}", f"{form},{prose},{place}", f"{form},{caps}",
        f"shape={shape}", f"shape={shape},{prose}", f"{form},{again}", f"{form},{partner}", f"{form},{partner},{end},{begin}", f"{form},{place},{end},{begin},{prose}", f"{mark},{form}", f"{cells},{form}", f"len={size},{form}", f"{form},{room},{end},{begin}",
        f"{form},{begins},{place}", f"{form},{over}", f"{form},{over},{room},{prose}",
    )


def _recurring(lines: list[str]) -> Counter:
    return Counter([_key(x) if len(x) <= 200 else _key.__wrapped__(x) for x in lines])


def furnish(text: str, rng: random.Random, titles: list[str]) -> tuple[str, set[int]]:
    """Put running headings and page numbers amid a text; gives it with the numbers of their lines."""
    lines = text.split("\n")
    if len(lines) < 3 and len(text) > 160:
        words, lines, row = text.split(" "), [], ""
        for w in words:
            if len(row) + len(w) > 76:
                lines.append(row)
                row = w
            else:
                row = f"{row} {w}".strip()
        lines.append(row)
    if len(lines) < 3:
        return text, set()
    title = lines[0].strip("# ")[:50]
    if titles and (not _TITLE.fullmatch(title) or rng.random() < 0.3):
        title = rng.choice(titles)
    first = next((i for i, x in enumerate(lines) if x.count(" ") > 5), 0) + 1  # not between a title and its text
    if first >= len(lines):
        return text, set()
    out, found, cuts = [], set(), set(rng.sample(range(first, len(lines)), min(len(lines) - first, rng.choice((1, 1, 2, 3)))))
    for i, line in enumerate(lines):
        if i in cuts:
            n = rng.randrange(1, 150)
            number = rng.choice(_NUMBERS).format(n=n, m=n + rng.randrange(100))
            head = rng.choice((title, title.upper())) if title else ""
            kind = rng.random()
            new = [number] if not head or kind < 0.4 else [number, head] if kind < 0.6 else [head] if kind < 0.75 else [f"{head}    {number}"]
            # a heading alone between blank lines after a full stop would be a title
            stop = not out or out[-1].rstrip()[-1:] in ".!?”»\"" or not out[-1].strip()
            room = [""] if rng.random() < 0.35 and not (new == [head] and stop) else []
            if rng.random() < 0.35 and out and out[-1][-3:].isalpha():
                out[-1] += rng.choice("-¬")
            out += room
            for x in new:
                found.add(len(out))
                out.append(x)
            out += room
        out.append(line)
    return "\n".join(out), found


def _cut(lines: list[str], found: set[int], rng: random.Random) -> tuple[list[str], set[int]]:
    """A part of a page, cut anywhere, as in a snippet."""
    start = rng.randrange(max(1, len(lines) - 2))
    part = lines[start : start + rng.randrange(3, 9)]
    inside = {i - start for i in found if 0 <= i - start < len(part)}
    for i, keep in ((0, False), (len(part) - 1, True)):
        if len(part[i]) > 1 and rng.random() < 0.85:
            at = rng.randrange(1, len(part[i]))
            if i not in inside:
                part[i] = part[i][:at] if keep else part[i][at:]
    return part, inside


def fit_lines(texts: list[str], rng: random.Random) -> dict[str, float]:
    """Averaged perceptron over the lines of clean pages, of pages with furniture and of parts of both."""
    data = []
    titles = [t.split("\n", 1)[0] for t in texts]
    titles = [t for t in titles if len(t) < 50 and _TITLE.fullmatch(t)]
    for t in texts:
        for k in range(4):
            text, found = (t, set()) if k < 2 else furnish(t, rng, titles)
            lines = text.split("\n")
            if k % 2 and len(lines) > 2:
                lines, found = _cut(lines, found, rng)
            maybe = candidate_lines(lines)
            if maybe:
                common, joined = _recurring(lines), _joined(lines)
            for i in maybe:
                data.append((line_features(lines, i, common, joined), i in found))
    numbers: dict[str, int] = {}
    rows = {f: [numbers.setdefault(x, len(numbers)) for x in f] for f in dict.fromkeys([f for f, _ in data])}
    data = [(rows[f], 1 if right else -1) for f, right in data]
    w, total = [0] * len(numbers), [0] * len(numbers)
    step = 1
    for _ in range(LINE_EPOCHS):
        rng.shuffle(data)
        for f, d in data:
            if sum([w[x] for x in f]) * d < 2:  # wrong, or not by a margin
                for x in f:
                    w[x] += d
                    total[x] += d * step
            step += 1
    return {name: w[x] - total[x] / step for name, x in numbers.items() if w[x] or total[x]}


def fit(texts: list[str], noisy: Iterable[str] = (), seed: int = 11) -> ScanModel:
    rng = random.Random(seed)
    candidates = Candidates(learn_confusions(noisy, texts))
    parts = [t[i : i + PART_CHARS] for t in texts for i in range(0, len(t), PART_CHARS)]
    weights, lexicon = fit_editor(parts, rng, candidates)
    return ScanModel(weights, lexicon, fit_lines(texts, rng), candidates=candidates)


def _words_of(df: DataFrame, noisy: bool) -> DataFrame:
    """Distinct ``(bit, held, word)`` of all values of the columns: the words that confusions are learnt from, and of clean
    texts the places of known words in the table, ``held`` for those that stand in a fifth of the texts only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelt: set[str] = set()
        words: tuple[set[str], set[str]] = (set(), set())

        def flush() -> pa.RecordBatch:
            taught, held = (_word_bits(x) for x in words)
            held = np.setdiff1d(held, taught)
            none, n = [pa.nulls(len(spelt), pa.int64()), pa.nulls(len(spelt), pa.bool_())], len(taught) + len(held)
            bits = pa.array(np.concatenate([taught, held]))
            out = [pa.concat_arrays([none[0], bits]), pa.concat_arrays([none[1], pa.array(np.arange(n) >= len(taught))]), pa.concat_arrays([pa.array(sorted(spelt), pa.string()), pa.nulls(n, pa.string())])]
            for x in (spelt, *words):
                x.clear()
            return pa.record_batch(out, names=["bit", "held", "word"])

        for batch in batches:
            stretches: tuple[set[str], set[str]] = (set(), set())  # between blanks; no word holds one
            for text in {t for c in batch.columns for t in c.to_pylist() if t}:
                held = not noisy and zlib.crc32(text.encode("utf-8", "surrogatepass")) % 5 == 4
                stretches[held].update(text.split())
            for own, part in zip(words, stretches):
                joined = " ".join(sorted(part))
                spelt |= _spelt(_even(joined) if noisy else joined)
                if not noisy:
                    own.update(_WORDS.findall(joined))
            if len(spelt) + len(words[0]) + len(words[1]) > 500_000:
                yield flush()
        yield flush()

    return df.mapInArrow(run, "bit bigint, held boolean, word string").groupBy("bit", "word").agg(F.min("held").alias("held"))


def _tables_of(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The table of all known words, and the one without those held back."""
    mask = F.expr("shiftleft(1L, cast(bit & 63 as int))")
    found = words.filter("bit is not null").groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(mask).alias("a"), F.bit_or(F.when(~F.col("held"), mask).otherwise(F.lit(0).cast("bigint"))).alias("b")).toArrow()
    tables = np.zeros((2, 1 << _LEX_BITS - 6), np.uint64)
    for table, c in zip(tables, "ab"):
        table[found.column("at").to_numpy()] = found.column(c).to_numpy().view(np.uint64)
    return tables[0], tables[1]


def groups_of(texts: list[str]) -> Iterator[list[str]]:
    """All texts in groups of much the same number of characters, so that memory doesn't grow with their lengths."""
    ends = np.cumsum([len(t) for t in texts])
    n = max(1, round(int(ends[-1]) / GROUP_CHARS))
    cuts = [0, *np.searchsorted(ends, [int(ends[-1]) * k // n for k in range(1, n)]).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            yield texts[a:b]


@contextmanager
def _no_collecting() -> Iterator[None]:
    """Without looking for garbage in cycles, of which there is none here; what isn't used any more goes at once all the same."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


#: Weights are added up as whole numbers of this fraction, so that sums don't depend on the order.
_UNIT = 1 << 20
_EDITOR, _LINES, _GROUPS, _CODES, _MADE = range(5)


def fit_on(docs: DataFrame, noisy: DataFrame, text_col: str = "text", fields: tuple[str, ...] = ("context", "document_text")) -> tuple[ScanModel, EncodingModel]:
    """Train on all clean texts, and on the noisy values of ``fields``: this model, and the one of problem 1.

    Words and confusions are counted over all texts and values. Every distinct part of a clean text is learnt from: groups
    of ``GROUP_CHARS`` train by themselves, and their weights are averaged by their parts; the counts of problem 1
    are added up. What a group holds and what comes out doesn't depend on the order or partitions of the tables.
    """
    seen = materialize(_words_of(docs.select(text_col), False), "p4-words")
    lexicon, taught = _tables_of(seen)
    spelt = _words_of(noisy.select(*fields), True)
    candidates = Candidates(confusions_in(spelt.select("word"), seen.filter("word is not null").select("word")))
    discard(seen)
    at = np.flatnonzero(taught)
    shared = docs.sparkSession.sparkContext.broadcast((at, taught[at], candidates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bits, candidates = shared.value
        table = np.zeros(1 << _LEX_BITS - 6, np.uint64)
        table[at] = bits
        texts = [t for batch in batches for t in batch.column(0).to_pylist()]
        if not texts:
            return
        with _no_collecting():
            yield from learn(texts, table, candidates)

    def learn(texts: list[str], table: np.ndarray, candidates: Candidates) -> Iterator[pa.RecordBatch]:
        texts = [t for _, t in sorted((zlib.crc32(t.encode("utf-8", "surrogatepass")), t) for t in texts)]
        weights, lines = np.zeros(1 << BITS, np.int64), Counter()
        for group in groups_of(texts):
            rng = random.Random(zlib.crc32(group[0].encode("utf-8", "surrogatepass")))
            parts = [t[i : i + PART_CHARS] for t in group for i in range(0, len(t), PART_CHARS)]
            weights += np.rint(fit_editor(parts, rng, candidates, table)[0].astype(np.float64) * (_UNIT * len(group))).astype(np.int64)
            for x, v in fit_lines(group, rng).items():
                lines[x] += round(v * _UNIT * len(group))
        counts, made_of = count(texts)
        for kind, sums in ((_EDITOR, weights), (_CODES, counts.ravel()), (_MADE, made_of), (_GROUPS, np.array([len(texts)]))):
            key = np.flatnonzero(sums)
            yield pa.record_batch([pa.array(np.full(len(key), kind, np.int8)), pa.array(key), pa.nulls(len(key), pa.string()), pa.array(sums[key])], names=names)
        yield pa.record_batch([pa.array(np.full(len(lines), _LINES, np.int8)), pa.array(np.zeros(len(lines), np.int64)), pa.array(list(lines), pa.string()), pa.array(list(lines.values()), pa.int64())], names=names)

    names = ["kind", "key", "name", "n"]
    found = distinct_parts(docs, text_col).mapInArrow(run, "kind tinyint, key bigint, name string, n bigint").groupBy("kind", "key", "name").agg(F.sum("n").alias("n")).toArrow()
    shared.unpersist()
    kind, key, n = (found.column(c).to_numpy() for c in ("kind", "key", "n"))

    def dense(k: int, size: int) -> np.ndarray:
        out = np.zeros(size, np.int64)
        out[key[kind == k]] = n[kind == k]
        return out

    scale = 1 / (_UNIT * max(1, int(dense(_GROUPS, 1)[0])))
    lines = {x: int(v) * scale for x, v in sorted(zip(found.column("name").filter(pa.array(kind == _LINES)).to_pylist(), n[kind == _LINES].tolist()))}
    model = ScanModel((dense(_EDITOR, 1 << BITS) * scale).astype(np.float32), lexicon, lines, candidates=candidates)
    return model, of_counts(dense(_CODES, BUCKETS * len(LABELS)).reshape(BUCKETS, len(LABELS)), dense(_MADE, len(LABELS)))


_rewriters: list[Rewriter] = []
#: Characters of which one at least is in every text that is not in that form.
_CODED = re.compile("[\u00a0\u00ad\u0132\u0133\u01c4-\u01cc\u01f1-\u01f3\u0300-\u058f\u1100-\u11ff\u13a0-\u13ff\u1680\u180e\u1f00-\u1fff\u2000-\u200f\u202f\u205f-\u2064\u3000\uab70-\uabbf\ufb00-\ufb17\ufeff\uff01-\uffe6\U0001d400-\U0001d7ff]")


def _even(text: str) -> str:
    """The text in the consistent form of problem 6."""
    if text.isascii() or not _CODED.search(text):
        return text
    if not _rewriters:
        _rewriters.append(choose(find_classes(), {}))
    return _rewriters[0].rewrite(text)[0]


class Restorer:
    def __init__(self, model: ScanModel):
        self.model = model
        self._lines: dict[tuple[str, ...], bool] = {}

    def furniture(self, text: str) -> tuple[str, int]:
        """The text without running headings and page numbers, and how many lines those were.

        They stand amid the text: a value whose only ones are its first or last line keeps them, as these may
        as well be the cut row of a table or a title.
        """
        if "\n" not in text:
            return text, 0
        lines = text.split("\n")
        found = candidate_lines(lines)
        if not found:
            return text, 0
        w, common, joined = self.model.lines, _recurring(lines), _joined(lines)
        drop = set()
        for i in found:
            f = line_features(lines, i, common, joined)
            if f not in self._lines:
                if len(self._lines) >= 1 << 14:
                    self._lines.clear()
                self._lines[f] = sum([w.get(x, 0.0) for x in f]) > 0
            if self._lines[f]:
                drop.add(i)
        if not drop:
            return text, 0
        full = [i for i, x in enumerate(lines) if x.strip()]
        if not drop - {full[0], full[-1]}:
            return text, 0
        kept: list[str] = []
        for i, line in enumerate(lines):
            if i in drop:
                continue
            # blank lines around furniture are the page's, not a paragraph's, if the sentence goes on
            if not line.strip() and kept and (i - 1 in drop or i + 1 in drop):
                continue
            kept.append(line)
        return "\n".join(kept), len(drop)

    def edit(self, texts: list[str]) -> list[tuple[str, Counter]]:
        """Each text with its edits applied, and how many of each kind: wrong, join, spaced, mark."""
        out: list[tuple[str, Counter]] = []
        group, chars = [], 0
        for t in texts:
            if group and chars + len(t) > CHUNK:
                out += self._edit(group)
                group, chars = [], 0
            group.append(t)
            chars += len(t) + _PAD
        return out + self._edit(group) if group else out

    def _edit(self, texts: list[str]) -> list[tuple[str, Counter]]:
        if len(texts) == 1 and len(texts[0]) > CHUNK:
            text = texts[0]
            edits = [(s, a + pos, p, j) for a, b, core in _pieces(text) for own in self._proposals([text[a:b]]) for s, pos, p, j in own if core.start <= a + pos < core.stop]
            return [self._apply(text, edits)]
        return [self._apply(t, own) for t, own in zip(texts, self._proposals(texts))]

    def _proposals(self, texts: list[str]) -> list[list[tuple[float, int, int, int]]]:
        """Edits that beat 'keep' in each text: score, offset, pattern and option."""
        page = Page(texts)
        w, edits = self.model.weights, []
        for site in sites_of(page, self.model.lexicon, self.model.candidates):
            scores = _scores(w, site.features.transpose(1, 0, 2))
            gains = scores[1:] - scores[0]
            best, which = gains.max(axis=0), gains.argmax(axis=0)
            for k in np.flatnonzero(best > self.model.margin).tolist():
                edits.append((float(best[k]), int(site.pos[k]), site.pattern, int(which[k])))
        per_text: list[list] = [[] for _ in texts]
        owner = np.searchsorted(page.starts, [e[1] for e in edits], side="right") - 1 if edits else []
        starts = page.starts.tolist()
        for (s, pos, p, j), o in zip(edits, owner):
            per_text[o].append((s, pos - starts[o], p, j))
        return per_text

    def _apply(self, t: str, own: list[tuple[float, int, int, int]]) -> tuple[str, Counter]:
        """The best edits first, each place once; the words of the whole text have a say."""
        c = self.model.candidates
        counts: Counter = Counter()
        taken: list[tuple[int, int, str]] = []
        used: set[int] = set()
        ordered = [(pos, c.patterns[p], c.options[c.patterns[p]][j]) for _, pos, p, j in sorted(own, key=lambda e: (-e[0], e[1], e[2]))]
        words = Words(t, ordered, self.model.lexicon) if any(pattern in c.letters for _, pattern, _ in ordered) else None
        for a, pattern, was in ordered:
            place = range(a, a + len(pattern))
            if used.isdisjoint(place):
                if pattern in c.letters and words.keeps(a, pattern, was):
                    continue
                used.update(place)
                taken.append((a, a + len(pattern), was))
                counts["join" if pattern in BREAKS else "spaced" if pattern == " " else "mark" if pattern in MARKS else "wrong"] += 1
        parts, at = [], 0
        for a, b, new in sorted(taken):
            parts += [t[at:a], new]
            at = b
        return "".join(parts) + t[at:], counts

    def restore(self, texts: list[str]) -> list[tuple[str, Counter]]:
        stripped = [self.furniture(_even(t)) for t in texts]
        edited = self.edit([t for t, _ in stripped])
        for (_, n), (_, counts) in zip(stripped, edited):
            if n:
                counts["furniture"] += n
        return edited


def _pieces(text: str) -> Iterator[tuple[int, int, range]]:
    """Overlapping pieces of a long text: start, end, and the places that are judged by this piece.

    A piece reaches over its core to white space beyond 16 characters on either side, further than features look,
    so that what is seen of a place is the same as in the whole text.
    """
    step = CHUNK // 2
    for a in range(0, len(text), step):
        b = min(a + step, len(text))
        start, end = max(0, a - 16), min(len(text), b + 16)
        while start > max(0, a - LONGEST_WORD) and not text[start].isspace():
            start -= 1
        while end < min(len(text), b + LONGEST_WORD) and not text[end - 1].isspace():
            end += 1
        yield start, end, range(a, b)


#: Within words: what breaks them over lines, and invisible characters.
_WITHIN = r"[-¬] ?\n|[\u00ad\u200b-\u200f\u2060\ufeff]+"
_SCANNED_WORD = re.compile(rf"(?:[^\W_]|[@†])+(?:(?:{_WITHIN})(?:[^\W_]|[@†])+)*")
#: A longer run of letters is no word to look up.
LONGEST = 60


def is_known(word: str, lexicon: np.ndarray) -> bool:
    return bool(_knows(lexicon, _whole(Page([word])))[0])


def _whole_word(s: str) -> str:
    return re.sub(_WITHIN, "", s).lower()


class Words:
    """The words of a text with the edits ``(offset, pattern, was)`` proposed for it, the best first."""

    def __init__(self, text: str, edits: list[tuple[int, str, str]], lexicon: np.ndarray):
        self.text, self.lexicon = text, lexicon
        self.spans = [m.span() for m in _SCANNED_WORD.finditer(text)]
        self.starts = [a for a, _ in self.spans]
        self.count = Counter(_whole_word(text[a:b]) for a, b in self.spans)
        self.edits: dict[int, list[tuple[int, str, str]]] = {}
        for e in edits:
            self.edits.setdefault(self._word(e[0]), []).append(e)

    def _word(self, at: int) -> int:
        return bisect_right(self.starts, at) - 1

    def keeps(self, at: int, pattern: str, was: str) -> bool:
        """Whether the word at ``at`` is to stay: a longer word that stands elsewhere in the text just so, as a
        scan seldom errs twice alike. It doesn't stay if it is unknown, and what all edits make of it is
        known or stands in the text."""
        k = self._word(at)
        a, b = self.spans[k]
        word = _whole_word(self.text[a:b])
        if len(word) <= 4 or not self._recurs(word, a, b):
            return False
        if b - a > LONGEST or is_known(word, self.lexicon):
            return True
        alone = [(at, pattern, was)]
        return not any(right in self.count or is_known(right, self.lexicon) for right in (self._edited(a, b, alone), self._edited(a, b, alone + self.edits[k])))

    def _recurs(self, word: str, a: int, b: int) -> bool:
        """A word at an edge of the text may be cut there, as in a snippet."""
        if self.count[word] > 1 or (a == 0 and any(w != word and w.endswith(word) for w in self.count)):
            return True
        return b == len(self.text) and any(w != word and w.startswith(word) for w in self.count)

    def _edited(self, a: int, b: int, edits: list[tuple[int, str, str]]) -> str:
        """The word at ``a:b`` with those of the edits that fit into it, the first before the others."""
        new = list(self.text[a:b])
        used: set[int] = set()
        for at, pattern, was in edits:
            place = range(at - a, at - a + len(pattern))
            if place.stop <= len(new) and used.isdisjoint(place):
                used.update(place)
                new[place.start : place.stop] = [was, *[""] * (len(pattern) - 1)]
        return _whole_word("".join(new))


def is_case(counts: Counter) -> bool:
    """A word spaced out or a stray mark counts as one wrongly recognised character."""
    return bool(counts["join"] or counts["furniture"] or counts["wrong"] + counts["mark"] + (counts["spaced"] > 1) >= SEVERAL)


_WRAP = re.compile(r"(?<=[^\n])[ \t]*\n[ \t]*(?=[^\W_]|[“«(„])")


def reflow(text: str) -> str:
    """Wrapped lines of prose joined into paragraphs; blank lines, lists and tables stay."""
    paragraphs = []
    for p in re.split(r"\n[ \t]*\n", text):
        lines = p.split("\n")
        prose = len(lines) > 1 and sum(len(x) for x in lines[:-1]) > 40 * (len(lines) - 1) and not any(re.match(r"\s*(?:[-*•|#]|\d+[.)] )", x) or "\t" in x or " | " in x for x in lines[1:])
        paragraphs.append(_WRAP.sub(" ", p) if prose else p)
    return "\n\n".join(paragraphs)


def restore_fields(rows: DataFrame, model: ScanModel, garbled: EncodingModel | None = None, id_col: str = "match_id", fields: tuple[str, ...] = ("context", "document_text")) -> DataFrame:
    """``(id_col, field, joins, wrong, furniture, restored)``: each value with scan noise, and it repaired.

    A value is a case if a word is broken over lines, ``SEVERAL`` or more characters are wrongly recognised,
    or a running heading or page number stands amid the text. Null and empty values are never returned;
    repeated rows are judged each for itself; whole texts are read, very long ones in pieces; other columns
    are not read. No shuffle. The model has a fixed size (about 18 MB).
    """
    kind = rows.schema[id_col].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast((model, garbled))
    names = [id_col, "field", "joins", "wrong", "furniture", "restored"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, garbled = shared.value
        restorer, judge = Restorer(model), Repairer(garbled) if garbled is not None else None
        for batch in batches:
            with _no_collecting():
                out = judged(batch, restorer, judge)
            yield out

    def judged(batch: pa.RecordBatch, restorer: Restorer, judge: Repairer | None) -> pa.RecordBatch:
        at, which, joins, wrong, furniture, texts = [], [], [], [], [], []
        for j, field in enumerate(fields, 1):
            values = batch.column(j).to_pylist()
            index = [i for i, v in enumerate(values) if v]
            if judge:
                values = [t for _, t in judge.repair_all(values)]
            distinct = list(dict.fromkeys(values[i] for i in index))
            restored = dict(zip(distinct, restorer.restore(distinct)))
            for i in index:
                new, counts = restored[values[i]]
                if is_case(counts):
                    at.append(i)
                    which.append(field)
                    joins.append(counts["join"])
                    wrong.append(counts["wrong"])
                    furniture.append(counts["furniture"])
                    texts.append(reflow(new))
        ints = [pa.array(x, pa.int64()) for x in (joins, wrong, furniture)]
        return pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), pa.array(which, pa.string()), *ints, pa.array(texts, pa.string())], names=names)

    return rows.select(id_col, *fields).mapInArrow(run, f"`{id_col}` {kind}, field string, joins bigint, wrong bigint, furniture bigint, restored string")
