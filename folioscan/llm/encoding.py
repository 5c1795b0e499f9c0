"""Problem 1: text that was decoded with a wrong encoding.

A multinomial (naive Bayes) classifier over hashed byte bigrams, trained on clean texts that were
garbled on purpose by every chain of encodings in :data:`CHAINS`. It looks at each word that holds
characters beyond ASCII, with the characters beside it, and predicts the exact chain or 'clean'. The
predicted chain is undone; what comes out must decode strictly and must be likelier as clean text than
what stood there.
"""

from __future__ import annotations

import codecs
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import sample_texts

#: The encodings a text had, and was read with, in order of the steps.
CHAINS: dict[str, tuple[tuple[str, str], ...]] = {
    "utf8>cp1252": (("utf-8", "cp1252"),),
    "utf8>latin1": (("utf-8", "latin-1"),),
    "utf8>cp1251": (("utf-8", "cp1251"),),
    "utf8>cp1250": (("utf-8", "cp1250"),),
    "utf8>cp1253": (("utf-8", "cp1253"),),
    "utf8>koi8r": (("utf-8", "koi8-r"),),
    "utf8>mac": (("utf-8", "mac_roman"),),
    "utf8>cp437": (("utf-8", "cp437"),),
    "utf8>cp850": (("utf-8", "cp850"),),
    "utf8>cp866": (("utf-8", "cp866"),),
    "utf8>cp1252 twice": (("utf-8", "cp1252"), ("utf-8", "cp1252")),
    "utf8>latin1 twice": (("utf-8", "latin-1"), ("utf-8", "latin-1")),
    "utf8>mac twice": (("utf-8", "mac_roman"), ("utf-8", "mac_roman")),
    "cp1252>mac": (("cp1252", "mac_roman"),),
    "cp1252>cp437": (("cp1252", "cp437"),),
    "cp1252>cp850": (("cp1252", "cp850"),),
    "cp1252>cp1251": (("cp1252", "cp1251"),),
    "mac>cp1252": (("mac_roman", "cp1252"),),
    "cp437>cp1252": (("cp437", "cp1252"),),
    "cp850>cp1252": (("cp850", "cp1252"),),
    "cp1251>cp1252": (("cp1251", "cp1252"),),
    "cp1251>mac": (("cp1251", "mac_roman"),),
    "cp1251>koi8r": (("cp1251", "koi8-r"),),
    "cp1251>cp866": (("cp1251", "cp866"),),
    "koi8r>cp1251": (("koi8-r", "cp1251"),),
    "koi8r>cp1252": (("koi8-r", "cp1252"),),
    "cp866>cp1251": (("cp866", "cp1251"),),
    "cp1253>cp1252": (("cp1253", "cp1252"),),
    "cp1253>mac": (("cp1253", "mac_roman"),),
    "cp1253>cp1251": (("cp1253", "cp1251"),),
    "gbk>cp1252": (("gbk", "cp1252"),),
    "gbk>latin1": (("gbk", "latin-1"),),
}
CLEAN, LOST = "clean", "lost"
LABELS = [CLEAN, LOST, *CHAINS]

#: Rows of the sample for fitting, buckets of the hash, and pseudo-count.
SAMPLE_ROWS, BUCKETS, SMOOTH = 4000, 1 << 15, 0.05
#: Words of each text that get the traces of other problems for training.
NOISY_WORDS = 6
#: Log of how much rarer a garbled word is thought to be than a clean one, and the margin beyond it.
PRIOR, MARGIN = -5.0, 2.0
#: Bigrams of one place say partly the same; their evidence counts by this factor.
TEMPER = 0.4
#: By how much a byte of the restored word must be likelier as clean text than one of what stood there.
GAIN = 0.5

#: From a word's first character beyond ASCII on; the ASCII letters and digits right before it are its own too.
_WORD = re.compile(r"[^\x00-\x7f][A-Za-z0-9\x80-\U0010ffff]*")
_ASCII_WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")


@lru_cache(maxsize=64)
def _table(codec: str) -> tuple[str, dict[int, int]]:
    """Characters of the 256 bytes of a single-byte codec, and the bytes of code points; bytes it leaves undefined stand for themselves."""
    chars = "".join(bytes([b]).decode(codec, "ignore") or chr(b) for b in range(256))
    return chars, {ord(c): b for b, c in reversed(list(enumerate(chars)))}


_MULTI = {"utf-8", "gbk"}


def encode(text: str, codec: str) -> bytes:
    if codec in _MULTI:
        return text.encode(codec)
    return codecs.charmap_encode(text, "strict", _table(codec)[1])[0]


def decode(data: bytes, codec: str) -> str:
    if codec in _MULTI:
        return data.decode(codec)
    return codecs.charmap_decode(data, "strict", _table(codec)[0])[0]


def garble(text: str, chain: str) -> str | None:
    """``text`` after the steps of a chain, None if it can't be encoded or doesn't change."""
    out = text
    try:
        for was, read in CHAINS[chain]:
            out = decode(encode(out, was), read)
    except UnicodeError:
        return None
    return out if out != text else None


def ungarble(text: str, chain: str) -> str | None:
    """The chain undone, None unless every step decodes strictly."""
    out = text
    try:
        for was, read in reversed(CHAINS[chain]):
            out = decode(encode(out, read), was)
    except UnicodeError:
        return None
    return out if out != text else None


def words_of(text: str) -> list[tuple[int, int, str]]:
    """Start, end and features text of each word beyond ASCII: the word with two characters on either side.

    No chain turns a byte above 127 into an ASCII character, so a garbled stretch never reaches over the
    ASCII sign at which a word ends.
    """
    out = []
    for m in _WORD.finditer(text):
        s, e = m.span()
        while s and text[s - 1] in _ASCII_WORD:
            s -= 1
        out.append((s, e, _before(text[max(0, s - 2) : s]) + text[s:e] + _after(text[e : e + 2])))
    return out


@lru_cache(maxsize=1 << 14)
def _before(two: str) -> str:
    return _side(two.rjust(2))


@lru_cache(maxsize=1 << 14)
def _after(two: str) -> str:
    return _side(two.ljust(2)[::-1])[::-1]


def _side(two: str) -> str:
    """Two characters beside a word, the outer one as its kind only."""
    far, near = two
    if far > "\x7f":
        far = "\x01"
    elif far.isalpha():
        far = "a"
    elif far.isdigit():
        far = "0"
    return far + ("\n" if near in "\r\n\t" else near)


#: No letter has a higher code point.
_LAST_LETTER = 0x3FFFF
_LETTERS = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    table = np.zeros(_LAST_LETTER + 2, bool)
    for m in _LETTERS.finditer("".join(map(chr, range(_LAST_LETTER + 1)))):
        table[m.start() : m.end()] = True
    return table


def letter_spans(texts: list[str], least: int = 1, rows: int = 250) -> Iterator[tuple[list[int], list[int]]]:
    """Of each text where the runs of ``least`` and more letters start and end; so many ``rows`` are looked at together."""
    for k in range(0, len(texts), rows):
        group = texts[k : k + rows]
        raw = np.frombuffer("\n".join(["", *group, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _is_letter()[np.minimum(raw, _LAST_LETTER + 1)]
        edges = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        starts, ends = edges[::2], edges[1::2]
        if least > 1:
            long = ends - starts >= least
            starts, ends = starts[long], ends[long]
        offsets = np.cumsum([1, *(len(t) + 1 for t in group)])
        cuts = np.searchsorted(starts, offsets)
        own = np.repeat(offsets[:-1], np.diff(cuts))
        at, to, cuts = (starts - own).tolist(), (ends - own).tolist(), cuts.tolist()
        for a, b in zip(cuts, cuts[1:]):
            yield at[a:b], to[a:b]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte bigrams, of neighbours and of bytes two and three apart: (word number, bucket)."""
    data = [w.encode("utf-8", "surrogatepass") for w in words]
    joined = np.frombuffer(b"".join(data), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(data)), [len(x) for x in data])
    owners, buckets = [], []
    for gap in (1, 2, 3):
        if len(joined) <= gap:
            continue
        same = owner[gap:] == owner[:-gap]
        pair = (joined[:-gap] << np.uint32(8) | joined[gap:]) + np.uint32(gap << 16)
        h = pair * np.uint32(2654435761)
        owners.append(owner[:-gap][same])
        buckets.append((h >> np.uint32(32 - 15))[same])
    if not owners:
        return np.empty(0, np.int64), np.empty(0, np.uint32)
    return np.concatenate(owners), np.concatenate(buckets)


@dataclass
class EncodingModel:
    """Log likelihoods, one row for each hash bucket, one column for each of :data:`LABELS`."""

    weights: np.ndarray
    prior: np.ndarray
    margin: float = MARGIN

    def scores(self, words: list[str]) -> np.ndarray:
        owner, bucket = features(words)
        out = np.zeros((len(words), self.weights.shape[1]), np.float64)
        if len(owner):
            order = np.argsort(owner, kind="stable")
            owner, bucket = owner[order], bucket[order]
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            ends = np.append(first[1:], len(owner))
            cuts = [*np.unique(np.searchsorted(first, np.arange(0, len(owner), 1 << 16))).tolist(), len(first)]
            for i, j in zip(cuts, cuts[1:]):
                if i < j:
                    out[owner[first[i:j]]] = np.add.reduceat(self._wide.take(bucket[first[i] : ends[j - 1]], axis=0), first[i:j] - first[i], axis=0)
        return out * TEMPER + self.prior

    @cached_property
    def _wide(self) -> np.ndarray:
        return self.weights.astype(np.float64)


#: What other kinds of noise make of letters in clean words, so that it isn't taken for a chain's work.
_OTHER_NOISE = {
    "a": "аα@", "c": "с", "e": "е", "i": "іι", "j": "ј", "o": "оο", "p": "рρ", "s": "ѕ§", "u": "υ", "v": "ν", "x": "х", "y": "у",
    "t": "†", "f": "†ﬁ", "A": "АΑ", "B": "ВΒ", "C": "С", "E": "ЕΕ", "H": "НΗ", "K": "КΚ", "M": "МΜ", "O": "ОΟ", "P": "РΡ", "T": "ТΤ", "X": "ХΧ",
    "ο": "o", "ν": "v", "α": "a", "ρ": "p", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x",
}
_ANYWHERE = "\u00ad\u200b\u200c\u200d\u2060\ufeff\u00a0\u2009\u2003\u202f\u0301\u0300\u0308"


def _noisy(word: str, rng: random.Random) -> str:
    """A clean word with the traces of another problem: still clean here."""
    kind = rng.random()
    if kind < 0.15:
        return "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in word)
    if kind < 0.3:
        i = rng.randrange(len(word) + 1)
        return word[:i] + rng.choice(_ANYWHERE) + word[i:]
    if kind < 0.4:
        return word + "¬"
    share = rng.choice((0.3, 1.0))
    return "".join(rng.choice(_OTHER_NOISE[c]) if c in _OTHER_NOISE and rng.random() < share else c for c in word)


@lru_cache(maxsize=1 << 10)
def _in_mark(mark: str, n: int) -> list[str]:
    return [w for _, _, w in words_of(mark.format(n))]


def count(texts: Iterable[str], seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Of clean texts, garbled by each chain: features by bucket and label, and words by label. Counts of texts add up."""
    rng = random.Random(seed)
    clean: Counter[str] = Counter()
    mixed: Counter[str] = Counter()
    texts = list(texts)
    for text, (starts, ends) in zip(texts, letter_spans(texts, 2)):
        clean.update([w for _, _, w in words_of(text)])
        for i in rng.sample(range(len(starts)), min(NOISY_WORDS, len(starts))):
            w = text[starts[i] : ends[i]]
            noisy = _noisy(w, rng)
            if noisy != w:
                mixed["a " + noisy + ("\na" if noisy.endswith("¬") else " a")] += 1
        plain = [text[a:b] for a, b in zip(starts[:NOISY_WORDS], ends)]
        for a, b in zip(plain[::2], plain[1::2]):
            for _, _, w in words_of(f"a {a}{rng.choice(_ANYWHERE)}{b} a"):
                mixed[w] += 1
        for mark in ("\n— {} —\n", "a · a", ". · a", "a · ."):
            for w in _in_mark(mark, rng.randrange(200)):
                mixed[w] += 1
    for w, n in list(clean.items()):
        core = w[2:-2]
        for other in (core.upper(), core.capitalize()):
            if other != core:
                mixed[w[:2] + other + w[-2:]] += 1 + n // 10
        if core.isalpha() and len(core) > 2:  # cut by the edge of a snippet, or spaced out by a scan
            cut = rng.randrange(1, len(core))
            mixed["  " + core[cut:] + w[-2:]] += 1
            mixed[w[:2] + core[:cut] + "  "] += 1
            for _, _, x in words_of(" ".join(core)):
                mixed[x] += 1
    counts = np.zeros((BUCKETS, len(LABELS)), np.int64)
    items = [(w, n) for w, n in clean.items() if "�" not in w]

    def add(label: int, pairs: list[tuple[str, int]]) -> None:
        if pairs:
            owner, bucket = features([w for w, _ in pairs])
            n = np.array([n for _, n in pairs], np.int64)
            np.add.at(counts[:, label], bucket, n[owner])

    add(0, items)
    add(0, list(mixed.items()))
    made_of = np.zeros(len(LABELS), np.int64)
    made_of[0] = made_of[1] = sum(n for _, n in items)
    lost = [(w[:2] + re.sub(r"[^\x00-\x7f]", "�", w[2:-2]) + w[-2:], n) for w, n in items]
    add(1, lost)
    for k, chain in enumerate(CHAINS, 2):
        made = []
        for w, n in items:
            g = garble(w[2:-2], chain)
            if g is not None:
                made.append((w[:2] + g + w[-2:], n))
        add(k, made)
        made_of[k] += sum(n for _, n in made)
    return counts, made_of


def of_counts(counts: np.ndarray, made_of: np.ndarray) -> EncodingModel:
    """The model that the sums of :func:`count` give."""
    counts, made_of = counts + SMOOTH, made_of + 1.0
    return EncodingModel(np.log(counts / counts.sum(axis=0)).astype(np.float32), np.log(made_of / made_of[0]) + np.where(np.arange(len(LABELS)) > 0, PRIOR, 0))


def fit(texts: Iterable[str], seed: int = 7) -> EncodingModel:
    """Train on clean texts, garbled by each chain."""
    return of_counts(*count(texts, seed))


def fit_on(docs: DataFrame, text_col: str = "text", rows: int = SAMPLE_ROWS) -> EncodingModel:
    """Train on a bounded sample of clean texts (parameter ``rows``)."""
    return fit(sample_texts(docs, rows, text_col))


class Repairer:
    """Judges the words of texts; remembers a bounded number of words already judged."""

    def __init__(self, model: EncodingModel, memory: int = 200_000):
        self.model, self.memory = model, memory
        #: Chain, restored word, and whether this word alone is enough to call its text garbled.
        self.known: dict[str, tuple[str, str | None, bool] | None] = {}

    def _judge(self, words: list[str]) -> None:
        if len(self.known) > self.memory:
            self.known.clear()
        m = self.model
        scores = m.scores(words)
        tried: list[tuple[int, int, str]] = []
        self.known.update(dict.fromkeys(words))
        self.known.update((w, (LOST, None, True)) for w in words if "�" in w)
        for i in np.flatnonzero(scores[:, 2:].max(axis=1) - scores[:, 0] >= m.margin).tolist():
            w, s = words[i], scores[i]
            if "�" in w:
                continue
            for k in np.argsort(-s[2:])[:6] + 2:
                if s[k] - s[0] < m.margin:
                    break
                back = ungarble(w[2:-2], LABELS[k])
                if back is not None and not any("\x80" <= c < "\xa0" or "\ue000" <= c <= "\uf8ff" for c in back):
                    tried.append((i, k, w[:2] + back + w[-2:]))
        if tried:
            again = m.scores([w for _, _, w in tried])[:, 0]
            for (i, k, back), s in zip(tried, again):
                w = words[i]
                # per byte pair, so that the shorter original isn't preferred for its length alone
                gain = s / len(back.encode()) - scores[i][0] / len(w.encode())
                if gain > 0 and (self.known[w] is None or gain > GAIN and not self.known[w][2]):
                    self.known[w] = (LABELS[k], back[2:-2], gain > GAIN)

    def prepare(self, texts: Iterable[str | None]) -> None:
        new = {w for t in texts if t and not t.isascii() for _, _, w in words_of(t)} - self.known.keys()
        if new:
            self._judge(sorted(new))

    def repair(self, text: str | None) -> tuple[str | None, str | None]:
        """Chain and restored text; (None, text) for a clean one. Lost characters stay as they are."""
        if not text or text.isascii():
            return None, text
        return self._repair(text, words_of(text))

    def repair_all(self, texts: list[str | None], chars: int = 1 << 20) -> list[tuple[str | None, str | None]]:
        """:meth:`repair` of many texts, the words of about ``chars`` characters of them judged at once."""
        out: list[tuple[str | None, str | None]] = [(None, t) for t in texts]
        group: list[tuple[int, list[tuple[int, int, str]]]] = []
        size = 0
        for i, text in [*((i, t) for i, t in enumerate(texts) if t and not t.isascii()), (-1, None)]:
            if group and (text is None or size + len(text) > chars):
                new = {w for _, own in group for _, _, w in own} - self.known.keys()
                if new:
                    self._judge(sorted(new))
                for k, own in group:
                    out[k] = self._repair(texts[k], own)
                group, size = [], 0
            if text is not None:
                group.append((i, words_of(text)))
                size += len(text)
        return out

    def _repair(self, text: str, words: list[tuple[int, int, str]]) -> tuple[str | None, str | None]:
        votes: Counter[str] = Counter()
        marked = []
        for s, e, w in words:
            if w not in self.known:
                self._judge([w])
            verdict = self.known[w]
            if verdict:
                votes[verdict[0]] += 100 if verdict[2] else 1
                marked.append((s, e, verdict))
        if not marked:
            return None, text
        chain = max(votes, key=lambda c: (votes[c], c), default=None)
        if chain is None or votes[chain] < 100:
            return None, text
        parts, at = [], 0
        for s, e, (c, word, sure) in marked:
            if word is not None and (sure or c == chain):
                parts += [text[at:s], word]
                at = e
        return chain, "".join(parts) + text[at:]


_BEYOND_ASCII = r"[^\x00-\x7f]"


def repair_fields(rows: DataFrame, model: EncodingModel, id_col: str = "match_id", fields: tuple[str, ...] = ("context", "document_text")) -> DataFrame:
    """``(id_col, field, chain, restored)``: each value with a stretch that was decoded with a wrong encoding.

    ``chain`` is the chain most of its garbled words have, 'lost' if replaced characters are all that is
    left of them; ``restored`` has the words undone that can be. Null and empty values are never returned;
    repeated rows are judged each for itself; other columns are not read. No shuffle. The model (fixed size,
    about 4 MB) goes to the tasks with the code.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    sc = rows.sparkSession.sparkContext
    shared = sc.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Repairer(shared.value)
        for batch in batches:
            ids, names, chains, texts = [], [], [], []
            for j, field in enumerate(fields, 1):
                values = batch.column(j).to_pylist()
                judge.prepare(values)
                for i, v in enumerate(values):
                    if v and not v.isascii():
                        chain, restored = judge.repair(v)
                        if chain:
                            ids.append(i)
                            names.append(field)
                            chains.append(chain)
                            texts.append(restored)
            yield pa.record_batch([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(names, pa.string()), pa.array(chains, pa.string()), pa.array(texts, pa.string())], names=[id_col, "field", "chain", "restored"])

    # values of ASCII only can't be garbled; they needn't go to Python
    cols = [F.when(F.col(f).rlike(_BEYOND_ASCII), F.col(f)).alias(f) for f in fields]
    return rows.select(id_col, *cols).mapInArrow(run, f"`{id_col}` {kind}, field string, chain string, restored string")
