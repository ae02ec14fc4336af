"""The features of windows of sentences, from what is known of each sentence.

A sentence is tokenised once, though two or three windows cover it.  Most
features are sums over a window's sentences; only how often words repeat is
found for each window.  That holds if the window's text, joined by blanks,
splits into these very sentences again.  Where one does not end like a
sentence, or begins with a mark, the window's text is measured as it stands.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from math import sqrt

import regex

from prosegrid.functions import constants as C

SIZE, STRIDE = 7, 3
_EDGE = "(?<![A-Za-z0-9_])(?:{})(?![A-Za-z0-9_])"
WORD = regex.compile(C.WORD)
PLAIN_WORD = re.compile(r"[A-Za-z]+(?:'[A-Za-z]+)?|[0-9]+(?:[.,][0-9]+)*")
SENTENCE = re.compile(C.SENTENCE.replace(r"\z", r"\Z"))
SPACE = "\t\n\x0b\x0c\r "  # what \s is in the other forms of this model
CLOSED = re.compile(r"""[.!?]["'”’\])}]*\Z""")
STOCK = re.compile("|".join(C.STOCK), re.I | re.A)
STOCKS = [re.compile(p, re.I | re.A) for p in C.STOCK]
PASSIVE = re.compile(_EDGE.format(C.PASSIVE.replace(r"\s", r"[ \t\n\x0b\x0c\r]").replace(r"\w", "[A-Za-z0-9_]")), re.I | re.A)
OPENING = re.compile(rf"(?:{C.OPENINGS})(?![A-Za-z0-9_])", re.I | re.A)
DASH = re.compile(r"[()—–]|[ \t\n\x0b\x0c\r]-[ \t\n\x0b\x0c\r]")
SUFFIX = re.compile(C.SUFFIX.replace("$", r"\Z"))
CITATION = re.compile(
    C.CITATION.replace(r"\b", r"(?<![A-Za-z0-9_])").replace(r"\s", r"[ \t\n\x0b\x0c\r]").replace(r"\d", "[0-9]"), re.I | re.A
)
UPPER, NUMBER, LETTER = regex.compile(r"\p{Lu}"), regex.compile(r"\p{N}"), regex.compile(r"\p{L}")
STOP, FIRST, HEDGES = frozenset(C.STOPWORDS), frozenset(C.FIRST_PERSON), frozenset(C.HEDGES)
NONE = [0.0] * len(C.FEATURES)


def words_of(text: str) -> list[str]:
    return PLAIN_WORD.findall(text) if text.isascii() else WORD.findall(text)


#: Bits of one sum; all sums of a sentence are fields of one integer, added at once.
_FIELD = 40
_MASK = (1 << _FIELD) - 1


@lru_cache(1 << 16)
def _kind(word: str) -> tuple[str, int, bool]:
    """Of a word: lower case, a one in the field of each list or form it is of (bare length in the lowest), whether it has content."""
    low = word.lower()
    marks = word.count("'") + word.count("’")
    upper = word[0].isupper() if word.isascii() else bool(UPPER.match(word))
    number = word[0].isdigit() if word.isascii() else bool(NUMBER.match(word))
    counts = (
        len(word) - marks,
        low in STOP,
        low in FIRST,
        marks > 0,
        number,
        len(low) > 5 and SUFFIX.search(low) is not None,
        low in HEDGES,
        upper,
    )
    return low, sum(int(n) << _FIELD * i for i, n in enumerate(counts)), len(low) > 2 and low not in STOP


def _fields(packed: int) -> tuple[int, ...]:
    return tuple(packed >> _FIELD * i & _MASK for i in range(8))


class Sentence:
    """What the windows need of one sentence."""

    __slots__ = ("text", "low", "sums", "number", "content", "opener", "dashes", "dashes_after_blank", "single", "regular")

    def __init__(self, text: str):
        self.text = text
        kinds = [_kind(w) for w in words_of(text)]
        self.low = [k[0] for k in kinds]
        self.number = len(kinds)
        self.content = frozenset([k[0] for k in kinds if k[2]])
        packed = sum([k[1] for k in kinds])
        if kinds:
            packed -= kinds[0][1] >> 7 * _FIELD << 7 * _FIELD  # a capital at the beginning says nothing
        self.opener = " ".join(self.low[:2])
        self.dashes = len(DASH.findall(text))
        self.dashes_after_blank = len(DASH.findall(" " + text)) if text[:1] == "-" else self.dashes
        self.single = text[:1] not in ".!?" and _single(text)
        self.regular = self.single and CLOSED.search(text) is not None
        stock = sum(len(p.findall(text)) for p in STOCKS) if STOCK.search(text) else 0
        self.sums = (
            *_fields(packed),
            text.count(","),
            text.count(";") + text.count(":"),
            1 if OPENING.match(text) else 0,
            stock,
            len(PASSIVE.findall(text)),
        )


def overlap(a: frozenset, b: frozenset) -> float:
    both = len(a & b)
    every = len(a) + len(b) - both
    return both / every if every else 0.0


def _measure(found: list[Sentence], near: list[float]) -> list[float]:
    """The features, in the model's order; ``near`` are the overlaps of neighbours."""
    n = len(found)
    lengths = [s.number for s in found]
    m = sum(lengths)
    if not n:
        return list(NONE)
    bare, stop, first, marks, numbers, nominal, hedges, proper, commas, colons, openings, stock, passive = map(
        sum, zip(*(s.sums for s in found))
    )
    dashes = found[0].dashes + sum(s.dashes_after_blank for s in found[1:])
    mean = float(m) / n
    total = 0.0
    for x in lengths:
        total += (x - mean) * (x - mean)
    counts = Counter()
    for s in found:
        counts.update(s.low)
    kinds = len(counts)
    once = sum(1 for v in counts.values() if v == 1)
    openers = [s.opener for s in found if s.opener]
    shared = 0.0
    for x in near:
        shared += x
    share = (lambda x: float(x) / m) if m else (lambda x: 0.0)
    return [
        mean,
        sqrt(total / n) / mean if mean else 0.0,
        sum(x <= 8 for x in lengths) / n,
        sum(x >= 28 for x in lengths) / n,
        share(bare),
        1 - float(kinds) / m if m else 0.0,
        float(once) / kinds if kinds else 0.0,
        share(stop),
        share(first),
        share(marks),
        share(numbers),
        commas / n,
        colons / n,
        dashes / n,
        openings / n,
        stock / n,
        share(nominal),
        shared / (n - 1) if n > 1 else 0.0,
        1 - float(len(set(openers))) / len(openers) if openers else 0.0,
        share(proper),
        passive / n,
        share(hedges),
    ]


def split(text: str) -> list[str]:
    return [s for s in (p.strip(SPACE) for p in SENTENCE.findall(text)) if s]


def of_text(text: str) -> list[float]:
    """The features of a text as it stands, split into sentences by its marks."""
    found = [Sentence(s) for s in split(text)]
    if not found:
        return list(NONE)
    out = _measure(found, [overlap(a.content, b.content) for a, b in zip(found, found[1:])])
    n = len(found)
    # What is counted in the text, not in its sentences.
    stock = sum(len(p.findall(text)) for p in STOCKS) if STOCK.search(text) else 0
    whole = words_of(text)
    if len(whole) != sum(s.number for s in found):  # marks between sentences that stand alone hold no words
        return _of_words(text, found, whole, out)
    out[11], out[12] = text.count(",") / n, (text.count(";") + text.count(":")) / n
    out[13], out[15], out[20] = len(DASH.findall(text)) / n, stock / n, len(PASSIVE.findall(text)) / n
    return out


def _of_words(text: str, found: list[Sentence], whole: list[str], out: list[float]) -> list[float]:
    """The same where the words of the text are not those of its sentences: a mark inside a number divides them."""
    n, m = len(found), len(whole)
    kinds = [_kind(w) for w in whole]
    sums, counts = _fields(sum(k[1] for k in kinds)), Counter(k[0] for k in kinds)
    stock = sum(len(p.findall(text)) for p in STOCKS)
    if m:
        out[5] = 1 - len(counts) / m
        out[6] = sum(v == 1 for v in counts.values()) / len(counts)
        for at, k in ((4, 0), (7, 1), (8, 2), (9, 3), (10, 4), (16, 5), (21, 6)):
            out[at] = sums[k] / m
        out[19] = sum(s.sums[7] for s in found) / m
    out[11], out[12] = text.count(",") / n, (text.count(";") + text.count(":")) / n
    out[13], out[15], out[20] = len(DASH.findall(text)) / n, stock / n, len(PASSIVE.findall(text)) / n
    return out


def ranges(n: int) -> list[tuple[int, int]]:
    """Windows of ``SIZE`` sentences every ``STRIDE``, the last one at the end; one for all if there are few."""
    if n <= SIZE:
        return [(0, n)] if n else []
    starts = list(range(0, n - SIZE + 1, STRIDE))
    if starts[-1] != n - SIZE:
        starts.append(n - SIZE)
    return [(a, a + SIZE) for a in starts]


def of_sentences(texts: list[str]) -> list[tuple[int, int, list[float]]]:
    """``(start, end, features)`` for every window over the sentences of a document."""
    found = [Sentence(t) for t in texts]
    near = [overlap(a.content, b.content) for a, b in zip(found, found[1:])]
    out = []
    for a, b in ranges(len(found)):
        mine = found[a:b]
        if all(s.regular for s in mine[:-1]) and mine[-1].single:
            out.append((a, b, _measure(mine, near[a : b - 1])))
        else:
            out.append((a, b, of_text(" ".join(s.text for s in mine))))
    return out


def _single(text: str) -> bool:
    """Whether a sentence holds no other sentence's end, and no word over it."""
    end = len(text)
    while end and text[end - 1] in "\"'”’])}":
        end -= 1
    while end and text[end - 1] in ".!?":
        end -= 1
    body = text[:end]
    return "." not in body and "!" not in body and "?" not in body


def characteristics(text: str) -> tuple[float, float]:
    """The share of long words, and of sentences with a citation."""
    words = [w for w in words_of(text) if (w[0].isalpha() if w.isascii() else LETTER.match(w))]
    long = sum(len(w) - w.count("'") - w.count("’") >= C.LONG_WORD for w in words)
    found = split(text)
    cited = sum(CITATION.search(s) is not None for s in found)
    return (long / len(words) if words else 0.0), (cited / len(found) if found else 0.0)
