"""Sentence boundaries across languages and scripts, learnt without labels.

One pass over the texts writes every place where a sentence may end as a small row and counts, per
language, how sentences begin and go on. From all counts log-likelihood ratios give

- abbreviations: words that keep company with the period;
- collocations: followers that stand behind one ending more often than behind others;
- sentence starters: followers that begin sentences more often than they go on with them.

Each place is classified by the sum of the three. How often an ending ends a sentence where no
statistic is beyond doubt (an ellipsis, a closing quotation, a line break) is fitted from what
follows it. The rows of the pass are then joined with these verdicts; no text is read twice.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.session import broadcast_if_small, materialise, spread

#: Log-likelihood ratio from which a follower counts as starter or collocation, and weight of a collocation against how sentences go on in general.
SURE, OWN = 7.88, 0.3
#: Share of a word's periods that end a sentence where nothing speaks against it.
CERTAIN = 0.9998
#: Buckets of hashed following words, letters from which a word without inner period also tells how sentences begin, fewest occurrences for a share of its own, and rounds of fitting.
BUCKETS, LONG, LEAST, ROUNDS = 4096, 8, 3, 12
_TERM = re.compile(r"[.!?…。！？｡।॥؟۔]+|;(?=\s|$)|(?:\s*[\U0001F000-\U0001FAFF☀-➿][️‍\U0001F3FB-\U0001F3FF]*)+")
_CLOSERS = re.compile(r"(?:[  \u202f]?»|[\"'”’“›」』）)\]】》])*")
_BLANK = re.compile(r"\n[^\S\n]*(?:\n\s*)+")
_LIST = re.compile(r"[^\S\n]*(?:[-*•‣◦–] |\d{1,3}[.)] |[a-z]\) )")
_HEADING = re.compile(r"[^\S\n]*#{1,6}\s")
_BREAK = re.compile(r"(?<=[^\s.!?。！？।؟…])[^\S\n]*\n(?=[^\s])")
_TERM_PLAIN = re.compile(r"[.!?]+")
_SPACE = re.compile(r"(?<=[^\s.!?…,;:(\[—–-])[^\S\n]+(?=\S)")
_RUN = re.compile(r"\S+")
_QUOTED = re.compile(r"[\"“„«「『（(\[‘《]")
_AFTER = re.compile(r"(?:\s*(?:[\U0001F000-\U0001FAFF☀-➿][️‍\U0001F3FB-\U0001F3FF]*|:-?[)(DPp]|;-?\)|\^\^|\b(?:lol|lmao|haha+|hehe+|xd|jaja+|mdr|www+|kkk+)\b[.!]*))+", re.I)
#: First letters of the laughs in _AFTER, and what a run of closers may begin with.
_LAUGHS, _CLOSING = frozenset("lLhHxXjJmMwWkKſK"), frozenset("  \u202f»\"'”’“›」』）)]】》")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_TOKENS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+")
_DIGITS = re.compile(r"\d+")
_STOPPED = re.compile(r"[^.…]*[.…]")
_BEFORE = re.compile(r"[^\s\"“”„«»()\[\]（）「」『』,;:!?]+$")
_OPENERS = " \t\n\r ​\"'“„«‹「『（([¿¡*_"
_PAIRS = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "‘": "’", "《": "》"}
_NO_SPACES = re.compile(r"[぀-ヿ㐀-鿿฀-๿]")
#: Where a token stands behind a letter or digit in text of such a script; not within a word or number of another one.
_GOES_ON = re.compile(r"(?<=[^\W_])(?!(?<=[^\W\d_぀-ヿ㐀-鿿฀-๿])[^\W\d_぀-ヿ㐀-鿿฀-๿])(?!(?<=\d)\d)(?=[%s]*([぀-ヿ㐀-鿿฀-๿](?s:.)?|\d|[^\W\d_]+(?:['’-][^\W\d_]+)*|(?s:.)))" % re.escape(_OPENERS))
_INNER = re.compile(r"(?:https?://|www\.)\S+|[\w.+-]+@[\w.-]+\w|(?<![\w.])\.\w+|\b[\w-]+(?:\.[a-z]{2,5})(?:/\S*)?(?=[\s,;:!?)]|\.(?:\s|$))|\d+(?:[.,:]\d+)+")
# Very common words that tell the languages written in Latin script apart.
_COMMON = {"en": "the and of to is in that for with was it", "de": "der die das und ist nicht ein für mit von auf zu", "fr": "le la les des et est une pour que dans sur", "es": "el los las y es una para que en por del con"}
_COMMON_SETS = {k: frozenset(v.split()) for k, v in _COMMON.items()}
_COMMON_ANY = frozenset().union(*_COMMON_SETS.values())
_OTHER = re.compile(r"[Ͱ-῿぀-퟿]")
_SCRIPTS = [("th", re.compile(r"[฀-๿]")), ("ja", re.compile(r"[぀-ヿ]")), ("zh", re.compile(r"[一-鿿]")), ("ar", re.compile(r"[؀-ۿ]")), ("hi", re.compile(r"[ऀ-ॿ]")), ("el", re.compile(r"[Ͱ-Ͽἀ-῿]")), ("ru", re.compile(r"[Ѐ-ӿ]")), ("ko", re.compile(r"[가-힯]")), ("he", re.compile(r"[֐-׿]"))]


def language(text: str, tag: str | None) -> str:
    """Where the script settles the language, that; else the written tag if it is a Latin one; else by common words."""
    if not text.isascii() and _OTHER.search(text):
        letters = sum(map(str.isalpha, text)) or 1
        for code, script in _SCRIPTS:
            if len(script.findall(text)) > 0.2 * letters:
                return code
    words = Counter(filter(_COMMON_ANY.__contains__, text.casefold().split()))
    best = max(_COMMON_SETS, key=lambda k: sum(words[w] for w in _COMMON_SETS[k]))
    told = (tag or "").strip().casefold().replace("_", "-").split("-")[0]
    if sum(words[w] for w in _COMMON_SETS[best]) >= 2:
        return best
    return told if len(told) == 2 and told not in {c for c, _ in _SCRIPTS} else best


@lru_cache(200_000)
def _bucket(token: str) -> int:
    return zlib.crc32(token.encode()) % BUCKETS


@lru_cache(200_000)
def _hashed(token: str) -> tuple[int, int]:
    """Bucket of a following token and bucket of its shape."""
    return _bucket(token), BUCKETS + _bucket(_shape(token)) % 64


def following(text: str, at: int, end: int) -> str:
    """The token a sentence would begin with at `at`: a word, # for digits, two letters in scripts without spaces, or a mark."""
    while at < end and text[at] in _OPENERS:
        at += 1
    if at >= end:
        return ""
    c = text[at]
    if c.isdigit():
        return "#"
    if _NO_SPACES.match(c):
        return text[at : at + 2]
    m = _WORD.match(text, at)
    return m.group() if m else c


def _shape(token: str) -> str:
    return "digit" if token == "#" else "lower" if token[:1].islower() else "upper" if token[:1].isupper() else "other" if token[:1].isalpha() else "mark"


def _spans(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Quotations and brackets that close again within the block, however far; a straight quote opens or closes by what stands at its sides, and where these don't tell, by turns."""
    out, i, straight = [], start, -1
    opened: list[tuple[str, int]] = []
    while i < end:
        c = text[i]
        if c == '"':
            left, right = text[i - 1 : i] if i > start else "", text[i + 1 : i + 2] if i + 1 < end else ""
            no_left, no_right = not left or left.isspace() or left in "([{", not right or right.isspace() or right in ".,;:!?…)]}"
            if straight < 0 or no_left and not no_right:
                straight = -1 if no_right and not no_left else i
            else:
                out.append((straight, i))
                straight = -1
        elif opened and c in opened[-1][0]:
            out.append((opened.pop()[1], i))
        elif c in _PAIRS and not (c == "‘" and i > start and text[i - 1].isalnum()):
            opened.append((_PAIRS[c], i))
        i += 1
    return out


def blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, running): pieces in which sentences lie; headings and list items aren't running text."""
    at = 0
    for gap in [*_BLANK.finditer(text), None]:
        stop = gap.start() if gap else len(text)
        lines = []
        for line in re.finditer(r"[^\n]+", text[at:stop]):
            if line.group().strip():
                lines.append((at + line.start(), at + line.end()))
        run: tuple[int, int] | None = None
        item = False
        for s, e in lines:
            listed, heading = bool(_LIST.match(text, s, e)), bool(_HEADING.match(text, s, e))
            if listed or heading:
                if run:
                    yield run[0], run[1], not item
                run, item = (s, e), True
                if heading:
                    yield s, e, False
                    run = None
            elif run and item:
                # A line below an item goes on with it when it is indented or begins small.
                first = text[s:e].lstrip()[:1]
                if text[s] in " \t" or first.islower():
                    run = (run[0], e)
                else:
                    yield run[0], run[1], False
                    run, item = (s, e), False
            else:
                run, item = (run[0] if run else s, e), False
        if run:
            yield run[0], run[1], not item
        at = gap.end() if gap else stop


def endings(text: str, start: int, end: int, lang: str) -> Iterator[tuple[int, str, str, bool]]:
    """Places in a running block where a sentence may end: (end, ending, following token, sure).

    `ending` names what stands there: a word with its period, … (an ellipsis), Q for a closing
    quotation or bracket, S for a space of a script that parts sentences by spaces, L for a line
    break, G for a period without space behind it.
    """
    term = _TERM_PLAIN if text.isascii() else _TERM
    marks = [(m.start(), m.end(), m.group()) for m in term.finditer(text, start, end)]
    broken = text.find("\n", start, end) >= 0
    if broken:
        marks += [(m.start(), m.start(), "\n") for m in _BREAK.finditer(text, start, end)]
    if lang == "th":
        marks += [(start + m.start(), start + m.start(), " ") for m in _SPACE.finditer(text[start:end])]
    if not marks:
        return
    quoted = _spans(text, start, end) if _QUOTED.search(text, start, end) else []
    # An address or a number matters only where a mark has no white space behind it.
    inner = [m.span() for m in _INNER.finditer(text, start, end)] if any(e < end and not text[e].isspace() for _, e, _ in marks) else []
    widest = max(map(len, text[start:end].split("\n"))) if broken else 0
    begins, ends_at = [a for a, _ in inner], {q[1] for q in quoted}
    quoted.sort(reverse=True)
    active: list[tuple[int, int]] = []
    marks.sort()
    for s, e, mark in marks:
        if mark == ";" and lang != "el":
            continue
        if inner:
            k = bisect_right(begins, s) - 1
            if k >= 0 and s < inner[k][1] and not (mark[0] == "." and inner[k][1] == e):
                continue
        if quoted or active:
            while quoted and quoted[-1][0] < s:
                active.append(quoted.pop())
            active = [q for q in active if q[1] >= s]
        wordless = mark == "\n" or mark == " "
        stop = e if wordless or e >= end or text[e] not in _CLOSING else _CLOSERS.match(text, e, end).end()
        around = active
        if around and not all(e <= q[1] < stop for q in around):
            continue
        # Closers that close nothing opened before belong to what follows.
        if stop > e and not around:
            real = e
            while real < stop and text[real] in ")”’»」』）]】》" or real < stop and real in ends_at:
                real += 1
            stop = real
        at = stop
        while at < end and text[at].isspace():
            at += 1
        if not wordless and at < end and (not text[at].isalnum() or text[at] in _LAUGHS):
            extra = _AFTER.match(text, stop, end)
            if extra and extra.end() > stop:
                at = stop = extra.end()
                while at < end and text[at].isspace():
                    at += 1
        if at >= end:
            continue
        ahead, first = text[stop], text[at]
        spaced = at > stop or bool(_NO_SPACES.match(ahead)) or mark[0] in "。！？｡"
        if not wordless and first in ",;:—–-)]，、；：":
            continue
        nxt = following(text, at, end)
        if around:
            yield stop, "Q", nxt, False
        elif mark == "\n":
            line = text.rfind("\n", start, s) + 1
            # What would have had to follow on the line: in Thai, which breaks between words it doesn't part, all up to the next space.
            ahead = nxt if nxt[:1].isupper() or lang in ("ja", "zh") else _RUN.match(text, at).group()
            fits = s - max(line, start) + 1 + len(ahead) + 2 < widest
            if nxt[:1].isalpha() and not nxt[:1].islower() and fits:
                yield s, "L", nxt, False
        elif mark == " ":
            yield s, "S", nxt, False
        elif mark.strip()[:1] not in ".…":
            if mark[0] in "!?" and not spaced and ahead not in "«„“¿¡" and not ahead.isupper():
                continue
            yield stop, "!", nxt, True
        elif "…" in mark or mark.startswith(".."):
            yield stop, "…", nxt, False
        else:
            before, width = _BEFORE.search(text, max(start, s - 30), s), 30
            while before and before.start() == s - width > start:  # a word longer than what was looked at
                width *= 2
                before = _BEFORE.search(text, max(start, s - width), s)
            word = (before.group() if before else "").casefold()
            word = _DIGITS.sub("#", word)
            if not spaced:
                if ahead in "«„“¿¡(\"「" or ahead.isupper() and len(word) > 1 and "." not in word and stop + 1 < len(text) and (text[stop + 1].islower() or text[stop + 1].isspace()):
                    yield stop, "G", nxt, False
                continue
            yield stop, word, nxt, False


#: Endings that are no words: closing quotations, ellipses and other marks.
_MARKS = ("Q", "S", "L", "G", "…")


def log_likelihood(k: int, n: int, others: int, rest: int) -> float:
    """Dunning's ratio: how sure it is that k of n isn't the share of `others` among `rest`."""

    def ll(a: float, b: float, p: float) -> float:
        return (a * math.log(p) if a else 0.0) + ((b - a) * math.log(1 - p) if b > a else 0.0)

    if not n or not rest:
        return 0.0
    p, p1, p2 = (k + others) / (n + rest), k / n, others / rest
    return 0.0 if p in (0.0, 1.0) else 2 * (ll(k, n, p1) + ll(others, rest, p2) - ll(k, n, p) - ll(others, rest, p))


class Model:
    """Statistics of each language: how sentences begin and go on, periods and tokens.

    `rows` are (lang, what, bucket, shape, n) of beginnings (s) and goings-on (m); their number is
    bounded by the buckets. Each ending is judged from its own counts alone.
    """

    def __init__(self, rows: list[tuple], periods: dict[str, int], tokens: dict[str, int]):
        self.begin: dict[str, Counter] = {}
        self.on: dict[str, Counter] = {}
        for lang, what, bucket, shape, n in rows:
            t = (self.begin if what == "s" else self.on).setdefault(lang, Counter())
            t[bucket] += n
            t[shape] += n
        self.totals = {(k, lang): sum(t.values()) / 2 for k, d in (("begin", self.begin), ("on", self.on)) for lang, t in d.items()}
        self.periods, self.tokens = periods, tokens
        self._lean: dict[tuple, tuple[float, float]] = {}

    def judge(self, lang: str, key: str, seen: dict[tuple[int, int], int], without: int) -> tuple[bool, list[tuple[int, int]]]:
        """From what followed an ending and how often its word stood without period: whether it ends sentences as a rule, and the followers with which it does otherwise."""
        n = sum(seen.values())
        prior = 0.5 if key in ("Q", "…", "L") else 0.9
        if key not in _MARKS:
            periods = self.periods.get(lang, 0)
            prior = 0.95 - 0.8 * self.abbreviation(n, without, periods, self.tokens.get(lang, 0) + periods, key)
        fitted = self._fit(lang, seen, n, prior) if n >= LEAST else prior
        # A word that is no abbreviation and mostly ends sentences always does; what follows in small letters is then a careless start.
        share = CERTAIN if prior == 0.95 and fitted > 0.6 else fitted
        if n < LEAST and prior < 0.9 and len(key) == 1 and key.isalpha():
            share = min(share, 0.25)
        verdict = {b: self._ends(lang, share, b, self._own(lang, b, k, n)) for b, k in seen.items()}
        usual = 2 * sum(verdict.values()) >= len(verdict)
        return usual, [b for b, v in verdict.items() if v != usual]

    @staticmethod
    def abbreviation(with_period: int, without: int, periods: int, tokens: int, word: str) -> float:
        """1 if the log-likelihood that the word keeps company with the period, scaled down for length and for bare occurrences, says so; else 0."""
        n = with_period + without
        if not n or not tokens:
            return 0.0
        p0, p1 = max(1e-6, min(1 - 1e-6, periods / tokens)), 0.99
        ratio = with_period * math.log(p1 / p0) + without * math.log((1 - p1) / (1 - p0))
        letters = len(word.replace(".", ""))
        score = ratio * math.exp(-letters) * (word.count(".") + 1) * letters ** -min(without, 300) if letters else 0.0
        return 1.0 if score >= 0.3 else 0.0

    def _chance(self, table: str, lang: str, bucket: int, shape: int) -> float:
        """How likely a sentence begins (or goes on) with the token: its own count, smoothed by that of its shape."""
        t = getattr(self, table).get(lang)
        if not t:
            return 1e-4
        total = self.totals[table, lang]
        return (t.get(bucket, 0) + 0.2 * (t.get(shape, 0) + 1) / (total + 4)) / (total + 1)

    def chances(self, lang: str, b: tuple[int, int]) -> tuple[float, float]:
        """How likely the token begins a sentence and how likely it goes on with one.

        A token whose two counts differ by the log-likelihood ratio is a starter (or the opposite)
        in its own right; any other is judged by what its shape says beside its own counts.
        """
        got = self._lean.get((lang, b))
        if got is None:
            got = self._lean[lang, b] = self._chance("begin", lang, *b), self._chance("on", lang, *b)
        return got

    def starter(self, lang: str, b: tuple[int, int]) -> float:
        """Signed log-likelihood ratio of beginning sentences against going on with them."""
        s, m = self.begin.get(lang, {}).get(b[0], 0), self.on.get(lang, {}).get(b[0], 0)
        n, rest = self.totals.get(("begin", lang), 0), self.totals.get(("on", lang), 0)
        ratio = log_likelihood(s, n, m, rest)
        return ratio if n and rest and s / n >= m / rest else -ratio

    def _own(self, lang: str, b: tuple[int, int], k: int, n: int) -> float:
        """Share of an ending's followers where they are a collocation with it: seen behind it surely more often than tokens go on with it elsewhere; once or twice is no habit."""
        if k < LEAST:
            return 0.0
        m, rest = self.on.get(lang, {}).get(b[0], 0), self.totals.get(("on", lang), 0)
        collocated = rest and k / n > m / rest and log_likelihood(k, n, m, rest) >= SURE
        return k / (n + LEAST) if collocated else 0.0

    def _fit(self, lang: str, seen: dict[tuple[int, int], int], n: int, prior: float) -> float:
        share = prior
        odds = [(k, p, OWN * self._own(lang, b, k, n) + (1 - OWN) * q) for b, k in seen.items() for p, q in (self.chances(lang, b),)]
        for _ in range(ROUNDS):
            ended = sum(k * share * p / (share * p + (1 - share) * q) for k, p, q in odds)
            share = min(0.9999, max(0.0001, (ended + 2 * prior) / (n + 2)))
        return share

    def _ends(self, lang: str, share: float, b: tuple[int, int], own: float) -> bool:
        """The sum of the three: odds of the ending, log-likelihood of the starter, less that of the collocation."""
        p, q = self.chances(lang, b)
        return math.log(share / (1 - share)) + math.log(p) - math.log(OWN * own + (1 - OWN) * q) >= 0


_SCHEMA = pa.schema([("what", pa.string()), ("lang", pa.string()), ("key", pa.string()), ("bucket", pa.int32()), ("shape", pa.int32()), ("n", pa.int64()), ("doc_id", pa.int64()), ("end_pos", pa.int32()), ("next_pos", pa.int32())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over the texts.

    what = d: a place where a sentence ends (key null or !) or may end, with its ending, the hashed
    follower, and where the next sentence would begin. s and m: counts of how sentences begin and
    go on; w: words without period.
    """
    begun: Counter = Counter()
    # Words are added up as they are, and told apart once when the counts go out.
    going: defaultdict[str, Counter] = defaultdict(Counter)
    plain: defaultdict[str, Counter] = defaultdict(Counter)
    glued: defaultdict[str, Counter] = defaultdict(Counter)

    def told() -> pa.RecordBatch:
        counts: Counter = Counter()
        for (lang, token), n in begun.items():
            counts["s", lang, None, *_hashed(token)] += n
        for lang, raw, n in ((lang, raw, n) for lang, t in going.items() for raw, n in t.items()):
            m = _TOKENS.match(raw)
            if m:
                counts["m", lang, None, *_hashed("#" if raw[0].isdigit() else m.group())] += n
        for lang, token, n in ((lang, token, n) for lang, t in glued.items() for token, n in t.items()):
            counts["m", lang, None, *_hashed("#" if token[0].isdigit() else token)] += n
        for lang, raw, n in ((lang, raw, n) for lang, t in plain.items() for raw, n in t.items()):
            last = None
            for last in _TOKENS.finditer(raw):
                pass
            if last and not _STOPPED.match(raw, last.end()):
                counts["w", lang, _DIGITS.sub("#", last.group().casefold()), None, None] += n
        for c in (begun, going, plain, glued):
            c.clear()
        cols = [*zip(*((*k, n) for k, n in counts.items()))] or [[]] * 6
        nulls = [None] * len(counts)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*cols, nulls, nulls, nulls], _SCHEMA)], schema=_SCHEMA)

    for batch in batches:
        langs, keys, buckets, shapes, ids, ends, nexts = [], [], [], [], [], [], []
        for doc_id, text, tag in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            lang, size = language(text, tag), len(text)

            def place(start: int, at: int, key: str | None, bucket: int | None, shape: int | None) -> None:
                e = at
                while e > start and text[e - 1].isspace():
                    e -= 1
                if e > start:
                    while at < size and text[at].isspace():
                        at += 1
                    langs.append(lang)
                    keys.append(key)
                    buckets.append(bucket)
                    shapes.append(shape)
                    ids.append(doc_id)
                    ends.append(e)
                    nexts.append(at)

            for start, end, running in blocks(text):
                if running:
                    any_end = False
                    for at, ending, nxt, sure in endings(text, start, end, lang):
                        any_end = True
                        place(start, at, "!" if sure else ending, *_hashed(nxt))
                    if any_end or text[end - 1] in ".!?。！？।؟…":
                        begun[lang, following(text, start, end)] += 1
                    piece = text[start:end]
                    if lang != "ko" and _NO_SPACES.search(piece):
                        glued[lang].update(_GOES_ON.findall(piece))
                    else:
                        words = piece.split()
                        plain[lang].update(words)
                        going[lang].update(right for left, right in zip(words, words[1:]) if left[-1].isalnum())
                place(start, end, None, None, None)
        n = len(ids)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((["d"] * n, langs, keys, buckets, shapes, [1] * n, ids, ends, nexts), _SCHEMA)], schema=_SCHEMA)
        if len(begun) + sum(len(t) for c in (going, plain, glued) for t in c.values()) > 400_000:
            yield told()
    yield told()


def judged(scanned: DataFrame) -> DataFrame:
    """(lang, key, usual, except): what each ending does as a rule, and the followers (bucket and shape in one number) with which it does otherwise; endings that always end sentences have no row.

    Counts are added up map-side over all documents. To the driver come those of beginnings and
    goings-on, whose number the hash buckets bound; endings are judged by the workers.
    """
    seen = scanned.where("what = 'd' and key <> '!'").groupBy("lang", "key", "bucket", "shape").agg(F.sum("n").alias("n"))
    seen = materialise(seen, "endings")
    # What follows a long word begins a sentence nearly always.
    long = (F.length("key") >= LONG) & ~F.col("key").contains(".")
    begun = scanned.where("what in ('s', 'm') or key = '!'").select("lang", F.when(F.col("what") == "m", "m").otherwise("s").alias("what"), "bucket", "shape", "n").union(seen.where(long).select("lang", F.lit("s"), "bucket", "shape", "n"))
    rows = [tuple(r) for r in begun.groupBy("lang", "what", "bucket", "shape").agg(F.sum("n").alias("n")).collect()]
    words = scanned.where("what = 'w'").groupBy("lang", "key").agg(F.sum("n").alias("without"))
    total = lambda df, n: {r.lang: r.n for r in df.groupBy("lang").agg(F.sum(n).alias("n")).collect()}
    model = Model(rows, total(seen.where(~F.col("key").isin(*_MARKS) & ~long), "n"), total(words.where((F.length("key") < LONG) | F.col("key").contains(".")), "without"))
    listed = seen.groupBy("lang", "key").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("shape").alias("shapes"), F.collect_list("n").alias("counts"))

    def verdicts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for lang, key, buckets, shapes, counts, without in zip(*(b[c] for c in ("lang", "key", "buckets", "shapes", "counts", "without"))):
                usual, other = model.judge(lang, key, {(int(x), int(y)): int(n) for x, y, n in zip(buckets, shapes, counts)}, int(without))
                if other or not usual:
                    out.append((lang, key, usual, [x * 2 * BUCKETS + y for x, y in other]))
            yield pd.DataFrame(out, columns=["lang", "key", "usual", "other"])

    return listed.join(words, ["lang", "key"], "left").withColumn("without", F.coalesce("without", F.lit(0))).mapInPandas(verdicts, "lang string, key string, usual boolean, other array<int>")


def sentence_places(documents: DataFrame) -> DataFrame:
    """documents (doc_id, text, lang) -> (doc_id, end_pos, next_pos): where each sentence ends and the next one begins, in code points.

    Null, empty and blank texts give no rows; a null or wrong lang is replaced by what the text
    shows; rows repeated whole count once.
    """
    rows = spread(documents.where("doc_id is not null and text is not null and trim(text) <> ''").select("doc_id", "text", "lang"))
    scanned = materialise(rows.mapInArrow(_scan, "what string, lang string, key string, bucket int, shape int, n long, doc_id long, end_pos int, next_pos int"), "scanned")
    places = scanned.where("what = 'd'")
    told = materialise(judged(scanned), "verdicts")
    code = F.col("bucket") * (2 * BUCKETS) + F.col("shape")
    open_ = places.where("key <> '!'").join(broadcast_if_small(told), ["lang", "key"], "left")
    ends = open_.where(F.coalesce(F.col("usual") != F.array_contains("other", code), F.lit(True)))
    sure = places.where("key is null or key = '!'")
    return sure.select("doc_id", "end_pos", "next_pos").unionByName(ends.select("doc_id", "end_pos", "next_pos")).groupBy("doc_id", "end_pos").agg(F.max("next_pos").alias("next_pos"))


def sentences(documents: DataFrame) -> DataFrame:
    """documents (doc_id, text, lang) -> (doc_id, sentence_no, start_pos, end_pos) of every sentence; start_pos counts the code points before the sentence.

    Null, empty and blank texts give no rows; rows repeated whole count once.
    """
    first = documents.where("doc_id is not null and text is not null").groupBy("doc_id").agg(F.max(F.length(F.regexp_extract("text", r"(?U)^\s*", 0))).alias("_first"))
    line = Window.partitionBy("doc_id").orderBy("end_pos")
    placed = sentence_places(documents).withColumn("sentence_no", F.row_number().over(line) - 1).withColumn("_before", F.lag("next_pos").over(line))
    return placed.join(first, "doc_id").select("doc_id", "sentence_no", F.coalesce("_before", "_first").cast("int").alias("start_pos"), "end_pos")
