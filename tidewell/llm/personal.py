"""Personal information in free text: labelers vote, EM weighs them, a span classifier decides.

One pass over the texts finds candidate spans and the votes of the labelers (written form,
gazetteer, words to the left, words to the right, counter-evidence). Vote patterns are counted
over all rows; expectation-maximisation on those counts estimates how reliable each labeler is,
and the soft labels train a classifier on hashed features of the spans, which learns from the
corpus what stands beside each kind. Only counts leave the executors: at most BUCKETS x classes
numbers.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.session import materialise, spread

KINDS = ("none", "email", "phone", "id_number", "street_address", "person_name")
NONE, EMAIL, PHONE, ID, ADDRESS, NAME = range(6)
ABSTAIN = 6
LABELERS = ("form", "lexicon", "left", "right", "counter")
#: Hash buckets of the classifier's features, rounds of EM, words of the lexicon up to which one pattern screens texts for them, and weight of the first belief in a labeler: so many votes, and so large a share of all.
BUCKETS, ROUNDS, SCREENED, BELIEF, BELIEF_SHARE = 4096, 25, 2000, 20, 0.02
PLACEHOLDER = {EMAIL: "[EMAIL]", PHONE: "[PHONE]", ID: "[ID_NUMBER]", ADDRESS: "[STREET_ADDRESS]", NAME: "[PERSON_NAME]"}

_MAIL = re.compile(r"(?<![\w.+@/-])[^\W_][\w.+-]*@[^\W_][\w-]*(?:\.[\w-]+)*\.[^\W\d_]{2,}(?![\w@])")
_MAIL_SPELT = re.compile(r"(?<![\w.+-])[^\W_][\w.+-]*(?: ?[(\[{] ?(?:at|AT|At) ?[)\]}] ?| (?:at|AT) )[^\W_][\w-]*(?:(?: ?[(\[{] ?(?:dot|DOT|punkt|point|punto) ?[)\]}] ?| (?:dot|DOT|punkt|punto) |\.)[^\W_][\w-]*)+")
_NUMBER = re.compile(r"(?<![\w@/.:+#-])(?:[A-Za-z]{2}[ -]?)?(?:\+ ?|\(\+?)?\d(?:[\s.()/‐‑–-]{0,3}\d){5,15}(?:[ ‐‑-]?[A-Za-z])?(?![\w@/]|[.:]\d|-\d)")
_STREET_EN = r"\d{1,5}[A-Za-z]? (?:[A-Z][\w'’-]*\.? ){1,3}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Court|Ct|Terrace|Ter|Drive|Dr|Way|Place|Pl|Square|Sq|Boulevard|Blvd|Close|Crescent|Row|Gardens|Walk|Alley|Parkway|Pkwy)\b"
_STREET_DE = r"(?:[A-ZÄÖÜ][\w-]*(?:straße|strasse|str\.|gasse|weg|allee|platz|anger|ring|damm|ufer|hof|steig|graben|markt|chaussee|pfad)|[A-ZÄÖÜ][\w-]+[ -](?:Straße|Strasse|Str\.|Allee|Platz|Gasse|Weg)|(?:Am|An der|An den|Im|In der|Zum|Zur|Auf dem|Auf der|Unter den|Hinter dem|Beim) (?:[A-ZÄÖÜ][\w-]+ ?){1,3}(?<! )),? \d{1,4}(?: ?[a-h](?![\w]))?\b"
_STREET_FR = r"\d{1,4}(?: ?(?:bis|ter|quater)|[A-Za-z])?,? (?:[Rr]ue|[Aa]venue|[Aa]v\.|[Bb]d\.?|[Bb]oulevard|[Cc]hemin|[Pp]lace|[Ii]mpasse|[Aa]llée|[Qq]uai|[Rr]oute|[Cc]ours|[Pp]assage|[Ss]quare)(?: (?:de|du|des|la|le|les|aux?)| [dl]['’])*[ ]?[A-ZÀ-Ý][\w'’-]+(?: (?:(?:de|du|des|la) )*[A-ZÀ-Ý][\w'’-]+)*"
_STREET_ES = r"(?:Calle|calle|C/|Avenida|Avda\.?|Av\.|Plaza|Pza\.?|Pl\.|Paseo|P\.º|Camino|Carrera|Ronda|Travesía)(?: (?:de|del|la|las|los|el|san|santa))* ?[A-ZÁÉÍÓÚÑ][\wÀ-ÿ]+(?: (?:(?:de|del|la|las|los) )*[A-ZÁÉÍÓÚÑ][\wÀ-ÿ]+)*,? (?:n\.?º ?)?\d{1,4}(?: ?(?:bis)|[A-Za-z])?\b"
_STREET = re.compile(rf"(?<![\w./-])(?:{_STREET_ES}|{_STREET_DE}|{_STREET_FR}|{_STREET_EN})")
_STREET_SCREEN = (
    r"(?:stra(?:ß|ss)e|str\.|gasse|weg|llee|latz|anger|ring|damm|ufer|hof|steig|graben|markt|chaussee|pfad|Gasse|Weg|(?:Am|An de[rn]|Im|In der|Zu[mr]|Auf de[mr]|Unter den|Hinter dem|Beim) [A-ZÄÖÜ][^0-9\n]{2,60}),? [0-9]"
    r"|[0-9](?: ?(?:bis|ter|quater)|[A-Za-z])?,? (?:[Rr]ue|[Aa]venue|[Aa]v\.|[Bb]d|[Bb]oulevard|[Cc]hemin|[Pp]lace|[Ii]mpasse|[Aa]llée|[Qq]uai|[Rr]oute|[Cc]ours|[Pp]assage|[Ss]quare)"
    r"|(?:[Cc]alle|C/|Av|Plaza|Pza|Pl\.|Paseo|P\.|Camino|Carrera|Ronda|Travesía)[^0-9\n]{2,60}[0-9]"
    r"|[0-9][A-Za-z]? [A-Z][^0-9\n]{0,50}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Court|Ct|Terrace|Ter|Drive|Dr|Way|Place|Pl|Square|Sq|Boulevard|Blvd|Close|Crescent|Row|Gardens|Walk|Alley|Parkway|Pkwy)"
)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_TITLES = frozenset("dr mr mrs ms prof herr frau señor señora sr sra m mme monsieur madame sir miss".split())

# Number forms. Phones in national and international writing; identity numbers of several countries.
_PHONE_FORMS = [re.compile(p) for p in (
    r"\+ ?\d[\d\s.()/‐‑–-]{7,}", r"00[1-9][\d\s.()/‐‑–-]{8,}", r"\(\d{3}\) ?\d{3}[\s.‐‑-]?\d{4}", r"(?:1[\s.‐‑-])?[2-9]\d{2}[\s.‐‑-]\d{3}[\s.‐‑-]\d{4}",
    r"\(?0\d{2,4}\)?[\s/‐‑-]?\d{3,4}[\s‐‑-]?\d{3,4}", r"\(?0\d{1,4}\)?[\s/.‐‑-]\d{2,8}(?:[\s.‐‑-]\d{2,5}){0,4}", r"0\d(?:[\s.]\d{2}){4}", r"[67]\d{2}[\s.]\d{3}[\s.]\d{3}", r"0[1-9]\d{8,9}",
)]
_ID_FORMS = [re.compile(p) for p in (
    r"\d{3}[\s‐‑-]\d{2}[\s‐‑-]\d{4}", r"[A-Za-z]{2}[ -]?\d{2} ?\d{2} ?\d{2}[ -]?[A-Da-d]", r"\d{8}[\s‐‑-]?[A-Za-z]", r"[XYZxyz][ -]?\d{7}[ -]?[A-Za-z]", r"\d{4}[\s‐‑-]\d{4}[\s‐‑-]\d{4}", r"\d{2} \d{3} \d{3} \d{3}", r"\d{11}", r"\d{1,2}\.\d{3}\.\d{3}[\s‐‑-]?[A-Za-z]", r"\d{3}\.\d{3}\.\d{3}-\d{2}",
)]
# Words that stand beside each kind in English, German, French and Spanish.
_PHONE_LEFT = re.compile(r"(?:\b(?:call|ring|phone|tel|telefon|téléphone|teléfono|mobile|cell|whatsapp|number is|nummer ist|numéro est|desk on|reach\b.{0,20} on|ruf|anrufen|appelle\w*|llámame al|fax|sms|text|handy|móvil|dial)\b[.: ]*)$", re.I)
_PHONE_RIGHT = re.compile(r"^[ .,;:(]*(?:ext\b|extension\b|works best|any ?time|anrufen|\(?(?:mobile|office|home|cell)\b)", re.I)
_ID_LEFT = re.compile(r"(?:\b(?:ssn|nino?|ni number|national insurance|dni|nif|nie|passport|pass(?:eport|aporte)?|id|id card|ausweis\w*|steuer-?id\w*|steuernummer|tax (?:no\.?|number|id)|identity|social security|insee|aadhaar|cpf|personal\w*nummer|carte d.identité|my id)\b[.:# ]*)$", re.I)
_NOT_NUMBER = re.compile(r"(?:\b(?:order|ticket|invoice no|build|commit|version|v|host|port|latency|issue|pr|rev|revision|bestellung|commande|pedido|isbn|sku|tracking|ticket is|order no\.?)\b[.:# ]*)$", re.I)
_MAIL_NEAR = re.compile(r"(?:\b(?:e-?mail|mail is|correo|contact|kontakt|write to|schreib an|cc|send\b.{0,20} to|went out as|courriel)\b[ :<(]*)$", re.I)
_STREET_NEAR = re.compile(r"(?:\b(?:at|to|addr(?:ess)?|adresse|dirección|oficina en|office|est au|est à|wohnt|uns|vive en|live[sd]? (?:at|in)|keys at)\b[ :]*)$", re.I)
_NAME_LEFT = re.compile(r"(?:\b(?:thanks to|ask|met|signed|talk by|written by|gracias a|merci à|danke an|cc|from|regards|with|hi|hello|hallo|dear|by|dr|prof|mr|mrs|ms|herr|frau|sr|sra|mme)\b[.,: ]*)$", re.I)
_NAME_RIGHT = re.compile(r"^[,: ]*(?:said\b|says\b|works (?:on|at|for)\b|is (?:the|our|my)\b|will\b|wrote\b|told\b|thinks\b|a dit\b|dijo\b|schrieb\b|sagte?\b)", re.I)
_ORDINARY = frozenset("the a an my our this that one each whoever der die das unser unsere le la el les los las nuestro notre cette esta ein eine un une wir ich you we they he she it in on at for and or but so if when what who how why where hat has had with from to of by ask call thanks met gracias merci danke schreib write contact order host build ping clone street road board period feed export ticket open has anyone not sharing latency signed intro slides mail cc steuer whatsapp tel ruf mi me as is are was were be been will would".split())


class Lexicon:
    """Given and family names with what their endings and beginnings share."""

    def __init__(self, rows: list[tuple[str, str]]):
        self._known: dict[str, tuple[int, int, bool]] = {}
        self.given = {w.casefold() for w, k in rows if k == "given"}
        self.family = {w.casefold() for w, k in rows if k == "family"}
        self.endings = self._shared(w[-n:] for w in self.family for n in (4, 5, 6, 7) if len(w) > n + 1)
        self.beginnings = self._shared(w[:n] for w in self.family for n in (3, 4, 5, 6) if len(w) > n + 1)
        words = sorted(self.given | self.family, key=len, reverse=True)
        #: What a text must hold so that a name can be in it: a word of the lexicon, an ending of its family names, or two words with capitals.
        self.screen = r"\p{Lu}[\p{L}'’‐‑-]+[ ,.\x{A0}]+(?:\p{Lu}[ .\x{A0}]+){0,3}\p{Lu}" + "".join(f"|(?i:{re.escape(w)})" for w in [*words, *sorted(self.endings)]) if len(words) <= SCREENED else ""

    @staticmethod
    def _shared(parts) -> frozenset[str]:
        n: dict[str, int] = {}
        for p in parts:
            n[p] = n.get(p, 0) + 1
        return frozenset(p for p, k in n.items() if k >= 4)

    def kinds(self, word: str) -> tuple[int, int, bool]:
        """(given, family, ordinary) of a word, remembered."""
        known = self._known.get(word)
        if known is None:
            if len(self._known) > 200_000:
                self._known.clear()
            known = self._known[word] = (self.is_given(word), self.is_family(word), word.casefold() in _ORDINARY)
        return known

    def is_family(self, word: str) -> int:
        """2 in the lexicon, 1 built from shared beginnings and endings, 0 else; of a double name the weaker half counts."""
        return min(self._family(p) for p in re.split("[-‐‑]", word.casefold()) or [""])

    def _family(self, w: str) -> int:
        if w in self.family:
            return 2
        return int(any(w.endswith(e) and (w[: -len(e)] in self.beginnings or any(w.startswith(b) for b in self.beginnings)) for n in (4, 5, 6, 7) if len(w) > n and (e := w[-n:]) in self.endings))

    def is_given(self, word: str) -> int:
        parts = re.split("[-‐‑]", word.casefold())
        return 2 * all(p in self.given for p in parts)


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % BUCKETS


def _shape(text: str) -> str:
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"\d+", lambda m: f"9{len(m.group())}", text))[:40]


def _features(kind: int, text: str, left: str, right: str, extra: tuple[str, ...] = ()) -> list[int]:
    words_left, words_right = _WORD.findall(left.casefold())[-2:], _WORD.findall(right.casefold())[:2]
    told = [f"{kind}:shape:{_shape(text)}", f"{kind}:left:{words_left[-1:]}", f"{kind}:left2:{words_left}", f"{kind}:right:{words_right[:1]}", f"{kind}:right2:{words_right}", *(f"{kind}:{e}" for e in extra)]
    return [_bucket(x) for x in told]


def _around(text: str, start: int, end: int) -> tuple[str, str]:
    return text[max(0, start - 40) : start], text[end : end + 30]


def number_spans(text: str) -> Iterator[tuple]:
    for m in _NUMBER.finditer(text):
        start, end = m.span()
        found = m.group()
        # Letters belong to the number only where an identity number has them.
        lead = re.match(r"[A-Za-z]{2}[ -]?", found)
        tail = re.search(r"[ ‐‑-]?[A-Za-z]$", found)
        first, last = lead.end() if lead else 0, len(tail.group()) if tail else 0
        ways = [(0, 0), (first, 0), (0, last), (first, last)]
        left_off, right_off = next((w for w in ways if any(p.fullmatch(found[w[0] : len(found) - w[1]]) for p in _ID_FORMS)), (first, last))
        if right_off == last == 1:
            continue  # a letter without gap that no form knows: part of a code
        start, end = start + left_off, end - right_off
        found = text[start:end]
        if found.startswith("(") and ")" not in found:
            start, found = start + 1, found[1:]
        digits = sum(c.isdigit() for c in found)
        if digits < 6:
            continue
        left, right = _around(text, start, end)
        phone, ident = any(p.fullmatch(found) for p in _PHONE_FORMS) and 8 <= digits <= 15, any(p.fullmatch(found) for p in _ID_FORMS)
        form = PHONE if phone and not ident else ID if ident and not phone else ABSTAIN if phone else NONE
        lv = PHONE if _PHONE_LEFT.search(left) else ID if _ID_LEFT.search(left) else ABSTAIN
        rv = PHONE if _PHONE_RIGHT.match(right) else ABSTAIN
        counter = NONE if _NOT_NUMBER.search(left) or re.match(r"\d{1,3}(?:\.\d{1,3}){3}$", found) else ABSTAIN
        yield start, end, found, (form, ABSTAIN, lv, rv, counter), _features(PHONE, found, left, right)


def mail_spans(text: str) -> Iterator[tuple]:
    for spelt, pattern in ((False, _MAIL), (True, _MAIL_SPELT)):
        for m in pattern.finditer(text):
            start, end = m.span()
            left, right = _around(text, start, end)
            clone = bool(re.match(r":[\w~/]", right)) or bool(re.search(r"(?:clone|ssh|scp|://)\S*(?: it)?(?: from)? ?$", left, re.I))
            sure = not spelt or "(" in m.group() or "[" in m.group() or " dot " in m.group().casefold()
            yield start, end, m.group(), (EMAIL if sure and not clone else NONE, ABSTAIN, EMAIL if _MAIL_NEAR.search(left) else ABSTAIN, ABSTAIN, NONE if clone else ABSTAIN), _features(EMAIL, m.group(), left, right, (f"clone{clone}",))


_STREET_WORDS = frozenset({"street", "road"})
_LAST_WORD = re.compile(r" ([^\W\d_][\w'’-]*)$")


def street_spans(text: str) -> Iterator[tuple]:
    for m in _STREET.finditer(text):
        start, end = m.span()
        # An ordinary word at the end begins the next sentence.
        while (last := _LAST_WORD.search(text[start:end])) and last.group(1).casefold() in _ORDINARY - _STREET_WORDS:
            end -= len(last.group())
        left, right = _around(text, start, end)
        yield start, end, text[start:end], (ADDRESS, ABSTAIN, ADDRESS if _STREET_NEAR.search(left) else ABSTAIN, ABSTAIN, ABSTAIN), _features(ADDRESS, text[start:end], left, right)


_TOKEN = re.compile(r"[^\W\d_]+(?:[-‐‑'’][^\W\d_]+)*")


def name_spans(text: str, lexicon: Lexicon) -> Iterator[tuple]:
    """Two name words with initials between, behind or before them, in either order."""
    tokens = [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(text)]
    kinds = [lexicon.kinds(t[2]) for t in tokens]
    taken = -1
    for at in range(len(tokens) - 1):
        start, stop, first = tokens[at]
        if at <= taken or len(first) < 2:
            continue
        g1, f1, o1 = kinds[at]
        if not (g1 or f1) and (o1 or not first[0].isupper() and not kinds[at + 1][1]) or first.casefold() in _TITLES:
            continue
        k, middle = at + 1, 0
        while k < len(tokens) and len(tokens[k][2]) == 1 and tokens[k][2].isupper() and middle < 3 and text[stop : tokens[k][0]].strip(".") in ("", " "):
            stop, k, middle = tokens[k][1], k + 1, middle + 1
        if k >= len(tokens):
            continue
        begin, end, second = tokens[k]
        g2, f2, o2 = kinds[k]
        gap = text[stop:begin]
        comma = gap in (", ", ",")
        if len(second) < 2 or not (gap in (" ", "\xa0") or comma or middle and gap in (". ", ".")):
            continue
        capital = first[0].isupper() and second[0].isupper()
        strong = (g1 and f2) or (f1 and g2)
        ordinary = o1 or o2
        half = (g1 or g2 or f1 or f2) and capital and not ordinary
        if not strong and (ordinary or not capital and not (f1 or f2 or g1)):
            continue
        left, right = _around(text, start, end)
        lv, rv = _NAME_LEFT.search(left), _NAME_RIGHT.match(right)
        # Small letters need more to go by: a family name and one neighbour, or both neighbours.
        if not strong and not half and not capital and not (lv and rv) and not ((f1 or f2) and (lv or rv) and first[0].isupper() == second[0].isupper()):
            continue
        half = half or not capital
        if comma and g1 and f2 and not (f1 and g2):
            # A family name comes first where a comma parts the two; the other way round is a list.
            strong = False
        trailing = re.match(r",? (?:[A-Z]\.)(?: ?[A-Z]\.)*", text[end : end + 12]) if (comma or f1) and not middle else None
        if trailing:
            end += len(trailing.group())
        street = bool(re.match(r" (?:Street|St|Road|Rd|Ave|Lane)\b", text[end : end + 10])) or bool(re.search(r"\d[a-z]? $", left))
        votes = (NAME if capital else ABSTAIN, NAME if strong else ABSTAIN if half else NONE, NAME if lv else ABSTAIN, NAME if rv else ABSTAIN, NONE if street else ABSTAIN)
        yield start, end, text[start:end], votes, _features(NAME, "x", left, right, (f"given{max(g1, g2)}", f"family{max(f1, f2)}", f"pair{bool(strong)}", f"capital{capital}", f"comma{comma}"))
        taken = k


def spans(text: str, lexicon: Lexicon, which: str = "mnsp") -> list[tuple]:
    """Candidate spans (start, end, found, votes, features); an earlier kind keeps what overlaps."""
    out: list[tuple] = []
    for key, finder in (("m", mail_spans), ("s", street_spans), ("n", number_spans), ("p", lambda t: name_spans(t, lexicon))):
        if key in which:
            out += [x for x in finder(text) if all(x[1] <= y[0] or y[1] <= x[0] for y in out)]
    return out


def _pattern(votes: tuple[int, ...]) -> int:
    code = 0
    for v in votes:
        code = code * 7 + v
    return code


@lru_cache(100_000)
def votes_of(pattern: int) -> tuple[int, ...]:
    out = []
    for _ in LABELERS:
        pattern, v = divmod(pattern, 7)
        out.append(v)
    return tuple(reversed(out))


def _candidates_in(batches: Iterator[pa.RecordBatch], lexicon_rows: list[tuple[str, str]]) -> Iterator[tuple]:
    lexicon = Lexicon(lexicon_rows)
    # A linear-time scan of the Arrow column decides which texts are looked at by which finder.
    screens = {
        "m": "@|(?i: at [^ ]+(?: dot |\\.)|[(\\[{] ?at ?[)\\]}])",
        "n": r"[0-9](?:[^0-9A-Za-z\n]{0,3}[0-9]){5}",
        "s": _STREET_SCREEN,
        "p": lexicon.screen,
    }
    for batch in batches:
        texts = batch.column("text")
        wanted = {k: pc.fill_null(pc.match_substring_regex(texts, p), False) for k, p in screens.items()}
        keep = pc.or_(pc.or_(wanted["m"], wanted["n"]), pc.or_(wanted["s"], wanted["p"]))
        picked = batch.filter(keep)
        flags = {k: v.filter(keep).to_pylist() for k, v in wanted.items()}
        for i, (tbl, row_id, text) in enumerate(zip(picked.column("tbl").to_pylist(), picked.column("row_id").to_pylist(), picked.column("text").to_pylist())):
            which = "".join(k for k in "mnsp" if flags[k][i]) 
            if which:
                yield tbl, row_id, spans(text, lexicon, which)


_SPANS = "tbl string, row_id long, start int, stop int, found_text string, pattern int, features array<int>"
_SPAN_SCHEMA = pa.schema([("tbl", pa.string()), ("row_id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("found_text", pa.string()), ("pattern", pa.int32()), ("features", pa.list_(pa.int32()))])


def _emit(batches: Iterator[pa.RecordBatch], lexicon_rows: list) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _SPAN_SCHEMA)], schema=_SPAN_SCHEMA)

    for tbl, row_id, found in _candidates_in(batches, lexicon_rows):
        rows += [(tbl, row_id, s[0], s[1], s[2], _pattern(s[3]), s[4]) for s in found]
        if len(rows) >= 5000:
            yield told()
            rows = []
    if rows:
        yield told()


class SpanModel:
    """Reliabilities of the labelers and weights of the span classifier; a few hundred kB."""

    def __init__(self, posteriors: dict[int, np.ndarray], weights: np.ndarray):
        self.posteriors, self.weights = posteriors, weights

    def decide(self, pattern: int, features) -> int:
        score = np.log(self.posteriors.get(pattern, np.full(6, 1 / 6)) + 1e-6) * 2 + self.weights[list(features)].mean(axis=0)
        return int(score.argmax())


def estimate(counts: dict[int, int]) -> dict[int, np.ndarray]:
    """EM on counted vote patterns -> class posteriors of each pattern.

    Labelers err independently given the class. Each begins with the belief that its votes are
    right in nine of ten cases; this belief counts as BELIEF votes and BELIEF_SHARE of all, the
    rest is estimated. Counter-evidence has one thing to say only: what is estimated is how often
    it speaks up where there is no personal data; beside a real piece it does so once in 500, which
    nothing but labels could tell better.
    """
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    votes = np.array([votes_of(p) for p in patterns])
    # A vote says nothing about how often a labeler abstains; classes no labeler names for a pattern are impossible there.
    named = np.zeros((len(patterns), 6), bool)
    for j in range(len(LABELERS)):
        seen = votes[:, j] < ABSTAIN
        named[np.nonzero(seen)[0], votes[seen, j]] = True
    # Only a number that both forms fit has no vote at all: what stands beside it decides.
    open_ = ~named.any(axis=1)
    named[np.ix_(open_, [PHONE, ID])] = True
    named[:, NONE] = ~open_
    right = np.full((len(LABELERS), 6, 6), 0.1 / 5)
    for j in range(len(LABELERS)):
        np.fill_diagonal(right[j], 0.9)
    counter = LABELERS.index("counter")
    against = votes[:, counter] < ABSTAIN
    first = np.where(np.arange(6) == NONE, 0.5, 0.002)
    speaks, belief = first.copy(), BELIEF + BELIEF_SHARE * n.sum()
    prior, start = np.full(6, 1 / 6), right.copy()
    for _ in range(ROUNDS):
        log = np.log(prior)[None, :] + np.zeros((len(patterns), 6))
        log += np.where(against[:, None], np.log(speaks), np.log(1 - speaks))
        for j in range(len(LABELERS)):
            seen = votes[:, j] < ABSTAIN
            if j != counter:
                log[seen] += np.log(right[j][:, votes[seen, j]].T)
        log[~named] = -50
        post = np.exp(log - log.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        weight = post * n[:, None]
        prior = (weight.sum(axis=0) + 1) / (weight.sum() + 6)
        for j in range(len(LABELERS)):
            table = start[j] * belief
            for v in range(6):
                table[:, v] += weight[votes[:, j] == v].sum(axis=0)
            right[j] = table / table.sum(axis=1, keepdims=True)
        speaks[NONE] = (weight[against, NONE].sum() + first[NONE] * belief) / (weight[:, NONE].sum() + belief)
    post[np.ix_(open_, [PHONE, ID])] = 0.5
    return dict(zip(patterns, post))


def candidates(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """texts (tbl, row_id, text) -> candidate spans (tbl, row_id, start, stop, found_text, pattern, features); start and stop in code points.

    The lexicon, a list of names, goes whole to the workers.
    """
    words = sorted((r.word, r.kind) for r in lexicon.where("word is not null").select("word", "kind").distinct().collect())
    told = texts.where("row_id is not null and text is not null and text <> ''").select("tbl", F.col("row_id").cast("long"), "text")
    return spread(told).mapInArrow(partial(_emit, lexicon_rows=words), _SPANS)


def fit(found: DataFrame) -> SpanModel:
    """Count vote patterns over all candidates, run EM, and train the classifier on the soft labels.

    What comes to the driver is bounded: at most 7^5 patterns and BUCKETS x patterns' classes.
    """
    counts = {r.pattern: r.n for r in found.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()}
    post = estimate(counts) if counts else {}
    spark = found.sparkSession
    told = spark.createDataFrame([(p, [float(x) for x in v]) for p, v in post.items()], "pattern int, post array<double>") if post else None
    weights = np.zeros((BUCKETS, 6))
    if told is not None:
        sums = found.select("pattern", F.explode("features").alias("f")).groupBy("pattern", "f").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(told), "pattern").groupBy("f").agg(*[F.sum(F.col("n") * F.col("post")[c]).alias(f"c{c}") for c in range(6)])
        total = np.zeros(6)
        for r in sums.collect():
            weights[r.f] = [r[f"c{c}"] for c in range(6)]
            total += weights[r.f]
        share = (total + 1) / (total.sum() + 6)
        weights = np.log((weights + 2 * share) / (weights.sum(axis=1, keepdims=True) + 2))
        weights = np.where(np.isfinite(weights), weights, math.log(1e-6)) - np.log(share) * 0.5
    return SpanModel(post, weights)


def classify(found: DataFrame, model: SpanModel) -> DataFrame:
    """Candidates -> (tbl, row_id, start, stop, kind, found_text) of what is personal data."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = [KINDS[model.decide(p, f)] for p, f in zip(b.column("pattern").to_pylist(), b.column("features").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("tbl", "row_id", "start", "stop")), pa.array(kinds, pa.string()), b.column("found_text")], ["tbl", "row_id", "start", "stop", "kind", "found_text"])

    told = found.mapInArrow(decide, "tbl string, row_id long, start int, stop int, kind string, found_text string").where("kind <> 'none'")
    return _without_next_sentence(told)


def _without_next_sentence(told: DataFrame) -> DataFrame:
    """Cut from an address the capital words of the next sentence: of its beginnings the street that most addresses name stays."""
    told = materialise(told, "told")
    numbered = F.col("kind") == "street_address"
    open_ended = numbered & F.col("found_text").rlike(r"^[0-9].* [\p{Lu}][\p{L}'’-]*$")
    street = F.regexp_replace("found_text", r"^[0-9]+ ?(?:bis|ter|quater|[A-Za-z])?,? ", "")
    fixed = told.where(~open_ended)
    loose = told.where(open_ended).withColumn("street", street)
    # A row and a street count once, however often a row repeats it.
    counts = loose.select("tbl", "row_id", "found_text", "street").distinct().groupBy("street").agg(F.count(F.lit(1)).alias("n"))
    words = F.split("street", " ")
    shorter = counts.select("street", "n", F.explode(F.transform(F.sequence(F.lit(2), F.size(words)), lambda i: F.array_join(F.slice(words, 1, i), " "))).alias("part"))
    best = shorter.join(counts.select(F.col("street").alias("part"), F.col("n").alias("support")), "part").groupBy("street").agg(F.max_by("part", F.struct("support", -F.length("part"))).alias("part"))
    cut = loose.join(best, "street").withColumn("less", F.length("street") - F.length("part"))
    cut = cut.select("tbl", "row_id", "start", (F.col("stop") - F.col("less")).cast("int").alias("stop"), "kind", F.expr("substring(found_text, 1, length(found_text) - less)").alias("found_text"))
    return fixed.unionByName(cut)


def _pieces(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    found = materialise(candidates(texts, lexicon), "spans")
    return classify(found, fit(found))


def personal_data(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """texts (tbl, row_id, text) -> (tbl, row_id, kind, found_text) of every piece of personal data.

    Null and empty texts and null ids give no rows; whole-row copies and repeats within a row
    count once; an empty table or lexicon gives what the other labelers find.
    """
    return _pieces(texts, lexicon).select("tbl", "row_id", "kind", "found_text").distinct()


def redacted(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """texts (tbl, row_id, text) -> the same rows, once each, with a typed placeholder in place of each piece personal_data finds.

    Two rows of one id with different texts keep what was found in each of them.
    """
    rows = texts.select("tbl", F.col("row_id").cast("long").alias("row_id"), "text").distinct()
    placeholder = F.create_map(*[F.lit(x) for k, v in PLACEHOLDER.items() for x in (KINDS[k], v)])
    piece = F.struct(F.col("start"), F.col("stop"), placeholder[F.col("kind")].alias("by"), F.col("found_text"))
    listed = _pieces(texts, lexicon).groupBy("tbl", "row_id").agg(F.reverse(F.array_sort(F.collect_set(piece))).alias("pieces"))
    # From the last piece to the first, so that the places of the others hold.
    fits = lambda x: F.substring("text", x["start"] + 1, x["stop"] - x["start"]) == x["found_text"]
    own = F.filter("pieces", fits)
    done = F.aggregate(own, F.col("text"), lambda t, x: F.concat(F.substring(t, F.lit(1), x["start"]), x["by"], F.substring(t, x["stop"] + 1, F.length(t))))
    return rows.join(listed, ["tbl", "row_id"], "left").select("tbl", "row_id", F.when(F.col("pieces").isNull(), F.col("text")).otherwise(done).alias("text"))


def table_texts(messages: DataFrame, grades: DataFrame, requests: DataFrame) -> DataFrame:
    one = lambda df, tbl, key, text: df.select(F.lit(tbl).alias("tbl"), F.col(key).alias("row_id"), F.col(text).alias("text"))
    return one(messages, "messages", "msg_id", "text").unionByName(one(grades, "grades", "grade_id", "original_text")).unionByName(one(requests, "ingest_requests", "entry_id", "text"))
