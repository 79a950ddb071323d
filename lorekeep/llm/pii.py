"""Personal information inside free text.

A semi-Markov conditional random field over candidate segments. Grammars propose
whole spans with their kind (several readings of the same place: with or without a
town, two or three words of a name); features describe the whole span and what stands
around it; the weights are trained (``pii_train``). Dynamic programming over the
candidates, whose length is bounded by the grammars, chooses boundaries and kinds
jointly; text outside the chosen segments scores zero.
"""

from __future__ import annotations

import json
import math
import pkgutil
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "phone", "identity_number", "street_address", "name")


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    features: tuple[str, ...]


# words -------------------------------------------------------------------------
_WORD = re.compile(r"(?<![\w/:.@+-])[^\W\d_]+(?:['’-][^\W\d_]+)*\.?(?![\w/:@(]|[.-]\w)")
_PARTICLES = {"de", "van", "von", "der", "den", "del", "la", "da", "di", "du", "dos", "le", "ter", "zu", "bin", "al", "el", "mac"}
_STREET_END = {"street", "st", "road", "rd", "avenue", "ave", "lane", "ln", "close", "court", "ct", "drive", "dr", "way", "terrace", "boulevard", "blvd", "square", "sq", "place", "crescent", "walk", "row", "hill", "grove", "gardens", "quay", "mews"}
_STREET_FRONT = {"rue", "avenue", "boulevard", "bd", "impasse", "chemin", "place", "quai", "allée", "route", "cours", "passage", "ruelle", "square"}
_STREET_ES = {"calle", "camino", "plaza", "avenida", "avda", "paseo", "ronda", "travesía", "carretera", "callejón", "c"}
_STREET_DE = ("straße", "strasse", "str", "gasse", "allee", "weg", "platz", "ufer", "damm", "ring")
_DE_FRONT = {"am", "an", "auf", "im", "in", "zum", "zur", "unter"}
_LABELS = {"tel", "fon", "fax", "phone", "telefon", "teléfono", "téléphone", "mobile", "mobil", "cell", "mail", "email", "courriel", "correo", "and", "und", "et", "y", "or", "oder", "ou"}
_TITLES = {"dr", "mr", "mrs", "ms", "prof", "herr", "frau", "mme", "sr", "sra", "señor", "señora"}


class Lexicon:
    """Name words: given names, family names, and the beginnings and ends that family names are built from."""

    def __init__(self, words: Iterable[tuple[str, str]]):
        self.given: set[str] = set()
        self.family: set[str] = set()
        for word, part in words:
            if word:
                low = word.lower()
                (self.given if part == "given" else self.family).add(low.split(" ")[-1] if part != "given" else low)
        self.heads = {w[:4] for w in self.family if len(w) > 6}
        self.tails = {w[-4:] for w in self.family if len(w) > 6} | {w[-3:] for w in self.family if len(w) > 6}
        self.memo: dict[str, str] = {}

    def kind(self, word: str) -> str:
        """G given, F family, f built like a family name, P particle, I initial, h inner apostrophe or hyphen, S street word, T title, X label or joining word, w other."""
        got = self.memo.get(word)
        if got is None:
            low = word.lower().rstrip(".")
            if len(low) == 1 and low.isalpha():
                got = "I" if word[0].isupper() or word.endswith(".") else "X"
            elif low in _LABELS:
                got = "X"
            elif low in self.family:
                got = "F"
            elif low in self.given:
                got = "G"
            elif low in _PARTICLES:
                got = "P"
            elif low in _STREET_END or low in _STREET_FRONT or low in _STREET_ES or (len(low) > 5 and low.endswith(_STREET_DE) and (word[0].isupper() or not low.endswith("ring"))):
                got = "S"
            elif low in _TITLES:
                got = "T"
            elif len(low) > 5 and low[:4] in self.heads and (low[-3:] in self.tails or low[-4:] in self.tails):
                got = "f"
            elif "'" in low or "’" in low or "-" in low:
                got = "h"
            else:
                got = "w"
            if len(self.memo) < 200_000:  # a cache: it changes the speed, not the result
                self.memo[word] = got
        return got


def _case(w: str) -> str:
    w = w.rstrip(".")
    if w.isupper():
        return "U"
    if w[:1].isupper():
        return "T"
    return "l"


# context -----------------------------------------------------------------------
_LAST = re.compile(r"([^\W\d_]+)\W*$")
_NEXT = re.compile(r"^\W*([^\W_]+)")


# Words that say what kind of number follows, in several languages.
_ID_WORDS = {"passport", "passeport", "pasaporte", "reisepass", "ausweis", "ausweisnummer", "ssn", "sin", "nino", "insurance", "national", "identity", "identité", "identidad", "tax", "taxpayer", "tin", "steuer", "steuernummer", "fiscal", "nif", "nie", "dni", "nir", "cpf", "aadhaar", "id", "nid"}
_PHONE_WORDS = {"phone", "telephone", "tel", "telefon", "téléphone", "teléfono", "mobile", "mobil", "móvil", "cell", "fax", "call", "dial", "ring", "sms", "appeler", "rappeler", "llamar", "anrufen", "whatsapp"}
_LABEL = re.compile(r"[^\W\d_]+")


def _label(text: str, start: int) -> str:
    """What kind of number the last label of the same clause announces: id, phone or none."""
    clause = re.split(r"[.;\n,]", text[max(0, start - 40) : start])[-1]
    for w in reversed(_LABEL.findall(clause)):
        low = w.lower()
        if low in _ID_WORDS:
            return "id"
        if low in _PHONE_WORDS:
            return "phone"
    return "none"


def _around(text: str, start: int, end: int, kind: str) -> list[str]:
    before, after = text[max(0, start - 24) : start], text[end : end + 16]
    left = _LAST.search(before)
    right = _NEXT.match(after)
    lc, rc = before[-1:] or "^", after[:1] or "$"

    def cls(c: str) -> str:
        if c.isalpha():
            return "a"
        if c.isdigit():
            return "0"
        return c

    n = right.group(1) if right else "$"
    out = [f"{kind}|l={left.group(1).lower() if left else '^'}", f"{kind}|lc={cls(lc)}", f"{kind}|rc={cls(rc)}", f"{kind}|r={n.lower()}"]
    glue = after[: right.start(1)] if right else after[:2]
    out.append(f"{kind}|rn={glue[:2]!r}{'0' if n[0].isdigit() else _case(n)}")
    return out


# emails ------------------------------------------------------------------------
_AT, _DOT = r"(?:@| ?[\[({<]\s?at\s?[\])}>] ?| at )", r"(?:\.| ?[\[({<]\s?dot\s?[\])}>] ?| dot )"
_EMAIL = re.compile(rf"(?<![\w.+%-])([\w](?:[\w.+%'-]*[\w+-])?){_AT}((?:[\w-]+{_DOT})+)([a-z]{{2,24}})(?![\w@-])", re.I)
_EMAIL_HINT = re.compile(r"@| ?[\[({<]\s?at\s?[\])}>]| at (?=[\w-]+ dot )", re.I)


def _emails(text: str) -> Iterator[Span]:
    at = 0
    for hint in _EMAIL_HINT.finditer(text):
        if hint.start() < at:
            continue
        # the local part has no spaces, so it begins after the last one before the hint
        begin = max(text.rfind(" ", 0, hint.start()), text.rfind("\n", 0, hint.start())) + 1
        m = _EMAIL.search(text, begin)
        if not m or m.start() > hint.start():
            continue
        at = m.end()
        body = m.group().lower()
        form = "@" if "@" in body else "br" if re.search(r"[\[({<]\s?at", body) else "word"
        dots = "word" if " dot " in body else "br" if re.search(r"[\[({<]\s?dot", body) else "."
        if form == "word" and dots == ".":
            dots = "mixed"
        yield Span(m.start(), m.end(), "email", (f"email|form={form},{dots}", f"email|tld={min(len(m.group(3)), 8)}", *_around(text, m.start(), m.end(), "email")))


# numbers -----------------------------------------------------------------------
_EXT = r"(?:,? ?(?:ext|x|extension|durchwahl|poste|int)\.? ?\d{1,6})?"
_PHONES = [
    ("intl", re.compile(rf"(?<![\w+])\+\d{{1,3}}(?:[ .-]?\(\d{{1,4}}\))?(?:[ .-]?\d{{1,5}}){{2,6}}{_EXT}", re.I)),
    ("intl00", re.compile(rf"(?<![\w+.])00\d{{1,3}}(?:[ .-]\d{{1,5}}){{2,6}}{_EXT}", re.I)),
    ("paren", re.compile(rf"(?<!\w)\(\d{{2,5}}\) ?\d{{2,4}}(?:[ .-]?\d{{2,4}}){{1,3}}{_EXT}", re.I)),
    ("us", re.compile(rf"(?<![\w.+-])(?:1[ .-])?\d{{3}}([ .-])\d{{3}}\1\d{{4}}(?![\w-]|\.\d){_EXT}", re.I)),
    ("trunk", re.compile(rf"(?<![\w.+-])0\d{{1,5}}(?: ?/ ?|-| )\d{{2,8}}(?:[ .-]\d{{1,6}}){{0,3}}(?![\w])(?!-\d){_EXT}", re.I)),
    ("pairs", re.compile(rf"(?<![\w.+-])0\d(?:([ .-])\d\d)(?:\1\d\d){{3}}(?![\w]|[.-]\d){_EXT}", re.I)),
    ("groups", re.compile(rf"(?<![\w.+-])\d{{3}} \d{{3}} \d{{3}}(?![\w]|[ .-]\d){_EXT}", re.I)),
    ("plain", re.compile(rf"(?<![\w.+-])0?\d{{9,10}}(?![\w]|[.-]\d){_EXT}", re.I)),
]
_IDS = [
    ("ssn", re.compile(r"(?<![\w.+-])\d{3}([- ])\d{2}\1\d{4}(?![\w]|-\d)")),
    ("ni", re.compile(r"(?<![\w.+-])[A-Z]{2}( ?)\d\d\1\d\d\1\d\d\1[A-D](?![\w])", re.I)),
    ("passport", re.compile(r"(?<![\w.+-])(?:[A-Z]{1,2}\d{6,9}|[a-z]{1,2}\d{8,9})(?![\w]|-\d)")),
    ("dni", re.compile(r"(?<![\w.+-])\d{8}-?[A-Z](?![\w])", re.I)),
    ("tax", re.compile(r"(?<![\w.+-])\d{2}([ ./-])\d{3}\1\d{3}\1\d{3}(?![\w]|-\d)")),
    ("tax11", re.compile(r"(?<![\w.+-])\d{11}(?![\w]|-\d)")),
    ("cpf", re.compile(r"(?<![\w.+-])\d{3}\.\d{3}\.\d{3}-\d{2}(?![\w]|-\d)")),
    ("twelve", re.compile(r"(?<![\w.+-])\d{4}([ -])\d{4}\1\d{4}(?![\w]|[ -]\d)")),
    ("nir", re.compile(r"(?<![\w.+-])[12]( ?)\d{2}\1\d{2}\1\d[\dAB]\1\d{3}\1\d{3}(?: ?\d{2})?(?![\w]|[ -]\d)")),
    ("nine", re.compile(r"(?<![\w.+-])\d{9}(?![\w]|[.-]\d)")),
    ("tax9", re.compile(r"(?<![\w.+-])\d{3}([ ./-])\d{3}\1\d{3}(?![\w]|[.-]\d)")),
]
_DENSE = re.compile(r"[+(]?(?:[A-Za-z]{1,2} ?)?(?:\d[ ()./-]{0,3}){6,}(?:[A-Za-z]\b)?")


#: Characters behind a dense stretch of digits that are searched first; a match that reaches their end is searched for again in twice as many.
_REACH = 48


def _matches(rule: re.Pattern, text: str, lo: int, first: int, last: int) -> Iterator[re.Match]:
    """Matches that begin in lo..first, as if the whole rest of the text were searched."""
    reach = _REACH
    while True:
        hi = min(len(text), last + reach)
        found = [m for m in rule.finditer(text, lo, hi) if m.start() < first]
        # at the end of the window, look-aheads and greedy parts see a text that ends there
        if hi == len(text) or all(m.end() + 4 < hi for m in found):
            return iter(found)
        reach *= 2


# a bank account number is no identity number, and no part of it is one or a telephone
_ACCOUNT = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")


def _numbers(text: str) -> Iterator[Span]:
    accounts: list[tuple[int, int]] | None = None
    for w in _DENSE.finditer(text):
        if accounts is None:
            accounts = [m.span() for m in _ACCOUNT.finditer(text)]
        if any(a <= w.start() < b for a, b in accounts):
            continue
        lo, label = max(0, w.start() - 3), None
        for kind, rules in (("phone", _PHONES), ("identity_number", _IDS)):
            for name, rule in rules:
                for m in _matches(rule, text, lo, w.end(), w.end()):
                    body = m.group()
                    shape = re.sub(r"[A-Z]", "A", re.sub(r"[a-z]", "a", re.sub(r"\d", "0", body)))
                    digits = sum(c.isdigit() for c in body)
                    label = label or _label(text, m.start())
                    f = (f"{kind}|rule={name}", f"{kind}|shape={shape}", f"{kind}|digits={digits}", f"{kind}|rule,lc={name},{text[m.start() - 1 : m.start()] or '^'}", f"{kind}|label={label}", f"{kind}|rule,label={name},{label}")
                    yield Span(m.start(), m.end(), kind, (*f, *_around(text, m.start(), m.end(), kind)))


# addresses ---------------------------------------------------------------------
_NAMEWORD = r"[^\W\d_][^\W\d_'’-]*(?:['’-][^\W\d_]+)*"
_NUM = r"(?<![\w.,/-])\d{1,5} ?[a-z]?(?: (?:bis|ter|quater))?"
_LINK = r"(?:(?:de la|de l['’]|du|des|de|d['’]|la|le|les|del|de las|de los|el|las|los)(?<=['’])|(?:de las|de los|de la|del|du|des|de|la|le|les|el|las|los) )"
_EN = re.compile(rf"(?<![\w.,/-])\d{{1,5}}(?: ?[a-z])?(?: (?:(?:st|mt|gt)\.|[^\W\d_]['’\w-]+)){{1,3}}? (?:{'|'.join(sorted(_STREET_END, key=len, reverse=True))})\b\.?", re.I)
_FR = re.compile(rf"{_NUM},? (?:{'|'.join(sorted(_STREET_FRONT, key=len, reverse=True))}) (?:{_LINK})?{_NAMEWORD}(?: {_NAMEWORD}){{0,2}}?(?=[,.;)\n\"]|$| )", re.I)
_ES = re.compile(rf"(?<![\w/])(?:calle|camino|plaza|avenida|avda\.?|paseo|ronda|travesía|carretera|callejón|c/) ?(?:{_LINK})?{_NAMEWORD}(?: {_NAMEWORD}){{0,2}},? \d{{1,4}}(?: ?[a-z]\b)?(?![\w])", re.I)
_DE = re.compile(rf"(?<![\w/])(?:{_NAMEWORD}(?:straße|strasse|str\.|gasse|allee|weg|platz|ufer|damm|ring)|(?:{_NAMEWORD} )?(?:straße|strasse|str\.|gasse|allee|platz)|(?:an der|an den|am|auf dem|auf der|im|in der|zum|zur|unter den) {_NAMEWORD}(?: {_NAMEWORD})?) \d{{1,4}}(?: ?[a-z]\b)?(?![\w])", re.I)
_APT = re.compile(r",?[ \n]+(?:apt|apartment|flat|unit|suite|ste|appt|app|piso|wohnung|whg|floor)\.? ?#?\d{0,4} ?[a-z]?\d{0,3}(?![\w])", re.I)
_ZIP_TOWN = re.compile(r",?[ \n]+(\d{4,6}) ")
_TOWN = re.compile(rf"({_NAMEWORD})")
_SEP = re.compile(r",[ \n]+|\n")
_ZIP = re.compile(r",? (\d{4,6}|[A-Z]{1,2}\d[A-Z\d]? \d[A-Z]{2})(?![\w-]|\.\d)")
_TOWN_LINKS = {"an", "der", "am", "de", "del", "la", "las", "los", "les", "du", "sur", "le", "in", "im", "bei", "den", "l", "d", "upon", "under", "of", "the"}


def _towns(text: str, at: int, most: int = 5) -> list[tuple[int, int, bool]]:
    """(end, words, whether the last word may end a town) of each length of a town that starts at ``at``."""
    out, words = [], 0
    while words < most:
        m = _TOWN.match(text, at)
        if not m:
            break
        words += 1
        out.append((m.end(), words, m.group().lower() not in _TOWN_LINKS))
        at = m.end()
        if text[at : at + 1] != " ":
            break
        at += 1
    return [x for x in out if x[2]]


_STRETCH = re.compile(r"\S+")
#: Words before and behind a street word that the grammars can take up: a number with its addition and three words, particles and a number behind.
_BEFORE, _BEHIND = 6, 9


def _addresses(text: str, around: list[int]) -> Iterator[Span]:
    seen: set[tuple[int, int]] = set()
    stretches = [m.span() for m in _STRETCH.finditer(text)]
    begins = [s for s, _ in stretches]
    for hit in around:
        at = bisect_right(begins, hit) - 1
        lo, hi = stretches[max(0, at - _BEFORE)][0], stretches[min(len(stretches) - 1, at + _BEHIND)][1]
        for name, rule in (("en", _EN), ("fr", _FR), ("es", _ES), ("de", _DE)):
            for m in rule.finditer(text, lo, hi):
                if (m.start(), m.end()) in seen or not m.start() <= hit <= m.end():
                    continue
                seen.add((m.start(), m.end()))
                yield from _address_readings(text, m.start(), m.end(), name)


def _address_readings(text: str, start: int, core: int, rule: str) -> Iterator[Span]:
    tails: list[tuple[int, str]] = [(core, "")]
    apt = _APT.match(text, core)
    if apt:
        tails.append((apt.end(), "A"))
    readings: list[tuple[int, str, int]] = []
    for end, mark in tails:
        readings.append((end, mark, 0))
        z = _ZIP_TOWN.match(text, end)
        if z:
            readings.append((z.end(1), mark + "Z", 0))
            for e, n, _ in _towns(text, z.end()):
                readings.append((e, mark + "ZT", n))
        sep = _SEP.match(text, end)
        if sep:
            for e, n, _ in _towns(text, sep.end(), 4):
                readings.append((e, mark + "T", n))
                p = _ZIP.match(text, e)
                if p:
                    readings.append((p.end(), mark + "TZ", n))
    words = len(text[start:core].split())
    street = [w for w in re.findall(r"[^\W\d_]+", text[start:core]) if w.lower() not in _TOWN_LINKS and len(w) > 1]
    for end, mark, n in readings:
        e = end
        while text[e - 1] in ".,":
            e -= 1
        part = re.findall(r"[^\W\d_]+", text[core:end])
        low = sum(w[0].islower() for w in part if w.lower() not in _TOWN_LINKS)
        mixed = bool(part) and bool(low) and any(w[0].isupper() for w in street)
        # a town is no label of what follows, and a full stop behind a word that is written out ends the sentence
        label = any(w.lower() in _ID_WORDS or w.lower() in _PHONE_WORDS for w in part)
        stop = text[core - 1] == "." and len(street[-1] if street else "") > 4 and bool(mark)
        k = "street_address"
        f = [f"{k}|rule={rule}", f"{k}|parts={mark}", f"{k}|town={n}", f"{k}|mixed={mixed}", f"{k}|label={label}", f"{k}|stop={stop}", f"{k}|rule,parts={rule},{mark}", f"{k}|words={min(words, 9)}", f"{k}|low={min(low, 3)}"]
        f.append(f"{k}|parts,town={mark},{n}")
        yield Span(start, e, k, (*f, *_around(text, start, e, k)))


# names -------------------------------------------------------------------------
_GLUE = re.compile(r"^(?: |, |,\n|\n)$")


def _names(text: str, words: list[tuple[int, int, str, str]]) -> Iterator[Span]:
    """Readings of two to five words, with one comma at most."""
    n = len(words)
    for i in range(n - 1):
        c0, w0 = words[i][3], words[i][2]
        if c0 in "STX" or c0 == "w" and not w0[0].isupper() and words[i + 1][3] not in "Ff":
            continue
        if words[i + 1][0] - words[i][1] > 2:
            continue
        comma, caps = -1, []
        for j in range(i, min(i + 5, n)):
            s, e, w, c = words[j]
            if c in "STX":
                break
            if j > i:
                gap = text[words[j - 1][1] : s]
                dotted = words[j - 1][2].endswith(".") and words[j - 1][3] != "I"
                if dotted or not _GLUE.match(gap):
                    break
                if gap[0] == ",":
                    if comma >= 0:
                        break
                    comma = j - i
            caps.append(_case(w) if c not in "P" else "p")
            if j == i:
                continue
            kinds = "".join(x[3] for x in words[i : j + 1])
            strong = sum(k in "FfG" for k in kinds)
            upper = sum(k in "TU" for k in caps)
            if c == "P" or not strong and (upper < len([k for k in kinds if k != "P"]) or "l" in caps):
                continue
            if all(k in "IP" for k in kinds):
                continue
            if not strong and "T" not in [x for x, k in zip(caps, kinds) if k != "I"]:
                continue  # unknown words in capitals throughout: shouted text
            end = e - 1 if w.endswith(".") and c != "I" else e
            if w.endswith(".") and c == "I":
                end = e - 1  # no full stop at the end of what is found
            body = kinds if comma < 0 else kinds[:comma] + "," + kinds[comma:]
            shape = "".join(dict.fromkeys(x for x in caps if x != "p"))
            f = [f"name|kinds={body}", f"name|case={shape}", f"name|kinds,case={body},{shape}", f"name|n={len(kinds)}", f"name|newline={chr(10) in text[words[i][0] : end]}"]
            f += [f"name|first={kinds[0]}", f"name|last={kinds[-1]}", f"name|w={kinds.count('w')}"]
            f.append(f"name|start={_begins(text, words[i][0])},{kinds[0]}")
            yield Span(words[i][0], end, "name", (*f, *_around(text, words[i][0], end, "name")))


def _begins(text: str, at: int) -> bool:
    """Whether a sentence may begin here."""
    before = text[max(0, at - 2) : at].strip(" ")
    return before == "" or before[-1] in ".!?\n"


# field -------------------------------------------------------------------------
def candidates(text: str, lexicon: Lexicon) -> list[Span]:
    """All segments that the grammars propose, with features."""
    words, streets = [], []
    kind = lexicon.kind
    strong = False
    last_cap = -9
    pairs = False
    for m in _WORD.finditer(text):
        w = m.group()
        c = kind(w)
        if c == "S":
            streets.append(m.start())
        elif c in "FfG":
            strong = True
        elif w[0].isupper():
            if m.start() - last_cap <= 2:
                pairs = True
            last_cap = m.end()
        words.append((m.start(), m.end(), w, c))
    out = list(_emails(text))
    out += _numbers(text)
    for i, (s, _, w, c) in enumerate(words):
        if c == "w" and w.lower() in _DE_FRONT and i + 1 < len(words) and words[i + 1][0] - s < 8 and re.match(r"[^\d\n.;:]{3,40} \d{1,4}\b", text[s : s + 48]):
            streets.append(s)
        elif c == "P" and w.lower() in _DE_FRONT and re.match(r"[^\d\n.;:]{3,40} \d{1,4}\b", text[s : s + 48]):
            streets.append(s)
    if "c/" in text or "C/" in text:
        streets += [m.start() for m in re.finditer(r"(?i)(?<!\w)c/", text)]
    if streets:
        out += _addresses(text, streets)
    if strong or pairs:
        out += _names(text, words)
    # one reading of the same place and kind
    return list({(s.start, s.end, s.kind): s for s in out}.values())


def weights() -> dict[str, float]:
    return json.loads(pkgutil.get_data("lorekeep.llm", "pii_weights.json"))


def decode(spans: list[Span], w: dict[str, float]) -> list[Span]:
    """The segmentation of highest score: no two chosen spans overlap, outside text scores 0."""
    order = sorted(((sum(w.get(f, 0.0) for f in s.features), s) for s in spans), key=lambda x: x[1].end)
    order = [x for x in order if x[0] > 0]
    if not order:
        return []
    ends = [s.end for _, s in order]
    best: list[tuple[float, int, bool]] = [(0.0, -1, False)]
    for i, (score, s) in enumerate(order):
        j = bisect_right(ends, s.start, 0, i)
        take = best[j][0] + score
        best.append((take, j, True) if take > best[i][0] else (best[i][0], i, False))
    out, i = [], len(order)
    while i > 0:
        _, j, took = best[i]
        if took:
            out.append(order[i - 1][1])
        i = j
    return out[::-1]


def find(text: str, lexicon: Lexicon, w: dict[str, float]) -> list[Span]:
    if not text:
        return []
    spans = candidates(text, lexicon)
    return decode(spans, w) if spans else []


def redact(text: str, found: list[Span]) -> str:
    """``text`` with a placeholder such as [EMAIL] for each span, everything else as it was."""
    out, at = [], 0
    for s in found:
        out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = s.end
    return "".join([*out, text[at:]])


def _lexicon_rows(lexicon: DataFrame) -> list[tuple[str, str]]:
    # a fixed word list, not a table that grows with the data
    return [(r["word"], r["part"]) for r in lexicon.select("word", "part").collect() if r["word"]]


def find_personal(df: DataFrame, lexicon: DataFrame, key: str = "id", text: str = "content") -> DataFrame:
    """(key, pii_kind, found_text): one row per record, kind and distinct text.

    Defined cases: null and empty texts have no rows; repeated rows count once; texts
    of any length are read whole; other columns are dropped; null keys are left out.
    """
    names = _lexicon_rows(lexicon)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex, w = Lexicon(names), weights()
        for p in parts:
            rows = []
            for k, t in zip(p["key"].tolist(), p["text"].tolist()):
                rows += dict.fromkeys((k, s.kind, t[s.start : s.end]) for s in find(t, lex, w))
            yield pd.DataFrame(rows, columns=[key, "pii_kind", "found_text"])

    rows = df.filter(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"{key} long, pii_kind string, found_text string").distinct()


def redact_personal(df: DataFrame, lexicon: DataFrame, key: str = "id", text: str = "content") -> DataFrame:
    """(key, text, found): the text with placeholders and the number of replaced spans; null texts stay null."""
    names = _lexicon_rows(lexicon)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex, w = Lexicon(names), weights()
        for p in parts:
            out, n = [], []
            for t in p["text"].tolist():
                found = find(t, lex, w) if t else []
                out.append(redact(t, found) if found else t)
                n.append(len(found))
            yield pd.DataFrame({key: p["key"], text: out, "found": n})

    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"{key} long, {text} string, found long")


def partition(spans: list[Span], w: dict[str, float]) -> tuple[float, list[float]]:
    """Log of the summed weight of all segmentations, and the marginal of each span (for training)."""
    order = sorted(range(len(spans)), key=lambda i: spans[i].end)
    score = [sum(w.get(f, 0.0) for f in spans[i].features) for i in order]
    ends = [spans[i].end for i in order]
    n = len(order)
    fwd = [0.0] * (n + 1)
    prev = [bisect_right(ends, spans[i].start, 0, k) for k, i in enumerate(order)]

    def add(a: float, b: float) -> float:
        hi, lo = (a, b) if a > b else (b, a)
        return hi + math.log1p(math.exp(lo - hi))

    for k in range(n):
        fwd[k + 1] = add(fwd[k], fwd[prev[k]] + score[k])
    # backward over starts, mirrored
    back_order = sorted(range(n), key=lambda k: -spans[order[k]].start)
    starts = [-spans[order[k]].start for k in back_order]
    bwd = [0.0] * (n + 1)
    nxt = [bisect_right(starts, -spans[order[k]].end, 0, i) for i, k in enumerate(back_order)]
    for i, k in enumerate(back_order):
        bwd[i + 1] = add(bwd[i], bwd[nxt[i]] + score[k])
    z = fwd[n]
    marginal = [0.0] * len(spans)
    for i, k in enumerate(back_order):
        marginal[order[k]] = math.exp(min(0.0, fwd[prev[k]] + score[k] + bwd[nxt[i]] - z))
    return z, marginal
