"""Personal information in free text: found, and replaced by typed placeholders that keep equal values linked.

Items are e-mail addresses (disguised ones too), numbers by which a state identifies a person, phone numbers, street
addresses and names (a family name with a given name or a title). Detection reads the whole text: candidates are the
digit groups, at-signs, titles, given names and pairs of capitalised words; each is then matched by a pattern anchored
there. Numbers of orders, tickets, builds and devices fail those patterns. Two capitalised words are a name where the
sentence says so ("my colleague …", "regards, …", "… called"). From such places ``learn_given`` reads the corpus' own given
names: a first word that is met there before LEARN different family names. They join the seeds and are found everywhere
else, written in any case, so recall does not hang on a list. However many are learned, all count: as a set on the workers,
or, beyond SEND, each text with those that stand in it (``with_learned``).

Placeholders are ``[kind:pseudonym]``. Numbers are permuted within their format by a keyed Feistel network: digits stay
digits, separators, prefixes and letters stay in place, dates inside numbers stay dates, and check digits are made valid
again where the format has them (personnummer, DNI and NIE, Steuer-ID, CPF, NIR, Aadhaar; SSN and North American phone
numbers stay within their valid ranges). The permutation depends on the key and the value alone, so equal values get equal pseudonyms in all documents, different
ones different ones, and ``reidentify_digits`` undoes it for the holder of the key. Mail addresses, names and addresses
get a keyed digest of their normalised form.

Defined results: null stays null and has no items, an empty text stays empty; items that would overlap count once, in
the order mail, id number, phone, address, name; earlier placeholders such as ``[redacted:email]`` are left alone.
"""

from __future__ import annotations

import bisect
import datetime as dt
import hashlib
import itertools
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.runtime import BROADCAST_BYTES, written

KINDS = ("email", "id_number", "phone", "address", "name")

# Seeds: some given names in common use; the corpus adds its own (learn_given).
GIVEN = set("""
adam agnes ahmed aisha alan alejandro alex ali alice amadou amina amir amy ana andrea andreas andrew anita anna anne anouk antonio arjun
aurélie beatriz ben benoît bertil bjørn björn carla carlos carmen caroline chiamaka chloé christian claire claudia conall daniel daria dario
david deepak diego dmitri elena elin elisa elspeth emily emma erik eva farid fatima felix fernando florian francesca franck gabriel george
giulia grace greta hannah hans helen helena henrike hiro hugo ibrahim ines ingrid isabel ivan ivo jack jakob james jan jane javier jean
jens joanna johan john jonas jorge josé juan julia jürgen kamal karin kate katja kenji kofi kwame lars laura lea leila leokadia lena linda
louis lucas lucía ludmila luis magnus malik manuel marc marco maren maria marie marta martin mary mateo matteo max mehmet mei michael miguel
mohamed nadia natalia nicolas nina noor odile olga olivia omar oscar osman pablo paolo patrick paul pavel pedro peter petra pierre priya
rachel rafe raj rasmus robert rosa samir sandra sara sergio silvio sofia solveig stefan sunniva susan sven tamsin thomas tilda tomás ursula
valentina vera viktor wei william ximena yasmin yuki yusuf zoltan zoé étienne élodie
""".split())
# Titles before a family name.
TITLES = set("mr mrs ms mx dr prof herr frau mme mlle monsieur madame señora señor señorita sra sr signor signora".split())
# Function words and openings of sentences: they follow a name, or stand before one, without being part of it.
NOT_FAMILY = set("""
about after again and are ask asked at back because before both but by call called can could dear did does for from gives good got gruß had has
hallo have hello her here hey hi him his how into its just let lost maybe never next not now often once one only our over please regards said
saw says she should since still thanks that the their then there they this today told two und until very was were what when where which who
will with would wrote you your reach contact write mail send either ping call antwort rückruf joignable lieferung escribidme please cc signed
bitte der die das mit von aus bei nicht avec pour dans les des est pas con para por los las que una está
the since every neither either not these those more most less new old north south east west upper lower main mr mrs ms
""".split())

_EMAIL_AT = re.compile(r"(?<![\w.+-])[\w][\w.+'-]{0,63}@[\w-]+(?:\.[\w-]+)+", re.UNICODE)
_EMAIL_HIDDEN = re.compile(
    r"(?<![\w.+-])[\w][\w.+-]{0,63}\s?(?:[\[({<]\s?(?:at|@|arroba|ät|chez)\s?[\])}>]\s?[\w-]+(?:(?:\.|\s?[\[({<]\s?(?:dot|punto|punkt|point)\s?[\])}>]\s?|\sdot\s)[\w-]+)+"
    r"|\s(?:at|arroba|ät)\s[\w-]+(?:\s(?:dot|punto|punkt|point)\s[\w-]+)+|@[\w-]+(?:\s?[\[({<]\s?(?:dot|punto|punkt|point)\s?[\])}>]\s?[\w-]+)+)", re.IGNORECASE)
_HIDDEN_HINT = re.compile(r"[\[({<]\s?(?:at|@|arroba|ät|chez|dot|punto)\s?[\])}>]|\s(?:dot|punto|punkt)\s", re.IGNORECASE)

_DIGITS = re.compile(r"\d(?:[ \t]?[().‑/+-]{0,2}[ \t]?\(?\d+\)?)*")
_LABEL = re.compile(
    r"(?:\b(?:ssn|social security(?: number| no\.?)?|ni(?: number| no\.?)|nino|national insurance(?: number| no\.?)?|passport(?: number| no\.?)?|reisepass(?:nummer)?|pasaporte|passeport"
    r"|driv(?:ing|er'?’?s?) licen[cs]e(?: number| no\.?)?|führerschein(?:nummer)?|permis(?: de conduire)?|tax id|tin|steuer-?(?:id|nummer)|idnr\.?|personnummer|national id|id card|identity card|ausweis(?:nummer)?"
    r"|dni|nie|nif|cpf|aadhaar|pan|insee|nir|numéro de sécurité sociale|sozialversicherungsnummer|my number|tfn|medicare)\b\.?)\s?(?:nr\.?|no\.?|number|n[.º°]+)?\s?[:#]?\s?([A-Za-z]{0,3}[ -]?)?$", re.IGNORECASE)
_SSN = re.compile(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])")
_NINO = re.compile(r"(?<!\w)(?:QQ|[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]) ?(\d{2} ?\d{2} ?\d{2}) ?[A-D](?!\w)", re.IGNORECASE)
_DNI = re.compile(r"(?<![\w-])(?:[XYZ]-?\d{7}|\d{8})-?[A-Z](?!\w)", re.IGNORECASE)
_PERSONNUMMER = re.compile(r"(?:\d\d)?\d{6}[-+]\d{4}(?![\w-])")
_STEUER = re.compile(r"[1-9]\d ?\d{3} ?\d{3} ?\d{3}(?![\w-])")
_LICENCE = re.compile(r"(?<!\w)[A-Z]\d{3}-\d{4}-\d{2}(?![\w-])", re.IGNORECASE)
_CPF = re.compile(r"\d{3}\.\d{3}\.\d{3}-\d{2}(?![\w-])")
_NIR = re.compile(r"[12] ?\d{2} ?(?:0[1-9]|1[0-2]) ?\d{2} ?\d{3} ?\d{3}(?: ?\d{2})?(?![\w-])")
_VALUE = re.compile(r"[A-Za-z]{0,3}[ -]?\d[\dA-Za-z]*(?:[ ./-]\d[\dA-Za-z]*){0,5}(?:[ -]?[A-Za-z](?!\w))?")

_EXT = r"(?:,? ?(?:ext\.?|x|durchwahl|poste|int\.?) ?\d{1,5})?"
_PHONE = re.compile(
    r"(?:\+\d{1,3}(?:[ ./-]?\(0?\d{0,4}\))?(?:[ ./-]?\d{1,8}){1,6}"
    r"|00[1-9]\d{0,2}(?:[ ./-]?\(0?\d{0,4}\))?(?:[ ./-]\d{1,8}){1,6}"
    r"|\(0\d{1,5}\)[ ./-]?\d{2,8}(?:[ -]\d{2,8}){0,3}"
    r"|\([2-9]\d{2}\)[ .-]?\d{3}[ .-]\d{4}"
    r"|[2-9]\d{2}([.-])\d{3}\1\d{4}"
    r"|0\d{1,4}[ /-]\d{2,8}(?:[ -]\d{2,8}){0,4}"
    r"|0\d(?:\.\d\d){4})" + _EXT + r"(?![\w/-]|\.\d)", re.IGNORECASE)
_CALL = re.compile(r"(?:\b(?:tel|telephone|phone|mobile|cell|fax|call (?:me|us) (?:on|at)|ring me on|reach me on|rückruf unter|telefon|handy|mobil|joignable au|tél|téléphone|llamadme al|teléfono|móvil)\b\.?:?\s?)$", re.IGNORECASE)
_BARE = re.compile(r"\d{9,11}(?![\w/-]|\.\d)")
_NO_PHONE = re.compile(r"(?:\b(?:ticket|order|invoice|serial|ref|build|version|asset|part|account|case|no|nr|number)\b\.?:?\s?#?|[A-Za-z]|\d[./-]|[#_=])$", re.IGNORECASE)

_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’-]*"
_TOWN = rf"(?:,? \d{{4,5}}(?!\d)(?: {_CAP})?)?(?:, (?:\d{{4,5}} )?(?!(?:Phone|PHONE|Tel|TEL|Reach|Call|My)\b){_CAP}(?: (?:{_CAP}))?(?:,? \d{{4,5}}(?!\d))?)?"
_STREET_EN = "street|st|lane|ln|road|rd|avenue|ave|court|ct|boulevard|blvd|drive|dr|terrace|row|close|way|place|square|crescent|gardens|mews|parade|grove|walk|quay|highway|parkway"
_ADDRESS_AFTER = re.compile(  # the house number comes first
    rf"\d{{1,4}}(?:[a-z]|[ -]?(?:bis|ter))?,? (?:(?:(?!(?:of|the|in|a|an|and|at|on|to|is|was|for|with|or|by|than|that|our)\b)[^\W\d][\w'’-]* ){{1,3}}?(?:{_STREET_EN})\b(?:(?<=\bst)\.|(?<=\brd)\.|(?<=\bln)\.|(?<=\bct)\.|(?<=\bdr)\.|(?<=\bave)\.|(?<=\bblvd)\.)?"
    r"|(?:rue|avenue|chemin|impasse|boulevard|allée|quai|place|cours|route|square|passage|sentier) (?:de la |de l['’]|du |des |de |d['’]|l['’])?[\w'’-]+(?:[ -](?!(?:now|instead|on|is|and|for)\b)[A-ZÀ-Þ][\w'’-]*){0,3})", re.IGNORECASE)
_ADDRESS_BEFORE = re.compile(  # the house number comes last
    r"(?:(?<!\w)(?:[\wäöüß-]{2,}(?:straße|strasse|str\.|gasse|weg|platz|allee|damm|ufer)|(?!spring\b|during\b|string\b|bring\b)[\wäöüß-]{3,}ring|[\wäöüß-]+ (?:straße|strasse|str\.|gasse|weg|platz|allee))"
    r"|\b(?:calle|c/|avenida|avda\.?|camino|plaza|paseo|ronda|travesía|carretera|callejón) (?:de las? |de los |del |de )?[\w'’-]+(?: [\w'’-]+){0,3}?,?(?: n\.?[º°])?"
    r"|\b(?:am|an der|an den|im|in der|zum|zur|auf der|auf dem|unter den|hinter der) [\wäöüß-]+(?: [\wäöüß-]+){0,2}) $", re.IGNORECASE)
_PREPOSITION_DE = re.compile(r"(?:^|.*[^\w])(?:am|an der|an den|im|in der|zum|zur|auf der|auf dem|unter den|hinter der) [\wäöüß-]+(?: [\wäöüß-]+){0,2} $", re.IGNORECASE | re.DOTALL)
_STREET_DE = re.compile(r"(?:straße|strasse|str\.|gasse|weg|platz|allee|damm|ufer|ring) $", re.IGNORECASE)
_ZIP_TOWN = re.compile(rf",? \d{{4,5}} {_CAP}")
_FLAT_BEFORE = re.compile(r"(?:\b(?:apt|apartment|flat|unit|suite|no)\.? ?\w{1,5}, )$", re.IGNORECASE)
_FLAT_AFTER = re.compile(r"(?:,? \d{1,2}\.?[º°ª]?\.? ?[A-Za-z]?\b(?=,|\s|\.|$))?")
_TOWN_RE = re.compile(_TOWN)
_FLOOR = re.compile(r",? \d{1,2}\.?[º°ª] ?[A-Za-z]?\b")

_WORD = re.compile(r"[^\W\d_]+")
_NUMBER = re.compile(r"\d+")
_TITLE_WORDS = frozenset(TITLES)
_FAMILY = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?(?:-[^\W\d_]+)*")


class _Spans:
    """Disjoint spans in order: whether a new one overlaps any is a binary search."""

    def __init__(self, spans: list[tuple[int, int]] = ()) -> None:
        self.all = sorted(spans)

    def free(self, s: int, e: int) -> bool:
        k = bisect.bisect_left(self.all, (s, e))
        return not (k and self.all[k - 1][1] > s) and not (k < len(self.all) and self.all[k][0] < e)

    def add(self, s: int, e: int) -> None:
        bisect.insort(self.all, (s, e))


def _id_at(text: str, s: int, e: int) -> tuple[int, int] | None:
    """The id number whose digits begin at s."""
    before = text[s - 1] if s else " "
    if before.isdigit() or before in "./":
        return None
    if m := _SSN.match(text, s):
        return (s, m.end()) if before not in "-" and not before.isalnum() else None
    for start in (s - 2, s - 3):
        if start >= 0 and (m := _NINO.match(text, start)) and m.start(1) == s:
            return start, m.end()
    for start in (s, s - 1, s - 2):
        if start >= 0 and (m := _DNI.match(text, start)) and m.end() > s + 6:
            return start, m.end()
    if (m := _LICENCE.match(text, s - 1)) and s:
        return s - 1, m.end()
    if before not in "-" and not before.isalnum():
        if (m := _PERSONNUMMER.match(text, s)) and 1 <= int(m[0].replace("+", "-").split("-")[0][-4:-2]) <= 12 and 1 <= int(m[0].replace("+", "-").split("-")[0][-2:]) <= 31:
            return s, m.end()
        if m := _CPF.match(text, s):
            return s, m.end()
        if (m := _STEUER.match(text, s)) and m[0].count(" ") == 3 and steuer_digit(re.sub(r"\D", "", m[0])[:10]) == m[0][-1]:
            return s, m.end()
        if (m := _NIR.match(text, s)) and m[0].count(" ") >= 5:
            return s, m.end()
    if label := _LABEL.search(text, max(0, s - 48), s):
        start = label.start(1) if label.group(1) else s
        m = _VALUE.match(text, start)
        if m and sum(c.isdigit() for c in m[0]) >= 6:
            return start, m.end()
    return None


def _phone_at(text: str, s: int) -> tuple[int, int] | None:
    start = s
    while start and text[start - 1] in "+(":
        start -= 1
    if _NO_PHONE.search(text, max(0, start - 12), start) and not _CALL.search(text, max(0, start - 24), start):
        return None
    m = _PHONE.match(text, start)
    if m:
        n = sum(c.isdigit() for c in re.sub(r"(?i)(ext|x|durchwahl|poste|int).*", "", m[0]))
        lead = m[0][0]
        if 8 <= n <= 15 and not (lead == "0" and n < 9 and m[0][:2] != "00"):
            return start, m.end()
    if (m := _BARE.match(text, s)) and _CALL.search(text, max(0, s - 24), s):
        return s, m.end()
    return None


def _address_at(text: str, s: int, e: int) -> tuple[int, int] | None:
    """The address whose house number is the digits from s to e."""
    if e - s > 4 or (s and (text[s - 1].isalnum() or text[s - 1] in "-./#")):
        return None
    if m := _ADDRESS_AFTER.match(text, s):
        end = m.end()
        end = _TOWN_RE.match(text, end).end()
        flat = _FLAT_BEFORE.search(text, max(0, s - 24), s)
        return (flat.start() if flat else s), end
    head = text[max(0, s - 60):s]
    if head.endswith(" ") and (m := _ADDRESS_BEFORE.search(head)):
        end = e + 1 if e < len(text) and text[e].isalpha() and not text[e + 1:e + 2].isalnum() else e
        if end < len(text) and text[end].isalnum():
            return None
        if _PREPOSITION_DE.match(m[0]) and not _STREET_DE.search(m[0]) and not _ZIP_TOWN.match(text, end):
            return None
        if f := _FLOOR.match(text, end):
            end = f.end()
        end = _TOWN_RE.match(text, end).end()
        return s - len(head) + m.start(), end
    return None


def _same_case(a: str, b: str) -> bool:
    """A family name may follow a given name written the same way: Title Title, lower lower, UPPER UPPER."""
    if a.islower():
        return b.islower()
    return b[:1].isupper()


def _family(text: str, at: int, like: str, given: frozenset[str] | set[str] = GIVEN) -> int | None:
    """End of a family name at this place."""
    m = _FAMILY.match(text, at)
    if not m or len(m[0]) < 3 or m[0].lower() in NOT_FAMILY or m[0].lower() in given or not _same_case(like, m[0]):
        return None
    if m.end() < len(text) and (text[m.end()] in "@_" or text[m.end()].isdigit()):
        return None
    if text[m.end():m.end() + 1] == "'" and text[m.end() + 1:m.end() + 2].isalpha():
        return None
    return m.end()


_INITIAL = re.compile(r" (?:[^\W\d_]\. ?)?")
_TITLE_GAP = re.compile(r"\.? ")
_COMMA_GIVEN = re.compile(r"((?:[^\W\d_]+['’])?[^\W\d_]+(?:-[^\W\d_]+)*), $")


_BEFORE = re.compile(
    r"(?:\b(?:colleagues?|coworker|kolleg(?:e|in|en)|coll[èe]gue|compañer[oa]|spoke (?:to|with)|talked (?:to|with)|speak (?:to|with)|ask for|asked for|named|this is|hier ist|ici|soy|i am|i[’']m"
    r"|name is|name ist|m[’']appelle|me llamo|ich heiße|contact (?:person )?is|ansprechpartner(?:in)? ist|attn\.?|attention)\s"
    r"|\b(?:regards|sincerely|cheers|greetings|grüße|gruß|grüßen|saludos|cordialement|atentamente|signed|signé|firmado|gez\.?|contact|ansprechpartner(?:in)?|name|reported by|written by)[,:]?\s{1,3})$", re.IGNORECASE)
_AFTER = re.compile(r" (?:saw|said|says|called|reported|wrote|writes|told|asked|noticed|confirmed|complained|phoned|replied|mentioned|explained|thinks|insists|admitted|sagte|schrieb|meldete|dijo|escribió|écrit|signale)\b| here(?=[.,!]|$)")
_SHOUTED_BEFORE = re.compile(r"(?<!\w)[A-ZÀ-ÖØ-Þ]{2,}[,:]?\s$")
_SHOUTED_AFTER = re.compile(r",? [A-ZÀ-ÖØ-Þ]{2,}(?!\w)")
_ARTICLE = re.compile(r"(?<!\w)(?:the|our|your|my|its|their|this|that|an?|der|die|das|des|dem|unser|unsere|le|la|les|un|une|notre|el|los|las|nuestro|nuestra)\s$", re.IGNORECASE)
_PAIR = re.compile(rf"(?<![\w.@'’-])(?=({_CAP})(?: [^\W\d_]\.)? ({_CAP}))")


def _stated(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, first, family) of capitalised pairs where the sentence says that a person is meant."""
    for m in _PAIR.finditer(text):
        first, family = m[1], m[2]
        s, e = m.start(), m.end(2)
        if len(first) < 2 or len(family) < 3 or "_" in first + family or any(c.isdigit() for c in first + family) or first.lower() in NOT_FAMILY or family.lower() in NOT_FAMILY or first.lower() in TITLES:
            continue
        if text[e:e + 1] in ("@", "_") or (text[e - 1:e] in "'’-"):
            continue
        if first.isupper() != family.isupper() or (first.isupper() and (_SHOUTED_BEFORE.search(text, max(0, s - 24), s) or _SHOUTED_AFTER.match(text, e))):
            continue  # in a text in capitals no two words stand out
        if (_AFTER.match(text, e) and not _ARTICLE.search(text, max(0, s - 8), s)) or _BEFORE.search(text, max(0, s - 32), s):
            yield s, e, first.lower(), family.lower()


def _names(text: str, taken: _Spans, given: frozenset[str] | set[str] = GIVEN) -> list[tuple[int, int]]:
    out = _Spans()
    if not (_TITLE_WORDS.isdisjoint(words := set(_WORD.findall(text.lower()))) and given.isdisjoint(words)):
        for span in _listed(text, given):
            if out.free(*span):
                out.add(*span)
    for s, e, *_ in _stated(text):
        if out.free(s, e):
            out.add(s, e)
    return [x for x in out.all if taken.free(*x)]


def _listed(text: str, given: frozenset[str] | set[str]) -> Iterator[tuple[int, int]]:
    """Names with a title or a known given name."""
    last = 0
    for m in _WORD.finditer(text):
        w = m[0]
        low = w.lower()
        s, e = m.span()
        if low in TITLES:
            if s and (text[s - 1].isalnum() or text[s - 1] in "@.'’-"):
                continue
            g = _TITLE_GAP.match(text, e)
            if not g:
                continue
            at = g.end()
            first = _WORD.match(text, at)
            if first and first[0].lower() in given and (i := _INITIAL.match(text, first.end())) and (end := _family(text, i.end(), first[0], given)):
                last = end
                yield s, end
            elif end := _family(text, at, "A" if w[0].isupper() else "a", given):
                last = end
                yield s, end
            continue
        if low not in given or (s and (text[s - 1].isalnum() or text[s - 1] in "@_.+'’-")) or text[e:e + 1] in ("@", "_", "+") or text[e:e + 1].isdigit():
            continue
        if not (w.islower() or w[0].isupper()) or s < last:
            continue
        head = text[max(0, s - 40):s]
        if (f := _COMMA_GIVEN.search(head)) and f[1].lower() not in NOT_FAMILY and f[1].lower() not in given and len(f[1]) >= 3 and _same_case(w, f[1]) and (w.islower() == f[1].islower()):
            start = s - len(head) + f.start()
            if not (start and (text[start - 1].isalnum() or text[start - 1] in "@.")) and start >= last:
                last = e
                yield start, e
                continue
        i = _INITIAL.match(text, e)
        if i and (end := _family(text, i.end(), w, given)):
            last = end
            yield s, end


def _looked_up(text: str) -> set[str]:
    """Every word of a text that find_items may look up among the given names, but for the seeds."""
    words = set(_WORD.findall(text.lower()))
    if not text.isascii():  # a letter's lower case may depend on its neighbours
        words.update(w.lower() for w in _WORD.findall(text))
    if "'" in text or "-" in text or "’" in text:
        words.update(_FAMILY.match(text, m.start())[0].lower() for m in _WORD.finditer(text))
    return words - GIVEN


def find_items(text: str, given: frozenset[str] | set[str] = GIVEN) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every item, by position. given: the given names known."""
    found: list[tuple[str, int, int]] = []
    spans = _Spans()

    def take(kind: str, s: int, e: int) -> None:
        if spans.free(s, e):
            found.append((kind, s, e))
            spans.add(s, e)

    if "@" in text:
        for m in _EMAIL_AT.finditer(text):
            take("email", *m.span())
    if _HIDDEN_HINT.search(text):
        for m in _EMAIL_HIDDEN.finditer(text):
            take("email", *m.span())
    groups = [m.span() for m in _DIGITS.finditer(text)]
    wide = [g for g in groups if g[1] - g[0] >= 6]
    for s, e in wide:
        if x := _id_at(text, s, e):
            take("id_number", *x)
    for s, e in wide:
        at = s
        while at < e:
            x = _phone_at(text, at)
            if x and spans.free(*x):
                take("phone", *x)
                at = x[1]
            while at < e and text[at].isdigit():
                at += 1
            while at < e and not text[at].isdigit():
                at += 1
    for s, e in groups:
        for m in _NUMBER.finditer(text, s, e):
            if m.end() - m.start() <= 4 and spans.free(m.start(), m.end()) and (x := _address_at(text, *m.span())):
                take("address", *x)
    for s, e in _names(text, spans, given):
        take("name", s, e)
    return sorted(found, key=lambda x: x[1])


# --- pseudonyms -----------------------------------------------------------------------------------------------------


def _round(key: bytes, tweak: str, i: int, value: int, modulus: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{tweak}|{i}|{value}".encode(), key=key, digest_size=16).digest(), "big") % modulus


ROUNDS = 10


def feistel(key: bytes, tweak: str, value: int, modulus_a: int, modulus_b: int, back: bool = False) -> int:
    """A keyed permutation of 0 … modulus_a * modulus_b - 1: alternating additive rounds on the two halves."""
    a, b = divmod(value, modulus_b)
    for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
        sign = -1 if back else 1
        if i % 2 == 0:
            a = (a + sign * _round(key, tweak, i, b, modulus_a)) % modulus_a
        else:
            b = (b + sign * _round(key, tweak, i, a, modulus_b)) % modulus_b
    return a * modulus_b + b


def permute_digits(key: bytes, tweak: str, digits: str, back: bool = False) -> str:
    n = len(digits)
    if n == 0:
        return digits
    return f"{feistel(key, f'{tweak}{n}', int(digits), 10 ** (n // 2), 10 ** (n - n // 2), back):0{n}d}"


def _walk(key: bytes, tweak: str, digits: str, valid) -> str:
    """Permute until the value is valid again: still a permutation of the valid values."""
    while True:
        digits = permute_digits(key, tweak, digits)
        if valid(digits):
            return digits


def luhn_digit(digits: str) -> str:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        v = int(ch) * (2 if k % 2 == 0 else 1)
        total += v - 9 * (v > 9)
    return str(-total % 10)


def steuer_digit(digits: str) -> str:
    p = 10
    for ch in digits:
        x = (int(ch) + p) % 10 or 10
        p = x * 2 % 11
    return str((11 - p) % 10)


_DAY0 = dt.date(1900, 1, 1).toordinal()
_DAYS = 36_524  # days of a century whose years are written with two digits


def permute_date(key: bytes, yymmdd: str) -> str:
    """Another date of the same century, or the digits permuted if they are no date."""
    try:
        day = dt.date(1900 + int(yymmdd[:2]), int(yymmdd[2:4]), int(yymmdd[4:6])).toordinal() - _DAY0
    except ValueError:
        return permute_digits(key, "nodate", yymmdd)
    while True:
        day = feistel(key, "date", day, 191, 192)
        if day < _DAYS:
            return dt.date.fromordinal(_DAY0 + day).strftime("%y%m%d")


def cpf_digits(digits: str) -> str:
    """The two check digits of nine."""
    for _ in range(2):
        r = sum(int(c) * (len(digits) + 1 - k) for k, c in enumerate(digits)) % 11
        digits += str(0 if r < 2 else 11 - r)
    return digits[9:]


def nir_key(digits: str) -> str:
    return f"{97 - int(digits) % 97:02d}"


def verhoeff_digit(digits: str) -> str:
    """The check digit of the dihedral group of ten: rotations 0 to 4, reflections 5 to 9."""
    def times(a: int, b: int) -> int:
        return (a + b) % 5 if a < 5 and b < 5 else (a + b - 5) % 5 + 5 if a < 5 else (a - b) % 5 + 5 if b < 5 else (a - b) % 5

    swap = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    total = 0
    for k, ch in enumerate(reversed(digits)):
        v = int(ch)
        for _ in range((k + 1) % 8):
            v = swap[v]
        total = times(total, v)
    return str(next(d for d in range(10) if times(total, d) == 0))


def _north_american(d: str) -> bool:
    return d[0] in "23456789" and d[1] != "9" and d[1:3] != "11" and d[3] in "23456789" and d[4:6] != "11"


def _refill(text: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in text)


def pseudonym(kind: str, value: str, key: bytes) -> str:
    digits = "".join(c for c in value if c.isdigit())
    if kind == "phone":
        m = re.match(r"(?:\+|00)\d{1,3}(?=\D)|0", value)
        lead = sum(c.isdigit() for c in m[0]) if m else 0
        code = 0 if not lead or value[0] == "0" and digits[:2] != "00" else 1 if digits[lead - 1] == "1" and digits[:lead].lstrip("0") == "1" else -1
        if code >= 0 and (lead == 0 or code) and len(digits) - lead >= 10 and _north_american(digits[lead:lead + 10]):
            rest = digits[lead + 10:]
            return _refill(value, digits[:lead] + _walk(key, "nanp", digits[lead:lead + 10], _north_american) + permute_digits(key, "extension", rest))
        return _refill(value, digits[:lead] + permute_digits(key, "phone", digits[lead:]))
    if kind == "id_number":
        if _PERSONNUMMER.fullmatch(value):
            new = permute_date(key, digits[-10:-4]) + permute_digits(key, "serial", digits[-4:-1])
            return _refill(value, digits[:-10] + new + (luhn_digit(new) if luhn_digit(digits[-10:-1]) == digits[-1] else permute_digits(key, "check", digits[-1])))
        if _DNI.fullmatch(value) and digits:
            new = permute_digits(key, "dni", digits)
            letters = "TRWAGMYFPDXBNJZSQVHLCKE"
            lead = {"X": "0", "Y": "1", "Z": "2"}.get(value[0].upper(), "")
            last = letters[int(lead + new) % 23]
            return _refill(value, new)[:-1] + (last if value[-1].isupper() else last.lower())
        if _SSN.fullmatch(value):
            return _refill(value, _walk(key, "ssn", digits, lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"))
        if _STEUER.fullmatch(value) and steuer_digit(digits[:10]) == digits[10]:
            new = permute_digits(key, "steuer", digits[:10])
            return _refill(value, new + steuer_digit(new))
        if _CPF.fullmatch(value) and cpf_digits(digits[:9]) == digits[9:]:
            new = permute_digits(key, "cpf", digits[:9])
            return _refill(value, new + cpf_digits(new))
        if _NIR.fullmatch(value):
            month = feistel(key, "nirmonth", int(digits[3:5]) - 1, 3, 4) + 1
            new = digits[0] + permute_digits(key, "niryear", digits[1:3]) + f"{month:02d}" + permute_digits(key, "nirplace", digits[5:13])
            return _refill(value, new + (nir_key(new) if digits[13:] == nir_key(digits[:13]) else permute_digits(key, "nirkey", digits[13:])))
        if len(digits) == 12 and digits[0] > "1" and verhoeff_digit(digits[:11]) == digits[11]:
            new = _walk(key, "aadhaar", digits[:11], lambda d: d[0] > "1")
            return _refill(value, new + verhoeff_digit(new))
        return _refill(value, permute_digits(key, "id", digits))
    plain = re.sub(r"\s*[\[({<]\s?(?:at|ät|arroba)\s?[\])}>]\s*", "@", value.lower()) if kind == "email" else value.lower()
    plain = re.sub(r"\s*[\[({<]\s?(?:dot|punto|punkt)\s?[\])}>]\s*", ".", plain)
    return hashlib.blake2b(re.sub(r"\s+", " ", plain).encode(), key=key, digest_size=6).hexdigest()


def reidentify_digits(digits: str, tweak: str, key: bytes) -> str:
    return permute_digits(key, tweak, digits, back=True)


def redact(text: str, key: bytes, given: frozenset[str] | set[str] = GIVEN) -> str:
    out, at = [], 0
    for kind, s, e in find_items(text, given):
        out += [text[at:s], f"[{kind}:{pseudonym(kind, text[s:e], key)}]"]
        at = e
    return "".join(out) + text[at:]


# --- DataFrame operators --------------------------------------------------------------------------------------------

#: Different family names a word must be stated with to be learned as a given name.
LEARN = 3
#: Up to this many learned names (and BROADCAST_BYTES) go to the workers as a set; more are joined to the texts.
SEND = 500_000
#: Most bits of the map that says which words may be learned names.
MAP_BITS = 1 << 29

Given = frozenset[str] | set[str] | DataFrame


def learn_given(df: DataFrame, text: str) -> frozenset[str] | DataFrame:
    """The seeds and the given names the corpus states itself, from counts over all its texts.

    Where the learned names are too many for a set: a table (first) of them all, which items and with_redacted take as well.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            met = {(first, family) for t in pdf["t"] if isinstance(t, str) for _, _, first, family in _stated(t)}
            yield pd.DataFrame(sorted(met), columns=["first", "family"], dtype=object)

    pairs = df.select(F.col(text).alias("t")).mapInPandas(run, "first string, family string").distinct()
    learned = written(pairs.groupBy("first").agg(F.count("*").alias("n")).filter(F.col("n") >= LEARN).select("first"), "pii-given")
    n, size = learned.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("first")), F.lit(0))).head()
    if n > SEND or size > BROADCAST_BYTES:
        return learned
    return frozenset(GIVEN | {r["first"] for r in learned.toLocalIterator()})


def _bit_map(learned: DataFrame) -> bytes:
    """A bit for the CRC of each name: a word whose bit is not set is none of them. Its size is a power of two and bounded."""
    bits = min(MAP_BITS, 1 << (32 * learned.count()).bit_length())
    out = bytearray(bits // 8)
    for r in learned.select(F.crc32(F.col("first").cast("binary")).alias("crc")).toLocalIterator():
        at = r["crc"] & (bits - 1)
        out[at >> 3] |= 1 << (at & 7)
    return bytes(out)


def with_learned(df: DataFrame, text: str, learned: DataFrame) -> DataFrame:
    """df with _given: the learned names among the words of its text, null if there are none; find_items looks up no others.

    Words that the bit map lets pass are joined with the names, and the names of a text with its rows by the text's SHA-256.
    The map only thins the join out, so the result is exact for any number of names.
    """
    bits = _bit_map(learned)
    last = len(bits) * 8 - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, words = [], []
            for k, t in zip(pdf["_key"], pdf["_text"]):
                if not isinstance(t, str):
                    continue
                for w in _looked_up(t):
                    at = zlib.crc32(w.encode()) & last
                    if bits[at >> 3] >> (at & 7) & 1:
                        keys.append(k)
                        words.append(w)
            yield pd.DataFrame({"_key": pd.Series(keys, dtype=object), "first": pd.Series(words, dtype=object)})

    key = F.unhex(F.sha2(F.col(text).cast("binary"), 256)).alias("_key")
    words = df.select(key, F.col(text).alias("_text")).mapInPandas(run, "_key binary, first string")
    names = words.join(learned.hint("merge"), "first", "left_semi").groupBy("_key").agg(F.collect_set("first").alias("_given"))
    return df.select("*", key).join(names, "_key", "left").drop("_key")


def _known(names: Iterable) -> Iterator[set[str]]:
    """The given names to look up in each text: the seeds and those of with_learned."""
    return (GIVEN if x is None else GIVEN.union(x) for x in names)


def redacted(text: Column, key: bytes, given: frozenset[str] | set[str] = GIVEN) -> Column:
    """The text with placeholders; Arrow-batched."""
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redact(t, key, given) if isinstance(t, str) else None)

    return F.pandas_udf(run, "string")(text)


def with_redacted(df: DataFrame, text: str, key: bytes, given: Given = GIVEN) -> DataFrame:
    """df with a column redacted: the text with placeholders."""
    if not isinstance(given, DataFrame):
        return df.withColumn("redacted", redacted(F.col(text), key, given))

    def run(texts: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([redact(t, key, g) if isinstance(t, str) else None for t, g in zip(texts, _known(names))], dtype=object)

    return with_learned(df, text, given).withColumn("redacted", F.pandas_udf(run, "string")(F.col(text), F.col("_given"))).drop("_given")


def items(df: DataFrame, ids: list[str], text: str, key: bytes, given: Given = GIVEN) -> DataFrame:
    """(*ids, pii_kind, nth, pseudonym): one row per item, with what the redacted text has in its place.

    With a set of given names a narrow map: no shuffle, whatever the skew. With a table of them the texts are joined once.
    """
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in ids) + ", pii_kind string, nth int, pseudonym string"
    df = df.select(*ids, text)
    fixed = given
    if isinstance(given, DataFrame):
        df, fixed = with_learned(df, text, given), None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, kinds, nths, names = [], [], [], []
            for i, (t, known) in enumerate(zip(pdf[text], itertools.repeat(fixed) if fixed is not None else _known(pdf["_given"]))):
                if not isinstance(t, str) or not t:
                    continue
                seen: dict[str, int] = {}
                for kind, s, e in find_items(t, known):
                    seen[kind] = seen.get(kind, 0) + 1
                    rows.append(i)
                    kinds.append(kind)
                    nths.append(seen[kind])
                    names.append(pseudonym(kind, t[s:e], key))
            at = np.array(rows, dtype=np.int64)
            plain = {c: pd.Series(pdf[c].to_numpy(object)[at], dtype=object) for c in ids}
            yield pd.DataFrame(plain | {"pii_kind": pd.Series(kinds, dtype=object), "nth": pd.Series(nths, dtype="int32"), "pseudonym": pd.Series(names, dtype=object)})

    return df.mapInPandas(run, schema)
