"""Personal information inside free text, by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs and their spelled-out forms, cues of identity numbers, street words and
pairs of digits. At each anchor a deterministic local parser expands to the whole string and validates it. Texts of any length
are read whole. Found spans never overlap: of overlapping ones the higher kind in ``KINDS`` wins, then the longer.

Persons are found by structure, not by a list of names: anchors are capitals; runs of capitalised words, words in
capitals and initials are expanded over blanks, particles and one comma. A word takes part unless a vocabulary of a public
tokenizer holds it in lower case as the more frequent piece. Where a sentence may begin, so that a capital tells nothing, two
words that no vocabulary knows need more: a line of their own, an e-mail address made of one of them, or a given name.

Defined results
* Null, empty and blank texts hold nothing and stay as they are.
* ``find`` gives each distinct (kind, text) of a document once; ``replace`` puts ``[KIND]`` in place of each occurrence
  and keeps every other character.
* No surroundings are assumed around a value: it may touch the ends of the text, brackets, quotes or separators.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import spread

KINDS = ("email", "address", "id_number", "phone", "name")

# Given names. They decide only where a sentence begins with two words that no vocabulary knows.
GIVEN = frozenset(
    """
Adam Adrian Adrien Agnes Ahmed Aisha Alain Albert Alejandro Alexander Alexandra Alice Alicia Amélie Ana Andrea Andreas
Anita Anna Anne Anton Antonio Arthur Astrid Barbara Beatriz Benjamin Bernd Bruno Camille Carla Carlos Carmen Caroline
Catherine Charles Charlotte Chiara Christian Christine Clara Claire Claudia Daniel David Diana Diego Dieter Dominik
Eduardo Elena Elisa Elizabeth Emil Emily Emma Eric Erik Eva Fabian Fatima Felix Fernando Florian Francesca Francisco
François Frank Frederik Gabriel Georg George Greta Guillaume Gustav Hannah Hans Heike Helena Henrik Henry Hiroshi Hugo
Ines Inés Ingrid Irene Isabel Ivan Jacob James Jan Javier Jean Jens Johanna John Jonas José Juan Julia Julie Julien
Kai Karl Katrin Kenji Klara Klaus Laura Lars Lena Leïla Lina Louis Louise Lucas Lucía Luis Lukas Maja Malik Manuel
Marek Maria María Marie Mark Marta Martin Mary Mateo Matthias Maximilian Michael Michel Miguel Mohamed Monika Nadia
Natalie Nicolas Nina Noah Noemi Olga Olivia Oscar Pablo Patrick Paul Paula Pedro Peter Petra Philipp Pierre Pieter
Priya Rafael Raúl Ravi Robert Rosa Samuel Sara Sarah Sebastian Simon Sofia Sofía Sophie Stefan Susanne Theo Thomas
Tobias Ursula Valentina Victor Wanda William Wolfgang Yara Yusuf Zoë
""".split()
)
# Titles, which are no part of a name.
TITLES = frozenset("Frau Herr Herrn Dr Prof Mr Mrs Ms Miss Mme Mlle Sr Sra Srta Don Doña Dott Ing Sig".split())
# Words that lead up to an identity number.
ID_CUES = (
    "social security number", "social security no", "ssn", "tax id", "tax number", "national id", "id number", "identity number", "identity card", "passport number", "passport no",
    "identifikationsnummer", "steuer-id", "steuernummer", "ausweisnummer", "personalausweis", "sozialversicherungsnummer", "reisepassnummer",
    "nir", "numéro de sécurité sociale", "sécurité sociale", "numéro d'identité", "numéro fiscal", "dni", "nie", "nif", "número de identidad", "número de identificación", "documento de identidad", "pasaporte",
)
# Words that lead up to a phone number.
PHONE_CUES = (
    "phone", "mobile", "cell", "tel", "fax", "call", "ring", "dial", "pager", "on-call number", "sms", "whatsapp", "telefon", "telefonisch", "rufbereitschaft", "handy", "anrufen", "mobil",
    "guardia", "llamad", "llamar", "teléfono", "móvil", "astreinte", "appelez", "appeler", "téléphone", "portable", "joignable", "bitte",
)
#: A cue as a whole word, at most five words and no other number before the number.
PHONE_LEAD = re.compile(r"(?<!\w)(?:" + "|".join(PHONE_CUES) + r")(?!\w)(?:\W*[^\W\d]+){0,5}\W*$")
# Street words by where they stand. English ones follow the name, the others lead it or end it.
STREET_AFTER = "Street|St\\.|St|Avenue|Ave\\.|Ave|Lane|Ln\\.|Road|Rd\\.|Rd|Drive|Court|Ct\\.|Crescent|Boulevard|Blvd\\.?|Terrace|Close|Square|Parkway|Place|Way|Row|Walk|Mews|Hill|Gardens|Grove"
STREET_FR = "rue|avenue|boulevard|impasse|allée|chemin|place|quai|cours|passage|route|square|ruelle|esplanade|faubourg"
STREET_ES = "Calle|Avenida|Avda\\.|Paseo|Plaza|Camino|Carrera|Ronda|Travesía|Callejón|Carretera|Glorieta|C/"
STREET_DE_END = "straße|strasse|str\\.|weg|allee|gasse|platz|ufer|ring|damm|steig|stieg|pfad|chaussee|graben|markt|hof|wall"
STREET_DE_WORD = "Straße|Strasse|Str\\.|Weg|Allee|Gasse|Platz|Ufer|Damm|Ring|Chaussee"

_U, _L = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĖĘĚĞĢĪĮİŁŃŇŌŐŒŘŚŠŞŢŤŪŮŰŲŸŹŻŽ", "a-zß-öø-ÿāăąćčďđēėęěğģīįıłńňōőœřśšşţťūůűųźżž"
_WORD = rf"(?:[{_U}][{_L}]+(?:[-'’]?[{_U}]?[{_L}]+)*|(?:O|D)['’][{_U}][{_L}]+)"
_CAPS = rf"[{_U}][{_U}ß]+(?:[-'’][{_U}ß]+)*"
_PART = r"(?:(?:de|del|della|di|da|dos|du|la|le|van|von|vom|zu|zur|der|den|ter|ten|el|al|bin|ibn) ){0,3}"
_INIT = rf"[{_U}]\."
#: Pieces of names: words, words in capitals, initials; and what may stand between two of them.
PIECE = re.compile(rf"(?<![\w@.\-/’'])(?:({_WORD})|({_CAPS})|({_INIT}))(?![\w@]|[.\-/]\w)")
GAP = re.compile(rf"[  ]{_PART}|,[  ]")
#: What a name is not followed by where it names a group, a machine or a thing.
GROUPS = re.compile(r"[  ](?:[Tt]eam|[Gg]roup|[Gg]uild|[Ss]quad|[Bb]oard|[Bb]ot|[Ss]ervice|[Oo]ffice|[Ss]treet|[Aa]venue|[Rr]oad|[Ll]ane)\b")
#: Within a sentence: after a word in lower case. Anywhere else a capital may mark a beginning and says nothing about the word.
WITHIN = re.compile(rf"[{_L}]['’)\"]?,?[  ]$")


class Words:
    """What the vocabularies of public tokenizers tell about a word: the earlier piece of the two spellings is the more frequent one."""

    _own: dict[tuple[str, ...], Words] = {}

    @classmethod
    def of(cls, paths: tuple[str, ...]) -> Words:
        if paths not in cls._own:
            cls._own[paths] = cls(paths)
        return cls._own[paths]

    def __init__(self, paths: tuple[str, ...]) -> None:
        self.ranks: list[dict[str, int]] = []
        for path in paths:
            ranks = {}
            with open(path, encoding="ascii") as f:
                for line in f:
                    piece, rank = line.split()
                    raw = base64.b64decode(piece)
                    if raw[:1] == b" ":
                        ranks[raw[1:].decode("utf-8", "replace")] = int(rank)
            self.ranks.append(ranks)
        self.memo: dict[str, str] = {}

    def kind(self, word: str) -> str:
        """common: used in lower case rather than with a capital; proper: the other way; unknown: no vocabulary holds it whole."""
        low = word.lower()
        found = self.memo.get(low)
        if found is None:
            title = low[:1].upper() + low[1:]
            found = "unknown"
            for ranks in self.ranks:
                a, b = ranks.get(low), ranks.get(title)
                if a is not None and (b is None or a < b):
                    found = "common"
                    break
                if b is not None:
                    found = "proper"
            self.memo[low] = found
        return found


def word_vocabularies() -> tuple[str, ...]:
    import public_tokenizers

    return tuple(public_tokenizers.path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"))


EMAIL_PLAIN = re.compile(r"[A-Za-z0-9_](?:[A-Za-z0-9._%+'\-]*[A-Za-z0-9_+\-])?$")
_AT = r"(?:\(at\)|\[at\]|\{at\}|<at>|\(ät\)|\[ät\]|\(a\)|\[a\]|\(arroba\)|\[arroba\]|\(arobase\)|\[arobase\]|＠)"
_DOT = r"(?:\(dot\)|\[dot\]|\{dot\}|<dot>|\(punkt\)|\[punkt\]|\(punto\)|\[punto\]|\(point\)|\[point\])"
DOMAIN = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,24}(?![A-Za-z0-9\-])")
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?"
DOMAIN_SPELLED = re.compile(rf"\s*({_LABEL}(?:(?:\s*{_DOT}\s*|\.){_LABEL})*(?:\s*{_DOT}\s*|\.)[A-Za-z]{{2,24}})(?![A-Za-z0-9\-])", re.I)
WORD_AT = re.compile(rf"\s+(?:at|AT|arroba|arobase)\s+({_LABEL}(?:\s+(?:dot|DOT|punto|punkt|point)\s+{_LABEL})*\s+(?:dot|DOT|punto|punkt|point)\s+[A-Za-z]{{2,24}})(?![\w])")
LOCAL_SPELLED = re.compile(rf"([A-Za-z0-9_](?:[A-Za-z0-9._%+'\-]*[A-Za-z0-9_])?(?:\s*{_DOT}\s*[A-Za-z0-9_+\-]+)*)\s*$", re.I)

NUMBER = re.compile(r"(?:\+|\(\+?)?\d(?:[ \u00a0./()\-]{0,3}\d)*")
ID_TOKEN = re.compile(
    r"(?:[^\w\n]|is|ist|es|est|lautet|no|nr|number|nummer|número|numéro|:|#|=){0,6}?(?<![\w])("
    r"[A-Z]{2}\d{8}(?!\w)|[XYZ]-?\d{7}-?[A-Z](?!\w)|\d{8}[- ]?[A-Z](?!\w)|[A-Z]{1,2}\d{6,9}(?!\w)|[A-Z]\d{2}[A-Z0-9]{6}\d?(?!\w)|"
    r"[12] \d{2} \d{2} \d[\dAB] \d{3} \d{3}(?: \d{2})?(?!\w)|[12]\d{12}(?: ?\d{2})?(?!\w)|\d{3}[- .]\d{2}[- .]\d{4}(?![\w])|\d{2} \d{3} \d{3} \d{3}(?!\w)|\d(?:[ .-]?\d){6,17}(?!\w))"
)
ID_BARE = re.compile(r"(?<![\w.\-/])(?:\d{3}-\d{2}-\d{4}|\d{8}-?[A-HJ-NP-TV-Z]|[XYZ]-?\d{7}-?[A-HJ-NP-TV-Z]|[12] \d{2} (?:0[1-9]|1[0-2]|13|[2-9]\d) \d[\dAB] \d{3} \d{3} \d{2})(?![\w\-])")

_NO = r"\d{1,4}(?:[a-zA-Z](?!\w))?"
ADDRESS_EN = re.compile(rf"(?<![\w.\-/#])\d{{1,5}}[a-zA-Z]?(?:[ ]?(?:bis|ter))? (?:(?:North|South|East|West|N\.|S\.|E\.|W\.) )?{_WORD}(?: {_WORD}){{0,2}} (?:{STREET_AFTER})(?!\w)")
NO_STREET = re.compile(r" (?:Fast|Slow|Swim|Memory|Open|Main|Closed|Pending|Critical|Happy|Golden|Merge|Release|Build|Test) [A-Z]")
COUNTED = re.compile(r" (?:items?|issues?|tickets?|cards?|tasks?|entries|modules?|jobs?|builds?|tests?|points?)\b")
ADDRESS_FR = re.compile(rf"(?<![\w.\-/#])\d{{1,4}}[a-zA-Z]?(?: ?(?:bis|ter|quater)\b)?,? (?:{STREET_FR}|{STREET_FR.title()}) (?:(?:de|du|des|de la|de l['’]|d['’]|la|le|les|l['’]) ?)*{_WORD}(?:[ -](?:(?:de|du|des|la|le) )*{_WORD}){{0,3}}")
ADDRESS_ES = re.compile(rf"(?<!\w)(?:{STREET_ES}) ?(?:(?:de|del|de la|de los|de las|la|el|los|las) )*{_WORD}(?: (?:(?:de|del|la|los|las|y) )*{_WORD}){{0,3}},?(?: n\.?º| nº| núm\.)? {_NO}(?: ?bis\b)?")
ADDRESS_DE = re.compile(
    rf"(?<![\w])(?:(?:Am|An der|An den|Auf der|Auf dem|Im|In der|In den|Zum|Zur|Zu den|Unter den|Hinter der|Hinter dem|Vor dem|Beim|Bei der) {_WORD}|(?:(?:Alte|Neue|Große|Kleine|Obere|Untere|Lange|Kurze) )?{_WORD}(?:-{_WORD}){{0,2}}[- ](?:{STREET_DE_WORD})|[{_U}][{_L}\-]*(?:{STREET_DE_END})) \d{{1,4}}(?: ?[a-z](?![\w ]))?(?:[a-z](?!\w))?"
)
DE_LEAD = ("Am ", "An der ", "An den ", "Auf der ", "Auf dem ", "Im ", "In der ", "In den ", "Zum ", "Zur ", "Zu den ", "Unter den ", "Beim ", "Bei der ")


def _trim(s: str, a: int, b: int) -> tuple[int, int]:
    while b > a and s[b - 1] in "  ":
        b -= 1
    return a, b


#: Digits of a full number, for countries where their count is fixed.
COUNTRY_DIGITS = {"1": 11, "33": 11, "34": 11, "44": 12}


def _fits(digits: str, trunk_zero: bool) -> bool:
    """Whether an international number has as many digits as its country's numbers have."""
    for code, n in COUNTRY_DIGITS.items():
        if digits.startswith(code):
            return len(digits) - trunk_zero == n
    return True


def _phone(text: str, a: int, b: int, cue: bool) -> tuple[int, int] | None:
    """The phone number within the digit run text[a:b], or None. Structure decides; bare digit strings need a cue."""
    s = text[a:b]
    if a and (text[a - 1].isalnum() or text[a - 1] in "_@#/" or (text[a - 1] in ".-" and a > 1 and text[a - 2].isalnum())):
        return None
    if b < len(text) and (text[b].isalpha() or text[b] in "_@" or (text[b] in ".-:/" and b + 1 < len(text) and text[b + 1].isalnum())):
        return None
    digits = re.sub(r"\D", "", s)
    if s.count("(") != s.count(")"):
        return None
    m = re.fullmatch(r"(?:\+|00)([1-9]\d{0,2})[ .\-/]?(?:\(0\)[ .\-/]?)?(?:\(?\d{1,5}\)?[ .\-/]{0,2})?\d(?:[ .\-/]?\d)+", s)
    if m and 8 <= len(digits) - 2 * s.startswith("00") <= 15 and _fits(digits[2 * s.startswith("00") :], "(0)" in s):
        return a, b
    if re.fullmatch(r"(?:1[ .\-])?(?:\([2-9]\d\d\) ?|[2-9]\d\d([.\- ]))[2-9]\d\d[.\- ]\d{4}", s):
        return a, b
    if re.fullmatch(r"0[1-9](?:[ .\-]\d\d){4}", s) or re.fullmatch(r"\(0\d{2,5}\) ?\d{3,}(?:[ \-]\d{1,5}){0,2}", s):
        return a, b
    if re.fullmatch(r"0\d{2,5}[/\-]\d{3,}(?:[ \-]\d{1,4})?", s) and 9 <= len(digits) <= 13:
        return a, b
    if re.fullmatch(r"0\d{3,4} \d{3,7}(?: \d{3,4})?", s) and 9 <= len(digits) <= 12:
        return a, b
    if re.fullmatch(r"[5-9]\d\d(?: \d\d){3}|[5-9]\d\d(?: \d{3}){2}", s):
        return a, b
    if cue and not digits.startswith(("978", "979")) and re.fullmatch(r"\d(?:[ .\-/]?\d)*", s) and (9 <= len(digits) <= 13) and (len(digits) == 10 or digits[0] in "056789"):
        return a, b
    return None


class Finder:
    """Anchors and parsers; one per Python worker."""

    _own: Finder | None = None

    @classmethod
    def get(cls) -> Finder:
        if cls._own is None:
            cls._own = cls()
        return cls._own

    def __init__(self, vocabularies: tuple[str, ...] | None = None) -> None:
        import ahocorasick

        self.words = Words.of(vocabularies or word_vocabularies())
        anchors: dict[str, set[tuple[str, str]]] = {}

        def add(kind: str, word: str) -> None:
            anchors.setdefault(word.lower(), set()).add((kind, word))

        for w in ID_CUES:
            add("id", w)
        add("at", "@")
        for w in ("(at)", "[at]", "{at}", "<at>", "(ät)", "[ät]", "(a)", "[a]", "(arroba)", "[arroba]", "(arobase)", "[arobase]", "＠"):
            add("spelled", w)
        for w in (" at ", " arroba ", " arobase "):
            add("word", w)
        for w in re.sub(r"\\|\?", "", STREET_AFTER).split("|"):
            add("street_en", " " + w)
        for w in STREET_FR.split("|"):
            add("street_fr", " " + w + " ")
        for w in re.sub(r"\\", "", STREET_ES).split("|"):
            add("street_es", w)
        for w in re.sub(r"\\", "", STREET_DE_END + "|" + STREET_DE_WORD).split("|"):
            add("street_de", w + " ")
        for w in DE_LEAD:
            add("lead_de", w)
        for i in range(100):
            add("digits", f"{i:02}")
        for i in range(10):
            for sep in " .-/(":
                add("digits", f"{sep}{i}")
            add("digits", f"+{i}")
        self.auto = ahocorasick.Automaton()
        for w, kinds in anchors.items():
            self.auto.add_word(w, (len(w), tuple(sorted(kinds))))
        self.auto.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """Chosen, non-overlapping spans in order: (start, end, kind)."""
        low = text.lower()
        if len(low) != len(text):  # letters whose lower form has another length keep their places
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        found: list[tuple[int, int, str]] = []
        numbers: dict[int, tuple[int, int]] = {}
        digit_end = -1
        for last, (size, kinds) in self.auto.iter(low):
            a, b = last + 1 - size, last + 1
            for kind, word in kinds:
                if kind == "digits":
                    if b <= digit_end:
                        continue
                    s = self._left(text, a)
                    while s < b and not (text[s].isdigit() or text[s] in "+("):
                        s += 1
                    m = NUMBER.match(text, max(s, digit_end, 0))
                    if m:
                        digit_end = m.end()
                        if m.end() - m.start() >= 8:
                            numbers[m.start()] = (m.start(), m.end())
                elif r := getattr(self, "_" + kind)(text, a, b, word):
                    found.append(r)
        taken_ids = [(a, b) for a, b, k in found if k in ("id_number", "email", "address")]
        for a, b in numbers.values():
            if any(a < y and x < b for x, y in taken_ids):
                continue
            lead = low[low.rfind("\n", 0, a) + 1 : a]
            if r := self._number(text, a, b, bool(PHONE_LEAD.search(lead))):
                found.append(r)
        found += self._names(text)
        return self._choose(found)

    @staticmethod
    def _left(text: str, a: int) -> int:
        """Start of the number that text[a:] may lie in: back over digits and their separators."""
        i, start = a, a
        while i > 0 and (text[i - 1].isdigit() or text[i - 1] in "+( \u00a0.-/)"):
            i -= 1
            if text[i].isdigit() or text[i] in "+(":
                start = i
            elif i + 1 < len(text) and not text[i + 1].isdigit() and not (i and text[i - 1].isdigit()) and text[i] == " ":
                break
        return start

    @staticmethod
    def _number(text: str, a: int, b: int, cue: bool) -> tuple[int, int, str] | None:
        if m := ID_BARE.match(text, a, min(len(text), b + 2)):
            return m.start(), m.end(), "id_number"
        # a run may start or end with another number set off by a blank: try the whole, then shorter ends, then later starts
        cuts = [m.start() + 1 for m in re.finditer(r"\d(?=[ \u00a0.\-/()]{1,3}\d)", text[a:b])]
        starts = [0, *[m.start() for m in re.finditer(r"(?<=[ ])[+(\d]", text[a:b])]]
        for s in starts:
            for e in [b - a, *reversed(cuts)]:
                if e - s >= 8 and (r := _phone(text, a + s, a + e, cue)):
                    return *r, "phone"
        return None

    def _at(self, text: str, a: int, b: int, word: str) -> tuple[int, int, str] | None:
        d = DOMAIN.match(text, b, min(len(text), b + 254))
        if not d:
            return None
        local = EMAIL_PLAIN.search(text, max(0, a - 64), a)
        local = local and self._longest_local(text, a)
        if local is None or local == a:
            return None
        if text[local:a].lower() == "git" and text[d.end() : d.end() + 1] in (":", "/"):
            return None
        if text[max(0, local - 3) : local] == "://" or (d.end() < len(text) and text[d.end()] == ":" and text[d.end() + 1 : d.end() + 2].isalpha() and "/" in text[d.end() : d.end() + 60].split(" ")[0]):
            return None  # a remote
        if re.search(r"(?i)\.(?:py|js|ts|go|java|json|md)$", d.group()):
            return None
        return local, d.end(), "email"

    @staticmethod
    def _longest_local(text: str, a: int) -> int | None:
        i = a
        while i > 0 and a - i < 64 and (text[i - 1].isalnum() and text[i - 1].isascii() or text[i - 1] in "._%+-'"):
            i -= 1
        while i < a and text[i] in ".%+-'":
            i += 1
        return i if i < a and text[a - 1] not in ".'" else None

    def _spelled(self, text: str, a: int, b: int, word: str) -> tuple[int, int, str] | None:
        d = DOMAIN_SPELLED.match(text, b, min(len(text), b + 254))
        m = LOCAL_SPELLED.search(text, max(0, a - 100), a)
        if not d or not m:
            return None
        start = m.start(1)
        return start, d.end(1), "email"

    def _word(self, text: str, a: int, b: int, word: str) -> tuple[int, int, str] | None:
        d = WORD_AT.match(text, a, min(len(text), a + 254))
        m = re.search(r"[A-Za-z0-9_](?:[A-Za-z0-9._+\-]*[A-Za-z0-9_])?(?:\s+(?:dot|DOT|punto|punkt|point)\s+[A-Za-z0-9_+\-]+)*$", text[max(0, a - 100) : a])
        return (max(0, a - 100) + m.start(), d.end(1), "email") if d and m else None

    def _id(self, text: str, a: int, b: int, word: str) -> tuple[int, int, str] | None:
        if (a and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum()):
            return None
        m = ID_TOKEN.match(text, b, min(len(text), b + 50))
        return (m.start(1), m.end(1), "id_number") if m else None

    @staticmethod
    def _near(pattern: re.Pattern, text: str, a: int, b: int, before: int, after: int) -> tuple[int, int, str] | None:
        """The match of the pattern that covers the anchor."""
        pos, stop = max(0, a - before), min(len(text), b + after)
        while m := pattern.search(text, pos, stop):
            if m.start() > a:
                return None
            if m.end() >= b or m.end() > a:
                return *_trim(text, m.start(), m.end()), "address"
            pos = m.start() + 1
        return None

    def _street_en(self, text: str, a: int, b: int, word: str) -> tuple[int, int, str] | None:
        r = self._near(ADDRESS_EN, text, a, b, 60, 2) if text[a + 1 : b][:1].isupper() else None
        # a count of things that only share their name with a street: 4 Fast Lane items
        return None if r and NO_STREET.search(text[r[0] : r[1]]) or COUNTED.match(text, b) else r

    def _street_fr(self, text: str, a: int, b: int, word: str) -> tuple[int, int, str] | None:
        return self._near(ADDRESS_FR, text, a, b, 14, 60)

    def _street_es(self, text: str, a: int, b: int, word: str) -> tuple[int, int, str] | None:
        return self._near(ADDRESS_ES, text, a, b, 0, 80) if text[a].isupper() and not (a and text[a - 1].isalnum()) else None

    def _street_de(self, text: str, a: int, b: int, word: str) -> tuple[int, int, str] | None:
        return self._near(ADDRESS_DE, text, a, b, 50, 8) if text[b : b + 1].isdigit() else None

    def _lead_de(self, text: str, a: int, b: int, word: str) -> tuple[int, int, str] | None:
        m = ADDRESS_DE.match(text, a, min(len(text), b + 50)) if text[a].isupper() and not (a and text[a - 1].isalnum()) else None
        return (*_trim(text, m.start(), m.end()), "address") if m else None

    def _names(self, text: str) -> Iterator[tuple[int, int, str]]:
        """Names by their structure: runs of capitalised pieces without common words, two words or an initial and a word,
        in either order. Anchors are the capitals; each run is expanded over blanks, particles and one comma."""
        run: list[tuple[int, int, str]] = []  # start, end, kind of piece
        for m in [*PIECE.finditer(text), None]:
            kind = None
            if m is not None:
                kind = "initial" if m.group(3) else "caps" if m.group(2) else "word"
                if kind != "initial" and (len(m.group()) < 2 or m.group() in TITLES or any(self.words.kind(w) == "common" for w in re.split("[-'’]", m.group()) if len(w) > 1)):
                    # a family name may be a common word, after a given name only
                    kind = kind if len(run) == 1 and text[run[0][0] : run[0][1]].title() in GIVEN and text[run[0][1] : m.start()] in (" ", "\u00a0") and m.group() not in TITLES and len(m.group()) > 1 else None
            if kind and run and (g := GAP.fullmatch(text, run[-1][1], m.start())) and not (g.group().startswith(",") and (len(run) > 1 + self._led(text, run) or kind == "initial" or run[-1][2] == "initial")):
                run.append((m.start(), m.end(), kind))
                continue
            if len(run) > 1 and (r := self._name_run(text, run)):
                yield r
            run = [(m.start(), m.end(), kind)] if kind else []

    def _name_run(self, text: str, run: list[tuple[int, int, str]]) -> tuple[int, int, str] | None:
        if len(run) > 2 and self._led(text, run):
            run = run[1:]
        turned = "," in text[run[0][1] : run[1][0]]
        kind = next((k for _, _, k in run if k != "initial"), None)
        taken: list[tuple[int, int, str]] = []
        words = 0
        for x, y, k in run:
            if k not in ("initial", kind):
                break
            taken.append((x, y, k))
            words += k != "initial"
            known = k != "initial" and self.words.kind(text[x:y]) == "proper"
            if words and len(taken) > 1 and k != "initial" and (turned or not known):
                break  # the family name; what follows belongs to another sentence
        if turned and len(taken) == 2 and len(run) > 2 and run[2][2] == "initial":
            taken.append(run[2])
        while taken and taken[-1][2] == "initial" and not turned:
            taken.pop()
        own = [text[x:y] for x, y, k in taken if k != "initial"]
        if len(taken) < 2 or not own or (len(own) < 2 and taken[0][2] != "initial"):
            return None
        a, b = taken[0][0], taken[-1][1]
        if GROUPS.match(text, b) or (kind == "caps" and min(map(len, own)) < 3):
            return None
        if turned and (re.match(r",[  ]?\w", text[b : b + 3]) or text[max(0, a - 2) : a] == ", "):
            return None  # a list
        sure = taken[0][2] == "initial" or any(self.words.kind(w) == "proper" or w.title() in GIVEN for w in own)
        sure = sure or bool(re.match(r"[  ]?[<(][^\s<>()]+@", text[b : b + 80]))
        if not sure and re.match(r"[  ]\d{1,4}(?!\d)", text[b : b + 6]):
            return None  # a numbered thing
        if not sure and not WITHIN.search(text, max(0, a - 5), a) and not re.match(r"[ \t]*(?:\n|\r|$)", text[b : b + 8]) and not self._in_address(text, own):
            return None  # the first words of a sentence, which may be any words
        return a, b, "name"

    @staticmethod
    def _led(text: str, run: list[tuple[int, int, str]]) -> bool:
        """Whether a particle follows the first piece, which then is no given name if a whole name follows: Reported by A B."""
        return len(run) > 1 and run[0][2] != "initial" and bool(text[run[0][1] : run[1][0]].strip(" ,\u00a0"))

    @staticmethod
    def _in_address(text: str, words: list[str]) -> bool:
        """Whether an e-mail address of the text is made of one of the words."""
        plain = lambda w: unicodedata.normalize("NFKD", w).encode("ascii", "ignore").decode().lower()
        return any(len(w) > 3 and re.search(rf"{re.escape(plain(w))}[\w.+\-]*@", text, re.I) for w in words)

    @staticmethod
    def _choose(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        kept: list[tuple[int, int, str]] = []
        by_kind = sorted(set(found), key=lambda r: (KINDS.index(r[2]), -(r[1] - r[0]), r[0]))
        import bisect

        starts: list[int] = []
        for r in by_kind:
            i = bisect.bisect_left(starts, r[0])
            if (i and kept[i - 1][1] > r[0]) or (i < len(kept) and kept[i][0] < r[1]):
                continue
            starts.insert(i, r[0])
            kept.insert(i, r)
        return kept

    def replace(self, text: str, spans: list[tuple[int, int, str]] | None = None) -> str:
        out, at = [], 0
        for a, b, kind in spans if spans is not None else self.spans(text):
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
        return "".join([*out, text[at:]])


def scan(df: DataFrame, key: str, text: str, redacted: bool = True) -> DataFrame:
    """One row per document: ``key``, found (array of kind and value), and with ``redacted`` the text with placeholders."""
    fields = [df.schema[key], T.StructField("found", T.ArrayType(T.StructType([T.StructField("pii_kind", T.StringType()), T.StructField("matched_text", T.StringType())])))]
    if redacted:
        fields.append(T.StructField("redacted", T.StringType()))
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Finder.get()
        kind = pa.list_(pa.struct([("pii_kind", pa.string()), ("matched_text", pa.string())]))
        for batch in batches:
            found, texts = [], []
            for t in batch.column(text).to_pylist():
                spans = f.spans(t) if t else []
                found.append([{"pii_kind": k, "matched_text": v} for k, v in dict.fromkeys((k, t[a:b]) for a, b, k in spans)])
                if redacted:
                    texts.append(f.replace(t, spans) if spans else t)
            columns = [batch.column(key), pa.array(found, kind), *([pa.array(texts, pa.string())] if redacted else [])]
            yield pa.RecordBatch.from_arrays(columns, names=[c.name for c in fields])

    return spread(df.select(key, text)).mapInArrow(run, schema)


def find(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, pii_kind, matched_text: each distinct string once per document."""
    return scan(df, key, text, redacted=False).select(key, F.explode("found").alias("f")).select(key, "f.*")
