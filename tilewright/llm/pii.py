"""Personal information in free text: where it is, exactly as written.

A page may be garbled (UTF-8 read as Latin-1, or characters lost as U+FFFD). Detection runs on a repaired copy whose
characters know their place in the original, so that what is found is given as it stands there.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field

LOST = "�"
_TRAIL = "".join(chr(c) for c in range(0x80, 0xC0)) + "".join(c for b in range(0x80, 0xA0) if (c := bytes([b]).decode("cp1252", "ignore")))
_BROKEN = re.compile(f"[Â-ß][{_TRAIL}]|[à-ï][{_TRAIL}]{{2}}")


def _raw(c: str) -> bytes:
    return bytes([ord(c)]) if ord(c) < 256 else c.encode("cp1252")


def repair(text: str) -> tuple[str, list[int] | None]:
    """The text with garbled characters restored, and for each of its characters (and its end) the place in the original."""
    if not _BROKEN.search(text):
        return text, None
    out, places, at = [], [], 0
    for m in _BROKEN.finditer(text):
        try:
            good = b"".join(map(_raw, m.group())).decode("utf-8")
        except UnicodeDecodeError:
            continue
        out += [text[at : m.start()], good]
        places += [*range(at, m.start()), *[m.start()] * len(good)]
        at = m.end()
    return "".join([*out, text[at:]]), [*places, *range(at, len(text) + 1)]


# ---- e-mail addresses

#: Top-level domains taken as such where an address is spelled out in words.
SPELLED_TLDS = "com org net edu gov info biz eu int mil name io app dev de fr es uk us nl ch se dk fi pl cz it pt ca au jp example test invalid localhost".split()
_LOCAL, _LABEL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*", r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_DOT = r"(?:\.|\s?\[\s?(?:dot|punkt|point|punto)\s?\]\s?|\s?\(\s?(?:dot|punkt|point|punto)\s?\)\s?)"
_EMAIL = re.compile(
    rf"(?<![\w.%+-]){_LOCAL}(?:@| @ |\s?[\[(]\s?(?:at|@|arroba)\s?[\])]\s?){_LABEL}(?:{_DOT}{_LABEL})*?{_DOT}[A-Za-z]{{2,}}(?:{_DOT}[A-Za-z]{{2,}})*(?![\w@-])", re.I
)
_SPELLED = re.compile(rf"(?<![\w.%+-]){_LOCAL} (?:at|arroba) {_LABEL}(?: (?:dot|punkt|point|punto) {_LABEL})* (?:dot|punkt|point|punto) (?:{'|'.join(SPELLED_TLDS)})\b(?: (?:dot|punkt|point|punto) (?:{'|'.join(SPELLED_TLDS)})\b)*", re.I)
#: What any match of _EMAIL without an @ holds.
_AT = re.compile(r"[\[(]\s?(?:at|arroba)\s?[\])]")


def emails(text: str, low: str) -> Iterator[tuple[int, int]]:
    if "@" in text or _AT.search(low):
        for m in _EMAIL.finditer(text):
            yield m.span()
    if " at " in low or " arroba " in low:
        for m in _SPELLED.finditer(text):
            yield m.span()


# ---- telephone numbers

_EXT = r"(?:,? ?(?:ext\.?|extension|durchwahl|poste|extensi[oó]n|x) ?\d{1,6})?"
_PHONE = re.compile(
    r"(?<![\w+./-])(?:"
    r"\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}"
    r"|(?:\+|00)[1-9]\d{0,2}(?:[ .-]?\(0\) ?|(?P<s>[ .-]))\d{1,10}(?:(?P<t>(?(s)(?P=s)|[ .-]))\d{1,10})?(?:(?P=t)\d{1,10}){0,5}|(?:\+|00)[1-9]\d{8,13}"
    r"|\(\d{3}\) ?\d{3}[ .-]\d{4}"
    r"|\d{3}(?P<u>[ .-])\d{3}(?P=u)\d{4}"
    r"|0[1-9](?:(?P<v>[ .-])\d\d)(?:(?P=v)\d\d){3}"
    r"|0\d{1,4} ?/ ?\d{3,8}(?:[ -]\d{1,5}){0,2}"
    r"|0\d{3,4}[ -]\d{6}|0\d{2,4}[ -]\d{3,4}[ -]\d{3,4}"
    rf"){_EXT}(?![\w]|[.,/:-]\d)(?! ?(?:mV|mm|cm|km|kg|kB|MB|%|°)\b)", re.I,
)


def phones(text: str, used: bytearray) -> Iterator[tuple[int, int]]:
    """Ends before what is taken already, such as the house number of an address that follows."""
    at = 0
    while m := _PHONE.search(text, at):
        taken = used.find(1, m.start(), m.end())
        if taken >= 0:
            m2 = _PHONE.match(text[: m.start() + len(text[m.start() : taken].rstrip(" ,"))], m.start()) if taken > m.start() else None
            if not m2:
                at = max(taken, m.start()) + 1
                continue
            m = m2
        digits = sum(c.isdigit() for c in re.split(r"(?i)ext|x|durch|poste", m.group())[0])
        if 9 <= digits <= 17:
            yield m.span()
        at = m.end()


# ---- numbers of a person's documents

#: Words that name a document or record of a person.
_LABELS = (
    r"passport|national\s+id(?:entity)?(?:\s+card)?|identity\s+card|id\s+card|driv(?:ing|er[’']?s?)\s+licen[cs]e|social\s+(?:insurance|security)|national\s+insurance|"
    r"tax\s+(?:reference|id|identification)|health\s+insurance|insurance\s+(?:no|number|id)|reisepass|personalausweis|ausweis|f[üu]hrerschein|steuer|sozialversicherungs?|"
    r"versicherten|passeport|carte\s+d[’']identit[eé�]|num[eé�]ro\s+(?:fiscal|de\s+s[eé�]curit[eé�]\s+sociale)|permis\s+de\s+conduire|pasaporte|documento\s+(?:nacional\s+)?de\s+identidad|"
    r"dni|nie|nif|ssn|nino|permiso\s+de\s+conducir|seguridad\s+social"
)
_FILL = r"(?:[\s.-]*(?:(?:no|nr|num(?:ber|[eé]ro|mer)?|nummer|id|reference|card)\b|n[°º�]|n\.\s?[°ºo�])\.?)*"
_ID_VALUE = (
    r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]|[A-Z]-?\d{6,9}(?:-?[A-Z])?|\d{7,9}-?[A-Z]|\d{3}-\d{2}-\d{4}|\d{6}-\d{4}|\d{2}(?: \d{3}){3}|\d{3}(?: \d{3}){2}|[A-Z]{1,3}\d{5,10}[A-Z]?|\d{6,14}"
)
_ID = re.compile(rf"(?i:(?<!\w)(?:{_LABELS}){_FILL}(?:\s*[:=#]\s*|\s+))((?:{_ID_VALUE}))(?![\w])(?!-\d)")
#: One of these is in every label, however it is spaced or accented.
_ID_WORDS = ("pass", "pasap", "ident", "licen", "insur", "secur", "num", "tax", "ausweis", "führer", "fuhrer", "steuer", "versicher", "fiscal", "permis", "national", "card", "dni", "nie", "nif", "ssn", "nino", "seguridad", "health")


def id_numbers(text: str, low: str) -> Iterator[tuple[int, int]]:
    if any(w in low for w in _ID_WORDS):
        for m in _ID.finditer(text):
            yield m.span(1)


# ---- street addresses

def _letters(*kinds: str, but: str = "", up_to: int = 0x30000) -> str:
    """Ranges of all letters of these Unicode categories, for a character class."""
    own = [c for c in range(up_to) if unicodedata.category(chr(c)) in kinds and chr(c) not in but]
    out, first = [], None
    for i, c in enumerate(own):
        first = c if first is None else first
        if i + 1 == len(own) or own[i + 1] != c + 1:
            out.append(chr(first) if first == c else f"{chr(first)}-{chr(c)}")
            first = None
    return "".join(out)


#: What streets begin with: capitals, as far as streets of the languages below have them.
_C, _W = f"[A-ZÀ-ÖØ-Þ{_letters('Lu', up_to=0x250)}{LOST}]", "[\\w�’'-]"
#: Letters beyond Latin-1. A pattern over the capitals of all scripts is much slower, so it is used for texts that need it.
_FAR = re.compile("[\u0100-\u1fff\u2c00-\ud7ff\uf900-\uffdc\U00010000-\U0002fa1f]")
_WORD = f"{_C}{_W}+"
#: What streets are called, by the order of their language.
_EN = "Street|Road|Lane|Drive|Avenue|Terrace|Row|Close|Court|Way|Place|Square|Boulevard|Crescent|Grove|Mews|Walk|Rd|Ave|Blvd|Ln|Dr|Ct|Sq"
_EN_STREET = re.compile(rf"(?<![\w./:,-])\d{{1,4}}[A-Za-z]? (?:{_WORD} ){{1,3}}(?:(?:{_EN}|{_EN.upper()})(?![\w�'’-])|(?:St|ST)\b\.?)")
_DE_STREET = re.compile(
    rf"(?<![\w�-])(?:{_C}{_W}*?(?i:stra(?:ß|ss|ẞ|{LOST})e|str\.|gasse|platz|weg|allee|damm|ufer|steig|ring)|(?:Am|An der|An den|Im|In der|In den|Auf der|Auf dem|Zum|Zur|AM|AN DER|IM|ZUM|ZUR) {_WORD}(?: {_WORD})?) \d{{1,4}}[A-Za-z]?(?![\w�]|[.,]\d)"
)
_FR_STREET = re.compile(
    rf"(?<![\w./:-])\d{{1,4}}(?: ?(?:bis|ter|quater)\b|[A-Za-z]\b)?,? (?i:rue|avenue|boulevard|impasse|all[eé{LOST}]e|chemin|quai|place|cours|passage|square|sentier|faubourg) (?i:de la |de l[’']|des |du |de |d[’'])?(?:(?i:Vieux|Vieille|Grande?|Petite?|Sainte?|Haute?|Bas|Basse|Belle|Beau|Nouvelle|Nouveau) )?{_WORD}"
)
_ES_STREET = re.compile(
    rf"(?<![\w{LOST}])(?i:calle|c/|avenida|avda\.|av\.|plaza|pza\.|paseo|camino|carretera|ronda|traves[ií{LOST}]a) (?i:de la |de los |de las |del |de )?(?:{_WORD} ){{0,3}}{_WORD},? (?i:n\.? ?[º°o{LOST}] ?|n[uú{LOST}]m\. ?)?\d{{1,4}}[A-Za-z]?(?![\w{LOST}])"
)
#: What stands before a number that is no house number, and what follows "am" without being a street.
_NO_HOUSE = re.compile(r"(?i)\b(?:route|bus|line|linie|ligne|l[ií]nea|tram|highway|exit|gate|platform|room|tile|no\.|nr\.) ?$")
_NO_STREET = re.compile(r"(?i)^(?:am|im|zum|zur) (?:\w*tag|mittwoch|\w*woche|januar|februar|märz|april|mai|juni|juli|august|september|oktober|november|dezember|jahr|kapitel|teil|absatz)\b")


def addresses(text: str, low: str) -> Iterator[tuple[int, int]]:
    for m in _EN_STREET.finditer(text):
        if not _NO_HOUSE.search(text, max(0, m.start() - 12), m.start()):
            yield m.span()
    for m in _DE_STREET.finditer(text):
        if not _NO_STREET.match(m.group()):
            yield m.span()
    for m in _FR_STREET.finditer(text):
        if not _NO_HOUSE.search(text, max(0, m.start() - 12), m.start()):
            yield m.span()
    if any(w in low for w in ("calle", "c/", "avenida", "avda", "av.", "plaza", "pza", "paseo", "camino", "carretera", "ronda", "traves")):
        for m in _ES_STREET.finditer(text):
            yield m.span()


# ---- names of persons

GIVEN, FAMILY = 1, 2


def _token(first: str, initial: str) -> re.Pattern:
    return re.compile(f"{first}(?<![\\w{LOST}’'-].)(?:(?:[\\w{LOST}]|[’'-](?=\\w))+|((?<={initial})\\.))", re.S)


#: Words that begin with a capital, and initials: in Latin-1, and in all scripts, where letters without case begin names, too.
_NEAR_TOKEN = _token(f"[A-ZÀ-ÖØ-Þ{LOST}]", f"[A-ZÀ-ÖØ-Þ{LOST}]")
_FAR_TOKEN = re.compile(f"(?<![\\w{LOST}’'-])(?:[{_letters('Lu', 'Lt', 'Lo', but='ªº')}{LOST}](?:[\\w{LOST}]|[’'-](?=\\w))+|([{_letters('Lu', 'Lt')}{LOST}]\\.))")
#: What makes a place or thing of the words before it; not where a number follows or a title stands.
_THING = re.compile(rf"^[ -](?:{_EN}|St|Bridge|Gardens?|Park|Station|Museum|Hall|House|School|Library|Hotel|Church|Tower|Forest|Lake|River|Island|Valley|Hill|Field|Meadow|Mill|Farm|Centre|Center|Institute|Foundation|Festival|Prize|Award|Ltd|Inc|GmbH)\b(?! \d)(?!\. ?[^\W\d_])")


def fold(word: str) -> str:
    """Without case and accents; lost characters stay."""
    if word.isascii():
        return word.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", word).casefold() if not unicodedata.combining(c))


def blur(word: str) -> str:
    """As the word stands where every character beyond ASCII was lost."""
    return "".join(c if c.isascii() else LOST for c in unicodedata.normalize("NFC", word).lower())


@dataclass(frozen=True)
class Names:
    """Parts of names with their roles, by folded and by blurred form, and the sex that titles give to given names."""

    roles: dict[str, int]
    sexes: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def of(parts: Iterable[tuple[str, int]], sexes: Mapping[str, str] | None = None) -> Names:
        roles: dict[str, int] = {}
        for word, role in parts:
            for form in {fold(word), blur(word)}:
                roles[form] = roles.get(form, 0) | role
        return Names(roles, {form: sex for word, sex in (sexes or {}).items() for form in (fold(word), blur(word))})

    def role(self, word: str) -> int:
        return self.roles.get(fold(word), 0)


def tokens(text: str) -> list[tuple[int, int, bool]]:
    """Start, end and whether it is an initial, of each capitalised word."""
    pattern = _FAR_TOKEN if not text.isascii() and _FAR.search(text) else _NEAR_TOKEN
    return [(m.start(), m.end(), m.group(1) is not None) for m in pattern.finditer(text)]


def names(text: str, known: Names) -> Iterator[tuple[int, int]]:
    """Given name or initial, middle initials and family name; or family name, comma, given name."""
    toks = tokens(text)
    roles = [0 if initial else known.role(text[a:b]) for a, b, initial in toks]
    gap = lambda i: text[toks[i][1] : toks[i + 1][0]] if i + 1 < len(toks) else None

    def forward(i: int) -> int:
        """The family name that ends a name beginning at i, or -1."""
        j = i
        while gap(j) == " ":
            j += 1
            if not toks[j][2]:
                return j if roles[j] & FAMILY else -1
            if j - i > 2:
                break
        return -1

    i = 0
    while i < len(toks):
        start, end, initial = toks[i]
        j = forward(i) if initial or roles[i] & GIVEN else -1
        if j > 0 and not _THING.match(text, toks[j][1]) and not (_THING.match(text[toks[j][1] : toks[j][1] + 14])):
            yield start, toks[j][1]
            i = j + 1
            continue
        if roles[i] & FAMILY and gap(i) == ", " and roles[i + 1] & GIVEN and forward(i + 1) < 0:
            j = i + 1
            if gap(j) == " " and toks[j + 1][2] and not (gap(j + 1) == " " and roles[j + 2] & FAMILY):
                j += 1
            yield start, toks[j][1]
            i = j + 1
            continue
        i += 1


#: Titles, which stand before names without being part of them.
_MR, _MRS = "mr sir herr monsieur señor sr don".split(), "mrs ms miss lady frau madame mademoiselle mme mlle señora sra srta doña".split()
TITLES = {"dr", "prof", *_MR, *_MRS}
MALE, FEMALE = 4, 8
_TITLE = re.compile(rf"(?i)(?<!\w)(?:({'|'.join(_MR)})|({'|'.join(_MRS)}))\.? (?:dr\.? |prof\.? )?$")


def plain_form(word: str) -> str:
    return unicodedata.normalize("NFC", word).lower()


def name_evidence(texts: Iterable[str | None], known: Names) -> Counter:
    """Counts for words that may be parts of names: keys (word, 0, "") for all its capitalised occurrences, (word, role,
    partner) where a known part stands beside it as in a name, and (word, MALE or FEMALE, "") where a title stands before it
    and another word follows."""
    out: Counter = Counter()
    for text in texts:
        if not text:
            continue
        text, _ = repair(text)
        toks = tokens(text)
        words = [None if initial else plain_form(text[a:b]) for a, b, initial in toks]
        out.update((w, 0, "") for w in words if w)
        roles = [known.role(w) if w else 0 for w in words]
        for (a, _, _), (c, _, _), w in zip(toks, toks[1:], words):
            if w and w not in TITLES and c - a <= len(w) + 4 and (m := _TITLE.search(text, max(0, a - 20), a)):
                out[w, MALE if m[1] else FEMALE, ""] += 1
        if not any(roles):
            continue
        gaps = [None, *[text[toks[i][1] : toks[i + 1][0]] for i in range(len(toks) - 1)], None]  # gaps[i] stands before token i

        def free(i: int) -> bool:
            return bool(words[i]) and not roles[i] and words[i] not in TITLES

        for i, role in enumerate(roles):
            if not role:
                continue
            before, after = gaps[i], gaps[i + 1]
            if role & GIVEN and after == " ":
                j = i + 1
                while words[j] is None and j - i < 3 and gaps[j + 1] == " ":
                    j += 1
                if free(j):
                    out[words[j], FAMILY, words[i]] += 1
            if role & GIVEN and before == ", " and after != " " and free(i - 1) and not (gaps[i - 1] == " " and roles[i - 2] & GIVEN):
                out[words[i - 1], FAMILY, words[i]] += 1
            if role & FAMILY and before == " " and after != ", ":
                j = i - 1
                while words[j] is None and j and i - j < 3 and gaps[j] == " ":
                    j -= 1
                if free(j):
                    out[words[j], GIVEN, words[i]] += 1
            if role & FAMILY and after == ", " and free(i + 1) and gaps[i + 2] != " " and not (before == " " and (roles[i - 1] & GIVEN or words[i - 1] is None)):
                out[words[i + 1], GIVEN, words[i]] += 1
    return out


#: Different partners of a word that ``enough`` asks about at most, and the least share that it asks for.
PARTNERS, LEAST_SHARE = 8, 0.02


def enough(n_partners: int, n_beside: int, n_all: int) -> bool:
    """Whether a word counts as a part of names: it stands where one does beside several known parts, for a good part of its
    occurrences; the more partners, the smaller, as some parts are ordinary words most of the time, but ordinary words stand
    beside few."""
    return any(n_partners >= p and n_beside >= share * n_all for p, share in ((2, 0.3), (4, 0.08), (PARTNERS, LEAST_SHARE)))


# ---- all together

TYPES = ("email", "id_number", "address", "phone", "person_name")


def find(text: str | None, known: Names) -> list[tuple[int, int, str]]:
    """Start, end and type of each piece of personal information, in order, none over another."""
    if not text:
        return []
    fixed, places = repair(text)
    low = fixed.lower()
    if len(low) != len(fixed):  # a few characters grow when lowered; places matter only in the text itself
        low = low + " "
    taken: list[tuple[int, int, str]] = []
    used = bytearray(len(fixed) + 1)
    sources = (emails(fixed, low), id_numbers(fixed, low), addresses(fixed, low), phones(fixed, used), names(fixed, known))
    for kind, spans in zip(TYPES, sources):
        for a, b in spans:
            if not any(used[a:b]):
                used[a:b] = b"\x01" * (b - a)
                taken.append((a, b, kind))
    taken.sort()
    return taken if places is None else [(places[a], places[b], kind) for a, b, kind in taken]
