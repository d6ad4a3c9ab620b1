"""Replacements for personal information: keyed, of the same type and format, distinct for distinct originals.

Numbers go through a keyed permutation of all numbers of their length, which can't collide. Words become words made of
syllables of their own script. Given names end as names of the sex do that titles before them tell, and where no title
does in the same class of sound as before. The same original, however written, always gets the same replacement; without
the key it can't be undone.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Mapping

from tilewright.llm.pii import _EN, fold, repair

#: Of scripts with syllables of their own: consonants, vowels, what ends a word that isn't to end in a vowel.
SOUNDS = {"LATIN": ("bdfgklmnprstvz", "aeiou", "nrlsk"), "CYRILLIC": ("бвгдзклмнпрст", "аеиоу", "нрлск"), "GREEK": ("βγδζκλμνπρστ", "αειου", "νρξ")}


def script_of(word: str) -> str:
    """The script of a word's first letter, as Unicode names it."""
    return next((unicodedata.name(c, "").split()[0] for c in word if c.isalpha() and unicodedata.name(c, "")), "LATIN")


def letters_like(c: str) -> str:
    """Letters of the same kind around a letter of a script without syllables here: those of its block of 32."""
    start = ord(c) & ~31
    return "".join(chr(n) for n in range(start, start + 32) if unicodedata.category(chr(n)) == unicodedata.category(c))
_ROUNDS = 8


class Surrogates:
    def __init__(self, key: bytes, parts: Mapping[str, str] | None = None, attempts: Mapping[tuple[str, str], int] | None = None):
        """``parts``: injective replacements of parts of names, from name_parts; ``attempts``: from the collision check."""
        self.key, self.parts, self.attempts = key, parts or {}, attempts or {}

    def _bits(self, *what: object) -> int:
        return int.from_bytes(hmac.new(self.key, "\x1f".join(map(str, what)).encode(), hashlib.sha256).digest(), "big")

    def permuted(self, value: int, size: int, tweak: str) -> int:
        """A keyed bijection of 0..size-1: Feistel rounds on the next power of four, walked until inside."""
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        while True:
            left, right = value >> half, value & mask
            for r in range(_ROUNDS):
                left, right = right, left ^ (self._bits("perm", tweak, size, r, right) & mask)
            value = left << half | right
            if value < size:
                return value

    def digits(self, run: str, tweak: str) -> str:
        return str(self.permuted(int(run), 10 ** len(run), tweak)).zfill(len(run)) if run else run

    def counted(self, run: str, tweak: str) -> str:
        """As digits, but a number that doesn't begin with 0 becomes another such."""
        low = 10 ** (len(run) - 1) if run else 0
        return str(low + self.permuted(int(run) - low, 9 * low, tweak)) if run and run[0] != "0" else self.digits(run, tweak)

    def word(self, original: str, role: str, attempt: int = 0, syllables: int = 4, sex: str = "") -> str:
        """A word of the same script; ``sex`` (m or f) decides how it ends, else the original's last letter does."""
        bits, out, plain = self._bits("word", role, fold(original), attempt), "", fold(original)
        script = script_of(plain)
        if script not in SOUNDS:  # letter by letter, so that the length stays
            for c in plain:
                own = letters_like(c) if c.isalpha() else c
                bits, k = divmod(bits, len(own))
                out += own[k]
            return out
        consonants, vowels, ends = SOUNDS[script]
        for _ in range(syllables):
            bits, k = divmod(bits, len(consonants) * len(vowels))
            out += consonants[k // len(vowels)] + vowels[k % len(vowels)]
        last = plain[-1:]
        if sex == "f":
            return out[:-1] + vowels[0]
        if sex == "m" or last not in vowels:
            return out + ends[bits % len(ends)]
        return out[:-1] + last if last in vowels[0] + vowels[1] + vowels[3] else out

    @staticmethod
    def cased(like: str, word: str) -> str:
        return word.upper() if len(like) > 1 and like.isupper() else word.capitalize() if like[:1].isupper() else word

    def replace(self, kind: str, written: str) -> str:
        return getattr(self, kind)(repair(written)[0])

    def email(self, s: str) -> str:
        local, mark, domain = re.match(r"(?s)(.+?)((?:\s?[\[(]\s?(?:at|@|arroba)\s?[\])]\s?)| ?@ ?| (?:at|arroba) )(.+)", s, re.I).groups()
        core = canonical("email", s)
        attempt = self.attempts.get(("email", core), 0)
        words = re.sub(r"[A-Za-z]+", lambda m: self.cased(m.group(), self.word(core + str(m.start()), "mail", attempt)), local)
        names = re.split(r"(\W+(?:dot|punkt|point|punto)?\W*)", domain, flags=re.I)
        names[0] = self.cased(names[0], self.word(names[0], "host"))
        return re.sub(r"\d+", lambda m: self.counted(m.group(), "mail"), words) + mark + "".join(names)

    def phone(self, s: str) -> str:
        """The last seven digits change, before any extension; the rest keeps its place, so formats of one number agree."""
        main = re.split(r"(?i)(?:,? ?(?:ext|extension|durch|poste|x))", s)[0]
        places = [i for i, c in enumerate(main) if c.isdigit()][-7:]
        new = self.digits("".join(main[i] for i in places), "phone")
        out = list(s)
        for i, d in zip(places, new):
            out[i] = d
        return "".join(out[: len(main)]) + re.sub(r"\d+", lambda m: self.counted(m.group(), "ext"), s[len(main) :])

    def id_number(self, s: str) -> str:
        """Letters stay letters and digits digits: a permutation of all numbers of that shape."""
        at = [i for i, c in enumerate(s) if c.isalnum() and c.isascii()]
        sizes = [10 if s[i].isdigit() else 26 for i in at]
        value, size = 0, 1
        for i, n in zip(at, sizes):
            value, size = value * n + (int(s[i]) if n == 10 else ord(s[i].upper()) - 65), size * n
        value = self.permuted(value, size, "id" + "".join("9" if n == 10 else "A" for n in sizes))
        out = list(s)
        for i, n in zip(reversed(at), reversed(sizes)):
            value, d = divmod(value, n)
            out[i] = str(d) if n == 10 else chr(65 + d)
        return "".join(out)

    def address(self, s: str) -> str:
        """The street's own words and the number change; its kind, its articles and the order stay."""
        attempt = self.attempts.get(("address", canonical("address", s)), 0)
        kept = rf"(?i)^(?:{_EN}|St|rue|avenue|boulevard|impasse|allée|chemin|quai|place|calle|c|avenida|plaza|paseo|camino|bis|ter|am|an|der|im|in|auf|zum|zur|de|la|los|las|del|des|du|n)$"
        ends = re.compile(r"(?i)(straße|strasse|stra�e|str|gasse|platz|weg|allee)$")

        def one(m: re.Match) -> str:
            w = m.group()
            if re.match(kept, w):
                return w
            tail = ends.search(w)
            stem = w[: tail.start()] if tail else w
            return self.cased(stem, self.word(stem, "street", attempt)) + (tail.group() if tail else "")

        return re.sub(r"\d+|[^\W\d_][\w�’'-]*[^\W\d_]", lambda m: self.counted(m.group(), "house") if m.group().isdigit() else one(m), s)

    def person_name(self, s: str) -> str:
        def one(m: re.Match) -> str:
            w = m.group()
            if len(w) == 1:
                return chr(65 + self.permuted((ord(fold(w)[:1] or "a") - 97) % 26, 26, "initial"))
            return self.cased(w, self.parts.get(fold(w)) or self.word(w, "name"))

        return re.sub(r"[\w�’'-]+", one, s)


def canonical(kind: str, written: str) -> str:
    """What is the same for all ways of writing one original."""
    s = repair(written)[0]
    if kind == "email":
        s = re.sub(r"(?i)\s?[\[(]\s?(?:at|@|arroba)\s?[\])]\s?| ?@ ?| (?:at|arroba) ", "@", s)
        return re.sub(r"(?i)\s?[\[(]\s?(?:dot|punkt|point|punto)\s?[\])]\s?| (?:dot|punkt|point|punto) ", ".", s).lower()
    if kind == "phone":
        return "".join(c for c in s if c.isdigit())
    if kind == "id_number":
        return "".join(c for c in s if c.isalnum()).upper()
    words = re.findall(r"[\w�]+", fold(s))
    if kind == "person_name" and "," in s:
        words = words[1:] + words[:1]
    return " ".join(words)


def name_parts(key: bytes, words: list[str], sexes: Mapping[str, str] | None = None) -> dict[str, str]:
    """Distinct replacements of all known parts of names; a clash moves on to the next attempt."""
    made, taken, out, sexes = Surrogates(key), set(), {}, sexes or {}
    for w in sorted({fold(w) for w in words}):
        attempt = 0
        while (new := made.word(w, "name", attempt, 3, sexes.get(w, ""))) in taken or new in words:
            attempt += 1
        taken.add(new)
        out[w] = new
    return out
