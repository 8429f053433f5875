"""Text decoded with the wrong encoding: finding it, and restoring what can be restored.

A text is re-encoded under a candidate legacy encoding and strictly decoded as the intended one, again and again for
nested damage, for as long as its garbling cost drops. One-byte encodings taken for one another are told by words that no
Latin script writes so (a capital or a symbol within a word, a ß after a consonant); a field without any such word stays. The cost counts signs where running text does not have them:
controls, box drawing, symbols that touch letters, capitals after small letters, ordinals after letters, and so on.
Letters of other languages cost little, and signs of other scripts nothing, so names and symbols written properly stay.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizlake.session import ready

#: Encodings in which bytes of UTF-8 may have been read.
READ_AS = ("cp1252", "latin-1", "cp850", "cp437", "mac_roman", "cp1251")
#: (read as, meant): one-byte encodings taken for one another.
SWAPPED = (("mac_roman", "cp1252"), ("cp850", "cp1252"), ("cp437", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp850"))
#: Words that must speak for a pair of encodings before it also changes words which look right as they are.
AGREEING = 2
#: Least drop of the cost; smaller ones, down to SMALL_DROP, count if no cost remains.
DROP, SMALL_DROP = 1.0, 0.35
#: Signs that running text has anyway; any other sign makes a field suspect.
ORDINARY = r"\x00-\x7FáéíóúüñÁÉÍÓÚÜÑ¿¡«»“”‘’–—…º\x{A0}\x{300}-\x{36F}\p{Zs}\x{200B}-\x{200F}\x{2060}\x{FEFF}\x{FF01}-\x{FF5E}"
#: Ordinary signs where they cost something, as pairs of code pages swap them for one another (é and Ú, í and ¡, ó and —):
#: wherever cost() is above 0, one of these is found, and a field without them never leaves the JVM.
_LETTER, _SMALL = r"A-Za-záéíóúüñÁÉÍÓÚÜÑº\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}", r"a-záéíóúüñ\x{FF41}-\x{FF5A}"
_ALNUM = _LETTER + r"0-9\x{FF10}-\x{FF19}"
ODD = r"(?=[^\x00-\x7F])(?:" + "|".join((
    f"[^{ORDINARY}]", f"(?<=[{_SMALL}])[ÁÉÍÓÚÜÑ]", f"(?<![{_LETTER}])[ñÑ](?![{_LETTER}])", f"(?<![0-9.nNoO])º|(?<=[nNoO])º(?=[{_LETTER}])",
    f"(?<=[{_ALNUM}])[¿¡«“‘]", r"[¿¡«“‘](?=[\s\x1C-\x1F\p{Zs}]|\z)", f"[»”’](?=[{_ALNUM}])", f"(?<=[{_LETTER}])[–—](?=[{_LETTER}])",
)) + ")"

_HOME = frozenset("áéíóúüñÁÉÍÓÚÜÑ")
_RARE = frozenset("ßþðÞÐƒ")
# Letters of that block which living languages of Europe and Asia write.
_EXTENDED = frozenset("ȘșȚțƠơƯưƏǍǎǐǑǒǓǔǦǧƁƂƉƊƎ")
_OPENING, _CLOSING = frozenset("¿¡«“‘"), frozenset("»”’")


def _sign_cost(c: str, before: str, after: str) -> float:
    kind = unicodedata.category(c)
    if c == "�" or "\x80" <= c <= "\x9f" or "─" <= c <= "▟":
        return 2.0
    if "\u0180" <= c <= "\u024f" and c not in _EXTENDED and c not in _RARE:  # letters no one writes, but for these
        return 2.0
    if kind in ("Lu", "Ll") and c <= "ɏ":
        cost = 0.0 if c in _HOME else 1.1 if c in _RARE else 0.4
        if kind == "Lu" and before.islower() and before.isalpha() and before not in "ºª":
            cost += 1.6
        if c in "ÃÂãâ" and after and not after.isalpha() and after > "\x7f" and after not in "«»“”‘’–—…":
            cost += 2.0
        if c in "ñÑ" and not before.isalpha() and not after.isalpha():
            cost += 1.0
        return cost
    if c in "ºª":
        return 0.0 if before.isdigit() or before == "." or before in "nNoO" and not after.isalpha() and c == "º" else 1.5
    if c in _OPENING:
        return 1.5 if before.isalnum() else 1.0 if not after or after.isspace() else 0.0
    if c in _CLOSING:
        return 1.5 if after.isalnum() and (c != "’" or not before.isalnum()) else 0.0
    if c == "…":
        return 0.0
    if c in "–—":
        return 0.5 if before.isalpha() and after.isalpha() else 0.0
    if c == "\xad":
        return 1.0
    if kind == "No":
        return 1.5 if after.isalpha() or before > "\x7f" else 0.25 if before.isalpha() else 0.0
    if kind[0] == "M" and not "\u0300" <= c <= "\u036f":
        return 1.0
    if "\u02b0" <= c <= "\u02ff":  # accents standing alone
        return 1.5
    if "Ͱ" <= c <= "ӿ" and kind[0] == "L":  # of another alphabet; within a Latin word it is odd, however it came there
        return 1.5 if any(x.isalpha() and x <= "ɏ" for x in (before, after)) else 0.0
    if kind[0] == "L" or kind[0] in "MZ" or kind in ("Cf", "Nd") or c >= "＀" and c <= "～":
        return 0.0
    if c in "±°×÷" and (after.isdigit() or before.isdigit()) and not before.isalpha() and not after.isalpha():
        return 0.0
    touches = before.isalnum() or after.isalnum() or before > "\x7f" or after > "\x7f"
    return 1.5 if touches else 0.25


def cost(text: str) -> float:
    """How garbled a text looks: 0 for Spanish as it is written."""
    if text.isascii():
        return 0.0
    last = len(text) - 1
    return sum(_sign_cost(c, text[i - 1] if i else "", text[i + 1] if i < last else "") for i, c in enumerate(text) if c > "\x7f")


@lru_cache(maxsize=None)
def _bytes_of(encoding: str) -> dict[str, int]:
    """Sign -> byte from 0x80 on; undefined bytes of an encoding stand for the control of that number, as browsers read them."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


@lru_cache(maxsize=None)
def _signs_of(encoding: str) -> dict[int, str]:
    return {b: c for c, b in _bytes_of(encoding).items()}


#: A sequence of UTF-8 that is longer than one byte, in bytes written as signs of the same number.
_SEQUENCE = re.compile("[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


def _as_utf8(text: str, encoding: str) -> str:
    """Every stretch that is strict UTF-8 read in ``encoding`` decoded, where that lowers the cost of its surroundings.

    A lead byte whose sign was put in the other case later (Ã as ã) is read as it was.
    """
    table = _bytes_of(encoding)
    mapped = "".join(chr(b) if (b := table.get(c)) else "\0" if c > "\x7f" else c for c in text)
    mapped = re.sub("[\xe2\xe3](?=[\x80-\xbf](?![\x80-\xbf]))", lambda m: chr(ord(m[0]) - 0x20), mapped) if encoding in ("latin-1", "cp1252") else mapped
    out, at = [], 0
    for m in re.finditer(f"(?:{_SEQUENCE.pattern})+", mapped):
        try:
            got = m[0].encode("latin-1").decode("utf-8")
        except UnicodeDecodeError:
            continue
        a, b = m.span()
        lead, tail = text[max(0, a - 1) : a], text[b : b + 1]
        if cost(lead + got + tail) < cost(lead + text[a:b] + tail):
            out += [text[at:a], got]
            at = b
    return "".join([*out, text[at:]])


#: A dash between letters that is none of the ñ and ó of Mac Roman: a ñ stands before a small vowel, an ó before a small letter.
_DASH = re.compile(r"(?<=[^\W\d_])(?:–(?![aeiouáéíóúü])|—(?![a-záéíóúüñ]))(?=[^\W\d_])")


# Where the letters stand that damage brings into words, in languages that write them.
_WRITTEN = {
    "ß": re.compile(r"(?<=[aeiouyäöüAEIOUÄÖÜ])ß"),
    "œ": re.compile(r"œ(?=[ui])|(?<![^\W\d_])œ(?=[ncsd])|(?<=f)œ(?=t)|(?<=c)œ(?=l)|(?<=m)œ(?=ll)", re.IGNORECASE),
    "Ÿ": re.compile(r"(?<![a-z])Ÿ"),
    "ƒ": re.compile(r"(?!)"),
    "à": re.compile(r"(?<![aeo])à|à(?=[^\W\d_])"),
}
_LETTERS = re.compile(r"[^\W\d_]+(?:(?:[-'’]|(?<=[lL])·(?=[lL]))[^\W\d_]+)*")
_EDGE = " \t\n¿?¡!«»“”„‘’\"'()[]{}.,;:…–—-/%*"


def plausible(word: str) -> bool:
    """Whether a word could be written so in some language of the Latin script: letters that are all small, all capitals, or
    small after a capital, and rare letters where they are at home. Marks at its ends do not count."""
    core = word.strip(_EDGE)
    if core.isascii():
        return True
    if not _LETTERS.fullmatch(core) or any(unicodedata.category(c) not in ("Lu", "Ll", "Lo") or c > "ɏ" for c in core if c > "\x7f" and c not in "’·"):
        return False
    if not all(part.isupper() or part[1:].islower() or len(part) == 1 for part in re.split("[-'’·]", core)):
        return False
    return all(len(at.findall(core)) == core.count(sign) for sign, at in _WRITTEN.items() if sign in core)


def _as_other(text: str, read_as: str, meant: str) -> str:
    """The words that look better when read in ``meant``, so read; all others stay.

    A word which is plausible as it stands changes only if AGREEING others, which are not, speak for the same pair.
    """
    table, signs = _bytes_of(read_as), _signs_of(meant)
    changes: dict[str, str] = {}
    surely = set()
    for old in set(re.findall(r"[^\s]+", text)):
        if old.isascii() or any(c > "\x7f" and c not in table for c in old) or read_as == "cp1252" and _DASH.search(old):
            continue
        new = "".join(signs[table[c]] if c > "\x7f" else c for c in old)
        a, b = cost(new), cost(old)
        if a < b or a == b == 0:
            changes[old] = new
            if a < b and not plausible(old):
                surely.add(old)
    if not surely:
        return text
    if len(surely) < AGREEING:
        changes = {w: changes[w] for w in surely}
    return re.sub(r"[^\s]+", lambda m: changes.get(m[0], m[0]), text)


def restore(text: str) -> tuple[str, bool]:
    """(the text as it was meant, as far as it can be restored; whether it was garbled).

    A replacement character, or a control that no decoding explains, is garbled beyond repair. Any other text counts as
    garbled only if a decoding lowers its cost by DROP, or by SMALL_DROP to nothing.
    """
    now, left = text, cost(text)
    while left > 0:  # every layer lowers the cost, so they end
        tries = [_as_utf8(now, e) for e in READ_AS] + [_as_other(now, *pair) for pair in SWAPPED]
        prices = [cost(t) for t in tries]
        best = min(range(len(tries)), key=lambda i: (prices[i], i))
        drop = left - prices[best]
        if drop < DROP and not (drop >= SMALL_DROP and prices[best] == 0):
            break
        now, left = tries[best], prices[best]
    broken = any(c == "�" or "\x80" <= c <= "\x9f" for c in now)
    return now, now != text or broken


def suspect(text: Column) -> Column:
    """Whether a text holds a sign that damage would leave, or has one where damage would put it; all others cost nothing."""
    return F.coalesce(text.rlike(ODD), F.lit(False))


def _repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        seen: dict[str, tuple[str, bool]] = {}
        got = [seen[t] if t in seen else seen.setdefault(t, restore(t)) for t in batch["texto"]]
        batch = batch.assign(restaurado=[g[0] for g in got])
        yield batch[[g[1] for g in got]]


def garbled(fields: DataFrame) -> DataFrame:
    """The garbled rows of ``fields`` (any columns, with ``texto``), each with ``restaurado``.

    Null, empty and ASCII texts are never garbled; they and all texts that cost nothing stay in the JVM. What cannot be
    restored (replacement characters) stays as it is within ``restaurado``.
    """
    ready(fields.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields.schema.fields) + ", restaurado string"
    return fields.where(suspect(F.col("texto"))).mapInPandas(_repair, schema)
