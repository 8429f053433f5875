"""Text that looks the same but differs in its characters, brought to one form.

Look-alikes are pairs of strings: full-width and ordinary forms, letters written with combining marks and composed ones,
spaces of all kinds, invisible signs and nothing, letters of Cyrillic, Greek and Armenian and the Latin ones of the same shape.
Union-find makes them transitive classes; of a class's plain members the commonest in the corpus stands for it; an automaton
over all members rewrites a text greedily, the longest member first. Letters of another script are rewritten only within
words that mix them with Latin. A field is a case if the rewriting changes it or leaves a sign that no class explains.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizlake.functions.matching import DisjointSets
from quizlake.llm.mojibake import restore
from quizlake.session import ready

# Letters of the same shape, Latin first, by script.
CYRILLIC = {"A": "А", "B": "В", "C": "С", "E": "Е", "H": "Н", "I": "ІӀ", "J": "Ј", "K": "К", "M": "М", "O": "О", "P": "Р", "S": "Ѕ", "T": "Т", "X": "Х", "Y": "УҮ", "Q": "Ԛ", "W": "Ԝ", "G": "Ԍ", "a": "а", "c": "с", "d": "ԁ", "e": "е", "h": "һ", "i": "і", "j": "ј", "l": "ӏ", "o": "о", "p": "р", "q": "ԛ", "s": "ѕ", "v": "ѵ", "w": "ԝ", "x": "х", "y": "уү", "k": "к", "m": "м", "t": "т", "b": "Ь", "r": "г", "n": "п", "u": "и"}
GREEK = {"A": "Α", "B": "Β", "E": "Ε", "F": "Ϝ", "H": "Η", "I": "Ι", "J": "Ϳ", "K": "Κ", "M": "Μ", "N": "Ν", "O": "Ο", "P": "Ρ", "T": "Τ", "X": "Χ", "Y": "Υ", "Z": "Ζ", "a": "α", "c": "ϲ", "i": "ι", "j": "ϳ", "k": "κ", "n": "η", "o": "ο", "p": "ρ", "t": "τ", "u": "υ", "v": "ν", "w": "ω", "x": "χ", "y": "γ"}
ARMENIAN = {"h": "հ", "n": "ո", "o": "օ", "u": "ս", "g": "ց", "q": "զ", "O": "Օ", "S": "Տ", "U": "Ս", "L": "Լ"}
INVISIBLE = tuple(map(chr, (0xAD, 0x34F, 0x180E, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0x2061, 0x2062, 0x2063, 0x2064, 0xFEFF)))
SPACES = tuple(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))
JOINER = "\u200d"
#: Composed letters are derived for these ranges of code points.
COMPOSED = ((0xC0, 0x250), (0x370, 0x530), (0x1E00, 0x2000))
#: Full-width forms of signs outside the run that is its ASCII sign plus a constant.
WIDE = (*range(0xFF5F, 0xFF61), *range(0xFFE0, 0xFFE7))

_FULL_WIDTH = r"[\x{FF01}-\x{FF60}\x{FFE0}-\x{FFE6}]"
_INVISIBLE = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in INVISIBLE) + "]"
_OTHER_LETTER = r"[\p{L}&&[^\p{IsLatin}\p{IsCommon}\p{IsInherited}]]"
#: A text without any of these signs holds no member of a class but the plain one.
_SIGNS = rf"[\x{{FF01}}-\x{{FF60}}\x{{FFE0}}-\x{{FFE6}}\p{{M}}{_INVISIBLE[1:-1]}[\p{{Zs}}&&[^ ]]{_OTHER_LETTER}]"

_WORD = regex.compile(r"[\p{L}\p{N}]+")
_LATIN, _OTHER = regex.compile(r"\p{Latin}"), regex.compile(r"[\p{L}--\p{Latin}--\p{Common}--\p{Inherited}]", regex.V1)
#: Kind of deviation -> pattern that finds it.
KINDS = {
    "ancho": regex.compile("[\uff01-\uff60\uffe0-\uffe6]"),
    "combinado": regex.compile(r"\p{M}"),
    "invisible": regex.compile("[" + "".join(INVISIBLE) + "]"),
    "espacio": regex.compile(r"[\p{Zs}--[ ]]", regex.V1),
}
#: Joined emoji: a joiner between them is part of the sign and stays.
_EMOJI = regex.compile(r"(?<=\p{Extended_Pictographic}[\p{EMod}\ufe0f]?)\u200d(?=\p{Extended_Pictographic})")
_KEPT = "\ue000"


def kinds(text: str) -> list[str]:
    """The kinds of deviation in a text; none in ordinary text."""
    out = [kind for kind, pattern in KINDS.items() if pattern.search(text)]
    return out + ["mezcla"] if any(mixed(w) for w in _WORD.findall(text)) else out


def mixed(word: str) -> bool:
    """Whether a word has Latin letters and such of another script."""
    return not word.isascii() and bool(_LATIN.search(word) and _OTHER.search(word))


def suspect(text: Column) -> Column:
    """Whether a text holds a sign that a class may rewrite; every case does."""
    return F.coalesce(text.rlike(_SIGNS), F.lit(False))


@lru_cache(maxsize=None)
def pairs() -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(look-alikes that hold anywhere, look-alikes that hold within mixed words)."""
    free = [(chr(c), chr(c - 0xFEE0)) for c in range(0xFF01, 0xFF5F)] + [(s, " ") for s in SPACES] + [(z, "") for z in INVISIBLE]
    free += [(chr(c), unicodedata.normalize("NFKC", chr(c)).strip() if c != 0xFFE3 else "¯") for c in WIDE]
    for low, high in COMPOSED:
        for c in map(chr, range(low, high)):
            parts = unicodedata.normalize("NFD", c)
            if len(parts) > 1 and unicodedata.normalize("NFC", parts) == c:
                free.append((parts, c))
                if len(parts) > 2:  # also with only the last mark apart
                    free.append((unicodedata.normalize("NFC", parts[:-1]) + parts[-1], c))
    shapes = [(other, latin) for table in (CYRILLIC, GREEK, ARMENIAN) for latin, others in table.items() for other in others]
    return free, shapes


def classes(within_mixed: bool) -> list[list[str]]:
    """The transitive classes of look-alikes."""
    free, shapes = pairs()
    sets = DisjointSets()
    for a, b in free + (shapes if within_mixed else []):
        sets.join(a, b)
    return list(sets.classes().values())


def plain(member: str) -> bool:
    """Whether a member may stand for its class: it is no deviation itself."""
    return not any(pattern.search(member) for pattern in KINDS.values())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(s, n) of every sign below U+10000, and of every letter with marks; the signs of _TEXTS texts are counted at once."""
    signs = np.zeros(0x10000, np.int64)
    several: Counter[str] = Counter()
    for batch in batches:
        texts = [t for t in batch.column(0).to_pylist() if t]
        for low in range(0, len(texts), _TEXTS):
            codes = np.frombuffer("".join(texts[low : low + _TEXTS]).encode("utf-32-le", "surrogatepass"), np.uint32)
            signs += np.bincount(codes[codes < 0x10000], minlength=0x10000)
        for t in texts:
            if not t.isascii():
                several.update(_SEVERAL.findall(t))
    found = np.flatnonzero(signs)
    names = [chr(c) if not 0xD800 <= c < 0xE000 else "" for c in found.tolist()] + list(several)
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([*signs[found].tolist(), *several.values()], pa.int64())], ["s", "n"])


_TEXTS = 500
_SEVERAL = regex.compile(r"\p{L}\p{M}+")


def frequencies(fields: DataFrame) -> dict[str, int]:
    """How often each member of a class occurs in all of ``texto``. Counted in the cluster; only members reach the driver."""
    members = sorted({m for group in classes(True) for m in group if m})
    counts = fields.select("texto").mapInArrow(_counted, "s string, n long").where(F.col("s").isin(members)).groupBy("s").agg(F.sum("n").alias("n"))
    return {r["s"]: r["n"] for r in counts.collect()}


def rewriting(counts: dict[str, int], within_mixed: bool) -> dict[str, str]:
    """Member -> the commonest plain member of its class; ties and unseen classes go to the plainest (shortest, lowest) one.

    Nothing stands for what is invisible.
    """
    out = {}
    for group in classes(within_mixed):
        best = "" if "" in group else min(filter(plain, group), key=lambda m: (-counts.get(m, 0), len(m.encode()), m))
        out |= {m: best for m in group if m and m != best}
    return out


def automaton(table: dict[str, str]) -> ahocorasick.Automaton:
    got = ahocorasick.Automaton()
    for member, best in table.items():
        got.add_word(member, (len(member), best))
    got.make_automaton()
    return got


def rewrite(text: str, anywhere: ahocorasick.Automaton, in_mixed: ahocorasick.Automaton) -> str:
    """The consistent form of a text."""

    def through(part: str, by: ahocorasick.Automaton) -> str:
        out, at = [], 0
        for end, (n, best) in by.iter_long(part):
            out += [part[at : end + 1 - n], best]
            at = end + 1
        return "".join([*out, part[at:]])

    if JOINER in text:
        text = _EMOJI.sub(_KEPT, text.replace(_KEPT, "\ufffd"))
    text = through(text, anywhere).replace(_KEPT, JOINER)
    return _WORD.sub(lambda m: through(m[0], in_mixed) if mixed(m[0]) else m[0], text)


def consistent(fields: DataFrame) -> DataFrame:
    """The rows of ``fields`` (any columns, with ``texto``) that deviate, with ``forma``, ``clases`` and ``restantes``.

    ``forma`` is the text rewritten by the automata; a row is a case if that changes it, or if ``forma`` still has deviations.
    ``clases`` are the kinds of deviation of the text, ``restantes`` those of ``forma``: a word that stays mixed, a mark no
    letter takes, and the joiners and selectors of emoji, which stay. Garbled texts (wrong encoding) are no case and are
    left out. Null, empty and ordinary texts give no row and never leave the JVM.
    """
    ready(fields.sparkSession)
    counts = frequencies(fields)
    anywhere, in_mixed = rewriting(counts, False), rewriting(counts, True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, two = automaton(anywhere), automaton(in_mixed)
        for batch in batches:
            forms = [rewrite(t, one, two) for t in batch["texto"]]
            batch = batch.assign(forma=forms, clases=[[]] * len(forms), restantes=[kinds(f) for f in forms])
            batch = batch[[(f != t or bool(left)) and not restore(t)[1] for t, f, left in zip(batch["texto"], forms, batch["restantes"])]]
            yield batch.assign(clases=[kinds(t) for t in batch["texto"]])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields.schema.fields) + ", forma string, clases array<string>, restantes array<string>"
    return fields.where(suspect(F.col("texto"))).mapInPandas(run, schema)
