"""Sentences of texts in any script, with their places, in SQL expressions only.

Periods that end no sentence (decimals, file names, initials, abbreviations, numbers of headings, whatever stands within
quotation marks or brackets) are masked by private-use signs, one for one, so places keep. Ends are then found by the
rules of each script and marked by a further private-use sign; the text is cut at the marks and the pieces are measured.
A text is first cut into blocks (paragraphs and list items), so no expression looks beyond one. Nothing is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK, CUT, BREAK, INNER = "\ue000", "\ue001", "\ue002", "\ue003"

# Abbreviations which never end a sentence, in any case.
ABBREVIATIONS = (
    "sr sra srta sres dr dra dres dña excmo excma ilmo ilma rvdo capt cap cía cia avda av art arts pág pag págs páx pàg núm num nro "
    "aprox approx env ca cf chap sec fig vol ed ej ex vs mr mrs ms st lt sgt prof gral mme mlle nr abs bzw ggf bspw κ κα डॉ"
).split()
#: These end a sentence unless it goes on in a small letter.
OPEN_ABBREVIATIONS = ("etc", "usw", "uu", "ff", "jr", "μ", "m", "s")
MONTHS = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split()
HEADINGS = "tema capítulo capitulo lección unidad sección parte apartado chapter section part lesson unit kapitel teil chapitre leçon anexo".split()
UNITS = "minutos horas días metros millas segundos semanas meses años".split()
#: A sentence goes on after a quotation that is followed by one of these.
GOING_ON = "y e o u ni pero sin con luego and or but then before after et ou mais puis und oder aber".split()
PAIRS = (("«", "»"), ("“", "”"), ("„", "“"), ("「", "」"), ("『", "』"), ("(", ")"), ("（", "）"), ("[", "]"))

_SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_CLOSERS = r"»”’\"'」』）)\]“"
_EMOJI = r"[\x{2190}-\x{21FF}\x{2300}-\x{23FF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE0F}\x{200D}\x{20E3}\x{1F000}-\x{1FAFF}\x{E0020}-\x{E007F}]"
_ITEM = r"(?:[-*•·▪‣◦]\s|\(?\d{1,3}\)\s|\(?[a-zA-Z]\)\s)"
_ENDS = ".!?…。！？｡।॥؟۔;"


def _swap(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, pattern, by)


def _inside(text: Column, opening: str, closing: str, change, keep=None) -> Column:  # noqa: ANN001
    """``text`` with ``change`` applied to what stands between a mark and its next partner; unpaired marks do nothing."""

    def piece(s: Column, i: Column) -> Column:
        at = F.instr(s, closing)
        inner = F.substring(s, F.lit(1), at - 1)
        paired = (i > 0) & (at > 0) if keep is None else (i > 0) & (at > 0) & keep(inner)
        return F.when(paired, F.concat(change(inner), F.substring(s, at, F.length(s)))).otherwise(s)

    got = F.array_join(F.transform(F.split(text, F.lit("\\Q" + opening + "\\E"), -1), piece), opening)
    return F.when(text.contains(opening), got).otherwise(text)


def _inside_straight(text: Column, change) -> Column:  # noqa: ANN001
    """The same for straight quotation marks, which open and close by turns; the last of an odd number does nothing."""
    last = F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))
    got = F.array_join(F.transform(F.split(text, '"', -1), lambda s, i: F.when((i % 2 == 1) & (i < last), change(s)).otherwise(s)), '"')
    return F.when(text.contains('"'), got).otherwise(text)


def _steps(rows: DataFrame, name: str, steps: list) -> DataFrame:
    """``rows`` with the text column ``name`` put through each step. Each is a projection of its own, so a step may use its
    input more than once without running what comes before it again."""
    for step in steps:
        rows = rows.withColumn(name, step(F.col(name)))
    return rows


def _pieces(rows: DataFrame, text: str, start: str, piece: str) -> DataFrame:
    """One row per piece between the cuts of the column ``text``, with the piece and its place; ``text`` goes.

    Places are sums over runs of 64 pieces and within a run: near linear for any number of pieces.
    """
    run, zero = 64, F.lit(0).cast("bigint")
    total = lambda a: F.aggregate(a, zero, lambda x, y: x + y)
    rows = rows.withColumn("_p", F.split(text, CUT, -1)).drop(text).withColumn("_n", F.transform("_p", lambda s: F.length(s).cast("bigint")))
    rows = rows.withColumn("_r", F.transform(F.sequence(F.lit(0), F.floor((F.size("_n") - 1) / run).cast("int")), lambda k: total(F.slice("_n", k * run + 1, run))))
    part = lambda i: F.floor(i / run).cast("int")
    place = lambda x, i: total(F.slice("_r", 1, part(i))) + total(F.slice("_n", part(i) * run + 1, i % run))
    # The sizes are asked for so that the arrays stay columns, made once a row and not once a piece.
    rows = rows.withColumn("_s", F.when((F.size("_r") > 0) & (F.size("_n") > 0), F.transform("_n", place)))
    others = [c for c in rows.columns if c not in ("_p", "_n", "_r", "_s")]
    return rows.select(*others, F.inline(F.arrays_zip("_s", "_p")).alias(start, piece))


def _flat(s: Column) -> Column:
    return F.replace(s, F.lit("\n"), F.lit(BREAK))


def _hidden(s: Column) -> Column:
    return _swap(s, f"[{_ENDS}]", INNER)


def _any(words: tuple | list) -> str:
    return "(?:" + "|".join(words) + ")"


def _by_first(words: tuple | list) -> str:
    """``_any``, sorted by first letters, so that a word is held against those of its own letter only."""
    firsts: dict[str, list[str]] = {}
    for w in words:
        firsts.setdefault(w[0], []).append(w[1:])
    return _any([f + _any(rest) for f, rest in firsts.items()])


def _has(c: Column, signs: str) -> Column:
    """Whether any of a few signs occurs: a search of bytes each, much cheaper than a pattern."""
    test = c.contains(signs[0])
    for sign in signs[1:]:
        test = test | c.contains(sign)
    return test


def _where(test, change):  # noqa: ANN001, ANN202
    """A step that is taken only where the test holds: tests are cheap, and most rules concern few texts."""
    return lambda c: F.when(test(c), change(c)).otherwise(c)


#: Cuts after blank lines and before list items on a new line, but not within quotations.
BLOCKS = [
    _where(lambda c: _has(c, MASK + CUT + BREAK + INNER), lambda c: _swap(c, f"[{MASK}-{INNER}]", "\ufffd")),
    _where(lambda c: _has(c, "\r\x85\u2028\u2029"), lambda c: _swap(c, "[\r\x85\u2028\u2029](?<!\r(?=\n))", "\n")),
    *(lambda c, p=p: _inside(c, *p, _flat, lambda s: ~s.rlike(r"\n[ \t\r\x{A0}]*\n")) for p in PAIRS[:2]),
    lambda c: _swap(c, rf"(\n{_SPACE}*\n{_SPACE}*)(?=\S)", "$1" + CUT),
    lambda c: _swap(c, rf"(\n[ \t\x{{A0}}]*)(?={_ITEM})", "$1" + CUT),
]

#: Periods that end no sentence: every pattern starts at the period, which is rarer than any letter. These look at the text
#: as it is and so make one pattern; those of _AFTER also look at what these have masked.
_NO_ENDS = [
    r"\.(?<=[\p{L}\p{M}\p{N}]\.)(?=[\p{L}\p{N}])",  # decimals, times, file names, hosts, a.m, U.S
    rf"(?iu)\.(?<=(?<![\p{{L}}\p{{N}}]){_by_first(ABBREVIATIONS)}\.)",
    r"(?iu)\.(?<=(?<![\p{L}\p{N}])p\.)(?=\s+(?:ej|ex)\W)",
    r"(?i)\.(?<=(?<![\p{L}\p{N}])[dz]\.)(?=\s*[hb]\.)",
    r"\.(?<=(?<![\p{L}\p{N}])EE\.)(?=\s*UU\.)",
    rf"\.(?<=(?<![\p{{L}}\p{{N}}])(?iu:{_any(OPEN_ABBREVIATIONS)})\.)(?=\s*[,;:)]|\s+\p{{Ll}})",
    r"\.(?<=(?<![\p{L}\p{N}])v\.)(?=\s+(?:\p{Ll}|\d))",
    r"\.(?<=(?<!['′º°]\s)(?<!\d\s)(?<![\p{L}\p{N}'′])\p{Lu}\.)(?=\s+\p{L})",  # initials, but not the points of a position
    rf"(?i)\.(?<=(?<![\p{{L}}\p{{N}}])no?\.)(?=\s*\d+(?!\d)(?!\s+{_any(UNITS)}))",
    rf"(?iu)\.(?<=\d\.)(?=\s+{_any(MONTHS)}(?!\p{{L}}))",
]
_AFTER = [
    rf"(?i)\.(?<=[hb]\.)(?<=(?<![\p{{L}}\p{{N}}])[dz]{MASK}\s{{0,2}}[hb]\.)",
    rf"\.(?<={MASK}\p{{L}}\.)(?=\s*[,;:)]|\s+[^\p{{Lu}}\s«“\"¿¡(])",
    rf"\.(?<!\p{{L}}\p{{L}}\.)(?<=(?:^\s{{0,4}}|[.!?…»”\"{MASK}]\s{{1,4}})\p{{Ll}}\.)(?=\s+\p{{Lu}})",
]


def _one(patterns: list[str]) -> str:
    """One pattern for all, with the period that each starts at in front; each keeps its own flags."""
    parts = [re.fullmatch(r"(?:\(\?(\w+)\))?\\\.(.*)", p).groups() for p in patterns]
    return r"\." + _any([f"(?{flags or ''}:{rest})" for flags, rest in parts])


_CAPITALS = r"^[^\p{Ll}]*\p{Lu}{3}[^\p{Ll}]*$"
_ITEM_BLOCK = rf"^{_SPACE}*{_ITEM}"
#: After these, no sign of an end is left in a block that ends no sentence. A list item is one sentence as it is.
MASKS = [
    lambda c: F.when(c.rlike(_ITEM_BLOCK), _hidden(c)).otherwise(c),
    *(lambda c, p=p: _inside(c, *p, _hidden) for p in PAIRS),
    lambda c: _inside_straight(c, _hidden),
    lambda c: F.when(c.contains("."), _swap(c, _one(_NO_ENDS), MASK)).otherwise(c),
    lambda c: F.when(c.contains("."), _swap(c, _one(_AFTER), MASK)).otherwise(c),
    # Within capitals only, the case of the next letter tells nothing.
    lambda c: F.when(F.col(_CAPS), _swap(c, rf"\.(?<=(?:{MASK}\p{{L}}|(?<!\p{{L}})UU)\.)(?=\s+\p{{L}})", MASK)).otherwise(c),
    lambda c: _swap(c, rf"(?iu)^({_SPACE}*{_any(HEADINGS)}\s+[\dIVXLC]+)\.", "$1" + MASK),
    lambda c: _swap(c, rf"^({_SPACE}*\d+(?:{MASK}\d+)*)\.(?=\s)", "$1" + MASK),
]

_TAIL = rf"[{_CLOSERS}]*+(?:\s[»])?+(?:{_SPACE}*+{_EMOJI}++)*+"
_QUOTED = rf"{INNER}\s?[»”’\"」』“]++(?:{_SPACE}*+{_EMOJI}++)*+"
#: Columns made once for a block: whether it is in capitals, and whether it has signs of the scripts with rules of their own.
_CAPS, _SCRIPTS = "_caps", "_scripts"
_OTHER_SCRIPTS = r"[।॥؟۔。！？｡」』\p{IsThai}]"
_capitals, _scripts = (lambda c: F.col(_CAPS)), (lambda c: F.col(_SCRIPTS))
_inner = lambda c: c.contains(INNER)
_dashes = lambda c: c.contains("—") | c.contains("–")
#: Cuts after every sentence of a masked block.
CUTS = [
    lambda c: _swap(c, rf"(?=[!?.…;])((?:[!?.…]|;(?<=\p{{IsGreek}};))+{_TAIL}{_SPACE}++)(?=\S)", "$1" + CUT),
    # Not after dots of suspense before a small letter, nor before what a speaker's dash adds.
    _where(lambda c: c.contains("..") | c.contains("…"), lambda c: _swap(c, rf"{CUT}(?<=(?:\.\.|…)[{_CLOSERS}]{{0,3}}{_SPACE}{{1,4}}{CUT})(?=\p{{Ll}}|(?iu:{_any(GOING_ON)})\s)", "")),
    _where(_dashes, lambda c: _swap(c, rf"{CUT}(?=[—–]\s?\p{{Ll}})", "")),
    _where(_scripts, lambda c: _swap(c, rf"([।॥؟۔]++{_TAIL}{_SPACE}*+)(?=\S)", "$1" + CUT)),
    _where(_scripts, lambda c: _swap(c, rf"([。！？｡]++[»”’」』）)]*+(?:{_SPACE}*+{_EMOJI}++)*+{_SPACE}*+)(?=\S)", "$1" + CUT)),
    # A quotation that ends with an end: a new sentence follows if it looks like one.
    _where(_inner, lambda c: _swap(c, rf"({_QUOTED}{_SPACE}+)(?=[\p{{Lu}}\p{{Lt}}\p{{N}}¿¡«“„\"(—]|[\p{{IsHan}}\p{{IsHiragana}}\p{{IsKatakana}}])(?!(?iu:{_any(GOING_ON)})\s)", "$1" + CUT)),
    _where(_capitals, lambda c: _swap(c, rf"(^|{CUT})({_SPACE}*[\"«“„][^\"«»“”„{CUT}]*{_QUOTED}{_SPACE}+){CUT}", "$1$2")),
    _where(_inner, lambda c: _swap(c, rf"({INNER}[」』”])(?=[「『“])", "$1" + CUT)),
    _where(_inner, lambda c: _swap(c, rf"((?:^|{CUT}){_SPACE}*[(（][^()（）{CUT}]*{INNER}[)）]{_SPACE}+)(?=[\p{{Lu}}¿¡«“„\"])", "$1" + CUT)),
    _where(_capitals, lambda c: _swap(c, rf"{CUT}(?=[—–]\p{{L}})", "")),
    _where(lambda c: c.contains(INNER + '"'), lambda c: _swap(c, rf"([:,]\s\"[^\"{CUT}]*{INNER}\"{_SPACE}+)(?=\p{{Ll}})(?!{_any(GOING_ON)}\s)", "$1" + CUT)),
    # Thai: every space.
    _where(_scripts, lambda c: _swap(c, rf"({_SPACE}+)(?=\p{{IsThai}})|(?<=\p{{IsThai}})({_SPACE}+)(?!\p{{IsThai}})", "$1$2" + CUT)),
]


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, start_char, end_char, oracion): one row per sentence, offsets in code points, the end exclusive.

    Null, empty and blank texts give no row; repeated rows give their sentences again. Texts of any length are read whole.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_text").rlike(r"\S")).withColumn("_b", F.col("_text"))
    rows = _pieces(_steps(rows, "_b", BLOCKS), "_b", "_block", "_c").where(F.col("_c").rlike(r"\S"))
    rows = rows.withColumns({_CAPS: F.col("_c").rlike(_CAPITALS), _SCRIPTS: F.col("_c").rlike(_OTHER_SCRIPTS)})
    rows = _pieces(_steps(rows, "_c", MASKS + CUTS), "_c", "_at", "_o")
    around = rf"[{_SPACE[1:-1]}{BREAK}]+"
    rows = rows.withColumn("_lead", F.length("_o") - F.length(_swap(F.col("_o"), "^" + around, "")))
    rows = rows.withColumn("_start", (F.col("_block") + F.col("_at") + F.col("_lead")).cast("bigint"))
    rows = rows.withColumn("_len", F.length(_swap(F.col("_o"), f"^{around}|{around}$", ""))).where(F.col("_len") > 0)
    return rows.select(F.col("_id").alias(id_col), F.col("_start").alias("start_char"), (F.col("_start") + F.col("_len")).alias("end_char"), F.substring("_text", F.col("_start").cast("int") + 1, F.col("_len")).alias("oracion"))
