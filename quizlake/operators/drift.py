"""Schemas that drift between the files of a feed: profiles, changes, and one table over all of them.

1. Every file's fields are profiled: types, share of distinct values, and a bottom-k sketch of the values. Each task
   folds its records into partial profiles before anything is shuffled; the forms of values are sketched likewise.
2. A file is compared with the one before it in its feed. The neighbours are found chunk by chunk of time, so a feed that
   holds most files is never one task.
3. Fields that went and fields that came are matched (cheapest assignment) on the overlap of their values, the overlap of
   the values which those names have in the whole corpus, types, and names. A matched pair is a rename.
4. Renames link names to columns; the records of all files come out under one name per column.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizlake.functions.matching import DisjointSets, assignment
from quizlake.session import ready, stage

#: Values kept by a sketch.
SKETCH = 64
#: Partial profiles that a task keeps before it hands them on.
FOLD = 20_000
#: Least similarity of a rename.
RENAMED = 0.35
#: Width of a chunk of a feed's files.
CHUNK_SECONDS = 30 * 86_400
#: Least share of what either of two names ever did in renames that links them.
LINKED = 0.1
TYPES = ("string", "whole", "decimal", "list", "other")

_PROFILE = "feed string, archivo_id long, exportado_at timestamp_ntz, campo string, n long, tipos array<long>, valores array<long>, formas array<long>"
_PAIR = "archivo_id long, viejo string, nuevo string, parecido double"


def record(payload: str | None) -> dict | None:
    """The object in a payload; None for what is no JSON, or JSON but no object."""
    if payload is None:
        return None
    try:
        got = json.loads(payload)
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def leaves(obj: dict) -> Iterator[tuple[str, object]]:
    """(dotted path, value) of every leaf; lists are leaves. Works for any depth."""
    todo = [("", obj)]
    while todo:
        prefix, at = todo.pop()
        for key, value in at.items():
            if isinstance(value, dict):
                todo.append((f"{prefix}{key}.", value))
            else:
                yield prefix + key, value


def kind(value: object) -> int:
    """Place in TYPES. true and false are of the type other."""
    if isinstance(value, bool):
        return 4
    return 0 if isinstance(value, str) else 1 if isinstance(value, int) else 2 if isinstance(value, float) else 3 if isinstance(value, list) else 4


def plain(value: object) -> str:
    """A value as text, alike for all its types: 2020, 2020.0, "2020" and [2020] agree."""
    while isinstance(value, list) and len(value) == 1:
        value = value[0]
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e15:
        value = int(value)
    return value.strip() if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)


class _Shapes(dict):
    """Code point -> 9 for digits, a for letters, itself for others; filled as signs are met."""

    def __missing__(self, c: int) -> int:
        sign = chr(c)
        self[c] = got = 57 if sign.isdecimal() else 97 if sign.isalpha() else c
        return got


_SHAPES = _Shapes()
_DIGIT, _LETTERS = re.compile(r"\d"), re.compile("a{2,}")


def form(text: str) -> str:
    """The form of a written value if it tells much: digits as 9, runs of letters as a, with three signs or more and a digit; else empty."""
    if not _DIGIT.search(text):
        return ""
    got = _LETTERS.sub("a", text.translate(_SHAPES))
    return got if len(got) >= 3 else ""


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _keep(sketch: set[int], value: int) -> set[int]:
    """``sketch`` with ``value``; whatever the order of values, its SKETCH smallest ones are those of all values."""
    sketch.add(value)
    return sketch if len(sketch) <= 4 * SKETCH else set(sorted(sketch)[:SKETCH])


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict = {}

    def out() -> pd.DataFrame:
        rows = [(*key, n, kinds, sorted(values)[:SKETCH], sorted(forms)[:SKETCH]) for key, (n, kinds, values, forms) in held.items()]
        held.clear()
        return pd.DataFrame(rows, columns=["feed", "archivo_id", "exportado_at", "campo", "n", "tipos", "valores", "formas"])

    for batch in batches:
        for feed, file, at, payload in zip(batch["feed"], batch["archivo_id"], batch["exportado_at"], batch["payload"]):
            got = record(payload)
            if got is None:
                continue
            for path, value in leaves(got):
                if value is None:
                    continue
                mine = held.setdefault((feed, file, at, path), [0, [0] * len(TYPES), set(), set()])
                mine[0] += 1
                mine[1][kind(value)] += 1
                text = plain(value)
                mine[2] = _keep(mine[2], _hash(text))
                if shape := form(text):
                    mine[3] = _keep(mine[3], _hash(shape))
            if len(held) > FOLD:
                yield out()
    if held:
        yield out()


def _merged(sketches: str) -> Column:
    """The bottom-k sketch of a group's sketches."""
    return F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(sketches)))), 1, SKETCH)


def _fold_names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[str, np.ndarray] = {}

    def out() -> pd.DataFrame:
        got = pd.DataFrame({"campo": list(held), "dominio": list(held.values())})
        held.clear()
        return got

    for batch in batches:
        for name, values in batch.groupby("campo")["valores"]:
            parts = [held[name], *values] if name in held else list(values)
            held[name] = np.unique(np.concatenate(parts))[:SKETCH]
        if len(held) > FOLD:
            yield out()
    if held:
        yield out()


def domains(profiled: DataFrame) -> DataFrame:
    """(campo, dominio): the sketch of all values that a name has in the whole corpus.

    Files' sketches are merged within every task first, so what meets in one group grows with the tasks, not with the files.
    """
    parts = profiled.select("campo", "valores").mapInPandas(_fold_names, "campo string, dominio array<long>")
    return parts.groupBy("campo").agg(_merged("dominio").alias("dominio"))


def profile(raw: DataFrame) -> DataFrame:
    """One row per file and field with any value: (feed, archivo_id, exportado_at, campo, n, tipo, varia, valores, formas).

    ``raw`` has feed, archivo_id, exportado_at and payload; rows without a file, and payloads which are no JSON object,
    count for nothing. ``tipo`` is the commonest type, ties going to the first in TYPES. ``varia`` is 0 if
    the field stands still and 1 if no value comes twice, null of a single value; the number of distinct values is exact
    while they fit the sketch, estimated from it beyond.
    """
    ready(raw.sparkSession)
    parts = raw.where(F.col("archivo_id").isNotNull()).select("feed", F.col("archivo_id").cast("long").alias("archivo_id"), F.col("exportado_at").cast("timestamp_ntz").alias("exportado_at"), "payload").mapInPandas(_fold, _PROFILE)
    sums = [F.sum(F.col("tipos")[i]).alias(f"_{i}") for i in range(len(TYPES))]
    one = parts.groupBy("archivo_id", "campo").agg(F.min("feed").alias("feed"), F.min("exportado_at").alias("exportado_at"), F.sum("n").alias("n"), *sums, _merged("valores").alias("valores"), _merged("formas").alias("formas"))
    most = F.greatest(*(F.col(f"_{i}") for i in range(len(TYPES))))
    tipo = F.coalesce(*(F.when(F.col(f"_{i}") == most, F.lit(t)) for i, t in enumerate(TYPES)))
    full = F.size("valores") >= SKETCH
    reach = (F.element_at("valores", -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    distinct = F.when(full, F.least(F.lit(SKETCH - 1) / F.greatest(reach, F.lit(1e-18)), F.col("n").cast("double"))).otherwise(F.size("valores").cast("double"))
    return one.select("feed", "archivo_id", "exportado_at", "campo", "n", tipo.alias("tipo"), F.try_divide(distinct - 1, F.col("n") - 1).alias("varia"), "valores", "formas")


def consecutive(files: DataFrame, group: str, order: tuple[str, str], payload: str, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """``files`` with ``_before``: struct(order[1], payload) of the file before in its group by ``order``, null for the first.

    The order is by a time and then a number. Files are numbered within chunks of time only; what crosses from one chunk
    to the next is one row per chunk. Null times come first.
    """
    at, number = order
    seconds = F.unix_timestamp(F.col(at).cast("timestamp"))
    chunked = files.withColumn("_chunk", F.coalesce(F.floor(seconds / chunk_seconds), F.lit(-(1 << 40))))
    near = Window.partitionBy(group, "_chunk").orderBy(F.col(at).asc_nulls_first(), number)
    inner = chunked.withColumn("_near", F.lag(F.struct(number, payload)).over(near))
    place = F.struct(F.coalesce(F.col(at), F.lit("0001-01-01").cast("timestamp_ntz")), F.col(number))
    last = chunked.groupBy(group, "_chunk").agg(F.max_by(F.struct(number, payload), place).alias("_last"))
    last = last.withColumn("_far", F.lag("_last").over(Window.partitionBy(group).orderBy("_chunk"))).select(F.col(group).alias("_g"), F.col("_chunk").alias("_c"), "_far")
    out = inner.join(last, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_chunk") == F.col("_c")), "left")
    return out.withColumn("_before", F.coalesce("_near", "_far")).drop("_g", "_c", "_chunk", "_near", "_far")


def _overlap(a: list[int], b: list[int]) -> float:
    """Jaccard similarity of two value sets from their bottom-k sketches."""
    x, y = set(a), set(b)
    if not x or not y:
        return 0.0
    seen = sorted(x | y)[:SKETCH]
    return sum(v in x and v in y for v in seen) / len(seen)


def _name_likeness(a: str, b: str) -> float:
    x, y = a.rpartition(".")[2].lower(), b.rpartition(".")[2].lower()
    return 1.0 if x == y else SequenceMatcher(None, x, y).ratio()


def likeness(old: dict, new: dict) -> float:
    """0 to 1: how surely ``new`` carries on what ``old`` held.

    Values weigh most: those of the two files, those which the two names have in the whole corpus, or, less, their forms. Fields whose values
    vary in one file and stand still in the other are not the same. Names and types settle the rest.
    """
    here, ever = _overlap(old["valores"], new["valores"]), _overlap(old["dominio"], new["dominio"])
    values = max(here, ever, 0.6 * _overlap(old["formas"], new["formas"]))
    name = _name_likeness(old["campo"], new["campo"])
    vary = (old["varia"], new["varia"])
    apart = abs(vary[0] - vary[1]) if all(v is not None and v == v for v in vary) else 0.0
    same_type = 1.0 if old["tipo"] == new["tipo"] else 0.6
    if values < 0.05 and name < 0.8:
        return 0.0
    score = 0.75 * values + 0.15 * name + 0.10 * same_type
    if name == 1.0:
        score = max(score, 0.6 if values > 0 or old["tipo"] == new["tipo"] else 0.5)
    return max(0.0, score - 0.8 * max(0.0, apart - 0.35))


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for file, fields in zip(batch["archivo_id"], batch["campos"]):
            fields = sorted(fields, key=lambda f: f["campo"])
            gone, came = [f for f in fields if f["lado"] == "gone"], [f for f in fields if f["lado"] == "came"]
            if not gone or not came:
                continue
            score = [[likeness(o, n) for n in came] for o in gone]
            # Each old field may also stay unmatched, at the price of the least similarity.
            cost = [[-s for s in row] + [-RENAMED if i == j else 0.0 for j in range(len(gone))] for i, row in enumerate(score)]
            for i, j in enumerate(assignment(cost)):
                if j < len(came) and score[i][j] >= RENAMED:
                    rows.append((file, gone[i]["campo"], came[j]["campo"], score[i][j]))
        yield pd.DataFrame(rows, columns=["archivo_id", "viejo", "nuevo", "parecido"])


def compare(profiled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From staged profiles: the renames (archivo_id, viejo, nuevo, parecido), and the files with their neighbours' fields."""
    fields = F.map_from_entries(F.array_sort(F.collect_list(F.struct("campo", "tipo"))))
    files = profiled.groupBy("archivo_id").agg(F.min("feed").alias("feed"), F.min("exportado_at").alias("exportado_at"), fields.alias("campos"))
    pairs = consecutive(files, "feed", ("exportado_at", "archivo_id"), "campos").where(F.col("_before").isNotNull())
    pairs = pairs.select("archivo_id", "campos", F.col("_before.archivo_id").alias("anterior"), F.col("_before.campos").alias("antes"))
    pairs = pairs.withColumn("_gone", F.array_except(F.map_keys("antes"), F.map_keys("campos"))).withColumn("_came", F.array_except(F.map_keys("campos"), F.map_keys("antes")))
    pairs = stage(pairs, "pairs")
    both = pairs.where((F.size("_gone") > 0) & (F.size("_came") > 0))

    def side(lado: str, source: str, names: str) -> DataFrame:
        return both.select("archivo_id", F.col(source).alias("_file"), F.lit(lado).alias("lado"), F.explode(names).alias("campo"))

    wanted = side("gone", "anterior", "_gone").unionByName(side("came", "archivo_id", "_came"))
    sketches = profiled.select(F.col("archivo_id").alias("_file"), "campo", "tipo", "varia", "valores", "formas")
    full = wanted.join(sketches, ["_file", "campo"]).join(domains(profiled), "campo")
    sets = full.groupBy("archivo_id").agg(F.collect_list(F.struct("lado", "campo", "tipo", "varia", "valores", "formas", "dominio")).alias("campos"))  # a file's fields
    return stage(sets.mapInPandas(_solve, _PAIR), "renames"), pairs


def changes(profiled: DataFrame) -> DataFrame:
    """(archivo_id, campo, cambio) of every change from one file of a feed to the next.

    ``cambio``: added, removed, renamed (with the new name), type_changed. The first file of a feed has no changes; files
    without any valid record are passed over. Files of equal time are ordered by archivo_id.
    """
    renamed, pairs = compare(profiled)
    types = F.filter(F.array_intersect(F.map_keys("antes"), F.map_keys("campos")), lambda k: F.col("antes")[k] != F.col("campos")[k])
    kept = pairs.select("archivo_id", F.explode(types).alias("campo"), F.lit("type_changed").alias("cambio"))
    came = pairs.select("archivo_id", F.explode("_came").alias("campo"))
    gone = pairs.select("archivo_id", F.explode("_gone").alias("campo"))
    new, old = renamed.select("archivo_id", F.col("nuevo").alias("campo")), renamed.select("archivo_id", F.col("viejo").alias("campo"))
    typed = renamed.join(pairs.select("archivo_id", "antes", "campos"), "archivo_id").where(F.col("antes")[F.col("viejo")] != F.col("campos")[F.col("nuevo")])
    return (
        kept.unionByName(came.join(new, ["archivo_id", "campo"], "left_anti").withColumn("cambio", F.lit("added")))
        .unionByName(gone.join(old, ["archivo_id", "campo"], "left_anti").withColumn("cambio", F.lit("removed")))
        .unionByName(new.withColumn("cambio", F.lit("renamed")))
        .unionByName(typed.select("archivo_id", F.col("nuevo").alias("campo"), F.lit("type_changed").alias("cambio")))
    )


def columns(profiled: DataFrame, least: float = LINKED) -> dict[str, list[str]]:
    """Column name -> the field names it was delivered under, commonest first.

    Two names are linked if the likenesses of their renames add up to ``least`` of all renames that the less active of the
    two took part in: a share, alike for inputs of any size, that a mistaken pair now and then does not reach. What
    reaches the driver is one row per pair of names, not per file.
    """
    renamed, _ = compare(profiled)
    links = renamed.groupBy("viejo", "nuevo").agg(F.count(F.lit(1)).alias("n"), F.sum("parecido").alias("w")).collect()
    files = {r["campo"]: r["n"] for r in profiled.groupBy("campo").agg(F.count(F.lit(1)).alias("n")).collect()}
    of: dict[str, int] = {}
    both: dict[frozenset, float] = {}
    for r in links:
        of[r["viejo"]] = of.get(r["viejo"], 0) + r["n"]
        of[r["nuevo"]] = of.get(r["nuevo"], 0) + r["n"]
        pair = frozenset((r["viejo"], r["nuevo"]))
        both[pair] = both.get(pair, 0.0) + r["w"]
    sets = DisjointSets()
    for name in files:
        sets.find(name)
    for pair, weight in both.items():
        if weight >= least * min(of[name] for name in pair):
            sets.join(*sorted(pair))
    out = {}
    for names in sets.classes().values():
        names = sorted(names, key=lambda c: (-files[c], c))
        out[names[0]] = names
    return dict(sorted(out.items()))


#: Of the table over all files: values of further names of a column, as a JSON object; null if there are none.
OTHERS = "otros_valores"


def unify(raw: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """All valid records as (feed, archivo_id, registro_no, one column per entry of ``names``, otros_valores), distinct.

    A column is bigint or double if all its values are whole or decimal numbers, however they were delivered, else a
    string with every value written alike (``plain``). If a record has several names of one column, the commonest name that
    has a value wins, and other values go to ``otros_valores`` under their names. Dots in a column name become underscores.
    """
    spelled = [(c.replace(".", "_"), many) for c, many in names.items()]
    schema = "feed string, archivo_id long, registro_no long" + "".join(f", `{c}` string" for c, _ in spelled) + f", `{OTHERS}` string"

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for feed, file, no, payload in zip(batch["feed"], batch["archivo_id"], batch["registro_no"], batch["payload"]):
                got = record(payload)
                if got is None:
                    continue
                have = {k: plain(v) for k, v in leaves(got) if v is not None}
                taken, rest = [], {}
                for _, many in spelled:
                    there = [n for n in many if n in have]
                    taken.append(have[there[0]] if there else None)
                    rest |= {n: have[n] for n in there[1:] if have[n] != have[there[0]]}
                out.append((feed, file, no, *taken, json.dumps(rest, ensure_ascii=False, sort_keys=True) if rest else None))
            yield pd.DataFrame(out, columns=["feed", "archivo_id", "registro_no", *(c for c, _ in spelled), OTHERS])

    ready(raw.sparkSession)
    wanted = raw.where(F.col("archivo_id").isNotNull()).select("feed", F.col("archivo_id").cast("long").alias("archivo_id"), F.col("registro_no").cast("long").alias("registro_no"), "payload")
    texts = stage(wanted.mapInPandas(rows, schema).distinct(), "unified")
    if not spelled:
        return texts
    # One count per column and type decides; a value of digits with a leading zero is a code, not a number.
    whole = lambda c: F.col(f"`{c}`").rlike(r"^-?(0|[1-9]\d*)$") & F.col(f"`{c}`").try_cast("bigint").isNotNull()
    number = lambda c: F.col(f"`{c}`").rlike(r"^-?(0|[1-9]\d*)(\.\d+)?([eE][-+]?\d+)?$")
    counts = texts.agg(*(x for i, (c, _) in enumerate(spelled) for x in (F.count(f"`{c}`").alias(f"_a{i}"), F.count_if(whole(c)).alias(f"_w{i}"), F.count_if(number(c)).alias(f"_n{i}")))).first()
    kind = lambda i: "string" if not counts[f"_a{i}"] else "bigint" if counts[f"_w{i}"] == counts[f"_a{i}"] else "double" if counts[f"_n{i}"] == counts[f"_a{i}"] else "string"
    return texts.select("feed", "archivo_id", "registro_no", *(F.col(f"`{c}`").cast(kind(i)).alias(c) for i, (c, _) in enumerate(spelled)), OTHERS)
