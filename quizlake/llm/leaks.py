"""Evaluation items that occur in training texts, word for word or paraphrased.

Words become 64-bit hashes, and those hashes fall into a fixed number of slots, so no table grows with a vocabulary.
TF-IDF passages of the whole corpus over the items' slots are reduced by a randomised SVD whose products are summed in the
cluster. Windows of documents are compared with the items' windows by their cosine in that space, but only within
buckets: a code of the (fixed-point) latent vector, equal for equal windows whatever the rank, so no shared run is
lost; and the nearest of a number of cells of the items' windows. Shared runs and paraphrases differ only in the
least cosine. The pairs found are then checked on the words themselves: the run that both share, the longest common
subsequence, and the options that occur.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizlake.session import local_path, ready, ship, stage

#: Successive words that make a leak.
RUN = 12
#: Words of a window, and between the starts of a document's windows: WINDOW + STRIDE - 1 <= RUN.
WINDOW, STRIDE = 8, 5
RANK, EXTRA = 48, 8
#: Slots of words, a power of two. It bounds all tables that the driver and the tasks hold; words of one slot share their vector.
SLOTS = 1 << 16
#: Least cosine of literal and of paraphrased candidates.
LITERAL, PARAPHRASED = 0.985, 0.8
#: Windows of items in one index file; more items make several files, each searched in a pass of its own.
BLOCK_WINDOWS = 1_000_000
#: Cells per square root of the number of windows, cells looked into for a window, and rounds and windows of their fitting.
CELLS, PROBES, ROUNDS, FITTED = 1.0, 8, 6, 60_000
#: Least share of an item's content words, in order, in a document's passage that counts as a paraphrase.
COVERED = 0.5
#: Words of more than this share of all distinct texts are no content words.
COMMON = 0.05
_ROWS = 16_384
#: Between two texts of one item; no word has this hash.
_APART = np.int64(-(1 << 63))
_FIXED = 1 << 16

_WORD = regex.compile(r"[\p{L}\p{N}]+")
_OPTION = regex.compile(r"(?<!\p{L})\(?([a-h])\)\s*")


def _base_letters() -> dict[int, str | None]:
    table: dict[int, str | None] = {}
    for c in range(0x80, 0x2000):
        parts = unicodedata.normalize("NFD", chr(c))
        if unicodedata.category(chr(c)) == "Mn":
            table[c] = None
        elif len(parts) > 1:
            table[c] = "".join(p for p in parts if unicodedata.category(p) != "Mn")
    return table


_BASE = _base_letters()
_SINGLE = {c: b for c, b in _BASE.items() if b and len(b) == 1}
#: For ``translate``: letters, their base letters, and at the end the marks, which go.
_FROM = "".join(map(chr, _SINGLE)) + "".join(chr(c) for c, b in _BASE.items() if b is None)
_TO = "".join(_SINGLE.values())


def words(text: str | None) -> list[str]:
    """The words of a text: runs of letters or numerals, in small letters and without accents."""
    if not text:
        return []
    text = text.lower()
    return _WORD.findall(text if text.isascii() else text.translate(_BASE))


def word_hashes(text: Column) -> Column:
    """The 64-bit hashes of ``words``, in order, in the JVM. Null texts have none."""
    found = F.regexp_extract_all(F.translate(F.lower(text), _FROM, _TO), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda w: F.xxhash64(w))


def _hashed(found: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 42) for w in found], np.uint64).view(np.int64)


def _place(hashes: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The place of each word's slot, -1 for slots that no item uses."""
    return place[(hashes.view(np.uint64) % np.uint64(len(place))).astype(np.int64)]


def _pack(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays as one file that can be memory-mapped: a line of JSON, then the arrays, each from a multiple of eight."""
    head = json.dumps({k: [str(a.dtype), list(a.shape)] for k, a in arrays.items()}).encode()
    head += b" " * (-(len(head) + 1) % 8) + b"\n"
    return head + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays.values())


def _mapped(path: str) -> dict[str, np.ndarray]:
    with open(path, "rb") as f:
        head = f.readline()
    raw, at, out = np.memmap(path, np.uint8, "r"), len(head), {}
    for name, (kind, shape) in json.loads(head).items():
        size = int(np.prod(shape)) * np.dtype(kind).itemsize
        out[name] = raw[at : at + size].view(kind).reshape(shape)
        at += size + -size % 8
    return out


def item_blocks(items: DataFrame, most: int) -> Iterator[dict[str, np.ndarray]]:
    """The items (item_id, text) in blocks of at most so many windows (one item at least), each as flat arrays.

    ids; words with ends; starts and owners of windows; options (their words) with ends and owners. Null ids and texts
    are left out; items of equal id are one text after the other, apart. One block at a time is on the driver.
    """
    ids, texts, options, windows = [], [], [], 0

    def block() -> dict[str, np.ndarray]:
        flat = np.concatenate(texts) if texts else np.zeros(0, np.int64)
        ends = np.cumsum([0, *map(len, texts)])
        starts = np.concatenate([np.arange(a, max(a, b - WINDOW + 1)) for a, b in zip(ends, ends[1:])]) if texts else np.zeros(0, np.int64)
        parts = [(i, o) for i, many in enumerate(options) for o in many]
        if len(starts):
            whole = np.lib.stride_tricks.sliding_window_view(flat == _APART, WINDOW)[starts].any(1)
            starts = starts[~whole]
        return {
            "ids": np.array(ids, np.int64), "words": flat, "ends": ends, "starts": starts.astype(np.int64), "owners": (np.searchsorted(ends, starts, side="right") - 1).astype(np.int32),
            "option_words": np.concatenate([np.zeros(0, np.int64), *(o for _, o in parts)]), "option_ends": np.cumsum([0, *(len(o) for _, o in parts)]), "option_owners": np.array([i for i, _ in parts], np.int64),
        }

    rows = items.where("item_id is not null and text is not null").select("item_id", "text", word_hashes(F.col("text")).alias("w")).orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        found = np.array(r["w"], np.int64)
        if ids and ids[-1] == r["item_id"]:
            texts[-1] = np.concatenate([texts[-1], [_APART], found])
        else:
            if windows + len(found) > most and ids:
                yield block()
                ids, texts, options, windows = [], [], [], 0
            ids.append(r["item_id"])
            texts.append(found)
            options.append([])
        windows += len(found)
        options[-1].extend(_hashed(words(p)) for p in _OPTION.split(r["text"])[2::2])
    if ids:
        yield block()


def placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, w array<bigint>, huella): the hashes of all words in order. Null texts have no words.

    ``huella`` is a hash of all of them, the same for texts that are the same but for case, accents and punctuation.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), word_hashes(F.col(text_col)).alias("w"))
    return rows.withColumn("huella", F.struct(F.xxhash64("w"), F.xxhash64(F.lit(1), "w")))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all words, ends) of a batch's lists."""
    ends = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), ends - ends[0]


def weights(placed_docs: DataFrame, place: np.ndarray) -> tuple[np.ndarray, float]:
    """IDF of every place over all distinct texts, and that of a word of none.

    Copies count once: the words of an item that leaked often would otherwise pass for common ones. Every task counts
    its texts per place first, so what is shuffled beside the distinct texts is bounded by SLOTS.
    """
    size = int(place.max()) + 1 if len(place) else 0
    handle = placed_docs.sparkSession.sparkContext.broadcast(place)  # SLOTS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size + 1, np.int64)
        for batch in batches:
            flat, ends = _flat(batch.column(0))
            counts[size] += len(ends) - 1
            at = _place(flat, handle.value)
            row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[at >= 0]
            counts[:size] += np.bincount(np.unique(row * size + at[at >= 0]) % max(1, size), minlength=size)[:size]
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], ["r", "n"])

    texts = placed_docs.select("huella", "w").dropDuplicates(["huella"]).select("w")
    df = np.zeros(size + 1)
    for r in texts.mapInArrow(run, "r long, n long").groupBy("r").agg(F.sum("n").alias("n")).collect():  # one row per place
        df[r["r"]] = r["n"]
    n = df[size]
    return np.log((n + 1) / (df[:size] + 1)) + 1, float(np.log(n + 1) + 1)


def _passages(column: pa.Array, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of words that have one, number of their passage): a batch's texts cut into passages of RUN words."""
    flat, ends = _flat(column)
    lengths = np.diff(ends)
    inside = np.arange(len(flat)) - np.repeat(ends[:-1], lengths)
    number = np.cumsum(inside % RUN == 0) - 1
    at = _place(flat, place)
    known = at >= 0
    return at[known], number[known]


def _summed(placed_docs: DataFrame, size: int, width: int, step, held) -> np.ndarray:  # noqa: ANN001
    """The sum over all batches of ``step(total, places, passages, table)``, a (size, width) table; summed row by row in the cluster."""
    handle = placed_docs.sparkSession.sparkContext.broadcast(held)  # (place, table): at most SLOTS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, table = handle.value
        total = np.zeros((size, width))
        for batch in batches:
            w, p = _passages(batch.column(0), place)
            if len(w):
                step(total, w, p, table)
        rows = np.flatnonzero(np.abs(total).sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), *(pa.array(total[rows, j]) for j in range(width))], ["r", *(f"c{j}" for j in range(width))])

    parts = placed_docs.select("w").mapInArrow(run, "r int, " + ", ".join(f"c{j} double" for j in range(width)))
    out = np.zeros((size, width))
    for row in parts.groupBy("r").agg(*(F.sum(f"c{j}").alias(f"c{j}") for j in range(width))).toLocalIterator():  # SLOTS rows at most
        out[row["r"]] = row[1:]
    return out


def _passage_vectors(table: np.ndarray, w: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum of the words' rows for each passage, place of each word's passage among them)."""
    first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    return np.add.reduceat(table[w], first, axis=0), np.repeat(np.arange(len(first)), np.diff(np.append(first, len(p))))


def _sketch(total: np.ndarray, w: np.ndarray, p: np.ndarray, table: np.ndarray) -> None:
    vectors, of = _passage_vectors(table, w, p)
    order = np.argsort(w, kind="stable")
    at = np.flatnonzero(np.concatenate([[True], np.diff(w[order]) != 0]))
    total[w[order][at]] += np.add.reduceat(vectors[of[order]], at, axis=0)


def _gram(total: np.ndarray, w: np.ndarray, p: np.ndarray, table: np.ndarray) -> None:
    vectors, _ = _passage_vectors(table, w, p)
    total += vectors.T @ vectors


def latent(placed_docs: DataFrame, place: np.ndarray, idf: np.ndarray, rank: int = RANK, seed: int = 1) -> np.ndarray:
    """Rows of places in the space of the leading right singular vectors of the corpus' TF-IDF passages.

    Randomised range finder with one power step, then the exact eigenvectors within that range: two passes over the staged
    words, whose sums (at most SLOTS x rank) alone reach the driver.
    """
    size = len(idf)
    width = min(rank + EXTRA, size)
    start = np.random.default_rng(seed).standard_normal((size, width)) * idf[:, None]
    basis, _ = np.linalg.qr(_summed(placed_docs, size, width, _sketch, (place, start.astype(np.float32))) * idf[:, None] + 1e-9 * start)
    weighted = basis * idf[:, None]
    values, turn = np.linalg.eigh(_summed(placed_docs, width, width, _gram, (place, weighted.astype(np.float32))))
    return (weighted @ turn[:, np.argsort(-values)[:rank]]).astype(np.float32)


def _cells(vectors: np.ndarray, seed: int = 1) -> np.ndarray:
    """Unit centres of the cells of the items' windows, fitted to at most FITTED of them."""
    n = max(1, int(CELLS * len(vectors) ** 0.5))
    rng = np.random.default_rng(seed)
    some = vectors[rng.permutation(len(vectors))[:FITTED]]
    centres = some[:n].copy()
    for _ in range(ROUNDS):
        near = np.concatenate([(some[i : i + _ROWS] @ centres.T).argmax(1) for i in range(0, len(some), _ROWS)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, some)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), centres)
    return centres


def build_index(block: dict[str, np.ndarray], place: np.ndarray, idf: np.ndarray, space: np.ndarray, other: float) -> bytes:
    """A block's index as a file: windows ordered by cell with their vectors, and their codes in order."""
    at = _place(block["words"], place)
    fixed = np.rint(space.astype(np.float64) * _FIXED).astype(np.int64)
    odd = np.random.default_rng(7).integers(1, 1 << 62, fixed.shape[1] + 1) * 2 + 1
    code = (fixed * odd[:-1]).sum(1) + odd[-1]  # a linear code: that of a window is the sum of its words'
    spans = block["starts"][:, None] + np.arange(WINDOW)
    vectors = space[at[spans]].sum(1) if len(spans) else np.zeros((0, space.shape[1]), np.float32)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    centres = _cells(vectors) if len(vectors) else vectors
    cell = np.concatenate([(vectors[i : i + _ROWS] @ centres.T).argmax(1) for i in range(0, len(vectors), _ROWS)]) if len(vectors) else np.zeros(0, np.int64)
    order = np.argsort(cell, kind="stable")
    closeness = np.ones(len(centres), np.float32)
    for i in range(0, len(vectors), _ROWS):
        mine = cell[i : i + _ROWS]
        np.minimum.at(closeness, mine, np.einsum("ij,ij->i", vectors[i : i + _ROWS], centres[mine]))
    codes = code[at[spans[order]]].sum(1) if len(spans) else np.zeros(0, np.int64)
    by_code = np.argsort(codes, kind="stable")
    return _pack(block | {
        "place": place, "space": space, "code": code, "content": idf >= 1 - np.log(COMMON), "other": np.array([other]),
        "starts": block["starts"][order], "owners": block["owners"][order], "vectors": vectors[order], "centres": centres, "radii": np.arccos(np.clip(closeness, -1, 1)), "lengths": np.linalg.norm(space, axis=1),
        "cell_ends": np.searchsorted(cell[order], np.arange(len(centres) + 1)), "codes": codes[by_code], "by_code": by_code,
    })


def _lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bits of one number."""
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for y in b.tolist():
        if hit := state & places.get(y, 0):
            state = (state + hit | state - hit) & full
    return len(a) - state.bit_count()


def _shared(doc: np.ndarray, at: int, item: np.ndarray, start: int) -> int:
    """Length of the run which both have around two places; 0 if the windows there differ."""
    if not np.array_equal(doc[at : at + WINDOW], item[start : start + WINDOW]):
        return 0
    left = 0
    while at - left > 0 and start - left > 0 and doc[at - left - 1] == item[start - left - 1]:
        left += 1
    right = WINDOW
    while at + right < len(doc) and start + right < len(item) and doc[at + right] == item[start + right]:
        right += 1
    return left + right


def search(docs: DataFrame, items: DataFrame, least: float, id_col: str = "doc_id", text_col: str = "text", rank: int = RANK, probes: int = PROBES) -> DataFrame:
    """(doc_id, item_id, seguidas, comunes, contenido, opciones, opciones_halladas) of all pairs with a window of cosine >= ``least``.

    Windows meet in buckets: those of equal latent code, and those of the ``probes`` nearest cells (with as many as there are
    cells nothing is left out); the cosine decides in either. ``seguidas``: longest run of words that
    both share around such windows. ``comunes``: of the item's content words (``contenido``), those that the passage
    around the windows has in order. ``opciones_halladas``: of the item's ``opciones`` with content words, those that have
    four fifths of them in order there. Null and empty texts give no row; repeated documents repeat theirs.
    """
    spark = docs.sparkSession
    ready(spark)
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, item_id long, seguidas int, comunes int, contenido int, opciones int, opciones_halladas int"
    used = items.where("item_id is not null").select(F.explode(word_hashes(F.col("text"))).alias("w")).select(F.expr(f"pmod(w, {SLOTS})").alias("w"))
    mine = sorted(int(r["w"]) for r in used.distinct().collect())  # SLOTS rows at most
    if not mine:
        return spark.createDataFrame([], schema)
    place = np.full(SLOTS, -1, np.int64)
    place[mine] = np.arange(len(mine))
    rows = stage(placed(docs, id_col, text_col), "placed")
    idf, other = weights(rows, place)
    space = latent(rows, place, idf, rank)
    out = None
    for block in item_blocks(items, BLOCK_WINDOWS):
        name = ship(spark, build_index(block, place, idf, space, other), "items")
        found = rows.select("doc_id", "w").mapInArrow(_searcher(name, least, probes), schema)
        out = found if out is None else out.unionByName(found)
    return out


_FILES: dict[str, dict[str, np.ndarray]] = {}


def _by_code(x: dict, place: np.ndarray, at: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window of the batch, window of the items) of the pairs of equal code and cosine >= ``least``; equal null vectors have cosine 1."""
    known = np.concatenate([[0], np.cumsum(place >= 0)])
    sums = np.concatenate([[0], np.cumsum(np.where(place >= 0, x["code"][np.maximum(place, 0)], 0))])
    whole = np.flatnonzero(known[at + WINDOW] - known[at] == WINDOW)
    codes = sums[at[whole] + WINDOW] - sums[at[whole]]
    low, high = np.searchsorted(x["codes"], codes), np.searchsorted(x["codes"], codes, side="right")
    n = high - low
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    window, other = np.repeat(whole, n), x["by_code"][np.repeat(low, n) + inside]
    for i in range(0, len(window), _ROWS):
        w, j = window[i : i + _ROWS], other[i : i + _ROWS]
        vectors = x["space"][place[at[w, None] + np.arange(WINDOW)]].sum(1)
        near = np.einsum("ij,ij->i", vectors, x["vectors"][j]) >= least * np.linalg.norm(vectors, axis=1) - 1e-9
        yield w[near], j[near]


def _near(x: dict, place: np.ndarray, at: np.ndarray, least: float, probes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window of the batch, window of the items) of the pairs of cosine >= ``least`` in the ``probes`` nearest cells."""
    other = float(x["other"][0])
    reach = np.cos(np.minimum(np.pi, x["radii"] + np.arccos(min(1.0, least)) + 1e-3))
    for low in range(0, len(at), _ROWS):
        ids = place[at[low : low + _ROWS, None] + np.arange(WINDOW)]
        strange = (ids < 0).sum(1)
        longest = np.where(ids < 0, 0, x["lengths"][np.maximum(ids, 0)]).sum(1)  # no sum of the vectors is longer
        some = np.flatnonzero(longest * (1 + 1e-5) >= least * np.sqrt(longest * longest + strange * other * other))
        some = some[strange[some] < WINDOW]
        vectors = np.where(ids[some][..., None] < 0, np.float32(0), x["space"][np.maximum(ids[some], 0)]).sum(1)
        energy = np.einsum("ij,ij->i", vectors, vectors)
        norm = np.sqrt(energy + strange[some] * other * other) + 1e-12
        good = np.flatnonzero(np.sqrt(energy) >= least * norm)  # no cosine can be larger than this share
        vectors, share = vectors[good] / norm[good, None], np.sqrt(energy[good]) / norm[good]
        good = some[good] + low
        if not len(good):
            continue
        likeness = vectors @ x["centres"].T
        k = min(probes, likeness.shape[1])
        chosen = np.argpartition(-likeness, k - 1, axis=1)[:, :k] if k < likeness.shape[1] else np.tile(np.arange(k), (len(good), 1))
        order = np.argsort(chosen.ravel(), kind="stable")
        row, cell = order // k, chosen.ravel()[order]
        within = likeness[row, cell] >= reach[cell] * share[row] - 1e-4  # no window of the other cells is near enough
        row, cell = row[within], cell[within]
        bounds = np.searchsorted(cell, np.arange(likeness.shape[1] + 1))
        for c in np.unique(cell).tolist():
            mine = row[bounds[c] : bounds[c + 1]]
            a, b = int(x["cell_ends"][c]), int(x["cell_ends"][c + 1])
            i, j = np.nonzero(vectors[mine] @ x["vectors"][a:b].T >= least)
            yield good[mine[i]], j + a


def _searcher(name: str, least: float, probes: int):  # noqa: ANN202
    names = ["doc_id", "item_id", "seguidas", "comunes", "contenido", "opciones", "opciones_halladas"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _FILES:
            _FILES[name] = _mapped(local_path(name))
        x = _FILES[name]
        at_of, content = x["place"], x["content"]

        def kept(w: np.ndarray) -> np.ndarray:
            p = _place(w, at_of)
            return w[(p >= 0) & content[np.maximum(p, 0)] & (w != _APART)]

        parts_of: dict[int, tuple[np.ndarray, list[np.ndarray]]] = {}

        def item(i: int) -> tuple[np.ndarray, list[np.ndarray]]:
            if i not in parts_of:
                low, high = np.searchsorted(x["option_owners"], [i, i + 1])
                options = [kept(x["option_words"][x["option_ends"][o] : x["option_ends"][o + 1]]) for o in range(low, high)]
                parts_of[i] = kept(x["words"][x["ends"][i] : x["ends"][i + 1]]), [o for o in options if len(o)]
            return parts_of[i]

        for batch in batches:
            flat, ends = _flat(batch.column(1))
            counts = np.maximum(0, (np.diff(ends) - WINDOW) // STRIDE + 1)
            doc = np.repeat(np.arange(len(counts)), counts)
            at = ends[doc] + STRIDE * (np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts))
            place = _place(flat, at_of)
            hits: dict[tuple[int, int], set[tuple[int, int]]] = {}
            for w, j in chain(_by_code(x, place, at, least), _near(x, place, at, least, probes)):
                for d, a, i, s in zip(doc[w].tolist(), at[w].tolist(), x["owners"][j].tolist(), x["starts"][j].tolist()):
                    hits.setdefault((d, i), set()).add((a, s))
            table = []
            for (d, i), places in hits.items():
                begin, end, first, last = int(ends[d]), int(ends[d + 1]), int(x["ends"][i]), int(x["ends"][i + 1])
                text, target = flat[begin:end], x["words"][first:last]
                run_length = max(_shared(text, a - begin, target, s - first) for a, s in places)
                low, high = max(0, min(a for a, _ in places) - begin - len(target)), max(a for a, _ in places) - begin + WINDOW + len(target)
                core, options = item(i)
                passage = kept(text[low:high])
                table.append((d, int(x["ids"][i]), run_length, _lcs(core, passage), len(core), len(options), sum(_lcs(o, passage) >= 0.8 * len(o) for o in options)))
            ids = batch.column(0).take(pa.array([t[0] for t in table], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([t[1] for t in table], pa.int64()), *(pa.array([t[i] for t in table], pa.int32()) for i in range(2, 7))], names)

    return run


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id): documents with a run of RUN successive words of an item; distinct.

    A run holds a whole window that starts at a multiple of STRIDE, and equal windows have equal latent codes and cosine 1;
    so the search has all runs, and the words around its windows decide.
    """
    return search(docs, items, LITERAL, id_col, text_col).where(F.col("seguidas") >= RUN).select("doc_id", "item_id").distinct()


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with literal or paraphrased items: (doc_id, item_id, clase, seguidas, comunes, contenido, opciones, opciones_halladas).

    ``clase`` is literal (a run of RUN words), or parafraseada: the item has content words, COVERED of them are there in
    order, and so is the content of one of its options at least, if it has any.
    """
    found = search(docs, items, PARAPHRASED, id_col, text_col)
    covered = (F.col("contenido") > 0) & (F.col("comunes") >= COVERED * F.col("contenido"))
    answered = (F.col("opciones") == 0) | (F.col("opciones_halladas") > 0)
    clase = F.when(F.col("seguidas") >= RUN, F.lit("literal")).when(covered & answered, F.lit("parafraseada"))
    return found.withColumn("clase", clase).where(F.col("clase").isNotNull()).select("doc_id", "item_id", "clase", "seguidas", "comunes", "contenido", "opciones", "opciones_halladas").distinct()
