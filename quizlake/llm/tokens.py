"""The corpus as ids of a public byte-level tokenizer.

Words are cut by the tokenizer's pattern. The commonest words of the whole corpus and their ids are compiled into a
transducer, which executors memory-map; a word that it lacks is merged by the tokenizer's ranks. Both give the same ids,
so the lexicon's size only sets the speed.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlake.llm.transducer import Lexicon, compile_lexicon
from quizlake.session import local_path, ready, ship

#: Place of the tokenizers' files.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Words compiled into the lexicon.
LEXICON_WORDS = 65_536
#: Longer words (runs without a break) stay out of the lexicon and of the cache.
LONGEST_WORD = 64
#: Words whose ids a worker keeps.
CACHE = 300_000
# Fixed value: the pattern that cuts a text into words, as published with the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_WORD = regex.compile(PATTERN)


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token -> id from lines of a token in base 64 and its id."""
    return {base64.b64decode(token): int(i) for token, i in (line.split() for line in data.splitlines() if line)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a word: of all neighbours, the pair of lowest rank is merged first, the leftmost of equals.

    Pairs wait in a heap and neighbours in a linked list, so long words take n log n steps.
    """
    if (whole := ranks.get(word)) is not None:
        return [whole]
    from heapq import heapify, heappop, heappush

    n = len(word)
    end = list(range(1, n + 1))  # end of the part which starts at i; 0 if it is no start
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        middle = end[i]
        if not middle or middle >= n or not end[middle] or end[middle] != stop:
            continue
        end[i] = stop
        end[middle] = 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heappush(heap, (r, i, end[stop]))
        if (j := before[i]) >= 0 and (r := ranks.get(word[j:stop])) is not None:
            heappush(heap, (r, j, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def frequent_words(docs: DataFrame, text_col: str, most: int) -> list[str]:
    """The commonest words of all texts, at most so many; equal counts go by the word. Counts are combined before the shuffle."""
    words = docs.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit("(?U)(" + PATTERN + ")"), F.lit(1))).alias("w"))
    top = words.where(F.length("w") <= LONGEST_WORD).groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "w").limit(most)
    return [r["w"] for r in top.collect()]


class Encoder:
    """Words to ids by the lexicon, a bounded cache, and merging."""

    def __init__(self, ranks: dict[bytes, int], lexicon: Lexicon | None):
        self.ranks, self.lexicon, self.known = ranks, lexicon, {}

    def learn(self, words: set[str]) -> dict[str, list[int]]:
        """The ids of all ``words``."""
        fresh = [w for w in words if w not in self.known]
        if len(self.known) + len(fresh) > CACHE:
            self.known, fresh = {}, list(words)
        raw = [w.encode("utf-8", "surrogatepass") for w in fresh]
        places = self.lexicon.places(raw) if self.lexicon and raw else np.full(len(raw), -1)
        got = {}
        for word, data, place in zip(fresh, raw, places):
            ids = self.lexicon.output(place) if place >= 0 else merge(data, self.ranks)
            (self.known if len(word) <= LONGEST_WORD else got)[word] = ids
        return self.known if not got else self.known | got

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        cut = [_WORD.findall(t) if t else [] for t in texts]
        ids_of = self.learn(set().union(*cut)) if cut else {}
        flat: list[int] = []
        ends = [0]
        for words in cut:
            for w in words:
                flat += ids_of[w]
            ends.append(len(flat))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, lexicon_words: int = LEXICON_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, the columns of ``keep``, ids array<int>) of every row, without special tokens; their strings in a text are ordinary text.

    Null and empty texts have the empty list. Rows that repeat are encoded each time. Texts of any length are encoded whole.
    """
    spark = docs.sparkSession
    ready(spark)
    with open(f"{tokenizers}/{vocabulary}", "rb") as f:
        data = f.read()
    ranks = read_ranks(data)
    words = frequent_words(docs, text_col, lexicon_words)
    lexicon_name = ship(spark, compile_lexicon({(raw := w.encode("utf-8", "surrogatepass")): merge(raw, ranks) for w in words}), "lexicon")
    ranks_name = ship(spark, data, "ranks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (ranks_name, lexicon_name)
        if key not in _ENCODERS:
            _ENCODERS.clear()
            with open(local_path(ranks_name), "rb") as f:
                _ENCODERS[key] = Encoder(read_ranks(f.read()), Lexicon(local_path(lexicon_name)))
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], _ENCODERS[key].encode(part.column(1).to_pylist())], [id_col, *keep, "ids"])

    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in (id_col, *keep)) + "ids array<int>"
    return docs.select(id_col, text_col, *keep).mapInArrow(run, schema)


def totals(docs: DataFrame, by: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(by, documentos, tokens): sizes of the parts of a corpus, in tokens; rows with null or repeated ids count like all others."""
    sizes = encode(docs, id_col, text_col, keep=(by,)).select(by, F.size("ids").cast("bigint").alias("_n"))
    return sizes.groupBy(by).agg(F.count(F.lit(1)).alias("documentos"), F.sum("_n").alias("tokens"))
