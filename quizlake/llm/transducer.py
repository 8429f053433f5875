"""A lexicon of byte strings as a minimal acyclic transducer: flat arrays that can be memory-mapped.

States with the same right language are one, so endings are shared. Every edge carries a number; their sum along a word
is the word's place in the sorted lexicon, which leads to its output, a run of ids.
"""

from __future__ import annotations

import numpy as np

_ARRAYS = ("keys", "targets", "sums", "finals", "offsets", "outputs")


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The transducer of ``entries`` (word -> ids) as bytes: a header of lengths, then the arrays.

    Words are added in order and states are shared as soon as no later word can change them, so no larger automaton is
    ever built. The empty word is not held.
    """
    words = sorted(w for w in entries if w)
    register: dict[tuple, int] = {}
    edges_of: list[tuple] = []
    counts: list[int] = []
    final_of: list[bool] = []

    def settle(final: bool, edges: list[tuple[int, int]]) -> int:
        key = (final, tuple(edges))
        if (got := register.get(key)) is None:
            got = register[key] = len(edges_of)
            edges_of.append(key[1])
            final_of.append(final)
            counts.append(final + sum(counts[t] for _, t in edges))
        return got

    path: list[list] = [[False, []]]  # open states of the last word: final, settled edges
    last = b""
    for word in words:
        shared = 0
        while shared < len(last) and shared < len(word) and last[shared] == word[shared]:
            shared += 1
        while len(path) > shared + 1:
            final, edges = path.pop()
            path[-1][1].append((last[len(path) - 1], settle(final, edges)))
        path += [[False, []] for _ in word[shared:]]
        path[-1][0] = True
        last = word
    while len(path) > 1:
        final, edges = path.pop()
        path[-1][1].append((last[len(path) - 1], settle(final, edges)))
    root = settle(*path[0])
    # The root gets number 0.
    order = [root, *(s for s in range(len(edges_of)) if s != root)]
    number = {s: i for i, s in enumerate(order)}
    keys, targets, sums = [], [], []
    for s in order:
        before = int(final_of[s])
        for byte, t in edges_of[s]:
            keys.append(number[s] << 8 | byte)
            targets.append(number[t])
            sums.append(before)
            before += counts[t]
    runs = [entries[w] for w in words]
    arrays = {
        "keys": np.array(keys, np.int64),
        "targets": np.array(targets, np.int32),
        "sums": np.array(sums, np.int32),
        "finals": np.array([final_of[s] for s in order], np.uint8),
        "offsets": np.concatenate([[0], np.cumsum([len(r) for r in runs], dtype=np.int64)]).astype(np.int32),
        "outputs": np.array([i for r in runs for i in r], np.int32),
    }
    return np.array([len(arrays[a]) for a in _ARRAYS], np.int64).tobytes() + b"".join(arrays[a].tobytes() + b"\0" * (-arrays[a].nbytes % 8) for a in _ARRAYS)


class Lexicon:
    """A compiled lexicon, mapped from a file; look-ups are done for many words at once."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        lengths = raw[: 8 * len(_ARRAYS)].view(np.int64)
        at = 8 * len(_ARRAYS)
        for name, n, kind in zip(_ARRAYS, lengths, (np.int64, np.int32, np.int32, np.uint8, np.int32, np.int32)):
            size = int(n) * np.dtype(kind).itemsize
            setattr(self, name, raw[at : at + size].view(kind))
            at += size + -size % 8

    def places(self, words: list[bytes]) -> np.ndarray:
        """The place of each word, -1 for those that the lexicon lacks."""
        lengths = np.fromiter((len(w) for w in words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        place = np.where(lengths > 0, 0, -1)
        state = np.zeros(len(words), np.int64)
        live = np.flatnonzero(lengths > 0) if len(self.keys) else np.zeros(0, np.int64)
        if not len(self.keys):
            place[:] = -1
        depth = 0
        while len(live):
            wanted = state[live] << 8 | flat[starts[live] + depth]
            edge = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            found = self.keys[edge] == wanted
            place[live[~found]] = -1
            live, edge = live[found], edge[found]
            state[live] = self.targets[edge]
            place[live] += self.sums[edge]
            depth += 1
            ended = lengths[live] == depth
            done = live[ended]
            place[done[self.finals[state[done]] == 0]] = -1
            live = live[~ended]
        return place

    def output(self, place: int) -> list[int]:
        return self.outputs[self.offsets[place] : self.offsets[place + 1]].tolist()
