"""Suffix arrays by two-stage sorting, and their adjacent common prefixes."""

from __future__ import annotations

import numpy as np

#: Strings compared at once.
CHUNK = 1 << 12


def two_stage(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted suffixes (ascending positions of bytes > 0) in suffix order; `text`
    holds zeros where suffixes end, one at least at its end.

    A suffix is of type B if it is smaller than its successor, else of type A. Type B ones
    are sorted directly, by their first `depth` bytes. Buckets by first byte are then
    scanned in ascending order: a type A suffix follows the order of its successor, which
    the scan has met before, and goes before its bucket's type B ones. Suffixes that agree
    for `depth` bytes may come in any order.
    """
    size = len(text)
    # A run of one byte has the type of its end: compare with the next byte that differs.
    change = np.flatnonzero(text[1:] != text[:-1]) + 1
    later = np.repeat(np.append(text[change], np.uint8(0)), np.diff(change, prepend=0, append=size))
    is_b = text < later
    # Type A suffixes need their successors up to the next type B one or end of text.
    need = np.zeros(size + 1, bool)
    need[wanted] = True
    while True:
        at = np.flatnonzero(need[:size] & ~is_b & (text > 0))
        new = at[~need[at + 1]] + 1
        if not len(new):
            break
        need[new] = True
    need = need[:size]
    raw = text.tobytes()
    # Direct sort of type B; an end of text (0) sorts before all, and what follows it decides among equals only.
    b_at = np.flatnonzero(need & is_b & (text > 0)).tolist()
    keys = [raw[p : p + depth] for p in b_at]
    order = sorted(range(len(keys)), key=keys.__getitem__)
    b_sorted = np.array([b_at[i] for i in order], np.int64)
    bounds = np.searchsorted(text[b_sorted], np.arange(257)) if len(b_sorted) else np.zeros(257, np.int64)
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]

    def induce(done: np.ndarray) -> None:
        before = done[done > 0] - 1
        before = before[need[before] & ~is_b[before] & (text[before] > 0)]
        if len(before):
            first = text[before]
            by = np.argsort(first, kind="stable")
            before, first = before[by], first[by]
            cut = np.flatnonzero(np.diff(first)) + 1
            for part in np.split(before, cut):
                induced[int(text[part[0]])].append(part)

    out = []
    induce(np.flatnonzero((text == 0) & np.append(need[:-1], False)[np.arange(size) - 1]) if size else np.zeros(0, np.int64))
    for c in range(1, 256):
        # Members of this bucket may induce more of it, a run of c: scan until none is new.
        while induced[c]:
            part = np.concatenate(induced[c])
            induced[c] = []
            out.append(part)
            induce(part)
        part = b_sorted[bounds[c] : bounds[c + 1]]
        if len(part):
            out.append(part)
            induce(part)
    found = np.concatenate(out) if out else np.zeros(0, np.int64)
    keep = np.zeros(size, bool)
    keep[wanted] = True
    return found[keep[found]]


def agreeing(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Whether each suffix has its first `depth` bytes in common with its predecessor in
    `order`; the first has not. No suffix ends within `depth` bytes."""
    out = np.zeros(len(order), bool)
    if not len(order):
        return out
    # The `depth` bytes from each place on, as one item: taken whole, some thousand at a time.
    strings = np.ndarray((len(text) - depth + 1,), f"V{depth}", text, strides=(1,))
    word = np.uint64 if depth % 8 == 0 else np.uint8
    for lo in range(0, len(order) - 1, CHUNK):
        some = strings[order[lo : lo + CHUNK + 1]].view(word).reshape(-1, depth // np.dtype(word).itemsize)
        out[lo + 1 : lo + len(some)] = (some[1:] == some[:-1]).all(1)
    return out


def repeated_starts(blocks: list[bytes], depth: int) -> list[np.ndarray]:
    """For each block, whether the string of `depth` bytes at each of its starts (its first
    len - depth + 1 positions) also starts anywhere else in these blocks. Zero bytes of the
    blocks are allowed: they are moved apart from the ends of suffixes."""
    if any(b"\x00" in b or b"\xff" in b for b in blocks):
        # UTF-8 has no byte 0xF8-0xFF; NUL itself takes one of them.
        blocks = [b.replace(b"\x00", b"\xf8") for b in blocks]
    text = np.frombuffer(b"\x00".join([*blocks, b""]) or b"\x00", np.uint8)
    starts = np.cumsum([0, *[len(b) + 1 for b in blocks]])[:-1]
    counts = np.array([max(0, len(b) - depth + 1) for b in blocks], np.int64)
    wanted = np.concatenate([np.arange(s, s + n) for s, n in zip(starts, counts, strict=True)]) if blocks else np.zeros(0, np.int64)
    order = two_stage(text, wanted, depth)
    full = agreeing(text, order, depth)
    hit = np.zeros(len(text), bool)
    hit[order[full]] = True
    hit[order[np.flatnonzero(full) - 1]] = True
    return [hit[s : s + n] for s, n in zip(starts, counts, strict=True)]
