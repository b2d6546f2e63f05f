"""Matching blocks of one name and many titles at once, as ``difflib`` finds them.

The first longest common run is taken, then those of the parts before and after it, and so
on; the sizes of the runs add up.  Of runs of equal length the one that begins first in the
name counts, then the one that begins first in the title.  The runs of the whole texts, and
of long parts of the name that are left over beside many titles, come from suffix automata
that read all titles in step; those of other parts come from bits: a row for each place in
the title, whose bits are the places in the name with the same character, shifted and joined
until no run is left.
"""

from __future__ import annotations

import numpy as np

#: Words of bits that are worked on at a time.
WORDS = 1 << 16
#: A part of the name gets an automaton if it is longer than so many characters and left over beside so many titles.
LONG, SHARED = 64, 16
#: Titles from this length on are compared by ``difflib`` itself, which leaves out their frequent characters; so are longer names than the second length.
FREQUENT, LONGEST = 200, 1024
_ONE, _TOP = np.uint64(1), 0xFFFF


def _automaton(name: np.ndarray, letters: int) -> np.ndarray:
    """For each state (row) and letter: row of the next state, first place where it ends, and the longest run there, packed.

    A state stands for the runs of ``name`` that end at the same places.
    """
    step, link, length, first = [{}], [-1], [0], [-1]
    last = 0
    for i, c in enumerate(name.tolist()):
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        first.append(i)
        v = last
        while v >= 0 and c not in step[v]:
            step[v][c] = new
            v = link[v]
        if v >= 0:
            q = step[v][c]
            if length[q] == length[v] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[v] + 1)
                first.append(first[q])
                while v >= 0 and step[v].get(c) == q:
                    step[v][c] = twin
                    v = link[v]
                link[q] = link[new] = twin
        last = new
    depth = [0] * len(step)
    for v in sorted(range(1, len(step)), key=length.__getitem__):
        depth[v] = depth[link[v]] + 1
    own = np.array([(v, c, t) for v, to in enumerate(step) for c, t in to.items()], dtype=np.int64)
    length, first, link, depth = (np.array(x, dtype=np.int64) for x in (length, first, link, depth))
    table = np.zeros((len(step), letters), dtype=np.int64)
    table[own[:, 0], own[:, 1]] = (own[:, 2] * letters << 32) | (_TOP - first[own[:, 2]] << 16) | (length[own[:, 0]] + 1)
    table[0, table[0] == 0] = _TOP << 16
    for d in range(1, int(depth.max()) + 1):  # letters that do not go on here go on from a shorter run
        at = np.flatnonzero(depth == d)
        here = table[at]
        table[at] = np.where(here == 0, table[link[at]], here)
    return table


def _first_runs(tables: list[np.ndarray], which: np.ndarray, columns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and places of the first longest common run of each title and its automaton; ``columns`` has a row for each place, titles have falling lengths."""
    base = np.cumsum([0] + [t.size for t in tables])
    flat = np.concatenate([(t + (x << 32)).reshape(-1) for t, x in zip(tables, base.tolist())])
    state, (size, best) = base[which], (np.zeros(len(lengths), dtype=np.int64) for _ in range(2))
    longer = np.searchsorted(-lengths, -np.arange(len(columns)), side="left")  # titles longer than a place
    for t, n in enumerate(longer.tolist()):
        s = size[:n]
        to = flat.take(state[:n] + columns[t, :n])
        np.right_shift(to, 32, out=state[:n])
        s += 1
        np.minimum(s, to & _TOP, out=s)
        to &= _TOP << 16
        to |= s << 32
        to |= _TOP - t
        np.maximum(best[:n], to, out=best[:n])
    k = best >> 32
    return k, _TOP - (best >> 16 & _TOP) - k + 1, _TOP - (best & _TOP) - k + 1


def _starts(name: np.ndarray, letters: int) -> np.ndarray:
    """Row ``s``, letter ``c``: the places ``i`` below 64 with ``name[s + i] == c``, as bits."""
    table = np.zeros((len(name) + 1, letters), dtype=np.uint64)
    for s in range(len(name) - 1, -1, -1):
        np.left_shift(table[s + 1], _ONE, out=table[s])
        table[s, name[s]] |= _ONE
    return table


def _longest(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`_first_runs`, of parts; ``rows`` has places in the title, words of bits, and parts, each with a common character."""
    one = rows.dtype.type(1)
    size, i, j = (np.zeros(rows.shape[2], dtype=np.int64) for _ in range(3))
    at, open_ = np.arange(rows.shape[2]), np.ones(rows.shape[2], dtype=bool)
    runs, held, k = rows, np.bitwise_or.reduce(rows, axis=0), 1
    while True:  # runs: where runs of length k end, from place k - 1 on
        more = runs[:-1] << one
        if rows.shape[1] > 1:
            more[:, 1:] |= runs[:-1, :-1] >> np.uint64(63)
        more &= rows[k:]
        after = np.bitwise_or.reduce(more, axis=0)
        live = after.any(axis=0)
        ended = np.flatnonzero(open_ & ~live)
        if len(ended):
            word = (held[:, ended] != 0).argmax(axis=0)
            bits = held[word, ended]
            lowest = bits & (~bits + one)
            own = at[ended]
            size[own] = k
            i[own] = word * 64 + np.bitwise_count(lowest - one) - k + 1
            j[own] = (runs[:, word, ended] & lowest != 0).argmax(axis=0)
            open_[ended] = False
        left = np.count_nonzero(live)
        if not left:
            return size, i, j
        if left < 0.8 * len(at):
            rows, more, after, at, open_ = rows[:, :, live], more[:, :, live], after[:, live], at[live], open_[live]
        runs, held, k = more, after, k + 1


def _columns(codes: np.ndarray, p: np.ndarray, blo: np.ndarray, height: int) -> np.ndarray:
    """Characters of titles ``p`` from places ``blo`` on, a row for each place."""
    return codes.reshape(-1).take((p * codes.shape[1] + blo) + np.arange(height)[:, None], mode="clip")


def _rows(table: np.ndarray, codes: np.ndarray, p: np.ndarray, alo: np.ndarray, la: np.ndarray, blo: np.ndarray, lb: np.ndarray, bits: int) -> np.ndarray:
    """Bits of parts of falling length ``lb`` in titles ``p``, for :func:`_longest`."""
    words, height, letters = max(1, bits // 64), int(lb[0]), table.shape[1]
    c = _columns(codes, p, blo, height)
    rows = np.empty((height, words, len(p)), dtype=table.dtype)
    for w in range(words):
        start = np.minimum(alo + 64 * w, len(table) - 1) * letters
        left = np.clip(la - 64 * w, 0, 64).astype(np.uint64)
        mask = np.where(left == 64, ~np.uint64(0), (_ONE << (left % np.uint64(64))) - _ONE)
        np.bitwise_and(table.reshape(-1).take(c + start if start.any() else c), mask.astype(table.dtype), out=rows[:, w])
    for place in range(int(lb[-1]), height):
        rows[place, :, int(np.searchsorted(-lb, -place, side="left")) :] = 0
    return rows


def matched(name: np.ndarray, codes: np.ndarray, lengths: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Characters of ``name`` in blocks that match each title, or some number below ``need`` where that is out of reach.

    ``codes`` has a row for each title, of falling ``lengths`` below :data:`FREQUENT`; ``name``
    has at least one character and at most :data:`LONGEST`.
    """
    n = len(lengths)
    got = np.zeros(n, dtype=np.int64)
    if not n:
        return got
    own, name = np.unique(name, return_inverse=True)
    letters = len(own) + 1  # the last one stands for all that the name does not have
    most = int(max(codes.max(initial=0), own[-1])) + 1
    small = np.full(most, letters - 1, dtype=np.int64)
    small[own] = np.arange(len(own))
    codes = small[codes[:, : lengths[0]]]
    starts, lb = _starts(name, letters), lengths.astype(np.int64)
    tables = {16: starts.astype(np.uint16), 32: starts.astype(np.uint32)}
    k, i, j = _first_runs([_automaton(name, letters)], np.zeros(n, dtype=np.int64), np.ascontiguousarray(codes.T), lb)
    p, alo, la, blo = np.arange(n), np.zeros(n, dtype=np.int64), np.full(n, len(name)), np.zeros(n, dtype=np.int64)
    while True:
        got += np.bincount(p, k, n).astype(np.int64)
        b, a = (k > 0) & (i > 0) & (j > 0), (k > 0) & (i + k < la) & (j + k < lb)  # parts before and after the run
        parts = ((p[b], p[a]), (alo[b], (alo + i + k)[a]), (i[b], (la - i - k)[a]), (blo[b], (blo + j + k)[a]), (j[b], (lb - j - k)[a]))
        p, alo, la, blo, lb = (np.concatenate(x) for x in parts)
        keep = (got + np.bincount(p, np.minimum(la, lb), n) >= need)[p]
        p, alo, la, blo, lb = (x[keep] for x in (p, alo, la, blo, lb))
        if not len(p):
            return got
        bits = np.where(la <= 16, 16, np.where(la <= 32, 32, (la + 63) // 64 * 64))
        which, long = np.zeros(len(p), dtype=np.int64), np.flatnonzero(la > LONG)
        part, which[long], beside = np.unique(alo[long] * LONGEST + la[long] - 1, return_inverse=True, return_counts=True)
        bits[long[beside[which[long]] >= SHARED]] = 0  # automata
        order = np.argsort((bits // 16 * FREQUENT + FREQUENT - lb).astype(np.uint16), kind="stable")
        p, alo, la, blo, lb, bits, which = (x[order] for x in (p, alo, la, blo, lb, bits, which))
        k, i, j = (np.zeros(len(p), dtype=np.int64) for _ in range(3))
        reach = np.minimum(la, lb)
        first = s = int(np.searchsorted(bits, 1))
        chunks = []
        while s < len(p):
            own = int(bits[s])
            e = min(s + max(1, WORDS * 64 // int(own * lb[s])), int(np.searchsorted(bits, own, side="right")))
            rows = _rows(tables.get(own, starts), codes, p[s:e], alo[s:e], la[s:e], blo[s:e], lb[s:e], own)
            chunks.append((s, e, rows))
            some = (rows[:, 0] if own <= 64 else np.bitwise_or.reduce(rows, axis=1)) != 0
            here = np.add.reduce(some.view(np.uint8), axis=0, dtype=np.uint8)  # places of the title, then of the name, that have a fellow
            reach[s:e] = np.minimum(here, np.bitwise_count(np.bitwise_or.reduce(rows, axis=0)).sum(axis=0))
            s = e
        keep = (got + np.bincount(p, reach, n) >= need)[p] & (reach > 0)
        if len(at := np.flatnonzero(keep[:first])):
            used, own = np.unique(which[at], return_inverse=True)
            automata = [_automaton(name[x : x + y + 1], letters) for x, y in zip(*(z.tolist() for z in np.divmod(part[used], LONGEST)))]
            k[at], i[at], j[at] = _first_runs(automata, own, _columns(codes, p[at], blo[at], int(lb[at[0]])), lb[at])
        for s, e, rows in chunks:
            if len(at := np.flatnonzero(keep[s:e])):
                k[s + at], i[s + at], j[s + at] = _longest(rows if len(at) == e - s else rows[:, :, at])
        p, alo, la, blo, lb, k, i, j = (x[keep] for x in (p, alo, la, blo, lb, k, i, j))
