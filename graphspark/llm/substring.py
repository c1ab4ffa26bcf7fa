"""Substring dedup: shared k-mer seeds, collinear chains through a Fenwick tree, aligned passages."""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphspark.llm.common import cut, in_worker, sorted_groups, tidy

#: A-Z become a-z; ASCII digits, a-z and bytes of other characters make words; 0 parts them.
_FOLD = np.array(
    [b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 0 for b in range(256)], np.uint64
)
_WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")
_MULTIPLIER = 0x9E3779B97F4A7C15
_CHUNK = 1 << 20
#: Chars for a word that are read on either side of a chain.
MARGIN = 16
#: A seed's chars are counted up to here.
LONGEST = (1 << 15) - 1
#: Words at either side of a seed of which it carries six bits.
BESIDE = 4
#: Of those eight words, how many must be alike for a seed to be worth reading texts for.
GOES_ON = 2
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers modulo 2^64 of an odd number and of its inverse."""
    size = max(_CHUNK * 2, 1 << (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        base = 1_000_003
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[size] = np.cumprod(up), np.cumprod(down)
    return _POWERS[size]


def _forget() -> None:
    _POWERS.clear()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _slide(x: np.ndarray, w: int, how) -> np.ndarray:
    """how(x[i], ..., x[i + w - 1]) for every i with a whole window."""
    out, span = x, 1
    while span * 2 <= w:
        out = how(out[:-span], out[span:])
        span *= 2
    rest = w - span
    return how(out[: len(out) - rest], out[rest:]) if rest else out


def _repeat_seeds(
    hashed: np.ndarray, places: np.ndarray, h: np.uint64, low: int, high: int, k: int, window: int, min_words: int
) -> list[tuple[int, int]]:
    """(word, key) every ``min_words`` words or so of a run that repeats with a short period.

    ``places`` are those of its one k-mer, of hash ``h``, in the text of words ``low`` to ``high``.
    Runs of fewer words have none, so whoever answers for a key holds a long run.
    """
    q, lo, hi = int(places[0]), max(low, int(places[0]) - 2 * window), min(high, int(places[-1]) + k + 2 * window)
    for period in np.unique(places[1 : window + 1] - q).tolist():
        same = hashed[lo : hi - period] == hashed[lo + period : hi]
        before, after = np.flatnonzero(~same[: q - lo]), np.flatnonzero(~same[q - lo :])
        start = lo + int(before[-1]) + 1 if len(before) else lo
        end = (q + int(after[0]) if len(after) else hi - period) + period
        if end - start >= min_words:
            step = period * -(-min_words // period)
            at = np.arange(q, end - k + 1, step)
            keys = _mix(np.full(len(at), h) + np.arange(1, len(at) + 1, dtype=np.uint64) * np.uint64(_MULTIPLIER))
            return list(zip(at.tolist(), keys.tolist()))
    return []


def seeds_of(texts: list[bytes], k: int, window: int, min_words: int) -> tuple[np.ndarray, ...]:
    """(text index, hash, word index, first char, end char, sides) of the seeds of each text.

    ``sides`` holds six bits of each of the four words before and of the four after, the nearest
    lowest; 0 stands for none.

    A k-mer of words is taken if its first word has a smaller hash than its other words: a matter of
    the k-mer alone, so one that two texts share is a seed of both or of neither, whatever stands beside
    it. Where ``window`` consecutive k-mers have none such, the one with the smallest hash is taken, so any
    shared run of window + k - 1 words shares a seed. Texts of fewer than
    ``min_words`` words have none, and a seed that repeats the text's previous one is left out; a
    long run of such repeats has seeds of its own, numbered, every ``min_words`` words or so.
    """
    none = (np.zeros(0, np.int64),) * 6
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if len(texts) == 0 or len(data) <= k:
        return none
    folded = _FOLD[data]
    word = folded != 0
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    start, end = edge[0::2], edge[1::2]
    if len(start) < max(k, min_words):
        return none
    up, down = _powers(len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(folded * up[: len(data)])])
    hashed = _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    ends = np.cumsum([len(t) + 1 for t in texts])
    text_of = np.searchsorted(ends, start, "right")
    first = np.searchsorted(text_of, np.arange(len(texts)))
    sizes = np.bincount(text_of, minlength=len(texts))
    h = np.zeros(len(start) - k + 1, np.uint64)
    for i in range(k):
        h = h * np.uint64(_MULTIPLIER) + hashed[i : i + len(h)]
    h = _mix(h)
    top = np.uint64(2**64 - 1)
    owner = text_of[: len(h)]
    whole = (owner == text_of[k - 1 :]) & (sizes[owner] >= min_words)
    w = window
    if len(h) < w:
        return none
    ahead = hashed[: len(h)] < _slide(hashed[1:], k - 1, np.minimum) if k > 1 else np.ones(len(h), bool)
    # Seeds by themselves come before all others, which fill the gaps that they leave.
    half = h >> np.uint64(1)
    rank = np.where(ahead, half, half | np.uint64(1 << 63))
    low = _slide(np.where(whole, rank, top), w, np.minimum)
    inside = whole[: len(low)] & whole[w - 1 :] & (owner[: len(low)] == owner[w - 1 :])
    low = np.where(inside, low, np.uint64(0))
    padded = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
    best = _slide(padded, w, np.maximum)
    at = np.flatnonzero(whole & (ahead | (best == rank)) & (h != 0))
    if len(at) == 0:
        return none
    again = np.zeros(len(at), bool)
    again[1:] = (h[at[1:]] == h[at[:-1]]) & (owner[at[1:]] == owner[at[:-1]])
    heads = np.flatnonzero(~again)
    more_at, more = [], []
    for lo, hi in zip(heads, np.append(heads[1:], len(at))):
        if hi - lo > 1 and at[hi - 1] - at[lo] + k + 4 * w >= min_words:
            t = owner[at[lo]]
            for q, key in _repeat_seeds(hashed, at[lo:hi], h[at[lo]], int(first[t]), int(first[t] + sizes[t]), k, w, min_words):
                more_at.append(q)
                more.append(key)
    at = at[~again]
    keys = np.concatenate([h[at], np.array(more, np.uint64)])
    at = np.concatenate([at, np.array(more_at, np.int64)])
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    text = owner[at]
    base = chars[np.concatenate([[0], ends[:-1]])][text]
    sides = np.zeros(len(at), np.int64)
    for place, step in enumerate([*range(-1, -1 - BESIDE, -1), *range(k, k + BESIDE)]):
        there = np.clip(at + step, 0, len(hashed) - 1)
        own = (text_of[there] == text) & (there == at + step)
        sides |= np.where(own, hashed[there] & np.uint64(63), 0).astype(np.int64) << (6 * place)
    return text, keys.view(np.int64), at - first[text], chars[start[at]] - base, chars[end[at + k - 1]] - base, sides


def _seeds(docs: DataFrame, k: int, window: int, min_words: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            texts = batch.column("text").to_pylist()
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) < _CHUNK):
                    size += len(texts[hi]) + 1
                    hi += 1
                t, h, w, c, e, sides = seeds_of(texts[lo:hi], k, window, min_words)
                yield pa.RecordBatch.from_pydict(
                    {
                        "h": pa.array(h, pa.int64()),
                        "doc": pa.array(ids[lo:hi][t] if len(t) else [], pa.int64()),
                        "at": pa.array(w << 32 | c, pa.int64()),
                        "near": pa.array(np.minimum(e - c, LONGEST) << 48 | sides, pa.int64()),
                    }
                )
                lo = hi

    source = docs.where("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")
    )
    return source.mapInArrow(in_worker("substring", run, _forget), "h long, doc long, at long, near long")


def _unpacked(at: str, near: str, prefix: str = "") -> list[Column]:
    """The word, first and end char of a seed's place: at is word and char, near length and words beside.

    A seed of LONGEST chars or more is taken to end with its text.
    """
    c, size = F.col(at).bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(near, 48)
    end = F.when(size < LONGEST, c + size).otherwise(F.lit(1 << 31) - 1 - (1 << 20))
    return [F.shiftrightunsigned(at, 32).cast("int").alias(f"{prefix}w"), c.cast("int").alias(f"{prefix}c"), end.cast("int").alias(f"{prefix}e")]


def _goes_on(mine: str, other: str) -> Column:
    """Whether a seed's passage can go on beyond it: GOES_ON of the eight words beside it, or more, are alike by their bits.

    Of an exact passage at least four are, on one side or the other. Of one with a fifth of its words
    edited more than six are on average, so hardly a chain of it has no such seed; a phrase that chance
    repeats seldom has two.
    """
    differ = F.col(mine).bitwiseXOR(F.col(other))
    return sum((differ.bitwiseAND(F.lit(63 << 6 * i)) == 0).cast("int") for i in range(2 * BESIDE)) >= GOES_ON


class Fenwick:
    """Prefix maxima of (value, index) over ranks 0..n-1."""

    def __init__(self, n: int) -> None:
        self.best: list[tuple[float, int]] = [(-np.inf, -1)] * (n + 1)

    def raise_to(self, rank: int, value: float, index: int) -> None:
        i = rank + 1
        while i < len(self.best):
            if self.best[i][0] < value:
                self.best[i] = (value, index)
            i += i & -i

    def below(self, rank: int) -> tuple[float, int]:
        """The best of ranks 0..rank-1."""
        out = (-np.inf, -1)
        while rank > 0:
            if self.best[rank][0] > out[0]:
                out = self.best[rank]
            rank &= rank - 1
        return out


def chains(x: list[int], y: list[int], gain: float, gap: float) -> list[list[int]]:
    """Disjoint chains of matches (x, y), both ascending strictly, the best first.

    A chain scores ``gain`` a match less ``gap`` for every word, on either side, from each match to
    the next. That cost splits into a part of either match, so the best predecessor of a match is a
    prefix maximum over y while x ascends. ``x`` must be sorted.
    """
    n = len(x)
    if n == 0:
        return []
    rank = {v: i for i, v in enumerate(sorted(set(y)))}
    tree = Fenwick(len(rank))
    score, back = [0.0] * n, [-1] * n
    i = 0
    while i < n:
        j = i
        while j < n and x[j] == x[i]:  # matches at one place do not follow each other
            value, prev = tree.below(rank[y[j]])
            through = value - gap * (x[j] + y[j])
            score[j], back[j] = (gain + through, prev) if through > 0 else (gain, -1)
            j += 1
        for m in range(i, j):
            tree.raise_to(rank[y[m]], score[m] + gap * (x[m] + y[m]), m)
        i = j
    used = [False] * n
    out = []
    for m in sorted(range(n), key=lambda m: (-score[m], m)):
        chain = []
        while m >= 0 and not used[m]:
            used[m] = True
            chain.append(m)
            m = back[m]
        if chain:
            out.append(chain[::-1])
    return out


def edit_distance(a: list, b: list, most: int) -> int | None:
    """Insertions and deletions that turn a into b, or None if there are more than ``most``."""
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    ha, hb = len(a), len(b)
    while ha > lo and hb > lo and a[ha - 1] == b[hb - 1]:
        ha, hb = ha - 1, hb - 1
    a, b = a[lo:ha], b[lo:hb]
    n, m = len(a), len(b)
    if n == 0 or m == 0:
        return n + m if n + m <= most else None
    reach = {1: 0}
    for d in range(min(most, n + m) + 1):
        for diagonal in range(-d, d + 1, 2):
            if diagonal == -d or (diagonal != d and reach[diagonal - 1] < reach[diagonal + 1]):
                i = reach[diagonal + 1]
            else:
                i = reach[diagonal - 1] + 1
            j = i - diagonal
            while i < n and j < m and a[i] == b[j]:
                i, j = i + 1, j + 1
            if i >= n and j >= m:
                return d
            reach[diagonal] = i
    return None


def extend(a: Iterable, b: Iterable, drop: int = 8, penalty: int = 3) -> int:
    """How far a and b go on alike: words until the score falls ``drop`` below its best."""
    best = score = 0
    take = 0
    for n, (p, q) in enumerate(zip(a, b), 1):
        score += 1 if p == q else -penalty
        if score > best:
            best, take = score, n
        elif score < best - drop:
            break
    return take


def follow(a: list, b: list, drop: int = 20, penalty: int = 3, skip: int = 4) -> list[tuple[int, int, int]]:
    """(i, p, length) of runs of equal words from the beginnings of a and b on, over small edits.

    Where the two part, they go on at the nearest place, at most ``skip`` words ahead on either side,
    at which two words in a row are equal again, or one if as many words were replaced. Every word that
    is passed over costs ``penalty``; the walk ends when the score is ``drop`` below its best.
    """
    out, x, y, best, score = [], 0, 0, 0, 0
    while x < len(a) and y < len(b):
        run = 0
        while x + run < len(a) and y + run < len(b) and a[x + run] == b[y + run]:
            run += 1
        if run:
            out.append((x, y, run))
            x, y, score = x + run, y + run, score + run
            best = max(best, score)
        step = None
        for far in range(1, 2 * skip + 1):
            for dx in sorted(range(max(0, far - skip), min(skip, far) + 1), key=lambda d: abs(far - 2 * d)):
                i, p = x + dx, y + far - dx
                if i < len(a) and p < len(b) and a[i] == b[p] and (2 * dx == far or (i + 1 < len(a) and p + 1 < len(b) and a[i + 1] == b[p + 1])):
                    step = (dx, far - dx)
                    break
            if step:
                break
        dx, dy = step or (1, 1)
        x, y, score = x + dx, y + dy, score - penalty * max(dx, dy)
        if score < best - drop:
            break
    return out


def _folded(text: str) -> str:
    """A-Z lower-cased, every char in its place."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _words(text: str) -> tuple[list[str], list[int], list[int]]:
    found = list(_WORD.finditer(_folded(text)))
    return [m.group() for m in found], [m.start() for m in found], [m.end() for m in found]


def _word_at(folded: str, at: int) -> int | None:
    """The index of the word that starts at a char; null if none does."""
    if not 0 <= at < len(folded) or not _WORD.match(folded, at) or (at and _WORD.match(folded, at - 1)):
        return None
    return len(_WORD.findall(folded, 0, at))


def _span(folded: str, first: int, last: int) -> tuple[int, int]:
    """The chars from the first to the last word of the given indices."""
    words = itertools.islice(_WORD.finditer(folded), first, last + 1)
    start = next(words)
    end = start
    for end in words:
        pass
    return start.start(), end.end()


def _runs(a: list, b: list, i: int, p: int, n: int) -> list[tuple[int, int, int]]:
    """(i, p, length) of the runs of equal words among the n words from a[i] and b[p]."""
    out, at = [], 0
    while at < n:
        run = at
        while run < n and a[i + run] == b[p + run]:
            run += 1
        if run > at:
            out.append((i + at, p + at, run - at))
        at = run + 1
    return out


def _blocks(a: list, b: list, chain: list[tuple[int, int]], k: int, far: bool = False) -> list[tuple[int, int, int]]:
    """(i, p, length) of equal runs along a chain of k-word matches, in order and apart.

    Each match is extended word by word into the gaps beside it to where that is best, or ``far``: over
    small edits for as long as words go on alike.
    """
    solid: list[list[int]] = []
    for i, p in chain:
        skip = max(0, solid[-1][0] + solid[-1][2] - i, solid[-1][1] + solid[-1][2] - p) if solid else 0
        if skip >= k:
            continue
        if solid and i + skip == solid[-1][0] + solid[-1][2] and p + skip == solid[-1][1] + solid[-1][2]:
            solid[-1][2] += k - skip
        else:
            solid.append([i + skip, p + skip, k - skip])
    out = []
    i = p = 0
    for i1, p1, n in [*solid, [len(a), len(b), 0]]:
        if far:
            on = [(i + x, p + y, m) for x, y, m in follow(a[i:i1], b[p:p1])] if out else []
            out += on
            x, y = (on[-1][0] + on[-1][2], on[-1][1] + on[-1][2]) if on else (i, p)
            back = follow(a[x:i1][::-1], b[y:p1][::-1]) if n else []
            out += [(i1 - u - m, p1 - v - m, m) for u, v, m in reversed(back)]
        else:
            on = extend(a[i:i1], b[p:p1]) if out else 0
            out += _runs(a, b, i, p, on)
            back = extend(a[i + on : i1][::-1], b[p + on : p1][::-1]) if n else 0
            out += _runs(a, b, i1 - back, p1 - back, back)
        if n:
            out.append((i1, p1, n))
        i, p = i1 + n, p1 + n
    return out


def _stretches(blocks: list[tuple[int, int, int]], edits: list[int], similarity: float) -> list[tuple[int, int]]:
    """(first, last) of every run of blocks that is similar enough and lies in no longer such run."""
    starts, ends = [], []
    total = 0
    for (i, p, n), d in zip(blocks, [0, *edits]):
        total += d
        starts.append((1 - similarity) * (i + p) - total)
        ends.append((1 - similarity) * (i + p + 2 * n) - total)
    best = list(itertools.accumulate(reversed(ends), max))[::-1]
    out, reach = [], -1
    for s, least in enumerate(starts):
        t = bisect.bisect_right(best, 1e-9 - least, lo=s, key=lambda v: -v) - 1
        if t > reach:
            out.append((s, t))
            reach = t
    return out


def _least_edits(a: list, b: list) -> int:
    """A lower bound of the edits that turn a into b: words that the other side lacks."""
    if not a or not b:
        return len(a) + len(b)
    if len(a) == 1 or len(b) == 1:
        one, other = (a, b) if len(a) == 1 else (b, a)
        return len(other) + 1 - 2 * (one[0] in other)
    return len(a) + len(b) - 2 * sum((Counter(a) & Counter(b)).values())


def align(
    text: str, ref: str, at: int, ref_at: int, chain: list[tuple[int, int]], k: int, similarity: float, min_words: int
) -> list[tuple[int, int, int, int, int, float]]:
    """(start, end, ref start, ref end, words, similarity) of the passages along a chain, in chars.

    ``at`` and ``ref_at`` are the first char of the chain's first match in the slices, ``chain`` the
    words from there to the start of each match of ``k`` words. The chain is extended on both sides
    and into its gaps word by word (as far as that pays, and where no passage comes of it, as far as words
    are shared) and falls apart where the gaps do not align: a passage has
    ``min_words`` words on both sides and 2 * matches / (words of both) of at least ``similarity``
    in the best alignment, and no longer part of the chain that has this holds it.
    """
    text, ref = _folded(text), _folded(ref)
    i, p = _word_at(text, at), _word_at(ref, ref_at)
    if i is None or p is None:
        return []
    a, b = _WORD.findall(text), _WORD.findall(ref)
    places = [(i + x, p + y) for x, y in chain]
    found = _passages(a, b, _blocks(a, b, places, k), similarity, min_words)
    if not found and _could_hold(a, b, places, similarity, min_words):
        # Edits near the ends of a passage can outweigh its words there, though not those of the whole.
        wide = _blocks(a, b, places, k, far=True)
        if sum(n for _, _, n in wide) >= 2 * similarity * min_words - min_words:
            found = _passages(a, b, wide, similarity, min_words)
    return [(*_span(text, i, j - 1), *_span(ref, p, q - 1), j - i, alike) for i, j, p, q, alike in found]


def _could_hold(a: list, b: list, places: list[tuple[int, int]], similarity: float, min_words: int) -> bool:
    """Whether some ``min_words`` words of a near the chain are mostly words that b has near it.

    In a passage at least ``similarity`` of both sides' words are matched, so of the longer side no less
    than similarity / (2 - similarity).
    """
    (i, p), (j, q) = places[0], places[-1]
    reach = 2 * min_words
    there = set(b[max(0, p - reach) : q + reach])
    run = [0, *itertools.accumulate(w in there for w in a[max(0, i - reach) : j + reach])]
    least = similarity / (2 - similarity) * min_words
    return any(y - x >= least for x, y in zip(run, run[min_words:]))


def _passages(a: list, b: list, blocks: list[tuple[int, int, int]], similarity: float, min_words: int) -> list[tuple[int, int, int, int, float]]:
    """(i, j, p, q, similarity) of the passages a[i:j] and b[p:q] that runs of equal words make up."""
    gaps = [
        (a[i + n : i1], b[p + n : p1]) for (i, p, n), (i1, p1, _) in zip(blocks[:-1], blocks[1:])
    ]

    def long(stretches):
        for s, t in stretches:
            i, p, _ = blocks[s]
            j, q, n = blocks[t]
            if min(j + n - i, q + n - p) >= min_words:
                yield s, t, i, j + n, p, q + n

    def whole():
        i, p, _ = blocks[0]
        j, q, n = blocks[-1]
        j, q = j + n, q + n
        most = int((1 - similarity) * (j - i + q - p) + 1e-9)
        if min(j - i, q - p) >= min_words and _least_edits(a[i:j], b[p:q]) <= most:
            if edit_distance(a[i:j], b[p:q], most) is not None:
                yield 0, len(blocks) - 1, i, j, p, q

    edits = [_least_edits(x, y) for x, y in gaps]
    exact = [not (x and y) for x, y in gaps]
    for s, t, i, j, p, q in list(long(_stretches(blocks, edits, similarity))):
        most = int((1 - similarity) * (j - i + q - p) + 1e-9)
        for g in range(s, t):
            if not exact[g]:
                d = edit_distance(*gaps[g], most)
                # More than the widest stretch may have: no stretch goes over this gap.
                edits[g], exact[g] = (d, True) if d is not None else (max(edits[g], most + 1), False)
    found = list(long(_stretches(blocks, edits, similarity)))
    if [(s, t) for s, t, *_ in found] != [(0, len(blocks) - 1)]:
        found = list(whole()) or found
    out = []
    for _, _, i, j, p, q in found:
        d = edit_distance(a[i:j], b[p:q], int((1 - similarity) * (j - i + q - p) + 1e-9))
        if d is not None:
            out.append((i, j, p, q, (j - i + q - p - d) / (j - i + q - p)))
    return out


def shared_passages(
    docs: DataFrame, k: int = 5, window: int = 12, min_words: int = 50, similarity: float = 0.8, gap: float = 0.05
) -> DataFrame:
    """Passages of a document that an earlier one (a smaller doc_id) has as well, up to small edits.

    Returns (doc_id, start, end, n_words, ref_doc_id, ref_start, ref_end, similarity, n_seeds):
    char offsets in code points, end exclusive. Words are runs of digits, letters and non-ASCII
    characters, A-Z lower-cased. A passage has at least ``min_words`` words on both sides.

    Each seed's smallest document answers for it: every other occurrence is matched with that one
    only, so a passage that very many documents share gives rows in proportion to them, and each
    copy is found once, in every document but the first. Matches of a pair of documents are
    chained, each chain is aligned over slices of both texts, and it falls apart into
    passages where its gaps do not align. A passage goes on for at most MARGIN * ``min_words`` chars
    beyond the chain it was found by; the seeds of what lies further answer for that.

    A chain none of whose seeds has two of the eight words beside it alike is dropped before its
    texts are read: a passage has 50 words, and single seeds are mostly phrases that chance repeats.

    A passage whose parts lie in several smaller documents is not found through its seeds. Where a
    stretch of shared seeds is left without a passage, its windows of ``min_words`` words are
    matched with the smallest document that holds each, so every exact passage is found.

    Null texts and ids, empty texts and texts of fewer words have no passages. Rows that share a
    doc_id count as one document; repeats within a document are not looked for. Equal rows of the
    result are returned once. Other columns are ignored.
    """
    seeds = _seeds(docs, k, window, min_words)
    # Which document answers for a seed is all that is settled for every seed; its place there is looked up for shared ones.
    first = seeds.groupBy("h").agg(F.min("doc").alias("odoc"), F.max("doc").alias("last")).where("odoc <> last").select("h", "odoc")
    shared = cut(seeds.join(first, "h"))
    tidy(docs.sparkSession)
    place = shared.where("doc = odoc").groupBy("h").agg(F.min(F.struct("at", "near")).alias("o")).select("h", F.col("o.at").alias("oat"), F.col("o.near").alias("onear"))
    met = shared.where("doc <> odoc").join(place, "h")
    met = met.select("doc", "odoc", *_unpacked("at", "near"), *_unpacked("oat", "onear", "o"), _goes_on("near", "onear").alias("alive"))
    gain = float(k)

    def link(batches):
        names = ["doc", "odoc", "c", "e", "oc", "oe", "n", "ws", "ows"]
        kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * 2

        def rows(tables):
            for t in tables:
                cols = [t.column(c).to_numpy(zero_copy_only=False) for c in ("w", "ow", "c", "e", "oc", "oe", "alive")]
                pair = t.column("odoc").to_numpy()
                doc = t.column("doc")[0].as_py()
                cuts = [0, *(np.flatnonzero(pair[1:] != pair[:-1]) + 1).tolist(), len(pair)]
                for lo, hi in zip(cuts[:-1], cuts[1:]):
                    part = [x[lo:hi] for x in cols]
                    once = np.append(True, (np.diff(part[0]) != 0) | (np.diff(part[1]) != 0))
                    if not part[-1].any():
                        continue
                    w, ow, c, e, oc, oe, alive = (x[once].tolist() for x in part)
                    for chain in chains(w, ow, gain, gap):
                        if not any(alive[m] for m in chain):
                            continue
                        f, g = chain[0], chain[-1]
                        steps = [[x[m] - x[f] for m in chain] for x in (w, ow)]
                        yield doc, int(pair[lo]), c[f], e[g], oc[f], oe[g], len(chain), *steps

        out = []
        for row in rows(t for _, t in sorted_groups(batches, "doc")):
            out.append(row)
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_pydict({n: pa.array(v, t) for n, v, t in zip(names, zip(*out), kinds)})
                out = []
        if out:
            yield pa.RecordBatch.from_pydict({n: pa.array(v, t) for n, v, t in zip(names, zip(*out), kinds)})

    found = (
        met.repartition("doc")
        .sortWithinPartitions("doc", "odoc", "w", "ow")
        .mapInArrow(link, "doc long, odoc long, c long, e long, oc long, oe long, n long, ws array<int>, ows array<int>")
    )
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chained = cut(found)
    # The files of each step go before the next one writes its own.
    del found, met, place, first, seeds
    tidy(docs.sparkSession)
    told = cut(_aligned(chained, texts, k, similarity, min_words))
    del chained
    tidy(docs.sparkSession)
    matches = shared.where("doc <> odoc").select("h", "doc", *_unpacked("at", "near"))
    rest = cut(_whole_windows(matches, told, texts, k, window, min_words))
    del matches, shared
    tidy(docs.sparkSession)
    return told.union(_aligned(rest, texts, min_words, similarity, min_words)).distinct()


def _stretch_rows(matches: DataFrame, k: int, window: int, min_words: int) -> DataFrame:
    """``matches`` (doc, w, ...) that lie in a stretch that a shared run of ``min_words`` words can fill.

    Neighbouring seeds of a shared run are at most ``window`` words apart, and it goes on for fewer
    words than that before the first and after the last. ``stretch`` is the stretch's first word.
    """

    def run(batches):
        for _, t in sorted_groups(batches, "doc"):
            w = t.column("w").to_numpy()
            new = np.append(True, np.diff(w) > window)
            at = np.flatnonzero(new)
            first, last = w[at], w[np.append(at[1:], len(w)) - 1]
            part = np.cumsum(new) - 1
            keep = (last - first + k + 2 * (window - 1) >= min_words)[part]
            t = t.append_column("stretch", pa.array(first[part].astype(np.int32))).filter(pa.array(keep))
            yield from t.to_batches()

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in matches.schema)
    return matches.repartition("doc").sortWithinPartitions("doc", "w").mapInArrow(run, schema + ", stretch int")


def _whole_windows(matches: DataFrame, told: DataFrame, texts: DataFrame, k: int, window: int, min_words: int) -> DataFrame:
    """Chains of one match of ``min_words`` words each, for stretches that the passages told leave open.

    A run that two documents share, and whose seeds all have smaller holders, has all its seeds in
    ``matches`` on both sides; so windows of these stretches only are compared.
    """
    spans = told.groupBy(F.col("doc_id").alias("doc")).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    near = _stretch_rows(matches.select("doc", "w", "h", "c", "e"), k, window, min_words)
    left = near.join(spans, "doc", "left").where("spans is null or not exists(spans, s -> s.start <= c and e <= s.end)")
    open_ = left.select("doc", "stretch").distinct()
    wanted = near.join(open_, ["doc", "stretch"], "left_semi").select("h").distinct()
    held = _stretch_rows(matches.join(wanted, "h", "left_semi").select("doc", "w", "c", "e"), k, window, min_words)
    ranges = held.groupBy("doc", "stretch").agg(F.min("c").alias("lo"), F.max("e").alias("hi"))
    margin = MARGIN * min_words
    begin = f"greatest(0, lo - {margin})"
    slices = ranges.join(texts.withColumnRenamed("doc_id", "doc"), "doc").select(
        "doc", "stretch", F.expr(begin).alias("base"), F.expr(f"lo - {begin}").alias("lo"), F.expr(f"hi - {begin}").alias("hi"),
        F.expr(f"substring(text, {begin} + 1, hi - {begin} + {margin})").alias("slice"),
    )

    def windows(batches):
        for batch in batches:
            for r in batch.to_pylist():
                words, starts, ends = _words(r["slice"])
                # The first and last word of a slice may be cut; no run goes on for ``window`` words beyond the stretch.
                lo = max(0, bisect.bisect_left(starts, r["lo"]) - window)
                hi = min(len(words), bisect.bisect_right(ends, r["hi"]) + window)
                n = max(0, hi - lo - min_words + 1)
                at = range(lo, lo + n)
                digests = [hashlib.blake2b(" ".join(words[i : i + min_words]).encode(), digest_size=16).digest() for i in at]
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": pa.array(digests, pa.binary()),
                        "doc": pa.array([r["doc"]] * n, pa.int64()),
                        "c": pa.array([r["base"] + starts[i] for i in at], pa.int64()),
                        "e": pa.array([r["base"] + ends[i + min_words - 1] for i in at], pa.int64()),
                        "w": pa.array(list(at), pa.int64()),
                        "stretch": pa.array([r["stretch"]] * n, pa.int64()),
                    }
                )

    rows = slices.mapInArrow(windows, "key binary, doc long, c long, e long, w long, stretch long")
    rows = cut(rows)
    tidy(rows.sparkSession)
    holder = rows.groupBy("key").agg(F.min(F.struct("doc", "c", "e", "w", "stretch")).alias("o"), F.max("doc").alias("last"))
    holder = holder.where("o.doc <> last").select("key", "o")
    met = rows.join(holder, "key").where("doc <> o.doc")
    # Windows that follow each other on both sides are one run.
    order = Window.partitionBy("doc", "stretch", F.col("o.doc"), F.col("o.stretch"), F.col("w") - F.col("o.w")).orderBy("w")
    met = met.withColumn("new", F.coalesce(F.col("w") - F.lag("w").over(order) > 1, F.lit(True))).where("new")
    zero = F.array(F.lit(0))
    return met.select(
        "doc", F.col("o.doc").alias("odoc"), "c", "e", F.col("o.c").alias("oc"), F.col("o.e").alias("oe"), F.lit(1).cast("long").alias("n"), zero.alias("ws"), zero.alias("ows")
    ).distinct()


def _aligned(found: DataFrame, texts: DataFrame, k: int, similarity: float, min_words: int) -> DataFrame:
    """The passages of chains of matches of ``k`` words, over slices of both texts.

    A document's text is dealt out once for both sides, and what goes on to the other one is the slice.
    """
    margin = MARGIN * min_words

    def sliced(rows: DataFrame, doc: str, lo: str, hi: str, name: str) -> DataFrame:
        begin = F.greatest(F.lit(0), F.col(lo) - margin)
        own = rows.join(texts.withColumnRenamed("doc_id", doc), doc)
        piece = F.col("text").substr((begin + 1).cast("int"), (F.col(hi) + margin - begin).cast("int"))
        return own.select(*rows.columns, begin.alias(f"{name}_at"), piece.alias(name))

    pairs = sliced(sliced(found, "doc", "c", "e", "left"), "odoc", "oc", "oe", "right")

    def passages(batches):
        names = ["doc_id", "start", "end", "n_words", "ref_doc_id", "ref_start", "ref_end", "similarity", "n_seeds"]
        kinds = [pa.int64()] * 7 + [pa.float64(), pa.int64()]
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("doc", "odoc", "c", "oc", "n", "ws", "ows", "left_at", "right_at", "left", "right")))
            out = []
            for doc, odoc, c, oc, n, ws, ows, a, b, left, right in rows:
                for s, e, rs, re_, words, sim in align(left, right, c - a, oc - b, list(zip(ws, ows)), k, similarity, min_words):
                    out.append((doc, s + a, e + a, words, odoc, rs + b, re_ + b, sim, n))
            cols = list(zip(*out)) if out else [[]] * 9
            yield pa.RecordBatch.from_pydict({n: pa.array(c, t) for n, c, t in zip(names, cols, kinds)})

    schema = (
        "doc_id long, start long, end long, n_words long, ref_doc_id long, ref_start long, ref_end long, "
        "similarity double, n_seeds long"
    )
    return pairs.mapInArrow(in_worker("substring", passages, _forget), schema)


def numbered(docs: DataFrame) -> DataFrame:
    """(row struct, doc long): rows of ``docs`` under a number that stands for one text.

    It is doc_id, but where different texts share one: of those, one text keeps the id and each other
    text gets a number of its own beyond all ids, so that offsets never meet another text. Texts are
    told apart by a 128-bit hash. Rows without an id or a text have no number.
    """
    text = F.when(F.col("doc_id").isNotNull() & F.col("text").isNotNull(), F.col("text"))
    keys = [F.xxhash64(F.lit(i), text).alias(f"h{i}") for i in (1, 2)]
    rows = docs.select(F.struct("*").alias("row"), F.when(text.isNotNull(), F.col("doc_id").cast("long")).alias("doc"), *keys)
    known = rows.where("doc is not null").select("doc", F.struct("h1", "h2").alias("h"))
    several = known.groupBy("doc").agg(F.min("h").alias("first"), F.max("h").alias("last")).where("first <> last").select("doc", "first")
    others = cut(known.join(several, "doc").where("h <> first").select("doc", "h.h1", "h.h2").distinct())
    if others.isEmpty():
        return rows.select("row", "doc")
    beyond = known.agg(F.max("doc")).first()[0]
    new = others.withColumn("new", F.lit(beyond) + 1 + F.monotonically_increasing_id())
    return rows.join(new, ["doc", "h1", "h2"], "left").select("row", F.coalesce("new", "doc").alias("doc"))


def cut_shared(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the passages that an earlier text has as well, as ``shared_passages`` finds them.

    Texts count one by one: where different texts share a doc_id, the passages of each are its own
    (and the order among them is arbitrary but fixed). Rows without a passage come back as they are,
    those without an id or a text too; equal rows are cut alike. A row whose text is nothing but
    passages stays, with an empty text. n_chars follows. Other columns may have any names.
    """
    rows = numbered(docs)
    passages = shared_passages(rows.select(F.col("doc").alias("doc_id"), F.col("row.text").alias("text")), **options)
    return _without(rows, passages, docs)


def remove_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs`` without the passages' chars; overlapping spans count once, n_chars follows.

    ``passages`` has doc_id, start and end, and a doc_id must stand for one text: offsets belong to a
    text (``cut_shared`` looks after ids that several texts share). Rows without a passage come back
    as they are. A row whose text is nothing but passages stays, with an empty text.
    """
    return _without(docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc")), passages, docs)


def _without(rows: DataFrame, passages: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows (row, doc) without the passages of ``doc``, in the columns of ``docs``."""
    spans = passages.groupBy(F.col("doc_id").alias("doc")).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    # Keep what lies between the running end of the spans so far and the next start.
    kept = F.expr(
        """
        aggregate(spans, named_struct('text', cast('' as string), 'at', cast(0 as bigint)),
          (s, x) -> named_struct(
            'text', if(x.start > s.at, concat(s.text, substring(row.text, cast(s.at + 1 as int), cast(x.start - s.at as int))), s.text),
            'at', greatest(s.at, x.end)),
          s -> concat(s.text, substring(row.text, cast(s.at + 1 as int), length(row.text))))
        """
    )
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(kept)
    changed = rows.join(spans, "doc", "left").select("row", F.col("spans").isNotNull().alias("cut"), text.alias("text"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col("cut"), size).otherwise(F.col("row.n_chars"))
    return changed.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
