"""Suffix arrays by induced sorting, and the common prefixes of neighbouring suffixes.

Suffixes are classified as smaller (S) or larger (L) than the next one. The substrings
between leftmost-smaller (LMS) positions are sorted by induction, named, and the string of
names is sorted recursively; the LMS suffixes in order then induce the whole array. The
scans work on all entries up to the first open place at once: what these induce
lies behind them, so a scan over n entries takes few array operations and linear time.
"""

import numpy as np

SEPARATOR, FIRST_BYTE = 1, 2


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``t`` in order; ``t`` ends with 0, its only and smallest one."""
    n = len(t)
    top = int(t.max()) + 1
    if n == 1 or top == n and np.bincount(t, minlength=n).max() == 1:
        order = np.empty(n, np.int64)
        order[t] = np.arange(n)
        return order
    smaller = _types(t)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    rough = _induce(t, top, smaller, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    by_substring = rough[is_lms[rough]]
    names, different = _names(t, lms, by_substring)
    order = suffix_array(names)  # of LMS suffixes; all names differing ends the recursion
    del rough, is_lms, by_substring
    return _induce(t, top, smaller, lms[order])


def _types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; of equal symbols the last one decides."""
    n = len(t)
    same = t[:-1] == t[1:]
    decides = np.where(same, n, np.arange(n - 1))
    decides = np.minimum.accumulate(decides[::-1])[::-1]
    smaller = np.empty(n, bool)
    smaller[:-1] = (t[:-1] < t[1:])[decides]
    smaller[-1] = True
    return smaller


def _names(t: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """LMS substrings, sorted in ``ordered``, as numbers in the order of the text."""
    n = len(t)
    place = np.full(n, -1)
    place[lms] = np.arange(len(lms))
    rank = place[ordered]
    length = np.append(np.diff(lms) + 1, 1)[rank]
    same = np.append(False, length[1:] == length[:-1])
    active = np.flatnonzero(same)
    offset = 0
    while len(active):
        left, right = ordered[active - 1] + offset, ordered[active] + offset
        equal = t[left] == t[right]
        same[active[~equal]] = False
        offset += 1
        active = active[equal]
        active = active[length[active] > offset]
    number = np.cumsum(~same) - 1
    names = np.empty(len(lms), np.int64)
    names[rank] = number
    return names, int(number[-1]) + 1


def _dealt(c: np.ndarray, free: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of the symbols ``c`` and the place each gets: the next free one of its symbol.

    ``free`` is moved on by ``step`` (1 or -1) for every place given.
    """
    order = c.argsort(kind="stable")
    c = c[order]
    new = np.empty(len(c), bool)
    new[0] = True
    np.not_equal(c[1:], c[:-1], out=new[1:])
    heads = new.nonzero()[0]
    places = free[c]
    if len(heads) < len(c):
        places += step * (np.arange(len(c)) - heads[new.cumsum() - 1])
    free[c] = places + step  # the last of a symbol counts
    return order, places


def _induce(t: np.ndarray, top: int, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes from the given order of the LMS ones: first the larger kind, then the smaller."""
    n = len(t)
    if top <= 1 << 16:
        t = t.astype(np.uint16)  # sorted by radix
    kind = np.int32 if n < 1 << 31 else np.int64
    all_, large = np.bincount(t, minlength=top), np.bincount(t[~smaller], minlength=top)
    seeds = np.bincount(t[lms], minlength=top)

    # Larger suffixes, from left to right: each symbol has its larger suffixes, then its LMS ones.
    starts = np.append(0, np.cumsum(large + seeds)[:-1])
    found = np.full(int((large + seeds).sum()), -1, kind)
    order, places = _dealt(t[lms], starts + large, 1)
    found[places] = lms[order]
    free, at, total = starts.copy(), 0, len(found)
    while at < total:
        end = _next_open(found, at)
        before = found[at:end] - 1
        before = before[~smaller[before]]  # the whole text has no suffix before it: -1 is the end, of the smaller kind
        if len(before):
            order, places = _dealt(t[before], free, 1)
            found[places] = before[order]
        at = end

    # Smaller suffixes, from right to left: each symbol has its larger suffixes, then its smaller ones.
    ends = np.cumsum(all_)
    array = np.full(n, -1, kind)
    of = np.repeat(np.arange(top), large)
    within = np.arange(len(of)) - np.repeat(np.append(0, np.cumsum(large)[:-1]), large)
    array[(ends - all_)[of] + within] = found[starts[of] + within]
    array[0] = n - 1
    free, at = ends - 1, n
    while at > 0:
        end = _last_open(array, at)
        before = array[end:at][::-1] - 1
        before = before[(before >= 0) & smaller[before]]
        if len(before):
            order, places = _dealt(t[before], free, -1)
            array[places] = before[order]
        at = end
    return array


def _next_open(array: np.ndarray, at: int) -> int:
    size = 1024
    while at < len(array):
        open_ = array[at : at + size] < 0
        first = int(open_.argmax())
        if open_[first]:
            return at + first
        at, size = at + size, 2 * size
    return len(array)


def _last_open(array: np.ndarray, at: int) -> int:
    """The place after the last open one before ``at``."""
    size = 1024
    while at > 0:
        open_ = array[max(0, at - size) : at][::-1] < 0
        first = int(open_.argmax())
        if open_[first]:
            return at - first
        at, size = at - size, 2 * size
    return 0


def joined(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, raw, rest): pieces behind one another, each with a separator, and an end.

    ``raw`` are the bytes with 0 in the gaps; ``rest`` is how many bytes of its piece follow a place.
    """
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    raw = np.frombuffer(b"\0".join(pieces) + b"\0\0", np.uint8)
    t = raw.astype(np.int32) + FIRST_BYTE
    gaps = np.cumsum(sizes + 1) - 1
    t[gaps], t[-1] = SEPARATOR, 0
    rest = np.append(np.repeat(gaps, sizes + 1), len(t) - 1) - np.arange(len(t))
    return t, raw, rest


def permuted_lcp(t: np.ndarray, raw: np.ndarray, rest: np.ndarray, array: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(lcp, previous) in the order of the text: bytes shared with the suffix before it in the array.

    Matches end at the ends of pieces. Only where the symbols before both suffixes differ is
    anything compared: elsewhere the value is that of the place before, less one. Values
    below ``least`` are only known to be below it.
    """
    n = len(t)
    previous = np.empty(n, np.int64)
    previous[array[1:]] = array[:-1]
    previous[array[0]] = array[0]
    new = np.ones(n, bool)
    new[1:] = (t[:-1] != t[previous[1:] - 1]) | (t[:-1] == SEPARATOR) | (previous[1:] == 0)
    places = np.flatnonzero(new)
    limit = np.minimum(rest[places], rest[previous[places]])
    words = _words(raw)
    value = np.zeros(len(places), np.int64)
    active = np.flatnonzero(limit >= least)  # others stay below
    while len(active):
        at = value[active]
        left, right = places[active] + at, previous[places[active]] + at
        equal = words[left] == words[right]
        stopped = active[~equal]
        if len(stopped):
            differ = words[left[~equal]] ^ words[right[~equal]]
            shared = np.zeros(len(stopped), np.int64)
            for k in range(1, 8):
                shared += differ >> np.uint64(64 - 8 * k) == 0
            value[stopped] += shared
        active = active[equal]
        value[active] += 8
        active = active[value[active] < limit[active]]
    value = np.minimum(value, limit)
    last = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    full = np.zeros(n, np.int64)
    full[places] = value
    return np.maximum(full[last] - (np.arange(n) - last), 0), previous


def _words(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(np.uint64)
    for step in (1, 2, 4):
        padded = padded[:-step] << np.uint64(8 * step) | padded[step:]
    return padded[: len(raw)]


def repeated(pieces: list[bytes], length: int) -> np.ndarray:
    """Whether the ``length`` bytes from a place of the joined pieces on also start at another place.

    False where fewer bytes of the piece are left.
    """
    t, raw, rest = joined(pieces)
    array = suffix_array(t)
    lcp, previous = permuted_lcp(t, raw, rest, array, length)
    found = np.zeros(len(t), bool)
    hits = np.flatnonzero(lcp >= length)
    found[hits] = True
    found[previous[hits]] = True
    return found
