"""Edit distances of many pairs at once: a column of each pair's matrix in the bits of 64-bit words (Myers 1999, in blocks as
Hyyro 2003 has them).

Sequences come as one array of symbols (code points, or numbers of words) and the ends of each. The shorter of two is the pattern.
A word of a pattern needs what the word before has carried out at the same symbol; so in each step every word reads the symbol
after the one it has read, a step behind the word before, and one numpy operation is for all words of all pairs of a group.
Groups are of pairs whose texts are about as long. Where only a few are, integers of any length are faster, a pair at a time.
Their work is the product of the lengths; where a bound from below meets one from above, a long pair needs none of it.
"""

from __future__ import annotations

import numpy as np

#: Words of the patterns of a group at most (what an operation reads then fits a processor's cache), pairs that make one at
#: least, and symbols of a text in one at most.
WORDS, FEW, LONG = 4096, 12, 2500
_ONE, _TOP, _FULL = np.uint64(1), np.uint64(63), np.uint64(0xFFFFFFFFFFFFFFFF)


def single(a: list, b: list) -> int:
    """The distance of two sequences of any length."""
    low = 0
    while low < len(a) and low < len(b) and a[low] == b[low]:
        low += 1
    a, b = a[low:], b[low:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return len(a) + len(b)
    if len(a) > len(b):
        a, b = b, a
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    up, down = full, 0  # vertical differences of +1 and -1
    for x in b:
        match = at.get(x, 0)
        diagonal = ((((match & up) + up) ^ up) | match | down) & full
        plus, minus = (down | (full ^ (diagonal | up))) << 1 & full | 1, (up & diagonal) << 1 & full
        up, down = minus | (full ^ (diagonal | plus)), plus & diagonal
    return len(b) + up.bit_count() - down.bit_count()


def bounds(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(least, most) that the distance can be: the symbols that one holds and the other lacks, counted with repeats, and the
    places that differ where both are laid side by side. Of texts in which only symbols were exchanged they are often equal."""
    n = min(len(a), len(b))
    most = int(np.count_nonzero(a[:n] != b[:n])) + max(len(a), len(b)) - n
    both = np.concatenate([a, b])
    if len(both) and both.max() > 1 << 16:
        both = np.unique(both, return_inverse=True)[1]
    size = int(both.max(initial=0)) + 1
    over = np.bincount(both[: len(a)], minlength=size) - np.bincount(both[len(a) :], minlength=size)
    return max(int(over[over > 0].sum()), int(-over[over < 0].sum())), most


def _spread(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place within it) of every symbol of sequences."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _together(pattern: np.ndarray, m: np.ndarray, text: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Distances of pairs of patterns (m symbols each, m > 0) and texts (n symbols each)."""
    pairs, words, longest, shortest = len(m), int(m.max() + 63) >> 6, int(n.max()), int(n.min())
    owner, place = _spread(m)
    keys, of = np.unique(owner.astype(np.uint64) << np.uint64(32) | pattern.astype(np.uint64), return_inverse=True)
    lacks = len(keys)  # stands for symbols that a pattern lacks
    masks = np.zeros((words, lacks + 1), np.uint64)
    np.bitwise_or.at(masks, (place >> 6, of), _ONE << (place & 63).astype(np.uint64))
    masks = masks.ravel()
    owner, place = _spread(n)
    wanted = owner.astype(np.uint64) << np.uint64(32) | text.astype(np.uint64)
    found = np.minimum(np.searchsorted(keys, wanted), lacks - 1)
    rows = np.full((longest + words, pairs), lacks, np.int32)
    rows[place, owner] = np.where(keys[found] == wanted, found, lacks)
    base = (np.arange(words) * (lacks + 1))[:, None]
    up, down = np.full((words, pairs), _FULL), np.zeros((words, pairs), np.uint64)
    rise, fall = np.zeros((words + 1, pairs), np.uint64), np.zeros((words + 1, pairs), np.uint64)  # carried into a word
    rise[0] = 1
    for step in range(longest + words - 1):
        k = min(words, step + 1)  # words that have begun
        match = masks[rows[step - k + 1 : step + 1][::-1] + base[:k]]
        p, d, r, f = up[:k], down[:k], rise[:k], fall[:k]
        vertical = match | d
        match |= f
        diagonal = match & p
        diagonal += p
        diagonal ^= p
        diagonal |= match
        plus, minus = d | ~(diagonal | p), p & diagonal
        out = plus >> _TOP, minus >> _TOP
        plus <<= _ONE
        plus |= r
        minus <<= _ONE
        minus |= f
        minus |= ~(vertical | plus)
        plus &= vertical
        if step < shortest:
            up[:k], down[:k] = minus, plus
        else:  # some have read their last symbol
            reads = n[None, :] > step - np.arange(k)[:, None]
            np.copyto(p, minus, where=reads)
            np.copyto(d, plus, where=reads)
        rise[1 : k + 1], fall[1 : k + 1] = out
    bits = np.clip(m[None, :] - 64 * np.arange(words)[:, None], 0, 64)
    own = np.where(bits == 64, _FULL, (_ONE << np.minimum(bits, 63).astype(np.uint64)) - _ONE)
    return n + np.bitwise_count(up & own).sum(0, dtype=np.int64) - np.bitwise_count(down & own).sum(0, dtype=np.int64)


def many(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """Distances of pairs: sequence i of a and of b ends before a_ends[i] and b_ends[i], and begins where the one before ends."""
    a_n, b_n = np.diff(a_ends, prepend=0), np.diff(b_ends, prepend=0)
    first = a_n <= b_n  # a is the pattern
    both, offset = np.concatenate([a, b]), len(a)
    m, n = np.where(first, a_n, b_n), np.where(first, b_n, a_n)
    a_start, b_start = a_ends - a_n, b_ends - b_n + offset
    p_start, t_start = np.where(first, a_start, b_start), np.where(first, b_start, a_start)
    out = n.astype(np.int64)  # of patterns without a symbol
    order = np.flatnonzero(m)
    order = order[np.argsort(-n[order], kind="stable")]
    lengths, at = n[order], 0
    while at < len(order):
        longest = int(lengths[at])
        alike = int(np.searchsorted(-lengths, -(longest * 3 // 4), "right")) if longest > 64 else len(order)
        words = -(-longest // 64)
        some = order[at : max(at + 1, min(alike, at + WORDS // words))]
        at += len(some)
        if len(some) < FEW or longest > LONG:
            for i in some:
                pattern, text = both[p_start[i] : p_start[i] + m[i]], both[t_start[i] : t_start[i] + n[i]]
                least, most = bounds(pattern, text) if n[i] > LONG else (0, 1)  # a short pair is done as soon as bounded
                out[i] = most if least == most else single(pattern.tolist(), text.tolist())
            continue
        owner, place = _spread(m[some])
        pattern = both[p_start[some][owner] + place]
        owner, place = _spread(n[some])
        out[some] = _together(pattern, m[some], both[t_start[some][owner] + place], n[some])
    return out


def of_texts(a: list[str], b: list[str]) -> np.ndarray:
    """Distances of texts by character."""
    coded = [np.frombuffer("".join(x).encode("utf-32-le", "surrogatepass"), np.uint32) for x in (a, b)]
    ends = [np.cumsum([len(t) for t in x], dtype=np.int64) for x in (a, b)]
    return many(coded[0], ends[0], coded[1], ends[1])


def of_words(a: list[str], b: list[str]) -> np.ndarray:
    """Distances of texts by word: what stands between spaces, empty ones dropped."""
    number: dict[str, int] = {}
    coded, ends = [], []
    for side in (a, b):
        cut = [[number.setdefault(w, len(number)) for w in t.split(" ") if w] for t in side]
        coded.append(np.array([x for t in cut for x in t], np.uint32))
        ends.append(np.cumsum([len(t) for t in cut], dtype=np.int64))
    return many(coded[0], ends[0], coded[1], ends[1])
