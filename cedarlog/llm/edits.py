"""Edit distances of many pairs of texts at a time.

The bit vectors of Myers and Hyyroe hold a band of the table around the diagonal that
ends in its last corner; a column of all pairs is one step of numpy. A distance of up
to ``most`` never leaves the band, so it is exact; others only show that they are over it.
"""

from __future__ import annotations

import numpy as np

#: Pairs that go through the columns together.
PAIRS = 2048
#: How much longer than the shortest of them their texts may be.
SPREAD = 2
#: Fewer pairs of about one length, or longer texts, are not worth it.
FEW, LONG = 40, 4096
#: Difference in length up to which a narrow band is tried.
NARROW = 23
#: Columns after which pairs that are over their limit leave.
STEP = 16
_ONE, _SIX, _LAST = np.uint64(1), np.uint64(6), np.uint64(63)


class Letters:
    """The characters of texts as small numbers; of more kinds than LETTERS, rare ones share numbers."""

    LETTERS, SHARED = 96, 32

    def __init__(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """``points``: code points; the texts are its parts from ``starts`` to ``ends``."""
        counts = np.bincount(points)
        kinds = np.flatnonzero(counts)
        kinds = kinds[np.argsort(-counts[kinds], kind="stable")]
        number = np.arange(len(kinds))
        own = self.LETTERS - self.SHARED
        self.shared = len(kinds) > self.LETTERS
        if self.shared:
            number[own:] = own + number[own:] % self.SHARED
        table = np.zeros(len(counts), np.uint8)
        table[kinds] = number
        self.codes, self.starts, self.size = table[points], starts, ends - starts
        self.n = min(len(kinds), self.LETTERS)
        before = np.concatenate([[0], np.cumsum(self.codes >= own)]) if self.shared else None
        #: Whether a text has characters that share a number with others: two such texts may be farther apart than they seem.
        self.vague = before[ends] > before[starts] if self.shared else np.zeros(len(starts), bool)


def _places(letters: Letters, texts: np.ndarray, blank: int, behind: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bits of the places of each letter in each text: words by (text, word, letter), and each text's first word.

    ``blank`` words come before each text, ``behind`` after the last.
    """
    size = letters.size[texts]
    words = (size >> 6) + 1 + blank
    first = np.cumsum(words) - words
    bits = np.zeros((int(words.sum()) + behind) * letters.n, np.uint64)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    codes = letters.codes[inside + np.repeat(letters.starts[texts], size)]
    at = (np.repeat(first + blank, size) + (inside >> 6)) * letters.n + codes
    np.add.at(bits, at, _ONE << (inside & 63).astype(np.uint64))  # no bit comes twice
    return bits, first, letters.n


def _within(letters: Letters, a: np.ndarray, b: np.ndarray, most: np.ndarray, beside: np.ndarray) -> np.ndarray:
    """Whether the distances of pairs are ``most`` at most; a is never shorter than b, nor by more than ``most``.

    The band has ``beside`` diagonals on both sides of the first and the last diagonal.
    A narrower one than ``most`` asks for shows of some pairs that they are within, of none that it is not.

    Row r of column j is bit r - j - low of a pair's window, low the same distance above
    the pair's last diagonal in all pairs. Rows before the text have no equal letters;
    those behind it may have any, as no row depends on those below it.
    """
    out = np.zeros(len(a), bool)
    off = letters.size[a] - letters.size[b]
    below = int(beside.max())
    wide = int((off + beside).max()) + below + 1
    W = (wide + 63) // 64
    texts, node = np.unique(a, return_inverse=True)
    bits, first, n_letters = _places(letters, texts, W, W + 2 + ((int(letters.size[b].max() + off.max()) + below) >> 6))
    order = np.argsort(-letters.size[b], kind="stable")  # those that end first are last
    columns = letters.size[b][order]
    off, limit = letters.size[a][order] - columns, most[order]
    low = off + below  # the window of column j begins at bit j + low of a text's places
    P = len(order)
    # before column 1: rows 1 and up are one more than the row above
    VP = np.zeros((W, P), np.uint64)
    for w in range(W):
        zero = np.clip(64 * (W - w) - 1 - low, 0, 64)  # bits of rows 0 and less in this word
        VP[w] = np.where(zero == 64, np.uint64(0), np.uint64(2**64 - 1) << np.minimum(zero, 63).astype(np.uint64))
    VN = np.zeros((W, P), np.uint64)
    last, bit = (64 * W - 1 - below) >> 6, _ONE << np.uint64((64 * W - 1 - below) & 63)
    word = first[node[order]] * n_letters + np.arange(W + 1)[:, None] * n_letters
    codes = np.append(letters.codes, np.zeros(int(columns[0]), np.uint8))
    state = [order, columns, limit, off, letters.starts[b][order], low.astype(np.uint64)]
    rising = -columns
    for j in range(int(columns[0])):
        order, columns, limit, score, at, low = state
        if j % STEP == 0 and j:
            out[order[(columns <= j) & (score <= limit)]] = True
            alive = (columns > j) & (score <= limit)
            n = int(alive.sum())
            if n < 0.9 * len(order):
                if not n:
                    return out
                state = [z[alive] for z in state]
                VP, VN, word = VP[:, alive], VN[:, alive], word[:, alive]
                order, columns, limit, score, at, low = state
                rising = -columns
        low += _ONE
        place = (low >> _SIX).view(np.int64)
        place *= n_letters
        place += codes.take(at)
        at += 1
        eq = bits.take(word + place)
        shift = low & _LAST
        X = eq[1:] << _ONE
        X <<= _LAST - shift
        X |= eq[:-1] >> shift
        D0 = X & VP
        if W == 1:
            D0 += VP
        else:
            total = D0 + VP
            over = total < D0
            carry, D0 = over[0], total
            for w in range(1, W):
                D0[w] += carry
                if w + 1 < W:
                    carry = over[w] | (carry & (D0[w] == 0))
        D0 ^= VP
        D0 |= X
        D0 |= VN
        HP = D0 | VP
        np.invert(HP, out=HP)
        HP |= VN
        VP &= D0  # the horizontal minus
        going = int(rising.searchsorted(-j))
        score[:going] += (D0[last, :going] & bit) == 0
        down = D0 >> _ONE
        if W > 1:
            down[:-1] |= D0[1:] << _LAST
        VN = down & HP
        down |= HP
        np.invert(down, out=down)
        VP |= down
    out[state[0][state[3] <= state[2]]] = True
    return out


def _banded(letters: Letters, a: np.ndarray, b: np.ndarray, most: np.ndarray, likely: bool) -> np.ndarray:
    """As ``_within`` with all of the band; if most pairs are ``likely`` within, a narrow one is tried first."""
    off = letters.size[a] - letters.size[b]
    beside = (most - off) // 2
    out = np.zeros(len(a), bool)
    if likely:
        few = np.flatnonzero((off <= NARROW) & (off + 2 * beside >= 64))
        if len(few) >= FEW:
            room = np.minimum((63 - int(off[few].max())) // 2, beside[few])
            out[few] = _within(letters, a[few], b[few], most[few], room)
    rest = np.flatnonzero(~out)
    if len(rest):
        out[rest] = _within(letters, a[rest], b[rest], most[rest], beside[rest])
    return out


def within(letters: Letters, x: np.ndarray, y: np.ndarray, most: np.ndarray, one, likely: bool = False) -> np.ndarray:
    """Whether the edit distances of the pairs (x, y) of texts are ``most`` at most; ``one(x, y)`` tells it of one pair."""
    swap = letters.size[x] < letters.size[y]
    a, b = np.where(swap, y, x), np.where(swap, x, y)
    out = np.zeros(len(a), bool)
    todo = np.flatnonzero(letters.size[a] - letters.size[b] <= most)
    todo = todo[np.argsort(letters.size[a[todo]], kind="stable")]
    size = letters.size[a[todo]]
    at = 0
    while at < len(todo):
        end = min(at + PAIRS, int(np.searchsorted(size, size[at] * SPREAD + 32, "right")))
        part = todo[at:end]
        if len(part) < FEW or size[end - 1] > LONG:
            out[part] = [one(int(p), int(q)) for p, q in zip(x[part], y[part], strict=True)]
        else:
            out[part] = _banded(letters, a[part], b[part], most[part], likely)
            for k in part[out[part] & letters.vague[a[part]] & letters.vague[b[part]]].tolist():
                out[k] = one(int(x[k]), int(y[k]))
        at = end
    return out
