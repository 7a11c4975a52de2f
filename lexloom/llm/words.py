"""Words and word sequences as numbers, for operators that compare texts."""

import re

import numpy as np
import xxhash

try:
    import ahocorasick
except ImportError:
    ahocorasick = None

#: A word: a longest run of letters and digits (Unicode classes L and N).
WORD = re.compile(r"[^\W_]+")
CACHE = 300_000
_MARKS, _DIGITS, _ID = re.compile(r"[^\w]+"), re.compile(r"\d+"), re.compile(r"^(?=.*0)[0-9a-f]{6,}$|^[0a-f]*0[0a-f]*$")
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class Hashes(dict):
    """word -> 64-bit hash; forgets all when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


hashes = Hashes()


class Tokens(Hashes):
    """token between spaces -> hash of its letters, digits as 0: so numbers, ids and marks around words make no difference."""

    def __missing__(self, token: str) -> int:
        bare = _DIGITS.sub("0", _MARKS.sub("", token))
        if len(self) >= CACHE:
            self.clear()
        h = self[token] = xxhash.xxh3_64_intdigest(_ID.sub("0", bare) if "0" in bare else bare)
        return h


tokens = Tokens()


def token_hashes(text: str) -> np.ndarray:
    """64-bit hashes of what stands between a text's spaces, in order, in lower case; tokens of marks alone are one kind."""
    parts = text.lower().split()
    return np.fromiter(map(tokens.__getitem__, parts), np.uint64, len(parts))


class Cues:
    """Literals of which texts are searched for all at once: by an automaton where the library for it is installed, else one by one."""

    def __init__(self, literals: tuple[str, ...]):
        self.literals = literals
        self.automaton = None
        if ahocorasick:
            self.automaton = ahocorasick.Automaton()
            for x in literals:
                self.automaton.add_word(x, x)
            self.automaton.make_automaton()

    def within(self, text: str) -> bool:
        """Whether any of them stands in ``text``."""
        if self.automaton is None or len(text) < 200:
            return any(x in text for x in self.literals)
        return next(self.automaton.iter(text), None) is not None


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of a text's words, in order."""
    words = WORD.findall(text.lower())
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of x reaches every bit of the result."""
    x = (x ^ (x >> np.uint64(29))) * _B
    x = (x ^ (x >> np.uint64(32))) * _A
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all sequences of ``size`` words, in order, with repetitions."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, _C, np.uint64)
    for k in range(size):
        out = mixed(out * _A + hashes[k : k + n] + np.uint64(k))
    return out
