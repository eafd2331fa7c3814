"""Indonesian stems by confix stripping: affixes go until a root of a given table is left.

A word that is a root, or has under four letters, stays.  Suffixes are tried from none to all three kinds
(particle, possessive, derivational), then up to three prefixes, whose sound changes are undone; the
first root found is the stem.  Prefixes and derivational suffixes that don't go together are not tried.
A word that no way leads to a root stays as it is.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator

# Affixes, and prefixes that don't go with a derivational suffix.
PARTICLES = ("lah", "kah", "tah", "pun")
POSSESSIVES = ("ku", "mu", "nya")
DERIVATIONAL = ("kan", "an", "i")
APART = {("be", "i"), ("di", "an"), ("ke", "i"), ("ke", "kan"), ("me", "an"), ("se", "i"), ("se", "kan"), ("te", "an")}
VOWELS = "aiueo"


def without_suffixes(word: str) -> Iterator[tuple[str, str]]:
    """(what is left, derivational suffix or nothing), fewest cuts first."""
    def cut(w: str, suffixes: tuple[str, ...]) -> list[str]:
        return [w[: -len(s)] for s in suffixes if w.endswith(s) and len(w) - len(s) >= 2]

    particle = [word, *cut(word, PARTICLES)]
    inflected = particle + [x for w in particle for x in cut(w, POSSESSIVES)]
    for w in inflected:
        yield w, ""
    for w in inflected:
        for s in DERIVATIONAL:
            for left in cut(w, (s,)):
                yield left, s


def _nasal(rest: str, kind: str) -> Iterator[str]:
    """What may have stood after me- or pe-: the nasal of the prefix swallows some first letters."""
    if rest.startswith("ny") and rest[2:3] in VOWELS:
        yield from ("s" + rest[2:], rest)
    if rest.startswith("ng"):
        if rest[2:3] in VOWELS:
            yield from (rest[2:], "k" + rest[2:])
        elif rest[2:3] in "ghkq":
            yield rest[2:]
        elif rest[2:3] == "e" or len(rest) == 5:
            yield rest[3:]
    if rest.startswith("m"):
        if rest[1:2] in VOWELS:
            yield from ("p" + rest[1:], rest)
        elif rest[1:2] in "bfvp":
            yield rest[1:]
    if rest.startswith("n") and not rest.startswith(("ny", "ng")):
        if rest[1:2] in VOWELS:
            yield from ("t" + rest[1:], rest)
        elif rest[1:2] in "cdjszt":
            yield rest[1:]
    if rest[:1] in "lrwy":
        yield rest
    if kind == "pe" and rest[:1] not in VOWELS + "lrwymn":
        yield rest


def without_prefix(word: str) -> Iterator[tuple[str, str]]:
    """(kind of the prefix, what is left) for each way to read the word's first prefix."""
    for kind in ("di", "ke", "se"):
        if word.startswith(kind):
            yield kind, word[2:]
    for kind in ("be", "te", "pe"):
        if word.startswith(kind + "r"):
            yield from ((kind, word[3:]), (kind, word[2:]))
        elif kind != "pe" and word.startswith(kind) and "er" in word[2:5]:
            yield kind, word[2:]
    for whole, left in (("belajar", "ajar"), ("pelajar", "ajar")):
        if word.startswith(whole):
            yield word[:2], left + word[len(whole) :]
    for kind in ("me", "pe"):
        if word.startswith(kind):
            for left in _nasal(word[2:], kind):
                yield kind, left


class Stemmer:
    """A function from words in lower case to stems, which can be sent to tasks; it keeps up to ``cache`` results."""

    def __init__(self, roots: Collection[str], cache: int = 100_000):
        self.roots, self.cache, self.known = frozenset(roots), cache, {}

    def __getstate__(self) -> dict:
        return {"roots": self.roots, "cache": self.cache, "known": {}}

    def __call__(self, word: str) -> str:
        if word not in self.known:
            if len(self.known) >= self.cache:
                self.known.clear()
            self.known[word] = self.stem(word)
        return self.known[word]

    def stem(self, word: str) -> str:
        if len(word) < 4 or word in self.roots:
            return word
        for left, suffix in without_suffixes(word):
            if found := self._stripped(left, suffix, ()):
                return found
        return word

    def _stripped(self, word: str, suffix: str, used: tuple[str, ...]) -> str | None:
        if word in self.roots:
            return word
        if len(used) == 3:
            return None
        for kind, left in without_prefix(word):
            if kind in used or len(left) < 2 or (not used and (kind, suffix) in APART):
                continue
            if found := self._stripped(left, suffix, (*used, kind)):
                return found
        return None
