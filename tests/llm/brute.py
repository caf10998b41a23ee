"""Plain counterparts of the operators, written from their contracts, and a table of awkward documents."""

from __future__ import annotations

import re
from collections import Counter

import xxhash

AWKWARD = [
    # doc_id, text, lang, source, then columns whose names the operators use themselves
    (1, "One two three four five six seven eight nine ten. Eleven twelve.\nThirteen", "en", "b", 9, "x"),
    (2, "One two three four five six seven eight nine ten. Eleven twelve.\nThirteen", "en", "a", None, "y"),
    (3, "", "en", "a", 1, None),
    (4, None, None, None, 2, "z"),
    (5, " \t\r\n\x0b\x0c ", "fr", "b", 3, "z"),
    (6, "word", "fr", None, 4, "z"),
    (6, "word", "fr", None, 4, "z"),
    (None, "no id here, two words", "de", "c", 5, "z"),
    (None, None, "de", "c", 5, "z"),
    (8, "a b " * 20_000, "de", "c", 6, "z"),
    (9, "x" * 300_000, "de", "c", 7, "z"),
    (10, "ÉCOLE école ΣΑΣ <|endoftext|> 𝒳 é İ\n\n\nline\nline\nline  \n", "el", "é", 8, "z"),
    (11, "idiot! you idiot; said not stupid " * 9, "en", "b", 8, "z"),
    (-5, "One two three four five six seven eight nine ten. Eleven twelve.\nThirteenth", "en", "a", 0, "w"),
]
COLUMNS = "doc_id long, text string, lang string, source string, size long, row string"


def words(text: str | None) -> list[str]:
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def simhash(text: str | None) -> int:
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def component_ids(fps: list[tuple[int | None, int]], radius: int = 2) -> list[int | None]:
    """Least id of each row's component, by merging all pairs of distinct fingerprints."""
    label = {f: f for _, f in fps}

    def top(f: int) -> int:
        while label[f] != f:
            f = label[f]
        return f

    distinct = sorted(label)
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                label[top(a)] = top(b)
    least: dict[int, int | None] = {}
    for doc_id, f in fps:
        known = least.setdefault(top(f), doc_id)
        if doc_id is not None and (known is None or doc_id < known):
            least[top(f)] = doc_id
    return [least[top(f)] for _, f in fps]


def measures(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def shingle_set(text: str | None, each: int = 5) -> frozenset[tuple[str, ...]]:
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + each]) for i in range(max(1, len(w) - each + 1))) if w else frozenset()


def overlap_pairs(texts: list[str | None], similarity: float = 0.8) -> list[tuple[int, int, float]]:
    """All pairs of distinct shingle sets at the similarity or more, as places in texts with their Jaccard similarity."""
    sets = [shingle_set(t) for t in texts]
    at: dict[tuple[str, ...], list[int]] = {}
    for i, found in enumerate(sets):
        for s in found:
            at.setdefault(s, []).append(i)
    shared = Counter((a, b) for places in at.values() for k, a in enumerate(places) for b in places[k + 1 :])
    pairs = ((a, b, n / (len(sets[a]) + len(sets[b]) - n)) for (a, b), n in shared.items())
    return [p for p in pairs if p[2] >= similarity]


def kept_places(ids: list[int | None], texts: list[str | None], similarity: float = 0.8) -> list[int]:
    """Place of the row that stays of each component of near copies: the least id, null last, then the first."""
    top = list(range(len(texts)))

    def root(i: int) -> int:
        while top[i] != i:
            i = top[i]
        return i

    empty = [i for i, t in enumerate(texts) if not words(t)]
    for a, b in [*((a, b) for a, b, _ in overlap_pairs(texts, similarity)), *zip(empty, empty[1:])]:
        top[root(a)] = root(b)
    groups: dict[int, list[int]] = {}
    for i in range(len(texts)):
        groups.setdefault(root(i), []).append(i)
    return sorted(min(g, key=lambda i: (ids[i] is None, ids[i] or 0, i)) for g in groups.values())
