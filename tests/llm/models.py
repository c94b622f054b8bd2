"""Plain row-by-row versions of the operators' contracts, for small tables."""

import hashlib
import re
import string

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(docs, items):
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each row."""
    windows = []
    for item, text in items:
        w = ITEM_WORD.findall((text or "").translate(LOWER))
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.append((str(item) if item is not None else "null", w[i : i + 13]))
    out = []
    for doc_id, text in docs:
        w = ITEM_WORD.findall((text or "").translate(LOWER))
        hit, names = set(), set()
        for name, terms in windows:
            for i in range(len(w) - len(terms) + 1):
                if w[i : i + len(terms)] == terms:
                    hit |= set(range(i, i + len(terms)))
                    names.add(name)
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def linked(rows, size, numerator, denominator):
    """(doc_id, set size, component, links) of each row, by comparing all pairs."""
    sets, parent, links = [shingles(t, size) for _, t in rows], list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and denominator * both >= numerator * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(doc_id)
    least = {r: min((d for d in found if d is not None), default=None) for r, found in ids.items()}
    return [(d, len(sets[i]), least[root(i)], links[i]) for i, (d, _) in enumerate(rows)]


def within_one_word(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    least, i, j = min(len(a), len(b)), 0, 0
    while i < least and a[i] == b[i]:
        i += 1
    while j < least and a[-1 - j] == b[-1 - j]:
        j += 1
    return i + j >= max(len(a), len(b)) - 1


def deduplicated(rows, exact, near):
    """doc_id -> (text, lines, dropped lines); doc_id must be unique or null once."""
    first, places = {}, []
    for doc_id, text in rows:
        for k, line in enumerate(text.split("\n") if text is not None else ()):
            w = tuple(WORD.findall(line.lower()))
            if len(w) >= exact:
                place = (doc_id is None, doc_id or 0, k)
                places.append((doc_id, k, w, place))
                first[w] = min(first.get(w, place), place)
    long = [w for w in first if len(w) >= near]
    gone = {w for w in long if any(first[v] < first[w] and within_one_word(v, w) for v in long)}
    dropped = {}
    for doc_id, k, w, place in places:
        if w in gone or place > first[w]:
            dropped.setdefault(doc_id, set()).add(k)
    out = {}
    for doc_id, text in rows:
        lines, drop = (text or "").split("\n"), dropped.get(doc_id, set())
        left = None if text is None else "\n".join(x for k, x in enumerate(lines) if k not in drop)
        out[doc_id] = (left, 0 if text is None else len(lines), len(drop))
    return out


def quality_base(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = WORD.findall(text)
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {i + k for starts in seen.values() if len(starts) > 1 for i in starts for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)
