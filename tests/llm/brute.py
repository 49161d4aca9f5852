"""Plain versions of the operators' contracts, for small tables."""

import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def parts(pairs, ids):
    """Least id that can be reached from each id."""
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text):
    words = WORD.findall((text or "").translate(UPPER))
    if not words:
        return set()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def near_duplicates(docs, percent=85):
    """{doc_id: (n_shingles, component_id)} of (doc_id, text) pairs."""
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(i for i in sets if sets[i])
    pairs = []
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if 100 * small < percent * large:
                continue
            shared = len(sets[a] & sets[b])
            if 100 * shared >= percent * (small + large - shared):
                pairs.append((a, b))
    top = parts(pairs, sets)
    return {i: (len(sets[i]), top[i]) for i in sets}
