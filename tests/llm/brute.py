"""Plain single-process versions of the operators, for small inputs."""

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, size):
    words = WORD.findall(lower_ascii(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1)))


def components(rows, size, percent):
    """rows: (doc_id, text). The set of (doc_id, set size, component id)."""
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    common = defaultdict(int)
    for at in holders.values():
        for a in range(len(at)):
            for b in range(a):
                common[at[b], at[a]] += 1
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            parent[root(a)] = root(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        if d is not None and (least.get(r) is None or d < least[r]):
            least[r] = d
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def repeats(rows, passage):
    """rows: (doc_id, text) with ids in order of place. Kept and removed spans as (doc_id, first, n, removed)."""
    places = defaultdict(list)
    words = {d: WORD.findall(t or "") for d, t in rows}
    for d in sorted(words):
        for i in range(len(words[d]) - passage + 1):
            places[tuple(words[d][i:i + passage])].append((d, i))
    marks = defaultdict(set)
    for at in places.values():
        if len(at) > 1:
            for k, (d, i) in enumerate(at):
                marks[d, k > 0].add(i)
    out = []
    for (d, removed), runs in marks.items():
        runs = sorted(runs)
        begin = last = runs[0]
        for r in runs[1:]:
            if r > last + passage:
                out.append((d, begin, last + passage - begin, removed))
                begin = r
            last = r
        out.append((d, begin, last + passage - begin, removed))
    return sorted(out)
