"""Brute-force versions, written without Spark."""

import re
from collections import Counter, defaultdict

SPACE = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[k:k + width]) for k in range(len(w) - width + 1)}


def near_components(docs, width, percent=80):
    """(number of shingles, smallest id of the component) per row; docs have distinct ids."""
    sets = [shingles(t, width) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    for k, s in enumerate(sets):
        common = Counter(j for x in s for j in holders[x] if j > k)
        for j, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                parent[find(k)] = find(j)
    low = {}
    for k, (i, _) in enumerate(docs):
        low[find(k)] = min(low.get(find(k), i), i)
    return {docs[k][0]: (len(sets[k]), low[find(k)]) for k in range(len(docs))}


def line_dedup(docs, min_chars=20, min_docs=3):
    """Per id: kept text and number of dropped lines; docs have distinct ids."""
    key = lambda line: lower(line.strip(SPACE))
    seen = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                seen[key(line)].add(i)
    often = {k: max(v) for k, v in seen.items() if len(v) >= min_docs}
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if often.get(key(x), i) == i]
        out[i] = ("\n".join(kept), len(lines) - len(kept))
    return out


def edit_window(pattern, text):
    """Least edit distance of the pattern to any part of a text."""
    column, best = list(range(len(pattern) + 1)), len(pattern)
    for c in text:
        new = [0]
        for i, x in enumerate(pattern):
            new.append(min(column[i] + (x != c), column[i + 1] + 1, new[i] + 1))
        column, best = new, min(best, new[-1])
    return best


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    """(kind number, start, end) of the four base patterns."""
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    out = []
    for kind, pattern in enumerate(patterns):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = (True, all(int(p) <= 255 for p in m.group().split(".")) if kind == 1 else True,
                  16 <= len(digits) <= 19 and luhn(digits), 8 <= len(digits) <= 15)[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out
