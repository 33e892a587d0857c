"""Plain models of what the operators decide, for small tables."""

import collections
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def passes_rules(text):
    """Whether the strict policy keeps a text."""
    ws = WORD.findall(text)
    grams = collections.defaultdict(list)
    for i in range(len(ws) - 4):
        grams[tuple(ws[i : i + 5])].append(i)
    repeated = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    chars, upper = sum(map(len, ws)), sum("A" <= c <= "Z" for c in text)
    symbols, later = sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines))
    return not (
        len(ws) < 10 or 100 * len(repeated) > 20 * len(ws) or 10 * symbols > len(ws) or 100 * later > 35 * len(lines)
        or chars > 14 * len(ws) or chars < 2 * len(ws) or 2 * upper > chars
    )


def without_shared_lines(texts, long=40, documents=5):
    """{id: text} without the lines that many documents hold, but in the largest id."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    holders = collections.defaultdict(set)
    for i, t in texts.items():
        for line in t.split("\n"):
            if len(key(line)) >= long:
                holders[key(line)].add(i)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= documents}
    return {i: "\n".join(x for x in t.split("\n") if gone.get(key(x), i) == i) for i, t in texts.items()}


def groups(texts, size):
    """{id: smallest id of its group} by sets of shingles."""
    sets = {}
    for i, t in texts.items():
        ws = WORD.findall(t.translate(UPPER))
        sets[i] = {tuple(ws[k : k + size]) for k in range(max(1, len(ws) - size + 1))} if ws else set()
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def mix_repeats(rows, targets):
    """{id: repeats} of (id, source, size, key): whole epochs, then by ascending key to where the sum comes nearest the rest."""
    out = {}
    by = collections.defaultdict(list)
    for i, s, size, key in rows:
        by[s].append((key, i, size))
    for s, some in by.items():
        total = sum(x[2] for x in some)
        epochs = int(targets[s] // total) if total else 0
        rest, through = targets[s] - epochs * total, 0
        for key, i, size in sorted(some):
            through += size
            out[i] = epochs + (rest > 0 and through - size / 2 < rest)
    return out
