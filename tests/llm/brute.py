"""Plain versions of the operators' contracts, for small inputs."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k + j for k in range(len(w) - 2) if seen[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def components(texts):
    sets = {}
    for i, x in texts.items():
        w = (x or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: (len(sets[i]), find(i)) for i in ids}


def without_repeats(texts, length):
    raw = {i: (x or "").encode() for i, x in texts.items()}
    seen = collections.Counter(b[k : k + length] for b in raw.values() for k in range(len(b) - length + 1))
    out = {}
    for i, b in raw.items():
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()
    return out


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def personal(text):
    found = []
    for rank, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": lambda m=m: True,
                "ip": lambda m=m: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda d=digits: 14 <= len(d) <= 19 and _luhn(d),
                "phone": lambda d=digits: 10 <= len(d) <= 15,
            }[kind]()
            if good:
                found.append((m.start(), rank, kind, m.end()))
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found)]


def template_hits(docs, items, marks, window, shortest, literals):
    """Windows of each (document, item) that share a template and fit; both given as id: (template words, value words)."""
    want = collections.defaultdict(set)
    by_size = collections.defaultdict(lambda: collections.defaultdict(list))
    for item, (t, v) in items.items():
        size = min(len(t), window)
        if len(t) >= shortest:
            for b in range(len(t) - size + 1):
                by_size[size][tuple(t[b : b + size])].append((item, v[b : b + size]))
    for size, windows in by_size.items():
        for doc, (t, v) in docs.items():
            for a in range(len(t) - size + 1):
                part = t[a : a + size]
                for item, theirs in windows.get(tuple(part), ()):
                    slots = {(k, x, y) for k, x, y in zip(part, v[a : a + size], theirs, strict=True) if k in marks}
                    if size - sum(k in marks for k in part) < literals:
                        fits = all(x == y for _, x, y in slots)
                    else:
                        fits = len({s[:2] for s in slots}) == len(slots) == len({s[::2] for s in slots})
                    if fits:
                        want[doc, item].add(a)
    return {pair: len(places) for pair, places in want.items()}


def _share_out(children, budget):
    """Budgets of (name, supply, weight): the least supply for its weight first; a full child leaves the rest to the others."""
    out, left, weight = {}, budget, sum(w for _, _, w in children)
    children = sorted(children, key=lambda c: (c[1] / c[2], (c[0] is not None, c[0] or "")))
    for k, (name, supply, w) in enumerate(children):
        if supply * weight > left * w:
            return out | {n: int(left * x / weight) for n, _, x in children[k:]}
        out[name], left, weight = supply, left - supply, weight - w
    return out


def mixed(rows, share, seed, lang_weights, other_weight):
    """Ids of the rows (doc_id, text, lang, source) that one epoch of the mix keeps; ids are distinct."""
    leaves = collections.defaultdict(list)
    for i, text, lang, source in rows:
        digit = re.search("[0-9]", source or "")
        domain = None if source is None else "domain" + (digit.group() if digit else "")
        leaves[domain, lang, source].append((hashlib.md5(f"{seed}:0:{i}".encode()).hexdigest(), i, len(WORD.findall(text or ""))))
    supply = {leaf: sum(n for *_, n in docs) for leaf, docs in leaves.items()}

    def below(*path):
        names = {leaf[len(path)] for leaf in leaves if leaf[: len(path)] == path}
        weigh = (lambda n: lang_weights.get(n, other_weight)) if len(path) == 1 else lambda n: 1
        return [(n, sum(s for leaf, s in supply.items() if leaf[: len(path) + 1] == (*path, n)), weigh(n)) for n in names]

    kept = set()
    for domain, of_domain in _share_out(below(), int(sum(supply.values()) * share)).items():
        for lang, of_lang in _share_out(below(domain), of_domain).items():
            for source, budget in _share_out(below(domain, lang), of_lang).items():
                total = 0
                for _, i, n in sorted(leaves[domain, lang, source]):
                    total += n
                    if total <= budget:
                        kept.add(i)
    return kept
