"""Plain, slow versions of the operators."""

import hashlib
import math
import re
import string
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    lowered = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def groups(docs, size=4, percent=85):
    """{id: (set size, smallest id in its group)}"""
    sets = {}
    for name, text in docs:
        w = words(text)
        runs = [tuple(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [tuple(w)] if w else []
        sets[name] = frozenset(runs)
    parent = {name: name for name in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for name, own in sets.items():
        for x in own:
            holders[x].append(name)
    for name, own in sets.items():
        for other, n in Counter(o for x in own for o in holders[x] if o > name).items():
            if 100 * n >= percent * (len(own) + len(sets[other]) - n):
                a, b = root(name), root(other)
                parent[max(a, b)] = min(a, b)
    return {name: (len(own), root(name)) for name, own in sets.items()}


def bigram_scores(train, texts):
    """Interpolated modified Kneser-Ney over word pairs: (tokens, known, N, base, score) of each text."""
    split = lambda text: [*(text or "").encode().lower().split(), None]
    count, pairs = Counter(), Counter()
    for text in train:
        w = split(text)
        count.update(w)
        pairs.update(zip(["<s>", *w[:-1]], w))
    follows = Counter(w for _, w in pairs)
    context = defaultdict(lambda: [0, 0, 0, 0])
    for (u, _), n in pairs.items():
        context[u][0] += n
        context[u][min(n, 3)] += 1

    def discounts(values):
        n = [sum(1 for v in values if v == i) for i in (1, 2, 3, 4)]
        if min(n) == 0:
            return [0, 0.5, 1.0, 1.5]
        y = n[0] / (n[0] + 2 * n[1])
        return [0, *(min(max(i - (i + 1) * y * n[i] / n[i - 1], 0), i) for i in (1, 2, 3))]

    low, high = discounts(list(follows.values())), discounts(list(pairs.values()))
    kinds = Counter(min(v, 3) for v in follows.values())
    total, vocabulary, n_pairs = sum(count.values()), len(count), len(pairs)

    def single(w):
        if not n_pairs:
            return 1 / (vocabulary + 1)
        left = sum(low[i] * kinds[i] for i in (1, 2, 3))
        return (max(follows[w] - low[min(follows[w], 3)], 0) + left / (vocabulary + 1)) / n_pairs

    def pair(u, w):
        if u not in context:
            return single(w)
        all_, a, b, c = context[u]
        n = pairs[u, w]
        return (max(n - high[min(n, 3)], 0) + (high[1] * a + high[2] * b + high[3] * c) * single(w)) / all_

    out = []
    for text in texts:
        w = split(text)
        base = sum(math.log10((count[x] + 0.1) / (total + 0.1 * (vocabulary + 1))) for x in w)
        score = sum(math.log10(pair(u, x)) for u, x in zip(["<s>", *w[:-1]], w))
        out.append((len(w), sum(count[x] > 0 for x in w), total, base, score))
    return out


def run_scores(train, texts, order):
    """Interpolated modified Kneser-Ney over runs of ``order`` words: the score of each text."""
    split = lambda text: [*["<s>"] * (order - 1), *(text or "").encode().lower().split(), None]
    runs = lambda w: [tuple(w[i : i + order]) for i in range(len(w) - order + 1)]
    level = {order: Counter(run for text in train for run in runs(split(text)))}
    vocabulary = len({run[-1] for run in level[order]})
    for k in range(order - 1, 0, -1):
        level[k] = Counter(run[1:] for run in level[k + 1])
    off, totals = {}, {}
    for k, counts in level.items():
        n = [sum(1 for v in counts.values() if v == i) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if min(n) else None
        off[k] = [0, *(min(max(i - (i + 1) * y * n[i] / n[i - 1], 0), i) for i in (1, 2, 3))] if y else [0, 0.5, 1.0, 1.5]
        totals[k] = defaultdict(lambda: [0, 0])
        for run, c in counts.items():
            totals[k][run[:-1]][0] += c
            totals[k][run[:-1]][1] += off[k][min(c, 3)]

    def chance(run):
        k = len(run)
        below = chance(run[1:]) if k > 1 else 1 / (vocabulary + 1)
        if run[:-1] not in totals[k]:
            return below
        total, left = totals[k][run[:-1]]
        c = level[k][run]
        return (max(c - off[k][min(c, 3)], 0) + left * below) / total

    return [sum(math.log10(chance(run)) for run in runs(split(text))) for text in texts]


def leaks(docs, items, size=5, least=0.8):
    """{(id, item): best similarity of any window as long as the item that is aligned with a shared shingle}"""
    runs = lambda text: [tuple(w[i : i + size]) for w in [words(text)] for i in range(len(w) - size + 1)]
    out = {}
    profile = {item: Counter(runs(text)) for item, text in items}
    for name, text in docs:
        own = runs(text)
        seen = set(own)
        for item, c in profile.items():
            n = sum(c.values())
            if not seen & c.keys():
                continue
            places = runs(dict(items)[item])
            for at in {i - j for i, x in enumerate(own) if x in c for j, y in enumerate(places) if x == y}:
                window = Counter(own[max(at, 0) : at + n])
                shared = sum(min(v, window[x]) for x, v in c.items())
                value = shared / (n + sum(window.values()) - shared)
                if value >= least:
                    out[name, item] = max(value, out.get((name, item), 0))
    return out


def licenses(docs, templates, least=0.8):
    """{(id, template): best containment}"""
    out = {}
    for name, text in docs:
        own = words(text)
        for number, (_, template) in enumerate(templates):
            w = words(template)
            size = min(5, len(w))
            wanted = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
            runs = [tuple(own[i : i + size]) for i in range(len(own) - size + 1)]
            if not wanted & set(runs):
                continue
            best = max(len(wanted & set(runs[at : at + len(w) - size + 1])) / len(wanted) for at in range(len(runs)))
            if best >= least:
                out[name, number] = best
    return out


def line_dedup(docs, min_docs=10):
    """[(id, lines, dropped, text)]"""
    key = lambda line: re.sub(r"[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    found = Counter(k for _, text in docs for k in {key(line) for line in (text or "").split("\n")})
    out = []
    for name, text in docs:
        lines = (text or "").split("\n")
        kept = [line for line in lines if not key(line) or found[key(line)] < min_docs]
        out.append((name, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def vector_codes(rows, entries, parts=4, rounds=4):
    """Rows (vec_id, code, error, label_error, digest) of rows (vec_id, finite vector, label)."""
    whole = [(i, [math.floor(1024 * Fraction(x)) for x in v], label) for i, v, label in rows]
    by_id = sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, rows[r][0] or 0, rows[r][1]))
    size = next(len(rows[r][1]) for r in by_id if len(rows[r][1]) % parts == 0)
    usable = [r for r in by_id if len(rows[r][1]) == size]
    width = size // parts
    cut = {r: [whole[r][1][p * width : (p + 1) * width] for p in range(parts)] for r in usable}
    books = [[cut[r][p] for r in usable[:entries]] for p in range(parts)]

    def best(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), e) for e, entry in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            near = [(best(cut[r][p], books[p])[1], cut[r][p]) for r in usable]
            for e in range(len(books[p])):
                own = [part for at, part in near if at == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    coded = []
    for r, (vec_id, _, label) in enumerate(whole):
        found = [best(cut[r][p], books[p]) for p in range(parts)] if r in cut else None
        error = sum(d for d, _ in found) if found else None
        coded.append((vec_id, label, "".join(f"{e:02x}" for _, e in found) if found else None, error if found and error < 2**63 else None))
    sums = {label: [e for _, other, _, e in coded if other == label and e is not None] for _, label, _, _ in coded}
    return [(i, code, error, sum(sums[label]) if sums[label] else None, digest) for i, label, code, error in coded]


def letter_runs(text):
    return [run.translate(LOWER) for run in re.findall("[A-Za-zÀ-ÿ]+", text or "")]


def misspelt(doc_id, run, one_in=97):
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    return run if h % one_in else run[: h % len(run)] + run[h % len(run) + 1 :]


def spelling(counts):
    """word: (word, form, root, n, n_near, form_n), by the holes each word leaves."""
    holes = defaultdict(set)
    for word in counts:
        holes[word].add(word)
        for i in range(len(word)):
            holes[word[:i] + word[i + 1 :]].add(word)
    near = {word: set() for word in counts}
    for group in holes.values():
        for a in group:
            near[a] |= group
    one_edit = lambda a, b: a != b and (len(a) != len(b) or sum(x != y for x, y in zip(a, b)) == 1)
    form = {}
    for word, others in near.items():
        near[word] = {b for b in others if one_edit(word, b)}
        best = min(near[word], key=lambda b: (-counts[b], b), default=None)
        form[word] = best if best is not None and counts[best] >= 2 * counts[word] else None
    out = {}
    for word, n in counts.items():
        root = word
        while form[root]:
            root = form[root]
        out[word] = (word, form[word], root, n, len(near[word]), counts[form[word]] if form[word] else None)
    return out
