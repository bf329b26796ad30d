"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re


def repeats(docs, width=100):
    """[(doc_id, text)] -> {doc_id: (n_bytes, n_removed, n_spans, sha256 of the rest)}."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs):
        data = (text or "").encode()
        cover = bytearray(len(data))
        for i in range(len(data) - width + 1):
            piece = data[i:i + width]
            if piece in seen:
                cover[i:i + width] = b"\x01" * width
            seen.add(piece)
        kept = bytes(b for b, c in zip(data, cover) if not c)
        spans = sum(1 for i, c in enumerate(cover) if c and not (i and cover[i - 1]))
        out[doc_id] = (len(data), sum(cover), spans, hashlib.sha256(kept).hexdigest())
    return out


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def shingles(text, width=5):
    found = words(text)
    if len(found) < width:
        return {tuple(found)} if found else set()
    return {tuple(found[i:i + width]) for i in range(len(found) - width + 1)}


def roots(nodes, links):
    """{node: least node it is joined to}."""
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def jaccard(docs):
    """[(doc_id, text)] -> {doc_id: (set size, component)}."""
    sets = {i: shingles(t) for i, t in docs}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    common = {}
    for held in holders.values():
        for a in range(len(held)):
            for b in range(a):
                pair = (held[b], held[a])
                common[pair] = common.get(pair, 0) + 1
    links = [(a, b) for (a, b), k in common.items() if 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k)]
    found = roots(list(sets), links)
    return {i: (len(s), found[i]) for i, s in sets.items()}


def private(text):
    """(kind, start, end) of the base spans by the patterns as given."""
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        n = [int(c) for c in s[::-1]]
        return (sum(n[0::2]) + sum(sum(divmod(2 * d, 10)) for d in n[1::2])) % 10 == 0

    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15)]
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, text or "") if ok(m[0])]


def vectors(rows, least=0.93):
    """[(vec_id, vector, label)] -> {vec_id: (n_links, component, kept)}."""
    import numpy as np

    links, good = [], []
    for i, v, label in rows:
        if label is not None and v and None not in v and np.isfinite(v).all() and any(v):
            good.append((i, np.array(v, float) / np.linalg.norm(np.array(v, float)), label))
    for k, (i, x, a) in enumerate(good):
        links += [(i, j) for j, y, b in good[:k] if a == b and len(x) == len(y) and x @ y >= least]
    found = roots([i for i, _, _ in rows], links)
    count = {i: 0 for i, _, _ in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return {i: (count[i], found[i], found[i] == i) for i, _, _ in rows}


class Ppm:
    """A byte trie as nested counts, scored symbol by symbol."""

    def __init__(self, texts, order):
        self.order, self.counts, self.words = order, {}, {}
        for text in texts:
            symbols = self.symbols(text)
            for i in range(order, len(symbols)):
                for k in range(order + 1):
                    held = self.counts.setdefault(tuple(symbols[i - k:i]), {})
                    held[symbols[i]] = held.get(symbols[i], 0) + 1
            for word in [*words(text), None]:
                self.words[word] = self.words.get(word, 0) + 1

    def symbols(self, text):
        return [0xFE] * self.order + list(lower(text).encode()) + [0xFF]

    def score(self, text):
        import math

        total, symbols = 0.0, self.symbols(text)
        for i in range(self.order, len(symbols)):
            gone = set()
            for k in range(self.order, -1, -1):
                held = self.counts.get(tuple(symbols[i - k:i]))
                if held is None:
                    continue
                left = {s: c for s, c in held.items() if s not in gone}
                mass = sum(left.values()) + len(left)
                if symbols[i] in left:
                    total += math.log10(left[symbols[i]] / mass)
                    break
                if mass:
                    total += math.log10(len(left) / mass)
                gone |= set(held)
            else:
                total -= math.log10(255 - len(gone))
        return total

    def base(self, text):
        import math

        n, v = sum(self.words.values()), len(self.words)
        counts = [self.words.get(w, 0) for w in [*words(text), None]]
        return len(counts), sum(c > 0 for c in counts), n, sum(math.log10((c + 1) / (n + v + 1)) for c in counts)


def contamination(docs, items, window=10, slop=0):
    """[(doc_id, text)], [(item_id, text)] -> one (doc_id, words, hit words, sorted item ids) per document."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    out = []
    for doc_id, text in docs:
        found, hit, held = split(text), set(), set()
        for item_id, item in items:
            words_of = split(item)
            size = min(len(words_of), window)
            for s in range(len(words_of) - size + 1 if size else 0):
                piece = words_of[s:s + size]
                for at in range(-slop, len(found)):
                    if all(w in found[max(0, at + k):max(0, at + k + slop + 1)] for k, w in enumerate(piece)):
                        held.add(item_id)
                        if not slop:
                            hit |= set(range(at, at + size))
        out.append((doc_id, len(found), len(hit), sorted(str(i) for i in held if i is not None), len(held)))
    return out


def collocations(docs, least=30, contained=80, top=2000):
    """[(lang, text)] -> set of (lang, rank, phrase, a, l, r, n, score)."""
    from collections import Counter

    seen, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(w)
            seen.update((lang, w[i:i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    rows = {}
    for (lang, w), a in seen.items():
        if len(w) < 2 or a < least:
            continue
        cuts = [(2_000_000 * a // (seen[lang, w[:k]] + seen[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        rows[lang, w] = (a, seen[lang, w[:k]], seen[lang, w[k:]], score)
    gone = set()
    for (lang, w), row in rows.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                if 100 * row[0] >= contained * rows[lang, w[i:i + k]][0]:
                    gone.add((lang, w[i:i + k]))
    out = set()
    for lang in n:
        mine = [(-v[3], -v[0], " ".join(w).encode(), v) for (x, w), v in rows.items() if x == lang and (x, w) not in gone]
        for rank, (_, _, phrase, (a, left, right, score)) in enumerate(sorted(mine)[:top], 1):
            out.add((lang, rank, phrase.decode(), a, left, right, n[lang], score))
    return out


def merkle(rows):
    """[(lang, id, leaf)] -> (root, {(lang, id, leaf): subroot and the sibling digests from leaf to root, as a list of both})."""
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            last = levels[-1]
            levels.append([digest("".join(last[i:i + 2])) for i in range(0, len(last), 2)])
        return levels

    def path(levels, place):
        out = []
        for nodes in levels[:-1]:
            out += nodes[place ^ 1:(place ^ 1) + 1]
            place >>= 1
        return out

    groups = {}
    for lang, i, leaf in rows:
        groups.setdefault(lang, []).append((i is not None, i or 0, leaf))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([leaf for _, _, leaf in sorted(groups[g])]) for g in order}
    top = tree([trees[g][-1][0] for g in order])
    out = {}
    for k, g in enumerate(order):
        for place, (known, i, leaf) in enumerate(sorted(groups[g])):
            out.setdefault((g, i if known else None, leaf), []).append((trees[g][-1][0], path(trees[g], place) + path(top, k)))
    return top[-1][0], out


def best_fit(counts, lengths, overhead=64, attention=65536):
    """{length: pieces} -> sorted [(capacity, tokens)] of the bins, piece by piece."""
    bins, to_come = [], sum(n * c for n, c in counts.items())
    for n in sorted(counts, reverse=True):
        left = counts[n]
        to_come -= n * left
        while left and n:
            rooms = [(c - used, k) for k, (c, used) in enumerate(bins) if c - used >= n]
            if rooms:
                bins[min(rooms)[1]][1] += n
                left -= 1
                continue

            def price(c):
                return (overhead + c + c * c / attention) / min(c, (left * n + to_come) / -(-left // (c // n)))

            best = min((c for c in lengths if c >= n), key=lambda c: (price(c), c))
            bins += [[best, 0] for _ in range(-(-left // (best // n)))]
    if not bins and counts.get(0):
        bins.append([lengths[0], 0])
    return sorted((next(c for c in lengths if c >= used), used) for _, used in bins)
