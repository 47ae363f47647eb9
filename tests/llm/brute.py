"""Plain Python versions of the queries' contracts, over pandas frames."""

import base64
import hashlib
import re
from collections import defaultdict

import pandas as pd


def none(x):
    return None if x is None or x is pd.NA or (isinstance(x, float) and x != x) else x


def text(x):
    return none(x) or ""


def number(x):
    return None if none(x) is None else int(x)


def base_spans(t):
    found = []
    for kind, (name, pattern, ok) in enumerate(
        (
            ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
            ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
            ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
        )
    ):
        found += [(m.start(), kind, m.end(), name) for m in pattern.finditer(t) if ok(m)]
    return [(name, s, e) for s, _, e, name in sorted(found)]


def secrets(docs):
    out = []
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        own = base_spans(text(t))
        said = ",".join(f"{k}:{s}:{e}" for k, s, e in own)
        n = [sum(k == kind for k, _, _ in own) for kind in ("assign", "access", "hex")]
        out.append((number(i), *n, hashlib.sha256(said.encode()).hexdigest()))
    return out


def bpe(docs, ranks, pattern):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    out = []
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        ids = enc.encode_ordinary(text(t))
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        out.append((number(i), len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text(t).encode()).hexdigest()))
    return out


ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return t.translate({c: c + 32 for c in range(65, 91)})


def contamination(docs, items):
    windows = defaultdict(set)
    for i, t in zip(items.item_id, items.text, strict=True):
        w = ALNUM.findall(lower(text(t)))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add("" if none(i) is None else str(i))
    sizes = {len(x) for x in windows}
    out = []
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        w = ALNUM.findall(lower(text(t)))
        hit, own = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    own |= windows[tuple(w[k : k + n])]
        out.append((number(i), len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    return out


def edited(docs):
    rows = [(number(i), text(t)) for i, t in zip(docs.doc_id, docs.text, strict=True)]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        out.append((i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    return out


def split_url(u):
    u = text(u)
    if "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return lower(host), re.match(r"[^?#]*", rest[len(host) :])[0]


def ruled(u, rules):
    host, path = split_url(u)
    best = max(((len(h + p), h + p, kind) for kind, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
    return host, path, best[1] if best else None, best[2] if best else None


def shingles(t, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def groups(docs, percent):
    """Sets, ids, and a root for each row."""
    sets = [shingles(text(t)) for t in docs.text]
    ids = [number(i) for i in docs.doc_id]
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    common = defaultdict(int)
    for own in by.values():
        for a in range(len(own)):
            for b in own[a + 1 :]:
                common[own[a], b] += 1
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            root[find(a)] = find(b)
    return sets, ids, [find(i) for i in range(len(ids))]


def near_duplicates(docs, percent):
    sets, ids, roots = groups(docs, percent)
    least = {}
    for r, d in zip(roots, ids, strict=True):
        if d is not None and (r not in least or d < least[r]):
            least[r] = d
    return [(d, len(sets[i]), c := least.get(roots[i], d), d is None or d == c) for i, d in enumerate(ids)]


def one_of_each(docs, percent):
    """(doc_id, text) of one row of each group, of the least id (null last); each different row with an empty set stays. Where a group's least id has several texts, any of these is as good."""
    sets, ids, roots = groups(docs, percent)
    best, out = {}, set()
    for i, (d, t) in enumerate(zip(ids, docs.text, strict=True)):
        row = (d, none(t))
        if not sets[i]:
            out.add(row)
        elif roots[i] not in best or (d is not None and (best[roots[i]][0] is None or d < best[roots[i]][0])):
            best[roots[i]] = row
    return [*best.values(), *sorted(out, key=repr)]


def warc(pages):
    least = {}
    for i, h in zip(pages.page_id, pages.html, strict=True):
        p = text(h).encode()
        if number(i) is not None:
            least[p] = min(least.get(p, number(i)), number(i))
    out = []
    for i, h in zip(pages.page_id, pages.html, strict=True):
        p, i = text(h).encode(), number(i)
        revisit = p in least and least[p] != i
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", least[p] if revisit else None))
    return out
