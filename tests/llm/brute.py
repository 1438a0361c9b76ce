"""Slow, plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from html import unescape
from html.parser import HTMLParser


def grams(text, n=3):
    w = re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def jaccard_pairs(docs, threshold, n=3):
    """Every pair of documents, as (smaller, larger): similarity; docs: (id, text)."""
    sets = [(i, grams(t, n)) for i, t in docs if i is not None and t is not None]
    out = {}
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and i != j:
                s = len(a & b) / len(a | b)
                if s >= threshold - 1e-12:
                    k = (min(i, j), max(i, j))
                    out[k] = max(out.get(k, 0), s)
    return out


def groups(pairs):
    """Each node's smallest node."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def least_edits(pattern, text):
    """Edits of the pattern against the best part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edits(a, b):
    """Edits between two whole texts."""
    row = list(range(len(b) + 1))
    for i, p in enumerate(a, 1):
        new = [i]
        for j, t in enumerate(b, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def fold(text):
    return "".join(" " if c.isspace() else c.lower() if len(c.lower()) == 1 else c for c in text)


def segments(text, size, stride):
    t = fold(text)
    starts = list(range(0, max(1, len(t) - size + 1), stride))
    if len(t) > size and starts[-1] != len(t) - size:
        starts.append(len(t) - size)
    return [t[s : s + size] for s in starts]


def mixed(docs, weights, share, default=1.0, seed=0):
    """Identifiers kept, in order; docs: (id, text, source)."""
    by = defaultdict(list)
    for i, t, s in docs:
        key = "|".join([str(seed), *[str(x) for x in (i, t) if x is not None]])
        by[s].append((hashlib.md5(key.encode()).hexdigest(), i, len(re.findall(r"[^ \t\n\r\f\x0b]+", t or ""))))
    rows, total = [], 0
    for s, own in by.items():
        w, run = weights.get(s, default), 0
        if w <= 0:
            continue
        for k, i, n in sorted(own):
            run += n
            total += n
            rows.append((run / w, s or "", k, i, n))
    out, run = [], 0
    for _, _, _, i, n in sorted(rows):
        run += n
        if run > int(total * share):
            break
        out.append(i)
    return out


def best_paths(messages, per_root=1):
    """(tree, root, leaf): (rank, turns, score, identifiers); messages: (tree, id, parent, role, text, score)."""
    node = {(m[0], m[1]): m for m in messages}
    kids = defaultdict(list)
    roots = []
    for (tree, i), m in node.items():
        if m[2] is not None and (tree, m[2]) in node:
            kids[tree, m[2]].append(i)
        else:
            roots.append((tree, i))
    out = {}
    for tree, r in roots:
        found, stack = [], [[r]]
        while stack:
            path = stack.pop()
            below = kids[tree, path[-1]]
            stack += [[*path, k] for k in below]
            if not below:
                found.append((-sum(node[tree, i][5] or 0 for i in path), path[-1], path))
        for rank, (s, leaf, path) in enumerate(sorted(found)[:per_root], 1):
            out[tree, r, leaf] = (rank, len(path), -s, path)
    return out


def page_blocks(html, block_tags, hidden):
    """(text, characters in links) of a well-formed page's blocks, from the standard library's events."""
    events = []

    class Parser(HTMLParser):
        def handle_starttag(self, tag, attrs):
            events.append(("open", tag))

        handle_startendtag = handle_starttag

        def handle_endtag(self, tag):
            events.append(("close", tag))

        def handle_data(self, data):
            events.append(("text", unescape(data)))

        def handle_entityref(self, name):
            events.append(("text", unescape(f"&{name};")))

        def handle_comment(self, data):
            events.append(("mark", ""))

    Parser(convert_charrefs=False).feed(html)
    blocks, inside, link, text, linked, breaks, run = [], None, False, "", 0, 0, ""
    for kind, value in [*events, ("close", "html")]:
        if inside:
            if (kind, value) == ("close", inside):
                inside = None
            continue
        if kind == "text":
            run += value
            continue
        if run.strip():
            breaks = 0
            linked += len(" ".join(run.split())) if link else 0
        text, run = text + run, ""
        if kind == "open" and value in hidden:
            inside = value
        if value == "a":
            link = kind == "open"
        if value == "br":
            breaks, text = breaks + 1, text + " "
        if inside or value in block_tags or breaks > 1:
            t = " ".join(text.split())
            if t:
                blocks.append((t, min(linked, len(t))))
            text, linked, breaks = "", 0, 0
    return blocks


def block_label(text, linked, stop_words):
    words = re.findall(r"\w+", text.lower())
    share = len([w for w in words if w in stop_words]) / max(1, len(words))
    if "\u00a9" in text or linked > 0.2 * len(text):
        return "bad"
    if len(text) < 70:
        return "short" if not linked else "bad"
    if share < 0.1:
        return "bad"
    return "good" if share >= 0.2 and len(text) > 200 else "near"
