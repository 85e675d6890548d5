"""Plain versions of operators, for small inputs."""

from __future__ import annotations

import re

from identity_spark.llm import pieces


def brute_viterbi(v, text):
    s = pieces.BLANK + text.replace(" ", pieces.BLANK) if text else ""
    best, back = [0] + [None] * len(s), [None] * (len(s) + 1)
    for end in range(1, len(s) + 1):
        for start in range(max(0, end - v.longest), end):
            i = v.id.get(s[start:end])
            if i is not None and (best[end] is None or best[start] + v.score[i] > best[end]):
                best[end], back[end] = best[start] + v.score[i], (start, [i])
        if best[end] is None:
            best[end], back[end] = best[end - 1] + v.unknown, (end - 1, v.spelled(s[end - 1]))
    out, at = [], len(s)
    while at:
        at, ids = back[at]
        out.append(ids)
    return [i for x in reversed(out) for i in x]


def shingle_set(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute_components(rows, size, percent):
    sets, root = [shingle_set(t, size) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return {rows[i][0]: (len(sets[i]), min(groups[find(i)]) if sets[i] else rows[i][0]) for i in range(len(rows))}


def brute_spans(text):
    spans = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"""((?:(?i:password|passwd|token|api_?key)|(?ai:secret)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(spans + [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])
