"""Plain versions of what the queries must give, over lists of rows, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text):
    return WORD.findall(lower(text or ""))


def shingles(text, k):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def components(ids, linked):
    """id → smallest id reachable, by trying all pairs."""
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    order = sorted(up)
    for n, a in enumerate(order):
        for b in order[n + 1 :]:
            if linked(a, b):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in order}


def jaccard_components(texts, k, num, den):
    sets = {i: shingles(t, k) for i, t in texts.items()}
    link = lambda a, b: bool(sets[a] and sets[b]) and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])
    return components(texts, link), {i: len(s) for i, s in sets.items()}


def spelled(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()


ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secret_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(found)]


def luhn(digits):
    total = 0
    for n, d in enumerate(reversed(digits)):
        x = int(d) * (1 + n % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def personal_spans(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    )
    return [(kind, m.start(), m.end()) for kind, pattern, test in kinds for m in re.finditer(pattern, text) if test(m)]


def weighted_windows(text, item, least):
    """(similarity, start) of the best window of the item's length in words."""
    t, w = lower_all(text), lower_all(item)
    if len(w) < 5 or len(t) < 5:
        return None
    bag = lambda x: Counter(tuple(x[i : i + 5]) for i in range(len(x) - 4))
    want, best = bag(w), None
    if not want.keys() & bag(t).keys():
        return None
    for start in range(max(1, len(t) - len(w) + 1)):
        have = bag(t[start : start + len(w)])
        both, either = sum((want & have).values()), sum((want | have).values())
        if both >= least * either and (best is None or both / either > best[0]):
            best = both / either, start
    return best


def lower_all(text):
    return WORD.findall((text or "").lower())


def warc_rows(pages):
    """{page_id: (payload_bytes, digest, type, refers_to)} of (page_id, html) with distinct ids."""
    data = {i: (h or "").encode() for i, h in pages}
    most = {}
    for i, d in data.items():
        if len(d) >= 1000:
            most[d] = max(i, most.get(d, i))
    out = {}
    for i, d in data.items():
        other = most.get(d, i)
        out[i] = (len(d), hashlib.sha1(d).hexdigest(), "response" if other == i else "revisit", None if other == i else other)
    return out


def base_scores(docs, training):
    """{doc_id: (n_tokens, n_known, train_tokens, base_score)}; docs: {doc_id: text}."""
    tokens = lambda t: [*words(t), None]  # noqa: E731  None: the end
    counts = Counter(x for i, t in docs.items() if training(i) for x in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return {i: (len(tokens(t)), sum(x in counts for x in tokens(t)), n, sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens(t))) for i, t in docs.items()}


def prefix_trie(rows):
    """Nodes as the query gives them, of rows (conv_id, turn, role, text)."""
    by = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    by = {c: [t[2:] for t in sorted(own, key=lambda t: t[:2])] for c, own in by.items()}
    built = {}
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = by.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:]
    members, children, totals, out = {}, {}, {}, []
    prefix_of = {}
    for c, turns in built.items():
        prefix_of[c] = [hashlib.sha256().digest()]
        for role, text in turns:
            prefix_of[c].append(hashlib.sha256(prefix_of[c][-1] + repr((role, text)).encode()).digest())
        for d, p in enumerate(prefix_of[c]):
            if (d, p) not in members:
                members[d, p] = []
                if d:
                    children.setdefault((d - 1, prefix_of[c][d - 1]), []).append((d, p))
            members[d, p].append(c)
    for node in sorted(members, key=lambda n: -n[0]):
        depth, convs = node[0], members[node]
        saved, leaves = (len(convs) - 1) * (len(built[convs[0]][depth - 1][1]) if depth else 0), 0 if node in children else 1
        for child in children.get(node, []):
            saved, leaves = saved + totals[child][0], leaves + totals[child][1]
        totals[node] = saved, leaves
        parent = min(members[depth - 1, prefix_of[convs[0]][depth - 1]]) if depth else None
        ends = ",".join(str(c) for c in sorted(convs) if len(built[c]) == depth)
        out.append((min(convs), depth, parent, len(convs), len(children.get(node, [])), leaves, saved, sha256(ends)))
    return out


def merkle_manifest(rows):
    """Rows as the query gives them, of documents (doc_id, text, lang, source, n_chars)."""
    spelled_field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    sources = {}
    for doc_id, text, lang, source, n_chars in rows:
        tampered = text.replace("\n", "") if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 else text
        own, now = (sha256("".join(map(spelled_field, (doc_id, source, lang, n_chars, t)))) for t in (text, tampered))
        sources.setdefault(source, []).append({"id": doc_id, "leaf": own, "now": now, "path": []})

    def build(nodes):
        while len(nodes) > 1:
            above = []
            for a in range(0, len(nodes), 3):
                run = nodes[a : a + 3]
                for k, (_, leaves) in enumerate(run):
                    for x in leaves:
                        x["path"].append(("".join(d for d, _ in run[:k]), "".join(d for d, _ in run[k + 1 :])))
                above.append((sha256("".join(d for d, _ in run)), [x for _, leaves in run for x in leaves]))
            nodes = above
        return nodes[0]

    tops = []
    for source in sorted(sources, key=lambda s: (s is not None, (s or "").encode())):
        digest, leaves = build([(x["leaf"], [x]) for x in sorted(sources[source], key=lambda x: (x["id"] is not None, x["id"] or 0, x["leaf"]))])
        for x in leaves:
            x["subroot"] = digest
        tops.append((digest, leaves))
    root, leaves = build(tops)
    out = []
    for x in leaves:
        folded = x["now"]
        for left, right in x["path"]:
            folded = sha256(left + folded + right)
        out.append((x["id"], x["leaf"], x["subroot"], root, sha256("".join(a + b for a, b in x["path"])), folded, folded == root))
    return out


def contexts(texts, support=5, share=0.5, least=0.9):
    """The values that contexts find in the texts, by a plain bootstrap over all patterns and values."""
    digits = lambda v: re.sub("[^0-9]", "", v)
    kinds = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda v: 13 <= len(digits(v)) <= 19 and luhn(digits(v))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(digits(v)) <= 15),
        (r"(?<![0-9A-Za-z])(?=[A-Za-z_./:-]{0,15}[0-9](?:[A-Za-z_./:-]*[0-9]){2})[0-9A-Za-z][0-9A-Za-z_./:-]{2,}[0-9A-Za-z]", lambda v: True),
    )
    count, sure, others = Counter(), set(), set()
    for text in texts:
        text, base = text or "", []
        for k, (pattern, test) in enumerate(kinds):
            found = list(re.finditer(pattern, text))
            edges = [0, *(x for m in found for x in m.span()), len(text)]
            for n, m in enumerate(found):
                if not test(m[0]) or k == 4 and any(m.start() < b and a < m.end() for a, b in base):
                    continue
                base += [m.span()] * (k < 4)
                (sure if k < 4 else others).add(m[0])
                before, after = WORD.findall(text[edges[2 * n] : m.start()].lower()), WORD.findall(text[m.end() : edges[2 * n + 3]].lower())
                count.update((p, m[0]) for p in [*(f"1 {w}" for w in before[-1:]), *([f"2 {before[-2]} {before[-1]}"] if len(before) > 1 else []), *(f"+ {w}" for w in after[:1])])
    while True:
        total, held, values = Counter(), Counter(), Counter()
        for (p, v), n in count.items():
            total[p] += n
            held[p] += n * (v in sure)
            values[p] += v in sure
        good = {p for p in total if values[p] >= support and held[p] >= share * total[p] and held[p] / (held[p] + 1) >= least}
        new = {v for p, v in count if p in good} - sure
        if not new:
            return {v for p, v in count if p in good} & others
        sure |= new
