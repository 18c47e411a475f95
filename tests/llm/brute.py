"""Plain re-statements of what the queries return, over lists of rows."""

import xxhash


def fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = [w for w in _split(low)]
    if not ws:
        return 0
    sh = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def _split(text):
    word = ""
    for c in text:
        if c in " \t\n\x0b\x0c\r":
            if word:
                yield word
            word = ""
        else:
            word += c
    if word:
        yield word


def words(text):
    return list(_split(text or ""))


def components(fps, bits=3):
    """{doc_id: smallest doc_id reachable}."""
    root = {d: d for d in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}


def without_repeats(docs, window=50):
    """{doc_id: (n_words, kept words)} for unique doc_ids."""
    first = {}
    split = {d: words(t) for d, t in docs.items()}
    for d in sorted(docs):
        ws = split[d]
        for i in range(len(ws) - window + 1):
            first.setdefault(tuple(ws[i : i + window]), d)
    out = {}
    for d, ws in split.items():
        gone = set()
        for i in range(len(ws) - window + 1):
            if first[tuple(ws[i : i + window])] < d:
                gone.update(range(i, i + window))
        out[d] = (len(ws), [w for i, w in enumerate(ws) if i not in gone])
    return out


def targets(sizes, weights=(5, 2, 1), epochs=3):
    """{source: target} by sharing again and again until no target is above its cap."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, open_ = sum(sizes.values()), {}, set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > epochs * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in open_}
        for s in over:
            out[s] = float(epochs * sizes[s])
            left -= epochs * sizes[s]
        open_ -= over
    return out


def mix(docs, epochs=3):
    """{row number: copies} for rows (doc_id, source, text)."""
    order = mix_order(docs, epochs)
    return {i: order.count(i) for i in range(len(docs))}


def mix_order(docs, epochs=3):
    """The row numbers of the mix's copies by finish time."""
    import hashlib

    rows = [(i, d, s, len(words(t))) for i, (d, s, t) in enumerate(docs)]
    total = {}
    for _, _, s, n in rows:
        total[s] = total.get(s, 0) + n
    target, copies, upto = targets(total), [], dict.fromkeys(total, 0)
    key = lambda d: hashlib.md5(f"mix:{'' if d is None else d}".encode()).hexdigest()
    for i, d, s, n in sorted(rows, key=lambda r: (key(r[1]), -(1 << 62) if r[1] is None else r[1], r[3])):
        upto[s] += n
        if n:
            copies += [((e * total[s] + upto[s]) / target[s], key(d), d or 0, e, i, n) for e in range(epochs)]
    out, held = [], 0
    for *_, i, n in sorted(copies):
        if held + n > sum(total.values()):
            break
        held += n
        out.append(i)
    return out
