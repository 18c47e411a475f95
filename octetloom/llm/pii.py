"""Personal data by patterns and a skip-chain conditional random field.

The patterns find e-mail addresses, IP addresses, card numbers and phone numbers
in whole texts. The field then labels every token with a digit or an at sign,
written out or not (all others are none). It has a factor for each token's shape
and context, one for each pair of adjacent tokens, and skip factors, however
distant the tokens: all occurrences of one thing in any spelling (equal digits;
equal letters and digits) hang on one shared node, and nodes of similar things
(one edit apart, or of equal last nine digits) on each other. Only what hangs
together with a find of the patterns has such nodes, so that copies of a number
that no pattern accepts cannot vouch for each other. Loopy belief propagation
carries the finds along these links until the messages settle.

All weights are learned by pseudo-likelihood from a bounded sample: the patterns'
labels of all tokens, and masked twins of what they find and of other numbers,
which are put into the text elsewhere, rewritten and without their label.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octetloom.llm.common import BLANKS, materialised
from octetloom.session import spread

KINDS = ("email", "ip", "card", "phone")
#: Documents that the field is fitted on, at most: of those with a digit or an at sign, the ones with the least hash of doc_id.
SAMPLE_DOCS = 4_000
LEAST_MARGINAL = 0.95
#: Letters and digits of a key that may be linked at all, of a number, and of one that may be linked to a similar one; keys above the last are compared by hashes.
LEAST_KEY, LEAST_DIGITS, LEAST_SIMILAR, MOST_SIMILAR = 5, 7, 9, 64
#: Where more finds and more other things than this share one deletion or ending, a node between them stands for their links.
MOST_PAIRED = 16
#: Masked twins of one document that the field is fitted on, at most.
TWINS = 40
Span = tuple[int, int, int]  # start, kind, end

_DIGIT = re.compile(r"[0-9]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """What the patterns find: of each kind leftmost and non-overlapping, without those that fail its check, by start and kind.

    Every search takes time in proportion to the text: an address is sought from
    its at sign, an IP address within a whole run of dotted numbers.
    """
    out: list[Span] = []
    if "@" in text:
        free, at = 0, text.find("@")
        while at >= 0:
            start = at
            while start > free and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            m = _DOMAIN.match(text, at + 1) if start < at else None
            if m:
                out.append((start, 0, m.end()))
                free = m.end()
            else:
                free = max(free, at + 1)
            at = text.find("@", max(at + 1, free))
    if _DIGIT.search(text):
        for m in _DOTTED.finditer(text):
            parts, at = m.group().split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                end = at + sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in four):
                    out.append((at, 1, end))
                at = end + 1
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    out.sort()
    return out


_AT = re.compile(r"[(\[{]\s?(?:at|AT|At)\s?[)\]}]")
_DOT = re.compile(r"[(\[{]\s?(?:dot|DOT|Dot)\s?[)\]}]")
_MARK = re.compile(r"[0-9@]|[(\[{](?:at|AT|At)[)\]}]")
_REST = re.compile(r"[^\x20\x09-\x0D]*")
_EDGE = " \t\n\x0b\x0c\r.,;:!?()[]{}<>\"'*#$%&|="
_BLANK = re.compile(r"[\x20\x09-\x0D]*\Z")
_CUES = (("mail", "contact", "write", "correo", "courriel"), ("ip", "host", "server", "address", "addr"), ("card", "visa", "account", "tarjeta", "carte", "karte"), ("tel", "phone", "call", "fax", "mobile", "telefon", "teléfono"))
N_FEATURES = 31
SIDE = 5


def tokens(text: str) -> list[tuple[int, int]]:
    """The tokens that may be labelled, without the punctuation around them."""
    out, free = [], 0
    for m in _MARK.finditer(text):
        a = m.start()
        if a < free:
            continue
        while a > free and text[a - 1] not in BLANKS:
            a -= 1
        free = b = _REST.match(text, m.start()).end()
        while a < b and text[a] in _EDGE and text[a] != "(":
            a += 1
        while b > a and text[b - 1] in _EDGE and text[b - 1] != ")":
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def _run_bounds(text: str, toks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """For each token the first and last of the adjacent number tokens around it."""
    number = [all(c in "0123456789().+-/" for c in text[a:b]) for a, b in toks]
    first = 0
    out: list[tuple[int, int]] = []
    while first < len(toks):
        last = first
        while number[first] and last + 1 < len(toks) and number[last + 1] and toks[last + 1][0] - toks[last][1] <= 2:
            last += 1
        out += [(first, last)] * (last - first + 1)
        first = last + 1
    return out


def features(text: str, toks: list[tuple[int, int]]) -> np.ndarray:
    x = np.zeros((len(toks), N_FEATURES), np.float32)
    runs, cache = _run_bounds(text, toks), {}
    for i, (a, b) in enumerate(toks):
        t = text[a:b]
        n = sum(c.isdigit() for c in t)
        if runs[i] not in cache:
            cache[runs[i]] = "".join(c for c in text[toks[runs[i][0]][0] : toks[runs[i][1]][1]] if c.isdigit())
        run, whole = cache[runs[i]], len(cache[runs[i]])
        head = toks[runs[i][0]][0]
        before = text[max(0, head - 24) : head].lower()
        f = [
            1,
            "@" in t,
            bool(re.search(r"[^@]@[A-Za-z0-9-]+\.[A-Za-z0-9]", t)),
            n == 0,
            1 <= n <= 2,
            3 <= n <= 4,
            5 <= n <= 8,
            9 <= n <= 11,
            12 <= n <= 19,
            n > 19,
            t.count(".") == 3 and n + 3 == len(t),
            t[0] == "+",
            "(" in t or ")" in t,
            any(c.isalpha() for c in t),
            "-" in t,
            n == len(t),
            12 <= n <= 19 and luhn("".join(c for c in t if c.isdigit())),
            whole < 9,
            9 <= whole <= 11,
            12 <= whole <= 15,
            16 <= whole <= 19,
            whole > 19,
            12 <= whole <= 19 and run.isascii() and luhn(run),
            text[head] == "+",
            runs[i][0] < runs[i][1],
            any(c in before for c in _CUES[0]),
            any(c in before for c in _CUES[1]),
            any(c in before for c in _CUES[2]),
            any(c in before for c in _CUES[3]),
            before.rstrip().endswith((":", "=")),
            bool(_AT.search(t)),
        ]
        x[i] = f
    return x


def adjacent(text: str, toks: list[tuple[int, int]]) -> np.ndarray:
    """The pairs of tokens with nothing but punctuation and blanks between them, as an array of (from, to)."""
    near = [(i, i + 1) for i in range(len(toks) - 1) if _BLANK.match(text[toks[i][1] : toks[i + 1][0]].strip(_EDGE)) and toks[i + 1][0] - toks[i][1] <= 16]
    return np.array(near, np.int64).reshape(-1, 2)


def _digits(t: str) -> str:
    return "".join(c for c in t if c in "0123456789")


def _key(t: str) -> str:
    """What stays of a token in any spelling: its letters and digits, without a written-out at or dot."""
    return "".join(c for c in _DOT.sub(".", _AT.sub("@", t)).lower() if c.isalnum())


_PRIME = (1 << 61) - 1


def _near(key: str) -> set:
    """What a key shares with every key one edit away: itself and each deletion, and of a number its last nine digits.

    Of keys longer than MOST_SIMILAR polynomial hashes stand for these, so that a
    key takes time and space in proportion to its length.
    """
    n = len(key)
    if n < LEAST_SIMILAR:
        return set()
    out: set = {f"...{key[-9:]}"} if key.isdigit() else set()
    if n <= MOST_SIMILAR:
        out |= {key, *(key[:i] + key[i + 1 :] for i in range(n))}
    if n >= MOST_SIMILAR:
        base, head, tail, power = 1_000_003, [0], [0], [1]
        for a, b in zip(key, reversed(key)):
            head.append((head[-1] * base + ord(a) + 1) % _PRIME)
            tail.append((tail[-1] + (ord(b) + 1) * power[-1]) % _PRIME)
            power.append(power[-1] * base % _PRIME)
        out.add((n, head[n]))
        if n > MOST_SIMILAR:
            out |= {(n - 1, (head[i] * power[n - 1 - i] + tail[n - 1 - i]) % _PRIME) for i in range(n)}
    return out


@dataclass
class Links:
    """The skip links of a document: for each shared node the tokens of its occurrences (none: a node between others), and the pairs of similar nodes."""

    nodes: list[list[int]]
    similar: list[tuple[int, int]]


def skip_links(text: str, toks: list[tuple[int, int]], base: list[Span], hidden: set[int] = frozenset()) -> Links:
    """The nodes of the patterns' finds that have other occurrences or similar things besides, and of those similar things.

    Tokens in ``hidden`` count as found by no pattern. A find's digits are looked
    for in every stretch of adjacent number tokens; what is left of a stretch is
    one thing by its digits, or where these are like no find's, cut into the
    numbers that are. Each thing is linked to every find that shares a deletion or
    ending with it; where both are many, by way of one node, so that time and
    links grow with the tokens only.
    """
    starts = [a for a, _ in toks]
    found: dict[str, list[int]] = {}
    taken = set()
    for start, kind, end in base:
        i = max(0, bisect_right(starts, start) - 1)
        mine = []
        while i < len(toks) and toks[i][0] < end:
            if toks[i][1] > start and i not in hidden:
                mine.append(i)
            i += 1
        if mine:
            taken.update(mine)
            key = _key(text[start:end]) if kind == 0 else _digits(text[start:end])
            if len(key) >= (LEAST_KEY if kind == 0 else LEAST_DIGITS):
                found.setdefault(key, []).extend(mine)
    if not found:
        return Links([], [])
    longest = max([len(k) for k in found if k.isdigit()], default=0)
    hubs: dict = {}
    for k in found:
        for n in _near(k):
            hubs.setdefault(n, []).append(k)
    like = lambda k: not hubs.keys().isdisjoint(_near(k))
    others: dict[str, list[int]] = {}

    def left_over(parts: list[str], at: int) -> None:
        """Number tokens from ``at`` on, with the digits ``parts``, that are no find's."""
        cuts, whole = [(0, len(parts))], "".join(parts)
        if len(parts) > 1 and not like(whole):
            cuts, i, rest = [], 0, 0
            while i < len(parts):
                upto, window = 0, ""
                for j in range(i, len(parts)):
                    window += parts[j]
                    if len(window) > longest + 1:
                        break
                    if like(window):
                        upto = j + 1
                if upto:
                    cuts += [(rest, i), (i, upto)]
                    rest = upto
                i = upto or i + 1
            cuts.append((rest, len(parts)))
        for a, b in cuts:
            key = "".join(parts[a:b])
            if len(key) >= LEAST_DIGITS:
                others.setdefault(key, []).extend(range(at + a, at + b))

    runs = _run_bounds(text, toks)
    for first, last in sorted(set(runs)):
        at = first
        while at <= last:
            if at in taken:
                at += 1
                continue
            upto = at
            while upto < last and upto + 1 not in taken:
                upto += 1
            number = all(c in "0123456789().+-/" for c in text[toks[at][0] : toks[at][1]])
            if not number:
                key = _key(text[toks[at][0] : toks[at][1]])
                if len(key) >= LEAST_KEY:
                    (found if key in found else others).setdefault(key, []).append(at)
                at += 1
                continue
            parts = [_digits(text[a:b]) for a, b in toks[at : upto + 1]]
            i = rest = 0
            while i <= len(parts):
                match, whole = 0, ""
                for j in range(i, len(parts)):
                    whole += parts[j]
                    if len(whole) > longest:
                        break
                    if whole in found:
                        match = j + 1
                if match or i == len(parts):
                    left_over(parts[rest:i], at + rest)
                    if match:
                        found["".join(parts[i:match])].extend(range(at + i, at + match))
                        rest = match
                i = match or i + 1
            at = upto + 1
    sharers: dict = {}
    for k in others:
        for n in _near(k):
            if n in hubs:
                sharers.setdefault(n, []).append(k)
    pairs, between = set(), []
    for n, ks in sharers.items():
        if min(len(ks), len(hubs[n])) <= MOST_PAIRED:
            pairs |= {(k, f) for k in ks for f in hubs[n]}
        else:
            between.append((ks, hubs[n]))
    between.sort()
    mid = [(k, h) for h, (ks, _) in enumerate(between) for k in ks], [(h, f) for h, (_, fs) in enumerate(between) for f in fs]
    used = dict.fromkeys([k for k, at in found.items() if any(i not in taken for i in at)] + [k for pair in sorted(pairs) for k in pair] + [k for k, _ in mid[0]] + [f for _, f in mid[1]])
    number = {k: n for n, k in enumerate(used)}
    similar = [(number[a], number[b]) for a, b in sorted(pairs)] + [(number[k], len(used) + h) for k, h in mid[0]] + [(len(used) + h, number[f]) for h, f in mid[1]]
    return Links([(found | others)[k] for k in used] + [[] for _ in between], similar)


def evidence(toks: list[tuple[int, int]], base: list[Span]) -> np.ndarray:
    """The label that the patterns give each token (0: none)."""
    y = np.zeros(len(toks), np.int64)
    starts = [a for a, _ in toks]
    for start, kind, end in reversed(base):
        i = max(0, bisect_right(starts, start) - 1)
        while i < len(toks) and toks[i][0] < end:
            if toks[i][1] > start:
                y[i] = kind + 1
            i += 1
    return y


@dataclass
class Field:
    """Weights of the token and chain factors, and of links to an equal and to a similar thing by label."""

    unary: np.ndarray
    chain: np.ndarray
    equal: np.ndarray
    similar: np.ndarray

    def marginals(self, x: np.ndarray, near: np.ndarray, linked: Links, known: np.ndarray, rounds: int | None = None) -> np.ndarray:
        """Beliefs of each token by damped loopy belief propagation; tokens with a label in ``known`` keep it.

        Rounds go on until the messages settle; without ``rounds`` the limit grows
        with the tokens.
        """
        n = len(x)
        own = np.concatenate([x @ self.unary, np.zeros((len(linked.nodes), SIDE))])
        own -= own.max(axis=1, keepdims=True)
        own[:n][known > 0] = -30.0
        own[:n][known > 0, known[known > 0]] = 0.0
        skip = [(i, n + k) for k, at in enumerate(linked.nodes) for i in at]
        alike = [(n + a, n + b) for a, b in linked.similar]
        pairs = np.concatenate([near, np.array(skip, np.int64).reshape(-1, 2), np.array(alike, np.int64).reshape(-1, 2)])
        factor = np.exp(np.concatenate([np.repeat(m[None], k, 0) for m, k in ((self.chain, len(near)), (np.diag(self.equal), len(skip)), (np.diag(self.similar), len(alike)))]))
        e = len(pairs)
        a, b = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
        back = np.concatenate([np.arange(e, 2 * e), np.arange(e)])
        factor = np.concatenate([factor, factor.transpose(0, 2, 1)])
        msg = np.zeros((2 * e, SIDE))
        for _ in range(200 + 4 * len(own) if rounds is None else rounds):
            total = own.copy()
            np.add.at(total, b, msg)
            out = total[a] - msg[back]
            out -= out.max(axis=1, keepdims=True)
            new = np.log(np.einsum("ei,eij->ej", np.exp(out), factor) + 1e-30)
            new -= new.max(axis=1, keepdims=True)
            if not e or np.abs(new - msg).max() < 1e-3:
                msg = new
                break
            msg = 0.5 * msg + 0.5 * new
        total = own.copy()
        np.add.at(total, b, msg)
        total = np.exp(total - total.max(axis=1, keepdims=True))
        return (total / total.sum(axis=1, keepdims=True))[:n]

    def extra(self, text: str, base: list[Span]) -> list[Span]:
        """Spans that the field adds: adjacent tokens of one likely label that hang on a find's or a similar thing's node, clear of the patterns' spans."""
        toks = tokens(text) if base else []
        if not toks:
            return []
        near, known, linked = adjacent(text, toks), evidence(toks, base), skip_links(text, toks, base)
        if not linked.nodes:
            return []
        p = self.marginals(features(text, toks), near, linked, known)
        label = np.where(p.max(axis=1) >= LEAST_MARGINAL, p.argmax(axis=1), 0)
        # What has no tie to a find stays as the patterns left it.
        label[sorted(set(range(len(toks))) - {i for at in linked.nodes for i in at})] = 0
        label[known > 0] = 0
        joined = {int(i) for i, _ in near}
        out, i = [], 0
        while i < len(toks):
            j = i
            while label[i] and j in joined and label[j + 1] == label[i]:
                j += 1
            if label[i] and not any(s < toks[j][1] and e > toks[i][0] for s, _, e in base):
                out.append((toks[i][0], int(label[i]) - 1, toks[j][1]))
            i = j + 1
        return out


def _sides(y: np.ndarray, near: np.ndarray, linked: Links) -> np.ndarray:
    """Of each token the labels of its left and right neighbours, and of the finds on its node and on a similar one."""
    side = np.zeros((len(y), 4 * SIDE), np.float32)
    np.add.at(side, (near[:, 1], y[near[:, 0]]), 1)
    np.add.at(side, (near[:, 0], SIDE + y[near[:, 1]]), 1)
    said = [max((int(y[i]) for i in at), default=0) for at in linked.nodes]
    for k, at in enumerate(linked.nodes):
        if said[k]:
            side[at, 2 * SIDE + said[k]] = 1
    heard: dict[int, set[int]] = {}
    for a, b in linked.similar:
        heard.setdefault(a, set()).add(said[b])
    for a, b in linked.similar:
        for k in {said[b]} | (heard.get(b, set()) if not linked.nodes[b] else set()):
            side[linked.nodes[a], 3 * SIDE + k] = 1
    return side


def rewritten(t: str, kind: int, dice: np.random.Generator) -> str:
    """Another spelling of a find (kind 0 to 3) or other number (4): other separators, no country prefix, a written-out at, or one digit wrong."""
    if kind == 0:
        user, _, domain = t.rpartition("@")
        return (user + dice.choice(["(at)", "[at]", "@", "(AT)"]) + domain.replace(".", dice.choice([".", ".", "(dot)"]))).swapcase() if dice.random() < 0.2 else user + dice.choice(["(at)", "[at]"]) + domain
    if kind == 1:
        return t.replace(".", dice.choice([" ", "-", ". "]))
    digits = _digits(t)
    if kind == 3 and len(digits) > 10 and dice.random() < 0.3:
        digits = digits[len(digits) - 10 :]
    if len(digits) >= LEAST_SIMILAR and dice.random() < 0.25:
        i = int(dice.integers(len(digits)))
        digits = digits[:i] + str((int(digits[i]) + int(dice.integers(1, 10))) % 10) + digits[i + 1 :]
    size = int(dice.choice([3, 4, len(digits)]))
    return dice.choice(["", " ", "-", ".", "/"]).join(digits[i : i + size] for i in range(0, len(digits), size))


def twin_rows(text: str, base: list[Span], seed: int) -> Iterator[np.ndarray]:
    """Training rows of masked twins: (features, sides, label) of the tokens of rewritten finds and other numbers, put elsewhere in the text."""
    dice = np.random.default_rng(seed)
    toks = tokens(text)
    others = [(a, 4, b) for a, b in toks if len(_digits(text[a:b])) >= LEAST_DIGITS and not any(s < b and e > a for s, _, e in base)]
    things = base + others
    if len(things) > TWINS:
        things = [things[i] for i in sorted(dice.choice(len(things), TWINS, replace=False))]
    gaps = [m.end() for m in re.finditer(r"[A-Za-z]{2,} ", text)] or [0]
    for start, kind, end in things:
        at = int(dice.choice(gaps))
        twin = rewritten(text[start:end], kind, dice)
        # The find with what is around it, and the twin with what is around its place.
        head = f"{text[max(0, start - 40) : end + 20]}\nand {text[max(0, at - 40) : at]}"
        mini = f"{head}{twin} {text[at : at + 40]}"
        spans = base_spans(mini)
        ts = tokens(mini)
        mine = [i for i, (a, b) in enumerate(ts) if a < len(head) + len(twin) and b > len(head)]
        if not mine or any(s < len(head) + len(twin) and e > len(head) for s, _, e in spans):
            continue
        y = evidence(ts, spans)
        near = adjacent(mini, ts)
        linked = skip_links(mini, ts, spans, set(mine))
        said = {k for at_ in linked.nodes for i in at_ if i in mine for k in at_ if y[k]} | {k for a, b in linked.similar if set(linked.nodes[a]) & set(mine) for k in linked.nodes[b] if y[k]}
        # A twin that no link ties to its find says nothing about links, and is none as far as anything shows.
        label = kind + 1 if kind < 4 and any(y[k] == kind + 1 for k in said) else 0
        truth = y.copy()
        truth[mine] = label
        rows = np.concatenate([features(mini, ts), _sides(y, near, linked), truth[:, None]], axis=1)
        # Of its own tokens, a twin's neighbours have its label too.
        near_side = _sides(truth, near, Links([], []))[:, : 2 * SIDE]
        rows[:, N_FEATURES : N_FEATURES + 2 * SIDE] = near_side
        yield from rows[mine]


def _text_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Field:
    """A field fitted on at most ``sample_docs`` documents by pseudo-likelihood.

    Each distinct (features, neighbours' and finds' labels, label) counts once
    with its number of tokens; masked twins weigh as much as all other tokens
    together. Where the sample has no finds, links are worth nothing; without any
    document all labels are none.
    """
    some = _text_of(docs).where(F.col("text").rlike("[0-9@]"))
    ids = some.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    sample = materialised(some.join(F.broadcast(ids), "doc_id", "left_semi").select("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, twin = [], []
            for t in b.column(0).to_pylist():
                toks, base = tokens(t), base_spans(t)
                if toks:
                    near, y = adjacent(t, toks), evidence(toks, base)
                    out += [r.tobytes() for r in np.concatenate([features(t, toks), _sides(y, near, skip_links(t, toks, base)), y[:, None]], axis=1).astype(np.int8)]
                    twin += [r.astype(np.int8).tobytes() for r in twin_rows(t, base, xxhash.xxh32_intdigest(t))]
            yield pa.RecordBatch.from_arrays([pa.array(out + twin, pa.binary()), pa.array([False] * len(out) + [True] * len(twin))], ["row", "twin"])

    seen = sorted((bytes(r.row), r.twin, r["count"]) for r in sample.mapInArrow(rows, "row binary, twin boolean").groupBy("row", "twin").count().toLocalIterator())
    width = N_FEATURES + 4 * SIDE
    w = np.zeros((width, SIDE))
    if not seen:
        w[0, 0] = 20.0
    else:
        data = np.frombuffer(b"".join(r for r, _, _ in seen), np.int8).reshape(len(seen), width + 1).astype(float)
        x, y, n = data[:, :-1], data[:, -1].astype(int), np.array([c for _, _, c in seen], float)
        twin = np.array([t for _, t, _ in seen])
        for part in (twin, ~twin):
            n[part] /= max(1.0, n[part].sum())
        want = np.eye(SIDE)[y] * n[:, None]
        step, grad_sq = 0.5, np.full(w.shape, 1e-8)
        for _ in range(600):
            z = x @ w
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p *= (n / p.sum(axis=1))[:, None]
            grad = (x.T @ (p - want)) / n.sum() + 1e-4 * w
            grad_sq += grad**2
            w -= step * grad / np.sqrt(grad_sq)
    left, right, equal, similar = (w[N_FEATURES + i * SIDE : N_FEATURES + (i + 1) * SIDE] for i in range(4))
    # A pair's factor is what either side's conditional says of the other, halved; links only ever draw labels together.
    chain = (left + right.T) / 2
    draws = lambda m: np.array([0.0] + [max(0.0, m[k, k] - m[k, 0]) for k in range(1, SIDE)])
    return Field(w[:N_FEATURES], chain - chain.mean(), draws(equal), draws(similar))


def _named(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, n_email, n_ip, n_card and n_phone (the patterns' spans), and base and spans as ``kind:start:end`` joined by commas.

    Positions are code points, the end exclusive, by start and then kind. A null
    text is empty and has no spans; repeated rows give equal rows; null ids stay
    null; an empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, bases, alls = [], [], []
            for t in b.column(1):
                text = t.as_py()
                base = base_spans(text)
                counts.append([sum(k == i for _, k, _ in base) for i in range(4)])
                bases.append(_named(base))
                alls.append(_named(sorted(base + field.extra(text, base))))
            cols = [b.column(0), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(4)), pa.array(bases, pa.string()), pa.array(alls, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"])

    return _text_of(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def redacted_text(text: str, field: Field) -> str:
    """The text with the union of its spans replaced by the kind of the first, as in ``<EMAIL>``."""
    base = base_spans(text)
    out, at = [], 0
    upto = 0
    for start, kind, end in sorted(base + field.extra(text, base)):
        if start >= upto:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = upto = max(upto, end)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, field: Field) -> DataFrame:
    """The documents with personal data replaced in ``text``, ``n_chars`` (if there) kept in step; all rows and columns stay.

    A null text stays null and an empty one empty; ids play no part, so that null
    and repeated ones are like any other; an empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t if t is None else redacted_text(t, field) for t in b.column("text").to_pylist()]
            cols = dict(zip(b.schema.names, b.columns))
            cols["text"] = pa.array(texts, b.schema.field("text").type)
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([n if t is None else len(t) for n, t in zip(cols["n_chars"].to_pylist(), texts)], b.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return docs.mapInArrow(run, docs.schema)


def op3_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    found = find(docs, fit(docs))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
