import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from octetloom.llm import pii

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]
DOCS = "doc_id long, text string, n_chars long, spans string"


def plain(text):
    out = []
    for kind, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == 2:
                d = [int(c) for c in digits][::-1]
                if not 12 <= len(d) <= 19 or sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10:
                    continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["a", "Z.", "@", "@@", "x@y.z", ".", "..", "1", "25", "255", "300", "1.2.3.4", "0001.2.3.4", "4111 1111 1111 1111", "-", " ", "  ", "+", "+49 (30) 1234-5678", "(", "é", "%", "٣", "\n"]), max_size=14).map("".join))
def test_base_is_what_the_patterns_say(text):
    assert pii.base_spans(text) == plain(text)


def test_base_takes_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 150_000, "a@" * 150_000, "+1" + "(" * 200_000):
        assert all(e > s for s, _, e in pii.base_spans(text))


def by_enumeration(field, x, near, linked, known):
    """Marginals of the tokens by summing over all labellings of tokens and nodes."""
    n, k = len(x), len(linked.nodes)
    want, own = np.zeros((n, 5)), x @ field.unary
    for y in itertools.product(*([c] if c else range(5) for c in known), *([range(5)] * k)):
        w = sum(own[i, y[i]] for i in range(n) if not known[i]) + sum(field.chain[y[i], y[j]] for i, j in near)
        w += sum(field.equal[y[i]] * (y[i] == y[n + j]) for j, at in enumerate(linked.nodes) for i in at)
        w += sum(field.similar[y[n + i]] * (y[n + i] == y[n + j]) for i, j in linked.similar)
        for i in range(n):
            want[i, y[i]] += np.exp(w)
    return want / want.sum(axis=1, keepdims=True)


@pytest.mark.parametrize(
    "near,nodes,similar,known,most",
    [
        ([(0, 1), (1, 2)], [[2, 3]], [], [0, 0, 0, 2], 1e-3),  # a tree: exact
        ([(0, 1)], [[1, 2], [3]], [(0, 1)], [0, 0, 0, 3], 1e-3),  # over a similar thing, a tree
        ([(0, 1), (2, 3)], [[0, 1, 2, 3]], [], [0, 0, 4, 4], 0.03),  # neighbours on one node: loops
        ([(0, 1), (1, 2)], [[0, 3], [2, 3]], [(0, 1)], [0, 0, 0, 1], 0.03),
    ],
)
def test_messages_against_enumeration(near, nodes, similar, known, most):
    for seed in range(8):
        rng = np.random.default_rng(seed)
        field = pii.Field(rng.normal(size=(pii.N_FEATURES, 5)), rng.normal(size=(5, 5)) / 2, np.array([0, 2, 1, 3, 2.0]), np.array([0, 1, 1, 2, 1.0]))
        x = (rng.random((4, pii.N_FEATURES)) < 0.1).astype(float)
        linked = pii.Links(nodes, similar)
        got = field.marginals(x, np.array(near), linked, np.array(known))
        assert np.abs(got - by_enumeration(field, x, near, linked, known)).max() < most


def corpus():
    rng = random.Random(5)
    words = ["lorem", "ipsum", "12", "2024", "dolor", "v1.2", "sit", "x7", "100", "amet"]
    for i in range(300):
        ws = rng.choices(words, k=40)
        if i % 3 == 0:
            ws[5:5] = [f"me{i}@mail.example.com", "tel:", f"+1 (415) 555-{1000 + i}", "host", f"10.0.{i % 200}.7"]
        yield i, " ".join(ws)


TWINS = [
    ("mail joe.9@x.example.org now or +1 (415) 555-1234 then later ring 1 (415) 555-1234 again and pay 12 on 2024", [("phone", "1 (415) 555-1234")]),
    ("+1 202 555 0143 is mine, call 1-202-555-0143", [("phone", "1-202-555-0143")]),
    ("write bob@mail.example.com aka bob(at)mail.example.com", [("email", "bob(at)mail.example.com")]),
    ("call 1-202-555-0143 or 1-202-555-0143 or 1-202-555-0143", []),
    ("a 12345678901 b 12345678901 c 12345678901 d 12345678901", []),
]


def test_twins_take_the_label_and_clean_texts_none(spark):
    docs = spark.createDataFrame([(i, t, len(t), None) for i, t in corpus()], DOCS).repartition(3)
    field = pii.fit(docs)
    found = {r.doc_id: r for r in pii.find(docs, field).collect()}
    for i, t in corpus():
        r = found[i]
        base = plain(t)
        assert r.base == ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in base) for j in range(4)]
        assert set(r.base.split(",")) <= set(r.spans.split(","))
        assert i % 3 == 0 or r.spans == r.base
    for text, want in TWINS:
        base = pii.base_spans(text)
        assert [(pii.KINDS[k], text[a:b]) for a, k, b in field.extra(text, base)] == want, text
    out = pii.redacted(docs, field)
    assert out.columns == docs.columns
    texts = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert all("@" not in t and n == len(t) for t, n in texts.values()) and len(texts) == 300
    assert texts[1][0] == dict(corpus())[1]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None), (None, "", 0, "x"), (2, "a@b.cd", 6, None), (2, "a@b.cd", 6, None), (3, "1 " * 60_000, 1, None)], DOCS)
    field = pii.fit(docs)
    got = sorted((str(r.doc_id), r.n_email, r.base) for r in pii.find(docs, field).collect())
    assert got == [("1", 0, ""), ("2", 1, "email:0:6"), ("2", 1, "email:0:6"), ("3", 0, ""), ("None", 0, "")]
    assert pii.find(docs.where("false"), pii.fit(docs.where("false"))).count() == 0
    assert sorted(str(r.text)[:7] for r in pii.redacted(docs, field).collect()) == ["", "1 1 1 1", "<EMAIL>", "<EMAIL>", "None"]


def spread_field():
    """A field in which only twins and neighbours say that a number is a phone."""
    unary = np.zeros((pii.N_FEATURES, 5))
    unary[0, 0] = 5.0
    return pii.Field(unary, np.diag([0.0, 0.5, 0.5, 0.5, 0.5]), np.array([0.0] + [10.0] * 4), np.array([0.0] + [10.0] * 4))


def test_evidence_reaches_every_occurrence():
    filler = " lorem ipsum dolor sit "
    text = "ring +1 415 555 1234 now" + filler + filler.join(["1 415 555 1234"] * 90) + filler + "on 2024 pay 777 8888"
    extra = spread_field().extra(text, pii.base_spans(text))
    assert [text[s:e] for s, k, e in extra if k == 3] == ["1 415 555 1234"] * 90 and all(k == 3 for _, k, _ in extra)


def test_other_spellings_of_a_number_take_its_label():
    for twin in ("415-555-1234", "4155551234", "(415) 555-1234", "415 555 1234", "415.555.1234", "1 (415) 555 1234", "1 415 555 1243"[:-2] + "35"):
        text = f"ring +1 415 555 1234 now, or later {twin} again on 2024 or 7778888 or 777-8888"
        assert [text[s:e] for s, k, e in spread_field().extra(text, pii.base_spans(text))] == [twin], twin
    inside = "ring +1 415 555 1234 now, or later 1-415-555-1234 19 times"
    assert [inside[s:e] for s, k, e in spread_field().extra(inside, pii.base_spans(inside))] == ["1-415-555-1234"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "4111111111111111", "4111.1111.1111.1112", "a@b.cd", "a(at)b.cd", "+1 415 555 1234", "415-555-1234", "12", "x", "1.2.3.4", "1-2-3-4", "1234567", "123456789012", "\n"]), max_size=12).map(" ".join))
def test_links_start_from_finds_and_hold_no_found_token_twice(text):
    toks, base = pii.tokens(text), pii.base_spans(text)
    linked, known = pii.skip_links(text, toks, base), pii.evidence(toks, base)
    assert all(0 <= i < len(toks) for at in linked.nodes for i in at)
    sure = [any(known[i] for i in at) for at in linked.nodes]
    assert all(s or any(a == n and sure[b] for a, b in linked.similar) for n, s in enumerate(sure))
    free = [i for at in linked.nodes for i in at if not known[i]]
    assert len(free) == len(set(free))
    assert pii.skip_links(text, toks, base, set(range(len(toks)))) == pii.Links([], [])


def test_planted_twins_are_found_and_copies_without_a_find_are_not(spark):
    docs = spark.createDataFrame([(i, t, len(t), None) for i, t in corpus()], DOCS)
    field = pii.fit(docs)
    rng, hit, planted, false = random.Random(8), 0, 0, 0
    for i, t in list(corpus())[::3]:
        d = f"1415555{1000 + i}"
        twin = rng.choice([d, d[1:], f"1-415-555-{1000 + i}", f"415.555.{1000 + i}", f"(415) 555 {1000 + i}", f"me{i}(at)mail.example.com", f"ME{i}[at]mail.example.com"])
        text = f"{t} later {twin} was said"
        got = {text[a:b] for a, _, b in field.extra(text, pii.base_spans(text))}
        hit, planted, false = hit + (twin in got), planted + 1, false + len(got - {twin})
    assert hit >= 0.9 * planted and false <= 0.02 * planted
    for n in ("4111111111111112", "12345678901", "4111 1111 1111 1112", "1.2.3.400", "me@", "555-0143-77"):
        for words in (" lorem ", " card ", " tel: ", ", "):
            text = words + words.join([n] * 5)
            assert field.extra(text, pii.base_spans(text)) == []


def linked_things(text):
    """The pairs of similar things (as their tokens' text), by way of nodes between them too."""
    toks, base = pii.tokens(text), pii.base_spans(text)
    linked = pii.skip_links(text, toks, base)
    known = pii.evidence(toks, base)
    name = lambda n: text[toks[min(linked.nodes[n])][0] : toks[max(i for i in linked.nodes[n] if bool(known[i]) == bool(known[min(linked.nodes[n])]))][1]]
    into: dict = {}
    for a, b in linked.similar:
        into.setdefault(a, []).append(b)
    return {(name(a), name(f)) for a, bs in into.items() if linked.nodes[a] for b in bs for f in ([b] if linked.nodes[b] else into[b])}, linked


def test_a_thing_is_linked_to_every_similar_find():
    some = "ring +14155551234 or +14155551235 now, and later 14155551236 was said"
    assert linked_things(some)[0] == {("14155551236", "+14155551234"), ("14155551236", "+14155551235")}
    long = "a" * 60 + "@" + "b" * 60 + ".example"
    typo = long.replace("@", "(at)")[:-2] + "xe"
    assert linked_things(f"write to {long} or later to {typo} again")[0] == {(typo, long)}
    # Two misspelt numbers next to each other are two things.
    two = "ring +14155551234 now, and later 14155551236 14155551237 was said"
    assert linked_things(two)[0] == {("14155551236", "+14155551234"), ("14155551237", "+14155551234")}


def test_many_things_and_many_finds_share_one_node():
    finds = [f"+{i}415555123" for i in range(1000, 1300)]
    twins = [t for t in (f"00{i}415555123" for i in range(5000, 5300)) if not pii.luhn(t)]
    text = " was said. ".join(finds + twins) + " x"
    pairs, linked = linked_things(text)
    assert {(t, f) for t in twins for f in finds} <= pairs
    assert len(linked.similar) < 20 * 600
