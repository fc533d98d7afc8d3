import re

from hypothesis import given, settings
from hypothesis import strategies as st

from pitchlake.llm import pii


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def brute(t):
    s = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    s += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    s += [(2, m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    s += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(s)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab9410.@+-() é%\n", max_size=60))
def test_base_patterns(t):
    assert sorted(pii.base_spans(t)) == brute(t)


def test_examples():
    for t in ("4111 1111 1111 1111", "a@b.co@c.de, x@@y.z", "1.2.3.4.5.6.7.8 300.1.1.1 00255.1.1.1", "+49 (30) 1234-5678 +1 2", "é😀 me@x.org", "9" * 4000, "a" * 4000 + "@"):
        assert sorted(pii.base_spans(t)) == brute(t)


def test_contexts_find_unseen_identifiers(make):
    rows = [(i, f"please contact member{i}@mail.org today about row {i % 3}") for i in range(30)]
    rows += [(100, "é please contact XK-4471-Q today about it"), (101, "order ZZ-9917-P was shipped yesterday"), (102, None), (103, "")]
    got = {r["doc_id"]: r for r in pii.scan(make(rows)).collect()}
    found = lambda i: [(s["kind"], s["start"], s["end"]) for s in got[i]["spans"]]
    assert found(100) == [(4, 17, 26)] and found(101) == [] and found(102) == [] == found(103)
    assert all(len(found(i)) == 1 for i in range(30)) and len(got) == 34


def context_spans(rows):
    """Kind-context spans by the rules, with words and patterns as plain strings and no bit fields."""
    word, token = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"""[^\x20\x09-\x0D,;:=!?"'()<>\[\]{}|]+""")
    fold = lambda x: re.sub("[0-9]+", "0", x.lower())
    mentions, base_of = [], []
    for i, (_, t) in enumerate(rows):
        t = t or ""
        words = [m.span() for m in word.finditer(t)]
        base = brute(t)
        base_of.append(base)
        spans = [(a, b, True) for _, a, b in base]
        for lo, hi in words:
            for m in token.finditer(t, lo, hi):
                a, b = m.start(), m.start() + len(m[0].rstrip(".-"))
                if a < b and not any(x < b and a < y for _, x, y in base):
                    spans.append((a, b, False))
        for a, b, seed in spans:
            at, to = max(k for k, w in enumerate(words) if w[0] <= a), max(k for k, w in enumerate(words) if w[0] <= b - 1)
            say = lambda k: "^" if k < 0 else "$" if k >= len(words) else fold(t[slice(*words[k])])  # noqa: B023, E731
            pre, post = fold(t[words[at][0] : a]), fold(t[b : words[to][1]])
            for p in ((1, say(at - 2), say(at - 1), pre), (2, say(at - 1), pre, post, say(to + 1))):
                mentions.append((i, a, b, seed, t[a:b].lower(), p))
    support = {}
    for *_, seed, value, p in mentions:
        if seed:
            support.setdefault(p, set()).add(value)
    opened = {p for p, v in support.items() if len(v) >= pii.LEAST_SEEDS}
    edges = {(p, v) for *_, v, p in mentions if p in opened}
    known = {v for *_, seed, v, p in mentions if seed and p in opened}
    score = {v: float(v in known) for _, v in edges}
    for r in range(pii.ROUNDS):
        of = {p: [v for q, v in edges if q == p] for p in opened}
        confidence = {p: sum(score[v] for v in vs) / (len(vs) + pii.SHRINK) for p, vs in of.items()}
        if r < pii.ROUNDS - 1:
            for v in score:
                if v not in known:
                    doubt = 1.0
                    for p in [p for p, x in edges if x == v]:
                        doubt *= max(1e-6, 1 - confidence[p])
                    score[v] = 1 - doubt
    passed = {p for p, c in confidence.items() if c >= pii.LEAST_CONFIDENCE}
    return [sorted({(a, b) for i, a, b, seed, _, p in mentions if i == k and not seed and p in passed}) for k in range(len(rows))]


def test_bootstrap_against_brute_force(make):
    import random

    rng = random.Random(6)
    words = ["alpha", "beta", "gamma", "mail", "call", "to", "id", "42", "(see"]
    value = lambda: rng.choice([f"u{rng.randrange(9)}@x.org", f"10.0.0.{rng.randrange(9)}", "maria_k", "Zed", f"X-{rng.randrange(5)}.", "z" * 100])
    rows = [(i, " ".join(rng.choice(words) if rng.random() < 0.6 else rng.choice(["", "id=", "("]) + value() + rng.choice(["", ",", ")"]) for _ in range(rng.randrange(40)))) for i in range(60)]
    rows += [(100 + i, f"write to user{i}@mail.org now") for i in range(6)] + [(200, "please write to maria_k now"), (201, f"write to {'q7' * 50}. now"), (202, "write to"), (203, None)]
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == 4] for r in pii.scan(make(rows)).collect()}
    want = context_spans(rows)
    assert [got[i] for i, _ in rows] == want
    assert got[200] == [(16, 23)] and got[201] == [(9, 109)] and sum(map(len, want)) > 10


def test_fields_grow_with_their_numbers(spark):
    """Far more numbers than the least field has bits: all are found, few others are."""
    import numpy as np
    from pyspark.sql import functions as F

    rows = spark.range(60_000).select(F.xxhash64("id").alias("n"))
    f = pii.field(rows, "n")
    inside = np.array([r["n"] for r in rows.collect()], "i8").view("u8")
    others = np.random.default_rng(2).integers(0, 1 << 63, 100_000, dtype="u8")
    assert f.bits == 20 and f.holds(inside).all() and f.holds(others).mean() < 0.01
    assert all(int(x) in f for x in inside[:500]) and [int(x) in f for x in others[:500]] == f.holds(others[:500]).tolist()
    assert not pii.field(rows.where("false"), "n").words.any()


def test_saturated_fields_change_nothing(make, monkeypatch):
    """With fields far too small every token is looked at, and the spans stay."""
    rows = [(i, f"please contact member{i}@mail.org today about row {i % 3}") for i in range(30)] + [(100, "please contact XK-4471-Q today about it"), (101, "order ZZ-9917-P was shipped")]
    spans = lambda: sorted((r["doc_id"], str(r["spans"])) for r in pii.scan(make(rows)).collect())
    usual = spans()
    full = lambda numbers, column: pii.Field(12, np.full(64, 2**64 - 1, "u8"))
    import numpy as np

    monkeypatch.setattr(pii, "field", full)
    assert spans() == usual


def test_no_documents_and_repeated_rows(make):
    assert pii.scan(make([])).count() == 0
    rows = pii.scan(make([(1, "a@b.cc"), (1, "a@b.cc"), (None, "a@b.cc")])).collect()
    assert [len(r["base"]) for r in rows] == [1, 1, 1]


def frequent_contexts(n):
    """Texts of few words, so that most pairs of words are open patterns that hold many tokens."""
    import random

    rng = random.Random(11)
    words = ["of", "the", "Straße", "naïve", "x1", "😀", "(see", "it's", "a.b-c.", "Σας", "end\n", '"q"'] + [f"w{i}" for i in range(9)]
    word = lambda: rng.choice(words[: 1 + rng.randrange(len(words))])
    seed = lambda: rng.choice(["u{}@x.org", "10.0.0.{}", "<m{}@y.de>,", "+49 30 12345{}"]).format(rng.randrange(9))
    return [(i, " ".join(seed() if rng.random() < 0.1 else word() for _ in range(rng.randrange(60)))) for i in range(n)] + [(n, None), (n, ""), (None, " \n"), (n, "of the u1@x.org")]


def test_frequent_contexts_send_no_token_as_a_row(make, monkeypatch):
    """Whether edges go in one piece or in many, the spans are those of a row for each mention; no plan explodes mentions or joins them."""
    rows = frequent_contexts(300)
    spans = lambda: sorted((str(r["doc_id"]), [tuple(s) for s in r["base"]], [tuple(s) for s in r["spans"]]) for r in pii.scan(make(rows)).collect())
    found = pii.scan(make(rows))
    plan = found._jdf.queryExecution().toString()
    assert "Generate" not in plan and "Join" not in plan
    usual = spans()
    more = [s for _, _, all_ in usual for s in all_ if s[0] == 4]
    assert len(more) > 1000
    for _, base, all_ in usual:
        assert all_[: len(base)] == base and all_[len(base) :] == sorted(set(all_[len(base) :]))
    for name, value in (("MOST_EDGES", 20), ("GATHERED_BYTES", 300), ("RANGE_BYTES", 500)):
        monkeypatch.setattr(pii, name, value)
    assert spans() == usual
    monkeypatch.setattr(pii, "MOST_OPEN", 1)
    assert spans() == usual


def test_few_open_patterns_many_tokens_few_rows(make):
    """Ten times the tokens of the same patterns are not more rows between tasks."""
    import numpy as np

    n = lambda k: [(i, " ".join(f"of the v{i}-{j}" for j in range(k))) for i in range(20)]
    context = pii.Context("of the x now")
    one, *both = context.patterns(7, 8)
    slots = pii.Slots(np.array(both, "u8"), np.array([one] * 2, "u8"))
    few, many = (pii.edges(make(n(k)), slots, 4).collect() for k in (5, 50))
    assert len(few) == len(many) == 4
    assert sum(r["n"] for r in many) == 20 * 50
