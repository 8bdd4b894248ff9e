import hashlib
import random
import re

import numpy as np
import pytest

from quarry.llm import pii
from quarry.llm.common import documents
from quarry.llm.tagger import Tagger


def patterns(x):
    """The contract's patterns as written."""
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        d = [int(c) for c in m[0] if c not in " -"][::-1]
        if 16 <= len(d) <= 19 and sum(d[::2] + [2 * c - 9 * (c > 4) for c in d[1::2]]) % 10 == 0:
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]


def test_base_spans_equal_the_patterns():
    rnd = random.Random(3)
    for signs, n in (("a1.@2+- (5)9.z_", 60), ("0123456789 -", 45), ("12.0+3() ", 40), ("ab@.1", 25)):
        for _ in range(3000):
            x = "".join(rnd.choice(signs) for _ in range(rnd.randrange(n)))
            assert pii.base_spans(x) == patterns(x), x


@pytest.mark.parametrize("text", ["1" * 200_000, "a" * 200_000 + "@", "1." * 50_000, "+" * 50_000 + "1", "a@" * 50_000, "1 " * 50_000])
def test_long_runs_are_linear(text):
    assert isinstance(pii.base_spans(text), list)


def test_gradient():
    t, rng = Tagger(6, 3, 4, 5), np.random.default_rng(0)
    for k in t.p:
        t.p[k] = t.p[k].astype(np.float64) + 0.1 * rng.standard_normal(t.p[k].shape)
    codes, tags = rng.integers(0, 6, (3, 7)), rng.integers(0, 3, (3, 7))
    _, grad = t.loss_and_gradient(codes, tags)
    for k, p in t.p.items():
        at = tuple(rng.integers(0, s) for s in p.shape)
        old, values = p[at], []
        for step in (1e-3, -1e-3):
            p[at] = old + step
            values.append(t.loss_and_gradient(codes, tags)[0])
        p[at] = old
        assert abs((values[0] - values[1]) / 2e-3 - grad[k][at]) < 1e-4 + 1e-3 * abs(grad[k][at])


def test_decoding_is_the_best_path():
    t, rng = Tagger(5, 3, 4, 4), np.random.default_rng(1)
    t.p = {k: rng.standard_normal(v.shape).astype(np.float32) for k, v in t.p.items()}
    e = rng.standard_normal((6, 3)).astype(np.float32)

    def score(path):
        return t.p["first"][path[0]] + t.p["last"][path[-1]] + sum(e[i, p] for i, p in enumerate(path)) + sum(t.p["pair"][a, b] for a, b in zip(path, path[1:]))

    paths = np.stack(np.meshgrid(*[range(3)] * 6, indexing="ij"), -1).reshape(-1, 6)
    assert score(t.decode(e)) == pytest.approx(max(score(p) for p in paths), abs=1e-5)


def test_documents(spark):
    docs = documents(spark, "/root/testdata/sf0.1")
    tagger = pii.fit(docs)
    rows = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.find(docs, tagger).collect():
        base = patterns(rows[r.doc_id])
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in sorted(base))
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in range(4)]
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))
    # Without the patterns the tagger finds nearly all of what they find, in windows it has mostly not seen.
    texts = list(rows.values())
    got, want = pii.added_spans(tagger, texts, [[] for _ in texts]), [pii.base_spans(t) for t in texts]
    right = sum(len(set(g) & set(w)) for g, w in zip(got, want))
    assert right >= 0.9 * sum(map(len, want)) and right >= 0.95 * sum(map(len, got))


def test_edge_cases(spark, edge, none):
    assert pii.fit(edge) is None and pii.fit(none) is None
    got = pii.find(edge, None).collect()
    assert len(got) == edge.count() and all(r.spans == "" and r.n_email == 0 for r in got)
    assert pii.find(none, None).count() == 0


def test_overlapping_windows_cover_a_stretch():
    for n in (1, 10, 63, 64, 65, 96, 97, 500):
        starts = pii.windows(0, n)
        assert starts[0] == 0 and starts[-1] + pii.WINDOW >= n and all(b - a == pii.STEP for a, b in zip(starts, starts[1:]))


def test_disguised_data_is_added(spark):
    """Ways of writing that the patterns miss; e-mail addresses in words are not learned well enough to be asked for here."""
    docs = documents(spark, "/root/testdata/sf0.1")
    tagger = pii.fit(docs)
    samples = {"host 10 . 0 . 0 . 1 is down": "10 . 0 . 0 . 1", "ip 192 [.] 168 [.] 0 [.] 12 ok": "192 [.] 168 [.] 0 [.] 12", "pay 4012/8888/8888/1881 now": "4012/8888/8888/1881", "call (030) 1234 5678 soon": "(030) 1234 5678"}
    clean = ["The 12 cats at home dot the floor", "On 2021-03-04 at 12:30 we met 1500 people"]
    texts = [*samples, *clean]
    assert not any(pii.base_spans(t) for t in texts)
    got = [{t[a:b] for _, a, b in own} for t, own in zip(texts, pii.added_spans(tagger, texts, [[] for _ in texts]))]
    assert sum(want in g for want, g in zip(samples.values(), got)) >= 3 and not any(got[len(samples) :])


def test_disguises_are_undone():
    rng = np.random.default_rng(0)
    for kind, plain in ((0, "jane.doe@mail.example.com"), (1, "10.20.30.40"), (2, "4111 1111 1111 1111"), (3, "+49 30 1234567")):
        assert all(pii.well_formed(pii.KINDS[kind], pii.disguise(kind, plain, rng)) for _ in range(60))
    assert not pii.well_formed("email", "meet at noon") and not pii.well_formed("ip", "1 . 2 . 3 . 400") and not pii.well_formed("card", "4111/1111/1111/1112") and not pii.well_formed("phone", "2021-03-04 12")
    text, tags = pii._disguised("x" * 10 + "10.20.30.40" + " y" * 10, [0] * 10 + [3] + [4] * 10 + [0] * 20, rng)
    marked = "".join(c for c, t in zip(text, tags) if t)
    assert len(text) == len(tags) and pii.well_formed("ip", marked) and marked != "10.20.30.40"


def test_every_span_that_can_be_accepted_lies_in_a_stretch():
    """Signs are in all of them, however long or widely spaced they are written."""
    fill = "quiet words without any of it, " * 20
    long = "a" * 200
    for kind, span in (
        ("email", "jane at example.com"), ("email", f"{long}@example.org"), ("email", "jane AT example . com"), ("email", "jane [  at  ] example [   dot   ] com"),
        ("email", "jane . m . doe at mail . example . org"), ("email", "jane" + " " * 90 + "at" + " " * 90 + "example.org"), ("ip", "10" + " " * 70 + "." + " " * 70 + "0.0.1"),
    ):
        assert pii.well_formed(kind, span)
        text = f"{fill}{span} {fill}"
        at = len(fill)
        assert any(a <= at and at + len(span) <= b for a, b in pii.stretches(text)), span
    found = pii.stretches(fill + "7 " + fill + "8" + fill)
    assert len(found) == 2 and all(b - a < 120 for a, b in found)
