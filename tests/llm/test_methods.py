"""The methods against brute force, round trips and held-out data."""

import collections
import itertools
import math
import random
import re

import numpy as np
import pytest

from frameloom.llm import decontaminate, html_text, langid, lm_scoring, mixing, ngram_jaccard, pii, secret_scan

WORD = re.compile("[^\x20\x09-\x0d]+")


def sentence(rng, n, vocabulary=40):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def test_quotas_are_those_of_highest_quotients(spark):
    rng = random.Random(1)
    held = [(shard, f"s{k}", k, 10_000, rng.choice((0.0, rng.random() * 60, rng.random() * 3000))) for shard in range(40) for k in range(rng.randint(1, 25))]
    got = {(r.shard, r.skey): r.quota for r in mixing.quotas(spark.createDataFrame(held, "shard long, skey string, source_no int, tokens long, wish double"), 16).collect()}
    for shard, own in itertools.groupby(held, key=lambda r: r[0]):
        own = list(own)
        seats = math.floor(sum(r[4] for r in own) / 16 + 0.5)
        quota = collections.Counter()
        for _ in range(seats):
            quota[max(own, key=lambda r: (r[4] / (2 * quota[r[1]] + 1), -r[2]))[1]] += 1
        assert all(got[shard, r[1]] == quota[r[1]] for r in own)


def test_jaccard_components(spark):
    rng = random.Random(2)
    texts = []
    for _ in range(40):
        base = sentence(rng, rng.choice((3, 5, 30, 120))).split()
        for _ in range(rng.choice((1, 1, 3, 8))):
            copy = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 4))):
                copy[rng.randrange(len(copy))] = f"W{rng.randrange(40)}"
            texts.append(" ".join(copy))
    common = sentence(rng, 50)
    texts += [f"{common} {sentence(rng, 4)}" for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    out = {r.doc_id: r for r in ngram_jaccard.near_classes(docs, n_words=4, percent=85, block_bytes=4000).collect()}
    sets = []
    for t in texts:
        w = WORD.findall(t.lower())
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} or {tuple(w)})
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    assert all(out[i].component_id == find(i) and out[i].n_shingles == len(s) for i, s in enumerate(sets))
    assert len({find(i) for i in range(len(sets))}) < len(sets)


def test_rtree_finds_all_that_the_bound_allows(spark):
    rng = np.random.default_rng(3)
    base = rng.poisson(3, (40, ngram_jaccard.GROUPS))
    points = np.maximum(0, np.repeat(base, 10, 0) + rng.integers(-1, 2, (400, ngram_jaccard.GROUPS)) * (rng.random((400, ngram_jaccard.GROUPS)) < 0.2))
    sizes, comps = points.sum(1), rng.integers(0, 300, 400)
    tokens = [sorted({int(t) for t in rng.integers(0, 3, rng.integers(1, 3))} | ({9} if i % 2 else {i % 10 + 20})) for i in range(400)]
    name = lambda v: b"%06d" % v
    rows = [(t, int(sizes[i]), name(i), int(sizes[i]), name(comps[i]), points[i].astype(np.uint32).tobytes(), tokens[i]) for i in range(400) for t in tokens[i]]
    entries = spark.createDataFrame(rows, "token long, place long, digest binary, n long, comp binary, point binary, prefix array<long>").repartition(5)
    want = set()
    for i in range(400):
        for j in np.flatnonzero((comps != comps[i]) & ngram_jaccard.may_link(points, sizes, points[i], int(sizes[i]), 85)):
            if i < j and set(tokens[i]) & set(tokens[j]):
                want.add((i, int(j)))
    for leaf, fan in ((32, 16), (4, 3)):
        got = [tuple(sorted((int(r.a), int(r.b)))) for r in ngram_jaccard._candidates(entries, 85, leaf, fan).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert len(want) > 100


def test_tree_edges_reach_every_entry_and_stay_few(spark):
    rows = [(t, i, b"%05d" % i) for t, k in ((1, 700), (2, 3), (3, 65)) for i in range(k)]
    entries = spark.createDataFrame(rows, "token long, place long, digest binary").repartition(5)
    edges = [(bytes(r.a), bytes(r.b)) for r in ngram_jaccard._edges(entries, 8).collect() if r.before < r.b]
    assert len(edges) == 699 + 2 + 64 and {b for _, b in edges} | {b"00000"} == {b"%05d" % i for i in range(700)}


def test_language_model_accuracy_on_held_out_text():
    rng = random.Random(4)
    parts = {"aa": ("the", "ing", "ou", "sh"), "bb": ("der", "ung", "ü", "sch"), "cc": ("ción", "ñ", "rr", "mente")}
    make = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    langs = sorted(parts)
    x, y = [], []
    for i in range(300):
        raw = langid.folded(np.frombuffer(make(langs[i % 3], 80).encode(), np.uint8))[:259]
        x.append(np.pad(raw, (0, 259 - len(raw))))
        y.append(i % 3)
    model = langid.train(np.array(x), np.array(y), langs, epochs=6)
    import pyarrow as pa

    texts = [make(langs[i % 3], rng.choice((3, 40, 900))) for i in range(150)]
    pred, score = langid.predict(model, pa.array(texts))
    assert np.mean([p == langs[i % 3] for i, p in enumerate(pred)]) > 0.97 and score.max() <= 1
    i = 5  # the tables of byte pairs give what the filters give
    buf = np.zeros(256 + 3, np.uint8)
    own = langid.folded(np.frombuffer(texts[i].encode(), np.uint8))[:256]
    buf[: len(own)] = own
    h = np.concatenate([sum(t[j][buf[j : j + 256]] for j in range(len(t))).max(0) for t in model.tables]) + model.bias
    assert np.allclose(h, (model.pairs()[0][buf[:256].astype(int) * 256 + buf[1:257]] + model.pairs()[1][buf[2:258].astype(int) * 256 + buf[3:259]]).max(0), atol=1e-4)


def test_lm_scores(spark):
    rng = random.Random(5)
    texts = [sentence(rng, rng.choice((0, 1, 5, 60))) for _ in range(80)]
    train = [i % 5 != 0 for i in range(80)]
    docs = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(zip(texts, train))], "doc_id long, text string, train boolean").repartition(4)
    for order, fan_bits in ((2, 10), (3, 2), (4, 1)):
        mu = (10.0, 4.0, 2.0)
        out = {r.doc_id: r for r in lm_scoring.score(docs, order=order, mu=mu, block_bytes=2000, fan_bits=fan_bits, segment=7).collect()}
        toks = [[*WORD.findall(t), None] for t in texts]
        grams = [collections.Counter() for _ in range(order + 1)]
        for t, k in zip(toks, train):
            padded = [None, *t]
            for o in range(1, order + 1):
                if k:
                    grams[o].update(tuple(padded[i - o + 1 : i + 1]) for i in range(1, len(padded)) if i - o + 1 >= 0)
        total, v = sum(grams[1].values()), len(grams[1])

        def p(history, w):
            if not history:
                return (grams[1][(w,)] + 0.5) / (total + 0.5 * (v + 1))
            before = grams[len(history)][history]
            m = mu[len(history) - 1]  # noqa: B023
            return (grams[len(history) + 1][(*history, w)] + m * p(history[1:], w)) / (before + m)

        for i, t in enumerate(toks):
            padded = [None, *t]
            want = sum(math.log10(p(tuple(padded[max(0, j - order + 1) : j]), padded[j])) for j in range(1, len(padded)))
            base = sum(math.log10(p((), w)) for w in t)
            assert out[i].base_score == pytest.approx(base) and out[i].score == pytest.approx(want) and out[i].n_tokens == len(t)


def test_edit_matching_is_exact():
    rng = random.Random(6)

    def brute(item, text):
        row = [0] * (len(text) + 1)
        for i, a in enumerate(item, 1):
            diagonal, row[0] = row[0], i
            for j, b in enumerate(text, 1):
                diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (a != b))
        return min(row)

    items = [(i, "".join(rng.choice("abc ") for _ in range(rng.randint(20, 90))).strip()) for i in range(8)]
    matcher = decontaminate.Matcher(items, 0.1)
    hits = 0
    for _ in range(60):
        _, item = rng.choice(items)
        edited = list(item)
        for _ in range(rng.randint(0, len(item) // 7)):
            at = rng.randrange(len(edited))
            edited[at : at + 1] = rng.choice(("", "x", edited[at] + "y"))
        text = decontaminate.normal("zzz " + "".join(rng.choice("abc ") for _ in range(30)) + "".join(edited) + " zz")
        want = {i: brute(decontaminate.normal(t), text) for i, t in items}
        want = {i: d for i, d in want.items() if d <= int(len(decontaminate.normal(dict(items)[i])) * 0.1)}
        assert {i: d for i, d, _ in matcher.find(text)} == want
        hits += len(want)
    assert hits > 20


def test_main_text_on_held_out_pages():
    crf = html_text.trained()
    wrong = total = 0
    for found, labels in html_text.labelled_pages(100, seed=123):
        wrong += sum(a != bool(b) for a, b in zip(crf.decode(found), labels))
        total += len(labels)
    assert wrong / total < 0.02


def luhn(digits):
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(sum(divmod(2 * c, 10)) for c in d[1::2])) % 10 == 0


def test_pii_patterns_and_linked_mentions():
    rng = random.Random(7)
    alphabet = ["1", "23", ".", "-", " ", "+", "@", "a", "b.c", "4111", "(", "255", "é"]
    for _ in range(3000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        want = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        want += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            digits = re.sub("[^0-9]", "", m[0])
            want += [(m.start(), m.end(), "card")] if 14 <= len(digits) <= 19 and luhn(digits) else []
        want += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        assert pii.base_spans(t) == sorted(want, key=lambda s: (s[0], pii.KINDS.index(s[2]))), t
    crf = pii.trained()
    text = "call +1 555 123 4567 at noon, or later 1-555-123-4567 and (555) 123-4567; order 5559988776"
    spans = pii.all_spans(text, pii.base_spans(text), crf, 0.9)
    assert [text[s:e] for s, e, _ in spans] == ["+1 555 123 4567", "1-555-123-4567", "(555) 123-4567"]
    right = total = 0
    for feats, masks, labels, links in pii.labelled_documents(100, seed=99):
        right += (crf.marginals(feats, masks, links).argmax(1) == np.array(labels)).sum()
        total += len(labels)
    assert right / total > 0.93


def test_secret_patterns_and_random_strings():
    rng = random.Random(8)
    alphabet = ["password", "TOKEN", "api_key", "=", ": ", "'", '"', " ", "abc123", "AKIA", "ABCDEFGHIJKLMNOPQRST", "0123456789abcdef", "é", "ſ", "."]
    for _ in range(3000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12)))
        want = [(m.start(), m.end(), "assign") for m in re.finditer(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m[1]) >= 6]
        want += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert secret_scan.base_spans(t) == sorted(want, key=lambda s: (s[0], secret_scan.KINDS.index(s[2]))), t
    encoding = secret_scan._encoding(open(secret_scan.DEFAULT_VOCABULARY, "rb").read())
    text = "key Zx9Qv7Lk2Pt8Rm4Wd6Hs then internationalization2024 and some_long_variable_name_2 and 9b2f1c34-aaaa-4bbb-8ccc-1234567890ab"
    assert [text[s:e] for s, e, _ in secret_scan.random_strings(text, encoding, 2.0)] == ["Zx9Qv7Lk2Pt8Rm4Wd6Hs"]
