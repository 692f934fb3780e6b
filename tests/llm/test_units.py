"""Operators' cores against brute force, without Spark."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from cuelake.llm import decontamination as dc
from cuelake.llm import html_extraction as he
from cuelake.llm import jaccard_join as jj
from cuelake.llm import language_id as li
from cuelake.llm import packing, quality_classifier, sharding, token_files, tokens, url_filter
from cuelake.llm.boosting import Trees


def test_wand_retrieves_what_brute_force_does():
    r = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    index = dc.Index([(i, " ".join(r.choice(words) for _ in range(r.randint(3, 30)))) for i in range(150)])
    index.weigh(np.array([r.randint(0, 500) for _ in index.terms], float), 1000)
    for _ in range(150):
        q = sorted(set(r.choice(index.entries)) - {r.randrange(60)} | {r.randrange(len(index.terms)) for _ in range(10)})
        score = [sum(index.weight[e].get(t, 0) for t in q) for e in range(len(index.entries))]
        got = index.wand(q)
        assert [e for e, _ in sorted(got)] == [e for e, s in enumerate(score) if s >= dc.THRESHOLD - 1e-9]
        assert all(abs(s - score[e]) < 1e-9 for e, s in got)
        flat = np.array([*q, -1, -1])
        zero, none = np.zeros(len(flat), int), np.full(len(flat), -1)
        assert not got or list(index.reaching(flat, zero, none)) == [0]


def test_hits_find_planted_items_and_near_copies_only():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(r.randint(15, 150)))) for i in range(20)]
    noise = lambda n: " ".join(word() for _ in range(n))
    near = items[3][1].split()
    near[5] = "changed"
    texts = [noise(300), noise(100) + " " + items[7][1].upper() + ". " + noise(500), None, "", noise(40) + " " + " ".join(near), items[0][1]]
    index = dc.Index([*items, (99, ""), (98, None)])
    counts, n = index.counts(texts)
    index.weigh(counts.astype(float), n)
    assert [[h[0] for h in x] for x in index.hits(texts)] == [[], [7], [], [], [3], [0]]
    assert dc.Index([]).hits(["a b c"]) == [[]]


def test_a_leak_of_a_long_item_needs_its_answer():
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    question, answer = [word() for _ in range(280)], [word() for _ in range(20)]
    item = " ".join(question) + ". " + " ".join(answer)
    noise = lambda n: " ".join(word() for _ in range(n))
    texts = [" ".join(question[:70]), noise(100) + " " + " ".join(question), noise(700) + " " + item + " " + noise(900), item, " ".join(answer), noise(90) + " " + " ".join(question[100:]) + " " + " ".join(answer)]
    index = dc.Index([(None, item), (-1, noise(40))])
    counts, n = index.counts(texts)
    index.weigh(counts.astype(float), n)
    assert [[h[0] for h in x] for x in index.hits(texts)] == [[], [], [None], [None], [], [None]]


def brute_hits(index: dc.Index, texts: list[str | None]) -> list[set]:
    """Every passage scored against every entry, term by term."""
    out = []
    for text in texts:
        ids = [index.terms.get(w, -1) for w in dc.words(text)]
        found = set()
        for start in range(0, max(1, len(ids) - dc.ENTRY), dc.ENTRY):
            passage = ids[start : start + 2 * dc.ENTRY]
            for e, weight in enumerate(index.weight):
                if sum(w for t, w in weight.items() if t in passage) >= dc.THRESHOLD - 1e-9:
                    reach = index.reach[index.item[e]]
                    around = ids[max(0, start - reach) : start + 2 * dc.ENTRY + reach]
                    seen = dc.runs(around) | dc.runs(around, 1) | dc.runs(around, 2)
                    if all(len(p & seen) >= dc.OVERLAP * len(p) for p in index.parts[index.item[e]]):
                        found.add(index.item[e])
        out.append(found)
    return out


def test_hits_are_those_of_brute_force():
    r = random.Random(13)
    vocabulary = [f"w{i}" for i in range(300)]
    some = lambda n: [vocabulary[int(300 * r.random() ** 3)] for _ in range(n)]
    items = [some(r.choice([3, 20, 50, 64, 65, 150, 400])) for _ in range(40)]
    texts: list = [None, "", " ".join(some(20_000))]
    for _ in range(40):
        w = list(r.choice(items))
        for _ in range(len(w) // r.choice([2, 4, 9, 99])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        a, b = sorted((r.randrange(len(w) + 1), len(w)))
        texts.append(" ".join(some(r.randrange(150)) + w[a if r.random() < 0.2 else 0 : b] + some(r.randrange(150))))
    index = dc.Index([(i, " ".join(w)) for i, w in enumerate(items)])
    counts, n = index.counts(texts)
    index.weigh(counts.astype(float), n)
    got = index.hits(texts)
    assert [{h[0] for h in x} for x in got] == brute_hits(index, texts) and sum(map(len, got)) > 15


@pytest.mark.parametrize("percent", [80, 85])
def test_bundle_join_is_exact(percent):
    r = random.Random(3)
    for _ in range(12):
        bases = [[r.randrange(10**6) for _ in range(r.choice([3, 20, 60]))] for _ in range(r.choice([1, 3]))]
        sets = []
        for _ in range(r.choice([30, 200])):
            b = list(r.choice(bases))
            for _ in range(r.randrange(0, len(b) // 6 + 2)):
                b[r.randrange(len(b))] = r.randrange(10**6)
            sets.append(np.unique(np.array(b, np.uint64)))
        u = jj.Union(len(sets))
        linked = []
        for a in range(len(sets)):
            for b in range(a):
                i = len(np.intersect1d(sets[a], sets[b]))
                if 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                    u.join(a, b)
                    linked.append((a, b))
        assert (u.roots() == jj.join_sets(sets, percent)).all()
        # regions keep every link together
        n, pos = np.array([len(s) for s in sets]), np.zeros(len(sets), int)
        g = jj.Union(len(sets))
        for a, b in jj.region_edges(np.arange(len(sets)), n, pos, [jj.parity(s) for s in sets], percent):
            g.join(a, b)
        roots = g.roots()
        assert all(roots[a] == roots[b] for a, b in linked)


def test_ngrams():
    assert len(jj.ngrams(None, 4)) == len(jj.ngrams(" \n", 4)) == 0
    assert (jj.ngrams("A b\tC", 4) == jj.ngrams("a B c", 4)).all() and len(jj.ngrams("a b c", 4)) == 1
    assert len(jj.ngrams("a b c d e f a b c d", 4)) == 6
    assert not (jj.ngrams("É a b c", 4) == jj.ngrams("é a b c", 4)).all()


def plain_differencing(sizes: list[int], k: int) -> list[int]:
    """Sorted sums by Karmarkar-Karp differencing, with whole lists searched at each step."""
    parts = [[0] * (k - 1) + [s] for s in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[0] - p[-1])
        a, b = parts.pop(0), parts.pop(0)
        parts.append(sorted(x + y for x, y in zip(a, b[::-1])))
    return parts[0]


def test_differencing():
    r = random.Random(4)
    sizes = [r.randint(1, 1000) for _ in range(500)]
    to, totals = sharding.differencing(sizes, 24)
    assert max(totals) - min(totals) <= 3
    assert [sum(s for s, t in zip(sizes, to) if t == k) for k in range(24)] == totals
    for k in (2, 3, 5):
        few = [round(1.7**i) for i in range(12)]  # no two spreads are equal, so there is one answer
        assert sharding.differencing(few, k)[1] == plain_differencing(few, k)
    parts = [sharding.differencing(sizes[i::5], 7)[1] for i in range(5)]
    to, totals = sharding.combine([*parts, [4], [9]], 7)
    assert all(sorted(x) == list(range(7)) for x in to[:5]) and max(totals) - min(totals) <= 9
    sums = [0.0] * 7
    for part, x in zip([*parts, [4], [9]], to):
        for y, t in zip(part, x):
            sums[t] += y
    assert sums == totals
    assert sharding.differencing([], 4)[0] == [] and sharding.combine([[3.0, 1.0]], 2)[1] == [1.0, 3.0]


def test_best_fit():
    r = random.Random(5)
    sizes = np.array([r.randint(1, 1023) for _ in range(2000)])
    bins = packing.best_fit(sizes, 1024)
    assert sorted(i for b in bins for i in b) == list(range(2000))
    assert all(sizes[b].sum() <= 1024 for b in bins) and len(bins) <= 1.01 * -(-sizes.sum() // 1024)
    assert packing.cut(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)] and packing.cut(1024, 1024) == [(0, 1024)] and packing.cut(2048, 1024) == [(0, 1024), (1024, 1024)]


def test_encoder_gives_the_librarys_ids(monkeypatch):
    e = tokens.Encoder(tokens.default_path())
    bits = ["a", "é", "  ", " ", "\n", " \n", "don't", "12", "!!", "\t", "　", "\x1c", "\x85", "​", " <|endoftext|>", "日本", "x y z", "Ġ", "\xa0", "\n\n", "\r\n", "\n ", ".\nFür", ","]
    for k in range(400):
        r = random.Random(k)
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 14)))
        assert e.encode([text, None]) == [e.whole(text).tobytes(), b""]
    texts = ["".join(random.Random(k).choice(bits) for _ in range(k % 40)) for k in range(400)]
    monkeypatch.setattr(tokens, "SLICE", 700)  # many slices
    monkeypatch.setattr(tokens, "KEEP", 300)  # and forgetting between them
    assert e.encode(texts) == [e.whole(t).tobytes() for t in texts] and e.encode([]) == []


def test_segment_round_trip_and_random_access():
    r = random.Random(6)
    docs = [np.array([r.choice([0, 5, 255, 256, 50_000, 2**20, 2**32 - 1]) for _ in range(r.randint(0, 900))], "<u4") for _ in range(9)]
    seg = token_files.Segment(token_files.write_segment([3, None, 5, 6, 6, 7, 8, 9, 10], [d.tobytes() for d in docs]))
    flat = np.concatenate(docs)
    assert (seg.tokens() == flat).all() and seg.valid.tolist() == [True, False] + [True] * 7
    assert all(seg.token(i) == flat[i] for i in range(len(flat)))
    assert all((seg.document(k) == d).all() and seg.document(k).dtype == np.dtype("<u4") for k, d in enumerate(docs))
    ends = sorted(r.randint(0, len(flat)) for _ in range(60))
    assert all((seg.span(a, b) == flat[a:b]).all() for a in ends for b in ends)
    two = [d.astype("<u2") for d in docs]
    assert (token_files.Segment(token_files.write_segment([None] * 9, [d.tobytes() for d in two], "<u2")).tokens() == np.concatenate(two)).all()
    with pytest.raises(IndexError):
        seg.token(len(flat))


def test_network_learns():
    texts = {"de": "der die und nicht schlich keit ung ", "en": "the and of tion ing with that ", "fr": "le la les eau ment que é è ou "}
    r = random.Random(7)
    make = lambda k: " ".join(r.choice(texts[k].split()) for _ in range(60))
    net = li.Network(sorted(texts))
    x, y = [], []
    for k in range(240):
        w = li.windows(make(sorted(texts)[k % 3]))
        x.append(w)
        y += [k % 3] * len(w)
    net.train(np.concatenate(x), np.array(y))
    assert all(net.predict([make(k)])[0][0] == k for k in texts for _ in range(10))
    assert net.predict([None, "", "123 !!", "x"])[:3] == [("und", 0.0)] * 3 and li.Network([]).predict(["a"]) == [("und", 0.0)]
    assert li.windows("a" * 300).shape == (3, li.WINDOW)


def test_classifier():
    r = random.Random(8)
    good = lambda: " ".join(r.choice("the cat sat on a mat and ran far".split()) for _ in range(30)) + "."
    bad = lambda: " | ".join(r.choice("cat mat WIN!! $$$ ###".split()) for _ in range(20))
    rows, labels = [], []
    for k in range(200):
        rows.append(quality_classifier.features(good() if k % 4 else bad()))
        labels.append(int(k % 4 > 0))
    m = quality_classifier.fit(rows, labels, 0.75)
    assert all(m.score(quality_classifier.features(good())) > 0.5 > m.score(quality_classifier.features(bad())) for _ in range(20))
    assert quality_classifier.fit(rows[1:3], [1, 1], 0.9).score(rows[0]) == pytest.approx(0.9)
    long = "x" * 39 + "A1b2" * 10
    assert quality_classifier.shape(long) == "a" + "A0a0" * 10 and quality_classifier.shape("aaB9" + "é" * 99 + "!!!!") == "aA0a!!"
    assert quality_classifier.features(None).tolist() == quality_classifier.features(" ").tolist() == [0]


def test_urls():
    assert url_filter.parts("http://A.Example.ORG/es/x?y#z") == ("a.example.org", "/es/x")
    assert url_filter.parts("x://host?q/://") == ("host", "") and url_filter.parts("nothing/here") == ("", "") == url_filter.parts(None)
    rules = url_filter.Rules(url_filter.RULES)
    assert rules.match("a.example.org", "/es/1") == ("example.org/es/", "block") and rules.match("a.example.org", "/en/2") == ("org/", "allow")
    assert rules.match("notorg", "/") == (None, None) == rules.match("x.org", "")
    m = url_filter.Models()
    good, bad = [f"http://news.site/{i}/article" for i in range(60)], [f"http://win.casino/{i}/bonus" for i in range(60)]
    m.add(good + bad, [0] * 60 + [1] * 60)
    d = m.differences(["http://news.site/99/article", "http://win.casino/99/bonus", None, ""])
    assert d[0] > 0 > d[1] and d[2] == d[3] == 0
    assert (url_filter.Models().differences(["a", None]) == 0).all()


def test_trees():
    r = np.random.default_rng(9)
    x = r.normal(size=(600, 5)).astype(np.float32)
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] > 0.5)
    assert (Trees(3).fit(x, y).probabilities(x).argmax(1) == y).mean() > 0.97


def test_decoding_is_consistent():
    r = np.random.default_rng(10)
    parent = [-1] + [int(r.integers(0, i)) for i in range(1, 60)]
    label = he.decode(parent, r.dirichlet([1, 1, 1], 60))
    assert all(label[p] == he.SOME or label[i] == label[p] for i, p in enumerate(parent) if i)


#: Layouts written by hand, with the text that a reader would take from them.
_ONE, _TWO = "The river rose in the night, and by morning the lower fields were under water.", "Nobody had seen such a flood since the old bridge was built, the miller said."
LAYOUTS = [
    ("<p>One only.</p>", "One only."),
    ("<div>Hello world, this is text. <p>And then there is more of it.</p></div>", "Hello world, this is text.\n\nAnd then there is more of it."),
    (f"<p title=don't>It's a start. {_ONE}</p><p data-x='a>b'>{_TWO}</p>", f"It's a start. {_ONE}\n\n{_TWO}"),
    (f"<html><body><svg><p>{_ONE}</p><button><p>{_TWO}</p></body></html>", f"{_ONE}\n\n{_TWO}"),
    (f"<html><body><header class=header><a href=/>Home</a></header><main><h1>Floods</h1><p>{_ONE} Here <math><mi>x</mi>=<mn>2</mn></math> metres.</p><p>{_TWO}</p></main><footer>&copy; 2020 Us</footer></body></html>", f"Floods\n\n{_ONE} Here x=2 metres.\n\n{_TWO}"),
    (f"<body><div class='sidebar'><ul><li><a href=1>News</a><li><a href=2>Sport</a></ul></div><article><h2>Floods</h2><p>{_ONE}<script>if (a<b) x('</p>')</script></p><blockquote><p>{_TWO}</p></blockquote></article><div id=comments><p>Great read, thanks!</p></div></body>", f"Floods\n\n{_ONE}\n\n{_TWO}"),
    ("<div>" * 3000 + f"<p>{_ONE}</p>" + "</div>" * 2000, _ONE),
    (f"<p>{_ONE}<script>var s = 1; <p>{_TWO}", _ONE),
]


def test_extraction():
    model = he.train()
    wrong = total = 0
    for k in range(120):
        page, article = he.training_page(9_000_000 + k)
        got = set(map(int, re.findall(r"q(\d+)q", he.extract_many([page], model)[0])))
        wrong, total = wrong + len(got ^ article), total + len(article)
    assert wrong < 0.08 * total
    for source, text in LAYOUTS:
        assert he.extract_many([source], model) == [text], source
    page = "<html><nav><a href=x>menu</a></nav><article><h1>T &amp; U</h1><p>One\n two<br>three, and  more words here.<p><b>Four five six.</article><footer>&copy; x"
    assert he.extract_many([None, "", page, "<p"], model) == ["", "", "T & U\n\nOne two three, and more words here.\n\nFour five six.", ""]
