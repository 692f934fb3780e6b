"""Fill-in-middle, whitening and MinHash near-dedup against plain versions, and on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuelake.llm import fill_in_middle as fim
from cuelake.llm import html_extraction, jaccard_join, language_id, minhash_dedup, queries, whitening
from cuelake.llm.common import Scratch

SF = "/root/testdata/sf0.001"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SIGNS = "ab<P>SM \t\n\x0b\x0c\r\x00\x1c\x85\xa0 　é你😀"


# ---- fill in the middle


@settings(max_examples=400, deadline=None)
@given(st.text(SIGNS, max_size=60))
def test_units_are_those_of_the_expression(text):
    raw, ends = text.encode(), fim.unit_ends(text.encode())
    units = UNIT.findall(text)
    assert ends.bit_count() == len(units)
    for rank in range(1, len(units) + 1):
        assert raw[: fim.select(ends, len(raw), rank) + 1].decode() == "".join(units[:rank])


def plain(text: str, doc_id: int, percent: int, spm: int) -> tuple:
    """The contract's words, one after the other."""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in fim.MARKS) or h3 % 100 >= percent:
        return text, "plain", len(units), None, None
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return f"<S>{suffix}<P>{prefix}<M>{middle}", "spm", len(units), len(prefix), len(middle)
    return f"<P>{prefix}<S>{suffix}<M>{middle}", "psm", len(units), len(prefix), len(middle)


@settings(max_examples=300, deadline=None)
@given(st.text(SIGNS, max_size=40), st.integers(0, 10**12))
def test_rearranged_as_said(text, doc_id):
    marks = tuple(m.encode() for m in fim.MARKS)
    got = fim.rearrange(text.encode(), doc_id, "42", 100, 60, marks)
    assert (got[0].decode(), *got[1:]) == plain(text, doc_id, 100, 60)


def test_fim_keeps_rows_and_restores(spark, monkeypatch):
    monkeypatch.setattr(fim, "BATCH", 50)
    r = random.Random(5)
    texts = [None, "", " \n\t", "one", "a<M>b c", "x" * 300_000, "　".join("wörter" * 3), *("".join(r.choices(SIGNS.replace("<", ""), k=r.randrange(90))) for _ in range(60))]
    rows = [(i, t, f"f{i}", i) for i, t in enumerate(texts)] + [(None, "a b c d", "z", 1), (8, texts[8], "again", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fim_form string, n int").repartition(2)
    out = fim.transform(docs, percent=80, spm_percent=50)
    assert out.columns == ["doc_id", "text", "fim_form", "n", "fim__output", "fim__form", "fim__n", "fim__prefix_chars", "fim__middle_chars"]
    got = out.withColumn("back", fim.restored(F.col("fim__output"), F.col("fim__form"))).collect()
    assert sorted(map(str, (x[:4] for x in got))) == sorted(str(tuple(x)) for x in rows)
    for x in got:
        assert x["back"] == (x["text"] or "")
        if x["doc_id"] is not None:
            assert tuple(x[4:9]) == plain(x["text"] or "", x["doc_id"], 80, 50)
    assert {x["fim__form"] for x in got} == {"plain", "psm", "spm"}
    assert fim.transform(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fim.transform(docs, marks=("<<", "<S>", "<M>"))


# ---- whitening


def test_residues_are_exact():
    r = np.random.default_rng(1)
    z = r.integers(-(2**40), 2**40, (9000, 3))
    moduli = whitening.primes(2 * 9000 * 2**80 + 1)
    assert all(p < 2**20 and all(p % q for q in range(2, math.isqrt(p) + 1)) for p in moduli)
    got = whitening.reconstruct(whitening.residue_scatter(z, moduli).astype(object), moduli)
    plain_z = z.astype(object)
    assert (got == plain_z.T @ plain_z).all()


def whitened_plainly(rows: list[tuple]) -> tuple:
    """n, deviations, covariance by fractions, of rows (id, entries)."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    n, dims = len(x), len(x[0])
    s = [sum(v[d] for v in x) for d in range(dims)]
    far = [sum((n * v[d] - s[d]) ** 2 for d in range(dims)) for v in x]
    centred = [[Fraction(v[d]) - Fraction(s[d], n) for d in range(dims)] for v in x]
    cov = np.array([[float(sum(v[a] * v[b] for v in centred) / n) for b in range(dims)] for a in range(dims)])
    return n, far, cov, np.array([[float(c) for c in v] for v in centred])


def test_op12_is_brute_force_over_the_table(spark):
    rows = [(r["vec_id"], [float(c) for c in r["embedding"]]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    n, far, cov, centred = whitened_plainly(rows)
    e, u = np.linalg.eigh(cov)
    got = queries.queries()["op12_whitening"](spark, SF).collect()
    assert len(got) == 8 * len(rows)
    by = {(r["vec_id"], r["component"]): r for r in got}
    for k in range(1, 9):
        want = centred @ u[:, -k] / math.sqrt(e[-k])
        have = np.array([by[i, k]["whitened"] for i, _ in rows])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-8
        assert {by[i, k]["n"] for i, _ in rows} == {n} and abs(by[rows[0][0], k]["explained"] - e[-k] / np.trace(cov)) < 1e-10
    assert [by[i, 1]["deviation"] for i, _ in rows] == far
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.5, -0.25, 3.0]), (2, [1.5, 0.75, -2.0]), (2, [1.5, 0.75, -2.0]), (None, [1e12, 1.0, 0.0]), (5, [0.0, 0.0, 0.0]), (6, [0.1, 0.2, 0.3])]
    bad = [(7, None), (8, [1.0, None, 2.0]), (9, [nan, 0.0, 0.0]), (10, [0.0, inf, 0.0]), (11, [1.0, 2.0]), (12, [])]
    schema = "vec_id long, embedding array<double>, white_whitened int"
    table = spark.createDataFrame([(*x, 0) for x in good + bad], schema).repartition(3)
    model = whitening.fit(table)
    n, far, cov, _ = whitened_plainly([(i, v) for i, v in good])
    assert model.n == n == 6 and np.allclose(model.components @ np.diag(model.variances) @ model.components.T, cov, rtol=1e-9, atol=1e-9 * cov.max())
    out = model.transform(table)
    assert out.columns == ["vec_id", "embedding", "white_whitened", "white__whitened", "white__deviation"]
    assert sorted((r["white__deviation"] is None, str(r["vec_id"]), r["white__deviation"]) for r in out.collect()) == sorted((v >= 1 << 63, str(i), None if v >= 1 << 63 else v) for (i, _), v in zip(good, far))
    same = spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(5)], schema)
    flat = whitening.fit(same)
    assert len(flat.variances) == 0 and flat.identity_error(same) == 0.0 and [r["white__deviation"] for r in flat.transform(same).collect()] == [0] * 5
    assert whitening.fit(table.limit(0)) is None and whitening.fit(spark.createDataFrame(bad[:3], "vec_id long, embedding array<double>")) is None
    assert whitening.fit(spark.createDataFrame([(1, [nan, 1.0])], "vec_id long, embedding array<double>")) is None


def test_op12_without_variance(spark, tmp_path):
    spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.queries()["op12_whitening"](spark, str(tmp_path)).collect() == []


# ---- MinHash


def test_match_threshold():
    chance = lambda t: sum(math.comb(64, i) * 0.8**i * 0.2 ** (64 - i) for i in range(t))
    t = minhash_dedup.match_threshold(64, 80)
    assert chance(t) <= minhash_dedup.MISS < chance(t + 1) and 25 < t < 45


def test_collisions_follow_the_similarity():
    """As many coordinates collide as independent permutations would give, in mean and spread."""
    r = np.random.default_rng(7)
    masks, factors = minhash_dedup.permutations(64)
    found = []
    for _ in range(400):
        both, one, two = (r.integers(0, 2**63, n, dtype=np.uint64) for n in (160, 20, 20))
        x, y = (minhash_dedup.minhashes(np.sort(np.concatenate([both, own])), masks, factors) for own in (one, two))
        found.append(int((x == y).sum()))
    assert abs(np.mean(found) - 51.2) < 0.8 and 2.4 < np.std(found) < 4.0 and min(found) >= minhash_dedup.match_threshold(64, 80)


def test_long_sets_are_hashed_in_pieces():
    s = np.unique(np.random.default_rng(2).integers(0, 2**63, 10_000, dtype=np.uint64))
    masks, factors = minhash_dedup.permutations(16)
    assert (minhash_dedup.minhashes(s, masks, factors) == [int(((s ^ m) * f).min()) >> 32 for m, f in zip(masks[:, 0], factors[:, 0])]).all()


def members(r: np.random.Generator, groups: int, size: int, coordinates: int) -> np.ndarray:
    """Codes in groups whose members differ from the group's first in some coordinates, groups sharing some."""
    out = []
    common = r.integers(0, 2**16, coordinates)
    for _ in range(groups):
        base = np.where(r.random(coordinates) < 0.3, common, r.integers(0, 2**16, coordinates))
        out += [np.where(r.random(coordinates) < 0.25, r.integers(0, 2**16, coordinates), base) for _ in range(size)]
    return np.array(out, np.uint32)[r.permutation(groups * size)]


@pytest.mark.parametrize("dense,long", [(256, 32), (0, 32), (0, 2), (0, 10**9)])
def test_merging_and_skipping_count_alike(monkeypatch, dense, long):
    monkeypatch.setattr(minhash_dedup, "DENSE", dense), monkeypatch.setattr(minhash_dedup, "LONG", long)
    r = np.random.default_rng(3)
    codes = members(r, 20, 25, 32)
    postings = minhash_dedup.Postings(codes)
    for x in r.integers(0, len(codes), 60):
        assert postings.collide(codes[x], 14).tolist() == np.flatnonzero((codes == codes[x]).sum(axis=1) >= 14).tolist()


@pytest.mark.parametrize("dense", [256, 4])
def test_a_list_is_cut_into_its_components(monkeypatch, dense):
    monkeypatch.setattr(minhash_dedup, "DENSE", dense)
    r = np.random.default_rng(4)
    codes, n = members(r, 12, 15, 32), r.integers(80, 120, 180)
    edges = minhash_dedup.cluster(codes, n, 80, 14)
    same = [[bool((codes[a] == codes[b]).sum() >= 14 and min(n[a], n[b]) * 100 >= 80 * max(n[a], n[b])) for b in range(180)] for a in range(180)]
    assert all(same[a][b] for a, b in edges) and len(edges) < 180

    def parts(pairs) -> list[int]:
        up = list(range(180))
        for _ in up:
            for a, b in pairs:
                up[a] = up[b] = min(up[a], up[b])
        return up

    assert parts(edges) == parts([(a, b) for a in range(180) for b in range(180) if same[a][b]])


def rows_of_all_kinds() -> list[tuple]:
    r = random.Random(9)
    words = ["".join(r.choices("abcdefg", k=r.randint(2, 6))) for _ in range(300)]
    base = [r.choices(words, k=n) for n in (60, 80, 1, 3, 4, 2500, 40)]
    texts = [None, "", " \n", *(" ".join(b) for b in base)]
    for b in base:
        for _ in range(6):
            c = list(b)
            for _ in range(r.randrange(1, 5)):
                c[r.randrange(len(c))] = r.choice(words)
            texts.append(" ".join(c).upper() if r.random() < 0.3 else " ".join(c))
    return [(i, t, 0.5) for i, t in enumerate(texts)] + [(None, texts[3], 0.1), (4, texts[4], None), (None, None, None)]


def plain_components(rows: list[tuple], k: int, percent: int) -> list[tuple]:
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    sets, up = [grams(r[1]) for r in rows], list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(a):
                if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    up[a] = up[b] = min(up[a], up[b])
    least = {u: min((rows[i][0] for i in range(len(rows)) if up[i] == u and rows[i][0] is not None), default=None) for u in up}
    return [(r[0], len(s), least[u]) for r, s, u in zip(rows, sets, up)]


@pytest.mark.parametrize("split", [10_000, 4])
def test_minhash_on_rows_of_all_kinds(spark, monkeypatch, split):
    monkeypatch.setattr(minhash_dedup, "SPLIT", split), monkeypatch.setattr(jaccard_join, "SPLIT", split)
    rows = rows_of_all_kinds()
    docs = spark.createDataFrame(rows, "doc_id long, text string, key double").repartition(3).withColumn("uid", F.monotonically_increasing_id())
    got = jaccard_join.classes(minhash_dedup.link(docs, 4, 80, Scratch(spark, "t"))).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, plain_components(rows, 4, 80)))


def test_minhash_filter_keeps_one_of_each(spark):
    rows = rows_of_all_kinds()
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, __uid double, sig string")
    kept = minhash_dedup.filter_documents(docs, k=4, percent=80)
    assert kept.columns == docs.columns
    groups = {(c if n else ("own", i, k)) for k, (i, n, c) in enumerate(plain_components(rows, 4, 80))}
    assert kept.count() == len(groups)
    assert minhash_dedup.filter_documents(docs.limit(0)).count() == 0


# ---- what the Jaccard join sends


def test_a_text_sends_bytes_in_proportion_to_its_length():
    sizes = [300, 3000, 30_000, 300_000]
    sets = [np.unique(np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64)) for n in sizes]
    sent = [len(jaccard_join.folded(jaccard_join.parity(s), jaccard_join.SENT)) * jaccard_join._window(len(s), 85) / len(s) for s in sets]
    assert max(sent) <= 8 * jaccard_join.SENT * 0.16


def test_folded_sketches_keep_the_bound():
    r = np.random.default_rng(6)
    for n in (50, 5000, 40_000):
        both = r.integers(0, 2**63, n, dtype=np.uint64)
        x, y = (np.unique(np.concatenate([both, r.integers(0, 2**63, n // 9, dtype=np.uint64)])) for _ in range(2))
        short = [jaccard_join.folded(jaccard_join.parity(s), jaccard_join.SENT) for s in (x, y)]
        assert all(len(s) <= 8 * jaccard_join.SENT for s in short) and jaccard_join.apart(*short) <= len(np.setxor1d(x, y))
        assert jaccard_join.apart(*short) == jaccard_join.apart(jaccard_join.parity(x), short[1]) or len(jaccard_join.parity(x)) == len(short[0])


# ---- pages without names, forms


@pytest.fixture(scope="module")
def trees():
    return html_extraction.train()


LONG = "Rivers rose quickly on Monday after two days of rain, and the town hall was opened to families."


@pytest.mark.parametrize("page,want", [
    (f"<ul><li><a href=/>Home</a><li><a href=/n>News</a></ul><div><h1>Floods</h1><div>{LONG}</div><div>By Tuesday the water had fallen again, and helpers began to clean the streets.</div></div><div>&copy; 2024 Example News</div>", f"Floods\n\n{LONG}\n\nBy Tuesday the water had fallen again, and helpers began to clean the streets."),
    (f"<article><h1>News</h1><p>{LONG}</p><form><label>Mail</label><input></form><p>{LONG}</p></article>", f"News\n\n{LONG}\n\n{LONG}"),
    (f"<form id=aspnet><article><h1>News</h1><p>{LONG}</p></article></form>", f"News\n\n{LONG}"),
    (f"<table><tr><td><a href=/>Home</a><br><a href=/b>B</a></td><td><p>{LONG}</p></td></tr></table>", LONG),
])
def test_pages_written_by_hand(trees, page, want):
    assert html_extraction.extract_many([page], trees) == [want]


def test_a_page_of_megabytes(spark, trees):
    page = "<nav><a href=/>Home</a></nav><article>" + f"<p>{LONG}</p>" * 20_000 + "</article>"
    table = spark.createDataFrame([(1, "u", page, "own", 5)], "page_id long, url string, html string, text string, n_chars int")
    out = html_extraction.extract(table, trees).collect()
    assert out[0]["text"] == "\n\n".join([LONG] * 20_000)


def test_decoding_is_the_most_likely_consistent_labelling():
    """Against all labellings of small trees."""
    import itertools

    r = np.random.default_rng(11)
    for _ in range(120):
        n = int(r.integers(1, 7))
        parent = [-1, *(int(r.integers(0, i)) for i in range(1, n))]
        p = r.dirichlet([0.7] * 3, n)
        ok = [x for x in itertools.product(range(3), repeat=n) if all(i == 0 or x[parent[i]] == html_extraction.SOME or x[i] == x[parent[i]] for i in range(n))]
        # the root is never all or none of a page by itself
        score = lambda x: sum(math.log(max(p[i, x[i]], 1e-6)) for i in range(n))
        got = html_extraction.decode(parent, p.copy()).tolist()
        assert score(got) >= max(map(score, ok)) - 1e-9


# ---- the choice of texts to learn languages from


def test_many_rows_of_one_id_are_chosen_alike(spark):
    rows = [(7, f"das ist ein kleiner satz nummer {i}", "de") for i in range(60)] + [(i, f"this is a small sentence number {i}", "en") for i in range(60)]
    one, two = (language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(n), sample=10) for n in (1, 7))
    texts = ["ein satz", "a sentence", "kleiner", "small number"]
    assert one.predict(texts) == two.predict(texts)
