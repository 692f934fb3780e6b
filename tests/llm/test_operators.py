"""The operators as DataFrames, on small tables with nulls, ties, repeated rows, long texts, nothing at all, and extra columns."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.llm import decontamination, html_extraction, jaccard_join, language_id, packing, quality_classifier, quality_rules, sharding, token_files, tokens, url_filter
from cuelake.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, piece int, shard int"
R = random.Random(1)
VOCABULARY = ["".join(R.choice("abcdefgh") for _ in range(R.randint(2, 7))) for _ in range(400)]


def prose(n: int) -> str:
    return "\n".join(" ".join(R.choice(VOCABULARY) for _ in range(min(12, n - i))).capitalize() + "." for i in range(0, n, 12))


def make() -> list[tuple]:
    base, long = prose(60), prose(3000)
    texts = [base, base, base + " end", prose(80), None, "", " \n", "one", long, long + " x y", "a a a a a a a a a a a a a a a a a a a a a a a a a a a a", "### $$$ | | | %%% !!! " * 12, prose(15), base]
    rows = [(i, t, ["en", "de", None][i % 3], None if i == 3 else "s", len(t or ""), 0.5, 7, 1) for i, t in enumerate(texts)]
    return [*rows, (None, prose(50), None, None, None, None, None, None), rows[3]]


SAMPLE = make()


def sample() -> list[tuple]:
    return SAMPLE


@pytest.fixture(scope="module")
def docs(spark):
    return Scratch(spark, "t").save(spark.createDataFrame(sample(), DOCS).repartition(3), "docs")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def key(rows):
    return sorted(rows, key=str)


def test_jaccard_join(docs, empty, spark):
    uid = lambda d: d.withColumn("uid", F.monotonically_increasing_id())
    got = jaccard_join.classes(jaccard_join.link(uid(docs), 4, 85, Scratch(spark, "t"))).select("doc_id", "n_shingles", "component_id")
    rows = sample()
    sets = [set(jaccard_join.ngrams(r[1], 4).tolist()) for r in rows]
    comp = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                i = len(sets[a] & sets[b])
                if i and 100 * i >= 85 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    least = {c: min((r[0] for r, k in zip(rows, comp) if k == c and r[0] is not None), default=None) for c in comp}
    assert key(tuple(r) for r in got.collect()) == key((r[0], len(s), least[c] if s else r[0]) for r, s, c in zip(rows, sets, comp))
    assert jaccard_join.classes(jaccard_join.link(uid(empty), 4, 85, Scratch(spark, "t"))).count() == 0


@pytest.mark.parametrize(("large", "dealt", "kind"), [(5000, 16, "near"), (12_000, 3, "near"), (20_000, 4, "chain"), (20_000, 2, "star")])
def test_jaccard_join_of_a_large_bundle(spark, monkeypatch, large, dealt, kind):
    monkeypatch.setattr(jaccard_join, "LARGE", large)
    monkeypatch.setattr(jaccard_join, "DEALT", dealt)
    r = random.Random(large)
    word = lambda: f"x{r.random()}"
    base = [word() for _ in range(120)]
    texts, w = [], list(base)
    for i in range(90):
        if kind != "chain":
            w = list(base)
        at = r.randrange(120)
        for _ in range({"near": i % 5, "chain": 2, "star": 3 * (i > 0)}[kind]):
            w[(at + r.randrange(8 if kind == "star" else 120)) % 120] = word()
        texts.append(" ".join(w))
    sets = [set(jaccard_join.ngrams(t, 4).tolist()) for t in texts]
    comp = list(range(90))
    linked = [(a, b) for a in range(90) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    for _ in texts:
        for a, b in linked:
            comp[a] = comp[b] = min(comp[a], comp[b])
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("uid", F.lit(0))
    got = {x["doc_id"]: x["component_id"] for x in jaccard_join.classes(jaccard_join.link(d, 4, 85, Scratch(spark, "t"))).collect()}
    assert [got[i] for i in range(90)] == comp and len(linked) > 80


@pytest.mark.parametrize("percent", [60, 85, 100])
def test_crowded_regions_are_cut_up(spark, monkeypatch, percent):
    """Many unlike documents of many sizes share runs of words; regions of over six rows are cut into bands and blocks."""
    monkeypatch.setattr(jaccard_join, "SPLIT", 6)
    monkeypatch.setattr(jaccard_join, "LEAST_BITS", 12)
    r = random.Random(percent)
    word = lambda: f"x{r.random()}"
    shared, texts = [word() for _ in range(40)], []
    for i in range(70):
        w = shared[: r.randrange(8, 41)] + [word() for _ in range(r.choice((0, 0, 2, 5, 60)))]
        texts += [" ".join(w)] * (1 + (i % 9 == 0)) + [" ".join([*w, word()])] * (i % 4 == 0)
    sets = [set(jaccard_join.ngrams(t, 4).tolist()) for t in texts]
    comp = list(range(len(texts)))
    linked = [(a, b) for a in range(len(texts)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in texts:
        for a, b in linked:
            comp[a] = comp[b] = min(comp[a], comp[b])
    cut = []
    monkeypatch.setattr(jaccard_join, "_cut_up", lambda few, *a, f=jaccard_join._cut_up: cut.append(f(few, *a)) or cut[-1])
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("uid", F.lit(0)).repartition(4)
    got = {x["doc_id"]: x["component_id"] for x in jaccard_join.classes(jaccard_join.link(d, 4, percent, Scratch(spark, "t"))).collect()}
    assert [got[i] for i in range(len(texts))] == comp and len(set(comp)) > 3
    assert cut


def test_near_copies_collapse_when_dealt():
    r = random.Random(5)
    base = np.unique(np.array([r.randrange(2**60) for _ in range(300)], np.uint64))
    sets = [np.unique(np.append(np.delete(base, r.sample(range(len(base)), 5)), np.uint64(r.randrange(2**60)))) for _ in range(200)]
    raw, sig = [x.tobytes() for x in sets], np.arange(200)
    _, window, settled, links = jaccard_join.measure(sig, raw, list(range(16)), raw[:16], 85)
    assert set(settled.tolist()) == {0} and {a for a, _ in links} == set(range(200))  # one component: no member goes on


def test_jaccard_filter_keeps_one_of_each_group(docs, empty):
    kept = jaccard_join.filter_documents(docs)
    assert kept.columns == docs.columns
    rows = [r["doc_id"] for r in kept.collect()]
    assert {0, 3, 4, 5, 6, 7, 8, None} <= set(rows) and not {1, 2, 9, 13} & set(rows) and rows.count(3) == 1
    assert jaccard_join.filter_documents(empty).count() == 0


def whole_ids(library: tokens.Encoder, text: str | None) -> bytes:
    return np.append(library.whole(text or ""), 2).astype("<u4").tobytes()


def test_packing_against_the_library(docs, empty):
    pieces = packing.pack(docs, capacity=64).collect()
    library = tokens.Encoder(tokens.default_path())
    want = []
    for r in sample():
        ids = whole_ids(library, r[1])
        want += [(r[0], k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(packing.cut(len(ids) // 4, 64))]
    assert key(tuple(p)[:5] for p in pieces) == key(want)
    by = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == by.get(p["sequence_id"], 0)
        by[p["sequence_id"]] = p["offset"] + p["length"]
    assert max(by.values()) <= 64 and len(by) <= -(-sum(by.values()) // 64) + 1
    assert packing.pack(empty).count() == 0


def test_token_files(docs, empty, spark, tmp_path):
    token_files.write(docs, str(tmp_path / "a"))
    got = [tuple(r) for r in token_files.scan(spark, str(tmp_path / "a")).collect()]
    library = tokens.Encoder(tokens.default_path())
    encoded = {i: whole_ids(library, r[1]) for i, r in enumerate(sample())}
    assert key((g[0], g[2], g[3]) for g in got) == key((r[0], len(encoded[i]) // 4, zlib.crc32(encoded[i])) for i, r in enumerate(sample()))
    at, last = 0, -1
    for g in sorted(got, key=lambda g: g[1]):
        assert g[1] == at and (g[0] is None or g[0] >= last)
        at, last = at + g[2], last if g[0] is None else g[0]
    again = str(tmp_path / "c")
    token_files.write(docs.repartition(5), again)
    assert key(tuple(r) for r in token_files.scan(spark, again).collect()) == key(got)  # whatever the order of the rows, repeated doc_ids too
    token_files.write(empty, str(tmp_path / "b"))
    assert token_files.scan(spark, str(tmp_path / "b")).count() == 0


def test_token_files_of_one_hot_doc_id(spark, tmp_path):
    rows = [(7 if i % 3 else None if i % 2 else i, prose(5)) for i in range(400)]
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), str(tmp_path / "h"))
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.scan(spark, str(tmp_path / "h")).collect())
    library = tokens.Encoder(tokens.default_path())
    want = [(d, whole_ids(library, t)) for d, t in rows]
    assert key((d, len(x) // 4, zlib.crc32(x)) for d, x in want) == key(g[1:] for g in got)
    order = [g[1] for g in got]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0)) and [g[0] for g in got] == [0, *np.cumsum([g[2] for g in got])[:-1].tolist()]
    parts = {r["part"] for r in spark.read.parquet(str(tmp_path / "h")).select("part").collect()}
    assert len(parts) == 4  # two thirds of the rows have one doc_id


def test_op10_reads_back_what_the_library_gives(spark):
    sf = "/root/testdata/sf0.001"
    library, at, want = tokens.Encoder(tokens.default_path()), 0, []
    for r in sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r["doc_id"]):
        x = whole_ids(library, r["text"])
        want.append((r["doc_id"], at, len(x) // 4, zlib.crc32(x)))
        at += len(x) // 4
    assert sorted(tuple(r) for r in token_files.op10_token_files(spark, sf).collect()) == want


def test_sharding(docs, empty):
    rows = sharding.shard(docs, 3).collect()
    assert key((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == key((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in sample())
    for s in range(3):
        own = [r for r in rows if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    assert sharding.shard(empty, 3).count() == 0


@pytest.mark.parametrize("items", [sharding.ITEMS, 12])
def test_sharding_keeps_all_groups_whole_that_fit_a_shard(spark, monkeypatch, items):
    monkeypatch.setattr(sharding, "ITEMS", items)  # few: several levels of partial partitions
    texts = ["hot " * 50] * 400 + ["0.6 of a share " * 4] * 280 + ["warm"] * 3 + [prose(30) for _ in range(500)]
    rows = sharding.shard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 6).collect()
    load = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(6)]
    assert len(rows) == len(texts) and max(load) - min(load) < 0.02 * sum(load)
    share = sum(load) / 6
    groups: dict = {}
    for r in rows:
        groups.setdefault(texts[r["doc_id"]], []).append(r)
    sizes = {t: sum(r["size"] for r in g) for t, g in groups.items()}
    assert sizes["hot " * 50] > share and 0.5 * share < sizes["0.6 of a share " * 4] < share
    assert all(len({r["shard"] for r in g}) == 1 for t, g in groups.items() if sizes[t] <= share)


def brute_stats(text: str | None) -> tuple:
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen: dict = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(docs, empty):
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = quality_rules.stats(docs).select("doc_id", *(f"__q_{c}" for c in counts))
    assert key(tuple(r) for r in got.collect()) == key((r[0], *brute_stats(r[1])) for r in sample())
    judged = quality_rules.judge(quality_rules.stats(docs))
    assert judged.where("__q_quality between 0 and 1").count() == len(sample())
    assert quality_rules.filter_documents(docs).columns == docs.columns
    assert quality_rules.judge(quality_rules.stats(empty)).count() == 0


def test_estimation_finds_accuracies(spark):
    n = len(quality_rules.RULES)
    rows = []
    r = random.Random(3)
    for _ in range(3000):
        good = r.random() < 0.8
        rows.append((good, [(1 if r.random() < 0.9 else 0) if good else (-1 if r.random() < 0.5 else 0) for _ in range(n)]))
    d = spark.createDataFrame(rows, "good boolean, v array<int>")
    p, table = quality_rules.estimate(d, "v")
    assert abs(p - 0.8) < 0.03
    assert d.where((quality_rules.posterior(F.col("v"), p, table) >= 0.5) == F.col("good")).count() > 2950


def test_quality_classifier(docs, empty, spark):
    labels = spark.createDataFrame([(i, int(i not in (10, 11)), 0) for i in range(14)] + [(None, 1, 0), (5, None, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")
    scored = quality_classifier.score(docs, quality_classifier.train(docs, labels))
    assert sorted(scored.columns) == sorted(docs.columns) and scored.where("score between 0 and 1").count() == len(sample())
    twice = quality_classifier.train(docs.unionByName(docs).unionByName(docs.where("doc_id = 3").withColumn("text", F.lit("other"))), labels.unionByName(labels))
    assert twice.weights is not None and (quality_classifier.train(docs, labels).weights == quality_classifier.train(docs.unionByName(docs), labels.unionByName(labels)).weights).all()
    none = quality_classifier.train(docs, labels.where("false"))
    assert {r["score"] for r in quality_classifier.score(docs, none).collect()} == {0.5}
    assert quality_classifier.score(empty, none).count() == 0


def test_language_id(docs, empty):
    out = language_id.predict(docs, language_id.fit(docs))
    got = {r["doc_id"]: r["lang_pred"] for r in out.collect()}
    assert out.count() == len(sample()) and got[4] == got[5] == got[6] == "und" and got[0] in ("en", "de")
    assert {r["lang_pred"] for r in language_id.predict(docs, language_id.fit(empty)).collect()} == {"und"}


def test_language_id_learns_from_all_windows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language_id.Network, "train", lambda self, x, y: seen.append((x, y)))
    texts = [prose(3000), prose(900), "short", None, "12 34"]
    language_id.fit(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string"))
    want = np.concatenate([language_id.windows(t) for t in texts[:3]])
    assert sorted(map(bytes, seen[0][0])) == sorted(map(bytes, want)) and (seen[0][1] == 0).all()


def test_decontamination(docs, empty, spark, monkeypatch):
    item = sample()[0][1]
    bench = spark.createDataFrame([(1, prose(30)), (2, docs.where("doc_id = 12").first()["text"]), (3, None), (4, "")], "item_id long, text string")
    hits = decontamination.find(docs, bench).collect()
    assert {(h["doc_id"], h["item_id"]) for h in hits} == {(12, 2)}
    for size in (20, 49):  # several indexes
        monkeypatch.setattr(decontamination, "INDEX", size)
        long = spark.createDataFrame([(8, sample()[8][1]), (None, sample()[12][1]), (-1, prose(40)), (2, sample()[12][1])], "item_id long, text string")
        got = {(h["doc_id"], h["item_id"]) for h in decontamination.find(docs, long).collect()}
        assert got == {(12, 2), (12, None), (8, 8), (9, 8)}
        assert decontamination.filter_documents(docs, long).count() == len(sample()) - 3
    assert decontamination.filter_documents(docs, bench).count() == len(sample()) - 1
    assert decontamination.find(empty, bench).count() == 0 == decontamination.find(docs, bench.where("false")).count()
    assert decontamination.filter_documents(docs, bench.where("false")).count() == len(sample()) and item


def test_url_filter(spark):
    urls = [f"http://a{i}.example.{'org' if i % 2 else 'com'}/{'es' if i % 3 else 'de'}/{i}" for i in range(60)] + [None, "", "x", "http://b.net/fr/1", "http://b.net/fr/1"]
    pages = spark.createDataFrame([(i, u, None, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, html string, host string, verdict string")
    out = url_filter.judge(pages, url_filter.fit(pages)).collect()
    rules = url_filter.Rules(url_filter.RULES)
    for r in out:
        rule, verdict = rules.match(*url_filter.parts(r["url"]))
        assert (r["host"], r["path"]) == url_filter.parts(r["url"]) and r["rule"] == rule and r["verdict"] == (verdict or r["verdict"]) and r["verdict"] in ("allow", "block")
    assert len(out) == len(urls)
    none = pages.where("false")
    assert url_filter.judge(none, url_filter.fit(none)).count() == 0


def test_html_extraction(spark):
    model = html_extraction.train(60)
    pages = spark.createDataFrame([(1, "u", None, 3), (2, None, "", 3), (2, None, "", 3), (None, "u", "<article><p>Some words of text, to be kept here.</p></article>", 3)], "page_id long, url string, html string, text int")
    out = html_extraction.extract(pages, model)
    assert out.columns == ["page_id", "url", "text"] and sorted(r["text"] for r in out.collect())[:3] == ["", "", ""] and out.count() == 4
    assert html_extraction.extract(pages.where("false"), model).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    start, scratch = docs.columns, Scratch(spark, "t")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = scratch.save(stage(spark, docs, sf), name)
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.columns == start and after.items() <= before.items()
        if name == "jaccard_join":  # brute force: exactly one of each group
            ids = sorted(before)
            roots = jaccard_join.join_sets([jaccard_join.ngrams(before[i], 5) for i in ids], 80)
            assert sorted(after) == sorted(ids[i] for i in set(roots.tolist()))
        if name == "decontamination":
            squeeze = lambda t: b" ".join(decontamination.words(t))
            items = [squeeze(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert {i for i, t in before.items() if not any(b in squeeze(t) for b in items)} == set(after)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(after)
