"""The url filter's language models against counts in plain dicts."""

from __future__ import annotations

import math
import random
from collections import Counter

from cuelake.llm import url_filter as uf


def brute_force(urls: list[str], kinds: list[int]):
    n, m = Counter(), Counter()
    runs = lambda u: [(k, ((None,) * uf.ORDER + tuple(u.encode()))[i + uf.ORDER - k : i + uf.ORDER + 1]) for i in range(len(u.encode())) for k in range(uf.ORDER + 1)]
    for u, c in zip(urls, kinds):
        for k, run in runs(u):
            n[c, k, run[:-1]] += 1
            m[c, k, run] += 1

    def difference(u: str | None) -> float:
        p, total = [1 / 256] * 2, 0.0
        for k, run in runs(u or ""):
            p = [1 / 256] * 2 if not k else p
            p = [(m[c, k, run] + uf.SMOOTH * p[c]) / (n[c, k, run[:-1]] + uf.SMOOTH) if n[c, k, run[:-1]] >= uf.LEAST else p[c] for c in (0, 1)]
            total += math.log(p[0] / p[1]) if k == uf.ORDER else 0
        return total / max(1, len((u or "").encode()))

    return difference


def test_counts_are_exact_however_many_contexts(spark):
    r = random.Random(1)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    urls = [f"http://{word(8)}.{r.choice(['org', 'com', 'net'])}/{r.choice(['fr', 'de', 'x'])}/{word(40)}" for _ in range(1500)] + [None, "", "é你", "http://b.net"] * 2
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").repartition(3)
    ruled = [(x["url"], x["kind"]) for x in uf._ruled(pages, uf.RULES).where("not calibrates").collect()]
    difference = brute_force(*zip(*ruled))
    model = uf.Models()
    model.add(*map(list, zip(*ruled)))
    assert len(model.grams) > 20_000
    fitted = uf.fit(pages)
    out = uf.judge(pages, fitted).collect()
    assert len(out) == len(urls) and out[0].__fields__ == ["page_id", "url", "host", "path", "rule", "verdict", "score"]
    for x in out:
        want = difference(x["url"])
        assert abs(x["score"] - want) < 1e-9 and abs(model.differences([x["url"]])[0] - want) < 1e-9
        assert x["rule"] or x["verdict"] == ("allow" if x["score"] >= fitted.threshold else "block")
