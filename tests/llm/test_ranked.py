import math
import random
from collections import Counter

import numpy as np
import pytest

from talentgrid.llm import ranked_search
from tests.llm import plain


def brute(docs, items, k=20):
    terms = [(i, plain.words(text)) for i, text in docs]
    terms = [(i, w) for i, w in terms if w]
    n_docs, n_words = len(terms), sum(len(w) for _, w in terms)
    df = Counter(t for _, w in terms for t in set(w))
    out = []
    for item, text in sorted(set(items), key=str):
        found = []
        for i, w in terms:
            m, tf, score = 75 + 25 * len(w) * n_docs // n_words, Counter(w), 0
            for t, times in Counter(plain.words(text)).items():
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += times * weight * (1000000000 * tf[t] // (1000 * tf[t] + 12 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, n + 1, f[3], -f[0]) for n, f in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def random_rows(seed, n):
    rng = random.Random(seed)
    words = [f"t{int(rng.paretovariate(0.7)) % 400}" for _ in range(5000)] + ["É", "ſ", "K", "naïve"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 120)))) for i in range(n)]
    docs += [(i, docs[3][1]) for i in range(n, n + 60)] + [(3, docs[3][1])] * 3  # copies: ties, repeated rows
    docs += [(9000, None), (9001, ""), (9002, "... !"), (None, docs[5][1]), (9003, "T1 t2,T3 " * 4000), (9004, docs[7][1] * 50)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 40)))) for i in range(12)]
    items += [(20, None), (21, ""), (22, "absent terms only"), (5, docs[5][1]), items[1], (3, docs[3][1]), (None, "t1 t2"), (23, "É É K naïve")]
    return docs, items


@pytest.mark.parametrize("how", [{}, {"block_bytes": 300, "head": 0.5, "k": 3}])
def test_ranks_are_those_of_all_scores(spark, docs_of, how):
    docs, items = random_rows(5, 300)
    table = spark.createDataFrame([(*r, 1, 2, 3) for r in items], "item_id long, text string, q long, doc_id long, rank int")
    got = ranked_search.ranked_search(docs_of(docs).repartition(3), table, **how).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, items, how.get("k", 20))


def test_empty_tables(spark, docs_of):
    none, one = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.ranked_search(docs_of([(1, "a")]), none).count() == 0
    assert ranked_search.ranked_search(docs_of([]).limit(0), one).count() == 0
    assert ranked_search.ranked_search(docs_of([(1, None), (2, "b")]), one).count() == 0
    # a term in every document has weight 0 only where (2N+2)/(2df+1) is below e to the 1/1000
    assert [tuple(r) for r in ranked_search.ranked_search(docs_of([(1, "a")]), one).collect()] == [(1, 1, 1, math.floor(1000 * math.log(4 / 3)) * (10**9 // (1000 + 1200)))]


def test_bounds_leave_few_rows_and_no_good_one_out():
    rng = np.random.default_rng(3)
    weight, size = rng.integers(1, 9000, 500), rng.integers(5, 60, 400)
    terms = np.concatenate([rng.choice(500, s, replace=False) for s in size])
    values, first = rng.integers(1, 500000, len(terms)), np.append(0, np.cumsum(size))
    norm = np.sqrt(np.add.reduceat(weight[terms] * values.astype(float) ** 2, first[:-1]))
    bucket = ranked_search.Bucket(norm, terms, values, first, weight)
    left = 0
    for _ in range(50):
        own = rng.choice(500, 12, replace=False)
        item = ranked_search.Item(list(own), list(rng.integers(1, 4, 12)), weight, 0)
        factor = np.zeros(500, np.int64)
        factor[item.terms] = item.factor
        scores = bucket.scores(np.arange(400), factor)
        least = int(np.sort(scores)[-20])
        rows = bucket.may_reach(item, least)
        assert set(np.flatnonzero(scores >= least)) <= set(rows)
        assert set(bucket.may_reach(item, 0)) >= set(np.flatnonzero(scores > 0))
        assert not len(bucket.may_reach(item, int(item.rest[0] * norm.max() * 1.01)))
        left += len(rows)
    assert left < 50 * 100
