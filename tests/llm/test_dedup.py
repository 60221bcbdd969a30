import random
import re

import numpy as np
import pytest

from talentgrid.llm import near_dedup
from talentgrid.llm.components import components
from talentgrid.llm.near_dedup import near_duplicates
from talentgrid.llm.passages import _onward, beyond, repeated_passages
from tests.llm import plain

SF = "/root/testdata/sf0.001"


def edited(text, n, seed):
    rng, w = random.Random(seed), text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10 ** 6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    texts = {r.doc_id: r.text for r in rows if len(r.text) < 4000}
    base = [texts[i] for i in sorted(texts)[:60]]
    for n in range(90):  # copies of one text, and of many, with few and with more edits
        texts[1000 + n] = edited(base[n % 30] if n % 3 else base[0], 1 + n % 6, n)
    shared = " ".join(f"common{i}" for i in range(60))
    for n in range(30):  # one passage in texts of all sizes: mostly it, or little of it
        texts[2000 + n] = shared + " " + " ".join(f"own{n}x{i}" for i in range(2 + 2 * n))
    return texts


@pytest.mark.parametrize("small", [16, 2])
def test_near_duplicates_are_those_of_all_pairs(spark, texts, small):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in near_duplicates(df, small=small).collect()}
    assert got == plain.near_classes(texts)


def test_rows_of_sketches_and_rare_kmers_are_not_joined_by_text(spark, texts, monkeypatch):
    plans, store = [], near_dedup.stored

    def seen(df, name):
        if name in ("hubs", "pairs", "left-over"):
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return store(df, name)

    monkeypatch.setattr(near_dedup, "stored", seen)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert near_duplicates(df, small=2).count() == len(texts)
    assert len(plans) > 4 and not [p for p in plans if re.search(r"Join Inner, \(id#\d+L? = id#", p)]


def test_near_duplicates_edge_cases(docs_of):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(5, "Same few words"), (3, "same FEW words!"), (7, None), (8, ""), (9, "..."), (10, long), (4, long + " end"),
            (4, long + " end"), (None, "same few words"), (None, None), (11, "one"), (12, "the of " * 40), (13, "the of " * 41)]
    got = sorted(((r.doc_id, r.class_id) for r in near_duplicates(docs_of(rows)).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (7, 7), (8, 8), (9, 9), (10, 4), (4, 4), (4, 4), (None, None), (None, None), (11, 11),
                          (12, 12), (13, 12)], key=str)
    assert near_duplicates(docs_of([]).limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (None, 5), (301, 300), (300, 301)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 300: 300, 301: 300}


def test_repeated_passages_are_those_of_all_windows(spark, texts):
    rng = random.Random(3)
    own = lambda n: " ".join(f"u{rng.randrange(10 ** 9)}" for _ in range(n))
    passage = [own(51 + i) for i in range(30)]
    rows = {k: v for k, v in texts.items() if k < 1000}
    for i in range(120):
        rows[3000 + i] = own(rng.randrange(5, 300)) + " " + passage[i % 30] + " " + own(rng.randrange(5, 300))
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(4)
    found = repeated_passages(df).collect()
    seen, want = {}, set()
    for i, t in sorted(rows.items()):
        w = plain.words(t)
        for at in range(len(w) - 49):
            other = seen.setdefault(tuple(w[at:at + 50]), i)
            if other != i:
                want |= {i, other}
    got = {r.doc_id for r in found}
    assert want <= got and not {i for i in got - want if i >= 3000}
    for r in found:
        if r.doc_id >= 3000:
            w, o = plain.words(rows[r.doc_id]), plain.words(rows[r.other])
            assert w[r.begin:r.end] == o[r.other_begin:r.other_begin + r.end - r.begin] and r.end - r.begin >= 50
            assert r.removed == (r.doc_id != r.cluster)


def test_repeated_passages_edge_cases(docs_of):
    p = " ".join(f"w{i}" for i in range(60))
    changed = p.replace("w30", "x")
    rows = [(1, "start " + p), (2, p + " end"), (2, p + " end"), (3, None), (4, ""), (None, p), (5, "short"), (6, "z\n" + changed + "\nz")]
    got = {(r.doc_id, r.begin, r.end) for r in repeated_passages(docs_of(rows)).collect()}
    assert {(1, 1, 61), (2, 0, 60)} <= got and {g[0] for g in got} <= {1, 2, 6}
    assert repeated_passages(docs_of([]).limit(0)).count() == 0


def test_repeated_passages_beside_a_first_document_with_a_part(docs_of):
    own = lambda n, x: " ".join(f"{x}{i}" for i in range(n))
    rows, want = [], set()
    for n in range(40):  # documents 3n to 3n + 2: a part of 45 words, then twice the whole of 51
        p = [f"p{n}x{i}" for i in range(51)]
        part = p[:45] if n % 2 else p[6:]
        for k, middle in enumerate((part, p, p)):
            before = 5 + k
            rows.append((3 * n + k, " ".join([own(before, f"a{n}k{k}x"), *middle, own(9, f"b{n}k{k}x")])))
            if k:
                want.add((3 * n + k, before, before + 51, 3 * n + 3 - k))
    got = {(r.doc_id, r.begin, r.end, r.other) for r in repeated_passages(docs_of(rows), threshold=1.1).collect()}
    assert got == want


def test_repeated_passages_in_a_first_document_with_the_context_twice(docs_of):
    rows = []
    for n in range(20):
        p = [f"p{n}x{i}" for i in range(60)]
        own = lambda x: [f"{x}{n}x{i}" for i in range(60)]  # noqa: E731, B023
        rows += [(2 * n, " ".join([*own("a"), *p[12:48], *own("b"), *p, *own("c")])), (2 * n + 1, " ".join([*own("d"), *p, *own("e")]))]
    got = {(r.doc_id, r.begin, r.end) for r in repeated_passages(docs_of(rows), threshold=1.1).collect()}
    assert got == {x for n in range(20) for x in ((2 * n, 156, 216), (2 * n + 1, 60, 120))}


def test_near_duplicates_in_chains_of_revisions(spark):
    rng, w, chain = random.Random(11), [f"w{i}" for i in range(160)], []
    for n in range(200):  # a shared passage; each revision changes a word of the rest
        chain.append(" ".join([f"s{i}" for i in range(60)] + w))
        w[rng.randrange(len(w))] = f"r{n}"
    ids = list(range(200))
    rng.shuffle(ids)
    texts = dict(zip(ids, chain))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in near_duplicates(df.union(df.limit(50)), small=2).collect()}
    assert got == plain.near_classes(texts)


def near(x, y, k=5):
    """Jaccard similarity of two passages' shingles."""
    a, b = ({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} for w in (x, y))
    return len(a & b) / len(a | b)


def test_near_passages_inside_longer_lines_are_found(docs_of):
    """Recall of planted passages with changed, missing or added words that brute force calls near; the rest stays alone."""
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    rows, planted = [], set()
    for n in range(150):
        length = rng.choice([52, 60, 80, 120])
        one = words(length)
        two = list(one)
        for _ in range(1 if length < 100 else 2):
            at = rng.randrange(6, len(two) - 6)
            two[at:at + rng.randrange(2)] = rng.choice([[], ["changed"], ["put", "in"]])
        for i, passage in ((2 * n, one), (2 * n + 1, two)):
            rows.append((i, " ".join(words(rng.randrange(30, 150)) + passage + words(rng.randrange(30, 150)))))
        if near(one, two) >= 0.8 and one != two:
            planted |= {2 * n, 2 * n + 1}
    clean = [(1000 + n, " ".join(words(200))) for n in range(100)]
    found = repeated_passages(docs_of(rows + clean)).collect()
    ids = {r.doc_id for r in found}
    assert len(planted) > 200 and len(ids & planted) >= 0.95 * len(planted) and not ids & {i for i, _ in clean}
    texts = {i: t.split() for i, t in rows}
    for r in found:  # what is listed is similar, and ends with the passage
        x, y = texts[r.doc_id][r.begin:r.end], texts[r.other]
        assert r.end - r.begin >= 50 and r.doc_id // 2 == r.other // 2
        assert max(near(x, y[r.other_begin:r.other_begin + n]) for n in range(len(x) - 4, len(x) + 5)) >= 0.8


@pytest.mark.parametrize("small", [16, 1])
def test_repeated_passages_near_each_other_but_not_the_first_document(docs_of, small):
    """Four documents share a line; it is all that the first has, and two go on alike after, or before, a word."""
    rows, want = [], {}
    for n in range(20):
        own = lambda k, x: [f"{x}{n}x{i}" for i in range(k)]  # noqa: E731, B023
        line, rest = own(40, "line"), own(12, "rest")
        one, two = ([*line, x, *rest] if n % 2 else [*rest, x, *line] for x in ("one", "two"))
        for k, passage in enumerate((line, one, line, two)):
            rows.append((4 * n + k, " ".join([*own(9 + k, f"a{k}x"), *passage, *own(9, f"b{k}x")])))
        want |= {4 * n + 1: 4 * n + 1, 4 * n + 3: 4 * n + 1}
    found = repeated_passages(docs_of(rows), small=small).collect()
    assert {r.doc_id: r.cluster for r in found} == want
    assert {(r.doc_id, r.other) for r in found} == {(a, 2 * (a // 4 * 4 + 2) - a) for a in want}


def test_shingles_behind_runs_meet_where_two_texts_leave_a_third_alike():
    own = lambda x, n: [hash(f"{x}{i}") for i in range(n)]
    words = lambda w: np.array(w, np.int64).view(np.uint64)
    line, rest = own("line", 30), own("rest", 25)
    first = words(own("a", 9) + line + own("b", 40))
    one, two = words(own("c", 20) + line + rest + own("d", 5)), words(own("e", 7) + line + own("gap", 3) + rest + own("f", 5))
    keys = [beyond(t, first, [(at + 10, 19, 7)])[at + 10, 7] for t, at in ((one, 20), (two, 7))]
    assert len(np.intersect1d(*keys)) and all(len(k) <= 12 for k in keys)


def test_walks_through_two_texts_are_shared():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 60, 3000).astype(np.uint64)
    y = x.copy()
    y[10::12] = 1  # 250 runs of 11 words
    seen, alone = {}, [_onward(x[p:], y[p:], {}, (p, p), 1) for p in range(10, 3000, 12)]
    for p, want in zip(range(10, 3000, 12), alone):
        known = len(seen)
        assert np.array_equal(_onward(x[p:], y[p:], seen, (p, p), 1), want)
        assert not known or len(seen) == known  # the first walk has been everywhere
