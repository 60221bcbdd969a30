import re
from collections import Counter, defaultdict

import pytest

from talentgrid.llm import mixture

DOCS = [(n, f"word{n} " * (n % 37), f"s{n % 7}") for n in range(400)] + [
    (1000, None, "s1"), (1001, "", "s1"), (1002, " \t\n\x0b\x0c\r", "empty"), (1003, "w x y z " * 3000, "long"), (None, "a b c", "s1"),
    (7, "again and again", "s2"), (7, "again and again", "s2"), (7, "other text", "s2"), (1004, "null source here", None), (1005, "a b", "\U0001F600"), (1006, "c", "￿")]


def plain_targets(sizes):
    """Targets by sharing what is over again and again."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: 3 * sizes[s] for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return fixed | share
        fixed |= over


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", 3.0) for r in rows],
                                 "doc_id long, text string, source string, n long, s long, block string, target double")


@pytest.mark.parametrize("block", [1024, 7])
def test_the_mix_meets_its_targets(spark, block):
    docs = rows_of(spark, DOCS)
    got = mixture.mixture_counts(docs, block_words=block).collect()
    size = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    assert sorted(((r.doc_id, r.size) for r in got), key=str) == sorted(((i, size(text)) for i, text, _ in DOCS), key=str)
    sizes, taken, target = Counter({s: 0 for _, _, s in DOCS}), Counter(), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    for s, t in plain_targets(sizes).items():
        assert target[s] == pytest.approx(t) and t - 1.001 < taken[s] <= t + 1e-6
    assert all(r.source_size == sizes[r.source] for r in got)
    again = mixture.mixture_counts(docs.repartition(5), block_words=block).collect()
    assert sorted(got, key=str) == sorted(again, key=str)


def test_the_schedule_is_even_and_takes_each_word_once_an_epoch(spark):
    rows = mixture.mixture(rows_of(spark, DOCS), block_words=16).orderBy("position", "nth").collect()
    words, slots, seen = defaultdict(list), {}, set()
    for r in rows:
        slots.setdefault(r.position, r.source)
        assert slots[r.position] == r.source and r.words > 0
        words[r.source, r.epoch].append((r.doc_id, r.first_word, r.words))
        if r.doc_id is not None and r.doc_id != 7:
            places = {(r.doc_id, r.epoch, w) for w in range(r.first_word, r.first_word + r.words)}
            assert not places & seen
            seen |= places
    order = [s for _, s in sorted(slots.items())]
    total = Counter(order)
    for n in range(1, len(order), 17):  # no run from the start is far from the weights
        for s, m in total.items():
            assert abs(sum(x == s for x in order[:n]) - n * m / len(order)) < 8
    assert max(e for _, e in words) >= 1


def test_empty_tables_and_tables_without_words(spark):
    none = rows_of(spark, DOCS).limit(0)
    assert mixture.mixture_counts(none).count() == 0 and mixture.mixture(none).count() == 0
    blank = rows_of(spark, [(1, None, "a"), (2, "", None)])
    assert [tuple(r) for r in mixture.mixture_counts(blank).orderBy("doc_id").collect()] == [(1, "a", 0, 0, 0.0, 0), (2, None, 0, 0, 0.0, 0)]
    assert mixture.mixture(blank).count() == 0
