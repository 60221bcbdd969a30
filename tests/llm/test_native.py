import random

import duckdb
import pytest

from talentgrid.llm import decontaminate, line_dedup, twins
from tests.llm import plain

WIN = "one two three four five six seven eight nine ten"
DOCS = [(1, f"x {WIN} eleven y {WIN}"), (2, WIN.upper() + "!"), (3, "one two three"), (4, None), (5, ""), (6, "... !"), (7, "É one-two, É"),
        (8, f"{WIN} " * 3000), (8, f"{WIN} " * 3000), (None, WIN), (9, "four five six seven eight nine ten " * 2), (10, "é one two é")]
ITEMS = [(1, WIN + " eleven"), (2, "é One two"), (2, "é One two"), (3, None), (4, ""), (5, "É one"), (None, WIN), (6, "absent " * 12)]


def contaminated(spark, docs_of, docs, items, **how):
    found = decontaminate.contamination(docs_of(docs), spark.createDataFrame(items, "item_id long, text string"), **how)
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in found.collect()), key=str)


@pytest.mark.parametrize("prefix_bytes", [1 << 20, 300])
def test_contamination_is_that_of_all_windows(spark, docs_of, prefix_bytes):
    want = []
    for d in DOCS:
        ((i, r),) = plain.contamination([d], ITEMS).items()
        want.append((i, r[0], r[1], r[2]))
    assert contaminated(spark, docs_of, DOCS, ITEMS, prefix_bytes=prefix_bytes) == sorted(want, key=str)


def test_contamination_of_empty_tables(spark, docs_of):
    assert contaminated(spark, docs_of, [(1, "a b")], []) == [(1, 2, 0, [])]
    found = decontaminate.contamination(docs_of([]).limit(0), spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert found.count() == 0


BODY = "The quick brown fox jumps over the lazy dog near the bank"
LINES = [(2, f"{BODY}\n\n{BODY}x\nshort\nshorT"), (1, f"{BODY[1:]}\nshort\n  {BODY[1:]}  \nother"), (3, None), (4, ""), (5, f"{BODY}\n"),
         (6, f"{BODY.replace('fox', 'fix')}\n{BODY.replace('fox', 'fo')}\n{BODY.replace('fox', 'foxy')}\n{BODY.replace('fox', 'cat')}"),
         (7, f"{BODY[:-1]}\n{BODY}\n\n \n"), (8, "é" * 30 + "\n" + "é" * 29 + "\n" + "é" * 29 + "ê\n" + "é" * 28 + "ab"), (9, BODY * 200), (10, BODY * 200 + "!")]


def removed(docs_of, rows, **how):
    return {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.dedup_lines(docs_of(rows), **how).collect()}


@pytest.mark.parametrize("min_near", [24, 0])
def test_lines_are_those_of_all_pairs(docs_of, min_near):
    assert removed(docs_of, LINES, min_near=min_near) == plain.dedup_lines(sorted(LINES), min_near)


@pytest.mark.parametrize("min_near", [24, 0])
def test_random_edits_are_found_wherever_they_are(docs_of, min_near):
    rng = random.Random(min_near)
    rows = []
    for n in range(120):
        line = "".join(rng.choice("abé ") for _ in range(rng.choice([1, 2, 3, 5, 23, 24, 25, 40, 300])))
        lines = [line]
        for _ in range(5):
            x = list(rng.choice(lines))
            for _ in range(rng.choice([1, 1, 2])):
                at = rng.randrange(len(x) + 1)
                x[at:at + rng.randrange(2)] = rng.choice(["", "a", "b", "é"])
            lines.append("".join(x))
        rng.shuffle(lines)
        rows.append((n, "\n".join(lines)))
    assert removed(docs_of, rows, min_near=min_near) == plain.dedup_lines(rows, min_near)


def test_lines_of_repeated_rows_null_ids_and_empty_tables(docs_of):
    out = line_dedup.dedup_lines(docs_of([(None, BODY), (1, BODY), (1, BODY), (2, BODY[:-1])])).collect()
    assert sorted(((r.doc_id, r.n_removed, r.text) for r in out), key=str) == [(1, 1, ""), (1, 1, ""), (2, 1, ""), (None, 0, BODY)]
    assert out[0].own == "x" and out[0].removed == "r"
    assert removed(docs_of, [(2, BODY[:-1]), (1, BODY)], max_edits=0) == {1: (1, 0, BODY), 2: (1, 0, BODY[:-1])}
    assert line_dedup.dedup_lines(docs_of([]).limit(0)).count() == 0


def test_sql_twins_on_the_edge_cases(spark, docs_of):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", LINES)
    got = {r[0]: r[1:3] for r in con.execute(twins.LINES).fetchall()}
    assert got == {k: v[:2] for k, v in plain.dedup_lines(sorted(LINES)).items()}


def test_a_short_earliest_neighbour_hides_no_longer_one(docs_of):
    line = "abcdefghijklmnopqrstuvw"  # 23 characters
    rows = [(1, line[:4] + "X" + line[5:]), (2, line + "x"), (3, line)]
    assert removed(docs_of, rows) == plain.dedup_lines(rows) == {1: (1, 0, rows[0][1]), 2: (1, 0, rows[1][1]), 3: (1, 1, "")}
