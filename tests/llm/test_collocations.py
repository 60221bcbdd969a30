import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from talentgrid.llm import collocations


def brute(rows, top, least, longest=4):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang, text = lang or "und", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang in f:
        many = {p: a for p, a in f[lang].items() if a >= least}
        longer = Counter()
        for p, a in many.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i:i + k]] = max(longer[p[i:i + k]], a)
        found = []
        for p, a in many.items():
            if len(p) > 1 and not 100 * longer[p] >= 80 * a:
                score, _, l, r = min((2000000 * a // (many[p[:k]] + many[p[k:]]), k, many[p[:k]], many[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def random_rows(seed):
    rng = random.Random(seed)
    rows = []
    for lang in ("xx", "yy", None, "und", "few"):
        words = [f"w{i}" for i in range(40)] + ["É", "à b", "UPPER", "x\x00y"]
        fixed = [" ".join(rng.choices(words, k=rng.randrange(2, 7))) for _ in range(30)]
        for _ in range(4 if lang == "few" else 150):
            parts = [rng.choice(fixed) if rng.random() < 0.6 else " ".join(rng.choices(words, k=3)) for _ in range(8)]
            rows.append((rng.choice([". ", " ", "\t", "\r\n"]).join(parts), lang))
    return rows + [rows[0]] * 40 + [(None, "xx"), ("", "yy"), (" .,; ", None), ("solo " * 3000, "xx"), ("w1 w2 w3 " * 500, "long")]


@pytest.mark.parametrize("top,least,bits", [(5, 3, 20), (60, 5, 6), (2000, 30, 25)])
def test_phrases_are_those_of_all_counts(spark, top, least, bits, monkeypatch):
    rows = random_rows(top)
    docs = spark.createDataFrame([(i, *r, 1, 2) for i, r in enumerate(rows)], "doc_id long, text string, lang string, phrase long, f long")
    monkeypatch.setattr(collocations, "FLUSH_ROWS", 1000)
    got = collocations.collocations(docs, top=top, least=least, table_bits=bits).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, top, least)


def test_an_empty_table_has_no_phrases(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None)], "lang string, text string")).count() == 0


def test_the_bit_table_and_the_slots_agree(spark):
    rng = np.random.default_rng(1)
    phrases = rng.integers(-2**63, 2**63, (500, 3))
    df = spark.createDataFrame([(p.tolist(),) for p in phrases], "phrase array<long>")
    table = collocations.BitTable.of(df.select(collocations._slot_column(df["phrase"], 3).alias("slot")), 16)
    slots = collocations._slot([phrases[:, i].view(np.uint64) for i in range(3)])
    assert table.has(slots).all()
    assert table.has(rng.integers(0, 2**63, 10000).astype(np.uint64)).mean() < 0.02
