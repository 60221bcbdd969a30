import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from talentgrid.llm import language
from talentgrid.llm.secret_scan import SecretScanner, find_secrets
from talentgrid.llm.vantage import VantageTree, nearest

KEY = "q7Zt9LmX2vB4nR8sKd3W"


def brute(ids, x, queries, k):
    out = []
    for q in queries:
        rows = [(-float(np.dot(x[i], x[q])), ids[i]) for i in range(len(ids)) if ids[i] != ids[q]]
        out += [(ids[q], n + 1, v, s) for n, (s, v) in enumerate(sorted((round(s, 9), v) for s, v in rows)[:k])]
    return out


def test_nearest_is_exact_at_factor_one(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 12))
    x[300:420] = x[5]  # many copies: ties go to the smaller id
    x *= rng.uniform(0.2, 3, (700, 1))
    x[300:420] = x[5]
    rows = [(i, [float(v) for v in x[i]]) for i in range(700)]
    odd = [(1000, None), (1001, [0.0] * 12), (1020, [float("nan")] + [1.0] * 11), (1002, [None] + [1.0] * 11), (None, rows[0][1]), (1003, [float("inf")] * 12)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns({"dim": F.lit(1), "group": F.lit(2)})
    got = nearest(df, df.filter("vec_id % 20 = 0"), k=20, shard_size=150, leaf=8)
    got = sorted((r.query_id, r.rank, r.vec_id, round(-r.score, 9)) for r in got.collect())
    assert got == sorted(brute(list(range(700)), x, range(0, 700, 20), 20))


def test_repeated_query_rows_are_one_query_and_other_vectors_their_own(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(101, 8))
    rows = [(i, x[i].tolist()) for i in range(100)] + [(20, x[20].tolist()), (40, x[100].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest(df, df.filter("vec_id in (20, 40)"), k=20, shard_size=30, leaf=4).collect()
    ids = [i for i, _ in rows]
    for query, vectors in ((20, [x[20]]), (40, [x[40], x[100]])):
        want = sorted((n + 1, ids[j], round(-s, 9)) for v in vectors for n, (s, j) in enumerate(
            sorted((round(-float(np.dot(np.array(rows[j][1]), v)), 9), j) for j in range(len(rows)) if ids[j] != query)[:20]))
        assert sorted((r.rank, r.vec_id, round(r.score, 9)) for r in got if r.query_id == query) == want


def test_copies_of_unit_vectors_go_by_the_smaller_row():
    rng = np.random.default_rng(8)
    for n in range(40):
        x = rng.normal(size=(3000, 128))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        x = x.astype(np.float32).astype(float) if n % 2 else x
        copies = np.sort(rng.permutation(3000)[:1000])
        x[copies] = x[copies[0]]
        row, score = VantageTree(x).search(x[copies[[0, 500, 999]]], 21)
        assert (row == copies[:21]).all() and (score == score[0, 0]).all()


def test_smaller_factor_still_finds_nearly_all():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 8))
    tree = VantageTree(x, 16)
    exact, some = tree.search(x[:100], 10, 1.0)[0], tree.search(x[:100], 10, 0.8)[0]
    assert (exact == np.argsort(-(x[:100] @ x.T), axis=1)[:, :10]).all()
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(exact, some)]) > 0.9


def test_few_and_no_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [2.0, 1.0]), (20, [1.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in nearest(df, df.filter("vec_id % 20 = 0").distinct()).collect()]
    assert got == [(0, 1, 1, 4.0)]
    assert nearest(df.limit(0), df.limit(0)).count() == 0


BASE = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
        ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]


def test_secrets_base_patterns(docs_of):
    texts = ["", None, "ſecret=abcdefgh toKen = token = abcdefgh", 'api_key: "x.y/z+1=" PASSWD=12345', "AKIA" + "Z" * 16 + " AKIA123", "f" * 24 + "g" + "a" * 23,
             "é" * 3 + "secret='" + "deadbeef" * 4 + "'", "token=token=abc secret:short " + "AKIAAKIA" * 4, "ab" * 60_000, KEY]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "token=abcdefg")] * 2
    for r, (i, t) in zip(sorted(find_secrets(docs_of(rows)).collect(), key=lambda r: (r.doc_id is None, r.doc_id)), rows, strict=True):
        want = sorted((m.start(), n, m.end(), k) for n, (k, p, g, least) in enumerate(BASE) for m in p.finditer(t or "") if len(m[g]) >= least)
        assert [(s.kind, s.start, s.end) for s in r.spans if s.kind != "novel"] == [(k, a, b) for a, _, b, k in want]


def test_novel_strings_in_sensitive_context():
    spans = lambda t: [t[a:b] for a, b, k in SecretScanner().scan(t) if k == "novel"]
    assert spans(f"Authorization: Bearer {KEY}") == [KEY] and spans(f"the auth header is {KEY}; later {KEY[::-1]}") == [KEY, KEY[::-1]]
    assert spans(f"nothing here: {KEY}") == [] and spans("auth in client_secret_configuration1_default") == []
    assert spans("auth is abcabcabcabcabcabc1abcabc") == [] and spans(f"secret={KEY}") == []
    assert spans(f"uses {KEY} as an identifier, so auth {KEY} is known nearby") == []


@pytest.mark.parametrize("letters, size", [("0123456789ABCDEF", 64), ("0123456789ABCDEF", 128), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 200),
                                           ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", 1000),
                                           ("0123456789", 20), ("abcdefghijklmnopqrstuvwxyz", 32), ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", 24)])
def test_random_keys_of_every_alphabet_are_novel(letters, size):
    rng = random.Random(size)
    for _ in range(30):
        key = "".join(rng.choices(letters, k=size))
        assert [(a, b, k) for a, b, k in SecretScanner().scan(f"Bearer {key}\nagain: {key}") if k == "novel"] == [(7, 7 + size, "novel")]


def test_planted_keys_are_found_and_identifiers_of_the_corpus_are_not(docs_of):
    """Recall and precision of novel spans; the identifiers are made of words that other texts have, none of them nearby."""
    rng = random.Random(9)
    words = ["".join(rng.choices("bcdfghlmnprst", k=2)) + "".join(rng.choices("aeiou", k=1)) + "".join(rng.choices("bcdfglmnprst", k=1))
             + rng.choice(["ing", "tion", "er", "able"]) for _ in range(300)]
    plain_texts = [(1000 + n, " ".join(rng.choices(words, k=200))) for n in range(60)]
    join = [lambda w: "_".join(w), lambda w: w[0] + "".join(x.title() for x in w[1:]), lambda w: "-".join(w)]
    names = {n: rng.choice(join)(rng.choices(words, k=3)) for n in range(150)}
    letters = ["abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEF"]
    keys = {n: "".join(rng.choices(letters[n % 3], k=rng.randrange(20, 60))) for n in range(200, 350)}
    leaked = [(n, f"bearer {keys[200]} end") for n in range(400, 440)]  # copies don't make a key known
    rows = [(n, f"auth with {x} and more") for n, x in {**names, **keys}.items()] + leaked + plain_texts
    found = {r.doc_id for r in find_secrets(docs_of(rows)).collect() if any(s.kind == "novel" for s in r.spans)}
    assert len(found & set(keys)) == 150 and len(found & {n for n, _ in leaked}) == 40
    assert len(found & set(names)) <= 3 and not found & {n for n, _ in plain_texts}


def test_added_bytes_are_those_of_two_frames():
    """The novelty measure against frames squeezed apart, with and without the candidate."""
    import zstandard
    scanner = SecretScanner(identifiers=("alpha", "session_token"))
    how = zstandard.ZstdCompressionParameters.from_level(12, window_log=18, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)
    for candidate, around in ((KEY, ""), ("session_token_alpha", "x"), (KEY, "uses " + KEY)):
        squeeze = lambda x: len(zstandard.ZstdCompressor(compression_params=how, dict_data=zstandard.ZstdCompressionDict(
            b"alpha session_token", dict_type=zstandard.DICT_TYPE_RAWCONTENT)).compress(x.encode()))
        both = f"alpha session_token {around} "
        assert scanner.added_bytes(candidate, around) == squeeze(both + candidate) - squeeze(both)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_language_of_held_out_documents(documents):
    docs = documents.withColumn("held_out", language.held_out(F.col("doc_id")))
    net = language.learn(documents)
    got = language.predict(docs, net, keep=("doc_id", "held_out", "lang")).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == documents.count() and np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert set(net.langs) == {"de", "en", "es", "fr"} and all(0 <= r.score <= 1 for r in got)


def test_language_edge_cases(spark, docs_of, documents):
    net = language.learn(documents)
    en = documents.filter("lang = 'en'").orderBy("doc_id").first().text
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, en), (4, en), (5, en * 400), (None, en[:20]), (6, "你好")]
    got = {(r.doc_id, r.lang_pred) for r in language.predict(docs_of(rows), net).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "en")} <= got and len(got) == 7
    assert language.predict(docs_of([]).limit(0), net).count() == 0
    unlabelled = docs_of(rows).withColumn("lang", F.lit(None).cast("string"))
    assert language.learn(unlabelled) is None
    assert {r.lang_pred for r in language.predict(unlabelled, None).collect()} == {"und"}


def test_windows_cover_the_whole_text():
    net = language.train([b"aaaa", b"bbbb"] * 4, ["x", "y"] * 4, epochs=30)
    tables = net.tables()
    x = np.frombuffer(b"ab" * 128, np.uint8)[None, :]
    direct = np.stack([sum(w[j][x[0, j:j + 256 - len(w) + 1]] for j in range(len(w))).max(0) for w in net.filters]).ravel()
    z = np.maximum(direct + net.bias, 0) @ net.out + net.out_bias
    assert np.allclose(net.probabilities(x, tables)[0], np.exp(z - z.max()) / np.exp(z - z.max()).sum(), atol=1e-5)
