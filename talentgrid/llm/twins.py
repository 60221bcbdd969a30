"""The corpus queries in DuckDB's SQL."""

# The letters A-Z are lower-cased, and words are runs of the other characters.
_WORDS = (r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

CONTAMINATION_PARTS = f"""
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format('text')} AS w FROM docs),
i AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark),
win AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS win, least(10, len(w)) AS n
        FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
spot AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n),
hit AS (SELECT spot.r, spot.n, spot.s, win.item_id FROM spot JOIN d USING (r) JOIN win ON win.n = spot.n AND win.win = array_to_string(d.w[spot.s : spot.s + spot.n - 1], ' ')),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r),
found AS (SELECT r, count(DISTINCT item_id) AS n_items, sha256(array_to_string(list_sort(list(DISTINCT item_id)), ',')) AS items_sha256 FROM hit GROUP BY r)
"""

CONTAMINATION = f"""
WITH docs AS (SELECT doc_id, text FROM documents), {CONTAMINATION_PARTS}
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN found USING (r)
"""

LINES = """
WITH pos AS (SELECT doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS raw
             FROM documents),
lines AS (SELECT doc_id, line_no, raw, trim(raw) AS line FROM pos),
dist AS (SELECT line, length(line) AS n, min((doc_id, line_no)) AS first FROM lines WHERE line <> '' GROUP BY line),
sides AS (SELECT line, first, n, m, 0 AS side, left(line, m // 2) AS half FROM (SELECT *, unnest([n, n - 1]) AS m FROM dist)
          UNION ALL
          SELECT line, first, n, m, 1, right(line, m - m // 2) FROM (SELECT *, unnest([n, n - 1]) AS m FROM dist)),
pairs AS (SELECT DISTINCT x.line AS later, y.line AS earlier
          FROM sides x JOIN sides y ON x.m = y.m AND x.side = y.side AND x.half = y.half
          WHERE y.first < x.first AND greatest(x.n, y.n) >= 24),
near AS (SELECT DISTINCT later AS line FROM (SELECT *, unnest(range(0, greatest(length(later), length(earlier)))) AS i FROM pairs)
         WHERE left(later, i) = left(earlier, i)
           AND substr(later, i + 1 + CAST(length(later) >= length(earlier) AS INT)) = substr(earlier, i + 1 + CAST(length(earlier) >= length(later) AS INT))),
marked AS (SELECT l.doc_id, l.line_no, l.raw,
                  l.line <> '' AND (near.line IS NOT NULL OR (l.doc_id, l.line_no) <> dist.first) AS gone
           FROM lines l LEFT JOIN dist USING (line) LEFT JOIN near USING (line))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       md5(coalesce(string_agg(raw, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), '')) AS text_md5
FROM marked GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""

MIXTURE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), chr(10), coalesce(md5(text), ''))) AS o FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 3 * n AS cap FROM per),
ratios AS (SELECT *, cap / w AS ratio, row_number() OVER (ORDER BY source NULLS LAST) AS s FROM weighed),
levels AS (SELECT *, CAST(sum(n) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
                     / sum(w) OVER (ORDER BY ratio, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ratios),
targets AS (SELECT source, n, least(CAST(cap AS DOUBLE), w * (SELECT arg_min(level, (ratio, s)) FROM levels WHERE level <= ratio)) AS target FROM levels),
streams AS (SELECT d.*, n, target, sum(size) OVER (PARTITION BY d.source ORDER BY o, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
            FROM d JOIN targets ON d.source IS NOT DISTINCT FROM targets.source),
epochs AS (SELECT *, CAST(floor(target) AS BIGINT) AS whole, CASE WHEN n > 0 THEN CAST(floor(target) AS BIGINT) // n ELSE 0 END AS epochs FROM streams)
SELECT doc_id, size, n AS source_size, target,
       CAST(epochs * size + greatest(0, least(upto, whole - epochs * n) - (upto - size)) AS BIGINT) AS taken
FROM epochs
"""

RANKED = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format('text')} AS w FROM documents),
docs AS (SELECT * FROM d WHERE len(w) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS words FROM docs),
i AS (SELECT row_number() OVER () AS q, item_id, {_WORDS.format('text')} AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
it AS (SELECT q, term, count(*) AS times FROM (SELECT q, unnest(w) AS term FROM i) GROUP BY q, term),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM it) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
v AS (SELECT r, term, (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * len(docs.w) * total.docs) // total.words)) AS v
      FROM tf JOIN docs USING (r), total),
scores AS (SELECT q, r, CAST(sum(it.times * w.w * v.v) AS BIGINT) AS score FROM it JOIN w USING (term) JOIN v USING (term) GROUP BY q, r),
ranked AS (SELECT q, doc_id, score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
           FROM scores JOIN docs USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked JOIN i USING (q) WHERE rank <= 20
"""

PHRASES = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                             '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, w[s : s + k - 1] AS p FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS s FROM (SELECT *, unnest([1, 2, 3, 4]) AS k FROM words) WHERE len(w) >= k)),
f AS (SELECT lang, p, count(*) AS f FROM grams GROUP BY lang, p HAVING count(*) >= 30),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
cuts AS (SELECT lang, p, f, unnest(range(1, len(p))) AS k FROM f WHERE len(p) > 1),
scores AS (SELECT c.lang, c.p, c.f, k, x.f AS l, y.f AS r, CAST((2000000 * CAST(c.f AS HUGEINT)) // (x.f + y.f) AS BIGINT) AS score
           FROM cuts c JOIN f x ON x.lang = c.lang AND x.p = c.p[: k] JOIN f y ON y.lang = c.lang AND y.p = c.p[k + 1 :]),
best AS (SELECT lang, p, f, min((score, k)) AS low FROM scores GROUP BY lang, p, f),
inside AS (SELECT lang, p[s : s + k - 1] AS p, max(f) AS longer FROM (SELECT *, unnest(range(1, len(p) - k + 2)) AS s FROM (SELECT *, unnest(range(2, len(p))) AS k FROM f)) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inside i USING (lang, p) WHERE longer IS NULL OR 100 * longer < 80 * b.f),
ranked AS (SELECT s.lang, array_to_string(s.p, ' ') AS phrase, s.f AS a, l, r, score FROM scores s JOIN kept USING (lang, p) WHERE (score, k) = low)
SELECT lang, CAST(rank AS INTEGER) AS rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM ranked) JOIN total USING (lang) WHERE rank <= 2000
"""
