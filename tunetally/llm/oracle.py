"""DuckDB SQL for the queries that SQL can express, over the same tables."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_TERMS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


def _folded(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_LOWER}')"


def _digest(values: str, by: str, joint: str = "' '") -> str:
    return f"sha256(coalesce(string_agg({values}, {joint} ORDER BY {by}), ''))"


NEAR_DEDUP = f"""WITH RECURSIVE texts AS (
    SELECT doc_id, {_WORDS.format(_folded("coalesce(text, '')"))} AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS shingle
    FROM texts)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a
    JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT s.a, s.b FROM shared s JOIN sizes x ON x.doc_id = s.a JOIN sizes y ON y.doc_id = s.b
    WHERE 100 * s.n >= 80 * (x.n + y.n - s.n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT DISTINCT a AS node, a AS other FROM both_ways
    UNION SELECT r.node, l.b FROM reached r JOIN both_ways l ON l.a = r.other),
least AS (SELECT node, min(other) AS component FROM reached GROUP BY 1)
SELECT t.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(c.component, t.doc_id) AS component_id,
    coalesce(c.component, t.doc_id) = t.doc_id AS kept
FROM texts t LEFT JOIN sizes s ON s.doc_id = t.doc_id LEFT JOIN least c ON c.node = t.doc_id"""

SUBSTRINGS = f"""WITH texts AS (
    SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS passage FROM (
    SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM texts)),
first AS (SELECT passage, min(doc_id) AS doc_id FROM windows GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS place FROM (
    SELECT w.doc_id, w.i FROM windows w JOIN first f ON f.passage = w.passage AND f.doc_id < w.doc_id)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM texts),
left_over AS (SELECT doc_id, count(*) AS kept, {_digest("word", "place")} AS kept_sha256
    FROM words ANTI JOIN gone USING (doc_id, place) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(kept, 0) AS n_removed,
    coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM texts LEFT JOIN left_over USING (doc_id)"""

PERIODIC_RUNS = f"""WITH crc AS (SELECT list(x ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS x
    FROM range(256) r(i))),
hashed AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w, xor(4294967295, list_reduce(
    [4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM documents, crc),
placed AS (SELECT *, (h // 10) % len(w) AS a, 1 + (len(w) - (h // 10) % len(w)) // (3 + (h // 10) % 8) AS p
    FROM hashed),
texts AS (SELECT doc_id, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN list_transform(range(len(w)),
    lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w FROM placed),
periods AS (SELECT * FROM (SELECT doc_id, n, w, unnest(range(1, n // 4 + 1)) AS q FROM texts)
    WHERE len(list_filter(range(1, n - 3 * q + 1, q), lambda i:
        w[i] = w[i + q] AND w[i] = w[i + 2 * q] AND w[i] = w[i + 3 * q])) > 0),
equal AS (SELECT doc_id, q, unnest(list_filter(range(n - q), lambda i: w[i + 1] = w[i + q + 1])) AS i FROM periods),
islands AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (
    SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM equal)
    GROUP BY doc_id, q, island HAVING count(*) >= 3 * q),
runs AS (SELECT doc_id, start, length, q AS period FROM islands r WHERE length >= 6 AND NOT EXISTS (
    SELECT 1 FROM islands s WHERE s.doc_id = r.doc_id AND s.q < r.q AND s.start <= r.start
        AND s.start + s.length >= r.start + r.length)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id
    ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS place FROM runs) WHERE place = 1),
told AS (SELECT doc_id, count(*) AS n_runs, sha256(string_agg(
    start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256
    FROM runs GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS place FROM runs),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(n)) AS place FROM texts),
left_over AS (SELECT doc_id, {_digest("word", "place")} AS collapsed_sha256
    FROM words ANTI JOIN gone USING (doc_id, place) GROUP BY 1)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period,
    CAST(1000 * length // period AS BIGINT) AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256,
    coalesce(collapsed_sha256, sha256('')) AS collapsed_sha256, n AS n_words
FROM texts t LEFT JOIN told USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN left_over USING (doc_id)"""

LEXICAL = f"""WITH terms AS (SELECT doc_id, unnest({_TERMS.format(_folded("coalesce(text, '')"))}) AS term FROM documents),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY 1, 2),
sizes AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY 1),
facts AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM sizes),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM tfs, facts GROUP BY 1),
shares AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))) AS share
    FROM tfs JOIN sizes USING (doc_id) JOIN weights USING (term), facts),
items AS (SELECT DISTINCT item_id, unnest({_TERMS.format(_folded("coalesce(text, '')"))}) AS term FROM benchmark),
scores AS (SELECT item_id, doc_id, CAST(sum(share) AS BIGINT) AS score FROM items JOIN shares USING (term) GROUP BY 1, 2)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (
    PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 50"""

LINE_DEDUP = f"""WITH lines AS (SELECT doc_id, line, place,
    {_folded("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM (
    SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS place FROM (
        SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
shared AS (SELECT key, max(doc_id) AS top FROM lines WHERE length(key) >= 40
    GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT l.*, s.top IS NULL OR s.top = l.doc_id AS stays FROM lines l LEFT JOIN shared s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped, sha256(coalesce(
    string_agg(line, chr(10) ORDER BY place) FILTER (stays), '')) AS kept_sha256 FROM marked GROUP BY 1"""

#: The base columns of op3. Gaps and matches of a kind take turns, so a match starts where all
#: gaps up to it and all matches before it end.
BASE_SECRETS = r"""WITH kinds(o, kind, pattern, part, least) AS (VALUES
    (0, 'assign', '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1, 12),
    (1, 'access', '(AKIA[A-Z0-9]+)', 1, 18),
    (2, 'hex', '([0-9a-f]{16,})', 1, 1)),
cut AS (SELECT doc_id, o, kind, least, regexp_split_to_array(text, pattern) AS gaps,
    regexp_extract_all(text, pattern, 0) AS found, regexp_extract_all(text, pattern, 1) AS counted
    FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents), kinds),
laid AS (SELECT doc_id, o, kind, least, unnest(gaps[1:len(found)]) AS gap, unnest(found) AS hit,
    unnest(counted) AS counted, unnest(range(len(found))) AS k FROM cut),
placed AS (SELECT *, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, o ORDER BY k) AS BIGINT) AS stop FROM laid),
good AS (SELECT *, stop - length(hit) AS start FROM placed WHERE length(counted) >= least),
told AS (SELECT doc_id, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access,
    count(*) FILTER (o = 2) AS n_hex,
    sha256(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o)) AS base_sha256
    FROM good GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
    coalesce(n_hex, 0) AS n_hex, coalesce(base_sha256, sha256('')) AS base_sha256
FROM documents LEFT JOIN told USING (doc_id)"""

#: The base columns of op8.
BASE_QUALITY = rf"""WITH texts AS (SELECT doc_id, text, {_WORDS.format("text")} AS w
    FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts),
line_counts AS (SELECT doc_id, CAST(sum(n - 1) AS BIGINT) AS n_dup_lines FROM (
    SELECT doc_id, line, count(*) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1, 2)
    GROUP BY 1),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS passage FROM (
    SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM texts)),
twice AS (SELECT doc_id, passage FROM windows GROUP BY 1, 2 HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT place) AS n_repeat_words FROM (
    SELECT doc_id, unnest(range(i, i + 8)) AS place FROM windows JOIN twice USING (doc_id, passage)) GROUP BY 1),
counts AS (SELECT doc_id, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM texts LEFT JOIN line_counts USING (doc_id) LEFT JOIN covered USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts"""

ORACLE_SQL: dict[str, str] = {
    "op2_minhash_near_dedup": NEAR_DEDUP,
    "op6_difference_cover_substrings": SUBSTRINGS,
    "op11_synchronising_runs": PERIODIC_RUNS,
    "op12_hybrid_lexical_search": LEXICAL,
    "op13_line_bitmaps": LINE_DEDUP,
    "base_secrets": BASE_SECRETS,
    "base_quality_counts": BASE_QUALITY,
}
