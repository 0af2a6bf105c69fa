"""DuckDB SQL for the text queries that SQL can express."""

from __future__ import annotations

_OP2 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
l AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
      FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
marked AS (SELECT r, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) AS t(k) GROUP BY r),
c AS (SELECT d.doc_id, d.text, len(words) AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        coalesce(n, 0) AS n_repeat_words,
        len(list_filter(words, lambda x: regexp_matches(x, '[A-Za-z\x{80}-\x{10FFFF}]'))) AS lettered,
        length(regexp_replace(text, '[^A-Z]', '', 'g')) AS upper_letters,
        length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS ascii_letters
      FROM d JOIN w USING (r) JOIN l USING (r) LEFT JOIN marked USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR word_chars < 2 * n_words
    OR word_chars > 15 * n_words OR 10 * n_dup_lines > 3 * n_lines OR 2 * upper_letters > ascii_letters
    OR 10 * lettered < 8 * n_words) AS kept
FROM c
"""

_OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
      FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
g AS (SELECT lang, k, list_slice(w, i, i + k - 1) AS ws
      FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (VALUES (1), (2), (3)) AS t(k))),
f AS MATERIALIZED (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, f
      FROM (SELECT lang, k, array_to_string(ws, ' ') AS phrase, count(*) AS f FROM g GROUP BY lang, k, phrase)),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT c.lang, c.phrase, c.k, c.f AS a, cut, x.f AS l, y.f AS r,
           ((1000000::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f))::BIGINT AS score
         FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) AS c
         JOIN f AS x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(c.ws, 1, cut), ' ')
         JOIN f AS y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(c.ws, cut + 1, c.k), ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_of AS (SELECT DISTINCT c.lang, array_to_string(list_slice(c.ws, i, i + 1), ' ') AS phrase, c.f AS longer
             FROM c, (VALUES (1), (2)) AS t(i) WHERE c.k = 3),
dropped AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN inner_of AS i ON i.lang = c.lang AND i.phrase = c.phrase WHERE 100 * longer >= 50 * c.f)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank, s.phrase, a, l, r, n, score
FROM lowest AS s JOIN n ON n.lang = s.lang
WHERE NOT EXISTS (SELECT 1 FROM dropped AS x WHERE x.lang = s.lang AND x.phrase = s.phrase)
QUALIFY rank <= 2000
"""


def checks() -> dict[str, str]:
    return {"op2_quality_rules": _OP2, "op12_phrase_collocations": _OP12}
