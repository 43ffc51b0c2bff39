"""The same results as the queries', asked of DuckDB."""

from __future__ import annotations

from tablewright.llm.licenses import BREAK, PHRASES, TEMPLATES, THRESHOLD, words_of

_NGRAM_SHARES = dict.fromkeys(range(5, 11), 0.2)
_LONGEST = max(_NGRAM_SHARES)


def _gram(size: int) -> str:
    words = ", ".join(f"w{k}" for k in range(size))
    return f"CASE WHEN w{size - 1} IS NOT NULL THEN concat_ws(' ', {words}) END"


def _later(size: int) -> str:
    """1 where a gram starts that an earlier place of the text has too."""
    return f"(g{size} IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, g{size} ORDER BY i) > 1)::INT AS d{size}"


def _covered(size: int) -> str:
    return f"max(d{size}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW) AS c{size}"


QUALITY_RULES = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
tok AS (
  SELECT doc_id, unnest(words) AS w0, unnest(range(len(words))) AS i
  FROM (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM w)),
led AS (
  SELECT doc_id, i, w0, {", ".join(f"lead(w0, {k}) OVER (PARTITION BY doc_id ORDER BY i) AS w{k}" for k in range(1, _LONGEST))}
  FROM tok),
grams AS (SELECT doc_id, i, w0, {_gram(3)} AS g3, {", ".join(f"{_gram(n)} AS g{n}" for n in _NGRAM_SHARES)} FROM led),
marked AS (
  SELECT doc_id, i, w0, (g3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g3) > 1)::INT AS d3,
         {", ".join(map(_later, _NGRAM_SHARES))}
  FROM grams),
inside AS (SELECT doc_id, w0, {_covered(3)}, {", ".join(map(_covered, _NGRAM_SHARES))} FROM marked),
words AS (
  SELECT doc_id, count(*) AS n_words, sum(length(w0)) AS word_chars, sum(c3) AS n_repeat_words,
         {", ".join(f"sum(c{n} * length(w0)) AS chars{n}" for n in _NGRAM_SHARES)}
  FROM inside GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, sum(length(line)) AS line_chars,
         coalesce(sum(length(line)) FILTER (nth > 1), 0) AS dup_chars
  FROM (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS nth
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
        WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]'))
  GROUP BY doc_id),
base AS (
  SELECT w.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(line_chars, 0) AS line_chars, coalesce(dup_chars, 0) AS dup_chars,
         {", ".join(f"coalesce(chars{n}, 0) AS chars{n}" for n in _NGRAM_SHARES)}
  FROM w LEFT JOIN words USING (doc_id) LEFT JOIN lines USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words
            {" ".join(f"OR chars{n} > {share} * word_chars" for n, share in _NGRAM_SHARES.items())}
            OR dup_chars > 0.2 * line_chars) AS kept
FROM base
"""


_LEADS = ", ".join(f"lead(word, {k}) OVER later" for k in range(1, 50))
SUBSTRING_DEDUP = f"""
WITH tok AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents)),
wide AS (
  SELECT doc_id, i, word, CASE WHEN lead(word, 49) OVER later IS NOT NULL THEN md5(concat_ws(' ', word, {_LEADS})) END AS w
  FROM tok WINDOW later AS (PARTITION BY doc_id ORDER BY i)),
known AS (SELECT doc_id, i, word, (w IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY w))::INT AS again FROM wide),
inside AS (
  SELECT doc_id, i, word, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
  FROM known),
done AS (
  SELECT doc_id, count(*) AS n_words, sum(gone)::BIGINT AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY i) FILTER (gone = 0), '') AS kept
  FROM inside GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN done USING (doc_id)
"""


def license_scan() -> str:
    """Phrases by the words that follow each word; templates against every sentence."""
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    phrases = ", ".join(f"({phrase.split()!r}, '{label}')" for phrase, label in PHRASES.items())
    parts = ((n, x.label, *(sorted(words_of(y)) for y in (x.statement, x.needs, x.bars))) for n, x in enumerate(TEMPLATES))
    statements = ", ".join(f"({n}, '{label}', {words!r}, {needs!r}::VARCHAR[], {bars!r}::VARCHAR[])" for n, label, words, needs, bars in parts)
    ends = BREAK.replace("'", "''")
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS (SELECT doc_id, {lower} AS text FROM documents),
phrases(words, label) AS (VALUES {phrases}),
templates(n, label, words, needs, bars) AS (VALUES {statements}),
tok AS (
  SELECT doc_id, unnest(words) AS w0, unnest(range(len(words))) AS i
  FROM (SELECT doc_id, regexp_extract_all(text, '{word}') AS words FROM d)),
led AS (
  SELECT doc_id, i, w0, lead(w0, 1) OVER later AS w1, lead(w0, 2) OVER later AS w2, lead(w0, 3) OVER later AS w3
  FROM tok WINDOW later AS (PARTITION BY doc_id ORDER BY i)),
places AS (
  SELECT doc_id, i, label FROM led JOIN phrases ON w0 = words[1] AND w1 = words[2]
    AND (len(words) < 3 OR w2 = words[3]) AND (len(words) < 4 OR w3 = words[4])),
base AS (
  SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels
  FROM places GROUP BY doc_id),
blocks AS MATERIALIZED (
  SELECT doc_id, row_number() OVER () AS b, list_distinct(regexp_extract_all(block, '{word}')) AS have
  FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '{ends}')) AS block FROM d)),
shares AS (
  SELECT b, n, count(*) AS shared FROM (SELECT b, unnest(have) AS word FROM blocks)
  JOIN (SELECT n, unnest(words) AS word FROM templates) USING (word) GROUP BY b, n),
met AS (
  SELECT doc_id, label, shared / len(words) AS score FROM shares JOIN templates USING (n) JOIN blocks USING (b)
  WHERE shared >= ceil({THRESHOLD} * len(words) - 1e-9) AND list_has_all(have, needs) AND NOT list_has_any(have, bars)),
more AS (SELECT doc_id, list(DISTINCT label) AS labels, max(score) AS score FROM met GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id)
SELECT d.doc_id, coalesce(counts.n, 0)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ','), '') AS labels,
       coalesce(more.score, 0)::DOUBLE AS score
FROM d LEFT JOIN counts USING (doc_id) LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)
"""


_DIGITS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(h, {5 * k + 1}, 5))::BIGINT // {32 ** (3 - d)}) % 32 + 1, 1)"
    for k in range(8)
    for d in range(4)
)
WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT html, max(page_id) AS response, count(*) AS n FROM p GROUP BY html)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_DIGITS} AS payload_digest,
       CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> response THEN response END AS refers_to
FROM p JOIN g USING (html)
"""


CHAT_FORMAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -1, turn, role, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v (turn, role)),
written AS (SELECT *, regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS body FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>') + length(role) + 1 + length(body) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM written GROUP BY conv_id
"""


COLLOCATIONS = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, words FROM (
    SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS words
    FROM (SELECT coalesce(lang, 'und') AS lang,
                 translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents))),
w AS (SELECT lang, piece, unnest(words) AS w1, unnest(range(len(words))) AS i FROM pieces),
led AS (
  SELECT lang, w1, lead(w1, 1) OVER p AS w2, lead(w1, 2) OVER p AS w3 FROM w WINDOW p AS (PARTITION BY piece ORDER BY i)),
f1 AS (SELECT lang, w1, count(*) AS f FROM led GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM led WHERE w2 IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM led WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
longer AS (
  SELECT lang, w1, w2, max(f) AS f FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL),
cuts AS (
  SELECT c.lang, c.w1 || ' ' || c.w2 AS phrase, c.f AS a, 1 AS k, x.f AS l, y.f AS r
  FROM f2 c JOIN f1 x ON x.lang = c.lang AND x.w1 = c.w1 JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w2
  LEFT JOIN longer g ON g.lang = c.lang AND g.w1 = c.w1 AND g.w2 = c.w2
  WHERE c.f >= 10 AND coalesce(100 * g.f < 50 * c.f, true)
  UNION ALL
  SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, 1, x.f, y.f
  FROM f3 c JOIN f1 x ON x.lang = c.lang AND x.w1 = c.w1 JOIN f2 y ON y.lang = c.lang AND y.w1 = c.w2 AND y.w2 = c.w3
  UNION ALL
  SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, 2, x.f, y.f
  FROM f3 c JOIN f2 x ON x.lang = c.lang AND x.w1 = c.w1 AND x.w2 = c.w2 JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w3),
scored AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
