"""The queries that SQL can express, in DuckDB's dialect."""

from knowspark.llm.license_scan import AGREE, BASE, RARE, TEMPLATES, places

#: Words of a text: no space and none of 0x09 to 0x0D.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = rf"""
WITH docs AS (SELECT doc_id, {_WORDS} AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, unnest(generate_series(1, len(words))) AS i,
             len(words) AS n FROM docs),
windows AS (
  SELECT doc_id, i, n, string_agg(word, ' ') OVER (
    PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS seq FROM w),
again AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY md5(seq)) AS k FROM windows WHERE i <= n - 34)
  WHERE k > 1),
marked AS (
  SELECT w.doc_id, w.i, w.word, max(again.i) OVER (
    PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM w LEFT JOIN again ON w.doc_id = again.doc_id AND w.i = again.i)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words,
       CAST(count(m.i) FILTER (WHERE m.gone) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(m.word, ' ' ORDER BY m.i) FILTER (WHERE NOT m.gone), ''))
         AS kept_sha256
FROM docs d LEFT JOIN marked m ON d.doc_id = m.doc_id GROUP BY d.doc_id, d.words
"""

OP5 = rf"""
WITH RECURSIVE
docs AS (SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') AS w FROM documents),
items AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ')
           ELSE array_to_string(w[i:i + 4], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, least(len(w), 1)))) AS i
        FROM docs)),
sizes AS (SELECT doc_id, count(*) AS n FROM items GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM items a JOIN items b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * k >= 75 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (
  SELECT a, b FROM both_ways
  UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles,
       least(d.doc_id, coalesce(low.m, d.doc_id)) AS component_id,
       least(d.doc_id, coalesce(low.m, d.doc_id)) = d.doc_id AS kept
FROM docs d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN low ON low.a = d.doc_id
"""

OP7 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
    length(text) + length(text) - length(replace(text, '\', ''))
    + 2 * list_sum([(length(text) - length(replace(text, c, ''))) // length(c) FOR c IN
        ['<<SYS>>', '<</SYS>>', '[INST]', '[/INST]', '<s>', '</s>', '[ROLE]', '[/ROLE]', '[/TURN]']])
    + CASE role WHEN 'system' THEN 19 WHEN 'user' THEN 15 WHEN 'assistant' THEN 9
        ELSE length(role) + 22 END AS chars
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
    AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text)
    FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user')
    WHEN before = 'user' THEN role = 'assistant'
    WHEN before IN ('system', 'assistant') THEN role = 'user' ELSE false END) AS valid
FROM sized GROUP BY conv_id
"""

OP8 = r"""
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
spots AS (
  SELECT doc_id, i, n, substr(h, 2 * i - 1, 2) AS byte, md5(substr(h, 2 * i - 1, 100)) AS s
  FROM (SELECT doc_id, h, length(h) // 2 AS n, unnest(generate_series(1, length(h) // 2)) AS i
        FROM docs)),
again AS (SELECT doc_id, i FROM (
            SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS low
            FROM spots WHERE i <= n - 49)
          WHERE low < doc_id),
marked AS (
  SELECT p.doc_id, p.i, p.byte, max(again.i) OVER (
    PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM spots p LEFT JOIN again ON p.doc_id = again.doc_id AND p.i = again.i),
edges AS (SELECT *, gone AND NOT coalesce(
            lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM marked)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes,
       count(e.i) FILTER (WHERE e.gone) AS n_removed, count(e.i) FILTER (WHERE e.opens) AS n_spans,
       sha256(unhex(coalesce(string_agg(e.byte, '' ORDER BY e.i) FILTER (WHERE NOT e.gone), '')))
         AS kept_sha256
FROM docs d LEFT JOIN edges e ON d.doc_id = e.doc_id GROUP BY d.doc_id, d.h
"""

OP6 = rf"""
WITH docs AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
runs AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, seq) > 1 AS again
  FROM (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS seq
        FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i
              FROM docs WHERE len(w) > 7))),
covered AS (
  SELECT doc_id, CAST(sum(least(8, coalesce(after - i, 8))) AS BIGINT) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after
        FROM runs WHERE again) GROUP BY doc_id),
base AS (
  SELECT d.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(c.n, 0) AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(text, chr(10)),
          lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM docs) d
  LEFT JOIN covered c ON c.doc_id = d.doc_id),
rated AS (
  SELECT *, n_symbols / greatest(word_chars, 1) AS r1, n_dup_lines / greatest(n_words, 1) AS r2,
    n_repeat_words / greatest(n_words, 1) AS r3 FROM base),
sketches AS (
  SELECT lang, source, grouping(lang) = 0 AS by_lang, grouping(source) = 0 AS by_source, count(*) AS n,
    least(0.5, greatest(0.05, quantile_disc(r1, 0.5) + 3 * (quantile_disc(r1, 0.75) - quantile_disc(r1, 0.25)))) AS l1,
    least(0.5, greatest(0.05, quantile_disc(r2, 0.5) + 3 * (quantile_disc(r2, 0.75) - quantile_disc(r2, 0.25)))) AS l2,
    least(0.5, greatest(0.25, quantile_disc(r3, 0.5) + 3 * (quantile_disc(r3, 0.75) - quantile_disc(r3, 0.25)))) AS l3
  FROM rated GROUP BY GROUPING SETS ((lang, source), (lang), ())),
by_lang AS (
  SELECT l.lang, (l.n * l.l1 + 200 * w.l1) / (l.n + 200) AS l1, (l.n * l.l2 + 200 * w.l2) / (l.n + 200) AS l2,
    (l.n * l.l3 + 200 * w.l3) / (l.n + 200) AS l3
  FROM sketches l CROSS JOIN (SELECT * FROM sketches WHERE NOT by_lang) w WHERE l.by_lang AND NOT l.by_source),
limits AS (
  SELECT g.lang, g.source, (g.n * g.l1 + 200 * b.l1) / (g.n + 200) AS l1,
    (g.n * g.l2 + 200 * b.l2) / (g.n + 200) AS l2, (g.n * g.l3 + 200 * b.l3) / (g.n + 200) AS l3
  FROM sketches g JOIN by_lang b ON b.lang IS NOT DISTINCT FROM g.lang WHERE g.by_source)
SELECT r.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND r1 <= l1 AND r2 <= l2 AND r3 <= l3 AS kept
FROM rated r JOIN limits g ON g.lang IS NOT DISTINCT FROM r.lang AND g.source IS NOT DISTINCT FROM r.source
"""

_TERMS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")

OP11 = rf"""
WITH docs AS (SELECT doc_id, {_TERMS} AS w FROM documents),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
whole AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs,
                 CAST(greatest(sum(len(w)), 1) AS BIGINT) AS n_terms FROM docs),
postings AS (
  SELECT doc_id, n, term, count(*) AS tf
  FROM (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term) CROSS JOIN whole),
worth AS (
  SELECT doc_id, term, weights.w
           * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * n_docs) // n_terms)))) AS s
  FROM postings JOIN weights USING (term) CROSS JOIN whole),
scored AS (SELECT item_id, doc_id, CAST(sum(s) AS BIGINT) AS score
           FROM asked JOIN worth USING (term) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
      FROM scored WHERE score > 0) WHERE rank <= 10
"""

#: CRC-32 of a doc_id's digits, bit by bit.
_CRC = ("xor(list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: "
        "list_transform(range(8), lambda b: CAST((ord(ch) >> b) & 1 AS BIGINT)))), lambda c, b: "
        "xor(c >> 1, (xor(c, b) & 1) * 3988292384), 4294967295), 4294967295)")


def _leaf(text: str) -> str:
    field = "coalesce(CAST(strlen({0}) AS VARCHAR) || ':' || {0}, '-')".format
    return "sha256(" + " || ".join(map(field, (
        "CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text))) + ")"


OP12 = rf"""
WITH RECURSIVE
leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf) AS k,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
         count(*) OVER (PARTITION BY source) AS n,
         dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS sid
  FROM (SELECT doc_id, source, {_leaf("text")} AS leaf,
               CASE WHEN {_CRC} % 5 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
                                                    "'abcdefghijklmnopqrstuvwxyz')")}
               END AS changed FROM documents)),
trees(sid, level, i, n, h) AS (
  SELECT sid, 0, i, n, leaf FROM leaves
  UNION ALL
  SELECT sid, level + 1, i // 16, any_value((n + 15) // 16), sha256(string_agg(h, '' ORDER BY i))
  FROM trees WHERE n > 1 GROUP BY sid, level, i // 16),
upper_tree(level, i, n, h) AS (
  SELECT 0, sid, (SELECT count(*) FROM trees WHERE n = 1), h FROM trees WHERE n = 1
  UNION ALL
  SELECT level + 1, i // 16, any_value((n + 15) // 16), sha256(string_agg(h, '' ORDER BY i))
  FROM upper_tree WHERE n > 1 GROUP BY level, i // 16),
nodes AS MATERIALIZED (
  SELECT sid, level, i, n, h FROM trees WHERE n > 1
  UNION ALL SELECT NULL, level, i, n, h FROM upper_tree WHERE n > 1),
path AS MATERIALIZED (
  SELECT k, level, l.i // CAST(16 ** level AS BIGINT) AS own, l.sid AS tree
  FROM leaves l JOIN (SELECT DISTINCT sid, level FROM nodes WHERE sid IS NOT NULL) t ON t.sid = l.sid
  UNION ALL
  SELECT k, 100 + level, l.sid // CAST(16 ** level AS BIGINT), NULL
  FROM leaves l CROSS JOIN (SELECT DISTINCT level FROM nodes WHERE sid IS NULL) t),
steps AS MATERIALIZED (
  SELECT p.k, p.level, row_number() OVER (PARTITION BY p.k ORDER BY p.level) AS step,
         coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i < own), '') AS before,
         coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i > own), '') AS after
  FROM path p JOIN nodes x ON x.sid IS NOT DISTINCT FROM p.tree AND x.level = p.level % 100
    AND x.i // 16 = p.own // 16
  GROUP BY p.k, p.level),
folds(k, step, h) AS (
  SELECT k, 0, coalesce(changed, leaf) FROM leaves
  UNION ALL
  SELECT f.k, f.step + 1, sha256(s.before || f.h || s.after)
  FROM folds f JOIN steps s ON s.k = f.k AND s.step = f.step + 1),
proofs AS (SELECT k, string_agg(before || after, '' ORDER BY step) AS siblings FROM steps GROUP BY k),
whole AS (SELECT h AS root FROM upper_tree WHERE n = 1)
SELECT doc_id, leaf, t.h AS subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256,
       f.h AS folded_root, f.h = root AS verified
FROM leaves l JOIN (SELECT sid, h FROM trees WHERE n = 1) t ON t.sid = l.sid CROSS JOIN whole
LEFT JOIN proofs p ON p.k = l.k
JOIN (SELECT k, arg_max(h, step) AS h FROM folds GROUP BY k) f ON f.k = l.k
"""

def _op13() -> str:
    """The licence scan over (file, place, word) rows."""
    templates = [(label, text, (text,)) for label, text in BASE] + list(TEMPLATES)
    values = lambda rows: "VALUES " + ", ".join(
        "(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    heads = [(t, label, t < len(BASE), len(text.split()), len(phrases))
             for t, (label, text, phrases) in enumerate(templates)]
    words = [(t, j, w) for t, (_, text, _) in enumerate(templates)
             for j, w in enumerate(text.split())]
    keys = [(t, n, q, k, w, len(phrase.split())) for t, (_, text, phrases) in enumerate(templates)
            for n, phrase in enumerate(phrases) for q in places(phrase, text)
            for k, w in enumerate(phrase.split())]
    return rf"""
WITH template(t, label, base, m, phrases) AS ({values(heads)}),
t_words(t, j, word) AS ({values(words)}),
t_keys(t, phrase, q, k, word, size) AS ({values(keys)}),
files AS MATERIALIZED (
  SELECT doc_id, row_number() OVER () AS f, {_TERMS} AS w FROM documents),
tokens AS MATERIALIZED (
  SELECT f, unnest(w) AS word, unnest(range(len(w))) AS p FROM files),
holds AS (SELECT word, count(DISTINCT f) AS n FROM tokens
          WHERE word IN (SELECT word FROM t_words) GROUP BY word),
rare AS (
  SELECT t, word FROM (
    SELECT t, word, base, row_number() OVER (PARTITION BY t ORDER BY coalesce(n, 0), word) AS place
    FROM (SELECT DISTINCT t, word FROM t_words) JOIN template USING (t) LEFT JOIN holds USING (word))
  WHERE place <= CASE WHEN base THEN 1 ELSE {RARE} END),
origins AS MATERIALIZED (
  SELECT f, t, o FROM (
    SELECT DISTINCT f, t, p - j AS o, word FROM tokens JOIN rare USING (word) JOIN t_words USING (t, word))
  JOIN template USING (t) GROUP BY f, t, o, base
  HAVING count(*) >= CASE WHEN base THEN 1 ELSE {AGREE} END),
stands AS (
  SELECT origins.f, t, o, phrase FROM origins JOIN t_keys USING (t)
  JOIN tokens x ON x.f = origins.f AND x.p = o + q + k AND x.word = t_keys.word
  GROUP BY origins.f, t, o, phrase, q, size HAVING count(*) = size),
labelled AS (SELECT f, t FROM stands JOIN template USING (t) GROUP BY f, t, phrases
             HAVING count(DISTINCT phrase) = phrases),
shares AS (
  SELECT f, max(n / m) AS score FROM (
    SELECT origins.f, t, o, m, base, CAST(count(*) AS DOUBLE) AS n FROM origins JOIN template USING (t)
    JOIN t_words USING (t) JOIN tokens x ON x.f = origins.f AND x.p = o + j AND x.word = t_words.word
    GROUP BY origins.f, t, o, m, base)
  WHERE n = m OR NOT base GROUP BY f),
found AS (SELECT f, count(*) AS n, min(o) AS lo, max(o) AS hi
          FROM stands JOIN template USING (t) WHERE base GROUP BY f),
named AS (
  SELECT f, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels
  FROM labelled JOIN template USING (t) GROUP BY f)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word,
       hi AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0) AS score
FROM files LEFT JOIN found USING (f) LEFT JOIN named USING (f) LEFT JOIN shares USING (f)
"""


OP13 = _op13()

ORACLE = {
    "op1_substring_dedup": OP1,
    "op5_near_dup": OP5,
    "op6_quality_rules": OP6,
    "op7_chat_format": OP7,
    "op8_suffix_dedup": OP8,
    "op11_lexical_search": OP11,
    "op12_merkle": OP12,
    "op13_license_scan": OP13,
}
