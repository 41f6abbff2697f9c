"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from isohypsa.llm import licenses
from isohypsa.llm.lines import MIN_CHARS, SITES
from isohypsa.llm.quality import LATIN, MARKS, RULES, STOP_WORDS, TOLD, WINDOW

WS = r"[\x20\x09-\x0D]+"


def words_of(text: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '{WS}'), lambda x: x <> '')"


def quality_rules() -> str:
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    broken = " OR ".join(f"{r.measure} {op} {v}" for r in RULES for op, v in (("<", r.low), (">", r.high)) if v is not None)
    return f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') AS t, {words_of('text')} AS w FROM documents
), win AS (
  SELECT doc_id, i, list_aggregate(w[i:i + {WINDOW - 1}], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW} + 2)) AS i FROM d)
), twice AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range({WINDOW}) r(k) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(c.n, 0) AS n_repeat_words,
    length(t) - length(regexp_replace(t, '{LATIN}', '', 'g')) AS latin,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l,
    len(list_filter(w, lambda x: trim(lower(x), '{MARKS}') IN ({stops}))) AS stops,
    len(list_filter(w, lambda x: length(x) > 1 AND upper(x) = x AND lower(x) <> x)) AS capitals
  FROM d LEFT JOIN covered c USING (doc_id)
), r AS (
  SELECT *, len(l) - len(list_distinct(l)) AS n_dup_lines,
    CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word,
    CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbol_ratio,
    CASE WHEN n_words < {TOLD} OR 2 * latin < word_chars THEN 1 ELSE stops / n_words END AS stop_ratio,
    CASE WHEN n_words > 0 THEN capitals / n_words ELSE 0 END AS capital_ratio,
    CASE WHEN len(l) > 0 THEN (len(l) - len(list_distinct(l))) / len(l) ELSE 0 END AS dup_line_ratio,
    CASE WHEN len(l) > 0 THEN len(list_filter(l, lambda x: regexp_matches(x, '^\\s*[-*•]\\s'))) / len(l) ELSE 0 END AS bullet_ratio,
    CASE WHEN len(l) > 0 THEN len(list_filter(l, lambda x: ends_with(x, '...') OR ends_with(x, '…'))) / len(l) ELSE 0 END AS ellipsis_ratio
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR {broken}) AS kept
FROM r"""


def chat_format() -> str:
    """Turns as they are, and the length of the format by its marks: 9 + 8 + 8 characters a block, 8 between turns, one for
    every backslash that an escape adds."""
    control = r"[<\[]\\*(\||/?s>|/?INST\]|/?SYS>>)"
    extra = f"len(regexp_extract_all(text, '{control}')) + len(regexp_extract_all(role, '{control}')) * (fresh::INT)"
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), o AS (
  SELECT *, row_number() OVER w AS n, coalesce(lag(role) OVER w <> role, TRUE) AS fresh FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(text) + 8 + CASE WHEN fresh THEN length(role) + 17 ELSE 0 END + {extra})::BIGINT AS formatted_chars
FROM o GROUP BY conv_id"""


def license_scan(documents: str = "documents") -> str:
    """Votes are counted by distinct places of the passage, in the whole run of diagonals or, where that is too long, from each diagonal as far as a span reaches."""
    width = licenses.STRETCH - 1 + 1e-6
    phrases = [(i, label, True, i < len(licenses.BASE), t) for i, (label, t) in enumerate(licenses.BASE + licenses.PHRASES)]
    passages = [(len(phrases) + i, label, False, False, t) for i, (label, t) in enumerate(licenses.PASSAGES)]
    rows = ", ".join(f"({i}, '{label}', {exact}, {base}, '{text}')" for i, label, exact, base, text in phrases + passages)
    common = ", ".join(f"'{w}'" for w in licenses.COMMON)
    words = lambda t: f"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH t AS MATERIALIZED (
  SELECT *, {words('text')} AS w FROM (VALUES {rows}) v(template, label, exact, base, text)
), tp AS (
  SELECT *, count(*) OVER (PARTITION BY template) AS votes FROM (
    SELECT template, label, exact, base, len(w) AS length, place, w[place + 1] AS a, w[place + 2] AS b
    FROM (SELECT *, unnest(range(len(w) - 1)) AS place FROM t))
  WHERE exact OR NOT (a IN ({common}) AND b IN ({common}))
), d AS MATERIALIZED (
  SELECT doc_id, {words("coalesce(text, '')")} AS w FROM {documents}
), p AS (
  SELECT doc_id, pos, w[pos + 1] AS a, w[pos + 2] AS b FROM (SELECT doc_id, w, unnest(range(len(w) - 1)) AS pos FROM d)
), g AS (
  SELECT doc_id, template, label, exact, base, length, votes, pos - place AS diagonal, count(*) AS got, min(pos) AS lo, max(pos) AS hi
  FROM p JOIN tp USING (a, b) GROUP BY ALL
), v AS MATERIALIZED (
  SELECT doc_id, template, place, pos, pos - place AS diagonal FROM p JOIN tp USING (a, b)
), r AS MATERIALIZED (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS run FROM (
    SELECT *, CASE WHEN exact OR diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= {licenses.BAND} THEN exact::INT ELSE 1 END AS fresh
    FROM g WHERE NOT exact OR got = votes)
), m AS (
  SELECT r.doc_id, template, label, base, run, count(DISTINCT place) / any_value(votes) AS cover, min(pos) AS lo, max(pos) + 1 AS hi
  FROM r JOIN v USING (doc_id, template, diagonal) GROUP BY ALL
  HAVING any_value(exact) OR (count(DISTINCT place) / any_value(votes) >= {licenses.COVER} AND max(pos) + 1 - min(pos) < {licenses.STRETCH} * any_value(length))
), o AS (
  SELECT * FROM r ANTI JOIN m USING (doc_id, template, run)
), x AS MATERIALIZED (
  SELECT a.doc_id, a.template, a.label, a.base, a.run, a.diagonal, a.length, count(DISTINCT place) / any_value(a.votes) AS cover, min(pos) AS lo, max(pos) + 1 AS hi
  FROM o a JOIN o b ON a.doc_id = b.doc_id AND a.template = b.template AND a.run = b.run AND b.diagonal / b.length BETWEEN a.diagonal / a.length AND a.diagonal / a.length + {width}
  JOIN v ON v.doc_id = b.doc_id AND v.template = b.template AND v.diagonal = b.diagonal GROUP BY ALL
  HAVING count(DISTINCT place) / any_value(a.votes) >= {licenses.COVER} AND max(pos) + 1 - min(pos) < {licenses.STRETCH} * any_value(a.length)
), s AS (
  SELECT doc_id, label, base, lo, cover FROM m UNION ALL
  SELECT a.doc_id, any_value(a.label), any_value(a.base), any_value(a.lo), any_value(a.cover)
  FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.template = b.template AND a.run = b.run AND b.diagonal / b.length BETWEEN a.diagonal / a.length - {width + 1e-6} AND a.diagonal / a.length + {width + 1e-6}
  GROUP BY a.doc_id, a.template, a.run, a.diagonal
  HAVING max((b.cover, b.lo - b.hi, b.lo, b.hi, b.diagonal)) = any_value((a.cover, a.lo - a.hi, a.lo, a.hi, a.diagonal))
)
SELECT d.doc_id, any_value(len(d.w)) AS n_words, count(*) FILTER (base) AS n_base, min(lo) FILTER (base) AS first_word, max(lo) FILTER (base) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels,
  coalesce(max(cover), 0)::DOUBLE AS score
FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id"""


def nearest_vectors() -> str:
    return """
WITH v AS MATERIALIZED (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5"""


def line_spread(documents: str = "documents", sites: int = SITES) -> str:
    """Exact counts of sites per line; ids are unique in the tables that this is held against."""
    trim = r"trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    return f"""
WITH l AS MATERIALIZED (
  SELECT doc_id, no, {trim} AS t, line, source FROM (
    SELECT doc_id, coalesce(source, '') AS source, unnest(range(len(string_split(text, chr(10))))) AS no, unnest(string_split(text, chr(10))) AS line FROM {documents})
), s AS (
  SELECT t, min((doc_id, no)) AS first FROM l WHERE length(t) >= {MIN_CHARS} GROUP BY t HAVING count(DISTINCT source) >= {sites}
), c AS (
  SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY no) FILTER (s.t IS NULL OR (doc_id, no) = first) AS text,
    count(*) FILTER (s.t IS NOT NULL AND (doc_id, no) <> first) AS gone
  FROM l LEFT JOIN s ON l.t = s.t GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN gone > 0 THEN coalesce(c.text, '') ELSE d.text END AS text, coalesce(n, 0) AS n_lines, coalesce(gone, 0) AS n_removed,
  coalesce(gone > 0 AND NOT regexp_matches(coalesce(c.text, ''), '[^\\x20\\x09-\\x0D]'), FALSE) AS emptied
FROM {documents} d LEFT JOIN c USING (doc_id)"""


def fill_in_middle() -> str:
    """Tokens by a regular expression; the cuts are the lengths of the first tokens together. What is restored must be the text."""
    token = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
    number = lambda k: f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT"
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), u AS (
  SELECT doc_id, t, {number(0)} AS h1, {number(1)} AS h2, {number(2)} AS h3, {number(3)} AS h4,
    list_transform(regexp_extract_all(t, '{token}'), lambda x: length(x)) AS w FROM d
), c AS (
  SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
  SELECT *, coalesce(list_sum(w[1:a]), 0)::BIGINT AS low, coalesce(list_sum(w[1:b]), 0)::BIGINT AS high FROM c
), o AS (
  SELECT *, '<P>' || substr(t, 1, low) AS prefix, '<M>' || substr(t, low + 1, high - low) AS middle, '<S>' || substr(t, high + 1) AS suffix FROM p
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN suffix || prefix || middle ELSE prefix || suffix || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM o"""


def hard_negatives() -> str:
    return """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_dot_product(a.e, r.e)::BIGINT AS score
  FROM v a JOIN v r ON a.vec_id <> r.vec_id AND len(a.e) = len(r.e) WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
