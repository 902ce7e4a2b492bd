"""The same results as plain SQL, where SQL can express them."""

from __future__ import annotations

from gavel.llm import line_dedup, mixing, quality

_WORD = r"[^\x20\x09-\x0D]+"
_WHITE = r"[\x20\x09-\x0D]"

# Lines of distinct text with their earliest place; two lines of enough tokens match if
# they are equal once a token is left out at the same place of both, or of one of them.
LINE_DEDUP = f"""
WITH body AS (
  SELECT doc_id, text, hash(text) AS text_hash, string_split(text, chr(10)) AS pieces
  FROM documents),
lines AS (
  SELECT doc_id, text_hash, no, line FROM (
    SELECT doc_id, text_hash, unnest(range(len(pieces))) AS no,
           trim(unnest(pieces), ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line
    FROM body WHERE doc_id IS NOT NULL AND text IS NOT NULL) WHERE line <> ''),
firsts AS (
  SELECT line, min({{'doc': doc_id, 'no': no}}) AS start, string_split(line, ' ') AS tokens
  FROM lines GROUP BY line),
long AS (SELECT * FROM firsts WHERE len(tokens) >= {line_dedup.MIN_TOKENS}),
cut AS (
  SELECT line, start, pos, md5(array_to_string(tokens[:pos] || tokens[pos + 2:], ' ')) AS rest
  FROM (SELECT *, unnest(range(len(tokens))) AS pos FROM long)),
whole AS (SELECT line, start, md5(line) AS rest FROM long),
near AS (
  SELECT line, min(start) OVER (PARTITION BY rest, pos) AS near FROM cut
  UNION ALL
  SELECT c.line, w.start FROM cut c JOIN whole w USING (rest)
  UNION ALL
  SELECT w.line, c.start FROM cut c JOIN whole w USING (rest)),
earliest AS (
  SELECT line, min(near) AS earliest FROM (
    SELECT line, near FROM near UNION ALL SELECT line, start FROM firsts) GROUP BY line),
gone AS (
  SELECT DISTINCT doc_id, text_hash, no FROM lines JOIN earliest USING (line)
  WHERE {{'doc': doc_id, 'no': no}} > earliest),
lost AS (SELECT doc_id, text_hash, list(no) AS numbers FROM gone GROUP BY ALL)
SELECT b.doc_id, CAST(coalesce(len(pieces), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(numbers), 0) AS BIGINT) AS n_removed,
       CASE WHEN numbers IS NULL THEN text ELSE coalesce(array_to_string(
         [pieces[i + 1] for i in range(len(pieces)) if NOT list_contains(numbers, i)], chr(10)), '')
       END AS text
FROM body b LEFT JOIN lost l ON b.doc_id = l.doc_id AND b.text_hash = l.text_hash
"""

_FAILS = rf"""
(2 * length(regexp_replace(line, '[^#*$%&<>]+', '', 'g')) >= n
 OR 2 * length(regexp_replace(line, '[^!]+', '', 'g')) >= n
 OR (length(regexp_replace(line, '[^|]+', '', 'g')) >= 4
     AND 4 * length(regexp_replace(line, '[^|]+', '', 'g')) >= n)
 OR (n >= 3 AND NOT regexp_matches(line, '[{quality.MARKS}]'))
 OR regexp_matches(line, '(?i){quality.BOILERPLATE}'))"""

QUALITY = rf"""
WITH docs AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT k, doc_id, text, regexp_extract_all(text, '{_WORD}') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines
  FROM docs),
windows AS (
  SELECT k, i, array_to_string(w[i:i + {quality.WINDOW - 1}], ' ') AS word_window
  FROM (SELECT k, w, unnest(range(1, len(w) - {quality.WINDOW - 2})) AS i FROM words)),
repeated AS (
  SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, word_window) AS n FROM windows)
  WHERE n > 1),
covered AS (
  SELECT k, count(DISTINCT i + d) AS n_repeat_words
  FROM repeated, range({quality.WINDOW}) AS r(d) GROUP BY k),
judged AS (
  SELECT k, line, len(regexp_extract_all(line, '{_WHITE}+')) + 1 AS n,
         length(regexp_replace(line, '{_WHITE}+', '', 'g')) AS chars
  FROM (SELECT k, unnest(lines) AS line FROM words)),
lost AS (SELECT k, sum(chars) AS lost_chars FROM judged WHERE {_FAILS} GROUP BY k),
measured AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(lost_chars, 0) AS BIGINT) AS lost_chars
  FROM words LEFT JOIN covered USING (k) LEFT JOIN lost USING (k)),
based AS (
  SELECT *, n_words < {quality.MIN_WORDS}
            OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed
  FROM measured)
SELECT *, NOT base_failed AND lost_chars <= {quality.MAX_LOST} * word_chars AS kept FROM based
"""

URL_FILTER = r"""
WITH rules(rule, rule_host, rule_path, verdict) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
         ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
cut AS (
  SELECT row_number() OVER () AS k, page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS u
  FROM pages),
parts AS (
  SELECT k, page_id, lower(regexp_extract(u, '^[^/?#]*')) AS host,
         regexp_extract(u, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
best AS (
  SELECT k, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host))
                           AND starts_with(path, rule_path) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN best USING (k)
"""

_BLOCK = f"substr(md5('{mixing.SEED}|' || key), 1, {mixing.BLOCK_DIGITS})"
_BLOCK_KEY = f"md5('{mixing.SEED}|' || epoch || '|block|' || {_BLOCK})"
_DOC_KEY = f"md5('{mixing.SEED}|' || epoch || '|row|' || key)"

MIX_SOURCES = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, coalesce(CAST(doc_id AS VARCHAR), 'null') AS key,
         coalesce('=' || source, 'null') AS src,
         CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS n_tokens
  FROM documents),
totals AS (SELECT src, sum(n_tokens) AS tokens FROM docs GROUP BY src HAVING sum(n_tokens) > 0),
bounds AS (SELECT max(tokens) AS most, max(tokens) / min(tokens) AS ratio FROM totals),
bisect(step, low, high) AS (
  SELECT 0, CASE WHEN pow(ratio, 1.0) <= {mixing.MAX_REPEATS} THEN -1.0 ELSE 0.0 END::DOUBLE,
         CASE WHEN pow(ratio, 1.0) <= {mixing.MAX_REPEATS} THEN 0.0 ELSE 1.0 END::DOUBLE FROM bounds
  UNION ALL
  SELECT step + 1,
         CASE WHEN low < 0 OR pow(ratio, 1 - (low + high) / 2) <= {mixing.MAX_REPEATS}
              THEN low ELSE (low + high) / 2 END,
         CASE WHEN low < 0 THEN high
              WHEN pow(ratio, 1 - (low + high) / 2) <= {mixing.MAX_REPEATS}
              THEN (low + high) / 2 ELSE high END
  FROM bisect, bounds WHERE step < {mixing.ROUNDS}),
rates AS (
  SELECT src, tokens, pow(CAST(most AS DOUBLE) / tokens,
                          1 - (SELECT high FROM bisect WHERE step = {mixing.ROUNDS})) AS repeats
  FROM totals, bounds),
plan AS (
  SELECT src, CAST(floor(repeats) AS INT) AS epochs,
         CAST(floor((repeats - floor(repeats)) * tokens) AS BIGINT) AS budget FROM rates),
every AS (
  SELECT d.*, unnest(range(0, coalesce(epochs, 1) + 1)) AS epoch, coalesce(epochs, 1) AS epochs,
         coalesce(budget, 0) AS budget
  FROM docs d LEFT JOIN plan USING (src)),
keyed AS (SELECT *, {_BLOCK} AS block, {_BLOCK_KEY} || {_DOC_KEY} AS order_key FROM every),
run AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY src, epoch ORDER BY order_key
                                RANGE UNBOUNDED PRECEDING)
            - sum(n_tokens) OVER (PARTITION BY src, epoch, order_key) AS before
  FROM keyed)
SELECT doc_id, source, n_tokens, CAST(epoch AS BIGINT) AS epoch, block, order_key
FROM run WHERE epoch < epochs OR before < budget
"""

def _levels(name: str, key: str, levels: int) -> str:
    """Nodes of the levels 1 to ``levels`` above those of level 0; a last node just stays."""
    made = []
    for i in range(levels):
        made.append(f"""
{name}{i + 1} AS (
  SELECT *, CASE WHEN was = 1 THEN kids[1] ELSE sha256(array_to_string(kids, '')) END AS d FROM (
    SELECT {key}, nth // 16 AS nth, n AS was, (n + 15) // 16 AS n, list(d ORDER BY nth) AS kids
    FROM {name}{i} GROUP BY {key}, nth // 16, n))""")
    return ",".join(made)


def _ways(name: str, key: str, levels: int, nth: str) -> tuple[list[str], list[str], list[str]]:
    """Joins with the runs that hold a row, its siblings there, and the steps of folding."""
    joins, rest, steps = [], [], []
    for i in range(1, levels + 1):
        run, digit = f"{name}{i}", f"({nth} // {16 ** (i - 1)} % 16)"
        joins.append(f"JOIN {run} ON {run}.{key} = r.{key} AND {run}.nth = {nth} // {16 ** i}")
        before, after = (f"array_to_string({run}.kids[:{digit}], '')",
                         f"array_to_string({run}.kids[{digit} + 2:], '')")
        rest.append(f"CASE WHEN {run}.was = 1 THEN '' ELSE {before} || {after} END")
        steps.append(f"CASE WHEN {run}.was = 1 THEN h ELSE sha256({before} || h || {after}) END")
    return joins, rest, steps


def _merkle(levels: int = 6, upper: int = 4) -> str:
    """The manifest with levels for 16^6 rows a source and 16^4 sources."""
    joins, rest, steps = _ways("g", "grp", levels, "r.rank")
    more, rest2, steps2 = _ways("t", "one", upper, "r.pos")
    fields = "\n || ".join(
        f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
        for c in ("doc_id", "source", "lang", "n_chars"))

    def field(text: str) -> str:
        return f"sha256({fields} || coalesce(strlen({text}) || ':' || {text}, '-'))"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    folds, h = [], "claimed"
    for i, step in enumerate([*steps, *steps2]):
        folds.append(f"f{i + 1} AS (SELECT r.*, {step.replace(' h ', f' {h} ')} AS h{i + 1} FROM f{i} r "
                     f"{([*joins, *more])[i]})")
        h = f"h{i + 1}"
    return f"""
WITH crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b:
      CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS v
    FROM (SELECT unnest(range(256)) AS i))),
docs AS (
  SELECT doc_id, coalesce('=' || source, '-') AS grp, {field('text')} AS leaf, {field(lower)} AS changed,
         xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
                                                        lambda c: CAST(ascii(c) AS BIGINT)),
                         lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) AS crc
  FROM documents, crc_table),
ranked AS (
  SELECT *, 1 AS one, CASE WHEN crc % 5 = 0 THEN changed ELSE leaf END AS claimed,
         row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank,
         dense_rank() OVER (ORDER BY grp) - 1 AS pos
  FROM docs),
g0 AS (SELECT grp, rank AS nth, count(*) OVER (PARTITION BY grp) AS n, leaf AS d FROM ranked),
{_levels("g", "grp", levels).lstrip()},
subroots AS (SELECT DISTINCT grp, d FROM g{levels}),
t0 AS (SELECT 1 AS one, row_number() OVER (ORDER BY grp) - 1 AS nth, count(*) OVER () AS n, d
       FROM subroots),
{_levels("t", "one", upper).lstrip()},
proofs AS (
  SELECT r.*, sha256({' || '.join([*rest, *rest2])}) AS proof_sha256
  FROM ranked r {' '.join([*joins, *more])}),
f0 AS (SELECT * FROM proofs),
{', '.join(folds)}
SELECT f.doc_id, f.leaf, s.d AS subroot, t{upper}.d AS root, f.proof_sha256, f.{h} AS folded_root,
       f.{h} = t{upper}.d AS verified
FROM f{len(folds)} f JOIN subroots s USING (grp), t{upper}
"""


MERKLE = _merkle()

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": LINE_DEDUP,
    "op6_quality_rules": QUALITY,
    "op9_url_filter": URL_FILTER,
    "op10_mix_sources": MIX_SOURCES,
    "op12_merkle_manifest": MERKLE,
}
