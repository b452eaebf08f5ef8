"""SQL of the operators that plain SQL over the raw tables can express."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Ten rounds, one after the other: each assigns all vectors to the centroids of the one before.
_ROUNDS = 10


def _assigned(centroids: str) -> str:
    """The nearest centroid of each vector."""
    square = "list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    return (
        f"SELECT r, any_value(vec_id) AS vec_id, min(struct_pack(d := CAST({square} AS HUGEINT), c := c)) AS best FROM kept, {centroids} GROUP BY r"
    )


def _clustering() -> str:
    parts = [
        "raw AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) = 64)",
        "kept AS MATERIALIZED (SELECT r, vec_id, list_transform(e, lambda x: CAST(floor(1024 * x) AS HUGEINT)) AS v FROM raw "
        "WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, r) - 1 AS c, v AS m FROM "
        "(SELECT *, sha256('3:' || CAST(vec_id AS VARCHAR)) AS h FROM kept ORDER BY h, r LIMIT 8))",
    ]
    for k in range(_ROUNDS):
        parts += [
            f"a{k} AS MATERIALIZED ({_assigned(f'c{k}')})",
            f"s{k} AS MATERIALIZED (SELECT c, i, CAST(sum(x) AS HUGEINT) AS s, count(*) AS n FROM (SELECT a.best.c AS c, unnest(v) AS x, "
            f"unnest(range(1, 65)) AS i FROM a{k} a JOIN kept USING (r)) GROUP BY c, i)",
            # integer division goes towards zero, so what is below zero goes one further where it leaves a rest
            f"m{k} AS MATERIALIZED (SELECT c, list(s // n - CASE WHEN s < 0 AND s % n <> 0 THEN 1 ELSE 0 END ORDER BY i) AS m FROM s{k} GROUP BY c)",
            f"c{k + 1} AS MATERIALIZED (SELECT c, coalesce(m{k}.m, c{k}.m) AS m FROM c{k} LEFT JOIN m{k} USING (c))",
        ]
    last = f"c{_ROUNDS}"
    parts.append(f"placed AS MATERIALIZED (SELECT vec_id, best.c AS c, best.d AS d FROM ({_assigned(last)}))")
    return (
        f"WITH {', '.join(parts)} SELECT vec_id, CAST(c AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, "
        f"CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM placed JOIN {last} USING (c)"
    )


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    bit = "CASE WHEN b & 1 = 1 THEN xor(b >> 1, 3988292384) ELSE b >> 1 END"
    byte = f"list_reduce(list_prepend(xor(a, x), range(8)::BIGINT[]), lambda b, i: {bit})"
    codes = f"list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda a, x: {byte}), 4294967295)"


_TRIE = rf"""
WITH turns AS MATERIALIZED (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k,
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS w
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 20 AS base, {_crc32("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS MATERIALIZED (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY mine, k) AS d, id, w FROM (
    SELECT c.conv_id, 0 AS mine, t.k, t.id, t.w FROM convs c JOIN turns t ON t.conv_id = c.base AND t.k <= c.h
    UNION ALL SELECT c.conv_id, 1, t.k, t.id, t.w FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.k > c.h)),
prefixes AS MATERIALIZED (
  SELECT conv_id, d, w, string_agg(id, '') OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS p FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
node AS MATERIALIZED (SELECT p, min(conv_id) AS conv_id, max(d) AS depth, count(*) AS n, max(w) AS w, left(p, greatest(0, length(p) - 32)) AS up FROM prefixes GROUP BY p),
ends AS (SELECT p, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS s FROM (SELECT conv_id, max_by(p, d) AS p FROM prefixes GROUP BY 1) GROUP BY p),
kids AS MATERIALIZED (SELECT up AS p, count(*) AS k FROM node WHERE depth > 0 GROUP BY up),
above AS (
  SELECT left(n.p, 32 * i) AS p, CAST(kids.k IS NULL AS BIGINT) AS leaf, (n.n - 1) * n.w AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS i FROM node) n LEFT JOIN kids ON kids.p = n.p),
sums AS (SELECT p, sum(leaf) AS leaves, sum(saved) AS saved FROM above GROUP BY p)
SELECT n.conv_id, n.depth, CASE WHEN n.depth > 0 THEN u.conv_id END AS parent_conv_id, n.n AS n_convs, coalesce(kids.k, 0) AS n_children,
  CAST(sums.leaves AS BIGINT) AS n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens, coalesce(ends.s, sha256('')) AS ends_sha256
FROM node n JOIN node u ON u.p = n.up JOIN sums ON sums.p = n.p LEFT JOIN kids ON kids.p = n.p LEFT JOIN ends ON ends.p = n.p
"""

_RULES = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, CASE WHEN source IS NULL THEN 'n' ELSE 'h' || source END || chr(10) AS host FROM documents),
w AS MATERIALIZED (SELECT r, regexp_extract_all(text, '{_WORD}') AS ws FROM d),
lines AS MATERIALIZED (SELECT r, host, unnest(string_split(text, chr(10))) AS line FROM d),
words AS (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM w),
windows AS (SELECT r, i, w || chr(10) || lead(w) OVER o || chr(10) || lead(w, 2) OVER o AS g FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
repeats AS (SELECT r, i FROM windows WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM repeats, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '{_WORD}') GROUP BY r),
clean AS MATERIALIZED (
  SELECT r, host, line, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT r, host, array_to_string(ws, ' ') AS line, len(ws) AS n FROM (SELECT r, host, regexp_extract_all(translate(line, '{_UPPER}', '{_LOWER}'), '{_WORD}') AS ws FROM lines) WHERE len(ws) > 0)
  GROUP BY ALL),
hashed AS MATERIALIZED (SELECT *, left(md5(host || line), 16) AS h FROM clean),
low AS (SELECT r, min(h, 2) AS two FROM hashed GROUP BY r),
families AS (SELECT h, CASE WHEN h = two[1] THEN two[2] ELSE two[1] END AS beside, count(*) AS docs FROM hashed JOIN low USING (r) GROUP BY ALL),
above AS (SELECT h FROM families GROUP BY h HAVING sum(docs) > 10 AND max(docs) * 2 <= sum(docs)),
removed AS (SELECT r, CAST(sum(n) AS BIGINT) AS n FROM hashed JOIN above USING (h) GROUP BY r),
facts AS (
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
    len(ws) - coalesce(removed.n, 0) AS n_left
  FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN covered USING (r) LEFT JOIN removed USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_left,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_left >= 25 AND 2 * n_left >= n_words AS kept
FROM facts
"""

SQL = {"op11_centroid_clustering": _clustering(), "op12_prefix_trie": _TRIE, "op13_quality_rules": _RULES}
