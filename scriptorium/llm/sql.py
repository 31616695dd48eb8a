"""DuckDB SQL for the queries that SQL can express. The others have brute-force versions in the tests."""

_SAID = "<|im_end|><|im_start|>assistant ok"
_ESC = r"replace(replace({x}, '\', '\\'), '<|', '<\|')"

CHAT = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_SAID}' UNION ALL SELECT -1, 1, 'assistant', '{_SAID}'
), s AS (
  SELECT *, row_number() OVER w AS n,
         length('<|im_start|>') + length(replace({_ESC.format(x='role')}, chr(10), '\n')) + 1 + length({_ESC.format(x='text')}) + length('<|im_end|>') + 1 AS chars
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), t AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY n) AS upto, count(*) OVER (PARTITION BY conv_id) AS turns,
         max(CASE WHEN role = 'assistant' THEN n ELSE 0 END) OVER (PARTITION BY conv_id) AS last
  FROM s
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY n), '')) AS loss_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN upto ELSE 0 END) + max(CASE WHEN n = turns AND last < turns THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

MIX = r"""
WITH d AS (
  SELECT doc_id, source, size, CASE WHEN size > 0 THEN length(bin(size)) - 1 ELSE -1 END AS class,
         (CAST('0x' || substr(md5('20|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents)
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w FROM d GROUP BY 1
), sl AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS here,
         row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS pos
  FROM s
), sx AS (SELECT *, source_size > 0 AND here * (w / nullif(3 * source_size, 0)) <= 1.0 AS free FROM sl
), st AS (
  SELECT source, source_size, CASE WHEN (SELECT count(*) FROM sx WHERE free) = 0 THEN 3.0::DOUBLE * source_size ELSE least((SELECT arg_min(here, pos) FROM sx WHERE free) * w, (3 * source_size)::DOUBLE) END AS target FROM sx
), k AS (
  SELECT d.source, class, CAST(sum(size) AS BIGINT) AS words, any_value(target) AS target, greatest(1, 16 - class) AS iw
  FROM d JOIN st ON d.source IS NOT DISTINCT FROM st.source GROUP BY 1, 2 HAVING sum(size) > 0
), kl AS (
  SELECT *, (target - coalesce(sum(3 * words) OVER (PARTITION BY source ORDER BY iw DESC, class ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / (sum(words * iw) OVER (PARTITION BY source ORDER BY iw DESC, class ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS here FROM k
), kx AS (SELECT *, arg_min(here, class) FILTER (here * (iw / 3.0::DOUBLE) <= 1.0) OVER (PARTITION BY source) AS level FROM kl
), kp AS (SELECT *, CASE WHEN level IS NULL THEN 3.0::DOUBLE ELSE least(3.0::DOUBLE, level * iw) END AS lam FROM kx
), kq AS (SELECT source, class, CAST(floor(lam) AS BIGINT) AS whole, lam - floor(lam) AS p, target - (sum(CAST(floor(lam) AS BIGINT) * words) OVER (PARTITION BY source))::DOUBLE AS rest FROM kp
), r AS (
  SELECT d.*, coalesce(whole, 0) AS whole, rest, CASE WHEN p > 0 AND size > 0 THEN (u * (1 - p)) / ((1 - u) * p) END AS q
  FROM d LEFT JOIN kq ON d.source IS NOT DISTINCT FROM kq.source AND d.class = kq.class
), o AS (SELECT *, q / (1 + q) AS t FROM r
), c AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY t, coalesce(CAST(doc_id AS VARCHAR), ''), size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM o WHERE t IS NOT NULL
), best AS (
  SELECT source, min(abs(upto - rest)) AS off, any_value(rest) AS rest FROM c GROUP BY 1
), cut AS (
  SELECT c.source, min(upto) AS upto FROM c JOIN best b ON c.source IS NOT DISTINCT FROM b.source AND abs(c.upto - c.rest) = b.off WHERE b.off < b.rest GROUP BY 1
)
SELECT o.doc_id, o.size, st.source_size, st.target,
       CAST(CASE WHEN o.size > 0 THEN o.whole + CASE WHEN c.upto <= cut.upto THEN 1 ELSE 0 END ELSE 0 END * o.size AS BIGINT) AS taken
FROM o JOIN st ON o.source IS NOT DISTINCT FROM st.source
LEFT JOIN (SELECT DISTINCT doc_id, source, size, t, upto FROM c) c ON o.doc_id IS NOT DISTINCT FROM c.doc_id AND o.source IS NOT DISTINCT FROM c.source AND o.size = c.size AND o.t = c.t
LEFT JOIN cut ON o.source IS NOT DISTINCT FROM cut.source
"""

_SEEDS, _ROUNDS = 40, 5


def _clusters() -> str:
    """Lloyd's rounds by comparing every vector with every centroid, a block of common tables for each round."""
    ctes = ["""
kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
)""", f"""
c0 AS (
  SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q FROM (SELECT sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, q FROM kept) ORDER BY h, q LIMIT {_SEEDS}
)"""]
    for k in range(_ROUNDS + 1):
        ctes.append(f"""
a{k} AS (
  SELECT r, min(vec_id) AS vec_id, any_value(v) AS q, arg_min(c, (d, c)) AS c, min(d) AS d
  FROM (SELECT r, vec_id, kept.q AS v, c, list_sum(list_transform(list_zip(kept.q, c{k}.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept, c{k}) GROUP BY r
)""")
        if k < _ROUNDS:
            ctes.append(f"""
s{k} AS (
  SELECT c, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY j) AS q
  FROM (SELECT c, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(q) AS x, unnest(range(64)) AS j FROM a{k}) GROUP BY 1, 2) GROUP BY 1
), c{k + 1} AS (SELECT c, coalesce(s{k}.q, c{k}.q) AS q FROM c{k} LEFT JOIN s{k} USING (c)
)""")
    return f"""WITH {",".join(ctes)}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(z.q, ',')) AS centroid_sha256
FROM a{_ROUNDS} a JOIN c{_ROUNDS} z ON a.c = z.c
"""


CLUSTERS = _clusters()


def _told(*fields: str) -> str:
    return "sha256(" + " || ".join(f"CASE WHEN {f} IS NULL THEN '-' ELSE strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR) END" for f in fields) + ")"


def _tree(name: str, leaves: str) -> str:
    """All nodes of the trees of leaves (tree, pos, d), and for each leaf what stands beside it on each level up."""
    return f"""
{name} AS (
  SELECT 0 AS level, tree, pos, d, count(*) OVER (PARTITION BY tree) AS n FROM {leaves}
  UNION ALL SELECT level + 1, tree, pos // 2, sha256(string_agg(d, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM {name} WHERE n > 1 GROUP BY level, tree, pos // 2
), {name}_up AS (
  SELECT l.tree, l.pos, list(CASE WHEN s.d IS NULL THEN '-' WHEN (l.pos >> v.level) % 2 = 1 THEN 'L' || s.d ELSE 'R' || s.d END ORDER BY v.level) AS up
  FROM {leaves} l JOIN (SELECT DISTINCT level, tree FROM {name} WHERE n > 1) v ON l.tree = v.tree
  LEFT JOIN {name} s ON s.tree = l.tree AND s.level = v.level AND s.pos = xor(l.pos >> v.level, 1) GROUP BY 1, 2
)"""


_CRC = "xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, (a & 1) * 3988292384))), 4294967295)"

MANIFEST = f"""
WITH RECURSIVE l AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS pos FROM (
    SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS tree, {_told("doc_id", "source", "lang", "n_chars", "text")} AS d,
           CASE WHEN n_chars IS NOT NULL AND {_CRC} % 7 = 0 THEN {_told("doc_id", "source", "lang", "(n_chars + 1)", "text")} END AS seen
    FROM documents)
), {_tree("t", "l")}, subs AS MATERIALIZED (
  SELECT '' AS tree, tree AS own, d, row_number() OVER (ORDER BY tree) - 1 AS pos FROM t WHERE n = 1
), {_tree("u", "subs")}, whole AS (
  SELECT doc_id, l.d AS leaf, coalesce(seen, l.d) AS seen, subs.d AS subroot, (SELECT d FROM u WHERE n = 1) AS root, list_concat(coalesce(t_up.up, []), coalesce(u_up.up, [])) AS up
  FROM l JOIN subs ON l.tree = subs.own LEFT JOIN t_up ON t_up.tree = l.tree AND t_up.pos = l.pos LEFT JOIN u_up ON u_up.pos = subs.pos
), folded AS (
  SELECT *, list_reduce(list_concat([seen], up), lambda a, s: CASE s[1] WHEN 'L' THEN sha256(s[2:] || a) WHEN 'R' THEN sha256(a || s[2:]) ELSE sha256(a) END) AS folded_root FROM whole
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(up, lambda s: s[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""

ORACLES: dict[str, str] = {"op2_mix": MIX, "op6_chat": CHAT, "op12_clusters": CLUSTERS, "op13_manifest": MANIFEST}
