"""DuckDB SQL with the rows of query op11, for small tables."""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || " + "{0})"
# CRC-32 of a decimal id: eight shifts a character, which is mixed in before the first of them.
_STEPS = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1]))"
_MIXED = "(CASE WHEN x >= 0 THEN xor(acc, x) ELSE acc END)"
_CRC = f"xor(CAST(4294967295 AS BIGINT), list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {_STEPS}), lambda acc, x: CASE WHEN {_MIXED} & 1 = 1 THEN xor({_MIXED} >> 1, CAST(3988292384 AS BIGINT)) ELSE {_MIXED} >> 1 END))"

OP11 = f"""WITH RECURSIVE leaf_v AS (SELECT doc_id, source, {_LEAF.format(_FIELD.format("text"))} AS leaf,
    CASE WHEN {_CRC} % 2 = 0 THEN {_LEAF.format(_FIELD.format("replace(text, chr(10), '')"))} END AS other FROM documents),
  rank_v AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, other NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaf_v),
  node_v AS (SELECT tree, 0 AS lvl, pos, n, leaf AS d FROM rank_v
    UNION ALL SELECT tree, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY pos)) FROM node_v WHERE n > 1 GROUP BY tree, lvl, pos // 3, n),
  sub_v AS (SELECT tree, d FROM node_v WHERE n = 1),
  top_v AS (SELECT 0 AS lvl, tree AS pos, (SELECT count(*) FROM sub_v) AS n, d FROM sub_v
    UNION ALL SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY pos)) FROM top_v WHERE n > 1 GROUP BY lvl, pos // 3, n),
  fold_v AS (SELECT tree, pos AS leaf_pos, 0 AS lvl, pos, n, coalesce(other, leaf) AS d, '' AS said FROM rank_v
    UNION ALL SELECT f.tree, leaf_pos, f.lvl + 1, f.pos // 3, (f.n + 2) // 3, sha256(string_agg(CASE WHEN s.pos = f.pos THEN f.d ELSE s.d END, '' ORDER BY s.pos)), any_value(f.said) || coalesce(string_agg(s.d, '' ORDER BY s.pos) FILTER (s.pos <> f.pos), '')
    FROM fold_v f JOIN node_v s ON s.tree = f.tree AND s.lvl = f.lvl AND s.pos // 3 = f.pos // 3 WHERE f.n > 1 GROUP BY f.tree, leaf_pos, f.lvl, f.pos, f.n),
  over_v AS (SELECT tree, leaf_pos, 0 AS lvl, tree AS pos, (SELECT count(*) FROM sub_v) AS n, d, said FROM fold_v WHERE n = 1
    UNION ALL SELECT f.tree, leaf_pos, f.lvl + 1, f.pos // 3, (f.n + 2) // 3, sha256(string_agg(CASE WHEN s.pos = f.pos THEN f.d ELSE s.d END, '' ORDER BY s.pos)), any_value(f.said) || coalesce(string_agg(s.d, '' ORDER BY s.pos) FILTER (s.pos <> f.pos), '')
    FROM over_v f JOIN top_v s ON s.lvl = f.lvl AND s.pos // 3 = f.pos // 3 WHERE f.n > 1 GROUP BY f.tree, leaf_pos, f.lvl, f.pos, f.n),
  root_v AS (SELECT d AS root FROM top_v WHERE n = 1)
SELECT doc_id, leaf, s.d AS subroot, root, sha256(o.said) AS proof_sha256, o.d AS folded_root, o.d = root AS verified
FROM rank_v r JOIN sub_v s USING (tree) JOIN over_v o ON o.tree = r.tree AND o.leaf_pos = r.pos AND o.n = 1, root_v"""
