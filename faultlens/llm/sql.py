"""DuckDB SQL for the rows of the Merkle manifest and of the conversation trie."""

from __future__ import annotations


def crc32(text: str) -> str:
    """Unsigned checksum of an ASCII string, bit by bit (the polynomial is a fixed value)."""
    bits = ("list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: "
            "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)")
    return (f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform("
            f"string_split({text}, ''), lambda d: ascii(d)::BIGINT)), lambda crc, b: {bits}))")


def _field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR)::VARCHAR || ':' || ({value})::VARCHAR, '-')"


_REST = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RUN = "OVER (PARTITION BY {tree} level, spot // 8 ORDER BY spot ROWS BETWEEN {rows})"
_BEFORE, _AFTER = "UNBOUNDED PRECEDING AND 1 PRECEDING", "1 FOLLOWING AND UNBOUNDED FOLLOWING"


def _siblings(table: str, tree: str) -> str:
    before, after = (_RUN.format(tree=tree, rows=r) for r in (_BEFORE, _AFTER))
    return (f"SELECT *, coalesce(string_agg(digest, '') {before}, '') AS before, "
            f"coalesce(string_agg(digest, '') {after}, '') AS after FROM {table} WHERE n > 1")


MANIFEST = f"""WITH RECURSIVE
given AS (SELECT doc_id, lang, sha256({_REST} || {_field('text')}) AS leaf,
  CASE WHEN {crc32('doc_id::VARCHAR')} % 3 = 0 THEN sha256({_REST} || {_field(_LOWER)}) END AS altered
  FROM documents),
leaves AS (SELECT *, row_number() OVER () AS id,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS spot,
  count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree
  FROM given),
nodes AS (SELECT tree, 0 AS level, spot, leaf AS digest, n FROM leaves
  UNION ALL
  SELECT tree, level + 1, spot // 8, sha256(string_agg(digest, '' ORDER BY spot)), any_value((n + 7) // 8)
  FROM nodes WHERE n > 1 GROUP BY tree, level, spot // 8),
subroots AS (SELECT tree, digest AS subroot FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS level, tree AS spot, subroot AS digest, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, spot // 8, sha256(string_agg(digest, '' ORDER BY spot)), any_value((n + 7) // 8)
  FROM tops WHERE n > 1 GROUP BY level, spot // 8),
runs AS ({_siblings('nodes', 'tree,')}),
top_runs AS ({_siblings('tops', '')}),
walk AS (SELECT id, tree, 0 AS level, spot, '' AS proof, coalesce(altered, leaf) AS folded FROM leaves
  UNION ALL
  SELECT id, tree, w.level + 1, w.spot // 8, proof || before || after, sha256(before || folded || after)
  FROM walk w JOIN runs USING (tree, level, spot)),
below AS (SELECT id, tree, arg_max(proof, level) AS proof, arg_max(folded, level) AS folded
  FROM walk GROUP BY id, tree),
top_walk AS (SELECT id, 0 AS level, tree AS spot, proof, folded FROM below
  UNION ALL
  SELECT id, w.level + 1, w.spot // 8, proof || before || after, sha256(before || folded || after)
  FROM top_walk w JOIN top_runs USING (level, spot)),
done AS (SELECT id, arg_max(proof, level) AS proof, arg_max(folded, level) AS folded_root
  FROM top_walk GROUP BY id)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves JOIN done USING (id) JOIN subroots USING (tree)
CROSS JOIN (SELECT digest AS root FROM tops WHERE n = 1) AS r"""


TRIE = f"""WITH
given AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
hashed AS (SELECT conv_id, turn, sha256(strlen(role)::VARCHAR || ':' || role || text) AS digest,
  strlen(text) AS size FROM given),
own AS (SELECT conv_id, digest, size, row_number() OVER (
  PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(digest, 32)) AS spot FROM hashed),
convs AS (SELECT conv_id, count(*) AS n, {crc32('conv_id::VARCHAR')} % 9 AS kept FROM own GROUP BY conv_id),
built AS (SELECT c.conv_id, spot, digest, size
  FROM convs c JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 5 AND spot <= kept
  UNION ALL
  SELECT c.conv_id, least(c.kept, coalesce(h.n, 0)) + spot - c.kept, digest, size
  FROM convs c JOIN own o ON o.conv_id = c.conv_id AND spot > c.kept
  LEFT JOIN convs h ON h.conv_id = c.conv_id - c.conv_id % 5),
members AS (SELECT conv_id, spot AS depth, size,
  string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY spot) AS path FROM built
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
longest AS (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS turns FROM members),
nodes AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
  (count(*) - 1) * any_value(size) AS saved, left(path, length(path) - 64) AS parent,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = turns), ''))
  AS ends_sha256 FROM longest GROUP BY path, depth),
children AS (SELECT parent AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent),
counted AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (path)),
ancestors AS (SELECT unnest(range(depth + 1)) AS above, path, saved, n_children FROM counted),
sums AS (SELECT left(path, 64 * above) AS path, sum(saved) AS saved_tokens,
  count(*) FILTER (n_children = 0) AS n_leaves FROM ancestors GROUP BY 1)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves,
  saved_tokens::BIGINT AS saved_tokens, c.ends_sha256
FROM counted c JOIN sums s ON s.path = c.path LEFT JOIN nodes p ON c.depth > 0 AND p.path = c.parent"""
