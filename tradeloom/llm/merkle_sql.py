"""DuckDB SQL of the Merkle manifest, level by level."""

from __future__ import annotations


def _levels(name: str, start: str, levels: int) -> str:
    """Nodes of each level (key, idx, h, n) from the table ``start``, and each level's runs with their digests in order."""
    out = []
    for d in range(levels):
        here = start if d == 0 else f"{name}{d}"
        out.append(f"{name}r{d} AS (SELECT key, idx // 16 AS run, max(n) AS n, list(h ORDER BY idx) AS hs FROM {here} GROUP BY key, idx // 16)")
        out.append(f"{name}{d + 1} AS (SELECT key, run AS idx, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h, (n + 15) // 16 AS n FROM {name}r{d})")
    return ",\n".join(out)


def _paths(name: str, start: str, runs: str, levels: int, key: str = "key") -> str:
    """From (i, f, p): a leaf's index, folded digest and proof so far, up the levels."""
    out = []
    for d in range(levels):
        here = start if d == 0 else f"{name}{d}"
        left = "array_to_string(hs[:i % 16], '')"
        right = "array_to_string(hs[i % 16 + 2:], '')"
        out.append(
            f"{name}{d + 1} AS (SELECT a.* EXCLUDE (i, f, p), i // 16 AS i, CASE WHEN r.n = 1 THEN f ELSE sha256({left} || f || {right}) END AS f,"
            f" CASE WHEN r.n = 1 THEN p ELSE p || {left} || {right} END AS p FROM {here} a JOIN {runs}r{d} r ON a.{key} = r.key AND a.i // 16 = r.run)"
        )
    return ",\n".join(out)


def manifest_sql(levels: int = 5) -> str:
    """For up to 16**levels rows a source and as many sources."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    step = "(SELECT v, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS c FROM {})"
    table = "(SELECT range AS v, range AS c FROM range(256))"
    for _ in range(8):
        table = step.format(table)
    return f"""
WITH RECURSIVE bytes AS (SELECT v, c FROM {table}),
crc AS (
  SELECT DISTINCT CAST(doc_id AS VARCHAR) AS s, 1 AS pos, CAST(4294967295 AS BIGINT) AS c FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT s, pos + 1, xor(crc.c >> 8, bytes.c) FROM crc JOIN bytes ON bytes.v = xor(crc.c, ascii(substr(s, pos, 1))) & 255 WHERE pos <= length(s)
),
sums AS (SELECT s, xor(c, 4294967295) AS crc FROM crc WHERE pos = length(s) + 1),
leaves AS (
  SELECT doc_id, coalesce('1' || source, '0') AS key, {leaf("text")} AS h, CASE WHEN crc % 5 = 0 THEN {leaf(lower)} END AS changed
  FROM documents LEFT JOIN sums ON s = CAST(doc_id AS VARCHAR)
),
s0 AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY key) AS n FROM leaves
),
{_levels("s", "s0", levels)},
t0 AS (SELECT '' AS key, key AS source, row_number() OVER (ORDER BY key) - 1 AS idx, count(*) OVER () AS n, h FROM s{levels}),
{_levels("t", "t0", levels)},
p0 AS (SELECT doc_id, key, h AS leaf, idx AS i, coalesce(changed, h) AS f, '' AS p FROM s0),
{_paths("p", "p0", "s", levels)},
q0 AS (SELECT doc_id, leaf, t0.h AS subroot, '' AS key, t0.idx AS i, f, p FROM p{levels} JOIN t0 ON t0.source = p{levels}.key),
{_paths("q", "q0", "t", levels)}
SELECT doc_id, leaf, subroot, t{levels}.h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = t{levels}.h AS verified
FROM q{levels}, t{levels}
"""
