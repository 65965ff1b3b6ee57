"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations


def _unit(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13))::BIGINT"


def _draw(path: str, weight: float) -> str:
    return f"(-ln(({_unit("'7'", f"'{path}'", 'k')} + 0.5) / 4503599627370496.0) / {weight})"


def _pick(options: list[tuple[str, float, str]]) -> str:
    """The result of the least draw; options: path, weight and the SQL of the result."""
    if len(options) == 1:
        return options[0][2]
    least = "least(" + ", ".join(_draw(p, w) for p, w, _ in options) + ")"
    return "CASE " + " ".join(f"WHEN {_draw(p, w)} = {least} THEN {r}" for p, w, r in options) + " END"


def _tree(regions: int) -> str:
    def rack(r: int, k: int) -> str:
        return _pick([(f"/{r}/{k}/{s}", 1.0, str(s)) for s in range(r * 4 + k * 2, r * 4 + k * 2 + 2)])

    grid = [(f"/{r}", 4.0, _pick([(f"/{r}/{k}", 2.0, rack(r, k)) for k in range(2)])) for r in range(2)]
    return _pick(grid + [("/2", 1.0, "8")] * (regions > 2))


#: The table of CRC-32 has the reversed polynomial EDB88320, eight halvings per entry.
SHARDING = f"""
WITH RECURSIVE halve(i, n, v) AS (
  SELECT range::BIGINT, 0, range::BIGINT FROM range(256)
  UNION ALL
  SELECT i, n + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM halve WHERE n < 8),
crc AS (SELECT list(v ORDER BY i) t FROM halve WHERE n = 8),
keyed AS (
  SELECT *, coalesce(doc_id::VARCHAR, 'null') k FROM documents),
placed AS (
  SELECT doc_id, (coalesce(octet_length(encode(text)), 0) + 1)::BIGINT size,
    CASE WHEN text IS NOT NULL THEN xor(4294967295, list_reduce(
      list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT),
      lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]), 4294967295::BIGINT)) END text_crc32,
    ({_tree(2)})::INTEGER shard, ({_tree(3)})::INTEGER grown_shard,
    substr(md5('slot|' || k), 1, 3) part
  FROM keyed CROSS JOIN crc)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY part, doc_id, size, text_crc32) - 1)::BIGINT AS slot, grown_shard
FROM placed"""

EXACT_DEDUP = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) len, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') norm FROM documents),
r AS (
  SELECT *, row_number() OVER w rn, first_value(doc_id) OVER w keep_id, count(*) OVER (PARTITION BY norm) group_size
  FROM n WINDOW w AS (PARTITION BY norm ORDER BY len DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, rn = 1 AS kept, sha256(norm) AS text_sha256 FROM r"""

MIXING = rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT size,
    md5(coalesce(text, '')) digest, {_unit("'11'", "coalesce(doc_id::VARCHAR, 'null')")} h
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] w, 2.0::DOUBLE * source_size cap FROM totals),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM weighed),
goal AS (
  SELECT source, source_size, least(cap, coalesce(w * (SELECT lvl FROM levels WHERE cap / w > lvl ORDER BY cap / w LIMIT 1), cap)) target FROM levels),
dealt AS (
  SELECT s.*, source_size, target, (h // 32) % greatest(1, (SELECT sum(source_size)::BIGINT FROM goal) // 1048576) cell
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source, cell ORDER BY h, doc_id, size, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM dealt),
cells AS (
  SELECT source, cell, sum(size)::BIGINT cell_words, ceil(sum(size) / 128.0)::BIGINT blocks, any_value(target) target, any_value(source_size) source_size
  FROM dealt GROUP BY source, cell HAVING sum(size) > 0),
ideal AS (SELECT *, round(target / source_size * blocks * 1000000)::BIGINT v FROM cells),
seats AS (SELECT *, round(sum(v) OVER (PARTITION BY cell) / 1000000.0)::BIGINT total FROM ideal),
quotients AS (
  SELECT source, cell, v, total, k, row_number() OVER (PARTITION BY cell ORDER BY v / (2.0 * k - 1) DESC, source NULLS LAST, k) rn
  FROM (SELECT *, unnest(range(1, 2 * blocks + 1)) k FROM seats)),
won AS (SELECT source, cell, sum(CASE WHEN rn <= total AND v > 0 THEN 1 ELSE 0 END)::BIGINT quota FROM quotients GROUP BY source, cell),
blocks AS (
  SELECT c.source, c.cell, c.blocks, c.cell_words, q.quota, j,
    row_number() OVER (PARTITION BY c.source, c.cell ORDER BY {_unit("'11'", "coalesce('s' || c.source, 'n')", "c.cell::VARCHAR", "j::VARCHAR")}) rn
  FROM (SELECT *, unnest(range(0, blocks)) j FROM cells) c JOIN won q ON c.source IS NOT DISTINCT FROM q.source AND c.cell = q.cell),
taken_blocks AS (
  SELECT source, cell, j, quota // blocks + CASE WHEN rn <= quota % blocks THEN 1 ELSE 0 END times,
    ceil(j * cell_words / blocks::DOUBLE)::BIGINT b0, ceil((j + 1) * cell_words / blocks::DOUBLE)::BIGINT b1, cell_words, blocks
  FROM blocks),
numbered AS (SELECT *, row_number() OVER () row_no FROM placed),
shares AS (
  SELECT row_no, sum(greatest(0, least(pos + size, b1) - greatest(pos, b0)) * times)::BIGINT taken
  FROM numbered p JOIN taken_blocks b ON p.source IS NOT DISTINCT FROM b.source AND p.cell = b.cell AND b.b0 < p.pos + p.size AND b.b1 > p.pos
  GROUP BY row_no)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM numbered LEFT JOIN shares USING (row_no)"""
