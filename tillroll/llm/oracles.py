"""SQL twins, in DuckDB's dialect, of the queries whose whole result SQL can say."""

from __future__ import annotations

from tillroll.llm.manifest import RUN, TAMPER_MOD
from tillroll.llm.resample import BUCKETS, DRAWN_PERCENT, MIN_WORDS, SEED

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: CTE crc(t): the 256 entries of the CRC-32 table (reflected polynomial 0xEDB88320).
_CRC_TABLE = """crc AS (
  SELECT list(list_reduce(range(8), lambda c, k : CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)
              ORDER BY i) AS t FROM range(256) r(i))"""


def _crc(values: str) -> str:
    """CRC-32 of a list of byte values, with the table crc.t at hand."""
    return (
        f"xor(list_reduce(CAST({values} AS BIGINT[]), lambda c, b : xor(c >> 8, crc.t[xor(c & 255, b) + 1]), "
        "4294967295), 4294967295)"
    )


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode({value}))::VARCHAR || ':' || {value}, '-')"


def _leaf(text: str) -> str:
    values = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return f"sha256({' || '.join(map(_field, values))})"


def _levels(name: str, leaves: str) -> str:
    return f"""{name} AS (
  SELECT tree, 0 AS lvl, pos, n, digest FROM {leaves}
  UNION ALL
  SELECT tree, lvl + 1, pos // {RUN}, (max(n) + {RUN - 1}) // {RUN}, sha256(string_agg(digest, '' ORDER BY pos))
  FROM {name} WHERE n > 1 GROUP BY tree, lvl + 1, pos // {RUN})"""


def _steps(nodes: str, leaves: str) -> str:
    """Per leaf and level what stands left and right of the leaf's node in its run."""
    at = f"(l.pos // CAST(power({RUN}, s.lvl) AS BIGINT))"
    return f"""
  SELECT l.tree, l.pos, s.lvl,
         coalesce(string_agg(s.digest, '' ORDER BY s.pos) FILTER (s.pos < {at}), '') AS lefts,
         coalesce(string_agg(s.digest, '' ORDER BY s.pos) FILTER (s.pos > {at}), '') AS rights
  FROM {leaves} l JOIN {nodes} s ON s.tree = l.tree AND s.n > 1 AND s.pos // {RUN} = {at} // {RUN}
  GROUP BY l.tree, l.pos, s.lvl"""


MERKLE = f"""
WITH RECURSIVE {_CRC_TABLE},
made AS (
  SELECT doc_id, coalesce('s' || source, '') AS tree, {_leaf('text')} AS digest,
         CASE WHEN {_crc("list_transform(string_split(doc_id::VARCHAR, ''), lambda x : ascii(x))")} % {TAMPER_MOD} = 0
              THEN {_leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS tampered
  FROM documents, crc),
leaf AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos,
         count(*) OVER (PARTITION BY tree) AS n FROM made),
{_levels('node', 'leaf')},
subroot AS (
  SELECT tree AS source, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, '' AS tree
  FROM node WHERE n = 1),
{_levels('upper', 'subroot')},
root AS (SELECT digest AS root FROM upper WHERE n = 1),
step AS (
  SELECT tree, pos, 0 AS part, lvl, lefts, rights FROM ({_steps('node', 'leaf')})
  UNION ALL
  SELECT leaf.tree, leaf.pos, 1, u.lvl, u.lefts, u.rights
  FROM leaf JOIN subroot ON subroot.source = leaf.tree JOIN ({_steps('upper', 'subroot')}) u ON u.pos = subroot.pos),
path AS (SELECT *, row_number() OVER (PARTITION BY tree, pos ORDER BY part, lvl) AS k FROM step),
proof AS (SELECT tree, pos, sha256(string_agg(lefts || rights, '' ORDER BY k)) AS proof, max(k) AS steps
          FROM path GROUP BY tree, pos),
folded AS (
  SELECT tree, pos, 0 AS k, coalesce(tampered, digest) AS digest FROM leaf
  UNION ALL
  SELECT f.tree, f.pos, f.k + 1, sha256(p.lefts || f.digest || p.rights)
  FROM folded f JOIN path p ON p.tree = f.tree AND p.pos = f.pos AND p.k = f.k + 1)
SELECT leaf.doc_id, leaf.digest AS leaf, subroot.digest AS subroot, root.root,
       coalesce(proof.proof, sha256('')) AS proof_sha256, folded.digest AS folded_root,
       folded.digest = root.root AS verified
FROM leaf JOIN subroot ON subroot.source = leaf.tree CROSS JOIN root
LEFT JOIN proof ON proof.tree = leaf.tree AND proof.pos = leaf.pos
JOIN folded ON folded.tree = leaf.tree AND folded.pos = leaf.pos AND folded.k = coalesce(proof.steps, 0)
"""

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _grams(table: str, key: str) -> str:
    return f"""
  SELECT {key}, w, unnest(w || list_transform(range(1, len(w)), lambda i : w[i] || ' ' || w[i + 1])
      || list_transform(range(1, len(w) - 1), lambda i : w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g
  FROM (SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORDS}') AS w
        FROM {table})"""


RESAMPLE = f"""
WITH RECURSIVE {_CRC_TABLE},
gram AS ({_grams('documents', 'doc_id')}),
wanted AS ({_grams('benchmark', 'item_id')}),
bucket AS (
  SELECT g, {_crc("list_transform(range(0, strlen(g)), lambda i : ('0x' || substr(x, 2 * i + 1, 2))::INTEGER)")}
            % {BUCKETS} AS b
  FROM (SELECT g, hex(encode(g)) AS x FROM (SELECT g FROM gram UNION SELECT g FROM wanted)), crc),
had AS (SELECT b, count(*) AS s FROM gram JOIN bucket USING (g) GROUP BY b),
want AS (SELECT b, count(*) AS t FROM wanted JOIN bucket USING (g) GROUP BY b),
total AS (SELECT (SELECT count(*) FROM gram)::DOUBLE AS ss, (SELECT count(*) FROM wanted)::DOUBLE AS tt),
gain AS (
  SELECT b, floor(1000.0 * ln(((coalesce(t, 0)::DOUBLE + 1) * (ss + {BUCKETS}))
                              / ((s::DOUBLE + 1) * (tt + {BUCKETS}))))::BIGINT AS gain
  FROM had LEFT JOIN want USING (b), total),
weighed AS (
  SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight, max(len(w)) AS n_words
  FROM gram JOIN bucket USING (g) JOIN gain USING (b) GROUP BY doc_id),
scored AS (
  SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(n_words, 0) >= {MIN_WORDS} AS enough,
         (coalesce(weight, 0) + floor(-1000.0 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE)
                                                      / 4294967296.0::DOUBLE))))::BIGINT AS score
  FROM documents LEFT JOIN weighed USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE enough)
SELECT doc_id, n_features, weight, score, rank
FROM scored LEFT JOIN (SELECT * FROM ranked
                       WHERE rank <= (SELECT {DRAWN_PERCENT} * count(*) // 100 FROM scored WHERE enough)) USING (doc_id)
"""
