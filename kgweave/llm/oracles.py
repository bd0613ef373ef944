"""DuckDB SQL for the corpus queries that SQL can state; the others are tested against brute force."""
from __future__ import annotations

ORACLES: dict[str, str] = {}

SPACE = r"[\x20\x09-\x0D]+"

ORACLES["op8_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

# words of a whole text; translate folds A-Z only
_WORDS = f"list_filter(regexp_split_to_array({{t}}, '{SPACE}'), lambda x: x <> '')"

ORACLES["op1_minhash_dedup"] = f"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, {_WORDS.format(t="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 75 * (a.c + b.c - i)),
both_ways AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x AS doc_id, y AS other FROM both_ways UNION SELECT r.doc_id, e.y FROM reach r JOIN both_ways e ON e.x = r.other),
low AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.c, 0) AS n_shingles, least(d.doc_id, coalesce(low.m, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(low.m, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)
"""

ORACLES["op2_substring_dedup"] = f"""
WITH w AS MATERIALIZED (SELECT doc_id, {_WORDS.format(t="coalesce(text, '')")} AS ws FROM documents),
win AS MATERIALIZED (
  SELECT doc_id, p, sha256(array_to_string(ws[p:p + 49], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM w WHERE len(ws) >= 50)),
first AS (SELECT h, min(doc_id) AS lo FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS k FROM win JOIN first USING (h) WHERE lo < doc_id),
lost AS (SELECT doc_id, list(k) AS ats FROM gone GROUP BY doc_id),
kept AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(len(ats), 0) AS n_removed,
    CASE WHEN ats IS NULL THEN ws ELSE list_select(ws, list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(ats, i))) END AS kept_words
  FROM w LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(kept_words, ' '), '')) AS kept_sha256 FROM kept
"""

ORACLES["op5_url_filter"] = """
WITH rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                               ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
rest AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN url[instr(url, '://') + 3:] ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, row_number() OVER () AS n,
    translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest)
SELECT page_id, host, path, h || p AS rule, coalesce(v, 'allow') AS verdict
FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
QUALIFY row_number() OVER (PARTITION BY n ORDER BY length(h || p) DESC NULLS LAST) = 1
"""

ORACLES["op9_topk"] = """
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

# cuts: the first two draws modulo n + 1
_UNITS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
ORACLES["op12_fill_in_middle"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_UNITS}') AS u, sha256('42:' || doc_id::VARCHAR) AS h FROM documents),
k AS (SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


def _merkle(levels: int = 12) -> str:
    """Unrolled levels of all language trees and of the tree over them; up to 8^levels leaves a tree."""
    part = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: f"sha256({' || '.join(part(c) for c in ('doc_id', 'source', 'lang', 'n_chars'))} || {part(text)})"
    byte = "list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)"
    step = "list_reduce(list_prepend(xor(a, c), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, o: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {byte}), lambda a, c: {step}), 4294967295)"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    sql = [f"docs AS MATERIALIZED (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS found FROM documents)",
           "a0 AS MATERIALIZED (SELECT *, coalesce('=' || lang, '') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, leaf AS h FROM docs)"]

    def climb(name: str):
        for k in range(levels):
            run = "PARTITION BY tree, i // 8 ORDER BY i"
            sql.append(f"{name}x{k} AS MATERIALIZED (SELECT tree, i, n, h, coalesce(string_agg(h, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
                       f"coalesce(string_agg(h, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k})")
            sql.append(f"{name}{k + 1} AS MATERIALIZED (SELECT tree, i // 8 AS i, (n + 7) // 8 AS n, CASE WHEN n = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {name}{k} GROUP BY tree, i // 8, n)")

    climb("a")
    sql.append(f"b0 AS MATERIALIZED (SELECT '' AS tree, tree AS name, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, count(*) OVER () AS n, h FROM a{levels})")
    climb("b")
    sql.append("f0 AS (SELECT doc_id, leaf, tree, i, found AS f, '' AS proof FROM a0)")
    step_up = "CASE WHEN x.n = 1 THEN f ELSE sha256(x.l || f || x.r) END AS f, CASE WHEN x.n = 1 THEN proof ELSE proof || x.l || x.r END AS proof"
    for k in range(levels):
        sql.append(f"f{k + 1} AS (SELECT doc_id, leaf, f.tree, f.i // 8 AS i, {step_up} FROM f{k} f JOIN ax{k} x ON f.tree = x.tree AND f.i = x.i)")
    sql.append(f"g0 AS (SELECT doc_id, leaf, b0.h AS subroot, b0.i, f, proof FROM f{levels} JOIN b0 ON b0.name = f{levels}.tree)")
    for k in range(levels):
        sql.append(f"g{k + 1} AS (SELECT doc_id, leaf, subroot, g.i // 8 AS i, {step_up} FROM g{k} g JOIN bx{k} x ON g.i = x.i)")
    return ("WITH " + ",\n".join(sql) + f"\nSELECT doc_id, leaf, subroot, b.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = b.h AS verified FROM g{levels}, b{levels} b")


ORACLES["op13_merkle_manifest"] = _merkle()
