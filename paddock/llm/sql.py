"""DuckDB SQL for the rows of the operators that SQL can state."""

from __future__ import annotations

# Near-duplicate classes in SQL: shingle sets, pairs that share shingles, and the least id reachable by links.
JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, shingle FROM (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM words) u),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * o >= 85 * (p.n + q.n - o)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, least) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.least FROM reach r JOIN edges e ON e.x = r.doc_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, min(least) AS component_id FROM reach GROUP BY doc_id) r ON r.doc_id = d.doc_id"""


def centroid_sql(k: int = 8, rounds: int = 10, width: int = 64) -> str:
    """Lloyd rounds one after the other, every distance computed."""
    parts = [f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS row_id, vec_id, x FROM (
  SELECT vec_id, list_transform(embedding, lambda v: CAST(floor(1024 * CAST(v AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = {width}) e),
c0 AS MATERIALIZED (SELECT c, x FROM (
  SELECT row_number() OVER (ORDER BY sha256(concat('3:', vec_id))) - 1 AS c, x FROM kept) s WHERE c < {k})"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, x, c, d FROM (
  SELECT k.vec_id, k.x, c.c, d, row_number() OVER (PARTITION BY k.row_id ORDER BY d, c.c) AS rank
  FROM kept k, c{r} c, LATERAL (SELECT list_sum(list_transform(list_zip(k.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d) z) s
  WHERE rank = 1)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS x FROM (
    SELECT c, j, sum(v) AS s, count(*) AS n FROM (SELECT c, unnest(x) AS v, unnest(range({width})) AS j FROM a{r}) u GROUP BY c, j) g GROUP BY c
  UNION ALL SELECT c, x FROM c{r} WHERE c NOT IN (SELECT c FROM a{r}))""")
    last = rounds
    return "WITH " + ",\n".join(parts) + f"""
SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance,
  CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{last} a JOIN c{last} c ON a.c = c.c"""


# CRC-32 of a short text: its table of 256 entries from the polynomial, folded over the bytes.
CRC_TABLE = "(SELECT list_transform(range(256), lambda i: " + "list_reduce(range(8), lambda c, _: " \
    "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(i AS BIGINT))) AS crc)"
CRC = "xor(4294967295, list_reduce(list_transform(range(1, length({0}) + 1), lambda k: CAST(ascii({0}[k]) AS BIGINT)), " \
    "lambda c, b: xor(crc[CAST(xor(c, b) & 255 AS INTEGER) + 1], c >> 8), CAST(4294967295 AS BIGINT)))"


def merkle_sql(levels: int = 5, tops: int = 3, fan: int = 16) -> str:
    """Levels spelled out: a source (and the sequence of subroots) that has become one node rises no more."""
    text = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def leaf(last: str) -> str:
        fields = [f"coalesce(concat(octet_length(encode(CAST({c} AS VARCHAR))), ':', CAST({c} AS VARCHAR)), '-')"
                  if c else f"coalesce(concat(octet_length(encode({last})), ':', {last}), '-')" for c in ("doc_id", "source", "lang", "n_chars", "")]
        return f"sha256(concat({', '.join(fields)}))"

    parts = [f"""leaves AS MATERIALIZED (SELECT doc_id, source, {leaf('text')} AS node,
  CASE WHEN {CRC.format('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {leaf(text)} END AS changed FROM documents, {CRC_TABLE} t),
placed AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, node) - 1 AS p FROM leaves),
l0 AS MATERIALIZED (SELECT g, p, node, count(*) OVER (PARTITION BY g) AS n FROM placed)"""]

    def rise(name: str, count: int) -> None:
        for k in range(count):
            parts.append(f"""{name}{k + 1} AS MATERIALIZED (SELECT g, p, node, count(*) OVER (PARTITION BY g) AS n FROM (
  SELECT g, p // {fan} AS p, sha256(string_agg(node, '' ORDER BY p)) AS node FROM {name}{k} WHERE n > 1 GROUP BY g, p // {fan}
  UNION ALL SELECT g, p, node FROM {name}{k} WHERE n = 1) u)""")

    rise("l", levels)
    parts.append(f"t0 AS MATERIALIZED (SELECT 0 AS g, g AS p, node, count(*) OVER () AS n FROM l{levels})")
    rise("t", tops)
    # f: for every leaf the node of the current level (tampered), the proof so far, its place
    parts.append("f0 AS (SELECT doc_id, g, p, p AS at, node AS leaf, coalesce(changed, node) AS x, '' AS proof FROM placed)")
    step = 0
    for name, count in (("l", levels), ("t", tops)):
        if name == "t":
            parts.append(f"f{step + 1} AS (SELECT doc_id, g, p, g AS at, leaf, x, proof FROM f{step})")
            step += 1
        own = "f.g" if name == "l" else "0"
        for k in range(count):
            parts.append(f"""s{step} AS MATERIALIZED (SELECT f.g, f.p, f.doc_id, f.leaf, min(n.n) AS n,
    coalesce(string_agg(n.node, '' ORDER BY n.p) FILTER (n.p < f.at), '') AS before, coalesce(string_agg(n.node, '' ORDER BY n.p) FILTER (n.p > f.at), '') AS after
  FROM f{step} f JOIN {name}{k} n ON n.g = {own} AND n.p // {fan} = f.at // {fan} GROUP BY f.g, f.p, f.doc_id, f.leaf),
f{step + 1} AS MATERIALIZED (SELECT f.doc_id, f.g, f.p, CASE WHEN s.n > 1 THEN f.at // {fan} ELSE f.at END AS at, f.leaf,
    CASE WHEN s.n > 1 THEN sha256(concat(s.before, f.x, s.after)) ELSE f.x END AS x,
    CASE WHEN s.n > 1 THEN concat(f.proof, s.before, s.after) ELSE f.proof END AS proof
  FROM f{step} f JOIN s{step} s ON s.g = f.g AND s.p = f.p)""")
            step += 1
    return "WITH " + ",\n".join(parts) + f"""
SELECT f.doc_id, f.leaf, l.node AS subroot, t.node AS root, sha256(f.proof) AS proof_sha256, f.x AS folded_root, f.x = t.node AS verified
FROM f{step} f JOIN l{levels} l ON l.g = f.g JOIN t{tops} t ON true"""


# All pairs by cosine in double precision, and the least id reachable by links.
COSINE_SQL = """
WITH RECURSIVE vectors AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x
  FROM embeddings WHERE len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM vectors a JOIN vectors b ON a.r <> b.r AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
reach(vec_id, least) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.y, r.least FROM reach r JOIN links l ON l.x = r.vec_id)
SELECT e.vec_id, coalesce(l.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e LEFT JOIN (SELECT x, count(*) AS n FROM links GROUP BY x) l ON l.x = e.vec_id
JOIN (SELECT vec_id, min(least) AS component_id FROM reach GROUP BY vec_id) c ON c.vec_id = e.vec_id"""

ORACLE: dict[str, str] = {"op1_ngram_jaccard_join": JACCARD_SQL, "op11_centroid_clustering": centroid_sql(),
                          "op12_merkle_manifest": merkle_sql(), "op13_embedding_near_dedup": COSINE_SQL}
