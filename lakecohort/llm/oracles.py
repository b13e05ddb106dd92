"""DuckDB SQL for the operators that SQL can express."""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, vec_id, score,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

FILTER_AUDIT = """
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents
), m AS (
  SELECT text, min(doc_id) AS first FROM d GROUP BY text
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (CASE WHEN len(words) < 50 THEN 'A' ELSE '' END)
         || (CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END)
         || (CASE WHEN 100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 5 * length(d.text) THEN 'C' ELSE '' END)
         || (CASE WHEN regexp_matches(d.text, '[#$%&*|]') THEN 'D' ELSE '' END)
         || (CASE WHEN d.doc_id > m.first THEN 'E' ELSE '' END) AS fails
  FROM d JOIN m ON d.text = m.text LEFT JOIN l ON d.doc_id = l.doc_id
), x AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c
), o AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order
  FROM x a JOIN x b ON b.c <> a.c JOIN x c ON c.c NOT IN (a.c, b.c) JOIN x d ON d.c NOT IN (a.c, b.c, c.c)
    JOIN x e ON e.c NOT IN (a.c, b.c, c.c, d.c)
), s AS (
  SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM o
), r AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS filter, fails, good, toxic,
         contains(fails, substr(filter_order, step, 1)) AS failed,
         length(translate(substr(filter_order, 1, step - 1), fails, '')) < step - 1 AS gone
  FROM f CROSS JOIN s
), c AS (
  SELECT part, filter_order, step, filter,
         CAST(count(*) FILTER (WHERE NOT failed AND NOT gone) AS BIGINT) AS kept,
         CAST(count(*) FILTER (WHERE failed AND NOT gone) AS BIGINT) AS removed,
         CAST(count(*) FILTER (WHERE failed AND gone) AS BIGINT) AS redundant,
         CAST(count(*) FILTER (WHERE fails = filter) AS BIGINT) AS unique_fails,
         CAST(count(*) FILTER (WHERE failed AND NOT gone AND good = 1) AS BIGINT) AS good_lost,
         CAST(count(*) FILTER (WHERE failed AND NOT gone AND toxic = 1) AS BIGINT) AS toxic_lost
  FROM r GROUP BY part, filter_order, step, filter
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM c
"""


def _merkle() -> str:
    """Trees of up to 16^6 leaves a source and 16^4 sources, level by level; crc32 is spelled out, as DuckDB has none."""
    told = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    head = " || ".join(told(c) for c in ("doc_id", "source", "lang", "n_chars"))
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = (
        "xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))), "
        "lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, i: xor(a >> 1, (a & 1) * 3988292384))), 4294967295)"
    )
    parts, source_levels, top_levels = [], 6, 4
    parts.append(f"d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS tree, sha256({head} || {told('text')}) AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN sha256({head} || {told(low)}) END AS changed FROM documents)")
    parts.append("l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d)")
    for name, below, node, levels in (("r", "l", "leaf", source_levels), ("s", "t", "node", top_levels)):
        if name == "s":
            ends = ["SELECT tree, leaf AS node FROM l WHERE n = 1"] + [f"SELECT tree, sha256(run) AS node FROM r{k} WHERE n > {16 ** (k - 1)} AND n <= {16**k}" for k in range(1, source_levels + 1)]
            parts.append(f"e AS ({' UNION ALL '.join(ends)})")
            parts.append("t AS (SELECT '' AS tree, tree AS name, node, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM e)")
        for k in range(1, levels + 1):
            parts.append(f"{name}{k} AS (SELECT tree, n, pos // 16 AS pos, string_agg({node}, '' ORDER BY pos) AS run FROM {below} WHERE n > {16 ** (k - 1)} GROUP BY tree, n, pos // 16)")
            below, node = f"{name}{k}", "sha256(run)"
    ends = ["SELECT node FROM t WHERE n = 1"] + [f"SELECT sha256(run) AS node FROM s{k} WHERE n > {16 ** (k - 1)} AND n <= {16**k}" for k in range(1, top_levels + 1)]
    parts.append(f"root AS ({' UNION ALL '.join(ends)})")
    columns, joins = [], []
    for name, owner, levels in (("r", "l", source_levels), ("s", "t", top_levels)):
        for k in range(1, levels + 1):
            place = f"64 * ({owner}.pos // {16 ** (k - 1)} % 16)"
            columns.append(f"{name}{k}.run AS {name}{k}_run, substr({name}{k}.run, 1, {place}) AS {name}{k}_left, substr({name}{k}.run, {place} + 65) AS {name}{k}_right")
            joins.append(f"LEFT JOIN {name}{k} ON {name}{k}.tree = {owner}.tree AND {name}{k}.pos = {owner}.pos // {16**k}")
    parts.append(f"f0 AS (SELECT l.doc_id, l.leaf, t.node AS subroot, root.node AS root, coalesce(l.changed, l.leaf) AS fold, {', '.join(columns)} FROM l JOIN t ON t.name = l.tree CROSS JOIN root {' '.join(joins)})")
    levels = [f"r{k}" for k in range(1, source_levels + 1)] + [f"s{k}" for k in range(1, top_levels + 1)]
    for i, x in enumerate(levels):
        parts.append(f"f{i + 1} AS (SELECT * REPLACE (CASE WHEN {x}_run IS NULL THEN fold ELSE sha256({x}_left || fold || {x}_right) END AS fold) FROM f{i})")
    proof = " || ".join(f"coalesce({x}_left || {x}_right, '')" for x in levels)
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, fold AS folded_root, fold = root AS verified FROM f{len(levels)}"


SQL: dict[str, str] = {"op2_topk_search": TOP_K, "op12_merkle_manifest": _merkle(), "op13_filter_audit": FILTER_AUDIT}
