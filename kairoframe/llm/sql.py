"""DuckDB SQL for the queries that SQL can express over whole tables."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP4_URL_FILTER = f"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), '{_UPPER}', '{_LOWER}') AS host,
         coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
  FROM pages),
rules AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) r(h, p, v)),
named AS (
  SELECT page_id, host, path,
         CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule, coalesce((SELECT v FROM rules WHERE h || p = rule), 'allow') AS verdict
FROM named
"""

OP5_BLOCK_SEARCH = """
WITH cells AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM cells q JOIN cells c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP2_LINE_DEDUP = f"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
keyed AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM docs),
keys AS (
  SELECT doc_id, line, pos,
         translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), '{_UPPER}', '{_LOWER}') AS k
  FROM keyed),
hot AS (SELECT k FROM keys WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT doc_id, line, pos, k IN (SELECT k FROM hot) AS gone FROM keys)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP9_NEAR_DEDUP = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""


def _marked(text: str, capitals: bool = False) -> str:
    """decontamination.marked_words without looking around: rewritten with groups, twice where matches may touch."""
    from kairoframe.llm.decontamination import UNITS

    named = f"regexp_replace({text}, '([\\p{{L}}\\p{{N}},;:] )(\\p{{Lu}})', '\\1' || chr(1) || '\\2', 'g')"
    named = f"regexp_replace({named}, '([\\p{{L}}\\p{{N}},;:] )(\\p{{Lu}})', '\\1' || chr(1) || '\\2', 'g')"
    if capitals:
        named = f"regexp_replace({named}, '(^|[^\\p{{L}}\\p{{N}}\\x01])(\\p{{Lu}})', '\\1' || chr(3) || '\\2', 'g')"
    numbers = f"regexp_replace(regexp_replace({named}, '(\\d)[.,](\\d)', '\\1\\2', 'g'), '(\\d)[.,](\\d)', '\\1\\2', 'g')"
    apart = f"regexp_replace({numbers}, '(\\d)(\\p{{L}})', '\\1 \\2', 'g')"
    units = f"regexp_replace({apart}, '(\\d )\\x01?((?i:{UNITS}))([^\\p{{L}}\\p{{N}}]|$)', '\\1' || chr(2) || '\\2\\3', 'g')"
    return f"regexp_split_to_array(lower({units}), '[^\\p{{L}}\\p{{N}}\\x01\\x02\\x03]+')"


_SLOT = "regexp_matches({w}, '^[0-9\\x01\\x02]')"
_PLAIN = "regexp_replace({w}, '^[\\x01-\\x03]', '')"


def _joined(words: str, word: str) -> str:
    """The words of a list, each put as the expression ``word`` of w, with a space after each."""
    return f"list_aggregate(list_transform({words}, lambda w: {word} || ' '), 'string_agg', '')"


_OWN = _PLAIN.format(w="w")
_TYPED = f"CASE WHEN regexp_matches(w, '^[0-9]') THEN chr(5) WHEN regexp_matches(w, '^[\\x01\\x02]') THEN w[1] ELSE {_OWN} END"
_INSIDE = f"CASE WHEN regexp_matches(w, '^[0-9]') THEN chr(5) WHEN regexp_matches(w, '^\\x03') THEN chr(1) WHEN regexp_matches(w, '^[\\x01\\x02]') THEN w[1] ELSE w END"

OP10_DECONTAMINATION = f"""
WITH iw AS (SELECT item_id, list_filter({_marked("text", capitals=True)}, lambda w: w <> '') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
ip AS (SELECT DISTINCT item_id, least(len(w), 8) AS size, w, unnest(range(0, len(w) - least(len(w), 8) + 1)) AS at_i FROM iw WHERE len(w) >= 3),
win AS (SELECT item_id, size, at_i, list_slice(w, at_i + 1, at_i + size) AS words FROM ip),
opened AS (SELECT *, len(list_filter(words, lambda w: NOT {_SLOT.format(w="w")})) >= 5 AS open FROM win),
cnt AS (SELECT item_id, count(DISTINCT at_i) AS n_windows, count(DISTINCT at_i) FILTER (open) AS n_open FROM opened GROUP BY 1),
keys AS (SELECT *, {_joined("words", _OWN)} AS key FROM opened UNION SELECT *, {_joined("words", _TYPED)} FROM opened WHERE open UNION SELECT *, {_joined("words", _INSIDE)} FROM opened WHERE open),
dw AS (SELECT DISTINCT doc_id, text, {_marked("text")} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
dp AS (SELECT doc_id, w, size, unnest(range(0, len(w) - size + 1)) AS start FROM dw, (SELECT DISTINCT size FROM opened)),
dn AS (SELECT doc_id, size, start, list_slice(w, start + 1, start + size) AS there FROM dp),
dk AS (SELECT *, {_joined("there", _OWN)} AS key FROM dn UNION SELECT *, {_joined("there", _TYPED)} FROM dn),
met AS (SELECT DISTINCT doc_id, item_id, at_i, open, start - at_i AS shift, words, there FROM dk JOIN keys USING (size, key)),
pairs AS (SELECT *, list_zip(words, there) AS p FROM met),
hit AS (
  SELECT doc_id, item_id, at_i, open, shift, CASE WHEN open THEN list_transform(list_filter(p, lambda x: {_SLOT.format(w="x[1]")}), lambda x: {{'a': x[1], 'b': {_PLAIN.format(w="x[2]")}}}) ELSE [] END AS slots
  FROM pairs
  WHERE len(list_filter(p, lambda x: {_PLAIN.format(w="x[1]")} <> {_PLAIN.format(w="x[2]")}
    AND NOT (open AND {_SLOT.format(w="x[1]")} AND CASE WHEN regexp_matches(x[1], '^[0-9]') THEN regexp_matches(x[2], '^[0-9]') ELSE x[1][1] = x[2][1] END))) = 0),
slot AS (SELECT DISTINCT doc_id, item_id, shift, s.a AS a, s.b AS b, regexp_extract(s.a, '^[\x01\x02]') || s.b AS c FROM (SELECT *, unnest(slots) AS s FROM hit)),
several AS (
  SELECT doc_id, item_id, shift, a AS v FROM slot GROUP BY ALL HAVING count(DISTINCT b) > 1
  UNION SELECT doc_id, item_id, shift, c FROM slot GROUP BY ALL HAVING count(DISTINCT a) > 1),
bad AS (SELECT doc_id, item_id, shift, list(v) AS vs, bool_or(v[1] = chr(1)) AS persons FROM several GROUP BY 1, 2, 3),
judged AS (
  SELECT h.*, len(list_filter(slots, lambda s: {_PLAIN.format(w="s.a")} <> s.b)) > 0 AS changed,
    coalesce(persons, false) OR len(list_filter(slots, lambda s: list_contains(coalesce(vs, []), s.a) OR list_contains(coalesce(vs, []), regexp_extract(s.a, '^[\x01\x02]') || s.b))) > 0 AS clash
  FROM hit h LEFT JOIN bad USING (doc_id, item_id, shift)),
per AS (SELECT doc_id, item_id, count(DISTINCT at_i) AS n_found, count(DISTINCT at_i) FILTER (open) AS n_open_found, bool_or(changed) AS reparameterised FROM judged WHERE NOT (changed AND clash) GROUP BY 1, 2)
SELECT doc_id, count(*) AS n_items, min(item_id) AS first_item, CAST(sum(n_found) AS BIGINT) AS n_found, bool_or(reparameterised) AS reparameterised
FROM per JOIN cnt USING (item_id) WHERE n_found >= least(4, n_windows) OR (n_open > 0 AND n_open_found >= least(4, n_open)) GROUP BY 1
"""



def _elkan(k: int = 16, rounds: int = 3, width: int = 64) -> str:
    """Plain rounds of assigning every vector and replacing every centroid."""
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS INTEGER) AS c, v FROM v WHERE vec_id IS NOT NULL QUALIFY c < {k})""",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (SELECT v.rid, v.vec_id, v.v, c.c, CAST(list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{r} c
  QUALIFY row_number() OVER (PARTITION BY v.rid ORDER BY d, c.c) = 1)"""
        )
        if r < rounds:
            steps += [
                f"""s{r} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY c, i)""",
                f"""m{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{r} GROUP BY c)""",
                f"""c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{r} o LEFT JOIN m{r} m USING (c))""",
            ]
    return f"""WITH {', '.join(steps)}
SELECT vec_id, a.c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(f.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} f ON f.c = a.c"""


OP12_ELKAN = _elkan()

ORACLES: dict[str, str] = {
    "op2_line_dedup": OP2_LINE_DEDUP,
    "op4_url_filter": OP4_URL_FILTER,
    "op5_block_search": OP5_BLOCK_SEARCH,
    "op9_near_dedup": OP9_NEAR_DEDUP,
    "op10_decontamination": OP10_DECONTAMINATION,
    "op12_elkan": OP12_ELKAN,
}
