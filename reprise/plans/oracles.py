"""SQL twins of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

THRESHOLD = 20

DOCS = """docs AS (SELECT doc_id, 'file:///corpus/' || coalesce(source, 'none') || '/' || doc_id || '.txt' AS uri, coalesce(text, '') AS text FROM documents)"""
BENCH = """bench AS (SELECT 'file:///bench/' || item_id || '.txt' AS uri, coalesce(text, '') AS text FROM benchmark)"""
LINES = """lines AS (SELECT uri, CAST(frag_id AS INT) AS frag_id, line, list_filter(string_split(line, ' '), lambda w: w <> '') AS toks
          FROM (SELECT uri, unnest(ls) AS line, unnest(range(len(ls))) AS frag_id FROM (SELECT uri, string_split(text, chr(10)) AS ls FROM {docs})))"""
_CHAIN = f"""pos AS (SELECT uri, frag_id, CAST(off AS INT) AS off, list_slice(toks, off + 1, off + {THRESHOLD}) AS seed, list_slice(toks, off + 1, len(toks)) AS suf
        FROM (SELECT uri, frag_id, toks, unnest(range(len(toks) - {THRESHOLD - 1})) AS off FROM lines WHERE len(toks) >= {THRESHOLD})),
rep AS (SELECT seed FROM pos GROUP BY seed HAVING count(*) > 1),
nb AS (SELECT pos.*, lag(suf) OVER w AS psuf, lag(uri) OVER w AS prev_uri, lag(frag_id) OVER w AS prev_frag_id, lag(off) OVER w AS prev_off, row_number() OVER w AS rk
       FROM pos WHERE seed IN (SELECT seed FROM rep) WINDOW w AS (PARTITION BY seed ORDER BY suf, uri, frag_id, off)),
l AS (SELECT *, CASE WHEN psuf IS NOT NULL THEN coalesce(list_position(list_transform(range(1, least(len(suf), len(psuf)) + 1), lambda i: suf[i] = psuf[i]), false) - 1,
                                                         least(len(suf), len(psuf))) END AS lcp FROM nb),
e AS (SELECT *, lcp IS NOT NULL AND NOT (coalesce(lag(off) OVER p = off - 1, false) AND coalesce(lag(lcp) OVER p > lcp, false)) AS emitted
      FROM l WINDOW p AS (PARTITION BY uri, frag_id ORDER BY off)),
i AS (SELECT *, sum(CASE WHEN emitted THEN 0 ELSE 1 END) OVER r AS island, greatest(CASE WHEN emitted THEN lcp END, lead(CASE WHEN emitted THEN lcp END) OVER r) AS longest
      FROM e WINDOW r AS (PARTITION BY seed ORDER BY rk)),
nodes AS (SELECT uri, frag_id, off, longest - 1 AS clone_size,
                 first_value(uri || '#' || frag_id || '#' || off) OVER (PARTITION BY seed, island ORDER BY uri, frag_id, off) AS class_id
          FROM i WHERE longest IS NOT NULL),
parted AS (SELECT nodes.*, string_split(line, ' ') AS parts FROM nodes JOIN lines USING (uri, frag_id)),
placed AS (SELECT *, list_filter(range(len(parts)), lambda k: parts[k + 1] <> '') AS word_parts FROM parted),
bounds AS (SELECT *, word_parts[off + 1] AS a, word_parts[off + clone_size + 1] AS b FROM placed),
ranged AS (SELECT uri, frag_id, off, clone_size, class_id, frag_id AS start_line,
                  CASE WHEN a > 0 THEN length(array_to_string(list_slice(parts, 1, a), ' ')) + 1 ELSE 0 END AS start_char, frag_id AS end_line,
                  CASE WHEN b > 0 THEN length(array_to_string(list_slice(parts, 1, b), ' ')) + 1 ELSE 0 END + length(parts[b + 1]) AS end_char FROM bounds),
counted AS (SELECT *, count(*) OVER (PARTITION BY class_id) - 1 AS n_matches,
                   start_line || ':' || start_char || '-' || end_line || ':' || end_char AS range FROM ranged)"""


def on_docs(select: str) -> str:
    return f"WITH {DOCS}, {LINES.format(docs='docs')} {select}"


def on_clones(select: str, source: str = "docs", more: str = "") -> str:
    head = more or DOCS
    return f"WITH {head}, {LINES.format(docs=source)}, {_CHAIN} {select}"


_PLACES = "places AS (SELECT uri, frag_id, off, token FROM (SELECT uri, frag_id, unnest(toks) AS token, unnest(range(len(toks))) AS off FROM lines))"
_DICTIONARY = f"""{_PLACES}, dict AS (SELECT token, row_number() OVER (ORDER BY f.uri, f.frag_id, f.off) + 1 AS token_id
  FROM (SELECT token, min(struct_pack(uri := uri, frag_id := frag_id, off := off)) AS f FROM places GROUP BY token))"""
_CORPUS = """corpus AS (SELECT uri, frag_id, CAST(len(toks) AS BIGINT) AS n_tokens,
  CAST(coalesce(sum(len(toks) + 1) OVER (ORDER BY uri, frag_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos_start FROM lines)"""
_OLD_NEW = """old AS (SELECT doc_id, uri, CASE WHEN doc_id % 10 = 1 THEN text || ' changed' ELSE text END AS text FROM docs WHERE doc_id % 10 <> 3),
new AS (SELECT doc_id, uri, text FROM docs WHERE doc_id % 10 <> 2)"""
_TURNS = """pairs AS (SELECT a.conv_id, a.turn, list_filter(string_split(coalesce(a.text, ''), ' '), lambda w: w <> '') AS old,
  list_filter(string_split(coalesce(b.text, ''), ' '), lambda w: w <> '') AS new
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn)"""
_BENCH_PLACES = "SELECT uri AS doc, pos, token FROM (SELECT uri, unnest(toks) AS token, unnest(range(len(toks))) AS pos FROM b)"
_B = f"{BENCH}, b AS (SELECT uri, list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda w: w <> '') AS toks FROM bench)"

ORACLES = {
    "scan_documents": f"WITH {DOCS} SELECT uri, CAST(length(text) AS BIGINT) AS n_chars FROM docs WHERE uri LIKE '%.txt'",
    "norm_text": f"WITH {DOCS}, n AS (SELECT uri, regexp_replace(text, '\\n[^\\n]*\\z', '') AS t FROM docs) SELECT uri, md5(t) AS digest, CAST(len(string_split(t, chr(10))) AS BIGINT) AS n_lines FROM n",
    "changed_docs": f"""WITH {DOCS}, {_OLD_NEW} SELECT coalesce(o.uri, n.uri) AS uri, CASE WHEN o.uri IS NULL THEN 'added' WHEN n.uri IS NULL THEN 'deleted' ELSE 'modified' END AS change
  FROM old o FULL JOIN new n ON o.uri = n.uri WHERE o.uri IS NULL OR n.uri IS NULL OR o.text <> n.text""",
    "upsert_documents": f"WITH {DOCS} SELECT uri, md5(CASE WHEN doc_id % 10 = 1 THEN text || ' second' ELSE text END) AS digest FROM docs WHERE doc_id % 10 <> 2",
    "tokenize": on_docs("SELECT uri, frag_id, CAST(len(toks) AS BIGINT) AS n_tokens, md5(array_to_string(toks, ' ')) AS digest FROM lines"),
    "token_filter": on_docs("SELECT uri, CAST(sum(len(list_filter(toks, lambda w: w NOT IN ('the', 'of', 'and', 'de', 'la')))) AS BIGINT) AS n_tokens FROM lines GROUP BY uri"),
    "blind_tokens": on_docs("SELECT uri, frag_id, md5(array_to_string(list_transform(toks, lambda w: regexp_replace(lower(w), '[0-9]+', '#', 'g')), ' ')) AS digest FROM lines"),
    "fragments": on_docs("SELECT uri, frag_id, CAST(len(toks) AS BIGINT) AS n_tokens FROM lines WHERE len(toks) > 0"),
    "fragment_size_filter": on_docs("SELECT uri, frag_id, CAST(len(toks) AS BIGINT) AS n_tokens FROM lines WHERE len(toks) BETWEEN 20 AND 50"),
    "outermost_fragments": on_docs("""SELECT a.uri, a.frag_id FROM (SELECT *, len(toks) % 3 AS kind, frag_id * 3 AS s, frag_id * 3 + len(toks) % 11 AS t FROM lines) a
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT *, len(toks) % 3 AS kind, frag_id * 3 AS s, frag_id * 3 + len(toks) % 11 AS t FROM lines) o
                    WHERE o.uri = a.uri AND o.kind = a.kind AND o.s < a.s AND o.t >= a.t)"""),
    "token_dictionary": on_docs(f", {_DICTIONARY} SELECT token, token_id FROM dict"),
    "token_counts": on_docs(f", {_PLACES} SELECT token, count(*) AS n FROM places GROUP BY token"),
    "token_cumcounts": on_docs(f", {_PLACES}, c AS (SELECT token, count(*) AS n FROM places GROUP BY token) SELECT token, n, CAST(coalesce(sum(n) OVER (ORDER BY token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS smaller FROM c"),
    "token_alphabet": on_docs(f", {_PLACES} SELECT count(DISTINCT token) + 1 AS largest_id, CAST(length(CAST(bin(count(DISTINCT token) + 1) AS VARCHAR)) AS BIGINT) AS bits FROM places"),
    "corpus_positions": on_docs(f", {_CORPUS} SELECT uri, frag_id, n_tokens, pos_start, pos_start + n_tokens AS pos_end FROM corpus"),
    "fingerprints": on_docs(f", {_DICTIONARY} SELECT uri, frag_id, md5(string_agg(CAST(token_id AS VARCHAR), ' ' ORDER BY off) || ' 1') AS digest, count(*) + 1 AS n_ids FROM places JOIN dict USING (token) GROUP BY uri, frag_id"),
    "pos_to_source": on_docs(f", {_CORPUS} SELECT pos_start + off AS pos, uri, frag_id, off FROM (SELECT *, unnest(range(n_tokens + 1)) AS off FROM corpus)"),
    "suffix_ranks": on_clones("SELECT uri, frag_id, off, rk FROM nb"),
    "lcp_values": on_clones("SELECT uri, frag_id, off, CAST(lcp AS BIGINT) AS lcp FROM l WHERE lcp IS NOT NULL"),
    "repeated_ngrams": on_docs("SELECT gram, count(*) AS n FROM (SELECT array_to_string(list_slice(toks, p, p + 4), ' ') AS gram FROM (SELECT toks, unnest(range(1, len(toks) - 3)) AS p FROM lines WHERE len(toks) >= 5)) GROUP BY gram HAVING count(*) > 1"),
    "clone_edges": on_clones("SELECT uri, frag_id, off, CAST(lcp AS BIGINT) AS lcp, prev_uri, prev_frag_id, prev_off FROM e WHERE emitted"),
    "maximal_clones": on_clones("SELECT uri, frag_id, off, CAST(lcp AS BIGINT) AS lcp FROM e WHERE emitted"),
    "clone_nodes": on_clones("SELECT uri, frag_id, off, CAST(clone_size AS BIGINT) AS clone_size FROM nodes"),
    "clone_classes": on_clones("SELECT class_id, count(*) AS n_clones, CAST(max(clone_size) + 1 AS BIGINT) AS tokens FROM nodes GROUP BY class_id"),
    "clone_ranges": on_clones("SELECT uri, CAST(start_line AS BIGINT) AS start_line, CAST(start_char AS BIGINT) AS start_char, CAST(end_line AS BIGINT) AS end_line, CAST(end_char AS BIGINT) AS end_char, class_id FROM ranged"),
    "clones_per_document": on_clones("SELECT d.uri, count(r.uri) AS n_clones, CAST(coalesce(sum(clone_size + 1), 0) AS BIGINT) AS n_tokens FROM docs d LEFT JOIN ranged r ON d.uri = r.uri GROUP BY d.uri"),
    "diagnostics": on_clones("SELECT uri, range, n_matches || ' clone(s) detected' AS message, 'Information' AS severity, n_matches AS n_related FROM counted"),
    "published_diagnostics": on_clones("SELECT d.uri, count(r.uri) AS n_diagnostics, md5(coalesce(string_agg(range || ' ' || n_matches, ',' ORDER BY range || ' ' || n_matches), '')) AS digest FROM docs d LEFT JOIN counted r ON d.uri = r.uri GROUP BY d.uri"),
    "related_locations": on_clones("SELECT class_id, uri, range, 'Matching clone in ' || string_split(uri, '/')[-1] AS message FROM counted"),
    "related_of_documents": on_clones("""SELECT a.uri, a.range, b.uri AS related_uri, b.range AS related_range, 'Matching clone in ' || string_split(b.uri, '/')[-1] AS message
  FROM counted a JOIN counted b ON a.class_id = b.class_id AND (a.uri <> b.uri OR a.range <> b.range)"""),
    "clone_pairs_csv": on_clones("""SELECT string_split(a.uri, '/')[-2] AS folder, string_split(a.uri, '/')[-1] AS file, a.start_line + 1 AS first_line, a.end_line + 1 AS last_line,
  string_split(b.uri, '/')[-2] AS match_folder, string_split(b.uri, '/')[-1] AS match_file, b.start_line + 1 AS match_first_line, b.end_line + 1 AS match_last_line
  FROM counted a JOIN counted b ON a.class_id = b.class_id AND (a.uri <> b.uri OR a.range <> b.range)"""),
    "clone_report": on_clones("SELECT 'CodeClone(' || uri || chr(10) || range || chr(10) || 'Matches: ' || n_matches || ')' AS line FROM counted"),
    "clone_summary": on_clones("SELECT count(*) AS n_clones, count(DISTINCT class_id) AS n_classes, CAST(coalesce(max(clone_size) + 1, 0) AS BIGINT) AS largest, count(DISTINCT uri) AS n_documents FROM ranged"),
    "clones_at_range": on_clones("SELECT r.uri, r.range, q.line FROM counted r JOIN (SELECT uri, CAST(doc_id % 7 AS INT) AS line FROM docs) q ON r.uri = q.uri AND start_line <= q.line AND end_line >= q.line"),
    "jump_targets": on_clones("""SELECT a.uri AS from_uri, q.line AS from_line, 'Jump to matching clone in ' || b.uri AS title, b.uri,
  '{"start":{"line":' || b.start_line || ',"character":' || b.start_char || '},"end":{"line":' || b.end_line || ',"character":' || b.end_char || '}}' AS range_json
  FROM counted a JOIN (SELECT uri, CAST(doc_id % 7 AS INT) AS line FROM docs) q ON a.uri = q.uri AND a.start_line <= q.line AND a.end_line >= q.line
  JOIN counted b ON a.class_id = b.class_id AND (a.uri <> b.uri OR a.range <> b.range)"""),
    "largest_classes": on_clones("SELECT class_id, count(*) AS n_clones, CAST(max(clone_size) + 1 AS BIGINT) AS tokens FROM nodes GROUP BY class_id ORDER BY 2 DESC, 1 LIMIT 25"),
    "cross_table_clones": on_clones("""SELECT class_id, count(*) FILTER (uri LIKE 'file:///bench/%') AS n_bench, count(*) FILTER (uri NOT LIKE 'file:///bench/%') AS n_docs
  FROM nodes GROUP BY class_id HAVING count(*) FILTER (uri LIKE 'file:///bench/%') > 0 AND count(*) FILTER (uri NOT LIKE 'file:///bench/%') > 0""",
        "both_tables", f"{DOCS}, {BENCH}, both_tables AS (SELECT uri, text FROM docs UNION ALL SELECT uri, text FROM bench)"),
    "incremental_refresh": on_clones("SELECT uri, frag_id, off, CAST(clone_size AS BIGINT) AS clone_size, class_id FROM nodes", "new", f"{DOCS}, {_OLD_NEW}"),
    "streaming_clones": on_clones("SELECT uri, frag_id, off, CAST(clone_size AS BIGINT) AS clone_size, class_id FROM nodes", "new", f"{DOCS}, {_OLD_NEW}"),
    "rank_select": f"WITH {DOCS}, b AS (SELECT uri, list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda w: w <> '') AS toks FROM docs), p AS ({_BENCH_PLACES}) SELECT doc, pos, token, row_number() OVER (PARTITION BY doc, token ORDER BY pos) - 1 AS rank, count(*) OVER (PARTITION BY doc, token) AS total FROM p",
    "merged_token_counts": f"WITH {DOCS}, {_OLD_NEW}, {LINES.format(docs='new')}, {_PLACES} SELECT token, count(*) AS n FROM places GROUP BY token",
    "run_timings": "SELECT user_id AS run, md5(coalesce(string_agg(CAST(CAST(floor(value) AS BIGINT) AS VARCHAR), ',' ORDER BY event_id), '')) AS digest FROM events GROUP BY user_id",
    "bwt_lf": f"""WITH {_B}, s AS (SELECT uri AS doc, pos, toks, list_slice(toks, pos + 1, len(toks)) AS suf FROM (SELECT uri, toks, unnest(range(len(toks))) AS pos FROM b)),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY suf) - 1 AS rk FROM s)
  SELECT r.doc, r.rk, r.pos, CASE WHEN r.pos > 0 THEN r.toks[r.pos] ELSE '' END AS bwt, coalesce(p.rk, -1) AS lf FROM r LEFT JOIN r p ON r.doc = p.doc AND p.pos = r.pos - 1""",
    "edit_trim": f"""WITH {_TURNS}, s AS (SELECT *, coalesce(list_position(list_transform(range(1, least(len(old), len(new)) + 1), lambda i: old[i] = new[i]), false) - 1, least(len(old), len(new))) AS st FROM pairs),
  r AS (SELECT *, list_reverse(list_slice(old, st + 1, len(old))) AS ro, list_reverse(list_slice(new, st + 1, len(new))) AS rn FROM s),
  t AS (SELECT *, coalesce(list_position(list_transform(range(1, least(len(ro), len(rn)) + 1), lambda i: ro[i] = rn[i]), false) - 1, least(len(ro), len(rn))) AS en FROM r)
  SELECT conv_id, turn, CAST(st AS BIGINT) AS shared_start, CAST(en AS BIGINT) AS shared_end, array_to_string(list_slice(old, st + 1, len(old) - en), ' ') AS deleted,
         array_to_string(list_slice(new, st + 1, len(new) - en), ' ') AS inserted FROM t""",
    "edit_script": f"WITH {_TURNS} SELECT conv_id, turn, array_to_string(new, ' ') AS applied FROM pairs",
    "apply_edits": f"""WITH {DOCS}, one AS (SELECT uri, text, 'HEAD' || substr(text, least(length(text), 3) + 1) AS a FROM docs),
  f AS (SELECT uri, a, strpos(a, chr(10)) AS nl FROM one)
  SELECT uri, md5(CASE WHEN nl > 0 THEN substr(a, 1, nl) || 'SECOND ' || substr(a, nl + 1) ELSE a END) AS digest FROM f""",
    "changes_feed": f"""WITH {DOCS} SELECT doc_id // 100 AS version, CASE doc_id % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'A' ELSE 'D' END AS op, uri AS path FROM docs WHERE doc_id % 5 <> 4""",
    "sample_fragments": on_docs(", f AS (SELECT uri, min(frag_id) AS frag_id FROM lines WHERE len(toks) BETWEEN 20 AND 50 GROUP BY uri) SELECT uri, frag_id, md5('s' || uri) AS place FROM f ORDER BY place, uri LIMIT 40"),
    "minimized_versions": """WITH v AS (SELECT d.doc_id, r.v AS version FROM documents d, (SELECT unnest([0, 1, 2]) AS v) r)
  SELECT version, 'p' || doc_id AS path FROM v WHERE version = 0 OR doc_id % 7 = version""",
    "reversed_versions": """SELECT 2 - r.v AS version, 'p' || d.doc_id AS path, r.v AS was FROM documents d, (SELECT unnest([0, 1, 2]) AS v) r WHERE d.doc_id % 3 >= r.v""",
    "versions_with_deletions": on_docs(""", f AS (SELECT uri, toks, line, row_number() OVER (PARTITION BY uri ORDER BY frag_id) AS nth FROM lines WHERE frag_id = 0)
  SELECT v.version, d.uri, CAST(length(CASE WHEN d.doc_id % 5 BETWEEN 1 AND v.version THEN substr(d.text, length(f.line) + 1) ELSE d.text END) AS BIGINT) AS n_chars
  FROM docs d JOIN f USING (uri), (SELECT unnest([0, 1, 2, 3]) AS version) v"""),
    "averaged_results": "SELECT user_id % 10 AS place, CAST(round(avg(floor(value)), 6) AS DOUBLE) AS mean FROM (SELECT user_id, value FROM events) GROUP BY 1",
    "code_clones": """SELECT * FROM (VALUES ('file:///src/A.java', 2, 4, 6, 5, 30), ('file:///src/A.java', 8, 4, 12, 5, 30)) t(uri, start_line, start_char, end_line, end_char, tokens)""",
    "config_json": """SELECT * FROM (VALUES ('blind_nodes', '["identifier"]'), ('clone_token_threshold', '50'), ('dynamic_detection', 'true'), ('extra_nodes', '[]'),
  ('fragment_query', '"(function_definition) @f"'), ('ignore_nodes', '[]'), ('incrementalParsing', 'false'), ('indexGitFilesOnly', 'false'), ('language', '"py"'), ('update_on_save', 'true')) t(name, value)""",
}
