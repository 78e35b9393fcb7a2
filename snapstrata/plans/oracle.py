"""DuckDB SQL that states each query's result over the same tables."""

from __future__ import annotations

from snapstrata.functions.scalars import AUTHOR, PROGRAMS
from snapstrata.plans.queries import AUTHOR as WHO
from snapstrata.plans.queries import EXTENSIONS, IGNORE, KEY, PENDING_PREFIXES, PREFIXES, RAW_PATHS

_T = "t AS (SELECT doc_id, source || '/' || lang || '/' || doc_id || '.txt' AS path, encode(text) AS b FROM documents)"


def _chunks(size: int, name: str = "c", of: str = "t", keep: str = "doc_id, path") -> str:
    return f"{name} AS (SELECT *, sha256(x) AS chunk_hash, octet_length(x)::BIGINT AS n FROM (SELECT {keep}, i AS seq, b[i*{size}+1:(i+1)*{size}] AS x FROM (SELECT {keep}, b, unnest(range(0, (octet_length(b) + {size} - 1) // {size})) AS i FROM {of})))"


_R = "r AS (SELECT l_orderkey AS backup, l_partkey || ':' || l_suppkey AS chunk FROM lineitem)"
_V = "v AS (SELECT snap, conv_id, 'conv/' || conv_id || '.txt' AS path, encode(string_agg(coalesce(text, ''), chr(10) ORDER BY turn)) AS b FROM (SELECT conv_id, turn, text, unnest(range(turn, 8)) AS snap FROM conversations WHERE turn < 8) GROUP BY snap, conv_id)"
_S = "s AS (SELECT o_orderkey AS k, epoch(o_orderdate)::BIGINT AS ts, sha256(o_orderkey::VARCHAR) AS hash, o_orderpriority AS message, round(o_totalprice * 100)::BIGINT AS size FROM orders)"
_P = "p AS (SELECT user_id, sha256(user_id::VARCHAR) AS hash, count(*)::BIGINT AS uploaded FROM events GROUP BY user_id)"
_A = "a AS (SELECT path, unnest(list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) AS dir FROM t)"
_D = f"WITH {_R}, i AS (SELECT chunk, count(*) AS rc, count(*) FILTER (backup % 4 = 0) AS gone FROM r GROUP BY chunk)"


def _list(xs) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


_PLAN = f"""WITH {_V}, x AS (SELECT snap, conv_id, path, sha256(b) AS hash FROM v), o AS (SELECT path, hash FROM x WHERE snap = 3 AND conv_id % 7 <> 0), l AS (SELECT path, hash FROM x WHERE snap = 7 AND conv_id % 5 <> 0),
    plan AS (SELECT coalesce(o.path, l.path) AS path, CASE WHEN o.path IS NULL THEN 'delete_local' WHEN l.path IS NULL THEN 'restore_missing' WHEN o.hash = l.hash THEN 'skip' ELSE 'restore_changed' END AS action FROM o FULL JOIN l ON o.path = l.path)"""

#: The sizes that queries.SIZES spells.
_SIZES = (("5 MB", 5_000_000), ("64 KiB", 65_536), ("0", 0), ("1.5k", 1500), ("12b", 12), (" 2GB ", 2_000_000_000), ("3 tib", 3_298_534_883_328))
_UNITS = (("PB", 10**13), ("TB", 10**10), ("GB", 10**7), ("MB", 10**4), ("kB", 10))  # hundredths in bytes
_HUMAN = " ".join(f"WHEN bytes >= {100 * s} THEN ((bytes + {s // 2}) // {s}) // 100 || '.' || lpad((((bytes + {s // 2}) // {s}) % 100)::VARCHAR, 2, '0') || ' {u}'" for u, s in _UNITS)
_FILES = (("a/empty", b""), ("a/.hidden", b"h"), ("_x", b"x"), ("ab/z", b"zz" * 600))
# two backups: even documents, then all
_E = "e AS (SELECT chunk_hash, count(*) AS rc, max(n) AS n FROM c WHERE doc_id % 2 = 0 GROUP BY 1), a AS (SELECT chunk_hash, count(*) AS rc, max(n) AS n, chunk_hash IN (SELECT chunk_hash FROM e) AS known FROM c GROUP BY 1)"
_B = f"b AS (SELECT 'even' AS message, 1700000000 AS ts, (SELECT count(*) FROM t WHERE doc_id % 2 = 0) AS files, coalesce(sum(n), 0) AS written, coalesce(sum(n * rc), 0) AS total FROM e UNION ALL SELECT 'all', 1700086400, (SELECT count(*) FROM t), coalesce(sum(n) FILTER (NOT known), 0), coalesce(sum(n * rc), 0) FROM a), h AS (SELECT *, sha256(message || ':{WHO}:' || ts) AS hash FROM b)"

ORACLES = {
    "backup_totals": f"WITH {_T}, {_chunks(1000)}, g AS (SELECT chunk_hash, count(*) AS rc, max(n) AS n FROM c GROUP BY 1) SELECT (SELECT count(*) FROM documents)::BIGINT AS files_total, count(*)::BIGINT AS distinct_chunks, sum(rc)::BIGINT AS refs, sum(n)::BIGINT AS written_bytes, sum(n * (rc - 1))::BIGINT AS deduplicated_bytes, sum(n * rc)::BIGINT AS total_bytes FROM g",
    "chunk_files": f"WITH {_T}, {_chunks(1000)} SELECT path, seq::BIGINT AS seq, chunk_hash, n FROM c",
    "chunk_refcount": f"WITH {_T}, {_chunks(1000)} SELECT chunk_hash, count(*)::BIGINT AS refcount FROM c GROUP BY 1",
    "chunk_refs": f"WITH {_T}, {_chunks(1000)} SELECT path, seq::BIGINT AS seq, chunk_hash FROM c",
    "ref_index": f"WITH {_R} SELECT chunk, count(*)::BIGINT AS refcount FROM r GROUP BY 1",
    "file_hashes": f"WITH {_T} SELECT path, sha256(b) AS hash, octet_length(b)::BIGINT AS size, 'application/octet-stream' AS content_type, 420::INTEGER AS permissions FROM t",
    "tree_listing": f"WITH {_T} SELECT path FROM t",
    "chunk_paths": f"WITH {_R} SELECT DISTINCT sha256(chunk) AS chunk_hash, '{KEY}/chunks/' || sha256(chunk)[1:2] || '/' || sha256(chunk)[3:] AS chunk_path FROM r",
    "physical_chunks": f"WITH {_R} SELECT DISTINCT sha256(chunk) AS chunk_hash, '{KEY}/chunks/' || sha256(chunk)[1:2] || '/' || sha256(chunk)[3:] AS chunk_path FROM r",
    "snapshot_accounting": f"WITH {_V}, {_chunks(512, 'c', 'v', 'snap, conv_id, path')}, g AS (SELECT *, snap = min(snap) OVER (PARTITION BY chunk_hash) AS new FROM (SELECT snap, chunk_hash, count(*) AS rc, max(n) AS n FROM c GROUP BY 1, 2)) SELECT snap, sum(rc)::BIGINT AS refs, sum(new::INT)::BIGINT AS new_chunks, sum(n * new::INT)::BIGINT AS written_bytes, sum(n * (rc - new::INT))::BIGINT AS deduplicated_bytes FROM g GROUP BY snap",
    "snapshot_tree": f"WITH {_V} SELECT snap, path, sha256(b) AS hash, octet_length(b)::BIGINT AS size FROM v",
    "backup_against_index": f"WITH {_T}, {_chunks(1000)}, i AS (SELECT DISTINCT chunk_hash FROM c WHERE doc_id % 2 = 0), g AS (SELECT chunk_hash, count(*) AS rc, max(n) AS n, chunk_hash NOT IN (SELECT chunk_hash FROM i) AS new FROM c WHERE doc_id % 2 = 1 GROUP BY 1) SELECT count(*) FILTER (new)::BIGINT AS new_chunks, count(*) FILTER (NOT new)::BIGINT AS reused_chunks, coalesce(sum(n) FILTER (new), 0)::BIGINT AS written_bytes, sum(CASE WHEN new THEN n * (rc - 1) ELSE n * rc END)::BIGINT AS deduplicated_bytes FROM g",
    "resume_backup": f"WITH {_T}, {_chunks(1000)}, g AS (SELECT chunk_hash, max(n) AS n, bool_or(doc_id % 3 = 0) AS done FROM c GROUP BY 1) SELECT count(*) FILTER (done)::BIGINT AS skipped_chunks, count(*) FILTER (NOT done)::BIGINT AS uploaded_chunks, sum(n)::BIGINT AS written_bytes FROM g",
    "delete_orphans": f"{_D} SELECT count(*) FILTER (rc = gone)::BIGINT AS deleted_chunks, sum(rc - gone)::BIGINT AS remaining_refs FROM i",
    "delete_index_after": f"{_D} SELECT chunk, (rc - gone)::BIGINT AS refcount FROM i WHERE rc > gone",
    "delete_summary": f"WITH {_S} SELECT hash, message, ts AS timestamp, size FROM s WHERE k <> (SELECT k FROM s ORDER BY ts DESC, k DESC LIMIT 1)",
    "prune_candidates": f"{_D}, {_P} SELECT chunk AS item, 'chunk' AS kind FROM i WHERE rc = gone UNION ALL SELECT 'pending_' || hash, 'pending' FROM p",
    "encrypt_worklist": f"WITH {_R}, {_S} SELECT '{KEY}/indexes/chunks' AS path UNION ALL SELECT '{KEY}/indexes/backups' UNION ALL SELECT DISTINCT '{KEY}/chunks/' || sha256(chunk)[1:2] || '/' || sha256(chunk)[3:] FROM r UNION ALL SELECT '{KEY}/backups/' || hash FROM s",
    "encrypt_status": "SELECT count(*) FILTER (doc_id % 3 <> 0)::BIGINT AS encrypted, count(*) FILTER (doc_id % 3 = 0)::BIGINT AS already_encrypted FROM documents",
    "maybe_decrypt": "SELECT doc_id % 2 = 0 AS was_encrypted, count(*)::BIGINT AS opened FROM documents GROUP BY 1",
    "only_select": f"WITH {_T} SELECT DISTINCT path FROM t WHERE doc_id = 7 OR starts_with(path, 'src0/de/') OR starts_with(path, 'src1/')",
    "only_normalize": "SELECT raw, regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(raw, '^\\s+|\\s+$', '', 'g'), '\\', '/'), '^(\\./)+', ''), '^/+', ''), '/+$', '') AS normalized FROM (SELECT unnest([" + _list(RAW_PATHS) + "]) AS raw UNION ALL SELECT './' || source || '/' || lang || '/' || doc_id || '.txt/' FROM documents)",
    "path_search": f"WITH {_T} SELECT path, '/' || path AS display FROM t WHERE contains(lower(path), lower('SRC1/EN'))",
    "ignore_filter": f"WITH {_T} SELECT path FROM t WHERE NOT list_has_any(string_split(path, '/'), [{_list(IGNORE)}])",
    "dir_tree": f"WITH {_T}, {_A}, e AS (SELECT DISTINCT dir AS p, true AS is_dir FROM a UNION ALL SELECT path, false FROM t) SELECT array_to_string(string_split(p, '/')[1:len(string_split(p, '/')) - 1], '/') AS parent, string_split(p, '/')[-1] AS name, is_dir FROM e",
    "selection_rollup": f"WITH t0 AS (SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, doc_id IN (SELECT doc_id FROM labels) AS selected FROM documents), t AS (SELECT * FROM t0 UNION ALL SELECT 'all/' || path, selected FROM t0 WHERE selected), {_A}, x AS (SELECT a.dir, t.selected FROM a JOIN t ON a.path = t.path) SELECT dir AS path, CASE WHEN bool_and(selected) THEN 'Selected' WHEN bool_or(selected) THEN 'Partial' ELSE 'None' END AS state FROM x GROUP BY dir",
    "cleanup_dirs": f"WITH {_T}, {_A} SELECT DISTINCT dir, len(string_split(dir, '/'))::BIGINT AS depth FROM a",
    "restore_plan": f"{_PLAN} SELECT path, action FROM plan",
    "restore_plan_counts": f"{_PLAN} SELECT action, count(*)::BIGINT AS n FROM plan GROUP BY action",
    "restore_reassemble": f"WITH {_T} SELECT path, sha256(b) AS hash, sha256(b) AS reassembled_hash, true AS ok FROM t",
    "log": f"WITH {_S} SELECT hash AS backup, hash[1:8] AS backup_short, message, strftime(make_timestamp(ts * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS timestamp, ts AS timestamp_unix, size AS size_bytes FROM s",
    "log_page": f"WITH {_S}, n AS (SELECT hash, row_number() OVER (ORDER BY ts DESC, k DESC) AS rn FROM s) SELECT 2::BIGINT AS page, rn, hash[1:8] AS backup_short FROM n WHERE rn BETWEEN 11 AND 20",
    "recent_top10": f"WITH {_S}, n AS (SELECT hash, row_number() OVER (ORDER BY ts DESC, k DESC) AS rn FROM s) SELECT 1::BIGINT AS page, rn, hash[1:8] AS backup_short FROM n WHERE rn <= 10",
    "resolve_prefix": f"WITH {_S}, q AS (SELECT unnest([{_list(PREFIXES)}]) AS prefix) SELECT prefix, CASE WHEN octet_length(encode(prefix)) > 8 THEN prefix ELSE (SELECT arg_max(hash, (ts, k)) FROM s WHERE starts_with(hash, prefix)) END AS hash FROM q",
    "resolve_pending": f"WITH {_P}, q AS (SELECT unnest([{_list(PENDING_PREFIXES)}]) AS prefix) SELECT prefix, (SELECT max(hash) FROM p WHERE starts_with(hash, prefix)) AS hash FROM q",
    "pending_list": f"WITH {_P} SELECT hash AS backup, hash[1:8] AS backup_short, uploaded AS uploaded_chunks FROM p",
    "progress_percent": "WITH x AS (SELECT user_id, count(*) FILTER (event_id % 3 = 0) AS processed, count(*) FILTER (event_id % 2 = 0) AS total FROM events GROUP BY user_id) SELECT user_id, processed, total, CASE WHEN total = 0 THEN 0 ELSE processed * 100 // total END AS percent, (total + 9) // 10 AS pages FROM x",
    "author_check": f"WITH x AS (SELECT c_custkey, c_name, CASE c_custkey % 4 WHEN 0 THEN 'Ada Lovelace <c' || c_custkey || '@mail.org>' WHEN 1 THEN c_name || ' <x@y.z>' WHEN 2 THEN 'Ada <' || c_custkey || '@b.c>' ELSE 'Ada B Lovelace<' || c_custkey || '@h.co>' END AS value FROM customer) SELECT c_custkey, value, regexp_matches(value, '{AUTHOR}') AS valid, regexp_matches(c_name, '^[A-Za-z0-9_-]*$') AS name_ok, regexp_matches(replace(c_name, '#', '-'), '^[A-Za-z0-9_-]*$') AS dashed_ok FROM x",
    "permission_bits": "SELECT p_partkey, ((p_partkey * 37 + 32768) & 511)::BIGINT AS bits FROM part",
    "backup_names": "WITH x AS (SELECT o_orderkey, sha256(o_orderpriority || ':Ada Lovelace <ada@mail.org>:' || epoch(o_orderdate)::BIGINT) AS hash FROM orders) SELECT o_orderkey, hash, hash[1:8] AS backup_short FROM x",
    "stream_refcount": "SELECT sha256(props) AS chunk_hash, count(*)::BIGINT AS refcount FROM events GROUP BY 1",
    "stream_first_seen": "SELECT DISTINCT sha256(props) AS chunk_hash FROM events",
    "codec_roundtrip": f"WITH {_T} SELECT path, true AS ok FROM t",
    "tree_scan": "SELECT path, size::BIGINT AS size, sha256(body) AS hash FROM (VALUES " + ", ".join(f"('{p}', {len(b)}, '{b.decode()}')" for p, b in _FILES) + ") x(path, size, body)",
    "relative_paths": f"WITH {_T}, f AS (SELECT CASE WHEN doc_id % 3 = 0 THEN '/r' ELSE '/s\\' END || CASE WHEN doc_id % 2 = 0 THEN '/' ELSE '\\' END || path AS \"full\" FROM t), g AS (SELECT \"full\", replace(CASE WHEN starts_with(\"full\", '/r') THEN \"full\"[3:] ELSE \"full\" END, '\\', '/') AS p FROM f) SELECT \"full\", CASE WHEN p[1] = '/' THEN p[2:] ELSE p END AS path FROM g",
    "local_times": f"WITH {_S} SELECT hash, strftime(make_timestamp((ts + 32400) * 1000000), '%Y-%m-%d %H:%M:%S') AS local FROM s",
    "human_sizes": f"WITH x AS (SELECT DISTINCT CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey % 1000 ELSE round(o_totalprice * 100)::BIGINT * [1, 100, 10000, 1000000, 100000000][o_orderkey % 5 + 1] END::BIGINT AS bytes FROM orders) SELECT bytes, CASE {_HUMAN} ELSE bytes || ' B' END AS shown FROM x",
    "parse_sizes": "SELECT text, bytes::BIGINT AS bytes FROM (VALUES " + ", ".join(f"('{x}', {n})" for x, n in _SIZES) + ") x(text, bytes)",
    "fallback_modes": f"WITH x AS (SELECT p_partkey AS k, [{_list(EXTENSIONS)}][p_partkey % {len(EXTENSIONS)} + 1] AS ext FROM part) SELECT 'd.x/' || k || ext AS path, (292 + CASE WHEN k % 5 = 0 THEN 0 ELSE 128 END + CASE WHEN lower(ext) IN ({_list('.' + x for x in PROGRAMS)}) THEN 73 ELSE 0 END)::BIGINT AS mode FROM x",
    "progress_events": "WITH x AS (SELECT user_id, count(*) FILTER (event_id % 3 = 0) AS processed, count(*) FILTER (event_id % 2 = 0) AS total FROM events GROUP BY user_id) SELECT user_id, '{\"type\":\"progress\",\"data\":{\"percent\":' || CASE WHEN total = 0 THEN 0 ELSE processed * 100 // total END || ',\"total\":' || total || ',\"processed\":' || processed || '}}' AS line FROM x",
    "repository_results": f"WITH {_T}, {_chunks(1000)}, {_E}, {_B} SELECT hash AS backup, hash[1:8] AS backup_short, message, '{WHO}' AS author, ts::BIGINT AS timestamp_unix, files::BIGINT AS files_total, written::BIGINT AS written_bytes, (total - written)::BIGINT AS deduplicated_bytes FROM h",
    "repository_log": f"WITH {_T}, {_chunks(1000)}, {_E}, {_B} SELECT hash AS backup, hash[1:8] AS backup_short, message, strftime(make_timestamp(ts::BIGINT * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS timestamp, ts::BIGINT AS timestamp_unix, written::BIGINT AS size_bytes FROM h",
    "repository_tree": f"WITH {_T} SELECT sha256('even:{WHO}:1700000000') AS backup_hash, path, sha256(b) AS hash, octet_length(b)::BIGINT AS size, 'application/octet-stream' AS content_type, 420::INTEGER AS permissions, ((octet_length(b) + 999) // 1000)::BIGINT AS n_chunks FROM t WHERE doc_id % 2 = 0",
    "repository_contents": f"WITH {_T} SELECT path, sha256(b) AS hash, octet_length(b)::BIGINT AS size, 420::INTEGER AS permissions FROM t",
    "repository_index": f"WITH {_T}, {_chunks(1000)} SELECT chunk_hash, count(*)::BIGINT AS refcount FROM c WHERE doc_id % 2 = 0 GROUP BY 1",
    "stored_chunks": f"WITH {_T}, {_chunks(1000)} SELECT DISTINCT chunk_hash, 1::BIGINT AS copies FROM c",
    "repository_encrypt": f"WITH {_T}, {_chunks(1000)}, n AS (SELECT count(DISTINCT chunk_hash) + 4 AS n FROM c) SELECT 0::INTEGER AS run, n::BIGINT AS encrypted, 0::BIGINT AS already_encrypted FROM n UNION ALL SELECT 1, 0, n FROM n",
    "repository_prune": "SELECT run::INTEGER AS run, CASE WHEN run = 1 THEN (SELECT count(*) FROM documents WHERE doc_id % 5 = 0) ELSE 0 END::BIGINT AS deleted_items, run = 0 AS aborted FROM range(3) x(run)",
    "repository_restore": f"WITH {_T} SELECT path, sha256(b) AS hash, octet_length(b)::BIGINT AS size FROM t WHERE starts_with(path, 'src1/')",
}
