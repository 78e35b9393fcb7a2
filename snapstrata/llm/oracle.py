"""DuckDB SQL that states the results of the operators that SQL can express, from their definitions and not their methods."""

from __future__ import annotations

from snapstrata.llm.op7_license import BASE, TEMPLATES

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _reach(nodes: str) -> str:
    """Smallest id reachable over links l (x, y): a label goes on to larger ids only, so that the smallest reaches all."""
    return f"""e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l), r AS (SELECT {nodes} AS id, {nodes} AS m FROM d UNION SELECT e.y, r.m FROM r JOIN e ON e.x = r.id WHERE r.m < e.y),
        k AS (SELECT id, min(m) AS component_id FROM r GROUP BY id)"""


_OP2 = rf"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
        {_reach("doc_id")}
    SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN k ON k.id = d.doc_id
"""

_OP6 = f"""
    WITH RECURSIVE d AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
        u AS (SELECT vec_id, label, v FROM d WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
        l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
        {_reach("vec_id")}, n AS (SELECT x, count(*) AS n FROM e GROUP BY x)
    SELECT d.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id::BIGINT AS component_id, d.vec_id = component_id AS kept FROM d LEFT JOIN n ON n.x = d.vec_id JOIN k ON k.id = d.vec_id
"""


def _key_at(text: str, key: str) -> int:
    return f" {text} ".index(f" {key} ") and len(text[: f" {text} ".index(f" {key} ") - 1].split())


_TEMPLATE_ROWS = ", ".join(
    f"({k}, '{label}', {place}, '{word}', {len(text.split())}, {_key_at(text, key)}, {len(key.split())})"
    for k, (label, text, key) in enumerate(TEMPLATES) for place, word in enumerate(text.split())
)
_BASE_CASES = " ".join(
    "WHEN word = '{}'{} THEN '{}'".format(p.split()[0], "".join(f" AND lead(word, {j}) OVER o = '{w}'" for j, w in enumerate(p.split()) if j), label)
    for p, label in BASE.items()
)

_OP7 = rf"""
    WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM d),
        b AS (SELECT doc_id, pos, CASE {_BASE_CASES} END AS label FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
        g AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list_distinct(list(label))) AS base FROM b WHERE label IS NOT NULL GROUP BY doc_id),
        t(k, label, place, word, size, key_at, key_size) AS (VALUES {_TEMPLATE_ROWS}),
        m AS (SELECT doc_id, k, any_value(label) AS label, count(*) / any_value(size) AS score FROM w JOIN t ON w.word = t.word GROUP BY doc_id, k, pos - place HAVING count(*) FILTER (place >= key_at AND place < key_at + key_size) = any_value(key_size) AND count(*) / any_value(size) >= 0.5),
        f AS (SELECT doc_id, max(score) AS score, list(label) AS labels FROM m GROUP BY doc_id)
    SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(array_to_string(base, ','), '') AS base_labels,
        array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(labels, [])))), ',') AS labels,
        greatest(coalesce(score, 0), CASE WHEN n_base > 0 THEN 0.5 ELSE 0 END)::DOUBLE AS score
    FROM d LEFT JOIN g ON g.doc_id = d.doc_id LEFT JOIN f ON f.doc_id = d.doc_id
"""

_OP8 = """
    WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        s AS (SELECT doc_id, i, sha256(b[i + 1:i + 100]) AS x FROM (SELECT doc_id, b, unnest(range(0, n - 99)) AS i FROM d WHERE n >= 100)),
        a AS (SELECT doc_id, i FROM s QUALIFY row_number() OVER (PARTITION BY x ORDER BY doc_id, i) > 1),
        g AS (SELECT doc_id, i, count(*) FILTER (new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, true) AS new FROM a)),
        c AS (SELECT doc_id, min(i) AS start, max(i) + 100 AS stop FROM g GROUP BY doc_id, run),
        h AS (SELECT c.doc_id, start, stop, hex(b)[2 * coalesce(lag(stop) OVER (PARTITION BY c.doc_id ORDER BY start), 0) + 1:2 * start] AS part FROM c JOIN d ON d.doc_id = c.doc_id),
        k AS (SELECT doc_id, sum(stop - start) AS n_removed, count(*) AS n_spans, max(stop) AS stop, string_agg(part, '' ORDER BY start) AS parts FROM h GROUP BY doc_id)
    SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(CASE WHEN k.stop IS NULL THEN b ELSE unhex(parts || hex(b)[2 * k.stop + 1:]) END) AS kept_sha256
    FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""

_ESCAPED = r"regexp_replace(regexp_replace({0}, '<(\\*)(\||/?s>|</?SYS>>)', '<\\\1\2', 'g'), '\[(\\*)(/?INST\])', '[\\\1\2', 'g')"
_OP10 = rf"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) x(turn, role)),
        f AS (SELECT *, length({_ESCAPED.format("replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n')")}) + length({_ESCAPED.format("text")}) + 17 AS size FROM c),
        g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns, coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss, sum(size) AS formatted_chars FROM f GROUP BY conv_id)
    SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars FROM g
"""

_OP5 = r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
    r AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""

ORACLES = {"op2_ngram_join": _OP2, "op5_exact_dedup": _OP5, "op6_embedding": _OP6, "op7_license": _OP7, "op8_suffix": _OP8, "op10_chat": _OP10}
