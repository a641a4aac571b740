"""DuckDB SQL for the queries that SQL can express."""

from tidegrid.llm.license_scan import PHRASES, THRESHOLD, template_rows
from tidegrid.llm.license_texts import TEMPLATES

_TURNS = r"""
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
"""
_ESCAPED = r"replace(replace(replace({}, '\', '\\'), '#', '\#'), '</', '<\/')"
_HEAD = "'### ' || " + _ESCAPED.format("role") + " || ' ###' || chr(10)"


def _assignment(name: str, entries: str) -> str:
    """CTEs of the nearest entry of every part (distance, then index)."""
    return f"""
        {name}_all AS (
            SELECT c.rn, c.p, e.entry, CAST(sum((c.x - e.x) * (c.x - e.x)) AS BIGINT) AS distance
            FROM comps c JOIN {entries} e ON c.p = e.p AND c.i = e.i GROUP BY c.rn, c.p, e.entry
        ), {name} AS (
            SELECT rn, p, entry, distance FROM {name}_all
            QUALIFY row_number() OVER (PARTITION BY rn, p ORDER BY distance, entry) = 1
        )"""


def _moved(name: str, assigned: str, entries: str) -> str:
    """CTE of the codebooks after a round."""
    return f"""
        {name} AS (
            SELECT e.p, e.entry, e.i, coalesce(m.x, e.x) AS x FROM {entries} e LEFT JOIN (
                SELECT a.p, a.entry, c.i, CAST(floor(CAST(sum(c.x) AS DOUBLE) / count(*)) AS BIGINT) AS x
                FROM {assigned} a JOIN comps c ON a.rn = c.rn AND a.p = c.p GROUP BY a.p, a.entry, c.i
            ) m ON e.p = m.p AND e.entry = m.entry AND e.i = m.i
        )"""


_CODES = f"""
        WITH kept AS (
            SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS rn, len(embedding) // 16 AS w,
                   [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), cells AS (
            SELECT rn, w, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS j FROM kept
        ), comps AS (
            SELECT rn, j // w AS p, j % w AS i, x FROM cells
        ), e0 AS (
            SELECT p, rn - 1 AS entry, i, x FROM comps WHERE rn <= 64
        ), {_assignment("a1", "e0")}, {_moved("e1", "a1", "e0")},
        {_assignment("a2", "e1")}, {_moved("e2", "a2", "e1")},
        {_assignment("a3", "e2")}, coded AS (
            SELECT rn, string_agg(printf('%02x', entry), '' ORDER BY p) AS code, CAST(sum(distance) AS BIGINT) AS error
            FROM a3 GROUP BY rn
        ), digest AS (
            SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, entry, i)) AS codebooks_sha256 FROM e2
        )
        SELECT vec_id, label, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               codebooks_sha256
        FROM kept JOIN coded USING (rn), digest
"""

_TEMPLATES = ", ".join(f"({k}, '{label}', {step}, {share}, {words!r})"
                       for k, label, step, share, words in template_rows(TEMPLATES, THRESHOLD))
_PHRASES = " UNION ALL ".join(
    f"SELECT rn, pos, '{label}' AS label FROM marked WHERE " + " AND ".join(
        f"word{k or ''} = '{w}'" for k, w in enumerate(phrase.split())) for phrase, label in PHRASES)
_LICENSES = rf"""
        WITH docs AS (
            SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
            FROM documents
        ), positions AS (
            SELECT rn, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM docs
        ), marked AS (
            SELECT rn, pos, word, lead(word) OVER w AS word1, lead(word, 2) OVER w AS word2
            FROM positions WINDOW w AS (PARTITION BY rn ORDER BY pos)
        ), places AS ({_PHRASES}), template AS (
            SELECT * FROM (VALUES {_TEMPLATES}) t(template, label, step, share, words)
        ), template_words AS (
            SELECT template, label, step, share, len(words) AS n, unnest(words) AS word FROM template
        ), block_words AS (
            SELECT DISTINCT p.rn, t.template, t.label, t.share, t.n, p.pos // t.step - back.k AS block, p.word
            FROM positions p JOIN template_words t ON p.word = t.word, (VALUES (0), (1)) back(k)
            WHERE p.pos // t.step - back.k >= 0
        ), met AS (
            SELECT rn, label, count(*) / n AS containment FROM block_words
            GROUP BY rn, template, label, share, n, block HAVING count(*) >= share
        ), base AS (
            SELECT rn, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word,
                   string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
            FROM places GROUP BY rn
        ), every AS (
            SELECT rn, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(containment) AS containment
            FROM (SELECT rn, label, containment FROM met UNION ALL SELECT rn, label, 1.0 FROM places) GROUP BY rn
        )
        SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
               coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
               CAST(coalesce(containment, 0) AS DOUBLE) AS score
        FROM docs LEFT JOIN base USING (rn) LEFT JOIN every USING (rn)
"""

_TERMS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
          r" '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")
_SEARCH = f"""
        WITH docs AS (
            SELECT row_number() OVER () AS rn, doc_id, {_TERMS} AS words FROM documents
        ), totals AS (
            SELECT count(*) FILTER (WHERE len(words) > 0) AS n_docs, CAST(sum(len(words)) AS BIGINT) AS n_terms FROM docs
        ), tf AS (
            SELECT rn, doc_id, n, term, count(*) AS tf
            FROM (SELECT rn, doc_id, len(words) AS n, unnest(words) AS term FROM docs) GROUP BY rn, doc_id, n, term
        ), df AS (
            SELECT term, count(*) AS df FROM tf GROUP BY term
        ), weights AS (
            SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
            FROM df, totals
        ), wanted AS (
            SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark
        ), scored AS (
            SELECT item_id, rn, doc_id, CAST(sum(w * ((1000000000 * tf) //
                (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_terms))))) AS BIGINT) AS score
            FROM wanted JOIN tf USING (term) JOIN weights USING (term), totals GROUP BY item_id, rn, doc_id
        )
        SELECT item_id, CAST(row_number() OVER best AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
        WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id)
        QUALIFY row_number() OVER best <= 50
"""

_NEAR = r"""
        WITH RECURSIVE docs AS (
            SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS words
            FROM documents
        ), shingles AS (
            SELECT DISTINCT rn, array_to_string(words[p:p + 3], ' ') AS shingle
            FROM (SELECT rn, words, unnest(range(1, greatest(len(words) - 2, 2))) AS p FROM docs WHERE len(words) > 0)
        ), sizes AS (
            SELECT rn, count(*) AS n FROM shingles GROUP BY rn
        ), links AS (
            SELECT a.rn AS a, b.rn AS b FROM shingles a JOIN shingles b ON a.shingle = b.shingle
            JOIN sizes x ON a.rn = x.rn JOIN sizes y ON b.rn = y.rn
            GROUP BY a.rn, b.rn, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
        ), reach AS (
            SELECT rn AS a, rn AS b FROM docs
            UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
        ), named AS (
            SELECT reach.a AS rn, min(docs.doc_id) AS component_id FROM reach JOIN docs ON reach.b = docs.rn GROUP BY reach.a
        )
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM docs JOIN named USING (rn) LEFT JOIN sizes USING (rn)
"""

SQL = {
    "op1_chat_format": f"""
        WITH t AS ({_TURNS})
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text)
                               FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length({_HEAD} || {_ESCAPED.format("text")} || '</turn>' || chr(10))) AS BIGINT)
                   AS formatted_chars
        FROM t GROUP BY conv_id
    """,
    "op3_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY text)
    """,
    "op4_minhash": _NEAR,
    "op5_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents
        ), keyed AS (
            SELECT doc_id, pos, line,
                   translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM lines
        ), often AS (
            SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= 20
            GROUP BY key HAVING count(DISTINCT doc_id) >= 3
        ), marked AS (
            SELECT k.doc_id, k.pos, k.line, o.key IS NOT NULL AND k.doc_id <> o.holder AS dropped
            FROM keyed k LEFT JOIN often o ON k.key = o.key
        )
        SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(dropped AS INTEGER)) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
    "op11_lexical_search": _SEARCH,
    "op12_license_scan": _LICENSES,
    "op13_vector_codes": _CODES,
}
