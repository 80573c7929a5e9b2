"""DuckDB twins of the numbered queries that SQL can express; written apart from the operators, over whole tables."""

from skyledger.llm.chat_windows import BUDGET, HISTORY
from skyledger.llm.quality_rules import GROWTH, PRIOR_ROWS, SPREADS, UPPER

_FENCES = """SELECT {g} ratio, total, up + {s}::DOUBLE * (up - mid) AS fence FROM (SELECT {g} ratio, any_value(total) AS total, min(CASE WHEN upto >= 0.5 * total THEN bucket END) AS mid, min(CASE WHEN upto >= {u} * total THEN bucket END) AS up FROM
    (SELECT *, sum(n) OVER (PARTITION BY {g} ratio ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY {g} ratio) AS total
     FROM (SELECT {g} ratio, bucket, count(*) AS n FROM sk GROUP BY ALL)) GROUP BY ALL)"""


def _fences(groups: str) -> str:
    return _FENCES.format(g=groups, u=UPPER, s=SPREADS)


def _drawn(own: str, around: str) -> str:
    """An average by rows of a group's fence and that of the group around it."""
    return f"({own}.total::DOUBLE * {own}.fence + {PRIOR_ROWS}::DOUBLE * {around}.fence) / ({own}.total::DOUBLE + {PRIOR_ROWS}::DOUBLE)"


QUALITY_RULES = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
tri AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
dup AS (SELECT rid, i FROM tri QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM dup CROSS JOIN (VALUES (0), (1), (2)) v(k) GROUP BY rid),
ln AS (SELECT rid, line FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
lc AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM ln GROUP BY rid),
m AS (SELECT w.rid, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(length(array_to_string(ws, '')), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
    FROM w LEFT JOIN cov ON w.rid = cov.rid LEFT JOIN lc ON w.rid = lc.rid),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
v AS (SELECT rid, lang, source, unnest([struct_pack(ratio := 'symbols', x := (n_symbols + 0.5::DOUBLE) / (greatest(word_chars - n_symbols, 0) + 0.5::DOUBLE)),
    struct_pack(ratio := 'dup_lines', x := (n_dup_lines + 0.5::DOUBLE) / (greatest(n_lines - n_dup_lines, 0) + 0.5::DOUBLE)),
    struct_pack(ratio := 'repeats', x := (n_repeat_words + 0.5::DOUBLE) / (greatest(n_words - n_repeat_words, 0) + 0.5::DOUBLE)),
    struct_pack(ratio := 'long', x := word_chars / n_words), struct_pack(ratio := 'short', x := n_words / word_chars)]) AS s FROM b WHERE NOT base_failed),
sk AS (SELECT rid, lang, source, s.ratio AS ratio, CAST(ceil(ln(s.x) / ln({GROWTH}::DOUBLE)) AS INT) AS bucket FROM v),
q3 AS ({_fences("lang, source,")}), q2 AS ({_fences("lang,")}), q1 AS ({_fences("")}),
l2 AS (SELECT q2.lang, q2.ratio, {_drawn("q2", "q1")} AS fence FROM q2 JOIN q1 ON q1.ratio = q2.ratio),
l3 AS (SELECT q3.lang, q3.source, q3.ratio, {_drawn("q3", "l2")} AS fence FROM q3 JOIN l2 ON l2.ratio = q3.ratio AND l2.lang IS NOT DISTINCT FROM q3.lang),
over_ AS (SELECT rid, bool_or(bucket > l3.fence) AS bad FROM sk JOIN l3 ON l3.ratio = sk.ratio AND l3.lang IS NOT DISTINCT FROM sk.lang AND l3.source IS NOT DISTINCT FROM sk.source GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(bad, false) AS kept FROM b LEFT JOIN over_ USING (rid)
"""

_ESCAPED = "length({x}) + length({x}) - length(replace(replace(replace({x}, '\\', ''), '<', ''), '[', ''))"

CHAT = rf"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
k AS (SELECT *, CAST(len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]')) AS BIGINT) AS tokens, 23 + {_ESCAPED.format(x="role")} + {_ESCAPED.format(x="text")} AS chars FROM c),
t AS (SELECT *, row_number() OVER o - 1 AS pos, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM k WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
walk AS (SELECT conv_id, pos, CAST(0 AS BIGINT) AS win, CAST(0 AS HUGEINT) AS before, CAST(0 AS BIGINT) AS first FROM t WHERE pos = 0
    UNION ALL SELECT t.conv_id, t.pos, CASE WHEN t.upto - w.before > {BUDGET} AND t.pos > w.first THEN w.win + 1 ELSE w.win END, CASE WHEN t.upto - w.before > {BUDGET} AND t.pos > w.first THEN t.upto - t.tokens ELSE w.before END,
    CASE WHEN t.upto - w.before > {BUDGET} AND t.pos > w.first THEN t.pos ELSE w.first END FROM t JOIN walk w ON t.conv_id = w.conv_id AND t.pos = w.pos + 1),
wins AS (SELECT DISTINCT conv_id, win, first FROM walk),
lead AS (SELECT n.conv_id, sum(t.chars) AS chars FROM wins n JOIN wins b ON b.conv_id = n.conv_id AND b.win = greatest(n.win - 2, 0) JOIN t ON t.conv_id = n.conv_id AND t.pos >= b.first AND t.pos < n.first
    JOIN t p ON p.conv_id = n.conv_id AND p.pos = n.first - 1 WHERE p.upto - t.upto + t.tokens <= {HISTORY} AND NOT (t.pos = 0 AND t.role = 'system') GROUP BY 1),
sys AS (SELECT n.conv_id, sum(t.chars) AS chars FROM wins n JOIN t ON t.conv_id = n.conv_id AND t.pos = 0 AND t.role = 'system' WHERE n.win > 0 GROUP BY 1),
own AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256, coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY pos), '') AS loss, sum(chars) AS chars FROM t GROUP BY 1)
SELECT conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(own.chars + coalesce(lead.chars, 0) + coalesce(sys.chars, 0) AS BIGINT) AS formatted_chars
FROM own LEFT JOIN lead USING (conv_id) LEFT JOIN sys USING (conv_id)
"""

_USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

HARD_NEGATIVES = f"""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_USABLE}),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
    FROM r a JOIN r b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (SELECT p.anchor_id, p.other_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id) AS INT) AS rank,
    s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT * FROM n WHERE rank <= 5
"""


def _code_rounds(rounds: int) -> str:
    """Codes after so many rounds: a row per component, entries as rows of the same form, one pair of steps a round."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT rid, part, entry, error FROM (SELECT c.rid, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x)) AS error
            FROM c JOIN b{k} b ON b.part = c.part AND b.pos = c.pos GROUP BY c.rid, c.part, b.entry) QUALIFY row_number() OVER (PARTITION BY rid, part ORDER BY error, entry) = 1)""")
        if k < rounds:
            steps.append(f"""m{k} AS MATERIALIZED (SELECT c.part, a.entry, c.pos, sum(c.x) AS total, count(*) AS n FROM c JOIN a{k} a ON a.rid = c.rid AND a.part = c.part GROUP BY c.part, a.entry, c.pos)""")
            steps.append(f"""b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, CASE WHEN m.n IS NULL THEN b.x ELSE CAST((m.total - ((m.total % m.n) + m.n) % m.n) // m.n AS BIGINT) END AS x
            FROM b{k} b LEFT JOIN m{k} m ON m.part = b.part AND m.entry = b.entry AND m.pos = b.pos)""")
    return ", ".join(steps)


VECTOR_CODES = f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS rid, vec_id, label, embedding FROM embeddings WHERE {_USABLE}),
w AS (SELECT CAST(ceil(max(len(embedding)) / 4) AS BIGINT) AS width FROM k),
c AS MATERIALIZED (SELECT rid, i // width AS part, i % width AS pos, CAST(coalesce(floor(1024 * CAST(embedding[i + 1] AS DOUBLE)), 0) AS BIGINT) AS x
    FROM (SELECT rid, embedding, width, unnest(range(4 * width)) AS i FROM k CROSS JOIN w)),
b0 AS MATERIALIZED (SELECT part, rid AS entry, pos, x FROM c WHERE rid < 256), {_code_rounds(4)},
e AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(error) AS BIGINT) AS error FROM a4 GROUP BY rid),
h AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b4)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN k USING (rid) CROSS JOIN h
"""

ORACLE_SQL: dict[str, str] = {"op8_chat": CHAT, "op9_quality_rules": QUALITY_RULES, "op11_hard_negatives": HARD_NEGATIVES, "op12_vector_codes": VECTOR_CODES}
