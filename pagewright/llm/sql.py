"""DuckDB SQL for the operators that SQL can express.

The statements are written from the operators' definitions, with the production parameters.
"""

from __future__ import annotations

import re

from pagewright.llm import quality, secrets

#: Words and the code points in them, for every document.
_WORDS = r"""docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM docs),
word AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM split)"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _characters(ranges: str) -> str:
    """The characters of a pattern's class."""
    return "".join(x for x in map(chr, range(128)) if re.match(f"[{ranges}]", x))


def _secrets() -> str:
    located, rank = [], 0
    for p in secrets.PATTERNS:
        pattern = _quoted(p.pattern.removesuffix("+") if p.pattern.endswith("}+") else p.pattern)
        located.append(
            f"""SELECT doc_id, '{p.kind}' AS kind, {rank} AS rank, start, start + length(m) AS stop, false AS added FROM (
            SELECT doc_id, m[i] AS m, v[i] AS v, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start FROM (
            SELECT doc_id, m, v, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, {pattern}) AS m,
            regexp_extract_all(text, {pattern}, {p.group}) AS v, string_split_regex(text, {pattern}) AS g FROM docs))) WHERE length(v) >= {p.least}"""
        )
        rank += 1
    added = []
    blanked = "text"
    for length, pattern in secrets.BLANKED.items():
        blanked = f"regexp_replace({blanked}, {_quoted(pattern)}, repeat(' ', {length}), 'g')"
    equal = "|".join(f"{re.escape(c)}{{{secrets.EQUAL}}}" for c in _characters(secrets.EQUAL_CHARACTERS))
    blanked = f"regexp_replace({blanked}, {_quoted(equal)}, repeat(' ', {secrets.EQUAL}), 'g')"
    for c in secrets.CLASSES:
        pattern = _quoted(f"[{c.characters}]{{{c.window},}}")
        allow = " OR ".join(f"regexp_matches(run, {_quoted(a)})" for a in secrets.ALLOW)
        folded = "lower(run)" if c.fold else "run"
        over = f"len(list_filter(range(1, length(run) - {c.window} + 2), lambda i: list_entropy(string_split(substr({folded}, i, {c.window}), '')) > {c.bits})) > 0"
        added.append(
            f"""SELECT doc_id, '{c.kind}' AS kind, {rank} AS rank, origin AS start, origin + length(run) AS stop, true AS added FROM (
            SELECT doc_id, m[j] AS run, list_sum(list_transform(g[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:j - 1], lambda x: length(x))), 0) AS origin FROM (
            SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS j FROM (SELECT doc_id, regexp_extract_all(text, {pattern}) AS m, string_split_regex(text, {pattern}) AS g FROM blanked)))
            WHERE NOT ({allow}) AND {over}"""
        )
        rank += 1
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{p.kind}' AND NOT added) AS n_{p.kind}" for p in secrets.PATTERNS)
    line = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop)"
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), blanked AS (SELECT doc_id, {blanked} AS text FROM docs), base AS ({" UNION ALL ".join(located)}),
    extra AS ({" UNION ALL ".join(added)}),
    every AS (SELECT * FROM base UNION ALL SELECT * FROM extra e WHERE NOT EXISTS
    (SELECT 1 FROM base b WHERE b.doc_id = e.doc_id AND b.start <= e.start AND e.stop <= b.stop)),
    found AS (SELECT doc_id, {counts}, {line} FILTER (WHERE NOT added) AS base, {line} AS spans FROM every GROUP BY doc_id)
    SELECT d.doc_id, {", ".join(f"coalesce(n_{p.kind}, 0) AS n_{p.kind}" for p in secrets.PATTERNS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM docs d LEFT JOIN found f ON d.doc_id = f.doc_id"""


_TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20"""

_MIX = """WITH docs AS (SELECT doc_id, source, coalesce(strlen(text), 0) AS bytes FROM documents),
sizes AS (SELECT source, sum(bytes) AS bytes FROM docs GROUP BY source),
rates AS (SELECT source, CASE WHEN bytes > 0 THEN pow(bytes, 0.5) * (SELECT sum(bytes) FROM sizes) / (SELECT sum(pow(bytes, 0.5)) FROM sizes WHERE bytes > 0) / bytes ELSE 0 END AS rate FROM sizes),
terms AS (SELECT source, k, CASE WHEN rate > 0 THEN exp(k * ln(rate) - rate - lgamma(k + 1)) ELSE CASE WHEN k = 0 THEN 1 ELSE 0 END END AS p
FROM rates, (SELECT unnest(range(0, (SELECT CAST(ceil(max(rate + 12 * sqrt(rate) + 12)) AS BIGINT) + 1 FROM rates))) AS k) WHERE k <= ceil(rate + 12 * sqrt(rate) + 12)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
drawn AS (SELECT doc_id, source, CAST('0x' || substr(md5('mixture:' || doc_id), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM docs),
counted AS (SELECT d.doc_id, d.source, count(*) FILTER (WHERE c.c <= d.u) AS copies FROM drawn d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source GROUP BY d.doc_id, d.source)
SELECT doc_id, source, CAST(copy AS INTEGER) AS copy, CAST(copies AS INTEGER) AS copies, md5('mixture:order:' || doc_id || ':' || copy) AS shuffle_key
FROM (SELECT *, unnest(range(1, copies + 1)) AS copy FROM counted)"""


def _gram(n: int) -> str:
    """The ``n`` words from a word on, null where the text ends before."""
    return " || ' ' || ".join(["word", *(f"lead(word, {k}) OVER w" for k in range(1, n))])


def _quality() -> str:
    shares = " UNION ALL ".join(
        f"""SELECT doc_id, sum(chars) AS chars, {limit} AS most FROM (
        SELECT DISTINCT w.doc_id, w.i, length(w.word) AS chars FROM word w JOIN (
        SELECT doc_id, unnest(range(i, i + {n})) AS i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, gram ORDER BY i) AS seen FROM (
        SELECT doc_id, i, {_gram(n)} AS gram FROM word WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE gram IS NOT NULL) WHERE seen > 1) s
        ON w.doc_id = s.doc_id AND w.i = s.i) GROUP BY doc_id"""
        for n, limit in quality.LIMITS.items()
    )
    return rf"""WITH {_WORDS},
    sizes AS (SELECT doc_id, text, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols FROM split),
    lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs),
    real AS (SELECT doc_id, strlen(line) AS bytes, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS seen FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
    dup AS (SELECT doc_id, count(*) FILTER (WHERE seen > 1) AS n, coalesce(sum(bytes) FILTER (WHERE seen > 1), 0) AS bytes, sum(bytes) AS total FROM real GROUP BY doc_id),
    three AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM (SELECT doc_id, i, {_gram(3)} AS gram FROM word WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE gram IS NOT NULL),
    repeated AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS i FROM three WHERE n > 1) GROUP BY doc_id),
    shares AS ({shares}),
    over AS (SELECT DISTINCT s.doc_id FROM shares s JOIN sizes z ON s.doc_id = z.doc_id WHERE CAST(s.chars AS DOUBLE) / z.word_chars > s.most
    UNION SELECT doc_id FROM dup WHERE CAST(bytes AS DOUBLE) / total > {quality.LINE_LIMIT}),
    verdict AS (SELECT z.doc_id, z.n_words, z.word_chars, z.n_symbols, coalesce(d.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, o.doc_id IS NOT NULL AS over,
    z.n_words < 50 OR 100 * coalesce(r.n, 0) > 50 * z.n_words AS base_failed
    FROM sizes z LEFT JOIN dup d ON z.doc_id = d.doc_id LEFT JOIN repeated r ON z.doc_id = r.doc_id LEFT JOIN over o ON z.doc_id = o.doc_id)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT over AS kept FROM verdict"""


_JACCARD = r"""WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingle AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, w[i:i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM docs WHERE len(w) >= 3)
UNION ALL SELECT doc_id, w FROM docs WHERE len(w) IN (1, 2))),
sizes AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) AS component_id
FROM docs d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN (SELECT x, min(y) AS y FROM reach GROUP BY x) m ON m.x = d.doc_id"""

ORACLE_SQL: dict[str, str] = {
    "op2_secret_scan": _secrets(),
    "op4_exact_top_k": _TOP_K,
    "op5_source_mix": _MIX,
    "op6_quality_rules": _quality(),
    "op10_ngram_jaccard": _JACCARD,
}
