"""SQL twins of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

from movewell.llm import decontamination, outliers, secrets

_VECTORS = """
WITH v AS (
    SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vector
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
)"""

TOP_K = _VECTORS + """, scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.vector) + 1), lambda i: q.vector[i] * c.vector[i])) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.vector) = len(c.vector) WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 5
"""


def _matches(name: str, kind: int, pattern: str, kept: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
{name}_all AS (SELECT doc_id, x, regexp_extract_all(x, '{quoted}') AS v, string_split_regex(x, '{quoted}') AS b FROM t),
{name} AS (
    SELECT doc_id, {kind} AS kind, v[i] AS value,
           coalesce(list_sum(list_transform(b[1:i], lambda p: length(p))), 0)
             + coalesce(list_sum(list_transform(v[1:i - 1], lambda p: length(p))), 0) AS start
    FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM {name}_all WHERE len(v) > 0) WHERE {kept}
)"""


def _secrets(settings: secrets.Settings = secrets.Settings()) -> str:
    assign = secrets.ASSIGN.replace("'", "''")
    allowed = "|".join(f"(?:{p})" for p in settings.allowed).replace("'", "''")
    most = (f"CASE WHEN regexp_full_match(value, '[0-9a-fA-F]+') THEN {settings.most(settings.hex_bits)} "
            f"WHEN regexp_full_match(value, '[0-9A-Za-z]+') THEN {settings.most(settings.alphanumeric_bits)} "
            f"ELSE {settings.most(settings.base64_bits)} END")
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
{_matches("assign", 0, secrets.ASSIGN, f"length(regexp_extract(v[i], '{assign}', 2)) >= 8")},
{_matches("access", 1, "AKIA[A-Z0-9]+", "length(v[i]) >= 16")},
{_matches("hexes", 2, secrets.HEX, "true")},
{_matches("runs", 3, secrets.CANDIDATE, "true")},
base AS (SELECT * FROM assign UNION ALL SELECT * FROM access UNION ALL SELECT * FROM hexes),
windows AS (
    SELECT doc_id, start, value, w, substring(value, w, {secrets.WINDOW}) AS part
    FROM (SELECT *, unnest(range(1, length(value) - {secrets.WINDOW - 2})) AS w FROM runs
          WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND NOT regexp_matches(value, '{allowed}'))
),
letters AS (SELECT doc_id, start, value, w, c, count(*) AS n
            FROM (SELECT *, unnest(string_split(part, '')) AS c FROM windows) GROUP BY ALL),
sums AS (SELECT doc_id, start, value, w, sum({secrets.TERMS}[n + 1]) AS total FROM letters GROUP BY ALL),
entropy AS (SELECT doc_id, 3 AS kind, value, start FROM (SELECT doc_id, start, value, min(total) AS least FROM sums GROUP BY ALL)
            WHERE least <= {most}),
found AS (
    SELECT * FROM base UNION ALL
    SELECT e.doc_id, e.kind, e.value, e.start FROM entropy e WHERE NOT EXISTS (
        SELECT 1 FROM base b WHERE b.doc_id = e.doc_id AND b.start <= e.start AND b.start + length(b.value) >= e.start + length(e.value))
),
named AS (SELECT doc_id, kind, start, {list(secrets.KINDS)}[kind + 1] || ':' || CAST(start AS BIGINT) || ':'
                 || CAST(start + length(value) AS BIGINT) AS label FROM found),
joined AS (
    SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
           string_agg(label, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(label, ',' ORDER BY start, kind) AS spans
    FROM named GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN joined USING (doc_id)
"""


def _shingles(name: str, table: str, key: str, words: str, width: int) -> str:
    """(key, shingle): distinct shingles; a shorter text is one shingle of all its words."""
    return f"""
{name}_words AS (SELECT {key}, {words} AS w FROM {table} WHERE {key} IS NOT NULL AND text IS NOT NULL),
{name} AS (SELECT DISTINCT {key}, array_to_string(w[i:i + {width - 1}], ' ') AS shingle
           FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - {width - 2}, 2))) AS i FROM {name}_words WHERE len(w) > 0))"""


_PLAIN_WORDS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


def _leaks(settings: decontamination.Settings = decontamination.Settings()) -> str:
    return f"""
WITH {_shingles("d", "documents", "doc_id", _PLAIN_WORDS, settings.words)},
{_shingles("m", "benchmark", "item_id", _PLAIN_WORDS, settings.words)},
long AS (SELECT * FROM m WHERE item_id IN (SELECT item_id FROM m_words WHERE len(w) >= {settings.words})),
short AS (SELECT DISTINCT item_id, len(w) AS width, array_to_string(w, ' ') AS run FROM m_words WHERE len(w) BETWEEN 1 AND {settings.words - 1}),
runs AS (SELECT DISTINCT doc_id, width, array_to_string(w[i:i + width - 1], ' ') AS run FROM (
    SELECT doc_id, width, w, unnest(range(1, len(w) - width + 2)) AS i FROM d_words, (SELECT DISTINCT width FROM short) WHERE len(w) >= width)),
sizes AS (SELECT item_id, count(*) AS n_item FROM long GROUP BY item_id),
hits AS (SELECT doc_id, item_id, count(*) AS matched FROM d JOIN long USING (shingle) GROUP BY ALL)
SELECT doc_id, item_id, matched, n_item, CAST(matched * 100 // n_item AS INTEGER) AS containment
FROM hits JOIN sizes USING (item_id) WHERE matched * 100 >= n_item * {settings.containment}
UNION ALL SELECT doc_id, item_id, 1, 1, 100 FROM runs JOIN short USING (width, run)
"""


_LOWERED = ("regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
            r"'[^\x20\x09-\x0D]+')")

NEAR_DUPLICATES = f"""
WITH RECURSIVE {_shingles("s", "documents", "doc_id", _LOWERED, 4)},
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
    SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (shingle)
                      WHERE x.doc_id < y.doc_id GROUP BY ALL) p
    JOIN sizes u ON u.doc_id = a JOIN sizes v ON v.doc_id = b WHERE 100 * c >= 80 * (u.n + v.n - c)
),
twoway AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, b AS other FROM twoway UNION SELECT r.doc_id, e.b FROM reach r JOIN twoway e ON r.other = e.a),
least AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(other, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(other, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""


_UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"

FILL_IN_MIDDLE = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256('42:' || CAST(doc_id AS VARCHAR)) AS d FROM documents),
u AS (SELECT doc_id, x, regexp_extract_all(x, '{_UNIT}') AS w,
             {", ".join(f"CAST('0x' || substr(d, {8 * n + 1}, 8) AS BIGINT) AS h{n + 1}" for n in range(4))} FROM t),
v AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
             CASE WHEN doc_id IS NULL OR x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                  WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(w[1:a], '') AS before, array_to_string(w[a + 1:b], '') AS middle, array_to_string(w[b + 1:], '') AS after FROM v)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(before) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || before || '<S>' || after || '<M>' || middle
              ELSE '<S>' || after || '<P>' || before || '<M>' || middle END) AS output_sha256, sha256(x) AS restored_sha256
FROM p
"""


def _reached(name: str, source: str, key: str, value: str, share: float) -> str:
    """(key, value): the least value at which the running count reaches the share; source: key, value, n."""
    return f"""
{name} AS (SELECT {key}, min({value}) AS {value} FROM (
    SELECT {key}, {value}, sum(n) OVER (PARTITION BY {key} ORDER BY {value}) AS upto, sum(n) OVER (PARTITION BY {key}) AS everything
    FROM {source}) WHERE upto >= ceil(CAST(everything AS DOUBLE) * {share!r}e0) GROUP BY {key})"""


def _outliers(settings: outliers.Settings = outliers.Settings()) -> str:
    size, floor, least = range(outliers.SIZE), outliers._floor(settings), outliers.UNIT * settings.spread
    listed = lambda steps: ", ".join(f"{sql} AS {name}" for name, sql in steps)
    z = listed((f"z{i}", f"CAST(floor({outliers.UNIT}.0e0 * {s} + 0.5e0) AS BIGINT)") for i, s in enumerate(outliers.STATISTICS))
    off = [f"(z{i} - a{i}) / (b{i} + {least!r}e0)" for i in size]
    places = {"squares": " + ".join(f"{o} * {o}" for o in off), "largest": f"greatest({', '.join(f'{o} * {o}' for o in off)})"}
    sums = listed([*((f"s{i}", f"CAST(sum(z{i}) AS BIGINT)") for i in size),
                   *((f"t{i}_{j}", f"CAST(sum(z{i} * z{j}) AS BIGINT)") for i, j in outliers.PAIRS)])
    parts = [f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS lang, coalesce('=' || source, '') AS source,
                  coalesce(text, '') AS x FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w FROM t),
windows AS (SELECT r, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS times FROM windows) WHERE times > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) AS v(k) GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(x, chr(10))) AS line FROM t)
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
counted AS (
    SELECT w.r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, length(array_to_string(w, '')) AS word_chars,
           length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines,
           coalesce(covered.n, 0) AS n_repeat_words
    FROM w LEFT JOIN lines USING (r) LEFT JOIN covered USING (r)
),
known AS (SELECT *, n_words < {settings.least_words} OR 100 * n_repeat_words > {settings.repeat_percent} * n_words AS base_failed, {z} FROM counted),
vectors AS (SELECT * FROM known WHERE NOT base_failed)""",
             "long AS (" + " UNION ALL ".join(f"SELECT lang, source, {i} AS j, z{i} AS a FROM vectors" for i in size) + ")",
             "tallies AS (SELECT lang, source, j, a, count(*) AS n FROM long GROUP BY ALL)",
             _reached("middle", "tallies", "lang, source, j", "a", 0.5),
             """deviations AS (SELECT lang, source, j, abs(t.a - m.a) AS b, sum(n) AS n
                               FROM tallies t JOIN middle m USING (lang, source, j) GROUP BY ALL)""",
             _reached("wide", "deviations", "lang, source, j", "b", 0.5),
             f"""medians AS (SELECT lang, source, {listed((f"{c}{i}", f"max({c}) FILTER (j = {i})") for i in size for c in "ab")}
                             FROM middle JOIN wide USING (lang, source, j) GROUP BY lang, source)""",
             "placed0 AS (" + " UNION ALL ".join(
                 f"SELECT lang, source, {', '.join(f'z{i}' for i in size)}, '{start}' AS start, {outliers.PLACE.format(places[start])} AS place "
                 "FROM vectors JOIN medians USING (lang, source)" for start in outliers.STARTS) + ")"]
    for step in range(settings.rounds):
        parts += [f"tally{step} AS (SELECT lang, source, start, place, count(*) AS n FROM placed{step} GROUP BY ALL)",
                  _reached(f"border{step}", f"tally{step}", "lang, source, start", "place", settings.share),
                  f"""sums{step} AS (SELECT p.lang, p.source, p.start, count(*) AS n, {sums}
                      FROM placed{step} p JOIN border{step} b ON p.lang = b.lang AND p.source = b.source AND p.start = b.start
                      AND p.place <= b.place GROUP BY p.lang, p.source, p.start)""",
                  f"estimates{step} AS (SELECT *, {listed(outliers.factor_steps(floor, settings.prior))} FROM sums{step})",
                  f"""placed{step + 1} AS (SELECT v.lang, v.source, {", ".join(f"v.z{i}" for i in size)}, start, {listed(outliers.distance_steps())},
                      {outliers.PLACE.format("d2")} AS place
                      FROM vectors v JOIN estimates{step} e ON v.lang = e.lang AND v.source = e.source)"""]
    determinant = " * ".join(f"c{i}_{i}" for i in size)
    cut, factor = outliers.chi_square_quantile(1 - settings.tail, outliers.SIZE), outliers.consistency(settings.share, outliers.SIZE)
    parts += [f"""best AS (SELECT * FROM estimates{settings.rounds - 1}
                  QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY {determinant}, start DESC) = 1)""",
              f"""scored AS (SELECT k.*, {listed(outliers.distance_steps())} FROM known k LEFT JOIN (SELECT * EXCLUDE (n) FROM best) e
                             ON k.lang = e.lang AND k.source = e.source)"""]
    return ",\n".join(parts) + f"""
SELECT doc_id, {", ".join(outliers.COUNTS)}, base_failed, NOT base_failed AND coalesce(d2 / {factor!r}e0 <= {cut!r}e0, false) AS kept FROM scored"""


#: crc32 by its table, of which each entry is eight steps of division by the polynomial.
TRIE = r"""
WITH RECURSIVE steps(n, k, v) AS (
    SELECT n, 0, n FROM range(256) AS r(n)
    UNION ALL SELECT n, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM steps WHERE k < 8
),
entries AS (SELECT list(v ORDER BY n) AS entry FROM steps WHERE k = 8),
turns AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS place, digest, words FROM (
        SELECT conv_id, turn, sha256(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
               len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL)
),
convs AS (
    SELECT conv_id, conv_id - conv_id % 20 AS base,
           xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
               lambda acc, b: xor(entry[xor(acc, b) % 256 + 1], acc // 256), 4294967295), 4294967295) % 4 AS h
    FROM (SELECT DISTINCT conv_id FROM turns), entries
),
rebuilt AS (
    SELECT c.conv_id, t.place, digest, words, 0 AS side FROM convs c JOIN turns t ON t.conv_id = c.base AND t.place <= h
    UNION ALL SELECT c.conv_id, t.place, digest, words, 1 FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place > h
),
told AS (SELECT conv_id, digest, words, row_number() OVER (PARTITION BY conv_id ORDER BY side, place) AS depth FROM rebuilt),
paths AS (
    SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY depth) AS parent FROM (
        SELECT conv_id, 0 AS depth, '' AS key, 0 AS words FROM convs
        UNION ALL SELECT conv_id, depth, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth), words FROM told)
),
lengths AS (SELECT conv_id, max(depth) AS length FROM paths GROUP BY conv_id),
nodes AS (
    SELECT key, any_value(parent) AS parent, any_value(depth) AS depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
           string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (depth = length) AS ends
    FROM paths p JOIN lengths l ON p.conv_id = l.conv_id GROUP BY key
),
children AS (SELECT parent AS key, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
grown AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (key)),
totals AS (
    SELECT p.key, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * g.words) AS BIGINT) AS saved_tokens
    FROM grown g JOIN paths p ON p.conv_id = g.conv_id AND p.depth <= g.depth GROUP BY p.key
)
SELECT g.conv_id, CAST(g.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, g.n_convs, g.n_children, n_leaves, saved_tokens,
       sha256(coalesce(g.ends, '')) AS ends_sha256
FROM grown g JOIN totals USING (key) LEFT JOIN nodes p ON p.key = g.parent
"""

ORACLES = {"op1_topk": TOP_K, "op2_secrets": _secrets(), "op5_decontamination": _leaks(), "op10_near_duplicates": NEAR_DUPLICATES,
           "op11_fim": FILL_IN_MIDDLE, "op12_outliers": _outliers(), "op13_trie": TRIE}
