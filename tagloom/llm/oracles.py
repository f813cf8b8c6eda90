"""DuckDB SQL of the corpus queries that SQL can express, with the thresholds written out."""

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_SPACES = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_BARE = f"length(translate(coalesce(text, ''), {_SPACES}, ''))"
_SYMBOLS = "(length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')))"

ORACLES: dict[str, str] = {}

ORACLES["op3_line_dedup"] = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS site, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT r, doc_id, site, i, raw, trim(raw, {_SPACES}) AS line,
    coalesce(trim(ls[i - 1], {_SPACES}), '#none') || chr(10) || coalesce(trim(ls[i + 1], {_SPACES}), '#none') AS context
  FROM (SELECT *, ls[i] AS raw FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM docs))),
spread AS (SELECT line FROM lines WHERE line <> '' GROUP BY line
  HAVING count(DISTINCT site) >= 10 AND count(DISTINCT context) >= 0.5 * count(*)),
kept AS (SELECT r, any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (s.line IS NOT NULL) AS n_removed,
    coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (s.line IS NULL), '') AS body
  FROM lines LEFT JOIN spread s USING (line) GROUP BY r)
SELECT doc_id, n_lines, n_removed, sha256(body) AS kept_sha256 FROM kept"""

ORACLES["op5_suffix_dedup"] = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
strings AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s FROM (SELECT *, unnest(range(0, n - 99)) AS p FROM docs WHERE n >= 100)),
firsts AS (SELECT md5(s) AS k, min(doc_id * 1000000000 + p) AS least FROM strings GROUP BY md5(s) HAVING count(*) > 1),
hits AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS step FROM strings JOIN firsts ON md5(s) = k WHERE doc_id * 1000000000 + p > least),
runs AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM (SELECT *, sum(CASE WHEN step <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM hits) GROUP BY doc_id, run),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM runs
  UNION ALL SELECT doc_id, coalesce(max(b), 0), any_value(n) FROM docs LEFT JOIN runs USING (doc_id) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS kept FROM gaps JOIN docs USING (doc_id) GROUP BY doc_id),
counts AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM runs GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id)"""

ORACLES["op6_phrase_dedup"] = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM p WHERE i + 12 <= len(ws)),
firsts AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM win JOIN firsts USING (s), range(13) t(k) WHERE doc_id > m),
kept AS (SELECT p.doc_id, string_agg(ws[p.i], ' ' ORDER BY p.i) FILTER (gone.i IS NULL) AS body, count(gone.i) AS n_removed
  FROM p LEFT JOIN gone ON p.doc_id = gone.doc_id AND p.i = gone.i GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""

ORACLES["op7_warc_archive"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS digest, max(page_id) OVER (PARTITION BY sha256(payload)) AS response FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(digest, 5 * CAST(i // 4 AS INTEGER) + 1, 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> response THEN response END AS refers_to
FROM d"""

ORACLES["op8_quality_rules"] = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS ws, {_BARE} AS word_chars, {_SYMBOLS} AS n_symbols,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {_SPACES}) <> '') AS ls FROM documents),
p AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM p) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(5) t(k) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, word_chars, n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words, greatest(len(ws), 1) AS nw, greatest(len(ls), 1) AS nl,
    len(list_filter(ws, lambda x: list_contains(['the','of','and','to','in','is','that','it','for','was','on','with','as','be','by','a','this','are','from','at','he',
      'le','la','de','et','les','des','du','un','une','en','que','pour','dans','par','sur','est','qui','au','pas','ne',
      'der','die','und','das','ist','nicht','mit','von','zu','den','dem','ein','eine','sich','auf',
      'el','los','las','y','con','para','se','por','del','es','no','lo','su'], x))) AS stops,
    len(list_filter(ls, lambda x: regexp_matches(x, '^ *[-*•]'))) AS bullets, len(list_filter(ls, lambda x: regexp_matches(x, '([.][.][.]|…) *$'))) AS ellipses
  FROM w LEFT JOIN covered USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND word_chars / nw BETWEEN 2.5 AND 12.0 AND n_symbols / nw <= 0.1
    AND (n_words < 30 OR stops / nw >= 0.06) AND n_dup_lines / nl <= 0.4 AND bullets / nl <= 0.9 AND ellipses / nl <= 0.3 AS kept
FROM m"""

ORACLES["op10_mix_sources"] = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, CAST(len({_WORDS}) AS BIGINT) AS size,
    -ln((CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0)
      / (1.0 - 0.5 * {_SYMBOLS} / greatest(length(coalesce(text, '')), 1)) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS total FROM d GROUP BY source),
ranked AS (SELECT *, [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS weight, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
ordered AS (SELECT *, 2.0 * total / weight AS ratio, coalesce(sum(2.0 * total) OVER before, 0) AS capped,
    sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS rest, 1.5 * sum(total) OVER () AS everything
  FROM ranked WINDOW before AS (ORDER BY 2.0 * total / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT arg_min((everything - capped) / rest, (ratio, rank)) FILTER ((everything - capped) / rest <= ratio) AS level FROM ordered),
t AS (SELECT source, total, round(least(2.0 * total, coalesce(level * weight, 2.0 * total)), 6)::DOUBLE AS target FROM ordered, levels),
b AS (SELECT *, CASE WHEN total > 0 THEN least(2, floor(target / total)) ELSE 0 END AS epochs FROM t),
x AS (SELECT d.*, total, target, CAST(epochs AS BIGINT) AS epochs, CAST(round(target - epochs * total) AS BIGINT) AS rest,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, total AS source_size, target, CAST(epochs * size + greatest(0, least(size, rest - ahead)) AS BIGINT) AS taken FROM x"""


def _vector_codes() -> str:
    """Lloyd's rounds as one chain of common table expressions."""
    near = """SELECT vec_id, p, e, d FROM (SELECT x.vec_id, x.p, c.e, list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i]))) AS d,
      row_number() OVER (PARTITION BY x.vec_id, x.p ORDER BY d, c.e) AS rn FROM x JOIN {book} c USING (p)) WHERE rn = 1"""
    steps = []
    for k in range(6):
        steps.append(f"a{k} AS ({near.format(book=f'b{k}')})")
        steps.append(f"""m{k} AS (SELECT p, e, list(f ORDER BY i) AS v FROM (
          SELECT p, e, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS f FROM (
            SELECT a.p, a.e, i, CAST(sum(x.v[i]) AS BIGINT) AS s, count(*) AS n FROM a{k} a JOIN x USING (vec_id, p), range(1, 9) t(i) GROUP BY ALL)) GROUP BY p, e)""")
        steps.append(f"b{k + 1} AS (SELECT b.p, b.e, coalesce(m{k}.v, b.v) AS v FROM b{k} b LEFT JOIN m{k} USING (p, e))")
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(4096 * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS (SELECT vec_id, p, v[8 * p + 1:8 * p + 8] AS v FROM kept, range(8) t(p)),
b0 AS (SELECT p, e, v FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 16) USING (vec_id)),
{", ".join(steps)}, z AS ({near.format(book="b6")}),
coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM z GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(w AS VARCHAR), ',' ORDER BY p, e, i)) FROM (SELECT p, e, i, v[i] AS w FROM b6, range(1, 9) t(i))) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""


ORACLES["op11_vector_codes"] = _vector_codes()


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII string: eight shifts per byte."""
    bits = f"flatten(list_transform(range(1, len({text}) + 1), lambda i: [ord(substr({text}, i, 1)), -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"xor(list_reduce({bits}, lambda c, x: {step}, CAST(4294967295 AS BIGINT)), 4294967295)"


def _plus(value: str, cost: str, letter: str) -> str:
    """A derivation 'cost in ten digits, audit' with one more edit; such strings sort by cost, then audit."""
    return f"(printf('%010d', CAST(substr({value}, 1, 10) AS BIGINT) + {cost}) || substr({value}, 11) || '{letter}')"


ORACLES["op12_conversation_repair"] = f"""
WITH RECURSIVE k AS (SELECT *, {_crc32("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS k FROM conversations),
d AS (SELECT conv_id AS c, turn AS t, CASE WHEN k = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy,
    CASE k WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text FROM k WHERE k > 0),
o AS (SELECT *, left(role, 1) AS ini, row_number() OVER (PARTITION BY c ORDER BY t NULLS FIRST, role, text, copy) AS i FROM d),
f AS (SELECT *, CASE WHEN trim(text, {_SPACES}) = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN right(rtrim(text, {_SPACES}), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    coalesce(lag(ini) OVER (PARTITION BY c ORDER BY i) || ini NOT IN ('su', 'ua', 'au'), false) AS illegal FROM o),
s AS (SELECT c, count(*) AS n, coalesce(max(t) - min(t) + 1 - count(DISTINCT t), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal FROM f GROUP BY c),
w AS (SELECT c, CAST(0 AS BIGINT) AS i, '0000000000' AS b0, CAST(NULL AS VARCHAR) AS b1, CAST(NULL AS VARCHAR) AS b2, CAST(NULL AS VARCHAR) AS b3 FROM s
  UNION ALL
  SELECT c, i, {_plus("b0", "3", "D")}, least({_plus("b1", "3", "D")}, CASE WHEN alive AND ini = 's' THEN {_plus("b0", "x", "K")} END),
    least({_plus("n2", "3", "D")}, CASE WHEN alive AND ini = 'u' THEN {_plus("least(b0, b1, n3)", "x", "K")} WHEN alive THEN {_plus("least(b0, b1, n3)", "x + 2", "R")} END),
    least({_plus("n3", "3", "D")}, CASE WHEN alive AND ini = 'a' THEN {_plus("n2", "x", "K")} WHEN alive THEN {_plus("n2", "x + 2", "R")} END)
  FROM (SELECT m.*, f.i, ini, fault NOT IN ('blank', 'duplicate') AS alive, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS x
    FROM (SELECT c, i AS at, b0, b1, n2, least(b3, {_plus("n2", "2", "I")}) AS n3 FROM (SELECT *, least(b2, {_plus("least(b0, b1, b3)", "2", "I")}) AS n2 FROM w)) m
    JOIN f ON f.c IS NOT DISTINCT FROM m.c AND f.i = m.at + 1)),
e AS (SELECT s.*, least(b0, b3, {_plus("least(b2, " + _plus("least(b0, b1, b3)", "2", "I") + ")", "2", "I")}) AS best FROM s JOIN w ON s.c IS NOT DISTINCT FROM w.c AND s.n = w.i),
a AS (SELECT *, CAST(substr(best, 1, 10) AS BIGINT) AS cost, substr(best, 11) AS audit FROM e),
l AS (SELECT c, j, substr(audit, j, 1) AS l FROM (SELECT c, audit, unnest(range(1, len(audit) + 1)) AS j FROM a)),
g AS (SELECT *, count(*) FILTER (l <> 'I') OVER (PARTITION BY c ORDER BY j) AS i, count(*) FILTER (l <> 'D') OVER (PARTITION BY c ORDER BY j) AS m FROM l),
h AS (SELECT g.*, role, text, max(CASE WHEN m = 1 AND l = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY g.c) AS has_s
  FROM g LEFT JOIN f ON l <> 'I' AND f.c IS NOT DISTINCT FROM g.c AND f.i = g.i),
r AS (SELECT c, string_agg(CASE WHEN l = 'K' THEN role ELSE CASE WHEN (m - has_s) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE WHEN l = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS body
  FROM h WHERE l <> 'D' GROUP BY c)
SELECT q.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN a ON q.conv_id IS NOT DISTINCT FROM a.c LEFT JOIN r ON q.conv_id IS NOT DISTINCT FROM r.c"""
