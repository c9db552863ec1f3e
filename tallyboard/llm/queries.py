"""The corpus operators as driver queries: thin wrappers over whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyboard.llm import conversation_repair, decontaminate, hard_negatives, hilbert_shards, jaccard_join, license_scan, mixing, quality_ranker, quality_rules, secret_scan, substring_dedup, suffix_dedup, warc
from tallyboard.llm.common import LOWER, cut, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal_digest(table(spark, sf_dir, "documents"))


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards.shard_documents(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_labels(table(spark, sf_dir, "documents"))


def op6_quality_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_ranker.scored(docs, quality_ranker.train(docs, table(spark, sf_dir, "labels")))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digest(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digest(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mixed(docs).select("doc_id", "source", "n_tokens", "block", "epoch", "block_rank")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), nameless=True)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archives are deleted once they are read; the result is kept by checkpoint()."""
    folder = warc.new_folder(spark)
    files = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    out = cut(warc.read_archives(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"))
    warc.delete_folder(spark, folder)
    return out


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_reports(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(hard_negatives.relabelled(table(spark, sf_dir, "embeddings")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_rules, op2_substring_dedup, op3_hilbert_shards, op4_jaccard_join, op5_license_scan, op6_quality_ranker, op7_secret_scan, op8_suffix_dedup, op9_mixing, op10_decontaminate, op11_warc, op12_conversation_repair, op13_hard_negatives)}


def _hilbert_sql() -> str:
    """op3 in SQL: cells by rank, the curve bit by bit in nested selects, CRC-32 by its table."""
    steps, x, bits = "c0", ("a", "b", "c"), hilbert_shards.BITS
    for q in (1 << k for k in range(bits - 1, 0, -1)):
        steps = f"(SELECT * REPLACE (CASE WHEN a & {q} > 0 THEN xor(a, {q - 1}) ELSE a END AS a) FROM {steps})"
        for i in x[1:]:
            steps = f"(SELECT * REPLACE (CASE WHEN {i} & {q} > 0 THEN xor(a, {q - 1}) ELSE xor(a, xor(a, {i}) & {q - 1}) END AS a, CASE WHEN {i} & {q} > 0 THEN {i} ELSE xor({i}, xor(a, {i}) & {q - 1}) END AS {i}) FROM {steps})"
    steps = f"(SELECT * REPLACE (xor(c, b) AS c) FROM (SELECT * REPLACE (xor(b, a) AS b) FROM {steps}))"
    turn = "0"
    for q in (1 << k for k in range(bits - 1, 0, -1)):
        turn = f"xor({turn}, CASE WHEN c & {q} > 0 THEN {q - 1} ELSE 0 END)"
    steps = f"(SELECT * REPLACE (xor(a, t) AS a, xor(b, t) AS b, xor(c, t) AS c) FROM (SELECT *, {turn} AS t FROM {steps}))"
    curve = " + ".join(f"((({i} >> {bit}) & 1) << {bit * 3 + 2 - k})" for bit in range(bits) for k, i in enumerate(x))
    cells, last = 1 << bits, hilbert_shards.SHARDS
    return rf"""
WITH r AS (SELECT list(list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY k) AS t FROM range(256) AS x(k)),
h AS (SELECT doc_id, source, lang, hex(encode(coalesce(text, ''))) AS h FROM documents),
d AS (SELECT doc_id, source, lang, CAST(len(h) // 2 + 16 AS BIGINT) AS size, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(h, '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INT) + 1]))) AS text_crc32 FROM h, r),
c0 AS (SELECT *, (rank() OVER (ORDER BY source NULLS FIRST) - 1) * {cells} // n AS a, (rank() OVER (ORDER BY lang NULLS FIRST) - 1) * {cells} // n AS b, (rank() OVER (ORDER BY size) - 1) * {cells} // n AS c FROM (SELECT *, count(*) OVER () AS n FROM d)),
k AS (SELECT doc_id, size, text_crc32, n, CAST({curve} AS BIGINT) AS curve FROM {steps}),
s AS (SELECT *, CAST('0x' || substr(md5(concat_ws('|', doc_id, text_crc32, size)), 1, 8) AS BIGINT) % CAST(ceil(count(*) OVER (PARTITION BY curve) / greatest({hilbert_shards.SUB_ROWS}, n // {hilbert_shards.SUBS})) AS BIGINT) AS sub FROM k),
p AS (SELECT *, row_number() OVER (ORDER BY curve, sub, doc_id NULLS FIRST, text_crc32, size) - 1 AS place FROM s),
q AS (SELECT *, place * {last} // n AS shard FROM p)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, CAST(place - (shard * n + {last - 1}) // {last} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, curve FROM q"""


def lower(text: str) -> str:
    """A-Z in lower case."""
    return text.encode().translate(LOWER).decode()


def _license_sql() -> str:
    """op5 in SQL: every line, and every window of a template's width that begins with one of its words, against every template."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    templates = ", ".join(f"({k}, {quoted(label)}, {quoted(lower(text))})" for k, (label, text) in enumerate(license_scan.TEMPLATES))
    phrases = " ".join(f"WHEN {' AND '.join(f'{c} = {quoted(w)}' for c, w in zip(('word', 'w1', 'w2', 'w3'), phrase.split()))} THEN {quoted(label)}" for phrase, label in license_scan.PHRASES)
    words = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(10)) AS ls FROM documents),
l AS (SELECT r, unnest(ls) AS l, generate_subscripts(ls, 1) AS line FROM d),
v AS (SELECT r, line, unnest(regexp_extract_all(l, {words})) AS word, generate_subscripts(regexp_extract_all(l, {words}), 1) AS j FROM l),
w AS (SELECT r, line, word, row_number() OVER (PARTITION BY r ORDER BY line, j) - 1 AS pos FROM v),
q AS (SELECT r, pos, CASE {phrases} END AS label FROM (SELECT r, pos, word, lead(word, 1) OVER o AS w1, lead(word, 2) OVER o AS w2, lead(word, 3) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY r ORDER BY pos))),
b AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM q WHERE label IS NOT NULL GROUP BY r),
t AS (SELECT t, label, unnest(regexp_extract_all(x, {words})) AS word FROM (VALUES {templates}) AS y(t, label, x)),
m AS (SELECT t, label, count(DISTINCT word) AS n, CAST(ceil(round({license_scan.CONTAINMENT} * count(DISTINCT word), 6)) AS BIGINT) AS need, {license_scan.WIDTH} * count(*) AS width FROM t GROUP BY t, label),
h AS (SELECT r, line, pos, t, word FROM w JOIN (SELECT DISTINCT t, word FROM t) USING (word)),
e AS (SELECT r, t, count(DISTINCT word) AS c FROM h GROUP BY r, t, line),
g AS (SELECT r, t FROM h JOIN m USING (t) GROUP BY r, t, need HAVING count(DISTINCT word) >= need),
f AS (SELECT x.r, x.t, x.pos, count(DISTINCT y.word) AS c FROM h x JOIN g ON g.r = x.r AND g.t = x.t JOIN m ON m.t = x.t JOIN h y ON y.r = x.r AND y.t = x.t AND y.pos >= x.pos AND y.pos < x.pos + width GROUP BY x.r, x.t, x.pos),
k AS (SELECT r, label, max(c / n) AS share FROM (SELECT r, t, c FROM e UNION ALL SELECT r, t, c FROM f) JOIN m USING (t) WHERE c >= need GROUP BY r, label),
a AS (SELECT r, label, share FROM k UNION ALL SELECT r, label, 1.0 FROM q WHERE label IS NOT NULL),
s AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM a GROUP BY r),
n AS (SELECT r, count(*) AS n_words FROM w GROUP BY r)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN n USING (r) LEFT JOIN b USING (r) LEFT JOIN s USING (r)"""


def _repair_sql() -> str:
    """op12 in SQL: distances and texts from the last row to the first, for the four states at once. A state's edits have different
    initials, so the least (cost, audit) is found row by row."""
    never, lead, wanted = 10**6, {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}, "uuau"
    names = {"u": "user", "a": "assistant"}
    least = lambda *xs: f"list_sort([{', '.join(xs)}])[1]"
    step = lambda cost, letter, there, turn=None: f"{{'c': {cost} + {there}.c, 'a': '{letter}' || {there}.a, 't': {f'list_prepend({turn}, {there}.t)' if turn else f'{there}.t'}}}"
    rows, layers = [], []
    for x in range(4):
        w, to = wanted[x], lead[x][wanted[x]]
        keep = [f"CASE WHEN fault IN (1, 2) OR initial <> '{r}' THEN {{'c': {never}, 'a': '~', 't': ['']}} ELSE {step('mend', 'K', f's{y}', 'role || chr(58) || text')} END" for r, y in lead[x].items()]
        other = f"CASE WHEN fault IN (1, 2) THEN {{'c': {never}, 'a': '~', 't': ['']}} ELSE {step('3 + mend', 'R', f's{to}', f'{chr(39)}{names[w]}:{chr(39)} || text')} END"
        rows.append(f"{least(step(4, 'D', f's{x}'), *keep, other)} AS s{x}")
        layers.append(f"{least(f's{x}', step(3, 'I', f's{to}', f'{chr(39)}{names[w]}:{chr(39)}'))} AS s{x}")
    layer = ", ".join(layers)
    last = ", ".join(f"CAST({{'c': {0 if x in (0, 3) else never}, 'a': '', 't': []}} AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR[])) AS s{x}" for x in range(4))
    return rf"""
WITH RECURSIVE r AS (SELECT list(list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY k) AS t FROM range(256) AS x(k)),
h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS h FROM conversations),
k AS (SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(h, '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INT) + 1]))) % 20 AS k FROM h, r),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE k <> 0),
o AS (SELECT coalesce(conv_id, -1) AS id, turn, role, text, left(role, 1) AS initial, row_number() OVER w AS n, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
f AS (SELECT *, CASE WHEN bare = '' THEN 1 WHEN row_number() OVER (PARTITION BY id, role, text ORDER BY n) > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM o),
g AS (SELECT *, CASE WHEN fault = 3 THEN 3 ELSE 0 END AS mend, lag(initial) OVER (PARTITION BY id ORDER BY n) AS before FROM f),
z AS (SELECT id, max(n) AS n, {last} FROM g GROUP BY id),
z1 AS (SELECT id, n, {layer} FROM z), z2 AS (SELECT id, n, {layer} FROM z1),
p AS (SELECT id, n, s0, s1, s2, s3 FROM z2 UNION ALL SELECT id, n, {layer} FROM (SELECT id, n, {layer} FROM (SELECT p.id, p.n - 1 AS n, {', '.join(rows)} FROM p JOIN g ON g.id = p.id AND g.n = p.n))),
a AS (SELECT id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 1) AS blank, count_if(fault = 2) AS duplicate, count_if(fault = 3) AS truncated, count_if(n > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY id),
e AS (SELECT id, s0.c AS cost, s0.a AS audit, sha256(array_to_string(s0.t, chr(10))) AS sha FROM p WHERE n = 0)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
  CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN a ON a.id = coalesce(conv_id, -1) LEFT JOIN e ON e.id = coalesce(conv_id, -1)"""


ORACLE_SQL = {
    "op12_conversation_repair": _repair_sql(),
    "op11_warc": """
SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
  CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to, TRUE AS intact
FROM (SELECT page_id, html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)""",
    "op13_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.e, b.e), lambda x: x[1] * x[2])) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10""",
    "op5_license_scan": _license_sql(),
    "op3_hilbert_shards": _hilbert_sql(),
    "op1_quality_rules": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, ws FROM t WHERE len(ws) >= 8),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM w),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, sum(least(8, coalesce(i - p, 8))) AS n FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup FROM (SELECT doc_id, unnest(string_split(x, chr(10))) AS l FROM t) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT t.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
  length(x) - length(regexp_replace(x, '[A-Z]', '', 'g')) AS capitals, length(x) - length(replace(x, '!', '')) AS shouted, len(list_distinct(ws)) AS vocabulary
  FROM t LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, greatest(n_words, 1) AS n FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 3 * n OR word_chars > 10 * n OR 10 * n_symbols > n OR 100 * capitals > 35 * greatest(word_chars, 1)
    OR 10 * shouted > 3 * n OR 2 * n_dup_lines > n_lines OR 20 * vocabulary < n) AS kept
FROM b""",
    "op2_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 12], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13)),
h AS (SELECT doc_id, i FROM w QUALIFY min(doc_id) OVER (PARTITION BY g) < doc_id),
r AS (SELECT doc_id, list(DISTINCT k) AS ks FROM (SELECT doc_id, unnest(range(i, i + 13)) AS k FROM h) GROUP BY doc_id),
x AS (SELECT d.doc_id, len(ws) AS n, coalesce(len(ks), 0) AS gone, CASE WHEN ks IS NULL THEN ws ELSE list_select(ws, list_filter(range(1, len(ws) + 1), lambda k: NOT list_contains(ks, k))) END AS kept FROM d LEFT JOIN r USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(gone AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM x""",
    "op4_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + least(5, len(ws)) - 1], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)""",
    "op8_suffix_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 100)) AS g FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d WHERE len(h) >= 100)),
s AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM (SELECT doc_id, i FROM w QUALIFY min(doc_id) OVER (PARTITION BY g) < doc_id)),
r AS (SELECT doc_id, i, sum(CASE WHEN gap <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s),
p AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM r GROUP BY doc_id, run),
q AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS gone, list(a ORDER BY a) AS xs, list(b ORDER BY a) AS ys FROM p GROUP BY doc_id),
k AS (SELECT d.doc_id, len(h) // 2 AS n, coalesce(n_spans, 0) AS n_spans, coalesce(gone, 0) AS gone,
  CASE WHEN xs IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(xs) + 1), lambda j: substr(h, 2 * (CASE WHEN j = 0 THEN 0 ELSE ys[j] END) + 1, 2 * ((CASE WHEN j = len(xs) THEN len(h) // 2 ELSE xs[j + 1] END) - (CASE WHEN j = 0 THEN 0 ELSE ys[j] END)))), '') END AS kept
  FROM d LEFT JOIN q USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(gone AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM k""",
    "op9_mixing": r"""
WITH d AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS k, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h, CAST(h % 256 AS INTEGER) AS block, h // 256 % 256 AS part FROM documents),
b AS (SELECT k, block, sum(n_tokens) AS tokens FROM d GROUP BY k, block),
t AS (SELECT k, sum(tokens) AS total FROM b GROUP BY k),
a AS (SELECT max(total) AS most, CASE WHEN max(total) = min(total) THEN 0.0 ELSE greatest(0.0, round(1 - ln(1.5) / ln(max(total) / min(total)), 9)) END AS a FROM t WHERE total > 0),
q AS (SELECT k, total, CASE WHEN total > 0 THEN CAST(floor(round(total * pow(total / most, a - 1), 3)) AS BIGINT) ELSE 0 END AS quota FROM t, a),
e AS (SELECT b.k, block, tokens, CASE WHEN total > 0 THEN quota // total ELSE 1 END AS epochs, CASE WHEN total > 0 THEN quota % total ELSE 0 END AS rest FROM b JOIN q USING (k)),
x AS (SELECT *, CAST('0x' || substr(md5('mix|' || epoch || '|' || k || '|' || block), 1, 8) AS BIGINT) AS o FROM (SELECT *, CAST(unnest(range(0, CAST(epochs AS BIGINT) + 1)) AS INTEGER) AS epoch FROM e)),
r AS (SELECT *, CAST(row_number() OVER w - 1 AS INTEGER) AS block_rank, rest - (sum(tokens) OVER w - tokens) AS room FROM x WINDOW w AS (PARTITION BY k, epoch ORDER BY o, block ROWS UNBOUNDED PRECEDING)),
p AS (SELECT k, block, epoch, block_rank FROM r WHERE epoch < epochs OR (rest > 0 AND room >= tokens)),
c AS (SELECT k, block, epoch, block_rank, room FROM r WHERE epoch = epochs AND room > 0 AND room < tokens),
s AS (SELECT c.k, c.block, epoch, block_rank, room, part, sum(n_tokens) AS tokens, CAST('0x' || substr(md5('mix|' || epoch || '|' || c.k || '|' || c.block || '|' || part), 1, 8) AS BIGINT) AS o FROM d JOIN c ON d.k = c.k AND d.block = c.block GROUP BY ALL),
u AS (SELECT k, block, epoch, block_rank, part FROM s QUALIFY sum(tokens) OVER (PARTITION BY k ORDER BY o, part ROWS UNBOUNDED PRECEDING) <= room)
SELECT doc_id, source, n_tokens, d.block, epoch, block_rank FROM d JOIN p ON d.k = p.k AND d.block = p.block
UNION ALL SELECT doc_id, source, n_tokens, d.block, epoch, block_rank FROM d JOIN u ON d.k = u.k AND d.block = u.block AND d.part = u.part""",
    "op10_decontaminate": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
q AS (SELECT DISTINCT item, least(10, len(ws)) AS n, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS g FROM (SELECT item, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM b WHERE len(ws) > 0)),
s AS (SELECT DISTINCT n FROM q),
p AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, s WHERE len(ws) >= n)),
h AS (SELECT doc_id, p.n, i, item FROM p JOIN q ON p.g = q.g AND p.n = q.n),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
x AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN x USING (doc_id)""",
}
