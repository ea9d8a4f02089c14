"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

GAP = r"[^\x20\x09-\x0D]+"

# All shards: rows in the order of doc_id and size, dealt by the middle of their bytes.
SHARDING = """
WITH sized AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) + 16 AS BIGINT) AS size, text FROM documents
), placed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS before,
    row_number() OVER (ORDER BY doc_id NULLS FIRST, size) - 1 AS rank, sum(size) OVER () AS total
  FROM sized
), cut AS (
  SELECT *, CAST(least(39, ((2 * before + size) * 40) // (2 * total)) AS INTEGER) AS shard FROM placed
)
SELECT doc_id, size, shard, CAST(rank - min(rank) OVER (PARTITION BY shard) AS BIGINT) AS slot
FROM cut
"""

DECONTAMINATION = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark
), it AS (
  SELECT DISTINCT item_id, least(5, len(w)) AS n, array_to_string(w[k:k + least(5, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)
), need AS (
  SELECT item_id, n, count(*) AS n_item FROM it GROUP BY item_id, n
), ds AS (
  SELECT DISTINCT doc_id, n, array_to_string(w[k:k + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS k FROM d, (SELECT DISTINCT n FROM it) WHERE len(w) >= n)
)
SELECT doc_id, item_id, CAST(any_value(n_item) AS INTEGER) AS n_item, CAST(count(*) AS INTEGER) AS n_shared
FROM ds JOIN it USING (n, s) JOIN need USING (item_id, n)
GROUP BY doc_id, item_id
HAVING 100 * count(*) >= 80 * any_value(n_item)
"""

PREFERENCES = """
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM turns
), pairs AS (
  SELECT DISTINCT a.conv_id AS chosen_id, b.conv_id AS rejected_id, a.conv_id // 2 AS pair_id
  FROM turns a JOIN turns b ON b.conv_id = a.conv_id + 1 WHERE a.conv_id % 2 = 0
), shared AS (
  SELECT pair_id, chosen_id, rejected_id, count(*) FILTER (WHERE k < coalesce(broken, 1e18)) AS n_prompt_turns
  FROM (
    SELECT p.*, c.k, min(CASE WHEN r.k IS NULL THEN c.k END) OVER (PARTITION BY pair_id) AS broken
    FROM pairs p JOIN numbered c ON c.conv_id = p.chosen_id
    LEFT JOIN numbered r ON r.conv_id = p.rejected_id AND r.k = c.k AND r.role = c.role AND r.text = c.text
  ) GROUP BY ALL
), parts AS (
  SELECT pair_id, conv_id, k, role, k <= n_prompt_turns AS in_prompt,
    '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS told,
    length(role) + 13 AS head, length(text) + 10 AS body
  FROM shared JOIN numbered ON conv_id IN (chosen_id, rejected_id)
), placed AS (
  SELECT *, sum(head + body + 1) OVER (PARTITION BY pair_id, conv_id, in_prompt ORDER BY k ROWS UNBOUNDED PRECEDING) - (head + body + 1) AS pos
  FROM parts
), sides AS (
  SELECT pair_id, conv_id,
    coalesce(string_agg(told, '' ORDER BY k) FILTER (WHERE in_prompt), '') AS prompt,
    coalesce(string_agg(told, '' ORDER BY k) FILTER (WHERE NOT in_prompt), '') AS completion,
    coalesce(string_agg(CAST(pos + head AS BIGINT) || ':' || CAST(pos + head + body AS BIGINT), ',' ORDER BY k)
      FILTER (WHERE NOT in_prompt AND role = 'assistant'), '') AS mask
  FROM placed GROUP BY pair_id, conv_id
)
SELECT s.pair_id, s.chosen_id, s.rejected_id, CAST(n_prompt_turns AS INTEGER) AS n_prompt_turns, c.prompt,
  c.completion AS chosen, r.completion AS rejected, c.mask AS chosen_mask, r.mask AS rejected_mask
FROM shared s
JOIN sides c ON c.pair_id = s.pair_id AND c.conv_id = s.chosen_id
JOIN sides r ON r.pair_id = s.pair_id AND r.conv_id = s.rejected_id
"""

# Each conversation against its own turns with the next one's last answer in place of its last.
ANSWER_PREFERENCES = """
WITH numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k
  FROM (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), answers AS (
  SELECT conv_id, max(k) AS own, arg_max(text, k) AS answer FROM numbered WHERE role = 'assistant' GROUP BY conv_id
), pairs AS (
  SELECT conv_id, own, coalesce(lead(conv_id) OVER w, first_value(conv_id) OVER w) AS rejected_id, coalesce(lead(answer) OVER w, first_value(answer) OVER w) AS other
  FROM answers WINDOW w AS (ORDER BY conv_id)
), sides AS (
  SELECT conv_id, rejected_id, k, role, true AS is_chosen, text, k = own AND text <> other AS differs FROM numbered JOIN pairs USING (conv_id)
  UNION ALL
  SELECT conv_id, rejected_id, k, role, false, CASE WHEN k = own THEN other ELSE text END, k = own AND text <> other FROM numbered JOIN pairs USING (conv_id)
), shared AS (
  SELECT *, coalesce(min(CASE WHEN differs THEN k END) OVER (PARTITION BY conv_id) - 1, max(k) OVER (PARTITION BY conv_id)) AS n_prompt_turns FROM sides
), parts AS (
  SELECT *, k <= n_prompt_turns AS in_prompt, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS told, length(role) + 13 AS head, length(text) + 10 AS body FROM shared
), placed AS (
  SELECT *, sum(head + body + 1) OVER (PARTITION BY conv_id, is_chosen, in_prompt ORDER BY k ROWS UNBOUNDED PRECEDING) - (head + body + 1) AS pos FROM parts
), told AS (
  SELECT conv_id, is_chosen, any_value(rejected_id) AS rejected_id, any_value(n_prompt_turns) AS n_prompt_turns,
    coalesce(string_agg(told, '' ORDER BY k) FILTER (WHERE in_prompt), '') AS prompt, coalesce(string_agg(told, '' ORDER BY k) FILTER (WHERE NOT in_prompt), '') AS completion,
    coalesce(string_agg(CAST(pos + head AS BIGINT) || ':' || CAST(pos + head + body AS BIGINT), ',' ORDER BY k) FILTER (WHERE NOT in_prompt AND role = 'assistant'), '') AS mask
  FROM placed GROUP BY conv_id, is_chosen
)
SELECT c.conv_id AS pair_id, c.conv_id AS chosen_id, c.rejected_id, CAST(c.n_prompt_turns AS INTEGER) AS n_prompt_turns, c.prompt,
  c.completion AS chosen, r.completion AS rejected, c.mask AS chosen_mask, r.mask AS rejected_mask
FROM told c JOIN told r ON r.conv_id = c.conv_id AND c.is_chosen AND NOT r.is_chosen
"""

# op8 by brute force over all pairs that share a shingle; components by repeated minima along links.
JACCARD = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + least(4, len(w)) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, CAST(len(w) - least(4, len(w)) + 2 AS BIGINT))) AS k FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), least_of AS (
  SELECT a, min(b) AS b FROM reach GROUP BY a
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(least_of.b, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least_of ON least_of.a = d.doc_id
"""

JACCARD_LINKS = (
    JACCARD.replace("AS component_id\n", "AS component_id, CAST(coalesce(many.n, 0) AS BIGINT) AS n_links\n")
    + "LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) many ON many.a = d.doc_id\n"
)


def _spans(kind: int, name: str, regex: str, flags: str, least: int, group: int) -> str:
    """Matches by the lengths of what is between them: rows doc_id, start, kind number, end, span."""
    return rf"""
f{kind} AS MATERIALIZED (
  SELECT doc_id, text, regexp_extract_all(text, '{regex}', 0{flags}) AS hits, regexp_extract_all(text, '{regex}', {group}{flags}) AS kepts
  FROM documents WHERE regexp_matches(text, '{regex}')
), g{kind} AS MATERIALIZED (
  SELECT doc_id, hits, kepts, string_split_regex(text, '{regex}'{flags}) AS gaps FROM f{kind}
), h{kind} AS (
  SELECT doc_id, k, hits[k] AS hit, kepts[k] AS kept, length(gaps[k]) + (CASE WHEN k > 1 THEN length(hits[k - 1]) ELSE 0 END) AS before
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM g{kind})
), s{kind} AS (
  SELECT doc_id, start, {kind} AS kind, '{name}:' || start || ':' || (start + length(hit)) AS span
  FROM (SELECT *, sum(before) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS start FROM h{kind})
  WHERE length(kept) >= {least}
)"""


_CLASS = r"[A-Za-z0-9+/_.=-]+"
_ASSIGN = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "(password|passwd|secret|token|api_?key)") + r"""["'']?\x20*[:=]\x20*["'']?(""" + _CLASS + ")"
_KINDS = (
    ("assign", _ASSIGN, 12, 2),
    ("access", r"AKIA[A-Z0-9]+", 18, 0),
    ("hex", r"[0-9a-f]{16,}", 16, 0),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 0),
    ("forge_token", r"(?:ghp|gho|ghs|ghr)_[A-Za-z0-9]{36,}", 0, 0),
    ("bearer", r"[bB][eE][aA][rR][eE][rR]\x20+[A-Za-z0-9+/_.=~-]{20,}", 0, 0),
)
SECRETS = (
    "WITH "
    + ",".join(_spans(i, name, regex, "", least, group) for i, (name, regex, least, group) in enumerate(_KINDS))
    + ", spans AS ("
    + " UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(len(_KINDS)))
    + """
), by_doc AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
    string_agg(span, ',' ORDER BY start, kind) FILTER (WHERE kind < 3) AS base, string_agg(span, ',' ORDER BY start, kind) AS spans
  FROM spans GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access,
  CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN by_doc b ON b.doc_id = d.doc_id
"""
)

# crc32 by its table of 256 remainders, made here from the polynomial, over the bytes of each text.
SHARD_DIGEST = f"""
WITH crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) AS r(i)
), bytes AS (
  SELECT doc_id, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS b FROM documents
), summed AS (
  SELECT doc_id, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS BIGINT) AS text_crc32
  FROM bytes, crc
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, slot, CAST(NULL AS INTEGER) AS grown_shard
FROM summed JOIN ({SHARDING}) USING (doc_id)
"""

URL_RULES = r"""
WITH parts AS (
  SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages
), named AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, CASE WHEN starts_with(after, '/') THEN regexp_extract(after, '^[^?#]*') ELSE '' END AS path
  FROM (SELECT page_id, h, substr(rest, length(h) + 1) AS after FROM (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM parts))
), rules(verdict, rule_host, rule_path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fits AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS rule_verdict
  FROM named JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id
)
SELECT page_id, host, path, rule, rule_verdict FROM named LEFT JOIN fits USING (page_id)
"""

BASE_RULES = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), runs AS (
  SELECT doc_id, k, array_to_string(w[k:k + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, CAST(len(w) - 6 AS BIGINT))) AS k FROM d WHERE len(w) >= 8)
), twice AS (
  SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, s) AS n FROM runs) WHERE n > 1
), repeated AS (
  SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(k, k + 8)) AS place FROM twice) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), counts AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN lines ON lines.doc_id = d.doc_id LEFT JOIN repeated ON repeated.doc_id = d.doc_id
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts
"""

# The table of crc32's 256 remainders, made from the polynomial; and the crc32 of a column of short ASCII text by it.
CRC_TABLE = """
SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
FROM range(256) AS r(i)
"""
CRC_OF_ID = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"""


def _trees(name: str, levels: int) -> str:
    """The levels of the trees over {name}0 (grp, i, n, d): nodes {name}1, ..., and children by parent {name}c0, ... of those not done."""
    out = []
    for k in range(levels):
        out.append(f"""{name}{k + 1} AS MATERIALIZED (
  SELECT grp, i // 3 AS i, (max(n) + 2) // 3 AS n, CASE WHEN max(n) > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE max(d) END AS d FROM {name}{k} GROUP BY grp, i // 3
), {name}c{k} AS MATERIALIZED (
  SELECT grp, i // 3 AS i, {", ".join(f"coalesce(max(CASE WHEN i % 3 = {j} THEN d END), '') AS c{j}" for j in range(3))}
  FROM {name}{k} WHERE n > 1 GROUP BY grp, i // 3
)""")
    return ", ".join(out)


def _climbed(source: str, name: str, grp: str, place: str, levels: int) -> str:
    """Subquery over {source}: all its columns, with acc folded and proof lengthened by the levels of {name}."""
    query = source
    for k in range(levels):
        slot = f"{place} // {3**k} % 3"
        beside = " || ".join(f"CASE WHEN {slot} = {j} THEN '' ELSE c{j} END" for j in range(3))
        told = " || ".join(f"CASE WHEN {slot} = {j} THEN acc ELSE c{j} END" for j in range(3))
        query = f"""(SELECT s.* REPLACE (CASE WHEN c0 IS NULL THEN acc ELSE sha256({told}) END AS acc, CASE WHEN c0 IS NULL THEN proof ELSE proof || {beside} END AS proof)
  FROM {query} s LEFT JOIN {name}c{k} c ON c.grp = s.{grp} AND c.i = s.{place} // {3 ** (k + 1)})"""
    return query


def _leaf(text: str) -> str:
    fields = ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)
    return "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in fields) + ")"


# Levels enough for 3**13 rows of a source and 3**6 sources.
_ROW_LEVELS, _SOURCE_LEVELS = 13, 6
MERKLE = f"""
WITH crc AS ({CRC_TABLE}), leaves AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || source, '') AS grp, {_leaf("text")} AS leaf, CASE WHEN {CRC_OF_ID} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS claim
  FROM documents, crc
), placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST) - 1 AS place, count(*) OVER (PARTITION BY grp) AS n FROM leaves
), r0 AS MATERIALIZED (
  SELECT grp, place AS i, n, leaf AS d FROM placed
), {_trees("r", _ROW_LEVELS)}, subroots AS MATERIALIZED (
  SELECT grp AS of_source, d, row_number() OVER (ORDER BY grp) - 1 AS nth, count(*) OVER () AS n FROM r{_ROW_LEVELS}
), s0 AS MATERIALIZED (
  SELECT '' AS grp, nth AS i, n, d FROM subroots
), {_trees("s", _SOURCE_LEVELS)}, held AS MATERIALIZED (
  SELECT doc_id, p.grp, place, leaf, u.d AS subroot, '' AS top, u.nth, claim AS acc, '' AS proof FROM placed p JOIN subroots u ON u.of_source = p.grp
)
SELECT doc_id, leaf, subroot, o.d AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = o.d AS verified
FROM {_climbed(_climbed("held", "r", "grp", "place", _ROW_LEVELS), "s", "top", "nth", _SOURCE_LEVELS)}, s{_SOURCE_LEVELS} o
"""

# Base 32 of a SHA-1 in hexadecimal, five bits at a time.
WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) || '0' AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS f FROM pages
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  list_reduce(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((CAST('0x' || substr(h, 1 + 5 * k // 4, 2) AS INTEGER)) >> (3 - 5 * k % 4)) & 31) + 1, 1)), lambda a, b: a || b) AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM f THEN f END AS refers_to
FROM p
"""

ORACLES = {
    "op2_benchmark_decontamination": DECONTAMINATION,
    "op4_answer_preferences": ANSWER_PREFERENCES,
    "op4_preference_formatting": PREFERENCES,
    "op5_url_rules": URL_RULES,
    "op6_sharding": SHARD_DIGEST,
    "op8_jaccard_join": JACCARD,
    "op8_jaccard_links": JACCARD_LINKS,
    "op9_base_rules": BASE_RULES,
    "op10_secret_scan": SECRETS,
    "op12_merkle_manifest": MERKLE,
    "op13_warc": WARC,
}
