"""DuckDB twins of the operators that SQL can express, over whole tables and whole texts."""

from __future__ import annotations

import re

from gradloom.llm import chat_format, rule_ledger, secret_scan, url_reputation


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _either_case(pattern: str) -> str:
    """``(?i)`` for ASCII letters alone, as Java has it: each letter outside of classes in both cases."""
    if not pattern.startswith("(?i)"):
        return pattern
    return "".join(part if part.startswith("[") or part.startswith("\\x") else re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", part) for part in re.split(r"(\[[^\]]*\]|\\x[0-9a-fA-F]{2})", pattern[4:]))


#: A key block without look-ahead, for closed ones and whole base64 lines of unclosed ones.
_GAP = r"(?:\s|\\[rn])+"
_PEM = rf"{secret_scan._BEGIN}(?:(?:-{{0,4}}[^-])*{secret_scan._END}|(?:(?:{_GAP}(?:Proc-Type|DEK-Info):\s*[^\s\\]+)*(?:{_GAP}[A-Za-z0-9+/=]{{16,}})+)?)"


def secrets_sql(widely: int = secret_scan.WIDELY, copies: int = secret_scan.COPIES) -> str:
    found = []
    for rank, (kind, rx, group, least, _) in enumerate([*secret_scan.BASE, *secret_scan.EXTRA]):
        rx = q(_PEM if kind == "pem" else _either_case(rx))
        total = "coalesce(list_sum(list_transform({0}, lambda x: length(x))), 0)"
        value = f"regexp_extract(m, {rx}, {group})" if group else "m"
        if kind == "pem":
            value = f"regexp_replace(regexp_replace(m, {q('^' + secret_scan._BEGIN)}, ''), {q(secret_scan._END + '$')}, '')"
        found.append(
            f"SELECT * FROM (SELECT doc_id, source, {rank} AS rank, {q(kind)} AS kind, m, CAST(s AS BIGINT) AS s, CAST(s + length(m) AS BIGINT) AS e, {value} AS value FROM (SELECT doc_id, source, ms[i] AS m, {total.format('gs[1:i]')} + {total.format('ms[1:i - 1]')} AS s "
            f"FROM (SELECT doc_id, source, regexp_extract_all(t, {rx}) AS ms, string_split_regex(t, {rx}) AS gs FROM d), UNNEST(range(1, len(ms) + 1)) AS u(i))) WHERE length(value) >= {least}"
        )
    span = "kind || ':' || CAST(s AS VARCHAR) || ':' || CAST(e AS VARCHAR)"
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents), found AS ({" UNION ALL ".join(found)}),
per_doc AS (SELECT doc_id, count(CASE WHEN kind = 'assign' THEN 1 END) AS n_assign, count(CASE WHEN kind = 'access' THEN 1 END) AS n_access, count(CASE WHEN kind = 'hex' THEN 1 END) AS n_hex,
    coalesce(string_agg(CASE WHEN rank < {len(secret_scan.BASE)} THEN {span} END, ',' ORDER BY s, rank), '') AS base, string_agg({span}, ',' ORDER BY s, rank) AS spans FROM found GROUP BY doc_id),
cands AS (SELECT DISTINCT doc_id, coalesce(source, chr(1)) AS owner, value, len(list_distinct(regexp_extract_all(value, '(?s).'))) >= 8 AND NOT regexp_matches(value, '(?i)example|changeme|placeholder|dummy|sample|your[_-]') AS random FROM found),
owned AS (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT owner || chr(2) || coalesce(CAST(doc_id AS VARCHAR), '')) AS repos, CASE WHEN count(DISTINCT owner) >= {widely} OR count(DISTINCT owner) >= 2 AND count(DISTINCT owner || chr(2) || coalesce(CAST(doc_id AS VARCHAR), '')) >= {copies} THEN 'example' WHEN count(DISTINCT owner) = 1 AND bool_or(random) THEN 'live' ELSE 'weak' END AS class FROM cands GROUP BY value),
classes AS (SELECT doc_id, count(CASE WHEN class = 'live' THEN 1 END) AS n_live, count(CASE WHEN class = 'example' THEN 1 END) AS n_example, count(CASE WHEN class = 'weak' THEN 1 END) AS n_weak, max(owners) AS most_owners, max(repos) AS most_repos FROM cands JOIN owned USING (value) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
    coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(n_weak, 0) AS n_weak, coalesce(most_owners, 0) AS most_owners, coalesce(most_repos, 0) AS most_repos
FROM d LEFT JOIN per_doc p ON d.doc_id = p.doc_id LEFT JOIN classes c ON d.doc_id = c.doc_id
"""


def _strength(children: str, parent: str, low: float = 1.0, high: float = 1000.0) -> str:
    """One row ``s``: the prior's strength of a level by analysis of variance."""
    return f"""(SELECT CASE WHEN coalesce(n, 0) = 0 THEN {high} WHEN c - p <= 0 OR n - c <= 0 THEN CASE WHEN p > 0 THEN {low} ELSE {high} END WHEN rho <= 0 OR rho IS NULL THEN {high} ELSE least({high}, greatest({low}, 1 / rho - 1)) END::DOUBLE AS s
    FROM (SELECT n, c, p, (b - w) / nullif(b + (greatest((n - sq) / nullif(c - p, 0), 1e-9) - 1) * w, 0) AS rho FROM (
    SELECT sum(n)::DOUBLE AS n, count(*) AS c, count(DISTINCT pid) AS p, sum(n * (k / n - pk / pn) * (k / n - pk / pn)) / nullif(count(*) - count(DISTINCT pid), 0) AS b, sum(n * (k / n) * (1 - k / n)) / nullif(sum(n) - count(*), 0) AS w, sum(n * n / pn) AS sq
    FROM (SELECT n::DOUBLE AS n, k::DOUBLE AS k, {parent} AS pid, sum(n::DOUBLE) OVER (PARTITION BY {parent}) AS pn, sum(k::DOUBLE) OVER (PARTITION BY {parent}) AS pk FROM {children} WHERE n > 0))))"""


def reputation_sql(z: float = 1.64, block_above: float = 0.5) -> str:
    rx = q(r"(?s)^.*?://([^/?#]*)([^?#]*)")
    ordered = sorted(url_reputation.RULES, key=lambda r: (-len(r[0]), r[0]))
    case = lambda pick: "CASE " + " ".join(f"WHEN (host = {q(r.partition('/')[0])} OR ends_with(host, {q('.' + r.partition('/')[0])})) AND starts_with(path, {q('/' + r.partition('/')[2])}) THEN {q(pick(r, v))}" for r, v in ordered) + " END"
    many = "(" + ", ".join(map(q, url_reputation.SUFFIXES)) + ")"
    part = lambda i: f"array_to_string(string_split(name, '.')[-{i}:], '.')"
    number = r"regexp_matches(name, '^[0-9.]+$|^\[')"
    return rf"""
WITH pages_split AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), {rx}, 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), {rx}, 2) AS path FROM pages),
bad AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY 1),
per_host AS (SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name, count(bad) AS n, coalesce(sum(bad), 0) AS k FROM pages_split LEFT JOIN bad ON page_id = doc_id GROUP BY 1),
hosts AS (SELECT host, n, k, CASE WHEN {number} THEN name WHEN {part(2)} IN {many} THEN {part(3)} ELSE {part(2)} END AS domain, CASE WHEN {number} THEN name WHEN {part(2)} IN {many} THEN {part(2)} ELSE {part(1)} END AS suffix FROM per_host),
domains AS (SELECT domain, suffix, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k FROM hosts GROUP BY 1, 2), suffixes AS (SELECT suffix, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k, '' AS root FROM domains GROUP BY 1),
total AS (SELECT coalesce(sum(n), 0)::DOUBLE AS n, CASE WHEN coalesce(sum(n), 0) = 0 THEN 0.0 ELSE (sum(k) + 0.5) / (sum(n) + 1.0) END::DOUBLE AS mean FROM suffixes),
st AS (SELECT x.s AS s_suffix, y.s AS s_domain, w.s AS s_host FROM {_strength('suffixes', 'root')} x, {_strength('domains', 'suffix')} y, {_strength('hosts', 'domain')} w),
up AS (SELECT suffix, s.n AS sn, s.k AS sk, 1 / (1 / s_suffix + 1 / (total.n - s.n + 1.0)) AS s_eff FROM suffixes s, total, st),
dom AS (SELECT d.domain, d.n AS dn, d.k AS dk, (sk - d.k + s_eff * mean) / (sn - d.n + s_eff) AS m_suffix, 1 / (1 / s_domain + 1 / (sn - d.n + s_eff)) AS d_eff FROM domains d JOIN up USING (suffix), total, st),
h1 AS (SELECT host, h.n, h.k, dn - h.n + d_eff AS known, (dk - h.k + d_eff * m_suffix) / (dn - h.n + d_eff) AS m_domain, s_host FROM hosts h JOIN dom USING (domain), st),
h2 AS (SELECT host, n, k, (k + m_domain / (1 / s_host + 1 / known)) / (n + 1 / (1 / s_host + 1 / known)) AS rate, n + 1 / (1 / s_host + 1 / known) AS ab FROM h1),
judged AS (SELECT host, n, k, CASE WHEN greatest(0.0, rate - {z} * sqrt(rate * (1 - rate) / (ab + 1))) > {block_above} THEN 'block' ELSE 'allow' END AS by_host FROM h2)
SELECT page_id, s.host, path, {case(lambda r, v: r)} AS rule, coalesce({case(lambda r, v: v)}, by_host, 'allow') AS verdict, CAST(coalesce(n, 0) AS BIGINT) AS host_labelled, CAST(coalesce(k, 0) AS BIGINT) AS host_bad
FROM (SELECT page_id, host, path FROM pages_split) s LEFT JOIN (SELECT host AS hh, n, k, by_host FROM judged) j ON s.host = j.hh
"""


def mix_sql(seed: int = 7, most: int = 3) -> str:
    """Where a document has one source, the flow takes from each source its target. The capped sources
    are those with the least size for their weight: ``k`` is the smallest number of them that fits."""
    return rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, sum(size) AS n, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY {most} * n / w, source) AS i, sum({most} * n) OVER (ORDER BY {most} * n / w, source) AS capped, sum(n) OVER () AS total, sum(w) OVER (ORDER BY {most} * n / w DESC, source DESC) AS open_w FROM s),
l AS (SELECT *, (total - (capped - {most} * n))::DOUBLE AS left_over FROM o),
k AS (SELECT coalesce(min(i), 1000000000) AS first_open FROM l WHERE left_over * w / open_w <= {most} * n),
f AS (SELECT left_over, open_w FROM l WHERE i = (SELECT first_open FROM k)),
t AS (SELECT source, n, CASE WHEN i < (SELECT first_open FROM k) THEN {most} * n::DOUBLE ELSE (SELECT left_over FROM f) * w / (SELECT open_w FROM f) END::DOUBLE AS target FROM l),
c AS (SELECT d.*, t.n, t.target, CAST(round(t.target) AS BIGINT) AS quota, sum(size) OVER (PARTITION BY d.source ORDER BY h ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(n AS BIGINT) AS source_size, target, CAST(size * CASE WHEN n = 0 THEN 0 ELSE quota // n + CASE WHEN quota % n > 0 AND upto - size / 2 <= quota % n THEN 1 ELSE 0 END END AS BIGINT) AS taken FROM c
"""


_SCORE = "CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT)"
#: Every product of an anchor with every row, which is for the sizes that the oracle runs at.
HARD_NEGATIVES = f"""
WITH d AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, {_SCORE} AS score FROM d a JOIN d b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS r
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE r <= 10"""


def chat_sql(t: chat_format.Template = chat_format.INSTRUCT) -> str:
    """Of each turn what stands before and after, and the escaped text's length: one more for a backslash or a control string."""
    control = "(" + "|".join(re.sub(r"([\[\]\\/])", r"\\\1", c) for c in ("\\", *t.control)) + ")"

    def escaped(x: str) -> str:
        return f"length({x}) + len(regexp_extract_all({x}, {q(control)}))"

    marks = "CASE role " + " ".join(f"WHEN {q(r)} THEN {len(b) + len(a)}" for r, (b, a, _) in t.roles.items()) + f" ELSE {sum(map(len, t.other))} + " + escaped("role") + " END"
    learnt = ", ".join(q(r) for r, (_, _, loss) in t.roles.items() if loss)
    said = "'</s>[INST] ok [/INST]'"
    order = "ORDER BY turn NULLS FIRST, role, md5(text)"
    # a state is known by the role that leads to it, so up to the first error the turn before says what may follow
    entered = {after: role for moves in t.moves.values() for role, after in moves.items()}
    allowed = " OR ".join(f"(before {'= ' + q(entered[state]) if state in entered else 'IS NULL'} AND role = {q(role)})" for state, moves in t.moves.items() for role in moves)
    ends = ", ".join(q(entered[s]) for s in t.ends)
    error = f"coalesce(min(i) FILTER (NOT ({allowed})), CASE WHEN arg_max(role, i) IN ({ends}) THEN NULL ELSE count(*) END)"
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-1, 0, 'user', {said}), (-1, 1, 'assistant', {said})),
o AS (SELECT *, row_number() OVER w - 1 AS i, lag(role) OVER w AS before FROM c WINDOW w AS (PARTITION BY conv_id {order}))
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role IN ({learnt})), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' {order}) FILTER (role IN ({learnt})), '')) AS loss_sha256,
  CAST(sum({marks} + {escaped("text")}) AS BIGINT) AS formatted_chars, {error} IS NULL AS valid, CAST({error} AS BIGINT) AS first_error
FROM o GROUP BY conv_id"""


ORACLE_SQL = {"op2_url_reputation": reputation_sql(), "op6_secret_ownership": secrets_sql(), "op7_flow_mix": mix_sql(), "op10_rule_ledger": rule_ledger.SQL, "op11_bit_sliced": HARD_NEGATIVES, "op12_chat_format": chat_sql()}
