"""SQL of the chat, trie, spelling and secret queries."""

from __future__ import annotations

from .chat_format import ALIASES, FINAL, INSERT, MOVES, PATHS, ROLES, START

#: CRC-32 of a string, by a table of 256 values.
_TABLE = """crc0(k, v, s) AS (SELECT k, k, 0 FROM range(256) x(k) UNION ALL SELECT k, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, s + 1 FROM crc0 WHERE s < 8),
crct AS (SELECT list(v ORDER BY k) AS crcl FROM crc0 WHERE s = 8)"""


def _crc(of: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({of})), '..'), lambda b: ('0x' || b)::BIGINT)), lambda a, b: xor(a >> 8, crcl[(xor(a, b) & 255) + 1])), 4294967295)"


TRIE = f"""
WITH RECURSIVE {_TABLE},
t AS (SELECT conv_id, turn, strlen(coalesce(text, ''))::BIGINT AS z, md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || ':' || coalesce(text, '')) AS h FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(h ORDER BY turn NULLS FIRST, h) AS l, list(z ORDER BY turn NULLS FIRST, h) AS z FROM t GROUP BY conv_id),
c AS (SELECT conv_id, l, z, ({_crc("conv_id::VARCHAR")} % 9)::BIGINT AS h FROM o, crct),
b AS (SELECT c.conv_id, list_concat(coalesce(d.l[1:h], []), c.l[h + 1:]) AS l, list_concat(coalesce(d.z[1:h], []), c.z[h + 1:]) AS z FROM c LEFT JOIN o d ON d.conv_id = c.conv_id - c.conv_id % 5),
m AS (SELECT conv_id, i::BIGINT AS depth, md5(array_to_string(l[1:i], ',')) AS k, md5(array_to_string(l[1:i - 1], ',')) AS p, CASE WHEN i > 0 THEN z[i] ELSE 0 END AS z, len(l) = i AS e FROM b, unnest(range(len(l) + 1)) AS u(i)),
n AS (SELECT k, depth, any_value(p) AS p, min(conv_id) AS conv_id, count(*) AS n, any_value(z) AS z, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (e), '')) AS ends_sha256 FROM m GROUP BY k, depth),
q AS (SELECT p, count(*) AS n FROM n WHERE depth > 0 GROUP BY p),
v AS (SELECT n.*, coalesce(q.n, 0)::BIGINT AS n_children FROM n LEFT JOIN q ON q.p = n.k),
s AS (SELECT m.k, m.depth, count(*) FILTER (n_children = 0)::BIGINT AS n_leaves, sum((n - 1) * v.z)::BIGINT AS saved_tokens FROM v JOIN m ON m.conv_id = v.conv_id AND m.depth <= v.depth GROUP BY m.k, m.depth)
SELECT v.conv_id, v.depth, a.conv_id AS parent_conv_id, v.n AS n_convs, v.n_children, n_leaves, saved_tokens, v.ends_sha256
FROM v JOIN s ON s.k = v.k AND s.depth = v.depth LEFT JOIN n a ON a.k = v.p AND a.depth = v.depth - 1"""

SPELLING = rf"""
WITH RECURSIVE {_TABLE},
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents),
g AS (SELECT doc_id, w, count(*) AS n FROM r GROUP BY doc_id, w),
h AS (SELECT w, n, {_crc("coalesce(doc_id::VARCHAR, 'null') || ':' || w")} AS h FROM g, crct),
e AS (SELECT CASE WHEN h % 97 = 0 THEN substring(w, 1, h % length(w)) || substring(w, h % length(w) + 2) ELSE w END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM e WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
d AS (SELECT word, n, p, substring(word, 1, p) || substring(word, p + 2) AS short FROM v, unnest(range(length(word))) AS u(p)),
x AS (SELECT a.word, b.word AS other, b.n FROM d a JOIN d b ON a.short = b.short AND a.p = b.p AND a.word <> b.word
      UNION SELECT a.word, b.word, b.n FROM d a JOIN v b ON b.word = a.short UNION SELECT b.word, a.word, a.n FROM d a JOIN v b ON b.word = a.short),
y AS (SELECT word, count(*) AS n_near, max(n) AS top, min({{'minus': -n, 'word': other}}) AS best FROM x GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top >= 2 * v.n THEN top END AS form_n, CASE WHEN top >= 2 * v.n THEN best.word END AS form FROM v LEFT JOIN y USING (word)),
z(word, root, k) AS (SELECT word, word, 0 FROM f UNION ALL SELECT z.word, f.form, k + 1 FROM z JOIN f ON f.word = z.root WHERE f.form IS NOT NULL)
SELECT f.*, root FROM f JOIN (SELECT word, arg_max(root, k) AS root FROM z GROUP BY word) USING (word)"""

_ASSIGN = r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)"
#: Kinds in order: the pattern, and a condition on a match m.
_KINDS = {
    "assign": (_ASSIGN, f"length(regexp_extract(m, '{_ASSIGN}', 2)) >= 8"),
    "access": ("AKIA[A-Z0-9]+", "length(m) >= 16"),
    "hex": ("[0-9a-f]+", "length(m) >= 32"),
    "pem": ("-----BEGIN [A-Z ]*PRIVATE KEY-----", "true"),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "true"),
    "github": ("gh[pousr]_[A-Za-z0-9]{36,}", "true"),
    "slack": ("xox[abprs]-[A-Za-z0-9-]{10,}", "true"),
}
#: Where the matches of a pattern stand: what lies before the i-th match, and the matches before it.
_FOUND = "".join(
    f""",
l{i} AS (SELECT r, list_transform(regexp_extract_all(t, '{p}'), lambda m: {{'m': m, 'z': length(m)}}) AS m, list_transform(regexp_split_to_array(t, '{p}'), lambda g: length(g)) AS g FROM d),
u{i} AS (SELECT r, unnest(m) AS m, unnest(g[1:len(m)]) AS g, unnest(range(len(m))) AS i FROM l{i} WHERE len(m) > 0),
s{i} AS (SELECT r, {i} AS k, '{kind}' AS kind, m.m AS m, (sum(g + m.z) OVER (PARTITION BY r ORDER BY i))::BIGINT AS b, m.z AS z FROM u{i}),
o{i} AS (SELECT r, k, kind, b - z AS a, b FROM s{i} WHERE {ok})"""
    for i, (kind, (p, ok)) in enumerate(_KINDS.items())
)
SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents){_FOUND},
s AS ({" UNION ALL ".join(f"SELECT * FROM o{i}" for i in range(len(_KINDS)))}),
f AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) FILTER (k < 3) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS spans FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN f USING (r)"""

# The automaton's moves as rows: from a state with a turn's role at a cost to the next state, with empty turns before.
_EMPTY = [f"<|im_start|>{r}\n<|im_end|>\n" for r in ROLES]
_text = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
_MOVES = ", ".join(f"({s}, {r}, {k}, {c}, {t}, {len(p)}, {a}, {_text(''.join(_EMPTY[i] for i in p))}, '{ROLES[t]}')" for (s, r), ms in MOVES.items() for k, (c, t, p, a) in enumerate(ms))
_TAILS = ", ".join(f"({s}, {INSERT * len(p)}, {len(p)}, {k}, {_text(''.join(_EMPTY[i] for i in p))})" for s in PATHS for k, p in enumerate(sorted(p for p, t in PATHS[s] if t in FINAL)) if s != START)
_ROLE = "CASE regexp_replace(lower(coalesce(role, '')), '^\\s+|\\s+$', '', 'g') " + " ".join(f"WHEN '{w}' THEN {ROLES.index(r)}" for w, r in [*ALIASES.items(), *zip(ROLES, ROLES, strict=True)]) + " ELSE -1 END"
CHATS = f"""
WITH RECURSIVE move(state, role, ord, cost, next, empty, action, before, name) AS (VALUES {_MOVES}), tail(state, cost, empty, ord, after) AS (VALUES {_TAILS}),
t AS (SELECT coalesce(conv_id::VARCHAR, 'null') AS k, conv_id, {_ROLE} AS role, replace(coalesce(text, ''), '<|', '< |') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, text NULLS LAST) AS i FROM conversations),
g AS (SELECT k, any_value(conv_id) AS conv_id, count(*) AS n_turns, string_agg(CASE role WHEN 0 THEN 's' WHEN 1 THEN 'u' WHEN 2 THEN 'a' ELSE '?' END, '' ORDER BY i) AS roles FROM t GROUP BY k),
p(k, i, state, cost, merged, relabeled, empty, rendered) AS (SELECT k, 0::BIGINT, {START}, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, '' FROM g UNION ALL
  SELECT p.k, t.i, m.next, p.cost + m.cost, merged + (action = 1)::BIGINT, relabeled + (action = 2)::BIGINT, p.empty + m.empty,
         p.rendered || CASE WHEN action = 1 THEN chr(10) ELSE CASE WHEN p.i > 0 THEN '<|im_end|>' || chr(10) ELSE '' END || before || '<|im_start|>' || name || chr(10) END || t.text
  FROM p JOIN t ON t.k = p.k AND t.i = p.i + 1 JOIN move m ON m.state = p.state AND m.role = t.role
  QUALIFY row_number() OVER (PARTITION BY p.k, m.next ORDER BY p.cost + m.cost, p.state, m.ord) = 1),
e AS (SELECT p.*, g.conv_id, n_turns, roles, p.cost + tail.cost AS total, tail.empty AS more, tail.after FROM p JOIN g ON g.k = p.k AND g.n_turns = p.i JOIN tail ON tail.state = p.state
      QUALIFY row_number() OVER (PARTITION BY p.k ORDER BY p.cost + tail.cost, tail.empty, p.state, tail.ord) = 1)
SELECT conv_id, n_turns, (n_turns - merged + empty + more)::BIGINT AS n_out, total::BIGINT AS cost, merged AS n_merged, relabeled AS n_relabeled, (empty + more)::BIGINT AS n_inserted, roles, sha256(rendered || '<|im_end|>' || chr(10) || after) AS rendered_sha256 FROM e"""

SQL = {"op7_chat_format": CHATS, "op11_conversation_trie": TRIE, "op12_spelling_variants": SPELLING, "op13_secret_scan": SECRETS}
