"""SQL of the queries that SQL can express, written from the contracts and without the operators' code."""

from __future__ import annotations

from quillmark.llm.pii import IBAN_LENGTHS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text,''),'{_UPPER}','{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents), b AS (SELECT row_number() OVER () AS b, coalesce(item_id::varchar,'') AS item, {_WORDS} AS w FROM benchmark),
 bi AS (SELECT b, item, w, least(10,len(w)) AS l, unnest(range(1, len(w)-least(10,len(w))+2)) AS j FROM b WHERE len(w)>0), win AS (SELECT b, item, l, j, array_to_string(w[j:j+l-1],' ') AS k FROM bi),
 dl AS (SELECT r, w, l, unnest(range(1, len(w)-l+2)) AS i FROM d, (SELECT DISTINCT l FROM win) WHERE len(w)>=l), dk AS (SELECT r, l, i, array_to_string(w[i:i+l-1],' ') AS k FROM dl),
 m AS (SELECT r, b, item, dk.l, i, j FROM dk JOIN win ON dk.l=win.l AND dk.k=win.k), h AS (SELECT DISTINCT r, unnest(range(i, i+l)) AS p FROM m), s AS (SELECT r, count(*) AS n_hit FROM h GROUP BY r),
 g AS (SELECT *, i-row_number() OVER (PARTITION BY r, b, l, i-j ORDER BY i) AS island FROM m), x AS (SELECT r, item, min(i)-1 AS s, min(j)-1 AS t, count(*)+l-1 AS n FROM g GROUP BY r, b, item, l, i-j, island),
 y AS (SELECT r, max(n) AS longest, string_agg(s||':'||item||':'||t||':'||n, ',' ORDER BY s, item, t, n) AS matches FROM (SELECT DISTINCT * FROM x) GROUP BY r),
 t AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY 1)
 SELECT doc_id::bigint AS doc_id, len(w)::bigint AS n_words, coalesce(n_hit,0) AS n_hit, coalesce(n_items,0) AS n_items, sha256(coalesce(items,'')) AS items_sha256, coalesce(n_hit,0)>0 AS contaminated, coalesce(longest,0)::bigint AS longest, coalesce(matches,'') AS matches
 FROM d LEFT JOIN s USING (r) LEFT JOIN t USING (r) LEFT JOIN y USING (r)"""


def _found(kind: str, rank: int, pattern: str, keep: str = "true", before: str = "", score: str = "1.0") -> str:
    """Rows (r, s, e, rank, kind, m) of the matches of a pattern; ``before`` is the pattern of one guarding character, which isn't part of a match."""
    whole = f"(?:^|{before})(?:{pattern})" if before else pattern
    quoted = whole.replace("'", "''")
    lead = f"(CASE WHEN regexp_matches(m0[1:1], '^{before}') THEN 1 ELSE 0 END)" if before else "0"
    return f"""SELECT * FROM (SELECT r, text, m0[1+{lead}:] AS m, s0+{lead} AS s, s0+length(m0) AS e, {rank} AS rank, '{kind}' AS kind FROM (
 SELECT r, text, ms[i] AS m0, (list_sum([length(x) FOR x IN ps[1:i]])+coalesce(list_sum([length(x) FOR x IN ms[1:i-1]]),0))::bigint AS s0 FROM (
 SELECT r, text, ms, ps, unnest(range(1,len(ms)+1)) AS i FROM (SELECT r, text, regexp_extract_all(text,'{quoted}') AS ms, string_split_regex(text,'{quoted}') AS ps FROM d WHERE regexp_matches(text,'{quoted}'))))) WHERE {keep}"""


_DOCS = "d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text,'') AS text FROM documents)"


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either("api") + "_?" + _either("key")
_VALUE = f"""(?:{_NAMES})["']?\\x20*[:=]\\x20*["']?""".replace("'", "''")
_SECRETS = " UNION ALL ".join(
    [
        _found("assign", 0, f"""(?:{_NAMES})["']?\\x20*[:=]\\x20*["']?[A-Za-z0-9+/_.=-]+""", f"length(regexp_extract(m,'^{_VALUE}([A-Za-z0-9+/_.=-]+)$',1))>=12"),
        _found("access", 1, "AKIA[A-Z0-9]+", "length(m)>=18"),
        _found("hex", 2, "[0-9a-f]{16,}"),
        _found("private_key", 3, "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
        _found("service_token", 4, "gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}", before="[^A-Za-z0-9]"),
        _found("web_token", 5, "eyJ[A-Za-z0-9_-]{10,}\\.eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}", before="[^A-Za-z0-9_-]"),
    ]
)
_LIST = "string_agg(kind||':'||s||':'||e, ',' ORDER BY s, rank)"

SECRETS = f"""WITH {_DOCS}, f AS ({_SECRETS}), g AS (SELECT r, count(*) FILTER (rank=0) AS n_assign, count(*) FILTER (rank=1) AS n_access, count(*) FILTER (rank=2) AS n_hex, {_LIST} FILTER (rank<3) AS base, {_LIST} AS spans FROM f GROUP BY r)
 SELECT doc_id::bigint AS doc_id, coalesce(n_assign,0) AS n_assign, coalesce(n_access,0) AS n_access, coalesce(n_hex,0) AS n_hex, sha256(coalesce(base,'')) AS base_sha256, coalesce(spans,'') AS spans, sha256(text) AS blob FROM d LEFT JOIN g USING (r)"""

_DIGITS = "regexp_replace(m,'[^0-9]','','g')"
_LUHN = f"list_sum([CASE WHEN i%2=0 THEN (reverse({_DIGITS})[i]::int*2)//10+(reverse({_DIGITS})[i]::int*2)%10 ELSE reverse({_DIGITS})[i]::int END FOR i IN range(1,length({_DIGITS})+1)])%10=0"
_IBAN = "replace(m,' ','')"
_TURNED = f"({_IBAN}[5:]||{_IBAN}[:4])"
_MOD97 = f"list_reduce([0::bigint]||[instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ',{_TURNED}[i])-1 FOR i IN range(1,length({_TURNED})+1)], lambda a, v: (a*(CASE WHEN v>9 THEN 100 ELSE 10 END)+v)%97)=1"
_CONTEXT = {"email": (0.9, "mail|contact|write"), "ip": (0.6, "host|server|address|ip"), "card": (0.8, "card|visa|credit|pay|karte|carte|tarjeta"), "phone": (0.6, "phone|tel|call|mobile|fax"), "iban": (0.8, "iban|bank|account|konto|compte|cuenta"), "ssn": (0.3, "ssn|social|security|insurance|tax")}
_SCORE = "least(1.0::double, CASE kind " + " ".join(f"WHEN '{k}' THEN {s}::double+CASE WHEN regexp_matches(near,'{w}') THEN 0.3::double ELSE 0.0::double END" for k, (s, w) in _CONTEXT.items()) + " END)"
_PII = " UNION ALL ".join(
    [
        _found("email", 0, "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+"),
        _found("ip", 1, "[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+", "list_bool_and([ltrim(x,'0')='' OR (length(ltrim(x,'0'))<=3 AND try_cast(ltrim(x,'0') AS int)<=255) FOR x IN string_split(m,'.')])"),
        _found("card", 2, "[0-9](?:[\\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}"),
        _found("phone", 3, "\\+[0-9][\\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15"),
        _found("iban", 4, "(?:" + "|".join(f"{c}[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for c, n in IBAN_LENGTHS.items()) + ")\\b", _MOD97, before="[^A-Za-z0-9]"),
        _found("ssn", 5, "[0-9]{3}-[0-9]{2}-[0-9]{4}\\b", "NOT regexp_matches(text[e+1:e+1],'[0-9-]')", before="[^0-9-]"),
    ]
)

PII = f"""WITH {_DOCS}, f AS ({_PII}), c AS (SELECT *, lower(text[greatest(s-40,0)+1:s]) AS near FROM f), z AS (SELECT *, {_SCORE} AS score FROM c), k AS (SELECT * FROM z WHERE rank<4 OR score>=0.5),
 g AS (SELECT r, count(*) FILTER (rank=0) AS n_email, count(*) FILTER (rank=1) AS n_ip, count(*) FILTER (rank=2) AS n_card, count(*) FILTER (rank=3) AS n_phone, {_LIST} FILTER (rank<4) AS base, {_LIST} AS spans, count(*) AS n_found, max(score) AS top_score FROM k GROUP BY r)
 SELECT doc_id::bigint AS doc_id, coalesce(n_email,0) AS n_email, coalesce(n_ip,0) AS n_ip, coalesce(n_card,0) AS n_card, coalesce(n_phone,0) AS n_phone, sha256(coalesce(base,'')) AS base_sha256, coalesce(spans,'') AS spans, coalesce(n_found,0) AS n_found, coalesce(top_score,0.0::double) AS top_score FROM d LEFT JOIN g USING (r)"""



def _clusters_sql(clusters: int = 40, rounds: int = 5) -> str:
    """A query for each round: distances to all centroids, the nearest, the floors of means."""
    square = "list_sum([(p[1]-p[2])*(p[1]-p[2]) FOR p IN list_zip(k.q, c.q)])"
    near = lambda i: f"a{i} AS MATERIALIZED (SELECT r, min(struct_pack(d := d, c := c)) AS m FROM (SELECT k.r, c.c, {square} AS d FROM k, c{i} c) GROUP BY r)"
    mean = lambda i: f"""c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(n.q, c.q) AS q FROM c{i} c LEFT JOIN (SELECT c, list(m ORDER BY i) AS q FROM (SELECT c, i, floor(sum(x)/count(*))::bigint AS m
 FROM (SELECT a.m.c AS c, unnest(k.q) AS x, unnest(range(64)) AS i FROM k JOIN a{i} a USING (r)) GROUP BY 1,2) GROUP BY c) n USING (c))"""  # noqa: E731
    steps = ", ".join(f"{near(i)}, {mean(i)}" for i in range(rounds))
    return f"""WITH k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [floor(256*x::double)::bigint FOR x IN embedding] AS q, sha256('2:'||coalesce(vec_id::varchar,'')) AS h FROM embeddings WHERE len(embedding)=64 AND len(list_filter(embedding, lambda x: isfinite(x)))=64),
 c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, q)-1 AS c, q FROM k ORDER BY h, q LIMIT {clusters}), {steps}, {near(rounds)}
 SELECT vec_id, c.c::int AS cluster, a.m.d::bigint AS distance, (sum(a.m.d) OVER (PARTITION BY c.c))::bigint AS cluster_inertia, (sum(a.m.d) OVER ())::bigint AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
 FROM k JOIN a{rounds} a USING (r) JOIN c{rounds} c ON c.c=a.m.c"""


FILTERS = r"""WITH d AS (SELECT doc_id, coalesce(text,'') AS text, coalesce(source,'') AS part FROM documents), w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS one FROM d),
 l AS (SELECT doc_id, coalesce(bool_or(quality=1),false) AS g, coalesce(bool_or(toxic=1),false) AS t FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
 c AS (SELECT part, [len(ws)<50, 100*len(list_distinct(ws))<65*len(ws), 100*length(regexp_replace(text,'[^A-Z]','','g'))>5*length(text), regexp_matches(text,'[#$%&*|]'), coalesce(doc_id>one,false)] AS f, count(*) AS n, count(*) FILTER (g) AS g, count(*) FILTER (t) AS t FROM w LEFT JOIN l USING (doc_id) GROUP BY 1,2),
 o AS (SELECT [i,j,k,m,15-i-j-k-m] AS s FROM range(1,6) a(i), range(1,6) b(j), range(1,6) x(k), range(1,6) y(m) WHERE len(list_distinct([i,j,k,m,15-i-j-k-m]))=5 AND 15-i-j-k-m BETWEEN 1 AND 5), p AS (SELECT s, unnest(range(1,6)) AS step FROM o),
 v AS (SELECT part, s, step, s[step] AS own, n, g, t, f[s[step]] AS fails, coalesce(list_bool_or([f[x] FOR x IN s[1:step-1]]),false) AS gone, len(list_filter(f, lambda x: x)) AS many FROM c, p),
 r AS (SELECT part, s, step, own, coalesce(sum(n) FILTER (NOT fails AND NOT gone),0)::bigint AS kept, coalesce(sum(n) FILTER (fails AND NOT gone),0)::bigint AS removed, coalesce(sum(n) FILTER (fails AND gone),0)::bigint AS redundant,
 coalesce(sum(n) FILTER (fails AND many=1),0)::bigint AS unique_fails, coalesce(sum(g) FILTER (fails AND NOT gone),0)::bigint AS good_lost, coalesce(sum(t) FILTER (fails AND NOT gone),0)::bigint AS toxic_lost FROM v GROUP BY ALL)
 SELECT part, array_to_string(['ABCDE'[x] FOR x IN s],'') AS filter_order, step::int AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::bigint AS shapley FROM r"""

SQL = {"op2_pii": PII, "op6_decontamination": DECONTAMINATION, "op9_secrets": SECRETS, "op12_centroids": _clusters_sql(), "op13_filter_audit": FILTERS}
