"""DuckDB SQL with the same results as the registered queries, written from the definitions.

Pairs are inequality joins, caching is NOT EXISTS, distances are a recursive table: none of
the bins, running totals or deletion keys of the Spark side appear here.
"""

from __future__ import annotations

import textwrap

from nearname.sources.events import POPULAR, SITES

# Fixed values, kept here apart from the code they test: which keys lie next to which, the
# registry's name servers, and the characters put in for another one.
KEYBOARD = {
    'a': 'qwsxz',
    'b': 'vfghn',
    'c': 'xsdfv',
    'd': 'swerfvcx',
    'e': 'wsdfr432',
    'f': 'edcvbgtr',
    'g': 'rfvbnhyt',
    'h': 'tgbnmjuy',
    'i': '7ujklo98',
    'j': 'uyhnm,ki',
    'k': 'ujm,.loi',
    'l': 'ik,./;po',
    'm': 'hn,kj',
    'n': 'gbmjh',
    'o': '8ikl;p09',
    'p': "9ol;'[-0",
    'q': 'asw21',
    'r': '3edfgt54',
    's': 'qazxcdew',
    't': '4rfghy65',
    'u': '6yhjki87',
    'v': 'dcbgf',
    'w': '1qasde32',
    'x': 'zasdc',
    'y': '5tghju76',
    'z': 'asx',
    '1': 'qw2',
    '2': '1qwe3',
    '3': '2wer4',
    '4': '3ert5',
    '5': '4rty6',
    '6': '5tyu7',
    '7': '6yui8',
    '8': '7uio9',
    '9': '8iop0',
    '0': '9op[-',
    '-': '0p[]=_',
    '=': '-[]+',
    '[': "]=-0p;'{",
    ']': "-=\\';}",
    '\\': "=]'|",
    ';': "op['/.,l:",
    "'": '][p;./"',
    ',': 'mkl.<',
    '.': ",l;'/>",
    '/': "';.?",
    '<': 'mkl.,',
    '>': ',l;/.',
    '?': ".;'/",
    '"': "][;/'",
    ':': "'][pl,./;",
    '{': "-p;']=[",
    '}': "=[;'\\]",
    '|': "]='\\",
    '+': '-[]=',
    '_': '0p[=-',
}
REGISTRY_SERVERS = [f"{letter}.GTLD-SERVERS.NET." for letter in "ABCDEFGHIJKLM"]
LETTERS = "abcdefghijklmnopqrstuvwxyz"
DIGITS = "0123456789"
KMEANS_PASSES = 3
CONVERGED_PASSES = 60  # more than any of the given tables takes; further passes change nothing

_SITES = ", ".join(f"({i}, '{s}.')" for i, s in enumerate(SITES, start=1))
_POPULAR = ", ".join(f"({i}, '{s}.')" for i, s in enumerate(POPULAR, start=1))
_SERVERS = ", ".join(f"'{s}'" for s in REGISTRY_SERVERS)


def _rr(owner: str, ttl: str, rtype: str, rdata: str) -> str:
    return f"{{'owner': {owner}, 'ttl': cast({ttl} as varchar), 'rclass': 'IN', 'rtype': '{rtype}', 'rdata': {rdata}}}"


_OWN = _rr("qname", "v", "A", "'192.0.2.' || (u % 250)")
_ALIAS = _rr("'alias.' || qname", "30", "CNAME", "qname")
_MAIL = _rr("qname", "v", "MX", "'10 mail.' || qname")
_NS1 = _rr("target", "172800", "NS", "'ns1.' || target")
_SOA = _rr("'com.'", "900", "SOA", "'a.gtld-servers.net.;nstld.example.net.;2024'")
_REG = _rr("'com.'", "172800", "NS", "'b.gtld-servers.net.'")
_OTHER = _rr("target", "172800", "NS", "'ns9.parking.example.net.'")
_GLUE = _rr("'ns1.' || target", "300", "A", "'192.0.2.1'")
_LATE = _rr("qname", "v + 1", "A", "'192.0.2.2'")

LOOKUPS = f"""
sites(rank, site) AS (VALUES {_SITES}),
popular(rank, site) AS (VALUES {_POPULAR}),
ev AS (
  SELECT event_id AS e, user_id AS u, event_type AS k, ts AS stamp, cast(floor(value) AS bigint) AS v,
         cast(user_id % 4 + 2 AS integer) AS p, (SELECT site FROM sites WHERE rank = event_id % {len(SITES)} + 1) AS target
  FROM events),
named AS (
  SELECT *, CASE k
    WHEN 'click' THEN target
    WHEN 'error' THEN target[:p-1] || target[p+1:]
    WHEN 'view' THEN target[:p-1] || target[p+1] || target[p] || target[p+2:]
    WHEN 'signup' THEN CASE u % 3 WHEN 0 THEN 'www.' WHEN 1 THEN 'w.' ELSE 'a.www.' END || target
    ELSE CASE WHEN u % 4 = 0 THEN replace(target, '.com.', '.ocm.') ELSE 'cdn' || u || '.example.net.' END END AS qname,
    CASE k WHEN 'click' THEN e % 5 <> 0 WHEN 'signup' THEN e % 2 = 0 WHEN 'purchase' THEN false
      ELSE u % 2 = 0 AND e % 3 = 0 END AS answered
  FROM ev),
lk AS (
  SELECT e AS lookup_id, epoch_us(stamp) // 60000000 AS ts, 0 AS typ,
    CASE WHEN u % 11 = 0 THEN '2001:db8::' || u ELSE '10.' || u % 8 || '.' || u % 250 || '.' || e % 200 END AS src_ip,
    '192.0.2.' || u % 5 AS dst_ip, qname,
    CASE WHEN e % 7 = 0 THEN 28 ELSE 1 END AS qtype, CASE WHEN k = 'purchase' THEN 3 ELSE 0 END AS rcode,
    CASE WHEN answered AND e % 7 = 1 THEN [{_ALIAS}, {_OWN}] WHEN answered THEN [{_OWN}]
      WHEN k = 'view' AND u % 4 = 3 AND e % 6 = 0 THEN [{_MAIL}] ELSE [] END AS answer,
    CASE WHEN answered AND e % 3 = 0 THEN [{_NS1}] WHEN answered THEN []
      WHEN k = 'error' AND u % 4 = 1 AND e % 2 = 0 THEN [{_SOA}]
      WHEN k = 'view' AND u % 4 = 1 THEN [{_REG}, {_OTHER}]
      WHEN e % 3 = 0 THEN [] ELSE [{_OTHER}, {_REG}] END AS authority,
    CASE WHEN k = 'purchase' AND e % 9 = 0 THEN [{_GLUE}, {_LATE}] WHEN e % 6 = 0 THEN [{_GLUE}] ELSE [] END AS additional,
    target
  FROM named)"""


def _suffix(name: str, reference: str, extra: int = 1) -> str:
    n = f"(len({reference}) - len(replace({reference}, '.', '')) + {extra})"
    dots = f"(len({name}) - len(replace({name}, '.', '')))"
    labels = f"string_split(rtrim({name}, '.'), '.')"
    last = f"list_slice({labels}, greatest(len({labels}) - {n} + 1, 1), len({labels}))"
    return f"CASE WHEN {dots} = {n} THEN {name} ELSE array_to_string({last}, '.') || '.' END"


_TTL = """coalesce((SELECT min_by(cast(r.ttl AS bigint), i) FROM (
    SELECT unnest(answer || authority || additional) AS r, generate_subscripts(answer || authority || additional, 1) AS i)
    WHERE r.owner = qname AND r.rtype = 'A'), 0)"""

TAGGED = f"""
log AS (
  SELECT *, {_suffix('qname', 'target')} AS suffix,
    CASE WHEN len(src_ip) - len(replace(src_ip, '.', '')) >= 3
      THEN string_split(src_ip, '.')[1] || '.' || string_split(src_ip, '.')[2] || '.0.0' END AS net16,
    {_TTL} AS a_ttl
  FROM lk),
own AS (SELECT * FROM (SELECT *, {_suffix('qname', 'suffix')} AS s2 FROM log) WHERE s2 = suffix AND suffix <> target),
hidden AS (
  SELECT r.lookup_id FROM log r
  WHERE EXISTS (SELECT 1 FROM log t WHERE t.target = r.target AND t.net16 = r.net16 AND t.suffix = t.target
    AND t.a_ttl <> 0 AND t.ts < r.ts AND r.ts < t.ts + t.a_ttl)),
visible AS (SELECT * FROM log WHERE net16 IS NOT NULL AND lookup_id NOT IN (SELECT lookup_id FROM hidden))"""

_LINE_SECTION = (
    "len({s}) || array_to_string([''] || list_transform({s}, lambda r: '5,' || r.owner || ',' || r.ttl || ',' || "
    "r.rclass || ',' || r.rtype || ',' || r.rdata), ',')"
)
_BODY = " || ',' || ".join(_LINE_SECTION.format(s=s) for s in ("answer", "authority", "additional"))
_HEAD = "ts || ',' || typ || ',' || src_ip || ',' || dst_ip"
CLEAN = f"{_HEAD} || ',' || qname || ',' || qtype || ',' || rcode || ',' || {_BODY}"


def _osa(pairs: str, name: str = "osa", cost: str = "(a[i]<>b[j])::double") -> str:
    """CTEs computing the restricted Damerau-Levenshtein distance of the pairs (a, b), cell by
    cell. ``cost`` is the price of putting b[j] for a[i]."""
    return f"""
{name}_in AS ({pairs}),
{name}_dp(a, b, i, j, p2, p1, r) AS (
  SELECT a, b, 1, 1, [0.0::double FOR x IN range(len(b)+1)], [x::double FOR x IN range(len(b)+1)], [1.0::double] FROM {name}_in
  UNION ALL
  SELECT a, b, CASE WHEN j=len(b) THEN i+1 ELSE i END, CASE WHEN j=len(b) THEN 1 ELSE j+1 END,
    CASE WHEN j=len(b) THEN p1 ELSE p2 END,
    CASE WHEN j=len(b) THEN list_append(r, v) ELSE p1 END,
    CASE WHEN j=len(b) THEN [(i+1)::double] ELSE list_append(r, v) END
  FROM (SELECT *, least(p1[j+1]+1, r[j]+1, p1[j]+{cost},
      CASE WHEN i>1 AND j>1 AND a[i]=b[j-1] AND a[i-1]=b[j] THEN p2[j-1]+{cost} ELSE 1000000 END) AS v
    FROM {name}_dp WHERE i <= len(a))),
{name} AS (SELECT a, b, p1[len(b)+1] AS d FROM {name}_dp WHERE i = len(a)+1)"""


_HOSTS = "hosts AS (SELECT DISTINCT lower(split_part(url, '/', 3)) AS host FROM pages)"
_NEAR = "osa_near AS (SELECT a, b, cast(d AS integer) AS d FROM osa)"

RATIOS = """
unpopular AS (SELECT DISTINCT target, suffix AS typo FROM log WHERE suffix <> target AND lower(suffix) NOT IN (SELECT site FROM popular)),
single AS (SELECT target, suffix AS typo, count(*) AS single_count FROM log WHERE suffix <> target GROUP BY ALL),
joined AS (SELECT a.target, a.suffix AS typo, count(*) AS join_count FROM log a JOIN log b ON a.target = b.target
    AND a.net16 = b.net16 AND b.suffix = b.target AND a.suffix <> a.target AND b.ts - a.ts > 0 AND b.ts - a.ts < 60 GROUP BY ALL),
ratios AS (SELECT typo, target, join_count / single_count::double AS ratio, join_count, single_count
    FROM (SELECT s.*, coalesce(join_count, 0) AS join_count FROM single s JOIN unpopular USING (target, typo) LEFT JOIN joined USING (target, typo))
    WHERE join_count / single_count::double > 0.1)"""

_REGISTRY = f"upper({{x}}) IN ({_SERVERS})"
_BAD_MAIL = f"(r.rtype = 'MX' AND NOT coalesce({_REGISTRY.format(x='regexp_split_to_array(r.rdata, chr(91) || chr(32) || chr(59) || chr(93))[2]')}, false))"
RULES = f"""
first20 AS (SELECT *, row_number() OVER (PARTITION BY target, suffix ORDER BY ts, lookup_id) AS rn FROM log WHERE suffix <> target
  QUALIFY rn <= 20),
auth AS (SELECT target, suffix, rn, i, r FROM (
  SELECT target, suffix, rn, unnest(authority) AS r, generate_subscripts(authority, 1) AS i FROM first20)),
judged AS (
  SELECT target, suffix, rn,
    CASE WHEN len(answer) + len(authority) + len(additional) = 0 THEN 0
      WHEN len(list_filter(answer, lambda r: (r.rtype = 'A' AND r.owner = suffix) OR {_BAD_MAIL})) > 0 THEN 1
      ELSE (SELECT CASE WHEN min_by(r.rtype, i) = 'MX' THEN 1 WHEN min_by(r.rtype, i) = 'SOA' THEN 0 END FROM auth x
        WHERE x.target = f.target AND x.suffix = f.suffix AND x.rn = f.rn
          AND ((r.rtype = 'SOA' AND {_REGISTRY.format(x="regexp_split_to_array(r.rdata, '[ ;]')[1]")}) OR {_BAD_MAIL})) END AS verdict,
    (SELECT CASE WHEN min_by({_REGISTRY.format(x='regexp_split_to_array(r.rdata, chr(91) || chr(32) || chr(59) || chr(93))[1]')}, i) THEN -1 ELSE 1 END FROM auth x
      WHERE x.target = f.target AND x.suffix = f.suffix AND x.rn = f.rn AND r.rtype = 'NS' HAVING count(*) > 0) AS vote
  FROM first20 f),
ruled AS (SELECT target, suffix AS typo,
    coalesce(min_by(verdict, rn) FILTER (verdict IS NOT NULL) = 1, coalesce(sum(vote), 0) >= 0) AS exists
  FROM judged GROUP BY target, suffix)"""

STATS = """
v1 AS (SELECT a.target, a.suffix AS typo, a.lookup_id AS typo_id, a.ts AS typo_ts, b.lookup_id AS target_id, b.ts AS target_ts,
    a.net16, b.ts - a.ts AS delay_s FROM visible a JOIN visible b ON a.target = b.target AND a.net16 = b.net16
    AND b.suffix = b.target AND a.suffix <> a.target AND b.ts - a.ts BETWEEN 0 AND 60),
tstats AS (SELECT v1.typo, v1.target, any_value(single_count) AS single_count, count(*) AS pair_count, avg(delay_s) AS mean_delay,
    any_value(exists) AS exists FROM v1 JOIN (SELECT target, suffix AS typo, count(*) AS single_count, sum(a_ttl) <> 0 AS exists
      FROM own GROUP BY ALL) USING (target, typo) GROUP BY v1.typo, v1.target)"""

V3 = """
v3 AS (SELECT a.suffix AS typo, a.ts AS typo_ts, a.lookup_id AS typo_id, b.target, b.ts AS target_ts, b.lookup_id AS target_id, a.net16, exists
  FROM own a JOIN ratios q ON a.target = q.target AND a.suffix = q.typo JOIN ruled u ON u.target = a.target AND u.typo = a.suffix
  JOIN log b ON b.target = a.target AND b.net16 = a.net16 AND b.suffix = b.target AND b.ts - a.ts > 0 AND b.ts - a.ts <= 60)"""

TRANSITIONS = f"""
{_osa("SELECT DISTINCT suffix AS a, target AS b FROM log")},
near AS (SELECT g.target, coalesce(net16, src_ip) AS src, g.suffix AS name, ts, lookup_id FROM log g
  JOIN osa ON g.suffix = a AND g.target = b WHERE d <= 2),
trans AS (SELECT y.target, x.name AS a, y.name AS b, count(DISTINCT y.lookup_id) AS n FROM near x JOIN near y
  ON x.target = y.target AND x.src = y.src AND x.name <> y.name AND y.ts - x.ts > 0 AND y.ts - x.ts < 60 GROUP BY ALL),
names AS (SELECT target, name, count(*) AS lookups FROM near GROUP BY ALL),
n_out AS (SELECT target, a, sum(n) AS n_out, count(*) AS fan_out FROM trans GROUP BY ALL),
n_in AS (SELECT target, b, sum(n) AS n_in, count(*) AS fan_in FROM trans GROUP BY ALL),
placed AS (SELECT s.target, s.name AS b, coalesce(n_in, 0) AS n_in, coalesce(fan_in, 0) AS fan_in,
    row_number() OVER (PARTITION BY s.target ORDER BY coalesce(fan_in, 0) DESC, s.name) - 1 AS fan_in_pos
  FROM names s LEFT JOIN n_in i ON i.target = s.target AND i.b = s.name),
scores AS (SELECT target, a, b, n, round(n / n_out::double, 6) AS share_out, n / n_out::double AS raw_out, fan_out,
    round(n / n_in::double, 6) AS share_in, fan_in, fan_in_pos
  FROM trans JOIN n_out USING (target, a) JOIN placed USING (target, b))"""


def _kmeans(passes: int = KMEANS_PASSES) -> str:
    steps = [
        "vec AS (SELECT vec_id AS name, label, cast(embedding AS double[]) AS vec FROM embeddings)",
        "c0 AS (SELECT row_number() OVER (ORDER BY md5(name::varchar), name) - 1 AS cluster, vec AS c FROM vec ORDER BY md5(name::varchar), name LIMIT 10)",
    ]
    for i in range(passes + 1):
        steps.append(
            f"a{i} AS MATERIALIZED (SELECT name, vec, arg_min(cluster, (list_distance(vec, c), cluster)) AS cluster, min(list_distance(vec, c)) AS dist "
            f"FROM vec, c{i} GROUP BY name, vec)"
        )
        if i < passes:
            steps.append(
                f"m{i} AS (SELECT cluster, pos, avg(x) AS m FROM (SELECT cluster, unnest(vec) AS x, generate_subscripts(vec, 1) AS pos FROM a{i}) GROUP BY ALL)"
            )
            steps.append(
                f"c{i + 1} AS MATERIALIZED (SELECT k.cluster, coalesce(n.c, k.c) AS c FROM c{i} k LEFT JOIN "
                f"(SELECT cluster, list(m ORDER BY pos) AS c FROM m{i} GROUP BY cluster) n USING (cluster))"
            )
    return ",\n".join(steps)


def _oversampled(k: int = 10, rounds: int = 5, seed: int = 1) -> str:
    """Draws by share of the summed squared distances, round by round, then k of the drawn by
    weight times squared distance."""
    steps = [
        "vec AS MATERIALIZED (SELECT vec_id AS name, cast(embedding AS double[]) AS vec FROM embeddings)",
        "d0 AS MATERIALIZED (SELECT * FROM vec ORDER BY md5(name::varchar), name LIMIT 1)",
    ]
    for i in range(1, rounds + 1):
        steps.append(f"s{i} AS MATERIALIZED (SELECT v.name, v.vec, min(list_distance(v.vec, d.vec) ** 2) AS cost FROM vec v, d{i - 1} d GROUP BY ALL)")
        draw = f"('0x' || substr(md5('{seed}:{i}:' || name), 1, 8))::bigint / 4294967296.0"
        steps.append(
            f"d{i} AS MATERIALIZED (SELECT * FROM d{i - 1} UNION SELECT name, vec FROM s{i} "
            f"WHERE {draw} * (SELECT sum(cost) FROM s{i}) < cost * {2 * k})"
        )
    steps.append(f"drawn AS MATERIALIZED (SELECT row_number() OVER (ORDER BY md5(name::varchar), name) AS i, name, vec FROM d{rounds})")
    steps.append(
        "weights AS MATERIALIZED (SELECT i, count(*) AS w FROM (SELECT v.name, arg_min(d.i, (list_distance(v.vec, d.vec), d.i)) AS i "
        "FROM vec v, drawn d GROUP BY v.name) GROUP BY i)"
    )
    steps.append("heavy AS MATERIALIZED (SELECT drawn.*, coalesce(w, 0) AS w FROM drawn LEFT JOIN weights USING (i))")
    steps.append("k1 AS MATERIALIZED (SELECT 1 AS place, * FROM heavy ORDER BY w DESC, i LIMIT 1)")
    for p in range(2, k + 1):
        steps.append(
            f"k{p} AS MATERIALIZED (SELECT * FROM k{p - 1} UNION ALL (SELECT {p}, i, name, vec, w FROM "
            f"(SELECT h.i, h.name, h.vec, h.w, min(list_distance(h.vec, c.vec) ** 2) AS far FROM heavy h, k{p - 1} c GROUP BY ALL) "
            "WHERE w * far > 0 ORDER BY w * far DESC, i LIMIT 1))"
        )
    return ",\n".join(steps) + f" SELECT place::integer AS place, name, w AS weight FROM k{k}"


def _typo_candidates(names: str, column: str) -> str:
    letters, both = f"'{LETTERS}'", f"'{LETTERS + DIGITS}'"
    return f"""
n AS ({names}),
pl AS (SELECT n.s, unnest(range(1, len(s) + 2)) AS i FROM n),
cand AS (
  SELECT s, s[:i-1] || {letters}[c] || s[i:] AS t FROM pl, range(1, {len(LETTERS) + 1}) x(c)
  UNION SELECT s, s[:i-1] || s[i+1:] FROM pl WHERE i <= len(s)
  UNION SELECT s, s[:i-1] || {both}[c] || s[i+1:] FROM pl, range(1, {len(LETTERS + DIGITS) + 1}) x(c) WHERE i <= len(s) AND s[i] <> {both}[c]
  UNION SELECT s, s[:i-1] || ',' || s[i+1:] FROM pl WHERE s[i] = '.'
  UNION SELECT s, s[:i-1] || s[i+1] || s[i] || s[i+2:] FROM pl WHERE i < len(s) AND s[i] <> s[i+1]),
found AS (SELECT s AS {column}, t AS candidate FROM cand)"""


def all_sql() -> dict[str, str]:
    base, tagged = LOOKUPS, f"{LOOKUPS},{TAGGED}"
    observed = "observed AS (SELECT DISTINCT target, suffix AS candidate FROM log WHERE suffix <> target AND lower(suffix) NOT IN (SELECT site FROM popular))"
    parsed = f"""{base},
good AS (SELECT * REPLACE (
    CASE lookup_id % 16 WHEN 5 THEN 'x=0' || qname WHEN 7 THEN '"a,b,' || qname || '"' ELSE qname END AS qname,
    CASE WHEN lookup_id % 16 = 15 THEN 1 ELSE qtype END AS qtype, CASE WHEN lookup_id % 16 = 15 THEN 0 ELSE rcode END AS rcode,
    CASE WHEN lookup_id % 16 = 15 THEN [] ELSE answer END AS answer,
    CASE WHEN lookup_id % 16 = 15 THEN [] ELSE authority END AS authority,
    CASE WHEN lookup_id % 16 = 15 THEN [] ELSE additional END AS additional)
  FROM lk WHERE lookup_id % 16 NOT IN (11, 13))"""
    sections = " UNION ALL ".join(
        f"SELECT lookup_id, '{s}' AS section, unnest({s}) AS r, generate_subscripts({s}, 1) - 1 AS pos FROM good"
        for s in ("answer", "authority", "additional")
    )
    assign = f"""{base},
q AS (SELECT DISTINCT qname, site, rank, {_suffix('qname', 'site')} AS suffix FROM lk, sites),
{_osa("SELECT DISTINCT suffix AS a, site AS b FROM q")},
best AS (SELECT qname, min_by((site, rank, d), (d, rank)) AS m FROM q JOIN osa ON suffix = a AND site = b WHERE d <= 2 GROUP BY qname),
assigned AS (SELECT lk.lookup_id, lk.qname, m[1] AS target, m[2] AS rank, cast(m[3] AS integer) AS distance FROM lk JOIN best USING (qname))"""
    edges = ", ".join("'" + (a + b).replace("'", "''") + "'" for a, near in KEYBOARD.items() for b in near)
    keyboard_cost = f"(CASE WHEN a[i]=b[j] THEN 0.0 WHEN (a[i]||b[j]) IN ({edges}) THEN 0.5 ELSE 1.0 END)::double"
    swapped = """
ask AS (SELECT *, replace(qname, '.ocm.', '.com.') AS name FROM lk WHERE qname LIKE '%.ocm.'),
checked AS (SELECT a.lookup_id, a.name, a.ts,
    count(*) FILTER (len(r.answer) > 0 AND r.ts + r.answer[1].ttl::bigint < a.ts) AS expired_before,
    count(*) FILTER (len(r.answer) > 0 AND r.ts <= a.ts AND a.ts < r.ts + r.answer[1].ttl::bigint) AS cached_at,
    count(*) FILTER (r.ts > a.ts AND r.ts < a.ts + 60) AS followed
  FROM ask a LEFT JOIN lk r ON r.qname = a.name{same} GROUP BY ALL)"""
    block = base.replace("lk AS (", "lk_all AS (") + """,
lk AS (SELECT * REPLACE (string_split(src_ip, '.')[1] || '.' || string_split(src_ip, '.')[2] || '.0.0' AS src_ip)
  FROM lk_all WHERE src_ip LIKE '10.%')"""
    bucket = "ts - ts % 300"
    stamp = f"strftime(make_timestamp(({bucket}) * 1000000), '%Y%m%d.%H%M')"
    delays = f"""{tagged},{RATIOS},{RULES},{V3},
delays AS (SELECT exists, count(*) AS pairs, avg(target_ts - typo_ts) AS m FROM v3 GROUP BY exists)"""

    sql = {
        "ingest_parse": f"WITH {parsed} SELECT lookup_id, ts, typ, src_ip, dst_ip, qname, qtype, rcode, len(answer) AS n_answer, len(authority) AS n_authority, len(additional) AS n_additional FROM good",
        "ingest_rr": f"WITH {parsed}, rr AS ({sections}) SELECT lookup_id, section, pos, r.owner AS owner, r.ttl::bigint AS ttl, r.rclass AS rclass, r.rtype AS rtype, r.rdata AS rdata FROM rr",
        "ingest_rejects": f"""WITH {base} SELECT lookup_id,
  CASE WHEN lookup_id % 16 = 13 THEN 'x' || {CLEAN} ELSE {CLEAN.replace("|| qname ||", "|| 'a,b,' || qname ||", 1)} END AS line,
  CASE WHEN lookup_id % 16 = 13 THEN 'time or type is no number' ELSE 'query type or result code is no number' END AS reason
  FROM lk WHERE lookup_id % 16 IN (11, 13)""",
        "export_roundtrip": f"WITH {base} SELECT lookup_id, {CLEAN} AS line, true AS same FROM lk",
        "count_log": "SELECT count(*) AS lookups FROM events WHERE event_id % 16 NOT IN (11, 13)",
        "log_sorted": f"WITH {base} SELECT target, ts, lookup_id, qname FROM lk ORDER BY ts, lookup_id",
        "file_union": f"WITH {base}, {_HOSTS} SELECT qname AS name FROM lk UNION SELECT host || '.' FROM hosts",
        "name_suffix": f"WITH {base} SELECT DISTINCT target, qname, {_suffix('qname', 'target')} AS suffix, {_suffix('qname', 'target', 0)} AS registered, split_part(qname, '.', 1) AS label, upper(qname) AS dotted FROM lk",
        "net16": f"WITH {tagged} SELECT src_ip, count(*) AS lookups, any_value(net16) AS net16, contains(src_ip, '.') AS ipv4, contains(src_ip, ':') AS ipv6 FROM log GROUP BY src_ip",
        "distinct_networks": f"WITH {tagged} SELECT DISTINCT target, net16 FROM log WHERE net16 IS NOT NULL",
        "answer_ttls": f"WITH {tagged} SELECT lookup_id, qname, a_ttl, answer[1].ttl::bigint AS first_ttl FROM log",
        "bucket_5min": f"""WITH {base}, s AS (SELECT ts, count(*) AS lookups, CASE WHEN ts < 28401300 THEN 28401300 WHEN ts > 28443900 THEN 28443900
    WHEN ts % 300 < 150 THEN ts - ts % 300 ELSE ts + 300 - ts % 300 END AS mid FROM lk GROUP BY ts)
  SELECT ts, lookups, {bucket} AS bucket, {stamp} AS stamp,
    array_to_string(list_filter([mid - 300, mid, mid + 300], lambda b: b >= 28401300 AND b <= 28443900), ' ') AS near FROM s""",
        "lookups_near_stamps": f"""WITH {tagged}, first AS (SELECT min(ts) AS ts FROM log WHERE suffix <> target GROUP BY target, suffix),
mid AS (SELECT CASE WHEN ts < 28401300 THEN 28401300 WHEN ts > 28443900 THEN 28443900 WHEN ts % 300 < 150 THEN ts - ts % 300 ELSE ts + 300 - ts % 300 END AS mid FROM first),
near AS (SELECT DISTINCT unnest([mid - 300, mid, mid + 300]) AS bucket FROM mid)
SELECT lookup_id, ts, target, qname, {bucket} AS bucket FROM log WHERE {bucket} IN (SELECT bucket FROM near WHERE bucket BETWEEN 28401300 AND 28443900)""",
        "tld_swap": f"WITH {base} SELECT lookup_id, qname, replace(qname, '.ocm.', '.com.') AS corrected FROM lk WHERE qname LIKE '%.ocm.'",
        "typo_candidates_of_hosts": f"WITH {_HOSTS}, {_typo_candidates('SELECT host AS s FROM hosts', 'host')} SELECT host, candidate FROM found",
        "candidate_hits_in_log": f"WITH {base}, {_typo_candidates('SELECT DISTINCT target AS s FROM lk', 'site')} SELECT candidate, site, count(*) AS lookups FROM found JOIN lk ON candidate = qname GROUP BY ALL",
        "observed_candidate_hits": f"WITH {base}, {_typo_candidates('SELECT DISTINCT target AS s FROM lk', 'site')} SELECT candidate, site, count(*) AS lookups FROM found JOIN lk ON candidate = qname GROUP BY ALL",
        "fuzzy_osa": f"WITH RECURSIVE {_HOSTS}, {_osa('SELECT x.host AS a, y.host AS b FROM hosts x, hosts y WHERE x.host <> y.host AND abs(len(x.host) - len(y.host)) <= 2')} SELECT a AS x, b AS y, cast(d AS integer) AS distance FROM osa WHERE d <= 2",
        "fuzzy_keyboard": f"WITH RECURSIVE {_HOSTS}, {_osa('SELECT x.host AS a, y.host AS b FROM hosts x, hosts y WHERE x.host <> y.host AND abs(len(x.host) - len(y.host)) <= 1', cost=keyboard_cost)} SELECT a AS x, b AS y, d AS distance FROM osa WHERE d <= 1.5",
        "fuzzy_segments": f"""WITH RECURSIVE {base}, {_HOSTS}, known AS (SELECT host AS y FROM hosts UNION SELECT site FROM sites),
{_osa("SELECT DISTINCT qname AS a, y AS b FROM lk, known WHERE abs(len(qname) - len(y)) <= 3 AND len(qname) > 0")}
SELECT a AS x, b AS y, cast(d AS integer) AS distance FROM osa WHERE d <= 3""",
        "fuzzy_segments_keyboard": f"WITH RECURSIVE {_HOSTS}, {_osa('SELECT x.host AS a, y.host AS b FROM hosts x, hosts y WHERE x.host <> y.host AND abs(len(x.host) - len(y.host)) <= 1', cost=keyboard_cost)} SELECT a AS x, b AS y, d AS distance FROM osa WHERE d <= 1.5",
        "fuzzy_site_assign": f"WITH RECURSIVE {assign} SELECT * FROM assigned",
        "fuzzy_regroup": f"""WITH RECURSIVE {base}, members AS (SELECT DISTINCT target AS list_id, qname AS name FROM lk),
heads AS (SELECT list_id, name AS target FROM members WHERE name IN (SELECT site FROM popular)),
{_osa("SELECT DISTINCT m.name AS a, h.target AS b FROM members m JOIN heads h USING (list_id)")}
SELECT m.list_id, h.target, m.name AS candidate, cast(d AS integer) AS distance FROM members m JOIN heads h USING (list_id)
  JOIN osa ON a = m.name AND b = h.target WHERE d > 0 AND d <= 2""",
        "qc_far_names": f"WITH RECURSIVE {tagged}, {_osa('SELECT DISTINCT suffix AS a, target AS b FROM log')} SELECT b AS target, a AS name, cast(d AS integer) AS distance FROM osa WHERE d > 2",
        "popular_anti": f"WITH {tagged}, {observed} SELECT * FROM observed",
        "candidate_lines": f"WITH {tagged}, {observed} SELECT target, target || ' ' || string_agg(candidate, ' ' ORDER BY candidate) AS line FROM observed GROUP BY target",
        "candidate_lines_read": f"WITH {tagged}, {observed} SELECT * FROM observed",
        "extract_typo_lookups": f"WITH {tagged}, {observed} SELECT lookup_id, target, suffix AS typo FROM own WHERE (target, suffix) IN (SELECT (target, candidate) FROM observed)",
        "zone_sites": f"""WITH {base}, zones AS (SELECT DISTINCT upper(split_part(qname, '.', 1)) AS zone FROM lk WHERE lookup_id % 4 <> 0)
SELECT DISTINCT zone, site AS target, qname FROM zones JOIN sites ON split_part(site, '.', 1) = lower(zone) JOIN lk ON lk.target = site""",
        "ttl_suppressed": f"WITH {tagged} SELECT lookup_id, target, net16, ts, suffix FROM log WHERE lookup_id IN (SELECT lookup_id FROM hidden)",
        "pairs_v1": f"WITH {tagged},{STATS} SELECT * FROM v1",
        "pairs_stored": f"WITH {tagged},{STATS} SELECT * FROM v1",
        "pair_lines_v1": f"WITH {tagged},{STATS}, text AS (SELECT lookup_id, {CLEAN} AS line FROM lk) SELECT a.line || ';;' || b.line AS line FROM v1 JOIN text a ON a.lookup_id = typo_id JOIN text b ON b.lookup_id = target_id",
        "pairs_status": f"WITH {tagged},{RATIOS},{RULES},{V3} SELECT * FROM v3",
        "pairs_dist1": f"""WITH RECURSIVE {tagged}, {_osa('SELECT DISTINCT suffix AS a, target AS b FROM log')}
SELECT x.target, x.suffix AS typo, x.lookup_id AS typo_id, y.lookup_id AS target_id, y.ts - x.ts AS delay_s
FROM log x JOIN osa ON x.suffix = a AND x.target = b AND d = 1 JOIN log y ON y.target = x.target AND y.suffix = y.target AND y.ts - x.ts >= 0 AND y.ts - x.ts < 60""",
        "pair_ratio": f"WITH {tagged},{RATIOS} SELECT * REPLACE (round(ratio, 6) AS ratio) FROM ratios",
        "single_counts": f"WITH {tagged} SELECT target, suffix AS typo, count(*) AS single_count FROM log WHERE suffix <> target GROUP BY ALL",
        "exists_by_ttl": f"WITH {tagged} SELECT s.target, s.typo, coalesce(any_value(o.exists), false) AS exists FROM (SELECT DISTINCT target, suffix AS typo FROM log WHERE suffix <> target) s LEFT JOIN (SELECT target, suffix AS typo, sum(a_ttl) <> 0 AS exists FROM own GROUP BY ALL) o USING (target, typo) GROUP BY ALL",
        "exists_by_rules": f"WITH {tagged},{RULES}, {observed} SELECT ruled.* FROM ruled JOIN observed ON ruled.target = observed.target AND typo = candidate",
        "ratio_status": f"WITH {tagged},{RATIOS},{RULES} SELECT ratios.target, ratios.typo, round(ratio, 6) AS ratio, join_count, single_count, CASE WHEN exists THEN 'yes' WHEN NOT exists THEN 'no' END AS status FROM ratios LEFT JOIN ruled USING (target, typo)",
        "typo_stats": f"WITH {tagged},{STATS} SELECT * REPLACE (round(mean_delay, 6) AS mean_delay) FROM tstats",
        "typo_stats_by_loads": f"WITH {tagged},{STATS} SELECT * REPLACE (round(mean_delay, 6) AS mean_delay) FROM tstats",
        "summary_by_exists": f"WITH {tagged},{STATS} SELECT exists, count(*) AS lookalikes, sum(pair_count)::bigint AS pairs, round(sum(pair_count * mean_delay) / sum(pair_count), 6) AS mean_delay FROM tstats WHERE pair_count / single_count::double > 0.2 GROUP BY exists",
        "summary_sentences": f"""WITH {tagged},{STATS}, s AS (SELECT exists, count(*) AS k, sum(pair_count)::bigint AS pairs, round(sum(pair_count * mean_delay) / sum(pair_count), 3) AS m
  FROM tstats WHERE pair_count / single_count::double > 0.2 GROUP BY exists)
SELECT exists, CASE WHEN exists THEN 'For existed' ELSE 'For non-existed' END || ' typo domain, there are ' || k || ' pairs of typo and target website, ' || pairs || ' records. The average time is ' || m || '.' AS line FROM s""",
        "delay_by_exists": f"WITH {delays} SELECT exists, pairs, round(m, 6) AS mean_delay FROM delays",
        "delay_sentences": f"WITH {delays} SELECT exists, CASE WHEN exists THEN 'For existed domain' ELSE 'For non-existed domain' END || ', there are ' || pairs || ' records, average time is ' || round(m, 3) AS line FROM delays",
        "pending_lookalikes": f"WITH {tagged},{RATIOS} SELECT target, typo FROM unpopular WHERE (target, typo) NOT IN (SELECT (target, typo) FROM ratios)",
        "ipv6_share": f"WITH {base} SELECT count(*) AS lookups, count(*) FILTER (contains(src_ip, ':')) AS ipv6_lookups, round(count(*) FILTER (contains(src_ip, ':')) / count(*)::double, 6) AS ipv6_share FROM lk",
        "tld_cached_check": f"WITH {base},{swapped.replace('{same}', '')} SELECT * FROM checked",
        "uncached_followup": f"""WITH {block},{swapped.replace('{same}', ' AND r.src_ip = a.src_ip')}
SELECT count(*) FILTER (expired_before > 0) AS with_answer_before, count(*) FILTER (expired_before = 0) AS without_answer_before,
  count(*) FILTER (expired_before = 0 AND followed > 0) AS followed,
  round(count(*) FILTER (expired_before = 0 AND followed > 0) / nullif(count(*) FILTER (expired_before = 0), 0)::double, 6) AS followed_share FROM checked""",
        "name_counts": f"WITH RECURSIVE {tagged},{TRANSITIONS} SELECT target, name, lookups, sum(lookups) OVER (PARTITION BY target)::bigint AS site_lookups FROM names",
        "transition_counts": f"WITH RECURSIVE {tagged},{TRANSITIONS} SELECT * FROM trans",
        "transition_scores": f"WITH RECURSIVE {tagged},{TRANSITIONS} SELECT * EXCLUDE (raw_out) FROM scores",
        "transition_pairs": f"WITH RECURSIVE {tagged},{TRANSITIONS} SELECT * EXCLUDE (raw_out) FROM scores WHERE raw_out >= 0.12 AND fan_out <= 30 AND fan_in_pos <= 3",
        "co_lookup_share": f"""WITH RECURSIVE {tagged},{TRANSITIONS},
both_ways AS (SELECT x.target, x.name, y.name AS other, CASE WHEN y.ts > x.ts THEN 'after' ELSE 'before' END AS direction, count(DISTINCT y.lookup_id) AS n
  FROM near x JOIN near y ON x.target = y.target AND x.src = y.src AND x.name <> y.name AND abs(y.ts - x.ts) BETWEEN 1 AND 59 GROUP BY ALL)
SELECT target, name, other, direction, n, round(n / lookups::double, 6) AS share FROM both_ways JOIN names USING (target, name)""",
        "co_lookup_ranked": f"""WITH RECURSIVE {tagged},{TRANSITIONS},
both_ways AS (SELECT x.target, x.name, y.name AS other, CASE WHEN y.ts > x.ts THEN 'after' ELSE 'before' END AS direction, count(DISTINCT y.lookup_id) AS n
  FROM near x JOIN near y ON x.target = y.target AND x.src = y.src AND x.name <> y.name AND abs(y.ts - x.ts) BETWEEN 1 AND 59 GROUP BY ALL),
shares AS (SELECT target, name, other, direction, n, round(n / lookups::double, 6) AS share FROM both_ways JOIN names USING (target, name))
SELECT *, row_number() OVER (ORDER BY share DESC, target, name, other, direction) AS place FROM shares""",
        "consecutive_gap": f"""WITH {base}, s AS (SELECT src_ip, ts, lead(ts) OVER (PARTITION BY src_ip ORDER BY ts, lookup_id) AS next_ts FROM lk)
SELECT src_ip, ts, next_ts, next_ts - ts AS gap_s FROM s WHERE next_ts - ts < 300""",
        "consecutive_global": f"""WITH {base}, s AS (SELECT ts, lookup_id, qname, lead(ts) OVER w AS next_ts, lead(lookup_id) OVER w AS next_lookup_id, lead(qname) OVER w AS next_qname
  FROM lk WINDOW w AS (ORDER BY ts, lookup_id))
SELECT *, next_ts - ts AS gap_s FROM s WHERE next_ts - ts < 300""",
        "kmeans_fixed_passes": f"WITH {_kmeans()} SELECT cluster::integer AS cluster, pos::integer AS pos, round(x, 5) AS x, size FROM (SELECT cluster, unnest(c) AS x, generate_subscripts(c, 1) - 1 AS pos FROM c{KMEANS_PASSES}) JOIN (SELECT cluster, count(*) AS size FROM a{KMEANS_PASSES} GROUP BY cluster) USING (cluster)",
        "kmeans_converged": f"WITH {_kmeans(CONVERGED_PASSES)} SELECT cluster::integer AS cluster, pos::integer AS pos, round(x, 4) AS x, size FROM (SELECT cluster, unnest(c) AS x, generate_subscripts(c, 1) - 1 AS pos FROM c{CONVERGED_PASSES}) JOIN (SELECT cluster, count(*) AS size FROM a{CONVERGED_PASSES} GROUP BY cluster) USING (cluster)",
        "log_files_read": f"WITH {base}, h(how) AS (VALUES ('glob'), ('recursive')) SELECT how, qname, count(*) AS lookups FROM lk, h GROUP BY ALL",
        "ingest_ledger": f"WITH {base} SELECT {bucket} AS bucket, count(*) FILTER (lookup_id % 16 NOT IN (11, 13)) AS rows, count(*) FILTER (lookup_id % 16 IN (11, 13)) AS rejects FROM lk GROUP BY ALL",
        "ledger_lookups": f"""WITH {parsed} SELECT qname, count(*) AS lookups, sum(len(answer))::bigint AS answers FROM good GROUP BY qname
UNION ALL SELECT CASE WHEN lookup_id % 16 = 13 THEN 'time or type is no number' ELSE 'query type or result code is no number' END, count(*), NULL FROM lk WHERE lookup_id % 16 IN (11, 13) GROUP BY 1""",
        "site_files_read": f"WITH {base} SELECT target, qname, count(*) AS lookups FROM lk GROUP BY ALL",
        "pair_files_read": f"WITH {tagged},{STATS} SELECT a.ts AS typo_ts, a.src_ip AS typo_src_ip, a.qname AS typo_qname, b.ts AS target_ts, b.src_ip AS target_src_ip, b.qname AS target_qname FROM v1 JOIN lk a ON a.lookup_id = typo_id JOIN lk b ON b.lookup_id = target_id",
        "ratio_file_read": f"WITH {tagged},{RATIOS},{RULES} SELECT ratios.target, ratios.typo, round(ratio, 6) AS ratio, join_count, single_count, CASE WHEN exists THEN 'yes' WHEN NOT exists THEN 'no' END AS status FROM ratios LEFT JOIN ruled USING (target, typo)",
        "typo_stats_file_read": f"WITH {tagged},{STATS} SELECT * REPLACE (round(mean_delay, 6) AS mean_delay) FROM tstats",
        "status_pair_files_read": f"WITH {tagged},{RATIOS},{RULES},{V3} SELECT typo, typo_ts, target, target_ts, net16, CASE WHEN exists THEN 'existed' ELSE 'nonexisted' END AS status FROM v3",
        "delay_list": f"WITH {tagged},{RATIOS},{RULES},{V3} SELECT exists, target_ts - typo_ts AS delay_s FROM v3",
        "write_modes": f"WITH {base} SELECT target, count(*) AS appended, count(*) FILTER (lookup_id % 2 = 0) AS overwritten FROM lk GROUP BY target HAVING overwritten > 0",
        "typo_files_read": f"WITH {tagged}, {observed} SELECT target, suffix AS typo, count(*) AS lookups FROM own WHERE (target, suffix) IN (SELECT (target, candidate) FROM observed) GROUP BY ALL",
        "list_files_read": f"WITH {tagged}, {observed} SELECT * FROM observed",
        "site_files_ranked": f"WITH {_HOSTS} SELECT cast(row_number() OVER (ORDER BY host) AS integer) AS rank, host || '.' AS site FROM hosts WHERE host <> ''",
        "lookup_dates": f"WITH {base} SELECT strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, count(*) AS lookups, min(ts) AS first_ts, max(ts) AS last_ts FROM lk GROUP BY 1",
        "zone_file_read": f"WITH {base} SELECT upper(split_part(qname, '.', 1)) AS zone, count(*) AS lines FROM lk WHERE lookup_id % 4 <> 0 AND split_part(qname, '.', 1) <> '' GROUP BY ALL",
        "feature_file_read": "SELECT vec_id::varchar AS name, len(embedding)::integer AS dims, round(list_sum(cast(embedding AS double[])), 5) AS total FROM embeddings",
        "pair_lines_dist1": f"""WITH RECURSIVE {tagged}, {_osa('SELECT DISTINCT suffix AS a, target AS b FROM log')}, text AS (SELECT lookup_id, {CLEAN} AS line FROM lk)
SELECT s.line || ';;' || t.line AS line FROM log x JOIN osa ON x.suffix = a AND x.target = b AND d = 1
  JOIN log y ON y.target = x.target AND y.suffix = y.target AND y.ts - x.ts >= 0 AND y.ts - x.ts < 60
  JOIN text s ON s.lookup_id = x.lookup_id JOIN text t ON t.lookup_id = y.lookup_id""",
        "sql_distances": f"WITH RECURSIVE {tagged}, {_osa('SELECT DISTINCT suffix AS a, target AS b FROM log')} SELECT b AS target, a AS suffix, cast(d AS integer) AS distance, '10.1.0.0' AS net16 FROM osa",
        "sql_keyboard_distances": f"WITH RECURSIVE {tagged}, {_osa('SELECT DISTINCT suffix AS a, target AS b FROM log', cost=keyboard_cost)} SELECT b AS target, a AS suffix, d AS distance FROM osa",
        "sql_typo_candidates": f"WITH {_HOSTS}, {_typo_candidates('SELECT host AS s FROM hosts', 'host')} SELECT host, candidate FROM found",
        "kmeans_members": f"WITH {_kmeans()} SELECT cluster::integer AS cluster, row_number() OVER (PARTITION BY cluster ORDER BY name)::integer AS place, name FROM a{KMEANS_PASSES} QUALIFY place <= 10",
        "kmeans_oversampled_start": f"WITH {_oversampled()}",
        "centre_distance": f"WITH {_kmeans()} SELECT name, cluster::integer AS cluster, round(dist, 5) AS distance FROM a0",
        "label_means": "WITH t AS (SELECT label, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) SELECT label, pos::integer AS pos, round(avg(x), 6) AS mean, count(*) AS count FROM t GROUP BY label, pos",
        "features_from_text": "SELECT vec_id AS name, len(embedding)::integer AS dims, round(list_sum(cast(embedding AS double[])), 5) AS total FROM embeddings",
        "stream_ingest_by_site": f"WITH RECURSIVE {assign} SELECT target, qname, distance, count(*) AS lookups FROM assigned GROUP BY ALL",
        "stream_pairs": f"WITH {tagged} SELECT a.target, a.net16, a.suffix AS typo, a.lookup_id, a.ts AS typo_ts, b.ts AS target_ts, b.ts - a.ts AS delay_s FROM log a JOIN log b ON a.target = b.target AND a.net16 = b.net16 AND b.suffix = b.target AND a.suffix <> a.target AND b.ts - a.ts BETWEEN 0 AND 60",
        "stream_pairs_any_order": f"WITH {tagged} SELECT a.target, a.net16, a.suffix AS typo, a.lookup_id, a.ts AS typo_ts, b.ts AS target_ts, b.ts - a.ts AS delay_s FROM log a JOIN log b ON a.target = b.target AND a.net16 = b.net16 AND b.suffix = b.target AND a.suffix <> a.target AND b.ts - a.ts BETWEEN 0 AND 60",
        "stream_pairs_visible": f"WITH {tagged} SELECT a.target, a.net16, a.suffix AS typo, a.lookup_id, a.ts AS typo_ts, b.ts AS target_ts, b.ts - a.ts AS delay_s FROM visible a JOIN visible b ON a.target = b.target AND a.net16 = b.net16 AND b.suffix = b.target AND a.suffix <> a.target AND b.ts - a.ts BETWEEN 0 AND 60",
    }
    return {name: textwrap.dedent(text).strip() for name, text in sql.items()}
