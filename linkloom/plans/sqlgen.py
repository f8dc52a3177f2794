"""The same rules as SQL for DuckDB, built from the rule tables."""

from __future__ import annotations

from linkloom.functions import normalize as N


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(words: list[str]) -> str:
    return "(" + ", ".join(map(quoted, words)) + ")"


def words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '\\s+'), lambda x: x <> '')"


def sanitize(c: str) -> str:
    s = f"trim(coalesce({c}, ''))"
    t = f"lower(regexp_replace(strip_accents({s}), '[^\\x00-\\x7F]', '', 'g'))"
    t = f"replace(replace({t}, '&', ' and '), '@', ' at ')"
    t = f"trim(regexp_replace(regexp_replace({t}, '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
    return f"CASE WHEN lower({s}) IN {listed(N.NULL_WORDS)} THEN '' ELSE {t} END"


def rewrite(c: str, rules: list[tuple[str, str]]) -> str:
    for pattern, to in rules:
        c = f"regexp_replace({c}, {quoted(pattern)}, {quoted(to)}, 'g')"
    return c


def collapse(c: str) -> str:
    """``c`` is a column name."""
    return f"array_to_string(list_filter({words(c)}, lambda x, i: i = 1 OR x <> ({words(c)})[i - 1]), ' ')"


def name_words(c: str) -> str:
    return f"list_filter({words(c)}, lambda x: x NOT IN {listed(N.STOP_WORDS + N.LEGAL_WORDS)})"


def ordered_distinct(c: str) -> str:
    return f"list_filter({c}, lambda x, i: list_position({c}, x) = i)"


def postal(a: str, land: str) -> str:
    strip = lambda p: p.replace("(?U)", "").replace("(?iU)", "(?i)")
    near = f"regexp_extract({a}, {quoted(strip(N.POSTAL_US_NEAR))}, 1)"
    end = f"regexp_extract({a}, {quoted(strip(N.POSTAL_US_END))}, 1)"
    return (
        f"CASE upper(trim({land})) WHEN 'INDIA' THEN replace(regexp_extract({a}, {quoted(strip(N.POSTAL_INDIA))}, 1), ' ', '') "
        f"WHEN 'US' THEN split_part(CASE WHEN {near} <> '' THEN {near} ELSE {end} END, '-', 1) "
        f"WHEN 'FRANCE' THEN regexp_extract({a}, {quoted(strip(N.POSTAL_FRANCE))}, 1) ELSE '' END"
    )


def soundex(w: str) -> str:
    code = f"translate(upper({w}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '_123_12__22455_12623_1_2_2')"
    for d in "123456":
        code = f"regexp_replace({code}, '{d}+', '{d}', 'g')"
    letters = f"regexp_replace(upper({w}), '[^A-Z]', '', 'g')"
    code = code.replace(f"upper({w})", letters)
    return f"CASE WHEN {letters} = '' THEN '' ELSE left({letters}[1] || replace(substr({code}, CASE WHEN {code}[1] = '_' THEN 1 ELSE 2 END), '_', '') || '000', 4) END"


def normalized(raw: str = "raw", out: str = "norm") -> str:
    """CTEs from ``raw`` to ``out``."""
    return f"""{out}1 AS (SELECT *, {rewrite(f"regexp_replace({sanitize('business_name')}, {quoted(N.HONORIFIC)}, '')", N.LEGAL_REWRITES)} AS n1,
        {rewrite(f"regexp_replace({sanitize('business_address')}, '\\b0+([1-9]\\d*)\\b', '\\1', 'g')", N.ADDRESS_REWRITES)} AS a1 FROM {raw}),
    {out}2 AS (SELECT *, {collapse('n1')} AS business_name_clean, {collapse('a1')} AS business_address_clean FROM {out}1),
    {out}3 AS (SELECT *, {ordered_distinct(name_words('business_name_clean'))} AS kept FROM {out}2),
    {out} AS (SELECT trim(entity_id) AS entity_id, business_name_clean, business_address_clean, trim(country) AS country,
        {postal('trim(business_address)', 'country')} AS postal_code,
        array_to_string(CASE WHEN len(list_filter(kept, lambda x: length(x) > 1)) > 0 THEN list_filter(kept, lambda x: length(x) > 1)
            WHEN len(kept) > 0 THEN kept ELSE {ordered_distinct(words('business_name_clean'))} END, ' ') AS name_tokens, ord FROM {out}3)"""


def candidates(s1: str, targets: str, top_k: int, out: str) -> str:
    """CTEs up to ``out`` (source1_entity_id, candidates); targets have src and ord."""
    caps = {1: 20, 2: 15, 3: 10, 4: 5, 5: 5}
    ws = f"({words("CASE WHEN trim(name_tokens) <> '' THEN name_tokens ELSE business_name_clean END")})"
    gate = f"CASE x.rule WHEN 1 THEN true WHEN 4 THEN len(a.c) < 15 WHEN 5 THEN len(a.c) < 10 ELSE len(a.c) < {top_k} END"
    go = f"(CASE WHEN x.rule <> a.rule THEN {gate} ELSE a.go END)"
    open_ = "(CASE WHEN x.rule <> a.rule OR x.nth <> a.nth THEN true ELSE a.op END)"
    c = f"(CASE WHEN {go} AND {open_} AND NOT list_contains(a.c, x.tid) THEN list_append(a.c, x.tid) ELSE a.c END)"
    return f"""{out}_t AS (SELECT *, upper(country) AS block, {ws} AS ws FROM {targets}),
    {out}_q AS (SELECT *, CASE WHEN upper(country) IN (SELECT block FROM {out}_t) THEN upper(country) ELSE '*' END AS block, {ws} AS ws FROM {s1}),
    {out}_tt AS (SELECT * FROM {out}_t UNION ALL BY NAME SELECT * REPLACE ('*' AS block) FROM {out}_t WHERE EXISTS (SELECT 1 FROM {out}_q WHERE block = '*')),
    {out}_w AS (SELECT block, postal_code, src, ord, entity_id AS tid, unnest(ws[1:4]) AS w, generate_subscripts(ws[1:4], 1) AS pos FROM {out}_tt),
    {out}_k AS (
        SELECT block, 1 AS rule, postal_code || '_' || w AS key, src, ord, pos, tid FROM {out}_w WHERE length(w) >= 3 AND postal_code <> ''
        UNION ALL SELECT block, 2, w, src, ord, pos, tid FROM {out}_w WHERE length(w) >= 3
        UNION ALL SELECT block, 3, postal_code, src, ord, 0, entity_id FROM {out}_tt WHERE postal_code <> ''
        UNION ALL SELECT block, 4, {soundex('w')}, src, ord, pos, tid FROM {out}_w WHERE length(w) >= 3 AND {soundex('w')} <> ''
        UNION ALL SELECT block, 5, left(w, 3), src, ord, pos, tid FROM {out}_w WHERE length(w) >= 3),
    {out}_p AS (SELECT *, row_number() OVER (PARTITION BY block, rule, key ORDER BY src, ord, pos) AS rk FROM {out}_k
        QUALIFY rk <= CASE rule {" ".join(f"WHEN {r} THEN {n}" for r, n in caps.items())} END),
    {out}_u AS (SELECT entity_id, ord, block, postal_code, unnest(ws[1:4]) AS w, generate_subscripts(ws[1:4], 1) AS nth FROM {out}_q),
    {out}_a AS (
        SELECT entity_id, ord, block, 1 AS rule, nth, postal_code || '_' || w AS key FROM {out}_u WHERE postal_code <> ''
        UNION ALL SELECT entity_id, ord, block, 2, nth, w FROM {out}_u WHERE nth <= 3 AND length(w) >= 3
        UNION ALL SELECT entity_id, ord, block, 3, 1, postal_code FROM {out}_q WHERE postal_code <> ''
        UNION ALL SELECT entity_id, ord, block, 4, nth, {soundex('w')} FROM {out}_u WHERE nth <= 2
        UNION ALL SELECT entity_id, ord, block, 5, nth, left(w, 3) FROM {out}_u WHERE nth <= 2 AND length(w) >= 3),
    {out}_e AS (SELECT a.entity_id, a.ord, list({{'c': []::VARCHAR[], 'rule': a.rule, 'nth': a.nth, 'go': true, 'op': true, 'tid': p.tid}} ORDER BY a.rule, a.nth, p.rk) AS ev
        FROM {out}_a a JOIN {out}_p p USING (block, rule, key) GROUP BY ALL),
    {out}_f AS (SELECT entity_id, ord, list_reduce(list_prepend({{'c': []::VARCHAR[], 'rule': 0, 'nth': 0::BIGINT, 'go': true, 'op': true, 'tid': ''}}, ev),
        lambda a, x: {{'c': {c}, 'rule': x.rule, 'nth': x.nth, 'go': {go}, 'op': {open_} AND NOT (x.rule <= 3 AND {go} AND {open_} AND len({c}) >= {top_k}), 'tid': x.tid}}).c AS c
        FROM {out}_e),
    {out} AS (SELECT q.entity_id AS source1_entity_id, list_sort(list_filter(coalesce(f.c, []::VARCHAR[]), lambda x: (x LIKE 'S2-%' OR x LIKE 'S3-%') AND x <> q.entity_id)) AS candidates
        FROM {out}_q q LEFT JOIN {out}_f f USING (entity_id, ord))"""
