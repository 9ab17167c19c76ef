"""DuckDB SQL for the span queries (operators 5 and 10), from regular expressions alone.

DuckDB's expressions have no lookaround, so what they can't say is checked on the matches.
"""

from __future__ import annotations

from . import pii, secret_ledger

_D = "d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"
_ALNUM = r"[\p{L}\p{N}]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def matches(pattern: str) -> str:
    """``doc_id, t, m, pos``: leftmost non-overlapping matches and where they start, from the texts between them."""
    before = "coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0)"
    found = f"SELECT doc_id, t, regexp_extract_all(t, {quoted(pattern)}) AS ms, regexp_split_to_array(t, {quoted(pattern)}) AS gaps FROM d"
    return f"SELECT doc_id, t, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1), lambda i: {before}))::BIGINT AS pos FROM ({found})"


def spans(kinds: tuple[str, ...], kind: str, pattern: str, condition: str = "true", start: str = "pos", end: str = "pos + length(m)") -> str:
    return f"SELECT doc_id, {kinds.index(kind)} AS k, '{kind}' AS kind, ({start})::BIGINT AS a, ({end})::BIGINT AS b FROM ({matches(pattern)}) WHERE {condition}"


def query(kinds: tuple[str, ...], base: tuple[str, ...], order: str, parts: list[str], more: str = "") -> str:
    """The columns of a span query, from the spans of each kind."""
    spelled = "kind || ':' || a || ':' || b"
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in base)
    is_base = f"kind IN ({', '.join(map(quoted, base))})"
    return f"""WITH {_D}{more}, s AS ({" UNION ALL ".join(f"({part})" for part in parts)}),
g AS (SELECT d.doc_id, {counts}, coalesce(string_agg({spelled}, ',' ORDER BY {order}) FILTER ({is_base}), '') AS base,
    coalesce(string_agg({spelled}, ',' ORDER BY {order}), '') AS spans FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id)
SELECT doc_id, {", ".join(f"n_{kind}" for kind in base)}, sha256(base) AS base_sha256, spans FROM g"""


def secrets() -> str:
    """Operator 10."""
    parts = []
    for kind, pattern, group, least in secret_ledger.RULES:
        start = "pos"
        if pattern.startswith("(?<!"):  # a character that isn't in the class, or the start of the text
            pattern = pattern.replace("(?<!", "(?:^|", 1).replace("[", "[^", 1)
            start = "pos + CASE WHEN starts_with(m, 'eyJ') THEN 0 ELSE 1 END"
        length = f"length(regexp_extract(m, {quoted(pattern)}, {group}))" if group else f"length(m) - ({start} - pos)"
        parts.append(spans(secret_ledger.KINDS, kind, pattern, f"{length} >= {least}", start))
    return query(secret_ledger.KINDS, secret_ledger.BASE, "a, k", parts)


def accounts() -> str:
    """CTEs up to ``accounts(doc_id, a, b)``."""
    cues = "|".join(form for cue in pii.CUES for form in dict.fromkeys((cue, cue.upper(), cue.capitalize())))
    after = rf"^x(?:[ ]?\b(?i:{'|'.join(pii.LINKS)})\b\.?){{0,3}}[ ]*[:#=]?[ ]*"
    lengths = "MAP {" + ", ".join(f"'{country}': {size}" for country, size in pii.IBAN_LENGTHS.items()) + "}"
    return rf""", cues AS (SELECT doc_id, pos, pos + length(m) AS e, substr(t, (pos + length(m) + 1)::BIGINT) AS tail FROM ({matches(f"(?:^|[^{_ALNUM[1:-1]}])(?:{cues})")})),
rests AS (SELECT doc_id, pos, e + length(h) - 1 AS start, substr(tail, length(h)) AS r FROM (SELECT *, regexp_extract('x' || tail, {quoted(after)}) AS h FROM cues)),
ibans AS (SELECT doc_id, pos, start, max(len) AS len FROM (SELECT *, length(c) AS len, replace(c, ' ', '') AS tight FROM
    (SELECT doc_id, pos, start, r, k, regexp_extract(r, '^[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{' || (k - 4) || '}}') AS c FROM rests, range(15, 35) s(k) WHERE regexp_matches(r, '^[A-Z]{{2}}[0-9]{{2}}')))
    WHERE len > 0 AND NOT regexp_matches(substr(r, len + 1, 1), '{_ALNUM}') AND coalesce({lengths}[substr(c, 1, 2)], k) = k
    AND list_reduce(string_split(substr(tight, 5) || substr(tight, 1, 4), ''), lambda acc, c: CASE WHEN c BETWEEN '0' AND '9' THEN ((acc::INT * 10 + c::INT) % 97)::VARCHAR ELSE ((acc::INT * 100 + ascii(c) - 55) % 97)::VARCHAR END, '0') = '1'
    GROUP BY ALL),
runs AS (SELECT doc_id, pos, start, r, regexp_extract(r, '^[0-9]+') AS one, regexp_extract(r, '^[0-9]{{1,5}}(?:(?:-[0-9]+)+|(?: [0-9]+)+)') AS more FROM (SELECT doc_id, pos, start, substr(r, 1, 64) AS r FROM rests)),
groups AS (SELECT doc_id, pos, start, CASE WHEN length(one) BETWEEN 6 AND 20 AND NOT regexp_matches(substr(r, length(one) + 1, 1), '[A-Za-z]') THEN one
    WHEN more = '' THEN '' WHEN NOT regexp_matches(substr(r, length(more) + 1, 1), '[0-9A-Za-z]') THEN more
    WHEN regexp_matches(regexp_replace(more, '[- ][0-9]+$', ''), '[- ]') THEN regexp_replace(more, '[- ][0-9]+$', '') ELSE '' END AS n FROM runs),
sizes AS (SELECT doc_id, pos, start, list_transform(regexp_split_to_array(n, '[- ]'), lambda g: length(g)) AS gs FROM groups WHERE n <> ''),
numbers AS (SELECT doc_id, pos, start, max(total + i - 1) AS len FROM (SELECT doc_id, pos, start, i, list_sum(gs[1:i]) AS total FROM sizes, range(1, 33) s(i) WHERE i <= len(gs)) WHERE total <= 20 AND total >= 6 GROUP BY ALL),
ends AS (SELECT doc_id, pos, start AS a, max(start + len) AS b FROM (SELECT * FROM ibans UNION ALL SELECT * FROM numbers) GROUP BY ALL),
accounts AS (SELECT doc_id, a, b FROM ends x WHERE NOT EXISTS (SELECT 1 FROM ends y WHERE y.doc_id = x.doc_id AND y.a < x.a AND y.b > x.pos + 1))"""


def personal() -> str:
    """Operator 5."""
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    doubled = "CASE WHEN i % 2 = 1 THEN x WHEN x * 2 > 9 THEN x * 2 - 9 ELSE x * 2 END"
    luhn = f"list_sum(list_transform(list_reverse(string_split({digits}, '')), lambda c, i: {doubled.replace('x', 'c::INT')})) % 10 = 0"
    parts = "string_split(m, '.')"
    small = f"len(list_filter({parts}, lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(right(p, 3) AS INT), 0) > 255)) = 0"
    space = r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
    address = rf"""(?:^|[^A-Za-z])(?i:https?|ftp)://{_ALNUM}[^{space}<>"'`{{}}|\\^]*"""
    lead = "pos + length(m) - length(regexp_extract(m, '(?is)(?:https?|ftp)://.*'))"
    of = [
        spans(pii.KINDS, "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
        spans(pii.KINDS, "ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", small),
        spans(pii.KINDS, "card", r"[0-9](?:[\x20-]?[0-9])+", f"length({digits}) BETWEEN 13 AND 19 AND {luhn}"),
        spans(pii.KINDS, "phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 9 AND 15"),
        f"SELECT doc_id, {pii.KINDS.index('account')}, 'account', a::BIGINT, b::BIGINT FROM accounts",
        spans(pii.KINDS, "address", address, start=lead, end=r"""pos + length(regexp_replace(m, '[.,;:!?)\]"]+$', ''))"""),
    ]
    return query(pii.KINDS, pii.BASE, "k, a", of, accounts())
