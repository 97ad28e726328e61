"""SQL fragments shared by the oracle queries: independent statements of the derived inputs."""

from __future__ import annotations

from notelens.functions import text as tx
from notelens.plans import fixtures as fx


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def str_list(values) -> str:
    return "([" + ", ".join(quote(v) for v in values) + "]::VARCHAR[])"


def u(*keys: str, seed: int | str) -> str:
    text = " || ':' || ".join([*(f"({k})::VARCHAR" for k in keys), quote(str(seed))])
    return f"(('0x' || substr(md5({text}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


SP = f"[{tx.SPACE_SET}]"
HEADER = rf"(?m)(?:^|{SP}{{4,}}|\n)[\p{{Nd}}.#]{{0,4}}{SP}*([A-Z][A-z0-9/ ]+[A-z]:)"
PUNCT = quote(tx.PUNCTUATION)


def clean(expr: str) -> str:
    out = f"regexp_replace({expr}, '\\[\\*\\*.*?\\*\\*\\]', ' ', 'g')"
    out = f"regexp_replace({out}, '[_*?/()]+', ' ', 'g')"
    out = f"regexp_replace({out}, '\\b(-)?[\\d.,]+(-)?\\b', ' DIGITPARSED ', 'g')"
    return f"regexp_replace({out}, '{SP}+', ' ', 'g')"


def words(expr: str, stops=()) -> str:
    split = f"regexp_split_to_array(lower({expr}), '{SP}+')"
    stripped = f"list_transform({split}, lambda w: trim(w, {PUNCT}))"
    return f"list_filter({stripped}, lambda w: w <> '' AND NOT list_contains({str_list(stops)}, w))"


def pseudo(prefix: str, expr: str) -> str:
    return f"('{prefix}' || upper(regexp_replace({expr}, '[:{tx.SPACE_SET}]+', '', 'g')))"


_PREFIX = f"""CASE WHEN (doc_id + 3 * (i - 1)) % 17 < 12
         THEN {str_list(fx.HEADER_NAMES)}[((doc_id + 3 * (i - 1)) % 17) + 1] || ': '
       WHEN (doc_id + 3 * (i - 1)) % 17 = 12 THEN 'Visit ' || chr((65 + doc_id % 26)::INT) || 'x: '
       WHEN (doc_id + 3 * (i - 1)) % 17 = 13
         THEN 'Plan ' || chr((97 + doc_id % 26)::INT) || chr((97 + (doc_id // 26) % 26)::INT) || ': '
       ELSE '' END"""

#: name -> (fragments it needs, SQL body)
CTE: dict[str, tuple[tuple[str, ...], str]] = {
    "notes": ((), f"""
SELECT doc_id, source AS category,
       array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: {_PREFIX} || x), chr(10)) AS text
FROM documents"""),
    "all_headers": (("notes",), f"""
SELECT doc_id, trim(trim(upper(unnest(regexp_extract_all(text, '{HEADER}', 1)))), ':') AS section FROM notes"""),
    "sections": (("all_headers",), f"""
SELECT section, count(*) AS count FROM all_headers GROUP BY section HAVING count(*) >= {fx.MIN_COUNT}"""),
    "pieces": (("notes",), f"""
SELECT *, is_header AND coalesce(lead(is_header) OVER (PARTITION BY doc_id ORDER BY i), true) AS is_empty
FROM (SELECT *, i % 2 = 1 AS is_header FROM (
        SELECT doc_id, category, unnest(p) AS body, unnest(range(len(p))) AS i
        FROM (SELECT doc_id, category,
                     string_split(regexp_replace(text, '{HEADER}', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS p
              FROM notes)))
WHERE regexp_matches(body, '[^{tx.SPACE_SET}]')"""),
    "raw_tokens": (("pieces", "sections"), f"""
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS pos, token,
       CASE WHEN token LIKE '%header=%' THEN 'section' WHEN token LIKE '%document=%' THEN 'category'
            ELSE 'token' END AS kind
FROM (SELECT doc_id, -1 AS i, 0 AS j, {pseudo('document=', 'category')} AS token FROM notes
      UNION ALL
      SELECT doc_id, i, unnest(range(len(toks))) AS j, unnest(toks) AS token
      FROM (SELECT p.doc_id, p.i,
              CASE WHEN is_empty THEN []::VARCHAR[]
                   WHEN is_header AND s.section IS NOT NULL THEN [{pseudo('header=', 's.section')}]
                   ELSE {words(clean('p.body'), fx.STOPS)} END AS toks
            FROM pieces p LEFT JOIN sections s
              ON p.is_header AND s.section = trim(upper(p.body), ': ')))"""),
    "token_counts": (("raw_tokens",), "SELECT token, kind, count(*) AS count FROM raw_tokens GROUP BY token, kind"),
    "corpus_size": (("token_counts",), "SELECT sum(count)::DOUBLE AS total FROM token_counts WHERE kind = 'token'"),
    "clean_tokens": (("raw_tokens", "token_counts", "corpus_size"), f"""
SELECT doc_id, pos, token, kind FROM (
  SELECT *, lag(token) OVER (PARTITION BY doc_id ORDER BY pos) AS previous FROM (
    SELECT r.*, c.count,
           r.kind = 'section' AND coalesce(lead(r.kind) OVER (PARTITION BY doc_id ORDER BY pos), 'section') = 'section'
             AS is_empty,
           least((sqrt(c.count / total / {fx.THRESHOLD}) + 1) * ({fx.THRESHOLD} / (c.count / total)), 1.0) AS keep_p
    FROM raw_tokens r JOIN token_counts c ON c.token = r.token AND c.kind = r.kind CROSS JOIN corpus_size)
  WHERE kind <> 'token' OR (count >= {fx.MIN_COUNT} AND {u('doc_id', 'pos', seed=0)} < keep_p))
WHERE (previous IS NULL OR previous <> token) AND NOT is_empty"""),
    "vocab": (("clean_tokens",), """
SELECT row_number() OVER (ORDER BY rank, d, p, token) - 1 AS id, token, support, kind FROM (
  SELECT 0 AS rank, 0 AS d, 0 AS p, '<pad>' AS token, 1 AS support, 'pad' AS kind
  UNION ALL
  SELECT 1, min(doc_id), arg_min(pos, (doc_id, pos)), token, count(*), kind
  FROM clean_tokens WHERE kind = 'token' GROUP BY token, kind
  UNION ALL
  SELECT DISTINCT CASE kind WHEN 'section' THEN 2 ELSE 3 END, 0, 0, token, 0, kind
  FROM clean_tokens WHERE kind <> 'token')"""),
    "ids": (("clean_tokens", "vocab"), """
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos,
       row_number() OVER (ORDER BY doc_id, pos) - 1 AS gpos, v.id, t.token, t.kind
FROM clean_tokens t JOIN vocab v ON v.token = t.token AND v.kind = t.kind"""),
    "filled": (("ids",), """
SELECT *, coalesce(last_value(CASE WHEN kind = 'section' THEN id END IGNORE NULLS)
                   OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 0) AS metadata_id FROM ids"""),
    "corpus_lines": ((), """
SELECT doc_id, i - 1 AS line_no,
       CASE WHEN (i - 1 + doc_id) % 5 = 4 OR (i - 1 + doc_id) % 11 >= 8 THEN ' ' ELSE line END AS line
FROM (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i
      FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""),
    "pair_counts": ((), f"""
SELECT pair, upper(substr(pair, 1, 1) || substr(string_split(pair, ' ')[2], 1, 1)) AS sf, count(*) AS n FROM (
  SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS pair
  FROM (SELECT regexp_split_to_array(lower(text), '{SP}+') AS w FROM documents))
WHERE regexp_full_match(pair, '[a-z]+ [a-z]+') GROUP BY pair HAVING count(*) >= 5"""),
    "senses": (("pair_counts",), """
SELECT sf, (rn - 1) % 5 AS lf_idx, string_agg(pair, ';' ORDER BY rn) AS lf, sum(n)::BIGINT AS n
FROM (SELECT *, row_number() OVER (PARTITION BY sf ORDER BY n DESC, pair) AS rn,
             count(*) OVER (PARTITION BY sf) AS pairs FROM pair_counts)
WHERE rn <= 10 AND pairs >= 2 GROUP BY sf, (rn - 1) % 5"""),
}


def define(name: str, needs: tuple[str, ...], body: str) -> None:
    CTE[name] = (needs, body)


def with_(body: str, *names: str) -> str:
    """``body`` behind a WITH clause holding the named fragments and what they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in CTE[name][0]:
            visit(need)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTE[n][1]})" for n in order) + "\n" + body
