"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

from cargohold.llm import decontaminate, site_lines, spotsigs, url_filter

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_OP2 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))
                      WHEN len(w) = 1 THEN w ELSE [] END AS s FROM words
), one AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS i
  FROM one a JOIN one b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY ALL
), links AS (SELECT a, b FROM shared WHERE 100 * i >= 80 * (na + nb - i)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM ways UNION SELECT r.a, w.b FROM reach r JOIN ways w ON r.b = w.a),
least_of AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, len(s) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id,
       doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
FROM sets LEFT JOIN least_of ON doc_id = a
"""

_ANCHORS = "[" + ", ".join(_quoted(a) for a in spotsigs.ANCHORS) + "]"

_OP4 = rf"""
WITH own AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
follow AS (
  SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS nx FROM own
), three AS (
  SELECT *, substring(text, 1, length(text) - length(text) // 3) || substring(nx, 1, length(text) // 3) AS edited FROM follow
), roles AS (
  SELECT doc_id, 1 AS r, text AS t FROM three UNION ALL SELECT doc_id, 2, edited FROM three UNION ALL SELECT doc_id, 3, nx FROM three
), words AS (
  SELECT doc_id, r, list_filter(regexp_split_to_array(lower(t), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM roles
), parts AS (
  SELECT doc_id, r, w, list_filter(w, lambda x: NOT list_contains({_ANCHORS}, x)) AS c,
         list_filter(range(1, len(w) + 1), lambda i: list_contains({_ANCHORS}, w[i])) AS p FROM words
), chains AS (
  SELECT doc_id, r, w, list_filter(list_transform(range(0, len(p)), lambda j: CASE WHEN p[j + 1] - j + 1 <= len(c)
           THEN w[p[j + 1]] || ' ' || c[p[j + 1] - j] || ' ' || c[p[j + 1] - j + 1] END), lambda x: x IS NOT NULL) AS s FROM parts
), spots AS (
  SELECT doc_id, r, CASE WHEN len(s) > 0 THEN list_sort(list_distinct(list_transform(s, lambda x: substring(md5(x), 1, 12))))
                         ELSE [substring(md5(array_to_string(w, ' ')), 1, 12)] END AS f FROM chains
)
SELECT t.doc_id, length(t.text) AS n_chars, sha256(t.edited) AS edited_sha256,
       array_to_string(a.f, ' ') AS fingerprint, array_to_string(b.f, ' ') AS edited_fingerprint,
       len(list_intersect(a.f, b.f)) / (len(a.f) + len(b.f) - len(list_intersect(a.f, b.f)))::DOUBLE AS near_edited,
       len(list_intersect(a.f, c.f)) / (len(a.f) + len(c.f) - len(list_intersect(a.f, c.f)))::DOUBLE AS near_next
FROM three t JOIN spots a ON a.doc_id = t.doc_id AND a.r = 1 JOIN spots b ON b.doc_id = t.doc_id AND b.r = 2
JOIN spots c ON c.doc_id = t.doc_id AND c.r = 3
"""

_K = decontaminate.SHINGLE_WORDS
_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


def _shingles(w: str) -> str:
    return f"list_distinct(list_transform(range(1, len({w}) - {_K} + 2), lambda i: array_to_string({w}[i : i + {_K} - 1], ' ')))"


# Items of the benchmark tables have SHINGLE_WORDS words or more.
_OP5 = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
marks AS (SELECT item_id, len(w) AS n, unnest(range(1, len(w) - {_K} + 2)) AS q, w FROM items),
places AS (SELECT doc_id, unnest(range(1, len(w) - {_K} + 2)) AS p, w FROM docs),
hits AS (
  SELECT DISTINCT doc_id, item_id, n, p - q AS spot
  FROM (SELECT item_id, n, q, array_to_string(w[q : q + {_K} - 1], ' ') AS s FROM marks) m
  JOIN (SELECT doc_id, p, array_to_string(w[p : p + {_K} - 1], ' ') AS s FROM places) d ON m.s = d.s
), windows AS (
  SELECT DISTINCT doc_id, item_id, greatest(0, least(spot, len(d.w) - n)) AS start, n FROM hits JOIN docs d USING (doc_id)
), sets AS (
  SELECT x.doc_id, x.item_id, x.start, {_shingles("(d.w[x.start + 1 : x.start + x.n])")} AS a, {_shingles("i.w")} AS b
  FROM windows x JOIN docs d USING (doc_id) JOIN items i USING (item_id)
), scored AS (
  SELECT doc_id, item_id, start,
         list_sum(list_transform(list_intersect(a, b), lambda x: length(x)))
         / list_sum(list_transform(list_distinct(list_concat(a, b)), lambda x: length(x)))::DOUBLE AS similarity FROM sets
), best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS nth FROM scored WHERE similarity >= {decontaminate.SIMILARITY}
)
SELECT doc_id, item_id, start AS start_word, similarity FROM best WHERE nth = 1
"""


def _replaced(expression: str, pattern: str, by: str) -> str:
    return f"regexp_replace({expression}, {_quoted(pattern)}, {by}, 'g')"


def _op9() -> str:
    text = _replaced("coalesce(html, '')", r"[\x20\x09-\x0D]+", "' '")
    text = _replaced(_replaced(_replaced(text, site_lines._HIDDEN, "''"), site_lines._BREAK, "chr(10)"), site_lines._TAG, "''")
    for reference, char in site_lines._REFERENCES:
        text = f"replace({text}, {_quoted(reference)}, {_quoted(char)})"
    tidy = _replaced("x", r"[\x20\x09-\x0D]+", "' '")
    return f"""
WITH rows_of AS (
  SELECT page_id, row_number() OVER () AS r, translate(coalesce(regexp_extract(url, {_quoted(url_filter._PARTS)}, 1), ''), {_AZ}) AS host,
         list_filter(list_transform(string_split({text}, chr(10)), lambda x: trim({tidy})), lambda x: x <> '') AS lines FROM pages
), one AS (SELECT r, host, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM rows_of),
totals AS (SELECT host, count(*) AS pages FROM rows_of GROUP BY host),
gone AS (
  SELECT host, line FROM (SELECT host, line, count(DISTINCT r) AS n FROM one GROUP BY ALL) JOIN totals USING (host)
  WHERE n >= {site_lines.MIN_PAGES} AND n > {site_lines.RATIO} * pages
), kept AS (
  SELECT r, count(*) AS k, string_agg(line, chr(10) ORDER BY i) AS text FROM one ANTI JOIN gone USING (host, line) GROUP BY r
)
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - coalesce(k, 0))::BIGINT AS n_dropped, coalesce(text, '') AS text
FROM rows_of LEFT JOIN kept USING (r)
"""


def _op12(levels: int = 8) -> str:
    """Trees unrolled over `levels` levels, enough for 16 ** levels leaves of a source."""
    crc = (
        "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)), "
        "lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::BIGINT)"
    )
    field = lambda v: f"coalesce(strlen({v}::VARCHAR) || ':' || {v}::VARCHAR, '-')"
    leaf = lambda text: f"sha256({' || '.join(field(v) for v in ('doc_id', 'source', 'lang', 'n_chars', text))})"
    parts = [
        f"""rows_of AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS t, CASE WHEN {crc} % 5 = 0 THEN {leaf(f"translate(text, {_AZ})")} ELSE leaf END AS altered
  FROM (SELECT doc_id, source, lang, n_chars, text, {leaf("text")} AS leaf FROM documents)
)""",
        "n0 AS (SELECT doc_id, t, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k, leaf AS d, altered FROM rows_of)",
        "s0 AS (SELECT t, k, d FROM n0)",
    ]

    def tree(name: str, key: str) -> str:
        """CTEs of all levels of the trees in `name`0 (key, k, d); a tree with one node stays as it is. The last is its root."""
        for i in range(levels):
            parts.append(
                f"{name}{i + 1} AS (SELECT {key}, k // 16 AS k, CASE WHEN any_value(size) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY k)) END AS d "
                f"FROM (SELECT *, count(*) OVER (PARTITION BY {key}) AS size FROM {name}{i}) GROUP BY {key}, k // 16)"
            )
            parts.append(
                f"{name}p{i} AS (SELECT a.{key}, a.k, coalesce(string_agg(b.d, '' ORDER BY b.k) FILTER (b.k < a.k), '') AS l, coalesce(string_agg(b.d, '' ORDER BY b.k) FILTER (b.k > a.k), '') AS r "
                f"FROM {name}{i} a JOIN {name}{i} b ON a.{key} = b.{key} AND a.k // 16 = b.k // 16 GROUP BY a.{key}, a.k)"
            )
        return f"{name}{levels}"

    last = tree("s", "t")
    parts.append(f"u0 AS (SELECT 0 AS z, t AS k, d FROM {last})")
    root = tree("u", "z")
    ways, at, by = [], "n0 x", ""
    for name, key, node, size in (("s", "x.t", "x.k", "(SELECT count(*) FROM n0 y WHERE y.t = x.t)"), ("u", "0", "x.t", "(SELECT count(*) FROM u0)")):
        for i in range(levels):
            at += f" JOIN {name}p{i} ON {name}p{i}.{'t' if name == 's' else 'z'} = {key} AND {name}p{i}.k = {node} // {16**i}"
            ways.append((f"{name}p{i}.l", f"{name}p{i}.r", f"(({size} - 1) // {16**i}) > 0"))
    proof = " || ".join(f"{left} || {right}" for left, right, _ in ways)
    by = "altered"
    columns = []
    for i, (left, right, more) in enumerate(ways):
        columns.append(f"{left} AS l{i}, {right} AS r{i}, {more} AS m{i}")
    parts.append(f"way AS (SELECT x.doc_id, x.t, x.d AS leaf, x.altered, sha256({proof}) AS proof_sha256, {', '.join(columns)} FROM {at})")
    for i in range(len(ways)):
        parts.append(f"f{i} AS (SELECT *, CASE WHEN m{i} THEN sha256(l{i} || {by} || r{i}) ELSE {by} END AS a{i} FROM {'way' if i == 0 else f'f{i - 1}'})")
        by = f"a{i}"
    return f"""
WITH {", ".join(parts)}
SELECT doc_id, leaf, s.d AS subroot, u.d AS root, proof_sha256, {by} AS folded_root, {by} = u.d AS verified
FROM f{len(ways) - 1} f JOIN {last} s ON s.t = f.t JOIN {root} u ON true
"""


_OP13 = """
WITH rows_of AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM rows_of WINDOW w AS (PARTITION BY t)
"""


ORACLE_SQL: dict[str, str] = {
    "op2_minhash_hamming": _OP2,
    "op4_spotsigs": _OP4,
    "op5_simhash_windows": _OP5,
    "op9_site_lines": _op9(),
    "op12_octopus_manifest": _op12(),
    "op13_heavy_hitter_dedup": _OP13,
}
