"""The same results in SQL, for checking the registered queries with another engine."""

from __future__ import annotations

RESPONSES = """
pg AS (SELECT page_id, url, html, octet_length(encode(html)) AS n FROM pages),
resp AS (
  SELECT page_id,
    lpad(CAST(page_id AS VARCHAR), 16, '0') AS "ImageID",
    CASE page_id % 10 WHEN 0 THEN 'validation' WHEN 1 THEN 'test' ELSE 'train' END AS "Subset",
    url AS "OriginalURL", '' AS "OriginalLandingURL",
    'https://creativecommons.org/licenses/by/2.0/' AS "License", '' AS "AuthorProfileURL",
    'author "' || page_id || '", and others' AS "Author",
    regexp_extract(html, '<title>([^<]*)</title>', 1) AS "Title",
    CAST(n AS VARCHAR) AS "OriginalSize",
    to_base64(unhex(md5(CASE WHEN page_id % 17 = 0 THEN html || 'x' ELSE html END))) AS "OriginalMD5",
    CASE WHEN page_id % 3 = 0 THEN '' ELSE 'https://thumb.example.com/' || lpad(CAST(page_id AS VARCHAR), 6, '0') || '_z.jpg' END
      AS "Thumbnail300KURL",
    CASE page_id % 12 WHEN 7 THEN 302 WHEN 8 THEN 404 WHEN 9 THEN 204 WHEN 10 THEN NULL ELSE 200 END AS status,
    CASE WHEN page_id % 12 = 10 THEN 'connection reset' END AS transport_error,
    CASE WHEN page_id % 12 = 6 THEN 'text/html' ELSE 'image/jpeg' END AS content_type,
    CASE page_id % 12 WHEN 5 THEN NULL WHEN 4 THEN n + 1 ELSE n END AS content_length,
    html, n, html AS body
  FROM pg)
"""

LIST_COLUMNS = (
    '"ImageID", "Subset", "OriginalURL", "OriginalLandingURL", "License", "AuthorProfileURL", '
    '"Author", "Title", "OriginalSize", "OriginalMD5", "Thumbnail300KURL"'
)


def _named(url: str) -> str:
    path = f"regexp_extract({url}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    return f"regexp_extract({path}, '([^/]+)/*$', 1)"


def _paths(url: str = '"OriginalURL"') -> str:
    return f"""
named AS (SELECT *, {url} AS url, {_named(url)} AS file_name FROM resp),
params AS (
  SELECT *, CASE WHEN length(file_name) >= 3 THEN substr(file_name, 1, 3) END AS shard,
    CASE WHEN length(file_name) >= 3 THEN '/store/assets/' || "Subset" || '/images-original/'
      || substr(file_name, 1, 3) || '/' || file_name END AS dest_path
  FROM named)
"""


SMALL_URL = 'CASE WHEN length("Thumbnail300KURL") > 0 THEN "Thumbnail300KURL" ELSE "OriginalURL" END'

CODED = """
coded AS (
  SELECT *, CASE
      WHEN dest_path IS NULL THEN 'BadPath'
      WHEN transport_error IS NOT NULL OR status IS NULL THEN 'RequestError'
      WHEN status = 200 AND content_type <> 'image/jpeg' THEN 'ContentTypeNotJpeg'
      WHEN status = 200 AND content_length IS NULL THEN 'NoContentLength'
      WHEN status = 200 AND content_length <> n THEN 'InvalidSize'
      WHEN status BETWEEN 300 AND 399 THEN 'Redirect'
      WHEN status <> 200 THEN 'RequestFailed'
      WHEN page_id % 17 = 0 THEN 'MD5SumMismatch'
    END AS failure_code
  FROM params),
classified AS (
  SELECT *, CASE failure_code
      WHEN 'BadPath' THEN 'no usable file name in url: ' || url
      WHEN 'RequestError' THEN 'request to ' || url || ' failed: ' || coalesce(transport_error, 'no response')
      WHEN 'ContentTypeNotJpeg' THEN url
      WHEN 'NoContentLength' THEN url
      WHEN 'InvalidSize' THEN url || ': server size (' || content_length || ') doesn''t match expected size (' || n || ')!'
      WHEN 'Redirect' THEN 'photo is unavailable: ' || url
      WHEN 'RequestFailed' THEN 'http request to ' || url || ' failed: ' || CASE WHEN n <= 1048576 THEN html ELSE '' END
      WHEN 'MD5SumMismatch' THEN 'md5 sum mismatch'
    END AS failure_details
  FROM coded)
"""

OUTCOMES = f"WITH {RESPONSES}, {_paths()}, {CODED}"


def _digest(function: str) -> str:
    return f"SELECT doc_id, {function}(text) AS digest FROM documents"


def _pieces(keys: str, source: str, n: int) -> str:
    """Cut blobs `b` of a source into pieces of `n` bytes."""
    return f"""
WITH src AS ({source}),
cut AS (
  SELECT {keys}, i AS chunk_id, b[i * {n} + 1 : least((i + 1) * {n}, octet_length(b))] AS p
  FROM (SELECT {keys}, b, unnest(range(CAST(ceil(octet_length(b) / {n}.0) AS BIGINT))) AS i FROM src))
SELECT {keys}, chunk_id, octet_length(p) AS n_bytes, md5(p) AS piece_md5 FROM cut
"""


def _placed_pieces(key: str, order: str, source: str, n: int) -> str:
    """The same for few long sequences: rows are cut by their offsets, no sequence is assembled."""
    return f"""
WITH placed AS (
  SELECT {key}, encode(text) AS b, octet_length(encode(text)) AS len,
    sum(octet_length(encode(text))) OVER (PARTITION BY {key} ORDER BY {order}) - octet_length(encode(text)) AS off
  FROM {source}),
parts AS (
  SELECT {key}, b, len, CAST(off AS BIGINT) AS off,
    unnest(range(CAST(off // {n} AS BIGINT), CAST((off + len - 1) // {n} + 1 AS BIGINT))) AS i FROM placed WHERE len > 0),
cut AS (
  SELECT {key}, i, off, hex(b[greatest(i * {n} - off, 0) + 1 : least((i + 1) * {n} - off, len)]) AS p FROM parts),
pieces AS (SELECT {key}, i AS chunk_id, unhex(string_agg(p, '' ORDER BY off)) AS p FROM cut GROUP BY {key}, i)
SELECT {key}, chunk_id, octet_length(p) AS n_bytes, md5(p) AS piece_md5 FROM pieces
"""


def _resize_plan(mode: str) -> str:
    scale = {"ShrinkToFit": "least(1.0, 224.0 / w, 224.0 / h)", "FillCrop": "greatest(224.0 / w, 224.0 / h)"}
    sized = "SELECT page_id, 64 + page_id * 37 % 1800 AS w, 64 + page_id * 53 % 1300 AS h FROM pages"
    if mode == "FillDistort":
        return f"""SELECT page_id, w, h, CAST(224 AS BIGINT) AS scaled_w, CAST(224 AS BIGINT) AS scaled_h,
          CAST(0 AS BIGINT) AS crop_x, CAST(0 AS BIGINT) AS crop_y,
          CAST(224 AS BIGINT) AS out_w, CAST(224 AS BIGINT) AS out_h FROM ({sized})"""
    size = "CAST(greatest(1, floor({0} * s + 0.5)) AS BIGINT) AS scaled_{0}"
    tail = {
        "ShrinkToFit": "CAST(0 AS BIGINT) AS crop_x, CAST(0 AS BIGINT) AS crop_y, scaled_w AS out_w, scaled_h AS out_h",
        "FillCrop": "(scaled_w - 224) // 2 AS crop_x, (scaled_h - 224) // 2 AS crop_y, "
        "CAST(224 AS BIGINT) AS out_w, CAST(224 AS BIGINT) AS out_h",
    }
    real = scale[mode].replace("w", "CAST(w AS DOUBLE)").replace("/ h", "/ CAST(h AS DOUBLE)")
    return f"""
WITH sized AS ({sized}), scaled AS (SELECT *, {real} AS s FROM sized),
sizes AS (SELECT page_id, w, h, {size.format("w")}, {size.format("h")} FROM scaled)
SELECT page_id, w, h, scaled_w, scaled_h, {tail[mode]} FROM sizes
"""


def _resized_images(mode: str) -> str:
    scale = {"ShrinkToFit": "least(1.0, 64.0 / CAST(w AS DOUBLE), 64.0 / CAST(h AS DOUBLE))"}
    size = "CAST(greatest(1, floor({0} * s + 0.5)) AS INTEGER)" if mode == "ShrinkToFit" else "64"
    return f"""
WITH sized AS (
  SELECT page_id, 16 + page_id * 37 % 300 AS w, 16 + page_id * 53 % 260 AS h, octet_length(encode(html)) % 256 AS v FROM pages),
scaled AS (SELECT *, {scale.get(mode, "1.0")} AS s FROM sized),
final AS (SELECT page_id, v, {size.format("w")} AS ow, {size.format("h")} AS oh FROM scaled)
SELECT page_id, CAST(ow AS BIGINT) AS width, CAST(oh AS BIGINT) AS height,
  md5(unhex(repeat(printf('%02x', v), ow * oh))) AS pixel_md5 FROM final
"""


UNIQUE_EVENTS = """
SELECT event_id, ts, user_id, event_type FROM (
  SELECT *, row_number() OVER w AS rn, lag(event_type) OVER w AS before FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
WHERE rn = 1 OR before IS DISTINCT FROM event_type
"""

UNIQUE_TYPED = """
WITH e AS (SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 11 <> 0 THEN floor(value / 40) END AS level FROM events)
SELECT event_id, ts, user_id, event_type, level FROM (
  SELECT *, row_number() OVER w AS rn, lag(event_type) OVER w AS b1, lag(level) OVER w AS b2 FROM e
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
WHERE rn = 1 OR b1 IS DISTINCT FROM event_type OR b2 IS DISTINCT FROM level
"""

GROUPED_TURNS = """
grouped AS (
  SELECT conv_id, turn, role, text, rn,
    CAST(sum(CASE WHEN rn > 1 AND role = 'user' THEN 1 ELSE 0 END)
      OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS group_id
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations))
"""

DOC_MD5 = "md5(CASE WHEN doc_id % 17 = 0 THEN text || 'x' ELSE text END)"


def oracle_sql() -> dict[str, str]:
    sql = {
        "outcome_counts": f"""{OUTCOMES}
            SELECT "Subset", coalesce(failure_code, 'Success') AS outcome, count(*) AS n_rows FROM classified GROUP BY ALL""",
        "dest_paths": f'WITH {RESPONSES}, {_paths()} SELECT "ImageID", url, file_name, shard, dest_path FROM params',
        "resized_paths": f"""WITH {RESPONSES}, {_paths()}
            SELECT "ImageID", CASE WHEN dest_path IS NOT NULL THEN '/store/assets/' || "Subset" || '/images-resized/' || shard
              || '/' || CASE WHEN suffix(file_name, '.jpg') THEN left(file_name, length(file_name) - 4) ELSE file_name END
              || '.png' END AS resized_path FROM params""",
        "choose_url": f'WITH {RESPONSES}, {_paths(SMALL_URL)} SELECT "ImageID", url, dest_path FROM params',
        "classify_responses": f'{OUTCOMES} SELECT "ImageID", failure_code, failure_details FROM classified',
        "classify_small_images": f"""WITH {RESPONSES}, {_paths(SMALL_URL)}
            SELECT "Subset", CASE
                WHEN dest_path IS NULL THEN 'BadPath'
                WHEN transport_error IS NOT NULL OR status IS NULL THEN 'RequestError'
                WHEN status = 200 AND content_type <> 'image/jpeg' THEN 'ContentTypeNotJpeg'
                WHEN status = 200 AND content_length IS NULL THEN 'NoContentLength'
                WHEN status BETWEEN 300 AND 399 THEN 'Redirect'
                WHEN status <> 200 THEN 'RequestFailed'
                ELSE 'Success' END AS outcome, count(*) AS n_rows
            FROM params GROUP BY ALL""",
        "success_table": f"{OUTCOMES} SELECT {LIST_COLUMNS} FROM classified WHERE failure_code IS NULL",
        "failure_table": f"""{OUTCOMES} SELECT {LIST_COLUMNS}, failure_details AS "FailureDetails"
            FROM classified WHERE failure_code IS NOT NULL""",
        "result_lines": f"""{OUTCOMES}
            SELECT "ImageID", concat_ws(',', "ImageID", "Subset", "OriginalURL", "OriginalLandingURL", "License",
              "AuthorProfileURL", '"' || replace("Author", '"', '""') || '"', '"' || replace("Title", '"', '""') || '"',
              "OriginalSize", "OriginalMD5", "Thumbnail300KURL",
              CASE WHEN failure_code IS NOT NULL THEN '"' || replace(failure_details, '"', '""') || '"' END) AS line
            FROM classified""",
        "replayed_responses": f"""WITH {RESPONSES}
            SELECT "ImageID", CAST(CASE WHEN status = 204 THEN NULL ELSE status END AS INTEGER) AS status,
              CASE WHEN status = 204 THEN 'no response recorded' ELSE transport_error END AS transport_error,
              CASE WHEN status = 204 OR status IS NULL THEN 'RequestError'
                WHEN status = 200 AND content_type <> 'image/jpeg' THEN 'ContentTypeNotJpeg'
                WHEN status = 200 AND content_length IS NULL THEN 'NoContentLength'
                WHEN status BETWEEN 300 AND 399 THEN 'Redirect'
                WHEN status <> 200 THEN 'RequestFailed' END AS failure_code
            FROM resp""",
        "redirect_targets": f"""WITH {RESPONSES}
            SELECT "ImageID", coalesce(status BETWEEN 300 AND 399 AND n % 3 <> 2, false) AS unavailable FROM resp""",
        "count_by_subset": "SELECT lang, count(*) AS n_rows FROM documents GROUP BY lang",
        "host_count": "SELECT count(DISTINCT regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS n_hosts FROM pages",
        "payload_bytes": """SELECT lang, source, CAST(sum(octet_length(encode(text))) AS BIGINT) AS n_bytes
            FROM documents GROUP BY lang, source""",
        "entry_size_errors": """
            SELECT conv_id, entry_size, n_bytes, 'expected ' || entry_size || ' bytes, got ' || n_bytes AS error FROM (
              SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS entry_size,
                CAST(sum(octet_length(encode(text))) AS BIGINT) AS n_bytes FROM conversations GROUP BY conv_id)
            WHERE entry_size <> n_bytes""",
        "parent_dirs": "SELECT DISTINCT lang || '/' || source AS dir FROM documents",
        "parent_dirs_in_order": """
            SELECT doc_id, dir FROM (
              SELECT doc_id, lang || '/' || source AS dir, lag(lang || '/' || source) OVER (ORDER BY doc_id) AS before
              FROM documents)
            WHERE before IS NULL OR before <> dir""",
        "payload_md5": _digest("md5"),
        "payload_sha1": _digest("sha1"),
        "payload_sha256": _digest("sha256"),
        "digest_encodings": """SELECT doc_id, to_base64(unhex(md5(text))) AS b64, md5(text) AS digest,
            lower(hex(unhex(md5(text)))) AS again FROM documents""",
        "digest_chunks": """SELECT conv_id, md5(string_agg(text, '' ORDER BY turn)) AS digest,
            CAST(sum(octet_length(encode(text))) AS BIGINT) AS n_bytes FROM conversations GROUP BY conv_id""",
        "digest_sources": """SELECT source, doc_id, sha256(text) AS digest,
            CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes FROM documents WHERE text <> ''""",
        "plan_fetch": f"""
            WITH w AS (SELECT *, lang || '/' || doc_id AS dest_path, octet_length(encode(text)) AS length,
                doc_id IN (SELECT doc_id FROM labels) AS held FROM documents),
            r AS (SELECT doc_id, dest_path, CASE WHEN NOT held THEN 'missing' WHEN length <> n_chars THEN 'size'
                WHEN md5(text) <> {DOC_MD5} THEN 'md5' ELSE 'valid' END AS reason FROM w)
            SELECT doc_id, dest_path, reason <> 'valid' AS need_fetch, reason FROM r""",
        "verify_artifacts": f"""
            SELECT CAST(doc_id AS VARCHAR) AS name, n_chars AS size, {DOC_MD5} AS md5_hex,
              CASE WHEN lang = 'fr' THEN 'missing' WHEN octet_length(encode(text)) <> n_chars THEN 'size_mismatch'
                WHEN doc_id % 17 = 0 THEN 'md5_mismatch' ELSE 'ok' END AS state FROM documents""",
        "resize_needed": """SELECT doc_id, '/r/' || doc_id AS resized_path FROM documents
            WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality > 0)""",
        "resume_rows": "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
        "join_results": """
            SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, quality, md5(text) AS digest,
              coalesce(CASE WHEN toxic = 1 THEN 'refused' END, CASE WHEN lang = 'de' THEN 'unread' END) AS error
            FROM labels l FULL JOIN documents d ON l.doc_id = d.doc_id""",
        "quarantine": f"""{OUTCOMES} SELECT dest_path AS to_delete, failure_code FROM classified
            WHERE failure_code = 'MD5SumMismatch'""",
        "unique_consecutive": UNIQUE_EVENTS,
        "stream_unique_consecutive": UNIQUE_EVENTS,
        "stream_unique_typed": UNIQUE_TYPED,
        "sliding_pairs": """
            SELECT user_id, window_start, a, b FROM (
              SELECT user_id, row_number() OVER w - 1 AS window_start, event_type AS a, lead(event_type) OVER w AS b,
                count(*) OVER (PARTITION BY user_id) AS n
              FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
            WHERE window_start + 2 <= n OR n = 1""",
        "sliding_triples": """
            SELECT user_id, window_start, a, b, c FROM (
              SELECT user_id, row_number() OVER w - 1 AS window_start, event_id AS a, lead(event_id) OVER w AS b,
                lead(event_id, 2) OVER w AS c, count(*) OVER (PARTITION BY user_id) AS n
              FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
            WHERE window_start % 2 = 0 AND (window_start = 0 OR window_start + 1 < n)""",
        "rechunk_documents": _pieces("doc_id", "SELECT doc_id, encode(text) AS b FROM documents", 512),
        "rechunk_conversations": _pieces(
            "conv_id",
            "SELECT conv_id, encode(string_agg(text, '' ORDER BY turn)) AS b FROM conversations GROUP BY conv_id",
            64,
        ),
        "rechunk_sources": _pieces(
            "source",
            "SELECT source, encode(string_agg(text, '' ORDER BY doc_id)) AS b FROM documents GROUP BY source",
            8192,
        ),
        "split_when": f"""WITH {GROUPED_TURNS}
            SELECT conv_id, turn, role, group_id, (rn = 1 OR role = 'user') AS is_first FROM grouped""",
        "split_group_heads": f"""WITH {GROUPED_TURNS}
            SELECT conv_id, group_id, arg_min(text, turn) AS head, count(*) AS n_rows FROM grouped GROUP BY ALL""",
        "capped_concat": """
            WITH sized AS (SELECT conv_id, turn, text, octet_length(encode(text)) AS n,
                sum(octet_length(encode(text))) OVER (PARTITION BY conv_id ORDER BY turn) AS total,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations)
            SELECT conv_id, md5(string_agg(text, '' ORDER BY turn)) AS digest, CAST(sum(n) AS BIGINT) AS n_bytes
            FROM sized WHERE total <= 2000 OR rn = 1 GROUP BY conv_id""",
        "head_per_group": """SELECT conv_id, turn, role, text FROM conversations
            QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 2""",
        "switch_source": """SELECT conv_id, turn, role, CASE WHEN turn < 2 THEN text ELSE 'copy: ' || text END AS text
            FROM conversations""",
        "switch_source_by_key": """
            WITH p AS (SELECT conv_id, min(turn) AS point FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
            SELECT c.conv_id, turn, role, CASE WHEN point IS NULL OR turn < point THEN text ELSE 'copy: ' || text END AS text
            FROM conversations c LEFT JOIN p ON c.conv_id = p.conv_id""",
        "ordered_concat": """SELECT doc_id AS id, md5(text) AS digest, 0 AS source_ord FROM documents
            UNION ALL SELECT item_id, md5(text), 1 FROM benchmark""",
        "if_then_else": """SELECT doc_id, CASE WHEN lang <> 'de' AND n_chars > 1000 THEN 'long' ELSE 'short' END AS branch,
            CASE WHEN lang <> 'de' AND n_chars > 1000 THEN md5(text) ELSE source END AS value FROM documents""",
        "tee_outputs": f"""{OUTCOMES} SELECT "ImageID", "Subset", CASE WHEN failure_code IS NULL THEN 'good' ELSE 'bad' END
            AS output FROM classified""",
        "sliced_unique_consecutive": """
            SELECT event_id, ts, user_id, event_type FROM (
              SELECT *, lag(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS before FROM events)
            WHERE before IS DISTINCT FROM user_id""",
        "sliced_sliding_pairs": """
            SELECT event_type, window_start, a, b FROM (
              SELECT event_type, row_number() OVER w - 1 AS window_start, user_id AS a, lead(user_id) OVER w AS b,
                count(*) OVER (PARTITION BY event_type) AS n
              FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))
            WHERE window_start + 2 <= n OR n = 1""",
        "sliced_rechunk": _placed_pieces("lang", "doc_id", "documents", 8192),
        "sliced_split_when": """
            WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events)
            SELECT event_id, ts, event_type, value,
              CAST(sum(CASE WHEN rn > 1 AND value > 20 THEN 1 ELSE 0 END)
                OVER (PARTITION BY event_type ORDER BY rn) AS BIGINT) AS group_id,
              (rn = 1 OR value > 20) AS is_first FROM r""",
        "sliced_capped_concat": """
            WITH sized AS (SELECT lang, doc_id, text, octet_length(encode(text)) AS n,
                sum(octet_length(encode(text))) OVER (PARTITION BY lang ORDER BY doc_id) AS total,
                row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents)
            SELECT lang, md5(string_agg(text, '' ORDER BY doc_id)) AS digest, CAST(sum(n) AS BIGINT) AS n_bytes
            FROM sized WHERE total <= 1048576 OR rn = 1 GROUP BY lang""",
        "sliced_digest": """SELECT doc_id, md5(text) AS digest,
            CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes FROM documents WHERE text <> ''""",
        "sliced_global_order": """
            SELECT event_id, ts, event_type FROM (
              SELECT *, lag(event_type) OVER (ORDER BY ts, event_id) AS before FROM events)
            WHERE before IS DISTINCT FROM event_type""",
        "csv_split_roundtrip": """SELECT CAST(doc_id AS VARCHAR) AS "ImageID",
            CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS "Subset",
            source AS "Author", text AS "Title" FROM documents""",
        "csv_quote": """SELECT doc_id, '"' || replace(text, '"', '""') || '"' AS quoted FROM documents""",
        "csv_roundtrip": """SELECT CAST(doc_id AS VARCHAR) AS "ImageID",
            CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS "Subset",
            source AS "Author", text AS "Title", CASE WHEN lang = 'en' THEN 'failure' ELSE 'success' END AS outcome
            FROM documents""",
        "repaired_headers": """SELECT CAST(doc_id AS VARCHAR) AS "ImageID",
            CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS "Subset",
            source AS "Author", text AS "Title" FROM documents""",
        "header_audit": """SELECT CASE WHEN lang = 'en' THEN 'failure' ELSE 'success' END AS outcome,
            bool_and(lang <> 'en') AS all_ok, bool_or(lang <> 'en') AS any_ok FROM documents GROUP BY 1""",
        "tar_entries": """SELECT doc_id, lang || '/' || source || '/' || doc_id || '.txt' AS entry_name,
            octet_length(encode(text)) AS entry_size, md5(text) AS digest FROM documents""",
        "tar_source_filtered": """SELECT doc_id, lang || '/' || source || '/' || doc_id || '.txt' AS entry_name,
            octet_length(encode(text)) AS entry_size, md5(text) AS digest FROM documents
            WHERE lang = 'en' AND octet_length(encode(text)) BETWEEN 500 AND 3000""",
        "stream_tar_entries": """SELECT doc_id, lang || '/' || source || '/' || doc_id || '.txt' AS entry_name,
            octet_length(encode(text)) AS entry_size, md5(text) AS digest FROM documents""",
        "tar_chunks": """
            WITH src AS (SELECT doc_id, encode(text) AS b FROM documents),
            cut AS (SELECT doc_id, i, octet_length(b) AS n, b[i * 512 + 1 : least((i + 1) * 512, octet_length(b))] AS p
              FROM (SELECT doc_id, b, unnest(range(greatest(1, CAST(ceil(octet_length(b) / 512.0) AS BIGINT)))) AS i FROM src))
            SELECT doc_id, i AS chunk_pos, octet_length(p) AS n_bytes, md5(p) AS piece_md5, i = 0 AS "first",
              (i + 1) * 512 >= n AS "last" FROM cut""",
        "tar_extract": "SELECT doc_id, octet_length(encode(text)) AS bytes_written, md5(text) AS digest FROM documents",
        "store_changes": """
            WITH d AS (SELECT doc_id, lang || '/' || doc_id AS dest_path, n_chars, octet_length(encode(text)) AS n,
                CASE WHEN doc_id % 7 = 0 THEN false ELSE doc_id % 7 = 1 OR doc_id % 3 <> 0 OR doc_id % 2 = 0 END AS held FROM documents),
            r AS (SELECT doc_id, dest_path, CASE WHEN NOT held THEN 'missing'
                WHEN n_chars <> n - CASE WHEN doc_id % 7 = 1 THEN 1 ELSE 0 END THEN 'size'
                WHEN doc_id % 17 = 0 THEN 'md5' ELSE 'valid' END AS reason FROM d)
            SELECT doc_id, dest_path, reason <> 'valid' AS need_fetch, reason FROM r""",
        "packed_store": """
            WITH d AS (SELECT doc_id, lang || '/' || source || '/' || doc_id || '.txt' AS path,
                CASE WHEN doc_id % 2 = 0 THEN text || '!' ELSE text END AS t FROM documents WHERE doc_id % 5 <> 0)
            SELECT doc_id, path, octet_length(encode(t)) AS length, md5(t) AS digest, CAST(NULL AS VARCHAR) AS error FROM d""",
        "gunzip_payloads": "SELECT doc_id, md5(text) AS digest, CAST(NULL AS VARCHAR) AS error FROM documents",
        "gunzip_members": """SELECT doc_id, octet_length(encode(text)) AS n_bytes, md5(text) AS digest,
            CAST(NULL AS VARCHAR) AS error FROM documents""",
        "cached_documents": _digest("md5"),
        "image_lists_from_archives": f"WITH {RESPONSES} SELECT {LIST_COLUMNS} FROM resp",
        "fetch_payloads": f"""WITH {RESPONSES}
            SELECT "ImageID", CASE WHEN page_id % 7 = 3 THEN 404 ELSE 200 END AS status,
              CASE WHEN page_id % 7 <> 3 THEN n END AS content_length,
              CASE WHEN page_id % 7 <> 3 THEN md5(html) END AS digest, 1 AS attempts FROM resp""",
        "fetch_scheduled": f"""WITH {RESPONSES}
            SELECT "ImageID", CASE WHEN page_id % 7 = 3 THEN 404 ELSE 200 END AS status,
              CASE WHEN page_id % 7 <> 3 THEN n END AS content_length,
              CASE WHEN page_id % 7 <> 3 THEN md5(html) END AS digest, 1 AS attempts FROM resp""",
        "fetch_ledger": """
            WITH p AS (SELECT page_id, url, ('0x' || substr(md5(url), 1, 2))::INT % 4 AS fails FROM pages)
            SELECT page_id, CASE WHEN fails < 3 THEN 200 END AS status, least(fails + 1, 3) AS attempts,
              CASE WHEN fails = 3 THEN 'TransportError: connection reset' END AS transport_error, true AS closed,
              CASE WHEN fails < 3 THEN md5(url) END AS digest FROM p""",
        "ingest_assets": f"""
            WITH {RESPONSES},
            j AS (SELECT *, 'https://assets.example.com/' || lpad(CAST(page_id AS VARCHAR), 6, '0') || '.jpg' AS url,
                CASE WHEN page_id % 7 = 3 THEN 'RequestFailed' WHEN page_id % 11 = 0 THEN 'InvalidSize'
                  WHEN page_id % 17 = 0 THEN 'MD5SumMismatch' END AS failure_code FROM resp)
            SELECT "ImageID", "Subset", failure_code IS NOT NULL AS need_fetch,
              CASE WHEN failure_code IS NULL THEN 'valid' ELSE 'missing' END AS reason,
              CASE WHEN failure_code IS NULL THEN n ELSE 0 END AS bytes_written, failure_code,
              CASE failure_code WHEN 'RequestFailed' THEN 'http request to ' || url || ' failed: '
                WHEN 'InvalidSize' THEN url || ': server size (' || n || ') doesn''t match expected size (' || n || '0)!'
                WHEN 'MD5SumMismatch' THEN 'md5 sum mismatch' END AS failure_details
            FROM j""",
        "ingest_packed": f"""
            WITH {RESPONSES},
            j AS (SELECT *, CASE WHEN page_id % 7 = 3 THEN 'RequestFailed' WHEN page_id % 11 = 0 THEN 'InvalidSize'
                  WHEN page_id % 17 = 0 THEN 'MD5SumMismatch' END AS failure_code FROM resp)
            SELECT "ImageID", failure_code IS NOT NULL AS need_fetch,
              CASE WHEN failure_code IS NULL THEN 'valid' ELSE 'missing' END AS reason,
              CASE WHEN failure_code IS NULL THEN n ELSE 0 END AS bytes_written, failure_code,
              CASE WHEN failure_code IS NULL THEN md5(html) END AS digest FROM j""",
        "ingest_resumed": f"""
            WITH {RESPONSES},
            j AS (SELECT *, 'https://assets.example.com/' || lpad(CAST(page_id AS VARCHAR), 6, '0') || '.jpg' AS url,
                CASE WHEN page_id % 7 = 3 THEN 'RequestFailed' WHEN page_id % 11 = 0 THEN 'InvalidSize'
                  WHEN page_id % 17 = 0 THEN 'MD5SumMismatch' END AS failure_code FROM resp)
            SELECT "ImageID", "Subset", true AS need_fetch,
              'missing' AS reason,
              CASE WHEN failure_code IS NULL THEN n ELSE 0 END AS bytes_written, failure_code,
              CASE failure_code WHEN 'RequestFailed' THEN 'http request to ' || url || ' failed: '
                WHEN 'InvalidSize' THEN url || ': server size (' || n || ') doesn''t match expected size (' || n || '0)!'
                WHEN 'MD5SumMismatch' THEN 'md5 sum mismatch' END AS failure_details
            FROM j""",
        "ingest_resized": f"""
            WITH {RESPONSES},
            j AS (SELECT *, CASE WHEN page_id % 7 = 3 THEN 'RequestFailed' WHEN page_id % 11 = 0 THEN 'InvalidSize'
                  WHEN page_id % 17 = 0 THEN 'MD5SumMismatch' END AS failure_code FROM resp)
            SELECT "ImageID", failure_code, CASE WHEN failure_code IS NULL THEN md5(CAST(n AS VARCHAR)) END AS resized_md5 FROM j""",
        "refused_inputs": f"""
            WITH {RESPONSES}
            SELECT "ImageID",
              CASE page_id % 4 WHEN 1 THEN 'BadSize' WHEN 2 THEN 'BadChecksumField' WHEN 3 THEN 'ImageUnknown' END AS failure_code,
              CASE page_id % 4 WHEN 1 THEN 'size is not a number: many' WHEN 2 THEN 'checksum is not Base64: ?'
                WHEN 3 THEN 'body of ' || (n + 1) || ' bytes is over the limit of ' || n END AS failure_details
            FROM resp""",
        "gunzip_damaged": """SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN md5(text) END AS digest,
            doc_id % 4 = 0 AS failed FROM documents""",
        "pipe_upper": """SELECT doc_id, md5(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')) AS digest,
            0 AS exit_code, CAST(NULL AS VARCHAR) AS stderr FROM documents""",
        "resize_plan_shrink": _resize_plan("ShrinkToFit"),
        "resize_plan_crop": _resize_plan("FillCrop"),
        "resize_plan_distort": _resize_plan("FillDistort"),
        "resize_images_shrink": _resized_images("ShrinkToFit"),
        "resize_images_crop": _resized_images("FillCrop"),
        "resize_images_distort": _resized_images("FillDistort"),
        "stream_outcomes": f"""{OUTCOMES} SELECT "ImageID", "Subset",
            CASE WHEN failure_code IS NULL THEN 'kept: ' ELSE '' END || "License" AS "License",
            CASE WHEN failure_code IS NULL THEN 'success' ELSE 'failure' END AS outcome FROM classified""",
    }
    return sql
