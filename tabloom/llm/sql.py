"""SQL that gives the rows of the queries that SQL can express."""

from __future__ import annotations

from tabloom.llm import benchmark_scan as scan_for_items, mixing, quality, spelling

WORD = r"[^\x20\x09-\x0D]"


def quality_rules() -> str:
    """Words and lines as rows; the n-grams are windows over the words."""
    lengths = sorted({3, *quality.NGRAM_LIMITS})
    in_text = "PARTITION BY r ORDER BY i"
    grams = ", ".join(
        f"CASE WHEN i + {n - 1} <= n_words THEN string_agg(word, ' ') OVER ({in_text} ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) END AS g{n}" for n in lengths
    )
    flags = ", ".join(
        f"g{n} IS NOT NULL AND " + (f"count(*) OVER (PARTITION BY r, g{n}) > 1" if n == 3 else f"row_number() OVER (PARTITION BY r, g{n} ORDER BY i) > 1") + f" AS f{n}"
        for n in lengths
    )
    covered = ", ".join(f"max(f{n}::INTEGER) OVER ({in_text} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c{n}" for n in lengths)
    chars = ", ".join(f"sum(c{n} * len)::BIGINT AS chars_in_repeated_{n}" for n in quality.NGRAM_LIMITS)
    shown = ", ".join(f"coalesce(chars_in_repeated_{n}, 0) AS chars_in_repeated_{n}" for n in quality.NGRAM_LIMITS)
    fine = " AND ".join(f"chars_in_repeated_{n} <= {limit}e0 * word_chars" for n, limit in quality.NGRAM_LIMITS.items())
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
      ws AS (SELECT r, regexp_extract_all(t, '{WORD}+') AS ws FROM d),
      w AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n_words FROM ws),
      g AS (SELECT r, i, length(word) AS len, {grams} FROM w), f AS (SELECT r, i, len, {flags} FROM g), c AS (SELECT r, len, {covered} FROM f),
      per AS (SELECT r, count(*) AS n_words, sum(len)::BIGINT AS word_chars, sum(c3)::BIGINT AS n_repeat_words, {chars} FROM c GROUP BY 1),
      ls AS (SELECT r, string_split(t, chr(10)) AS ls FROM d),
      l AS (SELECT r, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM ls),
      again AS (SELECT r, line, row_number() OVER (PARTITION BY r, line ORDER BY i) > 1 AS dup FROM l WHERE regexp_matches(line, '{WORD}')),
      lines AS (SELECT r, count(*) FILTER (dup) AS n_dup_lines, coalesce(sum(length(line)) FILTER (dup), 0)::BIGINT AS dup_line_chars FROM again GROUP BY 1),
      m AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
          length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
          coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(dup_line_chars, 0) AS dup_line_chars, {shown}
        FROM d LEFT JOIN per USING (r) LEFT JOIN lines USING (r)),
      b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
      SELECT *, NOT base_failed AND dup_line_chars <= {quality.LINE_LIMIT}e0 * (word_chars + n_words) AND {fine} AS kept FROM b"""


def source_mix() -> str:
    order = "ORDER BY stop / weight, source NULLS LAST"
    return f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}+'))::BIGINT AS size FROM documents),
      p AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
      q AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, {mixing.LIMIT} * source_size::DOUBLE AS stop FROM p),
      l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(stop) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM q),
      m AS (SELECT level AS found FROM l WHERE level * weight <= stop {order} LIMIT 1),
      t AS (SELECT source, source_size, least(stop, found * weight) AS target FROM l, m),
      r AS (SELECT doc_id, size, source_size, target, coalesce(least(target / nullif(source_size, 0), {mixing.LIMIT}), 0) AS rate,
          ('0x' || substr(md5(concat_ws('-', doc_id::VARCHAR, '{mixing.SEED}')), 1, 13))::BIGINT / {float(1 << 52)} AS coin
        FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
      c AS (SELECT *, (floor(rate) + (coin < rate - floor(rate))::INTEGER)::BIGINT AS copies FROM r)
      SELECT doc_id, size, source_size, round(target, 6) AS target, copies * size AS taken, copies FROM c"""


def benchmark_scan() -> str:
    """Windows of documents that equal a window of an item, as strings of words."""
    fold = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    found = rf"regexp_extract_all({fold}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    n = scan_for_items.WINDOW
    return f"""WITH i AS (SELECT coalesce(item_id::VARCHAR, '') AS id, {found} AS ws FROM benchmark),
      k AS (SELECT id, ws, unnest(range(1, greatest(len(ws) - {n - 1}, 1) + 1)) AS k FROM i WHERE len(ws) > 0),
      p AS (SELECT DISTINCT id, least(len(ws), {n}) AS n, array_to_string(ws[k : k + {n - 1}], ' ') AS s FROM k),
      d AS (SELECT row_number() OVER () AS r, doc_id, {found} AS ws FROM documents),
      spots AS (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM p)),
      m AS (SELECT r, k, n, id FROM (SELECT r, k, n, array_to_string(ws[k : k + n - 1], ' ') AS s FROM spots) JOIN p USING (n, s)),
      w AS (SELECT DISTINCT r, unnest(range(k, k + n)) AS w FROM m), hits AS (SELECT r, count(*) AS n_hit FROM w GROUP BY 1),
      ids AS (SELECT r, count(DISTINCT id) AS n_items, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM m GROUP BY 1)
      SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
        sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
      FROM d LEFT JOIN hits USING (r) LEFT JOIN ids USING (r)"""


def crc32(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of a text expression."""
    table = "[" + ",".join(map(str, spelling._TABLE.tolist())) + "]::BIGINT[]"
    byte = f"('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::BIGINT"
    values = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda i: {byte})"
    return f"xor(list_reduce({values}, lambda s, b: xor(({table})[(xor(s, b) & 255) + 1], s >> 8), 4294967295::BIGINT), 4294967295)"


def spelling_variants() -> str:
    """Words without one code point bring near words together: at the same place, or a whole word with a longer one."""
    fold = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    key = "coalesce(doc_id::VARCHAR, '') || ':' || run"
    return f"""WITH r AS (SELECT doc_id, {fold.format("unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+'))")} AS run FROM documents),
      g AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= {spelling.LEAST_POINTS} GROUP BY 1, 2),
      h AS (SELECT run, n, {crc32(key)} AS h FROM g),
      l AS (SELECT CASE WHEN h % {spelling.LOSS} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
      w AS (SELECT word, sum(n)::BIGINT AS n FROM l WHERE length(word) >= {spelling.LEAST_POINTS} GROUP BY 1 HAVING sum(n) >= {spelling.LEAST_COUNT}),
      i AS (SELECT word, n, unnest(range(length(word))) AS i FROM w), s AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM i),
      p AS (SELECT a.word, b.word AS other FROM s a JOIN s b USING (i, rest) WHERE a.word <> b.word AND length(a.word) = length(b.word)
        UNION SELECT w.word, s.word FROM w JOIN s ON w.word = s.rest UNION SELECT s.word, w.word FROM w JOIN s ON w.word = s.rest),
      b AS (SELECT p.word, count(*) AS n_near, min((-o.n, p.other)) AS best FROM p JOIN w o ON o.word = p.other GROUP BY 1),
      f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 2 * w.n THEN best[2] END AS form, CASE WHEN -best[1] >= 2 * w.n THEN -best[1] END AS form_n
        FROM w LEFT JOIN b ON b.word = w.word),
      t AS (WITH RECURSIVE t AS (SELECT word, form AS root FROM f WHERE form IS NOT NULL UNION ALL SELECT t.word, f.form FROM t JOIN f ON f.word = t.root WHERE f.form IS NOT NULL) SELECT * FROM t),
      e AS (SELECT t.word, t.root FROM t JOIN f ON f.word = t.root WHERE f.form IS NULL)
      SELECT f.word, form, coalesce(e.root, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN e ON e.word = f.word"""


def conversation_trie() -> str:
    """Every beginning of every rebuilt conversation, named by the ids of its turns."""
    base = "conv_id - ((conv_id % 20) + 20) % 20"
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
      i AS (SELECT conv_id, turn, substr(sha256(octet_length(encode(role))::VARCHAR || ':' || role || text), 1, 32) AS id, len(regexp_extract_all(text, '{WORD}+')) AS w FROM t),
      o AS (SELECT conv_id, list({{'id': id, 'w': w}} ORDER BY turn NULLS FIRST, id) AS ts FROM i GROUP BY 1),
      h AS (SELECT conv_id, ts, {base} AS base, {crc32("conv_id::VARCHAR")} % 4 AS h FROM o),
      r AS (SELECT h.conv_id, list_concat(coalesce(b.ts, [])[1 : h.h], h.ts[h.h + 1 :]) AS ts FROM h LEFT JOIN o b ON b.conv_id = h.base),
      p AS (SELECT conv_id, ts, unnest(range(len(ts) + 1)) AS depth FROM r),
      m AS (SELECT conv_id, depth, depth = len(ts) AS ends, array_to_string([x.id FOR x IN ts[1 : depth]], '') AS path, CASE WHEN depth > 0 THEN ts[depth].w ELSE 0 END AS w FROM p),
      g AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
          coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ends FROM m GROUP BY 1, 2),
      c AS (SELECT substr(path, 1, 32 * (depth - 1)) AS path, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY 1),
      n AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN c USING (path)),
      a AS (SELECT n_convs, w, n_children, path, unnest(range(depth + 1)) AS e FROM n),
      s AS (SELECT substr(path, 1, 32 * e) AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * w)::BIGINT AS saved_tokens FROM a GROUP BY 1)
      SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, sha256(n.ends) AS ends_sha256
      FROM n JOIN s USING (path) LEFT JOIN n u ON n.depth > 0 AND u.path = substr(n.path, 1, 32 * (n.depth - 1))"""
