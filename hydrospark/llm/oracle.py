"""DuckDB SQL of the queries that SQL can express, by the plain definition and not by the operators' methods."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LETTER_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWERED)} AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END)) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) m USING (doc_id)"""

OP5 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_LETTER_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_LETTER_WORDS} AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2),
        lambda k: array_to_string(w[k:k + least(10, len(w)) - 1], ' '))) AS g FROM i WHERE len(w) > 0),
p AS (SELECT rid, size, w, unnest(range(1, len(w) - size + 2)) AS k FROM d, (SELECT DISTINCT size FROM v) WHERE len(w) >= size),
h AS (SELECT rid, k, p.size, item_id FROM p JOIN v ON v.size = p.size AND v.g = array_to_string(w[k:k + p.size - 1], ' ')),
t AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(k, k + size)) AS pos FROM (SELECT DISTINCT rid, k, size FROM h)) GROUP BY 1),
m AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN t USING (rid) LEFT JOIN m USING (rid)"""

OP8 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT rid, doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13),
g AS (SELECT rid, doc_id, k, array_to_string(w[k:k + 12], ' ') AS g FROM p),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY 1),
x AS (SELECT DISTINCT rid, unnest(range(k, k + 13)) AS pos FROM g JOIN f USING (g) WHERE first < doc_id),
u AS (SELECT rid, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM d),
k AS (SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS kept FROM u ANTI JOIN x USING (rid, pos) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)"""

_ASSIGN = (r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
           r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)")
# A private key: all up to an END line that is the next run of five dashes; or header fields, the base64 block and a shorter
# last line that ends in = or before a quote, a line's end or a backslash (group 4, outside of the span); or the first line.
_HEAD, _SPACE = "-----BEGIN [A-Z ]*PRIVATE KEY-----", r"[\s\x0B\x5C>\x22\x27]"
_BLOCK = rf"{_HEAD}(?:{_SPACE}*(?:Proc-Type|DEK-Info):[^\n]*)*(?:{_SPACE}*[A-Za-z0-9+/]{{16,}}={{0,2}})+"
_KEY = (rf"({_HEAD}(?:[^-]|-{{1,4}}[^-])*-{{5,}}END [A-Z ]*PRIVATE KEY-----)|({_BLOCK}{_SPACE}+[A-Za-z0-9+/]*=+)"
        rf"|({_BLOCK}{_SPACE}+[A-Za-z0-9+/]+)([\x22\x27]?[\t\x0B\f\r ]*(?:\n|\x5C|\z))|({_BLOCK})|({_HEAD})")
_MARK = chr(0xE000)
_KINDS = (("assign", _ASSIGN, f"length(regexp_extract(m, '{_ASSIGN}', 2)) >= 6"),
          ("access", "AKIA[A-Z0-9]+", "length(m) >= 20"), ("hex", "[0-9a-f]+", "length(m) >= 24"),
          ("private_key", _KEY, "true"),
          ("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "true"),
          ("url_login", r"[a-z][a-z0-9+.-]*://[^\s:/@]+:[^\s/@]+@", "true"),
          ("prefixed", "(?:gh[pousr]_|xox[abprs]-|sk_live_)[A-Za-z0-9_-]{16,}", "true"))
_PUT = {"private_key": rf"{_MARK}\1\2\3\5\6{_MARK}\4"}
_WHOLE, _NEEDLE = r"\0", {"private_key": "PRIVATE KEY-----"}
_FOUND = " UNION ALL ".join(
    f"""SELECT rid, '{kind}' AS kind, {place} AS place, pos AS start, pos + length(m) AS stop FROM (
  SELECT rid, unnest(list_transform(range(1, len(q) // 2 + 1), lambda k: length(array_to_string(q[1:2 * k - 1], '')))) AS pos,
         unnest(list_transform(range(1, len(q) // 2 + 1), lambda k: q[2 * k])) AS m
  FROM (SELECT rid, regexp_split_to_array(regexp_replace(t, '{pattern}', '{_PUT.get(kind, _MARK + _WHOLE + _MARK)}', 'g'), '{_MARK}') AS q FROM d WHERE contains(t, '{_NEEDLE.get(kind, '')}')))
WHERE {test}""" for place, (kind, pattern, test) in enumerate(_KINDS))

OP9 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
             translate(coalesce(text, ''), '{_MARK}{chr(0xE001)}', '{chr(0xFFFD) * 2}') AS t FROM documents),
f AS ({_FOUND}),
s AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
        count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) FILTER (place < 3) AS base,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS spans FROM f GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN s USING (rid)"""

_TERMS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS.format(_LOWERED)} AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0) AS n_all, CAST(sum(len(w)) AS BIGINT) AS l_all FROM d),
i AS (SELECT DISTINCT item_id, text FROM benchmark),
q AS (SELECT item_id, text, term, count(*) AS times FROM (SELECT item_id, text, unnest({_TERMS.format(_LOWERED)}) AS term FROM i) GROUP BY ALL),
p AS (SELECT rid, doc_id, n, term, count(*) AS tf FROM (SELECT rid, doc_id, len(w) AS n, unnest(w) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * n_all + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY 1), s),
x AS (SELECT rid, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_all) // l_all))) AS gain FROM p JOIN f USING (term), s),
g AS (SELECT item_id, text, rid, doc_id, CAST(sum(times * gain) AS BIGINT) AS score FROM q JOIN x USING (term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS place FROM g WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM r WHERE place <= 10"""

OP13 = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d"""

ORACLE_SQL = {"op3_ngram_join": OP3, "op5_decontaminate": OP5, "op8_substring_dedup": OP8, "op9_secrets": OP9,
              "op12_ranked_search": OP12, "op13_exact_dedup": OP13}
