"""DuckDB SQL of the queries that SQL can say: byte shards, the n-gram join, line dedup, and the base columns of quality rules and secret scans."""

from __future__ import annotations

from .line_dedup import HOST, MIN_COPIES, MIN_PAGES, VISIBLE
from .ngram_join import NGRAM
from .quality_mcd import MIN_WORDS
from .sharding import WHOLE_UP_TO

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


#: CRC-32 (reflected polynomial 0xEDB88320) bit by bit: each byte enters with the first of its eight steps.
CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(0, length(h) // 2), lambda i: [('0x' || substr(h, 2 * i + 1, 2))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
 lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295)"""

SHARDING = f"""WITH d AS (SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, md5(coalesce(text, '')) AS m, hex(encode(coalesce(text, ''))) AS h FROM documents),
t AS (SELECT sum(size)::BIGINT AS total FROM d), g AS (SELECT m, sum(size) > {WHOLE_UP_TO} * (SELECT total FROM t) / 24 AS large FROM d GROUP BY 1),
p AS (SELECT d.*, large, sum(size) OVER (ORDER BY m, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)::BIGINT - size AS start FROM d JOIN g USING (m)),
c AS (SELECT *, CASE WHEN large THEN start ELSE min(start) OVER (PARTITION BY m) END AS cut FROM p), s AS (SELECT *, least(23, cut * 24 // (SELECT total FROM t))::INT AS shard FROM c)
SELECT doc_id, size::BIGINT AS size, {CRC}::BIGINT AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY m, doc_id NULLS FIRST) - 1 AS slot, NULL::INT AS grown_shard FROM s"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
NGRAMS = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {NGRAM} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {NGRAM - 2}), lambda i: array_to_string(w[i : i + {NGRAM - 1}], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.seen)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY 1) m ON m.doc_id = d.doc_id"""

_text = "html"
for _pattern, _by in VISIBLE:
    _text = f"regexp_replace({_text}, {_quoted(_pattern)}, {'chr(10)' if _by else _quoted(_by)}, 'g')"
_BARE = "trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
LINES = f"""WITH p AS (SELECT page_id, lower(CASE WHEN regexp_extract(url, {_quoted(HOST)}, 1) = '' THEN url ELSE regexp_extract(url, {_quoted(HOST)}, 1) END) AS host, string_split({_text}, chr(10)) AS lines FROM pages),
k AS (SELECT DISTINCT page_id, host, {_BARE} AS line FROM (SELECT page_id, host, unnest(lines) AS x FROM p)), n AS (SELECT coalesce(host, '') AS host, count(*) AS pages FROM p GROUP BY 1),
b AS (SELECT coalesce(k.host, '') AS host, list(line) AS bad FROM (SELECT host, line, count(*) AS c FROM k WHERE line <> '' GROUP BY ALL) k JOIN n ON n.host = coalesce(k.host, '') WHERE c >= {MIN_COPIES} AND pages >= {MIN_PAGES} AND c > 0.1 * pages GROUP BY 1),
o AS (SELECT page_id, p.host, lines, list_filter(lines, lambda x: {_BARE} = '' OR NOT list_contains(coalesce(bad, []), {_BARE})) AS kept FROM p LEFT JOIN b ON b.host = coalesce(p.host, ''))
SELECT page_id, host, len(lines) AS n_lines, len(lines) - len(kept) AS n_dropped, sha256(array_to_string(kept, chr(10))) AS text_sha256 FROM o"""

QUALITY_BASE = f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3), x AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM p),
r AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM x WHERE c > 1) GROUP BY 1),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1)
SELECT w.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
len(w) < {MIN_WORDS} OR 100 * coalesce(r.n, 0) > 50 * len(w) AS base_failed FROM w LEFT JOIN r ON r.doc_id = w.doc_id LEFT JOIN l ON l.doc_id = w.doc_id"""


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_ASSIGN = "(?:" + "|".join(_either(x) for x in ("password", "passwd", "secret", "token")) + "|" + _either("api") + "_?" + _either("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
SECRETS_BASE = f"""SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), {_quoted(_ASSIGN)}, 1), lambda x: length(x) >= 6)) AS n_assign,
len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS n_access, len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 24)) AS n_hex FROM documents"""
