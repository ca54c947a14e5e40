"""Queries of the training-data operators, with SQL where SQL can express the whole result.

The SQL is written on its own, with DuckDB's functions. Trained models, tokenisers, signatures and
encoded media have none: tests hold their queries against brute-force versions.
"""

from __future__ import annotations

from gaugeworks.llm import align, ann, bpe, chat, decontaminate, linededup, media, neardup, quality, secrets, sharding, urls, variants

QUERIES = {
    "op1_urls": urls.op1_urls,
    "op2_secrets": secrets.op2_secrets,
    "op3_quality": quality.op3_quality,
    "op4_media": media.op4_media,
    "op5_neardup": neardup.op5_neardup,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op7_sharding": sharding.op7_sharding,
    "op8_bpe": bpe.op8_bpe,
    "op9_linededup": linededup.op9_linededup,
    "op10_chat": chat.op10_chat,
    "op11_neighbours": ann.op11_neighbours,
    "op12_variants": variants.op12_variants,
    "op13_alignment": align.op13_alignment,
    "url_rules": urls.url_rules,
    "secret_patterns": secrets.secret_patterns,
    "quality_folds": quality.quality_folds,
}

#: CRC-32 of bytes in hexadecimal (column x of a table t), by the reflected polynomial and a table of 256 entries.
_CRC = """crc8 AS (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)),
 crct AS (SELECT list(c ORDER BY i) AS tab FROM crc8)"""


def _crc_of(bytes_hex: str) -> str:
    """SQL of the CRC-32 of a text of hexadecimal digits; the table crct must be joined."""
    steps = f"list_transform(range(length({bytes_hex}) // 2), lambda i: CAST('0x' || substr({bytes_hex}, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda c, b: xor(c >> 8, tab[xor(c, b) % 256 + 1])), 4294967295)"


_CHAT = """WITH c AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
 t AS (SELECT *, COALESCE(role, '') AS r, COALESCE(text, '') AS x FROM c)
SELECT conv_id, COUNT(*) AS n_turns,
  sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)) AS turns_sha256,
  CAST(COALESCE(SUM(length(x)) FILTER (WHERE r = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(COALESCE(string_agg(x, '' ORDER BY turn NULLS FIRST, text NULLS FIRST) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
  CAST(SUM(24 + length(replace(replace(r, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|')) + length(replace(replace(x, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""

_SHARDS = f"""WITH {_CRC},
 d AS (SELECT doc_id, source, hex(encode(COALESCE(text, ''))) AS x, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS stratum FROM documents),
 e AS (SELECT doc_id, source, stratum, length(x) // 2 + 1 AS size, {_crc_of('x')} AS text_crc32, md5('{sharding.SEED}|' || stratum || '|' || COALESCE(CAST(doc_id AS VARCHAR), '-')) AS h FROM d, crct),
 f AS (SELECT *, (2 * ROW_NUMBER() OVER (PARTITION BY stratum ORDER BY h, doc_id, size, text_crc32) - 1)::DOUBLE / (2 * COUNT(*) OVER (PARTITION BY stratum))::DOUBLE AS frac FROM e),
 g AS (SELECT *, ROW_NUMBER() OVER (ORDER BY frac, stratum, h, doc_id, size, text_crc32) - 1 AS place, COUNT(*) OVER () AS total FROM f),
 s AS (SELECT *, place * {sharding.SHARDS} // total AS shard FROM g)
SELECT doc_id, source, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard,
  CAST(ROW_NUMBER() OVER (PARTITION BY shard ORDER BY place) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s"""

_URLS = """WITH u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN url[instr(url, '://') + 3:] ELSE '' END AS rest FROM pages),
 h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
 p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest[length(raw) + 1:], '^[^?#]*') AS path FROM h),
 r(kind, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
 m AS (SELECT page_id, host, path, rh || rp AS rule, kind, ROW_NUMBER() OVER (PARTITION BY page_id, host, path ORDER BY length(rh || rp) DESC) AS k
  FROM p LEFT JOIN r ON (host = rh OR suffix(host, '.' || rh)) AND prefix(path, rp))
SELECT page_id, host, path, rule, kind AS verdict FROM m WHERE k = 1"""


def _secret_sql() -> str:
    either = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    words = "|".join(map(either, ("password", "passwd", "secret", "token", "api_?key")))
    quote = "[\"'']?"
    assign = f"({words}){quote}[ ]*[:=][ ]*{quote}([A-Za-z0-9+/_.=-]+)"
    parts = []
    for rank, (kind, pattern, group, least) in enumerate((("assign", assign, 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]{16,}", 0, 16))):
        parts.append(f"""SELECT doc_id, '{kind}' AS kind, {rank} AS rank, s.a AS a, s.z AS z FROM (SELECT doc_id, unnest(list_filter(list_transform(range(1, len(hits) + 1), lambda i:
   {{'a': CAST(list_sum(list_transform(gaps[:i], lambda g: length(g))) + COALESCE(list_sum(list_transform(hits[:i - 1], lambda g: length(g))), 0) AS BIGINT),
     'z': CAST(list_sum(list_transform(gaps[:i], lambda g: length(g))) + list_sum(list_transform(hits[:i], lambda g: length(g))) AS BIGINT), 'n': length(vals[i])}}), lambda x: x.n >= {least})) AS s
  FROM (SELECT doc_id, string_split_regex(x, '{pattern}') AS gaps, regexp_extract_all(x, '{pattern}') AS hits, regexp_extract_all(x, '{pattern}', {group}) AS vals FROM d WHERE regexp_matches(x, '{pattern}')))""")
    return f"""WITH d AS (SELECT doc_id, COALESCE(text, '') AS x FROM documents), s AS ({' UNION ALL '.join(parts)}),
 g AS (SELECT doc_id, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, rank) AS spans, COUNT(*) FILTER (WHERE rank = 0) AS n0, COUNT(*) FILTER (WHERE rank = 1) AS n1, COUNT(*) FILTER (WHERE rank = 2) AS n2 FROM s GROUP BY 1)
SELECT d.doc_id, COALESCE(n0, 0) AS n_assign, COALESCE(n1, 0) AS n_access, COALESCE(n2, 0) AS n_hex, sha256(COALESCE(spans, '')) AS base_sha256 FROM d LEFT JOIN g USING (doc_id)"""


_FOLDS = f"""WITH {_CRC}, d AS (SELECT doc_id, hex(encode(CAST(doc_id AS VARCHAR))) AS x FROM documents)
SELECT doc_id, COALESCE({_crc_of('x')} % 5 = 0, TRUE) AS held_out FROM d, crct"""

_VARIANTS = f"""WITH RECURSIVE {_CRC},
 r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
 o AS (SELECT doc_id, run, COUNT(*) AS k, hex(encode(CAST(doc_id AS VARCHAR) || ':' || run)) AS x FROM r WHERE length(run) >= 5 GROUP BY ALL),
 h AS (SELECT run, k, {_crc_of('x')} AS h FROM o, crct),
 w AS MATERIALIZED (SELECT CASE WHEN h % 97 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, CAST(SUM(k) AS BIGINT) AS n FROM h GROUP BY 1 HAVING length(word) >= 5 AND SUM(k) >= 3),
 c AS MATERIALIZED (SELECT word, n, i, word[1:i - 1] || '*' || word[i + 1:] AS spot, word[1:i - 1] || word[i + 1:] AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
 p AS (SELECT a.word AS a, b.word AS b, b.n FROM c a JOIN c b USING (spot) WHERE a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM c JOIN w ON c.less = w.word UNION SELECT w.word, c.word, c.n FROM c JOIN w ON c.less = w.word),
 f AS (SELECT w.word, w.n, COUNT(p.b) AS n_near, arg_max(p.b, (p.n, -q.at)) AS near, MAX(p.n) AS near_n FROM w LEFT JOIN p ON p.a = w.word LEFT JOIN (SELECT word, ROW_NUMBER() OVER (ORDER BY word) AS at FROM w) q ON q.word = p.b GROUP BY ALL),
 g AS MATERIALIZED (SELECT word, n, n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n FROM f),
 t AS (SELECT word, word AS root, 0 AS step FROM g UNION ALL SELECT t.word, g.form, step + 1 FROM t JOIN g ON g.word = t.root WHERE g.form IS NOT NULL)
SELECT g.word, g.form, (SELECT arg_max(t.root, t.step) FROM t WHERE t.word = g.word) AS root, g.n, CAST(g.n_near AS BIGINT) AS n_near, CAST(g.form_n AS BIGINT) AS form_n FROM g"""

ORACLE_SQL: dict[str, str] = {
    "op12_variants": _VARIANTS,
    "op7_sharding": _SHARDS,
    "op10_chat": _CHAT,
    "url_rules": _URLS,
    "secret_patterns": _secret_sql(),
    "quality_folds": _FOLDS,
}
