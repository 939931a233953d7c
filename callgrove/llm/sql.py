"""DuckDB SQL for the numbered queries that SQL can express."""

_SPACES = r"[\x20\x09-\x0D]+"
_WORDS = rf"list_filter(string_split_regex(coalesce(text, ''), '{_SPACES}'), lambda w: w <> '')"

_QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM d, unnest(range(1, len(w) - 1)) AS u(i)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
f AS (SELECT d.doc_id, text, w, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
    FROM d LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR n_symbols * 100 > word_chars * 10 OR n_dup_lines * 2 > len(string_split(text, chr(10)))
        OR word_chars NOT BETWEEN n_words * 2 AND n_words * 20 OR len(regexp_extract_all(text, '\pL')) * 2 < word_chars
        OR len(list_distinct(w)) * 20 < len(w)) AS kept
FROM b
"""


def _bench(table: str, key: str) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lower = f"translate(coalesce(text, ''), '{upper}', '{upper.lower()}')"
    return rf"SELECT {key}, list_filter(string_split_regex({lower}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM {table}"


_CONTAMINATION = f"""
WITH d AS ({_bench("documents", "doc_id")}), b AS ({_bench("benchmark", "item_id")}),
v AS (SELECT DISTINCT item_id, w[i : i + 9] AS win FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
o AS (SELECT doc_id, item_id, i, len(win) AS n FROM p JOIN v ON p.w[i] = v.win[1] AND p.w[i : i + len(v.win) - 1] = v.win),
h AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, n)) AS k FROM o) GROUP BY doc_id),
s AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM o GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
    sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id)
"""

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BASE32 = f"array_to_string(list_transform(range(0, 32), lambda i: substr('{_ALPHABET}', 1 + ((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31), 1)), '')"
_WARC = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS original FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
    CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < original THEN original END AS refers_to
FROM m
"""


def _field(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen(CAST({column} AS VARCHAR)) || ':' || CAST({column} AS VARCHAR) END"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


#: Unsigned crc32 of the digits of doc_id, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
    lambda crc, c: list_reduce(list_prepend(xor(crc, c), range(8)), lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""


def _merkle(levels: int) -> str:
    """Trees by language (g) and over the languages, unrolled for so many levels; place i of a node in its tree, siblings as one string."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = f"translate(text, '{upper}', '{upper.lower()}')"
    parts = [
        f"d AS (SELECT doc_id, lang AS g, {_leaf('text')} AS leaf, CASE WHEN text IS NOT NULL AND doc_id IS NOT NULL AND {_CRC} % 3 = 0 THEN {_leaf(lowered)} END AS own FROM documents)",
        "a0 AS (SELECT *, coalesce(own, leaf) AS x, '' AS w, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d)",
        "n0 AS (SELECT g, i, leaf AS h, n FROM a0)",
    ]

    def climb(a: str, n: str, key: str, up: str) -> None:
        """One level: n has the nodes (key, i, h, n), a the rows with their place in it."""
        k = len(parts)
        parts.extend([
            f"r{k} AS (SELECT {key}, i // 8 AS i, list(h ORDER BY i) AS hs, any_value(n) AS n FROM {n} GROUP BY {key}, i // 8)",
            f"n{up} AS (SELECT {key}, CASE WHEN n > 1 THEN i ELSE 0 END AS i, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h, (n + 7) // 8 AS n FROM r{k})",
            f"""a{up} AS (SELECT a.* REPLACE (
                CASE WHEN r.n > 1 THEN sha256(array_to_string(hs[1 : a.i % 8], '') || a.x || array_to_string(hs[a.i % 8 + 2 :], '')) ELSE a.x END AS x,
                CASE WHEN r.n > 1 THEN a.w || array_to_string(hs[1 : a.i % 8], '') || array_to_string(hs[a.i % 8 + 2 :], '') ELSE a.w END AS w, a.i // 8 AS i)
                FROM {a} a JOIN r{k} r ON a.{key} IS NOT DISTINCT FROM r.{key} AND a.i // 8 = r.i)""",
        ])

    for k in range(levels):
        climb(f"a{k}", f"n{k}", "g", str(k + 1))
    parts += [
        f"s AS (SELECT g, h, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, count(*) OVER () AS n, 0 AS o FROM n{levels})",
        "nt0 AS (SELECT o, i, h, n FROM s)",
        f"at0 AS (SELECT a.* REPLACE (s.i AS i), s.h AS subroot, 0 AS o FROM a{levels} a JOIN s ON a.g IS NOT DISTINCT FROM s.g)",
    ]
    for k in range(levels):
        climb(f"at{k}", f"nt{k}", "o", f"t{k + 1}")
    return f"""WITH {", ".join(parts)}
SELECT doc_id, leaf, subroot, h AS root, sha256(w) AS proof_sha256, x AS folded_root, x = h AS verified FROM at{levels} CROSS JOIN (SELECT h FROM nt{levels}) t"""


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PHRASES = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, w[i : i + k - 1] AS g FROM w, (VALUES (1), (2), (3)) AS v(k), unnest(range(1, len(w) - k + 2)) AS u(i)),
t AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
f AS (SELECT lang, k, g, count(*) AS f FROM g GROUP BY lang, k, g HAVING count(*) >= 10),
inner_parts AS (SELECT lang, unnest([g[1:2], g[2:3]]) AS g, f FROM f WHERE k = 3),
longer AS (SELECT lang, g, max(f) AS m FROM inner_parts GROUP BY lang, g),
c AS (SELECT f.* FROM f LEFT JOIN longer USING (lang, g) WHERE k > 1 AND (m IS NULL OR 100 * m < 50 * f)),
s AS (SELECT c.lang, c.g, c.f AS a, l.f AS l, r.f AS r, cut, CAST(CAST(c.f AS HUGEINT) * c.f * 1000000 // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
    FROM c, (VALUES (1), (2)) AS v(cut), f l, f r WHERE cut < c.k AND l.lang = c.lang AND r.lang = c.lang AND l.g = c.g[1 : cut] AND r.g = c.g[cut + 1 :]),
b AS (SELECT *, array_to_string(g, ' ') AS phrase FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b JOIN t USING (lang) QUALIFY rank <= 2000
"""

ORACLES = {"op4_quality_rules": _QUALITY, "op7_warc": _WARC, "op8_decontamination": _CONTAMINATION, "op11_merkle_manifest": _merkle(7), "op13_phrase_mining": _PHRASES}
