"""DuckDB SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

CHAT = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (
    SELECT *, length(role) + length(text) + length('[INST][/INST]</s>')
        + len(regexp_extract_all(role, '[\[<]\\*(?:/?INST\]|/s>)')) + len(regexp_extract_all(text, '[\[<]\\*(?:/?INST\]|/s>)')) AS formatted
    FROM turns),
joined AS (
    SELECT conv_id, count(*) AS n_turns, sum(formatted)::BIGINT AS formatted_chars,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss
    FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM joined
"""

FM_INDEX = r"""
WITH cut AS (
    SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
words AS (
    SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM cut),
wins AS (
    SELECT DISTINCT id::VARCHAR AS item, w[i:i + 9] AS win
    FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM words WHERE kind = 'b' AND len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS n FROM wins),
places AS (
    SELECT id, i, n, w[i:i + n - 1] AS win
    FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE kind = 'd' AND len(w) >= n)),
hits AS (SELECT p.id, p.i, p.n, v.item FROM places p JOIN wins v ON p.win = v.win),
covered AS (SELECT id, count(DISTINCT k) AS n_hit FROM (SELECT id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY id),
items AS (
    SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT id, item FROM hits) GROUP BY id)
SELECT w.id AS doc_id, len(w.w) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(x.n_items, 0) AS n_items,
    sha256(coalesce(x.list, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN covered c ON c.id = w.id LEFT JOIN items x ON x.id = w.id WHERE w.kind = 'd'
"""

#: The divergence limits, word minimum, character classes and common words are stated here anew, not imported.
_CLASSES = (r"[a-z]", r"[A-Z]", r"[0-9]", r"[.,;:]", r"[#*$%&|<>]", r"[!?]", r"[\x20\x09-\x0D]", r"[\x{80}-\x{10FFFF}]")
_COMMON = """der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat
the of and to a in is it that for was on as with be by at this are from or have an they which you had not were
de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha
de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son"""

QUALITY_RULES = r"""
WITH docs AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
split AS (
    SELECT doc_id, lang, t, [x FOR x IN regexp_split_to_array(t, '[\x20\x09-\x0D]+') IF x <> ''] AS w,
        [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM docs),
windows AS (SELECT doc_id, i, w[i:i + 7] AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM split WHERE len(w) >= 8)),
twice AS (SELECT doc_id, unnest(list(i)) AS i FROM windows GROUP BY doc_id, win HAVING count(*) > 1),
repeated AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM twice) GROUP BY doc_id),
measured AS (
    SELECT s.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        coalesce(r.n, 0) AS n_repeat_words
    FROM split s LEFT JOIN repeated r ON r.doc_id = s.doc_id),
counted AS (SELECT doc_id, lang, length(t) AS size, [{classes}] AS n FROM docs),
words AS (SELECT doc_id, lang, trim(lower(unnest(w)), '.,;:!?"''()[]') AS x FROM split),
hist AS (
    SELECT doc_id, lang, 'c' AS kind, unnest(range(9))::VARCHAR AS k, unnest(list_append(n, size - list_sum(n)))::DOUBLE AS n FROM counted
    UNION ALL
    SELECT doc_id, lang, 'w', CASE WHEN x IN ({common}) THEN x ELSE '' END AS y, count(*) FROM words GROUP BY doc_id, lang, y),
shares AS (SELECT doc_id, kind, k, n / sum(n) OVER (PARTITION BY doc_id, kind) AS p FROM hist WHERE n > 0),
-- the references: documents near the medians of their language, one vote each
enough AS (
    SELECT s.doc_id, s.lang FROM split s WHERE s.lang IN ('de', 'en', 'es', 'fr') AND len(s.w) >= 50),
own AS (
    SELECT e.doc_id, e.lang, count(w.x) FILTER (list_contains({by_lang}[e.lang], w.x)) AS n, count(w.x) AS total
    FROM enough e JOIN words w ON w.doc_id = e.doc_id GROUP BY e.doc_id, e.lang),
bins AS (
    SELECT e.doc_id, e.lang, h.k, floor(h.n * 1000 / c.size)::BIGINT AS bin
    FROM enough e JOIN (SELECT doc_id, unnest(range(9))::VARCHAR AS k, unnest(list_append(n, size - list_sum(n))) AS n FROM counted) h ON h.doc_id = e.doc_id
        JOIN counted c ON c.doc_id = e.doc_id
    UNION ALL SELECT doc_id, lang, 'own', floor(n * 1000 / total)::BIGINT FROM own),
medians AS (
    SELECT lang, k, min(bin) AS m
    FROM (SELECT lang, k, bin, sum(count(*)) OVER (PARTITION BY lang, k ORDER BY bin) AS until, sum(count(*)) OVER (PARTITION BY lang, k) AS total
          FROM bins GROUP BY lang, k, bin) WHERE 2 * until >= total GROUP BY lang, k),
typical AS (
    SELECT b.doc_id FROM bins b JOIN medians m ON m.lang = b.lang AND m.k = b.k
    GROUP BY b.doc_id HAVING bool_and(CASE WHEN b.k = 'own' THEN b.bin * 2 >= m.m ELSE abs(b.bin - m.m) <= 20 + m.m // 4 END)),
refs AS (
    SELECT lang, kind, k, n / sum(n) OVER (PARTITION BY lang, kind) AS q
    FROM (SELECT h.lang, h.kind, h.k, sum(floor(h.n * 1000000 / CASE WHEN h.kind = 'c' THEN c.size ELSE len(s.w) END)::BIGINT) AS n
          FROM hist h JOIN typical t ON t.doc_id = h.doc_id JOIN counted c ON c.doc_id = h.doc_id JOIN split s ON s.doc_id = h.doc_id
          GROUP BY h.lang, h.kind, h.k) WHERE n > 0),
without AS (  -- the word divergence of a text without common words
    SELECT lang, (log2(2 / (1 + q)) + CASE WHEN q > 0 THEN q * log2(2 * q / (1 + q)) ELSE 0 END + 1 - q) / 2 AS d
    FROM (SELECT l.lang, coalesce(r.q, 0) AS q FROM (SELECT DISTINCT lang FROM refs) l LEFT JOIN refs r ON r.lang = l.lang AND r.kind = 'w' AND r.k = '')),
terms AS (
    SELECT s.doc_id, l.lang, s.kind, s.p, coalesce(r.q, 0) AS q
    FROM shares s CROSS JOIN (SELECT DISTINCT lang FROM refs) l LEFT JOIN refs r ON r.lang = l.lang AND r.kind = s.kind AND r.k = s.k),
divergence AS (
    SELECT doc_id, lang, kind,
        (1 + sum(p * log2(2 * p / (p + q)) + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END - q)) / 2 AS d
    FROM terms GROUP BY doc_id, lang, kind),
near AS (
    SELECT DISTINCT c.doc_id FROM divergence c JOIN divergence w ON w.doc_id = c.doc_id AND w.lang = c.lang
        JOIN without o ON o.lang = c.lang JOIN split s ON s.doc_id = c.doc_id
    WHERE c.kind = 'c' AND w.kind = 'w' AND c.d <= 0.10 AND w.d <= o.d * least(0.9, 0.5 + 4.0 / sqrt(len(s.w)))),
based AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured)
SELECT b.*, NOT base_failed AND (n_words < 50 OR n.doc_id IS NOT NULL OR NOT EXISTS (SELECT 1 FROM refs)) AS kept
FROM based b LEFT JOIN near n ON n.doc_id = b.doc_id
""".replace("{classes}", ", ".join(f"len(regexp_extract_all(t, '{c}'))" for c in _CLASSES)).replace(
    "{common}", ", ".join(f"'{w}'" for w in sorted(set(_COMMON.split())))).replace(
    "{by_lang}", "MAP {" + ", ".join(f"'{k}': {sorted(set(x.split()))}" for k, x in zip(("de", "en", "es", "fr"), _COMMON.split("\n"), strict=True)) + "}")

MERKLE = r"""
WITH RECURSIVE fields AS (
    SELECT doc_id, lang, text, doc_id IS NOT NULL AND text IS NOT NULL AS can_change,
        coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
            || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
    FROM documents),
-- crc32 of the decimal id, byte by byte through the usual table, whose entries are eight halvings each
steps AS (
    SELECT i AS entry, i::BIGINT AS v, 0 AS k FROM range(256) r(i) UNION ALL
    SELECT entry, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM steps WHERE k < 8),
crcs AS (
    SELECT doc_id, 4294967295::BIGINT AS v, 1 AS k FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) UNION ALL
    SELECT c.doc_id, xor(c.v // 256, s.v), c.k + 1 FROM crcs c JOIN steps s ON s.k = 8 AND s.entry = xor(c.v, ascii(substr(c.doc_id::VARCHAR, c.k::BIGINT, 1))::BIGINT) % 256
    WHERE c.k <= strlen(c.doc_id::VARCHAR)),
thirds AS (SELECT doc_id FROM crcs WHERE k = strlen(doc_id::VARCHAR) + 1 AND xor(v, 4294967295) % 3 = 0),
leaves AS (
    SELECT f.doc_id, f.lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
        CASE WHEN can_change AND t.doc_id IS NOT NULL
            THEN sha256(head || strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) END AS now
    FROM fields f LEFT JOIN thirds t ON t.doc_id = f.doc_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
nodes AS (
    SELECT lang, 0 AS lev, i, leaf AS h, n FROM placed UNION ALL
    SELECT lang, lev + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY lang, lev, i // 8, n),
subroots AS (SELECT lang, lev, h AS subroot FROM nodes WHERE n = 1),
langs AS (SELECT *, row_number() OVER (ORDER BY lang IS NOT NULL, lang) - 1 AS g, count(*) OVER () AS n FROM subroots),
upper AS (
    SELECT 0 AS lev, g AS i, subroot AS h, n FROM langs UNION ALL
    SELECT lev + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM upper WHERE n > 1 GROUP BY lev, i // 8, n),
top AS (SELECT h AS root, lev FROM upper WHERE n = 1),
-- the siblings of every node that is not a root, and the steps of each leaf: first in its language, then above
sides AS (
    SELECT a.lang, a.lev, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS lhs,
        coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS rhs
    FROM nodes a JOIN nodes b ON b.lang IS NOT DISTINCT FROM a.lang AND b.lev = a.lev AND b.i // 8 = a.i // 8 WHERE a.n > 1 GROUP BY a.lang, a.lev, a.i),
top_sides AS (
    SELECT a.lev, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS lhs,
        coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS rhs
    FROM upper a JOIN upper b ON b.lev = a.lev AND b.i // 8 = a.i // 8 WHERE a.n > 1 GROUP BY a.lev, a.i),
every_side AS (
    SELECT coalesce(lang, chr(0)) AS lang, lev, i, lhs, rhs FROM sides UNION ALL
    SELECT coalesce(l.lang, chr(0)), l.lev + t.lev, -1 - l.g // pow(8, t.lev)::BIGINT, t.lhs, t.rhs
    FROM langs l JOIN top_sides t ON t.i = l.g // pow(8, t.lev)::BIGINT),
walked AS (
    SELECT p.doc_id, p.leaf, p.i AS own, coalesce(p.lang, chr(0)) AS lang, 0 AS lev, coalesce(p.now, p.leaf) AS h, '' AS proof, l.lev AS inner_levels, l.g, l.subroot
    FROM placed p JOIN langs l ON l.lang IS NOT DISTINCT FROM p.lang UNION ALL
    SELECT w.doc_id, w.leaf, w.own, w.lang, w.lev + 1, sha256(s.lhs || w.h || s.rhs), w.proof || s.lhs || s.rhs, w.inner_levels, w.g, w.subroot
    FROM walked w JOIN every_side s ON s.lang = w.lang AND s.lev = w.lev
        AND s.i = CASE WHEN w.lev < w.inner_levels THEN w.own // pow(8, w.lev)::BIGINT ELSE -1 - w.g // pow(8, w.lev - w.inner_levels)::BIGINT END)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
FROM walked w JOIN top t ON w.lev = w.inner_levels + t.lev
"""

RANKED = r"""
WITH cut AS (
    SELECT 'd' AS kind, doc_id AS id, row_number() OVER () AS r, text FROM documents UNION ALL
    SELECT 'b', item_id, row_number() OVER (), text FROM benchmark),
words AS (
    SELECT kind, id, r, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM cut),
counted AS (SELECT id, r, term, count(*) AS tf FROM words WHERE kind = 'd' GROUP BY id, r, term),
sized AS (SELECT r, sum(tf)::BIGINT AS n FROM counted GROUP BY r),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sized),
asked AS (SELECT DISTINCT id AS item_id, r AS q, term FROM words WHERE kind = 'b'),
weights AS (
    SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w
    FROM counted, total WHERE term IN (SELECT term FROM asked) GROUP BY term),
scored AS (
    SELECT a.item_id, a.q, c.id AS doc_id, c.r, sum(w.w * ((1000000000 * c.tf) // (1000 * c.tf + 8 * (100 - 90 + (90 * s.n * t.docs) // t.terms))))::BIGINT AS score
    FROM asked a JOIN counted c ON c.term = a.term JOIN weights w ON w.term = a.term JOIN sized s ON s.r = c.r CROSS JOIN total t
    GROUP BY a.item_id, a.q, c.id, c.r)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id, q ORDER BY score DESC, doc_id NULLS FIRST, r)::INTEGER AS rank FROM scored WHERE score > 0)
WHERE rank <= 10
"""
