"""DuckDB SQL for the operators that SQL can express."""

OP8 = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         row_number() OVER () AS r
  FROM documents
), windows AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM base, unnest(range(1, len(w) - 1)) AS u(i)
), repeated AS (
  SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, x) > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM repeated, unnest([0, 1, 2]) AS u(k) GROUP BY r
), spread AS (
  SELECT r, source, regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g') AS y
  FROM base, unnest(lines) AS u(x)
), norm AS (
  SELECT r, source, trim(y, ' ') AS line FROM spread
), same AS (
  SELECT r, [trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') FOR x IN lines] AS same FROM base WHERE len(lines) > 0
), hosts AS (
  SELECT source, count(DISTINCT same) AS of FROM base JOIN same USING (r) GROUP BY source
), common AS (
  SELECT n.source, n.line FROM norm n JOIN same s USING (r) GROUP BY n.source, n.line
  HAVING count(DISTINCT same) >= 10
     AND 100 * count(DISTINCT same) >= 8 * (SELECT of FROM hosts h WHERE h.source IS NOT DISTINCT FROM n.source)
), removed AS (
  SELECT r, sum(len(string_split(n.line, ' '))) AS n_removed_words FROM norm n JOIN common c
    ON n.line = c.line AND n.source IS NOT DISTINCT FROM c.source GROUP BY r
), measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(x.n_removed_words, 0)::BIGINT AS n_removed_words
  FROM base LEFT JOIN covered c USING (r) LEFT JOIN removed x USING (r)
), failed AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * n_removed_words <= 50 * n_words AS kept, n_removed_words
FROM failed
"""


OP10 = r"""
WITH turns AS (
  SELECT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations
), sized AS (
  SELECT *, length(role) + length(text) + CASE WHEN role = 'system' THEN 13 ELSE 18 END AS size,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n
  FROM turns
), numbered AS (
  SELECT *, ((sum(size) OVER (PARTITION BY conv_id ORDER BY n) - size) // 262144)::BIGINT AS part FROM sized
), speakers AS (
  SELECT DISTINCT conv_id, role AS speaker FROM turns WHERE role <> 'system'
), pieces AS (
  SELECT t.conv_id, part, speaker, n, text, role = speaker AS own,
         CASE WHEN role = speaker THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>'
              ELSE '<|user:' || role || '|>' END || chr(10) AS head, '<|end|>' || chr(10) AS tail
  FROM numbered t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id
), placed AS (
  SELECT *, sum(length(head) + length(text) + length(tail)) OVER (PARTITION BY conv_id, speaker ORDER BY n)
            - length(tail) AS stop
  FROM pieces
)
SELECT conv_id, part, speaker, count(*) AS n_turns, min(stop - length(text) - length(head))::BIGINT AS start,
       string_agg(head || text || tail, '' ORDER BY n) AS text,
       coalesce(string_agg((stop - length(text))::BIGINT || ':' || stop::BIGINT, ',' ORDER BY n) FILTER (own), '') AS mask
FROM placed GROUP BY conv_id, part, speaker
"""


#: crc32 bit by bit: 0xEDB88320 where the low bit is set
CRC32 = """
xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                             lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)
"""

OP11 = rf"""
WITH RECURSIVE fields AS (
  SELECT *, row_number() OVER () AS r, {CRC32.format(text="doc_id::VARCHAR")} % 7 = 0 AS changed,
         list_aggregate([coalesce(strlen(x) || ':' || x, '-') FOR x IN [doc_id::VARCHAR, source, lang]], 'string_agg', '') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM documents
), leaves AS (
  SELECT *, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
         sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) AS claim
  FROM fields
), placed AS (
  SELECT r, doc_id, lang, leaf, CASE WHEN changed THEN claim ELSE leaf END AS claimed,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS idx,
         count(*) OVER (PARTITION BY lang) AS n
  FROM leaves
), lower_levels AS (
  SELECT 0 AS level, lang, idx, n, leaf AS digest FROM placed
  UNION ALL
  SELECT level + 1, lang, idx // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx))
  FROM lower_levels WHERE n > 1 GROUP BY level, lang, idx // 2, (n + 1) // 2
), subroots AS (
  SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n
  FROM lower_levels WHERE n = 1
), upper_levels AS (
  SELECT 0 AS level, place AS idx, n, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx))
  FROM upper_levels WHERE n > 1 GROUP BY level, idx // 2, (n + 1) // 2
), steps AS (
  SELECT p.r, m.level, CASE WHEN (p.idx >> m.level) % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(s.digest, '') AS step
  FROM placed p JOIN (SELECT DISTINCT lang, level FROM lower_levels WHERE n > 1) m ON m.lang IS NOT DISTINCT FROM p.lang
  LEFT JOIN lower_levels s ON s.lang IS NOT DISTINCT FROM p.lang AND s.level = m.level AND s.idx = xor(p.idx >> m.level, 1)
), above AS (
  SELECT b.lang, 1000 + m.level AS level, CASE WHEN (b.place >> m.level) % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(s.digest, '') AS step
  FROM subroots b JOIN (SELECT DISTINCT level FROM upper_levels WHERE n > 1) m ON true
  LEFT JOIN upper_levels s ON s.level = m.level AND s.idx = xor(b.place >> m.level, 1)
), every_step AS (
  SELECT r, level, step FROM steps
  UNION ALL SELECT p.r, a.level, a.step FROM placed p JOIN above a ON a.lang IS NOT DISTINCT FROM p.lang
), ways AS (
  SELECT r, list(step ORDER BY level) AS way FROM every_step GROUP BY r
), folded AS (
  SELECT p.*, coalesce(list_aggregate([s[2:] FOR s IN way], 'string_agg', ''), '') AS siblings,
         list_reduce(list_prepend(claimed, coalesce(way, [])), lambda a, s: sha256(CASE WHEN s[1] = 'L' THEN s[2:] || a ELSE a || s[2:] END)) AS folded_root
  FROM placed p LEFT JOIN ways USING (r)
)
SELECT doc_id, leaf, subroot, (SELECT digest FROM upper_levels WHERE n = 1) AS root, sha256(siblings) AS proof_sha256,
       folded_root, folded_root = (SELECT digest FROM upper_levels WHERE n = 1) AS verified
FROM folded f JOIN subroots s ON s.lang IS NOT DISTINCT FROM f.lang
"""


def _found(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    """Places of one pattern's matches: sums of the lengths of matches and of what lies between them."""
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT r, {rank} AS rank, '{kind}' AS kind, found[i] AS string, measured[i] AS part,
         list_sum([length(x) FOR x IN gaps[:i]]) + coalesce(list_sum([length(x) FOR x IN found[:i - 1]]), 0) AS start
  FROM (SELECT r, regexp_extract_all(t, '{quoted}') AS found, string_split_regex(t, '{quoted}') AS gaps,
               regexp_extract_all(t, '{quoted}', {group}) AS measured FROM base), unnest(range(1, len(found) + 1)) AS u(i)
  WHERE length(measured[i]) >= {least}"""


def _secrets() -> str:
    from spendframe.llm import secret_scan as s

    def plain(pattern: str) -> str:  # letters in either case without the folding of letters beyond ASCII
        head, tail = pattern.split("(?i:", 1)[0], pattern.split("(?i:", 1)[1]
        words, tail = tail.split(")", 1)
        return head + "(" + "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words) + ")" + tail

    patterns = {k: (plain(p) if "(?i:" in p else p, g, n) for k, (p, g, n) in s.PATTERNS.items()}
    union = " UNION ALL ".join(_found(k, rank, *p) for rank, (k, p) in enumerate(patterns.items()))
    limits = " ".join(f"WHEN regexp_matches(string, '{pattern}') THEN {s.most_weight(bits)}" for _, pattern, bits in s.CLASSES)
    known = " OR ".join(f"regexp_matches(string, '{pattern}')" for pattern in s.ALLOWED)
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in s.PATTERNS)
    return f"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
matches AS ({union}),
candidates AS ({_found(s.ADDED, len(patterns), s.CANDIDATE, 0, s.LEAST)}),
windows AS (
  SELECT r, start, string, w, string[w:w + {s.WINDOW - 1}] AS part FROM candidates, unnest(range(1, length(string) - {s.WINDOW - 2})) AS u(w)
  WHERE NOT ({known})
), counted AS (
  SELECT r, start, string, w, c, count(*) AS n FROM windows, unnest(string_split(part, '')) AS u(c) GROUP BY ALL
), weighed AS (
  SELECT r, start, string, w, sum(({s.weights()})[n + 1]) AS weight FROM counted GROUP BY ALL
), added AS (
  SELECT r, {len(patterns)} AS rank, '{s.ADDED}' AS kind, string, start FROM weighed GROUP BY r, start, string
  HAVING min(weight) <= CASE {limits} ELSE -1 END
), alone AS (
  SELECT * FROM added a WHERE NOT EXISTS (
    SELECT 1 FROM matches m WHERE m.r = a.r AND m.start < a.start + length(a.string) AND a.start < m.start + length(m.string))
), every AS (
  SELECT r, rank, kind, start, kind || ':' || start || ':' || start + length(string) AS said FROM matches
  UNION ALL SELECT r, rank, kind, start, kind || ':' || start || ':' || start + length(string) FROM alone
), joined AS (
  SELECT r, {counts}, string_agg(said, ',' ORDER BY start, rank) FILTER (rank < {len(patterns)}) AS own,
         string_agg(said, ',' ORDER BY start, rank) AS spans FROM every GROUP BY r
)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in s.PATTERNS)}, sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM base LEFT JOIN joined USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_line_quality": OP8, "op10_perspectives": OP10, "op11_merkle": OP11, "op13_secret_scan": _secrets()}
