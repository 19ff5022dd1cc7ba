"""DuckDB SQL for the corpus queries that SQL can express."""

MIXING = r"""
WITH sized AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS k, md5(coalesce(text, '')) AS text_md5,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
per AS (SELECT k, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY k),
weighed AS (
  SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY k = 'n', k) - 1) % 3 + 1 AS INTEGER)] AS w,
         source_size * 2.0::DOUBLE AS cap FROM per),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
rates AS (
  SELECT k, source_size,
         least(CASE WHEN cap / w <= level THEN cap ELSE max(level) OVER () * w END, cap) AS target,
         CAST('0x' || substr(md5('mix 7 ' || k), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM levels),
cells AS (
  SELECT *, -((size >> greatest(length(bin(size)) - 7, 0)) << greatest(length(bin(size)) - 7, 0)) AS q,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || text_md5), 1, 8) AS BIGINT) AS tie FROM sized),
dealt AS (
  SELECT *, tie % CAST(ceil(count(*) OVER (PARTITION BY k, q) / 4096.0) AS BIGINT) AS cell FROM cells),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY q, cell, size DESC, doc_id NULLS FIRST, tie) AS r FROM dealt),
rated AS (
  SELECT p.doc_id, p.size, s.source_size, s.target, s.u, p.r,
         CASE WHEN s.source_size > 0 THEN s.target / s.source_size ELSE 0.0::DOUBLE END AS rate
  FROM placed p JOIN rates s USING (k))
SELECT doc_id, size, source_size, target,
       CAST(least(floor(rate * r + u) - floor(rate * (r - 1) + u), ceil(rate)) AS BIGINT) * size AS taken
FROM rated
"""

CHAT_FORMAT = r"""
WITH turns AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
filled AS (
  SELECT *, coalesce(role, '') AS r, coalesce(text, '') AS t FROM turns),
sized AS (
  SELECT *, 2 * length(t) - length(replace(replace(replace(t, '\', ''), '<', ''), '[', '')) AS chars,
         CASE r WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 WHEN 'system' THEN 17
              ELSE 16 + 2 * length(r) - length(replace(replace(replace(replace(r, '\', ''), '<', ''), '[', ''), chr(10), ''))
         END AS marks FROM filled)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST))
         AS turns_sha256,
       CAST(sum(CASE WHEN r = 'assistant' THEN length(t) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN r = 'assistant' THEN t ELSE '' END, ''
                         ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)) AS loss_sha256,
       CAST(sum(chars + marks) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

EXACT_TOPK = r"""
WITH first AS (
  SELECT vec_id, min(embedding::DOUBLE[]) AS v FROM embeddings
  WHERE len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
  GROUP BY vec_id),
whole AS (SELECT vec_id, list_transform(v, lambda x: floor(64 * x)) AS v FROM first),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM placed WHERE rank <= 20
"""


def _clusters(k: int = 40, rounds: int = 5, dim: int = 64) -> str:
    """Rounds of centroid clustering, written out one after the other over (vector, component) rows."""
    parts = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS x FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "flat AS MATERIALIZED (SELECT r, unnest(range(len(x))) AS i, unnest(x) AS x FROM kept)",
        f"""first AS (
  SELECT x, row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, x) - 1 AS c FROM kept ORDER BY c LIMIT {k})""",
        "c0 AS MATERIALIZED (SELECT c, unnest(range(len(x))) AS i, unnest(x) AS x FROM first)",
    ]
    for n in range(rounds + 1):
        parts.append(
            f"""a{n} AS MATERIALIZED (
  SELECT r, min(d) AS d, arg_min(c, (d, c)) AS c FROM (
    SELECT r, c, CAST(sum((f.x - m.x) * (f.x - m.x)) AS BIGINT) AS d FROM flat f JOIN c{n} m USING (i) GROUP BY r, c) GROUP BY r)"""
        )
        if n < rounds:
            parts.append(
                f"""c{n + 1} AS MATERIALIZED (
  SELECT m.c, m.i, coalesce(s.x, m.x) AS x FROM c{n} m LEFT JOIN (
    SELECT c, i, CAST((t - ((t % n) + n) % n) // n AS BIGINT) AS x FROM (SELECT c, i, sum(x) AS t, count(*) AS n FROM flat JOIN a{n} USING (r) GROUP BY c, i)) s
  ON s.c = m.c AND s.i = m.i)"""
            )
    parts.append(f"digests AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS digest FROM c{rounds} GROUP BY c)")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, digest AS centroid_sha256
FROM a{rounds} a JOIN kept USING (r) JOIN digests USING (c)
"""


CLUSTERS = _clusters()

REPAIR = r"""
WITH RECURSIVE base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS cid,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations),
crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t
  FROM range(256) AS r(i)),
kinds AS (
  SELECT k, xor(list_reduce([CAST(ascii(ch) AS BIGINT) FOR ch IN string_split(k, '')],
                            lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295), 4294967295) % 20 AS kind
  FROM (SELECT DISTINCT k FROM base), crc_table),
damaged AS (
  SELECT cid, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM base JOIN kinds USING (k) WHERE kind <> 0),
numbered AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM damaged),
placed AS MATERIALIZED (
  SELECT cid, turn, role, text, left(role, 1) AS initial, i,
         NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         row_number() OVER (PARTITION BY cid, role, text ORDER BY i) > 1 AS again,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS open
  FROM numbered),
counted AS (
  SELECT cid, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank,
         count_if(again AND NOT blank) AS duplicate, count_if(open AND NOT blank AND NOT again) AS truncated, count(*) AS n
  FROM placed GROUP BY cid),
pairs AS (
  SELECT cid, count_if(before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT cid, initial, lag(initial) OVER (PARTITION BY cid ORDER BY i) AS before FROM placed) GROUP BY cid),
walks(cid, i, state, cost, audit, lines) AS (
  SELECT cid, CAST(0 AS BIGINT), 0, CAST(0 AS BIGINT), '', CAST([] AS VARCHAR[]) FROM counted
  UNION ALL
  SELECT cid, i, state, cost, audit, lines FROM (
    SELECT *, row_number() OVER (PARTITION BY cid, state ORDER BY cost, audit) AS place FROM (
      SELECT s.cid, p.i, CASE e.edit WHEN 'D' THEN s.state WHEN 'R' THEN CASE WHEN s.state = 2 THEN 3 ELSE 2 END
                              ELSE CASE p.initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END END AS state,
             s.cost + CASE e.edit WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END
                    + CASE WHEN e.edit <> 'D' AND p.open AND NOT p.blank THEN 1 ELSE 0 END AS cost,
             s.audit || e.edit AS audit,
             CASE e.edit WHEN 'D' THEN s.lines
                         WHEN 'R' THEN list_append(s.lines, CASE WHEN s.state = 2 THEN 'assistant:' ELSE 'user:' END || p.text)
                         ELSE list_append(s.lines, p.role || ':' || p.text) END AS lines
      FROM (
        SELECT cid, i, CASE more WHEN 0 THEN state WHEN 1 THEN CASE WHEN state = 2 THEN 3 ELSE 2 END
                                 ELSE CASE WHEN state = 2 THEN 2 ELSE 3 END END AS state,
               cost + 2 * more AS cost, audit || repeat('I', more) AS audit,
               list_concat(lines, CASE WHEN state = 2 THEN ['assistant:', 'user:'] ELSE ['user:', 'assistant:'] END[1:more]) AS lines
        FROM walks, (VALUES (0), (1), (2)) AS inserts(more)) s
      JOIN placed p ON p.cid = s.cid AND p.i = s.i + 1, (VALUES ('K'), ('R'), ('D')) AS e(edit)
      WHERE CASE e.edit WHEN 'D' THEN true WHEN 'R' THEN NOT (p.blank OR p.again)
            ELSE NOT (p.blank OR p.again) AND (p.initial = 's' AND s.state = 0 OR p.initial = 'u' AND s.state IN (0, 1, 3) OR p.initial = 'a' AND s.state = 2) END))
  WHERE place = 1),
ended AS (
  SELECT w.cid, cost + 2 * length(tail) AS cost, audit || tail AS audit,
         list_concat(lines, CASE tail WHEN '' THEN [] WHEN 'I' THEN ['assistant:'] ELSE ['user:', 'assistant:'] END) AS lines
  FROM (SELECT *, CASE state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS tail FROM walks) w JOIN counted c ON c.cid = w.cid AND c.n = w.i),
least AS (SELECT * FROM ended QUALIFY row_number() OVER (PARTITION BY cid ORDER BY cost, audit) = 1)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit,
       sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, cid FROM base) LEFT JOIN counted USING (cid) LEFT JOIN pairs USING (cid) LEFT JOIN least USING (cid)
"""
