"""DuckDB SQL for the queries that SQL can express."""

REPEATED_LINES = r"""
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS body, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents),
units AS (
  SELECT *, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm,
         sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY place) - length(line) - 1 AS start
  FROM lines),
ranked AS (
  SELECT *, norm <> '' AND row_number() OVER (PARTITION BY norm ORDER BY doc_id, place) > 1 AS gone FROM units)
SELECT doc_id, count(*) FILTER (norm <> '') AS n_units, count(*) FILTER (gone) AS n_removed,
       coalesce(string_agg(start || ':' || (start + length(line)), ',' ORDER BY place) FILTER (gone), '') AS removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS text_sha256
FROM ranked GROUP BY doc_id
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
                             lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
         ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
  FROM words),
each AS (SELECT doc_id, unnest(s) AS x FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM each a JOIN each b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE 100 * n >= 80 * (len(x.s) + len(y.s) - n)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, c) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT w.b, r.c FROM reach r JOIN ways w ON w.a = r.doc_id)
SELECT s.doc_id, CAST(len(any_value(s.s)) AS BIGINT) AS n_shingles, min(c) AS component_id, s.doc_id = min(c) AS kept
FROM sets s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id
"""



def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    bits = "list_reduce(range(8), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(c, b))"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT), lambda c, b: {bits}, 4294967295), 4294967295)"


NEAR_VECTORS = r"""
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach(vec_id, c) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.vec_id),
least AS (SELECT vec_id, min(c) AS component_id FROM reach GROUP BY vec_id),
degree AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least USING (vec_id) LEFT JOIN degree USING (vec_id)
"""

PERIODIC_RUNS = rf"""
WITH split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, {_crc32("doc_id::VARCHAR")} AS h
  FROM documents),
tails AS (SELECT doc_id, w, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM split),
spread AS (SELECT doc_id, n, a, 1 + (n - a) // (3 + g % 8) AS p, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM tails),
words AS (
  SELECT x.doc_id, x.n, x.i, y.word FROM spread x JOIN spread y
  ON x.doc_id = y.doc_id AND y.i = CASE WHEN x.i >= x.a THEN x.a + (x.i - x.a) % x.p ELSE x.i END),
same AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND (y.i - x.i) * 4 <= x.n),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same),
long AS (
  SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM islands GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (
  SELECT * FROM long x WHERE NOT EXISTS (SELECT 1 FROM long y WHERE y.doc_id = x.doc_id AND y.q < x.q AND y.s <= x.s AND y.s + y.l >= x.s + x.l)),
told AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS runs,
         min({{'l': -l, 's': s, 'q': q}}) AS best FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (
  SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS body FROM words w LEFT JOIN gone USING (doc_id, i) WHERE gone.i IS NULL GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, -best.l AS length, best.q AS period, 1000 * -best.l // best.q AS exponent_milli,
       sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
FROM split d LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def _conversation_repair() -> str:
    """A forward search: of all edits that lead to a state, the cheapest and then the ASCII-least, with the text that they leave."""
    def put(state: str, cost: str, edit: str, row: str = "''") -> str:
        return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 't': {state}.t || {row}}} END"

    def best(*ways: str) -> str:
        return f"list_sort([{', '.join(ways)}], 'ASC', 'NULLS LAST')[1]"

    def stay(state: str, initial: str, role: str) -> list[str]:
        kept = put(state, "(fault = 3)::BIGINT", "K", "chr(10) || role || ':' || text")
        given = put(state, "2 + (fault = 3)::BIGINT", "R", f"chr(10) || '{role}:' || text")
        return [f"CASE WHEN fault IN (0, 3) AND left(role, 1) = '{initial}' THEN {kept} END", f"CASE WHEN fault IN (0, 3) THEN {given} END"]

    gone = {k: put(f"b{k}", "3", "D") for k in range(4)}
    after = {0: gone[0], 1: best(gone[1], stay("b0", "s", "system")[0]), 2: best(gone[2], *[w for k in (0, 1, 3) for w in stay(f"b{k}", "u", "user")]),
             3: best(gone[3], *stay("b2", "a", "assistant"))}
    user, assistant = (lambda s, r=r: put(s, "2", "I", f"chr(10) || '{r}:'") for r in ("user", "assistant"))
    new2 = best("n2", user("n0"), user("n1"), user("n3"))
    none = "NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"
    return rf"""
WITH RECURSIVE told AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS way FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role,
         CASE way WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE way WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM told),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM damaged),
marked AS (
  SELECT *, regexp_extract(text, '([^ 	-])[ 	-]*$', 1) AS last,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) AS seen, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) || left(role, 1) AS pair
  FROM placed),
rows AS (
  SELECT *, CASE WHEN last = '' THEN 1 WHEN seen > 1 THEN 2 WHEN last NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM marked),
start AS (SELECT {{'c': 0::BIGINT, 'a': '', 't': ''}}::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS b),
walk AS (
  SELECT conv_id, 0::BIGINT AS k, b AS b0, {none} AS b1, {user("b")} AS b2, {put("(" + user("b") + ")", "2", "I", "chr(10) || 'assistant:'")} AS b3
  FROM (SELECT DISTINCT conv_id FROM conversations), start
  UNION ALL
  SELECT conv_id, k, n0, n1, m2, {best("n3", assistant("m2"))} FROM (
    SELECT *, {new2} AS m2 FROM (
      SELECT w.conv_id, r.k, {", ".join(f"{sql} AS n{k}" for k, sql in after.items())}
      FROM walk w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.k = w.k + 1))),
ends AS (SELECT conv_id, max(k) AS k FROM walk GROUP BY conv_id),
done AS (SELECT w.conv_id, {best("b0", "b3")} AS b FROM walk w JOIN ends e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.k = w.k),
sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
         count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id)
SELECT d.conv_id, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal"))}, b.c AS cost, b.a AS audit,
       sha256(substr(b.t, 2)) AS repaired_sha256
FROM done d LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM d.conv_id
"""


SQL = {"op4_near_duplicates": NEAR_DUPLICATES, "op10_repeated_lines": REPEATED_LINES, "op11_conversation_repair": _conversation_repair(),
       "op12_near_vectors": NEAR_VECTORS, "op13_periodic_runs": PERIODIC_RUNS}
