"""DuckDB SQL of every registered query, written independently of the Spark plans.

Tables are the pre-registered views of the benchmark parquet files. The SQL
follows the definitions (line-window forms for sections, bigram-count blocking
plus a list_reduce LCS for fuzzy matching), not the Spark physical design.
Non-integer literals are written as DOUBLE so that both engines compute in
binary floating point with the same operation order.
"""

from __future__ import annotations

from ..functions import stats
from . import catalog as C
from .inputs import EDGE_ANSWERS

Z = "CAST(1.96 AS DOUBLE)"
Z2 = f"CAST('{repr(stats.Z95 * stats.Z95)}' AS DOUBLE)"
Z2H = f"CAST('{repr(stats.Z95 * stats.Z95 / 2)}' AS DOUBLE)"
D0, D1, D2 = "CAST(0.0 AS DOUBLE)", "CAST(1.0 AS DOUBLE)", "CAST(2.0 AS DOUBLE)"
# The patterns of the answer parser and of trimming.
WS = r"'^\s+|\s+$'"
PROB = r"'\b0\.\d+|1\.0|0|1\b'"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def trim_ws(x: str) -> str:
    return f"regexp_replace({x}, {WS}, '', 'g')"


def clean(x: str) -> str:
    folded = f"regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]', '', 'g')"
    v = trim_ws(f"lower({folded})")
    v = f"regexp_replace({v}, '[_\\-]', ' ', 'g')"
    return f"regexp_replace({v}, '\\s+', ' ', 'g')"


_SCORE = "lpad(CAST((doc_id * 7919 + n_chars * 104729) % 1000000 AS VARCHAR), 6, '0')"
_EDGE = f"[{', '.join(lit(x) for x in EDGE_ANSWERS)}][CAST((doc_id // 6) % {len(EDGE_ANSWERS)} AS INTEGER) + 1]"
RESPONSES = f"""responses AS (
  SELECT doc_id, lang, n_chars,
    CASE doc_id % 6
      WHEN 0 THEN '0.' || {_SCORE}
      WHEN 1 THEN 'Confidence: 0.' || {_SCORE} || chr(10) || coalesce(text, '')
      WHEN 2 THEN CASE WHEN ((doc_id * 37 + n_chars) % 100) % 2 = 0 THEN '1' ELSE '0' END
      WHEN 3 THEN coalesce(text, '') || chr(10) || 'Probability: 0.' || {_SCORE}
      WHEN 4 THEN coalesce(text, '') || chr(10) || {_EDGE}
      ELSE {_EDGE} END AS response
  FROM documents)"""

SCORED = RESPONSES + f""",
parsed AS (
  SELECT doc_id, lang, response,
    TRY_CAST(NULLIF(regexp_extract({trim_ws('response')}, {PROB}, 0), '') AS DOUBLE) AS probability
  FROM responses),
scored AS (
  SELECT doc_id, lang, response, probability,
    CASE WHEN probability IS NOT NULL AND NOT isnan(probability) AND probability >= CAST(0.5 AS DOUBLE)
         THEN 1 ELSE 0 END AS relevance
  FROM parsed)"""

PAIRS = SCORED + """,
pairs AS (
  SELECT s.doc_id, s.lang, s.probability, l.quality AS y_true, s.relevance AS y_pred
  FROM scored s JOIN labels l ON s.doc_id = l.doc_id)"""

COUNTS = """SUM(CASE WHEN y_true = 1 AND y_pred = 1 THEN 1 ELSE 0 END)::BIGINT AS tp,
    SUM(CASE WHEN y_true = 0 AND y_pred = 1 THEN 1 ELSE 0 END)::BIGINT AS fp,
    SUM(CASE WHEN y_true = 0 AND y_pred = 0 THEN 1 ELSE 0 END)::BIGINT AS tn,
    SUM(CASE WHEN y_true = 1 AND y_pred = 0 THEN 1 ELSE 0 END)::BIGINT AS fn"""


def _ratio(num: str, den: str) -> str:
    return f"CASE WHEN {den} > 0 THEN ({num}) / ({den}) ELSE {D0} END"


def _wald(p: str, n: str) -> tuple[str, str]:
    se = f"sqrt({p} * ({D1} - {p}) / {n})"
    return (f"CASE WHEN {n} = 0 THEN {D0} ELSE greatest({D0}, {p} - {Z} * {se}) END",
            f"CASE WHEN {n} = 0 THEN {D0} ELSE least({D1}, {p} + {Z} * {se}) END")


def _ac(x: str, n: str) -> tuple[str, str]:
    nt = f"({n} + {Z2})"
    pt = f"(({x} + {Z2H}) / {nt})"
    se = f"sqrt({pt} * ({D1} - {pt}) / {nt})"
    return (f"CASE WHEN {n} = 0 THEN {D0} ELSE greatest({D0}, {pt} - {Z} * {se}) END",
            f"CASE WHEN {n} = 0 THEN {D0} ELSE least({D1}, {pt} + {Z} * {se}) END")


def metrics_sql(prefix: str, counts_select: str, keys: list[str], extra: list[str] = ()) -> str:
    """``prefix`` = WITH-list text ending without comma; counts_select yields keys + tp, fp, tn, fn."""
    k = "".join(f"{c}, " for c in keys)
    head = (prefix + ",\n") if prefix else ""
    wald = {
        "recall_ci": _wald("recall", "(dtp + dfn)"),
        "precision_ci": _wald("precision", "(dtp + dfp)"),
        "specificity_ci": _wald("specificity", "(dtn + dfp)"),
        "accuracy_ci": _wald("accuracy", "dtotal"),
        "balanced_accuracy_ci": _wald("balanced_accuracy", "dtotal"),
        "recall_ac_ci": _ac("dtp", "(dtp + dfn)"),
        "precision_ac_ci": _ac("dtp", "(dtp + dfp)"),
        "specificity_ac_ci": _ac("dtn", "(dtn + dfp)"),
        "accuracy_ac_ci": _ac("(dtp + dtn)", "dtotal"),
    }
    ci = ",\n    ".join(f"{lo} AS {n}_low, {hi} AS {n}_high" for n, (lo, hi) in wald.items())
    ext = "".join(f", {e}" for e in extra)
    return f"""WITH {head}cnt AS ({counts_select}),
m1 AS (SELECT *, CAST(tp AS DOUBLE) AS dtp, CAST(fp AS DOUBLE) AS dfp, CAST(tn AS DOUBLE) AS dtn,
              CAST(fn AS DOUBLE) AS dfn FROM cnt),
m2 AS (SELECT *, dtp + dfp + dtn + dfn AS dtotal,
    {_ratio('dtp', 'dtp + dfn')} AS recall,
    {_ratio('dtp', 'dtp + dfp')} AS precision,
    {_ratio('dtn', 'dtn + dfp')} AS specificity,
    {_ratio('dtp + dtn', 'dtp + dfp + dtn + dfn')} AS accuracy FROM m1),
m3 AS (SELECT *,
    CASE WHEN recall + specificity > 0 THEN (recall + specificity) / {D2} ELSE {D0} END AS balanced_accuracy,
    CASE WHEN precision + recall > 0 THEN {D2} * precision * recall / (precision + recall) ELSE {D0} END AS f1,
    CASE WHEN dtotal > 0 THEN (dtn + dfn) / dtotal ELSE {D0} END AS work_saved FROM m2),
m4 AS (SELECT *, work_saved - ({D1} - recall) AS wss,
    {ci} FROM m3)
SELECT {k}tp, fp, tn, fn, recall, precision, specificity, accuracy, balanced_accuracy, f1, work_saved, wss,
  recall_ci_low, recall_ci_high, precision_ci_low, precision_ci_high, specificity_ci_low, specificity_ci_high,
  accuracy_ci_low, accuracy_ci_high, balanced_accuracy_ci_low, balanced_accuracy_ci_high,
  recall_ac_ci_low, recall_ac_ci_high, precision_ac_ci_low, precision_ac_ci_high,
  specificity_ac_ci_low, specificity_ac_ci_high, accuracy_ac_ci_low, accuracy_ac_ci_high,
  (recall_ac_ci_low + specificity_ac_ci_low) / {D2} AS balanced_accuracy_ac_ci_low,
  (recall_ac_ci_high + specificity_ac_ci_high) / {D2} AS balanced_accuracy_ac_ci_high{ext}
FROM m4"""


SQL: dict[str, str] = {}

SQL["screening_metrics"] = metrics_sql(PAIRS, f"SELECT {COUNTS} FROM pairs", [])
SQL["screening_metrics_by_lang"] = metrics_sql(PAIRS, f"SELECT lang, {COUNTS} FROM pairs GROUP BY lang", ["lang"])
SQL["confusion_counts"] = f"""SELECT
    SUM(CASE WHEN quality = 1 AND toxic = 1 THEN 1 ELSE 0 END)::BIGINT AS tp,
    SUM(CASE WHEN quality = 0 AND toxic = 1 THEN 1 ELSE 0 END)::BIGINT AS fp,
    SUM(CASE WHEN quality = 0 AND toxic = 0 THEN 1 ELSE 0 END)::BIGINT AS tn,
    SUM(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END)::BIGINT AS fn
  FROM labels"""


def _long_report() -> str:
    inner = metrics_sql(PAIRS, f"SELECT {COUNTS} FROM pairs", [])
    rows = []
    for i, n in enumerate(["tp", "fp", "tn", "fn"]):
        rows.append(f"SELECT {i} AS ord, '{n}' AS metric, CAST({n} AS DOUBLE) AS value, "
                    f"CAST(NULL AS DOUBLE) AS ci_low, CAST(NULL AS DOUBLE) AS ci_high FROM mb")
    for j, n in enumerate(C.MT.POINT_METRICS):
        rows.append(f"SELECT {4 + j}, '{n}', {n}, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM mb")
    for k, n in enumerate(C.MT.INTERVALS):
        rows.append(f"SELECT {12 + k}, '{n}', CAST(NULL AS DOUBLE), {n}_low, {n}_high FROM mb")
    return f"WITH mb AS ({inner})\n" + "\nUNION ALL ".join(rows)


SQL["metric_report_long"] = _long_report()
_WALD_COLS = ", ".join(f"{n}_{e}" for n in C.MT.INTERVALS[:5] for e in ("low", "high"))
_AC_COLS = ", ".join(f"{n}_{e}" for n in C.MT.INTERVALS[5:] for e in ("low", "high"))
SQL["wald_intervals"] = (f"WITH mb AS ({metrics_sql(PAIRS, f'SELECT lang, {COUNTS} FROM pairs GROUP BY lang', ['lang'])})"
                         f"\nSELECT lang, tp, fp, tn, fn, {_WALD_COLS} FROM mb")
SQL["agresti_coull_intervals"] = (f"WITH mb AS ({metrics_sql(PAIRS, f'SELECT lang, {COUNTS} FROM pairs GROUP BY lang', ['lang'])})"
                                  f"\nSELECT lang, tp, fp, tn, fn, {_AC_COLS} FROM mb")
SQL["threshold_labels"] = f"WITH {SCORED}\nSELECT doc_id, probability, relevance FROM scored"


def _sweep() -> str:
    ts = ", ".join(f"(CAST({t!r} AS DOUBLE))" for t in C.THRESHOLDS)
    counts = """SELECT threshold,
    SUM(CASE WHEN y_true = 1 AND pred = 1 THEN 1 ELSE 0 END)::BIGINT AS tp,
    SUM(CASE WHEN y_true = 0 AND pred = 1 THEN 1 ELSE 0 END)::BIGINT AS fp,
    SUM(CASE WHEN y_true = 0 AND pred = 0 THEN 1 ELSE 0 END)::BIGINT AS tn,
    SUM(CASE WHEN y_true = 1 AND pred = 0 THEN 1 ELSE 0 END)::BIGINT AS fn
  FROM swept GROUP BY threshold"""
    prefix = PAIRS + f""",
ts(threshold) AS (VALUES {ts}),
swept AS (SELECT t.threshold, p.y_true,
    CASE WHEN p.probability IS NOT NULL AND NOT isnan(p.probability) AND p.probability >= t.threshold
         THEN 1 ELSE 0 END AS pred FROM pairs p, ts t)"""
    inner = metrics_sql(prefix, counts, ["threshold"])
    return (f"WITH mb AS ({inner})\nSELECT threshold, tp, fp, tn, fn, recall, precision, specificity, f1, "
            f"work_saved FROM mb")


SQL["threshold_sweep"] = _sweep()
SQL["false_negatives"] = (f"WITH {PAIRS}\nSELECT doc_id, lang, probability, y_true, y_pred FROM pairs "
                          f"WHERE y_true = 1 AND y_pred = 0")
SQL["label_domain_check"] = """WITH raw AS (
  SELECT CASE doc_id % 8 WHEN 1 THEN 2 WHEN 2 THEN 0.5 WHEN 3 THEN NULL ELSE quality END AS y_true,
         CASE doc_id % 8 WHEN 5 THEN -1 ELSE toxic END AS y_pred FROM labels)
SELECT COUNT(*) FILTER (WHERE y_true IS NULL OR y_true NOT IN (0, 1)) AS bad_y_true,
       COUNT(*) FILTER (WHERE y_pred IS NULL OR y_pred NOT IN (0, 1)) AS bad_y_pred FROM raw"""
SQL["distinct_labels"] = "SELECT DISTINCT quality FROM labels"
SQL["length_parity"] = ("SELECT (SELECT COUNT(*) FROM labels) AS n_human, (SELECT COUNT(*) FROM documents) AS n_ai, "
                        "(SELECT COUNT(*) FROM labels) = (SELECT COUNT(*) FROM documents) AS equal")
SQL["positional_pairing"] = f"""WITH {SCORED},
h AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, doc_id, quality AS y_true FROM labels),
a AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, doc_id, relevance AS y_pred
      FROM scored)
SELECT h.pos, h.y_true, h.doc_id AS human_doc_id, a.y_pred, a.doc_id AS ai_doc_id FROM h JOIN a ON h.pos = a.pos"""
SQL["parse_probability"] = f"WITH {SCORED}\nSELECT doc_id, response, probability FROM parsed"
SQL["parse_binary"] = (f"WITH {RESPONSES}\nSELECT doc_id, response, "
                       r"TRY_CAST(NULLIF(regexp_extract(response, '\b([01])\b', 1), '') AS INTEGER) AS label "
                       "FROM responses")

ANSWERS = f"""answers AS (
  SELECT event_id, CASE WHEN event_id % 40 = 5 THEN '[]' WHEN event_id % 40 = 9 THEN '{{}}' WHEN event_id % 40 = 13 THEN '7' ELSE CASE event_id % 4
    WHEN 0 THEN '```json' || chr(10) || props || chr(10) || '```'
    WHEN 1 THEN props
    WHEN 2 THEN '[' || props || ', {{"k": ' || CAST(event_id % 7 AS VARCHAR) || '}}]'
    ELSE 'oops ' || props END END AS output_text
  FROM events),
cleaned AS (
  SELECT event_id, output_text,
    {trim_ws(f"replace(replace({trim_ws('output_text')}, '```json', ''), '```', '')")} AS cleaned
  FROM answers),
typed AS (
  SELECT *, CASE WHEN json_valid(cleaned) THEN json_type(CAST(cleaned AS JSON)) END AS jt FROM cleaned)"""

SQL["json_fence_parse"] = f"""WITH {ANSWERS}
SELECT event_id, cleaned, COALESCE(json_valid(cleaned), false) AS is_valid,
  CASE WHEN jt IS NULL THEN NULL WHEN jt = 'ARRAY' THEN 'array' WHEN jt = 'OBJECT' THEN 'object' ELSE 'scalar' END AS kind
FROM typed"""
SQL["json_flatten"] = f"""WITH {ANSWERS},
items AS (
  SELECT event_id, CASE WHEN jt = 'ARRAY' THEN CAST(cleaned AS JSON[])
                        WHEN jt = 'OBJECT' AND len(json_keys(CAST(cleaned AS JSON))) > 0
                        THEN [CAST(cleaned AS JSON)] END AS arr
  FROM typed)
SELECT event_id, CAST(i - 1 AS INTEGER) AS rec_pos, TRY_CAST(json_extract(arr[i], '$.k') AS BIGINT) AS k
FROM (SELECT event_id, arr, generate_subscripts(arr, 1) AS i FROM items WHERE arr IS NOT NULL)"""
SQL["response_audit"] = f"""WITH {ANSWERS}
SELECT event_id, length(output_text) AS raw_length, substr(output_text, 1, 200) AS preview
FROM answers WHERE output_text IS NOT NULL AND length(output_text) > 0"""

CANDIDATES = """cand AS (SELECT doc_id AS row_id, split_part(text, chr(10), 1) AS title, text AS abstract, lang
  FROM documents)"""

SQL["first_n_candidates"] = (f"WITH {CANDIDATES}\nSELECT row_id, title, length(abstract) AS abstract_chars "
                             "FROM cand ORDER BY row_id LIMIT 5")
SQL["truncate_text"] = ("WITH long AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN repeat(text, 120000 // greatest(length(text), 1) + 1) "
                        "ELSE text END AS text FROM documents)\n"
                        "SELECT doc_id, length(substr(text, 1, 120000)) AS chars, md5(substr(text, 1, 120000)) AS digest FROM long")
SQL["length_stats"] = (f"WITH {CANDIDATES}\nSELECT lang, avg(length(title)) AS avg_title_chars, "
                       "avg(length(abstract)) AS avg_abstract_chars FROM cand GROUP BY lang")


def _prompt_sql() -> str:
    pr = C.PR
    head = pr.SCREENING_TASK + "\n\n" + C.criteria_block_text() + "\n\nInstructions:\n" + pr.SCREENING_ANSWER \
        + "\n\nTitle:\n"
    return (f"{lit(head)} || COALESCE(title, 'nan') || {lit(chr(10) + chr(10) + 'Abstract:' + chr(10))} || "
            f"COALESCE(abstract, 'nan') || chr(10)")


PROMPTS = CANDIDATES + f""",
prompts AS (SELECT row_id, {_prompt_sql()} AS prompt FROM cand)"""

SQL["render_prompt"] = f"WITH {PROMPTS}\nSELECT row_id, length(prompt) AS prompt_chars, md5(prompt) AS digest FROM prompts"

def _fulltext_prompt_sql() -> str:
    pr = C.PR
    head = pr.SCREENING_TASK + "\n\n" + C.criteria_block_text() + "\n\nInstructions:\n" + pr.SCREENING_ANSWER \
        + "\n\nFull text:\n"
    return f"{lit(head)} || substr(COALESCE(text, 'nan'), 1, 120000) || chr(10)"


def _extraction_prompt_sql() -> str:
    pr = C.PR
    head = pr.EXTRACTION_TASK + "\n\nFields:\n" + C.field_block_text() + "\n\nExample:\n" + C.EXAMPLE \
        + "\n\nStudy:\n"
    return f"{lit(head)} || COALESCE(text, 'nan') || chr(10)"


SQL["render_fulltext_prompt"] = (f"WITH p AS (SELECT doc_id AS row_id, {_fulltext_prompt_sql()} AS prompt FROM documents)\n"
                                 "SELECT row_id, length(prompt) AS prompt_chars, md5(prompt) AS digest FROM p")
SQL["render_extraction_prompt"] = (f"WITH p AS (SELECT doc_id AS row_id, {_extraction_prompt_sql()} AS prompt FROM documents)\n"
                                   "SELECT row_id, length(prompt) AS prompt_chars, md5(prompt) AS digest FROM p")

SCORES = PROMPTS + """,
s0 AS (SELECT row_id, length(prompt) AS L,
  CASE row_id % 50 WHEN 7 THEN 'Error code: 429 - rate_limit_exceeded'
                   WHEN 13 THEN 'Request timeout while reading response'
                   WHEN 29 THEN 'invalid request: context too long' END AS error FROM prompts),
scores AS (SELECT row_id,
  CASE WHEN error IS NULL THEN '0.' || lpad(CAST((row_id * 37 + L) % 100 AS VARCHAR), 2, '0') END AS output_text,
  CASE WHEN error IS NULL THEN L // 4 + 1 ELSE 0 END::BIGINT AS input_tokens,
  CASE WHEN error IS NULL THEN 3 ELSE 0 END::BIGINT AS output_tokens,
  CASE WHEN error IS NULL THEN L // 4 + 4 ELSE 0 END::BIGINT AS total_tokens,
  error FROM s0),
classed AS (SELECT *, CASE WHEN error IS NULL THEN NULL
    WHEN error LIKE '%429%' OR lower(error) LIKE '%rate_limit%' THEN 'rate_limit'
    WHEN lower(error) LIKE '%timeout%' OR lower(error) LIKE '%connection%' THEN 'network'
    ELSE 'other' END AS error_class FROM scores)"""

SQL["score_batch"] = f"WITH {SCORES}\nSELECT row_id, output_text, input_tokens, output_tokens, total_tokens, error FROM scores"
SQL["error_classes"] = (f"WITH {SCORES}\nSELECT error_class, COUNT(*) AS failed FROM classed "
                        "WHERE error IS NOT NULL GROUP BY error_class")
SQL["dead_letter"] = f"WITH {SCORES}\nSELECT row_id, error, error_class FROM classed WHERE error IS NOT NULL"
SQL["shard_round_robin"] = (f"SELECT doc_id AS row_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) % {C.SHARDS} "
                            "AS INTEGER) AS shard FROM documents")
SQL["token_totals"] = (f"WITH {SCORES}\nSELECT SUM(input_tokens)::BIGINT AS input_tokens, "
                       "SUM(output_tokens)::BIGINT AS output_tokens, SUM(total_tokens)::BIGINT AS total_tokens, "
                       "COUNT(*) AS rows, COUNT(*) FILTER (WHERE error IS NOT NULL) AS failed FROM scores")
RUNNING = SCORES + """,
running AS (SELECT row_id, row_number() OVER w AS completed,
  SUM(input_tokens) OVER w AS cum_input_tokens, SUM(output_tokens) OVER w AS cum_output_tokens,
  SUM(total_tokens) OVER w AS cum_total_tokens
  FROM scores WINDOW w AS (ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
SQL["token_running"] = (f"WITH {RUNNING}\nSELECT row_id, completed, cum_input_tokens::BIGINT AS cum_input_tokens, "
                        "cum_output_tokens::BIGINT AS cum_output_tokens, cum_total_tokens::BIGINT AS cum_total_tokens "
                        "FROM running")
SQL["checkpoint_rows"] = (f"WITH {RUNNING}\nSELECT row_id, completed, cum_total_tokens::BIGINT AS cum_total_tokens "
                          f"FROM running WHERE completed % {C.CHECKPOINT_EVERY} = 0")
SQL["csv_candidates"] = ("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, "
                         "length(split_part(text, chr(10), 1)) AS title_chars, length(text) AS abstract_chars, "
                         "md5(text) AS digest FROM documents")
SQL["skip_existing"] = "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"

SQL["clean_values"] = (f"SELECT doc_id, length({clean('text')}) AS chars, md5({clean('text')}) AS digest "
                       "FROM documents")
SQL["normalize_doi"] = f"SELECT page_id, {trim_ws('replace(replace(lower(url), \'.\', \'_\'), \'/\', \'_\')')} AS doi_norm FROM pages"
SQL["normalize_title"] = (f"WITH {CANDIDATES}\nSELECT row_id, COALESCE({trim_ws('lower(title)')}, '') AS title_norm "
                          "FROM cand")
SQL["normalize_list"] = (f"SELECT p_partkey, to_json(list_sort(list_transform(string_split(p_name || ' ' || p_type, ' '), "
                         f"lambda x: {clean('x')}))) AS tokens FROM part")

# --- extraction -------------------------------------------------------------

_NAME_AI = "CASE WHEN p_partkey % 5 = 0 THEN upper(replace(p_name, ' ', '_')) ELSE p_name END"
_BRAND_AI = "CASE WHEN p_partkey % 4 = 0 THEN replace(p_brand, '#', '-') ELSE p_brand END"
_SIZE_AI = "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END"
_WORDS_AI = "CASE WHEN p_partkey % 9 = 0 THEN []::VARCHAR[] ELSE list_reverse(string_split(p_name, ' ')) END"
_TYPE_AI = "CASE WHEN p_partkey % 8 = 3 THEN p_type || ' GRADE' ELSE p_type END"

RECORDS = f"""g_rec AS (
  SELECT CAST(p_partkey AS VARCHAR) AS record_id, p_partkey AS pos, p_name AS name, p_brand AS brand,
         p_type AS type, p_size AS size, string_split(p_name, ' ') AS words FROM part),
a_key AS (SELECT *, CASE WHEN p_partkey % 11 = 0 THEN -2 * p_partkey - 2 ELSE p_partkey END AS key_ai FROM part),
a_all AS (
  SELECT {clean('CAST(key_ai AS VARCHAR)')} AS record_id, p_partkey * 4 + 1 AS pos, {_NAME_AI} AS name, {_BRAND_AI} AS brand,
         {_TYPE_AI} AS type, {_SIZE_AI} AS size, {_WORDS_AI} AS words FROM a_key
  UNION ALL
  SELECT {clean('CAST(key_ai AS VARCHAR)')}, p_partkey * 4, {_NAME_AI}, {_BRAND_AI}, 'WRONG', {_SIZE_AI}, {_WORDS_AI}
  FROM a_key WHERE p_partkey % 13 = 0
  UNION ALL
  SELECT {clean('CAST(-2 * p_partkey - 1 AS VARCHAR)')}, p_partkey * 4 + 2, p_name, p_brand, p_type, p_size,
         string_split(p_name, ' ') FROM part WHERE p_partkey % 17 = 0),
a_rec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY pos DESC) AS rn FROM a_all)
          WHERE rn = 1)"""


def _long(src: str) -> str:
    def s(col):
        return f"'s:' || COALESCE({clean(f'CAST({col} AS VARCHAR)')}, '')"
    arr = f"'a:' || to_json(list_sort(list_transform(words, lambda x: {clean('COALESCE(x, ' + lit('None') + ')')})))"
    return (f"SELECT record_id, 'name' AS field, {s('name')} AS value FROM {src} UNION ALL "
            f"SELECT record_id, 'brand', {s('brand')} FROM {src} UNION ALL "
            f"SELECT record_id, 'type', {s('type')} FROM {src} UNION ALL "
            f"SELECT record_id, 'size', {s('size')} FROM {src} UNION ALL "
            f"SELECT record_id, 'words', CASE WHEN words IS NULL THEN 's:' ELSE {arr} END FROM {src}")


def _cells(lenient: bool = False) -> str:
    exact = "hv = av"
    if lenient:
        th = "list_filter(string_split(substr(hv, 3), ' '), lambda t: t <> '')"
        ta = "list_filter(string_split(substr(av, 3), ' '), lambda t: t <> '')"
        sub = (f"(len(list_filter({th}, lambda u: NOT list_contains({ta}, u))) = 0 OR "
               f"len(list_filter({ta}, lambda u: NOT list_contains({th}, u))) = 0)")
        exact = f"CASE WHEN field = 'type' THEN hv = av OR {sub} ELSE hv = av END"
    return f"""{RECORDS},
h_long AS ({_long('g_rec')}),
a_long AS ({_long('a_rec')}),
j AS (SELECT COALESCE(h.record_id, a.record_id) AS record, COALESCE(h.field, a.field) AS field,
             COALESCE(h.value, 's:') AS hv, COALESCE(a.value, 's:') AS av
      FROM h_long h FULL OUTER JOIN a_long a ON h.record_id = a.record_id AND h.field = a.field),
cells AS (SELECT record, field, substr(hv, 3) AS human, substr(av, 3) AS ai, {exact} AS correct FROM j)"""


SQL["dedup_last_wins"] = f"WITH {RECORDS}\nSELECT record_id, pos AS rec_pos, type FROM a_rec"
SQL["key_union"] = f"WITH {RECORDS}\nSELECT record_id FROM g_rec UNION SELECT record_id FROM a_all"
SQL["key_intersection"] = f"WITH {RECORDS}\nSELECT record_id FROM g_rec INTERSECT SELECT record_id FROM a_all"
SQL["extraction_cells"] = f"WITH {_cells()}\nSELECT record, field, human, ai, correct FROM cells"
SQL["extraction_metrics"] = metrics_sql(
    _cells(), "SELECT COUNT(*) FILTER (WHERE correct) AS tp, 0::BIGINT AS fp, 0::BIGINT AS tn, "
              "COUNT(*) FILTER (WHERE NOT correct) AS fn FROM cells", [])
SQL["extraction_errors"] = f"WITH {_cells()}\nSELECT record, field, human, ai, correct FROM cells WHERE NOT correct"
SQL["error_preview"] = (f"WITH {_cells()}\nSELECT record, field, human, ai, correct FROM cells WHERE NOT correct "
                        "ORDER BY record, field LIMIT 5")
SQL["field_accuracy"] = (f"WITH {_cells()}\nSELECT field, avg(CAST(correct AS INTEGER)) AS accuracy FROM cells "
                         "GROUP BY field")
SQL["study_accuracy"] = (f"WITH {_cells()},\nper AS (SELECT record, bool_and(correct) AS ok FROM cells GROUP BY record)\n"
                         "SELECT avg(CAST(ok AS INTEGER)) AS study_accuracy, COUNT(*) AS records FROM per")
SQL["extraction_coverage"] = f"""WITH {RECORDS},
hk AS (SELECT DISTINCT record_id FROM g_rec), ak AS (SELECT DISTINCT record_id FROM a_all),
j AS (SELECT hk.record_id AS h, ak.record_id AS a FROM hk FULL OUTER JOIN ak ON hk.record_id = ak.record_id)
SELECT COUNT(h) AS human_records, COUNT(a) AS ai_records, COUNT(*) AS union_records,
  COUNT(*) FILTER (WHERE h IS NOT NULL AND a IS NOT NULL) AS matched_records,
  CAST(COUNT(*) FILTER (WHERE h IS NOT NULL AND a IS NOT NULL) AS DOUBLE) / CAST(COUNT(h) AS DOUBLE) AS coverage
FROM j"""
SQL["extraction_counts"] = f"""WITH {_cells()},
hk AS (SELECT DISTINCT record_id FROM g_rec), ak AS (SELECT DISTINCT record_id FROM a_all)
SELECT (SELECT COUNT(*) FROM g_rec) AS human_loaded, (SELECT COUNT(*) FROM a_all) AS ai_loaded,
  (SELECT COUNT(*) FROM hk) AS human_records, (SELECT COUNT(*) FROM ak) AS ai_records,
  (SELECT COUNT(*) FROM (SELECT record_id FROM hk UNION SELECT record_id FROM ak)) AS union_records,
  (SELECT COUNT(*) FROM cells) AS cells, (SELECT COUNT(*) FROM cells WHERE NOT correct) AS errors,
  (SELECT COUNT(*) FROM hk WHERE record_id IN (SELECT record_id FROM ak)) AS matched_records"""
SQL["extraction_lenient"] = (f"WITH {_cells(True)}\nSELECT field, avg(CAST(correct AS INTEGER)) AS accuracy FROM cells "
                             "GROUP BY field")

# --- match cascade ------------------------------------------------------------

LCS = """list_reduce(string_split(b, ''), lambda prev, ch:
  list_reduce(range(1, length(a) + 1), lambda acc, j:
    list_append(acc, CASE WHEN substr(a, j::int, 1) = ch THEN prev[j] + 1
                          ELSE greatest(acc[-1], prev[j + 1]) END), [0::bigint]),
  list_resize([0::bigint], length(a) + 1, 0::bigint))[-1]"""


def _tsort(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN '' ELSE array_to_string(list_sort(regexp_split_to_array({x}, '\\s+')), ' ') END"


def _bigrams(src: str, name: str) -> str:
    return (f"{name} AS (SELECT s, bg, COUNT(*) AS c FROM (SELECT s, substr(s, i::int, 2) AS bg "
            f"FROM (SELECT s, unnest(range(1, length(s))) AS i FROM {src})) GROUP BY s, bg)")


def _fuzzy_hits(left: str, right: str, name: str) -> str:
    """CTEs ending in ``name``(s): distinct left strings with a right string at ratio >= threshold.
    Blocking: shared bigram multiset >= 0.35*S - 1 (20*shared >= 7*S - 20) and the length rule."""
    t = C.FUZZY_THRESHOLD
    return f"""{name}_l AS (SELECT DISTINCT s FROM {left}),
{name}_r AS (SELECT DISTINCT s FROM {right}),
{_bigrams(name + '_l', name + '_lb')},
{_bigrams(name + '_r', name + '_rb')},
{name}_cand AS (
  SELECT l.s AS a, r.s AS b FROM {name}_lb l JOIN {name}_rb r ON l.bg = r.bg
  GROUP BY l.s, r.s
  HAVING 20 * SUM(least(l.c, r.c)) >= 7 * (length(l.s) + length(r.s)) - 20
     AND 200 * least(length(l.s), length(r.s)) >= {t} * (length(l.s) + length(r.s))),
{name}_ver AS (SELECT a, b, {LCS} AS lcs FROM {name}_cand),
{name}(s) AS (
  SELECT a FROM {name}_ver
  WHERE 100 * ((length(a) + length(b)) - 2 * lcs) <= {100 - t} * (length(a) + length(b))
  UNION SELECT s FROM {name}_l WHERE s IN (SELECT s FROM {name}_r))"""


_OWN = "p_type || ' ' || substr(md5(CAST(p_partkey AS VARCHAR)), 1, 14)"
CASCADE = f"""g AS (SELECT p_partkey AS paper_id, p_name || ' ' || {_OWN} AS title, '10.' || CAST(p_partkey AS VARCHAR) || '/x' AS doi
      FROM part),
a AS (SELECT p_partkey AS ai_id, CASE p_partkey % 4
        WHEN 0 THEN '  ' || upper(p_name || ' ' || {_OWN}) || ' '
        WHEN 1 THEN substr(p_name, 2) || ' ' || {_OWN}
        WHEN 2 THEN '10_' || CAST(p_partkey AS VARCHAR) || '_x'
        ELSE 'unrelated ' || CAST(p_partkey AS VARCHAR) END AS title,
      CAST(p_size % 2 AS INTEGER) AS y_pred FROM part),
gn AS (SELECT *, COALESCE({trim_ws('lower(title)')}, '') AS title_norm,
        {trim_ws("replace(replace(lower(doi), '.', '_'), '/', '_')")} AS doi_norm FROM g),
gt AS (SELECT DISTINCT title_norm FROM gn),
gs AS (SELECT DISTINCT {_tsort('title_norm')} AS s FROM gt),
an AS (SELECT *, COALESCE({trim_ws('lower(title)')}, '') AS title_norm,
        {trim_ws("replace(replace(lower(title), '.', '_'), '/', '_')")} AS doi_norm FROM a),
af AS (SELECT *, length(doi_norm) > 0 AND doi_norm IN (SELECT doi_norm FROM gn WHERE doi_norm IS NOT NULL) AS id_hit,
        title_norm IN (SELECT title_norm FROM gt) AS exact_hit, {_tsort('title_norm')} AS title_sorted FROM an),
todo AS (SELECT title_sorted AS s FROM af WHERE NOT id_hit AND NOT exact_hit),
{_fuzzy_hits('todo', 'gs', 'fz')},
casc AS (SELECT af.*, CASE WHEN id_hit THEN 'id' WHEN exact_hit THEN 'exact'
                       WHEN title_sorted IN (SELECT s FROM fz) THEN 'fuzzy' ELSE 'none' END AS match_kind FROM af),
res AS (SELECT *, CASE WHEN match_kind <> 'none' THEN 1 ELSE 0 END AS y_true FROM casc)"""

SQL["doi_match"] = f"WITH {CASCADE}\nSELECT ai_id, doi_norm FROM res WHERE match_kind = 'id'"
SQL["title_match"] = f"WITH {CASCADE}\nSELECT ai_id, title_norm FROM res WHERE match_kind = 'exact'"
SQL["fuzzy_match"] = f"WITH {CASCADE}\nSELECT ai_id, title_sorted FROM res WHERE match_kind = 'fuzzy'"
SQL["match_cascade"] = f"WITH {CASCADE}\nSELECT ai_id, match_kind, y_true, y_pred FROM res"
_PAD = """SELECT COUNT(*) FILTER (WHERE y_true = 1 AND y_pred = 1) AS tp,
    COUNT(*) FILTER (WHERE y_true = 0 AND y_pred = 1) AS fp,
    COUNT(*) FILTER (WHERE y_true = 0 AND y_pred = 0) AS tn,
    COUNT(*) FILTER (WHERE y_true = 1 AND y_pred = 0)
      + greatest((SELECT COUNT(*) FROM g) - COUNT(*) FILTER (WHERE y_true = 1), 0) AS fn,
    greatest((SELECT COUNT(*) FROM g) - COUNT(*) FILTER (WHERE y_true = 1), 0) AS padding FROM res"""
SQL["fuzzy_metrics"] = metrics_sql(CASCADE, _PAD, [], ["padding"])
SQL["unmatched_padding"] = f"""WITH {CASCADE},
gfz_src AS (SELECT {_tsort('title_norm')} AS s FROM gn),
fz_ai AS (SELECT title_sorted AS s FROM res WHERE match_kind = 'fuzzy'),
{_fuzzy_hits('gfz_src', 'fz_ai', 'gz')},
un AS (SELECT * FROM gn
       WHERE NOT (doi_norm IN (SELECT doi_norm FROM res WHERE match_kind = 'id'))
         AND NOT (title_norm IN (SELECT title_norm FROM res WHERE match_kind = 'exact'))
         AND NOT ({_tsort('title_norm')} IN (SELECT s FROM gz)))
SELECT greatest((SELECT COUNT(*) FROM g) - (SELECT COUNT(*) FROM res WHERE y_true = 1), 0) AS padding,
  (SELECT COUNT(*) FROM res WHERE y_true = 1) AS matched, (SELECT COUNT(*) FROM g) AS n_golden,
  (SELECT COUNT(*) FROM un) AS unmatched_human"""
SQL["false_negatives_ai"] = f"WITH {CASCADE}\nSELECT ai_id, title FROM res WHERE y_true = 1 AND y_pred = 0"

# --- sections -----------------------------------------------------------------

_NORM = r"regexp_replace(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]', chr(10), 'g')"


def _lines(src: str, key: str) -> str:
    return f"""nt AS (SELECT {key} AS id, {_NORM} AS t FROM {src}),
arr AS (SELECT id, CASE WHEN t = '' THEN []::VARCHAR[]
                     ELSE string_split(regexp_replace(t, '\\n$', ''), chr(10)) END AS ls FROM nt),
lines AS (SELECT id, i, ls[i] AS line FROM (SELECT id, ls, generate_subscripts(ls, 1) AS i FROM arr))"""


_HDR = rf"""lower(COALESCE(
    NULLIF(regexp_extract({trim_ws('line')}, '^#+\s+(.*)$', 1), ''),
    NULLIF(regexp_extract({trim_ws('line')}, '^\*\*(.+?)\*\*$', 1), ''),
    CASE WHEN regexp_matches({trim_ws('line')}, '^\pL{{1,39}}$') THEN {trim_ws('line')} END))"""

PAPERS = """papers AS (SELECT doc_id, CASE doc_id % 5
    WHEN 0 THEN '# Methods' || chr(10) || text || chr(10) || '## Funding' || chr(10) || 'somebody paid' || chr(10) || chr(10) || '# Results' || chr(10) || 'found'
    WHEN 1 THEN text || chr(10) || '# References' || chr(10) || 'first' || chr(10) || '# Results' || chr(10) || 'lost'
    WHEN 2 THEN '**Acknowledgements**' || chr(10) || 'thanks' || chr(10) || 'for all' || chr(10) || text || chr(10) || 'Discussion' || chr(10) || 'end'
    WHEN 3 THEN 'Supplementary' || chr(10) || 'more' || chr(10) || '#### ' || chr(10) || 'rest' || chr(10) || text
    ELSE text END AS text FROM documents)"""

SQL["split_lines"] = f"WITH {_lines('documents', 'doc_id')}\nSELECT id AS doc_id, CAST(i AS INTEGER) AS line_no, length(line) AS chars FROM lines"
SQL["detect_headers"] = (f"WITH {PAPERS},\n{_lines('papers', 'doc_id')},\nh AS (SELECT id, i, {_HDR} AS header FROM lines)\n"
                         "SELECT id AS doc_id, CAST(i AS INTEGER) AS line_no, header FROM h WHERE header IS NOT NULL")


def _drop(src: str, key: str, drop: list[str]) -> str:
    cond = " OR ".join(f"contains(cur, {lit(w)})" for w in drop)
    return f"""WITH {_lines(src, key)},
h AS (SELECT id, i, line, {_HDR} AS header FROM lines),
w AS (SELECT *, last_value(header IGNORE NULLS) OVER (PARTITION BY id ORDER BY i
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cur,
             min(CASE WHEN contains(header, 'references') THEN i END) OVER (PARTITION BY id) AS stop FROM h),
kept AS (SELECT id, string_agg(line, chr(10) ORDER BY i) AS out FROM w
         WHERE (stop IS NULL OR i < stop) AND (cur IS NULL OR NOT ({cond})) GROUP BY id),
allids AS (SELECT {key} AS id FROM {src})
SELECT a.id AS {key}, length(COALESCE(k.out, '')) AS chars, md5(COALESCE(k.out, '')) AS digest
FROM allids a LEFT JOIN kept k ON a.id = k.id"""


CONV_MD = """convmd AS (SELECT conv_id, string_agg('## ' || role || chr(10) || text, chr(10) ORDER BY turn) AS text
  FROM conversations GROUP BY conv_id)"""

SQL["drop_sections"] = _drop("papers", "doc_id", C.SE.DEFAULT_DROP).replace("WITH ", f"WITH {PAPERS},\n", 1)
SQL["drop_sections_markdown"] = _drop("convmd", "conv_id", ["system"]).replace("WITH ", f"WITH {CONV_MD},\n", 1)


def _keep(keywords: list[str]) -> str:
    kw = ", ".join(lit(k) for k in keywords)
    core = trim_ws(f"regexp_replace({trim_ws('line')}, '^\\*+|\\*+$', '', 'g')")
    return f"""WITH {CONV_MD},
{_lines('convmd', 'conv_id')},
c AS (SELECT id, i, line, {trim_ws('line')} AS s, {core} AS core FROM lines),
f AS (SELECT *, starts_with(s, '#') OR (
        (CASE WHEN core = '' THEN 0 ELSE len(regexp_split_to_array(core, '\\s+')) END) <= 5
        AND NOT regexp_matches(core, '[.:,;]')
        AND ((upper(core) = core AND lower(core) <> core) OR list_contains([{kw}], lower(core)))) AS is_h FROM c),
n AS (SELECT *, SUM(CASE WHEN is_h THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sec,
             SUM(CASE WHEN is_h THEN 1 ELSE 0 END) OVER (PARTITION BY id) AS nsec FROM f),
secs AS (SELECT id, sec, max(nsec) AS nsec,
           max(CASE WHEN is_h THEN {trim_ws("regexp_replace(line, '^[#* ]+|[#* ]+$', '', 'g')")} END) AS header,
           COALESCE({trim_ws("string_agg(CASE WHEN NOT is_h THEN line END, chr(10) ORDER BY i)")}, '') AS body,
           COUNT(*) FILTER (WHERE NOT is_h) AS nbody
         FROM n WHERE sec > 0 GROUP BY id, sec),
good AS (SELECT * FROM secs WHERE header <> '' AND (sec < nsec OR nbody > 0)
           AND len(list_filter([{kw}], lambda k: contains(lower(header), k))) > 0),
out AS (SELECT id, string_agg('## ' || header || chr(10) || body, chr(10) || chr(10) ORDER BY sec) AS out
        FROM good GROUP BY id)
SELECT m.conv_id, length(COALESCE(o.out, '')) AS chars, md5(COALESCE(o.out, '')) AS digest
FROM convmd m LEFT JOIN out o ON m.conv_id = o.id"""


SQL["keep_sections"] = _keep(C.KEEP_ROLES)
SQL["stream_confusion"] = f"WITH {PAIRS}\nSELECT {COUNTS} FROM pairs"


def _int_lengths(sql: str, names=("raw_length", "abstract_chars", "title_chars", "chars", "prompt_chars")) -> str:
    """``length(...) AS name`` → ``CAST(length(...) AS INTEGER) AS name`` (Spark's length is INT)."""
    for name in names:
        marker = f") AS {name}"
        start = 0
        while True:
            i = sql.find(marker, start)
            if i < 0:
                break
            depth, j = 0, i
            while j >= 0:
                if sql[j] == ")":
                    depth += 1
                elif sql[j] == "(":
                    depth -= 1
                    if depth == 0:
                        break
                j -= 1
            if sql[j - 6:j] == "length":
                sql = sql[:j - 6] + "CAST(" + sql[j - 6:i + 1] + " AS INTEGER)" + sql[i + 1:]
                i += len("CAST(") + len(" AS INTEGER)")
            start = i + len(marker)
    return sql


SQL = {k: _int_lengths(v) for k, v in SQL.items()}
SQL["normalize_list"] = SQL["normalize_list"].replace(") AS tokens FROM part", ")::VARCHAR AS tokens FROM part")

# Sources and sinks: what was written is what is read.
SQL["semicolon_csv"] = "SELECT conv_id, turn, role, md5(text) AS digest FROM conversations"
SQL["json_records"] = """SELECT row_number() OVER (PARTITION BY p_partkey // 500 ORDER BY p_partkey) - 1 AS rec_pos, p_partkey, p_name,
  p_size, split_part(p_type, ' ', 1) AS first_word FROM part"""
SQL["json_lines"] = "SELECT page_id, url, md5(html) AS digest FROM pages"
SQL["null_columns"] = "SELECT doc_id AS row_id, true AS no_relevance, true AS no_probability FROM documents"
SQL["concat_rows"] = """SELECT p_partkey AS key, p_name AS name, p_size AS size, CAST(NULL AS DOUBLE) AS balance FROM part
UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier"""
SQL["threshold_files"] = f"""WITH {SCORED}, t AS (SELECT unnest({C.STAMPS!r}::DOUBLE[]) AS threshold)
SELECT doc_id, threshold, CASE WHEN probability >= threshold THEN 1 ELSE 0 END AS relevance FROM scored, t"""
SQL["extraction_status"] = f"""WITH found AS ({SQL["json_flatten"]})
SELECT count(*) AS records, 'ok' AS status, 'all' AS run FROM found
UNION ALL SELECT 0, 'no records extracted', 'none'"""
SQL["raw_responses"] = f"""WITH {SCORES}
SELECT row_id, output_text, CAST(output_text AS DOUBLE) AS probability FROM scores"""
SQL["metric_report_text"] = f"""WITH mb AS ({SQL["screening_metrics"]}), long AS ({SQL["metric_report_long"]})
SELECT unnest(['truth,predicted 0,predicted 1', '0,' || tn || ',' || fp, '1,' || fn || ',' || tp, 'false negatives: ' || fn]) AS line FROM mb
UNION ALL SELECT CASE WHEN ord < 4 THEN metric || ': ' || CAST(CAST(value AS BIGINT) AS VARCHAR) 
  WHEN ord < 12 THEN printf('%s: %.4f', metric, value) ELSE printf('%s: (%.6f, %.6f)', metric, ci_low, ci_high) END
FROM long"""
SQL["extraction_report_text"] = f"""WITH e AS ({SQL["extraction_errors"]}), f AS ({SQL["field_accuracy"]}), s AS ({SQL["study_accuracy"]})
SELECT 1000 AS ord, 'errors: ' || (SELECT count(*) FROM e) AS line
UNION ALL SELECT 2000, printf('%s: %.4f', field, accuracy) FROM f
UNION ALL SELECT 3000, printf('study accuracy: %.4f', study_accuracy) FROM s"""


def _recovered(ids: str) -> str:
    """Answers when the service is back for the rows ``ids``: the failed ones are scored as their neighbours."""
    return f"""SELECT row_id, '0.' || lpad(CAST(((row_id + 1) * 37 + L) % 100 AS VARCHAR), 2, '0') AS output_text,
  CAST(L // 4 + 1 AS BIGINT) AS input_tokens, CAST(3 AS BIGINT) AS output_tokens, CAST(L // 4 + 4 AS BIGINT) AS total_tokens,
  CAST(NULL AS VARCHAR) AS error FROM s0 WHERE {ids}"""


SQL["retry_failed"] = f"""WITH {SCORES}
SELECT row_id, output_text, input_tokens, output_tokens, total_tokens, error FROM scores WHERE row_id % 50 NOT IN (7, 13)
UNION ALL {_recovered("row_id % 50 IN (7, 13)")}"""
SQL["score_resume"] = SQL["retry_failed"]
SQL["wss_at_recall"] = f"""WITH {PAIRS}, counted AS (
  SELECT coalesce(probability, -1) AS score, count(*) AS n, sum(y_true) AS pos FROM pairs GROUP BY 1),
cum AS (SELECT sum(n) OVER (ORDER BY score DESC) AS read, sum(pos) OVER (ORDER BY score DESC) AS found, sum(n) OVER () AS total,
  sum(pos) OVER () AS relevant FROM counted), t AS (SELECT unnest([0.8, 0.9, 0.95, 1.0]::DOUBLE[]) AS target)
SELECT target, CAST(min(read) AS BIGINT) AS read, CAST(total AS BIGINT) AS total,
  (CAST(total AS DOUBLE) - CAST(min(read) AS DOUBLE)) / CAST(total AS DOUBLE) - (CAST(1 AS DOUBLE) - target) AS wss
FROM cum, t WHERE found >= target * relevant GROUP BY target, total, relevant"""

# --- documents as files, records without declared fields -------------------------
_FOLDER = r"""files AS (
  SELECT doc_id, 'doc_' || doc_id AS title, CASE WHEN doc_id % 7 = 5 THEN '' ELSE coalesce(text, '') END AS body,
         doc_id % 7 = 3 AND regexp_full_match(coalesce(text, ''), '[\x00-\x7F\x{A0}-\x{FF}]*') AS latin FROM documents)"""
SQL["markdown_folder"] = f"WITH {_FOLDER} SELECT title, length(body) AS chars, md5(body) AS digest FROM files WHERE body <> ''"  # files of no bytes are passed over
SQL["latin1_documents"] = rf"""WITH {_FOLDER}, others AS (SELECT title, regexp_replace(body, '[\x00-\x7F]', '', 'g') AS other FROM files)
SELECT title, length(other) AS n_other, md5(other) AS digest FROM others WHERE other <> ''"""
SQL["document_listing"] = f"""WITH {_FOLDER} SELECT title AS stem, CASE WHEN latin THEN length(body) ELSE octet_length(encode(body)) END AS length
FROM files WHERE body <> '' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"""
SQL["records_wide"] = f"""WITH a_key AS (SELECT *, CASE WHEN p_partkey % 11 = 0 THEN -2 * p_partkey - 2 ELSE p_partkey END AS key_ai FROM part)
SELECT p_partkey * 4 + 1 AS rec_pos, key_ai AS p_partkey, {_NAME_AI} AS name, {_BRAND_AI} AS brand, {_TYPE_AI} AS type, CAST({_SIZE_AI} AS BIGINT) AS size,
  array_to_string({_WORDS_AI}, ' ') AS words FROM a_key
UNION ALL SELECT p_partkey * 4, key_ai, {_NAME_AI}, {_BRAND_AI}, 'WRONG', CAST({_SIZE_AI} AS BIGINT), array_to_string({_WORDS_AI}, ' ') FROM a_key WHERE p_partkey % 13 = 0
UNION ALL SELECT p_partkey * 4 + 2, -2 * p_partkey - 1, p_name, p_brand, p_type, CAST(p_size AS BIGINT), array_to_string(string_split(p_name, ' '), ' ') FROM part WHERE p_partkey % 17 = 0"""
