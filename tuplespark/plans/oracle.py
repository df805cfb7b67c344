"""DuckDB SQL for every registered query (the correctness oracle).

The SQL is written independently of the Spark code: list functions, window
numbering and a recursive CTE for the greedy assignment. The driver
pre-registers the parquet tables as views; ``oie_pairs`` is derived here with
the same rule as ``sources.fixtures``.
"""

from __future__ import annotations

OIE_PAIRS = r"""
oie_pairs AS (
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, trim(regexp_replace(unnest(string_split(text, chr(10))), '[#,.]', '', 'g'), ' ') AS line FROM documents),
f AS (SELECT doc_id, pos, regexp_split_to_array(line, ' +') AS f FROM l WHERE len(regexp_split_to_array(line, ' +')) >= 3),
c0 AS (SELECT *, (len(f) + 99) // 100 AS s, unnest(range(0, (len(f) + 99) // 100)) AS j FROM f),
w AS (SELECT doc_id, pos, j, f[j * len(f) // s + 1:(j + 1) * len(f) // s] AS w FROM c0),
k AS (SELECT doc_id, w, len(w) AS n, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos, j) AS INT) AS k,
        max(len(w)) OVER (PARTITION BY doc_id) AS widest FROM w),
c AS (SELECT *, (doc_id + k) % 6 AS v, CASE WHEN n >= 8 THEN 1 + (doc_id + k) % 3 ELSE 1 END AS ns,
        CASE WHEN n >= 8 THEN 1 + k % 3 ELSE 1 END AS np FROM k),
b AS (SELECT *, w[ns + np + 1:] AS b, n - ns - np AS r FROM c),
m AS (SELECT *, CASE WHEN k % 7 = 0 AND r >= 8 AND widest <= 64 THEN 4 + k % 5 WHEN r >= 5 THEN 1 + k % 3
                     WHEN r >= 3 THEN 2 ELSE 1 END AS m FROM b),
e AS (SELECT *, CASE WHEN m = 3 THEN 4 ELSE m END AS z FROM m),
p AS (SELECT doc_id, k, v, array_to_string(w[1:ns], ' ') AS subj,
        CASE WHEN k % 2 = 0 AND n >= 8 THEN 'not ### ' ELSE '' END || array_to_string(w[ns + 1:ns + np], ' ') AS pred,
        list_append(CASE WHEN m = 3 THEN [b[1], b[2] || ' ### ' || b[3]] ELSE b[1:m - 1] END,
                    CASE WHEN r > z THEN b[z] || ' ### ' || array_to_string(b[z + 1:], ' ') ELSE b[z] END) AS o FROM e),
r AS (SELECT doc_id, k, v, array_to_string(list_concat([subj, pred], o), ' ,, ') AS g,
        CASE v WHEN 1 THEN array_to_string(list_concat([subj, pred], list_reverse(o)), ' ,, ')
               WHEN 2 THEN array_to_string(list_concat([subj, pred], o[1:len(o) - 1]), ' ,, ')
               WHEN 3 THEN array_to_string(list_concat([subj, 'not ### ' || pred], o), ' ,, ')
               WHEN 4 THEN NULL
               ELSE array_to_string(list_concat([subj, pred], o), ' ,, ') END AS h FROM p),
s AS (SELECT *, min(CASE WHEN h IS NOT NULL THEN k END) OVER (PARTITION BY doc_id) AS k0 FROM r)
SELECT d.doc_id,
  coalesce(string_agg(CASE WHEN k = 1 THEN g ELSE k || '. ' || g END, chr(10) ORDER BY k), '') AS gold_str,
  concat(CASE WHEN d.doc_id % 7 = 0 THEN '   ' || chr(10) ELSE '' END,
    coalesce(string_agg(CASE WHEN h IS NULL THEN NULL WHEN k = k0 THEN h WHEN v = 5 THEN k || '. ' || h || chr(10) || k || '. ' || h ELSE k || '. ' || h END, chr(10) ORDER BY k), ''),
    CASE WHEN d.doc_id % 3 = 0 THEN chr(10) || 'note without number' ELSE '' END,
    CASE WHEN d.doc_id % 5 = 0 THEN chr(10) || '9x. bad ,, number' ELSE '' END) AS pred_str
FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id)
"""


def parse_cte(name: str, src: str, text: str) -> str:
    """CTEs turning ``src(doc_id, <text>)`` into
    ``name(doc_id, tidx, subj, pred, auxi, objs)`` by rules P1-P9."""
    return f"""
{name}_l AS (
  SELECT doc_id, generate_subscripts(string_split(lower({text}), chr(10)), 1) AS pos,
         unnest(string_split(lower({text}), chr(10))) AS line FROM {src}),
{name}_k AS (
  SELECT doc_id, pos, line FROM {name}_l WHERE trim(line, ' ') <> ''
  QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) = 1),
{name}_n AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS li FROM {name}_k),
{name}_b AS (
  SELECT doc_id, li, CASE WHEN li = 1 THEN line
      WHEN regexp_full_match(string_split(line, '.')[1], '[0-9]+')
      THEN array_to_string(string_split(line, '.')[2:], '.') END AS b FROM {name}_n),
{name}_p AS (
  SELECT doc_id, li, string_split(b, ',,') AS p FROM {name}_b
  WHERE b IS NOT NULL AND len(string_split(b, ',,')) >= 2),
{name} AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY li) - 1 AS BIGINT) AS tidx,
    trim(p[1], ' ') AS subj,
    list_transform(string_split(p[2], '###'), lambda x: trim(x, ' '))[-1] AS pred,
    list_transform(string_split(p[2], '###'), lambda x: trim(x, ' '))[1:-2] AS auxi,
    list_transform(p[3:], lambda o: CASE WHEN len(string_split(o, '###')) = 1
        THEN {{'prep': '', 'obj': trim(o, ' ')}}
        ELSE {{'prep': trim(string_split(o, '###')[-2], ' '), 'obj': trim(string_split(o, '###')[-1], ' ')}} END) AS objs
  FROM {name}_p)"""


def linearize_sql(t: str = "") -> str:
    """Duck form of PRJ-4 over columns subj, pred, auxi, objs (prefix ``t``)."""
    return (f"array_to_string(list_concat([{t}subj, array_to_string(list_append({t}auxi, {t}pred), ' ### ')], "
            f"list_transform({t}objs, lambda o: CASE WHEN length(o.prep) = 0 THEN o.obj "
            f"ELSE o.prep || ' ### ' || o.obj END)), ' ,, ')")


def with_ctes(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(c.strip() for c in ctes) + "\n"


ORACLE: dict[str, str] = {}

ORACLE["parse_tuples"] = with_ctes(OIE_PAIRS, parse_cte("g", "oie_pairs", "gold_str"),
                                   parse_cte("pr", "oie_pairs", "pred_str")) + """
SELECT doc_id, side, tidx, subj, pred, array_to_string(auxi, ' ### ') AS auxi,
       CAST(len(auxi) AS BIGINT) AS n_auxi,
       array_to_string(list_transform(objs, lambda o: o.prep || ' ### ' || o.obj), ' ,, ') AS objs,
       CAST(len(objs) AS BIGINT) AS n_objs
FROM (SELECT 'gold' AS side, * FROM g UNION ALL SELECT 'pred' AS side, * FROM pr)
"""

_FACTS_SELECT = """
SELECT CAST(doc_id AS VARCHAR) AS articleId, CAST(0 AS BIGINT) AS lineId, tidx AS factId,
  {lin} AS text, subj, pred, array_to_string(auxi, ' ') AS auxi,
  objs[1].prep AS prep1, objs[1].obj AS obj1, objs[2].prep AS prep2, objs[2].obj AS obj2,
  objs[3].prep AS prep3, objs[3].obj AS obj3, objs[4].prep AS prep4, objs[4].obj AS obj4,
  objs[5].prep AS prep5, objs[5].obj AS obj5, CAST(len(objs) AS BIGINT) AS n_objs
FROM pr
""".replace("{lin}", linearize_sql())

ORACLE["facts_wide"] = with_ctes(OIE_PAIRS, parse_cte("pr", "oie_pairs", "pred_str")) + _FACTS_SELECT


# ---------------------------------------------------------------------------
# M1: text side
# ---------------------------------------------------------------------------
from tuplespark import constants as K  # noqa: E402


def lit(s: str) -> str:
    """A DuckDB string literal."""
    return "'" + s.replace("'", "''") + "'"


SENTS = r"""
sents AS (
  SELECT doc_id, CAST(generate_subscripts(ss, 1) - 1 AS BIGINT) AS lineId, unnest(ss) AS s
  FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]+[.!?]*["'')\]]*'),
                                                  lambda x: trim(x, ' ')), lambda x: x <> '') AS ss
        FROM documents))
"""

OBJ_TEXT = "lambda o: CASE WHEN length(o.prep) = 0 THEN o.obj ELSE o.prep || ' ### ' || o.obj END"
PRED_TEXT = "array_to_string(list_append(auxi, pred), ' ### ')"
PRED_FIRST = f"array_to_string(list_concat([{PRED_TEXT}, subj], list_transform(objs, {OBJ_TEXT})), ' ;; ')"

GREC = f"""
grec AS (SELECT 'sentence ' || doc_id AS sent, {PRED_TEXT} AS pred,
                list_concat([subj], list_transform(objs, {OBJ_TEXT})) AS args,
                doc_id * 1000000 + tidx AS line_no FROM g)
"""

GOLD_REPLIES = f"""
replies AS (SELECT doc_id, string_agg((tidx + 1) || '. ' || {PRED_FIRST}, chr(10) ORDER BY tidx) AS reply
            FROM g GROUP BY doc_id)
"""

PRED_REPLIES = """
replies AS (SELECT doc_id, replace(pred_str, ' ,, ', ' ;; ') AS reply FROM oie_pairs)
"""

ANNO_LINES = """
al_l AS (SELECT doc_id, generate_subscripts(string_split(reply, chr(10)), 1) AS pos,
                unnest(string_split(reply, chr(10))) AS line FROM replies),
al AS (SELECT doc_id, pos, line, string_split(line, '.')[1] AS item,
              string_split(array_to_string(string_split(line, '.')[2:], '.'), ' ;; ') AS parts,
              CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS BIGINT) AS item_idx
       FROM al_l WHERE length(line) >= 5 AND regexp_full_match(substr(line, 1, 1), '[0-9]'))
"""

GOLD = [OIE_PAIRS, parse_cte("g", "oie_pairs", "gold_str")]

ORACLE["split_sentences"] = with_ctes(SENTS) + "SELECT doc_id, lineId, s FROM sents"

ORACLE["ident_build"] = with_ctes(SENTS) + \
    "SELECT CAST(doc_id AS VARCHAR) AS articleId, lineId, CAST(doc_id AS VARCHAR) || '_' || lineId AS ident FROM sents"

ORACLE["ident_split"] = with_ctes(SENTS) + \
    "SELECT CAST(doc_id AS VARCHAR) || '_' || lineId AS ident, CAST(doc_id AS VARCHAR) AS articleId, lineId FROM sents"

ORACLE["template_reformat"] = with_ctes(*GOLD, GREC) + """
SELECT line_no, sent, pred, args[1] AS subj,
  '' AS obj0_prep, coalesce(args[2], '') AS obj0_obj,
  '' AS obj1_prep, coalesce(args[3], '') AS obj1_obj,
  '' AS obj2_prep, coalesce(args[4], '') AS obj2_obj,
  '' AS auxilliary FROM grec
"""

ORACLE["linearize_tuples"] = with_ctes(*GOLD) + f"SELECT doc_id, tidx, {linearize_sql()} AS text FROM g"

ORACLE["linearize_pred_first"] = with_ctes(*GOLD) + f"SELECT doc_id, tidx, {PRED_FIRST} AS text FROM g"

ORACLE["render_target"] = with_ctes(*GOLD) + f"""
SELECT p.doc_id, coalesce(t.target, '') AS target FROM oie_pairs p LEFT JOIN (
  SELECT doc_id, string_agg(CASE WHEN tidx = 0 THEN {linearize_sql()} ELSE (tidx + 1) || '. ' || {linearize_sql()} END,
                            chr(10) ORDER BY tidx) AS target FROM g GROUP BY doc_id) t ON p.doc_id = t.doc_id
"""

ORACLE["render_plain"] = with_ctes(*GOLD) + """
SELECT doc_id, tidx, trim(subj || ' ' || CASE WHEN len(auxi) > 0 THEN array_to_string(auxi, ' ') || ' ' ELSE '' END
  || pred || ' ' || array_to_string(list_transform(objs, lambda o: o.prep || ' ' || o.obj), ' '), ' ') AS plain FROM g
"""

ORACLE["annotation_prompt"] = with_ctes(*GOLD, GREC) + f"""
, items AS (SELECT sent, line_no, row_number() OVER (PARTITION BY sent ORDER BY line_no) AS i,
                   array_to_string(list_prepend(pred, args), ' ;; ') AS body FROM grec)
SELECT sent, CAST(row_number() OVER (ORDER BY min(line_no)) - 1 AS BIGINT) AS sidx,
  CAST(count(*) AS BIGINT) AS n_records,
  {lit(K.ANNOTATION_HEADER)} || sent || chr(10) || chr(10) || 'Before:' || chr(10)
    || string_agg(i || '. ' || body || chr(10) || chr(10) || 'After:', '' ORDER BY line_no) AS prompt
FROM items GROUP BY sent
"""

ORACLE["build_messages"] = with_ctes(SENTS) + f"""
SELECT doc_id, lineId, CAST(0 AS BIGINT) AS msg_idx, 'system' AS role, {lit(K.SYSTEM_INSTRUCTION)} AS content FROM sents
UNION ALL
SELECT doc_id, lineId, CAST(1 AS BIGINT) AS msg_idx, 'user' AS role, {lit(K.USER_PREFIX)} || s AS content FROM sents
"""

ORACLE["render_chat"] = """
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY turn, role, text)
    || '<|assistant|>' || chr(10) || '1. ' AS prompt
FROM conversations GROUP BY conv_id
"""

ORACLE["parse_lines"] = with_ctes(OIE_PAIRS) + """
, l AS (SELECT doc_id, generate_subscripts(string_split(lower(pred_str), chr(10)), 1) AS pos,
               unnest(string_split(lower(pred_str), chr(10))) AS line FROM oie_pairs),
k AS (SELECT doc_id, pos, line FROM l WHERE trim(line, ' ') <> ''
      QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) = 1),
n AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS li FROM k),
b AS (SELECT doc_id, li, line, CASE WHEN li = 0 THEN line
        WHEN regexp_full_match(string_split(line, '.')[1], '[0-9]+')
        THEN array_to_string(string_split(line, '.')[2:], '.') END AS body FROM n)
SELECT doc_id, CAST(li AS BIGINT) AS line_idx, line, body,
       CAST(CASE WHEN body IS NOT NULL THEN len(string_split(body, ',,')) END AS BIGINT) AS n_parts FROM b
"""

ANNO_TUPLES = """
ar AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS BIGINT) AS tidx,
   parts[2] AS subj,
   CASE WHEN contains(parts[1], '###') THEN list_transform(string_split(parts[1], '###'), lambda x: trim(x, ' '))[-1]
        ELSE parts[1] END AS pred,
   CASE WHEN contains(parts[1], '###') THEN list_transform(string_split(parts[1], '###'), lambda x: trim(x, ' '))[1:-2]
        ELSE []::VARCHAR[] END AS auxi,
   list_transform(parts[3:], lambda o: CASE WHEN contains(o, '###')
        THEN {'prep': trim(string_split(o, '###')[1], ' '), 'obj': trim(string_split(o, '###')[2], ' ')}
        ELSE {'prep': '', 'obj': o} END) AS objs
  FROM al WHERE len(parts) >= 2)
"""

ORACLE["parse_annotation"] = with_ctes(*GOLD, GOLD_REPLIES, ANNO_LINES, ANNO_TUPLES) + """
SELECT doc_id, tidx, subj, pred, array_to_string(auxi, ' ### ') AS auxi, CAST(len(auxi) AS BIGINT) AS n_auxi,
       array_to_string(list_transform(objs, lambda o: o.prep || ' ### ' || o.obj), ' ,, ') AS objs,
       CAST(len(objs) AS BIGINT) AS n_objs
FROM ar
"""

ORACLE["valid_replies"] = with_ctes(OIE_PAIRS, PRED_REPLIES) + \
    "SELECT doc_id, CAST(length(reply) AS BIGINT) AS n_chars, length(reply) >= 10 AS valid FROM replies"

ORACLE["annotation_violations"] = with_ctes(*GOLD, GREC, PRED_REPLIES, ANNO_LINES) + """
, bad AS (SELECT doc_id, item_idx, line, item, parts,
     list_filter(parts[3:], lambda o: contains(o, '###') AND len(string_split(o, '###')) <> 2) AS bad_objs FROM al)
SELECT CAST(doc_id AS VARCHAR) AS key, item_idx, 'item_not_numeric' AS rule, line AS detail FROM bad
  WHERE NOT regexp_full_match(item, '[0-9]+')
UNION ALL SELECT CAST(doc_id AS VARCHAR), item_idx, 'pred_pieces', parts[1] FROM bad
  WHERE contains(parts[1], '###') AND len(string_split(parts[1], '###')) <> 2
UNION ALL SELECT CAST(doc_id AS VARCHAR), item_idx, 'no_subject', line FROM bad WHERE len(parts) < 2
UNION ALL SELECT CAST(doc_id AS VARCHAR), item_idx, 'subj_has_sep', parts[2] FROM bad
  WHERE len(parts) >= 2 AND contains(parts[2], '###')
UNION ALL SELECT CAST(doc_id AS VARCHAR), item_idx, 'obj_pieces', array_to_string(bad_objs, ' ;; ') FROM bad
  WHERE len(bad_objs) > 0
UNION ALL SELECT sent, CAST(NULL AS BIGINT), 'too_many_args', array_to_string(args, chr(9)) FROM grec WHERE len(args) > 4
"""

ORACLE["long_outputs"] = """
SELECT doc_id, n_tokens FROM (
  SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS n_tokens
  FROM documents) WHERE n_tokens > 510
"""


# ---------------------------------------------------------------------------
# M2 / M3: scoring, greedy matching (recursive CTE), distances
# ---------------------------------------------------------------------------

def W(x: str) -> str:
    """Whitespace words."""
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


def OV(a: str, b: str) -> str:
    """Multiset intersection size."""
    return (f"coalesce(list_sum(list_transform(list_distinct({a}), lambda u: least("
            f"len(list_filter({a}, lambda x: x = u)), len(list_filter({b}, lambda x: x = u))))), 0)")


PLAIN = ("trim(subj || ' ' || CASE WHEN len(auxi) > 0 THEN array_to_string(auxi, ' ') || ' ' ELSE '' END || pred "
         "|| ' ' || array_to_string(list_transform({objs}, lambda o: o.prep || ' ' || o.obj), ' '), ' ')")


def LEM(x: str) -> str:
    """Whitespace words without the last ``s`` of the longer ones."""
    return (f"list_transform({W(x)}, lambda v: CASE WHEN length(v) > 3 AND suffix(v, 's') "
            f"THEN substr(v, 1, length(v) - 1) ELSE v END)")


def _words_cte(name: str, src: str, idx: str, W1=W) -> str:
    return f"""
{name} AS (SELECT doc_id, tidx AS {idx}, subj, pred, auxi, objs, {W1('subj')} AS subj_w, {W1('pred')} AS pred_w,
   list_transform(auxi, lambda a: {W1('a')}) AS aux_w,
   list_transform(objs, lambda o: {W1("o.prep || ' ' || o.obj")}) AS obj_w,
   len(objs) AS n_objs, {W(PLAIN.format(objs='objs'))} AS tok,
   {W("concat_ws(' ', subj, array_to_string(auxi, ' '), pred)")} AS h,
   list_transform(objs, lambda o: {W("o.prep || ' ' || o.obj")}) AS os FROM {src})"""


SCORE_CTES = [
    OIE_PAIRS, parse_cte("g", "oie_pairs", "gold_str"), parse_cte("pr", "oie_pairs", "pred_str"),
    _words_cte("gw", "g", "gidx"), _words_cte("pw", "pr", "pidx"),
    f"""
allp AS (SELECT gw.doc_id, gidx, pidx, gw.subj_w AS gs, pw.subj_w AS ps, gw.pred_w AS gp, pw.pred_w AS pp,
   gw.aux_w AS ga, pw.aux_w AS pa, gw.obj_w AS go, pw.obj_w AS po, gw.n_objs AS gn, pw.n_objs AS pn,
   {OV('gw.subj_w', 'pw.subj_w')} AS ovs, {OV('gw.pred_w', 'pw.pred_w')} AS ovp
 FROM gw JOIN pw ON gw.doc_id = pw.doc_id)""",
    """
cand AS (SELECT *, least(gn, coalesce(min(CASE WHEN pn > 0 THEN pn END) OVER (PARTITION BY doc_id, gidx ORDER BY pidx
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), gn)) AS ncur,
         least(gn, coalesce(min(CASE WHEN pn > 0 THEN pn END) OVER (PARTITION BY doc_id, gidx), gn)) AS ncut
         FROM allp WHERE ovs > 0 AND ovp > 0)""",
    """
cand2 AS (SELECT *, CASE WHEN pn = 0 THEN CASE WHEN ncur = 0 THEN 0 END ELSE least(ncur, pn) END AS L,
          least(len(ga), len(pa)) AS A FROM cand)""",
    f"""
stats AS (SELECT *,
   coalesce(list_sum(list_transform(range(1, A + 1), lambda k: {OV('ga[k]', 'pa[k]')})), 0) AS aov,
   coalesce(list_sum(list_transform(range(1, A + 1), lambda k: len(pa[k]))), 0) AS anp,
   coalesce(list_sum(list_transform(range(1, A + 1), lambda k: len(ga[k]))), 0) AS ang,
   coalesce(list_sum(list_transform(range(1, coalesce(L, 0) + 1), lambda k: {OV('go[k]', 'po[k]')})), 0) AS oov,
   coalesce(list_sum(list_transform(range(1, coalesce(L, 0) + 1), lambda k: len(po[k]))), 0) AS onp,
   coalesce(list_sum(list_transform(range(1, coalesce(L, 0) + 1), lambda k: len(go[k]))), 0) AS ong,
   len(list_filter(range(1, coalesce(L, 0) + 1), lambda k: {OV('go[k]', 'po[k]')} = 0)) AS ofail
 FROM cand2)""",
    """
scores AS (SELECT doc_id, gidx, pidx, L AS n_cmp_objs, ncut,
   CASE WHEN L IS NOT NULL AND ofail = 0 THEN (ovs + ovp + aov + oov) / (len(ps) + len(pp) + anp + onp) END AS prec,
   CASE WHEN L IS NOT NULL AND ofail = 0 THEN (ovs + ovp + aov + oov) / (len(gs) + len(gp) + ang + ong) END AS rec
 FROM stats)""",
]


def greedy_cte(name: str, cells: str, score: str, higher: bool) -> str:
    """``name(doc_id, gidx, pidx, score)``: accepted cells of the greedy
    assignment, as a recursive walk over each sentence's sorted cells."""
    order = f"{score} DESC" if higher else f"{score} ASC"
    return f"""
{name}_r AS (SELECT doc_id, gidx, pidx, {score} AS s,
   row_number() OVER (PARTITION BY doc_id ORDER BY {order}, gidx, pidx) AS rn FROM {cells}),
{name}_w(doc_id, rn, rws, cols, picked) AS (
  SELECT DISTINCT doc_id, 0, []::BIGINT[], []::BIGINT[], []::STRUCT(g BIGINT, p BIGINT, s DOUBLE)[] FROM {name}_r
  UNION ALL
  SELECT w.doc_id, w.rn + 1,
    CASE WHEN list_contains(w.rws, c.gidx) OR list_contains(w.cols, c.pidx) THEN w.rws ELSE list_append(w.rws, c.gidx) END,
    CASE WHEN list_contains(w.rws, c.gidx) OR list_contains(w.cols, c.pidx) THEN w.cols ELSE list_append(w.cols, c.pidx) END,
    CASE WHEN list_contains(w.rws, c.gidx) OR list_contains(w.cols, c.pidx) THEN w.picked
         ELSE list_append(w.picked, {{'g': c.gidx, 'p': c.pidx, 's': CAST(c.s AS DOUBLE)}}) END
  FROM {name}_w w JOIN {name}_r c ON c.doc_id = w.doc_id AND c.rn = w.rn + 1),
{name} AS (SELECT doc_id, m.g AS gidx, m.p AS pidx, m.s AS {score} FROM (
  SELECT doc_id, unnest(arg_max(picked, rn)) AS m FROM {name}_w GROUP BY doc_id))"""


GREEDY_P = greedy_cte("gp", "(SELECT * FROM scores WHERE prec IS NOT NULL)", "prec", True)

SENT_SCORES = """
, sscore AS (
  SELECT o.doc_id, coalesce(ng.n, 0) AS rec_den, coalesce(np.n, 0) AS prec_den,
         coalesce(pn.v, 0.0) AS prec_num, coalesce(rn.v, 0.0) AS rec_num
  FROM oie_pairs o
  LEFT JOIN (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id) ng ON ng.doc_id = o.doc_id
  LEFT JOIN (SELECT doc_id, count(*) AS n FROM pr GROUP BY doc_id) np ON np.doc_id = o.doc_id
  LEFT JOIN (SELECT doc_id, sum(prec) AS v FROM gp GROUP BY doc_id) pn ON pn.doc_id = o.doc_id
  LEFT JOIN (SELECT doc_id, sum(m) AS v FROM (SELECT doc_id, gidx, max(rec) AS m FROM scores
             WHERE prec IS NOT NULL GROUP BY doc_id, gidx) GROUP BY doc_id) rn ON rn.doc_id = o.doc_id),
sscore2 AS (SELECT *, CASE WHEN prec_den > 0 THEN prec_num / prec_den ELSE 1.0 END AS prec,
                      CASE WHEN rec_den > 0 THEN rec_num / rec_den ELSE 0.0 END AS rec FROM sscore),
sscore3 AS (SELECT *, CASE WHEN prec + rec > 0 THEN (1 + 0.25) * prec * rec / (0.25 * prec + rec) ELSE 0.0 END AS f_score
            FROM sscore2)
"""

ORACLE["candidate_pairs"] = with_ctes(*SCORE_CTES) + "SELECT doc_id, gidx, pidx FROM cand"

ORACLE["word_overlap"] = with_ctes(*SCORE_CTES) + f"""
SELECT c.doc_id, c.gidx, c.pidx, CAST(ovs AS BIGINT) AS ov_subj, CAST(ovp AS BIGINT) AS ov_pred,
       CAST({OV('gw.tok', 'pw.tok')} AS BIGINT) AS ov_text
FROM cand c JOIN gw ON gw.doc_id = c.doc_id AND gw.gidx = c.gidx JOIN pw ON pw.doc_id = c.doc_id AND pw.pidx = c.pidx
"""

ORACLE["pair_scores"] = with_ctes(*SCORE_CTES) + """
SELECT doc_id, gidx, pidx, round(prec, 6) AS prec, round(rec, 6) AS rec, CAST(n_cmp_objs AS BIGINT) AS n_cmp_objs FROM scores
"""

ORACLE["gold_truncation"] = with_ctes(*SCORE_CTES) + """
SELECT DISTINCT doc_id, gidx, CAST(gn AS BIGINT) AS n_objs, CAST(ncut AS BIGINT) AS n_cut FROM cand WHERE ncut < gn
"""

ORACLE["greedy_precision"] = with_ctes(*SCORE_CTES, GREEDY_P) + "SELECT doc_id, gidx, pidx, round(prec, 6) AS prec FROM gp"

ORACLE["sentence_scores"] = with_ctes(*SCORE_CTES, GREEDY_P) + SENT_SCORES + """
SELECT doc_id, round(prec_num, 6) AS prec_num, round(prec, 6) AS prec, round(rec_num, 6) AS rec_num,
       round(rec, 6) AS rec, round(f_score, 6) AS f_score, 0.5 AS f_beta,
       CAST(prec_den AS BIGINT) AS prec_den, CAST(rec_den AS BIGINT) AS rec_den FROM sscore3
"""

ORACLE["macro_metrics"] = with_ctes(*SCORE_CTES, GREEDY_P) + SENT_SCORES + """
SELECT CAST(n AS BIGINT) AS n_sentences, round(p, 6) AS macro_prec, round(r, 6) AS macro_rec,
       round((1 + 0.25) * p * r / (0.25 * p + r), 6) AS macro_f_beta, round(2 * p * r / (p + r), 6) AS macro_f1
FROM (SELECT count(*) AS n, avg(prec) AS p, avg(rec) AS r FROM sscore3)
"""

ORACLE["micro_metrics"] = with_ctes(*SCORE_CTES, GREEDY_P) + SENT_SCORES + """
SELECT round(p, 6) AS micro_prec, round(r, 6) AS micro_rec,
       round((1 + 0.25) * p * r / (0.25 * p + r), 6) AS micro_f_beta, round(2 * p * r / (p + r), 6) AS micro_f1
FROM (SELECT sum(prec_num) / sum(prec_den) AS p, sum(rec_num) / sum(rec_den) AS r FROM sscore3)
"""


def dist_sql(name: str, pairs: str, orders: str) -> str:
    """``name(doc_id, gidx, pidx, d)``: least edit distance of gold tokens ``a``
    and head ``h`` plus objects ``os`` of ``pairs`` over the orders in the list
    ``orders``. Common tokens of a pair become single bytes for the built-in
    function, which counts bytes (a tuple of the fixture has at most 101 words)."""
    def code(x: str, other: int) -> str:
        return (f"array_to_string(list_transform({x}, lambda t: CASE WHEN list_contains(c, t) "
                f"THEN chr((2 + list_position(c, t))::INT) ELSE chr({other}) END), '')")
    order = "list_transform(p, lambda k: {0}[k + 1])"
    return f"""
{name}_c AS (SELECT *, list_intersect(a, list_concat(h, flatten(os))) AS c FROM ({pairs}) JOIN ({orders}) USING (n)),
{name}_k AS (SELECT *, {code('a', 1)} AS ac, {code('h', 2)} AS hc, list_transform(os, lambda o: {code('o', 2)}) AS oc FROM {name}_c),
{name} AS (SELECT doc_id, gidx, pidx,
    list_min(list_transform(ps, lambda p: levenshtein(ac, hc || array_to_string({order.format('oc')}, '')))) AS d FROM {name}_k)"""


GIVEN = "SELECT n, [range(n)] AS ps FROM range(10) t(n)"
EVERY = "SELECT n, list(p) AS ps FROM perms GROUP BY n"
CAND = """SELECT c.doc_id, c.gidx, c.pidx, gw.tok AS a, pw.h, pw.os, len(pw.os) AS n FROM cand c
  JOIN gw ON gw.doc_id = c.doc_id AND gw.gidx = c.gidx JOIN pw ON pw.doc_id = c.doc_id AND pw.pidx = c.pidx"""

ORACLE["token_distance"] = with_ctes(*SCORE_CTES, dist_sql("td", CAND, GIVEN)) + """
SELECT doc_id, gidx, pidx, CAST(d AS BIGINT) AS dist FROM td
"""

PERMS = """
perm(n, p) AS (SELECT n, []::BIGINT[] FROM range(0, 9) t(n)
               UNION ALL SELECT n, list_append(p, k) FROM perm, range(0, 9) r(k)
               WHERE k < n AND len(p) < n AND NOT list_contains(p, k)),
perms AS (SELECT n, p, row_number() OVER (PARTITION BY n ORDER BY p) - 1 AS perm_idx FROM perm WHERE len(p) = n)
"""

ORACLE["min_perm_distance"] = with_ctes(*SCORE_CTES, PERMS, dist_sql("md", CAND, EVERY)) + """
SELECT doc_id, gidx, pidx, CAST(d AS BIGINT) AS dist FROM md
"""

ORACLE["object_permutations"] = with_ctes(*SCORE_CTES, PERMS) + """
SELECT pw.doc_id, CAST(pw.pidx AS BIGINT) AS pidx, CAST(perms.perm_idx AS BIGINT) AS perm_idx,
       array_to_string(list_transform(perms.p, lambda k: pw.objs[k + 1].obj), ' | ') AS objs
FROM pw JOIN perms ON perms.n = pw.n_objs
"""


def dist_ctes(mode: str) -> list[str]:
    """Greedy-matched distances over all pairs of each sentence (E5, E7)."""
    if mode == "sequential":
        gcut = """
gcut AS (SELECT gw.doc_id, gw.gidx, """ + W(PLAIN.format(objs="objs[1:coalesce(c.ncut, gw.n_objs)]")) + """ AS tok
  FROM gw LEFT JOIN (SELECT DISTINCT doc_id, gidx, ncut FROM cand) c ON c.doc_id = gw.doc_id AND c.gidx = gw.gidx)"""
    else:
        gcut = "gcut AS (SELECT doc_id, gidx, tok FROM gw)"
    pairs = ("SELECT gcut.doc_id, gidx, pidx, gcut.tok AS a, pw.h, pw.os, len(pw.os) AS n "
             "FROM gcut JOIN pw ON pw.doc_id = gcut.doc_id")
    return [gcut, dist_sql("dcell", pairs, EVERY), greedy_cte("gd", "dcell", "d", False)]


ORACLE["greedy_distance"] = with_ctes(*SCORE_CTES, PERMS, *dist_ctes("sequential")) + """
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY d, gidx, pidx) - 1 AS BIGINT) AS match_idx,
       CAST(d AS BIGINT) AS dist FROM gd
"""


def _hist(mode: str) -> str:
    return with_ctes(*SCORE_CTES, PERMS, *dist_ctes(mode)) + """
SELECT CAST(d AS BIGINT) AS distance, CAST(count(*) AS BIGINT) AS n,
       printf('%.2f%%', round(100.0 * count(*) / sum(count(*)) OVER (), 10)) AS share FROM gd GROUP BY d
"""


ORACLE["distance_histogram"] = _hist("sequential")
ORACLE["distance_histogram_pairwise"] = _hist("pairwise")

ORACLE["mean_distance"] = with_ctes(*SCORE_CTES, PERMS, *dist_ctes("sequential")) + """
SELECT round(avg(d), 6) AS mean_distance, CAST(count(*) AS BIGINT) AS n_matches FROM gd
"""

ORACLE["distance_fallback"] = with_ctes(*SCORE_CTES, PERMS, *dist_ctes("sequential")) + """
, eff AS (SELECT o.doc_id, coalesce(ng.n, 0) AS G, coalesce(np.n, 0) AS P, coalesce(np.f, 0) AS F
          FROM oie_pairs o
          LEFT JOIN (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id) ng ON ng.doc_id = o.doc_id
          LEFT JOIN (SELECT doc_id, count(*) AS n, sum(factorial(CAST(len(objs) AS INTEGER))) AS f FROM pr GROUP BY doc_id) np
            ON np.doc_id = o.doc_id)
SELECT e.doc_id, e.G * e.F > 12 AS fallback,
  CAST(CASE WHEN e.G * e.F > 12 THEN least(e.G, e.P) ELSE coalesce(s.n, 0) END AS BIGINT) AS n_dists,
  CAST(CASE WHEN e.G * e.F > 12 THEN 20 * least(e.G, e.P) ELSE coalesce(s.t, 0) END AS BIGINT) AS sum_dists
FROM eff e LEFT JOIN (SELECT doc_id, count(*) AS n, sum(d) AS t FROM gd GROUP BY doc_id) s ON s.doc_id = e.doc_id
"""

ORACLE["evaluate_chain"] = with_ctes(*SCORE_CTES, GREEDY_P, PERMS, *dist_ctes("sequential")) + SENT_SCORES + """
SELECT s.doc_id, round(prec, 6) AS prec, round(rec, 6) AS rec, round(f_score, 6) AS f_score,
       coalesce(d.dists, '') AS dists
FROM sscore3 s LEFT JOIN (SELECT doc_id, string_agg(CAST(CAST(d AS BIGINT) AS VARCHAR), ',' ORDER BY d, gidx, pidx) AS dists
                          FROM gd GROUP BY doc_id) d ON d.doc_id = s.doc_id
"""


# ---------------------------------------------------------------------------
# M4: corpus sources/sinks, resume, splits, corpus statistics
# ---------------------------------------------------------------------------

FLAT = ("subj, pred, array_to_string(auxi, ' ### ') AS auxi, "
        "array_to_string(list_transform(objs, lambda o: o.prep || ' ### ' || o.obj), ' ,, ') AS objs")

ORACLE["src_annotated"] = with_ctes(*GOLD) + f"""
SELECT CAST(doc_id AS BIGINT) AS sidx, 'sentence ' || doc_id AS sent, tidx, {FLAT} FROM g
"""

ORACLE["src_gold_tsv"] = with_ctes(*GOLD, GREC) + """
SELECT sent, pred, array_to_string(args, ' | ') AS args, CAST(len(args) AS BIGINT) AS n_args,
       row_number() OVER (ORDER BY line_no) - 1 AS line_no FROM grec
"""

ORACLE["src_sentences"] = with_ctes(SENTS) + "SELECT CAST(doc_id AS VARCHAR) AS articleId, lineId, s FROM sents"

ORACLE["src_documents"] = """
SELECT CAST(doc_id AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS url, CAST(NULL AS VARCHAR) AS title,
       CAST(length(text) AS BIGINT) AS n_chars FROM documents
"""

ORACLE["chunk_slice"] = """
SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS corpus_idx,
       CAST((row_number() OVER (ORDER BY doc_id) - 1) // 128 AS BIGINT) AS chunk_id FROM documents
"""

ORACLE["sink_predictions"] = with_ctes(OIE_PAIRS, parse_cte("pr", "oie_pairs", "pred_str")) + f"""
SELECT doc_id || '_0' AS idents, 'sentence ' || doc_id AS text, tidx, {FLAT} FROM pr
"""

ORACLE["sink_labelled"] = with_ctes(OIE_PAIRS, parse_cte("pr", "oie_pairs", "pred_str")) + """
SELECT o.gold_str AS labels, CAST(coalesce(n.n, 0) AS BIGINT) AS n_triples, true AS no_idents
FROM oie_pairs o LEFT JOIN (SELECT doc_id, count(*) AS n FROM pr GROUP BY doc_id) n ON n.doc_id = o.doc_id
"""

ORACLE["group_by_sentence"] = with_ctes(*GOLD, GREC) + """
SELECT sent, CAST(row_number() OVER (ORDER BY min(line_no)) - 1 AS BIGINT) AS sidx, CAST(count(*) AS BIGINT) AS n_records,
       CAST(min(line_no) AS BIGINT) AS first_pos, string_agg(pred, ' | ' ORDER BY line_no) AS preds
FROM grec GROUP BY sent
"""

RESUME = [*GOLD, GREC, GOLD_REPLIES, """
todo AS (SELECT sent, row_number() OVER (ORDER BY min(line_no)) - 1 AS sidx FROM grec GROUP BY sent)""", """
stored AS (SELECT 'sentence ' || r.doc_id AS sent, r.reply FROM replies r WHERE r.doc_id IN (SELECT doc_id FROM labels))"""]

ORACLE["resume_reused"] = with_ctes(*RESUME) + """
SELECT t.sent, CAST(t.sidx AS BIGINT) AS sidx, s.reply FROM todo t JOIN stored s ON s.sent = t.sent
"""

ORACLE["resume_pending"] = with_ctes(*RESUME) + """
SELECT t.sent, CAST(t.sidx AS BIGINT) AS sidx FROM todo t WHERE t.sent NOT IN (SELECT sent FROM stored)
"""

ORACLE["resume_union"] = with_ctes(*RESUME) + """
SELECT t.sent, s.reply, 'reused' AS source FROM todo t JOIN stored s ON s.sent = t.sent
UNION ALL
SELECT t.sent, r.reply, 'new' AS source FROM todo t JOIN replies r ON 'sentence ' || r.doc_id = t.sent
WHERE t.sent NOT IN (SELECT sent FROM stored)
"""

BUCKET = "CASE WHEN CAST(('0x' || substr(md5('42:' || CAST({k} AS VARCHAR)), 1, 8)) AS BIGINT) % 3 < 1 THEN 0 ELSE 1 END"

ORACLE["seeded_split"] = f"SELECT doc_id, CAST({BUCKET.format(k='doc_id')} AS INTEGER) AS bucket FROM documents"

ORACLE["corpus_stats"] = with_ctes(*GOLD) + f"""
SELECT CASE WHEN {BUCKET.format(k='o.doc_id')} = 0 THEN 'test1' ELSE 'test2' END AS subset,
       CAST(count(*) AS BIGINT) AS n_sentences, CAST(sum(coalesce(n.n, 0)) AS BIGINT) AS n_tuples
FROM oie_pairs o LEFT JOIN (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id) n ON n.doc_id = o.doc_id
GROUP BY 1
"""

ORACLE["usage_totals"] = with_ctes(*GOLD, GREC, GOLD_REPLIES) + f"""
, items AS (SELECT sent, line_no, row_number() OVER (PARTITION BY sent ORDER BY line_no) AS i,
                   array_to_string(list_prepend(pred, args), ' ;; ') AS body FROM grec),
prompts AS (SELECT sent, {lit(K.ANNOTATION_HEADER)} || sent || chr(10) || chr(10) || 'Before:' || chr(10)
    || string_agg(i || '. ' || body || chr(10) || chr(10) || 'After:', '' ORDER BY line_no) AS prompt
  FROM items GROUP BY sent)
SELECT CAST(sum(len({W("p.prompt || chr(10) || r.reply")})) AS BIGINT) AS total_tokens, CAST(count(*) AS BIGINT) AS n_requests
FROM prompts p JOIN replies r ON 'sentence ' || r.doc_id = p.sent
"""


# ---------------------------------------------------------------------------
# M5: supervised examples, numbering, batching
# ---------------------------------------------------------------------------

PROMPT_TEXT = ("'<|system|>' || chr(10) || " + lit(K.SYSTEM_INSTRUCTION) + " || chr(10) || '<|user|>' || chr(10) || "
               + lit(K.USER_PREFIX) + " || d.text || chr(10) || '<|assistant|>' || chr(10) || '1. '")

EX = [*GOLD, f"""
tgt AS (SELECT doc_id, string_agg(CASE WHEN tidx = 0 THEN {linearize_sql()} ELSE (tidx + 1) || '. ' || {linearize_sql()} END,
                                  chr(10) ORDER BY tidx) AS target FROM g GROUP BY doc_id)""", f"""
ex AS (SELECT o.doc_id, {W(PROMPT_TEXT)} AS prompt_tok, {W("coalesce(t.target, '')")} AS target_tok
       FROM oie_pairs o JOIN documents d ON d.doc_id = o.doc_id LEFT JOIN tgt t ON t.doc_id = o.doc_id)"""]


def vocab_cte(min_count: int) -> str:
    return f"""
vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY count(*) DESC, token) + 3 AS BIGINT) AS id,
                 CAST(count(*) AS BIGINT) AS count
          FROM (SELECT unnest(list_concat(prompt_tok, target_tok)) AS token FROM ex) GROUP BY token
          HAVING count(*) >= {min_count})"""


def ids_cte(name: str, col: str) -> str:
    return f"""
{name} AS (SELECT p.doc_id, list(coalesce(v.id, 3) ORDER BY p.pos) AS ids
  FROM (SELECT doc_id, unnest({col}) AS token, generate_subscripts({col}, 1) AS pos FROM ex) p
  LEFT JOIN vocab v ON v.token = p.token GROUP BY p.doc_id)"""


def CHK(x: str) -> str:
    return f"md5(array_to_string({x}, ','))"


ENC = lambda mc: [*EX, vocab_cte(mc), ids_cte("pid", "prompt_tok"), ids_cte("tid", "target_tok"), """
enc AS (SELECT ex.doc_id, coalesce(pid.ids, []::BIGINT[]) AS pids, coalesce(tid.ids, []::BIGINT[]) AS tids
        FROM ex LEFT JOIN pid ON pid.doc_id = ex.doc_id LEFT JOIN tid ON tid.doc_id = ex.doc_id)"""]  # noqa: E731

EXAMPLES = [*ENC(1), """
exm AS (SELECT doc_id,
   list_append(list_concat(pids, tids)[1:2047], 1) AS input_ids,
   list_append(list_concat(list_transform(pids, lambda x: -100), tids)[1:2047], 1) AS labels FROM enc)""", """
exi AS (SELECT *, len(input_ids) AS length, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM exm)"""]

ORACLE["build_vocab"] = with_ctes(*EX, vocab_cte(1)) + "SELECT token, id, count FROM vocab"

ORACLE["encode_tokens"] = with_ctes(*ENC(2)) + f"""
SELECT doc_id, CAST(len(pids) AS BIGINT) AS n_ids, CAST(len(list_filter(pids, lambda x: x = 3)) AS BIGINT) AS n_unk,
       {CHK('pids')} AS id_check, {CHK('tids')} AS target_check FROM enc
"""

ORACLE["build_examples"] = with_ctes(*EXAMPLES) + f"""
SELECT doc_id, CAST(length AS BIGINT) AS length, CAST(len(list_filter(labels, lambda x: x = -100)) AS BIGINT) AS n_ignored,
       {CHK('input_ids')} AS ids_check, {CHK('labels')} AS labels_check FROM exi
"""

ORACLE["build_inference_examples"] = with_ctes(*ENC(1)) + f"""
SELECT doc_id, CAST(len(pids[1:2048]) AS BIGINT) AS length, {CHK('pids[1:2048]')} AS ids_check FROM enc
"""


def _pad(method: str) -> str:
    fill = {"bos": "0", "ign": "-100", "pad": "2"}[method]
    if method == "bos":
        ids = f"list_concat(list_transform(range(n_pad), lambda x: {fill}), input_ids)"
        lab = "list_concat(list_transform(range(n_pad), lambda x: -100), labels)"
    else:
        ids = f"list_concat(input_ids, list_transform(range(n_pad), lambda x: {fill}))"
        lab = "list_concat(labels, list_transform(range(n_pad), lambda x: -100))"
    return with_ctes(*EXAMPLES, """
b AS (SELECT *, idx // 8 AS batch_id, max(length) OVER (PARTITION BY idx // 8) - length AS n_pad FROM exi)""") + f"""
SELECT doc_id, CAST(batch_id AS BIGINT) AS batch_id, CAST(length + n_pad AS BIGINT) AS padded_len,
       CAST(n_pad AS BIGINT) AS n_pad, {CHK(ids)} AS ids_check, {CHK(lab)} AS labels_check FROM b
"""


ORACLE["pad_batch_bos"] = _pad("bos")
ORACLE["pad_batch_ign"] = _pad("ign")
ORACLE["pad_batch_pad"] = _pad("pad")

ORACLE["length_buckets"] = with_ctes(*EXAMPLES) + """
SELECT doc_id, CAST(length AS BIGINT) AS length,
  CAST((idx // 32) * 4 + (row_number() OVER (PARTITION BY idx // 32 ORDER BY length DESC, idx) - 1) // 8 AS BIGINT) AS batch_id
FROM exi
"""

ORACLE["row_index"] = with_ctes(SENTS) + """
SELECT doc_id, lineId, CAST(row_number() OVER (ORDER BY doc_id, lineId) - 1 AS BIGINT) AS idx FROM sents
"""

ORACLE["batch_assign"] = with_ctes(SENTS) + """
SELECT doc_id, lineId, CAST((row_number() OVER (ORDER BY doc_id, lineId) - 1) // 1000 AS BIGINT) AS batch_id FROM sents
"""


# ---------------------------------------------------------------------------
# M6: plug-ins, stored outputs, class metrics, SQL functions
# ---------------------------------------------------------------------------

STUB_REPLY = f"""
gen AS (SELECT doc_id * 100000 + lineId AS doc_id, CAST(doc_id AS VARCHAR) || '_' || lineId AS ident,
   CASE WHEN len({W('s')}) >= 3 THEN {W('s')}[1] || ' ,, ' || {W('s')}[2] || ' ,, ' || array_to_string({W('s')}[3:], ' ') ELSE '' END AS output,
   len({W('s')}) AS n_words, doc_id AS article FROM sents)"""

ORACLE["generate_batch"] = with_ctes(SENTS, STUB_REPLY) + "SELECT ident, output, CAST(NULL AS VARCHAR) AS error FROM gen"

ORACLE["predict_chain"] = with_ctes(SENTS, STUB_REPLY, parse_cte("pt", "gen", "output")) + f"""
SELECT gen.ident, pt.tidx AS factId, {linearize_sql('pt.')} AS text, pt.subj, pt.pred, array_to_string(pt.auxi, ' ') AS auxi,
       pt.objs[1].prep AS prep1, pt.objs[1].obj AS obj1, pt.objs[2].prep AS prep2, pt.objs[2].obj AS obj2,
       CAST(len(pt.objs) AS BIGINT) AS n_objs
FROM pt JOIN gen ON gen.doc_id = pt.doc_id
"""

ORACLE["replay_generation"] = with_ctes(OIE_PAIRS) + """
SELECT o.doc_id, l.doc_id IS NOT NULL AS has_output, CAST(CASE WHEN l.doc_id IS NOT NULL THEN length(o.pred_str) END AS BIGINT) AS n_chars
FROM oie_pairs o LEFT JOIN labels l ON l.doc_id = o.doc_id
"""

ORACLE["attach_gold"] = with_ctes(OIE_PAIRS) + """
SELECT o.doc_id, CAST(length(o.gold_str) AS BIGINT) AS gold_chars, CAST(length(o.pred_str) AS BIGINT) AS pred_chars
FROM oie_pairs o JOIN labels l ON l.doc_id = o.doc_id
"""

ORACLE["attach_gold_audit"] = with_ctes(OIE_PAIRS) + """
SELECT coalesce(o.doc_id, x.doc_id) AS doc_id, o.doc_id IS NOT NULL AS has_gold, x.doc_id IS NOT NULL AS has_pred
FROM oie_pairs o FULL OUTER JOIN (SELECT l.doc_id FROM labels l JOIN documents d ON d.doc_id = l.doc_id) x
  ON x.doc_id = o.doc_id
"""

ORACLE["lemma_lookup"] = with_ctes(*GOLD) + f"""
SELECT doc_id, tidx, array_to_string(list_transform({W('subj')}, lambda w: CASE WHEN length(w) > 3 AND suffix(w, 's')
       THEN substr(w, 1, length(w) - 1) ELSE w END), ' ') AS lemmas FROM g
"""

ORACLE["classification_metrics"] = """
WITH c AS (SELECT quality AS y, 1 - toxic AS yhat FROM labels),
cls AS (SELECT y AS k FROM c UNION SELECT yhat FROM c),
per AS (SELECT k,
   coalesce((SELECT count(*) FROM c WHERE y = k AND yhat = k) / nullif((SELECT count(*) FROM c WHERE yhat = k), 0), 0.0) AS p,
   coalesce((SELECT count(*) FROM c WHERE y = k AND yhat = k) / nullif((SELECT count(*) FROM c WHERE y = k), 0), 0.0) AS r
   FROM cls)
SELECT round((SELECT avg(CASE WHEN y = yhat THEN 1.0 ELSE 0.0 END) FROM c), 6) AS accuracy,
       round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall,
       round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS macro_f1,
       CAST(count(*) AS BIGINT) AS n_classes, (SELECT CAST(count(*) AS BIGINT) FROM c) AS n
FROM per
"""

ORACLE["sql_parse_tuples"] = with_ctes(OIE_PAIRS, parse_cte("pr", "oie_pairs", "pred_str")) + """
SELECT doc_id, tidx, subj, pred, array_to_string(auxi, ' ### ') AS auxi,
       array_to_string(list_transform(objs, lambda o: o.prep || ' ### ' || o.obj), ' ,, ') AS objs FROM pr
"""


# ---------------------------------------------------------------------------
# M7: streaming (stream = batch)
# ---------------------------------------------------------------------------

ORACLE["stream_facts"] = with_ctes(OIE_PAIRS, parse_cte("pr", "oie_pairs", "pred_str")) + f"""
SELECT doc_id || '_0' AS ident, tidx AS factId, {linearize_sql()} AS text, subj, pred, array_to_string(auxi, ' ') AS auxi,
  objs[1].prep AS prep1, objs[1].obj AS obj1, objs[2].prep AS prep2, objs[2].obj AS obj2,
  objs[3].prep AS prep3, objs[3].obj AS obj3, CAST(len(objs) AS BIGINT) AS n_objs FROM pr
"""

ORACLE["stream_micro_totals"] = with_ctes(*SCORE_CTES, GREEDY_P) + SENT_SCORES + """
SELECT 'run-0' AS run_id, CAST(n AS BIGINT) AS n_sentences, round(p, 6) AS micro_prec, round(r, 6) AS micro_rec,
       round((1 + 0.25) * p * r / (0.25 * p + r), 6) AS micro_f_beta
FROM (SELECT count(*) AS n, sum(prec_num) / sum(prec_den) AS p, sum(rec_num) / sum(rec_den) AS r FROM sscore3)
"""


# ---------------------------------------------------------------------------
# M8: lemmas in scoring, chunked runs, failing generators, few-shot prompts, further sinks
# ---------------------------------------------------------------------------

LEMMA_CTES = [*SCORE_CTES[:3], _words_cte("gw", "g", "gidx", LEM), _words_cte("pw", "pr", "pidx", LEM), *SCORE_CTES[5:]]

for _name in ("evaluate_lemmas", "evaluate_lemmatizer"):
    ORACLE[_name] = with_ctes(*LEMMA_CTES, GREEDY_P) + SENT_SCORES + """
SELECT doc_id, round(prec, 6) AS prec, round(rec, 6) AS rec, round(f_score, 6) AS f_score FROM sscore3
"""

ORACLE["evaluate_tokenizer"] = ORACLE["distance_histogram_pairwise"]

ORACLE["split_plugin"] = """
SELECT doc_id, CAST(generate_subscripts(ss, 1) - 1 AS BIGINT) AS lineId, unnest(ss) AS s
FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS ss FROM documents)
"""

ORACLE["predict_chunk"] = with_ctes(SENTS, STUB_REPLY, parse_cte("pt", "gen", "output")) + f"""
SELECT c.chunk_id, gen.ident, pt.tidx AS factId, {linearize_sql('pt.')} AS text
FROM pt JOIN gen ON gen.doc_id = pt.doc_id
JOIN (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 128 AS chunk_id FROM documents) c ON c.doc_id = gen.article
"""

ORACLE["generate_errors"] = with_ctes(SENTS, STUB_REPLY) + """
SELECT ident, CASE WHEN n_words <= 20 THEN output END AS output,
       CASE WHEN n_words > 20 THEN 'ValueError: sentence too long' END AS error FROM gen
"""


def _shots_sql(examples: list) -> str:
    turns = [("system", lit(K.SYSTEM_INSTRUCTION))]
    for s, o in examples:
        turns += [("user", lit(K.USER_PREFIX + s)), ("assistant", lit(o))]
    turns.append(("user", f"{lit(K.USER_PREFIX)} || s"))
    text = " || ".join(f"'<|{role}|>' || chr(10) || {content} || chr(10)" for role, content in turns)
    return with_ctes(SENTS) + f"""
SELECT doc_id, lineId, CAST({len(turns)} AS BIGINT) AS n_messages, md5({text} || '<|assistant|>' || chr(10) || '1. ') AS prompt_check FROM sents
"""


ORACLE["build_messages_train"] = _shots_sql(K.FEW_SHOT_TRAIN)
ORACLE["build_messages_test"] = _shots_sql(K.FEW_SHOT_TEST)

ORACLE["sink_template"] = with_ctes(*GOLD, GREC) + """
SELECT sent, pred, args[1] AS subj, '' AS obj0_prep, coalesce(args[2], '') AS obj0_obj, '' AS obj1_prep, coalesce(args[3], '') AS obj1_obj,
  '' AS obj2_prep, coalesce(args[4], '') AS obj2_obj, '' AS auxilliary FROM grec
"""

ORACLE["sink_facts"] = with_ctes(OIE_PAIRS, parse_cte("pr", "oie_pairs", "pred_str")) + f"""
SELECT CASE WHEN {BUCKET.format(k='doc_id')} = 0 THEN 'test1' ELSE 'test2' END AS subset, CAST(doc_id AS VARCHAR) AS articleId,
  tidx AS factId, {linearize_sql()} AS text, subj, objs[1].obj AS obj1, CAST(len(objs) AS BIGINT) AS n_objs FROM pr
"""

ORACLE["sink_ordered"] = with_ctes(OIE_PAIRS) + """
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line_no, doc_id || '_0' AS idents FROM oie_pairs
"""


# ---------------------------------------------------------------------------
# M7: whole runs over corpus files
# ---------------------------------------------------------------------------

ORACLE["annotate_chain"] = with_ctes(*GOLD, GREC, GOLD_REPLIES, ANNO_LINES, ANNO_TUPLES) + f"""
, todo AS (SELECT DISTINCT doc_id, doc_id IN (SELECT doc_id FROM labels) AS held FROM g),
s AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS rank FROM todo)
SELECT s.rank AS line_no, CAST(CASE WHEN held THEN s.doc_id ELSE s.rank END AS BIGINT) AS sidx, 'sentence ' || s.doc_id AS sent, tidx, {FLAT}
FROM s JOIN (SELECT 0 AS k, * FROM ar UNION ALL SELECT 1 AS k, * FROM g) t ON t.doc_id = s.doc_id AND (t.k = 1) = s.held
"""

ORACLE["annotate_audit"] = with_ctes(*GOLD, GREC, GOLD_REPLIES.replace("FROM g ", "FROM g WHERE doc_id NOT IN (SELECT doc_id FROM labels) "), ANNO_LINES) + f"""
, items AS (SELECT sent, line_no, row_number() OVER (PARTITION BY sent ORDER BY line_no) AS i,
                   array_to_string(list_prepend(pred, args), ' ;; ') AS body FROM grec),
prompts AS (SELECT sent, {lit(K.ANNOTATION_HEADER)} || sent || chr(10) || chr(10) || 'Before:' || chr(10)
    || string_agg(i || '. ' || body || chr(10) || chr(10) || 'After:', '' ORDER BY line_no) AS prompt FROM items GROUP BY sent),
spent AS (SELECT sum(len({W("p.prompt || chr(10) || r.reply")})) AS tokens, count(*) AS requests
          FROM prompts p JOIN replies r ON 'sentence ' || r.doc_id = p.sent),
v AS (SELECT 'item_not_numeric' AS rule FROM al WHERE NOT regexp_full_match(item, '[0-9]+')
  UNION ALL SELECT 'pred_pieces' FROM al WHERE contains(parts[1], '###') AND len(string_split(parts[1], '###')) <> 2
  UNION ALL SELECT 'no_subject' FROM al WHERE len(parts) < 2
  UNION ALL SELECT 'subj_has_sep' FROM al WHERE contains(parts[2], '###')
  UNION ALL SELECT 'obj_pieces' FROM al WHERE len(list_filter(parts[3:], lambda o: contains(o, '###') AND len(string_split(o, '###')) <> 2)) > 0
  UNION ALL SELECT 'short_reply' FROM replies WHERE length(reply) < 10
  UNION ALL SELECT 'too_many_args' FROM grec WHERE len(args) > 4)
SELECT rule, count(*) AS n FROM v GROUP BY rule
UNION ALL SELECT 'requests', requests FROM spent UNION ALL SELECT 'tokens', CAST(tokens AS BIGINT) FROM spent
"""

ORACLE["evaluate_corpus"] = with_ctes(*SCORE_CTES, GREEDY_P, PERMS, *dist_ctes("sequential")) + SENT_SCORES + """
SELECT row_number() OVER (ORDER BY s.doc_id) - 1 AS line_no, CAST(s.doc_id AS BIGINT) AS sidx, round(prec, 6) AS prec, round(rec, 6) AS rec,
       round(f_score, 6) AS f_score, coalesce(d.dists, '') AS dists, CAST(prec_den AS BIGINT) AS n_triples
FROM sscore3 s LEFT JOIN (SELECT doc_id, string_agg(CAST(CAST(d AS BIGINT) AS VARCHAR), ',' ORDER BY d, gidx, pidx) AS dists
                          FROM gd GROUP BY doc_id) d ON d.doc_id = s.doc_id
"""

_PADDED = "list_concat({x}, list_transform(range(n_pad), lambda x: {fill}))"
ORACLE["training_chain"] = with_ctes(*EXAMPLES, """
lb AS (SELECT *, (idx // 32) * 4 + (row_number() OVER (PARTITION BY idx // 32 ORDER BY length DESC, idx) - 1) // 8 AS batch_id FROM exi)""", """
b AS (SELECT *, max(length) OVER (PARTITION BY batch_id) - length AS n_pad FROM lb)""") + f"""
SELECT idx AS line_no, CAST(batch_id AS BIGINT) AS batch_id, CAST(length AS BIGINT) AS length, CAST(n_pad AS BIGINT) AS n_pad,
       {CHK(_PADDED.format(x="input_ids", fill=2))} AS ids_check, {CHK(_PADDED.format(x="labels", fill=-100))} AS labels_check FROM b
"""
