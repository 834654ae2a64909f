"""DuckDB SQL twins of the registered queries (the correctness oracle).

Fragments below are SQL text builders; each mirrors one Spark expression of
``rankshift.functions.text``.  Tables are the driver's pre-registered views.
"""

from __future__ import annotations

WORD_SPLIT = r"[^\p{L}\p{N}]+"


def tok(col: str) -> str:
    return (f"list_filter(string_split(lower(regexp_replace(coalesce({col}, ''), "
            f"'{WORD_SPLIT}', ' ', 'g')), ' '), lambda x: x <> '')")


def head(col: str, n) -> str:
    return f"array_to_string(list_slice(string_split(coalesce({col}, ''), ' '), 1, {n}), ' ')"


def letters(col: str) -> str:
    return f"length(regexp_replace(coalesce({col}, ''), '[^\\p{{L}}]', '', 'g'))"


QUERIES = "queries AS (SELECT item_id AS qid, text AS query FROM benchmark)"
CANDS = """cands AS (
  SELECT d.doc_id % (SELECT count(*) FROM benchmark) AS qid, d.doc_id AS idx, d.text,
         coalesce(l.quality, 0)::INTEGER AS label
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l
  USING (doc_id))"""


def echo_cte(name: str = "gen", words: int = 150) -> str:
    return f"""first_cand AS (SELECT qid, arg_min(coalesce(text, ''), idx) AS first FROM cands GROUP BY qid),
{name} AS (SELECT q.qid, concat_ws(' ', coalesce(q.query, ''), {head('f.first', words)}) AS text
       FROM queries q LEFT JOIN first_cand f USING (qid))"""


def lists_cte(gen: str = "gen", keys: str = "qid") -> str:
    return f"""last_idx AS (SELECT qid, max(idx) AS last FROM cands GROUP BY qid),
lists AS (SELECT {keys}, idx, text, label FROM cands {'' if keys == 'qid' else 'JOIN (SELECT DISTINCT ' + keys + ' FROM ' + gen + ') USING (qid)'}
          UNION ALL
          SELECT {', '.join('g.' + k.strip() for k in keys.split(','))}, coalesce(li.last, -1) + 1 AS idx, g.text, -1 AS label
          FROM {gen} g LEFT JOIN last_idx li USING (qid))"""


def bm25_ctes(lists: str = "lists", queries: str = "queries", keys: str = "qid",
              k1: float = 1.5, b: float = 0.75, eps: float = 0.25, out: str = "bm25") -> str:
    k = keys
    return f"""toks AS (SELECT {k}, idx, {tok('text')} AS t FROM {lists}),
dl AS (SELECT {k}, idx, len(t) AS dl FROM toks),
tf AS (SELECT {k}, tok, idx, dl, count(*) AS tf
       FROM (SELECT {k}, idx, len(t) AS dl, unnest(t) AS tok FROM toks) GROUP BY ALL),
stats AS (SELECT {k}, count(*) AS n_docs, avg(dl) AS avgdl FROM dl GROUP BY ALL),
idf AS (SELECT f.*, ln(s.n_docs - f.df + 0.5) - ln(f.df + 0.5) AS idf
        FROM (SELECT {k}, tok, count(*) AS df FROM tf GROUP BY ALL) f JOIN stats s USING ({k})),
mean_idf AS (SELECT {k}, avg(idf) AS mean_idf FROM idf GROUP BY ALL),
qt AS (SELECT {k}, tok, count(*) AS qn FROM (SELECT {k}, unnest({tok('query')}) AS tok FROM {queries}) GROUP BY ALL),
qw AS (SELECT {k}, tok, qn, CASE WHEN idf < 0 THEN mean_idf * {eps} ELSE idf END AS w
       FROM qt JOIN idf USING ({k}, tok) JOIN mean_idf USING ({k})),
hits AS (SELECT {k}, idx, sum(qn * w * tf * {k1 + 1.0} / (tf + {k1} * ({1.0 - b} + {b} * dl / avgdl))) AS s
         FROM tf JOIN qw USING ({k}, tok) JOIN stats USING ({k}) GROUP BY ALL),
{out} AS (SELECT {k}, idx, round(coalesce(h.s, 0.0), 6) AS score FROM dl LEFT JOIN hits h USING ({k}, idx))"""


def tfcos_ctes(lists: str = "lists", queries: str = "queries", keys: str = "qid", out: str = "tfcos") -> str:
    k = keys
    return f"""tc_tf AS (SELECT {k}, idx, tok, count(*) AS tf
       FROM (SELECT {k}, idx, unnest({tok('text')}) AS tok FROM {lists}) GROUP BY ALL),
tc_dn AS (SELECT {k}, idx, sqrt(sum(tf * tf)) AS dn FROM tc_tf GROUP BY ALL),
tc_q AS (SELECT {k}, tok, count(*) AS qn FROM (SELECT {k}, unnest({tok('query')}) AS tok FROM {queries}) GROUP BY ALL),
tc_qn AS (SELECT {k}, sqrt(sum(qn * qn)) AS qnorm FROM tc_q GROUP BY ALL),
tc_dot AS (SELECT {k}, idx, sum(tf * qn)::DOUBLE AS d FROM tc_tf JOIN tc_q USING ({k}, tok) GROUP BY ALL),
{out} AS (SELECT {k}, l.idx, round(CASE WHEN d.d IS NULL THEN 0.0 ELSE d.d / (dn.dn * qn.qnorm) END, 6) AS score
       FROM {lists} l LEFT JOIN tc_dot d USING ({k}, idx) LEFT JOIN tc_dn dn USING ({k}, idx)
       LEFT JOIN tc_qn qn USING ({k}))"""


def positions_ctes(scored: str = "scored", keys: str = "ranker, qid", out: str = "pos") -> str:
    k = keys
    above = "(s.score > f.fs OR (s.score = f.fs AND s.idx < f.fidx))"
    return f"""fk AS (SELECT {k}, score AS fs, idx AS fidx FROM {scored} WHERE label = -1),
{out} AS (SELECT {k}, count(*) AS n, (1 + count_if(s.label <> -1 AND {above}))::BIGINT AS loc,
         count_if(s.label = 1)::BIGINT AS n_rel, count_if(s.label = 1 AND {above})::BIGINT AS n_rel_above
         FROM {scored} s JOIN fk f USING ({k}) GROUP BY ALL)"""


def metrics_select(pos: str = "pos", by: str = "ranker", ks=(1, 3, 5), q: float = 0.75) -> str:
    one = lambda c: f"CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    tops = ", ".join(f"round(avg({one(f'loc <= {k}')}), 6) AS top_{k}" for k in ks)
    return f"""SELECT {by}, count(*) AS n_queries, round(avg(loc), 6) AS avg_loc,
  round(avg(loc / n), 6) AS avg_rel_loc, {tops},
  round(avg({one('n_rel_above = 0')}), 6) AS fdaro_v1,
  round(avg(CASE WHEN n_rel > 0 THEN {one('n_rel_above = 0')} END), 6) AS fdaro_v2,
  round(avg({one(f'loc / n <= {q}')}), 6) AS up_quartile
FROM {pos} GROUP BY {by}"""


def echo_eval_prefix(words: int = 150, strip: bool = False) -> str:
    """WITH-list up to ``pos`` for the echo fake (``strip``: without its prompt) scored by Bm25 and TfCosine."""
    gen = echo_cte("gen", words) if not strip else f"""{echo_cte("raw", words)},
gen AS (SELECT g.qid, substr(g.text, length(coalesce(q.query, '')) + 1) AS text FROM raw g JOIN queries q USING (qid))"""
    return f"""WITH {QUERIES},
{CANDS},
{gen},
{lists_cte('gen')},
{bm25_ctes()},
{tfcos_ctes()},
scored AS (SELECT 'Bm25' AS ranker, b.qid, b.idx, b.score, l.label FROM bm25 b JOIN lists l USING (qid, idx)
           UNION ALL
           SELECT 'TfCosine' AS ranker, c.qid, c.idx, c.score, l.label FROM tfcos c JOIN lists l USING (qid, idx)),
{positions_ctes()}"""


FIRST_USER = """fu AS (SELECT conv_id, arg_min(text, turn) AS query FROM conversations
        WHERE role = 'user' GROUP BY conv_id)"""
ANSWERS = """ans AS (SELECT conv_id, text, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS pos
         FROM conversations WHERE role = 'assistant')"""
EXPLODED = f"""WITH {FIRST_USER}, {ANSWERS}
SELECT fu.conv_id AS ord, fu.query, ans.pos, CASE WHEN ans.pos = 0 THEN 1 ELSE 0 END AS is_selected,
       ans.text AS passage_text
FROM fu JOIN ans USING (conv_id)"""
PAIRS = """pairs AS (SELECT c.conv_id * 100000 + c.turn AS ord, c.text AS query, n.text AS body, 3 AS label
  FROM conversations c JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1
  WHERE c.role = 'user' AND n.role = 'assistant')"""
PAGE_ROWS = """page_rows AS (SELECT url,
    regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1), '[\\t\\r\\n]+', ' ', 'g') AS query,
    trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text
  FROM pages)"""


def word_share_sql(tokens: str = "t", lang: str = "lang") -> str:
    from rankshift.operators.clean import LANG_WORD
    cases = " ".join(
        f"WHEN {lang} = '{code}' THEN len(list_filter({tokens}, lambda x: regexp_matches(x, '{pat}')))"
        for code, pat in reversed(list(LANG_WORD.items())))
    return f"CASE WHEN len({tokens}) = 0 THEN 0.0 ELSE (CASE {cases} ELSE 0 END) / len({tokens}) END"


HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1))"


def site_sql(hosts) -> str:
    return "(" + " OR ".join(f"({HOST} = '{h}' OR ends_with({HOST}, '.{h}'))" for h in hosts) + ")"


def sentences_sql(col: str = "text") -> str:
    return f"len(list_filter(string_split_regex(coalesce({col}, ''), '[.!?]+'), lambda s: trim(s) <> ''))"


SPECIAL_VALUES = ("('<pad>', 0, 0), ('<bos>', 1, 0), ('<s>', 2, 0), ('</s>', 3, 0), ('<sep>', 4, 0), "
                  "('<unk>', 5, 0), ('<mask>', 6, 0)")
VOCAB = f"""vc AS (SELECT tok, count(*) AS cnt FROM (SELECT unnest({tok('text')}) AS tok FROM documents) GROUP BY tok),
vocab AS (SELECT tok, (row_number() OVER (ORDER BY cnt DESC, tok) - 1 + 7)::INTEGER AS id, cnt FROM vc
          UNION ALL SELECT tok, id::INTEGER, cnt::BIGINT FROM (VALUES {SPECIAL_VALUES}) s(tok, id, cnt))"""
DOC_IDS = f"""dt AS (SELECT doc_id, {tok('text')} AS t FROM documents),
de AS (SELECT doc_id, unnest(t) AS tok, unnest(generate_series(1, len(t))) AS pos FROM dt),
dl AS (SELECT de.doc_id, list(coalesce(vocab.id, 5) ORDER BY pos) AS l FROM de LEFT JOIN vocab USING (tok) GROUP BY de.doc_id),
ids AS (SELECT dt.doc_id, coalesce(dl.l, []::INTEGER[]) AS l FROM dt LEFT JOIN dl USING (doc_id))"""


BIGRAMS_DOCS = f"""pt AS (SELECT doc_id, lang, list_concat(['<s>'], {tok('text')}, ['</s>']) AS t FROM documents),
bg_rows AS (SELECT doc_id, lang, unnest(list_transform(generate_series(1, len(t) - 1),
              lambda i: {{'w1': t[i], 'w2': t[i + 1]}})) AS p FROM pt),
bgr AS (SELECT doc_id, lang, p.w1 AS w1, p.w2 AS w2 FROM bg_rows),
bg AS (SELECT lang, w1, w2, count(*) AS c FROM bgr GROUP BY ALL),
ctx AS (SELECT lang, w1, sum(c) AS cw1 FROM bg GROUP BY ALL),
voc AS (SELECT lang, count(DISTINCT w2) + 1 AS V FROM bg GROUP BY ALL),
ppl AS (SELECT r.doc_id, r.lang, round(exp(-avg(ln((coalesce(bg.c, 0) + 1.0) / (coalesce(ctx.cw1, 0) + 1.0 * voc.V)))), 6)
          AS perplexity
        FROM bgr r LEFT JOIN bg USING (lang, w1, w2) LEFT JOIN ctx USING (lang, w1) LEFT JOIN voc USING (lang)
        GROUP BY r.doc_id, r.lang)"""


def ngrams_sql(t: str, n: int) -> str:
    return (f"list_transform(generate_series(1, len({t}) - {n - 1}), "
            f"lambda i: array_to_string({t}[i : i + {n - 1}], ' '))")


def extractive_cte(name: str = "gen", words: int = 150) -> str:
    return f"""best_cand AS (SELECT qid, arg_max(coalesce(text, ''), (length(coalesce(text, '')), -idx)) AS best
             FROM cands GROUP BY qid),
{name} AS (SELECT q.qid, {head('b.best', words)} AS text FROM queries q LEFT JOIN best_cand b USING (qid))"""


def ngram_lm_ctes(order: int = 3, d: float = 0.75) -> str:
    pads = f"list_resize([]::VARCHAR[], {order - 1}, '<s>')" if order > 1 else "[]::VARCHAR[]"
    return f"""npt AS (SELECT doc_id, lang, list_concat({pads}, {tok('text')}, ['</s>']) AS t FROM documents),
npos AS (SELECT doc_id, lang, t, unnest(generate_series({order}, len(t))) AS i FROM npt),
kg AS (SELECT doc_id, lang, i, ks.k, array_to_string(t[i - ks.k + 1 : i - 1], ' ') AS ctx, t[i] AS w
       FROM npos CROSS JOIN (SELECT unnest(range(1, {order + 1}))::INTEGER AS k) ks),
ncnt AS (SELECT lang, k, ctx, w, count(*) AS c FROM kg GROUP BY ALL),
ncx AS (SELECT lang, k, ctx, sum(c) AS ch, count(*) AS n1p FROM ncnt GROUP BY ALL),
nvoc AS (SELECT lang, count(DISTINCT w) + 1 AS V FROM ncnt WHERE k = 1 GROUP BY ALL),
nsc AS (SELECT kg.doc_id, kg.lang, kg.i, kg.k,
          CASE WHEN ncx.ch IS NULL THEN 0.0 ELSE greatest(coalesce(ncnt.c, 0) - {d}, 0.0) / ncx.ch END AS a,
          CASE WHEN ncx.ch IS NULL THEN 1.0 ELSE {d} * ncx.n1p / ncx.ch END AS b
        FROM kg LEFT JOIN ncnt USING (lang, k, ctx, w) LEFT JOIN ncx USING (lang, k, ctx)),
ntok AS (SELECT s.doc_id, s.lang, s.i,
           list_reduce(list_prepend({{'a': 1.0 / v.V, 'b': 0.0}}, list({{'a': s.a, 'b': s.b}} ORDER BY s.k)),
                       lambda acc, x: {{'a': x.a + x.b * acc.a, 'b': 0.0}}).a AS p
         FROM nsc s JOIN nvoc v USING (lang) GROUP BY s.doc_id, s.lang, s.i, v.V),
nppl AS (SELECT doc_id, lang, round(exp(-avg(ln(p))), 6) AS perplexity FROM ntok GROUP BY doc_id, lang)"""


# ------------------------------------------------------------ generation (GEN1, GEN2, GEN4, GEN6)

def u32(text: str, at: int = 1) -> str:
    return f"('0x' || substr(md5({text}), {at}, 8))::BIGINT"


def generator_bigrams(by: str = "") -> str:
    """(by, w1, w2, c) of all documents."""
    lead = f"{by}, " if by else ""
    return f"""gtok AS (SELECT {lead}list_concat(['<s>'], {tok('text')}, ['</s>']) AS t FROM documents),
gpair AS (SELECT {lead}unnest(list_transform(generate_series(1, len(t) - 1), lambda i: {{'w1': t[i], 'w2': t[i + 1]}})) AS p FROM gtok),
gbg AS (SELECT {lead}p.w1 AS w1, p.w2 AS w2, count(*) AS c FROM gpair {f'WHERE {by} IS NOT NULL' if by else ''} GROUP BY ALL)"""


def continuation_ctes(by: str = "", temperature: float = 1.0, top_k: int = 0, top_p: float = 1.0) -> str:
    """gcont (by, ctx, w, pos, x, n, total): the followers that stay, in their order."""
    k, lead = (f"{by}, ctx", f"{by}, ") if by else ("ctx", "")
    x = "c" if temperature == 1.0 else f"greatest(1, round(1024 * pow(c::DOUBLE, {1.0 / temperature!r})))"
    keep = [f"pos < {top_k}"] if top_k > 0 else []
    keep += [f"lo < {top_p!r}::DOUBLE * alls"] if top_p < 1.0 else []
    order = f"PARTITION BY {k} ORDER BY c DESC, {u32('w')}, w"
    return f"""gx AS (SELECT {lead}w1 AS ctx, w2 AS w, c, ({x})::BIGINT AS x FROM gbg),
gord AS (SELECT *, row_number() OVER ({order}) - 1 AS pos, sum(x) OVER ({order} ROWS UNBOUNDED PRECEDING) - x AS lo,
         sum(x) OVER (PARTITION BY {k}) AS alls FROM gx),
gcont AS (SELECT {lead}ctx, w, pos, x::HUGEINT AS x, count(*) OVER (PARTITION BY {k}) AS n,
          sum(x) OVER (PARTITION BY {k})::HUGEINT AS total FROM gord {'WHERE ' + ' AND '.join(keep) if keep else ''})"""


def alias_ctes(by: str = "") -> str:
    """galias (by, ctx, cell, total, t, own, other): Walker's cells, by running sums of deficits and surpluses."""
    k, lead = (f"{by}, ctx", f"{by}, ") if by else ("ctx", "")
    same = " AND ".join(f"a.{c.strip()} = b.{c.strip()}" for c in k.split(","))
    return f"""gdev AS (SELECT *, n * x - total AS over FROM gcont),
gsum AS (SELECT *, coalesce(sum(abs(over)) OVER (PARTITION BY {k}, over > 0 ORDER BY pos
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo,
           coalesce(sum(CASE WHEN over > 0 THEN over END) OVER (PARTITION BY {k}), 0) AS spare FROM gdev),
gspan AS (SELECT *, lo + abs(over) AS hi FROM gsum),
galias AS (
  SELECT {lead}ctx, pos AS cell, total, total AS t, w AS own, w AS other FROM gspan WHERE over = 0 OR (over > 0 AND hi = spare)
  UNION ALL
  SELECT {', '.join('a.' + c.strip() for c in k.split(','))}, a.pos, a.total, a.total + a.over, a.w, b.w
  FROM gspan a JOIN gspan b ON {same} AND a.over < 0 AND b.over > 0 AND b.lo <= a.lo AND a.lo < b.hi
  UNION ALL
  SELECT {', '.join('a.' + c.strip() for c in k.split(','))}, a.pos, a.total, a.total + a.hi - b.hi, a.w, d.w
  FROM gspan a JOIN gspan b ON {same} AND a.over > 0 AND a.hi < a.spare AND b.over < 0 AND b.lo < a.hi AND a.hi <= b.hi
  JOIN gspan d ON {same.replace('b.', 'd.')} AND d.pos = a.pos + 1)"""


def sampled_texts(prompts: str, keys: str = "qid", by: str = "", max_length: int = 40, seed: int = 123) -> str:
    """gtext (keys, text) by ``max_length`` draws; ``prompts`` has the keys, the group and ``query``."""
    ks = [c.strip() for c in keys.split(",")]
    own = ks + ([by] if by and by not in ks else [])
    on = f"g.{by} = s.{by} AND " if by else ""
    mark = " || ".join(f"'|' || coalesce({{}}.{c}::VARCHAR, '')" for c in ks)
    digest = f"'{seed}|' || s.step || " + mark.replace("{}", "s")
    return f"""ghead AS (SELECT DISTINCT {by + ', ' if by else ''}ctx, n FROM gcont),
gstart AS (SELECT {', '.join(own)}, coalesce(list_last({tok('query')}), '<s>') AS w FROM {prompts}),
gfirst AS (SELECT {', '.join('s.' + c for c in own)}, CASE WHEN g.n IS NOT NULL THEN s.w ELSE '<s>' END AS ctx
  FROM gstart s LEFT JOIN ghead g ON {on}g.ctx = s.w),
gwalk AS (
  SELECT {', '.join(own)}, ctx, 0 AS step, [] ::VARCHAR[] AS gen, false AS done FROM gfirst
  UNION ALL
  SELECT {', '.join('s.' + c for c in own)}, d.w, s.step + 1, CASE WHEN d.stop THEN s.gen ELSE list_append(s.gen, d.w) END, d.stop
  FROM (SELECT s.*, g.n, {u32(digest)} AS u1, {u32(digest, 9)} AS u2 FROM gwalk s JOIN ghead g ON {on}g.ctx = s.ctx
        WHERE NOT s.done AND s.step < {max_length}) s
  JOIN galias g ON {on}g.ctx = s.ctx AND g.cell = (s.u1 * s.n) >> 32,
  LATERAL (SELECT CASE WHEN s.u2 / 4294967296.0::DOUBLE * g.total::DOUBLE < g.t::DOUBLE THEN g.own ELSE g.other END AS w) e,
  LATERAL (SELECT e.w, e.w = '</s>' AS stop) d),
gtext AS (SELECT {', '.join(own)}, array_to_string(arg_max(gen, step), ' ') AS text FROM gwalk GROUP BY {', '.join(own)})"""


def beam_texts(prompts: str, beams: int, max_length: int, seed: int, sample: bool, max_input: int = 0) -> str:
    """gtext (qid, text) by ``beams`` parallel texts."""
    words = f"({tok('query')})[:{max_input}]" if max_input else tok("query")
    u = u32(f"'{seed}|' || s.step || '|' || s.qid || '|' || s.beam || '|' || coalesce(g.w, '')")
    noise = f"- ln(-ln(({u} + 0.5) / 4294967296.0::DOUBLE))" if sample else ""
    return f"""ghead AS (SELECT DISTINCT ctx, n FROM gcont),
gstart AS (SELECT qid, coalesce(list_last({words}), '<s>') AS w FROM {prompts}),
gbeam AS (
  SELECT s.qid, 1::BIGINT AS beam, 0.0::DOUBLE AS score, CASE WHEN g.n IS NOT NULL THEN s.w ELSE '<s>' END AS ctx,
         [] ::VARCHAR[] AS gen, 0::BIGINT AS len, false AS done, 0 AS step FROM gstart s LEFT JOIN ghead g ON g.ctx = s.w
  UNION ALL
  SELECT qid, CASE WHEN done OR w = '</s>' THEN beam ELSE live::BIGINT END, CASE WHEN done THEN score ELSE sc END,
         CASE WHEN done OR w = '</s>' THEN ctx ELSE w END, CASE WHEN done OR w = '</s>' THEN gen ELSE list_append(gen, w) END,
         len + CASE WHEN done THEN 0 ELSE 1 END, done OR w = '</s>', step + 1
  FROM (SELECT *, row_number() OVER (PARTITION BY qid, done ORDER BY round(sc, 9) DESC, beam, len, w) AS r,
          sum(CASE WHEN w <> '</s>' THEN 1 ELSE 0 END) OVER (PARTITION BY qid, done ORDER BY round(sc, 9) DESC, beam, len, w
            ROWS UNBOUNDED PRECEDING) AS live
        FROM (SELECT *, row_number() OVER (PARTITION BY qid, done ORDER BY round(draw, 9) DESC, beam, len, w) AS k
              FROM (SELECT *, CASE WHEN done THEN sc ELSE sc {noise.replace('s.', '').replace('g.w', 'w')} END AS draw
                    FROM (SELECT s.*, g.w, CASE WHEN s.done THEN CASE WHEN s.len > 0 THEN s.score / s.len ELSE 0.0 END
                            ELSE s.score + ln(g.x::DOUBLE / g.total::DOUBLE) END AS sc
                          FROM gbeam s LEFT JOIN gcont g ON NOT s.done AND g.ctx = s.ctx WHERE s.step < {max_length})))
        WHERE k <= {2 * beams})
  WHERE done OR (w = '</s>' AND r <= {beams}) OR (w <> '</s>' AND live <= {beams})),
gtext AS (SELECT qid, array_to_string(gen, ' ') AS text FROM (SELECT *, row_number() OVER (PARTITION BY qid
    ORDER BY round(CASE WHEN len > 0 THEN score / len ELSE 0.0 END, 9) DESC, len, array_to_string(gen, ' ')) AS k
  FROM gbeam WHERE step = {max_length}) WHERE k = 1)"""


def kn_ctes(order: int = 3) -> str:
    """kppl (doc_id, lang, perplexity) under the modified Kneser-Ney model of each language."""
    out = [f"kt AS (SELECT doc_id, lang, list_concat(['<s>'], {tok('text')}, ['</s>']) AS t FROM documents)",
           f"""kw AS (SELECT doc_id, lang, unnest(list_transform(generate_series(2, len(t)), lambda i:
                 array_to_string(t[greatest(i - {order - 1}, 1) : i], ' '))) AS gram FROM kt)""",
           "kseen AS (SELECT lang, gram, count(*) AS a, len(string_split(gram, ' ')) AS k FROM kw GROUP BY lang, gram)",
           f"ka{order} AS (SELECT lang, gram, a FROM kseen WHERE k = {order})"]
    for k in range(order - 1, 0, -1):
        out.append(f"""ka{k} AS (SELECT lang, array_to_string(string_split(gram, ' ')[2:], ' ') AS gram, count(*) AS a FROM ka{k + 1} GROUP BY ALL
                   UNION ALL SELECT lang, gram, a FROM kseen WHERE k = {k})""")
    for k in range(1, order + 1):
        d = {i: f"{i} - {i + 1} * (t1 / (t1 + 2 * t2)) * t{i + 1} / t{i}" for i in (1, 2, 3)}
        good = "t1 > 0 AND t2 > 0 AND t3 > 0 AND " + " AND ".join(f"{d[i]} > 0 AND {d[i]} <= {i}" for i in (1, 2, 3))
        ctx = f"array_to_string(string_split(gram, ' ')[:{k - 1}], ' ')"
        below = "u.below" if k == 1 else "l.p"
        out += [f"""kt{k} AS (SELECT lang, {', '.join(f'count_if(a = {i})::DOUBLE AS t{i}' for i in range(1, 5))} FROM ka{k} GROUP BY lang)""",
                f"kd{k} AS (SELECT lang, {', '.join(f'CASE WHEN {good} THEN {d[i]} ELSE {i / 2} END AS d{i}' for i in (1, 2, 3))} FROM kt{k})",
                f"""kr{k} AS (SELECT r.*, {ctx} AS ctx, array_to_string(string_split(gram, ' ')[2:], ' ') AS rest,
                     CASE WHEN a = 1 THEN d1 WHEN a = 2 THEN d2 ELSE d3 END AS d FROM ka{k} r JOIN kd{k} USING (lang))""",
                f"ks{k} AS (SELECT lang, ctx, sum(a)::DOUBLE AS alls, sum(d) / sum(a) AS bow, count(*) AS words FROM kr{k} GROUP BY ALL)"]
        if k == 1:
            out.append("ku AS (SELECT lang, bow / (words + 1) AS below FROM ks1)")
            out.append("kp1 AS (SELECT r.lang, gram, (a - d) / alls + below AS p FROM kr1 r JOIN ks1 USING (lang) JOIN ku USING (lang))")
        else:
            out.append(f"""kp{k} AS (SELECT r.lang, r.gram, (a - d) / alls + bow * l.p AS p FROM kr{k} r JOIN ks{k} s USING (lang, ctx)
                       JOIN kp{k - 1} l ON l.lang = r.lang AND l.gram = r.rest)""")
    parts = lambda n: f"array_to_string(string_split(w.gram, ' ')[-{n}:], ' ')"
    joins, pick, hand = "", "CASE", ""
    for k in range(order, 0, -1):
        joins += f" LEFT JOIN kp{k} p{k} ON w.k >= {k} AND p{k}.lang = w.lang AND p{k}.gram = {parts(k)}"
        handed = " + ".join(f"coalesce(ln(b{j}.bow), 0)" for j in range(k + 1, order + 1)) or "0"
        pick += f" WHEN p{k}.p IS NOT NULL THEN ln(p{k}.p) + {handed}"
        if k > 1:
            joins += (f" LEFT JOIN ks{k} b{k} ON w.k >= {k} AND b{k}.lang = w.lang AND b{k}.ctx = "
                      f"array_to_string(string_split(w.gram, ' ')[-{k}:-2], ' ')")
    handed = " + ".join(f"coalesce(ln(b{j}.bow), 0)" for j in range(2, order + 1)) or "0"
    out.append(f"klp AS (SELECT w.lang, w.gram, {pick} ELSE ln(u.below) + {handed} END AS lp FROM kseen w JOIN ku u USING (lang) {joins})")
    out.append("""kppl AS (SELECT doc_id, kw.lang, round(exp(-avg(lp)), 6) AS perplexity FROM kw LEFT JOIN klp ON klp.lang = kw.lang AND klp.gram = kw.gram
               GROUP BY doc_id, kw.lang)""")
    return ",\n".join(out)


# ------------------------------------------------------------ chat settings (STR1, STR2)

def settings_ctes(models: dict, start: tuple, least: int, most: int) -> str:
    """steps (user_id, event_id, ts, kind, text, outcome, model, word_count, mode): the chat state, event by event."""
    keys = ", ".join(f"'{k}'" for k in models)
    names = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in models.items())
    ok = f"s.mode = 'settings' AND e.kind = 'view' AND e.number BETWEEN {least} AND {most}"
    return f"""ev AS (SELECT user_id, event_id, ts, event_type AS kind, floor(value)::BIGINT AS number,
  CASE event_type WHEN 'view' THEN coalesce(floor(value)::BIGINT::VARCHAR, '')
    WHEN 'purchase' THEN [{keys}][((coalesce(floor(value), 0)::BIGINT % {len(models)} + {len(models)}) % {len(models)}) + 1] END AS text,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
steps AS (
  SELECT DISTINCT user_id, 0::BIGINT AS seq, NULL::BIGINT AS event_id, NULL::TIMESTAMP AS ts, '' AS kind, NULL::VARCHAR AS text,
    '' AS outcome, '{start[0]}' AS model, {start[1]}::BIGINT AS word_count, '{start[2]}' AS mode FROM ev
  UNION ALL
  SELECT e.user_id, e.seq, e.event_id, e.ts, e.kind, e.text,
    CASE e.kind WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'set_model' WHEN 'click' THEN 'settings'
      WHEN 'error' THEN CASE WHEN s.mode = 'wait' THEN 'done' ELSE 'ignored' END
      WHEN 'view' THEN CASE WHEN s.mode = 'input' THEN 'request' WHEN s.mode = 'wait' THEN 'busy' WHEN {ok} THEN 'set' ELSE 'rejected' END
      ELSE 'unknown' END,
    CASE WHEN e.kind = 'purchase' THEN CASE e.text {names} END ELSE s.model END,
    CASE WHEN {ok} THEN e.number ELSE s.word_count END,
    CASE WHEN e.kind = 'purchase' OR ({ok}) OR (e.kind = 'error' AND s.mode = 'wait') THEN 'input'
      WHEN e.kind = 'click' THEN 'settings' WHEN e.kind = 'view' AND s.mode <> 'settings' THEN 'wait' ELSE s.mode END
  FROM steps s JOIN ev e ON e.user_id = s.user_id AND e.seq = s.seq + 1)"""


SETTINGS_COLUMNS = "user_id, event_id, ts, kind, text, outcome, model, word_count::INTEGER AS word_count, mode"


# ------------------------------------------------------------ learned pair scorer (RNK4)

def translation_ctes(iterations: int = 3, keep: float = 1e-6, smooth: float = 0.5) -> str:
    """em (qid, idx, score): the lists scored by word translation learned from ``pairs``."""
    out = [f"eq AS (SELECT ord, tok AS q, count(*) AS nq FROM (SELECT ord, unnest({tok('query')}) AS tok FROM pairs) GROUP BY ALL)",
           f"ed AS (SELECT ord, tok AS d, count(*) AS nd FROM (SELECT ord, unnest(list_concat([''], {tok('body')})) AS tok FROM pairs) GROUP BY ALL)",
           "el AS (SELECT * FROM eq JOIN ed USING (ord))"]
    for i in range(1, iterations + 1):
        rows = "(SELECT *, 1.0::DOUBLE AS t FROM el)" if i == 1 else f"(SELECT el.*, t FROM el JOIN et{i - 1} USING (q, d))"
        out += [f"""ec{i} AS (SELECT q, d, sum(nq * nd * t / a) AS c FROM (SELECT *, sum(nd * t) OVER (PARTITION BY ord, q) AS a FROM {rows})
                  GROUP BY q, d)""", f"et{i} AS (SELECT q, d, c / sum(c) OVER (PARTITION BY d) AS t FROM ec{i})"]
    out.append(f"""ew AS (SELECT q, sum(nq) AS n FROM eq GROUP BY q), en AS (SELECT sum(n) AS n_all, count(*) AS v FROM ew),
ea AS (SELECT qid, a.tok AS q, qn, {smooth} * coalesce((w.n + 1) / (en.n_all + en.v + 1), 1 / (en.n_all + en.v + 1)) AS low
  FROM (SELECT qid, tok, count(*) AS qn FROM (SELECT qid, unnest({tok('query')}) AS tok FROM queries) GROUP BY ALL) a
  LEFT JOIN ew w ON w.q = a.tok, en),
et AS (SELECT * FROM et{iterations} WHERE t >= {keep}),
ex AS (SELECT qid, idx, {tok('text')} AS w FROM lists),
ef AS (SELECT qid, idx, d, count(*) AS tf FROM (SELECT qid, idx, unnest(list_concat([''], w)) AS d FROM ex) GROUP BY ALL),
em_mass AS (SELECT qid, idx, q, sum(t * tf) AS m FROM ea JOIN et USING (q) JOIN ef USING (qid, d) GROUP BY ALL),
em AS (SELECT ex.qid, ex.idx, round(coalesce(sum(qn * ln(low + {1 - smooth} * coalesce(m, 0) / (len(w) + 1))), 0), 6) AS score
  FROM ex LEFT JOIN ea USING (qid) LEFT JOIN em_mass USING (qid, idx, q) GROUP BY ex.qid, ex.idx)""")
    return ",\n".join(out)
