"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and SQL twins.

Each query reads whole driver tables (or data Spark derives from them).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankshift.operators import generate as gen_ops
from rankshift.operators import rank
from rankshift.operators.metrics import position_summary, rank_metrics
from rankshift.plans import evaluation, oracle as O, standins

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ------------------------------------------------------------ ranking (§2.6)

def _echo_lists(spark, sf, words=150):
    q = standins.queries(spark, sf)
    c = standins.candidates(spark, sf)
    g = gen_ops.echo_texts(q, c, words)
    return q, rank.with_fake(c, g)


def _echo_positions(spark, sf):
    q = standins.queries(spark, sf)
    c = standins.candidates(spark, sf)
    return evaluation.fake_positions_for(c, q, gen_ops.echo_texts(q, c, 150))


@register("rank_metrics_echo", O.echo_eval_prefix() + "\n" + O.metrics_select())
def q_rank_metrics_echo(spark, sf):
    return rank_metrics(_echo_positions(spark, sf), ["ranker"])


@register("bm25_scores", f"""WITH {O.QUERIES},
{O.CANDS},
{O.echo_cte('gen')},
{O.lists_cte('gen')},
{O.bm25_ctes()}
SELECT qid, idx, score FROM bm25""")
def q_bm25_scores(spark, sf):
    q, lists = _echo_lists(spark, sf)
    return rank.score_bm25(lists, q)


@register("tf_cosine_scores", f"""WITH {O.QUERIES},
{O.CANDS},
{O.echo_cte('gen')},
{O.lists_cte('gen')},
{O.tfcos_ctes()}
SELECT qid, idx, score FROM tfcos""")
def q_tf_cosine_scores(spark, sf):
    q, lists = _echo_lists(spark, sf)
    return rank.score_tf_cosine(lists, q)


@register("fake_positions", O.echo_eval_prefix() + "\nSELECT ranker, qid, n, loc, n_rel, n_rel_above FROM pos")
def q_fake_positions(spark, sf):
    return _echo_positions(spark, sf)


@register("position_summary", O.echo_eval_prefix() + """
SELECT ranker, round(median(loc::DOUBLE), 6) AS median_loc,
  round(median(CASE WHEN n <= 1 THEN 0.0 ELSE (loc - 1) / (n - 1) END), 6) AS median_pct_better,
  round(sum(loc * n) / sum(n), 6) AS wavg_loc_by_n,
  round(sum(loc / n) / sum(1.0 / n), 6) AS wavg_loc_by_inv_n
FROM pos GROUP BY ranker""")
def q_position_summary(spark, sf):
    return position_summary(_echo_positions(spark, sf), ["ranker"])


_VEC = """WITH g AS (SELECT vec_id, embedding, label, vec_id // 25 AS qid, vec_id % 25 AS pos FROM embeddings),
last AS (SELECT qid, max(pos) AS last FROM g GROUP BY qid),
q AS (SELECT qid, embedding AS qvec, label AS qlabel FROM g WHERE pos = 0),
d AS (SELECT g.qid, g.vec_id AS idx, g.embedding,
        CASE WHEN g.pos = last.last THEN -1 WHEN g.label = q.qlabel THEN 1 ELSE 0 END AS label
      FROM g JOIN last USING (qid) JOIN q USING (qid) WHERE g.pos > 0),
sc AS (SELECT d.qid, d.idx, d.label,
        list_dot_product(d.embedding::DOUBLE[], q.qvec::DOUBLE[]) AS dp,
        sqrt(list_dot_product(d.embedding::DOUBLE[], d.embedding::DOUBLE[])) *
        sqrt(list_dot_product(q.qvec::DOUBLE[], q.qvec::DOUBLE[])) AS den
      FROM d JOIN q USING (qid))"""


def _vector_scored(spark, sf, how="cosine"):
    d, q = standins.vector_lists(spark, sf)
    s = rank.score_vectors(d, q, ["qid"], how)
    return s.join(d.select("qid", "idx", "label"), ["qid", "idx"]).withColumn("ranker", F.lit("VecCosine"))


@register("vector_rank_metrics", _VEC + """,
scored AS (SELECT 'VecCosine' AS ranker, qid, idx, label,
             round(CASE WHEN den = 0 THEN 0.0 ELSE dp / den END, 6) AS score FROM sc),
""" + O.positions_ctes() + "\n" + O.metrics_select())
def q_vector_rank_metrics(spark, sf):
    pos = rank.fake_positions(_vector_scored(spark, sf), ["ranker", "qid"])
    return rank_metrics(pos, ["ranker"])


@register("spar_score", _VEC + """
SELECT round(avg(round(dp, 6)), 6) AS spar_score, count(*) AS n_lists FROM sc WHERE label = -1""")
def q_spar_score(spark, sf):
    d, q = standins.vector_lists(spark, sf)
    s = rank.score_vectors(d.where(F.col("label") == -1), q, ["qid"], "dot")
    return s.agg(F.round(F.avg("score"), 6).alias("spar_score"), F.count(F.lit(1)).alias("n_lists"))


# ----------------------------------------------- projections, filters (§2.2)

from rankshift.operators import prep  # noqa: E402
from rankshift.session import ROCKSDB, materialize, scratch_path  # noqa: E402
from rankshift.sources import dataset, readers, sinks  # noqa: E402
from rankshift.sources.tables import table  # noqa: E402


@register("explode_passages", O.EXPLODED)
def q_explode_passages(spark, sf):
    return prep.explode_passages(standins.qa_rows(spark, sf))


@register("concat_passages", f"""WITH {O.FIRST_USER},
a AS (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS target FROM conversations
      WHERE role = 'assistant' GROUP BY conv_id)
SELECT fu.conv_id AS ord, coalesce(a.target, '') AS target FROM fu LEFT JOIN a USING (conv_id)""")
def q_concat_passages(spark, sf):
    return prep.concat_passages(standins.qa_rows(spark, sf)).select("ord", "target")


@register("with_prompt", f"""WITH {O.PAIRS}
SELECT ord, '<LM>' || query AS query, body || '</s>' AS body FROM pairs""")
def q_with_prompt(spark, sf):
    return prep.with_prompt(standins.qa_pairs(spark, sf), "query", "body").select("ord", "query", "body")


@register("selected_passages", O.EXPLODED.replace("FROM fu JOIN ans USING (conv_id)",
                                                  "FROM fu JOIN ans USING (conv_id) WHERE ans.pos = 0"))
def q_selected_passages(spark, sf):
    return prep.selected_only(prep.explode_passages(standins.qa_rows(spark, sf)))


@register("drop_non_text", """SELECT doc_id, lang FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL""")
def q_drop_non_text(spark, sf):
    return prep.drop_non_text(table(spark, sf, "documents"), ["text", "lang"]).select("doc_id", "lang")


@register("head_n", "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 500")
def q_head_n(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), "n_chars")
    return prep.head_n(d, 500).select(F.col("ord").alias("doc_id"), "n_chars")


@register("head_n_dense", "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 700")
def q_head_n_dense(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), "n_chars")
    return prep.head_n(d, 700).select(F.col("ord").alias("doc_id"), "n_chars")


@register("hash_split", """SELECT doc_id, CASE WHEN ('0x' || substr(md5(concat('123', doc_id::VARCHAR)), 1, 8))::BIGINT
  < 3650722201 THEN 'train' ELSE 'test' END AS split FROM documents""")
def q_hash_split(spark, sf):
    return prep.hash_split(table(spark, sf, "documents").select("doc_id"), "doc_id", 0.85, 123)


@register("batch_ids", """SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 8)::BIGINT AS batch_id
FROM documents""")
def q_batch_ids(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("ord"))
    return prep.with_batch_id(d, 8, "ord", "batch_id").select(F.col("ord").alias("doc_id"), "batch_id")


@register("sample_batches", """WITH b AS (SELECT doc_id AS ord, lang,
    ((row_number() OVER (ORDER BY doc_id) - 1) // 8)::BIGINT AS batch_id FROM documents),
nb AS (SELECT max(batch_id) + 1 AS n FROM b),
d AS (SELECT DISTINCT floor(('0x' || substr(md5(concat('7', '|', r.i::VARCHAR)), 1, 8))::BIGINT
        / 4294967296.0::DOUBLE * nb.n)::BIGINT AS batch_id FROM range(5) r(i), nb)
SELECT ord, lang, batch_id FROM b WHERE batch_id IN (SELECT batch_id FROM d)""")
def q_sample_batches(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), "lang")
    return prep.sample_batches(d, k=5, size=8, seed=7)


# ------------------------------------------------------- sources/sinks (§2.1)

RECORD_SEP = "\x1e"  # texts hold newlines; a record separator keeps the round trip exact

@register("src_qa_jsonl", O.EXPLODED)
def q_src_qa_jsonl(spark, sf):
    path = scratch_path(spark, "qa_jsonl")
    standins.qa_rows(spark, sf).withColumnRenamed("ord", "query_id").write.json(path)
    back = readers.read_qa_jsonl(spark, path)
    return prep.explode_passages(back.drop("ord").withColumnRenamed("query_id", "ord"))


@register("src_labelled_csv", f"WITH {O.PAIRS} SELECT query, body, label FROM pairs")
def q_src_labelled_csv(spark, sf):
    path = scratch_path(spark, "labelled_csv")
    p = standins.qa_pairs(spark, sf)
    (p.select("query", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("title"),
              F.lit(None).cast("string").alias("meta"), "body", F.lit(None).cast("string").alias("qlinks"),
              "label")
     .write.option("header", "true").option("quote", '"').option("escape", '"').csv(path))
    return readers.read_labelled_csv(spark, path).select("query", "body", "label")


def _page_rows(spark, sf, *more):
    p = table(spark, sf, "pages")
    title = F.regexp_replace(F.regexp_extract("html", "<title>(.*?)</title>", 1), r"[\t\r\n]+", " ")
    body = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"\s+", " "))
    return p.select("url", title.alias("query"), body.alias("text"), *more)


@register("src_tsv_gz", f"WITH {O.PAGE_ROWS} SELECT url, query, text FROM page_rows")
def q_src_tsv_gz(spark, sf):
    path = scratch_path(spark, "tsv")
    (_page_rows(spark, sf).write.option("sep", "\t").option("header", "false")
     .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
     .option("compression", "gzip").csv(path))
    return readers.read_tsv(spark, path, partitions=8).select("url", "query", "text")


@register("src_text_corpus", """SELECT (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS line_no,
  regexp_replace(text, '[\\r\\n]', ' ', 'g') AS text FROM documents""")
def q_src_text_corpus(spark, sf):
    path = scratch_path(spark, "text_corpus")
    d = table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", r"[\r\n]", " ").alias("value"))
    d.repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id").select("value").write.text(path)
    return readers.read_text_corpus(spark, path).select(F.col("ord").alias("line_no"), "text")


@register("dataset_part_data", f"WITH {O.FIRST_USER}, {O.ANSWERS} SELECT fu.query, pos::INTEGER AS pos, ans.text AS passage FROM fu JOIN ans USING (conv_id)")
def q_dataset_part_data(spark, sf):
    """SRC8, nested JSON Lines as a data source; blocks far smaller than the files."""
    folder = scratch_path(spark, "part_data")
    standins.qa_rows(spark, sf).select("query", "passages").write.json(f"{folder}/train.jsonl")
    return (dataset.read_dataset(spark, "part_data", folder, block_bytes=100_000)
            .select("query", F.posexplode("passages").alias("pos", "passage")))


@register("dataset_made_valid_data", f"WITH {O.FIRST_USER}, {O.ANSWERS} SELECT fu.query, pos::INTEGER AS pos, ans.text AS passage FROM fu JOIN ans USING (conv_id)")
def q_dataset_made_valid_data(spark, sf):
    """SRC8, JSON arrays of nested records."""
    folder = scratch_path(spark, "made_valid_data")
    rows = standins.qa_rows(spark, sf).groupBy(F.floor(F.col("ord") / 200).alias("part")).agg(
        F.to_json(F.collect_list(F.struct("query", "passages"))).alias("value"))
    rows.select("value").write.option("maxRecordsPerFile", 1).text(f"{folder}/val.json")
    return (dataset.read_dataset(spark, "made_valid_data", folder, "validation")
            .select("query", F.posexplode("passages").alias("pos", "passage")))


@register("dataset_made_data", f"WITH {O.PAIRS} SELECT query, body, label FROM pairs")
def q_dataset_made_data(spark, sf):
    """SRC8, CSV with header and line breaks inside fields."""
    folder, none = scratch_path(spark, "made_data"), F.lit(None).cast("string")
    (standins.qa_pairs(spark, sf).select("query", none.alias("url"), none.alias("title"), none.alias("meta"), "body",
                                         none.alias("qlinks"), "label")
     .write.option("header", "true").option("quote", '"').option("escape", '"').option("quoteAll", "true")
     .csv(f"{folder}/filtred_df.csv"))
    return dataset.read_dataset(spark, "made_data", folder, block_bytes=100_000).select("query", "body", "label")


@register("dataset_full_data", f"WITH {O.PAGE_ROWS} SELECT url, query, text AS body FROM page_rows")
def q_dataset_full_data(spark, sf):
    """SRC8, headerless gzip TSV."""
    folder = scratch_path(spark, "full_data")
    lines = _page_rows(spark, sf).select(F.concat_ws("\t", "url", "query", "text").alias("value"))
    lines.write.option("compression", "gzip").text(f"{folder}/dataset.tsv.gz")
    return dataset.read_dataset(spark, "full_data", folder, block_bytes=100_000).select("url", "query", "body")


@register("snk_pairs_text", f"""WITH {O.PAIRS}
SELECT concat_ws(' ', query, '<sep>', body, '</s>') AS value FROM pairs""")
def q_snk_pairs_text(spark, sf):
    path = scratch_path(spark, "pairs_text")
    sinks.export_pairs_text(standins.qa_pairs(spark, sf), path, line_sep=RECORD_SEP)
    return spark.read.option("lineSep", RECORD_SEP).text(path)


@register("snk_selected_text", f"""WITH {O.FIRST_USER}, {O.ANSWERS}
SELECT concat_ws(' ', fu.query, ans.text, '</s>') AS value FROM fu JOIN ans USING (conv_id) WHERE ans.pos = 0""")
def q_snk_selected_text(spark, sf):
    path = scratch_path(spark, "selected_text")
    sinks.export_selected_text(standins.qa_rows(spark, sf), path, line_sep=RECORD_SEP)
    return spark.read.option("lineSep", RECORD_SEP).text(path)


# ------------------------------------------------------------ cleaning (§2.3)

from rankshift.operators import clean as C  # noqa: E402

TEST_MARKERS = ("Released under the", "All rights reserved", "Copyright")
TEST_SITES = ("tionsh.example.net", "thther.example.org", "ththhe.example.com")
_DOC_T = f"WITH d AS (SELECT doc_id, lang, text, {O.tok('text')} AS t FROM documents)"


def _docs(spark, sf):
    return C.with_tokens(table(spark, sf, "documents").select("doc_id", "lang", "text"))


@register("clean_max_tokens", _DOC_T + " SELECT doc_id, len(t)::BIGINT AS n_tokens FROM d WHERE len(t) < 1000")
def q_clean_max_tokens(spark, sf):
    return _docs(spark, sf).where(C.max_tokens()).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"))


@register("clean_min_letters", f"SELECT doc_id, {O.letters('text')}::BIGINT AS n_letters FROM documents "
          f"WHERE {O.letters('text')} > 200")
def q_clean_min_letters(spark, sf):
    from rankshift.functions.text import letter_count
    return (_docs(spark, sf).where(C.min_letters())
            .select("doc_id", letter_count("text").cast("long").alias("n_letters")))


@register("clean_word_share", _DOC_T + f", s AS (SELECT doc_id, {O.word_share_sql()} AS share FROM d) "
          "SELECT doc_id, round(share, 6) AS share FROM s WHERE share >= 0.7")
def q_clean_word_share(spark, sf):
    share = C.word_share_value(C.LANG_WORD)
    return (_docs(spark, sf).where(share >= 0.7)
            .select("doc_id", F.round(share, 6).alias("share")))


@register("clean_on_sites", f"SELECT page_id FROM pages WHERE {O.site_sql(TEST_SITES)}")
def q_clean_on_sites(spark, sf):
    return C.on_sites(table(spark, sf, "pages"), list(TEST_SITES)).select("page_id")


@register("clean_on_sites_table", f"SELECT page_id FROM pages WHERE {O.site_sql(TEST_SITES)}")
def q_clean_on_sites_table(spark, sf):
    hosts = spark.createDataFrame([(h,) for h in TEST_SITES], "site string")
    return C.on_sites(table(spark, sf, "pages"), hosts, key="page_id").select("page_id")


_MARK_RX = C.markup_regex(TEST_MARKERS)


@register("clean_cut_markup", f"SELECT doc_id, regexp_replace(text, '(?s){_MARK_RX}.*$', '') AS text FROM documents")
def q_clean_cut_markup(spark, sf):
    return C.cut_markup(table(spark, sf, "documents").select("doc_id", "text"), TEST_MARKERS, "cut")


@register("clean_markup_lines", f"""SELECT doc_id, array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)),
  lambda l: NOT regexp_matches(l, '{_MARK_RX}')), chr(10)) AS text FROM documents""")
def q_clean_markup_lines(spark, sf):
    return C.cut_markup(table(spark, sf, "documents").select("doc_id", "text"), TEST_MARKERS, "line")


@register("clean_with_label", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def q_clean_with_label(spark, sf):
    return C.with_label(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), 1,
                        "doc_id", "quality")


@register("clean_not_query_copy", f"""WITH {O.QUERIES}, {O.CANDS}
SELECT c.qid, c.idx FROM cands c JOIN queries q USING (qid)
WHERE NOT (coalesce(q.query, '') = coalesce(c.text, '') OR
  (abs(length(coalesce(q.query, '')) - length(coalesce(c.text, ''))) <= 10
   AND levenshtein(coalesce(q.query, ''), coalesce(c.text, '')) <= 10))""")
def q_clean_not_query_copy(spark, sf):
    c = standins.candidates(spark, sf).join(standins.queries(spark, sf), "qid")
    return c.where(C.not_query_copy(10)).select("qid", "idx")


@register("clean_unique_share", _DOC_T + """, s AS (SELECT doc_id,
  CASE WHEN len(t) = 0 THEN 0.0 ELSE len(list_distinct(t)) / len(t) END AS share FROM d)
SELECT doc_id, round(share, 6) AS share FROM s WHERE share >= 0.6""")
def q_clean_unique_share(spark, sf):
    v = C.unique_share_value()
    return _docs(spark, sf).where(C.min_unique_share(0.6)).select("doc_id", F.round(v, 6).alias("share"))


@register("clean_max_word_len", _DOC_T + """, s AS (SELECT doc_id,
  coalesce(list_max(list_transform(t, lambda x: length(x))), 0)::BIGINT AS longest FROM d)
SELECT doc_id, longest FROM s WHERE longest <= 15""")
def q_clean_max_word_len(spark, sf):
    return (_docs(spark, sf).where(C.max_word_len(15))
            .select("doc_id", C.longest_word().cast("long").alias("longest")))


@register("clean_min_sentences", f"""SELECT doc_id, {O.sentences_sql()}::BIGINT AS n_sentences FROM documents
WHERE {O.sentences_sql()} >= 3""")
def q_clean_min_sentences(spark, sf):
    from rankshift.functions.text import sentence_count
    return (table(spark, sf, "documents").where(C.min_sentences(3))
            .select("doc_id", sentence_count("text").cast("long").alias("n_sentences")))


@register("clean_has_punctuation", r"SELECT doc_id FROM documents WHERE regexp_matches(coalesce(text, ''), '\p{P}')")
def q_clean_has_punctuation(spark, sf):
    return table(spark, sf, "documents").where(C.has_punctuation()).select("doc_id")


_NLS = (f"1.0 - CASE WHEN length(coalesce(text, '')) = 0 THEN 0.0 "
        f"ELSE {O.letters('text')} / length(coalesce(text, '')) END")


@register("clean_non_letter_share", f"""WITH s AS (SELECT doc_id, {_NLS} AS share FROM documents)
SELECT doc_id, round(share, 6) AS share FROM s WHERE NOT (share < 0.18)""")
def q_clean_non_letter_share(spark, sf):
    return (table(spark, sf, "documents").where(C.non_letter_share(0.18, "<"))
            .select("doc_id", F.round(C.non_letter_share_value(), 6).alias("share")))


_EXTRA = {"max_word_len": 15, "min_unique_share": 0.6, "min_sentences": 3, "has_punctuation": True,
          "non_letter_share": 0.1}
_COMMON = {"min_letters": 200, "max_tokens": 1000, "word_patterns": C.LANG_WORD, "word_share": 0.7}


@register("clean_funnel", _DOC_T + f""", f AS (SELECT
  {O.letters('text')} > 200 AS k1, len(t) < 1000 AS k2, ({O.word_share_sql()}) >= 0.7 AS k3,
  coalesce(list_max(list_transform(t, lambda x: length(x))), 0) <= 15 AS k4,
  (CASE WHEN len(t) = 0 THEN 0.0 ELSE len(list_distinct(t)) / len(t) END) >= 0.6 AS k5,
  {O.sentences_sql()} >= 3 AS k6,
  regexp_matches(coalesce(text, ''), '\\p{{P}}') AS k7,
  NOT (({_NLS}) < 0.1) AS k8 FROM d)
SELECT count(*) AS n_in, count_if(NOT k1)::BIGINT AS removed_min_letters,
  count_if(k1 AND NOT k2)::BIGINT AS removed_max_tokens, count_if(k1 AND k2 AND NOT k3)::BIGINT AS removed_word_share,
  count_if(k1 AND k2 AND k3 AND NOT k4)::BIGINT AS removed_max_word_len,
  count_if(k1 AND k2 AND k3 AND k4 AND NOT k5)::BIGINT AS removed_min_unique_share,
  count_if(k1 AND k2 AND k3 AND k4 AND k5 AND NOT k6)::BIGINT AS removed_min_sentences,
  count_if(k1 AND k2 AND k3 AND k4 AND k5 AND k6 AND NOT k7)::BIGINT AS removed_has_punctuation,
  count_if(k1 AND k2 AND k3 AND k4 AND k5 AND k6 AND k7 AND NOT k8)::BIGINT AS removed_non_letter_share,
  count_if(k1 AND k2 AND k3 AND k4 AND k5 AND k6 AND k7 AND k8)::BIGINT AS n_out FROM f""")
def q_clean_funnel(spark, sf):
    return C.funnel(_docs(spark, sf), "common", {**_COMMON, **_EXTRA})


def _page_docs(spark, sf):
    lang = F.regexp_extract("html", '<html lang="([a-z]+)"', 1)
    return _page_rows(spark, sf, "page_id", lang.alias("lang"))


@register("clean_preset_ds1", f"""WITH p AS (SELECT page_id, url, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang,
  regexp_replace(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')),
                 '(?s){_MARK_RX}.*$', '') AS text FROM pages),
d AS (SELECT *, {O.tok('text')} AS t FROM p)
SELECT page_id, text FROM d WHERE {O.letters('text')} > 200 AND len(t) < 1000 AND ({O.word_share_sql()}) >= 0.7
  AND {O.site_sql(TEST_SITES)}""")
def q_clean_preset_ds1(spark, sf):
    params = {**_COMMON, "sites": list(TEST_SITES), "markers": TEST_MARKERS}
    return C.clean(_page_docs(spark, sf), "ds1", params).select("page_id", "text")


@register("clean_preset_ds2", _DOC_T + f"""
SELECT doc_id FROM d WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
  AND {O.letters('text')} > 200 AND len(t) < 1000 AND ({O.word_share_sql()}) >= 0.7""")
def q_clean_preset_ds2(spark, sf):
    params = {**_COMMON, "label_value": 1, "label_col": "quality"}
    return C.clean(_docs(spark, sf), "ds2", params, labels=table(spark, sf, "labels")).select("doc_id")


# ------------------------------------------------------ tokens, blocks (§2.4)

from rankshift.operators import tokens as TK  # noqa: E402


def _doc_tokens(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("ord"), "text", F.col("text").alias("_t")).transform(
        lambda x: C.with_tokens(x, "text"))


def _ids_str(c):
    return F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), " ")


@register("build_vocab", f"WITH {O.VOCAB} SELECT tok, id, cnt FROM vocab")
def q_build_vocab(spark, sf):
    return TK.build_vocab(_doc_tokens(spark, sf))


@register("tokenize", f"""WITH {O.VOCAB}, {O.DOC_IDS}
SELECT doc_id, array_to_string(list_resize(l, 32, 0), ' ') AS input_ids FROM ids""")
def q_tokenize(spark, sf):
    d = _doc_tokens(spark, sf)
    v = TK.build_vocab(d)
    ids = TK.encode(d, v, "ord", "text", "input_ids", max_len=32, pad=True)
    return ids.select(F.col("ord").alias("doc_id"), _ids_str("input_ids").alias("input_ids"))


@register("tokenize_whole", f"""WITH {O.VOCAB}, {O.DOC_IDS}
SELECT doc_id, array_to_string(l, ' ') AS input_ids FROM ids""")
def q_tokenize_whole(spark, sf):
    d = _doc_tokens(spark, sf)
    ids = TK.encode(d, TK.build_vocab(d), "ord", "text", "input_ids")
    return ids.select(F.col("ord").alias("doc_id"), _ids_str("input_ids").alias("input_ids"))


@register("tokenize_bounded_vocab", f"""WITH {O.VOCAB.replace("vocab AS (", "vocab0 AS (")},
vocab AS (SELECT * FROM vocab0 WHERE id < 7 + 500), {O.DOC_IDS}
SELECT doc_id, array_to_string(list_resize(l, 32, 0), ' ') AS input_ids FROM ids""")
def q_tokenize_bounded_vocab(spark, sf):
    d = _doc_tokens(spark, sf)
    v = TK.build_vocab(d, size=500)
    ids = TK.encode(d, v, "ord", "text", "input_ids", max_len=32, pad=True, bounded_vocab=True)
    return ids.select(F.col("ord").alias("doc_id"), _ids_str("input_ids").alias("input_ids"))


@register("tokenize_left_pad_gpt", f"""WITH {O.VOCAB}, {O.DOC_IDS}
SELECT doc_id, array_to_string(list_concat(list_resize([]::INTEGER[], 32 - least(len(l), 32), 0), l[1:32]), ' ')
  AS input_ids FROM ids""")
def q_tokenize_left_pad_gpt(spark, sf):
    d = _doc_tokens(spark, sf)
    v = TK.build_vocab(d, special=TK.GPT_SPECIAL)
    ids = TK.encode(d, v, "ord", "text", "input_ids", max_len=32, pad=True, special=TK.GPT_SPECIAL)
    return ids.select(F.col("ord").alias("doc_id"), _ids_str("input_ids").alias("input_ids"))


@register("detokenize", f"SELECT doc_id, array_to_string({O.tok('text')}, ' ') AS text FROM documents")
def q_detokenize(spark, sf):
    d = _doc_tokens(spark, sf)
    v = materialize(TK.build_vocab(d), "vocab")  # counted once for both ways
    ids = TK.encode(d, v, "ord", "text", "input_ids")
    return TK.decode(ids, v, "ord", "input_ids", "text").select(F.col("ord").alias("doc_id"), "text")


@register("src_tokenized_parquet", f"""WITH {O.VOCAB}, {O.DOC_IDS}
SELECT doc_id, array_to_string(l, ' ') AS input_ids FROM ids""")
def q_src_tokenized_parquet(spark, sf):
    d = _doc_tokens(spark, sf)
    ids = TK.encode(d, TK.build_vocab(d), "ord", "text", "input_ids")
    path = scratch_path(spark, "tokenized")
    sinks.write_tokenized(ids, path)
    back = readers.read_tokenized(spark, path)
    return back.select(F.col("ord").alias("doc_id"), _ids_str("input_ids").alias("input_ids"))


@register("clm_text_passages", f"""WITH {O.FIRST_USER}, {O.ANSWERS},
a AS (SELECT fu.conv_id, string_agg(CASE WHEN ans.pos = 0 THEN coalesce(fu.query, '') || coalesce(ans.text, '')
        ELSE coalesce(ans.text, '') END, '' ORDER BY ans.pos) AS text
      FROM fu JOIN ans USING (conv_id) GROUP BY fu.conv_id)
SELECT fu.conv_id AS ord, coalesce(a.text, '') AS text FROM fu LEFT JOIN a USING (conv_id)""")
def q_clm_text_passages(spark, sf):
    return TK.clm_text_passages(standins.qa_rows(spark, sf)).select("ord", "text")


@register("clm_text_pairs", f"WITH {O.PAIRS} SELECT ord, query || ' ' || body || '</s>' AS text FROM pairs")
def q_clm_text_pairs(spark, sf):
    return TK.clm_text_pairs(standins.qa_pairs(spark, sf)).select("ord", "text")


def _cut_sql(b: int, inclusive: bool) -> str:
    stop = f"len(t) - {b}" if inclusive else f"len(t) - {b} - 1"
    return f"""WITH d AS (SELECT doc_id, {O.tok('text')} AS t FROM documents),
s AS (SELECT doc_id, t, unnest(generate_series(0, {stop}, {b})) AS st FROM d WHERE {stop} >= 0)
SELECT doc_id, (st // {b})::INTEGER AS block, array_to_string(t[st + 1 : st + {b}], ' ') AS text FROM s"""


@register("cut_blocks", _cut_sql(64, False))
def q_cut_blocks(spark, sf):
    b = TK.cut_blocks(_doc_tokens(spark, sf), 64, "tokens", "ord", "exclusive", "piece")
    return b.select(F.col("ord").alias("doc_id"), "block", F.array_join("piece", " ").alias("text"))


@register("cut_blocks_inclusive", _cut_sql(64, True))
def q_cut_blocks_inclusive(spark, sf):
    b = TK.cut_blocks(_doc_tokens(spark, sf), 64, "tokens", "ord", "inclusive", "piece")
    return b.select(F.col("ord").alias("doc_id"), "block", F.array_join("piece", " ").alias("text"))


@register("pack_corpus", f"""WITH d AS (SELECT doc_id, {O.tok('text')} AS t FROM documents),
e AS (SELECT doc_id, unnest(t) AS tok, unnest(generate_series(1, len(t))) AS pos FROM d),
g AS (SELECT tok, row_number() OVER (ORDER BY doc_id, pos) - 1 AS gp FROM e)
SELECT (gp // 64)::BIGINT AS block, string_agg(tok, ' ' ORDER BY gp) AS text FROM g GROUP BY 1 HAVING count(*) = 64""")
def q_pack_corpus(spark, sf):
    p = TK.pack_corpus(_doc_tokens(spark, sf), 64, "tokens", "ord", width=97)
    return p.select("block", F.array_join("input_ids", " ").alias("text"))


@register("collate", f"""WITH {O.VOCAB}, {O.DOC_IDS},
b AS (SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 8)::BIGINT AS batch_id, l AS labels FROM ids),
m AS (SELECT batch_id, max(len(labels)) AS mx FROM b GROUP BY batch_id)
SELECT doc_id, batch_id, array_to_string(list_concat(labels, list_resize([]::INTEGER[], mx - len(labels), -100)), ' ')
  AS labels FROM b JOIN m USING (batch_id)""")
def q_collate(spark, sf):
    d = _doc_tokens(spark, sf)
    ids = materialize(TK.encode(d, TK.build_vocab(d), "ord", "text", "labels"), "ids")
    c = TK.collate(prep.with_batch_id(ids, 8, "ord"), "batch_id", "labels")
    return c.select(F.col("ord").alias("doc_id"), "batch_id", _ids_str("labels").alias("labels"))


def _draw_sql(salt: int) -> str:
    return f"('0x' || substr(md5(concat('{salt}:1:', doc_id::VARCHAR, ':', (i - 1)::VARCHAR)), 1, 8))::BIGINT"


_PICKED_SQL = f"x >= 7 AND {_draw_sql(1)} / 4294967296::DOUBLE < 0.15"


@register("mask_tokens", f"""WITH {O.VOCAB}, {O.DOC_IDS},
z AS (SELECT doc_id, l, (SELECT count(*) FROM vocab) AS v FROM ids)
SELECT doc_id, array_to_string(list_transform(l, lambda x, i: CASE WHEN NOT ({_PICKED_SQL}) THEN x
    WHEN {_draw_sql(2)} / 4294967296::DOUBLE < 0.8 THEN 6
    WHEN {_draw_sql(2)} / 4294967296::DOUBLE < 0.9 THEN {_draw_sql(3)} % greatest(v - 7, 1) + 7 ELSE x END), ' ') AS input_ids,
  array_to_string(list_transform(l, lambda x, i: CASE WHEN {_PICKED_SQL} THEN x ELSE -100 END), ' ') AS labels
FROM z""")
def q_mask_tokens(spark, sf):
    d = _doc_tokens(spark, sf)
    v = materialize(TK.build_vocab(d), "vocab")
    ids = TK.encode(d, v, "ord", "text", "input_ids")
    m = TK.mask_tokens(ids, "ord", "input_ids", 0.15, seed=1, vocab_size=v.count())
    return m.select(F.col("ord").alias("doc_id"), _ids_str("input_ids").alias("input_ids"),
                    _ids_str("labels").alias("labels"))


def _vocab_sql(src: str) -> str:
    """Vocabulary CTE over the word tokens of ``src`` (a SQL text column expression)."""
    return f"""vc AS (SELECT tok, count(*) AS cnt FROM (SELECT unnest({O.tok(src)}) AS tok FROM src) GROUP BY tok),
vocab AS (SELECT tok, (row_number() OVER (ORDER BY cnt DESC, tok) - 1 + 7)::INTEGER AS id, cnt FROM vc
          UNION ALL SELECT tok, id::INTEGER, cnt::BIGINT FROM (VALUES {O.SPECIAL_VALUES}) s(tok, id, cnt))"""


def _ids_sql(col: str, name: str) -> str:
    """(ord, l): ids of the word tokens of ``col`` of table ``src``, in order."""
    return f"""{name}_t AS (SELECT ord, {O.tok(col)} AS t FROM src),
{name}_e AS (SELECT ord, unnest(t) AS tok, unnest(generate_series(1, len(t))) AS pos FROM {name}_t),
{name}_l AS (SELECT e.ord, list(coalesce(vocab.id, 5) ORDER BY pos) AS l FROM {name}_e e LEFT JOIN vocab USING (tok)
             GROUP BY e.ord),
{name} AS (SELECT t.ord, coalesce(x.l, []::INTEGER[]) AS l FROM {name}_t t LEFT JOIN {name}_l x USING (ord))"""


_CLM_SRC = f"""WITH {O.FIRST_USER}, {O.ANSWERS},
a AS (SELECT fu.conv_id, string_agg(CASE WHEN ans.pos = 0 THEN coalesce(fu.query, '') || coalesce(ans.text, '')
        ELSE coalesce(ans.text, '') END, '' ORDER BY ans.pos) AS text
      FROM fu JOIN ans USING (conv_id) GROUP BY fu.conv_id),
src AS (SELECT fu.conv_id AS ord, coalesce(a.text, '') AS text FROM fu LEFT JOIN a USING (conv_id)),
{_vocab_sql('text')},
{_ids_sql('text', 'ids')},
blk AS (SELECT ord, l, unnest(generate_series(0, len(l) - 64 - 1, 64)) AS st FROM ids WHERE len(l) - 64 - 1 >= 0)
SELECT ord, (st // 64)::INTEGER AS block, array_to_string(l[st + 1 : st + 64], ' ') AS input_ids,
       array_to_string(l[st + 1 : st + 64], ' ') AS labels FROM blk"""


@register("training_table_clm", _CLM_SRC)
def q_training_table_clm(spark, sf):
    qa = standins.qa_rows(spark, sf)
    v = TK.build_vocab(C.with_tokens(TK.clm_text_passages(qa)))
    t = TK.training_table(qa, v, "part_data", "clm", block=64)
    return t.select("ord", "block", _ids_str("input_ids").alias("input_ids"), _ids_str("labels").alias("labels"))


# padded on the left up to 128 ids, never cut, then blocks of 64
@register("training_table_clm_made", f"""WITH {O.PAIRS},
src AS (SELECT ord, query || ' ' || body || '</s>' AS text FROM pairs),
{_vocab_sql('text')},
{_ids_sql('text', 'ids')},
padded AS (SELECT ord, list_concat(list_resize([]::INTEGER[], greatest(128 - len(l), 0), 0), l) AS l FROM ids),
blk AS (SELECT ord, l, unnest(generate_series(0, len(l) - 64 - 1, 64)) AS st FROM padded)
SELECT ord, (st // 64)::INTEGER AS block, array_to_string(l[st + 1 : st + 64], ' ') AS input_ids,
       array_to_string(l[st + 1 : st + 64], ' ') AS labels FROM blk""")
def q_training_table_clm_made(spark, sf):
    """TOK13 / TOK7: labelled texts padded to the context before they are cut, so short ones give a block too."""
    pairs = standins.qa_pairs(spark, sf)
    v = TK.build_vocab(C.with_tokens(TK.clm_text_pairs(pairs)), special=TK.GPT_SPECIAL)
    t = TK.training_table(pairs, v, "made_data", "clm", block=64, context=128, special=TK.GPT_SPECIAL)
    return t.select("ord", "block", _ids_str("input_ids").alias("input_ids"), _ids_str("labels").alias("labels"))


# ids cut to 256 before the blocks
@register("training_table_clm_limit", _CLM_SRC.replace("FROM ids WHERE", "FROM (SELECT ord, l[1:256] AS l FROM ids) WHERE"))
def q_training_table_clm_limit(spark, sf):
    """TOK13 / TOK5: nested texts cut at the tokenizer's own limit."""
    qa = standins.qa_rows(spark, sf)
    v = TK.build_vocab(C.with_tokens(TK.clm_text_passages(qa)))
    t = TK.training_table(qa, v, "part_data", "clm", block=64, limit=256)
    return t.select("ord", "block", _ids_str("input_ids").alias("input_ids"), _ids_str("labels").alias("labels"))


@register("training_table_full", f"""WITH {O.PAGE_ROWS.replace('SELECT url,', 'SELECT page_id AS ord, url,')},
src AS (SELECT ord, concat_ws(chr(9), url, query, text) AS text FROM page_rows),
{_vocab_sql('text')},
{_ids_sql('text', 'ids')},
e AS (SELECT ord, unnest(l) AS id, unnest(generate_series(1, len(l))) AS pos FROM ids),
g AS (SELECT id, row_number() OVER (ORDER BY ord, pos) - 1 AS at_ FROM e)
SELECT (at_ // 64)::BIGINT AS block, string_agg(id::VARCHAR, ' ' ORDER BY at_) AS input_ids,
       string_agg(id::VARCHAR, ' ' ORDER BY at_) AS labels FROM g GROUP BY 1 HAVING count(*) = 64""")
def q_training_table_full(spark, sf):
    """TOK13 / TOK8: raw records packed into blocks across records."""
    raw = _page_rows(spark, sf, F.col("page_id").alias("ord"))
    text = raw.select("ord", F.concat_ws("\t", "url", "query", "text").alias("text"))
    v = TK.build_vocab(C.with_tokens(text))
    t = TK.training_table(raw, v, "full_data", block=64)
    return t.select("block", _ids_str("input_ids").alias("input_ids"), _ids_str("labels").alias("labels"))


def _teacher_src(query: str, select: str) -> str:
    return f"""WITH {O.PAIRS},
src AS (SELECT ord, {query} AS query, body, query || ' ' || body || '</s>' AS text, label FROM pairs),
{_vocab_sql('text')},
{_ids_sql('query', 'qi')},
{_ids_sql('body', 'ti')}
{select} FROM src JOIN qi USING (ord) JOIN ti USING (ord)"""


def _teacher(spark, sf, family, split="train"):
    pairs = standins.qa_pairs(spark, sf)
    v = TK.build_vocab(C.with_tokens(TK.clm_text_pairs(pairs)))
    t = TK.training_table(pairs, v, "made_data", "teacher", max_len=48, target_len=64, family=family, split=split)
    return t.select("ord", *[_ids_str(c).alias(c) for c in t.columns if c != "ord"])


# query padded on the left and cut to 48; target cut to 64; neither eos nor padding for the target
@register("training_table_teacher", _teacher_src("query", """SELECT src.ord,
  array_to_string(list_concat(list_resize([]::INTEGER[], greatest(48 - len(qi.l), 0), 0), qi.l[1:48]), ' ') AS input_ids,
  array_to_string(ti.l[1:64], ' ') AS labels, CAST(src.label AS VARCHAR) AS pos_label"""))
def q_training_table_teacher(spark, sf):
    return _teacher(spark, sf, "gpt")


# prefix + query padded on the right and cut to 48; target + eos cut and padded to 64
@register("training_table_t5", _teacher_src("query", """, x AS (SELECT src.ord, coalesce(v.id, 5) AS lm, qi.l AS q, ti.l AS t
  FROM src JOIN qi USING (ord) JOIN ti USING (ord) LEFT JOIN vocab v ON v.tok = 'lm')
SELECT ord, array_to_string(list_resize(list_concat([lm], q)[1:48], 48, 0), ' ') AS input_ids,
  array_to_string(list_resize(list_concat(t, [3])[1:64], 64, 0), ' ') AS labels FROM x --""") + "\n")
def q_training_table_t5(spark, sf):
    return _teacher(spark, sf, "t5")


@register("training_table_t5_valid", _teacher_src("query", """, x AS (SELECT src.ord, coalesce(v.id, 5) AS lm, qi.l AS q
  FROM src JOIN qi USING (ord) LEFT JOIN vocab v ON v.tok = 'lm')
SELECT ord, array_to_string(list_resize(list_concat([lm], q)[1:48], 48, 0), ' ') AS input_ids FROM x --""") + "\n")
def q_training_table_t5_valid(spark, sf):
    return _teacher(spark, sf, "t5", "validation")


# ------------------------------------------------- language model, metrics (§2.5-2.6)

from rankshift.operators import buckets as BK, ngram as NG  # noqa: E402
from rankshift.operators import metrics as M  # noqa: E402


def _doc_lm(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    return d, NG.train_bigram_lm(d)


@register("ngram_counts", f"WITH {O.BIGRAMS_DOCS} SELECT lang, w1, w2, c FROM bg")
def q_ngram_counts(spark, sf):
    d = table(spark, sf, "documents").select("lang", "text")
    return NG.train_bigram_lm(d, written=False)["bigrams"]


def _self_perplexity(spark, sf):
    """Train on the documents and score them, tokenizing once."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    counted = NG.doc_bigrams(d)
    return NG.perplexity(d, NG.train_bigram_lm(d, counted=counted), counted=counted)


@register("perplexity", f"WITH {O.BIGRAMS_DOCS} SELECT doc_id, lang, perplexity FROM ppl")
def q_perplexity(spark, sf):
    return _self_perplexity(spark, sf)


@register("perplexity_uncounted", f"WITH {O.BIGRAMS_DOCS} SELECT doc_id, lang, perplexity FROM ppl")
def q_perplexity_uncounted(spark, sf):
    d, lm = _doc_lm(spark, sf)
    return NG.perplexity(d, lm)


@register("perplexity_filter", f"""WITH {O.BIGRAMS_DOCS},
cut AS (SELECT lang, quantile_cont(perplexity, 1.0 / 3.0) AS c FROM ppl GROUP BY lang)
SELECT doc_id, lang, perplexity FROM ppl JOIN cut USING (lang) WHERE perplexity <= c""")
def q_perplexity_filter(spark, sf):
    return NG.perplexity_keep(materialize(_self_perplexity(spark, sf), "perplexity"), 1.0 / 3.0)


@register("perplexity_buckets", f"""WITH {O.BIGRAMS_DOCS},
cut AS (SELECT lang, quantile_cont(perplexity, 1.0 / 3.0) AS c1, quantile_cont(perplexity, 2.0 / 3.0) AS c2 FROM ppl GROUP BY lang)
SELECT doc_id, lang, perplexity, CASE WHEN perplexity <= c1 THEN 'head' WHEN perplexity <= c2 THEN 'middle' ELSE 'tail' END AS bucket
FROM ppl JOIN cut USING (lang)""")
def q_perplexity_buckets(spark, sf):
    """CLN7 over two corpora stored one after the other; the second is added without scoring the first again."""
    ppl = materialize(_self_perplexity(spark, sf), "perplexity")
    folder = scratch_path(spark, "score_store")
    parts = prep.hash_split(ppl, "doc_id", 0.85, 123)
    for corpus in ("train", "test"):
        BK.add_corpus(parts.where(F.col("split") == corpus).drop("split"), folder, corpus)
    return BK.bucketed(spark, folder).select("doc_id", "lang", "perplexity", "bucket")


@register("clean_preset_ds2_ppl", _DOC_T.replace("WITH ", f"WITH {O.BIGRAMS_DOCS},\n") + f""",
cut AS (SELECT lang, quantile_cont(perplexity, 1.0 / 3.0) AS c FROM ppl GROUP BY lang),
keep AS (SELECT doc_id FROM ppl JOIN cut USING (lang) WHERE perplexity <= c)
SELECT doc_id FROM d WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
  AND {O.letters('text')} > 200 AND len(t) < 1000 AND ({O.word_share_sql()}) >= 0.7
  AND doc_id IN (SELECT doc_id FROM keep)""")
def q_clean_preset_ds2_ppl(spark, sf):
    ppl = materialize(_self_perplexity(spark, sf), "perplexity")
    keep = NG.perplexity_keep(ppl, 1.0 / 3.0).select("doc_id")
    params = {**_COMMON, "label_value": 1, "label_col": "quality"}
    return C.clean(_docs(spark, sf), "ds2", params, labels=table(spark, sf, "labels"),
                   ppl_keep=keep).select("doc_id")


def _bleu_sql(max_order: int = 4) -> str:
    parts = []
    for n in range(1, max_order + 1):
        parts.append(f"""h{n} AS (SELECT ord, g, count(*) AS hc FROM (SELECT ord, unnest({O.ngrams_sql('h', n)}) AS g FROM tk) GROUP BY ALL),
r{n} AS (SELECT ord, g, count(*) AS rc FROM (SELECT ord, unnest({O.ngrams_sql('r', n)}) AS g FROM tk) GROUP BY ALL),
m{n} AS (SELECT {n} AS ord_n, sum(least(hc, coalesce(rc, 0))) AS match, sum(hc) AS total
         FROM h{n} LEFT JOIN r{n} USING (ord, g))""")
    union = " UNION ALL ".join(f"SELECT * FROM m{n}" for n in range(1, max_order + 1))
    return f"""WITH {O.PAIRS},
tk AS (SELECT ord, {O.tok('query')} AS h, {O.tok('body')} AS r FROM pairs),
{','.join(parts)},
m AS ({union}),
agg AS (SELECT count_if(match > 0) AS nz, sum(CASE WHEN match > 0 THEN ln(match / total) END) AS logp FROM m),
lens AS (SELECT sum(len(h)) AS hyp_len, sum(len(r)) AS ref_len FROM tk)
SELECT round(CASE WHEN nz < {max_order} OR hyp_len = 0 THEN 0.0 ELSE
  (CASE WHEN hyp_len >= ref_len THEN 1.0 ELSE exp(1 - ref_len / hyp_len) END) * exp(logp / {max_order}) END, 6)
  AS bleu, hyp_len::BIGINT AS hyp_len, ref_len::BIGINT AS ref_len FROM agg, lens"""


@register("bleu", _bleu_sql(4))
def q_bleu(spark, sf):
    p = standins.qa_pairs(spark, sf).select(F.col("query").alias("hyp"), F.col("body").alias("ref"))
    return M.bleu(p, 4)


@register("bleu_unigram", _bleu_sql(1))
def q_bleu_unigram(spark, sf):
    p = standins.qa_pairs(spark, sf).select(F.col("query").alias("hyp"), F.col("body").alias("ref"))
    return M.bleu(p, 1)


# ------------------------------------------- variants, runs, generation (§2.5)

from rankshift.operators import generators as GN, kneser_ney as KN, sampling as SA, translation as TR  # noqa: E402
from rankshift.params import EvalParams, GenParams  # noqa: E402

LENGTHS = (50, 150, 300)
STRIPS = (False, True)
RUNS = tuple(f"echo_len{n}_{'stripped' if s else 'kept'}" for n in LENGTHS for s in STRIPS)


def _variant_metrics(spark, sf):
    from rankshift.plans.runs import run_metrics
    q = standins.queries(spark, sf)
    c = standins.candidates(spark, sf)
    g = gen_ops.variants(q, c, LENGTHS, STRIPS, "echo")
    return run_metrics(c, q, g)


@register("variant_metrics_direct")
def q_variant_metrics_direct(spark, sf):
    """Same as ``variant_metrics`` by appending each fake to a copy of its list."""
    q = standins.queries(spark, sf)
    c = standins.candidates(spark, sf)
    g = gen_ops.variants(q, c, LENGTHS, STRIPS, "echo")
    return evaluation.evaluate_fakes(c, q, g, ["run", "qid"])


def _variants_sql() -> str:
    grid = ", ".join(f"({n}, {'true' if s else 'false'}, 'echo_len{n}_{'stripped' if s else 'kept'}')"
                     for n in LENGTHS for s in STRIPS)
    cut = ("array_to_string(list_slice(string_split(b.text, ' '), 1, "
           "len(string_split(coalesce(b.query, ''), ' ')) + g.len), ' ')")
    return f"""{O.echo_cte('base', max(LENGTHS))},
grid AS (SELECT * FROM (VALUES {grid}) v(len, strip, run)),
based AS (SELECT b.qid, q.query, b.text FROM base b JOIN queries q USING (qid)),
cutv AS (SELECT b.qid, b.query, g.run, g.strip, {cut.replace('b.query', 'b.query')} AS text
         FROM based b CROSS JOIN grid g),
gen AS (SELECT qid, run, CASE WHEN strip THEN substr(text, length(coalesce(query, '')) + 1) ELSE text END AS text
        FROM cutv)"""


VARIANT_PREFIX = f"""WITH {O.QUERIES},
{O.CANDS},
{_variants_sql()},
qr AS (SELECT DISTINCT g.run, q.qid, q.query FROM gen g JOIN queries q USING (qid)),
{O.lists_cte('gen', 'run, qid')},
{O.bm25_ctes('lists', 'qr', 'run, qid')},
{O.tfcos_ctes('lists', 'qr', 'run, qid')},
scored AS (SELECT 'Bm25' AS ranker, b.run, b.qid, b.idx, b.score, l.label FROM bm25 b JOIN lists l USING (run, qid, idx)
           UNION ALL
           SELECT 'TfCosine' AS ranker, c.run, c.qid, c.idx, c.score, l.label FROM tfcos c JOIN lists l USING (run, qid, idx)),
{O.positions_ctes('scored', 'ranker, run, qid')},
met AS ({O.metrics_select('pos', 'ranker, run')})"""

_MET_COLS = ("avg_loc", "avg_rel_loc", "top_1", "top_3", "top_5", "fdaro_v1", "fdaro_v2", "up_quartile")
_NAME_SQL = "ranker || '_' || CASE metric " + " ".join(
    f"WHEN '{c}' THEN '{M.published_name(c)}'" for c in _MET_COLS) + " END"
REC_SQL = f"""rec AS (SELECT run, {_NAME_SQL} AS name, value::DOUBLE AS value FROM
  (UNPIVOT (SELECT ranker, run, {', '.join(_MET_COLS)} FROM met) ON {', '.join(_MET_COLS)} INTO NAME metric VALUE value))"""


@register("generate_variants", f"WITH {O.QUERIES}, {O.CANDS}, {_variants_sql()} SELECT qid, run, text FROM gen")
def q_generate_variants(spark, sf):
    return gen_ops.variants(standins.queries(spark, sf), standins.candidates(spark, sf), LENGTHS, STRIPS, "echo")


ORACLE["variant_metrics_direct"] = VARIANT_PREFIX + "\nSELECT * FROM met"


@register("variant_metrics", VARIANT_PREFIX + "\nSELECT * FROM met")
def q_variant_metrics(spark, sf):
    return _variant_metrics(spark, sf)


@register("metrics_record", VARIANT_PREFIX + f",\n{REC_SQL}\nSELECT run, name, value FROM rec")
def q_metrics_record(spark, sf):
    return M.metrics_record(_variant_metrics(spark, sf), names=list(_MET_COLS))


@register("compare_runs", VARIANT_PREFIX + f",\n{REC_SQL}\nSELECT name, "
          + ", ".join(f"max(CASE WHEN run = '{r}' THEN value END) AS \"{r}\"" for r in RUNS)
          + " FROM rec GROUP BY name")
def q_compare_runs(spark, sf):
    return M.compare_runs(M.metrics_record(_variant_metrics(spark, sf), names=list(_MET_COLS)), RUNS)


@register("best_run", VARIANT_PREFIX + f""",
{REC_SQL},
b1 AS (SELECT name, run, value, row_number() OVER (PARTITION BY name ORDER BY value DESC, run) AS rn
       FROM rec WHERE name = 'Bm25_Top@1'),
b2 AS (SELECT name, run, value, row_number() OVER (PARTITION BY name ORDER BY value ASC, run) AS rn
       FROM rec WHERE name = 'TfCosine_AverageLoc')
SELECT name, run, value FROM b1 WHERE rn = 1 UNION ALL SELECT name, run, value FROM b2 WHERE rn = 1""")
def q_best_run(spark, sf):
    rec = M.metrics_record(_variant_metrics(spark, sf), names=list(_MET_COLS))
    return M.best_run(rec, "Bm25_Top@1", True).unionByName(M.best_run(rec, "TfCosine_AverageLoc", False))


@register("length_histogram", f"""WITH {O.QUERIES}, {O.CANDS}, {_variants_sql()}
SELECT run, (floor(len({O.tok('text')}) / 25) * 25)::BIGINT AS bucket, count(*) AS n_texts FROM gen GROUP BY ALL""")
def q_length_histogram(spark, sf):
    g = gen_ops.variants(standins.queries(spark, sf), standins.candidates(spark, sf), LENGTHS, STRIPS, "echo")
    return M.length_histogram(g, 25, "text", ["run"])


@register("strip_prompt", f"""WITH {O.QUERIES}, {O.CANDS}, {O.echo_cte('gen', 150)}
SELECT g.qid, substr(g.text, length(coalesce(q.query, '')) + 1) AS text FROM gen g JOIN queries q USING (qid)""")
def q_strip_prompt(spark, sf):
    q, c = standins.queries(spark, sf), standins.candidates(spark, sf)
    g = gen_ops.echo_texts(q, c, 150).join(q, "qid")
    return gen_ops.strip_prompt(g).select("qid", "text")


@register("strip_prompt_checked", f"""WITH {O.QUERIES}, {O.CANDS}, {O.extractive_cte('gen', 150)}
SELECT g.qid, CASE WHEN starts_with(g.text, coalesce(q.query, '')) THEN substr(g.text, length(coalesce(q.query, '')) + 1)
  ELSE g.text END AS text FROM gen g JOIN queries q USING (qid)""")
def q_strip_prompt_checked(spark, sf):
    q, c = standins.queries(spark, sf), standins.candidates(spark, sf)
    g = gen_ops.extractive_texts(q, c, 150).join(q, "qid")
    return gen_ops.strip_prompt(g, check=True).select("qid", "text")


@register("extractive_texts", f"WITH {O.QUERIES}, {O.CANDS}, {O.extractive_cte('gen', 150)} SELECT qid, text FROM gen")
def q_extractive_texts(spark, sf):
    return gen_ops.extractive_texts(standins.queries(spark, sf), standins.candidates(spark, sf), 150)


def _generator_bigrams(spark, sf, by=()):
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    return materialize(NG.train_bigram_lm(d, by=by, written=False)["bigrams"], "generator_bigrams")


def _texts_sql(top: str, *ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([top, *ctes]) + "\n" + select


NGRAM = GenParams(do_sample=True, temperature=1.0, top_p=0.9, max_length=40, seed=123)


@register("generate_ngram", _texts_sql(
    O.QUERIES, O.generator_bigrams(), O.continuation_ctes(top_p=0.9), O.alias_ctes(),
    O.sampled_texts("queries", max_length=40), select="SELECT q.qid, q.query, g.text AS generated_text FROM queries q JOIN gtext g USING (qid)"))
def q_generate_ngram(spark, sf):
    """Texts drawn from the nucleus of the bigram model of all documents."""
    q = standins.queries(spark, sf)
    made = SA.sample_texts(q, _generator_bigrams(spark, sf), NGRAM.to_dict())
    return q.select("qid", "query").join(made, "qid")


@register("generate_ngram_join", _texts_sql(
    O.QUERIES, O.generator_bigrams(), O.continuation_ctes(), O.alias_ctes(), O.sampled_texts("queries", max_length=16),
    select="SELECT qid, text AS generated_text FROM gtext"))
def q_generate_ngram_join(spark, sf):
    """The same sampler without cuts of the continuation list, shorter texts."""
    params = GenParams(do_sample=True, temperature=1.0, top_p=1.0, top_k=0, max_length=16, seed=123)
    return SA.sample_texts(standins.queries(spark, sf), _generator_bigrams(spark, sf), params.to_dict())


@register("generate_greedy", _texts_sql(
    O.QUERIES, O.generator_bigrams(), O.continuation_ctes(top_k=1), O.alias_ctes(), O.sampled_texts("queries", max_length=12),
    select="SELECT qid, text AS generated_text FROM gtext"))
def q_generate_greedy(spark, sf):
    """GEN2 with ``do_sample`` off: always the most frequent follower."""
    params = GenParams(do_sample=False, max_length=12)
    return SA.sample_texts(standins.queries(spark, sf), _generator_bigrams(spark, sf), params.to_dict())


@register("generate_beam", _texts_sql(
    O.QUERIES, O.generator_bigrams(), O.continuation_ctes(temperature=1.5, top_p=0.9),
    O.beam_texts("queries", 2, 20, 123, True), select="SELECT qid, text AS generated_text FROM gtext"))
def q_generate_beam(spark, sf):
    """GEN2 as the reference's evaluation sets it: two beams together with sampling, temperature 1.5, top_p 0.9."""
    params = GenParams(do_sample=True, num_beams=2, temperature=1.5, top_p=0.9, max_length=20, seed=123)
    return SA.sample_texts(standins.queries(spark, sf), _generator_bigrams(spark, sf), params.to_dict())


@register("generate_beam_search", _texts_sql(
    O.QUERIES, O.generator_bigrams(), O.continuation_ctes(), O.beam_texts("queries", 3, 12, 123, False, 20),
    select="SELECT qid, text AS generated_text FROM gtext"))
def q_generate_beam_search(spark, sf):
    """GEN2: plain beam search with three beams, prompts cut to 20 words."""
    params = GenParams(do_sample=False, num_beams=3, top_p=1.0, max_length=12, max_input=20, seed=123)
    return SA.sample_texts(standins.queries(spark, sf), _generator_bigrams(spark, sf), params.to_dict())


@register("generate_grid", _texts_sql(
    O.QUERIES, O.generator_bigrams("lang"), O.continuation_ctes("lang", 0.8, 0, 0.95), O.alias_ctes("lang"),
    "grid AS (SELECT q.qid, m.lang, q.query FROM queries q CROSS JOIN (SELECT DISTINCT lang FROM gbg) m)",
    O.sampled_texts("grid", "qid, lang", "lang", 30, 7),
    select="SELECT q.qid, q.lang AS model, q.query, g.text AS generated_text FROM grid q JOIN gtext g USING (qid, lang)"))
def q_generate_grid(spark, sf):
    """GEN4: every query under every model; the models are the bigram models of the languages."""
    params = GenParams(do_sample=True, temperature=0.8, top_p=0.95, max_length=30, seed=7)
    b = _generator_bigrams(spark, sf, ("lang",)).withColumnRenamed("lang", "model")
    models = b.select("model").where("model is not null").distinct()  # one row a model
    q = standins.queries(spark, sf).select("qid", "query")
    grid = materialize(q.crossJoin(models), "grid")  # GEN4 is every query x every model
    made = SA.sample_texts(grid, b, params.to_dict(), keys=("qid", "model"), by=("model",))
    return grid.join(made, ["qid", "model"]).select("qid", "model", "query", "generated_text")


@register("pair_scores", f"""WITH {O.QUERIES},
{O.CANDS},
{O.echo_cte('gen')},
{O.lists_cte('gen')},
pt AS (SELECT l.qid, l.idx, list_distinct({O.tok('q.query')}) AS a, list_distinct({O.tok('l.text')}) AS b
       FROM lists l JOIN queries q USING (qid))
SELECT qid, idx, CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0.0
  ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS score FROM pt""")
def q_pair_scores(spark, sf):
    q, lists = _echo_lists(spark, sf)
    pairs = lists.join(q, "qid").select("qid", "idx", "query", "text")
    return rank.score_pairs(pairs, GN.overlap_scorer)


@register("pair_scores_em", f"""WITH {O.QUERIES},
{O.CANDS},
{O.echo_cte('gen')},
{O.lists_cte('gen')},
{O.PAIRS},
{O.translation_ctes()}
SELECT qid, idx, score FROM em""")
def q_pair_scores_em(spark, sf):
    """RNK4 with a scorer learned from the question/answer pairs in three rounds."""
    q, lists = _echo_lists(spark, sf)
    model = TR.train_translation(TR.word_pairs(standins.qa_pairs(spark, sf)))
    return TR.score_translation(lists, q, model)


# ------------------------------------------------------------ streaming (§2.7)

from rankshift.streaming import settings as ST  # noqa: E402


@register("latest_valid_setting", """WITH v AS (SELECT user_id, floor(value)::INTEGER AS wc, ts, event_id FROM events
  WHERE event_type = 'view' AND floor(value) BETWEEN 10 AND 1023),
r AS (SELECT user_id, wc, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn,
      count(*) OVER (PARTITION BY user_id) AS n FROM v)
SELECT user_id, wc AS word_count, n AS n_valid FROM r WHERE rn = 1""")
def q_latest_valid_setting(spark, sf):
    return ST.latest_valid_setting(table(spark, sf, "events"))


_STEPS = "WITH RECURSIVE " + O.settings_ctes(ST.MODEL_CHOICES, ST.START, ST.WORD_MIN, ST.WORD_MAX)
_STEP_ROWS = f"{_STEPS}\nSELECT {O.SETTINGS_COLUMNS} FROM steps WHERE seq > 0"


@register("settings_fold", _STEP_ROWS)
def q_settings_fold(spark, sf):
    return ST.settings_fold(table(spark, sf, "events"))


def run_settings_stream(spark, sf, max_files: int = 1):
    """Drive STR1 with the events table as a file stream (AvailableNow) into a
    Parquet sink under the shared checkpoint folder; returns the sink path."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # keyed state needs it, on any session
    events = table(spark, sf, "events")
    src = (spark.readStream.schema(events.schema).option("maxFilesPerTrigger", max_files)
           .option("pathGlobFilter", "events.parquet").parquet(sf))
    out, ckpt = scratch_path(spark, "settings_out"), scratch_path(spark, "settings_ckpt")
    q = (ST.settings_stream(src).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", ckpt).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return out


@register("settings_stream", _STEP_ROWS)
def q_settings_stream(spark, sf):
    return spark.read.schema(ST.OUT_SCHEMA).parquet(run_settings_stream(spark, sf))


@register("respond_stream", f"""{_STEPS}
SELECT user_id, event_id, model, word_count::INTEGER AS word_count,
  array_to_string(list_transform(generate_series(1, word_count), lambda i: text), ' ') AS generated_text
FROM steps WHERE outcome = 'request'""")
def q_respond_stream(spark, sf):
    """STR2 as a stream: the outcomes written by STR1 are read as a stream and answered by each chat's own model."""
    keys = list(ST.MODEL_CHOICES.values())

    def make(model):
        return GN.CycleGenerator(keys.index(model) if model in keys else 0)

    src = spark.readStream.schema(ST.OUT_SCHEMA).parquet(run_settings_stream(spark, sf))
    out, ckpt = scratch_path(spark, "answers_out"), scratch_path(spark, "answers_ckpt")
    answers = ST.respond(src, make)
    (answers.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(answers.schema).parquet(out)


@register("embed_rank_metrics", f"""WITH {O.QUERIES}, {O.CANDS}, {O.echo_cte('gen')}, {O.lists_cte('gen')},
{O.tfcos_ctes().replace("SELECT qid, idx, tok, count(*)", f"SELECT qid, idx, {O.u32('tok')} % 256 AS tok, count(*)")
 .replace("SELECT qid, tok, count(*)", f"SELECT qid, {O.u32('tok')} % 256 AS tok, count(*)")},
scored AS (SELECT 'HashEmb' AS ranker, c.qid, c.idx, c.score, l.label FROM tfcos c JOIN lists l USING (qid, idx)),
{O.positions_ctes()}
{O.metrics_select()}""")
def q_embed_rank_metrics(spark, sf):
    """RNK3 with the built-in hashing embedder on the echo lists."""
    q, lists = _echo_lists(spark, sf)
    terms = materialize(rank.list_terms(lists), "list_terms")
    s = rank.hashed_cosine_from_terms(terms, rank.query_terms(q))
    scored = s.join(rank.doc_table(terms).select("qid", "idx", "label"), ["qid", "idx"]).withColumn("ranker", F.lit("HashEmb"))
    return rank_metrics(rank.fake_positions(scored, ["ranker", "qid"]), ["ranker"])


@register("snk_examples_by_model", ORACLE["generate_grid"])
def q_snk_examples_by_model(spark, sf):
    """SNK6: one result set a model, written one after the other; each write leaves the others alone."""
    path = scratch_path(spark, "by_model")
    grid = materialize(q_generate_grid(spark, sf), "grid_texts")
    for half in (0, 1):
        sinks.write_by_model(grid.where(F.pmod(F.crc32(F.col("model").cast("binary")), F.lit(2)) == half), path)
    return spark.read.schema("qid long, query string, generated_text string, model string").json(path)


_RUN = EvalParams(launch_description="echo_stripped", strip_prompt=True, total_samples=500, number_examples_batch=3)


def _evaluated(spark, sf):
    folder = scratch_path(spark, "evaluation")
    run = evaluation.evaluate_run(standins.queries(spark, sf), standins.candidates(spark, sf), _RUN, folder)
    return folder, run


@register("evaluate_run", O.echo_eval_prefix(strip=True) + f""",
met AS ({O.metrics_select()})
SELECT {_NAME_SQL} AS name, value::DOUBLE AS value FROM
  (UNPIVOT (SELECT ranker, {', '.join(_MET_COLS)} FROM met) ON {', '.join(_MET_COLS)} INTO NAME metric VALUE value)""")
def q_evaluate_run(spark, sf):
    """One evaluation run from its parameters (generate, strip, mix, rank, measure, record), its record read back."""
    folder, run = _evaluated(spark, sf)
    back = spark.read.json(f"{folder}/metrics").where(F.col("run_id") == run)
    return back.select(F.explode(F.from_json("metrics", "map<string,double>")).alias("name", "value"))


@register("snk_examples", f"""WITH {O.QUERIES}, {O.CANDS}, {O.echo_cte('raw')},
b AS (SELECT q.query, substr(r.text, length(coalesce(q.query, '')) + 1) AS generated_text,
        (row_number() OVER (ORDER BY q.qid) - 1) // 8 AS batch FROM queries q JOIN raw r USING (qid)),
d AS (SELECT DISTINCT floor({O.u32("'123|' || r.i::VARCHAR")} / 4294967296.0::DOUBLE * n)::BIGINT AS batch
      FROM range(3) r(i), (SELECT max(batch) + 1 AS n FROM b))
SELECT query, generated_text FROM b WHERE batch IN (SELECT batch FROM d)""")
def q_snk_examples(spark, sf):
    """SNK5: the examples that an evaluation run keeps (all rows of three drawn batches), read back."""
    folder, run = _evaluated(spark, sf)
    back = spark.read.schema("query string, generated_text string, run_id string").json(f"{folder}/examples")
    return back.where(F.col("run_id") == run).select("query", "generated_text")


@register("perplexity_trigram", f"WITH {O.ngram_lm_ctes(3)} SELECT doc_id, lang, perplexity FROM nppl")
def q_perplexity_trigram(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    return NG.perplexity_ngram(d, NG.train_ngram_lm(d, 3))


@register("perplexity_kn", f"WITH {O.kn_ctes(3)} SELECT doc_id, lang, perplexity FROM kppl")
def q_perplexity_kn(spark, sf):
    """MET9 under a trigram model with modified Kneser-Ney smoothing, one for each language."""
    w = KN.doc_windows(table(spark, sf, "documents").select("doc_id", "lang", "text"))
    return KN.perplexity_kn(w, KN.train_kn(w))


@register("ngram_order_counts", f"""WITH {O.ngram_lm_ctes(3)}
SELECT lang, k, count(*) AS n_ngrams, sum(c)::BIGINT AS n_tokens FROM ncnt GROUP BY ALL""")
def q_ngram_order_counts(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    c = NG.train_ngram_lm(d, 3)["counts"]
    return c.groupBy("lang", "k").agg(F.count(F.lit(1)).alias("n_ngrams"), F.sum("c").cast("long").alias("n_tokens"))


@register("rank_metrics_echo_k234", O.echo_eval_prefix() + "\n" + O.metrics_select(ks=(2, 3, 4)))
def q_rank_metrics_echo_k234(spark, sf):
    """MET2 with the K values the reference's code passes (its notes say 1, 3, 5)."""
    return rank_metrics(_echo_positions(spark, sf), ["ranker"], ks=(2, 3, 4))


@register("snk_metrics_json", O.echo_eval_prefix() + f""",
met AS ({O.metrics_select()})
SELECT {_NAME_SQL} AS name, value::DOUBLE AS value FROM
  (UNPIVOT (SELECT ranker, {', '.join(_MET_COLS)} FROM met) ON {', '.join(_MET_COLS)}
   INTO NAME metric VALUE value)""")
def q_snk_metrics_json(spark, sf):
    """SNK4 + SNK7: the flat metrics record written as one JSON record under its
    run id, read back and flattened."""
    from rankshift.sources.sinks import run_id, write_metrics
    rec = M.metrics_record(rank_metrics(_echo_positions(spark, sf), ["ranker"]), names=list(_MET_COLS))
    path, rid = scratch_path(spark, "metrics_json"), run_id("echo_eval")
    write_metrics(rec, path, rid)
    back = spark.read.json(path).where(F.col("run_id") == rid)
    m = F.from_json("metrics", "map<string,double>")
    return back.select(F.explode(m).alias("name", "value"))


def _extractive_variants_sql() -> str:
    grid = ", ".join(f"({n}, {'true' if s else 'false'}, 'extractive_len{n}_{'stripped' if s else 'kept'}')"
                     for n in LENGTHS for s in STRIPS)
    return f"""WITH {O.QUERIES}, {O.CANDS}, {O.extractive_cte('base', max(LENGTHS))},
grid AS (SELECT * FROM (VALUES {grid}) v(len, strip, run)),
cutv AS (SELECT b.qid, q.query, g.run, g.strip,
           array_to_string(list_slice(string_split(b.text, ' '), 1, g.len), ' ') AS text
         FROM base b JOIN queries q USING (qid) CROSS JOIN grid g)
SELECT qid, run, CASE WHEN strip THEN substr(text, length(coalesce(query, '')) + 1) ELSE text END AS text FROM cutv"""


@register("generate_variants_extractive", _extractive_variants_sql())
def q_generate_variants_extractive(spark, sf):
    return gen_ops.variants(standins.queries(spark, sf), standins.candidates(spark, sf), LENGTHS, STRIPS,
                            "extractive")
