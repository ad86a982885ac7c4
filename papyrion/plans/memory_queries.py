"""Queries over translation memory, glossary, scores and engines, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyrion.functions import metrics as X
from papyrion.functions import text as T
from papyrion.operators import memory as M
from papyrion.operators import scoring as C
from papyrion.operators import segments as S
from papyrion.plans.tables import table
from papyrion.plans.text_queries import _KEY, _LINES, _TURN_PAIRS, turn_pairs

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def tm_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring turns put to the memory, some by turn number confirmed or corrected after."""
    pairs = turn_pairs(spark, sf_dir).withColumn("seq", F.col("conv_id") * 1000 + F.col("turn") * 10)
    confirm = pairs.where("turn % 3 = 0").withColumn("seq", F.col("seq") + 1)
    correct = pairs.where("turn % 5 = 1").withColumn("seq", F.col("seq") + 2).withColumn("tgt", F.concat(F.lit("fixed "), "tgt"))
    return M.puts(pairs, "seq", "de").unionByName(M.puts(confirm, "seq", "de", kind="confirm")).unionByName(M.puts(correct, "seq", "de", kind="correction", origin="user"))


_EVENTS = f"""p AS (SELECT conv_id * 1000 + turn * 10 AS seq, turn, src, tgt FROM ({_TURN_PAIRS})),
ev AS (SELECT seq, 'put' AS kind, {_KEY.format('src')} AS norm, src, tgt FROM p UNION ALL SELECT seq + 1, 'confirm', {_KEY.format('src')}, src, tgt FROM p WHERE turn % 3 = 0
  UNION ALL SELECT seq + 2, 'correction', {_KEY.format('src')}, src, 'fixed ' || tgt FROM p WHERE turn % 5 = 1),
fs AS (SELECT norm, min(seq) FILTER (kind = 'confirm') AS since, max(seq) FILTER (kind = 'correction') AS fixed_at FROM ev GROUP BY norm),
lv AS (SELECT ev.*, fs.since, fs.fixed_at FROM ev JOIN fs USING (norm) WHERE kind <> 'confirm' AND CASE WHEN fixed_at IS NOT NULL THEN kind = 'correction' ELSE since IS NULL OR seq < since END),
tm AS (SELECT norm, arg_max(src, seq) AS src_text, arg_max(tgt, seq) AS tgt_text, max(seq) AS updated_at, bool_or(since IS NOT NULL OR fixed_at IS NOT NULL) AS confirmed FROM lv GROUP BY norm)"""


@query(f"WITH {_EVENTS} SELECT norm, src_text, tgt_text, updated_at, confirmed FROM tm")
def tm_upsert_view(spark, sf_dir):
    return M.memory(tm_events(spark, sf_dir)).select("norm", "src_text", "tgt_text", "updated_at", "confirmed")


@query(f"WITH {_EVENTS} SELECT norm, tgt_text FROM tm WHERE confirmed")
def tm_confirm(spark, sf_dir):
    return M.confirmed_translation(M.memory(tm_events(spark, sf_dir))).select("norm", "tgt_text")


@query(f"WITH {_EVENTS} SELECT norm, tgt_text, confirmed FROM tm WHERE confirmed OR updated_at >= 50000")
def tm_purge(spark, sf_dir):
    return M.purged(M.memory(tm_events(spark, sf_dir)), 50000).select("norm", "tgt_text", "confirmed")


@query(f"WITH {_EVENTS} SELECT count(*) AS total, count(*) FILTER (confirmed) AS confirmed, count(*) FILTER (NOT confirmed) AS unconfirmed FROM tm")
def tm_stats(spark, sf_dir):
    return M.stats(M.memory(tm_events(spark, sf_dir)))


@query(f"WITH {_EVENTS} SELECT src_text, tgt_text FROM tm")
def tm_export(spark, sf_dir):
    return M.memory(tm_events(spark, sf_dir)).select("src_text", "tgt_text").orderBy("src_text", "tgt_text")


@query(f"WITH {_EVENTS} SELECT l.doc_id, l.ord, tm.tgt_text AS tgt FROM ({_LINES}) l LEFT JOIN tm ON tm.norm = {_KEY.format('l.line')}")
def tm_exact_lookup(spark, sf_dir):
    rows = S.lines(table(spark, sf_dir, "documents"))
    return M.exact(rows, M.memory(tm_events(spark, sf_dir)), "line", "de").select("doc_id", "ord", "tgt")


_CTX = "substr(sha1(coalesce(lag(text) OVER w, '') || chr(31) || coalesce(lead(text) OVER w, '')), 1, 16)"


@query(f"""WITH c AS (SELECT conv_id, turn, text, {_CTX} AS ctx FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
t AS (SELECT {_KEY.format('text')} AS norm, ctx, max(conv_id * 1000 + turn) AS seq FROM c GROUP BY ALL)
SELECT c.conv_id, c.turn, '[de] ' || b.text AS tgt FROM c JOIN t ON t.norm = {_KEY.format('c.text')} AND t.ctx = c.ctx JOIN c b ON b.conv_id * 1000 + b.turn = t.seq""")
def tm_context_lookup(spark, sf_dir):
    rows = S.context_hash(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    known = rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.col("text").alias("src"), S.echo(F.col("text"), "de").alias("tgt"), "ctx")
    tm = M.memory(M.puts(known, "seq", "de", ctx=F.col("ctx")))
    return M.exact(rows, tm, "text", "de", ctx=F.col("ctx")).select("conv_id", "turn", "tgt")


_TOKENS = r"list_distinct(list_filter(regexp_split_to_array({}, '[^\p{{L}}\p{{N}}]+'), lambda t: t <> ''))"


def _fuzzy_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q_id"), T.memory_key(F.col("text")).alias("norm"))
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("c_id"), T.memory_key(F.col("text")).alias("norm"), F.col("text").alias("tgt_text"))
    return queries, turns


@query(f"""WITH q AS (SELECT item_id AS q_id, {_KEY.format('text')} AS norm FROM benchmark), c AS (SELECT conv_id * 1000 + turn AS c_id, {_KEY.format('text')} AS norm FROM conversations),
qt AS (SELECT q_id, norm, unnest({_TOKENS.format('norm')}) AS t FROM q), ct AS (SELECT c_id, norm, unnest({_TOKENS.format('norm')}) AS t FROM c)
SELECT q_id, c_id, count(*) AS shared FROM qt JOIN ct USING (t) WHERE qt.norm <> ct.norm GROUP BY q_id, c_id""")
def fuzzy_candidates(spark, sf_dir):
    return M.overlaps(*_fuzzy_sides(spark, sf_dir))


@query()
def fuzzy_ratio(spark, sf_dir):
    out = M.fuzzy(*_fuzzy_sides(spark, sf_dir), least=0.3, cap=None, stated=True)
    return out.select("q_id", "c_id", "rank", F.round("score", 6).alias("score"))


@query("""WITH s AS (SELECT q.vec_id AS q_id, c.vec_id AS c_id, round(greatest(0, least(1, list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]))), 6) AS score FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, c_id) AS rank FROM s) SELECT q_id, c_id, rank, score FROM r WHERE rank <= 5""")
def embedding_cosine_topk(spark, sf_dir):
    """For a stated query set, the rows whose id is divisible by 50, the five nearest of all rows."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return M.nearest(rows.where("id % 50 = 0"), rows, 5)


def _glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    origin = F.when(F.col("p_size") % 3 == 0, "auto").when(F.col("p_size") % 3 == 1, "import").otherwise("user")
    return part.select(F.col("p_type").alias("term"), F.col("p_brand").alias("rendering"), origin.alias("origin"), F.when(F.col("p_partkey") % 2 == 0, "legal").otherwise("").alias("domain"), (F.col("p_size") == 50).alias("locked"), F.col("p_partkey").alias("seq"))


_GLOSS = """g AS (SELECT p_type AS term, p_brand AS rendering, CASE p_size % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS rank, p_partkey % 2 = 0 AS own, p_size = 50 AS locked, p_partkey AS seq FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY locked DESC, rank DESC, own DESC, seq DESC) AS n FROM g)"""


@query(f"WITH {_GLOSS} SELECT term, rendering, locked FROM r WHERE n = 1")
def glossary_resolve(spark, sf_dir):
    return M.resolved(_glossary(spark, sf_dir), "legal")


@query(f"""WITH {_GLOSS}, u AS (SELECT term, rendering, CASE WHEN locked THEN 2 ELSE 0 END AS p FROM r WHERE n = 1 UNION ALL SELECT n_name, upper(n_name), 1 FROM nation UNION ALL SELECT DISTINCT p_type, 'run', 1 FROM part WHERE p_size < 10)
SELECT term, arg_max(rendering, p) AS rendering FROM u GROUP BY term""")
def glossary_overlay(spark, sf_dir):
    run = table(spark, sf_dir, "nation").select(F.col("n_name").alias("term"), F.upper("n_name").alias("rendering"))
    run = run.unionByName(table(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_type").alias("term"), F.lit("run").alias("rendering")).distinct())
    return M.overlaid(M.resolved(_glossary(spark, sf_dir), "legal"), run)


@query("""WITH e AS (SELECT o_custkey AS job_id, o_orderkey AS seq, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'done' ELSE 'queued' END AS status FROM orders), l AS (SELECT job_id, arg_max(status, seq) AS status FROM e GROUP BY job_id)
SELECT job_id, CASE WHEN status IN ('queued', 'running') THEN 'error' ELSE status END AS status FROM l""")
def jobs_recovered(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "done").otherwise("queued")
    events = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("seq"), F.lit("b").alias("batch_id"), status.alias("status"), F.lit(None).cast("string").alias("error"), F.col("o_orderdate").alias("updated"))
    return M.recovered(M.jobs(events)).select("job_id", "status")


@query(f"""WITH p AS (SELECT row_number() OVER () AS i, conv_id, turn, lower(src) AS r, lower(tgt) AS h FROM ({_TURN_PAIRS})), g AS (SELECT i, n, substr(r, k, n::INT) AS g, 1 AS side FROM p, range(1, 7) t(n), LATERAL (SELECT unnest(range(1, length(r) - n + 2)) AS k)
  UNION ALL SELECT i, n, substr(h, k, n::INT), 2 FROM p, range(1, 7) t(n), LATERAL (SELECT unnest(range(1, length(h) - n + 2)) AS k)),
c AS (SELECT i, n, g, count(*) FILTER (side = 1) AS a, count(*) FILTER (side = 2) AS b FROM g GROUP BY ALL), o AS (SELECT i, n, sum(least(a, b)) AS m, sum(a) AS ra, sum(b) AS hb FROM c GROUP BY ALL HAVING sum(a) > 0 AND sum(b) > 0),
f AS (SELECT i, avg(CASE WHEN m = 0 THEN 0 ELSE 5 * (m / hb) * (m / ra) / (4 * (m / hb) + (m / ra)) END) AS s FROM o GROUP BY i) SELECT conv_id, turn, round(coalesce(100 * s, 0), 6) AS chrf FROM p LEFT JOIN f USING (i)""")
def chrf_pairs(spark, sf_dir):
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", F.round(X.chrf(F.col("src"), F.col("tgt")), 6).alias("chrf"))


@query("SELECT p_partkey, round(levenshtein(p_name, p_type) / length(p_name), 6) AS cer FROM part")
def cer_pairs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(X.error_rate(F.col("p_name"), F.col("p_type")), 6).alias("cer"))


@query(r"""WITH w AS (SELECT p_partkey, regexp_split_to_array(p_name || ' ' || p_brand, '\s+') AS a, regexp_split_to_array(p_brand || ' ' || p_type, '\s+') AS b FROM part), k AS (SELECT *, list_distinct(a || b) AS d FROM w)
SELECT p_partkey, round(levenshtein(array_to_string(list_transform(a, lambda x: chr((33 + list_position(d, x))::INT)), ''), array_to_string(list_transform(b, lambda x: chr((33 + list_position(d, x))::INT)), '')) / len(a), 6) AS wer FROM k""")
def wer_pairs(spark, sf_dir):
    ref, hyp = F.concat_ws(" ", "p_name", "p_brand"), F.concat_ws(" ", "p_brand", "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(X.word_error_rate(ref, hyp), 6).alias("wer"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    engine = F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b")
    return labels.join(docs.select("doc_id", "lang", "n_chars"), "doc_id").select("doc_id", "lang", engine.alias("engine"), F.when(F.col("toxic") == 0, F.col("quality") * 50 + F.col("n_chars") % 50).alias("score"))


_SCORES = "s AS (SELECT l.doc_id, d.lang, CASE l.doc_id % 2 WHEN 0 THEN 'a' ELSE 'b' END AS engine, CASE WHEN l.toxic = 0 THEN l.quality * 50 + d.n_chars % 50 END AS score FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"


@query(f"WITH {_SCORES} SELECT lang, round(avg(score) FILTER (engine = 'a'), 6) AS a, round(avg(score) FILTER (engine = 'b'), 6) AS b FROM s GROUP BY lang")
def score_matrix(spark, sf_dir):
    out = C.score_matrix(_scores(spark, sf_dir), "lang", "engine", "score", ["a", "b"])
    return out.select("lang", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query(f"WITH {_SCORES}, m AS (SELECT lang, engine, avg(score) AS mean FROM s GROUP BY ALL) SELECT lang, arg_max(engine, mean) AS engine, round(max(mean), 6) AS mean FROM m GROUP BY lang")
def best_per_lang(spark, sf_dir):
    return C.best_per(_scores(spark, sf_dir), "lang", "engine", "score").select("lang", "engine", F.round("mean", 6).alias("mean"))


@query(f"WITH {_SCORES} SELECT lang, round(avg(score), 6) AS mean, count(score) AS n FROM s GROUP BY GROUPING SETS ((lang), ())")
def pair_means(spark, sf_dir):
    return C.pair_means(_scores(spark, sf_dir), "lang", "score").select("lang", F.round("mean", 6).alias("mean"), "n")


@query("""WITH b AS (SELECT o_custkey AS k, avg(o_totalprice) AS was FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY ALL), c AS (SELECT o_custkey AS k, avg(o_totalprice) AS now FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY ALL)
SELECT k, CASE WHEN now IS NULL THEN 'missing' ELSE 'regressed' END AS state FROM b LEFT JOIN c USING (k) WHERE now IS NULL OR was - now > 1000""")
def regression_check(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    old = F.col("o_orderdate") < F.expr("TIMESTAMP_NTZ '1997-01-01 00:00:00'")
    mean = lambda rows: rows.groupBy(F.col("o_custkey").alias("k")).agg(F.avg("o_totalprice").alias("score"))
    return C.regressions(mean(orders.where(old)), mean(orders.where(~old)), "k", "score", 1000.0).select("k", "state")


_CARD = "SELECT l_suppkey AS doc, count(*) FILTER (l_returnflag = 'R') AS formulas, count(*) FILTER (l_linenumber = 1) AS tables, sum(l_linenumber)::BIGINT AS table_cells, count(*) FILTER (l_tax > 0.05) AS flagged, min(l_discount) < 0.01 AS monotonic, avg(l_quantity) AS chrf FROM lineitem WHERE l_linestatus = '{}' GROUP BY l_suppkey"


@query(f"""WITH b AS ({_CARD.format('F')}), c AS ({_CARD.format('O')}), j AS (SELECT b.doc, unnest([CASE WHEN c.doc IS NULL THEN 'missing' END, CASE WHEN c.formulas < b.formulas THEN 'formulas' END, CASE WHEN c.tables < b.tables THEN 'tables' END, CASE WHEN c.table_cells < b.table_cells THEN 'table_cells' END,
  CASE WHEN c.flagged > b.flagged THEN 'flagged' END, CASE WHEN b.monotonic AND NOT c.monotonic THEN 'monotonic' END, CASE WHEN b.chrf - c.chrf > 1.0 THEN 'chrf' END]) AS worse FROM b LEFT JOIN c ON c.doc = b.doc) SELECT doc, worse FROM j WHERE worse IS NOT NULL""")
def scorecard_diff(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    card = lambda d: d.groupBy(F.col("l_suppkey").alias("doc")).agg(F.count_if(F.col("l_returnflag") == "R").alias("formulas"), F.count_if(F.col("l_linenumber") == 1).alias("tables"), F.sum("l_linenumber").alias("table_cells"), F.count_if(F.col("l_tax") > 0.05).alias("flagged"), (F.min("l_discount") < 0.01).alias("monotonic"), F.avg("l_quantity").alias("chrf"))
    return C.scorecard_diff(card(rows.where("l_linestatus = 'F'")), card(rows.where("l_linestatus = 'O'")))


@query("SELECT event_id, event_type, round(value - lag(value IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY event_id), 6) AS delta FROM events")
def history_delta(spark, sf_dir):
    out = C.history_delta(table(spark, sf_dir, "events"), ["event_type"], "event_id", "value")
    return out.select("event_id", "event_type", F.round("delta", 6).alias("delta"))


@query("""WITH f AS (SELECT event_id, user_id, event_type = 'error' AS failed, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
c AS (SELECT *, sum(failed::INT) OVER (PARTITION BY user_id, i ORDER BY event_id) AS n FROM f) SELECT event_id, user_id, n::BIGINT AS failures, n >= 2 AS tripped FROM c""")
def breaker_state(spark, sf_dir):
    return C.breaker(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "error").select("event_id", "user_id", "failures", "tripped")


@query("""WITH m AS (SELECT max(value) AS top FROM events), w AS (SELECT user_id, value / top AS conf FROM events, m)
SELECT user_id, round(avg(conf), 6) AS mean, round(avg((conf < 0.6)::INT), 6) AS weak, count(*) AS n, round(avg(conf) - 0.3 * avg((conf < 0.6)::INT), 6) AS quality FROM w GROUP BY user_id""")
def ocr_pass_quality(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    rows = rows.join(rows.agg(F.max("value").alias("top"))).withColumn("conf", F.col("value") / F.col("top"))
    return C.confidence(rows, "user_id", "conf").select("user_id", *(F.round(c, 6).alias(c) for c in ("mean", "weak", "quality")), "n")


@query("""SELECT user_id, string_agg(event_type, ' ' ORDER BY event_id, event_type) AS text, round(avg(value), 6) AS conf, min(event_id % 500)::BIGINT AS x0, max(event_id % 500 + 20)::BIGINT AS x1, min(event_id % 700)::BIGINT AS y0, max(event_id % 700 + 10)::BIGINT AS y1 FROM events GROUP BY user_id""")
def ocr_words_to_blocks(spark, sf_dir):
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").withColumns({"x0": e % 500, "x1": e % 500 + 20, "y0": e % 700, "y1": e % 700 + 10})
    return C.word_blocks(rows, ["user_id"], "event_id", "event_type", "value", ("x0", "y0", "x1", "y1")).withColumn("conf", F.round("conf", 6))


@query()
def ocr_escalation(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    rows = rows.join(rows.agg(F.max("value").alias("top"))).withColumn("q", F.col("value") / F.col("top"))
    return C.escalated(rows, "user_id", "event_id", "q").select("user_id", "event_id", F.round("q", 6).alias("q"))


@query("""WITH v AS (SELECT floor(255 * value / (SELECT max(value) FROM events))::INT AS t FROM events), b AS (SELECT r.t, count(v.t) AS n FROM range(256) r(t) LEFT JOIN v ON v.t = r.t GROUP BY r.t),
c AS (SELECT t, sum(n) OVER (ORDER BY t) AS w0, sum(t * n) OVER (ORDER BY t) AS s0, sum(n) OVER () AS w, sum(t * n) OVER () AS s FROM b),
d AS (SELECT t, w0::DOUBLE * (w - w0) * (s0 / w0 - (s - s0) / (w - w0)) * (s0 / w0 - (s - s0) / (w - w0)) AS v FROM c WHERE w0 > 0 AND w > w0) SELECT arg_max(t, (v, -t))::INT AS threshold FROM d""")
def otsu_threshold(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return C.otsu(rows.join(rows.agg(F.max("value").alias("top"))).select(F.floor(255 * F.col("value") / F.col("top")).alias("v")), "v")


@query("""WITH b AS (SELECT conv_id, turn, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) > length(text) AS back, role, text FROM conversations)
SELECT conv_id, count(*) AS blocks, count(*) FILTER (role = 'assistant') AS n_paragraph, count(*) FILTER (role = 'system') AS n_heading, count(*) FILTER (trim(text) <> '') AS translatable, NOT bool_or(coalesce(back, false)) AS monotonic FROM b GROUP BY conv_id""")
def structure_metrics(spark, sf_dir):
    kind = F.when(F.col("role") == "assistant", "paragraph").when(F.col("role") == "system", "heading").otherwise("other")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", kind.alias("type"), F.length("text").alias("reading_order"), F.lit(0).alias("cells"), F.array().cast("array<string>").alias("flags"))
    return C.structure(rows, "conv_id", "turn").select("conv_id", "blocks", "n_paragraph", "n_heading", "translatable", "monotonic")
