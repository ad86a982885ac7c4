"""Queries over text functions and segments, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrion.functions import text as T
from papyrion.operators import segments as S
from papyrion.plans.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS ord FROM documents"
_STRIP = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"
_KEY = rf"lower(regexp_replace({_STRIP}, '\s+', ' ', 'g'))"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(f"SELECT doc_id, ord, line FROM ({_LINES})")
def segment_lines(spark, sf_dir):
    return S.lines(_docs(spark, sf_dir))


@query(f"SELECT {_KEY.format('line')} AS key, count(*) AS n FROM ({_LINES}) GROUP BY ALL")
def norm_tm_key(spark, sf_dir):
    return S.lines(_docs(spark, sf_dir)).groupBy(T.memory_key(F.col("line")).alias("key")).agg(F.count("*").alias("n"))


@query(rf"SELECT trim(regexp_replace(lower(line), '[^\p{{L}}\p{{M}}_]+|_+', ' ', 'g')) AS key, count(*) AS n FROM ({_LINES}) GROUP BY ALL")
def norm_repetition_key(spark, sf_dir):
    return S.lines(_docs(spark, sf_dir)).groupBy(T.repetition_key(F.col("line")).alias("key")).agg(F.count("*").alias("n"))


@query(rf"SELECT regexp_replace({_KEY.format('line')}, '\p{{Nd}}+', '#', 'g') AS key, count(*) AS n FROM ({_LINES}) GROUP BY ALL")
def norm_furniture_key(spark, sf_dir):
    return S.lines(_docs(spark, sf_dir)).groupBy(T.furniture_key(F.col("line")).alias("key")).agg(F.count("*").alias("n"))


@query(f"SELECT replace({_KEY.format('line')}, 'ß', 'ss') AS key, count(*) AS n FROM ({_LINES}) GROUP BY ALL")
def norm_consistency_key(spark, sf_dir):
    rows = S.lines(_docs(spark, sf_dir))
    return rows.groupBy(T.consistency_key(F.col("line")).alias("key")).agg(F.count("*").alias("n"))


@query(r"""SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text),
  '(\p{L})[-' || chr(173) || ']' || chr(10) || '(\p{L})', '\1\2', 'g'), '(\p{L})[-' || chr(173) || '][ \t]+([a-z])', '\1\2', 'g'), '[' || chr(173) || chr(8203) || chr(65279) || ']', '', 'g'),
  'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ﬅ', 'st'), 'ﬆ', 'st') AS text FROM documents""")
def clean_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.cleaned(T.composed(F.col("text"))).alias("text"))


@query(f"""WITH l AS (SELECT doc_id, ord, {_KEY.format('line')} AS key, line FROM ({_LINES})),
d AS (SELECT key, min(line) AS text FROM l WHERE key <> '' GROUP BY key)
SELECT l.doc_id, l.ord, '[de] ' || d.text AS tgt FROM l LEFT JOIN d ON d.key = l.key""")
def dedupe_scatter(spark, sf_dir):
    rows = S.lines(_docs(spark, sf_dir))
    done = S.distinct_work(rows, "line").select("key", S.echo(F.col("text"), "de").alias("tgt"))
    return S.scattered(rows, done, "line").select("doc_id", "ord", "tgt")


@query(r"""SELECT doc_id, length(text) >= 20 AND (regexp_matches(text, '\(cid:\d+\)') OR
  length(regexp_replace(text, '[^\p{Cc}\p{Cf}\p{Co}\x{FFFD}]|[\t\n\r]', '', 'g')) > 0.1 * length(text)) AS garbage FROM documents""")
def garbage_score(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.garbage(F.col("text")).alias("garbage"))


@query(rf"""WITH l AS (SELECT doc_id, ord, {_STRIP.format('line')} AS s FROM ({_LINES})),
m AS (SELECT *, length(s) > 0 AND length(s) <= 200 AND regexp_matches(s, '[=<>≤≥≠≈∈∉⊂⊆∪∩∑∏∫√∂∇∞∼≅≡↦→⊕⊗±×÷·]') AND len(regexp_extract_all(s, '[A-Za-z]{{4,}}')) <= 6
  AND len(list_filter(regexp_extract_all(s, '\p{{L}}+'), lambda x: length(x) = 1)) >= 3 AS formula FROM l)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (formula) AS n_formula FROM m GROUP BY doc_id""")
def formula_lines(spark, sf_dir):
    rows = S.lines(_docs(spark, sf_dir))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(T.formula_line(F.col("line"))).alias("n_formula"))


@query(rf"""WITH l AS (SELECT doc_id, list_filter(regexp_split_to_array(line, '\s+'), lambda t: t <> '') AS t FROM ({_LINES})),
m AS (SELECT doc_id, len(t) AS n, len(list_filter(t, lambda x: regexp_matches(x, '^[-+(]?[$€£]?[0-9][0-9.,]*[%)]?$'))) AS k FROM l)
SELECT doc_id, count(*) FILTER (n >= 8 AND k >= 6 AND k > 0.35 * n) AS n_tabular, sum(k)::BIGINT AS n_numeric FROM m GROUP BY doc_id""")
def tabular_lines(spark, sf_dir):
    rows = S.lines(_docs(spark, sf_dir))
    numeric = F.size(F.filter(F.split("line", r"\s+"), lambda t: t.rlike(r"^[-+(]?[$€£]?[0-9][0-9.,]*[%)]?$")))
    return rows.groupBy("doc_id").agg(F.count_if(T.tabular_line(F.col("line"))).alias("n_tabular"), F.sum(numeric).cast("long").alias("n_numeric"))


@query(r"""WITH p AS (SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 'Page ' || c_custkey WHEN 1 THEN c_custkey || ' of 900' WHEN 2 THEN 'xiv' WHEN 3 THEN 'Xiv' WHEN 4 THEN c_name ELSE c_custkey || '.' END AS s FROM customer)
SELECT id, length(s) <= 12 AND (regexp_matches(s, '(?i)^(page\s+)?\p{Nd}+(\s*[/of-]+\s*\p{Nd}+)?\.?$') OR regexp_matches(s, '^m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$')
  OR regexp_matches(s, '^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$')) AS page_number FROM p""")
def page_number_lines(spark, sf_dir):
    k = F.col("c_custkey")
    s = F.when(k % 6 == 0, F.concat(F.lit("Page "), k)).when(k % 6 == 1, F.concat(k, F.lit(" of 900"))).when(k % 6 == 2, "xiv").when(k % 6 == 3, "Xiv").when(k % 6 == 4, F.col("c_name")).otherwise(F.concat(k, F.lit(".")))
    return table(spark, sf_dir, "customer").select(k.alias("id"), T.page_number(s).alias("page_number"))


@query(r"""WITH r AS (SELECT doc_id, lang, length(regexp_replace(text, '[^\p{Hebrew}\p{Arabic}\p{Syriac}\p{Thaana}\p{Nko}]', '', 'g')) AS n_right, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS n_letters FROM documents)
SELECT doc_id, round(CASE WHEN n_letters > 0 THEN n_right / n_letters ELSE 0 END, 6) AS rtl_ratio, CASE WHEN n_letters > 0 AND n_right >= 0.4 * n_letters THEN 'rtl' ELSE 'ltr' END AS direction FROM r""")
def rtl_profile(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(T.rtl_ratio(F.col("text")), 6).alias("rtl_ratio"), T.direction(F.col("text"), F.col("lang")).alias("direction"))


@query("SELECT lang, " + ", ".join(rf"sum(length(regexp_replace(text, '[^\p{{{s}}}]', '', 'g')))::BIGINT AS n_{s.lower()}" for s in T.SCRIPTS) + " FROM documents GROUP BY lang")
def script_profile(spark, sf_dir):
    counts = T.script_counts(F.col("text"))
    return _docs(spark, sf_dir).groupBy("lang").agg(*(F.sum(c).cast("long").alias(f"n_{s.lower()}") for s, c in counts.items()))


_TURN_PAIRS = """SELECT a.conv_id, a.turn, a.text AS src, b.text AS tgt FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1"""


def turn_pairs(spark: SparkSession, sf_dir: str, lang: str = "de") -> DataFrame:
    """Neighbouring turns as source and translation."""
    turns = table(spark, sf_dir, "conversations")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("tgt"))
    return turns.select("conv_id", "turn", F.col("text").alias("src")).join(after, ["conv_id", "turn"]).withColumn("lang", F.lit(lang))


_D = r"regexp_replace({}, '[^\p{{Nd}}]', '', 'g')"
_CHECKED = rf"""WITH p AS ({_TURN_PAIRS}), e AS (SELECT *, regexp_extract_all(src, '[0-9][0-9.,]*[0-9]|[0-9]') AS a, list_transform(regexp_extract_all(tgt, '[0-9][0-9.,]*[0-9]|[0-9]'), lambda x: {_D.format('x')}) AS b,
  regexp_extract_all(src, 'https?://[^\s<>"]+|www\.[^\s<>"]+') AS ua, regexp_extract_all(tgt, 'https?://[^\s<>"]+|www\.[^\s<>"]+') AS ub,
  regexp_extract_all(src, '[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{{2,}}') AS ea, regexp_extract_all(tgt, '[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{{2,}}') AS eb FROM p),
f AS (SELECT conv_id, turn, src, tgt, list_filter(a, lambda x: NOT list_contains(b, {_D.format('x')})) || list_filter(ua, lambda x: NOT list_contains(ub, x)) || list_filter(ea, lambda x: NOT list_contains(eb, x)) AS missing FROM e),
c AS (SELECT conv_id, turn, missing, {_STRIP.format('src')} <> '' AND {_STRIP.format('tgt')} <> '' AS filled, {_STRIP.format('tgt')} = '' AND {_STRIP.format('src')} <> '' AS empty,
  len(missing) > 0 AS entity, {_STRIP.format('src')} = {_STRIP.format('tgt')} AND len(regexp_extract_all(src, '\p{{L}}{{4,}}')) >= 3 AS same,
  length(src) >= 25 AND NOT length(tgt) / greatest(length(src), 1) BETWEEN 0.7 AND 2.2 AS band FROM f)"""


@query(_CHECKED + " SELECT conv_id, turn, array_to_string(missing, ', ') AS missing FROM c")
def entity_loss_qa(spark, sf_dir):
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", F.array_join(T.missing_entities(F.col("src"), F.col("tgt")), ", ").alias("missing"))


@query(_CHECKED + " SELECT conv_id, turn, band AS outside FROM c")
def length_band_qa(spark, sf_dir):
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", T.outside_band(F.col("src"), F.col("tgt"), F.col("lang")).alias("outside"))


@query(_CHECKED + " SELECT conv_id, turn, same AS untranslated FROM c")
def untranslated_qa(spark, sf_dir):
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", T.untranslated(F.col("src"), F.col("tgt")).alias("untranslated"))


_FOUND = _CHECKED + """, x AS (SELECT conv_id, turn, unnest([CASE WHEN empty THEN 'empty' END, CASE WHEN filled AND entity THEN 'entity' END, CASE WHEN filled AND same THEN 'untranslated' END, CASE WHEN filled AND band THEN 'length' END]) AS chk FROM c),
y AS (SELECT * FROM x WHERE chk IS NOT NULL)"""


@query(_FOUND + ' SELECT chk AS "check", count(*) AS n, count(*) FILTER (chk <> \'length\') AS n_hard FROM y GROUP BY chk')
def qa_summary(spark, sf_dir):
    return S.summary(S.findings(turn_pairs(spark, sf_dir)))


@query(_FOUND + """ SELECT c.conv_id, count(DISTINCT c.turn) AS n_segments, count(DISTINCT c.turn) FILTER (y.chk IS NOT NULL AND y.chk <> 'length') AS n_hard_segments,
  2 * count(DISTINCT c.turn) FILTER (y.chk IS NOT NULL AND y.chk <> 'length') >= count(DISTINCT c.turn) AS poor FROM c LEFT JOIN y ON y.conv_id = c.conv_id AND y.turn = c.turn GROUP BY c.conv_id""")
def quality_banner(spark, sf_dir):
    return S.banner(S.findings(turn_pairs(spark, sf_dir)), "conv_id")


@query(_FOUND + """ SELECT c.conv_id, bool_or(y.chk IS NOT NULL) AS needs_escalation, count(y.chk) AS n_findings FROM c LEFT JOIN y ON y.conv_id = c.conv_id AND y.turn = c.turn GROUP BY c.conv_id""")
def needs_escalation(spark, sf_dir):
    return S.needs_escalation(S.findings(turn_pairs(spark, sf_dir)), "conv_id")


_TERMS = "SELECT n_name AS term, lower(n_name) AS rendering FROM nation UNION SELECT unnest(['tion', 'the ', 'and']), unnest(['tion', 'die ', 'und'])"


@query(f"WITH t AS ({_TERMS}) SELECT d.doc_id, t.term, contains(d.text, t.rendering) AS applied FROM documents d JOIN t ON contains(d.text, t.term)")
def glossary_adherence(spark, sf_dir):
    named = table(spark, sf_dir, "nation").select(F.col("n_name").alias("term"), F.lower("n_name").alias("rendering"))
    terms = named.union(spark.createDataFrame([("tion", "tion"), ("the ", "die "), ("and", "und")], "term string, rendering string")).distinct()
    return S.adherence(_docs(spark, sf_dir).select("doc_id", "text"), terms).select("doc_id", "term", "applied")


_PSEUDO = "CASE WHEN (doc_id + ord) % 3 = 0 THEN upper(replace(line, 'ß', 'SS')) ELSE line END"


@query(f"""WITH l AS (SELECT doc_id * 1000000 + ord AS ord, replace({_KEY.format('line')}, 'ß', 'ss') AS key, {_PSEUDO} AS tgt FROM ({_LINES})),
v AS (SELECT key, tgt, count(*) AS n, min(ord) AS o FROM l GROUP BY ALL)
SELECT key, arg_max(tgt, (n, -o)) AS target, count(*) AS n_variants, sum(n)::BIGINT AS n FROM v GROUP BY key""")
def consistency_majority(spark, sf_dir):
    rows = S.lines(_docs(spark, sf_dir))
    rows = rows.withColumn("tgt", F.when((F.col("doc_id") + F.col("ord")) % 3 == 0, F.upper("line")).otherwise(F.col("line"))).withColumn("at", F.col("doc_id") * 1000000 + F.col("ord"))
    return S.majority(rows, T.consistency_key(F.col("line")), "tgt", "at")


@query(rf"""WITH d AS (SELECT text FROM documents WHERE lang = 'en'), u AS (
SELECT unnest(regexp_extract_all(text, '\b[A-Z][A-Z0-9]{{2,}}\b')) AS term, 'acronym' AS kind FROM d UNION ALL SELECT unnest(regexp_extract_all(text, '\b[A-Z][a-z]{{2,}}\b')), 'name' FROM d),
n AS (SELECT unnest(regexp_split_to_array(name, '\s+')) AS term FROM (SELECT unnest(regexp_extract_all(text, '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b')) AS name FROM d)), low AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\b[a-z]{{2,}}\b')) AS term FROM d)
SELECT term, kind, count(*) AS n FROM u WHERE kind = 'acronym' OR (term NOT IN (SELECT term FROM n) AND lower(term) NOT IN (SELECT term FROM low)) GROUP BY ALL HAVING count(*) >= 2""")
def auto_glossary(spark, sf_dir):
    return S.mined_terms(_docs(spark, sf_dir).where("lang = 'en'"))


@query("""SELECT conv_id, turn, coalesce(string_agg(text, chr(10)) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS before,
  coalesce(string_agg(text, chr(10)) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '') AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def sliding_context(spark, sf_dir):
    return S.sliding_context(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "before", "after")


@query("""SELECT conv_id, turn, substr(sha1(coalesce(lag(text) OVER w, '') || chr(31) || coalesce(lead(text) OVER w, '')), 1, 16) AS ctx FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def context_hash(spark, sf_dir):
    return S.context_hash(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "ctx")


@query(r"""SELECT id, CASE WHEN substr(s, 1, 1) IN ('=', '+', '-', '@') THEN '''' || s ELSE s END AS safe FROM (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN '=' || c_name WHEN 1 THEN '-' || c_custkey ELSE c_name END AS s FROM customer)""")
def csv_safe(spark, sf_dir):
    k = F.col("c_custkey")
    s = F.when(k % 3 == 0, F.concat(F.lit("="), "c_name")).when(k % 3 == 1, F.concat(F.lit("-"), k)).otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select(k.alias("id"), T.spreadsheet_safe(s).alias("safe"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, 'costs ' || printf('%.2f', l_extendedprice) || ' or ' || format('{:,}', (l_extendedprice)::BIGINT) || '.50' AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, 'costs ' || replace(split_part(substr(s, 7), ' or ', 1), '.', ',') || ' or ' || CASE WHEN contains(split_part(s, ' or ', 2), ',') THEN translate(split_part(s, ' or ', 2), ',.', '.,') ELSE replace(split_part(s, ' or ', 2), '.', ',') END AS text FROM l""")
def localize_numbers(spark, sf_dir):
    price = F.col("l_extendedprice")
    s = F.concat(F.lit("costs "), F.format_string("%.2f", price), F.lit(" or "), F.format_number(F.rint(price), 0), F.lit(".50"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.localized_numbers(s, F.lit("de")).alias("text"))


@query(rf"""WITH l AS (SELECT doc_id, ord, {_KEY.format('line')} AS key, line FROM ({_LINES}) WHERE {_STRIP.format('line')} <> ''),
f AS (SELECT doc_id, length(line) >= 25 AND NOT (length(line) + 5) / length(line) BETWEEN 0.7 AND 2.2 AS band FROM l)
SELECT doc_id, bool_or(band) AS needs_escalation, count(*) FILTER (band) AS n_findings FROM f GROUP BY doc_id""")
def document_scorecard(spark, sf_dir):
    """Lines, deduplicated, translated by the echo engine, scattered, checked, and summed by document."""
    rows = S.lines(_docs(spark, sf_dir)).where(T.strip(F.col("line")) != "")
    key = T.collapsed(F.col("line"))
    done = S.distinct_work(rows, "line", key).select("key", S.echo(F.col("text"), "de").alias("tgt"))
    pairs = S.scattered(rows, done, "line", key).select("doc_id", F.col("line").alias("src"), "tgt", F.lit("de").alias("lang"))
    return S.needs_escalation(S.findings(pairs), "doc_id")
