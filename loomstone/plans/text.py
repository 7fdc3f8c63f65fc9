"""Queries over text: measures, normal forms, fingerprints, language, keywords, links."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import enrich as E
from ..operators import fingerprints as P
from ..operators import planning as N
from ..operators.graph import spread
from .base import query

NORM_SQL = r"trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+', ' ', 'g'))"
WORDS_SQL = f"list_filter(string_split({NORM_SQL}, ' '), lambda x: x <> '')"


@query("est_tokens", r"SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE greatest(1, floor(greatest(length(text) / 3.6::DOUBLE, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) * 1.15::DOUBLE)))::BIGINT END AS tokens FROM documents")
def est_tokens(t):
    return t.documents.select("doc_id", T.estimate_tokens("text").alias("tokens"))


@query("text_norm", f"SELECT doc_id, md5({NORM_SQL}) AS norm_md5 FROM documents")
def text_norm(t):
    return t.documents.select("doc_id", F.md5(T.normal("text")).alias("norm_md5"))


@query("exact_hash", f"SELECT sha256({NORM_SQL}) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1")
def exact_hash(t):
    return t.documents.groupBy(T.exact_hash("text").alias("digest")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"))


_SHINGLES_SQL = f"w AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents), s AS (SELECT doc_id, CASE WHEN len(w) <= 4 THEN w ELSE list_transform(range(1, len(w) - 2), lambda k: array_to_string(list_slice(w, k, k + 3), ' ')) END AS s FROM w)"


@query("shingles", f"WITH {_SHINGLES_SQL} SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS digest FROM s")
def shingles(t):
    s = T.shingles("text")
    return t.documents.select("doc_id", F.size(s).cast("long").alias("n"), F.md5(F.array_join(s, "|")).alias("digest"))


_BITS_SQL = " + ".join(f"CASE WHEN sum(((h >> {k}) & 1) * 2 - 1) > 0 THEN {1 << k}::BIGINT ELSE 0 END" for k in range(60))
_SIM_SQL = f"{_SHINGLES_SQL}, e AS (SELECT doc_id, ('0x' || substr(md5(x), 1, 15))::BIGINT AS h FROM (SELECT doc_id, unnest(s) AS x FROM s)), f AS (SELECT doc_id AS id, {_BITS_SQL} AS simhash FROM e GROUP BY doc_id)"


@query("simhash", f"WITH {_SIM_SQL} SELECT id, simhash FROM f")
def simhash(t):
    return P.simhash(t.documents, "doc_id", "text")


@query("simhash_hex", f"WITH {_SIM_SQL} SELECT id, lpad(lower(to_hex(simhash)), 16, '0') AS simhash_hex FROM f")
def simhash_hex(t):
    return P.simhash(t.documents, "doc_id", "text").select("id", T.hex16(F.col("simhash")).alias("simhash_hex"))


@query("dedupe_bands", f"WITH {_SIM_SQL}, o AS (SELECT simhash, min(id) AS id FROM f GROUP BY simhash) SELECT a.id AS a, b.id AS b, bit_count(xor(a.simhash, b.simhash))::BIGINT AS distance FROM o a JOIN o b ON a.id < b.id AND bit_count(xor(a.simhash, b.simhash)) <= 3")
def dedupe_bands(t):
    return P.near_pairs(P.simhash(t.documents, "doc_id", "text"))


@query("dedupe_members", f"WITH {_SIM_SQL} SELECT id, min(id) OVER (PARTITION BY simhash) AS representative FROM f")
def dedupe_members(t):
    """Beside ``dedupe_bands``: which document stands for each there."""
    return P.members(P.simhash(t.documents, "doc_id", "text"))


@query("hamming", "SELECT event_id, bit_count(xor(event_id * 2654435761, user_id * 40503))::BIGINT AS distance FROM events")
def hamming(t):
    return t.events.select("event_id", T.hamming(F.col("event_id") * 2654435761, F.col("user_id") * 40503).cast("long").alias("distance"))


@query("near_dup", "SELECT event_id, bit_count(xor(event_id, user_id)) <= 3 AS near FROM events")
def near_dup(t):
    return t.events.select("event_id", (T.hamming("event_id", "user_id") <= 3).alias("near"))


@query("corpus_probe", f"WITH h AS (SELECT doc_id, source, sha256({NORM_SQL}) AS digest FROM documents) SELECT digest, min(doc_id) AS owner FROM h WHERE source = 'src0' AND digest IN (SELECT digest FROM h WHERE source = 'src1') GROUP BY digest")
def corpus_probe(t):
    h = t.documents.select("doc_id", "source", T.exact_hash("text").alias("digest"))
    return h.where("source = 'src0'").join(h.where("source = 'src1'").select("digest"), "digest", "left_semi").groupBy("digest").agg(F.min("doc_id").alias("owner"))


@query("doc_id", "SELECT p_partkey, substr(sha256(p_brand || chr(0) || p_name), 1, 32) AS document_id FROM part")
def doc_id(t):
    return t.part.select("p_partkey", T.document_id(F.col("p_brand"), F.col("p_name")).alias("document_id"))


@query("media_type", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'text/markdown' WHEN 1 THEN 'text/csv' WHEN 2 THEN 'application/octet-stream' ELSE 'application/pdf' END AS media_type FROM pages")
def media_type(t):
    name = F.concat(F.lit("dir.x/file."), F.element_at(F.array(*map(F.lit, ("md", "CSV", "zzz", "Pdf"))), (F.col("page_id") % 4 + 1).cast("int")))
    return t.pages.select("page_id", T.media_type(name).alias("media_type"))


@query("size_limit", "SELECT page_id, strlen(html) <= 20000 AS within FROM pages")
def size_limit(t):
    return t.pages.select("page_id", (F.octet_length("html") <= 20000).alias("within"))


@query("parse_text", r"SELECT doc_id, pos - 1 AS pos, md5(p) AS digest FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS pos FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: trim(x, ' ')), lambda x: x <> '') AS ps FROM documents))")
def parse_text(t):
    return t.documents.select("doc_id", F.posexplode(T.paragraphs("text")).alias("pos", "p")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("p").alias("digest"))


@query("block_norm", r"SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(replace(text, chr(160), ' '), chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r\f]+', ' ', 'g'), ' ')), lambda x: x <> ''), chr(10))) AS digest FROM documents")
def block_norm(t):
    return t.documents.select("doc_id", F.md5(T.block_normal("text")).alias("digest"))


@query("html_strip", r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM pages")
def html_strip(t):
    return t.pages.select("page_id", F.md5(T.strip_tags("html")).alias("digest"))


@query("html_links", """SELECT page_id, url, min(pos) AS pos FROM (SELECT page_id, unnest(l) AS url, generate_subscripts(l, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"#]+)', 1) AS l FROM pages)) GROUP BY page_id, url""")
def html_links(t):
    links = t.pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"#]+)'), F.lit(1))).alias("pos", "url"))
    return links.groupBy("page_id", "url").agg((F.min("pos") + 1).cast("long").alias("pos"))


@query("ctx_header", "SELECT p_partkey, CASE WHEN p_brand = p_type THEN p_brand ELSE p_brand || ' > ' || p_type END || chr(10) || p_name AS header FROM part")
def ctx_header(t):
    crumbs = F.array_join(F.array_distinct(F.filter(F.array("p_brand", "p_type", "p_brand"), lambda x: x != "")), " > ")
    return t.part.select("p_partkey", F.concat_ws("\n", crumbs, "p_name").alias("header"))


@query("embed_text", "SELECT doc_id, md5(source || ' > ' || lang || chr(10) || chr(10) || text) AS digest FROM documents")
def embed_text(t):
    return t.documents.select("doc_id", F.md5(F.concat_ws("\n\n", F.concat_ws(" > ", "source", "lang"), "text")).alias("digest"))


@query("embed_trunc", "SELECT doc_id, md5(substr(text, 1, 2000)) AS digest FROM documents")
def embed_trunc(t):
    """Clipping is the feature: an embedder takes so many characters."""
    return t.documents.select("doc_id", F.md5(F.substring("text", 1, 2000)).alias("digest"))


@query("query_norm", r"SELECT conv_id, turn, md5(regexp_replace(regexp_replace(trim(lower(text), ' '), '\s+', ' ', 'g'), '[?!. ]+$', '')) AS digest FROM conversations")
def query_norm(t):
    return t.conversations.select("conv_id", "turn", F.md5(T.query_normal("text")).alias("digest"))


_ABSTRACT_SQL = r"""SELECT conv_id, turn, len(regexp_split_to_array(trim(text, ' '), '\s+')) <= 12 OR NOT (regexp_matches(text, '[0-9]') OR regexp_matches(text, '(^|[^\p{L}\p{N}_])[A-Z]{2,}($|[^\p{L}\p{N}_])')
  OR regexp_matches(text, '["''`]') OR regexp_matches(text, '[A-Za-z]\.[A-Za-z]')) AS abstract FROM conversations"""


@query("qt_abstract", _ABSTRACT_SQL)
def qt_abstract(t):
    return t.conversations.select("conv_id", "turn", T.is_abstract("text").alias("abstract"))


@query("qt_queries", "SELECT conv_id, q, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM (SELECT conv_id, turn, text AS q, row_number() OVER (PARTITION BY conv_id, lower(text) ORDER BY turn) AS rn FROM conversations WHERE role = 'user') WHERE rn = 1")
def qt_queries(t):
    user = t.conversations.where("role = 'user'").withColumn("rn", F.row_number().over(Window.partitionBy("conv_id", F.lower("text")).orderBy("turn"))).where("rn = 1")
    return user.select("conv_id", F.col("text").alias("q"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long").alias("place"))


@query("qt_fallback", "SELECT conv_id, turn, trim(text, ' ') AS q, true AS degraded, trim(text, ' ') <> '' AS retrieve FROM conversations WHERE role = 'user'")
def qt_fallback(t):
    return t.conversations.where("role = 'user'").select("conv_id", "turn", F.trim("text").alias("q"), F.lit(True).alias("degraded"), (F.trim("text") != "").alias("retrieve"))


@query("qt_facets", "SELECT p_partkey, array_to_string([lower(p_brand), 'x'], ',') AS facets FROM part")
def qt_facets(t):
    raw = F.array(F.concat(F.lit(" "), "p_brand"), F.upper("p_brand"), F.lit("X "), F.lit("unknown"), F.lit(" "))
    clean = F.filter(F.array_distinct(F.transform(raw, lambda x: F.lower(F.trim(x)))), lambda x: (x != "") & (x != "unknown"))
    return t.part.select("p_partkey", F.array_join(clean, ",").alias("facets"))


@query("qt_date", "SELECT o_orderkey, epoch(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH)::BIGINT AS month_end, epoch(make_timestamp(year(o_orderdate)::BIGINT, 1, 1, 0, 0, 0.0))::BIGINT AS year_start FROM orders")
def qt_date(t):
    """Month and year expressions: a month ends at the first instant of the next one."""
    month, year = F.date_format("o_orderdate", "yyyy-MM"), F.date_format("o_orderdate", "yyyy")
    end = F.coalesce(F.try_to_timestamp(month, F.lit("yyyy-MM-dd")), F.add_months(F.to_date(month, "yyyy-MM"), 1).cast("timestamp"))
    return t.orders.select("o_orderkey", F.unix_timestamp(end).alias("month_end"), F.unix_timestamp(F.to_timestamp(year, "yyyy")).alias("year_start"))


def _language_sql(least: int) -> str:
    votes = {lang: f"len(list_filter(w, lambda x: x IN ({', '.join(repr(m) for m in own.split())})))" for lang, own in T.MARKERS.items()}
    columns = ", ".join(f"{v} AS v_{k}" for k, v in votes.items())
    most = f"greatest({', '.join('v_' + k for k in votes)})"
    cases = " ".join(f"WHEN v_{k} = {most} THEN '{k}'" for k in votes)
    scripts = " ".join(f"WHEN len(regexp_extract_all(t, '[{span}]')) >= greatest({least}, floor(length(t) / 50.0)) THEN '{lang}'" for lang, span in T.SCRIPT_LANGUAGES)
    return rf"WITH b AS (SELECT doc_id, substr(text, 1, 4000) AS t FROM documents), c AS (SELECT doc_id, t, regexp_extract_all(lower(t), '[\p{{L}}\p{{M}}]+') AS w FROM b), v AS (SELECT doc_id, t, {columns} FROM c) SELECT doc_id, CASE WHEN trim(t) = '' THEN 'en' {scripts} WHEN {most} = 0 THEN 'en' {cases} END AS lang FROM v"


@query("lang_doc", _language_sql(8))
def lang_doc(t):
    """The rule reads the first 4000 characters: that limit is the operator's own."""
    return spread(t.documents.select("doc_id", "text")).select("doc_id", T.language("text").alias("lang"))


@query("lang_turn", _language_sql(6).replace("doc_id", "conv_id, turn").replace("documents", "conversations"))
def lang_turn(t):
    return t.conversations.select("conv_id", "turn", T.language("text", least=6).alias("lang"))


_KEY_SQL = r"""WITH e AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}]{3,}') AS w FROM documents)),
g AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first FROM e WHERE word NOT IN (%s) GROUP BY doc_id, word)
SELECT doc_id, word, n, rn AS place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rn FROM g) WHERE rn <= 10""" % ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query("insights_heur", _KEY_SQL)
def insights_heur(t):
    """The ten most frequent words of each document, ties by first place."""
    return E.keyword_counts(t.documents).select(F.col("id").alias("doc_id"), "word", "n", F.col("place").cast("long").alias("place"))


@query("keywords_clean", "SELECT p_partkey, array_to_string(list_distinct_keep, ',') AS keywords FROM (SELECT p_partkey, [lower(p_brand)] AS list_distinct_keep FROM part)")
def keywords_clean(t):
    raw = F.array(F.concat(F.lit(" "), "p_brand", F.lit(".")), F.lower("p_brand"), F.lit(" ,; "))
    return t.part.select("p_partkey", F.array_join(E.clean_keywords(raw), ",").alias("keywords"))


@query("insights_cache", f"SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256({NORM_SQL})) AS computed_for FROM documents")
def insights_cache(t):
    """Work is done once for each content hash and joined back to its copies."""
    d = t.documents.select("doc_id", T.exact_hash("text").alias("digest"))
    return d.join(d.groupBy("digest").agg(F.min("doc_id").alias("computed_for")), "digest").select("doc_id", "computed_for")


@query("invisible_count", r"SELECT doc_id, len(regexp_extract_all(text, '[\x{AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{FEFF}\x{E0000}-\x{E007F}]')) + len(regexp_extract_all(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]')) AS n FROM documents")
def invisible_count(t):
    return t.documents.select("doc_id", T.invisible_count("text").alias("n"))


_PII_SQL = r"SELECT doc_id, len(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')) AS emails, len(regexp_extract_all(text, '\b\d{3}[.-]\d{3}[.-]\d{4}\b')) AS phones, len(regexp_extract_all(text, '\b(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\b')) AS addresses FROM documents"


@query("pii_baseline", _PII_SQL)
def pii_baseline(t):
    from ..operators.pii import RECOGNISERS

    own = {r.name: r.pattern for r in RECOGNISERS}
    count = lambda name: F.regexp_count("text", F.lit(own[name])).cast("long")
    return t.documents.select("doc_id", count("email").alias("emails"), count("phone_national").alias("phones"), count("ipv4").alias("addresses"))


_LUHN_SQL = "SELECT o_orderkey, list_sum(list_transform(range(1, length(d) + 1), lambda k: CASE WHEN k % 2 = 1 THEN d[length(d) - k + 1]::INT WHEN d[length(d) - k + 1]::INT > 4 THEN d[length(d) - k + 1]::INT * 2 - 9 ELSE d[length(d) - k + 1]::INT * 2 END)) % 10 = 0 AS ok FROM (SELECT o_orderkey, (4000000000000 + o_orderkey * 7919)::VARCHAR AS d FROM orders)"


@query("luhn", _LUHN_SQL)
def luhn(t):
    return t.orders.select("o_orderkey", F.expr("luhn_check(cast(4000000000000 + o_orderkey * 7919 as string))").alias("ok"))


_PLAN_VOCABULARY = N.Vocabulary(("faq", "handbook", "policy"), ("blob", "web"))
_PLAN_SQL = """WITH j AS (SELECT doc_id, 'Question ' || doc_id AS message, substr(text, 1, 30) AS head, CASE WHEN doc_id % 7 = 0 THEN '{"rewritten": ' || doc_id ELSE json_object('rewritten', CASE WHEN doc_id % 5 = 0 THEN '  ' ELSE ' ' || substr(text, 1, 30) END, 'sub_questions', json_array('Ask ' || lang, 'ask ' || upper(lang), NULL, doc_id, json_array(1), 'last', 'over'),
  'filter_doc_types', json_array('FAQ', source, ' policy '), 'filter_date_from', CASE doc_id % 4 WHEN 0 THEN '2024' WHEN 1 THEN '2024-05' WHEN 2 THEN '2024-05-06' ELSE 'soon' END, 'filter_date_to', CASE WHEN doc_id % 3 = 0 THEN '2023' ELSE '2024-12' END, 'confidence', doc_id % 40 / 10.0 - 1, 'needs_tools', doc_id % 2 = 0) END AS payload FROM documents),
f AS (SELECT *, doc_id % 7 = 0 AS degraded, CASE WHEN doc_id % 7 = 0 OR doc_id % 5 = 0 OR regexp_full_match(head, '[ \\t\\n\\x0B\\f\\r]*') THEN message ELSE regexp_replace(head, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g') END AS rewritten FROM j)
SELECT doc_id, degraded, md5(rewritten) AS rewritten, CASE WHEN degraded THEN '' ELSE array_to_string([x for x in ['Ask ' || lang, doc_id::VARCHAR, 'last', 'over'] if lower(x) <> lower(rewritten)][1:3], '|') END AS questions, CASE WHEN degraded THEN '' ELSE 'faq,policy' END AS doc_types,
  CASE WHEN NOT degraded AND (doc_id % 3 <> 0 OR doc_id % 4 = 3) THEN CASE doc_id % 4 WHEN 0 THEN 1704067200 WHEN 1 THEN 1714521600 WHEN 2 THEN 1714953600 END END::BIGINT AS date_from, CASE WHEN NOT degraded THEN CASE WHEN doc_id % 3 <> 0 THEN 1735689600 WHEN doc_id % 4 = 3 THEN 1704067199 END END::BIGINT AS date_to,
  round(CASE WHEN degraded THEN 0.0 ELSE least(1.0, greatest(0.0, (doc_id % 40)::DOUBLE / 10.0 - 1)) END, 6)::DOUBLE AS confidence, NOT degraded AND doc_id % 2 = 0 AS needs_tools FROM f JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)"""


@query("qt_plan", _PLAN_SQL)
def qt_plan(t):
    """Answers as a model may give them, some cut short, some with fields of the wrong type, read as plans."""
    i, words = F.col("doc_id"), F.substring("text", 1, 30)
    asked = F.concat(F.lit('["Ask '), "lang", F.lit('", "ask '), F.upper("lang"), F.lit('", null, '), i.cast("string"), F.lit(', [1], "last", "over"]'))
    day = F.when(i % 4 == 0, "2024").when(i % 4 == 1, "2024-05").when(i % 4 == 2, "2024-05-06").otherwise("soon")
    said = F.to_json(F.struct(F.when(i % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), words)).alias("rewritten")))
    whole = F.concat(F.rtrim(said, F.lit("}")), F.lit(', "sub_questions": '), asked, F.lit(', "filter_doc_types": ["FAQ", "'), "source", F.lit('", " policy "], "filter_date_from": "'), day, F.lit('", "filter_date_to": "'), F.when(i % 3 == 0, "2023").otherwise("2024-12"), F.lit('", "confidence": '), (i % 40 / 10.0 - 1).cast("string"), F.lit(', "needs_tools": '), (i % 2 == 0).cast("string"), F.lit("}"))
    answers = t.documents.select(i, F.concat(F.lit("Question "), i.cast("string")).alias("message"), F.when(i % 7 == 0, F.concat(F.lit('{"rewritten": '), i.cast("string"))).otherwise(whole).alias("payload"))
    p = N.plan(answers, vocabulary=_PLAN_VOCABULARY, keep=("doc_id",))
    return p.select("doc_id", "degraded", F.md5("rewritten").alias("rewritten"), F.array_join("sub_questions", "|").alias("questions"), F.array_join("doc_types", ",").alias("doc_types"), F.unix_timestamp("date_from").alias("date_from"), F.unix_timestamp("date_to").alias("date_to"), F.round("confidence", 6).alias("confidence"), "needs_tools")


@query("qt_transform", "SELECT conv_id, turn, md5(regexp_replace(text, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')) AS rewritten, true AS degraded, NOT regexp_full_match(text, '[ \\t\\n\\x0B\\f\\r]*') AS needs_retrieval, 0 AS sub_questions FROM conversations WHERE role = 'user'")
def qt_transform(t):
    """Users' messages as plans where there is no model to ask: each stands for itself."""
    m = t.conversations.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("message"))
    p = N.transform(m, keep=("conv_id", "turn"))
    return p.select("conv_id", "turn", F.md5("rewritten").alias("rewritten"), "degraded", "needs_retrieval", F.size("sub_questions").alias("sub_questions"))
