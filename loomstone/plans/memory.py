"""Queries of sessions, memories and the cache.

Turns are those of conversations: turn 0 is pinned, turns with turn % 4 = 1 are
suppressed.  Memories and cache entries are vectors: ``user`` is vec_id % 40.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens
from ..operators import consolidate as C
from ..operators import memory as M
from .base import NOW, query

TURNS_SQL = r"turns AS (SELECT conv_id, turn, role, text, turn = 0 AS pinned, turn % 4 = 1 AS suppressed, CASE WHEN text = '' THEN 0 ELSE greatest(1, floor(greatest(length(text) / 3.6::DOUBLE, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) * 1.15::DOUBLE)))::BIGINT END AS tokens FROM conversations)"
MEM_SQL = f"""mem AS (SELECT vec_id AS id, vec_id % 40 AS usr, ['fact', 'preference', 'task'][1 + (vec_id % 3)::INT] AS kind, embedding AS vector, (vec_id % 11) / 10.0 AS salience, vec_id % 7 AS hits, {NOW} - 86400 * (vec_id % 60) AS last_used, CASE WHEN vec_id % 5 = 0 THEN {NOW} + 86400 * ((vec_id % 9) - 4) END AS expires FROM embeddings)"""


def turns(t):
    return t.conversations.select("conv_id", "turn", "role", "text", (F.col("turn") == 0).alias("pinned"), (F.col("turn") % 4 == 1).alias("suppressed"), estimate_tokens("text").alias("tokens"))


def memories(t):
    i = F.col("vec_id")
    kinds = F.array(F.lit("fact"), F.lit("preference"), F.lit("task"))
    return t.embeddings.select(
        i.alias("id"), (i % 40).alias("user"), F.element_at(kinds, (1 + i % 3).cast("int")).alias("kind"), F.col("embedding").alias("vector"), ((i % 11) / 10).alias("salience"), (i % 7).alias("hits"),
        (F.lit(NOW) - 86400 * (i % 60)).alias("last_used"), F.when(i % 5 == 0, F.lit(NOW) + 86400 * (i % 9 - 4)).alias("expires"),
    )


@query("sess_live", f"WITH {TURNS_SQL} SELECT conv_id, turn FROM turns WHERE pinned OR NOT suppressed")
def sess_live(t):
    return turns(t).where("pinned or not suppressed").select("conv_id", "turn")


@query("sess_tokens", f"WITH {TURNS_SQL} SELECT conv_id, sum(tokens)::BIGINT + 7 AS tokens FROM turns WHERE pinned OR NOT suppressed GROUP BY 1")
def sess_tokens(t):
    return turns(t).where("pinned or not suppressed").groupBy("conv_id").agg((F.sum("tokens") + 7).alias("tokens"))


@query("sess_recent", f"WITH {TURNS_SQL} SELECT conv_id, turn FROM turns WHERE pinned OR NOT suppressed QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4")
def sess_recent(t):
    return M.newest(turns(t).where("pinned or not suppressed"), 4).select("conv_id", "turn")


_SUPP_SQL = f"WITH {TURNS_SQL}, s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM turns WHERE pinned OR NOT suppressed) WHERE back > 3 AND NOT pinned)"


@query("sess_suppressible", f"{_SUPP_SQL} SELECT conv_id, turn FROM s")
def sess_suppressible(t):
    return M.suppressible(turns(t), 3).select("conv_id", "turn")


@query("sess_suppress", f"{_SUPP_SQL} SELECT conv_id, count(*) AS retired, sum(tokens)::BIGINT AS tokens FROM s GROUP BY 1")
def sess_suppress(t):
    return M.suppressible(turns(t), 3).groupBy("conv_id").agg(F.count(F.lit(1)).alias("retired"), F.sum("tokens").alias("tokens"))


@query("sess_trim", f"WITH {TURNS_SQL} SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, pinned ORDER BY turn DESC) AS back FROM turns) WHERE pinned OR back <= 5")
def sess_trim(t):
    back = F.row_number().over(Window.partitionBy("conv_id", "pinned").orderBy(F.desc("turn")))
    return turns(t).withColumn("back", back).where("pinned or back <= 5").select("conv_id", "turn")


@query("sess_summary", f"{_SUPP_SQL} SELECT conv_id, md5(right(string_agg(role || ': ' || substr(text, 1, 80), chr(10) ORDER BY turn), 400)) AS digest FROM s GROUP BY 1")
def sess_summary(t):
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", F.substring("text", 1, 80)).alias("line"))))
    g = M.suppressible(turns(t), 3).groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("all"))
    return g.select("conv_id", F.md5(F.right("all", F.lit(400))).alias("digest"))


@query("sess_compact", f"{_SUPP_SQL} SELECT t.conv_id, t.turn, t.suppressed OR s.turn IS NOT NULL AS suppressed FROM turns t LEFT JOIN s USING (conv_id, turn)")
def sess_compact(t):
    s = M.suppressible(turns(t), 3).select("conv_id", "turn", F.lit(True).alias("now"))
    return turns(t).join(s, ["conv_id", "turn"], "left").select("conv_id", "turn", (F.col("suppressed") | F.coalesce("now", F.lit(False))).alias("suppressed"))


@query("msg_list", f"WITH {TURNS_SQL} SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM turns WHERE pinned OR NOT suppressed) WHERE back <= 6")
def msg_list(t):
    m = M.newest(turns(t).where("pinned or not suppressed"), 6)
    return m.select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long").alias("place"))


@query("msg_count", "SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1")
def msg_count(t):
    return t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))


@query("msg_suppress", f"WITH {TURNS_SQL} SELECT conv_id, turn, suppressed OR (turn % 3 = 0 AND NOT pinned) AS suppressed FROM turns")
def msg_suppress(t):
    return turns(t).select("conv_id", "turn", (F.col("suppressed") | ((F.col("turn") % 3 == 0) & ~F.col("pinned"))).alias("suppressed"))


@query("sess_list", "SELECT user_id, event_id, place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 4 <> 0 THEN ts END DESC NULLS LAST, event_id) AS place FROM events) WHERE place BETWEEN 3 AND 7")
def sess_list(t):
    last = F.when(F.col("event_id") % 4 != 0, F.col("ts"))
    return t.events.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(last.desc_nulls_last(), "event_id")).cast("long").alias("place")).where("place between 3 and 7")


_DECAY_SQL = f"least(1, greatest(0, salience - 0.01 * greatest(0, ({NOW} - last_used) / 86400.0)))"


@query("mem_decay", f"WITH {MEM_SQL} SELECT id, round({_DECAY_SQL}, 6) AS salience FROM mem")
def mem_decay(t):
    return memories(t).select("id", F.round(M.decayed(F.col("salience"), F.col("last_used"), NOW), 6).alias("salience"))


@query("mem_decay_pass", f"WITH {MEM_SQL} SELECT id, round({_DECAY_SQL}, 6) AS salience FROM mem WHERE abs(salience - {_DECAY_SQL}) > 1e-6")
def mem_decay_pass(t):
    now = M.decayed(F.col("salience"), F.col("last_used"), NOW)
    return memories(t).where(F.abs(F.col("salience") - now) > 1e-6).select("id", F.round(now, 6).alias("salience"))


_RECALL_SQL = f"""WITH {MEM_SQL}, q AS (SELECT vec_id AS usr, embedding AS qv FROM embeddings),
j AS (SELECT mem.*, round(list_cosine_similarity(vector::DOUBLE[], qv::DOUBLE[]), 9) AS sim FROM mem JOIN q USING (usr) WHERE expires IS NULL OR expires > {NOW}),
n AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY usr ORDER BY sim DESC, id) <= 24), s AS (SELECT usr, id, round(0.7 * sim + 0.3 * {_DECAY_SQL}, 6) AS score FROM n WHERE {_DECAY_SQL} >= 0.25)
SELECT usr AS user, id, score, row_number() OVER (PARTITION BY usr ORDER BY score DESC, id) AS place FROM s QUALIFY place <= 6"""


@query("mem_recall", _RECALL_SQL)
def mem_recall(t):
    q = t.embeddings.select(F.col("vec_id").alias("user"), F.col("embedding").alias("qv"))
    r = M.recall(q, memories(t), NOW)
    return r.withColumn("place", F.col("place").cast("long"))


@query("mem_touch", f"WITH {MEM_SQL} SELECT id, hits + 1 AS hits, round(least(1, salience + 0.05), 6) AS salience FROM mem WHERE id % 9 = 0")
def mem_touch(t):
    return memories(t).where("id % 9 = 0").select("id", (F.col("hits") + 1).alias("hits"), F.round(F.least(F.lit(1.0), F.col("salience") + M.HIT), 6).alias("salience"))


@query("mem_supersede", f"WITH {MEM_SQL}, c AS (SELECT * FROM mem WHERE id % 100 = 0), j AS (SELECT c.id AS candidate, m.id AS existing, round(list_cosine_similarity(c.vector::DOUBLE[], m.vector::DOUBLE[]), 9) AS sim FROM c JOIN mem m ON c.usr = m.usr AND m.id <> c.id) SELECT candidate, arg_max(existing, (sim, -existing)) AS existing, max(sim) >= 0.9 AS supersedes FROM j GROUP BY candidate")
def mem_supersede(t):
    from ..operators.search import cosine

    m = memories(t)
    c = m.where("id % 100 = 0").select(F.col("id").alias("candidate"), "user", F.col("vector").alias("cv"))
    j = m.join(c, "user").where("id <> candidate").withColumn("sim", F.round(cosine("cv", "vector"), 9))
    return j.groupBy("candidate").agg(F.max_by("id", F.struct("sim", -F.col("id"))).alias("existing"), (F.max("sim") >= M.SUPERSEDES).alias("supersedes"))


@query("mem_expire", f"WITH {MEM_SQL} SELECT id FROM mem WHERE expires IS NULL OR expires > {NOW}")
def mem_expire(t):
    return memories(t).where(F.col("expires").isNull() | (F.col("expires") > NOW)).select("id")


@query("mem_prune", f"WITH {MEM_SQL} SELECT usr AS user, id FROM mem QUALIFY row_number() OVER (PARTITION BY usr ORDER BY round({_DECAY_SQL}, 9) DESC, id) <= 5")
def mem_prune(t):
    w = Window.partitionBy("user").orderBy(F.round(M.decayed(F.col("salience"), F.col("last_used"), NOW), 9).desc(), "id")
    return memories(t).withColumn("r", F.row_number().over(w)).where("r <= 5").select("user", "id")


@query("mem_list", f"WITH {MEM_SQL} SELECT usr AS user, id, row_number() OVER (PARTITION BY usr ORDER BY salience DESC, last_used DESC, id) AS place FROM mem WHERE kind IN ('fact', 'task') QUALIFY place <= 10")
def mem_list(t):
    w = Window.partitionBy("user").orderBy(F.desc("salience"), F.desc("last_used"), "id")
    return memories(t).where("kind in ('fact', 'task')").select("user", "id", F.row_number().over(w).cast("long").alias("place")).where("place <= 10")


@query("memory_filter", f"WITH {MEM_SQL} SELECT id FROM mem WHERE usr = 3 AND kind IN ('fact') AND (expires IS NULL OR expires > {NOW})")
def memory_filter(t):
    return memories(t).where((F.col("user") == 3) & F.col("kind").isin("fact") & (F.col("expires").isNull() | (F.col("expires") > NOW))).select("id")


@query("mem_scan", f"WITH {MEM_SQL} SELECT id, len(vector) AS dims FROM mem WHERE usr = 7")
def mem_scan(t):
    return memories(t).where("user = 7").select("id", F.size("vector").cast("long").alias("dims"))


@query("mem_salience", f"WITH {MEM_SQL} SELECT id, CASE WHEN usr = 7 THEN 1.0 ELSE salience END AS salience FROM mem")
def mem_salience(t):
    return memories(t).select("id", F.when(F.col("user") == 7, F.least(F.lit(1.0), F.lit(1.7))).otherwise(F.col("salience")).alias("salience"))


@query("mem_consent", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'disabled' WHEN p.k IS NULL THEN 'unknown' WHEN p.k % 3 = 0 THEN 'denied' ELSE 'ok' END AS gate FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) p ON k = c_custkey")
def mem_consent(t):
    p = t.orders.select(F.col("o_custkey").alias("k")).distinct()
    gate = F.when(F.col("c_custkey") % 10 == 0, "disabled").when(F.col("k").isNull(), "unknown").when(F.col("k") % 3 == 0, "denied").otherwise("ok")
    return t.customer.join(p, F.col("c_custkey") == F.col("k"), "left").select("c_custkey", gate.alias("gate"))


CACHE_SQL = f"cache AS (SELECT vec_id AS id, 'f' || (vec_id % 4) AS bucket, CASE WHEN vec_id % 3 <> 0 THEN vec_id % 10 END AS usr, embedding AS vector, vec_id % 13 AS hits, {NOW} - 3600 * (vec_id % 50) AS created, {NOW} - 60 * (vec_id % 17) AS last_used, 86400 AS ttl FROM embeddings)"


def cache(t):
    i = F.col("vec_id")
    return t.embeddings.select(i.alias("id"), F.concat(F.lit("f"), (i % 4).cast("string")).alias("bucket"), F.when(i % 3 != 0, i % 10).alias("user"), F.col("embedding").alias("vector"), (i % 13).alias("hits"), (F.lit(NOW) - 3600 * (i % 50)).alias("created"), (F.lit(NOW) - 60 * (i % 17)).alias("last_used"), F.lit(86400).alias("ttl"))


@query("cache_filter", f"WITH {CACHE_SQL} SELECT id FROM cache WHERE bucket = 'f1' AND (usr = 5 OR usr IS NULL)")
def cache_filter(t):
    return cache(t).where("bucket = 'f1' and (user = 5 or user is null)").select("id")


@query("cache_probe", f"WITH {CACHE_SQL}, q AS (SELECT vec_id AS query, 'f' || (vec_id % 4) AS bucket, embedding AS qv FROM embeddings WHERE vec_id % 100 = 0), j AS (SELECT query, id, round(list_cosine_similarity(vector::DOUBLE[], qv::DOUBLE[]), 9) AS sim FROM q JOIN cache USING (bucket) WHERE id <> query AND created + ttl > {NOW}) SELECT query, arg_max(id, (sim, -id)) AS id, CASE WHEN max(sim) >= 0.94 THEN 'hit' ELSE 'too_far' END AS reason FROM j GROUP BY query")
def cache_probe(t):
    """The entry of its bucket that is most like each asked one, of those that have not expired."""
    from ..operators.search import best_in_group

    q = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.concat(F.lit("f"), (F.col("vec_id") % 4).cast("string")).alias("grp"), F.col("embedding").alias("vector"))
    held = cache(t).where(F.col("created") + F.col("ttl") > NOW).select("id", F.col("bucket").alias("grp"), "vector")
    return best_in_group(q, held).select("query", "id", F.when(F.col("score") >= M.SIMILAR, "hit").otherwise("too_far").alias("reason"))


@query("cache_store", "SELECT o_custkey, array_to_string(list_slice(list_sort(list(o_orderkey)), 1, 32), ',') AS ids FROM orders GROUP BY 1")
def cache_store(t):
    return t.orders.groupBy("o_custkey").agg(F.array_join(F.slice(F.array_sort(F.collect_list("o_orderkey")), 1, 32), ",").alias("ids"))


@query("cache_evict", f"WITH {CACHE_SQL} SELECT id FROM cache WHERE created + ttl > {NOW} QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY hits DESC, last_used DESC, id) <= 20")
def cache_evict(t):
    return M.evict(cache(t), "bucket", NOW, 20).select("id")


@query("cache_invalidate", f"WITH {CACHE_SQL} SELECT id FROM cache WHERE bucket <> 'f2'")
def cache_invalidate(t):
    return cache(t).where("not bucket = 'f2'").select("id")


@query("cache_meta", f"WITH {CACHE_SQL} SELECT id, hits + CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS hits FROM cache")
def cache_meta(t):
    return cache(t).select("id", (F.col("hits") + F.when(F.col("id") % 2 == 0, 1).otherwise(0)).alias("hits"))


@query("cache_ids", f"WITH {CACHE_SQL} SELECT id, round((40 - rank + 1) / 40.0, 6) AS fusion_score FROM (SELECT range AS id, row_number() OVER (ORDER BY range) AS rank FROM range(20, 140, 3)) JOIN cache USING (id)")
def cache_ids(t):
    plan = t.values([(list(range(20, 140, 3)),)], "ids array<long>").select(F.posexplode("ids").alias("rank", "id"))
    return cache(t).join(F.broadcast(plan), "id").select("id", F.round((40 - F.col("rank")) / 40, 6).alias("fusion_score"))


def stored(t):
    """``memories`` with texts and the columns of the whole table."""
    m = memories(t)
    return m.select("user", "id", "kind", F.concat(F.lit("memory "), F.col("id").cast("string")).alias("text"), "vector", "salience", "hits", F.lit(NOW - 90 * 86_400).cast("long").alias("created"), "last_used", "expires", F.lit(None).cast("long").alias("supersedes"))


def profiles(t):
    """Every user but each eleventh has a profile, every seventh of them without consent."""
    return t.embeddings.select((F.col("vec_id") % 40).alias("user")).distinct().where("user % 11 <> 10").select("user", (F.col("user") % 7 != 3).alias("memory_consent"))


@query("mem_consolidate")
def mem_consolidate(t):
    """What a pass over all users does: a row for each, with digests of what it leaves."""
    out = C.consolidate(stored(t), profiles(t), NOW, 0.3, 8)
    after = out["memories"].groupBy("user").agg(F.count(F.lit(1)).alias("left"), F.sum("hits").alias("hits"), F.round(F.sum("salience"), 6).alias("salience"))
    return out["report"].join(after, "user", "left")


@query("mem_profile")
def mem_profile(t):
    return C.consolidate(stored(t), profiles(t), NOW, 0.3, 8)["profiles"].select("user", F.md5("summary").alias("digest"))


@query("mem_write")
def mem_write(t):
    """Every tenth vector said again by the user before: stored, in the place of what is like it, or dropped."""
    i = F.col("vec_id")
    c = t.embeddings.where("vec_id % 10 = 0").select(((i + 39) % 40).alias("user"), (1_000_000 + i).alias("id"), F.lit("fact").alias("kind"), F.concat(F.lit("New fact of mail"), i.cast("string"), F.lit("@example.org")).alias("text"), F.col("embedding").alias("vector"), F.lit(1.5).alias("salience"))
    return C.write_back(c, stored(t), profiles(t), NOW, 0.4, 60)["stored"]
