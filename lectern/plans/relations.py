"""Queries over stores, intervals, graph and vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph, intervals, retrieval, stores
from .registry import Registry

R = Registry()
QUERIES, SQL = R.queries, R.sql


_MANIFEST = """
f AS (SELECT doc_id, source || '/' || doc_id AS path, n_chars AS size, doc_id % 7 AS mtime, lang AS options, md5(text) AS md5 FROM documents),
m AS (SELECT path, CASE WHEN doc_id % 5 = 0 THEN size + 1 ELSE size END AS size, mtime, options, CASE WHEN doc_id % 11 <> 0 THEN md5 END AS md5 FROM f WHERE doc_id % 3 <> 0)
"""


def _files(t):
    f = t("documents").select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("size"), (F.col("doc_id") % 7).alias("mtime"), F.col("lang").alias("options"), F.md5(F.col("text").cast("binary")).alias("md5"))
    m = f.filter("doc_id % 3 <> 0").select("path", F.when(F.col("doc_id") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "mtime", "options", F.when(F.col("doc_id") % 11 != 0, F.col("md5")).alias("md5"))
    return f, m


_KEYS = ["path", "size", "mtime", "options"]


@R.add(f"WITH {_MANIFEST} SELECT doc_id, path FROM f WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.path = f.path AND m.size = f.size AND m.mtime = f.mtime AND m.options = f.options AND m.md5 IS NOT NULL)")
def manifest_todo(t):
    return stores.todo(*_files(t), _KEYS).select("doc_id", "path")


@R.add(f"WITH {_MANIFEST} SELECT doc_id, path FROM f WHERE EXISTS (SELECT 1 FROM m WHERE m.path = f.path AND m.size = f.size AND m.mtime = f.mtime AND m.options = f.options AND m.md5 IS NOT NULL)")
def manifest_skipped(t):
    return stores.skipped(*_files(t), _KEYS).select("doc_id", "path")


@R.add("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def latest_status(t):
    return stores.latest(t("events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], "ts", "event_id").select("user_id", "event_type", "ts")


@R.add("""
SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders
UNION ALL SELECT -1, max(o_orderkey) + 1, 'N' FROM orders""")
def store_upsert(t):
    old = t("orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    changed = old.filter("o_orderkey % 4 = 0").withColumn("o_orderstatus", F.lit("X"))
    fresh = old.agg((F.max("o_orderkey") + 1).alias("o_orderkey")).select(F.lit(-1).cast("long").alias("o_custkey"), "o_orderkey", F.lit("N").alias("o_orderstatus"))
    return stores.upsert(old, changed.unionByName(fresh), ["o_orderkey"])


@R.add("""
SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN 'done' ELSE c_name END AS c_name FROM customer""")
def status_merge(t):
    old = t("customer").select("c_custkey", "c_mktsegment", "c_name")
    new = old.filter("c_custkey % 3 = 0").select("c_custkey", F.lit(None).cast("string").alias("c_mktsegment"), F.lit("done").alias("c_name"))
    return stores.merge_fields(old, new, ["c_custkey"])


@R.add("""
WITH o AS (SELECT user_id, list(event_type ORDER BY event_id) AS xs FROM events WHERE event_id % 2 = 0 GROUP BY user_id),
n AS (SELECT user_id, list(event_type ORDER BY event_id) AS xs FROM events WHERE event_id % 2 = 1 GROUP BY user_id),
a AS (SELECT user_id, list_concat(coalesce(o.xs, []), coalesce(n.xs, [])) AS xs FROM o FULL JOIN n USING (user_id)),
p AS (SELECT user_id, xs, unnest(range(1, len(xs) + 1)) AS i FROM a),
q AS (SELECT user_id, xs[i] AS x, min(i) AS i FROM p GROUP BY 1, 2)
SELECT user_id, string_agg(x, ',' ORDER BY i) AS items, count(*) AS n FROM q GROUP BY user_id""")
def chunks_list_merge(t):
    side = lambda k: t("events").filter(F.col("event_id") % 2 == k).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("items"))
    return stores.union_lists(side(0), side(1), "user_id", "items").select("user_id", F.array_join("items", ",").alias("items"), "n")


@R.add("""
WITH a AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 0), b AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 1),
u AS (SELECT user_id FROM a UNION SELECT user_id FROM b)
SELECT user_id, NOT EXISTS ((SELECT event_type FROM a WHERE a.user_id = u.user_id EXCEPT SELECT event_type FROM b WHERE b.user_id = u.user_id)
  UNION ALL (SELECT event_type FROM b WHERE b.user_id = u.user_id EXCEPT SELECT event_type FROM a WHERE a.user_id = u.user_id)) AS same FROM u""")
def set_guard(t):
    e = t("events")
    return stores.same_sets(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), "user_id", "event_type")


_TIME = """
e AS (SELECT user_id, event_id, event_type, epoch(ts)::DOUBLE AS s, epoch(ts)::DOUBLE + greatest(value, 0) * 60 AS f FROM events),
seg AS (SELECT user_id, event_id, event_type, s, f FROM e WHERE event_type <> 'view'),
scene AS (SELECT user_id, event_id, s, f FROM e WHERE event_type = 'view')
"""


def _time(t):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    e = t("events").select("user_id", "event_id", "event_type", at.alias("s"), (at + F.greatest(F.col("value"), F.lit(0.0)) * 60).alias("f"))
    seg = e.filter("event_type <> 'view'").select("user_id", F.col("event_id").alias("seg_idx"), F.col("event_type").alias("text"), F.col("s").alias("s_start"), F.col("f").alias("s_end"))
    scene = e.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("scene_idx"), F.col("s").alias("start"), F.col("f").alias("end"))
    return scene, seg


@R.add(f"""WITH {_TIME} SELECT a.user_id, a.event_id AS scene_idx, string_agg(b.event_type, ' ' ORDER BY b.s, b.event_id) AS transcript
FROM scene a JOIN seg b ON a.user_id = b.user_id AND b.f > a.s AND b.s < a.f GROUP BY 1, 2""")
def scene_transcript(t):
    return intervals.texts_in_range(*_time(t), "user_id", 3600.0)


@R.add(f"WITH {_TIME} SELECT user_id, event_id AS seg_idx FROM seg WHERE NOT EXISTS (SELECT 1 FROM scene WHERE scene.user_id = seg.user_id AND seg.f > scene.s AND seg.s < scene.f)")
def speech_outside_scenes(t):
    scene, seg = _time(t)
    return intervals.outside(seg, scene, "user_id", width=3600.0).select("user_id", "seg_idx")


@R.add(f"""
WITH {_TIME}, r AS (SELECT *, max(f) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM seg),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT user_id, island::BIGINT AS island, count(*) AS n, round(max(f) - min(s), 3) AS length FROM i GROUP BY 1, 2""")
def session_islands(t):
    _, seg = _time(t)
    out = intervals.islands(seg, "user_id", "s_start", "s_end", "seg_idx")
    return out.groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("s_end") - F.min("s_start"), 3).alias("length"))


@R.add("""
WITH RECURSIVE s AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
p AS (SELECT conv_id, k, turn, 0 AS w, n::BIGINT AS load FROM s WHERE k = 1
  UNION ALL SELECT s.conv_id, s.k, s.turn, CASE WHEN p.load + s.n > 2000 THEN p.w + 1 ELSE p.w END, CASE WHEN p.load + s.n > 2000 THEN s.n ELSE p.load + s.n END
  FROM p JOIN s ON s.conv_id = p.conv_id AND s.k = p.k + 1)
SELECT conv_id, turn, w::INT AS packed FROM p""")
def token_packing(t):
    rows = F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n"))))
    packed = t("conversations").groupBy("conv_id").agg(rows.alias("rows")).withColumn("w", intervals.pack_in_order(F.transform("rows", lambda r: r["n"]), 2000))
    return packed.select("conv_id", F.explode(F.arrays_zip("rows", "w")).alias("x")).select("conv_id", F.col("x.rows.turn").alias("turn"), F.col("x.w").alias("packed"))


@R.add("""
SELECT conv_id, turn, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // greatest(ceil(count(*) OVER (PARTITION BY conv_id) / 3.0)::BIGINT, 1))::BIGINT AS part FROM conversations""")
def even_groups(t):
    w = Window.partitionBy("conv_id")
    index = F.row_number().over(w.orderBy("turn")) - 1
    return t("conversations").select("conv_id", "turn", intervals.even_groups(index, F.count(F.lit(1)).over(w), 3).alias("part"))


_VEC = """
q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS sim FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, vec_id) AS rank FROM s)
"""


def _near(t, k, threshold=None):
    e = t("embeddings")
    return retrieval.nearest(e, e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), k, threshold)


@R.add(f"WITH {_VEC} SELECT query_id, vec_id, rank::INT AS rank, round(sim, 6) AS sim FROM r WHERE rank <= 10")
def cosine_topk(t):
    return _near(t, 10).select("query_id", "vec_id", "rank", F.round("sim", 6).alias("sim"))


@R.add(f"WITH {_VEC} SELECT query_id, count(*) AS n, round(min(sim), 6) AS least FROM r WHERE rank <= 60 AND sim >= 0.2 GROUP BY query_id")
def naive_threshold(t):
    return _near(t, retrieval.TOP_K, retrieval.THRESHOLD).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("sim"), 6).alias("least"))


@R.add(f"""WITH {_VEC}, v AS (SELECT query_id, label, count(*) AS n FROM r JOIN embeddings USING (vec_id) WHERE rank <= 10 GROUP BY 1, 2)
SELECT query_id, arg_max(label, n * 1000000 - label) AS label, max(n) AS votes FROM v GROUP BY query_id""")
def label_neighbors_vote(t):
    votes = _near(t, 10).join(t("embeddings").select("vec_id", "label"), "vec_id").groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("query_id").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"), F.max("n").alias("votes"))


_PATTERN = "[A-Z][a-z]+"
#: Hashes that a broadcast may hold: 16 MB.
BROADCAST_HASHES = 2_000_000
_FOUND = f"""
x AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_PATTERN}')) AS entity FROM documents),
f AS (SELECT doc_id, entity, count(*) AS n FROM x WHERE length(entity) >= 4 GROUP BY 1, 2)
"""
_EDGES = """
p AS (SELECT doc_id, entity AS src, lead(entity) OVER w AS tgt, least(n, lead(n) OVER w) AS m FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY entity)),
e AS (SELECT src, tgt, sum(m)::DOUBLE AS weight, count(*) AS docs FROM p WHERE tgt IS NOT NULL GROUP BY 1, 2)
"""


def _found(t):
    return graph.mentions(t("documents"), "doc_id", "text", _PATTERN)


@R.add(f"WITH {_FOUND} SELECT entity, count(*) AS docs, sum(n)::BIGINT AS n, min(doc_id) AS first_doc FROM f GROUP BY entity")
def entity_nodes(t):
    return graph.nodes(_found(t), "doc_id")


@R.add(f"WITH {_FOUND}, {_EDGES} SELECT * FROM e")
def entity_edges(t):
    return graph.neighbours(_found(t), "doc_id")


@R.add(f"WITH {_FOUND} SELECT entity AS src, source || ' (document)' AS tgt, 10.0::DOUBLE AS weight, doc_id FROM f JOIN documents USING (doc_id)")
def belongs_to(t):
    items = t("documents").select("doc_id", F.concat("source", F.lit(" (document)")).alias("item_entity"))
    return graph.belongs_to(_found(t), items, "doc_id")


@R.add(f"""WITH {_FOUND} SELECT least(entity, source) AS src, greatest(entity, source) AS tgt, sum(10.0)::DOUBLE AS weight,
  string_agg(DISTINCT doc_id::VARCHAR, '<SEP>' ORDER BY doc_id::VARCHAR) AS sources FROM f JOIN documents USING (doc_id) GROUP BY 1, 2""")
def merged_edges(t):
    items = t("documents").select("doc_id", F.col("source").alias("item_entity"))
    return graph.merge_edges(graph.belongs_to(_found(t), items, "doc_id"), "doc_id")


_SEED = "SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS entity FROM benchmark"


def _seeds(t):
    return t("benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(_PATTERN), F.lit(0))).alias("entity")).distinct()


_LOCAL = f"""
seed AS ({_SEED}),
b AS (SELECT src, tgt FROM e UNION SELECT tgt, src FROM e),
reach AS (SELECT entity FROM seed UNION SELECT tgt FROM b JOIN seed ON b.src = seed.entity),
loc AS (SELECT doc_id, count(*)::DOUBLE AS score FROM f JOIN reach USING (entity) GROUP BY doc_id)
"""
_GLOBAL = """
ends AS (SELECT DISTINCT unnest([src, tgt]) AS entity FROM e WHERE src IN (SELECT entity FROM seed) OR tgt IN (SELECT entity FROM seed)),
glo AS (SELECT doc_id, count(*)::DOUBLE AS score FROM f JOIN ends USING (entity) GROUP BY doc_id)
"""


def _mode(t, mode, naive=None):
    found = _found(t)
    empty = t("documents").select("doc_id", F.lit(0.0).alias("score")).limit(0)
    return retrieval.retrieve(mode, _seeds(t), found, graph.neighbours(found, "doc_id"), empty if naive is None else naive, "doc_id")


@R.add(f"WITH {_FOUND}, {_EDGES}, {_LOCAL} SELECT * FROM loc")
def local_expand(t):
    return _mode(t, "local")


@R.add(f"WITH {_FOUND}, {_EDGES}, {_LOCAL}, {_GLOBAL} SELECT * FROM glo")
def global_edges(t):
    return _mode(t, "global")


@R.add(f"WITH {_FOUND}, {_EDGES}, {_LOCAL}, {_GLOBAL} SELECT doc_id, max(score) AS score FROM (SELECT * FROM loc UNION ALL SELECT * FROM glo) GROUP BY doc_id")
def hybrid_union(t):
    return _mode(t, "hybrid")


_MIX = f"""WITH {_FOUND}, {_EDGES}, {_LOCAL}, {_GLOBAL}, {_VEC},
n AS (SELECT vec_id AS doc_id, max(sim) AS score FROM r WHERE rank <= 60 AND sim >= 0.2 AND vec_id IN (SELECT doc_id FROM documents) GROUP BY vec_id)
SELECT doc_id, round(max(score), 6) AS score FROM (SELECT * FROM loc UNION ALL SELECT * FROM glo UNION ALL SELECT * FROM n) GROUP BY doc_id"""


@R.add(_MIX)
def mix_union(t):
    """A vector belongs to the document of its id; the naive score is the best cosine over the queries."""
    near = _near(t, retrieval.TOP_K, retrieval.THRESHOLD).groupBy(F.col("vec_id").alias("doc_id")).agg(F.max("sim").alias("score"))
    naive = near.join(t("documents").select("doc_id"), "doc_id", "left_semi")
    return _mode(t, "mix", naive).select("doc_id", F.round("score", 6).alias("score"))


# Earlier names of the same queries.
@R.add(f"WITH {_FOUND}, {_EDGES}, {_LOCAL} SELECT * FROM loc")
def local_expand_all(t):
    return local_expand(t)


@R.add(_MIX)
def mix_union_all(t):
    return mix_union(t)


@R.add("""SELECT lang, doc_id, used::BIGINT AS used FROM (
  SELECT lang, doc_id, sum(n_chars // 4) OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents) WHERE used <= 20000""")
def token_budget(t):
    rows = t("documents").withColumn("tokens", F.floor(F.col("n_chars") / 4).cast("long"))
    return retrieval.within_budget(rows, "lang", [F.desc("n_chars"), F.col("doc_id")], "tokens", 20000).select("lang", "doc_id", "used")


@R.add("""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[^ \\t\\n\\r\\f\\v]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[^ \\t\\n\\r\\f\\v]+') AS ws FROM benchmark),
dg AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
bg AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM b))
SELECT doc_id, item_id, count(*) AS shared FROM dg JOIN bg USING (g) GROUP BY 1, 2""")
def contamination_join(t):
    """Word 8-grams that documents share with benchmark items."""

    def grams(df, key):
        ws = F.filter(F.split(F.lower("text"), r"[ \t\n\r\f\x0B]+"), lambda w: w != "")
        rows = df.select(key, ws.alias("ws")).filter(F.size("ws") >= 8)
        hashed = lambda i: F.struct(F.xxhash64(F.slice("ws", i, 8)).alias("h"), F.array_join(F.slice("ws", i, 8), " ").alias("g"))
        return rows.select(key, F.inline(F.transform(F.sequence(F.lit(1), F.size("ws") - 7), hashed)))

    wanted = grams(t("benchmark"), "item_id").distinct()
    hashes = wanted.select("h").distinct()
    # Grams that no item has go before anything is shuffled, as long as the
    # items' hashes are few enough to send to every task.
    if hashes.count() <= BROADCAST_HASHES:
        hashes = F.broadcast(hashes)
    met = grams(t("documents"), "doc_id").join(hashes, "h", "left_semi").distinct()
    return met.join(wanted, ["h", "g"]).groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("shared"))
