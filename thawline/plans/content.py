"""Text and vector representations of items."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import blocks as bl
from ..operators import content as ct
from ..operators import models as md
from ..sources import schemas
from ..sources.readers import Checkpoint, materialise, read_stats, scratch_path
from .base import query
from .fixtures import SPLIT_SQL, items, kept, split, table, vectors

ROLES = ("title", "creator", "taxonomy")
STOPS = "[" + ", ".join(f"'{w}'" for w in fx.STOP_WORDS) + "]"
TERMS = f""", doc AS (SELECT p_partkey AS item_id, p_name AS title, lower(p_brand) AS creator, p_type AS taxonomy FROM part),
words AS (SELECT item_id, 'title' AS role, unnest(list_filter(regexp_extract_all(lower(title), '\\w\\w+'), lambda w: NOT list_contains({STOPS}, w))) AS term FROM doc),
ents AS (SELECT item_id, 'creator' AS role, trim(regexp_replace(regexp_replace(lower(creator), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')) AS term FROM doc
  UNION ALL SELECT item_id, 'taxonomy', trim(regexp_replace(regexp_replace(lower(taxonomy), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')) FROM doc),
terms AS (SELECT item_id, role, term, count(*) AS tf FROM (SELECT * FROM words UNION ALL SELECT * FROM ents) GROUP BY 1, 2, 3),
wi AS (SELECT DISTINCT item_id FROM train),
space AS (SELECT role, term, count(*) AS df, ln((1 + (SELECT count(*) FROM wi)) / (1 + count(*))) + 1 AS idf FROM terms WHERE item_id IN (SELECT item_id FROM wi) GROUP BY 1, 2 HAVING count(*) >= 2)"""
ROWS = """, raw AS (SELECT t.item_id, t.role, t.term, (1 + ln(tf)) * idf AS x FROM terms t JOIN space s ON s.role = t.role AND s.term = t.term),
blk AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY item_id, role)) * CASE role WHEN 'taxonomy' THEN 0.5 ELSE 1.0 END AS y FROM raw),
tf AS (SELECT item_id, role, term, y / sqrt(sum(y * y) OVER (PARTITION BY item_id)) AS w FROM blk)"""
S = "WITH " + SPLIT_SQL


def _docs(spark, sf):
    meta = items(spark, sf).select("item_id", F.col("p_name").alias("title"), F.lower("p_brand").alias("store"), F.col("p_type").alias("categories"), F.lit(None).cast("string").alias("author_name"), F.lit(0).alias("at"))
    return ct.documents(items(spark, sf), meta, schemas.FIELD_MAPS["books"], ["at"])


def _terms(spark, sf):
    return ct.role_terms(_docs(spark, sf), ROLES)


def _space(spark, sf, s):
    terms = _terms(spark, sf)
    return terms, ct.fit_space(terms, s.train.select("item_id").distinct())


def _rows(spark, sf, s):
    terms, space = _space(spark, sf, s)
    return ct.transform(terms, space)


@query(S + TERMS + "SELECT item_id, role, term, tf FROM terms")
def role_terms(spark, sf):
    """TXT-01, FN-05, FN-06, FN-19, JOIN-06, REL-10, SRC-10"""
    return _terms(spark, sf)


@query(S + TERMS + "SELECT role, term, df, round(idf, 9) AS idf FROM space")
def tfidf_vocab(spark, sf):
    """TXT-02, FN-20"""
    return _space(spark, sf, split(spark, sf))[1].withColumn("idf", F.round("idf", 9))


@query(S + TERMS + ROWS + "SELECT item_id, role, term, round(w, 9) AS w FROM tf")
def tfidf_rows(spark, sf):
    """TXT-03, TXT-04, TXT-05"""
    return _rows(spark, sf, split(spark, sf)).withColumn("w", F.round("w", 9))


PROFILES = ROWS + """, prof AS (SELECT h.user_id, role, term, sum(w / n) AS w FROM train h JOIN (SELECT user_id, count(*) AS n FROM train GROUP BY 1) c USING (user_id) JOIN tf USING (item_id) GROUP BY 1, 2, 3)"""
NEAR = PROFILES + """, nrm AS (SELECT user_id, sqrt(sum(w * w)) AS norm FROM prof GROUP BY 1),
sc AS (SELECT p.user_id, t.item_id, sum(p.w * t.w) AS score FROM prof p JOIN tf t ON t.role = p.role AND t.term = p.term WHERE t.item_id IN (SELECT item_id FROM cold_test) GROUP BY 1, 2)"""


@query(S + TERMS + PROFILES + "SELECT user_id, role, term, round(w, 9) AS w FROM prof")
def user_profiles(spark, sf):
    """TXT-10, AGG-09"""
    s = split(spark, sf)
    return ct.profiles(s.train, _rows(spark, sf, s)).withColumn("w", F.round("w", 9))


def _packed(spark, sf):
    """(split, packed item rows): written once for the scores that start from them."""

    def make():
        s = split(spark, sf)
        return s, materialise(ct.packed_rows(_docs(spark, sf), s.train, ROLES))

    return kept(spark, ("packed", sf), make)


def _profiles(spark, sf):
    """(split, item rows, profiles of all users with a train row)."""

    def make():
        s, rows = _packed(spark, sf)
        return s, rows, materialise(bl.profiles(s.train, rows))

    return kept(spark, ("profiles", sf), make)


def _cold(s, rows):
    return rows.join(s.cold_ids.withColumnRenamed("item_id", "id"), "id", "left_semi")


@query(S + TERMS + NEAR + "SELECT item_id, count(*) AS n, round(sum(score), 5) AS total, round(sum(score * score), 6) AS squares, round(sum(score * (user_id % 97)), 4) AS spread, round(max(score), 6) AS best FROM sc GROUP BY 1")
def content_scores(spark, sf):
    """JOIN-08, TXT-07: all cold scores of all users, as sums that any wrong or misplaced score would move"""
    s, rows, users = _profiles(spark, sf)
    sums = ct.score_sums(users, _cold(s, rows)).where("n > 0")
    return sums.select("item_id", "n", F.round("total", 5).alias("total"), F.round("squares", 6).alias("squares"), F.round("spread", 4).alias("spread"), F.round("best", 6).alias("best"))


@query(S + TERMS + NEAR + "SELECT count(*) AS n, round(avg(score), 7) AS mean, round(stddev_pop(score), 6) AS std FROM (SELECT coalesce(score, 0) AS score FROM (SELECT DISTINCT user_id FROM train) u CROSS JOIN cold_test c LEFT JOIN sc ON sc.user_id = u.user_id AND sc.item_id = c.item_id)")
def score_scale(spark, sf):
    """AGG-10, ML-06: moments of all cells, zeros among them, from one row a pair of blocks"""
    s, rows, users = _profiles(spark, sf)
    return md.score_moments(users, _cold(s, rows)).select("n", F.round("mean", 7).alias("mean"), F.round("std", 6).alias("std"))


@query(S + TERMS + NEAR + ", r AS (SELECT item_id, user_id, round(score / norm, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(score / norm, 9) DESC, user_id) AS rank FROM sc JOIN nrm USING (user_id)) SELECT item_id, rank, score FROM r WHERE rank <= 50")
def filter_candidates(spark, sf):
    """SYN-01, TOPK-03"""
    s, rows, users = _profiles(spark, sf)
    return ct.filter_candidates(users, _cold(s, rows)).select("item_id", "rank", F.round("score", 6).alias("score"))


@query(S + TERMS + ROWS + ", n AS (SELECT a.item_id AS source_id, b.item_id, sum(a.w * b.w) AS score FROM tf a JOIN tf b ON a.role = b.role AND a.term = b.term AND a.item_id <> b.item_id WHERE a.item_id IN (SELECT item_id FROM cold_test) GROUP BY 1, 2) SELECT source_id, item_id, round(score, 6) AS score, row_number() OVER (PARTITION BY source_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM n QUALIFY rank <= 10")
def item_neighbours(spark, sf):
    """TXT-11"""
    s, rows = _packed(spark, sf)
    return ct.neighbours(rows, s.cold_ids, 10).withColumn("score", F.round("score", 6))


DENSE = "d AS (SELECT p_partkey AS item_id, embedding::DOUBLE[] AS v FROM part JOIN embeddings ON vec_id = p_partkey % (SELECT count(*) FROM embeddings))"


@query(S + TERMS + ROWS + ", " + DENSE + """, inv AS (SELECT item_id, 1 / sqrt(list_sum(list_transform(v, lambda x: x * x)) + coalesce(s, 0)) AS inv FROM d LEFT JOIN (SELECT item_id, sum(w * w) AS s FROM tf GROUP BY 1) USING (item_id)),
 c AS (SELECT item_id FROM cold_test), pair AS (SELECT a.item_id AS source_id, b.item_id FROM c a CROSS JOIN c b WHERE a.item_id <> b.item_id),
 ds AS (SELECT source_id, pair.item_id, list_dot_product(x.v, y.v) AS s FROM pair JOIN d x ON x.item_id = source_id JOIN d y ON y.item_id = pair.item_id),
 ss AS (SELECT a.item_id AS source_id, b.item_id, sum(a.w * b.w) AS s FROM tf a JOIN tf b ON a.role = b.role AND a.term = b.term WHERE a.item_id IN (FROM c) AND b.item_id IN (FROM c) GROUP BY 1, 2),
 z AS (SELECT source_id, item_id, round((ds.s + coalesce(ss.s, 0)) * i.inv * j.inv, 9) AS score FROM ds LEFT JOIN ss USING (source_id, item_id) JOIN inv i ON i.item_id = source_id JOIN inv j USING (item_id))
SELECT source_id, item_id, round(score, 6) AS score, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, item_id) AS rank FROM z WHERE score > 0 QUALIFY rank <= 5""")
def mixed_neighbours(spark, sf):
    """TXT-08, TXT-09: dense and sparse parts under one joint length, and scores over both"""
    s = split(spark, sf)
    space = materialise(ct.as_space(ct.joint_space(vectors(spark, sf), _rows(spark, sf, s), 64)))
    return ct.neighbours(_cold(s, space), s.cold_ids, 5).withColumn("score", F.round("score", 6))


@query(S + TERMS + ROWS.replace("'taxonomy' THEN 0.5 ELSE 1.0", "'taxonomy' THEN 0.0 WHEN 'creator' THEN 0.0 ELSE 1.0").replace("FROM blk)", "FROM blk WHERE y <> 0)") + """, nb AS (SELECT * FROM (SELECT a.item_id AS source_id, b.item_id, round(sum(a.w * b.w), 9) AS score FROM tf a JOIN tf b ON a.role = b.role AND a.term = b.term AND a.item_id <> b.item_id WHERE a.item_id IN (FROM cold_test) GROUP BY 1, 2) WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY score DESC, item_id) <= 10),
 blk2 AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY item_id, role)) * CASE role WHEN 'taxonomy' THEN 0.5 ELSE 1.0 END AS y FROM raw), tf2 AS (SELECT item_id, role, term, y / sqrt(sum(y * y) OVER (PARTITION BY item_id)) AS w FROM blk2),
 na AS (SELECT * FROM (SELECT a.item_id AS source_id, b.item_id, round(sum(a.w * b.w), 9) AS score FROM tf2 a JOIN tf2 b ON a.role = b.role AND a.term = b.term AND a.item_id <> b.item_id WHERE a.item_id IN (FROM cold_test) GROUP BY 1, 2) WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY score DESC, item_id) <= 10)
SELECT source_id, count(*) AS shared FROM na JOIN nb USING (source_id, item_id) GROUP BY 1""")
def neighbour_overlap(spark, sf):
    """SET-09: ten neighbours by all roles against ten by the title alone"""
    s, rows = _packed(spark, sf)
    terms, space = _space(spark, sf, s)
    titles = bl.packed(ct.transform(terms, space, {"title": 1.0, "creator": 0.0, "taxonomy": 0.0}), "item_id")
    return ct.neighbour_overlap(ct.neighbours(rows, s.cold_ids, 10), ct.neighbours(titles, s.cold_ids, 10))


@query("SELECT p_partkey AS item_id, e IS NULL AS missing, array_to_string(list_transform(coalesce(e, list_transform(range(64), lambda i: 0.0::DOUBLE)), lambda x: CAST(CAST(round(x * 1000000) AS BIGINT) AS VARCHAR)), ',') AS v FROM part LEFT JOIN (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 3 <> 0) ON vec_id = p_partkey")
def aligned_vectors(spark, sf):
    """SRC-11: a third of the vectors lack, and items beyond their number"""
    stored = table(spark, sf, "embeddings").where("vec_id % 3 <> 0").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v"))
    v = ct.aligned_vectors(items(spark, sf), stored, 64)
    return v.select("item_id", "missing", F.array_join(F.transform("v", lambda x: F.round(x * 1_000_000).cast("long").cast("string")), ",").alias("v"))


@query(S + TERMS + ROWS + ", d AS (SELECT p_partkey AS item_id, list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) AS d FROM part JOIN embeddings ON vec_id = p_partkey % (SELECT count(*) FROM embeddings)), s AS (SELECT item_id, sum(w * w) AS s FROM tf GROUP BY 1) SELECT item_id, round(coalesce(d, 0), 6) AS d, round(coalesce(s, 0), 6) AS s, round(coalesce(1 / nullif(sqrt(coalesce(d, 0) + coalesce(s, 0)), 0), 0), 6) AS inv FROM d FULL JOIN s USING (item_id)")
def joint_space(spark, sf):
    """TXT-06"""
    s = split(spark, sf)
    out = ct.joint_norm(vectors(spark, sf), _rows(spark, sf, s))
    return out.select("item_id", *(F.round(c, 6).alias(c) for c in ("d", "s", "inv")))


@query("SELECT doc_id, len(w) AS n_windows, array_to_string(list_transform(w, lambda x: md5(x)), ',') AS digests FROM (SELECT doc_id, CASE WHEN len(x) <= 750 THEN [text] ELSE list_transform(list_slice(range(0, len(x), 650), 1, 4), lambda i: array_to_string(list_slice(x, i + 1, i + 750), ' ')) END AS w FROM (SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda y: y <> '') AS x FROM documents))")
def word_windows(spark, sf):
    """FN-10: the operator's own sizes, and a digest of each whole window"""
    w = fx.windows("text")
    return table(spark, sf, "documents").select("doc_id", F.size(w).alias("n_windows"), F.array_join(F.transform(w, F.md5), ",").alias("digests"))


REPLY = "CASE turn % 5 WHEN 0 THEN 'Answer: No. On reflection, ANSWER: Yes' WHEN 1 THEN 'thinking... answer: no' WHEN 2 THEN 'Answer: **yes**' WHEN 3 THEN text || ' Answer:nothing' ELSE text END"


@query(f"SELECT conv_id, turn, role, coalesce(lower(list_last(regexp_extract_all(coalesce({REPLY}, ''), 'answer:\\s*(yes|no)', 1, 'i'))), '') AS answer FROM conversations")
def parsed_answers(spark, sf):
    """FN-15: the last of several, a prefix of a longer word, other signs in between, none"""
    reply = F.expr(REPLY)
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", fx.answer(reply).alias("answer"))


@query("""WITH t AS (SELECT conv_id, list(coalesce(text, '') ORDER BY turn, text) AS h FROM conversations WHERE conv_id % 4 <> 0 GROUP BY 1), c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT conv_id, 'A reader liked these items:' || chr(10) || coalesce(array_to_string(list_transform(h[1:10], lambda x: '- ' || x), chr(10)), '(no prior history)') || chr(10)
  || 'Would the reader like this one?' || chr(10) || '- item ' || conv_id::VARCHAR || chr(10) || 'Reply with yes or no.' AS prompt FROM c LEFT JOIN t USING (conv_id)""")
def prompts(spark, sf):
    """FN-16: ten titles at most, and an empty history"""
    rows = table(spark, sf, "conversations")
    shown = rows.where("conv_id % 4 <> 0").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]).alias("h"))
    joined = rows.select("conv_id").distinct().join(shown, "conv_id", "left")
    return joined.select("conv_id", fx.prompt(F.col("h"), F.concat(F.lit("item "), F.col("conv_id").cast("string"))).alias("prompt"))


SECTIONED = "SELECT doc_id, trim(coalesce(text, '')[1:200]) AS a, trim(coalesce(text, '')[201:600]) AS b, trim(coalesce(text, '')[601:]) AS c FROM documents"


@query(f"""SELECT doc_id, 'jacket_copy' AS section, md5(CASE doc_id % 3 WHEN 0 THEN trim(a || ' Excerpt.. ' || c) ELSE a END) AS digest FROM ({SECTIONED}) WHERE doc_id % 3 = 0 OR a <> ''
UNION ALL SELECT doc_id, 'author_bio', md5(trim('About the Author. ' || b)) FROM ({SECTIONED}) UNION ALL SELECT doc_id, 'editorial_review', md5(trim('Review. ' || c)) FROM ({SECTIONED}) WHERE doc_id % 3 <> 0""")
def section_groups(spark, sf):
    """FN-09: headings of three groups in each text; every part stays, under its group"""
    t = F.coalesce("text", F.lit(""))
    part = lambda at, n: F.substring(t, at, n)
    head = F.when(F.col("doc_id") % 3 == 0, F.lit(" Excerpt. ")).otherwise(F.lit(" Review "))
    text = F.concat(part(1, 200), F.lit(" About the Author "), part(201, 400), head, part(601, 1 << 30))
    return table(spark, sf, "documents").select("doc_id", F.explode(fx.sections(text)).alias("section", "text")).select("doc_id", "section", F.md5("text").alias("digest"))


@query("""WITH e AS (SELECT event_id, value, event_id % 4 AS m, -((event_id % 7) + 1) / 4 AS a, -((event_id % 5) + 1) / 8 AS b, -((event_id % 11) + 10) / 2 AS c FROM events)
SELECT event_id, round(ln(exp(value / 100) + exp(-value / 100)), 6) AS lse, round(CASE m WHEN 0 THEN ln(exp(a) + exp(c)) - b WHEN 1 THEN ln(exp(a) + exp(b)) - c WHEN 2 THEN c - a END, 6) AS odds, CASE m WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 2 END AS position FROM e""")
def answer_log_odds(spark, sf):
    """FN-12, FN-13, FN-14: several surface forms of one answer, a side that lacks, neither; and the last position that holds an answer"""
    m, n = F.col("event_id") % 4, F.col("event_id")
    a, b, c = -((n % 7) + 1) / 4, -((n % 5) + 1) / 8, -((n % 11) + 10) / 2
    probs = lambda *kv: F.create_map(*(F.lit(x) if isinstance(x, str) else x for x in kv))
    other = probs("maybe", a, "_no", b)
    said = F.when(m == 0, probs(" YES", a, "yes", c, " No", b)).when(m == 1, probs("Yes", a, " yes", b, "maybe", c)).when(m == 2, probs(" NO", a, "perhaps", c)).otherwise(other)
    at = F.when(m == 0, F.array(said, said, other)).when(m == 1, F.array(said, other, other)).when(m == 2, F.array(other, said, said)).otherwise(F.array(other, other))
    values = F.array(F.col("value") / 100, -F.col("value") / 100)
    return table(spark, sf, "events").select("event_id", F.round(fx.log_sum_exp(values), 6).alias("lse"), F.round(fx.answer_log_odds(said), 6).alias("odds"), fx.answer_position(at).alias("position"))


VECTORS = "x AS (SELECT p_partkey AS item_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM part JOIN embeddings ON vec_id = p_partkey % (SELECT count(*) FROM embeddings))"


@query(S + ", " + VECTORS + """, m AS (SELECT i, avg(x) AS mu FROM x WHERE item_id IN (SELECT item_id FROM train) GROUP BY 1), c AS (SELECT item_id, i, x - mu AS y FROM x JOIN m USING (i)), n AS (SELECT item_id, sqrt(sum(y * y)) AS norm FROM c GROUP BY 1)
SELECT item_id, round(sum(y / norm * i), 5) AS moment, round(min(y / norm), 6) AS low, round(max(y / norm), 6) AS high FROM c JOIN n USING (item_id) GROUP BY 1""")
def center_transform(spark, sf):
    """TXT-12, TXT-13: fitted on items with train rows, applied to all, at length one"""
    v = vectors(spark, sf)
    out = ct.apply_transform(v, ct.fit_transform(v.join(split(spark, sf).train.select("item_id").distinct(), "item_id", "left_semi"), "center"))
    moment = ct.dot(F.col("v"), F.sequence(F.lit(1), F.size("v")))  # within the row: no component is a row of its own
    return out.select("item_id", F.round(moment, 5).alias("moment"), F.round(F.array_min("v"), 6).alias("low"), F.round(F.array_max("v"), 6).alias("high"))


@query("WITH " + VECTORS + ", p AS (SELECT item_id % 100 AS item_id, i, sum(x * (1 + item_id % 3)) AS y FROM x GROUP BY 1, 2), n AS (SELECT item_id, sqrt(sum(y * y)) AS norm FROM p GROUP BY 1) SELECT item_id, (i - 1)::INT AS i, round(y / norm, 6) AS x FROM p JOIN n USING (item_id)")
def pooled_windows(spark, sf):
    """TXT-14: length-weighted pooling of window vectors"""
    chunks = vectors(spark, sf).select((F.col("item_id") % 100).alias("item_id"), "v", (1 + F.col("item_id") % 3).cast("double").alias("weight"))
    return ct.pool_windows(chunks).select("item_id", F.posexplode("v").alias("i", "x")).select("item_id", "i", F.round("x", 6).alias("x"))


def _slots(text: str) -> str:
    """The default encoder as SQL over (id, text): id, slot and value of what isn't zero."""
    return f"""hw AS (SELECT id, CAST('0x' || md5(w)[1:8] AS BIGINT) AS h FROM (SELECT id, unnest(list_filter(string_split_regex(lower({text}), '\\s+'), lambda x: x <> '')) AS w FROM tx)),
hs AS (SELECT id, h % 64 AS slot, sum(CASE WHEN (h >> 16) & 1 = 1 THEN 1 ELSE -1 END) AS x FROM hw GROUP BY 1, 2), hn AS (SELECT id, sqrt(sum(x * x)) AS norm FROM hs GROUP BY 1)"""


@query("WITH tx AS (SELECT p_partkey AS id, p_name || '. ' || p_type AS text FROM part), " + _slots("'query: ' || text") + " SELECT id AS item_id, slot::INT AS slot, round(x / greatest(norm, 1e-12), 6) AS x FROM hs JOIN hn USING (id) WHERE x <> 0")
def encoded_texts(spark, sf):
    """TXT-16, TXT-17, FN-08, UDF-05: texts of an item joined, and a pluggable encoder with a prefix and its own batches"""
    text = items(spark, sf).select("item_id", fx.join_filled(". ", F.col("p_name"), F.lit(""), F.col("p_type")).alias("text"))
    out = ct.encode(text, ct.ENCODERS["hashing64-query"]).select("item_id", F.posexplode("v").alias("slot", "x")).where("x <> 0")
    return out.select("item_id", "slot", F.round("x", 6).alias("x"))


@query("WITH tx AS (SELECT p_partkey AS id, p_name AS text FROM part WHERE p_partkey % 4 <> 0), " + _slots("text") + " SELECT p_partkey AS item_id, p_partkey % 4 = 0 AS missing, round(coalesce(s, 0), 6) AS moment, 'hashing64' AS encoder, 1::BIGINT AS n_writes FROM part LEFT JOIN (SELECT id, sum(x / norm * (slot + 1)) AS s FROM hs JOIN hn USING (id) GROUP BY 1) ON id = p_partkey")
def embedding_store(spark, sf):
    """SRC-13, SRC-11: written once with what made it, read back beside the item list"""
    text = items(spark, sf).where("item_id % 4 <> 0").select("item_id", F.col("p_name").alias("text"))
    path, store = scratch_path(spark), ct.encode(text, ct.ENCODERS["hashing64"])
    writes = sum(ct.store_vectors(store, path, {"encoder": "hashing64"}) for _ in range(2))
    v = ct.aligned_vectors(items(spark, sf), spark.read.parquet(path), 64)
    moment = ct.dot(F.col("v"), F.sequence(F.lit(1), F.lit(64)))
    return v.select("item_id", "missing", F.round(moment, 6).alias("moment"), F.lit(read_stats(spark, path)["encoder"]).alias("encoder"), F.lit(writes).cast("long").alias("n_writes"))


#: A text a section of an item: its name, type and brand under the three headings.
_DESCRIBED = "SELECT p_partkey AS item_id, p_name AS a, p_type AS b, p_brand AS c FROM part WHERE p_partkey % 5 <> 0"


def _described(spark, sf):
    """(item_id, text): descriptions with three headings; a fifth of the items has none.  They are dealt over all cores, as the table may be one file part."""
    text = F.concat(F.col("p_name"), F.lit(" About the Author "), F.col("p_type"), F.lit(" Review "), F.col("p_brand"))
    return items(spark, sf).where("item_id % 5 <> 0").select("item_id", text.alias("text")).repartition(3 * spark.sparkContext.defaultParallelism, "item_id")


@query(f"""WITH d AS ({_DESCRIBED}), tx AS (SELECT item_id * 4 AS id, a AS text FROM d UNION ALL SELECT item_id * 4 + 1, 'About the Author. ' || b FROM d UNION ALL SELECT item_id * 4 + 2, 'Review. ' || c FROM d), """ + _slots("text") + """,
z AS (SELECT id // 4 AS item_id, id % 4 AS g, sum(x / norm * (slot + 1)) AS m FROM hs JOIN hn USING (id) GROUP BY 1, 2)
SELECT p_partkey AS item_id, round(coalesce(max(m) FILTER (g = 1), 0), 6) AS author_bio, round(coalesce(max(m) FILTER (g = 2), 0), 6) AS editorial_review, round(coalesce(max(m) FILTER (g = 0), 0), 6) AS jacket_copy, (3 - count(m))::INT AS missing FROM part LEFT JOIN z ON z.item_id = p_partkey GROUP BY 1""")
def section_vectors(spark, sf):
    """SRC-12: a vector a section, beside the item list, zeros where a section lacks"""
    parts = _described(spark, sf).select("item_id", F.explode(fx.sections("text")).alias("section", "text"))
    vectors_ = ct.pool_windows(ct.encode_windows(parts, ct.ENCODERS["hashing64"], ["item_id", "section"]), ["item_id", "section"])
    wide = ct.section_vectors(items(spark, sf), vectors_, list(fx.SECTIONS), 64)
    return wide.select("item_id", *(F.round(ct.dot(F.col(g), F.sequence(F.lit(1), F.lit(64))), 6).alias(g) for g in fx.SECTIONS), "missing")


#: Squared lengths of the dense and sparse parts before the joint length, by the weights of the blocks that an item has.
SPACES_SQL = S + TERMS + """, sp AS (SELECT item_id, role, CASE role WHEN 'taxonomy' THEN 0.25 ELSE 1.0 END AS q FROM (SELECT DISTINCT item_id, role FROM terms JOIN space USING (role, term)) WHERE role <> 'title'),
sq AS (SELECT item_id, sum(q) AS s FROM sp GROUP BY 1), m AS (SELECT unnest(['tfidf', 'chunked', 'pooled', 'sections']) AS mode)
SELECT mode, count(*) AS n, round(sum(CASE WHEN t > 0 THEN dq / t ELSE 0 END), 3) AS dense_mass, max(width)::INT AS width, count(*) FILTER (t > 0) AS n_filled FROM (
  SELECT mode, p_partkey, CASE WHEN mode = 'tfidf' THEN 2.0 ELSE 2.0 + CASE WHEN p_partkey % 5 <> 0 THEN 0.25 ELSE 0 END END AS dq, dq + coalesce(s, 0) AS t,
  CASE mode WHEN 'tfidf' THEN 64 WHEN 'sections' THEN 256 ELSE 128 END AS width FROM m CROSS JOIN part LEFT JOIN sq ON item_id = p_partkey) GROUP BY 1"""


@query(SPACES_SQL)
def description_modes(spark, sf):
    """TXT-15: the space of every mode, with the share of its mass that is dense: reviews keep their weight in each"""
    s = split(spark, sf)
    name = items(spark, sf)
    blank = F.lit("").alias
    docs = name.select("item_id", F.col("p_name").alias("title"), F.lower("p_brand").alias("creator"), F.col("p_type").alias("taxonomy"), blank("blurb"), blank("reviews"))
    warm, out = s.train.select("item_id").distinct(), None
    for mode in ct.MODES:
        rows = ct.build_space(docs, _described(spark, sf), warm, ct.ENCODERS["hashing64"], mode)
        mass = ct.dot(F.col("v"), F.col("v"))
        one = rows.agg(F.lit(mode).alias("mode"), F.count("*").alias("n"), F.round(F.sum(mass), 3).alias("dense_mass"), F.max(F.size("v")).alias("width"), F.count_if(mass > 0).alias("n_filled"))
        out = one if out is None else out.unionByName(one)
    return out


@query(S + TERMS.replace("words AS (SELECT item_id, 'title' AS role, unnest(list_filter(regexp_extract_all(lower(title), '\\w\\w+'), lambda w: NOT list_contains(" + STOPS + ", w))) AS term FROM doc)", "words AS (SELECT item_id, 'title' AS role, unnest(list_transform(range(1, greatest(length(title) - 2, 0) + 1), lambda i: lower(title)[i:i + 2])) AS term FROM doc)") + "SELECT item_id, role, term, tf FROM terms")
def analyzer_terms(spark, sf):
    """UDF-04: another analyzer for one role, here character trigrams"""
    cut = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(F.lower(c), i, 3))
    docs = items(spark, sf).select("item_id", F.col("p_name").alias("title"), F.lower("p_brand").alias("creator"), F.col("p_type").alias("taxonomy"))
    return ct.role_terms(docs, ROLES, {"title": cut})


GRID = ", g AS (SELECT p, r FROM (SELECT unnest([0.5, 1.0, 1.5, 2.0]) AS p) CROSS JOIN (SELECT unnest([0.0, 0.25, 0.5, 1.0]) AS r))"


@query(S + TERMS + ROWS + GRID + """, one AS (SELECT item_id, role, term, x / sqrt(sum(x * x) OVER (PARTITION BY item_id, role)) AS u FROM raw),
y AS (SELECT p, r, item_id, role, term, u * CASE role WHEN 'title' THEN p WHEN 'taxonomy' THEN r ELSE 1 END AS y FROM one CROSS JOIN g), z AS (SELECT p, r, item_id, role, term, y / sqrt(sum(y * y) OVER (PARTITION BY p, r, item_id)) AS w FROM y WHERE y <> 0),
near AS (SELECT a.p, a.r, a.item_id AS source_id, b.item_id, sum(a.w * b.w) AS score FROM z a JOIN z b ON a.p = b.p AND a.r = b.r AND a.role = b.role AND a.term = b.term AND a.item_id <> b.item_id WHERE a.item_id IN (FROM cold_test) GROUP BY 1, 2, 3, 4),
best AS (SELECT p, r, source_id, max(score) AS score FROM near GROUP BY 1, 2, 3) SELECT p, r, round(avg(score), 6) AS objective, row_number() OVER (ORDER BY round(avg(score), 6) DESC, p, r) <= 2 AS verified FROM best GROUP BY 1, 2""")
def weight_grid(spark, sf):
    """TUNE-04, TUNE-07: four by four weights of prose and taxonomy over role blocks that are written once; each line of the grid is kept, and the two best points are marked.
    A point's objective is the mean score of the cold items' nearest neighbours"""
    s = split(spark, sf)
    terms, space = _space(spark, sf, s)
    one = materialise(ct.transform(terms, space, dict.fromkeys(ROLES, 1.0), normalise=False))
    held, out = Checkpoint(spark, scratch_path(spark), {"blocks": "title, creator, taxonomy"}), None

    def objectives(p):
        line = None
        for r in (0.0, 0.25, 0.5, 1.0):
            rows = bl.packed(ct.reweighted(one, {"title": p, "creator": 1.0, "taxonomy": r}), "item_id")
            point = ct.neighbours(rows, s.cold_ids, 1).agg(F.lit(p).alias("p"), F.lit(r).alias("r"), F.round(F.avg("score"), 6).alias("objective"))
            line = point if line is None else line.unionByName(point)
        return line

    for p in (0.5, 1.0, 1.5, 2.0):
        line = held.get(f"p={p}", lambda p=p: objectives(p))
        out = line if out is None else out.unionByName(line)
    best = F.row_number().over(Window.orderBy(F.desc("objective"), "p", "r")) <= 2  # over the points of the grid
    return out.withColumn("verified", best)
