"""Queries of the library's own operators over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from switchback.functions import citations as C, text as X, validate as V
from switchback.functions.vectors import cosine
from switchback.operators import anomaly, catalog, review, scoring, search, sections, vectors
from switchback.plans.agent import permit_tool, trail_tools
from switchback.plans.providers import AUDIENCES, MODES, FakeProvider, cited_answers, compared, embedded, gated_replies, replies, structured, summary_prompt
from switchback.sources import files
from switchback.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def trails(spark: SparkSession, d: str) -> DataFrame:
    """A row per trail: repeated rows are equal."""
    return table(spark, d, "trails").dropDuplicates(["id"])


def reviews(spark: SparkSession, d: str) -> DataFrame:
    """A row per review: repeated rows differ in their time of arrival only."""
    return table(spark, d, "hard").select("id", "product", "rating", "text").dropDuplicates(["id"])


def inquiries(spark: SparkSession, d: str) -> DataFrame:
    """A row per message: repeated rows differ in their time of arrival only."""
    return table(spark, d, "inquiries").select("id", "category", "text").dropDuplicates(["id"])


def working_folder(spark: SparkSession, name: str) -> str:
    import uuid

    from switchback.plans.lineage import shared_folder

    return f"{shared_folder(spark)}/switchback/{name}-{uuid.uuid4().hex}"


def six(c) -> F.Column:
    return F.round(c, 6)


TRAILS = "t as (select id, any_value(name) as name, any_value(park) as park, any_value(distance_mi) as distance_mi, any_value(elevation_ft) as elevation_ft, any_value(difficulty) as difficulty, any_value(features) as features, any_value(description) as description from (select distinct * from trails) group by id)"
REVIEWS = "r as (select id, min(product) as product, min(rating) as rating, min(text) as text from hard group by id)"
INQUIRIES = "i as (select id, min(category) as category, min(text) as text from inquiries group by id)"
E = "e as (select vec_id as id, embedding::double[] as v, label from embeddings)"


@query(f"with {E} select 0 as query_id, e.id as id, round(list_cosine_similarity(e.v, q.v), 6) as score from e, e q where q.id = 0 and e.id <> 0 order by list_cosine_similarity(e.v, q.v) desc, e.id limit 5")
def vector_topk(spark, d):
    return vectors.top_k(items(spark, d), 0).select(F.col("query_id").cast("int"), "id", six(F.col("score")).alias("score"))


@query(f"with {E}, q as (select min(id) as qid from e group by label), s as (select q.qid as query_id, e.id as id, list_cosine_similarity(e.v, w.v) as score from e, q, e w where w.id = q.qid and e.id <> q.qid), k as (select *, row_number() over w as rank, score - lead(score) over w as margin from s window w as (partition by query_id order by score desc, id)) select query_id, id, round(score, 6) as score, rank, round(margin, 6) as margin from k where rank <= 5")
def vector_topk_per_label(spark, d):
    e = items(spark, d)
    firsts = e.groupBy("label").agg(F.min("id").alias("id")).select("id")
    asked = e.join(firsts, "id").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    return vectors.top_k_per_query(e, asked).select("query_id", "id", six(F.col("score")).alias("score"), "rank", six(F.col("margin")).alias("margin"))


@query(f"with {E}, s as (select q.id as query_id, e.id as id, list_cosine_similarity(e.v, q.v) as score from e, e q where q.id % 100 = 0 and e.id <> q.id), k as (select *, row_number() over w as rank from s window w as (partition by query_id order by score desc, id)) select query_id, id, round(score, 6) as score, rank from k where rank <= 5")
def vector_topk_hundredth(spark, d):
    """Every row whose id is divisible by 100, against all rows."""
    e = items(spark, d)
    asked = e.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    return vectors.top_k_per_query(e, asked).select("query_id", "id", six(F.col("score")).alias("score"), "rank")


@query(f"with {E} select e.id as id, round(list_cosine_similarity(e.v, q.v), 6) as score from e, e q where q.id = 3 and e.id <> 3 and e.label in (1, 2, 3) and list_cosine_similarity(e.v, q.v) >= 0.1 order by list_cosine_similarity(e.v, q.v) desc, e.id limit 5")
def metadata_filtered_topk(spark, d):
    e = items(spark, d)
    return vectors.top_k(e, 3, where=F.col("label").isin(1, 2, 3), least=0.1).select("id", six(F.col("score")).alias("score"))


@query(f"with {E}, x as (select label, generate_subscripts(v, 1) - 1 as pos, unnest(v) as x from e), m as (select label, pos, avg(x) as x from x group by all), n as (select label, sqrt(sum(x * x)) as n from m group by label) select label, pos::int as pos, round(x / n, 6) as x from m join n using (label)")
def centroid_per_label(spark, d):
    return vectors.centroids(items(spark, d), "label").select("label", F.posexplode("centroid").alias("pos", "x")).select("label", "pos", six(F.col("x")).alias("x"))


DIST = f"{E}, u as (select id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as v from e), x as (select label, generate_subscripts(v, 1) as pos, unnest(v) as x from u), m as (select label, pos, avg(x) as x from x group by all), c as (select label, list(x order by pos) as c from m group by label), d as (select u.id, u.label, 1 - list_cosine_similarity(u.v, c.c) as distance from u join c using (label))"


@query(f"with {DIST}, s as (select label, avg(distance) as mean, stddev_pop(distance) as sd from d group by label) select id, label, round(distance, 6) as distance, round(mean + 1.5 * sd, 6) as threshold from d join s using (label) where distance > mean + 1.5 * sd")
def anomaly_distance(spark, d):
    rows = anomaly.flagged(vectors.distances(items(spark, d), "label"), "label", 1.5)
    return rows.select("id", "label", six(F.col("distance")).alias("distance"), six(F.col("threshold")).alias("threshold"))


@query(f"with {E} select a.label as group_a, b.label as group_b, round(avg(1 - list_cosine_similarity(a.v, b.v)), 5) as mean_distance from e a, e b where a.label <= b.label and a.id <> b.id group by all")
def pairwise_distance(spark, d):
    return vectors.pair_distances(items(spark, d), "label").select("group_a", "group_b", F.round("mean_distance", 5).alias("mean_distance"))


@query(f"with {E}, x as (select generate_subscripts(v, 1) as pos, unnest(v) as x from e where id in (1, 2)), m as (select pos, avg(x) as x from x group by pos), q as (select list(x order by pos) as q from m) select id, round(list_cosine_similarity(v, q), 6) as score from e, q where id not in (1, 2) order by list_cosine_similarity(v, q) desc, id limit 5")
def taste_vector_topk(spark, d):
    return vectors.taste(items(spark, d), [1, 2]).select("id", six(F.col("score")).alias("score"))


@query(f"with {DIST}, s as (select label, avg(distance) as mean, stddev_pop(distance) as sd from d group by label) select id, rpad(id::varchar, 20, ' ') || lpad(printf('%.4f', distance), 10, ' ') || lpad(printf('%.4f', mean + 1.5 * sd), 10, ' ') || '  over by' || lpad(printf('%.4f', distance - mean - 1.5 * sd), 10, ' ') as line from d join s using (label) where distance > mean + 1.5 * sd")
def anomaly_report(spark, d):
    return anomaly.report(anomaly.flagged(vectors.distances(items(spark, d), "label"), "label", 1.5))


@query("select vec_id as id from embeddings order by md5('0:' || vec_id), vec_id limit 5")
def random_baseline(spark, d):
    return catalog.random_baseline(items(spark, d).select("id"))


WORDS = ("shaded", "loop", "creek")


@query(f"with {TRAILS}, h as (select id, {' + '.join(f'''regexp_matches(lower(coalesce(name, '') || ' ' || coalesce(description, '')), '\\b{w}\\b')::int''' for w in WORDS)} as hits from t) select id, hits from h where hits > 0 order by hits desc, id limit 5")
def keyword_search(spark, d):
    t = trails(spark, d).select("id", F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("description", F.lit(""))).alias("text"))
    return search.keyword_rank(t, "shaded loop creek")


STOPS = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
TOKENS = f"list_transform(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 2 and x not in ({STOPS})), lambda x: case when length(x) > 3 and x like '%s' and x not like '%ss' then x[:-2] else x end)"


@query(f"with k as (select unnest({TOKENS}) as token from documents where text is not null) select token, count(*) as n from k group by token")
def tokenize_counts(spark, d):
    return table(spark, d, "documents").select(F.explode(X.search_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


TERMS = ("shuttle", "permit", "foggy")
BM25 = (
    f"k as (select doc_id as id, coalesce({TOKENS}, []) as t from documents), s as (select count(*) as n, avg(len(t)) as mean, "
    + ", ".join(f"count(*) filter (list_contains(t, '{w}')) as df{i}" for i, w in enumerate(TERMS))
    + " from k), f as (select id, len(t) as l, "
    + ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) as tf{i}" for i, w in enumerate(TERMS))
    + " from k), b as (select id, "
    + " + ".join(f"case when tf{i} > 0 then ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (1 - 0.3 + 0.3 * l / mean)) else 0 end" for i in range(len(TERMS)))
    + " as score from f, s)"
)
ASKED = "Where is the shuttle permit for a foggy day?".replace("day", "")


@query(f"with {BM25} select id, round(score, 6) as score from b order by score desc, id limit 10")
def bm25_topk(spark, d):
    return search.bm25(table(spark, d, "documents"), ASKED, id_col="doc_id").orderBy(F.desc("score"), "id").limit(10).select("id", six(F.col("score")).alias("score"))


@query(f"with {BM25}, m as (select id, score, row_number() over w as rank, score - lead(score) over w as margin from b window w as (order by score desc, id)) select id, rank, round(margin, 6) as margin from m where rank <= 3")
def margin(spark, d):
    return search.ranked(search.bm25(table(spark, d, "documents"), ASKED, id_col="doc_id"), 3, by="score").select("id", "rank", six(F.col("margin")).alias("margin"))


@query(f"with {BM25}, top as (select id, row_number() over (order by score desc, id) as r from b order by r limit 3) select md5(string_agg('chunk_id:' || doc_id || chr(10) || 'source:' || coalesce(source, 'null') || chr(10) || text, chr(10) || chr(10) order by r)) as digest from top join documents on doc_id = id")
def context_assembly(spark, d):
    docs = table(spark, d, "documents")
    top = search.ranked(search.bm25(docs, ASKED, id_col="doc_id"), 3, by="score").select("id", "rank")
    hits = top.join(docs.select(F.col("doc_id").alias("id"), "source", "text"), "id").withColumn("id", F.col("id").cast("string"))
    return search.context(hits).select(F.md5("context").alias("digest"))


UNIT = "(1.0 if i % 2 else -1.0)"
QUERY_VECTOR = [1.0 if i % 3 == 0 else -0.5 for i in range(64)]
VEC = "v as (select id, any_value(vector)::double[] as v from trail_vectors where vector is not null and len(vector) = 64 and len(list_filter(vector, lambda x: isnan(x) or x is null)) = 0 and len(list_filter(vector, lambda x: x <> 0)) > 0 group by id)"
T25 = TOKENS.replace("lower(text)", "lower(description)")
HYBRID = (
    f"{TRAILS}, {VEC}, k as (select id, coalesce({T25}, []) as t from t), s as (select count(*) as n, avg(len(t)) as mean, count(*) filter (list_contains(t, 'birch')) as df from k), "
    "lx as (select id, case when len(list_filter(t, lambda x: x = 'birch')) > 0 then ln(1 + (n - df + 0.5) / (df + 0.5)) * len(list_filter(t, lambda x: x = 'birch')) * 2.2 / (len(list_filter(t, lambda x: x = 'birch')) + 1.2 * (1 - 0.3 + 0.3 * len(t) / mean)) else 0 end as lexical from k, s), "
    f"sm as (select id, list_cosine_similarity(v, {QUERY_VECTOR}::double[]) as c from v), "
    "a as (select id, (c - min(c) over ()) / (max(c) over () - min(c) over ()) as sn from sm), b as (select id, (lexical - min(lexical) over ()) / (max(lexical) over () - min(lexical) over ()) as ln from lx)"
)


def usable_vectors(spark, d):
    v = F.col("vector")
    fine = table(spark, d, "trail_vectors").where((F.size(v) == 64) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(v, lambda x: x != 0))
    return fine.groupBy("id").agg(F.first("vector").alias("vector"))


@query(f"with {HYBRID} select id, round(0.6 * sn + 0.4 * ln, 6) as combined from a join b using (id) order by 0.6 * sn + 0.4 * ln desc, id limit 10")
def hybrid_topk(spark, d):
    docs = trails(spark, d).select("id", F.col("description").alias("text"))
    hits = search.hybrid(docs, usable_vectors(spark, d), "birch", QUERY_VECTOR)
    return search.ranked(hits, 10).select("id", six(F.col("combined")).alias("combined"))


@query(f"with {HYBRID}, h as (select id, sn, ln from a join b using (id)), g as (select unnest([0.0, 0.25, 0.5, 0.75, 1.0])::double as alpha), c as (select alpha, id, alpha * sn + (1 - alpha) * ln as combined from h, g), o as (select *, row_number() over w as rank, combined - lead(combined) over w as margin from c window w as (partition by alpha order by combined desc, id)), want as (select id from t where contains(description, 'birch') and lower(difficulty) = 'easy') select alpha, coalesce(max((id in (select id from want))::int), 0)::double as recall, round(max(margin) filter (rank = 1), 6) as mean_margin from o where rank <= 3 group by alpha")
def alpha_sweep(spark, d):
    rows = trails(spark, d)
    hits = search.hybrid(rows.select("id", F.col("description").alias("text")), usable_vectors(spark, d), "birch", QUERY_VECTOR).withColumn("question", F.lit(1))
    # what is wanted does not depend on any ranking: easy trails whose description names the tree
    wanted = rows.where(F.contains("description", F.lit("birch")) & (F.lower("difficulty") == "easy")).select(F.lit(1).alias("question"), "id")
    return search.recall_at_k(hits, wanted, [0.0, 0.25, 0.5, 0.75, 1.0], 3).select("alpha", "recall", six(F.col("mean_margin")).alias("mean_margin"))


@query(f"with {TRAILS}, s as (select min(distance_mi) as lo, max(distance_mi) as hi from t) select id, round((distance_mi - lo) / (hi - lo), 6) as norm from t, s")
def min_max_distance(spark, d):
    return search.min_max(trails(spark, d).select("id", "distance_mi"), "distance_mi").select("id", six(F.col("norm")).alias("norm"))


@query(f"with {REVIEWS} select product, md5(string_agg(text, chr(10) order by id)) as digest, count(*) as reviews from r where text is not null group by product")
def group_concat(spark, d):
    return catalog.concatenated(reviews(spark, d)).select("product", F.md5("text").alias("digest"), "reviews")


@query(f"with {REVIEWS}, n as (select id, product, ' ' || trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ' as x from r where text is not null and product is not null), p as (select distinct product as other from r where product is not null) select product, other, count(distinct id) as mentions from n join p on product <> other and contains(x, ' ' || lower(other) || ' ') group by all")
def co_mention(spark, d):
    return catalog.co_mentions(reviews(spark, d))


RULE = "case when distance_mi >= 12 or elevation_ft >= 3000 then 'hard' when distance_mi >= 5 then 'moderate' else 'easy' end"
LABEL = "lower(difficulty)"


def predicted(spark, d, swap: bool = False):
    rule = F.expr(RULE if not swap else RULE.replace("12", "10"))
    rows = trails(spark, d).where("difficulty is not null")
    preds = rows.select("id", rule.alias("predicted"))
    return scoring.labelled(preds, rows.select("id", F.lower("difficulty").alias("label"), "park"))


@query(f"with {TRAILS} select park, count(*) filter ({RULE} = {LABEL}) as correct, count(*) as rows from t where difficulty is not null group by park")
def label_accuracy(spark, d):
    return scoring.accuracy(predicted(spark, d), "park")


@query(f"with {TRAILS} select case when distance_mi < 5 then 'short' else 'long' end as set, count(*) filter ({RULE} = {LABEL}) as correct, count(*) as rows from t where difficulty is not null and distance_mi is not null group by all")
def accuracy_by_set(spark, d):
    """Two labelled sets with their names, together."""
    rows = trails(spark, d).where("difficulty is not null and distance_mi is not null").select("id", F.expr(RULE).alias("predicted"), F.lower("difficulty").alias("label"), "distance_mi")
    return scoring.accuracy(scoring.union_of({"short": rows.where("distance_mi < 5"), "long": rows.where("distance_mi >= 5")}), "set")


@query(f"with {TRAILS} select count(*) filter ({RULE} = {LABEL}) as correct, count(*) as rows from t where difficulty is not null")
def global_accuracy(spark, d):
    return scoring.accuracy(predicted(spark, d))


@query(f"with {TRAILS} select count(*) filter ({RULE} = 'hard' and {LABEL} = 'hard') as caught, count(*) filter ({LABEL} = 'hard') as actual, count(*) filter ({RULE} = 'hard' and {LABEL} <> 'hard') as false_alarms from t where difficulty is not null")
def class_recall(spark, d):
    return scoring.class_recall(predicted(spark, d), "hard")


@query(f"with {TRAILS} select id, {RULE} as predicted, {RULE.replace('12', '10')} as other from t where difficulty is not null and {RULE} <> {RULE.replace('12', '10')}")
def disagreements(spark, d):
    return scoring.disagreements(predicted(spark, d).select("id", "predicted"), predicted(spark, d, True).select("id", "predicted"))


@query(f"with {INQUIRIES} select lane, count(*) as rows from (select case when category in ('trail-condition', 'permit', 'complaint', 'general', 'lost-and-found') then 'draft-for-approval' else 'human-only' end as lane from i) group by lane")
def policy_routing(spark, d):
    return review.with_lane(inquiries(spark, d)).groupBy("lane").agg(F.count("*").alias("rows"))


QUEUES = {"permit": "permits desk", "emergency": "dispatch", "complaint": "supervisor", "trail-condition": "trail crew", "lost-and-found": "front desk"}


@query(f"with {INQUIRIES} select queue, count(*) as rows from (select case category " + " ".join(f"when '{a}' then '{b}'" for a, b in QUEUES.items()) + " else 'front desk' end as queue from i) group by queue")
def queue_routing(spark, d):
    return scoring.routed(inquiries(spark, d), QUEUES, "front desk").groupBy("queue").agg(F.count("*").alias("rows"))


@query(f"with {INQUIRIES} select id, row_number() over (order by coalesce(category = 'emergency', false) desc, id) as rank from i")
def priority_sort(spark, d):
    return scoring.priority_ranks(inquiries(spark, d).select("id", "category"), "id").select("id", "rank")


@query(f"with {INQUIRIES}, l as (select id, category, coalesce(text, '') as draft, category in ('trail-condition', 'permit', 'complaint', 'general', 'lost-and-found') as may from i) select decision, count(*) as rows, sum(ed) as edits from (select case when not coalesce(may, false) then 'human-only' when upper(draft) like 'ESCALATE%' then 'escalated' when ends_with(id, '1') then 'approved' when ends_with(id, '2') then 'rejected' when ends_with(id, '3') then 'edited' else 'skipped' end as decision, case when coalesce(may, false) and upper(draft) not like 'ESCALATE%' and ends_with(id, '1') then 0 when coalesce(may, false) and upper(draft) not like 'ESCALATE%' and ends_with(id, '3') then 9 else length(draft) end as ed from l) group by decision")
def review_decisions(spark, d):
    rows = review.with_lane(inquiries(spark, d)).withColumn("draft", F.coalesce("text", F.lit("")))
    said = F.when(F.endswith("id", F.lit("1")), "approved").when(F.endswith("id", F.lit("2")), "rejected").when(F.endswith("id", F.lit("3")), "edited")
    verdicts = rows.select("id", said.alias("decision"), F.concat("draft", F.lit(" (edited)")).alias("edited"))
    return review.decided(rows, verdicts, "driver").groupBy("decision").agg(F.count("*").alias("rows"), F.sum("edit_distance").alias("edits"))


@query(f"with {INQUIRIES}, l as (select id, text, case when category in ('trail-condition', 'permit', 'complaint', 'general', 'lost-and-found') then 'draft-for-approval' else 'human-only' end as lane from i) select id, lane, case when lane = 'draft-for-approval' then md5(left('Answer as the ranger on duty.' || chr(10) || chr(10) || 'Draft a reply:' || chr(10) || coalesce(text, ''), 80)) end as draft from l")
def gated_drafts(spark, d):
    rows = review.with_lane(inquiries(spark, d)).select("id", "category", "lane", "text")
    may, _ = review.gate(rows)
    drafted = gated_replies(rows, may.select("id", F.concat(F.lit("Draft a reply:\n"), F.coalesce("text", F.lit(""))).alias("prompt")), FakeProvider(), system="Answer as the ranger on duty.")
    return drafted.select("id", "lane", F.md5("draft").alias("draft"))


@query(f"with {INQUIRIES} select id || '.txt' as name, md5(text || chr(10)) as digest from i where category in ('trail-condition', 'permit', 'complaint', 'general', 'lost-and-found') and ends_with(id, '1') and upper(coalesce(text, '')) not like 'ESCALATE%' and text is not null")
def outbox_files(spark, d):
    """Approved messages written as files, and read again as whole texts."""
    rows = review.with_lane(inquiries(spark, d)).where("text is not null").withColumn("draft", F.col("text"))
    audit = review.decided(rows, rows.select("id", F.when(F.endswith("id", F.lit("1")), "approved").alias("decision"), F.lit(None).cast("string").alias("edited")), "driver")
    folder = working_folder(spark, "outbox")
    review.write_outbox(audit, folder.removeprefix("file://"))
    return files.whole_texts(spark, folder, "*.txt").select("name", F.md5("text").alias("digest"))


@query(f"with {INQUIRIES} select case when category is null or category = 'general' then '(none on file for this message)' else upper(category) end as snippet, count(*) as rows from i group by all")
def snippet_lookup(spark, d):
    rows = inquiries(spark, d).withColumn("doc", F.concat("category", F.lit(".md")))
    snippets = rows.where("category <> 'general'").select("doc", "category").distinct().select(F.col("doc").alias("name"), F.upper("category").alias("text"))
    return files.with_snippet(rows, snippets).groupBy("snippet").agg(F.count("*").alias("rows"))


@query(f"with {TRAILS} select id, name, distance_mi, elevation_ft, len(features) as features, md5(description) as digest from t")
def json_lines_table(spark, d):
    """Trails written as JSON lines and read again."""
    path = working_folder(spark, "lines")
    files.write_json_lines(trails(spark, d).select([x.split()[0] for x in files.TRAIL.split(", ")]), path)
    back = files.json_lines(spark, path, files.TRAIL)
    return back.select("id", "name", "distance_mi", "elevation_ft", F.when(F.col("features").isNotNull(), F.size("features")).cast("long").alias("features"), F.md5("description").alias("digest"))


def one_text(spark, rows, path: str) -> str:
    """A small table's lines as one file."""
    rows.coalesce(1).write.text(path)
    return path


@query(f"with {TRAILS} select park, count(*) as trails from t where park is not null group by park")
def json_array_table(spark, d):
    parks = trails(spark, d).where("park is not null").groupBy("park").agg(F.count("*").alias("trails"))
    text = parks.agg(F.concat(F.lit("[\n"), F.array_join(F.sort_array(F.collect_list(F.to_json(F.struct("park", "trails")))), ",\n"), F.lit("\n]")).alias("value"))
    return files.json_array(spark, one_text(spark, text, working_folder(spark, "array")), "park string, trails long")


def keyed_parks(spark, d) -> DataFrame:
    """Parks as keys of one JSON object, beside a comment of another type, read as ``(key, pos, value)``."""
    parks = trails(spark, d).where("park is not null").groupBy("park").agg(F.count("*").alias("trails"))
    pair = F.concat(F.to_json(F.struct(F.col("park").alias("k"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("park").alias("k")))) - 6), F.lit(": "), F.to_json(F.struct("trails")))
    text = parks.agg(F.concat(F.lit('{"_comment": "not a park",\n'), F.array_join(F.sort_array(F.collect_list(pair)), ",\n"), F.lit("\n}")).alias("value"))
    return files.keyed_json(spark, one_text(spark, text, working_folder(spark, "keyed")), "struct<trails:long>")


@query(f"with {TRAILS} select park as key, count(*) as trails from t where park is not null group by park")
def keyed_json_table(spark, d):
    return keyed_parks(spark, d).select("key", "value.trails")


@query(f"with {TRAILS} select park, count(*) as trails from t where park in (select min(park) from t where park is not null) group by park")
def tool_weather(spark, d):
    """The lookup tools answer by park, from keyed JSON; asked for in capitals, and for nothing."""
    keyed = keyed_parks(spark, d)
    tools = trail_tools(trails(spark, d), table(spark, d, "condition_reports"), keyed, keyed)
    first = trails(spark, d).agg(F.min("park")).first()[0]
    said = [tools["get_weather"](park=first.upper()), tools["check_campsites"](park="null")]
    return spark.createDataFrame([(r["park"], r["value"]["trails"]) for r in said if "error" not in r], "park string, trails long")


@query("with c as (select id, any_value(trail_id) as trail_id, any_value(date) as date from condition_reports group by id) select id, row_number() over (order by date desc nulls last, id) as rank from c where trail_id = 'trail-00000117' order by rank limit 4")
def tool_conditions(spark, d):
    reports = table(spark, d, "condition_reports").select("id", "trail_id", "date").dropDuplicates(["id"])
    said = trail_tools(trails(spark, d), reports, None, None)["get_trail_conditions"](trail="trail-00000117")
    return spark.createDataFrame([(r["id"], r["rank"]) for r in said], "id string, rank int").withColumn("rank", F.col("rank").cast("long"))


@query("select * from (values (1, 'submitted', 1), (2, 'submitted', 1), (3, 'cancelled', 1), (4, '2 permits left in Lorin on 2026-09-16', 1), (5, 'a park and a date are needed', 1), (6, '0 permits left in Nowhere on 2026-09-16', 1)) x(request, answer, submitted)")
def permit_requests(spark, d):
    """Permits behind a person's yes: the same request twice is carried out once, a refusal cancels, checks come first."""
    done: dict[str, dict] = {}
    tool = permit_tool({"Lorin Park": {"2026-09-16": 2}}, {"status": "submitted"}, lambda args: args["party_size"] < 2, done)
    asked = [("Lorin", "2026-09-16", 1), ("Lorin", "2026-09-16", 1), ("lorin", "2026-09-16", 2), ("Lorin", "2026-09-16", 3), ("string", None, 1), ("Nowhere", "2026-09-16", 1)]
    said = [tool(park=p, date=x, party_size=n) for p, x, n in asked]
    return spark.createDataFrame([(k, r.get("status") or r["error"], len(done)) for k, r in enumerate(said, 1)], "request int, answer string, submitted int")


@query(f"with {INQUIRIES} select id, category is not null and lower(trim(category)) not in ('', 'null', 'string') as given from i")
def missing_arguments(spark, d):
    return inquiries(spark, d).select("id", V.given(F.col("category")).alias("given"))


@query(f"with {TRAILS} select id, description is null or regexp_replace(description, '^\\s+|\\s+$', '', 'g') <> '' as passed from t")
def blank_texts(spark, d):
    return trails(spark, d).select("id", V.text_verdict(F.col("description"))["passed"].alias("passed"))


@query(f"with {TRAILS}, w as (select id, ends_with(id, '7') as unparsed, name, distance_mi, features, list_filter(regexp_split_to_array(regexp_replace(name, '[-,'']', ' ', 'g'), '\\s+'), lambda x: length(x) >= 4 and lower(x) not in ({', '.join(quoted(x) for x in V.BOILERPLATE)})) as ws, lower(coalesce(description, '')) as src from t) select id, unparsed, unparsed or distance_mi is null or (distance_mi > 0 and distance_mi <= 100) as miles_ok, unparsed or name is null or (trim(name) <> '' and case when len(ws) > 0 then len(list_filter(ws, lambda x: not contains(src, lower(x)))) = 0 else contains(src, lower(trim(name))) end) as grounded, case when unparsed then 0 else len(list_filter(list_transform(coalesce(features, []), lambda x: trim(x)), lambda x: x is not null and x <> '')) end as hazards from w")
def structured_extraction(spark, d):
    """Facts asked of a model as JSON, parsed, and validated field by field; every tenth reply is broken off."""
    rows = trails(spark, d)
    facts = F.to_json(F.struct(F.col("name").alias("trail_name"), "distance_mi", F.col("features").alias("hazards")))
    prompts = rows.select("id", F.when(F.endswith("id", F.lit("7")), F.substring(facts, 1, 12)).otherwise(facts).alias("prompt"))
    read = structured(replies(prompts, FakeProvider(reply=lambda p: p)), files.FACTS)
    both = read.join(rows.select("id", "description"), "id")
    miles, named = V.range_verdict(F.col("record.distance_mi"), V.MAX_MILES), V.grounded_verdict(F.col("record.trail_name"), F.coalesce("description", F.lit("")))
    return both.select("id", "unparsed", miles["passed"].alias("miles_ok"), named["passed"].alias("grounded"), F.size(V.clean_list(F.col("record.hazards"))).cast("long").alias("hazards"))


@query("with c as (select id, min(trail_id) as trail_id, min(ingested_at) as ingested_at from condition_reports group by id) select trail_id, id, rank from (select trail_id, id, row_number() over (partition by trail_id order by ingested_at desc nulls last, id) as rank from c where trail_id is not null) where rank <= 4")
def latest_reports(spark, d):
    c = table(spark, d, "condition_reports").groupBy("id", "trail_id").agg(F.min("ingested_at").alias("ingested_at")).where("trail_id is not null")
    return catalog.latest(c, "trail_id", "ingested_at").select("trail_id", "id", "rank")


GAPS = "e as (select event_id, user_id, ts::date as date from events where event_type = 'error'), n as (select *, coalesce((date_diff('day', lag(date) over w, date) > 3)::int, 1) as fresh from e window w as (partition by user_id order by date, event_id)), g as (select *, sum(fresh) over (partition by user_id order by date, event_id rows unbounded preceding) as cluster from n)"


def error_clusters(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'").select("event_id", "user_id", F.to_date("ts").alias("date"))
    return anomaly.gap_clusters(e, "user_id", days=3)


@query(f"with {GAPS} select event_id, user_id, cluster::bigint as cluster from g")
def gap_clusters(spark, d):
    return error_clusters(spark, d).select("event_id", "user_id", F.col("cluster").cast("long").alias("cluster"))


@query(f"with {GAPS} select user_id, cluster::bigint as cluster, count(*) as size, min(date) as first, max(date) as last, count(*) >= 2 as alert from g group by user_id, cluster")
def cluster_alerts(spark, d):
    return anomaly.alerts(error_clusters(spark, d), "user_id").withColumn("cluster", F.col("cluster").cast("long"))


@query("with b as (select user_id, avg(value) as mean, stddev_pop(value) as sd from events group by user_id), f as (select user_id, ts from events join b using (user_id) where value > mean + sd), n as (select *, coalesce((ts > lag(ts) over w + interval 1 day)::int, 1) as fresh from f window w as (partition by user_id order by ts)), g as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as s from n) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first, count(*) as size, count(*) >= 2 as alert from g group by user_id, s")
def stream_alerts(spark, d):
    """The streaming plan over the whole table, with the sessions that are open at its end."""
    from switchback.streaming.alerts import baseline_of, replayed, stream_alerts as plan

    events = table(spark, d, "events").select("user_id", "ts", "value")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "*").parquet(f"{d}/events*.parquet")
    out = replayed(plan(stream, baseline_of(events, "user_id"), "user_id", gap="1 day", late="1 hour"), working_folder(spark, "stream"))
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("first"), "size", "alert")


@query(f"with {REVIEWS}, x as (select id, regexp_extract(lower(text), '(positive|negative|mixed|stars|rated)', 1) as hit, text from r where text is not null) select id, case when regexp_extract(lower(text), '(positive|negative|mixed)', 1) <> '' then regexp_extract(lower(text), '(positive|negative|mixed)', 1) else 'other' end as label from x")
def earliest_label(spark, d):
    r = reviews(spark, d).where("text is not null").select("id", X.earliest_label(F.col("text")).alias("label"))
    return r.select("id", F.when(F.col("label").isin(*X.LABELS), F.col("label")).otherwise("other").alias("label"))


@query(f"with {TRAILS} select id, levenshtein(name, coalesce(park, '')) as distance from t where name is not null")
def edit_distance(spark, d):
    return trails(spark, d).where("name is not null").select("id", X.edit_distance(F.col("name"), F.col("park")).cast("long").alias("distance"))


@query("with c as (select chunk_id, any_value(text) as text from (select distinct chunk_id, text from chunks) where text is not null group by chunk_id) select chunk_id, len(list_filter(list_transform(regexp_extract_all(text || ' [' || chunk_id || ', x:1]', '\\[([^\\]]*:[^\\]]*)\\]', 1), lambda g: g), lambda g: true)) as groups, true as repaired from c")
def citation_groups(spark, d):
    c = table(spark, d, "chunks").where("text is not null").dropDuplicates(["chunk_id"])
    answer = F.concat("text", F.lit(" ["), "chunk_id", F.lit(", x:1]"))
    bad = C.invalid(answer, F.array(F.col("chunk_id")))
    fixed = C.stripped(answer, bad)
    groups = F.size(F.regexp_extract_all(answer, F.lit(C.PATTERN), F.lit(1))).cast("long")
    return c.select("chunk_id", groups.alias("groups"), (F.contains(fixed, F.lit(C.REMOVED)) & ~F.contains(fixed, F.lit(", x:1]"))).alias("repaired"))


DAY = "coalesce(" + ", ".join(f"try_strptime(x, '{f}')" for f in ("%Y-%m-%d", "%Y/%m/%d", "%m/%d/%Y", "%B %d, %Y", "%b %d, %Y", "%d %B %Y", "%B %d %Y")) + ")"


@query(f"with c as (select id, min(trim(date)) as x from condition_reports group by id), p as (select id, x, {DAY}::date as day from c) select id, x is null or (day is not null and year(day) between 1900 and 2100) as passed, strftime(case when year(day) between 1900 and 2100 then day end, '%Y-%m-%d') as normalized from p")
def date_validate(spark, d):
    c = table(spark, d, "condition_reports").groupBy("id").agg(F.min(F.trim("date")).alias("date"))
    v = V.date_verdict(F.col("date"))
    return c.select("id", v["passed"].alias("passed"), v["normalized"].alias("normalized"))


@query(f"with {TRAILS} select id, distance_mi is null or (distance_mi > 0 and distance_mi <= 100) as miles_ok, elevation_ft is null or (elevation_ft > 0 and elevation_ft <= 20000) as feet_ok, case when distance_mi > 0 and distance_mi <= 100 then distance_mi end as miles from t")
def range_validate(spark, d):
    miles, feet = V.range_verdict(F.col("distance_mi"), V.MAX_MILES), V.range_verdict(F.col("elevation_ft"), V.MAX_FEET)
    return trails(spark, d).select("id", miles["passed"].alias("miles_ok"), feet["passed"].alias("feet_ok"), V.coerced(F.col("distance_mi"), miles).cast("double").alias("miles"))


BOILER = ", ".join(f"'{w}'" for w in V.BOILERPLATE)


@query(f"with {TRAILS}, w as (select id, name, lower(coalesce(description, '')) as src, list_filter(regexp_split_to_array(regexp_replace(name, '[-,'']', ' ', 'g'), '\\s+'), lambda x: length(x) >= 4 and lower(x) not in ({BOILER})) as ws from t) select id, name is null or (trim(name) <> '' and case when len(ws) > 0 then len(list_filter(ws, lambda x: not contains(src, lower(x)))) = 0 else contains(src, lower(trim(name))) end) as grounded from w")
def grounding(spark, d):
    v = V.grounded_verdict(F.col("name"), F.coalesce("description", F.lit("")))
    return trails(spark, d).select("id", v["passed"].alias("grounded"))


@query(f"with {TRAILS} select id, len(list_filter(list_transform(coalesce(features, []), lambda x: trim(x)), lambda x: x is not null and x <> '')) as features from t")
def clean_features(spark, d):
    return trails(spark, d).select("id", F.size(V.clean_list(F.col("features"))).cast("long").alias("features"))


@query(f"with {TRAILS} select id, name, difficulty from t where contains(lower(park), 'lor') and case lower(difficulty) when 'easy' then 0 when 'moderate' then 1 else 2 end <= 1 and len(list_filter(coalesce(features, []), lambda x: contains(lower(x), 'lake') or contains(lower(x), 'board'))) > 0 order by id limit 8")
def facet_search(spark, d):
    return catalog.search_trails(trails(spark, d), "lor", "moderate", ["lake", "board"]).select("id", "name", "difficulty")


@query(f"with {TRAILS} select park from (select distinct park from t where park is not null) where contains(lower(park), 'lorincrest') or contains('lorincrest', lower(park)) order by park limit 1")
def park_lookup(spark, d):
    parks = trails(spark, d).select("park").where("park is not null").distinct()
    return catalog.park_match(parks, "Lorincrest", position="park").select("park")


@query(f"with {TRAILS} select id from t where id = 'trail-00000007' or contains(lower(name), 'trail-00000007') order by id limit 1")
def target_resolution(spark, d):
    return catalog.resolve(trails(spark, d), "trail-00000007").select("id")


@query("select doc_id, case when len(string_split(text, '---')) >= 3 then length(regexp_replace(regexp_replace(substr(text, strpos(text, '---') + 3 + strpos(substr(text, strpos(text, '---') + 3), '---') + 2), '^\\s+', ''), '\\s+$', '')) else length(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')) end as body_length from documents where text is not null")
def front_matter(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.length(X.without_front_matter(F.col("text"))).cast("long").alias("body_length"))


@query(f"with {TRAILS} select id, case when length(description) > 70 then rtrim(left(description, 70), ' ') || '...' else description end as clipped, case when length(description) > 60 then left(description, 59) || '…' else description end as cut from t")
def clipping(spark, d):
    return trails(spark, d).select("id", X.clipped(F.col("description"), 70).alias("clipped"), X.truncated(F.col("description"), 60).alias("cut"))


@query("with x as (select doc_id, regexp_extract(text, '(?:^|\\n)#\\s+([^\\n]*)', 1) as title, regexp_matches(text, '(?:^|\\n)#\\s+') as titled, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as body from documents where text is not null) select doc_id || ':00' as chunk_id, doc_id || '.md' as source, md5('[' || case when titled then regexp_replace(title, '^\\s+|\\s+$', '', 'g') else doc_id::varchar end || ']' || chr(10) || chr(10) || body) as digest from x")
def section_chunks(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("name"), "text")
    return sections.chunk_documents(docs).select("chunk_id", "source", F.md5("text").alias("digest"))


@query(f"with {TRAILS} select struct_pack(id := id, name := name, park := park)::json::varchar as packed from t")
def json_rows(spark, d):
    return trails(spark, d).select(F.to_json(F.struct("id", "name", "park"), {"ignoreNullFields": "false"}).alias("packed"))


@query(f"with {REVIEWS} select id, md5({quoted(MODES['briefing'] + ' ' + AUDIENCES['ranger'])} || chr(10) || chr(10) || 'Report:' || chr(10) || text) as prompt from r where text is not null")
def prompt_render(spark, d):
    r = reviews(spark, d).where("text is not null")
    return r.select("id", F.md5(summary_prompt(F.col("text"), "briefing", "ranger")).alias("prompt"))


@query(f"with {TRAILS} select id, case when description = '' then '' else '  | ' || replace(description, chr(10), chr(10) || '  | ') end as indented from t")
def indenting(spark, d):
    return trails(spark, d).select("id", X.indented(F.col("description")).alias("indented"))


@query("select doc_id, contains(text, 'The provided documents don''t say.') as refusal, starts_with(upper(text), 'ESCALATE') as escalated from documents where text is not null")
def answer_flags(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.refused(F.col("text")).alias("refusal"), review.escalated(F.col("text")).alias("escalated"))


@query(f"with {DIST}, s as (select label, avg(distance) as mean, stddev_pop(distance) as sd from d where id < 250 group by label) select id, label, round(distance - mean - sd, 6) as excess from d join s using (label) where distance > mean + sd")
def anomaly_baseline(spark, d):
    rows = anomaly.flagged(vectors.distances(items(spark, d), "label"), "label", 1.0, baseline=F.col("id") < 250)
    return rows.select("id", "label", six(F.col("distance") - F.col("threshold")).alias("excess"))


@query(f"with {TRAILS} select id, lower(difficulty) in ('permit', 'conditions', 'complaint', 'lost-and-found', 'emergency', 'general', 'unsure') as passed from t where difficulty is not null")
def enum_validate(spark, d):
    return trails(spark, d).where("difficulty is not null").select("id", V.category_verdict(F.lower("difficulty"))["passed"].alias("passed"))


@query(f"with {REVIEWS} select id, case when ends_with(id, '3') then 'Told in [invalid-citation-removed]' when ends_with(id, '5') then {quoted(X.REFUSAL)} else 'Told in [' || id || ':1]' end as answer, right(id, 1) in ('3', '7') as retried, ends_with(id, '3')::int as removed from r where text is not null")
def citation_repair(spark, d):
    """Wrong twice, right at the second try, a refusal that cites, and right at once."""
    rows = reviews(spark, d).where("text is not null")
    q = rows.select("id", F.col("id").alias("prompt"), F.array(F.concat("id", F.lit(":1"))).alias("retrieved"))

    def reply(prompt: str) -> str:
        i, again = prompt.split("\n")[0], "Cite only" in prompt
        if i.endswith("5"):
            return f"{X.REFUSAL} [{i}:2]"
        return f"Told in [{i}:{2 if i.endswith('3') or (i.endswith('7') and not again) else 1}]"

    return cited_answers(q, FakeProvider(reply=reply)).select("id", "answer", "retried", "removed")


@query(f"with {REVIEWS} select case when rating >= 4 then 'positive' else 'negative' end as first, case when rating >= 3 then 'positive' else 'negative' end as second, count(*) as rows from r where rating is not null group by all")
def two_models(spark, d):
    rows = reviews(spark, d).where("rating is not null").select("id", F.col("rating").cast("string").alias("prompt"))
    strict = FakeProvider("strict", reply=lambda p: "Positive." if int(p) >= 4 else "negative")
    mild = FakeProvider("mild", reply=lambda p: "positive, mostly" if int(p) >= 3 else " negative")
    return compared(rows, strict, mild).groupBy("first", "second").agg(F.count("*").alias("rows"))


@query(f"with {REVIEWS} select count(*) as rows, count(distinct coalesce(text, '')) as cached, count(distinct coalesce(text, '')) as cached_again from r")
def embedding_cache(spark, d):
    """Reviews embedded by the stand-in, twice; equal texts share one cached vector, and the second time none is added."""
    cache = working_folder(spark, "cache")
    rows = reviews(spark, d).select("id", "text")
    first = embedded(rows, FakeProvider(), cache, task="search").count()
    on_file = spark.read.parquet(cache).count()
    embedded(rows, FakeProvider(), cache, task="search").count()
    return spark.createDataFrame([(first, on_file, spark.read.parquet(cache).count())], "rows long, cached long, cached_again long")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
