"""Queries over stored tables and rankings: upserts, imports, refreshes, agreement, reports; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text
from ..operators import evaluate, maintain, ranking, recall, tags
from ..operators.snapshots import SnapshotTable
from ..sources import records
from ..storage import new_folder
from .bindings import bind, read, with_ctes

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


@query(
    "upserted",
    """WITH u AS (SELECT o_custkey AS id, o_totalprice AS value, o_orderdate AS updated_at FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1)
 SELECT id, value, updated_at FROM u UNION ALL SELECT c_custkey, c_acctbal, TIMESTAMP '1990-01-01' FROM customer WHERE c_custkey NOT IN (SELECT id FROM u)""",
)
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"), F.expr("timestamp'1990-01-01'").cast(read(spark, sf_dir, "orders").schema["o_orderdate"].dataType).alias("updated_at"))
    updates = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("value"), F.col("o_orderdate").alias("updated_at"), "o_orderkey")
    return maintain.upsert(target, updates, ["id"], tie=["o_orderkey"]).select("id", "value", "updated_at")


@query("latest_orders", "SELECT o_orderkey AS id, o_orderdate AS updated_at FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def latest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.list_latest(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("updated_at")), 50)


@query("deleted_keys", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def deleted_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = read(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id"))
    return maintain.delete_keys(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), gone, ["id"])


@query("missing_ids", "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.missing_ids(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "doc_id")


@query("store_counts", " UNION ALL ".join(f"SELECT '{t}' AS store, count(*) AS n FROM {t}" for t in ("part", "customer", "orders", "embeddings")))
def store_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.store_counts({t: read(spark, sf_dir, t) for t in ("part", "customer", "orders", "embeddings")})


@query("content_dedupe", "SELECT doc_id, content_sha1 FROM (SELECT doc_id, sha1(text) AS content_sha1, row_number() OVER (PARTITION BY sha1(text) ORDER BY n_chars, doc_id) AS rn FROM documents) WHERE rn = 1")
def content_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.first_of_content(read(spark, sf_dir, "documents"), F.col("text"), ["n_chars", "doc_id"]).select("doc_id", "content_sha1")


_FILES = "SELECT concat('doc', doc_id, '.txt') AS name, n_chars AS size, text FROM documents"
_STATUS = f"""SELECT name, concat('resume-', substr(h, 1, 12)) AS id, CASE WHEN known THEN 'existing' WHEN size > 12000 THEN 'large' WHEN NOT open THEN 'empty' WHEN rn > 1 THEN 'duplicate' ELSE 'imported' END AS status
 FROM (SELECT *, row_number() OVER (PARTITION BY h, open ORDER BY size, lower(name), name) AS rn FROM (SELECT f.*, k.name IS NOT NULL AS known, sha1(coalesce(text, '')) AS h, k.name IS NULL AND size <= 12000 AND trim(coalesce(text, '')) <> '' AS open
 FROM ({_FILES}) f LEFT JOIN (SELECT DISTINCT concat('doc', doc_id, '.txt') AS name FROM labels WHERE toxic = 1) k ON f.name = k.name))"""


def _imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("doc"), "doc_id", F.lit(".txt")).alias("name")
    files = read(spark, sf_dir, "documents").select(name, F.col("n_chars").alias("size"), "text")
    return maintain.import_status(files, read(spark, sf_dir, "labels").filter("toxic = 1").select(name), 12000)


@query("import_status", _STATUS)
def import_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _imported(spark, sf_dir).select("name", "id", "status")


@query("import_counts", f"SELECT status, count(*) AS n FROM ({_STATUS}) GROUP BY status")
def import_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.import_counts(_imported(spark, sf_dir))


@query("stale_vectors", """SELECT CAST(doc_id AS VARCHAR) AS item_id, sha256(concat_ws(' ', nullif(source, ''), nullif(text, ''))) AS payload_hash FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0""")
def stale_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    docs = read(spark, sf_dir, "documents").select("doc_id", c("doc_id").cast("string").alias("item_id"), F.lit("jobs").alias("namespace"), recall.payload_text(c("source"), F.array("text"), text.strings()).alias("payload"))
    stored = docs.filter("doc_id % 3 <> 0").select("namespace", "item_id", F.when(c("doc_id") % 5 == 0, "old").otherwise(text.payload_hash(c("payload"))).alias("payload_hash"))
    return recall.stale_payloads(docs.drop("doc_id"), stored).select("item_id", "payload_hash")


_AGREE = """SELECT resume_id, count(*) AS n, CASE WHEN count(*) <= 1 THEN 1.0E0 ELSE round(1 - 6.0E0 * sum((rank_a - rank_b) * (rank_a - rank_b)) / (count(*) * (count(*) * count(*) - 1)), 6) END AS rho, count(*) FILTER (rank_a <= 5 AND rank_b <= 5) AS top_overlap FROM fx_rank GROUP BY resume_id"""


@query("rank_agreement", with_ctes(["fx_rank"], f"SELECT *, CASE WHEN rho >= 0.8 THEN 'strong' WHEN rho >= 0.5 THEN 'medium' ELSE 'weak' END AS label FROM ({_AGREE})"))
def rank_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.spearman(bind(spark, sf_dir, "fx_rank")).select("resume_id", "n", "rho", "top_overlap", evaluate.rho_label(F.col("rho")).alias("label"))


@query("agreement_summary", with_ctes(["fx_rank"], f"""SELECT label, count(rho) AS rho_n, round(avg(rho), 4) AS rho_mean, round(median(rho), 4) AS rho_median, round(min(rho), 4) AS rho_min, round(max(rho), 4) AS rho_max, count(o) AS o_n, round(avg(o), 4) AS o_mean, round(median(o), 4) AS o_median, min(o) AS o_min, max(o) AS o_max
 FROM (SELECT rho, top_overlap::DOUBLE AS o, CASE WHEN rho >= 0.8 THEN 'strong' WHEN rho >= 0.5 THEN 'medium' ELSE 'weak' END AS label FROM ({_AGREE})) GROUP BY label"""))
def agreement_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.summarize(rank_agreement(spark, sf_dir).withColumnRenamed("top_overlap", "o"), ["rho", "o"], ["label"])


@query("rank_shifts", with_ctes(["fx_rank"], """SELECT resume_id, item, rank_a - rank_b AS shift, abs(rank_a - rank_b) >= 3 AS is_big, CAST(row_number() OVER (PARTITION BY resume_id ORDER BY abs(rank_a - rank_b) DESC, rank_a, item) AS INT) AS shift_order FROM fx_rank"""))
def rank_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.rank_shift(bind(spark, sf_dir, "fx_rank")).select("resume_id", "item", "shift", "is_big", "shift_order")


@query(
    "repaired_orders",
    with_ctes(["fx_rank"], """WITH l AS (SELECT resume_id, item, rank_b AS pos FROM fx_rank WHERE item % 3 <> 0 UNION ALL SELECT resume_id, item, rank_b + 50 FROM fx_rank WHERE item % 4 = 0 UNION ALL SELECT resume_id, -item, rank_b FROM fx_rank), f AS (SELECT resume_id, item, min(pos) AS pos FROM l GROUP BY ALL)
 SELECT c.resume_id, c.item AS job_id, CAST(row_number() OVER (PARTITION BY c.resume_id ORDER BY pos IS NULL, pos, rank_a) AS INT) AS position, pos IS NULL AS appended FROM fx_rank c LEFT JOIN f ON c.resume_id = f.resume_id AND c.item = f.item"""),
)
def repaired_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = bind(spark, sf_dir, "fx_rank").withColumnRenamed("item", "job_id")
    listed = r.filter("job_id % 3 <> 0").select("resume_id", "job_id", F.col("rank_b").alias("pos")).unionByName(r.filter("job_id % 4 = 0").select("resume_id", "job_id", (F.col("rank_b") + 50).alias("pos"))).unionByName(r.select("resume_id", (-F.col("job_id")).alias("job_id"), F.col("rank_b").alias("pos")))
    return evaluate.repair_order(listed, r.select("resume_id", "job_id", F.col("rank_a").alias("rank")))


@query("score_payloads", """SELECT o_orderkey AS id, CASE WHEN o_totalprice / 3000 BETWEEN 0 AND 100 THEN round(CAST(CAST(round(o_totalprice / 3000, 3) AS VARCHAR) AS DOUBLE), 1) END AS score, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 150 <= 100 THEN (o_orderkey % 150)::DOUBLE END AS skill FROM orders""")
def score_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores as JSON texts, three digits where they are valid: one just over 100 must not be rounded into the range."""
    ratio = F.col("o_totalprice") / 3000
    score = F.when(ratio.between(0, 100), F.round(ratio * 1000) / 1000).otherwise(ratio).cast("string")
    payload = F.to_json(F.create_map(F.lit("score"), score, F.lit("skill"), F.when(F.col("o_orderkey") % 3 == 0, "n/a").otherwise((F.col("o_orderkey") % 150).cast("string"))))
    return evaluate.validate_scores(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), payload.alias("payload"))).select("id", "score", "skill")


@query("fill_report", """SELECT field, count(*) FILTER (NOT a AND b) AS filled, count(*) FILTER (a AND b) AS kept, count(*) FILTER (a AND NOT b) AS lost FROM (SELECT 'quality' AS field, d.doc_id % 2 = 0 AS a, l.quality IS NOT NULL AS b FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
 UNION ALL SELECT 'toxic', l.toxic IS NOT NULL AND l.toxic = 1, d.text <> '' FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) GROUP BY field""")
def fill_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = read(spark, sf_dir, "documents").select("doc_id", "text").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return evaluate.fill_report(rows, {"quality": (F.when(c("doc_id") % 2 == 0, "x"), c("quality")), "toxic": (F.when(c("toxic") == 1, "x"), c("text"))})


@query("external_ranks", """SELECT l_orderkey AS resume_id, l_linenumber AS job_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_discount DESC, coalesce(CASE WHEN l_returnflag <> 'R' THEN l_tax END, 0) DESC, l_extendedprice, l_linenumber) AS INT) AS rank FROM lineitem""")
def external_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, z = F.col, F.lit(0.0)
    rows = read(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("resume_id"), c("l_linenumber").alias("job_id"), c("l_quantity").alias("score"), c("l_discount").alias("domain"), F.when(c("l_returnflag") != "R", c("l_tax")).alias("skill"),
        z.alias("experience"), z.alias("location"), z.alias("education"), z.alias("salary"), c("l_extendedprice").alias("transition_cost"),
    )
    return ranking.rank_external(rows).select("resume_id", "job_id", "rank")


@query("top_parts", "SELECT p_type, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn <= 3")
def top_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_per_group(read(spark, sf_dir, "part"), ["p_type"], [F.desc("p_retailprice"), "p_partkey"], 3).select("p_type", "p_partkey")


_TAGS = """SELECT p_partkey AS job_id, split_part(p_name, ' ', 2) AS name, 'tech' AS category FROM part UNION ALL SELECT p_partkey, p_type, 'domain' FROM part WHERE p_size % 2 = 0"""
_AFTER = """SELECT p_partkey AS job_id, split_part(p_name, ' ', 2) AS name, 'tech' AS category FROM part UNION ALL SELECT p_partkey, p_type, CASE WHEN p_size % 3 = 0 THEN 'industry' ELSE 'domain' END FROM part WHERE p_size % 4 <> 1"""


def _two_tags(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = read(spark, sf_dir, "part")
    return spark.sql(_TAGS.replace("FROM part", "FROM {part}"), part=part), spark.sql(_AFTER.replace("FROM part", "FROM {part}"), part=part)


@query("tag_category_counts", f"SELECT coalesce(a.category, b.category) AS category, coalesce(na, 0) AS n_before, coalesce(nb, 0) AS n_after FROM (SELECT category, count(*) AS na FROM ({_TAGS}) GROUP BY 1) a FULL JOIN (SELECT category, count(*) AS nb FROM ({_AFTER}) GROUP BY 1) b ON a.category = b.category")
def tag_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.tag_counts(*_two_tags(spark, sf_dir))


@query("retagged_rows", f"""SELECT b.job_id, b.tags FROM (SELECT job_id, string_agg(concat(category, ':', name), ',' ORDER BY category, name) AS tags FROM ({_AFTER}) GROUP BY 1) b LEFT JOIN (SELECT job_id, string_agg(concat(category, ':', name), ',' ORDER BY category, name) AS tags FROM ({_TAGS}) GROUP BY 1) a ON a.job_id = b.job_id WHERE a.tags IS DISTINCT FROM b.tags""")
def retagged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = lambda df: df.groupBy("job_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "category", "name"))), ",").alias("tags"))
    before, after = _two_tags(spark, sf_dir)
    return maintain.changed_rows(flat(before), flat(after), "job_id", ["tags"]).select("job_id", "tags")


@query("merged_tags", f"""SELECT job_id, category, name FROM (SELECT *, row_number() OVER (PARTITION BY job_id, category, lower(name) ORDER BY src) AS rn FROM (SELECT *, 0 AS src FROM ({_TAGS}) UNION ALL SELECT job_id, upper(name), category, 1 FROM ({_AFTER}))) WHERE rn = 1""")
def merged_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _two_tags(spark, sf_dir)
    return tags.merge_tags(before, after.withColumn("name", F.upper("name"))).select("job_id", "category", "name")


@query(
    "built_tags",
    """WITH c AS (SELECT o_custkey AS job_id, split_part(p_name, ' ', 2) AS name, CASE l_linenumber % 3 WHEN 0 THEN 'tech' WHEN 1 THEN 'domain' ELSE 'general' END AS category, CAST(l_quantity AS INT) % 5 + 1 AS weight, l_orderkey * 10 + l_linenumber AS pos FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey),
 k AS (SELECT *, CASE category WHEN 'tech' THEN 0 WHEN 'domain' THEN 2 ELSE 6 END AS pr, CASE WHEN category = 'tech' THEN concat('tech:', lower(name)) ELSE lower(name) END AS k FROM c),
 a AS (SELECT *, row_number() OVER (PARTITION BY job_id, k ORDER BY pr, weight DESC, pos) AS rn FROM k), b AS (SELECT *, row_number() OVER (PARTITION BY job_id, category ORDER BY weight DESC, lower(name)) AS rc FROM a WHERE rn = 1)
 SELECT job_id, name, category, weight, CAST(row_number() OVER (PARTITION BY job_id ORDER BY pr, weight DESC, lower(name)) AS INT) AS position FROM b WHERE rc <= CASE category WHEN 'tech' THEN 8 WHEN 'domain' THEN 4 ELSE 3 END""",
)
def built_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "lineitem"), c("o_orderkey") == c("l_orderkey")).join(read(spark, sf_dir, "part"), c("l_partkey") == c("p_partkey"))
    kind = F.when(c("l_linenumber") % 3 == 0, "tech").when(c("l_linenumber") % 3 == 1, "domain").otherwise("general")
    named = rows.select(c("o_custkey").alias("job_id"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("name"), kind.alias("category"), (c("l_quantity").cast("int") % 5 + 1).alias("weight"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("pos"))
    return tags.build_tags(named)


@query("audit_log", """SELECT o_custkey AS resume_id, string_agg(concat(o_orderkey, ':', o_orderstatus), ',' ORDER BY o_orderkey) AS log FROM orders GROUP BY o_custkey""")
def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("resume_id"), F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("recall_rank"))
    log = records.match_audit(rows, ["job_id", "status"])
    parsed = F.from_json("entry", "struct<resumeId: long, candidates: array<struct<jobId: long, status: string>>>")
    return log.select("resume_id", F.array_join(F.transform(parsed["candidates"], lambda x: F.concat_ws(":", x["jobId"].cast("string"), x["status"])), ",").alias("log"))


@query("camel_json", """SELECT p_partkey AS id, concat('{"jobId":', p_partkey, ',"basicInfo":{"jobTitle":"', p_name, '","salaryMin":', p_size, '}}') AS json FROM part""")
def camel_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = read(spark, sf_dir, "part").select(c("p_partkey").alias("job_id"), F.struct(c("p_name").alias("job_title"), c("p_size").alias("salary_min")).alias("basic_info"))
    return records.to_json_camel(rows).select(c("job_id").alias("id"), c("json"))


@query("prompt_payloads", with_ctes(["fx_text"], """SELECT job_id, concat('{"title":"', title, '","summary":"', summary, '","skills":["', company, '"],"keywords":["', replace(part_name, ' ', '","'), '"]}') AS payload FROM fx_text"""))
def prompt_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return bind(spark, sf_dir, "fx_text").select("job_id", evaluate.prompt_payload(c("title"), c("summary"), F.array("company"), F.split("part_name", " ")).alias("payload"))


@query("set_operations", """SELECT c_custkey AS id, list_has_any([c_mktsegment, 'a'], ['a', 'BUILDING']) AS overlap, c_mktsegment IN ('BUILDING', 'MACHINERY') AS shared, CASE WHEN c_mktsegment = 'BUILDING' THEN 'a' ELSE concat(c_mktsegment, ',a') END AS only_left FROM customer""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.array("c_mktsegment", F.lit("a"))
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.arrays_overlap(a, text.strings("a", "BUILDING")).alias("overlap"), (F.size(F.array_intersect(a, text.strings("BUILDING", "MACHINERY"))) > 0).alias("shared"), F.array_join(F.array_except(a, text.strings("BUILDING")), ",").alias("only_left"),
    )


@query(
    "experience_scores",
    with_ctes(["fx_pairs", "fx_people", "fx_text"], """SELECT resume_id, job_id, round(CASE WHEN c = 0 THEN 0 ELSE c * 0.75 + CASE WHEN need <= 0 THEN 1 ELSE least(years / need::DOUBLE, 1) END * 0.25 END + 1e-9, 6) AS score FROM
 (SELECT resume_id, job_id, years, min_years AS need, CASE WHEN list_contains(terms, t) THEN 1 WHEN contains(lower(raw_text), t) THEN 0.85 WHEN len(list_filter(terms, lambda x: contains(x, t) OR contains(t, x))) > 0 THEN 0.7 ELSE 0 END AS c
 FROM (SELECT p.resume_id, p.job_id, r.years, r.raw_text, x.min_years, string_split(lower(r.summary), ' ') AS terms, lower(split_part(x.summary, ' ', 1)) AS t FROM fx_pairs p JOIN fx_people r ON p.resume_id = r.resume_id JOIN fx_text x ON p.job_id = x.job_id))"""),
)
def experience_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    people = bind(spark, sf_dir, "fx_people").select("resume_id", c("years").cast("double").alias("years"), F.lower("raw_text").alias("raw"), F.split(F.lower("summary"), " ").alias("terms"))
    jobs = bind(spark, sf_dir, "fx_text").select("job_id", F.split_part("summary", F.lit(" "), F.lit(1)).alias("term"), c("min_years").cast("double").alias("need"))
    rows = bind(spark, sf_dir, "fx_pairs").join(people, "resume_id").join(jobs, "job_id")
    return rows.select("resume_id", "job_id", text.r4(S.experience_score(S.term_hit(c("term"), c("terms"), c("raw")), c("years"), c("need")), 6).alias("score"))


DOMAIN_OVERLAP = """(SELECT resume_id, job_id, vector, CASE WHEN e > 0 THEN least(e / least(len(a), 4)::DOUBLE, 1) ELSE least(len(list_filter(b, lambda t: length(t) >= 2 AND contains(txt, t))) / least(len(b), 4)::DOUBLE * 0.8, 0.8) END AS o
 FROM (SELECT *, len(list_intersect(a, b)) AS e FROM (SELECT p.resume_id, p.job_id, p.vector, list_distinct(string_split(lower(x.part_name), ' ') || [lower(x.company)]) AS a, list_distinct(string_split(lower(r.summary), ' ') || [CASE WHEN r.resume_id % 4 = 0 THEN lower(x2.w) ELSE 'zz' END]) AS b, lower(concat(x.title, ' ', x.summary)) AS txt
 FROM fx_pairs p JOIN fx_people r ON p.resume_id = r.resume_id JOIN fx_text x ON p.job_id = x.job_id JOIN (SELECT c_custkey, lower(c_mktsegment) AS w FROM customer) x2 ON x2.c_custkey = r.resume_id)))"""


def domain_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Openings with their domain terms and text, and people with theirs."""
    c = F.col
    words = read(spark, sf_dir, "customer").select(c("c_custkey").alias("resume_id"), F.lower("c_mktsegment").alias("w"))
    people = bind(spark, sf_dir, "fx_people").join(words, "resume_id").select("resume_id", F.array_distinct(F.concat(F.split(F.lower("summary"), " "), F.array(F.when(c("resume_id") % 4 == 0, c("w")).otherwise("zz")))).alias("terms"))
    jobs = bind(spark, sf_dir, "fx_text").select("job_id", F.array_distinct(F.concat(F.split(F.lower("part_name"), " "), F.array(F.lower("company")))).alias("job_terms"), F.lower(F.concat("title", F.lit(" "), "summary")).alias("txt"))
    return jobs, people


@query(
    "domain_scores",
    with_ctes(["fx_pairs", "fx_people", "fx_text"], f"""SELECT resume_id, job_id, round(o + 1e-9, 6) AS overlap, round(CASE WHEN o = 0 THEN greatest(vector, 0.5) ELSE greatest(o, vector) END + 1e-9, 6) AS domain FROM {DOMAIN_OVERLAP}"""),
)
def domain_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    jobs, people = domain_sides(spark, sf_dir)
    rows = bind(spark, sf_dir, "fx_pairs").join(people, "resume_id").join(jobs, "job_id").withColumn("overlap", S.domain_overlap(c("job_terms"), c("terms"), c("txt")))
    return rows.select("resume_id", "job_id", text.r4(c("overlap"), 6).alias("overlap"), text.r4(S.domain_score(c("overlap"), c("vector")), 6).alias("domain"))


@query(
    "snapshot_batches",
    """SELECT id, value, updated_at FROM (SELECT o_custkey AS id, o_totalprice AS value, o_orderdate AS updated_at, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey % 4 DESC, o_orderkey) AS place FROM orders) WHERE place = 1""",
)
def snapshot_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as four batches, of which older rows come late and the second comes again; a compaction lies between."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("value"), F.col("o_orderdate").alias("updated_at"), "o_orderkey")
    table = SnapshotTable(spark, new_folder(spark, "orders"), ["id"], buckets=8)
    for batch in (0, 1, 1, 2, 3):
        table.commit(orders.filter(F.col("o_orderkey") % 4 == batch), batch, tie=["o_orderkey"])
        if batch == 2:
            table.compact(buckets=4)
    return table.read().select("id", "value", "updated_at")
